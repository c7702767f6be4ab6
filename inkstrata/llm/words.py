"""Words as several operators see them: runs of non-blank characters, and single Han characters."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Thai, kana and Han: scripts without blanks between words. As ranges, which a regular expression tests far faster than names.
SINGLE = "\u0e00-\u0e7f\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"


def word_count(text: Column) -> Column:
    """Number of runs of characters that aren't ASCII blanks; those of SINGLE count one by one. A null has 0."""
    mixed = F.regexp_count(text, F.lit(rf"[{SINGLE}]|[^\s{SINGLE}]+"))
    n = F.when(text.rlike(f"[{SINGLE}]"), mixed).otherwise(F.regexp_count(text, F.lit(r"\S+")))
    return F.coalesce(n, F.lit(0)).cast("long")


HAN = re.compile(r"[㐀-鿿]")
EDGES = re.compile(r"^[\W_]+|[\W_]+$")


def split_words(text: str | None) -> list[str]:
    """Runs of non-blank characters; each Han character stands alone."""
    if not text:
        return []
    if not text.isascii():
        try:
            text.encode("latin-1")  # far quicker than a search, and most texts pass
        except UnicodeEncodeError:
            text = HAN.sub(r" \g<0> ", text)
    return text.split()


def normal(word: str) -> str:
    """Lower case, without the signs before and after."""
    return word.lower() if word.isalnum() else EDGES.sub("", word.lower())
