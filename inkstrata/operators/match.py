"""Fuzzy search of fragments in texts, and replacement of what was found.

The similarity of two texts is 100 (1 - d / n), where d is the number of insertions and
deletions between them and n their total length. For one text and fragment all windows
are measured at once: the bit-parallel longest common subsequence runs over every start
of the text together, a step per character of the longest window.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkstrata.functions.rows import by_row
from inkstrata.functions.types import MATCH

PLACED = T.StructType([T.StructField("pos", T.IntegerType()), T.StructField("match", MATCH)])
LISTED = 1000  # replacements for all documents that are looked for in one call
SENT = 32 << 20  # bytes of replacements that are sent to the tasks at once


def common_lengths(text: str, fragment: str, longest: int) -> np.ndarray:
    """[k, i]: longest common subsequence of the fragment and the k characters of text from i; k from 0 to longest.

    The fragment's places are the bits of as many 64-bit words as it needs; a carry goes from word to word.
    """
    n, m = len(text), len(fragment)
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    out = np.zeros((longest + 1, n), np.int32)
    alphabet, which = np.unique(codes, return_inverse=True)
    bits: dict[int, int] = {}
    for j, c in enumerate(fragment):
        bits[ord(c)] = bits.get(ord(c), 0) | 1 << j
    sizes = [min(64, m - at) for at in range(0, m, 64)]
    fulls = [np.uint64((1 << size) - 1) for size in sizes]
    places = []
    for w in range(len(sizes)):
        masks = np.array([(bits.get(a, 0) >> 64 * w) & ((1 << 64) - 1) for a in alphabet.tolist()], np.uint64)
        places.append(np.append(masks[which], np.zeros(longest, np.uint64)))  # nothing matches beyond the end
    s = [np.full(n, full, np.uint64) for full in fulls]
    for k in range(1, longest + 1):
        carry = np.zeros(n, np.uint64)
        zeros = np.zeros(n, np.int64)
        for w, full in enumerate(fulls):
            u = s[w] & places[w][k - 1 : k - 1 + n]
            part = s[w] + u
            total = part + carry
            carry = ((part < u) | (total < part)).astype(np.uint64)
            s[w] = (total | (s[w] - u)) & full
            zeros += sizes[w] - np.bitwise_count(s[w])
        out[k] = zeros
    return out


def best_window(text: str, fragment: str, len_offset: int = 3) -> tuple[int, int, float] | None:
    """(start, end, ratio) of the window most like the fragment.

    Windows are len_offset shorter to len_offset - 1 longer than the fragment. Of equal
    ones the shortest counts, then the first. None if nothing is in common.
    """
    m, n = len(fragment), len(text)
    sizes = [k for k in range(m - len_offset, m + len_offset) if 0 < k <= n]
    if not sizes or not m:
        return None
    if m in sizes and (at := text.find(fragment)) >= 0:  # nothing is more like it, nothing shorter as like
        return at, at + m, 100.0
    common = common_lengths(text, fragment, sizes[-1])
    best = None
    for k in sizes:
        row = common[k, : n - k + 1]
        i = int(row.argmax())
        ratio = (1 - (m + k - 2 * int(row[i])) / (m + k)) * 100
        if ratio > (best[2] if best else 0):
            best = (i, i + k, ratio)
    return best


def _match(text: str | None, fragment: str | None, modified: str | None, len_offset: int) -> dict:
    hit = best_window(text, fragment, len_offset) if text and fragment else None
    found = (fragment, modified, text[hit[0] : hit[1]] if hit else None, {"start": hit[0], "end": hit[1]} if hit else None, hit[2] if hit else 0.0)
    return dict(zip(MATCH.names, found))


def match_struct(text: Column, fragment: Column, modified: Column, len_offset: int = 3) -> Column:
    """A match record of the best window; real_text and location are null and ratio 0 if there is none."""
    return by_row(lambda t, f, m: _match(t, f, m, len_offset), MATCH)(text, fragment, modified)


def matches_of(text: Column, wanted: Column, len_offset: int = 3) -> Column:
    """Array of (pos, match) for an array of (pos, fragment, modified), in its order: a text goes to Python once, whatever is looked for."""

    def run(t: str | None, ws: list[dict] | None) -> list[dict]:
        return [{"pos": w["pos"], "match": _match(t, w["fragment"], w["modified"], len_offset)} for w in ws or []]

    return by_row(run, T.ArrayType(PLACED))(text, wanted)


def _cuts(replacements: DataFrame) -> tuple[int, int]:
    """How many blocks and passes a list for all documents takes."""
    octets = F.sum(F.octet_length("fragment") + F.coalesce(F.octet_length("modified"), F.lit(0)))
    n, octets = replacements.agg(F.count("*"), octets).first()
    return max(1, -(-n // LISTED)), max(1, -(-(octets or 0) // SENT))


def _searched(docs: DataFrame, replacements: DataFrame, len_offset: int, how: str) -> DataFrame:
    """(row, doc_id, text, m): the matches of each text in one array, or in several rows for a long list without a doc_id."""
    docs = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    row = F.struct(F.col("pos").cast("int").alias("pos"), "fragment", "modified")
    searched = lambda pairs: pairs.select("row", "doc_id", "text", matches_of(F.col("text"), F.col("wanted"), len_offset).alias("m"))
    if "doc_id" in replacements.columns:
        wanted = replacements.groupBy("doc_id").agg(F.array_sort(F.collect_list(row)).alias("wanted"))
        return searched(docs.join(wanted, "doc_id", how))
    # One list for all documents, in blocks of about LISTED: mostly one row, which is sent to every task. What is sent at
    # once is SENT bytes at most; a longer list takes several passes over the documents.
    blocks, passes = _cuts(replacements)
    block = F.pmod(F.xxhash64("pos", "fragment", "modified"), F.lit(max(blocks, passes)))
    wanted = replacements.groupBy(block.alias("block")).agg(F.array_sort(F.collect_list(row)).alias("wanted"))
    parts = [wanted.where(F.pmod("block", F.lit(passes)) == k).drop("block") for k in range(passes)]
    return reduce(DataFrame.unionByName, (searched(docs.join(F.broadcast(part), F.lit(True), how)) for part in parts))


def find_matches(docs: DataFrame, replacements: DataFrame, len_offset: int = 3) -> DataFrame:
    """(doc_id, pos, match) for each text and each row of replacements (pos, fragment, modified).

    If replacements has a doc_id, rows meet their own document only.
    """
    return _searched(docs, replacements, len_offset, "inner").select("doc_id", F.inline("m"))


def replace_matches(text: Column, matches: Column, threshold: float = 80, at_location: bool = False) -> Column:
    """Replace the matches whose ratio is threshold or more, from the last start to the first, equal starts in order.

    Every occurrence of the found text is replaced, also in what an earlier replacement
    put there; with at_location only the place that was found. Matches without a
    location or a modified text change nothing.
    """
    ordered = F.array_sort(
        F.transform(
            matches,
            lambda m, i: F.struct(
                (-F.coalesce(m["location"]["start"], F.lit(-1))).alias("k"), i.alias("i"), m["real_text"].alias("old"), m["modified_text"].alias("new"),
                m["location"].alias("at"), m["ratio"].alias("ratio"),
            ),
        )
    )

    def step(done: Column, m: Column) -> Column:
        if at_location:
            new = F.concat(F.substr(done, F.lit(1), m["at"]["start"]), m["new"], F.substr(done, m["at"]["end"] + 1))
        else:
            new = F.replace(done, m["old"], m["new"])
        usable = m["old"].isNotNull() & (m["old"] != "") & m["new"].isNotNull() & m["at"].isNotNull() & (m["ratio"] >= threshold)
        return F.when(usable, new).otherwise(done)

    return F.when(matches.isNull(), text).otherwise(F.aggregate(ordered, text, step))


def apply_replacements(docs: DataFrame, replacements: DataFrame, threshold: float = 80, len_offset: int = 3) -> DataFrame:
    """(doc_id, text) with all replacements found and applied, in the order of the replacements' pos.

    What is found for a text in several blocks or passes is gathered again.
    """
    found = _searched(docs, replacements, len_offset, "left")
    if "doc_id" not in replacements.columns and max(_cuts(replacements)) > 1:
        found = found.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.first("text").alias("text"), F.array_sort(F.flatten(F.collect_list("m"))).alias("m"))
    return found.select("doc_id", replace_matches(F.col("text"), F.transform("m", lambda x: x["match"]), threshold).alias("text"))
