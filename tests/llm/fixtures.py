"""Small tables with the cases that every operator must take: nulls, empty and long texts, repeated rows, other columns."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long, _rank int, run int, shard int, n int"


def word(rng: random.Random) -> str:
    return "".join(rng.choice("abcdefghijklmnopqrstuvwxyzéü") for _ in range(rng.randint(3, 9)))


def prose(rng: random.Random, words: int, per_line: int = 9) -> str:
    out = [word(rng) for _ in range(words)]
    return "\n".join(" ".join(out[k : k + per_line]) + "." for k in range(0, words, per_line))


def documents(spark, rows):
    """rows of (doc_id, text[, source]); the other columns clash with names that operators use inside."""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "h", len(r[1] or ""), 7, 8, 9, 10) for r in rows]
    return spark.createDataFrame(full, DOCS)


def odd_rows(rng: random.Random) -> list[tuple]:
    """A null id, null, empty, blank, signs only, very long, a repeated row and a shared id."""
    one = prose(rng, 60)
    return [
        (None, one), (None, None), (1, None), (2, ""), (3, "  \n\t "), (4, "... !!!"), (5, prose(rng, 30_000)), (6, one), (6, one), (7, prose(rng, 40)),
        (7, prose(rng, 41)), (8, "字" * 50 + "\n" + "文" * 20), (9, "x" * 200_000), (10, "\x00   ퟿ 😀"),
    ]


def tuples(df, *columns):
    return sorted(map(tuple, df.select(*columns or df.columns).collect()), key=repr)
