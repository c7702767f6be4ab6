"""Best-fit packing with a swap-based local search.

Every document is cut into pieces of at most `capacity` tokens (a token here is a
run of characters other than blanks; a character of a script without blanks between words,
such as Han, is one by itself; another length can be given). The pieces are spread by a
hash of their place in the table over shards of about `shard_rows` pieces, so the work is
divided evenly at any size and whatever the ids are. In a shard, best-fit decreasing makes
the first bins. Then the emptiest underfull bin gives its content to the other underfull
bins by moves, else one-for-one swaps, else two-for-one swaps (either way), of each kind the
one that increases the sum of squared fills most, until it is empty or nothing improves;
then the next. Between shards nothing is exchanged: of each some bins stay underfull.

Defined results
- One row per piece: doc_id, piece, start, n_tokens, bin_id, slot.
- A text that is null, empty or blank gives one row with n_tokens 0 and no bin.
- A text longer than the capacity gives full pieces, each alone in its bin, and a rest.
- Rows with a null or a repeated doc_id are packed each for itself.
- doc_id must be a column of integers; others are refused with a TypeError.
- Equal sizes are ordered by doc_id and piece; of equal gains the first counts. An empty table gives an empty result;
  columns other than doc_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkstrata.llm.common import cut_lineage, integer_id, whole_buckets
from inkstrata.llm.words import word_count

CAPACITY = 2048
SHARD_ROWS = 16384
TASKS = 10_000  # shards beyond that share tasks
SCHEMA = "doc_id long, piece long, start long, n_tokens long, bin_id long, slot long"


def best_fit_decreasing(sizes: list[int], capacity: int) -> list[list[int]]:
    """Bins of indices; sizes must be in decreasing order and at most capacity."""
    free: list[list[int]] = [[] for _ in range(capacity + 1)]
    there = 0  # bit r: some bin has room r
    bins: list[list[int]] = []
    for i, s in enumerate(sizes):
        room = there >> s
        if room:
            r = s + (room & -room).bit_length() - 1
            b = free[r].pop()
            if not free[r]:
                there &= ~(1 << r)
        else:
            r, b = capacity, len(bins)
            bins.append([])
        bins[b].append(i)
        if r > s:
            free[r - s].append(b)
            there |= 1 << (r - s)
    return bins


def _exchange(sizes: np.ndarray, source: list[int], fill_s: int, targets: list[int], bins: list[list[int]], fill: np.ndarray, capacity: int):
    """The exchange with the greatest gain: (target, indices out of the source, indices into it)."""
    items = [i for t in targets for i in bins[t]]
    owner = np.repeat(np.arange(len(targets)), [len(bins[t]) for t in targets])
    fills = fill[targets]
    slack = capacity - fills
    own = sizes[source]
    there = sizes[items]

    def best(net: np.ndarray, at: np.ndarray):
        """net[k, j]: what choice k moves into the bin at[j]."""
        ok = (net > 0) & (net <= slack[at]) & (fills[at] - fill_s + net > 0)
        if not ok.any():
            return None
        gain = np.where(ok, 2 * net * (fills[at] - fill_s + net), -1)
        k, j = np.unravel_index(int(gain.argmax()), gain.shape)
        return int(k), int(j)

    every = np.arange(len(targets))
    if hit := best(np.broadcast_to(own[:, None], (len(own), len(targets))), every):
        return targets[hit[1]], [source[hit[0]]], []
    if hit := best(own[:, None] - there[None, :], owner):
        return targets[owner[hit[1]]], [source[hit[0]]], [items[hit[1]]]
    pairs = list(combinations(range(len(source)), 2))
    if pairs:
        two = np.array([own[a] + own[b] for a, b in pairs])
        if hit := best(two[:, None] - there[None, :], owner):
            a, b = pairs[hit[0]]
            return targets[owner[hit[1]]], [source[a], source[b]], [items[hit[1]]]
    theirs = [(n, a, b) for n, t in enumerate(targets) for a, b in combinations(bins[t], 2)]
    if theirs:
        at = np.array([n for n, _, _ in theirs])
        two = np.array([sizes[a] + sizes[b] for _, a, b in theirs])
        if hit := best(own[:, None] - two[None, :], at):
            n, a, b = theirs[hit[1]]
            return targets[n], [source[hit[0]]], [a, b]
    return None


def local_search(sizes: list[int], bins: list[list[int]], capacity: int) -> list[list[int]]:
    """Empty underfull bins while an exchange increases the sum of squared fills."""
    size = np.asarray(sizes, dtype=np.int64)
    bins = [list(b) for b in bins]
    fill = np.array([size[b].sum() for b in bins], dtype=np.int64)
    changed = True
    while changed:
        changed = False
        for s in sorted(np.flatnonzero((fill > 0) & (fill < capacity)).tolist(), key=lambda b: (fill[b], b)):
            while bins[s] and fill[s] < capacity:
                targets = [t for t in np.flatnonzero((fill > 0) & (fill < capacity)).tolist() if t != s]
                step = _exchange(size, bins[s], int(fill[s]), targets, bins, fill, capacity) if targets else None
                if not step:
                    break
                t, out, back = step
                bins[s] = [i for i in bins[s] if i not in out] + back
                bins[t] = [i for i in bins[t] if i not in back] + out
                fill[s], fill[t] = size[bins[s]].sum(), size[bins[t]].sum()
                changed = True
    return [b for b in bins if b]


def pack_sizes(sizes: list[int], capacity: int) -> list[list[int]]:
    """Bins of indices into sizes, which must be in decreasing order."""
    return local_search(sizes, best_fit_decreasing(sizes, capacity), capacity)


def pack(docs: DataFrame, capacity: int = CAPACITY, shard_rows: int = SHARD_ROWS, length: Column | None = None) -> DataFrame:
    """Assign every document to bins of `capacity` tokens; see the module's text."""
    n = word_count(F.col("text")) if length is None else F.coalesce(length, F.lit(0)).cast("long")
    counted = docs.select(integer_id(docs), n.alias("n"))
    last = F.greatest(F.lit(0), F.ceil(F.col("n") / capacity) - 1).cast("long")
    spread = counted.select("doc_id", "n", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("piece"))
    pieces = cut_lineage(
        spread.select(
            "doc_id",
            "piece",
            (F.col("piece") * capacity).alias("start"),
            F.least(F.lit(capacity), F.col("n") - F.col("piece") * capacity).cast("long").alias("n_tokens"),
            F.monotonically_increasing_id().alias("at"),  # written, so that it stays when a task runs again
        )
    )
    shards = max(1, -(-pieces.where("n_tokens > 0").count() // shard_rows))

    def pack_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in whole_buckets(batches, 1):
            shard, n_tokens = columns[0].to_numpy(), columns[4].to_numpy()
            for rows in np.split(np.arange(len(shard)), np.flatnonzero(np.diff(shard)) + 1):
                bin_id, slot = np.empty((2, len(rows)), np.int64)
                for b, items in enumerate(pack_sizes(n_tokens[rows].tolist(), capacity)):
                    bin_id[items] = (int(shard[rows[0]]) << 32) + b
                    slot[items] = np.arange(len(items))
                own = [c.slice(int(rows[0]), len(rows)) for c in columns[1:]]
                yield pa.RecordBatch.from_arrays([*own, pa.array(bin_id), pa.array(slot)], ["doc_id", "piece", "start", "n_tokens", "bin_id", "slot"])

    tasks = min(shards, TASKS)
    sharded = pieces.where("n_tokens > 0").select(F.pmod(F.xxhash64("at"), F.lit(shards)).alias("shard"), "doc_id", "piece", "start", "n_tokens")
    placed = sharded.repartitionById(tasks, F.pmod("shard", F.lit(tasks)).cast("int")).sortWithinPartitions("shard", F.desc("n_tokens"), "doc_id", "piece")
    none = F.lit(None).cast("long")
    rest = pieces.where("n_tokens <= 0").drop("at").withColumn("bin_id", none).withColumn("slot", none)
    return placed.mapInArrow(pack_shards, SCHEMA).unionByName(rest)
