import random
import re
from collections import Counter
from itertools import combinations

from inkstrata.llm import packing, tokencount
from inkstrata.llm.words import SINGLE
from tests.llm.fixtures import documents, odd_rows, prose, tuples


def test_pack_sizes():
    rng = random.Random(1)
    for n in (0, 1, 5, 60, 200):
        sizes = sorted((rng.randint(1, 100) for _ in range(n)), reverse=True)
        first = packing.best_fit_decreasing(sizes, 100)
        bins = packing.local_search(sizes, first, 100)
        assert sorted(i for b in bins for i in b) == list(range(n))
        assert all(0 < sum(sizes[i] for i in b) <= 100 for b in bins)
        square = lambda bs: sum(sum(sizes[i] for i in b) ** 2 for b in bs)
        assert len(bins) <= len(first) and square(bins) >= square(first)


def test_search_empties_a_bin():
    # Best fit makes {6, 3}, {5, 4}, {2}: two swaps free room for the last bin.
    sizes = [6, 5, 4, 3, 2]
    bins = packing.local_search(sizes, [[0, 3], [1, 2], [4]], 10)
    assert max(sum(sizes[i] for i in b) for b in bins) == 10 and len(bins) == 2


def search_spec(sizes, bins, capacity):
    """The local search a choice at a time, by the squares of the fills themselves."""
    bins = [list(b) for b in bins]
    fill = lambda items: sum(sizes[i] for i in items)
    underfull = lambda: [b for b in range(len(bins)) if 0 < fill(bins[b]) < capacity]

    def exchanges(s, kind):
        """(target, out, back) of one kind, in order."""
        targets = [t for t in underfull() if t != s]
        give = [(i,) for i in bins[s]] if kind != "two for one" else list(combinations(bins[s], 2))
        for out in give:
            for t in targets:
                take = {"move": [()], "one for two": combinations(bins[t], 2)}.get(kind, [(i,) for i in bins[t]])
                for back in take:
                    yield t, out, back

    changed = True
    while changed:
        changed = False
        for s in sorted(underfull(), key=lambda b: (fill(bins[b]), b)):
            while bins[s] and fill(bins[s]) < capacity:
                chosen = None
                for kind in ("move", "one for one", "two for one", "one for two"):
                    most = 0
                    for t, out, back in exchanges(s, kind):
                        a, b = fill(bins[s]) - fill(out) + fill(back), fill(bins[t]) + fill(out) - fill(back)
                        gain = a * a + b * b - fill(bins[s]) ** 2 - fill(bins[t]) ** 2
                        if fill(out) > fill(back) and b <= capacity and gain > most:
                            most, chosen = gain, (t, out, back)
                    if chosen:
                        break
                if not chosen:
                    break
                t, out, back = chosen
                bins[s] = [i for i in bins[s] if i not in out] + list(back)
                bins[t] = [i for i in bins[t] if i not in back] + list(out)
                changed = True
    return [b for b in bins if b]


def test_search_by_brute_force():
    rng = random.Random(4)
    moved = 0
    for _ in range(60):
        capacity = rng.choice([10, 30, 100])
        sizes = sorted((rng.randint(1, rng.choice([capacity, capacity // 2])) for _ in range(rng.randint(1, 28))), reverse=True)
        first = packing.best_fit_decreasing(sizes, capacity)
        if rng.random() < 0.5:  # a bad start, so that all kinds of exchanges come up
            first = [[i] for i in range(len(sizes))]
            first = [a + b if sum(sizes[i] for i in a + b) <= capacity else a for a, b in zip(first[::2], first[1::2] + [[]])] + [
                b for a, b in zip(first[::2], first[1::2]) if sum(sizes[i] for i in a + b) > capacity
            ]
        want = search_spec(sizes, first, capacity)
        assert packing.local_search(sizes, first, capacity) == want
        moved += want != first
    assert moved > 20


def test_best_fit_by_brute_force():
    rng = random.Random(5)
    for _ in range(50):
        sizes = sorted((rng.randint(1, 40) for _ in range(rng.randint(0, 40))), reverse=True)
        room, fills = [], []
        for i, s in enumerate(sizes):
            fits = [r for r in room if r >= s]
            if fits:
                b = room.index(min(fits))
                room[b] -= s
            else:
                room.append(40 - s)
        got = packing.best_fit_decreasing(sizes, 40)
        assert sorted(sum(sizes[i] for i in b) for b in got) == sorted(40 - r for r in room)


def test_shards_are_even(spark):
    """Null ids, and a row that is repeated for a third of the table, are spread over the shards."""
    rows = [(None, "a b c")] * 400 + [(5, "d e")] * 500 + [(k, "f " * (k % 9 + 1)) for k in range(600)]
    got = packing.pack(documents(spark, rows), capacity=16, shard_rows=100).collect()
    by_shard = Counter(r.bin_id >> 32 for r in got)
    assert len(got) == 1500 and len(by_shard) == 15 and max(by_shard.values()) < 150


def test_pack(spark):
    rng = random.Random(2)
    docs = documents(spark, odd_rows(rng) + [(100 + k, prose(rng, rng.randint(1, 300))) for k in range(150)])
    rows = packing.pack(docs, capacity=256, shard_rows=64).collect()
    unit = re.compile(rf"[{SINGLE}]|[^\s{SINGLE}]+", re.A)
    want = Counter((r.doc_id, len(unit.findall(r.text or ""))) for r in docs.collect())
    pieces = Counter()
    fill = Counter()
    slots = {}
    for r in rows:
        pieces[r.doc_id] += r.n_tokens
        if r.n_tokens:
            fill[r.bin_id] += r.n_tokens
            slots.setdefault(r.bin_id, []).append(r.slot)
            assert r.start == r.piece * 256
        else:
            assert r.bin_id is None and r.slot is None
    total = Counter()
    for (doc, n), times in want.items():
        total[doc] += n * times
    assert +pieces == +total and set(pieces) == set(total) and total[8] == 70
    assert max(fill.values()) <= 256 and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert len(fill) <= 1.1 * (sum(fill.values()) / 256) + 4
    assert packing.pack(docs.limit(0)).count() == 0


def encoder():
    import base64

    import tiktoken

    with open(tokencount.VOCABULARY, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("whole", pat_str=r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+", mergeable_ranks=ranks, special_tokens={})


def test_token_counts(spark):
    rng = random.Random(3)
    rows = odd_rows(rng) + [(100 + k, " ".join(rng.choice(["it's", "a\n\n b", "12 34x", "—?!", "naïve", "  ", "<|endoftext|>", "日本語"]) for _ in range(rng.randint(0, 60)))) for k in range(80)]
    enc, want = encoder(), Counter()
    for doc, text in rows:
        want[doc] += len(enc.encode_ordinary(text)) if text else 0
    docs = documents(spark, rows)
    for hot in (200_000, 5, 0):  # all, some or none of the pre-tokens are sent to the tasks
        got = {r.doc_id: r.n_tokens for r in tokencount.token_counts(docs, hot=hot).collect()}
        assert got == dict(want)
    assert tokencount.token_counts(docs.limit(0)).count() == 0


def test_pretokens_count(spark):
    docs = documents(spark, [(1, "a b b"), (1, "c"), (2, None)])
    assert tuples(tokencount.token_counts(docs), "doc_id", "n_pretokens") == [(1, 4), (2, 0)]
