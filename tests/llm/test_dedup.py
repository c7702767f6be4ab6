import random

import numpy as np
import pytest

import corpus_pipeline
from inkstrata.llm import chunkdedup, linededup, simhash
from inkstrata.llm.common import whole_buckets
from inkstrata.llm.components import components
from inkstrata.llm.words import normal, split_words
from tests.llm.fixtures import documents, odd_rows, prose, tuples, word

# line dedup


def runs_spec(rows, size=3, groups=None):
    """Later places of every run of `size` lines, merged where they touch; with groups (document: kept one) none whose first place is in a copy."""
    group = lambda d: (groups or {}).get(d, d)
    lines = {}
    for doc, text in sorted(((d, t) for d, t in rows if d is not None and t is not None), key=lambda x: x[0]):
        lines[doc] = [(p, x.strip(" ")) for p, x in enumerate(text.split("\n")) if x.strip(" ")]
    first, out = {}, set()
    for doc, ls in lines.items():
        hit = []
        for s in range(len(ls) - size + 1):
            g = tuple(x for _, x in ls[s : s + size])
            if first.setdefault(g, (doc, s)) != (doc, s) and (not groups or doc == first[g][0] or group(doc) != group(first[g][0])):
                hit.append((s, first[g]))
        while hit:
            k = 1
            while k < len(hit) and hit[k][0] - hit[k - 1][0] <= size:
                k += 1
            a, b, (fd, fs) = hit[0][0], hit[k - 1][0] + size - 1, hit[0][1]
            out.add((doc, ls[a][0], ls[b][0], b - a + 1, fd, lines[fd][fs][0]))
            hit = hit[k:]
    return sorted(out)


def line_rows(seed):
    rng = random.Random(seed)
    pool = [f"line {k}" for k in range(6)] + ["", " ", " line 1 ", "line 2"]
    return [(k, "\n".join(rng.choice(pool) for _ in range(rng.randint(0, 14)))) for k in range(60)]


@pytest.mark.parametrize("size", [1, 2, 3, 5])
def test_runs(spark, size):
    rows = line_rows(size)
    assert tuples(linededup.repeated_runs(documents(spark, rows), size).drop("text_key")) == sorted(runs_spec(rows, size), key=repr)


@pytest.mark.parametrize("size", [3, 4, 8])
def test_selected_lines(spark, size):
    """The least hash of every window is selected, no other line is, and they are as few as winnowing promises."""
    rng = random.Random(size)
    rows = [(k, "\n".join(f"{word(rng)} {n}" for n in range(200))) for k in range(10)]
    found = linededup.selected_lines(documents(spark, rows), size).collect()
    windows = 10 * (200 - size + 1)
    assert 1.7 / (size + 1) <= len(found) / windows <= 2.3 / (size + 1)
    covered = sorted((r.doc_id, r.i - off) for r in found for off in r.offs)
    assert covered == sorted((d, s) for d in range(10) for s in range(200 - size + 1))
    for r in found:
        assert r.near[size - 1] == r.fp and all(r.fp == min(r.near[size - 1 - off : 2 * size - 1 - off]) for off in r.offs)


def test_a_line_repeated_in_other_company(spark):
    """Lines whose first place has other neighbours than the run that repeats."""
    runs = [(a, b, c) for a in "ABC" for b in "XYZ" for c in "MNO"]
    rows = [(k, "\n".join(r) + f"\n{k}") for k, r in enumerate(runs)] + [(100 + k, f"{k}!\n" + "\n".join(r)) for k, r in enumerate(runs)]
    got = tuples(linededup.repeated_runs(documents(spark, rows)).drop("text_key"))
    assert got == sorted([(100 + k, 1, 3, 3, k, 0) for k in range(27)], key=repr) == sorted(runs_spec(rows), key=repr)


def test_runs_of_rows_that_share_an_id(spark):
    lines = lambda *names: "\n".join(names)
    rows = [(1, lines("p", "q", "r", "x")), (2, lines("p", "q", "r", "end")), (2, lines("unique one", "unique two", "unique three", "unique four"))]
    docs = documents(spark, rows)
    runs = linededup.repeated_runs(docs)
    assert tuples(runs.drop("text_key")) == [(2, 0, 2, 3, 1, 0)]
    assert tuples(linededup.delete_runs(docs, runs), "doc_id", "text") == sorted([rows[0], (2, "end"), rows[2]], key=repr)
    with pytest.raises(TypeError):
        linededup.repeated_runs(docs.withColumn("doc_id", docs.doc_id.cast("string")))


def test_runs_in_odd_tables(spark):
    rng = random.Random(8)
    rows = odd_rows(rng)
    text = prose(rng, 80)
    rows += [(20, text), (21, "intro\n" + text + "\n\nend"), (22, text.replace("\n", "\r\n")), (23, text + "\n" + text)]
    docs = documents(spark, rows)
    runs = linededup.repeated_runs(docs)
    got = {r[0] for r in tuples(runs)}
    assert 6 not in got and {21, 23} <= got and None not in got  # a repeated row isn't a repeat of itself
    left = linededup.delete_runs(docs, runs)
    assert left.columns == docs.columns
    texts = {}
    for r in left.collect():
        texts.setdefault(r.doc_id, []).append(r.text)
    assert texts[21] == ["intro\n\nend"] and 23 not in texts
    assert texts[20] == [text] and texts[22] == [text.replace("\n", "\r\n")] and len(texts[None]) == 2 and texts[1] == [None] and texts[2] == [""]
    assert linededup.repeated_runs(docs.limit(0)).count() == 0
    assert linededup.repeated_runs(linededup.delete_runs(docs.where("doc_id >= 20"), runs)).count() == 0


def test_runs_that_near_copies_share(spark):
    """With the near copies given, a document keeps what it shares with its own copies and loses what it shares with others."""
    rng = random.Random(18)
    body, passage, other = prose(rng, 300).split("\n"), prose(rng, 60), prose(rng, 200)
    edited = list(body)
    edited[5] = "an edited line."
    rows = [(1, other + "\n" + passage), (2, "\n".join(body[:20]) + "\n" + passage + "\n" + "\n".join(body[20:])), (3, "\n".join(edited[:20]) + "\n" + passage + "\n" + "\n".join(edited[20:])),
            (4, prose(rng, 90) + "\n" + "\n".join(body[:10]))]
    docs = documents(spark, rows)
    copies = simhash.near_duplicates(docs)
    assert tuples(copies, "doc_id", "kept_doc_id") == [(3, 2)]
    left = dict(tuples(linededup.delete_runs(docs, linededup.repeated_runs(docs, copies=copies)), "doc_id", "text"))
    assert left[1] == rows[0][1] and left[2] == "\n".join(body) and left[3] == "\n".join(edited) and left[4] + "\n" + "\n".join(body[:10]) == rows[3][1]
    assert tuples(simhash.near_duplicates(documents(spark, sorted(left.items()))), "doc_id", "kept_doc_id") == [(3, 2)]


def test_short_runs_of_many_words(spark):
    w = lambda name, n: " ".join(f"{name}{k}" for k in range(n))
    one, two, han = w("a", 60), w("b", 30) + "\n\n" + w("c", 30), "字词" * 30
    rows = [(1, f"p\n{one}\nq\n{two}\nr"), (2, f"s\n{one}\nt"), (3, f"u\n{two}\nv"), (4, han), (5, f"x\n{han}"), (6, w("d", 49)), (7, w("d", 49)),
            (8, one), (9, "p\n" + one + "\nq\ny")]
    docs = documents(spark, rows)
    runs = linededup.repeated_runs(docs, min_words=50)
    assert tuples(runs.drop("text_key")) == [(2, 1, 1, 1, 1, 1), (3, 1, 3, 2, 1, 3), (5, 1, 1, 1, 4, 0), (8, 0, 0, 1, 1, 1), (9, 0, 2, 3, 1, 0)]
    assert dict(tuples(linededup.delete_runs(docs, runs), "doc_id", "text")) == dict(rows[:1]) | {
        2: "s\nt", 3: "u\nv", 4: han, 5: "x", 6: rows[5][1], 7: rows[6][1], 9: "y"}


# substring dedup


def cuts_spec(raw: bytes):
    """The cuts of one text, a byte at a time."""
    ends, start, h = [], 0, 0
    found = []
    for i, b in enumerate(raw):
        h = ((h << 1) + int(chunkdedup.GEAR[b])) & 0xFFFFFFFF
        if i + 1 >= chunkdedup.WINDOW and h >> (32 - chunkdedup.ZERO_BITS) == 0:
            e = i + 1
            while e < len(raw) and raw[e] & 0xC0 == 0x80:
                e += 1
            found.append(e)
    whole = lambda at: next((k for k in range(at, len(raw)) if raw[k] & 0xC0 != 0x80), len(raw))
    for e in [*found, len(raw)]:
        while e - start > chunkdedup.MAX_BYTES:
            start = whole(start + chunkdedup.MAX_BYTES)
            ends.append(start)
        if e - start >= chunkdedup.MIN_BYTES or (e == len(raw) and e > start):
            if e - start > 0:
                ends.append(e)
                start = e
    return ends


def chunks_spec(rows):
    by_doc = {}
    for d, t in sorted(((d, t) for d, t in rows if d is not None and t), key=lambda x: x[0]):
        raw, at = t.encode(), 0
        for e in cuts_spec(raw):
            by_doc.setdefault(d, []).append((len(raw[:at].decode()), len(raw[:e].decode()), raw[at:e]))
            at = e
    return by_doc


def spans_spec(rows, least=chunkdedup.MIN_SPAN):
    first, out = {}, []
    for d, cs in sorted(chunks_spec(rows).items()):
        now = None
        for a, b, c in cs:
            repeat = c in first
            first.setdefault(c, d)
            if not repeat:
                continue
            if now and now[2] == a:
                now[2], now[3] = b, now[3] + 1
            else:
                now = [d, a, b, 1, first[c]]
                out.append(now)
    return sorted(tuple(x) for x in out if x[2] - x[1] >= least)


def test_spans(spark):
    rng = random.Random(5)
    shared = [prose(rng, 70) for _ in range(3)] + ["字é" * 200]
    rows = [(k, prose(rng, rng.randint(0, 60)) + rng.choice(["", *shared]) + prose(rng, rng.randint(1, 60)) + rng.choice(["", *shared])) for k in range(40)]
    rows += [(50, "z" * 5000), (51, "short")]
    got = tuples(chunkdedup.repeated_spans(documents(spark, rows)).drop("text_key"))
    assert got == sorted(spans_spec(rows), key=repr) and got
    covered = {}
    for d, a, b, _, _ in got:
        covered.setdefault(d, []).append((a, b))
    for s in shared[:3]:  # all but the edges of every later copy goes
        places = [(d, t.index(s)) for d, t in rows if s in t]
        for d, at in places[1:]:
            inside = sum(max(0, min(b, at + len(s)) - max(a, at)) for a, b in covered.get(d, []))
            assert inside >= 0.5 * len(s)


def test_spans_of_rows_that_share_an_id(spark):
    rng = random.Random(15)
    one, own = prose(rng, 200), prose(rng, 80)
    rows = [(1, one + " a"), (2, one + " b"), (2, own), (3, "x"), (3, own + " more")]
    docs = documents(spark, rows)
    spans = chunkdedup.repeated_spans(docs)
    left = tuples(chunkdedup.remove_spans(docs, spans), "doc_id", "text")
    assert {(1, one + " a"), (2, own), (3, "x")} <= set(left)
    assert all(len(t) < 120 for d, t in left if (d, t) not in {(1, one + " a"), (2, own)})
    with pytest.raises(TypeError):
        chunkdedup.repeated_spans(docs.withColumn("doc_id", docs.doc_id.cast("string")))


def test_spans_in_odd_tables(spark):
    rng = random.Random(9)
    rows = odd_rows(rng)
    docs = documents(spark, rows + [(30, rows[0][1] + " tail")])
    spans = chunkdedup.repeated_spans(docs)
    got = {r[0] for r in tuples(spans)}
    assert 30 in got and not got & {None, 1, 2, 3, 6}
    left = {r.doc_id: r.text for r in chunkdedup.remove_spans(docs, spans).collect()}
    assert chunkdedup.remove_spans(docs, spans).columns == docs.columns and len(left[30]) < 200 and left[30].endswith(" tail") and left[1] is None
    assert chunkdedup.repeated_spans(docs.limit(0)).count() == 0


# near duplicates


def near_rows(seed, n=120):
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        base = prose(rng, rng.randint(20, 200)).split(" ")
        rows.append((len(rows), " ".join(base)))
        for _ in range(rng.choice([0, 0, 1, 3])):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 25))):
                copy[rng.randrange(len(copy))] = word(rng)
            rows.append((len(rows), " ".join(copy)))
    return rows


def groups_spec(rows, radius=simhash.RADIUS):
    """Components of all pairs of fingerprints at a distance of radius at most."""
    ids = [d for d, t in rows]
    fp, has = simhash.fingerprint_bytes([t for _, t in rows])
    bits = np.unpackbits(fp, axis=1).astype(np.int16)
    root = list(range(len(ids)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    pairs = 0
    for a in range(len(ids)):
        if has[a]:
            for b in np.flatnonzero((np.abs(bits[a + 1 :] - bits[a]).sum(axis=1) <= radius) & has[a + 1 :]) + a + 1:
                pairs += 1
                x, y = find(a), find(int(b))
                root[max(x, y)] = min(x, y)
    return {ids[a]: ids[find(a)] for a in range(len(ids)) if find(a) != a}, pairs


def test_fingerprints():
    rng = random.Random(3)
    import xxhash

    assert simhash.fingerprint_bytes(["a b", ""], 192)[0].shape == (2, 24)

    for text in [prose(rng, 30), "a", "字文字", "A, a. B!"]:
        ws = {n for w in split_words(text) if (n := normal(w))}
        votes = sum(np.unpackbits(np.frombuffer(xxhash.xxh3_128_digest(w.encode()), np.uint8)).astype(int) * 2 - 1 for w in ws)
        assert (np.unpackbits(simhash.fingerprint_bytes([text])[0][0]) == (votes > 0)).all()


@pytest.mark.parametrize("small", [simhash.SMALL, 1])
def test_near_duplicates(spark, monkeypatch, small):
    monkeypatch.setattr(simhash, "SMALL", small)
    rows = near_rows(4)
    want, pairs = groups_spec(rows)
    assert pairs > 50
    assert dict(tuples(simhash.near_duplicates(documents(spark, rows)).drop("text_key", "kept_text_key"))) == want
    assert dict(tuples(simhash.near_duplicates(documents(spark, rows), radius=14, segment_count=5).drop("text_key", "kept_text_key"))) == groups_spec(rows, 14)[0]
    with pytest.raises(ValueError):
        simhash.near_duplicates(documents(spark, rows), segment_count=6)


def test_forest():
    """Components of all pairs at the radius at most, from rows of keys; small and large buckets."""
    g = np.random.default_rng(5)
    for small in (1, 8, 1000):
        n, radius = 300, 20
        fp = g.integers(0, 1 << 63, (40, 2), dtype=np.uint64)[g.integers(0, 40, n)]
        for k in range(n):
            for bit in g.integers(0, 128, g.integers(0, 9)):
                fp[k, bit // 64] ^= np.uint64(1 << int(bit % 64))
        nodes = np.concatenate([g.permutation(n), g.permutation(n)[:100]])
        keys = np.sort(np.concatenate([np.zeros(n, int), np.ones(100, int)]))
        old, simhash.SMALL = simhash.SMALL, small
        root = simhash._forest(keys, nodes, fp, n, radius)
        simhash.SMALL = old
        want = np.arange(n)
        near = np.array([simhash.distances(fp, f) <= radius for f in fp])
        while True:
            new = np.array([want[near[k]].min() for k in range(n)])
            if (new == want).all():
                break
            want = new
        assert (root == want).all()


def test_large_buckets(monkeypatch):
    """What meets by chance in a large bucket is compared in blocks and not row by row; whatever the blocks, no pair is lost."""
    g = np.random.default_rng(11)
    chance = g.integers(0, 1 << 63, (3000, 2), dtype=np.uint64)
    chance[2500] = chance[7] ^ np.uint64(5)
    chance[2999] = chance[2500] ^ np.array([0xFFFF00, 0], np.uint64)
    passes, count = [], np.bitwise_count
    with monkeypatch.context() as m:
        m.setattr(np, "bitwise_count", lambda *a, **k: passes.append(1) or count(*a, **k))
        root = simhash._forest(np.zeros(3000, int), np.arange(3000), chance, 3000, 20)
    assert np.flatnonzero(root != np.arange(3000)).tolist() == [2500, 2999] and set(root[[2500, 2999]]) == {7}
    assert len(passes) < 1000
    # a group of copies that makes up most of the bucket, some reached only by way of others, two small groups and chance
    one = chance[0] ^ (np.uint64(1) << g.integers(0, 64, (160, 2)).astype(np.uint64))
    far = one[:40] ^ np.array([0x3FFFF, 0], np.uint64)
    two, three = (chance[k] ^ (np.uint64(1) << g.integers(0, 64, (9, 2)).astype(np.uint64)) for k in (1, 2))
    fp = np.concatenate([one, far, two, three, chance[100:140]])[g.permutation(258)]
    near = np.array([simhash.distances(fp, f) <= 20 for f in fp])
    want = np.arange(258)
    while (new := np.array([want[row].min() for row in near])).tobytes() != want.tobytes():
        want = new
    monkeypatch.setattr(simhash, "SMALL", 4)
    for pairs in (1, 50, 1000, 1 << 15):
        monkeypatch.setattr(simhash, "PAIRS", pairs)
        for order in (np.arange(258), g.permutation(258), g.permutation(258)):
            assert (simhash._forest(np.zeros(258, int), order, fp, 258, 20) == want).all()
    # 256 bits, all of them different
    assert simhash._forest(np.zeros(6, int), np.arange(6), np.array([[0] * 4, [2**64 - 1] * 4] * 3, np.uint64), 6, 20).tolist() == [0, 1] * 3
    monkeypatch.setattr(simhash, "SMALL", 256)
    assert simhash._forest(np.zeros(6, int), np.arange(6), np.array([[0] * 4, [2**64 - 1] * 4] * 3, np.uint64), 6, 20).tolist() == [0, 1] * 3


def test_keys_are_made_in_many_tasks(spark, monkeypatch):
    """Small as the table of classes is, its keys are not: as many tasks make them as the session's shuffles ask for, over four."""
    plans = []
    monkeypatch.setattr(simhash, "components", lambda edges: plans.append(edges._jdf.queryExecution().optimizedPlan().toString()) or components(edges))
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 12)
    try:
        rows = near_rows(9, 20)
        assert dict(tuples(simhash.near_duplicates(documents(spark, rows)).drop("text_key", "kept_text_key"))) == groups_spec(rows)[0]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert any("RepartitionByExpression [node" in line and line.endswith(", 3") for line in plans[0].splitlines())


def test_whole_buckets():
    import pyarrow as pa

    g = np.random.default_rng(6)
    for least in (1, 7, 50, 10_000):
        keys = np.sort(g.integers(0, 60, 900))
        keys[200:500] = keys[200]
        at = np.sort(g.integers(0, 900, 12))
        batches = [pa.RecordBatch.from_arrays([pa.array(x), pa.array(x * 2)], ["a", "b"]) for x in np.split(keys, at)]
        parts = [[c.to_numpy() for c in p] for p in whole_buckets(batches, least)]
        assert (np.concatenate([p[0] for p in parts]) == keys).all() and all((p[1] == 2 * p[0]).all() for p in parts)
        assert all(a[0][-1] < b[0][0] for a, b in zip(parts, parts[1:]))


def test_near_duplicates_in_odd_tables(spark):
    rng = random.Random(6)
    rows = odd_rows(rng)
    docs = documents(spark, rows + [(40, rows[0][1]), (41, rows[0][1].upper()), (42, "x" * 200_000), (7, rows[0][1] + " .")])
    gone = simhash.near_duplicates(docs)
    assert tuples(gone.drop("text_key", "kept_text_key")) == [(40, 6), (41, 6), (42, 9), (7, 6)]
    left = simhash.keep_one_each(docs, gone)
    ids = sorted((r.doc_id for r in left.collect()), key=str)
    # of the three texts of 7 the two that resemble nothing stay
    assert left.columns == docs.columns and ids.count(6) == 1 and ids.count(7) == 2 and ids.count(None) == 2 and not {40, 41, 42} & set(ids)
    assert simhash.near_duplicates(docs.limit(0)).count() == 0 and simhash.keep_one_each(docs.limit(0), gone.limit(0)).count() == 0
    with pytest.raises(TypeError):
        simhash.near_duplicates(docs.withColumn("doc_id", docs.doc_id.cast("string")))


def test_components(spark):
    rng = random.Random(7)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(k, k + 1) for k in range(1000, 1100)] + [(5, 5)]
    root = {}

    def find(a):
        while root.setdefault(a, a) != a:
            a = root[a]
        return a

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    want = {a: find(a) for a in list(root) if find(a) != a}
    assert dict(tuples(components(spark.createDataFrame(edges, "u long, v long")))) == want
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0
