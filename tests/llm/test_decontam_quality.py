import math
import random
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from inkstrata.llm import decontam, quality
from tests.llm.fixtures import documents, odd_rows, prose, tuples, word

# benchmark decontamination


def bm25_spec(items):
    """Weight of each term in each item, divided by the item's sum."""
    bags = [Counter(decontam.words(t)) for _, t in items]
    df = Counter(w for b in bags for w in b)
    n, average = len(bags), sum(sum(b.values()) for b in bags) / len(bags)
    out = []
    for b in bags:
        size = sum(b.values())
        raw = {t: math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * size / average)) for t, f in b.items()}
        out.append({t: w / sum(raw.values()) for t, w in raw.items()})
    return out


def matches_spec(items, rows, longest):
    """Every passage against every item."""
    weights = bm25_spec(items)
    out = {}
    for doc, text in rows:
        raw = decontam.split_words(text)
        for start in range(0, max(1, len(raw)), longest):
            tokens = [n for w in raw[start : start + 2 * longest] if (n := decontam.normal(w))]
            for (item, body), w in zip(items, weights):
                score = sum(w.get(t, 0) for t in set(tokens))
                if score < decontam.MIN_SCORE:
                    continue
                there = {n: {tuple(tokens[i : i + n]) for i in range(len(tokens) - n + 1)} for n in range(1, 6)}
                shares = []
                for part in decontam.question_and_answer(body):
                    g = decontam.grams(part)
                    shares.append(len(g & there[min(5, len(part))]) / len(g))
                if min(shares) >= decontam.MIN_OVERLAP and score > out.get((doc, item), (0,))[0] + 1e-12:
                    out[doc, item] = (score, *shares)
    return {k: tuple(round(x, 4) for x in v) for k, v in out.items()}


def contaminated_rows(rng):
    items = [(k, f"{prose(rng, rng.randint(8, 40), 99)} {' '.join(word(rng) for _ in range(rng.randint(1, 8)))}.") for k in range(40)]
    rows = []
    for k in range(80):
        text = prose(rng, rng.randint(1, 400))
        if k % 3 == 0:
            body = rng.choice(items)[1].split()
            for _ in range(rng.choice([0, 0, 1, 3])):
                body[rng.randrange(len(body))] = word(rng)
            text += "\n" + " ".join(body).upper() + "\n" + prose(rng, rng.randint(1, 300))
        if k % 7 == 0:  # the question without the answer
            text += " ".join(rng.choice(items)[1].split(".")[0].split()[:-3])
        rows.append((k, text))
    return items, rows


def test_contaminated(spark):
    rng = random.Random(11)
    items, rows = contaminated_rows(rng)
    longest = max(decontam.LEAST_PASSAGE, max(len(decontam.split_words(t)) for _, t in items))
    bench = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, doc_id string")
    want = matches_spec(items, rows, longest)
    assert len(want) > 15
    for shard in (decontam.SHARD_BYTES, 900):  # one index, several indexes
        got = {(r.doc_id, r.item_id): (r.score, r.question_overlap, r.answer_overlap) for r in decontam.contaminated(documents(spark, rows), bench, shard_bytes=shard).collect()}
        assert set(got) == set(want)
        assert all(np.allclose(got[k], want[k], atol=2e-4) for k in want)


@pytest.mark.parametrize("least", [0.02, 0.05, 0.15, 0.5])
def test_search_at_any_score(least):
    """Every passage against every item, with terms that most items share."""
    rng = random.Random(14)
    pool = [word(rng) for _ in range(12)]
    items = [(k, " ".join([*rng.sample(pool, 8), *(word(rng) for _ in range(rng.randint(0, 6)))])) for k in range(60)]
    df = Counter(w for _, t in items for w in set(t.split()))
    index = decontam.build_index(items, df, len(items), sum(len(t.split()) for _, t in items) / len(items), 64)
    texts = [" ".join(rng.choice(rng.choice(items)[1].split()) for _ in range(rng.randint(1, 150))) for _ in range(40)] + [pool[0], None]
    weights = bm25_spec(items)
    want = {}
    for d, t in enumerate(texts):
        raw = (t or "").split()
        for start in range(0, max(1, len(raw)), 64):
            there = set(raw[start : start + 128])
            for i, w in enumerate(weights):
                if (score := sum(w.get(t, 0) for t in there)) >= least - 1e-9:
                    want[d, i] = max(want.get((d, i), 0), score)
    got = {(d, i): s for d, i, s, *_ in decontam.search(index, texts, least, 0.0)}
    assert want and got == pytest.approx(want)


def test_items_of_all_lengths(spark):
    rng = random.Random(16)
    items = [(k, f"{prose(rng, n, 999)} {word(rng)} {word(rng)}.") for k, n in enumerate([3, 60, 100, 200, 1000, 3000])]
    rows = [(k, f"{prose(rng, 700)}\n{t}\n{prose(rng, 900)}") for k, t in items] + [(99, prose(rng, 9000))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert {x.length for shard in decontam.indexes(bench) for x in shard} == {64, 128, 256, 1024, 4096}
    found = decontam.contaminated(documents(spark, rows), bench).collect()
    assert sorted((r.doc_id, r.item_id) for r in found) == [(k, k) for k in range(6)] and all(r.score >= 0.99 for r in found)


@pytest.mark.parametrize("least", [0.05, 0.3, 0.7])
def test_block_max_wand(least):
    rng = random.Random(12)
    pool = [word(rng) for _ in range(60)]
    items = [(k, " ".join(rng.choice(pool) for _ in range(rng.randint(3, 15)))) for k in range(150)]
    df = Counter(w for _, t in items for w in set(t.split()))
    index = decontam.build_index(items, df, len(items), sum(len(t.split()) for _, t in items) / len(items), 64)
    weights = bm25_spec(items)
    for _ in range(40):
        terms = sorted(index.term[w] for w in {rng.choice(pool) for _ in range(rng.randint(1, 30))} if w in index.term)
        names = {t for t, k in index.term.items() if k in terms}
        want = {i: sum(w.get(t, 0) for t in names) for i, w in enumerate(weights)}
        assert dict(decontam.block_max_wand(index, terms, least)) == pytest.approx({i: s for i, s in want.items() if s >= least - 1e-9})


def test_contaminated_in_odd_tables(spark):
    rng = random.Random(13)
    item = prose(rng, 20, 99) + " the answer is seven."
    rows = odd_rows(rng)
    rows[6] = (5, rows[6][1] + " " + item + " " + prose(rng, 2000))  # deep in a very long text
    docs = documents(spark, [*rows, (60, item), (60, "x"), (60, None), (61, item), (61, item), (None, item)])
    bench = spark.createDataFrame([(1, item), (2, item), (None, item), (3, None), (4, ""), (5, "...")], "item_id long, text string")
    found = decontam.contaminated(docs, bench)
    assert tuples(found, "doc_id", "item_id") == [(d, i) for d in (5, 60, 61) for i in (1, 2)]
    left = decontam.drop_contaminated(docs, found)
    ids = [r.doc_id for r in left.collect()]
    assert [r.text for r in left.where("doc_id = 60").collect()] == ["x", None]  # rows of that id that hold no item
    assert left.columns == docs.columns and not {5, 61} & set(ids) and ids.count(None) == 3 and ids.count(6) == 2
    assert decontam.contaminated(docs.limit(0), bench).count() == 0
    assert decontam.contaminated(docs, bench.limit(0)).count() == 0 and decontam.contaminated(docs, bench.where("item_id = 5")).count() == 0


# quality classifier

STEMS = ["vorkap", "milzor"]


def labelled(rng, n, start=0):
    """Toxic documents hold a stem in forms of its own, low ones many signs."""
    rows, labels = [], []
    for k in range(start, start + n):
        words = [word(rng) for _ in range(rng.randint(30, 300))]
        kind = rng.choice(["clean", "clean", "low", "toxic"])
        if kind == "toxic":
            for _ in range(3):
                words[rng.randrange(len(words))] = rng.choice(STEMS) + word(rng)[:4]
        if kind == "low":
            words = [w + rng.choice(["%%%", "***", "###"]) for w in words]
        rows.append((k, " ".join(words)))
        labels.append((k, int(kind != "low"), int(kind == "toxic")))
    return rows, labels


LABELS = "doc_id long, quality int, toxic int, text string"


def test_classifier_on_held_out_documents(spark):
    rng = random.Random(21)
    rows, labels = labelled(rng, 500)
    fresh, truth = labelled(rng, 200, 1000)
    docs = documents(spark, rows + fresh)
    known = spark.createDataFrame([(*x, "t") for x in labels], LABELS)
    got = {r.doc_id: r for r in quality.classify(docs, known).collect()}
    right = [got[d].keep == (q == 1 and t == 0) for d, q, t in truth]
    toxic = [got[d].toxic_score >= 0.5 for d, q, t in truth if t]
    assert len(got) == 700 and np.mean(right) >= 0.95 and np.mean(toxic) >= 0.9
    kept = {r.doc_id for r in quality.filter_documents(docs, known).collect()}
    assert kept == {d for d, r in got.items() if r.keep} and quality.held_out(docs, known) >= 0.9


def scores_spec(model, text):
    """Passage by passage and word by word, in plain Python."""
    w = {k: x.astype(float).tolist() for k, x in model.weights.items()}
    raw = quality.split_words(text)
    times = lambda v, m: [sum(a * row[j] for a, row in zip(v, m)) for j in range(len(m[0]))]
    sigmoid = lambda x: 1 / (1 + math.exp(-x))
    encoded = []
    for start in range(0, len(raw), quality.PASSAGE):
        words = raw[start : start + quality.PASSAGE]
        total = [0.0] * quality.WIDTH
        shapes = [0.0] * quality.SHAPES
        for k, word_ in enumerate(words):
            for f in quality.features(quality.normal(word_)):
                if f in model.vocabulary:
                    total = [a + b for a, b in zip(total, w["words"][model.vocabulary[f]])]
            bits = quality.shape(word_)
            for b in range(quality.SHAPES - 1):
                shapes[b] += (bits >> b) & 1
            if start + k and quality.normal(word_) == quality.normal(raw[start + k - 1]):
                shapes[-1] += 1
        n = len(words)
        pre = [a / math.sqrt(n) + b + c for a, b, c in zip(total, times([x / n for x in shapes], w["shapes"]), w["bias"])]
        encoded.append([math.tanh(x) for x in pre])
    gates = [sum(c * math.tanh(a) * sigmoid(b) for a, b, c in zip(times(h, w["V"]), times(h, w["U"]), w["w"])) for h in encoded]
    weights = [math.exp(g - max(gates)) for g in gates]
    z = [sum(a * h[j] for a, h in zip(weights, encoded)) / sum(weights) for j in range(quality.WIDTH)]
    return tuple(sigmoid(x + c) for x, c in zip(times(z, w["C"]), w["c"]))


def test_scores_by_brute_force(spark):
    rng = random.Random(26)
    rows, labels = labelled(rng, 200)
    model = quality.fit([t for _, t in rows], [q == 0 for _, q, _ in labels], [t == 1 for _, _, t in labels])
    assert model.heads == (True, True) and len(model.vocabulary) > 5
    texts = [t for _, t in rows[:25]] + ["a", "a a A a! b", "WORD " * 70, "字" * 130, "x" * 30, "%% !!", STEMS[0] + "x " + prose(rng, 300)]
    for text, got in zip(texts, quality.score(model, texts)):
        assert got == pytest.approx(scores_spec(model, text), abs=2e-5), text[:30]


def test_sample(spark):
    """Labels without a text take no place; of texts and labels that share an id the least counts, whatever their order."""
    rows = [(k, f"text {k}") for k in range(40)] + [(3, "a text"), (3, None), (4, "z" * 99), (5, "z" * 99), (5, "y" * 99)]
    labels = [(k, k % 2, 0, "t") for k in range(0, 400)] + [(2, 1, 0, "t"), (None, 1, 1, "t")]
    found = []
    for seed in (1, 2):
        random.Random(seed).shuffle(rows), random.Random(seed).shuffle(labels)
        found.append(quality.labelled_sample(documents(spark, rows), spark.createDataFrame(labels, LABELS), 10, 50))
    assert found[0] == found[1] and len(found[0]) == 20 and len({r.doc_id for r in found[0]}) == 20
    every = {r.doc_id: r for r in quality.labelled_sample(documents(spark, rows), spark.createDataFrame(labels, LABELS), 100, 50)}
    assert set(every) == set(range(40)) and every[3].text == "a text" and every[2].quality == 0 and every[5].text == "text 5"


def test_one_passage_decides(spark):
    rng = random.Random(22)
    rows, labels = labelled(rng, 500)
    model = quality.fit([t for _, t in rows], [q == 0 for _, q, _ in labels], [t == 1 for _, _, t in labels])
    calm = [word(rng) for _ in range(5000)]
    loud = list(calm)
    for k in (4000, 4002, 4005, 4007):
        loud[k] = STEMS[0] + "esk"
    (_, low), (_, high) = quality.score(model, [" ".join(calm), " ".join(loud)])
    assert low < 0.5 <= high


def test_features_of_words():
    rng = random.Random(25)
    words = ["", "a", "<", "a><b", "ab" * 40, "字", "<x>", "😀stone"] + [word(rng) for _ in range(300)]
    every = sorted(set().union(*(quality.features(quality.normal(w)) for w in words)))
    vocabulary = {f: k for k, f in enumerate(rng.sample(every, len(every) // 2), 1)}
    found = quality.Known(vocabulary).learn(words)
    for w in words:
        want = sorted({vocabulary[f] for f in quality.features(quality.normal(w)) if f in vocabulary}) or [0]
        assert found[w][0] == want, w
    assert quality.Known({}).learn(["a"])["a"][0] == [0]


def test_gradients():
    rng = random.Random(23)
    rows, labels = labelled(rng, 60)
    vocabulary = {f: k for k, f in enumerate(sorted(set().union(*(quality.features(quality.normal(w)) for _, t in rows[:5] for w in t.split()))), 1)}
    bags = quality.encode([t for _, t in rows[:6]], quality.Known(vocabulary))
    g = np.random.default_rng(1)
    shapes = {"shapes": (6, 16), "bias": (16,), "V": (16, 8), "U": (16, 8), "w": (8,), "C": (16, 2), "c": (2,), "words": (len(vocabulary) + 1, 16)}
    w = {k: g.normal(0, 0.3, s) for k, s in shapes.items()}
    y, heads = np.array([[q == 0, t == 1] for _, q, t in labels[:6]], float), np.array([True, True])

    def loss():
        p = np.clip(quality.Model(vocabulary, w, (True, True)).probabilities(bags), 1e-12, 1 - 1e-12)
        return -(y * np.log(p) + (1 - y) * np.log(1 - p)).sum() / len(y)

    grads = quality._gradients(w, bags, y, heads)
    found, rowwise = grads.pop("words")
    full = np.zeros_like(w["words"])
    full[found] = rowwise
    for name, d in {**grads, "words": full}.items():
        at = np.unravel_index(int(np.abs(d).argmax()), d.shape)
        old = w[name][at]
        w[name][at] = old + 1e-4
        up = loss()
        w[name][at] = old - 1e-4
        down = loss()
        w[name][at] = old
        assert d[at] == pytest.approx((up - down) / 2e-4, rel=0.03, abs=1e-5), name


def test_classifier_in_odd_tables(spark):
    rng = random.Random(24)
    rows, labels = labelled(rng, 120)
    docs = documents(spark, rows + [(None if d is None else d + 5000, t) for d, t, *_ in odd_rows(rng)])
    known = spark.createDataFrame([(*x, "t") for x in labels] + [(1, 0, 0, "t"), (None, 1, 1, "t"), (2, None, 1, "t"), (9999, 1, 0, "t")], LABELS)
    got = quality.classify(docs, known)
    assert got.count() == docs.count()
    none = {r.doc_id for r in got.where("n_passages = 0").collect()}
    assert none == {None, 5001, 5002, 5003} and not any(r.keep for r in got.where("n_passages = 0").collect())
    assert quality.filter_documents(docs, known).columns == docs.columns
    free = quality.classify(docs, known.limit(0))  # without labels nothing with words is rejected
    assert free.where("n_passages > 0 and not keep").count() == 0
    assert quality.classify(docs.limit(0), known).count() == 0 and quality.filter_documents(docs.limit(0), known).count() == 0


# pipeline


def tables(spark, folder, rows, labels, items):
    documents(spark, rows).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(*x, "t") for x in labels], LABELS).write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def test_pipeline(spark, tmp_path):
    from tests.llm.test_dedup import groups_spec, runs_spec

    rng = random.Random(31)
    rows, labels = labelled(rng, 240)
    shared = prose(rng, 60)
    item = prose(rng, 30, 99) + " forty two."
    clean = [d for d, q, t in labels if q and not t]
    text = dict(rows)
    text[clean[1]] += "\n" + shared
    text[clean[2]] += "\n" + shared
    text[clean[4]] = text[clean[3]].replace(" ", "  ", 1) + " more"
    text[clean[5]] += "\n" + item
    text[clean[6]] = prose(rng, 200)  # and a near copy that shares most of its lines
    text[clean[7]] = text[clean[6]].replace("\n", "\nnew ", 1)
    rows = sorted(text.items())
    folder = tables(spark, tmp_path / "in", rows, labels, [(1, item)])

    # By brute force, from the classifier's verdicts on.
    kept = {r.doc_id for r in quality.classify(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")).where("keep").collect()}
    left = {d: t for d, t in rows if d in kept}
    for d, a, b, *_ in runs_spec(list(left.items()), groups=groups_spec(list(left.items()))[0]):
        left[d] = "\n".join(x for k, x in enumerate(left[d].split("\n")) if not a <= k <= b)
    gone = groups_spec(list(left.items()))[0]
    left = {d: t for d, t in left.items() if d not in gone}
    hits = {d for d, _ in matches_spec([(1, item)], list(left.items()), decontam.LEAST_PASSAGE)}
    left = {d: t for d, t in left.items() if d not in hits}
    out = corpus_pipeline.run(spark, folder)
    tokens = Counter()
    for r in out.collect():
        tokens[r.doc_id] += r.n_tokens
    assert tokens == Counter({d: len(t.split()) for d, t in left.items()})
    assert {clean[0], clean[1], clean[2], clean[3]} <= set(tokens) and not {clean[4], clean[5], clean[7]} & set(tokens)
    assert tokens[clean[6]] == 200
    assert out.columns == ["doc_id", "piece", "start", "n_tokens", "bin_id", "slot"]


def test_pipeline_in_odd_tables(spark, tmp_path):
    rng = random.Random(32)
    rows, labels = labelled(rng, 80)
    folder = tables(spark, tmp_path / "odd", rows + [(d and d + 5000, t) for d, t, *_ in odd_rows(rng)], labels, [(1, None)])
    out = corpus_pipeline.run(spark, folder)
    assert out.count() > 0
    stages = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name in ("quality", "lines", "near_duplicates", "benchmark"):
        assert stages[name](spark, docs, folder).columns == docs.columns
    empty = tables(spark, tmp_path / "none", [], [], [])
    assert corpus_pipeline.run(spark, empty).count() == 0


def test_stages():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "lines", "near_duplicates", "benchmark", "packing"]
