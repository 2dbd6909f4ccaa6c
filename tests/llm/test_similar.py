"""Near copies that fingerprints tell apart: links by marks against all pairs, and what the pipeline's stage keeps."""

import random

import numpy as np
from pyspark.sql import functions as F

from ratebook.llm import common, simhash


def copies(rng, words, base, n, edits):
    """n texts of base, each with `edits` words of its own."""
    out = []
    for _ in range(n):
        text = list(base)
        for _ in range(edits):
            text[rng.randrange(len(text))] = rng.choice(words) + str(rng.randrange(10**6))
        out.append(" ".join(text))
    return out


def test_links_and_what_stays(spark):
    rng = random.Random(1)
    words = [f"w{i}" for i in range(3000)]
    common = rng.choices(words, k=60)  # a passage that many clean documents share
    groups = [copies(rng, words, rng.choices(words, k=rng.choice([60, 150, 400])), rng.choice([2, 3, 5]), 1) for _ in range(40)]
    groups.append(copies(rng, words, rng.choices(words, k=300), 120, 3))
    clean = [" ".join(rng.choices(words, k=80) + common + rng.choices(words, k=80)) for _ in range(60)] + ["one two", "a b c d e f", ""]
    texts = [t for g in groups for t in g] + clean
    rng.shuffle(texts)
    rows = [(i if i % 50 else None, t, "x") for i, t in enumerate(texts)] + [(9001, None, "x"), (9002, texts[0], "x"), (9002, texts[1], "x"), (9002, texts[1], "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, mark string").withColumn("fp", F.lit(0))

    sets = {t: np.unique(simhash._hashes(t, 5, 42)) for t in texts if t}
    fps = {t: simhash._majority(simhash._hashes(t, 3, 42)) for t in texts}

    def near(a, b):
        both = np.intersect1d(sets[a], sets[b]).size
        return both >= 0.8 * (len(sets[a]) + len(sets[b]) - both)

    own = sorted(sets)
    want = {tuple(sorted((fps[a], fps[b]))) for i, a in enumerate(own) for b in own[:i] if fps[a] != fps[b] and near(a, b)}
    got = {tuple(r) for r in simhash.similar_links(docs).collect()}
    assert got <= {p for p in want if bin((p[0] ^ p[1]) & (1 << 64) - 1).count("1") > 3} and len(want) > 5000  # the links of the large group are its star, not its pairs
    small = {tuple(sorted((fps[a], fps[b]))) for g in groups[:-1] for i, a in enumerate(g) for b in g[:i] if fps[a] != fps[b] and near(a, b)}
    assert len(small) > 50

    kept = [r.text for r in simhash.keep_one_of_each(docs).collect()]
    assert {t or "" for t in kept} >= set(clean)
    left = [sum(t in g for t in kept) for g in groups]
    linked = [g for g in groups if all(near(g[0], t) for t in g)]
    one = sum(n == 1 for g, n in zip(groups, left, strict=True) if g in linked)
    assert all(left) and one >= 0.95 * len(linked) and left[-1] <= 2, (left, one, len(linked), len(want), len(small))


def test_texts_without_words(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, " \n "), (4, "one")], "doc_id long, text string")
    assert simhash.similar_links(docs).collect() == [] and simhash.similar_links(docs.limit(0)).collect() == []
    assert sorted(r.doc_id for r in simhash.keep_one_of_each(docs).collect()) == [1, 4]


def test_what_follows_the_input_is_not_broadcast(spark, monkeypatch):
    """Joins of the stage are by shuffles; only keys of a bounded number of rows may be broadcast to the texts."""
    plans = []

    def noted(df, name, keep=simhash.stored):
        plans.append((name, df._jdf.queryExecution().executedPlan().toString()))
        return keep(df, name)

    rng = random.Random(4)
    words = [f"w{i}" for i in range(500)]
    texts = [t for _ in range(6) for t in copies(rng, words, rng.choices(words, k=200), 3, 1)]
    docs = spark.createDataFrame(list(enumerate(texts * 2)), "doc_id long, text string")
    monkeypatch.setattr(simhash, "stored", noted)
    monkeypatch.setattr(simhash, "bounded", lambda df: common.bounded(df, -1))
    kept = simhash.keep_one_of_each(docs)
    plans.append(("kept", kept._jdf.queryExecution().executedPlan().toString()))
    assert [name for name, p in plans if "Broadcast" in p] == [] and kept.count() == 6


def test_no_link_is_lost_where_marks_miss(spark, monkeypatch):
    """Without any link by marks or fingerprints the shingles' heads find every pair of different groups; with groups joined they make none within these."""
    rng = random.Random(7)
    words = [f"w{i}" for i in range(900)]
    passage = rng.choices(words, k=50)
    texts = [t for _ in range(25) for t in copies(rng, words, rng.choices(words, k=rng.choice([12, 60, 200])), 4, rng.choice([1, 2, 3]))]
    base = rng.choices(words, k=90)
    texts += [" ".join(base[: 90 - i]) for i in range(0, 40, 3)]  # sizes at and about 0.8 of one another
    texts += [" ".join(rng.choices(words, k=60) + passage) for _ in range(40)] + ["one two", "one two three", "", None]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(900, texts[0])], "doc_id long, text string")
    copy_of = {r.text: r.copy for r in docs.select("text", F.xxhash64("text").alias("copy")).collect() if r.text}
    sets = {c: np.unique(simhash._hashes(t, 5, 42)) for t, c in copy_of.items()}

    def near(a, b):
        both = np.intersect1d(sets[a], sets[b]).size
        return both >= 0.8 * (len(sets[a]) + len(sets[b]) - both)

    own = sorted(sets)
    want = {(a, b) for i, b in enumerate(own) for a in own[:i] if near(a, b)}
    groups = spark.createDataFrame([(c, c) for c in own], "copy long, root long")
    assert {tuple(r) for r in simhash.remaining_links(docs, groups).collect()} == want and len(want) > 90
    grouped = {c: min([a for a, b in want if b == c], default=c) for c in own}
    got = {tuple(r) for r in simhash.remaining_links(docs, spark.createDataFrame(list(grouped.items()), "copy long, root long")).collect()}
    assert got == {tuple(sorted((grouped[a], grouped[b]))) for a, b in want if grouped[a] != grouped[b]}

    none = spark.createDataFrame([], "a long, b long")
    monkeypatch.setattr(simhash, "similar_links", lambda *_: none)
    root = {r.copy: r.root for r in simhash.near_duplicate_components(docs, similar=True).collect()}
    assert all(root[a] == root[b] for a, b in want)


def test_whole_sets_travel_for_likely_pairs_only(spark, monkeypatch):
    rng = random.Random(5)
    blocks = [[f"b{i}w{rng.randrange(10**6)}" for _ in range(150)] for i in range(30)]
    ring = [" ".join(blocks[i] + blocks[(i + 1) % 30]) for i in range(30)]  # neighbours share a third of their shingles, none of which is rarer than others
    like = [f"c{i}" for i in range(300)]
    texts = [*ring, " ".join(like), " ".join([*like[:-1], "other"])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("copy", F.xxhash64("text"))
    rows, stored = {}, simhash.stored

    def counted(df, name, **options):
        out = stored(df, name, **options)
        rows[name] = out.count()
        return out

    monkeypatch.setattr(simhash, "stored", counted)
    links = simhash.remaining_links(docs, docs.select("copy", F.col("doc_id").alias("root"))).collect()
    assert [tuple(r) for r in links] == [(30, 31)] and rows["shared-pairs"] > 1 and rows["shingles"] == 2


def test_parity_rules_out_no_similar_pair(spark):
    rng = np.random.default_rng(3)
    rows, sketches = [], []
    for i in range(400):
        n = int(rng.integers(1, 700))
        x = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        y = np.concatenate((x[: rng.integers(0, x.size + 1)], rng.integers(0, 1 << 63, int(rng.integers(0, 1 + n // 3)), dtype=np.uint64)))
        y = np.unique(y) if y.size else x
        rows.append((2 * i, 2 * i + 1, float(np.intersect1d(x, y).size / np.union1d(x, y).size)))
        sketches += [(2 * i + j, int(h.size), simhash._parity(h).tolist()) for j, h in enumerate((x, y))]
    pairs = spark.createDataFrame(rows, "x long, y long, shared double")
    left = {r.x for r in simhash._may_share(pairs, spark.createDataFrame(sketches, "copy long, n int, bits array<long>"), 0.8).collect()}
    assert {x for x, _, shared in rows if shared >= 0.8} <= left and not {x for x, _, shared in rows if shared < 0.3 and sketches[x][1] > 100} & left
    assert len(left) < 400 and sum(shared >= 0.8 for *_, shared in rows) > 20
