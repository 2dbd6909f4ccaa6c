"""Line dedup, SimHash and components against brute force."""

import random

import numpy as np

import xxhash
from pyspark.sql import functions as F

from ratebook.llm import components, line_dedup, simhash

DOCS = "doc_id long, text string, lang string"


def fingerprint(text):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def least_reachable(ids, prints, bits=3):
    parent = list(range(len(ids)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= bits:
                parent[root(i)] = root(j)
    return {i: min(ids[k] for k in range(len(ids)) if root(k) == root(n)) for n, i in enumerate(ids)}


def some_docs():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(60)]
    texts = [" ".join(rng.choices(words, k=rng.choice([1, 2, 3, 8, 40, 200]))) for _ in range(60)]
    texts += [t.replace("w1 ", "w2 ", 1) for t in texts[:30]] + texts[:10] + ["", None, "  \n ", "Ä b", "ä b", "A B", "a b"]
    long = rng.choices(words, k=4000)
    texts += [" ".join(long), " ".join([*long[:2000], "x", *long[2000:]])]
    return [(i * 3, t, "en") for i, t in enumerate(texts)]


def test_simhash_matches_brute_force(spark):
    rows = some_docs()
    got = simhash.near_duplicate_components(spark.createDataFrame(rows, DOCS)).collect()
    prints = [fingerprint(t) for _, t, _ in rows]
    wanted = least_reachable([i for i, _, _ in rows], prints)
    assert {r.doc_id: r.fp & (1 << 64) - 1 for r in got} == {i: p for (i, _, _), p in zip(rows, prints, strict=True)}
    assert {r.doc_id: r.component_id for r in got} == wanted
    assert len(set(wanted.values())) < len(rows)


def test_near_links_lose_none(spark):
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(60)]
    prints = sorted({p for b in base for p in [b, *[b ^ sum(1 << x for x in rng.sample(range(64), k)) for k in (1, 2, 3, 4, 5)]]} | {0, (1 << 64) - 1, (1 << 63)})
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    for bits in (0, 1, 3):
        got = {(r.a, r.b) for r in simhash.near_links(spark.createDataFrame([(s,) for s in signed], "fp long"), bits).collect()}
        wanted = {tuple(sorted((a, b))) for i, a in enumerate(signed) for b in signed[:i] if bin((a ^ b) & (1 << 64) - 1).count("1") <= bits}
        assert got == wanted


def test_simhash_edges(spark):
    assert simhash.near_duplicate_components(spark.createDataFrame([], DOCS)).count() == 0
    rows = [(5, "a b c", "x"), (5, "a b c", "x"), (2, "a b c", "x"), (None, "a b c", "x"), (7, None, None)]
    docs = spark.createDataFrame(rows, DOCS).withColumn("fp", F.lit(1)).withColumn("component_id", F.lit(2)).withColumn("id", F.lit(0))
    kept = simhash.keep_one_of_each(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [2, 7]


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7)] + [(200, i) for i in range(201, 230)]
    got = {r.node: r.root for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100} | {i: 200 for i in range(200, 230)}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def brute_lines(rows):
    places = sorted((i, n, line.strip(line_dedup.BLANKS)) for i, t in rows for n, line in enumerate((t or "").split("\n")) if line.strip(line_dedup.BLANKS))
    first = {}
    for i, n, line in places:
        first.setdefault(line, (i, n))
    kept = {p for line, p in first.items() if not any(q < p and distance(line, o) <= 1 for o, q in first.items() if o != line)}
    return {i: "\n".join(x for n, x in enumerate(t.split("\n")) if (i, n) in kept or not x.strip(line_dedup.BLANKS)) for i, t in rows if t is not None}


def test_lines_match_brute_force(spark):
    rng = random.Random(11)
    base = ["".join(rng.choices("ab ", k=rng.choice([1, 2, 3, 5, 19, 20, 21, 40]))) for _ in range(25)] + ["aaaaaaaaaaaaaaaaaaaaaaaa", "ünïcode line of some length 日本"]
    pool = list(base)
    for line in base * 2:
        at = rng.randrange(len(line))
        pool += [line[:at] + line[at + 1 :], line[:at] + "b" + line[at:], line[:at] + "c" + line[at + 1 :], " " + line + "\t", line[:at] + "zz" + line[at:]]
    rows = [(i, "\n".join(rng.choices(pool, k=rng.choice([1, 3, 12])) + [""] * (i % 2))) for i in range(60)] + [(200, None), (201, ""), (202, "\n \n")]
    got = {r.doc_id: r.text for r in line_dedup.dedupe_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {k: v for k, v in got.items() if v is not None} == brute_lines(rows) and got[200] is None


def test_line_stage_edges(spark):
    rows = [(2, "same line of text here", "en"), (1, "same line of text here", "en"), (3, "other line of text, long\nsame line of text here", None), (4, None, "fr"), (5, "", "fr"), (6, "x\r\nyes", "fr")]
    docs = spark.createDataFrame(rows, DOCS).withColumn("n_lines", F.lit("mine")).withColumn("n_chars", F.lit(0).cast("long"))
    plain = docs.drop("n_lines")
    got = {r.doc_id: (r.text, r.n_chars) for r in line_dedup.drop_repeated_lines(plain).collect()}
    assert got == {1: ("same line of text here", 22), 3: ("other line of text, long", 24), 4: (None, None), 5: ("", 0), 6: ("x\r\nyes", 6)}
    assert line_dedup.drop_repeated_lines(spark.createDataFrame([], DOCS)).count() == 0


def test_variants_of_long_lines_come_in_slices(spark, monkeypatch):
    line = "".join(random.Random(3).choices("abcdef é日", k=500))
    whole = [x for _, part in line_dedup._variant_hashes(line) for x in part.tolist()]
    monkeypatch.setattr(line_dedup, "VARIANT_CHARS", 64)
    with np.errstate(over="ignore"):
        sliced = [(at + i, x) for at, part in line_dedup._variant_hashes(line) for i, x in enumerate(part.tolist())]
        other = [x for _, part in line_dedup._variant_hashes(line[:100] + line[101:]) for x in part.tolist()]
    assert [x for _, x in sliced] == whole and [at for at, _ in sliced] == list(range(-1, len(line))) and other[0] == whole[101]


def test_one_row_of_each_group_stays(spark):
    one, two = "first text of several words that is here", "second text of quite other words, also here"
    rows = [(4, one), (5, one), (5, two), (6, two), (4, one), (None, "third, with a null id and words"), (None, None), (9, None), (9, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("component_id", F.lit("mine"))
    kept = simhash.keep_one_of_each(docs)
    assert kept.columns == docs.columns
    got = [(r.doc_id, r.text) for r in kept.collect()]
    assert sorted(got[:], key=str) in (sorted([(4, one), (5, two), (None, rows[5][1]), (9, None)], key=str), sorted([(4, one), (5, two), (None, rows[5][1]), (9, "")], key=str))
    assert simhash.keep_one_of_each(docs.where("false")).count() == 0


def test_components_broadcast_nothing(spark, monkeypatch):
    """Every join of op9 is by shuffles: what Spark takes for a small file may be a large hash table on the driver."""
    plans = []

    def noted(df, name, keep=simhash.stored):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return keep(df, name)

    monkeypatch.setattr(simhash, "stored", noted)
    monkeypatch.setattr(components, "stored", noted)
    got = simhash.near_duplicate_components(spark.createDataFrame(some_docs(), DOCS))
    plans.append(got._jdf.queryExecution().executedPlan().toString())
    assert any("SortMergeJoin" in p for p in plans) and not any("Broadcast" in p for p in plans)
