"""Greedy packing by jump pointers against plain loops, and its time on one large group."""

import random
import time

from pyspark.sql import functions as F

from ratebook.operators import corpus as K
from ratebook.operators import facts as FA
from ratebook.operators.rulebook import unique_ids


def batches(sizes, limit):
    out, size, no = [], 0, 1
    for n in sizes:
        if size > 0 and size + n > limit:
            no, size = no + 1, 0
        size += n
        out.append(no)
    return out


def test_batches_agree_with_a_loop(spark):
    rng = random.Random(2)
    calls = {c: [rng.choice([0, 0, 1, 3, 9, 10, 11, 25]) for _ in range(rng.randrange(1, 40))] for c in range(60)}
    calls[100], calls[101], calls[102] = [0] * 9, [50], [0, 50, 0, 0, 50]
    rows = [(c, f"r{i}", i, n) for c, sizes in calls.items() for i, n in enumerate(sizes)]
    got = {(r.call_id, r.charge_id): r.batch for r in FA.batch_rules(spark.createDataFrame(rows, "call_id int, charge_id string, pos int, n_facts int"), limit=10).collect()}
    assert got == {(c, f"r{i}"): b for c, sizes in calls.items() for i, b in enumerate(batches(sizes, 10))}


def chunks(lines, limit):
    """(kind, texts) of each chunk of one section; lines are (text, is_table, kind of section)."""
    out, chars, shut, said = [], 0, True, []
    for text, is_table, kind in lines:
        term = kind == "definitions" and not is_table and text.startswith("“a”")
        if shut or is_table or term or chars + len(text) > limit:
            out.append(("table" if is_table else "definition" if kind == "definitions" else "text", said[-2:] if is_table else [], []))
            chars = 0
        out[-1][2].append(text)
        chars, shut = chars + len(text), is_table
        if not is_table:
            said.append(text)
    return out


def test_chunks_agree_with_a_loop(spark):
    rng = random.Random(4)
    rows, want = [], {}
    for section in range(40):
        kind = rng.choice(["body", "definitions"])
        lines = [(("“a” " if rng.random() < 0.2 else "") + "x" * rng.choice([0, 1, 5, 9, 31]), rng.random() < 0.15, kind) for _ in range(rng.randrange(1, 40))]
        rows += [("d", section, kind, i, i // 3, t, table) for i, (t, table, _) in enumerate(lines)]
        want[section] = [(k, len(own), "\n".join(intro) + "\n\n" + own[0] if k == "table" and intro else "\n".join(t.strip() for t in own)) for k, intro, own in chunks(lines, 30)]
    frame = spark.createDataFrame(rows, "document_id string, section_ordinal int, section_kind string, seq int, page int, text string, is_table boolean").withColumn("chars", F.lit("mine"))
    got = {}
    for r in K.chunks(frame, limit=30).orderBy("section_ordinal", "chunk_no").collect():
        got.setdefault(r.section_ordinal, []).append((r.kind, r.n_lines, r.body))
        assert r.chunk_no == len(got[r.section_ordinal])
    assert got == {s: [(k, n, body.strip()) for k, n, body in own] for s, own in want.items()}


def test_one_large_group(spark):
    """A fold that copies its list for each entry takes over a minute for these."""
    n = 40_000
    began = time.time()
    rules = spark.range(n).select(F.lit(1).alias("call_id"), F.col("id").cast("string").alias("charge_id"), F.col("id").alias("pos"), F.lit(30).alias("n_facts"))
    assert FA.batch_rules(rules).agg(F.max("batch")).first()[0] == n
    lines = spark.range(n).select(F.lit("d").alias("document_id"), F.lit(1).alias("section_ordinal"), F.lit("body").alias("section_kind"), F.col("id").alias("seq"), F.lit(1).alias("page"), F.lit("z" * 60).alias("text"), F.lit(False).alias("is_table"))
    assert K.chunks(lines, limit=100).count() == n
    assert time.time() - began < 60


def names(ids):
    seen, out = set(), []
    for i in ids:
        name, k = i, 2
        while name in seen:
            name, k = f"{i}_{k}", k + 1
        seen.add(name)
        out.append(name)
    return out


def test_unique_ids_agree_with_a_loop(spark):
    rng = random.Random(9)
    groups = {g: [rng.choice(["a", "a_2", "a_3", "a_2_2", "b", "a_02", "a_2_3", "_2", ""]) for _ in range(rng.randrange(1, 25))] for g in range(80)}
    groups[100], groups[101], groups[102] = ["a", "a", "a_2", "a", "a_2", "a_2_2"], ["a", "a_2", "a", "a"], ["a_3", "a", "a", "a", "a_4"]
    rows = [(g, i, x) for g, ids in groups.items() for i, x in enumerate(ids)]
    got = {(r.g, r.pos): r.unique_id for r in unique_ids(spark.createDataFrame(rows, "g int, pos int, charge_id string"), "g", "pos").collect()}
    assert got == {(g, i): x for g, ids in groups.items() for i, x in enumerate(names(ids))}


def test_many_equal_ids(spark):
    n = 100_000
    began = time.time()
    rows = spark.range(n).select(F.lit("g").alias("g"), F.col("id").alias("pos"), F.when(F.col("id") == n - 2, "a_2").otherwise("a").alias("charge_id")).union(spark.createDataFrame([("g", -1, "a_7")], "g string, pos long, charge_id string"))
    got = unique_ids(rows, "g", "pos")
    assert got.agg(F.count_distinct("unique_id")).first()[0] == n + 1
    last = {r.pos: r.unique_id for r in got.where(F.col("pos") >= n - 2).collect()}
    assert last == {n - 2: "a_2_2", n - 1: f"a_{n}"} and time.time() - began < 30


def test_opening_text(spark):
    rng = random.Random(3)
    rows, want = [], {}
    for d in range(30):
        lines = sorted(((rng.choice([None, 1, 2, 3, 9, 500, 70_000]), i, rng.choice(["", None, "abc", "x" * 20])) for i in range(rng.randrange(1, 25))), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        rows += [(f"d{d}", *r) for r in lines]
        size, shown = 0, []
        for _, _, text in lines:
            if size >= 40:
                break
            size += len(text or "")
            shown += [text] if text is not None else []
        want[f"d{d}"] = "\n".join(shown)
    frame = spark.createDataFrame(rows, "document_id string, page int, line_no int, text string")
    assert {r.document_id: r.opening for r in K.opening_text(frame, limit=40).collect()} == want
