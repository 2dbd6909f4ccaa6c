"""What large tables asked for: the same rows by plans that move and compute less."""

import random
import tempfile

from pyspark.sql import functions as F

from ratebook.functions.schemas import RULE
from ratebook.operators import facts as FA
from ratebook.operators import search as S
from ratebook.plans import corpus_queries as CQ
from ratebook.sources import files as IO


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def charges(spark):
    names = "struct('a' as name, 'x' as default_value), struct('b' as name, cast(null as string) as default_value), struct('c' as name, cast(null as string) as default_value)"
    rows = spark.createDataFrame([(1, "p", 1, {"b": "o"}), (1, "q", 2, {}), (2, "p", 1, None), (3, "p", 1, {"a": "o"}), (4, "p", 1, {"a": "o", "b": "o", "c": "o"})], "call_id int, charge_id string, pos int, overrides map<string,string>")
    return rows.withColumn("rule", F.from_json(F.to_json(F.expr(f"struct(array({names}) as facts)")), RULE))


def test_facts_are_opened_after_the_joins(spark):
    decisions = spark.createDataFrame([(1, "p", "a", "d", 1), (1, "p", "a", "e", 2), (1, "q", "c", None, 1), (2, "p", "c", "d", 1), (3, "p", "b", "d", 1), (2, "p", None, "d", 1), (2, "p", "z", "d", 1)], "call_id int, charge_id string, fact string, value string, pos int")
    failed = spark.createDataFrame([(3, "p"), (3, "p")], "call_id int, charge_id string")
    told = FA.resolve_facts(charges(spark), decisions, failed)
    assert sorted(map(tuple, told.collect())) == [
        (1, "p", "a", "e", "decision"), (1, "p", "b", "o", "override"), (1, "q", "a", "x", "default"), (2, "p", "a", "x", "default"), (2, "p", "c", "d", "decision"), (3, "p", "a", "o", "override"),
        (4, "p", "a", "o", "override"), (4, "p", "b", "o", "override"), (4, "p", "c", "o", "override"),
    ]
    assert plan(told).index("Generate") < plan(told).index("Join")


def test_batches_of_facts_are_dealt_once(spark):
    found = FA.fact_batches(charges(spark), 3)
    assert sorted(map(tuple, found.select("call_id", "charge_id", "batch", "n_facts").collect())) == [(1, "p", 1, 2), (1, "q", 2, 3), (2, "p", 1, 3), (3, "p", 1, 2)]
    assert "Join" not in plan(found) and plan(found).count("Exchange") == 1
    rng = random.Random(6)
    calls = {c: [rng.choice([0, 0, 1, 3, 9, 10, 11, 25]) for _ in range(rng.choice([3, 63, 64, 65, 200]))] for c in range(40)}
    want = {}
    for c, sizes in calls.items():
        size, no = 0, 1
        for i, n in enumerate(sizes):
            no, size = (no + 1, n) if size > 0 and size + n > 10 else (no, size + n)
            want[c, i] = no
    rows = spark.createDataFrame([(c, str(i), i, n) for c, sizes in calls.items() for i, n in enumerate(sizes)], "call_id int, charge_id string, pos int, n_facts int")
    assert {(r.call_id, int(r.charge_id)): r.batch for r in FA.batch_rules(rows, 10).collect()} == want


def test_tiles_agree_with_pairs_and_cut_ties(spark, monkeypatch):
    rng = random.Random(8)
    vector = lambda: rng.choice([[rng.choice([-1.0, 0.0, 0.5, 2.0]) for _ in range(4)], [1.0, 0.0, 0.0, 0.0], [0.5, None, 1.0, 1.0]])
    c = spark.createDataFrame([(f"c{i}", rng.choice(["a", "b"]), vector()) for i in range(300)], "chunk_id string, document_id string, embedding array<float>")
    q = spark.createDataFrame([(i, rng.choice(["a", "b"]), vector()) for i in range(90)], "query_id long, document_id string, embedding array<double>")
    monkeypatch.setattr(S, "TILE_BYTES", 640)
    for k in (1, 3, 50):
        want, got = S.semantic_top(q, c, k, digits=6), S.semantic_top_blocks(q, c, k, digits=6, block=5)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select(*got.columns).collect()))


def test_queries_travel_once_for_each_tile(spark):
    """300 chunks and 300 queries of one document in blocks of 5 are one tile each, not 3,600 pairs of blocks."""
    rows = spark.range(300).select(F.col("id").alias("vec"), F.lit("d").alias("document_id"), F.array(F.col("id").cast("float"), F.lit(1).cast("float")).alias("embedding"))
    assert S._tiles(rows, "vec", 5).count() == 1


def test_recall_multiplies_blocks(spark):
    """Every query meets every chunk; row by row that took 71 of 92 CPU seconds for 10,256 vectors."""
    out = CQ.recall_at_k(spark, "/root/testdata/sf0.001")
    assert "MapInArrow" in plan(out)
    n, found, share = out.first()
    assert n > 0 and 0 <= found <= n and share == round(found / n, 6)


def test_nearest_ids_agree_with_sorting(spark):
    rng = random.Random(4)
    ids = {d: rng.sample(range(300), n) for d, n in (("a", 90), ("b", 3), ("c", 40))}
    chunks = spark.createDataFrame([(d, i) for d, own in ids.items() for i in own] + [("b", None), (None, 20)], "document_id string, chunk_id long")
    want = []
    for d, own in ids.items():
        for q in (i for i in own if i % 4 == 0):
            want += [(d, q, i, r + 1) for r, i in enumerate(sorted(own, key=lambda i: (abs(i - q), i))[:5])]
    got = CQ._nearest_ids(chunks.where("document_id = 'a'"), "chunk_id % 4 = 0", 5)
    assert sorted(map(tuple, got.collect())) == sorted((q, i, r) for d, q, i, r in want if d == "a")
    few = CQ._nearest_ids(chunks.where("document_id = 'b' or document_id is null"), f"chunk_id = {ids['b'][0]}", 5)
    assert [r.chunk_id for r in few.orderBy("lex_rank").collect()] == [*sorted(ids["b"], key=lambda i: (abs(i - ids["b"][0]), i)), None]


def test_lexical_top_moves_asked_words_only(spark):
    rng = random.Random(5)
    text = lambda n: " ".join(f"w{rng.randrange(30)}" for _ in range(n))
    rows = [(f"d{i % 2}", i, 100 - i, text(2), text(rng.randrange(0, 12))) for i in range(80)] + [("d0", 90, 1, "...", None), ("d0", 91, 2, None, "ß")]
    chunks = spark.createDataFrame(rows, "document_id string, chunk_id long, ordinal long, path string, body string")
    asked = spark.createDataFrame([(i, f"d{i % 3}", text(3)) for i in range(12)], "query_id int, document_id string, text string")
    index = S.lexical_index(chunks)
    counted, given = S.lexical_top(asked, index, 4, digits=6), S.lexical_top(asked, index, 4, digits=6, sizes=S.lexical_sizes(chunks))
    assert sorted(map(tuple, given.collect())) == sorted(map(tuple, counted.collect())) and given.count() > 20
    assert 0 <= plan(given).find("hashpartitioning(document_id", plan(given).index("REPARTITION_BY_COL")) < plan(given).index("LeftSemi")


def test_small_files_share_tasks(spark):
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    for i in range(40):
        with open(f"{folder}/{i}.json", "w") as f:
            f.write(f'{{"n":\n{i}}}')
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1m")
    try:
        read = IO.read_profiles(spark, folder)
        assert read.rdd.getNumPartitions() <= 4 * spark.sparkContext.defaultParallelism < 40
        assert {r.call_id: r.profile for r in read.collect()} == {str(i): f'{{"n":\n{i}}}' for i in range(40)}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
