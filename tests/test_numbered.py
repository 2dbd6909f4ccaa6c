"""Positions in a total order, numbered in ranges."""

from ratebook.operators import rulebook as RB
from ratebook.plans import call_queries

SF = "/root/testdata/sf0.001"


def test_positions_by_ranges(spark):
    rows = [([i % 5, i % 3], i) for i in range(300)]
    got = RB.numbered(spark.createDataFrame(rows, "k array<int>, id long"), "k", "id")
    assert {r.id: r.pos for r in got.collect()} == {i: n for n, (_, i) in enumerate(sorted(rows), 1)}
    assert RB.numbered(spark.createDataFrame([], "k array<int>, id long"), "k", "id").count() == 0


def test_sections_are_sorted_in_ranges(spark):
    part = spark.read.parquet(f"{SF}/part.parquet").select("p_partkey", "p_size").collect()
    ordered = sorted((r.p_size, r.p_partkey % 7, r.p_partkey) for r in part)
    out = call_queries.QUERIES["section_sorted_all"](spark, SF)
    assert {r.p_partkey: r.pos for r in out.collect()} == {k: n for n, (*_, k) in enumerate(ordered, 1)}
    assert "SinglePartition" not in out._jdf.queryExecution().executedPlan().toString()
