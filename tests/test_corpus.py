"""Corpus queries over every document for itself, and sections as they read."""

from ratebook.operators import corpus as K
from ratebook.operators import search as S
from ratebook.plans.corpus_queries import QUERIES

SF = "/root/testdata/sf0.001"


def test_section_tree_of_every_document(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = QUERIES["section_tree"](spark, SF).collect()
    assert {r.document_id for r in got} == {r.doc_id for r in docs.collect()}
    assert max(r.level for r in got) > 1 and all(r.path.count(" > ") >= r.level - 1 for r in got)


def test_tree_does_not_depend_on_batches(spark):
    rows = [(d, 1 + i // 5, i, f"{i // 5 + 1}.{i} Title {i}" if i % 3 == 0 else f"goes on {i}", 12.0 if i % 3 < 2 else 10.0, i % 3 < 2, 10.0 * i, False) for d in ("a", "b", "c") for i in range(4 * ord(d) - 380)]
    lines = spark.createDataFrame(rows, "document_id string, page int, line_no int, text string, size double, bold boolean, y double, is_table boolean")
    whole = sorted(map(tuple, K.section_tree(lines).collect()), key=str)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1")
    try:
        assert sorted(map(tuple, K.section_tree(lines).collect()), key=str) == whole
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {r[0] for r in whole} == {"a", "b", "c"} and any(" goes on " in r[3] for r in whole)


def test_sections_read_without_bodies(spark):
    chunks = spark.createDataFrame([("d", 1, 2, 12, "two"), ("d", 1, 1, 11, "one"), ("d", 2, 3, 13, "three")], "document_id string, section_ordinal int, ordinal int, chunk_id long, body string")
    sections = spark.createDataFrame([("d", 1, "1", "A", None), ("d", 2, "1.1", "B", 1), ("d", 3, "1.2", "C", 1)], "document_id string, ordinal int, ref string, title string, parent_ordinal int")
    asked = spark.createDataFrame([("d", "1"), ("d", "1.2"), ("d", "9")], "document_id string, ref string")
    full = {r.ref: (r.body, r.chunk_ids, r.children) for r in S.read_sections(asked, sections, chunks).collect()}
    assert full == {"1": ("one\n\ntwo", [11, 12], ["1.1", "1.2"]), "1.2": (None, None, None)}
    slim = S.read_sections(asked, sections, chunks, bodies=False)
    assert {r.ref: (r.chunk_ids, r.children) for r in slim.collect()} == {k: v[1:] for k, v in full.items()} and "body" not in slim.columns


def test_breadcrumbs_of_deep_trees(spark):
    rows = [("d", n, f"t{n}", n, n - 1 if n > 1 else None) for n in range(1, 38)] + [("e", 1, "x", 1, None), ("e", 2, "y", 2, 1)]
    got = K.breadcrumbs(spark.createDataFrame(rows, "document_id string, ordinal int, title string, level int, parent_ordinal int")).collect()
    assert {(r.document_id, r.ordinal): r.path for r in got} == {("d", n): " > ".join(f"t{i}" for i in range(1, n + 1)) for n in range(1, 38)} | {("e", 1): "x", ("e", 2): "x > y"}
