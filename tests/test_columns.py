"""Numbers, texts, ports and quality gates on small tables."""

from decimal import Decimal

from pyspark.sql import functions as F

from ratebook.functions import numbers as N
from ratebook.functions import text as T
from ratebook.operators import corpus as K
from ratebook.operators import facts as FA
from ratebook.operators import quality as Q


def column(spark, expression, values, kind="string"):
    return [r.x for r in spark.createDataFrame([(v,) for v in values], f"v {kind}").select(expression(F.col("v")).alias("x")).collect()]


def test_parse_number(spark):
    printed = ["1 234.50", "1,234.50", "1.234,50", "1,234", "12,5", "1.234.567", "15 %", "-3", "2e3", "NaN", "12 tons", "", None, "1,23,456", "1 000"]
    got = column(spark, N.parse_number, printed)
    wanted = ["1234.5", "1234.5", "1234.5", "1234", "12.5", "1234567", "15", "-3", "2000", None, None, None, None, None, "1000"]
    assert [None if g is None else g.normalize() for g in got] == [None if w is None else Decimal(w).normalize() for w in wanted]


def test_extract_numbers(spark):
    got = column(spark, N.extract_numbers, ["Up to 3 000 0.75", "twenty-four\n2 hundred", "fifth of two thousand", "none", None])
    assert {int(x) if x == int(x) else float(x) for x in got[0]} == {3000, 3, 0, 0.75}
    assert {int(x) for x in got[1]} == {20, 4, 24, 2, 100, 400, 2400}
    assert {int(x) for x in got[2]} == {5, 2, 1000, 2000}
    assert got[3] == [] and not got[4]


def test_quotes_and_lines(spark):
    rows = spark.createDataFrame([("the fee is 5", "All: The FEE<br>is 5, now"), ("fee", "coffee"), ("!", "anything")], "q string, t string")
    assert [r.x for r in rows.select(T.quote_in(F.col("q"), F.col("t")).alias("x")).collect()] == [True, False, False]
    assert column(spark, T.join_lines, [["ton-", "nage", "A-", "B "]], "array<string>") == ["tonnage\nA-\nB"]
    assert column(spark, T.suspect_table, ["| a | b |\n|---|---|\n| 1 | 2 |", "| a | b |\n| 1 |", "| a |\n| b |", "| a | b |\n|  |  |\n|  |  |"]) == [False, True, True, True]
    assert column(spark, T.leaders, ["Dues ........ 12", "oﬃce"]) == ["Dues … 12", "office"]


def lines(spark, rows):
    full = [("d", page, i, text, size, bold, 300.0 if y is None else y, 600.0, table) for i, (page, text, size, bold, y, table) in enumerate(rows)]
    return spark.createDataFrame(full, "document_id string, page int, line_no int, text string, size double, bold boolean, y double, page_height double, is_table boolean")


def test_section_tree(spark):
    def line(text, size=9.0, bold=False, page=1, table=False, y=None):
        return page, text, size, bold, y, table

    rows = [
        line("Front words"), line("SECTION 1 Port dues", 12.0, True, y=10.0), line("and fees", 12.0, True, y=20.0), line("Some longer body text here", y=60.0), line("1.1 Light dues", 10.0, True, y=80.0), line("Body one"),
        line("1.2 Definitions", 10.0, True, y=100.0), line("Body two"), line("Note", 11.0, True, y=200.0), line("Body three of some length"), line("2.1 Odd one", 10.0, True, y=250.0), line("Body four"),
        line("SECTION 2 Other", 12.0, True, page=2, y=5.0), line("1.1 Light dues", 10.0, True, page=2, y=90.0), line("15 May 2020", 12.0, True, page=2, y=150.0),
    ]
    got = K.section_tree(lines(spark, rows)).orderBy("ordinal").collect()
    assert [(r.ref, r.title, r.level, r.parent_ordinal, r.kind) for r in got] == [
        ("s-1", "Front words", 1, None, "body"), ("1", "SECTION 1 Port dues and fees", 1, None, "body"), ("1.1", "1.1 Light dues", 2, 2, "body"), ("1.2", "1.2 Definitions", 2, 2, "definitions"),
        ("s-5", "Note", 3, 4, "body"), ("1.2.2.1", "2.1 Odd one", 3, 4, "body"), ("2", "SECTION 2 Other", 1, None, "body"), ("2.1.1", "1.1 Light dues", 2, 7, "body"),
    ]
    paths = {r.ordinal: r.path for r in K.breadcrumbs(K.section_tree(lines(spark, rows))).collect()}
    assert paths[5] == "SECTION 1 Port dues and fees > 1.2 Definitions > Note"


def test_chunks_and_running_lines(spark):
    rows = [("d", 1, i, 1, t, tab, term) for i, (t, tab, term) in enumerate([("aaaa", False, False), ("bbbb", False, False), ("| t |", True, False), ("cccccccc", False, False), ("Term: x", False, True)])]
    got = K.chunks(spark.createDataFrame(rows, "document_id string, section_ordinal int, seq int, page int, text string, is_table boolean, starts_term boolean").withColumn("section_kind", F.lit("body")), limit=9).orderBy("chunk_no").collect()
    assert [(r.kind, r.body) for r in got] == [("text", "aaaa\nbbbb"), ("table", "aaaa\nbbbb\n\n| t |"), ("text", "cccccccc"), ("text", "Term: x")]
    pages = [(p, t, 9.0, False, y, False) for p in range(1, 5) for t, y in ((f"Tariff book {p}", 10.0), (f"words {p}", 300.0), (str(p + 6), 590.0))]
    kept, labels, running = K.clean_lines(lines(spark, pages))
    assert sorted(r.text for r in kept.collect()) == ["words 1", "words 2", "words 3", "words 4"]
    assert {r.page: r.label for r in labels.collect()} == {1: "1", 2: "2", 3: "3", 4: "4"}
    assert [r.text for r in running.collect()] == ["Tariff book"]


def test_feature_vectors(spark):
    got = K.feature_vectors(spark.createDataFrame([(1, "a b a"), (2, ""), (3, None)], "id int, t string"), "id", "t", 64).collect()
    by = {}
    for r in got:
        by.setdefault(r.id, {})[r.dim] = r.value
    assert by[2] == by[3] == {0: 1.0} and abs(sum(v * v for v in by[1].values()) - 1) < 1e-9


def test_grounding(spark):
    from ratebook.functions.schemas import RULE

    rule = '{"minimum": "250", "components": [{"id": "a", "kind": "fixed", "amount": "12.50"}, {"id": "b", "kind": "fixed", "amount": "1"}], "citations": [{"chunk_id": 1, "quote": "fee of 12,50"}, {"chunk_id": 1, "quote": "never"}, {"chunk_id": 9, "quote": "x"}]}'
    rules = spark.createDataFrame([("r", rule)], "rule_id string, j string").select("rule_id", F.from_json("j", RULE).alias("rule"))
    chunks = spark.createDataFrame([(1, "A fee of 12,50 a day")], "chunk_id bigint, content string")
    got = {(r.path, r.issue) for r in Q.grounding_issues(rules, chunks).collect()}
    assert got == {("citations.2", "no such chunk"), ("citations.1", "quote not in the chunk"), ("minimum", "number not in the cited text")}


def test_rule_problems(spark):
    from ratebook.functions.schemas import RULE
    from ratebook.operators.rating import with_tier_ends

    bad = '{"status": "priced", "minimum": "5", "maximum": "1", "components": [{"id": "a", "kind": "banded", "bands": [{"lower": "5", "upper": "1"}]}, {"id": "a", "kind": "tiered", "tiers": [{"rate": "1"}, {"up_to": "2"}]}], "facts": [{"name": "loa_m", "type": "number"}], "adjustments": [{"id": "x", "applies_to": ["zz"], "when": [{"any_of": [{"fact": "ghost", "op": "eq", "value": ["1", "2"]}]}]}], "applies_when": [], "exemptions": []}'
    good = '{"status": "priced", "components": [{"id": "a", "kind": "fixed", "amount": "1"}], "facts": [], "adjustments": [], "applies_when": [], "exemptions": []}'
    rules = with_tier_ends(spark.createDataFrame([(1, bad), (2, good)], "rule_id int, j string").select("rule_id", F.from_json("j", RULE).alias("rule")))
    got = {r.rule_id: set(r.problems) for r in Q.rule_problems(rules).collect()}
    assert got[2] == set()
    assert got[1] == {"maximum below minimum", "component ids repeat", "a fact is named like a quantity", "an adjustment's target is unknown", "a condition's subject is unknown", "bands don't ascend", "tiers don't ascend", "only `in` takes several values"}


def test_batches_and_rereads(spark):
    rows = spark.createDataFrame([(1, "a", 1, 30), (1, "b", 2, 15), (1, "c", 3, 60), (1, "d", 4, 1)], "call_id int, charge_id string, pos int, n_facts int")
    assert sorted((r.charge_id, r.batch) for r in FA.batch_rules(rows).collect()) == [("a", 1), ("b", 2), ("c", 3), ("d", 4)]
    page = spark.createDataFrame([("rates 5 and 7", ["| 5 |"], ["| 7 |"]), ("rates 5", ["| 5 |"], ["| 6 |"]), ("rates 5", ["| 5 |"], [])], "p string, a array<string>, b array<string>")
    assert [r.x for r in page.select(Q.table_reread_ok(F.col("p"), F.col("a"), F.col("b")).alias("x")).collect()] == [True, False, False]
