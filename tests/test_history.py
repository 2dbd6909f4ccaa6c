"""Facts that nobody answered, catalogues as discovered, merged calls and files of several lines."""

import json
import tempfile

from pyspark.sql import functions as F

from ratebook.functions.schemas import RULE
from ratebook.operators import calls as C
from ratebook.operators import facts as FA
from ratebook.operators import quality as Q
from ratebook.operators.rating import prepared, rate
from ratebook.sources import files as IO

SEASON = {
    "status": "priced", "name": "Fee", "components": [{"id": "fee", "label": "Fee", "kind": "fixed", "amount": "5"}], "exemptions": [], "adjustments": [], "citations": [], "notes": [],
    "facts": [{"name": "season", "type": "text", "description": "Season", "default_value": "low"}, {"name": "crew", "type": "number"}], "applies_when": [{"any_of": [{"fact": "season", "op": "eq", "value": ["low"]}]}],
}


def test_failed_batches_leave_defaults_to_rating(spark):
    rows = [(i, "c", i, json.dumps(SEASON), {"season": "low"} if i == 4 else {}) for i in range(1, 7)]
    candidates = prepared(spark.createDataFrame(rows, "call_id int, charge_id string, pos int, j string, overrides map<string,string>").withColumn("rule", F.from_json("j", RULE)).drop("j"))
    decisions = spark.createDataFrame([(2, "c", "season", "high", 1), (2, "c", "season", "low", 2), (3, "c", "season", "high", 1), (5, "c", "crew", "3", 1), (5, "c", "other", "x", 1), (6, "c", "season", "high", 1)], "call_id int, charge_id string, fact string, value string, pos int")
    failed = spark.createDataFrame([(3, "c"), (4, "c")], "call_id int, charge_id string")
    told = {(r.call_id, r.fact): (r.value, r.source) for r in FA.resolve_facts(candidates, decisions, failed).collect()}
    assert told == {(1, "season"): ("low", "default"), (2, "season"): ("low", "decision"), (4, "season"): ("low", "override"), (5, "season"): ("low", "default"), (5, "crew"): ("3", "decision"), (6, "season"): ("high", "decision")}
    given = FA.with_facts(candidates, decisions, failed)
    assert {r.call_id: r.facts for r in given.collect()} == {1: {"season": "low"}, 2: {"season": "low"}, 3: {}, 4: {"season": "low"}, 5: {"season": "low", "crew": "3"}, 6: {"season": "high"}}
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    items = rate(given.select("call_id", "charge_id", "rule", "plan", "facts", none.cast("map<string,decimal(20,6)>").alias("quantities"), none.alias("assumptions")))
    assert {r.call_id: (r.status, len(r.assumptions or [])) for r in items.collect()} == {1: ("charged", 0), 2: ("charged", 0), 3: ("charged", 1), 4: ("charged", 0), 5: ("charged", 0), 6: ("not_applicable", 0)}
    assert {(r.call_id, r.n_facts) for r in FA.fact_batches(candidates).collect()} == {(i, 1 if i == 4 else 2) for i in range(1, 7)}


def test_catalogue_is_cleaned_by_document(spark):
    entries = spark.createDataFrame(
        [("d", 1, "fee", ["4.1.9", " 4.1. ", "9"]), ("d", 2, "gone", ["7", "x.1"]), ("d", 3, "fee", ["4"]), ("d", 4, "none", []), ("d", 5, "null", None), ("e", 1, "fee", ["4.1"]), ("e", 2, "fee", ["8", "4.1"])], "document_id string, pos int, charge_id string, section_refs array<string>",
    )
    refs = spark.createDataFrame([("d", "4.1"), ("d", "4"), ("e", "8")], "document_id string, ref string")
    cleaned, unknown = Q.clean_catalogue(entries, refs)
    assert {(r.document_id, r.pos, r.asked_id, r.charge_id, tuple(r.section_refs)) for r in cleaned.collect()} == {("d", 1, "fee", "fee", ("4.1",)), ("d", 3, "fee", "fee_2", ("4",)), ("e", 2, "fee", "fee", ("8",))}
    assert {(r.document_id, r.pos, tuple(r.refs)) for r in unknown.collect()} == {("d", 1, ("9",)), ("d", 2, ("7", "x.1")), ("e", 1, ("4.1",)), ("e", 2, ("4.1",))}


def test_additional_is_replaced_whole(spark):
    kind = "call_id int, port string, num_services int, additional map<string,string>"
    profiles = spark.createDataFrame([(1, None, None, {"a": "p", "statements": "old"}), (2, None, None, None), (3, None, None, {"a": "p"}), (5, None, None, None)], kind)
    asked = spark.createDataFrame([(i, "x", 2, {"a": "q", "b": "q"} if i != 4 else None) for i in (1, 2, 3, 4)], kind).withColumns({"request_port": F.lit(None).cast("string"), "request_num_services": F.lit(None).cast("int"), "statements": F.when(F.col("call_id") != 3, F.array(F.lit("s1"), F.lit("s2")))})
    got = {r.call_id: (r.additional, r.error) for r in C.merge_sources(profiles, asked, ["num_services", "port"]).collect()}
    said = '["s1","s2"]'
    assert got == {1: ({"a": "p", "statements": said}, None), 2: ({"a": "q", "b": "q", "statements": said}, None), 3: ({"a": "p"}, None), 4: ({"statements": said}, None), 5: (None, "PORT_REQUIRED")}


def test_files_of_several_lines(spark):
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    for name, text in (("one.json", '{\n "charge_id": "a",\n "minimum": "2.50"\n}\n'), ("two.json", '{"charge_id":\n"b"}')):
        with open(f"{folder}/{name}", "w") as f:
            f.write(text)
    assert {(r.call_id, json.loads(r.profile)["charge_id"]) for r in IO.read_profiles(spark, folder).collect()} == {("one", "a"), ("two", "b")}
    assert {(r.charge_id, str(r.rule.minimum)) for r in IO.read_rules(spark, folder).collect()} == {("a", "2.500000"), ("b", "None")}
    assert {r.rulebook.count("\n") for r in IO.read_rulebooks(spark, folder).collect()} == {4, 1}
