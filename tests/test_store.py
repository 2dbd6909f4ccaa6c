"""Documents replaced in the store, and rulebook files loaded into it."""

import json
import tempfile

import pytest
from pyspark.sql import functions as F

from ratebook.operators import importing, quality
from ratebook.operators.facts import rule_units
from ratebook.functions.schemas import RULE
from ratebook.sources import store

A, B = "document_id string, a long", "document_id string, b string"


@pytest.fixture
def root():
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp")


def seen(spark, root):
    return {name: sorted(map(tuple, store.current(spark, root, name, schema).collect()), key=repr) for name, schema in (("a", A), ("b", B))}


def put(spark, root, a, b, documents, version):
    store.replace_documents(root, {"a": spark.createDataFrame(a, A), "b": spark.createDataFrame(b, B)}, spark.createDataFrame([(d,) for d in documents], "document_id string"), version)


def test_readers_see_a_version_as_a_whole(spark, root, monkeypatch):
    assert seen(spark, root) == {"a": [], "b": []}
    put(spark, root, [("x", 1), ("x", 1), ("y", 2), ("z", 9), (None, 3)], [("x", "one"), ("y", "two")], ["x", "y", "y", None], 1)
    first = {"a": [("x", 1), ("x", 1), ("y", 2)], "b": [("x", "one"), ("y", "two")]}
    assert seen(spark, root) == first
    real = store._put

    def broken(rows, path, version):
        if path.endswith(store.COMMITS):
            raise RuntimeError("lost")
        real(rows, path, version)

    monkeypatch.setattr(store, "_put", broken)
    with pytest.raises(RuntimeError):
        put(spark, root, [("x", 7), ("w", 8)], [("w", "new")], ["x", "w"], 2)
    assert seen(spark, root) == first  # all rows of version 2 are there, but it doesn't count yet
    monkeypatch.setattr(store, "_put", real)
    for _ in range(2):  # the second time as a replay
        put(spark, root, [("x", 70), ("w", 8)], [("w", "new")], ["x", "w"], 2)
        assert seen(spark, root) == {"a": [("w", 8), ("x", 70), ("y", 2)], "b": [("w", "new"), ("y", "two")]}
    put(spark, root, [], [], ["y"], 3)
    now = {"a": [("w", 8), ("x", 70)], "b": [("w", "new")]}
    assert seen(spark, root) == now
    store.compact(spark, root, {"a": A, "b": B}, 4)
    assert seen(spark, root) == now and {r.version for r in store.versions(spark, root).collect()} == {4}


def rule(quote, chunk=1, **more):
    return {"status": "priced", "components": [{"id": "fee", "label": "Fee", "kind": "fixed", "amount": "5"}], "facts": [], "citations": [{"chunk_id": chunk, "section_ref": "1", "page": 1, "quote": quote}], **more}


def book(checksum, entries, **more):
    rules = [{"port_key": "main", "charge_id": c, "rule": json.dumps(r) if r else None, **({"prompt_version": v} if v else {})} for c, r, v in entries]
    return json.dumps({"format": 1, "schema_version": 2, "prompt_version": "p2", "checksum": checksum, "profile": {"title": "T " + checksum, "ports": ["a"]}, "catalogue": [{"charge_id": "c1", "section_refs": ["1"]}], "ordinals": {"1": 0, "2": 1}, "rules": rules} | more)


def test_import_of_files(spark, root):
    deducts = rule("hello world", components=[{"id": "fee", "label": "Fee", "kind": "per_unit", "rate": "2", "units": {"basis": "gross_tonnage", "unit_size": "1", "rounding": "ceil", "less": "crew"}}], facts=[{"name": "crew", "type": "number"}])
    wrong = rule("hello world", facts=[{"name": "loa_m", "type": "number"}])
    exempt = rule("good bye", chunk=2, exemptions=[{"description": "none", "when": [{"any_of": [{"fact": "gross_tonnage", "op": "gt", "value": ["5"]}]}], "citation": {"chunk_id": 1, "section_ref": "1", "page": 1, "quote": "nowhere at all"}}])
    files = [
        ("f1", book("k1", [("c1", rule("Hello, world!"), None), ("c2", rule("lost words"), None), ("c3", None, None), ("c4", deducts, None), ("c5", wrong, None), ("c6", exempt, None), ("c7", rule("good bye"), "p2")])), ("f2", book("k1", [("c1", rule("hello world"), None)])),
        ("g", "{not json"), ("h", book("k2", [], format=2)), ("i", book("k2", [], schema_version=3)), ("j", book("k2", [("c1", None, "p1")])), ("k", book("nobody", [])), ("l", book("k3", [])), ("m", book("k4", [])), ("n", book("k5", [])), ("o", book("k5", [("c9", None, None)])),
    ]
    documents = spark.createDataFrame([("k1", "d1", "ready"), ("k2", "d2", "ready"), ("k3", "d3", "failed"), ("k4", "d4", "ready"), ("k5", "d5", "ready")], "checksum string, document_id string, status string")
    chunks = spark.createDataFrame([("d1", 101, 0, "1", "So: hello world, said they."), ("d1", 102, 1, "2", "And good<br>bye."), ("d2", 103, 0, "1", "hello world")], "document_id string, chunk_id long, ordinal long, section_ref string, content string")
    options = {"format_version": 1, "schema_version": 2, "prompt_version": "p2", "reuse_older": False}
    got = importing.import_rulebooks(spark.createDataFrame(files, "file string, rulebook string"), documents, spark.createDataFrame([("d4",)], "document_id string"), chunks, **options)
    told = {r.file: (r.reason, r.n_rules, r.left_out) for r in got.decisions.collect()}
    assert told == {
        "f1": (None, 4, ["c2", "c5", "c6"]), "f2": ("has_rules", 0, []), "g": ("format", 0, []), "h": ("format", 0, []), "i": ("schema", 0, []), "j": ("prompts", 0, []), "k": ("document", 0, []), "l": ("document", 0, []), "m": ("has_rules", 0, []), "n": (None, 0, []), "o": (None, 1, []),
    }
    assert {(r.document_id, r.charge_id, r.rule and r.rule.citations[0].chunk_id) for r in got.rules.collect()} == {("d1", "c1", 101), ("d1", "c3", None), ("d1", "c4", 101), ("d1", "c7", 102), ("d5", "c9", None)}
    assert {(r.document_id, r.title) for r in got.profiles.collect()} == {("d1", "T k1"), ("d5", "T k5")}
    store.replace_documents(root, got.tables(), got.documents(), 1)
    assert {r.document_id for r in store.current(spark, root, "catalogue", "document_id string, pos int, charge_id string").collect()} == {"d1", "d5"}
    none = importing.import_rulebooks(spark.createDataFrame([], "file string, rulebook string"), documents, documents.select("document_id").limit(0), chunks, **options)
    assert none.decisions.collect() == [] and none.rules.collect() == []


def test_what_units_deduct(spark):
    units = {"basis": "gross_tonnage", "unit_size": "10", "rounding": "ceil"}
    facts = [{"name": "crew", "type": "number"}, {"name": "season", "type": "text"}]

    def problems(less, place):
        u = units | {"less": less}
        comps = {"units": [{"id": "fee", "kind": "per_unit", "rate": "1", "units": u}], "time": [{"id": "fee", "kind": "per_unit", "rate": "1", "units": units, "per_time": u}], "band": [{"id": "fee", "kind": "banded", "basis": "loa_m", "bands": [{"lower": "0", "base_fee": "1", "inc_rate": "1", "inc_units": u}]}]}
        r = {"status": "priced", "components": comps.get(place, comps["units"] if place != "multiplier" else [{"id": "fee", "kind": "fixed", "amount": "1"}]), "facts": facts, "exemptions": [], "adjustments": [], "applies_when": [], "citations": []} | ({"multiplier": u} if place == "multiplier" else {})
        frame = spark.createDataFrame([("c", json.dumps(r))], "charge_id string, j string").select("charge_id", F.from_json("j", RULE).alias("rule"))
        assert less in [x.less for x in rule_units(frame).collect()]
        return quality.rule_problems(frame).first().problems

    for place in ("units", "time", "band", "multiplier"):
        assert problems("crew", place) == problems("net_tonnage", place) == []
        assert problems("season", place) == problems("nobody", place) == ["a subtracted subject is neither a quantity nor a number"]
