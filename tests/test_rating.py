"""Golden amounts, boundaries and failures of rating."""

import json
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ratebook.functions.schemas import RULE
from ratebook.operators import rating as R


def units(basis, size="1", rounding="pro_rata", above=None, less=None):
    return {"basis": basis, "unit_size": size, "rounding": rounding, "above": above, "less": less}


def part(kind, part_id="fee", **more):
    return {"id": part_id, "label": part_id, "kind": kind, "when": []} | more


def test_if(fact="flag", op="eq", *value):
    return {"any_of": [{"fact": fact, "op": op, "value": list(value)}]}


test_if.__test__ = False


def rule(*components, **more):
    base = {"charge_id": "c", "port_key": "main", "currency": "EUR", "status": "priced", "notes": [], "applies_when": [], "exemptions": [], "adjustments": [], "facts": [], "citations": []}
    return base | {"components": list(components)} | more


def price(spark, rules, quantities, facts=None, assumptions=None):
    rows = [(name, json.dumps(r)) for name, r in rules.items()]
    book = R.prepared(spark.createDataFrame(rows, "charge_id string, j string").select("charge_id", F.from_json("j", RULE).alias("rule")))
    call = spark.createDataFrame([(1, {k: Decimal(v) for k, v in quantities.items()}, assumptions or {}, facts or {})], "call_id int, quantities map<string,decimal(20,6)>, assumptions map<string,string>, facts map<string,string>")
    return {r.charge_id: r for r in R.rate(book.crossJoin(call)).collect()}


HUNDREDS = units("gross_tonnage", "100", "ceil")


def test_golden_charges(spark):
    rules = {
        "dues": rule(part("per_unit", rate="117.08", units=HUNDREDS)),
        "stay": rule(part("per_unit", "a", rate="192.73", units=HUNDREDS), part("per_unit", "b", rate="57.79", units=HUNDREDS, per_time=units("time_in_port_hours", "24"))),
        "bands": rule(part("banded", basis="gross_tonnage", bands=[{"lower": "0", "upper": "50000", "base_fee": "1"}, {"lower": "50000", "base_fee": "73118.07", "inc_rate": "32.24", "inc_units": units("gross_tonnage", "100", "ceil", "50000")}]), multiplier=units("num_services")),
        "unit": rule(part("per_unit", rate="0.65", units=units("gross_tonnage"))),
        "two": rule(part("fixed", "a", amount="18608.61"), part("per_unit", "b", rate="9.72", units=HUNDREDS), multiplier=units("num_services")),
        "three": rule(part("fixed", "a", amount="2801.91"), part("per_unit", "b", rate="13.68", units=HUNDREDS), multiplier=units("num_services")),
        "fixed": rule(part("fixed", amount="1654.56"), multiplier=units("num_services")),
    }
    got = price(spark, rules, {"gross_tonnage": "51300", "time_in_port_hours": "81.36", "num_services": "2"}, assumptions={"num_services": "two assumed"})
    wanted = {"dues": "60062.04", "stay": "199371.35", "bands": "147074.38", "unit": "33345.00", "two": "47189.94", "three": "19639.50", "fixed": "3309.12"}
    assert {k: str(r.amount) for k, r in got.items()} == wanted
    assert sum(r.amount for r in got.values()) == Decimal("509991.33")
    assert got["fixed"].assumptions == ["two assumed"] and got["dues"].assumptions == []
    assert got["dues"].formula[-1] == "Amount (rounded to cents): 60,062.04"


def test_boundaries(spark):
    bands = [{"lower": "0", "upper": "100", "base_fee": "1"}, {"lower": "100", "upper": "200", "base_fee": "2"}]
    tiers = [{"up_to": "50", "rate": "1", "unit_size": "1", "rounding": "pro_rata"}, {"width": "50", "rate": "2", "unit_size": "1", "rounding": "pro_rata"}]
    rules = {
        "shared_bound": rule(part("banded", basis="loa_m", bands=bands)),
        "no_band": rule(part("banded", basis="beam_m", bands=bands)),
        "tier_end": rule(part("tiered", basis="loa_m", tiers=tiers)),
        "past_tiers": rule(part("tiered", basis="beam_m", tiers=tiers)),
        "half_cent": rule(part("fixed", amount="2.675")),
        "minimum": rule(part("fixed", amount="1"), minimum="10", multiplier=units("num_services")),
        "maximum": rule(part("fixed", amount="99"), maximum="10"),
        "all_free": rule(part("per_unit", rate="5", units=units("loa_m", above="1000"))),
        "missing": rule(part("per_unit", rate="5", units=units("deadweight"))),
        "unreached": rule(part("fixed", amount="1"), applies_when=[test_if("loa_m", "gt", "500"), test_if("nothing", "eq", "1")]),
        "reached": rule(part("fixed", amount="1"), applies_when=[test_if("loa_m", "gt", "5"), test_if("nothing", "eq", "1")]),
        "wrong_op": rule(part("fixed", amount="1"), applies_when=[test_if("flag", "lt", "yes")], facts=[{"name": "flag", "type": "bool", "default_value": "no"}]),
        "default_fact": rule(part("fixed", amount="1"), applies_when=[test_if("flag", "eq", "false")], facts=[{"name": "flag", "type": "bool", "default_value": "no"}]),
    }
    got = price(spark, rules, {"loa_m": "100", "beam_m": "250", "num_services": "3"})
    amounts = {k: None if r.amount is None else str(r.amount) for k, r in got.items()}
    assert amounts == {"shared_bound": "1.00", "no_band": None, "tier_end": "150.00", "past_tiers": "150.00", "half_cent": "2.68", "minimum": "30.00", "maximum": "10.00", "all_free": None, "missing": None, "unreached": None, "reached": None, "wrong_op": None, "default_fact": "1.00"}
    assert got["no_band"].status == got["missing"].status == got["reached"].status == got["wrong_op"].status == "failed"
    assert got["missing"].error == "no value for quantity deadweight" and got["reached"].error == "no value for nothing"
    assert got["unreached"].status == "not_applicable" and got["all_free"].reason == R.COMPUTES_TO_ZERO
    assert got["default_fact"].assumptions == ["flag: assumed no."]


def test_adjustments(spark):
    def cut(name, percent, group=None, kind="reduction", to=("all",)):
        return {"id": name, "kind": kind, "percent": percent, "applies_to": list(to), "exclusive_group": group, "when": [test_if("loa_m", "gt", "1")]}

    base = [part("fixed", "a", amount="100"), part("fixed", "b", amount="50")]
    rules = {
        "additive": rule(*base, adjustments=[cut("x", "10"), cut("y", "20")]),
        "group": rule(*base, adjustments=[cut("x", "10", "g"), cut("y", "30", "g"), cut("z", "30", "g", "surcharge")]),
        "target": rule(*base, adjustments=[cut("x", "50", to=("b",))], multiplier=units("num_services")),
        "floor": rule(*base, adjustments=[cut("x", "150")]),
    }
    got = price(spark, rules, {"loa_m": "100", "num_services": "2"})
    assert {k: str(r.amount) for k, r in got.items()} == {"additive": "105.00", "group": "105.00", "target": "250.00", "floor": "None"}
    assert [a.id for a in got["group"].adjustments] == ["y"]


def test_gates_come_in_order(spark):
    exempt = [{"description": "small", "when": [test_if("loa_m", "lt", "200")]}]
    rules = {
        "exempt_first": rule(part("fixed", amount="1"), exemptions=exempt, applies_when=[test_if("loa_m", "gt", "500")]),
        "quoted": rule(status="on_application"),
        "elsewhere": rule(status="not_applicable_at_port"),
        "unpriced": rule(part("unpriced", "odd", when=[test_if("loa_m", "eq", "100")]), part("fixed", amount="1")),
        "no_part": rule(part("fixed", amount="1", when=[test_if("loa_m", "gt", "500")])),
    }
    got = price(spark, rules, {"loa_m": "100"})
    assert [got[k].reason for k in rules] == ["Exempt: small", "Quoted on application.", "Not charged at main.", "odd: the document gives no rate for this case.", R.NO_COMPONENT]


def test_totals(spark):
    rows = [(1, "charged", Decimal("1.10"), "EUR", ["a"]), (1, "failed", None, "EUR", None), (2, "failed", None, "EUR", None), (3, "charged", Decimal("2.00"), "USD", ["b"]), (3, "charged", Decimal("1.00"), "EUR", ["b"])]
    items = spark.createDataFrame(rows, "call_id int, status string, amount decimal(18,2), currency string, assumptions array<string>")
    got = {r.call_id: r for r in R.call_totals(items).collect()}
    assert [(str(got[i].total), got[i].status, got[i].currency) for i in (1, 2, 3)] == [("1.10", "partial", "EUR"), ("0.00", "failed", None), ("3.00", "success", None)]
    assert got[3].assumptions == ["b"]


@pytest.mark.parametrize("width", [1, 2])
def test_null_rule_fails(spark, width):
    rows = spark.createDataFrame([(i,) for i in range(width)], "call_id int").withColumn("charge_id", F.lit("x")).withColumn("rule", F.lit(None).cast(RULE))
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    out = R.rate(rows.withColumns({"quantities": F.lit(None).cast("map<string,decimal(20,6)>"), "assumptions": empty, "facts": empty})).collect()
    assert [r.status for r in out] == ["failed"] * width


def test_ceil_and_floor_are_exact(spark):
    def by(rounding):
        return rule(part("per_unit", rate="7", units=units("gross_tonnage", "100000", rounding)))

    got = price(spark, {"up": by("ceil"), "down": by("floor"), "tier": rule(part("tiered", basis="gross_tonnage", tiers=[{"rate": "7", "unit_size": "100000", "rounding": "ceil"}]))}, {"gross_tonnage": "100000.000001"})
    assert {k: str(r.amount) for k, r in got.items()} == {"up": "14.00", "down": "7.00", "tier": "14.00"}
    got = price(spark, {"down": by("floor"), "up": by("ceil")}, {"gross_tonnage": "199999.999999"})
    assert {k: str(r.amount) for k, r in got.items()} == {"down": "7.00", "up": "14.00"}


def test_a_fact_may_be_deducted(spark):
    facts = [{"name": "free", "type": "number", "default_value": "40"}]
    rules = {"less": rule(part("per_unit", rate="1", units=units("loa_m", less="free")), facts=facts)}
    assert str(price(spark, rules, {"loa_m": "100"})["less"].amount) == "60.00"
    assert str(price(spark, rules, {"loa_m": "100"}, {"free": "1 0"})["less"].amount) == "90.00"


def test_assumptions_follow_the_evaluated_path(spark):
    flag = [{"name": "flag", "type": "bool", "description": "Flag flown", "default_value": "no"}]
    several = {"id": "x", "kind": "surcharge", "percent": "10", "applies_to": ["all"], "when": [test_if("num_services", "gt", "1")]}
    bands = [{"lower": "0", "base_fee": "1", "inc_rate": "1", "inc_units": units("time_in_port_hours", "24", "ceil")}]
    rules = {
        "skipped": rule(part("fixed", "a", amount="5"), part("per_unit", "b", rate="1", units=units("num_services"), when=[test_if("loa_m", "gt", "500")])),
        "adjusted": rule(part("fixed", amount="5"), adjustments=[several]),
        "banded": rule(part("banded", basis="loa_m", bands=bands)),
        "not_met": rule(part("fixed", amount="5"), applies_when=[test_if("flag", "eq", "yes"), test_if("num_services", "gt", "1")], facts=flag),
        "either": rule(part("fixed", amount="5"), applies_when=[{"any_of": [test_if("loa_m", "gt", "1")["any_of"][0], test_if("num_services", "gt", "1")["any_of"][0]]}]),
    }
    texts = {"num_services": "two assumed", "time_in_port_hours": "from the window"}
    got = price(spark, rules, {"loa_m": "100", "num_services": "2", "time_in_port_hours": "30"}, assumptions=texts)
    assert {k: r.assumptions for k, r in got.items()} == {"skipped": [], "adjusted": ["two assumed"], "banded": ["from the window"], "not_met": ["Flag flown: assumed no."], "either": []}
    assert got["not_met"].reason == "Not applicable: requires Flag flown = yes"


def test_filters_stay_above_what_rows_are_made_of(spark):
    from ratebook.plans.standins import candidates

    items = R.rate(candidates(spark, "/root/testdata/sf0.001", ["fixed_fee", "no_band", "exempted"]))
    tests = ["status = 'charged'", "amount > 60", "error is not null", "reason like 'Exempt%'", "size(formula) > 1", "size(assumptions) = 0", "currency = 'EUR'"]
    whole = items.collect()
    kept = [
        lambda r: r.status == "charged", lambda r: r.amount is not None and r.amount > 60, lambda r: r.error is not None, lambda r: (r.reason or "").startswith("Exempt"),
        lambda r: r.formula is not None and len(r.formula) > 1, lambda r: r.assumptions is not None and not r.assumptions, lambda r: r.currency == "EUR",
    ]
    for test, keep in zip(tests, kept, strict=True):
        assert items.where(test).count() == sum(map(keep, whole))
