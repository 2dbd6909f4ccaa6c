"""How the given tables stand in for calls, rules and documents, and a literal rulebook that the SQL restates."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.schemas import QUANTITY, RULE
from ..operators import calls as C
from ..operators.rating import prepared

__all__ = ["CALLS_SQL", "DOCUMENT", "RULES", "calls", "candidates", "rule_frame", "spread", "table", "values"]

DOCUMENT = "tariff"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """df dealt over all cores where its files give fewer splits than there are cores, as rating a row costs more than moving it.

    It is a matter of layout only: inputs with enough splits aren't shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def values(spark: SparkSession, sql: str) -> DataFrame:
    """A small literal table by a VALUES list that Spark and DuckDB both read."""
    return spark.sql(sql)


#: Calls as SQL: order = call, a tenth of its price = gross tonnage, its lines = services.
CALLS_SQL = """
calls AS (
  SELECT o_orderkey AS call_id, CAST(floor(CAST(o_totalprice AS DECIMAL(18,2)) / 10) AS BIGINT) AS gt,
         CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_custkey * 3 + 100 END AS dwt, o_custkey % 300 + 50 AS loa,
         (o_orderkey % 7 + 1) * 8 AS hours, coalesce(n_lines, 2) AS services, o_orderpriority AS prio, o_orderstatus AS st, o_orderdate AS arrival
  FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n_lines FROM lineitem GROUP BY l_orderkey) ON l_orderkey = o_orderkey
)"""


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """call_id, arrival, departure, quantities, assumptions, and facts of the order's priority and status."""
    orders = spread(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"))
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("num_services"))
    key = F.col("o_orderkey")
    raw = orders.join(lines, F.col("l_orderkey") == key, "left").select(
        key.alias("call_id"),
        F.col("o_orderdate").alias("arrival"),
        (F.col("o_orderdate") + F.make_dt_interval(hours=((key % 7 + 1) * 8).cast("int"))).alias("departure"),
        F.floor(F.col("o_totalprice").cast("decimal(18,2)") / 10).cast(QUANTITY).alias("gross_tonnage"),
        F.when(key % 5 != 0, F.col("o_custkey") * 3 + 100).cast(QUANTITY).alias("deadweight"),
        (F.col("o_custkey") % 300 + 50).cast(QUANTITY).alias("loa_m"),
        "num_services",
        F.create_map(F.lit("priority"), "o_orderpriority", F.lit("status"), "o_orderstatus").alias("facts"),
    )
    return C.quantities(raw).select("call_id", "arrival", "quantities", "assumptions", "facts")


def _units(basis: str, size: str = "1", rounding: str = "pro_rata", above: str | None = None, less: str | None = None) -> dict:
    return {"basis": basis, "unit_size": size, "rounding": rounding, "above": above, "less": less}


def _if(*tests: tuple[str, str, list[str]]) -> dict:
    return {"any_of": [{"fact": f, "op": op, "value": v} for f, op, v in tests]}


def _rule(charge_id: str, components: list[dict], **more) -> dict:
    base = {"charge_id": charge_id, "name": charge_id.replace("_", " "), "section_refs": ["1.1"], "port_key": "main", "currency": "EUR", "payer": "vessel", "status": "priced", "notes": []}
    lists = {"applies_when": [], "exemptions": [], "adjustments": [], "citations": []}
    facts = [{"name": "priority", "type": "text", "default_value": "none"}, {"name": "status", "type": "text"}, {"name": "green", "type": "bool", "default_value": "no"}, {"name": "draught_limit", "type": "number"}]
    return base | lists | {"facts": facts, "components": components} | more


def _part(kind: str, part_id: str = "fee", **more) -> dict:
    return {"id": part_id, "label": part_id.capitalize(), "kind": kind, "when": []} | more


HUNDREDS = _units("gross_tonnage", "100", "ceil")

#: The literal rulebook by charge: the rule, and SQL over the calls CTE for (status, cents).
RULES: dict[str, tuple[dict, str, str]] = {
    "fixed_fee": (_rule("fixed_fee", [_part("fixed", amount="125.50")]), "'charged'", "12550"),
    "per_unit": (_rule("per_unit", [_part("per_unit", rate="118.40", units=HUNDREDS)]), "'charged'", "((gt + 99) // 100) * 11840"),
    "unit_and_time": (
        _rule("unit_and_time", [_part("per_unit", "base", rate="19.25", units=HUNDREDS), _part("per_unit", "stay", rate="5.75", units=HUNDREDS, per_time=_units("time_in_port_hours", "24", "ceil"))]),
        "'charged'", "((gt + 99) // 100) * (1925 + 575 * ((hours + 23) // 24))",
    ),
    "free_period": (_rule("free_period", [_part("per_unit", rate="40", units=_units("time_in_port_hours", "24", "floor", above="24"))]), "CASE WHEN hours < 48 THEN 'not_applicable' ELSE 'charged' END", "CASE WHEN hours >= 48 THEN 4000 * ((hours - 24) // 24) END"),
    "banded": (
        _rule("banded", [_part("banded", basis="gross_tonnage", bands=[
            {"lower": "0", "upper": "10000", "base_fee": "500"},
            {"lower": "10000", "upper": "25000", "base_fee": "1200", "inc_rate": "3.50", "inc_units": _units("gross_tonnage", "1000", "ceil", above="10000")},
            {"lower": "25000", "base_fee": "2500.25"},
        ])]),
        "'charged'", "CASE WHEN gt <= 10000 THEN 50000 WHEN gt <= 25000 THEN 120000 + 350 * ((gt - 10000 + 999) // 1000) ELSE 250025 END",
    ),
    "no_band": (_rule("no_band", [_part("banded", basis="loa_m", bands=[{"lower": "100", "upper": "200", "base_fee": "75"}])]), "CASE WHEN loa BETWEEN 100 AND 200 THEN 'charged' ELSE 'failed' END", "CASE WHEN loa BETWEEN 100 AND 200 THEN 7500 END"),
    "tiered": (
        _rule("tiered", [_part("tiered", basis="gross_tonnage", tiers=[{"up_to": "5000", "rate": "0.10", "unit_size": "1", "rounding": "pro_rata"}, {"width": "15000", "rate": "0.08", "unit_size": "1", "rounding": "pro_rata"}, {"rate": "5", "unit_size": "100", "rounding": "ceil"}])]),
        "'charged'", "10 * least(gt, 5000) + 8 * greatest(least(gt, 20000) - 5000, 0) + 500 * ((greatest(gt - 20000, 0) + 99) // 100)",
    ),
    "bounded_tier": (_rule("bounded_tier", [_part("tiered", basis="loa_m", tiers=[{"up_to": "100", "rate": "2", "unit_size": "10", "rounding": "ceil"}, {"up_to": "250", "rate": "3", "unit_size": "10", "rounding": "floor"}])]), "'charged'", "200 * ((least(loa, 100) + 9) // 10) + 300 * ((greatest(least(loa, 250) - 100, 0)) // 10)"),
    "clamped": (_rule("clamped", [_part("fixed", "base", amount="100"), _part("per_unit", "extra", rate="0.02", units=_units("gross_tonnage"))], minimum="250", maximum="900"), "'charged'", "least(greatest(10000 + 2 * gt, 25000), 90000)"),
    "by_service": (_rule("by_service", [_part("fixed", "base", amount="100.05"), _part("per_unit", "extra", rate="9.85", units=HUNDREDS)], multiplier=_units("num_services")), "'charged'", "(10005 + 985 * ((gt + 99) // 100)) * services"),
    "adjusted": (
        _rule("adjusted", [_part("fixed", "base", amount="200"), _part("per_unit", "extra", rate="1", units=HUNDREDS)], adjustments=[
            {"id": "urgent", "kind": "surcharge", "percent": "25", "applies_to": ["all"], "when": [_if(("priority", "eq", ["1-URGENT"]))]},
            {"id": "open", "kind": "reduction", "percent": "10", "applies_to": ["base"], "when": [_if(("status", "in", ["O", "P"]))]},
        ]),
        "'charged'",
        "20000 + 100 * ((gt + 99) // 100) + CASE WHEN prio = '1-URGENT' THEN 5000 + 25 * ((gt + 99) // 100) ELSE 0 END - CASE WHEN st IN ('O', 'P') THEN 2000 ELSE 0 END",
    ),
    "exclusive": (
        _rule("exclusive", [_part("fixed", "base", amount="400")], adjustments=[
            {"id": "small", "kind": "reduction", "percent": "15", "applies_to": ["all"], "exclusive_group": "g", "when": [_if(("gross_tonnage", "lt", ["20000"]))]},
            {"id": "finished", "kind": "reduction", "percent": "40", "applies_to": ["all"], "exclusive_group": "g", "when": [_if(("status", "eq", ["f"]))]},
            {"id": "tied", "kind": "surcharge", "percent": "40", "applies_to": ["all"], "exclusive_group": "g", "when": [_if(("loa_m", "ge", ["200"]))]},
            {"id": "late", "kind": "surcharge", "percent": "5", "applies_to": ["all"], "when": [_if(("time_in_port_hours", "gt", ["40"]))]},
        ]),
        "'charged'",
        "40000 + CASE WHEN st = 'F' THEN -16000 WHEN loa >= 200 THEN 16000 WHEN gt < 20000 THEN -6000 ELSE 0 END + CASE WHEN hours > 40 THEN 2000 ELSE 0 END",
    ),
    "reduced_away": (_rule("reduced_away", [_part("fixed", amount="50")], adjustments=[{"id": "all_off", "kind": "reduction", "percent": "120", "applies_to": ["all"], "when": [_if(("status", "eq", ["O"]))]}]), "CASE WHEN st = 'O' THEN 'not_applicable' ELSE 'charged' END", "CASE WHEN st <> 'O' THEN 5000 END"),
    "exempted": (
        _rule("exempted", [_part("fixed", amount="60")], exemptions=[{"description": "low priority", "when": [_if(("priority", "eq", ["5-low"])), _if(("status", "eq", ["O"]), ("loa_m", "lt", ["120"]))]}], applies_when=[_if(("gross_tonnage", "ge", ["1000"]))]),
        "CASE WHEN lower(prio) = '5-low' AND (st = 'O' OR loa < 120) OR gt < 1000 THEN 'not_applicable' ELSE 'charged' END",
        "CASE WHEN NOT (lower(prio) = '5-low' AND (st = 'O' OR loa < 120) OR gt < 1000) THEN 6000 END",
    ),
    "conditional_parts": (
        _rule("conditional_parts", [_part("fixed", "wide", amount="10", when=[_if(("loa_m", "gt", ["150"]))]), _part("fixed", "heavy", amount="33.33", when=[_if(("gross_tonnage", "gt", ["30000"])), _if(("green", "eq", ["false"]))])]),
        "CASE WHEN loa > 150 OR gt > 30000 THEN 'charged' ELSE 'not_applicable' END", "CASE WHEN loa > 150 OR gt > 30000 THEN CASE WHEN loa > 150 THEN 1000 ELSE 0 END + CASE WHEN gt > 30000 THEN 3333 ELSE 0 END END",
    ),
    "unpriced_case": (_rule("unpriced_case", [_part("unpriced", "giants", when=[_if(("gross_tonnage", "gt", ["45 000"]))]), _part("per_unit", rate="0.001", units=_units("gross_tonnage"))]), "CASE WHEN gt > 45000 THEN 'not_priced_in_document' WHEN gt < 5 THEN 'not_applicable' ELSE 'charged' END", "CASE WHEN gt BETWEEN 5 AND 45000 THEN (gt + 5) // 10 END"),
    "missing_quantity": (_rule("missing_quantity", [_part("per_unit", rate="2", units=_units("deadweight", "10", "ceil"))]), "CASE WHEN dwt IS NULL THEN 'failed' ELSE 'charged' END", "200 * ((dwt + 9) // 10)"),
    "missing_fact": (
        _rule("missing_fact", [_part("fixed", amount="70")], applies_when=[_if(("loa_m", "lt", ["200"])), _if(("draught_limit", "lt", ["9"]))]),
        "CASE WHEN loa >= 200 THEN 'not_applicable' ELSE 'failed' END", "CAST(NULL AS BIGINT)",
    ),
    "quoted": (_rule("quoted", [], status="on_application"), "'on_application'", "CAST(NULL AS BIGINT)"),
    "unpriced": (_rule("unpriced", [], status="not_priced_in_document", notes=["See the annex."]), "'not_priced_in_document'", "CAST(NULL AS BIGINT)"),
}


def rule_frame(spark: SparkSession, charges: list[str] | None = None) -> DataFrame:
    """(document_id, charge_id, rule, plan) of the literal rulebook, prepared for rating."""
    rows = [(DOCUMENT, c, json.dumps(RULES[c][0])) for c in charges or RULES]
    parsed = spark.createDataFrame(rows, "document_id string, charge_id string, json string").select("document_id", "charge_id", F.from_json("json", RULE).alias("rule"))
    return prepared(parsed)


def candidates(spark: SparkSession, sf_dir: str, charges: list[str] | None = None, by_call: bool = False) -> DataFrame:
    """Calls joined to the rules of their document; the rule side is the literal book, a fixed few rows.

    by_call deals the calls by call_id before they are joined, so that totals by call need no shuffle of the many items.
    """
    own = calls(spark, sf_dir).withColumn("document_id", F.lit(DOCUMENT))
    own = own.repartition("call_id") if by_call else own
    return own.join(F.broadcast(rule_frame(spark, charges)), "document_id").select("call_id", "charge_id", "rule", "plan", "quantities", "assumptions", "facts")
