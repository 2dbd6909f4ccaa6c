"""Rating queries: one for each pricing mechanic over all orders, all charges together, and totals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import rating as R
from .standins import CALLS_SQL, RULES, calls, candidates, rule_frame, table

__all__ = ["ORACLES", "QUERIES"]


def _items(spark: SparkSession, sf_dir: str, charges: list[str] | None = None) -> DataFrame:
    return R.rate(candidates(spark, sf_dir, charges))


def _mechanic(charge: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _items(spark, sf_dir, [charge]).select("call_id", "status", F.col("amount").cast("double").alias("amount"))

    query.__doc__ = f"The charge {charge} for every call."
    return query


def _one(charge: str) -> str:
    _, status, cents = RULES[charge]
    return f"SELECT call_id, '{charge}' AS charge_id, {status} AS status, {cents} AS cents FROM calls"


ALL_SQL = f"WITH {CALLS_SQL}, items AS ({' UNION ALL '.join(_one(c) for c in RULES)})"


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _items(spark, sf_dir).select("call_id", "charge_id", "status", F.col("amount").cast("double").alias("amount"))


def totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = R.call_totals(R.rate(candidates(spark, sf_dir, by_call=True)))
    return out.select("call_id", F.col("total").cast("double").alias("total"), "n_charged", "n_not_applicable", "n_on_application", "n_not_priced_in_document", "n_failed", "currency", "status")


TOTALS_SQL = f"""{ALL_SQL}
SELECT call_id, coalesce(sum(cents), 0) / 100.0 AS total, count(*) FILTER (status = 'charged') AS n_charged, count(*) FILTER (status = 'not_applicable') AS n_not_applicable,
       count(*) FILTER (status = 'on_application') AS n_on_application, count(*) FILTER (status = 'not_priced_in_document') AS n_not_priced_in_document, count(*) FILTER (status = 'failed') AS n_failed,
       'EUR' AS currency, CASE WHEN count(*) FILTER (status = 'failed') = 0 THEN 'success' ELSE 'partial' END AS status
FROM items GROUP BY call_id"""


def reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why charges aren't priced, in words, and how often."""
    return _items(spark, sf_dir, ["exempted", "conditional_parts", "unpriced_case", "quoted", "unpriced", "missing_quantity", "missing_fact", "reduced_away"]).groupBy("charge_id", "status", F.coalesce("reason", "error").alias("why")).agg(F.count(F.lit(1)).alias("n"))


REASONS_SQL = f"""WITH {CALLS_SQL}, w AS (
  SELECT 'exempted' AS charge_id, CASE WHEN lower(prio) = '5-low' AND (st = 'O' OR loa < 120) THEN 'Exempt: low priority' WHEN gt < 1000 THEN 'Not applicable: requires gross_tonnage ≥ 1000' END AS why, 'not_applicable' AS s FROM calls
  UNION ALL SELECT 'conditional_parts', CASE WHEN NOT (loa > 150 OR gt > 30000) THEN 'No pricing component of this charge applies to the vessel call' END, 'not_applicable' FROM calls
  UNION ALL SELECT 'unpriced_case', CASE WHEN gt > 45000 THEN 'Giants: the document gives no rate for this case.' WHEN gt < 5 THEN 'Computes to zero for this call.' END, CASE WHEN gt > 45000 THEN 'not_priced_in_document' ELSE 'not_applicable' END FROM calls
  UNION ALL SELECT 'quoted', 'Quoted on application.', 'on_application' FROM calls
  UNION ALL SELECT 'unpriced', 'See the annex.', 'not_priced_in_document' FROM calls
  UNION ALL SELECT 'missing_quantity', CASE WHEN dwt IS NULL THEN 'no value for quantity deadweight' END, 'failed' FROM calls
  UNION ALL SELECT 'missing_fact', CASE WHEN loa >= 200 THEN 'Not applicable: requires loa_m < 200' ELSE 'no value for draught_limit' END, CASE WHEN loa >= 200 THEN 'not_applicable' ELSE 'failed' END FROM calls
  UNION ALL SELECT 'reduced_away', CASE WHEN st = 'O' THEN 'Computes to zero for this call.' END, 'not_applicable' FROM calls
) SELECT charge_id, CASE WHEN why IS NULL THEN 'charged' ELSE s END AS status, why, count(*) AS n FROM w GROUP BY ALL"""


def traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The formula and the assumptions of one charge, as text."""
    return _items(spark, sf_dir, ["by_service"]).select("call_id", F.array_join("formula", "; ").alias("formula"), F.array_join("assumptions", "; ").alias("assumptions"))


def _grouped(cents: str) -> str:
    """SQL that prints whole cents as an amount: grouped, without trailing zeros."""
    return f"regexp_replace(format('{{{{:,}}}}', ({cents}) // 100) || '.' || lpad(CAST(({cents}) % 100 AS VARCHAR), 2, '0'), '\\.00$|(\\.[0-9])0$', '\\1')".replace("{{:,}}", "{:,}")


TRACES_SQL = f"""WITH {CALLS_SQL}, f AS (SELECT *, (gt + 99) // 100 AS u FROM calls), g AS (SELECT *, u * 985 AS p, 10005 + 985 * u AS c, (10005 + 985 * u) * services AS t FROM f)
SELECT call_id, 'Base: 100.05; Extra: ' || {_grouped('u * 100')} || ' × 9.85 = ' || {_grouped('p')} || '; Subtotal: ' || {_grouped('c')} || '; × ' || services || ' (num_services) = ' || {_grouped('t')}
  || '; Amount (rounded to cents): ' || format('{{:,}}', t // 100) || '.' || lpad(CAST(t % 100 AS VARCHAR), 2, '0') AS formula,
  CASE WHEN call_id NOT IN (SELECT l_orderkey FROM lineitem) THEN '2 marine-service movements assumed (entering and leaving).' ELSE '' END AS assumptions
FROM g"""


def applied_adjustments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every adjustment that was applied, by exclusive groups, with its amount."""
    own = _items(spark, sf_dir, ["exclusive"]).select("call_id", F.explode("adjustments").alias("a"))
    return own.select("call_id", F.col("a.id").alias("adjustment"), F.col("a.amount").cast("double").alias("amount"))


ADJUSTMENTS_SQL = f"""WITH {CALLS_SQL}
SELECT call_id, CASE WHEN st = 'F' THEN 'finished' WHEN loa >= 200 THEN 'tied' ELSE 'small' END AS adjustment, CASE WHEN st = 'F' THEN -160.0 WHEN loa >= 200 THEN 160.0 ELSE -60.0 END AS amount
FROM calls WHERE st = 'F' OR loa >= 200 OR gt < 20000
UNION ALL SELECT call_id, 'late', 20.0 FROM calls WHERE hours > 40"""


def grand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Charged totals by charge and order status over all calls."""
    items = R.rate(candidates(spark, sf_dir))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("call_id"), "o_orderstatus")
    out = R.grand_total(items.join(orders, "call_id"), ["charge_id", "o_orderstatus"])
    return out.select("charge_id", "o_orderstatus", F.col("total").cast("double").alias("total"), "n_items")


GRAND_SQL = f"""{ALL_SQL} SELECT charge_id, o_orderstatus, sum(cents) / 100.0 AS total, count(*) AS n_items
FROM items JOIN orders ON o_orderkey = call_id WHERE status = 'charged' GROUP BY ALL"""


def sensitivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every rule priced for the call of the dearest order, facts at their defaults."""
    call = calls(spark, sf_dir).orderBy(F.element_at("quantities", "gross_tonnage").desc(), "call_id").limit(1)
    return R.sensitivity(rule_frame(spark, ["fixed_fee", "per_unit", "tiered", "banded", "clamped", "by_service"]), call.drop("facts", "arrival")).select("call_id", "charge_id", "status", F.col("amount").cast("double").alias("amount"))


SENSITIVITY_SQL = f"""WITH {CALLS_SQL}, c AS (SELECT * FROM calls ORDER BY gt DESC, call_id LIMIT 1)
SELECT call_id, charge_id, status, cents / 100.0 AS amount FROM ({' UNION ALL '.join(_one(c).replace('FROM calls', 'FROM c') for c in ["fixed_fee", "per_unit", "tiered", "banded", "clamped", "by_service"])})"""

QUERIES = {f"rate_{c}": _mechanic(c) for c in RULES} | {
    "rate_orders_items": items,
    "rate_orders_total": totals,
    "rate_reasons": reasons,
    "rate_traces": traces,
    "rate_applied_adjustments": applied_adjustments,
    "rate_grand_total": grand,
    "rate_sensitivity": sensitivity,
}
ORACLES = {f"rate_{c}": f"WITH {CALLS_SQL} SELECT call_id, status, cents / 100.0 AS amount FROM ({_one(c)})" for c in RULES} | {
    "rate_orders_items": f"{ALL_SQL} SELECT call_id, charge_id, status, cents / 100.0 AS amount FROM items",
    "rate_orders_total": TOTALS_SQL,
    "rate_reasons": REASONS_SQL,
    "rate_traces": TRACES_SQL,
    "rate_applied_adjustments": ADJUSTMENTS_SQL,
    "rate_grand_total": GRAND_SQL,
    "rate_sensitivity": SENSITIVITY_SQL,
}
