"""Queries of call preparation, lookups, facts and the rulebook's lifecycle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.numbers import extract_numbers, format_money, format_number, parse_number, round_money
from ..functions.schemas import QUANTITY
from ..operators import calls as C
from ..operators import facts as FA
from ..operators import ports as P
from ..operators import rulebook as RB
from .standins import CALLS_SQL, DOCUMENT, calls, rule_frame, spread, table

__all__ = ["ORACLES", "QUERIES"]

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    """Registers a query by its function's name, with its SQL."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


@query(f"""WITH {CALLS_SQL} SELECT call_id, basis, round(CAST(value AS DOUBLE), 6) AS value, note FROM (
SELECT call_id, 'gross_tonnage' AS basis, gt AS value, '' AS note FROM calls UNION ALL SELECT call_id, 'deadweight', dwt, '' FROM calls WHERE dwt IS NOT NULL UNION ALL SELECT call_id, 'loa_m', loa, '' FROM calls
UNION ALL SELECT call_id, 'passengers', 0, 'No passengers stated; none assumed.' FROM calls
UNION ALL SELECT call_id, 'num_services', services, CASE WHEN call_id NOT IN (SELECT l_orderkey FROM lineitem) THEN '2 marine-service movements assumed (entering and leaving).' ELSE '' END FROM calls
UNION ALL SELECT call_id, 'call_window_days', round(hours / 24.0, 6), '' FROM calls
UNION ALL SELECT call_id, b, CASE b WHEN 'time_in_port_days' THEN round(hours / 24.0, 6) ELSE hours END, 'Time in port taken as the arrival-to-departure window of ' || regexp_replace(regexp_replace(format('{{:.2f}}', round(hours / 24.0, 2)), '0+$', ''), '\\.$', '') || ' days (days alongside not given).' FROM calls, (VALUES ('time_in_port_days'), ('time_in_port_hours')) t(b))""")
def call_quantities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P-7, P-8: every quantity of every call, with the text of what was assumed."""
    flat = calls(spark, sf_dir).select("call_id", F.explode("quantities").alias("basis", "value"), "assumptions")
    return flat.select("call_id", "basis", F.col("value").cast("double").alias("value"), F.coalesce(F.try_element_at("assumptions", F.col("basis")), F.lit("")).alias("note"))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 3 = 1 AND p_partkey % 2 = 0 THEN 'dropped' WHEN p_partkey % 3 = 2 AND p_size > 10 THEN 'dropped' WHEN p_partkey % 4 > 1 THEN 'excluded' WHEN p_size % 5 = 3 THEN 'excluded' WHEN p_size % 5 = 4 AND p_size > 25 THEN 'on_request' ELSE 'candidate' END AS outcome,
CASE WHEN p_partkey % 3 = 1 AND p_partkey % 2 = 0 OR p_partkey % 3 = 2 AND p_size > 10 THEN NULL WHEN p_partkey % 4 = 2 THEN 'Payable by the cargo owner, not the vessel.' WHEN p_partkey % 4 = 3 THEN 'Not a charge on the vessel (a fee for other parties or services).' WHEN p_size % 5 = 3 THEN 'A licence or permit, not a charge on a vessel call.' WHEN p_size % 5 = 4 AND p_size > 25 THEN 'Charged only when requested or after an incident; not included.' END AS reason FROM part""")
def call_screen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P-9: catalogue entries screened in order: asked only, payer, licence, on request."""
    part, charge = table(spark, sf_dir, "part"), F.concat(F.lit("s"), F.col("p_size").cast("string"))
    small = F.transform(F.sequence(F.lit(1), F.lit(10)), lambda n: F.concat(F.lit("s"), n.cast("string")))
    only = F.when(F.col("p_partkey") % 3 == 2, small).when((F.col("p_partkey") % 3 == 1) & (F.col("p_partkey") % 2 == 0), F.array().cast("array<string>"))
    requested = F.transform(F.sequence(F.lit(1), F.lit(25)), lambda n: F.concat(F.lit("s"), n.cast("string")))
    triggers = F.array(*[F.lit(t) for t in ("per_call", "per_service", "per_period", "licence_or_permit", "on_request")])
    entries = part.select("p_partkey", charge.alias("charge_id"), F.get(F.array(*[F.lit(p) for p in ("vessel", "vessel", "cargo", "other")]), (F.col("p_partkey") % 4).cast("int")).alias("payer"), F.get(triggers, (F.col("p_size") % 5).cast("int")).alias("trigger"), only.alias("only"), requested.alias("requested"))
    return C.screen(entries).select("p_partkey", "outcome", "reason")


PORT_DOCUMENTS = """SELECT * FROM (VALUES ('a', DATE '1995-01-01', DATE '1997-06-30', 1, 0), ('b', DATE '1997-01-01', CAST(NULL AS DATE), 2, 0), ('c', CAST(NULL AS DATE), CAST(NULL AS DATE), 0, 1), ('d', DATE '1996-01-01', DATE '1996-12-31', 3, 1)) AS t(document_id, effective_from, effective_to, age, parity)"""


def _port_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that cover the nations of one parity; each port has a numbered alias."""
    nation = table(spark, sf_dir, "nation")
    ports = nation.groupBy((F.col("n_nationkey") % 2).alias("parity")).agg(F.collect_list(F.struct(F.col("n_name").alias("name"), F.array(F.concat(F.lit("Harbour "), F.col("n_nationkey").cast("string"))).alias("aliases"))).alias("ports"))
    return spark.sql(PORT_DOCUMENTS).join(F.broadcast(ports), "parity").select("document_id", F.lit("ready").alias("status"), "effective_from", "effective_to", F.timestamp_seconds(F.col("age") * 1000).alias("created_at"), "ports")


WORDS = "list_sort(list_distinct(list_filter(regexp_extract_all(lower({0}), '[\\p{{L}}\\p{{N}}]+'), lambda w: w NOT IN ('port', 'ports', 'of', 'the', 'harbour', 'harbor'))))"


@query(f"""WITH q AS (SELECT DISTINCT k AS query FROM nation, LATERAL (VALUES ('Port of ' || n_name), ('the harbour ' || n_nationkey), ('NATION'), (n_name || ' East'), ('port')) t(k)),
v AS (SELECT n_name AS port, {WORDS.format('n_name')} AS words, n_nationkey % 2 AS parity FROM nation UNION ALL SELECT n_name, {WORDS.format("'Harbour ' || n_nationkey")}, n_nationkey % 2 FROM nation),
d AS (SELECT document_id, port, words FROM v JOIN ({PORT_DOCUMENTS}) USING (parity)),
m AS (SELECT DISTINCT query, document_id, port, min(CASE WHEN w = words THEN 0 ELSE 1 END) AS kind FROM (SELECT query, {WORDS.format('query')} AS w FROM q) , d
  WHERE len(w) > 0 AND (w = words OR list_has_all(w, words) OR list_has_all(words, w)) GROUP BY ALL),
b AS (SELECT query, document_id, kind, count(*) AS n, min(port) AS port FROM m GROUP BY ALL)
SELECT query, document_id, port FROM b WHERE n = 1 AND kind = (SELECT min(kind) FROM b AS o WHERE o.query = b.query AND o.document_id = b.document_id)""")
def port_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J-2: ports by sets of words: exact beats contained, several match nothing."""
    kinds = F.array(F.concat(F.lit("Port of "), "n_name"), F.concat(F.lit("the harbour "), F.col("n_nationkey").cast("string")), F.lit("NATION"), F.concat("n_name", F.lit(" East")), F.lit("port"))
    asked = table(spark, sf_dir, "nation").select(F.explode(kinds).alias("port"))
    return P.match_ports(asked, P.port_variants(_port_documents(spark, sf_dir)))


@query(f"""WITH c AS (SELECT o_orderkey AS call_id, n_name, n_nationkey % 2 AS parity, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS day, CASE WHEN o_orderkey % 13 = 0 THEN 'a' END AS wanted
  FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey),
m AS (SELECT call_id, d.document_id, row_number() OVER (PARTITION BY call_id ORDER BY age DESC, d.document_id DESC) AS r FROM c JOIN ({PORT_DOCUMENTS}) d ON c.parity = d.parity
  WHERE (day IS NULL OR (coalesce(effective_from <= day, true) AND coalesce(day <= effective_to, true))) AND (wanted IS NULL OR wanted = d.document_id))
SELECT c.call_id, m.document_id, CASE WHEN m.document_id IS NOT NULL THEN n_name END AS matched_port, CASE WHEN m.document_id IS NULL THEN 'PORT_NOT_COVERED' END AS error FROM c LEFT JOIN m ON m.call_id = c.call_id AND r = 1""")
def document_in_force(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J-1, W-2: the newest ready document that covers a call's port on its date."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    named = orders.join(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), F.col("c_nationkey") == F.col("n_nationkey"))
    key = F.col("o_orderkey")
    asked = named.select(key.alias("call_id"), F.concat(F.lit("Port of "), "n_name").alias("port"), F.when(key % 11 != 0, F.to_date("o_orderdate")).alias("on_date"), F.when(key % 13 == 0, "a").alias("document_id"))
    return P.document_in_force(asked, _port_documents(spark, sf_dir)).select("call_id", "document_id", "matched_port", "error")


@query("""SELECT o_orderkey AS call_id, concat_ws('; ', CASE WHEN o_orderkey % 9 = 0 THEN 'gross_tonnage is required' END, CASE WHEN o_orderkey % 9 <> 0 AND o_totalprice <= 100000 THEN 'gross_tonnage must be greater than 0' END, CASE WHEN o_custkey % 6 = 0 THEN 'loa_m must be greater than 0' END,
CASE WHEN o_orderkey % 4 = 0 THEN 'passengers must not be negative' END, CASE WHEN o_orderkey % 10 = 0 THEN 'departure is before arrival' END) AS problems FROM orders""")
def call_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P-4: every problem of a call, none raised."""
    key = F.col("o_orderkey")
    raw = table(spark, sf_dir, "orders").select(
        key.alias("call_id"), F.when(key % 9 != 0, F.col("o_totalprice").cast("decimal(18,2)") - 100000).cast(QUANTITY).alias("gross_tonnage"), (F.col("o_custkey") % 6).cast(QUANTITY).alias("loa_m"),
        F.when(key % 4 == 0, -1).otherwise(3).alias("passengers"), F.col("o_orderdate").alias("arrival"), F.when(key % 10 == 0, F.col("o_orderdate") - F.expr("INTERVAL 1 HOUR")).otherwise(F.col("o_orderdate")).alias("departure"),
    )
    return C.validate(raw).select("call_id", F.array_join("problems", "; ").alias("problems"))


@query("""SELECT event_id, event_type AS name, CAST(user_id AS VARCHAR) AS gross_tonnage, CASE WHEN user_id % 13 = 0 THEN '7.5' ELSE CAST(user_id % 13 AS VARCHAR) END AS draft_m, json_extract_string(props, '$.k') AS k FROM events WHERE event_id % 2 = 0
UNION ALL SELECT event_id, event_type, CAST(user_id AS VARCHAR), '3', NULL FROM events WHERE event_id % 2 = 1""")
def profile_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P-1, P-2, P-3, IO-1: JSON profiles of both shapes as one set of columns."""
    user = F.col("user_id").cast("string")
    sectioned = F.concat(F.lit('{"vessel_metadata":{"name":"'), "event_type", F.lit('"},"technical_specs":{"gross_tonnage":'), user, F.lit(',"draft_sw_s_w_t":[0,'), (F.col("user_id") % 13).cast("string"), F.lit(',7.5]},"operational_data":'), "props", F.lit("}"))
    plain = F.concat(F.lit('{"vessel":{"name":"'), "event_type", F.lit('","gross_tonnage":'), user, F.lit(',"draft_m":3},"call":{}}'))
    profiles = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 2 == 0, sectioned).otherwise(plain).alias("profile"))
    out = C.canonical(profiles, "event_id")
    return out.select("event_id", "name", "gross_tonnage", F.regexp_replace("draft_m", "\\.?0+$", "").alias("draft_m"), F.try_element_at("call_additional", F.lit("k")).alias("k"))


@query("""SELECT coalesce(c, o) AS call_id, coalesce(g1, g2) AS gross_tonnage, coalesce(l1, l2) AS loa_m, coalesce(rp, qp) AS port, coalesce(rs, s1, s2) AS num_services, CASE WHEN coalesce(rp, qp) IS NULL THEN 'PORT_REQUIRED' END AS error FROM
(SELECT c_custkey AS c, CASE WHEN c_custkey % 3 <> 0 THEN c_nationkey END AS g1, CASE WHEN c_custkey % 4 = 0 THEN 12 END AS l1, CASE WHEN c_custkey % 5 = 0 THEN 4 END AS s1 FROM customer) FULL JOIN
(SELECT o_orderkey AS o, o_custkey AS g2, 99 AS l2, CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus END AS qp, CASE WHEN o_orderkey % 7 = 0 THEN 'main' END AS rp, CASE WHEN o_orderkey % 8 = 0 THEN 1 END AS rs, 6 AS s2 FROM orders) ON c = o""")
def call_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P-5: a profile's fields win, the query fills gaps, the request's port and services win over both."""
    c, key = F.col("c_custkey"), F.col("o_orderkey")
    profiles = table(spark, sf_dir, "customer").select(c.alias("call_id"), F.when(c % 3 != 0, F.col("c_nationkey")).alias("gross_tonnage"), F.when(c % 4 == 0, 12).alias("loa_m"), F.when(c % 5 == 0, 4).alias("num_services"), F.lit(None).cast("string").alias("port"))
    asked = table(spark, sf_dir, "orders").select(key.alias("call_id"), F.col("o_custkey").alias("gross_tonnage"), F.lit(99).alias("loa_m"), F.lit(6).alias("num_services"), F.when(key % 2 == 0, F.col("o_orderstatus")).alias("port"), F.when(key % 7 == 0, "main").alias("request_port"), F.when(key % 8 == 0, 1).alias("request_num_services"), F.lit(None).cast("string").alias("statements"))
    return C.merge_sources(profiles, asked, ["gross_tonnage", "loa_m", "num_services", "port"]).select("call_id", "gross_tonnage", "loa_m", "port", "num_services", "error")


@query("""SELECT l_orderkey, l_linenumber, CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS DOUBLE) AS grouped, CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS DOUBLE) AS european, CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS DOUBLE) AS spaced, CAST(l_quantity AS DOUBLE) AS percent, CAST(NULL AS DOUBLE) AS words, l_quantity * 1000.0 AS thousands FROM lineitem""")
def parse_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """N-1, P-6: printed numbers of several styles read back."""
    price, q = F.format_number(F.col("l_extendedprice").cast("decimal(18,2)"), 2), F.col("l_quantity").cast("int").cast("string")
    forms = {"grouped": price, "european": F.translate(price, ",.", ".,"), "spaced": F.replace(price, F.lit(","), F.lit(" ")), "percent": F.concat(q, F.lit(" %")), "words": F.concat(q, F.lit(" tons")), "thousands": F.concat(q, F.lit(",000"))}
    return spread(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity")).select("l_orderkey", "l_linenumber", *[parse_number(v).cast("double").alias(k) for k, v in forms.items()])


@query("""SELECT l_orderkey, l_linenumber, v AS value FROM (SELECT l_orderkey, l_linenumber, unnest(list_distinct([CAST(l_quantity AS DOUBLE), l_quantity * 1000.0, 0.0, 0.75, 20.0, 4.0, 24.0, 5.0, 2.0, 100.0, 200.0])) AS v FROM lineitem)""")
def extract_all_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """N-2, N-3: every reading of spaced digits, and numbers in words."""
    text = F.concat(F.lit("Up to "), F.col("l_quantity").cast("int").cast("string"), F.lit(" 000 units at 0.75\ntwenty-four hours, the fifth day, two hundred"))
    return spread(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")).select("l_orderkey", "l_linenumber", F.explode(extract_numbers(text)).alias("v")).select("l_orderkey", "l_linenumber", F.col("v").cast("double").alias("value"))


@query("""SELECT o_orderkey, format('{:,.2f}', cents / 100.0) AS money, CASE WHEN cents % 100 = 0 THEN format('{:,}', cents // 100) WHEN cents % 10 = 0 THEN format('{:,.1f}', cents / 100.0) ELSE format('{:,.2f}', cents / 100.0) END AS plain,
CAST((cents * 25 + 50) // 100 AS DOUBLE) / 100 AS quarter FROM (SELECT o_orderkey, CAST(CAST(o_totalprice AS DECIMAL(18,2)) * 100 AS BIGINT) AS cents FROM orders)""")
def money_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """N-4, N-5, N-6: half-up rounding and printing of amounts."""
    price = F.col("o_totalprice").cast("decimal(18,2)")
    return table(spark, sf_dir, "orders").select("o_orderkey", format_money(price).alias("money"), format_number(price).alias("plain"), round_money((price * F.lit("0.25").cast("decimal(4,2)")).cast("decimal(20,4)")).cast("double").alias("quarter"))


@query("""SELECT o_orderkey AS calculation_id, o_orderstatus AS status, n_total FROM (SELECT *, count(*) OVER () AS n_total FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '2-HIGH') ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 25 OFFSET 50""")
def calculation_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P-14: a page of a filtered history, newest first, with the total."""
    history = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("calculation_id"), F.col("o_orderpriority").alias("port_key"), F.col("o_orderstatus").alias("status"), F.col("o_orderdate").alias("created_at"))
    return C.listing(history, "2-HIGH", "F", 25, 50).select("calculation_id", "status", "n_total")


@query("""SELECT p_partkey, p_brand FROM part WHERE p_partkey % 4 < 2 AND p_size % 5 < 3""")
def routine_charges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P-10: the vessel's routine charges of a catalogue."""
    triggers = F.array(*[F.lit(t) for t in ("per_call", "per_service", "per_period", "licence_or_permit", "on_request")])
    entries = table(spark, sf_dir, "part").select("p_partkey", "p_brand", F.when(F.col("p_partkey") % 4 < 2, "vessel").otherwise("cargo").alias("payer"), F.get(triggers, (F.col("p_size") % 5).cast("int")).alias("trigger"))
    return C.routine_charges(entries).select("p_partkey", "p_brand")


@query("""SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN NULL ELSE upper(substr(c_mktsegment, 1, 3)) END AS currency, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE (c_nationkey + 0.5) / 100 END AS vat_rate FROM customer""")
def document_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P-18: currency codes and tax rates as documents print them."""
    c = F.col("c_custkey")
    code = F.when(c % 10 == 0, "").otherwise(F.lower("c_mktsegment"))
    rate = F.when(c % 3 == 0, "n/a").otherwise(F.concat(F.col("c_nationkey").cast("string"), F.lit(",5 %")))
    return C.document_fields(table(spark, sf_dir, "customer"), code, rate).select("c_custkey", "currency", F.col("vat_rate").cast("double").alias("vat_rate"))


@query("""SELECT o_orderkey AS call_id, fact, value, source FROM orders, LATERAL (VALUES
 ('priority', coalesce(CASE WHEN o_custkey % 4 = 0 THEN 'asked' END, CASE WHEN o_orderkey % 3 = 0 THEN 'second' WHEN o_orderkey % 2 = 0 THEN 'first' END, 'none'), CASE WHEN o_custkey % 4 = 0 THEN 'override' WHEN o_orderkey % 3 = 0 OR o_orderkey % 2 = 0 THEN 'decision' ELSE 'default' END),
 ('green', 'no', 'default'), ('status', CASE WHEN o_orderkey % 5 = 0 THEN o_orderstatus END, CASE WHEN o_orderkey % 5 = 0 THEN 'decision' END)) t(fact, value, source) WHERE source IS NOT NULL""")
def fact_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J-5: override, decision (the last one), default; others are absent."""
    orders, key = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    overrides = F.when(F.col("o_custkey") % 4 == 0, F.create_map(F.lit("priority"), F.lit("asked"))).otherwise(F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")))
    book = rule_frame(spark, ["fixed_fee"]).select("document_id", "charge_id", "rule")
    wanted = orders.select(key.alias("call_id"), overrides.alias("overrides"), F.lit(DOCUMENT).alias("document_id")).join(F.broadcast(book), "document_id")
    said = F.array_compact(F.array(
        F.when(key % 2 == 0, F.struct(F.lit("priority").alias("fact"), F.lit("first").alias("value"), F.lit(1).alias("pos"))),
        F.when(key % 3 == 0, F.struct(F.lit("priority").alias("fact"), F.lit("second").alias("value"), F.lit(2).alias("pos"))),
        F.when(key % 5 == 0, F.struct(F.lit("status").alias("fact"), F.col("o_orderstatus").alias("value"), F.lit(3).alias("pos"))),
        F.struct(F.lit("unheard_of").alias("fact"), F.lit("x").alias("value"), F.lit(4).alias("pos")),
    ))
    decisions = orders.select(key.alias("call_id"), F.lit("fixed_fee").alias("charge_id"), F.explode(said).alias("d")).select("call_id", "charge_id", "d.*")
    return FA.resolve_facts(wanted, decisions).select("call_id", "fact", "value", "source")


@query("""WITH RECURSIVE l AS (SELECT l_orderkey AS call_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, concat_ws('-', l_partkey, l_suppkey, l_linenumber), l_quantity) AS i, CAST(l_quantity AS INT) AS n FROM lineitem),
b AS (SELECT call_id, i, 1 AS batch, n AS size FROM l WHERE i = 1 UNION ALL SELECT l.call_id, l.i, CASE WHEN b.size > 0 AND b.size + l.n > 40 THEN b.batch + 1 ELSE b.batch END, CASE WHEN b.size > 0 AND b.size + l.n > 40 THEN l.n ELSE b.size + l.n END FROM b JOIN l ON l.call_id = b.call_id AND l.i = b.i + 1)
SELECT call_id, batch, count(*) AS n FROM b GROUP BY ALL""")
def fact_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W-14: rules packed greedily into batches of 40 facts, each rule whole."""
    rules = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("call_id"), F.concat_ws("-", "l_partkey", "l_suppkey", "l_linenumber").alias("charge_id"), F.col("l_linenumber").alias("pos"), F.col("l_quantity").cast("int").alias("n_facts"))
    return FA.batch_rules(rules).groupBy("call_id", "batch").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT rule_id, document_id, port_key, charge_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY document_id, port_key, charge_id ORDER BY rank DESC, rule_id DESC) AS r FROM (
SELECT o_orderkey AS rule_id, CAST(o_custkey % 10 AS VARCHAR) AS document_id, o_orderpriority AS port_key, CAST(o_orderkey % 20 AS VARCHAR) AS charge_id, CASE WHEN o_orderkey % 7 <> 0 AND o_orderstatus = 'F' THEN 3 WHEN o_orderkey % 7 <> 0 THEN 2 WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS rank FROM orders WHERE o_orderkey % 9 <> 0) WHERE rank > 0) WHERE r = 1""")
def rules_in_use(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W-1, S-2: the preferred rule of each document, port and charge."""
    key = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(key.alias("rule_id"), (F.col("o_custkey") % 10).cast("string").alias("document_id"), F.col("o_orderpriority").alias("port_key"), (key % 20).cast("string").alias("charge_id"), F.when(key % 9 == 0, 1).otherwise(2).alias("schema_version"), F.col("o_orderstatus").alias("prompt_version"), F.when(key % 7 != 0, F.struct(key.alias("x"))).alias("rule"))
    return RB.rules_in_use(rows, "F", 2).select("rule_id", "document_id", "port_key", "charge_id", "rank")


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN n IS NULL THEN 'no rule compiled' WHEN n = 0 THEN 'compilation failed' END AS error FROM lineitem LEFT JOIN (SELECT p_partkey, CASE WHEN p_size > 25 THEN 1 ELSE 0 END AS n FROM part WHERE p_partkey % 3 <> 0) ON p_partkey = l_partkey""")
def candidate_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J-3, J-4: candidates joined to the rules in use, with why there is none."""
    rules = table(spark, sf_dir, "part").where("p_partkey % 3 <> 0").select(F.lit("d").alias("document_id"), F.lit("p").alias("port_key"), F.col("p_partkey").alias("charge_id"), F.when(F.col("p_size") > 25, F.struct("p_size")).alias("rule"))
    wanted = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.lit("d").alias("document_id"), F.lit("p").alias("port_key"), F.col("l_partkey").alias("charge_id"))
    return RB.candidates_with_rules(wanted, rules).select("l_orderkey", "l_linenumber", "error")


@query("""SELECT DISTINCT l_suppkey AS charge_id FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0)""")
def unknown_charges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """U-1, J-3: asked ids that aren't known."""
    return RB.unknown_ids(table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("charge_id")), table(spark, sf_dir, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("charge_id")))


@query("""WITH r AS (SELECT doc_id, sha256(coalesce(text, '')) AS key, lang FROM documents), c AS (SELECT DISTINCT key FROM r WHERE doc_id % 2 = 0 AND lang <> 'fr')
SELECT 'hit' AS kind, key, count(*) AS n FROM r SEMI JOIN c USING (key) WHERE lang <> 'de' GROUP BY ALL UNION ALL SELECT 'miss', key, 1 FROM (SELECT DISTINCT key FROM r ANTI JOIN c USING (key) WHERE lang <> 'de')""")
def cache_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J-12, T-11, ST-3: requests by content hash: hits are answered, each miss once."""
    asked = table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("name"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("key"))
    cache = asked.where("doc_id % 2 = 0 AND name <> 'fr'").select("key").distinct().withColumn("response", F.lit("r"))
    hits, misses = RB.cache_lookup(asked, cache, ["en", "fr", "es"])
    return hits.groupBy("key").agg(F.count(F.lit(1)).alias("n")).select(F.lit("hit").alias("kind"), "key", "n").union(misses.select(F.lit("miss").alias("kind"), "key", F.lit(1).cast("long").alias("n")))


@query("""WITH a AS (SELECT l_orderkey AS charge_id, l_linenumber AS attempt, l_quantity > 10 AS grounded, CASE WHEN l_returnflag <> 'N' THEN CAST(l_suppkey % 3 AS INT) END AS n FROM lineitem),
b AS (SELECT charge_id, min(n * 1000 + attempt) FILTER (grounded AND n IS NOT NULL) AS best, max(attempt) FILTER (grounded) AS last FROM a GROUP BY 1)
SELECT charge_id, CASE WHEN best IS NOT NULL THEN best % 1000 ELSE last END AS attempt, CASE WHEN best // 1000 = 0 THEN 'approved' WHEN last IS NOT NULL THEN 'low_confidence' ELSE 'failed' END AS outcome FROM b""")
def best_revision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A-10, P-12: the revision of a rule that is kept."""
    attempts = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("charge_id"), F.col("l_linenumber").alias("attempt"), (F.col("l_quantity") > 10).alias("grounded"), F.when(F.col("l_returnflag") != "N", (F.col("l_suppkey") % 3).cast("int")).alias("n_blocking"))
    return RB.best_revision(attempts)


@query("""SELECT o_orderstatus AS status, count(*) AS n, count(*) FILTER (o_orderkey % 3 <> 0) AS n_fresh, CAST(sum(o_custkey) AS BIGINT) AS tokens FROM orders GROUP BY 1""")
def compile_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A-3, A-4: outcomes by status."""
    return RB.compile_report(table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("status"), (F.col("o_orderkey") % 3 == 0).alias("cached"), F.col("o_custkey").alias("tokens")))


@query("""SELECT p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_size, p_partkey % 7, p_partkey) AS pos FROM part""")
def section_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S-1: each rulebook's charges in section order: "10.2" after "9.10"."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand", _part_section().alias("k"))
    return part.select("p_partkey", F.row_number().over(Window.partitionBy("p_brand").orderBy("k", "p_partkey")).alias("pos"))


@query("""SELECT p_partkey, row_number() OVER (ORDER BY p_size, p_partkey % 7, p_partkey) AS pos FROM part""")
def section_sorted_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S-1: the charges of all sections in section order."""
    return _section_positions(table(spark, sf_dir, "part"))


def _section_positions(part: DataFrame) -> DataFrame:
    return RB.numbered(part.select("p_partkey", _part_section().alias("k")), "k", "p_partkey").select("p_partkey", "pos")


def _part_section() -> Column:
    return RB.section_order(F.array(F.concat_ws(".", F.col("p_size").cast("string"), (F.col("p_partkey") % 7).cast("string"))))


@query("""SELECT s_nationkey, s_suppkey, CASE WHEN r = 1 THEN id ELSE id || '_' || r END AS unique_id FROM (SELECT *, row_number() OVER (PARTITION BY s_nationkey, id ORDER BY s_suppkey) AS r FROM (SELECT s_nationkey, s_suppkey, 'c' || s_suppkey % 2 AS id FROM supplier))""")
def unique_charge_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W-13: repeated ids of a catalogue get suffixes."""
    rows = table(spark, sf_dir, "supplier").select("s_nationkey", "s_suppkey", F.concat(F.lit("c"), (F.col("s_suppkey") % 2).cast("string")).alias("charge_id"))
    return RB.unique_ids(rows, "s_nationkey", "s_suppkey").select("s_nationkey", "s_suppkey", "unique_id")


@query("""SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) = 1 AS first FROM conversations""")
def first_showing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W-15: what a conversation shows for the first time."""
    return RB.first_shown(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role"), ["conv_id", "role"], "turn")


@query("""SELECT o_custkey AS document_id, o_orderkey, 'old' AS version FROM orders WHERE o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') UNION ALL SELECT o_custkey, o_orderkey, 'new' FROM orders WHERE o_orderstatus = 'P'""")
def rebuild_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """U-3, U-4: a document's rows are dropped, then inserted anew."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("document_id"), "o_orderkey", "o_orderstatus")
    fresh = rows.where("o_orderstatus = 'P'").select("document_id", "o_orderkey", F.lit("new").alias("version"))
    return RB.rebuild(rows.select("document_id", "o_orderkey", F.lit("old").alias("version")), fresh)


@query("""WITH f AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 0 ELSE 1 END AS format, CASE WHEN doc_id % 7 = 0 THEN 1 ELSE 2 END AS sv, lang, source FROM documents)
SELECT doc_id, CASE WHEN format <> 1 THEN 'format' WHEN sv <> 2 THEN 'schema' WHEN lang <> 'en' THEN 'prompts' WHEN doc_id % 3 = 0 OR doc_id % 4 = 0 THEN 'document' WHEN doc_id % 11 = 0 THEN 'has_rules' END AS reason FROM f""")
def import_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """IO-6: why rulebook files are skipped, by the first objection."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    key = F.col("doc_id")
    files = docs.select("doc_id", key.alias("checksum"), F.when(key % 5 == 0, 0).otherwise(1).alias("format"), F.when(key % 7 == 0, 1).otherwise(2).alias("schema_version"), F.col("lang").alias("prompt_version"))
    known = docs.where("doc_id % 3 <> 0").select(key.alias("checksum"), key.alias("document_id"), F.when(key % 4 == 0, "failed").otherwise("ready").alias("status"))
    loaded = docs.where("doc_id % 11 = 0").select(key.alias("document_id"))
    return RB.import_decisions(files, known, loaded, 1, 2, "en", False).select("doc_id", "reason")
