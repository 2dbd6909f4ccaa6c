"""Queries of calls as they are told, of facts that nobody answered, of catalogues as discovered, and of calculations with their steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.schemas import RULE
from ..operators import calls as C
from ..operators import facts as FA
from ..operators import quality as Q
from ..operators import search as S
from ..operators.shared import scratch
from ..sources import files as IO
from .standins import spread, table

__all__ = ["ORACLES", "QUERIES"]

QUERIES, ORACLES = {}, {}


def query(sql: str):
    """Registers a query by its function's name, with its SQL."""

    def register(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return register




#: Facts of a charge up to which they are taken from a constant list.
_FACTS = 64


def _fact_candidates(spark: SparkSession, sf_dir: str, *by: str) -> DataFrame:
    """Each line of an order is a charge of its call, whose rule declares as many facts as the line's quantity: a0 at a default, the others without; a0 is overridden for every fourth customer. Dealt by columns before facts are made, so that slim rows travel."""
    dealt = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity").repartition("l_orderkey")
    lines = dealt.select(F.col("l_orderkey").alias("call_id"), F.col("l_linenumber").alias("pos"), F.concat_ws("-", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity").alias("charge_id"), F.col("l_quantity").cast("int").alias("n"))
    own = lines.groupBy("call_id", "pos", "charge_id").agg(F.max("n").alias("n"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("call_id"), (F.col("o_custkey") % 4 == 0).alias("asked"))
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    fact = lambda i: F.struct(F.concat(F.lit("a"), i.cast("string")).alias("name"), F.lit("text").alias("type"), F.lit(None).cast("string").alias("description"), F.when(i == 0, "no").alias("default_value"))
    most = F.array(*[fact(F.lit(i)) for i in range(_FACTS)])  # a constant, of which a slice is quicker than facts made for each charge
    facts = F.when(F.col("n").between(1, _FACTS), F.slice(most, 1, F.col("n"))).otherwise(F.transform(F.sequence(F.lit(0), F.col("n") - 1), fact))
    joined = own.join(orders, "call_id").repartition(*by).withColumn("overrides", F.when(F.col("asked"), F.create_map(F.lit("a0"), F.lit("asked"))).otherwise(none))
    return joined.select("call_id", "pos", "charge_id", "overrides", F.from_json(F.lit("{}"), RULE).withField("facts", facts).alias("rule"))


_LINES_SQL = """c AS (SELECT l_orderkey AS call_id, l_linenumber AS pos, concat_ws('-', l_linenumber, l_partkey, l_suppkey, l_quantity) AS charge_id, CAST(max(l_quantity) AS INT) AS n, any_value(o_custkey % 4 = 0) AS asked FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY ALL),
l AS (SELECT *, n - CASE WHEN asked THEN 1 ELSE 0 END AS pending FROM c), k AS (SELECT *, row_number() OVER (PARTITION BY call_id ORDER BY pos, charge_id) AS i FROM l WHERE pending > 0),
b AS (SELECT call_id, charge_id, i, 1 AS batch, pending AS size FROM k WHERE i = 1 UNION ALL
  SELECT k.call_id, k.charge_id, k.i, CASE WHEN b.size + k.pending > 40 THEN b.batch + 1 ELSE b.batch END, CASE WHEN b.size + k.pending > 40 THEN k.pending ELSE b.size + k.pending END FROM b JOIN k ON k.call_id = b.call_id AND k.i = b.i + 1)"""


@query(f"""WITH RECURSIVE {_LINES_SQL}, x AS (SELECT l.*, coalesce((call_id + batch) % 3 = 0, false) AS failed FROM l LEFT JOIN b USING (call_id, charge_id)),
t AS (SELECT call_id, charge_id, 'a0' AS fact, CASE WHEN asked THEN 'asked' WHEN failed THEN NULL WHEN call_id % 2 = 0 THEN 'told' ELSE 'no' END AS value, CASE WHEN asked THEN 'override' WHEN failed THEN NULL WHEN call_id % 2 = 0 THEN 'decision' ELSE 'default' END AS source FROM x
UNION ALL SELECT call_id, charge_id, 'a1', 'yes', 'decision' FROM x WHERE n > 1 AND NOT failed AND call_id % 5 = 0)
SELECT * FROM t WHERE source IS NOT NULL""")
def facts_of_failed_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J-5, W-14: facts where the batches of every third (call + batch) weren't answered: of those only overrides are known."""
    candidates = _fact_candidates(spark, sf_dir, "call_id", "charge_id")
    failed = FA.fact_batches(_fact_candidates(spark, sf_dir, "call_id")).where((F.col("call_id") + F.col("batch")) % 3 == 0)
    said = F.array_compact(F.array(F.when(F.col("call_id") % 2 == 0, F.struct(F.lit("a0").alias("fact"), F.lit("told").alias("value"))), F.when(F.col("call_id") % 5 == 0, F.struct(F.lit("a1").alias("fact"), F.lit("yes").alias("value")))))
    decisions = candidates.select("call_id", "charge_id", F.posexplode(said).alias("pos", "d")).select("call_id", "charge_id", "d.fact", "d.value", "pos")
    return FA.resolve_facts(candidates, decisions, failed)


@query(f"""WITH RECURSIVE {_LINES_SQL} SELECT call_id, batch, count(*) AS n_charges, CAST(sum(pending) AS BIGINT) AS n_facts FROM b JOIN l USING (call_id, charge_id) GROUP BY ALL""")
def pending_fact_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W-14: batches of the facts that no override gives."""
    return FA.fact_batches(_fact_candidates(spark, sf_dir, "call_id")).groupBy("call_id", "batch").agg(F.count(F.lit(1)).alias("n_charges"), F.sum("n_facts").alias("n_facts"))


def _discovered(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Parts as a catalogue of their brand that names three sections each, and the sections there are."""
    part, size = table(spark, sf_dir, "part"), F.col("p_size").cast("string")
    refs = F.array(F.concat(F.lit(" "), size, F.lit(".2.7. ")), F.concat(size, F.lit(".2.9")), F.concat(size, F.lit("x")))
    entries = part.select(F.col("p_brand").alias("document_id"), F.col("p_partkey").alias("pos"), F.concat(F.lit("fee"), (F.col("p_partkey") % 3).cast("string")).alias("charge_id"), refs.alias("section_refs"))
    known = part.select(F.col("p_brand").alias("document_id"), F.when(F.col("p_partkey") % 2 == 0, F.concat(size, F.lit(".2"))).when(F.col("p_partkey") % 7 == 0, F.concat(size, F.lit("x"))).alias("ref")).where("ref is not null")
    return entries, known


_CATALOGUE_SQL = """k AS (SELECT DISTINCT p_brand AS d, CASE WHEN p_partkey % 2 = 0 THEN p_size || '.2' WHEN p_partkey % 7 = 0 THEN p_size || 'x' END AS ref FROM part),
e AS (SELECT p_brand AS d, p_partkey AS pos, 'fee' || p_partkey % 3 AS id, a.ref IS NOT NULL AS two, x.ref IS NOT NULL AS odd, p_size FROM part LEFT JOIN k a ON a.d = p_brand AND a.ref = p_size || '.2' LEFT JOIN k x ON x.d = p_brand AND x.ref = p_size || 'x')"""


@query(f"""WITH {_CATALOGUE_SQL}, n AS (SELECT *, row_number() OVER (PARTITION BY d, id ORDER BY pos) AS r FROM e WHERE two OR odd)
SELECT d AS document_id, pos, id AS asked_id, id || CASE WHEN r > 1 THEN '_' || r ELSE '' END AS charge_id, concat_ws(',', CASE WHEN two THEN p_size || '.2' END, CASE WHEN odd THEN p_size || 'x' END) AS section_refs FROM n""")
def cleaned_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J-13, W-13: discovered entries with sections that exist, once each, and ids of their own; those without sections go."""
    cleaned, _ = Q.clean_catalogue(*_discovered(spark, sf_dir))
    return cleaned.withColumn("section_refs", F.array_join("section_refs", ","))


@query(f"""WITH {_CATALOGUE_SQL} SELECT d AS document_id, pos, id AS charge_id, concat_ws('|', CASE WHEN NOT two THEN ' ' || p_size || '.2.7. ' END, CASE WHEN NOT two THEN p_size || '.2.9' END, CASE WHEN NOT odd THEN p_size || 'x' END) AS refs FROM e WHERE NOT two OR NOT odd""")
def unknown_section_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J-13: the sections that a discovered entry names and the document hasn't got."""
    _, unknown = Q.clean_catalogue(*_discovered(spark, sf_dir))
    return unknown.withColumn("refs", F.array_join("refs", "|"))


@query("""SELECT o_orderkey AS call_id, CASE WHEN c_custkey % 3 = 0 THEN 'profile' ELSE coalesce(CASE WHEN o_orderkey % 2 = 0 THEN 'query' END, NULL) END AS flag, CASE WHEN o_orderkey % 5 = 0 THEN '["a","' || o_orderstatus || '"]' WHEN c_custkey % 3 = 0 AND c_custkey % 2 = 0 THEN 'old' END AS statements
FROM orders JOIN customer ON c_custkey = o_custkey""")
def merged_additional(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P-5: additional fields of two sources: the profile's as a whole, else the query's, and the query's statements."""
    key, c = F.col("o_orderkey"), F.col("o_custkey")
    rows = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer").select("c_custkey"), F.col("o_custkey") == F.col("c_custkey"))
    profiles = rows.select(key.alias("call_id"), F.lit(1).alias("num_services"), F.lit("x").alias("port"), F.when((c % 3 == 0) & (c % 2 == 0), F.create_map(F.lit("flag"), F.lit("profile"), F.lit("statements"), F.lit("old"))).when(c % 3 == 0, F.create_map(F.lit("flag"), F.lit("profile"))).alias("additional"))
    asked = rows.select(key.alias("call_id"), F.lit(1).alias("num_services"), F.lit("x").alias("port"), F.lit("x").alias("request_port"), F.lit(1).alias("request_num_services"), F.when(key % 5 == 0, F.array(F.lit("a"), F.col("o_orderstatus"))).alias("statements"), F.when(key % 2 == 0, F.create_map(F.lit("flag"), F.lit("query"))).alias("additional"))
    merged = C.merge_sources(profiles, asked, ["num_services", "port"])
    return merged.select("call_id", F.try_element_at("additional", F.lit("flag")).alias("flag"), F.try_element_at("additional", F.lit("statements")).alias("statements"))


@query("""SELECT s_suppkey AS call_id, s_name AS name, s_nationkey * 100 + 0.25 AS gross_tonnage FROM supplier""")
def read_profile_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """IO-1, P-1: vessel profiles as JSON files, one for each supplier, read as calls."""
    path = scratch(spark, "profiles")
    tonnage = F.concat((F.col("s_nationkey") * 100).cast("string"), F.lit(".25"))
    profile = F.concat(F.lit('{\n "vessel_metadata": {"name": "'), "s_name", F.lit('"},\n "technical_specs": {"gross_tonnage": '), tonnage, F.lit("}\n}"))
    spread(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("call_id"), profile.alias("value"))).write.partitionBy("call_id").option("mapreduce.fileoutputcommitter.algorithm.version", 2).text(path)  # tasks move their files, not the driver alone
    read = C.canonical(IO.read_profiles(spark, path), "call_id")
    return read.select(F.col("call_id").cast("long").alias("call_id"), "name", F.col("gross_tonnage").cast("double").alias("gross_tonnage"))


@query("""SELECT o_orderkey AS call_id, '{"gross_tonnage":' || o_custkey || CASE WHEN o_orderkey % 3 = 0 THEN ',"port":"' || o_orderstatus || '"' ELSE '' END || '}' || chr(10) || chr(10) || 'Quantities:' || chr(10) || '- gross_tonnage: ' || CASE WHEN o_custkey >= 1000 THEN o_custkey // 1000 || ',' || lpad(CAST(o_custkey % 1000 AS VARCHAR), 3, '0') ELSE CAST(o_custkey AS VARCHAR) END
|| chr(10) || '- passengers: 0' || chr(10) || '- num_services: 2' AS text FROM orders""")
def call_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T-13: calls as they are shown to whoever decides their facts."""
    calls = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("call_id"), F.col("o_custkey").alias("gross_tonnage"), F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderstatus")).alias("port"))
    return C.call_text(C.quantities(calls), ["gross_tonnage", "port"]).select("call_id", "text")


@query("""SELECT o_orderkey AS calculation_id, count(l_orderkey) AS n_steps, coalesce(string_agg(l_linenumber || ':' || CASE WHEN l_linenumber % 2 = 0 THEN 'compute' ELSE 'research' END || ':' || l_returnflag, ' ' ORDER BY l_linenumber, l_returnflag), '') AS steps,
CAST(coalesce(sum(CAST(l_quantity AS BIGINT)), 0) AS BIGINT) AS tokens FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey""")
def calculation_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """IO-8, P-14: step rows appended to the history, and each calculation with its steps in order."""
    path = scratch(spark, "steps")
    lines = table(spark, sf_dir, "lineitem")
    node = F.when(F.col("l_linenumber") % 2 == 0, "compute").otherwise("research")
    number = (F.col("l_linenumber").cast("long") * 100 + F.ascii("l_returnflag")).alias("step_no")
    steps = lines.select(F.col("l_orderkey").alias("calculation_id"), number, F.lit("fee").alias("charge_id"), node.alias("node"), F.struct(F.col("l_linenumber").alias("line"), F.col("l_returnflag").alias("mode")).alias("output"), F.col("l_quantity").cast("long").alias("prompt_tokens"))
    for part in ("l_orderkey % 2 = 0", "l_orderkey % 2 <> 0"):
        IO.append_steps(steps.join(lines.where(part).select(F.col("l_orderkey").alias("calculation_id")).distinct(), "calculation_id", "left_semi"), path)
    told = C.calculations_with_steps(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("calculation_id")), spark.read.parquet(path))
    shown = F.transform("steps", lambda s: F.concat_ws(":", F.get_json_object(s["output"], "$.line"), s["node"], F.get_json_object(s["output"], "$.mode")))
    tokens = F.aggregate("steps", F.lit(0).cast("long"), lambda t, s: t + s["prompt_tokens"])
    return told.select("calculation_id", F.size("steps").cast("long").alias("n_steps"), F.array_join(shown, " ").alias("steps"), tokens.alias("tokens"))


@query("""SELECT 'b' || doc_id // 20 AS document_id, sha256(string_agg(coalesce(text, ''), chr(10) ORDER BY doc_id) || chr(10)) AS checksum, CAST(sum(octet_length(encode(coalesce(text, ''))) + 1) AS BIGINT) AS n_bytes FROM documents GROUP BY 1""")
def stored_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """IO-3, T-11: whole texts as files, twenty documents in each, read as bytes with their checksums."""
    path = scratch(spark, "texts")
    docs = table(spark, sf_dir, "documents").groupBy(F.concat(F.lit("b"), F.floor(F.col("doc_id") / 20).cast("string")).alias("document_id")).agg(F.array_sort(F.collect_list(F.struct("doc_id", F.coalesce("text", F.lit("")).alias("text")))).alias("ds"))
    docs.select("document_id", F.array_join("ds.text", "\n").alias("value")).write.partitionBy("document_id").text(path)
    found = IO.read_binary_documents(spark, path, "txt")
    return found.select(F.regexp_extract("path", "document_id=([^/]+)/", 1).alias("document_id"), "checksum", F.col("size").alias("n_bytes"))


@query("""SELECT p_partkey AS charge_id, pos, p_name AS name FROM part JOIN (VALUES (0, 7), (1, 3), (2, 99), (3, 7)) t(pos, asked) ON p_partkey % 100 = asked""")
def asked_charges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P-10: charges that are asked for by id, in the order of asking, whoever pays for them."""
    catalogue = table(spark, sf_dir, "part").select((F.col("p_partkey") % 100).cast("string").alias("charge_id"), "p_partkey", "p_name")
    return C.routine_charges(catalogue, ["7", "3", "99", "7"]).select(F.col("p_partkey").alias("charge_id"), "pos", F.col("p_name").alias("name"))


@query("""WITH s AS (SELECT p_brand AS document_id, p_partkey AS ordinal, p_size || '.%' || p_partkey % 4 AS ref FROM part WHERE p_partkey % 6 <> 0), k AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY ordinal) AS r, count(*) OVER (PARTITION BY document_id) AS n FROM s WHERE starts_with(ref, '1.%'))
SELECT document_id, ordinal, ref, greatest(n - 2, 0) AS n_more FROM k WHERE r <= 2""")
def outline_of_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P-15: the sections below a ref, taken literally, without contents pages."""
    part = table(spark, sf_dir, "part")
    ref = F.concat(F.col("p_size").cast("string"), F.lit(".%"), (F.col("p_partkey") % 4).cast("string"))
    sections = part.select(F.col("p_brand").alias("document_id"), F.col("p_partkey").alias("ordinal"), ref.alias("ref"), F.col("p_name").alias("title"), F.when(F.col("p_partkey") % 6 == 0, "contents").otherwise("body").alias("kind"))
    return S.outline(sections, "1.%", 2).drop("title")
