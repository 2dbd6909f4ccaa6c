"""Queries of rule checks, texts of documents, files in and out, and evaluation totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.schemas import RULE
from ..operators import calls as C
from ..operators import corpus as K
from ..operators import facts as FA
from ..operators import quality as Q
from ..operators import rulebook as RB
from ..operators import search as S
from ..operators.rating import prepared
from ..sources import files as IO
from ..streaming import streams as ST
from .corpus_queries import NORMAL_SQL, lines
from .standins import table
from .stream_queries import _scratch

__all__ = ["ORACLES", "QUERIES"]

QUERIES, ORACLES = {}, {}


def query(sql: str):
    """Registers a query by its function's name, with its SQL."""

    def register(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return register


@query("""SELECT count(*) FILTER (o_orderstatus = 'F') AS n_ready FROM orders""")
def ready_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A-6: how many documents are ready."""
    return K.ready_count(table(spark, sf_dir, "orders").select(F.when(F.col("o_orderstatus") == "F", "ready").otherwise("failed").alias("status")))


@query("""WITH i AS (SELECT l_orderkey AS case_id, l_linenumber AS n, CAST(l_extendedprice AS DECIMAL(18,2)) AS computed, CAST(l_extendedprice AS DECIMAL(18,2)) + CASE WHEN l_suppkey % 10 = 0 THEN 1 ELSE 0 END AS amount FROM lineitem),
c AS (SELECT case_id, bool_and(abs((CAST(computed AS DOUBLE) - CAST(amount AS DOUBLE)) * 100 / CAST(amount AS DOUBLE)) <= 0.001) AS items_passed FROM i GROUP BY 1)
SELECT case_id, items_passed, case_id % 6 <> 3 AS total_passed, items_passed AND case_id % 6 <> 3 AS passed FROM c""")
def accuracy_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A-9: a case passes if its items do and its total is the expected one; every third case expects one, half of them another."""
    price = F.col("l_extendedprice").cast("decimal(18,2)")
    expected = (price + F.when(F.col("l_suppkey") % 10 == 0, 1).otherwise(0)).cast("decimal(18,2)")
    items = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("case_id"), price.alias("computed"), expected.alias("amount"), F.lit("0.001").cast("decimal(9,4)").alias("tolerance_pct"))
    total = items.groupBy("case_id").agg(F.sum("computed").alias("total"))
    wrong = F.when(F.col("case_id") % 6 == 3, 1).otherwise(0)
    totals = total.withColumn("expected_total", F.when(F.col("case_id") % 3 == 0, F.col("total") + wrong))
    return Q.case_results(Q.accuracy(items), totals)


@query("""SELECT l_orderkey AS case_id, bool_and(l_returnflag <> 'R' AND (l_linenumber <> 6 OR l_partkey % 2 = 0)) AS agree FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_extendedprice) AS r FROM lineitem) WHERE r = 1 GROUP BY 1""")
def input_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A-9: whether two forms of a case's input come to the same charges and amounts; returned lines differ, and some are missing in one form."""
    w = Window.partitionBy("l_orderkey", "l_linenumber").orderBy("l_partkey", "l_suppkey", "l_extendedprice")
    items = table(spark, sf_dir, "lineitem").withColumn("r", F.row_number().over(w)).where("r = 1")
    price = F.col("l_extendedprice").cast("decimal(18,2)")
    keys = [F.col("l_orderkey").alias("case_id"), F.col("l_linenumber").alias("charge_id")]
    second = items.where("l_linenumber <> 6 or l_partkey % 2 = 0").select(*keys, F.when(F.col("l_returnflag") == "R", price + 1).otherwise(price).cast("decimal(18,2)").alias("amount"))
    return Q.forms_agree(items.select(*keys, price.alias("amount")), second)


@query("""SELECT conv_id, turn, CASE WHEN row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) = 1 THEN '<tariff_excerpt chunk_id="' || turn || '" section="' || role || '" page="' || conv_id || '"' || CASE WHEN turn % 2 = 1 THEN ' printed_page="' || turn || '"' ELSE '' END || '>' || chr(10) || coalesce(text, '') || chr(10) || '</tariff_excerpt>'
ELSE '<tariff_excerpt chunk_id="' || turn || '" section="' || role || '" page="' || conv_id || '">(shown above)</tariff_excerpt>' END AS shown FROM conversations""")
def excerpts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T-13, W-15: excerpts in full the first time that a conversation shows them, then as a reference."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    shown = RB.first_shown(rows, ["conv_id", "role"], "turn")
    printed = F.when(F.col("turn") % 2 == 1, F.col("turn").cast("string"))
    full = T.excerpt(F.col("turn"), F.col("role"), F.col("conv_id"), printed, F.coalesce("text", F.lit("")))
    return shown.select("conv_id", "turn", F.when(F.col("first"), full).otherwise(T.excerpt_again(F.col("turn"), F.col("role"), F.col("conv_id"))).alias("shown"))


@query("""SELECT doc_id, CASE WHEN t <> '' THEN head || ': ' || substr(t, 1, 300) ELSE head END AS line FROM (SELECT doc_id, repeat('  ', CAST(doc_id % 3 AS INTEGER)) || '[' || doc_id || '] ' || lang AS head, trim(regexp_replace(text, '[ \\t\\n\\v\\f\\r]+', ' ', 'g')) AS t FROM documents)""")
def outline_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T-10: sections as an outline shows them, indented, with the opening of their text."""
    docs = table(spark, sf_dir, "documents")
    line = T.outline_line((F.col("doc_id") % 3 + 1).cast("int"), F.col("doc_id").cast("string"), F.col("lang"), F.col("text"))
    return docs.select("doc_id", line.alias("line"))


@query("""SELECT source AS document_id, doc_id AS page, CAST(doc_id % 1000 AS VARCHAR) AS label FROM documents""")
def printed_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T-3: pages' printed numbers, bare in a margin or at the end of a running line."""
    number, first = (F.col("page") % 1000).cast("string"), F.col("line_no") == 1
    own = lines(spark, sf_dir).withColumns({"text": F.when(first & (F.col("page") % 2 == 0), number).when(first, F.concat(F.lit("Tariff book "), number)).otherwise(F.col("text")), "y": F.when(first, 10.0).otherwise(300.0)})
    keyed = own.withColumn("key", T.running_key(F.col("text"), F.col("y") < 72))
    return K.page_labels(keyed, K.running_keys(keyed, share=0.05, least=1))


@query("""SELECT p_partkey, 'Item ' || p_partkey || ' … ' || p_size || CASE WHEN p_size % 2 = 0 THEN ' first' ELSE '' END AS text FROM part""")
def dot_leaders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T-4: leaders of several kinds as one ellipsis, ligatures spelt out."""
    dots = F.when(F.col("p_partkey") % 3 == 0, " ..... ").when(F.col("p_partkey") % 3 == 1, ". . . .").otherwise("……")
    line = F.concat(F.lit("Item "), F.col("p_partkey").cast("string"), dots, F.col("p_size").cast("string"), F.when(F.col("p_size") % 2 == 0, " ﬁrst").otherwise(""))
    return table(spark, sf_dir, "part").select("p_partkey", T.leaders(line).alias("text"))


@query("""SELECT doc_id, md5(coalesce(text, '')) AS body, CAST(ceil((length(lang || ' > ' || source) + 2 + length(coalesce(text, ''))) / 4) AS INTEGER) AS tokens FROM documents""")
def chunk_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T-8: chunks with their breadcrumb, their body without it, and the estimate of their tokens."""
    content = T.chunk_content(F.concat_ws(" > ", "lang", "source"), F.coalesce("text", F.lit("")))
    return table(spark, sf_dir, "documents").select("doc_id", content.alias("content")).select("doc_id", F.md5(T.body_of(F.col("content"))).alias("body"), T.token_estimate(F.col("content")).alias("tokens"))


@query("""SELECT l_orderkey AS query_id, l_linenumber AS rank, l_partkey AS chunk_id, CAST(p_partkey % 40 AS INTEGER) AS page, CAST(p_size AS VARCHAR) AS ref, p_brand || ' ' || p_size AS title FROM lineitem JOIN part ON p_partkey = l_partkey""")
def hit_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J-9: hits with their chunk's page and section."""
    part = table(spark, sf_dir, "part")
    chunks = part.select(F.col("p_partkey").alias("chunk_id"), F.col("p_brand").alias("document_id"), F.col("p_size").cast("int").alias("section_ordinal"), (F.col("p_partkey") % 40).cast("int").alias("page"))
    sections = part.select(F.col("p_brand").alias("document_id"), F.col("p_size").cast("int").alias("ordinal")).distinct().withColumns({"ref": F.col("ordinal").cast("string"), "title": F.concat_ws(" ", "document_id", F.col("ordinal").cast("string"))})
    hits = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("query_id"), F.col("l_linenumber").alias("rank"), F.col("l_partkey").alias("chunk_id"))
    return S.hits_with_sections(hits, chunks, sections).select("query_id", "rank", "chunk_id", "page", "ref", "title")


def part_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(rule_id, charge_id, rule, plan): a rule for each part, of which seven in eight have one fault each, by p_partkey."""
    kind, size = F.col("p_partkey") % 8, F.col("p_size").cast("string")
    fixed = '{"id":"fee","label":"Fee","kind":"fixed","amount":"5"}'
    components = (
        F.when(kind == 1, "[]").when(kind == 3, f"[{fixed},{fixed}]")
        .when(kind == 4, '[{"id":"fee","label":"Fee","kind":"banded","basis":"loa_m","bands":[{"lower":"10","base_fee":"1"},{"lower":"5","base_fee":"2"}]}]').otherwise(f"[{fixed}]")
    )
    maximum = F.when(kind == 2, "1").otherwise("9")
    target = F.when(kind == 5, "other").otherwise("fee")
    values = F.when(kind == 6, F.concat(F.lit('"'), size, F.lit('","7"'))).otherwise(F.concat(F.lit('"'), size, F.lit('"')))
    fact = F.when(kind == 7, "loa_m").otherwise("season")
    json = F.concat(
        F.lit('{"status":"priced","minimum":"2","maximum":"'), maximum, F.lit('","components":'), components, F.lit(',"exemptions":[],"citations":[],"notes":[],"facts":[{"name":"'), fact,
        F.lit('","type":"text"}],"applies_when":[{"any_of":[{"fact":"gross_tonnage","op":"eq","value":['), values,
        F.lit(']},{"fact":"loa_m","op":"lt","value":["9"]}]}],"adjustments":[{"id":"cut","kind":"reduction","percent":"10","applies_to":["'), target, F.lit('"],"when":[{"any_of":[{"fact":"loa_m","op":"gt","value":["50"]}]}]}]}'),
    )
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("rule_id"), F.col("p_partkey").cast("string").alias("charge_id"), F.from_json(json, RULE).alias("rule"))
    return prepared(rows)


@query("""SELECT p_partkey AS rule_id, CASE p_partkey % 8 WHEN 1 THEN 'a priced rule needs a component; an adjustment''s target is unknown' WHEN 2 THEN 'maximum below minimum' WHEN 3 THEN 'component ids repeat' WHEN 4 THEN 'bands don''t ascend' WHEN 5 THEN 'an adjustment''s target is unknown' WHEN 6 THEN 'only `in` takes several values' WHEN 7 THEN 'a fact is named like a quantity' ELSE '' END AS problems FROM part""")
def rule_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V-1, V-2, V-3: what makes each rule inconsistent."""
    return Q.rule_problems(part_rules(spark, sf_dir)).select("rule_id", F.array_join("problems", "; ").alias("problems"))


def part_unit_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(rule_id, charge_id, rule, plan): a rule for each part that counts units in four places, of which one deducts something, by p_partkey."""
    key = F.col("p_partkey")
    less = F.when(key % 6 == 0, "crew").when(key % 6 == 1, "net_tonnage").when(key % 6 == 2, "season").when(key % 6 == 3, "nothing")

    def units(n: int, basis: str, size: Column, rounding: str, above: Column) -> Column:
        deducted = F.when(less.isNotNull() & (key % 4 == n), F.concat(F.lit(',"less":"'), less, F.lit('"'))).otherwise("")
        return F.concat(F.lit(f'{{"basis":"{basis}","unit_size":"'), size, F.lit(f'","rounding":"{rounding}","above":"'), above, F.lit('"'), deducted, F.lit("}"))

    one, size, none = F.lit("1"), F.col("p_size").cast("string"), F.lit("0")
    json = F.concat(
        F.lit('{"status":"priced","exemptions":[],"citations":[],"notes":[],"applies_when":[],"adjustments":[],"facts":[{"name":"crew","type":"number"},{"name":"season","type":"text"}],"multiplier":'), units(0, "num_services", one, "pro_rata", none),
        F.lit(',"components":[{"id":"work","label":"Work","kind":"per_unit","rate":"2","units":'), units(1, "gross_tonnage", size, "ceil", (F.col("p_size") % 3).cast("string")), F.lit(',"per_time":'), units(2, "time_in_port_hours", F.lit("24"), "floor", none),
        F.lit('},{"id":"size","label":"Size","kind":"banded","basis":"loa_m","bands":[{"lower":"0","base_fee":"1","inc_rate":"2","inc_units":'), units(3, "loa_m", F.lit("10"), "ceil", none), F.lit("}]}]}"),
    )
    return prepared(table(spark, sf_dir, "part").select(key.alias("rule_id"), key.cast("string").alias("charge_id"), F.from_json(json, RULE).alias("rule")))


@query("""SELECT p_partkey AS rule_id, CASE WHEN p_partkey % 6 IN (2, 3) THEN 'a subtracted subject is neither a quantity nor a number' ELSE '' END AS problems FROM part""")
def rule_deductions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V-1: what units may deduct: quantities and facts that are numbers, wherever the units stand."""
    return Q.rule_problems(part_unit_rules(spark, sf_dir)).select("rule_id", F.array_join("problems", "; ").alias("problems"))


@query("""WITH p AS (SELECT p_partkey, p_size, p_partkey % 4 AS spot, CASE p_partkey % 6 WHEN 0 THEN 'crew' WHEN 1 THEN 'net_tonnage' WHEN 2 THEN 'season' WHEN 3 THEN 'nothing' END AS less FROM part)
SELECT CAST(p_partkey AS VARCHAR) AS charge_id, place, basis, CAST(coalesce(unit_size, p_size) AS DOUBLE) AS unit_size, rounding, CASE WHEN place = 'component work units' THEN p_size % 3 ELSE 0 END::double AS above, CASE WHEN n = spot THEN less END AS less
FROM p, (VALUES ('multiplier', 'num_services', 1, 'pro_rata', 0), ('component work units', 'gross_tonnage', NULL, 'ceil', 1), ('component work time', 'time_in_port_hours', 24, 'floor', 2), ('component size increment', 'loa_m', 10, 'ceil', 3)) t(place, basis, unit_size, rounding, n)""")
def rule_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V-4: every unit count of every rule, with what it deducts."""
    return FA.rule_units(part_unit_rules(spark, sf_dir)).withColumns({"unit_size": F.col("unit_size").cast("double"), "above": F.coalesce("above", F.lit(0)).cast("double")})


@query("""SELECT CAST(p_partkey AS VARCHAR) AS charge_id, place, fact, op, CASE WHEN fact = 'gross_tonnage' THEN p_size || CASE WHEN p_partkey % 8 = 6 THEN ', 7' ELSE '' END ELSE v END AS value FROM part, (VALUES ('applies', 'gross_tonnage', 'eq', ''), ('applies', 'loa_m', 'lt', '9'), ('adjustment cut', 'loa_m', 'gt', '50')) t(place, fact, op, v)""")
def rule_conditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V-4: every condition of every rule, alternatives opened."""
    return FA.rule_conditions(part_rules(spark, sf_dir)).select("charge_id", "place", "fact", "op", F.array_join("value", ", ").alias("value"))


@query("""SELECT CAST(p_partkey AS VARCHAR) AS charge_id, fact, CASE fact WHEN 'loa_m' THEN 'adjustment cut when loa_m gt 50; applies when loa_m lt 9' ELSE 'applies when gross_tonnage eq ' || p_size || CASE WHEN p_partkey % 8 = 6 THEN ', 7' ELSE '' END END AS uses FROM part, (VALUES ('loa_m'), ('gross_tonnage')) t(fact)""")
def fact_uses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V-6: how each rule uses each fact, in words."""
    return FA.fact_uses(part_rules(spark, sf_dir))


@query("""SELECT p_partkey, p_partkey % 3 = 0 AND p_size % 2 = 0 AS ok FROM part""")
def table_rereads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T-7, U-2: tables read again replace those before if they are as many and print no number that the page doesn't."""
    size, key = F.col("p_size").cast("string"), F.col("p_partkey")
    page = F.concat(F.lit("Rate "), size, F.lit(" of 900"))
    again = F.concat(F.lit("| "), F.when(F.col("p_size") % 2 == 0, size).otherwise("77777"), F.lit(" |"))
    after = F.when(key % 3 == 0, F.array(again)).when(key % 3 == 1, F.array(again, again)).otherwise(F.array().cast("array<string>"))
    return table(spark, sf_dir, "part").select("p_partkey", Q.table_reread_ok(page, F.array(F.lit("| old |")), after).alias("ok"))


@query("""SELECT c_custkey AS call_id, CASE c_custkey % 3 WHEN 0 THEN c_nationkey * 1000.0 WHEN 1 THEN NULL ELSE c_nationkey + 0.5 END AS gross_tonnage, CASE WHEN c_custkey % 3 = 1 THEN 'gross_tonnage: could not read ''about ' || c_nationkey || '''' ELSE '' END AS warnings FROM customer""")
def numeric_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P-6: numbers as a query says them, and a warning for each that can't be read."""
    nation, kind = F.col("c_nationkey").cast("string"), F.col("c_custkey") % 3
    said = F.when(kind == 0, F.concat(nation, F.lit(",000"))).when(kind == 1, F.concat(F.lit("about "), nation)).otherwise(F.concat(nation, F.lit(".5")))
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("call_id"), said.alias("gross_tonnage"))
    return C.parse_numerics(rows, ["gross_tonnage"]).select("call_id", F.col("gross_tonnage").cast("double").alias("gross_tonnage"), F.array_join("warnings", "; ").alias("warnings"))


@query("""SELECT doc_id, line_no, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS ordinal FROM (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS line_no, unnest(string_split(text, chr(10))) AS line FROM documents) WHERE line <> ''""")
def line_ordinals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W-4: places within a document, counted over what it holds."""
    own = lines(spark, sf_dir).where("text <> ''").select(F.col("page").alias("doc_id"), "line_no")
    return K.with_ordinals(own, "doc_id", "line_no").withColumn("ordinal", F.col("ordinal").cast("long")).withColumn("line_no", F.col("line_no").cast("long"))


@query(f"""WITH c AS (SELECT item_id, 'src' || item_id % 20 AS document_id, text AS quote FROM benchmark)
SELECT c.item_id AS rule_id, min(d.doc_id) AS chunk_id FROM c JOIN documents d ON d.source = c.document_id WHERE contains({NORMAL_SQL.format('d.text')}, {NORMAL_SQL.format('c.quote')}) GROUP BY 1""")
def imported_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """IO-6: imported rules with citations that point at this database's chunks; those whose quotes are lost are left out."""
    chunks = table(spark, sf_dir, "documents").select(F.col("source").alias("document_id"), F.col("doc_id").alias("ordinal"), F.col("doc_id").alias("chunk_id"), F.lit("1").alias("section_ref"), F.col("text").alias("content"))
    shape = '{"status":"priced","components":[{"id":"fee","label":"Fee","kind":"fixed","amount":"5"}],"facts":[],"applies_when":[],"exemptions":[],"adjustments":[],"notes":[]}'
    cite = F.struct(F.col("item_id").alias("chunk_id"), F.lit("1").alias("section_ref"), F.lit(1).alias("page"), F.col("text").alias("quote"))
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("rule_id"), F.concat(F.lit("src"), (F.col("item_id") % 20).cast("string")).alias("document_id"), F.from_json(F.lit(shape), RULE).withField("citations", F.array(cite)).alias("rule"))
    before = items.select("document_id", F.col("rule_id").alias("chunk_id"), F.lit(-1).cast("long").alias("ordinal"))
    return Q.retargeted_rules(items, before, chunks).select("rule_id", F.col("rule.citations")[0]["chunk_id"].alias("chunk_id"))


@query("""SELECT p_brand AS charge_id, CAST(min(p_size) AS DOUBLE) AS minimum, CAST(max(p_size) AS DOUBLE) AS maximum FROM part GROUP BY 1""")
def stored_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """IO-2, IO-4: rules written as JSON, a folder for each charge, and read back."""
    sizes = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("charge_id")).agg(F.min("p_size").cast("string").alias("minimum"), F.max("p_size").cast("string").alias("maximum"))
    rules = sizes.select("charge_id", F.from_json(F.to_json(F.struct("charge_id", "minimum", "maximum")), RULE).alias("rule"))
    path = _scratch(spark, "rules")
    IO.write_rules(rules, path)
    return IO.read_rules(spark, path).select("charge_id", F.col("rule.minimum").cast("double").alias("minimum"), F.col("rule.maximum").cast("double").alias("maximum"))


@query("""SELECT count(DISTINCT source) AS n_files, CAST(sum(octet_length(encode(lang)) + 1) AS BIGINT) AS n_bytes, true AS sound FROM documents""")
def stored_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """IO-3: files of a folder by suffix, as bytes with their checksums."""
    path = _scratch(spark, "binaries")
    docs = table(spark, sf_dir, "documents").select("source", F.col("lang").alias("value"))
    docs.repartition("source").write.partitionBy("source").text(path)
    found = IO.read_binary_documents(spark, path, "txt")
    sound = F.bool_and((F.length("content") == F.col("size")) & (F.length("checksum") == 64)).alias("sound")
    return found.agg(F.count_distinct(F.regexp_extract("path", "source=([^/]+)/", 1)).alias("n_files"), F.sum("size").alias("n_bytes"), sound)


@query("""SELECT o_orderpriority AS port_key, count(*) FILTER (o_orderstatus <> 'P') AS n_results, count(*) FILTER (o_orderstatus = 'P') AS n_failures, CAST(sum(CASE WHEN o_orderstatus <> 'P' THEN CAST(o_totalprice AS DECIMAL(18,2)) END) AS DOUBLE) AS total FROM orders GROUP BY 1""")
def stored_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """IO-8: results and failures appended to one history, by port."""
    orders, path = table(spark, sf_dir, "orders"), _scratch(spark, "history")
    keys = [F.col("o_orderkey").alias("calculation_id"), F.col("o_orderpriority").alias("port_key")]
    results = orders.where("o_orderstatus <> 'P'").select(*keys, F.col("o_totalprice").cast("decimal(18,2)").alias("total"), F.lit(None).cast("string").alias("error_code"))
    failures = orders.where("o_orderstatus = 'P'").select(*keys, F.lit(None).cast("decimal(18,2)").alias("total"), F.lit("PORT_NOT_COVERED").alias("error_code"))
    IO.append_history(results, path)
    IO.append_history(failures, path)
    return spark.read.parquet(path).groupBy("port_key").agg(F.count_if(F.col("error_code").isNull()).alias("n_results"), F.count_if(F.col("error_code").isNotNull()).alias("n_failures"), F.sum("total").cast("double").alias("total"))


@query("""SELECT o_orderstatus AS status, count(*) AS n FROM orders GROUP BY 1""")
def stored_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """IO-9: an evaluation's report as JSON, read back."""
    path = _scratch(spark, "report")
    IO.write_report(table(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count(F.lit(1)).alias("n")), path)
    return spark.read.schema("status string, n long").json(path)


@query("""SELECT DISTINCT sha256(coalesce(text, '')) AS key, 'answer' AS response FROM documents""")
def cached_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST-3: requests as they arrive; what the cache hasn't got is answered once and added."""
    cache, state, arrivals = _scratch(spark, "answers"), _scratch(spark, "answers-state"), _scratch(spark, "requests")

    def answer(misses: DataFrame) -> DataFrame:
        return misses.withColumn("response", F.lit("answer"))

    asked = table(spark, sf_dir, "documents").select("doc_id", F.lit("compile").alias("name"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("key"))
    for wave in (asked.where("doc_id % 3 <> 0"), asked):  # the second wave asks again what the first one has got
        wave.drop("doc_id").write.mode("append").parquet(arrivals)
        ST.cache_stream(spark.readStream.schema("name string, key string").parquet(arrivals), answer, cache, state, once=True).awaitTermination()
    return spark.read.parquet(cache).select("key", "response")
