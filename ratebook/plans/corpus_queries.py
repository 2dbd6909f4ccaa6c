"""Queries of the corpus, of retrieval and of quality gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.schemas import RATE
from ..operators import corpus as K
from ..operators import quality as Q
from ..operators import quotes as QU
from ..operators import rulebook as RB
from ..operators import search as S
from ..operators.shared import held
from .standins import RULES, rule_frame, table

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


LINES_SQL = """lines AS (SELECT source AS document_id, doc_id AS page, generate_subscripts(string_split(text, chr(10)), 1) AS line_no, unnest(string_split(text, chr(10))) AS line FROM documents)"""
KEY_SQL = "trim(regexp_replace(replace(lower(line), 'ß', 'ss'), '\\s+', ' ', 'g'))"


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as pages of lines: document = source, page = doc_id, with plain typography."""
    docs = table(spark, sf_dir, "documents").select(F.col("source").alias("document_id"), F.col("doc_id").alias("page"), F.posexplode(F.split("text", "\n", -1)).alias("i", "text"))
    return docs.select("document_id", "page", (F.col("i") + 1).alias("line_no"), "text", F.lit(10.0).alias("size"), F.lit(False).alias("bold"), F.lit(300.0).alias("y"), F.lit(600.0).alias("page_height"), F.lit(False).alias("is_table"))


def document_lines(spark: SparkSession, sf_dir: str, page_lines: int = 40) -> DataFrame:
    """Every document for itself: document = doc_id, with a page for each page_lines of its lines."""
    return lines(spark, sf_dir).withColumns({"document_id": F.col("page"), "page": F.ceil(F.col("line_no") / page_lines).cast("int")})


@query(f"""WITH {LINES_SQL}, k AS (SELECT document_id, page, {KEY_SQL} AS key FROM lines), p AS (SELECT document_id, count(DISTINCT page) AS pages FROM k GROUP BY 1),
s AS (SELECT document_id, key, count(DISTINCT page) AS n_pages FROM k WHERE key <> '' AND NOT regexp_full_match(key, '[0-9]{{1,4}}') GROUP BY ALL) SELECT document_id, key, n_pages FROM s JOIN p USING (document_id) WHERE n_pages >= greatest(3, pages * 0.05)""")
def running_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A-1, T-2: lines that recur on a share of a document's pages."""
    keyed = lines(spark, sf_dir).withColumn("key", T.running_key(F.col("text"), F.lit(False)))
    return K.running_keys(keyed, share=0.05)


@query(f"""WITH {LINES_SQL}, k AS (SELECT *, {KEY_SQL} AS key FROM lines), p AS (SELECT document_id, count(DISTINCT page) AS pages FROM k GROUP BY 1),
s AS (SELECT document_id, key FROM k JOIN p USING (document_id) WHERE key <> '' AND NOT regexp_full_match(key, '[0-9]{{1,4}}') GROUP BY document_id, key, pages HAVING count(DISTINCT page) >= greatest(3, pages * 0.05))
SELECT document_id, key, trim(arg_min(line, page * 100000 + line_no)) AS text FROM k JOIN s USING (document_id, key) GROUP BY ALL""")
def running_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A-13: each running line once, as first seen."""
    keyed = lines(spark, sf_dir).withColumn("key", T.running_key(F.col("text"), F.lit(False)))
    return K.running_text(keyed, K.running_keys(keyed, share=0.05))


@query(f"""WITH {LINES_SQL}, t AS (SELECT document_id, page, line_no, CASE WHEN (page + line_no) % 3 = 0 THEN line || ' … ' || page % 500 ELSE line END AS line FROM lines)
SELECT document_id, page, count(*) FILTER (regexp_matches(trim(line), '(^|[^0-9.,])[0-9]{{1,3}}(-[0-9]{{1,3}})?$')) AS n_entries, count(*) AS n_lines FROM t GROUP BY ALL HAVING n_entries >= 6 AND n_entries >= n_lines * 0.3""")
def contents_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A-7: pages of which many lines end in a page reference, which every third line gets."""
    entry = F.concat("text", F.lit(" … "), (F.col("page") % 500).cast("string"))
    return K.contents_pages(lines(spark, sf_dir).withColumn("text", F.when((F.col("page") + F.col("line_no")) % 3 == 0, entry).otherwise(F.col("text"))))


@query(f"""WITH {LINES_SQL}, s AS (SELECT document_id, 8 + length(line) % 4 AS size, sum(length(line)) AS n FROM lines GROUP BY ALL) SELECT document_id, CAST(arg_min(size, -n * 100 + size) AS DOUBLE) AS body_size FROM s GROUP BY 1""")
def body_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A-2: the size in which most characters of a document stand."""
    return K.body_sizes(lines(spark, sf_dir).withColumn("size", (8 + F.length("text") % 4).cast("double")))


@query(f"""WITH {LINES_SQL}, h AS (SELECT document_id, page, line_no, trim(line) AS t, line_no % 3 = 1 AS bold, 10 + line_no % 4 AS size FROM lines)
SELECT document_id, page, line_no, CASE WHEN regexp_matches(t, '(?i)^(SECTION|PART|CHAPTER)\\s+([0-9]{{1,3}})\\.?(\\s+\\S.*)?$') THEN 'keyword' WHEN regexp_matches(t, '^([0-9]{{1,3}}(\\.[0-9]{{1,3}})*)\\.?\\s+(\\S.*)$') AND regexp_matches(regexp_extract(t, '^([0-9]{{1,3}}(\\.[0-9]{{1,3}})*)\\.?\\s+(\\S.*)$', 3), '\\p{{L}}') THEN 'numbered' ELSE 'unnumbered' END AS kind
FROM h WHERE NOT contains(t, '…') AND length(t) <= 200 AND regexp_matches(t, '\\p{{L}}') AND NOT regexp_matches(t, '(?i)^[0-9]{{1,2}}(st|nd|rd|th)?\\s+\\p{{L}}{{3,9}}\\.?,?\\s+[0-9]{{4}}$') AND size >= 9.9 AND (bold OR size >= 10.5)
AND (regexp_matches(t, '(?i)^(SECTION|PART|CHAPTER)\\s+([0-9]{{1,3}})\\.?(\\s+\\S.*)?$') OR regexp_matches(t, '^([0-9]{{1,3}}(\\.[0-9]{{1,3}})*)\\.?\\s+(\\S.*)$') AND regexp_matches(regexp_extract(t, '^([0-9]{{1,3}}(\\.[0-9]{{1,3}})*)\\.?\\s+(\\S.*)$', 3), '\\p{{L}}') OR bold AND size >= 11.5 AND length(t) <= 120 AND NOT t LIKE '%:')""")
def heading_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T-5: what kind of heading a line is."""
    own = lines(spark, sf_dir).withColumns({"bold": F.col("line_no") % 3 == 1, "size": (10 + F.col("line_no") % 4).cast("double")})
    return own.select("document_id", "page", "line_no", T.heading_kind(F.col("text"), F.col("size"), F.col("bold"), F.lit(10.0)).alias("kind")).where("kind is not null")


@query(f"""WITH {LINES_SQL}, h AS (SELECT document_id, trim(line) AS t, 11.6 + line_no % 3 AS size FROM lines WHERE line_no % 5 = 0),
u AS (SELECT document_id, size FROM h WHERE NOT contains(t, '…') AND length(t) <= 120 AND regexp_matches(t, '\\p{{L}}') AND NOT regexp_matches(t, '(?i)^[0-9]{{1,2}}(st|nd|rd|th)?\\s+\\p{{L}}{{3,9}}\\.?,?\\s+[0-9]{{4}}$') AND NOT t LIKE '%:'
AND NOT regexp_matches(t, '(?i)^(SECTION|PART|CHAPTER)\\s+([0-9]{{1,3}})\\.?(\\s+\\S.*)?$') AND NOT (regexp_matches(t, '^([0-9]{{1,3}}(\\.[0-9]{{1,3}})*)\\.?\\s+(\\S.*)$') AND regexp_matches(regexp_extract(t, '^([0-9]{{1,3}}(\\.[0-9]{{1,3}})*)\\.?\\s+(\\S.*)$', 3), '\\p{{L}}')))
SELECT document_id, size_rank, count(*) AS n FROM (SELECT document_id, dense_rank() OVER (PARTITION BY document_id ORDER BY size DESC) AS size_rank FROM u) GROUP BY ALL""")
def heading_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W-5: unnumbered headings ranked by size within a document, the largest first."""
    set_off = F.col("line_no") % 5 == 0
    own = lines(spark, sf_dir).withColumns({"bold": set_off, "size": F.when(set_off, 11.6 + F.col("line_no") % 3).otherwise(10.0)})
    return K.headings(own).where("kind = 'unnumbered'").groupBy("document_id", F.col("size_rank").cast("long").alias("size_rank")).agg(F.count(F.lit(1)).alias("n"))


@query()
def section_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W-5, W-10, W-11, W-12: the section tree of each document, whose lines get headings from their places; tested on fixtures."""
    heading = F.when(F.col("line_no") % 7 == 1, F.concat(((F.col("page") % 9) + 1).cast("string"), F.lit("."), F.col("line_no").cast("string"), F.lit(" "), F.substring("text", 1, 40))).otherwise(F.col("text"))
    own = document_lines(spark, sf_dir).withColumns({"text": heading, "bold": F.col("line_no") % 7 == 1, "size": F.when(F.col("line_no") % 7 == 1, 12.0).otherwise(10.0)})
    sections = held(K.section_tree(own))
    return sections.join(K.breadcrumbs(sections), ["document_id", "ordinal"]).select("document_id", "ordinal", "ref", "level", "parent_ordinal", "kind", "path")


@query("""WITH l AS (SELECT doc_id, len(string_split(text, chr(10))) AS n_lines FROM documents WHERE text IS NOT NULL), h AS (SELECT doc_id, n_lines, unnest(range((n_lines + 3) // 4)) AS n FROM l),
t AS (SELECT doc_id, n, n_lines, n // 6 + 1 AS t, n % 6 AS k, n * 4 + 1 AS spot, least(n * 4 + 4, n_lines) AS stop FROM h)
SELECT doc_id AS document_id, n + 1 AS ordinal, t || CASE k WHEN 0 THEN '' WHEN 1 THEN '.1' WHEN 2 THEN '.1.1' WHEN 3 THEN '.1.2' WHEN 4 THEN '.2' ELSE '.2.1' END AS ref, CASE WHEN k = 0 THEN 1 WHEN k IN (1, 4) THEN 2 ELSE 3 END AS level,
CASE k WHEN 0 THEN NULL WHEN 1 THEN n WHEN 2 THEN n WHEN 3 THEN n - 1 WHEN 4 THEN n - 3 ELSE n END AS parent_ordinal, CAST((spot + 39) // 40 AS INT) AS page_start, CAST((stop + 39) // 40 AS INT) AS page_end, CASE WHEN stop > spot THEN spot + 1 END AS first_line, CASE WHEN stop > spot THEN stop END AS last_line FROM t""")
def numbered_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W-11, W-4: the tree of documents whose every fourth line is a heading numbered to three levels."""
    n = F.floor((F.col("line_no") - 1) / 4)
    heading = F.concat((F.floor(n / 6) + 1).cast("string"), F.get(F.array(*[F.lit(x) for x in ("", ".1", ".1.1", ".1.2", ".2", ".2.1")]), (n % 6).cast("int")), F.lit(" Part"))
    first = F.col("line_no") % 4 == 1
    own = document_lines(spark, sf_dir).withColumns({"text": F.when(first, heading).otherwise(F.concat("text", F.lit("."))), "bold": first, "size": F.when(first, 14.0).otherwise(10.0)})
    return K.section_tree(own).select("document_id", "ordinal", "ref", "level", "parent_ordinal", "page_start", "page_end", "first_line", "last_line")


STRIP = "regexp_replace({0}, '^\\s+|\\s+$', '', 'g')"


@query(f"""WITH RECURSIVE l AS (SELECT doc_id, doc_id % 3 = 0 AS defs, i, i % 9 = 4 AS tab, CASE WHEN i % 6 = 2 THEN '"term" ' || line ELSE line END AS line FROM (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS i, unnest(string_split(text, chr(10))) AS line FROM documents) WHERE doc_id % 10 <> 7),
c AS (SELECT doc_id, i, 1 AS chunk_no, length(line) AS chars, tab AS shut FROM l WHERE i = 1
  UNION ALL SELECT l.doc_id, l.i, CASE WHEN shut OR l.tab OR (defs AND i6) OR chars + n > 900 THEN chunk_no + 1 ELSE chunk_no END, CASE WHEN shut OR l.tab OR (defs AND i6) OR chars + n > 900 THEN n ELSE chars + n END, l.tab
  FROM c JOIN (SELECT *, i % 6 = 2 AND NOT tab AND regexp_matches(line, '^"term"\\s') AS i6, length(line) AS n FROM l) l ON l.doc_id = c.doc_id AND l.i = c.i + 1),
t AS (SELECT doc_id, i, line, lag(line) OVER (PARTITION BY doc_id ORDER BY i) AS line1 FROM l WHERE NOT tab),
p AS (SELECT l.*, c.chunk_no, (SELECT arg_max(coalesce(line1 || chr(10), '') || t.line, t.i) FROM t WHERE t.doc_id = l.doc_id AND t.i < l.i AND l.tab) AS intro FROM l JOIN c USING (doc_id, i)),
b AS (SELECT doc_id, chunk_no, bool_or(tab) AS tab, any_value(defs) AS defs, count(*) AS n_lines, CASE WHEN bool_or(tab) THEN coalesce(max(intro) || chr(10) || chr(10), '') || max(line) ELSE regexp_replace(string_agg(trim(line), chr(10) ORDER BY i), '(\\p{{L}})-\\n(\\p{{Ll}})', '\\1\\2', 'g') END AS body FROM p GROUP BY ALL)
SELECT doc_id, chunk_no, CASE WHEN tab THEN 'table' WHEN defs THEN 'definition' ELSE 'text' END AS kind, n_lines, md5({STRIP.format('body')}) AS body FROM b""")
def chunk_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W-7, W-8, W-9: lines packed greedily into chunks; tables with their introductions, defined terms, and sections of contents that have none."""
    key, i = F.col("page"), F.col("line_no")
    section = F.when(key % 10 == 7, "contents").when(key % 3 == 0, "definitions").otherwise("body")
    own = lines(spark, sf_dir).select(key.alias("document_id"), F.lit(1).alias("section_ordinal"), section.alias("section_kind"), i.alias("seq"), "page", F.when(i % 6 == 2, F.concat(F.lit('"term" '), "text")).otherwise(F.col("text")).alias("text"), (i % 9 == 4).alias("is_table"))
    return K.chunks(own, limit=900).select(F.col("document_id").alias("doc_id"), "chunk_no", "kind", F.col("n_lines").cast("long").alias("n_lines"), F.md5("body").alias("body"))


@query("""WITH w AS (SELECT doc_id, unnest(CASE WHEN len(regexp_extract_all(coalesce(text, ''), '[\\p{L}\\p{N}]+')) = 0 THEN [NULL] ELSE regexp_extract_all(replace(lower(text), 'ß', 'ss'), '[\\p{L}\\p{N}]+') END) AS token FROM documents),
h AS (SELECT doc_id, CASE WHEN token IS NULL THEN 0 ELSE CAST('0x' || substr(md5(token), 1, 8) AS BIGINT) % 256 END AS dim, CASE WHEN token IS NULL OR substr(md5(token), 9, 1) IN ('0', '2', '4', '6', '8', 'a', 'c', 'e') THEN 1 ELSE -1 END AS sign FROM w),
v AS (SELECT doc_id, dim, sum(sign) AS v FROM h GROUP BY ALL HAVING sum(sign) <> 0)
SELECT doc_id, CAST(dim AS INTEGER) AS dim, round(v / sqrt(sum(v * v) OVER (PARTITION BY doc_id)), 6) AS value FROM v""")
def feature_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T-12: every value of the documents' hashed feature vectors."""
    return K.feature_vectors(table(spark, sf_dir, "documents"), "doc_id", "text").select("doc_id", "dim", F.round("value", 6).alias("value"))


@query("""SELECT s.source AS document_id, count(DISTINCT d.doc_id) AS chunks, coalesce(any_value(t.n), 0) AS charges FROM (SELECT DISTINCT source FROM documents) s LEFT JOIN documents d ON d.source = s.source AND d.lang = 'fr' LEFT JOIN (SELECT source, count(*) AS n FROM documents JOIN labels USING (doc_id) WHERE toxic = 1 GROUP BY 1) t ON t.source = s.source GROUP BY 1""")
def document_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A-5, A-6: rows of each kind by document, zero where none."""
    docs = table(spark, sf_dir, "documents").select(F.col("source").alias("document_id"), "doc_id", "lang")
    toxic = docs.join(table(spark, sf_dir, "labels").where("toxic = 1"), "doc_id")
    return K.document_counts(docs.select("document_id").distinct(), chunks=docs.where("lang = 'fr'"), charges=toxic)


@query(f"""WITH {LINES_SQL}, r AS (SELECT *, coalesce(sum(length(line)) OVER (PARTITION BY document_id ORDER BY page, line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS sofar FROM lines)
SELECT document_id, string_agg(line, chr(10) ORDER BY page, line_no) AS opening FROM r WHERE sofar < 6000 GROUP BY 1""")
def opening_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A-12: a document's first 6,000 characters in whole lines."""
    return K.opening_text(lines(spark, sf_dir))


@query("""WITH h AS (SELECT p_brand, p_type, min(p_partkey) AS pos FROM part GROUP BY ALL) SELECT p_brand AS document_id, p_type AS header, pos FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY pos) AS n FROM h) WHERE n <= 3""")
def table_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A-12: a document's first different table headers."""
    return K.table_headers(table(spark, sf_dir, "part").select(F.col("p_brand").alias("document_id"), F.col("p_type").alias("header"), F.col("p_partkey").alias("pos")), limit=3)


@query("""SELECT p_brand AS document_id, count(*) AS n_tables, count(*) FILTER (p_size % 3 = 0 OR p_size % 5 = 0) AS n_suspect FROM part GROUP BY 1""")
def suspect_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A-11, T-6: tables whose rows differ in width, or that are mostly empty."""
    size = F.col("p_size")
    ragged, hollow = F.when(size % 3 == 0, "| x").otherwise(""), F.when(size % 5 == 0, "|  |  |\n|  |  |\n|  |  |").otherwise("| a | 1 |")
    markdown = F.concat(F.lit("| Item | Rate |\n|---|---|\n"), hollow, F.lit("\n| b | "), size.cast("string"), F.lit(" "), ragged, F.lit("|"))
    return K.table_counts(table(spark, sf_dir, "part").select(F.col("p_brand").alias("document_id"), markdown.alias("markdown")))


@query("""SELECT c_custkey AS id, r_name || ' > ' || n_name || ' > ' || c_name AS path FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey""")
def breadcrumb_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W-12: titles from the top of a tree down: regions, nations, customers."""
    parts = [
        table(spark, sf_dir, "region").select((F.col("r_regionkey") + 1).cast("int").alias("ordinal"), F.col("r_name").alias("title"), F.lit(1).alias("level"), F.lit(None).cast("int").alias("parent_ordinal")),
        table(spark, sf_dir, "nation").select((F.col("n_nationkey") + 100).cast("int"), "n_name", F.lit(2), (F.col("n_regionkey") + 1).cast("int")),
        table(spark, sf_dir, "customer").select((F.col("c_custkey") + 1000).cast("int"), "c_name", F.lit(3), (F.col("c_nationkey") + 100).cast("int")),
    ]
    sections = parts[0].union(parts[1]).union(parts[2]).withColumn("document_id", F.lit("d"))
    return K.breadcrumbs(sections).where("ordinal >= 1000").select((F.col("ordinal") - 1000).cast("long").alias("id"), "path")


@query("""SELECT label, count(*) FILTER (vec_id % 3 = 0) AS pending, count(*) FILTER (vec_id % 3 <> 0) AS embedded FROM embeddings GROUP BY 1""")
def embed_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P-17: chunks with and without a vector."""
    chunks = table(spark, sf_dir, "embeddings").select("label", F.when(F.col("vec_id") % 3 != 0, F.col("embedding")).alias("embedding"))
    counts = [S.by_embedding(chunks, pending).groupBy("label").agg(F.count(F.lit(1)).alias(name)) for pending, name in ((True, "pending"), (False, "embedded"))]
    return counts[0].join(counts[1], "label", "full_outer").fillna(0, ["pending", "embedded"])


SEMANTIC_SQL = """sem AS (SELECT query_id, chunk_id, similarity, sem_rank FROM (SELECT q.vec_id AS query_id, c.vec_id AS chunk_id, round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[])), 6) AS similarity,
row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[])), 6) DESC, c.vec_id) AS sem_rank FROM embeddings q JOIN embeddings c ON {on} WHERE q.vec_id % 20 = 0) WHERE sem_rank <= {k})"""


def _vectors(spark: SparkSession, sf_dir: str, document: str) -> tuple[DataFrame, DataFrame]:
    """Queries are the vectors whose id is divisible by 20."""
    vectors = table(spark, sf_dir, "embeddings").withColumn("document_id", F.expr(document))
    return vectors.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "document_id", "embedding"), vectors.select(F.col("vec_id").alias("chunk_id"), "document_id", "embedding", "label")


@query(f"WITH {SEMANTIC_SQL.format(on='q.label = c.label', k=20)} SELECT query_id, chunk_id, similarity, sem_rank FROM sem")
def semantic_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R-1, T-14: nearest chunks within a query's document."""
    queries, chunks = _vectors(spark, sf_dir, "label")
    return S.semantic_top(queries, chunks, S.candidate_depth(5), digits=6)


TOKENS_SQL = "regexp_extract_all(replace(lower({0}), 'ß', 'ss'), '[\\p{{L}}\\p{{N}}]+')"


@query(f"""WITH w AS (SELECT doc_id, unnest({TOKENS_SQL.format('text')}) AS token FROM documents), p AS (SELECT doc_id, unnest({TOKENS_SQL.format("lang || ' ' || source")}) AS token FROM documents),
i AS (SELECT doc_id, token, sum(a) AS tp, sum(b) AS tb FROM (SELECT doc_id, token, 1 AS a, 0 AS b FROM p UNION ALL SELECT doc_id, token, 0, 1 FROM w) GROUP BY ALL), n AS (SELECT count(DISTINCT doc_id) AS n FROM i), d AS (SELECT token, count(*) AS df FROM i GROUP BY 1),
q AS (SELECT DISTINCT item_id, unnest({TOKENS_SQL.format("text || ' en'")}) AS token FROM benchmark),
s AS (SELECT item_id, doc_id, round(sum((1.0 * tp + 0.4 * tb) * ln(1 + n / df)), 6) AS score FROM q JOIN d USING (token) JOIN i USING (token), n GROUP BY ALL)
SELECT item_id AS query_id, doc_id AS chunk_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS r FROM s) WHERE r <= 10""")
def lexical_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R-2, R-3: chunks by weighted words of a query."""
    docs = table(spark, sf_dir, "documents").select(F.lit("d").alias("document_id"), F.col("doc_id").alias("chunk_id"), F.col("doc_id").alias("ordinal"), F.concat_ws("/", "lang", "source").alias("path"), F.col("text").alias("body"))
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.lit("d").alias("document_id"), F.concat("text", F.lit(" en")).alias("text"))
    return S.lexical_top(asked, S.lexical_index(docs), 10, digits=6, sizes=S.lexical_sizes(docs)).select("query_id", "chunk_id", "score")


@query(f"""WITH {SEMANTIC_SQL.format(on='q.label = c.label', k=20)}, lex AS (SELECT query_id, chunk_id, lex_rank FROM (SELECT q.vec_id AS query_id, c.vec_id AS chunk_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY abs(c.vec_id - q.vec_id), c.vec_id) AS lex_rank FROM embeddings q JOIN embeddings c ON q.label = c.label WHERE q.vec_id % 20 = 0) WHERE lex_rank <= 20),
f AS (SELECT query_id, chunk_id, round(coalesce(1 / (60 + sem_rank), 0) + coalesce(1 / (60 + lex_rank), 0), 12) AS rrf, sem_rank, lex_rank FROM sem FULL JOIN lex USING (query_id, chunk_id))
SELECT query_id, chunk_id, round(rrf, 9) AS rrf, sem_rank, lex_rank, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, sem_rank NULLS LAST, lex_rank NULLS LAST) AS rank FROM f) WHERE rank <= 8""")
def rank_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R-4: two rankings fused by reciprocal ranks."""
    queries, chunks = _vectors(spark, sf_dir, "label")
    return S.fuse(S.semantic_top_blocks(queries, chunks, 20, digits=6), _nearest_ids(chunks, "chunk_id % 20 = 0", 20)).select("query_id", "chunk_id", F.round("rrf", 9).alias("rrf"), "sem_rank", "lex_rank", "rank")


def _nearest_ids(chunks: DataFrame, asked: str, k: int) -> DataFrame:
    """(query_id, chunk_id, lex_rank): for each asked chunk the k of its document whose ids are nearest, ties by chunk_id; null ids come last.

    In the order of ids those stand within k places of it, so it meets 2 k + 1 rows and not its whole document.
    """
    rows = chunks.where("document_id is not null").select("document_id", "chunk_id", F.col("chunk_id").isNull().alias("none"))
    placed = RB.numbered(rows, "document_id", "none", "chunk_id").drop("none")
    around = placed.where(asked).select("document_id", F.col("chunk_id").alias("query_id"), F.explode(F.sequence(F.col("pos") - k, F.col("pos") + k)).alias("pos"))
    near = F.row_number().over(Window.partitionBy("query_id").orderBy(F.abs(F.col("chunk_id") - F.col("query_id")).asc_nulls_last(), "chunk_id"))
    return around.join(placed, ["document_id", "pos"]).select("query_id", "chunk_id").withColumn("lex_rank", near).where(F.col("lex_rank") <= k)


@query(f"""WITH {SEMANTIC_SQL.format(on='true', k=5)}, h AS (SELECT DISTINCT query_id FROM sem JOIN embeddings a ON a.vec_id = query_id JOIN embeddings b ON b.vec_id = chunk_id WHERE a.label = b.label AND query_id <> chunk_id)
SELECT (SELECT count(*) FROM embeddings WHERE vec_id % 20 = 0) AS n_queries, (SELECT count(*) FROM h) AS n_found, round((SELECT count(*) FROM h) / (SELECT count(*) FROM embeddings WHERE vec_id % 20 = 0), 6) AS recall""")
def recall_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A-8, J-15: the share of queries with a hit of their label among the nearest."""
    queries, chunks = _vectors(spark, sf_dir, "'all'")
    hits = S.semantic_top_blocks(queries, chunks, 5, digits=6).withColumnRenamed("sem_rank", "rank")
    labels = chunks.select("chunk_id", "label")
    own = hits.select("query_id", "chunk_id").join(labels, "chunk_id").join(labels.select(F.col("chunk_id").alias("query_id"), F.col("label").alias("wanted")), "query_id").where("label = wanted AND chunk_id <> query_id")
    return Q.recall(hits, own.select("query_id", "chunk_id"), queries, 5)


@query("""SELECT source AS document_id, ref, n_more FROM (SELECT source, doc_id % 9 || '.' || doc_id AS ref, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n, greatest(count(*) OVER (PARTITION BY source) - 20, 0) AS n_more FROM documents WHERE doc_id % 10 <> 0) WHERE n <= 20""")
def outline_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P-15, T-10: a document's sections without contents pages, capped, with how many follow."""
    sections = table(spark, sf_dir, "documents").select(F.col("source").alias("document_id"), F.col("doc_id").alias("ordinal"), F.concat_ws(".", (F.col("doc_id") % 9).cast("string"), F.col("doc_id").cast("string")).alias("ref"), F.col("lang").alias("title"), F.when(F.col("doc_id") % 10 == 0, "contents").otherwise("body").alias("kind"))
    return S.outline(sections, limit=20).select("document_id", "ref", "n_more")


@query("""SELECT source AS document_id, term, doc_id AS chunk_id, n FROM (SELECT source, term, doc_id, row_number() OVER (PARTITION BY source, term ORDER BY doc_id) AS n FROM documents, (VALUES ('The '), ('license'), ('queno')) t(term) WHERE contains(lower(text), lower(term))) WHERE n <= 5""")
def definition_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P-16: the first chunks of a document that contain a term in any case."""
    docs = table(spark, sf_dir, "documents")
    chunks = docs.select(F.col("source").alias("document_id"), F.col("doc_id").alias("chunk_id"), F.col("doc_id").alias("ordinal"), F.lit("definition").alias("kind"), F.col("text").alias("content"))
    terms = docs.select(F.col("source").alias("document_id")).distinct().withColumn("term", F.explode(F.array(F.lit("The "), F.lit("license"), F.lit("queno"))))
    return S.definitions(terms, chunks)


@query("""WITH l AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS line_no, unnest(string_split(text, chr(10))) AS line FROM documents),
c AS (SELECT doc_id, CAST(ceil(line_no / 5) AS INTEGER) AS page, string_agg(line, chr(10) ORDER BY line_no) AS body FROM l GROUP BY ALL)
SELECT doc_id AS document_id, 'r' || page % 3 AS ref, md5(string_agg(body, chr(10) || chr(10) ORDER BY page)) AS body, string_agg(CAST(page AS VARCHAR), ',' ORDER BY page) AS chunks, CASE WHEN page % 3 = 1 THEN (SELECT string_agg(r, ',' ORDER BY r) FROM (SELECT DISTINCT 'r' || d.page % 3 AS r FROM c d WHERE d.doc_id = c.doc_id AND d.page % 3 <> 1)) END AS children FROM c GROUP BY ALL""")
def section_reading(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J-8: each document's sections as they read: bodies of their chunks in order, the chunks' ids, and sections below."""
    number = (F.col("page") % 3).cast("int")
    pages = document_lines(spark, sf_dir, 5).groupBy("document_id", "page").agg(F.array_sort(F.collect_list(F.struct("line_no", "text"))).alias("ls"))
    chunks = pages.select("document_id", number.alias("section_ordinal"), F.col("page").alias("ordinal"), F.col("page").alias("chunk_id"), F.array_join("ls.text", "\n").alias("body"))
    ref = F.concat(F.lit("r"), F.col("section_ordinal").cast("string"))
    sections = chunks.select("document_id", F.col("section_ordinal").alias("ordinal"), ref.alias("ref"), ref.alias("title"), F.when(F.col("section_ordinal") != 1, 1).alias("parent_ordinal")).distinct()
    out = S.read_sections(sections.select("document_id", "ref"), sections, chunks)
    return out.select("document_id", "ref", F.md5("body").alias("body"), F.array_join("chunk_ids", ",").alias("chunks"), F.array_join("children", ",").alias("children"))


NORMAL_SQL = "' ' || array_to_string(regexp_extract_all(replace(lower({0}), 'ß', 'ss'), '[\\p{{L}}\\p{{N}}]+'), ' ') || ' '"


@query(f"""WITH c AS (SELECT item_id, 'src' || item_id % 20 AS document_id, text AS quote FROM benchmark), m AS (SELECT c.item_id, min(d.doc_id) AS chunk_id FROM c JOIN documents d ON d.source = c.document_id WHERE contains({NORMAL_SQL.format('d.text')}, {NORMAL_SQL.format('c.quote')}) GROUP BY 1)
SELECT item_id AS rule_id, chunk_id FROM c LEFT JOIN m USING (item_id)""")
def citation_retarget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J-10, T-1: the chunk of the cited document that holds the quote."""
    chunks = table(spark, sf_dir, "documents").select(F.col("source").alias("document_id"), F.col("doc_id").alias("ordinal"), F.col("doc_id").alias("chunk_id"), F.col("lang").alias("section_ref"), F.col("text").alias("content"))
    cited = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("rule_id"), F.lit(0).alias("pos"), F.concat(F.lit("src"), (F.col("item_id") % 20).cast("string")).alias("document_id"), F.lit(-1).cast("long").alias("ordinal"), F.lit("none").alias("section_ref"), F.col("text").alias("quote"))
    return QU.retarget_citations(cited, chunks).select("rule_id", "chunk_id")


@query(f"""WITH e AS (SELECT item_id, doc_id, text FROM benchmark JOIN (SELECT doc_id, source, text AS body FROM documents) ON source = 'src' || item_id % 20), h AS (SELECT item_id, min(d.doc_id) AS found FROM benchmark b JOIN documents d ON d.source = 'src' || b.item_id % 20 WHERE contains({NORMAL_SQL.format('d.text')}, {NORMAL_SQL.format('b.text')}) GROUP BY 1)
SELECT item_id AS rule_id, CASE WHEN found IS NOT NULL AND found <> item_id THEN found ELSE item_id END AS chunk_id, coalesce(found <> item_id, false) AND NOT EXISTS (SELECT 1 FROM documents d WHERE d.doc_id = b.item_id AND d.source = 'src' || b.item_id % 20 AND contains({NORMAL_SQL.format('d.text')}, {NORMAL_SQL.format('b.text')})) AS repaired FROM benchmark b LEFT JOIN h USING (item_id)""")
def citation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J-11: a citation moves to the first evidence chunk that holds its quote."""
    source = F.concat(F.lit("src"), (F.col("item_id") % 20).cast("string"))
    cited = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("rule_id"), F.lit(0).alias("pos"), source.alias("document_id"), F.col("item_id").alias("chunk_id"), F.col("text").alias("quote"))
    chunks = table(spark, sf_dir, "documents").select(F.col("source").alias("document_id"), F.col("doc_id").alias("chunk_id"), F.col("text").alias("content"))
    return QU.repair_citations(cited, chunks).select("rule_id", "chunk_id", "repaired")


@query("""WITH r AS (SELECT DISTINCT p_size || '.' || p_partkey % 3 AS ref FROM part UNION SELECT DISTINCT CAST(p_size AS VARCHAR) FROM part WHERE p_size % 2 = 0), a AS (SELECT p_partkey AS entry_id, CAST(p_size AS VARCHAR) AS top, p_size || '.' || p_partkey % 6 AS two FROM part)
SELECT entry_id, CASE WHEN two IN (SELECT ref FROM r) THEN two WHEN top IN (SELECT ref FROM r) THEN top END AS ref FROM a""")
def section_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J-13: the longest dotted prefix of an asked section that exists."""
    part, size = table(spark, sf_dir, "part"), F.col("p_size").cast("string")
    refs = part.select(F.concat_ws(".", size, (F.col("p_partkey") % 3).cast("string")).alias("ref")).union(part.where("p_size % 2 = 0").select(size))
    asked = part.select(F.col("p_partkey").alias("entry_id"), F.array(F.concat(F.lit(" "), size, F.lit("."), (F.col("p_partkey") % 6).cast("string"), F.lit(".9. "))).alias("refs"))
    return Q.resolve_refs(asked, refs).select("entry_id", "ref")


@query("""WITH x AS (SELECT o_orderkey AS case_id, CAST(o_totalprice AS DECIMAL(18,2)) AS amount FROM orders), i AS (SELECT l_orderkey AS case_id, l_linenumber AS item_pos, CAST(l_extendedprice AS DECIMAL(18,2)) AS computed, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, CAST(l_extendedprice AS DECIMAL(18,2))) AS r FROM lineitem WHERE l_returnflag = 'R' OR l_linestatus = 'O')
SELECT x.case_id, i.item_pos, coalesce(abs((CAST(computed AS DOUBLE) - CAST(amount AS DOUBLE)) * 100 / CAST(amount AS DOUBLE)) <= 50, false) AS passed FROM x LEFT JOIN i ON i.case_id = x.case_id AND r = 1""")
def accuracy_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J-14, A-9: expected amounts against the first line item of the section, by ref or title, within a tolerance."""
    expected = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("case_id"), F.lit(1).alias("pos"), F.lit("R").alias("section"), F.lit("o").alias("section_title"), F.col("o_totalprice").cast("decimal(18,2)").alias("amount"), F.lit(50).cast("decimal(9,4)").alias("tolerance_pct"))
    items = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("case_id"), F.col("l_linenumber").alias("item_pos"), F.col("l_extendedprice").cast("decimal(18,2)").alias("amount"), F.array("l_returnflag").alias("section_refs"), F.array("l_linestatus").alias("section_titles"))
    return Q.accuracy(Q.match_items(expected, items)).select("case_id", "item_pos", "passed")


@query("""WITH l AS (SELECT l_orderkey AS task_id, l_partkey AS chunk_id, l_returnflag AS f FROM lineitem), s AS (SELECT DISTINCT task_id FROM l WHERE f = 'R')
SELECT DISTINCT task_id, chunk_id FROM l WHERE f = 'A' UNION SELECT r.task_id, r.chunk_id FROM l r JOIN l n ON r.task_id = n.task_id AND r.chunk_id = n.chunk_id WHERE r.f = 'R' AND n.f = 'N' UNION SELECT task_id, chunk_id FROM l WHERE f = 'N' AND task_id NOT IN (SELECT task_id FROM s)""")
def evidence_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J-16: opened chunks, and the submitted ones that were seen, or all that were seen."""
    l = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("task_id"), F.col("l_partkey").alias("chunk_id"), "l_returnflag")
    return Q.evidence(l.where("l_returnflag = 'A'"), l.where("l_returnflag = 'N'"), l.where("l_returnflag = 'R'"))


def document_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(rule_id, rule): a rule for each document, of the literal shapes in turn, whose minimum is the document's n_chars.

    It cites its own document by that one's first eight words, and the next document (by id) by the text of a benchmark item.
    """
    shapes = spark.createDataFrame(list(enumerate(RULES)), "n int, charge_id string").join(rule_frame(spark), "charge_id").select("n", "rule")
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("item"), F.col("text").alias("passage"))
    n_items = (items.agg(F.max("item")).first()[0] or 0) + 1
    key = F.col("doc_id")
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars", F.substring_index(F.trim(F.coalesce("text", F.lit(""))), " ", 8).alias("opening"), F.pmod(key, F.lit(len(RULES))).cast("int").alias("n"), F.pmod(key, F.lit(n_items)).alias("item"))

    def cited(chunk: Column, quote: str) -> Column:
        return F.struct(chunk.cast("long").alias("chunk_id"), F.lit("1").alias("section_ref"), F.lit(1).alias("page"), F.col(quote).alias("quote"))

    rule = F.col("rule").withField("minimum", F.col("n_chars").cast(RATE)).withField("citations", F.array(cited(key, "opening"), cited(key + 1, "passage")))
    return docs.join(F.broadcast(shapes), "n").join(items, "item", "left").select(key.alias("rule_id"), rule.alias("rule"))


@query()
def grounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V-4, V-5, U-2: quotes and numbers of every document's rule that the cited documents don't hold; tested by brute force."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("content"))
    return Q.grounding_issues(document_rules(spark, sf_dir), docs)
