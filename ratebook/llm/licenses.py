"""License scans by ordered signature rules, with DataFrame functions only."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import read_table
from .license_rules import RULES, Rule

__all__ = ["detections", "op12_licenses", "scan"]

_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Marks around a match; texts lose both, as they stand between words.
_OPEN, _CLOSE = "\x01", "\x02"
_GROUP = "array<struct<gate:string,keyword:string,needed:string,rules:array<struct<number:int,priority:int,pattern:string,label:string,base:boolean,confidence:double>>>>"


def _by_keyword(rules: list[Rule]) -> list[dict]:
    """The rules in groups of one keyword and needed pattern; gate is the keyword's longest word."""
    groups: dict[tuple[str, str], list[dict]] = {}
    for r in rules:
        groups.setdefault((r.keyword, r.needed), []).append(vars(r))
    return [{"gate": max(k.split(), key=len), "keyword": k, "needed": n, "rules": v} for (k, n), v in groups.items()]


def words_line(text: Column) -> Column:
    """The words of a text, lower-cased in A-Z, two blanks before and after each; null and texts without words give two blanks.

    lower() changes other letters too, but into letters: no word begins or ends elsewhere by it, and of those only the Kelvin
    sign, which is taken out before, could become a word of a rule.
    """
    low = F.lower(F.replace(F.coalesce(text.cast("string"), F.lit("")), F.lit("\u212a"), F.lit("\u0138")))
    return F.regexp_replace(F.concat(F.lit(" "), low, F.lit(" ")), _BETWEEN, "  ")


def _halves(line: Column) -> Column:
    """Words of a part of a line that begins or ends within the blanks between two words."""
    return F.shiftright(F.length(line) - F.length(F.replace(line, F.lit(" "), F.lit(""))), 1).cast("long")


def detections(docs: DataFrame, text_column: str = "text", rules: list[Rule] = RULES) -> DataFrame:
    """(docs' columns but the text, __row, n_words, rule, start, end, kept): what each rule finds; one row with nulls where none finds anything.

    One pass over a text's words tells which keywords may stand in it; rules whose keyword or needed pattern it lacks aren't tried. Matches of one rule don't overlap; start and end are words from 0, end not
    included. A detection is kept unless another of its document contains it and is of a better or equal priority; of equal
    spans the earlier rule's stays. Only numbers leave the pass over the texts, and a document's detections are put in order
    by sorts that spill. Repeated rows, null ids and ties are rows of their own: __row tells them apart.
    """
    groups = _by_keyword(rules)
    table, gates = F.from_json(F.lit(json.dumps(groups)), _GROUP), F.array(*[F.lit(g) for g in sorted({g["gate"] for g in groups})]).cast("array<string>")
    own = [c for c in docs.columns if c != text_column]
    lines = docs.select(*own, F.monotonically_increasing_id().alias("__row"), words_line(F.col(text_column)).alias("__line"))
    line = F.col("__line")

    def found(rule: Column) -> Column:
        parts = F.split(F.regexp_replace(line, rule["pattern"], F.lit(f"{_OPEN}$0{_CLOSE}")), _OPEN)
        sizes = F.transform(parts, lambda p: F.struct(_halves(p).alias("words"), F.when(F.contains(p, F.lit(_CLOSE)), _halves(F.substring_index(p, _CLOSE, 1))).alias("matched")))
        return F.struct(rule.alias("rule"), sizes.alias("parts"))

    lines = lines.withColumn("__gates", F.array_intersect(F.split(line, " "), gates))
    groups_in = F.filter(table, lambda g: F.array_contains("__gates", g["gate"]) & F.contains(line, g["keyword"]) & F.rlike(line, g["needed"]))
    tried = F.when(F.size("__gates") > 0, F.filter(F.flatten(F.transform(groups_in, lambda g: F.transform(g["rules"], found))), lambda f: F.size(f["parts"]) > 1))
    rows = lines.select(*own, "__row", (_halves(line) - 1).alias("n_words"), F.explode_outer(tried).alias("f"))
    rows = rows.select(*own, "__row", "n_words", F.struct(*[F.col("f.rule")[c].alias(c) for c in ("number", "priority", "label", "base", "confidence")]).alias("rule"), F.posexplode_outer("f.parts").alias("i", "part"))
    rows = rows.repartition("__row")  # serves both windows and whatever is grouped by row
    before = Window.partitionBy("__row", "rule.number").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("start", F.coalesce(F.sum("part.words").over(before), F.lit(0))).withColumn("end", F.col("start") + F.col("part.matched")).where("i is null or part.matched is not null")
    order = Window.partitionBy("__row").orderBy("start", F.desc("end"), "rule.number").rowsBetween(Window.unboundedPreceding, -1)
    reach = [F.max(F.when(F.col("rule.priority") <= p, F.col("end"))).over(order) for p in range(1 + max((r.priority for r in rules), default=0))]
    rows = rows.withColumn("reach", F.try_element_at(F.array(*reach), F.col("rule.priority") + 1))
    kept = F.col("end").isNotNull() & (F.col("reach").isNull() | (F.col("reach") < F.col("end")))
    return rows.select(*own, "__row", "n_words", "rule", F.when(F.col("end").isNotNull(), F.col("start")).alias("start"), "end", kept.alias("kept"))


def scan(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", rules: list[Rule] = RULES) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, n_kept), a row for each row of docs.

    labels are those of kept detections and the base ones, score the highest confidence among them (0 without any). Null
    texts count as empty, null ids stay null, repeated rows are scanned each for itself, other columns are not read.
    """
    got = detections(docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text")), rules=rules)
    base = F.coalesce(F.col("rule.base"), F.lit(False))
    label = F.col("rule.label")
    counted = F.col("kept") | base
    joined = lambda when: F.array_join(F.array_sort(F.collect_set(F.when(when, label))), ",")
    return got.groupBy("__row").agg(
        F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.count(F.when(base, 1)).alias("n_base"), F.min(F.when(base, F.col("start"))).alias("first_word"),
        F.max(F.when(base, F.col("start"))).alias("last_word"), joined(base).alias("base_labels"), joined(counted).alias("labels"),
        F.coalesce(F.max(F.when(counted & label.isNotNull(), F.col("rule.confidence"))), F.lit(0.0)).alias("score"), F.count(F.when(F.col("kept") & label.isNotNull(), 1)).alias("n_kept"),
    ).drop("__row")


def op12_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The licenses that every whole text names."""
    return scan(read_table(spark, sf_dir, "documents"))


def _values() -> str:
    quoted = lambda s: "NULL" if s is None else "'" + s.replace("'", "''") + "'"
    return ",\n".join(f"({r.number}, {r.priority}, {quoted(r.keyword)}, {quoted(r.pattern)}, {quoted(r.label)}, {r.base}, {r.confidence}::double)" for r in RULES)


OP12_SQL = (
    r"""
WITH rules(number, priority, keyword, pattern, label, base, confidence) AS (VALUES """
    + _values()
    + r"""
), low AS (
  SELECT doc_id, row_number() OVER () AS id, trim(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', '  ', 'g'), ' ') AS w
  FROM documents
), lines AS (
  SELECT doc_id, id, CASE WHEN w = '' THEN '' ELSE ' ' || w || ' ' END AS line FROM low
), split AS (
  SELECT id, number, priority, label, base, confidence, string_split(regexp_replace(line, pattern, chr(1) || '\0' || chr(2), 'g'), chr(1)) AS parts
  FROM (FROM lines WHERE regexp_matches(line, '"""
    + "|".join(sorted({r.keyword for r in RULES}))
    + r"""')) JOIN rules ON contains(line, keyword)
), parts AS (
  SELECT * EXCLUDE (parts), unnest(parts) AS part, generate_subscripts(parts, 1) AS i FROM split WHERE len(parts) > 1
), sized AS (
  SELECT * EXCLUDE (part), (length(part) - length(replace(part, ' ', ''))) // 2 AS words,
         CASE WHEN contains(part, chr(2)) THEN (length(split_part(part, chr(2), 1)) - length(replace(split_part(part, chr(2), 1), ' ', ''))) // 2 END AS matched FROM parts
), placed AS (
  SELECT *, coalesce(sum(words) OVER (PARTITION BY id, number ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM sized
), found AS (
  SELECT *, start + matched AS stop FROM placed WHERE matched IS NOT NULL
), judged AS (
  SELECT *, NOT EXISTS (FROM found g WHERE g.id = f.id AND g.number <> f.number AND g.start <= f.start AND g.stop >= f.stop AND g.priority <= f.priority
                        AND (g.start < f.start OR g.stop > f.stop OR g.number < f.number)) AS kept FROM found f
), told AS (
  SELECT id, count(*) FILTER (base) AS n_base, min(start) FILTER (base) AS first_word, max(start) FILTER (base) AS last_word,
         string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base OR kept) AS labels,
         max(confidence) FILTER ((base OR kept) AND label IS NOT NULL) AS score, count(*) FILTER (kept AND label IS NOT NULL) AS n_kept
  FROM judged GROUP BY id
)
SELECT doc_id, (length(line) - length(replace(line, ' ', ''))) // 2 AS n_words, coalesce(n_base, 0) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0) AS score, coalesce(n_kept, 0) AS n_kept
FROM lines LEFT JOIN told USING (id)
"""
)
