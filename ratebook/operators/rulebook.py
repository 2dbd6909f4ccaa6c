"""The rulebook's lifecycle: rules in use, lookups, caches, exports, intake by checksum."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import held

__all__ = [
    "best_revision", "cache_lookup", "candidates_with_rules", "compile_report", "export_rulebooks", "import_decisions", "numbered", "rebuild", "request_key", "rules_in_use", "section_order",
    "unknown_ids", "unique_ids",
]


def rules_in_use(rows: DataFrame, prompt_version: str, schema_version: int, reuse_older: bool = True) -> DataFrame:
    """The rule in use of each (document_id, port_key, charge_id) at the schema version.

    A rule under the current prompts, else (if reuse is on) one under older prompts, else a failure (null rule) under the
    current prompts; the newest rule_id of the best kind. It is a maximum, so it is aggregated without a sort.
    """
    has, now = F.col("rule").isNotNull(), F.col("prompt_version") == prompt_version
    rank = F.when(has & now, 3).when(has & F.lit(reuse_older), 2).when(now, 1).otherwise(0)
    ranked = rows.where(F.col("schema_version") == schema_version).withColumn("rank", rank).where("rank > 0")
    keys = ["document_id", "port_key", "charge_id"]
    best = ranked.groupBy(*keys).agg(F.max(F.struct("rank", "rule_id")).alias("b")).select("b.rule_id", "b.rank")
    return ranked.drop("rank").join(best, "rule_id")


def candidates_with_rules(candidates: DataFrame, rules: DataFrame) -> DataFrame:
    """candidates left joined to the rules in use; error names why there is none to price by."""
    joined = candidates.join(rules.select("document_id", "port_key", "charge_id", "rule", F.lit(True).alias("__has")), ["document_id", "port_key", "charge_id"], "left")
    return joined.withColumn("error", F.when(F.col("__has").isNull(), "no rule compiled").when(F.col("rule").isNull(), "compilation failed")).drop("__has")


def unknown_ids(asked: DataFrame, known: DataFrame, column: str = "charge_id") -> DataFrame:
    """Asked ids that aren't known."""
    return asked.join(known.select(column).distinct(), column, "left_anti").distinct()


def request_key(*columns: str) -> Column:
    """The content hash of a request: SHA-256 of its columns, sorted by name, as JSON."""
    return F.sha2(F.to_json(F.struct(*[F.col(c) for c in sorted(columns)])), 256)


def cache_lookup(requests: DataFrame, cache: DataFrame, names: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(hits, misses): requests (name, key) with the cached response, and each missing key once. Only listed names are cached."""
    usable = requests if names is None else requests.where(F.col("name").isin(names))
    hits = usable.join(cache.select("key", "response"), "key")
    misses = usable.join(cache.select("key"), "key", "left_anti").dropDuplicates(["key"])
    return hits, misses


def best_revision(attempts: DataFrame) -> DataFrame:
    """(charge_id, attempt, outcome): the revision with the fewest blocking issues among the approved, the earliest on ties; else the last that was grounded, as low_confidence; else failed.

    attempts has charge_id, attempt, grounded and n_blocking (null if it wasn't reviewed).
    """
    out = attempts.groupBy("charge_id").agg(
        F.min(F.when(F.col("grounded") & F.col("n_blocking").isNotNull(), F.struct("n_blocking", "attempt"))).alias("best"),
        F.max(F.when(F.col("grounded"), F.col("attempt"))).alias("last"),
    )
    outcome = F.when(F.col("best.n_blocking") == 0, "approved").when(F.col("best").isNotNull() | F.col("last").isNotNull(), "low_confidence").otherwise("failed")
    return out.select("charge_id", F.coalesce("best.attempt", "last").alias("attempt"), outcome.alias("outcome"))


def compile_report(outcomes: DataFrame) -> DataFrame:
    """Outcomes by status: how many, how many freshly compiled, tokens."""
    return outcomes.groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("cached")).alias("n_fresh"), F.sum("tokens").alias("tokens"))


def section_order(refs: Column) -> Column:
    """A sort key: the first section ref's parts as integers, 0 for what isn't one."""
    first = F.coalesce(F.get(refs, F.lit(0)), F.lit(""))
    return F.transform(F.split(first, "\\."), lambda p: F.coalesce(p.try_cast("int"), F.lit(0)))


def numbered(rows: DataFrame, *order: str, name: str = "pos") -> DataFrame:
    """rows with their position, from 1, among all rows in the order of the columns, which tell the rows apart.

    Rows are dealt by ranges of the order and written with the number of their range, as a second reading could draw other ranges; each
    is numbered for itself and begins after the rows in those before. Only a count for each range reaches the driver.
    """
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = held(rows.repartitionByRange(parts, *order).withColumn("__part", F.spark_partition_id()), "ranges")
    before, offsets = 0, []
    for part, n in sorted(map(tuple, dealt.groupBy("__part").count().collect())):
        offsets.append((part, before))
        before += n
    starts = spark.createDataFrame(offsets, "__part int, __before long")
    own = F.row_number().over(Window.partitionBy("__part").orderBy(*order))
    return dealt.withColumn("__own", own).join(F.broadcast(starts), "__part").withColumn(name, F.col("__before") + F.col("__own")).drop("__part", "__own", "__before")


def unique_ids(rows: DataFrame, by: str, order: str, id_column: str = "charge_id") -> DataFrame:
    """(by, order, id_column, unique_id): rows with repeated ids of a group renamed: the second gets _2, the third _3, skipping ids that stand earlier in the group.

    Which suffix is free depends on the names given before, so a group goes through one task in order; it is streamed. What stays is the set
    of names and, for each repeated id, the next suffix to try: names are never given back, so that only grows, and a group takes
    linear time however often an id repeats. Ties of order go by id; null ids stay null.
    """
    group, place = rows.schema[by].dataType.simpleString(), rows.schema[order].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begun, now, seen, suffix = False, None, set(), {}
        for batch in batches:
            out: list[str | None] = []
            for g, name in zip(batch.column(by).to_pylist(), batch.column(id_column).to_pylist(), strict=True):
                if not begun or g != now:
                    begun, now, seen, suffix = True, g, set(), {}
                free = name
                if name in seen:
                    n = suffix.get(name, 2)
                    while (free := f"{name}_{n}") in seen:
                        n += 1
                    suffix[name] = n + 1
                if free is not None:
                    seen.add(free)
                out.append(free)
            yield pa.RecordBatch.from_arrays([batch.column(by), batch.column(order), batch.column(id_column), pa.array(out, pa.string())], names=[by, order, id_column, "unique_id"])

    dealt = rows.select(by, order, F.col(id_column).cast("string").alias(id_column)).repartition(by).sortWithinPartitions(by, order, id_column)
    return dealt.mapInArrow(run, f"`{by}` {group}, `{order}` {place}, `{id_column}` string, unique_id string")


def export_rulebooks(documents: DataFrame, catalogue: DataFrame, rules: DataFrame, cited: DataFrame | None = None, schema_version: int = 1, prompt_version: str | None = None) -> DataFrame:
    """(document_id, rulebook): JSON of the profile, the catalogue by charge, the rules in use by (port, charge), and the ordinals of the chunks that they cite.

    cited has document_id, chunk_id and ordinal of cited chunks; without it no ordinals are exported. prompt_version is the current one, for
    entries that name none.
    """
    entries = catalogue.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("charge_id", "name", "section_refs", "payer", "trigger"))).alias("catalogue"))
    own = rules.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("port_key", "charge_id", "prompt_version", F.to_json("rule").alias("rule")))).alias("rules"))
    profile = F.struct("title", "currency", "ports", "effective_from", "effective_to").alias("profile")
    joined = documents.select("document_id", "checksum", profile).join(entries, "document_id", "left").join(own, "document_id", "left")
    parts = ["checksum", "profile", "catalogue", "rules"]
    if cited is not None:
        places = cited.distinct().groupBy("document_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("chunk_id").cast("string"), "ordinal")))).alias("ordinals"))
        joined, parts = joined.join(places, "document_id", "left"), [*parts, "ordinals"]
    return joined.select("document_id", "checksum", F.to_json(F.struct(F.lit(1).alias("format"), F.lit(schema_version).alias("schema_version"), F.lit(prompt_version).alias("prompt_version"), *parts)).alias("rulebook"))


def import_decisions(files: DataFrame, documents: DataFrame, with_rules: DataFrame, format_version: int, schema_version: int, prompt_version: str, reuse_older: bool) -> DataFrame:
    """files (checksum, format, schema_version, prompt_version) with reason, null for those to load: the first objection in order.

    Wrong format, wrong schema, other prompts while reuse is off, a document that is unknown or not ready, or that has rules.
    """
    known = documents.select("checksum", "document_id", "status")
    loaded = with_rules.select("document_id").distinct().withColumn("__has", F.lit(True))
    joined = files.join(known, "checksum", "left").join(loaded, "document_id", "left")
    reason = (
        F.when(~F.col("format").eqNullSafe(F.lit(format_version)), "format").when(~F.col("schema_version").eqNullSafe(F.lit(schema_version)), "schema")
        .when(~F.col("prompt_version").eqNullSafe(F.lit(prompt_version)) & F.lit(not reuse_older), "prompts")
        .when(F.col("document_id").isNull() | (F.col("status") != "ready"), "document").when(F.col("__has"), "has_rules")
    )
    return joined.withColumn("reason", reason).drop("__has")


def rebuild(table: DataFrame, fresh: DataFrame, key: str = "document_id") -> DataFrame:
    """table with the rows of fresh's documents replaced by fresh."""
    return table.join(fresh.select(key).distinct(), key, "left_anti").unionByName(fresh)


def first_shown(rows: DataFrame, by: list[str], order: str) -> DataFrame:
    """rows with first: whether this is the first time that the group shows it."""
    return rows.withColumn("first", F.row_number().over(Window.partitionBy(*by).orderBy(order)) == 1)
