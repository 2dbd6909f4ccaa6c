"""Streams over the given tables, run to their end, and written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import rulebook as RB
from ..operators.shared import scratch as _scratch
from ..streaming import streams as ST
from .standins import rule_frame, table

__all__ = ["ORACLES", "QUERIES"]


def stream_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST-1, IO-8: events as calls that arrive, priced against the rulebook by the batch function."""
    schema = table(spark, sf_dir, "events").schema
    arriving = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet*")
    nothing = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    calls = arriving.select(F.col("event_id").alias("call_id"), F.lit("tariff").alias("document_id"), nothing.alias("facts"), (F.col("user_id") * 10 + 7).cast("decimal(20,6)").alias("gross_tonnage"), (F.col("user_id") % 300).cast("decimal(20,6)").alias("loa_m"))
    out = _scratch(spark, "prices")
    ST.price_stream(calls, rule_frame(spark, ["per_unit", "no_band"]), out, _scratch(spark, "prices-state"), once=True).awaitTermination()
    return spark.read.parquet(out).select("call_id", "charge_id", "status", F.col("amount").cast("double").alias("amount"))


def _arrivals(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    """Documents in four waves that overlap, the last one forced: (checksum, wave, n_chars, force)."""
    docs = table(spark, sf_dir, "documents").withColumn("checksum", F.sha2(F.coalesce("text", F.lit("")), 256))
    waves = ["doc_id % 2 = 0", "doc_id % 3 = 0", "true", "n_chars % 4 = 0"]
    return [docs.where(w).select("checksum", F.lit(i).alias("wave"), "n_chars", F.lit(i == 3).alias("force")) for i, w in enumerate(waves)]


def _taken_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attempts at the documents of all waves: each wave arrives, the stream runs until it is done with it, and begins again with the next."""
    arrivals, out, state = _scratch(spark, "arrivals"), _scratch(spark, "intake"), _scratch(spark, "intake-state")

    def process(todo: DataFrame) -> DataFrame:
        """Reading fails in the first two waves for every fifth size."""
        fails = (F.col("wave") < 2) & F.coalesce(F.col("n_chars") % 5 == 0, F.lit(False))
        return todo.select("checksum", F.when(fails, "failed").otherwise("ready").alias("status"), F.when(fails, "unreadable").alias("error"))

    for wave in _arrivals(spark, sf_dir):
        wave.write.mode("append").parquet(arrivals)
        ST.intake_stream(spark.readStream.schema(wave.schema).parquet(arrivals), process, out, state, once=True).awaitTermination()
    return spark.read.schema(f"{ST.ATTEMPT}, batch_id long").parquet(out)


def stream_intake(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST-2: documents taken in once for each checksum, over waves with known, failed and forced ones; in the end all are ready."""
    return ST.document_status(_taken_in(spark, sf_dir)).select("checksum", "status")


def intake_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST-2: how often each checksum was tried: known ones not again, failed ones when they come again, forced ones always."""
    return _taken_in(spark, sf_dir).groupBy("checksum").agg(F.count(F.lit(1)).alias("n_attempts"), F.count_if(F.col("status") == "failed").alias("n_failed"), F.min("batch_id").alias("first_batch"), F.max("batch_id").alias("last_batch"))


def exported_rulebooks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """IO-4, IO-5, IO-7: rulebooks of the parts' brands written as JSON files and found again by checksum."""
    from ..sources import files as IO

    part = table(spark, sf_dir, "part")
    documents = part.select(F.col("p_brand").alias("document_id")).distinct().select("document_id", F.sha2("document_id", 256).alias("checksum"), F.col("document_id").alias("title"), F.lit("EUR").alias("currency"), F.array(F.lit("main")).alias("ports"), F.lit(None).cast("date").alias("effective_from"), F.lit(None).cast("date").alias("effective_to"))
    catalogue = part.select(F.col("p_brand").alias("document_id"), F.col("p_partkey").alias("charge_id"), F.col("p_name").alias("name"), F.array(F.col("p_size").cast("string")).alias("section_refs"), F.lit("vessel").alias("payer"), F.lit("per_call").alias("trigger"))
    rules = part.where("p_size > 25").select(F.col("p_brand").alias("document_id"), F.lit("main").alias("port_key"), F.col("p_partkey").alias("charge_id"), F.lit("v1").alias("prompt_version"), F.struct("p_size").alias("rule"))
    path = _scratch(spark, "rulebooks")
    IO.write_rulebooks(RB.export_rulebooks(documents, catalogue, rules), path)
    found = IO.find_rulebook(spark, path)
    book = F.from_json("rulebook", "profile struct<title:string>, catalogue array<struct<charge_id:bigint>>, rules array<struct<charge_id:bigint>>").alias("b")
    return found.select("checksum", book).select("checksum", F.col("b.profile.title").alias("title"), F.size("b.catalogue").cast("long").alias("n_charges"), F.coalesce(F.size("b.rules"), F.lit(0)).cast("long").alias("n_rules"))


QUERIES = {"stream_prices": stream_prices, "stream_intake": stream_intake, "intake_attempts": intake_attempts, "exported_rulebooks": exported_rulebooks}
ORACLES = {
    "stream_prices": """WITH c AS (SELECT event_id AS call_id, user_id * 10 + 7 AS gt, user_id % 300 AS loa FROM events) SELECT call_id, 'per_unit' AS charge_id, 'charged' AS status, ((gt + 99) // 100) * 11840 / 100.0 AS amount FROM c
UNION ALL SELECT call_id, 'no_band', CASE WHEN loa BETWEEN 100 AND 200 THEN 'charged' ELSE 'failed' END, CASE WHEN loa BETWEEN 100 AND 200 THEN 75.0 END FROM c""",
    "stream_intake": "SELECT DISTINCT sha256(coalesce(text, '')) AS checksum, 'ready' AS status FROM documents",
    "intake_attempts": """WITH d AS (SELECT sha256(coalesce(text, '')) AS checksum, doc_id, n_chars FROM documents),
e AS (
  SELECT checksum, 0 AS wave, false AS forced, max(n_chars) AS n FROM d WHERE doc_id % 2 = 0 GROUP BY 1 UNION ALL SELECT checksum, 1, false, max(n_chars) FROM d WHERE doc_id % 3 = 0 GROUP BY 1
  UNION ALL SELECT checksum, 2, false, max(n_chars) FROM d GROUP BY 1 UNION ALL SELECT checksum, 3, true, max(n_chars) FROM d WHERE n_chars % 4 = 0 GROUP BY 1
), f AS (SELECT *, wave < 2 AND coalesce(n % 5 = 0, false) AS fails FROM e),
g AS (SELECT *, forced OR NOT coalesce(bool_or(NOT fails) OVER (PARTITION BY checksum ORDER BY wave ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS tried FROM f)
SELECT checksum, count(*) AS n_attempts, count(*) FILTER (fails) AS n_failed, CAST(min(wave) AS BIGINT) AS first_batch, CAST(max(wave) AS BIGINT) AS last_batch FROM g WHERE tried GROUP BY checksum""",
    "exported_rulebooks": "SELECT sha256(p_brand) AS checksum, p_brand AS title, count(*) AS n_charges, count(*) FILTER (p_size > 25) AS n_rules FROM part GROUP BY p_brand",
}
