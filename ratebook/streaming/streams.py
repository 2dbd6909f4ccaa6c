"""Calls priced, documents taken in and requests answered as they arrive, by the batch operators.

Every sink holds a partition for each micro-batch, so a batch that is run again after a crash replaces what it left (see sinks).
Decisions that look at the table look at the batches before.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..operators.calls import quantities
from ..operators.rating import rate
from ..operators.rulebook import cache_lookup
from .sinks import BATCH, earlier_batches, put_batch, start

__all__ = ["cache_stream", "document_status", "intake", "intake_stream", "price_stream", "priced"]

#: Rows of the intake table: one for each attempt at a document.
ATTEMPT = "checksum string, status string, error string"
CACHED = "key string, response string"


def priced(calls: DataFrame, rules: DataFrame) -> DataFrame:
    """Calls (call_id, document_id, facts and the fields of quantities) priced by the rules of their document; a batch or a stream.

    rules (document_id, charge_id, rule, and plan if they are prepared) are the current rulebook, the static side.
    """
    own = quantities(calls).select("call_id", "document_id", "facts", "quantities", "assumptions")
    return rate(own.join(rules, "document_id").drop("document_id"))


def price_stream(calls: DataFrame, rules: DataFrame, path: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Every line item, failures too, to path as calls arrive, each batch once.

    The pricing is part of the streaming plan: it is built and analysed when the query starts, and batches only write.
    """
    return start(priced(calls, rules), checkpoint, lambda batch, batch_id: put_batch(batch, path, batch_id), once)


def document_status(attempts: DataFrame) -> DataFrame:
    """(checksum, status, n_attempts) of attempts (checksum, status, batch_id): the last one's status; a maximum by batch, not a sort."""
    return attempts.groupBy("checksum").agg(F.max_by("status", BATCH).alias("status"), F.count(F.lit(1)).alias("n_attempts"))


def intake(fresh: DataFrame, known: DataFrame, force: bool = False) -> DataFrame:
    """The documents of fresh (checksum, …, and force where single ones are forced) to be processed, once each.

    Those that are unknown, whose last attempt failed, or that are forced. known has checksum and status (of
    attempts, the last one's: document_status). Of repeats within fresh a forced one counts; others with null checksum are
    documents without content and are left out.
    """
    asked = fresh.where("checksum is not null").withColumn("__force", F.lit(force) | (F.coalesce("force", F.lit(False)) if "force" in fresh.columns else F.lit(False)))
    rest = [c for c in fresh.columns if c != "checksum"]
    once = asked.groupBy("checksum").agg(F.max(F.struct("__force", F.struct(*rest).alias("row") if rest else F.lit(0).alias("row"))).alias("d"))
    done = known.where("status = 'ready'").select("checksum").distinct().withColumn("__done", F.lit(True))
    todo = once.join(done, "checksum", "left").where("d.__force or __done is null")
    return todo.select(*[F.col("checksum") if c == "checksum" else F.col("d.row")[c].alias(c) for c in fresh.columns])


def intake_stream(documents: DataFrame, process: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Documents (checksum, …, force) as they arrive: those to be done go through process, and each attempt is a row of path.

    process gives checksum, status (ready or failed) and error. The same bytes are done once, however often they come;
    a failed document is tried again when it comes again, a forced one whatever its status. What is known is the table itself, up to
    the batch before, so the stream holds no state that grows.
    """
    spark = documents.sparkSession

    def write(batch: DataFrame, batch_id: int) -> None:
        known = document_status(earlier_batches(spark, path, ATTEMPT, batch_id))
        put_batch(process(intake(batch, known)).select("checksum", "status", "error"), path, batch_id)

    return start(documents, checkpoint, write, once)


def cache_stream(requests: DataFrame, answer: Callable[[DataFrame], DataFrame], cache_path: str, checkpoint: str, once: bool = False, names: list[str] | None = None) -> StreamingQuery:
    """Requests (name, key, …): misses are answered once each and added to the cache, a batch's as its own partition. A key is there once."""
    spark: SparkSession = requests.sparkSession

    def write(batch: DataFrame, batch_id: int) -> None:
        _, misses = cache_lookup(batch, earlier_batches(spark, cache_path, CACHED, batch_id), names)
        put_batch(answer(misses).select("key", "response"), cache_path, batch_id)

    return start(requests, checkpoint, write, once)
