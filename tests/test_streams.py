"""Streams that break and begin again against the batch operators."""

import os
import tempfile

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from ratebook.plans.standins import rule_frame
from ratebook.streaming import sinks
from ratebook.streaming import streams as ST


@pytest.fixture
def folder():
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp")


class Break:
    """put_batch that fails once in a batch: halfway, or after it has written and before the batch is committed."""

    def __init__(self, batch, when):
        self.batch, self.when, self.broken = batch, when, False

    def __call__(self, rows, path, batch_id):
        if batch_id == self.batch and not self.broken:
            self.broken = True
            if self.when == "halfway":
                sinks.put_batch(rows.limit(1), path, batch_id)
            elif self.when == "after":
                sinks.put_batch(rows, path, batch_id)
            raise RuntimeError("lost")
        sinks.put_batch(rows, path, batch_id)


def run_to_end(begin):
    """Begins the query again until it ends well; how often it broke."""
    for n in range(5):
        try:
            begin().awaitTermination()
            return n
        except StreamingQueryException:
            pass
    raise AssertionError("never ended")


def calls(spark, ids):
    nothing = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    rows = spark.createDataFrame([(i, 100 * i + 7) for i in ids], "call_id long, gt long")
    return rows.select("call_id", F.lit("tariff").alias("document_id"), nothing.alias("facts"), F.col("gt").cast("decimal(20,6)").alias("gross_tonnage"), F.col("call_id").cast("decimal(20,6)").alias("loa_m"))


@pytest.mark.parametrize("when", ["halfway", "after"])
def test_prices_once_whatever_breaks(spark, folder, monkeypatch, when):
    rules = rule_frame(spark, ["per_unit", "no_band"])
    monkeypatch.setattr(ST, "put_batch", Break(1, when))
    for wave in (range(90, 110), range(110, 130), range(180, 210)):
        calls(spark, wave).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    arriving = spark.readStream.schema(calls(spark, []).schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    assert run_to_end(lambda: ST.price_stream(arriving, rules, f"{folder}/out", f"{folder}/state", once=True)) == 1
    columns = ["call_id", "charge_id", "status", "amount"]
    want = sorted(map(tuple, ST.priced(spark.read.parquet(f"{folder}/in"), rules).select(*columns).collect()), key=repr)
    read = lambda: sorted(map(tuple, spark.read.parquet(f"{folder}/out").select(*columns).collect()), key=repr)
    assert len(want) == 140 and read() == want
    for name in ("2", ".2.crc"):  # the driver dies after the sink and before the commit log
        os.remove(f"{folder}/state/commits/{name}")
    assert run_to_end(lambda: ST.price_stream(arriving, rules, f"{folder}/out", f"{folder}/state", once=True)) == 0
    assert read() == want


@pytest.mark.parametrize("when", ["halfway", "after"])
def test_intake_of_known_failed_and_forced(spark, folder, monkeypatch, when):
    waves = [
        [("a", False, True), ("b", False, False), ("b", False, False), (None, False, True)],  # (checksum, force, readable)
        [("a", False, True), ("b", False, True), ("c", False, False)],
        [("a", True, False), ("a", False, True), ("b", False, True), ("c", False, False)],
        [("a", False, True), ("d", False, True), ("c", True, True), ("b", False, False)],
        [("a", False, False), ("d", False, False)],
    ]
    want = [("a", 0, "ready"), ("b", 0, "failed"), ("b", 1, "ready"), ("c", 1, "failed"), ("a", 2, "failed"), ("c", 2, "failed"), ("a", 3, "ready"), ("c", 3, "ready"), ("d", 3, "ready")]
    monkeypatch.setattr(ST, "put_batch", Break(2, when))
    schema = "checksum string, force boolean, readable boolean"

    def process(todo):
        return todo.withColumn("status", F.when(F.col("readable"), "ready").otherwise("failed")).withColumn("error", F.when(~F.col("readable"), "unreadable"))

    broke = 0
    for wave in waves:
        spark.createDataFrame(wave, schema).write.mode("append").parquet(f"{folder}/in")
        broke += run_to_end(lambda: ST.intake_stream(spark.readStream.schema(schema).parquet(f"{folder}/in"), process, f"{folder}/out", f"{folder}/state", once=True))
    attempts = spark.read.schema(ST.ATTEMPT + ", batch_id long").parquet(f"{folder}/out")
    assert broke == 1 and sorted((r.batch_id, r.checksum, r.status) for r in attempts.collect()) == sorted((b, c, s) for c, b, s in want)
    assert {(r.checksum, r.status, r.n_attempts) for r in ST.document_status(attempts).collect()} == {("a", "ready", 3), ("b", "ready", 2), ("c", "ready", 3), ("d", "ready", 1)}


def test_cache_answers_a_key_once(spark, folder, monkeypatch):
    monkeypatch.setattr(ST, "put_batch", Break(1, "after"))
    schema = "name string, key string"
    for wave in ([("compile", "a"), ("compile", "a"), ("chat", "x")], [("compile", "a"), ("compile", "b")], [("compile", "b")]):
        spark.createDataFrame(wave, schema).write.mode("append").parquet(f"{folder}/in")
        run_to_end(lambda: ST.cache_stream(spark.readStream.schema(schema).parquet(f"{folder}/in"), lambda m: m.withColumn("response", F.concat(F.lit("to "), "key")), f"{folder}/out", f"{folder}/state", once=True, names=["compile"]))
    got = spark.read.schema(ST.CACHED + ", batch_id long").parquet(f"{folder}/out").collect()
    assert sorted(map(tuple, got)) == [("a", "to a", 0), ("b", "to b", 1)]


def test_known_side_of_a_first_batch(spark, folder):
    assert sinks.earlier_batches(spark, f"{folder}/nothing", ST.ATTEMPT, 3).columns == ["checksum", "status", "error", "batch_id"]
    fresh = spark.createDataFrame([("a", "one"), ("a", "two")], "checksum string, name string")
    known = spark.createDataFrame([], "checksum string, status string")
    assert [tuple(r) for r in ST.intake(fresh, known).collect()] == [("a", "two")]
    assert ST.intake(fresh, spark.createDataFrame([("a", "ready")], "checksum string, status string")).collect() == []
    assert len(ST.intake(fresh, spark.createDataFrame([("a", "ready")], "checksum string, status string"), force=True).collect()) == 1
