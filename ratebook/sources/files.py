"""Reading profiles, rules, documents and rulebooks; writing rules, rulebooks, history and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.schemas import RULE
from ..operators.rating import prepared

__all__ = ["append_history", "append_steps", "find_rulebook", "read_binary_documents", "read_profiles", "read_rulebooks", "read_rules", "write_report", "write_rulebooks", "write_rules"]


def read_profiles(spark: SparkSession, path: str) -> DataFrame:
    """(call_id, profile): each JSON file under path as one text; numbers stay as printed. call_id is the folder's (call_id=…), else the file's name."""
    files = spark.read.text(path, wholetext=True).coalesce(4 * spark.sparkContext.defaultParallelism)  # else a task for each few small files
    named = F.col("call_id").cast("string") if "call_id" in files.columns else F.regexp_replace(F.col("_metadata.file_name"), "\\.json$", "")
    return files.select(named.alias("call_id"), F.col("value").alias("profile"))


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    """(file, charge_id, rule, plan) of a folder of rule JSON files, prepared for rating; an empty folder is an error."""
    files = spark.read.text(path, wholetext=True, pathGlobFilter="*.{json,txt}", recursiveFileLookup=True)
    rules = files.select(F.col("_metadata.file_name").alias("file"), F.from_json("value", RULE).alias("rule"))
    if rules.isEmpty():
        raise FileNotFoundError(f"no rules in {path}")
    return prepared(rules.select("file", F.col("rule.charge_id").alias("charge_id"), "rule"))


def read_binary_documents(spark: SparkSession, path: str, suffix: str = "pdf") -> DataFrame:
    """(path, file, size, checksum, content) of documents with the suffix, checksums as they are used against repeated intake."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*.{suffix}").option("recursiveFileLookup", True).load(path)
    return files.select("path", F.element_at(F.split("path", "/"), -1).alias("file"), F.col("length").alias("size"), F.sha2("content", 256).alias("checksum"), "content")


def write_rules(rules: DataFrame, path: str) -> None:
    """Rules as JSON in a folder for each charge."""
    rules.select(F.col("charge_id").alias("charge"), F.to_json("rule").alias("value")).write.mode("overwrite").partitionBy("charge").text(path)


def write_rulebooks(rulebooks: DataFrame, path: str) -> None:
    """(document_id, rulebook) as a JSON text in a folder for each document."""
    rulebooks.select("document_id", F.col("rulebook").alias("value")).write.mode("overwrite").partitionBy("document_id").text(path)


def read_rulebooks(spark: SparkSession, path: str) -> DataFrame:
    """(file, rulebook) of every file below path, each as one text."""
    return spark.read.text(path, wholetext=True, recursiveFileLookup=True).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("rulebook"))


def find_rulebook(spark: SparkSession, path: str) -> DataFrame:
    """(checksum, file, rulebook) of the first file by name for each checksum; files that aren't JSON are left out."""
    read = read_rulebooks(spark, path).withColumn("checksum", F.get_json_object("rulebook", "$.checksum")).where("checksum is not null")
    return read.groupBy("checksum").agg(F.min(F.struct("file", "rulebook")).alias("f")).select("checksum", "f.file", "f.rulebook")


def append_history(items: DataFrame, path: str) -> None:
    """Results, failures among them, appended by port."""
    items.write.mode("append").partitionBy("port_key").parquet(path)


def append_steps(steps: DataFrame, path: str) -> None:
    """Step rows (calculation_id, step_no, charge_id, node, tool, input_summary, output, latency_ms, tokens …) appended by node; output of any shape is kept as JSON."""
    kind = steps.schema["output"].dataType.typeName()
    output = F.to_json("output") if kind in ("struct", "map", "array", "variant") else F.col("output").cast("string")
    steps.withColumn("output", output).write.mode("append").partitionBy("node").parquet(path)


def write_report(report: DataFrame, path: str) -> None:
    report.write.mode("overwrite").json(path)
