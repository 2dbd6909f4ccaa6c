"""Helpers that the training-data operators share."""

from __future__ import annotations

import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

__all__ = [
    "BITMAP_WORDS",
    "bitmap_has",
    "bounded",
    "fold_held_out",
    "hashed_bitmap",
    "read_table",
    "scratch_dir",
    "shuffled",
    "stored",
    "text_batches",
]

#: Rows of a few numbers that the driver may gather for a broadcast; the hash table it builds takes some 100 bytes for each.
BROADCAST_ROWS = 100_000
#: 64-bit words of a membership bitmap: 2**18 words are 2**24 bits or 2 MB, whatever the data's size.
BITMAP_WORDS = 1 << 18


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a new local one where that is unset and all run in one JVM (tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="ratebook-")
        spark.sparkContext.setCheckpointDir(root)
    if ":/" not in root:  # Spark reads such a path by its default file system, other readers don't know that
        path = spark._jvm.org.apache.hadoop.fs.Path(root)
        root = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return re.sub("^file:/+", "file:///", root.rstrip("/"))


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder; nothing is made there yet."""
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, **options: str) -> DataFrame:
    """df written as Parquet in the shared folder and read again, so that what follows doesn't depend on any executor's disk."""
    spark = df.sparkSession
    path = scratch_dir(spark, name)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffled(df: DataFrame) -> DataFrame:
    """df for a join by shuffles of both sides: tables that follow the input are never gathered on the driver to be broadcast.

    Spark judges a table by its files, which repeated values make far smaller than the hash table that the driver builds from them.
    """
    return df.hint("merge")


def bounded(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """The stored df for a join: with more than `most` rows by shuffles, else as Spark likes, so that large rows on the other side may stay where they are."""
    return df if df.limit(most + 1).count() <= most else shuffled(df)


def fold_held_out(doc_id: Column) -> Column:
    """True for the fifth of the rows that no model may learn from: crc32 of the id's text is divisible by 5."""
    return F.coalesce(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0, F.lit(True))


def hashed_bitmap(hashes: DataFrame, column: str, words: int = BITMAP_WORDS) -> np.ndarray:
    """A bitmap of `words` 64-bit words in which each 64-bit hash of the column sets two bits.

    It is built by one aggregation; at most `words` rows reach the driver however many hashes there are. A hash that was
    put in always tests true (bitmap_has); others may, so what passes has to be joined exactly afterwards.
    """
    bits = words * 64
    h = F.col(column)
    slots = hashes.where(h.isNotNull()).select(F.explode(F.array(F.pmod(h, F.lit(bits)), F.pmod(F.shiftrightunsigned(h, 32), F.lit(bits)))).alias("slot"))
    parts = slots.groupBy(F.shiftright("slot", 6).cast("int").alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(slot & 63 as int)))").alias("bits"))
    table = parts.toArrow()
    out = np.zeros(words, dtype=np.uint64)
    if table.num_rows:
        out[table["word"].to_numpy()] = table["bits"].to_numpy().view(np.uint64)
    return out


def bitmap_has(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which of the uint64 hashes may be in a bitmap made by hashed_bitmap."""
    mask = np.uint64(bitmap.size * 64 - 1)
    one, six, low = np.uint64(1), np.uint64(6), np.uint64(63)
    a = hashes & mask
    found = (bitmap[a >> six] >> (a & low)) & one
    maybe = np.flatnonzero(found)
    b = (hashes[maybe] >> np.uint64(32)) & mask
    out = np.zeros(hashes.size, dtype=bool)
    out[maybe[((bitmap[b >> six] >> (b & low)) & one).astype(bool)]] = True
    return out


def text_batches(batch: pa.RecordBatch, column: str, limit: int = 4_000_000):
    """(first row, texts) slices of an Arrow batch that hold about `limit` characters each, so that memory doesn't follow the batch; null counts as empty."""
    start, size, texts = 0, 0, []
    for i, text in enumerate(batch.column(column)):
        text = text.as_py() or ""
        texts.append(text)
        size += len(text)
        if size >= limit:
            yield start, texts
            start, size, texts = i + 1, 0, []
    if texts:
        yield start, texts
