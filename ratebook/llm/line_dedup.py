"""Line dedup across documents: deletion-neighbourhood keys, verified edit distance, the earliest line stays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bitmap_has, hashed_bitmap, read_table, stored

__all__ = ["dedupe_lines", "drop_repeated_lines", "kept_lines", "op10_line_dedup"]

#: Characters that are cut from a line's ends before lines are compared.
BLANKS = " \t\r\x0b\x0c"
#: Characters of a line whose variants are made at a time.
VARIANT_CHARS = 1 << 16
LAST = (1 << 63) - 1
#: What tells the lines of all rows apart.
PLACE = ["id", "copy", "line"]

_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)


def _half_keys(line: str) -> tuple[int, int, int, int]:
    """Hashes of the halves of the line, cut as lines of its length and as lines one shorter are cut.

    Of two lines at edit distance 1, the longer agrees with the shorter's first half or with its last: they share a key.
    """
    n, digest = len(line), xxhash.xxh3_64_intdigest
    out = []
    for m in (n, n - 1):
        head = m // 2
        out.append(digest(line[:head].encode("utf-8", "surrogatepass"), 2 * m))
        out.append(digest(line[n - (m - head) :].encode("utf-8", "surrogatepass"), 2 * m + 1))
    return tuple(out)


def _lines(docs: DataFrame) -> DataFrame:
    """(id, copy, line, h1, h2, k0..k3) for every line that isn't blank: its place, a 128-bit hash of it, and the keys of its halves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, copies, numbers, digests, keys = [], [], [], [], []
            for doc, copy, text in zip(batch.column("id").to_pylist(), batch.column("copy").to_pylist(), batch.column("text"), strict=True):
                for number, line in enumerate((text.as_py() or "").split("\n")):
                    if line := line.strip(BLANKS):
                        ids.append(doc)
                        copies.append(copy)
                        numbers.append(number)
                        digests.append(xxhash.xxh3_128_digest(line.encode("utf-8", "surrogatepass")))
                        keys.append(_half_keys(line))
            h = np.frombuffer(b"".join(digests), dtype=np.int64).reshape(-1, 2)
            k = np.array(keys, dtype=np.uint64).reshape(-1, 4).view(np.int64)
            columns = [pa.array(ids, pa.int64()), pa.array(copies, pa.int64()), pa.array(numbers, pa.int32()), pa.array(h[:, 0]), pa.array(h[:, 1])]
            columns += [pa.array(np.ascontiguousarray(k[:, i])) for i in range(4)]
            yield pa.RecordBatch.from_arrays(columns, names=[*PLACE, "h1", "h2", "k0", "k1", "k2", "k3"])

    return docs.mapInArrow(run, "id long, copy long, line int, h1 long, h2 long, k0 long, k1 long, k2 long, k3 long")


def _texts_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(id, copy, line, content) of the lines whose places are in wanted (id, copy, line, h1): a second pass over the documents.

    A bitmap of fixed size of the wanted hashes keeps most other lines from leaving the pass; the join is exact.
    """
    bitmap = docs.sparkSession.sparkContext.broadcast(hashed_bitmap(wanted.select("h1"), "h1"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, copies, numbers, found, digests = [], [], [], [], []
            for doc, copy, text in zip(batch.column("id").to_pylist(), batch.column("copy").to_pylist(), batch.column("text"), strict=True):
                for number, line in enumerate((text.as_py() or "").split("\n")):
                    if line := line.strip(BLANKS):
                        ids.append(doc)
                        copies.append(copy)
                        numbers.append(number)
                        found.append(line)
                        digests.append(xxhash.xxh3_128_digest(line.encode("utf-8", "surrogatepass"))[:8])
            take = np.flatnonzero(bitmap_has(bitmap.value, np.frombuffer(b"".join(digests), dtype=np.uint64)))
            yield pa.RecordBatch.from_arrays(
                [pa.array([ids[i] for i in take], pa.int64()), pa.array([copies[i] for i in take], pa.int64()), pa.array([numbers[i] for i in take], pa.int32()), pa.array([found[i] for i in take], pa.string())],
                names=[*PLACE, "content"],
            )

    return docs.mapInArrow(run, "id long, copy long, line int, content string").dropDuplicates(PLACE).join(wanted.select(PLACE), PLACE)


def _variant_hashes(line: str) -> Iterator[tuple[int, np.ndarray]]:
    """(first place, hashes) of a line's variants, VARIANT_CHARS places at a time: at -1 of the whole line, then without the character at each place."""
    codes = np.frombuffer(line.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    n, block = codes.size, VARIANT_CHARS
    powers = np.cumprod(np.concatenate(([np.uint64(1)], np.full(min(block, n) - 1, _BASE, dtype=np.uint64))), dtype=np.uint64)

    def upto(start: int) -> np.ndarray:
        """Sums of the terms of this block, the last one over all of it."""
        c = codes[start : start + block].astype(np.uint64) + np.uint64(1)
        c *= np.uint64(0xBF58476D1CE4E5B9)
        c ^= c >> np.uint64(29)
        return np.concatenate(([np.uint64(0)], np.cumsum(c * powers[: c.size] * np.uint64(pow(_BASE, start, 1 << 64)), dtype=np.uint64)))

    sums = [upto(start)[-1] for start in range(0, n, block)]
    before = np.concatenate(([np.uint64(0)], np.cumsum(np.array(sums, dtype=np.uint64), dtype=np.uint64)))
    whole = before[-1]
    yield -1, np.array([whole ^ np.uint64(n)], dtype=np.uint64)
    for i, start in enumerate(range(0, n, block)):
        own = before[i] + upto(start)
        yield start, (own[:-1] + (whole - own[1:]) * np.uint64(_BASE_INVERSE)) ^ np.uint64(n - 1)


def _variants(texts: DataFrame) -> DataFrame:
    """(id, copy, line, h, at): hashes of the line itself (at -1) and of the line without the character at each place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for batch in batches:
                held, size = [], 0

                def made() -> pa.RecordBatch:
                    sizes = [h.size for *_, h in held]
                    columns = [np.repeat(np.array([x[i] for x in held], dtype=kind), sizes) for i, kind in enumerate((np.int64, np.int64, np.int32))]
                    columns += [np.concatenate([h for *_, h in held]).view(np.int64), np.concatenate([np.arange(x[3], x[3] + n, dtype=np.int32) for x, n in zip(held, sizes, strict=True)])]
                    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=[*PLACE, "h", "at"])

                for doc, copy, number, line in zip(*(batch.column(c) for c in (*PLACE, "content")), strict=True):
                    for at, h in _variant_hashes(line.as_py()):
                        held.append((doc.as_py(), copy.as_py(), number.as_py(), at, h))
                        size += h.size
                        if size >= 4 * VARIANT_CHARS:
                            yield made()
                            held, size = [], 0
                if held:
                    yield made()

    return texts.mapInArrow(run, "id long, copy long, line int, h long, at int")


def _near_repeats(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """(id, copy, line) of first occurrences that have an earlier line, of other wording, within one edit.

    Lines that share a half with another line are candidates. Their deletion variants meet by hash. All lines of a variant
    and place differ by one substitution at most, and all lines of which one deletion gives a line are one edit from that line;
    so the earliest of such a group stands for the others, and no pairs within it are made. Each line's witnesses are
    then verified by edit distance.
    """
    keys = classes.select("h1", F.explode(F.array("k0", "k1", "k2", "k3")).alias("k"))
    shared = keys.groupBy("k").agg(F.min("h1").alias("lo"), F.max("h1").alias("hi")).where("lo <> hi").select("k")
    candidates = keys.join(shared, "k", "left_semi").select("h1").distinct()
    wanted = stored(classes.select(*PLACE, "h1").join(candidates, "h1", "left_semi"), "candidates")
    texts = stored(_texts_of(docs, wanted), "candidate-lines")
    place = F.struct(*PLACE)
    by_hash, by_place = Window.partitionBy("h"), Window.partitionBy("h", "at")
    met = _variants(texts).withColumns({
        "twin": F.min(place).over(by_place),
        "shorter": F.min(F.when(F.col("at") < 0, place)).over(by_hash),
        "longer": F.min(F.when(F.col("at") >= 0, place)).over(by_hash),
    })
    witness = F.explode(F.array_compact(F.array(F.when(F.col("at") >= 0, F.col("twin")), F.when(F.col("at") >= 0, F.col("shorter")), F.when(F.col("at") < 0, F.col("longer")))))
    pairs = met.where((F.col("twin") < place) | (F.col("shorter") < place) | (F.col("longer") < place)).select(*PLACE, witness.alias("w")).where(F.col("w") < place).distinct()
    first = texts.select(*[F.col(c).alias(f"w_{c}") for c in PLACE], F.col("content").alias("w_content"))
    checked = pairs.select(*PLACE, *[F.col(f"w.{c}").alias(f"w_{c}") for c in PLACE]).join(first, [f"w_{c}" for c in PLACE]).join(texts, PLACE)
    return checked.where(F.levenshtein("content", "w_content", 1) >= 0).select(PLACE).distinct()


def _key(id_column: str, text_column: str) -> list[Column]:
    """id, LAST for null, and copy, which tells rows of one id and different texts apart."""
    return [F.coalesce(F.col(id_column).cast("long"), F.lit(LAST)).alias("id"), F.xxhash64(F.col(text_column).cast("string")).alias("copy")]


def kept_lines(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", max_edits: int = 1) -> DataFrame:
    """(id, copy, kept): the numbers, from 0, of the lines of each document that stay and aren't blank; documents without any are absent.

    A line of any length goes if it equals an earlier one or, with max_edits 1, is one edit from an earlier one; earlier means a smaller id, then a smaller copy (the hash of the text), then a smaller line number. Lines are compared
    without BLANKS at their ends. Rows that repeat an id and its text count as one document; a null id comes last. max_edits
    is 0 or 1.
    """
    if max_edits not in (0, 1):
        raise ValueError("max_edits is 0 or 1")
    source = docs.select(*_key(id_column, text_column), F.col(text_column).cast("string").alias("text"))
    lines = _lines(source)
    first = F.min(F.struct(*PLACE))
    classes = lines.groupBy("h1", "h2").agg(first.alias("first"), *[F.min(k).alias(k) for k in ("k0", "k1", "k2", "k3")])
    classes = stored(classes.select("first.*", "h1", "h2", "k0", "k1", "k2", "k3"), "line-classes")
    staying = classes.select(PLACE)
    if max_edits:
        staying = staying.join(_near_repeats(source, classes), PLACE, "left_anti")
    return staying.groupBy("id", "copy").agg(F.array_sort(F.collect_list("line")).alias("kept"))


def dedupe_lines(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", max_edits: int = 1) -> DataFrame:
    """docs with the text cut to the lines that stay, and with n_lines and n_kept, the lines that aren't blank before and after.

    Blank lines stay where they are; a null text stays null with 0 lines. Columns of docs by the names n_lines and n_kept are replaced.
    """
    kept = kept_lines(docs, id_column, text_column, max_edits).select(F.col("id").alias("__id"), F.col("copy").alias("__copy"), F.col("kept").alias("__kept"))
    own_id, own_copy = _key(id_column, text_column)
    joined = docs.drop("n_lines", "n_kept").join(kept, (own_id == F.col("__id")) & (own_copy == F.col("__copy")), "left")

    def blank(line: Column) -> Column:
        return F.btrim(line, F.lit(BLANKS)) == ""

    lines = F.split(F.col(text_column).cast("string"), "\n", -1)
    joined = joined.withColumn("__lines", lines)
    blanks = F.filter(F.transform("__lines", lambda line, i: F.when(blank(line), i)), lambda i: i.isNotNull())
    numbers = F.array_sort(F.concat(blanks, F.coalesce("__kept", F.array().cast("array<int>"))))
    n_lines = F.coalesce(F.size(F.filter("__lines", lambda line: ~blank(line))), F.lit(0))
    out = joined.withColumns({
        "n_lines": F.when(F.col(text_column).isNull(), 0).otherwise(n_lines),
        "n_kept": F.when(F.col(text_column).isNull(), 0).otherwise(F.coalesce(F.size("__kept"), F.lit(0))),
        text_column: F.array_join(F.transform(numbers, lambda i: F.get("__lines", i)), "\n"),
    })
    return out.drop("__id", "__copy", "__kept", "__lines")


def drop_repeated_lines(docs: DataFrame) -> DataFrame:
    """The stage: documents with their repeated lines cut; those that had lines and keep none go. Columns are docs' own."""
    out = dedupe_lines(docs.select(*[F.col(c) for c in docs.columns]))
    out = out.where((F.col("n_lines") == 0) | (F.col("n_kept") > 0))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: lines before and after, and the text that stays."""
    return dedupe_lines(read_table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_kept", "text")


OP10_SQL = """
WITH raw AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS n, unnest(string_split(text, chr(10))) AS part FROM documents),
lines AS (SELECT doc_id, n, part, trim(part, ' ' || chr(9) || chr(13) || chr(11) || chr(12)) AS line FROM raw),
firsts AS (SELECT line, length(line) AS size, min(doc_id * 1000000 + n) AS pos FROM lines WHERE line <> '' GROUP BY line),
halves AS (
  SELECT line, size, pos, m, side, CASE WHEN side = 0 THEN left(line, m // 2) ELSE right(line, m - m // 2) END AS half
  FROM (SELECT *, unnest([size, size - 1]) AS m FROM firsts), (VALUES (0), (1)) AS s(side)
),
pairs AS (SELECT DISTINCT a.line AS a, b.line AS b, b.pos FROM halves AS a JOIN halves AS b USING (m, side, half) WHERE a.pos < b.pos AND abs(a.size - b.size) <= 1),
near AS (
  SELECT DISTINCT pos FROM pairs
  WHERE len(list_filter(range(1, greatest(length(a), length(b)) + 1), lambda p:
    CASE WHEN length(a) = length(b) THEN left(a, p - 1) || substr(a, p + 1) = left(b, p - 1) || substr(b, p + 1)
         WHEN length(a) > length(b) THEN left(a, p - 1) || substr(a, p + 1) = b ELSE left(b, p - 1) || substr(b, p + 1) = a END)) > 0
),
kept AS (SELECT pos FROM firsts WHERE pos NOT IN (SELECT pos FROM near)),
marked AS (SELECT *, doc_id * 1000000 + n IN (SELECT pos FROM kept) AND line <> '' AS stays FROM lines)
SELECT d.doc_id, CAST(count(*) FILTER (line <> '') AS INTEGER) AS n_lines, CAST(count(*) FILTER (stays) AS INTEGER) AS n_kept,
       CASE WHEN any_value(d.text) IS NOT NULL THEN coalesce(string_agg(part, chr(10) ORDER BY n) FILTER (stays OR line = ''), '') END AS text
FROM documents AS d LEFT JOIN marked AS m ON m.doc_id = d.doc_id GROUP BY d.doc_id
"""
