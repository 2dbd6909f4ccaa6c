"""SimHash near-duplicates: fingerprints, a segment-popcount grid join, exact verification, components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bitmap_has, bounded, hashed_bitmap, read_table, shuffled, stored, text_batches
from .components import connected_components

__all__ = ["fingerprints", "near_duplicate_components", "near_links", "keep_one_of_each", "remaining_links", "similar_links", "op9_simhash_near_dedup"]

SHINGLE = 3
SEED = 42
MAX_BITS = 3
#: Of links between texts that the fingerprint tells apart: words of a shingle, the share of shingles in common, marks of a text and shingles of a mark.
SIMILAR_SHINGLE, SIMILAR, MARKS, SAMPLE = 5, 0.8, 12, 5
#: Counters of hashes that put shingles in order, and blocks in which tasks send them.
COUNTERS, COUNTER_BLOCKS = 1 << 18, 64


def _hashes(text: str, k: int, seed: int) -> np.ndarray:
    """XXH64 of the space-joined k-word shingles of the text, A-Z lower-cased; fewer words than k: of all of them; none: empty."""
    words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes split at 0x20 and 0x09-0x0D, and lower A-Z, only
    if not words:
        return np.empty(0, dtype=np.uint64)
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= k:
        return np.array([digest(joined, seed)], dtype=np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = len(words) - k + 1
    return np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts[:n].tolist(), ends[k - 1 :].tolist(), strict=True)), dtype=np.uint64, count=n)


def _majority(hashes: np.ndarray, block: int = 1 << 15) -> int:
    """The bits that are set in over half the hashes."""
    counts = np.zeros(64, dtype=np.int64)
    for i in range(0, hashes.size, block):
        part = hashes[i : i + block]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > hashes.size, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", k: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """(id, copy, fp): the 64-bit SimHash of every whole text, and a hash of it that tells rows of one id apart.

    Null, empty or blank texts have fingerprint 0. Rows are kept as they are, repeated ids too.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.empty(batch.num_rows, dtype=np.int64)
            for start, texts in text_batches(batch, "text"):
                for i, text in enumerate(texts, start):
                    out[i] = _majority(_hashes(text, k, seed))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("copy"), pa.array(out)], names=["id", "copy", "fp"])

    text = F.col(text_column).cast("string")
    picked = docs.select(F.col(id_column).cast("long").alias("id"), F.xxhash64(text).alias("copy"), text.alias("text"))
    return picked.mapInArrow(run, "id long, copy long, fp long")


def segment_counts(fp: Column) -> Column:
    """The embedding: 32 two-bit fields, each the number of bits set in that two-bit segment of the fingerprint.

    The Manhattan distance of two embeddings is a lower bound of the fingerprints' Hamming distance.
    """
    ones = F.lit(0x5555555555555555).cast("long")
    low, high = fp.bitwiseAND(ones), F.shiftrightunsigned(fp, 1).bitwiseAND(ones)
    return low.bitwiseXOR(high).bitwiseOR(F.shiftleft(low.bitwiseAND(high), 1))


def near_links(fps: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """(a, b) pairs of different fingerprints in column fp that differ in max_bits bits or fewer; none is lost.

    The 32 segments are cut into blocks, so many that within max_bits of Manhattan distance some block has distance 0 or 1.
    The grid's cells are the count vectors of a block: of two vectors at distance 1, one is the other with one count raised by
    one, so each fingerprint is put at its own cells and looks up those and the cells that one raise leads to. Pairs that meet
    are verified by counting differing bits. fps must be distinct; rows made grow as fingerprints times the segments of a block.
    """
    blocks = max_bits // 2 + 1
    edges = [32 * i // blocks for i in range(blocks + 1)]
    e = segment_counts(F.col("fp"))

    def cell(value: Column, block: int) -> Column:
        lo, hi = edges[block], edges[block + 1]
        mask = ((1 << 2 * (hi - lo)) - 1) << 2 * lo
        return F.xxhash64(value.bitwiseAND(F.lit(mask - (1 << 64) if mask >= 1 << 63 else mask).cast("long")), F.lit(block))

    def raised(segment: int) -> Column:
        """The counts with this segment's raised by one; null where it is full."""
        count = F.shiftrightunsigned(F.col("e"), 2 * segment).bitwiseAND(F.lit(3).cast("long"))
        flips = F.shiftleft(F.when(count == 0, F.lit(1).cast("long")).when(count == 1, F.lit(3).cast("long")), 2 * segment)
        return F.col("e").bitwiseXOR(flips)

    with_e = fps.select("fp", e.alias("e"))
    own = with_e.select(F.col("fp").alias("a"), F.explode(F.array(*[cell(F.col("e"), i) for i in range(blocks)])).alias("cell"))
    looks = []
    for i in range(blocks):
        looks.append(F.struct(cell(F.col("e"), i).alias("cell"), F.lit(True).alias("same")))
        for s in range(edges[i], edges[i + 1]):
            up = raised(s)
            looks.append(F.when(up.isNotNull(), F.struct(cell(up, i).alias("cell"), F.lit(False).alias("same"))))
    look = with_e.select(F.col("fp").alias("b"), F.explode(F.array_compact(F.array(*looks))).alias("l")).select("b", "l.cell", "l.same")
    met = own.join(shuffled(look), "cell").where((F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits) & (~F.col("same") | (F.col("a") < F.col("b"))))
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct()


def _marks(hashes: np.ndarray) -> list[int]:
    """For each of several orders of all hashes, a hash of the SAMPLE ones that come first: texts share a mark if they share those shingles."""
    h, out = hashes, []
    for j in range(MARKS):
        with np.errstate(over="ignore"):
            order = (h ^ np.uint64((j + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) * np.uint64(0xD6E8FEB86659FD93)
            order ^= order >> np.uint64(32)
            order *= np.uint64(0xD6E8FEB86659FD93)
        first = h[np.argpartition(order, SAMPLE)[:SAMPLE]] if h.size > SAMPLE else h
        out.append(xxhash.xxh64_intdigest(np.sort(first).tobytes(), j) - (1 << 63))
    return out


def _parity(hashes: np.ndarray) -> np.ndarray:
    """Bits, a power of 2 and as many as hashes at least, each telling whether an odd number of the distinct hashes fall on it.

    Two sets differ in as many hashes at least as their bits differ; xored halves are the bits of half the size.
    """
    size = 64 << max(0, (hashes.size - 1).bit_length() - 6)
    odd = np.bincount((hashes & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def _may_share(pairs: DataFrame, sketches: DataFrame, least: float) -> DataFrame:
    """pairs (x, y, ...) without those that the sizes or parity bits of their sets of shingles rule out; sketches is (copy, n, bits). No pair that shares `least` goes."""
    one, two = (sketches.select(F.col("copy").alias(c), F.col("n").alias(f"n{c}"), F.col("bits").alias(f"bits{c}")) for c in ("x", "y"))

    def xor(a: Column, b: Column) -> Column:
        return a.bitwiseXOR(b)

    def folded(bits: Column, words: Column) -> Column:
        return F.when(F.size(bits) > words, F.zip_with(F.slice(bits, 1, words), F.slice(bits, words + 1, words), xor)).otherwise(bits)

    x, y = F.col("bitsx"), F.col("bitsy")
    words = F.least(F.size(x), F.size(y))
    differ = F.aggregate(F.zip_with(folded(x, words), folded(y, words), lambda a, b: F.bit_count(xor(a, b))), F.lit(0), lambda n, m: n + m)
    sizes = F.least("nx", "ny") >= least * F.greatest("nx", "ny")  # so one has twice the other's bits at most
    near = sizes & (differ <= (F.col("nx") + F.col("ny")) * F.lit((1 - least) / (1 + least)) + F.lit(1e-6))
    return pairs.join(shuffled(one), "x").join(shuffled(two), "y").where(near).select(*pairs.columns)


def _verified(source: DataFrame, pairs: DataFrame, sketches: DataFrame, k: int, least: float) -> DataFrame:
    """(a, b) of the stored pairs (x, y, a, b) whose texts x and y, told by copy in source (copy, text), share `least` of their k-word shingles or more.

    Whole sets travel only for pairs that _may_share leaves, about those that share 0.7.
    """
    pairs = stored(_may_share(pairs, sketches, least), "likely-pairs")

    def shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, texts in text_batches(batch, "text", 1_000_000):
                sets = [np.unique(_hashes(t, k, SEED)).view(np.int64) for t in texts]
                yield pa.RecordBatch.from_arrays([batch.column("copy").slice(start, len(texts)), pa.array(sets, pa.list_(pa.int64()))], names=["copy", "shingles"])

    wanted = stored(pairs.select(F.explode(F.array("x", "y")).alias("copy")).distinct(), "wanted")
    sets = stored(source.join(bounded(wanted), "copy", "left_semi").dropDuplicates(["copy"]).mapInArrow(shingles, "copy long, shingles array<long>"), "shingles")
    one, two = (sets.select(F.col("copy").alias(c), F.col("shingles").alias(f"s{c}")) for c in ("x", "y"))
    both = F.size(F.array_intersect("sx", "sy"))
    near = pairs.join(shuffled(one), "x").join(shuffled(two), "y").withColumn("both", both).where(F.col("both") >= least * (F.size("sx") + F.size("sy") - F.col("both")))
    return near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def similar_links(docs: DataFrame, fps: DataFrame | None = None, text_column: str = "text", k: int = SIMILAR_SHINGLE, least: float = SIMILAR, max_bits: int = MAX_BITS) -> DataFrame:
    """(a, b) pairs of fingerprints more than max_bits apart, which near_links leaves, of texts that share `least` of their k-word shingles or more.

    A fingerprint of 64 bits tells texts apart that differ in a few words, so these links are found by fingerprints of small samples: each
    text has several marks, each of its few first shingles in an order of its own, and texts at 0.8 have some mark in common but for about one
    in a hundred pairs. Of those with a common mark all meet the one with the smallest and the one with the greatest hash, so no pairs within a group are
    made, and pairs that meet are verified by their whole sets of shingles, where the sets' sizes allow it. What is missed here
    remaining_links finds between the groups that come of these links. Different texts only are compared; null and
    blank ones have no marks. fps is fingerprints() of docs, if it is there already.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[list[int] | None] = [None] * batch.num_rows
            bits: list[np.ndarray | None] = [None] * batch.num_rows
            sizes = np.zeros(batch.num_rows, dtype=np.int32)
            for start, texts in text_batches(batch, "text"):
                for i, text in enumerate(texts, start):
                    hashes = np.unique(_hashes(text, k, SEED))
                    sizes[i] = hashes.size
                    if hashes.size:
                        found[i], bits[i] = _marks(hashes), _parity(hashes)
            yield pa.RecordBatch.from_arrays([batch.column("copy"), pa.array(sizes), *(pa.array(x, pa.list_(pa.int64())) for x in (bits, found))], names=["copy", "n", "bits", "marks"])

    text = F.col(text_column).cast("string")
    source = docs.select(F.xxhash64(text).alias("copy"), text.alias("text"))
    fp_of = (fingerprints(docs.select(F.lit(0).alias("id"), text.alias("text")), "id") if fps is None else fps).select("copy", "fp").distinct()
    marked = source.mapInArrow(run, "copy long, n int, bits array<long>, marks array<long>").where("marks is not null").dropDuplicates(["copy"])
    marked = stored(marked.join(shuffled(fp_of), "copy"), "marks")
    flat = marked.select(F.struct("copy", "fp", "n").alias("t"), F.explode("marks").alias("mark"))
    ends = stored(flat.groupBy("mark").agg(F.min("t").alias("lo"), F.max("t").alias("hi")).where("lo.copy < hi.copy"), "mark-ends")
    met = flat.join(shuffled(ends), "mark").select("t", F.explode(F.array("lo", "hi")).alias("o"))
    apart = F.bit_count(F.col("t.fp").bitwiseXOR(F.col("o.fp"))) > max_bits
    met = met.where((F.col("t.copy") != F.col("o.copy")) & apart & (F.least("t.n", "o.n") >= least * F.greatest("t.n", "o.n")))
    first = F.col("t.copy") < F.col("o.copy")
    ordered = met.select(F.when(first, F.col("t")).otherwise(F.col("o")).alias("p"), F.when(first, F.col("o")).otherwise(F.col("t")).alias("q"))
    pairs = stored(ordered.select(F.col("p.copy").alias("x"), F.col("q.copy").alias("y"), F.col("p.fp").alias("a"), F.col("q.fp").alias("b")).distinct(), "mark-pairs")
    return _verified(source, pairs, marked.select("copy", "n", "bits"), k, least)


def _order_counts(source: DataFrame, k: int) -> np.ndarray:
    """How often the shingles of each of COUNTERS buckets of hashes stand in the texts; tasks send their sums in blocks, so the driver gets as much whatever the input."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(COUNTERS, dtype=np.int64)
        for batch in batches:
            for _, texts in text_batches(batch, "text", 1_000_000):
                slots = np.concatenate([np.unique(_hashes(text, k, SEED)) & np.uint64(COUNTERS - 1) for text in texts])
                counts += np.bincount(slots.astype(np.int64), minlength=COUNTERS)
        blocks = [(i, part.astype(np.uint32).tobytes()) for i, part in enumerate(np.split(counts, COUNTER_BLOCKS)) if part.any()]
        yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in blocks], pa.int32()), pa.array([x for _, x in blocks], pa.binary())], names=["block", "counts"])

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, x in zip(*(batch.column(c).to_pylist() for c in ("block", "counts")), strict=True):
                sums[i] = sums.get(i, 0) + np.frombuffer(x, dtype=np.uint32).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], names=["block", "counts"])

    parts = source.select("text").mapInArrow(run, "block int, counts binary").repartition(F.col("block")).mapInArrow(total, "block int, counts binary").toArrow()
    out = np.zeros((COUNTER_BLOCKS, COUNTERS // COUNTER_BLOCKS), dtype=np.int64)
    for i, x in zip(parts["block"].to_pylist(), parts["counts"].to_pylist(), strict=True):
        out[i] = np.frombuffer(x, dtype=np.int64)
    return out.ravel()


def remaining_links(docs: DataFrame, groups: DataFrame, text_column: str = "text", k: int = SIMILAR_SHINGLE, least: float = SIMILAR) -> DataFrame:
    """(a, b) pairs of different roots that have texts which share `least` of their k-word shingles or more; none is lost.

    groups is (copy, root), the group of each different text. All texts' shingles are put in one order, rare ones first. Of two texts that are similar enough the
    first shingle they share is among the first n - least * n + 1 of either, and what stands from it on in either is as many as they must share;
    so texts meet by these. Shingles that a single group has are dropped first, and pairs are made between groups only, and only where the sizes
    and places of a shingle in both allow it, so a large group of near copies makes none within itself. Pairs that meet are verified by their whole sets.
    The order is by counts of buckets of hashes, and any order finds all.
    """
    text = F.col(text_column).cast("string")
    source = docs.select(F.xxhash64(text).alias("copy"), text.alias("text"))
    order = docs.sparkSession.sparkContext.broadcast(_order_counts(source, k))

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = order.value
        for batch in batches:
            for start, texts in text_batches(batch, "text", 1_000_000):
                sizes, bits, tokens = [], [], []
                for t in texts:
                    h = np.unique(_hashes(t, k, SEED))
                    n = h.size
                    end = n - int(np.ceil(least * n - 1e-9)) + 1 if n else 0
                    sizes.append(n)
                    bits.append(_parity(h) if n else None)
                    tokens.append(h[np.lexsort((h, counts[h & np.uint64(COUNTERS - 1)]))[:end]].view(np.int64))
                yield pa.RecordBatch.from_arrays([batch.column("copy").slice(start, len(texts)), pa.array(sizes, pa.int32()), *(pa.array(x, pa.list_(pa.int64())) for x in (bits, tokens))], names=["copy", "n", "bits", "tokens"])

    heads = source.mapInArrow(first, "copy long, n int, bits array<long>, tokens array<long>").where("n > 0").dropDuplicates(["copy"])
    heads = stored(heads.join(shuffled(groups), "copy"), "heads")
    several = heads.select("root", F.explode("tokens").alias("token")).groupBy("token").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi")
    several = stored(several.select("token"), "shared-shingles")
    bitmap = docs.sparkSession.sparkContext.broadcast(hashed_bitmap(several, "token"))

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("tokens")
            sizes = np.diff(lists.offsets.to_numpy())
            tokens = lists.flatten().to_numpy()
            row = np.repeat(np.arange(batch.num_rows), sizes)
            place = np.arange(tokens.size) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            at = np.flatnonzero(bitmap_has(bitmap.value, tokens.view(np.uint64)))
            row = row[at]
            copy, root, n = (batch.column(c).take(pa.array(row)) for c in ("copy", "root", "n"))
            rest = (n.to_numpy() - place[at]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(tokens[at]), root, copy, n, pa.array(rest)], names=["token", "root", "copy", "n", "rest"])

    met = heads.select("copy", "root", "n", "tokens").mapInArrow(shared, "token long, root long, copy long, n int, rest int").join(shuffled(several), "token", "left_semi")
    met = stored(met, "shared-heads")
    roots = met.groupBy("token", "root").agg(F.max("rest").alias("rest"), F.min("n").alias("lo"), F.max("n").alias("hi"))
    one, other = (roots.select("token", F.col("root").alias(r), F.struct("rest", "lo", "hi").alias(c)) for r, c in (("a", "p"), ("b", "q")))

    def fits(small: str, large: str) -> Column:
        """Of texts, or groups with these smallest and largest sizes: the sizes are near enough, and both have enough shingles left from this one on."""
        must = F.lit(least / (1 + least)) * (F.col(f"p.{small}") + F.col(f"q.{small}")) - F.lit(1e-6)
        sizes = (F.col(f"p.{large}") >= least * F.col(f"q.{small}")) & (F.col(f"q.{large}") >= least * F.col(f"p.{small}"))
        return sizes & (F.col("p.rest") >= must) & (F.col("q.rest") >= must)

    two = one.join(shuffled(other), "token").where((F.col("a") < F.col("b")) & fits("lo", "hi")).select("token", "a", "b")
    x = met.select("token", F.col("root").alias("a"), F.struct("copy", "n", "rest").alias("p"))
    y = met.select("token", F.col("root").alias("b"), F.struct("copy", "n", "rest").alias("q"))
    pairs = two.join(shuffled(x), ["token", "a"]).join(shuffled(y), ["token", "b"]).where(fits("n", "n"))
    pairs = stored(pairs.select(F.col("p.copy").alias("x"), F.col("q.copy").alias("y"), "a", "b").distinct(), "shared-pairs")
    return _verified(source, pairs, heads.select("copy", "n", "bits"), k, least)


def near_duplicate_components(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", k: int = SHINGLE, seed: int = SEED, max_bits: int = MAX_BITS, similar: bool = False) -> DataFrame:
    """(doc_id, copy, fp, component_id, root) for every row of docs; component_id is the smallest id that links lead to, its own included, root the smallest fingerprint.

    similar adds the links of similar_links and then those of remaining_links to those of the fingerprints, so that no pair of similar texts is left in two components; it needs k and seed as they are by default.
    Copies share a fingerprint and are one class from the start: links are sought between distinct fingerprints only.
    An empty table gives no rows; a null id stays null and is never a component's id unless the component has no other.
    """
    fps = stored(fingerprints(docs, id_column, text_column, k, seed), "fingerprints")
    classes = stored(fps.groupBy("fp").agg(F.min("id").alias("least_id")), "classes")
    links = near_links(classes.select("fp"), max_bits)
    roots = connected_components(links.union(similar_links(docs, fps, text_column)) if similar else links)
    if similar:
        found = fps.select("copy", "fp").distinct().join(shuffled(roots.withColumnRenamed("node", "fp")), "fp", "left")
        more = stored(remaining_links(docs, found.select("copy", F.coalesce("root", "fp").alias("root")), text_column), "remaining-links")
        if not more.isEmpty():
            roots = connected_components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).union(more))
    joined = classes.join(shuffled(roots.withColumnRenamed("node", "fp")), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    # written, so that both sides of the join are shuffles, of which adaptive execution splits a giant component's
    merged = stored(joined.groupBy("root").agg(F.min("least_id").alias("component_id")), "merged")
    labels = joined.select("fp", "root").join(shuffled(merged), "root").select("fp", "root", "component_id")
    return fps.join(shuffled(labels), "fp").select(F.col("id").alias("doc_id"), "copy", "fp", "component_id", "root")


def keep_one_of_each(docs: DataFrame) -> DataFrame:
    """One row of docs for each group of near copies (by fingerprints, or five-word shingles of which 0.8 are shared), with docs' columns: that of the smallest doc_id (null last), of one id's that of the smallest hash of its text; of equal rows one.

    What goes is told by id and text, so a row never stays or goes for another one that has its id. The rows that go are
    fewer than those that stay, and are written, so that the join is broadcast where their number allows it.
    """
    rows = near_duplicate_components(docs, similar=True).groupBy("root", F.col("doc_id").alias("__id"), F.col("copy").alias("__copy")).agg(F.count(F.lit(1)).alias("n"))
    rows = stored(rows, "group-rows")
    order = F.struct(F.col("__id").isNull().alias("null"), F.col("__id").alias("id"), F.col("__copy").alias("copy"))
    first = stored(rows.groupBy("root").agg(F.min(order).alias("first")), "group-firsts")
    met = rows.join(shuffled(first), "root").withColumn("stays", order == F.col("first"))
    marked = stored(met.select("__id", "__copy", "n", "stays"), "group-marks")
    copy = F.xxhash64(F.col("text").cast("string"))

    def among(keys: DataFrame, how: str) -> DataFrame:
        return docs.join(bounded(keys.select("__id", "__copy")), F.col("doc_id").eqNullSafe(F.col("__id")) & (copy == F.col("__copy")), how)

    gone, several = stored(marked.where("not stays or n > 1"), "group-gone"), stored(marked.where("stays and n > 1"), "group-several")
    out = among(gone, "left_anti")
    if several.isEmpty():
        return out
    return out.union(among(several, "left_semi").withColumn("__copy", copy).dropDuplicates(["doc_id", "__copy"]).drop("__copy"))


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = near_duplicate_components(read_table(spark, sf_dir, "documents"))
    return groups.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
