"""Benchmark decontamination by greedy string tiling of documents and test items."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bitmap_has, bounded, hashed_bitmap, read_table, stored

__all__ = ["contaminated_pairs", "drop_contaminated", "greedy_tiles", "greedy_tiles_by_rows", "op7_benchmark_decontamination", "tile_pairs"]

#: Words of the shortest tile; items of fewer words are one tile.
MIN_TILE = 5
#: Share of an item's words that tiles must cover; passages in another order lose the pieces that are shorter than a tile.
MIN_COVERAGE = 0.6

#: Shared places of a pair that are laid out at once; beyond it they are walked by rows of the item, with the same tiles.
PLACES_AT_ONCE = 1 << 20

_PUNCTUATION = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_SAME = bytes(range(256))
_BASE = 0x9E3779B97F4A7C15


def _words(text: str | None) -> list[bytes]:
    """Lower-case words between blanks, without ASCII punctuation."""
    return (text or "").lower().encode("utf-8", "surrogatepass").translate(_SAME, _PUNCTUATION).split()


def _codes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), dtype=np.uint64, count=len(words))


def _rolling(codes: np.ndarray, k: int) -> np.ndarray:
    """The Karp-Rabin hash of every k words, with k mixed in."""
    n = codes.size - k + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    with np.errstate(over="ignore"):
        h = codes[:n] + np.uint64(k)
        for j in range(1, k):
            h = h * np.uint64(_BASE) + codes[j : j + n]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        return h ^ (h >> np.uint64(32))


def _item_seeds(items: DataFrame, min_tile: int) -> DataFrame:
    """(item, icopy, n_words, k, ipos, seed) for every seed of every test item; icopy tells texts of one item apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, icopy, text in zip(*(batch.column(c).to_pylist() for c in ("item", "icopy", "text")), strict=True):
                codes = _codes(_words(text))
                k = min(min_tile, codes.size)
                if not k:
                    continue
                seeds = _rolling(codes, k).view(np.int64)
                n = seeds.size
                columns = [pa.array([item] * n, pa.int64()), pa.array(np.full(n, icopy, dtype=np.int64)), pa.array(np.full(n, codes.size, dtype=np.int32)), pa.array(np.full(n, k, dtype=np.int32)), pa.array(np.arange(n, dtype=np.int32)), pa.array(seeds)]
                yield pa.RecordBatch.from_arrays(columns, names=["item", "icopy", "n_words", "k", "ipos", "seed"])

    return items.mapInArrow(run, "item long, icopy long, n_words int, k int, ipos int, seed long")


def _document_seeds(docs: DataFrame, lengths: list[int], bitmap) -> DataFrame:
    """(doc, copy, pos, seed) where a document's words may start a seed of some item; copy tells rows of one id and different texts apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts: list[tuple[int | None, int, np.ndarray, np.ndarray]] = []
            for doc, copy, text in zip(batch.column("doc").to_pylist(), batch.column("copy").to_pylist(), batch.column("text"), strict=True):
                codes = _codes(_words(text.as_py()))
                found = [(np.flatnonzero(bitmap_has(bitmap.value, h := _rolling(codes, k))), h) for k in lengths]
                pos = np.concatenate([at for at, _ in found])
                if pos.size:
                    parts.append((doc, copy, pos, np.concatenate([h[at] for at, h in found])))
            if not parts:
                continue
            sizes = [p[2].size for p in parts]
            columns = [
                pa.array(np.concatenate([np.full(n, p[0] or 0, dtype=np.int64) for p, n in zip(parts, sizes, strict=True)]), mask=np.repeat([p[0] is None for p in parts], sizes)),
                pa.array(np.repeat(np.array([p[1] for p in parts], dtype=np.int64), sizes)),
                pa.array(np.concatenate([p[2] for p in parts]).astype(np.int32)),
                pa.array(np.concatenate([p[3] for p in parts]).view(np.int64)),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["doc", "copy", "pos", "seed"])

    return docs.mapInArrow(run, "doc long, copy long, pos int, seed long")


def greedy_tiles(ipos: np.ndarray, pos: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """(item start, document start, words) of the tiles that greedy string tiling marks.

    ipos and pos are the places of all shared seeds of k words. Seeds that follow each other on one diagonal are a maximal
    match; the longest match is marked first (ties: the smaller item place, then document place), and what marks leave of
    a match goes back in line if it still has k words.
    """
    if not pos.size:
        return []
    diagonal = pos.astype(np.int64) - ipos
    order = np.lexsort((ipos, diagonal))
    d, i = diagonal[order], ipos[order].astype(np.int64)
    new = np.ones(d.size, dtype=bool)
    new[1:] = (d[1:] != d[:-1]) | (i[1:] > i[:-1] + 1)
    starts = np.flatnonzero(new)
    ends = np.append(starts[1:], d.size) - 1
    heap = [(-(b - a + k), a, a + s) for a, b, s in zip(i[starts].tolist(), i[ends].tolist(), d[starts].tolist(), strict=True)]
    heapq.heapify(heap)
    item_marks, doc_marks, tiles = set(), set(), []
    while heap:
        size, a, b = heapq.heappop(heap)
        free = [a + j not in item_marks and b + j not in doc_marks for j in range(-size)]
        if all(free):
            item_marks.update(range(a, a - size))
            doc_marks.update(range(b, b - size))
            tiles.append((a, b, -size))
            continue
        run = 0
        for j, f in enumerate([*free, False]):
            if f:
                run += 1
            else:
                if run >= k:
                    heapq.heappush(heap, (-run, a + j - run, b + j - run))
                run = 0
    return tiles


def greedy_tiles_by_rows(places: list[tuple[np.ndarray, np.ndarray]], k: int) -> list[tuple[int, int, int]]:
    """The tiles of greedy_tiles where shared seeds repeat so often that their pairs of places would not fit memory.

    places holds, for each shared seed, its places in the item and in the document, both ascending. The longest match that
    is free is sought anew for each tile, over the item's places from the last to the first: a row holds the lengths of the
    runs that start at one item place, one for each place in the document, and is made from the row after it.
    """
    at_of = {int(i): at.astype(np.int64) for items, at in places for i in items}
    rows = sorted(at_of, reverse=True)
    n_item, n_doc = rows[0] + k, int(max(at[-1] for at in at_of.values())) + k
    item_marks, doc_marks, tiles = np.zeros(n_item, dtype=bool), np.zeros(n_doc, dtype=bool), []
    while True:
        marked = np.concatenate(([0], np.cumsum(doc_marks)))
        best, after, above, lengths = (0, 0, 0), -1, np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
        for i in rows:
            if item_marks[i : i + k].any():
                continue
            at = at_of[i]
            at = at[marked[at + k] == marked[at]]
            runs = np.ones(at.size, dtype=np.int64)
            if after == i + 1 and above.size:
                near = np.minimum(np.searchsorted(above, at + 1), above.size - 1)
                runs += np.where(above[near] == at + 1, lengths[near], 0)
            after, above, lengths = i, at, runs
            if at.size and runs.max() >= best[0]:
                first = int(runs.argmax())
                best = (int(runs[first]), i, int(at[first]))
        if not best[0]:
            return tiles
        size, a, b = best[0] + k - 1, best[1], best[2]
        item_marks[a : a + size] = True
        doc_marks[b : b + size] = True
        tiles.append((a, b, size))


def tile_pairs(docs: DataFrame, items: DataFrame, id_column: str = "doc_id", text_column: str = "text", item_column: str = "item_id", item_text_column: str = "text", min_tile: int = MIN_TILE, by_copy: bool = False) -> DataFrame:
    """(doc_id, item_id, n_words, covered, n_tiles, longest, coverage, reordered) for documents and items that share a seed.

    Words are lower-cased and lose ASCII punctuation. Only seeds that pass a bitmap of fixed size leave the pass over the
    documents; they are joined to the items' seeds by hash, and each pair's matches are tiled. A pair's group holds each shared
    seed once with its places in the item and in the document, not their products, so it grows as the two texts. reordered says that the tiles
    stand in another order in the document. Null or empty texts and items share nothing. Of rows that repeat an id with
    different texts, and of texts of one item id, the pair with the highest coverage counts; by_copy keeps the documents' apart by copy,
    the hash of the text. Texts of an item are tiled each for itself.
    """
    spark = docs.sparkSession
    said = F.col(item_text_column).cast("string")
    picked = items.select(F.col(item_column).cast("long").alias("item"), F.xxhash64(said).alias("icopy"), said.alias("text"))
    grouped = _item_seeds(picked, min_tile).groupBy("seed", "item", "icopy", "n_words", "k").agg(F.sort_array(F.collect_set("ipos")).alias("ipos"))
    seeds = stored(grouped, "item-seeds")
    lengths = sorted(r[0] for r in seeds.select("k").distinct().collect())  # min_tile values at most
    text = F.col(text_column).cast("string")
    source = docs.select(F.col(id_column).cast("long").alias("doc"), F.xxhash64(text).alias("copy"), text.alias("text"))
    bitmap = spark.sparkContext.broadcast(hashed_bitmap(seeds.select("seed").distinct(), "seed"))
    met = _document_seeds(source, lengths or [min_tile], bitmap).join(seeds, "seed")
    keys = ["doc", "copy", "item", "icopy", "n_words", "k"]
    # dealt by pair once, which serves both groupings
    at = met.repartition("doc", "copy", "item", "icopy").groupBy(*keys, "seed").agg(F.first("ipos").alias("ipos"), F.sort_array(F.collect_set("pos")).alias("pos"))
    pairs = at.groupBy(*keys).agg(F.collect_list(F.struct("ipos", "pos")).alias("places"))

    def tiles_of(places: list[tuple[np.ndarray, np.ndarray]], k: int) -> list[tuple[int, int, int]]:
        if sum(i.size * p.size for i, p in places) > PLACES_AT_ONCE:
            return greedy_tiles_by_rows(places, k)
        return greedy_tiles(np.concatenate([np.repeat(i, p.size) for i, p in places]), np.concatenate([np.tile(p, i.size) for i, p in places]), k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, copy, item, n, k, places in zip(*(batch.column(c) for c in ("doc", "copy", "item", "n_words", "k", "places")), strict=True):
                shared = [(s["ipos"].values.to_numpy(), s["pos"].values.to_numpy()) for s in places]
                tiles = sorted(tiles_of(shared, k.as_py()))
                covered = sum(t[2] for t in tiles)
                reordered = any(b[1] < a[1] for a, b in zip(tiles, tiles[1:], strict=False))
                rows.append((doc.as_py(), copy.as_py(), item.as_py(), n.as_py(), covered, len(tiles), max(t[2] for t in tiles), reordered))
            kinds = [("doc_id", pa.int64()), ("copy", pa.int64()), ("item_id", pa.int64()), ("n_words", pa.int32()), ("covered", pa.int32()), ("n_tiles", pa.int32()), ("longest", pa.int32()), ("reordered", pa.bool_())]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, (_, t) in enumerate(kinds)], names=[n for n, _ in kinds])

    tiled = pairs.mapInArrow(run, "doc_id long, copy long, item_id long, n_words int, covered int, n_tiles int, longest int, reordered boolean")
    keys = ["doc_id", *(["copy"] if by_copy else []), "item_id"]
    share = (F.col("covered") / F.col("n_words")).alias("coverage")
    return tiled.groupBy(*keys).agg(F.max(F.struct(share, "n_words", "covered", "longest", "n_tiles", "reordered")).alias("t")).select(*keys, "t.n_words", "t.covered", "t.n_tiles", "t.longest", "t.reordered", "t.coverage")


def contaminated_pairs(docs: DataFrame, items: DataFrame, min_coverage: float = MIN_COVERAGE, min_tile: int = MIN_TILE, by_copy: bool = False) -> DataFrame:
    """The pairs of tile_pairs of which tiles cover min_coverage of the item's words."""
    return tile_pairs(docs, items, min_tile=min_tile, by_copy=by_copy).where(F.col("coverage") >= min_coverage)


def drop_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """docs without the rows that hold a test item, with docs' columns; a clean row stays though another of its id goes.

    The leaks are written, so that the join is broadcast where their size allows it and the documents stay where they are.
    """
    leaks = contaminated_pairs(docs, items, by_copy=True).select(F.col("doc_id").alias("__id"), F.col("copy").alias("__copy")).distinct()
    return docs.join(bounded(stored(leaks, "leaks")), F.col("doc_id").eqNullSafe(F.col("__id")) & (F.xxhash64(F.col("text").cast("string")) == F.col("__copy")), "left_anti")


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that hold a benchmark item, with the items and how they are tiled."""
    return contaminated_pairs(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
