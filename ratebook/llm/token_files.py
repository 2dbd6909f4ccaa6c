"""Token ids in directly addressable files: chunk levels with continuation bitmaps and rank directories."""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import read_table, scratch_dir, stored, text_batches
from .shared_files import write_file

__all__ = ["TokenFile", "TextEncoder", "op2_token_files", "pack", "read_token_files", "write_token_files"]

MAGIC = b"DAC1"
#: Bits of each level's chunks; the last one holds for all further levels.
WIDTHS = (8, 8)
#: Bits of the bitmap between two entries of its rank directory.
RANK_STEP = 512
#: A file is closed once it holds so many ids.
TOKENS_PER_FILE = 4_000_000
END_ID = 0
#: Words after which a worker begins a new set of known ones; it keeps the set before, of which words in use come back.
CACHE_WORDS = 400_000
#: Characters of the longest word that is kept, and words that are encoded as one text.
WORD_CHARS, WORDS_AT_ONCE = 64, 200


def pack(doc_ids: np.ndarray, lengths: np.ndarray, ids: np.ndarray, widths: tuple[int, ...] = WIDTHS) -> bytes:
    """A file's bytes: header, document ids, their first places, then the levels.

    An id's low bits are its chunk on level 0; where the bitmap has a 1, the rest goes on in the next level, at the place that
    is the number of ones before. Chunks are 8 or 16 bits wide.
    """
    out = [struct.pack("<4sIQ", MAGIC, doc_ids.size, ids.size), doc_ids.astype("<i8").tobytes(), np.concatenate(([0], np.cumsum(lengths))).astype("<u8").tobytes()]
    rest, levels, level = ids.astype(np.uint32), [], 0
    while level == 0 or rest.size:
        width = widths[min(level, len(widths) - 1)]
        chunks = (rest & np.uint32((1 << width) - 1)).astype("<u1" if width <= 8 else "<u2")
        high = rest >> np.uint32(width)
        more = high > 0
        bitmap = np.packbits(more, bitorder="little")
        ones = np.add.reduceat(more, np.arange(0, max(more.size, 1), RANK_STEP), dtype=np.uint32) if more.size else np.zeros(0, dtype=np.uint32)
        ranks = np.concatenate(([0], np.cumsum(ones)[:-1])).astype("<u4") if ones.size else np.zeros(0, dtype="<u4")
        levels.append(struct.pack("<BQ", width, rest.size) + chunks.tobytes() + bitmap.tobytes() + ranks.tobytes())
        rest, level = high[more], level + 1
    return b"".join([*out, struct.pack("<I", len(levels)), *levels])


class TokenFile:
    """Reads what pack wrote; nothing is decoded until it is asked for."""

    def __init__(self, data: bytes) -> None:
        magic, self.n_docs, self.n_ids = struct.unpack_from("<4sIQ", data)
        if magic != MAGIC:
            raise ValueError("not a token file")
        at = struct.calcsize("<4sIQ")
        self.doc_ids = np.frombuffer(data, "<i8", self.n_docs, at)
        self.starts = np.frombuffer(data, "<u8", self.n_docs + 1, at + 8 * self.n_docs).astype(np.int64)
        at += 16 * self.n_docs + 8
        (n_levels,) = struct.unpack_from("<I", data, at)
        at, self.levels = at + 4, []
        for _ in range(n_levels):
            width, n = struct.unpack_from("<BQ", data, at)
            at += 9
            chunks = np.frombuffer(data, "<u1" if width <= 8 else "<u2", n, at)
            at += chunks.nbytes
            bitmap = np.frombuffer(data, "<u1", (n + 7) // 8, at)
            at += bitmap.nbytes
            ranks = np.frombuffer(data, "<u4", (n + RANK_STEP - 1) // RANK_STEP, at)
            at += ranks.nbytes
            self.levels.append((width, chunks, bitmap, ranks))

    def __getitem__(self, i: int) -> int:
        """The id at place i: a chunk, a bit and a rank for each level that it has, without decoding its neighbours."""
        value = shift = 0
        for width, chunks, bitmap, ranks in self.levels:
            value |= int(chunks[i]) << shift
            shift += width
            if not bitmap[i >> 3] >> (i & 7) & 1:
                break
            block = i // RANK_STEP
            first = block * RANK_STEP
            i = int(ranks[block]) + int(np.unpackbits(bitmap[first // 8 : i // 8 + 1], bitorder="little")[: i - first].sum())
        return value

    def ids_at(self, places: np.ndarray) -> np.ndarray:
        """The ids at many places at once, each by way of the rank directories; no block is decoded."""
        value, alive, at, shift = np.zeros(places.size, dtype=np.uint32), np.arange(places.size), places.astype(np.int64), 0
        for width, chunks, bitmap, ranks in self.levels:
            if not alive.size:
                break
            value[alive] |= chunks[at].astype(np.uint32) << np.uint32(shift)
            shift += width
            more = (bitmap[at >> 3] >> (at & 7) & 1).astype(bool)
            alive, at = alive[more], at[more]
            block, rank = at // RANK_STEP, np.empty(at.size, dtype=np.int64)
            for i in range(0, at.size, 4096):
                part, first = at[i : i + 4096], block[i : i + 4096] * RANK_STEP
                byte = np.minimum((first >> 3)[:, None] + np.arange(RANK_STEP // 8), bitmap.size - 1)
                bits = np.unpackbits(bitmap[byte], axis=1, bitorder="little")
                rank[i : i + 4096] = ranks[block[i : i + 4096]] + (bits & (np.arange(RANK_STEP) < (part - first)[:, None])).sum(axis=1)
            at = rank
        return value

    def all_ids(self) -> np.ndarray:
        """Every id of the file, level by level."""
        value, at, shift = np.zeros(self.n_ids, dtype=np.uint32), slice(None), 0
        for width, chunks, bitmap, _ in self.levels:
            if not chunks.size:
                break
            value[at] |= chunks.astype(np.uint32) << np.uint32(shift)
            more = np.flatnonzero(np.unpackbits(bitmap, count=chunks.size, bitorder="little"))
            at = more if isinstance(at, slice) else at[more]
            shift += width
        return value


class TextEncoder:
    """Ids of whole texts by a tokenizers file, without special tokens.

    With a byte-level pre-tokenizer, a blank that nothing blank follows always begins a new word, and a newline between two
    characters that aren't blank is a word of its own. Texts are cut there, Arrow finds the different words of a batch, and
    only those that aren't known yet are encoded. Other texts and other tokenizers are encoded whole.
    """

    _blank_run = re.compile(r" \s")
    _newline_run = re.compile(r"\n(?:(?=\s|\Z)|(?<=\s\n)|(?<=\A\n))")
    _any_blank = re.compile(r"\s")

    def __init__(self, path: str) -> None:
        import json

        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.tokenizer = Tokenizer.from_file(path)
        before = spec.get("pre_tokenizer") or {}
        self.by_word = spec.get("normalizer") is None and before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
        self.added = [t["content"] for t in spec.get("added_tokens", [])]
        self.newline = np.array(self._ids(["\n"])[0], dtype=np.uint32)
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode_words(self, words: list[str]) -> list[bytes]:
        """The ids, as bytes, of words: those without blanks but the one in front are joined by newlines, whose id no other word has."""
        out: list[bytes] = []
        for i in range(0, len(words), 64 * WORDS_AT_ONCE):
            groups = [words[j : j + WORDS_AT_ONCE] for j in range(i, min(i + 64 * WORDS_AT_ONCE, len(words)), WORDS_AT_ONCE)]
            joined = ["\n".join(g) for g in groups]
            for part, text, ids in zip(groups, joined, self._ids(joined), strict=True):
                flat = np.array(ids, dtype=np.uint32)
                cuts = np.flatnonzero(flat == self.newline[0])
                if self.newline.size == 1 and len(cuts) == len(part) - 1 and len(text.split()) == len(part) and all(map(str.strip, part)):
                    data, ends = flat.tobytes(), (4 * cuts).tolist()
                    out += [data[x:y] for x, y in zip([0, *[e + 4 for e in ends]], [*ends, len(data)], strict=True)]
                else:
                    out += [np.array(x, dtype=np.uint32).tobytes() for x in self._ids(part)]
        return out

    def _lookup(self, words: list[str]) -> list[bytes]:
        """The ids of words, of which those of WORD_CHARS or fewer are kept for later batches."""
        if len(self.known) > CACHE_WORDS:
            self.older, self.known = self.known, {}
        known, older = self.known, self.older
        found = list(map(known.get, words))
        missing = [i for i, ids in enumerate(found) if ids is None]
        new = [words[i] for i in missing]
        kept = list(map(older.get, new)) if older else [None] * len(new)
        fresh = iter(self._encode_words([w for w, ids in zip(new, kept, strict=True) if ids is None]))
        for i, w, ids in zip(missing, new, kept, strict=True):
            found[i] = ids = next(fresh) if ids is None else ids
            if len(w) <= WORD_CHARS:
                known[w] = ids
        return found

    def encode(self, texts: list[str], end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(the ids of all texts in a row, each with end behind it; how many each has)."""
        cut = [self.by_word and not self._blank_run.search(t) and not any(a in t for a in self.added) for t in texts]
        by_line = [c and not self._newline_run.search(t) for t, c in zip(texts, cut, strict=True)]
        column = pa.array([t.replace("\n", " \n") if n else t if c else "" for t, c, n in zip(texts, cut, by_line, strict=True)], pa.large_string())
        parts = pc.split_pattern(column, " ")
        offsets = parts.offsets.to_numpy()
        words = parts.flatten().dictionary_encode()
        different = words.dictionary.to_numpy(zero_copy_only=False).tolist()
        # a word behind a newline has no blank before it; so has the first of a text
        spelt = [w[1:] if w[:1] == "\n" else " " + w for w in different]
        firsts = [None if not c else t.split(" ", 1)[0].split("\n", 1)[0] if n else t.split(" ", 1)[0] for t, c, n in zip(texts, cut, by_line, strict=True)]
        entries = self._lookup(spelt + [f or "" for f in firsts])
        newline = self.newline.tobytes()
        for i in [i for i, w in enumerate(different) if w[:1] == "\n"]:
            entries[i] = newline + entries[i]
        for i, ids in zip([i for i, f in enumerate(firsts, len(different)) if f is None], self._ids([t for t, c in zip(texts, cut, strict=True) if not c]), strict=True):
            entries[i] = np.array(ids, dtype=np.uint32).tobytes()
        entries.append(end.tobytes())
        sizes = np.fromiter(map(len, entries), dtype=np.int64, count=len(entries)) // 4
        flat, starts = np.frombuffer(b"".join(entries), dtype=np.uint32), np.concatenate(([0], np.cumsum(sizes)[:-1]))
        n = len(texts)
        counts = np.diff(offsets)
        places = np.full(len(words) + n, len(entries) - 1, dtype=np.int64)
        places[np.arange(len(words)) + np.repeat(np.arange(n), counts)] = words.indices.to_numpy()
        places[offsets[:-1] + np.arange(n)] = len(different) + np.arange(n)
        lengths = sizes[places]
        ends = np.cumsum(lengths)
        out = flat[np.repeat(starts[places] - (ends - lengths), lengths) + np.arange(ends[-1] if ends.size else 0)]
        upto = ends[offsets[1:] + np.arange(n)]
        return out, np.diff(upto, prepend=0)


_encoders: dict[str, TextEncoder] = {}


def _encoder(path: str) -> TextEncoder:
    if path not in _encoders:
        _encoders[path] = TextEncoder(path)
    return _encoders[path]


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, id_column: str = "doc_id", text_column: str = "text", end_id: int | None = END_ID, tokens_per_file: int = TOKENS_PER_FILE) -> DataFrame:
    """Writes docs' ids into files of folder, in ascending order of id over all files; returns (file, part, seq, n_docs, n_ids) of each.

    Documents are dealt by ranges of the id and sorted within (rows that repeat an id by their text, a null id first); a task
    closes a file at tokens_per_file ids. A file's name and bytes depend on its rows alone, so a task that runs again puts
    the same file in place. Null texts count as empty; each document ends with end_id, if that isn't None.
    """
    picked = docs.select(F.col(id_column).cast("long").alias("id"), F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, seq = _encoder(tokenizer), TaskContext.get().partitionId(), 0
        end = np.array([] if end_id is None else [end_id], dtype=np.uint32)
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        size = 0

        def close() -> pa.RecordBatch:
            nonlocal held, size, seq
            name = f"part-{part:07d}-{seq:06d}.dac"
            doc_ids, lengths, ids = (np.concatenate(x) for x in zip(*held, strict=True))
            write_file(f"{folder}/{name}", pack(doc_ids, lengths, ids))
            row = [[name], [part], [seq], [doc_ids.size], [ids.size]]
            held, size, seq = [], 0, seq + 1
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(row, (pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64()), strict=True)], names=["file", "part", "seq", "n_docs", "n_ids"])

        for batch in batches:
            keys = batch.column("id").fill_null(NULL_ID).to_numpy()
            for start, texts in text_batches(batch, "text", 3_000_000):
                ids, lengths = encoder.encode(texts, end)
                own, upto, done = keys[start : start + len(texts)], np.cumsum(lengths), 0
                while done < len(texts):
                    before = int(upto[done - 1]) if done else 0
                    stop = min(len(texts), int(np.searchsorted(upto, before + tokens_per_file - size)) + 1)
                    held.append((own[done:stop], lengths[done:stop], ids[before : int(upto[stop - 1])]))
                    size += int(upto[stop - 1]) - before
                    done = stop
                    if size >= tokens_per_file:
                        yield close()
        if held:
            yield close()

    dealt = picked.repartitionByRange(F.col("id")).sortWithinPartitions("id", "text")
    return stored(dealt.mapInArrow(run, "file string, part int, seq int, n_docs long, n_ids long"), "token-files")


#: Stands for a null document id in files.
NULL_ID = -(1 << 63)


def read_token_files(spark: SparkSession, folder: str, files: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, file) of every document in the files of folder; start counts all ids before it in all files.

    files is what write_token_files returned. Only sums by part meet in one task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path"), batch.column("content"), strict=True):
                f = TokenFile(content.as_buffer())
                ids = f.all_ids().astype("<u4")
                last = f.starts[1:][np.diff(f.starts) > 0] - 1
                if not np.array_equal(f.ids_at(last), ids[last]):
                    raise ValueError("a rank directory leads elsewhere than its levels")
                crc = [zlib.crc32(ids[a:b]) for a, b in zip(f.starts[:-1].tolist(), f.starts[1:].tolist(), strict=True)]
                n = f.n_docs
                columns = [
                    pa.array([path.as_py().rpartition("/")[2]] * n, pa.string()),
                    pa.array(f.doc_ids, mask=f.doc_ids == NULL_ID),
                    pa.array(f.starts[:-1]),
                    pa.array(np.diff(f.starts)),
                    pa.array(crc, pa.int64()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["file", "doc_id", "at", "n_tokens", "ids_crc32"])

    schema = "file string, doc_id long, at long, n_tokens long, ids_crc32 long"
    parts = files.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("part_start"))
    within = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    firsts = files.withColumn("within", F.coalesce(F.sum("n_ids").over(within), F.lit(0))).join(parts, "part").select("file", (F.col("part_start") + F.col("within")).alias("file_start"))
    if files.isEmpty():
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long, file string")
    found = spark.read.format("binaryFile").load(folder).select("path", "content").mapInArrow(run, schema)
    return found.join(firsts, "file").select("doc_id", (F.col("file_start") + F.col("at")).alias("start"), "n_tokens", "ids_crc32", "file")


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's place, size and checksum in token files, read back from them."""
    import public_tokenizers

    folder = scratch_dir(spark, "tokens")
    files = write_token_files(read_table(spark, sf_dir, "documents"), folder, public_tokenizers.path("byte_bpe_50k.json"))
    return read_token_files(spark, folder, files)
