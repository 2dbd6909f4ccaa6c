"""Unigram segmentation by Viterbi over a double-array trie, with byte fallback, and its decoding."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table, text_batches

__all__ = ["PieceModel", "encode_and_decode", "load_model", "op4_sentence_pieces", "with_pieces"]

MARKER = "▁"
#: How far below the least score a character without a piece scores.
UNKNOWN_PENALTY = 10.0
#: Words of which a worker keeps the pieces at most; it starts anew beyond that.
CACHE_WORDS = 300_000
#: Characters of the longest word that is kept, so that unspaced texts aren't.
WORD_CHARS = 64
_RUNS = re.compile(" +[^ ]*")


@dataclass
class PieceModel:
    """Pieces with scores as a double-array trie: state s goes by character code c to t = base[s] + c if check[t] == s.

    value[t] is the id of the piece that ends at t, or -1. code_of gives a character's code; a blank has the marker's, and
    the marker itself, like all characters of no piece, has 0. byte_ids are the ids of the 256 byte pieces, surface what an id
    decodes to.
    """

    base: np.ndarray
    check: np.ndarray
    value: np.ndarray
    code_of: np.ndarray
    scores: np.ndarray
    longest: int
    byte_ids: np.ndarray
    surface: list[bytes]
    crosses: bool
    cache: dict[str, bytes] = field(default_factory=dict, repr=False)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"cache": {}}

    @property
    def unknown_score(self) -> float:
        return float(self.scores[self.value[self.value >= 0]].min()) - UNKNOWN_PENALTY

    def viterbi(self, words: list[str]) -> list[np.ndarray]:
        """The ids of each word's best segmentation; of equal ones, that whose last pieces are longer."""
        order = sorted(range(len(words)), key=lambda i: -len(words[i]))
        out: list[np.ndarray] = [np.empty(0, dtype=np.int32)] * len(words)
        at = 0
        while at < len(order):
            width = max(1, len(words[order[at]]))
            rows = order[at : at + max(1, 1_000_000 // width)]
            rows = [i for i in rows if len(words[i]) * 2 > width or width <= 12] or rows[:1]  # alike in length
            self._viterbi_block(words, rows, width, out)
            at += len(rows)
        return out

    def _viterbi_block(self, words: list[str], rows: list[int], width: int, out: list[np.ndarray]) -> None:
        n, lengths = len(rows), np.array([len(words[i]) for i in rows])
        flat = np.frombuffer("".join(words[i] for i in rows).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        inside = np.arange(width)[None, :] < lengths[:, None]
        codes = np.zeros((n, width), dtype=np.int32)
        codes[inside] = self.code_of[flat]
        best = np.full((n, width + 1), -np.inf)
        best[:, 0] = 0.0
        came, piece = np.zeros((n, width + 1), dtype=np.int32), np.full((n, width + 1), -1, dtype=np.int32)
        longer = np.searchsorted(-lengths, -np.arange(width), side="left")  # rows with more characters than s
        unknown = self.unknown_score
        for s in range(width):
            live = np.arange(longer[s])
            state, single = np.zeros(live.size, dtype=np.int64), np.zeros(live.size, dtype=bool)
            for k in range(min(self.longest, width - s)):
                if k:
                    going = live < longer[s + k]
                    live, state = live[going], state[going]
                c = codes[live, s + k]
                t = self.base[state] + c
                ok = (c > 0) & (self.check[t] == state)
                live, state = live[ok], t[ok]
                if not live.size:
                    break
                ids = self.value[state]
                has = ids >= 0
                w, ids = live[has], ids[has]
                if not k:
                    single[w] = True
                score = best[w, s] + self.scores[ids]
                up = score > best[w, s + k + 1]
                w = w[up]
                best[w, s + k + 1], came[w, s + k + 1], piece[w, s + k + 1] = score[up], s, ids[up]
            w = np.flatnonzero(~single)
            score = best[w, s] + unknown
            up = score > best[w, s + 1]
            w = w[up]
            best[w, s + 1], came[w, s + 1], piece[w, s + 1] = score[up], s, -1
        self._read_back(words, rows, lengths, came, piece, out)

    def _read_back(self, words: list[str], rows: list[int], lengths: np.ndarray, came: np.ndarray, piece: np.ndarray, out: list[np.ndarray]) -> None:
        at, alive, steps = lengths.copy(), np.arange(len(rows)), []
        alive = alive[at[alive] > 0]
        while alive.size:
            end = at[alive]
            steps.append((alive, piece[alive, end], end))
            at[alive] = came[alive, end]
            alive = alive[at[alive] > 0]
        if not steps:
            return
        who = np.concatenate([a for a, _, _ in steps])[::-1]
        ids = np.concatenate([p for _, p, _ in steps])[::-1]
        ends = np.concatenate([e for _, _, e in steps])[::-1]
        by = np.argsort(who, kind="stable")
        ids, ends = ids[by], ends[by]
        cuts = np.concatenate(([0], np.cumsum(np.bincount(who, minlength=len(rows)))))
        for r, i in enumerate(rows):
            own = ids[cuts[r] : cuts[r + 1]]
            if (own < 0).any():
                parts = [self.byte_ids[list(words[i][e - 1].encode("utf-8", "surrogatepass"))] if p < 0 else [p] for p, e in zip(own, ends[cuts[r] : cuts[r + 1]], strict=True)]
                own = np.concatenate(parts).astype(np.int32)
            out[i] = own

    def words_of(self, text: str) -> list[str]:
        """The parts that no piece spans, without the one blank that each begins with; the text gets a blank in front."""
        if not text:
            return []
        if self.crosses:
            return [text]
        if "  " in text or text[0] == " ":
            return [w[1:] for w in _RUNS.findall(" " + text)]
        return text.split(" ")

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text; nothing for an empty one."""
        parts = [self.words_of(t) for t in texts]
        if len(self.cache) > CACHE_WORDS:
            self.cache.clear()
        known = self.cache
        new = list({w for words in parts for w in words if w not in known})
        found = {w: ids.tobytes() for w, ids in zip(new, self.viterbi([" " + w for w in new]), strict=True)}
        known.update((w, ids) for w, ids in found.items() if len(w) <= WORD_CHARS)
        long = {w: ids for w, ids in found.items() if len(w) > WORD_CHARS}
        get = known.__getitem__ if not long else lambda w: long[w] if w in long else known[w]
        return [np.frombuffer(b"".join(map(get, words)), dtype=np.int32) for words in parts]

    def decode(self, ids: np.ndarray) -> str:
        """The text of the ids: markers are blanks, byte pieces bytes, and the blank in front goes."""
        return b"".join(map(self.surface.__getitem__, ids.tolist())).decode("utf-8", "replace")[1:]


def _double_array(pieces: dict[str, int], codes: dict[str, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    tree: dict[int, dict] = {}
    for text, i in pieces.items():
        node = tree
        for ch in text:
            node = node.setdefault(codes[ch], {})
        node[0] = i
    size = 4 * sum(map(len, pieces)) + 2 * len(codes) + 16
    base, check, value = np.zeros(size, dtype=np.int64), np.full(size, -1, dtype=np.int64), np.full(size, -1, dtype=np.int32)
    used, free, queue = bytearray(size), 1, [(0, tree)]
    used[0] = 1
    for state, node in queue:
        if 0 in node:
            value[state] = node[0]
        children = sorted(c for c in node if c)
        if not children:
            continue
        while used[free]:
            free += 1
        b = max(free - children[0], 0)
        while any(used[b + c] for c in children):
            b += 1
        base[state] = b
        for c in children:
            used[b + c] = 1
            check[b + c] = state
            queue.append((b + c, node[c]))
    top = max(i for i, u in enumerate(used) if u) + len(codes) + 2
    return base[:top], check[:top], value[:top]


def load_model(path: str | None = None, scores: str = "zipf") -> PieceModel:
    """The pieces of a SentencePiece file (default: the public 32k vocabulary) as a PieceModel.

    scores "file" takes the file's as log scores, as a unigram file has them. The public file is a BPE one, whose scores are
    merge ranks, so "zipf" takes a piece's log score from its place in the file by Zipf's law: -log(1 + place).
    """
    import sentencepiece

    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces, bytes_of, table, surface, place = {}, np.zeros(256, dtype=np.int32), np.zeros(sp.get_piece_size()), [], 0
    for i in range(sp.get_piece_size()):
        text = sp.id_to_piece(i)
        if sp.is_byte(i):
            value = int(text[3:5], 16)
            bytes_of[value] = i
            surface.append(bytes([value]))
        elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
            surface.append(b"")
        else:
            pieces[text] = i
            place += 1
            table[i] = -np.log(1.0 + place) if scores == "zipf" else sp.get_score(i)
            surface.append(text.replace(MARKER, " ").encode())
    codes = {ch: i for i, ch in enumerate(sorted({ch for text in pieces for ch in text}), 1)}
    code_of = np.zeros(0x110000, dtype=np.uint16)
    for ch, code in codes.items():
        code_of[ord(ch)] = code
    code_of[ord(" ")], code_of[ord(MARKER)] = codes.get(MARKER, 0), 0
    base, check, value = _double_array(pieces, codes)
    crosses = any(MARKER in text.lstrip(MARKER) for text in pieces)
    return PieceModel(base, check, value, code_of, table, max(map(len, pieces)), bytes_of, surface, crosses)


def encode_and_decode(docs: DataFrame, model: PieceModel, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """docs' other columns with ids, n_ids, n_byte_ids, ids_crc32 (of the ids as 32-bit little-endian integers) and decoded.

    decoded is the text that the ids alone give back. Null counts as empty and has no ids. Columns of docs by these names are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    new = ["ids", "n_ids", "n_byte_ids", "ids_crc32", "decoded"]
    picked = docs.drop(*new)
    names = [c for c in picked.columns if c != text_column]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: PieceModel = shared.value
        is_byte = np.zeros(len(m.surface), dtype=bool)
        is_byte[m.byte_ids] = True
        for batch in batches:
            for start, texts in text_batches(batch, text_column, 2_000_000):
                ids = m.encode(texts)
                flat = np.concatenate(ids) if ids else np.empty(0, dtype=np.int32)
                offsets = np.concatenate(([0], np.cumsum([a.size for a in ids]))).astype(np.int32)
                part = batch.slice(start, len(texts))
                columns = [part.column(c) for c in names] + [
                    pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)),
                    pa.array(np.diff(offsets)),
                    pa.array([int(is_byte[a].sum()) for a in ids], pa.int32()),
                    pa.array([zlib.crc32(a.tobytes()) for a in ids], pa.int64()),
                    pa.array([m.decode(a) for a in ids], pa.string()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=[*names, *new])

    schema = ", ".join([f"`{c}` {picked.schema[c].dataType.simpleString()}" for c in names] + ["ids array<int>, n_ids int, n_byte_ids int, ids_crc32 long, decoded string"])
    return picked.mapInArrow(run, schema)


def with_pieces(docs: DataFrame) -> DataFrame:
    """The stage: documents with their piece ids, and the text that they decode to in place of the text."""
    return encode_and_decode(docs, load_model()).withColumnRenamed("decoded", "text")


def op4_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces, and whether they decode to its whole text."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("before"))
    out = encode_and_decode(docs, load_model())
    return out.select("doc_id", "n_ids", "n_byte_ids", "ids_crc32", (F.xxhash64("decoded") == F.col("before")).alias("round_trip"), "ids")
