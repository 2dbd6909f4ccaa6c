"""Language identification with error-correcting output codes over hashed character n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded, fold_held_out, read_table, stored, text_batches

__all__ = ["EcocModel", "codewords", "drop_unidentified", "identify", "op1_language_id", "train"]

UNDETERMINED = "und"
#: Buckets of hashed n-grams (a power of two).
BUCKETS = 1 << 12
#: Bound of the training sample, in documents, shared evenly by the languages.
MAX_TRAIN_DOCS = 2_000
#: Languages with fewer labelled documents are not learned.
MIN_LANG_DOCS = 5
#: A prediction is ambiguous if its probability is lower, or no more than this above the runner-up's.
MIN_SCORE, MIN_LEAD = 0.5, 0.1

_letters: np.ndarray | None = None


def _is_letter() -> np.ndarray:
    """For each code point, whether it is a letter or a mark within words."""
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000)
    return _letters


def ngram_counts(text: str) -> np.ndarray | None:
    """Counts of the hashed 2- and 3-grams of the lower-cased letters, with one blank for whatever stands between words; None without a letter."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    letter = _is_letter()[codes]
    if not letter.any():
        return None
    before = np.concatenate(([False], letter[:-1]))
    c = np.where(letter, codes, np.uint32(32))[letter | before]
    c = np.concatenate(([np.uint32(32)], c, [np.uint32(32)])).astype(np.uint32)
    with np.errstate(over="ignore"):
        two = c[:-1] * np.uint32(0x9E3779B1) + c[1:] * np.uint32(0x85EBCA77)
        three = two[:-1] * np.uint32(0xC2B2AE3D) + c[2:] * np.uint32(0x27D4EB2F)
        grams = np.concatenate((two, three ^ np.uint32(0x165667B1)))
        grams ^= grams >> np.uint32(15)
        grams *= np.uint32(0x2C1B3C6D)
    return np.minimum(np.bincount(grams >> np.uint32(32 - BUCKETS.bit_length() + 1), minlength=BUCKETS), 65_535).astype(np.uint16)


def _scaled(counts: np.ndarray) -> np.ndarray:
    x = np.sqrt(counts.astype(np.float32))
    return x / np.maximum(np.sqrt((x * x).sum(axis=-1, keepdims=True)), 1e-9)


def codewords(n: int, seed: int = 7) -> np.ndarray:
    """n codewords of bits, rows by language: all splits of the languages in two for up to 7, else the best spread of random codes."""
    if n <= 7:
        masks = np.arange(1, 1 << max(n - 1, 0))
        return ((masks[None, :] >> np.arange(n)[:, None]) & 1).astype(np.int8)
    rng, bits, best, spread = np.random.default_rng(seed), 10 * int(np.ceil(np.log2(n))), None, -1
    for _ in range(200):
        code = rng.integers(0, 2, (n, bits), dtype=np.int8)
        least = min(int((code[i] != code[i + 1 :]).sum(axis=1).min()) for i in range(n - 1))
        if least > spread:
            best, spread = code, least
    return best


@dataclass
class EcocModel:
    """languages (rows of code), code, trust (of each bit for each language, rows sum to 1), weights and bias of each bit's classifier."""

    languages: list[str]
    code: np.ndarray
    trust: np.ndarray
    weights: np.ndarray
    bias: np.ndarray

    def probabilities(self, counts: np.ndarray) -> np.ndarray:
        """Loss-weighted decoding: each language's trust-weighted logistic loss against its codeword, as probabilities over languages."""
        if not self.code.shape[1]:
            return np.ones((*counts.shape[:-1], len(self.languages)))
        z = _scaled(counts) @ self.weights + self.bias
        loss = np.logaddexp(0, -(2.0 * self.code - 1) * z[..., None, :])
        d = (self.trust * loss).sum(axis=-1) * self.code.shape[1]
        p = np.exp(d.min(axis=-1, keepdims=True) - d)
        return p / p.sum(axis=-1, keepdims=True)


def _fit(x: np.ndarray, bits: np.ndarray, weight: np.ndarray, rounds: int = 150) -> tuple[np.ndarray, np.ndarray]:
    """Logistic regressions of all bits at once, by Adam over the whole sample."""
    w, b = np.zeros((x.shape[1], bits.shape[1]), dtype=np.float32), np.zeros(bits.shape[1], dtype=np.float32)
    m, v, mb, vb = (np.zeros_like(a) for a in (w, w, b, b))
    weight = (weight / weight.sum()).astype(np.float32)[:, None]
    for t in range(1, rounds + 1):
        error = (1 / (1 + np.exp(-(x @ w + b))) - bits) * weight
        for param, grad, first, second in ((w, x.T @ error + 1e-6 * w, m, v), (b, error.sum(axis=0), mb, vb)):
            first += 0.1 * (grad - first)
            second += 0.001 * (grad * grad - second)
            param -= 0.3 * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8)
    return w, b


def train(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang", max_docs: int = MAX_TRAIN_DOCS, seed: int = 7) -> EcocModel:
    """A model from the documents that aren't held out and have a lang: from about max_docs of them, chosen by a hash of the id.

    Of rows that repeat an id with one lang only the text with the least hash is taken, so no id brings more than that into the sample. Each gives two examples, its whole text and a few words of it, so that short texts are learned too. Without labelled
    documents the model has no languages.
    """
    picked = docs.where(F.col(lang_column).isNotNull() & ~fold_held_out(F.col(id_column)))
    picked = picked.select(F.col(id_column).cast("string").alias("id"), F.col(text_column).cast("string").alias("text"), F.col(lang_column).cast("string").alias("lang"))
    counts = {r[0]: r[1] for r in picked.groupBy("lang").count().collect() if r[1] >= MIN_LANG_DOCS}
    languages = sorted(counts)
    if not languages:
        return EcocModel([], np.zeros((0, 0), dtype=np.int8), np.zeros((0, 0)), np.zeros((BUCKETS, 0), dtype=np.float32), np.zeros(0, dtype=np.float32))
    share = max(1, max_docs // len(languages))
    lot = F.pmod(F.xxhash64(F.col("id"), F.lit(seed)), F.lit(1_000_000))
    chosen = F.lit(False)
    for lang in languages:
        chosen = chosen | ((F.col("lang") == lang) & (lot < int(1_000_000 * min(1.0, share / counts[lang])) + 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, vectors = [], []
            for doc, lang, text in zip(*(batch.column(c).to_pylist() for c in ("id", "lang", "text")), strict=True):
                words = (text or "").split()
                at = sum((doc or "").encode()) * 7919 % max(1, len(words) - 8)
                for part in (text or "", " ".join(words[at : at + 8])):
                    found = ngram_counts(part)
                    if found is not None:
                        langs.append(lang)
                        vectors.append(found.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(vectors, pa.binary())], names=["lang", "counts"])

    once = picked.where(chosen).groupBy("id", "lang").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    table = once.mapInArrow(run, "lang string, counts binary").toArrow()
    code = codewords(len(languages))
    if not table.num_rows or not code.shape[1]:
        return EcocModel(languages, code[:, :0], np.ones((len(languages), 0)), np.zeros((BUCKETS, 0), dtype=np.float32), np.zeros(0, dtype=np.float32))
    x = _scaled(np.frombuffer(b"".join(table["counts"].to_pylist()), dtype=np.uint16).reshape(-1, BUCKETS))
    y = np.searchsorted(np.array(languages), np.array(table["lang"].to_pylist()))
    per_lang = np.bincount(y, minlength=len(languages))
    bits = code[y].astype(np.float32)
    w, b = _fit(x, bits, 1 / per_lang[y])
    right = (x @ w + b > 0) == (bits > 0)
    trust = np.stack([right[y == i].mean(axis=0) if (y == i).any() else np.ones(code.shape[1]) for i in range(len(languages))])
    return EcocModel(languages, code, trust / trust.sum(axis=1, keepdims=True), w, b)


def identify(docs: DataFrame, model: EcocModel, id_column: str = "doc_id", text_column: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, columns of keep, lang_pred, score, runner_up, ambiguous) of every whole text; texts are read but not given back.

    `und` with score 0 where the text is null or has no letter, or the model no languages. ambiguous: the nearest codeword is
    not near enough, or not nearer enough than the next. Ties go to the first language by name.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: EcocModel = shared.value
        names = np.array([*m.languages, UNDETERMINED, None], dtype=object)
        n = len(m.languages)
        for batch in batches:
            best, second = np.full(batch.num_rows, n), np.full(batch.num_rows, n + 1)
            score, lead = np.zeros(batch.num_rows), np.zeros(batch.num_rows)
            for start, texts in text_batches(batch, "__text") if n else ():
                for j in range(0, len(texts), 256):
                    found = [(i, c) for i, t in enumerate(texts[j : j + 256], start + j) if (c := ngram_counts(t)) is not None]
                    if not found:
                        continue
                    at = np.array([i for i, _ in found])
                    p = m.probabilities(np.stack([c for _, c in found]))
                    order = np.argsort(-p, axis=1, kind="stable")
                    best[at] = order[:, 0]
                    score[at] = np.take_along_axis(p, order[:, :1], 1)[:, 0]
                    lead[at] = score[at]
                    if n > 1:
                        second[at] = order[:, 1]
                        lead[at] -= np.take_along_axis(p, order[:, 1:2], 1)[:, 0]
            vague = (best < n) & ((score < MIN_SCORE) | (lead <= MIN_LEAD))
            columns = [*map(batch.column, own), pa.array(names[best], pa.string()), pa.array(np.clip(score, 0, 1)), pa.array(names[second], pa.string()), pa.array(vague)]
            yield pa.RecordBatch.from_arrays(columns, names=[*own, *new])

    new = ["lang_pred", "score", "runner_up", "ambiguous"]
    own = ["doc_id", *keep]
    picked = docs.select(F.col(id_column).cast("long").alias("doc_id"), *keep, F.col(text_column).cast("string").alias("__text"))
    return picked.mapInArrow(run, ", ".join([*[f"`{c}` {picked.schema[c].dataType.simpleString()}" for c in own], "lang_pred string, score double, runner_up string, ambiguous boolean"]))


def drop_unidentified(docs: DataFrame) -> DataFrame:
    """The stage: rows whose language is undetermined or ambiguous go; lang becomes the predicted one where it was null.

    Each row is judged by its own text. Only rows that go or lack a language are noted, by id and the text's hash, and written, so
    that the join is broadcast where their number allows it and the texts stay where they are.
    """
    copy = F.xxhash64(F.col("text").cast("string"))
    judged = identify(docs.select("doc_id", "text", copy.alias("__copy"), F.col("lang").isNull().alias("__bare")), train(docs), keep=("__copy", "__bare"))
    goes = (F.col("lang_pred") == UNDETERMINED) | F.col("ambiguous")
    noted = judged.where(goes | F.col("__bare")).groupBy(F.col("doc_id").alias("__id"), "__copy").agg(F.bool_or(goes).alias("__goes"), F.min("lang_pred").alias("__lang"))
    kept = docs.join(bounded(stored(noted, "languages")), F.col("doc_id").eqNullSafe(F.col("__id")) & (copy == F.col("__copy")), "left").where("__goes is null or not __goes")
    return kept.withColumn("lang", F.coalesce("lang", "__lang")).select(*docs.columns)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's predicted language, by a model of the documents that aren't held out."""
    docs = read_table(spark, sf_dir, "documents")
    found = identify(docs, train(docs))
    return found.select("doc_id", fold_held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "runner_up", "ambiguous")
