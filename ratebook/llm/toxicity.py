"""Toxicity by a convolutional text classifier in numpy, with thresholds calibrated by language."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import language_id
from .common import bounded, fold_held_out, read_table, stored, text_batches

__all__ = ["ToxicityModel", "op6_toxicity", "score", "train", "trained"]

#: Buckets of the hashed embeddings, their size, filters of each width, and the widths in words.
BUCKETS, SIZE, FILTERS, WIDTHS = 1 << 16, 8, 8, (1, 2, 3)
#: Bounds of the training sample, in documents with label 1 and with label 0.
MAX_POSITIVE, MAX_NEGATIVE = 1_500, 3_000
EPOCHS, BATCH, RATE = 8, 64, 0.05
#: Labelled documents of a language, of either label, below which the common threshold holds.
MIN_CALIBRATION = 12
CACHE_WORDS = 300_000
#: Bins of probability in which thresholds are sought.
BINS = 1 << 16
#: Bytes of the longest word that is kept, so that unspaced texts aren't.
WORD_BYTES = 64

_PUNCTUATION = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_SAME = bytes(range(256))


class _Hasher:
    """Buckets of words: of the word itself and of its first 4 and 6 bytes, so that inflected and compound words share some."""

    def __init__(self) -> None:
        self.known: dict[bytes, bytes] = {}

    def __call__(self, text: str) -> np.ndarray:
        words = text.lower().encode("utf-8", "surrogatepass").translate(_SAME, _PUNCTUATION).split()
        known, digest, mask = self.known, xxhash.xxh32_intdigest, BUCKETS - 1
        if max(map(len, words), default=0) > WORD_BYTES:
            return self._slow(words)
        for w in words:
            if w not in known:
                if len(known) >= CACHE_WORDS:
                    known.clear()
                    return self(text) if len(set(words)) < CACHE_WORDS else self._slow(words)
                known[w] = np.array([digest(w) & mask, digest(w[:4], 1) & mask, digest(w[:6], 2) & mask], dtype=np.int32).tobytes()
        return np.frombuffer(b"".join(map(known.__getitem__, words)), dtype=np.int32).reshape(-1, 3)

    def _slow(self, words: list[bytes]) -> np.ndarray:
        mask, digest = BUCKETS - 1, xxhash.xxh32_intdigest
        return np.array([(digest(w) & mask, digest(w[:4], 1) & mask, digest(w[:6], 2) & mask) for w in words], dtype=np.int32).reshape(-1, 3)


@dataclass
class ToxicityModel:
    """embedding (buckets x size), filters (one array of width x size x filters for each width), their bias, the output layer, thresholds."""

    embedding: np.ndarray
    filters: list[np.ndarray]
    bias: np.ndarray
    out: np.ndarray
    out_bias: float
    languages: language_id.EcocModel
    thresholds: dict[str, float] = field(default_factory=dict)
    common: float = 0.5

    def convolve(self, docs: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
        """(window values for each width, first windows, numbers of windows, buckets) of documents laid end to end, two empty words (-1) after each.

        A document of n words has n windows of every width, and one if it has none.
        """
        sizes = np.array([max(1, d.shape[0]) for d in docs])
        starts = np.concatenate(([0], np.cumsum(sizes + 2)[:-1]))
        laid = np.full((int(sizes.sum() + 2 * sizes.size), 3), -1, dtype=np.int32)
        for d, a in zip(docs, starts.tolist(), strict=True):
            laid[a : a + d.shape[0]] = d
        x = self.embedding[laid[:, 0]] + self.embedding[laid[:, 1]] + self.embedding[laid[:, 2]]
        x[laid[:, 0] < 0] = 0
        values = []
        for w, f in zip(WIDTHS, self.filters, strict=True):
            n = x.shape[0] - w + 1
            value = x[:n] @ f[0]
            for j in range(1, w):
                value += x[j : j + n] @ f[j]
            values.append(value)
        return values, starts, sizes, laid

    def pooled(self, docs: list[np.ndarray]) -> np.ndarray:
        values, starts, sizes, _ = self.convolve(docs)
        cuts = np.stack([starts, starts + sizes], axis=1).ravel()
        top = [np.maximum.reduceat(np.concatenate((v, np.zeros((3, v.shape[1]), dtype=np.float32))), cuts, axis=0)[::2] for v in values]
        return np.maximum(np.concatenate(top, axis=1) + self.bias, 0)

    def probability(self, docs: list[np.ndarray]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.pooled(docs) @ self.out + self.out_bias, -30, 30)))

    def calibrated(self, p: np.ndarray, langs: list[str]) -> np.ndarray:
        """Probabilities moved so that a language's threshold comes to lie at 0.5; order within a language stays."""
        t = np.array([self.thresholds.get(lang, self.common) for lang in langs])
        return np.where(p < t, 0.5 * p / t, 0.5 + 0.5 * (p - t) / (1 - t))


def _languages(model: language_id.EcocModel, texts: list[str]) -> list[str]:
    out = [language_id.UNDETERMINED] * len(texts)
    for j in range(0, len(texts) if model.languages else 0, 256):
        found = [(i, c) for i, t in enumerate(texts[j : j + 256], j) if (c := language_id.ngram_counts(t)) is not None]
        best = model.probabilities(np.stack([c for _, c in found])).argmax(axis=1) if found else ()
        for (i, _), b in zip(found, best, strict=True):
            out[i] = model.languages[b]
    return out


def _initial(docs: list[np.ndarray], y: np.ndarray, languages: language_id.EcocModel, rng: np.random.Generator) -> ToxicityModel:
    """Small random weights, but the first embedding value starts at the bucket's log odds and the first filter of width 1 reads it."""
    seen = np.zeros((2, BUCKETS))
    for d, label in zip(docs, y, strict=True):
        seen[int(label), np.unique(d)] += 1
    odds = np.log((seen[1] + 0.5) / (y.sum() + 1)) - np.log((seen[0] + 0.5) / ((1 - y).sum() + 1))
    embedding = rng.normal(0, 0.05, (BUCKETS, SIZE)).astype(np.float32)
    embedding[:, 0] = np.where(seen.sum(axis=0) >= 5, np.clip(odds, -3, 3), 0) / 6
    filters = [rng.normal(0, 0.3, (w, SIZE, FILTERS)).astype(np.float32) for w in WIDTHS]
    filters[0][0, 0, 0] = 1.0
    n = FILTERS * len(WIDTHS)
    return ToxicityModel(embedding, filters, np.zeros(n, dtype=np.float32), rng.normal(0, 0.1, n).astype(np.float32), 0.0, languages)


def _learn(model: ToxicityModel, docs: list[np.ndarray], y: np.ndarray, rng: np.random.Generator) -> None:
    """Adagrad on the logistic loss, classes weighted alike; through max pooling only the winning windows learn."""
    weight = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum())) * y.size
    sums = {k: np.full_like(v, 1e-6) for k, v in (("e", model.embedding), ("b", model.bias), ("o", model.out), *((f"f{i}", f) for i, f in enumerate(model.filters)))}

    def step(name: str, value: np.ndarray, grad: np.ndarray, rows: np.ndarray | None = None) -> None:
        at = slice(None) if rows is None else rows
        sums[name][at] += grad * grad
        value[at] -= RATE * grad / np.sqrt(sums[name][at])

    for _ in range(EPOCHS):
        order = rng.permutation(len(docs))
        for k in range(0, len(docs), BATCH):
            rows = order[k : k + BATCH]
            part = [docs[i] for i in rows]
            values, starts, sizes, laid = model.convolve(part)
            where = [np.stack([a + v[a : a + n].argmax(axis=0) for a, n in zip(starts.tolist(), sizes.tolist(), strict=True)]) for v in values]
            top = np.concatenate([np.take_along_axis(v, w, axis=0) for v, w in zip(values, where, strict=True)], axis=1) + model.bias
            h = np.maximum(top, 0)
            error = (1 / (1 + np.exp(-np.clip(h @ model.out + model.out_bias, -30, 30))) - y[rows]) * weight[rows] / rows.size
            grad_h = (error[:, None] * model.out[None, :] * (top > 0)).astype(np.float32)
            step("o", model.out, (h.T @ error).astype(np.float32))
            model.out_bias -= RATE * float(error.sum())
            step("b", model.bias, grad_h.sum(axis=0))
            touched, grads = [], []
            for i, (w, f) in enumerate(zip(WIDTHS, model.filters, strict=True)):
                g = grad_h[:, i * FILTERS : (i + 1) * FILTERS]
                grad_f = np.zeros_like(f)
                for j in range(w):
                    ids = laid[where[i] + j]
                    ok = (ids[..., 0] >= 0) & (g != 0)
                    grad_f[j] = np.einsum("rfs,rf->sf", model.embedding[ids].sum(axis=2), g * ok)
                    touched.append(ids[ok].ravel())
                    grads.append(np.repeat((f[j].T[None] * g[..., None])[ok], 3, axis=0))
                step(f"f{i}", f, grad_f)
            if touched:
                ids, at = np.unique(np.concatenate(touched), return_inverse=True)
                total = np.zeros((ids.size, SIZE), dtype=np.float32)
                np.add.at(total, at, np.concatenate(grads))
                step("e", model.embedding, total, ids)


def _threshold(bins: np.ndarray, n: np.ndarray, hits: np.ndarray) -> float:
    """The middle of the gap of probabilities at which F1 is best; n documents and hits with label 1 by bin of probability, bins not repeated."""
    order = np.argsort(-bins)
    bins, n, hits = bins[order], np.cumsum(n[order]), np.cumsum(hits[order])
    best = int((2 * hits / (n + hits[-1])).argmax())
    after = (bins[best + 1] + 1) / BINS if best + 1 < bins.size else 0.0
    return float(np.clip((bins[best] / BINS + after) / 2, 1e-3, 1 - 1e-3))


def _scored(docs: DataFrame, model: ToxicityModel, id_column: str, text_column: str) -> DataFrame:
    """(id, copy, p, lang) of every whole text: a hash of it, the probability before calibration and the predicted language. Texts are read where they are and not given back."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, hasher = shared.value, _Hasher()
        for batch in batches:
            for start, texts in text_batches(batch, "text", 1_500_000):
                own = (batch.column(c).slice(start, len(texts)) for c in ("id", "copy"))
                yield pa.RecordBatch.from_arrays([*own, pa.array(m.probability([hasher(t) for t in texts]).astype(np.float64)), pa.array(_languages(m.languages, texts), pa.string())], names=["id", "copy", "p", "lang"])

    text = F.col(text_column).cast("string")
    picked = docs.select(F.col(id_column).alias("id"), F.xxhash64(text).alias("copy"), text.alias("text"))
    return picked.mapInArrow(run, f"id {picked.schema['id'].dataType.simpleString()}, copy long, p double, lang string")


def _calibrate(model: ToxicityModel, labelled: DataFrame, scored: DataFrame) -> None:
    """Thresholds from all labelled rows (id, y), by predicted language: counts of BINS bins of probability for each are what reaches the driver.

    scored is _scored() of the documents, so that labels meet a few numbers and no text is shuffled. Of rows that repeat an id the one with the least hash of its text counts.
    """
    met = scored.join(bounded(labelled), "id").groupBy("id", "y").agg(F.min(F.struct("copy", "p", "lang")).alias("s"))
    cut = F.least(F.floor(F.col("s.p") * BINS), F.lit(BINS - 1)).cast("long")
    counts = met.select("y", F.col("s.lang").alias("lang"), cut.alias("bin")).groupBy("lang", "bin").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("hits")).toArrow()
    langs = np.array(counts["lang"].to_pylist(), dtype=object)
    bins, n, hits = (counts[c].to_numpy().astype(np.int64) for c in ("bin", "n", "hits"))
    if not hits.sum():
        return
    each, at = np.unique(bins, return_inverse=True)
    model.common = _threshold(each, np.bincount(at, n).astype(np.int64), np.bincount(at, hits).astype(np.int64))
    for lang in sorted(set(langs)):
        mine = langs == lang
        if min(hits[mine].sum(), (n - hits)[mine].sum()) >= MIN_CALIBRATION:
            model.thresholds[lang] = _threshold(bins[mine], n[mine], hits[mine])


def train(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", label_column: str = "toxic", lang_column: str = "lang", max_positive: int = MAX_POSITIVE, max_negative: int = MAX_NEGATIVE, seed: int = 11) -> ToxicityModel | None:
    """The model of trained()."""
    return trained(docs, labels, id_column, text_column, label_column, lang_column, max_positive, max_negative, seed)[0]


def trained(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", label_column: str = "toxic", lang_column: str = "lang", max_positive: int = MAX_POSITIVE, max_negative: int = MAX_NEGATIVE, seed: int = 11) -> tuple[ToxicityModel | None, DataFrame | None]:
    """A model from labelled documents that aren't held out: weights from about max_positive and max_negative of them by a hash of the id, less a fifth.

    All others, a fifth of the labelled documents at least, set the thresholds, by predicted language. A document's label is the
    largest of its labels; null labels count as none. Of rows that repeat an id only the text with the least hash is taken. None without documents of both labels.
    The second value has every document's (id, copy, p, lang) before calibration, written: score() needn't read the texts again.
    """
    own = labels.where(F.col(label_column).isNotNull() & F.col(id_column).isNotNull() & ~fold_held_out(F.col(id_column)))
    own = own.groupBy(F.col(id_column).alias("id")).agg((F.max(label_column) > 0).cast("int").alias("y"))
    counts = {r["y"]: r["n"] for r in own.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(counts) < 2:
        return None, None
    lot = F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1_000_000))
    share = {y: int(1_000_000 * min(1.0, m / counts[y])) + 1 for y, m in ((0, max_negative), (1, max_positive))}
    aside = F.pmod(F.xxhash64("id", F.lit(seed + 1)), F.lit(5)) == 0
    own = own.withColumn("learn", (lot < F.when(F.col("y") == 1, share[1]).otherwise(share[0])) & ~aside)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = _Hasher()
        for batch in batches:
            ids = [hasher(t or "").tobytes() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id").cast(pa.string()), batch.column("y"), pa.array(ids, pa.binary())], names=["id", "y", "ids"])

    texts = docs.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text"))

    sample = texts.join(F.broadcast(own.where("learn").drop("learn")), "id")
    table = sample.groupBy("id", "y").agg(F.min_by("text", F.xxhash64("text")).alias("text")).mapInArrow(run, "id string, y int, ids binary").toArrow()  # the sample is bounded
    rows = sorted(zip(*(table[c].to_pylist() for c in ("id", "y", "ids")), strict=True))
    x, y = [np.frombuffer(r[2], dtype=np.int32).reshape(-1, 3) for r in rows], np.array([r[1] for r in rows])
    if not y.size or y.min() == y.max():
        return None, None
    rng = np.random.default_rng(seed)
    model = _initial(x, y, language_id.train(docs, id_column, text_column, lang_column), rng)
    _learn(model, x, y, rng)
    scored = stored(_scored(docs, model, id_column, text_column), "scored")
    _calibrate(model, stored(own.where("not learn").drop("learn"), "calibration"), scored)
    return model, scored


def score(docs: DataFrame, model: ToxicityModel | None, id_column: str = "doc_id", text_column: str = "text", scored: DataFrame | None = None) -> DataFrame:
    """(doc_id, score, lang_pred) of every whole text: 0.5 is its predicted language's threshold. Null counts as empty; without a model all score 0. scored is what trained() gave for these docs, if it is there."""
    if model is None:
        return docs.select(F.col(id_column).cast("long").alias("doc_id"), F.lit(0.0).alias("score"), F.lit(language_id.UNDETERMINED).alias("lang_pred"))
    scored = _scored(docs, model, id_column, text_column) if scored is None else scored

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            moved = shared.value.calibrated(batch.column("p").to_numpy(), batch.column("lang").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.clip(moved, 0, 1)), batch.column("lang")], names=["doc_id", "score", "lang_pred"])

    shared = docs.sparkSession.sparkContext.broadcast(ToxicityModel(*[np.empty(0)] * 4, 0.0, None, model.thresholds, model.common))
    return scored.select(F.col("id").cast("long").alias("doc_id"), "p", "lang").mapInArrow(run, "doc_id long, score double, lang_pred string")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity, by a model of the labelled documents that aren't held out."""
    docs = read_table(spark, sf_dir, "documents")
    model, scored = trained(docs, read_table(spark, sf_dir, "labels"))
    found = score(docs, model, scored=scored)
    return found.select("doc_id", fold_held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "lang_pred")
