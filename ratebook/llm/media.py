"""Media columns: interleaved sequences of text and media from HTML, with payloads in a store that digests lead to."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table, scratch_dir, stored

__all__ = ["as_image", "interleaved", "media_features", "op8_media", "resolve", "store_media"]

#: Samples of a row of the stored images, and rows of which their number is a multiple: 24 x 24 samples are 576.
ROW = 24
BLOCK = ROW * 24
REFERENCE = "media:"
_BREAKS = {"p", "div", "li", "h1", "h2", "h3", "h4", "h5", "h6", "article", "section", "nav", "footer", "header", "ul", "ol", "table", "tr", "td", "th", "blockquote", "pre", "br", "body", "title", "figure"}
_MEDIA = {"img", "video", "audio", "source", "embed"}
_SILENT = {"script", "style", "head", "noscript", "template"}


class _Sequence(HTMLParser):
    """Collects (kind, text, ref, caption) items in order. A figure's caption goes to the media in it, else their alt text does."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.items: list[list[str | None]] = []
        self.text: list[str] = []
        self.silent, self.figures, self.caption = 0, [], None

    def flush_text(self) -> None:
        text = "".join(self.text).strip()
        self.text = []
        if text:
            self.items.append(["text", text, None, None])

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in _SILENT:
            self.silent += 1
        if tag in _BREAKS or tag in _MEDIA:
            self.flush_text()
        if tag == "figure":
            self.figures.append(len(self.items))
        elif tag == "figcaption":
            self.flush_text()
            self.caption = []
        elif tag in _MEDIA:
            found = dict(attrs)
            if found.get("src"):
                self.items.append(["media", None, found["src"], found.get("alt")])

    def handle_endtag(self, tag: str) -> None:
        if tag in _SILENT:
            self.silent = max(0, self.silent - 1)
        if tag == "figcaption" and self.caption is not None:
            said, self.caption = "".join(self.caption).strip(), None
            for item in self.items[self.figures[-1] :] if self.figures else self.items[-1:]:
                if item[0] == "media":
                    item[3] = said
        elif tag in _BREAKS:
            self.flush_text()
            if tag == "figure" and self.figures:
                self.figures.pop()

    def handle_data(self, data: str) -> None:
        if self.caption is not None:
            self.caption.append(data)
        elif not self.silent:
            self.text.append(data)


def interleaved(pages: DataFrame, id_column: str = "page_id", html_column: str = "html") -> DataFrame:
    """(id, position, kind, text, ref, caption): the text blocks and media references of each page, in order of position.

    kind is text or media; ref is a media's src. Null or empty HTML gives no rows. Scripts and styles are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["id", "position", "kind", "text", "ref", "caption"]
        kinds = [pa.int64(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.string()]
        for batch in batches:
            rows, size = [], 0
            for page, html in zip(batch.column("id").to_pylist(), batch.column("html"), strict=True):
                parser, text = _Sequence(), html.as_py() or ""
                parser.feed(text)
                parser.close()
                parser.flush_text()
                rows += [(page, i, *item) for i, item in enumerate(parser.items)]
                size += len(text)
                if size > 4_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)

    picked = pages.select(F.col(id_column).cast("long").alias("id"), F.col(html_column).cast("string").alias("html"))
    return picked.mapInArrow(run, "id long, position int, kind string, text string, ref string, caption string")


def as_image(data: Column) -> Column:
    """The bytes as a binary PGM image of rows of 24 eight-bit samples; 255 fills up to a positive multiple of 576 samples."""
    n = F.greatest(F.ceil(F.octet_length(data) / BLOCK), F.lit(1)).cast("int") * BLOCK
    head = F.concat(F.lit(f"P5\n{ROW} "), (n / ROW).cast("int").cast("string"), F.lit("\n255\n")).cast("binary")
    return F.concat(head, F.rpad(data, n, F.lit(b"\xff")))


def store_media(media: DataFrame, folder: str) -> None:
    """Writes (digest, media) rows as Parquet; a digest may be there more than once, with equal bytes."""
    media.select("digest", "media").write.option("compression", "zstd").parquet(folder)


def media_features(spark: SparkSession, folder: str) -> DataFrame:
    """One row for each digest in the store: payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature.

    All are computed from the stored bytes, of which the digest is checked. feature has the mean of the samples, a 64-bit hash
    of which of 64 equal stretches are lighter than the whole, and the counts of samples by their high four bits.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for digest, media in zip(batch.column("digest").to_pylist(), batch.column("media"), strict=True):
                data = media.as_py()
                found = hashlib.sha256(data).hexdigest()
                if found != digest:
                    raise ValueError(f"stored media differ from their digest {digest}")
                kind, shape, _, payload = data.split(b"\n", 3)
                width, height = map(int, shape.split())
                if kind != b"P5" or width * height != len(payload):
                    raise ValueError("not the image that was stored")
                samples = np.frombuffer(payload, dtype=np.uint8)
                stretches = samples.reshape(64, -1).sum(axis=1, dtype=np.int64)
                total = int(stretches.sum())
                light = int(np.packbits(stretches * 64 > total).view(">u8")[0])
                counts = np.bincount(samples >> 4, minlength=16)
                feature = f"{total / samples.size:.3f}:{light:016x}:{','.join(map(str, counts.tolist()))}"
                rows.append((digest, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(data), found, feature))
            kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            names = ["digest", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)

    read = spark.read.schema("digest string, media binary").parquet(folder)
    found = read.mapInArrow(run, "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
    return found.dropDuplicates(["digest"])


def resolve(items: DataFrame, features: DataFrame) -> DataFrame:
    """items with what their references' digests lead to in the store (null for text and for what isn't there), positions and captions as they are."""
    digest = F.when(F.col("ref").startswith(REFERENCE), F.substring("ref", len(REFERENCE) + 1, 64))
    return items.withColumn("digest", digest).join(features, "digest", "left")


def _documents_as_pages(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, digest, media, html): each document as a page with its lines and a figure of which the image holds its bytes."""
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("t"))
    rows = rows.withColumn("media", as_image(F.col("t").cast("binary"))).withColumn("digest", F.sha2("media", 256))
    safe = F.replace(F.replace(F.replace("t", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    lines = F.replace(safe, F.lit("\n"), F.lit("</p><p>"))
    n_bytes = F.octet_length("t").cast("long")
    figure = F.concat(F.lit(f'</p><figure><img src="{REFERENCE}'), "digest", F.lit('"><figcaption>'), n_bytes.cast("string"), F.lit(" bytes</figcaption></figure></article>"))
    return rows.select("doc_id", "digest", "media", F.concat(F.lit("<article><p>"), lines, figure).alias("html"))


def op8_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's bytes as an image in the store, found again by way of its page's figure."""
    folder = scratch_dir(spark, "media")
    pages = _documents_as_pages(read_table(spark, sf_dir, "documents"))
    store_media(pages, folder)
    items = interleaved(pages.select("doc_id", "html"), "doc_id", "html").where("kind = 'media'")
    # written, so that both sides of the join are shuffles, of which adaptive execution splits a digest that many documents share
    found = resolve(items, stored(media_features(spark, folder), "features"))
    n_bytes = F.regexp_extract("caption", "^([0-9]+) bytes$", 1).cast("long").alias("n_bytes")
    return found.select(F.col("id").alias("doc_id"), n_bytes, "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "position", "caption")
