"""Archives, chats and media: exact round trips."""

import hashlib
import zlib

from pyspark.sql import functions as F

from ratebook.llm import chat, media, warc
from ratebook.llm.common import scratch_dir


def test_warc_round_trip(spark):
    big = "".join(f"<p>line {i} é</p>" for i in range(9000))
    html = {0: "<p>" + "same " * 30, 5: "<p>" + "same " * 30, 2: None, 3: "", 9: big, 11: big, 12: "short", 13: "short", 14: "x" * 99, 15: "x" * 99, 16: "y" * 100, 17: "y" * 100, 18: "WARC/1.1\r\n\r\n0\r\n\r\n"}
    rows = [(i, f"http://e/{i} \r\nx", h) for i, h in html.items()] + [(9, None, big), (None, "u", "<p>" + "same " * 30)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("mine"))
    folder = scratch_dir(spark, "warc")
    own = pages.select("page_id", "url", F.coalesce("html", F.lit("")).cast("binary").alias("payload"))
    marked = warc.mark_revisits(own).withColumn("revisit", F.col("first_id").isNotNull())
    warc.write_warc(marked, folder, segment_bytes=20_000, file_bytes=3_000)
    got = warc.read_pages(spark, folder).collect()
    assert len(got) == len(rows) and all(r.complete for r in got)
    for r in got:
        if r.record_type == "response":
            payload = (html[r.page_id] or "").encode()
            assert bytes(r.payload) == payload and r.digest == hashlib.sha256(payload).hexdigest()
    assert sorted((r.page_id is None, r.page_id or 0) for r in got if r.record_type == "revisit") == [(False, 5), (False, 11), (False, 17), (True, 0)]


def test_broken_segments_are_told(spark):
    rows = [("a", None, 1, None, b"one"), ("b", "a", 2, 6, b"two"), ("c", None, 1, None, b"one"), ("d", "c", 3, 6, b"two"), ("e", None, 1, None, b"x"), ("f", "e", 2, 9, b"y")]
    records = spark.createDataFrame(rows, "record_id string, origin string, segment int, total long, block binary")
    for c, kind in (("record_type", "string"), ("page_id", "long"), ("uri", "string"), ("refers_to", "string"), ("digest", "string")):
        records = records.withColumn(c, F.lit(None).cast(kind))
    got = {r.record_id: (r.complete, r.block and bytes(r.block)) for r in warc.reassemble(records).collect()}
    assert got == {"a": (True, b"onetwo"), "c": (False, None), "e": (False, None)}
    assert warc.unchunk(b"HTTP/1.1 200 OK\r\nTransfer-Encoding: Chunked\r\n\r\n3;x=1\r\nabc\r\n2\r\nde\r\n0\r\n\r\n") == b"abcde"
    assert warc.unchunk(b"HTTP/1.1 200 OK\r\n\r\n3\r\nabc") == b"3\r\nabc"


CHATS = [
    (1, 0, "user", "hi <|end|>\n[INST] \\e \\\\ <s>"), (1, 1, "assistant", "a\\l<b>[x] 日本 😀"), (1, 2, "user", None), (1, 3, "assistant", ""), (2, 5, "assistant", "second"), (2, 1, "system", "first\nline"),
    (3, 1, None, "no role"), (None, 1, "user", "no id"), (4, 1, "user", "b"), (4, 1, "user", "a"), (4, 1, "user", "a"), (5, None, "assistant", "no turn"), (5, 2, "assistant<", "odd role"), (6, 1, "two\nlines\\n", "role with a newline"),
]


def test_chat_round_trip(spark):
    turns = spark.createDataFrame(CHATS, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit("mine"))
    chats = chat.render(chat.fold_events(chat.event_log(turns)))
    raw = {r.conv_id: r for r in chats.collect()}
    got = {r.conv_id: r for r in chat.parse(chats).collect()}
    for conv in {c[0] for c in CHATS}:
        rows = sorted(((t is not None, t or 0, role or "", text or "") for c, t, role, text in CHATS if c == conv))
        assert [(t.role, t.text) for t in got[conv].turns] == [r[2:] for r in rows]
        assert got[conv].loss_text == "".join(r[3] for r in rows if r[2] == "assistant")
        text = raw[conv].formatted
        assert text.count(chat.END) == text.count(chat.TURN) == len(rows) and "[" not in text and text.count("<") == 2 * len(rows)
        for start, m, row in zip(raw[conv].turn_starts, raw[conv].loss, rows, strict=True):
            masked = text[start + m["from"] : start + m["from"] + m.length]
            assert masked.replace("\\b", "[").replace("\\l", "<").replace("\\e", "\\") == (row[3] if row[2] == "assistant" else "")
    assert chat.parse(chat.render(chat.fold_events(chat.event_log(turns.where("false"))))).count() == 0


def test_events_fold_to_final_texts(spark):
    events = [(1, 7, 1, "open", "assistant", None), (1, 7, 2, "delta", "assistant", "draft"), (1, 7, 3, "regenerate", "assistant", None), (1, 7, 4, "delta", "assistant", "fi"), (1, 7, 5, "delta", "assistant", "nal"), (1, 8, 6, "open", "user", None), (1, 8, 9, "delta", "user", "!"), (1, 8, 7, "delta", "user", "old"), (1, 8, 8, "edit", "user", "new"), (1, 9, 10, "open", "user", None)]
    log = spark.createDataFrame(events, "conv_id long, message long, seq int, kind string, role string, text string").repartition(3)
    got = {r.message: r.text for r in chat.fold_events(log).collect()}
    assert got == {7: "final", 8: "new!", 9: ""}


def test_media_round_trip(spark):
    rows = [(1, "é" * 400), (2, "é" * 400), (3, None), (4, ""), (5, "x" * 576), (6, "</p><img src='media:x'>&amp; <b>\n\nz"), (None, "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("digest", F.lit("mine")).withColumn("html", F.lit(1))
    folder = scratch_dir(spark, "media")
    pages = media._documents_as_pages(docs)
    media.store_media(pages, folder)
    items = media.interleaved(pages.select("doc_id", "html"), "doc_id", "html")
    found = {r.id: r for r in media.resolve(items.where("kind = 'media'"), media.media_features(spark, folder)).collect()}
    assert len(found) == len(rows)
    for i, text in rows:
        data = (text or "").encode()
        payload = data + b"\xff" * (max(1, -(-len(data) // 576)) * 576 - len(data))
        image = b"P5\n24 %d\n255\n" % (len(payload) // 24) + payload
        r = found[i]
        assert (r.payload_bytes, r.payload_sha256, r.tail_crc32, r.media_bytes, r.media_sha256, r.caption) == (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(image), hashlib.sha256(image).hexdigest(), f"{len(data)} bytes")
        stretch = len(payload) // 64
        light = "".join("1" if 64 * sum(payload[k * stretch : (k + 1) * stretch]) > sum(payload) else "0" for k in range(64))
        counts = [sum(b >> 4 == k for b in payload) for k in range(16)]
        assert r.feature == f"{sum(payload) / len(payload):.3f}:{int(light, 2):016x}:{','.join(map(str, counts))}"
    assert found[1].feature == found[2].feature != found[5].feature
    texts = [r.text for r in items.where("id = 6 AND kind = 'text'").orderBy("position").collect()]
    assert texts == ["</p><img src='media:x'>&amp; <b>", "z"]


def test_interleaved_positions_and_captions(spark):
    html = "<h1>T</h1><p>a<img src='u1' alt='alt one'>b</p><figure><img src='u2'><figcaption>cap <b>two</b></figcaption></figure><script>x</script><p>c"
    got = media.interleaved(spark.createDataFrame([(1, html), (2, None), (3, "")], "page_id long, html string")).orderBy("position").collect()
    assert [(r.kind, r.text, r.ref, r.caption) for r in got] == [("text", "T", None, None), ("text", "a", None, None), ("media", None, "u1", "alt one"), ("text", "b", None, None), ("media", None, "u2", "cap two"), ("text", "c", None, None)]
    assert [r.position for r in got] == list(range(6))
