"""Quotes found by the index of word runs against trying every text."""

import random
import re

from pyspark.sql import functions as F

from ratebook.operators import quotes as QU


def words(text):
    plain = re.sub(r"(?i)<br\s*/?>", " ", text or "").lower().replace("ß", "ss")
    return re.findall(r"[^\W_]+", plain)


def holds(quote, text):
    q = words(quote)
    return bool(q) and f" {' '.join(q)} " in f" {' '.join(words(text))} "


def made(seed=5):
    rng = random.Random(seed)
    vocabulary = ["port", "dues", "per", "100", "tons", "Straße", "a", "of"]
    text = lambda n: " ".join(rng.choices(vocabulary, k=n))
    chunks = [(f"d{i % 3}" if i % 17 else None, i // 2 if i % 5 else i // 2 + 1, i, f"s{i % 4}", text(rng.randrange(1, 40))) for i in range(120)]
    chunks += [("d0", 60, 900, "s1", None), ("d0", 61, 901, "s1", ""), ("d0", 62, None, "s1", "the only rare words stand here"), ("d1", 70, 902, "s9", "tug" + "<BR/>" + "services, per-hour; of (500)"), ("d0", 80, 903, "s2", "port dues " * 5000)]
    cited = []
    for i in range(90):
        source = rng.choice(chunks)
        piece = (source[4] or "x").split()
        at = rng.randrange(len(piece) or 1)
        quote = " ".join(piece[at : at + rng.randrange(1, 9)]).upper() if i % 4 else text(rng.randrange(1, 7))
        cited.append((i, i % 2, rng.choice([source[0], "d1"]), rng.choice([source[1], 3]), rng.choice([source[3], "s0"]), quote))
    cited += [(200, 0, "d1", 0, "s9", "tug services per hour of 500"), (201, 0, "d0", 0, "s", "..."), (202, 0, "d0", 0, "s", None), (203, 0, None, 0, "s", "port"), (204, 0, "d0", 62, "s1", "the only rare words"), (205, 0, "d0", 0, "s", "port dues port dues port"), (205, 0, "d0", 0, "s", "port dues port dues port")]
    return chunks, cited


def test_retarget_and_repair(spark):
    chunks, cited = made()
    table = spark.createDataFrame(chunks, "document_id string, ordinal int, chunk_id int, section_ref string, content string").withColumn("run", F.lit(0)).withColumn("line", F.lit("mine"))
    citations = spark.createDataFrame(cited, "rule_id int, pos int, document_id string, ordinal int, section_ref string, quote string").withColumn("content", F.lit(""))

    def best(c):
        found = [(k[1] != c[3], k[3] != c[4], k[1], k[2]) for k in chunks if c[2] is not None and k[0] == c[2] and k[2] is not None and holds(c[5], k[4])]
        return min(found)[3] if found else None

    want = sorted(((c[0], c[1], best(c)) for c in cited), key=repr)
    assert sorted(map(tuple, QU.retarget_citations(citations, table).collect()), key=repr) == want
    assert sum(w[2] is not None for w in want) > 50 and sum(w[2] is None for w in want) > 5

    named = citations.withColumn("chunk_id", F.col("rule_id"))

    def repaired(c):
        found = [k[2] for k in chunks if c[2] is not None and k[0] == c[2] and k[2] is not None and holds(c[5], k[4])]
        return (c[0], c[1], c[0], False) if c[0] in found or not found else (c[0], c[1], min(found), True)

    assert sorted(map(tuple, QU.repair_citations(named, table).collect())) == sorted(map(repaired, cited))


def test_places_don_t_depend_on_the_run_length(spark):
    chunks, cited = made(6)
    table = spark.createDataFrame(chunks, "document_id string, ordinal int, chunk_id int, section_ref string, content string")
    citations = spark.createDataFrame(cited, "rule_id int, pos int, document_id string, ordinal int, section_ref string, quote string")
    places = [sorted(map(tuple, QU.quote_places(citations, table, run=k).collect())) for k in (1, 2, 4, 7)]
    assert places[0] and all(p == places[0] for p in places)
    assert QU.quote_places(citations, table.limit(0)).collect() == [] and QU.quote_places(citations.limit(0), table).collect() == []
