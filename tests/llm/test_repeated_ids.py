"""Line dedup where ids are null or repeat with different texts."""

from ratebook.llm import line_dedup

DOCS = "doc_id long, text string"


def brute(spark, rows):
    """Texts by (id, text): rows in order of id, then of the text's hash; lines that equal an earlier one go."""
    docs = spark.createDataFrame(rows, DOCS)
    keyed = docs.select(*line_dedup._key("doc_id", "text"), "doc_id", "text").distinct().orderBy("id", "copy").collect()
    seen, out = set(), {}
    for r in keyed:
        kept = [line for line in r.text.split("\n") if not (line in seen or seen.add(line))]
        out[r.doc_id, r.text] = ("\n".join(kept), len(kept))
    return out


def test_null_and_repeated_ids(spark):
    rows = [(None, "foo"), (None, "bar"), (None, "foo\nquux"), (7, "one\ntwo"), (7, "three\none"), (7, "three\none"), (1, "two\nfour")]
    out = line_dedup.dedupe_lines(spark.createDataFrame(rows, DOCS).selectExpr("*", "text AS was"), text_column="text").collect()
    assert {(r.doc_id, r.was): (r.text, r.n_kept) for r in out} == brute(spark, rows)
    assert len(out) == len(rows) and all(r.n_kept <= r.n_lines for r in out)


def test_near_repeats_of_repeated_ids(spark):
    long = "a line of some length that has near copies"
    rows = [(1, long), (None, long.replace("near", "neat")), (None, "a line of its own, found nowhere else at all"), (7, "yet another line, which nothing repeats"), (7, long.replace("some", "same"))]
    out = line_dedup.dedupe_lines(spark.createDataFrame(rows, DOCS)).collect()
    assert sorted(r.text for r in out) == ["", "", rows[2][1], long, rows[3][1]]


def test_equal_pages_in_different_tasks(spark):
    from ratebook.llm import warc
    from ratebook.llm.common import scratch_dir

    long, big = "<p>" + "same " * 30, "".join(f"<p>line {i}</p>" for i in range(9000))
    rows = [(9, "u", long), (9, "u", long), (11, "u", long), (12, "u", big), (12, "u", big), (13, "v", big), (12, "w", big), (20, "u", None), (20, "u", None), (None, "u", long)]
    folder = scratch_dir(spark, "warc")
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5).selectExpr("page_id", "url", "cast(coalesce(html, '') as binary) as payload")
    marked = warc.mark_revisits(pages)
    warc.write_warc(marked.selectExpr("*", "first_id is not null as revisit"), folder)
    for got in (warc.read_pages(spark, folder).collect(), warc.page_digests(spark, folder).collect()):
        assert len(got) == len(rows) == len({r.record_id for r in got}) and all(r.complete for r in got)
        assert sorted((r.page_id or -1, r.record_type) for r in got) == sorted([(9, "response")] * 2 + [(11, "revisit"), (-1, "revisit")] + [(12, "response")] * 3 + [(13, "revisit")] + [(20, "response")] * 2)
        responses = {r.record_id for r in got if r.record_type == "response"}
        assert all(r.refers_to in responses for r in got if r.record_type == "revisit")


def test_stages_judge_each_row_by_itself(spark):
    from ratebook.llm import decontaminate

    item = "these words of the test item stand here in a row and nowhere else"
    docs = spark.createDataFrame([(1, "clean text of other words altogether, and no more"), (1, "before it " + item + " after it"), (2, None), (None, item)], DOCS)
    items = spark.createDataFrame([(7, item)], "item_id long, text string")
    assert sorted(decontaminate.drop_contaminated(docs, items).collect(), key=str) == sorted(docs.where("doc_id = 2 or text like 'clean%'").collect(), key=str)


def test_texts_of_one_item(spark):
    from ratebook.llm import decontaminate

    a, b = ("one two three four five six seven eight nine ten", "red green blue black white pink grey brown gold lime")
    items = spark.createDataFrame([(7, a), (7, b), (8, "only five words of it"), (8, "only five words of it and then another six of them")], "item_id long, text string")
    docs = spark.createDataFrame([(1, " ".join(a.split()[:5] + ["x"] + b.split()[:5])), (2, "before " + b + " after"), (3, "here only five words of it and no more")], DOCS)
    got = {(r.doc_id, r.item_id): (r.n_words, r.covered, round(r.coverage, 6)) for r in decontaminate.tile_pairs(docs, items).collect()}
    assert got == {(1, 7): (10, 5, 0.5), (2, 7): (10, 10, 1.0), (3, 8): (5, 5, 1.0)}
    assert {(r.doc_id, r.item_id) for r in decontaminate.contaminated_pairs(docs, items).collect()} == {(2, 7), (3, 8)}
    assert [r.doc_id for r in decontaminate.drop_contaminated(docs, items).collect()] == [1]


def test_samples_stay_bounded_with_a_hot_id(spark, monkeypatch):
    from pyspark.sql import functions as F

    from ratebook.llm import language_id, toxicity

    n = 30_000
    word = F.when(F.col("i") % 2 == 0, "the house of ").otherwise("das haus und ")
    hot = spark.range(2 * n).withColumnRenamed("id", "i").select(F.when(F.col("i") < n, 3).otherwise(F.col("i")).alias("doc_id"), F.concat(word, F.col("i").cast("string"), F.lit(" shown here")).alias("text"), F.when(F.col("i") % 2 == 0, "en").otherwise("de").alias("lang"), F.lit(0.5).alias("score"), F.lit("xx").alias("lang_pred"))
    seen = {}
    fit, learn = language_id._fit, toxicity._learn
    monkeypatch.setattr(language_id, "_fit", lambda x, *a: seen.setdefault("rows", len(x)) and fit(x[:, :], *a))
    monkeypatch.setattr(toxicity, "_learn", lambda model, docs, *a: seen.setdefault("learned", len(docs)))
    model = language_id.train(hot)
    assert model.languages == ["de", "en"] and seen["rows"] <= 2 * language_id.MAX_TRAIN_DOCS * 1.2
    labels = spark.range(n, 2 * n).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("toxic")).union(spark.createDataFrame([(3, 1), (3, 0)], "doc_id long, toxic int"))
    trained = toxicity.train(hot, labels)
    assert trained is not None and 100 < seen["learned"] <= (toxicity.MAX_POSITIVE + toxicity.MAX_NEGATIVE) * 1.2
    scored = toxicity.score(hot.limit(20), trained).collect()  # columns of the same names as the result's are not in the way
    assert len(scored) == 20 and all(0 <= r.score <= 1 for r in scored)
