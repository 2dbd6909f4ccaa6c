"""Language identification, toxicity and decontamination on small tables."""

import random

import numpy as np
from pyspark.sql import functions as F

from ratebook.llm import decontaminate, language_id, toxicity
from ratebook.llm.common import fold_held_out

SYLLABLES = {"aa": "ba ke ti mo lu", "bb": "shra ouk wem tiz grol", "cc": "éa ñu ço ße ïj", "dd": "при вет ска зал мор"}


def documents(n=240, seed=1):
    rng, rows = random.Random(seed), []
    for i in range(n):
        lang = rng.choice(sorted(SYLLABLES))
        words = ["".join(rng.choices(SYLLABLES[lang].split(), k=rng.choice([2, 3]))) for _ in range(rng.choice([4, 30, 80]))]
        rows.append((i, " ".join(words), lang))
    return rows


def test_codewords_are_apart():
    for n in (2, 4, 7, 12, 30):
        code = language_id.codewords(n)
        least = min(int((code[i] != code[j]).sum()) for i in range(n) for j in range(i))
        assert code.shape[0] == n and least >= (1 if n == 2 else 2 ** (n - 2) if n <= 7 else 8)


def test_language_id_learns_and_holds_out(spark):
    rows = documents() + [(900, None, "aa"), (901, "", None), (902, "123 !!", "bb"), (903, "bake timo", None), (None, "bake timo lulu", "aa")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("mine"))
    got = {r.doc_id: r for r in language_id.identify(docs, language_id.train(docs)).collect()}
    assert len(got) == len(rows)
    held = {r.doc_id for r in docs.select("doc_id", fold_held_out(F.col("doc_id")).alias("h")).where("h").collect()}
    tested = [(i, lang) for i, _, lang in rows[:240] if i in held]
    assert len(tested) > 25 and sum(got[i].lang_pred == lang for i, lang in tested) >= 0.95 * len(tested)
    assert [got[i].lang_pred for i in (900, 901, 902, 903)] == ["und", "und", "und", "aa"]
    assert all(0 <= r.score <= 1 for r in got.values()) and got[900].score == 0
    kept = language_id.drop_unidentified(docs)
    assert kept.columns == docs.columns
    assert {900, 901, 902}.isdisjoint({r.doc_id for r in kept.collect()}) and kept.where("doc_id = 903").first().lang == "aa"


def test_language_id_without_labels(spark):
    docs = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert [r.lang_pred for r in language_id.identify(docs, language_id.train(docs)).collect()] == ["und"]
    one = spark.createDataFrame([(i, "abc def", "xx") for i in range(30)], "doc_id long, text string, lang string")
    assert {r.lang_pred for r in language_id.identify(one, language_id.train(one)).collect()} == {"xx"}
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert language_id.identify(empty, language_id.train(empty)).count() == 0


def test_toxicity_learns_words(spark):
    rng, rows, labels = random.Random(4), [], []
    clean = [f"word{i}" for i in range(300)]
    for i in range(500):
        toxic = i % 4 == 0
        words = rng.choices(clean, k=rng.choice([5, 40, 200]))
        for _ in range(2 if toxic else 0):
            words.insert(rng.randrange(len(words)), rng.choice(["vilething", "grossness", "Nasty!"]))
        rows.append((i, " ".join(words), "aa"))
        labels.append((i, int(toxic)))
    rows += [(900, None, "aa"), (901, "", None), (902, "...", "aa")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    marks = spark.createDataFrame([*labels, (3, None), (None, 1), (7777, 1)], "doc_id long, toxic int")
    model = toxicity.train(docs, marks)
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    held = {r.doc_id for r in docs.select("doc_id", fold_held_out(F.col("doc_id")).alias("h")).where("h").collect()}
    right = [(got[i].score >= 0.5) == bool(y) for i, y in labels if i in held]
    assert len(right) > 60 and np.mean(right) >= 0.95
    assert all(0 <= r.score <= 1 for r in got.values()) and got[900].score < 0.5
    assert toxicity.train(docs, marks.where("toxic = 0")) is None
    assert {r.score for r in toxicity.score(docs, None).collect()} == {0.0}


def brute_tiles(item, doc, k):
    """The textbook greedy string tiling by rescans."""
    used_i, used_d, tiles = set(), set(), []
    while True:
        best = (0, 0, 0)
        for i in range(len(item)):
            for d in range(len(doc)):
                n = 0
                while i + n < len(item) and d + n < len(doc) and item[i + n] == doc[d + n] and i + n not in used_i and d + n not in used_d:
                    n += 1
                if n >= k and (n, -i, -d) > (best[0], -best[1], -best[2]):
                    best = (n, i, d)
        if not best[0]:
            return tiles
        n, i, d = best
        used_i |= set(range(i, i + n))
        used_d |= set(range(d, d + n))
        tiles.append((i, d, n))


def test_tiles_match_brute_force():
    rng = random.Random(8)
    for _ in range(60):
        item, doc, k = rng.choices("abc", k=rng.choice([6, 15, 25])), rng.choices("abc", k=rng.choice([6, 40])), rng.choice([2, 3, 4])
        at = [(i, d) for i in range(len(item) - k + 1) for d in range(len(doc) - k + 1) if item[i : i + k] == doc[d : d + k]]
        got = decontaminate.greedy_tiles(np.array([i for i, _ in at], dtype=np.int64), np.array([d for _, d in at], dtype=np.int64), k)
        assert sorted(got) == sorted(brute_tiles(item, doc, k))
        by_seed = {}
        for i, d in at:
            by_seed.setdefault(tuple(item[i : i + k]), (set(), set()))
            by_seed[tuple(item[i : i + k])][0].add(i)
            by_seed[tuple(item[i : i + k])][1].add(d)
        places = [(np.array(sorted(i)), np.array(sorted(d))) for i, d in by_seed.values()]
        assert sorted(decontaminate.greedy_tiles_by_rows(places, k) if places else []) == sorted(got)


def test_contamination(spark):
    rng = random.Random(9)
    words = [f"w{i}" for i in range(500)]
    item = rng.sample(words, 30)
    other = " ".join(rng.choices(words, k=300))
    texts = {
        1: other + " " + " ".join(item) + " tail", 2: " ".join(item[20:] + ["x"] + item[:10] + ["y"] + item[10:20]), 3: other, 4: " ".join(item[:9]), 5: ", ".join(item).upper(), 6: None, 7: "", 8: "one two", 9: "zero one two three",
    }
    docs = spark.createDataFrame([(i, t, 1) for i, t in texts.items()] + [(1, texts[1], 1), (None, " ".join(item), 1)], "doc_id long, text string, item_id int")
    items = spark.createDataFrame([(70, " ".join(item)), (71, "One two"), (72, None), (73, "")], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in decontaminate.contaminated_pairs(docs, items).collect()}
    assert set(got) == {(1, 70), (2, 70), (5, 70), (None, 70), (8, 71), (9, 71)}
    assert got[2, 70].reordered and got[2, 70].coverage == 1.0 and not got[1, 70].reordered
    kept = decontaminate.drop_contaminated(docs, items)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [3, 4, 6, 7]
    assert decontaminate.drop_contaminated(docs, items.where("item_id > 100")).count() == docs.count()


def test_identification_by_plain_loops(spark):
    """identify against counting, weighing and decoding by hand from the same weights."""
    rows = documents()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.train(docs)
    got = {r.doc_id: r for r in language_id.identify(docs, model).collect()}
    for i, text, _ in rows[::20]:
        counts = language_id.ngram_counts(text)
        x = [float(c) ** 0.5 for c in counts]
        size = sum(v * v for v in x) ** 0.5
        losses = []
        for lang in range(len(model.languages)):
            total = 0.0
            for bit in range(model.code.shape[1]):
                z = sum(v / size * float(model.weights[k, bit]) for k, v in enumerate(x) if v) + float(model.bias[bit])
                total += float(model.trust[lang, bit]) * float(np.log1p(np.exp(-z if model.code[lang, bit] else z)))
            losses.append(total * model.code.shape[1])
        weights = [float(np.exp(min(losses) - v)) for v in losses]
        best = max(range(len(losses)), key=lambda k: weights[k])
        assert got[i].lang_pred == model.languages[best] and abs(got[i].score - weights[best] / sum(weights)) < 1e-4


def test_language_stage_keeps_columns_and_judges_rows(spark):
    rows = [(i, t, None if i % 7 == 0 else lang, "mine") for i, t, lang in documents()] + [(1, None, "aa", "x"), (2, "123 !", "aa", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    kept = language_id.drop_unidentified(docs)
    assert kept.columns == docs.columns
    got = kept.collect()
    assert {r.score for r in got} == {"mine"} and all(r.lang for r in got) and len(got) > 200


def test_convolution_by_plain_loops():
    rng = np.random.default_rng(3)
    widths, filters = toxicity.WIDTHS, toxicity.FILTERS
    n = filters * len(widths)
    model = toxicity.ToxicityModel(
        rng.normal(size=(toxicity.BUCKETS, toxicity.SIZE)).astype(np.float32), [rng.normal(size=(w, toxicity.SIZE, filters)).astype(np.float32) for w in widths],
        rng.normal(size=n).astype(np.float32), rng.normal(size=n).astype(np.float32), 0.3, language_id.EcocModel([], np.zeros((0, 0)), np.zeros((0, 0)), np.zeros((1, 0)), np.zeros(0)),
    )
    docs = [rng.integers(0, toxicity.BUCKETS, (k, 3)).astype(np.int32) for k in (0, 1, 2, 7)]
    got = model.probability(docs)
    for d, p in zip(docs, got, strict=True):
        words = [sum(model.embedding[b].astype(float) for b in row) for row in d]
        padded = words + [np.zeros(toxicity.SIZE)] * 3
        h = []
        for w, f in zip(widths, model.filters, strict=True):
            for k in range(filters):
                values = [sum(float(padded[i + j] @ f[j, :, k]) for j in range(w)) for i in range(max(1, len(words)))]
                h.append(max(0.0, max(values) + float(model.bias[len(h)])))
        z = sum(a * float(b) for a, b in zip(h, model.out, strict=True)) + model.out_bias
        assert abs(p - 1 / (1 + np.exp(-z))) < 1e-3


def test_periodic_texts_are_walked_by_rows(spark):
    """2,000 x 300 repeats of each word make 1.2 million pairs of places; the group holds each place once."""
    docs = spark.createDataFrame([(1, "tick tock " * 2000)], "doc_id long, text string")
    items = spark.createDataFrame([(7, "tick tock " * 300)], "item_id long, text string")
    got = decontaminate.tile_pairs(docs, items).collect()
    assert [(r.doc_id, r.item_id, r.covered, r.n_tiles) for r in got] == [(1, 7, 600, 1)]


def test_thresholds_come_from_all_that_weights_leave(spark, monkeypatch):
    """Every labelled document that isn't held out and gave no weights counts for the thresholds, however small the sample of the weights."""
    rng, rows, labels = random.Random(5), [], []
    for i in range(400):
        words = rng.choices([f"word{j}" for j in range(80)], k=20) + ["vilething"] * (i % 4 == 0)
        rows.append((i, " ".join(words), "aa"))
        labels.append((i, int(i % 4 == 0)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    marks = spark.createDataFrame(labels, "doc_id long, toxic int")
    seen, learned = [], []
    threshold, learn = toxicity._threshold, toxicity._learn
    monkeypatch.setattr(toxicity, "_threshold", lambda bins, n, *hits: seen.append(int(np.sum(n)) if hits else bins.size) or threshold(bins, n, *hits))
    monkeypatch.setattr(toxicity, "_learn", lambda model, x, y, r: learned.append(len(x)) or learn(model, x, y, r))
    toxicity.train(docs, marks, max_positive=30, max_negative=60)
    given = docs.where(~fold_held_out(F.col("doc_id"))).count()
    assert 0 < learned[0] < 150 and seen[0] + learned[0] == given


def test_threshold_by_all_cuts():
    """The threshold against the best F1 of all cuts between different probabilities."""
    rng = np.random.default_rng(2)
    for _ in range(50):
        bins = np.sort(rng.choice(toxicity.BINS, 12, replace=False))
        n = rng.integers(1, 6, 12)
        hits = np.minimum(n, rng.integers(0, 6, 12))
        hits[-1] = max(hits[-1], 1)
        t = toxicity._threshold(bins, n, hits)
        f1 = [2 * hits[i:].sum() / (n[i:].sum() + hits.sum()) for i in range(12)]
        above = bins / toxicity.BINS >= t - 1e-9
        assert abs(2 * hits[above].sum() / (n[above].sum() + hits.sum()) - max(f1)) < 1e-9 or t in (1e-3, 1 - 1e-3)


def test_toxicity_thresholds_need_no_second_look_at_texts(spark, monkeypatch):
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choices(["swine", "fool"] if i % 3 == 0 else ["garden", "river"], k=30)), "en") for i in range(600)]
    docs = spark.createDataFrame(rows + [(3, None, "en"), (4, "river", "en")], "doc_id long, text string, lang string")
    marks = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(600)], "doc_id long, toxic int")
    seen, calls = [], []
    calibrate, scored = toxicity._calibrate, toxicity._scored
    monkeypatch.setattr(toxicity, "_calibrate", lambda model, labelled, found: seen.append((labelled.columns, found.columns, found.count())) or calibrate(model, labelled, found))
    monkeypatch.setattr(toxicity, "_scored", lambda *a: calls.append(1) or scored(*a))
    monkeypatch.setattr(toxicity, "read_table", lambda spark, sf_dir, name: {"documents": docs, "labels": marks}[name])
    got = sorted((r.doc_id, r.score) for r in toxicity.op6_toxicity(spark, "").collect())
    assert len(calls) == 1 and seen == [(["id", "y"], ["id", "copy", "p", "lang"], 602)]
    model = toxicity.train(docs, marks)
    assert got == sorted((r.doc_id, r.score) for r in toxicity.score(docs, model).collect()) and model.thresholds
    assert sum((s >= 0.5) == (i % 3 == 0) for i, s in got) >= 595
