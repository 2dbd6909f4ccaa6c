"""The whole pipeline against plain loops, stage by stage, on rows with nulls, repeated ids, near copies and test items."""

import random
import tempfile

import numpy as np
import xxhash
from test_line_and_near_dedup import fingerprint
from test_text_models import brute_tiles, documents
from test_tokens import brute as best_pieces

import corpus_pipeline
from ratebook.llm import decontaminate, language_id, line_dedup, sentence_pieces

ITEM = "the quick item of a test that stands here in full with all of its words in a row"


def rows():
    rng = random.Random(7)
    made = [(i, t, lang) for i, t, lang in documents(160)]
    texts = [t for _, t, _ in made]
    near = []
    for i in range(12):
        words = texts[i * 9].split()
        words = words * (1 + 60 // len(words))
        near.append((2000 + i, " ".join(words), made[i * 9][2]))
        words[len(words) // 2] = words[1] + "xx"
        near.append((3000 + i, " ".join(words) + " also", made[i * 9][2]))
    leaks = [(4000 + i, " ".join(texts[i].split()[:30]) + " " + part, made[i][2]) for i, part in enumerate([ITEM, " ".join(ITEM.split()[9:] + ITEM.split()[:9]), " ".join(ITEM.split()[:6])])]
    lines = [(5000 + i, "\n".join(rng.choices([texts[3], texts[4], texts[4] + "s", texts[70] + " and more", ""], k=4)), "") for i in range(8)]
    odd = [(None, texts[20], None), (None, texts[21] + " of none", None), (None, None, None), (7, texts[30] + " said twice", "x"), (7, texts[31] + " said otherwise", "x"), (7, texts[31] + " said otherwise", "x"), (6000, None, None), (6001, "", None), (6002, "12 34 !", "y")]
    return [(i, t, lang or None, "s", 1) for i, t, lang in made + near + leaks + lines + odd]


def within_one(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    k = 0
    while k < min(len(a), len(b)) and a[k] == b[k]:
        k += 1
    return a[k + 1 :] == b[k + 1 :] or a[k:] == b[k + 1 :] or a[k + 1 :] == b[k:]


def identified(model, table):
    for i, text, *rest in table:
        counts = language_id.ngram_counts(text or "")
        if counts is None:
            continue
        x = [float(c) ** 0.5 for c in counts]
        size = sum(v * v for v in x) ** 0.5
        z = [sum(v / size * float(model.weights[k, bit]) for k, v in enumerate(x) if v) + float(model.bias[bit]) for bit in range(model.code.shape[1])]
        losses = [sum(float(model.trust[lang, b]) * float(np.log1p(np.exp(-z[b] if model.code[lang, b] else z[b]))) for b in range(len(z))) * len(z) for lang in range(len(model.languages))]
        weights = [float(np.exp(min(losses) - v)) for v in losses]
        p = sorted((w / sum(weights) for w in weights), reverse=True)
        if p[0] >= language_id.MIN_SCORE and p[0] - p[1] > language_id.MIN_LEAD:
            yield (i, text, *rest)


def deduped(table, key):
    strip = line_dedup.BLANKS
    order = sorted(range(len(table)), key=lambda r: key[table[r][:2]])
    first = {}
    for r in order:
        for n, line in enumerate(table[r][1].split("\n")):
            if line.strip(strip):
                first.setdefault(line.strip(strip), (key[table[r][:2]], n))
    kept = {p for line, p in first.items() if not any(q < p and o != line and within_one(line, o) for o, q in first.items())}
    for r in range(len(table)):
        text, k = table[r][1], key[table[r][:2]]
        lines = [x for n, x in enumerate(text.split("\n")) if not x.strip(strip) or (k, n) in kept]
        if any(x.strip(strip) for x in lines) or not any(x.strip(strip) for x in text.split("\n")):
            yield (table[r][0], "\n".join(lines), *table[r][2:])


def one_of_each(table, copy):
    prints = [fingerprint(t) for _, t, *_ in table]
    shingles = []
    for _, t, *_ in table:
        w = t.encode().lower().split()
        shingles.append({b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(table)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(table)):
        for j in range(i):
            both = len(shingles[i] & shingles[j])
            if bin(prints[i] ^ prints[j]).count("1") <= 3 or (both and both >= 0.8 * (len(shingles[i]) + len(shingles[j]) - both)):
                root[find(i)] = find(j)
    groups = {}
    for n, r in enumerate(table):
        groups.setdefault(find(n), []).append(((r[0] is None, r[0] or 0, copy(r[1])), n))
    return [table[min(g)[1]] for g in groups.values()]


def clean(table, items):
    cut = lambda t: t.lower().encode().translate(bytes(range(256)), decontaminate._PUNCTUATION).split()
    for r in table:
        covered = [sum(n for *_, n in brute_tiles(cut(i), cut(r[1]), decontaminate.MIN_TILE)) / len(cut(i)) for i in items]
        if max(covered) < decontaminate.MIN_COVERAGE:
            yield r


def test_pipeline_by_hand(spark):
    import public_tokenizers
    import sentencepiece

    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    table = rows()
    spark.createDataFrame(table, schema).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, ITEM), (1, "another item of the same id with quite other words in it")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    keys = {(r.doc_id, r.text): (r.id, r.copy) for r in docs.select(*line_dedup._key("doc_id", "text"), "doc_id", "text").collect()}
    copy = lambda t: xxhash.xxh64_intdigest(t.encode(), 42) - ((1 << 64) if xxhash.xxh64_intdigest(t.encode(), 42) >> 63 else 0)

    after_language = list(identified(language_id.train(docs), table))
    after_lines = list(deduped(after_language, keys))
    after_copies = one_of_each(after_lines, copy)
    want = list(clean(after_copies, [ITEM, "another item of the same id with quite other words in it"]))
    assert len(table) > len(after_language) > len(after_lines) > len(after_copies) > len(want) > 100

    got = corpus_pipeline.run(spark, folder).collect()
    assert sorted((str(r.doc_id), r.text) for r in got) == sorted((str(r[0]), r[1]) for r in want)
    assert all(r.lang for r in got)
    model = sentence_pieces.load_model()
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    pieces = {sp.id_to_piece(i): i for i in range(sp.get_piece_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))}
    for r in got[::10]:
        assert list(r.ids) == [i for w in model.words_of(r.text) for i in best_pieces(model, pieces, w)]
