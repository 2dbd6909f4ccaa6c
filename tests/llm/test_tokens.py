"""Piece segmentation and token files against brute force and round trips."""

import zlib

import numpy as np
import pytest

from ratebook.llm import sentence_pieces, token_files
from ratebook.llm.common import scratch_dir

TEXTS = ["", "Hello  world", " lead", "tail ", "a\nb  \tc é 日本 😀", "▁x ▁", "<s> <0x0A>", "ab" * 300 + " " + "日" * 40, "a   b", "x \n y", "it's <|endoftext|> ok", "word " * 500]


@pytest.fixture(scope="module")
def model():
    return sentence_pieces.load_model()


def brute(model, pieces, word):
    text, best = " " + word, [(0.0, None, None)]
    for end in range(1, len(text) + 1):
        options = []
        for start in range(max(0, end - model.longest), end):
            piece = text[start:end]
            if "▁" not in piece and (i := pieces.get(piece.replace(" ", "▁"))) is not None:
                options.append((best[start][0] + model.scores[i], start, [i]))
            elif end - start == 1:
                options.append((best[start][0] + model.unknown_score, start, [int(model.byte_ids[b]) for b in piece.encode()]))
        best.append(max(options, key=lambda o: (o[0], -o[1])))
    out, end = [], len(text)
    while end:
        _, start, ids = best[end]
        out, end = ids + out, start
    return out


def test_viterbi_matches_brute_force(model):
    import public_tokenizers
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    pieces = {sp.id_to_piece(i): i for i in range(sp.get_piece_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))}
    for text in TEXTS:
        ids = model.encode([text])[0]
        assert model.decode(ids) == text
        assert ids.tolist() == [i for w in model.words_of(text) for i in brute(model, pieces, w)]


def test_pieces_frame(spark, model):
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)] + [(50, None, None), (None, "a", "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    out = sentence_pieces.encode_and_decode(docs, model)
    got = {r.doc_id: r for r in out.collect()}
    assert {i: r.decoded for i, r in got.items()} == {i: t or "" for i, t, _ in rows}
    assert all(r.n_ids == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, dtype="<i4").tobytes()) for r in got.values())
    assert got[50].n_ids == 0 and got[4].n_byte_ids > 0
    assert sentence_pieces.encode_and_decode(spark.createDataFrame([], "doc_id long, text string"), model).count() == 0


def test_random_access():
    rng = np.random.default_rng(2)
    ids = np.concatenate((rng.integers(0, 1 << 8, 3000), rng.integers(0, 1 << 16, 3000), [0, 255, 256, (1 << 32) - 1, 1 << 24])).astype(np.uint32)
    rng.shuffle(ids)
    for widths in ((8, 8), (16, 8), (8,)):
        f = token_files.TokenFile(token_files.pack(np.array([3, 9]), np.array([1000, ids.size - 1000]), ids, widths))
        assert (f.all_ids() == ids).all() and all(f[i] == x for i, x in enumerate(ids.tolist()))
        assert f.doc_ids.tolist() == [3, 9] and f.starts.tolist() == [0, 1000, ids.size]
    empty = token_files.TokenFile(token_files.pack(np.array([1]), np.array([0]), np.empty(0, dtype=np.uint32)))
    assert empty.all_ids().size == 0


def test_many_places_by_rank_directories():
    ids = np.random.default_rng(4).integers(0, 1 << 20, 20_000).astype(np.uint32)
    f = token_files.TokenFile(token_files.pack(np.array([1]), np.array([ids.size]), ids))
    places = np.random.default_rng(5).integers(0, ids.size, 9_000)
    assert (f.ids_at(places) == ids[places]).all() and f.ids_at(np.empty(0, dtype=np.int64)).size == 0


def test_words_are_cut_where_the_pretokenizer_cuts():
    import random

    import public_tokenizers
    from tokenizers import Tokenizer

    path, rnd = public_tokenizers.path("byte_bpe_50k.json"), random.Random(1)
    whole, encoder, end = Tokenizer.from_file(path), token_files.TextEncoder(path), np.array([0], dtype=np.uint32)
    parts = ["a", "b'", "'s", "1", ",", ".", " ", "\n", "\t", "é", "日", "\r", " w", " 's", "\x1c", "\x85", "_", "<|endoftext|>"]
    texts = [*TEXTS, "\n", "\n\n", "a\n", "\na b", " ", "a\n\nb c", *("".join(rnd.choices(parts, k=rnd.randint(0, 14))) for _ in range(1500))]
    for _ in range(2):  # the second time from known words
        ids, lengths = encoder.encode(texts, end)
        assert [x.tolist() for x in np.split(ids, np.cumsum(lengths)[:-1])] == [[*whole.encode(t, add_special_tokens=False).ids, 0] for t in texts]


def test_token_files(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    whole = Tokenizer.from_file(path)
    rows = [(40 - i, t) for i, t in enumerate(TEXTS)] + [(7, None), (None, "a b"), (3, "same"), (3, "same"), (3, "differs")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    folder = scratch_dir(spark, "tokens")
    files = token_files.write_token_files(docs, folder, path, tokens_per_file=300)
    got = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in token_files.read_token_files(spark, folder, files).collect())
    start, wanted = 0, []
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = np.array([*whole.encode(t or "", add_special_tokens=False).ids, 0], dtype="<u4")
        wanted.append((start, i, ids.size, zlib.crc32(ids.tobytes())))
        start += ids.size
    assert got == wanted and files.count() > 1
    nothing = scratch_dir(spark, "tokens")
    assert token_files.read_token_files(spark, nothing, token_files.write_token_files(spark.createDataFrame([], "doc_id long, text string"), nothing, path)).count() == 0
