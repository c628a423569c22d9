"""op1, op4 and op5 against the libraries' own encodings."""

import random
import zlib

import numpy as np
import pytest

from purselake.llm import packing, sentence_pieces, token_files
from purselake.llm.common import new_folder
from purselake.llm.wordbpe import WordEncoder


def brute_ids(path, texts):
    from tokenizers import Tokenizer

    return [x.ids for x in Tokenizer.from_file(path).encode_batch([t or "" for t in texts], add_special_tokens=False)]


def crc(ids):
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())


def test_cached_words_encode_like_the_library(word_file):
    odd = ["a,b ,c", "<|endoftext|>x", "don't we'll", "İ ΣΑΣ ẞ", "é ́x", "\x1c!\x1d!", "a b c", "1st 2,000.5", "_x_ --y--", "", " \n\t", "😀 é" * 50]
    rng = random.Random(1)
    odd += ["".join(rng.choice("aB1,.'é \n\t-_ <|>") for _ in range(80)) for _ in range(200)]
    assert [x.tolist() for x in WordEncoder(word_file).encode(odd)] == brute_ids(word_file, odd)


def test_cache_overflow_changes_nothing(word_file, monkeypatch):
    from purselake.llm import wordbpe

    monkeypatch.setattr(wordbpe, "CACHE_WORDS", 3)
    e = WordEncoder(word_file)
    for _ in range(3):
        assert [x.tolist() for x in e.encode(["a b c d e", "f g a"])] == brute_ids(word_file, ["a b c d e", "f g a"])


def test_forms_of_a_word_take_no_room_of_their_own(word_file):
    e = WordEncoder(word_file)
    texts = ["abc Abc ABC, abc. abc,", "É é. é, É."]
    assert [x.tolist() for x in e.encode(texts)] == brute_ids(word_file, texts)
    assert sum(len(x) for x in vars(e).values() if isinstance(x, dict)) == 5  # "", abc, é, comma, full stop


def test_odd_white_space_encodes_like_the_library(word_file):
    odd = ["a\x0bb\x0cc\x00d", "a\u00a0b,\u2028c.\x85D \u3000", "x.\r\n\r\n,y", "\x1ca \x1f", "'s 't's a's, l'a ''", "a.b,c .a ,b", "ÀÉ, ß. ÿ÷×", "  ", "\t", "e\u0301, A\u030a."]
    e = WordEncoder(word_file)
    for some in ([t] for t in [*odd, *odd]):
        assert [x.tolist() for x in e.encode(some)] == brute_ids(word_file, some)
    assert [x.tolist() for x in e.encode(odd)] == brute_ids(word_file, odd) and e.encode([]) == []


@pytest.mark.parametrize("docs", ["odd_docs", "no_docs", "sample"])
def test_packing(request, docs, word_file):
    docs = request.getfixturevalue(docs)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = []
    for (doc_id, _), ids in zip(rows, brute_ids(word_file, [t for _, t in rows])):
        ids = ids + [1]
        want += [(doc_id, k // 4096, k, len(ids[k : k + 4096]), crc(ids[k : k + 4096])) for k in range(0, len(ids), 4096)]
    got = packing.pack_documents(docs, word_file).collect()
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got), key=repr) == sorted(want, key=repr)
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    total = sum(w[3] for w in want)
    assert len(by) <= -(-total // 4096) * 1.02 + 1


def test_best_fit_takes_the_tightest_open_sequence():
    rng = random.Random(5)
    lengths = sorted((rng.randint(1, 99) for _ in range(500)), reverse=True)
    sequences, offsets = packing.best_fit(lengths, 100)
    room = []
    for n, s, o in zip(lengths, sequences, offsets):
        fits = [r for r in room if r >= n]
        if s == len(room):
            assert not fits
            room.append(100)
        assert room[s] == 100 - o and (not fits or room[s] == min(fits))
        room[s] -= n


def test_small_groups_lose_no_piece(odd_docs, word_file):
    from purselake.llm.common import staged

    pieces = staged(packing.token_pieces(odd_docs, word_file, 64), "pieces")
    assert packing.packed(pieces, 64, group=2).count() == pieces.count()


@pytest.mark.parametrize("bits", [False, True])
@pytest.mark.parametrize("n", [0, 1, 7, 65536, 150001])
@pytest.mark.parametrize("width", ["<u2", "<u4"])
def test_planes_round_trip(bits, n, width):
    ids = np.random.default_rng(n).integers(0, 49000, n).astype(width)
    block_ids, plane_bytes, payload = token_files.pack_chunk(ids, bits)
    assert (token_files.unpack_chunk(block_ids, plane_bytes, ids.dtype.itemsize, payload, bits) == ids).all()


@pytest.mark.parametrize("docs", ["odd_docs", "no_docs", "sample"])
def test_token_files(request, spark, docs, word_file, monkeypatch):
    docs = request.getfixturevalue(docs)
    folder = new_folder(spark, "files")
    token_files.write_token_files(docs, folder, word_file)
    got = sorted(((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in token_files.read_token_files(spark, folder).collect()), key=lambda r: r[0])
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = sorted(((d, len(i) + 1, crc(i + [2])) for (d, _), i in zip(rows, brute_ids(word_file, [t for _, t in rows]))), key=repr)
    assert sorted(((d, n, c) for _, d, n, c in got), key=repr) == want
    ids = [d for _, d, _, _ in got]
    assert ids == sorted(ids, key=lambda d: (d is None, d))
    assert [s for s, *_ in got] == [sum(g[2] for g in got[:k]) for k in range(len(got))]


@pytest.mark.parametrize("docs", ["odd_docs", "no_docs", "sample"])
def test_sentence_pieces(request, docs, piece_file):
    docs = request.getfixturevalue(docs)
    model = sentence_pieces.pieces(piece_file).model
    rows = [(r.doc_id, r.text or "") for r in docs.collect()]
    got = sentence_pieces.decoded(sentence_pieces.encoded(docs, piece_file), piece_file).collect()
    want = [(d, model.encode(t)) for d, t in rows]
    assert sorted(((r.doc_id, list(r.ids)) for r in got), key=repr) == sorted(want, key=repr)
    assert sorted((r.text for r in got)) == sorted(model.decode(i) for _, i in want)


def piece_texts():
    rng = random.Random(2)
    texts = ["x" * 700, " " * 333, "ab" * 300 + " " * 300 + "é中" * 150, "the cat " * 5 + "\n" * 300, "thequickbrownfox" * 40, "", " ", "\n", " \n ", "▁a ▁▁b▁" * 20, "😀 é" * 50]
    texts += ["x" * 400 + " ", "ab" * 200 + " ", "word " * 66 + "x" * 200 + " "]
    texts += ["".join(rng.choice("aehintrs") for _ in range(rng.randint(100, 500))) for _ in range(15)]
    texts += ["".join(rng.choice("ae ht\n ,.▁é中") for _ in range(rng.randint(1, 400))) for _ in range(100)]
    return texts + ["".join(rng.choice(["the ", "  ", "ing", "\n", "tion", " a", "x" * 20, "    "]) for _ in range(rng.randint(1, 60))) for _ in range(60)]


@pytest.mark.parametrize("chunk, spread", [(16, 1 << 20), (40, 100), (4096, 1 << 20)])
def test_chunks_scan_to_the_library_encoding(spark, piece_file, monkeypatch, chunk, spread):
    monkeypatch.setattr(sentence_pieces, "CHUNK", chunk)
    monkeypatch.setattr(sentence_pieces, "SPREAD", spread)
    model, texts = sentence_pieces.pieces(piece_file).model, piece_texts()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: list(r.ids) for r in sentence_pieces.encoded(docs, piece_file).collect()}
    assert got == {n: model.encode(t) for n, t in enumerate(texts)}
    sums = {r.doc_id: (r.n_pieces, r.ids_crc32, r.n_chars, r.text_crc32) for r in sentence_pieces.digests(docs, piece_file).collect()}
    assert sums == {n: (len(i), crc(i), len(model.decode(i)), zlib.crc32(model.decode(i).encode())) for n, i in ((n, model.encode(t)) for n, t in enumerate(texts))}


def test_boundaries_of_given_documents_pass_through_matrices(sample, piece_file):
    chunks = [c for r in sample.collect() for c in sentence_pieces.split_document(r.text or "")]
    assert sum(count > 1 for _, count, *_ in chunks) > 50


def test_long_texts_with_a_last_space(spark, piece_file):
    texts = ["x" * 40000 + " ", "ab" * 20000 + " ", "word " * 6600 + "x" * 20000 + " "]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    model = sentence_pieces.pieces(piece_file).model
    got = {r.doc_id: (r.n_pieces, r.ids_crc32) for r in sentence_pieces.digests(docs, piece_file).collect()}
    assert got == {n: (len(i), crc(i)) for n, i in enumerate(map(model.encode, texts))}


def test_joined_checksums():
    a, b = b"hello" * 7, b"world!" * 1000
    assert sentence_pieces.joined_crc(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)


def test_products_of_matrices_are_associative():
    rng = np.random.default_rng(4)
    a, b, c = (np.where(rng.random(s) < 0.5, 0.0, -np.inf) for s in ((3, 4), (4, 5), (5, 2)))
    assert (sentence_pieces.combine(sentence_pieces.combine(a, b), c) == sentence_pieces.combine(a, sentence_pieces.combine(b, c))).all()


def test_other_settings_go_to_the_library(word_file, tmp_path):
    import json

    from purselake.llm.wordbpe import splits_at_white_space

    settings = json.load(open(word_file))
    assert splits_at_white_space(settings)
    settings["normalizer"]["normalizers"] = [s for s in settings["normalizer"]["normalizers"] if s["type"] != "Lowercase"]
    assert not splits_at_white_space(settings)
    other = tmp_path / "cased.json"
    other.write_text(json.dumps(settings))
    texts = ["One TWO  three", "", "\n x"]
    assert [x.tolist() for x in WordEncoder(str(other)).encode(texts)] == brute_ids(str(other), texts)
