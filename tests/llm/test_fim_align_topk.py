"""op11, op12 and op13 against brute force and SQL."""

import hashlib
import random
from collections import Counter

import numpy as np
import oracle
import pytest
from pyspark.sql import functions as F

from purselake.llm import fill_in_middle, token_align, topk_search

SMALL = "/root/testdata/sf0.001"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# op11


@pytest.mark.parametrize("text", ["", "a", "plain ascii " * 9000, "é" * 70000, "中" * 50000, "x中" * 30000, "a😀é" * 25000, "x" * 65535 + "é", "x" * 65536, "😀" * 16384])
def test_boundary_set_selects_every_offset(text):
    raw = text.encode()
    want = np.cumsum([0, *(len(c.encode()) for c in text)])
    bounds = fill_in_middle.BoundarySet(raw)
    assert len(bounds) == len(text) + 1
    for k in {0, 1, len(text) // 3, len(text) // 2, len(text) - 1, len(text), *range(0, len(text), 997)} & set(range(len(text) + 1)):
        assert bounds.select(k) == want[k]
    with pytest.raises(IndexError):
        bounds.select(len(text) + 1)


def test_boundary_set_uses_all_kinds_of_containers():
    kinds = lambda t: [c[0] for c in fill_in_middle.BoundarySet(t.encode()).containers]
    assert kinds("x" * 200000) == ["run"] * 4
    assert kinds("中" * 50000)[0] == "bitmap"
    assert kinds("😀" * 500) == ["array"]


def by_the_rule(doc_id, text):
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    a, b = sorted((h1 % (len(text) + 1), h2 % (len(text) + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return len(text), "plain", None, None, text
    p, m, s = text[:a], text[a:b], text[b:]
    return (len(text), "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 20 else (len(text), "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}")


@pytest.fixture(scope="module")
def marked_docs(spark, odd_docs):
    texts = ["a <P> b", "<<S", "<M", "é<P", "x<S><", "<>" * 50, "中文 text\n" * 9] * 12
    return odd_docs.select("doc_id", "text").unionByName(spark.createDataFrame([(100 + i, t) for i, t in enumerate(texts)], "doc_id long, text string"))


def test_forms_follow_the_rule_and_texts_come_back(marked_docs):
    made = fill_in_middle.fill_in_middle(marked_docs)
    got = made.withColumn("back", fill_in_middle.restored(F.col("output"), F.col("form"))).collect()
    want = sorted(((r.doc_id, *by_the_rule(r.doc_id, r.text or ""), r.text or "") for r in marked_docs.collect()), key=repr)
    assert sorted(map(tuple, got), key=repr) == want
    assert {r.form for r in got} == {"plain", "psm", "spm"}


def test_other_markers_and_shares(marked_docs):
    signs = ("(|", ".*", "[M")
    made = fill_in_middle.fill_in_middle(marked_docs, seed=7, markers=signs, plain_from=100, spm_below=100)
    got = made.withColumn("back", fill_in_middle.restored(F.col("output"), F.col("form"), signs)).collect()
    assert {r.form for r in got if r.n} == {"spm"}
    assert sorted(r.back for r in got) == sorted(r.text or "" for r in marked_docs.collect())


def test_op11_matches_sql(spark):
    assert oracle.difference(fill_in_middle.op11_fill_in_middle(spark, SMALL), oracle.connect(SMALL), fill_in_middle.OP11_SQL) == ""


@pytest.mark.parametrize("make", [lambda d: fill_in_middle.fill_in_middle(d), lambda d: token_align.aligned_with_counts(d, *files())])
def test_empty_tables_give_empty_results(no_docs, make):
    assert make(no_docs).collect() == []


# op12


def files():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def brute_alignment(rows):
    """Whole texts by the libraries alone, then two pointers over byte ends."""
    import sentencepiece
    from tokenizers import Tokenizer

    a_path, b_path = files()
    a_model = Tokenizer.from_file(a_path)
    a_model.encode_special_tokens = True
    b_model = sentencepiece.SentencePieceProcessor(model_file=b_path)
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    sign = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}
    found, counts = [], Counter()
    for doc_id, text in rows:
        text = text or ""
        a = a_model.encode(" " + text, add_special_tokens=False).ids if text else []
        b = b_model.encode(text) if text else []
        a_bytes = [bytes(sign[c] for c in a_model.id_to_token(i)) for i in a]
        b_bytes = [bytes([int(b_model.id_to_piece(i)[3:5], 16)]) if b_model.is_byte(i) else b_model.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if not b"".join(a_bytes) == b"".join(b_bytes) == (" " + text).encode():
            a, b = [], []
        a_ends, b_ends = (dict(zip(np.cumsum([len(x) for x in side]).tolist(), range(len(side)))) for side in (a_bytes if a else [], b_bytes if b else []))
        links = [(a_ends[e], b_ends[e]) for e in sorted(a_ends.keys() & b_ends.keys())]
        groups, i, j = [], 0, 0
        for x, y in links:
            groups.append(",".join(map(str, a[i : x + 1])) + "|" + ",".join(map(str, b[j : y + 1])))
            i, j = x + 1, y + 1
        pairs = [(a[x], b[y]) for x, y in links]
        counts.update(pairs)
        found.append((doc_id, len(a), len(b), len(groups), pairs, ";".join(groups)))
    best = Counter()
    for (_, y), n in counts.items():
        best[y] = max(best[y], n)
    return [(d, na, nb, g, len(p), sum(counts[x] == best[x[1]] for x in p), sum(counts[x] for x in p), sha(t) if na else "") for d, na, nb, g, p, t in found]


HARD = [
    "a  b", " leading", "  two leading", "trailing  ", "tabs\t\tand\n\nlines \n x", "a \n  b", "x  y　 z", "  a", "<|endoftext|> and <s> </s> <unk> <0x41>", "don't I'll we've", "a▁b", "word ▁ x",
    "é é ﬁ ½ ²", "😀😀 👩‍👩‍👧", "\x00\x01 \x1c x", "1234567 8,9.0", "中文文本 とても ไทย", "a" * 3000, " " * 3000 + "x", "\n" * 500, "x" * 39 + "y" * 5, "﻿bom", "a\rb \r c",
]


@pytest.fixture(scope="module")
def align_docs(spark, odd_docs):
    rng = random.Random(5)
    signs = ["a", "the", " ", "  ", "\n", "\t", "é", "中", "▁", "1", "'s", ".", "<s>", " ", "\x85", "İ", "x" * 30]
    mixed = ["".join(rng.choices(signs, k=rng.randrange(1, 40))) for _ in range(300)]
    own = spark.createDataFrame([(1000 + i, t) for i, t in enumerate(HARD + mixed)], "doc_id long, text string")
    return odd_docs.select("doc_id", "text").unionByName(own).repartition(3)


def short(df):
    columns = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def test_alignment_equals_brute_force(align_docs):
    rows = [tuple(r) for r in align_docs.collect()]
    want = sorted(brute_alignment(rows), key=repr)
    assert short(token_align.aligned_with_counts(align_docs, *files())) == want
    assert sum(w[1] == 0 for w in want) > 5


def test_alignment_of_given_documents(sample):
    rows = [(r.doc_id, r.text) for r in sample.collect()]
    assert short(token_align.aligned_with_counts(sample, *files())) == sorted(brute_alignment(rows), key=repr)


def test_small_caches_and_rare_pairs_change_nothing(align_docs, monkeypatch):
    want = short(token_align.aligned_with_counts(align_docs, *files()))
    monkeypatch.setattr(token_align, "HOT_SHARE", 5)
    monkeypatch.setattr(token_align, "BATCH_CHARS", 500)
    assert short(token_align.aligned_with_counts(align_docs, *files())) == want
    worker = token_align.Aligner(*files())
    monkeypatch.setattr(token_align, "CACHE_SEGMENTS", 3)
    texts = [t for t in HARD if "▁" not in t]
    again = [worker.encode([t])[0] for t in texts * 2]
    assert again == token_align.Aligner(*files()).encode(texts) * 2


def test_overlaps_are_all_pairs_that_share_bytes():
    worker = token_align.Aligner(*files())
    for text in (t for t in HARD if "▁" not in t):
        found = worker.align([text])
        a, b = (np.frombuffer(x, dtype=np.int32) for x in worker.encode([text])[0])
        spans = [np.stack([np.cumsum(n) - n, np.cumsum(n)], axis=1) for n in (worker.lengths[0][a], worker.lengths[1][b])]
        want = sum(int(((spans[1][:, 0] < e) & (spans[1][:, 1] > s)).sum()) for s, e in spans[0])
        assert found["n_overlaps"][0] == want


# op13


def brute_topk(rows, k, every):
    whole = []
    for vec_id, v in rows:
        if v is not None and all(x is not None and np.isfinite(x) for x in v):
            whole.append((vec_id, [int(np.floor(1024 * float(x))) for x in v]))
    out = []
    for i, (q, v) in enumerate(whole):
        if q is None or q % every:
            continue
        found = [(-sum(x * y for x, y in zip(v, w)), c is None, c) for j, (c, w) in enumerate(whole) if j != i]
        found.sort(key=lambda x: (x[0], x[1], x[2] or 0))
        out += [(q, rank, c, -s) for rank, (s, _, c) in enumerate(found[:k], 1)]
    return sorted(out, key=repr)


def odd_vectors():
    rng = random.Random(8)
    rows = [(i, [rng.gauss(0, 0.3) for _ in range(6)]) for i in range(60)]
    rows += [(i, [0.5, -0.25, 0.125, 0.0, 0.1, 0.2]) for i in range(60, 140)]  # copies: ties beyond k
    rows += [(10, [0.1] * 6), (10, [0.1] * 6), (None, [9.0] * 6), (None, None), (20, None), (30, [None] * 6), (40, [float("nan")] * 6), (50, [float("inf")] + [0.0] * 5)]
    rows += [(150, []), (160, [1.0, 2.0]), (170, [-3.0] * 9), (-20, [0.3] * 6), (180, [1e5] * 6), (190, [3.0e4, -2.0e4, 0.0, 1.0, 2.0, 3.0])]
    return rows


@pytest.mark.parametrize(("block", "bins", "held", "k"), [(2048, 2048, 16, 10), (7, 4, 1, 3), (16, 32, 2, 10)])
def test_topk_equals_brute_force(spark, monkeypatch, block, bins, held, k):
    monkeypatch.setattr(topk_search, "BLOCK", block)
    monkeypatch.setattr(topk_search, "QUERY_BLOCK", block)
    monkeypatch.setattr(topk_search, "BINS", bins)
    monkeypatch.setattr(topk_search, "HELD_BLOCKS", held)
    rows = odd_vectors()
    df = spark.createDataFrame([(i, v, "x", "y") for i, v in rows], "vec_id long, embedding array<double>, row string, norm string").repartition(3)
    got = topk_search.exact_top_k(df, k=k, every=10)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute_topk(rows, k, 10)


def test_topk_of_few_or_no_rows(spark):
    ddl = "vec_id long, embedding array<float>"
    assert topk_search.exact_top_k(spark.createDataFrame([], ddl)).collect() == []
    assert topk_search.exact_top_k(spark.createDataFrame([(100, [1.0])], ddl)).collect() == []
    assert topk_search.exact_top_k(spark.createDataFrame([(1, [1.0])], ddl)).collect() == []
    three = topk_search.exact_top_k(spark.createDataFrame([(0, [1.0]), (1, [2.0]), (2, [-1.0])], ddl)).collect()
    assert sorted(map(tuple, three)) == [(0, 1, 1, 1024 * 2048), (0, 2, 2, -1024 * 1024)]
    huge = topk_search.exact_top_k(spark.createDataFrame([(0, [3e38, 3e38]), (1, [3e38, -3e38]), (2, [3e38, 3e38])], ddl)).collect()
    assert [r.vec_id for r in sorted(huge, key=lambda r: r["rank"])] == [2, 1]


def test_op13_matches_sql(spark):
    assert oracle.difference(topk_search.op13_exact_topk(spark, SMALL), oracle.connect(SMALL), topk_search.OP13_SQL) == ""
