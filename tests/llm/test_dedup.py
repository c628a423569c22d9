"""op8 and op9 against brute force."""

import random
from collections import Counter, defaultdict

import oracle
import pytest

from purselake.llm import exact_dedup, jaccard_join
from purselake.llm.common import likely_in, staged


def test_op8_matches_sql(spark):
    folder = "/root/testdata/sf0.001"
    assert oracle.difference(exact_dedup.op8_exact_dedup(spark, folder), oracle.connect(folder), exact_dedup.OP8_SQL) == ""


def norm(t):
    import re

    return re.sub("[ \t-\r]+", " ", t or "")


@pytest.mark.parametrize("docs", ["odd_docs", "no_docs"])
def test_exact_groups_of_odd_rows(request, docs):
    docs = request.getfixturevalue(docs)
    rows = [(r.doc_id, norm(r.text)) for r in docs.collect()]
    sizes = Counter(t for _, t in rows)
    first = {t: min((d for d, u in rows if u == t), key=lambda d: (d is None, d)) for t in sizes}
    got = exact_dedup.duplicate_groups(docs).collect()
    want = sorted(((d, first[t], sizes[t]) for d, t in rows), key=repr)
    assert sorted(((r.doc_id, r.keep_id, r.group_size) for r in got), key=repr) == want
    assert sum(r.kept for r in got) == len(sizes)
    kept = exact_dedup.deduplicated(docs)
    assert kept.columns == docs.columns
    assert sorted((norm(r.text) for r in kept.collect())) == sorted(sizes)
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == sorted(first.values(), key=repr)


def test_full_filter_changes_nothing(odd_docs, monkeypatch):
    want = sorted(map(repr, exact_dedup.duplicate_groups(odd_docs).collect()))
    monkeypatch.setattr(exact_dedup, "filter_bits", lambda rows: 1)
    assert sorted(map(repr, exact_dedup.duplicate_groups(odd_docs).collect())) == want


def test_likely_in_loses_no_key(spark):
    left = spark.range(5000).withColumnRenamed("id", "k")
    keys = staged(left.filter("k % 7 = 0"), "keys")
    found = {r.k for r in likely_in(left, "k", keys, keys.count()).collect()}
    assert {k for k in range(5000) if k % 7 == 0} <= found and len(found) < 1200


def brute(texts):
    sets = []
    for t in texts:
        w = (t or "").lower().split()
        sets.append(frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset())
    parent, links = list(range(len(sets))), [0] * len(sets)

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a == b or (a and b and len(a & b) >= 0.8 * len(a | b) - 1e-9):
                links[i] += 1
                links[j] += 1
                x, y = top(i), top(j)
                parent[max(x, y)] = min(x, y)
    return links, [top(i) for i in range(len(sets))]


def near_copies():
    rng = random.Random(3)
    words = ["w%d" % i for i in range(400)]
    texts = []
    for _ in range(25):
        base = [rng.choice(words) for _ in range(rng.randint(3, 120))]
        texts.append(" ".join(base))
        for _ in range(rng.randint(0, 12)):
            base = list(base)
            base[rng.randrange(len(base))] = rng.choice(words)
            texts.append(" ".join(base))
    texts += [texts[0]] * 20 + ["", None, "one", "one", "One"]
    return texts


@pytest.mark.parametrize("limit", [2048, 6])
def test_jaccard_classes(spark, limit, monkeypatch):
    """With a limit of 6, buckets split again and the last level is cut into blocks."""
    monkeypatch.setattr(jaccard_join.small_buckets, "__defaults__", (limit, 3 if limit == 6 else 6))
    texts = near_copies()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    links, classes = brute(texts)
    got = {r.doc_id: r for r in jaccard_join.jaccard_classes(docs).collect()}
    assert [got[i].n_links for i in range(len(texts))] == links
    assert [got[i].class_id for i in range(len(texts))] == classes
    kept = {r.doc_id for r in jaccard_join.one_per_class(docs).collect()}
    assert kept == set(classes)


@pytest.mark.parametrize("docs", ["odd_docs", "no_docs"])
def test_jaccard_of_odd_rows(request, docs):
    docs = request.getfixturevalue(docs)
    rows = docs.collect()
    links, classes = brute([r.text for r in rows])
    got = jaccard_join.jaccard_classes(docs).collect()
    assert Counter((r.doc_id, r.n_links) for r in got) == Counter((r.doc_id, n) for r, n in zip(rows, links))
    kept = jaccard_join.one_per_class(docs)
    assert kept.columns == docs.columns
    by = defaultdict(set)
    for r, c in zip(rows, classes):
        by[c].add((r.doc_id is None, r.doc_id or 0))
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == sorted(min(v) for v in by.values())


def test_one_of_repeated_rows_stays(spark):
    t, u = "one two three four five six seven eight", "nine ten eleven twelve thirteen fourteen"
    docs = spark.createDataFrame([(3, t, {"a": 1}), (3, t, {"a": 2}), (4, u, {}), (4, u, {}), (5, t, None)], "doc_id long, text string, text_hash map<string,int>")
    for kept in (jaccard_join.one_per_class(docs), exact_dedup.deduplicated(docs)):
        assert kept.columns == docs.columns
        assert sorted(r.doc_id for r in kept.collect()) == [3, 4]


def test_components_of_a_long_chain(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(0, 60)] + [(100, 101)], "a long, b long")
    got = {r.node: r.component for r in jaccard_join.components(e).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}
