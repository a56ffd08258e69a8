"""Near duplicates, substring dedup and language-model scores against brute force."""

import hashlib
import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.llm import jaccard_join, lm_scoring, substring_dedup

from .conftest import texts

LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def words(text, lower=True):
    return re.findall("[^\x20\x09-\x0d]+", (text or "").translate(LOWER) if lower else text or "")


def brute_components(rows, threshold=75):
    """(n_shingles, component, links) by row place."""
    sets = []
    for _, t in rows:
        w = words(t)
        sets.append(frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else []))
    parent, links = list(range(len(rows))), Counter()

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= threshold * (len(sets[a]) + len(sets[b]) - both):
                parent[find(a)] = find(b)
                links[a] += 1
                links[b] += 1
    least = {}
    for a, (i, _) in enumerate(rows):
        if i is not None:
            least[find(a)] = min(least.get(find(a), i), i)
    return [(len(sets[a]), least.get(find(a)) if sets[a] else rows[a][0], links[a]) for a in range(len(rows))]


@pytest.mark.parametrize("block", [256, 3])
def test_near_duplicates(spark, odd_docs, block, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK_DOCS", block)
    rows = [(r.doc_id, r.text) for r in odd_docs.select("doc_id", "text").collect()]
    want = Counter((i, *x) for (i, _), x in zip(rows, brute_components(rows), strict=True))
    got = Counter((r.doc_id, r.n_shingles, r.component_id, r.n_links) for r in jaccard_join.near_duplicates(odd_docs).collect())
    assert got == want
    assert max(x[3] for x in got) > 1


def test_large_family_of_near_copies(spark):
    rng = np.random.default_rng(1)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(700):
        w = list(base)
        for k in rng.integers(0, 120, int(rng.integers(0, 6))):
            w[k] = f"z{rng.integers(1000)}"
        rows.append((i, " ".join(w)))
    got = {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in jaccard_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i] for i in range(700)] == brute_components(rows)


def test_one_of_each(spark, odd_docs):
    kept = jaccard_join.one_of_each(odd_docs)
    assert kept.columns == odd_docs.columns
    found = brute_components([(r.doc_id, r.text) for r in odd_docs.select("doc_id", "text").collect()])
    groups = len({c for n, c, _ in found if n}) + sum(n == 0 for n, _, _ in found)
    assert kept.count() == groups
    assert jaccard_join.one_of_each(odd_docs.limit(0)).count() == 0


def test_threshold_is_inclusive(spark):
    # 7 and 7 shingles with 6 shared: 6 of 8 is exactly 75 %.
    a, b = "a b c d e f g h i j k", "a b c d e f g h i j z"
    got = {r.doc_id: r.component_id for r in jaccard_join.near_duplicates(spark.createDataFrame([(1, a), (2, b), (3, "a b c d e f q h i j k")], "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 1, 3: 3}


@pytest.mark.parametrize("length", [35, 8, 20])
def test_remove_repeats(spark, odd_docs, length):
    rows = [(r.doc_id, words(r.text, False)) for r in odd_docs.select("doc_id", "text").collect()]
    counts = Counter(tuple(w[k : k + length]) for _, w in rows for k in range(len(w) - length + 1))
    want = Counter()
    for i, w in rows:
        gone = [False] * len(w)
        for k in range(len(w) - length + 1):
            if counts[tuple(w[k : k + length])] > 1:
                gone[k : k + length] = [True] * length
        want[i, len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g)] += 1
    got = substring_dedup.remove_repeats(odd_docs, length).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept) for r in got) == want
    assert all(hashlib.sha256(r.kept.encode()).hexdigest() == r.kept_sha256 for r in got)
    assert sum(r.n_removed for r in got) > 0


def test_remove_repeats_over_many_chunks(spark):
    docs = spark.createDataFrame(list(enumerate(texts(300, 5))), "doc_id long, text string")
    few = substring_dedup.repeats_digest(docs)
    many = substring_dedup.repeated_spans(docs, 35, finish=lambda rows, w, covered: __import__("pyarrow").table({"n": [int(covered.sum())]}), schema="n long", chunk_bytes=2000)
    assert few.agg(F.sum("n_removed")).first()[0] == many.agg(F.sum("n")).first()[0] > 0


def test_levels():
    assert substring_dedup.levels(35) == [9, 18, 35]
    assert substring_dedup.levels(5) == [5]


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert substring_dedup.repeats_digest(empty).count() == jaccard_join.near_duplicates(empty).count() == lm_scoring.cross_entropy_difference(empty, empty).count() == 0


def test_cross_entropy_difference(spark, odd_docs):
    target = spark.createDataFrame([(i, t) for i, t in enumerate(texts(20, 9))] + [(None, None)], "doc_id long, text string")
    docs = [(r.doc_id, words(r.text)) for r in odd_docs.select("doc_id", "text").collect()]
    goal = [words(r.text) for r in target.collect()]
    total = Counter(w for _, x in docs for w in x) + Counter(w for x in goal for w in x)
    known = {w for w, n in total.items() if n >= 2}
    code = lambda x: [w if w in known else None for w in x]

    def model(corpus):
        uni, pair, head = Counter(), Counter(), Counter()
        for x in corpus:
            uni.update(x)
            pair.update(zip(x, x[1:], strict=False))
            head.update(x[:-1])
        size = sum(uni.values())

        def loss(x):
            out = 0.0
            for k, w in enumerate(x):
                low = (uni[w] + 1) / (size + len(known) + 1)
                out -= math.log(0.7 * pair[x[k - 1], w] / head[x[k - 1]] + 0.3 * low if k and head[x[k - 1]] else low)
            return out / max(1, len(x))

        return loss

    background, wanted = model([code(x) for _, x in docs]), model([code(x) for x in goal])
    want = defaultdict(list)
    for i, x in docs:
        want[i].append((len(x), code(x).count(None), wanted(code(x)), background(code(x))))
    for r in lm_scoring.cross_entropy_difference(odd_docs, target).collect():
        assert any(r.n_words == n and r.n_unknown == u and abs(r.loss_target - t) < 1e-9 and abs(r.loss_background - b) < 1e-9 and abs(r.score - (t - b)) < 1e-9 for n, u, t, b in want[r.doc_id])
