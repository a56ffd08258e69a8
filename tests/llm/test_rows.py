"""Token counts, sharding, mixing, decontamination, top-k."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quern.llm import decontam, mixing, sharding, token_counts, topk
from quern.llm.shared import Words, pack64, pack_sorted, unpack64, unpack_sorted

from .conftest import texts

LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


# ---------------------------------------------------------------- shared

@given(st.lists(st.integers(0, 2**64 - 1), max_size=50, unique=True), st.lists(st.integers(0, 2**60), max_size=50))
def test_packing(u, w):
    u = np.array(sorted(u), np.uint64)
    assert (unpack_sorted(pack_sorted(u, 8), 8) == u).all()
    assert unpack64(pack64(np.array(w, np.int64))).tolist() == w
    low = np.sort(u & np.uint64(2**40 - 1))
    assert (unpack_sorted(pack_sorted(low, 5), 5) == low).all()


@given(st.lists(st.one_of(st.none(), st.text(alphabet="aAb \t\né", max_size=20)), max_size=8))
def test_words(some):
    found = Words([None if t is None else t.encode() for t in some])
    plain = [re.findall("[^\x20\x09-\x0d]+", t or "") for t in some]
    assert np.diff(found.at).tolist() == [len(w) for w in plain]
    flat = [w for x in plain for w in x]
    assert len(set(found.hashes.tolist())) == len(set(flat)) == len(set(zip(flat, found.hashes.tolist(), strict=True)))


# ---------------------------------------------------------------- 1

def test_tokens_are_attributed_by_their_first_byte(spark, odd_docs):
    got = token_counts.count_tokens(odd_docs.select("doc_id", "text", F.col("key").alias("n_tokens")))
    assert got.columns == ["doc_id", "text", "n_tokens", "n_sections", "n_crossing", "outside", "section_tokens"]
    encoder = token_counts.Encoder(open(token_counts.VOCABULARY, "rb").read(), token_counts.PATTERN)
    for r in got.collect():
        data = (r.text or "").encode()
        want, at, line = Counter(), 0, 0
        for token in encoder.encoding.encode_ordinary(r.text or ""):
            want[data[:at].count(b"\n")] += 1
            at += len(encoder.encoding.decode_single_token_bytes(token))
        assert at == len(data)
        lines = data.count(b"\n") + (not data.endswith(b"\n") and data != b"")
        assert r.section_tokens == [want[i] for i in range(lines)] and r.n_tokens == sum(want.values()) == sum(r.section_tokens) and r.outside == 0


@given(st.lists(st.integers(1, 6), max_size=12), st.lists(st.tuples(st.integers(0, 40), st.integers(0, 40)), max_size=4), st.sampled_from(["start", "most", "share"]))
def test_allocation(sizes, spans, rule):
    bounds = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    end = int(bounds[-1])
    spans = [(min(a, end), min(b, end)) for a, b in spans]
    spans = [(a, max(a, b)) for a, b in spans]
    credit, _ = token_counts.allocate(bounds, np.array([a for a, _ in spans], np.int64), np.array([b for _, b in spans], np.int64), rule)
    for (a, b), c in zip(spans, credit, strict=True):
        want = 0.0
        for x, y in zip(bounds, bounds[1:], strict=False):
            inside = max(0, min(y, b) - max(x, a))
            before, after = max(0, min(y, a) - x), max(0, y - max(x, b))
            if rule == "start":
                want += a <= x < b
            elif rule == "share":
                want += inside / (y - x)
            else:
                want += inside > 0 and inside > before and inside >= after
        assert abs(c - want) < 1e-9


def test_tokens_of_no_rows_and_of_a_very_long_word(spark):
    assert token_counts.count_tokens(spark.createDataFrame([], "doc_id int, text string")).count() == 0
    got = token_counts.count_tokens(spark.createDataFrame([(1, "ab" * 50_000), (2, "x" + " " * 50_000 + "y")], "doc_id int, text string")).collect()
    assert all(r.n_sections == 1 and r.section_tokens == [r.n_tokens] and 0 < r.n_tokens < 100_000 for r in got)


def test_given_sections(spark):
    rows = [(1, "one two three four", [(0, 7), (7, 18), None, (3, None)]), (2, None, [(0, 5)]), (3, "éé abc", None)]
    got = {r.doc_id: r for r in token_counts.count_tokens(spark.createDataFrame(rows, "doc_id int, text string, s array<struct<start:int,end:int>>"), sections="s").collect()}
    assert got[1].n_sections == 2 and sum(got[1].section_tokens) == got[1].n_tokens and got[2].n_tokens == 0 and got[3].outside == got[3].n_tokens


# ---------------------------------------------------------------- 2

def test_shards(spark, odd_docs):
    got = sharding.shard_documents(odd_docs, 7)
    assert got.count() == odd_docs.count() and set(odd_docs.columns) <= set(got.columns)
    slots = defaultdict(list)
    for r in got.collect():
        data = (r.text or "").encode()
        assert r.size == len(data) + 16 and r.text_crc32 == (None if r.text is None else zlib.crc32(data)) and r.grown_shard in (r.shard, 7) and 0 <= r.shard < 7
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.shard_documents(odd_docs.limit(0)).count() == 0


def test_shards_of_large_ids_beside_null(spark):
    ids = [2**53 + 1, 2**60 + 1, 2**62 + 3, -(2**61) - 7, *(2**55 + 2 * k + 1 for k in range(20))]
    want = dict(zip(ids, sharding.jump_hash(sharding.mixed_key(np.array(ids)), 40), strict=True)) | {None: sharding.jump_hash(sharding.mixed_key(np.array([0])), 40)[0]}
    docs = spark.createDataFrame([(i, "t") for i in [*ids, None]], "doc_id long, text string").coalesce(1)
    assert {r.doc_id: r.shard for r in sharding.shard_documents(docs).collect()} == want


def test_shards_of_hot_keys_and_other_types(spark):
    """A third of the rows without an id, one id with many texts, one with one text; string ids; slots as without splitting."""
    rows = [(None if i % 3 == 0 else 7 if i % 3 == 1 else 8 if i % 9 == 2 else i, None if i % 50 == 0 else "same" if i % 9 == 2 else f"text {i}") for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    order = lambda got: sorted((r.shard, r.slot, r.doc_id or 0, r.text_crc32 or -1, r.size) for r in got.collect())
    split, plain = order(sharding.shard_documents(docs, 5, hot_key=50)), order(sharding.shard_documents(docs, 5))
    assert split == plain and len(plain) == 900
    named = docs.selectExpr("cast(doc_id as string) as doc_id", "text")
    got = sharding.shard_documents(named, 5).select("doc_id", "shard", "grown_shard").distinct().collect()
    assert len({r.doc_id for r in got}) == len(got) and all(r.grown_shard in (r.shard, 5) for r in got) and len({r.shard for r in got}) == 5


def test_jump_hash_moves_only_into_the_new_shard():
    keys = sharding.mixed_key(np.arange(20_000))
    before = sharding.jump_hash(keys, 1)
    assert (before == 0).all()
    for n in range(1, 45):
        after = sharding.jump_hash(keys, n + 1)
        moved = after != before
        assert (after[moved] == n).all() and abs(moved.mean() - 1 / (n + 1)) < 0.02
        before = after


# ---------------------------------------------------------------- 6

def test_mix(spark, odd_docs):
    rows = mixing.mix(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    own, goal, taken = Counter(), {}, Counter()
    for r in rows:
        own[r.source] += r.size
        goal[r.source] = r.target
        taken[r.source] += r.taken
        assert 0 <= r.taken <= 3 * r.size and r.source_size is not None
    total, names = sum(own.values()), sorted(own, key=lambda s: (s is None, s))
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    full: set = set()
    while True:  # water filling
        left = total - sum(3 * own[s] for s in full)
        share = left / max(1, sum(weight[s] for s in names if s not in full))
        more = {s for s in names if s not in full and share * weight[s] >= 3 * own[s]}
        if not more:
            break
        full |= more
    for s in names:
        assert abs(goal[s] - (3 * own[s] if s in full else share * weight[s])) < 1e-6
    assert sorted(map(tuple, rows), key=repr) == sorted(map(tuple, mixing.mix(odd_docs.repartition(5)).collect()), key=repr)


def test_mix_comes_near_its_targets(spark):
    rows = [(i, "w " * (1 + i % 7), f"s{min(i % 9, 4)}") for i in range(6000)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("goal")).collect()
    assert all(abs(r.t - r.goal) <= 4 for r in got)


def test_targets_when_each_round_fills_one_more_source(spark):
    total, n = 10**12, 25
    left, parts, sizes, below = Fraction(total), n + 1, [], Fraction(0)
    for _ in range(n):  # source k is full only at the level that the k sources before it leave
        level = left / parts
        sizes.append(int((below + level) / 6) if sizes else int(level / 4))
        left, parts, below = left - 3 * sizes[-1], parts - 1, level
    sizes.append(total - sum(sizes))
    rows = [(f"s{i:02}", size, i) for i, size in enumerate(sizes)]
    sources = spark.createDataFrame([*rows, ("without words", 0, n + 1)], "source string, source_size long, place long")
    got = {r.source: r.target for r in mixing.targets(sources, F.lit(1), 3).collect()}
    assert got == {f"s{i:02}": float(3 * size) for i, size in enumerate(sizes[:-1])} | {f"s{n}": float(total - 3 * sum(sizes[:-1])), "without words": 0.0}


def test_mixed_documents(spark, odd_docs):
    plan = {(r.doc_id, r.source): r for r in mixing.mix(odd_docs).collect()}
    got = mixing.mixed_documents(odd_docs.drop("copies"))
    assert got.columns == [*(c for c in odd_docs.columns if c != "copies"), "copies"]
    for r in got.collect():
        p = plan[r.doc_id, r.source]
        assert p.taken == p.size * r.copies
    assert mixing.mixed_documents(odd_docs.limit(0)).count() == mixing.mix(odd_docs.limit(0)).count() == 0


# ---------------------------------------------------------------- 8

def plain_words(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(LOWER))


@pytest.mark.parametrize("block_words", [1 << 20, 40])
def test_contamination(spark, odd_docs, block_words):
    some = texts(60)
    items = [(1, " ".join(some[7].split()[5:25])), (2, some[3]), (3, "not there at all in any of these texts I am sure of it"), (4, None), (5, ""), (6, "ABC,abc"), (None, " ".join(some[2].split()[20:50])), (7, some[2].upper()), (2, some[3])]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    phrases = defaultdict(set)
    for i, t in items:
        w = plain_words(t)
        for k in range(len(w) - min(10, len(w)) + 1 if w else 0):
            phrases[tuple(w[k : k + 10])].add("" if i is None else str(i))
    want = Counter()
    for r in odd_docs.collect():
        w = plain_words(r.text)
        hit, found = set(), set()
        for m in {len(p) for p in phrases}:
            for k in range(len(w) - m + 1):
                if own := phrases.get(tuple(w[k : k + m])):
                    hit |= set(range(k, k + m))
                    found |= own
        want[r.doc_id, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)] += 1
    got = decontam.find_contamination(odd_docs, benchmark, block_words=block_words)
    assert Counter((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got.collect()) == want
    assert sum(x[5] for x in want) > 3


def test_remove_contamination(spark):
    passage = "The quick brown fox jumps over the lazy dog again and again, today."
    rows = [(1, f"Before it. {passage} After it.", 0), (2, passage, 0), (3, "Clean  text,\nleft as it is.", 27), (4, None, None), (5, "  ", 2)]
    got = decontam.remove_contamination(spark.createDataFrame(rows, "doc_id int, text string, n_chars long"), spark.createDataFrame([(1, passage)], "item_id int, text string"))
    assert sorted(map(tuple, got.collect())) == [(1, "Before it. . After it.", 22), (3, "Clean  text,\nleft as it is.", 27), (4, None, None), (5, "  ", 2)]
    empty = spark.createDataFrame([], "item_id int, text string")
    docs = spark.createDataFrame(rows, "doc_id int, text string, n_chars long")
    assert decontam.remove_contamination(docs, empty).count() == 5 and decontam.remove_contamination(docs.limit(0), empty).count() == 0
    assert decontam.find_contamination(docs.limit(0), spark.createDataFrame([(1, passage)], "item_id int, text string")).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(2, 4), max_size=30), min_size=1, max_size=5), st.lists(st.lists(st.integers(2, 5), min_size=1, max_size=4), min_size=1, max_size=6))
def test_fm_index(docs, patterns):
    symbols, at = np.array([s for d in docs for s in d], np.int64), np.cumsum([0, *map(len, docs)])
    index = decontam.FMIndex(symbols, at, 5)
    grid, size = np.zeros((len(patterns), 4), np.int64), np.array([len(p) for p in patterns])
    for i, p in enumerate(patterns):
        grid[i, 4 - len(p) :] = p
    lo, hi = index.search(grid, size)
    for i, p in enumerate(patterns):
        want = sorted((d, k) for d, own in enumerate(docs) for k in range(len(own) - len(p) + 1) if own[k : k + len(p)] == p)
        place = index.locate(np.arange(lo[i], hi[i]))
        doc = np.searchsorted(index.starts, place, side="right") - 1
        assert sorted(zip(doc.tolist(), (place - index.starts[doc]).tolist(), strict=True)) == want


# ---------------------------------------------------------------- 5

@pytest.mark.parametrize(("shard", "block"), [(4_096, 1024), (20, 7)])
def test_top_k(spark, shard, block, monkeypatch):
    monkeypatch.setattr(topk, "SHARD", shard)
    monkeypatch.setattr(topk, "BLOCK", block)
    monkeypatch.setattr(topk, "LEAF", 8)
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in np.round(rng.normal(size=6), 1)], None) for i in range(300)]
    rows += [(300, None, 1), (301, [1.0, None, 2.0, 0.0, 0.0, 0.0], 1), (302, [float("nan")] * 6, 1), (303, [float("inf")] * 6, 1), (None, [1.0] * 6, 1), (304, list(rows[0][1]), 1), (305, list(rows[0][1]), 1)]
    got = sorted(map(tuple, topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>, score int"), F.col("vec_id") % 20 == 0, k=9).collect()))
    sound = [(i, np.floor(64 * np.array(v))) for i, v, _ in rows if i is not None and v is not None and None not in v and np.isfinite(v).all()]
    want = []
    for i, q in sound:
        if i % 20 == 0:
            best = sorted((-int(q @ v), j) for j, v in sound if j != i)[:9]
            want += [(i, r + 1, j, -s) for r, (s, j) in enumerate(best)]
    assert got == sorted(want)


def test_top_k_of_clusters_repeats_and_ragged_vectors(spark, monkeypatch):
    """Clustered vectors, a vector that a third of the rows repeat, repeated rows, lengths that differ."""
    monkeypatch.setattr(topk, "SHARD", 25)
    monkeypatch.setattr(topk, "LEAF", 4)
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in 5 * np.eye(4)[i % 4] + np.round(rng.normal(size=4), 1)]) for i in range(200)]
    rows += [(200 + i, [1.0, 2.0, 3.0, 4.0]) for i in range(100)] + [(400, [9.0]), (401, []), (402, [0.5, 0.5]), (7, rows[7][1]), (40, rows[40][1])]
    got = Counter(map(tuple, topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3), F.col("vec_id") % 20 == 0, k=7).collect()))
    wide = [(i, np.floor(64 * np.array([*v, 0, 0, 0, 0][:4]))) for i, v in rows]
    want: Counter = Counter()
    for i, q in {(i, tuple(v)) for i, v in wide if i % 20 == 0}:
        best = sorted((-int(np.array(q) @ v), j) for j, v in wide if j != i)[:7]
        want.update((i, r + 1, j, -s) for r, (s, j) in enumerate(best))
    assert got == want


def test_top_k_of_few_and_none(spark):
    few = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<double>")
    assert topk.top_k(few, F.col("vec_id") % 20 == 0).collect() == [(0, 1, 1, 64 * 128)]
    assert topk.top_k(few.limit(0), F.col("vec_id") % 20 == 0).count() == 0
