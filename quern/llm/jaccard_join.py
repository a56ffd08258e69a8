"""N-gram Jaccard self-join: rare-first prefix filtering with length, positional and suffix filters.

A document's set holds its distinct ``n``-word shingles of lower-cased (A-Z) words; shorter documents count as one
shingle, empty ones have none and link with nothing. Two documents link when 100 * |A & B| >= threshold * |A | B|.

1. Equal sets form a class (a 128-bit signature); only one representative of each goes on.
2. How many classes hold a shingle is counted over the whole corpus (see ``shared``). Shingles are ordered rarest
   first; those of one class alone can never match, so a document whose prefix (the first |A| - ceil(t |A|) + 1)
   is made of such shingles is finished, and only shared shingles travel on.
3. Documents of one family get a common label by a few rounds over (prefix shingle, document) rows and are packed in
   blocks of bounded size. Two blocks meet only if they share a prefix shingle with compatible lengths.
4. A pair of blocks is one task's work: prefix shingles join the documents, each candidate pair passes the length,
   positional and suffix filters, and is verified once by exact intersection. It sends each document's number of links and the
   roots of a local forest, never a row for each pair.
5. Components of those forests come from label propagation with pointer jumping, on the cluster.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import ANSWER, LOWER_WORDS, SEGMENT, Slices, Words, add_up, answers, chunk_of, chunks_for, deal, give_back, hot_from, partitions, pieces, rows_of, segments, settle, spread_join, volume, windows

#: Documents that a block holds on average where one family fills several.
BLOCK_DOCS = 256
#: Ranges of the shingle hashes that the suffix filter counts.
SUFFIX_BINS = 16


def shingle_sets(texts: list[bytes | None], n: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    words = Words(texts, LOWER_WORDS)
    whole = windows(words.hashes, n)
    out = []
    for a, b in zip(words.at, words.at[1:], strict=False):
        if b - a >= n:
            out.append(np.unique(whole[a : b - n + 1]))
        else:
            out.append(windows(words.hashes[a:b], int(b - a)) if b > a else np.zeros(0, np.uint64))
    return out


def signature(s: np.ndarray) -> bytes:
    """128 bits that name a set."""
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else b""


def _needed(size_a, size_b, threshold: int):
    """The least intersection that links sets of these sizes."""
    return -(-threshold * (size_a + size_b) // (100 + threshold))


def _prefix(size: int, threshold: int) -> int:
    return size - -(-threshold * size // 100) + 1


def row_key():
    return F.xxhash64("doc_id", "text")


def describe(docs: DataFrame, n: int, n_chunks: int) -> DataFrame:
    """doc_id, row_key, _chunk, n_shingles and the signature of each document."""
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches):
        for b in pieces(batches, "text"):
            sets = shingle_sets(rows_of(b, "text"), n)
            yield pa.RecordBatch.from_pydict({
                "doc_id": b.column("doc_id"), "row_key": b.column("row_key"), "_chunk": b.column("_chunk"), "n_shingles": pa.array([len(s) for s in sets], pa.int64()), "sig": pa.array([signature(s) for s in sets], pa.binary()),
            })
        give_back()

    return docs.select("doc_id", row_key().alias("row_key"), chunk_of(n_chunks, "doc_id", "text"), "text").mapInArrow(run, f"doc_id {kind}, row_key long, _chunk int, n_shingles long, sig binary")


class _Chunk:
    """The representatives in a chunk: their shingles, and the chunk's distinct ones."""

    def __init__(self, part: pa.Table, side: pa.Table, n: int, slices: Slices):
        wanted = {d: p for k, p, d in zip(*(side.column(c).to_pylist() for c in ("_kind", "_part", "data")), strict=True) if k == 0}
        self.sigs, self.sets, self.copies = [], [], []
        for s in shingle_sets(rows_of(part, "text"), n) if wanted else []:
            copies = wanted.pop(signature(s), None)
            if copies is not None:
                self.sigs.append(signature(s))
                self.sets.append(s)
                self.copies.append(copies)
        flat = slices.reduce(np.concatenate(self.sets)) if self.sets else np.zeros(0, np.uint64)
        self.distinct, self.where, self.counts = np.unique(flat, return_inverse=True, return_counts=True)


ACTIVE = "sig binary, size int, copies long, prefix binary, prefix_at binary, body binary"


def active(text: DataFrame, reps: DataFrame, n: int, threshold: int, slices: Slices) -> DataFrame:
    """The representatives that can link: those with a shared shingle in their prefix. prefix, prefix_at: the shared
    shingles of the prefix and their places, in order; body: all their shared shingles, sorted by hash."""

    def send(key, part, side):
        chunk = _Chunk(part, side, n, slices)
        out = segments(key[0].as_py(), chunk.distinct, chunk.counts, slices)
        del chunk
        give_back()
        return out

    def respond(sums: np.ndarray, chunk: int) -> bytes:  # 0: held by one class; else 1 + log2, rounded down
        return np.log2(sums[0]).astype(np.uint8).__add__(sums[0] > 1).astype(np.uint8).tobytes()

    def receive(key, part, side):
        chunk = _Chunk(part, side, n, slices)
        common = answers(side, 1, np.uint8)[chunk.where] if len(chunk.where) else np.zeros(0, np.uint8)
        rows, at = [], 0
        for sig, copies, s in zip(chunk.sigs, chunk.copies, chunk.sets, strict=True):
            own = common[at : at + len(s)]
            at += len(s)
            shared, length = np.flatnonzero(own), _prefix(len(s), threshold)
            first = len(s) - len(shared)  # shingles of this class alone come first
            if first < length and len(shared):
                ordered = s[shared[np.lexsort((s[shared], own[shared]))]][: length - first]
                rows.append((sig, len(s), copies, ordered.tobytes(), np.arange(first, first + len(ordered), dtype=np.int32).tobytes(), s[shared].tobytes()))
        return pa.table({f: pa.array([r[i] for r in rows], k) for i, (f, k) in enumerate((("sig", pa.binary()), ("size", pa.int32()), ("copies", pa.int64()), ("prefix", pa.binary()), ("prefix_at", pa.binary()), ("body", pa.binary())))})

    known = reps.select("_chunk", F.lit(0).alias("_kind"), F.col("copies").alias("_part"), F.col("sig").alias("data"))
    segs = text.groupBy("_chunk").cogroup(known.groupBy("_chunk")).applyInArrow(send, SEGMENT)
    side = known.union(add_up(segs, slices, 1, respond).select(*(c.split()[0] for c in ANSWER.split(", "))))
    return text.groupBy("_chunk").cogroup(side.groupBy("_chunk")).applyInArrow(receive, ACTIVE)


def _prefix_rows(act: DataFrame) -> DataFrame:
    def run(batches):
        for b in batches:
            for sig, size, prefix, at in zip(*(b.column(c).to_pylist() for c in ("sig", "size", "prefix", "prefix_at")), strict=True):
                h = np.frombuffer(prefix, np.int64)
                yield pa.RecordBatch.from_pydict({"h": pa.array(h), "sig": pa.array([sig] * len(h), pa.binary()), "size": pa.array(np.full(len(h), size, np.int32)), "at": pa.array(np.frombuffer(at, np.int32))})

    return act.select("sig", "size", "prefix", "prefix_at").mapInArrow(run, "h long, sig binary, size int, at int")


def blocks(prefix: DataFrame, least: int, rounds: int = 3) -> DataFrame:
    """sig, home, salt: documents that share prefix shingles mostly share a home; salt splits large homes. Any
    assignment is right; this one keeps most families in one block."""
    label = prefix.groupBy("sig").agg(F.min("h").alias("home"))
    for _ in range(rounds):
        at_shingle = prefix.join(label, "sig").groupBy("h").agg(F.min("home").alias("home"))
        label = spread_join(prefix, at_shingle, "h", least, F.xxhash64("sig")).groupBy("sig").agg(F.min("home").alias("home"))
        label = settle(label)
    size = label.groupBy("home").agg(F.count("*").alias("members"))
    salt = F.pmod(F.xxhash64("sig"), F.ceil(F.col("members") / BLOCK_DOCS)).cast("int")
    return spread_join(label, size, "home", least, F.xxhash64("sig")).select("sig", "home", salt.alias("salt"))


def block_pairs(prefix: DataFrame, placed: DataFrame, threshold: int) -> DataFrame:
    """The pairs of blocks (a <= b) that share a prefix shingle with compatible lengths."""
    block = F.struct("home", "salt").alias("block")
    held = prefix.join(placed, "sig").groupBy("h", block).agg(F.min("size").alias("least"), F.max("size").alias("most"), F.count("*").alias("docs"))
    x, y = held.alias("x"), held.alias("y")
    fits = (F.col("x.most") * 100 >= F.col("y.least") * threshold) & (F.col("y.most") * 100 >= F.col("x.least") * threshold)
    across = x.join(y, (F.col("x.h") == F.col("y.h")) & (F.col("x.block") < F.col("y.block")) & fits).select(F.col("x.block").alias("a"), F.col("y.block").alias("b"))
    within = held.filter("docs > 1").select(F.col("block").alias("a"), F.col("block").alias("b"))
    return across.union(within).distinct()


def verify(a: list, b: list | None, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """The links between documents of a and of b (b None: among those of a), as two arrays of places. A document is
    (size, prefix, prefix_at, body)."""
    same, b = b is None, a if b is None else b
    na, nb = np.array([d[0] for d in a]), np.array([d[0] for d in b])
    need = _needed(na[:, None], nb[None, :], threshold)
    seen = np.zeros((len(a), len(b)), bool)
    own = [np.concatenate([d[1] for d in x]) for x in (a, b)]
    who = [np.repeat(np.arange(len(x)), [len(d[1]) for d in x]) for x in (a, b)]
    at = [np.concatenate([d[2] for d in x]) for x in (a, b)]
    order = [np.argsort(o, kind="stable") for o in own]
    shared = np.intersect1d(own[0], own[1])
    ends = [(np.searchsorted(o[k], shared, "left"), np.searchsorted(o[k], shared, "right")) for o, k in zip(own, order, strict=True)]
    for k in range(len(shared)):
        i, j = (order[s][ends[s][0][k] : ends[s][1][k]] for s in (0, 1))
        if same and len(i) == 1:
            continue
        # What is left from here on bounds the intersection if no shared shingle came before; the earliest one that
        # two documents share has the largest rest, so any that suffices lets the pair through.
        rows, cols = who[0][i], who[1][j]
        rest = np.minimum((na[rows] - at[0][i])[:, None], (nb[cols] - at[1][j])[None, :])
        seen[np.ix_(rows, cols)] |= rest >= need[np.ix_(rows, cols)]
    if same:
        seen &= ~np.tri(len(a), dtype=bool)  # each pair once
    seen &= (100 * na[:, None] >= threshold * nb[None, :]) & (100 * nb[None, :] >= threshold * na[:, None])
    if not seen.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    bins = [np.stack([np.bincount((d[3] >> np.uint64(60)).astype(np.int64), minlength=SUFFIX_BINS) for d in x]) for x in (a, b)]
    bound = sum(np.minimum(bins[0][:, None, k], bins[1][None, :, k]) for k in range(SUFFIX_BINS))
    seen &= bound >= need
    rows, cols = np.flatnonzero(seen.any(1)), np.flatnonzero(seen.any(0))
    if not len(rows):
        return rows, rows
    both = np.zeros((len(rows), len(cols)), np.int64)
    body = [np.concatenate([x[d][3] for d in keep]) for x, keep in ((a, rows), (b, cols))]
    doc = [np.repeat(np.arange(len(keep)), [len(x[d][3]) for d in keep]) for x, keep in ((a, rows), (b, cols))]
    common = np.intersect1d(body[0], body[1])
    for k in range(0, len(common), 2048):  # exact intersections, some shingles at a time
        some = common[k : k + 2048]
        grid = []
        for s, keep in ((0, rows), (1, cols)):
            m = np.zeros((len(keep), len(some)), np.float32)
            place = np.searchsorted(some, body[s])
            hit = (place < len(some)) & (some[np.minimum(place, len(some) - 1)] == body[s])
            m[doc[s][hit], place[hit]] = 1
            grid.append(m)
        both += (grid[0] @ grid[1].T).astype(np.int64)
    linked = seen[np.ix_(rows, cols)] & (100 * both >= threshold * (na[rows][:, None] + nb[cols][None, :] - both))
    i, j = np.nonzero(linked)
    return rows[i], cols[j]


LINKED = "sig binary, root binary, n_links long"


def links(act: DataFrame, threshold: int, least: int) -> DataFrame:
    """Of each linked representative, from each pair of blocks: the root of its local forest and its links (copies counted)."""
    prefix = settle(_prefix_rows(act))
    shared = spread_join(prefix, prefix.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1").select("h"), "h", least, F.xxhash64("sig"))
    shared = settle(shared)
    placed = settle(blocks(shared, least))
    pairs = settle(block_pairs(shared, placed, threshold))
    full = act.join(placed, "sig").select(F.struct("home", "salt").alias("block"), "sig", "size", "copies", "prefix", "prefix_at", "body")
    cols = ["a", "b", "sig", "size", "copies", "prefix", "prefix_at", "body"]
    left = full.join(pairs, F.col("block") == F.col("a")).select(*cols, F.lit(0).alias("side"))
    right = full.join(pairs.filter("a != b"), F.col("block") == F.col("b")).select(*cols, F.lit(1).alias("side"))

    def run(part: pa.Table) -> pa.Table:
        rows = sorted(zip(*(part.column(c).to_pylist() for c in ("side", "sig", "size", "copies", "prefix", "prefix_at", "body")), strict=True))
        docs = [(r[2], np.frombuffer(r[4], np.uint64), np.frombuffer(r[5], np.int32), np.frombuffer(r[6], np.uint64)) for r in rows]
        m = sum(r[0] == 0 for r in rows)
        alone = m == len(rows)
        i, j = verify(docs[:m], None if alone else docs[m:], threshold)
        j = j if alone else j + m
        copies = np.array([r[3] for r in rows])
        n_links = np.bincount(i, weights=copies[j], minlength=len(rows)) + np.bincount(j, weights=copies[i], minlength=len(rows))
        root = np.arange(len(rows))
        while True:  # local components by the least place
            least = root.copy()
            np.minimum.at(least, i, root[j])
            np.minimum.at(least, j, root[i])
            least = least[least]
            if (least == root).all():
                break
            root = least
        keep = np.flatnonzero(n_links)
        return pa.table({"sig": pa.array([rows[k][1] for k in keep], pa.binary()), "root": pa.array([rows[root[k]][1] for k in keep], pa.binary()), "n_links": pa.array(n_links[keep].astype(np.int64))})

    return left.union(right).groupBy("a", "b").applyInArrow(run, LINKED)


def components(edges: DataFrame, least: int) -> DataFrame:
    """node, root: the least node that each node of ``edges`` (x, y) reaches. Each round takes the least label among the
    neighbours, then jumps to the label's own label; its cost is that of a few joins on the nodes, and
    long chains halve from round to round. Nodes with more than ``least`` neighbours and labels of more nodes are spread over tasks."""
    both = edges.filter("x != y").distinct()
    both = settle(both.union(both.select("y", "x")).toDF("x", "y").distinct())
    label = settle(both.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("root")).withColumnRenamed("x", "node"))
    while True:
        near = spread_join(both, label.withColumnRenamed("node", "y"), "y", least, F.xxhash64("x")).groupBy("x").agg(F.min("root").alias("near"))
        step = label.join(near, label.node == near.x).select("node", F.least("root", "near").alias("new"), F.col("root").alias("old"))
        jump = step.select(F.col("node").alias("new"), F.col("new").alias("far"))
        step = settle(spread_join(step, jump, "new", least, F.xxhash64("node"), "left").select("node", F.least("new", F.coalesce("far", "new")).alias("root"), "old"))
        if step.filter("root != old").isEmpty():
            return step.select("node", "root")
        label = step.select("node", "root")


def near_duplicates(docs: DataFrame, n: int = 5, threshold: int = 75) -> DataFrame:
    """doc_id, n_shingles, component_id (the least doc_id that links reach, its own included), n_links (to other
    documents, copies counted), class_sig (equal for equal sets), root (equal within a component; null without words) and row_key of every row.

    Null and empty texts have n_shingles 0, link with nothing and keep their own doc_id as component_id. Rows with a
    null doc_id take part; a component's id is the least that isn't null (null if all are). Repeated rows are copies
    of each other. Only doc_id and text are read. An empty table gives an empty result.
    """
    n_chunks = chunks_for(volume(docs))
    sigs = settle(describe(docs, n, n_chunks))
    hot = hot_from(sigs.count())
    classes = sigs.filter("n_shingles > 0").groupBy("sig").agg(F.min("_chunk").alias("_chunk"), F.count("*").alias("copies"), F.min("doc_id").alias("least"))
    classes = settle(classes)
    slices = Slices(n_chunks, partitions(docs.sparkSession, n_chunks), 4)
    act = settle(active(deal(docs, n_chunks, "doc_id", "text"), classes, n, threshold, slices))
    found = settle(links(act, threshold, hot))
    roots = components(found.select(F.col("sig").alias("x"), F.col("root").alias("y")), hot)
    # By class, each step written once, as the next reads it more than once.
    rooted = settle(classes.select("sig", "copies", "least").join(roots.withColumnRenamed("node", "sig"), "sig", "left").withColumn("root", F.coalesce("root", "sig")))
    named = spread_join(rooted, rooted.groupBy("root").agg(F.min("least").alias("component_id")), "root", hot, F.xxhash64("sig"))
    linked = named.join(found.groupBy("sig").agg(F.sum("n_links").alias("n")), "sig", "left")
    by_class = settle(linked.select("sig", "root", "component_id", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links")))
    some = F.col("n_shingles") > 0
    return spread_join(sigs, by_class, "sig", hot, F.monotonically_increasing_id(), "left").select(
        "doc_id", "n_shingles", F.when(some, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), F.when(some, F.col("n_links")).otherwise(0).alias("n_links"), F.col("sig").alias("class_sig"), "root", "row_key"
    )


def one_of_each(docs: DataFrame, n: int = 5, threshold: int = 75) -> DataFrame:
    """The rows of ``docs`` without those that repeat, nearly or exactly, another row's text: of each component one row
    with the least doc_id (a null one last) stays. Rows without words all stay."""
    found = settle(near_duplicates(docs, n, threshold))
    chosen = found.filter("n_shingles > 0").groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("open"), "doc_id", "row_key")).alias("m")).select("m.doc_id", "m.row_key")
    same = found.filter("n_shingles > 0").groupBy("doc_id", "row_key").agg(F.count("*").alias("rows"))
    chosen = settle(chosen.alias("c").join(same.alias("s"), (F.col("c.row_key") == F.col("s.row_key")) & F.col("c.doc_id").eqNullSafe(F.col("s.doc_id"))).select(F.col("c.doc_id").alias("_id"), F.col("c.row_key").alias("_key"), "rows"))
    worded = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    keyed = docs.filter(worded).select(F.struct(*docs.columns).alias("row"), "doc_id", row_key().alias("own"))
    stay = lambda rows: keyed.join(rows, (F.col("own") == F.col("_key")) & F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi")
    once, often = stay(chosen.filter("rows = 1")), stay(chosen.filter("rows > 1")).dropDuplicates(["own", "doc_id"])
    back = [F.col("row")[c].alias(c) for c in docs.columns]
    return once.select(*back).union(often.select(*back)).union(docs.filter(~worded))
