"""Language-model scoring by cross-entropy difference.

Two interpolated bigram models, one of the target texts and one of the background (all documents), share one
vocabulary: the words that occur at least ``min_count`` times in both corpora taken together; all others are one unknown word.

    p(w | v) = weight * c(v w) / c(v .) + (1 - weight) * (c(w) + 1) / (N + V + 1)

(only the second term, unweighted, where v was never followed by a word, and for a document's first word). A
document's score is the mean over its words of the target model's loss minus the background model's, in nats: the
lower, the more it resembles the target.

Counts cover every word of every text. Chunks send their distinct words, then their distinct bigrams, with counts;
hash slices add them up and answer (see ``shared``). How often a word is followed by another, c(v .), is its count less the
documents that it ends, so only words carry it. No table of words ever meets in one place: of the vocabulary, chunks
learn seven sums.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import LOWER_WORDS, SEGMENT, Slices, Words, add_up, chunk_of, chunks_for, pack64, partitions, rows_of, segments, unpack64, volume, windows

_UNKNOWN = np.uint64(0x5851F42D4C957F2D)
#: Kinds of answers: of words, of bigrams, and the sums over all words.
_WORD, _PAIR, _TOTAL = 1, 2, 101


def _answers(side: pa.Table, kind: int) -> list[bytes]:
    """The answers of one kind, in the order of the slices."""
    rows = zip(*(side.column(n).to_pylist() for n in ("_kind", "_part", "data")), strict=True)
    return [d for _, d in sorted((p, d) for k, p, d in rows if k == kind)]


def _counts(side: pa.Table, kind: int, height: int) -> np.ndarray:
    """The counts that answer a chunk's sorted distinct hashes: ``height`` rows."""
    parts = [unpack64(d).reshape(height, -1) for d in _answers(side, kind)]
    return np.concatenate(parts, axis=1) if parts else np.zeros((height, 0), np.int64)


class _Chunk:
    """The words of a chunk by place. Chunks below 0 hold target texts."""

    def __init__(self, part: pa.Table):
        self.words = Words(rows_of(part, "text"), LOWER_WORDS)
        self.distinct, self.where, self.counts = np.unique(self.words.hashes, return_inverse=True, return_counts=True)
        at = self.words.at
        self.n_words = np.diff(at)
        self.owner = np.repeat(np.arange(len(self.n_words)), self.n_words)
        self.last = at[1:][self.n_words > 0] - 1
        self.follows = self.owner[1:] == self.owner[:-1]  # word k + 1 is in the same document as word k

    def ends(self) -> np.ndarray:
        """How many documents each distinct word ends."""
        return np.bincount(self.where[self.last], minlength=len(self.distinct))

    def pairs(self, known: np.ndarray, slices: Slices):
        """Sorted distinct (reduced) bigrams with places and counts; ``known`` by distinct word."""
        hashes = np.where(known[self.where], self.words.hashes, _UNKNOWN)
        pairs = windows(hashes, 2)[self.follows] if len(hashes) > 1 else np.zeros(0, np.uint64)
        return np.unique(slices.reduce(pairs), return_inverse=True, return_counts=True)


def cross_entropy_difference(docs: DataFrame, target: DataFrame, min_count: int = 2, weight: float = 0.7) -> DataFrame:
    """doc_id, n_words, n_unknown, loss_target, loss_background and score of every document; ``target`` has the
    column text.

    Null and empty texts have no words, losses of 0 and a score of 0. Repeated rows count and score each. An empty
    target leaves the target model uniform over the vocabulary. Other columns aren't read. Words are lower-cased (A-Z)
    runs of anything but white space. A document's losses are added in the order of its words, so they don't depend on how rows
    arrive. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    n, m = chunks_for(volume(docs)), chunks_for(volume(target))
    width = partitions(spark, n + m)
    words, bigrams = Slices(n + m, width), Slices(n + m, width, 6)
    kind = dict(docs.dtypes)["doc_id"]
    goal = target.select((-2 - chunk_of(m, "text")).alias("_chunk"), F.lit(None).cast(kind).alias("doc_id"), "text")
    text = docs.select(chunk_of(n, "doc_id", "text").alias("_chunk"), "doc_id", "text").union(goal).repartition(width, "_chunk")

    # Words: (count, documents that it ends), of background and of target.
    def send_words(key, part):
        chunk = _Chunk(part)
        return segments(key[0].as_py(), chunk.distinct, np.stack([chunk.counts, chunk.ends()]), words)

    def known(sums: np.ndarray) -> np.ndarray:
        return sums[0] + sums[2] >= min_count

    def answer_words(sums: np.ndarray, chunk: int) -> bytes:
        return pack64(sums) if chunk >= 0 else pack64(known(sums).astype(np.int64))

    def total(sums: np.ndarray) -> bytes:
        rare = sums[:, ~known(sums)].sum(1)
        return pack64(np.array([known(sums).sum(), sums[0].sum(), sums[2].sum(), rare[0], rare[2], rare[0] - rare[1], rare[2] - rare[3]]))

    single = add_up(text.groupBy("_chunk").applyInArrow(send_words, SEGMENT), words, _WORD, answer_words, 2, 2, total).repartition(width, "_chunk")

    # One row of sums, from one of each slice, and back to each background chunk.
    def add_totals(batches):
        sums = np.zeros(7, np.int64)
        for batch in batches:
            rows = zip(batch.column("_kind").to_pylist(), batch.column("data").to_pylist(), strict=True)
            sums += sum((unpack64(d) for k, d in rows if k == _TOTAL), np.zeros(7, np.int64))
        yield pa.RecordBatch.from_pydict({f"t{i}": pa.array([x], pa.int64()) for i, x in enumerate(sums.tolist())})

    def pack_totals(batches):
        for batch in batches:
            for row in batch.to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in ((_TOTAL, pa.int32()), (0, pa.int64()), (pack64(np.array([row[f"t{i}"] or 0 for i in range(7)])), pa.binary()))], names=["_kind", "_part", "data"])

    sums = single.mapInArrow(add_totals, ", ".join(f"t{i} long" for i in range(7))).agg(*(F.sum(f"t{i}").alias(f"t{i}") for i in range(7)))
    one = sums.mapInArrow(pack_totals, "_kind int, _part long, data binary")
    totals = one.select(F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("_chunk"), "_kind", "_part", "data").repartition(width, "_chunk")

    # Bigrams.
    def send_pairs(key, part, side):
        chunk, number = _Chunk(part), key[0].as_py()
        own = _counts(side, _WORD, 4 if number >= 0 else 1)
        u, _, counts = chunk.pairs(known(own) if number >= 0 else own[0] > 0, bigrams)
        return segments(number, u, counts, bigrams)

    def answer_pairs(sums: np.ndarray, chunk: int) -> bytes | None:
        return pack64(sums) if chunk >= 0 else None  # target chunks aren't scored

    double = add_up(text.groupBy("_chunk").cogroup(single.groupBy("_chunk")).applyInArrow(send_pairs, SEGMENT), bigrams, _PAIR, answer_pairs, 1, 2).repartition(width, "_chunk")

    def score(key, part, side):
        chunk = _Chunk(part)
        if key[0].as_py() < 0 or not part.num_rows:
            return _scores(part.slice(0, 0), *(np.zeros(0),) * 4)
        own = _counts(side, _WORD, 4)
        vocabulary, *rest = unpack64(_answers(side, _TOTAL)[0]).tolist()
        size, rare, rare_heads = np.array(rest, np.int64).reshape(3, 2)
        ok = known(own)[chunk.where]
        count = np.where(ok, own[[0, 2]][:, chunk.where], rare[:, None])
        head = np.where(ok, (own[[0, 2]] - own[[1, 3]])[:, chunk.where], rare_heads[:, None])
        p = (count + 1) / (size[:, None] + vocabulary + 1)
        pair = _counts(side, _PAIR, 2)[:, chunk.pairs(known(own), bigrams)[1]]
        first = np.flatnonzero(chunk.follows)
        before, low = head[:, first], p[:, first + 1]
        p[:, first + 1] = np.where(before > 0, weight * pair / np.maximum(before, 1) + (1 - weight) * low, low)
        loss = [np.bincount(chunk.owner, weights=x, minlength=part.num_rows) / np.maximum(chunk.n_words, 1) for x in -np.log(p)]
        return _scores(part, chunk.n_words, np.bincount(chunk.owner, weights=~ok, minlength=part.num_rows), loss[1], loss[0])

    side = single.union(double).union(totals)
    return text.groupBy("_chunk").cogroup(side.groupBy("_chunk")).applyInArrow(score, f"doc_id {kind}, n_words long, n_unknown long, loss_target double, loss_background double, score double")


def _scores(part: pa.Table, n_words, n_unknown, target, background) -> pa.Table:
    return pa.table({
        "doc_id": part.column("doc_id"), "n_words": pa.array(n_words.astype(np.int64)), "n_unknown": pa.array(n_unknown.astype(np.int64)),
        "loss_target": pa.array(target), "loss_background": pa.array(background), "score": pa.array(target - background),
    })
