"""Substring dedup by level-wise doubling.

Windows of a short length are counted over the whole corpus; only where a window is repeated is it extended to twice
that length (two repeated windows end to end), and so on up to ``length`` words (the last step overlaps where
``length`` isn't a power of two times the first). A window that is repeated at one length contains only windows that
are repeated at every shorter one, so nothing is lost; a level without candidates sends nothing.

All levels read the one shuffled copy of the text (see ``shared``); what travels between levels is, out, 4 or 8 bytes
for each distinct candidate window of a chunk and, back, one bit. A passage that every document holds costs one entry
a chunk. The first levels compare about 40 bits of a window's hash, which can only let false candidates through; the
last compares 64.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .shared import SEGMENT, Slices, Words, add_up, chunks_for, deal, partitions, rows_of, segments, volume, windows


def levels(length: int, first: int = 9) -> list[int]:
    """The window lengths, shortest first: ``length`` halved, rounding up, while at least ``first``."""
    out = [length]
    while out[0] > 1 and -(-out[0] // 2) >= first:
        out.insert(0, -(-out[0] // 2))
    return out


class _Chunk:
    """One chunk's words and, level by level, which windows are still candidates."""

    def __init__(self, part: pa.Table, lengths: list[int]):
        order = sorted(range(part.num_rows), key=lambda i, t=rows_of(part, "text"), d=part.column("doc_id").to_pylist(): (d[i] is None, d[i], t[i] or b""))
        self.rows = part.take(pa.array(order, pa.int64()))
        self.words = Words(rows_of(self.rows, "text"))
        self.lengths = lengths
        ends = np.repeat(self.words.at[1:], np.diff(self.words.at))
        self.left = ends - np.arange(len(ends))  # words from here to the end of the document

    def candidates(self, level: int, repeated: np.ndarray | None) -> np.ndarray:
        """Starts whose windows of this level can be repeated, given which of the level before are (by start)."""
        length = self.lengths[level]
        fits = self.left >= length
        if level:
            half, step = self.lengths[level - 1], length - self.lengths[level - 1]
            assert 0 < step <= half
            second = np.zeros(len(fits), bool)
            second[: max(0, len(fits) - step)] = repeated[step:]
            fits = fits & repeated & second
        return np.flatnonzero(fits)

    def level(self, level: int, repeated, slices: Slices):
        starts = self.candidates(level, repeated)
        h = slices.reduce(windows(self.words.hashes, self.lengths[level])[starts]) if len(starts) else np.zeros(0, np.uint64)
        return starts, *np.unique(h, return_inverse=True, return_counts=True)

    def replay(self, upto: int, side: pa.Table | None, slices: list[Slices]) -> np.ndarray | None:
        """Which starts are repeated at level upto - 1."""
        repeated = None
        for k in range(upto):
            starts, u, where, _ = self.level(k, repeated, slices[k])
            repeated = np.zeros(len(self.left), bool)
            if len(u):
                cut = slices[k].cut(u)
                data = {p: d for kind, p, d in zip(*(side.column(n).to_pylist() for n in ("_kind", "_part", "data")), strict=True) if kind == k}
                bits = np.concatenate([np.unpackbits(np.frombuffer(data[p], np.uint8), count=b - a) for p, a, b in cut]).astype(bool)
                repeated[starts[bits[where]]] = True
        return repeated


def _sender(k: int, lengths: list[int], slices: list[Slices]):
    def later(key, part, side):
        chunk = _Chunk(part, lengths)
        _, u, _, counts = chunk.level(k, chunk.replay(k, side, slices), slices[k])
        return segments(key[0].as_py(), u, counts, slices[k])

    return later if k else lambda key, part: later(key, part, None)


def _respond(sums: np.ndarray, chunk: int) -> bytes:
    return np.packbits(sums[0] > 1).tobytes()


def repeated_spans(docs: DataFrame, length: int = 35, *, finish, schema: str, chunk_bytes: int = 4 << 20) -> DataFrame:
    """For each chunk, ``finish(rows, words, covered)`` with the rows as an Arrow table, their ``Words`` and, by word,
    whether a repeated window covers it; it returns an Arrow table of ``schema``."""
    spark = docs.sparkSession
    n = chunks_for(volume(docs), chunk_bytes)
    lengths = levels(length)
    slices = [Slices(n, partitions(spark, n), 8 if k == len(lengths) - 1 else 4) for k in range(len(lengths))]
    text = deal(docs, n, "doc_id", "text")
    side = None
    for k in range(len(lengths)):

        send = _sender(k, lengths, slices)
        grouped = text.groupBy("_chunk")
        segs = grouped.applyInArrow(send, SEGMENT) if side is None else grouped.cogroup(side.groupBy("_chunk")).applyInArrow(send, SEGMENT)
        answer = add_up(segs, slices[k], k, _respond)
        side = answer if side is None else side.union(answer)

    def last(key, part, more):
        chunk = _Chunk(part, lengths)
        repeated = chunk.replay(len(lengths), more, slices)
        n_words = len(repeated)
        starts = np.flatnonzero(repeated)
        change = np.zeros(n_words + 1, np.int32)
        np.add.at(change, starts, 1)
        np.add.at(change, starts + length, -1)
        return finish(chunk.rows, chunk.words, np.cumsum(change[:n_words]) > 0)

    return text.groupBy("_chunk").cogroup(side.groupBy("_chunk")).applyInArrow(last, schema)


def remove_repeats(docs: DataFrame, length: int = 35) -> DataFrame:
    """Removes each word that a repeated window of ``length`` words covers; a window is repeated if its word sequence
    also starts anywhere else in any text, the same one included.

    Returns doc_id, n_words, n_removed, kept (the kept words joined by one space) and kept_sha256. Null and empty texts
    have no words; texts shorter than the window lose none; equal rows make each other's windows repeated; columns
    other than doc_id and text are not read; an empty table gives an empty result.
    """
    return _finish(docs, length, with_text=True)


def repeats_digest(docs: DataFrame, length: int = 35) -> DataFrame:
    """``remove_repeats`` without the kept text."""
    return _finish(docs, length, with_text=False)


def _finish(docs: DataFrame, length: int, with_text: bool) -> DataFrame:
    def finish(rows: pa.Table, words: Words, covered: np.ndarray) -> pa.Table:
        removed, digest, kept = [], [], []
        for i, t in enumerate(rows_of(rows, "text")):
            gone = covered[words.at[i] : words.at[i + 1]]
            own = (t or b"").split()
            n = int(gone.sum())
            left = b" ".join(compress(own, ~gone) if n else own)
            removed.append(n)
            digest.append(hashlib.sha256(left).hexdigest())
            if with_text:
                kept.append(left.decode())
        out = {"doc_id": rows.column("doc_id"), "n_words": pa.array(np.diff(words.at), pa.int64()), "n_removed": pa.array(removed, pa.int64()), "kept_sha256": pa.array(digest, pa.string())}
        return pa.table(out | ({"kept": pa.array(kept, pa.string())} if with_text else {}))

    kind = dict(docs.dtypes)["doc_id"]
    return repeated_spans(docs, length, finish=finish, schema=f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string" + ", kept string" * with_text)
