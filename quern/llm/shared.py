"""What the corpus operators share: slim checkpoints, word hashes in numpy, chunks of documents, distributed counting.

Chunks and counting
-------------------
Several operators need, for every n-gram of every document, a number that depends on the whole corpus. They all go
the same way round:

1. documents are dealt into *chunks* of a few MB by a hash of their own content (``deal``); equal rows, and only
   those, always meet;
2. each chunk sends the sorted distinct hashes it holds, with weights, as packed *segments*, one for each slice of
   the hash range (``segments``), so a hash that is everywhere costs one entry a chunk however often it occurs;
3. each slice adds up its segments and answers every one with an array in the same order (``add_up``);
4. the chunk, grouped again on the same shuffled text, reads the answers (``answers``).

The text is shuffled once: every later use of ``deal`` in the same plan reuses that exchange. A lost executor costs
only the recomputation of its tasks, because chunk and slice contents do not depend on the order rows arrive in.
"""

from __future__ import annotations

import ctypes
import tempfile

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a chunk holds on average.
CHUNK_BYTES = 4 << 20


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder. On a single machine without such a setting, a temporary one; on a cluster that is an error, as
    executors couldn't read what others wrote."""
    if where := spark.conf.get("spark.checkpoint.dir", None):
        return where
    if not spark.sparkContext.getCheckpointDir():
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="quern-checkpoint-"))
    return spark.sparkContext.getCheckpointDir()


def settle(df: DataFrame) -> DataFrame:
    """``df`` as written to the cluster's shared checkpoint folder; its lineage is cut there."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


#: Rows of an Arrow batch: whole texts are long, so far fewer than Spark's 10,000.
BATCH_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the folder. Sets the session's Arrow batches to BATCH_ROWS, so that Python workers hold a few MB of texts at a time."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---------------------------------------------------------------- hot keys

#: Tasks that a hot key's rows are spread over.
SALTS = 64


def hot_from(n_rows: int) -> int:
    """How many rows make a key hot; fewer than 10,000 keys can hold as many of n_rows each."""
    return max(500, n_rows // 10_000)


def spread_join(rows: DataFrame, facts: DataFrame, key: str, least: int, by, how: str = "inner") -> DataFrame:
    """``rows`` joined on ``key`` with ``facts``, which has one row for each key. The rows of keys that more than ``least`` rows hold are
    spread over SALTS tasks by ``by``, an integer column that the rows' content decides. The keys concerned are few (see hot_from) and are broadcast."""
    hot = F.broadcast(rows.groupBy(key).agg(F.count("*").alias("_n")).filter(F.col("_n") > least).select(key, F.lit(True).alias("_hot")))
    left = rows.join(hot, key, "left").withColumn("_salt", F.when(F.col("_hot"), F.pmod(by, F.lit(SALTS))).otherwise(0).cast("int")).drop("_hot")
    salts = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    right = facts.join(hot, key, "left").withColumn("_salt", F.explode(salts)).drop("_hot")
    return left.join(right, [key, "_salt"], how).drop("_salt")


# ---------------------------------------------------------------- hashing in numpy

_U = np.uint64


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64 (the splitmix64 output function)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n (base odd)."""
    have = _POWERS.get(base)
    if have is None or len(have[0]) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        up, down = np.full(size, base, np.uint64), np.full(size, pow(base, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        have = _POWERS[base] = np.cumprod(up), np.cumprod(down)
    return have[0][:n], have[1][:n]


_BYTE_BASE, _WORD_BASE = 0x9E3779B97F4A7C15 | 3, 0xD6E8FEB86659FD93 | 3
_BYTE_CODE = mix64(np.arange(1, 257, dtype=np.uint64) * _U(0x9E3779B97F4A7C15))

_IDENTITY = np.arange(256, dtype=np.uint8)
_LOWER = _IDENTITY.copy()
_LOWER[65:91] += 32
_BLANK = np.zeros(256, bool)
_BLANK[[32, 9, 10, 11, 12, 13]] = True
_NOT_ALNUM = np.zeros(256, bool)
_NOT_ALNUM[:128] = True
_NOT_ALNUM[48:58] = _NOT_ALNUM[97:123] = _NOT_ALNUM[65:91] = False

#: (byte map, bytes that part words). UTF-8 bytes from 0x80 on always belong to words.
WORDS, LOWER_WORDS, LOWER_ALNUM = (_IDENTITY, _BLANK), (_LOWER, _BLANK), (_LOWER, _NOT_ALNUM)


#: Bytes of text that are hashed in one go.
PIECE_BYTES = 1 << 17


class Words:
    """The words of some texts as 64-bit hashes: those of text i are ``hashes[at[i]:at[i + 1]]``."""

    def __init__(self, texts: list[bytes | None], rule=WORDS):
        mapped, parts = rule
        hashes, counts = [np.zeros(0, np.uint64)], np.zeros(len(texts) + 1, np.int64)
        group, owner, size = [], [], 0
        for i, t in enumerate(texts):
            for piece in self._pieces(t or b"", parts):
                group.append(piece)
                owner.append(i)
                size += len(piece)
                if size > PIECE_BYTES:
                    self._hash(group, owner, mapped, parts, hashes, counts)
                    group, owner, size = [], [], 0
        if group:
            self._hash(group, owner, mapped, parts, hashes, counts)
        self.hashes = np.concatenate(hashes)
        self.at = np.concatenate([[0], np.cumsum(counts[: len(texts)])]).astype(np.int64)

    @staticmethod
    def _pieces(text: bytes, parts: np.ndarray) -> list[bytes]:
        """A long text cut between words, so that memory follows PIECE_BYTES (or the longest word)."""
        if len(text) <= 2 * PIECE_BYTES:
            return [text]
        gaps = np.flatnonzero(parts[np.frombuffer(text, np.uint8)])
        cuts = gaps[np.unique(np.searchsorted(gaps, np.arange(PIECE_BYTES, len(text), PIECE_BYTES)).clip(max=max(0, len(gaps) - 1)))] if len(gaps) else gaps
        ends = [0, *cuts.tolist(), len(text)]
        return [text[a:b] for a, b in zip(ends, ends[1:], strict=False)]

    @staticmethod
    def _hash(texts: list[bytes], owner: list[int], mapped, parts, hashes: list, counts: np.ndarray) -> None:
        data = np.frombuffer(b" " + b" ".join(texts) + b" ", np.uint8)
        edge = np.diff(parts[data].astype(np.int8))
        start, end = np.flatnonzero(edge == -1) + 1, np.flatnonzero(edge == 1) + 1
        up, down = _powers(_BYTE_BASE, len(data))
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE_CODE[mapped[data]] * up)])
        hashes.append(mix64((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64)))
        first = np.cumsum([1, *(len(t) + 1 for t in texts)])
        np.add.at(counts, owner, np.diff(np.searchsorted(start, first)))


def windows(words: np.ndarray, length: int) -> np.ndarray:
    """A hash of every ``length`` consecutive words, by start; none if there are fewer words."""
    n = len(words) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    up, down = _powers(_WORD_BASE, len(words))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * up)])
    return mix64((total[length:] - total[:-length]) * down[:n] + _U(length))


# ---------------------------------------------------------------- chunks

def rows_of(part: pa.Table | pa.RecordBatch, name: str) -> list:
    """A string or binary column as a list of bytes (None: null)."""
    column = part.column(name)
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
        if isinstance(column, pa.ChunkedArray):
            return [x for c in column.chunks for x in c.cast(pa.binary()).to_pylist()]
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def pieces(batches, name: str, most: int = 2 << 20):
    """Record batches cut so that each holds about ``most`` bytes of a text column (or one row)."""
    for batch in batches:
        size = np.cumsum([0, *((x or 0) + 1 for x in pc.binary_length(batch.column(name)).to_pylist())])
        start = 0
        while start < batch.num_rows:
            end = max(start + 1, int(np.searchsorted(size, size[start] + most, side="right")) - 1)
            yield batch.slice(start, end - start)
            start = end


def volume(docs: DataFrame, text: str = "text") -> int:
    """UTF-8 bytes of all texts."""
    return docs.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()[0]


def chunks_for(n_bytes: int, chunk_bytes: int = CHUNK_BYTES) -> int:
    """How many chunks texts of so many bytes make. Beyond 64 GB chunks grow with the square root of the whole (16 MB at 1 TB,
    160 MB at 100 TB), so that a chunk's segments, one for each slice, keep hundreds of hashes."""
    return max(1, -(-n_bytes // int(chunk_bytes * max(1.0, (n_bytes / (64 << 30)) ** 0.5))))


def give_back() -> None:
    """Returns freed memory to the system, so that idle Python workers don't hold what their largest task needed."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim is not None:
        trim(0)


def chunk_of(n_chunks: int, *by: str):
    return F.pmod(F.xxhash64(*by), F.lit(n_chunks)).cast("int").alias("_chunk")


def partitions(spark: SparkSession, n_chunks: int) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), n_chunks // 4)


def deal(docs: DataFrame, n_chunks: int, *cols: str) -> DataFrame:
    """``cols`` (doc_id and text among them) and _chunk, shuffled by chunk."""
    return docs.select(chunk_of(n_chunks, "doc_id", "text"), *cols).repartition(partitions(docs.sparkSession, n_chunks), "_chunk")


# ---------------------------------------------------------------- counting

SEGMENT = "_part int, _chunk int, vals binary, weights binary"
ANSWER = "_chunk int, _kind int, _part long, data binary"


class Slices:
    """2**bits equal ranges of the 64-bit hashes. ``width``: bytes of a hash that a segment holds besides its slice, so hashes
    are compared by their leading bits + 8 * width bits (64 at most)."""

    def __init__(self, n_chunks: int, n_partitions: int, width: int = 8):
        self.bits = max(3, (max(n_partitions, min(4 * n_partitions, n_chunks), n_chunks // 8) - 1).bit_length())
        self.low = min(64 - self.bits, 8 * width)  # bits of a hash within its slice
        self.width = -(-self.low // 8)

    @property
    def count(self) -> int:
        return 1 << self.bits

    def reduce(self, h: np.ndarray) -> np.ndarray:
        """The part of a hash that is compared."""
        return h >> _U(64 - self.bits - self.low)

    def cut(self, u: np.ndarray) -> list[tuple[int, int, int]]:
        """(slice, from, to) of the slices that the sorted reduced hashes u fall in."""
        at = np.append(np.searchsorted(u, np.arange(self.count, dtype=np.uint64) << _U(self.low)), len(u))
        return [(int(p), int(at[p]), int(at[p + 1])) for p in np.flatnonzero(np.diff(at))]


_ZSTD = pa.Codec("zstd", compression_level=1)


def _planes(x: np.ndarray, width: int) -> bytes:
    """The lowest ``width`` bytes of numbers, bytes of one weight together."""
    return np.ascontiguousarray(x, dtype="<u8").reshape(-1, 1).view(np.uint8)[:, :width].T.tobytes()


def _from_planes(data: bytes, width: int) -> np.ndarray:
    wide = np.zeros((len(data) // width, 8), np.uint8)
    wide[:, :width] = np.frombuffer(data, np.uint8).reshape(width, -1).T
    return wide.view("<u8").ravel()


def pack64(x: np.ndarray) -> bytes:
    """Numbers from 0 on (of any number of axes, which are lost) by bytes of one weight, compressed: small ones cost little."""
    return x.size.to_bytes(4, "little") + _ZSTD.compress(_planes(x.ravel(), 8), asbytes=True)


def unpack64(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:4], "little")
    return _from_planes(_ZSTD.decompress(data[4:], 8 * n, asbytes=True), 8).view(np.int64) if n else np.zeros(0, np.int64)


def pack_sorted(u: np.ndarray, width: int) -> bytes:
    """Sorted numbers as their differences, bytes of one weight together: the leading planes are mostly zeros."""
    return _planes(np.diff(u.astype(np.uint64), prepend=np.uint64(0)), width)


def unpack_sorted(data: bytes, width: int) -> np.ndarray:
    return np.cumsum(_from_planes(data, width), dtype=np.uint64)


def segments(chunk: int, u: np.ndarray, weights: np.ndarray, slices: Slices) -> pa.Table:
    """Sorted distinct reduced hashes of a chunk, packed by slice; weights: one row or several a hash."""
    w = weights.reshape(-1, max(1, len(u)))
    low = np.uint64(2**slices.low - 1)
    rows = [(p, pack_sorted(u[a:b] & low, slices.width), pack64(w[:, a:b])) for p, a, b in slices.cut(u)]
    return pa.table({
        "_part": pa.array([r[0] for r in rows], pa.int32()), "_chunk": pa.array([chunk] * len(rows), pa.int32()),
        "vals": pa.array([r[1] for r in rows], pa.binary()), "weights": pa.array([r[2] for r in rows], pa.binary()),
    })


#: The chunk to which the summaries of slices go.
NOBODY = -1


def add_up(segs: DataFrame, slices: Slices, kind: int, respond, n_weights: int = 1, n_sides: int = 1, summary=None) -> DataFrame:
    """Adds the weights of each hash over all segments of its slice. ``respond(sums, chunk)`` turns the sums (n_sides * n_weights
    rows, int64) that belong to one segment into the bytes sent back to its chunk (None: nothing is sent). With two sides, chunks below 0
    add to the second one. ``summary`` turns the sums of a whole slice into bytes, sent to NOBODY as kind + 100."""
    columns = ("_part", "_chunk", "vals", "weights")

    def total(rows: list, where: np.ndarray, n: int) -> np.ndarray:
        weights = np.concatenate([r[3] for r in rows], axis=1)
        if n_sides == 1:
            return np.stack([np.bincount(where, weights=w, minlength=n) for w in weights]).astype(np.int64)
        second = np.repeat([r[1] < 0 for r in rows], [len(r[2]) for r in rows])
        sides = [np.bincount(where[own], weights=w[own], minlength=n) for own in (~second, second) for w in weights]
        return np.stack(sides).astype(np.int64)

    def run(batches):
        by: dict[int, list] = {}
        for b in batches:
            for part, chunk, v, w in zip(*(b.column(n).to_pylist() for n in columns), strict=True):
                by.setdefault(part, []).append((part, chunk, unpack_sorted(v, slices.width), unpack64(w).reshape(n_weights, -1)))
        for part in list(by):
            rows = by.pop(part)
            u, where = np.unique(np.concatenate([r[2] for r in rows]), return_inverse=True)
            sums = total(rows, where, len(u))
            at = np.cumsum([0, *(len(r[2]) for r in rows)])
            out = [(r[1], kind, respond(sums[:, where[a:b]], r[1])) for r, a, b in zip(rows, at, at[1:], strict=False)]
            if summary is not None:
                out.append((NOBODY, kind + 100, summary(sums)))
            out = [r for r in out if r[2] is not None]
            yield pa.RecordBatch.from_pydict({
                "_chunk": pa.array([r[0] for r in out], pa.int32()), "_kind": pa.array([r[1] for r in out], pa.int32()), "_part": pa.array([part] * len(out), pa.int64()), "data": pa.array([r[2] for r in out], pa.binary()),
            })
        give_back()

    return segs.repartitionById(slices.count, F.col("_part")).mapInArrow(run, ANSWER)


def answers(side: pa.Table, kind: int, dtype) -> np.ndarray:
    """The answers of one kind to a chunk, joined in the order of its sorted distinct hashes."""
    rows = sorted((p, d) for k, p, d in zip(*(side.column(n).to_pylist() for n in ("_kind", "_part", "data")), strict=True) if k == kind)
    return np.frombuffer(b"".join(d for _, d in rows), dtype)
