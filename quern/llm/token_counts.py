"""Token counts by offset-mapped attribution.

Each text is encoded once, whole, so no token depends on where a section begins. Tokens cover the text's UTF-8 bytes without a
gap; their spans are joined with the sections' spans, and a token that crosses a boundary is allocated by an explicit rule:

* ``start``: to the section that holds its first byte;
* ``most``: to the section that holds most of its bytes, the earlier one if equal;
* ``share``: to each section in proportion to the bytes of the token in it.

What no section holds counts as outside. The sections of a document may overlap; each is then credited on its own, and
outside is what ``start`` puts in none.
"""

from __future__ import annotations

import base64
import os

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import pieces, rows_of

#: The public byte-level BPE split pattern, and the most bytes of a vocabulary file that are broadcast.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
MOST_VOCABULARY = 64 << 20
VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"


def read_vocabulary(spark: SparkSession, path: str):
    """The vocabulary file as a broadcast, so that executors need no copy: a path without a scheme is read on the driver, any other
    by Spark."""
    if "://" in path:
        row = spark.read.format("binaryFile").load(path).select("length", F.when(F.col("length") <= MOST_VOCABULARY, F.col("content")).alias("content")).first()
        length, content = row.length, row.content
    else:
        length = os.path.getsize(path)
        content = open(path, "rb").read(MOST_VOCABULARY + 1)
    if length > MOST_VOCABULARY:
        raise ValueError(f"{path} has {length} bytes; at most {MOST_VOCABULARY} are broadcast")
    return spark.sparkContext.broadcast(bytes(content))


class Encoder:
    """A byte-level BPE with the byte length of every token."""

    def __init__(self, content: bytes, pattern: str):
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, content.splitlines())}
        self.encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.sizes = np.zeros(max(ranks.values()) + 1, np.int64)
        self.sizes[list(ranks.values())] = [len(t) for t in ranks]

    def bounds(self, text: str) -> np.ndarray:
        """The byte offsets at which tokens begin, and the end."""
        return np.concatenate([[0], np.cumsum(self.sizes[np.array(self.encoding.encode_ordinary(text), np.int64)])])


_ENCODERS: dict = {}


def _encoder(content: bytes, pattern: str) -> Encoder:
    key = (hash(content), pattern)
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(content, pattern)
    return _ENCODERS[key]


def line_spans(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Byte spans of the lines, each with its line feed; they tile the text."""
    ends = np.flatnonzero(np.frombuffer(data, np.uint8) == 10) + 1
    if len(data) and (not len(ends) or ends[-1] < len(data)):
        ends = np.append(ends, len(data))
    return np.concatenate([[0], ends[:-1]]) if len(ends) else ends, ends


def to_bytes(data: bytes, offsets: np.ndarray) -> np.ndarray:
    """Byte offsets of character offsets (cut to the text)."""
    leads = np.append(np.flatnonzero((np.frombuffer(data, np.uint8) & 0xC0) != 0x80), len(data))
    return leads[np.clip(offsets, 0, len(leads) - 1)]


def allocate(bounds: np.ndarray, starts: np.ndarray, ends: np.ndarray, rule: str) -> tuple[np.ndarray, int]:
    """Tokens credited to each span (starts sorted or not), and how many tokens cross a span's boundary."""
    first, last = bounds[:-1], bounds[1:]
    if not len(first) or not len(starts):
        return np.zeros(len(starts)), 0
    edges = np.unique(np.concatenate([starts, ends]))
    crossing = int((np.searchsorted(edges, first, side="right") < np.searchsorted(edges, last, side="left")).sum())
    lo, hi = np.searchsorted(first, starts, side="left"), np.searchsorted(first, ends, side="left")
    hi = np.maximum(lo, hi)
    credit = (hi - lo).astype(np.float64)
    if rule == "start":
        return credit, crossing
    size = (last - first).astype(np.float64)
    for k in range(len(starts)):  # only the token that covers a start and the one that covers an end can differ
        a, b = int(starts[k]), int(ends[k])
        if b <= a:
            credit[k] = 0
            continue
        some = {int(np.searchsorted(last, a, side="right")), int(np.searchsorted(first, b, side="left")) - 1}
        for t in some:
            if 0 <= t < len(first):
                inside = min(last[t], b) - max(first[t], a)
                credit[k] -= lo[k] <= t < hi[k]
                if rule == "share":
                    credit[k] += max(0, inside) / size[t]
                else:
                    before = max(0, a - first[t])
                    credit[k] += inside > 0 and inside > before and inside >= size[t] - before - inside
    return credit, crossing


def count_tokens(docs: DataFrame, sections: str | None = None, rule: str = "start", vocabulary: str = VOCABULARY, pattern: str = PATTERN, carry: list[str] | None = None) -> DataFrame:
    """The columns of ``docs`` (those in ``carry``, if given; made columns replace those of the same names) and, of every row, n_tokens, n_sections, n_crossing
    (tokens across a section boundary), outside (tokens in no section, by their first byte) and section_tokens, an
    array in the order of the sections.

    ``sections``: a column with array<struct<start, end>>, in characters; by default the lines, which tile the
    text. A null text has no tokens and sections without any; an empty one has no lines. Null sections or null ends count as
    none. Any length of text is encoded whole. Repeated rows count each. An empty table gives an empty result.
    """
    if rule not in ("start", "most", "share"):
        raise ValueError(f"no such rule: {rule}")
    content = read_vocabulary(docs.sparkSession, vocabulary)
    made = "n_tokens long, n_sections long, n_crossing long, outside long, section_tokens array<double>"
    names = [c.split()[0] for c in made.split(", ")]
    kept = [c for c in (docs.columns if carry is None else carry) if c not in names]
    spans = F.lit(None).cast("array<struct<start:bigint,end:bigint>>") if sections is None else F.transform(sections, lambda s: F.struct(s["start"].cast("bigint").alias("start"), s["end"].cast("bigint").alias("end")))
    read = docs.select(*kept, docs["text"].alias("__quern_text"), spans.alias("__quern_sections"))

    def run(batches):
        encoder = _encoder(content.value, pattern)
        for batch in pieces(batches, "__quern_text"):
            out: list[list] = [[], [], [], [], []]
            given = batch.column("__quern_sections").to_pylist() if sections is not None else [None] * batch.num_rows
            for text, data, own in zip(batch.column("__quern_text").to_pylist(), rows_of(batch, "__quern_text"), given, strict=True):
                bounds = encoder.bounds(text or "")
                if sections is None:
                    starts, ends = line_spans(data or b"")
                else:
                    pairs = np.array([(s["start"], s["end"]) for s in own or [] if s and s["start"] is not None and s["end"] is not None], np.int64).reshape(-1, 2)
                    starts, ends = to_bytes(data or b"", pairs[:, 0]), to_bytes(data or b"", pairs[:, 1])
                credit, crossing = allocate(bounds, starts, ends, rule)
                inside = np.zeros(len(bounds), np.int64)
                lo = np.searchsorted(bounds[:-1], starts)
                np.add.at(inside, lo, 1)
                np.add.at(inside, np.maximum(lo, np.searchsorted(bounds[:-1], ends)), -1)
                n = len(bounds) - 1
                for column, value in zip(out, (n, len(starts), crossing, int((np.cumsum(inside)[:n] == 0).sum()), credit), strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in range(len(kept))), *(pa.array(c, pa.int64()) for c in out[:4]), pa.array(out[4], pa.list_(pa.float64()))], names=[*kept, *names]
            )

    types = dict(docs.dtypes)
    return read.mapInArrow(run, ", ".join([*(f"`{c}` {types[c]}" for c in kept), made]))
