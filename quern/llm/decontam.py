"""Benchmark decontamination with an FM-index for each shard of training text.

Words are runs of ASCII letters and digits and of anything beyond ASCII, lower-cased (A-Z). A phrase is a window of
``length`` consecutive words of a benchmark item (the whole item, if shorter). Every task builds, shard by shard, the
FM-index of its documents over the shard's own vocabulary: the suffix array gives the Burrows-Wheeler transform, a wavelet
matrix over that answers ranks, and the suffix array is kept only at sampled places. Phrases with a word that the shard lacks are
out at once; all others are searched backwards together, one wavelet descent for each of their words; occurrences are located by
walking to a sampled place, and the spans of a document are merged.

The size of the phrases is measured first. Up to ``block_words`` words they are broadcast; a larger benchmark is dealt by a hash of
its items into blocks of about that size, and the documents pass once for each, with what was found so far written between passes, so
neither a task nor the driver ever holds more of the benchmark than a block. Training text is never shuffled.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import LOWER_ALNUM, Words, give_back, rows_of, settle

#: Words of an index; a longer document has one of its own. Sampled places lie this many words apart.
SHARD_WORDS, SAMPLE = 1 << 18, 16
#: Words of all phrases of a broadcast block: 8 bytes each.
BLOCK_WORDS = 4 << 20


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Sorts all suffixes by doubling: several symbols make the first key, and only suffixes still tied with another
    are sorted again, by the ranks of twice the depth."""
    n = len(symbols)
    bits = max(1, int(symbols.max(initial=0) + 1).bit_length())
    depth = max(1, 62 // bits)
    key = np.zeros(n, np.int64)
    padded = np.concatenate([symbols.astype(np.int64) + 1, np.zeros(depth, np.int64)])
    for k in range(depth):
        key = (key << bits) | padded[k : k + n]
    order = np.argsort(key)
    ordered = key[order]
    new = np.concatenate([[True], ordered[1:] != ordered[:-1]])
    rank_of = np.empty(n + 1, np.int64)
    rank_of[n] = -1
    while True:
        # A group's rank is the place of its first suffix, so groups can be refined one by one.
        heads = np.flatnonzero(new)
        sizes = np.diff(np.append(heads, n))
        rank_of[order] = np.repeat(heads, sizes)
        tied = np.flatnonzero(np.repeat(sizes > 1, sizes))
        if not len(tied):
            return order
        who = order[tied]
        key = (rank_of[who] << 32) | (rank_of[np.minimum(who + depth, n)] + 1)
        again = np.argsort(key)
        order[tied] = who[again]
        ordered = key[again]
        new[tied[1:]] |= ordered[1:] != ordered[:-1]
        depth *= 2


class WaveletMatrix:
    """Ranks of symbols in a sequence: one stable partition by bit for each level, highest bit first."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.bits, self.ones, self.zeros = bits, [], []
        row = symbols.astype(np.int32)
        for b in reversed(range(bits)):
            bit = (row >> b) & 1 == 1
            self.ones.append(np.concatenate([np.zeros(1, np.int32), np.cumsum(bit, dtype=np.int32)]))
            self.zeros.append(len(row) - int(self.ones[-1][-1]))
            row = np.concatenate([row[~bit], row[bit]])

    def rank(self, symbols: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each end."""
        start, end = np.zeros_like(ends), ends
        for k, b in enumerate(reversed(range(self.bits))):
            ones, zeros = self.ones[k], self.zeros[k]
            bit = (symbols >> b) & 1 == 1
            s, e = ones[start], ones[end]
            start, end = np.where(bit, zeros + s, start - s), np.where(bit, zeros + e, end - e)
        return end - start

    def at(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each place, and its rank there."""
        symbol, start, place = np.zeros(len(places), np.int64), np.zeros(len(places), np.int64), places.astype(np.int64)
        zero = np.zeros(len(places), np.int64)
        for k in range(self.bits):
            ones, zeros = self.ones[k], self.zeros[k]
            bit = ones[place + 1] > ones[place]
            symbol = symbol * 2 + bit
            zero = np.where(bit, zeros + ones[zero], zero - ones[zero])
            place = np.where(bit, zeros + ones[place], place - ones[place])
        return symbol, place - zero


class FMIndex:
    """Over documents given as symbols >= 1; symbol 0 ends each document, and the ends sort by place, so no repeat runs
    across one."""

    def __init__(self, symbols: np.ndarray, at: np.ndarray, top: int):
        """symbols: of all documents; document i has at[i] to at[i + 1]; top: the largest symbol possible."""
        n_docs = len(at) - 1
        # In the text each document is followed by its end; a first end stands before the first one.
        self.starts = at[:-1] + np.arange(n_docs) + 1
        self.n = len(symbols) + n_docs + 1
        text = np.zeros(self.n, np.int64)
        where = np.arange(len(symbols)) + np.repeat(np.arange(n_docs), np.diff(at)) + 1
        text[where] = symbols
        unique = text + n_docs
        ends = np.flatnonzero(text == 0)
        unique[ends] = np.arange(len(ends))
        order = suffix_array(unique)
        before = text[order - 1]  # the text's last symbol, an end, stands before its first
        self.waves = WaveletMatrix(before, max(1, int(top).bit_length()))
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=top + 1))])
        # Walks end at sampled places and at each document's start, so they never cross an end.
        keep = (order % SAMPLE == 0) | (before == 0)
        self.sampled = np.concatenate([np.zeros(1, np.int32), np.cumsum(keep, dtype=np.int32)])
        self.place = order[keep]

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The suffix range of each phrase (its symbols in the row's last ``length`` columns; 0: absent from the index)."""
        lo, hi = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        for k in range(1, phrases.shape[1] + 1):
            go = np.flatnonzero((k <= lengths) & (lo < hi))
            if not len(go):
                break
            c = phrases[go, -k]
            both = self.waves.rank(np.tile(c, 2), np.concatenate([lo[go], hi[go]]))
            lo[go], hi[go] = self.first[c] + both[: len(go)], self.first[c] + both[len(go) :]
            hi[go[c == 0]] = lo[go[c == 0]]
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Where in the text the suffixes of these rows begin."""
        rows, steps, out = rows.astype(np.int64), np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
        todo = np.arange(len(rows))
        while len(todo):
            r = rows[todo]
            found = self.sampled[r + 1] > self.sampled[r]
            out[todo[found]] = self.place[self.sampled[r[found]]] + steps[todo[found]]
            todo = todo[~found]
            symbol, rank = self.waves.at(rows[todo])
            rows[todo] = self.first[symbol] + rank
            steps[todo] += 1
        return out


class Shard:
    """The FM-index of some documents, over the words that occur in them."""

    def __init__(self, words: Words):
        self.vocabulary, symbols = np.unique(words.hashes, return_inverse=True)
        self.index = FMIndex(symbols + 1, words.at, len(self.vocabulary))

    def symbols_of(self, hashes: np.ndarray) -> np.ndarray:
        """The symbol of each word, -1 for words that don't occur here."""
        if not len(self.vocabulary):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == hashes, at + 1, -1)


class Phrases:
    """Benchmark phrases: their vocabulary, distinct windows as places in it (from 1; 0 fills short ones), and the items that have each."""

    def __init__(self, items: list[tuple], length: int):
        words = Words([t for _, t in items], LOWER_ALNUM)
        self.ids = [i for i, _ in items]
        self.vocabulary, symbols = np.unique(words.hashes, return_inverse=True)
        wide = np.concatenate([np.zeros(length, np.int64), symbols + 1])
        rows, item = [], []
        for k, (a, b) in enumerate(zip(words.at, words.at[1:], strict=False)):
            if b > a:
                m = min(length, int(b - a))
                starts = np.arange(a, b - m + 1)
                grid = wide[starts[:, None] + np.arange(m - length, m)[None, :] + length]
                grid[:, : length - m] = 0
                rows.append(grid)
                item.append(np.full(len(starts), k))
        grid = np.concatenate(rows) if rows else np.zeros((0, length), np.int64)
        self.symbols, which = np.unique(grid, axis=0, return_inverse=True)
        self.lengths = (self.symbols > 0).sum(1)
        pairs = np.unique(np.stack([which.ravel(), np.concatenate(item)]) if rows else np.zeros((2, 0), np.int64), axis=1)
        self.item_at, self.items = np.searchsorted(pairs[0], np.arange(len(self.symbols) + 1)), pairs[1]

    def hits(self, shard: Shard) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of each occurrence in a shard: document, first word in it, number of words, phrase."""
        local = np.concatenate([[0], shard.symbols_of(self.vocabulary)])[self.symbols]
        here = np.flatnonzero((local >= 0).all(1))
        lo, hi = shard.index.search(local[here], self.lengths[here])
        some = np.flatnonzero(hi > lo)
        n = (hi - lo)[some]
        phrase = np.repeat(here[some], n)
        rows = np.repeat(lo[some], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        place = shard.index.locate(rows)
        doc = np.searchsorted(shard.index.starts, place, side="right") - 1
        return doc, place - shard.index.starts[doc], self.lengths[phrase], phrase


def phrase_blocks(benchmark: DataFrame, length: int, block_words: int):
    """The benchmark's items as blocks of ``Phrases`` of about ``block_words`` words, read to the driver one at a time."""
    items = benchmark.filter("text is not null").select("item_id", "text")
    size = F.coalesce(F.sum((F.octet_length("text") / 2 + 1).cast("long") * length), F.lit(0))
    n = max(1, -(-items.agg(size).first()[0] // block_words))
    block = F.pmod(F.xxhash64("item_id", "text"), F.lit(n))
    for k in range(n):
        yield Phrases([(r.item_id, r.text.encode()) for r in items.filter(block == k).toLocalIterator()], length)


_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def without(text: bytes, spans: list[dict]) -> bytes:
    """The text without the spans (in words), each with what stands between its words; one space is left in place."""
    words = [m.span() for m in _WORD.finditer(text)]
    out, at = [], 0
    for s in spans:
        out.append(text[at : words[s["start"]][0]])
        at = words[s["end"] - 1][1]
    left, rest = b" ".join(x.rstrip(b" ") for x in out), text[at:]
    return left + (b" " if left and rest[:1] not in (b" ", b"\n", b"") else b"") + rest


SPANS = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, items array<string>, spans array<struct<start:int,end:int>>"


def find_contamination(docs: DataFrame, benchmark: DataFrame, length: int = 10, block_words: int = BLOCK_WORDS, carry: list[str] | None = None, cut: bool = False) -> DataFrame:
    """The columns of ``docs`` (with ``cut``, without the spans in text; those in ``carry``, if given) and, of every row: n_words, n_hit (words inside any occurrence), n_items (items with
    occurring windows), items_sha256 (of those item_ids, sorted as strings, joined by commas), contaminated,
    items (those item_ids) and spans (merged, in words, end excluded). Columns of ``docs`` with these names are replaced.

    Null and empty texts and items have no words; an item of fewer than ``length`` words is one phrase; an item without
    an id takes part as an empty id; items and rows that repeat count once each by id and row. Empty tables are fine.
    Words are compared by 64-bit hashes. Extra columns pass through.
    """
    spark = docs.sparkSession
    made = [c.split()[0] for c in SPANS.split(", ")]
    kept = docs.select(*(c for c in (docs.columns if carry is None else carry) if c not in made))
    rows, found = docs.select(*kept.columns, docs["text"].alias(_TEXT)), None
    for phrases in phrase_blocks(benchmark, length, block_words):
        if found is not None:
            rows = settle(found).withColumnsRenamed({"items": _ITEMS, "spans": _SEEN}).drop(*made)
        block = spark.sparkContext.broadcast(phrases)  # about 8 * block_words bytes
        found = rows.mapInArrow(_searcher(block, kept.columns, _SEEN in rows.columns), ", ".join(f"`{c.replace('`', '``')}` {k}" for c, k in (*kept.dtypes, (_TEXT, "string"))) + ", " + SPANS)
    names = [c for c in kept.columns if not (cut and c == "text")]
    out = found.select(*names, *([F.col(_TEXT).alias("text")] if cut and "text" in kept.columns else []), *made)
    if cut:
        out = out.mapInArrow(_cut, out.schema)
    return out.select(*kept.columns, *made)


_TEXT, _ITEMS, _SEEN = "__quern_text", "__quern_items", "__quern_spans"


def _shards(batches):
    """Tables of about SHARD_WORDS words each, in the order of the rows."""
    held, size = [], 0
    for batch in batches:
        first = 0
        for i, n in enumerate(pc.binary_length(batch.column(_TEXT)).to_pylist()):
            size += (n or 0) // 5 + 1
            if size >= SHARD_WORDS:
                held.append(batch.slice(first, i + 1 - first))
                yield pa.Table.from_batches(held)
                held, size, first = [], 0, i + 1
        if first < batch.num_rows:
            held.append(batch.slice(first))
    if held:
        yield pa.Table.from_batches(held)


def _searcher(block, kept: list[str], again: bool):
    """A pass over the documents with one block of phrases; ``again``: rows bring the items and spans of passes before."""

    def search(rows: pa.Table) -> pa.Table:
        words = Words(rows_of(rows, _TEXT), LOWER_ALNUM)
        n = rows.num_rows
        items: list[set] = [set(x or ()) for x in rows.column(_ITEMS).to_pylist()] if again else [set() for _ in range(n)]
        change = np.zeros(len(words.hashes) + n + 1, np.int64)  # a gap after each document
        at = words.at[:-1] + np.arange(n)
        for d, own in enumerate(rows.column(_SEEN).to_pylist() if again else ()):
            for s in own or ():
                change[at[d] + s["start"]] += 1
                change[at[d] + s["end"]] -= 1
        p = block.value
        doc, start, size, phrase = p.hits(Shard(words))
        np.add.at(change, at[doc] + start, 1)
        np.add.at(change, at[doc] + start + size, -1)
        pairs = np.unique(np.stack([doc, phrase]), axis=1)
        for d, f in pairs.T.tolist():
            items[d].update("" if p.ids[i] is None else str(p.ids[i]) for i in p.items[p.item_at[f] : p.item_at[f + 1]])
        hit = np.cumsum(change)[:-1] > 0
        edge = np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))
        starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        owner = np.searchsorted(at, starts, side="right") - 1
        spans: list[list] = [[] for _ in range(n)]
        for d, s, e in zip(owner.tolist(), (starts - at[owner]).tolist(), (ends - at[owner]).tolist(), strict=True):
            spans[d].append({"start": s, "end": e})
        n_hit = [sum(s["end"] - s["start"] for s in x) for x in spans]
        names = [sorted(x) for x in items]
        out = rows.select([*kept, _TEXT])
        for name, column in (
            ("n_words", pa.array(np.diff(words.at), pa.int64())), ("n_hit", pa.array(n_hit, pa.int64())), ("n_items", pa.array([len(x) for x in names], pa.int64())),
            ("items_sha256", pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in names], pa.string())), ("contaminated", pa.array([x > 0 for x in n_hit], pa.bool_())),
            ("items", pa.array(names, pa.list_(pa.string()))), ("spans", pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))),
        ):
            out = out.append_column(name, column)
        return out

    def run(batches):
        for rows in _shards(batches):
            yield from search(rows).combine_chunks().to_batches()
        give_back()

    return run


def _cut(batches):
    """Takes the spans out of the texts."""
    for batch in batches:
        texts = [without(t, own) if own else t for t, own in zip(rows_of(batch, "text"), batch.column("spans").to_pylist(), strict=True)]
        yield batch.set_column(batch.schema.get_field_index("text"), "text", pa.array(texts, pa.binary()).cast(batch.schema.field("text").type))


def remove_contamination(docs: DataFrame, benchmark: DataFrame, length: int = 10) -> DataFrame:
    """``docs`` without the benchmark's passages in text (n_chars, if there, follows); a document that held some and of which no word is left
    goes. Clean rows, empty and null ones among them, stay as they are."""
    found = find_contamination(docs, benchmark, length, cut=True).filter("not contaminated or n_hit < n_words")
    made = found.select(*docs.columns, "contaminated")
    if "n_chars" in docs.columns:
        made = made.withColumn("n_chars", F.when(F.col("contaminated"), F.length("text")).otherwise(F.col("n_chars")).cast(dict(docs.dtypes)["n_chars"]))
    return made.select(*docs.columns)
