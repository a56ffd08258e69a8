"""Toxicity: a bidirectional gated recurrent network with attention pooling over character and word inputs, in numpy.

A word is a character network's pooled state (a BiGRU over its UTF-8 bytes) beside an embedding of its hash; a second BiGRU
reads the words of a text both ways; attention pools its states over a window of WINDOW words, and a logistic head scores
the window. A document's score comes from its highest window: all overlapping windows of the whole text, one from every word
on, are scored, so neither length nor where a passage stands hides anything. They share the recurrence: a word's state is
computed once each way, from CONTEXT words or more before it, and windows pool the states they cover.

Training takes labelled documents within ``Bounds``. Which words make a document toxic isn't labelled, so byte n-grams and words that
occur in toxic documents far more than chance allows (an exponential bound on the binomial tail, divided by the number tried)
mark words; the character network learns those first, the word network windows with them. Then the documents' own labels
train the word network: the highest window of every document has its label, in some rounds; and they fit the last scale and offset.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from itertools import islice
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .recurrent import F4, Adam, GRUAttention, sigmoid
from .shared import give_back, mix64, pieces, rows_of, windows

#: Words of a window (a power of two); words of a block whose states are computed together, and around it for context.
WINDOW, SPAN, CONTEXT = 32, 160, 16
#: Blocks that are computed together.
BATCH = 512
#: From one training window's start to the next.
STRIDE = 24
#: Bytes of a word that the character network reads at once; longer words become overlapping pieces.
PIECE = 24
BUCKETS, WORD_DIM, BYTE_DIM, CHAR_HIDDEN, WORD_HIDDEN = 4096, 8, 8, 10, 8


class Bounds(NamedTuple):
    """What training takes at most. Documents are chosen by a hash of their id, words by a hash, windows at random."""

    documents: int = 1500  #: labelled documents of each kind
    text_bytes: int = 64 << 20  #: of all of them
    frequent_words: int = 1000  #: of clean documents, the most frequent ones
    plain_words: int = 5000  #: others of clean documents
    tried_words: int = 60_000  #: of clean documents, among which those most like toxic ones are looked for
    hard_words: int = 2000  #: of these, in each of two rounds
    toxic_windows: int = 3000
    clean_windows: int = 20_000  #: among which the hardest are looked for
    first_windows: int = 5000  #: of these, before that
    hard_windows: int = 2000


#: Distinct words whose inputs a task remembers.
MEMORY = 80_000

_TABLE = bytes(32 if b < 128 and not chr(b).isalnum() else b + 32 if 65 <= b <= 90 else b for b in range(256))
_LONG = re.compile(rb"\S{%d,}" % (PIECE + 1))


def tokens(text: bytes) -> list[bytes]:
    """Lower-cased (A-Z) runs of ASCII letters and digits and bytes beyond; long ones as overlapping pieces."""
    clean = text.translate(_TABLE)
    words = clean.split()
    if _LONG.search(clean):
        words = [p for w in words for p in ([w] if len(w) <= PIECE else [w[i : i + PIECE] for i in range(0, len(w) - PIECE // 2, PIECE // 2)])]
    return words


def _bucket(word: bytes) -> int:
    return zlib.crc32(word) % BUCKETS


class Model:
    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.byte = (rng.normal(size=(256, BYTE_DIM)) * 0.3).astype(F4)
        self.chars = GRUAttention(BYTE_DIM, CHAR_HIDDEN, seed)
        self.char_head = {"w": np.zeros(2 * CHAR_HIDDEN, F4), "b": np.zeros(1, F4)}
        self.embed = np.zeros((BUCKETS, WORD_DIM), F4)
        self.words = GRUAttention(2 * CHAR_HIDDEN + WORD_DIM, WORD_HIDDEN, seed + 1)
        self.head = {"w": np.zeros(2 * WORD_HIDDEN, F4), "b": np.zeros(1, F4)}
        self.scale, self.offset, self.prior = 1.0, 0.0, None

    # ---- words

    @staticmethod
    def _bytes(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Byte codes (0: none) and mask, steps x words."""
        grid = np.array(words, dtype=f"S{max(map(len, words))}")
        grid = np.ascontiguousarray(grid.view(np.uint8).reshape(len(words), -1).T)
        return grid, (grid > 0).astype(F4)

    def char_vectors(self, words: list[bytes]) -> np.ndarray:
        out = np.zeros((len(words), 2 * CHAR_HIDDEN), F4)
        table = self.chars.project(self.byte)
        order = np.argsort([len(w) for w in words], kind="stable")
        for a in range(0, len(order), 1024):
            part = order[a : a + 1024]
            grid, mask = self._bytes([words[i] for i in part])
            out[part] = self.chars.run(table[grid], mask)
        return out

    def inputs(self, words: list[bytes], vectors: np.ndarray | None = None) -> np.ndarray:
        vectors = self.char_vectors(words) if vectors is None else vectors
        return np.concatenate([vectors, self.embed[[_bucket(w) for w in words]]], 1)

    # ---- windows

    def window_logits(self, projected: np.ndarray, mask: np.ndarray) -> np.ndarray:
        return self.words.run(projected, mask) @ self.head["w"] + self.head["b"]


def window_starts(n: int) -> np.ndarray:
    """Starts of training windows: every word is in one."""
    return np.arange(0, max(1, n - WINDOW + STRIDE), STRIDE)


class _Numbers(dict):
    """Numbers new words as they come."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


class Scorer:
    """The highest window's logit of each text."""

    def __init__(self, model: Model):
        self.model, self.known = model, _Numbers()
        self.table = np.zeros((0, 6 * WORD_HIDDEN), F4)

    def _ids(self, words: list[bytes]) -> np.ndarray:
        if len(self.known) > MEMORY:
            self.known.clear()
            self.table = self.table[:0]
        ids = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        if len(self.known) > len(self.table):
            new = list(islice(self.known, len(self.table), None))
            self.table = np.concatenate([self.table, self.model.words.project(self.model.inputs(new))])
        return ids

    def __call__(self, texts: list[bytes | None]) -> np.ndarray:
        return self.best([tokens(t or b"") for t in texts])[0]

    def best(self, texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
        """The highest window's logit (-inf without words) and its first word, of each text given as words."""
        out, first = np.full(len(texts), -np.inf), np.zeros(len(texts), np.int64)
        group, size = [], 0
        for i, w in enumerate(texts):
            group += [i] if w else []
            size += len(w)
            if group and (size > 100_000 or i == len(texts) - 1):
                out[group], first[group] = self._best([texts[k] for k in group])
                group, size = [], 0
        return out, first

    def states(self, ids: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The word network's state at each word; text i has the words at[i] to at[i + 1]. A text is read in blocks of SPAN words,
        each from CONTEXT words before it on, and backwards from CONTEXT words after it."""
        sizes = np.diff(at)
        per = -(-sizes // SPAN)
        owner = np.repeat(np.arange(len(sizes)), per)
        a = at[owner] + (np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per)) * SPAN
        b = np.minimum(a + SPAN, at[owner + 1])
        lo, hi = np.maximum(a - CONTEXT, at[owner]), np.minimum(b + CONTEXT, at[owner + 1])
        out = np.zeros((len(ids), 2 * WORD_HIDDEN), F4)
        order = np.argsort(hi - lo, kind="stable")
        for k in range(0, len(order), BATCH):
            pick = order[k : k + BATCH]
            place = lo[pick] + np.arange((hi - lo)[pick].max())[:, None]
            states = self.model.words.states(self.table[ids[np.minimum(place, len(ids) - 1)]], (place < hi[pick]).astype(F4))
            own = (place >= a[pick]) & (place < b[pick])
            out[place[own]] = states[own]
        return out

    def _best(self, texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
        sizes = np.array([len(w) for w in texts])
        at = np.concatenate([[0], np.cumsum(sizes)])
        states = self.states(self._ids([w for t in texts for w in t]), at)
        # Texts laid out with at least WINDOW places each; weights and weighted states are summed over WINDOW places by doubling.
        room = np.maximum(sizes, WINDOW)
        start = np.concatenate([[0], np.cumsum(room)])
        weight = self.model.words.attention(states)
        weight = np.exp(weight - weight.max())
        sums = np.zeros((start[-1], 1 + 2 * WORD_HIDDEN), F4)
        place = np.arange(at[-1]) + np.repeat(start[:-1] - at[:-1], sizes)
        sums[place, 0] = weight
        sums[place, 1:] = weight[:, None] * states
        step = 1
        while step < WINDOW:
            sums[:-step] += sums[step:].copy()
            step *= 2
        logit = (sums[:, 1:] @ self.model.head["w"]) / np.maximum(sums[:, 0], 1e-37) + self.model.head["b"]
        owner = np.repeat(np.arange(len(room)), room)
        logit[np.arange(len(logit)) > (start[1:] - WINDOW)[owner]] = -np.inf  # these windows would pass the text's end
        best = np.maximum.reduceat(logit, start[:-1])
        hit = np.flatnonzero(logit == best[owner])
        return best, hit[np.searchsorted(hit, start[:-1])] - start[:-1]


# ---------------------------------------------------------------- training

def _grams(word: bytes) -> set[bytes]:
    w = b"^" + word + b"$"
    return {w[i : i + n] for n in (4, 5, 6) for i in range(len(w) - n + 1)} | {w}


def marked_words(docs: list[list[bytes]], toxic: np.ndarray, purity: float) -> set[bytes]:
    """The words with a byte n-gram (or that are a word) found in toxic documents far beyond chance, and of all
    documents in toxic ones to more than ``purity``."""
    seen: dict = {True: Counter(), False: Counter()}
    for words, t in zip(docs, toxic, strict=True):
        seen[bool(t)].update(set(words))
    counts = {True: Counter(), False: Counter()}
    total = {True: 0, False: 0}
    for t, own in seen.items():  # toxic documents first
        for w, n in own.items():
            grams = _grams(w)
            total[t] += n * len(grams)
            for g in grams if t else grams & counts[True].keys():
                counts[t][g] += n
    p = total[True] / max(1, total[True] + total[False])
    if not 0 < p < 1:
        return set()
    limit = math.log(0.01 / max(1, len(counts[True])))
    strong = set()
    for g, k in counts[True].items():
        n = k + counts[False][g]
        q = k / n
        if q > max(purity, p) and k >= 4:
            divergence = q * math.log(q / p) + ((1 - q) * math.log((1 - q) / (1 - p)) if q < 1 else 0)
            if -n * divergence < limit:
                strong.add(g)
    return {w for w, n in seen[True].items() if _grams(w) & strong and seen[False][w] <= (1 - purity) * n}


def _epochs(n: int, batch: int, epochs: int, rng):
    for _ in range(epochs):
        order = rng.permutation(n)
        yield from (order[i : i + batch] for i in range(0, n, batch))


def _apart(docs: list[list[bytes]]) -> list[int]:
    """Places of documents that aren't near copies of an earlier one: they share none of 16 least hashes of 4 words."""
    seen, keep = set(), []
    salts = mix64(np.arange(16, dtype=np.uint64))
    for i, words in enumerate(docs):
        grams = windows(np.array([zlib.crc32(w) for w in words], np.uint64), 4)
        keys = set(zip(range(16), mix64(grams[None, :] ^ salts[:, None]).min(1).tolist(), strict=True)) if len(grams) else set()
        if not keys & seen:
            keep.append(i)
        seen |= keys
    return keep


def _fit_words(model: Model, words: list[bytes], target: np.ndarray, epochs: int, rng) -> None:
    params = {"byte": model.byte} | {f"c.{k}": v for k, v in model.chars.p.items()} | {f"h.{k}": v for k, v in model.char_head.items()}
    adam = Adam(params, 0.01)
    for pick in _epochs(len(words), 256, epochs, rng):
        grid, mask = model._bytes([words[i] for i in pick])
        x, keep = model.byte[grid], []
        pooled = model.chars.run(model.chars.project(x), mask, keep)
        d = (sigmoid(pooled @ model.char_head["w"] + model.char_head["b"]) - target[pick]) / len(pick)
        grads, d_proj = model.chars.back(keep, d[:, None] * model.char_head["w"])
        more, d_x = model.chars.back_project(x, d_proj)
        d_byte = np.zeros_like(model.byte)
        np.add.at(d_byte, grid.ravel(), d_x)
        adam.step({"byte": d_byte, "h.w": pooled.T @ d, "h.b": d.sum().reshape(1)} | {f"c.{k}": v for k, v in (grads | more).items()})


def _fit_windows(model: Model, samples: list[list[bytes]], target: np.ndarray, epochs: int, rng) -> None:
    distinct = {w: i for i, w in enumerate(dict.fromkeys(w for x in samples for w in x))}
    vectors = model.char_vectors(list(distinct))
    buckets = np.array([_bucket(w) for w in distinct])
    params = {"embed": model.embed} | {f"g.{k}": v for k, v in model.words.p.items()} | {f"h.{k}": v for k, v in model.head.items()}
    adam = Adam(params, 0.01)
    for pick in _epochs(len(samples), 256, epochs, rng):
        ids = np.zeros((WINDOW, len(pick)), np.int64)
        mask = np.zeros((WINDOW, len(pick)), F4)
        for j, i in enumerate(pick):
            ids[: len(samples[i]), j] = [distinct[w] for w in samples[i]]
            mask[: len(samples[i]), j] = 1
        x, keep = np.concatenate([vectors[ids], model.embed[buckets[ids]]], 2), []
        pooled = model.words.run(model.words.project(x), mask, keep)
        d = (sigmoid(pooled @ model.head["w"] + model.head["b"]) - target[pick]) / len(pick)
        grads, d_proj = model.words.back(keep, d[:, None] * model.head["w"])
        more, d_x = model.words.back_project(x, d_proj)
        d_embed = np.zeros_like(model.embed)
        np.add.at(d_embed, buckets[ids].ravel(), d_x[:, 2 * CHAR_HIDDEN :])
        adam.step({"embed": d_embed, "h.w": pooled.T @ d, "h.b": d.sum().reshape(1)} | {f"g.{k}": v for k, v in (grads | more).items()})


def _sample(items: list, most: int, rng) -> list:
    return [items[i] for i in rng.permutation(len(items))[:most]]


def _learn_words(model: Model, docs: list, toxic: np.ndarray, marked: set, bounds: Bounds, rng) -> None:
    """The character network learns which words are marked; then again with the unmarked words that look most like them."""
    clean = Counter(w for d, t in zip(docs, toxic, strict=True) if not t for w in d if w not in marked)
    plain = sorted(clean, key=zlib.crc32)
    first = sorted(marked) * max(1, 2000 // len(marked))
    others = [w for w, _ in clean.most_common(bounds.frequent_words)] + plain[: bounds.plain_words]

    def fit(epochs: int) -> None:
        _fit_words(model, first + others, np.array([1.0] * len(first) + [0.0] * len(others), F4), epochs, rng)

    fit(8)
    tried = plain[: bounds.tried_words]
    for _ in range(2 if tried else 0):
        scores = model.char_vectors(tried) @ model.char_head["w"]
        others += [tried[i] for i in np.argsort(-scores, kind="stable")[: bounds.hard_words]]
        fit(4)


def _learn_windows(model: Model, docs: list, toxic: np.ndarray, marked: set, bounds: Bounds, rng) -> None:
    """The word network learns windows of toxic documents with a marked word (all, where no words are marked) against those of clean
    ones, then again with the hardest of these, then every document's highest window by the document's label."""
    bad, good = [], []
    for words_of, t in zip(docs, toxic, strict=True):
        if t and marked:
            starts = [max(0, k - int(rng.integers(WINDOW))) for k, w in enumerate(words_of) if w in marked]
            bad += [words_of[a : a + WINDOW] for a in starts]
        elif words_of:
            (bad if t else good).extend(words_of[a : a + WINDOW] for a in window_starts(len(words_of)))
    bad, good = _sample(bad, bounds.toxic_windows, rng), _sample(good, bounds.clean_windows, rng)

    def fit(more_bad: list, some: list, epochs: int) -> None:
        samples = bad + more_bad + some
        _fit_windows(model, samples, np.array([1.0] * (len(samples) - len(some)) + [0.0] * len(some), F4), epochs, rng)

    some = good[: bounds.first_windows]
    fit([], some, 3)
    scores = Scorer(model).best(good)[0]
    some = some + [good[i] for i in np.argsort(-scores, kind="stable")[: bounds.hard_windows]]
    fit([], some, 2)
    for _ in range(2):
        start = Scorer(model).best(docs)[1]
        top = [(d[a : a + WINDOW], t) for d, a, t in zip(docs, start, toxic, strict=True) if d]
        fit([w for w, t in top if t], some + [w for w, t in top if not t], 1)


def train(texts: list[bytes], labels: np.ndarray, seed: int = 7, bounds: Bounds = Bounds()) -> Model:
    """A model fitted to whole labelled texts; without labels of both kinds there is nothing to learn."""
    model, rng = Model(seed), np.random.default_rng(seed)
    same: dict = {}
    docs = [[same.setdefault(w, w) for w in tokens(t)] for t in texts]  # one object for each distinct word
    del same
    toxic = np.asarray(labels) > 0
    model.prior = float(toxic.mean()) if len(toxic) else 0.0
    if not any(d for d, t in zip(docs, toxic, strict=True) if t) or not any(d for d, t in zip(docs, toxic, strict=True) if not t):
        return model
    apart = _apart(docs)
    marked = marked_words([docs[i] for i in apart], toxic[apart], 0.95)
    open_ = [i for i in apart if not (toxic[i] and marked & set(docs[i]))]  # toxic documents that these words don't explain
    marked |= marked_words([docs[i] for i in open_], toxic[open_], 0.7)
    if marked:
        _learn_words(model, docs, toxic, marked, bounds, rng)
    _learn_windows(model, docs, toxic, marked, bounds, rng)
    # The scale and offset of the highest window's logit, classes weighted alike.
    top = Scorer(model).best(docs)[0]
    some = np.isfinite(top)
    y, x = toxic[some].astype(float), np.clip(top[some], -12, 12)
    weight = np.where(y > 0, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum()))
    a, b = 1.0, 0.0
    for _ in range(300):
        d = (sigmoid(a * x + b) - y) * weight
        a, b = max(0.05, a - 0.5 * (d * x).sum()), b - 2.0 * d.sum()
    model.scale, model.offset = a, b
    return model


def probability(model: Model, top: np.ndarray) -> np.ndarray:
    """Scores from the highest windows' logits; without words as of the lowest logit, without a trained network the share of toxic labels."""
    if not model.head["w"].any():
        return np.full(len(top), min(0.49, model.prior or 0.0))
    return sigmoid(model.scale * np.clip(np.where(np.isfinite(top), top, -12), -12, 12) + model.offset)


# ---------------------------------------------------------------- on Spark

def labelled_sample(docs: DataFrame, labels: DataFrame, bounds: Bounds = Bounds()) -> DataFrame:
    """text and toxic of at most ``bounds.documents`` documents of each label and ``bounds.text_bytes`` altogether, chosen by a hash of
    doc_id; of rows that repeat an id, the one with the least text. An id with both labels is toxic."""
    known = labels.filter("toxic in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = F.xxhash64("doc_id", F.lit(3))
    chosen = [known.filter(F.col("toxic") == t).orderBy(order, "doc_id").limit(bounds.documents) for t in (0, 1)]
    picked = F.broadcast(chosen[0].union(chosen[1]))  # at most 2 * documents rows of two numbers
    rows = docs.select("doc_id", "text").filter("text is not null").join(picked, "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    upto = F.sum(F.octet_length("text")).over(Window.orderBy(order, "doc_id"))  # over those rows alone
    return rows.withColumn("upto", upto).filter(F.col("upto") <= bounds.text_bytes).select("text", "toxic")


def fit(docs: DataFrame, labels: DataFrame, bounds: Bounds = Bounds()) -> Model:
    rows = labelled_sample(docs, labels, bounds).collect()
    texts, toxic = [r.text.encode() for r in rows], np.array([r.toxic for r in rows])
    del rows
    model = train(texts, toxic, bounds=bounds)
    del texts
    give_back()
    return model


def held_out():
    """Whether a row is kept from training: crc32 of doc_id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def score_documents(docs: DataFrame, model: Model, carry: list[str] | None = None) -> DataFrame:
    """The columns of ``docs`` (those in ``carry``, if given; score and predicted are replaced) and score (0 to 1)
    and predicted (1 from 0.5 on).

    Only the text is read for a score, all of it. Null and empty texts score as the lowest possible window. Repeated rows
    score alike. Without labelled texts of both kinds there is nothing to learn, and all score the smaller of 0.49 and the share of toxic
    labels. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)  # a few hundred kB whatever the corpus
    kept = [c for c in (docs.columns if carry is None else carry) if c not in ("score", "predicted")]

    def run(batches):
        scorer = Scorer(shared.value)
        for batch in pieces(batches, "__quern_text"):
            score = probability(shared.value, scorer(rows_of(batch, "__quern_text"))).astype(np.float64)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(kept))), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], names=[*kept, "score", "predicted"])
        del scorer
        give_back()

    types = dict(docs.dtypes)
    return docs.select(*kept, docs["text"].alias("__quern_text")).mapInArrow(run, ", ".join([*(f"`{c}` {types[c]}" for c in kept), "score double, predicted int"]))
