"""HTML extraction by a recurrent block labeller.

A page becomes its sequence of blocks: the text between two block-level tags, with the path of elements that hold
it. Each block is a vector (hashed parts of its tag path, hashed words, a few measures), and a bidirectional LSTM in
numpy reads all blocks of the page both ways and labels each as main text or not, so that a block is judged by what
surrounds it.

Nothing labels blocks, so training makes its own: pages drawn from templates whose parts are known (articles in various
containers amid menus, headers, notices, adverts, forms, sidebars, comments, footers), filled with words of the table's own pages,
and at most ``most_pages`` real pages of ``most_bytes`` altogether, chosen by a hash, whose blocks are labelled where their containers' names
leave no doubt. Those that do leave doubt have no part in the loss.
"""

from __future__ import annotations

import html as entities
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .recurrent import F4, Adam, BiLSTM, sigmoid
from .shared import LOWER_ALNUM, Words, pieces, rows_of

# Elements of the HTML standard by their part in a page.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html "
    "legend li main menu nav ol p pre search section summary table tbody td tfoot th thead title tr ul".split()
)
RAW = frozenset("script style textarea".split())
#: In the midst of text, with text of their own for the labeller to judge. They end no paragraph unless they hold text.
PARTS = frozenset("template noscript iframe svg object select button canvas audio video".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SINGLE = frozenset("p li dd dt tr td th h1 h2 h3 h4 h5 h6".split())
SPACE = re.compile("[\x20\x09-\x0d]+")

_OPEN = re.compile(r"<(?:(!--)|(!\[CDATA\[)|([!?])|(/?)([a-zA-Z][a-zA-Z0-9:-]*))")
_STOP = re.compile(r">|=[\x20\x09-\x0d]*([\"'])")
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
_PART = re.compile(r"[a-z]+")


class Tags:
    """The tags of a page, found one after another in time linear in its length."""

    def __init__(self, page: str):
        self.page, self.last = page, {q: page.rfind(q) for q in "\"'"}

    def end(self, at: int) -> int:
        """Where a tag ends whose attributes begin at ``at``: behind the first > outside quoted values. A quote that is never closed is
        an ordinary character, so it hides nothing; without any > the tag ends with the page."""
        while stop := _STOP.search(self.page, at):
            quote = stop[1]
            if quote is None:
                return stop.end()
            at = self.page.find(quote, stop.end()) + 1 if stop.end() <= self.last[quote] else stop.end()
        return len(self.page)

    def _past(self, mark: str, at: int) -> int:
        found = self.page.find(mark, at)
        return len(self.page) if found < 0 else found + len(mark)

    def next(self, at: int) -> tuple[int, int, bool, str, str] | None:
        """(start, end, whether an end tag, name, attributes) of the next tag; comments and the like have no name."""
        tag = _OPEN.search(self.page, at)
        if tag is None:
            return None
        if tag[1] or tag[2] or tag[3]:
            return tag.start(), self._past("-->" if tag[1] else "]]>" if tag[2] else ">", tag.end()), False, "", ""
        end = self.end(tag.end())
        return tag.start(), end, bool(tag[4]), tag[5].lower(), self.page[tag.end() : end]


class Path:
    """The open elements, by what is known of each: its name, then words of its class, id and role."""

    def __init__(self):
        self.elements: list[str] = []
        self.open: Counter = Counter()
        self._kept: tuple | None = None

    def names(self) -> str:
        return self.elements[-1].split(" ", 1)[0] if self.elements else ""

    def push(self, element: str) -> None:
        self.elements.append(element)
        self.open[element.split(" ", 1)[0]] += 1
        self._kept = None

    def pop(self) -> str:
        name = self.elements.pop().split(" ", 1)[0]
        self.open[name] -= 1
        self._kept = None
        return name

    def close(self, name: str) -> None:
        """Closes the innermost element of this name with all in it; nothing, if none is open."""
        while self.open[name] and self.pop() != name:
            pass

    def now(self) -> tuple:
        if self._kept is None:
            self._kept = tuple(self.elements)
        return self._kept


def blocks(page: str) -> list[tuple[tuple, str, int]]:
    """(path, text, characters of it in links) of each block that has text, in page order."""
    out: list[tuple[tuple, str, int]] = []
    path, tags = Path(), Tags(page)
    held: list[str] = []
    spot: list[tuple] = []  # the path of the text in held, once there is any but white space
    state = [0, 0]  # open links, link characters
    ends: dict[str, int] = {}  # the next end tag of each part, found when last looked for

    def flush() -> None:
        if held:
            text = SPACE.sub(" ", entities.unescape("".join(held))).strip(" ")
            if text:
                out.append((spot[0] if spot else path.now(), text, state[1]))
            held.clear()
            spot.clear()
        state[1] = 0

    def say(text: str) -> None:
        if text:
            if not text.isspace():
                here = path.now()
                if spot and spot[0] is not here and spot[0] != here:
                    flush()
                if not spot:
                    spot.append(here)
            held.append(text)
            if state[0]:
                state[1] += len(text)

    at = 0
    while tag := tags.next(at):
        start, end, closing, name, attributes = tag
        say(page[at:start])
        at = end
        alone = attributes.endswith("/>")
        if closing:
            if name == "a":
                state[0] = 0
            elif name in BLOCKS:
                flush()
                path.close(name)
            elif name in PARTS:
                held.append(" ")
                path.close(name)
        elif name in RAW:
            if not alone:
                close = re.compile(rf"</{re.escape(name)}\b[^>]*(?:>|\Z)", re.I).search(page, at)
                at = close.end() if close else len(page)
            held.append(" ")
        elif name in PARTS:
            held.append(" ")
            if ends.get(name, -1) < at:
                close = re.compile(rf"</{name}\b", re.I).search(page, at)
                ends[name] = close.start() if close else len(page) + 1
            if ends[name] <= len(page) and not alone:  # without an end tag, only the tag itself is ignored
                path.push(name)
        elif name in BLOCKS:
            flush()
            top = path.names()
            if top == "p" or (top == name and name in SINGLE) or (top == "head" and name == "body"):
                path.pop()
            if name not in VOID:
                words = " ".join(w for m in _NAMES.finditer(attributes) for w in _PART.findall(m[1].lower()))
                path.push(f"{name} {words}".strip())
        elif name == "br":
            held.append(" ")
        elif name == "a":
            state[0] = 1
    say(page[at:])
    flush()
    return out


# ---------------------------------------------------------------- vectors

PATH_DIM, WORD_DIM, MEASURES = 96, 24, 8
INPUTS = PATH_DIM + WORD_DIM + MEASURES


def _add(vector: np.ndarray, feature: str, weight: float = 1.0) -> None:
    h = zlib.crc32(feature.encode())
    vector[h % PATH_DIM] += weight if h & 0x10000 else -weight


def path_vector(path: tuple) -> np.ndarray:
    """Every element's parts, and once more those of the innermost three."""
    v = np.zeros(PATH_DIM, F4)
    for k, element in enumerate(path):
        for part in set(element.split()):
            _add(v, part)
            if k >= len(path) - 3:
                _add(v, f"near {part}", 0.5)
    return v


class Vectors:
    """Block vectors; remembers those of paths."""

    def __init__(self):
        self.paths: dict[tuple, np.ndarray] = {}

    def __call__(self, page: list[tuple[tuple, str, int]]) -> np.ndarray:
        return self.many([page])[0]

    def many(self, pages: list[list]) -> list[np.ndarray]:
        flat = [b for p in pages for b in p]
        x = np.zeros((len(flat), INPUTS), F4)
        words = Words([b[1].encode() for b in flat], LOWER_ALNUM)
        counts = np.diff(words.at)
        owner = np.repeat(np.arange(len(flat)), counts)
        sign = np.where(words.hashes & np.uint64(1 << 20), 1.0, -1.0)
        bag = np.bincount(owner * WORD_DIM + (words.hashes % np.uint64(WORD_DIM)).astype(np.int64), weights=sign, minlength=len(flat) * WORD_DIM)
        x[:, PATH_DIM : PATH_DIM + WORD_DIM] = bag.reshape(-1, WORD_DIM) / np.sqrt(np.maximum(counts, 1))[:, None] * 0.3
        if len(self.paths) > 50_000:
            self.paths.clear()
        k = 0
        out = []
        for p in pages:
            for i, (path, text, linked) in enumerate(p):
                if path not in self.paths:
                    self.paths[path] = path_vector(path)
                x[k, :PATH_DIM] = self.paths[path]
                n = len(text)
                stops = text.count(".") + text.count("!") + text.count("?")
                x[k, -MEASURES:] = (np.log1p(n) / 6, min(1.0, linked / n), min(4, stops) / 4, i / len(p), 1 - (i + 1) / len(p), min(1.0, np.log1p(counts[k]) / 5), 20 * (text.count(",") / n), 1.0)
                k += 1
            out.append(x[k - len(p) : k])
        return out


# ---------------------------------------------------------------- training pages

# Names that pages give to containers of main text and of other parts.
MAIN_NAMES = ("article", "content", "post", "entry", "story", "body", "text", "main")
OTHER_NAMES = {
    "menu": ("nav", "menu", "navbar", "breadcrumb", "navigation", "topbar"),
    "header": ("header", "masthead", "banner", "logo", "site header"),
    "footer": ("footer", "copyright", "site footer", "colophon"),
    "side": ("sidebar", "aside", "related", "widget", "side", "recommended", "tags", "trending", "popular"),
    "notice": ("notice", "cookie", "consent", "gdpr", "alert", "notification", "popup", "modal", "newsletter", "subscribe", "disclaimer"),
    "advert": ("ad", "ads", "advert", "advertisement", "sponsor", "sponsored", "promo", "promotion"),
    "form": ("form", "search", "login", "signup", "contact"),
    "comments": ("comments", "comment", "reply", "replies", "discussion", "responses", "disqus", "reader comments"),
    "share": ("share", "social", "toolbar", "byline meta"),
}
_DOUBTLESS = {w for names in OTHER_NAMES.values() for n in names for w in n.split() if w not in ("site", "meta", "reader", "header")} | {"form", "footer", "aside", "nav", "head", "title"}


def made_page(rng, lexicon: list[str]) -> tuple[list, np.ndarray]:
    """Blocks of a page from a random template, and which are main text."""
    words = lambda n: " ".join(lexicon[i] for i in rng.integers(0, len(lexicon), n))
    page: list[tuple[str, bool]] = []
    parts, own = sorted(PARTS), rng.spawn(1)[0]

    def sentence(least: int, most: int) -> str:
        text = words(int(rng.integers(least, most)))
        return (text[:1].upper() + text[1:] + ".") if rng.random() < 0.8 else text

    def other(kind: str, tag: str | None = None) -> str:
        name = OTHER_NAMES[kind][rng.integers(len(OTHER_NAMES[kind]))]
        semantic = {"menu": "nav", "header": "header", "footer": "footer", "side": "aside", "form": "form", "comments": "section"}.get(kind, "div")
        tag = semantic if rng.random() < 0.5 else ("div", "section", "ul" if kind in ("menu", "side") else "div")[rng.integers(3)]
        attribute = "" if tag in ("nav", "header", "footer", "aside", "form") and rng.random() < 0.6 else f' {"class" if rng.random() < 0.7 else "id"}="{name.replace(" ", "-" if rng.random() < 0.5 else " ")}"'
        if kind in ("menu", "share") or (kind == "side" and rng.random() < 0.4):
            inner = "<ul>" * (tag != "ul") + "".join(f'<li><a href="/x">{words(int(rng.integers(1, 4)))}</a></li>' for _ in range(rng.integers(2, 9))) + "</ul>" * (tag != "ul")
        elif kind == "form":
            inner = "".join(f"<label>{words(2)}</label><input name=x>" for _ in range(rng.integers(1, 4))) + f"<p>{sentence(2, 12)}</p>" * int(rng.integers(0, 2))
        elif kind in ("comments", "side"):
            inner = f"<h3>{words(2)}</h3>" * int(rng.random() < 0.6) + "".join(f'<div class="{"comment" if kind == "comments" else "item"}"><p>{sentence(3, 60)}</p></div>' if rng.random() < 0.5 else f"<p>{sentence(3, 60)}</p>" for _ in range(rng.integers(1, 5)))
        else:
            inner = "".join(f"<p>{sentence(2, 40)}</p>" if rng.random() < 0.4 else sentence(2, 40) for _ in range(rng.integers(1, 3)))
        return f"<{tag}{attribute}>{inner}</{tag}>"

    def add(text: str, main: bool) -> None:
        page.append((text, main))

    add(f"<!DOCTYPE html><html><head><title>{words(6)}</title></head><body>", False)
    wrapped = rng.random() < 0.4
    if wrapped:
        add('<div class="wrapper">', False)
    for kind in ("header", "menu", "notice", "advert", "share", "side", "form"):
        if rng.random() < (0.7 if kind == "menu" else 0.35):
            add(other(kind), False)
    name = MAIN_NAMES[rng.integers(len(MAIN_NAMES))]
    tag = ("article", "main", "div", "section", "article")[rng.integers(5)]
    opened = f"<{tag}>" if tag in ("article", "main") and rng.random() < 0.7 else f'<{tag} {"class" if rng.random() < 0.6 else "id"}="{name}">'
    outer = rng.random() < 0.2
    add("<main>" * outer + opened, False)
    for k in range(int(rng.integers(2, 14))):
        r = rng.random()
        if k == 0 and r < 0.8:
            add(f"<header><h1>{words(8)}</h1></header>" if rng.random() < 0.15 else f"<h1>{words(8)}</h1>", True)
        elif r < 0.1:
            add(f"<h2>{words(int(rng.integers(1, 7)))}</h2>", True)
        elif r < 0.18:
            add("<ul>" + "".join(f"<li>{sentence(2, 20)}</li>" for _ in range(rng.integers(2, 6))) + "</ul>", True)
        elif r < 0.23:
            add(f"<blockquote>{sentence(4, 40)}</blockquote>", True)
        elif r < 0.27:
            add(f"<table><tr><td>{words(2)}</td><td>{words(3)}</td></tr></table>", True)
        elif r < 0.34:
            add(other(("advert", "share", "notice", "side", "form")[rng.integers(5)]), False)
        elif r < 0.42:
            add(f"<p><b>{sentence(1, 30)}<br>", True)
        else:
            add(f"<p>{sentence(1, 120)}" + "</p>" * int(rng.random() < 0.9), True)
        if own.random() < 0.06:
            part = parts[own.integers(len(parts))]
            add(f"<{part}>{' '.join(lexicon[i] for i in own.integers(0, len(lexicon), own.integers(1, 9)))}</{part}>", False)
    if rng.random() < 0.25:
        add(other("comments"), False)
    add(f"</{tag}>" + "</main>" * outer, False)
    for kind in ("comments", "share", "side", "advert", "form", "notice"):
        if rng.random() < 0.3:
            add(other(kind), False)
    if rng.random() < 0.8:
        add(other("footer"), False)
    add("</div>" * wrapped + "</body></html>", False)
    # A mark before each part's text says which label its blocks have.
    marked = "".join(re.sub(r">(?=[^<\s])", f">\ue000{int(main)}", text) if ">" in text else text for text, main in page)
    out, labels = [], []
    for path, text, linked in blocks(marked):
        label = re.findall("\ue000(.)", text)
        clean = re.sub("\ue000.", "", text).strip()
        if label and clean:
            out.append((path, clean, linked))
            labels.append(float(label[0]))
    return out, np.array(labels, F4)


def doubtless(page: list[tuple]) -> np.ndarray:
    """1 in an article or main element, 0 in a container named otherwise, -1 where neither or both can be."""
    out = np.full(len(page), -1.0, F4)
    for i, (path, _, _) in enumerate(page):
        parts = {p for e in path for p in e.split()}
        inner = [{*e.split()} for e in path]
        main = max((k for k, e in enumerate(inner) if e & {"article", "main"}), default=-1)
        other = max((k for k, e in enumerate(inner) if e & _DOUBTLESS), default=-1)
        if other > main:
            out[i] = 0
        elif main >= 0 and not parts & _DOUBTLESS:
            out[i] = 1
    return out


def train(pages: list[str], seed: int = 11, made: int = 1500, epochs: int = 7, hidden: int = 16, most_words: int = 5000) -> BiLSTM:
    """A labeller fitted to ``made`` template pages, filled with the first ``most_words`` distinct words of the given real ones, and to these."""
    rng = np.random.default_rng(seed)
    real = [blocks(p) for p in pages]
    lexicon = list(dict.fromkeys(w for p in real for _, t, _ in p for w in t.lower().split()))[:most_words] or ["a", "of", "text", "page", "words", "here"]
    data = [made_page(rng, lexicon) for _ in range(made)] + [(p, doubtless(p)) for p in real if p]
    data = [(p[k : k + 200], y[k : k + 200]) for p, y in data for k in range(0, len(p), 200)]
    vectors = Vectors()
    xs = vectors.many([p for p, _ in data])
    model = BiLSTM(INPUTS, hidden, seed)
    adam = Adam(model.p, 0.01)
    order = np.array(sorted(range(len(data)), key=lambda i: len(xs[i])))
    for epoch in range(epochs):
        groups = [order[i : i + 32] for i in range(0, len(order), 32)]
        adam.rate = 0.01 if epoch < epochs - 2 else 0.003
        for g in rng.permutation(len(groups)):
            pick = groups[g]
            longest = max(len(xs[i]) for i in pick)
            x, y, mask = np.zeros((longest, len(pick), INPUTS), F4), np.full((longest, len(pick)), -1, F4), np.zeros((longest, len(pick)), F4)
            for j, i in enumerate(pick):
                x[: len(xs[i]), j], y[: len(xs[i]), j], mask[: len(xs[i]), j] = xs[i], data[i][1], 1
            keep: list = []
            logit = model.run(x, mask, keep)
            used = mask * (y >= 0)
            if used.any():
                adam.step(model.back(keep, ((sigmoid(logit) - y) * used / used.sum()).astype(F4)))
    return model


def label(model: BiLSTM, vectors: Vectors, pages: list[list]) -> list[np.ndarray]:
    """The probability of every block of each page to be main text; whole pages, however long."""
    out: list[np.ndarray] = [np.zeros(0, F4)] * len(pages)
    order = sorted((i for i in range(len(pages)) if pages[i]), key=lambda i: len(pages[i]))
    a = 0
    while a < len(order):
        b = a + 1
        while b < len(order) and b - a < 128 and (b - a + 1) * len(pages[order[b]]) <= 8192:
            b += 1
        pick = order[a:b]
        xs = vectors.many([pages[i] for i in pick])
        longest = len(xs[-1])
        x, mask = np.zeros((longest, len(pick), INPUTS), F4), np.zeros((longest, len(pick)), F4)
        for j, own in enumerate(xs):
            x[: len(own), j], mask[: len(own), j] = own, 1
        p = sigmoid(model.run(x, mask))
        for j, i in enumerate(pick):
            out[i] = p[: len(pages[i]), j]
        a = b
    return out


# ---------------------------------------------------------------- on Spark

#: Real pages that training takes at most, and bytes of all of them.
MOST_PAGES, MOST_BYTES = 200, 32 << 20


def sample_pages(pages: DataFrame, most_pages: int = MOST_PAGES, most_bytes: int = MOST_BYTES) -> DataFrame:
    """html of at most ``most_pages`` different pages of ``most_bytes`` altogether, chosen by a hash. Hashes and sizes are
    compared first, and only the pages chosen travel."""
    key = F.xxhash64("page_id", "html").alias("key")
    sizes = pages.filter("html is not null").select(key, F.octet_length("html").alias("n")).groupBy("key").agg(F.max("n").alias("n"))
    some = sizes.orderBy("key").limit(most_pages)
    chosen = some.withColumn("upto", F.sum("n").over(Window.orderBy("key"))).filter(F.col("upto") <= most_bytes)  # over those rows alone
    return pages.filter("html is not null").select(key, "html").join(F.broadcast(chosen.select("key")), "key").groupBy("key").agg(F.min("html").alias("html"))


def fit(pages: DataFrame, most_pages: int = MOST_PAGES, most_bytes: int = MOST_BYTES) -> BiLSTM:
    rows = sample_pages(pages, most_pages, most_bytes).collect()
    return train([r.html for r in sorted(rows, key=lambda r: r.key)])


def extract(pages: DataFrame, model: BiLSTM, carry: list[str] | None = None) -> DataFrame:
    """The columns of ``pages`` (those in ``carry``, if given; text and n_chars are replaced) and text, the main blocks in page order joined
    by line feeds, and n_chars, its code points.

    Character references are decoded, white space in a block becomes one space, <br> counts as white space. Null and empty
    pages, and pages without main blocks, have an empty text. Scripts, styles, form text areas and comments are dropped, unclosed
    ones with all that follows, and a tag without > ends with the page; quotes that are never closed hide nothing. All other text is labelled. Pages
    of any length are labelled whole. Repeated rows give equal texts; an empty table gives an empty result.
    """
    shared = pages.sparkSession.sparkContext.broadcast(model)  # fixed size
    kept = [c for c in (pages.columns if carry is None else carry) if c not in ("text", "n_chars")]

    def run(batches):
        vectors = Vectors()
        for batch in pieces(batches, "__quern_html"):
            found = [blocks(t.decode()) if t else [] for t in rows_of(batch, "__quern_html")]
            chances = label(shared.value, vectors, found)
            text = ["\n".join(b[1] for b, p in zip(page, chance, strict=True) if p >= 0.5) for page, chance in zip(found, chances, strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(kept))), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], names=[*kept, "text", "n_chars"])

    types = dict(pages.dtypes)
    return pages.select(*kept, pages["html"].alias("__quern_html")).mapInArrow(run, ", ".join([*(f"`{c}` {types[c]}" for c in kept), "text string, n_chars long"]))
