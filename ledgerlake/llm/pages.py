"""Main text of pages by a recurrent block labeller.

A page becomes the sequence of its leaf blocks: runs of text between block elements, each with the
path of elements above it. A bidirectional LSTM reads the sequence, a block at a time, as vectors of
its path (elements, class and id words), of its hashed words and of a few plain measures, and labels
every block with the whole page in view. Blocks labelled as content are the text.

There are no labels in the data. The network is fitted on a bounded sample of pages whose blocks are
labelled by what elements and class words are for (`purpose`), on the same blocks put into other
layouts made up from the same lists, so that it doesn't hang on the layout of one site, and on the same
pages with some or all of these elements and words hidden, so that it learns to tell content by its
words, measures and neighbours where a page names nothing.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ledgerlake.llm.words import blocks, mix

#: Pages the network is fitted on at most, of at most so many characters, and layouts made of each.
SAMPLE_PAGES = 160
SAMPLE_CHARS = 200_000
LAYOUTS = 3
EPOCHS = 5
PATH_SLOTS = 1 << 10
WORD_SLOTS = 1 << 11
PATH_DIMS, WORD_DIMS, MEASURES, HIDDEN = 24, 6, 6, 20
#: Blocks that the network is fitted on at a time; longer pages of the sample come in runs of so many.
RUN = 400
#: Shares of telling words that are hidden in the copies of a page made for fitting.
HIDDEN_SHARES = (1.0, 0.5)

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
UNSEEN = {
    "script", "style", "noscript", "template", "head", "title", "textarea", "select", "button",
    "iframe", "svg", "math", "object", "audio", "video", "canvas",
}
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font",
    "i", "img", "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span",
    "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "br",
}
#: Elements that end when another of the same kind starts.
SAME = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}

CONTENT = ["article", "main", "content", "post", "entry", "story", "body", "text", "page"]
OTHER = [
    "nav", "menu", "navbar", "breadcrumb", "header", "masthead", "banner", "footer", "copyright",
    "aside", "sidebar", "widget", "related", "recommended", "promo", "ad", "ads", "advert",
    "advertisement", "sponsor", "sponsored", "cookie", "consent", "notice", "alert", "popup", "modal",
    "newsletter", "subscribe", "signup", "login", "form", "search", "share", "social", "comment",
    "comments", "reply", "disqus", "discussion", "toolbar", "pagination", "tags", "toc", "disclaimer",
]
_OTHER = set(OTHER)
_CONTENT = set(CONTENT)
_ELEMENTS = {"nav", "footer", "aside", "form", "dialog"}
_TELLING = {"article", "main", "nav", "header", "footer", "aside", "section", "form", "dialog"}
_PIECES = re.compile(r"[a-z]+")
_U = np.uint64


class _Leaves(HTMLParser):
    """Collects (text, path, characters inside links). A path has the element names and class words above
    a block, from the outermost element on, however deep it stands; each counts where it comes first.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, tuple[str, ...]]] = []
        self.parts: list[str] = []
        self.linked = 0
        self.hidden = self.links = 0
        self.leaves: list[tuple[str, tuple[str, ...], int]] = []

    def _end_block(self):
        text = " ".join("".join(self.parts).split())
        if text:
            self.leaves.append((text, self.open[-1][1] if self.open else (), self.linked))
        self.parts, self.linked = [], 0

    def _pop(self, k: int):
        for tag, _ in self.open[k:]:
            self.hidden -= tag in UNSEEN
            self.links -= tag == "a"
        del self.open[k:]

    def handle_starttag(self, tag, attrs):
        if tag not in INLINE:
            self._end_block()
        elif tag in ("br", "wbr"):
            self.parts.append(" " if tag == "br" else "")
        ends = SAME.get(tag)
        if ends:
            for k in range(len(self.open) - 1, -1, -1):
                if self.open[k][0] in ends:
                    self._pop(k)
                    break
                if self.open[k][0] not in INLINE:
                    break
        if tag == "body" and self.hidden:
            # a head that was never closed
            for k, (name, _) in enumerate(self.open):
                if name == "head":
                    self._pop(k)
                    break
        if tag in VOID:
            return
        named = " ".join(v for k, v in attrs if v and k in ("class", "id", "role")).lower()
        above = self.open[-1][1] if self.open else ()
        new = dict.fromkeys((tag, *("." + w for w in _PIECES.findall(named))))
        new = tuple(w for w in new if w not in above)
        self.open.append((tag, above + new if new else above))
        self.hidden += tag in UNSEEN
        self.links += tag == "a"

    def handle_startendtag(self, tag, attrs):
        if tag not in INLINE:
            self._end_block()
        elif tag == "br":
            self.parts.append(" ")

    def handle_endtag(self, tag):
        if tag not in INLINE:
            self._end_block()
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] == tag:
                self._pop(k)
                break
            # an inline element doesn't end the block it stands in
            if tag in INLINE and self.open[k][0] not in INLINE:
                break

    def parse_marked_section(self, i, report=1):
        # what is no known section ends at the next ">", as in browsers
        try:
            return super().parse_marked_section(i, report)
        except AssertionError:
            return self.parse_bogus_comment(i)

    def handle_data(self, data):
        if not self.hidden:
            self.parts.append(data)
            if self.links:
                self.linked += len(data)


def leaves(html: str | None) -> list[tuple[str, tuple[str, ...], int]]:
    parser = _Leaves()
    parser.feed(html or "")
    parser.close()
    parser._end_block()
    return parser.leaves


def purpose(path: tuple[str, ...], text: str, linked: int) -> int:
    """1 if a block is content by what its elements and class words are for, else 0."""
    inside = False
    for word in path:
        name = word.lstrip(".")
        if word in _ELEMENTS or (word.startswith(".") and name in _OTHER):
            return 0
        if word == "header" and not inside:
            return 0
        inside |= word in ("article", "main") or (word.startswith(".") and name in _CONTENT - {"body", "page"})
    return int(inside or (len(text.split()) > 25 and linked * 4 < len(text)))


def layouts(page: list, draw: np.random.Generator, spare: list[str]) -> tuple[list, list[int]]:
    """The content of a page in a made-up layout: blocks as from `leaves`, and their labels."""
    content = [x[0] for x in page if purpose(x[1], x[0], x[2])] or [x[0] for x in page]
    pick = lambda options: options[draw.integers(len(options))]
    base = ["html", "body", *(["div"] if draw.random() < 0.5 else [])]
    top = pick([["article"], ["main"], ["main", "article"], ["div", "." + pick(CONTENT)], ["section", "." + pick(CONTENT)], ["div", "main", "." + pick(CONTENT)]])
    out, labels = [], []

    def other(above: list[str]):
        word = pick(OTHER)
        holder = [word] if word in ("nav", "header", "footer", "aside", "form") and draw.random() < 0.6 else [pick(["div", "section", "ul", "p", "aside"]), "." + word]
        if above != base and holder[0] == "header":
            holder = ["div", ".ad"]
        for _ in range(draw.integers(1, 7)):
            words = pick(spare).split() if spare else ["x"]
            size = int(draw.integers(1, 5)) if draw.random() < 0.6 else int(draw.integers(5, 60))
            text = " ".join(words[:size]) or "x"
            inner = pick([["p"], ["li"], ["li", "a"], ["div"], ["a"], ["span"], []])
            out.append((text, tuple(base + above[len(base):] + holder + inner), len(text) if "a" in inner else 0))
            labels.append(0)

    for _ in range(draw.integers(0, 4)):
        other(base)
    inside = base + top
    for k, text in enumerate(content):
        if k and draw.random() < 0.08:
            other(inside)
        tags = ["h1"] if k == 0 and draw.random() < 0.7 else pick([["p"]] * 6 + [["h2"], ["h3"], ["blockquote", "p"], ["ul", "li"], ["div"], ["pre"], ["table", "tr", "td"], ["figure", "figcaption"]])
        if tags == ["h1"] and draw.random() < 0.3:
            tags = ["header", "h1"]
        out.append((text, tuple(inside + tags), 0))
        labels.append(1)
    if draw.random() < 0.4:
        other(inside)
    for _ in range(draw.integers(0, 4)):
        other(base)
    return out, labels


def hidden(page: list, share: float, draw: np.random.Generator) -> list:
    """A page on which that share of telling elements are a plain `div` and of class words are gone."""
    gone: dict[str, bool] = {}
    out = []
    for text, path, linked in page:
        kept = []
        for word in path:
            telling = word in _TELLING or word.startswith(".")
            if telling and gone.setdefault(word, bool(draw.random() < share)):
                word = "" if word.startswith(".") else "div"
            kept.append(word)
        out.append((text, tuple(dict.fromkeys(filter(None, kept))), linked))
    return out


def _slot(word: str) -> int:
    code = 0
    for b in word.encode():
        code = (code * 257 + b + 1) & 0xFFFFFFFFFFFF
    return int(mix(np.array([code], _U))[0] % _U(PATH_SLOTS))


class _Sequence:
    """What the network reads of one page: slots of path and words per block, and measures."""

    slots: dict[str, int] = {}

    def __init__(self, page: list):
        self.size = len(page)
        paths = []
        for _, path, _ in page:
            for word in path:
                if word not in self.slots:
                    if len(self.slots) > 100_000:
                        self.slots.clear()
                    self.slots[word] = _slot(word)
            # the last elements once more as such, so that the nearest ones can be told from others
            near = [("/" + w) for w in path[-2:]]
            for word in near:
                if word not in self.slots:
                    self.slots[word] = _slot(word)
            paths.append([self.slots[w] for w in (*path, *near)])
        self.path = paths
        words, ptr = [], [0]
        for block in blocks(pa.array([x[0] for x in page], pa.string())):
            hashes = block.word_hashes()
            words.append((hashes & _U(WORD_SLOTS - 1)).astype(np.int64))
            ptr += (block.word_ptr[1:] + ptr[-1]).tolist()
        self.word = np.concatenate([np.zeros(0, np.int64), *words])
        self.word_ptr = np.array(ptr)
        n = np.diff(self.word_ptr)
        chars = np.array([len(x[0]) for x in page], float)
        linked = np.array([x[2] for x in page], float)
        ends = np.array([x[0][-1] in ".!?:;\"'" for x in page], float)
        at = np.arange(len(page)) / max(1, len(page) - 1)
        self.measures = np.stack(
            [np.log1p(chars) / 6, np.log1p(n) / 5, np.minimum(linked / np.maximum(chars, 1), 1), ends, at, np.ones(len(page))], 1
        )


def _mean_rows(table: np.ndarray, slots: np.ndarray, ptr: np.ndarray) -> np.ndarray:
    out = np.zeros((len(ptr) - 1, table.shape[1]))
    some = np.flatnonzero(np.diff(ptr))
    if len(some):
        out[some] = np.add.reduceat(table[slots], ptr[some], axis=0) / np.diff(ptr)[some, None]
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Labeller:
    """Bidirectional LSTM over the blocks of a page, in numpy."""

    def __init__(self, seed: int = 0):
        draw = np.random.default_rng(seed)
        inputs = PATH_DIMS + WORD_DIMS + MEASURES
        self.p = {
            "path": draw.normal(0, 0.3, (PATH_SLOTS, PATH_DIMS)),
            "word": draw.normal(0, 0.1, (WORD_SLOTS, WORD_DIMS)),
            "out": draw.normal(0, 0.2, 2 * HIDDEN),
            "bias": np.zeros(1),
        }
        for way in "fb":
            self.p["x" + way] = draw.normal(0, 1 / np.sqrt(inputs), (inputs, 4 * HIDDEN))
            self.p["h" + way] = draw.normal(0, 1 / np.sqrt(HIDDEN), (HIDDEN, 4 * HIDDEN))
            self.p["c" + way] = np.concatenate([np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN)])

    def _inputs(self, pages: list[_Sequence]):
        """Vectors (page, block, input), mask, and where table rows went."""
        longest = max(x.size for x in pages)
        x = np.zeros((len(pages), longest, PATH_DIMS + WORD_DIMS + MEASURES))
        mask = np.zeros((len(pages), longest))
        slots = [np.array([s for line in y.path for s in line], np.int64) for y in pages]
        ptrs = [np.concatenate([[0], np.cumsum([len(line) for line in y.path])]).astype(np.int64) for y in pages]
        for k, y in enumerate(pages):
            x[k, : y.size, :PATH_DIMS] = _mean_rows(self.p["path"], slots[k], ptrs[k]) * 3
            x[k, : y.size, PATH_DIMS : PATH_DIMS + WORD_DIMS] = _mean_rows(self.p["word"], y.word, y.word_ptr)
            x[k, : y.size, PATH_DIMS + WORD_DIMS :] = y.measures
            mask[k, : y.size] = 1
        return x, mask, slots, ptrs

    def _pass(self, x: np.ndarray, mask: np.ndarray, way: str, keep: bool):
        """Hidden states in one direction; what the backward pass needs if `keep`."""
        n, steps, _ = x.shape
        h, c = np.zeros((n, HIDDEN)), np.zeros((n, HIDDEN))
        gates_x = x @ self.p["x" + way] + self.p["c" + way]
        out, saved = np.zeros((n, steps, HIDDEN)), []
        for t in range(steps) if way == "f" else range(steps - 1, -1, -1):
            g = gates_x[:, t] + h @ self.p["h" + way]
            i, f, o = (_sigmoid(g[:, k * HIDDEN : (k + 1) * HIDDEN]) for k in range(3))
            u = np.tanh(g[:, 3 * HIDDEN :])
            m = mask[:, t, None]
            new_c = (f * c + i * u) * m
            new_h = o * np.tanh(new_c) * m
            if keep:
                saved.append((t, i, f, o, u, c, new_c, h, m))
            h, c = new_h, new_c
            out[:, t] = h
        return out, saved

    def probability(self, pages: list[_Sequence]) -> list[np.ndarray]:
        out: list[np.ndarray] = [np.zeros(0)] * len(pages)
        order = sorted((k for k in range(len(pages)) if pages[k].size), key=lambda k: pages[k].size)
        at = 0
        while at < len(order):
            # pages of like length together, of so many blocks at most
            some = [order[at]]
            while at + len(some) < len(order) and len(some) < 64 and pages[order[at + len(some)]].size * (len(some) + 1) <= 20_000:
                some.append(order[at + len(some)])
            at += len(some)
            x, mask, _, _ = self._inputs([pages[k] for k in some])
            h = np.concatenate([self._pass(x, mask, way, False)[0] for way in "fb"], 2)
            p = _sigmoid(h @ self.p["out"] + self.p["bias"])
            for j, k in enumerate(some):
                out[k] = p[j, : pages[k].size]
        return out

    def gradients(self, pages: list[_Sequence], labels: list[list[int]]) -> dict[str, np.ndarray]:
        """Of the mean cross-entropy over blocks."""
        x, mask, slots, ptrs = self._inputs(pages)
        y = np.zeros_like(mask)
        for k, of in enumerate(labels):
            y[k, : len(of)] = of
        passes = {way: self._pass(x, mask, way, True) for way in "fb"}
        h = np.concatenate([passes["f"][0], passes["b"][0]], 2)
        err = (_sigmoid(h @ self.p["out"] + self.p["bias"]) - y) * mask / mask.sum()
        grad = {"out": np.einsum("ntk,nt->k", h, err), "bias": np.array([err.sum()])}
        dx = np.zeros_like(x)
        for k, way in enumerate("fb"):
            dh_out = err[:, :, None] * self.p["out"][k * HIDDEN : (k + 1) * HIDDEN]
            wx, wh = self.p["x" + way], self.p["h" + way]
            gx, gh, gc = np.zeros_like(wx), np.zeros_like(wh), np.zeros(4 * HIDDEN)
            dh, dc = np.zeros((len(x), HIDDEN)), np.zeros((len(x), HIDDEN))
            for t, i, f, o, u, c, new_c, h_before, m in reversed(passes[way][1]):
                dh = (dh + dh_out[:, t]) * m
                tc = np.tanh(new_c)
                dc = (dc + dh * o * (1 - tc * tc)) * m
                d = np.concatenate(
                    [dc * u * i * (1 - i), dc * c * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - u * u)], 1
                )
                gx += x[:, t].T @ d
                gh += h_before.T @ d
                gc += d.sum(0)
                dx[:, t] += d @ wx.T
                dh, dc = d @ wh.T, dc * f
            grad["x" + way], grad["h" + way], grad["c" + way] = gx, gh, gc
        grad["path"], grad["word"] = np.zeros_like(self.p["path"]), np.zeros_like(self.p["word"])
        for k, page in enumerate(pages):
            n = np.diff(ptrs[k])
            d = np.repeat(dx[k, : page.size, :PATH_DIMS] * 3 / np.maximum(n, 1)[:, None], n, axis=0)
            np.add.at(grad["path"], slots[k], d)
            n = np.diff(page.word_ptr)
            d = dx[k, : page.size, PATH_DIMS : PATH_DIMS + WORD_DIMS] / np.maximum(n, 1)[:, None]
            np.add.at(grad["word"], page.word, np.repeat(d, n, axis=0))
        return grad

    def fit(self, pages: list[_Sequence], labels: list[list[int]], epochs: int = EPOCHS, seed: int = 1):
        draw = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(v) for k, v in self.p.items()}
        t = 0
        for epoch in range(epochs):
            order = draw.permutation(len(pages))
            for at in range(0, len(order), 16):
                some = order[at : at + 16].tolist()
                t += 1
                rate = 0.02 * (1 - 0.8 * epoch / epochs)
                for k, g in self.gradients([pages[j] for j in some], [labels[j] for j in some]).items():
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.99 * v[k] + 0.01 * g * g
                    self.p[k] -= rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-8)
        return self


def trained(htmls: list[str], seed: int = 0) -> Labeller:
    """A labeller fitted on sample pages as they are, in made-up layouts, and with telling words hidden."""
    draw = np.random.default_rng(seed)
    parsed = [x for x in map(leaves, htmls) if x]
    spare = [text for page in parsed for text, *_ in page][:20_000]
    pages, labels = [], []
    for page in parsed:
        own = [purpose(path, text, linked) for text, path, linked in page]
        for made in (page, *(hidden(page, share, draw) for share in HIDDEN_SHARES)):
            pages.append(made)
            labels.append(own)
        for _ in range(LAYOUTS):
            made, of = layouts(page, draw, spare)
            pages.append([(text, tuple(dict.fromkeys(path)), linked) for text, path, linked in made])
            labels.append(of)
    runs = [(x[k : k + RUN], of[k : k + RUN]) for x, of in zip(pages, labels, strict=True) for k in range(0, len(x), RUN)]
    return Labeller(seed).fit([_Sequence(x) for x, _ in runs], [of for _, of in runs])


def extract_batch(htmls: list[str | None], labeller: Labeller) -> list[str]:
    """Text of each page; a page is read whole, however long it is."""
    parsed = [leaves(x) for x in htmls]
    found = labeller.probability([_Sequence(x) for x in parsed])
    return [
        "\n".join(text for (text, *_), p in zip(page, of, strict=True) if p >= 0.5)
        for page, of in zip(parsed, found, strict=True)
    ]


def extract(df: DataFrame, sample_pages: int = SAMPLE_PAGES) -> DataFrame:
    """page_id, url, text, n_chars of every row of (page_id, url, html).

    The network is fitted on `sample_pages` pages at most, of SAMPLE_CHARS characters at most, chosen by
    a hash. A NULL or empty page has
    an empty text. Repeated pages have a row each; an empty table gives an empty result; other
    columns are ignored. White space is what Python's str.split takes for it.
    """
    # hashes first: a page is only sent to the driver if it is in the sample
    hashed = df.where(F.length("html").between(1, SAMPLE_CHARS)).select(
        "html", F.xxhash64("page_id", "url").alias("at")
    )
    least = hashed.select("at").orderBy("at").limit(sample_pages).toPandas()["at"]
    bound = int(least.max()) if len(least) else 0
    sample = hashed.where(F.col("at") <= bound).orderBy("at", "html").limit(sample_pages).toPandas()
    labeller = trained(sample["html"].tolist())

    def read(batches):
        for batch in batches:
            for at in range(0, max(batch.num_rows, 1), 256):
                some = batch.slice(at, 256)
                yield pa.RecordBatch.from_arrays(
                    [
                        some["page_id"],
                        some["url"],
                        pa.array(extract_batch(some["html"].to_pylist(), labeller), pa.string()),
                    ],
                    names=["page_id", "url", "text"],
                )

    return (
        df.select("page_id", "url", "html")
        .mapInArrow(read, df.select("page_id", "url").schema.add("text", StringType()))
        .withColumn("n_chars", F.length("text").cast("long"))
    )
