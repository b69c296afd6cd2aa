"""Operator 7: main text of web pages, from a recurrent labeller of their blocks.

A page is cut into leaf blocks. Each block is a vector of its hashed tag path (names, classes and
ids of the open elements), its hashed words and a few measures. A bidirectional LSTM in numpy reads
the blocks of the whole page in order and labels each as article or not; pages are batched.

It is trained on a bounded sample, ``FIT_PAGES`` pages chosen by a hash of page_id. Their labels
come from markup that says what it holds (``article``, ``nav``, class and id names). Because other
sites say it differently or not at all, every page is also seen in ``VARIANTS`` altered forms: its
containers are renamed or lose their names, and menus, notices, adverts, forms, sidebars and reader
comments with the words of other pages are put around and between its paragraphs.

Defined results: where no page of the sample tells by its markup what an article is, no block is
one; null or empty html gives empty text; blocks without text are none; repeated rows
are extracted each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .registry import query, table
from .words import ALNUM, lean, pieces

FIT_PAGES, VARIANTS = 250, 3
HIDDEN, EPOCHS, BATCH, RATE, SEED = 24, 12, 32, 0.01, 11
PATH_SIZE, WORD_SIZE, MEASURES = 96, 32, 6
FEATURES = PATH_SIZE + WORD_SIZE + MEASURES
#: Pages labelled together.
PAGES_AT_ONCE = 256

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+>"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+|[^>]*+)>",
    re.S,
)
_NAMES = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_RAW = {"script", "style", "title", "textarea", "xmp", "iframe", "noembed", "noframes", "template"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins",
    "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr",
    "svg", "math", "foreignobject", "desc", "mi", "mo", "mn", "ms", "mtext", "annotation-xml",
}
#: Elements with a grammar of their own, elements in these that hold html, and html elements that end them.
_FOREIGN, _HOLDS_HTML = {"svg", "math"}, {"foreignobject", "desc", "mi", "mo", "mn", "ms", "mtext", "annotation-xml"}
_ENDS_P = {
    "address", "article", "aside", "blockquote", "div", "dl", "fieldset", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6",
    "header", "hr", "main", "nav", "ol", "p", "pre", "section", "table", "ul",
}
_BREAKS_OUT = _ENDS_P | {
    "b", "big", "body", "br", "center", "code", "dd", "dt", "em", "embed", "head", "i", "img", "li", "listing", "menu", "meta", "nobr",
    "ruby", "s", "small", "span", "strong", "strike", "sub", "sup", "tt", "u", "var",
}
_SELF_CLOSING = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_SPACE = re.compile(r"\s+")


@dataclass
class Block:
    path: tuple  #: one entry per open element: its name and the words of its class, id and role
    text: str
    linked: int  #: characters within links


@lru_cache(maxsize=65536)
def _element(name: str, attributes: str) -> tuple:
    words = [name]
    for _, a, b, c in _NAMES.findall(attributes):
        words += ["." + w for w in re.findall(r"[a-z]+", re.sub(r"(?<=[a-z])(?=[A-Z])", " ", a or b or c).lower())]
    return tuple(words)


def _raw_end(page: str, name: str, at: int) -> int:
    found = re.compile(rf"</{re.escape(name)}[^>]*>", re.I).search(page, at)
    return found.end() if found else len(page)


def blocks(page: str) -> list[Block]:
    """The leaf blocks of a page in order, white space made single spaces, references decoded."""
    out: list[Block] = []
    stack: list[tuple] = []
    parts: list[str] = []
    linked, links, at, foreign, hidden = 0, 0, 0, 0, 0

    def end_block() -> None:
        nonlocal linked
        if parts:
            text = _SPACE.sub(" ", html.unescape("".join(parts))).strip()
            if text:
                out.append(Block(tuple(stack), text, min(linked, len(text))))
        parts.clear()
        linked = 0

    def close(names: set) -> None:
        """Close the innermost open element of ``names`` and all within it."""
        nonlocal links, foreign, hidden
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] in names:
                links -= sum(x[0] == "a" for x in stack[i:])
                foreign -= sum(x[0] in _FOREIGN for x in stack[i:])
                hidden -= sum(x[0] == "svg" for x in stack[i:])
                del stack[i:]
                return

    def foreign_root() -> int:
        """Place of the svg or math element whose grammar holds now, -1 if it is that of html."""
        for i in range(len(stack) - 1, -1, -1) if foreign else ():
            if stack[i][0] in _FOREIGN:
                return i
            if stack[i][0] in _HOLDS_HTML:
                return -1
        return -1

    while True:
        found = _TAG.search(page, at)
        text = page[at:found.start() if found else len(page)]
        if text and not hidden:  # labels in drawings are not text of the page
            parts.append(text)
            linked += len(text) if links else 0
        if not found:
            break
        at = found.end()
        name = (found[2] or "").lower()
        if not name:
            continue
        root = foreign_root()
        if root >= 0 and not found[1] and name in _BREAKS_OUT:  # an element that was never closed
            close(_FOREIGN)
            root = foreign_root()
        if root >= 0 and not (found[1] and all(x[0] != name for x in stack[root:]) and any(x[0] == name for x in stack[:root])):
            if found[1]:
                if any(x[0] == name for x in stack[root:]):
                    close({name})
            elif not found[3].endswith("/"):
                if name in _RAW:
                    at = _raw_end(page, name, at)
                    continue
                stack.append(_element(name, found[3]))
                links, foreign, hidden = links + (name == "a"), foreign + (name in _FOREIGN), hidden + (name == "svg")
            continue
        if name == "br":
            parts.append(" ")
        if name not in _INLINE:
            end_block()
        if found[1]:
            close({name})
            continue
        if name in _ENDS_P and any(x[0] == "p" for x in stack):
            close({"p"})
        if name in _SELF_CLOSING and stack and stack[-1][0] in _SELF_CLOSING[name]:
            close(_SELF_CLOSING[name])
        if name in _RAW:
            at = _raw_end(page, name, at)
        elif name not in _VOID and not found[3].endswith("/"):
            stack.append(_element(name, found[3]))
            links, foreign, hidden = links + (name == "a"), foreign + (name in _FOREIGN), hidden + (name == "svg")
    end_block()
    return out


_ARTICLE = {"article", "main", ".article", ".content", ".post", ".entry", ".story", ".main"}
_OTHER = {
    "nav", "aside", "footer", "form", "button", "select", "noscript", "dialog", "menu", ".nav", ".navigation", ".navbar", ".menu", ".header",
    ".footer", ".sidebar", ".aside", ".ad", ".ads", ".advert", ".advertisement", ".sponsored", ".promo", ".banner", ".cookie", ".cookies",
    ".consent", ".notice", ".comment", ".comments", ".commentlist", ".disqus", ".reply", ".respond", ".share", ".sharing", ".social", ".related",
    ".breadcrumb", ".breadcrumbs", ".newsletter", ".subscribe", ".widget", ".copyright", ".login", ".search", ".popup", ".modal", ".toolbar",
    ".pagination", ".tags", ".contentinfo", ".complementary",
}


def markup_label(path: tuple) -> bool:
    """Whether markup says that a block belongs to an article."""
    inside = False
    for element in path:
        words = set(element)
        if words & _OTHER or (element[0] == "header" and not inside):
            return False
        inside |= bool(words & _ARTICLE)
    return inside


# Containers as other sites name them, for the altered training pages.
_AS_ARTICLE = [
    [("main",)], [("div", ".content")], [("div", ".main"), ("div", ".post")], [("section", ".entry", ".content")], [("div", ".story", ".body")],
    [("div",), ("div",)], [("main",), ("article", ".post")], [("article",)], [("article",)], [("table",), ("tr",), ("td",)], [("div", ".article", ".text")],
]
_IN_ARTICLE = [
    [("p",)], [("p",), ("b",)], [("h2",)], [("h2",)], [("h3",)], [("ul",), ("li",)], [("ol",), ("li",)], [("blockquote",)], [("blockquote",), ("p",)], [("pre",)],
    [("table",), ("tr",), ("td",)], [("table",), ("tbody",), ("tr",), ("th",)], [("header",), ("h1",)], [("figure",), ("figcaption",)], [("div",)], [("section",), ("p",)],
]
_AS_MENU = [
    [("nav",), ("ul",), ("li",), ("a",)], [("div", ".menu"), ("a",)], [("header",), ("nav",), ("ul",), ("li",), ("a",)], [("ul", ".navigation"), ("li",), ("a",)],
    [("div", ".breadcrumb"), ("a",)], [("div",), ("ul",), ("li",), ("a",)], [("header", ".site", ".header"), ("div",)], [("div", ".header"), ("p",)], [("header",), ("p",)],
]
_AS_FOOTER = [[("footer",)], [("footer",), ("p",)], [("div", ".footer"), ("p",)], [("div", ".copyright")], [("footer", ".site", ".footer"), ("div",)]]
_AS_NOTICE = [
    [("div", ".ad")], [("div", ".advert"), ("p",)], [("aside", ".sidebar"), ("p",)], [("aside",)], [("aside",), ("p",)], [("div", ".sidebar"), ("p",)], [("div", ".cookie", ".notice"), ("p",)],
    [("div", ".notice")], [("form",), ("label",)], [("form", ".subscribe"), ("p",)], [("form",)], [("div", ".newsletter"), ("p",)], [("div", ".promo")], [("div", ".banner"), ("p",)],
    [("section", ".related"), ("ul",), ("li",), ("a",)], [("div", ".share"), ("a",)], [("div", ".sponsored"), ("p",)], [("aside",), ("ul",), ("li",), ("a",)],
    [("form",), ("button",)], [("div", ".consent"), ("button",)], [("div", ".widget"), ("h3",)], [("aside",), ("h2",)],
]
_AS_COMMENT = [
    [("section", ".comments"), ("div", ".comment"), ("p",)], [("div", ".comments"), ("p",)], [("ol", ".commentlist"), ("li", ".comment"), ("p",)],
    [("div", ".comments"), ("article", ".comment"), ("p",)], [("section", ".comments"), ("h2",)], [("div", ".comment", ".body")], [("ul", ".comments"), ("li",)],
    [("div", ".comment")], [("section", ".comments"), ("article",), ("p",)],
]


def altered(page: list[tuple[Block, bool]], pool: list[str], rng: np.random.Generator) -> list[tuple[Block, bool]]:
    """The page as another site might have it, with foreign blocks around and in the article."""
    pick = lambda options: options[int(rng.integers(len(options)))]

    def foreign(options: list, base: tuple) -> tuple[Block, bool]:
        path = pick(options)
        text = pick(pool)
        if rng.random() < 0.5:
            words = text.split(" ")
            text = " ".join(words[: int(rng.integers(1, 12))])
        return Block(base + tuple(path), text, len(text) if path[-1][0] == "a" else 0), False

    top = (("html",), ("body",)) if rng.random() < 0.7 else (("html",), ("body",), ("div", ".page"))
    container = top + tuple(pick(_AS_ARTICLE))
    menu, footer = pick(_AS_MENU), pick(_AS_FOOTER)
    out: list[tuple[Block, bool]] = []
    own = [i for i, (_, good) in enumerate(page) if good]
    comments_inside = rng.random() < 0.4
    for i, (block, good) in enumerate(page):
        if good:
            tail = tuple(pick(_IN_ARTICLE)) if rng.random() < 0.35 else (("h1",) if block.path[-1][0] == "h1" else ("p",),)
            text = " ".join(block.text.split(" ")[: int(rng.integers(2, 14))]) if tail[-1][0] in ("h2", "h3", "li", "td", "th", "figcaption") else block.text
            out.append((Block(container + tail, text, block.linked), True))
            if rng.random() < 0.08:
                out.append(foreign(_AS_NOTICE, container))
            if own and i == own[-1]:
                for _ in range(int(rng.integers(0, 5))):
                    out.append(foreign(_AS_COMMENT, container if comments_inside else top))
        elif i < (own[0] if own else 0):
            out.append((Block(top + tuple(menu), block.text, block.linked), False))
            if rng.random() < 0.15:
                out.append(foreign(_AS_NOTICE, top))
        else:
            out.append((Block(top + tuple(footer), block.text, block.linked), False))
    for _ in range(int(rng.integers(0, 4))):
        out.insert(int(rng.integers(0, 2)) * len(out), foreign(_AS_NOTICE, top))
    return out


@lru_cache(maxsize=65536)
def _path_vector(path: tuple) -> np.ndarray:
    vector = np.zeros(PATH_SIZE, np.float32)
    for depth, element in enumerate(path):
        for word in element:
            vector[crc32(word.encode()) % (PATH_SIZE - 24)] = 1
        if depth == len(path) - 1:
            vector[PATH_SIZE - 24 + crc32(element[0].encode()) % 24] = 1
    return vector


def vectors(page: list[Block]) -> np.ndarray:
    """One row of ``FEATURES`` per block, all pages' blocks alike."""
    out = np.zeros((len(page), FEATURES), np.float32)
    if not page:
        return out
    out[:, :PATH_SIZE] = [_path_vector(b.path) for b in page]
    first = 0
    for piece in pieces(pa.array([b.text for b in page], pa.string()), ALNUM):
        hashes = piece.hashes(lower=True)
        counts = np.bincount(piece.doc * WORD_SIZE + (hashes % np.uint64(WORD_SIZE)).astype(np.int64), minlength=piece.n_texts * WORD_SIZE)
        counts = counts.reshape(piece.n_texts, WORD_SIZE)
        part = out[first:first + piece.n_texts]
        part[:, PATH_SIZE:PATH_SIZE + WORD_SIZE] = counts / np.maximum(counts.sum(1, keepdims=True), 1)
        part[:, -1] = np.log1p(piece.counts) / 4
        first += piece.n_texts
    length = np.array([len(b.text) for b in page], np.float32)
    out[:, -2] = np.log1p(length) / 8
    out[:, -3] = np.array([b.linked for b in page]) / length
    out[:, -4] = [b.text[-1] in ".!?:;\"'»”…" for b in page]
    out[:, -5] = [b.text.count(",") for b in page] / length * 10
    out[:, -6] = [b.text[:1] in "©(|" for b in page]
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


class BlockLabeller:
    """Bidirectional LSTM with one logistic output per block, trained with Adam."""

    def __init__(self, seed: int = SEED, hidden: int = HIDDEN):
        rng = np.random.default_rng(seed)
        self.hidden = hidden
        self.p = {"out": (rng.normal(size=2 * hidden) * 0.1).astype(np.float32), "out_bias": np.zeros(1, np.float32)}
        for way in ("on", "back"):
            self.p[f"{way}_x"] = (rng.normal(size=(FEATURES, 4 * hidden)) / np.sqrt(20)).astype(np.float32)
            self.p[f"{way}_h"] = (rng.normal(size=(hidden, 4 * hidden)) / np.sqrt(hidden)).astype(np.float32)
            bias = np.zeros(4 * hidden, np.float32)
            bias[hidden:2 * hidden] = 1
            self.p[f"{way}_b"] = bias

    def _run(self, way: str, x: np.ndarray, mask: np.ndarray, keep: bool):
        """States of one direction; x is (steps, pages, features), mask (steps, pages)."""
        steps, n, _ = x.shape
        size = self.hidden
        given = (x.reshape(steps * n, -1) @ self.p[f"{way}_x"]).reshape(steps, n, -1) + self.p[f"{way}_b"]
        h, c = np.zeros((n, size), np.float32), np.zeros((n, size), np.float32)
        states, kept = np.zeros((steps, n, size), np.float32), []
        for t in range(steps) if way == "on" else range(steps - 1, -1, -1):
            z = given[t] + h @ self.p[f"{way}_h"]
            gates, g = _sigmoid(z[:, :3 * size]), np.tanh(z[:, 3 * size:])
            i, f, o = gates[:, :size], gates[:, size:2 * size], gates[:, 2 * size:]
            m = mask[t][:, None]
            c_new = f * c + i * g
            tanh_c = np.tanh(c_new)
            if keep:
                kept.append((t, h, c, i, f, o, g, tanh_c, m))
            h, c = m * (o * tanh_c) + (1 - m) * h, m * c_new + (1 - m) * c
            states[t] = h
        return states, kept

    def logits(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        on, _ = self._run("on", x, mask, False)
        back, _ = self._run("back", x, mask, False)
        return np.concatenate([on, back], 2) @ self.p["out"] + self.p["out_bias"]

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> dict:
        size = self.hidden
        runs = {way: self._run(way, x, mask, True) for way in ("on", "back")}
        both = np.concatenate([runs["on"][0], runs["back"][0]], 2)
        error = (_sigmoid(both @ self.p["out"] + self.p["out_bias"]) - y) * mask / mask.sum()
        grad = {"out": np.einsum("tn,tnk->k", error, both), "out_bias": error.sum(keepdims=True)[0]}
        into = error[:, :, None] * self.p["out"]
        for way, part in (("on", into[:, :, :size]), ("back", into[:, :, size:])):
            dh, dc = np.zeros_like(part[0]), np.zeros_like(part[0])
            dz_all = np.zeros((*x.shape[:2], 4 * size), np.float32)
            grad[f"{way}_h"] = np.zeros_like(self.p[f"{way}_h"])
            for t, h, c, i, f, o, g, tanh_c, m in reversed(runs[way][1]):
                total = dh + part[t]
                dh_new = m * total
                dc_new = m * dc + dh_new * o * (1 - tanh_c**2)
                dz = np.concatenate([dc_new * g * i * (1 - i), dc_new * c * f * (1 - f), dh_new * tanh_c * o * (1 - o), dc_new * i * (1 - g**2)], 1)
                dz_all[t] = dz
                grad[f"{way}_h"] += h.T @ dz
                dh = dz @ self.p[f"{way}_h"].T + (1 - m) * total
                dc = dc_new * f + (1 - m) * dc
            flat = dz_all.reshape(-1, 4 * size)
            grad[f"{way}_x"] = x.reshape(-1, x.shape[2]).T @ flat
            grad[f"{way}_b"] = flat.sum(0)
        return grad

    def fit(self, pages: list[tuple[np.ndarray, np.ndarray]], epochs: int = EPOCHS, seed: int = SEED) -> BlockLabeller:
        rng = np.random.default_rng(seed)
        first = {k: np.zeros_like(v) for k, v in self.p.items()}
        second = {k: np.zeros_like(v) for k, v in self.p.items()}
        step = 0
        for epoch in range(epochs):
            order = sorted(rng.permutation(len(pages)).tolist(), key=lambda i: len(pages[i][0]) // 8)
            chunks = [order[at:at + BATCH] for at in range(0, len(order), BATCH)]
            for k in rng.permutation(len(chunks)).tolist():
                x, mask = padded([pages[i][0] for i in chunks[k]])
                y, _ = padded([pages[i][1][:, None] for i in chunks[k]])
                step += 1
                rate = RATE * (1 - epoch / epochs) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
                for name, g in self.gradients(x, mask, y[:, :, 0]).items():
                    g = np.clip(g, -1, 1)
                    first[name] = 0.9 * first[name] + 0.1 * g
                    second[name] = 0.999 * second[name] + 0.001 * g**2
                    self.p[name] -= (rate * first[name] / (np.sqrt(second[name]) + 1e-8)).astype(np.float32)
        return self

    def label(self, pages: list[np.ndarray]) -> list[np.ndarray]:
        """For each page's block vectors, which blocks are article."""
        out: list = [np.zeros(0, bool)] * len(pages)
        order = sorted((i for i in range(len(pages)) if len(pages[i])), key=lambda i: len(pages[i]))
        at = 0
        while at < len(order):
            to = at + 1  # pages of like length, and not too many cells
            while to < len(order) and to - at < PAGES_AT_ONCE and (to - at + 1) * len(pages[order[to]]) <= 65536 and len(pages[order[to]]) <= 1.3 * len(pages[order[at]]) + 2:
                to += 1
            x, mask = padded([pages[i] for i in order[at:to]])
            values = self.logits(x, mask) > 0
            for k, i in enumerate(order[at:to]):
                out[i] = values[:len(pages[i]), k]
            at = to
        return out


def padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    steps = max(len(p) for p in pages)
    x, mask = np.zeros((steps, len(pages), pages[0].shape[1]), np.float32), np.zeros((steps, len(pages)), np.float32)
    for i, p in enumerate(pages):
        x[:len(p), i], mask[:len(p), i] = p, 1
    return x, mask


def fit_labeller(pages: DataFrame, fit_pages: int = FIT_PAGES) -> BlockLabeller:
    """Train on about ``fit_pages`` pages, chosen by a hash of page_id, and their altered forms."""
    share = min(1.0, fit_pages / max(pages.count(), 1))
    chosen = pages.filter(F.pmod(F.xxhash64("page_id"), F.lit(1_000_000)) < int(share * 1_000_000)).select("page_id", "html")
    rows = sorted(chosen.filter("html is not null").collect(), key=lambda r: (str(r[0]), r[1]))
    marked = [[(b, markup_label(b.path)) for b in blocks(r[1])] for r in rows]
    marked = [p for p in marked if any(good for _, good in p)]
    pool = [b.text for p in marked for b, _ in p]
    if not pool:
        nothing = BlockLabeller()
        nothing.p["out_bias"] -= 100
        return nothing
    rng = np.random.default_rng(SEED)
    pages_seen = marked + [altered(p, pool, rng) for _ in range(VARIANTS) for p in marked]
    return BlockLabeller().fit([(vectors([b for b, _ in p]), np.array([g for _, g in p], np.float32)) for p in pages_seen])


def extract_text(pages: DataFrame, model: BlockLabeller) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    shared = pages.sparkSession.sparkContext.broadcast(model)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), PAGES_AT_ONCE):
                part = batch.slice(at, PAGES_AT_ONCE)
                cut = [blocks(page or "") for page in part.column(2).to_pylist()]
                bounds = np.concatenate([[0], np.cumsum([len(c) for c in cut])])
                x = vectors([b for c in cut for b in c])
                labels = shared.value.label([x[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)])
                texts = ["\n\n".join(b.text for b, good in zip(c, keep, strict=True) if good) for c, keep in zip(cut, labels, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                    ["page_id", "url", "text", "n_chars"],
                )

    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", "url", "html").mapInArrow(lean(extract), f"page_id {kind}, url string, text string, n_chars long")


@query("op7_html_text")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    pages = table(spark, sf_dir, "pages")
    return extract_text(pages, fit_labeller(pages))
