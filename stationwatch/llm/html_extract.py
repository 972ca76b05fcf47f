"""Main text of web pages by a linear-chain conditional random field over DOM leaf blocks.

A page is read into leaf blocks: runs of text between block-level tags, each
with its open ancestors. Features of a block are its ancestors' tags and the
words of their classes and ids, its length, its share of link text, its
punctuation and its place. The field has two labels, article and other; it is
trained by gradient on labelled pages and decoded by Viterbi. Labelled pages are
made from sentences of the corpus in many layouts, together with corpus pages
whose own markup (article, nav, footer, aside, ...) settles every block.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

#: Comments, CDATA, other declarations, and the beginning of tags.
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|</?([a-zA-Z][a-zA-Z0-9:-]*)", re.DOTALL)
#: Attributes up to the end of their tag. Quotes hold a ``>`` only after ``=``, and nothing is tried twice: time grows with the length.
TAG_REST = re.compile(r"((?:[^>=]|=(?:\s*+(?:\"[^\"]*\"|'[^']*'))?+)*+)>")
ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|style|aria-hidden)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.IGNORECASE)
# Fixed values of HTML: tags inside a line, tags without an end, tags whose content is no text of the page.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("script style noscript template textarea svg title select button iframe object canvas video audio map datalist annotation annotation-xml".split())
#: Of these the content is raw: without an end tag the rest of the page belongs to it, as in browsers.
RAW = frozenset("script style textarea title iframe".split())
_EDGE = {tag: re.compile(rf"<(/?){tag}(?=[\s/>])", re.IGNORECASE) for tag in SILENT}
#: Only these can close themselves; elsewhere browsers ignore the slash.
_FOREIGN = frozenset(["svg"])
_VALUE_END = re.compile(r"=\s*[^\s\"'=]+\Z")
#: Tags that end a formula left open.
_LEAVES_FORMULA = frozenset("p div article section main header footer nav aside body html table tr td th ul ol li dl dt dd h1 h2 h3 h4 h5 h6 blockquote pre form figure".split())
#: An opening tag of the first kind closes an open one of the second.
_CLOSES = {"li": "li", "dt": "dd", "dd": "dt", "tr": "tr", "td": "td", "th": "th", "option": "option"}
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)

Block = tuple[str, tuple[str, ...], float]  # text, ancestors' features, share of link text


def _features_of_tag(tag: str, attributes: str) -> tuple[str, ...]:
    out = [f"<{tag}"]
    if attributes and ("=" in attributes or "hidden" in attributes):
        for m in ATTRIBUTE.finditer(attributes):
            name, value = m[1].lower(), (m[2] or "").strip("\"'").lower()
            if name in ("class", "id", "role"):
                out += [f".{word}" for word in re.split(r"[^a-z]+", value) if word]
            elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and _HIDDEN.search(value):
                out.append("!hidden")
    return tuple(out)


def _closes_itself(attributes: str) -> bool:
    """A slash before the end of a tag, that is not the end of a value without quotes."""
    return attributes.endswith("/") and not _VALUE_END.search(attributes)


def _silent_end(page: str, tag: str, at: int) -> int | None:
    """Where an element that began before ``at`` ends, its like inside it counted; None if it doesn't. The content of a raw one has no elements."""
    depth = 1
    while m := _EDGE[tag].search(page, at):
        rest = TAG_REST.match(page, m.end())
        if rest is None:
            return None
        at = rest.end()
        if m[1]:
            depth -= 1
        elif tag not in RAW and not (tag in _FOREIGN and _closes_itself(rest[1])):
            depth += 1
        if not depth:
            return at
    return None


def leaf_blocks(page: str) -> list[Block]:
    """The blocks of a page in order. Unclosed and stray tags are read as browsers mostly do: a tag that never ends takes the rest of the page with it.

    Formulas are text of their paragraph, controls (buttons, lists to choose from) and drawings are none.
    """
    out: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    opened: Counter[str] = Counter()  # tags on the stack
    around: Counter[str] = Counter()  # their features
    endless: set[str] = set()  # silent tags of which no end follows
    parts: list[str] = []
    linked = at = links = formula = 0

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            parts.clear()
            if text:
                out.append((text, tuple(around), min(1.0, linked / len(text))))
        linked = 0

    def leave(k: int) -> None:
        """Close the stack down to its k-th element."""
        for tag, features in stack[k:]:
            opened[tag] -= 1
            around.subtract(features)
            for name in features:
                if not around[name]:
                    del around[name]
        del stack[k:]

    while True:
        m = TOKEN.search(page, at)
        piece = page[at : m.start()] if m else page[at:]
        if piece:
            parts.append(piece)
            if links:
                linked += len(piece.strip())
        if not m:
            break
        at = m.end()
        if m[1] is None:
            if m[0].startswith("<![CDATA["):
                parts.append(m[0][9:-3] if m[0].endswith("]]>") else m[0][9:])
            continue
        rest = TAG_REST.match(page, at)
        if rest is None:
            break
        at, tag, closing, attributes = rest.end(), m[1].lower(), m[0][1] == "/", rest[1]
        if tag == "math":
            formula = int(not closing)
            continue
        if tag in INLINE or formula and tag not in SILENT and tag not in _LEAVES_FORMULA:
            if tag == "br":
                parts.append(" ")
            elif tag == "a":
                links = 0 if closing else 1
            continue
        if not closing and tag in SILENT:
            if tag in _FOREIGN and _closes_itself(attributes):
                continue
            end = None if tag in endless else _silent_end(page, tag, at)
            if end is not None:
                at = end
            elif tag in RAW:
                break
            else:
                endless.add(tag)
            continue
        flush()
        formula = 0
        if closing:
            if opened[tag]:
                leave(next(k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == tag))
            links = 0
            continue
        if stack and (stack[-1][0] == "p" or tag in _CLOSES and stack[-1][0] in (tag, _CLOSES[tag])):
            leave(len(stack) - 1)
        if tag not in VOID:
            features = tuple(dict.fromkeys(_features_of_tag(tag, attributes)))
            stack.append((tag, features))
            opened[tag] += 1
            around.update(features)
    flush()
    return out


# -------------------------------------------------------------------- features

_HASHED = 1 << 14
_SIZES = (2, 5, 10, 20, 40, 80, 160)


def block_features(block: Block, before: Block | None, after: Block | None) -> list[str]:
    text, ancestors, links = block
    words = text.count(" ") + 1
    size = sum(words >= s for s in _SIZES)
    marks = sum(text.count(c) for c in ".,!?;:")
    own = [f"size{size}", f"links{int(links * 3.99)}", f"marks{min(4, int(20 * marks / words))}", f"stop{text[-1] in '.!?…'}", f"copyright{'©' in text[:40]}"]
    out = ["bias", *own, *ancestors]
    out += [f"{a}|{own[0]}" for a in ancestors if a in ("<p", "<div", "<li", "<td", "<h1", "<h2", "<h3", "<body")]
    for name, other in (("before", before), ("after", after)):
        if other is None:
            out.append(f"{name}none")
        else:
            out += [f"{name}links{int(other[2] * 3.99)}", f"{name}size{sum(other[0].count(' ') + 1 >= s for s in _SIZES) // 2}"]
            out.append(f"{name}same{set(ancestors) == set(other[1])}")
    return out


_slots: dict[str, int] = {}


def _slot(name: str) -> int:
    at = _slots.get(name)
    if at is None:
        value = 1469598103934665603
        for byte in name.encode():
            value = ((value ^ byte) * 1099511628211) & 0xFFFFFFFFFFFFFFFF
        at = (value >> 20) % _HASHED
        if len(_slots) < 200_000:
            _slots[name] = at
    return at


def encode(blocks: list[Block]) -> list[list[int]]:
    n = len(blocks)
    return [[_slot(f) for f in block_features(b, blocks[i - 1] if i else None, blocks[i + 1] if i + 1 < n else None)] for i, b in enumerate(blocks)]


# ----------------------------------------------------------------------- field


@dataclass
class ChainField:
    """Scores of two labels by hashed feature, and of label pairs; label 1 is article."""

    weights: np.ndarray
    moves: np.ndarray

    def emissions(self, encoded: list[list[int]]) -> np.ndarray:
        flat = np.fromiter((f for block in encoded for f in block), np.int64)
        starts = np.concatenate([[0], np.cumsum([len(block) for block in encoded])[:-1]])
        return np.add.reduceat(self.weights[flat], starts, axis=0)

    def decode(self, blocks: list[Block]) -> np.ndarray:
        """The likeliest labels by Viterbi."""
        if not blocks:
            return np.zeros(0, np.int64)
        e = self.emissions(encode(blocks)).tolist()
        (m00, m01), (m10, m11) = self.moves.tolist()
        a, b, back = e[0][0], e[0][1], []
        for x, y in e[1:]:
            to0, to1 = b + m10 > a + m00, b + m11 > a + m01
            a, b = (b + m10 if to0 else a + m00) + x, (b + m11 if to1 else a + m01) + y
            back.append((to0, to1))
        label = int(b > a)
        out = [label]
        for step in reversed(back):
            label = int(step[label])
            out.append(label)
        return np.array(out[::-1])


def train_field(pages: list[tuple[list[Block], list[int]]], epochs: int = 15, rate: float = 0.1, ridge: float = 1e-5, seed: int = 3) -> ChainField:
    """Maximum conditional likelihood by AdaGrad over single pages, with expectations from forward and backward sums."""
    field = ChainField(np.zeros((_HASHED, 2)), np.zeros((2, 2)))
    seen_w, seen_m = np.full((_HASHED, 2), 1e-8), np.full((2, 2), 1e-8)
    data = [(encode(blocks), np.array(labels)) for blocks, labels in pages if blocks]
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for k in rng.permutation(len(data)):
            encoded, labels = data[k]
            n = len(encoded)
            e = field.emissions(encoded)
            forward, backward = np.empty((n, 2)), np.zeros((n, 2))
            forward[0] = e[0]
            for t in range(1, n):
                forward[t] = np.logaddexp(forward[t - 1, 0] + field.moves[0], forward[t - 1, 1] + field.moves[1]) + e[t]
            for t in range(n - 2, -1, -1):
                step = field.moves + e[t + 1] + backward[t + 1]
                backward[t] = np.logaddexp(step[:, 0], step[:, 1])
            total = np.logaddexp(*forward[-1])
            p = np.exp(forward + backward - total)
            p[np.arange(n), labels] -= 1
            flat = np.fromiter((f for block in encoded for f in block), np.int64)
            gradient = np.repeat(p, [len(block) for block in encoded], axis=0)
            rows, where = np.unique(flat, return_inverse=True)
            g = np.zeros((len(rows), 2))
            np.add.at(g, where, gradient)
            g += ridge * field.weights[rows]
            seen_w[rows] += g * g
            field.weights[rows] -= rate * g / np.sqrt(seen_w[rows])
            if n > 1:
                pair = np.exp(forward[:-1, :, None] + field.moves + (e[1:] + backward[1:])[:, None, :] - total).sum(0)
                np.add.at(pair, (labels[:-1], labels[1:]), -1)
                seen_m += pair * pair
                field.moves -= rate * pair / np.sqrt(seen_m)
    return field


# --------------------------------------------------------------- labelled pages

_OTHER_MARKS = frozenset("<nav <header <footer <aside <form <head <menu !hidden .ad .ads .advert .nav .menu .sidebar .footer .comments .comment .cookie .notice .related .share".split())


def settled_by_markup(blocks: list[Block]) -> list[int] | None:
    """Labels of a page that has one clear article element; None if its markup doesn't settle it."""
    if not any("<article" in b[1] for b in blocks):
        return None
    return [int("<article" in b[1] and not _OTHER_MARKS.intersection(b[1])) for b in blocks]


def made_pages(sentences: list[str], n: int, seed: int = 5) -> list[tuple[list[Block], list[int]]]:
    """n labelled pages of given sentences in random layouts: semantic elements, classed divisions, tables and bare bodies."""
    rng = np.random.default_rng(seed)
    pick = lambda *seq: seq[int(rng.integers(len(seq)))]
    say = lambda low, high: " ".join(html.escape(sentences[int(rng.integers(len(sentences)))], quote=False) for _ in range(int(rng.integers(low, high))))
    short = lambda k=3: html.escape(" ".join(sentences[int(rng.integers(len(sentences)))].split()[:k]), quote=False)
    links = lambda low, high: "".join(f'<li><a href="/{i}">{short()}</a></li>' for i in range(int(rng.integers(low, high))))
    out = []
    for _ in range(n):
        style = pick("semantic", "classed", "classed", "table", "bare")
        box = lambda tag, word, body: f"<{tag}>{body}</{tag}>" if style == "semantic" and tag != "div" else f'<div {pick("class", "id")}="{word}">{body}</div>'
        before, after = [], []
        if rng.random() < 0.85:
            before.append(box("header", pick("header", "top", "masthead", "site-header", "banner"), f"<div>{short(4)}</div>" + (f"<p>{short(6)}</p>" if rng.random() < 0.5 else "")))
        if rng.random() < 0.9:
            before.append(box("nav", pick("nav", "menu", "navbar", "navigation", "breadcrumb"), f"<ul>{links(3, 9)}</ul>"))
        if rng.random() < 0.4:
            before.append(box("div", pick("cookie-notice", "notice", "alert", "banner", "consent"), f"<p>{say(1, 3)}</p>"))
        extras = {
            "ad": lambda: box("div", pick("ad", "ads", "advert", "sponsored", "promo", "banner-ad"), say(1, 3)),
            "aside": lambda: box("aside", pick("sidebar", "side", "widget", "right-col"), f"<h3>{short()}</h3><ul>{links(2, 7)}</ul><p>{say(1, 2)}</p>"),
            "related": lambda: box(pick("section", "aside"), pick("related", "recommended", "more", "see-also"), f"<h2>{short()}</h2><ul>{links(2, 6)}</ul>"),
            "comments": lambda: box("section", pick("comments", "discussion", "responses", "replies"), f"<h3>{short(2)}</h3>" + "".join(
                f'<div class="{pick("comment", "reply", "response")}"><b>{short(1)}</b><p>{say(1, 4)}</p></div>' for _ in range(int(rng.integers(1, 6))))),
            "form": lambda: f"<form><label>{short(2)}</label><input><p>{short(5)}</p><button>{short(1)}</button></form>",
            "share": lambda: box("div", pick("share", "social", "tools"), " ".join(f'<a href="#">{short(1)}</a>' for _ in range(3))),
        }
        names = list(extras)
        for name in rng.choice(names, int(rng.integers(0, 5)), replace=False):
            (before if rng.random() < 0.3 and name != "comments" else after).append(extras[name]())
        after.append(box("footer", pick("footer", "bottom", "site-footer", "copyright"), f"&copy; {short(2)} &middot; {say(1, 3)}" if rng.random() < 0.6 else f"<p>{short(5)}</p><ul>{links(1, 4)}</ul>"))
        body, stranger = [], "\ue001"  # private use: marks text that isn't the article's
        for i in range(int(rng.integers(1, 12))):
            kind = rng.random()
            paragraph = f"<p>{say(1, 7)}" + ("</p>" if rng.random() < 0.9 else "")
            if kind < 0.08:
                paragraph = f"<{pick('h2', 'h3')}>{short(6)}</{pick('h2', 'h3')}>"
            elif kind < 0.14:
                paragraph = f"<ul>{''.join(f'<li>{say(1, 2)}</li>' for _ in range(int(rng.integers(2, 6))))}</ul>"
            elif kind < 0.18:
                paragraph = f"<blockquote><p>{say(1, 3)}</p></blockquote>"
            elif kind < 0.22:
                paragraph = f'<p>{say(1, 2)} <a href="/x">{short(2)}</a> {say(1, 3)}</p>'
            elif kind < 0.25:
                paragraph = f"<p>{short(2)}</p>"
            elif kind < 0.29:  # not the article's, though inside its element
                paragraph = extras[pick("ad", "aside", "related", "share", "form")]().replace(">", f">{stranger}")
            body.append(paragraph)
        if rng.random() < 0.15:
            body.append(extras["comments"]().replace(">", f">{stranger}"))
        article = (f"<{pick('h1', 'h1', 'h2')}>{short(8)}</h1>" if rng.random() < 0.85 else "") + "".join(body)
        if style == "semantic":
            article = f"<main>{article}</main>" if rng.random() < 0.3 else f"<article>{article}</article>"
        elif style == "classed":
            article = f'<div {pick("class", "id")}="{pick("content", "post", "entry", "article", "story", "main", "post-body", "text")}">{article}</div>'
        elif style == "table":
            article = f"<table><tr><td>{article}</td></tr></table>"
        mark = "\ue000"  # private use: marks the article's text
        article = re.sub(r">(?=[^<])", f">{mark}", article)
        blocks = leaf_blocks(f"<html><head><title>{short(6)}</title></head><body>{''.join(before)}{article}{''.join(after)}</body></html>")
        labels = [int(mark in b[0] and stranger not in b[0]) for b in blocks]
        blocks = [(b[0].replace(mark, "").replace(stranger, ""), b[1], b[2]) for b in blocks]
        out.append(([b for b in blocks if b[0]], [label for b, label in zip(blocks, labels, strict=True) if b[0]]))
    return out


def fit(pages: DataFrame, sample: int = 250, made: int = 700, page_bytes: int = 1 << 17) -> ChainField:
    """Train on ``made`` made pages, whose sentences come from the ``sample`` corpus pages of at most ``page_bytes`` bytes
    whose ids hash lowest, and on those of them that their markup settles. So at most ``sample * page_bytes`` bytes are learned from."""
    short = pages.where((F.octet_length("html") <= page_bytes) & F.col("page_id").isNotNull()).select("page_id", F.xxhash64("page_id").alias("draw"), F.xxhash64("html").alias("same"), "html")
    ids = short.select("draw", "page_id", "same").distinct().orderBy("draw", "page_id", "same").limit(sample)
    rows = short.join(F.broadcast(ids), ["draw", "page_id", "same"], "left_semi").dropDuplicates(["draw", "page_id", "same"]).orderBy("draw", "page_id", "same").select("html").collect()
    labelled, sentences = [], []
    for row in rows:
        blocks = leaf_blocks(row["html"])
        labels = settled_by_markup(blocks)
        if blocks and labels is not None:
            labelled.append((blocks, labels))
        sentences += [s for text, _, _ in blocks for s in re.split(r"(?<=[.!?])\s+", text) if s]
    sentences = sentences or ["No page could be read, so this sentence stands in for all."]
    return train_field(labelled + made_pages(sentences, made))


def main_text(page: str | None, field: ChainField) -> str:
    """The article blocks of a page in order, joined by single spaces."""
    blocks = [b for b in leaf_blocks(page or "") if "!hidden" not in b[1]]
    return " ".join(b[0] for b, label in zip(blocks, field.decode(blocks), strict=True) if label)


def extract(pages: DataFrame, field: ChainField | None = None) -> DataFrame:
    """Every row of ``pages`` with ``text``, its main text; empty for null, empty and text-free pages.

    Ids and urls play no part in it; repeated rows are read one by one. A column
    named ``text`` is replaced.
    """
    field = fit(pages) if field is None else field
    keep = [c for c in pages.columns if c != "text"]
    shared = pages.sparkSession.sparkContext.broadcast(field)  # _HASHED rows of two numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, _, _ in slices(batches, "html"):
            texts = [main_text(value.as_py(), shared.value) for value in batch.column("html")]
            yield pa.RecordBatch.from_pydict({c: batch.column(c) for c in keep} | {"text": pa.array(texts, pa.string())})

    return pages.select(*keep).mapInArrow(run, pages.select(*keep, F.lit("").alias("text")).schema)
