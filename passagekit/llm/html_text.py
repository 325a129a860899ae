"""Main text of HTML pages by a recurrent labeller of leaf blocks.

A page becomes the sequence of its leaf blocks: texts between block-level tags, each with its tag path.  A bidirectional
LSTM reads hashed tag-path and word vectors of the whole sequence and labels every block as article or not.  It is
trained on pages from a generator of common page layouts, whose labels are known by construction.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import recurrent
from .common import map_batches, slices
from .textkit import words

PATH, WORD, EXTRA, HIDDEN = 96, 48, 8, 20
SCHEMA = "page_id long, url string, text string, n_chars long"

NAME = re.compile(r"</?([a-z][^\s/>]*)", re.I)
MARK = re.compile(r"[\"'>]")
TO_THE_END = frozenset(["script", "style", "iframe", "textarea"])  # where their end tag is missing, as in browsers
TO_ITS_END = frozenset(["noscript", "template", "svg", "select"])  # skipped only where they end
ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
IN_HEAD = frozenset("base basefont bgsound head html link meta noframes noscript script style template title".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())


class Node:
    """An open element: its name, and the hashed marks of it and all elements around it."""

    __slots__ = ("name", "around", "marks")

    def __init__(self, name: str, marks: tuple[str, ...], outer: Node | None):
        self.name, self.marks = name, marks
        self.around = _marked(name, marks, False) if outer is None else outer.around + _marked(name, marks, False)

    def path(self, outer: Node | None) -> np.ndarray:
        """The hashed tag path of a text that stands in this element itself."""
        leaf = _marked(self.name, self.marks, True)
        return leaf if outer is None else outer.around + leaf


@lru_cache(maxsize=20_000)
def _marked(name: str, marks: tuple[str, ...], leaf: bool) -> np.ndarray:
    row = np.zeros(PATH, np.float32)
    if name not in ("html", "body") or marks:
        for token in (f"{'leaf' if leaf else 'over'} {name}", name, *(f".{x}" for x in marks)):
            row[zlib.crc32(token.encode()) % PATH] += 1
    return row


_NOWHERE = np.zeros(PATH, np.float32)


class Block:
    __slots__ = ("path", "text", "linked")

    def __init__(self, path: np.ndarray, text: str, linked: int):
        self.path, self.text, self.linked = path, text, linked


class Markup:
    """The tags of a page, in one pass: work grows with the page's length whatever is broken in it.

    What was searched once and is not there is not searched again: no end tag, no further quotation mark.  A quotation mark
    without a partner is an ordinary character; a tag that the page's end cuts off takes the rest of the page.
    """

    def __init__(self, html: str):
        self.html, self.missing = html, set()

    def _tag_end(self, at: int) -> int:
        """Behind the tag's bracket, or -1."""
        while m := MARK.search(self.html, at):
            at = m.end()
            if m[0] == ">":
                return at
            if m[0] not in self.missing:
                partner = self.html.find(m[0], at)
                if partner < 0:
                    self.missing.add(m[0])
                else:
                    at = partner + 1
        return -1

    def _past_end_tag(self, name: str, at: int) -> int:
        """Behind the next end tag of this name, or -1."""
        if name in self.missing:
            return -1
        m = re.compile(rf"</{name}\s*>", re.I).search(self.html, at)
        if m is None:
            self.missing.add(name)
            return -1
        return m.end()

    def tags(self) -> Iterator[tuple[int, int, str, bool, str]]:
        """(start, end, name, is an end tag, attributes); name is empty for what is no tag, and ``skip`` for an element that
        is passed over with all in it."""
        html, at = self.html, 0
        while (start := html.find("<", at)) >= 0:
            m = NAME.match(html, start)
            if m is None:
                if html.startswith("<!--", start):
                    end = html.find("-->", start + 4)
                    at = end + 3 if end >= 0 else len(html)
                elif html[start + 1 : start + 2] in ("!", "?", "/"):
                    end = html.find(">", start)
                    at = end + 1 if end >= 0 else len(html)
                else:  # a sign in a text
                    at = start + 1
                    continue
                yield start, at, "", False, ""
                continue
            name, closing = m[1].lower(), html[start + 1] == "/"
            end = self._tag_end(m.end())
            if end < 0:
                yield start, len(html), name, closing, html[m.end() :]
                return
            rest = html[m.end() : end - 1]
            at = end
            if not closing:
                if name in TO_THE_END:
                    past = self._past_end_tag(name, end)
                    at = past if past >= 0 else len(html)
                    name = "skip"
                elif name == "svg" and rest.endswith("/"):
                    name = ""
                elif name in TO_ITS_END and (past := self._past_end_tag(name, end)) >= 0:
                    at, name = past, "" if name == "svg" else "skip"
                elif name == "title":
                    at = max(end, html.find("<", end)) if html.find("<", end) >= 0 else len(html)
                    if close := re.compile(r"</title\s*>", re.I).match(html, at):
                        at = close.end()
                    name = ""
            yield start, at, name, closing, rest


def leaf_blocks(html: str) -> list[Block]:
    """The non-empty leaf blocks in page order.  Broken markup is read leniently; a tag cut off at the end is none.

    Only script, style, iframe and textarea run to the page's end where their end tag is missing, as in browsers; an open
    head ends at the first tag that belongs to the body, and a closed-in-itself svg is empty.  Work is linear in the page.
    """
    blocks: list[Block] = []
    stack: list[Node] = []
    parts: list[str] = []
    where: np.ndarray | None = None
    linked = in_link = at = 0
    opened: Counter[str] = Counter()  # open elements by name

    def close() -> None:
        nonlocal parts, linked, where
        if parts:
            if text := " ".join(unescape("".join(parts)).split()):
                blocks.append(Block(where, text, linked))
        parts, linked, where = [], 0, None

    def say(raw: str) -> None:
        nonlocal linked, where
        if raw:
            if where is None:
                where = stack[-1].path(stack[-2] if len(stack) > 1 else None) if stack else _NOWHERE
            parts.append(raw)
            linked += len(raw) if in_link else 0

    def pop(name: str) -> None:
        nonlocal in_link
        while opened[name]:  # an unmatched end tag costs nothing
            gone = stack.pop().name
            opened[gone] -= 1
            in_link -= gone == "a"
            if gone == name:
                return

    for start, end, name, closing, rest in Markup(html).tags():
        say(html[at:start])
        at = end
        if name == "skip":
            close()
        if name in ("", "skip"):
            continue
        if name not in INLINE:
            close()
        if closing:
            pop(name)
            continue
        if name not in IN_HEAD and any(x.name == "head" for x in stack[:2]):
            pop("head")
        if name in VOID or rest.endswith("/") and name in INLINE:
            continue
        if name in CLOSES_P and any(x.name == "p" for x in stack[-4:]):
            pop("p")
        if name in ("li", "dt", "dd", "tr", "td", "th", "option") and stack and stack[-1].name == name:
            pop(name)
        if name == "a":
            if in_link:
                pop("a")
            in_link += 1
        marks = tuple(t for _, *v in ATTRIBUTE.findall(rest) for t in re.split(r"[^a-z]+", "".join(v).lower()) if t) if rest else ()
        stack.append(Node(name, marks, stack[-1] if stack else None))
        opened[name] += 1
    say(html[at:])
    close()
    return blocks


def features(pages: list[list[Block]]) -> list[np.ndarray]:
    """For each page: blocks x (hashed tag path, hashed words, sizes)."""
    flat = [b for page in pages for b in page]
    if not flat:
        return [np.zeros((0, PATH + WORD + EXTRA), np.float32) for _ in pages]
    x = np.zeros((len(flat), PATH + WORD + EXTRA), np.float32)
    x[:, :PATH] = np.minimum([b.path for b in flat], 2)
    w = words(pa.array([b.text for b in flat]), lower=True)
    bag = np.bincount(w.doc * WORD + (w.hash % np.uint64(WORD)).astype(np.int64), minlength=len(flat) * WORD).reshape(-1, WORD)
    count = np.diff(w.first)
    x[:, PATH : PATH + WORD] = np.sqrt(bag / np.maximum(count, 1)[:, None])
    size = np.array([len(b.text) for b in flat])
    place = np.concatenate([np.arange(len(p)) / max(1, len(p) - 1) for p in pages])
    x[:, PATH + WORD :] = np.stack(
        [
            np.log1p(size) / 5,
            np.log1p(count) / 4,
            np.minimum(1, np.array([b.linked for b in flat]) / np.maximum(size, 1)),
            [b.text[-1] in ".!?:;\"'" for b in flat],
            [any(c in b.text for c in "©®|·»") for b in flat],
            np.array([sum(map(str.isdigit, b.text)) for b in flat]) / np.maximum(size, 1),
            place,
            [b.text[:1].isupper() for b in flat],
        ],
        axis=1,
    )
    return np.split(x, np.cumsum([len(p) for p in pages])[:-1])


# --- training pages ------------------------------------------------------------------------------------------------

_ARTICLE = ["<article>", "<main>", '<div class="content">', '<div id="main-content">', '<section class="post">', '<div class="entry-content">', '<div class="article-body">', '<article class="story">', "<main><article>", '<div id="page">', '<div id="story">', '<div class="wrapper"><article>', '<div id="content"><div class="text">', "<div>"]
_MENU = ['<nav>', '<div class="menu">', '<ul class="nav">', '<div id="navigation">', '<header><nav>', '<div class="breadcrumb">', '<nav role="navigation">', '<div class="topbar">']
_SIDE = ['<aside>', '<div class="sidebar">', '<div class="related">', '<aside class="widget">', '<div id="side">', '<section class="recommended">', '<div class="share social">', '<div class="tags">']
_ADVERT = ['<div class="ad">', '<div class="ads banner">', '<div id="advert">', '<div class="sponsored">', '<aside class="promo">', '<div class="advertisement">']
_NOTICE = ['<div class="cookie">', '<div id="cookie-banner">', '<div class="notice">', '<div class="alert">', '<div class="newsletter">', '<div role="dialog" class="consent">', '<p class="notice">']
_COMMENT = ['<section id="comments">', '<div class="comment-list">', '<div class="comments">', '<ol class="commentlist">', '<div id="disqus">', '<section class="responses">', '<div id="respond">', '<div class="discussion">', '<ul class="replies">', '<section id="reactions">', '<div class="thread">', '<div id="reader-talk">']
_FOOTER = ['<footer>', '<div class="footer">', '<div id="footer">', '<footer class="site-footer">', '<div class="copyright">']
_HEADER = ['<header>', '<div class="header">', '<div id="masthead">', '<header class="site">', '<div class="logo">']


def _closing(opening: str) -> str:
    return "".join(f"</{t}>" for t in reversed(re.findall(r"<(\w+)", opening)))


def training_page(rng: np.random.Generator) -> list[tuple[str, bool]]:
    """Pieces of a page with their labels, by a random layout and random words."""
    letters = list("etaoinshrdlcumwfgypbvkéèüöäñóß")

    def word() -> str:
        return "".join(rng.choice(letters, int(rng.integers(1, 11))))

    vocabulary = [word() for _ in range(60)]

    def prose(least: int, most: int, stop: bool = True) -> str:
        out = [str(x) for x in rng.choice(vocabulary, int(rng.integers(least, most + 1)))]
        if not out:
            return ""
        out[0] = out[0].capitalize()
        noise = rng.random()
        if noise < 0.08:
            out = [x + "&amp;" * int(rng.integers(0, 3)) for x in out]
        elif noise < 0.14:
            out = [f"{x} |" for x in out]
        return " ".join(out) + ("." if stop and rng.random() < 0.9 else "")

    def pick(options: list[str]) -> str:
        return options[int(rng.integers(len(options)))]

    def links(opening: str, n: int) -> list[tuple[str, bool]]:
        rows = "".join(f'<li><a href="/{pick(vocabulary)}">{prose(1, 4, False)}</a></li>' for _ in range(n))
        return [(f"{opening}{f'<ul>{rows}</ul>' if 'ul' not in opening else rows}{_closing(opening)}", False)]

    def some(p: float) -> bool:
        return rng.random() < p

    page: list[tuple[str, bool]] = []
    if some(0.04):  # a page of bare text
        return [(pick(["<br>", "<br><br>", "\n<p>"]).join(prose(3, 60) for _ in range(int(rng.integers(1, 6)))), True)]
    if some(0.5):
        o = pick(_HEADER)
        page.append((f"{o}{pick(['<h1>', '<p>', '<a href=\"/\">'])}{prose(1, 5, False)}{_closing(o)}", False))
    if some(0.85):
        page += links(pick(_MENU), int(rng.integers(2, 9)))
    if some(0.25):
        o = pick(_NOTICE)
        page.append((f"{o}{prose(4, 25)} <button>{prose(1, 2, False)}</button>{_closing(o)}", False))
    if some(0.6):
        o = pick(_ADVERT)
        page.append((f"{o}{pick(['', '<p>'])}{prose(2, 25)}{_closing(o)}", False))
    if some(0.2):
        page += links(pick(_SIDE), int(rng.integers(1, 6)))
    o = pick(_ARTICLE)
    page.append((o, True))
    if some(0.85):
        page.append((f"<{(h := pick(['h1', 'h2']))}>{prose(1, 14, False)}</{h}>", True))
    para = "p" if some(0.9) else "div"
    for _ in range(int(rng.integers(1, 50 if some(0.15) else 14))):
        kind, text = rng.random(), prose(1, int(rng.choice([3, 12, 60, 150])))
        if kind < 0.6:
            page.append((f"<{para}>{text}</{para}>", True))
        elif kind < 0.65:
            page.append((f"<div>{text}</div>", True))
        elif kind < 0.75:
            page.append((f"<p><b>{text}<br>", True))
        elif kind < 0.82:
            page.append((f"<ul><li>{text}</li><li>{prose(1, 20)}</li></ul>", True))
        elif kind < 0.88:
            page.append((f"<blockquote>{text}</blockquote>", True))
        elif kind < 0.93:
            page.append((f"<h3>{prose(1, 6, False)}</h3>", True))
        elif kind < 0.945:
            page.append((f'<p>{text} <a href="#">{prose(1, 4, False)}</a> {prose(2, 20)}</p>', True))
        elif kind < 0.96:
            page.append((f'<figure><img src="a.png"><figcaption>{prose(1, 20)}</figcaption></figure>', True))
        elif kind < 0.97:
            page.append((f"<table><tr><th>{prose(1, 3, False)}</th><th>{prose(1, 3, False)}</th></tr><tr><td>{prose(1, 6, False)}</td><td>{prose(1, 6)}</td></tr></table>", True))
        else:
            a = pick(_ADVERT + _SIDE)
            page.append((f"{a}{prose(1, 12)}{_closing(a)}", False))
    page.append((_closing(o), True))
    if some(0.3):
        page += links(pick(_SIDE), int(rng.integers(2, 7)))
    if some(0.3):
        o = pick(_COMMENT)
        one = pick(['<div class="comment"><p>', '<div class="comment"><p>', "<li><p>", '<div class="reply">', "<p>", '<div class="post"><b>', "<article><p>"])
        head = f"<h3>{prose(1, 4, False)}</h3>" if some(0.4) else ""
        page.append((o + head + "".join(f"{one}{prose(2, 40)}{_closing(one)}" for _ in range(int(rng.integers(1, 6)))) + _closing(o), False))
    if some(0.25):
        page.append((f"<form><label>{prose(1, 3, False)}</label><input><p>{prose(1, 10)}</p><button>{prose(1, 2, False)}</button></form>", False))
    if some(0.9):
        o = pick(_FOOTER)
        page.append((f"{o}{pick(['&copy; ', '', 'Copyright 2020 '])}{prose(1, 12)}{pick(['', ' &middot; ' + prose(1, 5)])}{_closing(o)}", False))
    return page


def training_set(pages: int, seed: int) -> tuple[list[list[Block]], list[np.ndarray]]:
    rng, out, labels = np.random.default_rng(seed), [], []
    for _ in range(pages):
        pieces = training_page(rng)
        marked = "".join(re.sub(r">([^<]*[^<\s][^<]*)", lambda m, k=k: f">{'Q' if k else 'X'}\x02{m[1]}", ">" + html)[1:] for html, k in pieces)
        blocks = leaf_blocks(f"<html><body>{marked}</body></html>")
        label = np.array([b.text[0] == "Q" for b in blocks])
        for b in blocks:
            b.text = re.sub("[QX]\x02", "", b.text).strip() or "x"
        out.append(blocks)
        labels.append(label)
    return out, labels


def _padded(xs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    steps = max(len(x) for x in xs)
    out, mask = np.zeros((len(xs), steps, xs[0].shape[1]), np.float32), np.zeros((len(xs), steps), np.float32)
    for i, x in enumerate(xs):
        out[i, : len(x)], mask[i, : len(x)] = x, 1
    return out, mask


@lru_cache(maxsize=1)
def model(pages: int = 900, epochs: int = 8, seed: int = 10) -> recurrent.Params:
    """Train the labeller; the same parameters each time."""
    blocks, labels = training_set(pages, seed)
    xs = features(blocks)
    p = recurrent.init(PATH + WORD + EXTRA, HIDDEN, 1, seed)
    adam, rng = recurrent.Adam(p, 0.012), np.random.default_rng(seed)
    for epoch in range(epochs):
        adam.rate = 0.012 * 0.75**epoch
        order = rng.permutation(len(xs))
        for lo in range(0, len(xs), 32):
            own = order[lo : lo + 32]
            x, mask = _padded([xs[i] for i in own])
            # words and unknown marks must not decide alone
            x[:, :, PATH : PATH + WORD] *= rng.random((len(own), 1, 1)) < 0.5
            y = np.zeros(mask.shape, np.float32)
            for k, i in enumerate(own):
                y[k, : len(labels[i])] = labels[i]

            def loss(s: np.ndarray, y=y, mask=mask) -> tuple[float, np.ndarray]:
                q = 1 / (1 + np.exp(-np.clip(s[:, :, 0], -30, 30)))
                n = mask.sum()
                value = -(mask * (y * np.log(q + 1e-7) + (1 - y) * np.log(1 - q + 1e-7))).sum() / n
                return float(value), (mask * (q - y) / n)[:, :, None]

            adam.step(recurrent.gradients(p, x, mask, loss)[1])
    return p


def label(p: recurrent.Params, pages: list[list[Block]]) -> list[np.ndarray]:
    """Which blocks of each page are article, reading pages of like length together."""
    xs = features(pages)
    out = [np.zeros(0, bool)] * len(pages)
    order = sorted((i for i in range(len(pages)) if len(pages[i])), key=lambda i: len(pages[i]))
    lo = 0
    while lo < len(order):
        hi = lo + 1
        while hi < len(order) and (hi - lo + 1) * len(pages[order[hi]]) <= 16_384:
            hi += 1
        own = order[lo:hi]
        x, mask = _padded([xs[i] for i in own])
        score = recurrent.forward(p, x, mask)[:, :, 0]
        for k, i in enumerate(own):
            out[i] = score[k, : len(pages[i])] > 0
        lo = hi
    return out


def main_text(df: DataFrame) -> DataFrame:
    """(page_id, url, html) -> page_id, url, text, n_chars: the article's blocks joined by one space.

    Null, empty and text-free pages give an empty text.  Pages are read whole, however long or deep; repeated rows give
    repeated results; null ids and addresses stay null; further columns are not read; an empty table gives an empty
    result.
    """
    p = df.sparkSession.sparkContext.broadcast(model())  # about 100 kB

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for part in slices(batch, "html"):
            pages = [leaf_blocks(x or "") for x in part.column(2).to_pylist()]
            texts = [" ".join(b.text for b, ok in zip(page, own.tolist(), strict=True) if ok) for page, own in zip(pages, label(p.value, pages), strict=True)]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return map_batches(df, run, SCHEMA)


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return main_text(pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html"))
