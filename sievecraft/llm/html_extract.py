"""Main text of pages: a linear-chain conditional random field over the leaf blocks of the DOM.

Features of a block are its ancestor tags with the words of their class, id and role, how much of the page's text and links those hold, and the
shape of its text. What an element with most of the page's text is called is a feature of its own, so wrappers say little. The two labels are text and boilerplate; neighbouring labels are coupled by transition weights, and Viterbi
finds the best labelling. The weights are fitted by maximum likelihood (forward-backward) on labelled
pages: by default on pages made here from a fixed seed, whose layouts and names vary; ``train`` takes any others.
"""

from __future__ import annotations

import math
import random
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievecraft.llm.common import table
from sievecraft.llm.html_blocks import Block, Element, measure, read

EPOCHS = 12
RATE = 0.3
DECAY = 1e-4
TRAINING_PAGES = 2500
HINTS = re.compile(
    r"©|\b(?:cookies?|privacy|rights reserved|copyright|subscribe|sign ?(?:up|in)|log ?in|newsletter|advert\w*|sponsored|share|comments?|repl(?:y|ies)|posted by|terms|menu|skip to|read more|related)\b",
    re.I,
)


def path_features(block: Block, total: int) -> list[str]:
    """Tags and names of all elements around a block, each once, and features of the nearest."""
    return [f for e in block.around() for f in e.new] + near_features(block, total)


def near_features(block: Block, total: int) -> list[str]:
    """The nearest three tags, and of the two elements around the innermost the share of the page's text and of links in them."""
    made = []
    for k, e in enumerate(islice(block.around(), 3)):
        made.append(f"{k} up {e.token.split(' ', 1)[0]}")
        if k:
            made.append(f"{k} up share {min(5, (total // max(1, e.size)).bit_length())}")
            made.append(f"{k} up links {min(3, 4 * e.linked // max(1, e.size))}")
    return made


def text_features(block: Block, place: float) -> list[str]:
    n, words = len(block.text), block.text.count(" ") + 1
    made = ["any", f"words {min(6, words.bit_length())}", f"links {min(3, round(3 * block.linked / max(1, n)))}"]
    if block.text[-1] in ".!?…\"'”":
        made.append("ends")
    if place < 0.1 or place > 0.9:
        made.append("first" if place < 0.1 else "last")
    if HINTS.search(block.text):
        made.append("hint" if words < 25 else "hint in long text")
    return made


def measured(page: str) -> tuple[list[Block], int]:
    """The blocks of a page, whose elements have their features, and the characters of all."""
    found, elements = read(page)
    measure(found, elements)
    return found, sum(len(b.text) for b in found)


class Field:
    """Weights of a two-label chain: label 1 is text. Only differences to label 0 are kept for features."""

    def __init__(self, weights: dict[str, float], transitions: list[list[float]]):
        self.weights, self.transitions = weights, transitions

    def emissions(self, page: list[Block], total: int) -> list[float]:
        """Scores of label 1. An element's weight is its parent's and its own new features', so deep nesting costs each element once."""
        weigh, made, known = self.weights.get, [], {}

        def around(element: Element | None) -> float:
            fresh = []
            while element and id(element) not in known:
                fresh.append(element)
                element = element.parent
            total = known[id(element)] if element else 0.0
            for e in reversed(fresh):
                total = known[id(e)] = total + sum(weigh(f, 0.0) for f in e.new)
            return total

        for k, block in enumerate(page):
            shape = near_features(block, total) + text_features(block, k / len(page))
            made.append(around(block.within) + sum(weigh(f, 0.0) for f in shape))
        return made

    def decode(self, page: list[Block], total: int) -> list[int]:
        """Viterbi."""
        (t00, t01), (t10, t11) = self.transitions
        s0, s1, back = 0.0, 0.0, []
        for k, e in enumerate(self.emissions(page, total)):
            if k:
                from0, from1 = s0 + t00 < s1 + t10, s0 + t01 < s1 + t11
                back.append((from0, from1))
                s0, s1 = max(s0 + t00, s1 + t10), max(s0 + t01, s1 + t11)
            s1 += e
        label = int(s1 > s0)
        labels = [label]
        for step in reversed(back):
            label = int(step[label])
            labels.append(label)
        return labels[::-1]


def marginals(emissions: np.ndarray, transitions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Probability of label 1 at each place, and expected counts of the transitions, by forward-backward in log space."""
    n = len(emissions)
    score = np.stack([np.zeros(n), emissions], axis=1)
    forward, backward = score.copy(), np.zeros((n, 2))
    for k in range(1, n):
        forward[k] += np.logaddexp(forward[k - 1, 0] + transitions[0], forward[k - 1, 1] + transitions[1])
    for k in range(n - 2, -1, -1):
        ahead = backward[k + 1] + score[k + 1]
        backward[k] = np.logaddexp(transitions[:, 0] + ahead[0], transitions[:, 1] + ahead[1])
    total = np.logaddexp(*forward[-1])
    of_one = np.exp(forward[:, 1] + backward[:, 1] - total)
    pairs = forward[:-1, :, None] + transitions[None] + (score[1:] + backward[1:])[:, None, :] - total
    return of_one, np.exp(pairs).sum(axis=0)


def train(pages: list[tuple[str, list[int]]], seed: int = 3) -> Field:
    """Maximum-likelihood weights, by Adagrad over pages of (html, label of each leaf block)."""
    index: dict[str, int] = {}
    data = []
    for page, labels in pages:
        found, total = measured(page)
        if found:
            names = [path_features(b, total) + text_features(b, k / len(found)) for k, b in enumerate(found)]
            at = [[index.setdefault(f, len(index)) for f in fs] for fs in names]
            data.append((np.concatenate(at), np.repeat(np.arange(len(at)), [len(a) for a in at]), np.array(labels, float)))
    w, t = np.zeros(len(index)), np.zeros((2, 2))
    gw, gt = np.full(len(index), 1e-2), np.full((2, 2), 1e-2)
    order = random.Random(seed)
    for _ in range(EPOCHS):
        order.shuffle(data)
        for at, row, y in data:
            of_one, pairs = marginals(np.bincount(row, w[at], len(y)), t)
            d = np.bincount(at, (of_one - y)[row], len(w)) + DECAY * w
            seen = np.zeros((2, 2))
            np.add.at(seen, (y[:-1].astype(int), y[1:].astype(int)), 1)
            dt = pairs - seen + DECAY * t
            gw, gt = gw + d**2, gt + dt**2
            w, t = w - RATE * d / np.sqrt(gw), t - RATE * dt / np.sqrt(gt)
    return Field({f: float(w[k]) for f, k in index.items() if w[k]}, t.tolist())


# Labelled pages: layouts, names and texts are drawn from these, by seed.
MAIN = (
    "article", "main", "div id=content", "div class=post-content", "section class=story", "div class=entry-body", "td class=text", "article class=post", "main><article", "div class=article><div class=body",
    "body", "div", "div><div", "table><tr><td", "section", "div id=main-content", "div class=page-content><div class=text", "article class=entry><div class=entry-content",
)
ASIDE = {
    "nav": ("nav", "div class=menu", "ul class=navigation", "div id=nav", "nav class=breadcrumbs", "div role=navigation", "div class=topnav", "div", "div id=top", "table class=navbar><tr><td"),
    "header": ("header", "div id=header", "div class=masthead", "div class=site-header", "div role=banner", "header class=page-header"),
    "footer": ("footer", "div id=footer", "div class=site-footer", "footer class=footer", "div role=contentinfo", "div class=copyright", "div class=bottom", "div"),
    "side": ("aside", "div class=sidebar", "div id=right-rail", "aside class=related", "div class=widget", "div role=complementary", "section class=recommended", "div class=most-read", "td class=sidebar"),
    "ad": ("div class=ad", "div class=advert", "div class=sponsored", "ins class=adsbygoogle", "div id=banner-ad", "aside class=promo", "div class=ads", "div class=advertisement"),
    "notice": ("div class=cookie-notice", "div id=cookie-banner", "div class=notice", "div class=gdpr-consent", "div class=alert", "div role=alert", "section class=banner", "div class=consent"),
    "form": ("form", "form class=newsletter", "div class=subscribe", "form id=search", "div class=login", "form class=contact", "div class=signup"),
    "comments": ("section class=comments", "div id=comments", "div class=comment-list", "ol class=commentlist", "div class=disqus", "section id=respond", "div class=replies", "div class=reader-comments", "div class=discussion", "section class=responses"),
    "share": ("div class=share", "ul class=social", "div class=tags", "div class=byline-links", "div class=pagination", "div class=sharing"),
}
#: Short lines that boilerplate has often and an article now and then.
PHRASES = ("All rights reserved.", "Subscribe to our newsletter", "Share this", "Log in to comment", "Read more", "Related", "We use cookies.", "3 comments", "Terms and privacy", "Advertisement", "Posted by Ann")
INSIDE = ("ad", "side", "form", "share", "notice", "comments")
#: Names that a wrapper of the whole page may have; any name of a region may stand among them.
WRAPPERS = ("page", "wrapper", "site", "container", "outer", "layout", "home", "theme", "app", "root", "hfeed", "single", "desktop")


class _Maker:
    """A random labelled page."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)
        self.labels: list[int] = []
        self.out: list[str] = []

    def words(self, least: int, most: int, end: str = "") -> str:
        r = self.r
        word = lambda: "".join(r.choice("bcdfglmnprst") + r.choice("aeiouéä") for _ in range(r.randint(1, 4)))
        return (" ".join(word() for _ in range(r.randint(least, most))) + end).capitalize()

    def dull(self, least: int, most: int, end: str = "") -> str:
        return self.r.choice(PHRASES) if self.r.random() < 0.25 else self.words(least, most, end)

    def open(self, spec: str) -> str:
        parts = spec.split("><")
        for part in parts:
            self.out.append("<" + re.sub(r"=(\S+)", r'="\1"', part) + ">")
        return "".join(f"</{p.split(' ')[0]}>" for p in reversed(parts))

    def leaf(self, tag: str, text: str, label: int, closed: bool = True) -> None:
        self.out.append(f"<{tag}>{text}" + (f"</{tag}>" if closed else ""))
        self.labels.append(label)

    def wrapper(self) -> str:
        """A name for an element around the whole page: now and then that of a region, which then says nothing."""
        r = self.r
        if r.random() < 0.5:
            return r.choice(WRAPPERS)
        region = r.choice(r.choice(list(ASIDE.values()))).split("><")[0].split("=")[-1].split(" ")[-1]
        return r.choice(["has-", "with-", "no-", "page-", "", ""]) + region + r.choice(["", "-layout", "-enabled", ""])

    def junk(self, kind: str, depth: int = 0) -> None:
        r, spec = self.r, self.r.choice(ASIDE[kind])
        plain = spec == "div"
        end = self.open(spec)
        n = r.randint(1, 6) if kind != "ad" else 1
        if kind in ("nav", "share", "side") and (plain or r.random() < 0.8):
            if kind == "side" and r.random() < 0.6:
                self.leaf(r.choice(["h2", "h3", "h4"]), self.dull(1, 4), 0)
            if r.random() < 0.75:
                self.out.append("<ul>")
                for _ in range(n + plain):
                    self.leaf("li", f'<a href="/{r.random()}">{self.dull(1, 5)}</a>', 0)
                self.out.append("</ul>")
            else:
                self.out.append(r.choice([" | ", " ", " &gt; "]).join(f'<a href="/{k}">{self.words(1, 3)}</a>' for k in range(n + plain)))
                self.labels.append(0)
        elif kind == "footer" and (plain or r.random() < 0.7):
            mark = r.choice(["&copy; ", "© ", "Copyright "]) if plain else r.choice(["&copy; ", "", "© "])
            self.out.append(mark + self.words(2, 14, r.choice([".", ""])))
            self.labels.append(0)
        elif kind == "form":
            self.leaf(r.choice(["legend", "p", "h3"]) if r.random() < 0.5 else "p", self.dull(1, 9), 0)
            self.out.append('<div><label>Name</label><input type="text"><button>Go</button></div>')
        elif kind == "comments":
            if r.random() < 0.5:
                self.leaf(r.choice(["h2", "h3", "h4"]), self.dull(1, 5), 0)
            for _ in range(r.randint(5, 25) if r.random() < 0.2 else n):
                inner = r.choice(["p", "div", "li", "div><p", "div class=comment><p"])
                close = self.open(inner)
                self.out.append(self.dull(3, 60, "."))
                self.labels.append(0)
                self.out.append(close)
        elif r.random() < 0.4:
            self.out.append(self.dull(2, 30, r.choice([".", ""])))
            self.labels.append(0)
        else:
            for _ in range(min(n, 3)):
                self.leaf(r.choice(["p", "div", "h2"]), self.dull(2, 30, r.choice([".", ""])), 0)
        self.out.append(end)

    def body(self, main: str) -> None:
        r, end = self.r, self.open(main) if main != "body" else ""
        if r.random() < 0.3 and main.startswith(("article", "main")):
            self.out.append("<header>")
            self.leaf("h1", self.words(2, 12), 1)
            self.out.append("</header>")
        elif r.random() < 0.9:
            self.leaf("h1" if r.random() < 0.85 else "div", self.words(2, 12), 1)
        paragraph, longest = r.choice(["p", "p", "p", "div"]), r.choice([25, 120])
        for _ in range(r.randint(1, 12)):
            roll = r.random()
            if roll < 0.72:
                text = r.choice(PHRASES) if r.random() < 0.06 else self.words(1, 12, ".") if r.random() < 0.3 else self.words(8, longest, ".")
                if r.random() < 0.2:
                    text = f"<b>{text}" + r.choice(["</b>", "<br>", ""])
                elif r.random() < 0.2:
                    text = f'{text} <a href="#">{self.words(1, 4)}</a>'
                self.leaf(paragraph, text, 1, paragraph == "div" or r.random() < 0.9)
            elif roll < 0.8:
                self.leaf(r.choice(["h2", "h3"]), self.words(1, 8), 1)
            elif roll < 0.85:
                self.out.append(tag := r.choice(["<ul>", "<ol>"]))
                linked = r.random() < 0.35
                for _ in range(r.randint(2, 5)):
                    item = self.words(2, 20)
                    self.leaf("li", f'<a href="#">{item}</a>' if linked and r.random() < 0.6 else item, 1)
                self.out.append(tag.replace("<", "</"))
            elif roll < 0.87:
                self.out.append("<table>")
                for _ in range(r.randint(1, 4)):
                    self.out.append("<tr>")
                    for _ in range(3):
                        self.leaf("td", self.words(1, 3), 1)
                    self.out.append("</tr>")
                self.out.append("</table>")
            elif roll < 0.9:
                self.leaf(r.choice(["blockquote", "pre", "figcaption", "div"]), self.words(5, 40, "."), 1)
            else:
                self.junk(r.choice(INSIDE))
        self.out.append(end)

    def page(self) -> tuple[str, list[int]]:
        r = self.r
        named = f' class="{" ".join(self.wrapper() for _ in range(r.randint(1, 3)))}"' if r.random() < 0.4 else ""
        self.out.append(f'<!DOCTYPE html><html lang="en"><head><title>{self.words(2, 9)}</title><style>p{{margin:0}}</style></head><body{named}>')
        wrapped = ""
        while r.random() < 0.45 and wrapped.count("<") < 3:
            tag = r.choice(["div", "div", "div", "form", "section", "main", "center"])
            self.out.append(f'<{tag} class="{" ".join(self.wrapper() for _ in range(r.randint(1, 2)))}">' if r.random() < 0.7 else f"<{tag}>")
            wrapped = f"</{tag}>" + wrapped
        for kind, chance in (("notice", 0.25), ("header", 0.45), ("nav", 0.75), ("ad", 0.4), ("side", 0.15), ("form", 0.1)):
            if r.random() < chance:
                self.junk(kind)
        self.body(r.choice(MAIN))
        for kind, chance in (("share", 0.2), ("comments", 0.4), ("side", 0.35), ("ad", 0.2), ("form", 0.2), ("nav", 0.1), ("notice", 0.1), ("footer", 0.85)):
            if r.random() < chance:
                self.junk(kind)
        self.out.append(wrapped + "</body></html>")
        return "".join(self.out), self.labels


def labelled_pages(n: int, seed: int = 11) -> list[tuple[str, list[int]]]:
    """Pages with the label of each of their leaf blocks, the same for the same seed."""
    return [_Maker(seed * 1_000_003 + k).page() for k in range(n)]


@lru_cache(maxsize=1)
def default_field() -> Field:
    return train(labelled_pages(TRAINING_PAGES))


def main_text(page: str, field: Field) -> str:
    found, total = measured(page)
    return "\n".join(b.text for b, label in zip(found, field.decode(found, total), strict=True) if label) if found else ""


def extract(pages: DataFrame, field: Field | None = None) -> DataFrame:
    """page_id, url, text, n_chars of each page. Null html is empty; a page without text has an empty one. Repeated rows are returned each.

    Pages are independent and read in one pass, so a very long or deep one costs time and memory in proportion to its length.
    Other columns of ``pages`` are ignored.
    """
    shared = pages.sparkSession.sparkContext.broadcast(field or default_field())

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py() or "", shared.value) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], ["page_id", "url", "text", "n_chars"]
            )

    kind = {c: pages.schema[c].dataType.simpleString() for c in ("page_id", "url")}
    rows = pages.select("page_id", "url", F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(read, f"page_id {kind['page_id']}, url {kind['url']}, text string, n_chars bigint")


def op8_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
