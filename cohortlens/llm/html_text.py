"""Main text of web pages by a recurrent block labeller.

A page is cut into leaf blocks: stretches of text between block-level tags, each
with the path of tags (and their class and id words) above it. A bidirectional
LSTM in numpy reads a vector for each block (hashed path, hashed words, a few
measures) along the whole page, and labels every block as article or not. It
learns from pages written by rule with a fixed seed, in which the labels are
known.
"""

from __future__ import annotations

import html
import math
import random
import re
import zlib
from collections import defaultdict
from collections.abc import Iterable, Iterator
from functools import cache, lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import shipped
from ._util import free_name, read_table

BLOCKS = frozenset("html head body title main article section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd nav header footer aside form fieldset legend table thead tbody tfoot tr td th caption blockquote pre figure figcaption address details summary hr select option button dialog center".split())
RAW = frozenset(["script", "style", "noscript", "template", "textarea", "svg", "iframe", "object"])
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: A start tag of the first closes an open element of the second.
CLOSES = {"p": ["p"], "li": ["li", "p"], "dt": ["dt", "dd", "p"], "dd": ["dt", "dd", "p"], "tr": ["tr", "td", "th", "p"], "td": ["td", "th", "p"], "th": ["td", "th", "p"], "option": ["option"]} | {t: ["p"] for t in "div section article aside nav header footer form table ul ol dl pre blockquote figure h1 h2 h3 h4 h5 h6 main hr".split()}
#: An open element of the first is out of reach behind one of the second.
SCOPES = {"li": ["ul", "ol"], "dt": ["dl"], "dd": ["dl"], "tr": ["table"], "td": ["tr", "table"], "th": ["tr", "table"], "p": ["td", "th", "li", "div", "section", "article", "body"]}
START = re.compile(r"<(?:!--|[!?]|(/?)([a-zA-Z][a-zA-Z0-9-]*))")
STOP = re.compile(r"[>\"']")
NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
SPACE = re.compile(r"\s+")


PATH_DIM, WORD_DIM, DENSE = 96, 16, 9
DIM = PATH_DIM + WORD_DIM + DENSE


class Block(NamedTuple):
    path: int  # a bit for each of PATH_DIM slots that a name of an open element hashes to
    names: int  # how many names the open elements have
    inner: str  # the innermost element's tag, empty if it has a name beside it
    text: str
    linked: float  # share of the text in links


class _Path:
    """The open elements. Names are counted by slot as they come and go, so that a
    block takes a number and not a copy of its path, and where each tag is open is
    kept, so that closing one does not search."""

    def __init__(self) -> None:
        self.open: list[tuple[str, list[int]]] = []
        self.where: dict[str, list[int]] = defaultdict(list)
        self.count, self.bits, self.names = [0] * PATH_DIM, 0, 0

    def push(self, tag: str, words: list[str]) -> None:
        slots = [_slot(w) for w in (tag, *words)]
        self.where[tag].append(len(self.open))
        self.open.append((tag, slots))
        self.names += len(slots)
        for i in slots:
            self.count[i] += 1
            self.bits |= 1 << i

    def cut(self, to: int) -> None:
        """Close all elements from place `to` on."""
        while len(self.open) > to:
            tag, slots = self.open.pop()
            self.where[tag].pop()
            self.names -= len(slots)
            for i in slots:
                self.count[i] -= 1
                if not self.count[i]:
                    self.bits &= ~(1 << i)

    def last(self, tags: Iterable[str]) -> int:
        return max((self.where[t][-1] for t in tags if self.where.get(t)), default=-1)

    def inner(self) -> str:
        return self.open[-1][0] if self.open and len(self.open[-1][1]) == 1 else ""


def _tag_end(page: str, at: int, quotes: dict[str, int]) -> int:
    """Where the tag that begins before `at` has its >, quoted ones passed over; the page's end if it has none.
    A quote without a second one counts as a plain character."""
    while m := STOP.search(page, at):
        if m[0] == ">":
            return m.start()
        if m[0] not in quotes:
            quotes[m[0]] = page.rfind(m[0])
        at = page.find(m[0], m.end()) + 1 if m.start() < quotes[m[0]] else m.end()
    return len(page)


def leaf_blocks(page: str) -> list[Block]:
    """The blocks of a page in order.

    Scripts, styles and the like, comments and markup are left out; a comment or
    tag that never ends runs to the end of the page. Character references are
    decoded, white space becomes single spaces; blocks without text are dropped.
    Time and memory grow in line with the page, however deep its elements are.
    """
    out: list[Block] = []
    path, text, quotes = _Path(), [], {}
    linked, in_link, at = 0, False, 0

    def end_block() -> None:
        nonlocal linked
        if text:
            whole = SPACE.sub(" ", html.unescape("".join(text))).strip()
            if whole:
                out.append(Block(path.bits, path.names, path.inner(), whole, min(1.0, linked / max(1, len(whole)))))
            text.clear()
            linked = 0

    while at < len(page):
        m = START.search(page, at)
        piece = page[at : m.start()] if m else page[at:]
        if piece:
            text.append(piece)
            linked += len(piece) * in_link
        if not m:
            break
        if m[2] is None:
            sign = "-->" if m[0] == "<!--" else ">"
            end = page.find(sign, m.end())
            at = end + len(sign) if end >= 0 else len(page)
            continue
        tag, closing = m[2].lower(), m[1] == "/"
        end = _tag_end(page, m.end(), quotes)
        attributes, at = page[m.end() : end], end + 1
        if tag in RAW and not closing:
            if not attributes.endswith("/"):
                close = re.compile(rf"</{tag}\b", re.I).search(page, at)
                end = page.find(">", close.end()) if close else -1
                at = end + 1 if end >= 0 else len(page)
            if tag not in ("svg", "object"):
                end_block()
        elif tag == "a":
            in_link = not closing
        elif tag in ("br", "wbr"):
            text.append(" " if tag == "br" else "")
        elif tag in BLOCKS:
            end_block()
            if closing:
                if (to := path.last([tag])) >= 0:
                    path.cut(to)
                    in_link = False
                continue
            for open_ in CLOSES.get(tag, ()):
                to = path.last([open_])
                if to > path.last(SCOPES.get(open_, ())):
                    path.cut(to)
            if tag not in VOID:
                path.push(tag, [w for a in NAMES.findall(attributes) for w in re.split(r"[^a-z]+", "".join(a).lower()) if w] if attributes else [])
    end_block()
    return out


@lru_cache(1 << 16)
def _slot(name: str) -> int:
    return zlib.crc32(name.encode("utf-8", "surrogatepass")) % PATH_DIM


def block_vectors(blocks: list[Block], first: int = 0, of: int | None = None) -> np.ndarray:
    """Vectors of the blocks that stand at `first` and after among `of` blocks of their page."""
    x, of = np.zeros((len(blocks), DIM)), of or len(blocks)
    bits = np.frombuffer(b"".join(b.path.to_bytes(PATH_DIM // 8, "little") for b in blocks), np.uint8).reshape(-1, PATH_DIM // 8)
    x[:, :PATH_DIM] = np.unpackbits(bits, axis=1, bitorder="little")
    for i, b in enumerate(blocks):
        words = b.text.split(" ")
        slots = np.bincount([zlib.crc32(w.encode("utf-8", "surrogatepass")) & 15 for w in words], minlength=WORD_DIM)
        x[i, PATH_DIM : PATH_DIM + WORD_DIM] = slots / len(words)
        stops = sum(b.text.count(c) for c in ".!?,;:")
        x[i, PATH_DIM + WORD_DIM :] = (math.log1p(len(b.text)) / 5, math.log1p(len(words)) / 4, b.linked, min(1.0, 10 * stops / len(b.text)), b.text[-1:] in ".!?", (first + i) / of, b.names / 12, b.inner == "li", b.inner in ("h1", "h2", "h3"))
    return x


class BiLstm:
    """A bidirectional LSTM with a logistic output for each step; weights W (input, state, one) for each direction."""

    def __init__(self, dim: int, hidden: int = 20, seed: int = 42):
        rng = np.random.default_rng(seed)
        self.h = hidden
        self.w = [rng.normal(0, 1 / np.sqrt(dim + hidden), (dim + hidden + 1, 4 * hidden)) for _ in range(2)] + [rng.normal(0, 0.3, (2 * hidden + 1, 1))]
        for w in self.w[:2]:
            w[-1, hidden : 2 * hidden] = 1.0  # forget gates start open

    def _direction(self, w: np.ndarray, x: np.ndarray, mask: np.ndarray, trace: list | None = None, state: list | None = None) -> np.ndarray:
        """Outputs of each step; state, a list, gives the state to start from and takes the last one."""
        b, t, d = x.shape
        (h, c), out = state or (np.zeros((b, self.h)), np.zeros((b, self.h))), np.zeros((b, t, self.h))
        given = x @ w[:d] + w[-1]
        for i in range(t):
            z = given[:, i] + h @ w[d:-1]
            s = 1 / (1 + np.exp(-np.clip(z[:, : 3 * self.h], -30, 30)))
            gi, gf, go, g = s[:, : self.h], s[:, self.h : 2 * self.h], s[:, 2 * self.h :], np.tanh(z[:, 3 * self.h :])
            m = mask[:, i : i + 1]
            new = gf * c + gi * g
            if trace is not None:
                trace.append((h, c, gi, gf, go, g, new, m))
            c = m * new + (1 - m) * c
            h = m * go * np.tanh(new) + (1 - m) * h
            out[:, i] = h
        if state is not None:
            state[:] = h, c
        return out

    def _back(self, w: np.ndarray, x: np.ndarray, trace: list, dout: np.ndarray) -> np.ndarray:
        b, t, d = x.shape
        dw, dh, dc = np.zeros_like(w), np.zeros((b, self.h)), np.zeros((b, self.h))
        for i in range(t - 1, -1, -1):
            h, c, gi, gf, go, g, new, m = trace[i]
            dh = dh + dout[:, i]
            th = np.tanh(new)
            dnew = m * (dc + dh * go * (1 - th * th))
            dz = np.hstack([dnew * g * gi * (1 - gi), dnew * c * gf * (1 - gf), m * dh * th * go * (1 - go), dnew * gi * (1 - g * g)])
            dw[:d] += x[:, i].T @ dz
            dw[d:-1] += h.T @ dz
            dw[-1] += dz.sum(axis=0)
            dh = dz @ w[d:-1].T + (1 - m) * dh
            dc = dnew * gf + (1 - m) * dc
        return dw

    def forward(self, x: np.ndarray, lengths: np.ndarray, traces: list | None = None) -> np.ndarray:
        """Probability for each step of padded sequences x (batch, steps, dim)."""
        t = x.shape[1]
        mask = (np.arange(t)[None, :] < lengths[:, None]).astype(float)
        one, two = ([], []) if traces is not None else (None, None)
        ahead = self._direction(self.w[0], x, mask, one)
        behind = self._direction(self.w[1], x[:, ::-1], mask[:, ::-1], two)[:, ::-1]
        both = np.concatenate([ahead, behind, np.ones((*mask.shape, 1))], axis=2)
        if traces is not None:
            traces += [one, two, both, mask]
        return 1 / (1 + np.exp(-np.clip((both @ self.w[2])[:, :, 0], -30, 30)))

    def fit(self, pages: list[tuple[np.ndarray, np.ndarray]], epochs: int = 8, rate: float = 0.01, batch: int = 24, seed: int = 1) -> BiLstm:
        rng = np.random.default_rng(seed)
        m, v, step = [np.zeros_like(w) for w in self.w], [np.zeros_like(w) for w in self.w], 0
        by_length = sorted(range(len(pages)), key=lambda i: len(pages[i][1]))
        groups = [by_length[i : i + batch] for i in range(0, len(pages), batch)]
        for epoch in range(epochs):
            for g in rng.permutation(len(groups)):
                rows = [pages[i] for i in groups[g]]
                x, lengths = pad([r[0] for r in rows])
                y, _ = pad([r[1][:, None] for r in rows])
                traces: list = []
                p = self.forward(x, lengths, traces)
                one, two, both, mask = traces
                d = ((p - y[:, :, 0]) * mask / mask.sum())[:, :, None]
                dboth = d @ self.w[2].T
                grads = [self._back(self.w[0], x, one, dboth[:, :, : self.h]), self._back(self.w[1], x[:, ::-1], two, dboth[:, ::-1, self.h : 2 * self.h]), (both * d).sum(axis=(0, 1))[:, None]]
                step += 1
                for i, grad in enumerate(grads):
                    grad = grad / max(1.0, np.linalg.norm(grad))
                    m[i] = 0.9 * m[i] + 0.1 * grad
                    v[i] = 0.999 * v[i] + 0.001 * grad * grad
                    self.w[i] -= rate * 0.8**epoch * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
        return self


def pad(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.array([len(r) for r in rows])
    x = np.zeros((len(rows), max(lengths), rows[0].shape[1]))
    for i, r in enumerate(rows):
        x[i, : len(r)] = r
    return x, lengths


def example_page(rng: random.Random) -> str:
    """A page written by rule; blocks of the article hold the mark @@, which is taken out again."""
    word = lambda: "".join(rng.choice(["er", "th", "an", "in", "re", "on", "ou", "la", "de", "st", "ti", "é", "ö", "ñ"]) for _ in range(rng.randint(1, 4)))

    def words(lo: int, hi: int) -> str:
        return " ".join(word() + rng.choice(["", "", "", "", ",", rng.choice(["%%%", "!!", " |"])]) for _ in range(rng.randint(lo, hi)))

    def line(lo: int = 2, hi: int = 60) -> str:
        return words(lo, hi).capitalize() + "."

    links = lambda n: "".join(f'<li><a href="/{i}">{words(1, 3)}</a></li>' for i in range(n))
    named = lambda *names: rng.choice(["class", "id"]) + f'="{rng.choice(names)}"'

    def rare_part() -> str:
        """What articles hold now and then: code, captions, terms with what they mean."""
        code = "\n".join(f"  {word()}({word()}) = {rng.randint(0, 99)}{rng.choice([';', '', ' {'])}" for _ in range(rng.randint(1, 8)))
        terms = "".join(f"<dt>@@{words(1, 3)}</dt><dd>@@{line(2, 20)}</dd>" for _ in range(rng.randint(1, 4)))
        caption = rng.choice([words(2, 9), line(2, 20)])
        return rng.choice([
            f"<pre>@@{code}</pre>",
            f"<pre><code>@@{code}</code></pre>",
            f'<figure><img src="/{word()}.png"><figcaption>@@{caption}</figcaption></figure>',
            f"<dl>{terms}</dl>",
            f"<table><caption>@@{words(2, 8)}</caption><thead><tr><th>@@{words(1, 2)}</th><th>@@{words(1, 2)}</th></tr></thead><tr><td>@@{words(1, 4)}</td><td>@@{rng.randint(0, 9999)}</td></tr></table>",
        ])

    def para() -> str:
        if rng.random() < 0.08:
            return rare_part()
        body = "@@" + line(1, rng.choice([3, 20, 80, 200]))
        kind = rng.random()
        if kind < 0.62:
            return f"<p>{body}" + rng.choice(["</p>", "</p>", "</p>", ""])
        if kind < 0.74:
            return f"<p><b>{body}<br>"
        if kind < 0.82:
            return rng.choice(["<h2>", "<h3>"]) + "@@" + words(1, 8) + rng.choice(["</h2>", "</h3>"])
        if kind < 0.88:
            return "<ul>" + "".join(f"<li>@@{line(1, 20)}</li>" for _ in range(rng.randint(2, 5))) + "</ul>"
        if kind < 0.92:
            return f"<blockquote>{body}</blockquote>"
        if kind < 0.95:
            return "<table>" + "".join(f"<tr><td>@@{words(1, 3)}</td><td>@@{words(1, 3)}</td></tr>" for _ in range(3)) + "</table>"
        return f"<div>{body}</div>"

    def aside_part() -> str:
        return rng.choice([
            lambda: f"<aside {named('sidebar', 'side', 'widget')}>" + rng.choice([f"<h3>{words(1, 4)}</h3>", ""]) + rng.choice([f"<ul>{links(rng.randint(2, 8))}</ul>", f"<p>{line()}</p>"]) + "</aside>",
            lambda: f"<div {named('ad', 'ads', 'advert', 'banner', 'sponsored', 'promo')}>" + rng.choice([line(), f"<p>{line()}</p>"]) + "</div>",
            lambda: f"<div {named('cookie', 'notice', 'consent', 'cookie-banner', 'alert', 'gdpr')}><p>{line()}</p><button>{words(1, 2)}</button></div>",
            lambda: f"<form {named('search', 'newsletter', 'subscribe', 'login')}><label>{words(1, 3)}</label><select><option>{words(1, 1)}</option><option>{words(1, 1)}</option></select><button>{words(1, 2)}</button><p>{line(2, 12)}</p></form>",
            lambda: f"<div {named('related', 'share', 'social', 'breadcrumb', 'tags', 'menu')}><ul>{links(rng.randint(2, 7))}</ul></div>",
            lambda: f"<section {named('sidebar', 'promo', 'newsletter', 'related')}><h2>{words(1, 4)}</h2><p>{line()}</p></section>",
        ])()

    comments = lambda: f"<{(t := rng.choice(['section', 'div', 'ol']))} {named('comments', 'comment-list', 'discussion', 'replies', 'respond')}><h3>{words(1, 3)}</h3>" + "".join(f"<div class=\"comment\"><p>{line()}</p></div>" if rng.random() < 0.7 else f"<article class=\"comment\"><p>{line()}</p></article>" for _ in range(rng.randint(1, 6))) + f"</{t}>"
    some = lambda p: "".join(aside_part() for _ in range(rng.randint(1, 2))) if rng.random() < p else ""
    head = f'<head><meta charset="utf-8"><title>{words(2, 9)}</title><style>p{{margin:0}}</style><script>var t="</p>";track({rng.randint(0, 99)});</script></head>'
    top = rng.choice([f"<nav><ul>{links(rng.randint(3, 9))}</ul></nav>", f"<header><h1>{words(1, 3)}</h1><nav><ul>{links(5)}</ul></nav></header>", f"<div {named('menu', 'nav', 'navbar', 'navigation')}><ul>{links(6)}</ul></div>", f"<header><p>{line(2, 9)}</p></header>", ""])
    second = rng.choice([f"<h2>@@{words(2, 9)}</h2>", f"<h2 {named('title', 'headline', 'post-title')}>@@{words(2, 9)}</h2>", f"<header><h2>@@{words(2, 9)}</h2></header>"])
    title = second if rng.random() < 0.15 else rng.choice([f"<h1>@@{words(2, 9)}</h1>"] * 3 + [f"<header><h1>@@{words(2, 9)}</h1></header>", ""])
    inner = title + "".join(para() + some(0.04) for _ in range(rng.choice([1, 2, 4, 8, 14, 25])))
    within = rng.random() < 0.15
    inner += comments() if within else ""
    o, c = rng.choice([("<article>", "</article>")] * 5 + [("<main>", "</main>"), ("<main><article>", "</article></main>"), (f"<div {named('content', 'post', 'entry', 'article', 'main', 'story', 'post-body')}>", "</div>"), ('<section role="main">', "</section>"), ("<div>", "</div>")])
    foot = rng.choice([f"<footer>&copy; {word()}.com &middot; {line(3, 12)}</footer>"] * 3 + [f"<footer><p>{line(3, 12)}</p><ul>{links(4)}</ul></footer>", f"<div {named('footer', 'foot', 'copyright')}><p>{line(3, 12)}</p></div>", ""])
    end = rng.choice(["</body></html>", "</body></html>", ""])
    rights = lambda: f"{rng.choice(['&copy;', '(c)', 'Copyright', '&copy; ' + str(rng.randint(1996, 2026))])} {words(1, 4)}. {rng.choice(['All rights reserved', words(2, 4)])}{rng.choice(['.', ''])}"
    if rng.random() < 0.12:
        foot = rng.choice([f"<p>{rights()}</p>", f"<div>{rights()}</div>", f"<footer><p>{rights()}</p></footer>", f"<center>{rights()}</center>"])
    if rng.random() < 0.08:  # laid out in the cells of a table, with nothing named
        bare = " ".join(f'<a href="/{i}">{words(1, 2)}</a>{rng.choice(["<br>", " | "])}' for i in range(rng.randint(3, 8)))
        menu = rng.choice([bare, f"<ul>{links(rng.randint(3, 8))}</ul>", "</td><td>".join(f'<a href="/{i}">{words(1, 2)}</a>' for i in range(rng.randint(3, 6)))])
        banner = rng.choice([f"<tr><td colspan=2>{words(1, 4)}</td></tr>", f'<tr><td colspan=2><img src="/{word()}.gif"></td></tr>', ""])
        cells = rng.choice([f"<tr><td>{menu}</td><td>{inner}</td></tr>", f"<tr><td>{menu}</td></tr><tr><td>{inner}</td></tr>"])
        return f"<html>{head}<body><table>{banner}{cells}<tr><td colspan=2>{rights()}</td></tr></table>{end}"
    return f"<!DOCTYPE html><html>{head}<body>{top}<!-- ad {rng.randint(0, 9)} -->{some(0.7)}{o}{inner}{c}{'' if within or rng.random() < 0.6 else comments()}{some(0.3)}{foot}{end}"


@cache
def labeller(pages: int = 900, seed: int = 11) -> BiLstm:
    rng = random.Random(seed)
    rows = []
    while len(rows) < pages:
        blocks = leaf_blocks(example_page(rng))
        y = np.array([float("@@" in b.text) for b in blocks])
        if blocks:
            rows.append((block_vectors([b._replace(text=b.text.replace("@@", "") or "-") for b in blocks]), y))
    return BiLstm(DIM).fit(rows)


STEPS_AT_ONCE = 1 << 14
CHARS_AT_ONCE = 8 << 20


def label_long_page(blocks: list[Block], model: BiLstm) -> np.ndarray:
    """The probabilities for one page in windows of STEPS_AT_ONCE blocks: each direction
    carries its state from window to window, so the result is that of the whole page."""
    n, h, z = len(blocks), model.h, np.full(len(blocks), model.w[2][-1, 0])
    for back in (0, 1):
        state: list = []
        for lo in sorted(range(0, n, STEPS_AT_ONCE), reverse=bool(back)):
            x = block_vectors(blocks[lo : lo + STEPS_AT_ONCE], lo, n)[None]
            seen = model._direction(model.w[back], x[:, ::-1] if back else x, np.ones(x.shape[:2]), None, state)[0]
            z[lo : lo + x.shape[1]] += (seen[::-1] if back else seen) @ model.w[2][back * h : (back + 1) * h, 0]
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def label_pages(pages: list[list[Block]], model: BiLstm) -> list[np.ndarray]:
    """For the leaf blocks of each page the probability of being article; pages of like length go together."""
    out: list = [np.empty(0)] * len(pages)
    order = sorted((i for i, p in enumerate(pages) if p), key=lambda i: len(pages[i]))
    while order:
        take = 0
        while take < len(order) and (take + 1) * len(pages[order[take]]) <= STEPS_AT_ONCE:
            take += 1
        if not take:  # this page alone is longer, and so are all that follow
            for i in order:
                out[i] = label_long_page(pages[i], model)
            break
        rows, order = order[:take], order[take:]
        x, lengths = pad([block_vectors(pages[i]) for i in rows])
        p = model.forward(x, lengths)
        for i, q, n in zip(rows, p, lengths):
            out[i] = q[:n]
    return out


def extract(pages: DataFrame, keep: list[str], html_col: str = "html") -> DataFrame:
    """The columns `keep` with text: the article's blocks in page order, joined by line breaks.

    A null or empty page, and one without article blocks, has the empty text.
    Broken markup is read as far as it goes; a kept column named text gives way
    to the result's; repeated rows give repeated results; an empty table gives an
    empty result. A page is read in time and memory linear in its length.
    """
    model = labeller()
    keep = [c for c in keep if c.lower() != "text"]
    raw = free_name("html", keep)
    slim = pages.select(*keep, F.coalesce(F.col(html_col), F.lit("")).alias(raw))
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in slim.schema if f.name != raw)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = 0
            while at < b.num_rows:
                took, chars, blocks = 0, 0, []
                while at + took < b.num_rows and took < 256 and chars < CHARS_AT_ONCE:
                    page = b.column(raw)[at + took].as_py()
                    took, chars = took + 1, chars + len(page)
                    blocks.append(leaf_blocks(page))
                part = b.slice(at, took)
                text = ["\n".join(block.text for block, q in zip(page, p) if q >= 0.5) for page, p in zip(blocks, label_pages(blocks, model))]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(text, pa.string())], [*keep, "text"])
                at += took

    return shipped(slim).mapInArrow(run, f"{schema}text string")


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = extract(read_table(spark, sf_dir, "pages"), ["page_id", "url"])
    return out.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


QUERIES = {"op8_html_text": op8_html_text}
