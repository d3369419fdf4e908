"""Main text of web pages by a recurrent block labeller.

A page becomes its sequence of text blocks.  Each block is a vector: hashed elements of its
tag path (names, classes, ids), hashed words, and a few figures on length, links and marks.
A bidirectional LSTM in numpy reads the sequence both ways and says of each block whether
it belongs to the article.  It was trained by ``trained`` on pages that ``made_page`` composes
of invented words in many layouts, with every kind of boilerplate; seeds are fixed.  The
weights are stored beside this module (``python -m driftlens.llm.html`` makes them again).
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftlens.llm.common import slices

PATH, WORDS, FIGURES = 96, 32, 8
WIDTH = PATH + WORDS + FIGURES
HIDDEN = 20
#: Pages composed for training, and passes over them.
PAGES, PASSES, BATCH = 6000, 6, 32
#: Blocks of a page that are labelled at once; pages of more go window by window.
WINDOW = 8192
WEIGHTS = Path(__file__).with_name("html_weights.npz")

# Elements that end a block, that hold nothing to read, and that have no end tag.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead title tr ul".split())
SILENT = frozenset("script style noscript template iframe noembed noframes svg math object canvas audio video textarea title".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())

#: End tags that may be left out where these begin; of a paragraph where any other block does.
_LEFT_OUT = {"p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}

#: An attribute; a quote opens a value only right after its equals sign, and one that nothing closes is a letter like others.
_VALUE = r"""(?:"[^"]*+"|'[^']*+'|[^\s>]++)"""
_ONE = rf"(?:=[^\s/>=]*+|[^\s/>=]++)(?:\s*+=\s*+{_VALUE}?+)?+"
_TOKEN = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<(?:[!?]|/(?![a-zA-Z]))[^>]*+(?:>|\Z)"
    rf"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<rest>(?:[\s/]++|{_ONE})*+)(?:>|\Z)", re.S,
)
_ATTRIBUTE = re.compile(rf"(?P<name>=[^\s/>=]*+|[^\s/>=]++)(?:\s*+=\s*+(?P<value>{_VALUE})?+)?+")
_MARKED = frozenset(("class", "id", "role"))
_NAME = re.compile(r"[a-z]+|\d+")
_WORD = re.compile(r"[^\W\d_]+|[©®™»|·›]")


def attributes(rest: str) -> Iterator[tuple[str, str]]:
    """(name, value) of what stands in a start tag behind its name; references in values decoded."""
    for a in _ATTRIBUTE.finditer(rest):
        value = a["value"] or ""
        if value[:1] in "\"'" and len(value) > 1 and value[0] == value[-1]:
            value = value[1:-1]
        yield a["name"].lower(), html.unescape(value)


def _closes_itself(tag: str, rest: str) -> bool:
    """``/>`` ends a foreign element at once; in HTML it says nothing, and behind an unquoted value it is part of that."""
    return tag in ("svg", "math") and rest.endswith("/") and not any(a.end() == len(rest) for a in _ATTRIBUTE.finditer(rest))


@dataclass
class Block:
    path: int  # buckets of the tag path's names, as bits
    text: str
    linked: int  # characters within links


class _Open:
    """The elements that are open; every question takes the same time however many there are."""

    def __init__(self):
        self.tags: list[str] = []
        self.paths = [0]
        self.at: dict[str, list[int]] = {}  # where each tag is open
        self.ends: list[int] = []  # where elements that end blocks are open
        self.links = 0

    def push(self, tag: str, bits: int) -> None:
        self.at.setdefault(tag, []).append(len(self.tags))
        if tag in BLOCKS:
            self.ends.append(len(self.tags))
        self.links += tag == "a"
        self.tags.append(tag)
        self.paths.append(self.paths[-1] | bits)

    def close(self, depth: int) -> None:
        """Close all from ``depth`` on."""
        while len(self.tags) > depth:
            tag = self.tags.pop()
            self.paths.pop()
            self.at[tag].pop()
            self.links -= tag == "a"
        while self.ends and self.ends[-1] >= depth:
            self.ends.pop()

    def end(self, tag: str) -> None:
        """An end tag closes the last element of its name; one that ends no block doesn't reach beyond a block."""
        if self.at.get(tag):
            depth = self.at[tag][-1]
            if tag in BLOCKS or not self.ends or self.ends[-1] < depth:
                self.close(depth)

    def left_out(self, tags: tuple[str, ...]) -> None:
        """The end tag of the last block may have been left out, if it is one of these."""
        if self.ends and self.tags[self.ends[-1]] in tags:
            self.close(self.ends[-1])


def blocks(page: str) -> list[Block]:
    """Text blocks of a page in order; white space within one is one space.  Work is linear in the page, however deep it nests."""
    out: list[Block] = []
    now = _Open()
    parts: list[str] = []
    held: list[int] = []
    linked = at = 0

    def flush():
        nonlocal linked
        text = " ".join("".join(parts).split())
        if text:
            out.append(Block(held[0] if held else 0, text, min(linked, len(text))))
        parts.clear()
        held.clear()
        linked = 0

    def add(text: str):
        nonlocal linked
        if text:
            if not held and not text.isspace():
                held.append(now.paths[-1])
            parts.append(text)
            if now.links:
                linked += len(text.strip())

    while True:
        m = _TOKEN.search(page, at)
        add(html.unescape(page[at : m.start()] if m else page[at:]))  # a reference doesn't go on past a tag
        if m is None:
            break
        at = m.end()
        if m["cdata"] is not None:
            add(m["cdata"])
            continue
        tag = (m["tag"] or "").lower()
        if not tag:
            continue
        if tag in BLOCKS:
            flush()
        elif tag in ("br", "wbr"):
            parts.append(" " if tag == "br" else "")
        if m["end"]:
            now.end(tag)
            continue
        if tag in SILENT:
            if not _closes_itself(tag, m["rest"]):
                close = re.compile(rf"</{tag}(?=[\s/>])[^>]*+(?:>|\Z)", re.I).search(page, at)
                at = close.end() if close else len(page)
            continue
        if tag in VOID:
            continue
        if tag in BLOCKS:
            now.left_out(_LEFT_OUT.get(tag, ("p",)))
        bits = 1 << _bucket(tag, PATH)
        if "=" in m["rest"]:
            for name, value in attributes(m["rest"]):
                if name in _MARKED:
                    for n in _NAME.findall(value.lower()):
                        if not n.isdigit():
                            bits |= 1 << _bucket("." + n, PATH)
        now.push(tag, bits)
    flush()
    return out


_slot: dict[tuple[str, int], int] = {}


def _bucket(word: str, n: int) -> int:
    got = _slot.get((word, n))
    if got is None:
        if len(_slot) > 300_000:
            _slot.clear()
        got = _slot[word, n] = xxhash.xxh32_intdigest(word) % n
    return got


def vectors(page: list[Block], start: int = 0, end: int | None = None) -> np.ndarray:
    """A row for each block from ``start`` to ``end``."""
    chosen = page[start:end]
    out = np.zeros((len(chosen), WIDTH), np.float32)
    for k, b in enumerate(chosen):
        i = start + k
        out[k, :PATH] = np.unpackbits(np.frombuffer(b.path.to_bytes(PATH // 8, "little"), np.uint8), bitorder="little")
        words = _WORD.findall(b.text.lower())
        if words:
            count = np.bincount([_bucket(w, WORDS) for w in words], minlength=WORDS)
            out[k, PATH : PATH + WORDS] = count / np.sqrt((count * count).sum())
        n = len(b.text)
        out[k, PATH + WORDS :] = (
            np.log1p(n) / 6, b.linked / n, len(words) / 50 if len(words) < 50 else 1, sum(c in ".!?" for c in b.text[-1:]),
            min(1, 20 * sum(map(b.text.count, ".,;")) / n), (i + 1) / len(page), i / 20 if i < 20 else 1, 1,
        )
    return out


def _lstm(x: np.ndarray, w: dict[str, np.ndarray], side: str, mask: np.ndarray, state=None, keep: bool = True):
    """States of one direction; x is (time, page, WIDTH).  Padding leaves the state as it is.

    ``state`` goes on from before; with ``keep`` the second result is what training needs
    of each step, else the state at the end.
    """
    steps, pages, _ = x.shape
    h, c = state or (np.zeros((pages, HIDDEN), np.float32), np.zeros((pages, HIDDEN), np.float32))
    hs = np.zeros((steps, pages, HIDDEN), np.float32)
    kept = []
    given = x @ w[side + "x"] + w[side + "b"]
    for t in range(steps) if side == "f" else range(steps - 1, -1, -1):
        z = given[t] + h @ w[side + "h"]
        gates = 1 / (1 + np.exp(-z[:, : 3 * HIDDEN]))
        i, f, o = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :]
        g = np.tanh(z[:, 3 * HIDDEN :])
        new = f * c + i * g
        m = mask[t][:, None]
        if keep:
            kept.append((t, h, c, i, f, o, g, new))
        c = m * new + (1 - m) * c
        h = m * (o * np.tanh(new)) + (1 - m) * h
        hs[t] = h
    return hs, kept if keep else (h, c)


def _lstm_back(x, w, side, mask, kept, dhs, grad):
    dh = np.zeros_like(dhs[0])
    dc = np.zeros_like(dh)
    dz_all = np.zeros((*x.shape[:2], 4 * HIDDEN), np.float32)
    for t, h, c, i, f, o, g, new in reversed(kept):
        m = mask[t][:, None]
        dh = dh + dhs[t]
        th = np.tanh(new)
        dn = m * (dc + dh * o * (1 - th * th))
        dz = np.concatenate([dn * g * i * (1 - i), dn * c * f * (1 - f), m * dh * th * o * (1 - o), dn * i * (1 - g * g)], axis=1)
        grad[side + "h"] += h.T @ dz
        dz_all[t] = dz
        dc = dn * f + (1 - m) * dc
        dh = dz @ w[side + "h"].T + (1 - m) * dh
    grad[side + "x"] += np.tensordot(x, dz_all, ([0, 1], [0, 1]))
    grad[side + "b"] += dz_all.sum((0, 1))


def _batch(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    steps = max(map(len, pages))
    x, mask = np.zeros((steps, len(pages), WIDTH), np.float32), np.zeros((steps, len(pages)), np.float32)
    for k, p in enumerate(pages):
        x[: len(p), k], mask[: len(p), k] = p, 1
    return x, mask


def predict(pages: list[np.ndarray], w: dict[str, np.ndarray]) -> list[np.ndarray]:
    """The probability of each block of each page; pages of like lengths go together."""
    out: list[np.ndarray] = [np.zeros(0, np.float32)] * len(pages)
    order = sorted((k for k in range(len(pages)) if len(pages[k])), key=lambda k: len(pages[k]))
    at = 0
    while at < len(order):
        part = order[at : at + 128]
        while len(part) > 1 and len(pages[part[-1]]) * len(part) > 20_000:
            part = part[: len(part) // 2]
        at += len(part)
        x, mask = _batch([pages[k] for k in part])
        both = np.concatenate([_lstm(x, w, "f", mask, keep=False)[0], _lstm(x, w, "b", mask, keep=False)[0], x], axis=2)
        p = 1 / (1 + np.exp(-(both @ w["out"] + w["bias"])[:, :, 0]))
        for j, k in enumerate(part):
            out[k] = p[: len(pages[k]), j]
    return out


def predict_long(page: list[Block], w: dict[str, np.ndarray], window: int = WINDOW) -> np.ndarray:
    """``predict`` of one page of very many blocks: each way window by window, with the state handed on."""
    cuts = range(0, len(page), window)
    back, state, out = np.zeros((len(page), HIDDEN), np.float32), None, np.zeros(len(page), np.float32)
    for a in reversed(cuts):
        x = vectors(page, a, a + window)[:, None]
        hs, state = _lstm(x, w, "b", np.ones(x.shape[:2], np.float32), state, keep=False)
        back[a : a + window] = hs[:, 0]
    state = None
    for a in cuts:
        x = vectors(page, a, a + window)[:, None]
        hs, state = _lstm(x, w, "f", np.ones(x.shape[:2], np.float32), state, keep=False)
        both = np.concatenate([hs[:, 0], back[a : a + window], x[:, 0]], axis=1)
        out[a : a + window] = 1 / (1 + np.exp(-(both @ w["out"] + w["bias"])[:, 0]))
    return out


def made_page(rng: np.random.Generator) -> tuple[str, list[bool]]:
    """A page in one of many layouts, and of each of its blocks whether it is the article's."""
    letters = [chr(c) for c in range(97, 123)] + list("éèüößñóíçа日本")
    pool = ["".join(rng.choice(letters, rng.integers(1, 10))) for _ in range(60)]
    pick = lambda *x: x[rng.integers(len(x))]
    maybe = lambda p: rng.random() < p

    def words(a, b, end=""):
        w = [pick(*pool) for _ in range(rng.integers(a, b))]
        if end and len(w) > 8:
            w = [x + ("," if maybe(0.08) else "." if maybe(0.06) else "") for x in w]
        style = rng.random()
        if style < 0.06 and end:  # shouting, rows of a table as text, digits: in articles as elsewhere
            return "!! ".join(w).upper() + "."
        if style < 0.14 and end:
            return " | ".join(w).capitalize()
        if style < 0.2 and end:
            w = [x if maybe(0.6) else pick(str(rng.integers(1e6)), "a@b.example.com", "10.0.0.1", "=", "x1") for x in w]
        return " ".join(w).capitalize() + (end if maybe(0.9) else "")

    out, truth = [], []

    def put(text, good):
        truth.append(good)
        return text

    def link(a=1, b=4):
        return f'<a href="/{pick(*pool)}">{words(a, b)}</a>'

    def menu(cls, n):
        tag = pick("ul", "ul", "ol", "div")
        item = "div" if tag == "div" else "li"
        return f'<{tag}{cls}>' + "".join(put(f"<{item}>{link()}</{item}>", False) for _ in range(n)) + f"</{tag}>"

    def cls(*names):
        return f' {pick("class", "class", "id")}="{pick(*names)}{pick("", "", "-" + pick("box", "wrap", "inner", "main", "1"))}"' if maybe(0.85) else ""

    def bad(kind):
        if kind == "nav":
            return pick(lambda: f"<nav{cls('menu', 'navbar', 'top')}>" + menu("", rng.integers(2, 9)) + "</nav>", lambda: f"<div class=\"{pick('nav', 'menu', 'navigation', 'breadcrumb', 'breadcrumbs', 'topbar')}\">" + menu("", rng.integers(2, 8)) + "</div>")()
        if kind == "header":
            inner = put(f"<h1>{words(1, 6)}</h1>", False) if maybe(0.3) else put(f"<{(t := pick('div', 'p', 'span', 'h2'))}>{words(1, 6)}</{t}>", False)
            more = put(f"<p>{words(2, 10)}</p>", False) if maybe(0.4) else ""
            return pick(f"<header{cls('site', 'masthead', 'page', 'top')}>{inner}{more}</header>", f"<div class=\"{pick('header', 'masthead', 'banner', 'logo')}\">{inner}{more}</div>")
        if kind == "footer":
            text = pick("&copy; ", "© ", "Copyright 2024 ", "") + words(1, 14, pick(".", "")) + pick("", " &middot; " + words(1, 20, "."), " | " + words(1, 3), " All rights reserved.")
            open_ = pick(f"<footer{cls('site', 'page', 'bottom')}>", f"<div class=\"{pick('footer', 'copyright', 'legal', 'site-footer')}\">")
            body = put(pick(text, f"<p>{text}</p>", f"<small>{text}</small>"), False) + (menu("", rng.integers(1, 5)) if maybe(0.3) else "")
            return open_ + body + ("</footer>" if open_.startswith("<footer") else "</div>")
        if kind == "ad":
            return f"<{(t := pick('div', 'div', 'aside', 'section', 'p'))} class=\"{pick('ad', 'ads', 'advert', 'advertisement', 'sponsor', 'sponsored', 'promo', 'promotion', 'ad banner', 'adbox')}\">" + put(words(2, 25, "."), False) + f"</{t}>"
        if kind == "notice":
            return f"<{(t := pick('div', 'section', 'p'))} {pick('class', 'id')}=\"{pick('cookie', 'cookies', 'consent', 'gdpr', 'notice', 'alert', 'popup', 'modal', 'newsletter', 'subscribe', 'banner', 'cookie-notice', 'paywall')}\">" + put(words(3, 30, "."), False) + (put(f"<div>{link()}</div>", False) if maybe(0.3) else "") + f"</{t}>"
        if kind == "form":
            return f"<form{cls('search', 'login', 'signup', 'contact')}>" + "".join(put(f"<p>{pick('<label>', '')}{words(1, 6)}<input name=q></p>", False) for _ in range(rng.integers(1, 4))) + (f"<select>" + "".join(put(f"<option>{words(1, 3)}</option>", False) for _ in range(3)) + "</select>" if maybe(0.2) else "") + "</form>"
        if kind == "side":
            head = put(f"<h{(k := pick(2, 3, 4))}>{words(1, 4)}</h{k}>", False) if maybe(0.6) else ""
            body = menu(cls("list", "related"), rng.integers(1, 6)) if maybe(0.6) else "".join(put(f"<p>{words(3, 40, '.')}</p>", False) for _ in range(rng.integers(1, 4)))
            return pick(f"<aside{cls('sidebar', 'widget', 'related')}>{head}{body}</aside>", f"<div class=\"{pick('sidebar', 'widget', 'related', 'recommended', 'trending', 'share', 'social', 'tags', 'author-bio', 'side', 'pagination', 'read-more', 'right-rail')}\">{head}{body}</div>")
        item = pick("li", "div", "article", "p")
        inner = "".join(f"<{item}{cls('comment', 'reply', 'user')}>" + put(f"<{(t := pick('p', 'div'))}>{words(1, 40, '.')}</{t}>" if item != "p" else words(1, 40, "."), False) + f"</{item}>" for _ in range(rng.integers(1, 6)))
        head = put(f"<h{(k := pick(2, 3))}>{words(1, 3)}</h{k}>", False) if maybe(0.5) else ""
        # the heading stands first, so its mark has to as well; all marks here are the same
        return f"<{(t := pick('section', 'div', 'ol', 'ul'))} {pick('class', 'id')}=\"{pick('comments', 'comment-list', 'responses', 'discussion', 'replies', 'reader-comments', 'disqus')}\">{head}{inner}</{t}>"

    def good():
        kind = rng.random()
        if kind < 0.7:
            text = words(1, pick(3, 6, 15, 60, 90, 200), ".")
            if maybe(0.2):
                text += f" <a href='/x'>{words(1, 4)}</a> {words(1, 8, '.')}"
            if maybe(0.35):
                text = f"<{(t := pick('b', 'b', 'em', 'i', 'strong', 'span'))}>{text}" + (f"</{t}>" if maybe(0.6) else "")
            return put(f"<p{pick('', '', cls('lead', 'text', 'intro'))}>{text}" + ("</p>" if maybe(0.8) else ""), True)
        if kind < 0.8:
            return put(f"<h{(k := pick(2, 3, 4))}>{words(1, 7)}</h{k}>", True)
        if kind < 0.88:
            return f"<{(t := pick('ul', 'ol'))}>" + "".join(put(f"<li>{words(1, 20, '.')}</li>", True) for _ in range(rng.integers(1, 6))) + f"</{t}>"
        if kind < 0.92:
            return put(f"<blockquote>{words(3, 30, '.')}</blockquote>", True)
        if kind < 0.95:
            return "<table>" + "".join("<tr>" + "".join(put(f"<td>{words(1, 4)}</td>", True) for _ in range(3)) + "</tr>" for _ in range(rng.integers(1, 3))) + "</table>"
        return put(f"<{(t := pick('pre', 'figcaption', 'div'))}>{words(2, 15)}</{t}>", True)

    top = [k for k in ("notice", "header", "nav", "ad", "form", "side") if maybe({"nav": 0.8, "header": 0.6, "ad": 0.4}.get(k, 0.25))]
    end = [k for k in ("ad", "side", "comments", "form", "nav", "footer", "notice") if maybe({"footer": 0.85, "comments": 0.4, "nav": 0.2}.get(k, 0.3))]
    rng.shuffle(top)
    if maybe(0.08):  # nothing but an article
        top = end = []
    for k in top:
        out.append(bad(k))
    shell = pick("<article>", "<article>", "<main>", "<main><article>", '<div class="article">', '<div id="content">', '<div class="post">', '<div class="entry-content">', '<section class="story">', "<div class='main-content'><article>", "<div>")
    out.append(shell)
    if maybe(0.7):
        out.append(put(f"<h1{cls('title', 'headline')}>{words(1, 12, pick('', '.'))}</h1>", True))
    for _ in range(rng.integers(1, pick(3, 8, 16))):
        if maybe(0.06):
            out.append(bad(pick("ad", "notice", "side", "form")))
        out.append(good())
    if maybe(0.15):
        out.append(bad("comments"))
    out.append("".join(f"</{t}>" for t in reversed(re.findall(r"<(\w+)", shell))))
    for k in end:
        out.append(bad(k))
    head = f"<!DOCTYPE html><html><head><title>{words(1, 8)}</title><style>p{{}}</style></head><body>" if maybe(0.9) else ""
    return head + pick("", "\n").join(out) + pick("</body></html>", ""), truth


@cache
def stored() -> dict[str, np.ndarray]:
    """The weights beside this module."""
    with np.load(WEIGHTS) as f:
        return {k: f[k] for k in f.files}


def trained(pages: int = PAGES, passes: int = PASSES, seed: int = 11) -> dict[str, np.ndarray]:
    """The labeller's weights, trained anew."""
    rng = np.random.default_rng(seed)
    data = []
    while len(data) < pages:
        page, truth = made_page(rng)
        found = blocks(page)
        if len(found) == len(truth) and found:
            data.append((vectors(found), np.array(truth, np.float32)))
    w = {s + k: rng.normal(0, 0.15, shape).astype(np.float32) for s in "fb" for k, shape in (("x", (WIDTH, 4 * HIDDEN)), ("h", (HIDDEN, 4 * HIDDEN)))}
    w |= {s + "b": np.concatenate([np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN)]).astype(np.float32) for s in "fb"}
    w |= {"out": rng.normal(0, 0.15, (2 * HIDDEN + WIDTH, 1)).astype(np.float32), "bias": np.zeros(1, np.float32)}
    first, second = {k: np.zeros_like(v) for k, v in w.items()}, {k: np.zeros_like(v) for k, v in w.items()}
    step = 0
    for turn in range(passes):
        order = np.argsort([len(x) + rng.random() * 6 for x, _ in data])
        parts = [order[k : k + BATCH] for k in range(0, len(order), BATCH)]
        for p in rng.permutation(len(parts)):
            chosen = [data[k] for k in parts[p]]
            x, mask = _batch([c[0] for c in chosen])
            y = np.zeros_like(mask)
            for j, c in enumerate(chosen):
                y[: len(c[1]), j] = c[1]
            hf, kf = _lstm(x, w, "f", mask)
            hb, kb = _lstm(x, w, "b", mask)
            both = np.concatenate([hf, hb, x], axis=2)
            d = (1 / (1 + np.exp(-(both @ w["out"] + w["bias"])[:, :, 0])) - y) * mask / mask.sum()
            grad = {k: np.zeros_like(v) for k, v in w.items()}
            grad["out"] += np.tensordot(both, d[:, :, None], ([0, 1], [0, 1]))
            grad["bias"] += d.sum()
            back = d[:, :, None] @ w["out"].T[None]
            _lstm_back(x, w, "f", mask, kf, back[:, :, :HIDDEN], grad)
            _lstm_back(x, w, "b", mask, kb, back[:, :, HIDDEN : 2 * HIDDEN], grad)
            step += 1
            rate = 0.01 * (1 - turn / passes) + 0.001
            for k in w:  # Adam
                first[k] = 0.9 * first[k] + 0.1 * grad[k]
                second[k] = 0.99 * second[k] + 0.01 * grad[k] ** 2
                w[k] = w[k] - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-7)
    return w


def main_text(pages: DataFrame, weights: dict[str, np.ndarray] | None = None) -> DataFrame:
    """(page_id, url, text, n_chars) of every row: the blocks found to be the article's, a line each.

    One pass without a shuffle.  A page without such blocks, an empty or a null html has the
    empty text and 0 characters; repeated rows are extracted each; null ids and urls stay;
    other columns are ignored.
    """
    shared = pages.sparkSession.sparkContext.broadcast(weights or stored())

    def run(batches):
        for part in slices(batches, "html", 2_000_000):
            found = [blocks(h or "") for h in part.column(2).to_pylist()]
            marks = predict([vectors(b) if len(b) <= WINDOW else np.zeros((0, WIDTH), np.float32) for b in found], shared.value)
            marks = [predict_long(b, shared.value) if len(b) > WINDOW else m for b, m in zip(found, marks, strict=True)]
            texts = ["\n".join(b.text for b, p in zip(bs, ps, strict=True) if p >= 0.5) for bs, ps in zip(found, marks, strict=True)]
            yield pa.record_batch([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], ["page_id", "url", "text", "n_chars"])

    chosen = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return chosen.mapInArrow(run, "page_id long, url string, text string, n_chars long")


if __name__ == "__main__":
    np.savez(WEIGHTS, **trained())
