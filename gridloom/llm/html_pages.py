"""Main text of web pages: a bidirectional LSTM in numpy labels every block of a page by its tag path and its words.

A page is read once by a tag scanner into blocks: maximal stretches of text between block-level tags, each with the path
of open elements and what their class, id and role say.  Elements that hold no prose by definition (scripts, styles, head,
forms and their controls, ...) give no blocks.  Each block's vector is the sum of hashed embeddings: path steps (tag, and words of
class, id and role), all its words hashed, and dense features (length, link share, punctuation).  The LSTM reads the
sequence of blocks of the whole page in both directions, so a block is judged in the document's context; blocks
labelled as content are joined in page order by two line feeds.

The network is trained here, at first use in a process, on pages that `templates` makes from a seed: many layouts of
navigation, headers, sidebars, notices, adverts, forms, comments and footers round an article.  Training is
deterministic.

Defined results: null and empty pages give ''; markup that never closes ends at the page's end; character references are
decoded; white space inside a block becomes one space; a page without content gives ''.  Repeated rows get equal
results.  A page of any length is one sequence: the network reads it in slices of MOST blocks, and the state of each
direction goes on from slice to slice.  All attributes and all open elements are tracked; only of a path with more than
STEPS different steps the middle ones are no features.
"""

from __future__ import annotations

import html as entities
import random
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

# Parameters: rows of the embedding, its width, hidden units, blocks of a slice, training pages, passes, seed.
ROWS, WIDE, HIDDEN, MOST, PAGES, PASSES, SEED = 4096, 24, 20, 512, 900, 4, 3
#: Share of the rows that are for words, and the weight of the mean of a block's words beside the sum of its path.
WORD_ROWS, WORD_WEIGHT = 1024, 0.15
#: Steps of a path that count once more for being near, and different steps of a path that are features (open elements aren't bounded).
NEAR, STEPS = 6, 2000

# Elements by their part in a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("head script style noscript template title textarea select option button form svg math iframe object canvas audio video map datalist dialog".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
#: A block tag that, opened, ends an open paragraph.
ENDS_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>=]++|=\s*+(?:\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z)|[^\s>]*+))*+)(?:>|\Z)", re.S)
#: A name and its value; a quote opens a value only right after the equals sign.
ATTRIBUTE = re.compile(r"([^\s=/]+)(?:\s*=\s*(?:\"([^\"]*)\"?|'([^']*)'?|([^\s>]*)))?", re.S)
#: Attributes whose words are part of the path.
NAMING = frozenset("class id role itemprop aria-label".split())
SPACES = re.compile(r"\s+")
NAME = re.compile(r"[a-z]+|[0-9]+")
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


class Block:
    __slots__ = ("link", "path", "text")

    def __init__(self, path: tuple[str, ...], text: str, link: int):
        self.path, self.text, self.link = path, text, link


@lru_cache(65_536)
def step(tag: str, attributes: str) -> tuple[str, tuple[str, ...], bool]:
    """What an element adds to the path: its tag, the words of its names, and whether it is hidden."""
    words, hidden = [], False
    for m in ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "hidden":
            hidden = True
        elif name == "style":
            hidden |= bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I))
        elif name in NAMING:
            words += [f".{w}" for w in NAME.findall(CAMEL.sub(" ", value).lower()) if not w.isdigit()]
    return f"<{tag}", tuple(words), hidden


def extended(path: tuple[str, ...], steps: tuple[str, ...]) -> tuple[str, ...]:
    """A path and what follows.  Of a long one repeats go, which features don't count, and then, beyond STEPS different steps, those in the middle."""
    path += steps
    if len(path) > STEPS:
        path = (*dict.fromkeys(path[:-NEAR]), *path[-NEAR:])
        if len(path) > STEPS:
            path = path[: STEPS // 2] + path[-STEPS // 2 :]
    return path


def blocks(page: str) -> list[Block]:
    out: list[Block] = []
    parts: list[str] = []
    stack: list[tuple[str, tuple[str, ...], bool, int]] = []  # element, path up to it, silent, place of the last element that isn't inline
    opened: Counter[str] = Counter()  # elements on the stack
    path: tuple[str, ...] = ()
    silent, link, linked, at = False, 0, 0, 0

    def flush() -> None:
        nonlocal linked
        if parts:
            text = SPACES.sub(" ", "".join(parts)).strip()
            parts.clear()
            if text:
                out.append(Block(path, text, min(linked, len(text))))
        linked = 0

    def add(raw: str) -> None:
        nonlocal linked
        if raw and not silent:
            text = entities.unescape(raw) if "&" in raw else raw
            parts.append(text)
            linked += len(text) if link else 0

    def pop_to(k: int) -> None:
        nonlocal path, silent, link
        opened.subtract(s[0] for s in stack[k:])
        del stack[k:]
        path, silent = (stack[-1][1], stack[-1][2]) if stack else ((), False)
        link = opened["a"]

    n = len(page)
    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            add(page[at:])
            break
        if lt > at:
            add(page[at:lt])
        m = TOKEN.match(page, lt)
        if not m:
            add("<")
            at = lt + 1
            continue
        at, tag = m.end(), (m[2] or "").lower()
        if not tag:
            continue
        if tag == "br" or tag == "wbr":
            if tag == "br" and not silent:
                parts.append(" ")
            continue
        inline = tag in INLINE
        if not inline:
            flush()
        if m[1]:
            if not opened[tag]:
                continue
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    pop_to(k)
                    break
            continue
        if tag in VOID:
            continue
        if tag in ENDS_P:
            # an open paragraph ends, with the inline elements left open in it
            k = stack[-1][3] if stack else -1
            if k >= 0 and stack[k][0] == "p":
                pop_to(k)
        elif tag in ("li", "dt", "dd", "tr", "td", "th"):
            k = len(stack)
            while k and (k := stack[k - 1][3]) >= 0:
                if stack[k][0] == tag or (tag in ("dt", "dd") and stack[k][0] in ("dt", "dd")):
                    pop_to(k)
                    break
                if stack[k][0] in ("ul", "ol", "dl", "table", "menu", "nav", "div", "section", "article"):
                    break
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            at = end.end() if end else n
            if tag not in ("noscript", "xmp"):
                continue
            continue
        if m[3].rstrip().endswith("/") and tag not in ENDS_P and tag not in INLINE:
            continue
        name, words, hidden = step(tag, m[3]) if len(m[3]) <= 2000 else step.__wrapped__(tag, m[3])
        silent = silent or hidden or tag in SILENT
        if not inline or words:
            path = extended(path, (name, *words))
        stack.append((tag, path, silent, len(stack) if not inline else stack[-1][3] if stack else -1))
        opened[tag] += 1
        link = opened["a"]
    flush()
    return out


# ---------------------------------------------------------------- vectors


def _row(kind: str, word: str) -> int:
    return WORD_ROWS + zlib.crc32(f"{kind}{word}".encode()) % (ROWS - WORD_ROWS)


@lru_cache(200_000)
def _path_rows(path: tuple[str, ...]) -> tuple[int, ...]:
    near = path[-NEAR:]
    return tuple(_row("p", w) for w in dict.fromkeys(path)) + tuple(_row("n", w) for w in dict.fromkeys(near))


@lru_cache(200_000)
def _word_row(word: str) -> int:
    return zlib.crc32(word.strip(".,:;!?()\"'").encode()) % WORD_ROWS


def _words_of(text: str) -> tuple[list[int], list[float]]:
    """Rows of all words of a text and their shares of it; a long text's rows are counted, so there are at most WORD_ROWS."""
    rows = [_word_row(w) for w in text.lower().split()]
    if len(rows) <= WORD_ROWS:
        return rows, [1 / max(1, len(rows))] * len(rows)
    own, count = np.unique(rows, return_counts=True)
    return own.tolist(), (count / len(rows)).tolist()


DENSE = 8


def vectors(bs: list[Block], first: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Embedding rows of all blocks one after another, their weights, where each block's begin, and dense features; first: blocks of the page before these."""
    ids: list[int] = []
    weights: list[float] = []
    begin, dense = [], np.zeros((len(bs), DENSE), np.float32)
    for k, b in enumerate(bs):
        begin.append(len(ids))
        steps = _path_rows(b.path) if len(b.path) <= 200 else _path_rows.__wrapped__(b.path)
        ids += steps
        rows, count = _words_of(b.text)
        ids += rows
        weights += [1.0] * len(steps)
        weights += [WORD_WEIGHT * c for c in count]
        n = len(b.text)
        dense[k] = (np.log1p(n) / 8, b.link / n, b.text.count(" ") / n * 5, b.text[-1] in ".!?\"'", n < 30, n > 200, first + k == 0, min(first + k, 50) / 50)
    return np.array(ids, np.int64), np.array(weights, np.float32), np.array(begin, np.int64), dense


# ---------------------------------------------------------------- network


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Lstm:
    """One direction over padded sequences x (T, B, D); masked steps keep the state."""

    def __init__(self, rng: np.random.Generator, d: int, h: int):
        self.w = (rng.standard_normal((d + h, 4 * h)) / np.sqrt(d + h)).astype(np.float32)
        self.b = np.zeros(4 * h, np.float32)
        self.b[h : 2 * h] = 1
        self.h = h

    def forward(self, x: np.ndarray, mask: np.ndarray, keep: bool = False, state: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, list, tuple[np.ndarray, np.ndarray]]:
        """Outputs, what backward needs, and the state (h, c) after the last step; `state`: the one to begin with."""
        t, b, d = x.shape
        h, c = state or (np.zeros((b, self.h), np.float32), np.zeros((b, self.h), np.float32))
        out, kept = np.zeros((t, b, self.h), np.float32), []
        pre = x.reshape(t * b, d) @ self.w[:d] + self.b
        pre = pre.reshape(t, b, -1)
        for k in range(t):
            z = pre[k] + h @ self.w[d:]
            i, f, o = (sigmoid(z[:, s * self.h : (s + 1) * self.h]) for s in range(3))
            g = np.tanh(z[:, 3 * self.h :])
            m = mask[k][:, None]
            c2 = f * c + i * g
            tc = np.tanh(c2)
            h2 = o * tc
            if keep:
                kept.append((h, c, i, f, o, g, tc, m))
            c, h = np.where(m, c2, c), np.where(m, h2, h)
            out[k] = h
        return out, kept, (h, c)

    def backward(self, x: np.ndarray, kept: list, dout: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        t, b, d = x.shape
        dw, db, dx = np.zeros_like(self.w), np.zeros_like(self.b), np.zeros_like(x)
        dh, dc = np.zeros((b, self.h), np.float32), np.zeros((b, self.h), np.float32)
        for k in range(t - 1, -1, -1):
            h, c, i, f, o, g, tc, m = kept[k]
            dh = dh + dout[k]
            dh2, dc2 = dh * m, dc * m
            dc2 = dc2 + dh2 * o * (1 - tc**2)
            dz = np.concatenate([dc2 * g * i * (1 - i), dc2 * c * f * (1 - f), dh2 * tc * o * (1 - o), dc2 * i * (1 - g**2)], 1)
            dw[:d] += x[k].T @ dz
            dw[d:] += h.T @ dz
            db += dz.sum(0)
            dx[k] = dz @ self.w[:d].T
            dh, dc = dh * ~m + dz @ self.w[d:].T, dc * ~m + dc2 * f
        return dw, db, dx


class Labeller:
    def __init__(self, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.emb = (rng.standard_normal((ROWS, WIDE)) * 0.1).astype(np.float32)
        d = WIDE + DENSE
        self.ahead, self.back = Lstm(rng, d, HIDDEN), Lstm(rng, d, HIDDEN)
        self.out = (rng.standard_normal(2 * HIDDEN + d) * 0.1).astype(np.float32)
        self.bias = np.zeros(1, np.float32)

    def inputs(self, bs: list[Block], first: int = 0) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray]]:
        ids, weights, begin, dense = vectors(bs, first)
        summed = np.add.reduceat(self.emb[ids] * weights[:, None], begin) if len(bs) else np.zeros((0, WIDE), np.float32)
        return np.concatenate([summed, dense], 1), (ids, weights, begin)

    @staticmethod
    def padded(xs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        t = max(len(x) for x in xs)
        out, mask = np.zeros((t, len(xs), xs[0].shape[1]), np.float32), np.zeros((t, len(xs)), bool)
        for k, x in enumerate(xs):
            out[: len(x), k], mask[: len(x), k] = x, True
        return out, mask

    def logits(self, x: np.ndarray, mask: np.ndarray, keep: bool = False):
        a, ka, _ = self.ahead.forward(x, mask, keep)
        b, kb, _ = self.back.forward(x[::-1], mask[::-1], keep)
        full = np.concatenate([a, b[::-1], x], 2)
        return full @ self.out + self.bias, full, ka, kb

    def label(self, pages: list[list[Block]]) -> list[np.ndarray]:
        """Content or not, for each block of each page."""
        out = [np.zeros(len(p), bool) for p in pages]
        order = sorted((k for k, p in enumerate(pages) if p), key=lambda k: len(pages[k]))
        at = 0
        while at < len(order):
            stop = at + 1
            while stop < len(order) and (stop - at + 1) * len(pages[order[stop]]) <= 16_384:
                stop += 1
            group = order[at:stop]
            for k, z in zip(group, self.sliced([pages[k] for k in group]), strict=True):
                out[k] = z > 0
            at = stop
        return out

    def sliced(self, pages: list[list[Block]], most: int = MOST) -> list[np.ndarray]:
        """Logits of whole pages: slices of at most `most` blocks bound the memory, and each direction carries its state across them."""
        longest = max(map(len, pages))
        cuts = range(0, longest, most)

        def piece(s: int) -> tuple[np.ndarray, np.ndarray]:
            xs = [self.inputs(p[s : s + most], s)[0] for p in pages]
            return self.padded(xs)

        if len(cuts) == 1:
            z = self.logits(*piece(0))[0]
        else:
            z, state, h = np.zeros((longest, len(pages)), np.float32), None, HIDDEN
            for s in cuts:
                x, mask = piece(s)
                a, _, state = self.ahead.forward(x, mask, state=state)
                z[s : s + most] = a @ self.out[:h] + x @ self.out[2 * h :] + self.bias
            state = None
            for s in reversed(cuts):
                x, mask = piece(s)
                b, _, state = self.back.forward(x[::-1], mask[::-1], state=state)
                z[s : s + most] += b[::-1] @ self.out[h : 2 * h]
        return [z[: len(p), k] for k, p in enumerate(pages)]

    def train(self, pages: list[tuple[list[Block], list[bool]]], passes: int = PASSES, rate: float = 0.01, batch: int = 16) -> Labeller:
        rng = np.random.default_rng(SEED + 1)
        params = {"emb": self.emb, "aw": self.ahead.w, "ab": self.ahead.b, "bw": self.back.w, "bb": self.back.b, "out": self.out, "bias": self.bias}
        m1, m2, steps = {k: np.zeros_like(v) for k, v in params.items()}, {k: np.zeros_like(v) for k, v in params.items()}, 0
        pages = [p for p in pages if p[0]]
        for _ in range(passes):
            order = rng.permutation(len(pages))
            order = sorted(range(len(pages)), key=lambda k: (len(pages[order[k]][0]) // 16, k))
            groups = [order[i : i + batch] for i in range(0, len(order), batch)]
            for gi in rng.permutation(len(groups)):
                group = [pages[k] for k in groups[gi]]
                got = [self.inputs(p) for p, _ in group]
                x, mask = self.padded([g[0] for g in got])
                y = np.zeros(mask.shape, np.float32)
                for k, (_, labels) in enumerate(group):
                    y[: len(labels), k] = labels
                z, full, ka, kb = self.logits(x, mask, True)
                dz = np.where(mask, sigmoid(z) - y, 0) / mask.sum()
                dfull = dz[..., None] * self.out
                h = HIDDEN
                daw, dab, dxa = self.ahead.backward(x, ka, dfull[..., :h])
                dbw, dbb, dxb = self.back.backward(x[::-1], kb, dfull[::-1, :, h : 2 * h])
                dx = dxa + dxb[::-1] + dfull[..., 2 * h :]
                demb = np.zeros_like(self.emb)
                for k, (_, (ids, weights, begin)) in enumerate(got):
                    np.add.at(demb, ids, np.repeat(dx[: len(begin), k, :WIDE], np.diff(np.append(begin, len(ids))), 0) * weights[:, None])
                grads = {"emb": demb, "aw": daw, "ab": dab, "bw": dbw, "bb": dbb, "out": (dz[..., None] * full).sum((0, 1)), "bias": np.array([dz.sum()], np.float32)}
                steps += 1
                for k, g in grads.items():
                    g = np.clip(g, -1, 1)
                    m1[k] += 0.1 * (g - m1[k])
                    m2[k] += 0.01 * (g * g - m2[k])
                    params[k] -= (rate * (m1[k] / (1 - 0.9**steps)) / (np.sqrt(m2[k] / (1 - 0.99**steps)) + 1e-7)).astype(np.float32)
        return self


# ---------------------------------------------------------------- training pages


def templates(n: int, seed: int = SEED) -> Iterator[str]:
    """Pages of many layouts; content blocks begin with the mark U+0001, which training takes off."""
    rng = random.Random(seed)
    pick, some = rng.choice, rng.random
    syllables = "the and of to in er on th re an ti es le que de en un la los der die und sch ver ou ai pa mo ra ta ci ko lin sto bre".split()

    def word() -> str:
        return "".join(pick(syllables) for _ in range(rng.randint(1, 4)))

    def words(a: int, b: int) -> str:
        return " ".join(word() for _ in range(rng.randint(a, b)))

    def sentence(a: int = 3, b: int = 22) -> str:
        return words(a, b).capitalize() + pick(".....!?")

    def prose(a: int, b: int) -> str:
        return " ".join(sentence() for _ in range(rng.randint(a, b)))

    def named(*names: str) -> str:
        name = pick(names)
        k = some()
        if k < 0.65:
            return f' class="{name}{pick(["", "", " " + word(), "-" + word(), " clearfix"])}"'
        return f' id="{name}"' if k < 0.9 else f' class="{pick(["page", "site", "l"])}-{name}"'

    def links(a: int, b: int) -> str:
        items = [f'<a href="/{word()}">{words(1, 3)}</a>' for _ in range(rng.randint(a, b))]
        k = some()
        if k < 0.6:
            return "<ul>" + "".join(f"<li>{i}</li>" for i in items) + "</ul>"
        return pick([" | ", " ", " &middot; "]).join(items) if k < 0.85 else "".join(f"<div>{i}</div>" for i in items)

    def nav() -> str:
        return pick([f"<nav>{links(2, 9)}</nav>", f"<div{named('nav', 'menu', 'navbar', 'topbar', 'navigation', 'breadcrumb', 'breadcrumbs')}>{links(2, 9)}</div>", f'<div role="navigation">{links(2, 9)}</div>', f"<ul{named('menu', 'nav', 'tabs', 'pagination')}>" + "".join(f'<li><a href="#">{words(1, 2)}</a></li>' for _ in range(rng.randint(2, 8))) + "</ul>"])

    def header() -> str:
        inner = pick([f"<h1>{words(1, 4)}</h1><p>{sentence(3, 9)}</p>", f'<a href="/">{words(1, 3)}</a>', f"<p>{words(2, 6)}</p>", f"<div>{words(1, 4)}</div>{nav()}", f"<div{named('logo', 'brand', 'site-title')}>{words(1, 3)}</div><p{named('tagline', 'slogan')}>{sentence()}</p>"])
        return pick([f"<header>{inner}</header>", f"<div{named('header', 'masthead', 'banner', 'top', 'site-header')}>{inner}</div>", f'<div role="banner">{inner}</div>'])

    def sidebar() -> str:
        inner = "".join(pick([f"<h3>{words(1, 4)}</h3>{links(2, 6)}", f"<p>{prose(1, 3)}</p>", f"<div>{sentence()}</div>", f"<h4>{words(1, 3)}</h4><p>{sentence()}</p>"]) for _ in range(rng.randint(1, 4)))
        return pick([f"<aside>{inner}</aside>", f"<aside{named('sidebar', 'related', 'widget')}>{inner}</aside>", f"<div{named('sidebar', 'side', 'widget', 'related', 'recommended', 'rail', 'sidecol', 'secondary', 'trending', 'popular')}>{inner}</div>", f'<div role="complementary">{inner}</div>'])

    def advert() -> str:
        inner = pick([sentence(), f"<p>{prose(1, 2)}</p>", f'<a href="http://{word()}.com">{sentence()}</a>', f"<span>{words(1, 3)}</span><p>{sentence()}</p>"])
        return f"<div{named('ad', 'ads', 'advert', 'advertisement', 'sponsored', 'promo', 'banner-ad', 'sponsor', 'adbox', 'ad-slot', 'promotion')}>{inner}</div>" if some() < 0.9 else f"<aside{named('ad', 'promo')}>{inner}</aside>"

    def notice() -> str:
        inner = pick([f"<p>{prose(1, 2)}</p>", sentence(), f"<p>We use cookies. {sentence()}</p>", f"<span>{sentence()}</span> <a href='#'>OK</a>"])
        tag = pick(["div", "div", "section", "p"]) if "<p>" not in inner else "div"
        return f"<{tag}{named('cookie', 'cookies', 'cookie-notice', 'consent', 'notice', 'gdpr', 'alert', 'banner', 'newsletter', 'subscribe', 'popup', 'modal', 'paywall', 'disclaimer', 'signup', 'cookie-banner')}>{inner}</{tag}>"

    def form() -> str:
        return pick([f"<form><label>{words(1, 2)}</label><input><button>{word()}</button></form>", f"<form{named('search', 'login', 'newsletter')}><p>{sentence()}</p><input type=text></form>", f"<div{named('search', 'login-form', 'signup', 'form')}><p>{sentence()}</p><label>{words(1, 3)}</label><input></div>"])

    def social() -> str:
        return f"<div{named('share', 'social', 'sharing', 'tags', 'byline', 'meta', 'author-box', 'print', 'toolbar', 'post-meta')}>{pick([links(2, 5), words(2, 6), sentence(3, 8)])}</div>"

    def comments() -> str:
        one = lambda: pick([f"<div{named('comment', 'reply', 'comment-body')}><p>{prose(1, 3)}</p></div>", f"<li{named('comment', 'comment')}><b>{words(1, 2)}</b><p>{prose(1, 2)}</p></li>", f"<article{named('comment', 'comment')}><p>{prose(1, 3)}</p></article>", f"<div{named('comment')}>{prose(1, 2)}</div>"])
        inner = (f"<h{pick('234')}>{pick(['Comments', 'Kommentare', 'Commentaires', words(1, 3), 'Discussion', 'Replies'])}</h{pick('234')}>" if some() < 0.7 else "") + "".join(one() for _ in range(rng.randint(1, 6)))
        return pick([f"<section{named('comments', 'discussion', 'responses', 'disqus', 'replies', 'reader-comments')}>{inner}</section>", f"<div{named('comments', 'comment-list', 'commentlist', 'discussion', 'replies', 'comments-area')}>{inner}</div>"])

    def footer() -> str:
        inner = pick([f"&copy; {rng.randint(1999, 2025)} {words(1, 3)}. {sentence()}", f"<p>&copy; {words(1, 3)} &middot; {prose(1, 3)}</p>", links(2, 8), f"<p>{sentence()}</p>{links(2, 5)}", f"&copy; {word()}.example.com &middot; {prose(1, 3)}"])
        return pick([f"<footer>{inner}</footer>", f"<footer{named('footer', 'site-footer')}>{inner}</footer>", f"<div{named('footer', 'foot', 'copyright', 'bottom', 'site-footer', 'legal')}>{inner}</div>", f'<div role="contentinfo">{inner}</div>'])

    def inline(text: str) -> str:
        ws = text.split(" ")
        for _ in range(rng.randint(0, 2)):
            k = rng.randrange(len(ws))
            ws[k] = pick(['<a href="/x">{}</a>', "<b>{}</b>", "<em>{}</em>", "<span>{}</span>", "{}&amp;", "<code>{}</code>", "<i>{}</i>"]).format(ws[k])
        return " ".join(ws)

    def content() -> str:
        m = "\x01"
        out = [f"<h{pick('1112')}>{m}{words(2, 12)}</h1>" if some() < 0.75 else ""]
        out[0] = re.sub(r"<h(\d)>(.*)</h1>", r"<h\1>\2</h\1>", out[0])
        for _ in range(pick([1, 2, 3, 4, 6, 8, 12, 20])):
            k = some()
            if k < 0.6:
                out.append(f"<p>{m}{inline(prose(1, 7))}" + pick(["</p>", "</p>", "</p>", "\n"]))
            elif k < 0.68:
                out.append(f"<p><b>{m}{sentence(1, 10)}<br>" + pick(["", "</p>"]))
            elif k < 0.74:
                out.append(f"<h{pick('234')}>{m}{words(1, 6)}</h{{}}>")
            elif k < 0.80:
                tag = pick(["ul", "ol"])
                out.append(f"<{tag}>" + "".join(f"<li>{m}{pick([words(1, 5), sentence(), inline(sentence())])}" + pick(["</li>", ""]) for _ in range(rng.randint(2, 6))) + f"</{tag}>")
            elif k < 0.84:
                out.append(f"<blockquote><p>{m}{prose(1, 2)}</p></blockquote>")
            elif k < 0.87:
                out.append(f"<pre>{m}{words(3, 12)}</pre>")
            elif k < 0.90:
                out.append("<table>" + "".join("<tr>" + "".join(f"<td>{m}{words(1, 3)}</td>" for _ in range(3)) + "</tr>" for _ in range(rng.randint(2, 4))) + "</table>")
            elif k < 0.93:
                out.append(f"<figure><img src=x><figcaption>{m}{sentence()}</figcaption></figure>")
            elif k < 0.96:
                out.append(f"<div>{m}{prose(1, 4)}</div>")
            elif k < 0.97:
                out.append(f"<p>{m}{words(1, 2)}.</p>")
            else:
                out.append(pick([advert, social, notice, form, sidebar])())
        out = [re.sub(r"<h(\d)>([^<]*)</h\{\}>", r"<h\1>\2</h\1>", x) for x in out]
        return "".join(out)

    for _ in range(n):
        wrap = pick(["<article>{}</article>"] * 4 + ["<main>{}</main>", "<main><article>{}</article></main>", f"<div{named('content', 'post', 'entry-content', 'article', 'main', 'story', 'article-body', 'post-content')}>{{}}</div>", '<div role="main">{}</div>', f"<section{named('content', 'article', 'story')}>{{}}</section>", f"<article{named('post', 'entry', 'article')}>{{}}</article>", f"<article><div{named('content', 'body', 'entry')}>{{}}</div></article>"])
        before = [f() for f in (nav, header, notice, advert, form, nav, social) if some() < 0.4]
        after = [f() for f in (sidebar, comments, advert, social, form, notice, footer, nav) if some() < 0.4]
        if some() < 0.6:
            after.append(footer())
        body = "".join(before) + wrap.format(content()) + "".join(after)
        if some() < 0.15:
            body = f"<div{named('wrapper', 'container', 'page')}>{body}</div>"
        page = f"<!DOCTYPE html><html><head><meta charset=utf-8><title>{words(2, 6)}</title><style>p{{}}</style></head><body>{body}"
        yield page + ("</body></html>" if some() < 0.9 else "")


def training(n: int = PAGES, seed: int = SEED) -> list[tuple[list[Block], list[bool]]]:
    out = []
    for page in templates(n, seed):
        bs = blocks(page)
        labels = ["\x01" in b.text for b in bs]
        for b in bs:
            b.text = b.text.replace("\x01", "") or "."
        out.append((bs, labels))
    return out


@lru_cache(1)
def labeller() -> Labeller:
    return Labeller().train(training())


# ---------------------------------------------------------------- Spark

TEXTS = "page_id long, url string, text string, n_chars long"


def extract(pages: DataFrame, model: Labeller | None = None, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url, text, n_chars (code points) for every row."""
    shared = pages.sparkSession.sparkContext.broadcast(model or labeller())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in (b.slice(i, 200) for i in range(0, len(b), 200)):
                found = [blocks(h) if h else [] for h in part.column(2).to_pylist()]
                texts = ["\n\n".join(x.text for x, keep in zip(bs, mask.tolist(), strict=True) if keep) for bs, mask in zip(found, shared.value.label(found), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(pages[key].cast("long").alias("page_id"), pages[url].cast("string").alias("url"), pages[html].cast("string").alias("html")).mapInArrow(run, TEXTS)
