"""Main text of web pages: a bidirectional LSTM labels the leaf blocks of a page.

A page is cut into blocks, the text between block-level tags. A block is described by hashed tokens
of its tag path (tags, classes, ids, roles), hashed words and a few measures; the network reads a
page's blocks in both directions and keeps or drops each in the light of all others. It is written
in numpy and trained here, on pages that a rule writes with known labels.
"""

from __future__ import annotations

import html
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PATH_BUCKETS, WORD_BUCKETS, MEASURES = 512, 128, 8
FEATURES = PATH_BUCKETS + WORD_BUCKETS + MEASURES
EMBED, HIDDEN = 32, 24
#: Pages that training writes, and passes over them.
TRAIN_PAGES, EPOCHS, SEED = 1200, 8, 7
#: Share of training pages whose tag paths are hidden.
BLIND = 0.05
#: Pages that a task labels together, in bytes of html.
LOT = 4 << 20
#: Blocks (or steps of a long page) whose matrices are held together.
PART = 4096

INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is never text of the page.
OPAQUE = "script|style|template|title|textarea|svg|iframe|object|noframes|math"
#: A start tag that ends an open element of these names.
ENDS = {k: frozenset(v.split()) for k, v in {"li": "li", "dt": "dt dd", "dd": "dt dd", "tr": "tr td th", "td": "td th", "th": "td th", "option": "option"}.items()}

_TAG = re.compile(r"<(/?)([A-Za-z][A-Za-z0-9:-]*)")
#: The rest of a tag; a quoted ``>`` doesn't end it.
_TAG_END = re.compile(r"(?:[^'\">]++|\"[^\"]*+\"|'[^']*+')*+>")
_CLOSING = {tag: re.compile(rf"</{tag}\s*+>", re.IGNORECASE) for tag in OPAQUE.split("|")}
_ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|itemprop|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.IGNORECASE)
_NAME_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_LONG_NUMBER = re.compile(r"&#[xX]?[0-9a-fA-F]{9,};?")
#: Longer words and attributes aren't kept in the caches.
CACHED = 256


@lru_cache(1 << 16)
def _kept_bucket(token: str, buckets: int) -> int:
    return zlib.crc32(token.encode("utf-8", "replace")) % buckets


def _bucket(token: str, buckets: int) -> int:
    return (_kept_bucket if len(token) < CACHED else _kept_bucket.__wrapped__)(token, buckets)


@lru_cache(1 << 14)
def _kept_tokens(tag: str, more: str) -> tuple[int, ...]:
    out = [_bucket(f"t:{tag}", PATH_BUCKETS)]
    for name, *values in _ATTRIBUTE.findall(more):
        out += [_bucket(f"n:{part.lower()}", PATH_BUCKETS) for part in _NAME_PARTS.findall("".join(values))]
        if name.lower() == "hidden":
            out.append(_bucket("hidden", PATH_BUCKETS))
    return tuple(dict.fromkeys(out))


def path_tokens(tag: str, more: str) -> tuple[int, ...]:
    """Distinct buckets of an element's tag and of the parts of its class, id and role names."""
    return (_kept_tokens if len(more) < CACHED else _kept_tokens.__wrapped__)(tag, more)


def unescaped(text: str) -> str:
    """Text with its character references decoded; numbers beyond Unicode, however long, are U+FFFD."""
    if "&" not in text:
        return text
    return html.unescape(_LONG_NUMBER.sub("\ufffd", text) if "&#" in text else text)


class Block:
    __slots__ = ("linked", "node", "own", "text")

    def __init__(self, text: str, node: int, own: str, linked: int):
        self.text, self.node, self.own, self.linked = text, node, own, linked


class Page:
    """A page's blocks, and its elements as a tree: each node's parent, and the path tokens that it adds to its parent's."""

    __slots__ = ("blocks", "depth", "parent", "tokens")

    def __init__(self) -> None:
        self.blocks: list[Block] = []
        self.parent, self.depth, self.tokens = [0], [0], [()]

    def path(self, node: int) -> list[int]:
        found: list[int] = []
        while node:
            found += self.tokens[node]
            node = self.parent[node]
        return found


class _Open:
    """The open elements, with all that is asked of them kept up to date: nothing walks down the stack."""

    def __init__(self, page: Page):
        self.page = page
        self.stack: list[tuple[str, tuple[int, ...], int, str]] = []  # tag, tokens, node, innermost element that isn't inline
        self.at: dict[str, list[int]] = {}
        self.stops: dict[frozenset[str], list[int]] = {k: [] for k in (_BLOCK_STOP, _P_STOP, _LIST_STOP)}
        self.seen = [0] * PATH_BUCKETS

    def push(self, tag: str, tokens: tuple[int, ...]) -> None:
        page, k = self.page, len(self.stack)
        node = len(page.parent)
        page.parent.append(self.stack[-1][2] if k else 0)
        page.depth.append(k + 1)
        page.tokens.append(tuple(t for t in tokens if not self.seen[t]))
        for t in tokens:
            self.seen[t] += 1
        self.stack.append((tag, tokens, node, tag if tag not in INLINE else self.own))
        self.at.setdefault(tag, []).append(k)
        for names, places in self.stops.items():
            if tag in names:
                places.append(k)

    def close(self, names: frozenset[str], until: frozenset[str] | None) -> None:
        """Close the innermost element of these names and all inside it, unless one of ``until`` lies between."""
        k = max((self.at[t][-1] for t in names if self.at.get(t)), default=-1)
        if k < 0 or (until is not None and self.stops[until] and self.stops[until][-1] > k):
            return
        while len(self.stack) > k:
            tag, tokens, _, _ = self.stack.pop()
            self.at[tag].pop()
            for t in tokens:
                self.seen[t] -= 1
            for places in self.stops.values():
                if places and places[-1] == len(self.stack):
                    places.pop()

    @property
    def own(self) -> str:
        return self.stack[-1][3] if self.stack else ""


def tokens_of(page: str) -> Iterator[tuple[int, int, str | None, bool, str]]:
    """(start, end, tag, is an end tag, attributes) of a page's markup; the tag is None for what isn't an element's text.

    Each character is looked at a few times at most: where a tag doesn't end because of its quotes,
    the rest of the page is read without regard to quotes.
    """
    at, quotes, last = 0, True, page.rfind(">")
    while (start := page.find("<", at)) >= 0:
        at = start + 1
        head = page[start : start + 9]
        if head.startswith("<!--") or head == "<![CDATA[":
            mark = "-->" if head[2] == "-" else "]]>"
            end = page.find(mark, start + (4 if mark == "-->" else 9))
            at = end + 3 if end >= 0 else len(page)
            yield start, at, None, False, ""
        elif head[1:2] in ("!", "?"):
            end = page.find(">", start)
            at = end + 1 if end >= 0 else len(page)
            yield start, at, None, False, ""
        elif start < last and (m := _TAG.match(page, start)):
            end = _TAG_END.match(page, m.end()) if quotes else None
            quotes = end is not None
            stop = end.end() if end else page.find(">", m.end()) + 1
            tag, more = m[2].lower(), page[m.end() : stop - 1]
            at = stop
            if tag in _CLOSING and not m[1]:
                if not more.endswith("/"):
                    closing = _CLOSING[tag].search(page, stop)
                    at = closing.end() if closing else len(page)
                yield start, at, None, False, ""
            else:
                yield start, at, tag, bool(m[1]), more


def blocks_of(html_text: str) -> Page:
    """A page's blocks in order, white space made single; blocks without text are left out."""
    page = Page()
    open_ = _Open(page)
    text: list[str] = []
    linked, at = 0, 0

    def flush() -> None:
        nonlocal linked
        if text:
            whole = " ".join("".join(text).split())
            if whole:
                page.blocks.append(Block(whole, open_.stack[-1][2] if open_.stack else 0, open_.own, linked))
            text.clear()
        linked = 0

    for start, end, tag, closes, more in tokens_of(html_text):
        if start > at:
            piece = unescaped(html_text[at:start])
            text.append(piece)
            if open_.at.get("a"):
                linked += len(piece)
        at = end
        if tag is None:
            continue
        if tag == "br":
            text.append(" ")
        elif closes:
            if tag not in INLINE:
                flush()
            open_.close(frozenset((tag,)), None if tag not in INLINE else _BLOCK_STOP)
        else:
            if tag not in INLINE:
                flush()
                open_.close(_P, _P_STOP)
                if tag in ENDS:
                    open_.close(ENDS[tag], _LIST_STOP)
            if tag not in VOID and not more.endswith("/"):
                open_.push(tag, path_tokens(tag, more))
    if at < len(html_text):
        text.append(unescaped(html_text[at:]))
    flush()
    return page


_P = frozenset("p")
_BLOCK_STOP = frozenset("article aside body div footer form header li main nav ol p section table td th tr ul".split())
_P_STOP = frozenset("article aside body button div footer form header li main nav ol section table td th ul blockquote".split())
_LIST_STOP = frozenset("ul ol dl table article aside body div footer form header main nav section".split())


def measures(page: Page) -> np.ndarray:
    """Eight measures of each block: lengths, links, marks and place."""
    blocks = page.blocks
    n = np.array([len(b.text) for b in blocks], np.float32)
    k = np.arange(len(blocks), dtype=np.float32)
    marks = np.array([sum(map(b.text.count, ".,;:!?")) for b in blocks], np.float32)
    count = np.array([b.text.count(" ") + 1 for b in blocks], np.float32)
    linked = np.array([b.linked for b in blocks], np.float32)
    columns = (np.log1p(n) / 8, linked / n, marks / n * 10, k / len(blocks), (len(blocks) - 1 - k) / len(blocks), n / max(1, n.max(initial=1)), np.minimum(1, count / 40), np.ones_like(n))
    return np.stack(columns, 1).astype(np.float32)


def words_of(blocks: list[Block]) -> np.ndarray:
    """The share of each hashed word in each block."""
    lists = [[_bucket(w, WORD_BUCKETS) for w in b.text.split(" ")] for b in blocks]
    sizes = np.array([len(x) for x in lists], np.int64)
    cells = np.repeat(np.arange(len(blocks)) * WORD_BUCKETS, sizes) + np.fromiter((w for x in lists for w in x), np.int64, int(sizes.sum()))
    return (np.bincount(cells, minlength=len(blocks) * WORD_BUCKETS).reshape(len(blocks), WORD_BUCKETS) / sizes[:, None]).astype(np.float32)


def features(pages: list[Page]) -> tuple[np.ndarray, np.ndarray]:
    """A dense row of features for each block of the pages (to train on), and each page's number of blocks."""
    sizes = np.array([len(p.blocks) for p in pages], np.int64)
    out = np.zeros((int(sizes.sum()), FEATURES), np.float32)
    k = 0
    for page in pages:
        for b in page.blocks:
            out[k, page.path(b.node)] = 1
            out[k, _bucket(f"o:{b.own}", PATH_BUCKETS)] += 1
            k += 1
        if page.blocks:
            own = out[k - len(page.blocks) : k]
            own[:, PATH_BUCKETS : PATH_BUCKETS + WORD_BUCKETS] = words_of(page.blocks)
            own[:, PATH_BUCKETS + WORD_BUCKETS :] = measures(page)
    return out, sizes


# ------------------------------------------------------------------------------ network


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Labeller:
    """Blocks to keep-probabilities: an embedding, an LSTM in either direction, one output."""

    def __init__(self, seed: int = SEED):
        r = np.random.default_rng(seed)
        init = lambda *shape: (r.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        self.p = {"E": init(FEATURES, EMBED) * 3, "e": np.zeros(EMBED, np.float32), "o": init(2 * HIDDEN + EMBED, 1), "c": np.zeros(1, np.float32)}
        for d in "fb":
            self.p |= {f"{d}x": init(EMBED, 4 * HIDDEN), f"{d}h": init(HIDDEN, 4 * HIDDEN), f"{d}c": np.repeat(np.float32([0, 1, 0, 0]), HIDDEN)}

    def _run(self, d: str, e: np.ndarray, mask: np.ndarray, keep: list | None, state: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray]]:
        """Hidden states over (time, page) and the last state; padding leaves the state as it is."""
        steps, n, _ = e.shape
        gates = e @ self.p[f"{d}x"] + self.p[f"{d}c"]
        h, c = state or (np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32))
        out = np.zeros((steps, n, HIDDEN), np.float32)
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            z = gates[t] + h @ self.p[f"{d}h"]
            i, f, o = (_sigmoid(z[:, k * HIDDEN : (k + 1) * HIDDEN]) for k in range(3))
            g = np.tanh(z[:, 3 * HIDDEN :])
            m = mask[t][:, None]
            new = f * c + i * g
            tc = np.tanh(new)
            if keep is not None:
                keep.append((t, i, f, o, g, c, tc, h, m))
            c = np.where(m, new, c)
            h = np.where(m, o * tc, h)
            out[t] = h
        return out, (h, c)

    def _paths(self, pages: list[Page]) -> np.ndarray:
        """Sums of the embeddings of every node's path tokens, level by level; the pages' nodes stand one after the other."""
        e = self.p["E"]
        sizes = np.array([len(p.parent) for p in pages], np.int64)
        base = np.repeat(np.cumsum(sizes) - sizes, sizes)
        parent = np.fromiter((x for p in pages for x in p.parent), np.int64, len(base)) + base
        depth = np.fromiter((x for p in pages for x in p.depth), np.int64, len(base))
        added = np.fromiter((len(t) for p in pages for t in p.tokens), np.int64, len(base))
        flat = np.fromiter((x for p in pages for t in p.tokens for x in t), np.int64, int(added.sum()))
        out = np.zeros((len(base), EMBED), np.float32)
        has, first = np.flatnonzero(added), (np.cumsum(added) - added)
        for lo in range(0, len(has), PART):
            part = has[lo : lo + PART]
            a, z = int(first[part[0]]), int(first[part[-1]] + added[part[-1]])
            out[part] = np.add.reduceat(e[flat[a:z]], first[part] - a, 0)
        order = np.argsort(depth, kind="stable")
        edge = np.searchsorted(depth[order], np.arange(1, int(depth.max(initial=0)) + 2))
        for a, z in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
            level = order[a:z]
            out[level] += out[parent[level]]
        return out

    def _embedded(self, pages: list[Page]) -> np.ndarray:
        """The embedding of each block, as of its dense features, part by part."""
        e, words = self.p["E"], slice(PATH_BUCKETS, PATH_BUCKETS + WORD_BUCKETS)
        paths = self._paths(pages)
        base = np.cumsum([0, *(len(p.parent) for p in pages)])
        out, k = np.zeros((sum(len(p.blocks) for p in pages), EMBED), np.float32), 0
        for i, page in enumerate(pages):
            if not page.blocks:
                continue
            own = np.array([_bucket(f"o:{b.own}", PATH_BUCKETS) for b in page.blocks], np.int64)
            x = paths[base[i] + np.array([b.node for b in page.blocks], np.int64)] + measures(page) @ e[PATH_BUCKETS + WORD_BUCKETS :]
            x += e[own]
            out[k : k + len(x)] = x
            k += len(x)
        blocks = [b for p in pages for b in p.blocks]
        for lo in range(0, len(blocks), PART):
            out[lo : lo + PART] = np.tanh(out[lo : lo + PART] + words_of(blocks[lo : lo + PART]) @ e[words] + self.p["e"])
        return out

    def probabilities(self, pages: list[Page]) -> np.ndarray:
        """One for each block of the pages; pages of like length go together, long ones in parts that hand on the state."""
        sizes = np.array([len(p.blocks) for p in pages], np.int64)
        e_all = self._embedded(pages)
        out = np.zeros(len(e_all), np.float32)
        first = np.cumsum(sizes) - sizes
        order = [k for k in np.argsort(sizes, kind="stable").tolist() if sizes[k]]
        o = self.p["o"][:, 0]
        while order:
            most = max(1, min(512, 200_000 // max(1, int(sizes[order[-1]]))))
            lot, order = order[-most:], order[:-most]
            steps = int(sizes[lot].max())
            y = np.zeros((steps, len(lot)), np.float32)
            parts = [(t, min(steps, t + PART)) for t in range(0, steps, PART)]
            for d, weights in (("f", o[:HIDDEN]), ("b", o[HIDDEN : 2 * HIDDEN])):
                state = None
                for a, z in parts if d == "f" else reversed(parts):
                    e, mask = np.zeros((z - a, len(lot), EMBED), np.float32), np.zeros((z - a, len(lot)), bool)
                    for j, k in enumerate(lot):
                        n = max(0, min(z, int(sizes[k])) - a)
                        e[:n, j], mask[:n, j] = e_all[first[k] + a : first[k] + a + n], True
                    hidden, state = self._run(d, e, mask, None, state)
                    y[a:z] += hidden @ weights
                    if d == "f":
                        y[a:z] += e @ o[2 * HIDDEN :]
            for j, k in enumerate(lot):
                out[first[k] : first[k] + sizes[k]] = _sigmoid(y[: sizes[k], j] + self.p["c"])
        return out

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross-entropy of padded pages and its gradients, by backpropagation through time.

        ``x`` has a row of features for each true entry of ``mask`` (time, page), in its order.
        """
        p, n = self.p, mask.sum()
        e = np.zeros((*mask.shape, EMBED), np.float32)
        e[mask] = np.tanh(x @ p["E"] + p["e"])
        kept: dict[str, list] = {"f": [], "b": []}
        hidden = {d: self._run(d, e, mask, kept[d])[0] for d in "fb"}
        joined = np.concatenate([hidden["f"], hidden["b"], e], 2)
        q = _sigmoid((joined @ p["o"] + p["c"])[:, :, 0])
        loss = -np.where(mask, np.log(np.where(y, q, 1 - q) + 1e-9), 0).sum() / n
        dz = np.where(mask, q - y, 0).astype(np.float32) / n
        grad = {"o": np.einsum("tnk,tn->k", joined, dz)[:, None], "c": np.array([dz.sum()])}
        dj = dz[:, :, None] * p["o"][:, 0]
        de = dj[:, :, 2 * HIDDEN :].copy()
        for k, d in enumerate("fb"):
            dh, dc = np.zeros((mask.shape[1], HIDDEN), np.float32), np.zeros((mask.shape[1], HIDDEN), np.float32)
            gx, gh, gc = np.zeros_like(p[f"{d}x"]), np.zeros_like(p[f"{d}h"]), np.zeros_like(p[f"{d}c"])
            for t, i, f, o, g, c, tc, h, m in reversed(kept[d]):
                dh = dh + dj[t, :, k * HIDDEN : (k + 1) * HIDDEN]
                live = dh * m
                dn = dc * m + live * o * (1 - tc**2)
                z = np.concatenate([dn * g * i * (1 - i), dn * c * f * (1 - f), live * tc * o * (1 - o), dn * i * (1 - g**2)], 1)
                gx += e[t].T @ z
                gh += h.T @ z
                gc += z.sum(0)
                de[t] += z @ p[f"{d}x"].T
                dh = np.where(m, z @ p[f"{d}h"].T, dh)
                dc = np.where(m, dn * f, dc)
            grad |= {f"{d}x": gx, f"{d}h": gh, f"{d}c": gc}
        rows = (de * (1 - e**2))[mask]
        grad |= {"E": x.T @ rows, "e": rows.sum(0)}
        return float(loss), grad

    def fit(self, pages: list[tuple[Page, list[bool]]], epochs: int = EPOCHS, seed: int = SEED, rate: float = 0.01, batch: int = 32) -> float:
        """Adam over shuffled batches; returns the last pass's mean loss."""
        r = np.random.default_rng(seed)
        x_all, sizes = features([b for b, _ in pages])
        first = np.cumsum(sizes) - sizes
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(w) for k, w in self.p.items()}
        step, loss = 0, 0.0
        for epoch in range(epochs):
            losses = []
            order = r.permutation(len(pages))
            for lo in range(0, len(order), batch):
                lot = [k for k in order[lo : lo + batch] if sizes[k]]
                steps = int(sizes[lot].max())
                number, y = np.full((steps, len(lot)), -1), np.zeros((steps, len(lot)), bool)
                for j, k in enumerate(lot):
                    number[: sizes[k], j], y[: sizes[k], j] = np.arange(first[k], first[k] + sizes[k]), pages[k][1]
                mask = number >= 0
                x = x_all[number[mask]]
                # now and then a page's names tell nothing, so that the rest has to
                blind = r.random(len(lot)) < BLIND
                x[np.broadcast_to(blind, mask.shape)[mask], :PATH_BUCKETS] = 0
                loss, grad = self.gradients(x, mask, y)
                losses.append(loss)
                step += 1
                for k, g in grad.items():
                    g = np.clip(g, -1, 1)
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.99 * v[k] + 0.01 * g * g
                    self.p[k] = (self.p[k] - rate * 0.8**epoch * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
            loss = float(np.mean(losses))
        return loss


# ------------------------------------------------------------------------------ training pages

_SYLLABLES = "th er on an re in ion ti en es or te ed he st ou ea le que la de ent aux ment eau ch ung keit sch ge ver lich os ado ción mente ra ca mi so lu".split()
_MENU = "home news sport about contact search login register archive world business science culture video photos shop help accueil inicio startseite kontakt impressum".split()
_NAV = ["nav", 'div class="nav"', 'div class="menu"', 'ul class="navbar"', 'div id="navigation"', 'div class="breadcrumbs"', 'div role="navigation"', 'div class="top-bar"']
_HEADER = ["header", 'div class="header"', 'div id="header"', 'div class="site-header"', 'div class="masthead"', 'div class="banner"', 'div role="banner"']
_FOOTER = ["footer", 'div class="footer"', 'div id="footer"', 'div class="site-footer"', 'div class="copyright"', 'div role="contentinfo"']
_SIDE = ["aside", 'div class="sidebar"', 'div id="sidebar"', 'section class="related"', 'div class="widget"', 'div class="recommended"', 'div class="popular-posts"', 'aside class="sidebar"', 'div class="tags"', 'div class="author-bio"']
_ADS = ['div class="ad"', 'div class="ads"', 'div class="advert"', 'div class="advertisement"', 'div class="sponsored"', 'div class="promo"', 'aside class="ad"', 'div id="ad-top"', 'ins class="adsbygoogle"']
_NOTICE = ['div class="cookie"', 'div class="cookie-banner"', 'div id="cookie-notice"', 'div class="notice"', 'div class="alert"', 'div class="gdpr consent"', 'div class="popup"', 'div role="alert"', 'div class="newsletter"', 'div class="subscribe"', 'div class="paywall"']
_COMMENTS = ['section class="comments"', 'div id="comments"', 'div class="comments"', 'ol class="comment-list"', 'div class="comment"', 'section id="responses"', 'div class="disqus"', 'div class="discussion"', 'ul class="replies"', 'aside class="comments"']
_SHARE = ['div class="share"', 'div class="social"', 'ul class="share-buttons"', 'div class="post-meta"', 'div class="byline"']
_MAIN = ["article", "article", "article", "main", 'div class="content"', 'div id="content"', 'div class="post"', 'div class="entry-content"', 'div class="article-body"', 'section class="story"', 'div class="main"', 'div id="main"', 'td class="content"', 'div class="text"', "div", "section", 'article class="post"', 'div itemprop="articleBody"', 'div role="main"']


def training_page(r: np.random.Generator) -> tuple[str, list[str]]:
    """A page and the texts of its main blocks."""
    lexicon = ["".join(_SYLLABLES[k] for k in r.integers(len(_SYLLABLES), size=r.integers(1, 5))) for _ in range(60)]
    pick = lambda options: options[r.integers(len(options))]

    def sentence(least: int, most: int) -> str:
        found = " ".join(lexicon[k] for k in r.integers(60, size=r.integers(least, most)))
        return found.upper() + "!" if r.random() < 0.03 else found.capitalize() + "."

    def passage(n: int) -> str:
        return " ".join(sentence(3, 18) for _ in range(n))

    def inside(element: str, body: str) -> str:
        return f"<{element}>{body}</{element.split()[0]}>"

    def links(n: int) -> str:
        return inside("ul", "".join(f'<li><a href="/{k}">{pick(_MENU) if r.random() < 0.5 else pick(lexicon)}</a></li>' for k in range(n)))

    def boilerplate(kind: list[str]) -> str:
        body = r.random()
        if kind is _NAV or body < 0.2:
            return inside(pick(kind), links(int(r.integers(2, 9))))
        if kind is _COMMENTS:
            return inside(pick(kind), "".join(f"<div class=\"{pick(['comment', 'reply', 'c'])}\"><b>{pick(lexicon)}</b><p>{passage(int(r.integers(1, 4)))}</p></div>" for _ in range(r.integers(1, 5))))
        if kind is _NOTICE and body < 0.6:
            return inside(pick(kind), f"<p>{sentence(4, 20)}</p><button>OK</button>")
        if body < 0.5:
            return inside(pick(kind), sentence(3, 20))
        return inside(pick(kind), f"{inside(pick(['h2', 'h3', 'h4']), sentence(1, 4))}<p>{passage(int(r.integers(1, 4)))}</p>" if body < 0.8 else f"<p>{sentence(3, 20)}</p>{links(int(r.integers(1, 5)))}")

    def form() -> str:
        return f'<form action="/x"><label>{pick(lexicon)}</label><input name="q"><p>{sentence(2, 9)}</p><button>{pick(lexicon)}</button></form>'

    main: list[str] = []
    body: list[str] = []

    def content(text: str, element: str) -> None:
        main.append(text)
        shown = text
        if r.random() < 0.15:
            cut = text.split(" ")
            k = int(r.integers(len(cut)))
            cut[k] = f"<a href='/x'>{cut[k]}</a>" if r.random() < 0.5 else f"<em>{cut[k]}</em>"
            shown = " ".join(cut)
        body.append(f"<p><b>{shown}<br>" if element == "p" and r.random() < 0.1 else inside(element, shown))

    if r.random() < 0.85:
        content(sentence(2, 12), "h1")
    for _ in range(int(r.integers(1, 14))):
        kind = r.random()
        if kind < 0.75:
            content(passage(int(r.integers(1, 7))), "p")
        elif kind < 0.83:
            content(sentence(1, 7), pick(["h2", "h3"]))
        elif kind < 0.88:
            body.append("<ul>")
            for _ in range(int(r.integers(2, 5))):
                content(sentence(2, 12), "li")
            body.append("</ul>")
        elif kind < 0.92:
            content(passage(int(r.integers(1, 3))), pick(["blockquote", "div", "pre"]))
        elif kind < 0.95:
            body.append(boilerplate(_ADS))
        elif kind < 0.97:
            body.append(boilerplate(pick([_SIDE, _SHARE, _NOTICE])))
        elif kind < 0.985:
            body.append(form())
    holder = pick(_MAIN)
    page = inside(holder, "".join(body))
    if holder.startswith("td"):
        page = f"<table><tr>{page}</tr></table>"
    wrap = r.random()
    if wrap < 0.25:
        page = inside(pick(["main", 'div class="wrapper"', 'div id="page"', 'div class="container"', "div"]), page + (boilerplate(pick([_SIDE, _COMMENTS])) if r.random() < 0.4 else ""))
    before = [boilerplate(k) for k, p in ((_HEADER, 0.4), (_NAV, 0.7), (_NOTICE, 0.25), (_ADS, 0.4)) if r.random() < p]
    after = [boilerplate(k) for k, p in ((_SHARE, 0.2), (_SIDE, 0.4), (_ADS, 0.2), (_COMMENTS, 0.4), (_NOTICE, 0.15), (_FOOTER, 0.75)) if r.random() < p]
    if r.random() < 0.2:
        after.insert(0, form())
    if r.random() < 0.15:
        before.append(boilerplate(_SIDE))
    return f"<!DOCTYPE html><html><head><title>{pick(lexicon)}</title><script>var a = '<p>';</script></head><body>{''.join(before)}{page}{''.join(after)}</body></html>", main


def labelled_pages(n: int = TRAIN_PAGES, seed: int = SEED) -> list[tuple[Page, list[bool]]]:
    """Training pages as blocks and labels; a block is main text if it is the next of the page's main texts."""
    r = np.random.default_rng(seed)
    out = []
    for _ in range(n):
        page, main = training_page(r)
        blocks, labels, at = blocks_of(page), [], 0
        for b in blocks.blocks:
            labels.append(at < len(main) and b.text == " ".join(main[at].split()))
            at += labels[-1]
        if at == len(main):
            out.append((blocks, labels))
    return out


@lru_cache(1)
def trained() -> Labeller:
    """The labeller, trained once a process; the same seed gives the same weights."""
    model = Labeller()
    model.fit(labelled_pages())
    return model


# ------------------------------------------------------------------------------ Spark


def extract(pages: DataFrame, model: Labeller | None = None, threshold: float = 0.5) -> DataFrame:
    """Per page: page_id, url, text (main blocks, a line each), n_chars and n_blocks (all blocks).

    Null and empty html give an empty text; broken markup is read as far as it goes; very long pages
    take time in proportion to their length and are labelled in parts that hand on the network's state;
    repeated pages have a row each; an empty table gives no rows; further columns are ignored.
    """
    held = pages.sparkSession.sparkContext.broadcast(model or trained())
    schema = f"page_id {pages.schema['page_id'].dataType.simpleString()}, url {pages.schema['url'].dataType.simpleString()}, text string, n_chars long, n_blocks int"

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            at = 0
            while at < len(batch):
                lot, size = [], 0
                while at + len(lot) < len(batch) and size < LOT:
                    page = batch.column(2)[at + len(lot)].as_py() or ""
                    size += len(page)
                    lot.append(blocks_of(page))
                sizes = np.array([len(p.blocks) for p in lot], np.int64)
                keep = held.value.probabilities(lot) >= threshold
                texts, k = [], 0
                for found in lot:
                    texts.append("\n".join(b.text for b, ok in zip(found.blocks, keep[k : k + len(found.blocks)].tolist(), strict=True) if ok))
                    k += len(found.blocks)
                yield pa.RecordBatch.from_arrays([batch.column(0)[at : at + len(lot)], batch.column(1)[at : at + len(lot)], pa.array(texts), pa.array([len(t) for t in texts], pa.int64()), pa.array(sizes.astype(np.int32))], ["page_id", "url", "text", "n_chars", "n_blocks"])
                at += len(lot)

    return pages.select(F.col("page_id"), F.col("url"), F.col("html")).mapInArrow(run, schema)
