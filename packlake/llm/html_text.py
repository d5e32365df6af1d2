"""HTML extraction by a recurrent block labeller.

A page becomes its leaf blocks in order: runs of text between block-level tags,
character references decoded, white space made single spaces. Each block is
described by its tag path (element names, class and id words, hashed), its
words (hashed) and a few counts; a bidirectional LSTM in numpy reads the page's
sequence and labels every block as main text or not, with the whole page as
context. The blocks labelled main are joined by a blank line.

The network is trained on the driver, from pages that ``training_page`` makes
from a seed: ``PAGES`` of them, each with known labels, whose layouts vary in
element names, class names and order. It is the same on every run.

Null and empty html give an empty text, an empty table no rows. Script, style and
other raw elements and comments never give blocks, and so what belongs in a head
doesn't; anything else ends the head, closed or not. Nothing is cut short: pages
and blocks of any length are read whole, in time that follows their length; a raw
element that is never closed, other than script and style, loses its start tag
only, and a quote that never closes ends with its tag. Formulas and fallback text
are inline. Repeated rows give equal texts. Only the named columns are read.
"""

from __future__ import annotations

import functools
import html as entities
import random
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

# Element names of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br input object".split())
INLINE |= frozenset("math maction merror mfrac mi mmultiscripts mn mo mover mpadded mphantom mprescripts mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtext mtr munder munderover semantics".split())
SPACED = frozenset("br mtd annotation annotation-xml".split())
RAW = frozenset("script style noscript template textarea title iframe svg select option".split())
ENDS = {name: re.compile(rf"</{name}(?=[\s/>])", re.IGNORECASE) for name in RAW} | {
    "select": re.compile(r"</select(?=[\s/>])|(?=<select[\s/>])", re.IGNORECASE),
    "option": re.compile(r"</option(?=[\s/>])|(?=</?(?:option|optgroup|datalist|select)[\s/>])", re.IGNORECASE),
}
CLOSES = {"p": {"p"}, "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}}
PARAGRAPH = {"p"}
FENCE = frozenset("ul ol dl table article section div aside nav header footer main form blockquote body td th object".split())

TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)")
#: What may end a tag or open a quoted value: a quote does only after an equals sign.
MARKS = re.compile(r">|=[\s]*+([\"'])")
COMMENT_END = re.compile(r"--!?>")
NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
WORDS = re.compile(r"[a-z]+")

PATHS, BAG, COUNTS, HIDDEN = 512, 256, 8, 16
INPUT = PATHS + BAG + COUNTS
PAGES, ROUNDS, SEED = 240, 14, 11


class Path:
    """The elements above a block, from the root on. ``mask`` has a bit for each
    hashed feature of them, ``place`` is that of the element which holds the text."""

    __slots__ = ("mask", "node", "parent", "place")

    def __init__(self, parent: Path | None, node: str):
        self.parent, self.node = parent, node
        words = node.split()
        self.mask = parent.mask if parent else 0
        for w in words:
            self.mask |= 1 << hashed(f"in:{w}")
        if words and words[0] not in INLINE:
            self.place = hashed(f"at:{words[0]}")
        else:
            self.place = parent.place if parent else hashed("at:")

    def __iter__(self) -> Iterator[str]:
        out, at = [], self
        while at.parent is not None:
            out.append(at.node)
            at = at.parent
        return reversed(out)

    @classmethod
    def of(cls, nodes: tuple[str, ...]) -> Path:
        out = ROOT
        for node in nodes:
            out = cls(out, node)
        return out

    @property
    def features(self) -> int:
        return self.mask | 1 << self.place


@functools.lru_cache(maxsize=50_000)
def hashed(feature: str) -> int:
    return zlib.crc32(feature.encode()) % PATHS


ROOT = Path(None, "")


@dataclass(slots=True)
class Block:
    path: Path
    text: str
    linked: int


class Tags:
    """Finds where tags end, in time that follows the page's length."""

    def __init__(self, page: str):
        self.page, self.last = page, page.rfind(">")
        self.quotes = {q: page.rfind(q) for q in "\"'"}
        self.lost: set[int] = set()  # places of quotes from which no end is found

    def end(self, at: int) -> int:
        """The place of the ``>`` that ends the tag whose name ends at ``at``, or -1.
        Where quotes hide all of them the first one counts."""
        if at > self.last:
            return -1
        seen, place = [], at
        while m := MARKS.search(self.page, place):
            if m[1] is None:
                return m.start()
            if m.end() in self.lost or self.quotes[m[1]] < m.end():
                break
            seen.append(m.end())
            place = self.page.find(m[1], m.end()) + 1
        self.lost.update(seen)
        return self.page.find(">", at)


class Stack:
    """Open elements; where the last of each name, the last block and the last link
    stand is known at once, so that no step searches the stack."""

    def __init__(self) -> None:
        self.names: list[str] = []
        self.paths: list[Path] = [ROOT]
        self.places: dict[str, list[int]] = {}
        self.blocks: list[int] = []
        self.fences: list[int] = []

    def push(self, name: str, node: str) -> None:
        self.places.setdefault(name, []).append(len(self.names))
        if name not in INLINE:
            self.blocks.append(len(self.names))
        if name in FENCE:
            self.fences.append(len(self.names))
        self.names.append(name)
        self.paths.append(Path(self.paths[-1], node))

    def last(self, name: str) -> int:
        found = self.places.get(name)
        return found[-1] if found else -1

    def cut(self, at: int) -> None:
        """Close all from ``at`` on."""
        while len(self.names) > at:
            name = self.names.pop()
            self.paths.pop()
            self.places[name].pop()
            if name not in INLINE:
                self.blocks.pop()
            if name in FENCE:
                self.fences.pop()

    def close(self, name: str) -> None:
        """An end tag; one of an inline element doesn't reach over a block."""
        at = self.last(name)
        if at >= 0 and (name not in INLINE or not self.blocks or self.blocks[-1] < at):
            self.cut(at)

    def make_way(self, name: str) -> None:
        """End what a block's start tag ends without an end tag."""
        closes = CLOSES.get(name, PARAGRAPH)
        at = max(map(self.last, closes))
        if at < 0:
            return
        if closes.isdisjoint(FENCE):
            fence = self.fences[-1] if self.fences else -1
        else:
            fence = max(self.last(x) for x in FENCE if x not in closes)
        if at > fence:
            self.cut(at)

    @property
    def linked(self) -> bool:
        return bool(self.places.get("a"))


def blocks_of(page: str) -> list[Block]:
    """The leaf blocks of a page in order."""
    out: list[Block] = []
    tags, stack = Tags(page), Stack()
    parts: list[str] = []
    path: Path | None = None
    linked, at, n = 0, 0, len(page)
    endless: set[str] = set()

    def flush() -> None:
        nonlocal path, linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                out.append(Block(path or ROOT, text, min(linked, len(text))))
            parts.clear()
        path, linked = None, 0

    def say(text: str) -> None:
        nonlocal path, linked
        text = entities.unescape(text) if "&" in text else text
        if path is None and not text.isspace():
            path = stack.paths[-1]
        parts.append(text)
        if stack.linked:
            linked += len(text.strip())

    while at < n:
        if page[at] != "<":
            stop = page.find("<", at)
            stop = n if stop < 0 else stop
            say(page[at:stop])
            at = stop
            continue
        if at > tags.last:  # no tag ends any more, so all but a comment is text
            stop = page.find("<!--", at)
            say(page[at : n if stop < 0 else stop])
            break
        m = TAG.match(page, at)
        if m is None:
            if page.startswith("<!--", at):
                end = at + 5 if page.startswith(">", at + 4) else at + 6 if page.startswith("->", at + 4) else None
                if end is None:
                    close = COMMENT_END.search(page, at + 4)
                    end = close.end() if close else n
                at = end
            elif page[at + 1 : at + 2] in ("!", "?") and at < tags.last:
                at = page.find(">", at) + 1
            else:
                say("<")
                at += 1
            continue
        end = tags.end(m.end())
        if end < 0:
            say("<")
            at += 1
            continue
        name, ending, attributes, at = m[2].lower(), bool(m[1]), page[m.end() : end], end + 1
        alone = attributes.endswith("/")
        if name == "head":
            continue
        if name in RAW:
            if not ending and not alone and name not in endless:
                close = ENDS[name].search(page, at)
                if close:
                    at = close.end()
                    if close[0]:
                        at = page.find(">", at) + 1 or n
                elif name in ("script", "style"):
                    at = n
                else:
                    endless.add(name)
            if name in ("select", "option"):
                flush()
            continue
        if name in SPACED:
            parts.append(" ")
            continue
        inline = name in INLINE
        if not inline:
            flush()
        if ending:
            stack.close(name)
            continue
        if name in VOID:
            continue
        if not inline:
            stack.make_way(name)
        if not alone:
            words = [w for a, b, c in NAMES.findall(attributes) for w in WORDS.findall((a or b or c).lower())] if attributes else ()
            stack.push(name, " ".join([name, *words]))
    flush()
    return out


@functools.lru_cache(maxsize=50_000)
def places_of(features: int) -> np.ndarray:
    """Where the bits of a path's features are set."""
    return np.flatnonzero(np.unpackbits(np.frombuffer(features.to_bytes(PATHS // 8, "little"), np.uint8), bitorder="little"))


def bag_of(words: list[str]) -> np.ndarray:
    some = np.bincount([zlib.crc32(w.encode()) % BAG for w in words], minlength=BAG)
    return some * (0.3 / np.sqrt(np.dot(some, some)))


def counts_of(blocks: list[Block], first: int = 0, whole: int | None = None) -> np.ndarray:
    """Lengths, links, ending and place of each block; they are those from
    ``first`` on of a page of ``whole``."""
    n = len(blocks) if whole is None else whole
    return np.array([
        (np.log1p(len(b.text)) / 6, min(1.0, b.text.count(" ") / 60), b.linked / len(b.text), b.text[-1] in ".,;:!?", i / n, 1.0 - i / n, i == 0, 1.0)
        for i, b in enumerate(blocks, first)
    ], np.float32)


def describe(blocks: list[Block]) -> np.ndarray:
    """One row of features for each block."""
    x = np.zeros((len(blocks), INPUT), np.float32)
    for row, b in zip(x, blocks, strict=True):
        row[places_of(b.path.features)] = 1
        row[PATHS : PATHS + BAG] = bag_of(b.text.split(" "))
    x[:, PATHS + BAG :] = counts_of(blocks)
    return x


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def lstm(given: np.ndarray, wh: np.ndarray, mask: np.ndarray, keep: list | None = None, h: np.ndarray | None = None, c: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """States of one direction, and the last h and c. given: batch, steps, gates,
    from the inputs; padded steps keep the state."""
    batch, steps, _ = given.shape
    h = np.zeros((batch, HIDDEN), np.float32) if h is None else h
    c = np.zeros((batch, HIDDEN), np.float32) if c is None else c
    out = np.empty((batch, steps, HIDDEN), np.float32)
    for t in range(steps):
        g = given[:, t] + h @ wh
        i, f, o, u = sigmoid(g[:, :HIDDEN]), sigmoid(g[:, HIDDEN : 2 * HIDDEN] + 1), sigmoid(g[:, 2 * HIDDEN : 3 * HIDDEN]), np.tanh(g[:, 3 * HIDDEN :])
        cell = f * c + i * u
        bent = np.tanh(cell)
        m = mask[:, t, None]
        if keep is not None:
            keep.append((h, c, i, f, o, u, bent, m))
        h, c = m * o * bent + (1 - m) * h, m * cell + (1 - m) * c
        out[:, t] = h
    return out, h, c


def lstm_back(x: np.ndarray, wx: np.ndarray, wh: np.ndarray, kept: list, dout: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Gradients of wx, wh and b."""
    batch, steps, _ = x.shape
    dg = np.zeros((batch, steps, 4 * HIDDEN), np.float32)
    dwh, dh, dc = np.zeros_like(wh), np.zeros((batch, HIDDEN), np.float32), np.zeros((batch, HIDDEN), np.float32)
    for t in range(steps - 1, -1, -1):
        h, c, i, f, o, u, bent, m = kept[t]
        dh = dh + dout[:, t]
        dcell = m * (dc + dh * o * (1 - bent * bent))
        g = np.concatenate([dcell * u * i * (1 - i), dcell * c * f * (1 - f), m * dh * bent * o * (1 - o), dcell * i * (1 - u * u)], axis=1)
        dg[:, t] = g
        dwh += h.T @ g
        dh, dc = (1 - m) * dh + g @ wh.T, dcell * f + (1 - m) * dc
    flat = dg.reshape(-1, 4 * HIDDEN)
    return x.reshape(-1, x.shape[2]).T @ flat, dwh, flat.sum(axis=0)


def reverse(x: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Each row's own steps in reverse, its padding left at the end."""
    steps = np.arange(x.shape[1])
    at = np.where(steps < lengths[:, None], lengths[:, None] - 1 - steps, steps)
    return np.take_along_axis(x, at[:, :, None], axis=1)


class Labeller:
    """The network; ``weights`` are wx, wh, b forwards and backwards, then the output's."""

    def __init__(self, weights: list[np.ndarray]):
        self.weights = weights

    @classmethod
    def fresh(cls, seed: int) -> Labeller:
        rng = np.random.default_rng(seed)
        deal = lambda *shape: (rng.standard_normal(shape) * 0.15).astype(np.float32)
        one = lambda: [deal(INPUT, 4 * HIDDEN), deal(HIDDEN, 4 * HIDDEN), np.zeros(4 * HIDDEN, np.float32)]
        return cls([*one(), *one(), deal(2 * HIDDEN), np.zeros(1, np.float32)])

    def scores(self, ahead: np.ndarray, back: np.ndarray, lengths: np.ndarray, keep: tuple[list, list] | None = None) -> np.ndarray:
        """Log-odds of main text from the gates' inputs of both directions."""
        w = self.weights
        mask = (np.arange(ahead.shape[1]) < lengths[:, None]).astype(np.float32)
        states = lstm(ahead, w[1], mask, keep[0] if keep else None)[0]
        others = reverse(lstm(reverse(back, lengths), w[4], mask, keep[1] if keep else None)[0], lengths)
        self.states = np.concatenate([states, others], axis=2)
        return self.states @ w[6] + w[7]

    def gates(self, blocks: list[Block], first: int = 0, whole: int | None = None) -> np.ndarray:
        """``describe(blocks)`` times the input weights of both directions,
        with the share of each tag path worked out once."""
        if not hasattr(self, "both"):
            w = self.weights
            self.both, self.bias, self.known = np.concatenate([w[0], w[3]], axis=1), np.concatenate([w[2], w[5]]), {}
        if len(self.known) > 50_000:
            self.known.clear()
        out = np.empty((len(blocks), 8 * HIDDEN), np.float32)
        bags = np.empty((len(blocks), BAG), np.float32)
        for i, b in enumerate(blocks):
            features = b.path.features
            if features not in self.known:
                self.known[features] = self.both[places_of(features)].sum(axis=0) + self.bias
            out[i] = self.known[features]
            bags[i] = bag_of(b.text.split(" "))
        return out + bags @ self.both[PATHS : PATHS + BAG] + counts_of(blocks, first, whole) @ self.both[PATHS + BAG :]

    def gradients(self, x: np.ndarray, lengths: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        kept: tuple[list, list] = ([], [])
        mask = np.arange(x.shape[1]) < lengths[:, None]
        w = self.weights
        error = (sigmoid(self.scores(x @ w[0] + w[2], x @ w[3] + w[5], lengths, kept)) - y) * mask / mask.sum()
        states = self.states
        dstates = error[:, :, None] * w[6]
        ahead = lstm_back(x, w[0], w[1], kept[0], dstates[:, :, :HIDDEN])
        back = lstm_back(reverse(x, lengths), w[3], w[4], kept[1], reverse(dstates[:, :, HIDDEN:], lengths))
        return [*ahead, *back, np.einsum("bt,bth->h", error, states), np.array([error.sum()])]

    def label(self, pages: list[list[Block]], cells: int = 40_000) -> list[np.ndarray]:
        """Whether each block of each page is main text. Pages of like length
        are read together; a batch holds at most ``cells`` blocks, and a page of
        more is read in parts, both ways, with the states carried on."""
        out: list[np.ndarray] = [np.zeros(0, bool)] * len(pages)
        order = sorted((i for i in range(len(pages)) if pages[i]), key=lambda i: len(pages[i]))
        while order:
            if len(pages[order[-1]]) > cells:
                out[order[-1]] = self.label_long(pages[order[-1]], cells)
                order.pop()
                continue
            size = max(1, min(256, cells // len(pages[order[-1]])))
            some, order = order[-size:], order[:-size]
            gates, lengths = padded([self.gates(pages[i]) for i in some])
            scores = self.scores(gates[:, :, : 4 * HIDDEN], gates[:, :, 4 * HIDDEN :], lengths)
            for i, s, n in zip(some, scores, lengths, strict=True):
                out[i] = s[:n] > 0
        return out


    def label_long(self, blocks: list[Block], cells: int) -> np.ndarray:
        w, n = self.weights, len(blocks)
        scores = np.full(n, w[7][0], np.float32)
        for back in (False, True):
            h, c = (np.zeros((1, HIDDEN), np.float32) for _ in range(2))
            for at in range(0, n, cells):
                places = np.arange(at, min(n, at + cells))
                places = n - 1 - places if back else places
                low, high = int(places.min()), int(places.max()) + 1
                given = self.gates(blocks[low:high], low, n)[:, 4 * HIDDEN :] if back else self.gates(blocks[low:high], low, n)[:, : 4 * HIDDEN]
                states, h, c = lstm(given[::-1][None] if back else given[None], w[4] if back else w[1], np.ones((1, len(places)), np.float32), None, h, c)
                scores[places] += states[0] @ (w[6][HIDDEN:] if back else w[6][:HIDDEN])
        return scores > 0


def padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.array([len(p) for p in pages])
    x = np.zeros((len(pages), int(lengths.max()), pages[0].shape[1]), np.float32)
    for row, p in zip(x, pages, strict=True):
        row[: len(p)] = p
    return x, lengths


def training_page(rng: random.Random) -> list[tuple[tuple[str, ...], str, bool, bool]]:
    """Blocks of an invented page as (path, text, linked, main)."""
    syllables = "an ber cor del en fi gra hol in ja ka lo mer no or pe qui ra se ti un ver wo xa yo zu".split()
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))
    line = lambda a, b: " ".join(word() for _ in range(rng.randint(a, b)))
    sentence = lambda a, b: line(a, b).capitalize() + rng.choice(["."] * 6 + ["", "!", "?"])
    shell = rng.choice([("html", "body"), ("html", "body", "div wrapper"), ("html", "body", "div page"), ()])
    out = []

    def part(path: tuple[str, ...], text: str, linked: bool = False, main: bool = False) -> None:
        out.append((shell + path, text, linked, main))

    def menu() -> None:
        box = rng.choice([("nav", "ul", "li", "a"), ("nav", "a"), ("div menu", "ul", "li", "a"), ("ul nav", "li", "a"), ("header", "nav", "ul", "li", "a"), ("div navigation", "a"), ("div breadcrumb", "a")])
        for _ in range(rng.randint(2, 9)):
            part(box, line(1, 3), True)

    def head() -> None:
        box = rng.choice([("header",), ("div header",), ("header site header",), ("div banner",), ("div masthead",), ("div top bar",)])
        for leaf in rng.choice([("h1",), ("p",), ("h1", "p"), ("a",), ("span",)]):
            part((*box, leaf), line(1, 8), leaf == "a")

    def advert() -> None:
        box = rng.choice([("div ad",), ("div ads",), ("div advert",), ("div advertisement", "p"), ("aside ad",), ("div sponsored", "a"), ("div promo", "p"), ("div ad slot",), ("section promo", "p")])
        part(box, sentence(3, 25), rng.random() < 0.2)

    def notice() -> None:
        box = rng.choice([("div cookie notice", "p"), ("div notice",), ("div cookie banner", "span"), ("div alert", "p"), ("section consent", "p"), ("div gdpr",), ("div newsletter", "p"), ("div subscribe", "p")])
        for _ in range(rng.randint(1, 2)):
            part(box, sentence(4, 25))

    def side() -> None:
        box = rng.choice([("aside",), ("aside sidebar",), ("div sidebar",), ("div related",), ("div widget",), ("section related",), ("div share",), ("div side column",)])
        for _ in range(rng.randint(1, 5)):
            leaf = rng.choice([("h3",), ("p",), ("ul", "li", "a"), ("ul", "li")])
            part((*box, *leaf), sentence(2, 18), leaf[-1] == "a")

    def form() -> None:
        box = rng.choice([("form",), ("form search",), ("div login", "form"), ("form comment form", "p")])
        for _ in range(rng.randint(1, 3)):
            part((*box, rng.choice(["label", "button", "p", "div"])), line(1, 6))

    def foot() -> None:
        box = rng.choice([("footer",), ("div footer",), ("footer site footer", "p"), ("div copyright",), ("footer", "ul", "li", "a"), ("footer", "small"), ("div bottom", "p")])
        for _ in range(rng.randint(1, 4)):
            part(box, rng.choice(["© ", ""]) + line(2, 14), box[-1] == "a")

    def comments(inside: tuple[str, ...]) -> None:
        box = rng.choice([("section comments", "div comment"), ("div comments", "ul", "li comment"), ("div comment list", "div comment"), ("ol comments", "li"), ("div reader comments",), ("section responses", "article comment"), ("div disqus thread",)])
        for _ in range(rng.randint(1, 6)):
            part((*inside, *box, rng.choice(["p", "div", "p", "span"])), sentence(3, 30))

    def article() -> None:
        box = rng.choice([("article",)] * 6 + [("main",), ("main", "article"), ("div content",), ("div post",), ("div article body",), ("div entry content",), ("section story",), ("div main", "div text"), ("main content", "div"), ("article post",), ("div",), ()])
        if rng.random() < 0.7:
            part((*box, "h1"), line(2, 12).capitalize(), False, True)
        lines = rng.randint(1, 22)
        for _ in range(lines):
            kind = rng.random()
            leaf, text = ("p",), sentence(1, 90) + (" " + sentence(3, 40) if rng.random() < 0.5 else "")
            if kind < 0.12:
                leaf = ("p", "b")
            elif kind < 0.18:
                leaf, text = (rng.choice(["h2", "h3"]),), line(1, 9).capitalize()
            elif kind < 0.24:
                leaf, text = rng.choice([("ul", "li"), ("ol", "li")]), sentence(2, 20)
            elif kind < 0.29:
                leaf = rng.choice([("blockquote", "p"), ("pre",), ("blockquote",), ("table", "tr", "td"), ("figure", "figcaption"), ("div",)])
            if kind < 0.34 and kind >= 0.29:
                text = sentence(1, 3)
            part((*box, *leaf), text, False, True)
            if lines > 4 and rng.random() < 0.04:
                out.append((shell + (*box, rng.choice(["div ad", "aside", "div related", "div promo"]), "p"), sentence(3, 20), False, False))
        if rng.random() < 0.2:
            comments(box)

    if rng.random() < 0.04:
        for _ in range(rng.randint(1, 4)):
            out.append(((), sentence(5, 60), False, True))
        return out
    before = [menu, head, advert, notice, form, side]
    for f in rng.sample(before, rng.randint(1, 4)):
        f()
    article()
    for f in rng.sample([side, advert, form, lambda: comments(()), notice, menu], rng.randint(0, 3)):
        f()
    if rng.random() < 0.9:
        foot()
    return out


def training_set(pages: int = PAGES, seed: int = SEED) -> tuple[list[list[Block]], list[np.ndarray]]:
    rng = random.Random(seed)
    made = [training_page(rng) for _ in range(pages)]
    return [[Block(Path.of(p), t, len(t) if linked else 0) for p, t, linked, _ in page] for page in made], [np.array([m for *_, m in page], np.float32) for page in made]


@functools.cache
def train(pages: int = PAGES, rounds: int = ROUNDS, seed: int = SEED, rate: float = 0.01) -> Labeller:
    """The labeller, by Adam on the invented pages."""
    blocks, labels = training_set(pages, seed)
    order = sorted(range(pages), key=lambda i: len(blocks[i]))
    batches = []
    for at in range(0, pages, 16):
        some = order[at : at + 16]
        x, lengths = padded([describe(blocks[i]) for i in some])
        y = np.zeros(x.shape[:2], np.float32)
        for row, i in zip(y, some, strict=True):
            row[: len(labels[i])] = labels[i]
        batches.append((x, lengths, y))
    net, rng, step = Labeller.fresh(seed), np.random.default_rng(seed), 0
    first, second = [np.zeros_like(w) for w in net.weights], [np.zeros_like(w) for w in net.weights]
    for r in range(rounds):
        for k in rng.permutation(len(batches)):
            step += 1
            for i, g in enumerate(net.gradients(*batches[k])):
                first[i] = 0.9 * first[i] + 0.1 * g
                second[i] = 0.99 * second[i] + 0.01 * g * g
                move = first[i] / (1 - 0.9**step) / (np.sqrt(second[i] / (1 - 0.99**step)) + 1e-8)
                net.weights[i] = (net.weights[i] - rate * (0.5 if r > rounds * 0.6 else 1.0) * move - 1e-5 * net.weights[i]).astype(np.float32)
    return net


def text_of(blocks: list[Block], main: np.ndarray) -> str:
    return "\n\n".join(b.text for b, m in zip(blocks, main, strict=True) if m)


def extract(pages: DataFrame, net: Labeller | None = None, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url, text, n_chars."""
    weights = (net or train()).weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = Labeller(weights)
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                blocks = [blocks_of(v.as_py() or "") for v in batch.column(2)]
                texts = [text_of(b, m) for b, m in zip(blocks, labeller.label(blocks), strict=True)]
                columns = [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["page_id", "url", "text", "n_chars"])

    kind = pages.schema[page_id].dataType.simpleString()
    return pages.select(page_id, url, html).mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")
