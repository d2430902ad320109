"""Main text of web pages: a recurrent labeller over each page's sequence of text blocks.

A page is cut into leaf blocks; a bidirectional LSTM in numpy reads, for each, the hashed
tags, classes and ids on its path, its hashed words and a few measures, and labels it as
main text or not with the whole page as context. ``train_blocks`` made the weights.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from pathlib import Path
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tessella.llm.common import ascii_fold, letters_digits, pick, word_bounds, word_hashes

#: Buckets and sizes of the vectors for path tokens and for words; measures of a leaf; units of a direction.
PATHS, PATH_SIZE, WORDS, WORD_SIZE, MEASURES, HIDDEN = 1024, 16, 1024, 6, 7, 16
INPUT = PATH_SIZE + WORD_SIZE + MEASURES
MODEL = "blocks_model.npz"
#: Pages labelled together; their leaves are padded to the longest of a group of like length.
PAGES = 256
#: Steps of the recurrence whose inputs are multiplied at once.
STEPS_AHEAD = 8192

_NAME = re.compile(r"[A-Za-z][^\s/>]*")
_PLAIN = re.compile(r"[^>\"']*")
_ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role|hidden|style)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?(?=\s|/|\Z)", re.S | re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
FOLD = ascii_fold(letters_digits())

#: Elements whose content is no text of the page, or never shown.
SILENT = frozenset("script style noscript template title iframe svg math object canvas audio video head".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements inside a block's text; all others begin and end blocks.
INLINE = frozenset("a abbr b bdi bdo big br cite code data del dfn em font i img ins kbd mark q s samp small span strike strong sub sup time tt u var wbr".split())
#: What an opening tag ends if it is open: the same kind, up to a container.
_ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_HOLDS = frozenset("ul ol dl table tbody thead select div section article main aside nav body form".split())


#: Longer attributes are not remembered from one tag to the next.
_SHORT = 400


@dataclass
class Leaf:
    text: str
    #: How many path changes of the page came before it, and the token of the innermost element (-1: none).
    at: int
    last: int
    linked: int
    depth: int


@dataclass
class Page:
    """A page's leaves, and its path tokens as changes: which token comes (1) or goes (-1).

    A leaf's path is the sum of the changes before it, so neither time nor memory grows with depth.
    """

    leaves: list[Leaf] = field(default_factory=list)
    tokens: list[int] = field(default_factory=list)
    signs: list[int] = field(default_factory=list)

    def __len__(self) -> int:
        return len(self.leaves)

    def __iter__(self) -> Iterator[Leaf]:
        return iter(self.leaves)


@lru_cache(maxsize=1 << 16)
def _path_token(token: str) -> int:
    return crc32(token.encode()) % PATHS


def _read(tag: str, attributes: str) -> tuple[int, ...]:
    found = [f"<{tag}>"]
    for name, value in _ATTRIBUTE.findall(attributes):
        name = name.lower()
        if name == "hidden" or name == "style" and "none" in value:
            found.append("hidden")
        elif name != "style":
            found += [x.lower() for x in _PART.findall(value)]
    return tuple(dict.fromkeys(_path_token(x) if len(x) < _SHORT else crc32(x.encode()) % PATHS for x in found))


_remembered = lru_cache(maxsize=1 << 14)(_read)


def _tokens(tag: str, attributes: str) -> tuple[int, ...]:
    return _remembered(tag, attributes) if len(tag) + len(attributes) < _SHORT else _read(tag, attributes)


class Tags:
    """The tags of a page, each found in time that its own length bounds."""

    def __init__(self, page: str) -> None:
        self.page = page
        self.last = {c: page.rfind(c) for c in "\"'>"}
        #: Set once quotes were seen to hide all ends of tags to the page's end; then a tag ends at the next ``>``.
        self.plain = False

    def next(self, at: int) -> tuple[int, int, bool, str, str] | None:
        """(start, past its end, closing, name, attributes) of the next tag or comment (no name) from here on."""
        page = self.page
        while (start := page.find("<", at)) >= 0:
            follows = page[start + 1 : start + 2]
            if follows in ("!", "?"):
                stop = page.find("-->", start + 4) if page.startswith("<!--", start) else page.find(">", start)
                return start, len(page) if stop < 0 else stop + (3 if page.startswith("<!--", start) else 1), False, "", ""
            if start > self.last[">"]:  # no tag ends after this; a comment may yet begin
                if (at := page.find("<!", start)) < 0:
                    return None
                continue
            closing = follows == "/"
            name = _NAME.match(page, start + 1 + closing)
            if name is not None and name.end() <= self.last[">"]:
                stop = self._end(name.end())
                return start, stop + 1, closing, name[0].lower(), page[name.end() : stop]
            at = start + 1
        return None

    def _end(self, at: int) -> int:
        """Where the tag whose name ends here has its ``>``, which is not one between quotes; there is a ``>``."""
        first = self.page.find(">", at)
        while not self.plain:
            at = _PLAIN.match(self.page, at).end()
            if at == len(self.page):
                self.plain = True
            elif self.page[at] == ">":
                return at
            elif at >= self.last[self.page[at]]:  # a quote that nothing closes
                return first
            else:
                at = self.page.find(self.page[at], at + 1) + 1
        return first


class _Stack:
    """The open elements, with what is asked of them kept beside them."""

    def __init__(self, out: Page) -> None:
        self.out = out
        self.tags: list[str] = []
        self.own: list[tuple[int, ...]] = []
        self.where: dict[str, list[int]] = {}
        self.holders: list[int] = []
        self.open: dict[int, int] = {}  # path tokens: how many open elements have each

    def push(self, tag: str, tokens: tuple[int, ...]) -> None:
        self.where.setdefault(tag, []).append(len(self.tags))
        if tag in _HOLDS:
            self.holders.append(len(self.tags))
        self.tags.append(tag)
        self.own.append(tokens)
        for t in tokens:
            n = self.open[t] = self.open.get(t, 0) + 1
            if n == 1:
                self.out.tokens.append(t)
                self.out.signs.append(1)

    def cut(self, to: int) -> None:
        while len(self.tags) > to:
            tag = self.tags.pop()
            self.where[tag].pop()
            if tag in _HOLDS:
                self.holders.pop()
            for t in self.own.pop():
                self.open[t] -= 1
                if self.open[t] == 0:
                    self.out.tokens.append(t)
                    self.out.signs.append(-1)

    def innermost(self, *tags: str) -> int:
        return max((self.where[t][-1] for t in tags if self.where.get(t)), default=-1)


def leaves(page: str) -> Page:
    """The page's blocks of text in order; markup that is broken is read as browsers roughly do."""
    out = Page()
    stack = _Stack(out)
    tags = Tags(page)
    text: list[str] = []
    linked = 0
    in_link = False

    def flush() -> None:
        nonlocal linked
        if text:
            body = " ".join(html.unescape("".join(text)).split())
            if body:
                last = _path_token("last " + stack.tags[-1][:_SHORT]) if stack.tags else -1
                out.leaves.append(Leaf(body, len(out.tokens), last, linked, len(stack.tags)))
            text.clear()
        linked = 0

    at, end = 0, len(page)
    while at < end:
        found = tags.next(at)
        stop = found[0] if found else end
        if stop > at:
            text.append(page[at:stop])
            if in_link:
                linked += stop - at
        if found is None:
            break
        _, at, closing, tag, attributes = found
        if not tag:
            continue  # a comment or declaration
        if tag in SILENT and not closing:
            flush()
            if not attributes.endswith("/"):
                if tag == "head":
                    ended = re.compile(r"</head\s*>|<body\b", re.I).search(page, at)
                    at = end if ended is None else ended.end() if ended[0][1] == "/" else ended.start()
                else:
                    ended = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
                    at = ended.end() if ended else end
            continue
        if tag == "a":
            in_link = not closing
        if tag in INLINE:
            if tag == "br":
                text.append(" ")
            continue
        flush()
        if closing:
            if (k := stack.innermost(tag)) >= 0:
                stack.cut(k)
            continue
        if tag in VOID:
            continue
        if stack.tags and stack.tags[-1] == "p":
            stack.cut(len(stack.tags) - 1)
        if tag in _ENDS and (k := stack.innermost(*_ENDS[tag])) > (stack.holders[-1] if stack.holders else -1):
            stack.cut(k)
        stack.push(tag, _tokens(tag, attributes))
    flush()
    return out


def words_of(own: list[Leaf]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(buckets of all leaves' words, which leaf each is of, how many each leaf has)."""
    raw = [x.text.encode() for x in own]
    offsets = np.cumsum([0, *map(len, raw)])
    folded = FOLD[np.frombuffer(b"".join(raw), np.uint8)]
    starts, ends = word_bounds(folded != 0, offsets)
    leaf = np.searchsorted(offsets, starts, "right") - 1
    buckets = (word_hashes(folded, starts, ends) >> np.uint64(20)).astype(np.int64) % WORDS
    return buckets, leaf, np.bincount(leaf, minlength=len(own))


def measures(own: list[Leaf], n_words: np.ndarray) -> np.ndarray:
    """Each leaf's length, words, share of links, stops, commas, whether it ends a sentence, depth."""
    chars = np.array([len(x.text) for x in own], np.float32)
    n = np.maximum(1, n_words)
    stops = np.array([x.text.count(".") + x.text.count("!") + x.text.count("?") for x in own])
    columns = [
        np.log1p(chars) / 8,
        np.log1p(n_words) / 6,
        np.minimum(1, np.array([x.linked for x in own]) / np.maximum(1, chars)),
        np.minimum(1, 4 * stops / n),
        np.minimum(1, 4 * np.array([x.text.count(",") for x in own]) / n),
        np.array([x.text[-1] in ".!?:;\"'" for x in own]),
        np.array([x.depth for x in own]) / 12,
    ]
    return np.stack(columns, 1).astype(np.float32)


Weights = dict[str, np.ndarray]


def load() -> Weights:
    with np.load(Path(__file__).with_name(MODEL)) as f:
        return {k: f[k].astype(np.float32) for k in f.files}


def _summed(rows: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The sum of each run of so many rows; zero for an empty one."""
    out = np.zeros((len(counts), rows.shape[1]), np.float32)
    full = np.flatnonzero(counts)
    if len(full):
        out[full] = np.add.reduceat(rows, (np.cumsum(counts) - counts)[full])
    return out


def path_sums(w: Weights, pages: list[Page]) -> np.ndarray:
    """Each leaf's sum of the vectors of its path's tokens, and of its innermost element's once more."""
    out = []
    for page in pages:
        changes = w["path"][np.array(page.tokens, np.int64)].astype(np.float64) * np.array(page.signs, np.float64)[:, None]
        so_far = np.concatenate([np.zeros((1, PATH_SIZE)), np.cumsum(changes, 0)])
        last = np.array([x.last for x in page], np.int64)
        out.append(so_far[np.array([x.at for x in page], np.int64)] + np.where(last[:, None] >= 0, w["path"][last], 0))
    return np.concatenate(out).astype(w["path"].dtype)


def inputs(w: Weights, pages: list[Page]) -> np.ndarray:
    own = [x for p in pages for x in p]
    buckets, _, n_words = words_of(own)
    words = _summed(w["word"][buckets], n_words) / np.maximum(1, n_words)[:, None]
    return np.concatenate([path_sums(w, pages), words, measures(own, n_words)], 1).astype(np.float32)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 + 0.5 * np.tanh(0.5 * x)


def lstm(x: np.ndarray, mask: np.ndarray, w: Weights, name: str, keep: list | None = None) -> np.ndarray:
    """One direction over x [time, page, input]; states of padding are zero. keep gets what training needs."""
    steps, pages, _ = x.shape
    h = np.zeros((pages, HIDDEN), np.float32)
    c = np.zeros((pages, HIDDEN), np.float32)
    out = np.zeros((steps, pages, HIDDEN), np.float32)
    ahead, low, high = None, 0, 0  # the inputs' part of so many steps, so that a very long page takes little memory
    for t in range(steps) if name == "f" else range(steps - 1, -1, -1):
        if not low <= t < high:
            low, high = (t, min(steps, t + STEPS_AHEAD)) if name == "f" else (max(0, t + 1 - STEPS_AHEAD), t + 1)
            ahead = (x[low:high].reshape(-1, x.shape[2]) @ w[f"{name}x"] + w[f"{name}b"]).reshape(high - low, pages, 4 * HIDDEN)
        z = ahead[t - low] + h @ w[f"{name}h"]
        gates = sigmoid(z[:, : 3 * HIDDEN])
        i, f, o = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :]
        g = np.tanh(z[:, 3 * HIDDEN :])
        m = mask[t][:, None]
        before = (h, c)
        c = (f * c + i * g) * m
        th = np.tanh(c)
        h = o * th * m
        out[t] = h
        if keep is not None:
            keep.append((t, before, i, f, o, g, c, th, m))
    return out


def logits(w: Weights, x: np.ndarray, mask: np.ndarray, keep: dict[str, list] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The logit of each step of each page, from the states of both directions and the inputs; and those."""
    hidden = np.concatenate([lstm(x, mask, w, d, None if keep is None else keep[d]) for d in ("f", "r")] + [x], 2)
    return hidden @ w["out"] + w["bias"], hidden


def padded(w: Weights, pages: list[Page]) -> tuple[np.ndarray, np.ndarray]:
    steps = max(map(len, pages))
    x = np.zeros((steps, len(pages), INPUT), np.float32)
    mask = np.zeros((steps, len(pages)), np.float32)
    flat = inputs(w, pages)
    at = 0
    for k, p in enumerate(pages):
        x[: len(p), k] = flat[at : at + len(p)]
        mask[: len(p), k] = 1
        at += len(p)
    return x, mask


def main_texts(w: Weights, pages: list[str], threshold: float = 0.0) -> list[str]:
    """Each page's main text: its blocks labelled so, joined by an empty line."""
    parsed = [leaves(p) for p in pages]
    out = [""] * len(pages)
    order = sorted((i for i in range(len(pages)) if parsed[i]), key=lambda i: len(parsed[i]))
    at = 0
    while at < len(order):
        # pages of like length together, of bounded size
        to, size = at, len(parsed[order[at]])
        while to < len(order) and to - at < PAGES and len(parsed[order[to]]) <= 1.3 * size + 4 and (to == at or (to - at) * len(parsed[order[to]]) < 40_000):
            to += 1
        own = order[at:to]
        z, _ = logits(w, *padded(w, [parsed[i] for i in own]))
        for k, i in enumerate(own):
            out[i] = "\n\n".join(x.text for x, v in zip(parsed[i], z[:, k, 0], strict=False) if v > threshold)
        at = to
    return out


def extract(pages: DataFrame, key: str = "page_id", page: str = "html", keep: tuple[str, ...] = ("url",), weights: Weights | None = None) -> DataFrame:
    """(key, keep, text): the main text of every page, from the whole page.

    Null or empty pages, and pages without main text, give an empty text. Repeated rows each
    come back; an empty table gives no rows. Extra columns are left out. Memory: a batch and
    the padded leaves of a group of pages.
    """
    rows = pick(pages, key, page, *keep)
    sent = rows.sparkSession.sparkContext.broadcast(weights or load())
    kinds = [f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in (key, *keep)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4 * PAGES):
                part = batch.slice(at, 4 * PAGES)
                texts = main_texts(sent.value, [x or "" for x in part.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column(0), *part.columns[2:], pa.array(texts, pa.string())], names=[key, *keep, "text"])

    return rows.mapInArrow(run, ", ".join([*kinds, "text string"]))
