"""Benchmark decontamination: windows of test items, hashed and broadcast, found in documents.

A document's words are found, hashed and rolled into window hashes with numpy over blocks
of bytes; windows whose hash is in the set are compared word by word. Nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import ascii_fold, blocks, by_place, checkpoint, letters_digits, pick, powers, word_bounds, word_hashes

#: Words of a window.
WINDOW = 10
#: The items of one pass have at most this many bytes (a longer item is its own pass), so
#: what is broadcast has a fixed bound: ten times as many bytes at two-letter words, five times
#: at words of six. More items take more passes over the documents.
BLOCK_ITEM_BYTES = 8 << 20
#: Bytes of items that are cut into words at once.
CUT_BYTES = 256 << 10

FOLD = ascii_fold(letters_digits())
#: A run of hit words: its first word and past its last, its first character and past its last.
RUN = ("first", "last", "start", "end")


@dataclass
class Kind:
    """The distinct windows of one length, by hash: where each one's words begin and end in the
    items' bytes, and a run of ``items`` that have it. Windows of one hash stand side by side."""

    hashes: np.ndarray
    first: np.ndarray
    past: np.ndarray
    run: np.ndarray
    items: np.ndarray
    #: Which low bits of a hash occur, a bit each: a first sieve with sixteen places for a hash.
    seen: np.ndarray


class Windows:
    """The windows of some items, in arrays: a few bytes for each, whatever the items are."""

    def __init__(self, items: list[tuple[str | None, str]], window: int = WINDOW) -> None:
        self.names = np.array([x for x, _ in items], object)
        parts = [_cut(pa.array([t for _, t in items[at:to]], pa.string()), at) for at, to in _runs_of([len(t or "") for _, t in items])]
        sizes = [len(p[0]) for p in parts]
        self.bytes = b"".join(p[0] for p in parts)
        shift = np.cumsum([0, *sizes])
        starts = np.concatenate([np.zeros(0, np.int32), *[(p[1] + s).astype(np.int32) for p, s in zip(parts, shift, strict=False)]])
        ends = np.concatenate([np.zeros(0, np.int32), *[(p[2] + s).astype(np.int32) for p, s in zip(parts, shift, strict=False)]])
        owner = np.concatenate([np.zeros(0, np.int32), *[p[3] for p in parts]])
        hashes = np.concatenate([np.zeros(0, np.uint64), *[p[4] for p in parts]])
        del parts
        counts = np.bincount(owner, minlength=len(items)) if len(items) else np.zeros(0, np.int64)
        self.kinds: dict[int, Kind] = {}
        for n in np.unique(np.minimum(counts[counts > 0], window)).tolist():
            self.kinds[n] = self._kind(n, window, counts, starts, ends, owner, hashes)

    def _kind(self, n: int, window: int, counts: np.ndarray, starts: np.ndarray, ends: np.ndarray, owner: np.ndarray, hashes: np.ndarray) -> Kind:
        last = len(owner) - n
        size = counts[owner[: last + 1]]
        # the first words of windows: those whose n-th word is of the same item, in items that have windows so long
        at = np.flatnonzero((owner[: last + 1] == owner[n - 1 :]) & ((size >= window) if n == window else (size == n))).astype(np.int32)
        own = rolled(hashes, n)[at]
        order = np.argsort(own, kind="stable")
        own, at = own[order], at[order]
        first, past, item = starts[at], ends[at + n - 1], owner[at]
        del order, at
        # equal neighbours are one window; in the rare run of one hash and several texts, sort by text
        new = np.ones(len(own), bool)
        new[1:] = own[1:] != own[:-1]
        same = np.flatnonzero(~new)
        text = lambda i: self.bytes[first[i] : past[i]]
        unlike = [i for i in same.tolist() if text(i) != text(i - 1)]
        for i in unlike:
            if new[i]:
                continue
            low = int(np.searchsorted(own, own[i], "left"))
            high = int(np.searchsorted(own, own[i], "right"))
            by_text = np.array(sorted(range(low, high), key=lambda k: (text(k), k)))
            first[low:high], past[low:high], item[low:high] = first[by_text], past[by_text], item[by_text]
            for k in range(low + 1, high):
                new[k] = text(k) != text(k - 1)
        begin = np.flatnonzero(new).astype(np.int32)
        bits = max(16, (16 * len(begin)).bit_length())
        seen = np.zeros(1 << (bits - 3), np.uint8)
        low_bits = (own[begin] & np.uint64((1 << bits) - 1)).astype(np.int64)
        np.bitwise_or.at(seen, low_bits >> 3, (1 << (low_bits & 7)).astype(np.uint8))
        return Kind(own[begin], first[begin], past[begin], np.append(begin, len(own)).astype(np.int32), item, seen)

    def find(self, words: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """The first words of the runs of n words whose hash occurs, and the first window of that hash."""
        kind = self.kinds[n]
        if len(words) < n:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        h = rolled(words, n)
        low = (h & np.uint64((len(kind.seen) << 3) - 1)).astype(np.int64)
        maybe = np.flatnonzero(kind.seen[low >> 3] >> (low & 7).astype(np.uint8) & 1)
        at = np.searchsorted(kind.hashes, h[maybe])
        at[at == len(kind.hashes)] = 0
        hit = kind.hashes[at] == h[maybe]
        return maybe[hit], at[hit]

    def window(self, n: int, at: int, text: bytes) -> int:
        """The number of the window of these words, from the first of their hash on; -1 if there is none."""
        kind = self.kinds[n]
        h = kind.hashes[at]
        while at < len(kind.hashes) and kind.hashes[at] == h:
            if self.bytes[kind.first[at] : kind.past[at]] == text:
                return at
            at += 1
        return -1

    def items_of(self, n: int, at: int) -> set[str]:
        kind = self.kinds[n]
        return {x for x in self.names[kind.items[kind.run[at] : kind.run[at + 1]]] if x is not None}


def _runs_of(sizes: list[int]) -> Iterator[tuple[int, int]]:
    """Runs of items of about CUT_BYTES."""
    at, size = 0, 0
    for i, x in enumerate(sizes):
        size += x
        if size >= CUT_BYTES:
            yield at, i + 1
            at, size = i + 1, 0
    if at < len(sizes):
        yield at, len(sizes)


def _cut(texts: pa.Array, number: int) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, starts, ends, owners, hashes): texts as words with a space after each, and their words.

    Owners are numbers of items, the first text's being ``number``.
    """
    out = [(b"", *[np.zeros(0, np.int64)] * 2, np.zeros(0, np.int32), np.zeros(0, np.uint64))]
    size = 0
    for at, _, data, offsets in blocks(texts, CUT_BYTES):
        folded = FOLD[data]
        starts, ends = word_bounds(folded != 0, offsets)
        lens = ends - starts
        begin = size + np.cumsum(lens + 1) - (lens + 1)
        out.append((_spaced(folded, starts, ends), begin, begin + lens, (number + at + np.searchsorted(offsets, starts, "right") - 1).astype(np.int32), word_hashes(folded, starts, ends)))
        size += len(out[-1][0])
    return b"".join(x[0] for x in out), *[np.concatenate([x[i] for x in out]) for i in range(1, 5)]


def _spaced(folded: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> bytes:
    """The words, each with a space after it."""
    # a word that ends with its text has no byte of its own after it, so bytes are placed one by one
    lens = ends - starts
    place = np.repeat(np.cumsum(lens + 1) - (lens + 1) - starts, lens)
    kept = np.flatnonzero(folded)
    spaced = np.full(int((lens + 1).sum()), 32, np.uint8)
    spaced[kept + place] = folded[kept]
    return spaced.tobytes()


def rolled(words: np.ndarray, n: int) -> np.ndarray:
    """A hash of each n words in a row."""
    out = np.zeros(max(len(words) - n + 1, 0), np.uint64)
    with np.errstate(over="ignore"):
        for k, p in enumerate(powers(n, 0xA0761D6478BD642F)):
            out += words[k : len(words) - n + 1 + k] * p
    return out ^ (out >> np.uint64(31))


def scan(column: pa.Array, windows: Windows) -> Iterator[tuple[int, list[tuple[int, int, int, int]], set[str]]]:
    """For each text: the number of its words, its runs of hit words (see RUN), the items met."""
    for at, to, data, offsets in blocks(column):
        folded = FOLD[data]
        starts, ends = word_bounds(folded != 0, offsets)
        row = np.searchsorted(offsets, starts, "right") - 1
        n_words = np.bincount(row, minlength=to - at) if len(row) else np.zeros(to - at, np.int64)
        hashes = word_hashes(folded, starts, ends)
        delta = np.zeros(len(starts) + 1, np.int64)
        found: dict[int, set[tuple[int, int]]] = {}
        for n in windows.kinds:
            for i, w in zip(*(x.tolist() for x in windows.find(hashes, n)), strict=True):
                if row[i] != row[i + n - 1]:
                    continue
                text = b"".join(folded[starts[k] : ends[k]].tobytes() + b" " for k in range(i, i + n))[:-1]
                if (w := windows.window(n, w, text)) >= 0:
                    delta[i] += 1
                    delta[i + n] -= 1
                    found.setdefault(int(row[i]), set()).add((n, w))
        met = {k: set().union(*(windows.items_of(*x) for x in own)) for k, own in found.items()}
        hit = np.cumsum(delta[:-1]) > 0
        # runs of hit words; a run ends with its row
        edge = np.flatnonzero(hit)
        runs: dict[int, list[tuple[int, int, int, int]]] = {}
        first_word = np.cumsum(n_words) - n_words
        if len(edge):
            new = np.ones(len(edge), bool)
            new[1:] = (np.diff(edge) > 1) | (np.diff(row[edge]) > 0)
            first = edge[new]
            last = edge[np.append(np.flatnonzero(new)[1:] - 1, len(edge) - 1)]
            for a, b in zip(first.tolist(), last.tolist(), strict=True):
                word = a - int(first_word[row[a]])
                runs.setdefault(int(row[a]), []).append((word, word + b - a + 1, int(starts[a]), int(ends[b])))
        for k in range(to - at):
            own = runs.get(k, [])
            chars = []
            if own:
                # code points before each byte of this text
                text = data[offsets[k] : offsets[k + 1]]
                before = np.concatenate([[0], np.cumsum((text & 0xC0) != 0x80)])
                chars = [(i, j, int(before[a - offsets[k]]), int(before[b - offsets[k]])) for i, j, a, b in own]
            yield int(n_words[k]), chars, met.get(k, set())


def item_blocks(benchmark: DataFrame, key: str, text: str, most: int = BLOCK_ITEM_BYTES) -> Iterator[list[tuple[str | None, str]]]:
    """The items in blocks of bounded size; the driver holds one at a time."""
    block: list[tuple[str | None, str]] = []
    size = 0
    for item, body in pick(benchmark, key, text).select(F.col(key).cast("string"), text).toLocalIterator():
        if block and size + len(body or "") > most:
            yield block
            block, size = [], 0
        block.append((item, body or ""))
        size += len(body or "")
    yield block


def find_hits(
    docs: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    block_bytes: int = BLOCK_ITEM_BYTES,
) -> DataFrame:
    """docs with ``_words`` (their number), ``_runs`` (hit runs, in code points) and ``_items`` (ids as strings, sorted).

    Words: ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z. A window is
    ``window`` words of an item, or the whole item if it has fewer, but some. Null and empty
    texts have no words; an item without an id makes hits but is not listed. Repeated rows
    each get the same result, items repeated under one id count once, an empty table of
    items hits nothing. All columns of docs are kept, but columns of these three names are replaced.
    """
    docs = docs.drop("_words", "_runs", "_items")
    run = f"array<struct<{','.join(f'{x}:bigint' for x in RUN)}>>"
    out = docs.withColumns(
        {
            "_words": F.lit(0).cast("bigint"),
            "_runs": F.expr(f"cast(array() as {run})"),
            "_items": F.expr("cast(array() as array<string>)"),
        }
    )
    ready = None
    for block in item_blocks(benchmark, item, item_text, block_bytes):
        if ready is not None:
            ready = checkpoint(ready)
        ready = _pass(ready if ready is not None else out, Windows(block, window), text)
    return ready


def _pass(docs: DataFrame, windows: Windows, text: str) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(windows)
    at, schema = docs.columns.index(text), docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, runs, items = [], [], []
            olds = zip(batch.column(batch.num_columns - 2).to_pylist(), batch.column(batch.num_columns - 1).to_pylist(), strict=True)
            for (n, own, met), (old_runs, old_items) in zip(scan(batch.column(at), sent.value), olds, strict=True):
                words.append(n)
                runs.append(joined(own + [tuple(x[k] for k in RUN) for x in old_runs]))
                items.append(sorted(met.union(old_items)))
            made = [pa.array(words, pa.int64()), pa.array(runs, pa.list_(pa.struct([(x, pa.int64()) for x in RUN]))), pa.array(items, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-3], *made], names=schema.names)

    return docs.mapInArrow(run, schema)


def joined(runs: list[tuple[int, int, int, int]]) -> list[dict[str, int]]:
    """The union of runs of hit words, in order."""
    out: list[list[int]] = []
    for first, last, start, end in sorted(runs):
        if out and first <= out[-1][1]:
            if last > out[-1][1]:
                out[-1][1], out[-1][3] = last, end
        else:
            out.append([first, last, start, end])
    return [dict(zip(RUN, x, strict=True)) for x in out]


def without(text: str, runs: list[dict[str, int]]) -> str:
    """The text without the characters of the hit runs."""
    at, kept = 0, []
    for x in runs:
        kept.append(text[at : x["start"]])
        at = x["end"]
    return "".join([*kept, text[at:]])


def summary(hits: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, n_words, n_hit, n_items, items_sha256, contaminated) of what ``find_hits`` returns."""
    n_hit = F.expr("aggregate(_runs, 0L, (n, r) -> n + r.last - r.first)")
    return hits.select(
        key,
        F.col("_words").alias("n_words"),
        n_hit.alias("n_hit"),
        F.size("_items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("_items", ","), 256).alias("items_sha256"),
        (F.size("_runs") > 0).alias("contaminated"),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", remove: str = "documents", **options) -> DataFrame:
    """docs without those that hold a window (``remove="documents"``) or without the hit words (``"spans"``).

    Clean documents stay as they are. After spans are cut out, the words beside them can
    make up a window of their own, so the text is scanned again until none is left. Items
    over the size of a block are worked through block by block, so that one block at a time
    is broadcast, until a round cuts nothing. Null texts stay null, repeated rows each stay,
    an empty table of documents gives no rows and one of items changes nothing. All columns
    are kept, whatever their names.
    """
    if remove == "documents":
        own = by_place(docs)
        hits = find_hits(own, benchmark, own.columns[docs.columns.index(text)], **options)
        return hits.where("size(_runs) = 0").select(*own.columns).toDF(*docs.columns)
    if remove != "spans":
        raise ValueError("remove is 'documents' or 'spans'")
    own = by_place(docs).withColumn("_cut", F.lit(False))
    at, window = docs.columns.index(text), options.get("window", WINDOW)
    items = lambda: item_blocks(benchmark, options.get("item", "item_id"), options.get("item_text", "text"), options.get("block_bytes", BLOCK_ITEM_BYTES))
    clean, ready = 0, None  # passes in a row that cut nothing
    while True:
        passes = 0
        for block, more in _and_whether_more(items()):
            passes += 1
            ready = _cut_pass(own if ready is None else checkpoint(ready), Windows(block, window), at)
            if passes == 1 and not more:  # all items in one pass, which leaves none
                return ready.drop("_cut").toDF(*docs.columns)
            ready = checkpoint(ready)
            clean = 0 if not ready.where("_cut").isEmpty() else clean + 1
        if clean >= passes:
            return ready.drop("_cut").toDF(*docs.columns)


def _and_whether_more(blocks: Iterator[list]) -> Iterator[tuple[list, bool]]:
    held = next(blocks, None)
    for block in blocks:
        yield held, True
        held = block
    if held is not None:
        yield held, False


def _cut_pass(docs: DataFrame, windows: Windows, at: int) -> DataFrame:
    """docs, whose last column is ``_cut``, without hit words, until none is left; ``_cut`` where there were some."""
    sent, schema = docs.sparkSession.sparkContext.broadcast(windows), docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, cut = batch.column(at).to_pylist(), [False] * batch.num_rows
            again = list(range(len(texts)))
            while again:
                runs = {k: own for k, (_, own, _) in zip(again, scan(pa.array([texts[k] for k in again], pa.string()), sent.value), strict=True)}
                again = [k for k in again if runs[k]]
                for k in again:
                    texts[k], cut[k] = without(texts[k], joined(runs[k])), True
            columns = list(batch.columns)
            columns[at], columns[-1] = pa.array(texts, columns[at].type), pa.array(cut, pa.bool_())
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return docs.mapInArrow(run, schema)
