"""Benchmark decontamination by the q-gram lemma in diagonal bands, verified by banded alignment.

Texts are lower-cased and every run of characters other than letters, marks, digits and underscores, those of all scripts, becomes
one space. Each benchmark item is cut into overlapping windows (a short item is one window). A window of w characters that occurs with
at most k edits shares at least w - q + 1 - k * q of its q-grams with the text, all within k + 1 neighbouring diagonals
(place in the text less place in the window). So, for each text:

1. its q-grams are looked up among the benchmark's; stretches of a window's greatest length with too few hits to meet
   the least bound are left out at once;
2. the hits that remain are counted by (window, diagonal band); bands are 2(k + 1) wide and overlap by half, so that any
   k + 1 neighbouring diagonals lie within one; bands that meet the window's bound are kept;
3. each kept region is verified by an alignment within the band, the ends in the text free.

A text whose hits are too many to hold at once is cut into pieces that overlap by a window's greatest length, and the
windows into parts, until each piece has HITS hits at most. Neighbouring bands that pass are aligned together.

The benchmark is indexed in blocks of bounded size. A group of blocks is broadcast, and a worker keeps their indexes, so
a group takes one scan; a benchmark beyond that (16 million characters) takes another scan for each group. Texts are
never shuffled or broadcast. Items of fewer than q characters take no part.

Defined results: a null or empty text or item has no hits; every row is judged by its own text, whatever its doc_id, and
repeated rows are reported each; so are repeated items; ids are of any type, and null ids are ids; of several regions of one item in a text the one with the fewest
edits counts, then the first; an empty table gives no rows; extra columns are ignored (and kept by clean).
"""

from __future__ import annotations

import unicodedata
import uuid
from collections import OrderedDict
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema, to_arrow_type

from .common import materialize, only

#: q, a window's characters, their step, and edits as a part of the window.
Q, WINDOW, STEP, EDITS = 10, 128, 64, 0.08
#: Benchmark characters and items in one block, and blocks in a group, which a worker holds together.
BLOCK_CHARS, BLOCK_ITEMS, GROUP = 2_000_000, 20_000, 8
#: Hits held at once, and bands aligned together.
HITS, RUN = 1_000_000, 256
B, B2, B4 = (np.uint32(pow(0x9E3779B1, e, 1 << 32)) for e in (1, 2, 4))


def folded(text: str) -> str:
    """Lower case of the same length."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(x if len(x := c.lower()) == 1 else c for c in text)


@cache
def _word() -> np.ndarray:
    """For each code point whether it belongs to a word."""
    return np.array([unicodedata.category(chr(c))[0] in "LMN" or c == ord("_") for c in range(0x110000)])


def normal(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(code points, their places in text) after case folding and joining separators."""
    codes = np.frombuffer(folded(text).encode("utf-32-le", "surrogatepass"), np.uint32)
    word = _word()[codes]
    keep = word.copy()
    keep[1:] |= word[:-1]  # the first separator after a word
    codes = np.where(word, codes, 32)[keep]
    at = np.flatnonzero(keep)
    end = len(codes) - 1 if len(codes) and codes[-1] == 32 else len(codes)
    return codes[:end], at[:end]


def grams(codes: np.ndarray) -> np.ndarray:
    """A 32-bit hash of each run of Q code points, by doubling."""
    if len(codes) < Q:
        return np.empty(0, np.uint32)
    c = (codes + np.uint32(1)) * np.uint32(0x85EBCA6B)
    c ^= c >> np.uint32(15)
    two = c[:-1] * B + c[1:]
    four = two[:-2] * B2 + two[2:]
    eight = four[:-4] * B4 + four[4:]
    ten = eight[:-2] * B2 + two[8:]
    return (ten ^ (ten >> np.uint32(16))) * np.uint32(0xC2B2AE35)


class Windows:
    """The q-gram index of one block of benchmark items."""

    def __init__(self, texts: list[str]) -> None:
        """An item's number is its place in texts."""
        self.item, self.codes, hashes, posts = [], [], [], []
        for item, text in enumerate(texts):
            codes, _ = normal(text)
            if len(codes) < Q:
                continue
            last = max(0, len(codes) - WINDOW)
            for start in [*range(0, last, STEP), last]:
                w = codes[start : start + WINDOW]
                g = grams(w)
                posts.append(np.arange(len(g)) | (len(self.item) << 16))
                hashes.append(g)
                self.item.append(item)
                self.codes.append(w)
        n = np.array([len(w) for w in self.codes] or [Q])
        self.edits = np.minimum((n * EDITS).astype(int), np.maximum(0, (n - Q) // Q))
        self.least = n - Q + 1 - self.edits * Q
        self.span, self.bound = int((n + self.edits).max()) - Q + 1, int(self.least.min())
        flat, post = np.concatenate(hashes or [np.empty(0, np.uint32)]), np.concatenate(posts or [np.empty(0, np.int64)])
        order = np.argsort(flat, kind="stable")
        self.post = post[order]
        self.gram, first = np.unique(flat[order], return_index=True)
        self.cut = np.r_[first, len(flat)]
        self.bits = np.zeros(1 << 22, bool)
        self.bits[self.gram >> np.uint32(10)] = True

    def find(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item, edits, start, end) of every verified region."""
        codes, places = normal(text)
        g = grams(codes)
        maybe = np.flatnonzero(self.bits[g >> np.uint32(10)])
        if len(maybe) < self.bound:
            return []
        # Hits in a stretch that holds at least bound of them within span.
        near = np.flatnonzero(maybe[self.bound - 1 :] - maybe[: len(maybe) - self.bound + 1] < self.span) if self.bound > 1 else np.arange(len(maybe))
        if not len(near):
            return []
        edge = np.zeros(len(maybe) + 1, np.int64)
        np.add.at(edge, near, 1)
        np.add.at(edge, np.minimum(near + self.bound, len(maybe)), -1)
        at = maybe[np.cumsum(edge)[:-1] > 0]
        k = np.searchsorted(self.gram, g[at])
        ok = self.gram[np.minimum(k, len(self.gram) - 1)] == g[at]
        at, k = at[ok], k[ok]
        passed = [x for x in self._passed(at, k, 0, len(self.codes)) if len(x)]
        if not passed:
            return []
        out, runs = [], []
        for x in np.unique(np.concatenate(passed)).tolist():
            if runs and runs[-1][1] == x - 1 and x - runs[-1][0] < RUN:
                runs[-1][1] = x  # overlapping bands are aligned together
            else:
                runs.append([x, x])
        done = -1
        for x, y in runs:
            w, edits = x >> 40, int(self.edits[x >> 40])
            if w == done:  # an earlier region of the window has no edit
                continue
            low = ((x & (1 << 40) - 1) * (edits + 1)) - (1 << 20)
            high = ((y & (1 << 40) - 1) * (edits + 1)) - (1 << 20) + 2 * edits + 1
            r = align(self.codes[w], codes, low, high, edits)
            if r:
                out.append((self.item[w], r[0], int(places[r[1]]), int(places[r[2] - 1]) + 1))
                done = w if r[0] == 0 else -1
        return out

    def _passed(self, at: np.ndarray, k: np.ndarray, first: int, last: int) -> Iterator[np.ndarray]:
        """The keys (window, band) that hold enough hits of the places at with the grams k; of the windows first to last alone."""
        low, high = self.cut[k], self.cut[k + 1]
        if (first, last) != (0, len(self.codes)):
            own, back = np.unique(k, return_inverse=True)
            edges = [self.cut[i] + np.searchsorted(self.post[self.cut[i] : self.cut[i + 1]], [first << 16, last << 16]) for i in own.tolist()]
            low, high = np.array(edges).reshape(-1, 2)[back].T
        counts = high - low
        total = int(counts.sum())
        if total > HITS and len(at) > 4 * self.span:  # pieces that overlap by the longest match
            middle = len(at) // 2
            upto = int(np.searchsorted(at, at[middle] + self.span, "right"))
            yield from self._passed(at[:upto], k[:upto], first, last)
            yield from self._passed(at[middle:], k[middle:], first, last)
        elif total > HITS and last - first > 1:
            middle = (first + last) // 2
            yield from self._passed(at, k, first, middle)
            yield from self._passed(at, k, middle, last)
        elif total:
            post = self.post[np.repeat(low - np.r_[0, np.cumsum(counts)[:-1]], counts) + np.arange(total)]
            window, diagonal = post >> 16, np.repeat(at, counts) - (post & 0xFFFF)
            band = (diagonal + (1 << 20)) // (self.edits[window] + 1)
            # Two bands for each diagonal: (b, b + 1) for b and for b - 1.
            key = np.concatenate([window << 40 | band, window << 40 | (band - 1)])
            found, n = np.unique(key, return_counts=True)
            yield found[n >= self.least[found >> 40]]

    def best(self, text: str | None) -> list[tuple[int, int, int, int]]:
        """For each item, by its number, its best region."""
        best: dict[int, tuple[int, int, int]] = {}
        for item, *r in self.find(text) if text else []:
            best[item] = min(best.get(item, (1 << 60, 0, 0)), tuple(r))
        return [(i, *r) for i, r in sorted(best.items())]


def align(w: np.ndarray, text: np.ndarray, low: int, high: int, edits: int) -> tuple[int, int, int] | None:
    """(edits, start, end) of the best alignment of all of w within the diagonals low - edits to high + edits, or None.

    Cell d of row i holds the least edits of w[:i] against text ending at i + d, and the place where that began. Beyond
    the text stands a character that matches nothing; what an alignment takes of it is cut off, at no other cost.
    """
    first = low - edits
    n = high + edits + 1 - first
    a, b = max(0, first), min(len(text), first + n + len(w))
    if b <= a:
        return None
    exact = text[a:b].tobytes().find(w.tobytes())
    while exact >= 0 and exact % 4:
        exact = text[a:b].tobytes().find(w.tobytes(), exact + 1)
    if exact >= 0:
        return 0, a + exact // 4, a + exact // 4 + len(w)
    area = np.zeros(n + len(w), np.uint32)
    area[a - first : b - first] = text[a:b]
    differs = np.lib.stride_tricks.sliding_window_view(area, n)[: len(w)] != w[:, None]
    steps = np.arange(n, dtype=np.int32)
    cost, began = np.zeros(n, np.int32), steps + np.int32(first)
    new, start = np.empty(n, np.int32), np.empty(n, np.int32)
    for i in range(len(w)):
        np.add(cost, differs[i], out=new)
        skip = cost[1:] + 1  # w[i] has no partner
        less = skip < new[:-1]
        np.minimum(new[:-1], skip, out=new[:-1])
        start[:] = began
        start[:-1][less] = began[1:][less]
        held = new - steps  # text characters without partner
        least = np.minimum.accumulate(held)
        began = start[np.maximum.accumulate(np.where(held == least, steps, 0))]
        cost = least + steps
        if not i % 16 and cost.min() > edits:
            return None
    end = int(np.argmin(cost))
    a, b = max(0, int(began[end])), min(len(text), len(w) + first + end)
    return (int(cost[end]), a, b) if cost[end] <= edits and b > a else None


def _blocks(benchmark: DataFrame) -> Iterator[list[tuple]]:
    """The items, a bounded block at a time."""
    block, size = [], 0
    for r in only(benchmark, "item_id", "text").where("text is not null").toLocalIterator():
        block.append((r["item_id"], r["text"]))
        size += len(r["text"])
        if size >= BLOCK_CHARS or len(block) >= BLOCK_ITEMS:
            yield block
            block, size = [], 0
    if block:
        yield block


def _groups(benchmark: DataFrame) -> Iterator[list]:
    """Broadcasts of up to GROUP blocks, one for each block; the driver holds one block at a time."""
    share, group = benchmark.sparkSession.sparkContext.broadcast, []
    for block in _blocks(benchmark):
        group.append(share((uuid.uuid4().hex, [i for i, _ in block], [t for _, t in block])))
        if len(group) == GROUP:
            yield group
            group = []
    if group:
        yield group


_windows: OrderedDict[str, tuple[Windows, list]] = OrderedDict()


def _index(held) -> tuple[Windows, list]:
    """The index and item ids of a block; a worker keeps those of one group."""
    key, ids, texts = held.value
    if key not in _windows:
        while len(_windows) >= GROUP:
            _windows.popitem(last=False)
        _windows[key] = Windows(texts), ids
    return _windows[key]


def _pass(group: list, use: Callable[[pa.RecordBatch, list[tuple]], pa.RecordBatch]):
    """A mapInArrow function. use gets a batch and the (row, item_id, edits, start, end) found in its column text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = [_index(held) for held in group]
        for batch in batches:
            found = []
            for n, text in enumerate(batch.column("text")):
                text = text.as_py()
                found += [(n, ids[i], *r) for windows, ids in blocks for i, *r in windows.best(text)]
            yield use(batch, found)

    return run


def find(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, edits, start, end): the best region of each item in each text that holds one; offsets in code points."""
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    item = benchmark.schema["item_id"].dataType
    schema = f"doc_id {kind}, item_id {item.simpleString()}, edits bigint, start bigint, end bigint"
    types = [to_arrow_type(item), *[pa.int64()] * 3]

    def listed(batch: pa.RecordBatch, found: list[tuple]) -> pa.RecordBatch:
        cols = [pa.array([r[c] for r in found], t) for c, t in enumerate(types, 1)]
        return pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array([r[0] for r in found], pa.int64())), *cols], ["doc_id", "item_id", "edits", "start", "end"])

    texts, out, last = only(docs, "doc_id", "text"), None, []
    for group in _groups(benchmark):
        if last:  # one group's broadcast at a time
            out = materialize(out)
            for held in last:
                held.unpersist()
        found = texts.mapInArrow(_pass(group, listed), schema)
        out, last = found if out is None else out.unionByName(found), group
    return spark.createDataFrame([], schema) if out is None else out


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the rows whose text holds a benchmark passage. Rows pass through; there is no join."""
    out, last = docs, []
    arrow = to_arrow_schema(docs.schema)

    def kept(batch: pa.RecordBatch, found: list[tuple]) -> pa.RecordBatch:
        clear = np.ones(batch.num_rows, bool)
        clear[[r[0] for r in found]] = False
        rows = batch.filter(pa.array(clear))
        return pa.RecordBatch.from_arrays([c.cast(f.type) if c.type != f.type else c for c, f in zip(rows.columns, arrow)], schema=arrow)

    for group in _groups(benchmark):
        if last:
            out = materialize(out)
            for held in last:
                held.unpersist()
        out, last = out.mapInArrow(_pass(group, kept), docs.schema), group
    return out
