"""Removing passages that stand earlier in the corpus, found through a count-min sketch of windows.

A window is SIZE consecutive words of one document. It is repeated if its word sequence also starts earlier: in a document
with a smaller id, or in the same document further ahead. Each word that a repeated window covers is removed.

1. Rows are put in the order of their ids, once, and cut into blocks of BLOCK_BYTES. A block's number and a word's number
   in it are one 64-bit place, and "earlier" is a smaller place.
2. Sketch: each block touches one cell in each of DEPTH rows of a count-min sketch for each of its windows. The sketch has a cell
   a row for each byte of the corpus, so that it tells windows apart alike at every size. A block's own sketch is sparse:
   the touched cells in order, listed twice if touched more often, as differences in variable-length bytes. Block sketches are
   merged range of cells by range of cells, each in one task of bounded size, which answers to every block which of its cells
   are touched at least twice by all blocks together. No sketch is ever whole anywhere.
3. A window whose cells are all touched twice, in every row, is estimated repeated. The estimate is never too low, so every repeated window is
   among these. A second pass over the texts groups exactly these by 128 bits of their word sequence, of which the smallest place
   is kept; a block sends each sequence once, from its first place.
4. The places that are first go back to their blocks. The other windows estimated repeated are repeated, and their words go.

A sequence that is in a third of all documents is one entry a block in steps 2 and 3, and one row in step 4; nothing is
grouped by it but the smallest place. Texts are shuffled by block, never by content.

Defined results: words are the runs of characters other than ASCII white space, unchanged; a null text has none; a text of less
than SIZE words keeps them all; null ids come first; rows of equal ids are ordered by a hash of their text, and of rows equal in
both one, and only one, is the first; a task holds a block, or a longer text alone, with some 12 bytes for each of its bytes; an empty table gives
no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import only, written

SIZE, DEPTH = 20, 2
#: Bytes of text in a block, cells of a range of the sketch, bits of a word's number in a place and of a block's number in its partition.
BLOCK_BYTES, RANGE_CELLS, WORD_BITS, BLOCK_BITS = 8_000_000, 1 << 23, 30, 12
KEYS = ("spindle repeat 0", "spindle repeat 1")
_BASE = 0x9E3779B97F4A7C15  # odd


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts in one array, and how many each text has."""
    lists = pc.ascii_split_whitespace(texts)
    words = lists.flatten()
    full = pc.greater(pc.binary_length(words), 0)  # white space at an end gives an empty word
    upto = np.r_[0, np.cumsum(full.to_numpy(zero_copy_only=False))][lists.offsets.to_numpy()]
    return words.filter(full), np.diff(upto)


def window_hashes(words: np.ndarray, size: int = SIZE) -> np.ndarray:
    """A hash of each run of size word hashes: the value of a polynomial, from those of runs of 1, 2, 4 and so on."""
    total, length, run, width = None, 0, words, 1
    while True:
        power = np.uint64(pow(_BASE, width, 1 << 64))
        if size & width:
            # What is known so far stands before this run.
            if total is None:
                total, length = run, width
            else:
                n = len(words) - length - width + 1
                if n <= 0:
                    return np.empty(0, np.uint64)
                total, length = total[:n] * power + run[length : length + n], length + width
        if 2 * width > size:
            return total
        n = max(0, len(run) - width)
        run, width = run[:n] * power + run[width:], 2 * width


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def windows(texts: pa.Array, size: int = SIZE) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """(words, how many each text has, the first words of all windows, their hashes of 2 x 64 bits)."""
    words, sizes = split_words(texts)
    coded = words.dictionary_encode()
    which = coded.indices.to_numpy()
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(which))  # words from here to the end of the text
    starts = np.flatnonzero(left >= size)
    distinct = coded.dictionary.cast(pa.binary()).to_numpy(zero_copy_only=False)
    hashes = [_mixed(window_hashes(pd.util.hash_array(distinct, hash_key=k, categorize=False)[which], size)[starts]) for k in KEYS] if len(starts) else [np.empty(0, np.uint64)] * 2
    return words, sizes, starts, np.stack(hashes)


class Sketch(NamedTuple):
    """A count-min sketch of DEPTH rows of cells, which are merged in ranges of width cells; a range's number tells its row too."""

    cells: int
    width: int

    @property
    def ranges(self) -> int:
        return -(-self.cells // self.width)

    def touched(self, hashes: np.ndarray) -> list[np.ndarray]:
        """The cell that each window touches in each row."""
        a, b = hashes
        return [((a + np.uint64(2 * d + 1) * b) % np.uint64(self.cells)).astype(np.int64) for d in range(DEPTH)]

    def sparse(self, hashes: np.ndarray) -> Iterator[tuple[int, bytes]]:
        """(range, touched cells) of a block's windows; cells touched more than once are listed twice."""
        for d, cells in enumerate(self.touched(hashes)):
            cells, n = np.unique(cells, return_counts=True)
            cells = np.repeat(cells, np.minimum(n, 2))
            cuts = np.searchsorted(cells, np.arange(self.ranges + 1) * self.width)
            for r in np.flatnonzero(np.diff(cuts)).tolist():
                yield d * self.ranges + r, packed(cells[cuts[r] : cuts[r + 1]] - r * self.width)

    def merged(self, blobs: list[bytes]) -> Iterator[bytes]:
        """Of each sparse sketch of one range the cells that all of them together touch twice or more."""
        once, twice = np.zeros(self.width, bool), np.zeros(self.width, bool)
        for blob in blobs:
            c = unpacked(blob)
            again = once[c]
            again[1:] |= c[1:] == c[:-1]
            twice[c[again]] = True
            once[c] = True
        for blob in blobs:
            c = np.unique(unpacked(blob))
            yield packed(c[twice[c]])

    def estimated(self, hashes: np.ndarray, told: dict[int, list[bytes]]) -> np.ndarray:
        """Which windows touch cells, in every row, that are told, by range, to be touched twice."""
        repeated = np.ones(hashes.shape[1], bool)
        for d, cells in enumerate(self.touched(hashes)):
            mine = [unpacked(blob) + (r - d * self.ranges) * self.width for r, blobs in told.items() if r // self.ranges == d for blob in blobs]
            listed = np.sort(np.concatenate([np.empty(0, np.int64), *mine]))
            at = np.searchsorted(listed, cells)
            repeated &= at < len(listed)
            repeated[repeated] = listed[at[repeated]] == cells[repeated]
        return repeated


def packed(sorted_values: np.ndarray) -> bytes:
    """Sorted numbers as differences of seven bits a byte; the last byte of each is below 128."""
    if not len(sorted_values):
        return b""
    d = np.diff(sorted_values, prepend=0)
    n = 1 + sum((d >= 1 << 7 * k).astype(np.int64) for k in range(1, 9))
    place = np.cumsum(n) - n
    at = np.arange(int(n.sum())) - np.repeat(place, n)
    more = np.repeat(n, n) - 1 - at
    out = np.repeat(d, n) >> 7 * more & 127
    return (out | (more > 0) * 128).astype(np.uint8).tobytes()


def unpacked(blob: bytes) -> np.ndarray:
    b = np.frombuffer(blob, np.uint8).astype(np.int64)
    if not len(b):
        return b
    last = np.flatnonzero(b < 128)
    first = np.r_[0, last[:-1] + 1]
    more = np.repeat(last, last - first + 1) - np.arange(len(b))
    return np.cumsum(np.add.reduceat((b & 127) << 7 * more, first))


def _deal(block_bytes: int):
    """Rows with the number of their block and of the row in it; blocks are cut by bytes, in the order of the rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << BLOCK_BITS
        block, size, row = first, 0, 0
        for batch in batches:
            ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            done, at = 0, np.empty((2, batch.num_rows), np.int64)
            for i, end in enumerate(ends.tolist()):
                if size and size + end - done > block_bytes:
                    block, size, row = block + 1, 0, 0
                at[:, i] = block, row
                size, done, row = size + end - done, end, row + 1
            if block - first >> BLOCK_BITS:
                raise OverflowError("a partition has too many blocks")
            yield pa.RecordBatch.from_arrays([pa.array(at[0]), pa.array(at[1]), batch.column("doc_id"), batch.column("text")], ["block", "row", "doc_id", "text"])

    return run


def in_order(docs: DataFrame, volume: int, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(block, row, doc_id, text), written: blocks, and rows in a block, follow the order of ids, then of texts' hashes. volume: bytes of all texts."""
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("tie"), F.monotonically_increasing_id().alias("row"))
    dealt = rows.repartitionByRange(volume // (4 * block_bytes) + 1, "doc_id", "tie", "row").sortWithinPartitions("doc_id", "tie", "row")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return written(dealt.select("doc_id", "text").mapInArrow(_deal(block_bytes), f"block bigint, row bigint, doc_id {kind}, text string"))


def _runs(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int, pa.Array]]:
    """(block, texts) for each run of rows of a block."""
    held: list[pa.Array] = []
    now = None
    for batch in batches:
        blocks, texts = batch.column("block").to_numpy(), batch.column("text")
        cuts = np.r_[0, np.flatnonzero(np.diff(blocks)) + 1, len(blocks)] if len(blocks) else []
        for first, last in zip(cuts[:-1], cuts[1:]):
            if held and int(blocks[first]) != now:
                yield now, pa.concat_arrays(held)
                held = []
            now = int(blocks[first])
            held.append(pc.fill_null(texts.slice(first, last - first), ""))
    if held:
        yield now, pa.concat_arrays(held)


def _sketch(sketch: Sketch, size: int):
    """(range, block, cells): the sparse sketches of blocks. A block that two tasks read has two, which add up as any others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, texts in _runs(batches):
            found = [*sketch.sparse(windows(texts, size)[3])]
            ranges, blobs = [r for r, _ in found], [c for _, c in found]
            yield pa.RecordBatch.from_arrays([pa.array(ranges, pa.int64()), pa.array([block] * len(ranges), pa.int64()), pa.array(blobs, pa.binary())], ["range", "block", "cells"])

    return run


def _merge(sketch: Sketch):
    def run(key: tuple, parts: pa.Table) -> pa.Table:
        return parts.set_column(parts.column_names.index("cells"), "cells", pa.array(sketch.merged(parts.column("cells").to_pylist()), pa.binary())).select(["block", "range", "cells"])

    return run


def _told(parts: pa.Table) -> dict[int, list[bytes]]:
    out: dict[int, list[bytes]] = {}
    for r, blob in zip(parts.column("range").to_pylist(), parts.column("cells").to_pylist()):
        if r is not None:
            out.setdefault(r, []).append(blob)
    return out


def _ordered(rows: pa.Table) -> tuple[pa.Table, pa.Array]:
    """A block's rows in their order, and their texts."""
    rows = rows.sort_by("row")
    return rows, pc.fill_null(rows.column("text").combine_chunks(), "")


def _sequences(sketch: Sketch, size: int):
    """(a, b, place) of the windows of a block that are estimated repeated, each sequence from its first place."""

    def run(key: tuple, rows: pa.Table, told: pa.Table) -> pa.Table:
        _, _, starts, hashes = windows(_ordered(rows)[1], size)
        some = sketch.estimated(hashes, _told(told))
        a, b = hashes[:, some].view(np.int64)
        places = (key[0].as_py() << WORD_BITS) + starts[some]
        order = np.lexsort((places, b, a))
        new = np.ones(len(order), bool)
        new[1:] = (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])
        first = order[new]
        return pa.table([pa.array(a[first]), pa.array(b[first]), pa.array(places[first])], names=["a", "b", "place"])

    return run


def _kept(sketch: Sketch, size: int):
    """(doc_id, n_words, n_removed, kept) of a block's rows; told: cells by range, and, without range, the places that are first."""

    def run(key: tuple, rows: pa.Table, told: pa.Table) -> pa.Table:
        rows, texts = _ordered(rows)
        words, sizes, starts, hashes = windows(texts, size)
        some = sketch.estimated(hashes, _told(told))
        firsts = told.column("place").drop_null().to_numpy() - (key[0].as_py() << WORD_BITS)
        repeated = np.setdiff1d(starts[some], firsts, assume_unique=True)
        step = np.zeros(len(words) + 1, np.int64)
        np.add.at(step, repeated, 1)
        np.add.at(step, repeated + size, -1)
        stays = np.cumsum(step[:-1]) == 0
        upto = np.r_[0, np.cumsum(stays)][np.r_[0, np.cumsum(sizes)]]
        lists = pa.ListArray.from_arrays(pa.array(upto, pa.int32()), words.filter(pa.array(stays)))
        n = np.diff(upto)
        return pa.table([rows.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(sizes - n, pa.int64()), pc.binary_join(lists, " ")], names=["doc_id", "n_words", "n_removed", "kept"])

    return run


def remove(docs: DataFrame, size: int = SIZE, block_bytes: int = BLOCK_BYTES, range_cells: int = RANGE_CELLS) -> DataFrame:
    """(doc_id, n_words, n_removed, kept) of docs(doc_id, text); kept is the words that stay, with one space between."""
    docs = only(docs, "doc_id", "text")
    volume = docs.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    sketch = Sketch(max(1, volume), range_cells)
    texts = in_order(docs, volume, block_bytes)
    parts = texts.mapInArrow(_sketch(sketch, size), "range bigint, block bigint, cells binary")
    told = written(parts.groupBy("range").applyInArrow(_merge(sketch), "block bigint, range bigint, cells binary"))
    of_block = texts.groupBy("block")
    estimated = of_block.cogroup(told.groupBy("block")).applyInArrow(_sequences(sketch, size), "a bigint, b bigint, place bigint")
    firsts = written(estimated.groupBy("a", "b").agg(F.min("place").alias("place")).select(F.shiftright("place", WORD_BITS).alias("block"), "place"))
    both = told.select("block", "range", "cells", F.lit(None).cast("long").alias("place")).unionByName(firsts, allowMissingColumns=True)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return of_block.cogroup(both.groupBy("block")).applyInArrow(_kept(sketch, size), f"doc_id {kind}, n_words bigint, n_removed bigint, kept string")
