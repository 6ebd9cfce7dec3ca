"""Language-model scoring with Brown class bigrams learnt by exchange clustering.

Tokens are the runs of bytes other than ASCII white space, A-Z in lower case, then one end token for each text; the end
token is also the context of the first word. Counts cover every training text:

1. Word counts: each task counts its texts and sends sums; one table of the whole vocabulary, never gathered.
2. Words that make up at least FREQUENT of all tokens (so at most 1 / FREQUENT of them at any size) are exchanged by
   rounds; until these end all other words stand in one class more, and the end token in its own. Bigram counts of these
   symbols are one table.
3. Rounds: a word moves to the class that most raises the class bigram likelihood. The context counts of every word by
   class are aggregated over the bigram table, and one part of the words, by turns, is moved in parallel against the same
   class matrix. A round that lowers the likelihood is undone, and the parts are halved. The search ends when every part
   in turn has raised it by less than CONVERGED of its value, or the parts are smaller than one in MOST_PARTS.
4. All other words, however rare, are then exchanged once: one pass over the texts gives each word's contexts by class,
   which are added up over all tasks before the word is classed, so that classes do not depend on how texts are dealt to tasks. A word is
   added to the class of frequent words from which the likelihood of its contexts gains most; it is in no class before that, so nothing of its
   own is to be taken out. Words that have only each other for neighbours keep the class of their own.
5. One more pass counts the class pairs of all transitions, each word's class being known by then; nothing is spread or estimated.
6. p(word | previous) = MIX * p(class | previous class) * p(word | class) + (1 - MIX) * base(word), where class
   transitions have add-ALPHA smoothing and base is the add-0.1 unigram model that also holds one unseen word.

Rows are dealt to blocks of a bounded number of bytes by their place in the scan, so that equal rows are not one block, and written
so, once. A block's distinct words, without those of step 2 (which are broadcast: 1 / FREQUENT words at most), are joined with
the word table, and steps 5 and 6 give each block its own dictionary; neither the vocabulary nor the texts are broadcast.

Defined results: a null text is empty and has the end token alone; a null doc_id counts as the empty string when rows
are held out; without training texts every token is unseen; repeated rows count and are scored each, very long texts
whole; words of equal counts are ordered by the word, equal gains go to the lower class; an empty table gives no rows;
extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, only, written
from .langid import held_out

FREQUENT, CLASSES, MIX, ALPHA, ADD = 2e-5, 64, 0.6, 0.1, 0.1
CONVERGED, MOST_PARTS = 1e-4, 16
#: Bytes of text in a block, bytes that are split into words at once, and distinct words or bigrams that a task holds before it sends their sums.
BLOCK_BYTES, PIECE_BYTES, HELD = 16_000_000, 8_000_000, 400_000
#: The largest count of a packed entry.
MOST = (1 << 24) - 1


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def pieces(batches: Iterable[pa.RecordBatch], most: int = PIECE_BYTES) -> Iterator[pa.Array]:
    """The column text of batches, nulls as empty texts, in arrays of most bytes at most; a longer text stands alone."""
    held: list[pa.Array] = []
    size = 0
    for batch in batches:
        texts = pc.fill_null(batch.column("text"), "")
        ends = np.r_[0, np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64) + 8)]
        first = 0
        while first < len(texts):
            upto = int(np.searchsorted(ends, ends[first] + most - size, "right")) - 1
            if upto <= first and held:
                yield pa.concat_arrays(held)
                held, size = [], 0
                continue
            upto = max(upto, first + 1)
            held.append(texts.slice(first, upto - first))
            size += int(ends[upto] - ends[first])
            first = upto
    if held:
        yield pa.concat_arrays(held)


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts, as words_of gives them, in one array, and how many each text has."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    words = lists.flatten().cast(pa.binary())
    full = pc.greater(pc.binary_length(words), 0)  # white space at an end gives an empty word
    upto = np.r_[0, np.cumsum(full.to_numpy(zero_copy_only=False))][lists.offsets.to_numpy()]
    return words.filter(full), np.diff(upto)


def with_ends(ids: np.ndarray, sizes: np.ndarray, end: int) -> np.ndarray:
    """The words of texts of these sizes, each text followed by the end token."""
    out = np.full(len(ids) + len(sizes), end, np.int64)
    out[np.arange(len(ids)) + np.repeat(np.arange(len(sizes)), sizes)] = ids
    return out


def numbers(words: pa.Array, known: pa.Array, other: int) -> np.ndarray:
    """The place of each word among those known, or other."""
    return pc.fill_null(pc.index_in(words, value_set=known), other).to_numpy(zero_copy_only=False).astype(np.int64)


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[pa.Table] = []
    size = 0
    for texts in pieces(batches):
        found = split_words(texts)[0].value_counts()
        held.append(pa.table({"word": found.field("values"), "n": found.field("counts")}))
        size += len(found)
        if size > 2 * HELD:
            held = [_summed(held)]
            size = held[0].num_rows
            if size > HELD:
                yield from held.pop().to_batches()
                size = 0
    if held:
        yield from _summed(held).to_batches()


def _summed(counts: list[pa.Table]) -> pa.Table:
    total = pa.concat_tables(counts).group_by("word", use_threads=False).aggregate([("n", "sum")])
    return pa.table({"word": total.column("word"), "n": total.column("n_sum")})


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, n) over all of texts(text)."""
    return texts.select("text").mapInArrow(_count_words, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def _count_pairs(held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent = pa.array(held.value, pa.binary())
        rare, end = len(frequent), len(frequent) + 1
        base = end + 1
        sums, total = [], 0

        def out() -> pa.RecordBatch:
            nonlocal total
            keys, back = np.unique(np.concatenate([k for k, _ in sums]), return_inverse=True)
            n = np.bincount(back, np.concatenate([c for _, c in sums])).astype(np.int64)
            sums.clear()
            total = 0
            return pa.RecordBatch.from_arrays([pa.array(keys // base), pa.array(keys % base), pa.array(n)], ["a", "b", "n"])

        for texts in pieces(batches):
            words, sizes = split_words(texts)
            seen = with_ends(numbers(words, frequent, rare), sizes, end)
            sums.append(np.unique(np.r_[end, seen[:-1]] * base + seen, return_counts=True))
            total += len(sums[-1][0])
            if total > 4 * HELD:
                yield out()
        if sums:
            yield out()

    return run


def _h(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def likelihood(pairs: np.ndarray) -> float:
    """Class bigram log likelihood of a matrix of class pair counts, less what no assignment changes."""
    return float(_h(pairs).sum() - _h(pairs.sum(0)).sum() - _h(pairs.sum(1)).sum())


def best_class(pairs: np.ndarray, own: int, before: np.ndarray, after: np.ndarray, itself: float, classes: int) -> int:
    """The class to which a word of class own should move, or own.

    before and after: the word's counts by class of the token before and after it, those of itself included.
    """
    n = pairs.copy()
    n[own] -= after
    n[:, own] -= before
    n[own, own] += itself
    left, right = before.copy(), after.copy()
    left[own] -= itself
    right[own] -= itself
    c = np.arange(classes)
    # A row gets its pairs with the word back wherever that goes; so does a column.
    rows, columns = n.sum(1) + left, n.sum(0) + right
    m = n[:classes]
    gain = (_h(m + right) - _h(m)).sum(1) + (_h(n[:, :classes] + left[:, None]) - _h(n[:, :classes])).sum(0)
    d = n[c, c]
    gain -= _h(d + right[c]) + _h(d + left[c]) - 2 * _h(d)
    gain += _h(d + right[c] + left[c] + itself) - _h(d)
    gain -= _h(rows[c] + after.sum()) - _h(rows[c]) + _h(columns[c] + before.sum()) - _h(columns[c])
    to = int(np.argmax(gain))
    return to if gain[to] > gain[own] + 1e-9 * abs(gain[own]) else own


def _contexts(held):
    """Partial sums of (word, side, class, n) over bigrams; side 0: before, 1: after, 2: the word with itself; word -1: class pairs."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = np.array(held.value)
        width = int(of.max()) + 1
        for batch in batches:
            a, b, n = (batch.column(c).to_numpy() for c in ("a", "b", "n"))
            same = a == b
            word = np.concatenate([b, a, a[same], np.full(len(a), -1)])
            side = np.repeat([0, 1, 2, 3], [len(a), len(a), same.sum(), len(a)])
            kind = np.concatenate([of[a], of[b], np.zeros(same.sum(), np.int64), of[a] * width + of[b]])
            key, back = np.unique((word + 1) << 24 | side << 20 | kind, return_inverse=True)
            total = np.bincount(back, np.concatenate([n, n, n[same], n])).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array((key >> 24) - 1), pa.array(key >> 20 & 15), pa.array(key & (1 << 20) - 1), pa.array(total)], ["word", "side", "class", "n"])

    return run


def _moves(held, classes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, pairs = held.value
        for batch in batches:
            words = batch.column("word").to_pylist()
            to = []
            for word, found in zip(words, batch.column("found").to_pylist()):
                sides = np.zeros((3, len(pairs)))
                for f in found:
                    sides[f["side"], f["class"]] += f["n"]
                to.append(best_class(pairs, int(of[word]), sides[0], sides[1], sides[2, 0], classes))
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.int64()), pa.array(to, pa.int64())], ["word", "to"])

    return run


def exchange(bigrams: DataFrame, words: int, classes: int = CLASSES) -> tuple[np.ndarray, np.ndarray]:
    """(class of each symbol, matrix of class pair counts). Symbols: words by descending count, then all other words, then the end token."""
    share = bigrams.sparkSession.sparkContext.broadcast
    of = np.r_[np.arange(words) % classes, classes, classes + 1]
    width, parts, turn, quiet = classes + 2, 2, 0, 0
    best: tuple[float, np.ndarray, np.ndarray] | None = None
    found = None
    while True:
        new = written(bigrams.mapInArrow(_contexts(share(of.tolist())), "word bigint, side bigint, class bigint, n bigint").groupBy("word", "side", "class").agg(F.sum("n").alias("n")))
        pairs = np.zeros(width * width)
        for r in new.where("word = -1").collect():  # at most one row for each pair of classes
            pairs[r["class"]] = r["n"]
        pairs = pairs.reshape(width, width)
        value = likelihood(pairs)
        if best and value < best[0]:
            discard(new)
            parts, turn, quiet = 2 * parts, turn + 1, 0
            if parts > MOST_PARTS:
                break
        else:
            quiet = quiet + 1 if best and value - best[0] < CONVERGED * abs(value) else 0
            if found is not None:
                discard(found)
            best, found, turn = (value, of, pairs), new, turn + 1
            if quiet >= parts or not words:
                break
        _, of, pairs = best
        some = found.where((F.col("word") >= 0) & (F.col("word") < words) & (F.col("word") % parts == turn % parts))
        each = some.groupBy("word").agg(F.collect_list(F.struct("side", "class", "n")).alias("found"))  # at most 2 * classes + 5 entries
        moves = each.mapInArrow(_moves(share((of, pairs)), classes), "word bigint, to bigint").collect()  # at most 1 / FREQUENT rows
        of = of.copy()
        for r in moves:
            of[r["word"]] = r["to"]
    discard(found)
    return best[1], best[2]


def _rare_contexts(held):
    """(word, entries) of the words that are not frequent: packed counts of the classes before (code class) and after them (code width + class), 24 bits of count each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, of, width = held.value
        frequent = pa.array(frequent, pa.binary())
        kinds = np.r_[of, width - 2]  # then a rare word's
        for texts in pieces(batches):
            words, sizes = split_words(texts)
            coded = words.dictionary_encode()
            kind_of = kinds[numbers(coded.dictionary, frequent, len(frequent))]
            rare_words = np.flatnonzero(kind_of == width - 2)
            if not len(rare_words):
                continue
            number = np.full(len(kind_of) + 1, -1)  # of rare words; the last is the end token's
            number[rare_words] = np.arange(len(rare_words))
            at = with_ends(coded.indices.to_numpy(), sizes, len(kind_of))
            kind = np.r_[width - 1, np.r_[kind_of, width - 1][at]]  # of what stands before each token, then of the last end
            number = number[at]
            rare = np.flatnonzero(number >= 0)
            own = number[rare] << 8
            keys, n = np.unique(np.concatenate([own | kind[rare], own | (kind[rare + 2] + width)]), return_counts=True)
            for start in range(0, int(n.max()), MOST):  # counts of more than 24 bits take several entries
                more = n > start
                yield _packed(coded.dictionary.take(pa.array(rare_words)), keys[more], np.minimum(n[more] - start, MOST))

    return run


def _packed(words: pa.Array, keys: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    entries = ((keys & 255) << 24 | n).astype(np.uint32)
    cuts = np.r_[0, np.cumsum(np.bincount(keys >> 8, minlength=len(words)))] * 4
    blob = pa.Array.from_buffers(pa.binary(), len(words), [None, pa.py_buffer(cuts.astype(np.int32)), pa.py_buffer(entries)])
    return pa.RecordBatch.from_arrays([words, blob], ["word", "entries"])


def best_rare_classes(pairs: np.ndarray, word: np.ndarray, code: np.ndarray, n: np.ndarray, words: int) -> np.ndarray:
    """For each of words, given the sorted sums (word, code, n) of _rare_contexts, the class that gains most from it.

    Gains are those of exchange for a word that is in no class yet, against the class pairs of frequent words and the end alone. A word
    without a neighbour among these stays in the class of rare words. Classes without frequent words are no choice: a word that
    were alone there would gain most, but all rare words are classed against the same counts and would go there together. All other
    classes are heavier than any rare word.
    """
    width = len(pairs)
    rare = width - 2
    empty = pairs.sum(0)[:rare] == 0
    pairs = pairs.copy()
    pairs[rare] = pairs[:, rare] = 0
    told = code % width != rare
    word, code, n = word[told], code[told], n[told]
    found, word = np.unique(word, return_inverse=True)
    out = np.full(words, rare)
    if not len(found):
        return out
    # What an entry adds depends on its code and count alone, and few of these differ.
    kinds, entry = np.unique(code << 48 | n, return_inverse=True)
    other, many = kinds >> 48, (kinds & (1 << 48) - 1).astype(np.float64)[:, None]
    m = np.where((other >= width)[:, None], pairs[:rare, other % width].T, pairs[other % width, :rare])
    gain = np.add.reduceat((_h(m + many) - _h(m))[entry], np.searchsorted(word, np.arange(len(found))))
    sides = np.zeros((2, len(found), width))
    np.add.at(sides, (code // width, word, code % width), n)
    before, after = sides[:, :, :rare]
    both = np.nonzero((before > 0) & (after > 0))  # a class that stands on both sides: its pairs with itself gain from both at once
    d, x, y = pairs[both[1], both[1]], before[both], after[both]
    gain[both] += _h(d + x + y) - _h(d + x) - _h(d + y) + _h(d)
    for counts, margin in ((sides[0].sum(1), pairs.sum(0)), (sides[1].sum(1), pairs.sum(1))):
        totals, which = np.unique(counts, return_inverse=True)
        gain -= (_h(margin[:rare] + totals[:, None]) - _h(margin[:rare]))[which]
    out[found] = rare if empty.all() else np.argmax(np.where(empty, -np.inf, gain), axis=1)
    return out


def _added(words: pa.Array, blobs: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """(distinct words, and their summed entries as number of the word, code and n) of sorted words with packed entries."""
    lengths = pc.binary_length(blobs).to_numpy(zero_copy_only=False) // 4
    packed = np.frombuffer(b"".join(blobs.to_pylist()), np.uint32)
    same = pc.run_end_encode(words)
    ends = same.run_ends.to_numpy()
    number = np.repeat(np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0)), lengths)
    key, back = np.unique(number << 8 | (packed >> 24).astype(np.int64), return_inverse=True)
    total = np.zeros(len(key), np.int64)
    np.add.at(total, back, (packed & 0xFFFFFF).astype(np.int64))
    return same.values, key >> 8, key & 255, total


def _rare_classes(held):
    """(word, class, its count n) from (word, entries), sorted by word: entries are added up, and the last word of a batch waits for the next."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = held.value
        width = len(pairs)

        def classed(words: pa.Array, number: np.ndarray, code: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            to = best_rare_classes(pairs, number, code, n, len(words))
            before = code < width  # one for each time that the word occurs
            count = np.zeros(len(words), np.int64)
            np.add.at(count, number[before], n[before])
            return pa.RecordBatch.from_arrays([words, pa.array(to, pa.int64()), pa.array(count)], ["word", "class", "n"])

        last: tuple[bytes, np.ndarray, np.ndarray] | None = None
        for batch in batches:
            for start in range(0, batch.num_rows, 2000):
                part = batch.slice(start, 2000)
                words, number, code, n = _added(part.column("word"), part.column("entries"))
                if last is not None:
                    if words[0].as_py() == last[0]:
                        mine = number == 0
                        summed, back = np.unique(np.r_[last[1], code[mine]], return_inverse=True)
                        total = np.zeros(len(summed), np.int64)
                        np.add.at(total, back, np.r_[last[2], n[mine]])
                        number, code, n = np.r_[np.zeros(len(summed), np.int64), number[~mine]], np.r_[summed, code[~mine]], np.r_[total, n[~mine]]
                    else:
                        yield classed(pa.array([last[0]], pa.binary()), np.zeros(len(last[1]), np.int64), *last[1:])
                final = number == len(words) - 1
                last = words[-1].as_py(), code[final], n[final]
                if len(words) > 1:
                    yield classed(words[:-1], number[~final], code[~final], n[~final])
        if last is not None:
            yield classed(pa.array([last[0]], pa.binary()), np.zeros(len(last[1]), np.int64), *last[1:])

    return run


class Model:
    """Everything but the counts and classes of words that are not frequent."""

    def __init__(self, frequent: list[bytes], counts: np.ndarray, of: np.ndarray, pairs: np.ndarray, totals: np.ndarray, n: int, distinct: int, ends: int) -> None:
        self.number = {w: i for i, w in enumerate(frequent)}
        self.counts, self.of = counts, of
        self.rare, self.end = len(pairs) - 2, len(pairs) - 1
        some = totals > 0  # classes without tokens get no probability
        self.step = (pairs + ALPHA * some) / np.maximum(pairs.sum(1, keepdims=True) + ALPHA * some.sum(), ALPHA)
        self.totals, self.n, self.distinct, self.ends = totals, n, distinct, ends

    def base(self, count: np.ndarray) -> np.ndarray:
        return (count + ADD) / (self.n + ADD * (self.distinct + 1))

    def known(self, counts: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Count, class, emission and base probability of the frequent words, then of words of these counts and classes, then of the end token."""
        kind = np.r_[self.of, classes, self.end].astype(np.int64)
        count = np.r_[self.counts, counts, self.ends].astype(np.float64)
        return count, kind, count / np.maximum(self.totals[kind], 1), self.base(count)

    def dictionary(self, words: list[bytes], counts: np.ndarray, classes: np.ndarray) -> tuple:
        """The place of each frequent or given word in the arrays of known, and these."""
        number = dict(self.number)
        number.update(zip(words, range(len(number), len(number) + len(words))))
        return number, *self.known(counts, classes)

    def scores(self, texts: pa.Array, words: pa.Array, known: tuple) -> list[np.ndarray]:
        """Tokens, known tokens, base score, score and perplexity of each text; words: the frequent ones and those that known was made of."""
        count, kind, emission, base = known
        found, sizes = split_words(texts)
        ids = numbers(found, words, -1)
        if (ids < 0).any():
            raise KeyError("a word of these texts is not in the dictionary of their block")
        ids = with_ends(ids, sizes, len(words))
        starts = np.r_[0, np.cumsum(sizes + 1)[:-1]]
        k, b = kind[ids], base[ids]
        p = MIX * self.step[np.r_[self.end, k[:-1]], k] * emission[ids] + (1 - MIX) * b
        score = np.add.reduceat(np.log10(p), starts)
        return [sizes + 1, np.add.reduceat((count > 0).astype(np.int64)[ids], starts), np.add.reduceat(np.log10(b), starts), score, 10.0 ** (-score / (sizes + 1))]


class Classes(NamedTuple):
    """Frequent words with their counts and classes, and (word, n, class) of all others; n tokens, distinct ones and ends of texts."""

    frequent: list[bytes]
    counts: np.ndarray
    of: np.ndarray
    width: int
    others: DataFrame
    n: int
    distinct: int
    ends: int


def learn(training: DataFrame, counts: DataFrame) -> Classes:
    """The classes of the words of training(text), whose word counts are counts."""
    share = training.sparkSession.sparkContext.broadcast
    ends = training.count()
    sums = counts.agg(F.count("*").alias("v"), F.sum("n").alias("n")).first()
    n, distinct = (sums["n"] or 0) + ends, sums["v"] + (ends > 0)
    often = F.col("n") >= FREQUENT * n
    top = counts.where(often).collect() if n else []  # at most 1 / FREQUENT rows
    top.sort(key=lambda r: (-r["n"], bytes(r["word"])))
    frequent, totals_of = [bytes(r["word"]) for r in top], np.array([r["n"] for r in top], np.int64)
    bigrams = written(training.select("text").mapInArrow(_count_pairs(share(frequent)), "a bigint, b bigint, n bigint").groupBy("a", "b").agg(F.sum("n").alias("n")))
    of, pairs = exchange(bigrams, len(frequent))
    discard(bigrams)
    of = of[: len(frequent)]
    contexts = training.select("text").mapInArrow(_rare_contexts(share((frequent, of, len(pairs)))), "word binary, entries binary")
    sorted_words = contexts.repartition("word").sortWithinPartitions("word")
    others = written(sorted_words.mapInArrow(_rare_classes(share(pairs)), "word binary, class bigint, n bigint"))
    return Classes(frequent, totals_of, of, len(pairs), others, n, distinct, ends)


def _distinct_words(held):
    """(block, word) of the words that are not frequent, once for each run of rows of a block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent = pa.array(held.value, pa.binary())
        for block, rows in runs(batches):
            words = pa.chunked_array([split_words(t)[0].unique() for t in pieces(rows)], pa.binary()).unique()
            words = words.filter(pc.invert(pc.is_in(words, value_set=frequent)))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(words), block)), words], ["block", "word"])

    return run


def runs(batches: Iterable[pa.RecordBatch], most: int = BLOCK_BYTES) -> Iterator[tuple[int, list[pa.RecordBatch]]]:
    """(block, rows) of rows that stand together; those of a block in several parts if they have more than most bytes."""
    held: list[pa.RecordBatch] = []
    now, size = None, 0
    for batch in batches:
        blocks = batch.column("block").to_numpy()
        cuts = np.r_[0, np.flatnonzero(np.diff(blocks)) + 1, len(blocks)].tolist()
        for first, last in zip(cuts[:-1], cuts[1:]):
            if first == last:
                continue
            if held and (int(blocks[first]) != now or size > most):
                yield now, held
                held, size = [], 0
            now = int(blocks[first])
            held.append(batch.slice(first, last - first))
            size += held[-1].nbytes
    if held:
        yield now, held


def _listed(held, words: pa.Table) -> tuple[pa.Array, np.ndarray]:
    """The words of a block's dictionary, the frequent ones first, and the classes of all and of the end token."""
    frequent, of, width = held
    listed = pa.concat_arrays([pa.array(frequent, pa.binary()), *words.column("word").chunks])
    return listed, np.r_[of, words.column("class").to_numpy(), width - 1].astype(np.int64)


def _count_classes(held):
    """(code, n): how often the class code // width stands before code % width in a block's texts."""

    def run(docs: pa.Table, words: pa.Table) -> pa.Table:
        width = held.value[2]
        listed, kind = _listed(held.value, words)
        total = np.zeros(width * width, np.int64)
        for texts in pieces(docs.to_batches(), PIECE_BYTES // 2):
            found, sizes = split_words(texts)
            k = kind[with_ends(numbers(found, listed, -1), sizes, len(listed))]
            total += np.bincount(np.r_[width - 1, k[:-1]] * width + k, minlength=width * width)
        code = np.flatnonzero(total)
        return pa.table([pa.array(code), pa.array(total[code])], names=["code", "n"])

    return run


_SCORED = pa.schema([("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64()), ("perplexity", pa.float64())])


def _score_block(held):
    def run(docs: pa.Table, words: pa.Table) -> pa.Table:
        model = held.value
        known = model.known(words.column("n").to_numpy(), words.column("class").to_numpy())
        listed = pa.concat_arrays([pa.array(list(model.number), pa.binary()), *words.column("word").chunks])
        parts = [model.scores(t, listed, known) for t in pieces(docs.to_batches(), PIECE_BYTES // 2)]
        cols = [pa.array(np.concatenate([[], *(p[i] for p in parts)]).astype(f.type.to_pandas_dtype())) for i, f in enumerate(_SCORED)]
        return pa.table([docs.column("doc_id"), docs.column("held_out"), *cols], names=["doc_id", "held_out", *_SCORED.names])

    return run


class Fitted(NamedTuple):
    """A model, all rows dealt to blocks (block, doc_id, text, held_out), and each block's words (block, word, n, class)."""

    model: Model
    dealt: DataFrame
    words: DataFrame


def fit(docs: DataFrame, held: Column, block_bytes: int = BLOCK_BYTES) -> Fitted:
    """What the rows of docs(doc_id, text) where held is false teach."""
    share = docs.sparkSession.sparkContext.broadcast
    rows = docs.select("doc_id", "text", held.alias("held_out"))
    size = rows.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    blocks = size // block_bytes + 1
    place = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(blocks))
    dealt = written(rows.withColumn("block", place).repartition(blocks, "block").sortWithinPartitions("block"))
    training = dealt.where(~F.col("held_out"))
    counts = written(word_counts(training))
    c = learn(training, counts)
    listed = dealt.select("block", "text").mapInArrow(_distinct_words(share(c.frequent)), "block bigint, word binary")
    known = listed.join(c.others, "word", "left").select("block", "word", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("class", F.lit(c.width - 2)).alias("class"))
    known = written(known)
    found = training.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(_count_classes(share((c.frequent, c.of, c.width))), "code bigint, n bigint")
    pairs = np.zeros(c.width * c.width)
    for r in written(found.groupBy("code").agg(F.sum("n").alias("n"))).collect():  # at most width ** 2 rows
        pairs[r["code"]] = r["n"]
    pairs = pairs.reshape(c.width, c.width)
    return Fitted(Model(c.frequent, c.counts, c.of, pairs, pairs.sum(0), c.n, c.distinct, c.ends), dealt, known)


def score(docs: DataFrame, held: Column, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity) of docs(doc_id, text), learnt from the rows where held is false."""
    model, dealt, known = fit(docs, held, block_bytes)
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double, perplexity double"
    shared = docs.sparkSession.sparkContext.broadcast(model)
    scored = dealt.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(_score_block(shared), schema)
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(model.n).cast("long").alias("train_tokens"), "base_score", "score", "perplexity")


def score_corpus(docs: DataFrame, folds: int = 10) -> DataFrame:
    return score(only(docs, "doc_id", "text"), held_out(F.col("doc_id"), folds))
