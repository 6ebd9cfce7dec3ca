"""Fill-in-the-middle examples: each text is cut into prefix, middle and suffix, which are put into an order that a model learns to fill.

Tokens are the isolated matches of a pattern, found by the Split pre-tokenizer of the tokenizers library, which needs no
training and gives code-point offsets. The array of a text's offsets has one entry for each token and one for the end:
its length gives n, and the offsets at two drawn ranks are where the text is cut. No token reaches over a space, so a
batch's texts are split at spaces, the library sees each distinct piece once (a task forgets all beyond MEMO of them),
and a text's offsets are those of its pieces, moved to where they stand. The library gets some PIECE code points at a
time, cut before characters that stand alone; this bounds its memory and changes no offset. So does the cutting of a text of more
than LONG code points, whose parts are counted one by one, and of which those that hold the drawn ranks are looked at again.

The draws are four unsigned 32-bit integers from the sha256 of seed, colon and doc_id. Ranks are two of them modulo
n + 1, the smaller first. A text stays plain if it is empty, holds one of the three marks, or is drawn to; of the others
spm gives <S>suffix<P>prefix<M>middle and psm <P>prefix<S>suffix<M>middle. restored() gives the text back exactly: no
mark can arise where pieces meet, because no mark ends as another begins.

Defined results: a null text is empty; a null doc_id counts as the empty string in the draw; rows of equal ids draw the
same numbers, each for its own text; a text of one token is cut before or after it; whole texts of any length are
taken; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import only

PATTERN, PREFIX, SUFFIX, MIDDLE = "[A-Za-z]+|[^A-Za-z]", "<P>", "<S>", "<M>"
#: Shares in percent: of all texts that stay plain, and of the others that become spm.
PLAIN, SPM = 10, 20
MEMO, PIECE = 400_000, 1 << 16
#: Bytes of texts, and code points of one text, whose offsets are held at once.
BYTES, LONG = 4_000_000, 4_000_000
_ALONE = re.compile("[^A-Za-z]")


def parts(text: str, most: int) -> Iterator[tuple[int, str]]:
    """(start, part) of a text cut before characters that stand alone, after most code points or as soon as there is one."""
    first = 0
    while first < len(text):
        cut = _ALONE.search(text, first + most) if len(text) - first > most else None
        last = cut.start() if cut else len(text)
        yield first, text[first:last]
        first = last


class Splitter:
    """Offsets of the tokens of texts; those of pieces between spaces are remembered."""

    def __init__(self) -> None:
        from tokenizers import Regex
        from tokenizers.pre_tokenizers import Split

        self.split = Split(Regex(PATTERN), behavior="isolated").pre_tokenize_str
        self.forget()

    def forget(self) -> None:
        self.memo: dict[str, int] = {}
        #: The offsets of remembered pieces one after another, and where those of each begin.
        self.flat, self.begins = np.empty(0, np.int64), np.zeros(1, np.int64)

    def starts(self, text: str) -> np.ndarray:
        """Where each token of a text starts."""
        found = [first + np.array([a for _, (a, _) in self.split(part)], np.int64) for first, part in parts(text, PIECE)]
        return np.concatenate([np.empty(0, np.int64), *found])

    def learn(self, pieces: list[str]) -> None:
        """Remember the offsets of new pieces: where each token starts, and where the piece ends."""
        joined = " ".join(pieces)
        places = np.r_[self.starts(joined), len(joined)]
        ends = np.cumsum([len(p) + 1 for p in pieces]) - 1  # where the spaces between them stand
        sizes = np.diff(np.searchsorted(places, np.r_[-1, ends], "right"))
        moved = places - np.repeat(np.r_[0, ends[:-1] + 1], sizes)
        self.memo.update(zip(pieces, range(len(self.memo), len(self.memo) + len(pieces))))
        self.flat, self.begins = np.concatenate([self.flat, moved]), np.r_[self.begins, len(self.flat) + np.cumsum(sizes)]

    def all_offsets(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The offsets of all texts one after another, and where each text's begin; an offset is a token's start or the text's end."""
        lists = pc.split_pattern(texts, " ")
        ends = lists.offsets.to_numpy().astype(np.int64)
        coded = lists.flatten().dictionary_encode()
        pieces = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        if new := [p for p in pieces if p not in self.memo]:
            if len(self.memo) > MEMO:
                self.forget()
                new = pieces
            self.learn(new)
        which = np.array([self.memo[p] for p in pieces], np.int64)[coded.indices.to_numpy()]
        sizes = np.diff(self.begins)[which]
        own = np.repeat(self.begins[which] - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))
        # A piece's last offset is its end: there the space stands, which is a token too, or the text ends.
        length = self.flat[self.begins[which + 1] - 1] + 1
        before = np.r_[0, np.cumsum(length)]
        stands = before[:-1] - np.repeat(before[ends[:-1]], np.diff(ends))
        return self.flat[own] + np.repeat(stands, sizes), np.r_[0, np.cumsum(sizes)][ends]


    def of_long(self, text: str, most: int) -> tuple[int, Callable[[int], int]]:
        """(n, the offset at a rank from 0 to n) of a text, of which no more than a part is held at once."""
        sizes = [len(self.all_offsets(pa.array([part]))[0]) - 1 for _, part in parts(text, most)]
        upto = np.cumsum(sizes)

        def offset(rank: int) -> int:
            if rank == upto[-1]:
                return len(text)
            i = int(np.searchsorted(upto, rank, "right"))
            first, part = next(islice(parts(text, most), i, None))
            return first + int(self.all_offsets(pa.array([part]))[0][rank - upto[i] + sizes[i]])

        return int(upto[-1]), offset


def draws(seed: str, doc_id: str) -> list[int]:
    digest = hashlib.sha256(f"{seed}:{doc_id}".encode()).hexdigest()
    return [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]


def arranged(text: str, doc_id: str, n: int, offset: Callable[[int], int], seed: str) -> tuple[int, str, int | None, int | None, str]:
    """(n, form, code points of the prefix, of the middle, the output) of a text of n tokens; offset tells where each rank starts, and for n where the text ends."""
    a, b, plain, spm = draws(seed, doc_id)
    if not text or plain % 100 >= 100 - PLAIN or any(m in text for m in (PREFIX, SUFFIX, MIDDLE)):
        return n, "plain", None, None, text
    first, last = map(offset, sorted((a % (n + 1), b % (n + 1))))
    prefix, middle, suffix = text[:first], text[first:last], text[last:]
    if spm % 100 < SPM:
        return n, "spm", first, last - first, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return n, "psm", first, last - first, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def _slices(batch: pa.RecordBatch, most: int) -> Iterator[pa.RecordBatch]:
    """batch in slices of most bytes of texts at most; a longer text stands alone."""
    ends = np.r_[0, np.cumsum(pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False).astype(np.int64) + 8)]
    first = 0
    while first < batch.num_rows:
        upto = max(first + 1, int(np.searchsorted(ends, ends[first] + most, "right")) - 1)
        yield batch.slice(first, upto - first)
        first = upto


def transform(docs: DataFrame, seed: str = "1", long: int = LONG) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) of docs(doc_id, text). prefix_chars and middle_chars are null where form is plain."""
    rows = only(docs, "doc_id", "text").select("doc_id", F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter = Splitter()
        for batch in (b for whole in batches for b in _slices(whole, BYTES)):
            texts, ids = pa.concat_arrays([batch.column("text")]), batch.column("id").to_pylist()  # without the rows that were sliced off
            made = []
            if batch.num_rows == 1 and len(text := texts[0].as_py()) > long:
                made.append(arranged(text, ids[0], *splitter.of_long(text, long), seed))
            else:
                flat, at = splitter.all_offsets(texts)
                for text, doc_id, a, b in zip(texts.to_pylist(), ids, at[:-1].tolist(), at[1:].tolist()):
                    made.append(arranged(text, doc_id, b - a - 1, lambda rank, a=a: int(flat[a + rank]), seed))
            n, form, prefix, middle, output = zip(*made)
            cols = [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(form), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), pa.array(output)]
            yield pa.RecordBatch.from_arrays(cols, names)

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string")


def restored(output: Column, form: Column) -> Column:
    """The text of which transform() made the output."""
    inner = F.substring(output, len(PREFIX) + 1, 2**31 - 1)
    psm, spm = F.split(inner, f"{SUFFIX}|{MIDDLE}"), F.split(inner, f"{PREFIX}|{MIDDLE}")  # prefix, suffix, middle; suffix, prefix, middle
    return F.when(form == "plain", output).when(form == "psm", F.concat(psm[0], psm[2], psm[1])).otherwise(F.concat(spm[1], spm[2], spm[0]))
