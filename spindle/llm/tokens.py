"""Token counts by byte-pair merging with a heap and a linked list.

A word's symbols form a doubly linked list; a heap holds its mergeable adjacent pairs by (rank, place). The lowest is
popped, skipped if one of its symbols has changed since, else merged; new neighbours are pushed. The number of tokens
is the number of initial symbols less the merges made, so identifiers are never looked up. A word of n symbols costs
O(n log n), so that a text without any space is no special case. Counts of short words are remembered in each task, up
to a fixed number of words.

Defined results: a null text counts as empty (0 tokens); strings of added special tokens inside a text count one each;
repeated rows are counted each; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
import uuid

import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import only
from .texts import with_text_columns

#: Words remembered by a task, and the longest of them.
MEMO_WORDS, MEMO_LENGTH = 400_000, 40


def merges(symbols: list[str], ranks: dict[tuple[str, str], int]) -> int:
    """The number of merges that byte-pair encoding makes on these symbols."""
    n = len(symbols)
    if n < 2:
        return 0
    alive = list(symbols)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, i, symbols[i], symbols[i + 1]) for i in range(n - 1) if (r := ranks.get((symbols[i], symbols[i + 1]))) is not None]
    heapq.heapify(heap)
    made = 0
    while heap:
        _, i, left, right = heapq.heappop(heap)
        j = after[i]
        if alive[i] != left or j >= n or alive[j] != right:
            continue
        made += 1
        alive[i], alive[j] = left + right, ""
        after[i] = k = after[j]
        if k < n:
            before[k] = i
            if (r := ranks.get((alive[i], alive[k]))) is not None:
                heapq.heappush(heap, (r, i, alive[i], alive[k]))
        h = before[i]
        if h >= 0 and (r := ranks.get((alive[h], alive[i]))) is not None:
            heapq.heappush(heap, (r, h, alive[h], alive[i]))
    return made


def byte_symbols() -> list[str]:
    """The printable character that byte-level vocabularies use for each byte: printable Latin-1 bytes stand for themselves."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(spare)) for b in range(256)]


class WordCounts(dict):
    """word -> tokens; counts what is missing and remembers it while there is room."""

    def __init__(self, ranks: dict, suffix: str) -> None:
        super().__init__()
        self.ranks, self.suffix, self.of_byte = ranks, suffix, byte_symbols()

    def __missing__(self, word: str) -> int:
        symbols = [self.of_byte[b] for b in word.encode("utf-8", "surrogatepass")]
        symbols[-1] += self.suffix
        n = len(symbols) - merges(symbols, self.ranks)
        if len(word) <= MEMO_LENGTH:
            if len(self) >= MEMO_WORDS:
                self.clear()
            self[word] = n
        return n


class Counter:
    """Counts tokens as the tokenizers library does for a word-end BPE file: NFC, lower case, split by pattern, byte-level BPE."""

    def __init__(self, spec: dict) -> None:
        model = spec["model"]
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        self.words = WordCounts({(a, b): i for i, (a, b) in enumerate(pairs)}, model["end_of_word_suffix"] or "")
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pattern = regex.compile(split["pattern"]["Regex"])
        special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        parts = self.special.split(text) if self.special else [text]
        total = len(parts) - 1
        for part in parts:
            # Character-wise lower case: a final capital sigma is not treated apart.
            low = unicodedata.normalize("NFC", part).replace("Σ", "σ").lower()
            total += sum(map(self.words.__getitem__, self.pattern.findall(low)))
        return total


def count_tokens(docs: DataFrame, vocabulary: str, limit: int = 2048) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for every row of docs(doc_id, text).

    vocabulary is the path of the tokenizer file on the driver; its bounded contents (one public file) are broadcast.
    """
    with open(vocabulary, encoding="utf-8") as f:
        spec = json.load(f)
    spec["model"].pop("vocab", None)
    spec["_key"] = uuid.uuid4().hex
    held = docs.sparkSession.sparkContext.broadcast(spec)

    def start():
        counter = _counter(held)
        return lambda texts: [list(map(counter.count, texts))]

    counted = with_text_columns(only(docs, "doc_id", "text"), [T.StructField("n_tokens", T.LongType())], start)
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    return counted.select("doc_id", size.alias("n_bytes"), "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


_counters: dict[str, Counter] = {}


def _counter(held) -> Counter:
    """One counter, with its memory of words, for all tasks of a Python worker."""
    spec = held.value
    key = spec["_key"]
    if key not in _counters:
        _counters.clear()
        _counters[key] = Counter(spec)
    return _counters[key]
