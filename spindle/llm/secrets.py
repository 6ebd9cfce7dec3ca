"""Secret scans through a trigram inverted index.

Each rule's regular expression is turned into a Boolean query over trigrams of ASCII-lower-cased text: a conjunction of
clauses, each a set of alternative trigram conjunctions. A block of texts is indexed (trigram -> sorted numbers of the
texts that hold it) for the trigrams that some rule asks for; postings are intersected and united as the query says, and
only the candidates are verified with the expression itself. A rule whose query says nothing, such as a long run of
hexadecimal digits, scans every text. Blocks are Arrow batches, so postings never leave their task.

Matches are leftmost and do not overlap within a kind; those whose measured group is too short are dropped. Offsets are
code points, the end exclusive.

Defined results: a null text counts as empty and has no spans; repeated rows are scanned each; ties of start go by the
order of the rules; an empty table gives no rows; extra columns are ignored by scan and kept by redact.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import product
from re import _constants as S
from re import _parser

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, only
from .texts import with_text_columns


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    least: int = 0
    group: int = 0
    fold: bool = False


# The three base rules, in the order in which ties of start are listed.
BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2, True),
    Rule("access", r"AKIA[A-Z0-9]+", 20),
    Rule("hex", r"[0-9a-f]+", 24),
)
#: Formats that issuers publish.
MORE = (
    Rule("private_key", r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("hub", r"hf_[A-Za-z0-9]{20,}"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{4,}"),
)
RULES = BASE + MORE

#: Characters of a class that are spelt out, and strings of a run; beyond either nothing is required there.
CLASS_MOST, RUN_MOST = 8, 64
Clause = frozenset[frozenset[str]]


def _strings(items: list, fold: bool) -> set[str] | None:
    """All strings that this part matches, in lower case, or None where they are too many to list."""
    out = {""}
    for op, arg in items:
        if op is S.LITERAL:
            part = {chr(arg).lower()} if arg < 128 else None
        elif op is S.IN:
            part = _of_class(arg)
        elif op is S.SUBPATTERN:
            part = _strings(arg[3], fold)
        elif op is S.BRANCH:
            each = [_strings(b, fold) for b in arg[1]]
            part = None if None in each else set().union(*each)
        elif op in (S.MAX_REPEAT, S.MIN_REPEAT) and arg[1] is not S.MAXREPEAT and arg[1] <= 4:
            one = _strings(arg[2], fold)
            part = None if one is None else {"".join(p) for n in range(arg[0], arg[1] + 1) for p in product(one, repeat=n)}
        else:
            part = None
        if part is None:
            return None
        out = {a + b for a in out for b in part}
        if len(out) > RUN_MOST:
            return None
    return out


def _of_class(items: list) -> set[str] | None:
    chars: set[str] = set()
    for op, arg in items:
        if op is S.LITERAL and arg < 128:
            chars.add(chr(arg).lower())
        elif op is S.RANGE and arg[1] < 128:
            chars |= {chr(c).lower() for c in range(arg[0], arg[1] + 1)}
        else:
            return None
        if len(chars) > CLASS_MOST:
            return None
    return chars


def _clause(strings: set[str]) -> Clause | None:
    """The text holds all trigrams of one of the strings; None if some string is too short to say anything."""
    if min(map(len, strings)) < 3:
        return None
    sets = {frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings}
    return frozenset(a for a in sets if not any(b < a for b in sets))


def trigram_query(pattern: str, fold: bool = False) -> list[Clause]:
    """Clauses that must all hold in any text with a match; an empty list means that every text must be scanned."""
    return _conjunction(list(_parser.parse(pattern)), fold)


def _conjunction(items: list, fold: bool) -> list[Clause]:
    clauses, run = [], {""}

    def close() -> None:
        nonlocal run
        if (c := _clause(run)) is not None:
            clauses.append(c)
        run = {""}

    for item in items:
        part = _strings([item], fold)
        joined = {a + b for a in run for b in part} if part is not None else None
        if joined is not None and len(joined) <= RUN_MOST:
            run = joined
            continue
        close()
        op, arg = item
        if part is not None:
            run = part
        elif op is S.SUBPATTERN:
            clauses += _conjunction(list(arg[3]), fold)
        elif op in (S.MAX_REPEAT, S.MIN_REPEAT) and arg[0] > 0:
            clauses += _conjunction(list(arg[2]), fold)
        elif op is S.BRANCH:
            each = [_conjunction(list(b), fold) for b in arg[1]]
            if all(each):  # one clause of each branch: any of them must hold
                clauses.append(frozenset().union(*(min(e, key=len) for e in each)))
    close()
    return clauses


class Index:
    """Posting lists of a block of texts for a fixed set of trigrams."""

    def __init__(self, wanted: list[str]) -> None:
        self.number = {t: i for i, t in enumerate(wanted)}
        self.table = np.full(1 << 24, -1, np.int16)
        for t, i in self.number.items():
            a, b, c = t.encode("ascii")
            self.table[a << 16 | b << 8 | c] = i

    def build(self, texts: list[bytes]) -> dict[int, np.ndarray]:
        """trigram number -> sorted numbers of texts. Texts are taken a megabyte or so at a time."""
        found = []
        first = 0
        while first < len(texts):
            last, size = first, 0
            while last < len(texts) and (size < 1 << 20 or last == first):
                size += len(texts[last]) + 2
                last += 1
            data = np.frombuffer(b"\0\0".join(texts[first:last]) + b"\0\0", np.uint8).astype(np.int32)
            code = (data[:-2] << 16) | (data[1:-1] << 8) | data[2:]
            ids = self.table[code]
            at = np.flatnonzero(ids >= 0)
            ends = np.cumsum([len(t) + 2 for t in texts[first:last]])
            found.append((ids[at].astype(np.int64) << 32) | (first + np.searchsorted(ends, at, "right")))
            first = last
        pairs = np.unique(np.concatenate(found)) if found else np.empty(0, np.int64)
        keys, docs = pairs >> 32, pairs & 0xFFFFFFFF
        cuts = np.searchsorted(keys, np.arange(len(self.number) + 1))
        return {i: docs[cuts[i] : cuts[i + 1]] for i in range(len(self.number))}


class Scanner:
    def __init__(self, rules: tuple[Rule, ...]) -> None:
        self.rules = rules
        self.compiled = [re.compile(r.pattern, re.ASCII | (re.IGNORECASE if r.fold else 0)) for r in rules]
        # A run of one class with a least length is the same run spelt with that length, which fails faster.
        self.compiled = [re.compile(f"{r.pattern[:-1]}{{{r.least},}}", re.ASCII) if re.fullmatch(r"\[[^]]+\]\+", r.pattern) else c for r, c in zip(rules, self.compiled)]
        self.queries = [trigram_query(r.pattern, r.fold) for r in rules]
        self.index = Index(sorted({t for q in self.queries for c in q for a in c for t in a}))

    def candidates(self, query: list[Clause], postings: dict[int, np.ndarray], n: int) -> np.ndarray:
        out = None
        for clause in query:
            any_of = np.empty(0, np.int64)
            for alternative in clause:
                lists = sorted((postings[self.index.number[t]] for t in alternative), key=len)
                all_of = lists[0]
                for x in lists[1:]:
                    all_of = np.intersect1d(all_of, x, assume_unique=True)
                any_of = np.union1d(any_of, all_of)
            out = any_of if out is None else np.intersect1d(out, any_of, assume_unique=True)
        return np.arange(n) if out is None else out

    def scan(self, texts: list[str | None]) -> list[list[tuple[int, int, int]]]:
        """For each text its (start, rule number, end), sorted."""
        texts = [t or "" for t in texts]
        postings = self.index.build([t.encode("utf-8", "surrogatepass").lower() for t in texts])
        spans: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        for k, (rule, match, query) in enumerate(zip(self.rules, self.compiled, self.queries)):
            for i in self.candidates(query, postings, len(texts)).tolist():
                spans[i] += [(m.start(), k, m.end()) for m in match.finditer(texts[i]) if m.end(rule.group) - m.start(rule.group) >= rule.least]
        for s in spans:
            s.sort()
        return spans


SPAN = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(doc_id, found): found is an array of (kind, start, end), by start and then by the order of the rules."""

    def start():
        scanner = Scanner(rules)
        return lambda texts: [[[{"kind": rules[k].kind, "start": a, "end": b} for a, k, b in s] for s in scanner.scan(texts)]]

    return with_text_columns(only(docs, "doc_id", "text"), [T.StructField("found", SPAN)], start).drop("text")


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """docs with every span of text replaced by the kind in brackets; spans that overlap become one."""

    def start():
        scanner = Scanner(rules)

        def cleaned(texts: list[str | None]) -> list[list[str | None]]:
            out = []
            for text, spans in zip(texts, scanner.scan(texts)):
                parts, at = [], 0
                for a, k, b in spans:
                    if a >= at:
                        parts += [text[at:a], f"[{rules[k].kind}]"]
                    at = max(at, b)
                out.append("".join([*parts, text[at:]]) if spans else text)
            return [out]

        return cleaned

    new = fresh("_redacted", docs)
    with_new = with_text_columns(docs, [T.StructField(new, T.StringType())], start)
    return with_new.select(*(F.col(new).alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns))
