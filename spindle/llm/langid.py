"""Language identification by compression with per-language zstandard dictionaries.

The labelled texts are cut into spans, and a bounded sample of spans, chosen by hash, makes the raw-content dictionary of
each language, in lower case. A text is cut into pieces of bounded length, every piece is compressed with every
dictionary, and the language with the smallest total wins; all of the text takes part, and a text of any length is judged
alike. Equal totals go to the language with more labelled rows. A text is rejected when the smallest total is not enough
below the second (a narrow margin), or when it has no letters.

Bounded sample: SPANS spans of SPAN characters a language, TOTAL over all languages (one span of each at least); any part
of any labelled text may be chosen, and no language is left out. The dictionaries are broadcast, at most SPAN * 4 bytes
for each span.

Defined results: a null text, or one without letters, is ``und`` with score 0 and rejected; with no labelled row every
text is ``und``; repeated rows are judged alike, and equal spans of repeated rows are chosen in any order, being equal; a
null doc_id counts as the empty string when rows are held out; very long texts are judged whole; extra columns are kept
by identify, but for those with the names of new ones, which it replaces; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import regex
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, only
from .texts import with_text_columns

SPANS, SPAN, TOTAL = 256, 750, 65_536
PIECE, LEVEL = 4096, 3
#: Least difference between the two smallest totals, in bytes and as a part of the second.
MARGIN_BYTES, MARGIN_PART = 1, 0.002
LETTER = regex.compile(r"\p{L}")


def held_out(doc_id: Column, folds: int) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds == 0


def learn(labelled: DataFrame) -> list[tuple[str, bytes]]:
    """(language, dictionary) from labelled(doc_id, text, lang), the language with most rows first."""
    rows = only(labelled, "doc_id", "text", "lang").where("text is not null and lang is not null")
    counts = rows.groupBy("lang").count().collect()  # one row a language
    counts.sort(key=lambda r: (-r["count"], r["lang"]))
    most = max(1, min(SPANS, TOTAL // max(1, len(counts))))
    spans = rows.select("lang", "doc_id", F.posexplode(F.regexp_extract_all("text", F.lit(f"(?s).{{1,{SPAN}}}"), F.lit(0))).alias("at", "span"))
    spans = spans.select("lang", "span", F.xxhash64("doc_id", "at", "span").alias("h"))
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("h", "span"))
    sample = spans.withColumn("n", nth).where(F.col("n") <= most).orderBy("lang", "n").collect()
    texts: dict[str, list[str]] = {r["lang"]: [] for r in counts}
    for r in sample:
        texts[r["lang"]].append(r["span"])
    return [(k, "\n".join(v).lower().encode("utf-8", "surrogatepass")) for k, v in texts.items()]


class Classifier:
    def __init__(self, dictionaries: list[tuple[str, bytes]]) -> None:
        self.languages = [k for k, _ in dictionaries]
        self.compress = []
        for _, content in dictionaries:
            d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=LEVEL)
            self.compress.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_dict_id=False).compress)

    def judge(self, text: str | None) -> tuple[str, float, bool]:
        """(language, score, rejected). The score is the weight of the winner if 2 ** -(bits) is spread over all languages, tempered."""
        if not text or not self.languages or not LETTER.search(text):
            return "und", 0.0, True
        data = text.lower().encode("utf-8", "surrogatepass")
        pieces = [data[i : i + PIECE] for i in range(0, len(data), PIECE)]
        totals = [sum(len(c(p)) for p in pieces) for c in self.compress]
        best = min(range(len(totals)), key=lambda i: (totals[i], i))
        second = min((t for i, t in enumerate(totals) if i != best), default=math.inf)
        score = 1.0 / sum(math.exp(max(-700.0, (totals[best] - t) / 4)) for t in totals)
        gap = second - totals[best]
        return self.languages[best], score, gap < MARGIN_BYTES or gap < MARGIN_PART * second


def identify(docs: DataFrame, labelled: DataFrame, names: Sequence[str] = ("lang_pred", "score", "rejected")) -> DataFrame:
    """docs with lang_pred, score and rejected, learnt from labelled; columns of docs that are called like these are replaced."""
    held = docs.sparkSession.sparkContext.broadcast(learn(labelled))

    def start():
        classifier = Classifier(held.value)
        return lambda texts: list(map(list, zip(*map(classifier.judge, texts)))) if texts else [[], [], []]

    fields = [T.StructField(n, k) for n, k in zip(names, (T.StringType(), T.DoubleType(), T.BooleanType()))]
    new = {n.lower() for n in names}
    return with_text_columns(only(docs, *(c for c in docs.columns if c.lower() not in new)), fields, start)


def recognised(docs: DataFrame, labelled: DataFrame) -> DataFrame:
    """docs without the rows that are rejected."""
    names = [fresh(f"_{n}", docs) for n in ("lang_pred", "score", "rejected")]
    return only(identify(docs, labelled, names).where(~F.col(names[-1])), *docs.columns)
