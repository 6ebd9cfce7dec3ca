"""Extra columns that are called like anything the operators name inside: results stay as they are, and rows pass through whole."""

import inspect
import re

import pytest
from pyspark.sql import functions as F

from spindle.llm import common, decontam, fim, langid, lm, mixing, neardup, negatives, repeats, secrets, texts, tokens, topk, urls, warc

public_tokenizers = pytest.importorskip("public_tokenizers")
MODULES = (common, decontam, fim, langid, lm, mixing, neardup, negatives, repeats, secrets, texts, tokens, topk, urls, warc)
#: Every name in quotes in the modules' code, and as fresh() spells it where that is taken.
INSIDE = sorted({n for m in MODULES for n in re.findall(r"[\"'](_?[a-z][a-z0-9_]*)[\"']", inspect.getsource(m))} | {n for m in MODULES for n in re.findall(r"\b([a-z][a-z0-9_]*) (?:long|bigint|string|binary|boolean|double)\b", inspect.getsource(m))})
NAMES = [*INSIDE, *(f"_{n}" for n in INSIDE if not n.startswith("_"))]

SAID = "the quick brown fox jumps over the lazy dog while token=abcdef123456 stays"
TEXTS = [SAID, SAID, SAID + " here", "der schnelle braune Fuchs und der faule Hund und die Katze sind nicht hier", None, "", "12 34"]


def crowded(df, *results):
    taken = {c.lower() for c in (*df.columns, *results)}
    return df.withColumns({n: F.lit("clash") for n in NAMES if n not in taken})


def documents(spark):
    rows = [(i, t, "de" if (t or "").startswith("der") else "en", "ab"[i % 2], 0) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(2)


def pages(spark):
    return spark.createDataFrame([(1, "http://a.net/x", "p"), (2, "http://b.org/fr/", "p"), (3, None, None)], "page_id long, url string, html string").coalesce(1)


def vectors(spark):
    return spark.createDataFrame([(i, [float(i % 3), 0.5]) for i in range(9)], "vec_id long, embedding array<double>").coalesce(1)


def rules(spark):
    return spark.createDataFrame([("net", "/", "block")], "host string, path string, verdict string")


def items(spark):
    return spark.createDataFrame([(7, SAID + " here")], "item_id long, text string")


#: Operators that give columns of their own.
OWN = {
    "count_tokens": (documents, lambda d: tokens.count_tokens(d, public_tokenizers.path("word_bpe_49k.json"))),
    "scan": (documents, secrets.scan),
    "round_trip": (pages, warc.round_trip),
    "score_corpus": (documents, lm.score_corpus),
    "search": (vectors, lambda v: topk.search(v, v.where("vec_id % 4 = 0"), 2)),
    "find": (documents, lambda d: decontam.find(d, crowded(items(d.sparkSession)))),
    "judge": (pages, lambda p: urls.judge(p, crowded(rules(p.sparkSession)))),
    "join": (documents, neardup.join),
    "transform": (documents, fim.transform),
    "remove": (documents, lambda d: repeats.remove(d, 3)),
    "mine": (lambda s: vectors(s).withColumn("label", F.col("vec_id") % 2), lambda v: negatives.mine(v, v.where("vec_id % 4 = 0"), 2)),
}
#: Operators that pass rows through, with the columns that they replace.
THROUGH = {
    "identify": (lambda d: langid.identify(d, crowded(d)), ("lang_pred", "score", "rejected")),
    "recognised": (lambda d: langid.recognised(d, crowded(d)), ()),
    "distinct": (neardup.distinct, ()),
    "clean": (lambda d: decontam.clean(d, crowded(items(d.sparkSession))), ()),
    "redact": (secrets.redact, ()),
    "mix": (mixing.mix, ("copy",)),
}


def rows_of(df, columns):
    return sorted((str([r[c] for c in columns]) for r in df.collect()))


@pytest.mark.parametrize("name", OWN)
def test_own_columns(spark, name):
    make, operator = OWN[name]
    plain = operator(make(spark))
    got = operator(crowded(make(spark)))
    assert got.columns == plain.columns
    rounded = [c for c, kind in plain.dtypes if kind != "double"]
    assert rows_of(got, rounded) == rows_of(plain, rounded) != []


@pytest.mark.parametrize("name", THROUGH)
def test_rows_pass_through(spark, name):
    operator, replaced = THROUGH[name]
    df = crowded(documents(spark))
    got = operator(df)
    assert {*got.columns} == {*df.columns, *replaced}
    plain = operator(documents(spark))
    assert rows_of(got, plain.columns) == rows_of(plain, plain.columns) != []
    kept = [c for c in df.columns if c in NAMES and c not in plain.columns]
    assert len(kept) > 50 and all(r[c] == "clash" for r in got.collect() for c in kept)


def test_decide_names_the_clash(spark):
    with pytest.raises(ValueError, match="source_size"):
        mixing.decide(crowded(documents(spark)))
    names = ("x1", "x2", "x3", "x4")
    got = mixing.decide(crowded(documents(spark)), names)
    assert rows_of(got, names) == rows_of(mixing.decide(documents(spark)), ("size", "source_size", "target", "copies"))
