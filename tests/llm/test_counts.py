"""Token counts, secret scans, mixing, URL filters and language ID."""

import hashlib
import json
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from spindle.llm import langid, mixing, secrets, tokens, urls

public_tokenizers = pytest.importorskip("public_tokenizers")
VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def docs(spark, *texts, extra=False):
    df = spark.createDataFrame([(i, t, None if t is None else "en", "s", 1) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    return df.withColumns({c: F.lit("clash") for c in ("n_tokens", "size", "found", "score", "fp", "block")}) if extra else df


def test_token_counts_equal_the_library(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(VOCABULARY)
    counter = tokens.Counter(json.load(open(VOCABULARY)))
    rng = random.Random(5)
    alphabet = "abcXYZ ÀßΣσςİıǅſ0123٣²½'’\"<|>\x00\x1c\x85\xa0\u200b\u3000\n\té́中文한🙂-_."
    texts = ["".join(rng.choices(alphabet, k=rng.randrange(60))) for _ in range(4000)]
    texts += ["a<|endoftext|>b <|startoftext|><|ENDOFTEXT|>", "x" * 20_000, " ", "It's we've", "the " * 3000]
    assert [counter.count(t) for t in texts] == [len(library.encode(t, add_special_tokens=False).ids) for t in texts]
    got = tokens.count_tokens(docs(spark, None, "", "Hello, world", "Hello, world", "y " * 2049, extra=True), VOCABULARY).orderBy("doc_id").collect()
    assert [(r.n_bytes, r.n_tokens, r.over_limit) for r in got] == [(0, 0, False), (0, 0, False), (12, 3, False), (12, 3, False), (4098, 2049, True)]
    assert tokens.count_tokens(docs(spark, "a").limit(0), VOCABULARY).count() == 0


def test_merges_ties_and_overlaps():
    ranks = {("a", "a"): 0, ("aa", "aa"): 1, ("b", "aa"): 2}
    assert tokens.merges(list("aaaa"), ranks) == 3
    assert tokens.merges(list("aaa"), ranks) == 1
    assert tokens.merges(list("baa"), ranks) == 2
    assert tokens.merges([], ranks) == tokens.merges(["a"], ranks) == 0


SECRET_TEXTS = [
    None, "", "nothing here", "Token: abcdef", "password = \"b7db7aa4a5fcc78305\" and", "token=token : abcdefgh", "token=abc", "AKIA" + "A1" * 8, "AKIA123", "deadbeef" * 3, "deadbeef" * 2, "é" * 3 + "api_key='x/y+z=.-_1'",
    "APIKEY:secret=abcdefghij", "ghp_" + "a" * 36, "-----BEGIN RSA PRIVATE KEY-----", "ſecret=abcdefg", "x" * 100_000 + " secret: " + "0f" * 12, "secret:" + " " * 9 + "=longenough", "passwd==abcdefgh",
]


def plain_spans(text):
    text, out = text or "", []
    for k, rule in enumerate(secrets.RULES):
        for m in re.finditer(rule.pattern, text, re.A | (re.I if rule.fold else 0)):
            if len(m[rule.group]) >= rule.least:
                out.append((m.start(), k, m.end()))
    return [(secrets.RULES[k].kind, a, b) for a, k, b in sorted(out)]


def test_secret_scan_equals_brute_force(spark):
    rng = random.Random(3)
    pieces = ["token", "secret", "Passwd", "api", "key", "_", "=", ":", " ", '"', "abcdef", "AKIA", "Z9" * 9, "0a" * 7, "é", "hf_", "x" * 25, "."]
    texts = SECRET_TEXTS + ["".join(rng.choices(pieces, k=rng.randrange(14))) for _ in range(1500)]
    got = [[tuple(s) for s in r.found] for r in secrets.scan(docs(spark, *texts, extra=True)).orderBy("doc_id").collect()]
    assert got == [plain_spans(t) for t in texts]
    assert secrets.scan(docs(spark, "a").limit(0)).count() == 0


def test_trigram_queries():
    assert secrets.trigram_query("[0-9a-f]+") == []
    assert secrets.trigram_query(r"AKIA[A-Z0-9]+") == [frozenset({frozenset({"aki", "kia"})})]
    (clause,) = secrets.trigram_query("(cat|door)s?x*", True)
    assert clause == frozenset({frozenset({"cat"}), frozenset({"doo", "oor"})})
    for rule in secrets.RULES:
        if rule.kind != "hex":
            assert secrets.trigram_query(rule.pattern, rule.fold)


def test_redaction(spark):
    got = [r.text for r in secrets.redact(docs(spark, None, "a token=abcdef0123456789abcdef0123 b", "clean")).orderBy("doc_id").collect()]
    assert got == [None, "a [assign] b", "clean"]


def test_mixing(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(["w"] * rng.randrange(1, 60)), rng.choice(["a"] * 8 + ["b"] * 8 + ["c", None])) for i in range(4000)] + [(None, "x y", "a"), (1, None, "zero"), (7, "dup dup", "b"), (7, "dup dup", "b")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("Size", F.lit("clash"))
    with pytest.raises(ValueError, match="other names"):
        mixing.decide(df)
    got = mixing.decide(df, ("_size", "_source_size", "_target", "_copies")).collect()
    assert [r.Size for r in got] == ["clash"] * len(rows)
    sizes, target, taken = Counter(), {}, Counter()
    for r in got:
        assert r._size == len((r.text or "").split()) and 0 <= r._copies <= 2
        sizes[r.source] += r._size
        taken[r.source] += r._copies * r._size
        target[r.source] = (r._source_size, r._target)
    total, order = sum(sizes.values()), ["a", "b", "c", "zero", None]
    weight = dict(zip(order, (5, 2, 1, 5, 2)))
    want, capped = {}, set()
    while True:  # plain water filling
        level = (1.5 * total - sum(2 * sizes[s] for s in capped)) / sum(weight[s] for s in order if s not in capped)
        want = {s: 2 * sizes[s] if s in capped else level * weight[s] for s in order}
        over = {s for s in order if want[s] > 2 * sizes[s]}
        if not over:
            break
        capped |= over
    for s in order:
        assert target[s] == (sizes[s], pytest.approx(want[s]))
        assert abs(taken[s] - want[s]) <= 0.01 * max(sizes[s], 1)
    assert sum(want.values()) == pytest.approx(1.5 * total)
    again = {(r.doc_id, r.text, r.source): r.copies for r in mixing.decide(df.drop("Size").repartition(7)).collect()}
    assert all(again[r.doc_id, r.text, r.source] == r._copies for r in got)
    mixed = mixing.mix(df)
    assert mixed.columns == ["doc_id", "text", "source", "Size", "copy"]
    assert mixed.count() == sum(r._copies for r in got)
    assert mixing.mix(df.limit(0)).count() == 0


def test_sources_of_few_documents_come_near_their_targets(spark):
    """Documents of very different sizes; one seed alone misses by far."""
    rng = random.Random(4)
    rows = [(i, "w " * int(10 ** rng.uniform(0.5, 3.5)), f"s{i % 20:02}") for i in range(800)] + [(900, "one document", "z")]
    got = mixing.decide(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    taken, target, once = Counter(), {}, Counter()
    for r in got:
        taken[r.source] += r.copies * r.size
        target[r.source] = r.target
        rate = r.target / r.source_size
        number = int(hashlib.md5(f"7:{r.doc_id}:{r.text}".encode()).hexdigest()[:13], 16) / 16**13
        once[r.source] += r.size * (int(rate) + (number < rate % 1))
        assert int(rate) <= r.copies <= int(rate) + 1
    missed = {s: abs(taken[s] / target[s] - 1) for s in target if s != "z"}
    assert max(missed.values()) < 0.05 < max(abs(once[s] / target[s] - 1) for s in missed)


def test_mixing_beyond_the_broadcast_bound(spark, monkeypatch):
    df = spark.range(900).select(F.col("id").alias("doc_id"), F.lit("a b").alias("text"), (F.col("id") % 90).cast("string").alias("source"))
    key = lambda rows: sorted((r.doc_id, r.target, r.copies) for r in rows)
    few = key(mixing.decide(df).collect())
    monkeypatch.setattr("spindle.llm.common.BROADCAST_BYTES", 1)
    assert key(mixing.decide(df).collect()) == few


def test_urls(spark):
    rules = spark.createDataFrame([("net", "/", "block"), ("Example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"), ("org", "/fr/", "allow"), (None, "/", "block")], "host string, path string, verdict string")
    cases = {
        "http://A.Example.NET/en/x?q": ("a.example.net", "/en/x", "example.net/en/", "allow"),
        "http://example.net/e": ("example.net", "/e", "net/", "block"),
        "http://example.net": ("example.net", "", None, "allow"),
        "http://badexample.net/en/": ("badexample.net", "/en/", "net/", "block"),
        "https://x.example.com/de/#f": ("x.example.com", "/de/", "example.com/de/", "block"),
        "https://x.example.com/de": ("x.example.com", "/de", None, "allow"),
        "https://example.org/fr/1?/de/": ("example.org", "/fr/1", "org/fr/", "allow"),
        "no scheme": ("", "", None, "allow"), None: ("", "", None, "allow"), "": ("", "", None, "allow"), "a://b://net/": ("b:", "//net/", None, "allow"),
        "http://net:80/": ("net:80", "/", None, "allow"), "http://" + "a." * 3000 + "net/" + "p" * 5000: ("a." * 3000 + "net", "/" + "p" * 5000, "net/", "block"),
    }
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate([*cases, "http://example.net/e"])], "page_id long, url string, rule string")
    got = urls.judge(pages, rules).orderBy("page_id").collect()
    assert [tuple(r)[1:] for r in got] == [*cases.values(), cases["http://example.net/e"]]
    assert urls.judge(pages.limit(0), rules).count() == 0
    assert {r.verdict for r in urls.judge(pages, rules.limit(0), "block").collect()} == {"block"}


def test_many_listed_urls(spark, monkeypatch):
    rng = random.Random(8)
    listed = {(f"h{i}.com", f"/{'ab'[i % 2]}/") for i in range(3000)}
    rules = spark.createDataFrame([(h, p, "block") for h, p in listed], "host string, path string, verdict string")
    pages = [(i, f"http://w.h{rng.randrange(6000)}.com/{rng.choice('abc')}/z") for i in range(3000)]
    df = spark.createDataFrame(pages, "page_id long, url string")
    want = {i: "block" if any(u.split("/")[2] == f"w.{h}" and u.split(h)[1].startswith(p) for h, p in [(u.split("/")[2][2:], f"/{u.split('/')[3]}/")] if (h, p) in listed) else "allow" for i, u in pages}
    assert {r.page_id: r.verdict for r in urls.judge(df, rules).collect()} == want
    monkeypatch.setattr("spindle.llm.common.BROADCAST_BYTES", 1)
    assert {r.page_id: r.verdict for r in urls.judge(df, rules).collect()} == want


def test_language_id(spark):
    import zlib

    rng = random.Random(2)
    words = {"aa": "the of and to in that was for".split(), "bb": "der die und ein nicht mit sich".split(), "cc": "que de los las por una con".split()}
    rows = []
    for i in range(600):
        lang = rng.choice([*words])
        rows.append((i, " ".join(rng.choices(words[lang], k=rng.randrange(5, 400))).title(), lang))
    rows += [(1000, None, "aa"), (1001, "", "bb"), (1002, "123 !!", "cc"), (1003, "the " * 40_000, None), (None, "the of and was that in for the", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("extra", F.lit(1))
    got = langid.identify(df, df.where(~langid.held_out(F.col("doc_id"), 5))).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(rows)
    held = [i for i, _, _ in rows[:600] if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum(by[i].lang_pred == rows[i][2] for i in held) >= 0.97 * len(held) > 0
    assert all((by[i].lang_pred, by[i].score, by[i].rejected) == ("und", 0.0, True) for i in (1000, 1001, 1002))
    assert by[1003].lang_pred == by[None].lang_pred == "aa"
    assert all(0 <= r.score <= 1 for r in got)
    assert {r.lang_pred for r in langid.identify(df, df.limit(0)).collect()} == {"und"}
    assert langid.identify(df.limit(0), df).count() == 0
