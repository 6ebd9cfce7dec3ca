"""The queries that SQL cannot express, over a whole small fixture, against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest

from spindle.llm import queries

pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def fixture(spark, tmp_path_factory):
    rng = random.Random(12)
    words = {"en": "the of and to in that was for with this token secret".split(), "de": "der die und ein nicht mit sich auf dem von".split()}
    rows = []
    for i in range(120):
        lang = rng.choice(["en", "en", "de"])
        text = " ".join(rng.choice(words[lang]) + rng.choice(["", "", str(rng.randrange(50))]) for _ in range(rng.randrange(20, 90)))
        if i % 5 == 0:
            text += rng.choice([" token=abc123def4 x", " password: 'qwertyuiop'", " AKIA" + "A1" * 10, " " + "0a" * 14, " Secret = ab", " hf_" + "x" * 30])
        rows.append((i, text, lang, f"s{i % 3}", len(text)))
    passage = " ".join(f"item{i} quiz" for i in range(14))
    rows += [(200, rows[3][1], "en", "s0", 0), (201, rows[3][1] + " more", None, "s0", 0), (202, "x " + passage + " y", "en", "s1", 0), (203, None, "en", None, None), (204, "", None, "s1", 0), (205, "12 34", "de", "s1", 5), (None, rows[4][1], "en", "s1", 0), (5, rows[5][1], rows[5][2], "s2", 0)]
    path = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(7, passage), (8, "another passage that is in none of these documents, at all")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, rows


def run(spark, fixture, name):
    return queries.QUERIES[name](spark, fixture[0]).collect()


def same(got, want):
    assert sorted(got, key=str) == sorted(want, key=str)


def test_op1(spark, fixture):
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    n = lambda t: len(library.encode(t or "", add_special_tokens=False).ids)
    same([tuple(r) for r in run(spark, fixture, "op1_token_counts")], [(i, len((t or "").encode()), n(t), n(t) > 2048) for i, t, *_ in fixture[1]])


def test_op2(spark, fixture):
    rules = {
        "assign": (r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A, 2, 6),
        "access": (r"AKIA[A-Z0-9]+", 0, 0, 20),
        "hex": (r"[0-9a-f]+", 0, 0, 24),
    }

    def plain(text):
        out = []
        for k, (kind, (pattern, flags, group, least)) in enumerate(rules.items()):
            out += [(m.start(), k, kind, m.end()) for m in re.finditer(pattern, text or "", flags) if len(m[group]) >= least]
        out.sort()
        joined = ",".join(f"{kind}:{a}:{b}" for a, _, kind, b in out)
        n = Counter(x[2] for x in out)
        return n["assign"], n["access"], n["hex"], hashlib.sha256(joined.encode()).hexdigest(), joined

    got = run(spark, fixture, "op2_secret_scans")
    same([(r.doc_id, r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in got], [(i, *plain(t)[:4]) for i, t, *_ in fixture[1]])
    texts = {(i, plain(t)[4]): t for i, t, *_ in fixture[1]}
    for r in got:  # the method's own kinds come on top; base ones stay
        base = ",".join(s for s in r.spans.split(",") if s.split(":")[0] in rules)
        assert (r.doc_id, base) in texts
    assert sum(r.n_assign > 0 for r in got) > 3 and any("hub:" in r.spans for r in got)


def test_op5(spark, fixture):
    rows = fixture[1]
    tokens = lambda t: re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower()) + [None]
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0
    c = Counter(w for i, t, *_ in rows if not held(i) for w in tokens(t))
    n, v = sum(c.values()), len(c)
    got = run(spark, fixture, "op5_class_lm")
    base = lambda t: round(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens(t)), 6)
    same([(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got], [(i, held(i), len(tokens(t)), sum(c[w] > 0 for w in tokens(t)), n, base(t)) for i, t, *_ in rows])
    assert all(r.score < 0 and math.isfinite(r.score) for r in got)
    again = {(r.doc_id, r.n_tokens): r.score for r in run(spark, fixture, "op5_class_lm")}
    assert all(again[r.doc_id, r.n_tokens] == pytest.approx(r.score) for r in got)


def test_op7(spark, fixture):
    (hit,) = run(spark, fixture, "op7_decontaminate")
    text = next(t for i, t, *_ in fixture[1] if i == 202)
    assert (hit.doc_id, hit.item_id, hit.edits, text[hit.start : hit.end].split()[0]) == (202, 7, 0, "item0")


def test_op9(spark, fixture):
    rows = fixture[1]

    def grams(t):
        w = re.findall(r"\w+", (t or "").lower())
        k = min(5, len(w))
        return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if k else None

    sets = [grams(t) for _, t, *_ in rows]
    distinct = {*sets} - {None}
    near = {s: {x for x in distinct if len(s & x) >= 0.8 * len(s | x)} for s in distinct}
    while any(near[x] - near[s] for s in distinct for x in near[s]):
        near = {s: set().union(*(near[x] for x in near[s])) for s in distinct}
    links = {s: sum(len(s & x) >= 0.8 * len(s | x) for x in distinct) - 1 for s in distinct}
    want = []
    for (i, *_), s in zip(rows, sets):
        if s is None:
            want.append((i, i, 0, 1))
        else:
            ids = [j for (j, *_), x in zip(rows, sets) if x in near[s] and j is not None]
            want.append((i, min(ids), links[s], sum(x == s for x in sets)))
    same([tuple(r) for r in run(spark, fixture, "op9_jaccard_join")], want)
    assert sum(w[2] for w in want) >= 2


def test_op10(spark, fixture):
    import zstandard

    from spindle.llm import langid

    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 0
    got = run(spark, fixture, "op10_language_id")
    same([(r.doc_id, r.held_out) for r in got], [(i, held(i)) for i, *_ in fixture[1]])
    truth = {i: lang for i, _, lang, *_ in fixture[1][:120]}
    test = [r for r in got if r.held_out and r.doc_id in truth]
    assert sum(r.lang_pred == truth[r.doc_id] for r in test) >= 0.95 * len(test) > 10
    assert {(r.lang_pred, r.score) for r in got if r.doc_id in (203, 204, 205)} == {("und", 0.0)}
    assert all(0 <= r.score <= 1 for r in got)
    # Judged again by plain compression with dictionaries of all spans, which are fewer than the sample may hold.
    spans = [(i, lang, (t or "")[n : n + langid.SPAN]) for i, t, lang, *_ in fixture[1] if lang and not held(i) for n in range(0, len(t or ""), langid.SPAN)]
    assert len(spans) < langid.SPANS
    learnt = dict(langid.learn(spark.read.parquet(f"{fixture[0]}/documents.parquet").where("crc32(cast(coalesce(cast(doc_id as string), '') as binary)) % 5 <> 0")))
    assert {k: sorted(v.decode().split("\n")) for k, v in learnt.items()} == {k: sorted(s.lower() for _, x, s in spans if x == k) for k in learnt}

    def size(text, content):
        data = text.lower().encode()
        d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        return sum(len(zstandard.ZstdCompressor(level=langid.LEVEL, dict_data=d, write_content_size=False, write_dict_id=False).compress(data[i : i + langid.PIECE])) for i in range(0, len(data), langid.PIECE))

    judged = {(r.doc_id, r.lang_pred, r.rejected) for r in got}
    for i, t, *_ in fixture[1]:
        if re.search(r"[^\W\d_]", t or ""):
            sizes = {k: size(t, v) for k, v in learnt.items()}
            low, second = sorted(sizes.values())[:2]
            best = next(k for k in learnt if sizes[k] == low)
            assert (i, best, second - low < max(langid.MARGIN_BYTES, langid.MARGIN_PART * second)) in judged
