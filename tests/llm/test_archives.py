"""WARC archives and exact top-k search."""

import base64
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from spindle.llm import topk, warc

EVIL = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:99>\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"


def digest(text):
    return base64.b32encode(hashlib.sha1(text.encode()).digest()).decode()


@pytest.mark.parametrize("split", ["700", "134217728"])
def test_round_trip(spark, split):
    rows = [(1, "http://a b\r\nx", None), (2, "u", EVIL * 40), (3, None, "x" * 3000 + EVIL), (4, "u", ""), (5, "u%41 %\x7f\x01", EVIL + "WARC/1."), (None, "u", "zz"), (7, "u", "zz"), (7, "u", "zz"), (8, "u", EVIL * 40), (9, "u", "é" * 50)]
    rows += [(i, "u", f"t{i}\r\n\r\nWARC/1.0\r\n") for i in range(10, 60)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("clash")).repartition(2)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        got = warc.round_trip(df).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    want = []
    for i, _, html in rows:
        html = html or ""
        top = max((x for x, _, y in rows if (y or "") == html and x is not None), default=None)
        again = i is not None and i != top
        want.append((i, "revisit" if again else "response", top if again else None, len(html.encode()), digest(html)))
    assert sorted((tuple(r[c] for c in ("page_id", "record_type", "refers_to", "payload_bytes", "payload_digest")) for r in got), key=str) == sorted(want, key=str)
    texts = {i: h or "" for i, _, h in rows}
    assert all(bytes(r.payload).decode() == texts[r.page_id] for r in got if r.record_type == "response")
    assert {(r.page_id, r.url) for r in got} == {(i, u or "") for i, u, _ in rows}


def test_least_bytes_and_empty(spark):
    df = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcd"), (4, "u", "abcd")], "page_id long, url string, html string")
    got = {r.page_id: r.record_type for r in warc.round_trip(df, 3).collect()}
    assert got == {1: "response", 2: "response", 3: "revisit", 4: "response"}
    assert warc.round_trip(df.limit(0)).count() == 0


def test_no_record_at_the_start(spark, tmp_path):
    (tmp_path / "bad.warc").write_bytes(b"junk" + EVIL.encode())
    (tmp_path / "good.warc").write_bytes(EVIL.encode() * 3)
    got = warc.read(spark, f"file://{tmp_path}")
    assert [(r.file[-9:], bytes(r.block)) for r in got.collect()] == [("good.warc", b"hello")] * 3


def plain(vectors, queries, k):
    out = {}
    ok = [(i, v) for i, v in vectors if i is not None and v is not None and all(x is not None and abs(x) < float("inf") for x in v)]
    import math

    ints = [(i, [math.floor(1024 * x) for x in v]) for i, v in ok]
    for q in {i for i in queries if i is not None}:
        mine = sorted(v for i, v in ints if i == q)
        if mine:
            s = [(min(max(sum(a * b for a, b in zip(mine[0], v)), -(2**63)), 2**63 - 1), i) for i, v in ints if i != q]
            out[q] = [(r + 1, i, x) for r, (x, i) in enumerate(sorted(s, key=lambda t: (-t[0], t[1]))[:k])]
    return {q: v for q, v in out.items() if v}


def few_values(f, values, queries):
    """f with small blocks, in the workers too."""

    def run(batches):
        topk.BLOCK_VALUES = values
        yield from f(batches)

    return run


@pytest.mark.parametrize("block", [50 * 16, 1_280_000])
def test_top_k_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(topk, "QUERY_VALUES", 7 * 16 if block < 1000 else 4_000_000)
    search = topk._search
    monkeypatch.setattr(topk, "_search", lambda held, k: few_values(search(held, k), block, None))
    monkeypatch.setattr(topk, "BLOCK_VALUES", block)
    rng = random.Random(6)
    rows = [(i, [rng.gauss(0, 0.2) for _ in range(16)]) for i in range(400)]
    rows += [(400 + i, rows[100][1]) for i in range(20)] + [(500, None), (501, [None] * 16), (502, [float("nan")] * 16), (503, [float("inf")] * 16), (None, [0.1] * 16), (3, [0.5] * 16), (504, [0.0]), (505, [0.0] * 16), (505, [0.0] * 16), (600, [1e4] * 16), (620, [1e10, -1e17, 1e19] + [0.5] * 13), (640, [-3e17] * 16), (641, [3e17] * 16)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("rank", F.lit(0))
    got = {}
    for r in topk.search(df, df.where("vec_id % 20 = 0 or vec_id = 3"), 10).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert got == plain(rows, [i for i, _ in rows if i is not None and (i % 20 == 0 or i == 3)], 10)
    huge = spark.createDataFrame([(0, [1.7e308, -1.0]), (1, [1e-300, 2.0]), (2, [-1.7e308, 5.0]), (3, [])], "vec_id long, embedding array<double>")
    top = [(r.query_id, r.vec_id, r.score) for r in topk.search(huge, huge.where("vec_id = 0")).collect()]
    assert top == [(0, 3, 0), (0, 1, -(2**21)), (0, 2, -(2**63))] or sorted(top) == sorted([(0, 3, 0), (0, 1, -(2**21)), (0, 2, -(2**63))])
    assert topk.search(df.limit(0), df).count() == topk.search(df, df.limit(0)).count() == 0
