"""Fill-in-the-middle, removal of repeated passages and hard negatives against plain versions."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from spindle.llm import fim, negatives, repeats

TOKEN = re.compile("[A-Za-z]+|[^A-Za-z]", re.S)


@pytest.fixture(scope="module")
def splitter():
    return fim.Splitter()


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab ZY \n\x00é中🎉<P>1"), max_size=40), min_size=1, max_size=8))
def test_offsets_are_those_of_the_matches(texts):
    flat, at = fim.Splitter().all_offsets(pa.array(texts))
    for t, a, b in zip(texts, at[:-1], at[1:]):
        assert flat[a:b].tolist() == [*(m.start() for m in TOKEN.finditer(t)), len(t)]


def test_offsets_of_long_pieces(splitter, monkeypatch):
    monkeypatch.setattr(fim, "PIECE", 50)
    monkeypatch.setattr(fim, "MEMO", 3)
    for t in ("a" * 500, "é" * 500, "ab中" * 300 + " x" * 90, "a" * 49 + "1" + "b" * 51 + ".", " " * 200):
        flat, at = splitter.all_offsets(pa.array([t, "x", t]))
        want = [*(m.start() for m in TOKEN.finditer(t)), len(t)]
        assert flat[at[0] : at[1]].tolist() == want == flat[at[2] : at[3]].tolist()


@settings(max_examples=100, deadline=None)
@given(st.text(st.sampled_from("ab Z\n1é"), min_size=1, max_size=60), st.integers(1, 9))
def test_offsets_of_long_texts_part_by_part(text, most):
    n, offset = fim.Splitter().of_long(text, most)
    assert [offset(r) for r in range(n + 1)] == [*(m.start() for m in TOKEN.finditer(text)), len(text)]


def plain_fim(i, t):
    t = t or ""
    h = hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    a, b, c, d = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
    units = TOKEN.findall(t)
    n = len(units)
    if not t or any(m in t for m in ("<P>", "<S>", "<M>")) or c % 100 >= 90:
        return i, n, "plain", None, None, t
    x, y = sorted((a % (n + 1), b % (n + 1)))
    p, m, s = "".join(units[:x]), "".join(units[x:y]), "".join(units[y:])
    return (i, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if d % 100 < 20 else (i, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


def test_fim_and_back(spark):
    rng = random.Random(4)
    rows = [(i, "".join(rng.choice("ab <PSM>é🎉\n.") for _ in range(rng.randrange(60)))) for i in range(400)]
    rows += [(401, None), (402, ""), (403, "x"), (404, "a <S> b"), (None, "no id here"), (7, rows[7][1]), (7, "another text"), (405, "word " * 20_000)]
    made = fim.transform(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    got = [tuple(r) for r in made.collect()]
    assert sorted(got, key=str) == sorted((plain_fim(*r) for r in rows), key=str)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}
    back = made.select("doc_id", fim.restored(F.col("output"), F.col("form")).alias("t")).collect()
    assert sorted(((r["doc_id"], r["t"]) for r in back), key=str) == sorted(((i, t or "") for i, t in rows), key=str)
    assert fim.transform(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    alone = [(1000 + i, "word, " * 900_000 + "a" * i) for i in range(6)]  # each longer than a slice
    got = fim.transform(spark.createDataFrame(alone, "doc_id long, text string"), long=1_000_000).collect()
    assert sorted(map(tuple, got)) == sorted(plain_fim(*r) for r in alone)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 2**62), max_size=60))
def test_packed_numbers(values):
    v = np.sort(np.array(values, np.int64))
    assert repeats.unpacked(repeats.packed(v)).tolist() == v.tolist()


def test_window_hashes_of_every_size():
    w = np.random.default_rng(0).integers(0, 2**63, 40).astype(np.uint64)
    for size in range(1, 30):
        want = [sum(int(w[i + k]) * pow(repeats._BASE, size - 1 - k, 1 << 64) for k in range(size)) % (1 << 64) for i in range(len(w) - size + 1)]
        assert repeats.window_hashes(w, size).tolist() == want
    assert len(repeats.window_hashes(w[:5], 6)) == 0


def plain_repeats(rows, size):
    seen, out = set(), []
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        gone = set()
        for k in range(len(w) - size + 1):
            g = tuple(w[k : k + size])
            if g in seen:
                gone.update(range(k, k + size))
            seen.add(g)
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return out


def passages(seed, n):
    rng = random.Random(seed)
    some = [" ".join(rng.choice("ab cd ef gh é".split()) for _ in range(rng.randrange(3, 40))) for _ in range(30)]
    rows = [(i, " \n".join(rng.choice(some) for _ in range(rng.randrange(4))) + rng.choice(["", " ", " x", "\x1c y"])) for i in range(n)]
    rows += [(n, None), (n + 1, ""), (n + 2, "x " * 500), (n + 3, " \t"), (None, some[0] + " null id " + some[1])]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("size", [1, 3, 20])
def test_repeats(spark, size):
    rows = passages(3, 250)
    got = repeats.remove(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), size).collect()
    assert sorted(map(tuple, got), key=str) == sorted(plain_repeats(rows, size), key=str)


def test_repeats_in_many_small_blocks_and_ranges(spark):
    rows = passages(5, 250)
    got = repeats.remove(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), block_bytes=2_000, range_cells=1 << 12).collect()
    assert sorted(map(tuple, got), key=str) == sorted(plain_repeats(rows, 20), key=str)


def test_a_sketch_never_underestimates():
    texts = [pa.array([" ".join(f"w{i}" for i in range(a, b))]) for a, b in ((0, 100), (50, 130), (200, 300))]
    found = [repeats.windows(t)[3] for t in texts]
    every = np.concatenate(found, axis=1)[0].tolist()
    for cells, most in ((64, 1.0), (1 << 20, 0.28)):
        sketch = repeats.Sketch(cells, 100)
        parts: dict[int, list[bytes]] = {}
        for f in found:
            for r, blob in sketch.sparse(f):
                parts.setdefault(r, []).append(blob)
        told = {r: [*sketch.merged(blobs)] for r, blobs in parts.items()}
        some = np.concatenate([sketch.estimated(f, told) for f in found])
        repeated = [every.count(x) > 1 for x in every]
        assert sum(repeated) == 62 and all(some[repeated])
        assert sum(repeated) / len(every) <= some.mean() <= most + 0.02


def test_rows_of_equal_ids(spark):
    long = " ".join(f"w{i}" for i in range(30))
    rows = [(1, long)] * 4 + [(1, "y " + long), (2, long), (2, "short")]
    got = [tuple(r) for r in repeats.remove(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()]
    assert sorted(r[1:3] for r in got if r[0] == 2) == [(1, 0), (30, 30)]
    one = sorted(r[1:3] for r in got if r[0] == 1)
    assert len(one) == 5 and sum(r[1] == 0 for r in one) == 1 and sum(n - gone for n, gone in one) in (30, 31)
    assert repeats.remove(spark.createDataFrame([], "doc_id string, text string")).collect() == []
    assert repeats.remove(spark.createDataFrame([("a", None)], "doc_id string, text string")).collect()[0][0] == "a"


def plain_negatives(vectors, anchors, positives=5, negatives_=3):
    floor = lambda v: [int(np.floor(256.0 * float(x))) for x in v]
    rows = [(i, y, floor(v)) for i, y, v in vectors if i is not None and y is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    dot = lambda a, b: min(max(sum(x * y for x, y in zip(a, b)), -(2**63)), 2**63 - 1)
    out = []
    for i, y, v in rows:
        if i not in anchors:
            continue
        best = sorted(((-dot(v, w), j) for j, z, w in rows if z == y and j != i))[:positives]
        for s, j in best:
            fit = sorted((-dot(v, w), n) for n, z, w in rows if z != y and n != i and 50 * -s <= 100 * dot(v, w) <= 95 * -s)
            out += [(i, j, r + 1, n, -s, -t) for r, (t, n) in enumerate(fit[:negatives_])]
    return out


@pytest.mark.parametrize("scale", [1.0, 1e-3, 1e9, 1e17])
def test_negatives(spark, scale, monkeypatch):
    monkeypatch.setattr(negatives, "LEAF", 4)
    monkeypatch.setattr(negatives, "BLOCK_VALUES", 200)
    monkeypatch.setattr(negatives, "SCORED", 3)
    rng = random.Random(5)
    rows = [(i, rng.randrange(4), [scale * rng.choice([rng.gauss(1, 0.5), 1.0]) for _ in range(rng.choice([5, 5, 5, 3]))]) for i in range(150)]
    rows += [(150, 1, None), (151, None, [1.0]), (152, 2, [1.0, None]), (153, 2, [float("nan")]), (154, 3, [float("inf"), 1.0]), (None, 1, [1.0]), (155, 9, [1.0]), (156, 0, [])]
    rows += [(200 + i, i % 4, [scale] * 5) for i in range(20)]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").repartition(3)
    chosen = [*range(0, 160, 20), 155, 156]
    got = [tuple(r) for r in negatives.mine(df, df.where(F.col("vec_id").isin(chosen))).collect()]
    assert sorted(got) == sorted(plain_negatives(rows, chosen))
    assert got or scale == 1e17


def test_queries_of_many_passes_find_the_same(spark, monkeypatch):
    rng = random.Random(6)
    rows = [(i, i % 3, [rng.random() for _ in range(4)]) for i in range(120)]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").repartition(2)
    rows = [(r["vec_id"], r["label"], r["embedding"]) for r in df.collect()]
    monkeypatch.setattr(negatives, "QUERY_VALUES", 40)
    got = [tuple(r) for r in negatives.mine(df, df.where("vec_id % 10 = 0")).collect()]
    assert sorted(got) == sorted(plain_negatives(rows, range(0, 120, 10)))
    empty = df.limit(0)
    assert negatives.mine(empty, empty).collect() == [] == negatives.mine(df, empty).collect()


def test_trees_are_pruned():
    """Far clusters of one label: a search for the best of one cluster enters few nodes of the others."""
    rng = np.random.default_rng(1)
    centers = rng.normal(size=(20, 8)) * 10_000
    vectors = np.floor(np.repeat(centers, 400, 0) + rng.normal(size=(8000, 8)) * 10)
    ids, labels = np.arange(8000), np.zeros(8000, np.int64)
    queries = vectors[::400]
    limits = np.full(20, negatives.LOW), np.full(20, negatives.HIGH)
    search = negatives.Search(ids[::400], labels[::400], queries, *limits, 5, True)
    search.block(ids, labels, vectors)
    assert search.entered < 20 * 255 / 3  # of some 255 nodes for each query
    scores = queries @ vectors.T
    for n in range(20):
        want = sorted(((-s, i) for i, s in enumerate(scores[n].astype(np.int64).tolist()) if i != 400 * n))[:5]
        assert [(-s, r) for s, r in zip(search.scores[n].tolist(), search.rows[n].tolist())] == want
