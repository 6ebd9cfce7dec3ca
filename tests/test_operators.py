import difflib
import hashlib
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from spindle.operators import analysis, compare, integrity, metrics, prompts, quality, sampling
from spindle.plans import gates
from spindle.plans.config import check_task
from spindle.queries import TASK


def frame(spark, schema, *rows):
    return spark.createDataFrame(list(rows), schema)


def test_prepare_rows(spark):
    task = check_task(TASK | {"prompt_template": "{{k}} {a}: {c}", "field_transforms": {"a": "title", "c": "join_comma"}, "response_field": "r", "response_map": {"1": "yes", "None": "nil"}})
    df = frame(spark, "a string, c array<string>, r int, a_b string", (" o'neil ", ["x ", "y"], 1, "q"), ("b", ["z"], 2, "q"), ("c", ["w"], None, None))
    assert [(r.prompt, r.response) for r in prompts.prepare_rows(df, task).collect()] == [("{k} O'Neil: x, y", "yes"), ("{k} B: z", "2"), ("{k} C: w", "nil")]
    assert prompts.prepare_rows(df, task).first().inputs.a == " o'neil "
    bad = frame(spark, "a string, c array<string>, r string", (" ", ["x"], "1"))
    with pytest.raises(Exception, match="empty prompt field: a"):
        prompts.prepare_rows(bad, task).collect()
    assert prompts.prepare_rows(bad.withColumn("r", F.lit(" ")), task).count() == 0  # the empty response goes first
    with pytest.raises(ValueError, match="no columns c, r"):
        prompts.prepare_rows(df.drop("c", "r"), task)
    with pytest.raises(ValueError, match="not a list"):
        prompts.prepare_rows(df.withColumn("c", F.lit("x")), task)


def test_encoded_boundary(spark):
    df = frame(spark, "prompt string, response string", ("a b", "c d"), ("a b c", "d e"), ("", "x"))
    got = prompts.encoded(df, 5).collect()
    assert [(r.input_ids, r.labels) for r in got] == [(["a", "b", "c", "d", "</s>"], ["-100", "-100", "c", "d", "</s>"]), (["x", "</s>"], ["x", "</s>"])]
    assert prompts.padded(prompts.encoded(df, 5), "labels", 6, "-100").first().labels == ["-100", "-100", "c", "d", "</s>", "-100"]


def test_overlap_and_priority(spark):
    rows = frame(spark, "id int, split string, prompt string", (1, "train", "p"), (2, "train", "p"), (3, "validation", "p"), (4, "test", "p"), (5, "test", "p"), (6, "train", "q"), (7, "train", "q"), (8, "validation", "r"), (9, "train", "r"))
    assert {(r.first, r.second): r.prompts for r in integrity.prompt_overlap(rows).collect()} == {("train", "validation"): 2, ("train", "test"): 1, ("validation", "test"): 1}
    kept = integrity.keep_highest_split(rows)
    assert sorted(r.id for r in kept.collect()) == [4, 5, 6, 7, 8]
    assert {r.split: r.removed for r in integrity.removed_counts(rows, kept).collect()} == {"train": 3, "validation": 1, "test": 0}
    assert {r.split: r.rows for r in integrity.row_counts(rows.where("split = 'train'")).collect()} == {"train": 5, "validation": 0, "test": 0}


def plain_simhash(value):
    t = value.split()
    w = [0] * 64
    for f in {*t, *(f"{a} {b}" for a, b in zip(t, t[1:]))}:
        bits = int.from_bytes(hashlib.blake2b(f.encode(), digest_size=8).digest(), "big")
        for b in range(64):
            w[b] += 1 if bits >> b & 1 else -1
    return sum(1 << b for b in range(64) if w[b] > 0)


def plain_near(first, second):
    n = 0
    for a in first:
        for b in second:
            x, y = plain_simhash(a), plain_simhash(b)
            same = any((x >> 8 * i & 255) == (y >> 8 * i & 255) for i in range(8)) or (len(a.split()) >= 3 and a.split()[:3] == b.split()[:3])
            n += same and (x ^ y).bit_count() <= 12 and difflib.SequenceMatcher(None, a, b, autojunk=False).ratio() >= 0.9
    return n


def test_near_duplicates_equal_brute_force(spark):
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(60)]
    base = [" ".join(rng.choices(vocabulary, k=rng.choice((2, 8, 30)))) for _ in range(12)]
    rows = []
    for _ in range(120):
        t = rng.choice(base).split()
        for _ in range(rng.choice((0, 0, 1, 2))):
            t[rng.randrange(len(t))] = rng.choice(vocabulary)
        rows.append((rng.choice(integrity.SPLITS), " ".join(t)))
    rows += [("train", ""), ("test", "")]
    got = {(r.first, r.second): r.pairs for r in quality.near_duplicates(frame(spark, "split string, source_text string", *rows)).collect()}
    by = {s: [t for x, t in rows if x == s and t] for s in integrity.SPLITS}
    want = {(a, b): plain_near(by[a], by[b]) for a, b in (("train", "validation"), ("train", "test"), ("validation", "test"))}
    assert got == want and sum(want.values()) > 50


def test_simhash(spark):
    values = ["", "one", "a b", "a b c d e f g " * 5, "é ü"]
    df = frame(spark, "i int, v string", *enumerate([*values, None]))
    got = [r.simhash for r in quality.with_simhash(df, "v").orderBy("i").collect()]
    assert [None if h is None else h % 2**64 for h in got] == [*map(plain_simhash, values), None]


def test_simhash_of_texts_with_every_white_space():
    import pyarrow as pa

    spaces = [chr(c) for c in range(0x3100) if chr(c).isspace()]
    values = [f"a{s}b{s}{s}c" for s in spaces] + [f"{s}a b{s}" for s in spaces] + ["x\u200by", "a " * 500 + "b", " "]
    assert [h % 2**64 for h in quality.simhashes(pa.array(values)).tolist()] == [*map(plain_simhash, values)]
    assert quality.simhashes(pa.array([], pa.string())).tolist() == []


def test_simhash_sums_features_in_parts(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(quality, "FEATURES", 7)
    rng = random.Random(8)
    values = [" ".join(rng.choice("ab cd ef gh ij".split()) for _ in range(rng.randrange(30))) for _ in range(40)]
    assert [h % 2**64 for h in quality.simhashes(pa.array(values)).tolist()] == [*map(plain_simhash, values)]


def test_fingerprint_pairs_equal_brute_force(spark):
    """Fingerprints 0 to 16 bits apart from a few, of which some share no byte."""
    rng = random.Random(9)
    base = [rng.getrandbits(64) for _ in range(6)]
    rows = []
    for i in range(400):
        h = rng.choice(base)
        for b in rng.sample(range(64), rng.choice((0, 1, 6, 8, 9, 12, 13))):
            h ^= 1 << b
        if i % 10 == 0:
            h = base[0] ^ sum(1 << 8 * b + rng.randrange(8) for b in range(8))  # each byte one bit away
        rows.append((i, rng.randrange(3), h - 2**64 if h >> 63 else h, rng.choice((1, 90, 100, 120)), rng.choice((None, "a b c", "d e f"))))
    pairs = quality.fingerprint_pairs(frame(spark, "id long, rank int, h long, size int, prefix string", *rows))
    got = [(r.x.id, r.y.id) for r in pairs.collect()]

    def likely(a, b):
        x = (a[2] ^ b[2]) % 2**64
        same = any(x >> 8 * i & 255 == 0 for i in range(8)) or a[4] is not None and a[4] == b[4]
        return a[1] < b[1] and same and x.bit_count() <= 12 and 2 * min(a[3], b[3]) / (a[3] + b[3]) >= 0.9

    want = [(a[0], b[0]) for a in rows for b in rows if likely(a, b)]
    assert sorted(got) == sorted(want) and len(want) > 500


def test_fingerprint_pairs_deals_buckets_to_cells(spark, monkeypatch):
    """Blocks of a few rows, and of the size of a bucket, give the same pairs; no join broadcasts what entries become, but the buckets."""
    rng = random.Random(10)
    base = [rng.getrandbits(63) for _ in range(3)]
    rows = [(i, rng.randrange(3), rng.choice(base) ^ 1 << rng.randrange(60) ^ 1 << rng.randrange(60), rng.choice((90, 100, 120)), rng.choice((None, "a b c"))) for i in range(150)]
    rows += [(200, 0, None, 9, "a b c"), (201, None, base[0], 90, None), (202, 1, base[0], None, None)]
    df = frame(spark, "id long, rank int, h long, size int, prefix string", *rows)
    plan = quality.fingerprint_pairs(df)._jdf.queryExecution().executedPlan().toString().split("\n")
    at = [i for i, line in enumerate(plan) if "BroadcastExchange" in line]
    assert all("Aggregate" in plan[i + 1] for i in at)
    whole = sorted((r.x.id, r.y.id) for r in quality.fingerprint_pairs(df).collect())
    monkeypatch.setattr(quality, "BLOCK", 7)
    assert sorted((r.x.id, r.y.id) for r in quality.fingerprint_pairs(df).collect()) == whole and len(whole) > 500


def test_quality_reports_and_policy(spark):
    rows = frame(spark, "split string, prompt string, response string", ("train", "mail me a@b.org", " Sadness "), ("train", "x", "joy!"), ("test", "hf_" + "a" * 32, "joy"))
    got = {(r.split, r.label): r.rows for r in quality.label_distribution(rows, ["sadness", "joy"]).collect()}
    assert got == {("train", "sadness"): 1, ("train", "joy"): 0, ("train", "other"): 1, ("test", "sadness"): 0, ("test", "joy"): 1, ("test", "other"): 0}
    found = [(r.split, r.type, r.rows) for r in quality.sensitive_counts(rows).collect()]
    assert ("train", "email", 1) in found and ("test", "huggingface_token", 1) in found and sum(x[2] for x in found) == 2
    with pytest.raises(ValueError, match="secret"):
        gates.quality_gate({}, {}, found)
    gates.quality_gate({"data_quality": {"fail_on_secret": False}}, {"a": 3}, found)
    with pytest.raises(ValueError, match="personal"):
        gates.quality_gate({"data_quality": {"fail_on_secret": False}}, {}, found, pii=True)
    with pytest.raises(ValueError, match="near-duplicate"):
        gates.quality_gate({}, {"a": 1}, [], near_duplicates=True)
    with pytest.raises(ValueError):
        gates.overlap_gate({"a": 1}, strict=True)
    assert gates.overlap_gate({"a": 0}, strict=True) is None
    lengths = spark.createDataFrame([("train", 0.2), ("test", 0.1)], "split string, fraction_over double")
    assert {r.split: r.status for r in gates.length_verdicts(lengths, 0.1).collect()} == {"train": "rejected", "test": "passed"}


def test_kth_key_and_fit(spark):
    df = spark.range(30_000).withColumnRenamed("id", "k")
    order = sorted(range(30_000), key=lambda i: (hashlib.md5(f"1:{i}".encode()).hexdigest(), str(i)))
    for k in (1, 17, 12_345, 30_000):
        assert {r.k for r in sampling.first_k(df, k, 1, "k").collect()} == {*order[:k]}
    assert sampling.first_k(df, 40_000, 1, "k").count() == 30_000
    taken, passed = sampling.first_k_that_fit(df, F.col("k") % 3 == 0, 100, 1, "k")
    fit = [i for i in order if i % 3 == 0][:100]
    assert {r.k for r in taken.collect()} == {*fit}
    assert passed.count() == order.index(fit[-1]) + 1 - 100


def test_balanced(spark):
    rows = frame(spark, "k int, response string, n int", *((i, (" A", "b", "c")[i % 3], i) for i in range(30)))
    quota = sampling.quotas(11, ["a", "b", "c"])
    assert quota == {"a": 4, "b": 4, "c": 3}
    got = sampling.balanced(rows, quota, 3, "k").collect()
    assert Counter(r.label for r in got) == quota and len({r.k for r in got}) == 11
    assert {r.k for r in sampling.balanced(rows.repartition(5), quota, 3, "k").collect()} == {r.k for r in got}
    with pytest.raises(ValueError, match="label a needs 11 rows; 10 found"):
        sampling.balanced(rows, {"a": 11}, 3, "k")
    with pytest.raises(ValueError, match="2 fit"):
        sampling.balanced(rows, {"a": 3}, 3, "k", fits=F.col("n") < 6)


def test_splits(spark):
    df = spark.range(101).withColumn("g", F.concat(F.lit(" G"), (F.col("id") % 10).cast("string")))
    got = Counter(r.split for r in sampling.percent_split(df, 0.1, 1, "id").collect())
    assert got == {"train": 90, "validation": 5, "test": 6}
    by = {}
    for r in sampling.group_split(df, "g", 0.25, 1).collect():
        by.setdefault(r.split, set()).add(r.g)
    assert {k: len(v) for k, v in by.items()} == {"train": 8, "validation": 1, "test": 1}  # 2.5 groups round to 2
    with pytest.raises(ValueError, match="fewer than two groups"):
        sampling.group_split(df.withColumn("g", F.lit("x")), "g", 0.25, 1)
    lists = frame(spark, "i int, c array<string>", (1, [" b", "A"]), (2, ["a", "B "]), (3, ["a", "a", "b"]))
    keys = [r[0] for r in lists.select(sampling.group_key(lists, "c")).collect()]
    assert keys[0] == keys[1] != keys[2]
    assert [r.i for r in sampling.without_leaks(lists.where("i > 1"), lists.where("i = 1"), "c").collect()] == [3]


def test_running_totals(spark):
    """Nulls count as nothing, ranges of any number, columns named as those used inside."""
    rng = random.Random(2)
    rows = [(i, rng.choice([None, 1, 5, -3])) for i in range(500)]
    rng.shuffle(rows)
    df = frame(spark, "i int, v int", *rows).repartition(7).withColumn("n", F.lit(0)).withColumn("part", F.lit(1)).withColumn("first", F.lit("x"))
    got = {r.i: (r.before, r["sum so far"]) for r in sampling.running_totals(sampling.running_totals(df, F.col("i")), F.col("i"), F.col("v"), "sum so far").collect()}
    by = dict(rows)
    assert got == {i: (i, sum(by[j] or 0 for j in range(i))) for i in range(500)}
    assert sampling.running_totals(df.limit(0), F.col("i")).collect() == []


def test_batches(spark):
    rows = [(i, [str(j) for j in range(i % 7 + 1)]) for i in range(23)]
    df = frame(spark, "i int, input_ids array<string>", *rows).withColumns({"attention_mask": F.transform("input_ids", lambda _: F.lit(1)), "labels": F.transform("input_ids", lambda x: F.when(x == "0", str(prompts.IGNORED)).otherwise(x))})
    got = prompts.batches(df.repartition(5), 4, F.col("i"), "<p>").orderBy("i").collect()
    for r in got:
        width = max(len(rows[i][1]) for i in range(4 * r.batch, min(23, 4 * r.batch + 4)))
        more = width - len(rows[r.i][1])
        assert (r.batch, r.place) == divmod(r.i, 4) and r.width == width
        assert r.input_ids == rows[r.i][1] + ["<p>"] * more and r.attention_mask == [1] * (width - more) + [0] * more
        assert r.labels == [str(prompts.IGNORED), *rows[r.i][1][1:]] + [str(prompts.IGNORED)] * more
    cut = prompts.truncated_examples(df, 1)
    assert cut.count() == 0 and prompts.truncated_examples(df, 3).count() == sum(len(x) > 1 for _, x in rows)
    with pytest.raises(Exception, match="no response token"):
        prompts.truncated_examples(df, 1, strict=True).collect()


def test_files_in_order(spark, tmp_path):
    df = frame(spark, "i int", *((i * 37 % 200,) for i in range(200))).repartition(9)
    sampling.write_in_order(df, str(tmp_path / "out"), F.col("i"), "csv")
    lines = [int(x) for p in sorted((tmp_path / "out").glob("part-*")) for x in p.read_text().split()]
    assert lines == list(range(200))


def test_label_scores(spark):
    df = frame(spark, "reference string, output string", ("joy", " Joy\n"), ("JOY", "fear"), ("joy ", "joy"), ("anger", "what"))
    labels = ["joy", "fear", "anger", "absent"]
    s = metrics.label_scores(df, labels).first()
    assert (s.examples, s.accuracy, s.invalid_label_outputs) == (4, 0.25, 1)
    per = {r.label: (r.support, r.predicted, r.precision, r.recall, r.f1) for r in metrics.per_label(metrics.confusion(df, labels)).collect()}
    assert per == {"joy": (2, 2, 0.5, 0.5, 0.5), "fear": (0, 1, 0.0, 0.0, 0.0), "anger": (1, 0, 0.0, 0.0, 0.0), "absent": (0, 0, 0.0, 0.0, 0.0)}
    assert s.macro_f1 == 0.125
    assert metrics.label_scores(df.limit(0), labels).first().accuracy is None


def plain_rouge(a, b):
    a, b = (re.findall(r"\b\w+\b", x.lower()) for x in (a, b))
    if not a or not b:
        return 0.0
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    return 2 * t[-1][-1] / (len(a) + len(b))


def test_rouge_and_coverage(spark):
    rng = random.Random(2)
    pairs = [(" ".join(rng.choices("a b c d é".split(), k=rng.randrange(90))), " ".join(rng.choices("a b c d é".split(), k=rng.randrange(90)))) for _ in range(60)] + [("", "a"), ("A-b", "a b")]
    df = frame(spark, "i int, reference string, output string", *((i, *p) for i, p in enumerate(pairs)))
    got = [r.rouge_l for r in metrics.rouge_l(df).orderBy("i").collect()]
    assert got == pytest.approx([plain_rouge(*p) for p in pairs])
    c = frame(spark, "concepts array<string>, output string, reference string", (["Ski", "ski", "hot dog"], "I ski", "skis"), ([], "x", "y"))
    one = metrics.concept_coverage(c).first()
    assert (one.mean_output_concept_fraction, one.mean_reference_concept_fraction) == (pytest.approx(2 / 3), 0.0)


def test_bootstrap(spark):
    rows = [("a", "a")] * 30 + [("a", "b")] * 10 + [("b", "x")] * 5 + [("z", "z")] * 5
    df = frame(spark, "reference string, output string", *rows)
    cells = metrics.cells_of(df, ["a", "b"])
    assert sum(c[2] for c in cells) == 50
    got = {r.metric: (r.lower, r.upper) for r in metrics.bootstrap(spark, cells, ["a", "b"], 9).collect()}
    assert got == {r.metric: (r.lower, r.upper) for r in metrics.bootstrap(spark, cells, ["a", "b"], 9).collect()}
    acc = metrics.label_scores(df, ["a", "b"]).first().accuracy
    assert got["accuracy"][0] < acc < got["accuracy"][1]


def test_binomial_quantiles():
    """Against distributions summed in whole numbers, and by size against the normal approximation."""
    import math
    from fractions import Fraction

    import numpy as np

    rng = np.random.default_rng(3)
    for n in (0, 1, 5, 40, 200):
        for p in (Fraction(0), Fraction(1, 1000), Fraction(1, 3), Fraction(9, 10), Fraction(1)):
            u = rng.random(50)
            upto, sums = Fraction(0), []
            for k in range(n + 1):
                upto += math.comb(n, k) * p**k * (1 - p) ** (n - k)
                sums.append(float(upto))
            want = [next(k for k, x in enumerate(sums) if x >= v) for v in u.tolist()]
            assert metrics.binomial_quantiles(u, np.full(50, n), float(p)).tolist() == want
    u = np.array([0.001, 0.5, 0.999])
    for n in (10**7, 10**9):
        x = (metrics.binomial_quantiles(u, np.full(3, n), 0.3) - 0.3 * n) / math.sqrt(n * 0.21)
        assert np.allclose(x, [-3.0902, 0, 3.0902], atol=2e-3)


def test_resamples_are_multinomial(spark):
    """Means and covariances of the counts, and intervals against those of plain resampling."""
    import numpy as np

    cells = [("a", "a", 300), ("a", "b", 100), ("b", "a", 50), ("b", "b", 0), ("b", "!", 150)]
    n, share = 600, np.array([c[2] for c in cells]) / 600
    counts = np.array([r.counts for r in metrics.resampled(spark, cells, 5, 4000).collect()])
    assert (counts.sum(1) == n).all() and (counts[:, 3] == 0).all()
    assert np.allclose(counts.mean(0), n * share, atol=1.0)
    assert np.allclose(np.cov(counts.T), n * (np.diag(share) - np.outer(share, share)), atol=12)
    rng = np.random.default_rng(1)
    right = np.sort(rng.choice([1.0] * 300 + [0.0] * 300, (4000, n)).mean(1))
    got = {r.metric: (r.lower, r.upper) for r in metrics.bootstrap(spark, cells, ["a", "b"], 5, 4000).collect()}
    assert np.allclose(got["accuracy"], (right[99], right[3899]), atol=0.004)


def test_bootstrap_of_many_rows_takes_no_longer(spark):
    import time

    def took(times):
        cells = [("a", "a", 60 * times), ("a", "b", 20 * times), ("b", "b", 15 * times), ("b", "a", 5 * times)]
        began = time.perf_counter()
        got = {r.metric: (r.lower, r.upper) for r in metrics.bootstrap(spark, cells, ["a", "b"], 5).collect()}
        return time.perf_counter() - began, got["accuracy"]

    took(1)
    (few, wide), (many, narrow) = took(1), took(100_000)
    assert many < few + 10 and narrow[1] - narrow[0] < 0.001 < wide[1] - wide[0]
    assert metrics.bootstrap(spark, [], ["a"], 5).first().lower is None


def test_loss(spark):
    df = frame(spark, "g string, loss double, tokens int", ("x", 1.0, 3), ("x", 3.0, 1), ("y", 5.0, 0))
    got = {r.g: (r.tokens, r.response_loss) for r in metrics.response_loss(df, "g").collect()}
    assert got == {"x": (4, 1.5), "y": (0, None)}


def test_compare(spark):
    a = frame(spark, "ordinal int, prompt string, reference string", (1, "p", "r"), (2, None, "r"), (3, "x", "r"))
    b = frame(spark, "ordinal int, prompt string, reference string", (1, "p", "r"), (2, None, "r"), (3, "y", "r"), (4, "z", "r"))
    assert [r.ordinal for r in compare.differing_cases(a, b).orderBy("ordinal").collect()] == [3, 4]
    e = frame(spark, "run int, split string, model string, accuracy double, group int, seed int", (1, "test", "trained_run", 0.8, 1, 11), (1, "test", "starting_model", 0.2, 1, 0), (2, "test", "trained_run", 0.6, 1, 22))
    got = {r.run: (r.accuracy_lift, r.has_base) for r in compare.lifts(e, "accuracy").collect()}
    assert got == {1: (pytest.approx(0.6), True), 2: (None, False)}
    s = compare.seed_summary(e.where("model = 'trained_run'"), "accuracy").first()
    assert (s.accuracy_mean, s.accuracy_values) == (pytest.approx(0.7), [0.8, 0.6])
    assert {r.fault for r in compare.seed_faults(e, "split").collect()} == {"not a trained run"}
    assert {r.fault for r in compare.seed_faults(e.where("run = 2").withColumn("seed", F.lit(None).cast("int")), "split").collect()} == {"fewer than two runs", "seeds repeat"}


def test_percentiles_and_limits(spark):
    df = frame(spark, "prompt_tokens int, response_tokens int", *((i, 2 * i) for i in range(1, 11)))
    got = {(r.measure, r.percent): r.value for r in analysis.percentiles(df, ["prompt_tokens"]).collect()}
    assert got == {("prompt_tokens", p): v for p, v in ((50, 5), (90, 9), (95, 10), (99, 10), (100, 10))}
    one = analysis.limit_sweep(df, [9]).first()
    assert (one.truncated, one.without_response) == (7, 2)
    assert one.response_retained_percent == pytest.approx(100 * sum(min(2 * i, max(0, 9 - i)) for i in range(1, 11)) / 110)


def test_promotion(spark):
    task = {"name": "t", "promotion": {"minimum_examples": 2, "minimum_metrics": {"accuracy": 0.7}, "minimum_lift": {"accuracy": 0.05}}}
    case = {"prompt": "p", "reference": "r"}
    ev = lambda model, a, **more: {"task": "t", "run_dir": "d", "model": model, "split": "test", "examples": [case, case], "generation_metric": {"metric": "label_accuracy", "accuracy": a, "invalid_label_outputs": 0}} | more
    assert gates.promote(task, ev("trained_run", 0.7), ev("starting_model", 0.6), "d", spark)["status"] == "promoted"
    got = gates.promote(task, ev("trained_run", 0.6, examples=[case]), ev("starting_model", 0.6, examples=[case]), "d", spark)
    assert got["status"] == "rejected" and got["failures"] == ["examples", "accuracy", "accuracy_lift"]
    for bad in (ev("starting_model", 0.9), ev("trained_run", 0.9, examples=[]), ev("trained_run", 0.9, split="validation"), ev("trained_run", 0.9, decoding=1)):
        with pytest.raises(ValueError):
            gates.promote(task, bad, ev("starting_model", 0.6), "d", spark)


def test_cues(spark):
    df = frame(spark, "sign string, category string, date string, response string", ("Leo", "Love", "2024/01/02", "leo and Virgo: romance on 2024-01-02"), ("Aries", "Travel", "2024/01/02", "clovers"))
    got = analysis.cue_audit(df, F.col("response")).collect()
    assert [(r.requested_sign_mentioned, r.other_signs_mentioned, r.category_cue, r.exact_date_mentioned) for r in got] == [(True, ["Virgo"], True, True), (False, [], None, False)]


def test_null_prompts_stay(spark):
    df = spark.createDataFrame([(None, "train"), (None, "train"), ("a", "train"), ("a", "test"), (None, "validation")], "prompt string, split string")
    got = sorted((str(r.prompt), r.split) for r in integrity.keep_highest_split(df).collect())
    assert got == [("None", "validation"), ("a", "test")]


def test_values_are_spelled_as_python_spells_them(spark):
    from spindle.functions import text

    values = [1e-05, 1e16, 0.1, -0.0, 1.5e300, float("nan"), float("inf"), 100.0, None]
    df = spark.createDataFrame([(v, [v, 1.0], [["a", None]]) for v in values], "x double, xs array<double>, nested array<array<string>>")
    got = df.select(*(text.spelled(F.col(c), df.schema[c].dataType).alias(c) for c in df.columns), text.joined(F.col("xs"), df.schema["xs"].dataType.elementType).alias("j")).collect()
    assert [tuple(r) for r in got] == [(str(v), str([v, 1.0]), "[['a', None]]", f"{v}, 1.0") for v in values]


def test_labels_have_the_type_of_ids(spark):
    df = spark.createDataFrame([("a b", "c")], "prompt string, response string")
    ids = lambda c: F.transform(prompts.white_space_tokens(c), lambda x: F.ascii(x))
    r = prompts.encoded(df, 9, ids, 0).first()
    assert (r.input_ids, r.labels) == ([97, 98, 99, 0], [-100, -100, 99, 0])
