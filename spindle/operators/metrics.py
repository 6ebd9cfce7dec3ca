"""Scores of generated outputs. Every metric is one aggregate over (reference, output) rows, or over counts of them."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text

RESAMPLES = 500
#: Probabilities that a task sums at once.
WINDOW = 1 << 21


def predicted(output: Column) -> Column:
    return F.lower(text.strip(output))


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def confusion(df: DataFrame, labels: Sequence[str]) -> DataFrame:
    """(label, tp, fp, fn) for each configured label, from one aggregate over all rows."""
    p, r = predicted(F.col("output")), F.lower("reference")
    sums = [F.count_if(c).alias(f"{k}{i}") for i, x in enumerate(labels) for k, c in (("tp", (p == x) & (r == x)), ("fp", (p == x) & (r != x)), ("fn", (p != x) & (r == x)))]
    listed = F.array(*(F.struct(F.lit(x).alias("label"), *(F.col(f"{k}{i}").alias(k) for k in ("tp", "fp", "fn"))) for i, x in enumerate(labels)))
    return df.agg(*sums).select(F.inline(listed))


def per_label(counts: DataFrame, *by: str) -> DataFrame:
    """support, predicted, precision, recall and f1 from (label, tp, fp, fn); zero denominators give 0."""
    tp, fp, fn = (F.col(c) for c in ("tp", "fp", "fn"))
    p, r = _ratio(tp, tp + fp), _ratio(tp, tp + fn)
    return counts.select(*by, "label", (tp + fn).alias("support"), (tp + fp).alias("predicted"), p.alias("precision"), r.alias("recall"), _ratio(2 * p * r, p + r).alias("f1"))


def label_scores(df: DataFrame, labels: Sequence[str]) -> DataFrame:
    """(examples, accuracy, macro_f1, invalid_label_outputs) in one row; accuracy of no rows is null."""
    p = predicted(F.col("output"))
    overall = df.agg(F.count("*").alias("examples"), F.avg((p == F.lower("reference")).cast("double")).alias("accuracy"), F.count_if(~p.isin(*labels)).alias("invalid_label_outputs"))
    macro = per_label(confusion(df, labels)).agg((F.sum("f1") / len(labels)).alias("macro_f1"))
    return overall.join(F.broadcast(macro)).select("examples", "accuracy", "macro_f1", "invalid_label_outputs")  # one row each


def covered(concepts: Column, value: Column) -> Column:
    """The part of the concepts, repeats counted, that are words of value; null for no concepts."""
    found = F.filter(concepts, lambda c: F.array_contains(text.words(value), F.lower(c)))
    return F.try_divide(F.size(found).cast("double"), F.size(concepts))


def concept_coverage(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("examples"), *(F.avg(covered(F.col("concepts"), F.col(c))).alias(f"mean_{c}_concept_fraction") for c in ("output", "reference")))


def longest_common(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence: rows of the table as bits of one integer."""
    places: dict[str, int] = {}
    for i, w in enumerate(a):
        places[w] = places.get(w, 0) | 1 << i
    row, full = 0, (1 << len(a)) - 1
    for w in b:
        grown = row | places.get(w, 0)
        row = grown & ~(grown - (row << 1 | 1)) & full
    return row.bit_count()


@F.arrow_udf(T.DoubleType())
def _rouge(a: pa.Array, b: pa.Array) -> pa.Array:
    return pa.array([2 * longest_common(x, y) / (len(x) + len(y)) if x and y else 0.0 for x, y in zip(a.to_pylist(), b.to_pylist())], pa.float64())


def rouge_l(df: DataFrame) -> DataFrame:
    """df with rouge_l, the F1 of the longest common subsequence of words; 0 if a side has none."""
    return df.withColumn("rouge_l", _rouge(text.words(F.col("reference")), text.words(F.col("output"))))


def response_loss(df: DataFrame, *by: str) -> DataFrame:
    """Token-weighted mean loss and its perplexity; null where there are no tokens."""
    mean = F.try_divide(F.sum(F.col("loss") * F.col("tokens")), F.sum("tokens"))
    return df.groupBy(*by).agg(F.sum("tokens").alias("tokens"), mean.alias("response_loss")).withColumn("perplexity", F.exp("response_loss"))


def binomial_quantiles(u: np.ndarray, n: np.ndarray, p: float) -> np.ndarray:
    """The least k of each n draws of chance p whose probability to be reached at most is u or more.

    Probabilities are summed from the ratios of neighbours over the k within nine deviations of the mean, and 40 more; what lies
    beyond is less than the steps of u.
    """
    if p <= 0.0 or p >= 1.0:
        return n if p > 0.0 else np.zeros_like(n)
    out = np.empty_like(n)
    reach = 9 * math.sqrt(float(n.max(initial=0)) * p * (1 - p)) + 40
    low = np.maximum(0, np.floor(n * p - reach)).astype(np.int64)
    width = int(2 * reach) + 3
    for first in range(0, len(n), max(1, WINDOW // width)):
        some = slice(first, first + max(1, WINDOW // width))
        k, left = low[some, None] + np.arange(width), n[some, None]
        ratio = np.where(k < left, (left - k).clip(min=1) / (k + 1.0) * (p / (1 - p)), 1.0)
        logs = np.concatenate([np.zeros((len(k), 1)), np.cumsum(np.log(ratio[:, :-1]), axis=1)], axis=1)
        weight = np.where(k <= left, np.exp(logs - logs.max(1, keepdims=True)), 0.0)
        upto = np.cumsum(weight, axis=1)
        out[some] = low[some] + (upto < u[some, None] * upto[:, -1:]).sum(1)
    return np.minimum(out, n)


def resampled(spark: SparkSession, cells: Sequence[tuple[str, str, int]], seed: int, resamples: int) -> DataFrame:
    """(resample, counts): how often each cell is drawn in n draws with replacement from n = all cases.

    The counts of a resample are a chain of binomial draws: of what the cells before have left, each cell takes a share. A
    draw inverts the distribution at a number made from the seed, the resample and the cell's labels, so there are
    resamples * cells draws, whatever n is, and no partitioning changes them.
    """
    n, sizes = sum(c[2] for c in cells), [c[2] for c in cells]
    number = lambda c: (F.conv(F.substring(text.draw_key(seed, F.col("id"), F.lit(c[0]), F.lit(c[1])), 1, 13), 16, 10).cast("double") + 0.5) / 2.0**52
    rows = spark.range(resamples).select(F.col("id").alias("resample"), F.array(*map(number, cells)).alias("u"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            u = batch.column("u").flatten().to_numpy().reshape(-1, len(sizes))
            left, rest, counts = np.full(len(u), n, np.int64), n, np.empty(u.shape, np.int64)
            for i, size in enumerate(sizes):
                counts[:, i] = binomial_quantiles(u[:, i], left, size / rest if rest else 0.0)
                left, rest = left - counts[:, i], rest - size
            yield pa.RecordBatch.from_arrays([batch.column("resample"), pa.array(list(counts), pa.list_(pa.int64()))], ["resample", "counts"])

    return rows.mapInArrow(run, "resample bigint, counts array<bigint>")


def bootstrap(spark: SparkSession, cells: Sequence[tuple[str, str, int]], labels: Sequence[str], seed: int, resamples: int = RESAMPLES) -> DataFrame:
    """(metric, lower, upper): percentile intervals of accuracy and macro-F1 by resampling cases with replacement.

    A case matters by its (reference, predicted) cell alone, so a resample is a count for each cell; there are as many cells
    as the square of the number of labels, and one for the rest, at most.
    """
    n = sum(c[2] for c in cells)
    if not n:
        return spark.createDataFrame([(m, None, None) for m in ("accuracy", "macro_f1")], "metric string, lower double, upper double")
    drawn = resampled(spark, cells, seed, resamples)
    n_if = lambda test: sum((F.col("counts")[i] for i, (r, p, _) in enumerate(cells) if test(r, p)), F.lit(0))
    sums = [n_if(test).alias(f"{k}{i}") for i, x in enumerate(labels) for k, test in (("tp", lambda r, p, x=x: p == r == x), ("fp", lambda r, p, x=x: p == x != r), ("fn", lambda r, p, x=x: r == x != p))]
    per = drawn.select(n_if(lambda r, p: p == r).alias("right"), *sums)
    f1 = [_ratio(2 * F.col(f"tp{i}"), 2 * F.col(f"tp{i}") + F.col(f"fp{i}") + F.col(f"fn{i}")) for i in range(len(labels))]
    macro = F.lit(0.0)
    for x in f1:
        macro = macro + x
    scored = per.select((F.col("right") / F.lit(float(n))).alias("accuracy"), (macro / len(labels)).alias("macro_f1"))
    low, high = int(0.025 * (resamples - 1)), int(0.975 * (resamples - 1))
    sorted_values = scored.agg(*(F.sort_array(F.collect_list(m)).alias(m) for m in ("accuracy", "macro_f1")))  # resamples values
    return sorted_values.select(F.inline(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m)[low].alias("lower"), F.col(m)[high].alias("upper")) for m in ("accuracy", "macro_f1")))))


def cells_of(df: DataFrame, labels: Sequence[str]) -> list[tuple[str, str, int]]:
    """Counts of (reference, predicted); a label that is not configured is ``!``, or ``=`` where both are equal."""
    p, r = predicted(F.col("output")), F.lower("reference")
    same = (p == r) & ~p.isin(*labels)
    kind = lambda c: F.when(same, "=").when(c.isin(*labels), c).otherwise("!")
    rows = df.groupBy(F.when(same, "=").otherwise(F.when(r.isin(*labels), r).otherwise("?")).alias("r"), kind(p).alias("p")).count().collect()
    return sorted((x["r"], x["p"], x["count"]) for x in rows)


def confusion_matrix(df: DataFrame) -> DataFrame:
    return df.groupBy(F.lower("reference").alias("reference"), predicted(F.col("output")).alias("predicted")).agg(F.count("*").alias("rows"))
