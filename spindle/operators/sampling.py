"""Seeded orders, samples and splits. The order is that of md5(seed:key): it depends on no partitioning.

The k smallest keys of a table are found by a threshold, from counts of key prefixes, so no operator sorts a whole
table in one task.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from decimal import ROUND_HALF_EVEN, Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text
from ..sources.tables import scratch

#: Hexadecimal digits by which candidates are narrowed, and rows that are few enough to order.
DIGITS, FEW = 3, 10_000


def prefix_counts(rows: DataFrame, key: Column, prefix: str = "") -> list[tuple[str, int]]:
    """Sorted (next digits, rows) of the keys that start with prefix: 16 ** DIGITS entries at most."""
    inside = rows.where(key.startswith(prefix)) if prefix else rows
    return sorted((r["p"], r["count"]) for r in inside.groupBy(F.substring(key, len(prefix) + 1, DIGITS).alias("p")).count().collect())


def kth_key(df: DataFrame, key: Column, k: int, counts: list[tuple[str, int]] | None = None) -> str | None:
    """The k-th smallest key (md5 digits, then anything), or None where there are fewer rows; counts are those of the first digits, if known."""
    rows, own, prefix, left = df.select(key.alias("_k")), F.col("_k"), "", k
    while True:
        for p, n in prefix_counts(rows, own, prefix) if counts is None else counts:
            if left <= n:
                break
            left -= n
        else:
            return None
        prefix, counts = prefix + p, None
        if n <= FEW or len(prefix) + DIGITS > 32:
            return rows.where(own.startswith(prefix)).orderBy("_k").limit(left).agg(F.max("_k")).first()[0]


def running_totals(df: DataFrame, key: Column, value: Column | None = None, name: str = "before") -> DataFrame:
    """df, written, with name: the sum of value (null: 0), or the number of rows, over all rows whose key is smaller. Keys must differ from row to row.

    Two levels: rows are dealt to ranges of the key, bounded by a sample of the keys, and written. Each range is summed on its
    own, and then the totals of the ranges before it, of which there is one a range, are added. No task sees more than a range.
    """
    k, part, each, first = (f"_spindle_{x}" for x in ("key", "part", "each", "first"))
    dealt = df.withColumns({k: key, each: F.lit(1) if value is None else F.coalesce(value, F.lit(0))}).repartitionByRange(k).withColumn(part, F.spark_partition_id())
    path = scratch(df.sparkSession)
    dealt.write.parquet(path)
    rows = df.sparkSession.read.schema(dealt.schema).parquet(path)
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy(part).agg(F.sum(each).alias("n"))
    firsts = totals.select(part, F.coalesce(F.sum("n").over(before(Window.orderBy(part))), F.lit(0)).alias(first))
    within = F.coalesce(F.sum(each).over(before(Window.partitionBy(part).orderBy(k))), F.lit(0))
    return rows.join(F.broadcast(firsts), part).withColumn(name, F.col(first) + within).select(*(f"`{c}`" for c in df.columns), name)


def write_in_order(df: DataFrame, path: str, key: Column, kind: str = "json") -> None:
    """df as files whose names are in the order of the keys, the rows of each in that order too: one ordered file for each range of the key."""
    k = "_spindle_key"
    dealt = df.withColumn(k, key).repartitionByRange(k).sortWithinPartitions(k)
    dealt.drop(k).write.format(kind).mode("errorifexists").save(path)


def order_key(seed: int, *key: str) -> Column:
    """md5 digits, then the key itself: a total order of different keys."""
    return F.concat_ws(":", text.draw_key(seed, *(F.col(k) for k in key)), *(F.col(k).cast("string") for k in key))


def first_k(df: DataFrame, k: int, seed: int, *key: str) -> DataFrame:
    """The first k rows of the seeded order, as a filter."""
    limit = kth_key(df, order_key(seed, *key), k)
    return df if limit is None else df.where(order_key(seed, *key) <= limit)


def slice_k(df: DataFrame, offset: int, k: int, seed: int, *key: str) -> DataFrame:
    """k rows of the seeded order after the first offset ones."""
    rows = first_k(df, offset + k, seed, *key)
    start = kth_key(rows, order_key(seed, *key), offset) if offset else ""
    return rows.limit(0) if start is None else rows.where(order_key(seed, *key) > start)


def until_k_fit(df: DataFrame, fits: Column, k: int, seed: int, *key: str) -> DataFrame:
    """The rows of the seeded order up to the k-th that fits, as one filter."""
    limit = kth_key(df.where(fits), order_key(seed, *key), k)
    return df if limit is None else df.where(order_key(seed, *key) <= limit)


def first_k_that_fit(df: DataFrame, fits: Column, k: int, seed: int, *key: str) -> tuple[DataFrame, DataFrame]:
    """(the first k fitting rows, those that were passed over before the k-th was found)."""
    seen = until_k_fit(df, fits, k, seed, *key)
    return seen.where(fits), seen.where(~fits)


def quotas(limit: int, labels: Sequence[str]) -> dict[str, int]:
    each, extra = divmod(limit, len(labels))
    return {x: each + (i < extra) for i, x in enumerate(labels)}


def label_of(response: str = "response") -> Column:
    return F.lower(text.strip(F.col(response)))


def balanced(df: DataFrame, quota: dict[str, int], seed: int, *key: str, fits: Column | None = None, response: str = "response") -> DataFrame:
    """For each label its quota of rows in seeded order, without replacement; ValueError where a label has too few."""
    label = label_of(response)
    rows = df.withColumn("label", label).where(F.col("label").isin(*quota))
    have = {r["label"]: r for r in rows.groupBy("label").agg(F.count("*").alias("n"), (F.count_if(fits) if fits is not None else F.count("*")).alias("fit")).collect()}
    for x, n in quota.items():
        for part, what in (("n", "found"), ("fit", "fit")):
            if (got := have[x][part] if x in have else 0) < n:
                raise ValueError(f"label {x} needs {n} rows; {got} {what}")
    rows = rows if fits is None else rows.where(fits)
    nth = F.row_number().over(Window.partitionBy("label").orderBy(order_key(seed, *key)))
    need = F.create_map(*(F.lit(v) for kv in quota.items() for v in kv))
    return rows.withColumn("nth", nth).where(F.col("nth") <= max(quota.values())).where(F.col("nth") <= need[F.col("label")])


def percent_split(df: DataFrame, fraction: float, seed: int, *key: str) -> DataFrame:
    """df with split: ceil(n * fraction) rows are held out, the first half of them (rounded up) as test. One pass counts the rows for both bounds."""
    k = order_key(seed, *key)
    counts = prefix_counts(df, k)
    held = math.ceil(sum(n for _, n in counts) * fraction)
    test, rest = (kth_key(df, k, x, counts) if x else "" for x in (math.ceil(held / 2), held))
    return df.withColumn("split", F.when(k <= F.lit(test), "test").when(k <= F.lit(rest), "validation").otherwise("train"))


def group_key(df: DataFrame, field: str) -> Column:
    """Lists are compared as sorted lower-case stripped items, other values as such text; as one string."""
    kind = df.schema[field].dataType
    if isinstance(kind, T.ArrayType):
        return F.array_join(F.array_sort(F.transform(text.items_spelled(F.col(field), kind.elementType), lambda x: F.lower(text.strip(x)))), "\x1f")
    return F.lower(text.strip(text.spelled(F.col(field), kind)))


def held_count(groups: int, fraction: float) -> int:
    """Groups to hold out: the fraction, halves to even, but one at least and one left."""
    return min(groups - 1, max(1, int(Decimal(groups * fraction).quantize(Decimal(1), ROUND_HALF_EVEN))))


def hold_rows(df: DataFrame, fraction: float, seed: int, *key: str) -> DataFrame:
    """df with _held: ceil(n * fraction) rows are."""
    k = order_key(seed, *key)
    counts = prefix_counts(df, k)
    limit = kth_key(df, k, math.ceil(sum(n for _, n in counts) * fraction), counts)
    return df.withColumn("_held", k <= F.lit(limit))


def _groups(df: DataFrame, field: str) -> DataFrame:
    """(_group) of all groups, at least two, written as a table so that df is read once for them."""
    if field not in df.columns:
        raise ValueError(f"no group column {field}")
    path = scratch(df.sparkSession)
    df.select(group_key(df, field).alias("_group")).distinct().write.parquet(path)
    return df.sparkSession.read.schema("_group string").parquet(path)


def _bound(groups: DataFrame, field: str, count: Callable[[int], int], seed: int) -> Column:
    """Whether a row's _group is among the first count(number of groups) ones: a comparison with a bound, so rows need no join."""
    k = order_key(seed, "_group")
    counts = prefix_counts(groups, k)
    n = sum(c for _, c in counts)
    if n < 2:
        raise ValueError(f"{field} has fewer than two groups")
    return k <= F.lit(kth_key(groups, k, count(n), counts))


def hold_groups(df: DataFrame, field: str, count: Callable[[int], int], seed: int) -> DataFrame:
    """df with _held: true for all rows of count(number of groups) groups."""
    held = _bound(_groups(df, field), field, count, seed)
    return df.withColumn("_group", group_key(df, field)).withColumn("_held", held).drop("_group")


def group_split(df: DataFrame, field: str, fraction: float, seed: int) -> DataFrame:
    """df with split; groups stay whole. Half of the held-out groups (rounded down, one at least) are test."""
    groups = _groups(df, field)
    held = _bound(groups, field, lambda n: held_count(n, fraction), seed)
    test = _bound(groups.where(held), field, lambda n: max(1, n // 2), seed + 1)
    return df.withColumn("_group", group_key(df, field)).withColumn("split", F.when(~held, "train").when(test, "test").otherwise("validation")).drop("_group")


def without_leaks(train: DataFrame, test: DataFrame, field: str) -> DataFrame:
    """train without rows whose group occurs in test."""
    keys = test.select(group_key(test, field).alias("_group")).distinct()
    return train.withColumn("_group", group_key(train, field)).join(keys, "_group", "left_anti").drop("_group")


def coverage(df: DataFrame, first: str, second: str, count: int, seed: int, *key: str) -> DataFrame:
    """For the i-th value of first the first seeded row with the (i mod C)-th value of second; ValueError if there is none."""
    values = lambda c: [r[0] for r in df.select(c).distinct().where(F.col(c).isNotNull()).orderBy(c).limit(count).collect()]
    a, b, n = values(first), values(second), df.select(second).distinct().where(F.col(second).isNotNull()).count()
    wanted = [(i, x, b[i % n]) for i, x in enumerate(a)]  # i % n < count
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    pairs = df.sparkSession.createDataFrame(wanted, f"ordinal int, {first} {kinds[first]}, {second} {kinds[second]}")
    nth = F.row_number().over(Window.partitionBy("ordinal").orderBy(order_key(seed, *key)))
    return df.join(F.broadcast(pairs), [first, second]).withColumn("_nth", nth).where("_nth = 1").drop("_nth")
