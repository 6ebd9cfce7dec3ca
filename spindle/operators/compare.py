"""Comparison of evaluations: aligned cases, side-by-side labels, lifts, seeds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def differing_cases(a: DataFrame, b: DataFrame) -> DataFrame:
    """Ordinals at which two lists of (ordinal, prompt, reference) differ, or that only one of them has."""
    x, y = a.alias("x"), b.alias("y")
    same = F.col("x.prompt").eqNullSafe(F.col("y.prompt")) & F.col("x.reference").eqNullSafe(F.col("y.reference")) & F.col("x.ordinal").isNotNull() & F.col("y.ordinal").isNotNull()
    return x.join(y, F.col("x.ordinal") == F.col("y.ordinal"), "full").where(~same).select(F.coalesce("x.ordinal", "y.ordinal").alias("ordinal"), F.col("x.prompt").alias("first_prompt"), F.col("y.prompt").alias("second_prompt"))


def side_by_side(a: DataFrame, b: DataFrame) -> DataFrame:
    """(label, support, first_recall, second_recall, first_f1, second_f1, same_support) of two per-label tables."""
    x, y = a.alias("x"), b.alias("y")
    cols = [F.col(f"{t}.{m}").alias(f"{n}_{m}") for m in ("recall", "f1") for t, n in (("x", "first"), ("y", "second"))]
    return x.join(y, F.col("x.label") == F.col("y.label")).select(F.col("x.label").alias("label"), F.col("x.support").alias("support"), *cols, (F.col("x.support") == F.col("y.support")).alias("same_support"))


def lifts(evaluations: DataFrame, *metrics: str) -> DataFrame:
    """For each trained evaluation its metrics less those of the same run's base: rows of (run, split, model, metrics).

    Where there are columns sampling or decoding, the base must agree in them too.
    """
    t = evaluations.where("model = 'trained_run'").alias("t")
    b = evaluations.where("model = 'starting_model'").alias("b")
    more = [c for c in ("sampling", "decoding") if c in evaluations.columns]
    same = F.lit(True)
    for c in ("run", "split", *more):
        same = same & F.col(f"t.{c}").eqNullSafe(F.col(f"b.{c}"))
    joined = t.join(b, same, "left")
    return joined.select("t.run", "t.split", *(f"t.{c}" for c in more), *(F.col(f"t.{m}").alias(m) for m in metrics), *((F.col(f"t.{m}") - F.col(f"b.{m}")).alias(f"{m}_lift") for m in metrics), F.col("b.run").isNotNull().alias("has_base"))


def changes(a: DataFrame, b: DataFrame) -> DataFrame:
    """Cases that the second of two evaluations of (ordinal, correct) gains, loses, keeps right and keeps wrong."""
    x, y = a.alias("x"), b.alias("y")
    p, q = F.col("x.correct"), F.col("y.correct")
    return x.join(y, F.col("x.ordinal") == F.col("y.ordinal")).agg(F.count_if(~p & q).alias("gained"), F.count_if(p & ~q).alias("lost"), F.count_if(p & q).alias("kept"), F.count_if(~p & ~q).alias("missed"))


def with_settings(evaluations: DataFrame, runs: DataFrame) -> DataFrame:
    return evaluations.join(runs, "run", "left")


def seed_summary(evaluations: DataFrame, *metrics: str) -> DataFrame:
    """(group, seeds, and for each metric mean, sample_std and values by seed) of rows (group, seed, metrics)."""
    aggs = [a for m in metrics for a in (F.avg(m).alias(f"{m}_mean"), F.stddev_samp(m).alias(f"{m}_std"), F.transform(F.array_sort(F.collect_list(F.struct("seed", F.col(m).alias("v")))), lambda x: x["v"]).alias(f"{m}_values"))]
    return evaluations.groupBy("group").agg(F.count("*").alias("runs"), *aggs)


def seed_faults(evaluations: DataFrame, *signature: str) -> DataFrame:
    """(group, fault) where runs of a group are fewer than two, differ in their signature, or do not have distinct seeds."""
    s = evaluations.withColumn("_s", F.to_json(F.struct(*signature), {"ignoreNullFields": "false"}))
    one = s.groupBy("group").agg(F.count("*").alias("n"), F.countDistinct("_s").alias("signatures"), F.countDistinct("seed").alias("seeds"), F.count_if(F.col("model") != "trained_run").alias("base"))
    faults = F.array_compact(F.array(
        F.when(F.col("n") < 2, "fewer than two runs"),
        F.when(F.col("base") > 0, "not a trained run"),
        F.when(F.col("signatures") > 1, "signatures differ"),
        F.when(F.col("seeds") < F.col("n"), "seeds repeat"),
    ))
    return one.select("group", F.explode(faults).alias("fault"))
