"""Policies over reports: what stops a preparation, a training run or a promotion. Reports are small; gates run on the driver."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import PII


def overlap_gate(overlap: Mapping[str, int], strict: bool) -> str | None:
    """A warning, or ValueError if strict, when prompts are shared by splits."""
    if not any(overlap.values()):
        return None
    said = f"prompts are shared by splits: {dict(overlap)}"
    if strict:
        raise ValueError(said)
    return said


def quality_gate(task: dict, pairs: Mapping[str, int], sensitive: Sequence[tuple[str, str, int]], *, near_duplicates: bool = False, pii: bool = False) -> None:
    """ValueError where the task's policy forbids what was found: secrets unless allowed, the others if asked for."""
    policy = task.get("data_quality", {})
    total = lambda personal: sum(n for _, kind, n in sensitive if (kind in PII) == personal)
    if (near_duplicates or policy.get("fail_on_near_duplicate", False)) and any(pairs.values()):
        raise ValueError(f"near-duplicate inputs across splits: {dict(pairs)}")
    if (pii or policy.get("fail_on_pii", False)) and total(True):
        raise ValueError(f"{total(True)} matches of personal data by split and type")
    if policy.get("fail_on_secret", True) and total(False):
        raise ValueError(f"{total(False)} matches of secrets by split and type")


def sensitive_verdicts(sensitive: DataFrame, fail_on_pii: bool = False, fail_on_secret: bool = True) -> DataFrame:
    """(split, pii, secrets, status) of (split, type, rows): the totals that the policy looks at, and what it says of each split."""
    of = lambda personal: F.sum(F.when(F.col("type").isin(*PII) == personal, F.col("rows")).otherwise(0))
    totals = sensitive.groupBy("split").agg(of(True).alias("pii"), of(False).alias("secrets"))
    bad = (F.lit(fail_on_pii) & (F.col("pii") > 0)) | (F.lit(fail_on_secret) & (F.col("secrets") > 0))
    return totals.withColumn("status", F.when(bad, "rejected").otherwise("passed"))


def length_verdicts(audit: DataFrame, most: float) -> DataFrame:
    """length_audit's rows with status: rejected where more than the fraction most is over the limit."""
    return audit.withColumn("status", F.when(F.col("fraction_over") > most, "rejected").otherwise("passed"))


def promotion_faults(task: dict, trained: dict, base: dict, run: str) -> list[str]:
    """What makes two evaluations unfit to decide on a promotion."""
    faults = [] if task.get("promotion") else ["the task has no promotion policy"]
    for e, model in ((trained, "trained_run"), (base, "starting_model")):
        for key, want in (("model", model), ("split", "test"), ("run_dir", run), ("task", task["name"])):
            if e.get(key) != want:
                faults.append(f"{model}: {key} is {e.get(key)!r}, not {want!r}")
    faults += [f"{k} differ" for k in ("prepared_artifacts", "sampling", "decoding") if trained.get(k) != base.get(k)]
    cases = [[(c["prompt"], c["reference"]) for c in e.get("examples", ())] for e in (trained, base)]
    if not cases[0] or cases[0] != cases[1]:
        faults.append("the cases differ, or there are none")
    if (trained.get("generation_metric") or {}).get("metric") != (base.get("generation_metric") or {}).get("metric"):
        faults.append("the metrics differ")
    return faults


def promotion_failures(runs: DataFrame, policy: dict) -> DataFrame:
    """runs with failures and status. Columns: examples, invalid_label_outputs, each metric of the policy, and base_<metric>."""
    below = lambda c, least: c.isNull() | (c < least)
    found = [F.when(F.col("examples") < policy.get("minimum_examples", 1), "examples")]
    found += [F.when(below(F.col(m), v), m) for m, v in policy["minimum_metrics"].items()]
    found += [F.when(below(F.col(m) - F.col(f"base_{m}"), v), f"{m}_lift") for m, v in policy.get("minimum_lift", {}).items()]
    found += [F.when(F.coalesce("invalid_label_outputs", F.lit(0)) > policy.get("maximum_invalid_label_outputs", 0), "invalid_label_outputs")]
    failures = F.array_compact(F.array(*found))
    return runs.withColumn("failures", failures).withColumn("status", F.when(F.size("failures") > 0, "rejected").otherwise("promoted"))


def promote(task: dict, trained: dict, base: dict, run: str, spark) -> dict[str, Any]:
    """The decision on one run; ValueError if its evaluations are unfit."""
    if faults := promotion_faults(task, trained, base, run):
        raise ValueError("; ".join(faults))
    policy = task["promotion"]
    metrics = {*policy["minimum_metrics"], *policy.get("minimum_lift", {})}
    t, b = trained["generation_metric"], base["generation_metric"]
    number = lambda v: float(v) if isinstance(v, (int, float)) else None
    row = {"examples": len(trained["examples"]), "invalid_label_outputs": t.get("invalid_label_outputs", 0)}
    row |= {m: number(t.get(m)) for m in metrics} | {f"base_{m}": number(b.get(m)) for m in metrics}
    schema = ", ".join(f"`{k}` {'bigint' if k in ('examples', 'invalid_label_outputs') else 'double'}" for k in row)
    decided = promotion_failures(spark.createDataFrame([tuple(row.values())], schema), policy).first()
    return {"task": task["name"], "run_dir": run, "status": decided["status"], "failures": decided["failures"], "policy": policy, "metrics": t, "base_metrics": b}
