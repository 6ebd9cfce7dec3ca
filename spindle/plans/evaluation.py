"""One evaluation of a run, and the sample that a training run starts from. Models stay outside: the caller's function adds output, loss and tokens."""

from __future__ import annotations

import json
from collections.abc import Callable
from pathlib import Path
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import metrics, prompts, sampling
from ..sources import tables
from . import lineage, workflow
from .config import check_task, preparation_spec

# How many rows an evaluation scores and how many it generates where nothing else is said.
ROWS, GENERATED, SAVE_STEPS = 128, 5, 100


def _labels(task: dict, what: str) -> list[str]:
    settings = task.get("evaluation") or {}
    if settings.get("metric") != "label_accuracy" or not settings.get("labels"):
        raise ValueError(f"{what} needs a label_accuracy task with labels")
    return settings["labels"]


def evaluation_sizes(task: dict, per_label: int | None = None, rows: int | None = None, generated: int | None = None) -> tuple[int, int]:
    """(rows to score, rows to generate); ValueError where the arguments do not go together."""
    if per_label is None:
        limit = ROWS if rows is None else rows
        generated = (task.get("evaluation") or {}).get("generation_examples", GENERATED) if generated is None else generated
    else:
        if rows is not None:
            raise ValueError("per_label and rows exclude each other")
        if per_label < 1:
            raise ValueError("per_label must be positive")
        limit = per_label * len(_labels(task, "per_label"))
        if generated not in (None, limit):
            raise ValueError("a balanced evaluation generates every selected row")
        generated = limit
    if limit < 1 or generated < 1:
        raise ValueError("numbers of rows must be positive")
    return limit, generated


def training_limits(task: dict, train: int | None = None, validation: int | None = None, save_steps: int | None = None, max_steps: int = -1, balanced: bool = False) -> tuple[int, int, list[str] | None]:
    """(training rows, validation rows, labels to balance or None); ValueError out of bounds."""
    given, settings = {"train_samples": train, "validation_samples": validation, "save_steps": save_steps}, {"save_steps": SAVE_STEPS, **task["training"]}
    values = {k: settings[k] if v is None else v for k, v in given.items()}
    if bad := [k for k, v in values.items() if v < 1]:
        raise ValueError(f"must be positive: {', '.join(bad)}")
    if max_steps < 1 and max_steps != -1:
        raise ValueError("max_steps must be -1 or positive")
    labels = _labels(task, "a balanced training sample") if balanced else None
    if labels and values["train_samples"] < len(labels):
        raise ValueError("a balanced training sample needs one row for each label at least")
    return values["train_samples"], values["validation_samples"], labels


def _sized(rows: DataFrame, task: dict, tokenize: Callable[[Column], Column]) -> DataFrame:
    size = F.size(tokenize(F.col("prompt"))) + F.size(tokenize(F.col("response"))) + 1
    return rows.withColumn(workflow.KEY, F.md5(F.to_json(F.struct(*rows.columns)).cast("binary"))).withColumn("_fits", size <= task["max_length"])


def first_fitting(rows: DataFrame, limit: int, seed: int) -> tuple[DataFrame, int]:
    """(the first limit rows that fit, numbered from 0 by ordinal; how many were passed over before the last of them). rows come from _sized."""
    order = sampling.order_key(seed, workflow.KEY)
    taken = rows.where("_fits").withColumn("_order", order).orderBy("_order").limit(limit)
    last = taken.agg(F.count("*").alias("n"), F.max("_order").alias("k")).first()
    seen = rows.where("not _fits") if last["n"] < limit else rows.where(~F.col("_fits") & (order < last["k"]))
    return taken.withColumn("ordinal", F.row_number().over(Window.orderBy("_order")) - 1).drop("_order"), seen.count()


def balanced_fitting(rows: DataFrame, quota: dict[str, int], seed: int) -> tuple[DataFrame, int]:
    """(each label's quota of fitting rows, those passed over before a label's last); ValueError where a label is short.

    What was passed over is told by comparison with the key of each label's last row, so no label's rows meet in a task.
    """
    taken = sampling.balanced(rows, quota, seed, workflow.KEY, fits=F.col("_fits"))
    order = sampling.order_key(seed, workflow.KEY)
    last = {r["label"]: r["k"] for r in taken.groupBy("label").agg(F.max(order).alias("k")).collect()}  # a row for each label
    before = F.lit(False)
    for label, k in last.items():
        before = before | ((sampling.label_of() == label) & (order < k))
    return taken, rows.where(~F.col("_fits") & before).count()


def training_sample(spark: SparkSession, task: dict, data: str, *, train: int | None = None, validation: int | None = None, save_steps: int | None = None, max_steps: int = -1, balanced: bool = False, seed: int = 42, allow_overlap: bool = False, tokenize=prompts.white_space_tokens, end: Any = "</s>") -> dict[str, Any]:
    """What a training run reads: encoded train and validation rows, with the reports of every gate before them. ValueError where one fails."""
    task = check_task(task)
    n_train, n_validation, labels = training_limits(task, train, validation, save_steps, max_steps, balanced)
    if preparation_spec(check_task(workflow.read_json(spark, f"{data}/task_config.json"))) != preparation_spec(task):
        raise ValueError("the data were prepared for another source, prompt or fields")
    audit = workflow.audit(spark, data, strict_overlap=not allow_overlap)
    rows = workflow.read_prepared(spark, data)
    lengths = workflow.length_report(rows, task, tokenize)
    split = lambda name: _sized(rows.where(F.col("split") == name), task, tokenize)
    if labels:
        taken, skipped = balanced_fitting(split("train"), sampling.quotas(n_train, labels), seed)
    else:
        taken, skipped = first_fitting(split("train"), n_train, seed)
    held, held_skipped = first_fitting(split("validation"), n_validation, seed)
    encoded = lambda df: prompts.encoded(df, task["max_length"], tokenize, end)
    out = {"train": encoded(taken), "validation": encoded(held)}
    counts = {k: df.count() for k, df in out.items()}
    if not all(counts.values()):
        raise ValueError(f"no row fits in {task['max_length']} tokens: {counts}")
    by_label = {r["label"]: r["count"] for r in taken.groupBy("label").count().collect()} if labels else {}
    return {**out, "examples": counts, "skipped": {"train": skipped, "validation": held_skipped}, "label_counts": by_label, "audit": audit, "lengths": lengths}


def given_outputs(outputs: DataFrame) -> Callable[[DataFrame, dict], DataFrame]:
    """A score function for evaluate() that looks answers up in outputs(prompt, output, loss, tokens); ValueError where a selected prompt has none, or two."""
    if missing := {"prompt", "output", "loss", "tokens"} - {*outputs.columns}:
        raise ValueError(f"outputs have no {', '.join(sorted(missing))}")

    def score(selected: DataFrame, decoding: dict) -> DataFrame:
        asked = F.broadcast(selected.select("prompt").distinct())  # as many as an evaluation scores
        known = outputs.join(asked, "prompt", "left_semi").groupBy("prompt").agg(F.count_distinct("output", "loss", "tokens").alias("_n"), *(F.first(c).alias(c) for c in ("output", "loss", "tokens")))
        found = selected.join(known, "prompt", "left")
        if bad := found.where("_n is null or _n > 1").select("prompt").first():
            raise ValueError(f"not one output for {bad['prompt']!r}")
        return found.drop("_n")

    return score


def evaluate(spark: SparkSession, run: str, data: str, score: Callable[[DataFrame, dict], DataFrame], *, split: str = "test", per_label: int | None = None, rows: int | None = None, generated: int | None = None, max_new_tokens: int | None = None, seed: int = 42, base: bool = False, tokenize=prompts.white_space_tokens, output: str | None = None) -> dict[str, Any]:
    """Evaluate a run on prepared data, write the result into its folder and return it.

    score(selected, decoding) gets rows of (ordinal, prompt, response, ...) and adds output (for the first generated
    ordinals at least), loss and tokens of each response. ValueError where the run, the data and the arguments do not fit.
    """
    task, manifest = lineage.load_task(run)
    limit, generated = evaluation_sizes(task, per_label, rows, generated)
    summary = json.loads((Path(run) / "run_summary.json").read_text(encoding="utf-8"))
    decoding = dict(manifest["evaluation_decoding"]) if manifest else {**lineage.DECODING, "max_new_tokens": (task.get("evaluation") or {}).get("max_new_tokens", 80), "temperature": 0, "top_p": 1, "repetition_penalty": 1}
    decoding |= {"seed": seed} | ({} if max_new_tokens is None else {"max_new_tokens": max_new_tokens})
    if decoding["max_new_tokens"] < 1:
        raise ValueError("max_new_tokens must be positive")
    if preparation_spec(workflow.read_json(spark, f"{data}/task_config.json")) != preparation_spec(task):
        raise ValueError("the data were prepared for another source, prompt or fields")
    if summary.get("task", task["name"]) != task["name"]:
        raise ValueError("the run's summary is of another task")
    found = workflow.verified_artifacts(spark, data)
    if summary.get("prepared_artifacts", found) != found:
        raise ValueError("prepared files differ from those of the run's summary")
    lineage.check_data(manifest, data.removeprefix("file://"), found)
    candidates = _sized(workflow.read_prepared(spark, data).where(F.col("split") == split), task, tokenize)
    if per_label is None:
        selected, skipped = first_fitting(candidates, limit, seed)
    else:
        chosen = sampling.balanced(candidates, dict.fromkeys(_labels(task, "per_label"), per_label), seed, workflow.KEY)
        selected, skipped = first_fitting(chosen, limit, seed + 1)
        if skipped:
            raise ValueError("a balanced evaluation lost rows to the token limit")
    done = score(selected.drop("_fits", "label", "nth"), decoding).orderBy("ordinal").collect()  # limit rows
    cases = [r.asDict(True) for r in done]
    examples = [{"prompt": c["prompt"], "reference": c["response"], "inputs": c.get("inputs") or {}, "output": c["output"]} for c in cases[:generated]]
    if not sum(c["tokens"] for c in cases):
        raise ValueError(f"no row of {split} fits in {task['max_length']} tokens")
    loss = metrics.response_loss(spark.createDataFrame([(float(c["loss"]), int(c["tokens"])) for c in cases], "loss double, tokens long")).first()
    concepts = [[str(x) for x in (e["inputs"].get("concepts") or [])] for e in examples]
    generations = spark.createDataFrame([(e["reference"], e["output"], c) for e, c in zip(examples, concepts)], "reference string, output string, concepts array<string>")
    interval = workflow.intervals(spark, generations, task, seed)
    result = {
        "task": task["name"], "run_dir": str(run), "split": split, "model": "starting_model" if base else "trained_run", "sampling": {"method": "random", "seed": seed} if per_label is None else {"method": "balanced_per_label", "per_label": per_label, "seed": seed},
        "training_seed": summary.get("seed"), "prepared_artifacts": found, "run_manifest_schema": manifest and manifest["schema_version"], "decoding": decoding, f"{split}_examples": len(cases), "skipped_for_length": skipped,
        "response_tokens": loss["tokens"], "response_loss": loss["response_loss"], "response_perplexity": loss["perplexity"], "generation_metric": workflow.generation_metric(generations, task), "generation_confidence_interval": interval, "examples": examples,
    }
    name = ("" if per_label is None else f"balanced_{per_label}_") + ("base_" if base else "") + f"{split}_evaluation.json"
    tables.report(output or Path(run) / name, result)
    return result
