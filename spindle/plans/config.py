"""Task configuration: one JSON object, checked by tables of rules on the driver, whose values become literals of plans."""

from __future__ import annotations

import json
import re
import string
from collections.abc import Callable
from pathlib import Path
from typing import Any

TRANSFORMS = ("strip", "title", "lower", "join_comma")
METRICS = ("label_accuracy", "concept_coverage_exact", "rouge_l_f1")
Check = Callable[[Any], bool]

is_text: Check = lambda v: isinstance(v, str) and bool(v.strip())
is_count: Check = lambda v: type(v) is int and v > 0
is_number: Check = lambda v: type(v) in (int, float)
is_positive: Check = lambda v: is_number(v) and v > 0
is_flag: Check = lambda v: type(v) is bool
is_object: Check = lambda v: isinstance(v, dict)
is_texts: Check = lambda v: isinstance(v, list) and bool(v) and all(map(is_text, v))
is_thresholds: Check = lambda v: is_object(v) and all(isinstance(k, str) and is_number(x) and -1 <= x <= 1 for k, x in v.items())

#: (path, check, needed, what it must be). A path that is not needed may be missing.
RULES: list[tuple[str, Check, bool, str]] = [
    ("name", lambda v: isinstance(v, str) and bool(re.fullmatch("[a-z][a-z0-9_]*", v)), True, "lower-case letters, digits and underscores"),
    ("source", is_object, True, "an object"),
    ("source.dataset", is_text, True, "text that is not empty"),
    *((f"source.{k}", lambda v: v is None or is_text(v), False, "text or null") for k in ("train_split", "validation_split", "test_split", "config", "group_field", "revision")),
    ("source.heldout_fraction", lambda v: is_number(v) and 0 < v < 1, False, "between 0 and 1"),
    ("source.data_files", lambda v: isinstance(v, (str, list, dict)), False, "a path, a list or a mapping from splits to paths"),
    *((k, is_text, True, "text that is not empty") for k in ("prompt_template", "response_field", "base_model")),
    ("base_model_revision", lambda v: v is None or is_text(v), False, "text that is not empty"),
    ("prompt_version", is_text, False, "text that is not empty"),
    ("max_length", lambda v: type(v) is int and v >= 32, True, "at least 32"),
    ("response_map", is_object, False, "an object"),
    ("field_transforms", is_object, False, "an object"),
    ("training", is_object, True, "an object"),
    ("training.method", lambda v: v in ("full", "lora"), True, "full or lora"),
    *((f"training.{k}", is_count, True, "a positive integer") for k in ("train_samples", "validation_samples", "batch_size", "gradient_accumulation_steps")),
    *((f"training.{k}", is_positive, True, "positive") for k in ("learning_rate", "epochs")),
    ("training.gradient_checkpointing", is_flag, False, "true or false"),
    *((f"training.{k}", is_count, False, "a positive integer") for k in ("torch_empty_cache_steps", "save_steps")),
    ("data_quality", is_object, False, "an object"),
    *((f"data_quality.{k}", is_flag, False, "true or false") for k in ("fail_on_near_duplicate", "fail_on_pii", "fail_on_secret")),
    ("data_quality.max_overlength_fraction", lambda v: is_number(v) and 0 <= v <= 1, False, "between 0 and 1"),
    ("evaluation", is_object, False, "an object"),
    ("evaluation.metric", lambda v: v is None or v in METRICS, False, "a known metric"),
    *((f"evaluation.{k}", is_count, False, "a positive integer") for k in ("generation_examples", "max_new_tokens")),
    ("promotion", lambda v: v is None or is_object(v), False, "an object"),
]
LORA = [
    *((f"training.{k}", is_count, True, "a positive integer") for k in ("lora_rank", "lora_alpha")),
    ("training.lora_dropout", lambda v: is_number(v) and 0 <= v < 1, True, "between 0 and 1"),
    ("training.lora_targets", is_texts, True, "a list of module names"),
]
LABELS = [("evaluation.labels", lambda v: is_texts(v) and len(set(v)) == len(v), True, "a list of different labels")]
PROMOTION = [
    ("promotion.minimum_metrics", lambda v: is_thresholds(v) and bool(v), True, "thresholds between -1 and 1, one at least"),
    ("promotion.minimum_lift", is_thresholds, False, "thresholds between -1 and 1"),
    ("promotion.minimum_examples", is_count, False, "a positive integer"),
    ("promotion.maximum_invalid_label_outputs", lambda v: type(v) is int and v >= 0, False, "an integer from 0"),
]
_MISSING = object()


def _get(task: dict, path: str) -> Any:
    at: Any = task
    for key in path.split("."):
        if not isinstance(at, dict) or key not in at:
            return _MISSING
        at = at[key]
    return at


def _hold(task: dict, rules: list) -> None:
    for path, check, needed, said in rules:
        value = _get(task, path)
        if value is _MISSING:
            if needed:
                raise ValueError(f"task configuration: {path} is missing")
        elif not check(value):
            raise ValueError(f"task configuration: {path} must be {said}")


def template_fields(template: str) -> list[str]:
    """The placeholders of a prompt template, in the order of their first use."""
    try:
        parts = list(string.Formatter().parse(template))
    except ValueError as e:
        raise ValueError(f"task configuration: prompt_template: {e}") from e
    fields = [p[1] for p in parts if p[1] is not None]
    if any(p[2] or p[3] for p in parts) or not all(re.fullmatch("[a-zA-Z_][a-zA-Z0-9_]*", f) for f in fields):
        raise ValueError("task configuration: prompt_template may hold plain field names alone")
    if not fields:
        raise ValueError("task configuration: prompt_template has no field")
    return list(dict.fromkeys(fields))


def check_task(task: Any) -> dict:
    """The task with input_fields added; ValueError names the first key that breaks a rule."""
    if not isinstance(task, dict):
        raise ValueError("task configuration must be an object")
    _hold(task, RULES)
    if task["training"]["method"] == "lora":
        _hold(task, LORA)
    if _get(task, "evaluation.metric") == "label_accuracy":
        _hold(task, LABELS)
    if task.get("promotion") is not None:
        _hold(task, PROMOTION)
    fields = template_fields(task["prompt_template"])
    for field, mode in task.get("field_transforms", {}).items():
        if field not in fields or mode not in TRANSFORMS:
            raise ValueError(f"task configuration: field_transforms.{field} must name a prompt field and a known transform")
    return task | {"input_fields": fields}


def load_task(path: str | Path) -> dict:
    return check_task(json.loads(Path(path).read_text(encoding="utf-8")))


def preparation_spec(task: dict) -> dict:
    """What the prepared rows depend on. Two tasks with equal specs prepare equal data."""
    keys = ("name", "source", "prompt_template", "response_field", "response_map", "field_transforms")
    return {k: task.get(k) for k in keys} | {"prompt_version": task.get("prompt_version", "v1")}
