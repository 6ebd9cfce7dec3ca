import copy

import pytest

from spindle.plans.config import check_task, load_task, preparation_spec

TASK = {
    "name": "t_1", "source": {"dataset": "parquet"}, "prompt_template": "Say {{x}} {b} then {a} and {b}\n", "response_field": "r", "base_model": "m", "max_length": 32,
    "training": {"method": "lora", "train_samples": 1, "validation_samples": 1, "batch_size": 1, "gradient_accumulation_steps": 1, "learning_rate": 0.1, "epochs": 1, "lora_rank": 8, "lora_alpha": 16, "lora_dropout": 0.0, "lora_targets": ["q"]},
    "evaluation": {"metric": "label_accuracy", "labels": ["x", "y"]}, "promotion": {"minimum_metrics": {"accuracy": 0.5}},
}


def test_valid(tmp_path):
    assert check_task(TASK)["input_fields"] == ["b", "a"]
    import json

    (tmp_path / "t.json").write_text(json.dumps(TASK))
    assert load_task(tmp_path / "t.json")["name"] == "t_1"


BAD = [
    ("name", "Bad"), ("source.dataset", " "), ("source.heldout_fraction", True), ("source.heldout_fraction", 1), ("source.data_files", 5), ("source.revision", ""), ("prompt_template", "none"), ("prompt_template", "{a.b}"),
    ("prompt_template", "{a!r}"), ("prompt_template", "{"), ("response_field", ""), ("max_length", 31), ("max_length", True), ("prompt_version", ""), ("response_map", []), ("field_transforms", {"c": "strip"}),
    ("field_transforms", {"a": "upper"}), ("training.method", "other"), ("training.batch_size", 0), ("training.batch_size", True), ("training.epochs", 0), ("training.lora_rank", None), ("training.lora_dropout", 1),
    ("training.lora_targets", []), ("training.gradient_checkpointing", 1), ("training.save_steps", 0), ("data_quality", []), ("data_quality", {"fail_on_pii": "yes"}), ("data_quality", {"max_overlength_fraction": 2}),
    ("evaluation.metric", "bleu"), ("evaluation.labels", ["x", "x"]), ("evaluation.labels", []), ("promotion.minimum_metrics", {}), ("promotion.minimum_metrics", {"a": 2}), ("promotion.minimum_lift", {"a": "1"}),
    ("promotion.minimum_examples", 0), ("promotion.maximum_invalid_label_outputs", -1),
]


@pytest.mark.parametrize("path,value", BAD)
def test_each_rule_names_its_key(path, value):
    task = copy.deepcopy(TASK)
    at = task
    *way, last = path.split(".")
    for k in way:
        at = at[k]
    at[last] = value
    with pytest.raises(ValueError, match=last.split(".")[-1]):
        check_task(task)


@pytest.mark.parametrize("key", ["name", "source", "prompt_template", "response_field", "base_model", "max_length", "training"])
def test_missing(key):
    with pytest.raises(ValueError, match=key):
        check_task({k: v for k, v in TASK.items() if k != key})


def test_spec():
    assert preparation_spec(TASK) == preparation_spec(TASK | {"training": {}, "prompt_version": "v1"})
    assert preparation_spec(TASK) != preparation_spec(TASK | {"prompt_version": "v2"})
