import hashlib
import json

import pytest
from pyspark.sql import functions as F

from spindle import __main__ as commands
from spindle.plans import evaluation as evaluation_plan
from spindle.plans import lineage, reports, workflow
from spindle.plans.config import check_task
from spindle.streaming import prepare as streams

LABELS = ["sadness", "joy", "love"]
TASK = {
    "name": "emotion", "source": {"dataset": "json", "heldout_fraction": 0.4}, "prompt_template": "Classify: {text}\n", "response_field": "label", "response_map": dict(zip("012", LABELS)), "base_model": "m", "max_length": 32,
    "training": {"method": "full", "train_samples": 1, "validation_samples": 1, "batch_size": 1, "gradient_accumulation_steps": 1, "learning_rate": 0.1, "epochs": 1},
    "evaluation": {"metric": "label_accuracy", "labels": LABELS}, "promotion": {"minimum_examples": 2, "minimum_metrics": {"accuracy": 0.7}, "minimum_lift": {"accuracy": 0.05}, "maximum_invalid_label_outputs": 2},
}


def source(tmp_path, texts):
    path = tmp_path / "source.jsonl"
    path.write_text("".join(json.dumps({"text": t, "label": i % 3, "topic": f"T{i % 4}"}) + "\n\n" for i, t in enumerate(texts)))
    return f"file://{path}"


def test_prepare_and_audit(spark, tmp_path):
    src, out = source(tmp_path, [f"text number {i} " + "abcdefgh"[i % 8] * (i + 3) for i in range(30)]), f"file://{tmp_path}/out"
    m = workflow.prepare(spark, TASK, out, local_jsonl=src)
    assert m["counts"] == {"train": 18, "validation": 6, "test": 6} and m["source_sha256"]
    report = workflow.audit(spark, out)
    assert report["quality"]["sensitive"] and {x["label"] for x in report["quality"]["label_distribution"]} == {*LABELS, "other"}
    assert set(workflow.length_report(workflow.read_prepared(spark, out), TASK)) == {"train", "validation", "test"}
    with pytest.raises(FileExistsError):
        workflow.prepare(spark, TASK, out, local_jsonl=src)
    part = next((tmp_path / "out/rows/split=train").glob("*.json"))
    part.write_text(part.read_text().replace("number", "NUMBER", 1))
    for crc in part.parent.glob(".*.crc"):
        crc.unlink()
    with pytest.raises(ValueError, match="differ"):
        workflow.audit(spark, out)


def test_failures_leave_nothing(spark, tmp_path):
    out = f"file://{tmp_path}/out"
    src = source(tmp_path, ["same"] * 30)
    for task, kw in ((TASK | {"prompt_template": "{nothing}"}, {}), (TASK, {"strict_overlap": True}), (TASK, {"deduplicate": True}), (TASK, {"heldout_fraction": 1.5})):
        with pytest.raises(Exception):
            workflow.prepare(spark, task, out, local_jsonl=src, **kw)
    assert [p.name for p in tmp_path.iterdir()] == ["source.jsonl"]
    src = source(tmp_path, ["token hf_" + "a" * 32, *map(str, range(29))])
    with pytest.raises(ValueError, match="secret"):
        workflow.prepare(spark, TASK, out, local_jsonl=src)


def test_deduplicate(spark, tmp_path):
    src = source(tmp_path, ["same"] * 12 + [f"unique {'xyz'[i % 3] * (i + 2)} {i}" for i in range(28)])
    m = workflow.prepare(spark, TASK, f"file://{tmp_path}/a", local_jsonl=src)
    n = workflow.prepare(spark, TASK, f"file://{tmp_path}/b", local_jsonl=src, deduplicate=True, strict_overlap=True)
    assert any(m["prompt_overlap"].values()) and m["warning"]
    assert not any(n["prompt_overlap"].values()) and sum(n["removed_cross_split"].values()) > 0
    assert {s: m["counts"][s] - n["counts"][s] for s in m["counts"]} == n["removed_cross_split"]


def test_given_splits_and_groups(spark, tmp_path):
    df = spark.range(40).select(F.concat(F.lit("t"), "id").alias("text"), (F.col("id") % 3).alias("label"), (F.col("id") % 8).cast("string").alias("topic"))
    for s, c in (("train", "id"), ("dev", "id"), ("held", "id")):
        df.write.parquet(f"{tmp_path}/{s}")
    files = {s: f"{tmp_path}/{s}" for s in ("train", "dev", "held")}
    base = TASK | {"source": {"dataset": "parquet", "data_files": files}}
    task = lambda **kw: check_task(base | {"source": base["source"] | kw})
    got = workflow.split_source(spark, task(validation_split="dev", test_split="held", group_field="topic"))
    assert [got[s].count() for s in got] == [40, 40, 40]  # given splits stay as they are
    got = workflow.split_source(spark, task(validation_split="dev"))
    assert [got[s].count() for s in got] == [40, 20, 20]
    got = workflow.split_source(spark, task(test_split="held"), heldout_fraction=0.25)
    assert [got[s].count() for s in got] == [30, 10, 40]
    got = workflow.split_source(spark, task(group_field="topic"), heldout_fraction=0.5)
    topics = [{r.topic for r in got[s].collect()} for s in got]
    assert [len(t) for t in topics] == [4, 2, 2] and not topics[0] & topics[1] and not topics[1] & topics[2]
    with pytest.raises(ValueError, match="fewer than two groups"):  # all groups leak into test, so none is left
        workflow.split_source(spark, task(group_field="topic", test_split="held"))


def evaluation(model, run, right, n=10, **more):
    cases = [{"prompt": f"p{i}", "reference": LABELS[i % 3], "output": LABELS[i % 3] if i < right else "what"} for i in range(n)]
    return {"task": "emotion", "run_dir": run, "model": model, "split": "test", "examples": cases} | more


def scored(spark, e):
    df = spark.createDataFrame(e["examples"], "prompt string, reference string, output string")
    return e | {"generation_metric": workflow.generation_metric(df, TASK)}


def test_evaluations(spark, tmp_path):
    t, b = scored(spark, evaluation("trained_run", "r", 8)), scored(spark, evaluation("starting_model", "r", 2))
    assert t["generation_metric"]["accuracy"] == 0.8 and t["generation_metric"]["invalid_label_outputs"] == 2
    report = workflow.compare_report(spark, t, t, b, b)
    assert "| r | trained_run | 0.800 | +0.600 |" in report and "| sadness | 4 |" in report
    with pytest.raises(ValueError, match="no base"):
        workflow.compare_report(spark, t, t, b)
    with pytest.raises(ValueError, match="cases"):
        workflow.compare_report(spark, t, scored(spark, evaluation("trained_run", "r", 8, 9)), b, b)
    df = spark.createDataFrame(t["examples"], "prompt string, reference string, output string")
    i = workflow.intervals(spark, df, TASK, 42)["intervals"]["accuracy"]
    assert i["lower"] <= 0.8 <= i["upper"]
    runs = [t | {"training_seed": 11}, scored(spark, evaluation("trained_run", "s", 6, training_seed=22))]
    s = workflow.seeds_report(spark, runs, [{}, {}])
    assert s["aggregate"]["accuracy"]["mean"] == pytest.approx(0.7) and s["aggregate"]["accuracy"]["values"] == [0.8, 0.6]
    with pytest.raises(ValueError, match="signatures"):
        workflow.seeds_report(spark, [runs[0], runs[1] | {"decoding": 1}], [{}, {}])
    with pytest.raises(ValueError, match="seeds repeat"):
        workflow.seeds_report(spark, [runs[0], runs[0]], [{}, {}])
    rouge = TASK | {"evaluation": {"metric": "rouge_l_f1"}}
    assert workflow.generation_metric(df.withColumn("output", F.col("reference")), rouge)["mean_f1"] == 1.0


def test_promote(spark, tmp_path):
    run, data = tmp_path / "run", tmp_path / "data"
    (run / "final").mkdir(parents=True)
    data.mkdir()
    (run / "task_config.json").write_text(json.dumps(TASK))
    (run / "run_summary.json").write_text("{}")
    (data / "manifest.json").write_text("{}")
    lineage.write_manifest(run, TASK, {"starting_model": "m", "prepared_artifacts": {"a": 1}, "seed": 1}, data)
    more = {"prepared_artifacts": {"a": 1}, "run_manifest_schema": 2}
    t, b = scored(spark, evaluation("trained_run", str(run), 8, **more)), scored(spark, evaluation("starting_model", str(run), 2, **more))
    paths = [tmp_path / "t.json", tmp_path / "b.json"]
    for p, e in zip(paths, (t, b)):
        p.write_text(json.dumps(e))
    decision = workflow.promote(spark, str(run), *paths, str(tmp_path / "reg"))
    assert decision["status"] == "promoted" and decision["evaluation_sha256"] == lineage.digest(paths[0]) and decision["base_evaluation_sha256"] == lineage.digest(paths[1])
    assert len([*(tmp_path / "reg/emotion").iterdir()]) == 1
    with pytest.raises(FileExistsError):
        workflow.promote(spark, str(run), *paths, str(tmp_path / "reg"))
    paths[0].write_text(json.dumps(t | {"prepared_artifacts": {}}))
    with pytest.raises(ValueError, match="manifest"):
        workflow.promote(spark, str(run), *paths, str(tmp_path / "reg"))


def answer(rows, decoding):
    """A model that is right in two of three cases."""
    right = F.col("ordinal") % 3 < 2
    return rows.withColumns({"output": F.when(right, F.col("response")).otherwise("what"), "loss": F.lit(0.5), "tokens": F.lit(2)})


def test_from_task_file_to_promotion(spark, tmp_path):
    task_path, run = tmp_path / "task.json", tmp_path / "run"
    task_path.write_text(json.dumps(TASK))
    src, out = source(tmp_path, [f"text number {i} " + "abcdefgh"[i % 8] * (i + 3) for i in range(60)]), f"file://{tmp_path}/out"
    assert commands.main(["prepare", "--task", str(task_path), "--output", out, "--local-jsonl", src], spark) == 0
    assert commands.main(["audit", "--data", out, "--fail-on-overlap", "--output", str(tmp_path / "audit.json")], spark) == 0 and (tmp_path / "audit.json").exists()
    sample = evaluation_plan.training_sample(spark, TASK, out, train=7, validation=4, balanced=True)
    assert sample["examples"] == {"train": 7, "validation": 4} and sample["label_counts"] == {"sadness": 3, "joy": 2, "love": 2} and sample["skipped"] == {"train": 0, "validation": 0}
    (run / "final").mkdir(parents=True)
    (run / "final/w").write_bytes(b"w")
    task = check_task(TASK)
    summary = {"task": "emotion", "starting_model": "m", "prepared_artifacts": sample["audit"]["artifacts"], "seed": 1}
    (run / "task_config.json").write_text(json.dumps(task))
    (run / "run_summary.json").write_text(json.dumps(summary))
    lineage.write_manifest(run, task, summary, tmp_path / "out")
    trained = evaluation_plan.evaluate(spark, str(run), out, answer, rows=9, generated=9)
    base = evaluation_plan.evaluate(spark, str(run), out, lambda r, d: answer(r, d).withColumn("output", F.lit("joy")), rows=9, generated=9, base=True)
    assert (trained["test_examples"], trained["skipped_for_length"], trained["response_tokens"]) == (9, 0, 18) and trained["response_loss"] == 0.5
    assert trained["generation_metric"]["accuracy"] == pytest.approx(6 / 9) and [e["prompt"] for e in trained["examples"]] == [e["prompt"] for e in base["examples"]]
    even = evaluation_plan.evaluate(spark, str(run), out, answer, split="validation", per_label=2)
    assert even["validation_examples"] == 6 and (run / "balanced_2_validation_evaluation.json").exists()
    # The same run once more, through given outputs: trained and starting model, then compared by file names alone.
    outputs, bad = tmp_path / "outputs.jsonl", tmp_path / "bad.jsonl"
    rows = [json.loads(x) for p in (tmp_path / "out/rows").rglob("*.json") for x in p.read_text().splitlines()]
    lines = [json.dumps({"prompt": r["prompt"], "output": r["response"] if i % 4 else "joy", "loss": 0.25, "tokens": 3}) for i, r in enumerate(rows)]
    outputs.write_text("\n".join(lines))
    bad.write_text("\n".join(lines[:3]))
    argv = ["evaluate", "--run", str(run), "--data", out, "--per-label", "2", "--split", "validation", "--outputs"]
    assert commands.main([*argv, f"file://{bad}"], spark) == 2
    assert commands.main([*argv, f"file://{outputs}"], spark) == 0
    assert commands.main([*argv, f"file://{outputs}", "--base"], spark) == 0
    first = run / "balanced_2_validation_evaluation.json"
    assert json.loads(first.read_text())["response_tokens"] == 18 and (run / "balanced_2_base_validation_evaluation.json").exists()
    assert commands.main(["compare", str(first), str(first), "--output", str(tmp_path / "report.md")], spark) == 0 and "+0.000" in (tmp_path / "report.md").read_text()
    assert commands.main(["compare", str(first), str(first), "--first-base", str(first)], spark) == 2  # not a base
    (tmp_path / "shape.json").write_text(json.dumps({"generation_metric": {"metric": "label_accuracy"}}))
    (tmp_path / "broken.json").write_text("{")
    for odd in ("shape.json", "broken.json"):
        assert commands.main(["compare", str(first), str(tmp_path / odd)], spark) == 2
    other = tmp_path / "other"
    other.mkdir()
    (other / "run_summary.json").write_text((run / "run_summary.json").read_text())
    (tmp_path / "second.json").write_text(json.dumps(json.loads(first.read_text()) | {"run_dir": str(other), "training_seed": 2}))
    assert commands.main(["compare", str(first), str(tmp_path / "second.json")], spark) == 2  # no base beside it
    assert commands.main(["compare", str(first), str(tmp_path / "second.json"), "--second-base", str(run / "balanced_2_base_validation_evaluation.json")], spark) == 2  # another run's
    # Seeds, and a training sample.
    summary |= {"method": "full", "train_examples": 7, "validation_examples": 4}
    for folder in (run, other):
        (folder / "seeds_summary").mkdir()
        (folder / "seeds_summary/run_summary.json").write_text(json.dumps(summary))
    names = []
    for folder, seed in ((run, 1), (other, 2)):
        names.append(str(tmp_path / f"seed{seed}.json"))
        (tmp_path / f"seed{seed}.json").write_text(json.dumps(json.loads(first.read_text()) | {"run_dir": str(folder / "seeds_summary"), "training_seed": seed}))
    assert commands.main(["seeds", *names, "--output", str(tmp_path / "seeds.json")], spark) == 0
    seeds = json.loads((tmp_path / "seeds.json").read_text())
    assert seeds["metric"] == "label_accuracy" and seeds["training_seeds"] == [1, 2] and seeds["evaluations"] == names and seeds["aggregate"]["accuracy"]["sample_std"] == 0
    assert commands.main(["seeds", names[0]], spark) == 2 and commands.main(["seeds", names[0], names[0]], spark) == 2
    argv = ["sample", "--task", str(task_path), "--data", out, "--train", "7", "--validation", "4", "--balanced", "--output"]
    assert commands.main([*argv, f"file://{tmp_path}/sample"], spark) == 0
    assert spark.read.parquet(f"{tmp_path}/sample/train").count() == 7 and json.loads((tmp_path / "sample/sample.json").read_text())["examples"] == {"train": 7, "validation": 4}
    assert commands.main([*argv, f"file://{tmp_path}/sample"], spark) == 2  # there is one already
    # The policy is that of the run's own task: no other file can loosen it.
    argv = ["promote", "--run", str(run), "--registry", str(tmp_path / "reg")]
    assert commands.main(argv, spark) == 2 and not (tmp_path / "reg").exists()
    easy = json.loads((run / "task_config.json").read_text()) | {"promotion": TASK["promotion"] | {"minimum_metrics": {"accuracy": 0.5}, "maximum_invalid_label_outputs": 9, "minimum_lift": {"accuracy": 0.0}}}
    (run / "task_config.json").write_text(json.dumps(easy))
    assert commands.main(argv, spark) == 2 and not (tmp_path / "reg").exists()  # changed since the run
    lineage.write_manifest(run, easy, json.loads((run / "run_summary.json").read_text()), tmp_path / "out")
    assert commands.main(argv, spark) == 0
    (record,) = (tmp_path / "reg/emotion").iterdir()
    assert {"run_manifest_sha256", "evaluation_sha256", "base_evaluation_sha256"} <= {*json.loads(record.read_text())}
    manifest = json.loads((tmp_path / "out/manifest.json").read_text())
    old = {k: v for k, v in manifest.items() if k != "artifacts"}
    for counts, stale in ((manifest["counts"], False), ({"train": 1}, True)):
        (tmp_path / "out/manifest.json").write_text(json.dumps(old | {"counts": counts}))
        (tmp_path / "out/.manifest.json.crc").unlink(missing_ok=True)
        if stale:
            with pytest.warns(UserWarning, match="train, validation, test"):
                workflow.verified_artifacts(spark, out)
        else:
            workflow.verified_artifacts(spark, out)
    (tmp_path / "out/manifest.json").write_text(json.dumps(manifest))
    part = next((tmp_path / "out/rows/split=test").glob("*.json"))
    lines = part.read_text().splitlines()
    part.write_text("\n".join([lines[0], json.dumps({"prompt": 5, "response": "joy"}), *lines[1:]]))
    for crc in part.parent.glob(".*.crc"):
        crc.unlink()
    with pytest.raises(ValueError, match=rf"{part.name}:2: prompt is not text"):
        workflow.read_prepared(spark, out)
    assert commands.main(["audit", "--data", out, "--output", str(tmp_path / "no.json")], spark) == 2 and not (tmp_path / "no.json").exists()


@pytest.mark.parametrize("bad", [{"per_label": 0}, {"per_label": 2, "rows": 4}, {"per_label": 2, "generated": 5}, {"rows": 0}, {"generated": 0}])
def test_evaluation_arguments(bad):
    assert evaluation_plan.evaluation_sizes(TASK) == (128, 5) and evaluation_plan.evaluation_sizes(TASK, per_label=2) == (6, 6)
    with pytest.raises(ValueError):
        evaluation_plan.evaluation_sizes(TASK, **bad)


@pytest.mark.parametrize("bad", [{"train": 0}, {"validation": 0}, {"save_steps": 0}, {"max_steps": 0}, {"max_steps": -2}, {"balanced": True, "train": 2}])
def test_training_arguments(bad):
    assert evaluation_plan.training_limits(TASK, balanced=True, train=3) == (3, 1, LABELS)
    with pytest.raises(ValueError):
        evaluation_plan.training_limits(TASK, **bad)
    with pytest.raises(ValueError, match="label_accuracy"):
        evaluation_plan.training_limits(TASK | {"evaluation": {}}, balanced=True)


def test_rows_passed_over_before_a_label_is_full(spark):
    """One label with nine tenths of the rows, of which few fit; no window or sort over a whole label."""
    rows = [("joy" if i % 10 else "Love ", f"row {i}", i % 13 == 0 or i % 10 == 0) for i in range(4000)]
    df = spark.createDataFrame(rows, "response string, prompt string, _fits boolean").withColumn(evaluation_plan.workflow.KEY, F.md5(F.col("prompt").cast("binary")))
    taken, skipped = evaluation_plan.balanced_fitting(df, {"joy": 40, "love": 7, "sadness": 0}, 3)
    order = lambda r: hashlib.md5(f"3:{hashlib.md5(r[1].encode()).hexdigest()}".encode()).hexdigest()
    want, passed = [], 0
    for label, quota in (("joy", 40), ("love", 7)):
        for r in sorted((r for r in rows if r[0].strip().lower() == label), key=order):
            if not quota:
                break
            want, passed, quota = (want + [r[1]], passed, quota - 1) if r[2] else (want, passed + 1, quota)
    assert sorted(r.prompt for r in taken.collect()) == sorted(want) and skipped == passed > 300


def test_reports(spark, tmp_path):
    def said(sign, category, date, response):
        return f"### Sign:\n{sign}\n\n### Category:\n{category}\n\n### Date:\n{date}\n\n### Horoscope:\n{response}"

    texts = [said("Leo", "Love", "2024/01/02", "leo finds love in 2024 "), said("Aries", "Career", "2024/05/06", "w " * 300), said("Aries", "Love", "2023/05/06", "on 2023/05/06 aries | rests")]
    (tmp_path / "a.jsonl").write_text("\n".join(json.dumps({"text": t}) for t in texts))
    assert commands.main(["analyze", f"first=file://{tmp_path}/a.jsonl", f"second=file://{tmp_path}/a.jsonl", "--output", str(tmp_path / "report")], spark) == 0
    found = json.loads((tmp_path / "report.json").read_text())
    one = found["first"]
    assert one == found["second"] and one["examples"] == 3 and one["category"] == {"Career": 1, "Love": 2}
    assert one["length"]["response"] == {"50": 6, "90": 301, "95": 301, "99": 301, "100": 301} and one["length"]["total"]["100"] == 301 + one["length"]["prompt"]["50"]
    assert one["limit"]["256"] == {"truncated": 1, "truncated_percent": pytest.approx(100 / 3), "response_retained_percent": pytest.approx(100 * (6 + 6 + 256 - one["length"]["prompt"]["50"]) / 313), "without_response": 0}
    assert {k: v["rows"] for k, v in one["mention"].items()} == {"sign": 2, "category": 1, "exact_date": 1, "year": 2}
    text = (tmp_path / "report.md").read_text()
    assert "## second: 3 examples" in text and "| sign | 2 | 66.7 |" in text and "| Love | 2 |" in text
    (tmp_path / "bad.jsonl").write_text(json.dumps({"text": "no marker"}))
    cases = reports.one_field_changed({"sign": "Aries", "date": "2026/10/04"}, sign="Taurus", date="2026/11/04")
    assert [c["case"] for c in cases] == ["baseline", "change-sign", "change-date"] and cases[1]["sign"] == "Taurus" and cases[2]["sign"] == "Aries"
    with pytest.raises(ValueError, match="no fields"):
        reports.one_field_changed({"sign": "Aries"}, house="x")
    rows = [(c["case"], m, c["sign"], "same" if m == "a" else c["case"]) for c in cases for m in ("a", "b")] + [("change-date", "c", "x", "")]
    df = spark.createDataFrame(rows, "case string, model string, sign string, output string")
    assert {(r.case, r.model): r.changed for r in reports.same_as_baseline(df).collect()} == {("change-sign", "a"): False, ("change-date", "a"): False, ("change-sign", "b"): True, ("change-date", "b"): True}
    losses = spark.createDataFrame([("a", 1.0, 2), ("a", 2.0, 2), ("b", 0.5, 4)], "model string, loss double, tokens int")
    page = reports.generations_markdown("Inputs", {"seed": 42}, losses, df, ["sign"])
    assert "| a | 4 | 1.5000 | 4.48 |" in page and "## change-sign\n\nsign: Taurus" in page and "c: (no text)" in page


def test_streams(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text('{"text": "one", "label": 1}\n{"text": "two", "label": 2}\n')
    stream = spark.readStream.schema("text string, label int").json(str(tmp_path / "in"))
    task = check_task(TASK)
    for expected in (2, 3):
        streams.prepare_stream(stream, task, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
        rows = spark.read.parquet(str(tmp_path / "out"))
        assert rows.count() == expected
        (tmp_path / f"in/b{expected}.json").write_text('{"text": "three", "label": 0}\n')
    assert {r.response for r in rows.collect()} == {*LABELS}
    events = spark.readStream.schema("ts timestamp, text string").json(str(tmp_path / "ev"), multiLine=False) if (tmp_path / "ev").mkdir() is None else None
    (tmp_path / "ev/a.json").write_text('{"ts": "2024-01-01T00:10:00", "text": "a@b.org"}\n{"ts": "2024-01-01T00:20:00", "text": "x"}\n')
    q = streams.sensitive_stream(events, "ts", "text").writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    one = spark.table("counts").first()
    assert (one.rows, one.email, one.phone) == (2, 1, 0)
