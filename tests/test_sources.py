import hashlib
import json
import subprocess
import sys
from pathlib import Path

import pytest

from spindle.operators import integrity
from spindle.plans import lineage
from spindle.sources import files, tables


def test_prepared_scan_checks_types(spark, tmp_path):
    lines = ['{"prompt": "a", "response": "b", "inputs": {"x": 1}}', "", "  ", '{"prompt": 5, "response": "b"}', '{"prompt": "a"}', "no json"]
    (tmp_path / "train.jsonl").write_text("\n".join(lines))
    rows = tables.prepared(spark, f"file://{tmp_path}/train.jsonl")
    assert [(r.prompt, r.response, r.inputs, r.fault) for r in rows.collect()][0] == ("a", "b", '{"x":1}', None)
    assert [r.fault for r in rows.collect()] == [None, "prompt is not text", "response is not text", "not JSON"]
    with pytest.raises(Exception, match="prompt is not text"):
        tables.checked(rows).collect()


def test_atomic_folder(spark, tmp_path):
    out = f"file://{tmp_path}/out"
    rows = spark.createDataFrame([("train", "p", "r"), ("test", "q", "s")], "split string, prompt string, response string")
    with pytest.raises(RuntimeError):
        tables.atomically(spark, out, lambda p: (tables.write_splits(rows, p + "/data"), (_ for _ in ()).throw(RuntimeError("x"))))
    assert list(tmp_path.iterdir()) == []

    def fill(path):
        tables.write_splits(rows, f"{path}/data")
        tables.write_text(spark, f"{path}/manifest.json", "{}\n")

    tables.atomically(spark, out, fill)
    assert spark.read.json(f"{out}/data").count() == 2 and (tmp_path / "out/manifest.json").read_text() == "{}\n"
    with pytest.raises(FileExistsError):
        tables.atomically(spark, out, fill)


def test_folders_on_stores_without_renames(spark, tmp_path, monkeypatch):
    """There a folder is written in place: it holds its last file if it is whole, and a failure removes it."""
    monkeypatch.setattr(tables, "RENAMES", ())
    out = f"file://{tmp_path}/out"

    def fill(staging, whole=True, fails=False):
        assert staging == out
        spark.range(3).write.json(f"{staging}/rows")
        if fails:
            raise RuntimeError("half-way")
        if whole:
            tables.write_text(spark, f"{staging}/manifest.json", "{}")

    for kw, error in (({"fails": True}, RuntimeError), ({"whole": False}, OSError)):
        with pytest.raises(error):
            tables.atomically(spark, out, lambda s, kw=kw: fill(s, **kw))
        assert not (tmp_path / "out").exists()
    tables.atomically(spark, out, fill)
    assert (tmp_path / "out/manifest.json").exists() and spark.read.json(f"{out}/rows").count() == 3
    with pytest.raises(FileExistsError):
        tables.atomically(spark, out, fill)


def test_snapshot(spark, tmp_path):
    (tmp_path / "d/sub").mkdir(parents=True)
    (tmp_path / "d/a.jsonl").write_bytes(b"x\n\n \ny")
    (tmp_path / "d/sub/b").write_bytes("é\n".encode())
    got = integrity.file_snapshot(spark, f"file://{tmp_path}/d")
    want = {(n, hashlib.sha256((tmp_path / "d" / n).read_bytes()).hexdigest(), k) for n, k in (("a.jsonl", 2), ("sub/b", 1))}
    assert {tuple(r) for r in got.collect()} == want
    kept = spark.createDataFrame(got.collect(), got.schema)
    assert integrity.snapshot_differences(got, kept).count() == 0
    (tmp_path / "d/a.jsonl").write_bytes(b"changed")
    assert [r.file for r in integrity.snapshot_differences(integrity.file_snapshot(spark, f"file://{tmp_path}/d"), kept).collect()] == ["a.jsonl"]


def test_sources(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"x": 1}\n\n{"x": 2}\n')
    assert tables.scan(spark, {"dataset": "json", "data_files": {"train": str(tmp_path / "a.json")}}).count() == 2
    assert tables.jsonl(spark, str(tmp_path / "a.json")).count() == 2
    (tmp_path / "in.json").write_text('{"a": "1", "b": "2"}')
    assert tables.inference_inputs(["b=x=y"], tmp_path / "in.json") == {"a": "1", "b": "x=y"}
    with pytest.raises(ValueError):
        tables.inference_inputs(["b"])
    tables.register(spark, tmp_path / "reg", "run", "f" * 64, {"a": 1})
    with pytest.raises(FileExistsError):
        tables.register(spark, tmp_path / "reg", "run", "f" * 64, {})


def test_lineage(tmp_path):
    run, data = tmp_path / "run", tmp_path / "data"
    (run / "final").mkdir(parents=True)
    data.mkdir()
    (run / "final/w.safetensors").write_bytes(b"w")
    task = {"name": "t", "source": {"dataset": "d", "revision": "r1"}, "prompt_template": "{a}"}
    (run / "task_config.json").write_text(json.dumps(task))
    (run / "run_summary.json").write_text("{}")
    (data / "manifest.json").write_text('{"source": "d"}')
    m = lineage.write_manifest(run, task, {"starting_model": "m", "prepared_artifacts": {"a": 1}, "seed": 3}, data)
    assert lineage.read_manifest(run) == m and m["dataset_revision"] == "r1"
    lineage.check_data(m, data, {"a": 1})
    for bad in ("final/w.safetensors", "task_config.json", "run_summary.json", "resolved_config.json"):
        before = (run / bad).read_bytes()
        (run / bad).write_bytes(before + b" ")
        with pytest.raises(ValueError, match="changed"):
            lineage.read_manifest(run)
        (run / bad).write_bytes(before)
    with pytest.raises(ValueError):
        lineage.check_data(m, data, {})
    assert lineage.read_manifest(data) is None
    assert lineage.inference_settings(m, temperature=0)["temperature"] == 0
    with pytest.raises(ValueError):
        lineage.inference_settings(m, top_p=0)


def test_resume(tmp_path):
    settings = {"max_steps": 10}
    lineage.write_guard(tmp_path, settings)
    for step in (2, 10, 9):
        (tmp_path / f"checkpoint-{step}").mkdir()
        (tmp_path / f"checkpoint-{step}/trainer_state.json").write_text(json.dumps({"global_step": step}))
    (tmp_path / "checkpoint-x").mkdir()
    with pytest.raises(ValueError, match="max_steps"):
        lineage.checkpoint_to_resume(tmp_path, "latest", settings)
    assert lineage.checkpoint_to_resume(tmp_path, tmp_path / "checkpoint-9", settings).name == "checkpoint-9"
    with pytest.raises(ValueError, match="incomplete"):
        lineage.checkpoint_to_resume(tmp_path, tmp_path / "checkpoint-x", settings)
    with pytest.raises(ValueError, match="other settings"):
        lineage.checkpoint_to_resume(tmp_path, "latest", {})


def test_files_are_streamed(spark, tmp_path, monkeypatch):
    """Any chunks give the same hashes and lines; a file of many chunks is never held whole; hidden files are left out."""
    import hashlib
    import resource
    import subprocess
    import sys

    bodies = {"a.json": b"one\n\n \t\r\ntwo", "b/c=1/d.txt": b"", "b/e.bin": bytes(range(256)) * 40, "f": b"\n\n", "g": b"x\n" * 3000 + b" "}
    for name, body in bodies.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(body)
    (tmp_path / "_SUCCESS").write_bytes(b"")
    (tmp_path / ".a.json.crc").write_bytes(b"x")
    want = {n: (hashlib.sha256(b).hexdigest(), sum(bool(x.strip()) for x in b.split(b"\n"))) for n, b in bodies.items()}
    for path in (f"file://{tmp_path}", str(tmp_path), f"file:{tmp_path}/"):
        assert {r.file: (r.sha256, r.rows) for r in integrity.file_snapshot(spark, path).collect()} == want
    assert [tuple(r) for r in integrity.file_snapshot(spark, f"file://{tmp_path}/a.json").collect()] == [("a.json", *want["a.json"])]
    for size in (1, 3, 1000):
        lines = files.Lines()
        for i in range(0, len(bodies["g"]), size):
            lines.add(bodies["g"][i : i + size])
        assert lines.total() == 3000
    with pytest.raises(Exception, match="FileNotFound"):
        integrity.file_snapshot(spark, f"file://{tmp_path}/none").collect()
    (tmp_path / "large").mkdir()
    with (tmp_path / "large/file").open("wb") as f:
        f.truncate(3 << 30)  # a hole: no disk is used
    code = f"import resource; from spindle.sources import files as s; r = s.HashReader('{tmp_path}/large'); before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss; rows = [b.to_pylist() for p in r.partitions() for b in r.read(p)]; print(rows[0][0]['size'], resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before)"
    size, more = map(int, subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, cwd=Path(__file__).parents[1]).stdout.split())
    assert size == 3 << 30 and more < 200_000  # KB
