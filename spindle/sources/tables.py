"""Sources and sinks: parquet, JSON lines with type checks, reports, directories that appear whole or not at all."""

from __future__ import annotations

import atexit
import json
import tempfile
import uuid
from collections.abc import Callable
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir, removed when the driver ends. In local mode alone that may be unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spindle-")
    path = f"{base.rstrip('/')}/spindle-{uuid.uuid4().hex}"
    atexit.register(remove, spark, path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    if spark.sparkContext._jsc is not None:
        fs, p = _fs(spark, path)
        fs.delete(p, True)


def once(df: DataFrame) -> DataFrame:
    """df, written as Parquet and reread: what made it runs once, and every later read takes the columns that it needs alone."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def scan(spark: SparkSession, source: dict, split: str | None = None) -> DataFrame:
    """The table that a task's source names. dataset is a Spark format (parquet, json, csv, orc, text) or a path of Parquet files; there is no download.

    A path may be of a local snapshot that keeps folders for configurations and revisions: revision and config, if given, name
    folders below it, in this order. With a format they cannot be followed, so they are refused.
    """
    files = source.get("data_files")
    below = [source[k] for k in ("revision", "config") if source.get(k)]
    if isinstance(files, dict):
        files = files[split or source.get("train_split", "train")]
    kind = source["dataset"]
    if files is None:
        return spark.read.parquet("/".join([kind.rstrip("/"), *below]))
    if below:
        raise ValueError("data_files take neither revision nor config")
    return spark.read.format(kind).load(files)


def jsonl(spark: SparkSession, path: str) -> DataFrame:
    """Rows of JSON lines; the reader leaves blank lines out."""
    return spark.read.json(path)


def prepared(spark: SparkSession, path: str) -> DataFrame:
    """(file, split, prompt, response, inputs as JSON text, value, fault) of prepared JSON lines; fault names a row whose prompt or response is not text.

    split is that of the folder (split=...) or null.

    Values are looked at as they stand in the JSON, so a number is not taken for text.
    """
    lines = spark.read.text(path).where(~F.regexp_like("value", F.lit(r"^\s*$")))
    split = F.col("split") if "split" in lines.columns else F.lit(None).cast("string")
    v = lines.select(F.col("_metadata.file_name").alias("file"), split.alias("split"), "value", F.try_parse_json("value").alias("v"))
    kind = lambda f: F.schema_of_variant(F.try_variant_get("v", f"$.{f}", "variant"))
    fault = F.when(F.col("v").isNull(), "not JSON")
    for f in ("prompt", "response"):
        fault = fault.when(F.coalesce(kind(f), F.lit("VOID")) != "STRING", f"{f} is not text")
    return v.select("file", "split", *(F.try_variant_get("v", f"$.{f}", "string").alias(f) for f in ("prompt", "response")), F.to_json(F.try_variant_get("v", "$.inputs", "variant")).alias("inputs"), "value", fault.alias("fault"))


def evaluations(spark: SparkSession, *paths: str) -> DataFrame:
    """(file, run_dir, model, split, task, metric, training_seed, v, fault) of many evaluation files, each a JSON document; v is the document, fault says why one is no evaluation of labels."""
    files = spark.read.text(list(paths), wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.try_parse_json("value").alias("v"))
    get = lambda path, kind="string": F.try_variant_get("v", f"$.{path}", kind)
    shape = lambda path: F.coalesce(F.schema_of_variant(get(path, "variant")), F.lit("VOID"))
    fault = F.when(F.col("v").isNull(), "not JSON").when(~shape("generation_metric").startswith("OBJECT"), "no metric").when(F.coalesce(get("generation_metric.metric"), F.lit("")) != "label_accuracy", "not label accuracy")
    fault = fault.when(~shape("generation_metric.per_label").startswith("OBJECT"), "no scores of labels").when(~shape("examples").startswith("ARRAY"), "no examples").when(get("run_dir").isNull() | get("task").isNull(), "no run or task")
    return files.select("file", get("run_dir").alias("run_dir"), F.coalesce(get("model"), F.lit("trained_run")).alias("model"), F.coalesce(get("split"), F.lit("test")).alias("split"), get("task").alias("task"), get("generation_metric.metric").alias("metric"), get("training_seed", "long").alias("training_seed"), "v", fault.alias("fault"))


def label_scores(found: DataFrame) -> DataFrame:
    """(file, label, support, recall, f1): a row for each label of each of evaluations() without fault."""
    listed = found.where("fault is null").withColumn("per_label", F.try_variant_get("v", "$.generation_metric.per_label", "variant"))
    entries = listed.select("file", "per_label").lateralJoin(found.sparkSession.tvf.variant_explode(F.col("per_label").outer()))
    number = lambda key, kind: F.try_variant_get("value", f"$.{key}", kind).alias(key)
    return entries.select("file", F.col("key").alias("label"), number("support", "long"), number("recall", "double"), number("f1", "double"))


def evaluation(spark: SparkSession, path: str) -> dict:
    """One evaluation of labels as a dictionary; ValueError names the file and its fault."""
    row = evaluations(spark, path).select("fault", F.to_json("v").alias("v")).first()
    if row["fault"]:
        raise ValueError(f"{path}: {row['fault']}")
    return json.loads(row["v"])


def first_fault(spark: SparkSession, path: str) -> str | None:
    """file:line and the fault of one row of prepared JSON lines that is not as it should be, or None."""
    bad = prepared(spark, path).where("fault is not null").select("file", "fault", "value").first()
    if bad is None:
        return None
    number = F.posexplode(F.split("value", "\n")).alias("at", "line")
    lines = spark.read.text(path, wholetext=True).where(F.col("_metadata.file_name") == bad["file"]).select(number)
    at = lines.where(F.col("line") == F.lit(bad["value"])).agg(F.min("at")).first()[0]  # that file alone, when it is known to be faulty
    return f"{bad['file']}:{'?' if at is None else at + 1}: {bad['fault']}"


def checked(rows: DataFrame) -> DataFrame:
    """prepared() rows without fault; the first fault stops the query."""
    bad = F.raise_error(F.concat_ws(": ", "file", "fault"))
    return rows.withColumn("prompt", F.when(F.col("fault").isNull(), F.col("prompt")).otherwise(bad)).drop("fault")


def write_splits(rows: DataFrame, path: str, kind: str = "json") -> None:
    """One folder for each split."""
    rows.write.partitionBy("split").format(kind).mode("errorifexists").save(path)


def export_completions(rows: DataFrame, path: str) -> None:
    rows.select("prompt", F.col("response").alias("completion")).write.mode("errorifexists").json(path)


def _fs(spark: SparkSession, path: str) -> tuple[Any, Any]:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


#: File systems on which a folder is renamed at once. Object stores copy file by file instead.
RENAMES = ("file", "hdfs", "viewfs", "webhdfs")


def atomically(spark: SparkSession, path: str, fill: Callable[[str], None], last: str = "manifest.json") -> None:
    """Let fill write a folder that appears whole or not at all. path may only be missing or empty; a failure leaves nothing.

    Where folders are renamed at once, fill writes a sibling that is renamed to path. Elsewhere it writes to path itself, and
    the file last, which it must write after all others and without which readers refuse a folder, commits the rest.
    """
    fs, target = _fs(spark, path)
    if fs.exists(target) and len(fs.listStatus(target)):
        raise FileExistsError(f"not empty: {path}")
    renames = fs.getUri().getScheme() in RENAMES
    staging = f"{target.getParent().toString()}/.{target.getName()}.tmp-{uuid.uuid4().hex}" if renames else path
    _, source = _fs(spark, staging)
    done = False
    try:
        fill(staging)
        if renames:
            if fs.exists(target):
                fs.delete(target, False)
            if not fs.rename(source, target):
                raise OSError(f"cannot rename {staging} to {path}")
        elif not fs.exists(_fs(spark, f"{path.rstrip('/')}/{last}")[1]):
            raise OSError(f"{path} has no {last}")
        done = True
    finally:
        if renames or not done:
            fs.delete(source, True)


def write_text(spark: SparkSession, path: str, content: str, replace: bool = False) -> None:
    """A small file of the driver's, on any file system."""
    fs, p = _fs(spark, path)
    out = fs.create(p, replace)
    try:
        out.write(bytearray(content.encode("utf-8")))
    finally:
        out.close()


def report(path: str | Path, value: Any) -> None:
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps(value, indent=2, ensure_ascii=False) + "\n", encoding="utf-8")


def register(spark: SparkSession, folder: str | Path, run: str, digest: str, record: dict) -> str:
    """A new record <run>-<first 12 of digest>.json; one that exists is never replaced. folder may be on any file system, whose own create-if-absent decides between two at once."""
    name, body = f"{run}-{digest[:12]}.json", json.dumps(record, indent=2) + "\n"
    if "://" in str(folder) and not str(folder).startswith("file://"):
        path = f"{str(folder).rstrip('/')}/{name}"
        fs, p = _fs(spark, path)
        if fs.exists(p):
            raise FileExistsError(path)
        write_text(spark, path, body)
        return path
    path = Path(str(folder).removeprefix("file://")) / name
    path.parent.mkdir(parents=True, exist_ok=True)
    with path.open("x", encoding="utf-8") as f:
        f.write(body)
    return str(path)


def inference_inputs(items: list[str], file: str | Path | None = None) -> dict[str, str]:
    """Values from a JSON file, overridden by field=value items, which are cut at their first equals sign."""
    values = json.loads(Path(file).read_text(encoding="utf-8")) if file else {}
    for item in items:
        field, equals, value = item.partition("=")
        if not equals:
            raise ValueError(f"not field=value: {item}")
        values[field] = value
    return values
