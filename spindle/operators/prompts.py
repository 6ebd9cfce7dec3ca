"""Prompts, responses and encoded examples as Column expressions compiled from a task."""

from __future__ import annotations

import string

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text
from . import sampling

IGNORED = -100


def missing_columns(df: DataFrame, task: dict) -> list[str]:
    return sorted({*task["input_fields"], task["response_field"]} - {*df.columns})


def check_columns(df: DataFrame, task: dict, split: str) -> None:
    if missing := missing_columns(df, task):
        raise ValueError(f"{split}: no columns {', '.join(missing)}")


def field_value(df: DataFrame, task: dict, field: str) -> Column:
    """The cleaned text of one prompt field."""
    mode, kind = task.get("field_transforms", {}).get(field), df.schema[field].dataType
    if mode == "join_comma":
        if not isinstance(kind, T.ArrayType):
            raise ValueError(f"{field} is not a list")
        return text.joined(F.col(field), kind.elementType)
    value = text.strip(text.spelled(F.col(field), kind))
    return text.title(value) if mode == "title" else F.lower(value) if mode == "lower" else value


def prompt(df: DataFrame, task: dict) -> Column:
    """The template is parsed once, here; the plan sees a concat of literals and columns."""
    parts = []
    for literal, field, _, _ in string.Formatter().parse(task["prompt_template"]):
        parts += [F.lit(literal)] if literal else []
        parts += [field_value(df, task, field)] if field else []
    return F.concat(*parts)


def response(df: DataFrame, task: dict) -> Column:
    raw = text.spelled(F.col(task["response_field"]), df.schema[task["response_field"]].dataType)
    table = task.get("response_map") or {}
    if table:
        pairs = [F.lit(x if isinstance(x, str) else str(x)) for kv in table.items() for x in kv]
        raw = F.coalesce(F.try_element_at(F.create_map(*pairs), raw), raw)
    return text.strip(raw)


def field_fault(df: DataFrame, task: dict) -> Column:
    """Which prompt field of a row is empty, or null."""
    fault = F.lit(None).cast("string")
    for field in reversed(task["input_fields"]):
        fault = F.when(field_value(df, task, field) == "", f"empty prompt field: {field}").otherwise(fault)
    return fault


def field_faults(df: DataFrame, task: dict, *by: str) -> DataFrame:
    """(by..., rows, fault) of the rows that have a response: the least of their faults, or null. One aggregate, so the same one at every run."""
    rows = df.where(response(df, task) != "")
    return rows.groupBy(*by).agg(F.count("*").alias("rows"), F.min(field_fault(df, task)).alias("fault"))


def prepare_rows(df: DataFrame, task: dict, *keep: str) -> DataFrame:
    """(keep..., prompt, response, inputs) without rows of empty responses; a row with an empty prompt field stops the query."""
    check_columns(df, task, "source")
    inputs = F.struct(*(F.col(f) for f in task["input_fields"]))
    rows = df.withColumn("_response", response(df, task)).where("_response <> ''")
    fault = field_fault(df, task)
    checked = F.when(fault.isNull(), prompt(df, task)).otherwise(F.raise_error(fault))
    return rows.select(*keep, checked.alias("prompt"), F.col("_response").alias("response"), inputs.alias("inputs"))


def white_space_tokens(c: Column) -> Column:
    """The default tokenizer: runs of other than white space. Any Column from text to an array may take its place."""
    return F.regexp_extract_all(c, F.lit(r"[^\x20\x09-\x0D]+"), 0)


def library_tokens(path: str):
    """A tokenizer of integer ids from a tokenizers file, in place of white_space_tokens; its bounded contents travel with the query."""
    with open(path, encoding="utf-8") as f:
        spec = f.read()
    made: dict[str, object] = {}

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def ids(a: pa.Array) -> pa.Array:
        from tokenizers import Tokenizer

        if "t" not in made:
            made["t"] = Tokenizer.from_str(spec)
        found = [made["t"].encode(x or "", add_special_tokens=False).ids for x in a.to_pylist()]
        return pa.array(found, pa.list_(pa.int32()))

    return ids


def encoded(df: DataFrame, max_length: int, tokenize=white_space_tokens, end="</s>") -> DataFrame:
    """Rows of (prompt, response) that fit, with input_ids, attention_mask and labels that hide the prompt. Labels have the ids' type."""
    p, r = tokenize(F.col("prompt")), F.concat(tokenize(F.col("response")), F.array(F.lit(end)))
    rows = df.withColumn("_p", p).withColumn("_r", r).where(F.size("_p") + F.size("_r") <= max_length)
    hidden = F.lit(IGNORED).cast(rows.schema["_p"].dataType.elementType)
    ids = F.concat("_p", "_r")
    return rows.withColumns({"input_ids": ids, "attention_mask": F.transform(ids, lambda _: F.lit(1)), "labels": F.concat(F.transform("_p", lambda _: hidden), F.col("_r"))}).drop("_p", "_r")


def padded(df: DataFrame, column: str, width: int, fill) -> DataFrame:
    """An array column made width long from the right."""
    return df.withColumn(column, F.concat(F.col(column), F.array_repeat(F.lit(fill), F.lit(width) - F.size(column))))


def batches(df: DataFrame, size: int, key: Column, pad) -> DataFrame:
    """Encoded rows with batch and place, both from 0 and in the order of key, which differs from row to row; arrays are padded from the right to the longest of their batch.

    input_ids are padded with pad, attention_mask with 0 and labels with what hides them. The order is found by ranges of
    the key, so no task numbers all rows; a batch has size rows at most.
    """
    at = "_spindle_at"
    rows = sampling.running_totals(df, key, name=at)
    rows = rows.withColumns({"batch": F.floor(F.col(at) / size), "place": F.pmod(at, F.lit(size))}).drop(at)
    width = F.max(F.size("input_ids")).over(Window.partitionBy("batch"))
    rows = rows.withColumn("width", width)
    hidden = F.lit(IGNORED).cast(df.schema["labels"].dataType.elementType)
    more = F.col("width") - F.size("input_ids")
    filled = {c: F.concat(F.col(c), F.array_repeat(x, more)) for c, x in (("input_ids", F.lit(pad)), ("attention_mask", F.lit(0)), ("labels", hidden))}
    return rows.withColumns(filled)


def truncated(df: DataFrame, column: str, length: int) -> DataFrame:
    return df.withColumn(column, F.slice(column, 1, length))


def truncated_examples(df: DataFrame, length: int, strict: bool = False) -> DataFrame:
    """Encoded rows whose input_ids, attention_mask and labels are cut to length; one of which no response token is left goes, or with strict stops the query."""
    for c in ("input_ids", "attention_mask", "labels"):
        df = truncated(df, c, length)
    left = F.exists("labels", lambda x: x != F.lit(IGNORED).cast(df.schema["labels"].dataType.elementType))
    if strict:
        return df.withColumn("labels", F.when(left, F.col("labels")).otherwise(F.raise_error(F.lit(f"no response token is left within {length}"))))
    return df.where(left)
