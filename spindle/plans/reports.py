"""Reports on marked training texts and on generations, as dictionaries and as Markdown. Spark makes the few rows that a report shows; the driver sets them."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import analysis, metrics, prompts
from ..sources.tables import scratch

MEASURES = ("prompt", "response", "total")


def analysis_rows(texts: DataFrame, tokenize=prompts.white_space_tokens, column: str = "text") -> DataFrame:
    """(part, name, measure, value) of marked texts: percentiles of lengths, what token limits cut off, literal mentions, categories.

    The marked texts are parsed and tokenized once: the counts of tokens, and what is said of the fields, are written as a narrow table first.
    """
    parsed = analysis.parsed(texts, column=column)
    narrow = parsed.select("response", "sign", "category", "date", F.size(tokenize(F.col("prompt"))).alias("prompt_tokens"), (F.size(tokenize(F.col("response"))) + 1).alias("response_tokens"))
    path = scratch(texts.sparkSession)
    narrow.write.parquet(path)
    rows = texts.sparkSession.read.schema(narrow.schema).parquet(path).withColumn("total_tokens", F.col("prompt_tokens") + F.col("response_tokens"))
    row = lambda df, part, name, measure, value: df.select(F.lit(part).alias("part"), name.cast("string").alias("name"), measure.alias("measure"), F.col(value).cast("double").alias("value"))
    lengths = analysis.percentiles(rows, [f"{m}_tokens" for m in MEASURES])
    out = row(lengths, "length", F.regexp_replace("measure", "_tokens$", ""), F.col("percent").cast("string"), "value")
    limits = analysis.limit_sweep(rows)
    for measure in ("truncated", "truncated_percent", "response_retained_percent", "without_response"):
        out = out.union(row(limits, "limit", F.col("token_limit"), F.lit(measure), measure))
    found = analysis.mentions(rows)
    for measure in ("rows", "percent"):
        out = out.union(row(found, "mention", F.col("field"), F.lit(measure), measure))
    return out.union(row(analysis.category_counts(rows, "category"), "category", F.col("category"), F.lit("rows"), "rows")).union(row(rows.agg(F.count("*").alias("rows")), "examples", F.lit("all"), F.lit("rows"), "rows"))


def analysis_report(sets: Mapping[str, DataFrame], tokenize=prompts.white_space_tokens) -> dict[str, dict[str, Any]]:
    """For each named set of marked texts: examples, length, limit, mention and category, by name and measure."""
    report: dict[str, dict[str, Any]] = {}
    for name, texts in sets.items():
        one: dict[str, Any] = {"length": {}, "limit": {}, "mention": {}, "category": {}}
        for r in analysis_rows(texts, tokenize).orderBy("part", "name", "measure").collect():  # a row for each category, and some 40
            if r["part"] in ("category", "examples"):
                value = int(r["value"])
                one |= {"examples": value} if r["part"] == "examples" else {"category": one["category"] | {r["name"]: value}}
            else:
                one[r["part"]].setdefault(r["name"], {})[r["measure"]] = r["value"]
        report[name] = one
    return report


def table(head: Sequence[str], rows: Iterable[Sequence[Any]]) -> list[str]:
    """Lines of a Markdown table; cells of text lose what would end them."""
    cell = lambda v: (f"{v:,.1f}" if isinstance(v, float) and v % 1 else f"{v:,.0f}") if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v).replace("|", "\\|").replace("\n", " ")
    line = lambda cells: f"| {' | '.join(cells)} |"
    return [line(head), line(["---"] * len(head)), *(line([cell(v) for v in r]) for r in rows), ""]


def analysis_markdown(report: Mapping[str, Mapping[str, Any]]) -> str:
    out = ["# Training texts", ""]
    for name, one in report.items():
        percents = [str(p) for p in analysis.PERCENTS]
        out += [f"## {name}: {one['examples']:,} examples", "", *table(["tokens", *(f"{p} %" for p in percents)], [[m, *(one["length"][m][p] for p in percents)] for m in MEASURES])]
        limits = sorted(one["limit"].items(), key=lambda kv: int(kv[0]))
        out += table(["token limit", "cut off", "cut off, %", "response kept, %", "no response left"], [[int(k), v["truncated"], v["truncated_percent"], v["response_retained_percent"], v["without_response"]] for k, v in limits])
        out += table(["field", "repeated literally", "%"], [[k, v["rows"], v["percent"]] for k, v in one["mention"].items()])
        out += table(["category", "rows"], one["category"].items())
    return "\n".join([*out, "That a field is not repeated does not show that it was ignored.", ""])


def loss_rows(scored: DataFrame) -> DataFrame:
    """(model, tokens, response_loss, perplexity) of scored(model, loss, tokens)."""
    return metrics.response_loss(scored, "model").orderBy("model")


def generations_markdown(title: str, settings: Mapping[str, Any], losses: DataFrame | None, cases: DataFrame, fields: Sequence[str]) -> str:
    """Settings, losses of models, and each case of cases(case, model, output, [reference], fields...) with what every model wrote; cases of a review are few."""
    out = [f"# {title}", "", *table(["setting", "value"], [(k, str(v)) for k, v in settings.items()])]
    if losses is not None:
        out += table(["model", "tokens", "mean loss", "perplexity"], [(r["model"], r["tokens"], f"{r['response_loss']:.4f}", f"{r['perplexity']:.2f}") for r in loss_rows(losses).collect()])
    seen = None
    for r in cases.orderBy("case", "model").collect():
        if r["case"] != seen:
            seen = r["case"]
            out += [f"## {seen}", "", ", ".join(f"{f}: {r[f]}" for f in fields), ""]
            if "reference" in cases.columns:
                out += [f"Reference: {r['reference']}", ""]
        out += [f"{r['model']}: {r['output'] or '(no text)'}", ""]
    return "\n".join(out)


def one_field_changed(base: Mapping[str, str], **others: str) -> list[dict[str, str]]:
    """The base case and, for each field of others, the same with that field changed."""
    if unknown := {*others} - {*base}:
        raise ValueError(f"no fields {', '.join(sorted(unknown))}")
    return [{"case": "baseline", **base}, *({"case": f"change-{f}", **base, f: v} for f, v in others.items())]


def same_as_baseline(cases: DataFrame) -> DataFrame:
    """(case, model, changed): whether a model's output for a changed case differs from its own for the baseline; cases(case, model, output)."""
    base = cases.where("case = 'baseline'").select("model", F.col("output").alias("_first"))
    return cases.where("case <> 'baseline'").join(base, "model").select("case", "model", (~F.col("output").eqNullSafe(F.col("_first"))).alias("changed"))
