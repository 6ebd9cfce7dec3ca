"""Audits of text rows: lengths, limits, mentions of prompt fields and lexical cues."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text

# The named fields of a marked prompt, the signs and the cue patterns of each category.
FIELDS = r"### Sign:\n([^\n]+)\n\n### Category:\n([^\n]+)\n\n### Date:\n([^\n]+)"
MARKER = "### Horoscope:\n"
SIGNS = ("Aries", "Taurus", "Gemini", "Cancer", "Leo", "Virgo", "Libra", "Scorpio", "Sagittarius", "Capricorn", "Aquarius", "Pisces")
CUES = {
    "Birthday": r"\b(?:birthday|birthdays|born|party|parties|celebrat\w*)\b",
    "Career": r"\b(?:career|careers|work|working|job|jobs|office|business|boss|promotion|interview|professional)\b",
    "Love": r"\b(?:love|loving|romance|romantic|relationship|partner|dating|affection|intimacy|intimate|crush)\b",
    "Wellness": r"\b(?:health|healthy|wellness|diet|exercise|rest|sleep|stress|body|breathe|breathing|relax\w*|illness)\b",
}
# The token limits and percentiles of a report.
LIMITS, PERCENTS = (128, 256, 384, 512), (50, 90, 95, 99, 100)


def parsed(df: DataFrame, marker: str = MARKER, column: str = "text") -> DataFrame:
    """df with prompt (marker included), response (stripped), sign, category and date; a row without them stops the query."""
    before, there, after = text.partition(F.col(column), marker)
    ok = there & F.regexp_like(before, F.lit(FIELDS))
    checked = F.when(ok, before).otherwise(F.raise_error(F.lit("no marker or fields in a row")))
    fields = {n: F.regexp_extract("_before", FIELDS, i + 1) for i, n in enumerate(("sign", "category", "date"))}
    return df.withColumn("_before", checked).withColumns({"prompt": F.concat("_before", F.lit(marker)), "response": text.strip(after), **fields}).drop("_before")


def length_audit(df: DataFrame, max_length: int, *by: str) -> DataFrame:
    """(rows, over_max_length, fraction_over, longest_tokens) of a column length."""
    over = F.count_if(F.col("length") > max_length)
    return df.groupBy(*by).agg(F.count("*").alias("rows"), over.alias("over_max_length"), F.coalesce(F.try_divide(over.cast("double"), F.count("*")), F.lit(0.0)).alias("fraction_over"), F.coalesce(F.max("length"), F.lit(0)).cast("long").alias("longest_tokens"))


def percentiles(df: DataFrame, columns: Sequence[str], percents: Sequence[int] = PERCENTS) -> DataFrame:
    """(measure, percent, value) by nearest rank."""
    one = df.agg(*(F.expr(f"percentile_disc({p / 100}) WITHIN GROUP (ORDER BY `{c}`)").alias(f"{c}_{p}") for c in columns for p in percents))
    listed = [F.struct(F.lit(c).alias("measure"), F.lit(p).alias("percent"), F.col(f"{c}_{p}").cast("long").alias("value")) for c in columns for p in percents]
    return one.select(F.inline(F.array(*listed)))


def limit_sweep(df: DataFrame, limits: Sequence[int] = LIMITS) -> DataFrame:
    """What each token limit cuts off rows of (prompt_tokens, response_tokens). One pass for all limits."""
    p, r = F.col("prompt_tokens"), F.col("response_tokens")
    sums = [F.count("*").alias("n"), F.sum(r).alias("r")]
    for k in limits:
        sums += [F.count_if(p + r > k).alias(f"cut{k}"), F.sum(F.least(r, F.greatest(F.lit(0), k - p))).alias(f"kept{k}"), F.count_if(p >= k).alias(f"none{k}")]
    rate = lambda a, b: F.try_divide(100.0 * a, b)
    rows = [
        F.struct(F.lit(k).alias("token_limit"), F.col(f"cut{k}").alias("truncated"), rate(F.col(f"cut{k}"), F.col("n")).alias("truncated_percent"), rate(F.col(f"kept{k}"), F.col("r")).alias("response_retained_percent"), F.col(f"none{k}").alias("without_response"))
        for k in limits
    ]
    return df.agg(*sums).select(F.inline(F.array(*rows)))


def mentions(df: DataFrame, response: str = "response") -> DataFrame:
    """(field, rows, percent) of rows whose response repeats a prompt field literally."""
    c = F.col(response)
    found = {
        "sign": text.literal_word(c, F.col("sign")),
        "category": text.literal_word(c, F.col("category")),
        "exact_date": F.contains(c, F.col("date")),
        "year": F.contains(c, F.substring("date", 1, 4)),
    }
    one = df.agg(F.count("*").alias("n"), *(F.count_if(v).alias(k) for k, v in found.items()))
    return one.select(F.inline(F.array(*(F.struct(F.lit(k).alias("field"), F.col(k).alias("rows"), F.try_divide(100.0 * F.col(k), F.col("n")).alias("percent")) for k in found))))


def category_counts(df: DataFrame, field: str) -> DataFrame:
    return df.groupBy(field).agg(F.count("*").alias("rows"))


def cue_audit(df: DataFrame, output: Column, signs: Sequence[str] = SIGNS, cues: Mapping[str, str] = CUES) -> DataFrame:
    """df with requested_sign_mentioned, other_signs_mentioned, category_cue (null for a category without a pattern) and exact_date_mentioned."""
    # One pass finds all signs; upper and then lower case bring every spelling that the pattern takes for a letter to that letter.
    found = F.transform(F.regexp_extract_all(output, F.lit(rf"(?U)(?iu)\b(?:{'|'.join(signs)})\b"), 0), lambda x: F.lower(F.upper(x)))
    named = F.filter(F.array(*map(F.lit, signs)), lambda s: F.array_contains(F.col("_found"), F.lower(s)))
    cue = F.lit(None).cast("boolean")
    for category, pattern in cues.items():
        cue = F.when(F.col("category") == category, F.regexp_like(output, F.lit(f"(?U)(?iu){pattern}"))).otherwise(cue)
    date = F.contains(output, F.col("date")) | F.contains(output, F.replace(F.col("date"), F.lit("/"), F.lit("-")))
    return df.withColumn("_found", found).withColumn("_named", named).withColumns({
        "requested_sign_mentioned": F.array_contains("_named", F.col("sign")),
        "other_signs_mentioned": F.filter("_named", lambda s: s != F.col("sign")),
        "category_cue": cue,
        "exact_date_mentioned": date,
    }).drop("_named", "_found")


def cue_summary(audited: DataFrame, *by: str) -> DataFrame:
    return audited.groupBy(*by).agg(
        F.count("*").alias("cases"),
        F.count_if("requested_sign_mentioned").alias("requested_sign_mentioned"),
        F.count_if(F.size("other_signs_mentioned") > 0).alias("other_sign_mentioned"),
        F.count_if("category_cue").alias("category_cue_present"),
        F.count("category_cue").alias("category_cue_applicable"),
        F.count_if("exact_date_mentioned").alias("exact_date_mentioned"),
    )


def length_stats(df: DataFrame, reach: int, *by: str) -> DataFrame:
    """Least, greatest and mean length; reaching counts lengths of reach or more."""
    return df.groupBy(*by).agg(F.min("length").cast("long").alias("least"), F.max("length").cast("long").alias("most"), F.avg("length").alias("mean"), F.count_if(F.col("length") >= reach).alias("reaching"))
