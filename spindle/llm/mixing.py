"""Mixing sources to target weights by repetition rates.

One aggregate gives the size of each source. Targets are set by water filling: each source gets its weight's part of
the wanted total, none more than a multiple of its own size, and what is cut off is shared again by weight. The water
level comes from running sums over the sources in the order in which they fill up: one row for each source, in one task,
with no loop. A source's rate is target / size; each document is emitted floor(rate) times and once more if a number in
[0, 1) from a hash of the seed, its id and its text falls below the fraction. For sources of few documents, whose sum could miss
the target by far, TURNS seeds are tried: turn i adds i / TURNS to all numbers of the source, modulo 1, and the turn whose sum of sizes
is nearest to the target, the lowest of equals, is the source's. All turns are summed in one aggregate over sizes and numbers,
which the first pass over the texts writes. Rates reach documents by a broadcast of the source table while its measured bytes
are few, else by a salted join, so a source with a third of all rows is no hot task.

Defined results: a null text has size 0; null is a source of its own, ranked last; a null doc_id hashes as the empty
string, as a null text does; rows of equal id and text make the same decision each; a source of size 0 has target 0 and
its documents are not taken; very long texts are counted whole; an empty table gives no rows; extra columns are kept,
whatever their names, but for a column copy, which mix replaces.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, lookup_join, materialize

WEIGHTS, SHARE, MOST = (5, 2, 1), 1.5, 2
WORD = r"[^\x20\x09-\x0D]+"
#: Hexadecimal digits of the hash: 52 bits, which a double holds exactly.
DIGITS = 13
#: Seeds of which each source gets the one whose sum is nearest to its target.
TURNS = 64


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def draw(seed: int, doc_id: Column, text: Column) -> Column:
    """A number in [0, 1) from seed, id and text alone: the same in every rerun and partitioning."""
    said = [F.coalesce(c.cast("string"), F.lit("")) for c in (doc_id, text)]
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), *said).cast("binary"))
    return F.conv(F.substring(digest, 1, DIGITS), 16, 10).cast("double") / F.lit(float(16**DIGITS))


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """(source, source_size, weight, target) from sizes(source, size)."""
    order = (F.col("source").isNull(), F.col("source"))
    t = materialize(sizes.groupBy("source").agg(F.sum("size").alias("source_size")))
    nth = F.row_number().over(Window.orderBy(*order)) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (nth % len(weights) + 1).cast("int"))
    t = t.select("source", "source_size", weight.alias("weight"), (F.col("source_size") * most).alias("cap"))
    # Sources fill up in the order of cap / weight. With the first n full, the others share what is left by weight.
    fill = Window.orderBy((F.col("cap") / F.col("weight")), *order)
    upto, whole = fill.rowsBetween(Window.unboundedPreceding, -1), fill.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = share * F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(upto), F.lit(0))
    open_weight = F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(upto), F.lit(0))
    t = t.withColumn("level", left / open_weight)
    # The first source that its level does not fill is where water stands; all before it are full.
    stands = F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct(F.col("cap") / F.col("weight"), *(c.alias(f"o{i}") for i, c in enumerate(order)), "level"))).over(whole)
    limit = F.col("cap").cast("double")
    return t.select("source", "source_size", "weight", F.coalesce(F.least(limit, stands["level"] * F.col("weight")), limit).alias("target"))


def decide(docs: DataFrame, names: Sequence[str] = ("size", "source_size", "target", "copies"), seed: int = 7, **how) -> DataFrame:
    """docs(doc_id, text, source, ...) with four more columns, called names: a row's size, its source's, that one's target, and the times that the row is emitted."""
    if {n.lower() for n in names} & {c.lower() for c in docs.columns}:
        raise ValueError(f"docs has one of the columns {', '.join(names)}; give other names")
    size, source_size, target, copies = names
    key, number, turn = (fresh(n, docs, names) for n in ("_key", "_number", "_turn"))
    of = F.coalesce(F.concat(F.lit("="), "source"), F.lit("null"))
    sized = docs.withColumn(size, size_of(F.col("text"))).withColumn(number, draw(seed, F.col("doc_id"), F.col("text"))).withColumn(key, of)
    slim = materialize(sized.select("source", *(F.col(c) for c in (key, size, number))))
    t = targets(slim.select("source", F.col(size).alias("size")), **how)
    rates = materialize(t.select(of.alias(key), F.col("source_size").alias(source_size), F.col("target").alias(target)))
    rate = F.coalesce(F.try_divide(F.col(target), F.col(source_size)), F.lit(0.0))
    whole = F.floor(rate)
    more = lambda by: _turned(F.col(number), by) < rate - whole
    sums = [F.sum(F.when(more(F.lit(i / TURNS)), F.col(size)).otherwise(0)).alias(f"{turn}{i}") for i in range(TURNS)]
    summed = lookup_join(slim.drop("source"), rates, key).groupBy(key, source_size, target).agg(*sums)
    missed = [F.struct(F.abs((whole * F.col(source_size) + F.col(f"{turn}{i}")).cast("double") - F.col(target)).alias("by"), F.lit(i / TURNS).alias("turn")) for i in range(TURNS)]
    chosen = materialize(summed.select(key, source_size, target, F.array_min(F.array(*missed))["turn"].alias(turn)))
    joined = lookup_join(sized, chosen, key)
    return joined.withColumn(copies, whole + more(F.col(turn)).cast("long")).drop(key, number, turn)


def _turned(number: Column, by: Column) -> Column:
    return number + by - F.floor(number + by)


def mix(docs: DataFrame, seed: int = 7, **how) -> DataFrame:
    """The mixed documents: the columns of docs and copy, from 1 to the times that a document is emitted (in place of any column copy)."""
    names = [fresh(f"_{n}", docs) for n in ("size", "source_size", "target", "copies")]
    times = F.col(names[-1])
    kept = [F.col(f"`{c}`") for c in docs.columns if c.lower() != "copy"]
    return decide(docs, names, seed, **how).where(times > 0).select(*kept, F.explode(F.sequence(F.lit(1).cast("long"), times)).alias("copy"))
