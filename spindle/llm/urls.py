"""URL filters: a blocked Bloom filter of listed canonical URLs in front of an exact hash join.

Listed entries are host+path keys such as ``example.net/en/``. A page url is looked up by its host suffixes joined to
its path prefixes, as in public safe-browsing lists. The filter is a table of 256-bit blocks keyed by block number,
so a probe is one join; it has a fixed greatest size and is broadcast. Keys that pass are joined with the list itself,
which removes every false positive.

Defined results: a null url, or one without ``://``, has empty host and path and gets the default verdict; repeated
rows are judged alike and all returned; repeated keys of the list count once, with the smallest verdict; an empty
list or page table gives default verdicts or no rows; extra columns of either table are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import block_of, bloom_blocks, bloom_table, lookup_join, lower_ascii, may_hold, only

URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    return lower_ascii(F.coalesce(F.regexp_extract(url, URL, 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, URL, 2), F.lit(""))


def rule_keys(rules: DataFrame) -> DataFrame:
    """(key, verdict) of distinct listed entries, from columns host, path, verdict."""
    r = only(rules, "host", "path", "verdict").where("host is not null and path is not null and host <> ''")
    return r.groupBy(F.concat(lower_ascii(F.col("host")), "path").alias("key")).agg(F.min("verdict").alias("listed_verdict"))


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """(page_id, host, path, rule, verdict) for every row of pages(page_id, url)."""
    listed = rule_keys(rules)
    shape = listed.agg(
        F.count("*").alias("n"),
        F.max(F.size(F.split(F.substring_index("key", "/", 1), r"\."))).alias("labels"),
        F.collect_set(F.length("key") - F.length(F.substring_index("key", "/", 1))).alias("lengths"),
    ).first()  # one row; path lengths are bounded by the longest listed url
    urls = only(pages, "page_id", "url").select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    none = F.lit(None).cast("string")
    if not shape["n"]:
        return urls.select("page_id", "host", "path", none.alias("rule"), F.lit(default).alias("verdict"))
    blocks = bloom_blocks(shape["n"])
    labels = F.split("host", r"\.")
    deepest = F.least(F.size(labels), F.lit(shape["labels"]))
    suffixes = F.transform(F.sequence(F.lit(1), deepest), lambda i: F.array_join(F.slice(labels, -i, i), "."))
    lengths = F.filter(F.array(*(F.lit(x) for x in sorted(shape["lengths"]))), lambda x: x <= F.length("path"))
    keys = F.flatten(F.transform(suffixes, lambda s: F.transform(lengths, lambda x: F.concat(s, F.substring(F.col("path"), F.lit(1), x)))))
    places = urls.select("host", "path").distinct()  # the verdict depends on these alone
    probes = places.select("host", "path", F.explode(keys).alias("key")).withColumn("block", block_of(F.col("key"), blocks))
    passed = probes.join(F.broadcast(bloom_table(listed, "key", blocks, "block")), "block").where(may_hold(F.col("key"), "block"))  # 8 MB at most
    exact = lookup_join(passed.select("host", "path", "key"), listed, "key")
    best = exact.groupBy("host", "path").agg(F.max(F.struct(F.length("key").alias("n"), F.length(F.substring_index("key", "/", 1)).alias("h"), "key", "listed_verdict")).alias("best"))
    best = best.select("host", "path", F.col("best.key").alias("rule"), "best.listed_verdict")
    # One host and path may be that of many pages: adaptive execution splits such a key. Pages without a host need none.
    known = urls.where("host <> ''").join(best, ["host", "path"], "left").select("page_id", "host", "path", "rule", F.coalesce("listed_verdict", F.lit(default)).alias("verdict"))
    return known.unionByName(urls.where("host = ''").select("page_id", "host", "path", none.alias("rule"), F.lit(default).alias("verdict")))
