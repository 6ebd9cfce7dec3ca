"""WARC archives: written with payload deduplication, read back by boundary-chain verification.

Writing: records are text rows ended by the blank lines that the format asks for, so Spark's own writer makes the
files on any file system. Of pages with equal payloads (equal length and SHA-1) of at least least_bytes, the one with
the largest page_id becomes a response and the others revisits that refer to it. Only digests that occur more than
once take part in a join.

Reading: files are cut at the magic ``WARC/1.``, by Spark's splittable text reader. A piece that parses as a header is
a candidate record with a successor offset (its own end). Within a split the chain of each candidate is followed to
the first offset beyond it; over the splits, only the candidates at such offsets remain, and pointer jumping from each
file's start keeps the reachable ones in log2(splits of a file) rounds. A magic inside a payload is on no such chain.
The last pass follows each split's chain from its verified entry; a payload cut by a magic is put together again, also
where it runs over splits.

Defined results: a null html is an empty payload; control characters, spaces and percent signs of a url
are percent-encoded in the header and decoded again (a null url comes back empty); a payload of more than 2 GB is beyond what a Spark value can hold; rows
without page_id are responses each; repeated rows of the largest page_id are responses each; a file that does not start
with a record has no records; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.tables import scratch
from .common import BROADCAST_BYTES, bytes_of, lookup_join, materialize, only

MAGIC = "WARC/1."
END = "\r\n\r\n"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8"


def base32_sha1(data: Column) -> Column:
    """SHA-1 in upper-case base32: 160 bits are 8 groups of 20, each 5 hexadecimal digits and 4 letters."""
    digits = F.sha1(data)
    letters = []
    for g in range(8):
        n = F.conv(F.substring(digits, 5 * g + 1, 5), 16, 10).cast("int")
        letters += [F.substring(F.lit(BASE32), F.shiftright(n, s).bitwiseAND(F.lit(31)) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*letters)


#: Characters of a url that would break a header line, and the percent sign, without which no url could be given back.
ESCAPED = "%" + "".join(map(chr, range(0x21))) + "\x7f"


def encoded_url(url: Column) -> Column:
    out = url
    for c in ESCAPED:
        out = F.replace(out, F.lit(c), F.lit(f"%{ord(c):02X}"))
    return F.when(F.regexp_like(url, F.lit(r"[%\x00-\x20\x7F]")), out).otherwise(url)


def decoded_url(url: Column) -> Column:
    out = url
    for c in reversed(ESCAPED):
        out = F.replace(out, F.lit(f"%{ord(c):02X}"), F.lit(c))
    return F.when(F.contains(url, F.lit("%")), out).otherwise(url)


def decided(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """page_id, url, payload, n_bytes, digest, refers_to (null for a response)."""
    payload = F.coalesce(F.col("html"), F.lit(""))
    p = only(pages, "page_id", "url", "html").select("page_id", "url", payload.alias("payload"), F.octet_length(payload).cast("long").alias("n_bytes"))
    p = p.withColumn("digest", base32_sha1(F.col("payload").cast("binary")))
    key = F.concat_ws(":", "digest", "n_bytes")
    twins = p.where(F.col("n_bytes") >= least_bytes).groupBy(key.alias("twin")).agg(F.count("*").alias("n"), F.max("page_id").alias("kept")).where("n > 1").drop("n")
    p = lookup_join(p.withColumn("twin", key), materialize(twins), "twin", how="left")
    return p.withColumn("refers_to", F.when(F.col("page_id") != F.col("kept"), F.col("kept"))).drop("twin", "kept")


def write(pages: DataFrame, path: str, least_bytes: int = 0, date: str = "2024-01-01T00:00:00Z") -> None:
    d = decided(pages, least_bytes)
    revisit = F.col("refers_to").isNotNull()
    url = encoded_url(F.coalesce("url", F.lit("")))
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit(">"))
    line = lambda key, *value: F.concat(F.lit(f"\r\n{key}: "), *value)
    block = F.concat(F.lit(HTTP + END), F.when(revisit, F.lit("")).otherwise(F.col("payload")))
    header = F.concat(
        F.lit(f"{MAGIC}1"),
        line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", name("page_id")),
        line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", url),
        line("WARC-Payload-Digest", F.lit("sha1:"), F.col("digest")),
        F.when(revisit, F.concat(line("WARC-Profile", F.lit(PROFILE)), line("WARC-Refers-To", name("refers_to")), line("X-Payload-Length", F.col("n_bytes").cast("string")))).otherwise(""),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", F.octet_length(block).cast("string")),
    )
    d.select(F.concat(header, F.lit(END), block).alias("value")).write.option("lineSep", END).text(path)


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.option("lineSep", MAGIC).text(path)
    return raw.select(F.col("value").cast("binary").alias("value"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))


def _header(piece: bytes) -> tuple[int, int, dict[str, str]] | None:
    """(bytes before the block, length of the block, fields) of a piece that reads as a record's header."""
    end = piece.find(b"\r\n\r\n")
    if end < 0 or piece[1:3] != b"\r\n" or piece[:1] not in b"01":
        return None
    fields = {}
    for row in piece[3:end].split(b"\r\n"):
        key, colon, value = row.partition(b":")
        if not colon:
            return None
        fields[key.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    length = fields.get("content-length", "")
    return (end + 4, int(length), fields) if length.isascii() and length.isdigit() else None


def _splits(batches: Iterator[pa.RecordBatch], *more: str) -> Iterator[tuple]:
    """(piece, (file, block, ...)) in the order of the scan."""
    for b in batches:
        yield from zip(b.column("value").to_pylist(), zip(*(b.column(c).to_pylist() for c in ("file", "block", *more))))


def _chains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each split, offsets relative to its first piece: (start, exit, last) of each candidate, and a row without start whose exit is the split's length."""
    sep = len(MAGIC)

    def closed(split: tuple, found: list[tuple[int, int]], total: int) -> pa.RecordBatch:
        chain: dict[int, tuple[int | None, int]] = {}
        for start, after in reversed(found):
            if after + sep >= total:
                chain[start] = (after, start)
            else:
                chain[start] = chain.get(after, (None, start))
        rows = [(*split, s, *chain[s]) for s, _ in found] + [(*split, None, total, None)]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), CHAINS.types)], schema=CHAINS)

    split, found, at = None, [], 0
    for piece, key in _splits(batches):
        if key != split:
            if split:
                yield closed(split, found, at)
            split, found, at = key, [], 0
        if (h := _header(piece)) and (at or key[1]):
            found.append((at - sep, at + h[0] + h[1] + len(END)))
        at += len(piece) + sep
    if split:
        yield closed(split, found, at)


CHAINS = pa.schema([("file", pa.string()), ("block", pa.int64()), ("start", pa.int64()), ("exit", pa.int64()), ("last", pa.int64())])
RECORDS = pa.schema([("file", pa.string()), ("start", pa.int64()), ("at", pa.int64()), ("fields", pa.map_(pa.string(), pa.string())), ("data", pa.binary()), ("whole", pa.bool_())])


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole records, and parts of those that run over the split: what they hold of the record, to be put together."""
    sep, magic = len(MAGIC), MAGIC.encode()
    rows: list[tuple] = []

    def flush() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), RECORDS.types)], schema=RECORDS)
        rows.clear()
        return out

    def done(state: list | None) -> None:
        if state and state[3]:
            start, need, fields, parts = state[1:3] + [state[4], state[3]]
            data = b"".join(parts)
            whole = fields is not None and len(data) >= need
            rows.append((state[0], start, state[5], list((fields or {}).items()), data[:need] if whole else data, whole))

    split, state, at, expect, size = None, None, 0, None, 0
    for piece, key in _splits(batches, "base", "entry", "owner"):
        if key != split:
            done(state)
            split, at, expect = key, key[2], key[3]
            state = [key[0], key[4], 0, [], None, at - sep] if key[4] is not None else None
        if expect is not None and at - sep == expect and (h := _header(piece)):
            done(state)
            expect = at + h[0] + h[1] + len(END)
            state = [key[0], at - sep, h[1], [piece[h[0] :]], h[2], at - sep]
        elif state:
            state[3].append(magic + piece)
        at += len(piece) + sep
        size += len(piece)
        if rows and size > 1 << 23:
            size = 0
            yield flush()
    done(state)
    if rows:
        yield flush()


def _reachable(nodes: DataFrame) -> DataFrame:
    """(file, at) of the nodes (file, at, jump) that are on the chain from their file's start, by pointer jumping."""
    nodes = materialize(nodes)
    reached = materialize(nodes.where("at = 0").select("file", "at"))
    n = reached.count()
    while True:
        step = reached.join(nodes, ["file", "at"]).select("file", F.col("jump").alias("at"))
        wider = materialize(reached.unionByName(step.join(nodes.select("file", "at"), ["file", "at"])).distinct())
        m = wider.count()
        if m == n:
            return wider
        reached, n = wider, m
        far = nodes.select("file", F.col("at").alias("jump"), F.col("jump").alias("far"))
        nodes = materialize(nodes.join(far, ["file", "jump"], "left").select("file", "at", F.coalesce("far", "jump").alias("jump")))


def read(spark: SparkSession, path: str) -> DataFrame:
    """(file, start, fields, block) of every verified record under path; fields by lower-case name, block in bytes."""
    pieces = _pieces(spark, path)
    chains = materialize(pieces.mapInArrow(_chains, "file string, block long, start long, exit long, last long"))
    in_file = Window.partitionBy("file").orderBy("block")  # a file's splits: one row for each block of it
    before = in_file.rowsBetween(Window.unboundedPreceding, -1)
    bases = chains.where("start is null").select("file", "block", F.coalesce(F.sum("exit").over(before), F.lit(0)).alias("base"))
    bases = materialize(bases)
    split = F.concat_ws("#", "file", "block")
    based = lookup_join(chains.where("start is not null").withColumn("split", split), bases.select(split.alias("split"), "base"), "split")
    c = materialize(based.select("file", "block", *((F.col(x) + F.col("base")).alias(x) for x in ("start", "exit", "last"))))
    ends = c.where("exit is not null").select("file", F.col("exit").alias("start")).distinct()
    entries = c.join(ends, ["file", "start"], "left_semi").unionByName(c.where("start = 0")).dropDuplicates(["file", "start"])
    entries = materialize(entries)
    reached = _reachable(entries.select("file", F.col("start").alias("at"), F.col("exit").alias("jump")))
    verified = entries.join(reached.select("file", F.col("at").alias("start")), ["file", "start"])
    # The record that a split begins in is the last one of the nearest earlier split that has an entry.
    plan = bases.join(verified.select("file", "block", F.col("start").alias("entry"), "last"), ["file", "block"], "left")
    plan = plan.withColumn("owner", F.last("last", ignorenulls=True).over(before))
    plan = materialize(plan.select(split.alias("split"), "base", "entry", "owner"))
    dealt = pieces.withColumn("split", split)
    if bytes_of(plan) <= BROADCAST_BYTES:
        dealt = dealt.join(F.broadcast(plan), "split")
    else:  # too many splits to broadcast: each is sent whole to one task and put in the order of its scan
        dealt = dealt.withColumn("nth", F.monotonically_increasing_id()).join(plan, "split").repartition(plan.count() // 8 + 1, "split").sortWithinPartitions("split", "nth")
    rows = dealt.select("value", "file", "block", "base", "entry", "owner").mapInArrow(_records, "file string, start long, at long, fields map<string,string>, data binary, whole boolean")
    whole = rows.where("whole").select("file", "start", "fields", F.col("data").alias("block"))
    parts = rows.where("not whole").groupBy("file", "start").agg(F.array_sort(F.collect_list(F.struct("at", F.map_entries("fields").alias("fields"), "data"))).alias("p"))  # the splits of one record
    fields = F.map_from_entries(F.col("p")[0]["fields"])
    data = F.aggregate("p", F.lit(b""), lambda a, x: F.concat(a, x["data"]))
    need = F.element_at(fields, "content-length").cast("int")
    joined = parts.select("file", "start", fields.alias("fields"), F.substring(data, F.lit(1), need).alias("block"))
    return whole.unionByName(joined.where(F.octet_length("block") == F.element_at("fields", "content-length").cast("int")))


def page_records(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, url, record_type, refers_to, payload, payload_bytes, payload_digest) of archives that write() made."""
    field = lambda name: F.element_at("fields", name)
    page = lambda name: F.regexp_extract(field(name), r"<urn:page:(-?\d+)>", 1).try_cast("long")
    cut = len(HTTP + END)
    payload = F.substring("block", cut + 1, 2**31 - 1 - cut)
    response = field("warc-type") == "response"
    return read(spark, path).select(
        page("warc-record-id").alias("page_id"),
        decoded_url(field("warc-target-uri")).alias("url"),
        field("warc-type").alias("record_type"),
        page("warc-refers-to").alias("refers_to"),
        F.when(response, payload).alias("payload"),
        F.when(response, F.octet_length(payload)).otherwise(field("x-payload-length").try_cast("long")).cast("long").alias("payload_bytes"),
        F.when(response, base32_sha1(payload)).otherwise(F.regexp_replace(field("warc-payload-digest"), "^sha1:", "")).alias("payload_digest"),
    )


def round_trip(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """The records of pages, written to shared scratch storage and read back."""
    path = scratch(pages.sparkSession)
    write(pages, path, least_bytes)
    return page_records(pages.sparkSession, path)
