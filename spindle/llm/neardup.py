"""N-gram Jaccard join by MinHash banding, with near-duplicate classes.

1. Every text becomes the set of its 5-word shingles, hashed to 64 bits; a 128-bit fingerprint of the set stands for
   all rows with that set. Rows with equal sets (copies) are one node from here on.
2. Each node has a MinHash signature cut into bands; bands and rows are chosen for the target recall at the threshold.
   Nodes are shuffled on band hashes. Buckets with the same members are kept once, in their first band.
3. Buckets are dealt to cells: members are hashed into blocks of bounded size, and a cell holds one pair of blocks, so
   that a bucket of any size is spread over tasks and no pair is ever a row. In a cell all pairs are verified on the
   full sets by one product of sparse 0/1 matrices; a pair counts only in the first bucket that it shares. A cell emits
   for each member its number of links and the smallest member of its component.
4. Components come from min-label propagation with pointer jumping over those star edges.

Words are lower-cased runs of letters, digits and underscores (and any character beyond ASCII); a text of fewer than
five words has one shingle, all its words; one without words has none and no class but its own row.

Every row is judged by a key of its own content, never by its doc_id. Texts are read in place: a blocked Bloom filter
of fixed greatest size tells which rows may be wanted (for their sets, or for removal), and only those are shuffled.

Defined results: a null or wordless text links to nothing and is its own class; repeated rows are copies; rows of one
doc_id with different texts are judged apart; a null doc_id takes part, its class id being that of the smallest known id,
if any; ties go to the smaller id, then to the smaller row key; a text of any length is one set, held as 8 bytes a
shingle; an empty table gives no rows; extra columns are ignored (and kept by distinct).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, materialize, only, parted, row_key

N, THRESHOLD, RECALL, HASHES = 5, 0.8, 0.9995, 128
#: Members of a block; a cell holds two of them at most.
BLOCK = 256
U = np.uint64


def choose_bands(threshold: float = THRESHOLD, recall: float = RECALL, hashes: int = HASHES) -> tuple[int, int]:
    """(bands, rows): the most rows whose bands reach the recall at the threshold within the number of hashes."""
    best = (1, 1)
    for rows in range(1, 16):
        bands = math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows)) if threshold < 1 else 1
        if bands * rows <= hashes:
            best = (bands, rows)
    return best


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = (x ^ (x >> U(31))) * U(0x7FB5D329728EA185)
    x = (x ^ (x >> U(27))) * U(0x81DADEF4BC2DD44D)
    return x ^ (x >> U(33))


_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(97, 123), 95, *range(128, 256)]] = True


def word_hashes(texts: list[str | None]) -> list[np.ndarray]:
    """A 64-bit hash of every word, for each text; computed over a megabyte or so at a time."""
    out: list[np.ndarray] = []
    first = 0
    while first < len(texts):
        raw, size = [], 0
        while first + len(raw) < len(texts) and size < 1 << 20:
            raw.append((texts[first + len(raw)] or "").lower().encode("utf-8", "surrogatepass"))
            size += len(raw[-1])
        first += len(raw)
        data = np.frombuffer(b"\0" + b"\0".join(raw) + b"\0", np.uint8)
        word = _WORD[data]
        starts = np.flatnonzero(word[1:] & ~word[:-1]) + 1
        if len(starts):
            lengths = np.flatnonzero(word[:-1] & ~word[1:]) + 1 - starts
            place = np.arange(len(data)) - np.repeat(np.r_[0, starts], np.diff(np.r_[0, starts, len(data)]))
            powers = np.cumprod(np.full(int(lengths.max()), 0x9E3779B97F4A7C15, U))
            values = np.where(word, data, 0).astype(U) * powers[np.minimum(place, len(powers) - 1)]
            hashes = mixed(np.add.reduceat(values, starts) + lengths.astype(U))
        else:
            hashes = np.empty(0, U)
        ends = np.cumsum([len(r) + 1 for r in raw])
        cuts = np.searchsorted(starts, np.r_[0, ends])
        out += [hashes[a:b] for a, b in zip(cuts, cuts[1:])]
    return out


def shingles(words: np.ndarray, n: int = N) -> np.ndarray:
    """The sorted distinct hashes of n-word runs; of all words, if fewer."""
    n = min(n, len(words))
    if not n:
        return words
    total = np.zeros(len(words) - n + 1, U)
    for j in range(n):
        total = total * U(0xD1342543DE82EF95) + words[j : len(words) - n + 1 + j]
    return np.unique(mixed(total))


def fingerprint(s: np.ndarray) -> bytes:
    return s.sum(dtype=U).tobytes() + (mixed(s ^ U(0xA5A5A5A5A5A5A5A5)).sum(dtype=U) + U(len(s))).tobytes()


def band_hashes(sets: list[np.ndarray], bands: int, rows: int) -> np.ndarray:
    """One row of band hashes for each (non-empty) set."""
    flat = np.concatenate(sets)
    starts = np.r_[0, np.cumsum([len(s) for s in sets])[:-1]]
    rng = np.random.default_rng(20240229)
    out = np.empty((len(sets), bands), U)
    for band in range(bands):
        total = np.full(len(sets), band + 1, U)
        for _ in range(rows):
            flip, factor = rng.integers(0, 2**64, 2, U)
            total = mixed(total * U(0x9E3779B97F4A7C15) + np.minimum.reduceat((flat ^ flip) * (factor | U(1)), starts))
        out[:, band] = total
    return out


def _sign(bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, ids, texts = batch.column("key"), batch.column("doc_id"), batch.column("text")
            for at in range(0, len(ids), 512):
                sets = [shingles(w) for w in word_hashes(texts[at : at + 512].to_pylist())]
                full = [i for i, s in enumerate(sets) if len(s)]
                signed: list = [None] * len(sets)
                if full:
                    for i, row in zip(full, band_hashes([sets[i] for i in full], bands, rows).view(np.int64)):
                        signed[i] = row
                fps = [fingerprint(s) if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays([keys[at : at + 512], ids[at : at + 512], pa.array(fps, pa.binary()), pa.array(signed, pa.list_(pa.int64()))], ["key", "doc_id", "fp", "bands"])

    return run


def _full_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sets of the rows whose fingerprint is the wanted one."""
    for batch in batches:
        wanted, texts = batch.column("fp").to_pylist(), batch.column("text")
        for at in range(0, len(wanted), 512):
            sets = [shingles(w) for w in word_hashes(texts[at : at + 512].to_pylist())]
            kept = [(fp, s.view(np.int64)) for fp, s in zip(wanted[at : at + 512], sets) if len(s) and fingerprint(s) == fp]
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in kept], pa.binary()), pa.array([s for _, s in kept], pa.list_(pa.int64()))], ["fp", "shingles"])


def jaccard_links(sets: list[np.ndarray], threshold: float) -> np.ndarray:
    """The Boolean matrix of pairs whose sets reach the threshold. Shingles of one set alone take part in sizes only."""
    sizes = np.array([len(s) for s in sets], np.float64)
    shared, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), sizes.astype(np.int64))
    often = count[column] > 1
    number = np.cumsum(count > 1) - 1
    row, column = row[often], number[column[often]]
    both = np.zeros((len(sets), len(sets)))
    width = 8192
    for first in range(0, int((count > 1).sum()), width):
        inside = (column >= first) & (column < first + width)
        x = np.zeros((len(sets), width), np.float32)
        x[row[inside], column[inside] - first] = 1
        both += x @ x.T
    links = both >= threshold * (sizes[:, None] + sizes - both) - 1e-9
    np.fill_diagonal(links, False)
    return links


def _verify(threshold: float):
    out = pa.schema([("fp", pa.binary()), ("links", pa.int64()), ("root", pa.binary())])

    def cell(rows: list[dict]) -> list[tuple]:
        rows.sort(key=lambda r: r["fp"])
        links = jaccard_links([r["shingles"] for r in rows], threshold)
        bands = np.array([r["bands"][: r["band"]] for r in rows], np.int64).reshape(len(rows), -1)
        for b in bands.T:  # counted in an earlier bucket
            links &= b[:, None] != b
        if rows[0]["low"] != rows[0]["high"]:
            side = np.array([r["own"] for r in rows])
            links &= side[:, None] != side
        label = np.arange(len(rows))
        while True:
            least = np.minimum(label, np.where(links, label, len(rows)).min(axis=1))
            if (least == label).all():
                break
            label = least
        n = links.sum(axis=1)
        return [(rows[i]["fp"], int(n[i]), rows[label[i]]["fp"]) for i in np.flatnonzero(n)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by cell; one cell is held at a time."""
        key, held, found = None, [], []
        for batch in batches:
            lists = batch.column("shingles")
            flat, cuts = lists.values.to_numpy(), lists.offsets.to_numpy()
            for i, r in enumerate(batch.drop_columns(["shingles"]).to_pylist()):
                r["shingles"] = flat[cuts[i] : cuts[i + 1]]  # a view: a long text's set never becomes Python integers
                k = (r["bucket"], r["low"], r["high"])
                if k != key:
                    found += cell(held) if len(held) > 1 else []
                    key, held = k, []
                held.append(r)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), out.types)], schema=out)
                found = []
        found += cell(held) if len(held) > 1 else []
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), out.types)], schema=out)

    return run


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for the nodes of edges(a, b): root is the smallest node of the component. All state is in tables."""
    both = materialize(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.min(F.least("a", "b")).alias("root")))
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "root"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        step = labels.join(near, "node").select("node", F.col("root").alias("old"), F.least("root", "near").alias("root"))
        hop = labels.select(F.col("node").alias("root"), F.col("root").alias("hop"))
        new = materialize(step.join(hop, "root", "left").select("node", "old", F.least("root", F.coalesce("hop", "root")).alias("root")))
        labels = new.select("node", "root")
        if new.where("old <> root").isEmpty():
            return labels


def _classes(source: DataFrame, threshold: float, recall: float) -> tuple[DataFrame, DataFrame]:
    """Tables (key, doc_id, fp) of all rows of source(key, doc_id, text), and (fp, chosen, n_links, n_copies) of all sets.

    chosen is the row that stands for the set's class: (no id, id, key), the smallest of its rows.
    """
    bands, rows = choose_bands(threshold, recall)
    kind = source.schema["doc_id"].dataType.simpleString()
    signed = materialize(source.mapInArrow(_sign(bands, rows), f"key struct<a:bigint,b:bigint>, doc_id {kind}, fp binary, bands array<bigint>"))
    row = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "key")
    nodes = materialize(signed.where("fp is not null").groupBy("fp").agg(F.min(row).alias("rep"), F.first("bands").alias("bands"), F.count("*").alias("copies")))
    dealt = nodes.select("fp", F.posexplode("bands").alias("band", "bucket"))
    marks = [F.bit_xor(F.xxhash64("fp", F.lit(i))).alias(f"mark{i}") for i in range(2)]
    buckets = dealt.groupBy("band", "bucket").agg(F.count("*").alias("n"), *marks).where("n > 1")
    first = buckets.groupBy("n", "mark0", "mark1").agg(F.min(F.struct("band", "bucket")).alias("b")).select("n", "b.band", "b.bucket")
    members = materialize(dealt.join(first, ["band", "bucket"]))
    wanted = materialize(members.select("fp").distinct().join(nodes.select("fp", F.col("rep.key").alias("key"), "bands"), "fp"))
    texts = parted(source, wanted, "key")[1].join(wanted.select("key", "fp"), "key").select("fp", "text")
    sets = materialize(texts.mapInArrow(_full_sets, "fp binary, shingles array<bigint>").dropDuplicates(["fp"]))
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("fp", F.lit(7)), F.col("blocks")).cast("int")
    cells = members.withColumn("blocks", blocks).withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cells = cells.select("fp", "bucket", "band", "own", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"))
    cells = cells.join(sets, "fp").join(wanted.select("fp", "bands"), "fp")
    at = ["bucket", "low", "high"]
    found = materialize(cells.repartition(*at).sortWithinPartitions(*at).mapInArrow(_verify(threshold), "fp binary, links bigint, root binary"))
    links = found.groupBy("fp").agg(F.sum("links").alias("links"))
    roots = components(found.where("fp <> root").select(F.col("fp").alias("a"), F.col("root").alias("b")))
    least = roots.join(nodes.select(F.col("fp").alias("node"), "rep"), "node").groupBy("root").agg(F.min("rep").alias("chosen"))
    linked = roots.join(least, "root").select(F.col("node").alias("fp"), "chosen").join(links, "fp", "left")
    judged = nodes.select("fp", "rep", "copies").join(linked, "fp", "left").select("fp", F.coalesce("chosen", "rep").alias("chosen"), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.col("copies").alias("n_copies"))
    # Materialised, so that the join with all rows stands alone in its stage, where a set with many copies can be split.
    return signed.select("key", "doc_id", "fp"), materialize(judged)


def join(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """(doc_id, class_id, n_links, n_copies) for every row of docs(doc_id, text).

    n_links counts the different texts that reach the threshold with the row's own, n_copies the rows of its set.
    """
    own = only(docs, "doc_id", "text")
    rows, judged = _classes(own.select(row_key(own).alias("key"), "doc_id", "text"), threshold, recall)
    some = rows.where("fp is not null").join(judged, "fp").select("doc_id", F.col("chosen.doc_id").alias("class_id"), "n_links", "n_copies")
    none = rows.where("fp is null").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.lit(1).cast("long").alias("n_copies"))
    return some.unionByName(none)


def distinct(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """docs with one row of each class: that with the class's id (the smallest row key, if no row has an id). Rows without words all stay."""
    key = fresh("_key", docs)
    keyed = docs.withColumn(key, row_key(docs))
    rows, judged = _classes(keyed.select(F.col(key).alias("key"), "doc_id", "text"), threshold, recall)
    judged = judged.select("fp", F.col("chosen.key").alias("kept"))
    other = materialize(rows.where("fp is not null").join(judged, "fp").select("key", (F.col("key") != F.col("kept")).alias("gone")))
    # Rows that go, and chosen rows that are repeated whole, of which one stays.
    some = other.groupBy("key").agg(F.max("gone").alias("gone"), F.count("*").alias("n")).where("gone or n > 1")
    some = materialize(some.select(F.col("key").alias(key), F.col("gone").alias(f"{key}_gone")))
    clear, rest = parted(keyed, some, key)
    columns = [F.col(f"`{c}`") for c in docs.columns]
    rest = rest.join(some, key, "left")
    out = clear.select(*columns).unionByName(rest.where(F.col(f"{key}_gone").isNull()).select(*columns))
    if some.where(~F.col(f"{key}_gone")).isEmpty():
        return out
    once = rest.where(~F.col(f"{key}_gone")).groupBy(key).agg(F.first(F.struct(*columns)).alias(key + "_row"))
    return out.unionByName(once.select(f"{key}_row.*"))
