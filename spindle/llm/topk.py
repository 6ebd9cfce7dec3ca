"""Exact top-k inner products over an impact-ordered index, score at a time.

Vectors stay where they are read. A task indexes them a bounded block at a time: each dimension is a posting list in the
order of its values, quantised to LEVELS steps of the block's range, and a segment is the run of postings of one dimension
with one quantised value. Queries come to the tasks in broadcasts of bounded size, each of which takes one pass.

For a query the segments of all dimensions are processed in the order of their descending quantised impact. After each
few of them every vector has a proven upper and lower bound of its score. Vectors whose upper bound is below the k-th best
lower bound, or below the k-th best score of the blocks before, are proven not to be members. When few enough remain
possible, or all segments are done, the possible members are rescored exactly from the whole vectors. Bounds are doubles,
scaled by a power of two and widened by more than their rounding errors; exact scores are integers.

Defined results: vectors that are null or hold null or non-finite components take no part, as queries or candidates;
components beyond 1e300 count as 1e300, and scores beyond 64 bits as the greatest or smallest 64-bit integer, of which
the smaller vec_id comes first; shorter vectors count as ended by zeros; rows with the query's vec_id are its own and no
candidates; rows with a null vec_id are ignored; of repeated query ids the smallest vector counts; repeated candidates
appear each; equal scores go to the smaller vec_id; empty tables give no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, only

SCALE, LEVELS, MOST = 1024.0, 128, 1e300
#: Values of an index block and of a broadcast of queries, and the parts in which segments are processed.
BLOCK_VALUES, QUERY_VALUES, PARTS = 1_280_000, 4_000_000, 16


def _usable(v: Column) -> Column:
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))
    return v.isNotNull() & F.forall(v, finite)


def _ready(df: DataFrame) -> DataFrame:
    """(vec_id, v) of the rows that take part."""
    rows = only(df, "vec_id", "embedding").where(F.col("vec_id").isNotNull() & _usable(F.col("embedding")))
    within = lambda x: F.least(F.greatest(x.cast("double"), F.lit(-MOST)), F.lit(MOST))
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", within).alias("v"))


def quantised(lists: pa.ListArray) -> np.ndarray:
    """floor(1024 * x) of every component, as doubles that are integers; a row for each vector, ended by zeros."""
    lengths = np.diff(lists.offsets.to_numpy())
    out = np.zeros((len(lengths), max(1, int(lengths.max(initial=0)))))
    out[np.arange(out.shape[1]) < lengths[:, None]] = np.floor(SCALE * lists.flatten().to_numpy())
    return out


def widened(a: np.ndarray, width: int) -> np.ndarray:
    return a if a.shape[1] == width else np.pad(a, ((0, 0), (0, width - a.shape[1])))


def power_over(a: np.ndarray) -> float:
    """A power of two that no value exceeds."""
    return 2.0 ** int(np.frexp(np.abs(a).max(initial=1.0))[1])


def exact(vectors: np.ndarray, q: np.ndarray) -> np.ndarray:
    """The integer inner products, limited to 64 bits. Doubles hold them while no sum can pass 2 ** 53."""
    if np.abs(vectors).max(initial=0.0) * np.abs(q).max(initial=0.0) * len(q) < 2.0**53:
        return (vectors @ q).astype(np.int64)
    whole = [int(x) for x in q]
    sums = (sum(int(a) * b for a, b in zip(v, whole)) for v in vectors)
    return np.array([min(max(s, -(2**63)), 2**63 - 1) for s in sums], np.int64)


class Index:
    """The impact-ordered index of one block of vectors."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        self.ids, self.vectors = ids, vectors
        self.power = power_over(vectors)
        n, dims = vectors.shape
        values = (vectors / self.power).T
        self.step = max(float(values.max() - values.min()) / LEVELS, 2.0**-1000)
        order = np.argsort(values, axis=1, kind="stable")
        level = np.floor(np.take_along_axis(values, order, 1) / self.step)
        new = np.ones((dims, n), bool)
        new[:, 1:] = level[:, 1:] != level[:, :-1]
        self.rows, self.start = order.ravel(), np.flatnonzero(new.ravel())
        self.length = np.diff(np.r_[self.start, n * dims])
        self.dim, self.low = self.start // n, level.ravel()[self.start] * self.step

    def possible(self, q_id: int, q: np.ndarray, k: int, least: float) -> np.ndarray:
        """Rows that may be among the k best of the block and score least or more."""
        others = self.ids != q_id
        n, dims = self.vectors.shape
        power = power_over(q)
        own = (q / power)[self.dim]
        a, b = own * self.low, own * (self.low + self.step)
        floor = np.full(dims, np.inf)
        np.minimum.at(floor, self.dim, np.minimum(a, b))
        gain = np.maximum(a, b) - floor[self.dim]  # by how much a segment's vectors may exceed the least impact of its dimension
        width = float(np.abs(q / power).sum()) * self.step
        slack = 1e-9 * (width + float(np.abs(floor).sum()) + float(gain.sum() / max(1, len(gain))) * dims) + 1e-290
        bound = least / power / self.power - slack if np.isfinite(least) else -np.inf
        limit = 2.0**63 / power / self.power  # scores beyond are equal
        order = np.argsort(-gain, kind="stable")
        ends = np.cumsum(self.length[order])
        cuts = np.unique(np.searchsorted(ends, np.linspace(0, n * dims, PARTS + 1)[1:]).clip(max=len(order) - 1) + 1)
        score, seen, first = np.full(n, floor.sum()), np.zeros(n), 0
        for last in cuts.tolist():
            part = order[first:last]
            length = self.length[part]
            at = np.repeat(self.start[part] - np.r_[0, np.cumsum(length)[:-1]], length) + np.arange(int(length.sum()))
            rows = self.rows[at]
            score += np.bincount(rows, np.repeat(gain[part], length), n)
            seen += np.bincount(rows, minlength=n)
            first, following = last, float(gain[order[last]]) if last < len(order) else 0.0
            lower = score[others] - width - slack
            kth = min(max(bound, np.partition(lower, -k)[-k] if len(lower) >= k else -np.inf), limit - slack)
            upper = np.maximum(score + (dims - seen) * following, -limit) + slack
            members = np.flatnonzero(others & (upper >= kth))
            if len(members) <= max(8 * k, n // 64):  # the rest are proven out
                break
        return members

    def search(self, q_id: int, q: np.ndarray, k: int, found: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, exact scores) of the k best of found and this block, ties to smaller ids."""
        ids, scores = found
        members = self.possible(q_id, q, k, float(scores[-1]) if len(scores) == k else -np.inf)
        ids, scores = np.r_[ids, self.ids[members]], np.r_[scores, exact(self.vectors[members], q)]
        best = np.lexsort((ids, ~scores))[:k]  # ~x falls as x rises, without overflow
        return ids[best], scores[best]


def _search(held, k: int):
    out = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q_ids, queries = held.value
        none = np.empty(0, np.int64)
        found = [(none, none)] * len(q_ids)

        def use(block: list[tuple[np.ndarray, np.ndarray]]) -> None:
            width = max(queries.shape[1], *(v.shape[1] for _, v in block))
            index = Index(np.concatenate([i for i, _ in block]), np.concatenate([widened(v, width) for _, v in block]))
            for n, (i, q) in enumerate(zip(q_ids.tolist(), widened(queries, width))):
                found[n] = index.search(i, q, k, found[n])

        block, size = [], 0
        for batch in batches:
            if batch.num_rows:
                block.append((batch.column("vec_id").to_numpy(), quantised(batch.column("v"))))
                size += block[-1][1].size
            if size >= BLOCK_VALUES:
                use(block)
                block, size = [], 0
        if block:
            use(block)
        for n in range(0, len(found), 10_000):
            some = found[n : n + 10_000]
            if any(len(i) for i, _ in some):
                cols = [np.repeat(q_ids[n : n + 10_000], [len(i) for i, _ in some]), np.concatenate([i for i, _ in some]), np.concatenate([s for _, s in some])]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], schema=out)

    return run


def search(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best rows of vectors(vec_id, embedding) for each of queries(vec_id, embedding)."""
    spark, schema = vectors.sparkSession, "query_id long, vec_id long, score long"
    v = _ready(vectors)
    q = materialize(_ready(queries).groupBy("vec_id").agg(F.min("v").alias("v")))
    shape = q.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("dims")).first()
    passes = shape["n"] * max(1, shape["dims"] or 0) // QUERY_VALUES + 1
    found = None
    for i in range(passes):
        t = q.where(F.pmod(F.xxhash64("vec_id"), F.lit(passes)) == i).toArrow().combine_chunks()  # some QUERY_VALUES values
        if not t.num_rows:
            continue
        lists = t.column("v").chunk(0) if t.column("v").num_chunks else t.column("v").combine_chunks()
        held = spark.sparkContext.broadcast((t.column("vec_id").to_numpy(), quantised(lists)))
        part = v.mapInArrow(_search(held, k), schema)
        if passes > 1:
            part = materialize(part)
            held.unpersist()
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = spark.createDataFrame([], schema)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
