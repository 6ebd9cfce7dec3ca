"""Hard negatives for contrastive training, found by branch and bound in ball trees.

For each anchor the positives are the best rows of its label by inner product, and for each positive the negatives are the
best rows of other labels whose score lies between two shares of the positive's.

Vectors stay where they are read. A task indexes them a bounded block at a time: one ball tree for each label, whose nodes
hold a center, a radius and their rows. A ball bounds the inner products of all its rows with a query on both sides:
center · query - radius * |query| and center · query + radius * |query|. The queries come to the tasks in broadcasts of bounded size,
each of which takes a pass, and descend a tree together: a node is entered by those queries alone for which it may still matter, that
is, whose upper bound is not strictly beneath their current k-th score and whose bounds do not both lie outside the window of scores
that they look for. The queries of a search differ in their window: an anchor has one for each different score of a
positive. Tasks send the k best rows that they have for each window; the k best of these are the result.

Scores are integers: components are floor(SCALE * x), and doubles hold the products exactly while no sum can pass 2 ** 53; beyond
that whole numbers are used, limited to 64 bits. Bounds are widened by more than their rounding errors.

Defined results: rows with a null id or label, a null vector, or null or non-finite components take no part; components
beyond 1e300 count as 1e300; shorter vectors count as ended by zeros; rows with the anchor's vec_id are its own and no
candidates; of repeated anchor ids the smallest label and vector counts; repeated candidates appear each; equal scores
go to the smaller vec_id, and equal rows in any order; a negative score of a positive leaves no window, so it has no
negatives; empty tables give no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import only, written

SCALE, MOST = 256.0, 1e300
#: The k best rows that are an anchor's positives, and a positive's negatives; percents of the positive's score between which negatives lie.
POSITIVES, NEGATIVES, LEAST, GREATEST = 5, 3, 50, 95
#: Rows of a leaf, values of a block and of a broadcast of queries, and queries that descend together.
LEAF, BLOCK_VALUES, QUERY_VALUES, TOGETHER = 64, 1_280_000, 4_000_000, 2048
#: Rows that are scored at once: a leaf has more than LEAF of them where these are equal.
SCORED = 1024
LOW, HIGH = -(2**63), 2**63 - 1


def _usable(v: Column) -> Column:
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))
    return v.isNotNull() & F.forall(v, finite)


def _ready(df: DataFrame) -> DataFrame:
    """(vec_id, label, v) of the rows that take part; v holds integers as doubles."""
    rows = only(df, "vec_id", "label", "embedding").where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & _usable(F.col("embedding")))
    times = lambda x: F.least(F.greatest(x.cast("double"), F.lit(-MOST)), F.lit(MOST)) * SCALE
    floor = lambda x: F.when(F.abs(times(x)) < 2.0**53, F.floor(times(x)).cast("double")).otherwise(times(x))  # noqa: E731  greater doubles are whole, and floor() gives a long
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.transform("embedding", floor).alias("v"))


def matrix(lists: pa.ListArray, width: int = 0) -> np.ndarray:
    """A row for each vector, ended by zeros."""
    lengths = np.diff(lists.offsets.to_numpy())
    out = np.zeros((len(lengths), max(1, width, int(lengths.max(initial=0)))))
    out[np.arange(out.shape[1]) < lengths[:, None]] = lists.flatten().to_numpy()
    return out


def widened(a: np.ndarray, width: int) -> np.ndarray:
    return a if a.shape[1] >= width else np.pad(a, ((0, 0), (0, width - a.shape[1])))


def exact(vectors: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """The integer inner products (query, vector), limited to 64 bits."""
    if np.abs(vectors).max(initial=0.0) * np.abs(queries).max(initial=0.0) * queries.shape[1] < 2.0**53:
        return (queries @ vectors.T).astype(np.int64)
    v, q = ([[int(x) for x in row] for row in a] for a in (vectors, queries))
    return np.array([[min(max(sum(a * b for a, b in zip(x, y)), LOW), HIGH) for x in v] for y in q], np.int64).reshape(len(q), len(v))


class BallTree:
    """A tree of balls over vectors: inner nodes have two halves, split at the median of the dimension of widest spread."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, rows: np.ndarray | None = None) -> None:
        rows = np.arange(len(ids)) if rows is None else rows
        own = vectors[rows]
        middle, half = own.min(0), own.max(0)
        middle, half = middle / 2 + half / 2, half / 2 - middle / 2  # of the box of its rows
        self.center = own.mean(0) if np.abs(own).max(initial=0.0) < 1e150 else middle
        power = max(1.0, float(np.abs(own - self.center).max()))
        self.radius = power * float(np.sqrt((((own - self.center) / power) ** 2).sum(1)).max()) * (1 + 1e-9)
        self.halves: tuple[BallTree, ...] = ()
        if len(rows) > LEAF and half.max() > 0:
            order = rows[np.argsort(own[:, int(np.argmax(half))], kind="stable")]
            self.halves = tuple(BallTree(ids, vectors, part) for part in np.array_split(order, 2))
        else:
            self.ids, self.vectors = ids[rows], own


class Search:
    """The k best rows, of scores from low to high and of the query's label (same) or of others, of each of many queries; blocks of vectors come one after another."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, queries: np.ndarray, low: np.ndarray, high: np.ndarray, k: int, same: bool) -> None:
        self.ids, self.labels, self.queries, self.low, self.high, self.k, self.same = ids, labels, queries, low, high, k, same
        power = np.maximum(1.0, np.abs(queries).max(1, initial=0.0))
        self.norm = power * np.sqrt(((queries / power[:, None]) ** 2).sum(1)) * (1 + 1e-9)
        self.size = np.abs(queries).max(1, initial=0.0)
        #: Best first, as many as are filled.
        self.scores = np.full((len(ids), k), LOW, np.int64)
        self.rows = np.zeros((len(ids), k), np.int64)
        self.filled = np.zeros(len(ids), np.int64)
        self.entered = 0

    def block(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray) -> None:
        width = max(vectors.shape[1], self.queries.shape[1])
        vectors, self.queries = widened(vectors, width), widened(self.queries, width)
        for label in np.unique(labels).tolist():
            own = labels == label
            tree = BallTree(ids[own], vectors[own])
            queries = np.flatnonzero((self.labels == label) if self.same else (self.labels != label))
            for i in range(0, len(queries), TOGETHER):
                self.descend(tree, queries[i : i + TOGETHER])

    def bounds(self, node: BallTree, active: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The least and greatest score that a row of node can have with each query, or less and more."""
        with np.errstate(over="ignore", invalid="ignore"):
            center = self.queries[active] @ node.center
            reach = self.norm[active] * node.radius
            slack = 1 + 1e-9 * (self.size[active] * (np.abs(node.center).sum() + node.radius) + reach)
            lower, upper = center - reach - slack, center + reach + slack
        return np.where(np.isnan(lower), -np.inf, lower), np.where(np.isnan(upper), np.inf, upper)

    def matters(self, lower: np.ndarray, upper: np.ndarray, active: np.ndarray) -> np.ndarray:
        """Whether a node of these bounds may change the queries' results. Limits are widened as doubles hold them to 53 bits."""
        wide = lambda x: np.abs(x.astype(np.float64)) * 2.0**-50
        inside = (upper >= self.low[active] - wide(self.low[active])) & (lower <= self.high[active] + wide(self.high[active]))
        inside |= (upper >= HIGH) & (self.high[active] == HIGH) | (lower <= LOW) & (self.low[active] == LOW)  # scores beyond are limited
        kth = self.scores[active, -1]
        beaten = (self.filled[active] == self.k) & (np.minimum(upper, float(HIGH)) < kth - wide(kth))
        return inside & ~beaten

    def descend(self, root: BallTree, active: np.ndarray) -> None:
        waiting = [(root, active, *self.bounds(root, active))]
        while waiting:
            node, active, lower, upper = waiting.pop()
            active = active[self.matters(lower, upper, active)]  # as the k-th scores are by now
            if not len(active):
                continue
            self.entered += len(active)
            if node.halves:
                both = [(h, active, *self.bounds(h, active)) for h in node.halves]
                waiting += sorted(both, key=lambda x: float(x[3].mean()))  # the more promising half first
            else:
                for i in range(0, len(node.ids), SCORED):
                    self.take(active, node.ids[i : i + SCORED], exact(node.vectors[i : i + SCORED], self.queries[active]))

    def take(self, active: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        good = (scores >= self.low[active, None]) & (scores <= self.high[active, None]) & (ids != self.ids[active, None])
        some = np.flatnonzero(good.any(1))
        if not len(some):
            return
        active, good, scores = active[some], good[some], scores[some]
        held = np.arange(self.k) < self.filled[active, None]
        there = np.concatenate([held, good], 1)
        all_scores = np.concatenate([self.scores[active], scores], 1)
        all_rows = np.concatenate([self.rows[active], np.broadcast_to(ids, scores.shape)], 1)
        order = np.lexsort((all_rows, ~all_scores, ~there))[:, : self.k]  # ~x falls as x rises, without overflow
        self.scores[active], self.rows[active] = np.take_along_axis(all_scores, order, 1), np.take_along_axis(all_rows, order, 1)
        self.filled[active] = np.minimum(self.k, there.sum(1))


def _searched(held, k: int, same: bool):
    """(query, vec_id, score): for each query of held the k best rows that the task reads."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, *queries = held.value
        search = Search(*queries, k, same)
        block, size = [], 0

        def use() -> None:
            width = max(v.shape[1] for *_, v in block)
            search.block(*(np.concatenate([b[i] for b in block]) for i in range(2)), np.concatenate([widened(b[2], width) for b in block]))
            block.clear()

        for batch in batches:
            if batch.num_rows:
                block.append((batch.column("vec_id").to_numpy(), batch.column("label").to_numpy(), matrix(batch.column("v"))))
                size += block[-1][2].size
            if size >= BLOCK_VALUES:
                use()
                size = 0
        if block:
            use()
        for first in range(0, len(numbers), 10_000):
            filled = search.filled[first : first + 10_000]
            there = np.arange(k) < filled[:, None]
            if there.any():
                cols = [np.repeat(numbers[first : first + 10_000], filled), search.rows[first : first + 10_000][there], search.scores[first : first + 10_000][there]]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["query", "vec_id", "score"])

    return run


def nearest(vectors: DataFrame, queries: DataFrame, k: int, same: bool) -> DataFrame:
    """(query, rank, vec_id, score), written: the k best rows of vectors(vec_id, label, v), of the same label or of others, for each of queries(query, vec_id, label, low, high, v)."""
    spark, schema = vectors.sparkSession, "query long, vec_id long, score long"
    shape = queries.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("dims")).first()
    passes = shape["n"] * max(1, shape["dims"] or 0) // QUERY_VALUES + 1
    found = spark.createDataFrame([], schema)
    for i in range(passes):
        t = queries.where(F.pmod(F.xxhash64("query"), F.lit(passes)) == i).toArrow().combine_chunks()  # some QUERY_VALUES values
        if not t.num_rows:
            continue
        column = lambda name: t.column(name).combine_chunks()
        numbers, ids, labels, low, high = (column(c).to_numpy(zero_copy_only=False) for c in ("query", "vec_id", "label", "low", "high"))
        held = spark.sparkContext.broadcast((numbers, ids, labels, matrix(column("v")), low, high))
        part = vectors.mapInArrow(_searched(held, k, same), schema)
        if passes > 1:
            part = written(part)
            held.unpersist()
        found = found.unionByName(part)
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id"))
    return written(found.withColumn("rank", rank).where(F.col("rank") <= k).select("query", "rank", "vec_id", "score"))


def mine(vectors: DataFrame, anchors: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES, least: int = LEAST, greatest: int = GREATEST) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of vectors and anchors(vec_id, label, embedding).

    rank counts the negatives of an anchor and positive from 1; least * positive_score <= 100 * negative_score <= greatest * positive_score.
    """
    v = _ready(vectors)
    own = written(_ready(anchors).groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("of")).select("vec_id", "of.label", "of.v"))
    asked = own.select(F.col("vec_id").alias("query"), "vec_id", "label", F.lit(LOW).alias("low"), F.lit(HIGH).alias("high"), "v")
    best = nearest(v, asked, positives, True).select(F.col("query").alias("anchor_id"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"), F.col("rank").alias("nth"))
    score = F.col("positive_score").cast("decimal(38,0)")
    low, high = F.ceil(score * least / 100), F.floor(score * greatest / 100)
    # Positives of one score have the same negatives.
    wanted = best.where("positive_score >= 0").groupBy("anchor_id", "positive_score").agg(F.min("nth").alias("nth")).select(F.col("anchor_id").alias("vec_id"), "nth", low.cast("long").alias("low"), high.cast("long").alias("high"), "positive_score")
    windows = written(wanted.join(own, "vec_id").withColumn("query", F.monotonically_increasing_id()))
    found = nearest(v, windows.select("query", "vec_id", "label", "low", "high", "v"), negatives, False)
    named = found.select("query", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    pairs = named.join(windows.select("query", F.col("vec_id").alias("anchor_id"), "positive_score"), "query").join(best, ["anchor_id", "positive_score"])
    return pairs.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
