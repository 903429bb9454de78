"""Nearest vectors by inner product: a vantage-point tree per shard.

Inner products are no metric, so a shard's vectors get one more component, ``sqrt(M^2 - |x|^2)``
with M the shard's longest norm; then ``|q - x|^2 = |q|^2 + M^2 - 2 q.x`` and the nearest point
has the largest product. Each inner node of a tree has a vantage point and, for both halves of
its points, the range of their distances to it. By the triangle inequality a half can hold no
point nearer than ``bound = max(d - high, low - d)``; it is left out when ``factor * bound``
exceeds the query's distance to its k-th best point so far. Factor 1 leaves out only what cannot
count and is an exact search; a larger one leaves out more, for speed.

Rows are dealt to shards of bounded size by their place in the table, so no value is hot; equal
vectors of a shard are one point with a list of ids. The index is a table with a row per shard.
Queries, any number of rows, are sent to each shard and streamed past its tree in batches: a task
holds one tree and one batch. The k best of each shard meet in a top-k per query. Products are
added component by component in double precision; matrix products only rule out what is
clearly worse.

Defined results: a vector that is null, empty, zero or has a null or non-finite component takes no
part. A candidate with the query's own id is the query's own row. Null ids come last among equal
products and are no queries; ids are integers below 2**63 - 1. Rows that repeat are candidates and
queries each. With fewer than k candidates all are returned. Vectors of different widths are an
error. Other columns are not read. No rows give an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from caselens.scratch import write_and_reread

K, FACTOR = 20, 1.0
SHARD_ROWS, LEAST_SHARDS = 65_536, 16
LEAF = 256
NO_ID = np.iinfo(np.int64).max
SLACK = 1e-9  # of the longest possible product, for rounding in matrix products and bounds
INDEX = "shard int, points binary, starts binary, ids binary, nodes binary, ranges binary"
FOUND = "q bigint, query_id bigint, vec_id bigint, score double"


def usable(vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """(row, id, v) of the vectors that take part, stored; ``row`` tells rows apart."""
    rows = vectors.select(F.col(id_column).cast("bigint").alias("id"), F.col(vector_column).cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: F.coalesce((x > float("-inf")) & (x < float("inf")), F.lit(False)))
    kept = rows.where(F.col("v").isNotNull() & finite & F.exists("v", lambda x: x != 0))
    return write_and_reread(kept.withColumn("row", F.monotonically_increasing_id()), "vectors")


class Tree:
    """Points in the order of the leaves; nodes (vantage point or -1, first child or begin, second
    child or end); ranges of distances to the vantage point in the first and second half."""

    def __init__(self, points, starts, ids, nodes, ranges):
        self.points, self.starts, self.ids, self.nodes, self.ranges = points, starts, ids, nodes, ranges
        self.longest = float((points * points).sum(1).max())  # M^2
        own = np.unique(ids[ids != NO_ID], return_counts=True)[1]
        self.most_repeats = int(own.max(initial=0))  # rows of one id

    @classmethod
    def of(cls, vectors: np.ndarray, ids: np.ndarray, leaf: int = LEAF) -> Tree:
        points, which = np.unique(vectors, axis=0, return_inverse=True)
        norms = (points * points).sum(1)
        lifted = np.hstack([points, np.sqrt(np.maximum(norms.max() - norms, 0))[:, None]])
        order = np.arange(len(points))
        nodes, ranges = [], []

        def grow(begin: int, end: int) -> int:
            place = len(nodes)
            nodes.append((-1, begin, end))
            ranges.append((0.0, 0.0, 0.0, 0.0))
            if end - begin > leaf:
                own = lifted[order[begin:end]]
                vantage = int(((own - own.mean(0)) ** 2).sum(1).argmax())
                distance = np.sqrt(((own - own[vantage]) ** 2).sum(1))
                half = (end - begin) // 2
                by = np.argpartition(distance, half)
                vantage = int(order[begin + vantage])
                order[begin:end] = order[begin:end][by]
                near, far = distance[by[:half]], distance[by[half:]]
                ranges[place] = (near.min(), near.max(), far.min(), far.max())
                nodes[place] = (vantage, grow(begin, begin + half), grow(begin + half, end))
            return place

        grow(0, len(points))
        nodes = np.array(nodes, np.int64)
        rank = np.empty(len(points), np.int64)
        rank[order] = np.arange(len(points))
        inner = nodes[:, 0] >= 0
        nodes[inner, 0] = rank[nodes[inner, 0]]
        place = rank[which.ravel()]
        by = np.lexsort((ids, place))
        starts = np.searchsorted(place[by], np.arange(len(points) + 1))
        return cls(points[order], starts, ids[by], nodes, np.array(ranges))

    def row(self) -> list[bytes]:
        arrays = (self.points, self.starts, self.ids, self.nodes, self.ranges)
        return [np.ascontiguousarray(a, kind).tobytes() for a, kind in zip(arrays, ("f8", "i8", "i8", "i8", "f8"))]

    @classmethod
    def of_row(cls, points: bytes, starts: bytes, ids: bytes, nodes: bytes, ranges: bytes) -> Tree:
        starts = np.frombuffer(starts, "i8")
        points = np.frombuffer(points, "f8").reshape(len(starts) - 1, -1)
        nodes = np.frombuffer(nodes, "i8").reshape(-1, 3)
        return cls(points, starts, np.frombuffer(ids, "i8"), nodes, np.frombuffer(ranges, "f8").reshape(-1, 4))

    def search(self, queries: np.ndarray, own_ids: np.ndarray, k: int, factor: float = 1.0) -> Best:
        if queries.shape[1] != self.points.shape[1]:
            raise ValueError(f"vectors of {queries.shape[1]} and {self.points.shape[1]} components")
        best = Best(self, queries, own_ids, k, factor)
        everyone = np.arange(len(queries))
        best.descend(0, everyone)
        best.visit(0, everyone)
        return best


class Best:
    """The k best points of each query so far, best first."""

    def __init__(self, tree: Tree, queries: np.ndarray, own_ids: np.ndarray, k: int, factor: float):
        self.tree, self.queries, self.own_ids, self.k, self.factor = tree, queries, own_ids, k, factor
        self.norms = (queries * queries).sum(1)
        self.slack = SLACK * np.sqrt(self.norms * tree.longest)
        self.scores = np.full((len(queries), k), -np.inf)
        self.ids = np.full((len(queries), k), NO_ID)
        self.home = np.full(len(queries), -1)  # the leaf a query would be stored in
        self.compared = 0  # pairs of query and point

    def reach(self, act: np.ndarray) -> np.ndarray:
        worst = self.scores[act, -1] - self.slack[act]
        return np.sqrt(np.maximum(self.norms[act] + self.tree.longest - 2 * worst, 0)) * (1 + SLACK)

    def bounds(self, node: int, act: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least distances of points in the first and in the second half."""
        squared = self.norms[act] + self.tree.longest - 2 * (self.queries[act] @ self.tree.points[self.tree.nodes[node, 0]])
        distance = np.sqrt(np.maximum(squared, 0))
        low1, high1, low2, high2 = self.tree.ranges[node]
        # the error of a distance is largest where it is small: the root of the error of its square
        error = np.sqrt(2 * self.slack[act]) + SLACK * distance
        return np.maximum(distance - high1, low1 - distance) - error, np.maximum(distance - high2, low2 - distance) - error

    def descend(self, node: int, act: np.ndarray) -> None:
        """Compare each query with the leaf on its own side of all vantage points, for a first
        distance to its k-th best point."""
        vantage, first, second = self.tree.nodes[node]
        if vantage < 0:
            self.home[act] = node
            self.scan(first, second, act)
        elif len(act):
            bound1, bound2 = self.bounds(node, act)
            self.descend(first, act[bound1 <= bound2])
            self.descend(second, act[bound1 > bound2])

    def visit(self, node: int, act: np.ndarray) -> None:
        """Compare with all leaves that cannot be left out, apart from the query's own one."""
        vantage, first, second = self.tree.nodes[node]
        if vantage < 0:
            self.scan(first, second, act[self.home[act] != node])
        elif len(act):
            for child, bound in zip((first, second), self.bounds(node, act)):
                self.visit(child, act[self.factor * bound <= self.reach(act)])

    def scan(self, begin: int, end: int, act: np.ndarray) -> None:
        if not len(act):
            return
        points, width = self.tree.points[begin:end], self.queries.shape[1]
        self.compared += len(act) * len(points)
        rough = self.queries[act] @ points.T
        q, p = np.nonzero(rough >= (self.scores[act, -1] - self.slack[act])[:, None])
        if not len(q):
            return
        q = act[q]
        exact = np.zeros(len(q))
        for j in range(width):  # one order of addition wherever a pair is met
            exact += self.queries[q, j] * points[p, j]
        # of equal vectors the k smallest ids are enough, beside the query's own
        at = self.tree.starts[begin + p]
        n = np.minimum(self.tree.starts[begin + p + 1] - at, self.k + self.tree.most_repeats)
        pair = np.repeat(np.arange(len(q)), n)
        ids = self.tree.ids[np.repeat(at, n) + np.arange(len(pair)) - np.repeat(np.cumsum(n) - n, n)]
        q, exact = q[pair], exact[pair]
        other = ids != self.own_ids[q]
        self.merge(q[other], exact[other], ids[other])

    def merge(self, q: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        touched = np.unique(q)
        q = np.concatenate([np.repeat(touched, self.k), q])
        scores = np.concatenate([self.scores[touched].ravel(), scores])
        ids = np.concatenate([self.ids[touched].ravel(), ids])
        by = np.lexsort((ids, -scores, q))
        q, scores, ids = q[by], scores[by], ids[by]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        kept = place < self.k
        self.scores[q[kept], place[kept]] = scores[kept]
        self.ids[q[kept], place[kept]] = ids[kept]


def _columns(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    """Row numbers, ids (NO_ID for null) and vectors of a batch of usable rows."""
    vectors = batch.column(batch.schema.get_field_index("v"))
    sizes = np.diff(vectors.offsets.to_numpy())
    if len(np.unique(sizes)) > 1:
        raise ValueError(f"vectors of {np.unique(sizes).tolist()} components in one table")
    row, id_ = (batch.column(batch.schema.get_field_index(c)).fill_null(NO_ID).to_numpy() for c in ("row", "id"))
    return row, id_, vectors.flatten().to_numpy().reshape(len(sizes), -1)


def _runs(shards: np.ndarray) -> Iterator[tuple[int, int]]:
    cuts = [0, *(np.flatnonzero(np.diff(shards)) + 1).tolist(), len(shards)]
    return ((a, b) for a, b in zip(cuts, cuts[1:]) if b > a)


def _plant(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per shard from rows that come shard by shard."""

    def planted(shard: int, parts: list[tuple]) -> pa.RecordBatch:
        if len({v.shape[1] for _, v in parts}) > 1:
            raise ValueError("vectors of different widths in one table")
        tree = Tree.of(np.concatenate([v for _, v in parts]), np.concatenate([i for i, _ in parts]))
        columns = [pa.array([shard], pa.int32()), *[pa.array([b], pa.binary()) for b in tree.row()]]
        return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in INDEX.split(", ")])

    current, parts = None, []
    for batch in batches:
        shards = batch.column(batch.schema.get_field_index("shard")).to_numpy()
        for begin, end in _runs(shards):
            if shards[begin] != current and parts:
                yield planted(current, parts)
                parts = []
            current = int(shards[begin])
            _, ids, vectors = _columns(batch.slice(begin, end - begin))
            parts.append((ids, vectors))
    if parts:
        yield planted(current, parts)


def build_index(rows: DataFrame, shard_rows: int = SHARD_ROWS, least_shards: int = LEAST_SHARDS) -> DataFrame:
    """A stored table with the tree of each shard, from :func:`usable` rows; all are in it."""
    shards = max(least_shards, -(-rows.count() // shard_rows))
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("row"), F.lit(shards)).cast("int"))
    dealt = dealt.repartition(shards, "shard").sortWithinPartitions("shard")
    return write_and_reread(dealt.mapInArrow(_plant, INDEX), "vector-index")


def _look_up(k: int, factor: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, tree = None, None
        for batch in batches:
            shards = batch.column(batch.schema.get_field_index("shard")).to_numpy()
            is_query = batch.column(batch.schema.get_field_index("is_query")).to_numpy(zero_copy_only=False)
            for begin, end in _runs(shards * 2 + is_query):
                part = batch.slice(begin, end - begin)
                if not is_query[begin]:
                    names = [c.split()[0] for c in INDEX.split(", ")][1:]
                    tree = Tree.of_row(*[part.column(part.schema.get_field_index(c))[0].as_py() for c in names])
                    current = shards[begin]
                    continue
                if shards[begin] != current:
                    continue  # a shard without rows has no tree
                row, ids, vectors = _columns(part)
                best = tree.search(vectors, ids, k, factor)
                q, place = np.nonzero(best.scores > -np.inf)
                found = best.ids[q, place]
                columns = [pa.array(row[q]), pa.array(ids[q]), pa.array(found, mask=found == NO_ID), pa.array(best.scores[q, place])]
                yield pa.RecordBatch.from_arrays(columns, ["q", "query_id", "vec_id", "score"])

    return run


def search(index: DataFrame, queries: DataFrame, k: int = K, factor: float = FACTOR) -> DataFrame:
    """(query_id, rank, vec_id, score): of each of the :func:`usable` rows ``queries`` its k best
    points found, best first, equal ones by id."""
    if factor < 1:
        raise ValueError("a factor below 1 looks at more than an exact search has to")
    shards = index.select(F.max("shard")).first()[0]
    trees = index.select("*", F.lit(False).alias("is_query"))
    asked = queries.select(
        F.explode(F.sequence(F.lit(0), F.lit(shards or 0))).alias("shard"), "row", "id", "v", F.lit(True).alias("is_query")
    )
    cells = trees.unionByName(asked, allowMissingColumns=True)
    cells = cells.repartition((shards or 0) + 1, "shard").sortWithinPartitions("shard", "is_query")
    found = cells.mapInArrow(_look_up(k, factor), FOUND)
    order = Window.partitionBy("q").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last())
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
