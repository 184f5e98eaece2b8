"""Exact top-k search by inner product: a ball tree for each shard, branch and bound over shards and nodes."""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import broadcast_if_small, materialize

#: Vectors of a shard and queries of a block, which bound the memory of a task.
SHARD_ROWS, BLOCK_ROWS = 8192, 1024
LEAF = 64
#: Vectors that the regions of space are fitted on, at most, and regions, at most. Every vector is indexed.
SAMPLE_ROWS, REGIONS = 8192, 4096
#: Summaries of shards that a task compares with queries at a time.
SUMMARIES = 4096
#: Each wave of shards is so many times the one before.
WAVE = 4

_LEAST = -(2**63 - 1)


class BallTree:
    """Nodes over rows of one shard, split at the median of the coordinate with the largest spread."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        self.order = np.arange(len(points))
        self.points = points
        self.shape = points.astype(np.float64)
        self.nodes: list[tuple[np.ndarray, float, int, int, int, int]] = []  # centre, radius, from, to, children
        self._grow(0, len(points), leaf)

    def _grow(self, a: int, b: int, leaf: int) -> int:
        own = self.shape[self.order[a:b]]
        centre, radius = ball(own)
        at = len(self.nodes)
        self.nodes.append((centre, radius, a, b, -1, -1))
        spread = own.max(axis=0) - own.min(axis=0)
        if b - a > leaf and spread.max() > 0:
            half = (b - a) // 2
            self.order[a:b] = self.order[a:b][np.argpartition(own[:, spread.argmax()], half)]
            left = self._grow(a, a + half, leaf)
            right = self._grow(a + half, b, leaf)
            self.nodes[at] = (centre, radius, a, b, left, right)
        return at


def ball(points: np.ndarray) -> tuple[np.ndarray, float]:
    centre = points.mean(axis=0)
    return centre, float(np.sqrt(((points - centre) ** 2).sum(axis=1).max()))


def upper_bounds(queries: np.ndarray, norms: np.ndarray, centres: np.ndarray, radii: np.ndarray) -> np.ndarray:
    """[queries, balls]: no inner product within the ball is larger; a little is added for rounding."""
    reach = np.abs(centres).sum(axis=1) + radii
    return queries @ centres.T + np.outer(norms, radii) + 1e-6 * (1 + np.outer(norms, reach))


def products(queries: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Exact inner products of int64 rows; those beyond the range of a long are cut to it."""
    most = float(np.abs(queries.astype(np.float64)).max(initial=0)) * float(np.abs(points.astype(np.float64)).max(initial=0)) * queries.shape[1]
    if most < 2**53:
        return np.rint(queries.astype(np.float64) @ points.T.astype(np.float64)).astype(np.int64)
    if most < 2**62:
        return queries @ points.T
    return np.clip(queries.astype(object) @ points.T.astype(object), _LEAST, 2**63 - 1).astype(np.int64)


def search(tree: BallTree, own: np.ndarray, queries: np.ndarray, asked: np.ndarray, floor: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(scores, rows) [queries, k], -1 where there is none: for each query the k best rows of the shard that score at least floor.

    A smaller row wins a tie; the row whose own number is the query's (asked) is left out. Best-first: the node with the
    highest upper bound of any of its live queries comes next; a query leaves a node if that bound is below its kth score so
    far (ties stay, as a smaller row may win).
    """
    n = len(queries)
    best, rows = np.full((n, k), _LEAST, np.int64), np.full((n, k), -1, np.int64)
    kth = floor.copy()
    shape = queries.astype(np.float64)
    norms = np.sqrt((shape**2).sum(axis=1))

    def bound(node: int, live: np.ndarray) -> np.ndarray:
        centre, radius = tree.nodes[node][:2]
        return upper_bounds(shape[live], norms[live], centre[None], np.array([radius]))[:, 0]

    every = np.arange(n)
    heap = [(0.0, 0, every)] if n and len(own) else []
    while heap:
        _, node, live = heapq.heappop(heap)
        live = live[bound(node, live) >= kth[live]]
        if not len(live):
            continue
        _, _, a, b, left, right = tree.nodes[node]
        if left >= 0:
            for child in (left, right):
                ub = bound(child, live)
                stay = live[ub >= kth[live]]
                if len(stay):
                    heapq.heappush(heap, (-float(ub.max()), child, stay))
            continue
        here = np.sort(tree.order[a:b])
        scores = products(queries[live], tree.points[here])
        last, at = best[live, -1:], rows[live, -1:]
        good = (scores >= floor[live][:, None]) & ((scores > last) | (at < 0) | ((scores == last) & (here < at))) & (own[here] != asked[live][:, None])
        some = good.any(axis=1)
        live, scores, good = live[some], scores[some], good[some]
        if len(live):
            all_scores = np.concatenate([best[live], np.where(good, scores, _LEAST)], axis=1)
            all_rows = np.concatenate([rows[live], np.where(good, here, -1)], axis=1)
            order = np.lexsort((all_rows, -all_scores, all_rows < 0), axis=-1)[:, :k]
            best[live], rows[live] = np.take_along_axis(all_scores, order, 1), np.take_along_axis(all_rows, order, 1)
            full = rows[live, -1] >= 0
            kth[live[full]] = np.maximum(kth[live[full]], best[live[full], -1].astype(np.float64))
    return best, rows


class Regions:
    """Regions of space, for each length of vectors: split at the median of the coordinate with the largest spread."""

    def __init__(self):
        self.trees: dict[int, tuple[np.ndarray, ...]] = {}

    def fit(self, points: np.ndarray, regions: int) -> None:
        coordinate, cut, children, name = [], [], [], []
        leaves = iter(range(1 << 31))

        def grow(own: np.ndarray, n: int) -> int:
            at = len(cut)
            for x, y in ((coordinate, 0), (cut, 0.0), (children, (at, at)), (name, -1)):
                x.append(y)
            spread = own.max(axis=0) - own.min(axis=0)
            if n > 1 and len(own) > 1 and spread.max() > 0:
                c = int(spread.argmax())
                half = float(np.median(own[:, c]))
                right = own[:, c] > half
                if right.any():
                    coordinate[at], cut[at] = c, half
                    children[at] = (grow(own[~right], n - n // 2), grow(own[right], n // 2))
                    return at
            name[at] = next(leaves)
            return at

        grow(points, regions)
        self.trees[points.shape[1]] = tuple(map(np.array, (coordinate, cut, children, name)))

    def of(self, points: np.ndarray) -> np.ndarray:
        node = np.zeros(len(points), np.int64)
        if points.shape[1] in self.trees:
            coordinate, cut, children, name = self.trees[points.shape[1]]
            while (name[node] < 0).any():
                right = points[np.arange(len(points)), coordinate[node]] > cut[node]
                node = children[node, right.astype(np.int64)]
            return name[node]
        return node


def _vectors(column: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Rows and vectors by their length."""
    lists, out = column.to_numpy(zero_copy_only=False), {}
    n = np.fromiter(map(len, lists), np.int64, len(lists))
    for dim in np.unique(n).tolist():
        at = np.nonzero(n == dim)[0]
        out[dim] = at, np.stack([np.asarray(lists[i], np.int64) for i in at])
    return out


def _fit(regions: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = [b.column(0) for b in batches if len(b)]
        fitted = Regions()
        if columns:
            rows = pa.chunked_array(columns).combine_chunks()
            for points in (p for _, p in _vectors(rows).values()):
                fitted.fit(points.astype(np.float64), max(1, round(regions * len(points) / len(rows))))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fitted)], pa.binary())], names=["regions"])

    return run


def _route(regions_b):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            region = np.zeros(len(batch), np.int32)
            for at, points in _vectors(batch.column(2)).values():
                region[at] = regions_b.value.of(points.astype(np.float64))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(region)], names=[*batch.schema.names, "region"])

    return run


def _points(frame: pd.DataFrame) -> np.ndarray:
    return np.stack(frame["vector"].to_numpy()).astype(np.int64)


def _summary(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    centre, radius = ball(_points(rows).astype(np.float64))
    return pd.DataFrame({"dim": [key[0]], "region": [key[1]], "sub": [key[2]], "centre": [centre], "radius": [radius]})


def _reachable(key: tuple, balls: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
    """Shards that a query cannot leave out, with their bounds."""
    if not len(balls) or not len(asked):
        return pd.DataFrame({"qid": np.zeros(0, np.int64), "dim": np.zeros(0, np.int32), "region": np.zeros(0, np.int32), "sub": np.zeros(0, np.int32), "bound": np.zeros(0)})
    queries = _points(asked).astype(np.float64)
    bound = upper_bounds(queries, np.sqrt((queries**2).sum(axis=1)), np.stack(balls["centre"].to_numpy()), balls["radius"].to_numpy())
    floor = asked["floor"].fillna(-np.inf).to_numpy(np.float64)
    home = (asked[["region", "sub"]].to_numpy()[:, None] == balls[["region", "sub"]].to_numpy()[None]).all(axis=2)
    q, s = np.nonzero((bound >= floor[:, None]) & ~home)
    return pd.DataFrame({"qid": asked["qid"].to_numpy()[q], **{c: balls[c].to_numpy()[s] for c in ("dim", "region", "sub")}, "bound": bound[q, s]})


def _cells(k: int):
    def run(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({c: np.zeros(0, np.int64) for c in ("qid", "vec_id", "rid", "score")})
        left = left.sort_values(["vec_id", "rid"])
        ids, own = left["vec_id"].to_numpy(np.int64), left["rid"].to_numpy(np.int64)
        asked = right["qid"].to_numpy(np.int64)
        scores, rows = search(BallTree(_points(left)), own, _points(right), asked, right["floor"].fillna(-np.inf).to_numpy(np.float64), k)
        q, c = np.nonzero(rows >= 0)
        at = rows[q, c]
        return pd.DataFrame({"qid": asked[q], "vec_id": ids[at], "rid": own[at], "score": scores[q, c]})

    return run


def top_k(vectors: DataFrame, queries: Column | DataFrame, k: int = 20, id_col: str = "vec_id", vector_col: str = "vector", shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query the k rows of vectors with the highest integer inner product.

    vectors: (id, array<bigint>); queries: rows of vectors for which a condition is true, each of which leaves itself out, or a
    table of its own. Ties go to the smaller id.
    1. Vectors go to regions of space, fitted on at most SAMPLE_ROWS of them; a region beyond shard_rows is dealt over several
    shards by a hash. 2. Each shard has a ball as its summary. A query first searches the shard that it would lie in; its kth
    score there leaves out every shard whose upper bound is below, before any vector is sent. 3. The others
    follow in waves by falling bound, each WAVE times as many as the one before; the kth score over all shards so far
    is the floor of the next wave, and leaves out more shards. 4. Within a shard a ball tree is searched best-first.
    A task holds shard_rows vectors and block_rows queries, whatever the tables' sizes.

    Vectors that are null or empty, hold nulls, or have a null id take no part, nor do they as queries. Only vectors of equal
    length are compared. Rows with the same id are rows of their own, each a candidate and, if asked, a query. Scores are
    exact; those beyond the range of a long are cut to it. Fewer candidates than k give fewer rows; empty tables an empty result.
    """
    def clean(df: DataFrame, asked: Column) -> DataFrame:
        ok = F.col(vector_col).isNotNull() & (F.size(vector_col) > 0) & ~F.exists(vector_col, lambda x: x.isNull()) & F.col(id_col).isNotNull()
        return df.where(ok).select(F.col(id_col).cast("long").alias("vec_id"), F.size(vector_col).alias("dim"), F.col(vector_col).alias("vector"), asked.alias("asked"))

    spark = vectors.sparkSession
    own = isinstance(queries, Column)
    rows = clean(vectors, F.coalesce(queries, F.lit(False)) if own else F.lit(False)).withColumn("rid", F.monotonically_increasing_id())
    if not own:
        rows = rows.unionByName(clean(queries, F.lit(True)).withColumn("rid", -1 - F.monotonically_increasing_id()))
    rows = materialize(rows.select("vec_id", "dim", "vector", "asked", "rid"), "vectors")
    total = rows.where("rid >= 0").count()
    regions = min(REGIONS, -(-total // shard_rows))
    fitted = Regions()
    if regions > 1:
        sample = rows.where("rid >= 0").orderBy(F.xxhash64("vec_id", "vector")).limit(SAMPLE_ROWS).select("vector")  # the limit leaves one partition
        fitted = pickle.loads(sample.mapInArrow(_fit(regions), "regions binary").first()["regions"])
    routed = rows.mapInArrow(_route(spark.sparkContext.broadcast(fitted)), "vec_id long, dim int, vector array<long>, asked boolean, rid long, region int")  # the cuts are REGIONS at most
    routed = materialize(routed, "regions")
    subs = broadcast_if_small(materialize(routed.where("rid >= 0").groupBy("dim", "region").agg(F.ceil(F.count("*") / shard_rows).cast("int").alias("subs")), "subs"), 12)
    shard = ["dim", "region", "sub"]
    placed = materialize(routed.join(subs, ["dim", "region"]).withColumn("sub", F.pmod(F.xxhash64("rid"), F.col("subs")).cast("int")).drop("subs"), "shards")
    base = placed.where("rid >= 0").select(*shard, "vec_id", "rid", "vector")
    asked = placed.where("asked").select(F.col("rid").alias("qid"), F.col("vec_id").alias("query_id"), *[F.col(c).alias(c) for c in (*shard, "vector")])  # columns of its own
    found_schema = "qid long, vec_id long, rid long, score long"

    def visit(pairs: DataFrame) -> DataFrame:
        """pairs: (qid, dim, region, sub, vector, floor), searched in cells of a shard and a block of its queries."""
        blocks = materialize(pairs.groupBy(shard).agg(F.ceil(F.count("*") / block_rows).cast("int").alias("blocks")), "blocks")
        keys = [*shard, "block"]
        left = base.join(blocks, shard).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
        right = pairs.join(blocks, shard).withColumn("block", F.pmod(F.xxhash64("qid", F.lit(1)), F.col("blocks")).cast("int")).drop("blocks")
        return left.groupBy(keys).cogroup(right.groupBy(keys)).applyInPandas(_cells(k), found_schema)

    order = Window.partitionBy("qid").orderBy(F.desc("score"), "vec_id", "rid")

    def best(found: DataFrame) -> DataFrame:
        return materialize(found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k), "best")

    def floors(found: DataFrame) -> DataFrame:
        return found.where(F.col("rank") == k).select("qid", F.col("score").cast("double").alias("floor"))

    so_far = best(visit(asked.drop("query_id").withColumn("floor", F.lit(None).cast("double"))))
    if total > 0:
        balls = materialize(base.groupBy(shard).applyInPandas(_summary, "dim int, region int, sub int, centre array<double>, radius double"), "summaries")
        n = balls.count()
        if n > 1:
            parts, blocks = -(-n // SUMMARIES), max(1, -(-asked.count() // block_rows))
            balls = balls.withColumn("part", F.pmod(F.xxhash64("region", "sub"), F.lit(parts)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
            known = asked.join(floors(so_far), "qid", "left").withColumn("block", F.pmod(F.xxhash64("qid", F.lit(1)), F.lit(blocks)).cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
            keys = ["dim", "part", "block"]
            reach = balls.groupBy(keys).cogroup(known.groupBy(keys)).applyInPandas(_reachable, "qid long, dim int, region int, sub int, bound double")
            place = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("bound"), *shard))
            wave = F.floor(F.log(float(WAVE), (place * (WAVE - 1) + 1).cast("double") - 0.5))
            reach = materialize(reach.withColumn("wave", wave), "reach")
            for r in reach.select("wave").distinct().orderBy("wave").collect():  # a few
                pairs = reach.where(F.col("wave") == r["wave"]).join(floors(so_far), "qid", "left").where("floor is null or bound >= floor")
                pairs = pairs.join(asked.select("qid", "vector"), "qid").select("qid", *shard, "vector", "floor")
                so_far = best(so_far.drop("rank").unionByName(visit(pairs)))
    return so_far.join(asked.select("qid", "query_id"), "qid").select("query_id", "rank", "vec_id", "score")


def scaled(vectors: DataFrame, id_col: str, vector_col: str, factor: int = 64) -> DataFrame:
    """(id, vector as array<bigint>): floor(factor * x) of each component; vectors with a null or non-finite component are null."""
    x = F.transform(F.col(vector_col), lambda v: v.cast("double"))
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    whole = F.transform(x, lambda v: F.floor(v * F.lit(float(factor))).cast("long"))
    return vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.when(~bad, whole).alias("vector"))
