"""Ball k-means over whole numbers: every result is exact, so it does not depend on how the rows are dealt.

A cluster is a ball: its centroid and a radius that no member exceeds. Centroid j is a neighbour of i if half the
distance between them is not above the radius of i; no member of i can be nearer to any other centroid. Neighbours by
distance cut a ball into its stable core (members nearer to their centroid than half the way to the nearest neighbour,
which stay uncompared) and annuli: members of the m-th annulus are compared with the m nearest neighbours alone. A
cluster that has not moved and whose neighbours have not keeps its members unread. All comparisons are of squared whole
numbers; where both sides are equal the smaller centroid number wins, so such members are compared.

Each round is one map over the table written by the round before: tasks keep the centroids (k vectors), write every
vector with its cluster and distance, and at their end a row for each cluster with count, component sums, inertia and
the largest distance. Spark sums these rows, and k rows of sums go to the driver, whatever the number of vectors. A
ball's radius is the largest distance found in the round before plus the way its centroid has gone since, so no pass is
needed for it. A cluster with most rows is spread over all tasks.

Defined results: vectors that are null, of another length, or with null or non-finite components take no part; a null
vec_id counts as no digits in the digest that picks the first centroids; rows that repeat count as often as they occur
(and may be several of the first centroids: the smaller number then wins, the other stays empty and in place); with
fewer vectors than clusters there are as many clusters as vectors; an empty table gives no rows; other columns are
ignored. A component of 2**27 or more after scaling ends in an error, as squared distances would leave 64 bits.
"""

from __future__ import annotations

from dataclasses import dataclass
from hashlib import sha256
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm import common

CLUSTERS, ROUNDS, SCALE, DIMENSIONS, SEED, LIMIT = 16, 3, 64, 64, 1, 1 << 27
STATE = "vec_id long, x binary, cluster int, distance long, n long, sums array<bigint>, inertia long, widest long, compared long"
ARROW = pa.schema([
    ("vec_id", pa.int64()), ("x", pa.binary()), ("cluster", pa.int32()), ("distance", pa.int64()), ("n", pa.int64()), ("sums", pa.list_(pa.int64())), ("inertia", pa.int64()), ("widest", pa.int64()),
    ("compared", pa.int64()),
])


@dataclass
class Balls:
    """Centroids, and what is known of each ball before the members are looked at."""

    centroids: np.ndarray
    neighbours: list[list[tuple[int, int]]]  # per ball: (squared distance between centroids, number), nearest first
    still: list[bool]  # neither the ball nor a neighbour has moved

    @classmethod
    def around(cls, centroids: np.ndarray, before: np.ndarray, widest: list[int | None]) -> Balls:
        """Balls of centroids that have come from `before`, where no member was farther than the root of `widest`."""
        gaps = ((centroids[:, None] - centroids[None]) ** 2).sum(2).tolist()
        ways = ((centroids - before) ** 2).sum(1).tolist()
        neighbours = []
        for i, most in enumerate(widest):
            reach = 0 if most is None else isqrt(most) + isqrt(ways[i]) + 2  # not below the true radius
            neighbours.append(sorted((g, j) for j, g in enumerate(gaps[i]) if j != i and most is not None and g <= 4 * reach * reach))
        still = [not ways[i] and not any(ways[j] for _, j in near) for i, near in enumerate(neighbours)]
        return cls(centroids, neighbours, still)


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    d = x - c
    return np.einsum("ij,ij->i", d, d)


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cluster and squared distance of each row, by comparing all."""
    cluster, best = np.zeros(len(x), np.int64), squared(x, centroids[0])
    for j in range(1, len(centroids)):
        d = squared(x, centroids[j])
        nearer = d < best
        cluster[nearer], best[nearer] = j, d[nearer]
    return cluster, best


def reassign(x: np.ndarray, cluster: np.ndarray, distance: np.ndarray, balls: Balls) -> tuple[np.ndarray, np.ndarray, int]:
    """(cluster, squared distance, number of distances computed) of members of balls."""
    cluster, best, computed = cluster.copy(), distance.copy(), 0
    for i in np.unique(cluster).tolist():
        if balls.still[i]:
            continue
        at = np.flatnonzero(cluster == i)
        own = squared(x[at], balls.centroids[i])
        least, to = own.copy(), np.full(len(at), i)
        computed += len(at)
        outer = np.arange(len(at))
        for gap, j in balls.neighbours[i]:
            outer = outer[4 * own[outer] >= gap]  # the rest is inside this annulus
            if not len(outer):
                break
            d = squared(x[at[outer]], balls.centroids[j])
            computed += len(outer)
            nearer = (d < least[outer]) | (d == least[outer]) & (j < to[outer])
            least[outer[nearer]], to[outer[nearer]] = d[nearer], j
        best[at] = least
        cluster[at] = -1 - to  # so that a member is not met again in a later ball
    moved = cluster < 0
    cluster[moved] = -1 - cluster[moved]
    return cluster, best, computed


class _Sums:
    """Count, component sums, inertia and largest distance by cluster, of one task."""

    def __init__(self, k: int, d: int) -> None:
        self.n, self.sums, self.inertia, self.widest = np.zeros(k, np.int64), np.zeros((k, d), np.int64), np.zeros(k, np.int64), np.full(k, -1, np.int64)
        self.compared = 0

    def add(self, x: np.ndarray, cluster: np.ndarray, distance: np.ndarray) -> None:
        for i in np.unique(cluster).tolist():
            own = cluster == i
            self.n[i] += own.sum()
            self.sums[i] += x[own].sum(0)
            self.inertia[i] += distance[own].sum()
            self.widest[i] = max(self.widest[i], distance[own].max())

    def rows(self) -> pa.RecordBatch:
        there = np.flatnonzero(self.n)
        columns = {"cluster": there, "n": self.n[there], "sums": list(self.sums[there]), "inertia": self.inertia[there], "widest": self.widest[there], "compared": [self.compared] + [0] * (len(there) - 1) if len(there) else []}
        return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(len(there), f.type) for f in ARROW], schema=ARROW)


def _vectors(column: pa.Array, dimensions: int) -> np.ndarray:
    """An array column without nulls, or binary rows of int64, as a matrix."""
    if pa.types.is_binary(column.type):
        return np.frombuffer(b"".join(column.to_pylist()), np.int64).reshape(-1, dimensions)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dimensions)


def _written(ids: pa.Array, x: np.ndarray, cluster: np.ndarray, distance: np.ndarray) -> pa.RecordBatch:
    columns = {"vec_id": ids, "x": pa.array([row.tobytes() for row in x], pa.binary()), "cluster": pa.array(cluster.astype(np.int32)), "distance": pa.array(distance)}
    return pa.RecordBatch.from_arrays([columns.get(f.name, pa.nulls(len(x), f.type)) for f in ARROW], schema=ARROW)


def _quantiser(scale: int, dimensions: int, centroids: np.ndarray):
    """Scaled whole vectors with the nearest of the first centroids."""

    def run(batches):
        sums = _Sums(len(centroids), dimensions)
        for batch in batches:
            if not batch.num_rows:
                continue
            scaled = np.floor(scale * _vectors(batch.column("embedding"), dimensions))
            if np.abs(scaled).max() >= LIMIT:
                raise ValueError(f"a component of {np.abs(scaled).max():g} after scaling: squared distances would leave 64 bits")
            x = scaled.astype(np.int64)
            cluster, distance = nearest(x, centroids)
            sums.add(x, cluster, distance)
            sums.compared += len(x) * len(centroids)
            yield _written(batch.column("vec_id"), x, cluster, distance)
        yield sums.rows()

    return run


def _round(balls: Balls, dimensions: int):
    def run(batches):
        sums = _Sums(len(balls.centroids), dimensions)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _vectors(batch.column("x"), dimensions)
            cluster, distance, computed = reassign(x, batch.column("cluster").to_numpy().astype(np.int64), batch.column("distance").to_numpy(), balls)
            sums.add(x, cluster, distance)
            sums.compared += computed
            yield _written(batch.column("vec_id"), x, cluster, distance)
        yield sums.rows()

    return run


def usable(vectors: DataFrame, dimensions: int) -> DataFrame:
    """vec_id, embedding of the rows that take part."""
    e = common.col("embedding")
    finite = F.forall(e, lambda x: F.coalesce(~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")), F.lit(False)))
    return vectors.select(common.col("vec_id").cast("long").alias("vec_id"), e.alias("embedding")).where(F.coalesce(F.size("embedding") == dimensions, F.lit(False)) & finite)


def _first_centroids(kept: DataFrame, k: int, scale: int, seed: int) -> np.ndarray:
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    rows = kept.select(order.alias("h"), F.transform("embedding", lambda x: F.floor(x.cast("double") * scale)).alias("x")).orderBy("h", "x").limit(k).collect()
    return np.array([r["x"] for r in rows], np.int64)


def _collected(state: DataFrame, k: int, dimensions: int) -> tuple[np.ndarray, list[list[int]], list[int], list[int | None], int]:
    """(counts, exact sums, inertia, widest, distances computed) by cluster: k rows to the driver."""
    rows = state.where("n is not null")
    one = {r["cluster"]: r for r in rows.groupBy("cluster").agg(F.sum("n").alias("n"), F.sum(F.col("inertia").cast("decimal(38,0)")).alias("inertia"), F.max("widest").alias("widest"), F.sum("compared").alias("compared")).collect()}
    parts = rows.select("cluster", F.posexplode("sums").alias("p", "v")).groupBy("cluster", "p").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v")).collect()
    sums = [[0] * dimensions for _ in range(k)]
    for r in parts:
        sums[r["cluster"]][r["p"]] = int(r["v"])
    n = [one[i]["n"] if i in one else 0 for i in range(k)]
    return n, sums, [int(one[i]["inertia"]) if i in one else 0 for i in range(k)], [one[i]["widest"] if i in one else None for i in range(k)], sum(r["compared"] for r in one.values())


@dataclass
class Clustering:
    """rows: vec_id, cluster, distance of every vector that takes part. compared: distances computed in each round."""

    rows: DataFrame
    centroids: np.ndarray
    n: list[int]
    inertia: list[int]
    compared: list[int]


def ball_kmeans(vectors: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, scale: int = SCALE, dimensions: int = DIMENSIONS, seed: int = SEED) -> Clustering:
    """Clusters of vectors (vec_id, embedding) after so many rounds and a last assignment."""
    spark = vectors.sparkSession
    common.bounded_batches(spark)
    kept = usable(vectors, dimensions)
    centroids = _first_centroids(kept, k, scale, seed)
    k = len(centroids)
    if not k:
        return Clustering(common.local_table(spark, [], "vec_id long, cluster int, distance long"), np.zeros((0, dimensions), np.int64), [], [], [])
    state = common.table(kept.mapInArrow(common.tidy(_quantiser(scale, dimensions, centroids)), STATE), "balls")
    compared = []
    for _ in range(rounds):
        n, sums, _, widest, computed = _collected(state, k, dimensions)
        compared.append(computed)
        before, centroids = centroids, np.array([[s // n[i] for s in sums[i]] if n[i] else centroids[i].tolist() for i in range(k)], np.int64)
        members = state.where("n is null").select("vec_id", "x", "cluster", "distance")
        following = common.table(members.mapInArrow(common.tidy(_round(Balls.around(centroids, before, widest), dimensions)), STATE), "balls")
        common.drop_table(state)
        state = following
    n, _, inertia, _, computed = _collected(state, k, dimensions)
    return Clustering(state.where("n is null").select("vec_id", "cluster", "distance"), centroids, n, inertia, [*compared, computed])


def op11_ball_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ball_kmeans(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    names = [sha256(",".join(map(str, c)).encode()).hexdigest() for c in found.centroids.tolist()]
    rows = [(i, inertia, sum(found.inertia), name) for i, (inertia, name) in enumerate(zip(found.inertia, names, strict=True))]
    clusters = common.local_table(spark, rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.rows.join(F.broadcast(clusters), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # a row for each cluster
