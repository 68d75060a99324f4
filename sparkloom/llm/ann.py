"""Approximate nearest neighbours by largest inner product: inverted file with product-quantised residuals.

Index: coarse centroids (k-means) part the vectors into lists; a vector's residual to its centroid is quantised per
subspace (one byte each). Both codebooks are fitted on a bounded sample of a 64th of the vectors, SAMPLE to 4 * SAMPLE, in order of a hash;
every vector is indexed. Lists are packed into cells of about CELL vectors (a longer list is split over several), a
row each. Queries are packed into blocks of QUERIES, meet the cells of the lists they probe, and are scored by asymmetric
tables: query x centroid plus a table of query x codeword entries per subspace. The best RERANK of each cell, and all
that tie with the last of them (equal vectors share list and code, hence the score), are reranked exactly on the
original vectors in double precision, and a query's best over all cells are its result.

How many lists a query probes is measured when the index is fitted: the least number that holds a share REACH of the
true neighbours of CALIBRATE sample rows within the sample. It does not grow with the table (neighbours in a larger
table are nearer, so fewer lists hold them): a few lists where vectors cluster, a good third of them where, as in random
directions, neighbours are hardly nearer than the rest. As many lists as hold LEAST_SCAN vectors are probed at least.

Defined results: vectors that are null, zero, hold a null or non-finite component or have another length than the most
frequent one (the larger, if equal) take no part, nor do rows without vec_id; rows that repeat a vec_id count once,
with the least vector; ties go to the smaller vec_id; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkloom.llm import common

SAMPLE, SUBSPACES, CODES, CELL, QUERIES, RERANK, LEAST_SCAN = 16_384, 16, 256, 8192, 2048, 200, 4096
CALIBRATE, REACH, NEIGHBOURS = 512, 0.95, 20
#: Queries scored against a cell at a time: a matrix of 8 MB.
STEP = 256


def kmeans(x: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    """Centroids by Lloyd's rounds; an empty one keeps its place."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        near = nearest(x, c)
        n = np.bincount(near, minlength=k)
        for d in range(x.shape[1]):
            total = np.bincount(near, x[:, d], k)
            c[n > 0, d] = total[n > 0] / n[n > 0]
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    half = (c * c).sum(1) / 2
    return np.concatenate([np.argmax(x[i : i + 4096] @ c.T - half, 1) for i in range(0, len(x), 4096)]) if len(x) else np.empty(0, np.int64)


class Codebooks:
    def __init__(self, sample: np.ndarray, n: int) -> None:
        dims = sample.shape[1]
        self.n_lists = max(1, min(int(4 * math.sqrt(n)), len(sample) // 16))
        self.centroids = kmeans(sample, self.n_lists, 10, 1)
        rest = sample - self.centroids[nearest(sample, self.centroids)]
        self.parts = np.array_split(np.arange(dims), min(SUBSPACES, dims))
        self.words = [kmeans(np.ascontiguousarray(rest[:, p]), min(CODES, len(sample)), 6, 2 + i) for i, p in enumerate(self.parts)]
        self.probes = min(self.n_lists, max(self._measured(sample), math.ceil(LEAST_SCAN * self.n_lists / n)))

    def _measured(self, sample: np.ndarray) -> int:
        """The least number of lists that holds REACH of the sample's true neighbours of some of its rows."""
        rows = np.linspace(0, len(sample) - 1, min(CALIBRATE, len(sample))).astype(int)
        q, k = sample[rows], min(NEIGHBOURS, len(sample) - 1)
        if not k:
            return 1
        scores = q @ sample.T
        scores[np.arange(len(rows)), rows] = -np.inf
        true = np.argpartition(-scores, k - 1, 1)[:, :k]
        place = np.argsort(np.argsort(-(q @ self.centroids.T), 1), 1)
        ranks = np.sort(np.take_along_axis(place, nearest(sample, self.centroids)[true], 1).ravel())
        return int(ranks[math.ceil(REACH * len(ranks)) - 1]) + 1

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        lists = nearest(x, self.centroids)
        rest = x - self.centroids[lists]
        return lists, np.stack([nearest(np.ascontiguousarray(rest[:, p]), w) for p, w in zip(self.parts, self.words, strict=True)], 1).astype(np.uint8)

    def probed(self, q: np.ndarray) -> np.ndarray:
        """Which lists each query looks into: those of its largest inner products with centroids."""
        s = q @ self.centroids.T
        out = np.zeros(s.shape, bool)
        np.put_along_axis(out, np.argpartition(-s, self.probes - 1, 1)[:, : self.probes], True, 1)
        return out

    def tables(self, q: np.ndarray) -> list[np.ndarray]:
        return [q[:, p] @ w.T for p, w in zip(self.parts, self.words, strict=True)]


def _matrix(column, dims: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float32).reshape(-1, dims)


def _encode(books, dims):
    def run(batches):
        for batch in batches:
            flat = batch.column("embedding")
            x = flat.flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(-1, dims)
            lists, codes = books.value.encode(x) if len(x) else (np.empty(0, np.int64), np.empty((0, 1), np.uint8))
            yield pa.record_batch({"vec_id": batch.column("vec_id"), "list": pa.array(lists, pa.int32()), "code": pa.array([c.tobytes() for c in codes], pa.binary()), "vec": pa.array([v.tobytes() for v in x], pa.binary())})

    return run


def _cells_of_queries(books, first, parts, dims):
    def run(batches):
        for batch in batches:
            ids, vecs = batch.column("vec_id").to_pylist(), batch.column("vec").to_pylist()
            out_id, out_vec, out_cell = [], [], []
            if ids:
                for i, row in enumerate(books.value.probed(_matrix(batch.column("vec"), dims))):
                    cells = np.unique(np.concatenate([np.arange(first[k], first[k] + parts[k]) for k in np.flatnonzero(row)])).tolist()
                    out_id += [ids[i]] * len(cells)
                    out_vec += [vecs[i]] * len(cells)
                    out_cell += cells
            yield pa.record_batch({"vec_id": pa.array(out_id, pa.int64()), "vec": pa.array(out_vec, pa.binary()), "cell": pa.array(out_cell, pa.int32())})

    return run


def _search(books, dims, k):
    def run(batches):
        b = books.value
        for batch in batches:
            for row in batch.to_pylist():
                ids, lists = np.array(row["ids"], np.int64), np.array(row["lists"])
                codes = np.frombuffer(row["codes"], np.uint8).reshape(len(ids), -1)
                x = np.frombuffer(row["vecs"], np.float32).reshape(len(ids), dims)
                all_ids, all_q = np.array(row["q_ids"], np.int64), np.frombuffer(row["q_vecs"], np.float32).reshape(-1, dims)
                depth = min(RERANK, len(ids))
                for at in range(0, len(all_ids), STEP):
                    q_ids, q = all_ids[at : at + STEP], all_q[at : at + STEP]
                    scores = (q @ b.centroids.T)[:, lists]
                    for m, t in enumerate(b.tables(q)):
                        scores += t[:, codes[:, m]]
                    scores[~b.probed(q)[:, lists] | (q_ids[:, None] == ids[None])] = -np.inf
                    least = -np.partition(-scores, depth - 1, 1)[:, depth - 1]
                    out_q, out_v, out_s = [], [], []
                    for i, bound in enumerate(least):
                        near = np.flatnonzero((scores[i] >= bound) & np.isfinite(scores[i]))
                        exact = (x[near].astype(np.float64) * q[i].astype(np.float64)).sum(1)
                        near, exact = (y[np.lexsort((ids[near], -exact))[:k]] for y in (near, exact))
                        out_q.append(np.full(len(near), q_ids[i]))
                        out_v.append(ids[near])
                        out_s.append(exact)
                    yield pa.record_batch({"query_id": pa.array(np.concatenate(out_q)), "vec_id": pa.array(np.concatenate(out_v)), "score": pa.array(np.concatenate(out_s))})

    return run


def _pack(df: DataFrame, keys: list[str], columns: dict[str, str]) -> DataFrame:
    """A row for each key with its rows' values: numbers as arrays, binaries joined, all in order of vec_id."""
    rows = df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("vec_id", *(c for c in columns if c != "vec_id")))).alias("r"))
    joined = lambda c: F.unhex(F.array_join(F.transform("r", lambda x: F.hex(x[c])), ""))
    return rows.select(*keys, *((joined(c) if c in ("vec", "code") else F.col(f"r.{c}")).alias(name) for c, name in columns.items()))


def search(vectors: DataFrame, k: int = 20, every: int = 20) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest of each row whose vec_id is divisible by `every`, of vectors (vec_id, embedding)."""
    spark = vectors.sparkSession
    common.bounded_batches(spark)
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    e = common.col("embedding").cast("array<float>")
    rows = vectors.select(common.col("vec_id").cast("long").alias("vec_id"), e.alias("embedding")).where("vec_id is not null and size(embedding) > 0")
    infinite = lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
    rows = rows.where(~F.exists("embedding", infinite) & F.exists("embedding", lambda v: v != 0))
    lengths = rows.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if lengths is None:
        return empty
    dims = lengths["d"]
    rows = common.table(rows.where(F.size("embedding") == dims).groupBy("vec_id").agg(F.min("embedding").alias("embedding")), "vectors")
    n = rows.count()
    size = min(4 * SAMPLE, max(SAMPLE, n // 64))
    share = min(1.0, 1.1 * size / n)
    sample = rows.where(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30)) < int(share * (1 << 30))).orderBy(F.xxhash64("vec_id")).limit(size).toArrow()
    books = spark.sparkContext.broadcast(Codebooks(sample.column("embedding").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(-1, dims), n))

    index = common.table(rows.mapInArrow(_encode(books, dims), "vec_id long, list int, code binary, vec binary"), "ivf")
    counts = np.zeros(books.value.n_lists, np.int64)
    for r in index.groupBy("list").count().collect():  # a row per list, of which the sample's size bounds the number
        counts[r["list"]] = r["count"]
    parts, first, cell, held = -(-counts // CELL), np.zeros(len(counts), np.int64), 0, 0
    for i, c in enumerate(counts):
        if held and held + c > CELL:
            cell, held = cell + 1, 0
        first[i] = cell
        held += c
        if parts[i] > 1:
            cell, held = cell + int(parts[i]), 0
    parts = np.maximum(parts, 1)
    places = spark.createDataFrame([(i, int(a), int(b)) for i, (a, b) in enumerate(zip(first, parts, strict=True))], "list int, first int, parts int")
    placed = index.join(F.broadcast(places), "list").withColumn("cell", (F.col("first") + F.pmod(F.xxhash64("vec_id"), F.col("parts"))).cast("int"))
    cells = _pack(placed, ["cell"], {"vec_id": "ids", "list": "lists", "code": "codes", "vec": "vecs"})
    queries = index.where(F.col("vec_id") % every == 0).select("vec_id", "vec")
    blocks = max(1, -(-queries.count() // QUERIES))
    asked = queries.mapInArrow(_cells_of_queries(books, first.tolist(), parts.tolist(), dims), "vec_id long, vec binary, cell int")
    asked = _pack(asked.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks))), ["cell", "block"], {"vec_id": "q_ids", "vec": "q_vecs"})
    found = cells.join(asked, "cell").drop("cell", "block").mapInArrow(_search(books, dims, k), "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op2_ivf_pq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
