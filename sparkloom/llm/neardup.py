"""MinHash near-dedup: an inverted join on signature coordinates, confirmed on full shingle sets.

1. Every text becomes its set of distinct five-word shingles (64-bit hashes) and a signature of COORDINATES minima.
   Rows with equal sets are one class, which goes on under a number of its own; its text is that of its smallest doc_id.
2. A (coordinate, value) pair is a posting list. Two sets of similarity 0.85 agree in a coordinate with probability
   0.85; pairs that agree in fewer than `matches` of COORDINATES coordinates are not candidates (at the threshold,
   one in about 100,000 is missed). So two candidates share a pair among the COORDINATES - matches + 1 rarest of
   either one, and only those prefixes are posted; pairs held by one class alone are never posted, and long lists
   (a passage in very many texts) are skipped where rarer pairs suffice.
3. Classes that share a posted pair form clusters (star edges to each list's least id, then connected components), inside
   which posting lists are merged: a class's shortest lists (the prefix) are merged and their collisions counted, the
   longest are skipped and only probed for the classes met so. Pairs above the match threshold are confirmed on full sets.
   A cluster is cut into chunks of CHUNK. First each chunk is searched by itself, best matches first; a pair whose ends
   are linked already needs no confirmation. Then the busiest member of each group found in a chunk stands for it in
   chunks of such members, level by level. Last, all members outside a cluster's largest component so far meet all of
   the cluster, chunk by chunk. So no pair between two components is left out, while a group of copies costs work in
   proportion to its size, not its square.
4. Connected components over confirmed links and over the classes that share a doc_id, then back to all rows.

Defined results: a text without words (or null) has an empty set and is linked with nothing; fewer than five words
are one shingle; a null doc_id cannot be named: its component_id is null and it is kept; rows that repeat a doc_id
are one document in links, whatever their texts, and keep a row each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from hashlib import blake2b

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkloom.llm import common

COORDINATES, SHINGLE, CHUNK = 64, 5, 512
#: Classes whose ids may be broadcast to pick their texts: 16 MB of ids. More are joined by shuffle.
BROADCAST_IDS = 1_000_000
#: Edges of a node that may meet in one task.
HOT_NODE = 256
#: Edges of a graph that one task may finish: 4 MB. More go by steps over all tasks.
TASK_EDGES = 1 << 18
PRIME = np.uint64(0x9E3779B97F4A7C15)
_rng = np.random.default_rng(20_250_801)
_MUL = _rng.integers(1, 1 << 63, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(0, 1 << 63, COORDINATES, dtype=np.uint64)


def least_matches(percent: int) -> int:
    """Coordinates in which two sets at the threshold agree at least, but for one pair in about 100,000: 4.3 deviations under the mean."""
    p = percent / 100
    return max(1, int(COORDINATES * p - 4.3 * (COORDINATES * p * (1 - p)) ** 0.5))


class Shingler:
    """Distinct shingles of a text as sorted 64-bit hashes."""

    #: Words whose hashes are held: some 15 MB.
    MEMO = 100_000

    def __init__(self, n: int = SHINGLE) -> None:
        self.n, self.memo = n, {}

    def __call__(self, text: bytes) -> np.ndarray:
        words, memo = text.lower().split(), self.memo
        for w in set(words).difference(memo):
            memo[w] = int.from_bytes(blake2b(w, digest_size=8).digest(), "little")
        h = np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))
        if len(memo) > self.MEMO:
            memo.clear()
        n = min(self.n, len(h))
        if not n:
            return h
        with np.errstate(over="ignore"):
            out = np.full(len(h) - n + 1, n, np.uint64)
            for i in range(n):
                out = out * PRIME + h[i : len(h) - n + 1 + i]
            out ^= out >> np.uint64(29)
            out *= np.uint64(0xBF58476D1CE4E5B9)
            out ^= out >> np.uint64(32)
        return np.unique(out)


def signature(shingles: np.ndarray) -> np.ndarray:
    out = np.full(COORDINATES, 0xFFFFFFFF, np.uint32)
    with np.errstate(over="ignore"):
        for at in range(0, len(shingles), 4096):
            part = (_MUL[:, None] * shingles[None, at : at + 4096] + _ADD[:, None]) >> np.uint64(32)
            out = np.minimum(out, part.min(1).astype(np.uint32))
    return out


def _signatures(batches):
    shingles = Shingler()
    for batch in batches:
        sizes, keys, sigs = [], [], []
        for text in batch.column("text").to_pylist():
            s = shingles(text)
            sizes.append(len(s))
            keys.append(blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
            sigs.append(signature(s).view(np.int32) if len(s) else None)
        yield pa.record_batch({"doc_id": batch.column("doc_id"), "n_shingles": pa.array(sizes, pa.int64()), "set_key": pa.array(keys, pa.binary()), "sig": pa.array(sigs, pa.list_(pa.int32()))})


def _sets(batches):
    shingles = Shingler()
    for batch in batches:
        found = [shingles(t) for t in batch.column("text").to_pylist()]
        yield pa.record_batch({
            "doc_id": batch.column("doc_id"), "set_key": pa.array([blake2b(s.tobytes(), digest_size=16).digest() for s in found], pa.binary()), "cluster": batch.column("cluster"), "chunks": batch.column("chunks"),
            "shingles": pa.array([s.tobytes() for s in found], pa.binary()),
        })


def _with_least(edges: DataFrame, least: DataFrame, many: int) -> DataFrame:
    """edges (u, v) with m of least (u, m, n). A hot node's edges, n over `many`, stay where they are: its m is sent to them."""
    hot = F.broadcast(least.where(F.col("n") > many).select(F.col("u").alias("hot"), "m"))
    spread = edges.join(hot, F.col("u") == F.col("hot")).select("u", "v", "m")
    rest = edges.join(hot, F.col("u") == F.col("hot"), "left_anti").join(least.where(F.col("n") <= many).select("u", "m"), "u").select("u", "v", "m")
    return spread.unionAll(rest)


def _roots(batches):
    """node, root of the edges (u, v) in all batches; roots take the least root they have an edge to until none has one."""
    found = [(batch.column("u").to_numpy(), batch.column("v").to_numpy()) for batch in batches if batch.num_rows]
    if not found:
        return
    nodes, ends = np.unique(np.concatenate([x for uv in zip(*found, strict=True) for x in uv]), return_inverse=True)
    a, b = ends.reshape(2, -1)
    root = np.arange(len(nodes))
    while True:
        ra, rb = root[a], root[b]
        apart = ra != rb
        if not apart.any():
            break
        a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while (root[root] != root).any():
            root = root[root]
    other = np.flatnonzero(root != np.arange(len(nodes)))
    yield pa.record_batch({"node": pa.array(nodes[other], pa.int64()), "root": pa.array(nodes[root[other]], pa.int64())})


def components(edges: DataFrame) -> DataFrame:
    """node, root (its component's least node) for edges (a, b); alternates large and small stars until stable, or until
    the edges left, which have the same components, are few enough for one task (TASK_EDGES).

    Each step is a join and an aggregate over the remaining edges; the edges are written to the shared folder between
    steps. Above that bound no component is gathered in one task: only least neighbours are aggregated, and a hot node's
    edges never meet. Each step also costs the driver some ten stages, of as many tasks as there are partitions.
    """
    edges = common.table(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "cc")
    before = None
    now = (edges.count(), None)
    while True:
        if now[0] <= TASK_EDGES:
            return common.table(edges.coalesce(1).mapInArrow(common.tidy(_roots), "node long, root long"), "roots")
        # nodes with more edges than this are at most BROADCAST_IDS, as every edge has two ends
        many = max(HOT_NODE, 2 * now[0] // BROADCAST_IDS)
        # large star: every larger neighbour of a node points to the least of its neighbours
        both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        large = _with_least(both.where("v > u"), least, many).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: a node and its smaller neighbours point to the least of them
        large = common.table(large, "cc")
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = _with_least(large, least, many).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = common.table(small.unionAll(least.select("u", F.col("m").alias("v"))).distinct(), "cc")
        now = edges.agg(F.count("*"), F.coalesce(F.sum(F.hash("u", "v").cast("long")), F.lit(0))).first()
        if now == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = now


def _collisions(sig: np.ndarray, size: np.ndarray, allowed, percent: int, matches: int):
    """(i, others, collisions) of each signature i and those others of at least `matches` collisions that allowed(i) names.

    Every coordinate's values have posting lists. Of i's lists the COORDINATES - matches + 1 shortest are its prefix: one
    with enough collisions is in some of them, so these are merged and counted; the rest, the longest, are skipped and
    only probed for what the merge has found. Sets too unlike in size are dropped before.
    """
    n = len(sig)
    lists = np.argsort(sig, 0, kind="stable")
    values = np.take_along_axis(sig, lists, 0)
    first = np.vstack([np.ones((1, sig.shape[1]), bool), values[1:] != values[:-1]])
    start = np.maximum.accumulate(np.where(first, np.arange(n)[:, None], 0), 0)
    after = np.vstack([first[1:], np.ones((1, sig.shape[1]), bool)])
    end = np.minimum.accumulate(np.where(after, np.arange(1, n + 1)[:, None], n)[::-1], 0)[::-1]
    low, high = np.empty_like(start), np.empty_like(end)
    np.put_along_axis(low, lists, start, 0)
    np.put_along_axis(high, lists, end, 0)
    order = np.argsort(high - low, 1, kind="stable")
    lists = np.ascontiguousarray(lists.T)
    for i in range(n):
        others = allowed(i)
        if others is None:
            continue
        prefix = order[i, : sig.shape[1] - matches + 1]
        merged = [lists[c, low[i, c] : high[i, c]] for c in prefix.tolist() if high[i, c] - low[i, c] > 1]
        if not merged:
            continue
        counts = np.bincount(np.concatenate(merged), minlength=n)
        near = np.flatnonzero((counts > 0) & others & (100 * np.minimum(size[i], size) >= percent * np.maximum(size[i], size)))
        skipped = order[i, sig.shape[1] - matches + 1 :]
        found = counts[near] + (sig[near][:, skipped] == sig[i, skipped]).sum(1)
        keep = found >= matches
        yield i, near[keep], found[keep]


def _linker(percent: int):
    matches = least_matches(percent)

    def links(cell: pd.DataFrame) -> pd.DataFrame:
        """Links of one cell: the pairs of one chunk, or those between two, that join components; in one chunk also
        each group's busiest member, as a link to itself."""
        cell = cell.sort_values("doc_id")
        ids, own = cell.doc_id.to_numpy(), cell.own.to_numpy()
        sets = [np.frombuffer(x, np.uint64) for x in cell.shingles]
        size = np.array([len(s) for s in sets], np.int64)
        sig = np.stack([signature(s) for s in sets])
        ci, cj = int(cell.ci.iloc[0]), int(cell.cj.iloc[0])
        one, place = ci == cj, np.arange(len(ids))
        allowed = (lambda i: place > i) if one else (lambda i: own == cj if own[i] == ci else None)
        found_i, found_j, found_m = [], [], []
        for i, others, found in _collisions(sig, size, allowed, percent, matches):
            found_i.append(np.full(len(others), i))
            found_j.append(others)
            found_m.append(found)
        out: list[tuple[int, int]] = []
        if found_i:
            i, j, m = (np.concatenate(x) for x in (found_i, found_j, found_m))
            first: dict[int, int] = {}
            root = [first.setdefault(c, k) for k, c in enumerate(cell.comp.tolist())]

            def find(x: int) -> int:
                while root[x] != x:
                    root[x] = root[root[x]]
                    x = root[x]
                return x

            for k in np.argsort(-m, kind="stable").tolist():
                a, b = int(i[k]), int(j[k])
                ra, rb = find(a), find(b)
                if ra == rb:
                    continue
                both = len(np.intersect1d(sets[a], sets[b], assume_unique=True))
                if 100 * both >= percent * (size[a] + size[b] - both):
                    root[ra] = rb
                    out.append((ids[a], ids[b]))
            if one:
                busy = np.bincount(np.concatenate([i, j]), minlength=len(ids))
                linked = {find(int(np.searchsorted(ids, a))) for a, _ in out}
                best: dict[int, int] = {}
                for k in np.argsort(-busy, kind="stable").tolist():
                    best.setdefault(find(k), k)
                out += [(ids[best[r]], ids[best[r]]) for r in linked]
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return links


def _chunk(name: str) -> Column:
    return F.pmod(F.xxhash64("doc_id"), F.col(name)).cast("int")


def _search_cells(cells: DataFrame, percent: int) -> DataFrame:
    columns = ["doc_id", "cluster", "ci", "cj", "own", "comp", "shingles"]
    return cells.select(*columns).groupBy("cluster", "ci", "cj").applyInPandas(_linker(percent), "a long, b long")


def _search_chunks(sets: DataFrame, percent: int) -> DataFrame:
    """Links inside each chunk of sets (doc_id, cluster, chunks, shingles)."""
    own = _chunk("chunks")
    return _search_cells(sets.select("doc_id", "cluster", "shingles", own.alias("own"), own.alias("ci"), own.alias("cj"), F.col("doc_id").alias("comp")), percent)


def _across_chunks(sets: DataFrame, links: DataFrame, percent: int) -> DataFrame:
    """`links` (those inside chunks) and the ones between chunks of one cluster that join components."""
    level, before = links, None
    while True:
        tops = level.where("a = b").select(F.col("a").alias("doc_id")).join(sets.select("doc_id", "cluster").distinct(), "doc_id")
        sizes = common.table(tops.groupBy("cluster").agg(F.count("*").alias("n")), "tops")
        n, most = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
        if most < 2 or before is not None and 2 * n > before:
            break
        chunked = sets.drop("chunks").join(tops.select("doc_id"), "doc_id").join(sizes.select("cluster", F.ceil(F.col("n") / CHUNK).cast("int").alias("chunks")), "cluster")
        level = common.table(_search_chunks(chunked, percent), "links")
        links, before = links.unionAll(level), n
        if most <= CHUNK:
            break

    found = components(links)
    place = sets.select("doc_id", "cluster").distinct().join(found, F.col("doc_id") == F.col("node"), "left").select("doc_id", "cluster", F.coalesce("root", "doc_id").alias("comp"))
    place = common.table(place, "places")
    main = place.groupBy("cluster", "comp").agg(F.count("*").alias("n")).groupBy("cluster").agg(F.max(F.struct("n", "comp")).alias("main"), F.sum("n").alias("n"))
    rest = F.col("n") - F.col("main.n")
    main = main.where(rest > 0).select("cluster", F.col("main.comp").alias("main"), F.ceil(rest / CHUNK).cast("int").alias("outer"), F.ceil(F.col("main.n") / CHUNK).cast("int").alias("inner"))
    placed = sets.drop("chunks", "cluster").join(place.join(main, "cluster"), "doc_id")
    outside = F.col("comp") != F.col("main")
    # chunks of members outside the main component come first, and each meets every chunk, itself included
    grid = (
        placed.withColumn("own", F.when(outside, _chunk("outer")).otherwise(F.col("outer") + _chunk("inner")))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.when(outside, F.col("outer") + F.col("inner")).otherwise(F.col("outer")) - 1)))
        .withColumn("ci", F.least("own", "other")).withColumn("cj", F.greatest("own", "other"))
    )
    return links.unionAll(common.table(_search_cells(grid, percent), "links"))


def _ids_of_several_sets(signed: DataFrame, classes: DataFrame) -> DataFrame | None:
    """doc_id, class of ids whose rows do not all have one set: one document in several classes. None if there is no such id."""
    key = F.coalesce("set_key", F.lit(b""))
    ids = signed.where("doc_id is not null").groupBy("doc_id").agg(F.min(key).alias("low"), F.max(key).alias("high")).where("low <> high").select("doc_id")
    ids = common.table(ids, "several-ids")
    n = ids.count()
    if not n:
        return None
    rows = signed.where("set_key is not null").select("doc_id", "set_key").join(F.broadcast(ids) if n <= BROADCAST_IDS else ids, "doc_id").distinct()
    return common.table(rows.join(classes.select("set_key", F.col("doc_id").alias("class")), "set_key").select("doc_id", "class"), "several")


def near_duplicates(docs: DataFrame, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs (doc_id, text); linked: similarity >= percent / 100."""
    spark = docs.sparkSession
    common.bounded_batches(spark)
    rows = docs.select(common.col("doc_id").cast("long").alias("doc_id"), common.text_of().cast("binary").alias("text"))
    signed = common.table(rows.mapInArrow(common.tidy(_signatures), "doc_id long, n_shingles long, set_key binary, sig array<int>"), "signatures")
    named = signed.where(F.col("set_key").isNotNull() & F.col("doc_id").isNotNull())
    classes = named.groupBy("set_key").agg(F.min("doc_id").alias("text_id"), F.first("sig").alias("sig"))
    classes = common.table(classes.withColumn("doc_id", F.monotonically_increasing_id()), "classes")  # from here on doc_id names a class

    pairs = classes.select("doc_id", F.posexplode("sig").alias("c", "v"))
    common_pairs = pairs.groupBy("c", "v").count().where("count > 1")
    shared = pairs.join(common_pairs, ["c", "v"]).groupBy("doc_id").agg(F.collect_list(F.struct("count", "c", "v")).alias("p"))
    # of the rarest COORDINATES - matches + 1 pairs, those that no other class holds come first and need no posting
    length = F.size("p") - F.lit(least_matches(percent) - 1)
    prefix = shared.where(length > 0).select("doc_id", F.explode(F.slice(F.array_sort("p"), F.lit(1), length)).alias("p"))
    posted = common.table(prefix.select("doc_id", "p.c", "p.v"), "postings")
    least = posted.groupBy("c", "v").agg(F.min("doc_id").alias("b"))
    clusters = components(posted.join(least, ["c", "v"]).select(F.col("doc_id").alias("a"), "b"))
    members = clusters.select(F.col("node").alias("doc_id"), F.col("root").alias("cluster")).unionAll(clusters.select(F.col("root").alias("doc_id"), F.col("root").alias("cluster")).distinct())
    sizes = members.groupBy("cluster").agg(F.count("*").alias("n"))
    members = members.join(sizes, "cluster").join(classes.select("doc_id", "text_id"), "doc_id")
    members = common.table(members.select("doc_id", "text_id", "cluster", F.ceil(F.col("n") / CHUNK).cast("int").alias("chunks")), "members")

    n = members.count()
    picked = F.broadcast(members) if n <= BROADCAST_IDS else members
    texts = rows.select(F.col("doc_id").alias("text_id"), "text").join(picked, "text_id").select("doc_id", "text", "cluster", "chunks")
    sets = texts.mapInArrow(common.tidy(_sets), "doc_id long, set_key binary, cluster long, chunks int, shingles binary")
    sets = sets.join(classes.select("doc_id", "set_key"), ["doc_id", "set_key"], "left_semi").dropDuplicates(["doc_id", "set_key"])
    sets = common.table(sets.drop("set_key"), "sets")
    links = common.table(_search_chunks(sets, percent), "links")
    big = sets.where("chunks > 1")
    if not big.isEmpty():
        links = _across_chunks(big, links, percent)
    several = _ids_of_several_sets(signed, classes)
    if several is not None:
        first = several.groupBy("doc_id").agg(F.min("class").alias("b"))
        links = links.unionAll(several.join(first, "doc_id").select(F.col("class").alias("a"), "b"))
    roots = components(links)

    grouped = roots.select("node", "root").unionAll(roots.select(F.col("root").alias("node"), "root").distinct())
    first = grouped.join(classes.select(F.col("doc_id").alias("node"), "text_id"), "node").groupBy("root").agg(F.min("text_id").alias("first"))
    firsts = grouped.join(first, "root").select(F.col("node").alias("doc_id"), "first")
    class_roots = classes.join(firsts, "doc_id", "left").select("set_key", F.col("doc_id").alias("class"), F.coalesce("first", "text_id").alias("root"))
    found = signed.select("doc_id", "n_shingles", "set_key").join(class_roots.drop("class"), "set_key", "left")
    if several is not None:  # a row without words too is of its document
        own = several.join(class_roots, "class").groupBy("doc_id").agg(F.min("root").alias("own"))
        found = found.join(own, "doc_id", "left").withColumn("root", F.coalesce("own", "root"))
    component = F.when(F.col("doc_id").isNull(), F.lit(None).cast("long")).otherwise(F.coalesce("root", "doc_id"))
    return found.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, percent: int = 85) -> DataFrame:
    """docs (doc_id, text) with one document of each group: rows that are not their component's least doc_id go.

    Rows that repeat a kept doc_id stay once, the one with the least hash of its text; rows of a null doc_id and texts
    without words stay; an empty table stays empty; other columns, whatever their names, pass through.
    """
    found = near_duplicates(docs, percent)
    gone_id, again_id, h, row, kept = common.free(docs, "gone_id", "again_id", "text_hash", "row_uid", "kept_uid")
    gone = found.where(~F.col("kept")).select(F.col("doc_id").alias(gone_id)).distinct()
    again = found.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias(again_id))
    doc_id = common.col("doc_id").cast("long")
    left = docs.join(gone, doc_id == F.col(gone_id), "left_anti")
    if again.isEmpty():
        return left
    # the row kept of each repeated id is found by an aggregate, which a hot id does not gather in one task
    left = common.table(left.withColumns({h: F.xxhash64(common.text_of()), row: F.monotonically_increasing_id()}), "once")
    side = F.broadcast(again) if again.count() <= BROADCAST_IDS else again
    first = left.join(side, doc_id == F.col(again_id)).groupBy(again_id).agg(F.min(F.struct(h, row)).alias("least")).select(again_id, F.col(f"least.{row}").alias(kept))
    first = common.table(first, "first-rows")
    firsts = F.broadcast(first) if first.count() <= BROADCAST_IDS else first
    marked = left.join(firsts, doc_id == F.col(again_id), "left").where(F.col(again_id).isNull() | (F.col(row) == F.col(kept)))
    return marked.select(*(common.col(c) for c in docs.columns))


def op10_minhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
