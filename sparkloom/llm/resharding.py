"""Resharding by minimum-cost flow: from the sizes of old shards and the capacities of new ones, the transfers that move
the fewest bytes; then only the files that a transfer meets are written again.

A layout is a Parquet dataset of blocks (folders shard=/block=) and a manifest with a row for each block: where its file
lies, its rows and bytes and the slot of its first row. A block's rows carry their place in it (`pos`, and `at` in
bytes), so a slot is the block's first slot plus pos, and blocks that stay are never opened to be numbered anew.

Resharding: old shards are sources of their bytes, new ones sinks of equal capacities; keeping a byte costs nothing, to
move it costs 1 (or what `cost` says). The cheapest flow is found by shortest augmenting paths over shards, which are few
whatever the data. An old shard is cut along its bytes: what it keeps, then its transfers in order; a row goes where its
middle byte lies. Blocks inside one cut go whole; those that hold a boundary are read once to count the rows on each
side. Rows of a whole block that stays are not read at all; moved ones are written to the new generation in one map
without a shuffle, and the manifest, written last, makes them valid: until then, and if a job fails, the old layout holds.

First layout: rows by a hash of id and text. Rows above 1/128 of a shard lie in the first half of its blocks, so that
cuts, which lie at the end of a shard that has too much, meet small rows and sizes come out near equal. Where far more
rows than usual share a part of the hash (rows repeated as they are), these are dealt over all shards by row.

Limits by parameter: a shard has MOST_BLOCKS blocks at first, so the manifest (the driver holds it, tasks get it) does
not grow without bound; blocks grow instead beyond BLOCK_BYTES.

Defined results: a null text is kept as null, its size is the overhead alone; a null doc_id is an id; rows that repeat
are rows of their own (where very many repeat, which of the equal rows lies where depends on how the input is read); an
empty table gives an empty layout; other columns are left out.
"""

from __future__ import annotations

import uuid
from bisect import bisect_right
from dataclasses import dataclass, replace
from itertools import accumulate

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkloom.llm import common

OLD_SHARDS, NEW_SHARDS, OVERHEAD = 32, 40, 16
BLOCK_BYTES, LEAST_BLOCKS, MOST_BLOCKS, LARGE = 64 << 20, 8, 4096, 128
#: Parts of the hash that are looked at for repeated rows, and how many times the mean such a part must have.
PARTS, REPEATED, FEW = 4096, 8, 64
ROWS = "doc_id long, text string, size long, pos long, at long, shard int, block int"
MANIFEST = "path string, shard int, block int, n long, bytes long, slot long"


@dataclass(frozen=True)
class Block:
    path: str  # the generation that holds it
    shard: int
    block: int
    n: int
    bytes: int
    slot: int = 0


@dataclass(frozen=True)
class Layout:
    """blocks: in the order of their slots. moved: bytes that the last resharding moved."""

    shards: int
    blocks: list[Block]
    manifest: str
    moved: int = 0

    def sizes(self) -> list[int]:
        out = [0] * self.shards
        for b in self.blocks:
            out[b.shard] += b.bytes
        return out


def transfers(sizes: list[int], capacities: list[int], cost: np.ndarray | None = None) -> list[tuple[int, int, int]]:
    """(old, new, bytes) of the cheapest flow from sizes into capacities, which hold all of them; whole numbers.

    cost: whole costs of a byte from old (row) to new (column); without it 0 in place and 1 elsewhere.
    """
    if sum(capacities) < sum(sizes):
        raise ValueError("the capacities are too small")
    n, m = len(sizes), len(capacities)
    if cost is None:
        cost = 1 - np.eye(n, m, dtype=np.int64)
    left, room, flow = np.array(sizes, np.int64), np.array(capacities, np.int64), np.zeros((n, m), np.int64)
    far = np.int64(1) << 60
    while left.any():
        # shortest ways from all old shards with bytes left, over given flow taken back as well
        to_old, to_new = np.where(left > 0, 0, far), np.full(m, far)
        from_new, from_old = np.full(n, -1), np.full(m, -1)
        while True:
            ways = to_old[:, None] + cost
            first = ways.argmin(0)
            shorter = ways[first, np.arange(m)] < to_new  # a way as long as the one known would make circles
            to_new[shorter], from_old[shorter] = ways[first, np.arange(m)][shorter], first[shorter]
            back = np.where(flow > 0, to_new[None, :] - cost, far)
            best = back.argmin(1)
            nearer = back[np.arange(n), best] < to_old
            if not nearer.any():
                break
            to_old[nearer], from_new[nearer] = back[np.arange(n), best][nearer], best[nearer]
        j = int(np.where(room > 0, to_new, far).argmin())
        path, at = [], j
        while True:
            i = int(from_old[at])
            path.append((i, at, 1))
            if from_new[i] < 0:
                break
            at = int(from_new[i])
            path.append((i, at, -1))
        amount = min(int(left[i]), int(room[j]), *(int(flow[a, b]) for a, b, way in path if way < 0))
        for a, b, way in path:
            flow[a, b] += way * amount
        left[i] -= amount
        room[j] -= amount
    return [(int(i), int(j), int(flow[i, j])) for i, j in np.argwhere(flow > 0)]


def equal_capacities(total: int, shards: int) -> list[int]:
    return [total // shards + (i < total % shards) for i in range(shards)]


def _with_slots(blocks: list[Block]) -> list[Block]:
    """blocks, each shard's slots counted up in their order."""
    at: dict[int, int] = {}
    out = []
    for b in blocks:
        out.append(replace(b, slot=at.get(b.shard, 0)))
        at[b.shard] = at.get(b.shard, 0) + b.n
    return out


def _store(spark: SparkSession, path: str, shards: int, blocks: list[Block], moved: int = 0) -> Layout:
    manifest = f"{path}/manifest-{uuid.uuid4().hex}"
    common.local_table(spark, [(b.path, b.shard, b.block, b.n, b.bytes, b.slot) for b in blocks], MANIFEST).coalesce(1).write.parquet(manifest)
    return Layout(shards, blocks, manifest, moved)


def load_layout(spark: SparkSession, manifest: str, shards: int) -> Layout:
    rows = spark.read.schema(MANIFEST).parquet(manifest).collect()  # bounded, see above
    return Layout(shards, sorted((Block(*r) for r in rows), key=lambda b: (b.shard, b.slot, b.block)), manifest)


def first_layout(docs: DataFrame, path: str, shards: int = OLD_SHARDS) -> Layout:
    """docs (doc_id, text) written to path as so many shards by hash."""
    spark = docs.sparkSession
    doc_id, text = common.col("doc_id").cast("long"), common.col("text").cast("string")
    rows = docs.select(doc_id.alias("doc_id"), text.alias("text"), (F.coalesce(F.octet_length(text), F.lit(0)) + OVERHEAD).cast("long").alias("size"), F.xxhash64(doc_id, text, F.lit(13)).alias("h"))
    part = F.shiftrightunsigned("h", 52)
    parts = rows.groupBy(part.alias("part")).agg(F.count("*").alias("n"), F.sum("size").alias("bytes")).collect()  # PARTS rows
    total, n = sum(r["bytes"] for r in parts), sum(r["n"] for r in parts)
    repeated = [r["part"] for r in parts if r["n"] > REPEATED * n / PARTS + FEW]
    blocks = min(max(total // (shards * BLOCK_BYTES), LEAST_BLOCKS), MOST_BLOCKS)
    dealt = F.when(part.isin(repeated), F.xxhash64("h", F.monotonically_increasing_id())).otherwise(F.col("h")) if repeated else F.col("h")
    chosen = F.pmod(F.shiftrightunsigned("dealt", 24), F.when(F.col("size") > total // (shards * LARGE), (blocks + 1) // 2).otherwise(blocks))
    placed = rows.withColumn("dealt", dealt).withColumns({"shard": F.pmod("dealt", F.lit(shards)).cast("int"), "block": chosen.cast("int")})
    order = Window.partitionBy("shard", "block").orderBy("h", "doc_id", "dealt")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.select("doc_id", "text", "size", (F.row_number().over(order) - 1).cast("long").alias("pos"), F.coalesce(F.sum("size").over(before), F.lit(0)).alias("at"), "shard", "block")
    own = f"{path}/blocks-{uuid.uuid4().hex}"
    placed.write.partitionBy("shard", "block").parquet(own)
    found = spark.read.schema(ROWS).parquet(own).groupBy("shard", "block").agg(F.count("*").alias("n"), F.sum("size").alias("bytes")).orderBy("shard", "block").collect()
    return _store(spark, path, shards, _with_slots([Block(own, *r) for r in found]))


def _cuts(layout: Layout, flow: list[tuple[int, int, int]]) -> list[tuple[Block, list[tuple[int, int, int]]]]:
    """Each block with the parts (low, high, new shard) that its bytes are cut into; low and high count from its start."""
    bounds: dict[int, tuple[list[int], list[int]]] = {}
    for old in range(layout.shards):
        own = sorted(((j, f) for i, j, f in flow if i == old), key=lambda t: (t[0] != old, t[0]))
        bounds[old] = [0, *accumulate(f for _, f in own)], [j for j, _ in own]
    out, at = [], [0] * layout.shards
    for b in layout.blocks:
        ends, new = bounds[b.shard]
        start, end = at[b.shard], at[b.shard] + b.bytes
        at[b.shard] = end
        parts = []
        for k in range(bisect_right(ends, start) - 1, len(new)):
            if ends[k] >= end:
                break
            parts.append((max(ends[k], start) - start, min(ends[k + 1], end) - start, new[k]))
        out.append((b, parts))
    return out


def _rows_of(spark: SparkSession, pieces: list[tuple], schema: str, blocks: list[Block]) -> DataFrame:
    """Rows of the blocks with the columns of pieces (path_no, shard, block, ...): each generation's files pruned to them."""
    paths = sorted({b.path for b in blocks})
    out = None
    for path in paths:
        own = [p[1:] for p in pieces if p[0] == path]
        side = common.local_table(spark, own, schema)
        rows = spark.read.schema(ROWS).parquet(path).join(F.broadcast(side), ["shard", "block"])  # at most a row for each cut of a block
        out = rows if out is None else out.unionByName(rows)
    return out


def reshard(layout: Layout, spark: SparkSession, path: str, shards: int = NEW_SHARDS, cost: np.ndarray | None = None) -> Layout:
    """The layout after the cheapest transfers to so many shards of equal capacity; what moves is written to path."""
    sizes = layout.sizes()
    flow = transfers(sizes, equal_capacities(sum(sizes), shards), cost)
    cuts = _cuts(layout, flow)
    whole = [(b, parts[0][2]) for b, parts in cuts if len(parts) == 1]
    cut = [(b, parts) for b, parts in cuts if len(parts) > 1]
    middle = F.col("at") + F.floor(F.col("size") / 2)
    inside = (F.col("low") <= middle) & (middle < F.col("high"))
    pieces = [(b, low, high, new) for b, parts in cut for low, high, new in parts]
    met: dict[tuple, tuple] = {}
    if cut:
        rows = _rows_of(spark, [(b.path, b.shard, b.block, low, high, new) for b, low, high, new in pieces], "shard int, block int, low long, high long, new int", [b for b, _ in cut])
        for r in rows.where(inside).groupBy("shard", "block", "new").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"), F.min("pos").alias("first"), F.min("at").alias("start")).collect():
            met[r["shard"], r["block"], r["new"]] = (r["n"], r["bytes"], r["first"], r["start"])

    own = f"{path}/blocks-{uuid.uuid4().hex}"
    kept = [b for b, new in whole if b.shard == new]
    taken = {(b.shard, b.block) for b in layout.blocks}
    following = {}
    for shard, block in taken:
        following[shard] = max(following.get(shard, 0), block + 1)
    moves, arrived = [], []

    def arrive(b: Block, new: int, low: int, high: int, n: int, size: int, first: int, start: int) -> None:
        block = following.get(new, 0)
        following[new] = block + 1
        arrived.append(Block(own, new, block, n, size))
        moves.append((b.path, b.shard, b.block, low, high, new, block, first, start))

    for b, low, high, new in sorted(pieces, key=lambda p: p[0].shard != p[3]):  # what stays in place comes first
        if (b.shard, b.block, new) in met:
            arrive(b, new, low, high, *met[b.shard, b.block, new])
    for b, new in whole:
        if b.shard != new:
            arrive(b, new, 0, b.bytes, b.n, b.bytes, 0, 0)
    if moves:
        rows = _rows_of(spark, moves, "shard int, block int, low long, high long, new int, new_block int, first long, start long", [b for b, _ in cuts])
        rows = rows.where(inside).select("doc_id", "text", "size", (F.col("pos") - F.col("first")).alias("pos"), (F.col("at") - F.col("start")).alias("at"), F.col("new").alias("shard"), F.col("new_block").alias("block"))
        rows.write.partitionBy("shard", "block").parquet(own)
    moved = sum(f for i, j, f in flow if i != j)
    blocks = sorted(kept + arrived, key=lambda b: b.shard)  # stable: kept ones first
    return _store(spark, path, shards, _with_slots(blocks), moved)


def read_layout(layout: Layout, spark: SparkSession) -> DataFrame:
    """doc_id, text, size, shard, slot of all rows."""
    if not layout.blocks:
        return common.local_table(spark, [], "doc_id long, text string, size long, shard int, slot long")
    pieces = [(b.path, b.shard, b.block, b.slot) for b in layout.blocks]
    rows = _rows_of(spark, pieces, "shard int, block int, first long", layout.blocks)
    return rows.select("doc_id", "text", "size", "shard", (F.col("first") + F.col("pos")).alias("slot"))


def op13_reshard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """32 shards by hash, resharded to 40 of equal bytes, read back from the files."""
    path = f"{common.scratch_dir(spark)}/shards-{uuid.uuid4().hex}"
    old = first_layout(spark.read.parquet(f"{sf_dir}/documents.parquet"), path)
    rows = read_layout(reshard(old, spark, path), spark)
    crc = F.crc32(F.coalesce("text", F.lit("")).cast("binary"))
    return rows.select("doc_id", "size", crc.alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
