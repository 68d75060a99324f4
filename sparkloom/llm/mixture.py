"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks.

Each source's documents, in an order shuffled by a hash, form one stream of words cut into blocks of BLOCK words. Slot i
of the schedule takes the point frac(i * golden ratio) through the cumulative target shares to a source; the slots of a
source are ranked, and its k-th slot takes its k-th block (the stream starts again after its last word, at most once,
as targets stop at twice the size). A source's last block is cut at its target. Any prefix of the schedule holds the
sources in their proportions to within a few blocks.

Ranks and stream positions are prefix sums in two levels (per hash bucket or run of slots, then inside), so a source
with a third of all rows is spread over 4096 buckets. One row per source goes through the driver.

Defined results: a null text has size 0; a null source is a source of its own, last in order; a document of size 0 is
never taken; repeated rows are documents of their own; an empty table, or one without words, gives an empty schedule;
other columns are ignored. Reruns give the same rows: the order depends on ids and texts only.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkloom.llm import common

WEIGHTS, SHARE, MOST, BLOCK = (3, 1, 2), 1.5, 2, 1024
BUCKETS, RUN, CELLS = 4096, 1 << 16, 4096
GOLDEN = (math.sqrt(5) - 1) / 2


def targets(sizes: list[int], weights: list[float], share: float = SHARE, most: float = MOST) -> list[float]:
    """share * sum(sizes) by weight; what exceeds most * size is shared again among the others."""
    out, open_ = [0.0] * len(sizes), set(range(len(sizes)))
    left = share * sum(sizes)
    while open_:
        weight = sum(weights[i] for i in open_)
        above = [i for i in open_ if left * weights[i] / weight > most * sizes[i]]
        if not above:
            for i in open_:
                out[i] = left * weights[i] / weight
            break
        for i in above:
            out[i] = float(most * sizes[i])
            open_.remove(i)
        left -= sum(out[i] for i in above)
    return out


def _point(i: Column) -> Column:
    high, low = F.shiftright(i, 20).cast("double"), i.bitwiseAND((1 << 20) - 1).cast("double")
    return F.pmod(high * F.lit(math.fmod(GOLDEN * (1 << 20), 1.0)) + low * F.lit(GOLDEN), F.lit(1.0))


def _slots(spark: SparkSession, quotas: list[int], n: int) -> DataFrame:
    """i, source_no of slots 0 .. n - 1."""
    total, bounds, at = sum(quotas), [], 0
    for no, q in enumerate(quotas):
        if q:
            low, high = at / total, (at + q) / total
            bounds += [(cell, low, high, no) for cell in range(int(low * CELLS), min(CELLS - 1, int(high * CELLS)) + 1)]
            at += q
    cells = common.local_table(spark, bounds, "cell int, low double, high double, source_no int")
    slots = spark.range(n).select(F.col("id").alias("i"), _point(F.col("id") + 1).alias("u")).withColumn("cell", F.floor(F.col("u") * CELLS).cast("int"))
    return slots.join(F.broadcast(cells), "cell").where("u >= low and u < high").select("i", "source_no")  # a row per source and cell


def _prefix(df: DataFrame, keys: list[str], part: str, order: list[str], value: Column) -> DataFrame:
    """df with `at`: the sum of value over the rows before in (part, order), by keys, in two levels."""
    totals = df.groupBy(*keys, part).agg(F.sum(value).alias("_n"))
    before = Window.partitionBy(*keys).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select(*keys, part, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy(*keys, part).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("_in", F.coalesce(F.sum(value).over(inside), F.lit(0))).join(base, [*keys, part]).withColumn("at", F.col("_base") + F.col("_in")).drop("_base", "_in")


def schedule(spark: SparkSession, quotas: list[int], block: int = BLOCK) -> DataFrame:
    """slot, source_no, k: the k-th slot of each source, as many as its quota of words needs."""
    need = [-(-q // block) for q in quotas]
    if not sum(need):
        return common.local_table(spark, [], "slot long, source_no int, k long")
    n = sum(need)
    while True:
        slots = _slots(spark, quotas, n)
        found = {r["source_no"]: r["count"] for r in slots.groupBy("source_no").count().collect()}
        if all(found.get(no, 0) >= k for no, k in enumerate(need)):
            break
        n += n // 8 + 16
    ranked = _prefix(slots.withColumn("run", F.floor(F.col("i") / RUN)), ["source_no"], "run", ["i"], F.lit(1).cast("long"))
    needed = common.local_table(spark, list(enumerate(need)), "source_no int, need long")
    return ranked.join(needed, "source_no").where("at < need").select(F.col("i").alias("slot"), "source_no", F.col("at").alias("k"))


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: int = MOST, block: int = BLOCK, uid_column: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows, pieces). rows: uid, doc_id, source_no, size, source_size, target of every row of docs (doc_id, text, source).
    pieces: the mix, as slot, uid, pass, first_word, n_words. uid_column: one of docs that tells its rows apart, if any."""
    spark = docs.sparkSession
    uid = common.col(uid_column) if uid_column else F.monotonically_increasing_id()
    text = common.text_of()
    rows = common.table(
        docs.select(
            uid.alias("uid"), common.col("doc_id").cast("long").alias("doc_id"), common.col("source").cast("string").alias("source"), F.regexp_count(text, F.lit(common.WORD)).cast("long").alias("size"),
            F.xxhash64(common.col("doc_id").cast("long"), text, F.lit(9)).alias("h"),
        ),
        "mix-rows",
    )
    sums = sorted(((r["source"], r["n"]) for r in rows.groupBy("source").agg(F.sum("size").alias("n")).collect()), key=lambda x: (x[0] is None, x[0] or ""))
    sizes = [n for _, n in sums]
    aims = targets(sizes, [weights[i % len(weights)] for i in range(len(sums))], share, most)
    quotas = [min(round(t), most * n) for t, n in zip(aims, sizes, strict=True)]
    sources = common.local_table(spark, [(s, i, n, t, q) for i, ((s, n), t, q) in enumerate(zip(sums, aims, quotas, strict=True))], "s string, source_no int, source_size long, target double, quota long")
    rows = rows.join(sources, F.col("source").eqNullSafe(F.col("s"))).drop("s", "source")
    bucket = F.shiftrightunsigned("h", 64 - int(math.log2(BUCKETS))).cast("int")
    placed = _prefix(rows.where("size > 0").withColumn("bucket", bucket), ["source_no"], "bucket", ["h", "doc_id", "uid"], F.col("size"))
    passes = placed.withColumn("pass", F.explode(F.sequence(F.lit(0), F.lit(most - 1)))).withColumn("at", F.col("at") + F.col("pass") * F.col("source_size")).where("at < quota")
    end = F.col("at") + F.col("size")
    cut = passes.select("uid", "source_no", "pass", "at", end.alias("end"), "quota", F.explode(F.sequence(F.floor(F.col("at") / block), F.floor((end - 1) / block))).alias("k"))
    first = F.greatest(F.col("at"), F.col("k") * block)
    n_words = F.least(F.col("end"), (F.col("k") + 1) * block, F.col("quota")) - first
    pieces = cut.join(schedule(spark, quotas, block), ["source_no", "k"]).select("slot", "uid", "pass", (first - F.col("at")).alias("first_word"), n_words.alias("n_words")).where("n_words > 0")
    return rows, pieces


def mix_documents(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, source) as the mix takes them: a row for each pass in which at least half of the document's
    words are taken.

    A document without words goes; equal rows are documents of their own; a null source is a source; an empty table
    stays empty; other columns, whatever their names, pass through.
    """
    uid, other, n = common.free(docs, "row_uid", "mix_uid", "mix_copies")
    held = common.table(docs.withColumn(uid, F.monotonically_increasing_id()), "mix-docs")
    rows, pieces = mix(held, uid_column=uid)
    taken = pieces.groupBy("uid", "pass").agg(F.sum("n_words").alias("n")).join(rows.select("uid", "size"), "uid").where("2 * n >= size")
    copies = taken.groupBy("uid").agg(F.count("*").cast("int").alias(n)).withColumnRenamed("uid", other)
    out = held.join(copies, F.col(uid) == F.col(other))
    return out.select(*(common.col(c) for c in docs.columns), F.explode(F.sequence(F.lit(1), F.col(n))).alias(uid)).drop(uid)


def op9_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, pieces = mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    taken = pieces.groupBy("uid").agg(F.sum("n_words").alias("taken"))
    return rows.join(taken, "uid", "left").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"))
