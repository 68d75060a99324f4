"""Benchmark decontamination by SimHash of item-sized windows, in DataFrame and SQL functions only.

Words are runs of letters and digits, lower-cased; shingles are five words, weighted by how often they occur.

1. Windows of an item's length are cut from each document. A window that matches holds so many of the item's shingles
   that only places with enough of them in reach can be one, and of the windows there one that starts with such a
   shingle (or, cut off by the document's start, ends with one) is the best: moving on to the next does not lose any. No
   other window is cut, and none that can match best is left out. Equal windows are judged once.
2. Each window and item gets a 128-bit SimHash of its weighted shingles. Fingerprints are cut into 8 blocks of 16 bits;
   two within Hamming distance RADIUS differ in at most 4 bits of one of the first four blocks or in at most 3 of one of
   the others, so items are indexed under every value so near and all fingerprints within the radius meet. Of unrelated
   fingerprints of one length a fifth meet and about one in four million is within the radius.
3. Candidates within the radius are verified by exact weighted Jaccard similarity of their shingles.

At a similarity of 0.8 the distance is about 19 bits, with a deviation of 4; RADIUS 35 leaves out about one in 10,000.

Step 1 looks up shingles before it fingerprints, as a fingerprint of every window of every text is some hundred times
the work (0.1 ms each) and gives no other candidates.

Defined results: null texts are empty; items or documents with fewer than five words have no shingle and match
nothing; repeated rows give a row each; a null doc_id is a document as any other; an empty benchmark marks nothing;
other columns are ignored.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm import common

SIMILARITY, RADIUS, BLOCKS, BITS = 0.8, 35, 8, 16
#: Rows of a side that may be broadcast (item shingles, windows): some 50 MB. More are joined by shuffle.
BROADCAST_ROWS = 1_000_000


def _shingles(df: DataFrame) -> DataFrame:
    """df with `sh`, the hashes of its shingles in order, in place of `text`."""
    words = F.transform(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), lambda w: F.xxhash64(w))
    five = lambda w, i: F.xxhash64(*(F.get(w, i + k) for k in range(5)))
    none = F.array().cast("array<bigint>")
    # an array of one, so that the words are a bound variable and not computed again for each shingle
    hashes = F.transform(F.array(words), lambda w: F.when(F.size(w) >= 5, F.transform(F.sequence(F.lit(0), F.size(w) - 5), lambda i: five(w, i))).otherwise(none))
    return df.withColumn("sh", F.get(hashes, F.lit(0))).drop("text")


def _simhash(shingles: str) -> Column:
    return F.expr(f"""
        aggregate(sequence(0, 63), 0L, (bits, b) -> bits | CASE WHEN
            aggregate({shingles}, 0, (sum, h) -> sum + 2 * CAST(shiftright(h, b) & 1 AS INT) - 1) > 0
        THEN shiftleft(1L, b) ELSE 0L END)""")


def _similarity(a: str, b: str) -> Column:
    """Weighted Jaccard of two arrays as multisets."""
    times = lambda x, array: f"size(filter({array}, y -> y = {x}))"
    shared = f"""CASE WHEN size(array_distinct({a})) = size({a}) OR size(array_distinct({b})) = size({b}) THEN size(array_intersect({a}, {b}))
        ELSE aggregate(array_intersect({a}, {b}), 0, (sum, x) -> sum + least({times("x", a)}, {times("x", b)})) END"""
    return F.expr(f"CAST({shared} AS DOUBLE) / (size({a}) + size({b}) - ({shared}))")


def _if_small(df: DataFrame) -> DataFrame:
    """df, marked for broadcasting if it is of few rows; only for rows of bounded width."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _tolerances(radius: int) -> list[int]:
    """Bits by which a block may differ: some block of two fingerprints within the radius differs by no more."""
    spare, rest = divmod(max(0, radius + 1 - BLOCKS), BLOCKS)
    return [spare + (i < rest) for i in range(BLOCKS)]


def _windows(docs: DataFrame, items: DataFrame, similarity: float) -> DataFrame:
    """doc_id, tie, start, n of the windows to judge: starts count shingles, negative ones lie before the text."""
    anchors = items.select("item_id", "n", F.explode("sh").alias("h")).distinct()
    places = _shingles(docs).select("doc_id", "tie", F.size("sh").alias("size"), F.posexplode("sh").alias("p", "h"))
    hits = places.join(_if_small(anchors), "h").groupBy("doc_id", "tie", "item_id").agg(F.first("n").alias("n"), F.first("size").alias("size"), F.array_sort(F.collect_set("p")).alias("ps"))
    # a matching window of n shingles shares `inner` with the item, a shorter one (at an end of the text) `least`
    least, inner = (F.ceil(F.col("n") * x - 1e-9).cast("int") for x in (similarity, 2 * similarity / (1 + similarity)))
    hits = hits.withColumns({"least": least, "inner": inner}).where("size(ps) >= least")
    p = lambda i: F.get("ps", i)
    index = F.sequence(F.lit(0), F.size("ps") - 1)
    need = lambda i: F.when(p(i) + F.col("n") <= F.col("size"), F.col("inner")).otherwise(F.col("least"))
    from_hit = F.transform(F.filter(index, lambda i: p(i + need(i) - 1) - p(i) < F.col("n")), p)
    to_hit = F.transform(F.filter(index, lambda i: (i + 1 >= F.col("least")) & (p(i) < F.col("n") - 1)), lambda i: p(i) - F.col("n") + 1)
    return hits.select("doc_id", "tie", "n", F.explode(F.concat(from_hit, to_hit)).alias("start")).distinct()


def matches(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """doc_id, tie (hash of the text), item_id, start (shingle), similarity of every verified window."""
    spark = docs.sparkSession
    again = F.transform("sh", lambda h: F.xxhash64(h))
    items = _shingles(benchmark.select(common.col("item_id").cast("long").alias("item_id"), common.text_of().alias("text"))).where("size(sh) > 0")
    # arrays are written before nested lambdas read them, which would compute them anew
    items = common.table(items.withColumns({"n": F.size("sh"), "sh2": again}), "items").withColumns({"a": _simhash("sh"), "b": _simhash("sh2")})
    items = common.table(items.drop("sh2"), "items")
    rows = docs.select(common.col("doc_id").cast("long").alias("doc_id"), common.text_of().alias("text")).withColumn("tie", F.xxhash64("text"))

    windows = common.table(_windows(rows, items, similarity), "anchored")
    keys = windows.select(F.col("doc_id").alias("d"), F.col("tie").alias("t")).distinct()
    hit_docs = rows.join(_if_small(keys), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("tie") == F.col("t")), "left_semi").dropDuplicates(["doc_id", "tie"])
    # a document's windows are fewer than its shingles times the lengths of items it holds shingles of
    grouped = windows.groupBy(F.col("doc_id").alias("d"), F.col("tie").alias("t")).agg(F.collect_list(F.struct("start", "n")).alias("ws"))
    cut = _shingles(hit_docs).join(grouped, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("tie") == F.col("t"))).select("doc_id", "tie", "sh", F.explode("ws").alias("w"))
    part = F.slice("sh", F.greatest(F.col("w.start"), F.lit(0)) + 1, F.col("w.n") + F.least(F.col("w.start"), F.lit(0)))
    placed = cut.select("doc_id", "tie", "w.start", "w.n", part.alias("part")).withColumns({"k1": F.xxhash64("part"), "k2": F.xxhash64("part", F.lit(1))})
    placed = common.table(placed, "windows")
    once = placed.groupBy("n", "k1", "k2").agg(F.first("part").alias("sh")).withColumn("sh2", again)
    prints = common.table(common.table(once, "distinct-windows").select("n", "k1", "k2", F.col("sh").alias("part"), _simhash("sh").alias("a"), _simhash("sh2").alias("b")), "prints")

    tolerances = _tolerances(radius)
    near_values = {t: [sum(1 << i for i in bits) for n in range(t + 1) for bits in combinations(range(BITS), n)] for t in set(tolerances)}
    masks = common.local_table(spark, [(t, m) for t, values in near_values.items() for m in values], "tolerance int, mask long")
    blocks = F.explode(F.array(*(F.struct(F.lit(i).alias("block"), F.lit(t).alias("tolerance")) for i, t in enumerate(tolerances)))).alias("x")
    half = BLOCKS // 2
    value = lambda a, b: F.expr(f"shiftrightunsigned(CASE WHEN block < {half} THEN {a} ELSE {b} END, {BITS} * (block % {half})) & {(1 << BITS) - 1}")
    posted = items.select("item_id", "n", F.col("a").alias("ia"), F.col("b").alias("ib"), blocks).select("item_id", "n", "ia", "ib", "x.*").join(F.broadcast(masks), "tolerance")
    posted = posted.withColumn("value", value("ia", "ib").bitwiseXOR(F.col("mask"))).select("item_id", "n", "ia", "ib", "block", "value")
    asked = prints.select("n", "k1", "k2", "a", "b", blocks).select("n", "k1", "k2", "a", "b", "x.block").withColumn("value", value("a", "b"))
    # a pair that meets in several blocks is taken in the first of them
    bits = lambda i: f"bit_count(shiftrightunsigned({'a ^ ia' if i < half else 'b ^ ib'}, {BITS} * {i % half}) & {(1 << BITS) - 1})"
    first = "CASE " + " ".join(f"WHEN {bits(i)} <= {t} THEN {i}" for i, t in enumerate(tolerances)) + " END"
    near = asked.join(posted, ["n", "block", "value"]).where(F.expr(f"bit_count(a ^ ia) + bit_count(b ^ ib) <= {radius} AND block = {first}")).select("n", "k1", "k2", "item_id")
    near = near.join(prints.select("n", "k1", "k2", "part"), ["n", "k1", "k2"]).join(items.select("item_id", F.col("sh").alias("item_sh")), "item_id")
    found = near.withColumn("similarity", _similarity("part", "item_sh")).where(F.col("similarity") >= similarity).select("n", "k1", "k2", "item_id", "similarity")
    found = common.table(found, "verified")
    return placed.select("doc_id", "tie", "start", "n", "k1", "k2").join(_if_small(found), ["n", "k1", "k2"]).select("doc_id", "tie", "item_id", "start", "similarity")


def contamination(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """doc_id, contaminated, n_items, items (ids, comma-joined), similarity (the largest; 0 if none) of every row of docs."""
    found = matches(docs, benchmark, similarity, radius).groupBy("doc_id", "tie").agg(F.collect_set("item_id").alias("items"), F.max("similarity").alias("most"))
    found = common.table(found, "matches").withColumnsRenamed({"doc_id": "d", "tie": "t"})
    rows = docs.select(common.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(common.text_of()).alias("tie"))
    out = rows.join(found, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("tie") == F.col("t")), "left")
    ids = F.array_join(F.transform(F.array_sort("items"), lambda x: x.cast("string")), ",")
    return out.select("doc_id", F.col("items").isNotNull().alias("contaminated"), F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"), F.coalesce(ids, F.lit("")).alias("items"), F.coalesce("most", F.lit(0.0)).alias("similarity"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs (doc_id, text) without those that hold a passage of the benchmark.

    Null and short texts stay; of equal rows all go or all stay; an empty benchmark or table changes nothing; other
    columns, whatever their names, pass through.
    """
    return common.without(docs, common.table(matches(docs, benchmark).select("doc_id", "tie").distinct(), "leaks"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
