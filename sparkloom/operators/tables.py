"""Ingest, dedup, splits and contracts: DataFrame in, DataFrame out; errors are rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom import config as C
from sparkloom.functions import text as T


def canonical(df: DataFrame, row: Column, subject: Column, body: Column, label: Column, prefix: str = "doc") -> DataFrame:
    """original_row_number, raw_subject, raw_body, label, email_id."""
    out = df.select(row.cast("long").alias("original_row_number"), F.coalesce(subject, F.lit("")).alias("raw_subject"), F.coalesce(body, F.lit("")).alias("raw_body"), label.cast("int").alias("label"))
    return out.withColumn("email_id", T.stable_id(prefix, F.col("original_row_number"), F.col("raw_subject"), F.col("raw_body"), F.col("label")))


def sanitise(df: DataFrame) -> DataFrame:
    """Native white-space form; functions.sanitise has the full one."""
    return df.withColumns({"sanitized_subject": T.whitespace(F.col("raw_subject")), "sanitized_body": T.whitespace(F.col("raw_body"))})


def blank(df: DataFrame) -> Column:
    return T.is_blank(F.col("sanitized_subject")) & T.is_blank(F.col("sanitized_body"))


def keyed(df: DataFrame) -> DataFrame:
    """dedup_key as a digest, so that a shuffle moves 32 bytes and not the texts."""
    return df.withColumn("dedup_key", F.sha2(T.dedup_key(F.col("sanitized_subject"), F.col("sanitized_body")), 256))


def key_groups(df: DataFrame) -> DataFrame:
    """dedup_key, first (row number), n, n_labels (2 if labels differ; null labels are none)."""
    groups = df.groupBy("dedup_key").agg(F.min("original_row_number").alias("first"), F.count("*").alias("n"), F.min("label").alias("low"), F.max("label").alias("high"))
    return groups.select("dedup_key", "first", "n", F.when(F.col("low").isNull(), 0).when(F.col("low") == F.col("high"), 1).otherwise(2).cast("long").alias("n_labels"))


def keep_first(df: DataFrame, groups: DataFrame | None = None, *more: str) -> DataFrame:
    """The first row of each key by row number, with the columns of its group asked for; of rows that repeat the number, the
    one of the least email_id. A hot key's rows are aggregated before they meet."""
    first = (key_groups(df) if groups is None else groups).select(F.col("dedup_key").alias("_key"), F.col("first").alias("_first"), *more)
    kept = df.join(first, (F.col("original_row_number") == F.col("_first")) & (F.col("dedup_key") == F.col("_key")))
    place = F.row_number().over(Window.partitionBy("original_row_number", "dedup_key").orderBy("email_id"))
    return kept.withColumn("_place", place).where("_place = 1").select(*df.columns, *more)


def group_metrics() -> list[Column]:
    """Aggregates of key_groups: what dedup_stats returns, and what a write of them can observe."""
    many = F.col("n") > 1
    return [
        F.coalesce(F.sum(many.cast("long")), F.lit(0)).alias("duplicate_groups"), F.coalesce(F.sum(F.when(many, F.col("n")).otherwise(0)), F.lit(0)).alias("duplicate_records"),
        F.coalesce(F.sum(F.when(many, F.col("n") - 1).otherwise(0)), F.lit(0)).alias("removed"), F.coalesce(F.sum((F.col("n_labels") > 1).cast("long")), F.lit(0)).alias("conflicting_groups"),
    ]


def dedup_stats(df: DataFrame) -> DataFrame:
    return key_groups(df).agg(*group_metrics())


def conflicts(df: DataFrame, most: int = 20) -> list[str]:
    """email_id:label of the first rows whose key has rows of other labels."""
    keys = key_groups(df).where("n_labels > 1").select("dedup_key")
    return [f"{r['email_id']}:{r['label']}" for r in df.join(keys, "dedup_key", "left_semi").orderBy("original_row_number").limit(most).collect()]


def quotas(totals: DataFrame, ratios: dict[str, float] = C.RATIOS) -> DataFrame:
    """Largest remainder: label, split, idx, quota from (label, total)."""
    shares = F.array(*(F.struct(F.lit(s).alias("split"), F.lit(i).alias("idx"), F.lit(float(r)).alias("ratio")) for i, (s, r) in enumerate(ratios.items())))
    exact = totals.withColumn("s", F.explode(shares)).select("label", "total", "s.split", "s.idx", (F.col("total").cast("double") * F.col("s.ratio")).alias("exact"))
    by_label, order = Window.partitionBy("label"), Window.partitionBy("label").orderBy(F.desc("frac"), "idx")
    cut = exact.withColumn("floor", F.floor("exact")).withColumn("frac", F.col("exact") - F.col("floor"))
    left = F.col("total") - F.sum("floor").over(by_label)
    return cut.withColumn("left", left).withColumn("rank", F.row_number().over(order)).select("label", "split", "idx", (F.col("floor") + (F.col("rank") <= F.col("left")).cast("long")).alias("quota"))


def stratified_split(df: DataFrame, ratios: dict[str, float] = C.RATIOS, seed: int = C.SEED) -> DataFrame:
    """df (email_id, label, ...) with `split`: per label, in hash order, cut by quota.

    Positions come in two levels, per leading hex digits and inside, so a label with most rows is not one task. Rows
    without a label are a class of their own.
    """
    hashed = df.select("email_id", "label", T.hash_order(seed, F.col("email_id")).alias("h")).withColumn("part", F.substring("h", 1, 3))
    sizes = hashed.groupBy("label", "part").count()
    before = Window.partitionBy("label").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = sizes.select("label", "part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    base = base.select(F.col("label").alias("_label"), F.col("part").alias("_part"), "base")
    inside = hashed.withColumn("in", F.row_number().over(Window.partitionBy("label", "part").orderBy("h", "email_id")))
    place = inside.join(base, F.col("label").eqNullSafe(F.col("_label")) & (F.col("part") == F.col("_part"))).select("email_id", "label", (F.col("base") + F.col("in")).alias("pos"))
    q = quotas(df.groupBy("label").agg(F.count("*").alias("total")), ratios)
    upto = Window.partitionBy("label").orderBy("idx")
    ranges = q.withColumn("high", F.sum("quota").over(upto)).withColumn("low", F.col("high") - F.col("quota")).select(F.col("label").alias("_label"), "split", "low", "high")
    found = place.join(F.broadcast(ranges), F.col("label").eqNullSafe(F.col("_label")) & (F.col("pos") > F.col("low")) & (F.col("pos") <= F.col("high")))  # labels x splits
    return df.join(found.select("email_id", "split"), "email_id")


def assigned(df: DataFrame, mapping: DataFrame) -> DataFrame:
    """df with the split of its email_id; a row that has none raises an error when it is read."""
    split = F.when(F.col("split").isNotNull(), F.col("split")).otherwise(F.raise_error(F.concat(F.lit("no split for "), F.col("email_id"))))
    return df.join(mapping.select("email_id", "split"), "email_id", "left").withColumn("split", split)


def frozen_audit(known: DataFrame, frozen: DataFrame) -> DataFrame:
    """One row: repeated, overlapping, unknown, retained and missing ids of a frozen split (email_id, split)."""
    per_id = frozen.groupBy("email_id").agg(F.count("*").alias("n"), F.countDistinct("split").alias("s"))
    a = per_id.agg(F.count_if(F.col("n") > 1).alias("repeated"), F.count_if(F.col("s") > 1).alias("overlapping"))
    b = per_id.join(known.select("email_id"), "email_id", "left_anti").agg(F.count("*").alias("unknown"))
    c = known.join(per_id, "email_id", "left_semi").agg(F.count("*").alias("retained"))
    d = known.join(per_id, "email_id", "left_anti").agg(F.count("*").alias("missing"))
    return reduce(lambda x, y: x.join(y, how="cross"), [a, b, c, d])  # one row each


def whole_shares(total: int, ratios: dict[str, float]) -> dict[str, int]:
    """total in whole parts by ratio: floors, and one more for the largest fractions, the earlier split first."""
    exact = {s: total * r for s, r in ratios.items()}
    out = {s: int(x) for s, x in exact.items()}
    by_fraction = sorted(ratios, key=lambda s: out[s] - exact[s])  # stable: ties stay in order
    for s in by_fraction[: total - sum(out.values())]:
        out[s] += 1
    return out


class Deficits:
    """How many rows each split still lacks, in all and by label, while rows are given out."""

    def __init__(self, totals: dict[int, int], present: dict[tuple[str, int], int], ratios: dict[str, float]) -> None:
        self.splits = list(ratios)
        self.total = whole_shares(sum(totals.values()), ratios)
        self.label = {y: whole_shares(n, ratios) for y, n in totals.items()}
        for (split, y), n in present.items():
            self._take(split, y, n)

    def _take(self, split: str, y: int, n: int = 1) -> None:
        self.total[split] -= n
        self.label[y][split] -= n

    def give(self, y: int) -> str:
        """The split that lacks most rows of this label, then most rows at all, then the first."""
        lack = [(self.label[y][s], self.total[s]) for s in self.splits]
        split = self.splits[lack.index(max(lack))]
        self._take(split, y)
        return split


def extend_split(rows: DataFrame, frozen: DataFrame, ratios: dict[str, float] = C.RATIOS, seed: int = C.SEED) -> DataFrame:
    """email_id, split of rows (email_id, label) that have none in frozen (email_id, split), given out in hash order.

    Each choice depends on the one before. So the rows are sorted over all tasks and then pass one task, which holds
    nothing but counters; only these go through the driver.
    """
    known = frozen.select("email_id", "split")
    rows = rows.select("email_id", "label")
    totals = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    present = {(r["split"], r["label"]): r["count"] for r in rows.join(known, "email_id").groupBy("split", "label").count().collect()}
    missing = rows.join(known, "email_id", "left_anti")
    ordered = missing.orderBy(T.hash_order(seed, F.col("email_id")), "email_id").coalesce(1)

    def run(frames):
        lack = Deficits(totals, present, ratios)
        for f in frames:
            yield f.assign(split=[lack.give(y) for y in f.label])[["email_id", "split"]]

    return ordered.mapInPandas(run, "email_id string, split string")


#: Checks of output_contract that rest on the labels given, not on the chain.
LABEL_CHECKS = ("label_domain", "both_labels_in_each_split")


def output_contract(df: DataFrame, features: tuple[str, ...]) -> DataFrame:
    """check, n_violations, passed: one pass over the rows and one over ids."""
    bad = lambda c: F.col(c).isNull() | F.isnan(F.col(c).cast("double")) | (F.abs(F.col(c).cast("double")) == float("inf"))
    counts = [f for f in features if f != C.RATIO_FEATURE]
    both = reduce(lambda a, b: a + b, (F.coalesce((F.countDistinct(F.when(F.col("split") == s, F.col("label"))) != 2).cast("long"), F.lit(1)) for s in C.SPLITS))
    one = df.agg(
        F.count_if(~F.col("label").isin(0, 1) | F.col("label").isNull()).alias("label_domain"), F.count_if(reduce(lambda a, b: a | b, map(bad, features))).alias("finite"),
        F.count_if((F.col(C.RATIO_FEATURE) < 0) | (F.col(C.RATIO_FEATURE) > 1)).alias("ratio_range") if C.RATIO_FEATURE in features else F.lit(0).cast("long").alias("ratio_range"),
        F.count_if(reduce(lambda a, b: a | b, [F.col(c) < 0 for c in counts])).alias("counts_not_negative"), (F.count("*") - F.countDistinct("email_id")).alias("unique_id"),
        F.count_if(~F.col("split").isin(*C.SPLITS) | F.col("split").isNull()).alias("split_domain"), both.alias("both_labels_in_each_split"),
    )
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("check"), F.col(c).cast("long").alias("n_violations")) for c in one.columns)))
    return one.select(pairs.alias("x")).select("x.check", "x.n_violations", (F.col("x.n_violations") == 0).alias("passed"))


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows in one frame and not in the other, with the side; empty if both are equal."""
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))
