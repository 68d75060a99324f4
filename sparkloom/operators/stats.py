"""Distributions, correlations, drift and validity of features."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkloom import config as C
from sparkloom.sources.scratch import scratch


def melt(df: DataFrame, features: list[str], *keys: str) -> DataFrame:
    pairs = F.array(*(F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value")) for f in features))
    return df.select(*keys, F.explode(pairs).alias("_p")).select(*keys, "_p.feature", "_p.value")


def cumulative(freq: DataFrame, keys: list[str], counts: list[str]) -> DataFrame:
    """freq (keys, value, counts) with `_upto_<count>`: the sum over values up to this one, by keys.

    Two levels: ranges of values, then inside a range; so a feature with very many values is not one task.
    """
    ranged = scratch(freq.repartitionByRange(*keys, "value").withColumn("_part", F.spark_partition_id()), "ranges")
    sums = ranged.groupBy(*keys, "_part").agg(*(F.sum(c).alias(f"_all_{c}") for c in counts))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select(*keys, "_part", *(F.coalesce(F.sum(f"_all_{c}").over(before), F.lit(0)).alias(f"_base_{c}") for c in counts))
    inside = Window.partitionBy(*keys, "_part").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    inner = ranged.withColumns({f"_in_{c}": F.sum(c).over(inside) for c in counts})
    # a row for each range, that is for each shuffle partition
    return inner.join(F.broadcast(base), [*keys, "_part"]).select(*freq.columns, *((F.col(f"_base_{c}") + F.col(f"_in_{c}")).alias(f"_upto_{c}") for c in counts))


def distribution(df: DataFrame, features: list[str], *keys: str) -> DataFrame:
    """min, max, mean, median, std, nonzero, distinct values (null counts as one) and mode ratio by feature and keys.

    Values are counted first, so a hot value is one row; medians are looked up by position in cumulative counts, and
    deviations are taken from the mean, so that large values do not cancel.
    """
    by = [*keys, "feature"]
    return _described(scratch(melt(df, features, *keys).groupBy(*by, "value").agg(F.count("*").alias("n")), "frequencies"), by)


def distributions(df: DataFrame, features: list[str], *scopes: str) -> DataFrame:
    """distribution() of all rows and by each scope (a column) in one frame: scope, key (its value as text; null: all rows).

    Rows are read once and counted by all scopes together; the scopes are summed from these counts.
    """
    freq = melt(df, features, *scopes).groupBy(*scopes, "feature", "value").agg(F.count("*").alias("n"))
    item = lambda scope, key: F.struct(F.lit(scope).alias("scope"), key.alias("key"))
    asked = F.explode(F.array(item("all", F.lit(None).cast("string")), *(item(c, F.col(c).cast("string")) for c in scopes)))
    summed = freq.withColumn("_s", asked).groupBy("_s.scope", "_s.key", "feature", "value").agg(F.sum("n").alias("n")).withColumn("key", F.coalesce("key", F.lit("")))
    out = _described(scratch(summed, "frequencies"), ["scope", "key", "feature"])
    return out.withColumn("key", F.nullif("key", F.lit("")))


def _described(freq: DataFrame, by: list[str]) -> DataFrame:
    """The columns of distribution() by `by`, which ends with the feature, from counts of values (by, value, n)."""
    v, n, there = F.col("value"), F.col("n"), F.col("value").isNotNull()
    nonzero = F.sum(F.when(F.coalesce(v, F.lit(1.0)) != 0, n).otherwise(0))
    one = freq.groupBy(*by).agg(
        F.min(v).alias("min"), F.max(v).alias("max"), (F.sum(v * n) / F.sum(F.when(there, n))).alias("mean"), F.coalesce(F.sum(F.when(there, n)), F.lit(0)).alias("_n"), nonzero.alias("nonzero_count"),
        (nonzero / F.sum(n)).alias("nonzero_ratio"), F.count("*").alias("unique_count"), (F.max(n) / F.sum(n)).alias("mode_ratio"),
    )
    few = F.broadcast(one.select(*by, "mean", "_n"))  # a row for each feature and key
    upto, low, high = F.col("_upto_n"), F.floor((F.col("_n") + 1) / 2), F.floor(F.col("_n") / 2) + 1
    holds = lambda at: F.max(F.when((upto >= at) & (upto - n < at), v))
    placed = cumulative(freq.where(there), by, ["n"]).join(few, by)
    middle = placed.groupBy(*by).agg(((holds(low) + holds(high)) / 2).alias("median"), F.sum(n * (v - F.col("mean")) * (v - F.col("mean"))).alias("_q"))
    std = F.when(F.col("_n") > 1, F.sqrt(F.col("_q") / (F.col("_n") - 1)))
    return one.join(F.broadcast(middle), by, "left").select(*by, "min", "max", "mean", "median", std.alias("std"), "nonzero_count", "nonzero_ratio", "unique_count", "mode_ratio")


def _corr(a: str, b: str):
    varied = (F.stddev_pop(a) > 0) & (F.stddev_pop(b) > 0)
    return F.when(varied, F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b)))


def pearson(df: DataFrame, features: list[str]) -> DataFrame:
    """left, right, r of each two features in one pass; null where one is constant."""
    d = df.select(*(F.col(f).cast("double").alias(f) for f in features))
    one = d.agg(*(_corr(a, b).alias(f"{i}") for i, (a, b) in enumerate(combinations(features, 2))))
    rows = F.array(*(F.struct(F.lit(a).alias("left"), F.lit(b).alias("right"), F.col(f"`{i}`").alias("r")) for i, (a, b) in enumerate(combinations(features, 2))))
    return one.select(F.explode(rows).alias("x")).select("x.*")


def average_ranks(df: DataFrame, features: list[str], key: str) -> DataFrame:
    """key and the average rank of each feature: ranks of distinct values, not of rows."""
    freq = melt(df, features).groupBy("feature", "value").agg(F.count("*").alias("n"))
    rank = cumulative(freq, ["feature"], ["n"]).select("feature", "value", (F.col("_upto_n") - (F.col("n") - 1) / 2.0).alias("rank"))
    return melt(df, features, key).join(rank, ["feature", "value"]).groupBy(key).pivot("feature", features).agg(F.first("rank"))


def spearman(df: DataFrame, features: list[str], key: str) -> DataFrame:
    return pearson(average_ranks(df, features, key), features)


def ks(df: DataFrame, features: list[str], split: str = "split") -> DataFrame:
    """feature, split_pair, ks_distance over each two splits, from counts of distinct values."""
    freq = melt(df, features, split).groupBy("feature", "value").pivot(split, list(C.SPLITS)).count().fillna(0, list(C.SPLITS))
    freq = scratch(freq, "frequencies")
    sizes = F.broadcast(freq.groupBy("feature").agg(*(F.sum(s).alias(f"_size_{s}") for s in C.SPLITS)))  # a row for each feature
    cdf = cumulative(freq, ["feature"], list(C.SPLITS)).join(sizes, "feature").select("feature", *(F.try_divide(F.col(f"_upto_{s}").cast("double"), F.col(f"_size_{s}")).alias(s) for s in C.SPLITS))
    pairs = F.array(*(F.struct(F.lit(f"{a} vs {b}").alias("split_pair"), F.abs(F.col(a) - F.col(b)).alias("d")) for a, b in combinations(C.SPLITS, 2)))
    return cdf.select("feature", F.explode(pairs).alias("x")).groupBy("feature", "x.split_pair").agg(F.max("x.d").alias("ks_distance"))


def recompute(df: DataFrame, stored_and_computed: dict[str, tuple[str, str]]) -> DataFrame:
    """feature, mismatches, non_finite: stored against computed columns, within 1e-12."""
    rows = []
    one = {}
    for f, (a, b) in stored_and_computed.items():
        x, y = F.col(a).cast("double"), F.col(b).cast("double")
        one[f"{f}_m"] = F.count_if(F.coalesce(F.abs(x - y) > C.TIE, F.lit(True)))
        one[f"{f}_f"] = F.count_if(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
        rows.append(F.struct(F.lit(f).alias("feature"), F.col(f"{f}_m").alias("mismatches"), F.col(f"{f}_f").alias("non_finite")))
    return df.agg(*(v.alias(k) for k, v in one.items())).select(F.explode(F.array(*rows)).alias("x")).select("x.*")


def verdict(df: DataFrame, features: list[str], ks_threshold: float = C.KS_THRESHOLD) -> DataFrame:
    """One row: constant, nearly constant and drifting features, and whether all is valid."""
    d = distribution(df, features).agg(F.count_if(F.col("unique_count") <= 1).alias("constant"), F.count_if(F.col("mode_ratio") >= C.NEAR_CONSTANT).alias("near_constant"))
    k = ks(df, features).agg(F.count_if(F.col("ks_distance") >= ks_threshold).alias("anomalies"))
    return d.join(k, how="cross").withColumn("passed", (F.col("constant") == 0) & (F.col("anomalies") == 0))  # one row each


def full_verdict(df: DataFrame, features: list[str], recomputed: DataFrame, ks_threshold: float = C.KS_THRESHOLD) -> DataFrame:
    """verdict() that also counts cells that are not finite and rows whose stored feature is not the one computed anew."""
    r = recomputed.agg(F.sum("non_finite").alias("non_finite"), F.sum("mismatches").alias("mismatches"))
    both = verdict(df, features, ks_threshold).join(r, how="cross")  # one row each
    return both.withColumn("passed", F.col("passed") & (F.col("non_finite") == 0) & (F.col("mismatches") == 0))
