"""Classifier evaluation, threshold and hyperparameter choice, attributions, representative examples."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom import config as C
from sparkloom.functions import text as T


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def metrics(scored: DataFrame, *keys: str) -> DataFrame:
    """tn, fp, fn, tp, precision, recall, f1, balanced_accuracy of (y, p, threshold) rows, by keys."""
    hit, y = F.col("p") >= F.col("threshold"), F.col("y") == 1
    m = scored.groupBy(*keys).agg(F.count_if(~y & ~hit).alias("tn"), F.count_if(~y & hit).alias("fp"), F.count_if(y & ~hit).alias("fn"), F.count_if(y & hit).alias("tp"))
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    sides = (tp + fn > 0).cast("int") + (tn + fp > 0).cast("int")
    return m.withColumns({
        "precision": _ratio(tp, tp + fp), "recall": _ratio(tp, tp + fn), "f1": _ratio(2 * tp, 2 * tp + fp + fn), "balanced_accuracy": _ratio(_ratio(tp, tp + fn) + _ratio(tn, tn + fp), sides),
    })


def threshold_search(scored: DataFrame) -> DataFrame:
    """metrics() at 0.30, 0.31 .. 0.70 in one job."""
    return metrics(scored.select("y", "p").withColumn("threshold", F.explode(F.transform(F.sequence(F.lit(30), F.lit(70)), lambda i: i / F.lit(100.0)))), "threshold")


def _best(results: DataFrame, *order: Column) -> DataFrame:
    top = results.agg((F.max("balanced_accuracy") - C.TIE).alias("_top"))
    return results.join(F.broadcast(top)).where("balanced_accuracy >= _top").drop("_top").orderBy(*order).limit(1)


def best_threshold(results: DataFrame) -> DataFrame:
    return _best(results, F.abs(F.col("threshold") - 0.5), F.col("threshold"))


def best_parameters(results: DataFrame) -> DataFrame:
    return _best(results, F.desc("balanced_accuracy"), F.col("max_depth"), F.col("n_estimators"), F.desc("min_child_weight"), F.col("learning_rate"))


def parameter_grid(spark) -> DataFrame:
    rows = [(f"model_{i:02d}", *x, 0.8, 1.0) for i, x in enumerate(product(*C.GRID.values()), 1)]
    return spark.createDataFrame(rows, "candidate_id string, max_depth int, learning_rate double, n_estimators int, min_child_weight int, subsample double, colsample_bytree double")


def outcome(y: Column, hit: Column) -> Column:
    return F.when(y & hit, "TP").when(~y & ~hit, "TN").when(~y & hit, "FP").otherwise("FN")


def availability(outcomes: DataFrame) -> DataFrame:
    types = outcomes.sparkSession.createDataFrame([("TP",), ("TN",), ("FP",), ("FN",)], "outcome_type string")
    n = F.coalesce("count", F.lit(0))
    return F.broadcast(types).join(outcomes.groupBy("outcome_type").count(), "outcome_type", "left").select("outcome_type", n.alias("count"), (n >= 4).alias("at_least_4"), (n >= 6).alias("at_least_6"))


def standardise(df: DataFrame, features: list[str]) -> DataFrame:
    """df with `z`: features by mean and population deviation of the train rows; a constant's scale is 1."""
    train = df.where(F.col("split") == "train").agg(*(x for f in features for x in (F.avg(f).alias(f"_m_{f}"), F.stddev_pop(f).alias(f"_s_{f}"))))
    scaled = [(F.col(f) - F.col(f"_m_{f}")) / F.when(F.col(f"_s_{f}") == 0, 1.0).otherwise(F.col(f"_s_{f}")) for f in features]
    return df.join(F.broadcast(train)).withColumn("z", F.array(*scaled)).drop(*(x for f in features for x in (f"_m_{f}", f"_s_{f}")))  # one row


def distance(a: str, b: str) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def nearest_medoid(rows: DataFrame, medoids: DataFrame) -> DataFrame:
    """email_id, medoid_id, distance within the class; ties to the least id. Medoids: at most 6 a class."""
    m = F.broadcast(medoids.select("predicted_label", F.col("email_id").alias("medoid_id"), F.col("z").alias("mz")))
    return rows.join(m, "predicted_label").withColumn("_d", distance("z", "mz")).groupBy("email_id").agg(F.min(F.struct(F.col("_d").alias("distance"), F.col("medoid_id"))).alias("x")).select("email_id", "x.medoid_id", "x.distance")


def shared_features(pairs: DataFrame, features: list[str], constant: tuple[str, ...] = ()) -> DataFrame:
    """email_id, rank, feature, value, example_value: the three nearest features of rows (email_id, raw, mraw, z, mz).

    constant: features without any spread in the training rows; these are shared only if both values are equal.
    """
    same = ~F.col("x.feature").isin(*constant) | (F.col("x.a") == F.col("x.b")) if constant else F.lit(True)
    item = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(f).alias("feature"), F.col("raw")[i].alias("a"), F.col("mraw")[i].alias("b"), F.abs(F.col("z")[i] - F.col("mz")[i]).alias("d")) for i, f in enumerate(features))))
    ok = (F.col("x.d") <= C.SHARED_DIFFERENCE) & ((F.col("x.feature") == C.RATIO_FEATURE) | ((F.col("x.a") > 0) & (F.col("x.b") > 0) & (F.abs(F.col("x.a") - F.col("x.b")) <= 1)))
    order = Window.partitionBy("email_id").orderBy("x.d", "x.i")
    return pairs.select("email_id", item.alias("x")).where(ok & same).withColumn("rank", F.row_number().over(order)).where("rank <= 3").select("email_id", "rank", "x.feature", F.col("x.a").alias("value"), F.col("x.b").alias("example_value"))


def constants(df: DataFrame, features: list[str]) -> tuple[str, ...]:
    """Features of one value only in the train rows."""
    one = df.where(F.col("split") == "train").agg(*(F.coalesce(F.min(f) == F.max(f), F.lit(True)).alias(f) for f in features)).first()
    return tuple(f for f in features if one[f])


def eligibility(rows: DataFrame) -> DataFrame:
    """rows (distance, t: the class's limit, example_text, count: shared features) with `reason`: the first rule broken."""
    blank = T.is_blank(F.coalesce("example_text", F.lit("")))
    reason = F.when(F.col("distance") > F.col("t"), "distance").when(blank, "blank_example").when(F.coalesce("count", F.lit(0)) < 2, "shared_features").otherwise("eligible")
    return rows.withColumn("reason", reason)


def eligibility_counters(rows: DataFrame) -> DataFrame:
    """One row: eligible, ineligible, each reason, and rule_violations: eligible rows that break a rule after all."""
    r, broken = F.col("reason"), (F.col("distance") > F.col("t")) | (F.coalesce("count", F.lit(0)) < 2)
    return rows.agg(
        F.count_if(r == "eligible").alias("eligible"), F.count_if(r != "eligible").alias("ineligible"), *(F.count_if(r == x).alias(x) for x in ("distance", "blank_example", "shared_features")),
        F.count_if((r == "eligible") & broken).alias("rule_violations"),
    )


def eligible_by_outcome(predictions: DataFrame, reasons: DataFrame) -> DataFrame:
    """outcome_type, rows, eligible of predictions (email_id, outcome_type) and reasons (email_id, reason)."""
    both = predictions.join(reasons.select("email_id", "reason"), "email_id")
    return both.groupBy("outcome_type").agg(F.count("*").alias("rows"), F.count_if(F.col("reason") == "eligible").alias("eligible"))


def largest_difference(a: DataFrame, b: DataFrame, value: str, key: str = "email_id") -> DataFrame:
    """One row: compared, unmatched (rows of one side only) and max_abs_difference of value between two frames."""
    left, right = (x.select(key, F.col(value).cast("double").alias(n), F.lit(1).alias(f"has_{n}")) for x, n in ((a, "x"), (b, "y")))
    both = left.join(right, key, "full")
    there = F.col("has_x").isNotNull() & F.col("has_y").isNotNull()
    return both.agg(F.count_if(there).alias("compared"), F.count_if(~there).alias("unmatched"), F.max(F.abs(F.col("x") - F.col("y"))).alias("max_abs_difference"))


def top_attributions(df: DataFrame, features: list[str], most: int = 3) -> DataFrame:
    """email_id, rank, feature, attribution, direction, text from arrays phi and raw: by size, ties by feature order."""
    item = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(f).alias("feature"), F.col("phi")[i].alias("phi"), F.col("raw")[i].alias("value")) for i, f in enumerate(features))))
    order = Window.partitionBy("email_id").orderBy(F.abs("x.phi").desc(), "x.i")
    names = F.create_map(*(F.lit(y) for f in features for y in (f, C.DISPLAY_NAMES.get(f, f))))
    towards = F.when(F.col("x.phi") > 0, C.TOWARDS[1]).when(F.col("x.phi") < 0, C.TOWARDS[-1]).otherwise("no effect")
    out = df.select("email_id", item.alias("x")).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)
    return out.select("email_id", "rank", "x.feature", "x.value", F.col("x.phi").alias("attribution"), towards.alias("direction"), F.concat(names[F.col("x.feature")], F.lit(": "), T.observed_text(F.col("x.feature"), F.col("x.value")), F.lit(" — "), towards).alias("text"))
