"""Training as a program: grid search, threshold, final evaluation, saved models and the documents that explain them."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom import config as C
from sparkloom.functions import text as T
from sparkloom.operators import evaluate as E
from sparkloom.operators import medoids as P
from sparkloom.operators import model as M
from sparkloom.operators import tables as O
from sparkloom.operators.boosting import Forest, Parameters, fit_all
from sparkloom.sources.files import check_document, read_text, write_text
from sparkloom.sources.scratch import scratch

PARAMETERS = ("max_depth", "learning_rate", "n_estimators", "min_child_weight", "subsample", "colsample_bytree")
# fixed values: how the search is described in its results, and their columns
OBJECTIVE, EVAL_METRIC, SEARCH_THRESHOLD = "binary:logistic", "logloss", 0.5
RESULT_COLUMNS = (
    "stage", "candidate_id", *PARAMETERS, "objective", "eval_metric", "threshold", "precision", "recall", "f1", "balanced_accuracy", "tn", "fp", "fn", "tp", "selected_hyperparameters", "selected_threshold",
)


def check_training(rows: DataFrame, features: list[str]) -> None:
    """Raises ContractError unless rows have all columns, both labels in each split, single ids and finite features."""
    missing = sorted({"email_id", "label", "split", *features} - set(rows.columns))
    if missing or len(set(features)) != len(features):
        raise C.ContractError(f"columns are missing: {missing}" if missing else "a feature is named twice")
    broken = [f"{r['check']} ({r['n_violations']})" for r in O.output_contract(rows, tuple(features)).where("not passed").collect()]
    if broken:
        raise C.ContractError(f"the training data break: {', '.join(broken)}")


def grid_forests(rows: DataFrame, features: list[str], grid: DataFrame) -> dict[str, Forest]:
    """candidate_id -> forest. Candidates that differ in the number of trees alone are stages of one fit, and all fits are
    grown side by side in the same jobs."""
    candidates = {r["candidate_id"]: Parameters(**{k: r[k] for k in PARAMETERS}) for r in grid.collect()}  # the grid, not data
    longest: dict[tuple, Parameters] = {}
    kind = lambda p: (p.max_depth, p.learning_rate, p.min_child_weight, p.subsample, p.colsample_bytree)
    for p in candidates.values():
        if kind(p) not in longest or longest[kind(p)].n_estimators < p.n_estimators:
            longest[kind(p)] = p
    fitted = dict(zip(longest, fit_all(rows.where(F.col("split") == "train"), features, list(longest.values())), strict=True))
    return {name: fitted[kind(p)].first(p.n_estimators) for name, p in candidates.items()}


def grid_metrics(forests: dict[str, Forest], rows: DataFrame, grid: DataFrame) -> DataFrame:
    """The grid with metrics at SEARCH_THRESHOLD on the validation rows, in one job."""
    scored = M.staged_margins(forests, rows.where(F.col("split") == "validation"), "label")
    scored = scored.select(F.col("name").alias("candidate_id"), F.col("label").alias("y"), M.probability(F.col("margin")).alias("p"), F.lit(SEARCH_THRESHOLD).alias("threshold"))
    return grid.join(E.metrics(scored, "candidate_id"), "candidate_id")


def grid_search(rows: DataFrame, features: list[str], grid: DataFrame | None = None) -> DataFrame:
    """The grid with metrics at 0.5 on the validation rows of models fitted on the train rows (email_id, label, split)."""
    grid = grid or E.parameter_grid(rows.sparkSession)
    return grid_metrics(grid_forests(rows, features, grid), rows, grid)


def train(rows: DataFrame, features: list[str], grid: DataFrame | None = None) -> tuple[Forest, dict, DataFrame, DataFrame]:
    """(model, parameters with threshold, grid results, threshold results): the best candidate and its threshold."""
    check_training(rows, features)
    grid = grid or E.parameter_grid(rows.sparkSession)
    forests = grid_forests(rows, features, grid)
    results = scratch(grid_metrics(forests, rows, grid), "grid")
    chosen = E.best_parameters(results).first()
    model = forests[chosen["candidate_id"]]
    validation = M.score(model, rows.where(F.col("split") == "validation"), features).select(F.col("label").alias("y"), "p")
    thresholds = scratch(E.threshold_search(validation), "thresholds")
    return model, {k: chosen[k] for k in PARAMETERS} | {"threshold": E.best_threshold(thresholds).first()["threshold"]}, results, thresholds


def result_table(results: DataFrame, thresholds: DataFrame, parameters: dict, threshold: float) -> DataFrame:
    """RESULT_COLUMNS of both stages of the search, in order: a row for each candidate and one for each threshold."""
    same = reduce(lambda a, b: a & b, (F.col(k) == F.lit(parameters[k]) for k in PARAMETERS))
    a = results.withColumns({"stage": F.lit("hyperparameter_search"), "threshold": F.lit(SEARCH_THRESHOLD), "selected_hyperparameters": same, "selected_threshold": F.lit(False), "_stage": F.lit(0)})
    name = F.format_string("threshold_%.2f", "threshold")
    b = thresholds.withColumns({k: F.lit(parameters[k]) for k in PARAMETERS}).withColumns({
        "stage": F.lit("threshold_search"), "candidate_id": name, "selected_hyperparameters": F.lit(True), "selected_threshold": F.abs(F.col("threshold") - threshold) < C.TIE, "_stage": F.lit(1),
    })
    both = [x.withColumns({"objective": F.lit(OBJECTIVE), "eval_metric": F.lit(EVAL_METRIC)}).select(*RESULT_COLUMNS, "_stage") for x in (a, b)]
    return both[0].unionByName(both[1]).orderBy("_stage", "candidate_id").drop("_stage")


def frozen_document(features: list[str], parameters: dict, threshold: float) -> dict:
    described = {k: parameters[k] for k in PARAMETERS if k in parameters} | {"objective": OBJECTIVE, "eval_metric": EVAL_METRIC}
    return {"feature_order": list(features), "label_definition": {str(k): v for k, v in C.CLASS_NAMES.items()}, "hyperparameters": described, "classification_threshold": threshold, "random_seed": C.SEED}


def metrics_document(metrics: dict[str, dict], candidates: int, rows: dict[str, int], input_sha256: str) -> dict:
    """What the search chose by, and how the model does: metrics by split, rows of each outcome, rows by split."""
    test = metrics["test"]
    outcomes = {t: {"count": test[t.lower()], "at_least_4": test[t.lower()] >= 4, "at_least_6": test[t.lower()] >= 6} for t in ("TP", "TN", "FP", "FN")}
    return {
        "selection": {
            "metric": "validation_balanced_accuracy", "search_threshold": SEARCH_THRESHOLD, "candidates": candidates, "ties": ["lower max_depth", "lower n_estimators", "higher min_child_weight", "lower learning_rate"],
            "thresholds": {"first": 0.3, "last": 0.7, "step": 0.01, "ties": "closest to 0.50, then lower threshold"},
        },
        **{split: metrics[split] for split in ("validation", "test")},
        "test_outcome_availability": {"by_outcome_type": outcomes, **{f"all_types_at_least_{n}": all(o[f"at_least_{n}"] for o in outcomes.values()) for n in (4, 6)}},
        "row_counts": rows, "input_sha256": input_sha256,
    }


def predictions(model: Forest, rows: DataFrame, features: list[str], threshold: float) -> DataFrame:
    """email_id, true_label, probability, predicted_label, outcome_type, ordered by id."""
    scored = M.score(model, rows, features, threshold)
    out = scored.select("email_id", F.col("label").alias("true_label"), F.col("p").alias("probability"), "predicted_label", E.outcome(F.col("label") == 1, F.col("p") >= threshold).alias("outcome_type"))
    return out.orderBy("email_id")


def final_evaluation(model: Forest, rows: DataFrame, features: list[str], threshold: float) -> DataFrame:
    """Metrics of the validation and test rows at the threshold."""
    scored = M.score(model, rows.where(F.col("split").isin("validation", "test")), features)
    return E.metrics(scored.select("split", F.col("label").alias("y"), "p", F.lit(float(threshold)).alias("threshold")), "split")


def save(model: Forest, path: str, features: list[str], parameters: dict, threshold: float) -> None:
    """The model in path/trees.json and its configuration in path/frozen.json."""
    spark = SparkSession.active()
    write_text(f"{path}/trees.json", model.to_json(), spark)
    frozen = {"features": list(features), "labels": {str(k): v for k, v in C.CLASS_NAMES.items()}, "threshold": threshold, "seed": C.SEED, "parameters": parameters}
    write_text(f"{path}/frozen.json", json.dumps(frozen, indent=2) + "\n", spark)


def load(spark: SparkSession, path: str, features: list[str]) -> tuple[Forest, dict]:
    """The model and its configuration; an error if it was fitted on other features or in another order."""
    frozen = json.loads(read_text(f"{path}/frozen.json", spark))
    model = Forest.from_json(read_text(f"{path}/trees.json", spark))
    for fitted in (frozen["features"], model.features):
        if fitted != list(features):
            raise C.ContractError(f"the model's features are {fitted}")
    return model, frozen


def reload_difference(model: Forest, again: Forest, rows: DataFrame, features: list[str], threshold: float) -> DataFrame:
    """One row: compared, unmatched, max_abs_difference of probabilities, changed_labels of two models."""
    a, b = (scratch(predictions(m, rows, features, threshold), "predictions") for m in (model, again))
    changed = a.join(b.select("email_id", F.col("predicted_label").alias("other")), "email_id").agg(F.count_if(F.col("predicted_label") != F.col("other")).alias("changed_labels"))
    return E.largest_difference(a, b, "probability").join(changed, how="cross")  # one row each


def check_reload(difference: DataFrame) -> None:
    d = difference.first()
    if d["unmatched"] or d["changed_labels"] or (d["max_abs_difference"] or 0.0) > C.RELOAD_TOLERANCE:
        raise C.ContractError(f"the reloaded model predicts otherwise: {d.asDict()}")


def attribution_checks(model: Forest, attributions: DataFrame, rows: DataFrame, features: list[str], stored: DataFrame) -> DataFrame:
    """check, compared, max_abs_difference, passed: base and attributions sum to the margin, and probabilities are the stored ones."""
    scored = M.score(model, rows, features).select("email_id", "margin", "p")
    total = attributions.select("email_id", (F.col("base") + F.aggregate("phi", F.lit(0.0), lambda s, x: s + x)).alias("margin"))
    checks = (
        ("additivity", E.largest_difference(scored, total, "margin"), C.ADDITIVITY_TOLERANCE),
        ("logistic", E.largest_difference(scored, total.select("email_id", M.probability(F.col("margin")).alias("p")), "p"), C.ADDITIVITY_TOLERANCE),
        ("probability", E.largest_difference(scored, stored.select("email_id", F.col("probability").alias("p")), "p"), C.PROBABILITY_TOLERANCE),
    )
    frames = [d.select(F.lit(name).alias("check"), "compared", "max_abs_difference", ((F.col("unmatched") == 0) & (F.coalesce("max_abs_difference", F.lit(0.0)) <= limit)).alias("passed")) for name, d, limit in checks]
    return reduce(DataFrame.unionByName, frames)


def _class_name(c):
    return F.when(c == 1, C.CLASS_NAMES[1]).otherwise(C.CLASS_NAMES[0])


def attribution_documents(model: Forest, rows: DataFrame, features: list[str], threshold: float, most: int = 3) -> DataFrame:
    """email_id, ai_prediction, features (rank, feature_key, display_name, observed_value, direction, display_text)."""
    scored = M.score(model, rows, features, threshold).select("email_id", "predicted_label", F.array(*(F.col(f).cast("double") for f in features)).alias("raw"))
    phi = M.attributions(model, rows, features)
    top = E.top_attributions(phi.join(scored, "email_id"), features, most)
    names = F.create_map(*(F.lit(x) for f in features for x in (f, C.DISPLAY_NAMES.get(f, f))))
    item = F.struct("rank", F.col("feature").alias("feature_key"), names[F.col("feature")].alias("display_name"), F.col("value").alias("observed_value"), "direction", F.col("text").alias("display_text"))
    documents = top.groupBy("email_id").agg(F.array_sort(F.collect_list(item)).alias("features"))  # `most` items
    out = documents.join(scored.select("email_id", _class_name(F.col("predicted_label")).alias("ai_prediction")), "email_id").select("email_id", "ai_prediction", "features")
    check_document(out.schema)
    return out.orderBy("email_id")


def example_rows(model: Forest, rows: DataFrame, features: list[str], threshold: float) -> tuple[DataFrame, DataFrame]:
    """(judged, shared) of the test rows: each with its class's nearest medoid and whether that is fit to be shown.

    Classes are those the model predicts; distances are between standardised features. rows: email_id, sanitized_subject,
    sanitized_body, split, features.
    """
    scored = scratch(E.standardise(M.score(model, rows, features, threshold), features), "standardised")
    train = scored.where(F.col("split") == "train")
    medoids = scratch(P.class_medoids(train).select("email_id").join(scored, "email_id"), "medoids")  # at most 6 a class
    near = scratch(E.nearest_medoid(scored, medoids), "nearest")
    limit = train.join(near, "email_id").groupBy("predicted_label").agg(F.percentile("distance", C.DISTANCE_PERCENTILE).alias("t"))
    raw = F.array(*(F.col(f).cast("double") for f in features))
    example = medoids.select(F.col("email_id").alias("medoid_id"), raw.alias("mraw"), F.col("z").alias("mz"), F.col("sanitized_subject").alias("example_subject"), F.col("sanitized_body").alias("example_body"))
    pairs = scored.where(F.col("split") == "test").select("email_id", "label", "predicted_label", raw.alias("raw"), "z").join(near, "email_id").join(F.broadcast(example), "medoid_id")
    shared = scratch(E.shared_features(pairs, features, E.constants(scored, features)), "shared")
    counted = pairs.join(F.broadcast(limit), "predicted_label").join(shared.groupBy("email_id").count(), "email_id", "left")
    return E.eligibility(counted.withColumn("example_text", F.concat_ws("\n", "example_subject", "example_body"))), shared


def example_documents(judged: DataFrame, shared: DataFrame, features: list[str]) -> DataFrame:
    """email_id, ai_prediction, eligible, representative_example (null unless eligible), shared_features, display_intro."""
    names = F.create_map(*(F.lit(x) for f in features for x in (f, C.DISPLAY_NAMES.get(f, f))))
    text = lambda c: T.observed_text(F.col("feature"), F.col(c).cast("double"))
    shown = F.concat(names[F.col("feature")], F.lit(": this email "), text("value"), F.lit(", example "), text("example_value"))
    item = F.struct("rank", F.col("feature").alias("feature_key"), names[F.col("feature")].alias("display_name"), F.col("value").alias("current_value"), "example_value", shown.alias("display_text"))
    items = shared.groupBy("email_id").agg(F.array_sort(F.collect_list(item)).alias("shared_features"))  # three at most
    ok, name = F.col("reason") == "eligible", _class_name(F.col("predicted_label"))
    example = F.when(ok, F.struct(F.col("medoid_id").alias("email_id"), name.alias("ai_prediction"), F.col("example_subject").alias("subject"), F.col("example_body").alias("body")))
    both = judged.join(items, "email_id", "left")
    none = F.array().cast(items.schema["shared_features"].dataType)
    out = both.select(
        "email_id", name.alias("ai_prediction"), ok.alias("eligible"), example.alias("representative_example"), F.when(ok, F.col("shared_features")).otherwise(none).alias("shared_features"),
        F.when(ok, F.concat(F.lit("A typical email that was also classified as "), name)).alias("display_intro"),
    )
    check_document(out.schema)
    return out.orderBy("email_id")
