"""Command line: python -m sparkloom.cli COMMAND CONFIG. Faults go to stderr and end with status 1, as failed diagnostics do.

CONFIG is a YAML mapping: `columns` and `labels` of the raw CSV, `raw`, `out` (a folder), and if wanted `expected_rows`,
`frozen_splits` (split: CSV of ids), `grid` (lists of parameters), `threshold` (of a frozen model, to be met exactly),
`ks_threshold` (of diagnose), `severe_coverage` (of leakage) and `repeat` (false: preprocess is not run a second time to
compare, which doubles its cost).
"""

from __future__ import annotations

import argparse
import json
import sys
from itertools import product

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from sparkloom import config as C
from sparkloom.operators import evaluate as E
from sparkloom.operators import model as M
from sparkloom.operators import similarity as J
from sparkloom.operators import stats as A
from sparkloom.operators import tables as O
from sparkloom.operators import training as R
from sparkloom.plans import catalog, reports
from sparkloom.sources import files
from sparkloom.sources.scratch import release, scratch
from sparkloom.streaming.features import with_features

FEATURES = list(C.FEATURES)
SCHEMA = "email_id string, sanitized_subject string, sanitized_body string, label int, split string, " + ", ".join(f"{f} {'double' if f == C.RATIO_FEATURE else 'long'}" for f in FEATURES)


def _processed(spark, config):
    return spark.read.schema(SCHEMA).parquet(f"{config['out']}/processed")


def preprocess(spark, config) -> bool:
    raw = files.read_raw_csv(spark, config["raw"], config["columns"], {str(k): v for k, v in config["labels"].items()}, config.get("expected_rows"))
    rows = scratch(O.canonical(raw, F.col("row"), F.col("subject"), F.col("body"), F.col("label"), config.get("prefix", "email")), "canonical")
    frozen = files.read_frozen_splits(spark, config.get("frozen_splits", {}), rows)
    run: dict[str, int] = {}
    out = catalog.preprocessed(rows, frozen, run)
    files.write_table(out, f"{config['out']}/processed")
    done = _processed(spark, config)
    if config.get("repeat", True):
        _check_repeat(done, catalog.preprocessed(rows, frozen))
    files.write_text(f"{config['out']}/preprocessing_summary.md", reports.preprocessing_summary(done, {name: run[key] for key, name in reports.COUNTS.items()}), spark)
    for s in C.SPLITS:
        files.write_csv(done.where(F.col("split") == s).select("email_id"), f"{config['out']}/splits/{s}_ids.csv", "email_id")
    return True


def _check_repeat(done, again) -> None:
    """A second run must give the same ids, splits and features."""
    kept = ["email_id", "split", *FEATURES]
    changed = O.difference(done.select(kept), again.select(kept)).limit(files.FIRST_FAULTS).collect()
    if changed:
        raise C.ContractError(f"a second run differs: {', '.join(sorted({r['email_id'] for r in changed}))}")


def _recomputed(rows):
    """Stored features against those computed anew from the sanitised texts."""
    again = with_features(rows.select("email_id", "sanitized_subject", "sanitized_body")).select("email_id", *(F.col(f).alias(f"_{f}") for f in FEATURES))
    return A.recompute(rows.join(again, "email_id"), {f: (f, f"_{f}") for f in FEATURES})


def diagnose(spark, config) -> bool:
    rows, limit = _processed(spark, config), float(config.get("ks_threshold", C.KS_THRESHOLD))
    described, recomputed = scratch(A.distributions(rows, FEATURES, "split", "label"), "distributions"), scratch(_recomputed(rows), "recomputed")
    tables = (
        ("Stored against recomputed", recomputed), ("Distribution", described.orderBy("scope", "key", "feature")), ("Distance between splits", A.ks(rows, FEATURES).orderBy("feature", "split_pair")),
        ("Pearson", A.pearson(rows, FEATURES)), ("Spearman", A.spearman(rows, FEATURES, "email_id")),
    )
    for title, df in tables:
        print(reports.text_table(title, df))
    for r in described.where((F.col("scope") == "all") & (F.col("mode_ratio") >= C.NEAR_CONSTANT)).orderBy("feature").collect():
        print(f"warning: {r['feature']} is nearly constant ({r['mode_ratio']:.4f} of the rows have one value)")
    verdict = A.full_verdict(rows, FEATURES, recomputed, limit)
    print(reports.text_table("Verdict", verdict))
    passed = bool(verdict.first()["passed"])
    print(reports.verdict_line("features", passed))
    return passed


def leakage(spark, config) -> bool:
    rows = scratch(_processed(spark, config).select("email_id", "label", "split", F.concat_ws("\n", "sanitized_subject", "sanitized_body").alias("text"), F.monotonically_increasing_id().alias("nr")), "rows")
    pairs = scratch(J.similar_pairs(scratch(J.tfidf(J.term_blocks(rows)), "tfidf"), rows, key="nr"), "pairs")
    print(reports.text_table("Thresholds", J.thresholds(pairs, rows).orderBy("threshold")))
    print(reports.text_table("Most similar pairs", J.ordered_pairs(pairs).limit(20)))
    severe = bool(J.leakage(pairs, rows, float(config.get("severe_coverage", C.SEVERE_COVERAGE))).first()["severe"])
    print(reports.verdict_line("template leakage", not severe))
    return not severe


def train(spark, config) -> bool:
    rows, out = _processed(spark, config), config["out"]
    grid = None
    if "grid" in config:
        values = product(*(config["grid"][k] for k in C.GRID))
        grid = spark.createDataFrame([(f"model_{i:02d}", *x, 0.8, 1.0) for i, x in enumerate(values, 1)], E.parameter_grid(spark).schema)
    model, best, results, thresholds = R.train(rows, FEATURES, grid)
    threshold = best.pop("threshold")
    R.save(model, f"{out}/model", FEATURES, best, threshold)
    again, _ = R.load(spark, f"{out}/model", FEATURES)
    R.check_reload(R.reload_difference(model, again, rows.where("split = 'validation'"), FEATURES, threshold))
    files.write_csv(R.result_table(results, thresholds, best, threshold), f"{out}/validation_results.csv", F.desc(F.col("stage") == "hyperparameter_search"), "candidate_id")
    files.write_csv(R.predictions(again, rows.where("split = 'test'"), FEATURES, threshold), f"{out}/test_predictions.csv", "email_id")
    metrics = {r["split"]: {k: v for k, v in r.asDict().items() if k != "split"} for r in R.final_evaluation(again, rows, FEATURES, threshold).collect()}
    by_split = {r["split"]: r["count"] for r in rows.groupBy("split").count().collect()}
    documents = {"model_metrics.json": R.metrics_document(metrics, results.count(), by_split, files.sha256_of(f"{out}/processed", spark)), "frozen_model_config.json": R.frozen_document(FEATURES, best, threshold)}
    for name, document in documents.items():
        files.write_text(f"{out}/{name}", json.dumps(document, indent=2) + "\n", spark)
    return True


def _model(spark, config):
    model, frozen = R.load(spark, f"{config['out']}/model", FEATURES)
    return model, C.check_frozen_model(frozen, config.get("threshold"))["threshold"]


def explain(spark, config) -> bool:
    model, threshold = _model(spark, config)
    test = _processed(spark, config).where("split = 'test'")
    stored = files.read_processed_csv(spark, f"{config['out']}/test_predictions.csv", "email_id string, true_label int, probability double, predicted_label int, outcome_type string")
    checks = R.attribution_checks(model, M.attributions(model, test, FEATURES), test, FEATURES, stored)
    print(reports.text_table("Checks", checks))
    if checks.where("not passed").count():
        raise C.ContractError("attributions do not add up to the stored predictions")
    files.write_table(files.json_documents(R.attribution_documents(model, test, FEATURES, threshold)), f"{config['out']}/attributions", "text")
    return True


def examples(spark, config) -> bool:
    model, threshold = _model(spark, config)
    judged, shared = R.example_rows(model, _processed(spark, config), FEATURES, threshold)
    counters = E.eligibility_counters(judged)
    print(reports.text_table("Eligibility", counters))
    if counters.first()["rule_violations"]:
        raise C.ContractError("examples are shown that break a rule")
    files.write_table(files.json_documents(R.example_documents(judged, shared, FEATURES)), f"{config['out']}/examples", "text")
    return True


COMMANDS = {f.__name__: f for f in (preprocess, diagnose, leakage, train, explain, examples)}


def main(arguments: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="sparkloom", description=__doc__.split(". ")[0])
    parser.add_argument("command", choices=COMMANDS)
    parser.add_argument("config")
    asked = parser.parse_args(arguments)
    spark = SparkSession.builder.getOrCreate()
    try:
        return 0 if COMMANDS[asked.command](spark, files.load_yaml(asked.config)) else 1
    except (C.ContractError, C.KeywordConfigError, OSError, KeyError, ValueError) as fault:
        print(f"{asked.command}: {fault}", file=sys.stderr)
        return 1
    finally:
        release(spark)  # results are files by now


if __name__ == "__main__":
    sys.exit(main())
