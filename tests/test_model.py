"""Boosted trees and their attributions against exhaustive search and plain formulas; the queries that use them."""

from itertools import combinations
from math import factorial

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom import config as C
from sparkloom.operators import boosting as B
from sparkloom.operators import model as M
from sparkloom.operators import training as R

SF = "/root/testdata/sf0.001"


def random_tree(rng, m, depth):
    tree = B.Tree()

    def grow(node, cover, left):
        tree.cover[node] = cover
        if left and rng.random() < 0.85:
            tree.split(node, int(rng.integers(m)), 0, float(rng.normal()))
            share = rng.uniform(0.05, 0.95)
            grow(tree.left[node], cover * share, left - 1)
            grow(tree.right[node], cover * (1 - share), left - 1)
        else:
            tree.value[node] = float(rng.normal())

    grow(0, 100.0, depth)
    return tree


def expected(tree, row, known, node=0):
    """A tree's output where unknown features follow both branches by cover."""
    f, a, b = tree.feature[node], tree.left[node], tree.right[node]
    if f < 0:
        return tree.value[node]
    if f in known:
        return expected(tree, row, known, b if row[f] >= tree.cut[node] else a)
    return (tree.cover[a] * expected(tree, row, known, a) + tree.cover[b] * expected(tree, row, known, b)) / (tree.cover[a] + tree.cover[b])


def shapley(trees, row, m):
    """By all sets of known features."""
    value = {s: sum(expected(t, row, set(s)) for t in trees) for n in range(m + 1) for s in combinations(range(m), n)}
    out = np.zeros(m)
    for s, v in value.items():
        for i in set(range(m)) - set(s):
            out[i] += factorial(len(s)) * factorial(m - len(s) - 1) / factorial(m) * (value[tuple(sorted((*s, i)))] - v)
    return out


@pytest.mark.parametrize(("m", "depth"), [(1, 2), (3, 5), (6, 4), (10, 6)])
def test_attributions_are_shapley_values(m, depth):
    rng = np.random.default_rng(m)
    forest = B.Forest([f"f{i}" for i in range(m)], B.Parameters(), [random_tree(rng, m, depth) for _ in range(2 if m == 10 else 4)])
    x = rng.normal(size=(3, m))
    got = forest.attributions(x)
    assert np.abs(got - np.stack([shapley(forest.trees, row, m) for row in x])).max() < 1e-9
    assert np.abs(forest.base() + got.sum(1) - forest.margins(x)).max() < 1e-9


def test_attributions_over_forty_features(spark):
    rng = np.random.default_rng(1)
    forest = B.Forest([f"f{i}" for i in range(40)], B.Parameters(), [random_tree(rng, 40, 8) for _ in range(30)])
    x = rng.normal(size=(500, 40))
    rows = spark.createDataFrame([(f"r{i}", *map(float, v)) for i, v in enumerate(x)], ["email_id", *forest.features])
    got = {r["email_id"]: r["base"] + sum(r["phi"]) for r in M.attributions(forest, rows, forest.features).collect()}
    assert max(abs(got[f"r{i}"] - v) for i, v in enumerate(forest.margins(x))) < 1e-9


def exhaustive(x, g, h, p, depth, values=None):
    """A tree by trying every cut of every feature: (feature, cut, left, right) or the leaf's value, with covers."""
    score = lambda a, b: a * a / (b + p.reg_lambda)
    values, best = values or [np.unique(c)[1:] for c in x.T], (B.LEAST_GAIN, None, None)
    if depth:
        for f in range(x.shape[1]):
            for cut in values[f]:
                left = x[:, f] < cut
                if min(h[left].sum(), h[~left].sum()) >= p.min_child_weight - 1e-9:
                    gain = score(g[left].sum(), h[left].sum()) + score(g[~left].sum(), h[~left].sum()) - score(g.sum(), h.sum())
                    if gain > best[0] + 1e-9:
                        best = (gain, f, cut)
    if best[1] is None:
        return (h.sum(), -p.learning_rate * g.sum() / (h.sum() + p.reg_lambda))
    left = x[:, best[1]] < best[2]
    return (h.sum(), best[1], best[2], *(exhaustive(x[s], g[s], h[s], p, depth - 1, values) for s in (left, ~left)))


def nested(tree, node=0):
    if tree.feature[node] < 0:
        return (tree.cover[node], tree.value[node])
    return (tree.cover[node], tree.feature[node], tree.cut[node], nested(tree, tree.left[node]), nested(tree, tree.right[node]))


def flat(t):
    return [t] if not isinstance(t, tuple) else [y for x in t for y in flat(x)]


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(7)
    x = np.stack([rng.integers(0, 6, 400), rng.normal(size=400).round(1), rng.poisson(0.3, 400)], 1).astype(float)
    y = (x[:, 0] + 2 * x[:, 1] * x[:, 2] + rng.normal(size=400) > 2.5).astype(int)
    rows = spark.createDataFrame([(f"r{i}", int(y[i]), ("train", "train", "train", "validation")[i % 4], *map(float, v)) for i, v in enumerate(x)], "email_id string, label int, split string, a double, b double, c double")
    return rows.repartition(5), x, y


@pytest.mark.parametrize("task_rows", [B.TASK_ROWS, 90])
def test_trees_are_those_of_exhaustive_search(table, monkeypatch, task_rows):
    """By one task and by jobs over five."""
    monkeypatch.setattr(B, "TASK_ROWS", task_rows)
    rows, x, y = table
    for p in (B.Parameters(4, 0.3, 3, 1.0, 1.0), B.Parameters(3, 0.1, 2, 7.5, 1.0, reg_lambda=0.2)):
        forest, margin = M.fit(rows, ["a", "b", "c"], **vars(p)), np.zeros(len(x))
        assert len(forest.trees) == p.n_estimators
        for tree in forest.trees:
            prob = 1 / (1 + np.exp(-margin))
            want = exhaustive(x, prob - y, prob * (1 - prob), p, p.max_depth)
            assert np.allclose(flat(nested(tree)), flat(want), atol=1e-9)
            assert all(tree.cover[i] >= p.min_child_weight - 1e-9 for i in range(1, len(tree.cover)))
            margin += tree.margins(x)
        assert np.abs(forest.margins(x) - margin).max() < 1e-12


def test_row_and_feature_share(spark, table):
    """A tree is grown on the drawn rows and features alone, whatever the partitions."""
    rows, x, y = table
    p = B.Parameters(3, 0.3, 1, 1.0, 0.5, 0.67)
    keys = np.array([r[0] for r in spark.createDataFrame([(f"r{i}",) for i in range(400)], "email_id string").select(F.xxhash64("email_id")).collect()])
    used, columns = B.drawn(keys, p.seed, 0, p.subsample), B.drawn_features(3, p.seed, 0, p.colsample_bytree)
    assert 150 < used.sum() < 250 and len(columns) == 2
    tree = M.fit(rows, ["a", "b", "c"], **vars(p)).trees[0]
    want = exhaustive(x[used][:, columns], 0.5 - y[used], np.full(used.sum(), 0.25), p, 3)
    got = nested(tree)
    assert got == nested(M.fit(rows.repartition(2), ["a", "b", "c"], **vars(p)).trees[0])
    assert [columns.index(f) for f in (got[1], got[3][1], got[4][1]) if isinstance(f, int)] == [f for f in (want[1], want[3][1], want[4][1]) if isinstance(f, int)] and abs(got[0] - want[0]) < 1e-9
    many = [B.drawn(keys, 42, t, 0.8).mean() for t in range(50)]
    assert abs(np.mean(many) - 0.8) < 0.01 and np.std(many) > 0


def test_candidates_side_by_side_and_stages(spark, table, monkeypatch):
    """Twelve trees by stages and side by side are those of separate fits, also over a write of the margins."""
    monkeypatch.setattr(B, "TREES_KEPT", 3)
    monkeypatch.setattr(B, "TASK_ROWS", 100)
    rows, x, _ = table
    grid = spark.createDataFrame([("m1", 2, 0.1, 4, 1, 0.8, 1.0), ("m2", 2, 0.1, 8, 1, 0.8, 1.0), ("m3", 3, 0.3, 5, 4, 0.8, 1.0)], "candidate_id string, max_depth int, learning_rate double, n_estimators int, min_child_weight int, subsample double, colsample_bytree double")
    forests = R.grid_forests(rows, ["a", "b", "c"], grid)
    monkeypatch.setattr(B, "TASK_ROWS", 1000)
    for r in grid.collect():
        alone = M.fit(rows.where("split = 'train'"), ["a", "b", "c"], **{k: r[k] for k in R.PARAMETERS})
        assert np.abs(forests[r["candidate_id"]].margins(x) - alone.margins(x)).max() < 1e-9 and len(alone.trees) == r["n_estimators"]
    found = {r["candidate_id"]: r for r in R.grid_metrics(forests, rows, grid).collect()}
    for name, forest in forests.items():
        v = [(r["label"], forest.margins(np.array([[r["a"], r["b"], r["c"]]]))[0] >= 0) for r in rows.where("split = 'validation'").collect()]
        assert (found[name]["tp"], found[name]["fp"]) == (sum(y == 1 and h for y, h in v), sum(y == 0 and h for y, h in v))
    assert B.Forest.from_json(forests["m3"].to_json()) == forests["m3"]


def test_many_values_are_cut_at_quantiles(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=5000)
    rows = spark.createDataFrame([(f"r{i}", int(v > 0.3), float(v)) for i, v in enumerate(x)], "email_id string, label int, a double")
    forest = M.fit(rows, ["a"], max_depth=1, n_estimators=1)
    assert len(B.cut_points(rows, ["a"], 64)[0]) == 63 and abs(forest.trees[0].cut[0] - 0.3) < 0.02


def test_nulls_and_one_value(spark):
    rows = spark.createDataFrame([(f"r{i}", i % 2, None if i % 2 else 1.0, 5.0) for i in range(40)], "email_id string, label int, a double, b double")
    forest = M.fit(rows, ["a", "b"], max_depth=2, n_estimators=2, subsample=1.0)
    assert forest.trees[0].feature[0] == -1 and forest.margins(np.array([[np.nan, 5.0]]))[0] == pytest.approx(0)


def test_training_contract(spark, table):
    rows, _, _ = table
    full = rows.unionByName(rows.where("split = 'train'").limit(9).withColumns({"email_id": F.concat("email_id", F.lit("t")), "split": F.lit("test")}))
    for broken, said in ((full.drop("split"), "split"), (full.withColumn("c", F.lit(float("nan"))), "finite"), (full.unionByName(full.limit(1)), "unique_id"), (full.withColumn("label", F.lit(1)), "both_labels")):
        with pytest.raises(C.ContractError, match=said):
            R.check_training(broken, ["a", "c"])


def test_model_queries(spark, monkeypatch):
    """Scores, predictions, attributions and documents of the frozen model on given rows, each against plain formulas."""
    from sparkloom.plans import catalog

    monkeypatch.setattr(C, "FROZEN_MODEL", C.FROZEN_MODEL | {"n_estimators": 6})
    catalog._fitted.clear()
    model, rows = catalog._model(spark, SF)
    names = list(C.FEATURES)
    held = {r["email_id"]: (r["label"], r["split"], np.array([[r[f] for f in names]], float)) for r in rows.collect()}
    p = {i: 1 / (1 + np.exp(-model.margins(x)[0])) for i, (_, _, x) in held.items()}
    kind = lambda y, hit: ("TN", "FP", "FN", "TP")[2 * y + hit]
    test = {i: kind(y, int(p[i] >= C.FROZEN_THRESHOLD)) for i, (y, s, _) in held.items() if s == "test"}
    found = catalog.test_predictions(spark, SF).collect()
    assert {r["email_id"]: r["outcome_type"] for r in found} == test and all(abs(r["probability"] - p[r["email_id"]]) < 1e-12 for r in found)
    for r in catalog.gbt_scores(spark, SF).collect():
        outcomes = [kind(y, int(p[i] >= C.FROZEN_THRESHOLD)) for i, (y, s, _) in held.items() if s == r["split"]]
        assert [r["tn"], r["fp"], r["fn"], r["tp"]] == [outcomes.count(k) for k in ("TN", "FP", "FN", "TP")]
    phi = {r["email_id"]: r["phi"] for r in catalog.tree_attribution(spark, SF).collect()}
    assert set(phi) == set(test)
    for i in sorted(phi)[:5]:
        assert np.abs(np.array(phi[i]) - shapley(model.trees, held[i][2][0], len(names))).max() < 1e-9
    assert [(r["check"], r["passed"], r["compared"]) for r in catalog.attribution_checks(spark, SF).collect()] == [(c, True, len(test)) for c in ("additivity", "logistic", "probability")]
    assert catalog.model_reload(spark, SF).first().asDict() == {"compared": len(held), "unmatched": 0, "max_abs_difference": 0.0, "changed_labels": 0}
    import json

    documents = {d["email_id"]: d for d in (json.loads(r["json"]) for r in catalog.attribution_documents(spark, SF).collect())}
    assert set(documents) == set(test)
    for i, d in documents.items():
        order = sorted(range(len(names)), key=lambda f: (-abs(phi[i][f]), f))[:3]
        assert [f["feature_key"] for f in d["features"]] == [names[f] for f in order] and [f["rank"] for f in d["features"]] == [1, 2, 3]
        assert d["ai_prediction"] == C.CLASS_NAMES[int(p[i] >= C.FROZEN_THRESHOLD)]
        for f, at in zip(d["features"], order, strict=True):
            towards = C.TOWARDS[1] if phi[i][at] > 0 else C.TOWARDS[-1] if phi[i][at] < 0 else "no effect"
            value = held[i][2][0][at]
            assert f["observed_value"] == value and f["direction"] == towards and f["display_name"] == C.DISPLAY_NAMES[names[at]]
            shown = f"{value * 100:.1f}".removesuffix(".0") + "%" if names[at] == C.RATIO_FEATURE else str(int(value))
            assert f["display_text"].startswith(f"{C.DISPLAY_NAMES[names[at]]}: ") and f["display_text"].endswith(towards) and (shown in f["display_text"] or names[at] == C.RATIO_FEATURE)
    catalog._fitted.clear()


def test_equal_rows_are_grown_on_as_weights(spark, monkeypatch):
    """More rows than a task holds, but few kinds of them: no job for each level, and the trees of the single rows."""
    rng = np.random.default_rng(5)
    x = np.stack([rng.integers(0, 4, 3000), rng.integers(0, 3, 3000)], 1).astype(float)
    y = (x.sum(1) + rng.normal(size=3000) > 2.5).astype(int)
    rows = spark.createDataFrame([(f"r{i}", int(y[i]), *map(float, v)) for i, v in enumerate(x)], "email_id string, label int, a double, b double").repartition(5)
    several = [B.Parameters(3, 0.3, 6), B.Parameters(2, 0.1, 9, 2.0), B.Parameters(3, 0.3, 4, subsample=0.5, seed=7)]
    monkeypatch.setattr(B, "TASK_ROWS", 10)
    by_level = B.fit_all(rows, ["a", "b"], several)
    monkeypatch.setattr(B, "TASK_ROWS", 100)
    monkeypatch.setattr(B, "_level", None)
    forests = B.fit_all(rows, ["a", "b"], several)
    for a, b in zip(forests, by_level, strict=True):
        assert len(a.trees) == len(b.trees) and all(s.feature == t.feature and s.cut == t.cut and np.allclose(s.value, t.value, atol=1e-12) and np.allclose(s.cover, t.cover) for s, t in zip(a.trees, b.trees, strict=True))
