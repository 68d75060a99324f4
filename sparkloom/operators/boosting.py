"""Second-order boosted trees for log loss, grown level by level over all tasks, and what a tree says about a row.

Rows are binned once. Growing a level of a tree is one Spark job: tasks sum gradients and hessians by node, feature and
bin, Spark adds the sums, and the driver gets them (bounded by nodes, features and bins) and picks the splits. So no rows
go to the driver. Candidates that differ in parameters alone are grown side by side in the same jobs. A row carries its
margin for each candidate as of the last table; the trees grown since are short work for the tasks, and every
TREES_KEPT trees the margins are written anew, which also cuts the lineage.

Rows of equal bins and label always share a margin, so they count as one with a weight: for each tree, how many of them it
is grown on. There are far fewer such groups than rows, as bins are few; if they are so few that one task holds them, each
candidate is grown by a task of its own, by the same steps.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field, replace
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom import config as C
from sparkloom.sources.scratch import scratch

#: Bins of a feature, trees between two writes of the margins, least gain of a split.
BINS, TREES_KEPT, LEAST_GAIN = 256, 25, 1e-6
#: Binned rows, or groups of equal ones, of a task. So many are some MB, groups with their weights some 50.
TASK_ROWS = 1 << 16
#: Groups that a task sums weights for before it sends them on.
GROUPS_KEPT = 1 << 13
#: What sums in another order may differ by: gains nearer than this are ties.
ROUNDING = 1e-9
SUMS = "candidate int, node int, feature int, bin int, g double, h double"


@dataclass(frozen=True)
class Parameters:
    max_depth: int = 3
    learning_rate: float = 0.1
    n_estimators: int = 10
    min_child_weight: float = 1.0  # least sum of hessians on each side of a split
    subsample: float = 0.8  # share of rows of a tree
    colsample_bytree: float = 1.0  # share of features of a tree
    reg_lambda: float = 1.0
    seed: int = C.SEED


@dataclass
class Tree:
    """Nodes by number, the root first. A row goes left if its feature is below the cut (or null); a leaf's feature is -1."""

    feature: list[int] = field(default_factory=lambda: [-1])
    cut: list[float] = field(default_factory=lambda: [0.0])
    bin: list[int] = field(default_factory=lambda: [0])  # the cut as a number of bins
    left: list[int] = field(default_factory=lambda: [-1])
    right: list[int] = field(default_factory=lambda: [-1])
    value: list[float] = field(default_factory=lambda: [0.0])
    cover: list[float] = field(default_factory=lambda: [0.0])

    def split(self, node: int, feature: int, bin: int, cut: float) -> None:
        for side in (self.left, self.right):
            side[node] = len(self.feature)
            for x, new in zip((self.feature, self.cut, self.bin, self.left, self.right, self.value, self.cover), (-1, 0.0, 0, -1, -1, 0.0, 0.0), strict=True):
                x.append(new)
        self.feature[node], self.bin[node], self.cut[node] = feature, bin, cut

    def leaves(self, x: np.ndarray, cuts: list | None = None) -> np.ndarray:
        """The leaf of each row of values, or of bins if cuts is self.bin."""
        cuts = np.asarray(self.cut if cuts is None else cuts)
        feature, left, right, at = np.asarray(self.feature), np.asarray(self.left), np.asarray(self.right), np.zeros(len(x), np.int64)
        inner = np.flatnonzero(feature[at] >= 0)
        while len(inner):
            node = at[inner]
            at[inner] = np.where(x[inner, feature[node]] >= cuts[node], right[node], left[node])
            inner = inner[feature[at[inner]] >= 0]
        return at

    def margins(self, x: np.ndarray, cuts: list | None = None) -> np.ndarray:
        return np.asarray(self.value)[self.leaves(x, cuts)]

    def expected(self, node: int = 0) -> float:
        """Mean of the leaves by cover."""
        if self.feature[node] < 0:
            return self.value[node]
        a, b = self.left[node], self.right[node]
        whole = self.cover[a] + self.cover[b]
        return (self.cover[a] * self.expected(a) + self.cover[b] * self.expected(b)) / whole if whole else 0.0

    def attributions(self, x: np.ndarray, out: np.ndarray) -> None:
        """Adds to out (rows, features) the path-dependent Shapley values of the rows x.

        A leaf is reached with the product, over the features of its path, of `one` (1 if the row keeps to all cuts of the
        feature) or `zero` (the covers' share of it) as the feature is known or not. The terms by number of known features
        are the coefficients of a product of (zero + one * t); a feature's value needs that product without the feature.
        So a leaf costs the cube of its depth, whatever the number of features.
        """

        def walk(node: int, zero: dict[int, float], one: dict[int, np.ndarray]) -> None:
            f = self.feature[node]
            if f >= 0:
                right = x[:, f] >= self.cut[node]
                whole = self.cover[self.left[node]] + self.cover[self.right[node]]
                for child, goes in ((self.left[node], ~right), (self.right[node], right)):
                    share = self.cover[child] / whole if whole else 0.5
                    walk(child, zero | {f: zero.get(f, 1.0) * share}, one | {f: one[f] & goes if f in one else goes})
                return
            path = list(zero)
            for i in path:
                known = np.zeros((len(path), len(x)))  # by number of known features among the others
                known[0] = 1.0
                for k, j in enumerate(p for p in path if p != i):
                    known[1 : k + 2] = known[1 : k + 2] * zero[j] + known[: k + 1] * one[j]
                    known[0] *= zero[j]
                weights = [factorial(k) * factorial(len(path) - k - 1) / factorial(len(path)) for k in range(len(path))]
                out[:, i] += self.value[node] * (one[i] - zero[i]) * (weights @ known)

        walk(0, {}, {})


@dataclass
class Forest:
    """A row's margin is the sum of the trees' leaves; its probability the logistic function of that."""

    features: list[str]
    parameters: Parameters
    trees: list[Tree] = field(default_factory=list)

    def margins(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x))
        for t in self.trees:
            out += t.margins(x)
        return out

    def base(self) -> float:
        return sum(t.expected() for t in self.trees)

    def attributions(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros((len(x), len(self.features)))
        for t in self.trees:
            t.attributions(x, out)
        return out

    def first(self, n: int) -> Forest:
        """The forest after n of its trees: that of the same parameters with n_estimators = n."""
        return Forest(self.features, replace(self.parameters, n_estimators=n), self.trees[:n])

    def to_json(self) -> str:
        return json.dumps({"features": self.features, "parameters": asdict(self.parameters), "trees": [asdict(t) for t in self.trees]}) + "\n"

    @classmethod
    def from_json(cls, text: str) -> Forest:
        d = json.loads(text)
        return cls(d["features"], Parameters(**d["parameters"]), [Tree(**t) for t in d["trees"]])


def _mixed(x: np.ndarray) -> np.ndarray:
    """64-bit numbers stirred, so that near ones are unrelated."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def drawn(keys: np.ndarray, seed: int, tree: int, share: float) -> np.ndarray:
    """Which rows a tree is grown on: by a hash of seed, tree and key, so on any task the same."""
    with np.errstate(over="ignore"):
        salt = _mixed(np.array([seed * 1_000_003 + tree + 1], np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        return _mixed(keys.view(np.uint64) + salt) < np.uint64(min(share, 1.0) * (2**64 - 2048)) if share < 1 else np.ones(len(keys), bool)


def drawn_features(m: int, seed: int, tree: int, share: float) -> list[int]:
    order = np.argsort(_mixed(np.arange(m, dtype=np.uint64) + np.uint64(abs(seed) * 7_919 + tree * 104_729 + 1)), kind="stable")
    return sorted(order[: max(1, round(share * m))].tolist())


def cut_points(rows: DataFrame, features: list[str], bins: int = BINS) -> list[np.ndarray]:
    """Ascending values of each feature at which a split may cut: all but the least if they are at most `bins`, else quantiles."""
    value = {f: F.col(f).cast("double") for f in features}
    few = rows.agg(*(F.count_distinct(value[f]).alias(f"{i}") for i, f in enumerate(features))).first()
    asked = [F.array_sort(F.collect_set(value[f])) if few[i] <= bins else F.percentile_approx(value[f], [k / bins for k in range(bins)], 100 * bins) for i, f in enumerate(features)]
    found = rows.agg(*(a.alias(f"{i}") for i, a in enumerate(asked))).first()  # at most `bins` values of each feature
    return [np.unique(np.array(found[i], float))[1:] for i in range(len(features))]


def binned(rows: DataFrame, features: list[str], cuts: list[np.ndarray], candidates: int, key: str, label: str) -> DataFrame:
    """key (hash), y, bins (uint16 a feature), margins (double a candidate, 0) of rows."""

    def run(batches):
        for batch in batches:
            x = np.stack([batch.column(f).to_numpy(zero_copy_only=False) for f in features], 1) if features else np.zeros((batch.num_rows, 0))
            b = np.stack([np.searchsorted(c, np.where(np.isnan(x[:, i]), -np.inf, x[:, i]), "right") for i, c in enumerate(cuts)], 1).astype(np.uint16)
            yield pa.record_batch({"key": batch.column("_key"), "y": batch.column("_y"), "bins": pa.array([r.tobytes() for r in b], pa.binary()), "margins": pa.array([bytes(8 * candidates)] * len(b), pa.binary())})

    chosen = rows.select(F.xxhash64(key).alias("_key"), F.col(label).cast("double").alias("_y"), *(F.col(f).cast("double").alias(f) for f in features))
    return chosen.mapInArrow(run, "key long, y double, bins binary, margins binary")


def _matrix(column: pa.Array, kind, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, width)


class _Rows:
    """Binned rows in memory: a batch, or groups of equal rows, whose weights by (group, tree) say how many a tree is grown on."""

    def __init__(self, batch: pa.RecordBatch, m: int, candidates: int, weights: np.ndarray | None = None) -> None:
        self.bins, self.y, self.weights = _matrix(batch.column("bins"), np.uint16, m), batch.column("y").to_numpy(), weights
        if weights is None:
            self.keys, self.margins = batch.column("key").to_numpy(), _matrix(batch.column("margins"), np.float64, candidates).copy()
        else:
            self.margins = np.zeros((len(self.y), candidates))

    def carry(self, grown: list[list[Tree]]) -> None:
        """The trees grown since into the margins."""
        for c, trees in enumerate(grown):
            for t in trees:
                self.margins[:, c] += t.margins(self.bins, t.bin)

    def add_sums(self, totals: dict[int, np.ndarray], growing: dict[int, Tree], parameters: list[Parameters], number: int) -> None:
        """Gradients and hessians of the drawn rows by (node, feature, bin) of each growing tree."""
        for c, tree in growing.items():
            p = 1 / (1 + np.exp(-self.margins[:, c]))
            if self.weights is None:
                used, weight = drawn(self.keys, parameters[c].seed, number, parameters[c].subsample), 1.0
            else:
                used = self.weights[:, number] > 0
                weight = self.weights[used, number]
            node, g, h, b = tree.leaves(self.bins[used], tree.bin), (p - self.y)[used] * weight, (p * (1 - p))[used] * weight, self.bins[used].astype(np.int64)
            _, _, m, width = totals[c].shape
            for f in range(m):
                place = (node * m + f) * width + b[:, f]
                for i, x in enumerate((g, h)):
                    totals[c][i] += np.bincount(place, x, totals[c][i].size).reshape(totals[c][i].shape)


def _no_sums(growing: dict[int, Tree], m: int, width: int) -> dict[int, np.ndarray]:
    return {c: np.zeros((2, len(t.feature), m, width)) for c, t in growing.items()}


def _level(m: int, grown: list[list[Tree]], growing: dict[int, Tree], parameters: list[Parameters], number: int, width: int):
    """Sums of gradients and hessians by (candidate, node, feature, bin) of a task's rows."""

    def run(batches):
        totals = _no_sums(growing, m, width)
        for batch in batches:
            if batch.num_rows:
                rows = _Rows(batch, m, len(grown))
                rows.carry(grown)
                rows.add_sums(totals, growing, parameters, number)
        parts = []
        for c, (g, h) in totals.items():
            at = np.nonzero(h)
            parts.append((np.full(len(at[0]), c), *at, g[at], h[at]))
        columns = [np.concatenate(x) for x in zip(*parts, strict=True)]
        yield pa.record_batch({n: pa.array(x, t) for n, x, t in zip(("candidate", "node", "feature", "bin", "g", "h"), columns, [pa.int32()] * 4 + [pa.float64()] * 2, strict=True)})

    return run


def best_split(g: np.ndarray, h: np.ndarray, usable: list[int], parameters: Parameters) -> tuple[float, int, int]:
    """(gain, feature, bin) of the best cut of a node's sums (feature, bin): rows below bin go left; ties to the first."""
    lam, g_all, h_all = parameters.reg_lambda, g[usable[0]].sum(), h[usable[0]].sum()
    best = (LEAST_GAIN, -1, 0)
    for f in usable:
        gl, hl = np.cumsum(g[f])[:-1], np.cumsum(h[f])[:-1]
        gr, hr = g_all - gl, h_all - hl
        gain = gl * gl / (hl + lam) + gr * gr / (hr + lam) - g_all * g_all / (h_all + lam)
        least = max(parameters.min_child_weight - ROUNDING, ROUNDING)
        gain[(hl < least) | (hr < least)] = -np.inf
        i = int((gain >= gain.max() - ROUNDING).argmax()) if len(gain) and np.isfinite(gain.max()) else -1
        if i >= 0 and gain[i] > best[0] + ROUNDING:
            best = (float(gain[i]), f, i + 1)
    return best


def _grow(features: list[str], candidates: list[Parameters], cuts: list[np.ndarray], sums_of, carried) -> list[Forest]:
    """Forests of the candidates. sums_of(number, growing): sums of (2, nodes, features, bins) by candidate for the open
    level of tree `number`; carried(trees): takes a finished round of trees into the margins."""
    m = len(features)
    forests = [Forest(features, p) for p in candidates]
    for number in range(max((p.n_estimators for p in candidates), default=0)):
        growing = {c: Tree() for c, p in enumerate(candidates) if number < p.n_estimators}
        open_ = {c: [0] for c in growing}
        usable = {c: drawn_features(m, candidates[c].seed, number, candidates[c].colsample_bytree) for c in growing}
        for depth in range(max(candidates[c].max_depth for c in growing)):
            now = {c: growing[c] for c in growing if open_[c] and depth < candidates[c].max_depth}
            for c, (g, h) in sums_of(number, now).items() if now else ():
                p, tree, following = candidates[c], growing[c], []
                value = lambda g, h: float(-p.learning_rate * g / (h + p.reg_lambda))  # noqa: B023, E731
                if not depth:
                    tree.cover[0], tree.value[0] = float(h[0, 0].sum()), value(g[0, 0].sum(), h[0, 0].sum())
                for node in open_[c]:
                    gain, f, b = best_split(g[node], h[node], usable[c], p)
                    if f < 0:
                        continue
                    tree.split(node, f, b, float(cuts[f][b - 1]))
                    for child, side in ((tree.left[node], slice(0, b)), (tree.right[node], slice(b, None))):
                        tree.cover[child], tree.value[child] = float(h[node, f, side].sum()), value(g[node, f, side].sum(), h[node, f, side].sum())
                        following.append(child)
                open_[c] = following
        for c, tree in growing.items():
            forests[c].trees.append(tree)
        carried([[growing[c]] if c in growing else [] for c in range(len(candidates))])
    return forests


def _draws(candidates: list[Parameters]) -> dict[tuple[int, float], int]:
    """(seed, share) -> number of trees: the different ways in which rows are drawn."""
    out: dict[tuple[int, float], int] = {}
    for p in candidates:
        out[p.seed, p.subsample] = max(out.get((p.seed, p.subsample), 0), p.n_estimators)
    return out


GROUPS = "draw int, y double, bins binary, weights binary"


def _weights(draws: dict[tuple[int, float], int]):
    """A task's rows in groups of equal bins and label; weights (int32 a tree) by draw. A group comes as often as the task sends."""

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, GROUPS_KEPT):
                part = batch.slice(start, GROUPS_KEPT)
                groups: dict[tuple[float, bytes], int] = {}
                at = np.array([groups.setdefault(x, len(groups)) for x in zip(part.column("y").to_pylist(), part.column("bins").to_pylist(), strict=True)], np.int64)
                y, bins = pa.array([k[0] for k in groups], pa.float64()), pa.array([k[1] for k in groups], pa.binary())
                keys = part.column("key").to_numpy()
                for i, ((seed, share), trees) in enumerate(draws.items()):
                    weights = np.stack([np.bincount(at, drawn(keys, seed, t, share), len(groups)) for t in range(trees)], 1).astype(np.int32)
                    yield pa.record_batch({"draw": pa.array([i] * len(groups), pa.int32()), "y": y, "bins": bins, "weights": pa.array([w.tobytes() for w in weights], pa.binary())})

    return run


def _summed(batches):
    """Groups in order, the weights of equal ones added."""
    held, total = None, None

    def row():
        return pa.record_batch({"draw": pa.array([held[0]], pa.int32()), "y": pa.array([held[1]], pa.float64()), "bins": pa.array([held[2]], pa.binary()), "weights": pa.array([total.tobytes()], pa.binary())})

    for batch in batches:
        for draw, y, bins, weights in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (draw, y, bins) == held:
                total += np.frombuffer(weights, np.int32)
            else:
                if held is not None:
                    yield row()
                held, total = (draw, y, bins), np.frombuffer(weights, np.int32).copy()
    if held is not None:
        yield row()


def grouped(rows: DataFrame, candidates: list[Parameters]) -> DataFrame:
    """draw, y, bins, weights: a row for each group of equal binned rows and each way of drawing."""
    parts = rows.mapInArrow(_weights(_draws(candidates)), GROUPS)
    return parts.repartition("draw", "y", "bins").sortWithinPartitions("draw", "y", "bins").mapInArrow(_summed, GROUPS)


def _grown_here(features: list[str], candidates: list[Parameters], cuts: list[np.ndarray], width: int):
    """The forest of one candidate from all groups, as a document."""

    def run(key, table):
        c = key[0].as_py()
        table = table.sort_by([("y", "ascending"), ("bins", "ascending")]).combine_chunks()
        batch = table.to_batches()[0]
        weights = np.frombuffer(b"".join(batch.column("weights").to_pylist()), np.int32).reshape(batch.num_rows, -1)
        rows = _Rows(batch, len(features), 1, weights)

        def sums_of(number: int, growing: dict[int, Tree]) -> dict[int, np.ndarray]:
            totals = _no_sums(growing, len(features), width)
            rows.add_sums(totals, growing, [candidates[c]], number)
            return totals

        return pa.table({"candidate": pa.array([c], pa.int32()), "forest": [f.to_json() for f in _grow(features, [candidates[c]], cuts, sums_of, rows.carry)]})

    return run


def fit_all(train: DataFrame, features: list[str], candidates: list[Parameters], key: str = "email_id", label: str = "label", bins: int = BINS) -> list[Forest]:
    """A forest for each candidate. Up to TASK_ROWS groups of equal rows: a task for each candidate, all in one job. More: grown
    side by side, one job for each level of a tree, whatever the number of candidates. Without rows the trees are single
    leaves of 0.
    """
    features, m, k = list(features), len(features), len(candidates)
    n = train.count()
    if not n or not candidates:
        return [Forest(features, p, [Tree() for _ in range(p.n_estimators)]) for p in candidates]
    cuts = cut_points(train, features, bins)
    width = max(map(len, cuts)) + 1
    rows = scratch(binned(train, features, cuts, k, key, label), "binned")
    if rows.select("y", "bins").distinct().count() <= TASK_ROWS:
        number = list(_draws(candidates))
        of = F.filter(F.array(*(F.struct(F.lit(i).alias("c"), F.lit(number.index((p.seed, p.subsample))).alias("draw")) for i, p in enumerate(candidates))), lambda x: x["draw"] == F.col("draw"))
        dealt = scratch(grouped(rows, candidates), "groups").withColumn("candidate", F.explode(F.transform(of, lambda x: x["c"]))).repartition(4 * k, "candidate")
        grown = dealt.groupBy("candidate").applyInArrow(_grown_here(features, candidates, cuts, width), "candidate int, forest string").collect()
        return [Forest.from_json(r["forest"]) for r in sorted(grown, key=lambda r: r["candidate"])]
    state = {"rows": rows.repartition(-(-n // TASK_ROWS)), "recent": [[] for _ in candidates]}

    def sums_of(number: int, growing: dict[int, Tree]) -> dict[int, np.ndarray]:
        sums = state["rows"].mapInArrow(_level(m, state["recent"], growing, candidates, number, width), SUMS).groupBy("candidate", "node", "feature", "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).toArrow()
        candidate, node, feature, bin, g, h = (sums.column(i).to_numpy() for i in range(6))
        totals = _no_sums(growing, m, width)
        for c, total in totals.items():
            own = candidate == c
            total[0][node[own], feature[own], bin[own]], total[1][node[own], feature[own], bin[own]] = g[own], h[own]
        return totals

    def carried(trees: list[list[Tree]]) -> None:
        state["recent"] = [a + b for a, b in zip(state["recent"], trees, strict=True)]
        if max(map(len, state["recent"])) >= TREES_KEPT:
            state["rows"] = scratch(state["rows"].mapInArrow(_carried(m, state["recent"]), "key long, y double, bins binary, margins binary"), "margins")
            state["recent"] = [[] for _ in candidates]

    return _grow(features, candidates, cuts, sums_of, carried)


def _carried(m: int, grown: list[list[Tree]]):
    """Rows with the trees grown since the last table in their margins."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                rows = _Rows(batch, m, len(grown))
                rows.carry(grown)
                yield pa.record_batch({"key": batch.column("key"), "y": batch.column("y"), "bins": batch.column("bins"), "margins": pa.array([r.tobytes() for r in rows.margins], pa.binary())})

    return run
