"""Ball k-means, fill-in-the-middle and resharding against plain Python, on tables with nulls, repeats, ties and odd texts."""

import random
import re
import zlib
from collections import Counter, defaultdict
from hashlib import sha256
from itertools import permutations

import numpy as np
import pytest

from sparkloom.llm import ballkmeans, fim, registry, resharding

TEXTS = [
    (1, "Hello, world"), (2, None), (3, ""), (4, "a <P> b"), (5, "x<S>y"), (6, "<M>"), (7, "<<P and <S and M> é 中 \U0001f600\n\ttwo\r\n"), (8, "same words here"), (8, "same words here"), (9, "word " * 40_000), (None, "no id at all"),
    (None, None), (-5, "below zero <"), (10, "<"), (11, "P>S>"), (12, "KİK"), *((i, f"text {i} of some words, and more!") for i in range(20, 220)),
]
DOCS = "doc_id long, text string, n long, form string, units int, shard int, DIGEST string, h long, `a.b` int"


def documents(spark, rows=TEXTS):
    return spark.createDataFrame([(*r, 1, "x", 2, 3, "y", 4, 5) for r in rows], DOCS)


def folder(spark, tmp_path, **tables):
    for name, df in tables.items():
        df.repartition(3).write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def hexed(x):
    return sha256(x.encode()).hexdigest()


def middle_filled(doc_id, text):
    text = text or ""
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    digest = hexed(f"1:{'' if doc_id is None else doc_id}")
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted(x % (len(units) + 1) for x in h[:2])
    pre, mid, suf = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return doc_id, len(units), "plain", None, None, hexed(text), hexed(text)
    form, out = ("spm", f"<S>{suf}<P>{pre}<M>{mid}") if h[3] % 100 < 20 else ("psm", f"<P>{pre}<S>{suf}<M>{mid}")
    return doc_id, len(units), form, len(pre), len(mid), hexed(out), hexed(text)


def known(rows):
    return sorted(rows, key=lambda r: [(x is not None, x) for x in r])


def test_op12(spark, tmp_path):
    sf = folder(spark, tmp_path, documents=documents(spark))
    got = known(tuple(r) for r in registry.QUERIES["op12_fill_in_middle"](spark, sf).collect())
    assert got == known(middle_filled(*r) for r in TEXTS)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}


def test_op12_parts_and_other_parameters(spark):
    """Always transformed, in either order: sentinels beside pieces of themselves are read back."""
    rows = [(i, t) for i, (_, t) in enumerate(TEXTS)] + [(1000 + i, "<" * (i % 5) + "P" * (i % 3) + ">" + "<M" * (i % 4)) for i in range(60)]
    for first in (0, 100):
        out = fim.fill_in_middle(documents(spark, rows), seed=7, rate=100, suffix_first=first).select("doc_id", "form", "prefix", "middle", "suffix", "output", fim.restored(fim.F.col("output"), fim.F.col("form")).alias("again")).collect()
        texts = dict(rows)
        assert all(r["again"] == (texts[r["doc_id"]] or "") for r in out)
        assert all(r["prefix"] + r["middle"] + r["suffix"] == texts[r["doc_id"]] for r in out if r["form"] != "plain")
        assert {r["form"] for r in out} == {"plain", "spm" if first else "psm"}


def test_op12_has_no_python_in_its_plan(spark, tmp_path):
    plan = registry.QUERIES["op12_fill_in_middle"](spark, folder(spark, tmp_path, documents=documents(spark)))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def lloyd(rows, k, rounds, d):
    """All distances in every round, in whole numbers."""
    kept = [(i, [int(np.floor(64 * float(x))) for x in v]) for i, v in rows if v is not None and len(v) == d and all(x is not None and np.isfinite(x) for x in v)]
    first = sorted((hexed(f"1:{'' if i is None else i}"), v) for i, v in kept)[:k]
    centroids = [v for _, v in first]
    to = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(centroids))
    for _ in range(rounds):
        members = defaultdict(list)
        for _, v in kept:
            members[to(v)[1]].append(v)
        centroids = [[sum(x) // len(members[j]) for x in zip(*members[j], strict=True)] if members[j] else c for j, c in enumerate(centroids)]
    found = [(i, *to(v)) for i, v in kept]
    own = Counter()
    for _, dist, j in found:
        own[j] += dist
    return [(i, j, dist, own[j], sum(own.values()), hexed(",".join(map(str, centroids[j])))) for i, dist, j in found]


def vectors(spark, rows, kind="float"):
    return spark.createDataFrame([(*r, 1, 2, "x") for r in rows], f"vec_id long, embedding array<{kind}>, cluster int, N long, Sums string")


def test_op11(spark, tmp_path):
    rng = np.random.default_rng(3)
    good = [(i, x.tolist()) for i, x in enumerate((rng.normal(size=(9, 64))[rng.integers(0, 9, 400)] + 0.2 * rng.normal(size=(400, 64))).astype(np.float32))]
    odd = [(900, None), (901, []), (902, [1.0] * 63), (903, [float("nan")] + [0.0] * 63), (904, [float("inf")] + [0.0] * 63), (905, [None] + [0.0] * 63), (906, [0.0] * 64), (None, [-0.5] * 64)]
    rows = good + odd + good[:7] + [(1000 + i, good[0][1]) for i in range(50)]
    sf = folder(spark, tmp_path, embeddings=vectors(spark, rows))
    assert known(tuple(r) for r in registry.QUERIES["op11_ball_kmeans"](spark, sf).collect()) == known(lloyd(rows, 16, 3, 64))


@pytest.mark.parametrize("seed", range(4))
def test_op11_ties(spark, seed):
    """Few values, so that many distances are equal and some of the first centroids too; fewer vectors than clusters."""
    rng = np.random.default_rng(seed)
    rows = [(i, x.tolist()) for i, x in enumerate(rng.integers(-2, 3, size=(300 if seed else 5, 3)) / 64)]
    found = ballkmeans.ball_kmeans(vectors(spark, rows, "double"), k=8, rounds=5, dimensions=3)
    assert known(tuple(r) for r in found.rows.collect()) == known((i, j, d) for i, j, d, *_ in lloyd(rows, 8, 5, 3))


def test_op11_compares_little(spark):
    """In separate clusters most members lie in the core of their ball."""
    rng = np.random.default_rng(5)
    x = 40 * rng.normal(size=(12, 16))[rng.integers(0, 12, 6000)] + rng.normal(size=(6000, 16))
    found = ballkmeans.ball_kmeans(vectors(spark, list(enumerate(x.tolist())), "double"), k=12, rounds=6, dimensions=16)
    assert found.compared[0] == 12 * 6000 and max(found.compared[1:]) < 4 * 6000 and found.compared[-1] < 2 * 6000


def test_op11_empty_and_large(spark, tmp_path):
    sf = folder(spark, tmp_path, embeddings=vectors(spark, [(1, None)]).where("vec_id > 1"))
    got = registry.QUERIES["op11_ball_kmeans"](spark, sf)
    assert got.count() == 0 and got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    with pytest.raises(Exception, match="would leave 64 bits"):
        ballkmeans.ball_kmeans(vectors(spark, [(1, [3e30] * 64)]))


def test_op13(spark, tmp_path):
    sf = folder(spark, tmp_path, documents=documents(spark))
    got = registry.QUERIES["op13_reshard"](spark, sf).collect()
    want = [(i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in TEXTS]
    assert known((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == known(want)
    assert {(r["law"], r["grown_shard"]) for r in got} == {("bytes", None)}
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    assert set(slots) <= set(range(40)) and all(sorted(s) == list(range(len(s))) for s in slots.values())


def sizes_of(layout, spark):
    out = Counter()
    for r in resharding.read_layout(layout, spark).collect():
        out[r["shard"]] += r["size"]
    return [out[i] for i in range(layout.shards)]


def test_op13_moves_the_fewest_bytes_and_leaves_the_rest(spark, tmp_path):
    rng = random.Random(2)
    rows = [(i, "x" * rng.randint(0, 400)) for i in range(6000)]
    old = resharding.first_layout(documents(spark, rows), str(tmp_path), 12)
    sizes = old.sizes()
    new = resharding.reshard(old, spark, str(tmp_path), 15)
    least = sum(max(0, a - b) for a, b in zip(sizes, resharding.equal_capacities(sum(sizes), 15), strict=False))
    assert new.moved == least
    assert sizes_of(new, spark) == new.sizes() and max(new.sizes()) - min(new.sizes()) < 2 * 416
    before = {(r["doc_id"], r["shard"]) for r in resharding.read_layout(old, spark).collect()}
    after = resharding.read_layout(new, spark).collect()
    assert sorted(r["doc_id"] for r in after) == list(range(6000)) and {r["doc_id"]: r["text"] for r in after} == dict(rows)
    gone = sum(r["size"] for r in after if (r["doc_id"], r["shard"]) not in before)
    assert abs(gone - least) < 15 * 416
    again = [b for b in new.blocks if b.path == old.blocks[0].path]
    assert len(again) > len(old.blocks) // 2 and {(b.shard, b.block) for b in again} <= {(b.shard, b.block) for b in old.blocks}
    # on from the manifest alone, to fewer shards and back to none moved
    few = resharding.reshard(resharding.load_layout(spark, new.manifest, 15), spark, str(tmp_path), 4)
    assert few.sizes() == sizes_of(few, spark) and {r["doc_id"] for r in resharding.read_layout(few, spark).collect()} == set(range(6000))
    assert resharding.reshard(few, spark, str(tmp_path), 4).moved < 4 * 416


def test_op13_repeated_rows(spark, tmp_path):
    """A third of all rows repeat one row: they are dealt over all shards."""
    rows = [(7, "the same row again and again")] * 3000 + [(i, f"row {i} of its own") for i in range(6000)]
    layout = resharding.first_layout(documents(spark, rows).repartition(5), str(tmp_path), 8)
    assert max(b.n for b in layout.blocks) < 600 and sum(b.n for b in layout.blocks) == 9000
    new = resharding.reshard(layout, spark, str(tmp_path), 10)
    assert max(new.sizes()) - min(new.sizes()) < 200


def test_op13_empty(spark, tmp_path):
    layout = resharding.first_layout(documents(spark).where("false"), str(tmp_path), 3)
    new = resharding.reshard(layout, spark, str(tmp_path), 5)
    assert layout.blocks == [] and new.sizes() == [0] * 5 and resharding.read_layout(new, spark).count() == 0


def test_transfers_are_the_cheapest():
    rng = random.Random(9)
    for _ in range(60):
        n = rng.randint(1, 5)
        cost = np.array([[rng.randint(0, 9) for _ in range(n)] for _ in range(n)])
        flow = resharding.transfers([1] * n, [1] * n, cost)
        assert sum(f * cost[i][j] for i, j, f in flow) == min(sum(cost[i][p[i]] for i in range(n)) for p in permutations(range(n)))
    for _ in range(40):
        sizes = [rng.choice((0, 3, 50, 1000)) for _ in range(rng.randint(1, 9))]
        capacities = resharding.equal_capacities(sum(sizes), rng.randint(1, 9))
        flow = resharding.transfers(sizes, capacities)
        assert [sum(f for i, _, f in flow if i == k) for k in range(len(sizes))] == sizes and all(sum(f for _, j, f in flow if j == k) <= c for k, c in enumerate(capacities))
        kept = sum(min(a, b) for a, b in zip(sizes, capacities, strict=False))
        assert sum(f for i, j, f in flow if i != j) == sum(sizes) - kept
    with pytest.raises(ValueError):
        resharding.transfers([5], [4])
