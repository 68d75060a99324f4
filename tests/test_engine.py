"""Contracts, splits, text functions and evaluation on small hand-made rows."""

import hashlib
import html
import json
import math
import os
import random
import re
import time
from collections import Counter
from itertools import combinations

import numpy as np
import pandas as pd
import pytest
import yaml
from pyspark.sql import functions as F

from plain_pam import pam, silhouette
from sparkloom import cli
from sparkloom import config as C
from sparkloom.functions import sanitise as S
from sparkloom.operators import evaluate as E
from sparkloom.operators import medoids as P
from sparkloom.operators import similarity as J
from sparkloom.operators import stats as A
from sparkloom.operators import tables as O
from sparkloom.operators import training as R
from sparkloom.functions import text as T
from sparkloom.sources import files
from sparkloom.streaming.features import stream_features, with_features


def valid_rows():
    """Three rows of each class in each split."""
    return [(f"m{k:03d}", y, split, k / 40, float(k % 5)) for k, (split, y) in enumerate((s, y) for s in C.SPLITS for y in (1, 0) for _ in range(3))]


def violations(spark, rows):
    df = spark.createDataFrame(rows, "email_id string, label int, split string, uppercase_letter_ratio double, url_count double")
    return {r["check"] for r in O.output_contract(df, ("uppercase_letter_ratio", "url_count")).collect() if not r["passed"]}


@pytest.mark.parametrize(("row", "check"), [
    (("m000", 1, "train", float("inf"), 2.0), "finite"), (("m000", 1, "train", 1.5, 2.0), "ratio_range"), (("m000", 1, "train", 0.5, -3.0), "counts_not_negative"),
    (("m007", 1, "train", 0.5, 2.0), "unique_id"), (("m000", 7, "train", 0.5, 2.0), "label_domain"), (("m000", 1, "dev", 0.5, 2.0), "split_domain"),
])
def test_contract_finds(spark, row, check):
    assert violations(spark, valid_rows()) == set()
    assert check in violations(spark, [row, *valid_rows()[1:]])


def test_one_label_split(spark):
    rows = [(i, 1 if s == "test" else y, s, r, u) for i, y, s, r, u in valid_rows()]
    assert violations(spark, rows) == {"both_labels_in_each_split"}


def test_split_is_stable_and_by_quota(spark):
    """67 rows of label 0 and 33 of label 1: 46.9, 10.05, 10.05 and 23.1, 4.95, 4.95 in largest remainders."""
    df = spark.createDataFrame([(f"row {i * i}", int(i % 3 == 1)) for i in range(100)], "email_id string, label int")
    a, b = (sorted(map(tuple, O.stratified_split(d).collect())) for d in (df, df.repartition(7)))
    assert a == b and len(a) == 100
    assert {(y, s): sum(r[1:] == (y, s) for r in a) for y in (0, 1) for s in C.SPLITS} == {(y, s): n for y, ns in ((0, (47, 10, 10)), (1, (23, 5, 5))) for s, n in zip(C.SPLITS, ns, strict=True)}


def test_features_count_markers_only(spark):
    rows = [("Pay now!!", "Locked: see http://203.0.113.9/pay, expired"), ("x", "[URL: 198.51.100.7/q] [URL: 300.1.1.1/] [URL: 2001:db8::1/a]")]
    found = with_features(spark.createDataFrame(rows, "sanitized_subject string, sanitized_body string")).orderBy("exclamation_mark_count", ascending=False).collect()
    assert [(r["url_count"], r["ip_address_url_count"], r["urgency_word_count"], r["exclamation_mark_count"]) for r in found] == [(0, 0, 2, 2), (3, 2, 0, 0)]


@pytest.mark.parametrize(("text", "clean"), [
    ("A&amp;amp;B", "A&B"), (None, ""), ("see http://[::1]/x", "see [URL: unknown-host]]/x"), ("mail a.b@Mail.Example now", "mail [USER]@mail.example now"), ("call +1 555 123 4567", "call [PHONE]"), ("id 1234567890123456", "id 1234567890123456"),
    ("[URL: http://1.2.3.4/x]", "[URL: http://1.2.3.4/x]"), ("www.A.example).", "[URL: a.example/])."), ("ftp://f.example/a", "[LINK: f.example/a]"), ('<a href="http://H.example:80//p?q=1#f">t</a>', "t [URL: h.example/p?q=1]"), ("<URL: http://x.example>", "[URL: x.example/]"),
])
def test_sanitise(text, clean):
    found = S.sanitise_text(text)
    assert found.replace("www.a", "a") == clean
    assert S.sanitise_text(found) == found


def test_keywords_must_be_frozen():
    with pytest.raises(C.KeywordConfigError):
        C.Keywords(status="draft")


def test_pam_never_costs_more_than_build():
    x = np.random.default_rng(0).normal(size=(40, 2))
    d = P.distances(x, x)
    for k in (1, 2, 3):
        assert d[:, pam(d, k)].min(1).sum() <= d[:, pam(d, k, rounds=0)].min(1).sum() + 1e-9


@pytest.mark.parametrize(("n", "size"), [(300, 64), (90, 1024), (45, 7)])
def test_medoids_over_blocks_are_those_of_the_whole_matrix(spark, n, size):
    """Two classes, several blocks, repeated vectors; all numbers of medoids, silhouettes and the choice among them."""
    rng = np.random.default_rng(n)
    rows = [(y, f"v{i:04d}", [float(v) for v in rng.normal(size=3) + 3 * y * (i % 4)]) for i in range(n) for y in (0, 1)]
    rows = [(y, f"{e}{y}", z) for y, e, z in rows] + [(0, f"w{i}", rows[0][2]) for i in range(5)]
    df = spark.createDataFrame(rows, "predicted_label int, email_id string, z array<double>").repartition(3)
    packed = P.blocks(df, size)
    found, chosen = P.search_medoids(packed, 3, [0, 1], C.MEDOID_KS), P.class_medoids(df, size).collect()
    for y in (0, 1):
        own = sorted((e, z) for label, e, z in rows if label == y)
        d = P.distances(*[np.array([z for _, z in own])] * 2)
        scores = {}
        for k in C.MEDOID_KS:
            m = pam(d, k)
            assert [own[i][0] for i in m] == [e for _, e, _ in found[y][k]]
            scores[k] = silhouette(d, d[:, m].argmin(1))
        k = max(scores, key=lambda k: (scores[k], -k))
        mine = [r for r in chosen if r["predicted_label"] == y]
        assert {r["k"] for r in mine} == {k} and sorted(r["email_id"] for r in mine) == [own[i][0] for i in pam(d, k)]
        assert abs(mine[0]["silhouette_score"] - scores[k]) < 1e-9 and abs(mine[0]["distance_threshold"] - np.percentile(d[:, pam(d, k)].min(1), 95)) < 1e-9


def test_bounds_leave_few_candidates_and_never_the_best(spark, monkeypatch):
    """Steps with bounds find what those over all candidates find, and few candidates meet all rows."""
    rng = np.random.default_rng(8)
    rows = [(y, f"v{i:04d}{y}", [float(v) for v in np.r_[rng.integers(0, 3), np.round(rng.normal() + 4 * y * (i % 3), 3)]]) for i in range(900) for y in (0, 1)]
    df = spark.createDataFrame(rows + [(0, "w", rows[0][2])], "predicted_label int, email_id string, z array<double>").repartition(3)
    packed = P.blocks(df, 256)
    plain = P.search_medoids(packed, 2, [0, 1], C.MEDOID_KS)
    monkeypatch.setattr(P, "BOUNDED", 100)
    ids = lambda found: {(y, k): [(at, i) for at, i, _ in m] for y, own in found.items() for k, m in own.items()}
    assert ids(P.search_medoids(packed, 2, [0, 1], C.MEDOID_KS)) == ids(plain)
    cells, blocks = P._cells(packed, 2, [0, 1]), packed.collect()
    monkeypatch.setattr(P, "FEW", 0.0)
    P._search(packed, 2, {y: {0: []} for y in (0, 1)}, False, spent := dict(cells))
    assert not spent  # no bounds after a step in which they leave too many
    for asked, swap in (({y: {0: []} for y in (0, 1)}, False), ({y: {0: plain[y][2]} for y in (0, 1)}, False), ({y: {k: list(plain[y][k]) for k in (2, 4)} for y in (0, 1)}, True)):
        chosen = P._chosen(packed, 2, asked, swap, cells)
        kept = sum(len(chosen(b["predicted_label"], b["block"], np.frombuffer(b["x"]).reshape(-1, 2))) for b in blocks)
        assert 0 < kept < 0.5 * sum(b["n"] for b in blocks)  # of some eight rows a cell; more rows leave less
    for y in (0, 1):
        x, w = (np.concatenate([np.frombuffer(b[c]) for b in sorted(blocks, key=lambda b: b["block"]) if b["predicted_label"] == y]) for c in ("x", "w"))
        x = x.reshape(-1, 2)
        tree, place, mean, _, _ = cells[y]
        at = place[P._leaves(tree, x)]
        radius = np.array([np.sqrt(np.square(x[at == g] - mean[g]).sum(1)).max() for g in range(len(mean))])
        for m, swap in (([], False), (plain[y][3], False), (plain[y][3], True)):
            each = P._limits(x, m, swap)
            limits = np.array([[(v[at == g].min(), v[at == g].max(), (v * w)[at == g].sum()) for g in range(len(mean))] for v in each]).transpose(0, 2, 1)
            exact = np.stack([np.minimum(P.distances(x, x), v) @ w for v in (each[1:] if swap else each)])
            assert (P._bounds(x, cells[y], radius, limits) <= exact + 1e-9).all()


def test_equal_vectors_count_as_one_with_a_weight(spark):
    """Copies do not multiply the work: totals of all rows from a row for each vector; few vectors keep their rows."""
    rng = np.random.default_rng(3)
    rows = [(y, f"v{i:03d}{y}", [float(v) for v in rng.integers(0, 3, 2)] + [float(i % 2)]) for i in range(200) for y in (0, 1)] + [(2, f"w{i}", [float(i % 2)] * 3) for i in range(9)]
    df = spark.createDataFrame(rows, "predicted_label int, email_id string, z array<double>").repartition(4)
    assert P.blocks(df).agg(F.sum("n")).first()[0] == len({(y, tuple(z)) for y, _, z in rows if y < 2}) + 9
    found = {(r["predicted_label"], tuple(r["z"])): r for r in P.total_distances(df).collect()}
    for y in (0, 1, 2):
        own = np.array([z for label, _, z in rows if label == y])
        total = P.distances(own, own).sum(1)
        for z, t in zip(own, total, strict=True):
            r = found[y, tuple(z)]
            assert abs(r["total"] - t) < 1e-9 and r["n"] == len(own)
        assert y == 2 or {r["email_id"] for k, r in found.items() if k[0] == y} == {min(e for label, e, v in rows if label == y and v == list(z)) for z in {tuple(z) for z in own}}


def test_pam_medoids_are_train_rows(spark):
    from sparkloom.plans import catalog

    sf = "/root/testdata/sf0.001"
    train = {r["email_id"]: r["predicted_label"] for r in catalog.vectors4(spark, sf).where("split = 'train'").collect()}
    found = catalog.pam_medoids(spark, sf).collect()
    assert all(train[r["email_id"]] == r["predicted_label"] for r in found) and {r["predicted_label"] for r in found} == {0, 1}
    with pytest.raises(C.ContractError, match="can't be clustered"):
        P.class_medoids(spark.createDataFrame([(1, f"{i}", [0.0]) for i in range(6)], "predicted_label int, email_id string, z array<double>"))


def test_broken_markup():
    """What is not closed ends with the element around it; media go with what is in them; links keep their address."""
    cases = {
        "<div><form>gone<input></div>kept": "kept", "<div><object>gone<p>gone</div><b>kept</b>": "kept", "a<video>gone<p>gone</p></video><p>b": "a\nb", "<p><a href='http://x.example/q'>one<p>two": "one [URL: x.example/q]\ntwo",
        "<td>a<td>b": "a\nb", "<a href=ftp://f.example>f</a><a href='mailto:x'>m</a>": "f [LINK: f.example/]\nm", "<a href='http://x.example'><img src=y>z</a>": "[REMOTE IMAGE REMOVED] z [URL: x.example/]", "<script>a</script><style>b</style><p>c": "c",
        "x < y and y > z": "x < y and y > z", "<p>a<!-- no --><br>b</p></p></div>c": "a\nb\nc",
    }
    assert {page: S.normalise_space(S.html_to_text(page)) for page in cases} == cases


def test_every_page_keeps_its_visible_words(spark):
    """No page loses what is outside of dropped elements: by a scan of tags that knows nothing of trees."""
    for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect():
        page = re.sub(r"(?is)<!--.*?-->|<(script|style|iframe|object|form|video|audio)\b.*?</\1\s*>", " ", r["html"])
        words = set(re.findall(r"[^\W\d_]{4,}", html.unescape(re.sub(r"(?s)<[^>]*>", " ", page))))
        assert words <= set(re.findall(r"[^\W\d_]{4,}", S.html_to_text(S.decode_entities(r["html"]))))


def test_native_rows_are_as_the_full_ones(spark):
    texts = [None, "", " a\t\x0bb \r\n\r\n\r\n c\x1c ", "plain words\u00a0only ", "call 555 123 4567", "x@y.example", "<p>t", "R&amp;D", "see www.a.example", "[URL: a.example/]", "12.50 and 7", "(01) 23 45 67 89"]
    rows = S.sanitised_rows(spark.createDataFrame(list(enumerate(texts)), "id int, raw string"), {"text": "raw"}).collect()
    assert {r["id"]: r["text"] for r in rows} == {i: S.sanitise_text(t) for i, t in enumerate(texts)}


def test_link_edges_are_word_edges():
    assert S.sanitise_text("[URL: a.example/]5551234567 (5551234567)") == "[URL: a.example/]5551234567 [PHONE])"
    assert S.sanitise_text("[URL: a.example/] 555 123 4567 \ua000\ua001") == "[URL: a.example/] [PHONE] \ua000\ua001"
    assert S.link_target("HTTP://User@EXAMPLE.com:8080//a///b?to=me@x.example&u=http://z#frag") == "example.com/a/b?to=[USER]@x.example&u=http-colon//z".replace("[", "").replace("]", "")


def test_phones_are_masked_until_none_is_left():
    """As by masking the whole text again and again."""

    def whole(text):
        again = S.PHONE.sub(lambda m: S.PHONE_MASK if 7 <= sum(c.isdigit() for c in m[0]) <= 15 else m[0], text)
        return text if again == text else whole(again)

    rng = random.Random(8)
    texts = ["".join(rng.choices("0123456789" * 3 + " .-+()()a]", k=rng.randint(5, 60))) for _ in range(4000)]
    assert [S.phones(t) for t in texts] == [whole(t) for t in texts]
    assert sum(whole(t) != S._mask_numbers(t, S.PHONE.finditer(t))[0] for t in texts) > 1


def test_link_targets():
    """Host and rest as the standard library parses them, where it does."""
    from urllib.parse import urlsplit

    urls = ["http://A.example", "https://u:p@B.example:8443/x//y/?q=a/b#f", "ftp://c.example/?#x", "d.example:80", "e.example/p:1@z?x=1?y", "http://[2001:DB8:0:0:0:0:0:1]:80/a", "HTTP://f.example?only=query", "http://g@h@i.example/", "x+y://j.example//", "k.example?#", "http:///path"]
    for url in urls:
        p = urlsplit(url if "://" in url else f"http://{url}")
        host = p.hostname.replace("2001:db8:0:0:0:0:0:1", "2001:db8::1") if p.hostname else "unknown-host"
        assert S.link_target(url) == host + (re.sub("/+", "/", p.path) or "/") + (f"?{p.query}" if p.query else ""), url
    assert [S.link_target(u) for u in ("http://[::1", "http://[x]/", "http://a]b/", "", "http://a.example/call/5551234567/x@Y.example?z=HTTP://b")] == ["unknown-host"] * 3 + ["unknown-host/", "a.example/call/PHONE/USER@y.example?z=http-colon//b"]
    assert S.decode_entities("&amp;amp;lt;b&amp;gt; &#65; & x") == "<b> A & x"


def test_extension_as_in_plain_python(spark):
    """Each new id goes where its label lacks most, then where rows lack most at all, against quotas in whole rows."""

    def shares(n):
        exact = [n * r for r in C.RATIOS.values()]
        out = [math.floor(x) for x in exact]
        for k in sorted(range(3), key=lambda k: (out[k] - exact[k], k))[: n - sum(out)]:
            out[k] += 1
        return out

    rng = random.Random(8)
    for case in range(4):
        rows = [(f"c{case}r{i}", int(rng.random() < 0.4)) for i in range(rng.randint(3, 60))]
        frozen = [(i, rng.choice(C.SPLITS)) for i, _ in rows if rng.random() < 0.5]
        split = dict(frozen)
        for i, y in sorted((r for r in rows if r[0] not in split), key=lambda r: hashlib.sha256(f"42:{r[0]}".encode()).hexdigest()):
            lack = []
            for k, s in enumerate(C.SPLITS):
                own = shares(sum(z == y for _, z in rows))[k] - sum(split.get(j) == s for j, z in rows if z == y)
                lack.append((own, shares(len(rows))[k] - sum(x == s for x in split.values()), -k))
            split[i] = C.SPLITS[-max(lack)[2]]
        got = O.extend_split(spark.createDataFrame(rows, "email_id string, label int"), spark.createDataFrame(frozen, "email_id string, split string"))
        assert {r["email_id"]: r["split"] for r in got.collect()} == {i: s for i, s in split.items() if i not in dict(frozen)}


def test_percent_text(spark):
    """Every ratio of small counts as Python formats it."""
    ratios = sorted({a / b for b in range(1, 161) for a in range(b + 1)})
    got = spark.createDataFrame([(r,) for r in ratios], "r double").select("r", T.observed_text(F.lit(C.RATIO_FEATURE), F.col("r")).alias("t")).collect()
    assert all(r["t"] == (f"{r['r'] * 100:.1f}".rstrip("0").rstrip(".") + "%") for r in got)


def test_accents(spark):
    rows = [("a", "Äpfel ﬁn naïve Ⅳ"), ("b", "plain old"), ("c", None)]
    got = {r["email_id"]: r["text"] for r in J.folded(spark.createDataFrame(rows, "email_id string, text string")).collect()}
    assert got == {"a": "apfel fin naive iv", "b": "plain old", "c": ""}


def test_white_space_as_in_plain_python(spark):
    """Ends, lines and keys of texts of every kind of white space."""
    rng, kinds = random.Random(4), [*" \t\x0b\f\r\n\x1c\x1f\x85\xa0\u2003\u2028\u3000", "\r\n", "\n\n", "  ", "\u200b", "A", "\u00e9", "b c"]
    texts = ["", " ", "\n", *("".join(rng.choices(kinds, k=rng.randrange(1, 14))) for _ in range(600))]

    def plain(t):
        t = re.sub(r"[\t\x0b\f ]+", " ", t.replace("\r\n", "\n").replace("\r", "\n"))
        return re.sub(r"\n{3,}", "\n\n", "\n".join(line.strip() for line in t.split("\n"))).strip()

    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    rows = df.select("i", T.strip(F.col("t")).alias("s"), T.whitespace(F.col("t")).alias("w"), T.dedup_key(F.col("t")).alias("k")).orderBy("i").collect()
    assert [(r["s"], r["w"], r["k"]) for r in rows] == [(t.strip(), plain(t), " ".join(t.lower().split())) for t in texts]
    assert df.select(F.lit(None).cast("string").alias("t")).select(T.whitespace(F.col("t")).alias("w")).first()["w"] is None


@pytest.mark.parametrize("cell", [4096, 3])
def test_similar_pairs_are_all_that_there_are(spark, monkeypatch, cell):
    """Vectors with very common terms and equal weights, in one join cell and in many, against all pairs."""
    monkeypatch.setattr(J, "CELL", cell)
    rng, vectors = random.Random(6), {}
    for k in range(60):
        near = vectors.get(f"e{k - 3}") if k % 3 else None
        raw = dict(near) if near else {t: rng.choice([0.0, 0.5, 1.0, 2.0]) for t in ["all", *(f"t{j}" for j in range(8))]} | {"all": 1.0}
        if near and k % 2:
            raw[f"t{rng.randrange(8)}"] = rng.choice([0.1, 0.4])
        size = math.sqrt(sum(x * x for x in raw.values()))
        vectors[f"e{k}"] = {t: x / size for t, x in raw.items() if x}
    split = {e: rng.choice(C.SPLITS) for e in vectors}
    often = {t: sum(t in v for v in vectors.values()) for v in vectors.values() for t in v}
    v = spark.createDataFrame([(e, t, often[t], w) for e, x in vectors.items() for t, w in x.items()], "email_id string, term string, df bigint, w double")
    rows = spark.createDataFrame([(e, split[e], 1, e) for e in vectors], "email_id string, split string, label int, text string")
    got = {(r["left_email_id"], r["right_email_id"]): r["similarity"] for r in J.similar_pairs(v, rows).collect()}
    dot = lambda a, b: sum(w * vectors[b].get(t, 0) for t, w in vectors[a].items())
    want = {(a, b): dot(a, b) for a in vectors for b in vectors if C.SPLITS.index(split[a]) < C.SPLITS.index(split[b]) and dot(a, b) >= C.SIMILAR + 1e-9}
    assert len(want) > 50 and set(got) >= set(want) and all(dot(*p) >= C.SIMILAR - 1e-9 for p in got)
    found = {tuple(r) for r in J.candidates(v, rows).select("a", "b").collect()}
    across = sum(C.SPLITS.index(split[a]) < C.SPLITS.index(split[b]) for a in vectors for b in vectors)
    assert set(got) <= found and len(found) < 0.8 * across


def test_terms_are_counted_without_a_shuffle(spark, monkeypatch):
    """By text, where it is read; a text's terms over several batches, accents, one word, nothing, null."""
    monkeypatch.setattr(J, "TERMS_BATCH", 4)
    texts = ["b\u00e9 be BE be a be_1 x9", "one", "", None, "to be or not to be, to be"]
    df = spark.createDataFrame([(f"e{i}", t) for i, t in enumerate(texts)], "email_id string, text string").repartition(2)
    got = sorted(map(tuple, J.terms(df).collect()))
    assert got == sorted(map(tuple, J.occurrences(df).groupBy("email_id", "term").count().collect())) and ("e0", "be be", 3) in got and ("e4", "to be", 3) in got and ("e1", "one", 1) in got
    plan = J.terms(spark.range(9).select(F.concat(F.lit("e"), "id").alias("email_id"), F.lit("some text").alias("text")))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def _shuffle_files(spark):
    dirs = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    return sum(f.startswith("shuffle_") for d in dirs for _, _, files in os.walk(d.getPath()) for f in files)


@pytest.mark.parametrize("postings", [1 << 21, 7])
def test_packed_weights_are_those_of_plain_python(spark, monkeypatch, postings):
    """In one block and in many, over several buckets: sums of all weights, and vectors of the terms that texts share."""
    monkeypatch.setattr(J, "POSTINGS", postings)
    monkeypatch.setattr(J, "BUCKET", 64)
    rng = random.Random(4)
    texts = {3 * i + (i % 2 << 33): " ".join(rng.choices(["to", "be", "or", "not", "caf\u00e9", "x", f"own{i}"], k=rng.randrange(30))) for i in range(40)} | {1: None, 2: "a"}
    df = spark.createDataFrame(list(texts.items()), "nr long, text string").repartition(3)
    words = {i: [w.replace("\u00e9", "e") for w in (t or "").split() if len(w) > 1] for i, t in texts.items()}
    tf = {i: Counter(w + [f"{a} {b}" for a, b in zip(w, w[1:], strict=False)]) for i, w in words.items()}
    often = Counter(t for x in tf.values() for t in x)
    raw = {i: {t: (1 + math.log(n)) * (math.log((1 + len(texts)) / (1 + often[t])) + 1) for t, n in x.items()} for i, x in tf.items() if x}
    want = {i: {t: r / math.sqrt(sum(y * y for y in x.values())) for t, r in x.items()} for i, x in raw.items()}
    sums = {r["nr"]: r for r in J.weight_sums(J.term_blocks(df)).collect()}
    assert set(sums) == set(want) and all(sums[i]["n_terms"] == len(w) and abs(sums[i]["sum_w"] - sum(w.values())) < 1e-9 and abs(sums[i]["max_w"] - max(w.values())) < 1e-12 for i, w in want.items())
    vectors = {r["nr"]: r for r in J.tfidf(J.term_blocks(df)).collect()}
    vectors = {i: {"terms": r["terms"], "ws": [x / r["norm"] for x in r["ws"]]} for i, r in vectors.items()}
    for i, w in want.items():
        assert np.allclose(sorted(vectors[i]["ws"]), sorted(x for t, x in w.items() if often[t] > 1))
    for a, b in ((a, b) for a in want for b in want):
        of = dict(zip(vectors[b]["terms"], vectors[b]["ws"], strict=True))
        got = sum(x * of.get(t, 0) for t, x in zip(vectors[a]["terms"], vectors[a]["ws"], strict=True))
        assert a == b or abs(got - sum(x * want[b].get(t, 0) for t, x in want[a].items())) < 1e-9


def test_a_write_leaves_no_shuffle_and_passing_tables_go(spark, tmp_path):
    """What bounds the disk of the leakage queries: only tables that are read later stay."""
    from sparkloom.sources.scratch import passing, scratch

    before = _shuffle_files(spark)
    with passing(spark) as keep:
        gone = scratch(spark.range(1000).withColumn("k", F.col("id") % 7).repartition(3, "k"), "gone")
        stays = keep(gone.groupBy("k").count(), "stays")
        path = gone.inputFiles()[0].removeprefix("file://")
        assert os.path.exists(path)
    assert not os.path.exists(path)
    for _ in range(50):
        if _shuffle_files(spark) <= before:
            break
        time.sleep(0.1)
    assert _shuffle_files(spark) <= before and stays.count() == 7


def test_statistics_of_large_values(spark):
    """Median and deviation of values near 1e9, where sums of squares cancel; ranks and distances as in pandas."""
    rng = np.random.default_rng(5)
    v = 1e9 + rng.integers(0, 50, 301).astype(float)
    rows = spark.createDataFrame([(str(i), C.SPLITS[i % 3], float(x), float(x % 7)) for i, x in enumerate(v)], "email_id string, split string, a double, b double")
    one = A.distribution(rows, ["a"]).first()
    assert one["median"] == np.median(v) and abs(one["std"] - v.std(ddof=1)) < 1e-6 and one["mean"] == pytest.approx(v.mean(), abs=1e-6)
    by = {r["split"]: r["median"] for r in A.distribution(rows, ["a"], "split").collect()}
    assert by == {s: np.median(v[i::3]) for i, s in enumerate(C.SPLITS)}
    ranks = pd.DataFrame({"a": v, "b": v % 7}).rank()
    assert A.spearman(rows, ["a", "b"], "email_id").first()["r"] == pytest.approx(ranks.a.corr(ranks.b))
    cdf = lambda x, at: np.searchsorted(np.sort(x), at, "right") / len(x)
    far = max(abs(cdf(v[0::3], x) - cdf(v[2::3], x)) for x in v)
    assert {r["split_pair"]: r["ks_distance"] for r in A.ks(rows, ["a"]).collect()}["train vs test"] == pytest.approx(far)


def test_pam_is_the_best_of_all():
    """On small classes the medoids found cost what the best of all choices costs."""
    for seed in range(6):
        x = np.concatenate([np.random.default_rng(seed).normal(m, 0.2, size=(5, 2)) for m in (0, 3)])
        d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
        best = min(d[:, list(m)].min(1).sum() for m in combinations(range(10), 2))
        assert d[:, pam(d, 2)].min(1).sum() == pytest.approx(best)


def test_shared_features_and_eligibility(spark):
    raw = "email_id string, raw array<double>, mraw array<double>, z array<double>, mz array<double>"
    rows = spark.createDataFrame([("a", [2.0, 5.0, 3.0], [2.0, 6.0, 4.0], [0.1, 0.2, 0.0], [0.1, 0.0, 0.0])], raw)
    assert [r["feature"] for r in E.shared_features(rows, ["f", "g", "h"]).orderBy("rank").collect()] == ["f", "h", "g"]
    assert [r["feature"] for r in E.shared_features(rows, ["f", "g", "h"], ("h",)).orderBy("rank").collect()] == ["f", "g"]
    judged = E.eligibility(spark.createDataFrame([(9.0, 1.0, "t", 3), (0.5, 1.0, " \n", 3), (0.5, 1.0, "t", 1), (1.0, 1.0, "t", 2), (0.5, 1.0, "t", None)], "distance double, t double, example_text string, count long"))
    assert [r["reason"] for r in judged.collect()] == ["distance", "blank_example", "shared_features", "eligible", "shared_features"]
    assert E.eligibility_counters(judged).first().asDict() == {"eligible": 1, "ineligible": 4, "distance": 1, "blank_example": 1, "shared_features": 2, "rule_violations": 0}


def test_eligible_by_outcome(spark):
    predictions = spark.createDataFrame([("a", "TP"), ("b", "TP"), ("c", "TN"), ("d", "FN"), ("e", "FP")], "email_id string, outcome_type string")
    reasons = spark.createDataFrame([("a", "eligible"), ("b", "distance"), ("c", "eligible"), ("d", "blank_example"), ("e", "eligible"), ("z", "eligible")], "email_id string, reason string")
    assert {tuple(r) for r in E.eligible_by_outcome(predictions, reasons).collect()} == {("TP", 2, 1), ("TN", 1, 1), ("FN", 1, 0), ("FP", 1, 1)}


def test_top_attributions_say_direction_and_value(spark):
    names = ["url_count", "uppercase_letter_ratio", "exclamation_mark_count", "action_word_count"]
    rows = spark.createDataFrame([("a", [0.5, -0.75, 0.5, 0.1], [2.0, 0.125, 3.0, 0.0]), ("b", [0.0, 0.0, 0.0, -1.0], [0.0, 0.0, 1.0, 7.0])], "email_id string, phi array<double>, raw array<double>")
    got = [tuple(r) for r in E.top_attributions(rows, names).orderBy("email_id", "rank").collect()]
    up, down = C.TOWARDS[1], C.TOWARDS[-1]
    assert got == [
        ("a", 1, "uppercase_letter_ratio", 0.125, -0.75, down, f"Uppercase-letter proportion: 12.5% — {down}"), ("a", 2, "url_count", 2.0, 0.5, up, f"Number of links: 2 — {up}"),
        ("a", 3, "exclamation_mark_count", 3.0, 0.5, up, f"Exclamation marks: 3 — {up}"), ("b", 1, "action_word_count", 7.0, -1.0, down, f"Action-request words: 7 — {down}"),
        ("b", 2, "url_count", 0.0, 0.0, "no effect", "Number of links: 0 — no effect"), ("b", 3, "uppercase_letter_ratio", 0.0, 0.0, "no effect", "Uppercase-letter proportion: 0% — no effect"),
    ]


def test_example_documents_in_full(spark):
    judged = spark.createDataFrame([("a", 1, "eligible", "m", "Hi", "there"), ("b", 0, "distance", "m", "Hi", "there")], "email_id string, predicted_label int, reason string, medoid_id string, example_subject string, example_body string")
    shared = spark.createDataFrame([("a", 2, "uppercase_letter_ratio", 0.25, 0.5), ("a", 1, "url_count", 1.0, 2.0), ("b", 1, "url_count", 1.0, 1.0)], "email_id string, rank int, feature string, value double, example_value double")
    a, b = (json.loads(r[0]) for r in files.json_documents(R.example_documents(judged, shared, list(C.FEATURES))).collect())
    assert a == {
        "email_id": "a", "ai_prediction": "phishing", "eligible": True, "representative_example": {"email_id": "m", "ai_prediction": "phishing", "subject": "Hi", "body": "there"},
        "shared_features": [
            {"rank": 1, "feature_key": "url_count", "display_name": "Number of links", "current_value": 1.0, "example_value": 2.0, "display_text": "Number of links: this email 1, example 2"},
            {"rank": 2, "feature_key": "uppercase_letter_ratio", "display_name": "Uppercase-letter proportion", "current_value": 0.25, "example_value": 0.5, "display_text": "Uppercase-letter proportion: this email 25%, example 50%"},
        ],
        "display_intro": "A typical email that was also classified as phishing",
    }
    assert b == {"email_id": "b", "ai_prediction": "legitimate", "eligible": False, "shared_features": []}


def test_keywords_as_patterns_find_them(spark):
    """Counts by plain search and runs of letters and digits, against patterns without regard to case over words' edges."""
    rng, terms = random.Random(8), [t for c in C.CATEGORIES for t in C.KEYWORDS[c]]
    odd = [*C.VARIANTS, "\u017fu\u017fpended", "clıck", "lin\u212a", "\u212aey", "İ", "prepinned", "pin9", "9pin", "pin-pin", "log  in", "log\nin", "é", "billé", "_fee_", "RE-VERIFY", "credit-cards", "user - id"]
    texts = ["".join(rng.choice([t.upper(), t, t.title()]) + rng.choice([" ", "  ", "\n", "-", ".", "", "_"]) for t in rng.choices(terms + odd, k=14)) for _ in range(300)]
    edge = lambda t: rf"(?<![a-z0-9])(?:{t})(?![a-z0-9])"

    def plain(text, category):
        text = text.lower()
        for old, new in sorted(C.VARIANTS.items(), key=lambda v: (-len(v[0]), v[0])):
            text = re.sub(edge(re.escape(old)), new, text, flags=re.I)
        n = 0
        for p in sorted((t for t in C.KEYWORDS[category] if " " in t), key=lambda t: (-len(t.split()), -len(t), t)):
            text, k = re.subn(edge(r"\s+".join(p.split())), " ", text, flags=re.I)
            n += k
        return n + len(re.findall(edge("|".join(sorted((t for t in C.KEYWORDS[category] if " " not in t), key=len, reverse=True))), text, flags=re.I))

    rows = with_features(spark.createDataFrame([(i, "", t) for i, t in enumerate(texts)], "i int, sanitized_subject string, sanitized_body string")).orderBy("i").collect()
    for c in C.CATEGORIES:
        assert [r[f"{c}_word_count"] for r in rows] == [plain("\n" + t, c) for t in texts]


def test_keyword_chains_of_long_texts_and_other_terms(spark):
    """No stack for long chains and long texts of other words; terms with characters of their own, at their ends as well."""
    long = ["pin log  in\n" * 50_000, "word " * 100_000 + "fee", "x" * 300_000, "", "--- !", "tax"]
    rows = with_features(spark.createDataFrame([(i, "", t) for i, t in enumerate(long)], "i int, sanitized_subject string, sanitized_body string")).orderBy("i").collect()
    assert [(r["credential_word_count"], r["money_related_word_count"]) for r in rows] == [(100_000, 0), (0, 1), (0, 0), (0, 0), (0, 0), (0, 1)]
    base = {c: ["unheard"] for c in C.CATEGORIES}
    text = "a's b. it's  due, it s due; it's due'; 50% off 5% off 0% off"
    for terms, expected in ((["it's due"], 2), (["it's due", "% off"], 2), (["50% off"], 1)):
        k = C.Keywords(lists=base | {"urgency": terms}, variants={})
        norm = spark.createDataFrame([(text,)], "t string").select(T.variants_normalised(F.col("t"), k).alias("n"))
        assert norm.select(T.keyword_count(F.col("n"), terms)).first()[0] == expected


def test_frozen_model_contract():
    good = {"features": list(C.FEATURES), "labels": {"0": "legitimate", "1": "phishing"}, "threshold": 0.35, "seed": 42}
    assert C.check_frozen_model(good, 0.35) is good
    for key, wrong in (("features", list(C.FEATURES)[::-1]), ("labels", {"0": "phishing", "1": "legitimate"}), ("threshold", 1.2), ("seed", 7)):
        with pytest.raises(C.ContractError, match=key):
            C.check_frozen_model(good | {key: wrong})
    with pytest.raises(C.ContractError, match="threshold"):
        C.check_frozen_model(good | {"threshold": 0.36}, 0.35)


def test_files(spark, tmp_path):
    """Frozen ids, single files and documents, with their faults."""
    known = spark.createDataFrame([(f"i{k}",) for k in range(6)], "email_id string")
    paths = {s: str(tmp_path / f"{s}.csv") for s in C.SPLITS}
    assert files.read_frozen_splits(spark, paths) is None
    for k, s in enumerate(C.SPLITS):
        files.write_csv(known.where(f"email_id in ('i{2 * k}', 'i{2 * k + 1}')"), paths[s], "email_id")
        if k == 0:
            with pytest.raises(C.ContractError, match="missing"):
                files.read_frozen_splits(spark, paths)
    assert open(paths["train"]).read() == "email_id\ni0\ni1\n"
    assert {tuple(r) for r in files.read_frozen_splits(spark, paths, known).collect()} == {(f"i{k}", C.SPLITS[k // 2]) for k in range(6)}
    with pytest.raises(C.ContractError, match="of no row: i4"):
        files.read_frozen_splits(spark, paths, known.where("email_id <> 'i4'"))
    files.write_text(paths["test"], "email_id\ni0\n")
    assert not list(tmp_path.glob(".test.csv.crc"))
    with pytest.raises(C.ContractError, match="more than once: i0"):
        files.read_frozen_splits(spark, paths)
    with pytest.raises(Exception, match="no split for i9"):
        O.assigned(spark.createDataFrame([("i9",)], "email_id string"), spark.createDataFrame([("i0", "test")], "email_id string, split string")).collect()
    files.write_text(str(tmp_path / "a/b.json"), '{"x": 1}', spark)
    assert files.load_json(str(tmp_path / "a/b.json")) == {"x": 1} and files.read_text(str(tmp_path / "a/b.json"), spark) == '{"x": 1}'
    files.write_table(known, str(tmp_path / "t"), "csv")
    files.write_table(known.where("email_id = 'i1'"), str(tmp_path / "t"), "csv")
    assert files.read_processed_csv(spark, str(tmp_path / "t"), "email_id string").count() == 1
    with pytest.raises(C.ContractError, match="probability"):
        files.json_documents(spark.createDataFrame([(1, [(0.5,)])], "id int, x array<struct<probability:double>>"))


def test_streamed_features_are_those_of_a_batch(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"Pay  {i}!", "verify your account at [URL: 198.51.100.7/]") for i in range(20)], "id int, subject string, body string")
    rows.write.parquet(str(tmp_path / "in"))
    stream_features(spark, str(tmp_path / "in"), "id int, subject string, body string", str(tmp_path / "out"), str(tmp_path / "checkpoint")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    want = with_features(rows.withColumns({"sanitized_subject": T.whitespace(F.col("subject")), "sanitized_body": T.whitespace(F.col("body"))}))
    assert got.count() == 20 and O.difference(got.select(*want.columns), want).isEmpty()


def test_command_line(spark, tmp_path, capsys):
    """All commands over one raw CSV: quoted line feeds, words for null, a duplicate and a blank row; then with faults."""
    rng, out = random.Random(2), tmp_path / "out"
    rows = [(f"Offer {i}!" if i % 2 else f"notes {i}", ("verify your account now " if i % 2 else "minutes of the meeting ") + " ".join(rng.choices(["Alpha", "beta", "gamma,", 'say ""hi""', "delta\n"], k=12)), i % 2) for i in range(80)]
    rows += [rows[5], ("", " ", 1), ("NA", "None of it", 0)]
    raw = "\ufefftitle,text,kind\n" + "".join(f'{s},"{b}",{y}\n' for s, b, y in rows)
    (tmp_path / "raw.csv").write_text(raw, encoding="utf-8")
    config = {"raw": str(tmp_path / "raw.csv"), "out": str(out), "columns": {"subject": "title", "body": "text", "label": "kind"}, "labels": {"0": 0, "1": 1}, "expected_rows": 83, "grid": {"max_depth": [2], "learning_rate": [0.1], "n_estimators": [2, 4], "min_child_weight": [1]}}
    path = str(tmp_path / "config.yaml")
    files.write_text(path, yaml.safe_dump(config))
    assert cli.main(["preprocess", path]) == 0, capsys.readouterr().err
    done = spark.read.parquet(str(out / "processed"))
    assert done.count() == 81 and done.where("sanitized_subject = ''").select("sanitized_body").collect()[0][0] == "None of it"
    first = done.where("email_id like 'email_000001_%'").first()
    assert first["sanitized_subject"] == "notes 0" and first["label"] == 0
    summary = (out / "preprocessing_summary.md").read_text()
    assert all(f"- {x}" in summary for x in ("input rows: 83", "blank rows removed: 1", "duplicate groups: 1", "records in duplicate groups: 2", "duplicates removed: 1", "groups of conflicting labels: 0", "output rows: 81"))
    assert [cli.main([c, path]) for c in ("train", "explain", "examples")] == [0, 0, 0], capsys.readouterr().err
    cli.main(["diagnose", path]), cli.main(["leakage", path])
    said = capsys.readouterr().out
    assert "features: " in said and "template leakage: " in said and "rule_violations" in said
    assert all(f"\n{title}\n" in f"\n{said}" for title in ("Stored against recomputed", "Distribution", "Distance between splits", "Pearson", "Spearman", "Verdict")) and "nearly constant" in said
    changed = done.withColumn("url_count", F.when(F.col("email_id").startswith("email_000003_"), 9).otherwise(F.col("url_count")))
    recomputed = {r["feature"]: r["mismatches"] for r in cli._recomputed(changed).collect()}
    assert recomputed == {f: int(f == "url_count") for f in C.FEATURES}
    assert not A.full_verdict(changed, ["uppercase_letter_ratio"], cli._recomputed(changed), 1.1).first()["passed"] and A.full_verdict(done, ["uppercase_letter_ratio"], cli._recomputed(done), 1.1).first()["passed"]
    metrics = files.load_json(str(out / "model_metrics.json"))
    test = pd.read_csv(out / "test_predictions.csv")
    assert list(test.email_id) == sorted(test.email_id) and set(test.outcome_type) <= {"TP", "TN", "FP", "FN"}
    assert metrics["test"]["tp"] == (test.outcome_type == "TP").sum() == metrics["test_outcome_availability"]["by_outcome_type"]["TP"]["count"] and sum(metrics["row_counts"].values()) == 81
    frozen = files.load_json(str(out / "frozen_model_config.json"))
    assert frozen["hyperparameters"]["n_estimators"] in (2, 4) and frozen["feature_order"] == list(C.FEATURES) and frozen["classification_threshold"] in [i / 100 for i in range(30, 71)]
    results = pd.read_csv(out / "validation_results.csv")
    assert list(results.columns) == list(R.RESULT_COLUMNS) and list(results.stage) == ["hyperparameter_search"] * 2 + ["threshold_search"] * 41
    assert results.selected_threshold.sum() == 1 and results[results.selected_threshold].threshold.item() == frozen["classification_threshold"]
    assert results.selected_hyperparameters.sum() == 42 and list(results.candidate_id)[:3] == ["model_01", "model_02", "threshold_0.30"]
    documents = [json.loads(x) for p in (out / "attributions").glob("part-*") for x in p.read_text().splitlines()]
    assert [d["email_id"] for d in documents] == list(test.email_id) and all([f["rank"] for f in d["features"]] == [1, 2, 3] for d in documents)
    frozen = {s: str(out / f"splits/{s}_ids.csv") for s in C.SPLITS}
    files.write_text(path, yaml.safe_dump(config | {"frozen_splits": frozen, "out": str(tmp_path / "again")}))
    assert cli.main(["preprocess", path]) == 0 and O.difference(spark.read.parquet(str(tmp_path / "again/processed")), done).isEmpty()
    files.write_text(path, yaml.safe_dump(config | {"expected_rows": 7}))
    assert cli.main(["preprocess", path]) == 1 and "expected 7 rows" in capsys.readouterr().err
    with pytest.raises(C.ContractError, match="second run differs: email_000003_"):
        cli._check_repeat(done, changed)
    files.write_text(path, yaml.safe_dump(config | {"labels": {"0": 0}}))
    assert cli.main(["preprocess", path]) == 1 and "row 2: 1" in capsys.readouterr().err
    files.write_text(path, yaml.safe_dump(config | {"threshold": 0.123}))
    assert cli.main(["explain", path]) == 1 and "threshold" in capsys.readouterr().err


def test_preprocess_chain_in_plain_python(spark):
    """Full sanitiser, first of each key and counts, by a loop over the documents."""
    from sparkloom.plans import catalog

    sf = "/root/testdata/sf0.001"
    seen, want = set(), {}
    for r in sorted(catalog.canon(spark, sf).collect(), key=lambda r: r["original_row_number"]):
        s, b = S.sanitise_text(r["raw_subject"]), S.sanitise_text(r["raw_body"])
        key = " ".join(f"{s}\n{b}".lower().split())
        if (s or b) and key not in seen:
            seen.add(key)
            text = f"{s}\n{b}"
            letters = re.findall("[A-Za-z]", text)
            words = re.compile(r"(?<![a-z0-9])(?:verify|validate|confirm|update|click|download|submit|provide|enter|review|respond|reply|activate|unlock|restore|renew|upgrade|complete|follow|visit|view)(?![a-z0-9])")
            want[r["email_id"]] = (len(re.findall(r"(?i)\[URL:\s*[^\]\r\n]+\]", text)), len(words.findall(text.lower())), text.count("!"), sum(c.isupper() for c in letters) / len(letters) if letters else 0.0)
    got = catalog.preprocess(spark, sf).collect()
    assert [r["email_id"] for r in got] == sorted(want)
    for r in got:
        assert (r["url_count"], r["action_word_count"], r["exclamation_mark_count"]) == want[r["email_id"]][:3] and abs(r["uppercase_letter_ratio"] - want[r["email_id"]][3]) < 1e-6


def test_entry_and_registry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 3
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_conflicting_labels_end_the_run(spark):
    from sparkloom.plans import catalog

    rows = [(f"m{i}", i, f"text {i}", "body", i % 2) for i in range(120)] + [("again", 200, "TEXT  7", "body ", 0), ("none", 201, "text 8", "body", None), ("same", 202, "text 9", "body", 1)]
    df = spark.createDataFrame(rows, "email_id string, original_row_number long, raw_subject string, raw_body string, label int")
    with pytest.raises(C.ContractError, match="in 1 groups: m7:1, again:0$"):
        catalog.preprocessed(df)


def test_preprocess_refuses_no_documents(spark, tmp_path):
    """One text with two labels, one with a label and none, texts without a label, a repeated row and a repeated number."""
    from sparkloom.plans import catalog

    rows = [(i, f"text {i}", ("en", "de")[i % 2]) for i in range(120)]
    rows += [(200, "TEXT  7", "en"), (201, "text 8", None), (202, "none", None), (203, "de.", "fr"), (204, "De.", "en"), (3, "text 3", "de"), (4, "Text  4", "en"), (4, "of its own", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = catalog.preprocess(spark, str(tmp_path)).collect()
    assert [r["email_id"] for r in got] == sorted({r["email_id"] for r in got})
    by = {r["sanitized_body"].lower(): r for r in got}
    assert len(got) == len(by) == 123 and set(by) == {*(f"text {i}" for i in range(120)), "none", "de.", "of its own"}
    assert {t: (r["label"], r["n_labels"]) for t, r in by.items() if r["n_labels"] != 1} == {"text 7": (0, 2), "de.": (0, 2), "none": (None, 0)}
    assert by["text 8"]["label"] == 1 and by["none"]["split"] == "train" and by["text 3"]["email_id"].startswith("doc_000004_")


def test_features_pass_a_text_once(spark):
    """One pattern goes over the text for the ratio, and each phrase is taken out of what the ones before have left."""
    df = spark.createDataFrame([(None,), ("",), ("12 é!",), ("aBcÉ D9",), ("ZZ",)], "t string")
    assert [r[0] for r in df.select(T.uppercase_ratio(F.col("t"))).collect()] == [0.0, 0.0, 0.0, 0.5, 1.0]
    plan = lambda c: df.select(c.alias("x"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan(T.uppercase_ratio(F.col("t"))).count("regexp_replace(t#") == 1
    terms = C.KEYWORDS["credential"]
    assert plan(T.keyword_count(F.col("t"), terms)).count("regexp_replace(") == sum(" " in t for t in terms)
    rng = random.Random(8)
    texts = ["".join(rng.choice(["log", "in", "sign", "user", "id", "pin", "access code", "x"]) + rng.choice([" ", "  ", "\0", "-"]) for _ in range(rng.randrange(12))) for _ in range(200)]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.keyword_count(F.col("t"), terms)).collect()
    for t, n in got:
        want, left = 0, t
        for p in sorted((t for t in terms if " " in t), key=lambda t: (-len(t.split()), -len(t), t)):
            left, k = re.subn(rf"(?<![a-z0-9]){p.replace(' ', r'[ ]+')}(?![a-z0-9])", " ", left)
            want += k
        assert n == want + sum(w in terms for w in re.split("[^a-z0-9]+", left)), t


def test_run_counts_are_observed(spark):
    from sparkloom.plans import catalog

    rng, counts = random.Random(4), {}
    rows = [(f"m{i}", i, s, "", int(s.strip() < "t")) for i, s in enumerate(rng.choice(["", "  \n", *(f"{c} {c}" for c in "abcdefghijklmnopqrstuvwxyz")]) + rng.choice(["", " "]) for _ in range(150))]
    out = catalog.preprocessed(spark.createDataFrame(rows, "email_id string, original_row_number long, raw_subject string, raw_body string, label int"), counts=counts)
    by: dict = {}
    for _, _, s, _, _ in rows:
        if s.strip():
            by[s.strip()] = by.get(s.strip(), 0) + 1
    many = [n for n in by.values() if n > 1]
    assert counts == {"input": 150, "blank": 150 - sum(by.values()), "duplicate_groups": len(many), "duplicate_records": sum(many), "removed": sum(many) - len(many), "conflicting_groups": 0, "output": len(by)}
    assert out.count() == len(by)


def test_split_keeps_rows_without_label(spark):
    rows = [(f"r{i}", (0, 1, None)[i % 3]) for i in range(90)]
    got = O.stratified_split(spark.createDataFrame(rows, "email_id string, label int")).collect()
    assert {r["email_id"]: r["label"] for r in got} == dict(rows)
    assert {(y, s): sum((r["label"], r["split"]) == (y, s) for r in got) for y in (0, 1, None) for s in C.SPLITS} == {(y, s): n for y in (0, 1, None) for s, n in zip(C.SPLITS, (21, 5, 4), strict=True)}


def test_release_forgets_frames_over_what_it_removes(spark):
    from sparkloom.plans import catalog
    from sparkloom.sources import scratch

    kept = scratch.scratch(spark.range(3), "kept")
    catalog._fitted["key"] = (None, kept)
    assert scratch.release(spark) >= 1 and not catalog._fitted
