"""LM scoring: prediction by partial matching over a byte trie of order four, next to a word-unigram base score.

The trie has the contexts of 0 to ORDER bytes (and a boundary symbol before and after a text) with their symbol counts
over the training documents. A symbol's probability is the one of method C: from the longest context seen,
count / (total + distinct); an escape costs distinct / (total + distinct) and leads to the next shorter context, in which
every symbol of the context just left is excluded. As a longer context's symbols are always among the shorter one's,
what is excluded depends on the context left alone. So a context's node holds all that scoring needs: its total, its
distinct symbols, their counts, and the denominator and escape of its parent once its own symbols are excluded.

Counts are rows, summed by shuffle, and grow with the corpus. The contexts of two bytes and less are one table of
257**3 floats (68 MB, a proven bound), which every worker has. Of the longer ones, every worker has the nodes of the most
frequent contexts, whole, with HOT_EDGES counts a length at most (a proven bound). A symbol in any other context is a
row, with what is known of it by its shorter contexts, and is joined to its node by shuffle.

Base score: add-0.1 unigram model of lower-cased words with one end per text. Counts of the whole training corpus
are shuffled by word; the most frequent (at most HOT_WORDS, a proven bound) are also broadcast and summed where
the text is read, the others are rows joined by shuffle.

Defined results: a null text is the empty text (its end alone is scored); a null doc_id counts as the empty text in
the fold; with no training document every symbol has probability 1/257 and the base formula holds with zero counts;
repeated rows give a row each; other columns are ignored.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkloom.llm import common

SYMBOLS, BOUNDARY, ORDER = 257, 256, 4
FLUSH_WORDS, FLUSH_GRAMS, PIECE = 200_000, 1_000_000, 1 << 20
#: Symbol counts of frequent contexts of one length that every worker has: some 40 MB with their index.
HOT_EDGES = 1 << 20
MASK = (1 << 64) - 1


def pieces(texts: list[bytes]):
    """(grams, document) of the symbols of texts, at most some PIECE of them at a time: a gram is the number of a symbol
    with the ORDER symbols before it, document the place of its text in the list."""
    held, size = [], 0

    def flush():
        grams, docs = [], []
        for doc, x in held:
            g = np.zeros(len(x) - ORDER, np.int64)
            for i in range(ORDER + 1):
                g *= SYMBOLS
                g += x[i : len(x) - ORDER + i]
            grams.append(g)
            docs.append(np.full(len(g), doc))
        return np.concatenate(grams), np.concatenate(docs)

    for doc, text in enumerate(texts):
        x = np.full(len(text) + ORDER + 1, BOUNDARY, np.uint16)
        x[ORDER:-1] = np.frombuffer(text, np.uint8)
        for at in range(0, len(text) + 1, PIECE):
            held.append((doc, x[at : at + PIECE + ORDER]))
            size += len(held[-1][1])
            if size > PIECE:
                yield flush()
                held, size = [], 0
    if held:
        yield flush()


class Index:
    """Places of distinct numbers, in hash tables a quarter full; one whose slot is taken goes to the next table."""

    def __init__(self, keys: np.ndarray) -> None:
        self.keys, self.tables = keys, []
        left = np.arange(len(keys), dtype=np.int32)
        while len(left):
            table = np.full(1 << max(4, (4 * len(left) - 1).bit_length()), -1, np.int32)
            slot = self._slot(keys[left], len(self.tables), len(table))
            table[slot] = left
            self.tables.append(table)
            left = left[table[slot] != left]

    @staticmethod
    def _multiplier(level: int) -> int:
        """Odd; the tables' multipliers are unrelated (SplitMix64), so that keys which meet in one do not meet in all others."""
        x = 0x9E3779B97F4A7C15 * (level + 1) & MASK
        if level:
            x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & MASK
            x = (x ^ x >> 27) * 0x94D049BB133111EB & MASK
            x ^= x >> 31
        return x | 1

    @classmethod
    def _slot(cls, keys: np.ndarray, level: int, size: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            h = keys.view(np.uint64) * np.uint64(cls._multiplier(level))
            return (h >> np.uint64(65 - size.bit_length())).view(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key, -1 of those that are not there."""
        out, todo = np.full(len(keys), -1, np.int32), None
        for level, table in enumerate(self.tables):
            asked = keys if todo is None else keys[todo]
            at = table[self._slot(asked, level, len(table))]
            taken = at >= 0
            same = taken & (self.keys[at] == asked)
            if todo is None:
                out = np.where(same, at, np.int32(-1))
                todo = np.flatnonzero(taken & ~same)
            else:
                out[todo[same]] = at[same]
                todo = todo[taken & ~same]
            if not len(todo):
                break
        return out


def short_contexts(grams: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The model of contexts of two symbols and less, from trigram counts.

    [before, last, symbol], flattened: log10 of the symbol's count if it was seen after the two (0 or more), else log10
    of its probability after the last alone, without the symbols seen after the two (less than 0). [before, last]: log10
    of the context's denominator, and of its escape; both 0 where the context was never seen.
    """
    n = SYMBOLS
    grams, counts = grams.astype(np.int64), counts.astype(np.float64)
    pair_symbol, symbol = grams % (n * n), grams % n
    c1 = np.bincount(symbol, counts, n)
    c2 = np.bincount(pair_symbol, counts, n * n).reshape(n, n)
    seen1, q0, total = c1 > 0, int((c1 > 0).sum()), c1.sum()
    denominators, escapes = np.zeros(n * n), np.zeros(n * n)
    with np.errstate(divide="ignore", invalid="ignore"):
        rest = -math.log10(n - q0) if q0 < n else -np.inf

        def order0(excluded: np.ndarray) -> np.ndarray:
            left, distinct = total - c1[excluded].sum(), q0 - int(excluded.sum())
            if distinct <= 0:
                return np.full(n, rest)
            out = np.where(seen1, np.log10(c1 / (left + distinct)), np.log10(distinct / (left + distinct)) + rest)
            return out

        def order1(last: int, excluded: np.ndarray) -> np.ndarray:
            seen, lower = c2[last] > 0, lower0[last]
            if not seen.any():
                return lower
            left, distinct = c2[last].sum() - c2[last][excluded].sum(), int(seen.sum()) - int(excluded.sum())
            if distinct <= 0:
                return lower
            return np.where(seen, np.log10(c2[last] / (left + distinct)), np.log10(distinct / (left + distinct)) + lower)

        nothing = np.zeros(n, bool)
        lower0 = np.stack([order0(c2[b] > 0) if c2[b].any() else order0(nothing) for b in range(n)])
        table = np.empty((n * n, n), np.float32)
        table.reshape(n, n, n)[:] = np.minimum(np.stack([order1(b, nothing) for b in range(n)]), -1e-30)[None]
        order = np.argsort(grams, kind="stable")
        context, symbols, counts = grams[order] // n, symbol[order], counts[order]
        starts = np.flatnonzero(np.r_[True, context[1:] != context[:-1]]) if len(context) else np.empty(0, int)
        for a, b in zip(starts, np.r_[starts[1:], len(context)][: len(starts)], strict=True):
            c, seen, own = int(context[a]), symbols[a:b], counts[a:b]
            excluded = nothing.copy()
            excluded[seen] = True
            left, distinct = own.sum(), len(seen)
            row = np.minimum(order1(c % n, excluded), -1e-30)
            row[seen] = np.log10(own)
            table[c] = row
            denominators[c], escapes[c] = math.log10(left + distinct), math.log10(distinct / (left + distinct))
    return table.ravel(), denominators, escapes


class Nodes:
    """The nodes of frequent contexts of one length."""

    def __init__(self, columns: dict[str, np.ndarray]) -> None:
        self.index, self.edges = Index(columns["c"]), Index(columns["g"])
        self.own, self.escape, self.parent, self.parent_escape = (columns[k] for k in ("own", "own_esc", "den", "esc"))
        self.log_n = np.log10(columns["n"].astype(np.float64))
        self.log_p = self.log_n - self.own[self.index.find(columns["g"] // SYMBOLS)] if len(columns["g"]) else self.log_n


class Trie:
    def __init__(self, short: tuple[np.ndarray, np.ndarray], three: dict, four: dict) -> None:
        self.table, self.own, self.escape = short_contexts(*short)
        self.three, self.four = Nodes(three), Nodes(four)

    def score(self, grams: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        """log10 probabilities, 0 for symbols of contexts not held here; and for these: place, level (the length of the
        context to look up), v (value if it was never seen), a (log10 of the symbol's count in the context one shorter,
        NaN if none), w (its value below, without that one's symbols)."""
        found = self.four.edges.find(grams)
        out = np.zeros(len(grams))
        hit = found >= 0
        out[hit] = self.four.log_p[found[hit]]
        at = np.flatnonzero(~hit)
        g = grams[at]
        low = self.table[g % SYMBOLS**3].astype(np.float64)
        c2 = g % SYMBOLS**3 // SYMBOLS
        seen2 = low >= 0
        v2 = np.where(seen2, low - self.own[c2], self.escape[c2] + low)
        j3, j4 = self.three.index.find(g % SYMBOLS**4 // SYMBOLS), self.four.index.find(g // SYMBOLS)
        i3 = self.three.edges.find(g % SYMBOLS**4)
        if len(self.three.own):
            w3 = np.where(seen2, low - self.three.parent[j3], self.three.parent_escape[j3] + low)
            a3 = np.where(i3 >= 0, self.three.log_n[i3], np.nan)
            v3 = np.where(i3 >= 0, a3 - self.three.own[j3], self.three.escape[j3] + w3)
        else:
            w3 = a3 = v3 = np.full(len(g), np.nan)
        whole = j4 >= 0
        if whole.any():
            j = j4[whole]
            out[at[whole]] = self.four.escape[j] + np.where(i3[whole] >= 0, a3[whole] - self.four.parent[j], self.four.parent_escape[j] + w3[whole])
        rest, three = ~whole, j3 >= 0
        ask = {
            "place": at, "level": np.where(three, 4, 3), "v": np.where(three, v3, v2), "a": np.where(three, a3, np.where(seen2, low, np.nan)), "w": np.where(three, w3, low)
        }
        return out, {k: x[rest] for k, x in ask.items()}


_tries: dict[str, Trie] = {}


def _trie_of(broadcast, tag: str) -> Trie:
    if tag not in _tries:
        _tries.clear()
        _tries[tag] = Trie(*broadcast.value)
    return _tries[tag]


def _train(batches):
    words: Counter = Counter()
    grams, counts = np.empty(0, np.int64), np.empty(0, np.int64)

    def rows(w, g, n):
        return pa.record_batch({"w": pa.array(w, pa.binary()), "g": pa.array(g, pa.int64()), "n": pa.array(n, pa.int64())})

    def flush():
        out = rows(list(words.keys()), [None] * len(words), list(words.values()))
        words.clear()
        return out

    for batch in batches:
        texts = [t.lower() for t in batch.column("text").to_pylist()]
        for text in texts:
            words.update(text.split())
            if len(words) > FLUSH_WORDS:
                yield flush()
        for new, _ in pieces(texts):
            new, n = np.unique(np.concatenate([new, grams]), return_counts=True)
            n[np.searchsorted(new, grams)] += counts - 1
            grams, counts = new, n
            if len(grams) > FLUSH_GRAMS:
                yield rows([None] * len(grams), grams, counts)
                grams, counts = grams[:0], counts[:0]
    yield flush()
    yield rows([None] * len(grams), grams, counts)


SCORED = "uid long, doc_id long, held_out boolean, n_tokens long, n_known long, known_sum double, score double, word binary, g long, level int, n long, v double, a double, w double"
_ARROW = pa.schema([
    ("uid", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("known_sum", pa.float64()), ("score", pa.float64()),
    ("word", pa.binary()), ("g", pa.int64()), ("level", pa.int32()), ("n", pa.int64()), ("v", pa.float64()), ("a", pa.float64()), ("w", pa.float64()),
])


def _rows(size: int, /, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type, from_pandas=True) if f.name in columns else pa.nulls(size, f.type) for f in _ARROW], schema=_ARROW)


def _score(hot, trie, tag):
    """A row for each document, and rows of what is left to look up: words (word, n) and grams (g, level, n, v, a, w)."""

    def run(batches):
        known, model, ids = hot.value, _trie_of(trie, tag), common.RowIds()
        for batch in batches:
            texts = [t.lower() for t in batch.column("text").to_pylist()]
            uid = np.array(ids.take(len(texts)), np.int64)
            n_tokens, n_known, known_sum, score = (np.zeros(len(texts), t) for t in (np.int64, np.int64, float, float))
            rest, rest_uid, rest_n = [], [], []
            for i, text in enumerate(texts):
                words = text.split()
                n_tokens[i] = len(words) + 1
                for word, times in Counter(words).items():
                    log = known.get(word)
                    if log is None:
                        rest.append(word)
                        rest_uid.append(uid[i])
                        rest_n.append(times)
                    else:
                        n_known[i] += times
                        known_sum[i] += times * log
                if len(rest) > FLUSH_WORDS:
                    yield _rows(len(rest), uid=rest_uid, word=rest, n=rest_n)
                    rest, rest_uid, rest_n = [], [], []
            yield _rows(len(rest), uid=rest_uid, word=rest, n=rest_n)
            for grams, doc in pieces(texts):
                logs, ask = model.score(grams)
                score += np.bincount(doc, logs, len(texts))
                at = ask.pop("place")
                _, first, times = np.unique(grams[at] + doc[at] * SYMBOLS ** (ORDER + 1), return_index=True, return_counts=True)
                yield _rows(len(first), uid=uid[doc[at][first]], g=grams[at][first], n=times, **{k: x[first] for k, x in ask.items()})
            yield _rows(len(texts), uid=uid, doc_id=batch.column("doc_id"), held_out=batch.column("held_out"), n_tokens=n_tokens, n_known=n_known, known_sum=known_sum, score=score)

    return run


def _edges(longer: DataFrame, length: int) -> DataFrame:
    """g, n of grams of `length` symbols, from longer ones."""
    return longer.groupBy((F.col("g") % SYMBOLS**length).alias("g")).agg(F.sum("n").alias("n"))


def _context(g: str) -> Column:
    return F.expr(f"{g} div {SYMBOLS}")


def _nodes(edges: DataFrame, shorter: DataFrame, length: int) -> DataFrame:
    """The nodes of contexts of `length` symbols: c, t and d (total and distinct), own and own_esc (log10 of denominator
    and escape), den and esc (the parent's, without the node's symbols), edges (symbol, n)."""
    own = Window.partitionBy(_context("g"))  # at most 257 rows
    parents = shorter.select(F.col("g").alias("pg"), F.col("n").alias("pn"), F.sum("n").over(own).alias("pt"), F.count("*").over(own).alias("pd"))
    joined = edges.join(parents, F.col("g") % SYMBOLS**length == F.col("pg"))
    nodes = joined.groupBy(_context("g").alias("c")).agg(
        F.sum("n").alias("t"), F.count("*").alias("d"), F.first("pt").alias("pt"), F.first("pd").alias("pd"), F.sum("pn").alias("x"), F.collect_list(F.struct((F.col("g") % SYMBOLS).cast("int").alias("s"), "n")).alias("edges")
    )
    left, distinct = F.col("pt") - F.col("x") + F.col("pd") - F.col("d"), F.col("pd") - F.col("d")
    log = lambda x: F.log10(x.cast("double"))
    none = distinct <= 0  # then a symbol that is not the node's is not the parent's either
    total = F.col("t") + F.col("d")
    return nodes.select("c", "t", "d", log(total).alias("own"), (log(F.col("d")) - log(total)).alias("own_esc"), F.when(none, 0.0).otherwise(log(left)).alias("den"), F.when(none, 0.0).otherwise(log(distinct) - log(left)).alias("esc"), "edges")


def _lowest_step(nodes: DataFrame, most: int) -> int:
    """The lowest frequency step whose contexts, with all more frequent ones, have at most `most` edges."""
    total, lowest = 0, 1 << 30
    steps = nodes.groupBy(common.frequency_step(F.col("t")).alias("step")).agg(F.sum("d").alias("d")).collect()
    for row in sorted(steps, key=lambda r: -r["step"]):
        total += row["d"]
        if total > most:
            break
        lowest = row["step"]
    return lowest


def _columns(nodes: DataFrame) -> dict[str, np.ndarray]:
    names = ["c", "own", "own_esc", "den", "esc"]
    own = nodes.select(*names).toArrow()
    edges = nodes.select("c", F.explode("edges").alias("e")).select((F.col("c") * SYMBOLS + F.col("e.s")).alias("g"), "e.n").toArrow()
    return {k: t.column(k).to_numpy() for t, ks in ((own, names), (edges, ["g", "n"])) for k in ks}


def _resolve(asked: DataFrame, nodes: DataFrame, length: int) -> DataFrame:
    """asked (uid, g, n, v, a, w) one context longer: looked up in the nodes of that length, unseen contexts left as they are."""
    context, symbol = F.expr(f"g % {SYMBOLS ** (length + 1)} div {SYMBOLS}"), F.col("g") % SYMBOLS
    count = F.get(F.filter("edges", lambda e: e["s"] == symbol), F.lit(0))["n"]
    found = asked.join(nodes.select("c", "own", "own_esc", "den", "esc", "edges"), context == F.col("c"), "left").withColumn("count", count)
    below = F.when(F.col("a").isNotNull(), F.col("a") - F.col("den")).otherwise(F.col("esc") + F.col("w"))
    a = F.log10(F.col("count").cast("double"))
    value = F.when(F.col("c").isNull(), F.col("v")).when(F.col("count").isNotNull(), a - F.col("own")).otherwise(F.col("own_esc") + below)
    return found.select("uid", "g", "n", value.alias("v"), a.alias("a"), below.alias("w"), F.col("c").isNotNull().alias("known"))


def score_documents(docs: DataFrame, held_out_of: int = 10, hot_words: int = common.HOT_WORDS, hot_edges: int = HOT_EDGES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row of docs (doc_id, text)."""
    spark = docs.sparkSession
    common.bounded_batches(spark)
    rows = docs.select(
        common.col("doc_id").cast("long").alias("doc_id"), common.text_of().cast("binary").alias("text"), (common.id_remainder(common.col("doc_id"), held_out_of) == 0).alias("held_out")
    )
    train = rows.where(~F.col("held_out"))
    counted = train.select("text").mapInArrow(_train, "w binary, g long, n long").groupBy("w", "g").agg(F.sum("n").alias("freq"))
    counted = common.table(counted, "ppm-counts")
    lexicon = counted.where(F.col("w").isNotNull()).select("w", "freq")
    words, distinct = lexicon.agg(F.coalesce(F.sum("freq"), F.lit(0)), F.count("*")).first()
    ends = train.count()
    n, v = words + ends, distinct + (ends > 0)
    norm, end_log = math.log10(n + 0.1 * (v + 1)), math.log10(ends + 0.1)

    edges4 = counted.where(F.col("g").isNotNull()).select("g", F.col("freq").alias("n"))
    edges3 = common.table(_edges(edges4, 4), "ppm-edges")
    edges2 = common.table(_edges(edges3, 3), "ppm-edges")
    nodes4, nodes3 = common.table(_nodes(edges4, edges3, 4), "ppm-nodes"), common.table(_nodes(edges3, edges2, 3), "ppm-nodes")
    low3 = _lowest_step(nodes3, hot_edges)
    low4 = max(low3, _lowest_step(nodes4, hot_edges))  # so that a frequent context's parent is one, too
    often = lambda nodes, low: common.frequency_step(F.col("t")) >= low
    grams = edges2.toArrow()  # at most 257**3 rows
    trie = spark.sparkContext.broadcast(((grams.column("g").to_numpy(), grams.column("n").to_numpy()), _columns(nodes3.where(often(nodes3, low3))), _columns(nodes4.where(often(nodes4, low4)))))

    lowest = common.hot_step(lexicon, hot_words)
    step = common.frequency_step(F.col("freq"))
    top = lexicon.where(step >= lowest).toArrow()
    hot = spark.sparkContext.broadcast(dict(zip(top.column("w").to_pylist(), np.log10(top.column("freq").to_numpy() + 0.1).tolist(), strict=True)))
    found = common.table(rows.mapInArrow(_score(hot, trie, uuid.uuid4().hex), SCORED), "ppm-scores")
    scored = found.where("n_tokens is not null").select("uid", "doc_id", "held_out", "n_tokens", "n_known", "known_sum", "score")

    log = F.log10(F.coalesce(F.col("freq"), F.lit(0)) + F.lit(0.1))
    rare = found.where("word is not null").select("uid", F.col("word").alias("w"), "n").join(lexicon.where(step < lowest), "w", "left")
    rare = rare.select("uid", (F.col("n") * log).alias("s"), F.when(F.col("freq").isNotNull(), F.col("n")).otherwise(0).alias("k"), F.lit(0.0).alias("m"))
    asked = found.where("g is not null").select("uid", "g", "n", "v", "a", "w", "level")
    short = _resolve(asked.where("level = 3"), nodes3.where(~often(nodes3, low3)), 3)
    longer = asked.where("level = 4").drop("level").unionByName(short.where("known").drop("known"))
    # a context whose own end was never seen was never seen itself
    values = _resolve(longer, nodes4.where(~often(nodes4, low4)), 4).select("uid", "n", "v").unionByName(short.where(~F.col("known")).select("uid", "n", "v"))
    values = values.select("uid", F.lit(0.0).alias("s"), F.lit(0).cast("long").alias("k"), (F.col("n") * F.col("v")).alias("m"))
    rest = rare.unionByName(values).groupBy("uid").agg(F.sum("s").alias("rest_sum"), F.sum("k").alias("rest_known"), F.sum("m").alias("rest_score"))
    base = F.col("known_sum") + F.coalesce("rest_sum", F.lit(0.0)) + F.lit(end_log) - F.col("n_tokens") * F.lit(norm)
    return scored.join(rest, "uid", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("rest_known", F.lit(0)) + F.lit(int(ends > 0))).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"), base.alias("base_score"),
        (F.col("score") + F.coalesce("rest_score", F.lit(0.0))).alias("score"),
    )


def op8_ppm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
