"""Token counts: pieces are counted once per distinct pre-token and joined to per-document frequencies.

No ids are materialised. A first pass counts distinct pre-tokens of the whole corpus; each is encoded once and
keeps only its number of pieces. A second pass takes each document's pre-token frequencies: those of frequent
pre-tokens (at most HOT_WORDS of them, a proven bound) are summed against a broadcast dictionary, all others are
rows joined to the lexicon by shuffle, so the result is exact whatever the vocabulary's size.

Defined results: a null text is the empty text (0 bytes, 0 tokens); repeated rows give a row each; an empty table
gives no rows; columns other than doc_id and text are ignored, whatever their names.
"""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm import common
from sparkloom.llm.pretok import default_path, pre_tokenizer

FLUSH = 200_000


def _distinct(path):
    def run(batches):
        tok, counts = pre_tokenizer(path), Counter()

        def flush():
            out = pa.record_batch({"pre": pa.array(counts.keys(), pa.string()), "n": pa.array(counts.values(), pa.int64())})
            counts.clear()
            return out

        for batch in batches:
            for text in batch.column(0).to_pylist():
                counts.update(tok.split(text))
                if len(counts) > FLUSH:
                    yield flush()
        yield flush()

    return run


def _pieces(path):
    def run(batches):
        tok = pre_tokenizer(path)
        for batch in batches:
            pieces = tok.lengths(batch.column("pre").to_pylist())
            yield pa.record_batch({"pre": batch.column("pre"), "freq": batch.column("freq"), "pieces": pa.array(pieces, pa.int32())})

    return run


RARE = pa.list_(pa.struct([("pre", pa.string()), ("n", pa.int32())]))


def _document_sums(path, hot):
    def run(batches):
        tok, known = pre_tokenizer(path), hot.value
        ids = common.RowIds()
        for batch in batches:
            sums, rare = [], []
            for text in batch.column("text").to_pylist():
                total, rest = 0, []
                for word, n in Counter(tok.split(text)).items():
                    pieces = known.get(word)
                    if pieces is None:
                        rest.append((word, n))
                    else:
                        total += n * pieces
                sums.append(total)
                rare.append([{"pre": w, "n": n} for w, n in rest])
            yield pa.record_batch({
                "uid": pa.array(ids.take(len(sums)), pa.int64()), "doc_id": batch.column("doc_id"), "n_bytes": batch.column("n_bytes"),
                "known": pa.array(sums, pa.int64()), "rare": pa.array(rare, RARE),
            })

    return run


def lexicon(docs: DataFrame, path: str) -> DataFrame:
    """Distinct pre-tokens of all texts with their frequency and number of pieces, as a scratch table."""
    counted = docs.select(common.text_of().alias("text")).mapInArrow(_distinct(path), "pre string, n long")
    words = counted.groupBy("pre").agg(F.sum("n").alias("freq"))
    return common.table(words.mapInArrow(_pieces(path), "pre string, freq long, pieces int"), "lexicon")


def count_tokens(docs: DataFrame, path: str | None = None, limit: int = 2048, hot_words: int = common.HOT_WORDS) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row of docs (doc_id, text)."""
    spark, path = docs.sparkSession, path or default_path()
    common.bounded_batches(spark)
    words = lexicon(docs, path)
    lowest = common.hot_step(words, hot_words)
    step = common.frequency_step(F.col("freq"))
    hot = spark.sparkContext.broadcast({r[0]: r[1] for r in words.where(step >= lowest).select("pre", "pieces").toArrow().to_pandas().itertuples(index=False)})
    text = common.text_of()
    sums = common.table(
        docs.select(common.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes"))
        .mapInArrow(_document_sums(path, hot), "uid long, doc_id long, n_bytes long, known long, rare array<struct<pre:string,n:int>>"),
        "token-sums",
    )
    rare = sums.select("uid", F.explode("rare").alias("r")).select("uid", "r.pre", "r.n")
    rest = rare.join(words.where(step < lowest).select("pre", "pieces"), "pre").groupBy("uid").agg(F.sum(F.col("n") * F.col("pieces")).alias("rest"))
    n_tokens = F.col("known") + F.coalesce(F.col("rest"), F.lit(0))
    return (
        sums.select("uid", "doc_id", "n_bytes", "known").join(rest, "uid", "left")
        .select("doc_id", "n_bytes", n_tokens.alias("n_tokens"), (n_tokens > limit).alias("over_limit"))
    )


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"))
