"""Fill-in-the-middle transformation of texts, by Spark SQL functions alone.

A text is an array of units (runs of letters, single other characters), cut at two places that a digest of seed and
doc_id chooses; the parts are put together in one of two orders with a sentinel before each, or the text stays plain.
Which it is, and where the cuts are, depends on seed, doc_id and text only. A text that is empty or holds a sentinel
stays plain, so an output is read back from itself and its form: sentinels occur once each, where they were set.

Defined results: a null text is empty; the digest of a null doc_id is that of the seed alone; rows that repeat are
transformed alike, each to a row; an empty table gives no rows; other columns, whatever their names, are left out. No
row meets another, so hot keys and groups of copies cost nothing; a long text is one row's work.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm import common

UNIT = "[A-Za-z]+|[^A-Za-z]"
#: Sentinels before the prefix, the suffix and the middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Per cent of texts that are transformed, and of these the ones whose suffix comes first.
RATE, SUFFIX_FIRST, SEED = 90, 20, 1


def _draw(digest: Column, i: int) -> Column:
    """The i-th group of eight hex digits as a number."""
    return F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long")


def _joined(units: Column, start: Column, n: Column) -> Column:
    return F.array_join(F.slice(units, start + 1, n), "")


def fill_in_middle(docs: DataFrame, seed: int = SEED, rate: int = RATE, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """doc_id, n (units), form (plain, psm, spm), prefix, middle, suffix (null if plain), output of docs (doc_id, text)."""
    text, doc_id = common.text_of(), common.col("doc_id").cast("long")
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    # each step is a projection of its own: what is used more than once is computed once
    rows = docs.select(doc_id.alias("doc_id"), text.alias("text"), F.regexp_extract_all(text, F.lit(UNIT), F.lit(0)).alias("units"), digest.alias("digest"))
    rows = rows.select("doc_id", "text", "units", F.size("units").cast("long").alias("n"), *(_draw(F.col("digest"), i).alias(f"h{i + 1}") for i in range(4)))
    cuts = [F.col(h) % (F.col("n") + 1) for h in ("h1", "h2")]
    plain = (F.col("n") == 0) | (F.col("h3") % 100 >= rate)
    for sentinel in (PREFIX, SUFFIX, MIDDLE):
        plain = plain | F.contains("text", F.lit(sentinel))
    rows = rows.select("doc_id", "text", "units", "n", F.least(*cuts).cast("int").alias("a"), F.greatest(*cuts).cast("int").alias("b"), F.when(plain, "plain").when(F.col("h4") % 100 < suffix_first, "spm").otherwise("psm").alias("form"))
    a, b, n, whole = F.col("a"), F.col("b"), F.col("n").cast("int"), F.col("form") == "plain"
    parts = {"prefix": _joined(F.col("units"), F.lit(0), a), "middle": _joined(F.col("units"), a, b - a), "suffix": _joined(F.col("units"), b, n - b)}
    rows = rows.select("doc_id", "text", "n", "form", *(F.when(~whole, part).alias(name) for name, part in parts.items()))
    said = {"prefix": F.concat(F.lit(PREFIX), "prefix"), "suffix": F.concat(F.lit(SUFFIX), "suffix"), "middle": F.concat(F.lit(MIDDLE), "middle")}
    orders = {"psm": ("prefix", "suffix", "middle"), "spm": ("suffix", "prefix", "middle")}
    output = F.when(whole, F.col("text"))
    for form, order in orders.items():
        output = output.when(F.col("form") == form, F.concat(*(said[part] for part in order)))
    return rows.select("doc_id", "n", "form", "prefix", "middle", "suffix", output.alias("output"))


def restored(output: Column, form: Column) -> Column:
    """The text of an output: what follows each sentinel up to the next one, in the text's order."""
    after = lambda x, sentinel: F.substring_index(x, sentinel, -1)
    before = lambda x, sentinel: F.substring_index(x, sentinel, 1)
    head, middle = before(output, MIDDLE), after(output, MIDDLE)
    psm = F.concat(after(before(head, SUFFIX), PREFIX), middle, after(head, SUFFIX))
    spm = F.concat(after(head, PREFIX), middle, after(before(head, PREFIX), SUFFIX))
    return F.when(form == "plain", output).when(form == "psm", psm).when(form == "spm", spm)


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fill_in_middle(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return rows.select(
        "doc_id", "n", "form", F.length("prefix").cast("long").alias("prefix_chars"), F.length("middle").cast("long").alias("middle_chars"),
        F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )
