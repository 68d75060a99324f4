"""Secret scan with corpus-wide ownership frequency, in DataFrame and SQL functions only.

Base candidates are regular expressions; places come from the texts between matches (split) and the matches
themselves, both in order. Each candidate's value is hashed, and the hashes of the whole corpus are aggregated by
distinct (owner, repository): a value in at least SHARED_OWNERS owners' texts is a widely copied example, any other is
specific to its owner and looks live. Opaque tokens (long, with digits and both cases) are candidates too, but only
owner-specific ones outside base spans become spans, of kind `opaque`.

Defined results: a null text is the empty text; a null owner or repository counts as the empty one; repeated rows
give a row each; spans are code points, end exclusive; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm import common

ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_LEAST = 8
#: A maximal run is the base pattern's match, so a least length in the pattern drops just the failing matches.
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
OPAQUE = r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z0-9+/_-]{24})(?=[A-Za-z+/_-]*[0-9])(?=[0-9a-z+/_-]*[A-Z])(?=[0-9A-Z+/_-]*[a-z])[A-Za-z0-9+/_-]+"
KINDS = ("assign", "access", "hex", "opaque")
SHARED_OWNERS = 3
SPAN = "array<struct<s:int,k:int,e:int,v:string>>"
#: Matches whose places are summed before they join the others'.
RUN = 256


def _spans(text: Column, pattern: str, kind: int, group: int) -> Column:
    """Spans of the pattern's matches in order: (start, kind, end, value)."""
    p = F.lit(pattern)
    gaps, whole, value = F.split(text, pattern, -1), F.regexp_extract_all(text, p, F.lit(0)), F.regexp_extract_all(text, p, F.lit(group))
    steps = F.zip_with(F.zip_with(F.slice(gaps, F.lit(1), F.size(whole)), whole, lambda g, m: F.struct(F.length(g).alias("g"), F.length(m).alias("m"))), value, lambda x, v: F.struct(x["g"].alias("g"), x["m"].alias("m"), v.alias("v")))
    none = F.array().cast(SPAN)

    def one(a: Column, x: Column) -> Column:
        start, end = a["at"] + x["g"], a["at"] + x["g"] + x["m"]
        span = F.struct(start.alias("s"), F.lit(kind).alias("k"), end.alias("e"), x["v"].alias("v"))
        return F.struct(end.alias("at"), F.concat(a["out"], F.array(span)).cast(SPAN).alias("out"))

    def runs(all_steps: Column) -> Column:
        """Places by runs of RUN matches: an array that grew by one match a step would cost the square of their number."""

        def run(a: Column, first: Column) -> Column:
            inner = F.aggregate(F.slice(all_steps, first, F.lit(RUN)), F.struct(a["at"].alias("at"), none.alias("out")), one)
            joined = lambda i: F.struct(i["at"].alias("at"), F.concat(a["out"], F.array(i["out"])).cast(f"array<{SPAN}>").alias("out"))
            return F.get(F.transform(F.array(inner), joined), F.lit(0))

        firsts = F.sequence(F.lit(1), F.greatest(F.size(all_steps), F.lit(1)), F.lit(RUN))
        return F.aggregate(firsts, F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SPAN}>").alias("out")), run, lambda a: F.flatten(a["out"]))

    found = F.get(F.transform(F.array(steps), runs), F.lit(0))
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast(SPAN))


def _joined(spans: Column) -> Column:
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(F.array_sort(spans), lambda x: F.concat_ws(":", F.element_at(kinds, x["k"] + 1), x["s"].cast("string"), x["e"].cast("string"))), ",")


def scan(docs: DataFrame, owner: str = "source", repository: str = "doc_id") -> DataFrame:
    """A row for every row of docs (doc_id, text, owner, repository): doc_id, n_assign, n_access, n_hex, base_sha256,
    spans, n_live, n_shared (candidates with an owner-specific or a widely copied value)."""
    text = common.text_of()
    held = docs.select(
        common.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("tie"), F.coalesce(common.col(owner).cast("string"), F.lit("")).alias("owner"), F.coalesce(common.col(repository).cast("string"), F.lit("")).alias("repository"),
        F.filter(_spans(text, ASSIGN, 0, 1), lambda x: F.length(x["v"]) >= ASSIGN_LEAST).alias("assign"), _spans(text, ACCESS, 1, 0).alias("access"), _spans(text, HEX, 2, 0).alias("hex"), _spans(text, OPAQUE, 3, 0).alias("opaque"),
    )
    base = F.concat("assign", "access", "hex")
    held = common.table(held, "secret-spans").withColumn("base", base).withColumn("opaque", F.filter("opaque", lambda o: ~F.exists("base", lambda b: (o["s"] < b["e"]) & (o["e"] > b["s"]))))
    found = held.select("doc_id", "tie", "owner", "repository", F.explode(F.concat("base", "opaque")).alias("x")).withColumn("value", F.sha2("x.v", 256))
    owners = found.select("value", "owner", "repository").distinct().groupBy("value", "owner").agg(F.count("*").alias("repositories"))
    frequency = owners.groupBy("value").agg(F.count("*").alias("owners"), F.sum("repositories").alias("repositories"))
    judged = found.select("doc_id", "tie", "value", "x").distinct().join(frequency, "value")
    live = F.col("owners") < SHARED_OWNERS
    opaque = F.when((F.col("x.k") == 3) & live, F.struct("x.s", "x.k", "x.e", "x.v"))
    per_text = judged.groupBy("doc_id", "tie").agg(F.sum(live.cast("long")).alias("n_live"), F.sum((~live).cast("long")).alias("n_shared"), F.collect_list(opaque).alias("added"))
    per_text = per_text.withColumnsRenamed({"doc_id": "d", "tie": "t"})
    out = held.join(per_text, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("tie") == F.col("t")), "left")
    spans = F.concat("base", F.coalesce(F.col("added").cast(SPAN), F.array().cast(SPAN)))
    return out.select(
        "doc_id", F.size("assign").cast("long").alias("n_assign"), F.size("access").cast("long").alias("n_access"), F.size("hex").cast("long").alias("n_hex"), F.sha2(_joined(F.col("base")), 256).alias("base_sha256"),
        _joined(spans).alias("spans"), F.coalesce("n_live", F.lit(0)).alias("n_live"), F.coalesce("n_shared", F.lit(0)).alias("n_shared"),
    )


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
