"""Sanitising and features as a stream: the batch expressions are stateless, so they run on readStream as they are."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom import config as C
from sparkloom.functions import text as T


def with_features(df: DataFrame, subject: str = "sanitized_subject", body: str = "sanitized_body") -> DataFrame:
    keywords = C.Keywords()
    norm = df.withColumn("_norm", T.variants_normalised(F.concat_ws("\n", subject, body), keywords))
    return norm.withColumns(T.features(F.col(subject), F.col(body), keywords)).drop("_norm")


def stream_features(spark: SparkSession, path: str, schema: str, out: str, checkpoint: str):
    """Feature rows of each new Parquet file under path, appended to out once."""
    df = spark.readStream.schema(schema).parquet(path)
    rows = with_features(df.withColumns({"sanitized_subject": T.whitespace(F.coalesce("subject", F.lit(""))), "sanitized_body": T.whitespace(F.coalesce("body", F.lit("")))}))
    return rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
