"""Sources and sinks: CSV with a contract, frozen split ids, atomic single files, explanation documents."""

from __future__ import annotations

import json
import os
import tempfile
import uuid
from functools import reduce
from hashlib import sha256
from pathlib import Path

import yaml
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom import config as C
from sparkloom.functions import text
from sparkloom.sources.scratch import scratch

#: Faults that an error names.
FIRST_FAULTS = 5

# fixed values: keys that a document must not hold
FORBIDDEN = {
    "true_label", "label", "outcome_type", "cluster_label", "scaled_value", "scaled_features", "distance", "distance_threshold", "silhouette_score", "phishing_probability", "probability", "shap_value", "shap_values",
    "raw_margin", "base_value",
}


def load_yaml(path: str) -> dict:
    found = yaml.safe_load(Path(path).read_text(encoding="utf-8"))
    if not isinstance(found, dict):
        raise C.ContractError(f"{path} is not a mapping")
    return found


def load_json(path: str) -> dict:
    found = json.loads(Path(path).read_text(encoding="utf-8"))
    if not isinstance(found, dict):
        raise C.ContractError(f"{path} is not an object")
    return found


def read_raw_csv(spark: SparkSession, path: str, columns: dict[str, str], labels: dict[str, int], expected_rows: int | None = None) -> DataFrame:
    """row, subject, body, label in file order; all text at first, nulls and words for null as empty text."""
    raw = spark.read.csv(path, header=True, multiLine=True, escape='"', inferSchema=False)
    missing = [c for c in columns.values() if c not in raw.columns]
    if missing:
        raise C.ContractError(f"missing columns: {missing}")
    col = lambda role: F.col("`" + columns[role].replace("`", "``") + "`")
    raw = raw.select(text.null_to_empty(col("subject")).alias("subject"), text.null_to_empty(col("body")).alias("body"), col("label").alias("_label"))
    known = F.create_map(*(F.lit(x) for kv in labels.items() for x in kv))
    out = scratch(numbered(raw).withColumn("label", known[text.label_key(F.col("_label"))]), "raw")
    bad = out.where("label is null").select("row", F.coalesce("_label", F.lit("(none)")).alias("found")).orderBy("row").limit(FIRST_FAULTS).collect()
    if bad:
        raise C.ContractError("no known label: " + ", ".join(f"row {r['row']}: {r['found']}" for r in bad))
    if expected_rows is not None and (n := out.count()) != expected_rows:
        raise C.ContractError(f"expected {expected_rows} rows, found {n}")
    return out.select("row", "subject", "body", "label")


def numbered(df: DataFrame) -> DataFrame:
    """df with `row`: 1 to n in the order it is read. A task's rows are numbered from the rows of the tasks before."""
    held = df.withColumn("_at", F.monotonically_increasing_id())  # task number, and place in the task
    held = scratch(held, "numbered")
    part = F.shiftright("_at", 33)
    sizes = held.groupBy(part.alias("_part")).count()
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each task
    base = sizes.select("_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_base"))
    out = held.join(F.broadcast(base), part == F.col("_part"))
    return out.withColumn("row", F.col("_base") + F.col("_at").bitwiseAND((1 << 33) - 1) + 1).select("row", *df.columns)


def read_processed_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV written by write_csv: empty fields and words for null are texts, never null."""
    return spark.read.csv(path, header=True, schema=schema, multiLine=True, escape='"', nullValue="\x00", emptyValue="", enforceSchema=False)


def read_frozen_splits(spark: SparkSession, paths: dict[str, str], known: DataFrame | None = None) -> DataFrame | None:
    """email_id, split of one CSV of ids for each split; None if there is none of them.

    An error if only some are there, if an id is in them more than once, or if `known` (email_id) lacks one.
    """
    there = {s: p for s, p in paths.items() if exists(p, spark)}
    if not there:
        return None
    if len(there) < len(paths):
        raise C.ContractError(f"split files are missing: {sorted(set(paths) - set(there))}")
    frames = [spark.read.csv(p, header=True, schema="email_id string").withColumn("split", F.lit(s)) for s, p in there.items()]
    out = scratch(reduce(DataFrame.unionByName, frames), "frozen")
    faults = {"more than once": out.groupBy("email_id").count().where("count > 1")}
    if known is not None:
        faults["of no row"] = out.join(known.select("email_id"), "email_id", "left_anti")
    for fault, ids in faults.items():
        first = [r["email_id"] for r in ids.select("email_id").distinct().orderBy("email_id").limit(FIRST_FAULTS).collect()]
        if first:
            raise C.ContractError(f"frozen ids {fault}: {', '.join(map(str, first))}")
    return out


def _hadoop(path: str, spark: SparkSession):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(path: str, spark: SparkSession) -> bool:
    p, fs = _hadoop(path, spark)
    return fs.exists(p)


def read_text(path: str, spark: SparkSession | None = None) -> str:
    """A small file, from any store that Spark reads if a session is given."""
    if spark is None:
        return Path(path).read_text(encoding="utf-8")
    return bytes(spark.read.format("binaryFile").load(path).select("content").first()["content"]).decode()


def write_text(path: str, content: str, spark: SparkSession | None = None) -> None:
    """A small file, whole or not at all: written beside its place and renamed."""
    if spark is None:
        os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
        fd, part = tempfile.mkstemp(dir=os.path.dirname(path) or ".")
        with os.fdopen(fd, "w", encoding="utf-8", newline="\n") as f:
            f.write(content)
        os.replace(part, path)
        Path(path).with_name(f".{Path(path).name}.crc").unlink(missing_ok=True)  # of an older file that Hadoop wrote
        return
    target, fs = _hadoop(path, spark)
    part, _ = _hadoop(f"{path}.{uuid.uuid4().hex}.part", spark)
    out = fs.create(part, True)
    try:
        out.write(bytearray(content.encode()))
    finally:
        out.close()
    _replace(fs, part, target, spark)


def _replace(fs, part, target, spark: SparkSession) -> None:
    """Moves part to target. A file takes an older one's place in one step; a folder's is removed first."""
    if fs.exists(target) and not fs.getFileStatus(target).isDirectory():
        hadoop, gateway = spark._jvm.org.apache.hadoop.fs, spark.sparkContext._gateway
        overwrite = gateway.new_array(hadoop.Options.Rename, 1)
        overwrite[0] = hadoop.Options.Rename.OVERWRITE
        hadoop.FileContext.getFileContext(target.toUri(), spark._jsc.hadoopConfiguration()).rename(fs.makeQualified(part), fs.makeQualified(target), overwrite)
        return
    fs.delete(target, True)
    if not fs.rename(part, target):
        raise OSError(f"cannot move {part} to {target}")


def write_table(df: DataFrame, path: str, kind: str = "parquet") -> None:
    """A table in a folder, whole or not at all: written beside its place and renamed."""
    spark = df.sparkSession
    target, fs = _hadoop(path, spark)
    part, _ = _hadoop(f"{path}.{uuid.uuid4().hex}.part", spark)
    w = df.write
    w.option("header", True).option("escape", '"').option("emptyValue", "").csv(str(part)) if kind == "csv" else w.format(kind).save(str(part))
    _replace(fs, part, target, spark)


def write_csv(df: DataFrame, path: str, *order: str | Column) -> None:
    """One named CSV file with a header, rows in `order`, for results that one file can hold; lines end with LF."""
    spark = df.sparkSession
    target, fs = _hadoop(path, spark)
    folder, _ = _hadoop(f"{path}.{uuid.uuid4().hex}.part", spark)
    rows = df.orderBy(*order) if order else df
    rows.coalesce(1).write.option("header", True).option("escape", '"').option("emptyValue", "").csv(str(folder))
    parts = [f.getPath() for f in fs.listStatus(folder) if f.getPath().getName().startswith("part-")]
    if parts:
        _replace(fs, parts[0], target, spark)
    else:
        write_text(path, ",".join(df.columns) + "\n", spark)
    fs.delete(folder, True)


def sha256_of(path: str, spark: SparkSession) -> str:
    """Digest of a file, or of a folder's files in order of name, each digested where it is read."""
    digests = spark.read.format("binaryFile").option("pathGlobFilter", "[!_.]*").load(path).select("path", F.sha2("content", 256).alias("d")).orderBy("path").collect()
    return digests[0]["d"] if len(digests) == 1 else sha256("".join(r["d"] for r in digests).encode()).hexdigest()


def check_document(schema: T.DataType) -> None:
    """A document must not hold forbidden keys, at any depth: a look at the schema, not at the data."""
    if isinstance(schema, T.ArrayType):
        check_document(schema.elementType)
    elif isinstance(schema, T.StructType):
        if bad := FORBIDDEN & set(schema.fieldNames()):
            raise C.ContractError(f"forbidden keys: {sorted(bad)}")
        for f in schema.fields:
            check_document(f.dataType)


def json_documents(df: DataFrame) -> DataFrame:
    check_document(df.schema)
    return df.select(F.to_json(F.struct(*df.columns)).alias("json"))
