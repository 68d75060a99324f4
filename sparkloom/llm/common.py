"""What the operators of this subpackage share: scratch tables, row keys, hot dictionaries."""

from __future__ import annotations

import atexit
import ctypes
import shutil
import tempfile
import uuid

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, as the words of all contracts are split: space and TAB to CR.
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes in one Arrow batch, so that long texts and blocks never meet in one batch of rows.
BATCH_BYTES = 4 << 20
#: Rows of a dictionary that may be sent to every worker; the rest of it is joined by shuffle.
HOT_WORDS = 1 << 18
#: Rows of two longs that may be broadcast to find documents: 16 MB. More are joined by shuffle.
BROADCAST_KEYS = 1_000_000

_own_scratch: list[str] = []
_tables: list[str] = []


def scratch_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (spark.checkpoint.dir). Where that is unset: a temporary one, removed at exit, if all
    executors are on this machine, else an error."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not _own_scratch:
        folder = tempfile.mkdtemp(prefix="sparkloom-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        _own_scratch.append("file://" + folder)
    return _own_scratch[0]


def table(df: DataFrame, tag: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _tables.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def tables() -> list[str]:
    """Paths of the tables written so far and not dropped."""
    return list(_tables)


def drop_tables(spark: SparkSession, paths: list[str]) -> None:
    """Removes tables that nothing reads any more."""
    for path in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
        _tables.remove(path)


def drop_table(df: DataFrame) -> None:
    drop_tables(df.sparkSession, [df.scratch_path])


def local_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A table of a few rows that the driver holds. It goes by Arrow: a list would be unpickled on the executors, by a second
    daemon with workers of its own, which stay for a minute beside those of mapInArrow."""
    columns = list(zip(*rows, strict=True)) or [()] * len(schema.split(","))
    return spark.createDataFrame(pa.table({c.split()[0]: pa.array(x) for c, x in zip(schema.split(","), columns, strict=True)}), schema)


def bounded_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def tidy(run):
    """`run` of mapInArrow, giving free memory back to the system at the end of a task: workers outlive tasks, and what
    they hold counts for the tasks of other steps."""

    def tidied(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it
        if trim is not None:
            trim(0)

    return tidied


def col(name: str) -> Column:
    """A column by its exact name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def id_remainder(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def text_of(name: str = "text") -> Column:
    return F.coalesce(col(name), F.lit(""))


def free(df: DataFrame, *names: str) -> list[str]:
    """Each name, lengthened until no column of df has it in any case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """docs without the rows named by gone (doc_id, tie: hash of the text); null ids are equal."""
    d, t = free(docs, "gone_doc", "gone_tie")
    gone = gone.select(F.col("doc_id").alias(d), F.col("tie").alias(t))
    side = F.broadcast(gone) if gone.count() <= BROADCAST_KEYS else gone
    return docs.join(side, col("doc_id").cast("long").eqNullSafe(F.col(d)) & (F.xxhash64(text_of()) == F.col(t)), "left_anti")


class RowIds:
    """Row ids of one task: unique over all tasks of the job that writes them."""

    def __init__(self) -> None:
        self.next = TaskContext.get().partitionId() << 40

    def take(self, n: int) -> range:
        first, self.next = self.next, self.next + n
        return range(first, first + n)


def frequency_step(freq: Column) -> Column:
    """A sixteenth of a power of two: at most about a thousand steps whatever the frequencies."""
    return F.floor(F.log2(freq.cast("double")) * 16).cast("int")


def hot_step(lexicon: DataFrame, most: int) -> int:
    """The lowest frequency step whose words, with all more frequent ones, are at most `most`."""
    total, lowest = 0, 1 << 30
    steps = lexicon.groupBy(frequency_step(F.col("freq")).alias("step")).count().collect()
    for row in sorted(steps, key=lambda r: -r["step"]):
        total += row["count"]
        if total > most:
            break
        lowest = row["step"]
    return lowest
