"""Token-id output: concatenated ids with Elias-Fano document boundaries.

File format (a Parquet dataset, so that any store Spark writes to will do and task commits survive lost
executors). A row is a block of whole documents, in ascending order of (shard, block):

    shard, block        place of the block; shards hold ascending, disjoint runs of doc_id
    start               ids in the blocks of the same shard before this one
    n_docs, n_ids       documents and ids in the block
    width               bytes of an id: 2 if every id of the vocabulary fits, else 4 (little-endian)
    doc_ids             the documents' ids, ascending
    low, high           Elias-Fano code of the n_docs + 1 boundaries (0 .. n_ids): `bits` low bits of each, packed
                        most significant bit first; the rest in unary: bit (value >> bits) + i is set for the i-th
    select              uint32 position in `high` of every 64th set bit: boundary i is found from the nearest
                        sample and a short scan, without a table of 64-bit offsets
    ids                 the block's ids

Blocks close at BLOCK_IDS ids; a document is never cut, so a longer one is a block of its own. Offsets over the whole
output are the shards' totals summed in order (one row per shard) plus `start`.

Defined results: a null text is empty and holds only the end id; null doc_ids come first; rows of one doc_id are
ordered by a hash of their text and keep a row each; an empty table gives an empty output.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkloom.llm import common
from sparkloom.llm.pretok import default_path, pre_tokenizer

BLOCK_IDS, BLOCK_DOCS, SAMPLE = 1 << 18, 1 << 14, 64
SCHEMA = "shard int, block int, start long, n_docs int, n_ids long, width int, bits int, doc_ids array<bigint>, low binary, high binary, `select` binary, ids binary"


class EliasFano:
    """Non-decreasing values in about 2 + log2(universe / n) bits each."""

    def __init__(self, n: int, bits: int, low: bytes, high: bytes, select: bytes) -> None:
        self.n, self.bits = n, bits
        self.low = np.frombuffer(low, np.uint8)
        self.high = np.frombuffer(high, np.uint8)
        self.samples = np.frombuffer(select, "<u4")

    @classmethod
    def encode(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.int64)
        n, top = len(values), int(values[-1]) if len(values) else 0
        bits = max(0, (top // max(n, 1)).bit_length() - 1)
        shifts = np.arange(bits - 1, -1, -1)
        low = np.packbits(((values[:, None] >> shifts) & 1).astype(np.uint8).ravel()).tobytes()
        ones = (values >> bits) + np.arange(n)
        high = np.zeros((top >> bits) + n + 1, np.uint8)
        high[ones] = 1
        return cls(n, bits, low, np.packbits(high).tobytes(), ones[::SAMPLE].astype("<u4").tobytes())

    def _low(self, i: int) -> int:
        at, out = i * self.bits, 0
        for k in range(at, at + self.bits):
            out = out << 1 | int(self.low[k >> 3]) >> (7 - (k & 7)) & 1
        return out

    def select(self, i: int) -> int:
        """The i-th value, by the sampled select structure."""
        at, seen = int(self.samples[i // SAMPLE]), i // SAMPLE * SAMPLE
        while seen < i:
            at += 1
            seen += int(self.high[at >> 3]) >> (7 - (at & 7)) & 1
        return (at - i) << self.bits | self._low(i)

    def run(self, i: int) -> np.ndarray:
        """Values i .. i + SAMPLE (fewer at the end), i a multiple of SAMPLE: the code between two select samples alone."""
        k = i // SAMPLE
        last = min(i + SAMPLE, self.n - 1)
        first_bit, last_bit = int(self.samples[k]), int(self.samples[k + 1]) if last == i + SAMPLE else 8 * len(self.high) - 1
        byte = first_bit >> 3
        ones = np.flatnonzero(np.unpackbits(self.high[byte : (last_bit >> 3) + 1])) + 8 * byte
        ones = ones[ones >= first_bit][: last - i + 1]
        out = (ones - np.arange(i, last + 1)) << self.bits
        if self.bits:
            a, b = i * self.bits, (last + 1) * self.bits
            low = np.unpackbits(self.low[a >> 3 : (b + 7) >> 3])[a & 7 :][: b - a].reshape(-1, self.bits).astype(np.int64)
            out = out | low @ (1 << np.arange(self.bits - 1, -1, -1, dtype=np.int64))
        return out


def _blocks(path: str, end_id: int):
    def run(batches):
        tok = pre_tokenizer(path)
        width = 2 if max(len(tok.ends_word), end_id + 1) <= 1 << 16 else 4
        end = end_id.to_bytes(width, "little")
        shard, block, start = TaskContext.get().partitionId(), 0, 0
        doc_ids, parts, sizes, total = [], [], [0], 0

        def close():
            nonlocal block, start, doc_ids, parts, sizes, total
            code = EliasFano.encode(np.cumsum(sizes))
            row = {
                "shard": shard, "block": block, "start": start, "n_docs": len(doc_ids), "n_ids": total, "width": width, "bits": code.bits, "doc_ids": doc_ids,
                "low": code.low.tobytes(), "high": code.high.tobytes(), "select": code.samples.tobytes(), "ids": b"".join(parts),
            }
            block, start = block + 1, start + total
            doc_ids, parts, sizes, total = [], [], [0], 0
            return pa.RecordBatch.from_pylist([row], schema=ARROW)

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                ids = tok.id_bytes(text, f"<u{width}")
                n = len(ids) // width + 1
                if doc_ids and (total + n > BLOCK_IDS or len(doc_ids) >= BLOCK_DOCS):
                    yield close()
                doc_ids.append(doc_id)
                parts += (ids, end)
                sizes.append(n)
                total += n
        if doc_ids:
            yield close()
        tok.forget()

    return run


ARROW = pa.schema([
    ("shard", pa.int32()), ("block", pa.int32()), ("start", pa.int64()), ("n_docs", pa.int32()), ("n_ids", pa.int64()), ("width", pa.int32()), ("bits", pa.int32()),
    ("doc_ids", pa.list_(pa.int64())), ("low", pa.binary()), ("high", pa.binary()), ("select", pa.binary()), ("ids", pa.binary()),
])


def write_token_ids(docs: DataFrame, out: str, path: str | None = None, end_id: int = 2) -> None:
    """Encodes every text of docs (doc_id, text) and writes the format above to the folder `out`."""
    common.bounded_batches(docs.sparkSession)
    ordered = (
        docs.select(common.col("doc_id").cast("long").alias("doc_id"), common.text_of().alias("text"))
        .withColumn("tie", F.xxhash64("text"))
        .repartitionByRange("doc_id", "tie")
        .sortWithinPartitions("doc_id", "tie")
    )
    ordered.select("doc_id", "text").mapInArrow(common.tidy(_blocks(path or default_path(), end_id)), SCHEMA).write.parquet(out)


def _documents(with_ids: bool):
    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                code = EliasFano(row["n_docs"] + 1, row["bits"], row["low"], row["high"], row["select"])
                ids = np.frombuffer(row["ids"], f"<u{row['width']}").astype("<u4")
                raw, first = memoryview(ids.tobytes()), row["base"] + row["start"]
                starts, sizes, cut = [], [], []
                for i in range(0, row["n_docs"], SAMPLE):
                    ends = code.run(i)
                    starts.append(first + ends[:-1])
                    sizes.append(np.diff(ends))
                    cut += [raw[4 * a : 4 * b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
                columns = {
                    "doc_id": pa.array(row["doc_ids"], pa.int64()), "start": pa.array(np.concatenate(starts), pa.int64()), "n_tokens": pa.array(np.concatenate(sizes), pa.int64()),
                    "ids_crc32": pa.array([zlib.crc32(x) for x in cut], pa.int64()),
                }
                if with_ids:
                    columns["ids"] = pa.array([np.frombuffer(x, "<u4").astype(np.int64) for x in cut], pa.list_(pa.int64()))
                yield pa.record_batch(columns)

    return run


def read_token_ids(spark: SparkSession, out: str, with_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (and ids) of every document, decoded from the files in `out`."""
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<bigint>" * with_ids
    return _placed(spark, out).mapInArrow(common.tidy(_documents(with_ids)), schema)


def _placed(spark: SparkSession, out: str) -> DataFrame:
    """Blocks with `base`: the ids of all shards before."""
    common.bounded_batches(spark)
    blocks = spark.read.schema(SCHEMA).parquet(out)
    totals = blocks.groupBy("shard").agg(F.sum("n_ids").alias("n_ids"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select("shard", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("base"))
    columns = ["start", "n_docs", "bits", "doc_ids", "low", "high", "select", "width", "ids", "base"]
    # one row per shard, that is per written partition: some ten thousand even at 100 TB
    return blocks.join(F.broadcast(base), "shard").select(*(common.col(c) for c in columns))


def _one_document(doc_id: int):
    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                code = EliasFano(row["n_docs"] + 1, row["bits"], row["low"], row["high"], row["select"])
                nulls = row["doc_ids"].count(None)
                found = nulls + np.searchsorted(row["doc_ids"][nulls:], [doc_id, doc_id + 1])
                spans = [(code.select(i), code.select(i + 1)) for i in range(*found.tolist())]
                w = row["width"]
                ids = [np.frombuffer(row["ids"][w * a : w * b], f"<u{w}").astype(np.int64) for a, b in spans]
                yield pa.record_batch({"start": pa.array([row["base"] + row["start"] + a for a, _ in spans], pa.int64()), "ids": pa.array(ids, pa.list_(pa.int64()))})

    return run


def read_document(spark: SparkSession, out: str, doc_id: int) -> DataFrame:
    """start, ids of the documents with this id: only blocks that can hold it are decoded, two boundaries each by select."""
    first, last = F.element_at("doc_ids", 1), F.element_at("doc_ids", -1)
    return _placed(spark, out).where((first.isNull() | (first <= doc_id)) & (last >= doc_id)).mapInArrow(_one_document(doc_id), "start long, ids array<bigint>")


def token_ids(docs: DataFrame, path: str | None = None, end_id: int = 2, with_ids: bool = False) -> DataFrame:
    spark = docs.sparkSession
    out = f"{common.scratch_dir(spark)}/token-ids-{uuid.uuid4().hex}"
    write_token_ids(docs, out, path, end_id)
    return read_token_ids(spark, out, with_ids)


def op7_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_ids(spark.read.parquet(f"{sf_dir}/documents.parquet"))
