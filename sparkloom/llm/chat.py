r"""Chat formatting in budgeted windows.

A conversation's turns, in order, are marked up and cut into windows of at most `budget` tokens: running prefix sums
of turn tokens choose the spans, which begin and end at turns. Every window starts with the conversation's system turn
(if its first turn is one) and repeats the turns just before its span, as far as `history` tokens reach and as the
window's first own turn leaves room. Loss spans cover assistant texts once: those of repeated turns are masked. Only a
turn that does not fit beside the system turn exceeds the budget; it is a window of the system turn and itself.

Template: `### ROLE: TEXT </turn>` and a line feed. Inside texts and roles a backslash escapes: `\` is `\\`, `###` is
`#\#\#`, `</turn>` is `<\/turn>`, and `:` in a role is `\:`; so the marks never occur in escaped text, and
dropping the escapes restores it.

Tokens are counted where the rows are read, so that a hot conversation's count is spread. Rows are then dealt by
conversation and sorted, then streamed: a task holds the current window, its history and the system turn, never a whole
conversation, however long.

Defined results: null roles and texts are empty; rows of a null conv_id are one conversation; equal turn numbers are
ordered by role, then text (nulls first), repeated rows are turns of their own; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import re
from collections import deque
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm import common
from sparkloom.llm.pretok import default_path, pre_tokenizer

BUDGET, HISTORY = 1024, 256
OPEN, CLOSE = "### ", " </turn>\n"
SCHEMA = "conv_id long, window int, n_repeated int, n_turns int, n_tokens long, text string, loss_starts array<bigint>, loss_ends array<bigint>"
_ARROW = pa.schema([
    ("conv_id", pa.int64()), ("window", pa.int32()), ("n_repeated", pa.int32()), ("n_turns", pa.int32()), ("n_tokens", pa.int64()), ("text", pa.string()), ("loss_starts", pa.list_(pa.int64())), ("loss_ends", pa.list_(pa.int64())),
])


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("###", "#\\#\\#").replace("</turn>", "<\\/turn>")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)


def mark(role: str, text: str) -> tuple[str, int, int]:
    """The marked turn and the place of its text."""
    head = f"{OPEN}{escape(role).replace(':', chr(92) + ':')}: "
    body = escape(text)
    return head + body + CLOSE, len(head), len(head) + len(body)


_HEAD = re.compile(r"### ((?:[^\\:]|\\.)*): ", re.DOTALL)


def parse(window: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a formatted window."""
    out = []
    for turn in window.split(CLOSE)[:-1]:
        head = _HEAD.match(turn)
        out.append((unescape(head[1]), unescape(turn[head.end() :])))
    return out


class Turn:
    def __init__(self, role: str, text: str, tokens: int) -> None:
        self.system, self.assistant = role == "system", role == "assistant"
        self.marked, self.start, self.end = mark(role, text)
        self.tokens = tokens


def windows(turns, budget: int = BUDGET, history: int = HISTORY):
    """Windows of one conversation's turns as (repeated turns, own turns), streamed."""
    system, past, own = None, deque(), []
    total, past_from, start = 0, 0, 0  # prefix sums: before the next turn, the first of past, and what a window repeats
    repeated: list[Turn] = []
    for k, turn in enumerate(turns):
        if own and total - start + turn.tokens > budget:
            yield repeated, own
            room = budget - turn.tokens - (system.tokens if system else 0)
            while past and total - past_from > min(history, room):
                past_from += past.popleft().tokens
            repeated, own = ([system] if system else []) + list(past), []
            start = past_from - (system.tokens if system else 0)
        own.append(turn)
        total += turn.tokens
        if k == 0 and turn.system:
            system, past_from = turn, total
            continue
        past.append(turn)
        while past and total - past_from > history:
            past_from += past.popleft().tokens
    if own:
        yield repeated, own


def _count(path):
    def run(batches):
        tok = pre_tokenizer(path)
        for batch in batches:
            rows = zip(batch.column("role").to_pylist(), batch.column("text").to_pylist(), strict=True)
            tokens = [tok.count(mark(role or "", text or "")[0]) for role, text in rows]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(tokens, pa.int64())], [*batch.schema.names, "tokens"])

    return run


def _format(budget, history):
    def run(batches):
        def rows():
            for batch in batches:
                for row in batch.to_pylist():
                    yield row["conv_id"], row["role"] or "", row["text"] or "", row["tokens"]

        out: list[dict] = []
        size, stream = 0, rows()
        ahead = next(stream, None)
        while ahead is not None:
            conv_id = ahead[0]

            def turns(conv_id=conv_id):
                nonlocal ahead
                while ahead is not None and ahead[0] == conv_id:
                    now, ahead = ahead, next(stream, None)
                    yield Turn(*now[1:])

            for number, (repeated, own) in enumerate(windows(turns(), budget, history)):
                at, starts, ends = sum(len(t.marked) for t in repeated), [], []
                for t in own:
                    if t.assistant:
                        starts.append(at + t.start)
                        ends.append(at + t.end)
                    at += len(t.marked)
                text = "".join(t.marked for t in repeated + own)
                out.append({
                    "conv_id": conv_id, "window": number, "n_repeated": len(repeated), "n_turns": len(repeated) + len(own), "n_tokens": sum(t.tokens for t in repeated + own), "text": text, "loss_starts": starts, "loss_ends": ends,
                })
                size += len(text)
                if size > common.BATCH_BYTES // 4:
                    yield pa.RecordBatch.from_pylist(out, schema=_ARROW)
                    out, size = [], 0
        yield pa.RecordBatch.from_pylist(out, schema=_ARROW)

    return run


def format_windows(turns: DataFrame, path: str | None = None, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """Windows of all conversations of turns (conv_id, turn, role, text)."""
    common.bounded_batches(turns.sparkSession)
    rows = turns.select(common.col("conv_id").cast("long").alias("conv_id"), common.col("turn").alias("turn"), common.col("role").cast("string").alias("role"), common.col("text").cast("string").alias("text"))
    fields = ", ".join(f"{c} {t}" for c, t in rows.dtypes)
    counted = rows.mapInArrow(_count(path or default_path()), f"{fields}, tokens long")
    ordered = counted.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.select("conv_id", "role", "text", "tokens").mapInArrow(_format(budget, history), SCHEMA)


_DIGEST = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])


def _read_back(batches):
    state, out, started = None, [], False

    def close(conv_id, s):
        out.append({"conv_id": conv_id, "n_turns": s["n"], "turns_sha256": s["turns"].hexdigest(), "loss_chars": s["chars"], "loss_sha256": s["loss"].hexdigest(), "formatted_chars": s["formatted"]})

    now = None
    for batch in batches:
        for row in batch.to_pylist():
            if not started or row["conv_id"] != now:
                if started:
                    close(now, state)
                started, now = True, row["conv_id"]
                state = {"n": 0, "turns": sha256(), "chars": 0, "loss": sha256(), "formatted": 0}
            for role, text in parse(row["text"])[row["n_repeated"] :]:
                state["n"] += 1
                state["turns"].update(f"{role}\n{text}\n".encode())
            for a, b in zip(row["loss_starts"], row["loss_ends"], strict=True):
                text = unescape(row["text"][a:b])
                state["chars"] += len(text)
                state["loss"].update(text.encode())
            state["formatted"] += len(row["text"])
        if len(out) > 5000:
            yield pa.RecordBatch.from_pylist(out, schema=_DIGEST)
            out.clear()
    if started:
        close(now, state)
    yield pa.RecordBatch.from_pylist(out, schema=_DIGEST)


def read_back(formatted: DataFrame) -> DataFrame:
    """Turn, loss and length digests of each conversation, from its windows alone."""
    ordered = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "window")
    return ordered.mapInArrow(_read_back, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def op1_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = r"\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    return read_back(format_windows(turns.unionByName(extra)))
