"""Reports: small aggregates as Markdown and as text tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom import config as C
from sparkloom.operators import stats as A
from sparkloom.operators import tables as O


#: Counts of a run, in the order and under the names of the summary.
COUNTS = {
    "input": "input rows", "blank": "blank rows removed", "duplicate_groups": "duplicate groups", "duplicate_records": "records in duplicate groups", "removed": "duplicates removed",
    "conflicting_groups": "groups of conflicting labels", "output": "output rows",
}


def markdown_table(df: DataFrame) -> list[str]:
    """A frame of a few rows as Markdown lines."""
    show = lambda x: "" if x is None else f"{x:.6g}" if isinstance(x, float) else str(x)
    return ["| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns), *("| " + " | ".join(map(show, r)) + " |" for r in df.collect())]


def preprocessing_summary(rows: DataFrame, counts: dict[str, int], issues: tuple[str, ...] = ()) -> str:
    """Markdown of processed rows: counts of what was removed, classes by split, ranges of features, checks, issues."""
    splits = rows.groupBy("split").pivot("label", [0, 1]).count().fillna(0, ["0", "1"]).withColumn("total", F.col("0") + F.col("1"))
    order = F.array_position(F.array(*map(F.lit, C.SPLITS)), F.col("split"))
    ranges = A.melt(rows, list(C.FEATURES)).groupBy("feature").agg(F.min("value").alias("min"), F.max("value").alias("max"))
    place = F.array_position(F.array(*map(F.lit, C.FEATURES)), F.col("feature"))
    checks = O.output_contract(rows, C.FEATURES)
    parts = [
        "# Preprocessing summary", "", *(f"- {name}: {n}" for name, n in counts.items()), "", "## Rows by split and class", "", *markdown_table(splits.orderBy(order)), "", "## Ranges", "", *markdown_table(ranges.orderBy(place)), "",
        "## Checks", "", *markdown_table(checks), "", "## Known issues", "", *(f"- {x}" for x in issues or ("none",)),
    ]
    return "\n".join(parts) + "\n"


def text_table(title: str, df: DataFrame) -> str:
    """A frame of a few rows as aligned text."""
    rows = [df.columns, *(["" if x is None else f"{x:.6f}" if isinstance(x, float) else str(x) for x in r] for r in df.collect())]
    width = [max(len(r[i]) for r in rows) for i in range(len(df.columns))]
    return "\n".join([title, *("  ".join(x.ljust(w) for x, w in zip(r, width, strict=True)).rstrip() for r in rows)]) + "\n"


def verdict_line(name: str, passed: bool) -> str:
    return f"{name}: {'PASS' if passed else 'FAIL'}"
