"""The classifier: fit, score and attributions of rows by second-order boosted trees."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.operators.boosting import Forest, Parameters, fit_all


def fit(train: DataFrame, features: list[str], **parameters) -> Forest:
    """The forest of train (email_id, label, features); parameters as in Parameters."""
    return fit_all(train, features, [Parameters(**parameters)])[0]


def _values(frame: pd.DataFrame, features: list[str]) -> np.ndarray:
    return frame[list(features)].to_numpy(float)


def staged_margins(forests: dict[str, Forest], df: DataFrame, *keep: str) -> DataFrame:
    """keep, name, margin: a row of df for each named forest."""
    features = next(iter(forests.values())).features

    def run(frames):
        for f in frames:
            x = _values(f, features)
            for name, forest in forests.items():
                yield f[list(keep)].assign(name=name, margin=forest.margins(x))

    kept = [f"{c} {t}" for c, t in df.select(*keep).dtypes]
    return df.select(*keep, *(F.col(c).cast("double").alias(c) for c in features)).mapInPandas(run, ", ".join([*kept, "name string", "margin double"]))


def probability(margin) -> F.Column:
    return 1 / (1 + F.exp(-margin))


def score(model: Forest, df: DataFrame, features: list[str], threshold: float = 0.5) -> DataFrame:
    """df with margin, p and predicted_label."""
    margin = F.pandas_udf(lambda *columns: pd.Series(model.margins(np.stack([c.to_numpy(float) for c in columns], 1))), "double")
    out = df.withColumn("margin", margin(*(F.col(f).cast("double") for f in features))).withColumn("p", probability(F.col("margin")))
    return out.withColumn("predicted_label", (F.col("p") >= threshold).cast("int"))


def attributions(model: Forest, df: DataFrame, features: list[str]) -> DataFrame:
    """email_id, phi (on the margin), base: base + sum(phi) is the margin."""
    base = model.base()

    def run(frames):
        for f in frames:
            yield pd.DataFrame({"email_id": f.email_id, "phi": list(model.attributions(_values(f, features))) if len(f) else [], "base": base})

    return df.select("email_id", *(F.col(c).cast("double").alias(c) for c in features)).mapInPandas(run, "email_id string, phi array<double>, base double")
