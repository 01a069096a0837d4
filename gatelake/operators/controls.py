"""Populations of a control, predicted from the primary staining of the same sample."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import transforms
from . import sampling
from .classify import CellClassifier, fold, metrics

#: Events that a control's classifier is fitted on, a documented bound of labelled rows; every event of the control is predicted.
SAMPLE_SIZE = 10_000


def training_rows(primary: DataFrame, members: DataFrame, features: list[str], *, size: int = SAMPLE_SIZE, id_col: str = "event_id", seed: int = 42) -> DataFrame:
    """id, features and label (1 for members): the rarer class repeated up to the other's size, then at most `size` rows in hash order."""
    flagged = primary.select(id_col, *features).join(members.select(id_col, F.lit(1).alias("label")).distinct(), id_col, "left").withColumn("label", F.coalesce("label", F.lit(0)))
    even = sampling.oversample(flagged, "label", id_col=id_col, seed=seed)
    return sampling.uniform(even.withColumn(id_col, F.concat_ws(":", id_col, "copy")), size, id_col=id_col, seed=seed).drop("copy")


def shared_features(primary: DataFrame, control: DataFrame, id_col: str = "event_id") -> list[str]:
    """Numeric columns of both, without times."""
    numeric = {n for n, t in primary.dtypes if t in ("double", "float", "int", "bigint")}
    return [c for c in primary.columns if c in numeric and c in control.columns and c != id_col and not re.search("time", c, re.IGNORECASE)]


def control_population(primary: DataFrame, control: DataFrame, members: DataFrame, *, features: list[str] | None = None, kind: str = "random_forest", params: dict | None = None, transform: str | None = "logicle", transform_params: dict | None = None, size: int = SAMPLE_SIZE, id_col: str = "event_id") -> DataFrame:
    """The control's events that look like the members of a population of the primary data; values keep their own scale."""
    features = features or shared_features(primary, control, id_col)
    scaled = lambda df: transforms.apply(df, features, transform, transform_params)
    train = scaled(training_rows(primary, members, features, size=size, id_col=id_col))
    model = CellClassifier(features, kind=kind, params={"seed": 42, **(params or {})} if kind in ("random_forest", "gbt", "decision_tree") else params or {}, scale=None).fit(train)
    found = model.predict(scaled(control.select(id_col, *features))).where("predicted = 1").select(id_col)
    return control.join(found, id_col, "left_semi").select(control.columns)


def evaluate(primary: DataFrame, members: DataFrame, features: list[str], *, kind: str = "random_forest", folds: int = 5, permutations: int = 25, metric: str = "balanced_accuracy", size: int = SAMPLE_SIZE, id_col: str = "event_id") -> dict[str, float]:
    """Mean score over folds, mean score after labels are dealt out anew, and the share of such scores that reach the first (p)."""
    rows = training_rows(primary, members, features, size=size, id_col=id_col).cache()

    def score(df: DataFrame) -> float:
        f = fold(id_col, folds)
        one = lambda i: metrics(CellClassifier(features, kind=kind, scale=None).fit(df.where(f != i)).predict(df.where(f == i)), "label", "predicted", (metric,))[metric]
        return sum(one(i) for i in range(folds)) / folds

    own, others = score(rows), []
    for seed in range(permutations):
        # at most `size` rows: labels move to the row of the same rank in another hash order
        order = lambda s: F.row_number().over(_window(id_col, s))
        a, b = rows.drop("label").withColumn("_r", order(2 * seed)), rows.select("label", order(2 * seed + 1).alias("_r"))
        others.append(score(a.join(b, "_r").drop("_r")))
    rows.unpersist()
    return {"score": own, "permuted": sum(others) / len(others) if others else 0.0, "p": (1 + sum(s >= own for s in others)) / (1 + len(others))}


def _window(id_col: str, seed: int):
    from pyspark.sql import Window

    return Window.partitionBy(F.lit(0)).orderBy(sampling.key(id_col, seed), id_col)


def control_populations(primary: DataFrame, control: DataFrame, members: DataFrame, **kwargs) -> DataFrame:
    """`control_population` for each sample of an experiment; all have sample_id. One classifier a sample, and each is fitted on its own events."""
    samples = [r.sample_id for r in control.select("sample_id").distinct().collect()]  # a row a sample
    out = None
    for s in samples:
        own = F.col("sample_id") == s
        part = control_population(primary.where(own), control.where(own), members.where(own), **kwargs)
        out = part if out is None else out.unionByName(part)
    return control.limit(0) if out is None else out
