"""Scoring (SCO1-SCO4): batch predictions, request validation, segment routing."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import rule_violations


def score(model, df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """SCO1 + SCO2: class prediction and P(class 1) from a fitted model or pipeline."""
    out = model.transform(df)
    return out.select(*keep, F.col("prediction").cast("int").alias("predicted"),
                      vector_to_array("probability")[1].alias("prediction"))


def validate_requests(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """SCO3 input check: ``violations`` array and a ``valid`` flag per request row."""
    v = df.withColumn("violations", rule_violations(rules))
    return v.withColumn("valid", F.size("violations") == 0)


def score_requests(model, df: DataFrame, rules: Mapping[str, Column], keep: Sequence[str]):
    """SCO3 (batch form): valid rows -> model -> label; invalid rows -> quarantine with reasons."""
    v = validate_requests(df, rules)
    scored = score(model, v.where("valid"), keep)
    quarantine = v.where(~F.col("valid")).select(*keep, F.array_join("violations", ",").alias("violations"))
    return scored, quarantine


def route_linear(df: DataFrame, segment: str, weights: DataFrame, features: Sequence[str],
                 link: str = "identity") -> DataFrame:
    """SCO4 with linear per-segment models: join each row to its segment's weights and take
    the dot product.  ``weights`` has one row per segment (intercept + one column per feature);
    AQE turns the join into a broadcast when that table is small."""
    j = df.join(weights, segment, "left")
    z = F.col("intercept") + sum((F.col(f).cast("double") * F.col(f"w_{f}") for f in features), F.lit(0.0))
    if link == "logistic":
        z = 1 / (1 + F.exp(-z))
    return j.withColumn("prediction", z).drop("intercept", *[f"w_{f}" for f in features])


def route_models(df: DataFrame, segment: str, models: Mapping, keep: Sequence[str]) -> DataFrame:
    """SCO4 with a few Spark models: score each segment's rows with its model and union.  Rows of
    a segment without a model (or without a segment) stay, with null predictions."""
    known = F.col(segment).isin(list(models))
    out = df.where(~F.coalesce(known, F.lit(False))).select(
        *keep, segment, F.lit(None).cast("int").alias("predicted"), F.lit(None).cast("double").alias("prediction"))
    for s, m in models.items():
        out = out.unionByName(score(m, df.where(F.col(segment) == F.lit(s)), [*keep, segment]))
    return out
