"""Normalisation and scaling of matrices in coordinate form."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from countloom.functions.special import clip, transform


def normalized(counts: DataFrame, how: str = "proportion", scale_factor: float | None = None, transformation=None, features: int | None = None, pseudo_normalize: float = 0, pseudo_transform: float = 0) -> DataFrame:
    """(feature_id, cell_id, value): counts by cell total, then times scale_factor, then transformed.

    proportion: (n + p) / (total + G p); cpm: per million; median, mean: by total relative to the cells' median or mean.
    Entries that are zero in counts stay out; zero_value() has what they become."""
    total = F.sum("n").over(Window.partitionBy("cell_id"))
    if how == "proportion":
        if pseudo_normalize and features is None:
            raise ValueError("a pseudocount needs the number of features")
        value = (F.col("n") + pseudo_normalize) / (total + (features or 0) * pseudo_normalize)
        out = counts.withColumn("value", value)
    elif how == "cpm":
        out = counts.withColumn("value", F.col("n") / (total / 1e6))
    elif how in ("median", "mean"):
        by_cell = counts.groupBy("cell_id").agg(F.sum("n").cast("double").alias("t"))
        middle = by_cell.agg(F.percentile("t", F.lit(0.5)) if how == "median" else F.avg("t")).first()[0]
        out = counts.withColumn("value", F.col("n") / (total / F.lit(middle)))
    else:
        raise ValueError(f"unknown normalisation {how!r}")
    value = F.col("value")
    if scale_factor is not None:
        value = value * scale_factor
    if transformation is not None:
        value = transform(transformation)(value + pseudo_transform)
    return out.select("feature_id", "cell_id", value.cast("double").alias("value"))


def zero_value(counts: DataFrame, features: int, pseudo: float) -> DataFrame:
    """(cell_id, value): what a zero becomes under proportion with a pseudocount."""
    return counts.groupBy("cell_id").agg((F.lit(float(pseudo)) / (F.sum("n") + features * pseudo)).alias("value"))


def z_scored(values: DataFrame, axis: str, size: int, missing_zero: bool = False) -> DataFrame:
    """value standardised along an axis (feature_id: over its `size` cells) with the sample standard deviation; absent
    entries count as zeros, and what a zero becomes is `zero`. missing_zero: a constant row gives 0, not null."""
    w = Window.partitionBy(axis)
    s, q = F.sum("value").over(w), F.sum(F.col("value") * F.col("value")).over(w)
    sd = F.sqrt(F.greatest((q - s * s / size) / (size - 1), F.lit(0.0)))
    ok = F.when(sd > 0, sd)
    z, zero = (F.col("value") - s / size) / ok, -(s / size) / ok
    if missing_zero:
        z, zero = F.coalesce(z, F.lit(0.0)), F.coalesce(zero, F.lit(0.0))
    return values.select("feature_id", "cell_id", z.alias("value"), zero.alias("zero"))


def scaled(values: DataFrame, scale: str, features: int, cells: int) -> DataFrame:
    """By row, by column, or not at all."""
    if scale == "none":
        return values.select("feature_id", "cell_id", "value", F.lit(0.0).alias("zero"))
    if scale not in ("row", "column"):
        raise ValueError(f"scale must be row, column or none, not {scale!r}")
    return z_scored(values, "feature_id" if scale == "row" else "cell_id", cells if scale == "row" else features)


def trimmed(values: DataFrame, trim: tuple[float, float] = (-2, 2)) -> DataFrame:
    if len(trim) != 2:
        raise ValueError("trim needs two bounds")
    return values.withColumn("value", clip(F.col("value"), *trim))


def min_max(values: DataFrame, by: str) -> DataFrame:
    """value mapped to 0..1 within each group."""
    ends = values.groupBy(F.col(by).alias("__by")).agg(F.min("value").alias("__low"), F.max("value").alias("__high"))  # a row a group
    low, high = F.col("__low"), F.col("__high")
    out = values.join(ends, F.col(by).eqNullSafe(F.col("__by")))
    return out.withColumn("value", F.when(high > low, (F.col("value") - low) / (high - low)).otherwise(F.lit(0.0))).drop("__by", "__low", "__high")


def softmax(scores: DataFrame, by: str, score: str = "score") -> DataFrame:
    """Log-probabilities as probabilities of each group, shifted by the largest."""
    w = Window.partitionBy(by)
    e = scores.withColumn("e", F.exp(F.col(score) - F.max(score).over(w)))
    return e.withColumn("probability", F.col("e") / F.sum("e").over(w)).drop("e")


def log_sum_exp(scores: DataFrame, by: str, score: str = "score") -> DataFrame:
    """(by, value): stable ln of the sum of exp(score)."""
    top = scores.withColumn("top", F.max(score).over(Window.partitionBy(by)))
    return top.groupBy(by).agg((F.first("top") + F.log(F.sum(F.exp(F.col(score) - F.col("top"))))).alias("value"))


def prop_table(values: DataFrame, by: str, column: str = "n") -> DataFrame:
    return values.withColumn("value", F.col(column) / F.sum(column).over(Window.partitionBy(by)))


def log_normalized(counts: DataFrame) -> DataFrame:
    """log2(n / size factor + 1); size factors are totals relative to their mean."""
    return normalized(counts, "mean", transformation="log2", pseudo_transform=1)

