"""Top-k, argmax and orders."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def top_rank(values: DataFrame, n: int = 25, by: str = "cell_id", item: str = "feature_id", value: str = "value", threshold: float | None = 0, decreasing: bool = True) -> DataFrame:
    """(by, rank, item, value): of each group the first k by value, ties by item; k is n or the number of values above
    threshold, whichever is less. Increasing order takes the k smallest of all values, above the threshold or not."""
    if decreasing and threshold is not None:  # those above the threshold come first
        values = values.where(F.col(value) > threshold)
    order = F.desc(value) if decreasing else F.asc(value)
    kept = values.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(order, item))).where(F.col("rank") <= n)
    if not decreasing and threshold is not None:
        above = values.groupBy(F.col(by).alias("__by")).agg(F.count_if(F.col(value) > threshold).alias("above"))  # a row a group
        kept = kept.join(above, F.col(by).eqNullSafe(F.col("__by"))).where(F.col("rank") <= F.col("above"))
    return kept.select(by, "rank", item, value)


def module_table(features: DataFrame, totals: DataFrame, modules: int, name: str = "feature_id") -> DataFrame:
    """(rank, L1, L2, ...): the features of each module by their counts, padded with empty strings."""
    listed = features.join(totals, "feature_id").where("n > 0")
    rank = F.row_number().over(Window.partitionBy("y").orderBy(F.desc("n"), "feature_id"))
    wide = listed.withColumn("rank", rank).groupBy("rank").pivot("y", list(range(1, modules + 1))).agg(F.first(F.col(name).cast("string")))
    return wide.select("rank", *[F.coalesce(F.col(str(y)), F.lit("")).alias(f"L{y}") for y in range(1, modules + 1)])


def head_and_tail(values: DataFrame, n: int, by: str = "y", item: str = "cell_id") -> DataFrame:
    """(by, place, item, value): the n items of largest and of smallest value of each group, all if there are at most 2 n;
    from the smallest to the largest. A group is thinned out in buckets of its items before it is ranked as a whole."""
    part = Window.partitionBy(by, F.pmod(F.xxhash64(item), F.lit(64)))
    first = values.withColumn("place", F.row_number().over(part.orderBy("value", F.desc(item)))).withColumn("from_top", F.row_number().over(part.orderBy(F.desc("value"), item)))
    values = first.where((F.col("place") <= n) | (F.col("from_top") <= n)).drop("place", "from_top")
    w = Window.partitionBy(by)
    up, down = w.orderBy("value", F.desc(item)), w.orderBy(F.desc("value"), item)
    kept = values.withColumn("place", F.row_number().over(up)).withColumn("from_top", F.row_number().over(down))
    kept = kept.where((F.col("place") <= n) | (F.col("from_top") <= n))
    return kept.select(by, F.row_number().over(w.orderBy("place")).alias("place"), item, "value")


def best_label(scores: DataFrame, item: str, label: str = "z", score: str = "score") -> DataFrame:
    """(item, label): the label of largest score, the first of equals."""
    return scores.groupBy(item).agg(F.max_by(label, F.struct(F.col(score), -F.col(label))).alias(label))


def second_best(scores: DataFrame, own: DataFrame, item: str, label: str = "z", score: str = "score") -> DataFrame:
    """(item, label): the best label besides the item's own."""
    others = scores.join(own.select(item, F.col(label).alias("own")), item).where(F.col(label) != F.col("own"))
    return best_label(others, item, label, score)


def best_runs(runs: DataFrame, params: list[str]) -> DataFrame:
    """Of each combination of parameters the run of largest log-likelihood, the first of equals."""
    w = Window.partitionBy(*params).orderBy(F.desc("log_lik"), "index")
    return runs.withColumn("rank", F.row_number().over(w)).where("rank = 1").drop("rank")


def perplexity_change(points: DataFrame) -> DataFrame:
    """(K, L, resample, perplexity, change): against the previous K of the same L, or with one K the previous L."""
    several = points.select("K").distinct().limit(2).count() > 1
    along, within = ("K", "L") if several else ("L", "K")
    w = Window.partitionBy(within, "resample").orderBy(along)
    return points.withColumn("change", F.col("perplexity") - F.lag("perplexity").over(w))


def mean_by(points: DataFrame, value: str, *by: str) -> DataFrame:
    return points.groupBy(*by).agg(F.avg(value).alias(value))


def elbow(curve: DataFrame, x: str, y: str) -> DataFrame:
    """(x, y, distance from the chord between the ends, second difference, elbow: whether the distance is the largest)."""
    w = Window.partitionBy(F.lit(0)).orderBy(x)  # a row a model size
    every = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    x0, y0, x1, y1 = F.first(x).over(every), F.first(y).over(every), F.last(x).over(every), F.last(y).over(every)
    area = F.abs((x0 - x1) * (F.col(y) - y0) - (y0 - y1) * (F.col(x) - x0))
    out = curve.withColumn("distance", area / F.sqrt((x0 - x1) * (x0 - x1) + (y0 - y1) * (y0 - y1)))
    out = out.withColumn("second", F.lead(y).over(w) + F.lag(y).over(w) - F.col(y) * 2)
    best = F.max(F.struct("distance", -F.col(x))).over(every)
    return out.withColumn("elbow", F.struct("distance", -F.col(x)) == best)


def added_log_lik(a: DataFrame, b: DataFrame) -> DataFrame:
    """(iter, log_lik): two histories added, the shorter going on with its last value."""
    last = [h.agg(F.max_by("log_lik", "iter")).first()[0] or 0.0 for h in (a, b)]
    both = a.select("iter", F.col("log_lik").alias("a")).join(b.select("iter", F.col("log_lik").alias("b")), "iter", "full")
    return both.select("iter", (F.coalesce("a", F.lit(last[0])) + F.coalesce("b", F.lit(last[1]))).alias("log_lik"))


def centroids(points: DataFrame, by: str = "z") -> DataFrame:
    """(by, dim1, dim2): medians, where a label goes."""
    return points.groupBy(by).agg(F.percentile("dim1", F.lit(0.5)).alias("dim1"), F.percentile("dim2", F.lit(0.5)).alias("dim2"))


def trimmed_mean(values: DataFrame, by: str, value: str = "value", trim: float = 0.1) -> DataFrame:
    """(by, value): the mean without the lowest and highest share `trim` of the values."""
    w = Window.partitionBy(by)
    ranked = values.withColumn("rank", F.row_number().over(w.orderBy(value))).withColumn("size", F.count("*").over(w))
    cut = F.floor(F.col("size") * trim)
    return ranked.where((F.col("rank") > cut) & (F.col("rank") <= F.col("size") - cut)).groupBy(by).agg(F.avg(value).alias(value))


def quantile(values: DataFrame, by: str, q: float, value: str = "value") -> DataFrame:
    return values.groupBy(by).agg(F.percentile(value, F.lit(q)).alias(value))


def drawn_label(scores: DataFrame, item: str, label: str = "z", score: str = "score", seed: int = 12345) -> DataFrame:
    """(item, label): a draw from each item's log-probabilities, by adding Gumbel noise to them and taking the best. The
    noise is a hash of item, label and seed, so a draw does not depend on how rows are dealt out."""
    u = (F.pmod(F.xxhash64(item, label, F.lit(seed)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    return best_label(scores.withColumn("__drawn", F.col(score) - F.log(-F.log(u))), item, label, "__drawn")
