"""Distances between the columns of a matrix whose columns are few: cluster profiles, samples, modules.

Each works on (item, column, value) without zeros. A distance comes from sums over the items that both columns hold and
from the columns' own sums; pairs of columns that share no item are added from the columns' list.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def pairs(values: DataFrame, columns: int, *terms) -> DataFrame:
    """(a, b, one sum for each term) for a < b: a term is a function of both values, zero if both are."""
    item, column = values.columns[:2]
    rows = values.groupBy(item).agg(F.map_from_entries(F.collect_list(F.struct(column, F.col(values.columns[2]).cast("double")))).alias("row"))
    # a row of the grid for each item: its columns are few
    levels = F.sequence(F.lit(1), F.lit(columns))
    grid = rows.select("row", F.explode(levels).alias("a")).select("row", "a", F.explode(F.when(F.col("a") < columns, F.sequence(F.col("a") + 1, F.lit(columns)))).alias("b"))
    x, y = F.coalesce(F.col("row")[F.col("a")], F.lit(0.0)), F.coalesce(F.col("row")[F.col("b")], F.lit(0.0))
    return grid.select("a", "b", x.alias("x"), y.alias("y")).groupBy("a", "b").agg(*[t(F.col("x"), F.col("y")).alias(f"t{i}") for i, t in enumerate(terms)])


def cosine(values: DataFrame, columns: int) -> DataFrame:
    """(1 - cosine) / 2"""
    p = pairs(values, columns, lambda x, y: F.sum(x * y), lambda x, y: F.sum(x * x), lambda x, y: F.sum(y * y))
    return p.select("a", "b", ((1 - F.col("t0") / F.sqrt(F.col("t1") * F.col("t2"))) / 2).alias("distance"))


def hellinger(values: DataFrame, columns: int) -> DataFrame:
    p = pairs(values, columns, lambda x, y: F.sum(F.pow(F.sqrt(x) - F.sqrt(y), 2)))
    return p.select("a", "b", (F.sqrt("t0") / F.sqrt(F.lit(2.0))).alias("distance"))


def spearman(values: DataFrame, columns: int, items: int) -> DataFrame:
    """(1 - rank correlation) / 2 over `items` rows, ties at their mean rank; absent values are zeros and tie."""
    item, column, value = values.columns[:3]
    w = Window.partitionBy(column)
    low = F.count_if(F.col(value) < 0).over(w)
    held = F.count("*").over(w)
    rank = F.rank().over(w.orderBy(value)) + (F.count("*").over(Window.partitionBy(column, value)) - 1) / 2
    rank = F.when(F.col(value) > 0, rank + items - held).otherwise(rank)
    zero = low + (items - held + 1) / 2  # the mean rank of the absent
    ranked = values.select(item, F.col(column).alias("c"), (rank - zero).alias("r"), (zero - (items + 1) / 2).alias("z"))
    # with r relative to the zeros' rank, absent items add nothing to the sums
    z = ranked.groupBy("c").agg(F.first("z").alias("z"), F.sum("r").alias("s"), F.sum(F.col("r") * F.col("r")).alias("q"))
    var = F.col("q") + F.col("s") * F.col("z") * 2 + F.col("z") * F.col("z") * items
    z = z.select("c", "z", "s", var.alias("v"))
    dot = pairs(ranked.select(item, "c", "r"), columns, lambda x, y: F.sum(x * y))
    za, zb = z.select(*[F.col(k).alias(f"a{k}") for k in z.columns]), z.select(*[F.col(k).alias(f"b{k}") for k in z.columns])
    cov = F.col("t0") + F.col("as") * F.col("bz") + F.col("bs") * F.col("az") + F.col("az") * F.col("bz") * items
    joined = dot.join(F.broadcast(za), F.col("a") == F.col("ac")).join(F.broadcast(zb), F.col("b") == F.col("bc"))  # a row a column
    return joined.select("a", "b", ((1 - cov / F.sqrt(F.col("av") * F.col("bv"))) / 2).alias("distance"))


def distance(values: DataFrame, columns: int, items: int, method: str = "euclidean", p: float = 2) -> DataFrame:
    """(a, b, distance): correlation (1 - r), euclidean, maximum, manhattan, canberra, binary or minkowski."""
    if method == "correlation":
        s = pairs(values, columns, *[lambda x, y: F.sum(x * y), lambda x, y: F.sum(x), lambda x, y: F.sum(y), lambda x, y: F.sum(x * x), lambda x, y: F.sum(y * y)])
        cov = F.col("t0") * items - F.col("t1") * F.col("t2")
        sd = F.sqrt((F.col("t3") * items - F.col("t1") * F.col("t1")) * (F.col("t4") * items - F.col("t2") * F.col("t2")))
        return s.select("a", "b", (1 - cov / sd).alias("distance"))
    one = {
        "euclidean": (lambda x, y: F.sum(F.pow(x - y, 2)), lambda t: F.sqrt(t)),
        "maximum": (lambda x, y: F.max(F.abs(x - y)), lambda t: t),
        "manhattan": (lambda x, y: F.sum(F.abs(x - y)), lambda t: t),
        "canberra": (lambda x, y: F.sum(F.when(F.abs(x) + F.abs(y) > 0, F.abs(x - y) / (F.abs(x) + F.abs(y)))), lambda t: t),
        "binary": (lambda x, y: F.count_if((x != 0) != (y != 0)) / F.count_if((x != 0) | (y != 0)), lambda t: t),
        "minkowski": (lambda x, y: F.sum(F.pow(F.abs(x - y), p)), lambda t: F.pow(t, 1 / p)),
    }
    if method not in one:
        raise ValueError(f"unknown distance {method!r}")
    term, end = one[method]
    return pairs(values, columns, term).select("a", "b", end(F.col("t0")).alias("distance"))
