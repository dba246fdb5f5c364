"""The tables behind the plots: what each draws, in long form, not the pixels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from countloom.operators import aggregate, factorize, filters, normalize, rank
from countloom.sources.matrix import Experiment


def violin(x: Experiment, features: list[int]) -> DataFrame:
    """(z, feature_id, cell_id, value) for listed features, zeros filled in."""
    grid = x.cells.select("cell_id", "z", F.explode(F.array(*[F.lit(f).cast("long") for f in features])).alias("feature_id"))
    return grid.join(x.counts, ["feature_id", "cell_id"], "left").select("z", "feature_id", "cell_id", F.coalesce("n", F.lit(0)).alias("value"))


def reduced_features(x: Experiment, dims: DataFrame, features: list[int], normalize_: bool = False, z_score: bool = True, trim: tuple[float, float] | None = (-2, 2)) -> DataFrame:
    """(cell_id, dim1, dim2, feature_id, value): listed features over an embedding."""
    counts = normalize.normalized(x.counts) if normalize_ else x.counts.select("feature_id", "cell_id", F.col("n").cast("double").alias("value"))
    values = counts.where(F.col("feature_id").isin(features))
    zero = F.lit(0.0)
    if z_score:
        values = normalize.z_scored(values, "feature_id", x.cells.count())
        zeros = values.groupBy("feature_id").agg(F.first("zero").alias("zero"))
    else:
        zeros = values.groupBy("feature_id").agg(F.first(zero).alias("zero"))
    grid = filters.embedded(x.cells.select("cell_id"), dims).select("cell_id", "dim1", "dim2", F.explode(F.array(*[F.lit(f).cast("long") for f in features])).alias("feature_id"))
    out = grid.join(values.select("feature_id", "cell_id", "value"), ["feature_id", "cell_id"], "left").join(zeros, "feature_id", "left")
    out = out.select("cell_id", "dim1", "dim2", "feature_id", F.coalesce("value", "zero").alias("value"))
    return normalize.trimmed(out, trim) if trim else out


def reduced_modules(x: Experiment, dims: DataFrame, rescale: bool = True) -> DataFrame:
    """(cell_id, dim1, dim2, y, value): module shares of each cell over an embedding, each module from 0 to 1."""
    shares = normalize.prop_table(aggregate.filled(aggregate.by_module(x.counts, x.features), x.cells.select("cell_id"), "y", x.params["L"]), "cell_id")
    shares = normalize.min_max(shares, "y") if rescale else shares
    return filters.embedded(x.cells.select("cell_id"), dims).join(shares.select("cell_id", "y", "value"), "cell_id")


def reduced_clusters(x: Experiment, dims: DataFrame, only: list[int] | None = None) -> tuple[DataFrame, DataFrame]:
    """Cells over an embedding with their cluster, and where the clusters' labels go."""
    points = filters.embedded(x.cells.select("cell_id", "z"), dims)
    if only:
        points = points.where(F.col("z").isin(only))
    return points, rank.centroids(points)


def heatmap(x: Experiment, features: list[int] | None = None, how: str = "proportion", transformation: str = "sqrt", trim: tuple[float, float] = (-2, 2)) -> DataFrame:
    """(feature_id, cell_id, value, zero): normalised, transformed, standardised by feature and trimmed. `zero` is what
    absent cells of the feature show."""
    values = normalize.z_scored(normalize.normalized(x.counts, how, transformation=transformation), "feature_id", x.cells.count(), missing_zero=True)
    if features is not None:
        values = values.where(F.col("feature_id").isin(features))
    from countloom.functions.special import clip

    return normalize.trimmed(values, trim).withColumn("zero", clip(F.col("zero"), *trim))


def top_feature_heatmap(x: Experiment, n: int = 25) -> DataFrame:
    """The heatmap of each module's top features."""
    totals = aggregate.totals(x.counts, "feature_id").join(x.features.select("feature_id", "y"), "feature_id")
    top = rank.top_rank(totals, n, "y", "feature_id", "n").select("feature_id", "y")
    shares = normalize.normalized(x.counts, transformation="sqrt")
    return shares.join(top, "feature_id").join(x.cells.select("cell_id", "z"), "cell_id")


def module_heatmap(x: Experiment, top_cells: int = 100, top_features: int | None = None, trim: tuple[float, float] = (-2, 2)) -> DataFrame:
    """(y, place, cell_id, feature_id, value): for each module its features over the cells where it is weakest and
    strongest."""
    shares = normalize.prop_table(aggregate.by_module(x.counts, x.features), "cell_id")
    shares = aggregate.filled(shares.select("cell_id", "y", F.col("value").alias("n")), x.cells.select("cell_id"), "y", x.params["L"]).withColumnRenamed("n", "value")
    cells = rank.head_and_tail(shares, top_cells).select("y", "place", "cell_id")
    values = heatmap(x, None, trim=trim).join(x.features.select("feature_id", "y"), "feature_id")
    if top_features is not None:
        totals = aggregate.totals(x.counts, "feature_id").join(x.features.select("feature_id", "y"), "feature_id")
        values = values.join(rank.top_rank(totals, top_features, "y", "feature_id", "n").select("feature_id"), "feature_id", "left_semi")
    return cells.join(values, ["y", "cell_id"]).select("y", "place", "cell_id", "feature_id", "value")


def probability_map(x: Experiment, level: str = "cellPopulation") -> DataFrame:
    """(row, column, probability, relative): shares, and their square roots standardised by row. cellPopulation: module
    by cluster; sample: cluster by sample. Groups without members are left out."""
    if level not in ("cellPopulation", "sample"):
        raise ValueError(f"unknown level {level!r}")
    if level == "cellPopulation":
        view = factorize.population_part(x, "posterior")
        live = x.cells.select(F.col("z").cast("string").alias("column")).distinct()
        view = view.join(live, "column", "left_semi")
    else:
        view = factorize.sample_part(x, "proportion")
        live = x.cells.select(F.col("z").cast("string").alias("row")).distinct()
        view = view.join(live, "row", "left_semi")
    from pyspark.sql.window import Window

    w = Window.partitionBy("row")
    root = F.sqrt("value")
    sd = F.stddev_samp(root).over(w)
    return view.select("row", "column", F.col("value").alias("probability"), F.when(sd > 0, (root - F.avg(root).over(w)) / sd).otherwise(F.lit(0.0)).alias("relative"))


def ordered_facets(points: DataFrame, facet: str = "feature_id", value: str = "value", item: str = "cell_id", decreasing: bool = False) -> DataFrame:
    """points with place: the order in which each facet's points are drawn, by value, ties by item."""
    order = F.desc(value) if decreasing else F.asc(value)
    return points.withColumn("place", F.row_number().over(Window.partitionBy(facet).orderBy(order, item)))


def color_breaks(values: DataFrame, colors: int, center: bool = True) -> DataFrame:
    """(place, value): the colors + 1 ends of the colours' intervals, evenly spaced over the values, or with center over
    -m to m for the largest absolute value m."""
    if colors < 1:
        raise ValueError("at least one colour is needed")
    low, high = (-F.max(F.abs("value")), F.max(F.abs("value"))) if center else (F.min("value"), F.max("value"))
    ends = values.agg(low.cast("double").alias("low"), high.cast("double").alias("high")).where("low IS NOT NULL")
    ends = ends.select("low", "high", F.explode(F.sequence(F.lit(0), F.lit(colors))).alias("place"))
    return ends.select("place", (F.col("low") + (F.col("high") - F.col("low")) * F.col("place") / colors).alias("value"))


def row_clusters(values: DataFrame, columns: list, k: int, row: str = "feature_id", column: str = "z", seed: int = 12345) -> tuple[DataFrame, DataFrame]:
    """Rows of a heatmap by k-means over listed columns (absent entries are zeros): (row, cluster), and the centres that are
    drawn in their place (cluster, size, column, value). Clusters are 1..k."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    wide = values.groupBy(row).pivot(column, columns).agg(F.first("value").cast("double")).na.fill(0.0)
    points = wide.select(row, array_to_vector(F.array(*[F.col(f"`{c}`") for c in columns])).alias("features"))
    model = KMeans(k=k, seed=seed, maxIter=100).fit(points)
    labels = model.transform(points).select(row, (F.col("prediction") + 1).cast("int").alias("cluster"))
    sizes = labels.groupBy("cluster").agg(F.count("*").alias("size"))
    centres = [(i + 1, c, float(v)) for i, centre in enumerate(model.clusterCenters()) for c, v in zip(columns, centre, strict=True)]  # k x columns
    kind = values.schema[column].dataType.simpleString()
    table = values.sparkSession.createDataFrame(centres, f"cluster int, {column} {kind}, value double")
    return labels, table.join(sizes, "cluster").select("cluster", "size", column, "value")


def search_perplexity(points: DataFrame) -> DataFrame:
    """(K, L, perplexity): the line through the resamples of a search."""
    return rank.mean_by(points, "perplexity", "K", "L")


def perplexity_rate(points: DataFrame) -> DataFrame:
    """(K, L, change, smooth): the mean change of each step and a smoothing spline through it."""
    from countloom.plans.kernels import smooth

    means = rank.mean_by(rank.perplexity_change(points).where("change IS NOT NULL"), "change", "K", "L").orderBy("L", "K").toPandas()  # a row a model size
    means["smooth"] = smooth(means["change"].to_numpy()) if len(means) else []
    return points.sparkSession.createDataFrame(means, "K int, L int, change double, smooth double")


def contamination(cells: DataFrame, dims: DataFrame) -> DataFrame:
    """Cells over an embedding with their contamination."""
    return filters.embedded(cells.select("cell_id", "contamination"), dims)


def marker_expression(x: Experiment, markers: DataFrame, assays: list[str], log1p: bool = False) -> DataFrame:
    """(assay, z, cell_type, feature_id, cell_id, value): markers in several assays, zeros filled in."""
    listed = [r.feature_id for r in markers.select("feature_id").distinct().collect()]  # a marker list is a user's
    out = None
    for name in assays:
        part = violin(Experiment(x.assay(name), x.cells, x.features), listed).join(markers, "feature_id")
        value = F.log1p(F.col("value").cast("double")) if log1p else F.col("value").cast("double")
        part = part.select(F.lit(name).alias("assay"), "z", "cell_type", "feature_id", "cell_id", value.alias("value"))
        out = part if out is None else out.unionByName(part)
    return out


def distinct_colors(n: int, hues: tuple[str, ...] = ("red", "cyan", "orange", "blue", "yellow", "purple", "green", "magenta"), saturation: tuple[float, float] = (0.7, 1), value: tuple[float, float] = (0.7, 1)) -> list[str]:
    """n colours: the hues in turn, then again with more saturation and less brightness."""
    import colorsys

    angle = {"red": 0, "orange": 39, "yellow": 60, "green": 120, "cyan": 180, "blue": 240, "purple": 277, "magenta": 300}
    unknown = [h for h in hues if h not in angle]
    if unknown:
        raise ValueError(f"unknown hues: {', '.join(unknown)}")
    turns = -(-n // len(hues))
    out = []
    for t in range(turns):
        share = t / max(turns - 1, 1)
        s, v = saturation[0] + share * (saturation[1] - saturation[0]), value[1] - share * (value[1] - value[0])
        for h in hues:
            out.append("#%02X%02X%02X" % tuple(round(255 * c) for c in colorsys.hsv_to_rgb(angle[h] / 360, s, v)))
    return out[:n]


def heatmap_order(values: DataFrame, labels: DataFrame, item: str, other: str, label: str, method: str = "ward.D2", limit: int = 2000) -> DataFrame:
    """(item, label, place): items ordered by agglomerative clustering within their label, labels in numeric order; at
    most `limit` items, as the linkage holds all their distances."""
    import numpy as np

    from countloom.plans.kernels import complete_order

    listed = labels.select(item, label).orderBy(label, item).limit(limit + 1).toPandas()
    if len(listed) > limit:
        raise ValueError(f"more than {limit} items to order")
    rows = values.join(labels.select(item), item, "left_semi").select(item, other, "value").toPandas()
    wide = rows.pivot_table(index=item, columns=other, values="value", fill_value=0.0)
    wide = wide.reindex(listed[item], fill_value=0.0)
    out = []
    for name, group in listed.groupby(label, sort=True):
        m = wide.loc[group[item]].to_numpy()
        n = (m**2).sum(axis=1)
        d = np.sqrt(np.maximum(n[:, None] + n - 2 * m @ m.T, 0))
        order = complete_order(d, method) if len(group) > 1 else np.array([0])
        out += [(int(group[item].iloc[i]), int(name)) for i in order]
    return values.sparkSession.createDataFrame([(i, z, p + 1) for p, (i, z) in enumerate(out)], f"{item} long, {label} int, place int")
