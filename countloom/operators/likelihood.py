"""Log-likelihoods and perplexities of clusterings.

A zero count adds lgamma(prior), which cancels against the constant term, so sums run over the non-zero entries only:
the sum of lgamma(n + b) - lgamma(b).
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from countloom.functions.special import lgamma
from countloom.operators import aggregate, factorize, normalize
from countloom.sources.matrix import Experiment


def _checked(label: str, levels: int, missing: int | None, lo: int | None, hi: int | None) -> None:
    if missing:
        raise ValueError(f"{label} is missing for {missing} items")
    if lo is not None and (lo < 1 or hi > levels):
        raise ValueError(f"{label} must lie within 1..{levels}; it runs from {lo} to {hi}")


def _wide(counts: DataFrame, labels: DataFrame, item: str, label: str, levels: int, other: str) -> DataFrame:
    """(other, by): an array of the sums by label of each row of the other axis."""
    each = [F.coalesce(F.sum(F.when(F.col(label) == i, F.col("n"))), F.lit(0)) for i in range(1, levels + 1)]
    return counts.join(labels.select(item, label), item).groupBy(other).agg(F.array(*each).alias("by"))


def _gains(by: str, levels: int, prior: float) -> F.Column:
    """The sum of lgamma(n + prior) - lgamma(prior) over an array's numbers."""
    return sum((lgamma(F.col(by)[i] + prior) for i in range(1, levels)), lgamma(F.col(by)[0] + prior)) - levels * math.lgamma(prior)


def _ends(totals: list[float], width: int, prior: float) -> float:
    return len(totals) * math.lgamma(width * prior) - sum(math.lgamma(n + width * prior) for n in totals)


def theta(x: Experiment) -> float:
    """Clusters by sample, in one pass over the cells."""
    alpha, k = x.params["alpha"], x.params["K"]
    by = x.cells.groupBy("sample", "z").agg(F.count("*").alias("n")).groupBy("sample")
    by = by.agg(F.sum(lgamma(F.col("n") + alpha)).alias("gain"), F.count("*").alias("have"), F.sum("n").alias("n"), F.min("z").alias("lo"), F.max("z").alias("hi"), F.sum(F.when(F.col("z").isNull(), F.col("n"))).alias("missing"))
    samples, gain, have, ends, missing, lo, hi = by.agg(F.count("*"), F.sum("gain"), F.sum("have"), F.sum(lgamma(F.col("n") + k * alpha)), F.sum("missing"), F.min("lo"), F.max("hi")).first()
    _checked("z", k, missing, lo, hi)
    if not samples:
        return 0.0
    return samples * (math.lgamma(k * alpha) - k * math.lgamma(alpha)) + gain + (samples * k - have) * math.lgamma(alpha) - ends


def phi_c(x: Experiment) -> float:
    """Features by cluster, in one pass over the counts."""
    k, beta = x.params["K"], x.params["beta"]
    per = x.features.select("feature_id").join(_wide(x.counts, x.cells, "cell_id", "z", k, "feature_id"), "feature_id", "left")
    row = per.agg(F.count("*"), F.sum(_gains("by", k, beta)), *[F.sum(F.col("by")[i]) for i in range(k)]).first()
    return (row[1] or 0.0) + _ends([n or 0 for n in row[2:]], row[0], beta)


def phi_g(x: Experiment) -> float:
    """Modules by cell, in one pass over the counts."""
    modules, beta = x.params["L"], x.params["beta"]
    per = x.cells.select("cell_id").join(_wide(x.counts, x.features, "feature_id", "y", modules, "cell_id"), "cell_id", "left")
    n = F.coalesce(sum((F.col("by")[i] for i in range(1, modules)), F.col("by")[0]), F.lit(0))
    cells, gain, ends = per.agg(F.count("*"), F.sum(_gains("by", modules, beta)), F.sum(lgamma(n + modules * beta))).first()
    return cells * math.lgamma(modules * beta) + (gain or 0.0) - (ends or 0.0)


def _modules(x: Experiment, per: DataFrame, sums: int) -> tuple[float, list]:
    """psi and eta, and the sums by cluster of each module. per: (feature_id, by); module sizes count one pseudo-feature
    each. A row a module is all that comes to the driver."""
    delta, gamma, modules = x.params["delta"], x.params["gamma"], x.params["L"]
    n = sum((F.col("by")[i] for i in range(1, sums)), F.col("by")[0])
    joined = x.features.select("feature_id", "y").join(per, "feature_id", "left").withColumn("total", n)
    rows = joined.groupBy("y").agg(F.count("*").alias("genes"), F.coalesce(F.sum("total"), F.lit(0)).alias("n"), F.coalesce(F.sum(lgamma(F.col("total") + delta)), F.lit(0.0)).alias("gain"), *[F.coalesce(F.sum(F.col("by")[i]), F.lit(0)).alias(f"s{i}") for i in range(sums)])
    out_of = F.col("y").isNull() | (F.col("y") < 1) | (F.col("y") > modules)
    rows = rows.withColumn("label", F.when(~out_of, F.col("y"))).groupBy("label").agg(*[F.sum(c).alias(c) for c in rows.columns if c != "y"], F.min("y").alias("lo"), F.max("y").alias("hi"), F.sum(F.when(F.col("y").isNull(), F.col("genes"))).alias("missing")).collect()
    for r in rows:
        _checked("y", modules, r.missing, r.lo, r.hi)
    by = {r.label: r for r in rows}
    size = [1 + (by[y].genes if y in by else 0) for y in range(1, modules + 1)]
    total = [by[y].n if y in by else 0 for y in range(1, modules + 1)]
    psi = sum(math.lgamma(a * delta) - a * math.lgamma(delta) - math.lgamma(b + a * delta) for a, b in zip(size, total, strict=True)) + sum(r.gain for r in rows)
    eta = math.lgamma(modules * gamma) - modules * math.lgamma(gamma) + sum(math.lgamma(a + gamma) for a in size) - math.lgamma(sum(a + gamma for a in size))
    return psi + eta, [[by[y][f"s{i}"] if y in by else 0 for i in range(sums)] for y in range(1, modules + 1)]


def psi_and_eta(x: Experiment) -> float:
    totals = aggregate.totals(x.counts, "feature_id").select("feature_id", F.array("n").alias("by"))
    return _modules(x, totals, 1)[0]


def modules_and_clusters(x: Experiment) -> float:
    """Modules by cluster, psi and eta, in one pass over the counts."""
    k, modules, beta = x.params["K"], x.params["L"], x.params["beta"]
    rest, sums = _modules(x, _wide(x.counts, x.cells, "cell_id", "z", k, "feature_id"), k)
    gain = sum(math.lgamma(n + beta) - math.lgamma(beta) for row in sums for n in row)
    return rest + gain + _ends([sum(row[i] for row in sums) for i in range(k)], modules, beta)


TERMS = {"c": (theta, phi_c), "g": (phi_g, psi_and_eta), "cg": (theta, modules_and_clusters)}


def log_likelihood(x: Experiment, model: str) -> float:
    """Two passes at most: over the cells, and over the counts once for each axis of the model. Missing labels and labels out
    of range are errors."""
    return sum(term(x) for term in TERMS[model])


def _labels_by(view: DataFrame, part: str, row: str, column: str, kinds: tuple[str, str], name: str) -> DataFrame:
    v = view.where(F.col("part") == part)
    return v.select(F.col("row").try_cast(kinds[0]).alias(row), F.col("column").try_cast(kinds[1]).alias(column), F.col("value").alias(name))


def cell_scores(x: Experiment, model: str, counts: DataFrame | None = None) -> DataFrame:
    """(cell_id, z, score): log of a cell's counts and cluster, from posterior means: n * log p summed, plus log theta of
    the cell's sample."""
    view = factorize.factorized(x, model, "posterior")
    counts = x.counts if counts is None else counts
    log_theta = _labels_by(view, "sample", "z", "sample", ("int", "string"), "theta").withColumn("theta", F.log("theta"))
    if model == "c":
        logs = _labels_by(view, "module", "feature_id", "z", ("long", "int"), "p").withColumn("p", F.log("p"))
    else:
        psi_ = _labels_by(view, "module", "feature_id", "y", ("long", "int"), "psi")
        logs = psi_.join(_labels_by(view, "cellPopulation", "y", "z", ("int", "int"), "phi"), "y").select("feature_id", "z", F.log(F.col("psi") * F.col("phi")).alias("p"))
    # a row of K logs for each feature and K sums for each cell: an entry is read once, not once for every cluster
    k = x.params["K"]
    rows = logs.groupBy("feature_id").agg(F.map_from_entries(F.collect_list(F.struct("z", "p"))).alias("p"))  # K entries
    rows = rows.select("feature_id", F.array(*[F.col("p")[z] for z in range(1, k + 1)]).alias("p"))
    sums = counts.join(rows, "feature_id").groupBy("cell_id").agg(*[F.sum(F.col("n") * F.col("p")[z]).alias(f"s{z}") for z in range(k)])
    inner = sums.select("cell_id", F.posexplode(F.array(*[f"s{z}" for z in range(k)])).alias("at", "score")).select("cell_id", (F.col("at") + 1).alias("z"), "score")
    return inner.join(x.cells.select("cell_id", "sample"), "cell_id").join(log_theta, ["z", "sample"]).select("cell_id", "z", (F.col("score") + F.col("theta")).alias("score"))


def perplexity(x: Experiment, model: str, counts: DataFrame | None = None) -> DataFrame:
    """One row: exp(- log p / n) of counts, which must have the features that the model has."""
    counts = x.counts if counts is None else counts
    if not counts.join(x.features, "feature_id", "left_anti").isEmpty():
        raise ValueError("the new counts have features that the model does not have")
    total = counts.agg(F.sum("n")).first()[0]
    if model == "g":
        view = factorize.factorized(x, "g", "posterior")
        psi_ = _labels_by(view, "module", "feature_id", "y", ("long", "int"), "psi")
        phi = _labels_by(view, "cell", "y", "cell_id", ("int", "long"), "phi")
        return counts.join(psi_, "feature_id").join(phi, ["y", "cell_id"]).agg(F.exp(-F.sum(F.col("n") * F.log(F.col("psi") * F.col("phi"))) / total).alias("perplexity"))
    by_cell = normalize.log_sum_exp(cell_scores(x, model, counts), "cell_id")
    return by_cell.agg(F.exp(-F.sum("value") / total).alias("perplexity"))


def cell_conditional(x: Experiment) -> DataFrame:
    """(cell_id, z, score): unnormalised log-probability of each cluster for each cell, the cell itself taken out."""
    p, g = x.params, x.features.count()
    beta, k = p["beta"], p["K"]
    sums = aggregate.by_cluster(x.counts, x.cells)
    n_z = aggregate.filled(sums.groupBy("z").agg(F.sum("n").alias("n")).select(F.lit(0).alias("one"), "z", "n"), sums.sparkSession.range(1).select(F.col("id").cast("int").alias("one")), "z", k).select("z", F.col("n").alias("n_z"))
    cells = x.cells.select("cell_id", "sample", F.col("z").alias("own"))
    wide = sums.groupBy("feature_id").agg(F.map_from_entries(F.collect_list(F.struct("z", "n"))).alias("by"))  # at most K entries
    entries = x.counts.join(wide, "feature_id").join(cells, "cell_id").select("cell_id", "own", "sample", "n", "by", F.explode(F.sequence(F.lit(1), F.lit(k))).alias("z"))
    have = F.coalesce(F.col("by")[F.col("z")], F.lit(0)) - F.when(F.col("z") == F.col("own"), F.col("n")).otherwise(0)
    gain = lgamma(have + F.col("n") + beta) - lgamma(have + beta)
    inner = entries.groupBy("cell_id", "own", "sample", "z").agg(F.sum(gain).alias("gain"), F.sum("n").alias("n_c"))
    table = aggregate.cluster_by_sample(x.cells, k)
    joined = inner.join(table, ["z", "sample"]).join(F.broadcast(n_z), "z")  # K rows
    mine = (F.col("z") == F.col("own")).cast("int")
    n_z = F.col("n_z") - mine * F.col("n_c")
    score = F.log(F.col("cells") - mine + p["alpha"]) + F.col("gain") - lgamma(n_z + F.col("n_c") + g * beta) + lgamma(n_z + g * beta)
    return joined.select("cell_id", "z", score.alias("score"))


def feature_conditional(x: Experiment) -> DataFrame:
    """(feature_id, y, score): unnormalised log-probability of each module for each feature, itself taken out."""
    p = x.params
    beta, gamma, delta, modules = p["beta"], p["gamma"], p["delta"], p["L"]
    sums = aggregate.by_module(x.counts, x.features)
    wide = sums.groupBy("cell_id").agg(F.map_from_entries(F.collect_list(F.struct("y", "n"))).alias("by"))  # at most L entries
    own = x.features.select("feature_id", F.col("y").alias("own"))
    entries = x.counts.join(wide, "cell_id").join(own, "feature_id").select("feature_id", "own", "n", "by", F.explode(F.sequence(F.lit(1), F.lit(modules))).alias("y"))
    have = F.coalesce(F.col("by")[F.col("y")], F.lit(0)) - F.when(F.col("y") == F.col("own"), F.col("n")).otherwise(0)
    gain = lgamma(have + F.col("n") + beta) - lgamma(have + beta)
    inner = entries.groupBy("feature_id", "own", "y").agg(F.sum(gain).alias("gain"), F.sum("n").alias("n_g"))
    sizes = aggregate.module_sizes(x.features, modules).join(sums.groupBy("y").agg(F.sum("n").alias("n_y")), "y", "left").na.fill(0, ["n_y"])
    joined = inner.join(F.broadcast(sizes), "y")  # L rows
    mine = (F.col("y") == F.col("own")).cast("int")
    size, n_y = F.col("genes") - mine, F.col("n_y") - mine * F.col("n_g")
    score = F.col("gain") + lgamma(size + 1 + gamma) - lgamma(size + gamma) + lgamma((size + 1) * delta) - lgamma(size * delta) + lgamma(n_y + size * delta) - lgamma(n_y + F.col("n_g") + (size + 1) * delta)
    return joined.select("feature_id", "y", score.alias("score"))


def cell_conditional_of_modules(x: Experiment) -> DataFrame:
    """cell_conditional() where clusters and modules are modelled together: on module sums."""
    from dataclasses import replace

    sums = aggregate.by_module(x.counts, x.features).select(F.col("y").cast("long").alias("feature_id"), "cell_id", "n")
    levels = x.counts.sparkSession.range(1, x.params["L"] + 1).select(F.col("id").alias("feature_id"))
    return cell_conditional(replace(x, counts=sums, features=levels))


def feature_conditional_of_clusters(x: Experiment) -> DataFrame:
    """feature_conditional() where both are modelled together: on cluster sums."""
    from dataclasses import replace

    sums = aggregate.by_cluster(x.counts, x.cells).select("feature_id", F.col("z").cast("long").alias("cell_id"), "n")
    return feature_conditional(replace(x, counts=sums))
