"""Operators against small matrices worked out by hand or in numpy."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from countloom.functions.special import clip, lgamma, transform
from countloom.operators import aggregate, contamination, distances, factorize, filters, likelihood, normalize, rank
from countloom.plans import kernels, plots
from countloom.sources import matrix, simulate

X = np.random.default_rng(4).poisson(1.3, (12, 9))
X[:, 0] += 1
X[0] += 1
Z = np.array([0, 1, 2, 0, 1, 2, 0, 1, 2])
Y = np.arange(12) % 4
S = np.arange(9) % 2
PRIORS = kernels.Priors(1.0, 0.7, 1.3, 2.0)


@pytest.fixture(scope="module")
def x(spark):
    counts = spark.createDataFrame([(i, j, int(X[i, j])) for i in range(12) for j in range(9) if X[i, j]], "feature_id long, cell_id long, n long")
    cells = spark.createDataFrame([(j, f"c{j}", f"s{S[j]}", int(Z[j]) + 1) for j in range(9)], "cell_id long, name string, sample string, z int")
    features = spark.createDataFrame([(i, f"g{i}", int(Y[i]) + 1) for i in range(12)], "feature_id long, name string, y int")
    return matrix.Experiment(counts.cache(), cells.cache(), features.cache(), {"K": 3, "L": 4, "alpha": 1.0, "beta": 0.7, "delta": 1.3, "gamma": 2.0})


def dense(df, a, b, value="n", shape=(12, 9)):
    out = np.zeros(shape)
    for r in df.collect():
        out[r[a], r[b]] = r[value]
    return out


def zero_based(df, label):
    return df.withColumn(label, F.col(label) - 1)


def test_lgamma(spark):
    points = [1e-6, 0.1, 0.49, 0.5, 1.0, 2.5, 100.0, 74000.0]
    got = spark.createDataFrame([(p,) for p in points], "x double").select(lgamma(F.col("x"))).collect()
    for p, (g,) in zip(points, got, strict=True):
        assert abs(g - math.lgamma(p)) <= 1e-12 * max(1, abs(math.lgamma(p)))


def test_transform_and_clip(spark):
    with pytest.raises(ValueError):
        transform("cube")
    row = spark.range(1).select(clip(F.lit(5.0), 2, -2), clip(F.lit(-5.0), -2, 2), transform("sqrt")(F.lit(9.0))).first()
    assert tuple(row) == (2.0, -2.0, 3.0)


def test_group_sums_and_changes(x):
    by = aggregate.by_cluster(x.counts, x.cells)
    assert np.array_equal(dense(zero_based(by, "z"), "feature_id", "z", shape=(12, 3)), kernels.group_sums(X, Z, 3))
    moves = x.cells.where("cell_id < 4").select("cell_id", F.col("z").alias("old"), (F.col("z") % 3 + 1).alias("new"))
    new = Z.copy()
    new[:4] = (Z[:4] + 1) % 3
    got = aggregate.changed(by, x.counts, moves, "cell_id", "z")
    assert np.array_equal(dense(zero_based(got, "z"), "feature_id", "z", shape=(12, 3)), kernels.group_sums(X, new, 3))


def test_labels_are_checked(x):
    with pytest.raises(ValueError):
        aggregate.check_labels(x.cells, "z", 2)
    with pytest.raises(ValueError):
        aggregate.check_labels(x.cells.withColumn("z", F.lit(None).cast("int")), "z", 3)


def test_cross_tabulation_keeps_zeros(x):
    got = {(r.z, r["sample"]): r.cells for r in aggregate.cluster_by_sample(x.cells, 4).collect()}
    assert len(got) == 8 and got[4, "s0"] == 0 and sum(got.values()) == 9


@pytest.mark.parametrize("how", ["proportion", "cpm", "median", "mean"])
def test_normalized(x, how):
    total = X.sum(axis=0)
    want = X / {"proportion": total, "cpm": total / 1e6, "median": total / np.median(total), "mean": total / total.mean()}[how]
    assert np.allclose(dense(normalize.normalized(x.counts, how), "feature_id", "cell_id", "value"), want)


def test_z_scores_count_zeros(x):
    v = X / X.sum(axis=0)
    z = normalize.z_scored(normalize.normalized(x.counts), "feature_id", 9)
    want = (v - v.mean(axis=1, keepdims=True)) / v.std(axis=1, ddof=1, keepdims=True)
    got = dense(z, "feature_id", "cell_id", "value")
    assert np.allclose(got[X > 0], want[X > 0])
    zero = {r.feature_id: r.zero for r in z.collect()}
    assert all(abs(zero[i] - want[i, j]) < 1e-9 for i in range(12) for j in range(9) if X[i, j] == 0)


def test_features_are_selected(x):
    want = {i for i in range(12) if (X[i] >= 2).sum() >= 3}
    assert {r.feature_id for r in filters.frequent_features(x.counts, x.features, x.cells, 2, 3).collect()} == want
    assert filters.frequent_features(x.counts, x.features, x.cells, 0, 0).count() == 12
    sub = filters.select_features(x, 2, 3).subset()
    assert {r.feature_id for r in sub.counts.select("feature_id").distinct().collect()} == want
    with pytest.raises(ValueError):
        x.subset("nothing")


def test_lookup(x):
    got = {r.query: r.feature_id for r in filters.feature_index(["g3", "zz"], x.features).collect()}
    assert got == {"g3": 3, "zz": None}
    assert filters.feature_index(["^g1"], x.features, exact=False).first().feature_id == 1
    with pytest.raises(ValueError):
        filters.feature_index(["zz"], x.features)


def test_recode_and_relabel(x):
    assert [r.z for r in filters.recoded(x.cells, "z", [1, 2], [2, 1]).orderBy("cell_id").collect()][:3] == [2, 1, 3]
    with pytest.raises(ValueError):
        filters.recoded(x.cells, "z", [1], [2])
    with pytest.raises(ValueError):
        filters.relabelled(x.cells.withColumn("label", F.lit("a")))


def test_counts_are_checked(spark, x):
    with pytest.raises(ValueError):
        matrix.check_counts(x.counts.drop("n"))
    with pytest.raises(Exception, match="missing"):
        matrix.check_counts(spark.createDataFrame([(1, 1, None)], "feature_id long, cell_id long, n long")).collect()
    assert matrix.same_counts(x.counts, x.counts.orderBy("n"))
    assert not matrix.same_counts(x.counts, x.counts.where("cell_id > 0"), error=False)


def test_validation_finds_empty_axes(spark, x):
    more = x.features.unionByName(spark.createDataFrame([(99, "none", 1)], x.features.schema))
    with pytest.raises(ValueError, match="99"):
        filters.validate(x.counts, more, x.cells)


@pytest.mark.parametrize("metric", ["euclidean", "manhattan", "maximum", "minkowski", "binary", "canberra", "correlation"])
def test_distances(x, metric):
    m = kernels.group_sums(X, Z, 3).astype(float)
    m[3, 1] = 0
    sums = aggregate.by_cluster(x.counts, x.cells).where("NOT (feature_id = 3 AND z = 2)")
    a, b = m[:, 0], m[:, 1]
    some = a + b > 0
    want = {
        "euclidean": np.linalg.norm(a - b), "manhattan": abs(a - b).sum(), "maximum": abs(a - b).max(), "minkowski": (abs(a - b) ** 3).sum() ** (1 / 3),
        "binary": ((a != 0) != (b != 0)).sum() / ((a != 0) | (b != 0)).sum(), "canberra": (abs(a - b)[some] / (a + b)[some]).sum(), "correlation": 1 - np.corrcoef(a, b)[0, 1],
    }[metric]
    got = distances.distance(sums, 3, 12, metric, 3).where("a = 1 AND b = 2").first().distance
    assert got == pytest.approx(want)


@pytest.mark.parametrize("model", ["c", "g", "cg"])
def test_likelihood_is_that_of_the_kernel(x, model):
    want = {"c": lambda: kernels.ll_cells(X, S, Z, 3, PRIORS), "g": lambda: kernels.ll_features(X, Y, 4, PRIORS), "cg": lambda: kernels.ll_both(X, S, Z, Y, 3, 4, PRIORS)}[model]()
    assert likelihood.log_likelihood(x, model) == pytest.approx(want, abs=1e-8)


def test_conditionals_are_likelihood_differences(x):
    got = dense(zero_based(likelihood.cell_conditional(x), "z"), "cell_id", "z", "score", (9, 3))
    assert np.allclose(got, kernels.cell_conditionals(X, S, Z.copy(), 3, PRIORS))
    for c in range(3):
        base = []
        for k in range(3):
            z = Z.copy()
            z[c] = k
            base.append(kernels.ll_cells(X, S, z, 3, PRIORS))
        assert np.allclose(np.array(base) - base[0], got[c] - got[c, 0])
    got = dense(zero_based(likelihood.feature_conditional(x), "y"), "feature_id", "y", "score", (12, 4))
    assert np.allclose(got, kernels.feature_conditionals(X, Y.copy(), 4, PRIORS))
    base = []
    for k in range(4):
        y = Y.copy()
        y[2] = k
        base.append(kernels.ll_features(X, y, 4, PRIORS))
    assert np.allclose(np.array(base) - base[0], got[2] - got[2, 0])


def test_em_scores(x):
    got = dense(zero_based(likelihood.cell_scores(x, "c"), "z"), "cell_id", "z", "score", (9, 3))
    assert np.allclose(got, kernels.cell_scores(X, S, Z, 3, PRIORS))


def test_posteriors_add_up(x):
    for model in ("c", "g", "cg"):
        v = factorize.factorized(x, model, "posterior")
        for part in {r.part for r in v.select("part").distinct().collect()}:
            by = "part" if part == "geneDistribution" else "column"
            for r in v.where(F.col("part") == part).groupBy(by).agg(F.sum("value").alias("s")).collect():
                assert r.s == pytest.approx(1)


def test_top_rank(x):
    by = aggregate.by_cluster(x.counts, x.cells)
    rows = rank.top_rank(by, 3, "z", "feature_id", "n").where("z = 1").orderBy("rank").collect()
    m = kernels.group_sums(X, Z, 3)[:, 0]
    assert [r.feature_id for r in rows] == sorted(range(12), key=lambda i: (-m[i], i))[:3]
    assert rank.top_rank(by, 50, "z", "feature_id", "n", threshold=10**6).isEmpty()


def test_downsampling_keeps_quotas(spark):
    cells = spark.createDataFrame([(i, 1 if i < 60 else 2 if i < 90 else 3) for i in range(100)], "cell_id long, z int")
    got = {r.z: r["count"] for r in filters.sample_quota(cells, 60, 10).groupBy("z").count().collect()}
    assert sum(got.values()) == 60 and got[3] == 10 and min(got.values()) >= 10
    with pytest.raises(ValueError):
        filters.sample_quota(cells, 20, 10)


def test_contamination_step(x):
    theta = x.cells.select("cell_id", "z", (F.lit(0.3) + F.col("cell_id") / 20).alias("theta"))
    t = 0.3 + np.arange(9) / 20
    w = kernels.group_sums(X * t, Z, 3)
    phi, rest = w / w.sum(axis=0), w.sum(axis=1, keepdims=True) - w
    eta = rest / rest.sum(axis=0)
    profiles = contamination.initial(x, theta)
    assert np.allclose(dense(zero_based(profiles, "z"), "feature_id", "z", "phi", (12, 3)), phi)
    share = phi[:, Z] * t / (phi[:, Z] * t + eta[:, Z] * (1 - t))
    got = {r.cell_id: r for r in contamination.shares(x, theta, profiles).collect()}
    assert all(got[j].native == pytest.approx((X * share)[:, j].sum()) for j in range(9))
    ll = contamination.log_likelihood(x, theta, profiles).first()[0]
    assert ll == pytest.approx((X * np.log(phi[:, Z] * t + eta[:, Z] * (1 - t) + 1e-20)).sum())


def test_delta_is_recovered():
    p = np.random.default_rng(0).beta(8, 3, 40000)
    a, b = contamination.fitted_delta((np.log(p).mean(), np.log(1 - p).mean()), (1, 1))
    assert a == pytest.approx(8, rel=0.05) and b == pytest.approx(3, rel=0.05)


def test_markers_are_checked():
    assert contamination.check_markers({"a": ["x", "y"]}) == [("a", "x"), ("a", "y")]
    with pytest.raises(ValueError):
        contamination.check_markers({"a": ["x"]}, {"g1": [1, 2], "g2": [2]})


def test_module_table_sink(spark, x, tmp_path):
    table = rank.module_table(x.features, aggregate.totals(x.counts, "feature_id"), 4)
    matrix.write_module_table(table, f"file://{tmp_path}/t")
    again = spark.read.option("sep", "\t").option("header", True).csv(f"file://{tmp_path}/t")
    assert again.columns == ["rank", "L1", "L2", "L3", "L4"] and again.count() == table.count()


def test_simulation_is_reproducible(spark):
    key = lambda e: sorted(map(tuple, e.counts.collect()))
    a, b, c = (simulate.simulate_cells(spark, "cg", samples=2, cells=(5, 8), genes=30, seed=s) for s in (1, 1, 2))
    assert key(a) == key(b) != key(c)
    x, native, names = simulate.simulate_contamination(spark, cells=20, genes=30)
    assert native.join(x.counts.withColumnRenamed("n", "total"), ["feature_id", "cell_id"]).where("n > total").isEmpty() and len(names) == 3


def test_colors():
    assert len(set(plots.distinct_colors(20))) == 20
    with pytest.raises(ValueError):
        plots.distinct_colors(2, hues=("mud",))
