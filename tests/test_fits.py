"""Fits recover what was planted; invariants of the drivers."""

from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from countloom.operators import contamination
from countloom.plans import fits, kernels
from countloom.plans.kernels import Priors
from countloom.sources import matrix, simulate


def agreement(a, b):
    """Share of pairs on which two clusterings agree."""
    a, b = np.asarray(a), np.asarray(b)
    return ((a[:, None] == a) == (b[:, None] == b)).mean()


@pytest.fixture(scope="module")
def planted(spark):
    rng = np.random.default_rng(3)
    z, y = np.arange(60) % 3, np.arange(40) % 4
    rate = rng.gamma(0.5, 1, (4, 3))[y][:, z] * 4 + 0.05
    x = rng.poisson(rate)
    x[:, x.sum(axis=0) == 0] = 1
    x[x.sum(axis=1) == 0] = 1
    counts = spark.createDataFrame([(int(i), int(j), int(x[i, j])) for i, j in np.argwhere(x)], "feature_id long, cell_id long, n long").cache()
    cells = spark.createDataFrame([(i, "s") for i in range(60)], "cell_id long, sample string")
    features = spark.createDataFrame([(i,) for i in range(40)], "feature_id long")
    return matrix.Experiment(counts, cells, features, {"K": 3, "L": 4, "alpha": 1.0, "beta": 1.0, "delta": 1.0, "gamma": 1.0}), x, z, y


def test_cells(planted):
    e, x, z, _ = planted
    m = fits.cluster_cells(e, 3, chains=2)
    got = [r.z for r in m.z.orderBy("cell_id").collect()]
    assert agreement(got, z) > 0.95
    s = np.zeros(60, int)
    assert m.log_lik == pytest.approx(kernels.ll_cells(x, s, np.array(got) - 1, 3, Priors())) and m.log_lik >= kernels.ll_cells(x, s, z, 3, Priors()) - 1


def test_distributed_cells_keep_their_best(planted):
    m = fits.cluster_cells_distributed(planted[0], 3, max_iter=6)
    assert m.log_lik == max(m.history) >= m.history[0]


def test_distributed_cells_read_counts_once_and_keep_empty_cells(planted, spark, monkeypatch):
    from countloom.plans import blocks

    e, _, z, _ = planted
    by_joins = fits.cluster_cells_by_joins(e, 3)
    monkeypatch.setattr(blocks, "PIECE", 16)
    monkeypatch.setattr(blocks, "TASK", 300)
    read = spark.sparkContext.accumulator(0)
    seen = F.udf(lambda n: read.add(1) or n, "long")
    entries = e.counts.count()
    counts = e.counts.select("feature_id", "cell_id", seen("n").alias("n"))
    m = fits.cluster_cells_distributed(replace(e, counts=counts), 3)
    assert read.value <= entries and len(m.history) > 3
    assert m.history == pytest.approx(by_joins.history)
    assert {r.cell_id: r.z for r in m.z.collect()} == {r.cell_id: r.z for r in by_joins.z.collect()}
    more = e.cells.unionByName(spark.createDataFrame([(100, None)], "cell_id long, sample string"))
    stray = e.counts.unionByName(spark.createDataFrame([(1, 200, 5), (99, 3, 5)], "feature_id long, cell_id long, n long"))
    got = fits.cluster_cells_distributed(replace(e, cells=more, counts=stray), 3).z.collect()
    assert {r.cell_id for r in got} == {*range(60), 100} and {r.z for r in got} <= {1, 2, 3}


def test_parallel_gibbs_improves(planted):
    m = fits.cluster_cells_distributed(planted[0], 3, max_iter=4, algorithm="Gibbs")
    assert m.log_lik == max(m.history) > m.history[0]


def test_subset_of_items(planted):
    from countloom.operators.filters import subset_items

    e = subset_items(planted[0], [1, 2], [3, 4, 5])
    assert e.features.count() == 2 and e.cells.count() == 3 and e.counts.where("feature_id > 2 OR cell_id > 5").isEmpty()


def test_features(planted):
    e, _, _, y = planted
    m = fits.cluster_features(e, 4, chains=2, init="random", max_iter=10)
    assert agreement([r.y for r in m.y.orderBy("feature_id").collect()], y) > 0.8


def test_both(planted):
    e, _, z, y = planted
    m = fits.cluster_both(e, 3, 4, chains=2, init="split", max_iter=10)
    assert agreement([r.z for r in m.z.orderBy("cell_id").collect()], z) > 0.9
    assert m.log_lik == max(m.history)


def test_search(planted):
    e = planted[0]
    got = fits.grid_search(e, "c", {"K": [2, 3]}, chains=2)
    assert sorted(r.K for r in got.collect()) == [2, 3]
    with pytest.raises(ValueError):
        fits.grid_search(e, "c", {"L": [2]})
    with pytest.raises(ValueError):
        fits.grid_search(e, "c", {"K": [2]}, fixed={"zInit": [1]})


def test_recursive_splits_grow_by_one(planted):
    rows = fits.recursive_split(planted[0], "z", 2, 4).orderBy("index").collect()
    assert [r.K for r in rows] == [2, 3, 4] and [len(set(r.z)) for r in rows] == [2, 3, 4]


def test_module_split(planted):
    e = planted[0]
    e = replace(e, features=e.features.withColumn("y", (F.col("feature_id") % 4 + 1).cast("int")))
    out = fits.split_module(e, 2, 2)
    assert out.params["L"] == 5 and {r.y for r in out.features.collect()} <= {1, 2, 3, 4, 5}
    with pytest.raises(ValueError):
        fits.split_module(e, 2, 99)


def test_decontamination_finds_the_ambient_share(spark):
    x, _, _ = simulate.simulate_contamination(spark, cells=60, genes=60, delta=(2, 8))
    x = replace(x, cells=x.cells.withColumnRenamed("contamination", "truth"))
    d = fits.remove_ambient(x, max_iter=20)
    rows = d.cells.select("contamination", "truth").toPandas()
    assert np.corrcoef(rows.contamination, rows.truth)[0, 1] > 0.8
    assert d.log_lik[-1] > d.log_lik[0]
    with pytest.raises(ValueError):
        fits.remove_ambient(x, delta=(-1, 2))


def test_decontamination_is_the_same_in_one_task_in_blocks_and_by_joins(spark, monkeypatch):
    from countloom.plans import ambient, blocks

    x, _, _ = simulate.simulate_contamination(spark, cells=40, genes=40, delta=(2, 8))
    x = replace(x, cells=x.cells.drop("contamination"), counts=x.counts.withColumn("n", F.col("n") + 0.5))
    steps = []
    monkeypatch.setattr(contamination, "shares", lambda *a, own=contamination.shares: steps.append(1) or own(*a))
    every = [fits.remove_ambient(x, max_iter=3, every=1)]
    monkeypatch.setattr(ambient, "LIMIT", 10)
    monkeypatch.setattr(blocks, "TASK", 500)
    every.append(fits.remove_ambient(x, max_iter=3, every=1))
    assert not steps  # no joins in a step
    monkeypatch.setattr(fits, "STATE", 10)
    every.append(fits.remove_ambient(x, max_iter=3, every=1))
    assert len(steps) == 3
    want = [(r.theta, r.contamination) for r in every[2].cells.orderBy("cell_id").collect()]
    left = [r.n for r in every[2].counts.orderBy("feature_id", "cell_id").collect()]
    for d in every[:2]:
        assert d.log_lik == pytest.approx(every[2].log_lik, rel=1e-9) and d.delta == pytest.approx(every[2].delta, rel=1e-6)
        assert np.allclose([(r.theta, r.contamination) for r in d.cells.orderBy("cell_id").collect()], want, atol=1e-8)
        assert np.allclose([r.n for r in d.counts.orderBy("feature_id", "cell_id").collect()], left, atol=1e-6)


def test_batches(spark):
    x, _, _ = simulate.simulate_contamination(spark, cells=40, genes=40)
    x = replace(x, cells=x.cells.drop("contamination").withColumn("batch", F.col("cell_id") % 2))
    d = fits.remove_ambient_batches(x, "batch", max_iter=2)
    assert d.cells.count() == 40 and {r.z.split("-")[0] for r in d.cells.collect()} == {"0", "1"}


def test_background_of_batches(spark):
    x, _, _ = simulate.simulate_contamination(spark, cells=40, genes=40)
    x = replace(x, cells=x.cells.drop("contamination").withColumn("batch", F.col("cell_id") % 2))
    empty = x.counts.join(x.cells.select("cell_id", "batch"), "cell_id")
    empty = empty.where("cell_id < 12").withColumn("cell_id", F.col("cell_id") + F.when(F.col("cell_id") < 10, 1000).otherwise(0))
    with pytest.raises(ValueError):
        fits.remove_ambient_batches(x, "batch", background=empty, max_iter=1)
    d = fits.remove_ambient_batches(x, "batch", background=empty, background_batch="batch", max_iter=1)
    assert d.cells.count() == 40 and d.counts.where("n < 0").isEmpty()


def test_modules_are_divided_on_parts_of_clusters(planted):
    _, x, z, _ = planted
    i, j = np.nonzero(x)
    sums = kernels.subclusters(kernels.Sparse(i, j, x[i, j], x.shape), z, Priors(), np.random.default_rng(1), most=5)
    assert 6 < sums.shape[1] <= 15 and (sums.sum(axis=1) == x.sum(axis=1)).all()


def test_leaf_order_and_smoothing():
    d = np.array([[0, 9, 1], [9, 0, 8], [1, 8, 0.0]])
    order = kernels.complete_order(d).tolist()
    assert sorted(order) == [0, 1, 2] and abs(order.index(0) - order.index(2)) == 1
    for method in ("single", "average", "mcquitty", "ward.D", "ward.D2", "centroid", "median"):
        assert sorted(kernels.complete_order(d, method).tolist()) == [0, 1, 2]
    with pytest.raises(ValueError):
        kernels.complete_order(d, "nearest")
    points = np.array([0.0, 0.1, 5.0, 5.1, 9.0])
    assert kernels.gaps(abs(points[:, None] - points), 3) in ([2, 4], [1, 3], [2, 3])
    v = np.linspace(0, 1, 12)
    assert np.allclose(kernels.smooth(v), v, atol=1e-6)


def test_registered_fits_see_every_item(spark):
    import countloom.queries as q

    sf = "/root/testdata/sf0.001"
    x = q.x_of(spark, sf)
    cells, features = x.cells.count(), x.features.count()
    known = q.queries()
    assert known["cluster_cells_fit"](spark, sf).count() == cells and known["cluster_features_fit"](spark, sf).count() == features
    assert known["cluster_both_fit"](spark, sf).count() == cells + features
    assert {len(r.z) for r in known["recursive_split_cells"](spark, sf).collect()} == {cells}


def test_sparse_kernels_equal_dense_ones(planted):
    _, x, z, _ = planted
    s, (i, j) = np.arange(60) % 2, np.nonzero(x)
    sparse = kernels.Sparse(i, j, x[i, j], x.shape)
    for algorithm in ("EM", "Gibbs"):
        a, b = (kernels.fit_both(m, s, 3, 4, Priors(), np.random.default_rng(1), algorithm, max_iter=11) for m in (x, sparse))
        assert (a.z == b.z).all() and (a.y == b.y).all() and a.log_lik == pytest.approx(b.log_lik)


def test_a_wide_matrix_is_fitted_whole(spark):
    n = 20_000  # 400 million positions
    counts = spark.range(n).select(F.col("id").alias("feature_id"), F.explode(F.array("id", (F.col("id") + 2) % n)).alias("cell_id"), F.lit(3).cast("long").alias("n"))
    x = matrix.Experiment(counts, spark.range(n).select(F.col("id").alias("cell_id"), F.lit("s").alias("sample")), spark.range(n).select(F.col("id").alias("feature_id")), {})
    m = fits.matrix_of(x)
    assert m.x.shape == (n, n) and m.x.values.sum() == 6 * n


def test_components_have_every_cell(planted):
    e, x, _, _ = planted
    got = fits.components(e, 1, features=1)
    assert got.count() == 60 and (x > 0).all(axis=1).sum() < 40


def test_components_are_those_of_the_covariance_and_need_no_dense_rows(planted):
    from pyspark.ml.functions import vector_to_array

    e, x, _, _ = planted
    got = fits.components(e, 3, features=25)
    assert "Python" not in (plan := got._jdf.queryExecution().toString()) and "Arrow" not in plan  # what reads a part stops no worker
    values = np.log2(x / (x.sum(axis=0) / x.sum(axis=0).mean()) + 1)
    spread = (values**2).sum(axis=1) - values.sum(axis=1) ** 2 / x.shape[1]
    top = values[np.sort(np.argsort(-spread, kind="stable")[:25])]
    vectors = np.linalg.eigh(np.cov(top))[1][:, ::-1][:, :3]
    want = np.abs(top.T @ vectors)
    rows = got.select(vector_to_array("pc").alias("pc")).orderBy("cell_id").collect()
    assert np.allclose(np.abs(np.array([r.pc for r in rows])), want)


def test_starts_for_unlabelled_cells(planted):
    e = planted[0]
    got = fits.initial_clusters(e, features=25).toPandas()
    assert len(got) == 60 and set(got.z) == {1, 2}


def test_registered_fits_are_not_cut_short(monkeypatch):
    import countloom.queries as q

    class Stop(Exception):
        pass

    def seen(*args, **how):
        raise Stop(args[1:], how)

    monkeypatch.setattr(q, "x_of", lambda spark, d: None)
    for name, function, own in (("cluster_cells_fit", "cluster_cells", (4,)), ("cluster_cells_distributed", "cluster_cells_distributed", (q.K,)), ("cluster_features_fit", "cluster_features", (4,)), ("cluster_both_fit", "cluster_both", (3, 4)), ("ambient_fit", "remove_ambient", ()), ("components", "components", (2,)), ("initial_clusters", "initial_clusters", ())):
        monkeypatch.setattr(fits, function, seen)
        with pytest.raises(Stop) as stop:
            q.queries()[name](None, "")
        assert stop.value.args == (own, {})


def test_large_fits_keep_chains_and_algorithm(planted, monkeypatch):
    e, cells, both = planted[0], [], []
    monkeypatch.setattr(fits, "LIMIT", 10)
    monkeypatch.setattr(fits, "STATE", 10)
    real = fits.modules_distributed
    monkeypatch.setattr(fits, "cluster_cells_distributed", lambda x, k, p, seed, n, algorithm: cells.append((seed, algorithm)) or fits.Model("c", {}, -seed, []))
    monkeypatch.setattr(fits, "modules_distributed", lambda x, k, l, p, seed, n=200, algorithm="EM": both.append((seed, algorithm)) or fits.Model("cg", {}, -seed, []))
    assert fits.cluster_cells(e, 3, algorithm="Gibbs", seed=5).log_lik == -5 and cells == [(5, "Gibbs"), (6, "Gibbs"), (7, "Gibbs")]
    assert fits.cluster_both(e, 3, 4, algorithm="Gibbs", seed=5, chains=2).log_lik == -5 and both == [(5, "Gibbs"), (6, "Gibbs")]
    m = real(e, 3, 4, max_iter=2, algorithm="Gibbs")
    assert m.log_lik == max(m.history) > m.history[0] and m.z.count() == 60 and m.y.count() == 40
    m = real(e, 0, 4, max_iter=2)
    assert m.log_lik == max(m.history) > m.history[0] and m.z is None and m.y.count() == 40


def test_blocks_find_what_was_planted(planted, monkeypatch):
    from countloom.plans import blocks

    e, x, z, y = planted
    monkeypatch.setattr(fits, "LIMIT", 10)
    monkeypatch.setattr(blocks, "TASK", 500)
    m = fits.matrix_of(e)
    assert m.in_blocks and (m.x.sum(axis=0) == x.sum(axis=0)).all() and (m.x.sum(axis=1) == x.sum(axis=1)).all()
    i, j = np.nonzero(x)
    sparse, local, s, p = kernels.Sparse(i, j, x[i, j], x.shape), blocks.Local(x), np.arange(60) % 2, Priors()
    for own in (m.x, local):
        assert (kernels.group_sums(own, z, 3) == kernels.group_sums(sparse, z, 3)).all()
        assert np.allclose(kernels.cell_scores(own, s, z, 3, p), kernels.cell_scores(sparse, s, z, 3, p))
        assert np.allclose(kernels.cell_conditionals(own, s, z.copy(), 3, p), kernels.cell_conditionals(sparse, s, z.copy(), 3, p))
        assert np.allclose(kernels.feature_conditionals(own, y.copy(), 4, p), kernels.feature_conditionals(sparse, y.copy(), 4, p))
        assert np.allclose(kernels.lls_cells(own, s, [z, z[::-1].copy()], 3, p), kernels.lls_cells(sparse, s, [z, z[::-1].copy()], 3, p))
        assert np.allclose(kernels.lls_features(own, [y, y[::-1].copy()], 4, p), kernels.lls_features(sparse, [y, y[::-1].copy()], 4, p))
    cells = fits.cluster_cells(e, 3, chains=1)
    assert agreement([r.z for r in cells.z.orderBy("cell_id").collect()], z) > 0.95
    features = fits.cluster_features(e, 4, chains=2, max_iter=12)
    assert agreement([r.y for r in features.y.orderBy("feature_id").collect()], y) > 0.8
    both = fits.cluster_both(e, 3, 4, chains=1, max_iter=12)
    assert agreement([r.z for r in both.z.orderBy("cell_id").collect()], z) > 0.9 and both.log_lik == max(both.history)


def test_runs_over_blocks_go_side_by_side_and_bring_the_same(planted, monkeypatch):
    import threading

    e, spark, seen = planted[0], planted[0].counts.sparkSession, set()
    monkeypatch.setattr(fits, "LIMIT", 10)
    m, own = fits.matrix_of(e), fits.fitted
    monkeypatch.setattr(fits, "fitted", lambda *a, **how: seen.add(threading.get_ident()) or own(*a, **how))
    runs = fits.grid({"L": [3]}, 3, 5)
    got = [(r.log_lik, r.y) for r in fits.run_all(spark, m, "g", runs, Priors(), max_iter=3).collect()]
    assert len(seen) == 3
    alone = [own(m, "g", r, Priors(), max_iter=3) for r in runs]
    assert got == [(r["log_lik"], r["y"].tolist()) for r in alone]


def test_searches_in_blocks(planted, monkeypatch):
    e, x, _, _ = planted
    want = {r.K: r.mean_perplexity for r in fits.grid_search(e, "c", {"K": [2, 3]}, chains=2).collect()}
    monkeypatch.setattr(fits, "LIMIT", 10)
    got = {r.K: r.mean_perplexity for r in fits.grid_search(e, "c", {"K": [2, 3]}, chains=2).collect()}
    assert set(got) == {2, 3} and got[3] == pytest.approx(want[3], rel=0.05)
    for axis, n in (("z", 60), ("y", 40)):
        rows = fits.recursive_split(e, axis, 2, 4).orderBy("index").collect()
        assert [len(set(r[axis])) for r in rows] == [2, 3, 4] and {len(r[axis]) for r in rows} == {n}
    m = fits.matrix_of(e)
    spark = e.counts.sparkSession
    points = fits.resampled_perplexity(spark, m, "c", fits.run_all(spark, m, "c", fits.grid({"K": [2]}, 1, 5), Priors()), resamples=2).collect()
    monkeypatch.setattr(fits, "LIMIT", 10_000)
    m = fits.matrix_of(e)
    same = fits.resampled_perplexity(spark, m, "c", fits.run_all(spark, m, "c", fits.grid({"K": [2]}, 1, 5), Priors()), resamples=2).collect()
    assert [r.perplexity for r in points] == pytest.approx([r.perplexity for r in same])


def test_tasks_that_hold_a_matrix_fit_it_in_one_job_as_blocks_do(planted, monkeypatch):
    from countloom.plans import blocks, ranks

    e, got = planted[0], []
    spark = e.counts.sparkSession
    monkeypatch.setattr(fits, "LIMIT", 10)
    side, each = fits._side_by_side, blocks.Blocks._each
    for held in (1 << 20, 0):
        monkeypatch.setattr(ranks, "HELD", held)
        jobs = []
        monkeypatch.setattr(fits, "_side_by_side", lambda *a: jobs.append(1) or side(*a))
        monkeypatch.setattr(blocks.Blocks, "_each", lambda self, *a: jobs.append(1) or each(self, *a))
        c = fits.cluster_cells(e, 3, chains=2, max_iter=4)
        g = fits.cluster_features(e, 4, chains=1, max_iter=3)
        cg = fits.cluster_both(e, 3, 4, chains=1, max_iter=3)
        rows = fits.grid_search(e, "c", {"K": [2, 3]}, chains=2, max_iter=4).orderBy("K").collect()
        assert bool(jobs) == (held == 0)  # no Spark jobs for a step
        got.append([c.history, g.history, cg.history, [(r.K, r.chain, r.log_lik, r.z, r.mean_perplexity) for r in rows]] + [[tuple(r) for r in d.orderBy(d.columns[0]).collect()] for d in (c.z, g.y, cg.z, cg.y)])
        m = fits.matrix_of(e, labels=2)
        got[-1].append([r.perplexity for r in fits.resampled_perplexity(spark, m, "c", fits.run_all(spark, m, "c", fits.grid({"K": [2]}, 1, 5), Priors(), max_iter=3), resamples=2).collect()])
    assert got[0] == got[1]


def test_decontamination_by_tasks_that_hold_the_counts_is_that_of_blocks(spark, monkeypatch):
    from countloom.plans import ambient, blocks, ranks

    x, _, _ = simulate.simulate_contamination(spark, cells=40, genes=40, delta=(2, 8))
    x = replace(x, cells=x.cells.drop("contamination"), counts=x.counts.withColumn("n", F.col("n") + 0.5))
    monkeypatch.setattr(ambient, "LIMIT", 10)
    got, jobs, each = [], [], blocks.Blocks._each
    monkeypatch.setattr(blocks.Blocks, "_each", lambda self, *a: jobs.append(1) or each(self, *a))
    for held in (1 << 20, 0):
        monkeypatch.setattr(ranks, "HELD", held)
        d = fits.remove_ambient(x, max_iter=3, every=1)
        assert bool(jobs) == (held == 0)
        got.append((d.log_lik, d.delta, [(r.theta, r.contamination) for r in d.cells.orderBy("cell_id").collect()]))
    assert np.allclose(got[0][0], got[1][0]) and np.allclose(got[0][1], got[1][1]) and np.allclose(got[0][2], got[1][2])
