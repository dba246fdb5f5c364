"""Draws, embeddings, reports, streams."""

from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from countloom.operators import likelihood, rank
from countloom.plans import embed, plots, report
from countloom.sources import matrix, simulate
from countloom.streaming import counts as streams


@pytest.fixture(scope="module")
def x(spark):
    e = simulate.simulate_cells(spark, "cg", samples=2, cells=(20, 25), genes=40, k=3, modules=4, seed=3)
    return matrix.Experiment(e.counts.cache(), e.cells.cache(), e.features.cache(), e.params)


def test_draws_follow_the_probabilities(spark):
    scores = spark.range(4000).select(F.col("id").alias("cell_id"), F.explode(F.array(*[F.struct(F.lit(z).alias("z"), F.lit(float(np.log(p))).alias("score")) for z, p in ((1, 0.2), (2, 0.5), (3, 0.3))])).alias("s")).select("cell_id", "s.*")
    drawn = rank.drawn_label(scores, "cell_id")
    share = {r.z: r["count"] / 4000 for r in drawn.groupBy("z").count().collect()}
    assert abs(share[1] - 0.2) < 0.04 and abs(share[2] - 0.5) < 0.04
    assert sorted(map(tuple, drawn.collect())) == sorted(map(tuple, rank.drawn_label(scores.repartition(3), "cell_id").collect()))


def test_joint_conditionals_have_all_pairs(x):
    assert likelihood.cell_conditional_of_modules(x).count() == x.cells.count() * x.params["K"]
    assert likelihood.feature_conditional_of_clusters(x).count() == x.features.count() * x.params["L"]


@pytest.mark.parametrize("kernel", [embed.stochastic_neighbours, embed.neighbour_graph])
def test_embeddings_keep_groups_apart(kernel):
    rng = np.random.default_rng(1)
    points = np.concatenate([rng.normal(c, 0.2, (30, 5)) for c in (0, 4, 8)])
    y, g = kernel(points, rounds=300), np.repeat(np.arange(3), 30)
    d = np.sqrt(((y[:, None] - y) ** 2).sum(axis=2))
    np.fill_diagonal(d, np.inf)
    assert (g[d.argmin(axis=1)] == g).mean() > 0.95


def test_embedding_of_an_experiment(x):
    assert embed.embedding(x, "pca", min_size=1).count() == x.cells.count()
    with pytest.raises(ValueError):
        embed.embedding(x, "map", min_size=1)


def test_every_cell_gets_a_place(x):
    plain = matrix.Experiment(x.counts, x.cells.drop("z"), x.features, x.params)
    for e in (x, plain):
        got = embed.embedding(e, "graph", 5, min_size=1, layout=12, rounds=20).toPandas()
        assert sorted(got.cell_id) == sorted(r.cell_id for r in e.cells.collect()) and np.isfinite(got[["dim1", "dim2"]].to_numpy()).all()
    assert embed.embedding(plain, "pca", max_cells=7).count() == 7


class Alone:
    """One task, which has all."""

    rank, size = 0, 1

    def swap(self, each):
        return [each(0)]

    def gather(self, own):
        return [own]


def test_neighbours_lay_out_every_cell(x, monkeypatch):
    def placed(*args):
        raise AssertionError("cells are placed beside a sample")

    monkeypatch.setattr(embed, "_placed", placed)
    got = embed.embedding(x, "neighbours", 5, min_size=1, layout=12, rounds=20).toPandas()
    assert sorted(got.cell_id) == sorted(r.cell_id for r in x.cells.collect()) and np.isfinite(got[["dim1", "dim2"]].to_numpy()).all()
    again = embed.embedding(replace(x, counts=x.counts.repartition(7), cells=x.cells.repartition(3)), "neighbours", 5, min_size=1, layout=12, rounds=20).toPandas()
    both = got.merge(again, on="cell_id")
    assert len(both) == len(got) and np.allclose(both.dim1_x, both.dim1_y, atol=1e-6)


@pytest.mark.parametrize("exact", [4000, 10])
def test_whole_layout_keeps_groups_apart_and_copies_together(exact, monkeypatch):
    from countloom.plans import neighbours

    monkeypatch.setattr(neighbours, "EXACT", exact)
    rng = np.random.default_rng(1)
    points = np.concatenate([rng.normal(c, 0.2, (30, 5)) for c in (0, 4, 8)])
    points, g = np.concatenate([points, points[:40]]), np.append(np.repeat(np.arange(3), 30), np.repeat([0, 1], [30, 10]))
    known, at, many = neighbours.distinct(points)
    assert len(known) == 90 and many.sum() == 130 and (known[at] == points).all()
    y = neighbours.layout(Alone(), known, many, rounds=300)[at]
    d = np.sqrt(((y[:, None] - y) ** 2).sum(axis=2))
    np.fill_diagonal(d, np.inf)
    assert (g[d.argmin(axis=1)] == g).mean() > 0.95 and (y[90:] == y[:40]).all()


def test_weighted_affinities_and_grid_are_those_of_all_pairs(monkeypatch):
    from countloom.plans import neighbours

    rng = np.random.default_rng(2)
    points = rng.normal(size=(200, 5))
    points = np.concatenate([points, points[:50], points[:20]])
    known, at, many = neighbours.distinct(points)
    near, far = neighbours.nearest(known, np.arange(200), 199)
    p = np.zeros((200, 200))
    np.put_along_axis(p, near.astype(int), neighbours.conditionals(far, many[near], many - 1, 20), 1)
    apart = at[:, None] != at
    assert np.allclose(p[at][:, at][apart], embed._affinities(embed._squared(points), 20)[apart], atol=1e-4)
    y = rng.normal(0, 20, (1000, 2))
    many, force = rng.integers(1, 5, 1000).astype(float), []
    for exact in (4000, 10):
        monkeypatch.setattr(neighbours, "EXACT", exact)
        q, q2, *pulls = neighbours.repelled(Alone(), y, many, slice(0, 1000))
        force.append((q, *(y[:, d] * q2 - pulls[d] for d in (0, 1))))
    for a, b in zip(*force, strict=True):
        assert np.abs(a - b).max() < 0.02 * np.abs(a).max()


def test_report(spark, x, tmp_path):
    done = report.run(x, 3, 4, f"file://{tmp_path}/r", min_count=1, min_cell=1)
    tables = report.read(spark, f"file://{tmp_path}/r")
    assert set(tables) == set(report.TABLES) and tables["cells"].count() == done.cells.count()
    out = report.results(done, tables["embedding"], [1, 2])
    assert all(t.count() for t in out.values())


def test_heatmap_order(x):
    values = plots.heatmap(x)
    order = plots.heatmap_order(values, x.cells, "cell_id", "feature_id", "z").orderBy("place").collect()
    assert [r.z for r in order] == sorted(r.z for r in order) and len({r.cell_id for r in order}) == x.cells.count()
    with pytest.raises(ValueError):
        plots.heatmap_order(values, x.cells, "cell_id", "feature_id", "z", limit=3)


def test_stream_sums(spark, x, tmp_path):
    for i in range(2):
        x.counts.where(F.col("cell_id") % 2 == i).write.mode("append").parquet(f"file://{tmp_path}/in")
    stream = spark.readStream.schema(x.counts.schema).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in")
    q = streams.to_table(streams.sums_by_cluster(stream, x.cells), "sums", f"file://{tmp_path}/c1")
    q.awaitTermination(120)
    want = x.counts.join(x.cells, "cell_id").groupBy("feature_id", "z").agg(F.sum("n").alias("n"))
    assert sorted(map(tuple, spark.table("sums").collect())) == sorted(map(tuple, want.collect()))


def test_late_events_are_dropped(spark, tmp_path):
    schema = "ts timestamp, feature_id long, cell_id long"
    for i, t in enumerate(["00:01", "00:02", "03:00", "03:05", "03:06", "00:03"]):
        spark.sql(f"SELECT timestamp'2024-01-01 {t}:00' AS ts, 1L AS feature_id, 2L AS cell_id").coalesce(1).write.parquet(f"file://{tmp_path}/ev/{i}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"file://{tmp_path}/ev")
    q = streams.to_table(streams.windowed_counts(stream, "ts", "1 hour", "30 minutes"), "win", f"file://{tmp_path}/c2", "append")
    q.awaitTermination(120)
    assert [r.n for r in spark.table("win").orderBy("start").collect()][:1] == [2]


def test_scratch_tables_need_a_shared_folder():
    from types import SimpleNamespace

    from countloom.plans.tables import Tables

    none = SimpleNamespace(get=lambda *a: None)
    session = lambda master: SimpleNamespace(conf=none, sparkContext=SimpleNamespace(master=master, getConf=lambda: none, environment={}))
    with pytest.raises(ValueError, match="share"):
        Tables(session("spark://host:7077"))
    assert Tables(session("local[4]")).base.startswith("file://")


def test_rows_of_a_heatmap_by_k_means(spark):
    rows = [(f, z, float(10 * (f % 2) + z)) for f in range(12) for z in (1, 2) if not (f == 3 and z == 2)]
    values = spark.createDataFrame(rows, "feature_id long, z int, value double")
    labels, centres = plots.row_clusters(values, [1, 2], 2)
    got = {r.feature_id: r.cluster for r in labels.collect()}
    assert len({got[f] for f in range(0, 12, 2)}) == 1 and got[0] != got[1]
    assert sum(r["size"] for r in centres.where("z = 1").collect()) == 12


def test_log_goes_to_a_file(tmp_path):
    for append, want in ((False, ["one"]), (True, ["one", "two"]), (False, ["three"])):
        report.log_to(str(tmp_path / "log"), append, verbose=False)
        report.log.info(want[-1])
        assert [line.split(" .. ")[1] for line in (tmp_path / "log").read_text().splitlines()] == want
    report.log_to(None)


def test_warnings(spark):
    from countloom.operators import filters

    features = spark.createDataFrame([(1, "aa"), (2, "ab")], "feature_id long, name string")
    with pytest.warns(UserWarning, match="several"):
        filters.feature_index(["a"], features, exact=False)
    with pytest.warns(UserWarning, match="no feature"):
        filters.feature_index(["aa", "zz"], features)
    nameless = spark.createDataFrame([(1, 2)], "feature_id long, n long")
    with pytest.warns(UserWarning, match="holds no cells"):
        assert matrix.without_cells(nameless, spark.createDataFrame([(1,)], "cell_id long")).count() == 1
    runs = spark.createDataFrame([(1, 2)], "index int, K int")
    a, b = (spark.createDataFrame([(1, 1, n)], "feature_id long, cell_id long, n long") for n in (1, 2))
    with pytest.warns(UserWarning, match="different counts"):
        assert filters.append_runs(runs, runs, a, b).count() == 2
