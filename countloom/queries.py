"""One query for each operator, over the part x customer matrix, and its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from countloom.functions.special import lgamma
from countloom.operators import aggregate, contamination, distances, factorize, filters, likelihood, normalize, rank
from countloom.plans import embed, fits, plots
from countloom.sources import matrix, simulate

K, L = 5, 8
Q: dict = {}
SQL: dict[str, str] = {}

PRELUDE = f"""
mx AS (SELECT l_partkey AS feature_id, o_custkey AS cell_id, CAST(SUM(l_quantity) AS BIGINT) AS n
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2),
cells AS (SELECT c_custkey AS cell_id, c_name AS name, c_mktsegment AS sample, CAST(c_custkey % {K} + 1 AS INTEGER) AS z
  FROM customer WHERE c_custkey IN (SELECT cell_id FROM mx)),
features AS (SELECT p_partkey AS feature_id, p_name AS name, CAST(p_partkey % {L} + 1 AS INTEGER) AS y
  FROM part WHERE p_partkey IN (SELECT feature_id FROM mx)),
ks AS (SELECT CAST(unnest(range(1, {K + 1})) AS INTEGER) AS z), ls AS (SELECT CAST(unnest(range(1, {L + 1})) AS INTEGER) AS y),
samples AS (SELECT DISTINCT sample FROM cells),
gz AS (SELECT feature_id, z, CAST(SUM(n) AS BIGINT) AS n FROM mx JOIN cells USING (cell_id) GROUP BY 1, 2),
yc AS (SELECT y, cell_id, CAST(SUM(n) AS BIGINT) AS n FROM mx JOIN features USING (feature_id) GROUP BY 1, 2),
yz AS (SELECT y, z, CAST(SUM(n) AS BIGINT) AS n FROM yc JOIN cells USING (cell_id) GROUP BY 1, 2),
zs AS (SELECT z, sample, (SELECT COUNT(*) FROM cells c WHERE c.z = ks.z AND c.sample = samples.sample) AS cells FROM ks, samples),
nc AS (SELECT cell_id, CAST(SUM(n) AS BIGINT) AS n FROM mx GROUP BY 1),
ng AS (SELECT feature_id, CAST(SUM(n) AS BIGINT) AS n FROM mx GROUP BY 1),
sizes AS (SELECT y, (SELECT COUNT(*) FROM features f WHERE f.y = ls.y) + 1 AS genes FROM ls)
"""
# posterior means, for what builds on them
POSTERIOR = f"""
theta AS (SELECT z, sample, (cells + 1) / SUM(cells + 1) OVER (PARTITION BY sample) AS p FROM zs),
gzf AS (SELECT f.feature_id, ks.z, COALESCE(gz.n, 0) AS n FROM features f CROSS JOIN ks LEFT JOIN gz ON gz.feature_id = f.feature_id AND gz.z = ks.z),
phi AS (SELECT feature_id, z, (n + 1) / SUM(n + 1) OVER (PARTITION BY z) AS p FROM gzf),
yzf AS (SELECT ls.y, ks.z, COALESCE(yz.n, 0) AS n FROM ls CROSS JOIN ks LEFT JOIN yz ON yz.y = ls.y AND yz.z = ks.z),
pop AS (SELECT y, z, (n + 1) / SUM(n + 1) OVER (PARTITION BY z) AS p FROM yzf),
ycf AS (SELECT ls.y, c.cell_id, COALESCE(yc.n, 0) AS n FROM ls CROSS JOIN cells c LEFT JOIN yc ON yc.y = ls.y AND yc.cell_id = c.cell_id),
cellp AS (SELECT y, cell_id, (n + 1) / SUM(n + 1) OVER (PARTITION BY cell_id) AS p FROM ycf),
psi AS (SELECT feature_id, y, (n + 1) / SUM(n + 1) OVER (PARTITION BY y) AS p FROM ng JOIN features USING (feature_id)),
score_c AS (SELECT s.cell_id, s.z, s.v + ln(t.p) AS score FROM (SELECT cell_id, z, SUM(n * ln(p)) AS v FROM mx JOIN phi USING (feature_id) GROUP BY 1, 2) s
  JOIN cells c USING (cell_id) JOIN theta t ON t.z = s.z AND t.sample = c.sample)
"""


def x_of(spark: SparkSession, d: str) -> matrix.Experiment:
    return matrix.orders_experiment(spark, d, K, L)


def query(name: str, sql: str | None = None, prelude: str = PRELUDE):
    """Register f(x) -> DataFrame over the matrix, with its SQL."""

    def put(f):
        Q[name] = lambda spark, d: f(x_of(spark, d))
        if sql is not None:
            SQL[name] = f"WITH {prelude} {sql}"
        return f

    return put


BOTH = PRELUDE + "," + POSTERIOR
r = F.round

# 2.1 to 2.3: sources, filters, lookups


@query("select_features", "SELECT feature_id FROM mx GROUP BY 1 HAVING COUNT(*) FILTER (WHERE n >= 3) >= 3")
def _(x):
    return filters.frequent_features(x.counts, x.features, x.cells).select("feature_id")


@query("matrix_checksum", "SELECT COUNT(*) AS entries, CAST(SUM(n) AS BIGINT) AS total FROM mx")
def _(x):
    return matrix.checksum(matrix.check_counts(x.counts)).drop("hash")


Q["empty_axes"] = lambda spark, d: filters.empty_axes(x_of(spark, d).counts, matrix.read(spark, d, "part").select(F.col("p_partkey").alias("feature_id")), matrix.read(spark, d, "customer").select(F.col("c_custkey").alias("cell_id")))
SQL["empty_axes"] = f"WITH {PRELUDE} " + "SELECT 'feature' AS axis, p_partkey AS id FROM part WHERE p_partkey NOT IN (SELECT feature_id FROM mx) UNION ALL SELECT 'cell', c_custkey FROM customer WHERE c_custkey NOT IN (SELECT cell_id FROM mx)"

Q["wide_to_coo"] = lambda spark, d: matrix.from_wide(matrix.read(spark, d, "embeddings"), "embedding", "vec_id", "dim").select("vec_id", "dim", F.col("n").cast("double").alias("n"))
SQL["wide_to_coo"] = "SELECT vec_id, CAST(i AS BIGINT) AS dim, CAST(embedding[i] AS DOUBLE) AS n FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings) WHERE embedding[i] <> 0"

Q["text_counts"] = lambda spark, d: matrix.text_experiment(spark, d).counts.groupBy("cell_id").agg(F.count("*").alias("words"), F.sum("n").alias("tokens"))
SQL["text_counts"] = "SELECT cell_id, COUNT(*) AS words, CAST(SUM(n) AS BIGINT) AS tokens FROM (SELECT doc_id AS cell_id, word, COUNT(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '\\w+')) AS word FROM documents) GROUP BY 1, 2) GROUP BY 1"


@query("transpose", "SELECT cell_id AS feature_id, feature_id AS cell_id, n FROM mx")
def _(x):
    return matrix.transposed(x.counts)


@query("background_antijoin", "SELECT feature_id, cell_id, n FROM mx WHERE cell_id NOT IN (SELECT cell_id FROM cells WHERE z <> 1)")
def _(x):
    return matrix.without_cells(x.counts, x.cells.where("z <> 1"))


@query("feature_lookup_exact", "SELECT q AS query, MIN(feature_id) AS feature_id, MIN(feature_id) % 8 + 1 AS y FROM (SELECT DISTINCT name AS q FROM features WHERE feature_id IN (3, 5, 8)) JOIN features ON name = q GROUP BY 1")
def _(x):
    names = sorted({row.name for row in x.features.where("feature_id IN (3, 5, 8)").select("name").collect()})
    return filters.module_of(names, x.features).select("query", "feature_id", F.col("y").cast("long").alias("y"))


@query("feature_lookup_regex", "SELECT q AS query, COALESCE((SELECT MIN(feature_id) FROM features WHERE regexp_matches(name, q)), -1) AS feature_id FROM (SELECT unnest(['^red', 'bolt$', 'nothing like this']) AS q)")
def _(x):
    return filters.feature_index(["^red", "bolt$", "nothing like this"], x.features, exact=False).na.fill(-1)


@query("recode", "SELECT cell_id, CASE z WHEN 1 THEN 2 WHEN 2 THEN 1 ELSE z END AS z FROM cells")
def _(x):
    return filters.recoded(x.cells, "z", [1, 2], [2, 1]).select("cell_id", "z")


@query("relabel", "SELECT cell_id, sample AS label, CAST(DENSE_RANK() OVER (ORDER BY f) AS INTEGER) AS z FROM (SELECT cell_id, sample, MIN(cell_id) OVER (PARTITION BY sample) AS f FROM cells)")
def _(x):
    return filters.relabelled(x.cells.select("cell_id", F.col("sample").alias("label"))).select("cell_id", "label", "z")


# 2.2: normalisation


def _norm(name: str, sql: str, **how) -> None:
    @query(name, f"SELECT feature_id, cell_id, round({sql}, 6) AS value FROM (SELECT *, SUM(n) OVER (PARTITION BY cell_id) AS t FROM mx)")
    def _(x):
        return normalize.normalized(x.counts, **how).withColumn("value", r("value", 6))


_norm("norm_proportion", "n / t")
_norm("norm_cpm", "n / (t / 1e6)", how="cpm")
_norm("norm_median", "n / (t / (SELECT median(CAST(n AS DOUBLE)) FROM nc))", how="median")
_norm("norm_mean", "n / (t / (SELECT AVG(n) FROM nc))", how="mean")
_norm("norm_scaled_log", "log2(n / t * 10000 + 1)", scale_factor=10000, transformation="log2", pseudo_transform=1)
_norm("norm_sqrt", "sqrt(n / t)", transformation="sqrt")
_norm("norm_log", "ln(n / t)", transformation="log")
_norm("norm_pseudocount", "(n + 1) / (t + 100.0)", features=100, pseudo_normalize=1)
ZSQL = "SELECT feature_id, cell_id, round({}, 7) AS value FROM (SELECT feature_id, cell_id, v, SUM(v) OVER w AS s, SUM(v * v) OVER w AS q, (SELECT COUNT(*) FROM cells) AS m FROM (SELECT feature_id, cell_id, sqrt(n / SUM(n) OVER (PARTITION BY cell_id)) AS v FROM mx) WINDOW w AS (PARTITION BY feature_id))"
ZVALUE = "(v - s / m) / sqrt((q - s * s / m) / (m - 1))"


@query("norm_zscore", ZSQL.format(ZVALUE))
def _(x):
    z = normalize.z_scored(normalize.normalized(x.counts, transformation="sqrt"), "feature_id", x.cells.count())
    return z.select("feature_id", "cell_id", r("value", 7).alias("value"))


@query("norm_scaled_columns", "SELECT feature_id, cell_id, round((value - s / g) / sqrt((q - s * s / g) / (g - 1)), 7) AS value FROM (SELECT feature_id, cell_id, sqrt(n) AS value, SUM(sqrt(n)) OVER (PARTITION BY cell_id) AS s, SUM(n) OVER (PARTITION BY cell_id)::DOUBLE AS q, (SELECT COUNT(*) FROM features)::DOUBLE AS g FROM mx)")
def _(x):
    roots = x.counts.select("feature_id", "cell_id", F.sqrt("n").alias("value"))
    return normalize.scaled(roots, "column", x.features.count(), x.cells.count()).select("feature_id", "cell_id", r("value", 7).alias("value"))


@query("log_normalized", "SELECT feature_id, cell_id, round(log2(n / (t / (SELECT AVG(n) FROM nc)) + 1), 9) AS value FROM (SELECT *, SUM(n) OVER (PARTITION BY cell_id) AS t FROM mx)")
def _(x):
    return normalize.log_normalized(x.counts).withColumn("value", r("value", 9))


@query("clip", ZSQL.format(f"least(greatest({ZVALUE}, -2), 2)"))
def _(x):
    z = normalize.z_scored(normalize.normalized(x.counts, transformation="sqrt"), "feature_id", x.cells.count())
    return normalize.trimmed(z).select("feature_id", "cell_id", r("value", 7).alias("value"))


@query("min_max", "SELECT y, cell_id, round((n - lo) / (hi - lo), 9) AS value FROM (SELECT *, MIN(n) OVER (PARTITION BY y) AS lo, MAX(n) OVER (PARTITION BY y) AS hi FROM yc)")
def _(x):
    rows = aggregate.by_module(x.counts, x.features).withColumnRenamed("n", "value")
    return normalize.min_max(rows, "y").select("y", "cell_id", r("value", 9).alias("value"))


@query("softmax", "SELECT cell_id, z, round(e / SUM(e) OVER (PARTITION BY cell_id), 6) AS probability FROM (SELECT *, exp(score - MAX(score) OVER (PARTITION BY cell_id)) AS e FROM score_c)", BOTH)
def _(x):
    return normalize.softmax(likelihood.cell_scores(x, "c"), "cell_id").select("cell_id", "z", r("probability", 6).alias("probability"))


@query("log_sum_exp", "SELECT cell_id, round(m + ln(SUM(exp(score - m))), 5) AS value FROM (SELECT *, MAX(score) OVER (PARTITION BY cell_id) AS m FROM score_c) GROUP BY cell_id, m", BOTH)
def _(x):
    return normalize.log_sum_exp(likelihood.cell_scores(x, "c"), "cell_id").select("cell_id", r("value", 5).alias("value"))


@query("lgamma", "SELECT feature_id, cell_id, round(lgamma(n + 0.3), 8) AS value FROM mx")
def _(x):
    return x.counts.select("feature_id", "cell_id", r(lgamma(F.col("n") + 0.3), 8).alias("value"))


# 2.4, 2.5: sums


@query("cell_totals", "SELECT * FROM nc")
def _(x):
    return aggregate.totals(x.counts, "cell_id")


@query("feature_totals", "SELECT * FROM ng")
def _(x):
    return aggregate.totals(x.counts, "feature_id")


@query("sum_by_cluster", "SELECT * FROM gz")
def _(x):
    return aggregate.by_cluster(x.counts, x.cells)


@query("sum_by_module", "SELECT * FROM yc")
def _(x):
    return aggregate.by_module(x.counts, x.features)


@query("sum_by_both", "SELECT * FROM yz")
def _(x):
    return aggregate.by_both(x.counts, x.cells, x.features)


@query("sum_change_cells", f"SELECT feature_id, CASE WHEN cell_id % 7 = 0 THEN CAST((cell_id + 1) % {K} + 1 AS INTEGER) ELSE z END AS z, CAST(SUM(n) AS BIGINT) AS n FROM mx JOIN cells USING (cell_id) GROUP BY 1, 2")
def _(x):
    moves = x.cells.where("cell_id % 7 = 0").select("cell_id", F.col("z").alias("old"), ((F.col("cell_id") + 1) % K + 1).cast("int").alias("new"))
    return aggregate.changed(aggregate.by_cluster(x.counts, x.cells), x.counts, moves, "cell_id", "z")


@query("sum_change_features", f"SELECT cell_id, CASE WHEN feature_id % 7 = 0 THEN CAST((feature_id + 1) % {L} + 1 AS INTEGER) ELSE y END AS y, CAST(SUM(n) AS BIGINT) AS n FROM mx JOIN features USING (feature_id) GROUP BY 1, 2")
def _(x):
    moves = x.features.where("feature_id % 7 = 0").select("feature_id", F.col("y").alias("old"), ((F.col("feature_id") + 1) % L + 1).cast("int").alias("new"))
    return aggregate.changed(aggregate.by_module(x.counts, x.features), x.counts, moves, "feature_id", "y")


@query("cluster_by_sample", "SELECT z, sample, cells FROM zs")
def _(x):
    return aggregate.cluster_by_sample(x.cells, K)


@query("tabulate_modules", "SELECT y, genes - 1 AS items FROM sizes")
def _(x):
    return aggregate.tabulate(x.features, "y", L)


def _view_sql(model: str, kind: str) -> str:
    share = {"counts": "n", "proportion": "n / SUM(n) OVER (PARTITION BY {})", "posterior": "(n + 1) / SUM(n + 1) OVER (PARTITION BY {})"}[kind]
    one = lambda part, row, column, table, by: f"SELECT '{part}' AS part, CAST({row} AS VARCHAR) AS row, CAST({column} AS VARCHAR) AS column, round(CAST({share.format(by)} AS DOUBLE), 9) AS value FROM {table}"
    full = kind == "posterior"
    sample = one("sample", "z", "sample", "(SELECT z, sample, cells AS n FROM zs)", "sample")
    module = one("module", "feature_id", "y", "(SELECT * FROM ng JOIN features USING (feature_id))", "y")
    gene = one("geneDistribution", "y", "'all'", "(SELECT y, genes AS n FROM sizes)", "1")
    by_cell = one("cell", "y", "cell_id", "ycf" if full else "yc", "cell_id")
    pop = one("cellPopulation", "y", "z", "yzf" if full else "yz", "z")
    by_cluster = one("module", "feature_id", "z", "gzf" if full else "gz", "z")
    parts = {"c": [sample, by_cluster], "g": [by_cell, module, gene], "cg": [sample, pop, *([] if full else [by_cell]), module, gene]}[model]
    return " UNION ALL ".join(parts)


for _model in ("c", "g", "cg"):
    for _kind in ("counts", "proportion", "posterior"):

        @query(f"factorize_{_model}_{_kind}", _view_sql(_model, _kind), BOTH)
        def _(x, model=_model, kind=_kind):
            return factorize.factorized(x, model, kind).withColumn("value", r("value", 9))


THETA = f"(SELECT COUNT(*) FROM samples) * lgamma({K}.0) + (SELECT SUM(lgamma(cells + 1.0)) FROM zs) - (SELECT SUM(lgamma(t)) FROM (SELECT SUM(cells + 1.0) AS t FROM zs GROUP BY sample))"
PHI = "(SELECT COUNT(*) FROM {groups}) * lgamma({width}) + (SELECT SUM(lgamma(n + 1.0)) FROM {table}) - (SELECT SUM(lgamma(t + {width})) FROM (SELECT SUM(n) AS t FROM {table} GROUP BY {by}))"
PHI_C = PHI.format(groups="ks", width="(SELECT COUNT(*) FROM features)", table="gz", by="z")
PHI_G = PHI.format(groups="cells", width=f"{L}.0", table="yc", by="cell_id")
PHI_CG = PHI.format(groups="ks", width=f"{L}.0", table="yz", by="z")
PSI = "(SELECT SUM(lgamma(CAST(genes AS DOUBLE))) FROM sizes) + (SELECT SUM(lgamma(n + 1.0)) FROM ng) - (SELECT SUM(lgamma(CAST(t + genes AS DOUBLE))) FROM sizes JOIN (SELECT y, SUM(n) AS t FROM yc GROUP BY y) USING (y))"
ETA = f"lgamma({L}.0) + (SELECT SUM(lgamma(genes + 1.0)) FROM sizes) - (SELECT lgamma(SUM(genes + 1.0)) FROM sizes)"
for _model, _terms in (("c", (THETA, PHI_C)), ("g", (PHI_G, PSI, ETA)), ("cg", (THETA, PHI_CG, PSI, ETA))):

    @query(f"loglik_{_model}", f"SELECT round(({') + ('.join(_terms)}), 2) AS log_lik")
    def _(x, model=_model):
        return x.counts.sparkSession.createDataFrame([(round(likelihood.log_likelihood(x, model), 2),)], "log_lik double")


PERPLEXITY = {
    "c": "SELECT round(exp(-SUM(v) / (SELECT SUM(n) FROM mx)), 5) AS perplexity FROM (SELECT m + ln(SUM(exp(score - m))) AS v FROM (SELECT *, MAX(score) OVER (PARTITION BY cell_id) AS m FROM score_c) GROUP BY cell_id, m)",
    "g": "SELECT round(exp(-SUM(n * ln(psi.p * cellp.p)) / SUM(n)), 5) AS perplexity FROM mx JOIN psi USING (feature_id) JOIN cellp USING (y, cell_id)",
    "cg": "SELECT round(exp(-SUM(v) / (SELECT SUM(n) FROM mx)), 5) AS perplexity FROM (SELECT m + ln(SUM(exp(score - m))) AS v FROM (SELECT *, MAX(score) OVER (PARTITION BY cell_id) AS m FROM (SELECT s.cell_id, s.z, s.v + ln(t.p) AS score FROM (SELECT cell_id, z, SUM(n * ln(psi.p * pop.p)) AS v FROM mx JOIN psi USING (feature_id) JOIN pop USING (y) GROUP BY 1, 2) s JOIN cells c USING (cell_id) JOIN theta t ON t.z = s.z AND t.sample = c.sample)) GROUP BY cell_id, m)",
}
for _model, _sql in PERPLEXITY.items():

    @query(f"perplexity_{_model}", _sql, BOTH)
    def _(x, model=_model):
        return likelihood.perplexity(x, model).select(r("perplexity", 5).alias("perplexity"))


LG = "lgamma(CAST({} AS DOUBLE))"


@query("cluster_probability_c", f"""
SELECT i.cell_id, i.z, round(ln(zs.cells - (i.z = i.own)::INT + 1.0) + i.gain - {LG.format('t.n - (i.z = i.own)::INT * i.nc + i.nc + g.g')} + {LG.format('t.n - (i.z = i.own)::INT * i.nc + g.g')}, 3) AS score
FROM (SELECT m.cell_id, c.z AS own, c.sample, ks.z, SUM({LG.format('coalesce(gz.n, 0) - (ks.z = c.z)::INT * m.n + m.n + 1')} - {LG.format('coalesce(gz.n, 0) - (ks.z = c.z)::INT * m.n + 1')}) AS gain, SUM(m.n) AS nc
  FROM mx m JOIN cells c USING (cell_id) CROSS JOIN ks LEFT JOIN gz ON gz.feature_id = m.feature_id AND gz.z = ks.z GROUP BY ALL) i
JOIN zs ON zs.z = i.z AND zs.sample = i.sample JOIN (SELECT z, SUM(n) AS n FROM gz GROUP BY z) t ON t.z = i.z, (SELECT COUNT(*) AS g FROM features) g""")
def _(x):
    return likelihood.cell_conditional(x).select("cell_id", "z", r("score", 3).alias("score"))


@query("cluster_probability_g", f"""
SELECT feature_id, y, round(gain + {LG.format('s + 2')} - {LG.format('s + 1')} + {LG.format('s + 1')} - {LG.format('s')} + {LG.format('t + s')} - {LG.format('t + n + s + 1')}, 3) AS score FROM (
SELECT i.feature_id, i.y, i.gain, i.ng AS n, sizes.genes - (i.y = i.own)::INT AS s, t.n - (i.y = i.own)::INT * i.ng AS t
FROM (SELECT m.feature_id, f.y AS own, ls.y, SUM({LG.format('coalesce(yc.n, 0) - (ls.y = f.y)::INT * m.n + m.n + 1')} - {LG.format('coalesce(yc.n, 0) - (ls.y = f.y)::INT * m.n + 1')}) AS gain, SUM(m.n) AS ng
  FROM mx m JOIN features f USING (feature_id) CROSS JOIN ls LEFT JOIN yc ON yc.cell_id = m.cell_id AND yc.y = ls.y GROUP BY ALL) i
JOIN sizes ON sizes.y = i.y JOIN (SELECT y, SUM(n) AS n FROM yc GROUP BY y) t ON t.y = i.y)""")
def _(x):
    return likelihood.feature_conditional(x).select("feature_id", "y", r("score", 3).alias("score"))


@query("cluster_probability_cg_cells", f"""
SELECT i.cell_id, i.z, round(ln(zs.cells - (i.z = i.own)::INT + 1.0) + i.gain - {LG.format('t.n - (i.z = i.own)::INT * i.nc + i.nc + g.g')} + {LG.format('t.n - (i.z = i.own)::INT * i.nc + g.g')}, 3) AS score
FROM (SELECT m.cell_id, c.z AS own, c.sample, ks.z, SUM({LG.format('coalesce(yz.n, 0) - (ks.z = c.z)::INT * m.n + m.n + 1')} - {LG.format('coalesce(yz.n, 0) - (ks.z = c.z)::INT * m.n + 1')}) AS gain, SUM(m.n) AS nc
  FROM yc m JOIN cells c USING (cell_id) CROSS JOIN ks LEFT JOIN yz ON yz.y = m.y AND yz.z = ks.z GROUP BY ALL) i
JOIN zs ON zs.z = i.z AND zs.sample = i.sample JOIN (SELECT z, SUM(n) AS n FROM yz GROUP BY z) t ON t.z = i.z, (SELECT COUNT(*) AS g FROM ls) g""")
def _(x):
    return likelihood.cell_conditional_of_modules(x).select("cell_id", "z", r("score", 3).alias("score"))


@query("cluster_probability_cg_features", f"""
SELECT feature_id, y, round(gain + {LG.format('s + 2')} - {LG.format('s + 1')} + {LG.format('s + 1')} - {LG.format('s')} + {LG.format('t + s')} - {LG.format('t + n + s + 1')}, 3) AS score FROM (
SELECT i.feature_id, i.y, i.gain, i.ng AS n, sizes.genes - (i.y = i.own)::INT AS s, t.n - (i.y = i.own)::INT * i.ng AS t
FROM (SELECT m.feature_id, f.y AS own, ls.y, SUM({LG.format('coalesce(yz.n, 0) - (ls.y = f.y)::INT * m.n + m.n + 1')} - {LG.format('coalesce(yz.n, 0) - (ls.y = f.y)::INT * m.n + 1')}) AS gain, SUM(m.n) AS ng
  FROM gz m JOIN features f USING (feature_id) CROSS JOIN ls LEFT JOIN yz ON yz.z = m.z AND yz.y = ls.y GROUP BY ALL) i
JOIN sizes ON sizes.y = i.y JOIN (SELECT y, SUM(n) AS n FROM yz GROUP BY y) t ON t.y = i.y)""")
def _(x):
    return likelihood.feature_conditional_of_clusters(x).select("feature_id", "y", r("score", 3).alias("score"))


@query("em_assign", "SELECT cell_id, z FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY cell_id ORDER BY score DESC, z) AS r FROM score_c) WHERE r = 1", BOTH)
def _(x):
    return rank.best_label(likelihood.cell_scores(x, "c"), "cell_id")


@query("second_best", "SELECT cell_id, z FROM (SELECT s.*, ROW_NUMBER() OVER (PARTITION BY s.cell_id ORDER BY score DESC, s.z) AS r FROM score_c s JOIN cells c USING (cell_id) WHERE s.z <> c.z) WHERE r = 1", BOTH)
def _(x):
    return rank.second_best(likelihood.cell_scores(x, "c"), x.cells, "cell_id")


@query("drawn_label")
def _(x):
    return rank.drawn_label(likelihood.cell_conditional(x), "cell_id")


# 2.6, 2.7: ranks, runs


@query("top_rank", "SELECT z, CAST(r AS INTEGER) AS rank, feature_id, n FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY z ORDER BY n DESC, feature_id) AS r FROM gz) WHERE r <= 25")
def _(x):
    return rank.top_rank(aggregate.by_cluster(x.counts, x.cells), 25, "z", "feature_id", "n")


@query("top_rank_increasing", "SELECT z, CAST(r AS INTEGER) AS rank, feature_id, n FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY z ORDER BY n, feature_id) AS r, COUNT(*) FILTER (WHERE n > 100) OVER (PARTITION BY z) AS a FROM gz) WHERE r <= least(10, a)")
def _(x):
    return rank.top_rank(aggregate.by_cluster(x.counts, x.cells), 10, "z", "feature_id", "n", threshold=100, decreasing=False)


@query("module_table", f"SELECT CAST(r AS INTEGER) AS rank, {', '.join(f'''coalesce(MAX(CAST(feature_id AS VARCHAR)) FILTER (WHERE y = {i}), '') AS L{i}''' for i in range(1, L + 1))} FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY y ORDER BY n DESC, feature_id) AS r FROM ng JOIN features USING (feature_id)) GROUP BY r")
def _(x):
    return rank.module_table(x.features, aggregate.totals(x.counts, "feature_id"), L)


@query("module_heatmap_cells", "SELECT y, CAST(ROW_NUMBER() OVER (PARTITION BY y ORDER BY up) AS INTEGER) AS place, cell_id, round(value, 9) AS value FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY y ORDER BY value, cell_id DESC) AS up, ROW_NUMBER() OVER (PARTITION BY y ORDER BY value DESC, cell_id) AS down FROM (SELECT y, cell_id, n / SUM(n) OVER (PARTITION BY cell_id) AS value FROM yc)) WHERE up <= 20 OR down <= 20")
def _(x):
    shares = normalize.prop_table(aggregate.by_module(x.counts, x.features), "cell_id")
    return rank.head_and_tail(shares, 20).withColumn("value", r("value", 9))


RUNS = "runs AS (SELECT CAST(o_orderkey AS INTEGER) AS index, CAST(o_orderkey % 3 + 1 AS INTEGER) AS chain, CAST(o_custkey % 4 + 2 AS INTEGER) AS K, CAST(o_custkey % 3 + 5 AS INTEGER) AS L, -o_totalprice AS log_lik FROM orders)"


def _runs(spark, d):
    return matrix.read(spark, d, "orders").select(F.col("o_orderkey").cast("int").alias("index"), (F.col("o_orderkey") % 3 + 1).cast("int").alias("chain"), (F.col("o_custkey") % 4 + 2).cast("int").alias("K"), (F.col("o_custkey") % 3 + 5).cast("int").alias("L"), (-F.col("o_totalprice")).alias("log_lik"))


Q["best_model"] = lambda s, d: rank.best_runs(_runs(s, d), ["K", "L"])
SQL["best_model"] = f"WITH {RUNS} SELECT index, chain, K, L, log_lik FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY K, L ORDER BY log_lik DESC, index) AS r FROM runs) WHERE r = 1"
Q["subset_runs"] = lambda s, d: filters.subset_runs(_runs(s, d), {"K": [2, 3], "L": [5]})
SQL["subset_runs"] = f"WITH {RUNS} SELECT * FROM runs WHERE K IN (2, 3) AND L IN (5)"
Q["append_runs"] = lambda s, d: filters.append_runs(_runs(s, d).where("chain = 1"), _runs(s, d).where("chain = 2"))
SQL["append_runs"] = f"WITH {RUNS} SELECT * FROM runs WHERE chain = 1 UNION ALL SELECT CAST(index + (SELECT MAX(index) FROM runs WHERE chain = 1) AS INTEGER), chain, K, L, log_lik FROM runs WHERE chain = 2"
CURVE = f"{RUNS}, points AS (SELECT K, L, chain AS resample, -AVG(log_lik) AS perplexity FROM runs GROUP BY ALL)"


def _points(s, d):
    return _runs(s, d).groupBy("K", "L", F.col("chain").alias("resample")).agg((-F.avg("log_lik")).alias("perplexity"))


Q["rpc"] = lambda s, d: rank.perplexity_change(_points(s, d)).withColumns({c: r(c, 4) for c in ("perplexity", "change")})
SQL["rpc"] = f"WITH {CURVE} SELECT K, L, resample, round(perplexity, 4) AS perplexity, round(perplexity - LAG(perplexity) OVER (PARTITION BY L, resample ORDER BY K), 4) AS change FROM points"
Q["mean_perplexity"] = lambda s, d: plots.search_perplexity(_points(s, d)).withColumn("perplexity", r("perplexity", 4))
SQL["mean_perplexity"] = f"WITH {CURVE} SELECT K, L, round(AVG(perplexity), 4) AS perplexity FROM points GROUP BY ALL"
Q["rpc_smooth"] = lambda s, d: plots.perplexity_rate(_points(s, d))
Q["parameter_grid"] = lambda s, d: s.createDataFrame([(g["index"], g["K"], g["L"], g["chain"], g["seed"]) for g in fits.grid({"K": [2, 3], "L": [4, 5]}, 3, 12345)], "index int, K int, L int, chain int, seed int")
SQL["parameter_grid"] = "SELECT CAST(ROW_NUMBER() OVER (ORDER BY K, L, chain) AS INTEGER) AS index, K, L, chain, 12344 + chain AS seed FROM (SELECT unnest([2, 3]) AS K), (SELECT unnest([4, 5]) AS L), (SELECT unnest([1, 2, 3]) AS chain)"


@query("elbow", """SELECT x, y, round(d, 6) AS distance, second, d = MAX(d) OVER () AND x = MIN(x) FILTER (WHERE d = dm) OVER () AS elbow FROM (SELECT *, MAX(d) OVER () AS dm FROM (
SELECT x, y, LEAD(y) OVER (ORDER BY x) + LAG(y) OVER (ORDER BY x) - 2 * y AS second, abs((x0 - x1) * (y - y0) - (y0 - y1) * (x - x0)) / sqrt((x0 - x1) * (x0 - x1) + (y0 - y1) * (y0 - y1)) AS d
FROM (SELECT *, FIRST(x) OVER w AS x0, FIRST(y) OVER w AS y0, LAST(x) OVER w AS x1, LAST(y) OVER w AS y1 FROM (SELECT z AS x, CAST(MAX(n) AS DOUBLE) AS y FROM gz GROUP BY z) WINDOW w AS (ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))))""")
def _(x):
    curve = aggregate.by_cluster(x.counts, x.cells).groupBy(F.col("z").alias("x")).agg(F.max("n").cast("double").alias("y"))
    return rank.elbow(curve, "x", "y").withColumn("distance", r("distance", 6))


@query("added_log_lik", f"SELECT iter, coalesce(a.v, (SELECT v FROM a WHERE iter = {K})) + coalesce(b.v, (SELECT v FROM b WHERE iter = {L})) AS log_lik FROM a FULL JOIN b USING (iter)", PRELUDE + ", a AS (SELECT z AS iter, -SUM(n)::DOUBLE AS v FROM yz GROUP BY z), b AS (SELECT y AS iter, -SUM(n)::DOUBLE AS v FROM yz GROUP BY y)")
def _(x):
    sums = aggregate.by_both(x.counts, x.cells, x.features)
    return rank.added_log_lik(*[sums.groupBy(F.col(label).alias("iter")).agg((-F.sum("n")).cast("double").alias("log_lik")) for label in ("z", "y")])


@query("downsample_cells")
def _(x):
    n = x.cells.count()
    return filters.sample_quota(x.cells, n * 2 // 3, n // 10).select("cell_id", "z")


# distances between cluster profiles

PAIRS = "pr AS (SELECT f.feature_id, a.z AS a, b.z AS b, COALESCE(ga.n, 0)::DOUBLE AS x, COALESCE(gb.n, 0)::DOUBLE AS y FROM features f JOIN ks a ON true JOIN ks b ON a.z < b.z LEFT JOIN gz ga ON ga.feature_id = f.feature_id AND ga.z = a.z LEFT JOIN gz gb ON gb.feature_id = f.feature_id AND gb.z = b.z)"
METRICS = {
    "cosine": "(1 - SUM(x * y) / sqrt(SUM(x * x) * SUM(y * y))) / 2",
    "hellinger": "sqrt(SUM((sqrt(x) - sqrt(y)) ** 2)) / sqrt(2)",
    "spearman": None,
    "correlation": "1 - corr(x, y)",
    "euclidean": "sqrt(SUM((x - y) ** 2))",
    "maximum": "MAX(abs(x - y))",
    "manhattan": "SUM(abs(x - y))",
    "canberra": "SUM(CASE WHEN x + y > 0 THEN abs(x - y) / (x + y) END)",
    "binary": "COUNT(*) FILTER (WHERE (x <> 0) <> (y <> 0)) / COUNT(*) FILTER (WHERE x <> 0 OR y <> 0)",
    "minkowski": "SUM(abs(x - y) ** 3) ** (1.0 / 3)",
}
for _name, _sql in METRICS.items():
    _sql = f"SELECT a, b, round(CAST({_sql} AS DOUBLE), 7) AS distance FROM pr GROUP BY a, b" if _sql else "SELECT a, b, round((1 - corr(rx, ry)) / 2, 7) AS distance FROM (SELECT a, b, RANK() OVER (PARTITION BY a, b ORDER BY x) + (COUNT(*) OVER (PARTITION BY a, b, x) - 1) / 2.0 AS rx, RANK() OVER (PARTITION BY a, b ORDER BY y) + (COUNT(*) OVER (PARTITION BY a, b, y) - 1) / 2.0 AS ry FROM pr) GROUP BY a, b"

    @query(f"distance_{_name}", _sql, PRELUDE + "," + PAIRS)
    def _(x, name=_name):
        sums, g = aggregate.by_cluster(x.counts, x.cells), x.features.count()
        if name in ("cosine", "hellinger"):
            out = getattr(distances, name)(sums, K)
        else:
            out = distances.spearman(sums, K, g) if name == "spearman" else distances.distance(sums, K, g, name, 3)
        return out.withColumn("distance", r("distance", 7))


# 2.9: contamination, with native shares fixed at 0.5

DX = f"""th AS (SELECT cell_id, z, 0.5::DOUBLE AS theta FROM cells),
w0 AS (SELECT feature_id, z, n * 0.5 + 1e-20 AS n FROM gzf), w1 AS (SELECT *, SUM(n) OVER (PARTITION BY feature_id) - n AS rest FROM w0),
pf AS (SELECT feature_id, z, n / SUM(n) OVER (PARTITION BY z) AS phi, rest / SUM(rest) OVER (PARTITION BY z) AS eta FROM w1),
en AS (SELECT m.feature_id, m.cell_id, c.z, m.n, theta, phi, eta, (phi + 1e-20) * (theta + 1e-20) / ((phi + 1e-20) * (theta + 1e-20) + (eta + 1e-20) * (1 - theta + 1e-20)) AS p FROM mx m JOIN th c USING (cell_id) JOIN pf ON pf.feature_id = m.feature_id AND pf.z = c.z)"""
DXP = BOTH + "," + DX


def _dx(x):
    theta = x.cells.select("cell_id", "z", F.lit(0.5).alias("theta"))
    return theta, contamination.initial(x, theta)


@query("ambient_init", "SELECT feature_id, z, round(phi, 10) AS phi, round(eta, 10) AS eta FROM pf", DXP)
def _(x):
    return _dx(x)[1].withColumns({c: r(c, 10) for c in ("phi", "eta")})


@query("ambient_em_theta", "SELECT cell_id, z, round((SUM(n * p) + 10) / (SUM(n) + 20), 8) AS theta FROM en GROUP BY ALL", DXP)
def _(x):
    return contamination.new_theta(contamination.shares(x, *_dx(x)), (10, 10)).withColumn("theta", r("theta", 8))


@query("ambient_em_profiles", """SELECT feature_id, z, round(n / SUM(n) OVER (PARTITION BY z), 9) AS phi, round(rest / SUM(rest) OVER (PARTITION BY z), 9) AS eta FROM (SELECT *, SUM(n) OVER (PARTITION BY feature_id) - n AS rest FROM
(SELECT g.feature_id, g.z, COALESCE(s.n, 0) AS n FROM gzf g LEFT JOIN (SELECT feature_id, z, SUM(n * p) AS n FROM en GROUP BY ALL) s ON s.feature_id = g.feature_id AND s.z = g.z))""", DXP)
def _(x):
    return contamination.new_profiles(x, *_dx(x)).withColumns({c: r(c, 9) for c in ("phi", "eta")})


@query("ambient_contamination", "SELECT cell_id, round((SUM(n) - SUM(n * p)) / SUM(n), 8) AS contamination FROM en GROUP BY ALL", DXP)
def _(x):
    return contamination.shares(x, *_dx(x)).select("cell_id", r("contamination", 8).alias("contamination"))


@query("ambient_loglik", "SELECT round(SUM(n * ln(phi * theta + eta * (1 - theta) + 1e-20)), 2) AS log_lik FROM en", DXP)
def _(x):
    return contamination.log_likelihood(x, *_dx(x)).select(r("log_lik", 2).alias("log_lik"))


@query("ambient_native", "SELECT feature_id, cell_id, round(n * p, 7) AS n FROM en", DXP)
def _(x):
    return contamination.native_matrix(x, *_dx(x)).withColumn("n", r("n", 7))


@query("background_eta", "SELECT feature_id, round((COALESCE(b.n, 0) + 1e-20) / SUM(COALESCE(b.n, 0) + 1e-20) OVER (), 10) AS eta FROM features LEFT JOIN (SELECT feature_id, SUM(n) AS n FROM mx WHERE cell_id % 10 = 0 GROUP BY 1) b USING (feature_id)")
def _(x):
    return contamination.background_eta(x.counts.where("cell_id % 10 = 0"), x.features).withColumn("eta", r("eta", 10))


@query("marker_percentage", "SELECT t AS markers, z, round_even(COALESCE(h, 0) / s * 100, 0) AS percent FROM (SELECT z, COUNT(*) AS s FROM cells GROUP BY z) JOIN (SELECT unnest(['A', 'B']) AS t) ON true LEFT JOIN (SELECT cell_type AS t, z, COUNT(DISTINCT cell_id) AS h FROM mx JOIN (SELECT CASE WHEN feature_id % 2 = 0 THEN 'A' ELSE 'B' END AS cell_type, feature_id FROM features WHERE feature_id < 6) USING (feature_id) JOIN cells USING (cell_id) WHERE n >= 2 GROUP BY ALL) USING (t, z)")
def _(x):
    markers = x.features.where("feature_id < 6").select(F.when(F.col("feature_id") % 2 == 0, "A").otherwise("B").alias("cell_type"), "feature_id")
    return contamination.marker_percentage(x.counts, x.cells, markers, 2)


@query("enrichment", """SELECT * FROM (SELECT y, term, overlap, round(p, 9) AS p, round(least(MIN(raw) OVER (PARTITION BY y ORDER BY k DESC ROWS UNBOUNDED PRECEDING), 1.0), 9) AS adjusted FROM (
SELECT *, p * COUNT(*) OVER (PARTITION BY y) / k AS raw FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY y ORDER BY p, term) AS k FROM (
SELECT y, term, overlap, least(SUM(CASE WHEN u - m - t + i >= 0 THEN exp(lgamma(t + 1.0) - lgamma(i + 1.0) - lgamma(t - i + 1.0) + lgamma(u - t + 1.0) - lgamma(m - i + 1.0) - lgamma(u - t - m + i + 1.0) - lgamma(u + 1.0) + lgamma(m + 1.0) + lgamma(u - m + 1.0)) ELSE 0 END), 1.0) AS p
FROM (SELECT *, unnest(range(overlap, least(m, t) + 1)) AS i FROM (SELECT f.y, s.term, COUNT(*) AS overlap FROM features f JOIN (SELECT feature_id, 'T' || CAST(feature_id % 16 // 3 AS VARCHAR) AS term FROM features) s USING (feature_id) GROUP BY ALL)
JOIN (SELECT y, COUNT(*) AS m FROM features GROUP BY y) USING (y) JOIN (SELECT 'T' || CAST(feature_id % 16 // 3 AS VARCHAR) AS term, COUNT(*) AS t FROM features GROUP BY 1) USING (term), (SELECT COUNT(*) AS u FROM features)) GROUP BY y, term, overlap)))) WHERE adjusted < 0.05""")
def _(x):
    sets = x.features.select(F.concat(F.lit("T"), F.floor(F.col("feature_id") % 16 / 3).cast("string")).alias("term"), "feature_id")
    return contamination.enrichment(x.features.select("feature_id", "y"), sets, x.features.count()).withColumns({c: r(c, 9) for c in ("p", "adjusted")})


# 2.11: tables behind the plots; an embedding of two totals stands for dimensions

DIMS = "dims AS (SELECT cell_id, CAST(n % 100 AS DOUBLE) AS dim1, CAST(n % 37 AS DOUBLE) AS dim2 FROM nc)"
DIMP = BOTH + "," + DIMS


def _dims(x):
    return aggregate.totals(x.counts, "cell_id").select("cell_id", (F.col("n") % 100).cast("double").alias("dim1"), (F.col("n") % 37).cast("double").alias("dim2"))


@query("violin_long", "SELECT c.z, f.feature_id, c.cell_id, COALESCE(m.n, 0) AS value FROM cells c CROSS JOIN (SELECT unnest([1, 2, 3])::BIGINT AS feature_id) f LEFT JOIN mx m ON m.feature_id = f.feature_id AND m.cell_id = c.cell_id")
def _(x):
    return plots.violin(x, [1, 2, 3])


@query("centroids", "SELECT z, median(dim1) AS dim1, median(dim2) AS dim2 FROM dims JOIN cells USING (cell_id) GROUP BY z", DIMP)
def _(x):
    return plots.reduced_clusters(x, _dims(x))[1]


@query("reduced_modules", "SELECT cell_id, dim1, dim2, y, round((v - MIN(v) OVER w) / (MAX(v) OVER w - MIN(v) OVER w), 9) AS value FROM (SELECT y, cell_id, n / SUM(n) OVER (PARTITION BY cell_id) AS v FROM ycf) JOIN dims USING (cell_id) WINDOW w AS (PARTITION BY y)", DIMP)
def _(x):
    return plots.reduced_modules(x, _dims(x)).select("cell_id", "dim1", "dim2", "y", r("value", 9).alias("value"))


@query("reduced_features", "SELECT c.cell_id, dim1, dim2, f.feature_id, CAST(COALESCE(m.n, 0) AS DOUBLE) AS value FROM cells c JOIN dims USING (cell_id) CROSS JOIN (SELECT unnest([1, 2, 3])::BIGINT AS feature_id) f LEFT JOIN mx m ON m.feature_id = f.feature_id AND m.cell_id = c.cell_id", DIMP)
def _(x):
    return plots.reduced_features(x, _dims(x), [1, 2, 3], z_score=False, trim=None).withColumn("value", F.coalesce("value", F.lit(0.0)))


@query("facet_order", "SELECT cell_id, feature_id, value, CAST(ROW_NUMBER() OVER (PARTITION BY feature_id ORDER BY value, cell_id) AS INTEGER) AS place FROM (SELECT c.cell_id, f.feature_id, CAST(COALESCE(m.n, 0) AS BIGINT) AS value FROM cells c CROSS JOIN (SELECT unnest([1, 2, 3])::BIGINT AS feature_id) f LEFT JOIN mx m ON m.feature_id = f.feature_id AND m.cell_id = c.cell_id)")
def _(x):
    return plots.ordered_facets(plots.violin(x, [1, 2, 3]).drop("z"))


@query("color_breaks", "SELECT CAST(i AS INTEGER) AS place, round(-m + 2 * m * i / 100, 9) AS value FROM (SELECT MAX(abs(n - 100))::DOUBLE AS m FROM yz) CROSS JOIN (SELECT unnest(range(0, 101)) AS i)")
def _(x):
    values = aggregate.by_both(x.counts, x.cells, x.features).select((F.col("n") - 100).alias("value"))
    return plots.color_breaks(values, 100).withColumn("value", r("value", 9))


@query("row_clusters")
def _(x):
    shares = normalize.prop_table(aggregate.by_cluster(x.counts, x.cells), "feature_id")
    return plots.row_clusters(shares, list(range(1, K + 1)), 6)[0]


@query("probability_map", 'SELECT "row", "column", round(v, 9) AS probability, round(CASE WHEN sd > 0 THEN (sqrt(v) - av) / sd ELSE 0 END, 7) AS relative FROM (SELECT *, stddev_samp(sqrt(v)) OVER (PARTITION BY "row") AS sd, AVG(sqrt(v)) OVER (PARTITION BY "row") AS av FROM (SELECT CAST(y AS VARCHAR) AS "row", CAST(z AS VARCHAR) AS "column", p AS v FROM pop))', BOTH)
def _(x):
    return plots.probability_map(x).withColumns({"probability": r("probability", 9), "relative": r("relative", 7)})


@query("top_feature_heatmap", "SELECT feature_id, cell_id, round(sqrt(v), 9) AS value, y, z FROM (SELECT feature_id, cell_id, n / SUM(n) OVER (PARTITION BY cell_id) AS v FROM mx) JOIN (SELECT feature_id, y FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY y ORDER BY n DESC, feature_id) AS r FROM ng JOIN features USING (feature_id)) WHERE r <= 5) USING (feature_id) JOIN (SELECT cell_id, z FROM cells) USING (cell_id)")
def _(x):
    return plots.top_feature_heatmap(x, 5).withColumn("value", r("value", 9))


@query("trimmed_mean", "SELECT y, round(AVG(n), 7) AS n FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY y ORDER BY n) AS k, COUNT(*) OVER (PARTITION BY y) AS s FROM yc) WHERE k > floor(s * 0.1) AND k <= s - floor(s * 0.1) GROUP BY y")
def _(x):
    return rank.trimmed_mean(aggregate.by_module(x.counts, x.features), "y", "n").withColumn("n", r("n", 7))


@query("quantile", "SELECT y, round(quantile_cont(CAST(n AS DOUBLE), 0.9), 7) AS n FROM yc GROUP BY y")
def _(x):
    return rank.quantile(aggregate.by_module(x.counts, x.features), "y", 0.9, "n").select("y", r("n", 7).alias("n"))


@query("marker_expression", "SELECT 'counts' AS assay, c.z, 'A' AS cell_type, f.feature_id, c.cell_id, round(ln(1 + COALESCE(m.n, 0)::DOUBLE), 9) AS value FROM cells c CROSS JOIN (SELECT unnest([1, 2])::BIGINT AS feature_id) f LEFT JOIN mx m ON m.feature_id = f.feature_id AND m.cell_id = c.cell_id")
def _(x):
    return plots.marker_expression(x, x.features.where("feature_id IN (1, 2)").select(F.lit("A").alias("cell_type"), "feature_id"), ["counts"], log1p=True).withColumn("value", r("value", 9))


@query("module_heatmap")
def _(x):
    return plots.module_heatmap(x, 20, 5)


# rows only: fits, searches, simulations


@query("cluster_cells_fit")
def _(x):
    return fits.cluster_cells(x, 4).z


@query("cluster_cells_distributed")
def _(x):
    return fits.cluster_cells_distributed(x, K).z


@query("cluster_features_fit")
def _(x):
    return fits.cluster_features(x, 4).y


@query("cluster_both_fit")
def _(x):
    m = fits.cluster_both(x, 3, 4)
    return m.z.select(F.lit("z").alias("axis"), F.col("cell_id").alias("id"), F.col("z").alias("label")).unionByName(m.y.select(F.lit("y").alias("axis"), F.col("feature_id").alias("id"), F.col("y").alias("label")))


@query("grid_search")
def _(x):
    return fits.grid_search(x, "c", {"K": [2, 3, 4]}).select("K", "L", "chain", "log_lik", "mean_perplexity")


@query("recursive_split_cells")
def _(x):
    return fits.recursive_split(x, "z", 2, 4)


@query("recursive_split_modules")
def _(x):
    return fits.recursive_split(x, "y", 2, 4)


@query("split_module")
def _(x):
    return fits.split_module(x, 1).features.select("feature_id", "y")


@query("ambient_fit")
def _(x):
    d = fits.remove_ambient(x)
    return d.cells.select("cell_id", "z", "theta", "contamination")


@query("reorder")
def _(x):
    return fits.reordered(x, "cg").cells.select("cell_id", "z")


@query("components")
def _(x):
    from pyspark.ml.functions import vector_to_array

    return fits.components(x, 2).select("cell_id", vector_to_array("pc").alias("pc"))


@query("initial_clusters")
def _(x):
    return fits.initial_clusters(x)


@query("embedding_graph")
def _(x):
    return embed.embedding(x, "graph")


@query("embedding_neighbours")
def _(x):
    return embed.embedding(x, "neighbours")


@query("resampled_perplexity")
def _(x):
    m = fits.matrix_of(x)
    s = x.counts.sparkSession
    return fits.resampled_perplexity(s, m, "c", fits.run_all(s, m, "c", fits.grid({"K": [2, 3]}, 1, 5), fits.Priors()), resamples=2)


Q["simulate_cells"] = lambda s, d: simulate.simulate_cells(s, "cg").counts
Q["simulate_contamination"] = lambda s, d: simulate.simulate_contamination(s)[0].counts


def entry(spark: SparkSession, d: str) -> DataFrame:
    """Frequent features, summed by cell cluster, as shares of it, the top ten of each cluster."""
    x = filters.select_features(x_of(spark, d)).subset()
    shares = normalize.prop_table(aggregate.by_cluster(x.counts, x.cells), "z")
    return rank.top_rank(shares, 10, "z", "feature_id", "value")


Q["flagship"] = entry
SQL["flagship"] = f"WITH {PRELUDE}, kept AS (SELECT feature_id FROM mx GROUP BY 1 HAVING COUNT(*) FILTER (WHERE n >= 3) >= 3) SELECT z, CAST(r AS INTEGER) AS rank, feature_id, value FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY z ORDER BY value DESC, feature_id) AS r FROM (SELECT z, feature_id, n / SUM(n) OVER (PARTITION BY z) AS value FROM gz WHERE feature_id IN (SELECT feature_id FROM kept))) WHERE r <= 10"


def queries() -> dict:
    return dict(Q)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
