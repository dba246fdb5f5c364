"""Count matrices as relations: counts(feature_id, cell_id, n) without zeros, and the tables beside them.

Fixed column names: cells have cell_id, name, sample and, once clustered, z; features have feature_id, name and y.
"""

from __future__ import annotations

import warnings
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEYS = ("feature_id", "cell_id")


@dataclass
class Experiment:
    """Matrices over the same features and cells, the side tables, and what was computed from them."""

    counts: DataFrame
    cells: DataFrame
    features: DataFrame
    params: dict = field(default_factory=dict)
    assays: dict[str, DataFrame] = field(default_factory=dict)
    subsets: dict[str, Experiment] = field(default_factory=dict)
    reduced_dims: dict[str, DataFrame] = field(default_factory=dict)
    models: dict[str, object] = field(default_factory=dict)

    def assay(self, name: str = "counts") -> DataFrame:
        if name == "counts":
            return self.counts
        if name not in self.assays:
            raise ValueError(f"no assay {name!r}")
        return self.assays[name]

    def with_assay(self, name: str, counts: DataFrame) -> Experiment:
        return replace(self, counts=counts) if name == "counts" else replace(self, assays={**self.assays, name: counts})

    def with_subset(self, name: str, subset: Experiment) -> Experiment:
        return replace(self, subsets={**self.subsets, name: subset})

    def subset(self, name: str = "featureSubset") -> Experiment:
        if name not in self.subsets:
            raise ValueError(f"no subset {name!r}; select_features() makes one")
        return self.subsets[name]


def check_counts(counts: DataFrame) -> DataFrame:
    """counts without zeros, if the columns are right; a null n is an error when it is read."""
    types = dict(counts.dtypes)
    if not {*KEYS, "n"} <= set(types):
        raise ValueError(f"counts need the columns feature_id, cell_id, n; there are {', '.join(types)}")
    if types["n"] not in ("int", "bigint", "smallint", "tinyint", "float", "double"):
        raise ValueError(f"n must be a number, not {types['n']}")
    value = F.when(F.col("n").isNull(), F.raise_error(F.lit("a count is missing")).cast(types["n"])).otherwise(F.col("n"))
    return counts.select(*KEYS, value.alias("n")).where("n <> 0")


def from_wide(rows: DataFrame, values: str = "values", row_id: str = "feature_id", column_id: str = "cell_id") -> DataFrame:
    """The non-zero entries of rows that hold an array each; columns are numbered from 1, as the triplets of a sparse
    matrix are."""
    exploded = rows.select(F.col(row_id), F.posexplode(values).alias("at", "n")).where("n <> 0")
    return exploded.select(row_id, (F.col("at") + 1).cast("long").alias(column_id), "n")


def to_wide(counts: DataFrame, cells: list[int]) -> DataFrame:
    """One row a feature, one column a listed cell, zeros filled in."""
    return counts.groupBy("feature_id").pivot("cell_id", cells).agg(F.sum("n")).na.fill(0)


def transposed(counts: DataFrame) -> DataFrame:
    return counts.select(F.col("cell_id").alias("feature_id"), F.col("feature_id").alias("cell_id"), "n")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def orders_experiment(spark: SparkSession, sf_dir: str, k: int = 5, modules: int = 8) -> Experiment:
    """Parts as features, customers as cells, ordered quantities as counts; labels z and y from the keys."""
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    counts = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).groupBy(F.col("l_partkey").alias("feature_id"), F.col("o_custkey").alias("cell_id"))
    counts = counts.agg(F.sum("l_quantity").cast("long").alias("n"))
    cells = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("cell_id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("sample"), (F.col("c_custkey") % k + 1).cast("int").alias("z"))
    features = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("feature_id"), F.col("p_name").alias("name"), (F.col("p_partkey") % modules + 1).cast("int").alias("y"))
    cells = cells.join(counts.select("cell_id").distinct(), "cell_id", "left_semi")
    features = features.join(counts.select("feature_id").distinct(), "feature_id", "left_semi")
    return Experiment(counts, cells, features, {"K": k, "L": modules, "alpha": 1.0, "beta": 1.0, "delta": 1.0, "gamma": 1.0})


def text_experiment(spark: SparkSession, sf_dir: str) -> Experiment:
    """Lower-cased tokens as features, documents as cells."""
    docs = read(spark, sf_dir, "documents")
    words = docs.select(F.col("doc_id").alias("cell_id"), F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"\w+"), 0)).alias("feature_id"))
    counts = words.groupBy("feature_id", "cell_id").agg(F.count("*").alias("n"))
    return Experiment(counts, docs.select(F.col("doc_id").alias("cell_id"), F.col("lang").alias("sample")), counts.select("feature_id").distinct())


def without_cells(background: DataFrame, cells: DataFrame, on: str = "cell_id") -> DataFrame:
    """Background columns that are not cells; their batch, if they have one, goes with them. Without names on either side
    nothing can be told, which is warned of."""
    if on not in background.columns or on not in cells.columns:
        warnings.warn(f"the background or the cells have no column {on!r}: make sure that the background holds no cells", stacklevel=2)
        return background
    return background.join(cells.select(on).distinct(), on, "left_anti")


def checksum(counts: DataFrame) -> DataFrame:
    """One row that says whether two matrices are the same, whatever their order: entries, sum, xor of hashes."""
    h = F.xxhash64(F.col("feature_id").cast("long"), F.col("cell_id").cast("long"), F.col("n").cast("double"))
    return counts.agg(F.count("*").alias("entries"), F.sum("n").alias("total"), F.bit_xor(h).alias("hash"))


def same_counts(a: DataFrame, b: DataFrame, error: bool = True) -> bool:
    """Whether two matrices agree; otherwise an error, or False."""
    if checksum(a).first() == checksum(b).first():
        return True
    if error:
        raise ValueError("the counts are not those that the model was made from")
    return False


def write_module_table(table: DataFrame, path: str) -> None:
    """Tab-separated, with a header, empty cells for what is missing."""
    table.na.fill("").orderBy("rank").coalesce(1).write.mode("overwrite").option("sep", "\t").option("header", True).option("emptyValue", "").csv(path)
