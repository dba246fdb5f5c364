"""Shared pieces: scratch tables in the cluster's shared folder, scalable running sums, row keys."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import pickle
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from countloom.workers import reachable

#: Words of most contracts: everything between ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; a folder of our own only where it is unset and the master
    is local, as executors elsewhere would each write to a disk of their own."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not at:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[.*\])?", master):
            raise ValueError(f"spark.checkpoint.dir must name a folder that all executors share (the master is {master})")
        at = getattr(shared_dir, "own", None) or "file://" + tempfile.mkdtemp(prefix="countloom-")
        shared_dir.own = at
    return at.rstrip("/")


class Scratch:
    """Written tables that cut lineage. They lie in the shared folder, so a lost executor takes none of them along."""

    def __init__(self, spark: SparkSession):
        self.spark, self.base = reachable(spark), f"{shared_dir(spark)}/scratch-{uuid.uuid4().hex}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.base}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def settle(self) -> None:
        """Let go of what the driver and the shuffle files hold of queries that are done: they stay until the driver collects
        its garbage. What its threads freed outside the heap is given back to the system, too."""
        gc.collect()
        self.spark._jvm.System.gc()
        trim(self.spark)

    def drop(self, *names: str) -> None:
        """Remove tables that no later plan reads."""
        jvm = self.spark._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.base}/{name}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def trim(spark: SparkSession) -> bool:
    """Return memory that the driver's JVM freed outside its heap to the system: its hundreds of threads each keep some. Whether
    this JVM can."""
    jvm = spark._jvm
    kind, lang = jvm.java.lang.Class.forName, jvm.java.lang

    def array(of, *items):
        out = spark.sparkContext._gateway.new_array(of, len(items))
        for i, x in enumerate(items):
            out[i] = x
        return out

    try:  # by reflection, as the server's own class is not open to callers
        name = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
        types = array(lang.Class, kind("javax.management.ObjectName"), kind("java.lang.String"), kind("[Ljava.lang.Object;"), kind("[Ljava.lang.String;"))
        call = kind("javax.management.MBeanServer").getMethod("invoke", types)
        call.invoke(lang.management.ManagementFactory.getPlatformMBeanServer(), array(lang.Object, name, "systemTrimNativeHeap", array(lang.Object), array(lang.String)))
    except Py4JError:  # another JVM, or another C library than glibc
        return False
    return True


def give_back() -> None:
    """Return freed memory to the system: a Python worker lives on after its task, and its size counts for its executor."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library than glibc
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def fitted(sample: DataFrame, build: Callable[[pa.Table], object]) -> object | None:
    """What build() makes of a sample of bounded size, in one task: the driver sees neither the sample nor what training
    takes, only the model. None for an empty sample."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        model = pickle.dumps(build(pa.Table.from_batches(held)) if held else None)
        del held
        give_back()
        yield pa.RecordBatch.from_arrays([pa.array([model], pa.binary())], ["model"])

    got = sample.repartition(1).mapInArrow(task, "model binary").collect()
    return pickle.loads(got[0][0]) if got else None


def text_keys(text: Column, names: tuple[str, str] = ("t1", "t2")) -> list[Column]:
    """128 bits that stand for a whole text; null texts count as empty."""
    t = F.coalesce(text, F.lit(""))
    return [F.xxhash64(t).alias(names[0]), F.xxhash64(F.lit("second"), t).alias(names[1])]


def values(spark: SparkSession, rows: list[tuple], columns: str) -> DataFrame:
    """A small table of literals as SQL VALUES; columns: names and types, as in a schema string."""
    fields = [c.strip().split() for c in columns.split(",")]
    names = ", ".join(n for n, _ in fields)
    casts = ", ".join(f"CAST({n} AS {kind}) AS {n}" for n, kind in fields)
    one = lambda v: "NULL" if v is None else "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'" if isinstance(v, str) else str(v)
    listed = ", ".join("(" + ", ".join(map(one, r)) + ")" for r in rows)
    return spark.sql(f"SELECT {casts} FROM VALUES {listed} AS t({names})")


def row_hash(df: DataFrame) -> Column:
    """A number for a whole row, to order rows that are alike in everything else."""
    return F.xxhash64(*[F.col(f"`{f.name}`") for f in df.schema.fields if "map" not in f.dataType.simpleString()])


def buckets_for(rows: int) -> int:
    """Buckets for running() over so many rows: 100,000 rows each, were all rows one part."""
    return min(max(64, -(-rows // 100_000)), 1 << 18)


def running(df: DataFrame, part: list[str], order: list[str], value: Column, name: str, rows: int) -> DataFrame:
    """Add `name`: the sum of `value` over the earlier rows of the same part, rows being ordered by
    (hash bucket of `order`, `order`). A part is spread over as many buckets as `rows`, the number of all rows, ask for:
    each sums its own rows, and the offsets come from the buckets' totals. Part columns must not be null.
    Rows that tie in `order` get different sums; which of them comes first is open."""
    b, v = "__bucket", "__value"
    split = df.withColumn(b, F.pmod(F.xxhash64(*order), F.lit(buckets_for(rows))).cast("int")).withColumn(v, value.cast("long"))
    totals = split.groupBy(*part, b).agg(F.sum(v).alias("__total"))
    before = Window.partitionBy(*part) if part else Window.partitionBy(F.lit(0))
    totals = totals.withColumn("__offset", F.coalesce(F.sum("__total").over(before.orderBy(b).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__total")
    within = Window.partitionBy(*part, b).orderBy(*[F.col(c).asc_nulls_first() for c in order]).rowsBetween(Window.unboundedPreceding, -1)
    split = split.withColumn(name, F.coalesce(F.sum(v).over(within), F.lit(0)))
    return split.join(totals, [*part, b]).withColumn(name, F.col(name) + F.col("__offset")).drop(b, v, "__offset")
