"""Shared tables, and order-dependent sums over whole tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows that one ordered bucket should hold.
BUCKET_ROWS = 1_000_000


def shared_path(spark: SparkSession) -> str:
    """A new folder in the directory that the cluster names in ``spark.checkpoint.dir``."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="massq-")  # one machine: driver and executors are one process
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/massq/{uuid.uuid4().hex}"


def materialise(df: DataFrame) -> DataFrame:
    """Write to the shared folder and read back: cuts lineage and tells the planner the size."""
    path = shared_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def range_bucket(value: Column, bounds: list[float]) -> Column:
    """How many of the sorted bounds lie at or below a value: a balanced tree of comparisons."""

    def side(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(value < F.lit(float(bounds[mid])), side(lo, mid)).otherwise(side(mid + 1, hi))

    return side(0, len(bounds))


def running_sums(df: DataFrame, order: str, sums: list[str], descending: bool = False, rows: int | None = None) -> DataFrame:
    """Running totals (``<name>_run``) by ``order``, of which ``df`` has one row a value, without a global window.

    Quantiles cut the values into buckets of bounded size; each bucket is summed in
    its own task, and only the buckets' totals, a row each, meet in one.
    """
    n = df.count() if rows is None else rows
    parts = n // BUCKET_ROWS
    bounds = sorted(set(df.approxQuantile(order, [k / (parts + 1) for k in range(1, parts + 1)], 0.001))) if parts else []
    bucketed = df.withColumn("_bucket", range_bucket(F.col(order), bounds))
    direction = (lambda c: F.col(c).desc()) if descending else (lambda c: F.col(c).asc())
    totals = bucketed.groupBy("_bucket").agg(*[F.sum(s).alias(f"_{s}") for s in sums])
    before = Window.partitionBy(F.lit(0)).orderBy(direction("_bucket")).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_bucket", *[F.coalesce(F.sum(f"_{s}").over(before), F.lit(0)).alias(f"_{s}_off") for s in sums])
    inner = Window.partitionBy("_bucket").orderBy(direction(order)).rowsBetween(Window.unboundedPreceding, 0)
    out = bucketed.join(offsets, "_bucket")
    return out.withColumns({f"{s}_run": F.sum(s).over(inner) + F.col(f"_{s}_off") for s in sums}).drop(*[f"_{s}_off" for s in sums])


def running_min_up(df: DataFrame, order: str, value: str, out: str) -> DataFrame:
    """Smallest ``value`` among rows with the same or a lower ``order``; ``df`` as ``running_sums`` returns it."""
    totals = df.groupBy("_bucket").agg(F.min(value).alias("_least"))
    before = Window.partitionBy(F.lit(0)).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_bucket", F.min("_least").over(before).alias("_below"))
    inner = Window.partitionBy("_bucket").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.join(offsets, "_bucket").withColumn(out, F.least(F.min(value).over(inner), F.col("_below"))).drop("_below")


def median(df: DataFrame, value: str, out: str) -> DataFrame:
    """One row: the mean of the middle values of a column, null without any.

    Rows shrink to one a distinct value, whose running counts lead to the middle, so no task sees all of them.
    """
    counts = materialise(df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count(F.lit(1)).alias("n")))
    n = counts.agg(F.sum("n")).first()[0] or 0
    runs = running_sums(counts, value, ["n"])
    at = lambda k: F.min(F.when(F.col("n_run") > k, F.col(value)))
    return runs.agg((at((n - 1) // 2) * 0.5 + at(n // 2) * 0.5).alias(out))
