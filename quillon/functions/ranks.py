"""Exact ranks and order statistics that never sort a table in one task."""

from __future__ import annotations

import math
import tempfile
import uuid
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Buckets of one pass of the search for order statistics: what the driver receives at most.
BUCKETS = 4096


def values_at(df: DataFrame, column: str, positions: Sequence[int]) -> list[int]:
    """The values at 0-based positions of the sorted long column, nulls left out.

    Each pass counts rows in equal buckets of the range that holds a position; a few passes over one
    column find the value, whatever the number of rows. Positions share the passes over ranges that hold them all.
    """
    low, high, total = df.agg(F.min(column), F.max(column), F.count(column)).first()
    if not total:
        raise ValueError(f"no value of {column}")
    out, known = [], {}
    for position in positions:
        if not 0 <= position < total:
            raise ValueError("position beyond the table")
        a, b, before = low, high, 0
        while a < b:
            width = -(-(b - a + 1) // BUCKETS)
            if (a, b) not in known:
                inside = df.where(F.col(column).between(a, b)).groupBy(F.expr(f"cast(({column} - {a}) div {width} as int)").alias("bucket")).count()
                known[a, b] = sorted((r["bucket"], r["count"]) for r in inside.collect())
            for bucket, n in known[a, b]:
                if before + n > position:
                    a, b = a + bucket * width, min(a + bucket * width + width - 1, b)
                    break
                before += n
        out.append(a)
    return out


def nearest_rank(n: int, fraction: float) -> int:
    """0-based position of the nearest-rank quantile."""
    return min(max(math.ceil(n * fraction) - 1, 0), n - 1)


def nearest_index(n: int, fraction: float) -> int:
    """0-based position of the quantile that takes the nearest of the two values around it, the even one in the middle."""
    return round((n - 1) * fraction)


def new_path(spark: SparkSession, tag: str) -> str:
    """A path that nothing else uses, in the checkpoint folder that the session names; in one of our own where it names none and Spark runs in one process."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        context = spark.sparkContext
        if context._jsc.sc().getCheckpointDir().isEmpty():
            if not context.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
            context.setCheckpointDir(tempfile.mkdtemp(prefix="quillon-"))
        named = context._jsc.sc().getCheckpointDir().get()
    return f"{named.rstrip('/')}/{tag}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """The rows, read from a Parquet table in the shared folder: lineage ends here, and later plans read only the columns that they need."""
    path = new_path(df.sparkSession, "rows")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_path(spark: SparkSession, path: str) -> None:
    """Removes a table that is no longer read."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


#: Rows of one key beyond which they are dealt out over segments of time, and slices of a key's time from which segments are made.
SEGMENT_ROWS, SLICES = 1_000_000, 4096


def hot_segments(rows: DataFrame, keys: Sequence[str], at: str, segment_rows: int) -> tuple[DataFrame, DataFrame] | None:
    """Rows of keys with over ``segment_rows`` rows, with their _segment, and the rest; None if no key has so many.

    Segments follow each other in time and rows of equal times share one. A key's time is cut into slices of equal length, which are counted; neighbouring slices
    make a segment until they have ``segment_rows`` rows. Counts and bounds are exact, so a task that runs again deals its rows as before. Null keys are one key.
    """
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("_n"), F.min(at).alias("_low"), F.max(at).alias("_high")).where(F.col("_n") > segment_rows)
    hot = cut(sizes.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "_low", "_high"))
    if hot.isEmpty():
        return None
    same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)])
    names = [f"_k{i}" for i in range(len(keys))]
    # rows without a time, and times of one instant, are in the first slice
    width = F.expr(f"(_high - _low) div {SLICES} + 1")
    sliced = rows.join(hot, same).withColumn("_slice", F.coalesce(((F.col(at) - F.col("_low")) / width).cast("int"), F.lit(-1))).drop("_low", "_high")
    counts = sliced.groupBy(*names, "_slice").agg(F.count("*").alias("_n"))  # some thousand rows for a hot key
    before = F.sum("_n").over(Window.partitionBy(*names).orderBy("_slice")) - F.col("_n")
    dealt = cut(counts.select(*[F.col(n).alias(f"_{n}") for n in names], F.col("_slice").alias("_s"), F.floor(before / segment_rows).cast("int").alias("_segment")))
    on = reduce(Column.__and__, [F.col(n).eqNullSafe(F.col(f"_{n}")) for n in names]) & (F.col("_slice") == F.col("_s"))
    split = sliced.join(dealt, on).drop(*names, *[f"_{n}" for n in names], "_slice", "_s")
    return split, rows.join(hot, same, "left_anti")


def numbered(df: DataFrame, order: Sequence[Column], name: str = "position") -> DataFrame:
    """Rows with their 0-based place in a total order: range-sorted, numbered in each partition, shifted by those before.

    The dealt rows are checkpointed: range bounds are sampled, and a second sampling could deal rows otherwise.
    """
    dealt = df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id())
    placed = cut(dealt.withColumn("_local", F.row_number().over(Window.partitionBy("_part").orderBy(*order))))
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    shifted = placed.join(F.broadcast(before), "_part")  # a row for each partition
    return shifted.withColumn(name, F.col("_before") + F.col("_local") - 1).drop("_part", "_local", "_before")


def first_n(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int | None, name: str = "rank") -> DataFrame:
    """The first n rows of each key in a total order, ranked from 1. With no key the n rows are found by partial limits."""
    if not keys:
        if n is None:
            return numbered(df, order, name).withColumn(name, F.col(name) + 1)
        return df.orderBy(*order).limit(n).withColumn(name, F.row_number().over(Window.orderBy(*order)).cast("long"))
    ranked = df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long"))
    return ranked if n is None else ranked.where(F.col(name) <= n)
