"""What the operators share: the shared folder, tables that cut lineage, and connected components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What counts as white space between words: the blank, and tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where the session names none, a local one if Spark runs in one process, else an error."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    at = spark.sparkContext._jsc.sc().getCheckpointDir()
    if at.isEmpty():
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="quillon-"))
        at = spark.sparkContext._jsc.sc().getCheckpointDir()
    return at.get().rstrip("/")


def new_path(spark: SparkSession, tag: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def drop_path(spark: SparkSession, path: str) -> None:
    """Removes a table that is no longer read."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


#: Rows in one batch between the JVM and Python: whole texts make rows large.
BATCH_ROWS = 1000


def small_batches(df: DataFrame) -> DataFrame:
    """The same frame; from now on its session's Arrow batches have at most BATCH_ROWS rows, so buffers on both sides stay small."""
    conf = df.sparkSession.conf
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(name)) <= BATCH_ROWS:
        conf.set(name, str(BATCH_ROWS))
    return df


def written(df: DataFrame, tag: str) -> DataFrame:
    """The same rows, read from a table in the shared folder: lineage ends here and a lost executor costs no more than a read."""
    path = new_path(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows that are broadcast at most: a hash table of so many ids has some 64 MB.
MAX_BROADCAST_IDS = 2_000_000

#: Bits of a hash that a bitmap tells apart: 32 MB, in rows of 4 KB.
BITMAP_BITS = 28


def bitmap(hashes: DataFrame) -> DataFrame:
    """(bucket, bits) of the values of the column ``h``, a fixed size however many there are; see in_bitmap."""
    low = F.col("h").bitwiseAND(F.lit((1 << BITMAP_BITS) - 1))
    return hashes.select(low.alias("low")).groupBy(F.bitmap_bucket_number("low").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("low")).alias("bits"))


def in_bitmap(rows: DataFrame, filled: DataFrame, h: Column, name: str) -> DataFrame:
    """Rows with a boolean column: whether their hash may be in the bitmap; false is certain. The bitmap is broadcast."""
    low = h.bitwiseAND(F.lit((1 << BITMAP_BITS) - 1))
    place = F.bitmap_bit_position(low).cast("int")
    byte = F.conv(F.hex(F.expr("substring(bits, _place div 8 + 1, 1)")), 16, 10).cast("int")
    told = rows.withColumns({"bucket": F.bitmap_bucket_number(low), "_place": place}).join(F.broadcast(filled), "bucket", "left")
    on = F.coalesce(F.expr("shiftright(_byte, _place % 8) & 1 = 1"), F.lit(False))
    return told.withColumn("_byte", byte).withColumn(name, on).drop("bucket", "bits", "_byte", "_place")


def joined_by_id(docs: DataFrame, other: DataFrame, how: str, weight: int = 1) -> DataFrame:
    """docs joined to a written table by doc_id: broadcast if the table is small, so texts stay where they are, else shuffled.

    ``weight``: how many ids' room a row takes on average at most.
    """
    small = other.count() * weight <= MAX_BROADCAST_IDS
    return docs.join(F.broadcast(other) if small else other, "doc_id", how)


#: Rows with one key beyond which the key is hot: its row of the other table is broadcast, so these rows are not brought together.
HOT_ROWS = 100_000


def joined_by_key(rows: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """rows left-joined to a written table with a row for each key, with no regard to how many rows a key has.

    A small table is broadcast. Of a larger one the rows of hot keys are, whose number is that of all rows over HOT_ROWS at most; the rest is shuffled.
    """
    if table.count() <= MAX_BROADCAST_IDS // 2:
        return rows.join(F.broadcast(table), key, "left")
    hot = written(rows.groupBy(key).count().where(F.col("count") > HOT_ROWS).select(key), "hot-keys")
    if hot.isEmpty():
        return rows.join(table, key, "left")
    few = F.broadcast(hot)
    told = rows.join(few, key, "left_semi").join(F.broadcast(table.join(few, key, "left_semi")), key, "left")
    return told.unionByName(rows.join(few, key, "left_anti").join(table, key, "left"))


def _smallest_neighbour(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))


def connected(edges: DataFrame, tag: str = "components") -> DataFrame:
    """(node, root) of every node with an edge; root is the smallest node that it reaches.

    ``edges`` has long columns ``u`` and ``v``; direction, repeats and loops don't matter, and edges
    with a null end are no edges. Alternating large-star and small-star steps halve the
    distances, each step is written to the shared folder, and each replaces a node's neighbours by
    its smallest one, so that a hub is never gathered in one place.
    """
    spark = edges.sparkSession

    def both(e: DataFrame) -> DataFrame:
        return e.select("u", "v").unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))

    def keep(e: DataFrame) -> tuple[DataFrame, str, tuple]:
        path = new_path(spark, tag)
        e.where(F.col("u") != F.col("v")).distinct().write.parquet(path)
        out = spark.read.schema("u long, v long").parquet(path)
        mark = out.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        return out, path, tuple(mark)

    now, path, mark = keep(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u is not null and v is not null"))
    while True:
        # large star: the larger neighbours of a node go to the smallest of its neighbourhood
        around = both(now)
        large = around.join(_smallest_neighbour(around), "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        middle, middle_path, _ = keep(large)
        # small star: a node and its smaller neighbours go to the smallest of them
        down = middle.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select("u", F.col("m").alias("v")))
        after, after_path, after_mark = keep(small)
        drop_path(spark, middle_path)
        drop_path(spark, path)
        if after_mark == mark:
            break
        now, path, mark = after, after_path, after_mark
    roots = after.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionAll(roots.select(F.col("root").alias("node"), "root").distinct())
