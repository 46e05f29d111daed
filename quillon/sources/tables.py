"""Sources: CSV and Parquet tables with the engine's schemas, and an adapter for the star-schema test tables."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.guards import EVENTS, PROPERTIES, TREE, require_columns

#: File names of a dataset folder.
EVENT_FILE, PROPERTY_FILES, TREE_FILE = "events.csv", ("item_properties_part1.csv", "item_properties_part2.csv"), "category_tree.csv"
EXPECTED_FILES = (EVENT_FILE, *PROPERTY_FILES, TREE_FILE)


@dataclass(frozen=True)
class Dataset:
    """events, properties and tree; row_id is the order of ingestion (the tree of the test tables has none). ``distinct``: the events are a written table, no two of them equal in all but row_id."""

    events: DataFrame
    properties: DataFrame
    tree: DataFrame
    distinct: bool = False


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def require_files(spark: SparkSession, folder: str) -> None:
    missing = [n for n in EXPECTED_FILES if not exists(spark, f"{folder}/{n}")]
    if missing:
        raise FileNotFoundError(f"Missing dataset files: {', '.join(missing)}")


def read_csv(spark: SparkSession, path: str | list[str], schema: T.StructType, name: str) -> DataFrame:
    """A CSV table with a header, checked by the names it must have; other columns are not read. row_id is the rows' order, see row_order.

    Values that are no numbers where numbers belong are an error, save a number with a fraction of zero.
    """
    paths = [path] if isinstance(path, str) else path
    for p in paths:
        header = spark.read.text(p).limit(1).collect()
        require_columns([c.strip().strip('"') for c in header[0][0].split(",")] if header else [], schema.fieldNames(), p.rpartition("/")[2] or name)
    typed = [F.col(f.name).cast("decimal(38,6)").cast("long").alias(f.name) if f.dataType == T.LongType() else F.col(f.name) for f in schema.fields]
    parts, first = [], 0
    for p in paths:
        raw = spark.read.option("header", True).csv(p)
        ordered, first = row_order(raw, typed, first, F.col("_metadata.file_block_start") + _place_in_task())
        parts.append(ordered)
    return reduce(DataFrame.unionAll, parts)


#: Bits of a row_id for the place in a file; those above number the files.
PLACE_BITS = 50


def _place_in_task() -> Column:
    return F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))


def row_order(raw: DataFrame, columns: list[Column], first: int, place: Column) -> tuple[DataFrame, int]:
    """The columns and row_id: ascending numbers for rows by file (in order of names within one path, from number ``first``) and ``place`` in the file; and the next file's number.

    Spark deals splits out by size, so the number of a task tells nothing of order. A split's offset does: a row takes a byte or more,
    so offset and place in the task stay under the next split's offset, as only a file's last split shares its task with others.
    Files are numbered by a small table, a row for each file, that is broadcast.
    """
    files = sorted(raw.inputFiles())
    after = first + max(len(files), 1)
    if len(files) < 2:
        return raw.select(*columns, (F.shiftleft(F.lit(first).cast("long"), PLACE_BITS) + place).alias("row_id")), after
    # one writes file:///a where the other writes file:/a
    numbers = raw.sparkSession.createDataFrame([(re.sub(":/+", ":/", f, count=1), first + i) for i, f in enumerate(files)], "_path string, _number long")
    placed = raw.select(*columns, F.regexp_replace("_metadata.file_path", "^([a-zA-Z0-9]+):/+", "$1:/").alias("_path"), place.alias("_place"))
    row = F.shiftleft(F.col("_number"), PLACE_BITS) + F.col("_place")
    return placed.join(F.broadcast(numbers), "_path").withColumn("row_id", row).drop("_path", "_place", "_number"), after


def read_dataset(spark: SparkSession, folder: str) -> Dataset:
    """The four-file layout; property files are one logical table, the rows of the second after those of the first."""
    properties = read_csv(spark, [f"{folder}/{n}" for n in PROPERTY_FILES], PROPERTIES, "item_properties")
    return Dataset(read_csv(spark, f"{folder}/{EVENT_FILE}", EVENTS, EVENT_FILE), properties, read_csv(spark, f"{folder}/{TREE_FILE}", TREE, TREE_FILE))


def read_parquet_dataset(spark: SparkSession, events: str, properties: str, tree: str) -> Dataset:
    """The same tables as Parquet; a row_id column is taken as it is, else rows are numbered by file and place."""

    def table(path: str, schema: T.StructType) -> DataFrame:
        df = spark.read.parquet(path)
        require_columns(df.columns, schema.fieldNames(), path.rpartition("/")[2])
        typed = [F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields]
        return df.select(*typed, "row_id") if "row_id" in df.columns else row_order(df, typed, 0, F.col("_metadata.row_index"))[0]

    return Dataset(table(events, EVENTS), table(properties, PROPERTIES), table(tree, TREE))


def file_profiles(spark: SparkSession, folder: str) -> list[dict[str, Any]]:
    """Rows, columns as the file has them, and nulls by column of each of the four files."""
    out = []
    for name in EXPECTED_FILES:
        raw = spark.read.option("header", True).csv(f"{folder}/{name}")
        row = raw.agg(F.count("*"), *[F.count_if(F.col(f"`{c}`").isNull()) for c in raw.columns]).first()
        out.append({"name": name, "row_count": row[0], "columns": raw.columns, "null_counts": dict(zip(raw.columns, row[1:], strict=True))})
    return out


def deduplicated(events: DataFrame) -> DataFrame:
    """One row, the first, of rows that are equal in all columns but row_id; nulls are equal."""
    names = [c for c in events.columns if c != "row_id"]
    return events.groupBy(*names).agg(F.min("row_id").alias("row_id"))


def star_dataset(spark: SparkSession, folder: str) -> Dataset:
    """The engine's tables from the test tables: events, part and lineitem.

    click is addtocart and purchase transaction; other event types are unexpected. Items are the k of props. Categories
    are type and brand of the part, under its type; availability follows the part's line items by day.
    """
    raw = spark.read.parquet(f"{folder}/events.parquet")
    kind = F.when(F.col("event_type") == "click", "addtocart").when(F.col("event_type") == "purchase", "transaction").otherwise(F.col("event_type"))
    millis = F.expr("unix_micros(cast(ts as timestamp)) div 1000")
    events = raw.select(
        millis.alias("timestamp"), F.col("user_id").alias("visitorid"), kind.alias("event"), F.get_json_object("props", "$.k").cast("long").alias("itemid"),
        F.when(F.col("event_type") == "purchase", F.col("event_id")).alias("transactionid"), F.col("event_id").alias("row_id"),
    )
    part = spark.read.parquet(f"{folder}/part.parquet").select("p_partkey", F.concat_ws("/", "p_type", "p_brand").alias("leaf"), "p_type")
    tree = part.select(F.col("leaf").alias("categoryid"), F.col("p_type").alias("parentid")).union(part.select("p_type", F.lit(None).cast("string"))).distinct()
    lines = spark.read.parquet(f"{folder}/lineitem.parquet")
    day = F.expr("unix_micros(cast(l_shipdate as timestamp)) div 1000")
    states = lines.groupBy(day.alias("timestamp"), F.col("l_partkey").alias("itemid")).agg(F.when(F.max("l_linestatus") == "O", "1").otherwise("0").alias("value"))
    category = part.select(F.lit(0).cast("long").alias("timestamp"), F.col("p_partkey").alias("itemid"), F.lit("categoryid").alias("property"), F.col("leaf").alias("value"))
    properties = category.unionByName(states.select("timestamp", "itemid", F.lit("available").alias("property"), "value")).withColumn("row_id", F.xxhash64("timestamp", "itemid", "property"))
    return Dataset(events, properties, tree)
