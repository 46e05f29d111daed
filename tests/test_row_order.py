"""Rows of files keep their order, however Spark deals out splits."""

import pytest

from quillon.operators import audit, rankings
from quillon.sources import tables


@pytest.fixture
def small_splits(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2k")
    spark.conf.set("spark.sql.files.openCostInBytes", "100")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def write_dataset(folder, sizes=(40, 700)):
    """Properties where every item's last row by file and line has the greatest value, all at one time."""
    n, want = 0, {}
    for name, size in zip(tables.PROPERTY_FILES, sizes, strict=True):
        lines = ["timestamp,itemid,property,value,extra"]
        for i in range(size):
            lines.append(f"500,{i % 7},categoryid,{n},x")
            want[i % 7] = str(n)
            n += 1
        (folder / name).write_text("\n".join(lines) + "\n")
    (folder / tables.EVENT_FILE).write_text("timestamp,visitorid,event,itemid,transactionid\n" + "".join(f"{i},1,view,{i % 5},\n" for i in range(900)))
    (folder / tables.TREE_FILE).write_text("categoryid,parentid\n1,\n2,1\n3,2\n2,2\n")
    return want


@pytest.mark.parametrize("sizes", [(40, 700), (700, 40), (300, 300)])
def test_last_row_of_equal_times_wins(spark, tmp_path, small_splits, sizes):
    want = write_dataset(tmp_path, sizes)
    data = tables.read_dataset(spark, f"file://{tmp_path}")
    assert data.properties.rdd.getNumPartitions() > 3
    ordered = [r.value for r in data.properties.orderBy("row_id").collect()]
    assert ordered == [str(i) for i in range(sum(sizes))]
    assert {r.itemid: r.category for r in rankings.latest_category(data.properties, 500).collect()} == want
    assert [r.timestamp for r in data.events.orderBy("row_id").collect()] == list(range(900))


def test_the_tree_takes_a_categorys_last_row(spark, tmp_path):
    write_dataset(tmp_path)
    found = audit.tree_profile(tables.read_dataset(spark, f"file://{tmp_path}").tree)
    assert found["has_cycle"] and found["self_parent_rows"] == 1


def test_folders_and_parquet_keep_their_order(spark, tmp_path, small_splits):
    frame = spark.range(3000).selectExpr("id as timestamp", "1L as visitorid", "'view' as event", "id % 9 as itemid", "cast(null as long) as transactionid")
    (tmp_path / "e").mkdir()
    for i in range(3):
        lines = ["timestamp,visitorid,event,itemid,transactionid"] + [f"{1000 * i + j},1,view,2," for j in range((200, 1000, 30)[i])]
        (tmp_path / f"e/part-{i}.csv").write_text("\n".join(lines) + "\n")
    from quillon.functions.guards import EVENTS

    found = [r.timestamp for r in tables.read_csv(spark, [f"file://{tmp_path}/e"], EVENTS, "events.csv").orderBy("row_id").collect()]
    assert found == sorted(found) and len(found) == 1230
    frame.coalesce(1).sortWithinPartitions("timestamp").write.option("parquet.block.size", 4096).parquet(f"file://{tmp_path}/p")
    one = spark.createDataFrame([(0, 1, "categoryid", "5")], "timestamp long, itemid long, property string, value string")
    one.write.parquet(f"file://{tmp_path}/q")
    spark.createDataFrame([("1", None)], "categoryid string, parentid string").write.parquet(f"file://{tmp_path}/t")
    data = tables.read_parquet_dataset(spark, *[f"file://{tmp_path}/{x}" for x in "pqt"])
    assert [r.timestamp for r in data.events.orderBy("row_id").collect()] == list(range(3000))


def test_each_file_has_its_profile(spark, tmp_path):
    write_dataset(tmp_path)
    found = tables.file_profiles(spark, f"file://{tmp_path}")
    assert [(f["name"], f["row_count"]) for f in found] == [(tables.EVENT_FILE, 900), (tables.PROPERTY_FILES[0], 40), (tables.PROPERTY_FILES[1], 700), (tables.TREE_FILE, 4)]
    assert found[1]["columns"][-1] == "extra" and found[0]["null_counts"]["transactionid"] == 900 and found[3]["null_counts"]["parentid"] == 1
