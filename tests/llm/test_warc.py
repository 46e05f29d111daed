import hashlib
import random
import re
from collections import defaultdict

import pytest

from quillon.llm import warc

SCHEMA = "page_id long, url string, html string"
MAGIC = warc.END + warc.MAGIC
FAKE = MAGIC + "WARC-Type: response\r\nWARC-Record-ID: <urn:page:99>\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"


def expected(rows):
    by = defaultdict(list)
    for i, _, h in rows:
        by[(h or "").encode()].append(i)
    out = []
    for i, _, h in rows:
        b = (h or "").encode()
        first = min((x for x in by[b] if x is not None), default=None)
        again = len(b) >= 100 and first is not None and i != first
        out.append((i, len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", first if again else None))
    return sorted(out, key=str)


def hostile():
    rng = random.Random(1)
    rows = [(1, "u", "x" * 150), (2, "u", "x" * 150), (3, None, None), (4, "u", ""), (5, "u", f"a{FAKE}b"), (6, "u", "short"), (7, "u", "short"), (8, "u", "ends\r\n\r\n"), (9, "u", MAGIC), (10, "u", MAGIC * 2 + "z" * 200), (11, "u", MAGIC * 2 + "z" * 200), (12, "u", "\r\n\r\n\r\nWARC/1.1"), (13, "ü\r\n", "é\r\n" * 100 + FAKE * 9), (14, "u", "WARC/1.1\r\nContent-Length: 3\r\n\r\n"), (None, "u", "x" * 150), (None, None, None)]
    parts = ["ab é", "\r\n", "\r\n\r\n", MAGIC, FAKE, "WARC/1.1\r\n", "WARC/1.1", "x" * 50]
    return rows + [(k, "u", "".join(rng.choice(parts) for _ in range(rng.randint(0, 12)))) for k in range(15, 120)]


@pytest.mark.parametrize("split", ["128m", "2k"])
def test_hostile_payloads_come_back(spark, split):
    rows = hostile()
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", "1k")
    try:
        found = warc.archived(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert sorted(map(tuple, found), key=str) == expected(rows)


def test_test_pages(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    assert sorted(map(tuple, warc.archived(pages).collect()), key=str) == expected([tuple(r) for r in pages.collect()])


def test_files_are_chains_of_records(spark, tmp_path):
    import re

    warc.write_archives(spark.createDataFrame(hostile(), SCHEMA).repartition(2), f"file://{tmp_path}/w")
    n = 0
    for f in tmp_path.glob("w/part*"):
        data, at = f.read_bytes(), 0
        while at < len(data):
            end = data.index(b"\r\n\r\n", at)
            head = data[at:end]
            assert head.startswith(b"WARC/1.1\r\n")
            at = end + 4 + int(re.search(rb"\r\nContent-Length: (\d+)", head)[1]) + 4
            n += 1
        assert at == len(data)
    assert n == len(hostile())


def test_broken_chain_is_an_error(spark, tmp_path):
    (tmp_path / "part-0").write_bytes(b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 99\r\n\r\nshort\r\n\r\n")
    with pytest.raises(ValueError):
        warc.read_archives(spark, f"file://{tmp_path}")


def test_empty_and_clashing(spark):
    pages = spark.createDataFrame([(1, "u", "y" * 120, "a", 2), (2, "u", "y" * 120, "b", 3)], SCHEMA + ", payload string, first long")
    assert sorted(map(tuple, warc.archived(pages).collect()), key=str) == expected([tuple(r)[:3] for r in pages.collect()])
    assert warc.archived(pages.limit(0)).count() == 0


@pytest.mark.parametrize("limit,bits", [(1, 28), (1, 15), (500_000, 28)])
def test_many_copies_take_a_bitmap(spark, monkeypatch, limit, bits):
    """Beyond the first check a bitmap stands for the copies, here also one so small that it takes other pages for copies."""
    from quillon.llm import common

    monkeypatch.setattr(warc, "MAX_BROADCAST", limit)
    monkeypatch.setattr(common, "BITMAP_BITS", bits)
    rows = [(i, "u", f"{'page' * 40} {i // 3}") for i in range(900)] + [(900 + i, "u", f"{'own' * 40} {i}") for i in range(5000)]
    frame = spark.createDataFrame(rows, SCHEMA)
    assert sorted(map(tuple, warc.archived(frame).collect()), key=str) == expected(rows)


def test_payloads_do_not_move(spark, sf, monkeypatch):
    """In the plan of the responses no payload is under an exchange, copies many or few."""
    from pyspark.sql import functions as F

    pages = spark.read.parquet(f"{sf}/pages.parquet").selectExpr("page_id", "url", "html as payload", "sha2(html, 256) as payload_digest")
    digests = pages.drop("payload")
    copies = digests.where("page_id % 3 = 0")
    for limit in (500_000, 1):
        monkeypatch.setattr(warc, "MAX_BROADCAST", limit)
        if limit == 1:  # the bitmap's mistakes are few at any bound here
            monkeypatch.setattr(warc, "MAX_BROADCAST", copies.count() - 1)
        plan = warc._not_copies(pages, digests, copies).select(F.length("payload"), "page_id")._jdf.queryExecution().executedPlan().toString()
        assert not re.search(r"Exchange (hash|range|round)[^\n]*\n[^\n]*payload#", plan) and "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan
