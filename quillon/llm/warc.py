"""WARC archives: writing, and reading back by boundary-chain verification.

Every place where the record magic stands at a boundary is a candidate. Tasks emit, for each candidate, the offset
at which its header says that the next record starts. Pointer jumping from the start of each file keeps the
candidates that the chain reaches; magic that a payload holds is never reached and stays payload.

Archives are written and read through Spark's text source, so they may lie in any store that Spark reads. Its line
separator is the magic with the two line ends before it: a row is a candidate, splits are Spark's own, and a row's
offset follows from the sizes of the rows before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bitmap, drop_path, in_bitmap, new_path, written

VERSION = "WARC/1.1"
END = "\r\n\r\n"
MAGIC = VERSION + "\r\n"
#: What ends a record and starts the next, without the line end of the magic: so no two boundaries can overlap.
BOUNDARY = END + VERSION
#: Payloads under so many bytes are always stored whole.
MIN_REVISIT_BYTES = 100
#: Fixed date of the records: equal inputs give equal archives.
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _bytes(c: Column) -> Column:
    return F.octet_length(c)


def _record(kind: str) -> Column:
    """A record from its magic to before the two line ends that close it."""
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("payload_bytes").cast("string"), F.lit(END))
    block = F.concat(http, F.col("payload")) if kind == "response" else http
    fields = [
        ("WARC-Type", F.lit(kind)),
        ("WARC-Record-ID", F.concat(F.lit("<urn:page:"), F.col("page_id").cast("string"), F.lit(">"))),
        ("WARC-Date", F.lit(DATE)),
        ("WARC-Target-URI", F.regexp_replace(F.coalesce("url", F.lit("")), r"[\r\n]", "%0A")),
        ("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("payload_digest"))),
    ]
    if kind == "revisit":
        fields += [("WARC-Profile", F.lit(PROFILE)), ("WARC-Refers-To", F.concat(F.lit("<urn:page:"), F.col("refers_to").cast("string"), F.lit(">")))]
    fields += [("Content-Type", F.lit("application/http;msgtype=response")), ("Content-Length", _bytes(block).cast("string"))]
    lines = [F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")) for name, value in fields]
    return F.concat(F.lit(MAGIC), *lines, F.lit("\r\n"), block)


#: Copies, and pages that a bitmap takes for copies, that are broadcast at most (some 200 bytes each).
MAX_BROADCAST = 500_000


def _row_key() -> Column:
    return F.xxhash64("page_id", "payload_digest")


def _not_copies(rows: DataFrame, digests: DataFrame, copies: DataFrame) -> DataFrame:
    """Rows that are no copies; their payloads stay where they are read but beyond two checks of sizes.

    Few copies are broadcast. Of many a bitmap is, and beside it the pages that it takes for copies wrongly. Where these are too many as well,
    the pages that the bitmap names are joined, which moves them.
    """
    keys = ["page_id", "payload_digest"]
    same = lambda a, b: a.page_id.eqNullSafe(b.page_id) & (a.payload_digest == b.payload_digest)
    if copies.count() <= MAX_BROADCAST:
        few = F.broadcast(copies.select(*keys))
        return rows.join(few, same(rows, few), "left_anti")
    filled = bitmap(copies.select(_row_key().alias("h")))
    narrow = in_bitmap(digests.select(*keys), filled, _row_key(), "maybe").where("maybe")
    wrong = written(narrow.join(copies, same(narrow, copies), "left_anti").select(*keys).distinct(), "warc-wrong")
    told = in_bitmap(rows, filled, _row_key(), "maybe")
    if wrong.count() <= MAX_BROADCAST:
        wrong = F.broadcast(wrong)
    return told.where(~F.col("maybe")).unionByName(told.where("maybe").join(wrong, same(told, wrong), "left_semi")).drop("maybe")


def write_archives(pages: DataFrame, path: str) -> None:
    """A WARC record for each row of page_id, url, html; the payload is the html in UTF-8 (null: empty).

    Of records with equal payloads of at least MIN_REVISIT_BYTES bytes the one with the smallest page_id is the response, the others
    are revisits that refer to it. Rows that repeat a page_id: the row itself decides nothing, so equal rows with
    the smallest page_id are all responses. Rows without a page_id have the id ``null`` and are responses unless
    a row with an id has their payload. Digests alone move; responses are written where they are read, and revisits, which
    have no payload, from the digests.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("payload"))
    rows = rows.withColumns({"payload_bytes": _bytes(F.col("payload")).cast("long"), "payload_digest": F.sha2(F.col("payload").cast("binary"), 256)})
    digests = written(rows.drop("payload"), "warc-digests")
    firsts = digests.where(F.col("payload_bytes") >= MIN_REVISIT_BYTES).groupBy("payload_digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1 and refers_to is not null").drop("n")
    copies = written(digests.join(firsts, "payload_digest").where(~F.col("page_id").eqNullSafe(F.col("refers_to"))), "warc-copies")
    name = F.coalesce(F.col("page_id").cast("string"), F.lit("null"))
    responses = _not_copies(rows, digests, copies).withColumn("page_id", name).select(_record("response").alias("value"))
    revisits = copies.withColumn("page_id", name).select(_record("revisit").alias("value"))
    for records in (responses, revisits):
        records.write.mode("append").option("lineSep", END).text(path)


def _field(name: str) -> Column:
    return F.regexp_extract("head", rf"(?:^|\r\n){name}: ([^\r\n]*)", 1)


def candidates(spark: SparkSession, path: str) -> DataFrame:
    """file, block, nth, size of every stretch between boundaries in order, with its bytes as ``value``."""
    rows = spark.read.option("lineSep", BOUNDARY).text(path)
    return rows.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("nth"), _bytes(F.col("value")).cast("long").alias("size"), "value"
    )


def _located(rows: DataFrame) -> DataFrame:
    """Rows with the offset of their magic. A block's rows follow those of the blocks before it without a gap."""
    sep = len(BOUNDARY)
    blocks = rows.groupBy("file", "block").agg(F.sum(F.col("size") + sep).alias("bytes"))
    base = blocks.select("file", "block", (F.sum("bytes").over(Window.partitionBy("file").orderBy("block")) - F.col("bytes")).alias("base"))
    within = Window.partitionBy("file", "block").orderBy("nth")
    local = rows.withColumn("local", F.sum(F.col("size") + sep).over(within) - F.col("size") - sep)
    at = F.col("base") + F.col("local")
    return local.join(base, ["file", "block"]).withColumn("row_start", at).withColumn("start", F.when(at == 0, 0).otherwise(at - len(VERSION))).drop("base", "local")


def _reached(nodes: DataFrame) -> DataFrame:
    """(file, start) of the candidates that the chains from offset 0 reach, by pointer jumping."""
    spark = nodes.sparkSession

    def laid(rows: DataFrame, tag: str) -> tuple[DataFrame, str]:
        path = new_path(spark, tag)
        rows.write.parquet(path)
        return spark.read.schema(rows.schema).parquet(path), path

    jump, jump_path = nodes.select("file", "start", "next"), None
    reached, path = laid(nodes.where("start = 0").select("file", "start"), "warc-reached")
    while True:
        steps = reached.join(jump, ["file", "start"]).select("file", F.col("next").alias("start"))
        steps = steps.join(nodes.select("file", "start"), ["file", "start"], "left_semi")
        wider, wider_path = laid(reached.unionByName(steps).distinct(), "warc-reached")
        far, far_path = laid(jump.withColumnRenamed("next", "mid").join(jump.select("file", F.col("start").alias("mid"), "next"), ["file", "mid"]).select("file", "start", "next"), "warc-jumps")
        for old in (path, jump_path):
            if old:
                drop_path(spark, old)
        reached, path, jump, jump_path = wider, wider_path, far, far_path
        if jump.isEmpty():
            drop_path(spark, jump_path)
            return reached


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every record of the archives.

    The digest of a response is computed from the bytes read and must equal the one in its header; a revisit tells what its
    response has. A file whose chain does not end at its last byte, or a digest that differs, is an error.
    """
    raw = candidates(spark, path)
    # up to the first blank line stand the fields; the magic stands before them in the first row of a file alone
    rows = raw.withColumn("head", F.substring_index("value", END, 1))
    magic = F.col("value").startswith("\r\n") | F.col("value").startswith(MAGIC)
    length = F.expr(r"try_cast(regexp_extract(head, '(?:^|\r\n)Content-Length: ([0-9]{1,18})(?:\r|$)', 1) as bigint)")
    block_at = _bytes(F.col("head")) + len(END)
    whole = F.col("value").cast("binary")
    http = F.substring_index(F.substring("value", F.length("head") + len(END) + 1, 2**31 - 1), END, 1)
    parsed = rows.withColumns({"block_bytes": F.when(magic, length), "http": http}).withColumns({"http_bytes": _bytes(F.col("http")) + len(END), "told_bytes": F.expr(r"try_cast(regexp_extract(http, '(?:^|\r\n)Content-Length: ([0-9]{1,18})(?:\r|$)', 1) as bigint)")})
    complete = (F.col("size") - block_at) >= F.col("block_bytes")
    payload = F.substring(whole, (block_at + F.col("http_bytes") + 1).cast("int"), (F.col("block_bytes") - F.col("http_bytes")).cast("int"))
    is_response = _field("WARC-Type") == "response"
    narrow = parsed.select(
        "file", "block", "nth", "size", "block_bytes", "http_bytes", "told_bytes",
        F.when(F.col("block_bytes").isNotNull(), (block_at + F.col("block_bytes") + len(END)).cast("long")).alias("row_bytes"),
        complete.alias("complete"), _field("WARC-Type").alias("record_type"), _field("WARC-Record-ID").alias("record_id"), _field("WARC-Refers-To").alias("refers"), _field("WARC-Payload-Digest").alias("told_digest"),
        F.when(complete & is_response, F.sha2(payload, 256)).alias("digest"),
    )
    at = _located(narrow).withColumn("next", F.col("row_start") + F.col("row_bytes"))
    at = written(at, "warc-candidates")
    ends = at.groupBy("file").agg(F.max(F.col("row_start") + F.col("size")).alias("end"))
    nodes = at.where("next is not null").select("file", "start", "next")
    reached = _reached(nodes)
    records = written(at.join(reached, ["file", "start"]), "warc-records")
    broken = records.groupBy("file").agg(F.max("next").alias("last")).join(ends, "file", "right").where(~F.col("last").eqNullSafe(F.col("end"))).select("file").take(1)
    if broken:
        raise ValueError(f"the chain of records breaks in {broken[0]['file']}")
    split = records.where("not complete").select("file", "start", "block_bytes")
    joined = None if split.isEmpty() else _split_payloads(raw, at, records, split)
    if joined is not None:
        records = records.join(joined, ["file", "start"], "left").withColumns({"digest": F.coalesce("digest", "joined"), "http_bytes": F.coalesce("joined_http", "http_bytes")})
    wrong = records.where("record_type = 'response' and not (told_digest <=> concat('sha256:', digest) and told_bytes <=> block_bytes - http_bytes)").take(1)
    if wrong:
        raise ValueError(f"a record's payload is not what its header says: {wrong[0]['record_id']}")
    page = lambda c: F.expr(f"try_cast(regexp_extract({c}, '<urn:page:(-?[0-9]+)>', 1) as bigint)")
    return records.select(page("record_id").alias("page_id"), F.col("told_bytes").alias("payload_bytes"), F.regexp_replace("told_digest", "^sha256:", "").alias("payload_digest"), "record_type", page("refers").alias("refers_to"))


def _split_payloads(raw: DataFrame, at: DataFrame, records: DataFrame, split: DataFrame) -> DataFrame:
    """(file, start, joined, joined_http): digests of payloads that hold boundaries, from their stretches in order.

    A stretch belongs to the last record of its file that starts no later. Which stretches are asked for is found without their bytes.
    """
    files = split.select("file").distinct()
    own = records.select("file", "start", F.col("start").alias("own"))
    known = at.select("file", "block", "nth", "start", "row_start").join(files, "file", "left_semi").join(own, ["file", "start"], "left")
    owned = known.withColumn("from", F.last("own", ignorenulls=True).over(Window.partitionBy("file").orderBy("start")))
    asked = owned.join(split.select("file", F.col("start").alias("from"), "block_bytes"), ["file", "from"]).select("file", "block", "nth", "from", "row_start", "block_bytes")
    asked = written(asked, "warc-stretches")
    met = raw.select("file", "block", "nth", "value").join(F.broadcast(asked) if asked.count() <= MAX_BROADCAST else asked, ["file", "block", "nth"])
    parts = met.groupBy("file", "from", "block_bytes").agg(F.array_sort(F.collect_list(F.struct("row_start", "value"))).alias("parts"))
    whole = parts.withColumn("text", F.array_join(F.transform("parts", lambda p: p["value"]), BOUNDARY)).withColumn("head", F.substring_index("text", END, 1))
    # the HTTP header too may end in a later stretch than it began
    http = F.substring_index(F.substring("text", F.length("head") + len(END) + 1, 2**31 - 1), END, 1)
    sized = whole.withColumn("http", _bytes(http) + len(END))
    payload = F.substring(F.col("text").cast("binary"), _bytes(F.col("head")) + len(END) + F.col("http") + 1, (F.col("block_bytes") - F.col("http")).cast("int"))
    return sized.select("file", F.col("from").alias("start"), F.sha2(payload, 256).alias("joined"), F.col("http").alias("joined_http"))


def archived(pages: DataFrame) -> DataFrame:
    """Writes the pages into the shared folder and reads the archives back, see write_archives and read_archives."""
    spark = pages.sparkSession
    path = new_path(spark, "warc")
    write_archives(pages, path)
    return read_archives(spark, path)
