"""Token-ID output as directly addressable codes.

Each id is split into 8-bit chunks. Level 0 has the low chunk of every id; a continuation bitmap
says which ids go on, and only those have a chunk in the next level. A rank directory
(ones before each 512th bit) finds an id's place in the next level, so any token is read
with a few look-ups and no block is decoded.

File format ``quillon-dac-1``: a Parquet table, a row for each shard, in ascending order of documents
by (part, shard). ``doc_ids`` and ``doc_tokens`` list the shard's documents; ``levels``, ``bitmaps``
and ``ranks`` are little-endian byte strings by level (the last level has no bitmap).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import tokens
from .common import new_path, small_batches

FORMAT = "quillon-dac-1"
#: Bits for each entry of a rank directory.
RANK_BITS = 512
#: A shard ends with the document that reaches so many tokens.
SHARD_TOKENS = 1_000_000
SHARDS = "format string, part int, shard int, n_tokens long, doc_ids array<long>, doc_tokens array<long>, levels array<binary>, bitmaps array<binary>, ranks array<binary>"


class DirectCodes:
    """Ids in chunk levels; any token or range is read without decoding what stands before it."""

    def __init__(self, levels: list[bytes], bitmaps: list[bytes], ranks: list[bytes]):
        self.levels = [np.frombuffer(x, np.uint8) for x in levels]
        self.bitmaps = [np.frombuffer(x, np.uint8) for x in bitmaps]
        self.ranks = [np.frombuffer(x, "<u4") for x in ranks]

    @classmethod
    def of(cls, ids: np.ndarray) -> DirectCodes:
        levels, bitmaps, ranks = [], [], []
        rest = np.asarray(ids, np.uint64)
        while True:
            levels.append((rest & np.uint64(255)).astype(np.uint8).tobytes())
            more = rest > 255
            if not more.any():
                return cls(levels, bitmaps, ranks)
            bits = np.packbits(more, bitorder="little")
            steps = RANK_BITS // 8
            ones = np.bitwise_count(np.pad(bits, (0, -len(bits) % steps))).reshape(-1, steps).sum(1, dtype=np.int64)
            bitmaps.append(bits.tobytes())
            ranks.append((np.cumsum(ones) - ones).astype("<u4").tobytes())
            rest = rest[more] >> np.uint64(8)

    def __len__(self) -> int:
        return len(self.levels[0])

    def _rank(self, level: int, at: int) -> int:
        """Ones before a place of a bitmap, from the directory and one block's bytes."""
        if not at:
            return 0
        block = (at - 1) // RANK_BITS
        own = self.bitmaps[level][block * RANK_BITS // 8 : (at + 7) // 8]
        ones = int(np.bitwise_count(own).sum())
        if at % 8:
            ones -= (int(own[-1]) >> at % 8).bit_count()
        return int(self.ranks[level][block]) + ones

    def get(self, at: int) -> int:
        """The id at a place."""
        if not 0 <= at < len(self):
            raise IndexError(at)
        value = 0
        for level, chunks in enumerate(self.levels):
            value |= int(chunks[at]) << 8 * level
            if level == len(self.bitmaps) or not self.bitmaps[level][at // 8] >> at % 8 & 1:
                break
            at = self._rank(level, at)
        return value

    def range(self, start: int, stop: int) -> np.ndarray:
        """The ids from start to before stop; only this range's chunks are touched."""
        out = np.zeros(stop - start, "<u4")
        where: np.ndarray | None = None
        for level, chunks in enumerate(self.levels):
            part = chunks[start:stop].astype(np.uint32) << np.uint32(8 * level)
            if where is None:
                out[:] = part
            else:
                out[where] |= part
            if level == len(self.bitmaps) or start == stop:
                break
            first = start // 8
            bits = np.unpackbits(self.bitmaps[level][first : (stop + 7) // 8], bitorder="little")[start - 8 * first : stop - 8 * first]
            on = np.flatnonzero(bits)
            where = on if where is None else where[on]
            start = self._rank(level, start)
            stop = start + len(on)
        return out


def _shards(path: str, end_id: int, shard_tokens: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = tokens.encoder(path)
        part, shard = TaskContext.get().partitionId(), 0
        doc_ids: list = []
        lengths: list[int] = []
        held: list[np.ndarray] = []
        end = np.array([end_id], np.uint32)
        total = 0

        def row() -> pa.RecordBatch:
            codes = DirectCodes.of(np.concatenate(held))
            one = [FORMAT, part, shard, total, doc_ids, lengths, [x.tobytes() for x in codes.levels], [x.tobytes() for x in codes.bitmaps], [x.tobytes() for x in codes.ranks]]
            kinds = [pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), *[pa.list_(pa.binary())] * 3]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(one, kinds, strict=True)], names=[x.split()[0] for x in SHARDS.split(", ")])

        for batch in batches:
            for at in range(0, len(batch), tokens.BATCH_TEXTS):
                some = batch.slice(at, tokens.BATCH_TEXTS)
                for doc_id, ids in zip(some.column(0).to_pylist(), enc.encode(some.column(1).to_pylist()), strict=True):
                    held += [np.frombuffer(ids, enc.dtype).astype(np.uint32), end]
                    n = len(held[-2]) + 1
                    doc_ids.append(doc_id)
                    lengths.append(n)
                    total += n
                    if total >= shard_tokens:
                        yield row()
                        shard, total, doc_ids, lengths, held = shard + 1, 0, [], [], []
        if doc_ids:
            yield row()

    return run


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, shard_tokens: int = SHARD_TOKENS) -> None:
    """Writes the ids of every whole text, each with the end id behind it, in ascending order of doc_id.

    Null and empty texts have the end id alone; rows without a doc_id come first; rows that repeat a doc_id are
    all written, side by side. Other columns are left out. An empty table gives a table without shards.
    Range partitioning deals documents out by doc_id, so no task holds more than its range.
    """
    dealt = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    dealt.mapInArrow(_shards(tokenizer, end_id, shard_tokens), SHARDS).write.parquet(path)


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            codes = DirectCodes(row["levels"], row["bitmaps"], row["ranks"])
            ends = np.cumsum(row["doc_tokens"], dtype=np.int64)
            starts = ends - np.array(row["doc_tokens"], np.int64)
            ids = codes.range(0, int(ends[-1])) if len(ends) else ends
            crcs = [zlib.crc32(ids[a:b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
            n = len(crcs)
            yield pa.RecordBatch.from_arrays(
                [pa.array([row["part"]] * n, pa.int32()), pa.array([row["shard"]] * n, pa.int32()), pa.array(row["doc_ids"], pa.int64()), pa.array(starts), pa.array(row["doc_tokens"], pa.int64()), pa.array(crcs, pa.int64())],
                names=["part", "shard", "doc_id", "local_start", "n_tokens", "ids_crc32"],
            )


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids_crc32 (of the ids as little-endian unsigned
    32-bit integers) of every document in the files, read shard by shard."""
    files = spark.read.schema(SHARDS).parquet(path)
    found = files.mapInArrow(_documents, "part int, shard int, doc_id long, local_start long, n_tokens long, ids_crc32 long")
    sizes = files.select("part", "shard", "n_tokens")
    parts = sizes.groupBy("part").agg(F.sum("n_tokens").alias("n"))  # as many rows as the write had tasks
    before = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("part_start"))
    in_part = Window.partitionBy("part").orderBy("shard")
    shards = sizes.select("part", "shard", (F.sum("n_tokens").over(in_part) - F.col("n_tokens")).alias("shard_start")).join(before, "part")
    shards = shards.select("part", "shard", (F.col("part_start") + F.col("shard_start")).alias("base"))
    return found.join(shards, ["part", "shard"]).select("doc_id", (F.col("base") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32")


def token_digest(docs: DataFrame, tokenizer: str, end_id: int = 2) -> DataFrame:
    """Writes token files into the shared folder and reads them back, see write_token_files and read_token_files."""
    spark = docs.sparkSession
    path = new_path(spark, "token-files")
    write_token_files(docs, path, tokenizer, end_id)
    return read_token_files(spark, path)
