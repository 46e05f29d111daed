"""Packing along a space-filling curve.

A document's token ids give a hashed, signed count vector; a fixed random projection takes it to
a few dimensions, whose cell has a place on the Hilbert curve. Documents are range-sorted
by that place, neighbours on the curve follow each other, and the stream of their ids is cut into
sequences. Every sequence is full but the last.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import tokens
from .common import small_batches, written

#: Buckets of the hashed vectors, dimensions of the curve, bits of each.
BUCKETS, DIMENSIONS, BITS = 1024, 4, 12
SEED = 20_240_601


@lru_cache(maxsize=2)
def _projection(vocabulary: int) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of each id, those of negative sign BUCKETS further on, and the projection of buckets."""
    ids = np.arange(vocabulary, dtype=np.uint64)
    mixed = ids * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    bucket = (mixed >> np.uint64(40)).astype(np.int64) % BUCKETS + np.where(mixed >> np.uint64(63), 0, BUCKETS)
    return bucket.astype(np.intp), np.random.default_rng(SEED).standard_normal((BUCKETS, DIMENSIONS))


def cells(all_ids: list[np.ndarray], vocabulary: int = 1 << 16) -> np.ndarray:
    """A row of DIMENSIONS cell numbers below 2 ** BITS for each array of unsigned ids."""
    bucket, matrix = _projection(vocabulary)
    vectors = np.zeros((len(all_ids), BUCKETS))
    for vector, ids in zip(vectors, all_ids, strict=True):
        if ids.itemsize > 2:
            ids = ids % vocabulary
        seen = np.bincount(bucket[ids], minlength=2 * BUCKETS)
        vector[:] = seen[:BUCKETS] - seen[BUCKETS:]
    length = np.linalg.norm(vectors, axis=1, keepdims=True)
    at = vectors @ matrix / np.where(length, length, 1)
    share = 1 / (1 + np.exp(-1.702 * at))  # near the normal distribution's, so cells are used evenly
    return np.minimum(share * (1 << BITS), (1 << BITS) - 1).astype(np.int64)


def hilbert(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Places on the Hilbert curve, by Skilling's transform, of an array of points (a row each)."""
    x = points.T.astype(np.int64).copy()
    n = len(x)
    q = 1 << bits - 1
    while q > 1:
        p = q - 1
        for i in range(n):
            on = (x[i] & q) != 0
            swap = (x[0] ^ x[i]) & p
            x[0] ^= np.where(on, p, swap)
            x[i] ^= np.where(on, 0, swap)
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << bits - 1
    while q > 1:
        t ^= np.where(x[n - 1] & q, q - 1, 0)
        q >>= 1
    x ^= t
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            out = out << 1 | x[i] >> b & 1
    return out


def _placed(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = tokens.encoder(path)
        end = np.array([end_id], enc.dtype).tobytes()
        for batch in batches:
            for at in range(0, len(batch), tokens.BATCH_TEXTS):
                some = batch.slice(at, tokens.BATCH_TEXTS)
                ids = [x + end for x in enc.encode(some.column(2).to_pylist())]
                arrays = [np.frombuffer(x, enc.dtype) for x in ids]
                key = hilbert(cells(arrays))
                n = np.array([len(x) for x in arrays], np.int64)
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), pa.array(key), pa.array(n), pa.array(ids, pa.binary())], names=["row", "doc_id", "key", "n", "ids"])

    return run


def _running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, before = TaskContext.get().partitionId(), 0
    for batch in batches:
        n = batch.column(1).to_numpy()
        ends = np.cumsum(n) + before
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.full(len(n), part, np.int32)), pa.array(ends - n), batch.column(1)], names=["row", "part", "local", "n"])
        before = int(ends[-1]) if len(n) else before


def _pieces(width: int, length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for doc_id, at, ids in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                wide = np.frombuffer(ids, f"<u{width}").astype("<u4").tobytes()
                total, start = len(wide) // 4, 0
                while start < total:
                    offset = (at + start) % length
                    n = min(length - offset, total - start)
                    out.append((doc_id, start, n, zlib.crc32(memoryview(wide)[4 * start : 4 * (start + n)]), total, (at + start) // length, offset))
                    start += n
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)] if out else [pa.array([], pa.int64())] * 7, names=names)

    return run


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(docs: DataFrame, tokenizer: str, length: int = 1024, end_id: int = 0) -> DataFrame:
    """Pieces of all documents in sequences of ``length`` tokens: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Null and empty texts are the end id alone. Rows that repeat a doc_id, or have none, are packed as they stand. Ties on
    the curve go by doc_id, then by row. Other columns are left out; an empty table gives no piece. Only the
    last sequence has padding. Lengths are added up task by task; ids move once, beside their places.
    """
    if length < 1:
        raise ValueError("length must be positive")
    rows = small_batches(docs).select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    placed = written(rows.mapInArrow(_placed(tokenizer, end_id), "row long, doc_id long, key long, n long, ids binary"), "pack-ids")
    order = ["key", "doc_id", "row"]
    narrow = placed.select(*order, "n").repartitionByRange(*order).sortWithinPartitions(*order).select("row", "n")
    local = written(narrow.mapInArrow(_running, "row long, part int, local long, n long"), "pack-places")
    parts = local.groupBy("part").agg(F.sum("n").alias("n"))  # a row for each task of the sort
    base = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))
    at = local.join(base, "part").select("row", (F.col("base") + F.col("local")).alias("at"))
    joined = placed.select("row", "doc_id", "ids").join(at, "row").select("doc_id", "at", "ids")
    return joined.mapInArrow(_pieces(tokens.encoder(tokenizer).width, length), PIECES)
