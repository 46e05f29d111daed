"""Byte strings that stand in more than one place, by bucket-pointer refinement of sampled suffixes.

A string's identifier names its bucket: the identifier of a q-gram and that of the q-gram at a later offset give the identifier of the longer
string that both cover, and such identifiers are used again for longer ones, from 8 bytes to the whole length. Two lanes with multipliers of their
own make a name of 128 bits.

No suffix of every offset is moved. Of all windows of ``length`` bytes, each is represented by the q-gram in it (three quarters as long) with the least
identifier; equal windows have the same one at the same place, so their suffixes lie in the same initial bucket. Buckets are then refined:

1. Initial buckets of one suffix go: their windows stand nowhere else.
2. A bucket is split by the identifiers of the longest context that its windows reach. In parts of two suffixes or more all windows repeat.
3. Parts of one suffix in a bucket that has others are split once more, by the identifiers of each window; one suffix of each larger part stands for all of it.

What moves is a row for some fifty bytes in the first step, and rows by byte only around the ends of repeats in the third.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import MAX_BROADCAST_IDS, drop_path, new_path, small_batches, written

LENGTH = 400
#: Bytes that are named at once: arrays of eight bytes each of a few times as many are held.
PIECE = 1 << 20
#: Places (some 60 bytes each) that are broadcast at most; texts stay where they are read as long as these suffice.
MAX_PLACES = 1_000_000

_U = np.uint64
_STEP = ((_U(0x9E3779B97F4A7C15), _U(0xBF58476D1CE4E5B9)), (_U(0xD6E8FEB86659FD93), _U(0xA0761D6478BD642F)))


def _refined(early: np.ndarray, late: np.ndarray, lane: int) -> np.ndarray:
    """Identifiers from those at an offset and at a later one."""
    by, spread = _STEP[lane]
    x = early * by + late
    x ^= x >> _U(32)
    x *= spread
    x ^= x >> _U(29)
    return x


def identifiers(raw: np.ndarray, size: int, lane: int) -> np.ndarray:
    """The identifier of the string of ``size`` bytes (8 or more) at each offset where one begins."""
    n = len(raw) - 7
    if len(raw) < size:
        return np.zeros(0, np.uint64)
    ids, at = np.ndarray(n, "<u8", raw, 0, (1,)).astype(np.uint64), 8
    while at < size:
        step = min(at, size - at)
        ids = _refined(ids[: len(ids) - step], ids[step:], lane)
        at += step
    return ids


def _sliding_least(keys: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours, from least values of blocks to the left and right."""
    n = len(keys)
    blocks = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    blocks[:n] = keys
    blocks = blocks.reshape(-1, width)
    left = np.minimum.accumulate(blocks, axis=1).ravel()
    right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[: n - width + 1], left[width - 1 : n])


def _texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a binary column and the offsets of its values in them."""
    kind = np.int64 if pa.types.is_large_binary(column.type) else np.int32
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[ends[0] : ends[-1]], ends - ends[0]


def suffixes(raw: np.ndarray, offsets: np.ndarray, length: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Sampled suffixes of texts that lie one after the other: text, place in it, bytes from the first window to it, windows, bucket, context.

    Whatever lies in two pieces is looked at in both; a suffix is given by the piece that it begins in.
    """
    reach = length // 4
    mask = _U((1 << (PIECE + 2 * length).bit_length()) - 1)
    for start in range(0, len(raw), PIECE):
        base = max(0, start - reach)
        part = raw[base : start + PIECE + length]
        if len(part) < length:
            continue
        grams, windows = identifiers(part, length - reach, 0), identifiers(part, length, 1)
        least = _sliding_least((grams & ~mask) | np.arange(len(grams), dtype=np.uint64), reach + 1)
        first, last = np.searchsorted(offsets, [base, base + len(part) - 1], "right") - 1
        own = np.clip(offsets[first : last + 2], base, base + len(part)) - base
        ends = np.repeat(offsets[first + 1 : last + 2] - base, np.diff(own))
        whole = np.flatnonzero(np.arange(len(windows)) + length <= ends[: len(windows)])
        at = (least[whole] & mask).astype(np.int64)
        new = np.flatnonzero(np.diff(at, prepend=-1))
        runs = np.diff(np.append(new, len(at)))
        place, from_ = at[new], whole[new]
        mine = (place + base >= start) & (place + base < start + PIECE)
        place, from_, runs = place[mine], from_[mine], runs[mine]
        text = np.searchsorted(offsets, place + base, "right") - 1
        low = np.maximum(place - reach, offsets[text] - base)
        high = np.minimum(place + length, offsets[text + 1] - base)
        shape = ((high - low) * 2 * length + place - low).astype(np.uint64)
        context = _refined(_refined(windows[low], windows[high - length], 1), shape, 1)
        yield text, place + base - offsets[text], place - from_, runs, grams[place], context


SUFFIXES = "doc_id long, v int, pos int, before int, run int, h long, c long"


def _sampled(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, versions = batch.column("doc_id"), batch.column("v")
        for text, pos, before, run, h, c in suffixes(*_texts(batch.column("raw")), length):
            rows = pa.array(text)
            numbers = [pa.array(x.astype(np.int32)) for x in (pos, before, run)] + [pa.array(x.view(np.int64)) for x in (h, c)]
            yield pa.RecordBatch.from_arrays([ids.take(rows), versions.take(rows), *numbers], ["doc_id", "v", "pos", "before", "run", "h", "c"])


WINDOWS = "h long, w long, doc_id long, v int, p int, n long"


#: Rows after which windows are given out.
FLUSH_ROWS = 200_000


def _windows(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """The identifiers of all windows of the suffixes asked for."""
    names = ["h", "w", "row", "p", "n"]
    for batch in batches:
        raw, offsets = _texts(batch.column("raw"))
        held: dict[str, list[np.ndarray]] = {c: [] for c in names}

        def given(batch: pa.RecordBatch = batch, held: dict[str, list[np.ndarray]] = held) -> pa.RecordBatch:
            h, w, row, p, n = (np.concatenate(held[c]) for c in names)
            for c in names:
                held[c].clear()
            rows = pa.array(row)
            return pa.RecordBatch.from_arrays([pa.array(h), pa.array(w.view(np.int64)), batch.column("doc_id").take(rows), batch.column("v").take(rows), pa.array(p.astype(np.int32)), pa.array(n)], ["h", "w", "doc_id", "v", "p", "n"])

        for i, places in enumerate(batch.column("places").to_pylist()):
            pos, before, run, h, n = (np.array(x, np.int64) for x in zip(*(p.values() for p in places), strict=True))
            order = np.argsort(pos, kind="stable")
            text = raw[offsets[i] : offsets[i + 1]]
            from_, run, h, n = (pos - before)[order], run[order], h[order], n[order]
            begin = 0
            while begin < len(from_):  # suffixes whose windows lie within a piece, at once
                last = int(np.searchsorted(from_, from_[begin] + PIECE))
                low, size = int(from_[begin]), run[begin:last]
                ids = identifiers(text[low : int((from_[begin:last] + size).max()) + length - 1], length, 1)
                p = np.repeat(from_[begin:last] - np.cumsum(size) + size, size) + np.arange(size.sum())
                for c, x in zip(names, (np.repeat(h[begin:last], size), ids[p - low], np.full(len(p), i), p, np.repeat(n[begin:last], size)), strict=True):
                    held[c].append(x)
                begin = last
                if sum(map(len, held["p"])) >= FLUSH_ROWS:
                    yield given()
        if held["p"]:
            yield given()


CUT = "doc_id long, n_bytes long, n_removed long, n_spans long, spans array<int>, kept_sha256 string"


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw, offsets = _texts(batch.column("raw"))
        all_spans = batch.column("spans").to_pylist()
        removed, digests = [], []
        for i, spans in enumerate(all_spans):
            text, at, kept = raw[offsets[i] : offsets[i + 1]], 0, hashlib.sha256()
            bounds = iter(spans or ())
            for low, high in zip(bounds, bounds, strict=True):
                kept.update(text[at:low])
                at = high
            kept.update(text[at:])
            removed.append(sum((spans or ())[1::2]) - sum((spans or ())[::2]))
            digests.append(kept.hexdigest())
        columns = [batch.column("doc_id"), pa.array(np.diff(offsets)), pa.array(removed, pa.int64()), pa.array([len(s or ()) // 2 for s in all_spans], pa.int64()), pa.array([s or [] for s in all_spans], pa.list_(pa.int32())), pa.array(digests, pa.string())]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "n_removed", "n_spans", "spans", "kept_sha256"])


class _Tables:
    """Written tables that go when they are no longer read."""

    def __init__(self) -> None:
        self.paths: dict[int, str] = {}

    def keep(self, df: DataFrame, tag: str) -> DataFrame:
        path = new_path(df.sparkSession, tag)
        df.write.parquet(path)
        out = df.sparkSession.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = path
        return out

    def drop(self, *frames: DataFrame) -> None:
        for df in frames:
            drop_path(df.sparkSession, self.paths.pop(id(df)))


def _among(rows: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys are in a written table of different keys: a small one is broadcast, else both are dealt out by key, where Spark splits what is hot."""
    return rows.join(F.broadcast(table) if table.count() <= MAX_BROADCAST_IDS else table, keys, "left_semi")


def _beside(texts: DataFrame, table: DataFrame, places: Column, how: str) -> DataFrame:
    """Texts with their row of a written table (doc_id, v, ...). It is broadcast if all its places fit; else texts that have none stay out of the shuffle as long as their ids fit."""
    named = table.withColumnsRenamed({"doc_id": "_doc", "v": "_v"})
    same = F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("v") == F.col("_v"))
    rows, n = table.agg(F.count("*"), F.sum(places)).first()
    if (n or 0) <= MAX_PLACES:
        return texts.join(F.broadcast(named), same, how).drop("_doc", "_v")
    if rows > MAX_BROADCAST_IDS:
        return texts.join(named, same, how).drop("_doc", "_v")
    ids = F.broadcast(named.select("_doc", "_v"))
    told = texts.join(ids, same, "left_semi").join(named, same).drop("_doc", "_v")
    return told if how == "inner" else told.unionByName(texts.join(ids, same, "left_anti"), allowMissingColumns=True)


def repeated_spans(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc_id, v, spans) of documents with bytes that a repeated string covers; spans are the bounds of maximal runs, ascending: from, to, from, to.

    v tells apart rows that share a doc_id: 32 bits of their text's hash.
    """
    if length < 32:
        raise ValueError("length must be at least 32")
    tables = _Tables()
    texts = small_batches(_rows(docs))
    one = tables.keep(texts.where(F.octet_length("raw") >= length).mapInArrow(partial(_sampled, length=length), SUFFIXES), "repeat-suffixes")
    often = tables.keep(one.groupBy("h").count().where("count > 1").select("h"), "repeat-buckets")
    members = tables.keep(_among(one, often, ["h"]), "repeat-members")
    tables.drop(one, often)
    parts = tables.keep(members.groupBy("h", "c").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "v", "pos", "before", "run")).alias("one")), "repeat-parts")
    mixed = tables.keep(parts.groupBy("h").agg(F.count("*").alias("k"), F.min("n").alias("least")).where("k > 1 and least = 1").select("h"), "repeat-mixed")
    asked = _among(parts, mixed, ["h"]).groupBy("one.doc_id", "one.v").agg(F.collect_list(F.struct("one.pos", "one.before", "one.run", "h", "n")).alias("places"))
    asked = tables.keep(asked, "repeat-asked")
    windows = tables.keep(_beside(texts, asked, F.size("places"), "inner").select("doc_id", "v", "raw", "places").mapInArrow(partial(_windows, length=length), WINDOWS), "repeat-windows")
    again = tables.keep(windows.groupBy("h", "w").agg(F.count("*").alias("k"), F.max("n").alias("n")).where("k > 1 or n > 1").select("h", "w"), "repeat-again")
    # rows by byte are dealt out alike at every size
    whole = _among(members, tables.keep(parts.where("n > 1").select("h", "c"), "repeat-whole"), ["h", "c"])
    begin = F.col("pos") - F.col("before")
    covered = whole.select("doc_id", "v", begin.alias("low"), (begin + F.col("run") - 1 + length).alias("high")).unionAll(windows.where("n = 1").join(again.hint("merge"), ["h", "w"], "left_semi").select("doc_id", "v", F.col("p").alias("low"), (F.col("p") + length).alias("high")))
    # a span begins where no earlier string reaches
    before = Window.partitionBy("doc_id", "v").orderBy("low", "high")
    reached = F.max("high").over(before.rowsBetween(Window.unboundedPreceding, -1))
    numbered = covered.withColumn("new", (reached.isNull() | (F.col("low") > reached)).cast("long")).withColumn("span", F.sum("new").over(before.rowsBetween(Window.unboundedPreceding, 0)))
    spans = numbered.groupBy("doc_id", "v", "span").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    found = spans.groupBy("doc_id", "v").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("low", "high"))), lambda s: F.array(s["low"], s["high"]))).alias("spans"))
    out = written(found, "repeat-spans")
    for path in tables.paths.values():
        drop_path(docs.sparkSession, path)
    return out


def _rows(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.hash(text).alias("v"), text.cast("binary").alias("raw"))


def without_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, spans and kept_sha256 of every document.

    Each byte goes that a string of ``length`` bytes covers which also begins anywhere else, in the same document or another; overlapping places count,
    and all is judged on the input. spans are the bounds of maximal removed runs; kept_sha256 is the digest of what is left. Null and missing texts are empty.
    Rows that repeat a doc_id are documents of their own, and equal rows are copies of each other; other columns are left out.
    """
    spans = repeated_spans(docs, length)
    return _beside(small_batches(_rows(docs)), spans, F.size("spans"), "left").select("doc_id", "raw", "spans").mapInArrow(_cut, CUT)
