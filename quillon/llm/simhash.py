"""SimHash near-duplicates by multi-index hashing.

A document's fingerprint has a bit for each hash bit that more than half of its word shingles set.
Fingerprints are cut into segments; for each segment small Hamming balls are enumerated
around its value, one on the side of the table and one on the side of the query, and rows that
meet are verified by their complete distance. If the two radii of segment i add up to r_i and the
sum of (r_i + 1) exceeds the distance asked for, no link can be missed.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import MAX_BROADCAST_IDS, WORD, connected, joined_by_id, small_batches, written

_WORDS = re.compile(WORD)
_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
SEED = 42


@dataclass(frozen=True)
class Segment:
    """Bits ``start`` to ``start + width`` of 64-bit word ``word``; radii of the balls in the table and around a query."""

    word: int
    start: int
    width: int
    table_radius: int
    query_radius: int


#: 64 bits in two halves: (1 + 1) + 1 and (0 + 1) + 1 make 5, over a distance of 4.
HALVES = (Segment(0, 32, 32, 1, 1), Segment(0, 0, 32, 0, 1))

#: Eight segments of 21 bits, two in each of four words. Of texts whose five-word shingles have a Jaccard similarity of 0.8, some 15 % of
#: the bits differ; a segment then has at most two differing bits, as its two balls allow, with probability 0.36, one of eight with
#: 0.97; 49 of 256 bits or fewer differ with 0.97. Unrelated texts differ in half of the bits, nine standard deviations away.
WIDE = tuple(Segment(i // 2, 21 * (i % 2), 21, 1, 1) for i in range(8))
WIDE_LONGS, WIDE_WORDS, WIDE_DISTANCE = 4, 5, 49
#: Buckets up to this size are compared at all places at once, larger ones from row to row.
LAGS = 32
#: Rows of a bucket that one task compares; a larger bucket is cut into blocks of about so many, and each two blocks meet in a task.
BLOCK = 4096

#: Bits of each byte, to count bits from counts of bytes.
_BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.float64)
_BYTE_AT = 256 * np.arange(8, dtype=np.uint16)


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """XXH64 (seed 42) of each word shingle of the text with A-Z in lower case; of the whole sequence if it is shorter."""
    found = _WORDS.findall(text.translate(_LOWER)) if text else []
    if not found:
        return np.zeros(0, np.uint64)
    joined = " ".join(found).encode()
    if len(found) <= words:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    ends = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32).tolist()
    starts = [0, *(e + 1 for e in ends)]
    ends.append(len(joined))
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, ends[words - 1 :], strict=False)), np.uint64, len(found) - words + 1)


def _mixed(h: np.ndarray, n: int) -> np.ndarray:
    """The n-th independent word of a hash; the hash itself for n = 0."""
    if not n:
        return h
    x = h + np.uint64(n * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def fingerprint(text: str | None, words: int = 4, longs: int = 1) -> list[int]:
    """Unsigned 64-bit words of the fingerprint; zero if the text has no word."""
    h = shingle_hashes(text, words)
    out = []
    for n in range(longs):
        x, seen = _mixed(h, n), np.zeros(8 * 256, np.int64)
        for at in range(0, len(x), 1 << 14):  # bounded memory however long the text
            seen += np.bincount((x[at : at + (1 << 14)].view(np.uint8).reshape(-1, 8) + _BYTE_AT).ravel(), minlength=8 * 256)
        ones = seen.reshape(8, 256) @ _BYTE_BITS  # whole numbers far below 2 ** 53
        out.append(int.from_bytes(np.packbits((2 * ones > len(x)).ravel(), bitorder="little").tobytes(), "little"))
    return out


def fingerprints(docs: DataFrame, words: int = 4, longs: int = 1) -> DataFrame:
    """doc_id and the columns f0, f1, ... of every document."""
    names = [f"f{i}" for i in range(longs)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [fingerprint(t.as_py(), words, longs) for t in batch.column(1)]
            cols = np.array(rows, np.uint64).reshape(-1, longs).view(np.int64).T
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(np.ascontiguousarray(c)) for c in cols)], names=["doc_id", *names])

    narrow = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return narrow.mapInArrow(run, ", ".join(["doc_id long", *(f"{n} long" for n in names)]))


def _ball(width: int, radius: int) -> list[int]:
    """Masks of up to ``radius`` bits."""
    out = [0]
    last = [(0, -1)]
    for _ in range(radius):
        last = [(mask | 1 << b, b) for mask, top in last for b in range(top + 1, width)]
        out += [mask for mask, _ in last]
    return out


def _keys(prints: DataFrame, segments: tuple[Segment, ...], side: str) -> DataFrame:
    rows: list[DataFrame] = []
    for n, s in enumerate(segments):
        value: Column = F.shiftrightunsigned(F.col(f"f{s.word}"), s.start).bitwiseAND(F.lit((1 << s.width) - 1).cast("long"))
        tagged = value.bitwiseOR(F.lit(n << 48).cast("long"))
        masks = F.array(*[F.lit(m).cast("long") for m in _ball(s.width, getattr(s, f"{side}_radius"))])
        rows.append(prints.select("*", F.explode(masks).alias("mask")).withColumn("key", tagged.bitwiseXOR(F.col("mask"))).drop("mask"))
    return reduce(DataFrame.unionAll, rows)


def links(prints: DataFrame, segments: tuple[Segment, ...], distance: int) -> DataFrame:
    """(u, v) of different fingerprints within the distance; ``prints`` has node and f0 with a row for each fingerprint."""
    table = _keys(prints.select("node", "f0"), segments, "table").select("key", F.col("node").alias("t_node"), F.col("f0").alias("t_f0"))
    query = _keys(prints.select("node", "f0"), segments, "query")
    apart = F.bit_count(F.col("f0").bitwiseXOR(F.col("t_f0")))
    met = query.join(table, (query.key == table.key) & (F.col("node") < F.col("t_node")) & (apart <= distance))
    return met.select(F.col("node").alias("u"), F.col("t_node").alias("v")).distinct()


def _spanning(keys: np.ndarray, words: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of linked rows in each bucket of sorted keys, so few that they still connect what all its links connect."""
    near = lambda i, j: np.bitwise_count(words[:, i] ^ words[:, j]).sum(0, dtype=np.int64) <= distance
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    sizes = np.diff(np.r_[starts, len(keys)])
    left, right = [], []
    small = np.repeat(sizes <= LAGS, sizes)
    place = np.arange(len(keys)) - np.repeat(starts, sizes)
    nearest = np.full(len(keys), -1)
    for lag in range(1, LAGS):
        at = np.flatnonzero(small & (place >= lag))
        if not len(at):
            break
        at = at[near(at, at - lag)]
        known = nearest[at] >= 0
        # a row that is linked to a nearer one needs no second link to what that one is linked to
        again = at[known]
        again = again[~near(again - lag, nearest[again])]
        new = at[~known]
        nearest[new] = new - lag
        for x in (new, again):
            left.append(x - lag)
            right.append(x)
    for start, size in zip(starts[sizes > LAGS].tolist(), sizes[sizes > LAGS].tolist(), strict=True):
        rest = np.arange(start, start + size)
        todo: list[int] = []
        while len(rest):
            if not todo:
                todo, rest = [int(rest[0])], rest[1:]
            at = todo.pop()
            on = near(np.full(len(rest), at), rest)
            found, rest = rest[on], rest[~on]
            left.append(np.full(len(found), at))
            right.append(found)
            todo += found.tolist()
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *left]), np.concatenate([none, *right])


def _bucket_links(longs: int, distance: int, limit: int | None):
    """Links of sorted buckets; of a bucket of more than ``limit`` rows, which is never held, its key and size."""
    names = [f"{side}{i}" for side in "fg" for i in range(longs)]

    def batch_of(words: np.ndarray, key: list[int | None], size: list[int | None]) -> pa.RecordBatch:
        none = pa.nulls(len(key), pa.int64())
        columns = [pa.array(np.ascontiguousarray(c)) for c in words.view(np.int64)] if len(words) else [none] * len(names)
        return pa.RecordBatch.from_arrays([*columns, pa.array(key, pa.int64()), pa.array(size, pa.int64())], names=[*names, "key", "size"])

    def edges(keys: np.ndarray, words: np.ndarray) -> pa.RecordBatch:
        a, b = _spanning(keys, words, distance)
        return batch_of(np.concatenate([words[:, a], words[:, b]]), [None] * len(a), [None] * len(a))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, words = np.zeros(0, np.int64), np.zeros((longs, 0), np.uint64)
        crowd: list[int] = []  # key and rows so far of a crowded bucket that may go on

        def done(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal keys, words, crowd
            starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
            sizes = np.diff(np.r_[starts, len(keys)])
            if limit:
                large = sizes > limit
                told = [(int(keys[s]), int(n)) for s, n in zip(starts[large], sizes[large], strict=True)]
                if told and large[-1] and not last:
                    crowd = list(told.pop())
                if told:
                    yield batch_of(np.zeros((0, 0), np.uint64), *(list(x) for x in zip(*told, strict=True)))
                small = np.repeat(~large, sizes)
                keys, words = keys[small], words[:, small]
                starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
            whole = len(keys) if last or crowd or not len(starts) else int(starts[-1])  # the last bucket may go on
            if whole:
                yield edges(keys[:whole], words[:, :whole])
            keys, words = keys[whole:], words[:, whole:]

        held_keys, held_words, held = [], [], 0
        for batch in batches:
            k = batch.column(0).to_numpy()
            w = np.stack([batch.column(i + 1).to_numpy().view(np.uint64) for i in range(longs)])
            if crowd and len(k):
                more = int(np.searchsorted(k, crowd[0], "right"))
                crowd[1] += more
                k, w = k[more:], w[:, more:]
                if not len(k):
                    continue
                yield batch_of(np.zeros((0, 0), np.uint64), [crowd[0]], [crowd[1]])
                crowd = []
            held_keys.append(k)
            held_words.append(w)
            held += len(k)
            if held >= 20_000:
                keys, words = np.concatenate([keys, *held_keys]), np.concatenate([words, *held_words], axis=1)
                held_keys, held_words, held = [], [], 0
                yield from done(False)
        keys, words = np.concatenate([keys, *held_keys]), np.concatenate([words, *held_words], axis=1)
        yield from done(True)
        if crowd:
            yield batch_of(np.zeros((0, 0), np.uint64), [crowd[0]], [crowd[1]])

    return run, ", ".join(f"{n} long" for n in [*names, "key", "size"])


def spanning_links(prints: DataFrame, segments: tuple[Segment, ...], distance: int) -> DataFrame:
    """(u, v) of fingerprints within the distance that share a bucket: enough of them to connect all such.

    Rows carry the complete fingerprint, so distances are verified where buckets stand; either side has the larger of a segment's two balls.
    A dense group gives a link or so for each row, not all its pairs. No task holds a bucket of over BLOCK rows: those are cut into blocks,
    and each two blocks of a bucket are compared by a task of their own.
    """
    names = [c for c in prints.columns if c != "node"]
    both = tuple(Segment(s.word, s.start, s.width, max(s.table_radius, s.query_radius), max(s.table_radius, s.query_radius)) for s in segments)
    keyed = _keys(prints.select(*names), both, "table").select("key", *names)
    node = lambda side: F.col(f"{side}0") if len(names) == 1 else F.xxhash64(*[f"{side}{i}" for i in range(len(names))])
    ends = [node("f").alias("u"), node("g").alias("v")]

    def met(rows: DataFrame, limit: int | None) -> DataFrame:
        run, schema = _bucket_links(len(names), distance, limit)
        return rows.repartition("key").sortWithinPartitions("key").mapInArrow(run, schema)

    found = written(met(keyed, BLOCK).select(*ends, "key", "size").distinct(), "bucket-links")
    links, crowded = found.where("key is null").select("u", "v"), found.where("key is not null").select("key", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks"))
    n = crowded.count()
    if not n:
        return links
    own = F.pmod(F.xxhash64(*names), F.col("blocks")).cast("int")
    told = keyed.join(F.broadcast(crowded) if n <= MAX_BROADCAST_IDS // 2 else crowded, "key").withColumn("own", own)
    other = told.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    blocks = other.select(F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("key"), *names)
    return links.unionByName(met(blocks, None).select(*ends)).distinct()


def near_duplicates(docs: DataFrame, words: int = 4, longs: int = 1, segments: tuple[Segment, ...] = HALVES, distance: int = 4) -> DataFrame:
    """doc_id, f0, ... and component_id (smallest doc_id that links reach) of every document.

    Null and empty texts have the fingerprint zero and link like any other. Equal fingerprints are brought together before the
    search, so copies never meet as pairs. Rows that repeat a doc_id stay; rows without one have a
    component only through others. Other columns are left out; an empty table gives no row.
    """
    if sum(s.table_radius + s.query_radius + 1 for s in segments) <= distance and longs == 1:
        raise ValueError("these segments can miss links")
    names = [f"f{i}" for i in range(longs)]
    found = written(fingerprints(docs, words, longs), "fingerprints")
    different = found.groupBy(*names).agg(F.min("doc_id").alias("first_doc"))
    node = F.col("f0") if longs == 1 else F.xxhash64(*names)
    nodes = written(different.withColumn("node", node), "fingerprint-nodes")
    roots = connected(spanning_links(nodes.select("node", *names), segments, distance), "fingerprint-links")
    first = roots.join(nodes.select("node", "first_doc"), "node").groupBy("root").agg(F.min("first_doc").alias("component_id"))
    linked = roots.join(first, "root").select("node", "component_id")
    own = nodes.join(linked, "node", "left").select(*names, F.coalesce("component_id", "first_doc").alias("component_id"))
    return found.join(own, names).select("doc_id", *names, "component_id")


def one_of_each(docs: DataFrame, words: int = WIDE_WORDS, longs: int = WIDE_LONGS, segments: tuple[Segment, ...] = WIDE, distance: int = WIDE_DISTANCE) -> DataFrame:
    """One document of each group of near duplicates, that with the smallest doc_id, with all its columns.

    Of rows that repeat a doc_id one stays. Rows without a doc_id stay as they are. All texts without a word are one
    group. Only the ids of documents that go are joined to the texts.
    """
    found = near_duplicates(docs.where("doc_id is not null"), words, longs, segments, distance)
    gone = written(found.where("doc_id != component_id").select("doc_id").distinct(), "near-duplicates")
    kept = joined_by_id(docs, gone, "left_anti")
    repeated = written(docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"), "repeated-ids")
    if repeated.isEmpty():
        return kept
    return joined_by_id(kept, repeated, "left_anti").unionByName(joined_by_id(kept, repeated, "left_semi").dropDuplicates(["doc_id"]))
