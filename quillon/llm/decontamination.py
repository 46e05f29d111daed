"""Benchmark decontamination by the q-gram lemma.

A window starts at every character of a benchmark item. A text that has a window with at most k edits shares at least
w - q + 1 - k * q of its q-grams, all within k diagonals of each other. Shared q-grams are gathered in
diagonal bands that overlap by half, so one band holds them all; windows whose q-grams reach the bound in a band are verified
by a bit-parallel alignment inside the band, many at once. Windows are ranges of an item's q-grams, so the
index holds each q-gram's place in an item once.

Texts and items that repeat a q-gram many times meet in very many places. Places are looked at in blocks of a bounded
number of such meetings, which overlap by a window, and stretches that are alike are aligned once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import joined_by_id, small_batches, written

#: Length of q-grams and of windows, edits for each window, all in characters of the canonical text.
Q, WIDTH, EDITS = 8, 64, 4
#: Characters of benchmark text in one index (some 40 bytes each); a larger benchmark is searched in blocks of so many.
BLOCK_CHARS = 4_000_000
#: Characters of texts that are searched together.
BATCH_CHARS = 2_000_000
#: Windows that are aligned together (some 500 bytes each).
ALIGNED = 4096
#: Meetings of a q-gram's places that are laid out together (some 100 bytes each).
MEETINGS = 500_000
#: Places that the q-grams of a window in a text may span.
SPAN = WIDTH + 4 * EDITS
#: Codes that no canonical text has: past a window's end, past a text's end.
_NO_ITEM, _NO_TEXT = 1, 2
_FILTER_BITS = 22
_PLACES = 1 << 32
#: Multiplier of hashes of stretches, and its inverse modulo 2 ** 64.
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


@lru_cache(maxsize=1)
def _canonical_codes() -> np.ndarray:
    """For each code point: its lower case if that is one letter or digit, else a blank."""
    out = np.full(0x110000, 32, np.uint32)
    for c in range(0x110000):
        s = chr(c)
        if s.isalnum():
            low = s.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


def canonical(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the text in lower case with one blank for each run of anything but letters and digits, and their places in the text."""
    codes = _canonical_codes()[np.frombuffer(text.encode("utf-32-le", "replace"), "<u4")]
    blank = codes == 32
    keep = ~blank
    keep[1:] |= ~blank[:-1]
    at = np.flatnonzero(keep)
    return codes[at], at


def _hashes(codes: np.ndarray) -> np.ndarray:
    n = len(codes) - Q + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    h, wide = np.zeros(n, np.uint64), codes.astype(np.uint64)
    for i in range(Q):
        h = h * np.uint64(0x9E3779B97F4A7C15) + wide[i : i + n]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ h >> np.uint64(29)


@dataclass
class Window:
    item: int
    start: int
    codes: np.ndarray
    edits: int


class Index:
    """Some items, and where each q-gram stands in them."""

    def __init__(self, items: list[tuple[int, str]]):
        self.items, parts = [], []
        for item, text in items:
            codes, _ = canonical(text)
            while len(codes) and codes[0] == 32:
                codes = codes[1:]
            while len(codes) and codes[-1] == 32:
                codes = codes[:-1]
            if len(codes) < Q:
                continue
            self.items.append(item)
            parts.append(codes)
        self.size = np.array([len(c) for c in parts], np.int64)
        self.base = np.cumsum(self.size) - self.size
        self.width = np.minimum(self.size, WIDTH)
        self.edits = EDITS * self.width // WIDTH
        #: q-grams that a window shares at least with a text that has it.
        self.bound = self.width - Q + 1 - self.edits * Q
        self.codes = np.concatenate([*parts, np.full(WIDTH, _NO_ITEM, np.uint32)])
        grams = [_hashes(c) for c in parts]
        h = np.concatenate(grams) if grams else np.zeros(0, np.uint64)
        number = np.repeat(np.arange(len(grams)), [len(g) for g in grams])
        place = np.concatenate([np.arange(len(g)) for g in grams]) if grams else number
        order = np.argsort(h, kind="stable")
        self.gram, self.first, self.count = np.unique(h[order], return_index=True, return_counts=True)
        self.number, self.place = number[order], place[order]
        #: places in all items one after the other, beside the number of their q-gram: in ascending order
        where = self.base[self.number] + self.place if len(h) else place
        self.sorted = np.repeat(np.arange(len(self.gram)), self.count) * _PLACES + where
        self.filter = np.zeros(1 << _FILTER_BITS, bool)
        self.filter[(self.gram >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)] = True

    @property
    def windows(self) -> Iterator[Window]:
        """Some of the windows, one for each half of WIDTH and the last of each item, to look at; the search goes over all."""
        for n, item in enumerate(self.items):
            last = int(self.size[n] - self.width[n])
            for start in sorted({*range(0, last, WIDTH // 2), last}):
                at = int(self.base[n]) + start
                yield Window(item, start, self.codes[at : at + int(self.width[n])], int(self.edits[n]))

    def candidates(self, codes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Numbers of items, starts of windows in them and bands (lowest diagonal of the window) whose shared q-grams reach the bound; block by block, some more than once."""
        h = _hashes(codes)
        at = np.flatnonzero(self.filter[(h >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)])
        if not len(at) or not len(self.gram):
            return
        where = np.minimum(np.searchsorted(self.gram, h[at]), len(self.gram) - 1)
        same = self.gram[where] == h[at]
        at, where = at[same], where[same]
        todo = [(0, len(at), 0, int(self.base[-1] + self.size[-1]))]
        while todo:
            i, j, a, b = todo.pop()
            gram = where[i:j] * _PLACES
            first = np.searchsorted(self.sorted, gram + a)
            n = np.searchsorted(self.sorted, gram + b) - first
            total = int(n.sum())
            if not total:
                continue
            if total > MEETINGS:
                if at[j - 1] - at[i] > 4 * SPAN:  # two parts of the text that overlap by a window
                    middle = int(at[i] + at[j - 1]) // 2
                    todo += [(i, int(np.searchsorted(at, middle + SPAN)), a, b), (int(np.searchsorted(at, middle)), j, a, b)]
                    continue
                if b - a > 4 * WIDTH:  # two parts of the items
                    todo += [(i, j, a, (a + b) // 2 + WIDTH), (i, j, (a + b) // 2, b)]
                    continue
            yield self._bands(at[i:j], first, n)

    def _bands(self, at: np.ndarray, first: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        entry = np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())
        item, place = self.number[entry], self.place[entry]
        half, lowest = EDITS + 1, int(self.size.max())
        band = (np.repeat(at, n) - place + lowest) // half  # a band is two halves; each diagonal lies in two bands
        key = np.concatenate([item, item]) * (1 << 40) + np.concatenate([band, band - 1]) + 1
        place = np.concatenate([place, place])
        order = np.lexsort((place, key))
        key, place = key[order], place[order]
        item = key >> 40
        # the bound-th next q-gram of the band must stand in the same window
        last = np.arange(len(key)) + self.bound[item] - 1
        ends = np.minimum(last, len(key) - 1)
        good = np.flatnonzero((last < len(key)) & (key[ends] == key) & (place[ends] - place <= self.width[item] - Q))
        item, key, ends = item[good], key[good], ends[good]
        low = np.maximum(place[ends] - self.width[item] + Q, 0)
        high = np.minimum(place[good], self.size[item] - self.width[item])
        # ranges of starts grow with the place; what the range before has is not told again
        low[1:] = np.where(key[1:] == key[:-1], np.maximum(low[1:], high[:-1] + 1), low[1:])
        n = np.maximum(high - low + 1, 0)
        start = np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())
        return np.repeat(item, n), start, np.repeat(((key & ((1 << 40) - 1)) - 1) * half - lowest, n) + start


class Stretches:
    """Hashes of any stretch of codes."""

    def __init__(self, codes: np.ndarray):
        with np.errstate(over="ignore"):
            power = np.full(len(codes) + 1, _BASE, np.uint64)
            power[0] = 1
            back = np.full(len(codes) + 1, _INVERSE, np.uint64)
            back[0] = 1
            power, self.back = np.cumprod(power), np.cumprod(back)
            self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * power[:-1])])

    def of(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        h = (self.sums[stop] - self.sums[start]) * self.back[start] + (stop - start).astype(np.uint64)
        h = (h ^ h >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
        return h ^ h >> np.uint64(31)


def _aligned(windows: np.ndarray, sizes: np.ndarray, texts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each row of windows: the fewest edits that turn it into a stretch of its row of texts, and where the first such stretch ends."""
    one = np.uint64(1)
    top = sizes.astype(np.uint64) - one
    full = np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(63) - top)
    vp, vn = full.copy(), np.zeros(len(full), np.uint64)
    score = sizes.astype(np.int64)
    best, end = score.copy(), np.zeros(len(score), np.int64)
    for j in range(texts.shape[1]):
        same = np.packbits(windows == texts[:, j, None], axis=1, bitorder="little").view(np.uint64)[:, 0]
        x = same | vn
        d0 = ((vp + (x & vp)) ^ vp) | x
        hn, hp = vp & d0, vn | full & ~(vp | d0)
        score += (hp >> top & one).astype(np.int64) - (hn >> top & one).astype(np.int64)
        hp, hn = hp << one & full, hn << one & full  # a stretch may begin anywhere
        vn = hp & d0
        vp = hn | full & ~(hp | d0)
        less = (score < best) & (j < lengths)
        best[less], end[less] = score[less], j + 1
    return best, end


def aligned(window: np.ndarray, codes: np.ndarray, edits: int) -> tuple[int, int] | None:
    """Fewest edits that turn a window of up to 64 codes into a stretch of the codes, and where the first such stretch ends; None beyond ``edits``."""
    wide = np.full((1, 64), -1, np.int64)
    wide[0, : len(window)] = window
    best, end = _aligned(wide, np.array([len(window)]), np.asarray(codes, np.int64)[None, :], np.array([len(codes)]))
    return (int(best[0]), int(end[0])) if best[0] <= edits else None


def find(index: Index, texts: list[str]) -> list[tuple[int, int, int, int, int, int]]:
    """(text number, item, start, end, windows, fewest edits) of each item that a text has passages of; places are the text's own."""
    parts, places, starts, total = [], [], [], 0
    for text in texts:
        codes, at = canonical(text)
        starts.append(total)
        parts += [codes, np.zeros(1, np.uint32)]  # no q-gram with a zero is in an index
        places += [at, np.zeros(1, at.dtype)]
        total += len(codes) + 1
    codes = np.concatenate(parts) if parts else np.zeros(0, np.uint32)
    begin = np.array([*starts, total], np.int64)
    spots: np.ndarray | None = None
    stretches: tuple[Stretches, Stretches] | None = None
    #: of each text and item: places around all windows, fewest edits, and the windows' starts
    hits: dict[tuple[int, int], list] = {}
    for found in index.candidates(codes):
        if not len(found[0]):
            continue
        if spots is None or stretches is None:
            spots, stretches = np.concatenate(places), (Stretches(index.codes), Stretches(codes))
        t, item, start, end, best = _aligned_candidates(index, codes, begin, stretches, *found)
        if not len(t):
            continue
        order = np.lexsort((start, item, t))
        t, item, start, end, best = t[order], item[order], start[order], end[order], best[order]
        first = np.flatnonzero(np.r_[True, (t[1:] != t[:-1]) | (item[1:] != item[:-1])])
        left = np.minimum.reduceat(spots[np.maximum(end - index.width[item], begin[t])], first)
        right = np.maximum.reduceat(spots[end - 1], first) + 1
        fewest = np.minimum.reduceat(best, first)
        for n, (a, b) in enumerate(zip(first.tolist(), [*first[1:].tolist(), len(t)], strict=True)):
            key = int(t[a]), index.items[int(item[a])]  # items that repeat an id are one item
            own = index.base[item[a]] + np.unique(start[a:b])
            old = hits.get(key)
            hits[key] = [min(old[0], left[n]), max(old[1], right[n]), np.union1d(old[2], own), min(old[3], fewest[n])] if old else [left[n], right[n], own, fewest[n]]
    return [(*k, int(a), int(b), len(own), int(e)) for k, (a, b, own, e) in sorted(hits.items())]


def _aligned_candidates(index: Index, codes: np.ndarray, begin: np.ndarray, stretches: tuple[Stretches, Stretches], item: np.ndarray, start: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, ...]:
    """Text number, item, start, end and edits of those candidates that are within their edits."""
    total, width = len(codes), index.width[item]
    # the band may reach over a text's edge, so both texts there are tried
    told: list[tuple[np.ndarray, np.ndarray]] = []
    for x in (low, low + EDITS + width // 2, low + 2 * EDITS + width):
        t = np.searchsorted(begin, np.clip(x, 0, total - 1), "right") - 1
        fresh = np.ones(len(t), bool)
        for _, other in told:
            fresh &= other != t
        told.append((fresh, t))
    which = np.concatenate([np.flatnonzero(fresh) for fresh, _ in told])
    t = np.concatenate([t[fresh] for fresh, t in told])
    item, start, low, width = item[which], start[which], low[which], width[which]
    a = np.maximum(low - EDITS, begin[t])
    b = np.minimum(low + 3 * EDITS + 2 + width, begin[t + 1] - 1)
    some = np.flatnonzero(b > a)
    t, item, start, width, a, b = (x[some] for x in (t, item, start, width, a, b))
    # stretches that are alike have one alignment
    window_at = index.base[item] + start
    alike = stretches[0].of(window_at, window_at + width) * np.uint64(_BASE) + stretches[1].of(a, b)
    _, one, back = np.unique(alike, return_index=True, return_inverse=True)
    best, end = np.zeros(len(one), np.int64), np.zeros(len(one), np.int64)
    step, along = np.arange(WIDTH), np.arange(WIDTH + 4 * EDITS + 2)
    for n in range(0, len(one), ALIGNED):
        own = one[n : n + ALIGNED]
        window = np.where(step < width[own, None], index.codes[window_at[own, None] + step], np.uint32(_NO_ITEM))
        spot = a[own, None] + along
        text = np.where(spot < b[own, None], codes[np.minimum(spot, total - 1)], np.uint32(_NO_TEXT))
        best[n : n + ALIGNED], end[n : n + ALIGNED] = _aligned(window, width[own], text, b[own] - a[own])
    best, end = best[back], a + end[back]
    good = best <= index.edits[item]
    return t[good], item[good], start[good], end[good], best[good]


def _search(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
            out: list[tuple] = []
            at = 0
            while at < len(texts):
                stop, size = at, 0
                while stop < len(texts) and (stop == at or size + len(texts[stop]) <= BATCH_CHARS):
                    size += len(texts[stop])
                    stop += 1
                out += [(ids[at + t], *rest) for t, *rest in find(index, texts[at:stop])]
                at = stop
            columns = [list(x) for x in zip(*out, strict=True)] or [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "item_id", "start", "end", "windows", "edits"])

    return run


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, start, end, windows, edits: each item of which a text has at least one window with at most its edits.

    start and end are places (code points) in the text around all matched windows of the item, windows the number of the item's windows found, edits the fewest of
    one. Case, punctuation and white space make no difference. An item shorter than WIDTH is one window with edits
    in proportion; one under Q canonical characters is no evidence and never matches, nor do null or empty texts. Items without
    an id are left out; items that repeat an id count as one item; repeated documents are found each. The
    benchmark is broadcast in blocks of BLOCK_CHARS; documents never move.
    """
    spark = docs.sparkSession
    items = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = -(-total // BLOCK_CHARS) or 1
    asked = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = []
    for n in range(blocks):
        own = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == n)
        index = Index(sorted((r["item_id"], r["text"]) for r in own.collect()))  # about BLOCK_CHARS characters
        shared = spark.sparkContext.broadcast(index)
        out.append(asked.mapInArrow(_search(shared), "doc_id long, item_id long, start long, end long, windows long, edits long"))
    return reduce(DataFrame.unionAll, out)


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Documents without a passage of the benchmark, with all their columns; see leaks(). Rows without a doc_id are looked at by their text alone."""
    found = written(leaks(docs.where("doc_id is not null"), benchmark).select("doc_id").distinct(), "leaks")
    kept = joined_by_id(docs, found, "left_anti")
    nameless = docs.where("doc_id is null")
    if nameless.isEmpty():
        return kept
    own = nameless.withColumn("doc_id", F.monotonically_increasing_id())
    own = written(own, "nameless")
    bad = written(leaks(own, benchmark).select("doc_id").distinct(), "leaks")
    clean = joined_by_id(own, bad, "left_anti").withColumn("doc_id", F.lit(None).cast(docs.schema["doc_id"].dataType))
    return kept.where("doc_id is not null").unionByName(clean.select(*docs.columns))
