"""Quality rules: base counts, then robust multivariate outliers.

Each text gives a vector of transformed statistics. For every (language, source), every language and all rows
a minimum-covariance-determinant estimate is made over all rows: the mean and covariance of the share H of rows whose covariance has the smallest
determinant. Four starts for each cell take two concentration steps (keep the share H of rows nearest by Mahalanobis
distance, estimate anew), none of which raises the determinant; the start with the smallest one goes on until it hardly falls. Covariances have
a floor added, which leaves this true. A row is judged by the narrowest of the three estimates that rests on enough rows.

Statistics are whole thousandths, so sums are exact and results do not depend on how rows are dealt out.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import reduce
from itertools import combinations_with_replacement

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, small_batches, written

_WORDS = re.compile(WORD)
SYMBOLS = "#*$%&|<>"
WINDOW = 8
STATS = ("length", "word_size", "symbols", "dup_lines", "repeats", "capitals")
P = len(STATS)
#: Thousandths below which a statistic's spread is not believed: constant statistics would make any change an outlier.
FLOOR = (1500, 80, 100, 100, 100, 80)
#: Words, of so many characters each, and lines that every text is taken to have besides: few words say little about a text.
EXTRA_WORDS, EXTRA_SIZE, EXTRA_LINES = 50, 5.0, 5
#: Share of rows that an estimate rests on, and steps of each start. The best one goes on until a step lowers its determinant by under a TOLERANCE-th part.
H, FIRST_STEPS, TOLERANCE = 0.75, 2, 1e-3
#: Rows that a (language, source), a language or the table must have for an estimate of its own, which has 27 numbers. A smaller cell is
#: judged by the next wider one; a table with fewer rows has no estimate.
MIN_ROWS = 200
#: Chi-squared quantiles for six statistics: 0.5, which sets the scale, and 0.999999, beyond which a row is rejected.
CHI2_MEDIAN, CHI2_CUT = 5.348, 38.258
#: Estimates that may be broadcast (some 400 bytes each); beyond it they are joined, salted.
MAX_BROADCAST, SALTS = 20_000, 64

_UPPER = np.array([chr(c).isupper() for c in range(0x110000)])
_MULTIPLIERS = np.array([pow(0x9E3779B97F4A7C15, j + 1, 1 << 64) for j in range(WINDOW)], np.uint64)


def repeated_words(words: list[str]) -> int:
    """Words in 8-word windows that occur twice or more in the list."""
    if len(words) <= WINDOW:
        return 0
    number: dict[str, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.uint64, len(words))
    if len(number) == len(words):
        return 0
    ids = (ids + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    ids ^= ids >> np.uint64(32)
    n = len(words) - WINDOW + 1
    keys = np.zeros(n, np.uint64)
    for j, m in enumerate(_MULTIPLIERS):
        keys += ids[j : j + n] * m
    _, back, counts = np.unique(keys, return_inverse=True, return_counts=True)
    again = counts[back] > 1
    if not again.any():
        return 0
    edge = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(again)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + WINDOW, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def counts(text: str | None) -> tuple:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and the transformed statistics of a text."""
    text = text or ""
    words = _WORDS.findall(text)
    n, chars = len(words), sum(map(len, words))
    symbols = sum(map(text.count, SYMBOLS))
    lines = text.split("\n")
    dup = 0
    if len(set(lines)) < len(lines):
        seen: set[str] = set()
        for line in lines:
            if line in seen:
                dup += bool(_WORDS.search(line))
            seen.add(line)
    again = repeated_words(words)
    codes = np.frombuffer(text.encode(), np.uint8) if text.isascii() else np.frombuffer(text.encode("utf-32-le", "replace"), "<u4")
    capitals = int(_UPPER[codes].sum())
    more, size = n + EXTRA_WORDS, chars + EXTRA_WORDS * EXTRA_SIZE
    stats = (math.log(more), math.log(size / more), math.sqrt(symbols / more), dup / (len(lines) + EXTRA_LINES), again / more, capitals / size)
    return (n, chars, symbols, dup, again, *(round(1000 * x) for x in stats))


BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        cols = np.array([counts(t.as_py()) for t in batch.column(3)], np.int64).reshape(len(batch), -1).T
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), *(pa.array(np.ascontiguousarray(c)) for c in cols)], names=["doc_id", "lang", "source", *BASE, *STATS])


def _near(rows: DataFrame, estimates: DataFrame, few: bool) -> DataFrame:
    """Rows with the estimate of their key beside them: broadcast if there are few, else joined by key and salt."""
    if few:
        return rows.join(F.broadcast(estimates), "key", "left")
    salted = estimates.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", F.pmod(F.xxhash64(*STATS), F.lit(SALTS)).cast("int")).join(salted, ["key", "salt"], "left").drop("salt")


def _distance() -> Column:
    """Squared Mahalanobis distance from mean and inverse; null without an estimate."""
    off = [F.col(s) - F.col("mean")[i] for i, s in enumerate(STATS)]
    total = F.lit(0.0)
    for n, (i, j) in enumerate(combinations_with_replacement(range(P), 2)):
        total = total + (1 if i == j else 2) * F.col("inverse")[n] * off[i] * off[j]
    return total


PAIRS = list(combinations_with_replacement(range(P), 2))
#: The four starts: medians and their deviations; all rows; statistics squashed by the hyperbolic tangent; statistics clipped at two deviations.
STARTS = ("median", "all", "tanh", "clipped")


def _told(key: str, start: int, mean: np.ndarray, cov: np.ndarray) -> tuple:
    """A row of an estimate; ``cov`` without its floor."""
    full = cov + np.diag(np.square(np.array(FLOOR, float)))
    inverse = np.linalg.inv(full)
    return key, start, mean.round(6).tolist(), [float(f"{inverse[i, j]:.9e}") for i, j in PAIRS], round(float(np.linalg.slogdet(full)[1]), 9)


ESTIMATE = "key string, start int, mean array<double>, inverse array<double>, logdet double"


def _moments(row, prefix: str = "s") -> tuple[np.ndarray, np.ndarray]:
    """Mean and covariance from exact sums."""
    n = float(row.n)
    mean = np.array([getattr(row, f"{prefix}{i}") for i in range(P)], float) / n
    cov = np.zeros((P, P))
    for i, j in PAIRS:
        cov[i, j] = cov[j, i] = float(getattr(row, f"{prefix}{i}_{j}")) / n - mean[i] * mean[j]
    return mean, cov


def _estimated(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in batches:
        yield pd.DataFrame([_told(row.key, row.start, *_moments(row)) for row in frame.itertuples(index=False)], columns=["key", "start", "mean", "inverse", "logdet"])


def _started(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in batches:
        out = []
        for row in frame.itertuples(index=False):
            middle = np.array([getattr(row, f"m{i}") for i in range(P)], float)
            scale = np.array([getattr(row, f"d{i}") for i in range(P)], float)
            out += [_told(row.key, 0, middle, np.diag(scale**2)), _told(row.key, 1, *_moments(row))]
            for start, prefix in ((2, "t"), (3, "c")):
                mean, cov = _moments(row, prefix)
                spread = np.sqrt(np.maximum(np.diag(cov), 1e-12))
                out.append(_told(row.key, start, middle + mean / 1000 * scale, cov / np.outer(spread, spread) * np.outer(scale, scale)))
        yield pd.DataFrame(out, columns=["key", "start", "mean", "inverse", "logdet"])


def _sums(columns: list[Column], prefix: str) -> list[Column]:
    return [*[F.sum(c).alias(f"{prefix}{i}") for i, c in enumerate(columns)], *[F.sum(columns[i] * columns[j]).alias(f"{prefix}{i}_{j}") for i, j in PAIRS]]


def _bin() -> Column:
    """Distances in steps of a thousandth of their logarithm: few enough values for exact quantiles."""
    return F.floor(F.log1p(F.greatest(_distance(), F.lit(0.0))) * 1000).cast("int")


def _beside(rows: DataFrame, table: DataFrame, few: bool, by: list[str]) -> DataFrame:
    return rows.join(F.broadcast(table) if few else table, by)


def _starts(rows: DataFrame, few: bool) -> DataFrame:
    """The estimates that each cell starts from."""
    middle = rows.groupBy("key").agg(*[(10 * F.percentile((F.col(s) / 10).cast("int"), F.lit(0.5))).alias(f"m{i}") for i, s in enumerate(STATS)])
    off = _beside(rows, middle, few, ["key"]).groupBy("key").agg(*[(14.826 * F.percentile(F.abs(F.col(s) - F.col(f"m{i}")).cast("int") / 10, F.lit(0.5))).alias(f"d{i}") for i, s in enumerate(STATS)])
    base = written(middle.join(off, "key"), "mcd-middles")
    beside = _beside(rows, base, few, ["key"])
    z = [(F.col(s) - F.col(f"m{i}")) / F.sqrt(F.col(f"d{i}") * F.col(f"d{i}") + FLOOR[i] ** 2) for i, s in enumerate(STATS)]
    whole = lambda c: F.round(1000 * c).cast("long")
    sums = [F.count("*").alias("n"), *_sums([F.col(s) for s in STATS], "s"), *_sums([whole(F.tanh(c)) for c in z], "t"), *_sums([whole(F.greatest(F.lit(-2.0), F.least(F.lit(2.0), c))) for c in z], "c")]
    return beside.groupBy("key").agg(*sums).join(base, "key").mapInPandas(_started, ESTIMATE)


def _step(rows: DataFrame, now: DataFrame, few: bool) -> DataFrame:
    """A concentration step of every (cell, start): estimates from the share H of rows that are nearest by the present ones. Rows that tie at the limit all count."""
    near = _beside(rows, now, few, ["key"]).select("key", "start", *STATS, _bin().alias("bin"))
    limit = near.groupBy("key", "start").agg(F.percentile("bin", F.lit(H)).alias("limit"))
    kept = _beside(near, limit, few, ["key", "start"]).where("bin <= limit")
    return kept.groupBy("key", "start").agg(F.count("*").alias("n"), *_sums([F.col(s) for s in STATS], "s")).mapInPandas(_estimated, ESTIMATE)


def robust_estimates(rows: DataFrame, few: bool) -> DataFrame:
    """key, mean, inverse, logdet, scale of each key; ``rows`` has key and the statistics."""
    rows = written(rows.select("key", *STATS), "mcd-rows")
    now = written(_starts(rows, few), "mcd")
    for _ in range(FIRST_STEPS):
        now = written(_step(rows, now, few), "mcd")
    best = now.groupBy("key").agg(F.min_by(F.struct("start", "mean", "inverse", "logdet"), F.struct("logdet", "start")).alias("best"))
    moving = written(best.select("key", "best.*"), "mcd")
    done = []
    while not moving.isEmpty():
        # a step never raises the determinant, and each step that counts lowers it by TOLERANCE: the loop ends
        after = _step(rows, moving, few).join(moving.select("key", F.col("logdet").alias("before")), "key")
        after = written(after.withColumn("fell", F.col("before") - F.col("logdet")), "mcd")
        done.append(after.where(F.col("fell") < TOLERANCE).select("key", "start", "mean", "inverse", "logdet"))
        moving = after.where(F.col("fell") >= TOLERANCE).select("key", "start", "mean", "inverse", "logdet")
    now = written(reduce(DataFrame.unionAll, done, best.select("key", "best.*").limit(0)), "mcd")
    near = _near(rows, now, few).select("key", _bin().alias("bin"))
    scale = near.groupBy("key").agg((F.expm1((F.percentile("bin", F.lit(0.5)) + 0.5) / 1000) / CHI2_MEDIAN).alias("scale"))
    return written(now.join(scale, "key").select("key", "mean", "inverse", "logdet", "scale"), "mcd")


def _key(level: int) -> Column:
    parts = [F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("null")) for c in ("lang", "source")[: 2 - level]]
    return F.concat_ws("\x1f", F.lit(str(level)), *parts)


#: Prefix of statistics beside a table's own columns.
OWN = "_quality_"


def _rules(min_words: int, max_repeat_percent: int, prefix: str = "") -> Column:
    n = F.col(f"{prefix}n_words")
    return (n < min_words) | (100 * F.col(f"{prefix}n_repeat_words") > max_repeat_percent * n)


def estimated(stats: DataFrame) -> tuple[DataFrame, bool]:
    """Estimates of all cells with enough rows, and whether they are few enough to broadcast; ``stats`` has passed the base rules."""
    levels = F.array(*[F.struct(F.lit(n).alias("level"), _key(n).alias("key")) for n in range(3)])
    rows = stats.select(F.explode(levels).alias("at"), *STATS).select("at.key", *STATS)
    sizes = written(rows.groupBy("key").count().where(f"count >= {MIN_ROWS}"), "quality-cells")
    few = sizes.count() <= MAX_BROADCAST
    cells = sizes.select("key")
    return robust_estimates(rows.join(F.broadcast(cells) if few else cells, "key", "left_semi"), few), few


def _verdict(rows: DataFrame, estimates: DataFrame, few: bool) -> DataFrame:
    """Rows with distance and kept; they have lang, source and the statistics."""
    estimates = estimates.drop("logdet")
    for n in range(2):
        own = _near(rows.withColumn("key", _key(n)), estimates, few)
        rows = own.withColumn(f"d{n}", _distance() / F.greatest(F.col("scale"), F.lit(1e-9))).drop("key", "mean", "inverse", "scale")
    # the estimate of all rows is one row, of nulls where there is none
    whole = estimates.where(F.col("key") == _key(2)).agg(*[F.max(c).alias(c) for c in ("mean", "inverse", "scale")])
    rows = rows.crossJoin(F.broadcast(whole)).withColumn("d2", _distance() / F.greatest(F.col("scale"), F.lit(1e-9))).drop("mean", "inverse", "scale")
    rows = rows.withColumn("distance", F.round(F.coalesce("d0", "d1", "d2"), 6)).drop("d0", "d1", "d2")
    return rows.withColumn("kept", F.coalesce(F.col("distance") <= CHI2_CUT, F.lit(True)))


def _asked(docs: DataFrame) -> DataFrame:
    return small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), F.col("text").cast("string").alias("text"))


def _statistics(docs: DataFrame) -> DataFrame:
    schema = ", ".join(["doc_id long, lang string, source string", *(f"{c} long" for c in (*BASE, *STATS))])
    return _asked(docs).mapInArrow(_counted, schema)


def judged(docs: DataFrame, min_words: int = 20, max_repeat_percent: int = 30) -> DataFrame:
    """Base counts, base_failed, distance and kept of every document.

    A null text counts as empty. Base rules reject texts with under ``min_words`` words or more than
    ``max_repeat_percent`` percent of words in repeated windows; these rows take no part in the estimates. The rest is kept
    unless its squared distance, scaled to the median of its cell, is over CHI2_CUT. Null languages and
    sources are cells of their own. Where not even all rows together reach MIN_ROWS there is no verdict, distance is null
    and the base rules decide. Repeated rows are judged alike; other columns are left out.
    """
    stats = written(_statistics(docs).withColumn("base_failed", _rules(min_words, max_repeat_percent)), "quality-stats")
    good = stats.where("not base_failed")
    estimates, few = estimated(good)
    bad = stats.where("base_failed").withColumns({"distance": F.lit(None).cast("double"), "kept": F.lit(False)})
    return _verdict(good, estimates, few).unionByName(bad).select("doc_id", *BASE, "base_failed", "distance", "kept")


def kept_rows(docs: DataFrame, min_words: int = 20, max_repeat_percent: int = 30) -> DataFrame:
    """The rows that judged() keeps, with their own columns. Texts are counted once, and rows that pass the base rules are written beside their statistics."""
    names = docs.columns
    whole = small_batches(docs).select(*[F.col(c).alias(f"{OWN}{i}") for i, c in enumerate(names)], F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), F.col("text").cast("string").alias("text"))
    own = [f for f in whole.schema.fields if f.name.startswith(OWN)]
    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in own), "lang string, source string", *(f"{c} long" for c in (*BASE, *STATS))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = np.array([counts(t.as_py()) for t in batch.column(len(own) + 2)], np.int64).reshape(len(batch), -1).T
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(own) + 2)), *(pa.array(np.ascontiguousarray(c)) for c in cols)], names=[*batch.schema.names[: len(own) + 2], *BASE, *STATS])

    rows = written(whole.mapInArrow(run, schema).where(~_rules(min_words, max_repeat_percent)), "quality-rows")
    estimates, few = estimated(rows)
    return _verdict(rows, estimates, few).where("kept").select(*[F.col(f"{OWN}{i}").alias(c) for i, c in enumerate(names)])
