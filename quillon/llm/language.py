"""Language identification with a bit-sliced Bloom filter of character n-grams.

A slot of the filter holds a mask of languages. The masks of an n-gram's slots, joined by AND, name all languages that
contain it; a text's n-grams are counted for each language, counts are corrected for each language's rate of
false positives, and the largest wins. An n-gram counts the less the more languages its mask names. Only text and language
of training rows are learned from.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

_NOT_LETTERS = re.compile(r"[\W\d_]+")
UNKNOWN = "und"
#: Characters of an n-gram (a blank marks a word's edge), slots of the filter, slots of an n-gram.
N, SLOTS, HASHES = 4, 1 << 21, 2
#: The classifier's sample: so many different training texts of each language on average at most, those with the smallest hashes.
SAMPLE_ROWS = 4000
#: A language contains an n-gram that it has so often in its sample; once or twice may be a name or a slip. Of a small sample one or two must do: one more for each FEW_TEXTS.
MIN_COUNT, FEW_TEXTS = 3, 5
#: Languages at most: each mask word is a filter of 16 MB.
MAX_LANGUAGES = 504
#: Languages in one mask; more languages take more masks.
MASK_BITS = 63
#: n-grams hashed together.
BLOCK = 1 << 20


def letters(text: str | None) -> str:
    """The text in lower case with a blank for all that is no letter; empty if it has no letter."""
    found = _NOT_LETTERS.sub(" ", (text or "").lower()).strip()
    return f" {found} " if any(map(str.isalpha, found)) else ""


def gram_hashes(found: str, n: int = N) -> np.ndarray:
    """A 64-bit hash of each n-gram of what letters() gives."""
    codes = np.frombuffer(found.encode("utf-32-le", "replace"), "<u4").astype(np.uint64)
    count = len(codes) - n + 1
    if count < 1:
        return np.zeros(0, np.uint64)
    h = np.zeros(count, np.uint64)
    for i in range(n):
        h = h * np.uint64(0x9E3779B97F4A7C15) + codes[i : i + count]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ h >> np.uint64(29)


def slots(h: np.ndarray, which: int) -> np.ndarray:
    return ((h >> np.uint64(which * 24)) % np.uint64(SLOTS)).astype(np.int64)


@dataclass
class Model:
    """Languages in order, their training rows, and for each mask word the filter's slots."""

    languages: list[str]
    rows: list[int]
    filters: list[np.ndarray]

    def __post_init__(self) -> None:
        size = max(len(self.languages), 1)
        fill = np.array([np.count_nonzero(self.filters[i // MASK_BITS] >> i % MASK_BITS & 1) / SLOTS for i in range(len(self.languages))] or [0.0])
        self.false_rate = np.minimum(fill**HASHES, 0.999)
        self.default = int(np.argmax(self.rows)) if self.rows else -1
        self.size = size

    def tallied(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """n-grams that each language contains, false positives among them; the same by weight; and the weight of all n-grams.

        Of L languages an n-gram that m contain weighs the logarithm of (L + 1) / m.
        """
        out, weighted, whole = np.zeros(self.size, np.int64), np.zeros(self.size), 0.0
        weights = np.log((self.size + 1) / np.maximum(np.arange(self.size + 1), 1))
        for at in range(0, len(h), BLOCK):
            part = h[at : at + BLOCK]
            masks = []
            for table in self.filters:
                mask = table[slots(part, 0)]
                for k in range(1, HASHES):
                    mask &= table[slots(part, k)]
                masks.append(mask)
            if len(masks) == 1 and self.size <= 8:
                seen = np.bincount(masks[0], minlength=1 << self.size)
                value = np.arange(len(seen))
                heavy = seen * weights[np.bitwise_count(value)]
                on = value >> np.arange(self.size)[:, None] & 1 == 1
                out += (seen * on).sum(1)
                weighted += (heavy * on).sum(1)
                whole += float(heavy.sum())
                continue
            weight = weights[sum(np.bitwise_count(m).astype(np.int64) for m in masks)]
            whole += float(weight.sum())
            for i in range(len(self.languages)):
                on = masks[i // MASK_BITS] >> i % MASK_BITS & 1 == 1
                out[i] += np.count_nonzero(on)
                weighted[i] += weight[on].sum()
        return out, weighted, whole

    def counts(self, h: np.ndarray) -> np.ndarray:
        """n-grams that each language contains, false positives among them."""
        return self.tallied(h)[0]

    def predict(self, text: str | None) -> tuple[str, float]:
        """The language and the corrected share of the text's n-grams that it contains."""
        found = letters(text)
        if not found or not self.languages:
            return UNKNOWN, 0.0
        h = gram_hashes(found)
        counts, weighted, whole = self.tallied(h)
        share = np.clip((counts / max(len(h), 1) - self.false_rate) / (1 - self.false_rate), 0, 1)
        evidence = np.where(share > 0, (weighted - self.false_rate * whole) / (1 - self.false_rate), -np.inf).round(9)
        best = int(np.argmax(evidence))  # a tie goes to the first by name
        if share[best] == 0:
            return self.languages[self.default], 0.0
        return self.languages[best], round(float(share[best]), 6)


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of (language number, n-gram) in each batch."""
    for batch in batches:
        by: dict[int, list[np.ndarray]] = {}
        for number, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            by.setdefault(number, []).append(gram_hashes(letters(text)))
        for number, parts in by.items():
            h, n = np.unique(np.concatenate(parts), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), number, np.int32)), pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))], names=["number", "gram", "n"])


def fit(rows: DataFrame) -> Model:
    """The model of rows with lang and text; rows with a null language or text teach nothing."""
    known = rows.where("lang is not null and text is not null").select("lang", "text")
    hashed = known.withColumn("h", F.xxhash64("text"))
    # rows and different texts of each language: a row for each language
    sizes = hashed.groupBy("lang", "h").agg(F.count("*").alias("n")).groupBy("lang").agg(F.sum("n").alias("n"), F.count("*").alias("texts")).orderBy("lang").limit(MAX_LANGUAGES + 1).collect()
    if len(sizes) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages to learn")
    names = [r["lang"] for r in sizes]
    if not names:
        return Model([], [], [])
    spark = rows.sparkSession
    number = spark.createDataFrame([(r["lang"], i, min(1.0, SAMPLE_ROWS / r["texts"])) for i, r in enumerate(sizes)], "lang string, number int, part double")
    # the hash of a text is even over different texts, and copies count once
    low = F.shiftrightunsigned(F.col("h"), 11) / float(1 << 53) < F.col("part")
    chosen = hashed.join(F.broadcast(number), "lang").where(low)
    sample = chosen.groupBy("number", "h").agg(F.max("text").alias("text")).select("number", "text")
    counted = sample.mapInArrow(_grams, "number int, gram long, n long").groupBy("number", "gram").agg(F.sum("n").alias("n"))
    least = spark.createDataFrame([(i, min(MIN_COUNT, 1 + r["texts"] // FEW_TEXTS)) for i, r in enumerate(sizes)], "number int, least int")
    own = counted.join(F.broadcast(least), "number").where(F.col("n") >= F.col("least"))  # a row for each language
    wide = F.col("gram")
    places = [F.pmod(F.shiftrightunsigned(wide, 24 * k), F.lit(SLOTS)) for k in range(HASHES)]
    filled = own.select((F.col("number") / MASK_BITS).cast("int").alias("word"), F.expr(f"shiftleft(1L, number % {MASK_BITS})").alias("bit"), F.explode(F.array(*places)).alias("slot"))
    filters = [np.zeros(SLOTS, np.int64) for _ in range(-(-len(names) // MASK_BITS))]
    table = filled.groupBy("word", "slot").agg(F.bit_or("bit").alias("mask")).toArrow()  # SLOTS rows for each mask word at most
    words, at, masks = (table.column(i).to_numpy() for i in range(3))
    for w, f in enumerate(filters):
        f[at[words == w]] = masks[words == w]
    return Model(names, [r["n"] for r in sizes], filters)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred and score of every document, from its text alone."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # SLOTS longs for each mask word

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            found = [own.predict(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x for x, _ in found], pa.string()), pa.array([y for _, y in found], pa.float64())], names=["doc_id", "lang_pred", "score"])

    return small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def held_out(doc_id: str = "doc_id", folds: int = 5):
    """Whether crc32 of the doc_id as text leaves no remainder; false without a doc_id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % folds == 0, F.lit(False))


def identified(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document, from a model of the rows that are not held out.

    Null texts and texts without a letter are ``und`` with score 0; a text none of whose n-grams is known gets the most frequent
    language with score 0; ties go to the first language by name. Without any training row all is ``und``. Repeated
    rows are predicted alike and other columns are left out.
    """
    model = fit(docs.where(~held_out()).select(F.col("lang").cast("string").alias("lang"), "text"))
    return predict(docs, model).withColumn("held_out", held_out()).select("doc_id", "held_out", "lang_pred", "score")
