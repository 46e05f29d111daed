"""Spelling variants: words at distance one, found by Levenshtein automata over broadcast shards of a trie.

The vocabulary in code-point order is cut into shards of bounded size, each a trie laid out breadth-first: a node's children stand side by side, so a
child is found by one search in a slice of labels. Groups of shards, of bounded size too, are broadcast one after the other; each word's automaton walks
every shard of the group depth-first. At each node that the word itself reaches, the automaton leaves the word by an edit where the word can't go on alike,
so each neighbour is accepted on one path alone. Per word only the number of neighbours and the best one leave a task.
"""

from __future__ import annotations

from array import array
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_path, new_path, written

#: A maximal run of letters.
RUN = "([A-Za-zÀ-ÿ]+)"
#: Every so many-th hash loses a letter: the misspellings that are planted.
PLANTED = 199
MIN_LENGTH, MIN_COUNT = 6, 5
#: How many times as frequent as a word its form is at least.
DOMINANCE = 5
#: Words and letters of a shard (some 13 bytes a letter), and bytes of the shards that are broadcast at once; a longer word is a shard of its own.
SHARD_WORDS, SHARD_LETTERS, GROUP_BYTES = 50_000, 1_000_000, 48_000_000

Trie = tuple[str, Sequence[int], Sequence[int]]


def vocabulary(docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, planted: int = PLANTED) -> DataFrame:
    """(word, n) of all words of documents, A-Z lowered, that are long and frequent enough. Of runs whose hash with the doc_id ``planted`` divides a letter is deleted."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all("text", F.lit(RUN), 1)).alias("run"))
    lowered = runs.where(F.char_length("run") >= min_length).select("id", F.translate("run", upper, upper.lower()).alias("run"))
    hashed = lowered.withColumn("h", F.crc32(F.concat_ws(":", "id", "run").cast("binary")))
    at = (F.col("h") % F.char_length("run")).cast("int")
    word = F.when(F.col("h") % planted == 0, F.overlay("run", F.lit(""), at + 1, F.lit(1))).otherwise(F.col("run"))
    counts = hashed.select(word.alias("word")).where(F.char_length("word") >= min_length).groupBy("word").agg(F.count("*").alias("n"))
    return counts.where(F.col("n") >= min_count)


def trie(words: Sequence[str], counts: Sequence[int]) -> Trie:
    """Labels, first children and counts (0 where no word ends) of the nodes of a trie, breadth-first; words are ascending and differ. A node's children end where the next node's begin."""
    labels, first, ends = ["\0"], array("i"), array("q")
    level, depth = [(0, len(words))], 0
    while level:
        below = []
        for low, high in level:
            ends.append(0)
            if low < high and len(words[low]) == depth:
                ends[-1] = counts[low]
                low += 1
            first.append(len(labels))
            while low < high:
                label, at = words[low][depth], low + 1
                while at < high and words[at][depth] == label:
                    at += 1
                labels.append(label)
                below.append((low, at))
                low = at
        level, depth = below, depth + 1
    first.append(len(labels))
    return "".join(labels), first, ends


def neighbours(word: str, shard: Trie) -> Iterator[tuple[str, int]]:
    """Words of the shard at distance one, each once, with their counts."""
    labels, first, ends = shard
    size, find = len(word), shard[0].find

    def rest(node: int, at: int) -> int:
        """The count of the word that ends where the rest of ``word`` leads from the node."""
        while at < size:
            node = find(word[at], first[node], first[node + 1])
            if node < 0:
                return 0
            at += 1
        return ends[node]

    node = 0
    for i in range(size + 1):
        low, high = first[node], first[node + 1]
        own = word[i] if i < size else ""
        if own and (i + 1 == size or word[i + 1] != own) and (n := rest(node, i + 1)):
            yield word[:i] + word[i + 1 :], n
        for child in range(low, high):
            label = labels[child]
            if label != own:
                if n := rest(child, i):
                    yield word[:i] + label + word[i:], n
                if own and (n := rest(child, i + 1)):
                    yield word[:i] + label + word[i + 1 :], n
        node = find(own, low, high) if own else -1
        if node < 0:
            return


def _shards(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Tries of the ascending words of a partition."""

    def row(words: list[str], counts: list[int]) -> pd.DataFrame:
        labels, first, ends = trie(words, counts)
        return pd.DataFrame({"low": [words[0]], "labels": [labels], "first": [first.tobytes()], "ends": [ends.tobytes()], "size": [16 * len(labels)]})

    words: list[str] = []
    counts: list[int] = []
    letters = 0
    for batch in batches:
        for word, n in zip(batch["word"], batch["n"], strict=True):
            if words and (len(words) == SHARD_WORDS or letters + len(word) > SHARD_LETTERS):
                yield row(words, counts)
                words, counts, letters = [], [], 0
            words.append(word)
            counts.append(n)
            letters += len(word)
    if words:
        yield row(words, counts)


def _walk(shards: Callable[[], list]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tries = [(labels, array("i", first), array("q", ends)) for labels, first, ends in shards()]
        for batch in batches:
            rows = []
            for word in batch["word"]:
                near = [(-n, x) for t in tries for x, n in neighbours(word, t)]
                if near:
                    n, form = min(near)
                    rows.append((word, len(near), form, -n))
            yield pd.DataFrame(rows, columns=["word", "n_near", "form", "form_n"])

    return run


def near_words(words: DataFrame) -> DataFrame:
    """word, n_near, form, form_n of a written table (word, n): the number of other words at distance one, and the most frequent of them (ties: the first in code-point order)."""
    spark = words.sparkSession
    shards = written(words.repartitionByRange("word").sortWithinPartitions("word").mapInPandas(_shards, "low string, labels string, first binary, ends binary, size long"), "trie-shards")
    groups: list[list[str]] = []
    room = 0
    for low, size in shards.select("low", "size").orderBy("low").collect():  # a row for each 50,000 words
        if not groups or size > room:
            groups.append([])
            room = GROUP_BYTES
        groups[-1].append(low)
        room -= size
    path = new_path(spark, "near-words")
    schema = "word string, n_near long, form string, form_n long"
    for group in groups:
        chosen = [tuple(r) for r in shards.where(F.col("low").between(group[0], group[-1])).select("labels", "first", "ends").collect()]  # of GROUP_BYTES at most
        sent = spark.sparkContext.broadcast([(labels, bytes(first), bytes(ends)) for labels, first, ends in chosen])
        words.select("word").repartition(spark.sparkContext.defaultParallelism * 2).mapInPandas(_walk(lambda sent=sent: sent.value), schema).write.mode("append").parquet(path)
        sent.destroy()
    found = spark.read.schema(schema).parquet(path) if groups else spark.createDataFrame([], schema)
    if len(groups) < 2:
        return found
    # over groups: of equal counts the first word
    least = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.max("form_n").alias("form_n"))
    named = found.join(least.select("word", F.col("form_n").alias("most")), "word").where("form_n = most").groupBy("word").agg(F.min("form").alias("form"))
    return least.join(named, "word").select("word", "n_near", "form", "form_n")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of a table (word, form): the last of the forms that follow from a word. Pointers double each round; none can lead back to its word."""
    spark = forms.sparkSession
    path = new_path(spark, "spelling-roots")
    forms.select("word", F.col("form").alias("root")).write.parquet(path)
    while True:
        now = spark.read.schema("word string, root string").parquet(path)
        on = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        if now.join(on, "root", "left_semi").isEmpty():
            return now
        after = new_path(spark, "spelling-roots")
        now.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root")).write.parquet(after)
        drop_path(spark, path)
        path = after


def variants(docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, planted: int = PLANTED, dominance: int = DOMINANCE) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of the documents' vocabulary.

    Words are maximal runs of letters with A-Z lowered, some of which lose a letter (see vocabulary()), of at least ``min_length`` letters and ``min_count`` places.
    n_near is the number of other words one inserted, deleted or replaced letter away. form is the most frequent of them (of equal ones the first in code-point
    order) if it is at least ``dominance`` times as frequent, else null, as is form_n, its count. root is the last form that forms lead to, or the word itself.
    Null and missing texts have no word; a null doc_id counts as empty text; rows that repeat a doc_id are counted each; other columns are left out.
    """
    words = written(vocabulary(docs, min_length, min_count, planted), "spelling-words")
    told = words.join(near_words(words), "word", "left")
    some = F.col("form_n") >= dominance * F.col("n")
    judged = written(told.select("word", F.when(some, F.col("form")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(some, F.col("form_n")).alias("form_n")), "spelling-forms")
    ends = roots(judged.where("form is not null"))
    return judged.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
