"""Near-equal lines by a segment-partition edit join, in DataFrame functions alone.

A line of length L is cut into T + 1 segments, T being the threshold. If a line has at most T edits against it, one
segment stands in it unchanged, at a place that the segment's number and the two lengths narrow down. Segments of each
different line are the index, keyed by length, number and content; each line probes the few substrings
that may match, for its own and up to T smaller lengths. Pairs that meet, and whose letter counts are near
enough, are verified by a bit-parallel edit distance inside the band of 2 T + 1 diagonals.

How many edits two lines may have grows with the shorter one's length: one for each MIN_CHARS / THRESHOLD characters, THRESHOLD at most.
Each number of edits is a search of its own, over the lengths that it is about.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import MAX_BROADCAST_IDS, WORD, connected, joined_by_id, joined_by_key, written

#: Edits between near-equal lines at most, and characters of lines that may have so many; shorter ones may have fewer in proportion, see tiers().
THRESHOLD, MIN_CHARS = 2, 24
#: Letters whose counts are compared: an edit changes two of them by one at most.
COUNTED = "en"
#: All letters that are counted where a bucket is crowded, eight to a number.
COUNTED_ALL = ("enaritso", "dhlcumfg", "pbwyvkxj")
#: Lines in one bucket of the index beyond which pairs are tested inside the join, their texts beside them, so that links alone leave it.
CROWD = 8
#: Lines of a crowded bucket, and lines that probe it, that meet in one place; larger buckets are cut, and their parts meet in places of their own.
MEMBERS, PROBES = 64, 4096
#: What marks a line's own segments among its probes, beside the letter counts.
OWN = 1 << 32


def line_rows(docs: DataFrame) -> DataFrame:
    """doc_id, line_no (from 0), line and its id of every line of every text; a null text has none."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.posexplode(F.split(F.col("text").cast("string"), "\n", -1)).alias("line_no", "line"))
    return rows.withColumn("id", F.xxhash64("line"))


def _packed_counts(letters: str = COUNTED) -> Column:
    """Counts of up to eight letters modulo 256 in one number."""
    size = F.length("line")
    return reduce(lambda a, b: a.bitwiseOR(b), [F.shiftleft((size - F.length(F.replace(F.col("line"), F.lit(c)))).cast("long").bitwiseAND(F.lit(255)), 8 * i) for i, c in enumerate(letters)])


def different_lines(rows: DataFrame) -> DataFrame:
    """id, counts and line of each different line; equal lines are brought together before and after the shuffle, by hashing."""
    return rows.select("id", _packed_counts().alias("counts"), "line").distinct()


def tiers(threshold: int = THRESHOLD, min_chars: int = MIN_CHARS) -> list[tuple[int, int, int | None]]:
    """(edits, shortest, longest line) of each search: lines of ``min_chars`` may have ``threshold`` edits, shorter ones fewer in proportion.

    A search with fewer edits is about pairs whose shorter line is too short for more.
    """
    out: list[tuple[int, int, int | None]] = []
    for edits in range(threshold, 0, -1):
        least = max(-(-min_chars * edits // threshold), edits + 1)
        out.append((edits, least, out[-1][1] - 1 + edits if out else None))
    return out


def _key(length: str, number: int, parts: int, place: str, size: str) -> str:
    return f"xxhash64({length}, {64 * parts + number}, substring(TEXT, {place} + 1, {size}))"


def _keys(keys: list[str]) -> Column:
    """The keys of a line. Where all characters are bytes, substrings are taken of bytes, which need no search for their start."""
    bytes_, chars = (f"array({', '.join(keys)})".replace("TEXT", t) for t in ("cast(line as binary)", "line"))
    return F.expr(f"if(octet_length(line) = n, {bytes_}, {chars})")


def _segment(length: str, number: int, parts: int) -> tuple[str, str]:
    """Place and size of a segment, from 0."""
    start, stop = (f"cast(({n} * ({length})) div {parts} as int)" for n in (number, number + 1))
    return start, f"({stop} - {start})"


def index_keys(threshold: int) -> list[str]:
    parts = threshold + 1
    return [_key("n", i, parts, *_segment("n", i, parts)) for i in range(parts)]


def probe_keys(threshold: int) -> list[tuple[str, bool]]:
    """Substrings that may equal a segment of a line up to ``threshold`` shorter: only those that leave few enough edits on either side.
    With each, whether it is the line's own segment."""
    parts, out = threshold + 1, []
    for shorter in range(threshold + 1):
        for i in range(parts):
            place, size = _segment(f"n - {shorter}", i, parts)
            low, high = max(-i, shorter - (threshold - i)), min(i, shorter + (threshold - i))
            out += [(_key(f"n - {shorter}", i, parts, f"{place} + ({off})", size), not shorter and not off) for off in range(low, high + 1)]
    return out


def _counts_apart(one: str = "counts", other: str = "p_counts", letters: str = COUNTED) -> Column:
    """Differences of the letter counts added up; lines within T edits have 2 T at most."""
    apart: Column = F.lit(0)
    for i in range(len(letters)):
        off = (F.shiftright(one, 8 * i).bitwiseAND(F.lit(255)) - F.shiftright(other, 8 * i).bitwiseAND(F.lit(255))).bitwiseAND(F.lit(255))
        apart = apart + F.least(off, 256 - off)
    return apart


def candidates(lines: DataFrame, threshold: int = THRESHOLD, min_chars: int = MIN_CHARS, max_chars: int | None = None) -> DataFrame:
    """Two kinds of rows from one join of probes and index: (a, b) of ids of different lines that share a segment and have near letter
    counts; and, where a bucket of the index is crowded, key and id of each line that probes it and whether it stands there itself. With each, the edits."""
    size = F.col("n") >= min_chars
    long = lines.withColumn("n", F.length("line")).where(size if max_chars is None else size & (F.col("n") <= max_chars))
    index = long.select("id", "counts", F.explode(_keys(index_keys(threshold))).alias("key"))
    probes = probe_keys(threshold)
    at = long.select(F.col("id").alias("p_id"), "counts", F.posexplode(_keys([key for key, _ in probes])).alias("at", "key"))
    own = F.when(F.col("at").isin([i for i, (_, own) in enumerate(probes) if own]), F.lit(OWN)).otherwise(F.lit(0)).cast("long")
    probe = at.select("p_id", F.col("counts").bitwiseOR(own).alias("p_counts"), "key")
    bucket = Window.partitionBy("key")
    sized = index.withColumns({"crowd": F.count("*").over(bucket) > CROWD, "nth": F.row_number().over(bucket.orderBy("id"))})
    # a crowded bucket leaves one row for its probes
    kept = sized.where(~F.col("crowd") | (F.col("nth") == 1)).drop("nth")
    near = (F.col("id") != F.col("p_id")) & (_counts_apart() <= 2 * threshold)
    met = probe.join(kept, (probe.key == kept.key) & (F.col("crowd") | near))
    pair = lambda c: F.when(~F.col("crowd"), c("id", "p_id"))
    crowd = lambda c: F.when(F.col("crowd"), c)
    return met.select(pair(F.least).alias("a"), pair(F.greatest).alias("b"), crowd(probe.key).alias("key"), crowd(F.col("p_id")).alias("id"), crowd(F.col("p_counts") >= OWN).alias("own"), F.lit(threshold).alias("edits"))


def banded_distance(left: str, right: str, threshold: int) -> Column:
    """Edit distance of two columns if it is at most ``threshold``, else some larger number; both must be longer than the threshold.

    One machine word holds the vertical differences of a column of the table inside the band; it moves down the diagonal
    until it reaches the last row, then along it (Hyyrö's banded form of Myers' algorithm).
    """
    width = 2 * threshold + 1
    mask, diagonal = (1 << width) - 1, 1 << (width - 1)
    a, b = f"split({left}, '')", f"split({right}, '')"
    # rows above the first and below the last give null, which equals nothing
    equal = " | ".join(f"if(coalesce(get(a, j + {p - threshold}) = get(b, j), false), {1 << p}, 0)" for p in range(width))
    matches = f"transform(sequence(0, size(b) - 1), j -> struct(j as j, {equal} as x))"
    d0 = f"((((m.x & s.vp) + s.vp) ^ s.vp) | m.x | s.vn) & {mask}"
    first = f"transform(array({d0}), d -> struct(d as d0, s.vn | (~(d | s.vp) & {mask}) as hp, d & s.vp as hn))[0]"
    step = f"""transform(array({first}), h -> struct(
        h.hn | (~(shiftright(h.d0, 1) | h.hp) & {mask}) as vp,
        shiftright(h.d0, 1) & h.hp as vn,
        s.distance + if(m.j < size(a) - {threshold}, if(h.d0 & {diagonal} = 0, 1, 0), if(h.hp & s.bit != 0, 1, 0) - if(h.hn & s.bit != 0, 1, 0)) as distance,
        if(m.j < size(a) - {threshold}, s.bit, shiftright(s.bit, 1)) as bit))[0]"""
    start = f"struct({mask & ~((1 << threshold) - 1)} as vp, 0 as vn, {threshold} as distance, {diagonal >> 1} as bit)"
    scan = f"aggregate({matches}, {start}, (s, m) -> {step}, s -> s.distance)"
    return F.expr(f"transform(array(struct({a} as a, {b} as b)), w -> transform(array(w.a), a -> transform(array(w.b), b -> {scan})[0])[0])[0]")


def _crowded(crowd: DataFrame, counted: DataFrame) -> DataFrame:
    """Pairs of lines, with their texts, of crowded buckets. A bucket's lines and those that probe it are dealt into parts, and each two parts meet in a place of their own."""
    parts = lambda c, size: F.ceil(c / size).cast("int")
    sizes = crowd.groupBy("key").agg(parts(F.count_if("own"), MEMBERS).alias("members"), parts(F.count("*"), PROBES).alias("probes"))
    told = crowd.join(sizes, "key")
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    part = lambda c: F.pmod(F.xxhash64("id"), F.col(c)).cast("int")
    there = told.where("own").select("key", "id", part("members").alias("m"), every("probes").alias("p")).join(counted, "id")
    asked = told.select("key", "edits", F.col("id").alias("p_id"), part("probes").alias("p"), every("members").alias("m"))
    asked = asked.join(counted.select(*[F.col(c).alias(f"p_{c}") for c in counted.columns]), "p_id")
    return asked.join(there, ["key", "p", "m"]).where(F.col("id") != F.col("p_id"))


def _verified(pairs: DataFrame, threshold: int) -> DataFrame:
    """(a, b) of pairs whose letters' counts and whose bit-parallel distance allow it."""
    apart = reduce(lambda x, y: x + y, [_counts_apart(f"c{i}", f"p_c{i}", c) for i, c in enumerate(COUNTED_ALL)])
    near = pairs.where(apart <= 2 * F.col("edits")).where(F.abs(F.length("line") - F.length("p_line")) <= F.col("edits")).where(banded_distance("line", "p_line", threshold) <= F.col("edits"))
    return near.select(F.least("id", "p_id").alias("a"), F.greatest("id", "p_id").alias("b"))


def _links(docs: DataFrame, searches: list[tuple[int, int, int | None]]) -> DataFrame:
    rows = line_rows(docs)
    lines = different_lines(rows)
    threshold = max(edits for edits, _, _ in searches)
    found = written(reduce(DataFrame.unionAll, [candidates(lines, *search) for search in searches]), "line-candidates")
    sparse = found.where("a is not null").groupBy("a", "b").agg(F.max("edits").alias("edits"))
    crowd = written(found.where("id is not null").groupBy("key", "id").agg(F.bool_or("own").alias("own"), F.max("edits").alias("edits")), "line-crowds")
    ids = written(sparse.select(F.col("a").alias("id")).union(sparse.select("b")).union(crowd.select("id")).distinct(), "line-ids")
    texts = different_lines(rows.join(F.broadcast(ids) if ids.count() <= MAX_BROADCAST_IDS else ids, "id", "left_semi")).where(F.length("line") >= min(least for _, least, _ in searches))
    counted = written(texts.select("id", "line", *[_packed_counts(c).alias(f"c{i}") for i, c in enumerate(COUNTED_ALL)]), "line-texts")
    beside = counted.select(*[F.col(c).alias(f"p_{c}") for c in counted.columns])
    pairs = sparse.select(F.col("a").alias("id"), F.col("b").alias("p_id"), "edits").join(counted, "id").join(beside, "p_id")
    return _verified(pairs, threshold).unionAll(_verified(_crowded(crowd, counted), threshold)).distinct()


def links(docs: DataFrame, threshold: int = THRESHOLD, min_chars: int = MIN_CHARS) -> DataFrame:
    """(a, b) of ids of different lines of at least ``min_chars`` characters within the threshold."""
    if threshold < 1 or min_chars <= threshold:
        raise ValueError("the threshold must be positive and shorter than the shortest line")
    return _links(docs, [(threshold, min_chars, None)])


def line_classes(docs: DataFrame, threshold: int = THRESHOLD, min_chars: int = MIN_CHARS) -> DataFrame:
    """doc_id, line_no, n_chars, class_id and n_links of every line.

    Equal lines are one line with many places: they share an id (their 64-bit hash). Two lines are linked if they have at most ``threshold`` edits,
    or, if the shorter has under ``min_chars`` characters, at most as many in proportion to its length, rounded down (see tiers()); where that is
    none, lines belong with their equals alone. n_links is the number of different lines that a line is linked to; a class is what links
    reach and its id the smallest line id in it. Null and missing texts have no line; rows that repeat a doc_id give their lines again.
    Other columns are left out. However many places a line has, they are never brought together.
    """
    if threshold < 1 or min_chars <= threshold:
        raise ValueError("the threshold must be positive and shorter than the shortest line")
    near = written(_links(docs, tiers(threshold, min_chars)), "line-links")
    both = near.select(F.col("a").alias("id")).unionAll(near.select(F.col("b").alias("id")))
    degrees = both.groupBy("id").agg(F.count("*").alias("n_links"))
    roots = connected(near.select(F.col("a").alias("u"), F.col("b").alias("v")), "line-classes")
    known = written(roots.select(F.col("node").alias("id"), F.col("root").alias("class_id")).join(degrees, "id"), "line-known")
    out = line_rows(docs).select("doc_id", F.col("line_no").cast("long").alias("line_no"), F.length("line").cast("long").alias("n_chars"), "id")
    return joined_by_key(out, known, "id").select("doc_id", "line_no", "n_chars", F.coalesce("class_id", "id").alias("class_id"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"))


#: Characters of lines whose repeats go: such that have an edit or more, see tiers().
MIN_REPEAT = tiers()[-1][1]


def without_repeats(docs: DataFrame, threshold: int = THRESHOLD, min_chars: int = MIN_CHARS, min_repeat: int = MIN_REPEAT) -> DataFrame:
    """Documents without lines whose class has stood before, in ascending order of (doc_id, line).

    Lines under ``min_repeat`` characters stay. A document that loses its last word goes; one that loses no line is unchanged, null and empty
    texts among them. n_chars, if there is such a column, follows the text. Rows without a doc_id stay as they are, and rows that
    repeat one are changed alike.
    """
    told = line_classes(docs, threshold, min_chars).where((F.col("n_chars") >= min_repeat) & F.col("doc_id").isNotNull())
    places = written(told.select("class_id", "doc_id", "line_no"), "line-places")
    first = written(places.groupBy("class_id").agg(F.min(F.struct("doc_id", "line_no")).alias("first"), F.count("*").alias("n")).where("n > 1").select("class_id", "first"), "line-firsts")
    again = joined_by_key(places, first, "class_id").where((F.col("doc_id") != F.col("first.doc_id")) | (F.col("line_no") != F.col("first.line_no")))
    drops = written(again.groupBy("doc_id").agg(F.collect_set(F.col("line_no").cast("int")).alias("_drops")), "line-drops")
    weight = drops.agg(F.avg(F.size("_drops"))).first()[0] or 0
    names = docs.columns
    kept = "array_join(filter(split(text, '\n', -1), (x, i) -> not array_contains(_drops, i)), '\n')"
    told = joined_by_id(docs, drops, "left", 2 + int(weight / 4)).withColumn("_kept", F.when(F.col("_drops").isNotNull(), F.expr(kept)))
    some = told.where(F.col("_drops").isNull() | F.col("_kept").rlike(WORD))
    text = F.coalesce("_kept", "text")
    columns = [text.alias(c) if c == "text" else F.coalesce(F.length("_kept").cast("long"), F.col(c)).alias(c) if c == "n_chars" else F.col(c) for c in names]
    return some.select(*columns)
