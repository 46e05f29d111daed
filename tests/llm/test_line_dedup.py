import random

import pytest

from quillon.llm import line_dedup


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
        row = new
    return row[-1]


def edited(rng, text, n):
    text = list(text)
    for _ in range(n):
        at, kind = rng.randrange(len(text)), rng.random()
        if kind < 0.33:
            text[at] = rng.choice("abé ")
        elif kind < 0.66:
            text.insert(at, rng.choice("abé "))
        elif len(text) > 6:
            del text[at]
    return "".join(text)


@pytest.mark.parametrize("threshold", [1, 2, 3])
def test_banded_distance(spark, threshold):
    rng = random.Random(threshold)
    pairs = []
    while len(pairs) < 250:
        a = "".join(rng.choice("abé ") for _ in range(rng.randint(5, 30)))
        b = edited(rng, a, rng.randint(0, 5))
        if min(len(a), len(b)) > threshold and abs(len(a) - len(b)) <= threshold:
            pairs.append((a, b))
    frame = spark.createDataFrame(pairs, "left string, right string").withColumn("d", line_dedup.banded_distance("left", "right", threshold))
    for r in frame.collect():
        assert min(r.d, threshold + 1) == min(distance(r.left, r.right), threshold + 1)


@pytest.mark.parametrize("threshold,variants", [(1, 6), (2, 6), (3, 6), (2, 60)])
def test_links_match_brute_force(spark, threshold, variants):
    """With many variants of few lines, buckets are crowded."""
    rng = random.Random(100 * threshold + variants)
    base = ["".join(rng.choice("abcdé ") for _ in range(rng.randint(12, 40))) for _ in range(240 // variants)]
    lines = sorted({edited(rng, b, rng.randint(0, 3)) for b in base for _ in range(variants)})
    docs = spark.createDataFrame([(i, "\n".join(lines[i::40])) for i in range(40)], "doc_id long, text string")
    want = {(a, b) for i, b in enumerate(lines) for a in lines[:i] if abs(len(a) - len(b)) <= threshold and min(len(a), len(b)) >= 8 and distance(a, b) <= threshold}
    text = {r.id: r.line for r in line_dedup.different_lines(line_dedup.line_rows(docs)).collect()}
    assert {tuple(sorted((text[r.a], text[r.b]))) for r in line_dedup.links(docs, threshold, 8).collect()} == want


def test_main_path_is_native(spark, odd):
    plan = line_dedup.candidates(line_dedup.different_lines(line_dedup.line_rows(odd)))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_classes_and_odd_rows(spark, odd, none):
    long = "a line of more than twenty four characters"
    docs = spark.createDataFrame([(1, f"{long}\nshort\n{long}!"), (2, f"{long}?!\nother line that stands alone in here"), (3, None), (4, "")], "doc_id long, text string")
    rows = {(r.doc_id, r.line_no): r for r in line_dedup.line_classes(docs).collect()}
    assert set(rows) == {(1, 0), (1, 1), (1, 2), (2, 0), (2, 1), (4, 0)}
    assert len({rows[k].class_id for k in ((1, 0), (1, 2), (2, 0))}) == 1
    assert [rows[k].n_links for k in ((1, 0), (1, 1), (1, 2), (2, 0), (2, 1))] == [2, 0, 2, 2, 0]
    assert line_dedup.line_classes(odd).count() == sum(len(r.text.split("\n")) for r in odd.collect() if r.text is not None)
    assert line_dedup.line_classes(none).count() == 0


def test_without_repeats(spark, odd, none):
    long = "a line of more than twenty four characters"
    rows = [(1, f"{long}\nshort", 0), (2, f"{long}.\nshort\nsome other line of its own with words", 0), (3, f"{long}..", 0), (4, None, None), (5, "", 0), (None, long, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long")
    found = {r.doc_id: r for r in line_dedup.without_repeats(docs).collect()}
    assert found[1].text == f"{long}\nshort" and found[1].n_chars == 0
    assert found[2].text == "short\nsome other line of its own with words" and found[2].n_chars == len(found[2].text)
    assert set(found) == {1, 2, 4, 5, None}
    assert line_dedup.without_repeats(odd).columns == odd.columns
    assert line_dedup.without_repeats(none).count() == 0


def test_parameters():
    with pytest.raises(ValueError):
        line_dedup.links(None, 0)


@pytest.mark.parametrize("members,probes", [(64, 4096), (3, 5)])
def test_short_lines_have_edits_in_proportion(spark, monkeypatch, members, probes):
    """Brute force over lines of all lengths: an edit for each twelve characters of the shorter line, two at most; parts of crowded buckets change nothing."""
    monkeypatch.setattr(line_dedup, "MEMBERS", members)
    monkeypatch.setattr(line_dedup, "PROBES", probes)
    rng = random.Random(77)
    base = ["".join(rng.choice("abcdé ") for _ in range(rng.randint(6, 34))) for _ in range(14)]
    lines = sorted({edited(rng, b, rng.randint(0, 3)) for b in base for _ in range(24)} | {"", "a", "ab", "abc"})
    docs = spark.createDataFrame([(i, "\n".join(lines[i::20])) for i in range(20)], "doc_id long, text string")
    allowed = lambda a, b: min(2, min(len(a), len(b)) // 12)
    want = {x: 0 for x in lines}
    for i, b in enumerate(lines):
        for a in lines[:i]:
            if abs(len(a) - len(b)) <= 2 and allowed(a, b) and distance(a, b) <= allowed(a, b):
                want[a] += 1
                want[b] += 1
    text = {(i, n): x for i in range(20) for n, x in enumerate(lines[i::20])}
    found = line_dedup.line_classes(docs).collect()
    assert {text[r.doc_id, r.line_no]: r.n_links for r in found} == want
    assert any(n and 12 <= len(x) < 24 for x, n in want.items())


def test_hot_lines_are_not_brought_together(spark, monkeypatch):
    from quillon.llm import common

    rows = spark.range(5000).selectExpr("id", "if(id % 3 = 0, 7L, id) as k")
    table = spark.range(3000).selectExpr("id as k", "id * 2 as v")
    want = sorted(map(tuple, rows.join(table, "k", "left").select("id", "k", "v").collect()), key=str)
    for ids, hot in ((1 << 20, 100), (10, 100), (10, 10**6)):
        monkeypatch.setattr(common, "MAX_BROADCAST_IDS", ids)
        monkeypatch.setattr(common, "HOT_ROWS", hot)
        assert sorted(map(tuple, common.joined_by_key(rows, table, "k").select("id", "k", "v").collect()), key=str) == want


def test_repeats_of_lines_of_twelve_characters_go(spark):
    docs = spark.createDataFrame([(1, "All rights reserved.\nshort"), (2, "words of its own stand here\nAll rights reserved!\nshort")], "doc_id long, text string")
    found = {r.doc_id: r.text for r in line_dedup.without_repeats(docs).collect()}
    assert found == {1: "All rights reserved.\nshort", 2: "words of its own stand here\nshort"}


def test_a_hot_bucket_leaves_one_row_for_its_probes(spark):
    """Lines that share a segment meet one row of it: no join tests all against all, and time follows the number of lines."""
    import time

    def lines(n):
        return spark.range(n).selectExpr("concat('a common start', lpad(conv(id * 7919 % 1000003, 10, 36), 16, '-'), lpad(id, 12, 'x')) as line").selectExpr("xxhash64(line) as id", "0L as counts", "line")

    plan = line_dedup.candidates(lines(100))._jdf.queryExecution().optimizedPlan().toString()
    assert not any("nth" in line for line in plan.splitlines() if "Join" in line)
    took = {}
    for n in (2000, 16_000, 64_000):
        began = time.monotonic()
        found = line_dedup.candidates(lines(n)).where("id is not null and own").select("key", "id").distinct().groupBy("key").count().agg({"count": "max"}).first()[0]
        took[n] = time.monotonic() - began
        assert found == n
    assert took[64_000] < 8 * took[16_000] + 5
