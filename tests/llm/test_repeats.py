import hashlib
import random
from collections import Counter

import pytest

from quillon.llm import repeats

SCHEMA = "doc_id long, text string"


def brute(rows, length):
    texts = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(t[p : p + length] for _, t in texts for p in range(len(t) - length + 1))
    out = []
    for i, t in texts:
        covered = [False] * len(t)
        for p in range(len(t) - length + 1):
            if seen[t[p : p + length]] > 1:
                covered[p : p + length] = [True] * length
        runs = sum(c and not (p and covered[p - 1]) for p, c in enumerate(covered))
        out.append((i, len(t), sum(covered), runs, hashlib.sha256(bytes(b for b, c in zip(t, covered, strict=True) if not c)).hexdigest()))
    return sorted(out, key=str)


def found(docs, length):
    return sorted((tuple(r) for r in repeats.without_repeats(docs, length).drop("spans").collect()), key=str)


def planted(rng, letters, n, length):
    """Texts that share passages of about the length, whole, cut, overlapping themselves, and with an edit inside."""
    word = lambda k: "".join(rng.choice(letters) for _ in range(k))
    passages = [word(rng.randrange(length - 3, 3 * length)) for _ in range(6)] + ["ab" * length, "z" * (2 * length)]
    rows = []
    for i in range(n):
        parts = [word(rng.randrange(2 * length))]
        for _ in range(rng.randrange(4)):
            p = rng.choice(passages)
            a, b = sorted((rng.randrange(len(p)), rng.randrange(len(p))))
            p = rng.choice([p, p[:b], p[a:], p[:a] + "#" + p[a:]])
            parts += [p, word(rng.randrange(length))]
        rows.append((i, "".join(parts)))
    return rows + [(n, rows[0][1]), (n + 1, rows[1][1]), (n + 2, None), (n + 3, ""), (n + 4, "é" * length)]


@pytest.mark.parametrize(("letters", "piece"), [("abcdefgh", 1 << 20), ("ab", 700), ("é日x", 300)])
def test_against_brute_force(spark, monkeypatch, letters, piece):
    monkeypatch.setattr(repeats, "PIECE", piece)
    for length in (40, 64):
        rows = planted(random.Random(f"{letters}{length}"), letters, 60, length)
        want = brute(rows, length)
        assert sum(w[2] for w in want) > 2000
        assert found(spark.createDataFrame(rows, SCHEMA).repartition(5), length) == want


def test_beyond_the_broadcasts(spark, monkeypatch):
    monkeypatch.setattr(repeats, "MAX_PLACES", 3)
    rows = planted(random.Random(3), "abcdefgh", 40, 40)
    want = brute(rows, 40)
    docs = spark.createDataFrame(rows, SCHEMA)
    assert found(docs, 40) == want
    monkeypatch.setattr(repeats, "MAX_BROADCAST_IDS", 3)
    assert found(docs, 40) == want


def test_identifiers_tell_strings_apart():
    import numpy as np

    raw = np.frombuffer(random.Random(1).randbytes(300) + b"a" * 100 + b"ab" * 50, np.uint8)
    for size in (8, 9, 31, 100):
        ids = [repeats.identifiers(raw, size, lane) for lane in (0, 1)]
        strings = [raw[p : p + size].tobytes() for p in range(len(raw) - size + 1)]
        for lane in ids:
            assert len(set(zip(lane.tolist(), strings, strict=True))) == len(set(strings)) == len(set(lane.tolist()))


def test_all_of_the_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert found(docs, 400) == brute([tuple(r) for r in docs.select("doc_id", "text").collect()], 400)


def test_odd_rows(spark, odd, none):
    assert found(odd, 400) == brute([tuple(r) for r in odd.select("doc_id", "text").collect()], 400)
    assert found(odd, 32) == brute([tuple(r) for r in odd.select("doc_id", "text").collect()], 32)
    assert found(none, 400) == []
    with pytest.raises(ValueError):
        repeats.without_repeats(odd, 31)
