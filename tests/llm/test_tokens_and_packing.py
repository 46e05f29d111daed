import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quillon.llm import packing, token_files, tokens

FILES = ("byte_bpe_50k.json", "word_bpe_49k.json")


def library(name):
    t = Tokenizer.from_file(public_tokenizers.path(name))
    t.encode_special_tokens = True
    return t


@pytest.mark.parametrize("name", FILES)
@settings(max_examples=150, deadline=None)
@given(text=st.one_of(st.text(max_size=60), st.text(alphabet="ab'sS .,!\n\t\r é İΣσ1²ßä́|$", max_size=60)))
def test_pieces_have_the_librarys_ids(name, text):
    enc = tokens.encoder(public_tokenizers.path(name))
    assert np.frombuffer(enc.encode([text])[0], enc.dtype).tolist() == library(name).encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("size", [0, 1, 7, 511, 512, 513, 5000])
def test_direct_codes_give_any_token(size):
    rng = random.Random(size)
    ids = np.array([rng.choice([rng.randrange(256), rng.randrange(50_000), rng.randrange(1 << 31)]) for _ in range(size)], np.uint32)
    codes = token_files.DirectCodes.of(ids)
    assert len(codes) == size
    for at in range(0, size, max(1, size // 300)):
        assert codes.get(at) == ids[at]
    for _ in range(60):
        a, b = sorted((rng.randint(0, size), rng.randint(0, size)))
        assert codes.range(a, b).tolist() == ids[a:b].tolist()
    with pytest.raises(IndexError):
        codes.get(size)


def expected(rows, name, end):
    t = library(name)
    return [(i, np.array([*t.encode(x or "", add_special_tokens=False).ids, end], "<u4")) for i, x in rows]


def test_token_files_round_trip(spark, sf, odd):
    for docs in (spark.read.parquet(f"{sf}/documents.parquet").limit(120), odd):
        rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
        found = token_files.token_digest(docs, public_tokenizers.path(FILES[1]), 2).collect()
        want = expected(rows, FILES[1], 2)
        assert sorted((str(r.doc_id), r.n_tokens, r.ids_crc32) for r in found) == sorted((str(i), len(x), zlib.crc32(x.tobytes())) for i, x in want)
        at = 0
        for r in sorted(found, key=lambda r: r.start):
            assert r.start == at
            at += r.n_tokens
        ids = [r.doc_id for r in sorted(found, key=lambda r: r.start) if r.doc_id is not None]
        assert ids == sorted(ids)


def test_small_shards_read_alike(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(60)
    path = f"file://{tmp_path}/t"
    token_files.write_token_files(docs, path, public_tokenizers.path(FILES[1]), 2, shard_tokens=500)
    assert spark.read.parquet(path).count() > 5
    key = lambda r: tuple(r)
    assert sorted(map(key, token_files.read_token_files(spark, path).collect())) == sorted(map(key, token_files.token_digest(docs, public_tokenizers.path(FILES[1]), 2).collect()))


def test_hilbert_steps_to_neighbours():
    points = np.array([[a, b, c] for a in range(8) for b in range(8) for c in range(8)])
    place = packing.hilbert(points, 3)
    assert sorted(place) == list(range(512))
    assert (np.abs(np.diff(points[np.argsort(place)], axis=0)).sum(1) == 1).all()


def test_packing_places_each_id_once(spark, sf, odd):
    for docs in (spark.read.parquet(f"{sf}/documents.parquet").limit(120), odd):
        rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
        found = packing.pack(docs, public_tokenizers.path(FILES[0]), 256, 0).collect()
        want = expected(rows, FILES[0], 0)
        assert sum(r.length for r in found) == sum(len(x) for _, x in want)
        by_id = defaultdict(list)
        for i, x in want:
            by_id[i].append(x)
        for r in found:
            assert any(r.doc_tokens == len(x) and zlib.crc32(x[r.start : r.start + r.length].tobytes()) == r.ids_crc32 for x in by_id[r.doc_id])
        sequences = defaultdict(list)
        for r in found:
            sequences[r.sequence_id].append((r.offset, r.length))
        ends = {}
        for s, parts in sequences.items():
            at = 0
            for offset, length in sorted(parts):
                assert offset == at
                at += length
            ends[s] = at
        assert sorted(sequences) == list(range(len(sequences)))
        assert all(ends[s] == 256 for s in list(sequences) if s != max(sequences)) and ends[max(sequences)] <= 256


def test_neighbours_on_the_curve_share_words(spark, sf):
    """Documents that follow each other share more of their ids than documents of another order."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    order = [r.doc_id for r in packing.pack(docs, public_tokenizers.path(FILES[0])).where("start = 0").orderBy("sequence_id", "offset").select("doc_id").collect()]
    lang = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    same = lambda o: sum(lang[a] == lang[b] for a, b in zip(o, o[1:], strict=False))
    assert same(order) > same(sorted(order)) * 1.2


def test_empty_tables(none):
    assert packing.pack(none, public_tokenizers.path(FILES[0])).count() == 0
    assert token_files.token_digest(none, public_tokenizers.path(FILES[1])).count() == 0
