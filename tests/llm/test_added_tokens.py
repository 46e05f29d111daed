"""Strings of added tokens in texts: ids are those of the library as it comes."""

import json
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from quillon.llm import packing, token_files, tokens

FILES = ("byte_bpe_50k.json", "word_bpe_49k.json")


def texts_of(name):
    with open(public_tokenizers.path(name), encoding="utf-8") as f:
        added = [t["content"] for t in json.load(f)["added_tokens"]]
    rng = random.Random(5)
    out = ["a < b | c > d", "<|end", "of|>", ""]
    for mark in added:
        out += [mark, f"hello {mark} world", f"hello{mark}world", f"{mark}{mark}\n {mark} ", mark.upper(), mark[:-1], f"line\n{mark}\nline", f"é {mark} ü\tİ"]
    for _ in range(200):
        out.append("".join(rng.choice([*added, "word ", " and", "\n", "é", " ", "<|", "|>", "Up."]) for _ in range(rng.randint(1, 12))))
    return out


@pytest.mark.parametrize("name", FILES)
@pytest.mark.parametrize("as_text", [False, True])
def test_ids_are_the_librarys(name, as_text):
    plain = Tokenizer.from_file(public_tokenizers.path(name))
    if as_text:
        plain.encode_special_tokens = True
    enc = tokens.encoder(public_tokenizers.path(name), as_text)
    texts = texts_of(name)
    for text, ids in zip(texts, enc.encode(texts), strict=True):
        assert np.frombuffer(ids, enc.dtype).tolist() == plain.encode(text, add_special_tokens=False).ids, text


def test_queries_use_the_library_as_it_comes(spark):
    rows = list(enumerate(texts_of(FILES[0]) + texts_of(FILES[1])))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for name, end, found in ((FILES[1], 2, token_files.token_digest(docs, public_tokenizers.path(FILES[1]), 2)), (FILES[0], 0, None)):
        plain = Tokenizer.from_file(public_tokenizers.path(name))
        want = {i: np.array([*plain.encode(t, add_special_tokens=False).ids, end], "<u4") for i, t in rows}
        if found is not None:
            assert {r.doc_id: (r.n_tokens, r.ids_crc32) for r in found.collect()} == {i: (len(x), zlib.crc32(x.tobytes())) for i, x in want.items()}
        else:
            for r in packing.pack(docs, public_tokenizers.path(name)).collect():
                assert r.doc_tokens == len(want[r.doc_id]) and zlib.crc32(want[r.doc_id][r.start : r.start + r.length].tobytes()) == r.ids_crc32
