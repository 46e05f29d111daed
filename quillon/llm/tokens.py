"""Exact, memoised use of a public tokenizer file.

A text is cut where the tokenizer's own pre-tokenizer is bound to cut it, each different
piece is encoded once per worker by the ``tokenizers`` library, and the ids of the pieces are
joined. Where a text has white space that could tie pieces together, or the string of an added token, the library encodes
the whole text instead, so ids are the library's own in every case.
"""

from __future__ import annotations

import json
from array import array
from functools import lru_cache

import numpy as np

#: Pieces that one worker remembers; the memo starts anew beyond it (about 200 bytes each).
MEMO_PIECES = 400_000
#: Texts whose pieces are looked up together.
BATCH_TEXTS = 500
#: Marks that may follow a word of letters; a run of them is one pre-token of either pattern.
MARKS = ".,;:!?$%&*#|"
#: Up to here letters have a lower case that does not depend on their neighbours, and are NFC as they stand.
LAST_PLAIN = "\u024f"
#: The byte-level alphabet: printable Latin-1 bytes stand for themselves, the others follow from 256 in order.
_PRINTABLE = {*range(33, 127), *range(161, 173), *range(174, 256)}
SPACE_SYMBOL = "\u0120"
BYTE_SYMBOLS = {b: 256 + n for n, b in enumerate(b for b in range(256) if b not in _PRINTABLE)}


def _lowered(text: str) -> str:
    """Lower case where that cannot depend on neighbours (Latin-1), so that fewer pieces differ; else the text."""
    if not text.isascii():
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return text
    return text.lower()


class PieceEncoder:
    """Ids of whole texts as little-endian unsigned integers of ``width`` bytes.

    The string of an added token in a text has that token's id, as the library gives it; with ``special_as_text`` it is ordinary text.
    """

    def __init__(self, path: str, special_as_text: bool = False):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = special_as_text
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        added = [t for t in spec.get("added_tokens") or [] if t["content"]]
        #: strings that the library looks for in a text before all else, or in its normalized form: pieces, which are cut and lowered, can't tell
        self.marks = tuple(t["content"].lower() for t in added if not (special_as_text and t.get("special")))
        self.first_marks = {c for m in self.marks for c in (m[0], m[0].upper())}
        self.width = 2 if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4
        self.dtype = np.dtype(f"<u{self.width}")
        kinds = [n.get("type") for n in ((spec.get("normalizer") or {}).get("normalizers") or [])]
        pre = (spec.get("pre_tokenizer") or {}).get("type")
        if spec.get("normalizer") is None and pre == "ByteLevel" and not spec["pre_tokenizer"].get("add_prefix_space"):
            self.mode = "spaced"  # a word takes the single space before it
        elif kinds == ["NFC", "Replace", "Lowercase"] and pre == "Sequence":
            self.mode = "loose"  # white space only parts words and leaves no ids
        else:
            self.mode = "whole"
        self.memo: dict[str, bytes] = {}
        self.typecode = "H" if self.width == 2 else "I"
        tails = [m * n for m in MARKS for n in (1, 2, 3)] + [a + m * n for a in ".," for m in MARKS for n in (1, 2, 3)]
        self.tails = dict(zip(tails, self._library(tails), strict=True))
        self.break_ids = self._library(["\n"])[0] if self.mode == "spaced" else b""

    def _marked(self, text: str) -> bool:
        if not any(c in text for c in self.first_marks):
            return False
        low = text.lower()
        return any(m in low for m in self.marks)

    def _library(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype=self.dtype).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, new: list[str]) -> None:
        """Puts the ids of pieces into the memo; None for those whose white space may tie them to their neighbours."""
        memo, model, tails, rest = self.memo, self.tokenizer.model.tokenize, self.tails, []
        spaced = self.mode == "spaced"
        for p in new:
            core = p.rstrip(MARKS)
            word = core[1:] if spaced and core[:1] == "\n" else core
            tail = p[len(core) :]
            plain = word.isascii()
            if not word.isalpha() or (tail and tail not in tails) or not plain and (max(word) > LAST_PLAIN or "\u0130" in word):
                rest.append(p)
                continue
            if not spaced:
                word = word.lower()
            ids = memo.get(word) if len(word) == len(core) else None
            if ids is not None:  # the word is known without its marks
                memo[p] = ids + tails[tail] if tail else ids
                continue
            symbols = word if plain else word.encode().decode("latin-1").translate(BYTE_SYMBOLS)
            if spaced and len(word) == len(core):
                symbols = SPACE_SYMBOL + symbols
            ids = array(self.typecode, [t.id for t in model(symbols)]).tobytes()
            if len(word) < len(core):
                ids = self.break_ids + ids
            memo[p] = ids + tails[tail] if tail else ids
        texts = []
        for p in rest:
            if spaced:
                word = p[1:] if p[:1] == "\n" else p
                if not word or word[0].isspace() or word[-1].isspace():
                    memo[p] = None
                    continue
                p = p if len(word) < len(p) else " " + p
            texts.append(p)
        for p, ids in zip([p for p in rest if p not in memo], self._library(texts), strict=True):
            memo[p] = ids

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """One byte string of ids for each text; none for null or empty ones."""
        out: list[bytes] = []
        for at in range(0, len(texts), BATCH_TEXTS):
            out += self._batch(texts[at : at + BATCH_TEXTS])
        return out

    def _batch(self, texts: list[str | None]) -> list[bytes]:
        if self.mode == "whole":
            return [self._library([t])[0] if t else b"" for t in texts]
        spaced = self.mode == "spaced"
        if spaced:
            cuts = [(t or "").replace("\n", " \n").split(" ") for t in texts]
        else:
            cuts = [_lowered(t or "").replace("\n", " ").split(" ") for t in texts]
        firsts = [c.pop(0) if spaced else "" for c in cuts]
        new = set().union(*cuts) - self.memo.keys()
        if len(self.memo) + len(new) > MEMO_PIECES:
            self.memo = {}
            new = set().union(*cuts)
        self._learn(list(new))
        get, out = self.memo.__getitem__, []
        heads = self._library(firsts) if spaced else [b""] * len(texts)
        for text, first, head, cut in zip(texts, firsts, heads, cuts, strict=True):
            if not text:
                out.append(b"")
                continue
            try:
                if self._marked(text):
                    raise TypeError
                if spaced and (not first or first[0].isspace() or first[-1].isspace()):
                    raise TypeError
                out.append(head + b"".join(map(get, cut)))
            except TypeError:  # a piece is tied or an added token's string is there: the library takes the whole text
                out.append(self._library([text])[0])
        return out


@lru_cache(maxsize=4)
def encoder(path: str, special_as_text: bool = False) -> PieceEncoder:
    """The encoder of a file, one for each worker process."""
    return PieceEncoder(path, special_as_text)
