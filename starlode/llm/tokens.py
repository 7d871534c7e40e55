"""Encoding whole texts with public byte-pair vocabularies, a distinct piece at a time.

A text's ids are those of its pieces (``textvec.pieces``) one after the other, so a task
encodes each distinct piece once and puts the ids together with array operations.
Vocabulary files are read where the caller says they are.
"""

from __future__ import annotations

import re
import struct
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from . import textvec as V

#: Distinct pieces that a worker remembers before it forgets all that its last texts don't have.
REMEMBERED = 250_000


def byte_letters() -> dict[int, str]:
    """The letter that byte-level vocabularies write for each byte: itself if printable, else the next one from 256 on."""
    plain = [b for b in range(256) if 33 <= b < 127 or 161 <= b < 256 and b != 173]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class PieceEncoder:
    """Ids of whole texts by a tokenizers file; ``kind`` is "byte" or "word" (see textvec.pieces).

    With ``added``, the file's added tokens get their own ids, as the library does at its defaults.
    """

    def __init__(self, path: str, kind: str, added: bool = False):
        from tokenizers import Tokenizer

        self.kind, self.letters = kind, byte_letters()
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.model._resize_cache(0)  # pieces come once; the cache would only cost
        tokens = self.tokenizer.get_added_tokens_decoder() if added else {}
        if any(t.normalized or t.lstrip or t.rstrip or t.single_word for t in tokens.values()):
            raise ValueError(f"{path}: added tokens other than literal ones")
        self.added = {t.content: i for i, t in tokens.items()}
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        # Pieces that are known, how many ids each has, and all their ids one behind the other.
        self.known, self.sizes, self.values = pa.array([], pa.string()), np.zeros(0, np.int64), np.zeros(0, "<u4")

    def piece(self, text: str) -> bytes:
        # Printable ASCII stands for itself; only a blank before it has another letter.
        if text.isascii() and text[1:].isalnum():
            text = self.letters[32] + text[1:] if text[0] == " " else text
            found = self.model.tokenize(text if text.isprintable() else self.written(text))
        else:
            found = self.model.tokenize(self.written(text))
        return struct.pack(f"<{len(found)}I", *[t.id for t in found])

    def written(self, text: str) -> str:
        return text.encode().decode("latin-1").translate(self.letters)

    def prepare(self, text: str) -> str:
        """What the word vocabulary's normaliser does, but for white space, which no piece holds: NFC, then each letter's lower case."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        return text.lower()

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids and each text's first (len+1); null texts are empty."""
        texts = [t or "" for t in column.to_pylist()]
        if not any(token in t for token in self.added for t in texts):
            return self.plain(texts)
        # What stands between added tokens is encoded as texts of their own.
        parts = [self.split.split(t) for t in texts]
        ids, first = self.plain([p for t in parts for p in t[::2]])
        out, sizes, at = [], [0], 0
        for text in parts:
            size = 0
            for i, part in enumerate(text):
                if i % 2:
                    own = np.array([self.added[part]], "<u4")
                else:
                    own = ids[first[at] : first[at + 1]]
                    at += 1
                out.append(own)
                size += len(own)
            sizes.append(size)
        return np.concatenate(out), np.cumsum(sizes)

    def plain(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """As encode, of texts in which no added token is told apart."""
        if self.kind == "word":
            texts = [self.prepare(t) for t in texts]
        array, first, keep = V.pieces(texts, self.kind == "byte")
        if self.kind == "word":  # white space has no ids
            array, first = array.filter(pa.array(keep)), np.concatenate([[0], np.cumsum(keep)])[first]
        coded = array.dictionary_encode()
        at = self.remember(coded.dictionary)
        order, sizes = coded.indices.to_numpy(zero_copy_only=False), self.sizes[at]
        total = np.concatenate([[0], np.cumsum(sizes[order])]).astype(np.int64)
        return V.gather(order, sizes, self.values, (np.cumsum(self.sizes) - self.sizes)[at]), total[first]

    def remember(self, pieces: pa.Array) -> np.ndarray:
        """The place of each piece among the known ones; those that are new are encoded first."""
        at = pc.index_in(pieces, value_set=self.known).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        new = np.flatnonzero(at < 0)
        if len(self.known) + len(new) > REMEMBERED:
            # Only what these texts have stays.
            old = np.flatnonzero(at >= 0)
            own = at[old]
            self.known, self.values = pieces.take(pa.array(old)), V.gather(own, self.sizes, self.values, np.cumsum(self.sizes) - self.sizes)
            self.sizes, at[old] = self.sizes[own], np.arange(len(old))
        if len(new):
            words = pieces.take(pa.array(new))
            ids = list(map(self.piece, words.to_pylist()))
            at[new] = len(self.known) + np.arange(len(new))
            self.known = pa.concat_arrays([self.known, words])
            self.sizes = np.append(self.sizes, np.fromiter(map(len, ids), np.int64, len(ids)) // 4)
            self.values = np.append(self.values, np.frombuffer(b"".join(ids), "<u4"))
        return at


@lru_cache(maxsize=2)
def encoder(path: str, kind: str) -> PieceEncoder:
    """A worker's encoder, kept between its tasks."""
    return PieceEncoder(path, kind, added=True)
