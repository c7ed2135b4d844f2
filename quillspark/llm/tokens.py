"""Token ids of whole texts, by the tokenizers library, with a bounded cache of words."""

from __future__ import annotations

import json
import os
import re
import sys
from array import array
from functools import lru_cache

import numpy as np

#: A word of Latin letters, then ASCII punctuation: two pre-tokens whose normal form is their lower case.
PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)")
#: Most words that a worker's cache holds; beyond it the cache starts anew.
CACHED = 300_000


def word_bpe() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_letters() -> dict[int, str]:
    """The letters by which byte-level vocabularies name bytes: printable ones themselves, the rest from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Encoder(dict):
    """Bytes of the little-endian ids (dtype) of each word between single spaces.

    The vocabulary's pre-tokens never span white space and drop it, so a text's ids are
    its words' ids in order. A plain word goes to the library's BPE model directly; any
    other goes through the library's whole pipeline. A text that holds the string of an
    added token goes through it as a whole, so that such a string is that token.
    """

    def __init__(self, path: str, most: int = CACHED):
        super().__init__()
        self.most = most
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        self.added = [x["content"] for x in said.get("added_tokens") or []]
        steps = [x["type"] for x in (said.get("normalizer") or {}).get("normalizers", [])]
        self.by_word = steps == ["NFC", "Replace", "Lowercase"]
        self.model = self.tokenizer.model if self.by_word else None
        self.size = self.tokenizer.get_vocab_size()
        self.dtype = np.dtype("<u2" if self.size <= 1 << 16 else "<u4")
        self.letters = byte_letters()
        self.pieces: dict[str, bytes] = {}
        self[""] = b""

    def packed(self, ids: list[int]) -> bytes:
        if sys.byteorder == "little":
            return array("H" if self.dtype.itemsize == 2 else "I", ids).tobytes()
        return np.asarray(ids, dtype=self.dtype).tobytes()

    def piece(self, text: str) -> bytes:
        """Packed ids of a normal pre-token; words differ in case and punctuation more than in these."""
        out = self.pieces.get(text)
        if out is None:
            plain = text if text.isascii() else text.encode().decode("latin-1").translate(self.letters)
            out = self.packed([x.id for x in self.model.tokenize(plain)])
            if len(text) <= 48:
                self.pieces[text] = out
        return out

    def __missing__(self, word: str) -> bytes:
        plain = PLAIN.fullmatch(word)
        if plain:
            head, tail = plain.groups()
            out = self.piece(head.lower())
            if tail:
                out += self.piece(tail)
        else:
            out = self.packed(self.tokenizer.encode(word, add_special_tokens=False).ids)
        if len(word) <= 48:
            self[word] = out
        return out

    def encode(self, text: str | None) -> bytes:
        """Packed ids of a whole text; none for a null or empty one."""
        if not text:
            return b""
        if not self.by_word or any(x in text for x in self.added):
            return self.packed(self.tokenizer.encode(text, add_special_tokens=False).ids)
        if len(self) > self.most:
            self.clear()
            self.pieces.clear()
            self[""] = b""
        return b"".join(map(self.__getitem__, text.replace("\n", " ").split(" ")))


@lru_cache(maxsize=2)
def encoder(path: str, most: int = CACHED) -> Encoder:
    """One encoder for each worker process, with a cache of `most` words."""
    return Encoder(path, most)
