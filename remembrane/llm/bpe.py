"""Byte-level BPE ids by the tokenizers library, with a memo of word units.

The pre-tokenizer's pattern never joins what lies on both sides of the units below: a space that stands between two
non-spaces always starts a pre-token, and of a run of white space before a non-space only the last character can attach
to what follows. So the ids of a text are the ids of its units in order, and each unit is encoded once per worker.
"""

from __future__ import annotations

import os
import re
from functools import lru_cache
from struct import pack

import numpy as np

from .common import KEPT

#: Unicode White_Space.
WHITE = "".join(map(chr, [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
UNITS = re.compile(f" ?[^{WHITE}]+|[{WHITE}]+(?=[{WHITE}][^{WHITE}])|[{WHITE}]+")
#: Units that are one pre-token of letters, then perhaps one of punctuation.
WORD = re.compile(r"( ?[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+|[!-&(-/:-@\[-`{-~]+)([!-&(-/:-@\[-`{-~]*)")
#: The sign that stands for each byte: itself where it prints, else the next free code point from 256 on.
PRINTS = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
SIGNS = {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in PRINTS)}
#: Units held at most; the memo starts anew beyond that.
MEMO = 1_000_000


class ByteBpe:
    """Encodes texts to packed little-endian ids; added tokens' strings in a text are those tokens, as for the library."""

    def __init__(self, name: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(name if os.path.sep in name else public_tokenizers.path(name))
        added = self.tokenizer.get_added_tokens_decoder()
        if any(t.lstrip or t.rstrip or t.single_word or t.normalized for t in added.values()) or self.tokenizer.normalizer is not None:
            raise ValueError("added tokens that take in what is around them, and normalizers, are not handled")
        self.added = {t.content: i for i, t in added.items()}
        self.split = re.compile("|".join(re.escape(t) for t in sorted(self.added, key=len, reverse=True))) if self.added else None
        self.vocab = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.dtype = np.dtype("<u2") if self.vocab <= 1 << 16 else np.dtype("<u4")
        encode, merge, dtype = self.tokenizer.encode, self.tokenizer.model.tokenize, self.dtype
        letter = "H" if dtype.itemsize == 2 else "I"

        class Memo(dict):
            def __missing__(self, unit):
                if len(unit) > 64:
                    return np.array(encode(unit, add_special_tokens=False).ids, dtype).tobytes()
                if not (m := WORD.fullmatch(unit)):
                    ids = np.array(encode(unit, add_special_tokens=False).ids, dtype).tobytes()
                elif m[2]:
                    ids = self[m[1]] + self[m[2]]
                else:  # one pre-token: straight to the library's merges
                    found = merge(unit.replace(" ", SIGNS[0x20]) if unit.isascii() else unit.encode().decode("latin-1").translate(SIGNS))
                    ids = pack(f"<{len(found)}{letter}", *[x.id for x in found])
                self[unit] = ids
                return ids

        self.memo = Memo()

    def encode(self, text: str) -> bytes:
        if len(self.memo) > MEMO:
            self.memo.clear()
        ids, at = [], 0
        for m in self.split.finditer(text) if self.split else ():
            ids += map(self.memo.__getitem__, UNITS.findall(text, at, m.start()))
            ids.append(np.array([self.added[m[0]]], self.dtype).tobytes())
            at = m.end()
        return b"".join(ids) + b"".join(map(self.memo.__getitem__, UNITS.findall(text, at)))


@lru_cache(maxsize=4)
def byte_bpe(name: str) -> ByteBpe:
    """One encoder per worker process, until another operator's task runs there."""
    KEPT["byte_bpe"] = byte_bpe.cache_clear
    return ByteBpe(name)
