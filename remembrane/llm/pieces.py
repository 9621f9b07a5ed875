"""SentencePiece BPE by a table of each prefix's last token.

The BPE tokens of a prefix end in one certain token. A token that matches up to a place is that last token if it may
stand after the last token of the prefix before it: if encoding both strings together gives the two. So one pass over
an automaton's matches fills a table with the last token of every prefix, and the ids are read off it backwards.

Texts are taken apart where no piece of the vocabulary has the two characters next to each other: merges never cross
such a place. What lies between is encoded once per worker and remembered.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_pieces, KEPT, spread, whole_text

SPACE = "▁"
UNITS = re.compile(f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n")
MEMO = 1_000_000
PAIRS = 4_000_000


class PieceBpe:
    """Encodes and decodes as the library does, for BPE models with identity normalisation, byte fallback and a dummy prefix."""

    def __init__(self, name: str):
        import ahocorasick
        import public_tokenizers
        import sentencepiece

        path = name if os.path.sep in name else public_tokenizers.path(name)
        self.library = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        normal = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.rank = {sp.id_to_piece(i): (-sp.get_score(i), i) for i in normal}
        self.alphabet = {p for p in self.rank if len(p) == 1}
        self.joined = {p[k : k + 2] for p in self.rank for k in range(len(p) - 1)}
        if any(a != SPACE and b == SPACE for a, b in self.joined):
            raise ValueError("a piece goes on over a space; this model needs other units")
        self.bytes = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.text = {i: p for p, (_, i) in self.rank.items()}
        self.automaton = ahocorasick.Automaton()
        for piece, (_, i) in self.rank.items():
            if self.merge(piece) == [piece]:  # tokens that no text of their own gives can't be a last token
                self.automaton.add_word(piece, (len(piece), i))
        self.automaton.make_automaton()
        self.compatible: dict[tuple[int, int], bool] = {}
        encode_unit = self.encode_unit

        class Memo(dict):
            def __missing__(self, unit):
                ids = encode_unit(unit)
                found = ",".join(map(str, ids)), ids
                if len(unit) <= 64:
                    self[unit] = found
                return found

        self.memo = Memo()

    def merge(self, text: str) -> list[str]:
        """BPE by its definition: of all neighbours that make a piece, the best scored, leftmost one is merged, again and again."""
        parts = list(text)
        while True:
            best = min(((self.rank[p][0], k) for k in range(len(parts) - 1) if (p := parts[k] + parts[k + 1]) in self.rank), default=None)
            if best is None:
                return parts
            k = best[1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]

    def may_follow(self, a: int, b: int) -> bool:
        """Whether the two tokens' strings together are encoded as the two."""
        left, right = self.text[a], self.text[b]
        found = left[-1] + right[0] not in self.joined or self.merge(left + right) == [left, right]
        if len(self.compatible) >= PAIRS:
            self.compatible.clear()
        self.compatible[a, b] = found
        return found

    def encode_known(self, text: str) -> tuple[int, ...]:
        """ids of a text whose characters are all in the vocabulary."""
        last, length = [0] * (len(text) + 1), [0] * (len(text) + 1)
        compatible, may_follow = self.compatible, self.may_follow
        for end, (size, token) in self.automaton.iter(text):
            end += 1
            if not length[end]:
                start = end - size
                if start:
                    before = last[start]
                    ok = length[start] and compatible.get((before, token))
                    if ok is None:
                        ok = may_follow(before, token)
                    if not ok:
                        continue
                last[end], length[end] = token, size
        ids, at = [], len(text)
        while at:
            if not length[at]:
                raise ValueError(f"no token ends at {at} of {text!r}")
            ids.append(last[at])
            at -= length[at]
        return tuple(reversed(ids))

    def encode_unit(self, unit: str) -> tuple[int, ...]:
        """A unit in parts between which nothing merges; characters that no piece has become their bytes' ids."""
        cuts = [0, *(k for k in range(1, len(unit)) if unit[k - 1 : k + 1] not in self.joined), len(unit)]
        if len(cuts) > 2:
            return tuple(i for a, b in zip(cuts, cuts[1:], strict=False) for i in (self.memo[unit[a:b]][1] if b - a <= 64 else self.encode_unit(unit[a:b])))
        if len(unit) == 1 and unit not in self.alphabet:
            return tuple(self.bytes[b] for b in unit.encode())
        return self.encode_known(unit)

    def encode(self, text: str) -> tuple[str, list[int]]:
        """ids joined by commas, and as a list."""
        if not text:
            return "", []
        if len(self.memo) > MEMO:
            self.memo.clear()
        found = list(map(self.memo.__getitem__, UNITS.findall(SPACE + text.replace(" ", SPACE))))
        return ",".join([x[0] for x in found]), [i for x in found for i in x[1]]

    def decode(self, ids: list[list[int]]) -> list[str]:
        return self.library.decode(ids)


@lru_cache(maxsize=4)
def piece_bpe(name: str) -> PieceBpe:
    """One encoder per worker process, until another operator's task runs there."""
    KEPT["piece_bpe"] = piece_bpe.cache_clear
    return PieceBpe(name)


def encode(docs: DataFrame, model: str, with_ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, and with_ids also ids and decoded, for every row of docs.

    docs: doc_id, text; other columns are left out. Null text is empty and has no ids; a null doc_id and repeated rows
    stay. Whole texts are encoded, without begin or end ids.
    """
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"][: 6 if with_ids else 4]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = piece_bpe(model)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        for b in arrow_pieces(batches, "text", keeps="piece_bpe"):
            found = [bpe.encode(t) for t in b.column("text").to_pylist()]
            decoded = bpe.decode([ids for _, ids in found])
            columns = [b.column("doc_id"), pa.array([len(ids) for _, ids in found], pa.int64()), pa.array([sha(s) for s, _ in found]), pa.array([sha(t) for t in decoded])]
            if with_ids:
                columns += [pa.array([ids for _, ids in found], pa.list_(pa.int32())), pa.array(decoded)]
            yield pa.RecordBatch.from_arrays(columns, names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text(docs).alias("text"))
    kinds = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>, decoded string" if with_ids else "")
    return spread(rows).mapInArrow(run, kinds)
