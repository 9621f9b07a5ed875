"""License scans by a positional index of rare words.

Notices are templates; the index maps a word to its places in templates. Of each template's words that a file has, the three
of highest IDF (document frequencies come from all files) look up the file's places and the template's; what they have in
common is a relative position, file place less template place. Relative positions on which two words agree are compared
word by word, and a label is given where enough words stand in place and every key phrase of the notice stands close by.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import PolyHash, arrow_pieces, spread, text_bytes, whole_text, word_spans

#: Phrases whose places are all reported, with their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Wording of public license notices: label, notice, phrases that must stand in it. Fixed values.
NOTICES = [
    ("mit", "released under the MIT License", ["mit license"]),
    ("mit", "licensed under the MIT License", ["mit license"]),
    ("mit", "permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", ["hereby granted free of charge", "associated documentation files"]),
    ("apache-2.0", "licensed under the Apache License, Version 2.0", ["apache license version 2 0"]),
    ("gpl-3.0", "licensed under the GNU General Public License, version 3", ["gnu general public license", "version 3"]),
    ("gpl-2.0", "licensed under the GNU General Public License, version 2", ["gnu general public license", "version 2"]),
    ("gpl-2.0", "GNU General Public License as published by the Free Software Foundation; either version 2 of the License", ["general public license", "version 2 of the license"]),
    ("gpl-3.0", "GNU General Public License as published by the Free Software Foundation, either version 3 of the License", ["general public license", "version 3 of the license"]),
    ("lgpl", "licensed under the GNU Lesser General Public License", ["lesser general public license"]),
    ("agpl", "licensed under the GNU Affero General Public License", ["affero general public license"]),
    ("cc-by-4.0", "licensed under CC BY 4.0", ["cc by 4 0"]),
    ("cc-by-nc", "licensed under CC BY-NC 4.0", ["cc by nc"]),
    ("cc-by-sa", "licensed under CC BY-SA 4.0", ["cc by sa"]),
    ("cc-by-nd", "licensed under CC BY-ND 4.0", ["cc by nd"]),
    ("cc-by-4.0", "licensed under a Creative Commons Attribution 4.0 International License", ["creative commons attribution 4 0"]),
    ("cc-by-sa", "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", ["creative commons attribution sharealike"]),
    ("cc-by-nc", "licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", ["creative commons attribution noncommercial"]),
    ("bsd", "redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", ["source and binary forms", "with or without modification"]),
    ("isc", "permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted", ["with or without fee", "hereby granted"]),
    ("mpl-2.0", "subject to the terms of the Mozilla Public License, v. 2.0", ["mozilla public license"]),
    ("epl-2.0", "made available under the terms of the Eclipse Public License 2.0", ["eclipse public license"]),
    ("unlicense", "this is free and unencumbered software released into the public domain", ["free and unencumbered software"]),
]
#: Rare words that look a template up, words that must agree on a relative position, share of words in place, and how far outside a key phrase may stand.
RARE, AGREE, SHARE, SLACK = 3, 2, 0.6, 3

LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20
#: Bytes between words: ASCII that is neither a letter nor a digit.
BETWEEN = np.array([b < 0x80 and not chr(b).isalnum() for b in range(256)])


def words_of(text: str) -> list[str]:
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text))


@dataclass
class Template:
    label: str
    words: np.ndarray
    keys: list[np.ndarray]


class Index:
    """Words of all templates and base phrases by number, and the templates in these numbers."""

    def __init__(self, notices: list[tuple[str, str, list[str]]], base: dict[str, str]):
        texts = [*base, *[t for _, notice, keys in notices for t in (notice, *keys)]]
        self.words = sorted({w for t in texts for w in words_of(t)})
        number = {w: i for i, w in enumerate(self.words)}
        ids = lambda text: np.array([number[w] for w in words_of(text)], np.int64)
        self.base = [(label, ids(phrase)) for phrase, label in base.items()]
        self.templates = [Template(label, ids(notice), [ids(k) for k in keys]) for label, notice, keys in notices]
        coded = [w.encode() for w in self.words]
        self.longest = max(map(len, coded), default=1)
        self.letters = np.zeros((len(coded), self.longest), np.uint8)
        for i, w in enumerate(coded):
            self.letters[i, : len(w)] = np.frombuffer(w, np.uint8)
        self.lengths = np.array([len(w) for w in coded], np.int64)
        raw = np.frombuffer(b"".join(coded), np.uint8)
        ends = np.cumsum(self.lengths)
        hashes = PolyHash(raw).of(ends - self.lengths, ends)
        self.order = np.argsort(hashes)
        self.hashes = hashes[self.order]

    def read(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Number of every word of every text (-1: in no template), and where each text's words begin, with the end last."""
        raw, offsets = text_bytes(texts)
        raw = LOWER[raw]
        starts, ends, first = word_spans(raw, offsets, BETWEEN)
        if not len(starts) or not self.words:
            return np.full(len(starts), -1, np.int64), first
        hashes = PolyHash(raw).of(starts, ends)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        hit = np.flatnonzero(self.hashes[at] == hashes)
        number = self.order[at[hit]]
        size = ends[hit] - starts[hit]
        cells = np.minimum(starts[hit, None] + np.arange(self.longest), len(raw) - 1)
        found = np.where(np.arange(self.longest) < size[:, None], raw[cells], 0)
        same = (size == self.lengths[number]) & (found == self.letters[number]).all(axis=1)
        out = np.full(len(starts), -1, np.int64)
        out[hit[same]] = number[same]
        return out, first


def phrase_places(words: np.ndarray, phrase: np.ndarray) -> np.ndarray:
    """Where the phrase's words stand one after another."""
    n = len(words) - len(phrase) + 1
    if n < 1 or not len(phrase):
        return np.zeros(0, np.int64)
    at = np.flatnonzero(words[:n] == phrase[0])
    for j in range(1, len(phrase)):
        at = at[words[at + j] == phrase[j]]
    return at


def aligned(words: np.ndarray, template: Template, idf: np.ndarray, places: dict[int, np.ndarray]) -> list[tuple[int, float]]:
    """Relative positions at which the template stands in the file, with the share of its words in place."""
    present = [w for w in sorted(set(template.words.tolist()), key=lambda w: (-idf[w], w)) if w in places][:RARE]
    shifts = [np.unique((places[w][:, None] - np.flatnonzero(template.words == w)).ravel()) for w in present]
    shift, votes = np.unique(np.concatenate(shifts), return_counts=True) if shifts else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    shift = shift[votes >= min(AGREE, len(present))]
    n = len(template.words)
    found = np.zeros(len(shift))
    for j in range(n):
        at = shift + j
        inside = (at >= 0) & (at < len(words))
        found[inside] += words[at[inside]] == template.words[j]
    shift, found = shift[found >= SHARE * n], found[found >= SHARE * n]
    for key in template.keys:
        at = phrase_places(words, key)
        after = np.searchsorted(at, shift - SLACK)
        close = after < len(at)
        close[close] = at[after[close]] + len(key) <= shift[close] + n + SLACK
        shift, found = shift[close], found[close]
    return [(int(s), float(f / n)) for s, f in zip(shift, found, strict=True)]


def frequencies(index: Index, docs: DataFrame) -> tuple[np.ndarray, int]:
    """How many documents have each word of the index, and how many there are: as many numbers as templates have words."""
    width = len(index.words)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width + 1, np.int64)
        for batch in arrow_pieces(batches, "text"):
            words, first = index.read(batch.column("text"))
            row = np.repeat(np.arange(batch.num_rows), np.diff(first))
            known = words >= 0
            pairs = np.unique(row[known] * width + words[known])
            total[:width] += np.bincount(pairs % width, minlength=width) if len(pairs) else 0
            total[width] += batch.num_rows
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width + 1)), pa.array(total)], ["word", "docs"])

    rows = docs.select(whole_text(docs).alias("text")).mapInArrow(count, "word long, docs long").groupBy("word").agg(F.sum("docs").alias("docs")).collect()
    out = np.zeros(width + 1, np.int64)
    for r in rows:
        out[r["word"]] = r["docs"]
    return out[:width], int(out[width])


SCAN = pa.schema([
    ("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()),
    ("matches", pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("share", pa.float64())]))),
])
SCAN_DDL = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, matches array<struct<label string, start long, end long, share double>>"


def scan_text(words: np.ndarray, index: Index, idf: np.ndarray) -> tuple:
    """The columns of SCAN after doc_id for one file's words by number."""
    known = np.flatnonzero(words >= 0)
    base, base_at, matches = set(), [], []
    if len(known):
        ids = words[known]
        by_id = np.argsort(ids, kind="stable")
        cuts = np.flatnonzero(np.diff(ids[by_id])) + 1
        places = {int(words[g[0]]): g for g in np.split(known[by_id], cuts)}
        for label, phrase in index.base:
            if len(at := phrase_places(words, phrase)):
                base.add(label)
                base_at.append(at)
        for t in index.templates:
            if all(int(w) in places for key in t.keys for w in key):
                matches += [{"label": t.label, "start": max(s, 0), "end": min(s + len(t.words), len(words)), "share": share} for s, share in aligned(words, t, idf, places)]
    places_of_base = np.concatenate(base_at) if base_at else np.zeros(0, np.int64)
    n = len(places_of_base)
    labels = base | {m["label"] for m in matches}
    score = 1.0 if n else max((m["share"] for m in matches), default=0.0)
    return len(words), n, int(places_of_base.min()) if n else None, int(places_of_base.max()) if n else None, ",".join(sorted(base)), ",".join(sorted(labels)), score, matches


def scan_licenses(docs: DataFrame, notices: list[tuple[str, str, list[str]]] | None = None, base: dict[str, str] | None = None) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, matches of every document.

    docs: doc_id, text; other columns are left out. Null text counts as empty; a document without words has no labels, a
    score of 0 and null places; a null doc_id and repeated rows stay as they are. matches are the notices found: label,
    first word, end (exclusive) and the share of the notice's words in place; score is the highest share, or 1 where a base
    phrase stands. Texts of any length are read whole; files are independent, so nothing is shuffled but counts of words.
    Words of equal IDF go by their spelling.
    """
    index = Index(NOTICES if notices is None else notices, BASE if base is None else base)
    docs = spread(docs)
    having, total = frequencies(index, docs)
    idf = np.log((total + 1) / (having + 1))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrow_pieces(batches, "text"):
            words, first = index.read(batch.column("text"))
            rows = [scan_text(words[a:b], index, idf) for a, b in zip(first[:-1], first[1:], strict=True)]
            columns = [batch.column("doc_id"), *[pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), list(SCAN)[1:], strict=True)]]
            yield pa.RecordBatch.from_arrays(columns, schema=SCAN)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text(docs).alias("text")).mapInArrow(scan, SCAN_DDL)
