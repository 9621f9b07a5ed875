"""Quality classifier: a generalised additive model with pairwise interactions.

Features are counts and shares taken from the bytes of a text. Each feature is cut into bins at quantiles. Boosting goes
round all features in turn; each time a tree of at most three leaves over one feature's bins is fitted to the gradient
and added to that feature's lookup table. Then pairs whose residuals interact most get tables of their own, boosted by
trees of two cuts. A score is a sum of table entries.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import PolyHash, arrow_pieces, crc_mod, materialize, segment_sums, spread, text_bytes, whole_text, word_spans

#: Labelled rows that the model is fitted on at most, chosen by a hash of doc_id.
MAX_TRAIN = 120_000
BINS, COARSE, ROUNDS, PAIR_ROUNDS, PAIRS, RATE, RIDGE = 32, 8, 60, 30, 8, 0.15, 5.0

KINDS = {
    "lower": range(97, 123), "upper": range(65, 91), "digit": range(48, 58), "space": (32,), "newline": (10,), "other_space": (9, 11, 12, 13),
    "stop": b".!?", "comma": b",;:'\"-()", "bar": b"|", "symbol": b"#$%&*+/<=>@[\\]^_`{}~", "control": (*range(9), *range(14, 32), 127), "high": range(128, 256),
}
LUT = np.zeros(256, np.uint8)
for _i, _bytes in enumerate(KINDS.values()):
    LUT[list(_bytes)] = _i
NAMES = [
    "log_bytes", "log_words", "word_length", *(f"share_{k}" for k in KINDS), "same_as_last", "distinct_words", "distinct_lines", "line_length", "lines_stopped",
    "words_end_symbol", "words_end_stop", "words_no_letter", "words_capital", "longest_word", "distinct_triples",
]


def distinct_share(keys: np.ndarray, owner: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Distinct keys over keys, by owner (ascending); 1 where there are none."""
    mixed = np.sort((keys & np.uint64(0xFFFFFFFFFF)) | (owner.astype(np.uint64) << np.uint64(40)))
    first = np.ones(len(mixed), bool)
    first[1:] = mixed[1:] != mixed[:-1]
    found = np.bincount((mixed[first] >> np.uint64(40)).astype(np.int64), minlength=len(counts))
    return np.where(counts > 0, found / np.maximum(counts, 1), 1.0)


def features(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of float32 a text, columns as in NAMES; an empty text has zeros, and ones for the distinct shares."""
    n, size = len(offsets) - 1, np.diff(offsets)
    kinds, per = LUT[raw], np.maximum(size, 1)
    starts, ends, first = word_spans(raw, offsets)
    words = np.diff(first)
    each = np.maximum(words, 1)
    shares = [segment_sums(kinds == i, offsets) / per for i in range(len(KINDS))]
    same = np.zeros(len(raw), bool)
    same[1:] = raw[1:] == raw[:-1]
    same[offsets[:-1][size > 0]] = False  # a text's first byte follows none
    hashes = PolyHash(raw)
    word = hashes.of(starts, ends)
    owner = np.repeat(np.arange(n), words)
    last = kinds[ends - 1] if len(ends) else np.zeros(0, np.uint8)
    at = {k: i for i, k in enumerate(KINDS)}
    letter = np.isin(kinds, [at["lower"], at["upper"], at["high"]])
    letters = np.concatenate([[0], np.cumsum(letter)])
    of_words = lambda x: segment_sums(x, first) / each
    # lines
    line_ends = np.flatnonzero(raw == 10)
    line_starts = np.unique(np.concatenate([offsets[:-1][size > 0], line_ends + 1]))
    line_starts = line_starts[line_starts < len(raw)]
    stops = np.append(line_starts[1:], len(raw))
    trimmed = np.where((stops > line_starts) & (raw[np.maximum(stops - 1, 0)] == 10), stops - 1, stops) if len(raw) else stops
    full = trimmed > line_starts
    line_starts, trimmed = line_starts[full], trimmed[full]
    line_first = np.searchsorted(line_starts, offsets)
    lines = np.diff(line_first)
    line_owner = np.repeat(np.arange(n), lines)
    stopped = kinds[trimmed - 1] == at["stop"] if len(trimmed) else np.zeros(0, bool)
    triple = word[:-2] * np.uint64(3) + word[1:-1] * np.uint64(5) + word[2:] * np.uint64(7) if len(word) > 2 else np.zeros(0, np.uint64)
    inside = owner[:-2] == owner[2:] if len(word) > 2 else np.zeros(0, bool)
    triple, triple_owner = triple[inside], owner[:-2][inside] if len(word) > 2 else np.zeros(0, np.int64)
    longest = np.zeros(n)
    np.maximum.at(longest, owner, ends - starts)
    columns = [
        np.log1p(size), np.log1p(words), (size - segment_sums(kinds == at["space"], offsets)) / each, *shares, segment_sums(same, offsets) / per,
        distinct_share(word, owner, words), distinct_share(hashes.of(line_starts, trimmed), line_owner, lines), np.log1p(size / np.maximum(lines, 1)), segment_sums(stopped, line_first) / np.maximum(lines, 1),
        of_words(last == at["symbol"]), of_words(last == at["stop"]), of_words(letters[ends] == letters[starts]), of_words(kinds[starts] == at["upper"]), np.log1p(longest),
        distinct_share(triple, triple_owner, np.bincount(triple_owner, minlength=n)),
    ]
    return np.stack(columns, axis=1).astype(np.float32)


@dataclass
class Gam:
    """Lookup tables; `score` adds their entries and maps the sum to 0..1."""

    base: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def bins(self, x: np.ndarray) -> list[np.ndarray]:
        return [np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(self.edges)]

    def score(self, x: np.ndarray) -> np.ndarray:
        bins, total = self.bins(x), np.full(len(x), self.base)
        for b, table in zip(bins, self.tables, strict=True):
            total += table[b]
        for f, g, table in self.pairs:
            total += table[self.coarse[f][bins[f]], self.coarse[g][bins[g]]]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def leaf(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g / (h + RIDGE)


def best_cut(g: np.ndarray, h: np.ndarray) -> tuple[float, int]:
    """Gain and place of the best cut of bins in two."""
    a, b = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gain = a * leaf(a, b) + (g.sum() - a) * leaf(g.sum() - a, h.sum() - b) - g.sum() * leaf(g.sum(), h.sum())
    k = int(np.argmax(gain))
    return float(gain[k]), k + 1


def shallow_tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Leaf values by bin of a tree of two leaves, or three where a second cut helps."""
    cuts = [0, len(g)]
    for _ in range(2):
        options = [(*best_cut(g[a:b], h[a:b]), a) for a, b in zip(cuts, cuts[1:], strict=False) if b - a > 1]
        gain, k, a = max(options, default=(0.0, 0, 0))
        if gain <= 1e-9:
            break
        cuts = sorted([*cuts, a + k])
    out = np.zeros(len(g))
    for a, b in zip(cuts, cuts[1:], strict=False):
        out[a:b] = leaf(g[a:b].sum(), h[a:b].sum())
    return out


def pair_tree(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """Gain and leaf values over a grid of the best tree that cuts both features once."""
    cg, ch = (np.pad(x.cumsum(0).cumsum(1), ((1, 0), (1, 0))) for x in (g, h))
    n, m = g.shape
    best, at = -1.0, (1, 1)
    for i in range(1, n):
        for j in range(1, m):
            gain = 0.0
            for a, b in ((0, i), (i, n)):
                for c, d in ((0, j), (j, m)):
                    x, y = (z[b, d] - z[a, d] - z[b, c] + z[a, c] for z in (cg, ch))
                    gain += x * x / (y + RIDGE)
            if gain > best:
                best, at = gain, (i, j)
    out = np.zeros_like(g)
    for rows in (slice(0, at[0]), slice(at[0], n)):
        for cols in (slice(0, at[1]), slice(at[1], m)):
            out[rows, cols] = leaf(g[rows, cols].sum(), h[rows, cols].sum())
    return best, out


def fit(x: np.ndarray, y: np.ndarray) -> Gam:
    """Cyclic boosting of log loss. No rows: every score 0.5; one class only: a constant near it."""
    model = Gam(base=float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))))
    if len(y) == 0 or y.min() == y.max():
        return model
    for f in range(x.shape[1]):
        edges = np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1]))
        model.edges.append(edges)
        model.coarse.append((np.arange(len(edges) + 1) * COARSE // (len(edges) + 1)).astype(np.int64))
        model.tables.append(np.zeros(len(edges) + 1))
    bins = model.bins(x)
    total = np.full(len(y), model.base)

    def gradient() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        return y - p, p * (1 - p)

    for _ in range(ROUNDS):
        for f, b in enumerate(bins):
            if len(model.tables[f]) > 1:
                g, h = gradient()
                step = RATE * shallow_tree(*(np.bincount(b, weights=w, minlength=len(model.tables[f])) for w in (g, h)))
                model.tables[f] += step
                total += step[b]
    coarse = [c[b] for c, b in zip(model.coarse, bins, strict=True)]
    grid = lambda f, k, w: np.bincount(coarse[f] * COARSE + coarse[k], weights=w, minlength=COARSE * COARSE).reshape(COARSE, COARSE)
    g, h = gradient()
    gains = []
    for f in range(len(bins)):
        for k in range(f):
            a, b = grid(f, k, g), grid(f, k, h)
            gains.append((float((a * leaf(a, b)).sum()), f, k))
    model.pairs = [(f, k, np.zeros((COARSE, COARSE))) for _, f, k in sorted(gains, reverse=True)[:PAIRS]]
    for _ in range(PAIR_ROUNDS):
        for f, k, table in model.pairs:
            g, h = gradient()
            step = RATE * pair_tree(grid(f, k, g), grid(f, k, h))[1]
            table += step
            total += step[coarse[f], coarse[k]]
    return model


def text_features(docs: DataFrame) -> DataFrame:
    """doc_id and x, the features of the whole text (null: empty)."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in arrow_pieces(batches, "text"):
            x = features(*text_bytes(b.column("text")))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), lists], ["doc_id", "x"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text(docs).alias("text"))
    return spread(rows).mapInArrow(compute, "doc_id long, x array<float>")


def sample_labels(labels: DataFrame, label: str = "quality", most: int = MAX_TRAIN, held_out: int = 0) -> DataFrame:
    """doc_id, y of labelled documents whose crc32(doc_id) mod 5 is not held_out; about `most` at most, chosen by a hash of doc_id.

    Null labels are left out; of several labels of one document the mean counts, rounded.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & (crc_mod("doc_id", 5) != held_out))
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.avg(label) >= 0.5).cast("int").alias("y"))
    share = most / max(1, known.count())
    if share < 1:
        known = known.where(F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    return known


def train(rows: DataFrame, known: DataFrame) -> Gam:
    """Fit on the features (doc_id, x) of the documents in known (doc_id, y); of repeated documents one."""
    sample = rows.join(F.broadcast(known), "doc_id").groupBy("doc_id").agg(F.min(F.struct("y", "x")).alias("s")).orderBy("doc_id").select("s.y", "s.x").toArrow()
    x = sample.column("x").combine_chunks()
    x = x.flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(len(sample), len(NAMES)) if len(sample) else np.zeros((0, len(NAMES)), np.float32)
    return fit(x, sample.column("y").to_numpy().astype(np.float64))


def score(rows: DataFrame, model: Gam) -> DataFrame:
    """doc_id and score of each row of features; the model is a few thousand numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column("x")
            m = x.values.to_numpy()[x.offsets[0].as_py() : x.offsets[-1].as_py()].reshape(-1, len(NAMES))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(model.score(m))], ["doc_id", "score"])

    return rows.mapInArrow(run, "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame, label: str = "quality", threshold: float = 0.3, most: int = MAX_TRAIN) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs.

    Only the text makes a score. Null and empty texts are scored, too; a null doc_id is held out (crc32 of no bytes is
    0); repeated rows are scored each. Columns besides doc_id and text are left out.
    """
    rows = materialize(text_features(docs), "features")
    scored = score(rows, train(rows, sample_labels(labels, label, most)))
    return scored.select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, label: str = "quality", threshold: float = 0.3, most: int = MAX_TRAIN) -> DataFrame:
    """The rows of docs, all columns, whose score is at least threshold; trained on labels as `classify` is."""
    known = materialize(sample_labels(labels, label, most), "labels")
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(known.select("doc_id")), "doc_id", "left_semi")
    model = train(text_features(own), known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = b.column("text").fill_null("")
            marked = pa.RecordBatch.from_arrays([text, pa.array(np.arange(b.num_rows))], ["text", "row"])
            kept = [p.column("row").filter(pa.array(model.score(features(*text_bytes(p.column("text")))) >= threshold)) for p in arrow_pieces(iter([marked]), "text")]
            yield b.take(pa.concat_arrays(kept)) if kept else b

    return spread(docs).mapInArrow(run, docs.schema)
