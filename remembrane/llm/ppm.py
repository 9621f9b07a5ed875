"""Language-model scores by prediction by partial matching over bytes.

A text becomes a stream of symbols: its lower-cased words, one space between, and an end. The training documents' counts
of (ORDER bytes of context, symbol) hold the trie of all contexts up to that length. A symbol is coded in the longest
context that was seen in training; there it has its count less a half, and half a count for each distinct symbol goes to
escaping (method D); after an escape the symbols of the longer context are excluded from the shorter one's counts. Below
all contexts, the symbols that are left are equally likely. That is done from several orders down, and the probabilities
are mixed by BLEND, as the longest context alone is sure of too little text. Last, what the document itself had after the
same context so far counts as well: the mixture stands for ADAPT earlier symbols there. All three keep a distribution.

Work is done in blocks, the splits of the input. A block's distinct keys (contexts with symbol; words, for the unigram
base) go out with their training counts, packed, to the partitions of a hash of the key; there they are summed over all
blocks. Words' totals go back to the blocks that asked. Grams are dealt to tasks by their three nearest bytes of context;
what the model needs of shorter contexts is in the counts of three bytes, which are at most 2**24. Grams are few beside
the text (a table whose growth slows with the corpus): their probabilities are sent to all tasks if they are at most
MAX_SENT, in pieces of about PIECE that the driver holds one at a time, else looked up like words.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import PolyHash, arrow_pieces, crc_mod, input_parts, let_go, materialize, mix64, spread, text_bytes, whole_text, word_spans
from .minhash import LOWER

ORDER = 6
#: Weights of the orders that coding begins at.
BLEND = {2: 0.02, 3: 0.08, 4: 0.2, 5: 0.3, 6: 0.4}
#: How many symbols of the document itself the model weighs as much as.
ADAPT = 10.0
#: Grams that are sent to every task at most (16 bytes each).
MAX_SENT = 8_000_000
#: About how many of them pass through the driver at a time.
PIECE = 500_000
#: Keys that a task gathers before it adds them up.
SQUEEZE = 3_000_000
#: Bytes that can stand in a stream: all but four kinds of white space.
SYMBOLS = 252
GRAM, WORD = 0, 1
PACKED = "kind int, block long, part int, keys binary, counts binary"


def symbol_stream(raw: np.ndarray, offsets: np.ndarray, order: int = ORDER) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Grams of all texts' streams (context bytes above, symbol in the low byte), where each text's begin (end last);
    hashes of their words, and where each text's begin."""
    low = LOWER[raw]
    starts, ends, first = word_spans(raw, offsets)
    words, sizes = np.diff(first), ends - starts
    total = np.concatenate([[0], np.cumsum(sizes)])
    symbols = total[first[1:]] - total[first[:-1]] + np.maximum(words, 1)
    begins = np.concatenate([[0], np.cumsum(symbols)])
    docs = len(symbols)
    stream = np.full(begins[-1] + order * docs, 10, np.uint8)  # each text has `order` ends before it as context
    owner = np.repeat(np.arange(docs), words)
    place = begins[owner] + order * (owner + 1) + (total[:-1] - total[first[:-1]][owner]) + (np.arange(len(starts)) - first[:-1][owner])
    index = np.arange(total[-1])
    stream[index + np.repeat(place - total[:-1], sizes)] = low[index + np.repeat(starts - total[:-1], sizes)]
    inner = np.ones(len(starts), bool)
    inner[first[1:][words > 0] - 1] = False
    stream[(place + sizes)[inner]] = 32
    grams = np.zeros(max(len(stream) - order, 0), np.uint64)
    for i in range(order + 1):
        grams <<= np.uint64(8)
        grams |= stream[i : i + len(grams)]
    at = np.arange(begins[-1]) + order * np.repeat(np.arange(docs), symbols)
    hashes = mix64(PolyHash(low).of(starts, ends)) if len(starts) else np.zeros(0, np.uint64)
    return grams[at], begins, hashes, first


def add_up(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, with the sums of their counts."""
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(counts, first)


def tally(keys: np.ndarray, counted: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Distinct keys with their counts: those to be counted, and those only asked for, with 0."""
    out = []
    for mine, weight in ((keys[counted], 1), (keys[~counted], 0)):
        mine.sort()
        first = np.flatnonzero(np.concatenate([[True], mine[1:] != mine[:-1]])) if len(mine) else np.zeros(0, np.int64)
        out.append((mine[first], np.diff(np.append(first, len(mine))) * weight))
    return out


def part_of(by: np.ndarray, parts: int) -> np.ndarray:
    return (mix64(by) % np.uint64(parts)).astype(np.int64)


def dealt(kind: int, block: int, keys: np.ndarray, counts: np.ndarray, parts: int, by: np.ndarray) -> pa.RecordBatch:
    """Rows of PACKED: keys and counts by part of `by`."""
    part = part_of(by, parts)
    order = np.argsort(part, kind="stable")
    part, keys, counts = part[order], keys[order], counts[order].astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])) if len(part) else np.zeros(0, np.int64)
    ends = np.append(first[1:], len(part))
    rows = [(kind, block, int(part[a]), keys[a:b].tobytes(), counts[a:b].tobytes()) for a, b in zip(first, ends, strict=True)]
    kinds = [pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], ["kind", "block", "part", "keys", "counts"])


def context_of(grams: np.ndarray, depth: int) -> np.ndarray:
    """The nearest `depth` bytes of context."""
    return (grams >> np.uint64(8)) & np.uint64((1 << 8 * depth) - 1)


@dataclass
class Near:
    """Training counts of single bytes after one and after two bytes of context."""

    keys: np.ndarray
    counts: np.ndarray

    def __post_init__(self) -> None:
        self.pairs = np.zeros((256, 256))
        symbol, near = (self.keys & 255).astype(np.int64), (self.keys >> 8 & 255).astype(np.int64)
        np.add.at(self.pairs, (near, symbol), self.counts)
        self.contexts, place = np.unique(self.keys >> 8, return_inverse=True)
        each = lambda w: np.bincount(place, weights=w, minlength=len(self.contexts))
        self.total, self.kinds = each(self.counts), each(self.counts > 0)
        self.shorter = each(np.where(self.counts > 0, self.pairs[near, symbol], 0))

    @staticmethod
    def take(known: np.ndarray, values: np.ndarray, asked: np.ndarray) -> np.ndarray:
        """Values by key, 0 where there is none."""
        if not len(known):
            return np.zeros(len(asked))
        at = np.minimum(np.searchsorted(known, asked), len(known) - 1)
        return np.where(known[at] == asked, values[at], 0)


def probabilities(grams: np.ndarray, counts: np.ndarray, near: Near, blend: dict[int, float] = BLEND) -> np.ndarray:
    """Probability of each distinct gram's symbol in its context, from training counts (0: never seen).

    grams must hold all grams of each three nearest context bytes that it holds any of.
    """
    order = max(blend)
    c, n, q, left_out = {}, {}, {}, {}
    for depth in range(order, 2, -1):
        own, back = np.unique(grams & np.uint64((1 << 8 * (depth + 1)) - 1), return_inverse=True)
        sums = np.bincount(back, weights=counts, minlength=len(own))
        _, place = np.unique(context_of(own, depth), return_inverse=True)
        c[depth] = sums[back]
        n[depth] = np.bincount(place, weights=sums)[place][back]
        q[depth] = np.bincount(place, weights=sums > 0)[place][back]
    symbol, last = (grams & np.uint64(255)).astype(np.int64), context_of(grams, 1).astype(np.int64)
    two, pairs = context_of(grams, 2).astype(np.int64), near.pairs
    c[2], n[2], q[2] = near.take(near.keys, near.counts, two << 8 | symbol), near.take(near.contexts, near.total, two), near.take(near.contexts, near.kinds, two)
    c[1], n[1], q[1] = pairs[last, symbol], pairs.sum(1)[last], (pairs > 0).sum(1)[last]
    single = pairs.sum(0)
    c[0], n[0], q[0] = single[symbol], np.full(len(grams), single.sum()), np.full(len(grams), (single > 0).sum())
    for depth in range(order - 1, 1, -1):  # counts at this depth of the symbols that the next longer context has
        own, first = np.unique(grams & np.uint64((1 << 8 * (depth + 2)) - 1), return_index=True)
        _, place = np.unique(context_of(own, depth + 1), return_inverse=True)
        seen = np.where(c[depth + 1][first] > 0, c[depth][first], 0)
        _, back = np.unique(context_of(grams, depth + 1), return_inverse=True)
        left_out[depth] = np.bincount(place, weights=seen)[back]
    left_out[1] = near.take(near.contexts, near.shorter, two)
    left_out[0] = ((pairs > 0) * single[None, :]).sum(1)[last]
    mixed = np.zeros(len(grams))
    for start, weight in blend.items():
        score, open_ = np.zeros(len(grams)), np.ones(len(grams), bool)
        with np.errstate(divide="ignore", invalid="ignore"):
            for depth in range(start, -1, -1):
                total, kinds = (n[depth], q[depth]) if depth == start else (n[depth] - left_out[depth], q[depth] - q[depth + 1])
                hit = open_ & (c[depth] > 0)
                score[hit] += np.log10((c[depth][hit] - 0.5) / total[hit])
                open_ &= ~hit
                escape = open_ & (kinds > 0)
                score[escape] += np.log10(0.5 * kinds[escape] / total[escape])
        score[open_] -= np.log10(max(SYMBOLS - int((single > 0).sum()), 1))
        mixed += weight * 10.0**score
    return mixed


def runs(equal_to_last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs begin and how long they are, from whether each entry but the first equals the one before."""
    starts = np.concatenate([np.zeros(1, np.int64), np.flatnonzero(~equal_to_last) + 1])
    return starts, np.diff(starts, append=len(equal_to_last) + 1)


def earlier(of: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """How many earlier entries of the same owner each entry equals; of: small numbers, owner: ascending."""
    size = len(of)
    if not size:
        return np.zeros(0, np.int32)
    bits = np.uint64(size.bit_length())
    key = owner.astype(np.uint64)
    key <<= bits
    key |= of.astype(np.uint64)
    key <<= bits
    key |= np.arange(size, dtype=np.uint64)
    key.sort()
    group = key >> bits
    starts, lengths = runs(group[1:] == group[:-1])
    rank = np.arange(size, dtype=np.int32)
    rank -= np.repeat(starts.astype(np.int32), lengths)
    key &= (np.uint64(1) << bits) - np.uint64(1)
    out = np.empty(size, np.int32)
    out[key.view(np.int64)] = rank
    return out


def stream_scores(grams: np.ndarray, begins: np.ndarray, table: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """log10 probability of each symbol of each text from the grams' table (probabilities of distinct grams) and what the text had before."""
    if not len(grams):
        return np.zeros(0)
    order = np.argsort(grams)
    ordered = grams[order]
    starts, lengths = runs(ordered[1:] == ordered[:-1])
    p, gram, context = np.empty(len(grams)), np.empty(len(grams), np.int32), np.empty(len(grams), np.int32)
    distinct = ordered[starts]
    p[order] = np.repeat(table(distinct), lengths)
    gram[order] = np.repeat(np.arange(len(starts), dtype=np.int32), lengths)
    contexts = distinct >> np.uint64(8)
    number = np.zeros(len(starts), np.int32)
    np.cumsum(contexts[1:] != contexts[:-1], out=number[1:])
    context[order] = np.repeat(number, lengths)
    owner = np.repeat(np.arange(len(begins) - 1, dtype=np.int32), np.diff(begins))
    seen = earlier(context, owner)
    # a symbol met before had its context before it; the first of a context counts, too, for those after it
    again = np.zeros(len(starts), bool)
    again[gram[seen > 0]] = True
    some = np.flatnonzero(again[gram])
    met = np.zeros(len(grams), np.int32)
    met[some] = earlier(gram[some], owner[some])
    p *= ADAPT
    p += met
    p /= seen + ADAPT
    return np.log10(p, out=p)


def blocks_of(docs: DataFrame) -> DataFrame:
    """docs with `block`, which names the split of the input that a row is read in."""
    parted = spread(docs.select("doc_id", "text"))
    docs = docs if input_parts(docs) >= input_parts(parted) else materialize(parted, "documents")
    try:
        return docs.select("doc_id", "text", F.xxhash64("_metadata.file_path", "_metadata.file_block_start").alias("block"))
    except AnalysisException:  # not a scan of files
        return materialize(docs.select("doc_id", "text"), "documents").select("doc_id", "text", F.xxhash64("_metadata.file_path", "_metadata.file_block_start").alias("block"))


def look_up(keys: np.ndarray, table: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The values of keys, all of which the table has; looked up in order, so that neighbours lie together."""
    order = np.argsort(keys)
    out = np.empty(len(keys), table[1].dtype)
    out[order] = table[1][np.searchsorted(table[0], keys[order])]
    return out


def score_documents(docs: DataFrame, held_out: int = 1, most_sent: int = MAX_SENT) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row of docs.

    docs: doc_id, text; other columns are left out. Training takes the documents whose crc32(doc_id) mod 5 is not
    held_out; with none, all counts are 0. Null text is empty: the end is its only token. A null doc_id counts as
    empty text in the crc. Repeated rows are scored, and learnt from, each.
    """
    spark = docs.sparkSession
    rows = blocks_of(docs)
    rows = rows.select("block", F.col("doc_id").cast("long").alias("doc_id"), whole_text(docs).alias("text"), (crc_mod("doc_id", 5) == held_out).alias("held_out"))
    # in proportion to the input, so that a part's share of all blocks' keys does not grow with it
    parts = 2 * max(input_parts(docs), int(spark.conf.get("spark.sql.shuffle.partitions")))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {GRAM: [], WORD: []}
        current, trained = None, 0

        def squeeze(kind: int) -> tuple[np.ndarray, np.ndarray]:
            keys, counts = add_up(np.concatenate([k for k, _ in held[kind]]), np.concatenate([n for _, n in held[kind]]))
            held[kind] = [(keys, counts)]
            return keys, counts

        def flush() -> Iterator[pa.RecordBatch]:
            for kind in held:
                keys, counts = squeeze(kind)
                yield dealt(kind, current, keys, counts, parts, keys)
                held[kind] = []

        for batch in arrow_pieces(batches, "text"):
            blocks = batch.column("block").to_numpy()
            for a, b in zip(edges := [0, *(np.flatnonzero(np.diff(blocks)) + 1), len(blocks)], edges[1:], strict=False):
                if current is not None and blocks[a] != current:
                    yield from flush()
                current = int(blocks[a])
                part = batch.slice(a, b - a)
                train = ~part.column("held_out").to_numpy(zero_copy_only=False)
                grams, begins, words, first = symbol_stream(*text_bytes(part.column("text")))
                for kind, keys, at in ((GRAM, grams, begins), (WORD, words, first)):
                    held[kind] += tally(keys, np.repeat(train, np.diff(at)))
                    if sum(len(k) for k, _ in held[kind][1:]) > max(SQUEEZE, len(held[kind][0][0])):
                        squeeze(kind)
        if current is not None:
            yield from flush()

    asked = materialize(rows.mapInArrow(count, PACKED), "asked")

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[int, int], list]]:
        """(kind, part) and its rows (block, keys, counts); rows come in that order."""
        now, own = None, []
        for batch in batches:
            for kind, block, part, keys, counts in zip(*(batch.column(c).to_pylist() for c in ("kind", "block", "part", "keys", "counts")), strict=True):
                if now is not None and (kind, part) != now:
                    yield now, own
                    own = []
                now = kind, part
                own.append((block, np.frombuffer(keys, np.uint64), np.frombuffer(counts, np.int64)))
        if own:
            yield now, own

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["kind", "block", "part", "keys", "counts", "n", "distinct"]
        kinds = [pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.int64()]
        for (kind, part), own in gather(batches):
            keys, counts = add_up(np.concatenate([k for _, k, _ in own]), np.concatenate([n for _, _, n in own]))
            if kind == GRAM:
                packed = dealt(kind, -1, keys, counts, parts, context_of(keys, 3))
                blank = [pa.array(np.zeros(packed.num_rows, np.int64))] * 2
                yield pa.RecordBatch.from_arrays([*packed.columns, *blank], names)
                continue
            for i, (block, mine, _) in enumerate(own):
                row = (kind, block, part, mine.tobytes(), counts[np.searchsorted(keys, mine)].tobytes(), int(counts.sum()) if i == 0 else 0, int((counts > 0).sum()) if i == 0 else 0)
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds, strict=True)], names)

    summed = materialize(asked.repartitionById(parts, "part").sortWithinPartitions("kind", "part").mapInArrow(total, PACKED + ", n long, distinct long"), "summed")
    docs_trained = rows.where("not held_out").count()
    words = summed.where(F.col("kind") == WORD).agg(F.sum("n"), F.sum("distinct")).first()
    n_train = (words[0] or 0) + docs_trained
    vocabulary = (words[1] or 0) + (docs_trained > 0)

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys, counts in zip(batch.column("keys").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                k, n = add_up(np.frombuffer(keys, np.uint64) & np.uint64(0xFFFFFF), np.frombuffer(counts, np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(k.astype(np.int64)), pa.array(n)], ["near", "n"])

    grams = summed.where(F.col("kind") == GRAM)
    counted = grams.select("keys", "counts").mapInArrow(nearest, "near long, n long").groupBy("near").agg(F.sum("n").alias("n")).orderBy("near").toArrow()  # 2**24 rows at most
    near = spark.sparkContext.broadcast(Near(counted.column("near").to_numpy(), counted.column("n").to_numpy()))

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (kind, part), own in gather(batches):
            keys, counts = add_up(np.concatenate([k for _, k, _ in own]), np.concatenate([n for _, _, n in own]))
            scores = probabilities(keys, counts, near.value)
            yield pa.RecordBatch.from_arrays([pa.array([kind], pa.int32()), pa.array([part], pa.int32()), pa.array([keys.tobytes()]), pa.array([scores.tobytes()]), pa.array([len(keys)], pa.int64())], ["kind", "part", "keys", "scores", "n"])

    model = materialize(grams.select("kind", "block", "part", "keys", "counts").repartitionById(parts, "part").sortWithinPartitions("part").mapInArrow(predict, "kind int, part int, keys binary, scores binary, n long"), "model")
    size = model.agg(F.sum("n")).first()[0] or 0
    answers = summed.where(F.col("kind") == WORD).select("kind", "block", "keys", F.col("counts").alias("answers"))
    sent = None
    if size <= most_sent:
        sent = send(model, 1 + size // PIECE, parts)
    else:
        answers = answers.unionByName(answer_grams(asked, model, parts))
    return score_blocks(rows, answers, sent, n_train, vocabulary, docs_trained, 4 * parts)


@dataclass
class Sent:
    """The model's grams and their probabilities in pieces, each ascending: those of every so many-th part."""

    pieces: list[Broadcast]
    parts: int

    def look_up(self, grams: np.ndarray) -> np.ndarray:
        piece = part_of(context_of(grams, 3), self.parts) % len(self.pieces)
        out = np.empty(len(grams))
        for i, each in enumerate(self.pieces):
            own = np.flatnonzero(piece == i)
            keys, scores = each.value
            out[own] = scores[np.searchsorted(keys, grams[own])]
        return out


def send(model: DataFrame, pieces: int, parts: int) -> Sent:
    """The model to all tasks, piece by piece, so that the driver never holds all of it as arrays."""
    sent = []
    for i in range(pieces):
        got = model.where(F.col("part") % pieces == i).select("keys", "scores").toArrow()
        keys = np.concatenate([np.zeros(0, np.uint64), *(np.frombuffer(x.as_buffer(), np.uint64) for x in got.column("keys"))])
        scores = np.concatenate([np.zeros(0), *(np.frombuffer(x.as_buffer(), np.float64) for x in got.column("scores"))])
        del got
        at = np.argsort(keys)
        sent.append(model.sparkSession.sparkContext.broadcast((keys[at], scores[at])))
        del keys, scores, at
        let_go()
    return Sent(sent, parts)


def answer_grams(asked: DataFrame, model: DataFrame, parts: int) -> DataFrame:
    """Each block's grams with their probabilities: questions and model meet in the partitions of the keys' hash."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys, scores in zip(batch.column("keys").to_pylist(), batch.column("scores").to_pylist(), strict=True):
                k = np.frombuffer(keys, np.uint64)
                yield dealt(-1, 0, k, np.frombuffer(scores, np.int64), parts, k)

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, known = None, None
        for batch in batches:
            for kind, block, part, keys, counts in zip(*(batch.column(c).to_pylist() for c in ("kind", "block", "part", "keys", "counts")), strict=True):
                k, v = np.frombuffer(keys, np.uint64), np.frombuffer(counts, np.float64)
                if kind == -1:
                    known = (k, v) if part != now else (np.concatenate([known[0], k]), np.concatenate([known[1], v]))
                    now, fresh = part, True
                    continue
                if fresh:
                    at = np.argsort(known[0])
                    known, fresh = (known[0][at], known[1][at]), False
                yield pa.RecordBatch.from_arrays([pa.array([GRAM], pa.int32()), pa.array([block], pa.int64()), pa.array([keys]), pa.array([known[1][np.searchsorted(known[0], k)].tobytes()])], ["kind", "block", "keys", "answers"])

    both = model.select("keys", "scores").mapInArrow(spread, PACKED).unionByName(asked.where(F.col("kind") == GRAM))
    return both.repartitionById(parts, "part").sortWithinPartitions("part", "kind").mapInArrow(answer, "kind int, block long, keys binary, answers binary")


def score_blocks(rows: DataFrame, answers: DataFrame, sent: Sent | None, n_train: int, vocabulary: int, ends: int, tasks: int) -> DataFrame:
    """Score texts block by block: a block's answers come first, then its texts stream through. So many tasks that few get two blocks."""
    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables: dict[int, list] = {}
        now, ready = None, {}
        base = lambda c: np.log10((c + 0.5) / (n_train + 0.5 * (vocabulary + 1)))
        for batch in arrow_pieces(batches, "text"):
            blocks, kinds = batch.column("block").to_numpy(), batch.column("kind").to_numpy()
            edges = np.flatnonzero((blocks[1:] != blocks[:-1]) | (kinds[1:] != kinds[:-1])) + 1
            for a, b in zip([0, *edges], [*edges, len(blocks)], strict=True):
                part, kind = batch.slice(a, b - a), int(kinds[a])
                if blocks[a] != now:
                    now, tables, ready = blocks[a], {}, {}
                if kind < 2:
                    tables.setdefault(kind, []).extend((np.frombuffer(k, np.uint64), np.frombuffer(v, np.int64 if kind == WORD else np.float64)) for k, v in zip(part.column("keys").to_pylist(), part.column("answers").to_pylist(), strict=True))
                    continue
                for k in tables:
                    keys, values = (np.concatenate(x) for x in zip(*tables[k], strict=True))
                    at = np.argsort(keys)
                    ready[k] = keys[at], values[at]
                tables = {}
                grams, begins, words, first = symbol_stream(*text_bytes(part.column("text")))
                known = look_up(words, ready[WORD]) if len(words) else np.zeros(0, np.int64)
                logs = stream_scores(grams, begins, (lambda g: ready[GRAM][1][np.searchsorted(ready[GRAM][0], g)]) if sent is None else sent.look_up)
                sums = lambda x, at: np.diff(np.concatenate([[0], np.cumsum(x, dtype=np.float64)])[at])
                n_known = sums(known > 0, first).astype(np.int64) + (ends > 0)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(np.diff(first) + 1), pa.array(n_known), pa.array(np.full(len(n_known), n_train)), pa.array(sums(base(known), first) + base(ends)), pa.array(sums(logs, begins))], names)

    texts = rows.select(F.lit(2).alias("kind"), "block", "doc_id", "held_out", "text", F.lit(None).cast("binary").alias("keys"), F.lit(None).cast("binary").alias("answers"))
    told = answers.select("kind", "block", F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("boolean").alias("held_out"), F.lit("").alias("text"), "keys", "answers")
    both = told.unionByName(texts).repartition(tasks, "block").sortWithinPartitions("block", "kind")
    return both.mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
