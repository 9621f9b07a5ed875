"""Operators over all documents, against brute force."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from remembrane.llm import minhash, ppm, quality, queries, suffix, syncmers, topk
from remembrane.llm.common import text_bytes

WORDS = re.compile(rb"[^\x20\x09-\x0D]+")


def words(text):
    return WORDS.findall(re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))


def table(spark, sf, name):
    return spark.read.parquet(f"{sf}/{name}.parquet")


# quality


def test_quality_held_out_accuracy(spark, sf):
    got = queries.op2_gam_quality(spark, "/root/testdata/sf0.01").toPandas()
    m = got.merge(table(spark, "/root/testdata/sf0.01", "labels").toPandas(), on="doc_id")
    test = m[m.held_out]
    ranks = test.score.rank()
    good = test.quality == 1
    auc = (ranks[good].sum() - good.sum() * (good.sum() + 1) / 2) / good.sum() / (~good).sum()
    assert auc > 0.97 and (test.predicted == test.quality).mean() > 0.95
    assert got.score.between(0, 1).all() and ((got.score >= 0.3) == (got.predicted == 1)).all()
    assert all(h == (zlib.crc32(str(i).encode()) % 5 == 0) for i, h in zip(got.doc_id, got.held_out, strict=True))


def test_quality_ignores_held_out_labels(spark, sf):
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    flipped = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (quality.classify(docs, x).toPandas().sort_values("doc_id").score.to_numpy() for x in (labels, flipped))
    assert (a == b).all()


def brute_features(text):
    raw = text.encode()
    share = lambda own: sum(b in own for b in raw) / max(len(raw), 1)
    own = re.findall(rb"[^\x20\x09-\x0D]+", raw)
    lines = [x for x in raw.split(b"\n") if x]
    distinct = lambda items: len(set(items)) / len(items) if items else 1.0
    kind = lambda b: next(k for k, values in quality.KINDS.items() if b in values)
    mean = lambda tests: sum(tests) / max(len(own), 1)
    letters = ("lower", "upper", "high")
    used = {b for k, values in quality.KINDS.items() for b in values}
    assert used == set(range(256))
    return [
        math.log1p(len(raw)), math.log1p(len(own)), sum(b != 32 for b in raw) / max(len(own), 1), *(share(set(v)) for v in quality.KINDS.values()),
        sum(a == b for a, b in zip(raw, raw[1:], strict=False)) / max(len(raw), 1), distinct(own), distinct(lines), math.log1p(len(raw) / max(len(lines), 1)), sum(kind(x[-1]) == "stop" for x in lines) / max(len(lines), 1),
        mean(kind(w[-1]) == "symbol" for w in own), mean(kind(w[-1]) == "stop" for w in own), mean(not any(kind(b) in letters for b in w) for w in own), mean(kind(w[0]) == "upper" for w in own),
        math.log1p(max(map(len, own), default=0)), distinct(list(zip(own, own[1:], own[2:], strict=False))),
    ]


def brute_trees(x, y):
    """The score of each row by a walk through the tables, entry by entry."""
    model = quality.fit(x, y)
    out = []
    for row in x:
        bins = [sum(v >= e for e in edges) for v, edges in zip(row, model.edges, strict=True)]
        total = model.base + sum(t[b] for t, b in zip(model.tables, bins, strict=True)) + sum(t[model.coarse[f][bins[f]]][model.coarse[g][bins[g]]] for f, g, t in model.pairs)
        out.append(1 / (1 + math.exp(-total)))
    return model, out


def test_quality_against_brute_force(spark, sf):
    docs = table(spark, sf, "documents").toPandas()
    texts = [t for t in docs.text[:60]] + ["", " ", "a", "A b\nc. d! #x 12", "é ü\n\n\nz z z z"]
    arrow = pa.array(texts)
    x = quality.features(*text_bytes(arrow))
    assert np.allclose(x, np.array([brute_features(t) for t in texts]), rtol=1e-5, atol=1e-6)
    y = np.array([float(len(t) % 2) for t in texts])
    model, scores = brute_trees(x.astype(np.float64), y)
    assert np.allclose(model.score(x.astype(np.float64)), scores) and model.pairs and len({f for f, _, _ in model.pairs}) > 1


def test_quality_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(1, 1, None), (5, 0, 1), (5, None, 0), (None, 1, 1), (10, 0, 0), (6, 1, 1)], "doc_id bigint, quality int, toxic int")
    assert quality.classify(odd, labels).count() == odd.count()
    assert {r.score for r in quality.classify(odd, labels.where("false")).collect()} == {0.5}
    assert quality.classify(empty, labels).count() == 0
    assert quality.keep_good(odd, labels.where("false")).count() == odd.count()
    assert quality.keep_good(odd, labels).columns == odd.columns


# language model


def brute_ppm(train, order):
    """Counts of every context up to `order`, by plain dictionaries."""
    counts = {}
    for text in train:
        stream = b"\n" * order + (b" ".join(words(text)) + b"\n")
        for i in range(order, len(stream)):
            for k in range(order + 1):
                own = counts.setdefault(stream[i - k : i], Counter())
                own[stream[i]] += 1
    return counts


def brute_probability(counts, stream, i, start):
    """PPM from contexts of `start` bytes down."""
    gone, s, p = set(), stream[i], 1.0
    for k in range(start, -1, -1):
        own = {c: n for c, n in counts.get(stream[i - k : i], {}).items() if c not in gone}
        if not own:
            continue
        size = sum(own.values())
        if s in own:
            return p * (own[s] - 0.5) / size
        p *= 0.5 * len(own) / size
        gone |= set(own)
    return p / (252 - len(gone))


def brute_score(counts, text, order):
    stream, total, own = b"\n" * order + (b" ".join(words(text)) + b"\n"), 0.0, {}
    for i in range(order, len(stream)):
        before = own.setdefault(stream[i - order : i], Counter())
        p = sum(w * brute_probability(counts, stream, i, start) for start, w in ppm.BLEND.items())
        total += math.log10((before[stream[i]] + ppm.ADAPT * p) / (sum(before.values()) + ppm.ADAPT))
        before[stream[i]] += 1
    return total


def test_ppm_is_a_distribution(spark):
    texts = [b"abracadabra cad abra", b"abra abba"]
    counts = brute_ppm([t.decode() for t in texts], ppm.ORDER)
    stream = b"\n" * ppm.ORDER + b"abrac"
    symbols = [b for b in range(256) if b not in (9, 11, 12, 13)]
    for start in ppm.BLEND:
        assert sum(brute_probability(counts, stream + bytes([b]), len(stream), start) for b in symbols) == pytest.approx(1)


def test_ppm_beats_the_words_on_held_out_documents(spark):
    got = queries.op3_ppm_scores(spark, "/root/testdata/sf0.01").where("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b")).first()
    assert got.s > got.b


@pytest.mark.parametrize("sent", [ppm.MAX_SENT, 0])
def test_ppm_against_dictionaries(spark, odd, odd_rows, held_out, sent):
    train = [t for i, t in odd_rows if not held_out(i, 1)]
    counts, tokens = brute_ppm(train, ppm.ORDER), Counter(w for t in train for w in [*words(t), b"\n"])
    n, v = sum(tokens.values()), len(tokens)
    got = ppm.score_documents(odd, most_sent=sent).toPandas()
    assert len(got) == len(odd_rows)
    want = sorted((len(words(t)) + 1, sum(tokens[w] > 0 for w in [*words(t), b"\n"]), round(sum(math.log10((tokens[w] + 0.5) / (n + 0.5 * (v + 1))) for w in [*words(t), b"\n"]), 3), round(brute_score(counts, t, ppm.ORDER), 3)) for _, t in odd_rows)
    have = sorted((r.n_tokens, r.n_known, round(r.base_score, 3), round(r.score, 3)) for r in got.itertuples())
    assert np.allclose(np.array(want), np.array(have), rtol=1e-9, atol=2e-3)
    assert set(got.train_tokens) == {n}


def test_ppm_sends_its_model_in_pieces(spark, sf, monkeypatch):
    """The driver never has the whole model; scores are those of the join."""
    docs = table(spark, sf, "documents").limit(200)
    monkeypatch.setattr(ppm, "PIECE", 5000, raising=False)
    frame, held = type(docs), []
    whole = frame.toArrow

    def counted(self):
        got = whole(self)
        held.extend([got.nbytes] if "scores" in got.column_names else [])
        return got

    monkeypatch.setattr(frame, "toArrow", counted)
    scores = [{(r.doc_id, round(r.score, 6)) for r in ppm.score_documents(docs, most_sent=most).collect()} for most in (ppm.MAX_SENT, 0)]
    assert scores[0] == scores[1] and len(scores[0]) == 200
    assert max(held) < 0.5 * sum(held)


def test_ppm_empty_and_untrained(spark, make, empty, held_out):
    assert ppm.score_documents(empty).count() == 0
    only = [i for i in range(200) if held_out(i, 1)][:2]
    got = ppm.score_documents(make([(i, "ab c") for i in only])).collect()
    assert [(r.n_tokens, r.n_known, r.train_tokens) for r in got] == [(3, 0, 0)] * 2
    assert got[0].score == pytest.approx(-5 * math.log10(252), rel=1e-5)


# near-duplicates


def brute_components(rows, size, percent):
    sets = {}
    for i, t in rows:
        w = words(t)
        sets.setdefault(i, []).append(frozenset(tuple(w[k : k + size]) for k in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else []))
    ids = sorted(i for i in sets if i is not None)
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and any(x and y and 100 * len(x & y) >= percent * len(x | y) for x in sets[a] for y in sets[b]):
                p, q = sorted((find(a), find(b)))
                parent[q] = p
    return {i: find(i) for i in ids}


def test_near_duplicates_against_brute_force(spark, sf):
    rows = [(r.doc_id, r.text) for r in table(spark, sf, "documents").collect()]
    want = brute_components(rows, 4, 80)
    got = queries.op5_minhash_oph(spark, sf).collect()
    assert {r.doc_id: r.component_id for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_near_duplicates_odd_rows(spark, odd, odd_rows, empty):
    got = minhash.near_duplicates(odd, size=4).collect()
    want = brute_components(odd_rows, 4, 80)
    assert len(got) == len(odd_rows) and all(r.component_id == (want[r.doc_id] if r.doc_id is not None else None) for r in got)
    assert minhash.near_duplicates(empty).count() == 0
    left = minhash.drop_near_duplicates(odd)
    assert left.columns == odd.columns and left.where("doc_id = 7").count() == 0 and left.where("doc_id is null").count() == 1


def test_groups_of_many_copies(spark, make):
    base = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(base)) for i in range(100)] + [(200 + i, " ".join([*base[:50], f"x{i}", *base[51:]])) for i in range(100)] + [(500 + i, f"word {i} " * 9) for i in range(50)]
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(make(rows)).collect()}
    assert all(got[i] == 0 for i, _ in rows[:200]) and all(got[500 + i] == 500 + i for i in range(50))


def in_one_bucket(tails):
    """(doc_id, text) for each (doc_id, tail): a common beginning that gives all of them both buckets of two bins."""
    for seed in range(1000):
        rows = [(i, " ".join([f"s{seed}w{k}" for k in range(40)] + tail)) for i, tail in tails]
        raw, offsets = text_bytes(pa.array([t for _, t in rows]))
        keys = minhash.band_keys(minhash.signatures(*minhash.shingle_sets(raw, offsets, 1), 2), 1)
        if (keys == keys[0]).all():
            return rows
    raise AssertionError("no seed")


def test_empty_round_does_not_end_the_rounds(spark, make):
    tail = [f"t{k}" for k in range(20)]
    rows = in_one_bucket([(1, [f"a{k}" for k in range(20)]), (2, tail), (3, [*tail[:-1], "x"]), (4, [])])  # 4 is too short for all
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(make(rows), size=1, bands=2, rows=1).collect()}
    assert got == brute_components(rows, 1, 80) == {1: 1, 2: 2, 3: 2, 4: 4}


def test_more_groups_in_a_bucket_than_rounds(spark, make):
    tail = lambda g, changed: [f"g{g}t{k}" for k in range(20)][changed:] + [f"g{g}c{changed}n{k}" for k in range(changed)]
    rows = in_one_bucket([(10 * g + c, tail(g, c)) for g in range(1, 13) for c in (0, 1, 9)])  # 0 and 1 agree, 1 and 9 do not
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(make(rows), size=1, bands=2, rows=1).collect()}
    want = brute_components(rows, 1, 80)
    assert got == want and got[11] == 10 and got[121] == 120 and got[19] == 19


def test_rounds_take_few_tasks(spark, make):
    """Each round goes through the links that it found, not through all of them again."""
    tail = lambda g, changed: [f"g{g}t{k}" for k in range(20)][changed:] + [f"g{g}c{changed}n{k}" for k in range(changed)]
    rows = in_one_bucket([(10 * g + c, tail(g, c)) for g in range(1, 13) for c in (0, 1, 9)])
    held = make(rows)
    context = spark.sparkContext
    context.setJobGroup("rounds", "rounds")
    try:
        assert len(minhash.near_duplicates(held, size=1, bands=2, rows=1).collect()) == len(rows)
        tracker = context.statusTracker()
        stages = {s for j in tracker.getJobIdsForGroup("rounds") for s in tracker.getJobInfo(j).stageIds}
        tasks = sum(info.numCompletedTasks for s in stages if (info := tracker.getStageInfo(s)))
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    assert tasks < 225, tasks


def test_members_are_placed_once(spark, make):
    """One join places all members, however many rounds found links."""
    tail = lambda g, changed: [f"g{g}t{k}" for k in range(20)][changed:] + [f"g{g}c{changed}n{k}" for k in range(changed)]
    for groups in (1, 6):
        rows = in_one_bucket([(10 * g + c, tail(g, c)) for g in range(1, groups + 1) for c in (0, 1, 9)])
        got = minhash.near_duplicates(make(rows), size=1, bands=2, rows=1)
        plan = got._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("Join LeftOuter") == 2, plan  # members with components, signatures with members
        assert {r.doc_id: r.component_id for r in got.collect()} == brute_components(rows, 1, 80)


def test_moves_are_followed(spark):
    rng = random.Random(3)
    names, steps, want = list(range(40)), [], {i: i for i in range(40)}
    for _ in range(6):
        gone = set(rng.sample(names[1:], 6))
        left = [x for x in names if x not in gone]
        step = {x: rng.choice([y for y in left if y < x]) for x in gone}
        names, want = left, {i: step.get(c, c) for i, c in want.items()}
        steps.append(spark.createDataFrame(list(step.items()), "node long, component long"))
    got = [(r.node, r.component) for r in minhash.followed(steps).collect()]
    assert sorted(got) == sorted((i, c) for i, c in want.items() if i != c)
    assert sorted(minhash.followed(steps[:1]).collect()) == sorted(steps[0].collect())


def test_pairs_within_a_template(spark, make):
    """400 pairs at similarity 0.815 in one template whose documents are alike to 0.774: every pair is found, and nothing else."""
    common = [f"c{k}" for k in range(240)]
    rows = [(2 * i + j, " ".join([*common, *(f"p{i}w{k}" for k in range(7)), *(f"d{i}n{j}w{k}" for k in range(28))])) for i in range(400) for j in (0, 1)]
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(make(rows), size=1).collect()}
    assert got == {i: i - i % 2 for i, _ in rows}


def test_exact_pairs_against_brute_force(spark):
    rng = np.random.default_rng(5)
    sets = {i: np.unique(rng.choice(60, rng.integers(1, 50), replace=False)).astype(np.uint64) for i in range(150)}
    for i in range(150, 300):
        old = sets[i - 150]
        sets[i] = np.unique(np.concatenate([old[rng.random(len(old)) > 0.1], rng.choice(60, 1).astype(np.uint64)]))
    held = spark.createDataFrame([(i, len(x), bytearray(x.tobytes())) for i, x in sets.items()], "doc_id long, n long, s binary")
    for group in (1, 7):  # components of one document, and of some
        rest = spark.createDataFrame([(i, i // group) for i in sets], "rep long, component long")
        pairs = minhash.exact_pairs(rest, held, 80)
        got = {(r.a, r.b) for r in minhash.confirm(pairs, held, 80).collect()}
        both = lambda a, b: len(np.intersect1d(sets[a], sets[b]))
        want = {(a, b) for a in sets for b in sets if a < b and a // group != b // group and 100 * both(a, b) >= 80 * (len(sets[a]) + len(sets[b]) - both(a, b))}
        assert got == want and len(want) > 50


def test_chain_links(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(100, 101)], "a bigint, b bigint")
    got = {r.node: r.component for r in minhash.connected_components(e).collect()}
    assert all(got[i] == 0 for i in range(21)) and got[101] == 100


# fingerprints


def spark_hash(points):
    """Spark's xxhash64 of code points, signed."""
    x = xxhash.xxh64_intdigest(b"".join(p.to_bytes(4, "big") for p in points), 42)
    return x - (1 << 64) if x >> 63 else x


def brute_anchors(text, k=syncmers.K, s=syncmers.S):
    if not text:
        return []
    marks = range(0x110000, 0x110000 + 2 * (k - 1))
    points = [*marks[: k - 1], *map(ord, text), *marks[k - 1 :]]
    inner = [spark_hash(points[i : i + s]) for i in range(len(points) - s + 1)]
    out = []
    for i in range(len(points) - k + 1):
        own = inner[i : i + k - s + 1]
        if min(own) in (own[0], own[-1]):
            out.append((i, (spark_hash(points[i : i + k]) & (1 << 64) - 1) >> 32))
    return out


def brute_likeness(a, b):
    first = lambda found: {h: p for p, h in sorted(found, reverse=True)}
    a, b = first(a), first(b)
    if not a and not b:
        return 1.0
    shifts = Counter(b[h] - a[h] for h in a.keys() & b.keys())
    n = sum(c for c in shifts.values() if c > 1 or min(len(a), len(b)) <= 1)
    return n / (len(a) + len(b) - n)


def check_fingerprints(docs, got, sha):
    """docs in order; got: rows in the same order."""
    for k, ((_, t), r) in enumerate(zip(docs, got, strict=True)):
        t, after = t or "", docs[(k + 1) % len(docs)][1] or ""
        edited = t[: len(t) - len(t) // 3] + after[: len(t) // 3]
        mine, changed, theirs = (brute_anchors(x) for x in (t, edited, after))
        assert r.n_chars == len(t) and r.edited_sha256 == sha(edited)
        assert r.fingerprint == " ".join(f"{p:x}:{h:08x}" for p, h in mine)
        assert r.edited_fingerprint == " ".join(f"{p:x}:{h:08x}" for p, h in changed)
        assert r.near_edited == pytest.approx(brute_likeness(mine, changed)) and r.near_next == pytest.approx(brute_likeness(mine, theirs))


def test_fingerprints_against_brute_force(spark, sf, sha):
    docs = [(r.doc_id, r.text) for r in table(spark, sf, "documents").orderBy(F.desc("doc_id")).collect()]
    got = queries.op7_closed_syncmers(spark, sf).orderBy(F.desc("doc_id")).collect()
    check_fingerprints(docs, got, sha)
    assert np.median([r.near_edited for r in got]) > 0.4 and np.median([r.near_next for r in got]) < 0.05


@pytest.mark.parametrize("parts", [1, 3, 40])
def test_fingerprints_odd_rows(spark, odd, odd_rows, make, sha, parts):
    ordered = sorted(odd_rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    place = lambda r: (r.doc_id is None, -(r.doc_id or 0))
    got = sorted(syncmers.fingerprints_with_edits(odd, parts=parts).collect(), key=lambda r: (*place(r), r.n_chars != 26 if r.doc_id == 8 else 0))
    check_fingerprints(ordered, got, sha)
    texts = [(i, ("ab" if i % 3 else "xyz é") * (i % 23) + "q" * (i % 7)) for i in range(60)]
    got = sorted(syncmers.fingerprints_with_edits(make(texts), parts=parts).collect(), key=place)
    check_fingerprints(texts[::-1], got, sha)


def test_fingerprints_empty_and_alone(spark, empty, make):
    assert syncmers.fingerprints_with_edits(empty).count() == 0
    assert syncmers.fingerprints_with_edits(make([(1, "alone here")])).first().near_next == 1.0


def test_syncmers_are_context_free(spark, make):
    for core in (" ".join(f"t{i}" for i in range(100)), "".join(f"t{i}" for i in range(100))):  # with and without spaces
        a = {(r.pos + 10, r.hash) for r in syncmers.anchors(make([(1, core)])).collect()}
        b = {(r.pos, r.hash) for r in syncmers.anchors(make([(2, f"before it {core} and after")])).collect()}
        inside = {(p, h) for p, h in a if 10 + syncmers.PAD <= p <= 10 + len(core) - 1}
        assert inside <= b and len(inside) > len(core) // 15 and len(a - b) < 14  # all but those with marks


@pytest.mark.parametrize("size", [3, 16, 31, 32, 33, 63, 64, 65, 75, 200])
def test_fingerprints_know_no_length(spark, make, sha, size):
    """A text, itself without its last character, and next to it one so short that the edited text shrinks: shared beginnings are found at any length."""
    r = random.Random(size)
    text = "".join(r.choice("abcdefg hi") for _ in range(size))
    rows = [(4, text), (3, text[:-1]), (2, text), (1, "")]
    got = sorted(syncmers.fingerprints_with_edits(make(rows)).collect(), key=lambda r: -r.doc_id)
    check_fingerprints(rows, got, sha)
    if size > 30:
        assert all(x > 0.15 for x in (got[0].near_next, got[1].near_next, got[2].near_edited)), [(x.near_edited, x.near_next) for x in got]


# search


def test_top_k_query(spark, sf, duck, same):
    same(queries.op9_exact_topk(spark, sf).toPandas(), duck.execute(queries.OP9_SQL).df())


@pytest.mark.parametrize("block", [3, 1000])
def test_top_k_odd_vectors(spark, block):
    r = np.random.default_rng(1)
    rows = [(i, r.normal(size=8).round(1).tolist(), 0) for i in range(60)] + [(60, None, 0), (61, [1.0, None] * 4, 0), (62, [float("nan")] * 8, 0), (63, [float("inf")] * 8, 0), (None, [1.0] * 8, 0), (64, [1e12] * 8, 0), (65, [1.0] * 3, 0), (80, [2.0] * 3, 0), (100, [], 0), (5, rows_5 := [0.5] * 8, 0), (5, rows_5, 0)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, score int")
    good = {}
    for i, v, _ in rows:
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v):
            good.setdefault((i, tuple(math.floor(64 * x) for x in v)), None)
    want = []
    for q, x in good:
        if q % 20 == 0:
            scored = sorted((-sum(a * b for a, b in zip(x, y, strict=True)), i) for i, y in good if i != q and len(y) == len(x))
            want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(scored[:5])]
    got = topk.top_k(df, F.col("vec_id") % 20 == 0, k=5, query_block=block).collect()
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in got) == sorted(want)
    assert topk.top_k(df.where("false"), F.col("vec_id") % 20 == 0).count() == 0


def test_bounds_hold():
    r = np.random.default_rng(2)
    q, x = r.normal(size=(20, 64)) * 30, r.normal(size=(50, 64)) * 30
    for s in (1, 4, 16):
        assert (topk.segment_stats(q, s) @ topk.segment_stats(x, s).T >= q @ x.T - 1e-6).all()


def test_bounds_prune_what_is_far():
    r = np.random.default_rng(0)
    x = np.floor(r.normal(size=(40, 64))[r.integers(0, 40, 6000)] * 10 + r.normal(size=(6000, 64)) * 2).astype(np.int64)
    ids = np.arange(len(x))
    pairs, *left = topk.prune_counts(ids[::20], x[::20], ids, x, 20).tolist()
    assert pairs == 300 * 6000 and left == sorted(left, reverse=True) and left[-1] < 0.02 * pairs
    flat = topk.prune_counts(ids[::20], np.ones((300, 64), np.int64), ids, np.ones((6000, 64), np.int64), 20)
    assert flat.tolist() == [300 * 6000] * 4  # all ties survive


# repeats


def brute_repeats(texts, width):
    where = Counter(t[i : i + width] for t in texts for i in range(len(t) - width + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - width + 1):
            if where[t[i : i + width]] > 1:
                gone[i : i + width] = True
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((len(t), int(gone.sum()), spans, bytes(np.frombuffer(t, np.uint8)[~gone])))
    return out


def check_repeats(rows, got, width, sha):
    want = sorted((str(i), n, g, s, sha(k)) for (i, _), (n, g, s, k) in zip(rows, brute_repeats([(t or "").encode() for _, t in rows], width), strict=True))
    assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == want


def test_repeats_query(spark, sf, sha):
    rows = [(r.doc_id, r.text) for r in table(spark, sf, "documents").collect()]
    check_repeats(rows, queries.op10_suffix_intervals(spark, sf).collect(), 200, sha)


def test_repeats_odd_rows(spark, odd, odd_rows, empty, sha):
    check_repeats(odd_rows, suffix.remove_repeats(odd).collect(), 200, sha)
    assert suffix.remove_repeats(empty).count() == 0


def test_repeats_random_texts(spark, make, sha):
    r = np.random.default_rng(4)
    passages = ["".join(r.choice(list("abcd é"), 260)) for _ in range(6)]
    rows = []
    for i in range(60):
        parts = ["".join(r.choice(list("xyz é"), int(r.integers(0, 150)))) for _ in range(3)]
        p = passages[int(r.integers(0, 6))]
        a, b = sorted(r.integers(0, 261, 2))
        rows.append((i, parts[0] + p[a:b] + parts[1] + passages[int(r.integers(0, 6))][: int(r.integers(0, 261))] + parts[2]))
    rows += [(100, "ab" * 400), (101, "é" * 300), (102, rows[0][1])]
    check_repeats(rows, suffix.remove_repeats(make(rows)).collect(), 200, sha)


def test_repeats_at_a_common_passage(spark, make, sha, monkeypatch):
    """One passage in ever new surroundings, with groups split once and down to single windows."""
    monkeypatch.setattr(suffix, "BUSY", 8)
    r = np.random.default_rng(9)
    letters = list("abcdefghij é")
    common = "".join(r.choice(letters, 150))
    near = ["".join(r.choice(letters, 30)) for _ in range(4)]
    rows = [(i, "".join(r.choice(letters, 120)) + near[i % 4] * (i % 2) + common + near[i // 7 % 4] * (i % 3 > 0) + "".join(r.choice(letters, 120))) for i in range(120)]
    check_repeats(rows, suffix.remove_repeats(make(rows)).collect(), 200, sha)
    # one byte after it differs: windows without that byte are repeated, others are not
    tight = [(i, "".join(r.choice(letters, 200)) + common + common[:45] + "".join(r.choice(letters, 200))) for i in range(60)]
    check_repeats(tight, suffix.remove_repeats(make(tight)).collect(), 200, sha)
    with pytest.raises(ValueError):
        suffix.remove_repeats(make(rows), width=257)
    check_repeats(rows[:20], suffix.remove_repeats(make(rows[:20]), width=20).collect(), 20, sha)


def test_maximal_repeats():
    text = np.frombuffer(b"xxabcdefyyabcdefzzqbcdef", np.uint8)
    got = {(n, tuple(sorted(at.tolist()))) for n, at in suffix.maximal_repeats(text, np.full(24, 24), np.arange(24), 4)}
    assert (6, (2, 10)) in got and (5, (3, 11, 19)) in got and not any(n == 4 for n, _ in got)


def test_without_repeats_keeps_columns(spark, odd):
    out = suffix.without_repeats(odd)
    assert out.columns == odd.columns and out.count() == odd.count() and out.where("doc_id = 1").first().text == odd.where("doc_id = 1").first().text
    long = out.where("doc_id = 10").first()
    assert long.text == "" and long.n_chars == 0


# pipeline


def test_pipeline_against_stages(spark, sf):
    docs = table(spark, sf, "documents")
    kept, seen = docs, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = spark.createDataFrame(stage(spark, kept, sf).toPandas(), docs.schema)
        seen.append((name, {r.doc_id: r.text for r in kept.collect()}))
    scores = {r.doc_id: r.predicted for r in queries.op2_gam_quality(spark, sf).collect()}
    first = {i for i, p in scores.items() if p == 1}
    assert set(seen[0][1]) == first
    want = brute_components([(i, t) for i, t in seen[0][1].items()], 5, 80)
    assert set(seen[1][1]) == {i for i, c in want.items() if i == c}
    texts = sorted(seen[1][1].items())
    for (i, _), (_, _, _, left) in zip(texts, brute_repeats([t.encode() for _, t in texts], 200), strict=True):
        assert seen[2][1][i] == left.decode("utf-8", "ignore")
    pieces = corpus_pipeline.run(spark, sf).collect()
    assert {r.doc_id for r in pieces} == set(seen[2][1]) and all(r.offset + r.length <= 1024 for r in pieces)
