"""Chat formatting, SentencePiece, packed ids, packing: exact round trips."""

import itertools
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from remembrane.llm import bitpack, chat, packing, pieces, queries
from remembrane.llm.bpe import ByteBpe

BPE, MODEL = queries.BPE, queries.PIECES


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(public_tokenizers.path(BPE))
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def test_byte_bpe_is_the_librarys(library):
    bpe, r = ByteBpe(BPE), random.Random(1)
    parts = [*"ab's1! \n\té", " ", "\x85", "\x1c", "<|endoftext|>", "😀", "don't", " the", "...", "ª"]
    for _ in range(3000):
        text = "".join(r.choice(parts) for _ in range(r.randint(0, 12)))
        assert np.frombuffer(bpe.encode(text), bpe.dtype).tolist() == library(text)
    for text in ("<|endoftext|>", "hello <|endoftext|> world", "a<|endoftext|>b", " <|endoftext|> <|endoftext|>\n<|endoftext|><|endoftext|>  x", "<|endoftext|", "<<|endoftext|>>" * 50):
        assert np.frombuffer(bpe.encode(text), bpe.dtype).tolist() == library(text)
    assert library("hello <|endoftext|> world").count(50256) == 1


def test_pieces_are_the_librarys():
    bpe, r = pieces.PieceBpe(MODEL), random.Random(2)
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(MODEL))
    known = [p.replace("▁", " ") for p in bpe.rank]
    for _ in range(3000):
        text = "".join(r.choice(known) if r.random() < 0.7 else r.choice(" ab\n\t\0é😀▁中") for _ in range(r.randint(0, 9)))
        ids = bpe.encode(text)[1]
        assert ids == sp.encode(text) and bpe.decode([ids]) == [sp.decode(ids)]


def test_sentencepiece_query(spark, odd, odd_rows, sha, empty):
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(MODEL))
    want = sorted((str(i), len(ids := sp.encode(t or "")), sha(",".join(map(str, ids))), sha(sp.decode(ids))) for i, t in odd_rows)
    got = pieces.encode(odd, MODEL).collect()
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == want
    assert pieces.encode(empty, MODEL).count() == 0


@pytest.mark.parametrize("bits", [1, 7, 8, 15, 16, 17])
def test_bits_round_trip(bits):
    ids = np.random.default_rng(0).integers(0, 1 << bits, 1000).astype(np.uint32)
    image = bitpack.Image(bitpack.write_image([5, None, 7], [0, 600, 400], ids, bits, block=64))
    assert (image.read(0, 1000) == ids).all() and (image.read(130, 515) == ids[130:515]).all()
    assert [image.document(k).tolist() for k in range(3)] == [[], ids[:600].tolist(), ids[600:].tolist()]
    assert len(image.raw) < 1000 * bits / 8 + 400


@pytest.mark.parametrize("shards", [1, 5])
def test_token_files(spark, odd, odd_rows, library, shards):
    files = bitpack.write_token_files(odd, BPE, end_id=0, shards=shards, file_tokens=700)
    got = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in bitpack.read_token_files(files).collect())
    docs = sorted(odd_rows, key=lambda x: (x[0] is not None, x[0] or 0))
    assert [g[1] for g in got] == [i for i, _ in docs]
    want, at = [], 0
    for i, t in docs:
        ids = np.array([*library(t), 0], "<u4")
        want.append((i, len(ids), zlib.crc32(ids.tobytes())))
    assert sorted(map(str, [(g[1], g[2], g[3]) for g in got])) == sorted(map(str, want))
    for g in got:
        assert g[0] == at
        at += g[2]


def test_token_files_empty_and_export(spark, empty, odd, tmp_path):
    assert bitpack.read_token_files(bitpack.write_token_files(empty, BPE)).count() == 0
    names = bitpack.export_images(bitpack.write_token_files(odd, BPE, shards=2), str(tmp_path))
    assert names and sum(bitpack.Image(open(n, "rb").read()).n_docs for n in names) == odd.count()


def check_packing(rows, capacity):
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_packing_query(spark, odd, odd_rows, library):
    rows = packing.pack(packing.token_pieces(odd, BPE, 64), 64, ["doc_id", "piece", "ids_crc32"]).collect()
    n = check_packing(rows, 64)
    total = sum(len(library(t)) + 1 for _, t in odd_rows)
    assert sum(r.length for r in rows) == total and -(-total // 64) <= n <= -(-total // 64) + 1
    want = []
    for i, t in odd_rows:
        ids = np.array([*library(t), 2], "<u4")
        first = len(ids) % 64 or 64
        cuts = [0, *range(first, len(ids) + 1, 64)] if len(ids) > 64 else [0, len(ids)]
        want += [(str(i), k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
    assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in rows) == sorted(want)


def test_packing_plan_against_first_fit():
    r = np.random.default_rng(3)
    for _ in range(30):
        capacity = int(r.integers(4, 40))
        counts = np.zeros(capacity + 1, np.int64)
        counts[1:] = r.integers(0, 12, capacity)
        plan = packing.plan_patterns(counts, capacity)
        used = np.zeros(capacity + 1, np.int64)
        for pattern, times in plan:
            assert sum(pattern) <= capacity and times > 0
            np.add.at(used, list(pattern), times)
        assert (used == counts).all()
        bins = []
        for length in np.repeat(np.arange(capacity + 1), counts)[::-1]:
            fit = [k for k, b in enumerate(bins) if b + length <= capacity]
            if fit:
                bins[max(fit, key=lambda k: bins[k])] += length
            else:
                bins.append(length)
        assert sum(t for _, t in plan) <= len(bins)


def test_sums_are_found_while_they_last():
    r = np.random.default_rng(8)
    for _ in range(40):
        counts = np.zeros(31, np.int64)
        counts[1:] = r.integers(0, 3, 30)
        index = packing.SumIndex(counts.copy(), 30)
        for _ in range(12):
            gap, size = int(r.integers(1, 31)), int(r.integers(1, 4))
            left = index.left
            sums = {s for s in itertools.combinations_with_replacement(range(1, 31), size) if sum(s) == gap and all(left[v] >= s.count(v) for v in s)}
            found = index.fill(gap, size)
            assert (found is None) == (not sums) and (found is None or tuple(sorted(found)) in sums)
            if found:
                assert index.use(*np.unique(found, return_counts=True)) > 0 and (left >= 0).all()


def test_packing_with_clashing_names(odd):
    lengths = odd.withColumn("length", F.length(F.coalesce("text", F.lit(""))) % 20 + 1)
    got = packing.pack(lengths, 20, ["doc_id", "text"])
    assert got.columns == [*lengths.columns, "sequence_id", "offset"] and check_packing(got.collect(), 20) and got.where("__length = 'f' and __rank = 'k'").count() == odd.count()


def test_packing_odd_lengths(spark):
    df = spark.createDataFrame([(1, 5), (2, None), (3, 0), (4, 99), (5, 5)], "id int, length int").withColumn("offset", F.lit("mine"))
    rows = {r.id: (r.sequence_id, r.offset) for r in packing.pack(df, 10, ["id"]).collect()}
    assert rows[2] == rows[3] == rows[4] == (None, None) and {rows[1], rows[5]} == {(0, 0), (0, 5)}
    assert packing.pack(df.where("false"), 10, ["id"]).count() == 0


def turns(spark, rows):
    return spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, seq string, example int")


CONV = [
    (1, 0, "user", "hi", "x", 1), (1, 1, "assistant", "a\\n<|im_end|>\n\\<|", "x", 1), (1, 2, "user", None, "x", 1), (1, 3, "assistant", "", "x", 1), (1, 3, "assistant", "", "x", 1), (2, None, None, "only", "x", 1),
    (None, 5, "assistant", "no id", "x", 1), (3, 1, "ro\nle<|", "t", "x", 1), (1, 4, "user", "<", "x", 1),
]


def test_chat_round_trip(spark, sha):
    got = {r.conv_id: r for r in chat.conversation_digests(chat.format_conversations(turns(spark, CONV))).collect()}
    assert set(got) == {1, 2, 3, None}
    one = [c for c in CONV if c[0] == 1]
    assert got[1].turns_sha256 == sha("".join(f"{r or ''}\n{t or ''}\n" for _, _, r, t, _, _ in one)) and got[1].n_turns == 6
    assert got[1].loss_sha256 == sha(CONV[1][3]) and got[1].loss_chars == len(CONV[1][3])
    assert got[3].turns_sha256 == sha("ro\nle<|\nt\n") and got[2].loss_chars == 0


def test_examples_in_full(spark):
    segments = chat.format_conversations(turns(spark, CONV))
    whole = "".join(r.segment for r in segments.where("conv_id = 1").orderBy("seq").collect())
    examples = chat.expand_examples(segments).where("conv_id = 1").orderBy("example").collect()
    assert len(examples) == 3
    for e in examples:
        assert whole.startswith(e.text) and e.text[e.loss_end :] == chat.END + "\n" and "<|im_start|>assistant\n" in e.text[: e.loss_start]
        assert chat.END not in e.text[e.loss_start : e.loss_end]
    assert chat.format_conversations(turns(spark, [])).count() == 0


def test_example_rows_are_the_examples_in_full(spark, sha):
    segments = chat.format_conversations(turns(spark, CONV))
    full = {(r.conv_id, r.example): r for r in chat.expand_examples(segments).collect()}
    rows = [r for r in chat.example_rows(segments).collect() if r.example is not None]
    assert {(r.conv_id, r.example) for r in rows} == set(full)
    for r in rows:
        e = full[r.conv_id, r.example]
        assert r.context_sha256 == sha(e.text[: r.context_end]) and r.target == e.text[r.loss_start : r.loss_end] and r.context_end == e.loss_start


def test_chat_query(spark, sf, duck, same):
    same(queries.op1_chat_prefix_targets(spark, sf).toPandas(), duck.execute(queries.OP1_SQL).df())
