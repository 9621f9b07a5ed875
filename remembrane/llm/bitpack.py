"""Token ids in files of fixed-width bit packing.

A file image: magic, bits per id, ids per block, counts, then per document its id and where its ids end, then the byte
offset of each block, then the blocks. Every id takes the fewest bits that hold the vocabulary, so id i of a block lies
at bit i * bits: a block is unpacked by numpy alone, and any document can be read without the rest.

Images are rows of a table written by Spark (one image a row): they then lie in whatever store the cluster shares, and
a task that is lost or run twice leaves no half-written file. `export_images` copies them to plain files where wanted.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import byte_bpe
from .common import arrow_pieces, input_parts, materialize, range_bounds, spread, whole_text

MAGIC = b"RMBP"
HEAD = struct.Struct("<4sIIQQ")
BLOCK = 1 << 16
FILE_TOKENS = 4 << 20


def pack_bits(ids: np.ndarray, bits: int) -> bytes:
    """ids, least significant bit first, `bits` bits each."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    spread = (ids.astype(np.uint64)[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)
    return np.packbits(spread.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack_bits(raw: bytes | memoryview, n: int, bits: int) -> np.ndarray:
    if bits in (8, 16, 32):
        return np.frombuffer(raw, f"<u{bits // 8}", n).astype(np.uint32)
    spread = np.unpackbits(np.frombuffer(raw, np.uint8), bitorder="little")[: n * bits].reshape(n, bits)
    return (spread.astype(np.uint32) << np.arange(bits, dtype=np.uint32)).sum(1, dtype=np.uint32)


def write_image(doc_ids: list[int | None], lengths: list[int], ids: np.ndarray, bits: int, block: int = BLOCK) -> bytes:
    blocks = [pack_bits(ids[i : i + block], bits) for i in range(0, len(ids), block)]
    offsets = np.cumsum([0, *map(len, blocks)], dtype="<u8")
    known = np.array([d is not None for d in doc_ids], np.uint8)
    head = HEAD.pack(MAGIC, bits, block, len(doc_ids), len(ids))
    return b"".join([head, np.array([d or 0 for d in doc_ids], "<i8").tobytes(), known.tobytes(), np.cumsum(lengths, dtype="<u8").tobytes(), offsets.tobytes(), *blocks])


class Image:
    """A file image, read without unpacking more than what is asked for."""

    def __init__(self, raw: bytes):
        self.raw = memoryview(raw)
        magic, self.bits, self.block, self.n_docs, self.n_tokens = HEAD.unpack_from(raw)
        if magic != MAGIC:
            raise ValueError("not a packed id file")
        at = HEAD.size
        self.doc_ids = np.frombuffer(raw, "<i8", self.n_docs, at)
        self.known = np.frombuffer(raw, np.uint8, self.n_docs, at := at + 8 * self.n_docs)
        self.ends = np.frombuffer(raw, "<u8", self.n_docs, at := at + self.n_docs).astype(np.int64)
        n_blocks = -(-self.n_tokens // self.block)
        self.offsets = np.frombuffer(raw, "<u8", n_blocks + 1, at := at + 8 * self.n_docs).astype(np.int64)
        self.payload = at + 8 * (n_blocks + 1)

    def read(self, start: int, end: int) -> np.ndarray:
        """ids start..end of the file, from the blocks that hold them."""
        if end <= start:
            return np.zeros(0, np.uint32)
        first, last = start // self.block, (end - 1) // self.block
        parts = [unpack_bits(self.raw[self.payload + self.offsets[b] : self.payload + self.offsets[b + 1]], min(self.block, self.n_tokens - b * self.block), self.bits) for b in range(first, last + 1)]
        return np.concatenate(parts)[start - first * self.block : end - first * self.block]

    def document(self, k: int) -> np.ndarray:
        return self.read(int(self.ends[k - 1]) if k else 0, int(self.ends[k]))


IMAGES = "shard int, file int, n_docs long, n_tokens long, image binary"


def write_token_files(docs: DataFrame, tokenizer: str, end_id: int = 0, shards: int | None = None, file_tokens: int = FILE_TOKENS) -> DataFrame:
    """Encode documents and write them in ascending doc_id order; returns the written table of images.

    docs: doc_id, text; other columns are left out. Null text is empty and yields the end id alone; a null doc_id comes
    first; repeated ids are ordered by their ids' bytes and all stay. shards (default: four for each split of the input)
    are ranges of doc_id, each a task of its own, and a shard goes on in a new file after file_tokens ids, so memory is bounded by that and by
    the longest document. An empty table gives no image.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text(docs).alias("text"))
    bounds = np.array(range_bounds(rows, "doc_id", shards or 4 * input_parts(docs)), np.int64)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(tokenizer)
        end = np.array([end_id], bpe.dtype).tobytes()
        for b in arrow_pieces(batches, "text", keeps="byte_bpe"):
            packed = [bpe.encode(t) + end for t in b.column("text").to_pylist()]
            at = np.searchsorted(bounds, b.column("doc_id").fill_null(np.iinfo(np.int64).min).to_numpy(), side="right")
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), b.column("doc_id"), pa.array(packed, pa.binary())], ["shard", "doc_id", "ids"])

    def images(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(tokenizer)
        bits = max(1, (bpe.vocab - 1).bit_length())
        schema = pa.schema([("shard", pa.int32()), ("file", pa.int32()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("image", pa.binary())])
        shard, file, held, size = None, 0, [], 0

        def flush():
            ids = np.frombuffer(b"".join(x for _, x in held), bpe.dtype)
            image = write_image([d for d, _ in held], [len(x) // bpe.dtype.itemsize for _, x in held], ids, bits)
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((shard, file, len(held), len(ids), image), schema, strict=True)], schema=schema)

        for batch in batches:
            for s, d, ids in zip(*(batch.column(c).to_pylist() for c in ("shard", "doc_id", "ids")), strict=True):
                if held and (s != shard or size >= file_tokens):
                    yield flush()
                    held, size = [], 0
                    file = file + 1 if s == shard else 0
                shard = s
                held.append((d, ids))
                size += len(ids) // bpe.dtype.itemsize
        if held:
            yield flush()

    encoded = spread(rows).mapInArrow(encode, "shard int, doc_id long, ids binary")
    dealt = encoded.repartitionById(len(bounds) + 1, "shard").sortWithinPartitions("shard", "doc_id", "ids")
    return materialize(dealt.mapInArrow(images, IMAGES), "token-files")


def read_token_files(files: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the images: start counts the ids of all documents before."""
    before = Window.orderBy("shard", "file").rowsBetween(Window.unboundedPreceding, -1)
    starts = files.select("shard", "file", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).cast("long").alias("base"))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, file, raw in zip(batch.column("shard").to_pylist(), batch.column("file").to_pylist(), batch.column("image"), strict=True):
                image = Image(raw.as_py())
                ids, ends = image.read(0, image.n_tokens).astype("<u4"), image.ends
                begins = np.concatenate([[0], ends[:-1]])
                crcs = [zlib.crc32(ids[a:b].data) if b > a else 0 for a, b in zip(begins, ends, strict=True)]
                place = [pa.array(np.full(image.n_docs, x), pa.int32()) for x in (shard, file)]
                yield pa.RecordBatch.from_arrays([*place, pa.array(image.doc_ids, pa.int64(), mask=image.known == 0), pa.array(begins, pa.int64()), pa.array(ends - begins, pa.int64()), pa.array(crcs, pa.int64())], ["shard", "file", "doc_id", "begin", "n_tokens", "ids_crc32"])

    # joined after decoding, so that no image is shuffled
    rows = files.select("shard", "file", "image").mapInArrow(decode, "shard int, file int, doc_id long, begin long, n_tokens long, ids_crc32 long")
    return rows.join(starts, ["shard", "file"]).select("doc_id", (F.col("base") + F.col("begin")).alias("start"), "n_tokens", "ids_crc32")


def export_images(files: DataFrame, folder: str) -> list[str]:
    """Copy images, one at a time, to plain files in a folder of the driver; returns their names in order."""
    from pathlib import Path

    names = []
    for row in files.orderBy("shard", "file").toLocalIterator():
        path = Path(folder) / f"tokens-{row['shard']:06d}-{row['file']:04d}.bin"
        path.write_bytes(row["image"])
        names.append(str(path))
    return names
