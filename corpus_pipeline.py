"""From raw documents to packed token sequences.

Each stage gets what the one before it returned, written as Parquet and read again, and works on all of it. Null texts
count as empty, rows with a null doc_id and repeated rows stay rows of their own until a stage drops them as copies, an
empty table gives an empty one, and columns beyond doc_id and text go through unread.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from remembrane.llm.common import materialize
from remembrane.llm.minhash import drop_near_duplicates
from remembrane.llm.packing import pack, token_pieces
from remembrane.llm.quality import keep_good
from remembrane.llm.suffix import without_repeats


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labels of documents not held out, does not reject.

    Empty and null texts get a score like any other, from their features.
    """
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (shingles of five words, similarity of 0.8 or more) the smallest doc_id.

    Texts without words are near to nothing and stay; of rows that repeat a doc_id the one with the smallest text stays, rows with
    a null doc_id all stay.
    """
    return drop_near_duplicates(docs, size=5, percent=80)


def repeat_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of 200 bytes or more that stand anywhere else as well.

    Every copy of a passage goes, so a text that is repeated whole becomes empty; the row stays.
    """
    return without_repeats(docs, width=200)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of a document: its sequence of at most 1024 tokens and its place there.

    An empty text is one piece that holds its end token alone. Pieces of equal length go by their rows' numbers.
    """
    pieces = token_pieces(docs, "byte_bpe_50k.json", capacity=1024, end_id=2)
    return pack(pieces, 1024, ["doc_id", "piece", "ids_crc32"])


STAGES = [
    ("quality classifier", quality_stage),
    ("MinHash near-dedup", near_duplicate_stage),
    ("suffix-array dedup", repeat_stage),
    ("best-fit packing", packing_stage),
]

#: The stages have no form in SQL; tests/llm hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole documents table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
