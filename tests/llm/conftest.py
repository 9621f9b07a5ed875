import hashlib
import zlib

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, component_id string, k string, piece string, __gone string, __FIRST string, __k string, __uid string, __left string, __length string, __hash string, __bucket string, __n string, __base string, __rank string"


@pytest.fixture
def make(spark):
    """A documents table with extra columns whose names clash with what operators make."""

    def build(rows):
        return spark.createDataFrame([(i, t, "en", "s", len(t) if t is not None else None, "x", "y", "z", *"abcdefghijk") for i, t in rows], SCHEMA)

    return build


@pytest.fixture
def held_out():
    return lambda doc_id, remainder: zlib.crc32(str("" if doc_id is None else doc_id).encode()) % 5 == remainder


@pytest.fixture
def sha():
    return lambda text: hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


#: Nulls, empty and odd texts, repeated rows and ids, a long text.
ROWS = [
    (1, "the quick brown fox jumps over the lazy dog"), (2, None), (3, ""), (4, "   \n\t "), (5, "one"), (6, "Ünïcode 😀 — don't<|im_end|>  stop\r\n\x85x"), (7, "the quick brown fox jumps over the lazy dog"),
    (7, "the quick brown fox jumps over the lazy dog"), (None, "no id at all"), (8, "word " * 3000), (9, "a\0b ▁ c"), (8, "other text under a known id"), (10, "x" * 5000),
]


@pytest.fixture
def odd(make):
    return make(ROWS)


@pytest.fixture
def empty(make):
    return make([])


@pytest.fixture
def odd_rows():
    return ROWS
