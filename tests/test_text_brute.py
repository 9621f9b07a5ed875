"""Text functions whose patterns SQL can't express, against the same patterns in Python."""

import re

import pytest
from pyspark.sql import functions as F

from remembrane.functions import text
from remembrane.plans import QUERIES

EXTRA = ["card 4111 1111 1111 1111 and 4111111111111112", "call +7 (912) 345-67-89 or 8 912 345 67 89", "112-233-445 95", "ИНН: 7707083893", "45 08 123456", "a@b.org, c.d+e@f-g.com", "", "4111-1111-1111-1111 x@y.zz"]


def luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (2 if i % 2 else 1)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def brute_pii(body):
    cards = [m for m in re.findall(text.PII_FORMS[0][1], body) if luhn(re.sub(r"\D", "", m))]
    found, rest = {"card": len(cards)}, body
    for c in dict.fromkeys(cards):
        rest = rest.replace(c, "[ПДн:card]")
    for kind, form in text.PII_FORMS[1:]:
        found[kind] = len(re.findall(form, rest))
        rest = re.sub(form, f"[ПДн:{kind}]", rest)
    return found, rest


@pytest.fixture
def docs(spark, sf):
    own = spark.createDataFrame([(-1 - i, t) for i, t in enumerate(EXTRA)], "doc_id bigint, text string")
    return spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").unionByName(own)


def test_personal_data(docs):
    got = docs.select("text", text.mask_pii(F.col("text")).alias("masked"), *(c.alias(k) for k, c in text.pii_counts(F.col("text")).items())).collect()
    for r in got:
        found, masked = brute_pii(r.text)
        assert {k: r[k] for k in found} == found and r.masked == masked
    assert sum(r.card for r in got) >= 2


def test_identifiers(docs):
    forms = re.compile("|".join(text.IDENTIFIER_FORMS))
    for r in docs.select("text", text.identifiers(F.col("text")).alias("ids")).collect():
        want: dict[str, str] = {}
        for m in forms.finditer(r.text):
            if len(m[0]) >= 3 and not re.fullmatch(r"\d{1,4}", m[0]):
                want.setdefault(m[0].lower(), m[0])
        assert r.ids == list(want.values())[: text.MAX_IDENTIFIERS]


def test_chunks_keep_all_words(spark, sf):
    chunks = QUERIES["chunk_documents_query"](spark, sf).orderBy("doc_id", "chunk_order").collect()
    whole: dict[int, list[str]] = {}
    for c in chunks:
        whole.setdefault(c.doc_id, []).extend([*(c.heading or "").split(" > "), c.text])
        assert c.text.strip() == c.text and c.text
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        lines = [x for x in r.text.split("\n") if not re.match(r"^#{1,6}\s+", x)]
        assert " ".join(" ".join(x for i, x in enumerate(whole.get(r.doc_id, [])) if i % 2).split()) == " ".join(" ".join(lines).split()) or any(x.startswith("#") for x in r.text.split("\n"))
