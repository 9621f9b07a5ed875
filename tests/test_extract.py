"""Extraction behind checks, its cache, and resolution with identities, forced and blocked pairs."""

import json

import pytest

from remembrane.operators import extract


def answer(nodes, edges=()):
    return json.dumps({"nodes": list(nodes), "edges": list(edges)})


PEOPLE = {
    "a": answer([{"id": "ivan", "label": "Ivan Petrovich Sidorov", "type": "person", "email": "I@x.ru"}, {"id": "acme", "label": "ACME", "type": "org"}]),
    "b": "text before " + answer([{"id": "ivan2", "label": "I. Sidorov", "type": "Person", "email": "i@x.ru "}, {"id": "acme2", "label": "Acme!", "type": "org"}]) + " and after",
    "c": answer([{"id": "other", "label": "Ivan Petrovich Sidorov", "type": "person", "email": "else@y.ru"}, {"id": "thing", "label": "Idea", "type": "concept"}, {"id": "", "label": "x", "type": "org"}]),
    "d": "no json", "e": answer([{"id": "p", "label": "P"}, {"id": "p", "label": "Q"}]), "f": answer([{"id": "q", "label": "Q", "type": "org"}], [{"source": "q", "target": "none"}]),
    "g": answer([{"id": "ivan", "label": "Vanya", "type": "person", "inn": "77"}]),
}


@pytest.fixture
def docs(spark):
    rows = [("1", "a"), ("2", "b"), ("3", "c"), ("4", "d"), ("5", "e"), ("6", "f"), ("7", "a"), ("8", None), ("9", "  "), ("91", "g"), ("92", "boom")]
    return spark.createDataFrame(rows, "doc string, body string")


def asking(log):
    """A model that notes what it is asked in a file that all workers share, and a function that reads the notes."""
    answers = dict(PEOPLE)

    def model(instructions, text):
        with open(log, "a") as f:
            f.write(text + "\n")
        if text == "boom":
            raise ValueError(text)
        return answers[text]

    def asked():
        with open(log) as f:
            return sorted(f.read().split())

    return model, asked


def test_extraction_is_checked_and_cached(docs, tmp_path):
    (model, asked), cache = asking(str(tmp_path / "log")), str(tmp_path / "cache")
    found = {r.key: r for r in extract.fragments(docs, "doc", "body", model, "m1", cache).collect()}
    assert set(found) == {"1", "2", "3", "4", "5", "6", "7", "91", "92"}
    assert found["1"].nodes == found["7"].nodes and len(found["1"].nodes) == 2 and not found["1"].errors
    assert found["4"].errors == ["no JSON object of nodes"] and found["5"].errors == ["id given twice"] and found["6"].errors == ["edge without node"] and found["92"].errors == ["model failed: ValueError"]
    assert all(not found[k].nodes for k in ("4", "5", "6", "92"))
    assert found["3"].errors == ["bad id"]
    assert asked() == sorted([*"abcdefg", "boom", "boom", "boom"])
    again, asked = asking(str(tmp_path / "log2"))
    assert extract.fragments(docs, "doc", "body", again, "m1", cache).count() == 9
    assert set(asked()) == {"c", "d", "e", "f", "boom"}  # only what had errors
    assert extract.fragments(docs.limit(0), "doc", "body", again, "m1", cache).count() == 0


@pytest.fixture
def some(spark):
    rows = [("p:1", "person", "Anna Maria Schmidt", "a@x", None), ("p:2", "person", "A. Schmidt", "A@x", None), ("p:3", "person", "anna maria  SCHMIDT", "b@x", None), ("p:4", "person", "Anna-Maria Schmidt", None, None), ("p:5", "person", "Jan Kowalski", None, "5"), ("o:1", "org", "Anna Maria Schmidt", None, None), ("p:6", "person", "Somebody Else Entirely", None, None)]
    return spark.createDataFrame(rows, "natural_key string, type string, title string, email string, inn string").selectExpr("*", "cast(null as string) as ogrn", "cast(null as string) as phone")


def test_merge_pairs(some):
    pairs = {(r.a, r.b) for r in extract.merge_pairs(some, forced=[("p:6", "p:5")], blocked=[("p:4", "p:1")])[0].collect()}
    assert ("p:1", "p:2") in pairs and ("p:1", "p:3") in pairs and ("p:5", "p:6") in pairs and ("p:1", "p:4") not in pairs
    assert not any("o:1" in p for p in pairs)


def test_documents_are_resolved(docs, tmp_path):
    got = extract.resolve_documents(docs.where("body <> 'c'"), "doc", "body", asking(str(tmp_path / "log"))[0], "m", str(tmp_path / "cache"))
    assert {r.natural_key: (r.title, r.email, r.inn) for r in got["nodes"].collect()} == {"person:ivan": ("Ivan Petrovich Sidorov", "I@x.ru", "77"), "org:acme": ("ACME", None, None)}
    assert {(r.src, r.dst) for r in got["edges"].collect()} == {(d, n) for d in "127" for n in ("person:ivan", "org:acme")} | {("91", "person:ivan")}
    assert {r.key for r in got["errors"].collect()} == {"4", "5", "6", "92"}
