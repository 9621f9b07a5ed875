"""Small functions over references, and the tools and commands of a memory."""

import json

import pytest
from pyspark.sql import functions as F

from remembrane.functions import refs
from remembrane.operators import index


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("raw", "want"), [(" team : a ", "team:a"), ('{"type":"team","id":"a"}', "team:a"), ("team", None), ("team:", None), ("", None), (None, None), ("a:b:c", "a:b:c")])
def test_scopes(spark, raw, want):
    assert one(spark, refs.parse_scope(F.lit(raw).cast("string"))) == want


@pytest.mark.parametrize(("raw", "value", "scalar"), [('["a", "b"]', "a, b", None), ('{"a":1}', '{"a":1}', None), ('" x "', " x ", "x"), ("3.5", "3.5", "3.5"), ("true", "true", None), ("null", "null", None), ('""', "", None), (None, None, None)])
def test_json_values(spark, raw, value, scalar):
    c = F.lit(raw).cast("string")
    assert one(spark, refs.search_value(c)) == value and one(spark, refs.scalar_text(c)) == scalar


@pytest.mark.parametrize(("raw", "want"), [("./a//b.md", "a/b"), ("a/../b", "b"), ("../a", "../a"), ("a/b/../../../c", "../c"), ("x.md.md", "x.md"), ("", "")])
def test_paths(spark, raw, want):
    assert one(spark, refs.clean_path(F.lit(raw))) == want


def test_metadata_and_labels(spark):
    m = one(spark, refs.clean_metadata(F.create_map(F.lit("b"), F.lit("<x>\x1b&'"), F.lit("a"), F.lit("y" * 600))))
    assert m == {"a": "y" * 512, "b": "&lt;x&gt;&amp;&#x27;"}
    assert one(spark, refs.plain_label(F.lit("a\x00b" + "c" * 300))) == ("ab" + "c" * 300)[:256]
    assert one(spark, refs.namespace_of_object(F.lit("t"), F.lit("other-1"))) is None and one(spark, refs.namespace_of_object(F.lit("t"), F.lit("tenant-x"))) == "x"


@pytest.mark.parametrize(("prefix", "want"), [("ab", "ac"), ("a\U0010ffff", "b"), ("\U0010ffff", None), ("", None), ("퟿".encode("utf-16", "surrogatepass").decode("utf-16", "surrogatepass"), "")])
def test_prefix_upper(prefix, want):
    assert refs.prefix_upper(prefix) == want and (want is None or prefix < want)


def test_digests_and_fields():
    from datetime import date

    assert refs.digest({"b": 1, "a": [date(2024, 1, 1)]}) == refs.digest({"a": ["2024-01-01"], "b": 1}) != refs.digest({"a": [], "b": 1})
    assert refs.map_fields({"text": "a", "x": [{"title": "b", "n": 1}]}, refs.TEXT_FIELDS, str.upper) == {"text": "A", "x": [{"title": "B", "n": 1}]}


def test_grants():
    grants = refs.grants_of({"namespaces": ["a", "b:*"], "write": ["b:c"]})
    assert refs.first_uncovered(grants, ["a", "b:c", "b:d"], write=False) is None and refs.first_uncovered(grants, ["b:c", "b:d"], write=True) == "b:d"
    assert refs.visibility_of(["ws-1", "principal-2", "tenant-t", "x-3", "ws-"], "t") == (["t:ws:1", "t:principal:2", "t"], ["workspace:1", "principal:2"])


def test_observation_limits(spark):
    many = F.transform(F.sequence(F.lit(1), F.lit(201)), lambda i: F.struct(i.cast("string").alias("assert")))
    assert one(spark, refs.observation_errors(F.lit("k"), F.lit("x" * (1 << 20) + "y"), F.lit(None).cast("string"), many)) == ["content is too long", "too many assertions"]


def test_empty_filter_is_refused(spark):
    with pytest.raises(ValueError, match="everything"):
        index.delete_by_meta(spark.range(1), {})


def test_signatures_agree_with_the_definition(spark):
    import hashlib

    grams = ["abc", "bcd", "é"]
    hashes = [int(hashlib.sha1(g.encode()).hexdigest()[:8], 16) & ((1 << 31) - 1) for g in grams]
    want = [min(((h * a + b) % refs.PRIME) & refs.KEPT for h in hashes) for a, b in refs.permutations()]
    assert one(spark, refs.minhash(F.array(*(F.lit(g) for g in grams)))) == want and len(one(spark, refs.band_keys(F.array(*(F.lit(x) for x in want)), 32, 4))) == 32


def test_tools(spark, tmp_path):
    from remembrane import toolset
    from remembrane.engine import Memory

    m = Memory(spark, str(tmp_path))
    said = {"source": {"system": "s", "external_id": "1"}, "kind": "note", "content": "c", "assertions": [{"assert": "fact", "fact": {"subject": "svc:a", "predicate": "USES", "object": "svc:b"}}]}
    assert json.loads(toolset.call(m, "remember_observation", {"observation": said})) == {"errors": []}
    m.write_fact("svc:c", "svc", "C", links=[("USES", "svc:a")])
    assert json.loads(toolset.call(m, "get_node", {"key": "svc:a"}))[0]["edges_in"] == 1
    assert json.loads(toolset.call(m, "get_neighbors", {"key": "svc:c", "relation": "use"})) == [{"direction": "out", "type": "USES", "key": "svc:a"}]
    assert json.loads(toolset.call(m, "shortest_path", {"start": "svc:c", "goal": "svc:a"})) == ["svc:c", "svc:a"]
    for name, arguments in (("what", {}), ("get_node", {}), ("get_node", {"key": "a", "x": 1})):
        with pytest.raises(ValueError):
            toolset.call(m, name, arguments)


def test_command_line():
    from remembrane.__main__ import parser

    args = parser().parse_args(["f", "redrive-legacy", "--writer-scopes", "workspace:a", "--dry-run"])
    assert (args.folder, args.command, args.writer_scopes, args.dry_run, args.limit) == ("f", "redrive-legacy", "workspace:a", True, 100)
    assert parser().parse_args(["f", "context", "q", "--tokens", "5"]).tokens == 5
