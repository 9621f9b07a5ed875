"""References, scopes, keys, labels and payloads: small column functions."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Mapping, Sequence
from datetime import date, datetime
from functools import reduce
from typing import Any

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from .predicates import NAMESPACE, is_visibility

# Forms of policy objects that stand for namespaces, the greatest length of a label, limits of metadata.
POLICY_OBJECTS = ("ws", "principal", "tenant")
MAX_LABEL, MAX_VALUE, MAX_LIST = 256, 512, 50
# Greatest sizes of an observation's texts in bytes and number of its assertions.
MAX_CONTENT, MAX_ASSERTIONS = 1 << 20, 200
# Fields of an answer that hold free text.
TEXT_FIELDS = ("text", "context", "content", "title", "answer", "heading")
# Permutations of a signature, the prime they are taken modulo, and the bits that are kept.
PERMUTATIONS, PRIME, KEPT = 128, (1 << 61) - 1, (1 << 32) - 1


def canonical_scope(kind: Column, ident: Column) -> Column:
    """type:id from its parts; null where one is empty."""
    a, b = F.trim(kind), F.trim(ident)
    return F.when((F.length(a) > 0) & (F.length(b) > 0), F.concat(a, F.lit(":"), b))


def parse_scope(raw: Column) -> Column:
    """A scope given as type:id or as a JSON object with type and id, in the form type:id; null where it is none."""
    parts = F.from_json(raw, "type string, id string")
    plain = canonical_scope(F.substring_index(raw, ":", 1), F.when(F.instr(raw, ":") > 0, F.substr(raw, F.instr(raw, ":") + 1)))
    return F.when(F.ltrim(raw).startswith("{"), canonical_scope(parts["type"], parts["id"])).otherwise(plain)


def ref_type(ref: Column, default: str = "entity") -> Column:
    """The type of a reference struct (key, type, id): its own, else what stands before the colon of its key."""
    prefix = F.when(F.instr(ref["key"], ":") > 0, F.substring_index(ref["key"], ":", 1))
    return F.coalesce(F.nullif(F.trim(ref["type"]), F.lit("")), F.nullif(prefix, F.lit("")), F.lit(default))


def namespace_of_object(tenant: Column, obj: Column) -> Column:
    """The namespace of a policy object: its tenant's for a tenant, else one below it for ws-<id> or principal-<id>; null for others."""
    kind, ident = F.substring_index(obj, "-", 1), F.substr(obj, F.instr(obj, "-") + 1)
    known = (F.instr(obj, "-") > 0) & (F.length(ident) > 0) & kind.isin(*POLICY_OBJECTS)
    return F.when(known & (kind == "tenant"), ident).when(known, F.concat_ws(":", tenant, kind, ident))


def valid_namespace(name: Column) -> Column:
    return F.coalesce(name.rlike(NAMESPACE), F.lit(False))


def scopes_of(props: Column, payload: Column | None = None) -> Column:
    """Scopes in a JSON text of properties, those in its payload, too: an array, empty where there are none."""
    own = F.from_json(props, "scopes array<string>")["scopes"]
    inner = F.from_json(payload if payload is not None else F.get_json_object(props, "$.payload"), "scopes array<string>")["scopes"]
    none = F.array().cast("array<string>")
    return F.array_distinct(F.concat(F.coalesce(own, none), F.coalesce(inner, none)))


def audit_scopes(scopes: Column) -> Column:
    """What an audit event keeps of an object's scopes: those that restrict, in order of name."""
    return F.array_sort(F.filter(scopes, is_visibility))


def plain_label(text: Column) -> Column:
    """A label without control characters, cut to MAX_LABEL."""
    return F.substr(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x00-\x1f\x7f]", ""), F.lit(1), F.lit(MAX_LABEL))


def escape_html(text: Column) -> Column:
    return reduce(lambda c, x: F.replace(c, F.lit(x[0]), F.lit(x[1])), (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")), text)


def clean_metadata(meta: Column) -> Column:
    """A map of texts without control characters, escaped for HTML, values and their number cut to the limits, in order of key."""
    short = lambda c, most: escape_html(F.substr(F.regexp_replace(c, r"[\x00-\x1f\x7f]", ""), F.lit(1), F.lit(most)))
    entries = F.slice(F.array_sort(F.map_entries(meta)), 1, MAX_LIST)
    return F.map_from_entries(F.transform(entries, lambda e: F.struct(short(e["key"], MAX_LABEL).alias("key"), short(e["value"], MAX_VALUE).alias("value"))))


def search_value(raw: Column) -> Column:
    """A JSON value as text for search: a list's items joined by commas, objects as they are, texts without quotes."""
    items = F.from_json(raw, "array<string>")
    return F.when(F.ltrim(raw).startswith("["), F.array_join(items, ", ")).when(raw.rlike(r'^\s*"'), F.get_json_object(F.concat(F.lit('{"v":'), raw, F.lit("}")), "$.v")).otherwise(raw)


def scalar_text(raw: Column) -> Column:
    """A JSON scalar as trimmed text; null for booleans, null, lists, objects and empty texts."""
    text = F.trim(search_value(raw))
    return F.when(F.trim(raw).isin("true", "false", "null") | raw.rlike(r"^\s*[\[{]"), None).otherwise(F.nullif(text, F.lit("")))


def look_up(name: str, *sources: Column) -> Column:
    """A placeholder's value from maps in order: by its exact name in any of them first, then regardless of case."""
    exact = [F.nullif(F.trim(F.try_element_at(m, F.lit(name))), F.lit("")) for m in sources]
    loose = [F.nullif(F.trim(F.get(F.filter(F.map_entries(m), lambda e: F.lower(e["key"]) == name.lower()), F.lit(0))["value"]), F.lit("")) for m in sources]
    return F.coalesce(*exact, *loose)


def alias_forms(forms: Sequence[str], attributes: Column, parts: Column) -> Column:
    """Aliases of a key by templates like {name}: from attributes, then from the key's own parts; forms with a gap are left out."""
    import re

    out = []
    for form in forms:
        names = re.findall(r"\{([^{}\s]+)\}", form)
        texts = re.split(r"\{[^{}\s]+\}", form)
        cells = [F.lit(texts[0])]
        for name, text in zip(names, texts[1:], strict=True):
            cells += [look_up(name, attributes, parts), F.lit(text)]
        out.append(F.concat(*cells))
    return F.array_distinct(F.array_compact(F.array(*out))) if out else F.array().cast("array<string>")


def prefix_upper(prefix: str) -> str | None:
    """The least text above all that begin with prefix; None where there is none."""
    for i in range(len(prefix) - 1, -1, -1):
        if ord(prefix[i]) < 0x10FFFF:
            return prefix[:i] + chr(ord(prefix[i]) + 1 if ord(prefix[i]) != 0xD7FF else 0xE000)
    return None


def source_path(citation: Column, source: Column, snapshot: Column) -> Column:
    """A version's own citation, else the snapshot that it comes from."""
    return F.coalesce(F.nullif(citation, F.lit("")), F.concat(F.lit("snapshot:"), source, F.lit("/"), snapshot))


def embedding_input(title: Column, heading: Column, text: Column) -> Column:
    """What is embedded of a chunk: title and heading on a line of their own, where there are any, then the text."""
    head = F.array_join(F.array_compact(F.array(F.nullif(title, F.lit("")), F.nullif(heading, F.lit("")))), " — ")
    return F.when(F.length(head) > 0, F.concat(head, F.lit("\n"), text)).otherwise(text)


def matter_links(items: Column) -> Column:
    """Links in front matter (array of texts): [[path#anchor|alias]] or a bare path, as structs; empty items are left out."""
    inner = F.transform(F.filter(items, lambda x: F.length(F.trim(x)) > 0), lambda x: F.trim(F.regexp_replace(F.trim(x), r"^\[\[|\]\]$", "")))

    def parse(raw: Column) -> Column:
        target = F.trim(F.substring_index(raw, "|", 1))
        alias = F.when(F.instr(raw, "|") > 0, F.nullif(F.trim(F.substr(raw, F.instr(raw, "|") + 1)), F.lit("")))
        anchor = F.when(F.instr(target, "#") > 0, F.trim(F.substr(target, F.instr(target, "#") + 1)))
        return F.struct(F.trim(F.substring_index(target, "#", 1)).alias("path"), anchor.alias("anchor"), alias.alias("alias"))

    return F.transform(inner, parse)


def link_ids(link: Column) -> Column:
    """Parts of a link (path, anchor, alias) that look like an id, anchor first: a letter, then letters, digits, dots or dashes with a digit."""
    parts = F.array_compact(F.array(link["anchor"], link["alias"], F.element_at(F.split(link["path"], "/"), -1)))
    return F.array_distinct(F.filter(parts, lambda p: p.rlike(r"^[A-Za-z][A-Za-z0-9_.-]*\d[A-Za-z0-9_.-]*$")))


def clean_path(path: Column) -> Column:
    """A relative path with single slashes, without . and .. steps and without .md at its end."""
    steps = F.filter(F.split(F.regexp_replace(F.trim(path), r"\\", "/"), "/"), lambda s: (s != "") & (s != "."))
    up = lambda out, s: F.when((s == "..") & (F.size(out) > 0) & (F.element_at(out, -1) != ".."), F.slice(out, 1, F.size(out) - 1)).otherwise(F.concat(out, F.array(s)))
    folded = F.aggregate(steps, F.array().cast("array<string>"), lambda out, s: F.when(F.size(out) > 0, up(out, s)).otherwise(F.array(s)))
    return F.regexp_replace(F.array_join(folded, "/"), r"\.md$", "")


def utc_time(value: Column) -> Column:
    """ISO time in UTC with its fraction of a second, if any; null where it is no time."""
    at = F.try_to_timestamp(value)
    micros = F.date_format(at, "SSSSSS")
    return F.concat(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss"), F.when(micros != "000000", F.concat(F.lit("."), micros)).otherwise(""), F.lit("Z"))


def graph_value(raw: Column) -> Column:
    """A graph value as JSON text: without the ::type that may follow it."""
    return F.regexp_replace(raw, r"::[a-z]+\s*$", "")


def jsonable(value: Any) -> Any:
    """A driver-side value with dates as ISO texts and keys as texts, all the way down."""
    if isinstance(value, Mapping):
        return {str(k): jsonable(v) for k, v in value.items()}
    if isinstance(value, (list, tuple, set)):
        return [jsonable(v) for v in value]
    return value.isoformat() if isinstance(value, (date, datetime)) else value


def digest(payload: Any) -> str:
    """sha256 of a payload as JSON with sorted keys: equal payloads in any order of keys have equal digests."""
    return hashlib.sha256(json.dumps(jsonable(payload), sort_keys=True, ensure_ascii=False, separators=(",", ":")).encode()).hexdigest()


def map_digest(*parts: Column) -> Column:
    """sha256 of texts and maps of texts, maps in order of key: a digest that columns make by themselves."""
    return F.sha2(F.concat_ws("\u001f", *parts), 256)


def map_text(m: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(F.map_entries(m)), lambda e: F.concat_ws("=", e["key"], F.coalesce(e["value"], F.lit("")))), "\u001e")


def map_fields(payload: Any, fields: Sequence[str], change) -> Any:
    """A payload with change applied to the texts in these fields, all the way down."""
    if isinstance(payload, Mapping):
        return {k: change(v) if k in fields and isinstance(v, str) else map_fields(v, fields, change) for k, v in payload.items()}
    return [map_fields(v, fields, change) for v in payload] if isinstance(payload, list) else payload


def observation_errors(kind: Column, content: Column, data: Column, assertions: Column) -> Column:
    """What is wrong with an observation: an array of texts, empty where all is well."""
    empty = lambda c: F.coalesce(F.length(F.trim(c)), F.lit(0)) == 0
    n = F.coalesce(F.size(assertions), F.lit(0))
    tests = [
        F.when(empty(kind), "kind is missing"), F.when(F.octet_length(content) > MAX_CONTENT, "content is too long"), F.when(F.octet_length(data) > MAX_CONTENT, "data is too long"),
        F.when(n > MAX_ASSERTIONS, "too many assertions"), F.when(empty(content) & empty(data) & (n <= 0), "nothing in it"),
    ]
    return F.array_compact(F.array(*tests))


def permutations() -> list[tuple[int, int]]:
    """Factors and summands of the permutations, from a fixed seed."""
    r = np.random.default_rng(1)
    return list(zip(r.integers(1, 1 << 31, PERMUTATIONS).tolist(), r.integers(0, 1 << 31, PERMUTATIONS).tolist(), strict=True))


def minhash(grams: Column) -> Column:
    """The signature of a set of texts: the smallest value of its 31-bit hashes under each permutation, 32 bits of it kept."""
    hashes = F.transform(grams, lambda g: F.conv(F.substr(F.sha1(g), F.lit(1), F.lit(8)), 16, 10).cast("long").bitwiseAND((1 << 31) - 1))
    given = F.array(*(F.struct(F.lit(a).cast("long").alias("a"), F.lit(b).cast("long").alias("b")) for a, b in permutations()))
    value = lambda h, p: ((h * p["a"] + p["b"]) % F.lit(PRIME)).bitwiseAND(KEPT)
    return F.get(F.transform(F.array(hashes), lambda own: F.transform(given, lambda p: F.array_min(F.transform(own, lambda h: value(h, p))))), F.lit(0))


def band_keys(signature: Column, bands: int, rows: int) -> Column:
    """A key for each band of so many values of a signature."""
    each = F.sequence(F.lit(0), F.lit(bands - 1))
    return F.transform(each, lambda i: F.concat_ws("|", i, F.array_join(F.transform(F.slice(signature, i * rows + 1, F.lit(rows)), lambda x: x.cast("string")), ",")))


def grants_of(claims: Mapping[str, Any]) -> dict[str, str]:
    """Namespace grants of a token's claims: {namespaces: [...], write: [...]}, names or name:* for what is below."""
    read = {str(n): "r" for n in claims.get("namespaces", []) if n}
    return read | {str(n): "rw" for n in claims.get("write", []) if n}


def first_uncovered(grants: Mapping[str, str], namespaces: Sequence[str], write: bool) -> str | None:
    """The first namespace that grants don't let in; None if all are."""
    from ..operators.tables import grants_allow

    return next((n for n in namespaces if not grants_allow(dict(grants), n, write)), None)


def visibility_of(objects: Sequence[str], tenant: str) -> tuple[list[str], list[str]]:
    """Namespaces and restricting scopes that a policy's objects (ws-<id>, principal-<id>, tenant-<id>) give a principal."""
    spaces, scopes = [], []
    for o in objects:
        kind, _, ident = o.partition("-")
        if kind not in POLICY_OBJECTS or not ident:
            continue
        spaces.append(ident if kind == "tenant" else f"{tenant}:{kind}:{ident}")
        if kind != "tenant":
            scopes.append(f"{'workspace' if kind == 'ws' else 'principal'}:{ident}")
    return list(dict.fromkeys(spaces)), list(dict.fromkeys(scopes))
