"""Row predicates as columns: visibility, validity intervals, attribute conditions."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Scopes that restrict who sees a row, and the limits of a request.
VISIBILITY_PREFIXES = ("workspace:", "principal:")
MAX_NAMESPACES = 50
MAX_CLAUSES = 20
MAX_IN_VALUES = 100
OPERATORS = ("eq", "in", "prefix", "lte", "gte", "exists")

NAMESPACE = r"^[a-z0-9][a-z0-9._:-]{0,199}$"


def resolve_namespaces(names: Iterable[str], default: str = "") -> list[str]:
    """Checked namespaces, each once, in order; the default where none is given."""
    import re

    found = list(dict.fromkeys(n.strip() for n in names if n and n.strip())) or ([default] if default else [])
    if len(found) > MAX_NAMESPACES:
        raise ValueError(f"more than {MAX_NAMESPACES} namespaces")
    if bad := [n for n in found if not re.match(NAMESPACE, n)]:
        raise ValueError(f"not a namespace: {bad[0]!r}")
    return found


def resolve_scopes(scopes: Iterable[str], limit: int = 50) -> list[str]:
    """Scopes in the form type:id, each once, in order."""
    found = list(dict.fromkeys(f"{t.strip()}:{i.strip()}" for t, _, i in (s.partition(":") for s in scopes) if t.strip() and i.strip()))
    if len(found) > limit:
        raise ValueError(f"more than {limit} scopes")
    return found


def is_visibility(scope: Column) -> Column:
    return reduce(lambda a, b: a | b, [scope.startswith(p) for p in VISIBILITY_PREFIXES])


def has_visibility_scope(scopes: Column) -> Column:
    return F.exists(F.coalesce(scopes, F.array()), is_visibility)


def strings(values: Iterable[str]) -> Column:
    return F.array(*(F.lit(v) for v in values)).cast("array<string>")


def visible(scopes: Column, allowed: Sequence[str] | None) -> Column:
    """No restriction asked (None), none on the row, or one of the row's scopes allowed. An empty list allows open rows only."""
    if allowed is None:
        return F.lit(True)
    return ~has_visibility_scope(scopes) | F.arrays_overlap(F.coalesce(scopes, F.array().cast("array<string>")), strings(allowed))


def scope_match(scopes: Column, wanted: Sequence[str]) -> Column:
    """Rows without scopes and rows that share one with the request; all rows if nothing is wanted."""
    if not wanted:
        return F.lit(True)
    return (F.size(F.coalesce(scopes, F.array().cast("array<string>"))) == 0) | F.arrays_overlap(scopes, strings(wanted))


def contains_meta(meta: Column, wanted: dict[str, str]) -> Column:
    """Each wanted key of a map has the wanted value."""
    return reduce(lambda a, b: a & b, [F.coalesce(meta[k] == v, F.lit(False)) for k, v in wanted.items()], F.lit(True))


def valid_at(valid_from: Column, valid_to: Column, as_of: Column | str | None) -> Column:
    """Half-open validity at a point in time; without one, whether the interval is still open."""
    if as_of is None or isinstance(as_of, str) and not as_of:
        return valid_to.isNull()
    t = F.lit(as_of) if isinstance(as_of, str) else as_of
    began = valid_from.isNull() | (valid_from.cast("string") == "") | (valid_from <= t)
    return began & (valid_to.isNull() | (valid_to > t))


def overlaps(a_from: Column, a_to: Column, b_from: Column, b_to: Column) -> Column:
    """Two half-open intervals share a point; a missing end is open."""
    before = lambda x, y: x.isNull() | y.isNull() | (x < y)
    return before(a_from, b_to) & before(b_from, a_to)


NUMBER = r"^[+-]?\d+(\.\d+)?([eE][+-]?\d+)?$"


def where_clause(value: Column, kind: Column, clause: dict) -> Column:
    """One condition {attr, op, value} on an attribute given as text and its JSON kind ('string', 'number', 'boolean', 'list').

    A list, given as JSON, fulfils a condition if any of its items does; exists asks for an item. An item's kind is taken
    from its form.
    """
    items = F.coalesce(F.from_json(F.when(kind == "list", value), "array<string>"), F.array().cast("array<string>"))
    if clause["op"] == "exists":
        present = value.isNotNull() & ((kind != "list") | (F.size(items) > 0))
        return F.coalesce(present, F.lit(False)) if clause.get("value") in (True, None) else ~F.coalesce(present, F.lit(False))
    form = lambda x: F.when(x.rlike(NUMBER), "number").when(x.isin("true", "false"), "boolean").otherwise("string")
    return F.when(F.coalesce(kind == "list", F.lit(False)), F.coalesce(F.exists(items, lambda x: scalar_clause(x, form(x), clause)), F.lit(False))).otherwise(scalar_clause(value, kind, clause))


def scalar_clause(value: Column, kind: Column, clause: dict) -> Column:
    """One condition on a scalar.

    Numbers compare as numbers, booleans only with booleans, other values as text; lte and gte take numbers or ISO
    dates of one kind. A missing attribute matches nothing but exists: false.
    """
    op, want = clause["op"], clause.get("value")
    if op not in OPERATORS:
        raise ValueError(f"unknown operator {op!r}")
    if op == "prefix":
        return F.coalesce((value == F.lit(str(want))) | value.startswith(f"{want}."), F.lit(False))
    if op == "in":
        if len(want) > MAX_IN_VALUES:
            raise ValueError(f"more than {MAX_IN_VALUES} values")
        return reduce(lambda a, b: a | b, [scalar_clause(value, kind, clause | {"op": "eq", "value": v}) for v in want], F.lit(False))
    if isinstance(want, bool):
        same = (kind == "boolean") & (value == F.lit(str(want).lower()))
        return F.coalesce(same, F.lit(False)) if op == "eq" else F.lit(False)
    if isinstance(want, (int, float)):
        number = F.when(kind == "number", value.try_cast("double"))
        test = {"eq": number == want, "lte": number <= want, "gte": number >= want}[op]
        return F.coalesce(test, F.lit(False))
    if op == "eq":
        return F.coalesce((kind == "string") & (value == F.lit(want)), F.lit(False))
    at, bound = F.try_to_timestamp(value), F.try_to_timestamp(F.lit(want))
    return F.coalesce(at <= bound if op == "lte" else at >= bound, F.lit(False))


def where(attributes: Column, kinds: Column, clauses: Sequence[dict]) -> Column:
    """All conditions hold on a map of attributes and a map of their kinds."""
    if len(clauses) > MAX_CLAUSES:
        raise ValueError(f"more than {MAX_CLAUSES} conditions")
    return reduce(lambda a, b: a & b, [where_clause(attributes[c["attr"]], kinds[c["attr"]], c) for c in clauses], F.lit(True))


def schema_violations(value: dict[str, Column], schema: dict) -> Column:
    """Violations of a JSON-Schema subset by a row given as columns by property: an array of texts, empty where it conforms."""
    found = []
    for name in schema.get("required", []):
        found.append(F.when(value[name].isNull() if name in value else F.lit(True), F.lit(f"$.{name}: required")))
    for name, rule in schema.get("properties", {}).items():
        if name not in value:
            continue
        c, path = value[name], f"$.{name}"
        tests = {
            "enum": lambda r, c=c: ~c.isin(r), "const": lambda r, c=c: c != F.lit(r), "pattern": lambda r, c=c: ~c.rlike(r), "minLength": lambda r, c=c: F.length(c) < r,
            "maxLength": lambda r, c=c: F.length(c) > r, "minimum": lambda r, c=c: c < r, "maximum": lambda r, c=c: c > r,
        }
        found += [F.when(F.coalesce(test(rule[key]), F.lit(False)), F.lit(f"{path}: {key}")) for key, test in tests.items() if key in rule]
    return F.array_compact(F.array(*found)) if found else F.array().cast("array<string>")
