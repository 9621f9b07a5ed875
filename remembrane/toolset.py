"""A memory's reads and its ingest as tools: names, what they take, and one call for all of them, each with a text or JSON as result."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from typing import Any

from .engine import Memory


@dataclass(frozen=True)
class Tool:
    about: str
    needs: tuple[str, ...]
    may: tuple[str, ...]
    call: Callable[[Memory, dict[str, Any], Sequence[str] | None], Any]


def rows(df, most: int = 100) -> list[dict]:
    return [r.asDict(recursive=True) for r in df.limit(most).collect()]


def _node(m: Memory, a: dict, allowed: Sequence[str] | None) -> Any:
    key = m.find_node(a["key"])
    return rows(m.node(key)[0], 1) if key else []


def _neighbors(m: Memory, a: dict, allowed: Sequence[str] | None) -> Any:
    key = m.find_node(a["key"])
    return rows(m.node(key, 1, a.get("relation", ""))[1].orderBy("direction", "type", "key")) if key else []


def _observe(m: Memory, a: dict, allowed: Sequence[str] | None) -> Any:
    raw = m.spark.createDataFrame([(json.dumps(a["observation"], ensure_ascii=False),)], "value string")
    return {"errors": [r["error"] for r in m.observe(raw, allowed=allowed).collect()]}


TOOLS = {
    "query_graph": Tool("The graph around what fits a question, as text", ("question",), ("depth", "token_budget", "mode"), lambda m, a, v: m.subgraph_text(a["question"], int(a.get("depth", 2)), int(a.get("token_budget", 2000)), a.get("mode", "bfs"))),
    "get_node": Tool("A node by key or title", ("key",), (), _node),
    "get_neighbors": Tool("What a node's edges lead to", ("key",), ("relation",), _neighbors),
    "get_community": Tool("The members of a community", ("community",), ("limit",), lambda m, a, v: rows(m.community_members(int(a["community"]), int(a.get("limit", 100))).select("natural_key", "type", "title"))),
    "shortest_path": Tool("Keys from one node to another", ("start", "goal"), (), lambda m, a, v: m.path(m.find_node(a["start"]) or "", m.find_node(a["goal"]) or "")),
    "build_context": Tool("A context pack for a question", ("question", "now"), ("tokens", "strategy", "anchors"), lambda m, a, v: rows(m.build_context(a["question"], int(a.get("tokens", 2000)), a["now"], allowed=v, strategy=a.get("strategy", "hybrid"), anchors=a.get("anchors", ())).where("kept").select("section", "id", "tokens", "score", "text").orderBy("section", "id"))),
    "remember_observation": Tool("Take in an observation", ("observation",), (), _observe),
}


def call(memory: Memory, name: str, arguments: dict[str, Any], allowed: Sequence[str] | None = None) -> str:
    """The result of a tool as text; ValueError for a tool or an argument that there is not, or one that is missing."""
    tool = TOOLS.get(name)
    if tool is None:
        raise ValueError(f"no tool {name}")
    if missing := [n for n in tool.needs if n not in arguments]:
        raise ValueError(f"{name} needs {missing[0]}")
    if extra := [n for n in arguments if n not in (*tool.needs, *tool.may)]:
        raise ValueError(f"{name} takes no {extra[0]}")
    out = tool.call(memory, arguments, allowed)
    return out if isinstance(out, str) else json.dumps(out, ensure_ascii=False, default=str)
