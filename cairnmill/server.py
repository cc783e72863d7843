"""The six query tools over JSON lines (JSON-RPC 2.0): one request a line in, one answer a line out."""

from __future__ import annotations

import json
from typing import IO

from cairnmill.api import NotFound, Project, to_json
from cairnmill.schemas import DEFAULT_TOP_K

#: Rows that one answer holds, at most; `total` says how many there are.
MOST_ROWS = 1000

_TEXT, _NUMBER = {"type": "string"}, {"type": "integer"}
TOOLS = {
    "search_hybrid": ("Chunks that answer a query, by vector and keyword ranks", {"query": _TEXT, "top_k": _NUMBER}, ["query"]),
    "query_by_concept": ("The entity of a name and its relations", {"concept": _TEXT}, ["concept"]),
    "get_related_entities": ("Entities within some hops of one", {"entity_id": _TEXT, "depth": _NUMBER}, ["entity_id"]),
    "get_ontology_schema": ("Entity and relation types with their numbers", {}, []),
    "explain_relation": ("The shortest chain of relations between two entities", {"entity_a": _TEXT, "entity_b": _TEXT}, ["entity_a", "entity_b"]),
    "query_ontological": ("An answer from the graph, or from search where the graph has none", {"question": _TEXT}, ["question"]),
}


class BadRequest(ValueError):
    pass


def _rows(df) -> dict:
    got = to_json(df.limit(MOST_ROWS))
    return {"rows": got, "total": len(got) if len(got) < MOST_ROWS else df.count()}


def call(project: Project, tool: str, given: dict) -> dict:
    if tool not in TOOLS:
        raise BadRequest(f"unknown tool: {tool}")
    _, known, needed = TOOLS[tool]
    missing = [k for k in needed if k not in given]
    wrong = [k for k, v in given.items() if k not in known or not isinstance(v, int if known[k] is _NUMBER else str) or isinstance(v, bool)]
    if missing or wrong:
        raise BadRequest(f"{tool}: missing {missing}, unknown or of a wrong type {wrong}")
    if tool == "search_hybrid":
        return _rows(project.search_hybrid(given["query"], given.get("top_k", DEFAULT_TOP_K)))
    if tool == "query_by_concept":
        entity, relations = project.query_by_concept(given["concept"])
        return {"entity": entity, "relations": _rows(relations)}
    if tool == "get_related_entities":
        return _rows(project.get_related_entities(given["entity_id"], given.get("depth", 1)))
    if tool == "get_ontology_schema":
        entities, relations = project.get_ontology_schema()
        return {"entity_types": _rows(entities), "relation_types": _rows(relations)}
    if tool == "explain_relation":
        return _rows(project.explain_relation(given["entity_a"], given["entity_b"]))
    return project.query_ontological(given["question"])


def answer(project: Project, line: str) -> dict | None:
    """The answer to one line; None for notifications."""
    try:
        request = json.loads(line)
        if not isinstance(request, dict) or not isinstance(request.get("method"), str):
            raise ValueError
    except ValueError:
        return {"jsonrpc": "2.0", "id": None, "error": {"code": -32700, "message": "not a request"}}
    method, given, number = request["method"], request.get("params") or {}, request.get("id")
    reply = {"jsonrpc": "2.0", "id": number}
    try:
        if method == "initialize":
            return reply | {"result": {"protocolVersion": given.get("protocolVersion", "2024-11-05"), "capabilities": {"tools": {}}, "serverInfo": {"name": "cairnmill", "version": "1"}}}
        if method == "tools/list":
            return reply | {"result": {"tools": [{"name": n, "description": d, "inputSchema": {"type": "object", "properties": p, "required": r}} for n, (d, p, r) in TOOLS.items()]}}
        if method == "tools/call":
            got = call(project, str(given.get("name")), given.get("arguments") or {})
            return reply | {"result": {"content": [{"type": "text", "text": json.dumps(got, ensure_ascii=False)}], "isError": False}}
        if number is None:
            return None
        return reply | {"error": {"code": -32601, "message": f"unknown method: {method}"}}
    except NotFound as e:
        return reply | {"result": {"content": [{"type": "text", "text": str(e)}], "isError": True}}
    except (BadRequest, ValueError) as e:
        return reply | {"error": {"code": -32602, "message": str(e)}}


def serve(project: Project, lines: IO[str], out: IO[str]) -> None:
    for line in lines:
        if line.strip() and (got := answer(project, line)) is not None:
            out.write(json.dumps(got, ensure_ascii=False) + "\n")
            out.flush()
