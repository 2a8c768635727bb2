"""JSON-RPC over lines: one request a line, one answer a line; notifications get none."""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

from codequarry.operators.search import QuerySyntaxError
from codequarry.operators.store import Store
from codequarry.plans import api

# Error codes, and the longest line that is read.
PARSE, METHOD, PARAMS, INTERNAL, NOT_READY, RESOURCE, SYNTAX = -32700, -32601, -32602, -32603, -32001, -32002, -32004
MAX_LINE = 16 << 20

RESOURCES = {"index://summary": api.get_summary, "index://architecture": api.get_architecture}
SCHEMAS = {
    "get_definition": {"symbol": "string"},
    "query_codebase": {"query": "string", "limit": "integer", "scope": "string", "file_filter": "string"},
    "get_call_chain": {"name": "string", "direction": "string", "depth": "integer", "min_confidence": "string", "max_results": "integer"},
    "get_impact": {"files": "array", "from_git": "string", "root": "string", "depth": "integer", "direction": "string", "include_tests": "boolean", "min_confidence": "string"},
    "get_architecture": {"focus": "string"},
}
RENAMED = {"query_codebase": {"max_results": "limit"}, "get_call_chain": {"function_name": "name"}}


class RpcError(Exception):
    def __init__(self, code: int, message: str):
        super().__init__(message)
        self.code = code


def handle(store: Store, method: str, params: dict, session: api.Session) -> object:
    if method == "initialize":
        return {"protocolVersion": params.get("protocolVersion", "2024-11-05"), "capabilities": {"tools": {}, "resources": {}}, "serverInfo": {"name": "codequarry"}}
    if method == "ping":
        return {}
    if method == "tools/list":
        return {"tools": [{"name": n, "inputSchema": {"type": "object", "properties": {k: {"type": t} for k, t in p.items()}}} for n, p in SCHEMAS.items()]}
    if method == "resources/list":
        return {"resources": [{"uri": u, "mimeType": "text/markdown"} for u in RESOURCES]}
    if method == "resources/read":
        if params.get("uri") not in RESOURCES:
            raise RpcError(RESOURCE, f"no such resource: {params.get('uri')}")
        return {"contents": [{"uri": params["uri"], "mimeType": "text/markdown", "text": RESOURCES[params["uri"]](store)}]}
    if method != "tools/call":
        raise RpcError(METHOD, f"no such method: {method}")
    name = params.get("name")
    if name not in SCHEMAS:
        raise RpcError(METHOD, f"no such tool: {name}")
    if store.is_empty():
        raise RpcError(NOT_READY, "the index is empty")
    args = {RENAMED.get(name, {}).get(k, k): v for k, v in (params.get("arguments") or {}).items()}
    try:
        result = api.query_codebase(store, session=session, **args) if name == "query_codebase" else api.call_tool(store, name, args)
    except QuerySyntaxError as e:
        raise RpcError(SYNTAX, str(e)) from e
    except TypeError as e:
        raise RpcError(PARAMS, str(e)) from e
    except ValueError as e:
        return {"content": [{"type": "text", "text": str(e)}], "isError": True}
    return {"content": [{"type": "text", "text": result if isinstance(result, str) else json.dumps(result, default=str)}]}


def serve(store: Store, lines: Iterable[str]) -> Iterator[str]:
    session = api.Session()
    for line in lines:
        if not line.strip():
            continue
        request: dict = {}
        try:
            if len(line) > MAX_LINE:
                raise RpcError(PARSE, "the line is too long")
            try:
                request = json.loads(line)
            except ValueError as e:
                raise RpcError(PARSE, str(e)) from e
            if not isinstance(request, dict) or not isinstance(request.get("method"), str):
                request = request if isinstance(request, dict) else {}
                raise RpcError(PARAMS, "no method")
            if "id" not in request:
                continue
            answer = {"result": handle(store, request["method"], request.get("params") or {}, session)}
        except RpcError as e:
            answer = {"error": {"code": e.code, "message": str(e)}}
        except Exception as e:  # the loop outlives a failed request
            answer = {"error": {"code": INTERNAL, "message": f"{type(e).__name__}: {e}"[:500]}}
        yield json.dumps({"jsonrpc": "2.0", "id": request.get("id")} | answer)
