"""The tools over JSON-RPC 2.0, a message a line."""

from __future__ import annotations

import json
from typing import TextIO

from sparkseek.services.tools import ToolError, Tools, definitions

PROTOCOL = "2024-11-05"


#: The protocol's code for an unknown method, and what this server says of itself.
UNKNOWN_METHOD = -32601
SERVER = {"name": "sparkseek", "version": "0.1"}


def _call(tools: Tools, params: dict) -> dict:
    """A tool's text. What a tool refuses is told to the agent as text too, marked as an error."""
    try:
        said, refused = tools.call(params.get("name", ""), params.get("arguments")), False
    except ToolError as e:
        said, refused = str(e), True
    return {"content": [{"type": "text", "text": said}], "isError": refused}


METHODS = {
    "tools/list": lambda tools, params: {"tools": definitions()},
    "tools/call": _call,
    "initialize": lambda tools, params: {"protocolVersion": params.get("protocolVersion", PROTOCOL), "capabilities": {"tools": {}}, "serverInfo": SERVER},
    "ping": lambda tools, params: {},
}


def handle(tools: Tools, message: dict) -> dict | None:
    """The response, or None where none is due: a message without an id or a method."""
    method = message.get("method")
    if "id" not in message or not isinstance(method, str):
        return None
    if run := METHODS.get(method):
        outcome = {"result": run(tools, message.get("params") or {})}
    else:
        outcome = {"error": {"code": UNKNOWN_METHOD, "message": f"this server has no method {method}"}}
    return {"jsonrpc": "2.0", "id": message["id"], **outcome}


def serve(tools: Tools, lines: TextIO, out: TextIO) -> None:
    for line in lines:
        try:
            message = json.loads(line)
        except ValueError:
            continue
        if isinstance(message, dict) and (response := handle(tools, message)) is not None:
            out.write(json.dumps(response) + "\n")
            out.flush()
