"""What hook payloads and tool calls hold: sessions, paths, resources."""

from __future__ import annotations

import json
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Keys of sessions (in order), paths and resources (fixed values).
SESSION_KEYS = ["session_id", "sessionId", "conversation_id", "conversationId", "transcript_path", "transcriptPath"]
PATH_KEYS = {"path", "file", "files", "filepath", "file_path", "targetfile", "target_file", "absolutepath"}
RESOURCE_KEYS = {
    "url": "url", "uri": "url", "endpoint": "url", "database": "database", "database_name": "database", "db": "database", "table": "table", "table_name": "table", "schema": "schema", "schema_name": "schema",
    "environment": "environment", "env": "environment", "server": "server", "server_name": "server", "host": "host", "hostname": "host", "project": "project", "project_id": "project",
}
OUTSIDE = "outside:"
#: Characters of a resource at most (fixed value).
MAX_ITEM = 500
_PATCH = re.compile(r"(?m)^\*\*\* (?:Add|Update|Delete) File: (.+)$")


def parse(text: str | None):
    try:
        return json.loads(text or "")
    except ValueError:
        return None


def fnv1a(data: bytes) -> int:
    h = 0xCBF29CE484222325
    for b in data:
        h = (h ^ b) * 0x100000001B3 & 0xFFFFFFFFFFFFFFFF
    return h


def session_of(payload) -> str:
    """The first session key's value: kept if it is a safe id, else a hash of it; without any, ``default``."""
    value = next((str(payload[k]) for k in SESSION_KEYS if isinstance(payload, dict) and isinstance(payload.get(k), str) and payload[k].strip()), None)
    if value is None:
        return "default"
    return value if re.fullmatch(r"[A-Za-z0-9._-]{1,128}", value) else f"session-{fnv1a(value.encode()):016x}"


def scoped(path: str, root: str | None = None) -> str:
    """A path relative to the root with its dots resolved; one that leaves it is marked."""
    p = path.strip().replace("\\", "/")
    if root and (p == root.rstrip("/") or p.startswith(root.rstrip("/") + "/")):
        p = p[len(root.rstrip("/")) + 1 :]
    elif p.startswith("/") or re.match(r"[A-Za-z]:/", p):
        return OUTSIDE + p
    parts: list[str] = []
    for x in p.split("/"):
        if x == "..":
            if not parts:
                return OUTSIDE + p
            parts.pop()
        elif x not in ("", "."):
            parts.append(x)
    return "/".join(parts) or "."


def _walk(value):
    stack = [(None, value)]
    while stack:
        key, v = stack.pop()
        yield key, v
        if isinstance(v, dict):
            stack += list(v.items())
        elif isinstance(v, list):
            stack += [(key, x) for x in v]


def first_of(payload, *ways: str):
    """The value at the first JSON pointer that leads somewhere."""
    for way in ways:
        v = payload
        for key in way.strip("/").split("/"):
            v = v.get(key) if isinstance(v, dict) else None
        if v is not None:
            return v
    return None


def tool_input(payload):
    return first_of(payload, "/tool_input", "/toolCall/args")


def tool_paths(payload, root: str | None = None) -> list[str]:
    """Paths anywhere in the tool's input, under path keys or as file headers of its patch command; sorted, distinct."""
    given, out = tool_input(payload), set()
    for key, v in _walk(given):
        if isinstance(v, str) and key is not None and key.lower() in PATH_KEYS and v.strip():
            out.add(scoped(v, root))
    if isinstance(given, dict) and isinstance(given.get("command"), str):
        out |= {scoped(m, root) for m in _PATCH.findall(given["command"])}
    return sorted(out)


def resource(text: str) -> str | None:
    """``kind:value`` in order: kinds of letters, digits, ``-`` and ``_``, lowered; null for what is blank, too long or holds control characters."""
    text = text.strip()
    kind, colon, value = text.partition(":")
    kind, value = kind.strip().lower(), value.strip().rstrip("/")
    ok = colon and value and re.fullmatch("[a-z0-9_-]+", kind) and len(text) <= MAX_ITEM and not any(unicodedata.category(c) == "Cc" for c in text)
    return f"{kind}:{value}" if ok else None


def tool_resources(payload) -> list[str]:
    """``kind:value`` of resource keys, and the tool itself; sorted, distinct."""
    out = set()
    for key, v in _walk(tool_input(payload)):
        kind = RESOURCE_KEYS.get(key.lower()) if isinstance(key, str) else None
        if kind and isinstance(v, str):
            out.add(resource(f"{kind}:{v}"))
    name = first_of(payload, "/tool_name", "/toolName", "/toolCall/name")
    if isinstance(name, str):
        out.add(resource(f"mcp:{name[5:].replace('__', '/')}" if name.startswith("mcp__") else f"tool:{name}"))
    return sorted(out - {None})


def facts(payload: Column, root: str | None = None) -> Column:
    """struct(session, paths, resources) of JSON payloads; malformed ones have none."""

    @F.pandas_udf("session string, paths array<string>, resources array<string>")
    def run(s: pd.Series) -> pd.DataFrame:
        got = [parse(x) for x in s]
        return pd.DataFrame({"session": [session_of(g) for g in got], "paths": [tool_paths(g, root) for g in got], "resources": [tool_resources(g) for g in got]})

    return run(payload)
