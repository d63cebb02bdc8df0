"""JSON path access and edits on text: ``$``, ``.key`` and ``[i]``; a negative i counts from the end."""

from __future__ import annotations

import json
import re

MISSING = object()
STEP = re.compile(r'\.(?:"([^"]*)"|([^.\[]+))|\[(-?[0-9]+)\]')


def steps(path: str | None) -> list[str | int] | None:
    """The steps of a path, or None if it isn't one."""
    if not path or path[0] != "$":
        return None
    out, at = [], 1
    while at < len(path):
        m = STEP.match(path, at)
        if not m:
            return None
        out.append(int(m[3]) if m[3] is not None else m[1] if m[1] is not None else m[2])
        at = m.end()
    return out


def load(text: str | None):
    if text is None:
        return MISSING
    try:
        return json.loads(text)
    except ValueError:
        return MISSING


def follow(value, path: list[str | int]):
    for step in path:
        if isinstance(step, str) and isinstance(value, dict) and step in value:
            value = value[step]
        elif isinstance(step, int) and isinstance(value, list) and -len(value) <= step < len(value):
            value = value[step]
        else:
            return MISSING
    return value


def dump(value) -> str:
    return json.dumps(value, ensure_ascii=False, separators=(",", ":"))


def extract(text: str | None, path: str | None) -> str | None:
    at = steps(path)
    value = MISSING if at is None else load(text)
    value = value if value is MISSING else follow(value, at)
    if value is MISSING or value is None:
        return None
    if isinstance(value, bool):
        return str(int(value))
    return value if isinstance(value, str) else dump(value)


def kind(text: str | None, path: str | None = "$") -> str | None:
    at = steps(path)
    value = MISSING if at is None else load(text)
    value = value if value is MISSING else follow(value, at)
    if value is MISSING:
        return None
    if value is None:
        return "null"
    if isinstance(value, bool):
        return str(value).lower()
    return {int: "integer", float: "real", str: "text", list: "array", dict: "object"}[type(value)]


def change(root, path: list[str | int], how: str, new):
    """``root`` after one edit. set and insert may add a key or append at the length; insert shifts array items."""
    if not path:
        return new if how in ("set", "replace") else root
    parent = follow(root, path[:-1])
    last = path[-1]
    if isinstance(parent, dict) and isinstance(last, str):
        there = last in parent
        if how == "remove":
            parent.pop(last, None)
        elif how == "set" or there == (how == "replace"):
            parent[last] = new
    elif isinstance(parent, list) and isinstance(last, int):
        at = last + len(parent) if last < 0 else last
        inside = 0 <= at < len(parent)
        if how == "remove" and inside:
            del parent[at]
        elif how in ("set", "replace") and inside:
            parent[at] = new
        elif how == "insert" and inside:
            parent.insert(at, new)
        elif how in ("set", "insert") and at == len(parent):
            parent.append(new)
    return root


def edit(how: str, text: str | None, changes: list[str | None] | None) -> str | None:
    """``text`` after the edits: paths for remove, else paths and JSON values in turn."""
    root = load(text)
    if root is MISSING or changes is None:
        return None
    pairs = [(p, None) for p in changes] if how == "remove" else list(zip(changes[::2], changes[1::2], strict=True))
    for path, value in pairs:
        at = steps(path)
        if at is None:
            return None
        root = change(root, at, how, None if value is None else json.loads(value))
    return dump(root)
