"""JSON text of any depth, in Python workers.

The standard parser and writer recurse in C and give up at a depth that depends on the machine. Where they do, the
same work is done here with an explicit stack, so a document is never unreadable for being nested deep.
"""

from __future__ import annotations

import json
import re
from json.decoder import scanstring
from typing import Any

_SPACE = re.compile(r"[ \t\n\r]*")
_SCALAR = re.compile(r"(-?(?:0|[1-9]\d*))((?:\.\d+)?(?:[eE][-+]?\d+)?)|true|false|null|NaN|-?Infinity")
_WORDS = {"true": True, "false": False, "null": None, "NaN": float("nan"), "Infinity": float("inf"), "-Infinity": float("-inf")}


def _integer(digits: str) -> int | float:
    """An integer; beyond what Python converts from text (thousands of digits) the nearest float."""
    try:
        return int(digits)
    except ValueError:
        return float(digits)


def _stacked(text: str) -> Any:
    root: list = []
    stack: list[Any] = [root]
    names: list[str] = [""]
    at = 0

    def name(at: int) -> int:
        """Read the name of the next member of the innermost object; the place of its value."""
        at = _SPACE.match(text, at).end()
        if text[at : at + 1] != '"':
            raise ValueError("a member without a name")
        names[-1], at = scanstring(text, at + 1, True)
        at = _SPACE.match(text, at).end()
        if text[at : at + 1] != ":":
            raise ValueError("a member without a value")
        return at + 1

    while True:
        at = _SPACE.match(text, at).end()
        first, opened = text[at : at + 1], False
        if first in ("{", "["):
            value: Any = {} if first == "{" else []
            at = _SPACE.match(text, at + 1).end()
            opened = text[at : at + 1] != ("}" if first == "{" else "]")
            at += not opened
        elif first == '"':
            value, at = scanstring(text, at + 1, True)
        else:
            m = _SCALAR.match(text, at)
            if not m:
                raise ValueError(f"no value at {at}")
            value = _WORDS[m[0]] if m[1] is None else float(m[0]) if m[2] else _integer(m[0])
            at = m.end()
        if isinstance(stack[-1], dict):
            stack[-1][names[-1]] = value
        else:
            stack[-1].append(value)
        if opened:
            stack.append(value)
            names.append("")
            if isinstance(value, dict):
                at = name(at)
            continue
        while len(stack) > 1:
            at = _SPACE.match(text, at).end()
            after = text[at : at + 1]
            if after == ",":
                at = name(at + 1) if isinstance(stack[-1], dict) else at + 1
                break
            if after != ("}" if isinstance(stack[-1], dict) else "]"):
                raise ValueError(f"an open container at {at}")
            stack.pop()
            names.pop()
            at += 1
        else:
            if _SPACE.match(text, at).end() != len(text):
                raise ValueError(f"more text at {at}")
            return root[0]


def loads(text: str) -> Any:
    """The value of a JSON text; ValueError if it is none. Neither depth nor the length of a number makes it unreadable."""
    try:
        return json.loads(text)
    except json.JSONDecodeError:
        raise
    except (RecursionError, ValueError):
        return _stacked(text)


def dumps(value: Any, sort_keys: bool = False, ensure_ascii: bool = True, tight: bool = False) -> str:
    """The JSON text of a value of any depth; tight leaves out the blanks after ',' and ':'."""
    comma, colon = (",", ":") if tight else (", ", ": ")
    encoder = json.JSONEncoder(sort_keys=sort_keys, ensure_ascii=ensure_ascii, separators=(comma, colon))
    try:
        return encoder.encode(value)
    except RecursionError:
        pass
    out: list[str] = []
    work: list[tuple[bool, Any]] = [(False, value)]
    while work:
        ready, x = work.pop()
        if ready:
            out.append(x)
        elif isinstance(x, dict):
            members = sorted(x.items()) if sort_keys else list(x.items())
            work.append((True, "}"))
            for n, (k, v) in reversed(list(enumerate(members))):
                work += [(False, v), (True, (comma if n else "") + encoder.encode(k) + colon)]
            work.append((True, "{"))
        elif isinstance(x, list):
            work.append((True, "]"))
            for n, v in reversed(list(enumerate(x))):
                work += [(False, v), (True, comma if n else "")]
            work.append((True, "["))
        else:
            out.append(encoder.encode(x))
    return "".join(out)


_HEX = re.compile(r'"(?:[^"\\]|\\.)*"|\b0[xX]([0-9a-fA-F]+)\b')
_FENCE = re.compile(r"^```[A-Za-z]*\s*|\s*```$")


def repaired(text: str | None) -> tuple[dict | None, str]:
    """The object of a text and how it was had: STRICT, or REPAIRED by leaving out fences and what stands around the outermost braces, and
    by reading bare hex literals as numbers; (None, reason) if there is none: NO_TEXT, NOT_AN_OBJECT, UNREADABLE.
    """
    given = (text or "").strip()
    if not given:
        return None, "NO_TEXT"
    try:
        strict = loads(given)
        return (strict, "STRICT") if isinstance(strict, dict) else (None, "NOT_AN_OBJECT")
    except ValueError:
        pass
    inner = _FENCE.sub("", given)
    inner = inner[inner.find("{") : inner.rfind("}") + 1]
    inner = _HEX.sub(lambda m: str(int(m[1], 16)) if m[1] else m[0], inner)
    try:
        value = loads(inner) if inner else None
    except ValueError:
        value = None
    return (value, "REPAIRED") if isinstance(value, dict) else (None, "UNREADABLE")


def strings(value: Any) -> list[str]:
    """All strings of a value, in order, at any depth; the names of members are none."""
    found: list[str] = []
    work = [value]
    while work:
        x = work.pop()
        if isinstance(x, str):
            found.append(x)
        elif isinstance(x, dict):
            work += reversed(x.values())
        elif isinstance(x, list):
            work += reversed(x)
    return found
