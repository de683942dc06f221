"""JSON texts of any depth: parsing and writing in canonical form, for use inside tasks."""

from __future__ import annotations

import json
import re

_BLANK = re.compile(r"[ \t\n\r]*")
_scalar = json.JSONDecoder().scan_once


def parsed(text: str | None):
    """The value of a JSON text; None for null, empty and unreadable ones."""
    if not text:
        return None
    try:
        return json.loads(text)
    except ValueError:
        return None
    except RecursionError:
        try:
            return _deep(text)
        except (ValueError, StopIteration):
            return None


def _deep(text: str):
    """``json.loads`` with a stack of its own instead of the interpreter's."""
    root: list = []
    stack: list = [root]
    keys: list = [None]
    at, wants = 0, "value"
    while True:
        at = _BLANK.match(text, at).end()
        c = text[at : at + 1]
        if wants == "done":
            if c:
                raise ValueError("text after the value")
            return root[0]
        if wants in ("value", "first") and c and c not in "]}:,":
            if wants == "first" and isinstance(stack[-1], dict):
                wants = "key"
                continue
            if c in "[{":
                value, at = ([] if c == "[" else {}), at + 1
            else:
                value, at = _scalar(text, at)
            if isinstance(stack[-1], dict):
                stack[-1][keys[-1]] = value
            else:
                stack[-1].append(value)
            if c in "[{":
                stack.append(value)
                keys.append(None)
                wants = "first"
            else:
                wants = "done" if len(stack) == 1 else "next"
        elif wants == "key" and c == '"':
            keys[-1], at = _scalar(text, at)
            at = _BLANK.match(text, at).end()
            if text[at : at + 1] != ":":
                raise ValueError("no colon")
            at, wants = at + 1, "value"
        elif wants in ("first", "next") and c and c == ("}" if isinstance(stack[-1], dict) else "]"):
            stack.pop()
            keys.pop()
            at, wants = at + 1, "done" if len(stack) == 1 else "next"
        elif wants == "next" and c == ",":
            at, wants = at + 1, "key" if isinstance(stack[-1], dict) else "value"
        else:
            raise ValueError("not JSON")


def canonical(value) -> str:
    """JSON with sorted keys and no blanks, for values of any depth."""
    try:
        return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    except RecursionError:
        pass
    out: list[str] = []
    stack: list = [value]
    while stack:
        x = stack.pop()
        if isinstance(x, tuple):
            out.append(x[0])
        elif isinstance(x, dict):
            items: list = [("{",)]
            for i, k in enumerate(sorted(x)):
                items += [(("," if i else "") + json.dumps(k, ensure_ascii=False) + ":",), x[k]]
            stack.extend(reversed([*items, ("}",)]))
        elif isinstance(x, list):
            items = [("[",)]
            for i, v in enumerate(x):
                items += [(",",), v] if i else [v]
            stack.extend(reversed([*items, ("]",)]))
        else:
            out.append(json.dumps(x, ensure_ascii=False))
    return "".join(out)
