"""Nested JSON records to flat, related tables: every object gets a content identity, is stored once, and each place where
it occurs is a bridge row that links it to its parent object and its record.

The identities are Merkle hashes: an object's hash covers its own scalar fields and the hashes of its children, so equal
subtrees share one identity wherever they stand, whatever the order of their keys.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarryline.functions.jsontext import canonical, parsed
from quarryline.session import first_delivery

SECTIONS = ("primary_candidates", "secondary_candidates", "regression_tests")
_OCCURRENCES = (
    "section string, node_path string, parent_path string, ordinal int, depth int, object_id string, parent_id string, "
    "file_path string, body string"
)


def _unwrap(value):
    """The objects that a section holds, in order: lists, one object, objects keyed by position, or any of it as JSON text."""
    while isinstance(value, str):  # each round is shorter, as JSON text has quotes around it
        value = parsed(value)
    if isinstance(value, dict):
        if value and all(k.isdigit() for k in value):
            value = [value[k] for k in sorted(value, key=int)]
        else:
            return [value]
    if not isinstance(value, list):
        return []
    found = []
    for item in value:
        if isinstance(item, dict):
            found.append(item)
        elif isinstance(item, (list, str)):
            found.extend(_unwrap(item))
    return found


def _sections(root: dict, names: tuple[str, ...]) -> Iterator[tuple[str, object]]:
    """Sections wherever they stand outside of other sections; an explicit stack, as nesting may be deep."""
    stack: list[object] = [root]
    while stack:
        at = stack.pop()
        if isinstance(at, dict):
            for key, value in at.items():
                if key in names:
                    yield key, value
                elif isinstance(value, (dict, list)):
                    stack.append(value)
        elif isinstance(at, list):
            stack.extend(v for v in at if isinstance(v, (dict, list)))


def _occurrences(payload: str | None, names: tuple[str, ...], children: str) -> list[tuple]:
    root = parsed(payload)
    if not isinstance(root, dict):
        return []
    rows: list[list] = []
    counts: dict[str, int] = {}
    for section, value in _sections(root, names):
        for item in _unwrap(value):
            n = counts[section] = counts.get(section, -1) + 1
            stack = [(item, f"{section}[{n}]", -1, n, 0)]
            while stack:  # parents come before their children
                node, path, parent, ordinal, depth = stack.pop()
                at = len(rows)
                rows.append([section, path, parent, ordinal, depth, node])
                below = _unwrap(node.get(children))
                stack.extend((x, f"{path}.{children}[{i}]", at, i, depth + 1) for i, x in enumerate(below))
    kids: list[list[str]] = [[] for _ in rows]
    ids: list[str] = [""] * len(rows)
    bodies: list[str] = [""] * len(rows)
    for at in range(len(rows) - 1, -1, -1):  # bottom up: children are hashed before their parent
        _, _, parent, _, _, node = rows[at]
        own = {k: v for k, v in node.items() if k != children}
        bodies[at] = canonical(own)
        below = "|".join(reversed(kids[at]))
        ids[at] = hashlib.sha256(f"{bodies[at]}\x1f{below}".encode("utf-8", "surrogatepass")).hexdigest()[:32]
        if parent >= 0:
            kids[parent].append(ids[at])
    made = []
    for at, (section, path, parent, ordinal, depth, node) in enumerate(rows):
        file_path = node.get("file_path")
        made.append((
            section, path, rows[parent][1] if parent >= 0 else "", ordinal, depth, ids[at], ids[parent] if parent >= 0 else "",
            "" if file_path is None else file_path if isinstance(file_path, str) else canonical(file_path), bodies[at],
        ))
    return made


def occurrences(df: DataFrame, key: str, payload: str, sections: tuple[str, ...] = SECTIONS, children: str = "alternatives", order: tuple[str, ...] = ()) -> DataFrame:
    """The bridge table with bodies: one row per object and place, keyed by ``key`` and ``node_path``.

    A null, unreadable or non-object payload has no rows; null entries of a list are no objects and take no number; a
    missing or null ``file_path`` becomes the empty string. Of a key delivered twice the first delivery by the columns
    ``order`` counts, ties going to the lesser payload. Nesting may be of any depth. Other columns of ``df`` don't matter.
    """
    schema = f"{key} {df.schema[key].dataType.simpleString()}, {_OCCURRENCES}"
    names = [c.split()[0] for c in schema.split(", ")]

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(k, *row) for k, text in zip(batch[key], batch[payload]) for row in _occurrences(text, sections, children)]
            yield pd.DataFrame(rows, columns=names)

    return _once(df, key, payload, order).mapInPandas(parse, schema)


def _once(df: DataFrame, key: str, payload: str, order: tuple[str, ...]) -> DataFrame:
    return first_delivery(df.select(key, payload, *order), key, list(order)).select(key, payload)


def fields(df: DataFrame, key: str, payload: str, sections: tuple[str, ...] = SECTIONS, order: tuple[str, ...] = ()) -> DataFrame:
    """The records' own fields outside of the sections: ``key, path, value``, one row per value that isn't an object or a list,
    its path with dots and positions, the value as JSON. Nulls keep their row; payloads that aren't objects have none."""
    schema = f"{key} {df.schema[key].dataType.simpleString()}, path string, value string"

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for k, text in zip(batch[key], batch[payload]):
                root = parsed(text)
                stack = [("", root)] if isinstance(root, dict) else []
                while stack:
                    path, at = stack.pop()
                    if isinstance(at, dict):
                        stack.extend((f"{path}.{name}" if path else name, x) for name, x in at.items() if name not in sections)
                    elif isinstance(at, list):
                        stack.extend((f"{path}[{i}]", x) for i, x in enumerate(at))
                    else:
                        rows.append((k, path, canonical(at)))
            yield pd.DataFrame(rows, columns=[key, "path", "value"])

    return _once(df, key, payload, order).mapInPandas(parse, schema)


def objects(bridge: DataFrame) -> DataFrame:
    """Every distinct object once: identity, own fields as canonical JSON, and how often it occurs. Partial aggregation
    keeps an object that occurs everywhere from gathering in one task."""
    return bridge.groupBy("object_id").agg(
        F.min("body").alias("body"), F.min("file_path").alias("file_path"), F.count("*").alias("occurrences")
    )
