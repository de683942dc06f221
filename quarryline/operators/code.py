"""Python sources to tables: symbols, imports, calls, bases, decorators and comment coverage, one pass over the files."""

from __future__ import annotations

import ast
import io
import tokenize
import warnings
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_FACTS = "file_id long, fact string, name string, qualified string, line int, end_line int, owner string, detail string, number double"


def _facts(file_id: int, text: str | None) -> list[tuple]:
    """(fact, name, ...) rows of one file: symbols, imports, calls, bases, coverage, or the error that it doesn't parse."""
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            tree = ast.parse(text or "")
    except (SyntaxError, ValueError, RecursionError, MemoryError) as error:
        return [(file_id, "error", type(error).__name__, "", getattr(error, "lineno", None) or 0, 0, "", str(error), None)]
    rows: list[tuple] = []
    scopes: list[tuple[ast.AST, tuple[str, ...], bool, bool]] = [(tree, (), False, False)]
    while scopes:
        node, path, in_class, in_function = scopes.pop()
        owner = ".".join(path)
        for child in ast.iter_child_nodes(node):
            inner = (child, path, in_class and not isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)), in_function)
            if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                qualified = (*path, child.name)
                is_class = isinstance(child, ast.ClassDef)
                direct = isinstance(node, ast.ClassDef)
                kind = "class" if is_class else "method" if direct else "function"
                rows.append((file_id, kind, child.name, ".".join(qualified), child.lineno, child.end_lineno or child.lineno, owner, ast.get_docstring(child), float(len(child.decorator_list))))
                if is_class:
                    rows.extend((file_id, "base", _dotted(b), ".".join(qualified), child.lineno, 0, owner, None, None) for b in child.bases if _dotted(b))
                inner = (child, qualified, is_class, in_function or not is_class)
            elif isinstance(child, ast.Import):
                rows.extend((file_id, "import", a.name, "", child.lineno, 0, owner, a.asname, 0.0) for a in child.names)
            elif isinstance(child, ast.ImportFrom):
                rows.extend((file_id, "import", child.module or "", a.name, child.lineno, 0, owner, a.asname, float(child.level)) for a in child.names)
            elif isinstance(child, ast.Call) and in_function and _dotted(child.func):
                rows.append((file_id, "call", _dotted(child.func).rsplit(".", 1)[-1], owner, child.lineno, 0, owner, _dotted(child.func), None))
            scopes.append(inner)
    lines = len((text or "").splitlines())
    try:
        comments = sum(t.type == tokenize.COMMENT for t in tokenize.generate_tokens(io.StringIO(text or "").readline))
    except (tokenize.TokenError, SyntaxError):
        comments = 0
    rows.append((file_id, "file", "", "", 1, lines, "", ast.get_docstring(tree), comments / lines if lines else 0.0))
    return rows


def _dotted(node: ast.AST) -> str:
    parts = []
    while isinstance(node, ast.Attribute):
        parts.append(node.attr)
        node = node.value
    return ".".join([node.id, *reversed(parts)]) if isinstance(node, ast.Name) else parts[0] if parts else ""


def parsed(files: DataFrame) -> DataFrame:
    """One row per fact of each file (``file_id``, ``content``). A file that doesn't parse gives one ``error`` row and never
    stops the job; null contents are empty files; lines count from 1 here."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [r for i, text in zip(batch.file_id, batch.content) for r in _facts(i, text)]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in _FACTS.split(", ")])

    return files.select("file_id", "content").mapInPandas(parse, _FACTS)


def call_graph(facts: DataFrame, files: DataFrame, scope: str) -> DataFrame:
    """Caller to callee where the callee's name is the only one of its kind in the ``scope`` (say, the repository)."""
    f = files.select("file_id", scope)
    named = facts.where(F.col("fact").isin("function", "method")).join(f, "file_id").groupBy(scope, "name").agg(F.count("*").alias("n"), F.max(F.struct("file_id", "qualified")).alias("to")).where("n = 1")
    calls = facts.where("fact = 'call'").join(f, "file_id").join(named, [scope, "name"])
    return calls.select(scope, F.col("file_id").alias("src_file"), F.col("owner").alias("src"), F.col("to.file_id").alias("dst_file"), F.col("to.qualified").alias("dst"), "line")


def inheritance(facts: DataFrame, files: DataFrame, scope: str) -> DataFrame:
    """Class to base where the base's name is unique in the scope; ``object`` and a class's own name are left out."""
    f = files.select("file_id", scope)
    named = facts.where("fact = 'class'").join(f, "file_id").groupBy(scope, "name").agg(F.count("*").alias("n"), F.max(F.struct("file_id", "qualified")).alias("to")).where("n = 1")
    bases = facts.where("fact = 'base' and name <> 'object'").join(f, "file_id").withColumn("name", F.element_at(F.split("name", "[.]"), -1))
    edges = bases.join(named, [scope, "name"]).where(F.col("qualified") != F.col("to.qualified"))
    return edges.select(scope, F.col("file_id").alias("src_file"), F.col("qualified").alias("src"), F.col("to.file_id").alias("dst_file"), F.col("to.qualified").alias("dst"))


def edit_similarity(a: str | None, b: str | None) -> float | None:
    """1 less the token-level edit distance over the longer length; 1 for two empty texts, null if either is null."""
    if a is None or b is None:
        return None
    x, y = a.split(), b.split()
    if not x and not y:
        return 1.0
    last = list(range(len(y) + 1))
    for i, s in enumerate(x, 1):
        row = [i]
        for j, t in enumerate(y, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (s != t)))
        last = row
    return 1.0 - last[-1] / max(len(x), len(y))
