"""Functions paired with their documentation (p6).

Each file is parsed and lexed once, in the task that holds it; its brackets, statement ends, comments and the names that could
be a function's become rows, with what stands right beside them. Running sums of brackets give every row its depth; windows
over the rows of one depth find the arguments, the end of the body, the enclosing class and the last statement before, so an
island between two ends is one function; the last comment before a name is its documentation if nothing stands between.
Comments and functions meet by a key at the end, so no window carries a comment's text from row to row.
"""

from __future__ import annotations

import ast
import bisect
import inspect
import io
import re
import tokenize

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarryline.llm import grammars
from quarryline.llm.sources import language_of
from quarryline.session import first_delivery

# kinds of rows: brackets, ends of statements, headers' colons, words that open a class, names, documenting strings, comments
OPEN, CLOSE, END, COLON, CLASS, NAME, STRING = "o", "c", "e", ":", "k", "n", "s"
DOC, NOTE, TRAILING = "d", "t", "x"
_FIELDS = ("k", "text", "beside", "line", "last", "head", "aliens", "marks")
_TOKENS = T.StructType([T.StructField(f, T.ArrayType(T.StringType() if f in ("k", "text", "beside") else T.IntegerType())) for f in _FIELDS])

# Words that may stand between a comment and the name it documents, and words that open a class.
_HEADER_WORDS = frozenset("export default async function const static get set public private protected readonly abstract override declare accessor".split())
_CLASS_WORDS = frozenset("class interface enum record".split())
# What looks like a call followed by a block, but opens a statement.
_STATEMENTS = frozenset("if for while switch catch with function return await typeof super do else try case throw".split())


def _python_tokens(text: str) -> list[tuple]:
    """Indents count as brackets. Strings next to each other are one; one that can be a docstring has a row with its value."""
    rows: list[list] = []
    strings: list[str] = []
    before, before2, first, word, head, decorated, code_line, colons = "end", "end", True, "", 0, False, 0, []

    def add(k: str, text: str, beside: str, line: int, last: int = -1) -> None:
        rows.append([k, text, beside, line, last, head, 0, 0])

    def flush(after: str) -> None:
        if strings:
            documents = (before == ":" or (before == "end" and before2 == ":")) and after in ("end", ";")
            if documents:
                try:
                    value = ast.literal_eval("(" + "\n".join(strings) + ")")
                except (ValueError, SyntaxError, MemoryError, RecursionError):
                    value = None
                if isinstance(value, str):
                    add(STRING, inspect.cleandoc(value), "", code_line)
            strings.clear()
            step("str")

    def step(now: str) -> None:
        nonlocal before, before2
        before, before2 = now, before

    for t in tokenize.generate_tokens(io.StringIO(text).readline):
        kind, line = t.type, t.start[0] - 1
        if kind in (tokenize.COMMENT, tokenize.NL, tokenize.ENCODING):
            continue
        if kind == tokenize.INDENT:
            add(OPEN, "{", word, line)
            continue
        if kind == tokenize.DEDENT:
            add(CLOSE, "}", "", code_line)
            continue
        if kind == tokenize.ENDMARKER:
            continue
        if kind == tokenize.STRING:
            strings.append(t.string)
            code_line = t.end[0] - 1
            continue
        now = "end" if kind == tokenize.NEWLINE else t.string if kind in (tokenize.NAME, tokenize.OP) else "other"
        flush(now)
        if kind == tokenize.NEWLINE:
            for c in colons:  # a body on the header's line ends with it
                rows[c][4] = -1 if before == ":" and c == colons[-1] else line
            colons.clear()
            decorated, first = first is False and word == "@", True
            step("end")
            continue
        if first:
            first, word = False, t.string
            if not decorated:
                head = line
        elif word == "async":
            word = t.string
        code_line = t.end[0] - 1
        if kind == tokenize.NAME and before == "def":
            add(NAME, t.string, "def", line)
        elif kind == tokenize.OP:
            if t.string in "([{":
                add(OPEN, t.string, before, line)
            elif t.string in ")]}":
                add(CLOSE, t.string, "", line)
            elif t.string == ":":
                colons.append(len(rows))
                add(COLON, ":", "", line)
        step(now)
    flush("end")
    return [tuple(r) for r in rows]


def _shape(language: str, at: int, kinds: list[str], words: list[str]) -> str:
    """What the tokens beside an identifier say: how it could name a function, else nothing."""
    word, before = words[at], words[at - 1] if at else ""
    after = words[at + 1] if kinds[at + 1] == "op" else ""
    if language == "go":
        return "func" if before == "func" and after in ("(", "[") else "method" if before == ")" and after in ("(", "[") and word not in grammars.RESERVED["go"] else ""
    if language in ("c", "java"):
        return "call" if after == "(" and word not in grammars.RESERVED[language] and before not in ("new", ".", "@") else ""
    if before == "function" or (before == "*" and at > 1 and words[at - 2] == "function"):
        return "function" if after in ("(", "<") else ""
    if before == "const":
        value = at + 1
        if after == ":":  # an annotation stands before the value
            deep = 0
            while kinds[value] != "eof" and not (deep == 0 and words[value] in ("=", ";")):
                deep += (words[value] in ("(", "[", "{", "<")) - (words[value] in (")", "]", "}", ">"))
                value += 1
        if words[value] != "=":
            return ""
        value += 2 if words[value + 1] == "async" else 1
        if words[value] == "function" or (kinds[value] == "id" and words[value + 1] == "=>"):
            return "bound"
        return ("bound(" if after == "=" else "") if words[value] in ("(", "<") else ""
    if after == "(" and before not in ("new", ".", "@", "=", "function"):
        return "word(" if word in _STATEMENTS else "call"
    return ""


def _brace_tokens(language: str, text: str) -> list[tuple]:
    notes: list[tuple[int, str, bool]] = []
    places: list[int] = []
    script = language in ("javascript", "typescript")
    skipped = text.split("\n", 1)[0] if script and text.startswith("#!") else ""
    kinds, words, _ = grammars._lex(language, text[len(skipped) :], notes, places)
    breaks = [m.start() for m in re.finditer(r"\r\n|\n|\r", text)]

    def lines(at: int) -> int:
        return bisect.bisect_left(breaks, at + len(skipped))

    rows, note, aliens, marks, head, fresh = [], 0, 0, 0, 0, True
    for at, (kind, word, place) in enumerate(zip(kinds, words, places)):
        while note < len(notes) and notes[note][0] < place:
            start, said, first = notes[note]
            k = DOC if said.startswith("/**") and not said.startswith("/**/") else NOTE
            rows.append((k if first or language != "go" else TRAILING, said, "", lines(start), lines(start + len(said) - 1), 0, aliens, marks))
            note += 1
        if kind == "eof":
            break
        line = -1
        if fresh and not (kind == "op" and word in (";", "}")):
            head, fresh = lines(place), False
        if kind == "op":
            bracket = {"${": "{", "}$": "}"}.get(word, word)
            if bracket in ("{", "(", "["):
                rows.append((OPEN, bracket, words[at - 1] if at else "", lines(place), -1, 0, 0, 0))
            elif bracket in ("}", ")", "]"):
                rows.append((CLOSE, bracket, words[at + 1], lines(place), -1, 0, 0, 0))
            elif word == ";":
                rows.append((END, ";", "", lines(place), -1, 0, 0, 0))
            elif word == "@":
                marks += 1
            fresh = fresh or bracket in ("{", ";", "}")
        elif kind == "id":
            if word in _CLASS_WORDS:
                rows.append((CLASS, "", "", -1, -1, 0, 0, 0))
            shape = _shape(language, at, kinds, words)
            if shape:
                line = lines(place)
                rows.append((NAME, word, shape, line, -1, head, aliens, marks))
            if script and word not in _HEADER_WORDS:
                aliens += 1
    for start, said, first in notes[note:]:
        rows.append((DOC if said.startswith("/**") else NOTE, said, "", lines(start), lines(start + len(said) - 1), 0, aliens, marks))
    return rows


def _tokens(language: str | None, text: str | None) -> list[tuple]:
    text = (text or "").removeprefix("﻿")
    if not language or not text.strip() or not grammars.valid(language, text):
        return []
    try:
        if language == "python":
            return _python_tokens(re.sub(r"\r\n|\r", "\n", text))
        return _brace_tokens(language, text)
    except (grammars.Bad, tokenize.TokenError, SyntaxError, IndentationError):
        return []


@F.pandas_udf(_TOKENS)
def _token_arrays(language: pd.Series, content: pd.Series) -> pd.DataFrame:
    out = []
    for a, b in zip(language, content):
        rows = _tokens(a, b)
        out.append([list(c) for c in zip(*rows)] if rows else [[] for _ in _FIELDS])
    return pd.DataFrame(out, columns=list(_FIELDS))


def token_rows(once: DataFrame) -> DataFrame:
    """``file_id, language, seq`` and the fields of a token, of the valid files in ``once`` (``file_id, path, content``, each
    file once). The rows stay where their file is, so the windows over them need no further shuffle."""
    arrays = once.select("file_id", language_of(F.col("path")).alias("language"), "content").where("language is not null")
    arrays = arrays.select("file_id", "language", _token_arrays("language", "content").alias("t"))
    zipped = F.arrays_zip(*[F.col(f"t.{f}").alias(f) for f in _FIELDS])
    return arrays.select("file_id", "language", F.posexplode(zipped).alias("seq", "x")).select("file_id", "language", "seq", *[f"x.{f}" for f in _FIELDS])


def definitions(rows: DataFrame) -> DataFrame:
    """``file_id, language, name, kind, start_line, head_line, end_line, documentation`` of the functions that have any
    documentation; lines count from 0, the head is the declaration's first line."""
    k, text = F.col("k"), F.col("text")
    comment = k.isin(DOC, NOTE, TRAILING)
    script = F.col("language").isin("javascript", "typescript")
    python, go = F.col("language") == "python", F.col("language") == "go"

    # depth: both brackets of a pair carry the depth outside of them, what is between them one more
    file = Window.partitionBy("file_id").orderBy("seq")
    upto = file.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    said = F.struct(F.col("seq").alias("seq"), k.alias("k"), F.col("last").alias("last"), F.col("aliens").alias("aliens"), F.col("marks").alias("marks"))
    rows = (
        rows.withColumn("after", F.sum(F.when(k == OPEN, 1).when(k == CLOSE, -1).otherwise(0)).over(upto))
        .withColumn("c", F.last(F.when(comment, said), ignorenulls=True).over(upto))
        .withColumn("colon", F.last(F.when(k == COLON, F.col("seq")), ignorenulls=True).over(upto))
        .withColumn("_k", F.lag("k").over(file)).withColumn("_last", F.lag("last").over(file))
    )
    # islands of comments: in Go, lines of comments that touch are one
    touches = go & (k != TRAILING) & F.col("_k").isin(DOC, NOTE) & (F.col("line") - F.col("_last") <= 1)
    rows = rows.withColumn("island", F.sum(F.when(comment & ~F.coalesce(touches, F.lit(False)), 1).otherwise(0)).over(upto)).drop("_k", "_last")
    rows = rows.withColumn("c", F.when(k == NAME, F.col("c"))).withColumn("depth", F.when(comment | (k == STRING), -1).when(k == OPEN, F.col("after") - 1).otherwise(F.col("after")))

    # the rows of one depth: a bracket's partner is its neighbour there
    level = Window.partitionBy("file_id", "depth").orderBy("seq")
    behind = level.rowsBetween(Window.unboundedPreceding, -1)
    rows = (
        rows.withColumn("ended", F.last(F.when((k == END) | ((k == CLOSE) & (text == "}")), F.col("seq")), ignorenulls=True).over(behind))
        .withColumn("classed", F.last(F.when(k == CLASS, F.col("seq")), ignorenulls=True).over(behind))
        .withColumn("follows", F.lead("beside", 2).over(level)).withColumn("receiver", F.lag("beside", 2).over(level))
    )
    # the same from the end: what closes, ends or heads a body next
    ahead = Window.partitionBy("file_id", "depth").orderBy(F.desc("seq")).rowsBetween(Window.unboundedPreceding, -1)
    body = F.when((k == CLOSE) & (text == "}") & ~F.col("beside").isin("{", "=>"), F.struct("seq", "line"))
    rows = (
        rows.withColumn("close", F.last(body, ignorenulls=True).over(ahead))
        .withColumn("stop", F.last(F.when(k == END, F.struct("seq", "line")), ignorenulls=True).over(ahead))
        .withColumn("header", F.last(F.when(k == COLON, F.struct("seq", "last")), ignorenulls=True).over(ahead))
    )
    rows = rows.where((k == OPEN) | (k == NAME) | comment | (k == STRING))
    # the bracket around a row is the last one that opened its depth
    inside = Window.partitionBy("file_id", F.when(comment | (k == STRING), -1).otherwise(F.col("after"))).orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    class_open = (text == "{") & F.when(python, F.col("beside") == "class").otherwise(F.col("classed") > F.coalesce("ended", F.lit(-1)))
    rows = rows.withColumn("parent", F.last(F.when(k == OPEN, F.struct(F.col("seq").alias("seq"), F.coalesce(class_open, F.lit(False)).alias("is_class"))), ignorenulls=True).over(inside)).where(k != OPEN)

    shape, member, block = F.col("beside"), F.coalesce("parent.is_class", F.lit(False)), F.col("follows") == "{"
    is_function = (
        F.when(python, F.lit(True))
        .when(go, (shape == "func") | (F.col("receiver") == "func"))
        .when(F.col("language") == "c", (F.col("depth") == 0) & block)
        .when(F.col("language") == "java", member & (block | (F.col("follows") == "throws")))
        .when(shape.isin("function", "bound"), F.lit(True))
        .when(shape == "bound(", F.col("follows").isin("=>", ":"))
        .when(shape == "word(", member & (block | (F.col("follows") == ":")))
        .otherwise(block | (member & (F.col("follows") == ":")))
    )
    is_bound = shape.isin("bound", "bound(")
    end_line = F.when(python, F.when(F.col("header.last") >= 0, F.col("header.last")).otherwise(F.col("close.line"))).when(
        is_bound & (F.coalesce("stop.seq", F.lit(1 << 30)) < F.coalesce("close.seq", F.lit(1 << 30))), F.col("stop.line")
    ).otherwise(F.col("close.line"))
    kind = F.when(member | (F.col("receiver") == "func"), "method").otherwise("function")

    near = (F.col("c.seq") > F.coalesce("ended", F.lit(-1))) & (F.col("c.seq") > F.coalesce("parent.seq", F.lit(-1)))
    own = (
        F.when(python, F.lit(True))
        .when(go, (F.col("c.last") == F.col("head") - 1) & (F.col("c.k") != TRAILING))
        .otherwise(near & (F.col("c.k") == DOC) & (~script | (F.col("aliens") == F.col("c.aliens")) | (F.col("marks") > F.col("c.marks"))))
    )
    key = F.when(python, -1 - F.when(k == NAME, F.col("header.seq")).otherwise(F.col("colon"))).otherwise(F.col("island"))
    words = F.when((k == STRING) | (comment & ~(go & text.startswith("//go:"))), F.struct("seq", "text"))
    named = F.struct(
        text.alias("name"), kind.alias("kind"), F.col("line").alias("start_line"), F.least("head", "line").alias("head_line"), F.greatest(F.coalesce(end_line, F.col("line")), F.col("line")).alias("end_line"),
    )
    rows = rows.where((k != NAME) | F.coalesce(is_function & own, F.lit(False)))
    met = rows.groupBy("file_id", "language", key.alias("key")).agg(F.collect_list(words).alias("said"), F.collect_list(F.when(k == NAME, named)).alias("functions")).where("size(said) > 0 and size(functions) > 0")
    documentation = F.array_join(F.transform(F.array_sort("said"), lambda x: x["text"]), "\n")
    return met.select("file_id", "language", documentation.alias("documentation"), F.explode("functions").alias("f")).select("file_id", "language", "f.name", "f.kind", "f.start_line", "f.head_line", "f.end_line", "documentation")


# What stands in place of documentation.
_PLACEHOLDERS = re.compile(
    r"(?:todo|fixme|tbd|tba|xxx|n/?a|none|wip|placeholder|docstring|documentation|description|comment|pending|stub|missing|undocumented|no doc(?:s|umentation|string)?)"
    r"|(?:todo|fixme|xxx|tbd|tba)\b.*"
    r"|(?:auto-?\s?generated)\b.*"
    r"|(?:add|insert|write|enter|put|fill in)(?: an?| the| your| some| proper)* (?:description|documentation|docs?|docstring|comment|text)s?(?: here| later| goes here)?"
    r"|(?:no|missing|empty|needs?|lacks|without)(?: an?| the)? (?:description|documentation|docs?|docstring|comment)s?(?: available| given| provided| yet)?"
    r"|(?:description|documentation|docs?|docstring|comment|text)s? (?:goes here|here|pending|missing|needed|to follow|to come|tbd)"
    r"|(?:to be (?:documented|written|done|added|completed))|(?:lorem ipsum)\b.*",
    re.I,
)
_POINTERS = re.compile(
    r"(?:@?inherit(?:ed|s|doc)?(?:\s+(?:from|docs?|documentation)\b.*)?|\{@inheritdoc\}|overrid(?:es?|den)(?: method| from \S+)?|same as (?:above|\S+)|as above|ditto"
    r"|(?:see|cf\.?|refer to|documented in|@see)\s+(?:also\s+)?(?:the\s+)?[\w.#:{}@/ ()\[\]-]{1,60})",
    re.I,
)
_TAG = re.compile(r"^\s*(?:[@:\\](?:param|arg|argument|parameter|type|rtype|returns?|throws|raises?|exception|template|tparam)\b)(?P<rest>.*)$", re.I)
_HEADING = re.compile(r"^\s*(?:args|arguments|parameters|params|returns?|yields?|raises|throws|keyword args)\s*:?\s*$", re.I)
_EMPTY_ENTRY = re.compile(r"^\s*[-*]?\s*`?\*{0,2}\w+`?\s*(?:\([^)]*\))?\s*:?\s*$")
_LITTLE = frozenset("a an and the this is of for it its function method procedure func def to does do will that which named called".split())


def _plain_comment(text: str) -> str:
    if text.startswith(("/*", "//")):
        text = re.sub(r"/\*+(.*?)\*/", lambda m: "\n".join(re.sub(r"^\s*\*+ ?", "", x) for x in re.split(r"\r\n|\n|\r", m.group(1))), text, flags=re.S)
        text = "\n".join(re.sub(r"^\s*//+", "", x) for x in re.split(r"\r\n|\n|\r", text))
    return text.strip()


def _stem(word: str) -> str:
    for end in ("ies", "ied"):
        if word.endswith(end) and len(word) > 4:
            return word[:-3] + "y"
    for end in ("ing", "ed", "es", "s", "e"):
        if word.endswith(end) and len(word) > len(end) + 2:
            word = word[: -len(end)]
            break
    return word[:-1] if len(word) > 3 and word[-1:] == word[-2:-1] else word


def trivial(documentation: str | None, name: str) -> bool:
    """Whether it says nothing beyond the name and signature, see TESTDATA.md."""
    text = _plain_comment(documentation or "")
    said: list[str] = []
    listing = False
    for line in re.split(r"\r\n|\n|\r", text):
        tag = _TAG.match(line)
        if tag:
            # a type in braces, the parameter's name and marks; what is left are words about it
            rest = re.sub(r"\{[^}]*\}", " ", tag.group("rest"))
            kind = re.match(r"\s*[@:\\](\w+)", line).group(1).lower()
            if kind.startswith(("return", "rtype")):
                words = rest.replace(":", " ").split()
                words = words if len(words) > 1 or kind.startswith("return") and words and line.lstrip().startswith("@") and not re.fullmatch(r"[\w.<>\[\]]+", words[0]) else []
            else:
                words = re.sub(r"[:\-]", " ", rest).split()[1:]
            if words:
                return False
            continue
        if _HEADING.match(line):
            listing = True
            continue
        if listing and (_EMPTY_ENTRY.match(line) or not line.strip()):
            continue
        said.append(line)
    left = re.sub(r"\s+", " ", " ".join(said)).strip()
    bare = left.strip(" .!?:;,-_*#/\"'`…–—()[]")
    if not re.search(r"\w", bare):
        return True
    if _PLACEHOLDERS.fullmatch(bare) or _POINTERS.fullmatch(bare) or _POINTERS.fullmatch(left.rstrip(".")):
        return True
    parts = {_stem(p.lower()) for p in name_parts(name)}
    words = [w for token in re.findall(r"[A-Za-z0-9_]+", left) for w in name_parts(token)]
    return all(w.lower() in _LITTLE or _stem(w.lower()) in parts for w in words) and bool(re.fullmatch(r"[\x00-\x7f]*", left))


def name_parts(name: str) -> list[str]:
    return [p for p in re.split(r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])|[^A-Za-z0-9]+", name) if p]


@F.pandas_udf(T.BooleanType())
def _trivial(documentation: pd.Series, name: pd.Series) -> pd.Series:
    return pd.Series([trivial(a, b) for a, b in zip(documentation, name)], dtype=bool)


@F.pandas_udf(T.StringType())
def _described(documentation: pd.Series) -> pd.Series:
    return documentation.map(_plain_comment)


def _once(files: DataFrame) -> DataFrame:
    return first_delivery(files.select("file_id", "parsed_at", "path", "content"), "file_id", ["parsed_at"])


def documented(files: DataFrame) -> DataFrame:
    """``file_id, language, name, kind, start_line, head_line, end_line, documentation`` of the functions whose documentation
    says something.

    Files that don't parse, of unknown extension, empty or null give no rows; two functions of one name on one line are
    one row. Lines count from 0.
    """
    rows = definitions(token_rows(_once(files)))
    kept = rows.where(~_trivial("documentation", "name")).withColumn("documentation", _described("documentation"))
    return kept.dropDuplicates(["file_id", "name", "start_line"])


def pairs(files: DataFrame) -> DataFrame:
    """Code and description: a documented function with the lines from its declaration's first, decorators and annotations
    included, to the end of its body. A file's functions are gathered first, so its text is split into lines once."""
    found = documented(files)
    rest = [c for c in found.columns if c not in ("file_id", "language")]
    own = found.groupBy("file_id", "language").agg(F.collect_list(F.struct(*rest)).alias("functions"))
    lines = F.split("content", r"\r\n|\n|\r")
    both = own.join(_once(files).select("file_id", lines.alias("lines")), "file_id")
    code = lambda f: F.array_join(F.slice("lines", f["head_line"] + 1, f["end_line"] - f["head_line"] + 1), "\n")
    out = both.select("file_id", "language", F.explode(F.transform("functions", lambda f: F.struct(f.alias("f"), code(f).alias("code")))).alias("x"))
    return out.select("file_id", "language", *[F.col(f"x.f.{c}").alias(c) for c in rest if c != "head_line"], "x.code")
