"""Scalar text functions as Columns: tokens, identifier shapes, quoted spans, paths, languages, size estimates.

All accept null (null or empty results), keep to ASCII words as developer queries are read here, and stay on the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns of words, identifier shapes, quotes and paths.
WORD = r"[A-Za-z0-9_]+(?:[./\\][A-Za-z0-9_]+)*"
SHAPES = {
    "pascal": r"^(?:[A-Z][a-z0-9]+){2,}$",
    "camel": r"^[a-z][a-z0-9]*(?:[A-Z][a-z0-9]+)+$",
    "snake": r"^[a-z][a-z0-9]*(?:_[a-z0-9]+)+$",
    "constant": r"^[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)+$",
    "acronym": r"^[A-Z]{2,}$",
}
QUOTED = "[\"'`]([^\"'`]+)[\"'`]"
# Words that are no search terms.
STOP_WORDS = (
    "a an and are as at be by can could did do does for from had has have how i in into is it its of on or should so that the"
    " their there this to was were what when where which who why will with would you your"
).split()
# Extensions of source and configuration files.
EXTENSIONS = "c cc cfg cjs cpp cxx go h hpp hxx ini java js json jsx md mjs py pyi rs toml ts tsx txt yaml yml".split()
FILE_PATH = r"^[\w.\-]+(?:[/\\][\w.\-]+)*\.(?:" + "|".join(EXTENSIONS) + ")$"
# Words that name a language.
LANGUAGES = {
    "python": "python", "py": "python", "javascript": "javascript", "js": "javascript", "typescript": "typescript", "ts": "typescript",
    "java": "java", "go": "go", "golang": "go", "rust": "rust", "c++": "cpp", "cpp": "cpp", "c": "c",
}


def words(values: list[str]) -> Column:
    return F.array(*map(F.lit, values))


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def is_stop_word(token: Column) -> Column:
    return F.lower(token).isin(STOP_WORDS)


def search_tokens(text: Column) -> Column:
    """Lower-case tokens without stop words; repeats and order are kept."""
    return F.transform(F.filter(tokens(text), lambda t: ~is_stop_word(t)), F.lower)


def expanded(token_array: Column) -> Column:
    """Each token followed by its parts between ``_ . / \\``; empty parts, the token itself and stop words are left out."""
    parts = lambda t: F.filter(F.split(t, r"[_./\\]+"), lambda p: (p != "") & (p != t) & ~is_stop_word(p))
    return F.flatten(F.transform(token_array, lambda t: F.concat(F.array(t), parts(t))))


def has_shape(token: Column, shape: str) -> Column:
    return token.rlike(SHAPES[shape])


def looks_like_identifier(token: Column) -> Column:
    return token.rlike("|".join(f"(?:{p})" for p in SHAPES.values()))


def quoted(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(QUOTED), F.lit(1))


def looks_like_file_path(token: Column) -> Column:
    return token.rlike(FILE_PATH)


def known_extension(token: Column) -> Column:
    """The token's extension if it is one of ``EXTENSIONS``, else null."""
    suffix = F.when(F.instr(token, ".") > 0, F.lower(F.element_at(F.split(token, r"\."), -1)))
    return F.when(suffix.isin(EXTENSIONS), suffix)


def symbols(text: Column) -> Column:
    """Tokens that look like code, then quoted spans, each once, in order."""
    named = F.filter(tokens(text), lambda t: looks_like_identifier(t) & ~looks_like_file_path(t))
    return F.array_distinct(F.concat(named, quoted(text)))


def file_paths(text: Column) -> Column:
    return F.array_distinct(F.filter(tokens(text), lambda t: looks_like_file_path(t) | known_extension(t).isNotNull()))


def keywords(text: Column) -> Column:
    return F.array_distinct(F.filter(tokens(text), lambda t: ~is_stop_word(t)))


def language(text: Column) -> Column:
    """The language that is mentioned first, else null."""
    table = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    named = F.filter(F.transform(tokens(text), lambda t: F.try_element_at(table, F.lower(t))), lambda x: x.isNotNull())
    return F.try_element_at(named, F.lit(1))


def estimated_tokens(text: Column) -> Column:
    """A quarter of the code points, rounded up."""
    return F.ceil(F.length(F.coalesce(text, F.lit(""))) / 4)


def byte_span(content: Column, start: Column, end: Column) -> Column:
    """Bytes ``start`` to ``end`` of a text's UTF-8 form; null for a negative or inverted span."""
    return F.when((start >= 0) & (end >= start), F.substring(F.encode(content, "UTF-8"), start + 1, end - start))


def module_path(path: Column) -> Column:
    """Dotted module of a Python path; a package for its ``__init__``."""
    bare = F.regexp_replace(path, r"\.pyi?$", "")
    return F.regexp_replace(F.regexp_replace(bare, r"/__init__$", ""), "/", ".")


def top_level(path: Column) -> Column:
    """The first directory, or the bare stem of a file outside of any."""
    return F.when(F.instr(path, "/") > 0, F.substring_index(path, "/", 1)).otherwise(F.regexp_replace(path, r"\.[^.]*$", ""))


def import_target(line: Column, lang: Column) -> Column:
    """The module, path or header that an import statement names, by the rules of its language; null if none."""
    some = lambda p, g=1: F.nullif(F.regexp_extract(line, p, g), F.lit(""))
    return (
        F.when(lang == "python", F.coalesce(some(r"from\s+([.\w]+)\s+import"), some(r"import\s+([.\w]+)")))
        .when(lang.isin("javascript", "typescript", "go"), some("['\"]([^'\"]+)['\"]"))
        .when(lang == "java", some(r"import\s+(?:static\s+)?([\w.]+)\s*;"))
        .when(lang == "rust", some(r"use\s+([\w:]+)"))
        .when(lang.isin("c", "cpp"), some(r"#include\s*[<\"]([^>\"]+)[>\"]"))
    )


def module_stem(target: Column) -> Column:
    """The last segment of a path, dotted or ``::`` name."""
    bare = F.regexp_replace(target, r"^\.+|\.+$", "")
    return F.nullif(F.element_at(F.split(bare, r"[./\\:]+"), -1), F.lit(""))


def collapsed(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"\s+", " "), "^ | $", "")


def query_id(*parts: Column) -> Column:
    """Sixteen hexadecimal digits of a hash over the parts."""
    return F.substring(F.sha2(F.concat_ws("\x1f", *parts), 256), 1, 16)
