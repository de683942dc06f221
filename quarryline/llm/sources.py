"""Source files that don't parse (p2).

Every file is parsed with all grammars, in the order of the evidence that its words give: the grammar of its extension decides
whether it is valid, a foreign grammar that accepts it points to a wrong extension, none at all to damage.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarryline.llm import grammars
from quarryline.session import first_delivery


def language_of(path: Column) -> Column:
    """The language that a path's extension stands for, else null."""
    extension = F.lower(F.regexp_extract(path, r"\.([A-Za-z]+)$", 1))
    out = F.lit(None).cast("string")
    for ext, language in grammars.EXTENSIONS.items():
        out = F.when(extension == ext, language).otherwise(out)
    return out


def verdict(language: str, text: str) -> tuple[bool | None, list[str], str | None]:
    """(valid, or null where no grammar comes to an end; the languages whose grammars accept the text, the likeliest first;
    what is wrong). A text without a character is valid in its own language."""
    if not text.removeprefix("\ufeff").strip():
        return True, [language], None
    found = {lang: grammars.judged(lang, text) for lang in grammars.ranked(text)}
    accepted = [lang for lang, good in found.items() if good]
    own = found[language]
    if own:
        return True, accepted, None
    if own is None:
        return None, accepted, "too deep"
    if accepted:
        return False, accepted, "wrong extension"
    if re.search(r"(?m)^(<{7} |>{7} |\|{7} )", text):
        return False, [], "merge conflict"
    opened, closed = sum(map(text.count, "([{")), sum(map(text.count, ")]}"))
    return False, [], "truncated" if opened > closed or not text.endswith(("\n", "\r")) else "corrupt"


_VERDICT = T.StructType([T.StructField("valid", T.BooleanType()), T.StructField("accepted_by", T.ArrayType(T.StringType())), T.StructField("fault", T.StringType())])


@F.pandas_udf(_VERDICT)
def _checked(language: pd.Series, content: pd.Series) -> pd.DataFrame:
    rows = [verdict(a, b or "") if a else (None, None, None) for a, b in zip(language, content)]
    return pd.DataFrame(rows, columns=["valid", "accepted_by", "fault"])


def checked(files: DataFrame) -> DataFrame:
    """``file_id, repository_id, commit_sha, path, language, valid, accepted_by, fault``, one row per file.

    ``accepted_by`` holds every language whose grammar accepts the file. A file whose extension stands for no language here
    isn't judged (null), nor is one nested deeper than memory can follow (null, ``too deep``); null and empty contents are
    valid; of a re-delivered file the earliest row counts. Contents are parsed where they are read, only verdicts are shuffled.
    """
    rows = files.where("file_id is not null").withColumn("language", language_of(F.col("path"))).withColumn("c", _checked("language", "content"))
    flat = rows.select("file_id", "parsed_at", "repository_id", "commit_sha", "path", "language", F.col("c.valid").alias("valid"), F.col("c.accepted_by").alias("accepted_by"), F.col("c.fault").alias("fault"))
    return first_delivery(flat, "file_id", ["parsed_at"]).drop("parsed_at")


def invalid(files: DataFrame) -> DataFrame:
    return checked(files).where("not valid")


def _plain_path(path: Column, repository: Column) -> Column:
    """A logged path as the repository has it: separators, leading dots and the place of the checkout don't count."""
    slashed = F.regexp_replace(path, r"\\", "/")
    home = F.concat(F.lit("/"), repository, F.lit("/"))
    at = F.instr(slashed, home)
    inside = F.when(slashed.startswith("/") & (at > 0), F.substr(slashed, at + F.length(home))).otherwise(slashed)
    return F.regexp_replace(inside, r"^(\./|/)+", "")


def rates(files: DataFrame, errors: DataFrame) -> DataFrame:
    """Per repository and language: files, files that don't parse, their rate, and how many of those the parser logged."""
    logged = first_delivery(errors, "error_id", ["logged_at"]).where("file_path is not null")
    logged = logged.select("repository_id", "commit_sha", _plain_path(F.col("file_path"), F.col("repository_id")).alias("path")).distinct().withColumn("logged", F.lit(1))
    rows = checked(files).where("language is not null").join(logged, ["repository_id", "commit_sha", "path"], "left")
    return rows.groupBy("repository_id", "language").agg(
        F.count("*").alias("files"),
        F.sum((~F.col("valid")).cast("long")).alias("failing"),
        F.avg((~F.col("valid")).cast("double")).alias("rate"),
        F.sum(F.when(~F.col("valid"), F.coalesce("logged", F.lit(0))).otherwise(0)).alias("logged"),
        F.sum(F.when(F.col("valid"), F.coalesce("logged", F.lit(0))).otherwise(0)).alias("wrongly_logged"),
    )
