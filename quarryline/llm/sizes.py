"""Sizes of texts in tokens of a public tokenizer. The vocabulary's path is a parameter; nothing of it is kept here."""

from __future__ import annotations

import base64

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
_loaded: dict[str, object] = {}


def default_vocabulary() -> str:
    try:
        import public_tokenizers

        return str(public_tokenizers.path(VOCABULARY))
    except ImportError:
        return f"/opt/tokenizers/{VOCABULARY}"


# How byte-level BPE vocabularies of this family cut a text before merging.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _encoder(path: str):
    if path not in _loaded:
        import tiktoken

        try:
            import public_tokenizers

            pattern = public_tokenizers.PATTERN
        except ImportError:
            pattern = PATTERN
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        _loaded[path] = tiktoken.Encoding("sizes", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _loaded[path]


def token_count(text: Column, path: str | None = None) -> Column:
    """Tokens of the whole text; null and empty texts have none. Strings of special tokens count as ordinary text."""
    where = path or default_vocabulary()

    @F.pandas_udf(T.IntegerType())
    def count(texts: pd.Series) -> pd.Series:
        encode = _encoder(where).encode_ordinary
        return texts.map(lambda t: len(encode(t)) if t else 0).astype("int32")

    return count(text)


def sized(documents: DataFrame, *keep: str, path: str | None = None) -> DataFrame:
    """``doc_id, tokens`` and the columns in ``keep``, once per document; texts are measured where they are read."""
    rows = documents.where("doc_id is not null").select("doc_id", *keep, token_count(F.col("text"), path).alias("tokens"))
    return rows
