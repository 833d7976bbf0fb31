"""Sizes of texts in tokens of a public tokenizer (the file's path is a parameter; it is never copied)."""

from __future__ import annotations

import base64
import os

from pyspark.sql import Column, DataFrame, functions as F

from .common import map_batches

TOKENIZER = os.environ.get("VELLUMINE_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.tiktoken")
#: The pre-token pattern that belongs to the vocabulary (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_loaded: dict[str, object] = {}


def encoding(path: str):
    """The tokenizer of a rank file, loaded once a worker."""
    if path not in _loaded:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        _loaded[path] = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _loaded[path]


def token_counts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", extra: tuple[str, ...] = (), tokenizer: str = TOKENIZER) -> DataFrame:
    """``id_col``, the ``extra`` columns and ``n_tokens``. Null and empty texts have 0 tokens; whole texts are read."""
    names = [id_col, *extra]
    text: Column = F.col(text_col)
    kept = df.select(*names, F.coalesce(text, F.lit("")).alias("__text"))

    def make():
        enc = encoding(tokenizer)

        def count(*columns):
            *keep, texts = columns
            return [*keep, [len(enc.encode_ordinary(t)) for t in texts]]

        return count

    schema = ", ".join(f"`{n}` {kept.schema[n].dataType.simpleString()}" for n in names)
    return map_batches(kept, make, f"{schema}, n_tokens bigint")
