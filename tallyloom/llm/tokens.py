"""Token counts by a public tokenizer, whose vocabulary file is a parameter."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.session import tokenizer_path


@lru_cache(maxsize=4)
def encoder(path: str) -> Callable[[str], int]:
    """Tokens of a text, by the kind of the file: .tiktoken ranks, .json (tokenizers) or .model (sentencepiece)."""
    if path.endswith(".tiktoken"):
        import base64

        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        return lambda t: len(enc.encode_ordinary(t))
    if path.endswith(".json"):
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)
        tok.encode_special_tokens = True
        return lambda t: len(tok.encode(t, add_special_tokens=False).ids)
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    return lambda t: len(sp.encode(t, num_threads=1))


def n_tokens(text: Column, path: str | None = None) -> Column:
    """Tokens of the whole text; NULL counts 0."""
    at = path or tokenizer_path()

    @F.pandas_udf("bigint")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        n = encoder(at)
        for s in batches:
            yield pd.Series([n(t) if t else 0 for t in s], dtype="int64")

    return count(text)


def counted(docs: DataFrame, text_col: str = "text", path: str | None = None) -> DataFrame:
    """docs without its text, with n_tok."""
    return docs.withColumn("n_tok", n_tokens(F.col(text_col), path)).drop(text_col)
