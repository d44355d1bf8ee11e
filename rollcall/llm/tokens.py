"""Token counts with a public byte-pair vocabulary, in Arrow batches."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame

#: Where vocabulary files lie; a parameter of every operator that counts tokens.
VOCABULARY = os.path.join("/opt/tokenizers", "byte_bpe_multi_50k.tiktoken")
#: Longer texts are encoded in parts, cut at white space where there is any, so that time stays linear in length.
PART = 100_000


@lru_cache(maxsize=4)
def encoding(path: str):
    """The vocabulary of a rank file, loaded once in each Python worker; special tokens are ordinary text."""
    import tiktoken
    from public_tokenizers import PATTERN

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_ids(text: str | None, path: str) -> list[int]:
    """Ids of the whole text; none for None and ''."""
    if not text:
        return []
    encode = encoding(path).encode_ordinary
    if len(text) <= PART:
        return encode(text)
    out: list[int] = []
    at = 0
    while at < len(text):
        end = min(len(text), at + PART)
        if end < len(text):
            space = max(text.rfind(" ", at + PART // 2, end), text.rfind("\n", at + PART // 2, end))
            end = space if space > at else end
        out += encode(text[at:end])
        at = end
    return out


def count_tokens(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str = VOCABULARY, keep: tuple[str, ...] = ()) -> DataFrame:
    """(key, keep..., n_tokens) for every row; 0 for null and empty texts."""
    kinds = dict(docs.dtypes)
    names = [key, *keep]

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b[names].assign(n_tokens=[len(token_ids(t, path)) for t in b[text]])

    return docs.select(*names, text).mapInPandas(count, ", ".join(f"`{c}` {kinds[c]}" for c in names) + ", n_tokens bigint")
