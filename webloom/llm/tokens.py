"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: Where the tokenizer's ranks lie; a parameter, the file is never copied.
TOKENIZER = os.environ.get("WEBLOOM_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.tiktoken")
#: Split pattern of that byte-level BPE (published with the vocabulary).
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Longer texts are encoded in pieces, so that no call holds one huge text; they are cut only where the pattern always parts tokens:
#: before a blank, and between a letter and a sign.
PIECE = 100_000
_SAFE = re.compile(r"\S(?= )|[^\W\d_](?=[^\w\s])")

_loaded: dict[str, object] = {}


def encoding(path: str = TOKENIZER):
    if path not in _loaded:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _loaded[path] = tiktoken.Encoding("webloom", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _loaded[path]


def count_tokens(text: str, path: str = TOKENIZER) -> int:
    enc, n, at = encoding(path), 0, 0
    while len(text) - at > PIECE and (safe := _SAFE.search(text, at + PIECE)):
        n += len(enc.encode_ordinary(text[at : safe.end()]))
        at = safe.end()
    return n + len(enc.encode_ordinary(text[at:]))


def with_tokens(documents: DataFrame, keep: list[str], path: str = TOKENIZER) -> DataFrame:
    """The kept columns and ``n_tokens`` of each row's text; null texts have 0 tokens."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = [count_tokens(t, path) if t else 0 for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(sizes, pa.int64())], names=[*keep, "n_tokens"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in documents.select(*keep).schema.fields) + ", n_tokens long"
    return documents.select(*keep, "text").mapInArrow(measure, schema)
