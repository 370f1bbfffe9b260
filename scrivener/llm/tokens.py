"""Encoding of a text column with a public byte-level BPE tokenizer."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from scrivener.llm import bpe

DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Characters handled at once; bounds a worker's memory, not the length of a text.
CHUNK = 1 << 20


def _chunks(texts: list[str]) -> Iterator[tuple[int, int]]:
    first = size = 0
    for i, t in enumerate(texts):
        size += len(t) + 1
        if size >= CHUNK:
            yield first, i + 1
            first, size = i + 1, 0
    if first < len(texts):
        yield first, len(texts)


def _run(df: DataFrame, keys: list[str], text: str, path: str, ids: bool) -> DataFrame:
    made = T.StructField("ids", T.ArrayType(T.IntegerType())) if ids else T.StructField("n_tokens", T.LongType())
    schema = T.StructType([*[df.schema[k] for k in keys], made])
    width = len(keys)
    shared = df.sparkSession.sparkContext.broadcast(bpe.load_vocabulary(path))  # fixed size: the vocabulary

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = shared.value
        for batch in it:
            texts = ["" if t is None else t for t in batch.column(width).to_pylist()]
            for a, b in _chunks(texts):
                own = [batch.column(i).slice(a, b - a) for i in range(width)]
                if ids:
                    flat, size = bpe.encode(texts[a:b], v)
                    offsets = np.r_[0, np.cumsum(size)].astype(np.int32)
                    out = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, pa.int32()))
                else:
                    out = pa.array(bpe.count(texts[a:b], v), pa.int64())
                yield pa.RecordBatch.from_arrays([*own, out], names=schema.names)

    return df.select(*[df[k] for k in keys], df[text]).mapInArrow(batches, schema)


def encode_column(df: DataFrame, key: str, text: str, path: str = DEFAULT_VOCABULARY) -> DataFrame:
    """``key`` and ``ids``, the token ids of ``text`` without special tokens.

    One row for each input row, in one pass over the rows without a shuffle. Null and empty texts have the empty list.
    Strings of special tokens inside a text are ordinary text. Whole texts of any length are encoded; other columns
    are dropped, an empty table gives no rows, repeated rows are encoded each.
    """
    return _run(df, [key], text, path, ids=True)


def count_column(df: DataFrame, keys: list[str], text: str, path: str = DEFAULT_VOCABULARY) -> DataFrame:
    """``keys`` and ``n_tokens``, the number of ids that ``encode_column`` gives; 0 for null and empty texts."""
    return _run(df, keys, text, path, ids=False)
