"""Plugging a per-row encoder (tokenizer, model) into a DataFrame.

The encoder is built once per task and fed whole Arrow batches through
``mapInArrow``; Spark partitions and schedules the work.  A deterministic
demo encoder (hashed bag of words) is provided.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

Encoder = Callable[[pa.Array], pa.Array]


def apply_encoder(df: DataFrame, make_encoder: Callable[[], Encoder], input_col: str, output_col: str = "x",
                  keep: Sequence[str] = ("row_id",), output_type=ArrayType(DoubleType(), False)) -> DataFrame:
    """Run ``make_encoder()`` once per task and map every Arrow batch of
    ``input_col`` to ``output_col``; ``keep`` columns pass through."""
    keep = list(keep)
    src = df.select(*keep, input_col)
    schema = StructType([src.schema[k] for k in keep] + [StructField(output_col, output_type, True)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = make_encoder()
        for rb in batches:
            out = encode(rb.column(len(keep)))
            yield pa.RecordBatch.from_arrays([rb.column(i) for i in range(len(keep))] + [out],
                                             names=keep + [output_col])

    return src.mapInArrow(run, schema)


def token_bucket(token: str, dim: int) -> int:
    """Bucket of a token: first 32 bits of its md5 digest, modulo ``dim``."""
    return int(hashlib.md5(token.encode("utf-8")).hexdigest()[:8], 16) % dim


def hashed_bag_of_words(dim: int = 32) -> Callable[[], Encoder]:
    """Encoder factory: token lists to relative frequencies per hash bucket."""

    def make() -> Encoder:
        def encode(tokens: pa.Array) -> pa.Array:
            size = pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            row = np.repeat(np.arange(len(size)), size)
            # every distinct token of the batch is hashed once; nothing outlives the batch
            words = pc.dictionary_encode(tokens.flatten())
            bucket = np.array([token_bucket(t, dim) for t in words.dictionary.to_pylist()], np.int64)
            cell = row * dim + bucket[words.indices.to_numpy(zero_copy_only=False)] if len(row) else row
            counts = np.bincount(cell, minlength=len(size) * dim).reshape(len(size), dim)
            share = counts / np.maximum(size, 1)[:, None]
            return pa.ListArray.from_arrays(pa.array(np.arange(0, len(size) * dim + 1, dim).astype(np.int32)), pa.array(share.ravel()))

        return encode

    return make
