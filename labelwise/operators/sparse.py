"""Sparse text features and their gradients.

A row's features are two arrays, the positions of its values in ascending order and the values: as many as the row has
distinct hashed words, however wide the feature space is.  A gradient pass multiplies whole Arrow batches as compressed rows
(one flat list of positions and values with row bounds).  Every task adds up touched positions only, and the shuffle merges these.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelwise.functions.text import tokens
from labelwise.operators.train import GRAD_SCHEMA, Head, _any_label, _softmax_rows

#: Positions that a task's pending sums may take before they are merged.
PENDING = 2_000_000
#: Words or values of the rows that are worked on at once.
SLICE = 1 << 18


def _slices(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """The rows of a batch, cut so that the lists of one slice hold about SLICE values (one longer row stands alone)."""
    total = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)])
    at = 0
    while at < batch.num_rows:
        end = max(int(np.searchsorted(total, total[at] + SLICE, side="right")) - 1, at + 1)
        yield batch.slice(at, end - at)
        at = end


def word_bucket(word: str, bits: int) -> int:
    """Position of a word: the first 32 bits of its MD5 modulo 2**bits, which any SQL engine can compute."""
    return int(hashlib.md5(word.encode()).hexdigest()[:8], 16) % (1 << bits)


def hashed_counts(df: DataFrame, text: str = "text", bits: int = 18, idx: str = "idx", val: str = "val") -> DataFrame:
    """``df`` with counts of hashed words: positions (array of int, ascending) and counts (array of double).

    Words are those of :func:`tokens`; a null or wordless text has empty arrays.  No word leaves its row: words are hashed once per
    Arrow batch and distinct word, and counted slice by slice.
    """
    if not 1 <= bits <= 30:
        raise ValueError("bits must lie between 1 and 30")
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema] + [f"`{idx}` array<int>", f"`{val}` array<double>"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            coded = batch.column(batch.num_columns - 1).flatten().dictionary_encode()
            bucket = np.array([word_bucket(w, bits) for w in coded.dictionary.to_pylist()], np.int64)
            code, done = coded.indices.to_numpy(), 0
            for rb in _slices(batch, batch.num_columns - 1):
                sizes = pc.fill_null(pc.list_value_length(rb.column(rb.num_columns - 1)), 0).to_numpy(zero_copy_only=False)
                row = np.repeat(np.arange(rb.num_rows, dtype=np.int64), sizes)
                cell, count = np.unique((row << bits) + bucket[code[done:done + len(row)]] if len(row) else np.zeros(0, np.int64), return_counts=True)
                done += len(row)
                at = pa.array(np.searchsorted(cell, np.arange(rb.num_rows + 1, dtype=np.int64) << bits).astype(np.int32))
                made = [pa.ListArray.from_arrays(at, pa.array((cell & ((1 << bits) - 1)).astype(np.int32))),
                        pa.ListArray.from_arrays(at, pa.array(count.astype(np.float64)))]
                yield pa.RecordBatch.from_arrays([*rb.columns[:-1], *made], names=[*rb.schema.names[:-1], idx, val])

    return df.select("*", F.coalesce(tokens(text), F.array().cast("array<string>")).alias("_words")).mapInArrow(run, schema)


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sums by position: (positions, classes x positions)."""
    pos, inverse = np.unique(np.concatenate([p for p, _ in parts]), return_inverse=True)
    values = np.concatenate([v for _, v in parts], axis=1)
    return pos, np.stack([np.bincount(inverse, weights=v, minlength=len(pos)) for v in values])


def sparse_gradient_table(df: DataFrame, heads: dict[str, Head], labels: dict[str, str], idx: str = "idx", val: str = "val") -> DataFrame:
    """The gradient table of :func:`train.gradient_table` for sparse rows: (task, class, pos, value), without the positions that no
    row touches; pos = width of the heads is the bias, class = -1 the summed loss (pos 0) and the labelled rows (pos 1).

    A row without a task's label counts for the other tasks only; a label outside the classes or a position outside the heads is an
    error, and so are arrays of different lengths.
    """
    tasks = list(heads)
    width = next(iter(heads.values())).W.shape[1]
    base = df.where(_any_label(heads, labels)).select(F.col(idx).alias("_i"), F.col(val).alias("_v"), *[F.col(labels[t]).alias(f"_y{k}") for k, t in enumerate(tasks)])

    def partials(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pending: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {t: [] for t in tasks}
        loss, n, held = dict.fromkeys(tasks, 0.0), dict.fromkeys(tasks, 0.0), 0
        for rb in (part for batch in batches for part in _slices(batch, 0)):
            sizes = pc.fill_null(pc.list_value_length(rb.column(0)), 0).to_numpy(zero_copy_only=False)
            if not np.array_equal(sizes, pc.fill_null(pc.list_value_length(rb.column(1)), 0).to_numpy(zero_copy_only=False)):
                raise ValueError("positions and values of a row differ in number")
            at = rb.column(0).flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            value = rb.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            if len(at) and (at.min() < 0 or at.max() >= width):
                raise ValueError(f"a position lies outside 0..{width - 1}")
            row = np.repeat(np.arange(rb.num_rows), sizes)
            pos, inverse = np.unique(at, return_inverse=True)
            touched = np.append(pos, width)
            for k, t in enumerate(tasks):
                W, b = heads[t].W, heads[t].b
                label = rb.column(2 + k)
                own = label.is_valid().to_numpy(zero_copy_only=False)
                y = label.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
                if ((y < 0) | (y >= len(b))).any():
                    raise ValueError(f"label of task {t} outside 0..{len(b) - 1}")
                z = np.stack([np.bincount(row, weights=W[c, at] * value, minlength=rb.num_rows) for c in range(len(b))], axis=1) + b
                p, lse, z = _softmax_rows(z)
                loss[t] += float((lse - z[np.arange(len(y)), y])[own].sum())
                n[t] += float(own.sum())
                p[np.arange(len(y)), y] -= 1.0
                p[~own] = 0.0
                sums = [np.bincount(inverse, weights=p[row, c] * value, minlength=len(pos)) for c in range(len(b))]
                pending[t].append((touched, np.column_stack([np.stack(sums) if len(pos) else np.zeros((len(b), 0)), p.sum(axis=0)])))
            held += len(pos) + 1
            if held > PENDING:
                for t in tasks:  # one after the other, so that one task's parts go before the next is merged
                    pending[t] = [_merged(pending[t])]
                held = max(len(v[0][0]) for v in pending.values())
        for t in tasks:
            if not pending[t]:
                continue
            pos, sums = _merged(pending.pop(t))
            for c, values in enumerate(sums):
                yield _rows(t, c, pos, values)
            yield _rows(t, -1, np.array([0, 1]), np.array([loss[t], n[t]]))

    return base.mapInArrow(partials, GRAD_SCHEMA).groupBy("task", "class", "pos").agg(F.sum("value").alias("value"))


def _rows(task: str, cls: int, pos: np.ndarray, values: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([task] * len(pos)), pa.array(np.full(len(pos), cls, np.int32)), pa.array(pos.astype(np.int32)), pa.array(values)],
                                      names=["task", "class", "pos", "value"])


def sparse_scores(df: DataFrame, head: Head, idx: str = "idx", val: str = "val", out: str = "logits", keep: Sequence[str] = ("row_id",)) -> DataFrame:
    """``keep`` and the head's scores of every sparse row (array of double, one per class)."""
    src = df.select(*keep, F.col(idx).alias("_i"), F.col(val).alias("_v"))
    schema = ", ".join([f"`{c}` {src.schema[c].dataType.simpleString()}" for c in keep] + [f"`{out}` array<double>"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            sizes = pc.fill_null(pc.list_value_length(rb.column(len(keep))), 0).to_numpy(zero_copy_only=False)
            at = rb.column(len(keep)).flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            value = rb.column(len(keep) + 1).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            row = np.repeat(np.arange(rb.num_rows), sizes)
            z = np.stack([np.bincount(row, weights=w[at] * value, minlength=rb.num_rows) for w in head.W], axis=1) + head.b
            ends = pa.array((np.arange(rb.num_rows + 1) * head.classes).astype(np.int32))
            yield pa.RecordBatch.from_arrays([*rb.columns[:len(keep)], pa.ListArray.from_arrays(ends, pa.array(z.ravel()))], names=[*keep, out])

    return src.mapInArrow(run, schema)
