"""DataFrame-level vector operators: pooled attention over sequences,
softmax over a sequence, dot-product matrices, step differences.

Sequences are stored long -- one row per (sequence, position) -- so a
window or aggregate per sequence is bounded by the sequence length.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelwise.functions import arrays as A


def formula_weights(rows: int, cols: int, a: int = 7, b: int = 3, m: int = 11, scale: float = 10.0,
                    row_offset: int = 0) -> list[list[float]]:
    """Deterministic start parameters ``((a*col + b*row) mod m - m//2) / scale``.

    A closed formula of the position instead of a random draw, so the same
    start can be written in SQL and runs are reproducible.
    """
    return [[(((a * c + b * (r + row_offset)) % m) - m // 2) / scale for c in range(cols)] for r in range(rows)]


def softmax_weights(df: DataFrame, seq: Sequence[str], score: str = "score", out: str = "weight") -> DataFrame:
    """Normalise scores over each sequence (max-shifted), weights sum to 1.

    A sequence is one text's positions, at most the encoding length, so a
    window per sequence is bounded: one scan and one exchange.
    """
    own = Window.partitionBy(*seq)
    shifted = df.withColumn("_e", F.exp(F.col(score) - F.max(score).over(own)))
    return shifted.withColumn(out, F.col("_e") / F.sum("_e").over(own)).drop("_e")


def hop_scores(vec, w1: Sequence[Sequence[float]], b1: Sequence[float], w2: Sequence[Sequence[float]],
               b2: Sequence[float]) -> Column:
    """Attention scores of one position: ``W2 tanh(W1 h + b1) + b2`` (one per hop)."""
    return A.linear(A.tanh_array(A.linear(vec, w1, b1)), w2, b2)


def attention_pool(df: DataFrame, seq: str = "seq_id", pos: str = "pos", vec: str = "vec",
                   scores: Column | None = None, mask: str | None = None,
                   network: tuple[Sequence[Sequence[float]], Sequence[float], Sequence[Sequence[float]], Sequence[float]] | None = None) -> DataFrame:
    """Per hop, a softmax over positions weights the position vectors; the
    weighted sums of all hops are concatenated into one pooled vector.

    ``scores`` is an array column (one score per hop), e.g. from
    :func:`hop_scores`; ``network`` (W1, b1, W2, b2) gives the same scores
    as whole matrix products inside the pass; default is one hop scored by
    the vector's first element.  With ``mask`` (a 0/1 column) masked positions
    get no weight; without it every position counts, padding included.
    Positions without a vector or scores are left out.
    Returns (seq, pooled) with ``pooled`` ordered hop-major.

    One exchange brings the rows of a sequence together, sorted, so that an
    Arrow batch is a run of whole sequences (compressed rows: flat vectors
    with bounds).  Each sequence is a segment of a few matrix operations; what
    is open at the end of a batch is carried as its running maximum, sum and
    weighted vector, so a sequence may be longer than any batch, and nothing
    is exploded.
    """
    if scores is not None and network is not None:
        raise ValueError("give scores or a network, not both")
    column = F.col(vec)
    if network is None:
        sc = scores if scores is not None else F.array(F.element_at(column, 1).cast("double"))
    else:
        sc = F.array().cast("array<double>")
        w1, b1, w2, b2 = (np.asarray(m, dtype=np.float64) for m in network)
    base = df.where(F.col(mask) == 1) if mask else df
    base = base.select(F.col(seq).alias("_k"), F.transform(column, lambda v: v.cast("double")).alias("_v"), sc.cast("array<double>").alias("_s"))
    base = base.where("_v IS NOT NULL AND _s IS NOT NULL" + ("" if network is not None else " AND NOT exists(_s, s -> s IS NULL)"))
    ordered = base.repartition("_k").sortWithinPartitions("_k")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # key, maximum (hops), sum (hops), weighted vectors (hops x d) of the open sequence
        for rb in batches:
            n = rb.num_rows
            if n == 0:
                continue
            keys = rb.column(0)
            starts, firsts = _key_runs(keys)
            xs = _rows_of(rb.column(1), n)
            z = np.tanh(xs @ w1.T + b1) @ w2.T + b2 if network is not None else _rows_of(rb.column(2), n)
            peak = np.maximum.reduceat(z, starts, axis=0)
            sizes = np.diff(np.append(starts, n))
            e = np.exp(z - np.repeat(peak, sizes, axis=0))
            total = np.add.reduceat(e, starts, axis=0)
            pooled = np.stack([np.add.reduceat(e[:, h:h + 1] * xs, starts, axis=0) for h in range(z.shape[1])], axis=1)
            parts = [(k, peak[i], total[i], pooled[i]) for i, k in enumerate(firsts)]
            if held is not None:
                if held[0] == parts[0][0]:
                    parts[0] = _joined(held, parts[0])
                else:
                    parts.insert(0, held)
            held = parts.pop()
            if parts:
                yield _pooled(parts, keys.type)
        if held is not None:
            yield _pooled([held], keys.type)

    kind = df.schema[seq].dataType.simpleString()
    return ordered.mapInArrow(run, f"`{seq}` {kind}, pooled array<double>")


def _key_runs(keys: pa.Array) -> tuple[np.ndarray, list]:
    """Starts and values of the runs of equal keys (null equals null)."""
    runs = pc.run_end_encode(keys)
    ends = runs.run_ends.to_numpy()
    return np.concatenate([[0], ends[:-1]]).astype(np.int64), runs.values.to_pylist()


def _rows_of(column: pa.Array, n: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if flat.size % n or not np.all(np.diff(column.offsets.to_numpy()) == flat.size // n):
        raise ValueError("vectors of one sequence set must have the same length")
    return flat.reshape(n, flat.size // n)


def _joined(a, b):
    """Two parts of one sequence under their common maximum."""
    peak = np.maximum(a[1], b[1])
    u, v = np.exp(a[1] - peak), np.exp(b[1] - peak)
    return a[0], peak, a[2] * u + b[2] * v, a[3] * u[:, None] + b[3] * v[:, None]


def _pooled(parts: list, kind: pa.DataType) -> pa.RecordBatch:
    flat = np.stack([(w / t[:, None]).ravel() for _, _, t, w in parts])
    ends = pa.array((np.arange(len(parts) + 1) * flat.shape[1]).astype(np.int32))
    return pa.RecordBatch.from_arrays([pa.array([p[0] for p in parts], kind), pa.ListArray.from_arrays(ends, pa.array(flat.ravel()))], names=["seq", "pooled"])


def dot_matrix(left: DataFrame, right: DataFrame, lid: str = "qid", rid: str = "sid", pos: str = "pos",
               value: str = "value", max_vectors: int = 10_000) -> DataFrame:
    """All dot products ``L . R^T`` of two vector sets stored long (id, pos, value).

    Every left vector meets every right vector, so both sets must be small
    and bounded by a parameter (per-step gradient vectors, a fixed number
    of group means) -- never raw data rows.  More than ``max_vectors`` on
    either side is an error.
    """
    for side, key in ((left, lid), (right, rid)):
        if side.select(key).distinct().limit(max_vectors + 1).count() > max_vectors:
            raise ValueError(f"dot_matrix takes at most {max_vectors} vectors a side")
    l = left.select(F.col(lid), F.col(pos), F.col(value).alias("_l"))
    r = right.select(F.col(rid), F.col(pos), F.col(value).alias("_r"))
    return l.join(r, pos).groupBy(lid, rid).agg(F.sum(F.col("_l") * F.col("_r")).alias("dot"))


def grad_difference(df: DataFrame, keys: Sequence[str] = ("task", "pos"), step: str = "step", value: str = "value",
                    faithful: bool = False) -> DataFrame:
    """Accumulated vectors to per-step increments: ``g[s] - g[s-1]``.

    ``faithful=True`` differences step 1 only, as the source loop does with
    two tasks; the default differences every step.
    """
    prev = F.lag(value).over(Window.partitionBy(*keys).orderBy(step))
    diff = F.col(value) - F.coalesce(prev, F.lit(0.0))
    if faithful:
        diff = F.when(F.col(step) == 1, diff).otherwise(F.col(value))
    return df.withColumn(value, diff)
