"""Array column expressions: padding, masks, argmax, linear maps, softmax, losses.

All are built-in higher-order functions: they run in the JVM, without Python,
but Spark interprets their lambdas row by row.  Weights enter as array literals
(a handful of classes times the feature width), never through a join; whole
batches go faster through the Arrow passes of ``operators.train``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _dlit(values: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def pad_truncate(arr, n: int, pad: int = 0) -> Column:
    """Exactly ``n`` elements: keep the first ``n``, pad the end with ``pad``."""
    a = _col(arr)
    return F.concat(F.slice(a, 1, n), F.array_repeat(F.lit(pad), F.greatest(F.lit(0), F.lit(n) - F.size(a))))


def attention_mask(ids) -> Column:
    """1 where the id is positive, else 0."""
    return F.transform(_col(ids), lambda x: (x > 0).cast("int"))


def argmax(arr) -> Column:
    """0-based index of the largest element; ties go to the lowest index."""
    a = _col(arr)
    return (F.array_position(a, F.array_max(a)) - 1).cast("int")


def dot(x, w: Sequence[float] | Column) -> Column:
    """Inner product of an array column with a weight vector."""
    wv = w if isinstance(w, Column) else _dlit(w)
    prod = F.zip_with(_col(x), wv, lambda a, b: a.cast("double") * b)
    return F.aggregate(prod, F.lit(0.0), lambda acc, v: acc + v)


def linear(x, weights: Sequence[Sequence[float]], bias: Sequence[float] | None = None) -> Column:
    """``W x + b`` as an array of one value per output row of ``W``."""
    bias = bias if bias is not None else [0.0] * len(weights)
    return F.array(*[dot(x, row) + F.lit(float(b)) for row, b in zip(weights, bias)])


def tanh_array(arr) -> Column:
    return F.transform(_col(arr), lambda v: F.tanh(v))


def softmax(arr) -> Column:
    """Max-shifted softmax of an array of scores."""
    a = _col(arr)
    shifted = F.transform(a, lambda v: F.exp(v - F.array_max(a)))
    total = F.aggregate(shifted, F.lit(0.0), lambda acc, v: acc + v)
    return F.transform(shifted, lambda v: v / total)


def logsumexp(arr) -> Column:
    a = _col(arr)
    m = F.array_max(a)
    return m + F.log(F.aggregate(F.transform(a, lambda v: F.exp(v - m)), F.lit(0.0), lambda acc, v: acc + v))


def cross_entropy(logits, label) -> Column:
    """``logsumexp(z) - z[y]`` for a 0-based class label."""
    z = _col(logits)
    return logsumexp(z) - F.element_at(z, _col(label).cast("int") + 1)


def l2_norm(arr) -> Column:
    return F.sqrt(F.aggregate(_col(arr), F.lit(0.0), lambda acc, v: acc + v * v))


def clip_norm(arr, max_norm: float = 1.0) -> Column:
    """Scale the vector by ``min(1, max_norm / (norm + 1e-6))``."""
    a = _col(arr)
    coef = F.least(F.lit(1.0), F.lit(float(max_norm)) / (l2_norm(a) + F.lit(1e-6)))
    return F.transform(a, lambda v: v * coef)
