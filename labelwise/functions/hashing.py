"""Reproducible keys from md5, identical to what a SQL engine computes.

``rand(seed)`` depends on how rows fall into partitions, so orderings and
splits are derived from ``md5(seed ':' [epoch ':'] id)`` instead.  The same
hex digest is available in every SQL dialect, which keeps results checkable.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def shuffle_key(id_col, seed: int, epoch: int | Column | None = None) -> Column:
    """Hex digest ordering rows reproducibly for one (seed, epoch)."""
    parts = [F.lit(str(seed)), F.lit(":")]
    if epoch is not None:
        parts += [_col(epoch).cast("string") if isinstance(epoch, Column) else F.lit(str(epoch)), F.lit(":")]
    parts.append(_col(id_col).cast("string"))
    return F.md5(F.concat(*parts))


def hash_bucket(id_col, seed: int, buckets: int = 10) -> Column:
    """Bucket 0..buckets-1 from the first 32 bits of ``md5(seed ':' id)``."""
    digest = F.md5(F.concat(F.lit(str(seed)), F.lit(":"), _col(id_col).cast("string")))
    return (F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") % F.lit(buckets)).cast("int")
