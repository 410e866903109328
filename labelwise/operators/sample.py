"""Reproducible order, exact fixed-size batches and hash splits.

An exact global position needs a total order over all rows.  A window with
no partition key would sort everything in one task, so positions come from
range partitioning instead: rows are range-partitioned and sorted on the
order key, each partition numbers its rows locally, the per-partition counts
(one number per partition) give the offsets, and the offsets are added back
as a literal array.  Every task sorts only its own range.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelwise.functions.hashing import hash_bucket, shuffle_key

_LOCAL_BITS = (1 << 33) - 1  # low bits of monotonically_increasing_id = row index in its partition


def seeded_shuffle(df: DataFrame, id_col: str = "row_id", seed: int = 42, epoch: int | str | Column | None = 0,
                   key: str = "shuffle_key") -> DataFrame:
    """Add the reproducible order key ``md5(seed ':' epoch ':' id)``."""
    ep = F.col(epoch) if isinstance(epoch, str) else epoch
    return df.withColumn(key, shuffle_key(id_col, seed, ep))


def global_rank(df: DataFrame, order: Sequence[str], rank_col: str = "rank", partitions: int | None = None,
                checkpoint: bool = False) -> DataFrame:
    """Exact 0-based position of every row in ``order`` (ties must not occur:
    end the order with a unique id).  Runs one small job for the counts.

    Without ``partitions`` the session's shuffle partition count is used:
    the ranked rows are pinned in the cache, and adaptive execution does not
    resize an exchange under a cached plan.  Callers that know the row count
    pass ``partitions`` (training sizes them from its counts).  Any count
    gives the same ranks: partitions are contiguous in key order.
    """
    ranged = df.repartitionByRange(partitions, *order) if partitions else df.repartitionByRange(*order)
    ranged = (ranged.sortWithinPartitions(*order)
              .withColumn("_pid", F.spark_partition_id())
              .withColumn("_local", F.monotonically_increasing_id().bitwiseAND(F.lit(_LOCAL_BITS))))
    # Numbering depends on the partition a row sits in: pin it before two jobs read it.
    ranged = ranged.checkpoint() if checkpoint else ranged.persist(StorageLevel.MEMORY_AND_DISK)
    counts = {r["_pid"]: r["n"] for r in ranged.groupBy("_pid").agg(F.count(F.lit(1)).alias("n")).collect()}
    offsets, run = [], 0
    for pid in range(max(counts, default=-1) + 1):
        offsets.append(run)
        run += counts.get(pid, 0)
    if not offsets:
        out = ranged.drop("_pid", "_local").withColumn(rank_col, F.lit(None).cast("bigint"))
    else:
        table = F.array(*[F.lit(o).cast("bigint") for o in offsets])
        out = ranged.withColumn(rank_col, F.element_at(table, F.col("_pid") + 1) + F.col("_local")).drop("_pid", "_local")
    out._labelwise_counts = [counts.get(pid, 0) for pid in range(len(offsets))]  # rows of every partition, in order of rank
    out._labelwise_pinned = ranged  # callers may release it with release()
    return out


def release(df: DataFrame) -> None:
    """Drop the cached intermediate behind a :func:`global_rank` result."""
    pinned = getattr(df, "_labelwise_pinned", None)
    if pinned is not None:
        pinned.unpersist()


def assign_batches(df: DataFrame, batch_size: int = 32, id_col: str = "row_id", seed: int = 42, epoch: int = 0,
                   batch_col: str = "batch_id", partitions: int | None = None) -> DataFrame:
    """Shuffle reproducibly and cut into batches of ``batch_size`` rows (the
    last one shorter).  Adds ``shuffle_key``, ``rank`` and ``batch_id``."""
    keyed = seeded_shuffle(df, id_col, seed, epoch)
    ranked = global_rank(keyed, ["shuffle_key", id_col], partitions=partitions)
    out = ranked.withColumn(batch_col, F.floor(F.col("rank") / F.lit(batch_size)).cast("bigint"))
    out._labelwise_counts, out._labelwise_pinned = ranked._labelwise_counts, ranked._labelwise_pinned
    return out


def batch_count(n_rows: Column | int, batch_size: int, epochs: int = 1) -> tuple[Column, Column]:
    """Batches per epoch ``ceil(N / n)`` and total steps over ``epochs``."""
    n = n_rows if isinstance(n_rows, Column) else F.lit(n_rows)
    per_epoch = F.ceil(n.cast("double") / F.lit(float(batch_size))).cast("bigint")
    return per_epoch, per_epoch * F.lit(epochs)


def n_batches(n_rows: int, batch_size: int) -> int:
    return math.ceil(n_rows / batch_size)


def train_test_tag(df: DataFrame, id_col: str, seed: int = 42, test_buckets: int = 2, buckets: int = 10,
                   split_col: str = "split") -> DataFrame:
    """``split`` = 'test' for the first ``test_buckets`` of ``buckets`` hash
    buckets of the participant id, else 'train'.  By participant, so no
    participant is on both sides."""
    b = hash_bucket(id_col, seed, buckets)
    return df.withColumn(split_col, F.when(b < test_buckets, F.lit("test")).otherwise(F.lit("train")))


def support_query_test(df: DataFrame, id_col: str, seed: int = 42, fractions=(6, 2, 2),
                       split_col: str = "part") -> DataFrame:
    """Three-way split by participant hash: 'support', 'query', 'test'.

    ``fractions`` are bucket counts out of their sum (default 6/2/2 of 10).
    """
    total = sum(fractions)
    b = hash_bucket(id_col, seed, total)
    return df.withColumn(split_col, F.when(b < fractions[0], F.lit("support"))
                         .when(b < fractions[0] + fractions[1], F.lit("query")).otherwise(F.lit("test")))


# --------------------------------------------------------------------------
# Epochs without a new sort
# --------------------------------------------------------------------------

#: Rounds of the permutation, and the steps by which a position outside the rows is walked back inside.
ROUNDS, WALKS = 6, 64


def permutation_keys(seed: int, epoch: int) -> list[int]:
    """Round keys: the first 28 bits of ``md5(seed ':' epoch ':' round)``."""
    return [int(hashlib.md5(f"{seed}:{epoch}:{r}".encode()).hexdigest()[:7], 16) for r in range(ROUNDS)]


def _mixed(v: Column, key: int) -> Column:
    first = ((v + F.lit(key)) * F.lit(1103515245).cast("bigint") + F.lit(12345)) % F.lit(2147483647).cast("bigint")
    return (first.bitwiseXOR(F.shiftright(first, 15)) * F.lit(48271).cast("bigint")) % F.lit(2147483647).cast("bigint")


def _grid(n: int) -> tuple[int, int]:
    """Sides of the smallest near-square grid with ``n`` cells; it has fewer than a row of cells too many."""
    a = math.isqrt(max(n - 1, 0)) + 1
    return a, max(1, -(-n // a))


def _round(left: Column, right: Column, r: int, key: int, a: int, b: int) -> tuple[Column, Column]:
    if r % 2 == 0:
        return (left + _mixed(right, key)) % F.lit(a), right
    return left, (right + _mixed(left, key)) % F.lit(b)


def permuted_position(df: DataFrame, n: int, seed: int = 42, epoch: int = 0, rank: str = "rank", out: str = "position") -> DataFrame:
    """Add the row's position in this epoch: a keyed permutation of ``0..n-1`` applied to its ``rank`` (which must be one of these).

    A Feistel network over a grid of a x b cells: rounds add a keyed hash of one coordinate to the other, so every round can be undone and
    the whole is a permutation of the grid; a rank that lands on one of the few cells beyond ``n`` goes on from there until it
    is inside (cycle walking), which keeps it a permutation of the rows.  Narrow: no row moves, whatever the epoch.  The rounds are
    projections in generated code; only the few walking rows (one in the square root of n) take an interpreted loop.
    """
    if n < 1:
        return df.withColumn(out, F.lit(None).cast("bigint"))
    a, b = _grid(n)
    keys = permutation_keys(seed, epoch)
    named = df.withColumns({"_left": F.floor(F.col(rank) / F.lit(b)).cast("bigint"), "_right": (F.col(rank) % F.lit(b)).cast("bigint")})
    for r, key in enumerate(keys):
        left, right = _round(F.col("_left"), F.col("_right"), r, key, a, b)
        named = named.withColumn("_left", left) if r % 2 == 0 else named.withColumn("_right", right)

    def again(position: Column) -> Column:
        left, right = F.floor(position / F.lit(b)).cast("bigint"), position % F.lit(b)
        for r, key in enumerate(keys):
            left, right = _round(left, right, r, key, a, b)
        return left * F.lit(b) + right

    landed = F.col("_left") * F.lit(b) + F.col("_right")
    walked = F.aggregate(F.sequence(F.lit(1), F.lit(WALKS)), landed, lambda p, _: F.when(p < n, p).otherwise(again(p)))
    named = named.withColumn(out, F.when(landed < n, landed).otherwise(walked)).drop("_left", "_right")
    # cells beyond n are fewer than a row of the grid; with up to WALKS of them the walk always ends, with more it fails once in (a) ** WALKS
    return named.withColumn(out, F.when(F.col(out) < n, F.col(out)).otherwise(F.raise_error(F.lit("a position was not walked back")).cast("bigint")))


def permuted_batches(ranked: DataFrame, n: int, batch_size: int = 32, seed: int = 42, epoch: int = 0, rank: str = "rank",
                     position: str = "position", batch_col: str = "batch_id") -> DataFrame:
    """Batches of an epoch of rows that were ranked once (:func:`global_rank`): another order each epoch, without another sort."""
    placed = permuted_position(ranked, n, seed, epoch, rank, position)
    return placed.withColumn(batch_col, F.floor(F.col(position) / F.lit(batch_size)).cast("bigint"))
