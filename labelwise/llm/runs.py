"""Running sums along ordered groups of rows, whatever the size of a group.

A window over a group would put the whole group into one task.  Here the rows are range-partitioned by group and order, so
that a large group takes many partitions.  Every partition sums what it holds, and the totals of those few groups that lie
in more than one partition are added from the partitions before.  What reaches the driver is at most two rows a partition.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelwise.llm.common import written


def changes(column: pa.Array, before: pa.Scalar | None) -> np.ndarray:
    """True where a value differs from the one above it (null equals null); ``before`` is the value above the first, None: no row."""
    n = len(column)
    out = np.ones(n, bool)
    if n == 0:
        return out
    if n > 1:
        a, b = column.slice(0, n - 1), column.slice(1)
        differ = pc.fill_null(pc.not_equal(a, b), False).to_numpy(zero_copy_only=False)
        out[1:] = differ | (pc.is_null(a).to_numpy(zero_copy_only=False) != pc.is_null(b).to_numpy(zero_copy_only=False))
    if before is not None:
        out[0] = column[0].as_py() != before.as_py()
    return out


def running(df: DataFrame, key: str, order: list[str], sums: list[str], parts: int | None = None, name: str = "runs") -> DataFrame:
    """``df`` with row_no (0-based place in its group) and, for every long column c of ``sums``, run_c: the sum of c over the
    group's rows up to and with this one, modulo 2**64.  Groups are rows of one ``key`` (null is one); ``order`` (nulls
    first) orders them.  The result is a written table.  No columns of df may be called row_no, part_no, edge_no or run_*."""
    spark = df.sparkSession
    made = ["row_no", *[f"run_{c}" for c in sums]]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + "".join(f", {m} bigint" for m in made) + ", part_no int, edge_no int"
    by = [key, *order]

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        last_key, state, first_group, waiting = None, np.zeros(1 + len(sums), np.uint64), True, None

        def emit(batch, edge_row, edge):
            marks = np.zeros(batch.num_rows, np.int32)
            if edge_row is not None:
                marks[edge_row] = edge
            return pa.RecordBatch.from_arrays([*batch.columns, pa.array(marks)], names=[*batch.schema.names, "edge_no"])

        for batch in batches:
            n = batch.num_rows
            if n == 0:
                continue
            column = batch.column(batch.schema.get_field_index(key))
            new = changes(column, last_key)
            values = np.ones((1 + len(sums), n), np.uint64)
            for k, c in enumerate(sums, 1):
                values[k] = pc.fill_null(batch.column(batch.schema.get_field_index(c)), 0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            with np.errstate(over="ignore"):
                acc = np.cumsum(values, axis=1, dtype=np.uint64)
                starts = np.flatnonzero(new)
                group = np.cumsum(new)  # 0: goes on from the batch before
                base = np.concatenate([(np.zeros(len(state), np.uint64) - state)[:, None], (acc - values)[:, starts]], axis=1)
                acc = acc - base[:, group]
                state = acc[:, -1].copy()
                acc[0] -= np.uint64(1)
            here = pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(a.view(np.int64)) for a in acc], pa.array(np.full(n, part, np.int32))],
                                              names=[*batch.schema.names, *made, "part_no"])
            # the last row of the partition's first group and of its last one are its edges
            if waiting is not None:
                yield emit(waiting, waiting.num_rows - 1 if first_group and new[0] else None, 1)
                first_group = first_group and not new[0]
            waiting, last_key = here, column[n - 1]
            ends = starts[starts > 0]
            if first_group and len(ends):
                row = int(ends[0]) - 1
                yield emit(here.slice(0, row + 1), row, 1)
                waiting, first_group = here.slice(row + 1), False
        if waiting is not None:
            yield emit(waiting, waiting.num_rows - 1, 2)

    dealt = df.repartitionByRange(*([parts] if parts else []), *[F.col(f"`{c}`").asc_nulls_first() for c in by])
    table = written(dealt.sortWithinPartitions(*[F.col(f"`{c}`").asc_nulls_first() for c in by]).mapInArrow(scan, schema), name)
    edges = table.where("edge_no > 0").select("part_no", F.col(f"`{key}`").alias("k"), *made).orderBy("part_no", "edge_no", "row_no").collect()
    carried: list[tuple] = []
    held, total, seen = None, [0] * len(made), -1
    for e in edges:
        if seen >= 0 and e.k == held and e.part_no != seen:  # the group goes on in this partition
            carried.append((e.k, e.part_no, *[t - (1 << 64) if t >= 1 << 63 else t for t in total]))
        elif seen < 0 or e.k != held:
            total = [0] * len(made)
        total = [(t + e[m] + (m == "row_no")) % (1 << 64) for t, m in zip(total, made)]
        held, seen = e.k, e.part_no
    plain = [f"`{f.name}`" for f in df.schema] + made
    if not carried:
        return table.select(*plain)
    key_type = df.schema[key].dataType.simpleString()
    offsets = spark.createDataFrame(carried, f"k_off {key_type}, part_off int, " + ", ".join(f"off_{m} bigint" for m in made))
    wide = table.join(F.broadcast(offsets), (F.col("part_no") == F.col("part_off")) & F.col(f"`{key}`").eqNullSafe(F.col("k_off")), "left")
    add = [F.expr(f"CAST(((CAST({m} AS decimal(38,0)) + coalesce(off_{m}, 0) + 9223372036854775808) % 18446744073709551616 + 18446744073709551616)"
                  f" % 18446744073709551616 - 9223372036854775808 AS bigint)").alias(m) if m != "row_no" else
           F.expr("row_no + coalesce(off_row_no, 0)").alias(m) for m in made]
    return wide.select(*[f"`{f.name}`" for f in df.schema], *add)
