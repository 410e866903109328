"""Per-epoch result tables: append, read back, combine runs.

Runs of different regimes report different columns (one task or two, with
or without a ``data`` column); they are combined by column name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The run columns that partition stored results.
PARTITION_COLUMNS = ("model", "data", "question", "training")


def append_results(df: DataFrame, path: str, fmt: str = "parquet") -> str:
    """Append report rows under ``path``.

    Parquet is partitioned by the run columns present.  A CSV file says its columns only in its own header, so reports
    with different columns go to different folders, named by a hash of the column list.
    """
    if fmt == "csv":
        name = hashlib.sha256(",".join(df.columns).encode()).hexdigest()[:16]
        df.write.mode("append").option("header", "true").csv(f"{path.rstrip('/')}/columns-{name}")
    else:
        parts = [c for c in PARTITION_COLUMNS if c in df.columns]
        df.write.mode("append").partitionBy(*parts).format(fmt).save(path)
    return path


#: Columns that name a run among the stored results.
RUN_KEY = (*PARTITION_COLUMNS, "run")


def replace_runs(df: DataFrame, path: str, key: Sequence[str] = RUN_KEY) -> str:
    """Store the report rows of whole runs so that doing it again changes nothing: rows of a run that is stored already are replaced.

    Parquet partitioned by ``key``, whose partitions are overwritten one by one (dynamic partition overwrite), so a retried job or a
    driver that starts over after a failure leaves every run once, and runs that are not in ``df`` stay as they are.  The files of a
    partition appear together when the job commits.  A missing key column is an error.
    """
    missing = [c for c in key if c not in df.columns]
    if missing:
        raise ValueError(f"reports without {missing} cannot be told apart by run")
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*key).parquet(path)
    return path


def read_results(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """All appended reports with all their columns; what a report lacks is NULL."""
    return spark.read.option("mergeSchema", "true").format(fmt).load(path)


def result_column_type(name: str) -> str:
    """Type of a report column, by the naming rule of the report."""
    if name.split("_")[0] in ("TP", "TN", "FP", "FN"):
        return "bigint"
    if name in ("epoch", "run", "batch_size"):
        return "int"
    if name.split("_")[0] in ("F1", "BA", "AUC") or name == "lr" or name.endswith("_loss"):
        return "double"
    return "string"


def read_results_csv(spark: SparkSession, path: str, types: dict[str, str] | None = None) -> DataFrame:
    """Read appended CSV reports: every column set by its own header, combined by name.

    A file appended to repeatedly with a header each time holds header lines
    in the middle; those rows are dropped (first column equal to its own
    name) and the remaining strings are cast with ``try_cast``, so a bad cell
    becomes NULL rather than failing the read.
    """
    return union_results([_read_columns(spark, p, types or {}) for p in _column_folders(spark, path)])


def _column_folders(spark: SparkSession, path: str) -> list[str]:
    """The folders of the column sets under ``path``; ``path`` itself where it holds files of one column set."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = where.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(where)
    folders = sorted(str(f.getPath().toString()) for f in found if f.isDirectory() and f.getPath().getName().startswith("columns-"))
    return folders or [path]


def _read_columns(spark: SparkSession, path: str, types: dict[str, str]) -> DataFrame:
    raw = spark.read.option("header", "true").option("inferSchema", "false").csv(path)
    first = raw.columns[0]
    raw = raw.where(F.col(first).isNull() | (F.col(first) != F.lit(first)))
    return raw.select(*[F.col(f"`{c}`").try_cast(types.get(c, result_column_type(c))).alias(c) for c in raw.columns])


def union_results(frames: Sequence[DataFrame]) -> DataFrame:
    """Stack reports whose columns differ; missing columns become NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def append_runs(frames: Sequence[DataFrame]) -> DataFrame:
    """Bag union of runs with the same columns (no de-duplication)."""
    return reduce(lambda a, b: a.unionByName(b), frames)
