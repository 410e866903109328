"""Labels and transcripts stored side by side, so that linking them moves no transcript.

Both tables are bucketed and sorted by (key, part).  ``part`` is 0 but for keys with many rows: theirs are dealt over several parts, and
their label stands once in each, so that no bucket, and so no task of a later link, holds a key's whole third of the table.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelwise.operators.prep import KEY
from labelwise.session import scratch_path

PART = "part_no"


@dataclass
class Colocated:
    """Names of the two stored tables, and what they are bucketed by."""

    spark: SparkSession
    labels_table: str
    transcripts_table: str
    key: str

    @property
    def labels(self) -> DataFrame:
        return self.spark.table(self.labels_table)

    @property
    def transcripts(self) -> DataFrame:
        return self.spark.table(self.transcripts_table)

    def drop(self) -> None:
        """Forget the tables (their files stay where they were written)."""
        for t in (self.labels_table, self.transcripts_table):
            self.spark.sql(f"DROP TABLE IF EXISTS {t}")


def colocate(labels: DataFrame, transcripts: DataFrame, key: str = KEY, buckets: int = 200, rows_per_part: int = 1_000_000,
             path: str | None = None, name: str | None = None) -> Colocated:
    """Write both tables, once, for any number of links.

    A key of more than ``rows_per_part`` transcript rows is dealt over as many parts as it needs.  Such keys are few: at most the rows of
    the table over ``rows_per_part``; their (key, parts) list is joined, never collected.  Rows without a key are kept, and link with nothing.
    """
    for df in (labels, transcripts):
        if PART in df.columns:
            raise ValueError(f"{PART} is this layout's own column")
    spark = labels.sparkSession
    base = (path or scratch_path(spark, "colocated")).rstrip("/")
    name = name or f"colocated_{uuid.uuid4().hex[:12]}"
    counts = transcripts.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_key")).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > rows_per_part)
    large = counts.select("_key", F.ceil(F.col("_n") / rows_per_part).cast("int").alias("_parts"))

    def with_parts(df: DataFrame) -> DataFrame:
        return df.join(large, F.col(key) == F.col("_key"), "left").drop("_key").withColumn("_parts", F.coalesce("_parts", F.lit(1)))

    dealt = with_parts(transcripts).withColumn(PART, F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.col("_parts").cast("bigint")).cast("int"))
    dealt = dealt.drop("_parts")
    copied = with_parts(labels).withColumn(PART, F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).drop("_parts")
    tables = {"labels": copied, "transcripts": dealt}
    for kind, df in tables.items():
        # one file per bucket: rows are brought to their bucket before writing
        df.repartition(buckets, key, PART).write.mode("overwrite").format("parquet").option("path", f"{base}/{kind}").bucketBy(buckets, key, PART).sortBy(
            key, PART).saveAsTable(f"{name}_{kind}")
    return Colocated(spark, f"{name}_labels", f"{name}_transcripts", key)


def linked(tables: Colocated) -> DataFrame:
    """The left join of labels to transcripts (see ``prep.link_labels``) from stored tables: no row of either moves."""
    key = tables.key
    matched = tables.labels.join(tables.transcripts, [key, PART]).drop(PART)
    return matched.unionByName(unlinked(tables), allowMissingColumns=True)


def matched(tables: Colocated) -> DataFrame:
    return tables.labels.join(tables.transcripts, [tables.key, PART]).drop(PART)


def unlinked(tables: Colocated) -> DataFrame:
    """Labels without a transcript.  A key with several parts has transcripts, so only part 0 of the others has to be looked at."""
    key = tables.key
    several = tables.labels.where(F.col(PART) == 1).select(key).distinct()
    single = tables.labels.where(F.col(PART) == 0).join(tables.transcripts.select(key, PART), [key, PART], "left_anti")
    # a part that no row was dealt to says nothing about its key
    return single.join(several, key, "left_anti").drop(PART)
