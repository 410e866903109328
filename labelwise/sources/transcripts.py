"""Transcript and label files, and the question/split partitioned layout."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from labelwise.sources.tables import TRANSCRIPT_SCHEMA

# Cells pandas reads as missing by default (the reference's
# reader); only used when ``na_words=True`` asks for that behaviour.
PANDAS_NA_WORDS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
                   "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]


def scan_transcripts(spark: SparkSession, path: str, quote: str = "", na_words: bool = False) -> DataFrame:
    """Headerless tab-separated transcripts with the five fixed columns.

    ``quote=''`` (default) turns quoting off: speech text holds stray double
    quotes that would otherwise swallow the tab.  ``na_words=True`` nulls the
    sentence when it is one of the words pandas reads as missing.
    """
    reader = spark.read.option("sep", "\t").option("header", "false").option("mode", "PERMISSIVE")
    reader = reader.option("quote", quote if quote else "\u0000")
    df = reader.schema(TRANSCRIPT_SCHEMA).csv(path)
    if na_words:
        df = df.withColumn("sentence", F.when(F.col("sentence").isin(PANDAS_NA_WORDS), F.lit(None))
                           .otherwise(F.col("sentence")))
    return df


#: Column of :func:`scan_checked` that holds a line which does not fit the schema.
CORRUPT = "_corrupt_record"


def scan_checked(spark: SparkSession, path: str, schema: str | StructType = TRANSCRIPT_SCHEMA, sep: str = "\t", header: bool = False, quote: str = "",
                 required: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(good, bad) rows of delimited files: nothing that does not fit becomes null unseen.

    ``bad`` has the whole line (``line``), its file (``file``) and a ``reason``: ``malformed`` (a value of another type, too few or too many
    fields) or ``missing`` (a field of ``required`` is empty).  ``good`` has the columns of ``schema``.  Every line is in exactly one of them.
    Lines are read in full: a fault in a column that a query does not use counts as well.
    """
    fields = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    if CORRUPT in fields.names:
        raise ValueError(f"{CORRUPT} is the reader's own column")
    unknown = [c for c in required if c not in fields.names]
    if unknown:
        raise ValueError(f"unknown required columns {unknown}")
    reader = spark.read.option("sep", sep).option("header", str(header).lower()).option("mode", "PERMISSIVE").option("columnPruning", "false")
    reader = reader.option("columnNameOfCorruptRecord", CORRUPT).option("quote", quote if quote else "\u0000")
    if header:
        reader = reader.option("enforceSchema", "false")
    rows = reader.schema(StructType([*fields, StructField(CORRUPT, StringType())])).csv(path).withColumn("_file", F.input_file_name())

    def given(c: str):
        # a plain null test would be handed to the reader, which then applies it before it has judged the line
        return F.coalesce(F.length(F.col(f"`{c}`").cast("string")), F.lit(-1)) >= 0

    empty = F.lit(False)
    for c in required:
        empty = empty | ~given(c)
    # the reader converts only columns that are used: the test of a line uses all of them (any number modulo 1 is 0)
    used = F.pmod(F.hash(*[f"`{c}`" for c in fields.names]), F.lit(1))
    malformed = F.coalesce(F.length(CORRUPT), F.lit(-1)) + used >= 0
    reason = F.when(malformed, F.lit("malformed")).when(empty, F.lit("missing"))
    told = rows.withColumn("_reason", reason)
    good = told.where("_reason IS NULL").select(*[f"`{c}`" for c in fields.names])
    whole = F.coalesce(F.col(CORRUPT), F.concat_ws(sep, *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in fields.names]))
    bad = told.where("_reason IS NOT NULL").select(whole.alias("line"), F.col("_file").alias("file"), F.col("_reason").alias("reason"))
    return good, bad


def quarantine(bad: DataFrame, path: str, limit: float | None = None, good: DataFrame | None = None) -> str:
    """Store the bad rows of a scan under ``path/reason=…``.  With ``limit`` and ``good``, a share of bad rows above it is an error,
    raised after they are stored."""
    bad.write.mode("append").partitionBy("reason").parquet(path)
    if limit is not None and good is not None:
        n_bad, n_good = bad.count(), good.count()
        if n_bad > limit * (n_bad + n_good):
            raise ValueError(f"{n_bad} of {n_bad + n_good} rows are bad, above the limit of {limit}; they are stored under {path}")
    return path


def scan_labels(spark: SparkSession, path: str, schema: str | StructType | None = None) -> DataFrame:
    """Header CSV of labels.  Pass ``schema`` (DDL or StructType) to type the
    columns; without it every column is read as a string (no inference pass
    over the data)."""
    reader = spark.read.option("header", "true")
    if schema is not None:
        reader = reader.schema(schema).option("enforceSchema", "false")
    return reader.csv(path)


def write_question_split(df: DataFrame, root: str, mode: str = "overwrite") -> str:
    """Store examples under ``root/question=…/split=…`` (parquet)."""
    df.write.mode(mode).partitionBy("question", "split").parquet(root)
    return root


def select_question_split(spark: SparkSession, root: str, question: str, split: str) -> DataFrame:
    """Read one question and one split; the filter prunes directories."""
    return spark.read.parquet(root).where((F.col("question") == question) & (F.col("split") == split))


def split_counts(df: DataFrame, keys=("question", "split")) -> DataFrame:
    """Rows per split (and question)."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"))
