"""Preparing examples: participant ids, linking labels to transcripts,
dropping and choosing columns, removing duplicate rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelwise.functions.text import ID_PATTERN, extract_id

KEY = "Participant_ID"
#: Pattern for names that begin with the whole id; the default takes the first three digits, as short file names have them.
WHOLE_ID_PATTERN = "^[0-9]+"


def with_id(transcripts: DataFrame, name_col: str = "audio_features", key: str = KEY,
            pattern: str = ID_PATTERN, mode: str = "strict", dtype: str = "int") -> DataFrame:
    """Add the participant id parsed from the file-name column.

    The default pattern takes three digits; names with longer ids need ``WHOLE_ID_PATTERN`` and ``dtype="bigint"``,
    or ids of 1000 and more would be cut and mislinked.
    """
    return transcripts.withColumn(key, extract_id(name_col, pattern, mode, dtype))


def drop_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Drop named columns; an unknown name is an error (Spark's ``drop``
    would ignore it silently)."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"cannot drop unknown columns {missing}; have {df.columns}")
    return df.drop(*names)


def project_text_label(df: DataFrame, label: str, text: str = "sentence") -> DataFrame:
    """Keep the text and one task's label column (the task is a parameter)."""
    return df.select(F.col(text), F.col(label))


def link_labels_matched(labels: DataFrame, transcripts: DataFrame, key: str = KEY) -> DataFrame:
    """Labels with each of their transcript rows (inner equi-join)."""
    return labels.join(transcripts, key, "inner")


def unlinked_labels(labels: DataFrame, transcripts: DataFrame, key: str = KEY) -> DataFrame:
    """Labels with no transcript row at all.

    The right side is reduced to its distinct keys first (map-side combined),
    so the anti join ships ids, never transcript text.
    """
    ids = transcripts.select(key).where(F.col(key).isNotNull()).distinct()
    return labels.join(ids, key, "left_anti")


def link_labels(labels: DataFrame, transcripts: DataFrame, key: str = KEY) -> DataFrame:
    """Left join of labels to transcripts: one row per matching transcript
    row, and the label alone (NULL transcript columns) when none matches.

    Written as inner join + anti join.  Spark cannot broadcast the preserved
    side of an outer join, and AQE can split a skewed key only on the
    non-preserved side, so a hot participant holding a third of all
    transcript rows would land in one task.  The inner join lets Spark
    broadcast whichever side is small (or split skew on both sides), the
    anti join touches only distinct ids, and the union gives exactly the
    rows of the left join.
    """
    matched = link_labels_matched(labels, transcripts, key)
    rest = unlinked_labels(labels, transcripts, key)
    return matched.unionByName(rest, allowMissingColumns=True)


def dedup_examples(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Drop rows equal in every column (NULLs compare equal).

    Duplicates of a hot row are merged map-side before the shuffle, so a
    row repeated a third of the time never reaches one task in full.
    """
    return df.dropDuplicates(list(columns)) if columns else df.dropDuplicates()
