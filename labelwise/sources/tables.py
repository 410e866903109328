"""Reading the supplied parquet tables and presenting them in the roles the
library works with (transcripts, labels, text examples, fixed features)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The five transcript columns, in file order.
TRANSCRIPT_COLUMNS = ["index", "label", "label_notes", "sentence", "audio_features"]
TRANSCRIPT_SCHEMA = "index INT, label INT, label_notes STRING, sentence STRING, audio_features STRING"
# Name pattern used when a table row stands in for a transcript file.
TRANSCRIPT_NAME_FORMAT = "%03d_TRANSCRIPT.csv"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def transcripts_from_conversations(conversations: DataFrame) -> DataFrame:
    """Conversation turns in the transcript layout.

    One row per turn: ``index`` = turn number, ``label`` unknown,
    ``label_notes`` = role, ``sentence`` = text and the participant encoded
    in a file name, as in the interview layout.
    """
    return conversations.select(
        F.col("turn").cast("int").alias("index"),
        F.lit(None).cast("int").alias("label"),
        F.col("role").alias("label_notes"),
        F.col("text").alias("sentence"),
        F.format_string(TRANSCRIPT_NAME_FORMAT, F.col("conv_id")).alias("audio_features"),
    )


def speaker_turns(transcripts: DataFrame, role: str) -> DataFrame:
    """The turns of one speaker role."""
    return transcripts.where(F.col("label_notes") == F.lit(role))


def participant_labels(labels: DataFrame, key: str = "doc_id") -> DataFrame:
    """The two-task label table keyed by participant."""
    return labels.select(F.col(key).cast("bigint").alias("Participant_ID"), "quality", "toxic")


def text_examples(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Labelled texts: one row per labelled document, ``row_id`` = doc id.

    ``documents`` keys are unique and ``labels`` is a subset of them, so this
    is an inner equi-join; Spark picks broadcast or shuffle from sizes.
    """
    docs = documents.select(F.col("doc_id").alias("row_id"), "text", "n_chars", "lang")
    return labels.select(F.col("doc_id").alias("row_id"), "quality", "toxic").join(docs, "row_id")


def embedding_examples(embeddings: DataFrame) -> DataFrame:
    """Fixed encoder output with two derived binary tasks.

    task ``a`` = label is odd, task ``b`` = label >= 5.
    """
    return embeddings.select(
        F.col("vec_id").alias("row_id"),
        F.col("embedding").alias("x"),
        (F.col("label") % 2).cast("int").alias("a"),
        (F.col("label") >= 5).cast("int").alias("b"),
        "label",
    )


def stand_in_predictions(examples: DataFrame) -> DataFrame:
    """Deterministic rule predictions for two tasks, in long form.

    quality: ``n_chars >= 500``; toxic: the lower-cased text mentions
    ``worthless`` or ``stupid``.  Rows: (row_id, task, y, pred, score).
    """
    text = F.lower(F.col("text"))
    rule_b = (F.instr(text, "worthless") > 0) | (F.instr(text, "stupid") > 0)
    return examples.select(
        "row_id",
        F.inline(F.array(
            F.struct(F.lit("quality").alias("task"), F.col("quality").alias("y"),
                     (F.col("n_chars") >= 500).cast("int").alias("pred"),
                     F.col("n_chars").cast("double").alias("score")),
            F.struct(F.lit("toxic").alias("task"), F.col("toxic").alias("y"),
                     rule_b.cast("int").alias("pred"),
                     F.col("n_chars").cast("double").alias("score")),
        )),
    )
