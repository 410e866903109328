"""A corpus pipeline over ``documents``: quality rules, near duplicates, benchmark leaks, personal data, encoding.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it as Parquet to the shared checkpoint
folder and reads it again as the next stage's docs.  All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelwise.llm import bpe, decontam, ngram_join, pii, quality
from labelwise.llm.common import read_table, written
from labelwise.llm.queries import bpe_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: documents that the label model rejects go."""
    return quality.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5 on shingles of five words and a similarity of 0.8: of every group of linked documents the one with the
    smallest doc_id stays."""
    return ngram_join.keep_one(docs, n=5, percent=80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: documents with a verbatim benchmark passage go."""
    return decontam.remove_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: personal data is replaced by its kind; n_chars follows the new text."""
    out = pii.redact_documents(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: token ids and round trip of what is left."""
    return bpe.token_digests(docs.select("doc_id", "text"), bpe_path())


STAGES = [("quality_rules", quality_rules), ("near_duplicates", near_duplicates), ("decontaminate", decontaminate), ("redact", redact),
          ("encode", encode)]

#: The near-duplicate, redaction and encoding stages have no SQL form; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
