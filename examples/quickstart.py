"""End to end on the supplied tables: link, de-duplicate, encode, batch,
train two tasks together, evaluate and store the per-epoch report.

usage: python examples/quickstart.py [sf_dir] [results_dir]
"""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import functions as F  # noqa: E402

from labelwise.operators import encode, prep, sample, train  # noqa: E402
from labelwise.plans import fit  # noqa: E402
from labelwise.session import get_spark, scratch_path  # noqa: E402
from labelwise.sources import results, tables  # noqa: E402


def main(sf_dir: str = "/root/testdata/sf0.001", results_dir: str | None = None):
    spark = get_spark("local[*]")

    # 1. transcripts and labels, linked by the participant id in the file name
    transcripts = prep.with_id(tables.transcripts_from_conversations(tables.read_table(spark, sf_dir, "conversations")),
                               pattern=prep.WHOLE_ID_PATTERN, dtype="bigint")
    labels = tables.participant_labels(tables.read_table(spark, sf_dir, "labels"))
    linked = prep.link_labels(labels, transcripts)
    examples = prep.dedup_examples(prep.drop_columns(linked, ["index", "label", "label_notes", "audio_features"]))
    print("unlinked labels:", prep.unlinked_labels(labels, transcripts).count())

    # 2. fixed-length ids and masks for the matched rows
    # rows are unique per (participant, sentence) after de-duplication: a deterministic id
    matched = examples.where(F.col("sentence").isNotNull()).withColumn("row_id", F.xxhash64("Participant_ID", "sentence"))
    fixed, vocab = encode.encode_corpus(matched, size=5000, max_len=128, text="sentence", carry=["quality", "toxic"])
    print("encoded rows:", fixed.count(), "vocabulary:", vocab.count())

    # 3. reproducible batches of 32 for epoch 0
    batches = sample.assign_batches(fixed.select("row_id"), 32)
    print("batches:", batches.select("batch_id").distinct().count())

    # 4. two tasks on fixed text features of the labelled documents, train/test by participant hash
    docs = tables.text_examples(tables.read_table(spark, sf_dir, "documents"), tables.read_table(spark, sf_dir, "labels"))
    tagged = sample.train_test_tag(train.text_stat_features(docs), "row_id")
    cfg = fit.RunConfig(tasks=("quality", "toxic"), regime="MTL", epochs=3, lr=0.01)
    run = fit.fit_tagged(tagged, {"quality": "quality", "toxic": "toxic"}, cfg)
    run.report.select("epoch", "training_loss", "testing_loss", "F1_quality", "BA_quality", "AUC_toxic").show()

    # 5. append the report to a results table partitioned by model / data / question / regime
    path = results_dir or scratch_path(spark, "results")
    results.append_results(run.report, path)
    return results.read_results(spark, path)


if __name__ == "__main__":
    main(*sys.argv[1:])
