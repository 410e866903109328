"""Edge cases on tiny frames (FIXTURES section 3)."""

import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from labelwise.functions import arrays as A
from labelwise.functions.text import extract_id
from labelwise.operators import evaluate as ev
from labelwise.operators import prep
from labelwise.operators import sample as smp
from labelwise.operators import train as tr
from labelwise.sources import results as rs
from labelwise.sources import transcripts as trs


def test_extract_id_null_mode(spark):
    df = spark.createDataFrame([("300_AUDIO.npy",), ("x12345.wav",), ("none",), (None,)], "name string")
    got = [r[0] for r in df.select(extract_id("name", mode="null")).collect()]
    assert got == [300, 123, None, None]


def test_extract_id_strict_raises(spark):
    df = spark.createDataFrame([("none",)], "name string")
    with pytest.raises(Exception):
        df.select(extract_id("name")).collect()
    ok = spark.createDataFrame([("300_AUDIO.npy",), (None,)], "name string")
    assert [r[0] for r in ok.select(extract_id("name")).collect()] == [300, None]


def test_scan_transcripts_unbalanced_quote(spark, tmp_dir):
    path = os.path.join(tmp_dir, "train.tsv")
    with open(path, "w") as f:
        f.write('0\t1\tnote\tshe said "hello and left\t300_AUDIO.wav\n')
        f.write("1\t0\tnote\tplain answer\t301_AUDIO.wav\n")
    rows = trs.scan_transcripts(spark, path).collect()
    assert len(rows) == 2
    assert rows[0]["sentence"] == 'she said "hello and left'
    assert rows[0]["audio_features"] == "300_AUDIO.wav"
    assert rows[1]["index"] == 1


def test_scan_transcripts_na_words(spark, tmp_dir):
    path = os.path.join(tmp_dir, "t.tsv")
    with open(path, "w") as f:
        f.write("0\t1\tn\tNA\t300_A.wav\n1\t1\tn\tfine\t300_A.wav\n")
    assert trs.scan_transcripts(spark, path).where("sentence IS NULL").count() == 0
    assert trs.scan_transcripts(spark, path, na_words=True).where("sentence IS NULL").count() == 1


def test_scan_labels_schema(spark, tmp_dir):
    path = os.path.join(tmp_dir, "labels.csv")
    with open(path, "w") as f:
        f.write("Participant_ID,task_a\n300,1\n301,0\n")
    df = trs.scan_labels(spark, path, "Participant_ID INT, task_a INT")
    assert df.collect()[1]["task_a"] == 0
    assert dict(df.dtypes)["Participant_ID"] == "int"


def test_link_labels_left_semantics(spark):
    labels = spark.createDataFrame([(1, 1), (2, 0)], "Participant_ID int, y int")
    tr_ = spark.createDataFrame([(1, "a"), (1, "b"), (3, "c")], "Participant_ID int, sentence string")
    got = sorted((r["Participant_ID"], r["sentence"]) for r in prep.link_labels(labels, tr_).collect())
    assert got == [(1, "a"), (1, "b"), (2, None)]
    assert prep.unlinked_labels(labels, tr_).count() == 1
    assert prep.link_labels_matched(labels, tr_).count() == 2


def test_dedup_nulls_equal(spark):
    df = spark.createDataFrame([(1, None), (1, None), (1, "a")], "id int, s string")
    assert prep.dedup_examples(df).count() == 2


def test_drop_unknown_column(spark):
    df = spark.createDataFrame([(1, "a")], "id int, s string")
    with pytest.raises(ValueError):
        prep.drop_columns(df, ["nope"])
    assert prep.drop_columns(df, ["s"]).columns == ["id"]


def test_pad_truncate_and_mask(spark):
    df = spark.createDataFrame([([1, 2],), ([1, 2, 3, 4, 5, 6],), ([],)], "a array<int>")
    got = [r[0] for r in df.select(A.pad_truncate("a", 4)).collect()]
    assert got == [[1, 2, 0, 0], [1, 2, 3, 4], [0, 0, 0, 0]]
    m = spark.createDataFrame([([5, 0, 7, 0],)], "a array<int>").select(A.attention_mask("a")).first()[0]
    assert m == [1, 0, 1, 0]


def test_argmax_ties_lowest(spark):
    assert spark.createDataFrame([([1.0, 3.0, 3.0],)], "a array<double>").select(A.argmax("a")).first()[0] == 1


def _long(spark, truth, pred, task="t"):
    return spark.createDataFrame([(i, task, y, p) for i, (y, p) in enumerate(zip(truth, pred))],
                                 "row_id int, task string, y int, pred int")


def test_confusion_and_metrics(spark):
    df = _long(spark, [1, 1, 0, 0, 0, 1], [1, 0, 0, 0, 1, 1])
    r = ev.multi_task_eval(df).first()
    assert (r["TP"], r["TN"], r["FP"], r["FN"]) == (2, 2, 1, 1)
    for k in ("F1", "BA", "AUC"):
        assert r[k] == pytest.approx(2 / 3)


def test_f1_without_positives_is_zero(spark):
    r = ev.multi_task_eval(_long(spark, [0, 0, 0], [0, 0, 0])).first()
    assert r["F1"] == 0.0


def test_auc_one_class_is_null(spark):
    r = ev.multi_task_eval(_long(spark, [1, 1, 1], [1, 0, 1])).first()
    assert r["AUC"] is None
    assert r["BA"] == pytest.approx(2 / 3)


def test_auc_score_ties(spark):
    df = spark.createDataFrame([("t", 1, 0.5), ("t", 0, 0.5), ("t", 1, 0.9), ("t", 0, 0.1)],
                               "task string, y int, score double")
    # pairs (pos, neg): (0.5,0.5)=0.5, (0.5,0.1)=1, (0.9,0.5)=1, (0.9,0.1)=1 -> 3.5/4
    assert ev.auc_score(df).first()["AUC"] == pytest.approx(3.5 / 4)
    assert ev.auc_score(df, partitions=1).first()["AUC"] == pytest.approx(3.5 / 4)


def test_assign_batches_sizes(spark):
    df = spark.range(70).withColumnRenamed("id", "row_id")
    b = smp.assign_batches(df, 32)
    sizes = sorted((r["batch_id"], r["count"]) for r in b.groupBy("batch_id").count().collect())
    assert [s for _, s in sizes] == [32, 32, 6]
    ranks = sorted(r["rank"] for r in b.select("rank").collect())
    assert ranks == list(range(70))


def test_read_results_csv_repeated_header(spark, tmp_dir):
    path = os.path.join(tmp_dir, "res.csv")
    one = "model,epoch,F1_a,TP_a\nm,0,0.5,3\n"
    with open(path, "w") as f:
        f.write(one + one)  # appended twice, header written each time
    df = rs.read_results_csv(spark, path)
    rows = df.collect()
    assert len(rows) == 2
    assert dict(df.dtypes) == {"model": "string", "epoch": "int", "F1_a": "double", "TP_a": "bigint"}
    assert rows[0]["F1_a"] == 0.5


def test_union_results_by_name(spark):
    a = spark.createDataFrame([(0, 1)], "epoch int, TP_a bigint")
    b = spark.createDataFrame([(0, 2, "d")], "epoch int, TP_b bigint, data string")
    u = rs.union_results([a, b])
    assert u.count() == 2 and set(u.columns) == {"epoch", "TP_a", "TP_b", "data"}


def test_min_norm_equal_is_half():
    assert tr.min_norm_weights(1.0, 1.0, 1.0) == (0.5, 0.5)
    g, _ = tr.min_norm_weights(1.0, 0.0, 0.0)
    assert g == 0.0


def test_clip_norm(spark):
    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.5],)], "v array<double>")
    got = [r[0] for r in df.select(A.clip_norm("v", 1.0)).collect()]
    assert math.sqrt(sum(x * x for x in got[0])) < 1.0
    assert math.sqrt(sum(x * x for x in got[0])) == pytest.approx(1.0, abs=1e-5)
    assert got[1] == [0.0, 0.5]


def test_grad_difference_faithful(spark):
    from labelwise.operators.linalg import grad_difference
    df = spark.createDataFrame([("a", 0, s, v) for s, v in enumerate([1.0, 3.0, 6.0])],
                               "task string, pos int, step int, value double")
    all_steps = [r["value"] for r in grad_difference(df).orderBy("step").collect()]
    assert all_steps == [1.0, 2.0, 3.0]
    faithful = [r["value"] for r in grad_difference(df, faithful=True).orderBy("step").collect()]
    assert faithful == [1.0, 2.0, 6.0]


def test_softmax_rows_sum_to_one(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0],), ([1000.0, 1000.0, -5.0],)], "z array<double>")
    for r in df.select(A.softmax("z")).collect():
        assert sum(r[0]) == pytest.approx(1.0)


def test_cross_entropy_matches_numpy(spark):
    z = [0.3, -1.2]
    got = spark.createDataFrame([(z, 1)], "z array<double>, y int").select(A.cross_entropy("z", "y")).first()[0]
    expect = np.log(np.exp(z).sum()) - z[1]
    assert got == pytest.approx(expect)


def test_attention_pool_mask(spark):
    from labelwise.operators.linalg import attention_pool
    df = spark.createDataFrame([(0, 0, [1.0, 0.0], 1), (0, 1, [0.0, 1.0], 1), (0, 2, [9.0, 9.0], 0)],
                               "seq_id int, pos int, vec array<double>, m int")
    masked = attention_pool(df, vec="vec", mask="m").first()["pooled"]
    e = np.exp([1.0, 0.0])
    w = e / e.sum()
    assert masked == pytest.approx([w[0], w[1]])
    unmasked = attention_pool(df, vec="vec").first()["pooled"]
    assert unmasked[0] > 8.0  # the padded position dominates without a mask


def test_gradient_rejects_ragged_features(spark):
    heads = {"t": tr.Head(np.zeros((2, 2)), np.zeros(2))}
    df = spark.createDataFrame([([1.0, 2.0], 0), ([1.0], 1)], "x array<double>, y int")
    with pytest.raises(Exception, match="every feature array"):
        tr.batch_gradient(df.coalesce(1), heads, {"t": "y"}, "x")


def test_auc_score_join_fallback_matches_literal_cuts(spark):
    rows = [("t", i % 2, float(i % 7)) for i in range(200)] + [("u", (i // 3) % 2, float(i % 5)) for i in range(90)]
    df = spark.createDataFrame(rows, "task string, y int, score double")
    lit_cuts = {r["task"]: r["AUC"] for r in ev.auc_score(df, partitions=8).collect()}
    one = {r["task"]: r["AUC"] for r in ev.auc_score(df, partitions=1).collect()}
    assert lit_cuts == pytest.approx(one)
    # brute force over pairs
    for task in ("t", "u"):
        pos = [s for t, y, s in rows if t == task and y == 1]
        neg = [s for t, y, s in rows if t == task and y == 0]
        brute = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
        assert lit_cuts[task] == pytest.approx(brute)
