"""Cases that clean fixtures do not hold: missing and bad labels, mixed reports, null keys, long ids, repeated ids."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from labelwise.operators import encode as enc
from labelwise.operators import evaluate as ev
from labelwise.operators import linalg as la
from labelwise.operators import prep
from labelwise.operators import train as tr
from labelwise.session import ensure_checkpoint_dir
from labelwise.sources import results as rs
from labelwise.sources import tables as tb

HEADS = {"a": tr.Head(np.array([[0.1, -0.2], [0.3, 0.4]]), np.array([0.0, 0.1])), "b": tr.Head(np.array([[0.2, 0.1], [-0.3, 0.2]]), np.zeros(2))}
LABELS = {"a": "a", "b": "b"}


def _rows(spark, rows):
    return spark.createDataFrame(rows, "row_id long, x array<double>, a int, b int")


@pytest.mark.parametrize("method", ["arrow", "explode"])
def test_a_missing_label_costs_only_its_own_task(spark, method):
    rows = [(1, [1.0, 2.0], 1, None), (2, [0.5, -1.0], 0, 1), (3, [2.0, 0.0], None, 0), (4, [1.0, 1.0], None, None)]
    both = tr.batch_gradient(_rows(spark, rows), HEADS, LABELS, method=method)
    assert both.counts == {"a": 2.0, "b": 2.0}
    for t, keep in (("a", rows[:2]), ("b", rows[1:3])):
        alone = tr.batch_gradient(_rows(spark, keep), {t: HEADS[t]}, {t: t}, method=method)
        assert both.loss[t] == pytest.approx(alone.loss[t]) and np.allclose(both.grads[t], alone.grads[t])


@pytest.mark.parametrize("method", ["arrow", "explode"])
@pytest.mark.parametrize("bad", [-1, 2])
def test_a_label_outside_the_classes_is_an_error(spark, method, bad):
    with pytest.raises(Exception, match="outside 0..1"):
        tr.batch_gradient(_rows(spark, [(1, [1.0, 2.0], bad, 0)]), HEADS, LABELS, method=method)


@pytest.mark.parametrize("fmt", ["parquet", "csv"])
def test_mixed_reports_keep_columns_and_values(spark, tmp_dir, fmt):
    one = spark.createDataFrame([(0, 0.5, "STL")], "epoch int, F1_toxic double, training string")
    two = spark.createDataFrame([(1, 0.25, 0.75, "MTL")], "epoch int, F1_quality double, F1_toxic double, training string")
    path = f"{tmp_dir}/{fmt}"
    for rep in (two, one, two):
        rs.append_results(rep, path, fmt)
    back = rs.read_results_csv(spark, path) if fmt == "csv" else rs.read_results(spark, path)
    got = sorted((r["epoch"], r["F1_quality"], r["F1_toxic"], r["training"]) for r in back.collect())
    assert got == [(0, None, 0.5, "STL"), (1, 0.25, 0.75, "MTL"), (1, 0.25, 0.75, "MTL")]


def test_auc_of_null_and_many_keys(spark):
    rows = [(None if k == 0 else f"t{k}", y, float(s)) for k in range(1200) for y, s in ((1, 3 + k % 2), (0, 3), (0, 1), (1, 0))]
    got = {r["task"]: r["AUC"] for r in ev.auc_score(spark.createDataFrame(rows, "task string, y int, score double")).collect()}
    assert len(got) == 1200 and got[None] == pytest.approx(1.5 / 4) and got["t1"] == pytest.approx(2 / 4)


def test_ids_of_any_length_link(spark):
    conv = spark.createDataFrame([(c, 0, "user", f"text {c}") for c in (7, 123, 1234, 10_000_000_000)], "conv_id long, turn long, role string, text string")
    lab = tb.participant_labels(spark.createDataFrame([(c, 1, 0) for c in (123, 1234, 10_000_000_000)], "doc_id long, quality int, toxic int"))
    linked = prep.link_labels(lab, prep.with_id(tb.transcripts_from_conversations(conv), pattern=prep.WHOLE_ID_PATTERN, dtype="bigint"))
    assert {(r["Participant_ID"], r["sentence"]) for r in linked.collect()} == {(c, f"text {c}") for c in (123, 1234, 10_000_000_000)}


def test_rows_that_share_an_id_keep_their_words(spark):
    df = spark.createDataFrame([(1, "alpha beta"), (1, "gamma delta"), (2, None)], "row_id long, text string")
    vocab = enc.build_vocab(df)
    ids = {r["token"]: r["id"] for r in vocab.collect()}
    want = sorted([[2, ids["alpha"], ids["beta"], 3], [2, ids["gamma"], ids["delta"], 3]])
    got = [r["encoded"] for r in enc.encode_ids(df, vocab).where("row_id = 1").collect()]
    assert sorted(got) == want
    vocab._labelwise_size = 1 << 40  # as if it were too large to ship
    assert sorted(r["encoded"] for r in enc.encode_ids(df, vocab).where("row_id = 1").collect()) == want


def test_keep_end(spark):
    df = spark.createDataFrame([(1, "a b c d"), (2, "a")], "row_id long, text string")
    got = {r["row_id"]: r["input_ids"] for r in enc.encode_fixed(df, enc.build_vocab(df), max_len=4, keep_end=True).collect()}
    assert got[1][-1] == enc.END_ID and len(got[1]) == 4 and got[2][2:] == [enc.END_ID, enc.PAD_ID]


def test_encoding_moves_no_tokens(spark):
    df = spark.createDataFrame([(1, "a b c d")], "row_id long, text string")
    plan = enc.encode_corpus(df)[0]._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Generate" not in plan


def test_dot_matrix_bound(spark):
    df = spark.createDataFrame([(i, 0, 1.0) for i in range(20)], "qid int, pos int, value double")
    with pytest.raises(ValueError, match="at most"):
        la.dot_matrix(df, df.withColumnRenamed("qid", "sid"), max_vectors=10)


def test_no_private_scratch_folder_on_a_cluster():
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

        def getConf(self):
            return {}

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        ensure_checkpoint_dir(Session())
