"""Run-level behaviour: lineage cut by checkpoint, scoring a stream, result files."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from labelwise.operators import sample as smp
from labelwise.operators import train as tr
from labelwise.plans import fit as fp
from labelwise.sources import results as rs
from labelwise.sources import tables as tb

from conftest import SF001


@pytest.fixture(scope="module")
def emb(spark):
    return tb.embedding_examples(tb.read_table(spark, SF001, "embeddings"))


def test_fit_with_checkpointed_features(emb):
    tagged = smp.train_test_tag(emb, "row_id")
    cfg = fp.RunConfig(model="embedding", tasks=("a", "b"), regime="MTL", epochs=2, lr=0.01, checkpoint=True)
    res = fp.fit(tagged.where("split = 'train'"), tagged.where("split = 'test'"), {"a": "a", "b": "b"}, cfg)
    plain = fp.fit(tagged.where("split = 'train'"), tagged.where("split = 'test'"), {"a": "a", "b": "b"},
                   fp.RunConfig(model="embedding", tasks=("a", "b"), regime="MTL", epochs=2, lr=0.01))
    a = sorted(res.report.select("epoch", "TP_a", "TN_a", "TP_b").collect())
    b = sorted(plain.report.select("epoch", "TP_a", "TN_a", "TP_b").collect())
    assert a == b
    assert [h["loss"] for h in res.history] == pytest.approx([h["loss"] for h in plain.history])


def test_score_batch_on_a_stream(spark, emb, tmp_dir):
    """Scoring is column expressions with literal weights, so the same call
    applies to a streaming DataFrame."""
    src = os.path.join(tmp_dir, "in")
    emb.select("row_id", "x", "a", "b").write.parquet(src)
    model = tr.LinearModel.create(["a", "b"], 2, 64, hidden=4)
    stream = spark.readStream.schema(emb.select("row_id", "x", "a", "b").schema).parquet(src)
    scored = tr.score_batch(stream, model, {"a": "a", "b": "b"}, "x")
    q = scored.writeStream.format("memory").queryName("scored_stream").outputMode("append").start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    streamed = spark.table("scored_stream")
    batch = tr.score_batch(emb, model, {"a": "a", "b": "b"}, "x")
    assert streamed.count() == batch.count() == 1000
    key = ["row_id", "task", "pred"]
    assert sorted(streamed.select(*key).collect()) == sorted(batch.select(*key).collect())


def test_append_results_partitioned(spark, tmp_dir):
    df = spark.createDataFrame([("m", "d", "q", "MTL", 0, 0.5)], "model string, data string, question string, "
                               "training string, epoch int, F1_a double")
    path = os.path.join(tmp_dir, "res")
    rs.append_results(df, path)
    rs.append_results(df, path)
    back = rs.read_results(spark, path)
    assert back.count() == 2
    assert back.where((F.col("training") == "MTL") & (F.col("model") == "m")).count() == 2
    assert os.path.isdir(os.path.join(path, "model=m", "data=d", "question=q", "training=MTL"))


def test_mini_batch_steps_cover_epoch(spark, emb):
    tagged = smp.train_test_tag(emb, "row_id")
    cfg = fp.RunConfig(model="embedding", tasks=("a",), regime="STL", epochs=1, lr=0.01, batch_size=64)
    res = fp.fit(tagged.where("split = 'train'"), tagged.where("split = 'test'"), {"a": "a"}, cfg)
    n_train = tagged.where("split = 'train'").count()
    assert len(res.history) == -(-n_train // 64)
    assert res.report.count() == 1


def test_three_class_task_and_grid_append(spark, emb, tmp_dir):
    """A task with three classes trains and evaluates; grid runs append."""
    e3 = emb.withColumn("c3", (F.col("label") % 3).cast("int"))
    tagged = smp.train_test_tag(e3, "row_id")
    cfg = fp.RunConfig(model="embedding", tasks=("c3",), regime="STL", epochs=1, lr=0.01, classes=3)
    res = fp.fit(tagged.where("split = 'train'"), tagged.where("split = 'test'"), {"c3": "c3"}, cfg)
    assert res.model.params["W"].shape == (3, 64)
    assert res.report.count() == 1
    path = os.path.join(tmp_dir, "grid")
    grid = fp.run_grid([fp.RunConfig(model="embedding", tasks=("a",), regime="STL", epochs=1),
                        fp.RunConfig(model="embedding", tasks=("a", "b"), regime="MTL", epochs=1)],
                       lambda c: (tagged.where("split = 'train'"), tagged.where("split = 'test'"), {"a": "a", "b": "b"}),
                       results_path=path)
    assert grid.count() == 2
    assert rs.read_results(spark, path).count() == 2


def test_question_split_prunes_directories(spark, tmp_dir):
    import io
    from contextlib import redirect_stdout

    from labelwise.sources import transcripts as trs

    docs = tb.read_table(spark, SF001, "documents").select("doc_id", F.col("lang").alias("question"))
    tagged = smp.train_test_tag(docs, "doc_id")
    root = os.path.join(tmp_dir, "layout")
    trs.write_question_split(tagged, root)
    sel = trs.select_question_split(spark, root, "en", "test")
    buf = io.StringIO()
    with redirect_stdout(buf):
        sel.explain("formatted")
    plan = buf.getvalue()
    filters = plan.split("PartitionFilters")[1].split("\n")[0]
    assert "(question#" in filters and "= en)" in filters and "(split#" in filters and "= test)" in filters
    assert sel.count() == tagged.where("question = 'en' AND split = 'test'").count()


def test_quickstart_example(spark, tmp_dir):
    import importlib.util
    spec = importlib.util.spec_from_file_location(
        "quickstart", os.path.join(os.path.dirname(os.path.dirname(__file__)), "examples", "quickstart.py"))
    mod = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(mod)
    back = mod.main("/root/testdata/sf0.001", os.path.join(tmp_dir, "res"))
    assert back.count() == 3
