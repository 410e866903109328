"""Properties and invariance over the supplied tables (sf0.01)."""

import math

import pytest
from pyspark.sql import functions as F

from labelwise.operators import encode as enc
from labelwise.operators import evaluate as ev
from labelwise.operators import sample as smp
from labelwise.sources import tables as tb

from conftest import SF001


@pytest.fixture(scope="module")
def docs(spark):
    return tb.read_table(spark, SF001, "documents").select(F.col("doc_id").alias("row_id"), "text", "n_chars")


@pytest.fixture(scope="module")
def stand_in(spark):
    ex = tb.text_examples(tb.read_table(spark, SF001, "documents"), tb.read_table(spark, SF001, "labels"))
    return tb.stand_in_predictions(ex)


def test_mask_sum_is_min_len(spark, docs):
    vocab = enc.build_vocab(docs, size=5000)
    fixed = enc.encode_fixed(docs, vocab)
    bad = fixed.where(F.aggregate("attention_mask", F.lit(0), lambda a, m: a + m)
                      != F.least(F.col("n_tokens") + 2, F.lit(128))).count()
    assert bad == 0
    assert fixed.where(F.size("input_ids") != 128).count() == 0


def test_encode_probe_values(spark, docs):
    """SURVEY 5.4: V=5000, 128 ids, markers at both ends before truncation."""
    vocab = enc.build_vocab(docs, size=5000)
    fixed = enc.encode_fixed(docs, vocab)
    ids = fixed.select("row_id", F.posexplode("input_ids").alias("pos", "id")).where("id > 0")
    r = ids.agg(F.count(F.lit(1)).alias("n"), F.sum("id").alias("s"), F.sum(F.col("id") * (F.col("pos") + 1)).alias("sp"),
                F.count_if(F.col("id") == 1).alias("unk"), F.max("id").alias("mx")).first()
    assert (r["n"], r["s"], r["sp"], r["unk"], r["mx"]) == (116794, 58435618, 3644188151, 35838, 5003)
    assert fixed.where(F.array_contains("input_ids", 3)).count() == 219
    assert fixed.where(F.col("n_tokens") + 2 >= 128).count() == 787


def test_tokenize_probe(spark, docs):
    t = enc.tokenize(docs)
    r = t.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("token").alias("d"), F.sum(F.length("token")).alias("l")).first()
    assert (r["n"], r["d"], r["l"]) == (385538, 68844, 1908904)


def test_counts_add_up(stand_in):
    for r in ev.multi_task_eval(stand_in).collect():
        assert r["TP"] + r["TN"] + r["FP"] + r["FN"] == r["n"]
        assert r["AUC"] == pytest.approx(r["BA"])


def test_batch_count_and_cover(spark, docs):
    b = smp.assign_batches(docs.select("row_id"), 32)
    assert b.select("batch_id").distinct().count() == math.ceil(1000 / 32)
    assert b.select("row_id").distinct().count() == 1000


def test_splits_cover_without_overlap(spark, docs):
    parts = smp.support_query_test(docs.select("row_id"), "row_id")
    counts = {r["part"]: r["count"] for r in parts.groupBy("part").count().collect()}
    assert sum(counts.values()) == 1000 and set(counts) == {"support", "query", "test"}
    buckets = docs.select(smp.hash_bucket("row_id", 42, 10).alias("b")).groupBy("b").count().orderBy("b")
    assert [r["count"] for r in buckets.collect()] == [87, 121, 104, 86, 105, 109, 102, 105, 97, 84]


@pytest.mark.parametrize("parts", [1, 4, 16])
def test_invariant_to_partitioning(spark, docs, stand_in, parts):
    base = ev.multi_task_eval(stand_in).orderBy("task").collect()
    again = ev.multi_task_eval(stand_in.repartition(parts)).orderBy("task").collect()
    assert base == again
    auc = ev.auc_score(stand_in.repartition(parts)).orderBy("task").collect()
    assert auc[1]["AUC"] == pytest.approx(0.541553978, abs=1e-9)
    b1 = {r["row_id"]: r["batch_id"] for r in smp.assign_batches(docs.select("row_id"), 32).collect()}
    b2 = {r["row_id"]: r["batch_id"] for r in smp.assign_batches(docs.select("row_id").repartition(parts), 32,
                                                                   partitions=parts).collect()}
    assert b1 == b2


def test_batch_mean_probe(spark, docs):
    b = smp.assign_batches(docs.select("row_id", "n_chars"), 32).withColumn("loss", F.log("n_chars"))
    r = ev.batch_mean_loss(b).first()
    assert r["batch_mean_loss"] == pytest.approx(7.312542414, abs=1e-9)
    assert r["row_mean_loss"] == pytest.approx(7.297427056, abs=1e-9)
    assert r["n_batches"] == 32


def test_stand_in_golden(stand_in):
    got = {r["task"]: r for r in ev.multi_task_eval(stand_in).collect()}
    q, t = got["quality"], got["toxic"]
    assert (q["TP"], q["TN"], q["FP"], q["FN"]) == (297, 3, 55, 44)
    assert q["F1"] == pytest.approx(0.857142857, abs=1e-9)
    assert q["BA"] == pytest.approx(0.461345940, abs=1e-9)
    assert (t["TP"], t["TN"], t["FP"], t["FN"]) == (22, 348, 0, 29)


def test_array_math_probes(spark):
    """SURVEY 5.4 probes for M1, M6 and M7 on embeddings."""
    from labelwise.functions import arrays as A
    from labelwise.operators import linalg as la

    emb = tb.read_table(spark, SF001, "embeddings")
    z = emb.select(A.linear("embedding", la.formula_weights(2, 64)).alias("z"))
    r = z.agg(F.sum(F.col("z")[0]).alias("s0"), F.max(F.col("z")[0]).alias("m0"),
              F.sum(F.col("z")[1]).alias("s1"), F.max(F.col("z")[1]).alias("m1")).first()
    assert (r["s0"], r["m0"], r["s1"], r["m1"]) == pytest.approx((1.387183, 0.948536, 7.464950, 0.870499), abs=1e-6)

    seq = emb.select(F.col("label").alias("seq_id"), F.col("vec_id").alias("pos"), F.col("embedding").alias("x"))
    pooled = {r["seq_id"]: sum(r["pooled"]) for r in la.attention_pool(seq, "seq_id", "pos", "x").collect()}
    assert [pooled[0], pooled[1], pooled[2]] == pytest.approx([-0.321570, 0.142215, 0.113490], abs=1e-6)

    long = emb.select("vec_id", F.posexplode("embedding").alias("pos", "value"))
    q = long.where("vec_id < 20").withColumnRenamed("vec_id", "qid")
    s = long.where("vec_id >= 480").withColumnRenamed("vec_id", "sid")
    d = la.dot_matrix(q, s).agg(F.count(F.lit(1)).alias("n"), F.sum("dot").alias("s"), F.max("dot").alias("m")).first()
    assert d["n"] == 400
    assert (d["s"], d["m"]) == pytest.approx((1.065076, 0.343538), abs=1e-6)


def test_softmax_weights_sum_to_one(spark):
    from labelwise.operators import linalg as la
    emb = tb.read_table(spark, SF001, "embeddings").select(
        "label", F.element_at("embedding", 1).cast("double").alias("score"))
    w = la.softmax_weights(emb, ["label"], "score").groupBy("label").agg(F.sum("weight").alias("s"))
    assert all(abs(r["s"] - 1.0) < 1e-12 for r in w.collect())


@pytest.mark.parametrize("parts", [1, 4, 16])
def test_gradient_and_encoding_invariant_to_partitioning(spark, docs, parts):
    import numpy as np

    from labelwise.operators import linalg as la
    from labelwise.operators import train as tr

    emb = tb.embedding_examples(tb.read_table(spark, SF001, "embeddings"))
    heads = {"a": tr.Head(np.array(la.formula_weights(2, 64)), np.zeros(2)),
             "b": tr.Head(np.array(la.formula_weights(2, 64, row_offset=2)), np.zeros(2))}
    base = tr.batch_gradient(emb, heads, {"a": "a", "b": "b"}, "x")
    other = tr.batch_gradient(emb.repartition(parts), heads, {"a": "a", "b": "b"}, "x")
    for t in ("a", "b"):
        assert np.allclose(base.grads[t], other.grads[t], rtol=0, atol=1e-12)
        assert base.loss[t] == pytest.approx(other.loss[t], abs=1e-12)
    small = docs.where("row_id < 200")
    e1 = dict(enc.encode_corpus(small, 500)[0].select("row_id", "input_ids").collect())
    e2 = dict(enc.encode_corpus(small.repartition(parts), 500)[0].select("row_id", "input_ids").collect())
    assert e1 == e2
