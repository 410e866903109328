"""Sparse features, epochs without a new sort, stacked runs, task vectors of their own."""

import hashlib
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from conftest import SF001, SF0001
from pyspark.sql import functions as F

from labelwise.operators import sample as smp
from labelwise.operators import sparse as sp
from labelwise.operators import train as tr
from labelwise.plans import fit as fp


def _words(text):
    return [w for w in re.findall(r"[^\W_]+", (text or "").lower())]


def _bucket(w, bits):
    return int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % (1 << bits)


@pytest.fixture(scope="module")
def texts(spark):
    rows = [(0, None, 0, 1), (1, "", 1, 0), (2, " ,;", 1, None), (3, "a b a A é ÉÉ 12", 0, 0), (4, "b " * 3000, None, 1), (5, "x", None, None), (6, "b c", 1, 1)] + [
        (10 + k, " ".join(f"w{(k * j) % 37}" for j in range(k)), k % 2, (k // 2) % 2) for k in range(60)]
    return rows, spark.createDataFrame(rows, "row_id long, text string, a int, b int").repartition(3)


@pytest.mark.parametrize("bits", [1, 3, 18, 30])
def test_hashed_counts(texts, bits):
    rows, df = texts
    got = {r.row_id: list(zip(r.idx, r.val)) for r in sp.hashed_counts(df, "text", bits).collect()}
    assert got == {i: sorted((p, float(n)) for p, n in Counter(_bucket(w, bits) for w in _words(t)).items()) for i, t, _, _ in rows}


@pytest.mark.parametrize("pending", [2_000_000, 3])
def test_sparse_gradient_equals_the_dense_one(texts, monkeypatch, pending):
    monkeypatch.setattr(sp, "PENDING", pending)
    bits, (rows, df) = 5, texts
    heads = {t: tr.Head(np.random.default_rng(k).normal(size=(2, 32)), np.array([0.3, -0.2])) for k, t in enumerate("ab")}
    sparse = sp.hashed_counts(df, "text", bits)
    got = {(r["task"], r["class"], r["pos"]): r["value"] for r in sp.sparse_gradient_table(sparse, heads, {"a": "a", "b": "b"}).collect()}
    dense = [(i, [float(Counter(_bucket(w, bits) for w in _words(t))[p]) for p in range(32)], a, b) for i, t, a, b in rows]
    spark = df.sparkSession
    want = {(r["task"], r["class"], r["pos"]): r["value"] for r in tr.gradient_table(
        spark.createDataFrame(dense, "row_id long, x array<double>, a int, b int"), heads, {"a": "a", "b": "b"}).collect()}
    touched = {p for _, x, a, b in dense if a is not None or b is not None for p in range(32) if x[p]} | {32}
    assert {k for k in got if k[1] >= 0} == {(t, c, p) for t in "ab" for c in range(2) for p in touched}
    for k, v in want.items():
        assert got.get(k, 0.0) == pytest.approx(v, abs=1e-9)
    scores = {r.row_id: r.logits for r in sp.sparse_scores(sparse, heads["a"]).collect()}
    for i, x, _, _ in dense:
        np.testing.assert_allclose(scores[i], heads["a"].W @ x + heads["a"].b, atol=1e-9)


def test_sparse_passes_hold_a_slice_at_a_time(spark, texts, monkeypatch):
    rows, df = texts
    heads = {"a": tr.Head(np.random.default_rng(0).normal(size=(2, 32)), np.zeros(2))}

    def results():
        counts = sp.hashed_counts(df.coalesce(1), "text", 5)
        table = sp.sparse_gradient_table(counts, heads, {"a": "a"}).collect()
        return {r.row_id: (r.idx, r.val) for r in counts.collect()}, {(r["task"], r["class"], r["pos"]): r["value"] for r in table}

    counts, table = results()
    monkeypatch.setattr(sp, "SLICE", 7)
    assert results()[0] == counts and results()[1] == pytest.approx(table, abs=1e-9)
    batch = pa.RecordBatch.from_arrays([pa.array([[1] * n if n is not None else None for n in (0, 9, 3, None, 4, 1, 0, 20, 7, 0)], pa.list_(pa.int32()))], ["x"])
    cut = list(sp._slices(batch, 0))
    assert pa.Table.from_batches(cut).equals(pa.Table.from_batches([batch])) and [sum(len(x or ()) for x in c.column(0).to_pylist()) for c in cut] == [0, 9, 7, 1, 20, 7]
    assert list(sp._slices(batch.slice(0, 0), 0)) == []


def test_sparse_errors(spark, texts):
    heads = {"a": tr.Head(np.zeros((2, 4)), np.zeros(2))}
    bad = [("array(9)", "array(1.0D)", 0, "outside"), ("array(1, 2)", "array(1.0D)", 0, "differ"), ("array(1)", "array(1.0D)", 7, "label")]
    for idx, val, y, message in bad:
        with pytest.raises(Exception, match=message):
            sp.sparse_gradient_table(spark.sql(f"SELECT {idx} AS idx, {val} AS val, {y} AS a"), heads, {"a": "a"}).collect()
    with pytest.raises(ValueError):
        sp.hashed_counts(texts[1], "text", 40)
    assert sp.sparse_gradient_table(spark.sql("SELECT array(1) AS idx, array(1.0D) AS val, 0 AS a").limit(0), heads, {"a": "a"}).count() == 0


def _position(rank, n, keys):
    def mixed(v, key):
        first = ((v + key) * 1103515245 + 12345) % 2147483647
        return ((first ^ (first >> 15)) * 48271) % 2147483647

    a, b = smp._grid(n)
    while True:
        left, right = divmod(rank, b)
        for r, key in enumerate(keys):
            if r % 2 == 0:
                left = (left + mixed(right, key)) % a
            else:
                right = (right + mixed(left, key)) % b
        rank = left * b + right
        if rank < n:
            return rank


@pytest.mark.parametrize("n", [1, 2, 3, 7, 50, 1000, 5003])
def test_every_epoch_is_a_permutation(spark, n):
    ranked = spark.range(n).withColumnRenamed("id", "rank")
    orders = []
    for epoch in range(3):
        got = {r["rank"]: r["position"] for r in smp.permuted_position(ranked, n, 7, epoch).collect()}
        assert sorted(got.values()) == list(range(n))
        keys = smp.permutation_keys(7, epoch)
        assert all(got[r] == _position(r, n, keys) for r in range(0, n, max(1, n // 200)))
        orders.append(tuple(got[r] for r in range(n)))
    assert n < 7 or len(set(orders)) == 3


def test_permuted_batches_move_no_row(spark):
    emb = spark.read.parquet(f"{SF0001}/embeddings.parquet").select(F.col("vec_id").alias("row_id"))
    ranked = smp.global_rank(emb, ["row_id"])
    n = sum(ranked._labelwise_counts)
    for epoch in range(2):
        plan = smp.permuted_batches(ranked, n, 32, 42, epoch)._jdf.queryExecution().executedPlan().toString()
        own = plan.split("InMemoryTableScan")[0]  # above the rows that were ranked once
        assert "Exchange" not in own and "Sort" not in own
    sizes = [r["count"] for r in smp.permuted_batches(ranked, n, 32).groupBy("batch_id").count().orderBy("batch_id").collect()]
    assert sizes == [32] * (n // 32) + [n % 32] * (n % 32 > 0)
    assert smp.permuted_position(ranked.limit(0), 0).collect() == []


def _emb(spark, n=300):
    return spark.read.parquet(f"{SF001}/embeddings.parquet").selectExpr(
        "vec_id AS row_id", "transform(slice(embedding, 1, 6), v -> CAST(v AS DOUBLE)) AS x", "CAST(label % 2 AS INT) AS a",
        "CAST(label >= 5 AS INT) AS b", "CAST(label % 3 AS INT) AS c").where(f"row_id < {n}")


def _grid_configs(batch):
    common = dict(epochs=2, data="embeddings", batch_size=batch)
    return [fp.RunConfig(tasks=("a",), regime="STL", lr=0.01, **common), fp.RunConfig(tasks=("b",), regime="STL", lr=0.1, run=1, **common),
            fp.RunConfig(tasks=("a", "b"), regime="MTL", lr=0.01, hidden=3, run=2, **common), fp.RunConfig(tasks=("a", "c"), regime="MTL_awl", lr=0.02, classes={"a": 2, "c": 3}, run=3, **common),
            fp.RunConfig(tasks=("a", "b"), regime="MTL_meta", lr=0.02, run=4, **common), fp.RunConfig(tasks=("a",), regime="STL", lr=0.01, run=5, **{**common, "epochs": 1})]


@pytest.mark.parametrize("batch", [None, 32])
def test_stacked_runs_equal_runs_on_their_own(spark, batch):
    tagged = smp.train_test_tag(_emb(spark), "row_id").cache()
    train, test = tagged.where("split = 'train'"), tagged.where("split = 'test'")
    labels = {t: t for t in "abc"}
    got, want = (fp.run_grid(_grid_configs(batch), lambda c: (train, test, labels), stacked=s) for s in (True, False))
    assert sorted(got.columns) == sorted(want.columns)
    key = lambda r: (r["run"], r["epoch"])
    a, b = sorted(got.collect(), key=key), sorted(want.select(got.columns).collect(), key=key)
    assert len(a) == len(b) == 11
    for x, y in zip(a, b):
        for name, u, v in zip(got.columns, x, y):
            assert u == v or u == pytest.approx(v, rel=1e-9), name


def test_jobs_do_not_grow_with_the_runs(spark):
    tagged = smp.train_test_tag(_emb(spark), "row_id").cache()
    train, test = tagged.where("split = 'train'"), tagged.where("split = 'test'")
    tagged.count()
    jobs = []
    for k in (2, 6):
        configs = [fp.RunConfig(tasks=("a",), regime="STL", lr=0.01 * (i + 1), epochs=2, run=i, data="embeddings") for i in range(k)]
        spark.sparkContext.setJobGroup(f"grid-{k}", "")
        fp.fit_stacked(train, test, {"a": "a"}, configs)
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"grid-{k}")))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs[0] == jobs[1]


def test_task_vectors_of_their_own(spark):
    """Three tasks: shared-layer gradients of each loss, and the weights' step by a plain computation."""
    parts = smp.support_query_test(_emb(spark), "row_id").cache()
    cfg = fp.RunConfig(tasks=("a", "b", "c"), regime="MTL_meta", epochs=1, lr=0.05, hidden=3, classes={"a": 2, "b": 2, "c": 3}, data="embeddings", per_task_shared=True)
    labels = {t: t for t in "abc"}
    got = fp.fit_tagged(parts, labels, cfg, split_col="part", train_value="support").task_weights[0]
    model = tr.LinearModel.create("abc", {"a": 2, "b": 2, "c": 3}, 6, 3)

    def vectors(part, lam):
        stats = tr.batch_gradient(parts.where(f"part = '{part}'"), model.heads(), labels, "x", method="explode")
        return {t: model.task_vector(tr.clip_grads(model.param_grads(stats, {u: lam if u == t else 0.0 for u in "abc"}))[0], t) for t in "abc"}, tr.clip_grads(
            model.param_grads(stats, {u: lam for u in "abc"}))[0]

    own, whole = vectors("support", 1 / 3)
    tr.Optimizer("adamw", 0.05, 1).step(model.params, whole)
    asked, _ = vectors("query", 1.0)
    cells = {t: float(asked[t] @ own[t]) * 3 for t in "abc"}
    m = [cells[t] for t in "abc"]
    scale = tr.min_norm_point(np.outer(m, m))
    for k, t in enumerate("abc"):
        assert got[t] == pytest.approx(1.0 + scale[k] * m[k], rel=1e-6)
    with pytest.raises(ValueError, match="accumulated"):
        fp.fit_tagged(parts, labels, fp.RunConfig(tasks=("a", "b"), regime="MTL_meta", data="embeddings", per_task_shared=True, accumulate=True), split_col="part", train_value="support")
