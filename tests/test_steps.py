"""Epochs as one barrier job: the same steps as a job per step, wherever batches lie; any number of tasks."""

import itertools

import numpy as np
import pytest
from conftest import SF001
from pyspark.sql import functions as F

from labelwise.operators import sample as smp
from labelwise.operators import train as tr
from labelwise.plans import fit as fp
from labelwise.plans import steps as st



@pytest.mark.parametrize("counts, batch", [([10], 3), ([5, 5], 5), ([5, 5], 4), ([3, 0, 1, 9, 2], 4), ([2, 2, 2], 100), ([100, 1, 100], 7), ([0, 0], 3), ([], 3), ([1] * 9, 2)])
def test_rounds_cover_every_batch_once(counts, batch):
    plan = st.rounds(counts, batch)
    total, owner = sum(counts), [p for p, n in enumerate(counts) for _ in range(n)]
    covered = [b for _, _, lo, hi in plan for b in range(lo, hi)]
    assert covered == list(range(-(-total // batch)))
    for first, last, lo, hi in plan:
        held = {owner[r] for r in range(lo * batch, min(hi * batch, total))}
        assert min(held) == first and max(held) == last and (first == last or hi == lo + 1)


def _embeddings(spark, n=400, d=5):
    return spark.read.parquet(f"{SF001}/embeddings.parquet").selectExpr(
        "vec_id AS row_id", f"transform(slice(embedding, 1, {d}), v -> CAST(v AS DOUBLE)) AS x", "CAST(label % 2 AS INT) AS a",
        "CAST(label >= 5 AS INT) AS b", "CAST(label % 3 AS INT) AS c").where(f"row_id < {n}")


@pytest.mark.parametrize("regime, tasks, step_tasks, batch", [("STL", ("a",), 3, 7), ("MTL", ("a", "b"), 3, 32), ("MTL_awl", ("a", "b"), 5, 90), ("MTL_meta", ("a", "b", "c"), 4, 25),
                                                              ("MTL", ("a", "b"), 2, 1000)])
def test_one_job_equals_a_job_per_step(spark, regime, tasks, step_tasks, batch):
    parts = smp.support_query_test(_embeddings(spark), "row_id").withColumn("b", F.when(F.col("row_id") % 3 != 0, F.col("b"))).cache()
    labels, runs = {"a": "a", "b": "b", "c": "c"}, []
    for one_job in (True, False):
        cfg = fp.RunConfig(tasks=tasks, regime=regime, epochs=2, lr=0.05, batch_size=batch, hidden=3, classes={"a": 2, "b": 2, "c": 3}, data="embeddings",
                           one_job=one_job, step_tasks=step_tasks, accumulate=regime == "MTL_meta", keep_params=True)
        runs.append(fp.fit_tagged(parts, {t: labels[t] for t in tasks}, cfg, split_col="part", train_value="support"))
    a, b = runs
    assert len(a.history) == len(b.history) > 0
    for x, y in zip(a.history, b.history):
        assert (x["epoch"], x["step"]) == (y["epoch"], y["step"]) and x["loss"] == pytest.approx(y["loss"], rel=1e-9)
        for k in x["params"]:
            np.testing.assert_allclose(x["params"][k], y["params"][k], rtol=1e-8, atol=1e-11)
    for x, y in zip(a.task_weights, b.task_weights):
        assert x == pytest.approx(y, rel=1e-8)


def test_jobs_do_not_grow_with_the_steps(spark):
    emb = _embeddings(spark).cache()
    emb.count()
    group, jobs = "steps-jobs", []
    for batch in (5, 100):
        cfg = fp.RunConfig(tasks=("a",), regime="STL", epochs=1, lr=0.01, batch_size=batch, data="embeddings", history=False)
        spark.sparkContext.setJobGroup(f"{group}-{batch}", "")
        res = fp.fit(emb, emb, {"a": "a"}, cfg)
        assert res.history == []
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"{group}-{batch}")))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs[0] == jobs[1]


def _brute_min_norm(gram):
    """Least norm over the affine best points of every set of vectors that lie inside the hull."""
    k, best = len(gram), None
    for m in range(1, k + 1):
        for s in itertools.combinations(range(k), m):
            g = gram[np.ix_(s, s)]
            w = np.linalg.lstsq(np.block([[g, np.ones((m, 1))], [np.ones((1, m)), np.zeros((1, 1))]]), np.append(np.zeros(m), 1.0), rcond=None)[0][:m]
            if (w >= -1e-12).all() and abs(w.sum() - 1) < 1e-9:
                value = float(w @ g @ w)
                best = value if best is None else min(best, value)
    return best


@pytest.mark.parametrize("k", [1, 2, 3, 4, 6])
def test_min_norm_point_equals_brute_force(k):
    rnd = np.random.default_rng(k)
    for trial in range(60):
        v = rnd.normal(size=(k, rnd.integers(1, 8))) + (0 if trial % 2 else 1.5)
        if trial % 5 == 0 and k > 1:
            v[1] = v[0]
        if trial % 7 == 0 and k > 2:
            v[2] = 0.0 if trial % 2 else 3 * v[0]
        gram = v @ v.T
        w = tr.min_norm_point(gram)
        assert w.min() >= 0 and w.sum() == pytest.approx(1.0)
        assert float(w @ gram @ w) == pytest.approx(_brute_min_norm(gram), rel=1e-7, abs=1e-9)


def test_min_norm_point_needs_a_square_table():
    with pytest.raises(ValueError):
        tr.min_norm_point(np.zeros((2, 3)))
