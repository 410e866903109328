"""The gradient-alignment regime against a step-by-step run on plain arrays that keeps every vector."""

import numpy as np
import pytest

from labelwise.operators import sample as smp
from labelwise.operators import train as tr
from labelwise.plans import fit as fp

from conftest import SF001

LABELS = {"a": "a", "b": "b"}


def _softmax_stats(model, rows):
    grads, loss = {}, {}
    x = np.array([r["x"] for r in rows])
    for t, h in model.heads().items():
        y = np.array([r[t] for r in rows])
        z = x @ h.W.T + h.b
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        loss[t] = float(-np.log(p[np.arange(len(y)), y]).mean())
        p[np.arange(len(y)), y] -= 1
        grads[t] = p.T @ np.hstack([x, np.ones((len(x), 1))]) / len(x)
    return tr.StepStats(grads, loss, {t: float(len(rows)) for t in grads})


def _batches(df, cfg, epoch):
    rows = smp.assign_batches(df, cfg.batch_size, "row_id", cfg.seed, epoch).orderBy("rank").collect()
    return [rows[i:i + cfg.batch_size] for i in range(0, len(rows), cfg.batch_size)]


@pytest.mark.parametrize("accumulate,faithful", [(True, True), (True, False), (False, False)])
def test_meta_regime_step_by_step(spark, accumulate, faithful):
    emb = spark.read.parquet(f"{SF001}/embeddings.parquet").selectExpr(
        "vec_id AS row_id", "transform(slice(embedding, 1, 5), v -> CAST(v AS DOUBLE)) AS x", "CAST(label % 2 AS INT) AS a", "CAST(label >= 5 AS INT) AS b").where("row_id < 260")
    parts = smp.support_query_test(emb, "row_id").cache()
    cfg = fp.RunConfig(tasks=("a", "b"), regime="MTL_meta", epochs=2, lr=0.05, batch_size=32, hidden=3, data="embeddings",
                       accumulate=accumulate, faithful_difference=faithful)
    got = fp.fit_tagged(parts, LABELS, cfg, split_col="part", train_value="support")
    support, query = parts.where("part = 'support'").drop("part"), parts.where("part = 'query'").drop("part")
    model = tr.LinearModel.create(["a", "b"], 2, 5, 3)
    w, history, weights = {"a": 1.0, "b": 1.0}, [], []
    per_epoch = len(_batches(support, cfg, 0))
    opt = tr.Optimizer("adamw", cfg.lr, per_epoch * 2)
    one = {"a": 1.0, "b": 1.0}
    for epoch in range(2):
        kept, S, Q, losses = None, {"a": [], "b": []}, {"a": [], "b": []}, []
        for rows in _batches(support, cfg, epoch):
            stats = _softmax_stats(model, rows)
            lam = {t: w[t] / 2 for t in w}
            fresh = model.param_grads(stats, lam)
            kept = fresh if kept is None or not accumulate else {k: kept[k] + fresh[k] for k in fresh}
            kept, _ = tr.clip_grads(kept)
            for t in w:
                S[t].append(model.task_vector(kept, t))
            history.append((sum(lam[t] * stats.loss[t] for t in w), opt.lr * (opt.total - opt.t) / opt.total))
            opt.step(model.params, kept)
        if accumulate:
            for t in w:
                for i in (range(1, 2) if faithful else range(len(S[t]) - 1, 0, -1)):
                    S[t][i] = S[t][i] - S[t][i - 1]
        S = {t: [v / (w[t] / 2) for v in S[t]] for t in w}
        for rows in _batches(query, cfg, 10_000 + epoch):
            stats = _softmax_stats(model, rows)
            fresh = model.param_grads(stats, one)
            kept = {k: kept[k] + fresh[k] for k in fresh} if accumulate else fresh
            kept, _ = tr.clip_grads(kept)
            for t in w:
                Q[t].append(model.task_vector(kept, t))
            losses.append(sum(stats.loss.values()))
        M = {t: np.stack(Q[t]) @ np.stack(S[t]).T for t in w}
        scale = tr.min_norm_weights(float((M["a"] ** 2).sum()), float((M["a"] * M["b"]).sum()), float((M["b"] ** 2).sum()))
        w = {t: w[t] + scale[i] * float(M[t].sum()) for i, t in enumerate(("a", "b"))}
        weights.append((w["a"], w["b"], float(np.mean(losses))))
    assert [(h["loss"], h["lr"]) for h in got.history] == [(pytest.approx(a), pytest.approx(b)) for a, b in history]
    assert [(r["a"], r["b"], r["query_loss"]) for r in got.task_weights] == [tuple(map(pytest.approx, r)) for r in weights]
    assert got.history[0]["weighted_loss_a"] == pytest.approx(got.history[0]["loss_a"] / 2)
    parts.unpersist()


def test_steps_are_bounded(spark):
    emb = spark.range(300).selectExpr("id AS row_id", "array(CAST(id AS DOUBLE) / 300, 1.0D) AS x", "CAST(id % 2 AS INT) AS a")
    cfg = fp.RunConfig(tasks=("a",), regime="STL", epochs=1, batch_size=10, max_steps=7, data="embeddings")
    res = fp.fit(emb, emb, {"a": "a"}, cfg)
    assert len(res.history) == 6  # 30 batches, five at a time
    assert res.history[0]["lr"] == cfg.lr


def test_every_batch_is_a_step(spark):
    """Batches are merged only on request, and the report says the batch size that results."""
    emb = spark.range(1200).selectExpr("id AS row_id", "array(CAST(id AS DOUBLE) / 300, 1.0D) AS x", "CAST(id % 2 AS INT) AS a")
    cfg = fp.RunConfig(tasks=("a",), regime="STL", epochs=1, batch_size=1, data="embeddings")
    steps = fp._Steps(emb, cfg, 0, "row_id", None)
    assert steps.n == 1200 and steps.group == 1
    steps.release()
    res = fp.fit(emb, emb, {"a": "a"}, fp.RunConfig(tasks=("a",), regime="STL", epochs=1, batch_size=100, max_steps=5, data="embeddings"))
    assert len(res.history) == 4 and {r["batch_size"] for r in res.report.collect()} == {300}


def test_unknown_dataset(spark):
    emb = spark.range(3).selectExpr("id AS row_id", "array(1.0D) AS x", "0 AS a")
    with pytest.raises(ValueError, match="unknown dataset"):
        fp.fit(emb, emb, {"a": "a"}, fp.RunConfig(tasks=("a",), regime="STL", data="nowhere"))
