"""Training: gradients, chain rule, optimizer, probes, regimes."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from labelwise.operators import linalg as la
from labelwise.operators import sample as smp
from labelwise.operators import train as tr
from labelwise.plans import fit as fp
from labelwise.sources import tables as tb

from conftest import SF001


@pytest.fixture(scope="module")
def feats(spark):
    ex = tb.text_examples(tb.read_table(spark, SF001, "documents"), tb.read_table(spark, SF001, "labels"))
    return tr.text_stat_features(ex).persist()


@pytest.fixture(scope="module")
def emb(spark):
    return tb.embedding_examples(tb.read_table(spark, SF001, "embeddings")).persist()


def _np_loss(model, X, Y):
    total = 0.0
    for t, h in model.heads().items():
        z = X @ h.W.T + h.b
        m = z.max(1, keepdims=True)
        lse = (m + np.log(np.exp(z - m).sum(1, keepdims=True)))[:, 0]
        total += float((lse - z[np.arange(len(X)), Y[t]]).mean())
    return total


def test_logistic_probe(feats):
    """SURVEY 5.4: two-feature logistic, 5 full-batch steps at 0.5 from zero.

    Two-class softmax at rate 0.25 moves w1 - w0 exactly as a logistic
    regression at rate 0.5."""
    f2 = feats.withColumn("x2", F.slice("x", 1, 2))
    m = tr.LinearModel.create(["quality"], 2, 2, None, "zeros")
    opt = tr.Optimizer("sgd", 0.25, 5, schedule=False)
    losses = []
    for _ in range(5):
        st = tr.batch_gradient(f2, m.heads(), {"quality": "quality"}, "x2")
        losses.append(st.loss["quality"])
        g = m.param_grads(st)
        g["b"] = np.zeros(2)
        opt.step(m.params, g)
    assert losses == pytest.approx([0.693147181, 0.605769945, 0.548466993, 0.510268229, 0.484255073], abs=1e-9)
    w = m.params["W"][1] - m.params["W"][0]
    assert w == pytest.approx([0.614248812, 0.448930316], abs=1e-9)


def test_arrow_equals_explode(emb):
    heads = {"a": tr.Head(np.array(la.formula_weights(2, 64)), np.array([0.1, -0.1])),
             "b": tr.Head(np.array(la.formula_weights(2, 64, row_offset=2)), np.zeros(2))}
    s1 = tr.batch_gradient(emb, heads, {"a": "a", "b": "b"}, "x", method="explode")
    s2 = tr.batch_gradient(emb, heads, {"a": "a", "b": "b"}, "x", method="arrow")
    for t in ("a", "b"):
        assert np.allclose(s1.grads[t], s2.grads[t], atol=1e-12)
        assert s1.loss[t] == pytest.approx(s2.loss[t])
    assert s1.n == s2.n == 500


def test_chain_rule_matches_finite_difference(emb):
    """Multi-task parameter gradients equal a numerical derivative."""
    model = tr.LinearModel.create(["a", "b"], 2, 64, hidden=4)
    rows = emb.select("x", "a", "b").collect()
    X = np.array([r["x"] for r in rows], dtype=np.float64)
    Y = {"a": np.array([r["a"] for r in rows]), "b": np.array([r["b"] for r in rows])}
    st = tr.batch_gradient(emb, model.heads(), {"a": "a", "b": "b"}, "x")
    grads = model.param_grads(st)
    eps = 1e-6
    for name, idx in (("U", (1, 5)), ("u", (2,)), ("A_a", (0, 3)), ("a_b", (1,))):
        p = model.params[name]
        old = p[idx]
        p[idx] = old + eps
        up = _np_loss(model, X, Y)
        p[idx] = old - eps
        down = _np_loss(model, X, Y)
        p[idx] = old
        assert grads[name][idx] == pytest.approx((up - down) / (2 * eps), abs=1e-6)


def test_min_norm_probe(feats):
    zero = {"quality": tr.Head(np.zeros((2, 3)), np.zeros(2)), "toxic": tr.Head(np.zeros((2, 3)), np.zeros(2))}
    st = tr.batch_gradient(feats, zero, {"quality": "quality", "toxic": "toxic"}, "x")
    ga, gb = st.grads["quality"][1, :3], st.grads["toxic"][1, :3]
    # class-1 row equals the logistic gradient (0.5 - y) x
    assert float(ga @ ga) == pytest.approx(0.196716850, abs=1e-9)
    assert float(ga @ gb) == pytest.approx(-0.205857621, abs=1e-9)
    assert float(gb @ gb) == pytest.approx(0.215433867, abs=1e-9)
    gamma, _ = tr.min_norm_weights(float(ga @ ga), float(ga @ gb), float(gb @ gb))
    assert gamma == pytest.approx(0.511359261, abs=1e-9)


def test_adamw_first_step_is_lr_sign():
    opt = tr.Optimizer("adamw", 0.1, 10)
    p = {"w": np.array([1.0, -1.0])}
    opt.step(p, {"w": np.array([0.5, -2.0])})
    assert p["w"] == pytest.approx([0.9, -0.9], abs=1e-6)
    assert opt.rate() == pytest.approx(0.09)


@pytest.mark.parametrize("regime,tasks", [("STL", ("quality",)), ("MTL", ("quality", "toxic")),
                                          ("MTL_awl", ("quality", "toxic")), ("MTL_meta", ("quality", "toxic"))])
def test_regimes_run_and_loss_falls(feats, regime, tasks):
    tagged = smp.train_test_tag(feats, "row_id")
    train, test = tagged.where("split = 'train'"), tagged.where("split = 'test'")
    cfg = fp.RunConfig(tasks=tasks, regime=regime, epochs=3, lr=0.05)
    res = fp.fit(train, test, {"quality": "quality", "toxic": "toxic"}, cfg)
    rep = res.report.orderBy("epoch").collect()
    assert [r["epoch"] for r in rep] == [0, 1, 2]
    assert all(r["training"] == regime for r in rep)
    for t in tasks:
        assert all(r[f"TP_{t}"] + r[f"TN_{t}"] + r[f"FP_{t}"] + r[f"FN_{t}"] == 77 for r in rep)
    if regime in ("STL", "MTL"):
        loss = [h["loss"] for h in res.history]
        assert loss[-1] < loss[0]
    if regime == "MTL_meta":
        assert len(res.task_weights) == 3


def test_unknown_model_name(feats):
    with pytest.raises(ValueError):
        tr.select_model_features(feats, "nope")


def test_spark_chain_rule_equals_driver(feats):
    model = tr.LinearModel.create(["quality", "toxic"], 2, 3, hidden=8)
    labels = {"quality": "quality", "toxic": "toxic"}
    g = tr.gradient_table(feats, model.heads(), labels, "x")
    spark_rows = {(r["grp"], r["i"], r["j"]): r["value"] for r in tr.param_gradient_table(g, model).collect()}
    grads = model.param_grads(tr.collect_step(g, model.heads()))
    for (kk, j), v in np.ndenumerate(grads["U"]):
        assert spark_rows[("shared", kk, j)] == pytest.approx(v, abs=1e-12)
    for kk, v in enumerate(grads["u"]):
        assert spark_rows[("shared", kk, 3)] == pytest.approx(v, abs=1e-12)
    for t in ("quality", "toxic"):
        for (c, kk), v in np.ndenumerate(grads[f"A_{t}"]):
            assert spark_rows[(f"head_{t}", c, kk)] == pytest.approx(v, abs=1e-12)
        for c, v in enumerate(grads[f"a_{t}"]):
            assert spark_rows[(f"head_{t}", c, 8)] == pytest.approx(v, abs=1e-12)
