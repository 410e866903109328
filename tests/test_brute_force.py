"""The mini-batch epoch loop against an independent numpy implementation.

The step count depends on the data, so no fixed SQL can unroll it; instead
every step is recomputed here with explicit backpropagation through the
shared layer (no effective-head shortcut), the same md5 batch order, norm
clipping, AdamW with a linear decay, and the test loss over shuffled test
batches.
"""

import hashlib
import math

import numpy as np
import pytest

import __spark_entry__ as se
from labelwise.operators.linalg import formula_weights

from conftest import SF001


def _md5(s: str) -> str:
    return hashlib.md5(s.encode()).hexdigest()


def _batches(ids, seed, epoch, size):
    order = sorted(ids, key=lambda i: (_md5(f"{seed}:{epoch}:{i}"), i))
    return [order[k:k + size] for k in range(0, len(order), size)]


def _forward(p, X):
    H = X @ p["U"].T + p["u"]
    out = {}
    for t in ("a", "b"):
        Z = H @ p[f"A_{t}"].T + p[f"a_{t}"]
        m = Z.max(1, keepdims=True)
        E = np.exp(Z - m)
        out[t] = (Z, E / E.sum(1, keepdims=True), (m + np.log(E.sum(1, keepdims=True)))[:, 0])
    return H, out


def brute_force(rows, epochs=2, lr=0.01, batch=32, hidden=8, seed=42):
    data = {r["row_id"]: r for r in rows}
    test_ids = [i for i in data if int(_md5(f"{seed}:{i}")[:8], 16) % 10 < 2]
    train_ids = [i for i in data if i not in set(test_ids)]
    d = len(rows[0]["x"])
    p = {"U": np.array(formula_weights(hidden, d)) / math.sqrt(d), "u": np.zeros(hidden)}
    for i, t in enumerate(("a", "b")):
        p[f"A_{t}"] = np.array(formula_weights(2, hidden, row_offset=7 * (i + 1))) / math.sqrt(hidden)
        p[f"a_{t}"] = np.zeros(2)
    steps_per_epoch = math.ceil(len(train_ids) / batch)
    total, t_step = steps_per_epoch * epochs, 0
    m = {k: np.zeros_like(v) for k, v in p.items()}
    v = {k: np.zeros_like(val) for k, val in p.items()}
    report = []
    for epoch in range(epochs):
        losses = []
        for ids in _batches(train_ids, seed, epoch, batch):
            X = np.array([data[i]["x"] for i in ids], dtype=np.float64)
            H, out = _forward(p, X)
            n = len(ids)
            g = {k: np.zeros_like(val) for k, val in p.items()}
            dH = np.zeros_like(H)
            loss = 0.0
            for t in ("a", "b"):
                y = np.array([data[i][t] for i in ids])
                Z, P, lse = out[t]
                loss += float((lse - Z[np.arange(n), y]).mean())
                D = P.copy()
                D[np.arange(n), y] -= 1.0
                D /= n
                g[f"A_{t}"] = D.T @ H
                g[f"a_{t}"] = D.sum(0)
                dH += D @ p[f"A_{t}"]
            g["U"] = dH.T @ X
            g["u"] = dH.sum(0)
            norm = math.sqrt(sum(float((x * x).sum()) for x in g.values()))
            coef = 1.0 / (norm + 1e-6)
            if coef < 1.0:
                g = {k: x * coef for k, x in g.items()}
            rate = lr * (total - t_step) / total
            t_step += 1
            for k in p:
                m[k] = 0.9 * m[k] + 0.1 * g[k]
                v[k] = 0.999 * v[k] + 0.001 * g[k] ** 2
                size = rate * math.sqrt(1 - 0.999 ** t_step) / (1 - 0.9 ** t_step)
                p[k] = p[k] - size * m[k] / (np.sqrt(v[k]) + 2e-8)
            losses.append(loss)
        row = {"epoch": epoch, "training_loss": float(np.mean(losses))}
        Xt = np.array([data[i]["x"] for i in test_ids], dtype=np.float64)
        _, out = _forward(p, Xt)
        per_row = np.zeros(len(test_ids))
        for t in ("a", "b"):
            y = np.array([data[i][t] for i in test_ids])
            Z, P, lse = out[t]
            pred = Z.argmax(1)
            row[f"TP_{t}"] = int(((y == 1) & (pred == 1)).sum())
            row[f"TN_{t}"] = int(((y == 0) & (pred == 0)).sum())
            row[f"FP_{t}"] = int(((y == 0) & (pred != 0)).sum())
            row[f"FN_{t}"] = int(((y == 1) & (pred != 1)).sum())
            per_row += lse - Z[np.arange(len(y)), y]
        pos = {i: k for k, i in enumerate(test_ids)}
        batch_means = [np.mean([per_row[pos[i]] for i in ids]) for ids in _batches(test_ids, seed, 20_000 + epoch, batch)]
        row["testing_loss"] = float(np.mean(batch_means))
        report.append(row)
    return report


def test_epoch_loop_matches_brute_force(spark):
    from labelwise.sources import tables as tb
    rows = [r.asDict() for r in tb.embedding_examples(tb.read_table(spark, SF001, "embeddings")).collect()]
    expect = brute_force(rows)
    got = sorted(se.queries()["epoch_loop"](spark, SF001).collect(), key=lambda r: r["epoch"])
    assert len(got) == len(expect) == 2
    for g, e in zip(got, expect):
        for k, val in e.items():
            if isinstance(val, float):
                assert g[k] == pytest.approx(val, rel=1e-9, abs=1e-9), k
            else:
                assert g[k] == val, k
