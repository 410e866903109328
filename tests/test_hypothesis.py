"""Randomised checks of column functions and metrics against plain Python.

Every generated batch becomes one DataFrame evaluated in one Spark job.
"""

import math
import re

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from labelwise.functions import arrays as A
from labelwise.functions.text import extract_id, tokens
from labelwise.operators import evaluate as ev

SETTINGS = settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))

int_lists = st.lists(st.lists(st.integers(min_value=0, max_value=50), max_size=12), min_size=1, max_size=30)


@SETTINGS
@given(int_lists, st.integers(min_value=1, max_value=10))
def test_pad_mask_argmax(spark, arrays, n):
    df = spark.createDataFrame([(i, a) for i, a in enumerate(arrays)], "i int, a array<int>")
    got = df.select("i", A.pad_truncate("a", n).alias("p"), A.attention_mask("a").alias("m"),
                    A.argmax("a").alias("k")).orderBy("i").collect()
    for r, a in zip(got, arrays):
        assert r["p"] == (a[:n] + [0] * max(0, n - len(a)))
        assert r["m"] == [int(x > 0) for x in a]
        assert r["k"] == (a.index(max(a)) if a else None)


names = st.lists(st.one_of(st.none(), st.text(alphabet="ab_x0123456789.", max_size=12)), min_size=1, max_size=30)


@SETTINGS
@given(names)
def test_extract_id_null_mode(spark, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, name string")
    got = [r["v"] for r in df.select("i", extract_id("name", mode="null").alias("v")).orderBy("i").collect()]
    for v, g in zip(values, got):
        m = re.search("[0-9]{3}", v) if v is not None else None
        assert g == (int(m.group()) if m else None)


labels = st.lists(st.tuples(st.sampled_from(["t1", "t2"]), st.integers(0, 1), st.integers(0, 1)), min_size=1, max_size=60)


@SETTINGS
@given(labels)
def test_metrics_against_python(spark, rows):
    df = spark.createDataFrame([(i, t, y, p) for i, (t, y, p) in enumerate(rows)], "row_id int, task string, y int, pred int")
    got = {r["task"]: r for r in ev.multi_task_eval(df).collect()}
    for task in {t for t, _, _ in rows}:
        ys = [(y, p) for t, y, p in rows if t == task]
        tp = sum(1 for y, p in ys if y == 1 and p == 1)
        tn = sum(1 for y, p in ys if y == 0 and p == 0)
        fp = sum(1 for y, p in ys if y == 0 and p == 1)
        fn = sum(1 for y, p in ys if y == 1 and p == 0)
        r = got[task]
        assert (r["TP"], r["TN"], r["FP"], r["FN"]) == (tp, tn, fp, fn)
        f1 = 2 * tp / (2 * tp + fp + fn) if (2 * tp + fp + fn) else 0.0
        assert r["F1"] == pytest.approx(f1)
        recalls = [x for x in (tp / (tp + fn) if tp + fn else None, tn / (tn + fp) if tn + fp else None) if x is not None]
        assert r["BA"] == pytest.approx(sum(recalls) / len(recalls))
        assert (r["AUC"] is None) == (len(recalls) < 2)


vectors = st.lists(st.lists(st.floats(-20, 20, allow_nan=False), min_size=2, max_size=5), min_size=1, max_size=20)


@SETTINGS
@given(vectors)
def test_softmax_and_cross_entropy(spark, zs):
    df = spark.createDataFrame([(i, z, i % len(z)) for i, z in enumerate(zs)], "i int, z array<double>, y int")
    got = df.select("i", A.softmax("z").alias("p"), A.cross_entropy("z", "y").alias("l")).orderBy("i").collect()
    for r, (i, z) in zip(got, enumerate(zs)):
        z = np.array(z)
        e = np.exp(z - z.max())
        assert r["p"] == pytest.approx((e / e.sum()).tolist(), abs=1e-12)
        assert r["l"] == pytest.approx(float(z.max() + np.log(e.sum()) - z[i % len(z)]), abs=1e-9)
        assert math.isclose(sum(r["p"]), 1.0, abs_tol=1e-12)


texts = st.lists(st.text(alphabet="abcXYZ éÜ1-.,\n\t'", max_size=40), min_size=1, max_size=20)


@SETTINGS
@given(texts)
def test_tokens_against_python(spark, values):
    import regex
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, text string")
    got = [r["t"] for r in df.select("i", tokens("text").alias("t")).orderBy("i").collect()]
    for v, g in zip(values, got):
        assert g == [t for t in regex.split(r"[^\p{L}\p{N}]+", v.lower()) if t]


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.integers(min_value=1, max_value=300), st.integers(min_value=1, max_value=64), st.integers(1, 6))
def test_assign_batches_sizes(spark, n_rows, size, parts):
    from labelwise.operators import sample as smp
    df = spark.range(n_rows).withColumnRenamed("id", "row_id").repartition(parts)
    b = smp.assign_batches(df, size, partitions=parts)
    counts = sorted((r["batch_id"], r["count"]) for r in b.groupBy("batch_id").count().collect())
    assert [c for _, c in counts] == [size] * (n_rows // size) + ([n_rows % size] if n_rows % size else [])
    assert len(counts) == math.ceil(n_rows / size)
    assert sorted(r["rank"] for r in b.select("rank").collect()) == list(range(n_rows))
