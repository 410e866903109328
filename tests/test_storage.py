"""Bad records, retried appends, tables stored side by side, attention by segments, encoding from one tokenisation."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from labelwise.operators import encode as enc
from labelwise.operators import linalg as la
from labelwise.operators import prep
from labelwise.sources import colocated as co
from labelwise.sources import results as rs
from labelwise.sources import transcripts as ts


def test_every_line_is_good_or_kept_with_a_reason(spark, tmp_dir):
    lines = ["0\t1\tuser\tHello \"you\t001_T.csv", "x\t1\tuser\tHi\t001_T.csv", "2\t1\tuser\tshort", "3\t1\tuser\tlong\t001_T.csv\tmore", "4\t1\tuser\t\t001_T.csv",
             "5\t1\tuser\tno name\t", "", "7\t\t\tnull label\t002_T.csv", "8\t99999999999\tuser\tover\t1"]
    with open(f"{tmp_dir}/t.csv", "w") as f:
        f.write("\n".join(lines) + "\n")
    good, bad = ts.scan_checked(spark, f"{tmp_dir}/t.csv", required=("audio_features",))
    assert sorted(r["index"] for r in good.collect()) == [0, 4, 7]
    assert good.columns == ["index", "label", "label_notes", "sentence", "audio_features"]
    assert Counter((r.reason, r.line) for r in bad.collect()) == Counter([("malformed", lines[k]) for k in (1, 2, 3, 8)] + [("missing", lines[5])])  # the empty line is no row
    assert good.select("sentence").count() == 3 and bad.select("reason").count() == 5  # whatever the query uses
    with pytest.raises(ValueError, match="above the limit"):
        ts.quarantine(bad, f"{tmp_dir}/q", 0.1, good)
    assert spark.read.parquet(f"{tmp_dir}/q").count() == 5
    with pytest.raises(ValueError):
        ts.scan_checked(spark, tmp_dir, required=("nothing",))


def test_a_run_stored_again_is_there_once(spark, tmp_dir):
    def report(run, f1, training="MTL", epochs=2):
        return spark.createDataFrame([("m", "d", "q", training, run, e, f1) for e in range(epochs)],
                                     "model string, data string, question string, training string, run int, epoch int, F1 double")

    path = f"{tmp_dir}/runs"
    rs.replace_runs(report(0, 0.1).unionByName(report(1, 0.2)), path)
    rs.replace_runs(report(1, 0.3, epochs=3), path)
    rs.replace_runs(report(1, 0.3, epochs=3), path)
    rs.replace_runs(report(1, 0.4, "STL"), path)
    got = sorted((r.training, r.run, r.epoch, r.F1) for r in rs.read_results(spark, path).collect())
    assert got == sorted([("MTL", 0, e, 0.1) for e in range(2)] + [("MTL", 1, e, 0.3) for e in range(3)] + [("STL", 1, e, 0.4) for e in range(2)])
    with pytest.raises(ValueError):
        rs.replace_runs(report(0, 0.1).drop("run"), path)


@pytest.mark.parametrize("rows_per_part", [1_000_000, 7])
def test_linking_stored_tables(spark, rows_per_part):
    key, rnd = prep.KEY, random.Random(4)
    labels = [(k, k % 2) for k in range(30)] + [(3, 9), (None, 5)]
    turns = [(rnd.choice([0, 1, 2, 3, 3, 3, 3, 40, None]), f"t{i}") for i in range(300)] + [(4, "same")] * 50
    a, b = spark.createDataFrame(labels, f"{key} int, y int"), spark.createDataFrame(turns, f"{key} int, sentence string")
    tables = co.colocate(a, b, buckets=5, rows_per_part=rows_per_part)
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for got, want in ((co.linked(tables), prep.link_labels(a, b)), (co.matched(tables), prep.link_labels_matched(a, b)), (co.unlinked(tables), prep.unlinked_labels(a, b))):
            assert Counter(got.collect()) == Counter(want.select(got.columns).collect())
        plan = co.matched(tables)._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan
        if rows_per_part == 7:
            held = tables.transcripts.where(F.col(key) == 4).groupBy(co.PART).count().collect()
            assert len(held) > 3 and max(r["count"] for r in held) < 25  # equal rows of a large key are dealt over its parts too
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
        tables.drop()
    with pytest.raises(ValueError):
        co.colocate(a.withColumn(co.PART, F.lit(1)), b)


@pytest.mark.parametrize("batch", [10_000, 7])
def test_attention_by_segments(spark, batch):
    rnd = np.random.default_rng(2)
    rows = [(s, p, rnd.normal(size=3).tolist(), int(p % 3 != 1)) for s in [*range(12), None] for p in range(1 if s == 5 else 50 if s == 6 else 8)]
    rows.append((0, 99, None, 1))
    df = spark.createDataFrame(rows, "seq_id int, pos int, vec array<double>, m int").repartition(4)
    w1, b1, w2, b2 = rnd.normal(size=(4, 3)), rnd.normal(size=4), rnd.normal(size=(2, 4)) * 200, rnd.normal(size=2)
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        for mask in (None, "m"):
            for kind in ("network", "scores", "first"):
                net = [x.tolist() for x in (w1, b1, w2, b2)]
                args = {"network": {"network": net}, "scores": {"scores": la.hop_scores("vec", *net)}, "first": {}}[kind]
                got = {r.seq_id: r.pooled for r in la.attention_pool(df, vec="vec", mask=mask, **args).collect()}
                for s in {r[0] for r in rows}:
                    xs = np.array([r[2] for r in rows if r[0] == s and r[2] is not None and (mask is None or r[3] == 1)])
                    z = np.tanh(xs @ w1.T + b1) @ w2.T + b2 if kind != "first" else xs[:, :1]
                    e = np.exp(z - z.max(axis=0))
                    np.testing.assert_allclose(got[s], ((e / e.sum(axis=0)).T @ xs).ravel(), rtol=1e-9, atol=1e-12)
        plan = la.attention_pool(df, vec="vec")._jdf.queryExecution().executedPlan().toString()
        assert "Generate" not in plan
        assert la.attention_pool(df.limit(0), vec="vec").count() == 0
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    with pytest.raises(ValueError):
        la.attention_pool(df, scores=F.array(F.lit(1.0)), network=(1, 2, 3, 4))


def test_encoding_tokenises_once_and_spreads_one_split(spark):
    df = spark.createDataFrame([(i, f"Some words {i % 7}, some {i}" if i else None) for i in range(50)], "row_id int, text string").coalesce(1)
    assert enc.spread(df, 4).rdd.getNumPartitions() == 4 and enc.spread(df, None) is df
    assert enc.spread(df.repartition(6), 4).rdd.getNumPartitions() == 6
    coded, vocab = enc.encode_corpus(df, 20, max_len=None, partitions=4)
    plan = coded._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all" not in plan  # read from the token arrays
    want = enc.encode_ids(df, enc.build_vocab(df, size=20))
    assert sorted(map(tuple, coded.collect()), key=lambda r: r[0]) == sorted(map(tuple, want.collect()), key=lambda r: r[0])
