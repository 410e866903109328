"""Plan regressions: the physical shapes the scale design relies on."""

import io
from contextlib import redirect_stdout

import numpy as np
import pytest

import __spark_entry__ as se
from labelwise.operators import train as tr
from labelwise.operators import linalg as la
from labelwise.sources import tables as tb

from conftest import SF001


def plan(df) -> str:
    buf = io.StringIO()
    with redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


@pytest.fixture(scope="module")
def q():
    return se.queries()


def test_link_labels_has_no_outer_join(spark, q):
    p = plan(q["link_labels"](spark, SF001))
    assert "LeftOuter" not in p and "Join type: Inner" in p and "Join type: LeftAnti" in p
    turns = plan(q["filter_turns"](spark, SF001))
    assert "PushedFilters: [IsNotNull(role), EqualTo(role,user)]" in turns


def test_scans_read_only_needed_columns(spark, q):
    p = plan(q["multi_task_eval"](spark, SF001))
    assert "ReadSchema: struct<doc_id:bigint,text:string,n_chars:bigint>" in p
    assert "lang" not in p.split("ReadSchema: struct<doc_id:bigint,text")[1].split("\n")[0]


def test_vocabulary_lookup_is_broadcast(spark, q):
    p = plan(q["encode_join"](spark, SF001))
    assert "BroadcastHashJoin LeftOuter BuildRight" in p
    assert "SortMergeJoin" not in p


def test_batches_use_range_partitioning(spark, q):
    p = plan(q["assign_batches"](spark, SF001))
    assert "rangepartitioning(shuffle_key" in p
    assert "SinglePartition" not in p


def test_auc_windows_are_spread_by_score_range(spark, q):
    p = plan(q["auc_score"](spark, SF001))
    assert "rangepartitioning(task" in p and "score" in p.split("rangepartitioning(task", 1)[1].split("\n")[0]
    assert "_part" in p.split("rangepartitioning", 1)[1]
    assert "SinglePartition" not in p


def test_gradient_pass_has_one_exchange(spark):
    emb = tb.embedding_examples(tb.read_table(spark, SF001, "embeddings"))
    heads = {"a": tr.Head(np.array(la.formula_weights(2, 64)), np.zeros(2))}
    p = plan(tr.gradient_table(emb, heads, {"a": "a"}, "x"))
    tree = p.split("\n\n\n")[0]
    assert tree.count("Exchange") == 1 and "BroadcastExchange" not in tree
    assert "MapInArrow" in tree or "PythonMapInArrow" in tree
