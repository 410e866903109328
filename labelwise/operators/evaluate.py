"""Evaluation: confusion counts, F1, balanced accuracy, AUC, losses, reports.

Inputs are long form -- one row per (row, task) with truth ``y`` and a hard
prediction ``pred`` (and optionally a real-valued ``score`` and a ``loss``)
-- so every task is evaluated by the same aggregate in one pass: a task is a
grouping key, not copied code.  Each metric is one map-side-combined
aggregate: only a handful of partial counts per task cross the shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _keys(keys) -> list[str]:
    return [keys] if isinstance(keys, str) else list(keys)


def label_outcome(y="y", pred="pred") -> Column:
    """'TP', 'FN', 'TN' or 'FP' for a binary truth; NULL when truth is not 0/1.

    A prediction that differs from the truth -- including a missing one --
    counts against it.
    """
    yc = F.col(y) if isinstance(y, str) else y
    pc = F.col(pred) if isinstance(pred, str) else pred
    hit = pc.eqNullSafe(yc)
    return (F.when((yc == 1) & hit, "TP").when(yc == 1, "FN")
            .when((yc == 0) & hit, "TN").when(yc == 0, "FP"))


def _cell_counts(y: str, pred: str) -> list[Column]:
    yc, pc = F.col(y), F.col(pred)
    return [
        F.count_if((yc == 1) & pc.eqNullSafe(yc)).alias("TP"),
        F.count_if((yc == 0) & pc.eqNullSafe(yc)).alias("TN"),
        F.count_if((yc == 0) & ~pc.eqNullSafe(yc)).alias("FP"),
        F.count_if((yc == 1) & ~pc.eqNullSafe(yc)).alias("FN"),
    ]


def confusion_counts(df: DataFrame, keys=("task",), y: str = "y", pred: str = "pred") -> DataFrame:
    """TP, TN, FP, FN per key, all tasks in one aggregate."""
    return df.groupBy(*_keys(keys)).agg(*_cell_counts(y, pred))


def f1_binary(tp="TP", fp="FP", fn="FN") -> Column:
    """F1 of class 1; 0.0 when there is no positive in truth or prediction."""
    tp, fp, fn = (F.col(c).cast("double") for c in (tp, fp, fn))
    return F.coalesce(F.try_divide(tp * 2.0, tp * 2.0 + fp + fn), F.lit(0.0))


def recall_pos(tp="TP", fn="FN") -> Column:
    return F.try_divide(F.col(tp).cast("double"), (F.col(tp) + F.col(fn)).cast("double"))


def recall_neg(tn="TN", fp="FP") -> Column:
    return F.try_divide(F.col(tn).cast("double"), (F.col(tn) + F.col(fp)).cast("double"))


def balanced_accuracy_binary(tp="TP", tn="TN", fp="FP", fn="FN") -> Column:
    """Mean recall over the classes 0/1 that occur in truth."""
    r1, r0 = recall_pos(tp, fn), recall_neg(tn, fp)
    return (F.when(r1.isNotNull() & r0.isNotNull(), (r1 + r0) / 2.0)
            .when(r1.isNotNull(), r1).otherwise(r0))


def auc_hard(tp="TP", tn="TN", fp="FP", fn="FN") -> Column:
    """ROC AUC of hard 0/1 predictions: (TPR + TNR) / 2; NULL with one class."""
    r1, r0 = recall_pos(tp, fn), recall_neg(tn, fp)
    return F.when(r1.isNotNull() & r0.isNotNull(), (r1 + r0) / 2.0)


def balanced_accuracy(df: DataFrame, keys=("task",), y: str = "y", pred: str = "pred") -> DataFrame:
    """Mean per-class recall over the classes present in truth (any number)."""
    keys = _keys(keys)
    per_class = df.where(F.col(y).isNotNull()).groupBy(*keys, y).agg(
        F.avg(F.col(pred).eqNullSafe(F.col(y)).cast("double")).alias("recall"))
    return per_class.groupBy(*keys).agg(F.avg("recall").alias("BA"))


def flat_accuracy(df: DataFrame, keys=("task",), y: str = "y", pred: str = "pred") -> DataFrame:
    """Share of rows whose prediction equals the label."""
    return df.groupBy(*_keys(keys)).agg(
        F.avg(F.col(pred).eqNullSafe(F.col(y)).cast("double")).alias("accuracy"),
        F.count(F.lit(1)).alias("n"))


def multi_task_eval(df: DataFrame, keys=("task",), y: str = "y", pred: str = "pred") -> DataFrame:
    """Confusion counts, F1, balanced accuracy and hard AUC for every key."""
    counts = df.groupBy(*_keys(keys)).agg(F.count(F.lit(1)).alias("n"), *_cell_counts(y, pred))
    return counts.select(*_keys(keys), "n", "TP", "TN", "FP", "FN",
                         f1_binary().alias("F1"), balanced_accuracy_binary().alias("BA"), auc_hard().alias("AUC"))


def auc_score(df: DataFrame, keys=("task",), y: str = "y", score: str = "score", partitions: int | None = None) -> DataFrame:
    """ROC AUC of real-valued scores (ties count one half), per key.

    Rows are first reduced to one row per distinct (key, score) with positive
    and negative counts.  These are range-partitioned by (key, score), so a
    key spreads over as many partitions as its scores need and a NULL key is a
    key like any other.  A window inside each (partition, key) gives its part
    of the rank sum; a window over the totals of a key's partitions (at most
    ``partitions`` rows) adds the negatives of earlier partitions.
    """
    keys = _keys(keys)
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    per_score = (df.where(F.col(y).isin(0, 1) & F.col(score).isNotNull())
                 .groupBy(*keys, score)
                 .agg(F.count_if(F.col(y) == 1).alias("n_pos"), F.count_if(F.col(y) == 0).alias("n_neg")))
    ranged = per_score.repartitionByRange(n, *keys, score).withColumn("_part", F.spark_partition_id())
    local = Window.partitionBy(*keys, "_part").orderBy(score).rowsBetween(Window.unboundedPreceding, -1)
    below = ranged.withColumn("_neg_local", F.coalesce(F.sum("n_neg").over(local), F.lit(0)))
    per_part = below.groupBy(*keys, "_part").agg(
        F.sum("n_pos").alias("_p"), F.sum("n_neg").alias("_n"),
        F.sum(F.col("n_pos") * (F.col("_neg_local") + F.col("n_neg") * 0.5)).alias("_u"))
    # every positive of a partition is above all negatives of the key's earlier partitions
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    per_part = per_part.withColumn("_neg_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    out = per_part.groupBy(*keys).agg(
        F.sum("_p").alias("n_pos"), F.sum("_n").alias("n_neg"),
        F.sum(F.col("_u") + F.col("_p") * F.col("_neg_before")).alias("_u"))
    return out.select(*keys, "n_pos", "n_neg",
                      F.when((F.col("n_pos") > 0) & (F.col("n_neg") > 0),
                             F.col("_u") / (F.col("n_pos").cast("double") * F.col("n_neg"))).alias("AUC"))


def batch_mean_loss(df: DataFrame, keys=(), batch: str = "batch_id", loss: str = "loss") -> DataFrame:
    """Epoch loss as the mean of per-batch means (a short last batch weighs
    as much as a full one), beside the plain mean over rows."""
    keys = _keys(keys)
    per_batch = df.groupBy(*keys, batch).agg(F.avg(loss).alias("_bm"), F.count(F.lit(1)).alias("_n"))
    return per_batch.groupBy(*keys).agg(
        F.avg("_bm").alias("batch_mean_loss"),
        (F.sum(F.col("_bm") * F.col("_n")) / F.sum("_n")).alias("row_mean_loss"),
        F.count(F.lit(1)).alias("n_batches"))


def epoch_report(metrics: DataFrame, tasks: Sequence[str], index=("epoch",),
                 measures=("TP", "TN", "FP", "FN", "F1", "BA", "AUC")) -> DataFrame:
    """One wide row per index value with ``<measure>_<task>`` columns.

    ``tasks`` is given explicitly so the pivot needs no extra pass to find
    the distinct task names.
    """
    index = _keys(index)
    wide = metrics.groupBy(*index).pivot("task", list(tasks)).agg(*[F.first(m).alias(m) for m in measures])
    renamed = [F.col(f"`{t}_{m}`").alias(f"{m}_{t}") for t in tasks for m in measures]
    return wide.select(*index, *renamed)


def align_pred_truth(predictions: DataFrame, truth: DataFrame, on=("row_id", "task")) -> DataFrame:
    """Pair each prediction with its truth by key (rows have no position)."""
    return predictions.join(truth, list(on))


def flatten_batches(batches: DataFrame, batch: str = "batch_id", arrays=("pred", "y")) -> DataFrame:
    """Per-batch arrays back to one row per element, with its position."""
    zipped = F.arrays_zip(*[F.col(a) for a in arrays])
    return batches.select(batch, F.posexplode(zipped).alias("pos", "_e")).select(
        batch, "pos", *[F.col("_e")[a].alias(a) for a in arrays])
