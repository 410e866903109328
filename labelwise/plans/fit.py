"""Training runs: epochs of gradient steps, evaluation, the epoch report.

One run = (model, tasks, regime, learning rate, batch size, run number).
A full-batch epoch is one Spark aggregate over the persisted training
features.  An epoch of mini-batches is one barrier job, whatever the number
of steps (see :mod:`labelwise.plans.steps`).  Then the evaluation of the test
rows with the epoch's weights is built.  Evaluations of all epochs are combined into
one plan and run once at the end.  Only gradients (classes x features per
task), counts and the report reach the driver.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field, replace

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from labelwise.operators import evaluate as ev
from labelwise.operators import sample as smp
from labelwise.operators import train as tr
from labelwise.plans.steps import GradientSums, QueryPass, Stack, Trainer, run_epoch

REGIMES = ("STL", "MTL", "MTL_awl", "MTL_meta")
#: Tables that runs know; an unknown one is an error.  Extend the set to register another.
DATASETS = {"documents", "embeddings"}


@dataclass
class RunConfig:
    model: str = "text_stats"
    tasks: Sequence[str] = ("quality", "toxic")
    regime: str = "MTL"
    epochs: int = 5
    lr: float = 1e-3
    batch_size: int | None = None      # None = one full-batch step per epoch
    run: int = 0
    seed: int = 42
    data: str = "documents"
    question: str = "all"
    hidden: int = 8
    classes: int | dict = 2            # classes per task (int for all, or task -> count)
    optimizer: str = "adamw"
    clip: float | None = tr.CLIP_NORM
    init: str = "formula"
    alpha: float = 1.0                 # meta step on task weights
    accumulate: bool = False           # meta: gradients accumulate over the epoch (source behaviour)
    per_task_shared: bool = False      # meta: shared-layer gradients of each task's own loss, not of the summed one
    faithful_difference: bool = False  # meta: difference step 1 only (source behaviour)
    max_steps: int | None = None       # bound of gradient steps per epoch, by larger batches; None: one step per batch
    schedule: bool = True              # linear decay of the rate to zero
    eps: float | None = None           # optimizer epsilon; None: the regime's own
    keep_params: bool = False          # parameters after every step in the history
    one_job: bool | None = None        # mini-batches: all steps of an epoch as one barrier job (None: where Spark can)
    step_tasks: int | None = None      # tasks of that job; None: by the number of rows
    history: bool = True               # keep the losses of every step on the driver
    checkpoint: bool = False           # cut lineage of the feature table with checkpoint()


@dataclass
class RunResult:
    model: tr.LinearModel
    history: list[dict] = field(default_factory=list)
    task_weights: list[dict] = field(default_factory=list)
    report: DataFrame | None = None


def _pin(df: DataFrame, checkpoint: bool) -> DataFrame:
    return df.checkpoint() if checkpoint else df.persist(StorageLevel.MEMORY_AND_DISK)


ROWS_PER_PARTITION = 200_000


def _partitions_for(df: DataFrame, n_rows: int) -> int:
    """Range partitions for ``n_rows``: about ``ROWS_PER_PARTITION`` each,
    at most the session's shuffle partitions.  A step filters one batch out
    of the cached ranked rows, so every partition is one more task per step."""
    cap = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(1, min(cap, -(-n_rows // ROWS_PER_PARTITION)))


def _group(batches: int, cfg: RunConfig) -> int:
    """Batches that one step takes together."""
    return 1 if cfg.max_steps is None else -(-batches // cfg.max_steps) or 1


class _Steps:
    """The row sets of one epoch's gradient steps, made one at a time.

    The rows are ranked and cached once.  With ``max_steps``, an epoch of more batches takes consecutive batches together,
    so the number of jobs stays bounded however many rows there are; the report then has the batch size that results.
    """

    def __init__(self, rows: DataFrame, cfg: RunConfig, epoch: int, id_col: str, n_rows: int | None):
        self.rows, self.batched, self.n = rows, None, 1
        if cfg.batch_size is None:
            return
        n_rows = rows.count() if n_rows is None else n_rows
        ranked = smp.assign_batches(rows, cfg.batch_size, id_col, cfg.seed, epoch, partitions=_partitions_for(rows, n_rows))
        # Range partitioning by the order key already leaves every partition
        # sorted by batch, so the cached column batches of other steps are
        # skipped by their min/max statistics when a step filters on its batch.
        self.batched = ranked.persist(StorageLevel.MEMORY_AND_DISK)
        batches = smp.n_batches(self.batched.count(), cfg.batch_size)
        smp.release(ranked)
        self.group = _group(batches, cfg)
        self.n = -(-batches // self.group)

    def __iter__(self):
        if self.batched is None:
            yield self.rows
            return
        for k in range(self.n):
            yield self.batched.where(F.col("batch_id").between(k * self.group, (k + 1) * self.group - 1))

    def release(self) -> None:
        if self.batched is not None:
            self.batched.unpersist()


def alignment(query: GradientSums, support: GradientSums) -> tuple[dict[str, float], dict[tuple[int, int], float]]:
    """With M_t the matrix of all dot products of query and support vectors of task t: the sum of M_t's cells, and the
    products <M_t, M_u> by the tasks' places.  Both follow from the sums alone."""
    cells = {t: float(query.total[t] @ support.total[t]) for t in query.tasks}
    # <M_t, M_u> = sum over steps of (q_t . s_t)(q_u . s_u) = trace((sum q_t q_u') (sum s_u s_t')')
    at = {t: i for i, t in enumerate(query.tasks)}
    dots = {(at[t], at[u]): float((query.gram[t, u] * support.gram[t, u]).sum()) for t, u in query.gram}
    return cells, dots


def fit_tagged(tagged: DataFrame, labels: dict[str, str], cfg: RunConfig, split_col: str = "split",
               train_value: str = "train", test_value: str = "test", query_value: str = "query",
               x: str = "x", id_col: str = "row_id") -> RunResult:
    """:func:`fit` on one table whose ``split_col`` says train / test (and
    query, for the meta regime).

    The table is read once and cached with only the columns training needs;
    every split is then a filter of that cache, so the source (scan, joins,
    features) is computed once for all splits rather than once per split.
    """
    cols = [id_col, x, split_col] + [labels[t] for t in cfg.tasks]
    pinned = _pin(tagged.select(*cols), cfg.checkpoint)
    pinned.count()
    part = F.col(split_col)
    try:
        return fit(pinned.where(part == train_value), pinned.where(part == test_value), labels, cfg, x, id_col,
                   support=pinned.where(part == train_value) if cfg.regime == "MTL_meta" else None,
                   query=pinned.where(part == query_value) if cfg.regime == "MTL_meta" else None,
                   pinned=True)
    finally:
        pinned.unpersist()


def fit(train: DataFrame, test: DataFrame, labels: dict[str, str], cfg: RunConfig, x: str = "x",
        id_col: str = "row_id", support: DataFrame | None = None, query: DataFrame | None = None,
        pinned: bool = False) -> RunResult:
    """Train for ``cfg.epochs`` and evaluate on ``test`` after every epoch.

    Regimes: STL (one task), MTL (sum of task losses), MTL_awl (learned
    uncertainty weights), MTL_meta (task weights moved each epoch by the
    alignment of support and query gradients; ``support``/``query`` default
    to ``train``/``test``).
    """
    if cfg.data not in DATASETS:
        raise ValueError(f"unknown dataset {cfg.data!r}; known {sorted(DATASETS)}")
    if cfg.regime not in REGIMES:
        raise ValueError(f"unknown regime {cfg.regime!r}; known {REGIMES}")
    tasks = list(cfg.tasks)
    if cfg.regime == "STL" and len(tasks) != 1:
        raise ValueError("STL trains exactly one task")
    cols = [id_col, x] + [labels[t] for t in tasks]
    # ``pinned``: the inputs are already views of one cached table (see fit_tagged)
    pin = (lambda df: df) if pinned else (lambda df: _pin(df, cfg.checkpoint))
    fit_rows = support if (cfg.regime == "MTL_meta" and support is not None) else train
    fit_rows = pin(fit_rows.select(*cols))
    query_rows = None
    if cfg.regime == "MTL_meta":
        query_rows = pin((query if query is not None else test).select(*cols))
    test_rows = pin(test.select(*cols))
    n_fit = fit_rows.count()
    n_test = test_rows.count() if cfg.batch_size is not None else None
    d = len(fit_rows.select(x).first()[0])
    group = _group(1 if cfg.batch_size is None else smp.n_batches(n_fit, cfg.batch_size), cfg)
    trainer = _trainer(cfg, d, n_fit)
    model = trainer.model
    result = RunResult(model)
    evals = []
    result_pins: list[DataFrame] = []
    for epoch in range(cfg.epochs):
        trainer.begin_epoch()
        history = _all_steps(fit_rows, trainer, cfg, epoch, id_col, labels, x, n_fit)
        result.history += [{"epoch": epoch, **h} for h in history]
        train_loss = trainer.loss / trainer.steps
        if cfg.regime == "MTL_meta":
            query_loss = _meta_update(query_rows, trainer, cfg, epoch, id_col, labels, x)
            result.task_weights.append({"epoch": epoch, **trainer.w_k, "query_loss": query_loss})
        evals.append(_evaluate(test_rows, model, labels, cfg, epoch, id_col, x, train_loss,
                               awl_s=trainer.s.copy() if cfg.regime == "MTL_awl" else None, pins=result_pins, n_rows=n_test))
    metrics = evals[0]
    for e in evals[1:]:
        metrics = metrics.unionByName(e)
    report = _report(metrics, tasks, cfg if group == 1 else replace(cfg, batch_size=cfg.batch_size * group))
    # The report is one row per epoch: bring it back once, then release every cache.
    spark = train.sparkSession
    result.report = spark.createDataFrame(report.collect(), report.schema)
    own = [] if pinned else [fit_rows, query_rows, test_rows]
    for df in (*own, *result_pins):
        if df is not None:
            df.unpersist()
    return result


def _trainer(cfg: RunConfig, d: int, n_rows: int) -> Trainer:
    """The training state of a run at its start."""
    tasks = list(cfg.tasks)
    model = tr.LinearModel.create(tasks, cfg.classes if isinstance(cfg.classes, int) else {t: cfg.classes[t] for t in tasks}, d,
                                  None if cfg.regime == "STL" else cfg.hidden, cfg.init)
    batches = 1 if cfg.batch_size is None else smp.n_batches(n_rows, cfg.batch_size)
    eps = cfg.eps if cfg.eps is not None else tr.ADAM_EPS_DEFAULT if cfg.regime == "MTL_awl" else tr.ADAM_EPS
    opt = tr.Optimizer(cfg.optimizer, cfg.lr, -(-batches // _group(batches, cfg)) * cfg.epochs, schedule=cfg.schedule, no_decay=("s",), eps=eps)
    return Trainer(model, opt, tasks, cfg.regime, cfg.clip, cfg.accumulate, cfg.faithful_difference, cfg.keep_params, cfg.history, cfg.per_task_shared)


def _one_job(df: DataFrame, cfg: RunConfig) -> bool:
    """Whether the steps of an epoch run as one barrier job.  All its tasks run at the same time, which Spark does not offer
    together with dynamic allocation; then, or on request, every step is a job."""
    if cfg.batch_size is None or cfg.one_job is False:
        return False
    return df.sparkSession.sparkContext.getConf().get("spark.dynamicAllocation.enabled", "false") != "true"


def _all_steps(rows: DataFrame, machine: Trainer | QueryPass | Stack, cfg: RunConfig, epoch: int, id_col: str, labels: dict[str, str], x: str,
               n_rows: int | None = None) -> list[dict]:
    """The steps of one pass over ``rows`` in the order of the epoch; ``machine`` has their state.  Returns their history."""
    own = machine.columns(labels)
    if _one_job(rows, cfg):
        n_rows = rows.count() if n_rows is None else n_rows
        # all tasks of a barrier stage need a slot at once
        slots = min(_partitions_for(rows, n_rows) if cfg.step_tasks is None else cfg.step_tasks, rows.sparkSession.sparkContext.defaultParallelism)
        ranked = smp.assign_batches(rows, cfg.batch_size, id_col, cfg.seed, epoch, partitions=slots)
        try:
            return run_epoch(ranked, ranked._labelwise_counts, machine, own, x, cfg.batch_size * _group(smp.n_batches(n_rows, cfg.batch_size), cfg))
        finally:
            smp.release(ranked)
    steps = _Steps(rows, cfg, epoch, id_col, n_rows)
    history = [machine.step(tr.batch_gradient(r, machine.heads(), own, x)) for r in steps]
    steps.release()
    return [h for h in history if h is not None]


def _meta_update(query_rows, trainer: Trainer, cfg, epoch, id_col, labels, x) -> float:
    """Align support and query gradients and move the task weights; the mean query loss.

    With ``accumulate`` the query gradients go on from the support's: nothing is reset within an epoch.  The weights' step is scaled
    by the least-norm point of the alignment matrices, for any number of tasks.
    """
    tasks, passed = trainer.tasks, QueryPass(trainer)
    _all_steps(query_rows, passed, cfg, 10_000 + epoch, id_col, labels, x)
    cells, dots = alignment(passed.query, trainer.support)
    gram = np.array([[dots[min(i, j), max(i, j)] for j in range(len(tasks))] for i in range(len(tasks))])
    scale = tr.min_norm_point(gram)
    trainer.w_k = {t: trainer.w_k[t] + cfg.alpha * float(w) * cells[t] for t, w in zip(tasks, scale)}
    return passed.loss / passed.steps


def _evaluate(test, model, labels, cfg, epoch, id_col, x, train_loss, awl_s=None, pins=None,
              n_rows=None) -> DataFrame:
    """Metrics of one epoch in long form, evaluated lazily.

    Test loss as in the source loop: per test batch the (weighted) sum of the
    task losses, averaged over batches; with learned weights the weighting
    and its regulariser apply to the test loss too.  With one full batch this
    is the sum over tasks of each task's mean loss, which the same aggregate
    as the confusion counts yields; with mini-batches the batches are formed
    from the epoch's shuffle of the test rows.
    """
    tasks = list(cfg.tasks)
    scored = tr.score_batch(test, model, {t: labels[t] for t in tasks}, x, id_col)
    reg = 0.0
    lam = {t: 1.0 for t in tasks}
    if awl_s is not None:
        lam = {t: 1.0 / (2 * si * si) for t, si in zip(tasks, awl_s)}
        reg = float(sum(np.log(1 + si * si) for si in awl_s))
    weight = F.coalesce(*[F.when(F.col("task") == t, F.lit(lam[t])) for t in tasks])
    if cfg.batch_size is None:
        counts = scored.groupBy("task").agg(F.count(F.lit(1)).alias("n"), *ev._cell_counts("y", "pred"),
                                            F.avg(F.col("loss") * weight).alias("_task_loss"))
        # one row per task: the window sums the task losses of this epoch
        metrics = counts.withColumn("epoch", F.lit(epoch)).select(
            "epoch", "task", "n", "TP", "TN", "FP", "FN", ev.f1_binary().alias("F1"),
            ev.balanced_accuracy_binary().alias("BA"), ev.auc_hard().alias("AUC"),
            (F.sum("_task_loss").over(Window.partitionBy("epoch")) + F.lit(reg)).alias("testing_loss"))
        return metrics.withColumn("training_loss", F.lit(float(train_loss)))
    metrics = ev.multi_task_eval(scored, keys=["task"])
    per_row = scored.groupBy(id_col).agg(F.sum(F.col("loss") * weight).alias("loss"))
    keyed = smp.seeded_shuffle(test.select(id_col), id_col, cfg.seed, 20_000 + epoch)
    ranked = smp.global_rank(keyed, ["shuffle_key", id_col],
                             partitions=_partitions_for(test, n_rows if n_rows is not None else test.count()))
    if pins is not None:
        pins.append(ranked._labelwise_pinned)
    per_row = per_row.join(ranked.select(id_col, F.floor(F.col("rank") / cfg.batch_size).alias("batch_id")), id_col)
    test_loss = ev.batch_mean_loss(per_row, keys=[], batch="batch_id", loss="loss").select(
        (F.col("batch_mean_loss") + F.lit(reg)).alias("testing_loss"), F.lit(epoch).alias("epoch"))
    return (metrics.withColumn("epoch", F.lit(epoch)).join(test_loss, "epoch")
            .withColumn("training_loss", F.lit(float(train_loss))))


def _report(metrics: DataFrame, tasks: Sequence[str], cfg: RunConfig) -> DataFrame:
    wide = ev.epoch_report(metrics, tasks, index=["epoch", "training_loss", "testing_loss"])
    return tag_run(wide, cfg)


def tag_run(df: DataFrame, cfg: RunConfig) -> DataFrame:
    """Repeat the run configuration on every report row."""
    tags = {"model": F.lit(cfg.model), "run": F.lit(cfg.run), "lr": F.lit(float(cfg.lr)),
            "batch_size": F.lit(cfg.batch_size if cfg.batch_size is not None else -1),
            "data": F.lit(cfg.data), "question": F.lit(cfg.question), "training": F.lit(cfg.regime)}
    return df.withColumns(tags)


#: What runs have to share to take their steps together: rows, order and number of the steps.
STACKED_BY = ("epochs", "batch_size", "seed", "max_steps", "one_job", "step_tasks", "checkpoint")


def run_grid(configs: Sequence[RunConfig], prepare, results_path: str | None = None, stacked: bool = True) -> DataFrame:
    """Run every configuration; ``prepare(cfg) -> (train, test, labels)``.

    Configurations on the same tables that take the same number of steps on the same batches run together: a step
    multiplies the rows with the heads of all of them, so the passes over the data and the jobs do not grow with the number of
    configurations.  The meta regime, whose passes are its own, runs alone, and so does everything without ``stacked``.
    Reports share the columns of their task set and are combined by name, in the order of ``configs``.
    With ``results_path`` every run's rows are also appended there (partitioned by model, data, question and regime).
    """
    from labelwise.sources.results import append_results

    prepared = [prepare(cfg) for cfg in configs]
    groups: dict[tuple, list[int]] = {}
    for k, (cfg, (train, test, labels)) in enumerate(zip(configs, prepared)):
        alone = not stacked or cfg.regime == "MTL_meta"
        key = (k,) if alone else (id(train), id(test), tuple(sorted(labels.items())), *(getattr(cfg, f) for f in STACKED_BY))
        groups.setdefault(key, []).append(k)
    reports: dict[int, DataFrame] = {}
    for members in groups.values():
        train, test, labels = prepared[members[0]]
        if len(members) == 1:
            reports[members[0]] = fit(train, test, labels, configs[members[0]]).report
        else:
            reports |= dict(zip(members, fit_stacked(train, test, labels, [configs[k] for k in members])))
        if results_path is not None:
            for k in members:
                append_results(reports[k], results_path)
    out = reports[0]
    for k in range(1, len(configs)):
        out = out.unionByName(reports[k], allowMissingColumns=True)
    return out


def fit_stacked(train: DataFrame, test: DataFrame, labels: dict[str, str], configs: Sequence[RunConfig], x: str = "x", id_col: str = "row_id") -> list[DataFrame]:
    """Reports of runs that differ in tasks, regime, rate, start, optimizer, hidden size or clipping, from shared passes over the data.

    Per epoch one pass (full batch) or one barrier job (mini-batches) for all of them, and one evaluation of all epochs and runs at the end: the
    heads of every epoch and run are multiplied with each test batch.  What is held is (runs x epochs) times a model.
    """
    cfg = configs[0]
    for c in configs:
        if any(getattr(c, f) != getattr(cfg, f) for f in STACKED_BY):
            raise ValueError("stacked runs must take the same steps")
        if c.regime not in REGIMES or c.regime == "MTL_meta":
            raise ValueError(f"regime {c.regime!r} cannot be stacked")
        if c.data not in DATASETS:
            raise ValueError(f"unknown dataset {c.data!r}; known {sorted(DATASETS)}")
        if c.regime == "STL" and len(c.tasks) != 1:
            raise ValueError("STL trains exactly one task")
    tasks = list(dict.fromkeys(t for c in configs for t in c.tasks))
    rows = _pin(train.select(id_col, x, *dict.fromkeys(labels[t] for t in tasks)), cfg.checkpoint)
    n_rows, d = rows.count(), len(rows.select(x).first()[0])
    stack = Stack([_trainer(c, d, n_rows) for c in configs])
    heads: dict[str, tr.Head] = {}
    told: dict[str, tuple[int, int, str, float, float, float]] = {}  # per head: epoch, run, task, weight of its test loss, regulariser, training loss
    for epoch in range(cfg.epochs):
        for m in stack.machines:
            m.begin_epoch()
        _all_steps(rows, stack, cfg, epoch, id_col, labels, x, n_rows)
        for k, m in enumerate(stack.machines):
            lam, reg = _test_weights(m)
            for t, h in m.heads().items():
                heads[f"{epoch}|{k}|{t}"] = h
                told[f"{epoch}|{k}|{t}"] = (epoch, k, t, float(lam[t]), reg, float(m.loss / m.steps))
    rows.unpersist()
    metrics, pins = _evaluate_stack(test, heads, told, labels, cfg, x, id_col)
    spark = train.sparkSession
    schema = metrics.schema
    small = metrics.collect()  # one row per epoch, run and task
    for df in pins:
        df.unpersist()
    reports = []
    for k, c in enumerate(configs):
        own = spark.createDataFrame([r for r in small if r["run_no"] == k], schema).drop("run_no")
        batches = 1 if c.batch_size is None else smp.n_batches(n_rows, c.batch_size)
        group = _group(batches, c)
        reports.append(_report(own, list(c.tasks), c if group == 1 or c.batch_size is None else replace(c, batch_size=c.batch_size * group)))
    return reports


def _test_weights(m: Trainer) -> tuple[dict[str, float], float]:
    """Weights of the tasks' test losses and the regulariser: learned weights hold for the test loss too."""
    if m.regime != "MTL_awl":
        return {t: 1.0 for t in m.tasks}, 0.0
    return {t: 1.0 / (2 * si * si) for t, si in zip(m.tasks, m.s)}, float(sum(np.log(1 + si * si) for si in m.s))


def _evaluate_stack(test, heads, told, labels, cfg, x, id_col) -> tuple[DataFrame, list[DataFrame]]:
    """Metrics of every epoch, run and task from one scoring pass over ``test``; also what to unpersist after reading them."""
    scored = tr.score_batch(test, heads, {n: labels[told[n][2]] for n in heads}, x, id_col).withColumnRenamed("task", "head")
    spark = test.sparkSession
    named = F.broadcast(spark.createDataFrame([(n, *v) for n, v in told.items()],
                                              "head string, epoch int, run_no int, task string, lam double, reg double, training_loss double"))
    # one row per epoch, run and task: as many as there are heads
    counts = scored.groupBy("head").agg(F.count(F.lit(1)).alias("n"), *ev._cell_counts("y", "pred"), F.avg("loss").alias("_mean")).join(named, "head")
    measures = [ev.f1_binary().alias("F1"), ev.balanced_accuracy_binary().alias("BA"), ev.auc_hard().alias("AUC")]
    keys = ["epoch", "run_no"]
    if cfg.batch_size is None:
        total = F.sum(F.col("_mean") * F.col("lam")).over(Window.partitionBy(*keys)) + F.col("reg")
        return counts.select(*keys, "task", "n", "TP", "TN", "FP", "FN", *measures, total.alias("testing_loss"), "training_loss"), []
    pins, orders = [], None
    n_test = test.count()
    for epoch in range(cfg.epochs):
        ranked = smp.global_rank(smp.seeded_shuffle(test.select(id_col), id_col, cfg.seed, 20_000 + epoch), ["shuffle_key", id_col], partitions=_partitions_for(test, n_test))
        pins.append(ranked._labelwise_pinned)
        order = ranked.select(id_col, F.floor(F.col("rank") / cfg.batch_size).alias("batch_id"), F.lit(epoch).alias("epoch"))
        orders = order if orders is None else orders.unionByName(order)
    weighted = scored.join(named, "head").groupBy(*keys, id_col).agg(F.sum(F.col("loss") * F.col("lam")).alias("loss"), F.first("reg").alias("reg"))
    batches = weighted.join(orders, ["epoch", id_col]).groupBy(*keys, "batch_id").agg(F.avg("loss").alias("mean"), F.first("reg").alias("reg"))
    losses = batches.groupBy(*keys).agg((F.avg("mean") + F.first("reg")).alias("testing_loss"))
    return counts.join(losses, keys).select(*keys, "task", "n", "TP", "TN", "FP", "FN", *measures, "testing_loss", "training_loss"), pins
