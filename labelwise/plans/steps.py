"""Steps of an epoch as one Spark job: a barrier stage whose tasks hand the training state on.

Mini-batch steps follow one another, so a step needs the parameters of the step before.  A job per step spends its time in
scheduling.  Here the ranked rows of an epoch stay in their partitions, in order, and one barrier stage makes all steps: a task that
holds whole batches makes their steps on its own, while it streams through its rows, and then gives the state to all
tasks (``allGather``); a batch that lies in more than one task is one exchange of gradient sums, after which each of these tasks makes
the same step.  So small batches cost two exchanges a partition, however many steps they are, and large batches are
data-parallel.  A task holds one batch of rows, never its partition.  A lost executor ends the stage, which Spark then starts again from
the state that the driver sent: an epoch is repeated, never continued from a half.

The state (parameters, optimizer moments, sums over steps) has the size of the model, whatever the number of rows.
"""

from __future__ import annotations

import base64
import pickle
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import BarrierTaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelwise.operators import train as tr


class GradientSums:
    """Task vectors of a pass as sums: per task their total, per pair of tasks the products summed over the steps.

    Their size is that of the parameters (squared), not the number of steps.
    """

    def __init__(self, tasks: Sequence[str]):
        self.tasks = list(tasks)
        self.total: dict[str, np.ndarray] = {}
        self.gram: dict[tuple[str, str], np.ndarray] = {}

    def add(self, vectors: dict[str, np.ndarray]) -> None:
        for i, t in enumerate(self.tasks):
            self.total[t] = self.total.get(t, 0.0) + vectors[t]
            for u in self.tasks[i:]:
                self.gram[t, u] = self.gram.get((t, u), 0.0) + np.outer(vectors[t], vectors[u])


def accumulated(acc, grads: dict[str, np.ndarray], clip: float | None) -> dict[str, np.ndarray]:
    """A gradient added to one that is never reset, and the sum clipped in place."""
    out = grads if acc is None else {k: acc[k] + grads[k] for k in grads}
    return tr.clip_grads(out, clip)[0] if clip is not None else out


def step_grads(model: tr.LinearModel, stats: tr.StepStats, lam: dict[str, float], clip: float | None):
    grads = model.param_grads(stats, lam)
    return grads if clip is None else tr.clip_grads(grads, clip)[0]


class Trainer:
    """What a gradient step does to the training state, in every regime; also the state that goes from task to task."""

    def __init__(self, model: tr.LinearModel, opt: tr.Optimizer, tasks: Sequence[str], regime: str, clip: float | None, accumulate: bool = False,
                 faithful_difference: bool = False, keep_params: bool = False, history: bool = True, per_task_shared: bool = False):
        if per_task_shared and accumulate:
            raise ValueError("accumulated gradients are of the summed loss; task vectors of their own need fresh gradients")
        self.per_task_shared = per_task_shared
        self.model, self.opt, self.tasks, self.regime, self.clip = model, opt, list(tasks), regime, clip
        self.accumulate, self.faithful, self.keep_params, self.history = accumulate, faithful_difference, keep_params, history
        self.s = np.ones(len(self.tasks))          # learned uncertainty parameters
        self.w_k = {t: 1.0 for t in self.tasks}    # meta task weights
        self.begin_epoch()

    def begin_epoch(self) -> None:
        self.steps, self.loss = 0, 0.0
        self.acc, self.before, self.support = None, None, GradientSums(self.tasks)

    def state(self) -> dict:
        m, o = self.model, self.opt
        return {"params": m.params, "opt": (o.t, o.m, o.v), "s": self.s, "steps": self.steps, "loss": self.loss, "acc": self.acc, "before": self.before,
                "support": (self.support.total, self.support.gram)}

    def load(self, state: dict) -> None:
        self.model.params, self.s = state["params"], state["s"]
        self.opt.t, self.opt.m, self.opt.v = state["opt"]
        self.steps, self.loss, self.acc, self.before = state["steps"], state["loss"], state["acc"], state["before"]
        self.support.total, self.support.gram = state["support"]

    def heads(self) -> dict[str, tr.Head]:
        return self.model.heads()

    def columns(self, labels: dict[str, str]) -> dict[str, str]:
        return {t: labels[t] for t in self.tasks}

    def vectors(self, stats: tr.StepStats, lam: dict[str, float], grads: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        """Task vectors of a step: of the summed loss's gradient, so that they differ in the heads, or each of its own loss."""
        if not self.per_task_shared:
            return {t: self.model.task_vector(grads, t) for t in self.tasks}
        own = {t: step_grads(self.model, stats, {u: lam[u] if u == t else 0.0 for u in self.tasks}, self.clip) for t in self.tasks}
        return {t: self.model.task_vector(g, t) for t, g in own.items()}

    def step(self, stats: tr.StepStats) -> dict | None:
        """One gradient step; what the history keeps of it."""
        tasks, model, regime = self.tasks, self.model, self.regime
        losses = [stats.loss[t] for t in tasks]
        if regime == "MTL_awl":
            lam_list, ds = tr.uncertainty_grads(losses, self.s)
            lam = dict(zip(tasks, lam_list))
            total = tr.uncertainty_weighted_loss(losses, self.s)
        elif regime == "MTL_meta":
            lam = {t: self.w_k[t] / len(tasks) for t in tasks}
            total = sum(lam[t] * stats.loss[t] for t in tasks)
        else:
            lam = {t: 1.0 for t in tasks}
            total = sum(losses)
        if regime == "MTL_meta" and self.accumulate:
            self.acc = grads = accumulated(self.acc, model.param_grads(stats, lam), self.clip)
        else:
            grads = step_grads(model, stats, lam, self.clip)
        if regime == "MTL_meta":
            now = self.vectors(stats, lam, grads)
            own = now
            if self.accumulate and self.before is not None and (self.steps == 1 or not self.faithful):
                own = {t: now[t] - self.before[t] for t in tasks}
            self.support.add({t: own[t] / (self.w_k[t] / len(tasks)) for t in tasks})
            self.before = now
        params = model.params
        if regime == "MTL_awl":
            params = dict(model.params, s=self.s)
            grads = dict(grads, s=np.array(ds))
        rate = self.opt.rate()
        self.opt.step(params, grads)
        if regime == "MTL_awl":
            self.s = params.pop("s")
            model.params = params
        self.loss += total
        self.steps += 1
        if not self.history:
            return None
        return {"step": self.steps - 1, "loss": total, **{f"loss_{t}": stats.loss[t] for t in tasks},
                **{f"weighted_loss_{t}": lam[t] * stats.loss[t] for t in tasks}, "lr": rate,
                **({"params": {k: np.array(v) for k, v in model.params.items()}} if self.keep_params else {})}


class QueryPass:
    """The query gradients of the meta regime, at fixed parameters; with ``accumulate`` they go on from the support's (``acc``)."""

    def __init__(self, trainer: Trainer):
        self.model, self.tasks, self.clip, self.accumulate, self.acc = trainer.model, trainer.tasks, trainer.clip, trainer.accumulate, trainer.acc
        self.query, self.steps, self.loss, self.trainer = GradientSums(self.tasks), 0, 0.0, trainer

    def state(self) -> dict:
        return {"acc": self.acc, "steps": self.steps, "loss": self.loss, "query": (self.query.total, self.query.gram)}

    def load(self, state: dict) -> None:
        self.acc, self.steps, self.loss = state["acc"], state["steps"], state["loss"]
        self.query.total, self.query.gram = state["query"]

    def heads(self) -> dict[str, tr.Head]:
        return self.model.heads()

    def columns(self, labels: dict[str, str]) -> dict[str, str]:
        return {t: labels[t] for t in self.tasks}

    def step(self, stats: tr.StepStats) -> None:
        one = {t: 1.0 for t in self.tasks}
        self.loss += sum(stats.loss[t] for t in self.tasks)
        self.steps += 1
        if self.accumulate:
            self.acc = grads = accumulated(self.acc, self.model.param_grads(stats, one), self.clip)
        else:
            grads = step_grads(self.model, stats, one, self.clip)
        self.query.add(self.trainer.vectors(stats, one, grads))


class Stack:
    """Machines that take the same steps on the same rows: all their heads are multiplied with a batch in one pass over it.

    A head is named ``k|task`` by its machine's place k.
    """

    def __init__(self, machines: Sequence[Trainer | QueryPass]):
        self.machines = list(machines)

    def state(self) -> list[dict]:
        return [m.state() for m in self.machines]

    def load(self, state: list[dict]) -> None:
        for m, s in zip(self.machines, state):
            m.load(s)

    def heads(self) -> dict[str, tr.Head]:
        return {f"{k}|{t}": h for k, m in enumerate(self.machines) for t, h in m.heads().items()}

    def columns(self, labels: dict[str, str]) -> dict[str, str]:
        return {f"{k}|{t}": labels[t] for k, m in enumerate(self.machines) for t in m.tasks}

    def step(self, stats: tr.StepStats) -> dict | None:
        made = []
        for k, m in enumerate(self.machines):
            names = {t: f"{k}|{t}" for t in m.tasks}
            made.append(m.step(tr.StepStats(*({t: part[n] for t, n in names.items()} for part in (stats.grads, stats.loss, stats.counts)))))
        return {"step": self.machines[0].steps - 1, "all": made} if any(h is not None for h in made) else None


def rounds(counts: Sequence[int], batch: int) -> list[tuple[int, int, int, int]]:
    """What the tasks do in turn: (first task, last task, first batch, batch after the last).

    ``counts``: rows of each partition, which hold consecutive ranks.  One task alone: all batches that lie in it whole and in
    sequence; several: one batch that they share.
    """
    ends = np.cumsum(counts)
    total = int(ends[-1]) if len(ends) else 0
    out: list[tuple[int, int, int, int]] = []
    for b in _candidates(ends, batch, total) if total else []:
        first = int(np.searchsorted(ends, b * batch, side="right"))
        last = int(np.searchsorted(ends, min((b + 1) * batch, total) - 1, side="right"))
        out.append((first, last, b, b + 1))
    filled: list[tuple[int, int, int, int]] = []
    for r in out:
        if r[0] == r[1] and filled and filled[-1][:2] == r[:2]:
            filled[-1] = (*r[:2], filled[-1][2], r[3])
        else:
            filled.append(r)
    return filled


def _candidates(ends: np.ndarray, batch: int, total: int) -> list[int]:
    """Batches at which the holder may change, and the last one of every stretch between: the others lie inside a stretch."""
    marks = {0, -(-total // batch) - 1}
    for e in ends[:-1]:
        b = int(e) // batch
        marks |= {x for x in (b - 1, b, b + 1) if 0 <= x < -(-total // batch)}
    return sorted(marks)


class _Rows:
    """A partition's rows in order, taken so many at a time."""

    def __init__(self, batches: Iterable[pa.RecordBatch]):
        self.batches, self.now, self.at = iter(batches), None, 0

    def take(self, n: int) -> list[pa.RecordBatch]:
        out = []
        while n:
            if self.now is None or self.at == self.now.num_rows:
                self.now, self.at = next(self.batches, None), 0
                if self.now is None:
                    raise ValueError("a partition holds fewer rows than it was counted with")
                continue
            part = self.now.slice(self.at, n)
            self.at, n = self.at + part.num_rows, n - part.num_rows
            out.append(part)
        return out


def run_epoch(ranked: DataFrame, counts: Sequence[int], machine: Trainer | QueryPass | Stack, labels: dict[str, str], x: str, batch: int) -> list[dict]:
    """All steps of one pass over ``ranked`` as one barrier job; ``machine`` has the final state.  Returns the history, if it is kept.

    ``ranked``: partitions of consecutive ranks, each in order (see ``sample.global_rank``), of ``counts`` rows.  Rows without any
    label stay in their batch and count for no task.
    """
    plan = rounds(counts, batch)
    if not plan:
        return []
    starts = np.concatenate([[0], np.cumsum(counts)])
    total, tasks = int(starts[-1]), list(labels)
    rows = ranked.select(F.col(x).alias("_x"), *[F.col(labels[t]).alias(f"_y{i}") for i, t in enumerate(tasks)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = BarrierTaskContext.get()
        me = context.partitionId()
        held, kept = _Rows(batches), []
        last_round = max((k for k, (a, b, _, _) in enumerate(plan) if a <= me <= b), default=-1)

        def sums(heads, lo, hi):
            acc = tr.empty_sums(heads)
            for part in held.take(max(0, min(hi, int(starts[me + 1])) - max(lo, int(starts[me])))):
                tr.add_rows(acc, heads, part)
            return acc

        def step(parts):
            row = machine.step(tr.mean_step(parts))
            if row is not None and me == first:
                kept.append(row)

        for k, (first, last, begin, end) in enumerate(plan):
            message = ""
            if first == me == last:
                for b in range(begin, end):
                    step([sums(machine.heads(), b * batch, min((b + 1) * batch, total))])
                message = _packed(machine.state())
            elif first <= me <= last:
                message = _packed(sums(machine.heads(), begin * batch, min(end * batch, total)))
            if k == len(plan) - 1 and first == last:
                break
            told = context.allGather(message)
            if k > last_round:
                continue  # nothing more to do here but to take part in the exchanges
            if first < last:
                step([_unpacked(m) for m in told[first:last + 1]])
            elif me != first:
                machine.load(_unpacked(told[first]))
        if me == plan[-1][0] or kept:
            yield pa.RecordBatch.from_arrays([pa.array([me == plan[-1][0]]), pa.array([pickle.dumps((machine.state() if me == plan[-1][0] else None, kept))], pa.binary())],
                                             names=["is_last", "data"])

    history: list[dict] = []
    for r in rows.mapInArrow(run, "is_last boolean, data binary", barrier=True).collect():
        state, kept = pickle.loads(bytes(r.data))
        history += kept
        if r.is_last:
            machine.load(state)
    return sorted(history, key=lambda h: h["step"])


def _packed(value) -> str:
    return base64.b64encode(pickle.dumps(value)).decode()


def _unpacked(text: str):
    return pickle.loads(base64.b64decode(text))
