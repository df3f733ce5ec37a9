"""A linear probe over embeddings: class-weighted softmax regression with fixed folds, all fits in the same passes.

The fits of a grid of regularisations over all folds, and those on all rows, differ only in which rows count and in the
penalty. So one pass over the data computes the losses and gradients of all of them, with a matrix of coefficients for
each fit and a column of row weights for each fold; each fit walks its own way by L-BFGS between passes, on the driver.
The number of passes is that of the slowest fit, however many there are. Features are scaled by their deviation in the
fit's own rows, the penalty applies to scaled coefficients, and intercepts are free.
"""

from __future__ import annotations

from collections.abc import Generator, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyframe.operators.captions import class_weights
from skyframe.operators.lineage import settled
from skyframe.operators.resample import _class_metrics
from skyframe.operators.scoring import benchmark_metrics
from skyframe.operators.splits import cv_folds

#: Partial sums of tasks are added up by this many tasks before the driver gets them.
ADDERS = 16


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), float).reshape(len(column), -1)


def _summed(rows: DataFrame, part, size: int) -> np.ndarray:
    """The sum over all Arrow batches of ``part(batch)``, an array of ``size`` numbers."""

    def partial(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for b in batches:
            if len(b):
                total += part(b)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sums"])

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for b in batches:
            for x in b.column(0):
                total += np.frombuffer(x.as_py())
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sums"])

    sums = rows.mapInArrow(partial, "sums binary").repartition(ADDERS).mapInArrow(add, "sums binary").collect()
    return sum((np.frombuffer(r["sums"]) for r in sums), np.zeros(size))


Walk = Generator[np.ndarray, tuple[float, np.ndarray], np.ndarray]


def lbfgs(start: np.ndarray, steps: int, tolerance: float = 1e-8, memory: int = 10) -> Walk:
    """Yields points, is sent the loss and gradient there, and returns the least point found."""
    x = start
    f, g = yield x
    moves: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        if np.abs(g).max() < tolerance * max(1.0, abs(f)):
            break
        d, back = -g.copy(), []
        for s, y in reversed(moves):
            a = s @ d / (s @ y)
            d -= a * y
            back.append(a)
        if moves:
            s, y = moves[-1]
            d *= (s @ y) / (y @ y)
        for (s, y), a in zip(moves, reversed(back), strict=True):
            d += s * (a - y @ d / (s @ y))
        t = 1.0 if moves else 1.0 / max(1.0, float(np.linalg.norm(g)))
        for _ in range(30):
            found, slope = yield x + t * d
            if found <= f + 1e-4 * t * (g @ d):
                break
            t /= 2
        else:
            break
        s, y = t * d, slope - g
        if s @ y > 1e-12 * np.linalg.norm(s) * np.linalg.norm(y):
            moves = [*moves[-(memory - 1) :], (s, y)]
        done = abs(f - found) <= 1e-10 * max(1.0, abs(f))
        x, f, g = x + s, found, slope
        if done:
            break
    return x


def fit_all(rows: DataFrame, fits: list[tuple[int, float]], n_classes: int, width: int, folds: int, max_iter: int = 100) -> tuple[np.ndarray, int]:
    """(coefficients by fit, class and feature, the intercept last; passes over the data) of rows (features, y, weight, fold).

    A fit is (fold to leave out, or -1, and its regularisation).
    """
    f = width + 1

    def moments(b: pa.RecordBatch) -> np.ndarray:
        x, w, fold = _matrix(b.column(0)), b.column(2).to_numpy(), b.column(3).to_numpy()
        out = np.zeros((folds, 2 + 2 * width))
        for k in range(folds):
            own, wk = x[fold == k], w[fold == k]
            out[k] = np.concatenate([[wk.sum(), (wk**2).sum()], wk @ own, wk @ own**2])
        return out.ravel()

    each = _summed(rows, moments, folds * (2 + 2 * width)).reshape(folds, -1)
    used = [each.sum(0) - (each[k] if k >= 0 else 0) for k, _ in fits]
    total = np.array([u[0] for u in used])
    deviation = []
    for u in used:
        mean = u[2 : 2 + width] / u[0]
        spread = np.maximum(u[2 + width :] - u[0] * mean**2, 0) / max(u[0] - u[1] / u[0], 1e-300)
        deviation.append(np.sqrt(spread))
    scale = np.array([np.divide(1.0, d, out=np.zeros(width), where=d > 0) for d in deviation])
    left_out, reg = np.array([k for k, _ in fits]), np.array([r for _, r in fits])

    def losses(at: np.ndarray, which: list[int]):
        """Losses and gradients of some fits at their points."""
        points = at.reshape(len(which), n_classes, f)
        plain = points.copy()
        plain[:, :, :width] *= scale[which][:, None]
        omit = left_out[which]

        def part(b: pa.RecordBatch) -> np.ndarray:
            x = np.column_stack([_matrix(b.column(0)), np.ones(len(b))])
            y, w, fold = b.column(1).to_numpy().astype(int), b.column(2).to_numpy(), b.column(3).to_numpy()
            out = np.zeros((len(which), 1 + n_classes * f))
            for m in range(len(which)):
                weight = np.where(fold == omit[m], 0.0, w)
                z = x @ plain[m].T
                z -= z.max(1, keepdims=True)
                e = np.exp(z)
                s = e.sum(1)
                out[m, 0] = weight @ (np.log(s) - z[np.arange(len(y)), y])
                p = e / s[:, None]
                p[np.arange(len(y)), y] -= 1
                out[m, 1:] = ((p * weight[:, None]).T @ x).ravel()
            return out.ravel()

        sums = _summed(rows, part, len(which) * (1 + n_classes * f)).reshape(len(which), -1) / total[which][:, None]
        gradient = sums[:, 1:].reshape(points.shape).copy()
        gradient[:, :, :width] *= scale[which][:, None]
        gradient[:, :, :width] += reg[which][:, None, None] * points[:, :, :width]
        loss = sums[:, 0] + 0.5 * reg[which] * (points[:, :, :width] ** 2).sum((1, 2))
        return loss, gradient.reshape(len(which), -1)

    walks = {m: lbfgs(np.zeros(n_classes * f), max_iter) for m in range(len(fits))}
    at, best, passes = {m: next(w) for m, w in walks.items()}, {}, 1
    while at:
        which = sorted(at)
        found, slopes = losses(np.stack([at[m] for m in which]), which)
        passes += 1
        for k, m in enumerate(which):
            try:
                at[m] = walks[m].send((float(found[k]), slopes[k]))
            except StopIteration as end:
                best[m] = end.value
                del at[m]
    out = np.stack([best[m] for m in range(len(fits))]).reshape(len(fits), n_classes, f)
    out[:, :, :width] *= scale[:, None]
    return out, passes


def linear_probe(train: DataFrame, held_out: DataFrame, values: str, label: str, labels: list[str], key: str, grid: tuple[float, ...] = (0.01, 0.1), folds: int = 3, max_iter: int = 100) -> DataFrame:
    """One row of held-out metrics and the chosen regularisation.

    The regularisation with the best mean macro F1 over the folds, then the best balanced accuracy, then the least value,
    is that of the fit on all training rows which the held-out rows are scored with, once.
    """
    number = F.create_map(*[F.lit(x) for i, v in enumerate(labels) for x in (v, i)])
    features = F.col(values).cast("array<double>").alias("features")
    dealt = cv_folds(train.select(F.col(key).cast("string").alias("key"), F.col(label).alias("truth")), "truth", folds, "probe", "key").select("key", F.col("fold").cast("int").alias("fold"))
    rows = train.select(F.col(key).cast("string").alias("key"), features, F.element_at(number, F.col(label)).alias("y"), F.col(label).alias("truth")).join(dealt, "key")
    # One row for each class.
    rows = rows.join(F.broadcast(class_weights(train, label, labels).select(F.col(label).alias("truth"), F.col("weight").cast("double").alias("weight"))), "truth")
    rows = settled(rows.select("features", "y", "weight", "fold"))
    first = rows.select(F.size("features")).first()
    if first is None:
        raise ValueError("no rows to train on")
    regs = sorted(grid)
    fits = [(fold, reg) for reg in regs for fold in range(-1, folds)]
    found, _ = fit_all(rows, fits, len(labels), first[0], folds, max_iter)
    wide = folds * len(regs) * len(labels) ** 2

    def confusion(b: pa.RecordBatch) -> np.ndarray:
        """How often each class of a fold got which answer of the fit that left the fold out."""
        x = np.column_stack([_matrix(b.column(0)), np.ones(len(b))])
        y, fold = b.column(1).to_numpy().astype(int), b.column(3).to_numpy()
        out = np.zeros((len(regs), folds, len(labels), len(labels)))
        for m, (k, reg) in enumerate(fits):
            if k >= 0:
                answer = (x[fold == k] @ found[m].T).argmax(1)
                np.add.at(out[regs.index(reg), k], (y[fold == k], answer), 1)
        return out.ravel()

    table = _summed(rows, confusion, wide).reshape(len(regs), folds, len(labels), len(labels))
    best = None
    for r, reg in enumerate(regs):
        scores = [_class_metrics(np.column_stack([table[r, k], np.zeros(len(labels))]), labels) for k in range(folds)]
        rank = (sum(s["macro_f1"] for s in scores), sum(s["balanced_accuracy"] for s in scores), -reg)
        if best is None or rank > best[0]:
            best = (rank, reg, found[fits.index((-1, reg))])
    _, reg, chosen = best
    rows.unpersist()

    def answers(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array(labels, object)
        for b in batches:
            said = names[(np.column_stack([_matrix(b.column(0)), np.ones(len(b))]) @ chosen.T).argmax(1)] if len(b) else []
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array(said, pa.string())], ["truth", "predicted"])

    out = held_out.select(features, F.col(label).cast("string").alias("truth")).mapInArrow(answers, "truth string, predicted string")
    return benchmark_metrics(out, "truth", "predicted", labels).withColumn("reg", F.lit(reg))
