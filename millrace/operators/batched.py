"""Many L1 logistic regressions over the same rows at once.

Folds and strengths share every scan: it adds up, for all regressions together, the loss, its
gradient and its second derivatives at the coefficients under trial.  Each regression then takes
a proximal Newton step of its own, a quadratic problem of as many variables as there are
features, and shortens it if the loss says so.  Newton steps are few, so the number of scans depends
neither on the number of folds nor on that of strengths, and what reaches the driver is a few sums
per regression.  The sums grow with the square of the number of features: for tens to a
few hundred of them.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: products held at once while second derivatives are added up
_CHUNK_VALUES = 1 << 20
_ROUNDS, _SWEEPS = 30, 10
#: promises below this share of the loss are rounding
_LEAST_TOL = 1e-10
_NO_PART = -1


@dataclass(frozen=True)
class Problem:
    """One regression: its strength, and the part that is left out (or, of drawn rows, used); None uses all rows."""

    C: float
    part: int | None = None


@dataclass
class _State:
    """Coefficients (the intercept last) that were accepted, and the step under trial."""

    weights: np.ndarray
    penalty: float
    value: float = np.inf
    step: np.ndarray | None = None
    promised: float = 0.0
    length: float = 1.0
    done: bool = False

    def trial(self) -> np.ndarray:
        return self.weights if self.step is None else self.weights + self.length * self.step


def _matrices(batches: Iterator[pa.RecordBatch], problems: Sequence[Problem], own: bool, chunk: int):
    """``X`` with a column of ones, ``y``, and which rows each problem uses, in pieces."""
    parts = np.array([_NO_PART if p.part is None else p.part for p in problems])
    for batch in batches:
        width = None
        for at in range(0, batch.num_rows, chunk):
            piece = batch.slice(at, chunk)
            column = piece.column(0)
            values = column.flatten().to_numpy(zero_copy_only=False).astype(float)
            width = len(values) // len(piece)
            x = np.column_stack([values.reshape(len(piece), width), np.ones(len(piece))])
            part = piece.column(2).to_numpy(zero_copy_only=False)
            used = part[:, None] == parts[None, :] if own else part[:, None] != parts[None, :]
            yield x, piece.column(1).to_numpy(zero_copy_only=False).astype(float), used | (parts == _NO_PART)[None, :]


def _sums(weights: np.ndarray, problems: Sequence[Problem], own: bool):
    size = weights.shape[1]
    upper = np.triu_indices(size)
    chunk = max(1, _CHUNK_VALUES // len(upper[0]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(problems), 1 + size + len(upper[0])))
        for x, y, used in _matrices(batches, problems, own, chunk):
            eta = x @ weights.T
            p = 1.0 / (1.0 + np.exp(-np.clip(eta, -700.0, 700.0)))
            total[:, 0] += np.where(used, np.logaddexp(0.0, eta) - y[:, None] * eta, 0.0).sum(axis=0)
            total[:, 1:1 + size] += np.where(used, p - y[:, None], 0.0).T @ x
            total[:, 1 + size:] += np.where(used, p * (1.0 - p), 0.0).T @ (x[:, upper[0]] * x[:, upper[1]])
        number, place = np.indices(total.shape)
        yield pa.RecordBatch.from_arrays(
            [pa.array(number.ravel(), pa.int32()), pa.array(place.ravel(), pa.int32()), pa.array(total.ravel())],
            names=["problem", "place", "value"])

    return run


def _summed(rows: DataFrame, run, shape: tuple[int, int]) -> np.ndarray:
    parts = rows.mapInArrow(run, "problem int, place int, value double")
    # one number per problem and place
    table = parts.groupBy("problem", "place").agg(F.sum("value").alias("value")).toArrow()
    out = np.zeros(shape)
    out[table["problem"].to_numpy(), table["place"].to_numpy()] = table["value"].to_numpy()
    return out


def _newton_step(weights: np.ndarray, gradient: np.ndarray, hessian: np.ndarray, penalty: float) -> np.ndarray:
    """The change that is best for the quadratic model plus the penalty.

    The intercept, free of the penalty, is solved for and left out.  Rounds of coordinate descent find
    which coefficients are not zero; a linear system on these then gives their values.
    """
    w, bend = weights[:-1], max(float(hessian[-1, -1]), 1e-300)
    cross = hessian[:-1, -1]
    model = hessian[:-1, :-1] - np.outer(cross, cross) / bend
    slope0 = gradient[:-1] - cross * (gradient[-1] / bend)
    curve = np.diag(model) + 1e-12 * max(1.0, float(np.abs(np.diag(model)).max(initial=0.0)))

    def value(step: np.ndarray) -> float:
        return float(slope0 @ step + 0.5 * step @ model @ step) + penalty * float(np.abs(w + step).sum())

    step, best = np.zeros_like(w), value(np.zeros_like(w))
    for _ in range(_ROUNDS):
        before = best
        slope = slope0 + model @ step
        for _ in range(_SWEEPS):
            for j in range(len(w)):
                now = w[j] + step[j]
                target = now - slope[j] / curve[j]
                target = np.sign(target) * max(0.0, abs(target) - penalty / curve[j])
                if target != now:
                    slope += (target - now) * model[:, j]
                    step[j] += target - now
        best, held = value(step), np.flatnonzero(w + step)
        if len(held):
            fixed = -w.copy()
            fixed[held] = 0.0  # all others go to zero
            wanted = -(slope0 + model @ fixed + penalty * np.sign(w + step))[held]
            exact = fixed.copy()
            exact[held] = np.linalg.lstsq(model[np.ix_(held, held)], wanted, rcond=1e-12)[0]
            if value(exact) < best:
                step, best = exact, value(exact)
        if before - best <= 1e-6 * max(0.0, -best + value(np.zeros_like(w))):
            break
    return np.append(step, -(gradient[-1] + cross @ step) / bend)


def _advance(state: _State, sums: np.ndarray, size: int, tol: float) -> None:
    weights = state.trial()
    value = sums[0] + state.penalty * np.abs(weights[:-1]).sum()
    if state.step is not None and value > state.value + 1e-4 * state.length * state.promised + 1e-12 * abs(state.value):
        state.length /= 2.0
        state.done = state.length < 1e-10
        return
    gained, least = state.value - value, max(tol, _LEAST_TOL) * max(1.0, abs(value))
    state.weights, state.value = weights, value
    gradient, hessian = sums[1:1 + size], np.zeros((size, size))
    hessian[np.triu_indices(size)] = sums[1 + size:]
    hessian = hessian + np.triu(hessian, 1).T
    state.step, state.length = _newton_step(weights, gradient, hessian, state.penalty), 1.0
    after = np.abs((weights + state.step)[:-1]).sum() - np.abs(weights[:-1]).sum()
    state.promised = float(gradient @ state.step) + state.penalty * after
    state.done = min(-state.promised, gained) <= least


def fit_many(
    rows: DataFrame, n_features: int, problems: Sequence[Problem], own: bool = False, tol: float = 1e-8, max_iter: int = 100,
) -> np.ndarray:
    """Coefficients of all problems, one row each, the intercept last.

    ``rows``: ``features array<double>, y double, part int``.  A problem uses the rows of all parts but its own, or
    with ``own`` those of its part alone.  Loss is summed, the penalty is ``|w| / C`` without the intercept.
    Stops where no step promises more than ``tol`` of the loss, or after ``max_iter`` scans.
    """
    size = n_features + 1
    states = [_State(np.zeros(size), 1.0 / p.C) for p in problems]
    data = rows.select("features", "y", "part")
    for _ in range(max_iter):
        going = [i for i, s in enumerate(states) if not s.done]
        if not going:
            break
        weights = np.stack([states[i].trial() for i in going])
        asked = [problems[i] for i in going]
        sums = _summed(data, _sums(weights, asked, own), (len(going), 1 + size + size * (size + 1) // 2))
        if not np.isfinite(sums).all():
            raise ValueError("features and labels must not be null or NaN")
        for i, row in zip(going, sums):
            _advance(states[i], row, size, tol)
    return np.stack([s.weights for s in states])


def hits(rows: DataFrame, weights: np.ndarray, problems: Sequence[Problem]) -> np.ndarray:
    """``true positives, false negatives`` of each problem on the rows of its part, in one scan."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(problems), 2))
        for x, y, used in _matrices(batches, problems, True, _CHUNK_VALUES // weights.shape[1]):
            found = x @ weights.T > 0.0
            positive = used & (y[:, None] == 1.0)
            total[:, 0] += (positive & found).sum(axis=0)
            total[:, 1] += (positive & ~found).sum(axis=0)
        number, place = np.indices(total.shape)
        yield pa.RecordBatch.from_arrays(
            [pa.array(number.ravel(), pa.int32()), pa.array(place.ravel(), pa.int32()), pa.array(total.ravel())],
            names=["problem", "place", "value"])

    return _summed(rows.select("features", "y", "part"), run, (len(problems), 2))
