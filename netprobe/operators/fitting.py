"""Classifiers of many runs at once: Newton steps from sums over each run's samples, all runs in one job.

Samples are rows (run_id, id, features array, label 0 or 1). A run's samples are dealt into parts of
bounded size; each part gives its loss, gradient and curvature at the run's weights, and a run's step
solves for a d x d matrix. So neither the number of runs nor the size of one is held by the driver.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import lru_cache
from itertools import combinations_with_replacement

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netprobe.functions.hashing import uniform
from netprobe.functions.tables import materialize
from netprobe.operators.learning import score_knn

#: Rows that a task holds of one run (on average, at most).
PART = 1 << 15
#: Weight of the squared length of the weights (but the intercept's), against the mean loss.
PENALTY = 0.01
ROUNDS, TOLERANCE = 60, 1e-9
#: Polynomial features: all of them up to so many, a sketch of so many beyond.
WIDEST = 512

Expand = Callable[[np.ndarray], np.ndarray]
Loss = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]


def logistic(z: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(loss, slope, curvature) by row."""
    p = 0.5 * (1 + np.tanh(z / 2))
    return np.logaddexp(0, z) - y * z, p - y, p * (1 - p)


def squared_hinge(z: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    sign = 2 * y - 1
    gap = np.maximum(0, 1 - sign * z)
    return gap**2, -2 * sign * gap, 2.0 * (gap > 0)


LOSSES: dict[str, Loss] = {"logistic": logistic, "squared_hinge": squared_hinge}


def plain(x: np.ndarray) -> np.ndarray:
    return x


@lru_cache(maxsize=8)
def _monomials(size: int, degree: int) -> tuple[np.ndarray, np.ndarray]:
    """(factors, weight) of every product of ``degree`` of (1, x): its weight is the root of how often it comes up in
    (1 + x y)^degree, so products of expansions are that kernel's values."""
    terms = list(combinations_with_replacement(range(size + 1), degree))
    often = [math.factorial(degree) / math.prod(math.factorial(t.count(i)) for i in set(t)) for t in terms]
    return np.array(terms), np.sqrt(often)


@lru_cache(maxsize=8)
def _hashes(size: int, degree: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(width * 31 + degree)
    return rng.integers(0, width, (degree, size + 1)), rng.choice([-1.0, 1.0], (degree, size + 1))


def polynomial(x: np.ndarray, degree: int = 3, widest: int = WIDEST) -> np.ndarray:
    """Features whose inner products are (1 + x y)^degree: all monomials, or where these are more than ``widest`` a
    TensorSketch of that width (Pham and Pagh 2013), whose inner products are so on average."""
    n, d = x.shape
    one = np.hstack([np.ones((n, 1)), x])
    if math.comb(d + degree, degree) <= widest:
        factors, weight = _monomials(d, degree)
        return one[:, factors].prod(axis=2) * weight
    to, sign = _hashes(d, degree, widest)
    out = np.ones((n, widest // 2 + 1), complex)
    for k in range(degree):
        sketch = np.zeros((n, widest))
        np.add.at(sketch.T, to[k], (one * sign[k]).T)
        out *= np.fft.rfft(sketch, axis=1)
    return np.fft.irfft(out, widest, axis=1)


EXPANSIONS: dict[str, Expand] = {"plain": plain, "polynomial": polynomial}


def dealt(rows: DataFrame, key: str) -> DataFrame:
    """Adds _part: numbers of parts of a run that hold about ``PART`` rows each."""
    sizes = rows.groupBy("run_id").agg(F.ceil(F.count("*") / PART).cast("int").alias("_parts"))
    return rows.join(sizes, "run_id").withColumn("_part", F.pmod(F.xxhash64(key), F.col("_parts")).cast("int"))


def _matrix(features: pd.Series, expand: Expand) -> np.ndarray:
    x = expand(np.nan_to_num(np.array(features.tolist(), float).reshape(len(features), -1)))
    return np.hstack([np.ones((len(x), 1)), x])


class Step:
    """Where a run's descent stands: the weights to try next, and the best so far with their value."""

    def __init__(self, theta: np.ndarray | None = None, kept: np.ndarray | None = None, best: float | None = None, done: bool = False) -> None:
        self.theta, self.kept, self.best, self.done = theta, kept, best, done

    def at(self, size: int) -> np.ndarray:
        return np.zeros(size) if self.theta is None else np.asarray(self.theta, float)

    def after(self, n: float, loss: float, slope: np.ndarray, curve: np.ndarray, penalty: float) -> Step:
        """``loss``, ``slope`` and ``curve``: sums over the run's samples at ``theta``. A step that raised the value is halved."""
        size = len(slope)
        theta, weight = self.at(size), np.r_[0.0, np.full(size - 1, penalty)]
        value, slope = loss / n + weight @ theta**2 / 2, slope / n
        if self.best is not None and self.best == self.best and value > self.best + 1e-15:
            kept = np.asarray(self.kept, float)
            done = bool(np.abs(theta - kept).max() < TOLERANCE)
            return Step(kept if done else (theta + kept) / 2, kept, self.best, done)
        move = np.linalg.lstsq(curve / n + np.diag(weight) + 1e-12 * np.eye(size), slope + weight * theta, rcond=None)[0]
        return Step(theta - move, theta, value, bool(np.abs(move).max() < TOLERANCE))


def newton(samples: DataFrame, loss: str = "logistic", expansion: str = "plain", penalty: float = PENALTY, rounds: int = ROUNDS) -> DataFrame:
    """(run_id, theta): the intercept and weights of least mean loss plus penalty / 2 of their squared length, by run.

    A run of one part is solved where it lies. Of the others each round is one job over their parts, whose sums a run's
    step gathers; runs that stand still are left out of the next one."""
    run_id = samples.schema["run_id"].dataType.simpleString()
    own = materialize(dealt(samples.select("run_id", "id", "features", F.col("label").cast("double").alias("label")), "id"), "fit-samples")
    values, expand = LOSSES[loss], EXPANSIONS[expansion]

    def gathered(x: np.ndarray, y: np.ndarray, theta: np.ndarray) -> tuple[float, float, np.ndarray, np.ndarray]:
        value, slope, curve = values(x @ theta, y)
        return float(len(x)), value.sum(), x.T @ slope, (x * curve[:, None]).T @ x

    def alone(rows: pd.DataFrame) -> pd.DataFrame:
        x, y, now = _matrix(rows.features, expand), rows.label.to_numpy(float), Step()
        for _ in range(rounds):
            now = now.after(*gathered(x, y, now.at(x.shape[1])), penalty)
            if now.done:
                break
        return pd.DataFrame({"run_id": rows.run_id.iloc[:1].to_list(), "theta": [now.theta]})

    small = own.filter("_parts = 1").select("run_id", "features", "label").groupBy("run_id").applyInPandas(alone, f"run_id {run_id}, theta array<double>")
    large = own.filter("_parts > 1")
    runs = materialize(large.select("run_id", "_parts").distinct(), "fit-runs")
    if runs.isEmpty():
        return small

    def sums(rows: pd.DataFrame, now: pd.DataFrame) -> pd.DataFrame:
        if not len(rows) or not len(now):
            return pd.DataFrame(columns=["_run", "n", "loss", "slope", "curve"], dtype=object)
        x = _matrix(rows.features, expand)
        n, value, slope, curve = gathered(x, rows.label.to_numpy(float), Step(now.theta.iloc[0]).at(x.shape[1]))
        return pd.DataFrame({"_run": [rows.run_id.iloc[0]], "n": [n], "loss": [value], "slope": [slope], "curve": [curve.ravel()]})

    def step(now: pd.DataFrame, parts: pd.DataFrame) -> pd.DataFrame:
        if not len(parts) or not len(now):
            return now[["run_id", "theta", "kept", "best", "done"]]
        slope = np.sum(parts.slope.to_list(), axis=0)
        curve = np.sum(parts.curve.to_list(), axis=0).reshape(len(slope), len(slope))
        then = Step(now.theta.iloc[0], now.kept.iloc[0], now.best.iloc[0]).after(parts.n.sum(), parts.loss.sum(), slope, curve, penalty)
        return pd.DataFrame({"run_id": now.run_id.to_list(), "theta": [then.theta], "kept": [then.kept], "best": [then.best], "done": [then.done]})

    fields = f"run_id {run_id}, theta array<double>, kept array<double>, best double, done boolean"
    state = runs.select("run_id", *[F.lit(None).cast(t).alias(c) for c, t in (("theta", "array<double>"), ("kept", "array<double>"), ("best", "double"))], F.lit(False).alias("done"))
    for _ in range(rounds):
        left = state.filter("NOT done").join(runs, "run_id").select(F.col("run_id").alias("_r"), F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("_p"), "theta")
        partial = large.select("run_id", "_part", "features", "label").groupBy("run_id", "_part").cogroup(left.groupBy("_r", "_p")).applyInPandas(sums, f"_run {run_id}, n double, loss double, slope array<double>, curve array<double>")
        state = materialize(state.groupBy("run_id").cogroup(partial.groupBy("_run")).applyInPandas(step, fields), "fit-state")
        if state.filter("NOT done").isEmpty():
            break
    return small.unionByName(state.select("run_id", "theta"))


def decisions(rows: DataFrame, thetas: DataFrame, expansion: str = "plain") -> DataFrame:
    """Adds ``value``: intercept plus weights times (expanded) features; rows of runs without weights are left out."""
    expand = EXPANSIONS[expansion]
    own = dealt(rows.withColumn("_row", F.monotonically_increasing_id()), "_row")
    every = own.select(F.col("run_id").alias("_r"), F.col("_part").alias("_p")).distinct()
    models = every.join(thetas.select(F.col("run_id").alias("_r"), "theta"), "_r")
    columns = rows.columns

    def run(some: pd.DataFrame, model: pd.DataFrame) -> pd.DataFrame:
        if not len(some) or not len(model):
            return pd.DataFrame(columns=[*columns, "value"], dtype=object)
        return some[columns].assign(value=_matrix(some.features, expand) @ np.asarray(model.theta.iloc[0], float))

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return own.select(*columns, "_part").groupBy("run_id", "_part").cogroup(models.groupBy("_r", "_p")).applyInPandas(run, f"{fields}, value double")


def _sigmoid(df: DataFrame) -> DataFrame:
    return df.withColumn("value", 1 / (1 + F.exp(-F.col("value"))))


def fitted(name: str, rows: DataFrame, samples: DataFrame, probability: bool = False) -> DataFrame:
    """Adds ``value`` to the rows (run_id, features, ...) of all runs that have samples: of logit the probability of
    label 1, of svm the decision value (with ``probability``, Platt's sigmoid of it), of knn the share of label 1."""
    if name == "logit":
        return _sigmoid(decisions(rows, newton(samples)))
    if name == "knn":
        return score_knn(rows, samples, by=["run_id"])
    if name != "svm":
        raise ValueError(f"unknown classifier: {name}")
    theta = materialize(newton(samples, "squared_hinge", "polynomial"), "fit-svm")
    out = decisions(rows, theta, "polynomial")
    if not probability:
        return out
    own = decisions(samples.select("run_id", "id", "label", "features"), theta, "polynomial")
    platt = newton(own.select("run_id", "id", F.array("value").alias("features"), "label"), penalty=1e-6)
    plain_columns = [c for c in out.columns if c not in ("value", "features")]
    scaled = decisions(out.select(*plain_columns, F.col("features").alias("_f"), F.array("value").alias("features")), platt)
    return _sigmoid(scaled).select(*plain_columns, F.col("_f").alias("features"), "value")


def fitted_runs(name: str, rows: DataFrame, samples: DataFrame, hold_out: float = 0.1, seed: int = 0) -> DataFrame:
    """``fitted`` for runs whose samples may be of one class (samples: run_id, id, features, label).

    A run of one class learns that class from the unprobed ``rows`` as unlabelled ones: with g the probability of the
    class and c the mean of g over samples held out of the fit, its probability is g / c, at most 1 (Elkan and Noto 2008);
    the value is the probability of label 1."""
    classes = samples.groupBy("run_id").agg(F.min("label").alias("_lo"), F.max("label").alias("_hi"))
    lone = materialize(classes.filter("_lo = _hi").select("run_id", F.col("_lo").alias("_class")), "fit-lone")
    columns = rows.columns
    both = fitted(name, rows, samples.join(lone, "run_id", "left_anti")).select(*columns, "value")
    if lone.isEmpty():
        return both
    known = samples.join(lone, "run_id").withColumn("_held", uniform(seed, "held", F.col("run_id"), F.col("id")) < hold_out)
    known = materialize(known, "fit-known")
    mine = materialize(rows.join(lone, "run_id").withColumn("_held", F.lit(False)), "fit-unlabelled")
    unlabelled = mine.select("run_id", F.xxhash64("run_id", *[c for c in columns if c not in ("run_id", "features")]).alias("id"), "features", F.lit(0).alias("label"))
    train = known.filter("NOT _held").select("run_id", F.xxhash64(F.lit("s"), "id").alias("id"), "features", F.lit(1).alias("label")).unionByName(unlabelled)
    held = known.filter("_held")
    asked = mine.unionByName(held.select("run_id", "features", "_class", "_held"), allowMissingColumns=True)
    g = materialize(fitted(name, asked, train, probability=True), "fit-asked")
    c = g.filter("_held").groupBy("run_id").agg(F.avg("value").alias("_c"))
    own = g.filter("NOT _held").join(c, "run_id", "left")
    p = F.least(F.lit(1.0), F.when(F.col("_c") > 0, F.col("value") / F.col("_c")).otherwise(F.col("value")))
    own = own.withColumn("value", F.when(F.col("_class") == 1, p).otherwise(1 - p))
    return both.unionByName(own.select(*columns, "value"))
