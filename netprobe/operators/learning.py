"""Parameter estimation from probe samples, and the value functions that are fitted to them.

Samples are rows (run_id, seq, features array, reward). Sums are grouped by run in Spark; what is left
for a small helper is linear algebra on d x d matrices.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from netprobe.functions.hashing import hash_key, uniform
from netprobe.functions.tables import materialize

#: Group size that a regression of the median of means uses at most; a fixed value of the method.
MOST_ROWS = 2000
#: What training adds to a reward of hit or miss.
TARGET_OFFSET = 0.1


def append_samples(samples: DataFrame, new: DataFrame) -> DataFrame:
    """Samples by (run_id, seq); a sample that is there already stays."""
    fresh = new.join(samples.select("run_id", "seq"), ["run_id", "seq"], "left_anti")
    return samples.unionByName(fresh.select(*samples.columns))


def init_theta(runs: DataFrame, size: int, seed: int = 0, by: Sequence[str] = ("run_id",)) -> DataFrame:
    """(run_id, theta): uniform in (-0.2, 0.2)."""
    keys = [F.col(c) for c in by]
    return runs.select(*by).distinct().withColumn("theta", F.array(*[uniform(seed, "theta", *keys, j) * 0.4 - 0.2 for j in range(size)]))


def dot(x: Column, w: Column) -> Column:
    return F.aggregate(F.zip_with(x, w, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)


def sgd_update(batch: DataFrame, thetas: DataFrame, size: int, alpha: float, by: Sequence[str] = ("run_id",)) -> DataFrame:
    """theta + sum over the batch of 2 alpha (reward - x theta) x; exact for a batch of one."""
    both = batch.join(thetas, list(by))
    step = 2 * alpha * (F.col("reward") - dot(F.col("features"), F.col("theta")))
    sums = both.withColumn("_s", step).groupBy(*by).agg(*[F.sum(F.col("_s") * F.col("features")[j]).alias(f"_d{j}") for j in range(size)])
    moved = F.array(*[F.col("theta")[j] + F.coalesce(F.col(f"_d{j}"), F.lit(0.0)) for j in range(size)])
    return thetas.join(sums, list(by), "left").select(*by, moved.alias("theta"))


def regularize(theta: Column, kind: str = "no") -> Column:
    """nonnegative, normalized (length 1), pos_normalized (both) or no."""
    if kind == "no":
        return theta
    out = F.transform(theta, lambda w: F.greatest(w, F.lit(0.0))) if kind in ("nonnegative", "pos_normalized") else theta
    if kind == "nonnegative":
        return out
    if kind not in ("normalized", "pos_normalized"):
        raise ValueError(f"unknown regularisation: {kind}")
    length = F.sqrt(F.aggregate(out, F.lit(0.0), lambda s, w: s + w * w))
    return F.when(length > 0, F.transform(out, lambda w: w / length)).otherwise(out)


def resolve_k(k: int | str, n: int) -> int:
    """A number of groups, or the name of a logarithm of n; at least 1 and at most n."""
    if isinstance(k, str):
        named = {"ln": math.log, "log": math.log, "log2": math.log2, "log10": math.log10}
        if k not in named:
            raise ValueError(f"unknown function for k: {k}")
        k = max(1, int(named[k](n))) if n > 0 else 1
    return n if n and n < k else max(1, k)


def htr_gram(samples: DataFrame, size: int, k: int | str, seed: int = 0) -> DataFrame:
    """(run_id, grp, n, gram, xy, sums): the sums of each of k disjoint groups of hash-ranked samples.

    A run's samples are its probes, a bounded number; each group takes min(2000, n / k) of them."""
    ranked = samples.withColumn("_r", F.row_number().over(W.partitionBy("run_id").orderBy(hash_key(seed, F.col("run_id"), F.col("seq")), "seq")) - 1)
    sizes = samples.groupBy("run_id").agg(F.count("*").alias("_n"))
    named = {"ln": F.log, "log": F.log, "log2": F.log2, "log10": F.log10}
    groups = F.lit(k) if isinstance(k, int) else F.greatest(F.floor(named[k](F.col("_n"))), F.lit(1))
    sizes = sizes.withColumn("_k", F.least(groups, F.col("_n"))).withColumn("_m", F.least(F.lit(MOST_ROWS), F.floor(F.col("_n") / F.col("_k"))))
    own = ranked.join(sizes, "run_id").withColumn("grp", F.floor(F.col("_r") / F.col("_m")).cast("int")).filter(F.col("grp") < F.col("_k"))
    x = [F.col("features")[i].cast("double") for i in range(size)]
    gram = [F.sum(x[i] * x[j]).alias(f"_g{i}_{j}") for i in range(size) for j in range(i, size)]
    out = own.groupBy("run_id", "grp").agg(F.count("*").alias("n"), *gram, *[F.sum(x[i] * F.col("reward")).alias(f"_y{i}") for i in range(size)], *[F.sum(x[i]).alias(f"_s{i}") for i in range(size)])
    return out.select(
        "run_id", "grp", "n", F.array(*[f"_g{i}_{j}" for i in range(size) for j in range(i, size)]).alias("gram"),
        F.array(*[f"_y{i}" for i in range(size)]).alias("xy"), F.array(*[f"_s{i}" for i in range(size)]).alias("sums"),
    )


def median_of_means(groups: pd.DataFrame, size: int, distance: str = "mahalanobis") -> np.ndarray:
    """The group's parameters whose median distance to the other groups is least; all pairs of groups at once."""
    own = groups.sort_values("grp")
    n, sums, xy = own.n.to_numpy(float), np.stack(own.sums), np.stack(own.xy)
    gram = np.zeros((len(own), size, size))
    gram[(slice(None), *np.triu_indices(size))] = np.stack(own.gram)
    gram = gram + np.triu(gram, 1).transpose(0, 2, 1)
    theta = np.einsum("kij,kj->ki", np.linalg.pinv(gram), xy)
    if len(own) == 1:
        return theta[0]
    spread = gram - np.einsum("ki,kj->kij", sums, sums) / n[:, None, None]
    spread = np.where(n[:, None, None] > 1, spread / np.maximum(n - 1, 1)[:, None, None], 0.0)
    gap = theta[:, None] - theta[None]
    pulled = np.einsum("kla,lab->klb", gap, spread)  # by the other group's covariance
    # the published code takes an elementwise product, and the median over all its numbers
    values = (pulled * gap).sum(axis=2, keepdims=True) if distance == "mahalanobis" else pulled * (theta[:, None] + theta[None])
    others = values[~np.eye(len(own), dtype=bool)].reshape(len(own), -1)
    return theta[np.argmin(np.median(others, axis=1))]


def htr_fit(samples: DataFrame, size: int, k: int | str, seed: int = 0, distance: str = "mahalanobis") -> DataFrame:
    """(run_id, theta) by heavy-tailed regression: one group-by, then k small solutions for each run."""
    run_id = samples.schema["run_id"].dataType.simpleString()

    def one(key: tuple, groups: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"run_id": [key[0]], "theta": [median_of_means(groups, size, distance).tolist()]})

    return htr_gram(samples, size, k, seed).groupBy("run_id").applyInPandas(one, f"run_id {run_id}, theta array<double>")


def linreg_theta(samples: DataFrame, size: int) -> DataFrame:
    """(run_id, theta, intercept): least squares with an intercept, from each run's sums."""
    run_id = samples.schema["run_id"].dataType.simpleString()
    x = [F.lit(1.0), *[F.col("features")[i].cast("double") for i in range(size)]]
    sums = samples.groupBy("run_id").agg(
        F.array(*[F.sum(x[i] * x[j]) for i in range(size + 1) for j in range(i, size + 1)]).alias("gram"),
        F.array(*[F.sum(x[i] * F.col("reward")) for i in range(size + 1)]).alias("xy"),
    )

    def one(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        gram = np.zeros((size + 1, size + 1))
        gram[np.triu_indices(size + 1)] = rows.gram.iloc[0]
        w = np.linalg.pinv(gram + np.triu(gram, 1).T) @ np.asarray(rows.xy.iloc[0])
        return pd.DataFrame({"run_id": [key[0]], "theta": [w[1:].tolist()], "intercept": [float(w[0])]})

    return sums.groupBy("run_id").applyInPandas(one, f"run_id {run_id}, theta array<double>, intercept double")


def score_linreg(rows: DataFrame, samples: DataFrame, size: int) -> DataFrame:
    """Adds ``value``: the fitted weights times the features, without the intercept."""
    fit = linreg_theta(samples, size).select("run_id", "theta")
    return rows.join(fit, "run_id").withColumn("value", dot(F.col("features"), F.col("theta"))).drop("theta")


#: Rows and samples that one task holds against one another, and rows of one matrix.
KNN_ROWS, KNN_SAMPLES, KNN_STEP = 16384, 16384, 256


def _nearest(q: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of q, row of x, squared distance to nine places) of the k nearest of x, ties by id.

    Distances by one matrix product leave out what cannot be among the k, by more than its error; the rest are exact."""
    with np.errstate(all="ignore"):
        own, theirs = (q * q).sum(axis=1), (x * x).sum(axis=1)
        rough = own[:, None] + theirs[None] - 2 * (q @ x.T)
    if np.isfinite(rough).all():
        last = min(k, len(x)) - 1
        # far beyond the error of the product, and of rounding to nine places
        slack = 1e-11 * q.shape[1] * (own + theirs.max()) + 1e-8
        i, j = np.nonzero(rough <= (np.partition(rough, last, axis=1)[:, last] + slack)[:, None])
    else:
        i, j = (a.ravel() for a in np.indices(rough.shape))
    gap = np.concatenate([np.round(((q[i[a : a + 65536]] - x[j[a : a + 65536]]) ** 2).sum(axis=1), 9) for a in range(0, len(i), 65536)])
    order = np.lexsort((ids[j], gap, i))
    i, j, gap = i[order], j[order], gap[order]
    taken = np.arange(len(i)) - np.searchsorted(i, i) < k
    return i[taken], j[taken], gap[taken]


def score_knn(rows: DataFrame, samples: DataFrame, k: int = 5, by: Sequence[str] = ()) -> DataFrame:
    """Adds ``value``: the share of label 1 among the k nearest samples (id, features, label), of the row's own run
    if ``by`` names its key.

    Blocks of rows meet blocks of samples in tasks; each row's k nearest of every block are merged, ties by sample id."""
    own = materialize(rows.withColumn("_row", F.monotonically_increasing_id()), "knn-rows")
    known = materialize(samples.select(*by, "id", "features", F.col("label").cast("double").alias("label")), "knn-samples")
    run = F.struct(*by) if by else F.lit(0)
    sizes = own.groupBy(run.alias("_run")).agg(F.ceil(F.count("*") / KNN_ROWS).alias("_nq"))
    sizes = sizes.join(known.groupBy(run.alias("_run")).agg(F.ceil(F.count("*") / KNN_SAMPLES).alias("_ns")), "_run")  # a row for each run
    sizes = materialize(sizes, "knn-sizes")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n).cast("int") - 1))
    left = own.withColumn("_run", run).join(sizes, "_run").select("_run", "_row", F.col("features").alias("_x"), F.pmod(F.xxhash64("_row"), F.col("_nq")).cast("int").alias("_q"), every("_ns").alias("_s"))
    spread = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.col("_ns")).cast("int")
    right = known.withColumn("_run", run).join(sizes.select(F.col("_run"), "_nq", "_ns"), "_run").withColumn("_b", spread)
    right = right.select(F.col("_run").alias("_run2"), "id", "features", "label", F.col("_b"), every("_nq").alias("_a"))

    def compare(own: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        q, x = (np.array(d.tolist(), float).reshape(len(d), -1) for d in (own["_x"], block["features"]))
        label, ids, found = block.label.to_numpy(float), block.id.to_numpy(), []
        for begin in range(0, len(q) if len(x) else 0, KNN_STEP):
            i, j, gap = _nearest(q[begin : begin + KNN_STEP], x, ids, k)
            found.append(pd.DataFrame({"_row": own._row.to_numpy()[begin + i], "gap": gap, "id": ids[j], "label": label[j]}))
        return pd.concat(found) if found else pd.DataFrame({"_row": [], "gap": [], "id": [], "label": []})

    fields = f"_row long, gap double, id {samples.schema['id'].dataType.simpleString()}, label double"
    near = left.groupBy("_run", "_q", "_s").cogroup(right.groupBy("_run2", "_a", "_b")).applyInPandas(compare, fields)
    best = near.groupBy("_row").agg(F.slice(F.sort_array(F.collect_list(F.struct("gap", "id", "label"))), 1, k).alias("_best"))
    total = F.aggregate("_best", F.lit(0.0), lambda acc, b: acc + b["label"])
    out = own.join(best, "_row", "inner" if by else "left").withColumn("value", total / F.size("_best"))
    return out.select(*rows.columns, "value")


def _one_run(df: DataFrame) -> DataFrame:
    return df.withColumn("run_id", F.lit(0).cast("long"))


def score_logit(rows: DataFrame, samples: DataFrame) -> tuple[DataFrame, list[float]]:
    """(rows with ``value`` = P(label 1), theta) of one run; samples (features, label)."""
    from netprobe.operators.fitting import decisions, newton

    known = _one_run(samples.select("features", "label").withColumn("id", F.monotonically_increasing_id()))
    fit = materialize(newton(known), "logit-theta")
    scored = decisions(_one_run(rows), fit).withColumn("value", 1 / (1 + F.exp(-F.col("value"))))
    return scored.select(*rows.columns, "value"), [float(w) for w in fit.first()["theta"][1:]]


def score_svm(rows: DataFrame, samples: DataFrame) -> DataFrame:
    """Adds ``value``: the decision value of a machine with the kernel (1 + x y)^3, of one run."""
    from netprobe.operators.fitting import decisions, newton

    known = _one_run(samples.select("features", "label").withColumn("id", F.monotonically_increasing_id()))
    return decisions(_one_run(rows), newton(known, "squared_hinge", "polynomial"), "polynomial").select(*rows.columns, "value")


def score_positive_unlabelled(rows: DataFrame, positives: DataFrame, hold_out: float = 0.1, seed: int = 0) -> DataFrame:
    """Adds ``value`` = P(positive | x) = g(x) / c: g tells positives from unlabelled rows, c is its mean on
    held-out positives (Elkan and Noto 2008)."""
    marked = positives.withColumn("_h", uniform(seed, "pu", F.col("id")) < hold_out)
    both = marked.filter("NOT _h").select("features", F.lit(1).alias("label")).unionByName(rows.select("features", F.lit(0).alias("label")))
    scored, _ = score_logit(rows.withColumn("_k", F.lit(1)).unionByName(marked.filter("_h").select(*rows.columns).withColumn("_k", F.lit(0))), both)
    c = scored.filter("_k = 0").agg(F.avg("value").alias("_c"))
    out = scored.filter("_k = 1").crossJoin(F.broadcast(c))  # one row
    return out.withColumn("value", F.least(F.lit(1.0), F.when(F.col("_c") > 0, F.col("value") / F.col("_c")).otherwise(F.col("value")))).select(*rows.columns, "value")
