"""Value functions and choices: score the unprobed nodes, pick the next to probe."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from netprobe.functions.hashing import hash_key, uniform


def score_linear(features: DataFrame, columns: Sequence[str], theta: Sequence[float]) -> DataFrame:
    """Adds ``value``: features times theta."""
    total = F.lit(0.0)
    for c, w in zip(columns, theta, strict=True):
        total = total + F.col(c) * float(w)
    return features.withColumn("value", total)


def score_linear_by_run(features: DataFrame, columns: Sequence[str], thetas: DataFrame, by: Sequence[str] = ("run_id",)) -> DataFrame:
    """As ``score_linear``, with each run's own theta array of (run_id, theta)."""
    vector = F.array(*[F.col(c).cast("double") for c in columns])
    dot = F.aggregate(F.zip_with(vector, F.col("theta"), lambda x, w: x * w), F.lit(0.0), lambda a, x: a + x)
    return features.join(thetas, list(by)).withColumn("value", dot).drop("theta")


def score_degree(features: DataFrame) -> DataFrame:
    return features.withColumn("value", F.col("degree").cast("double"))


def score_mod(features: DataFrame) -> DataFrame:
    """By the number of target neighbours."""
    return features.withColumn("value", F.col("target_nbrs").cast("double"))


#: Value functions by the policy's name; ``rand`` and ``low`` score by degree and choose otherwise.
POLICIES: dict[str, Callable[..., DataFrame]] = {"linear": score_linear, "high": score_degree, "low": score_degree, "rand": score_degree, "mod": score_mod}


def choose_top(scored: DataFrame, k: int, by: Sequence[str] = (), lowest: bool = False) -> DataFrame:
    """(rank, node, value): the k best of each run, ties to the lower node. Spark keeps k rows of each
    partition before it shuffles."""
    order = [F.col("value").asc() if lowest else F.col("value").desc(), F.col("node")]
    if by:
        ranked = scored.withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy(*order))).filter(F.col("rank") <= k)
    else:
        ranked = scored.orderBy(*order).limit(k)
        ranked = ranked.withColumn("rank", F.row_number().over(W.partitionBy(F.lit(0)).orderBy(*order)))  # k rows
    return ranked.select(*by, "rank", "node", "value")


def choose_epsilon_greedy(scored: DataFrame, k: int, epsilon: float, seed: int = 0, step: int = 0, by: Sequence[str] = ()) -> DataFrame:
    """(slot, node, jump): each slot is greedy, or with probability epsilon random among the first sample's
    unprobed nodes, then among all others. ``scored``: node, value, is_initial. A node is chosen once: slots
    take from the two orders in turn, and random ones leave out what the greedy slots took."""
    keys = [F.col(c) for c in by]
    group = W.partitionBy(*by) if by else W.partitionBy(F.lit(0))
    slots = scored.sparkSession.range(k).select(F.col("id").cast("int").alias("slot"))
    jumps = uniform(seed, "eps", *keys, step, F.col("slot")) < epsilon
    if by:
        slots = scored.select(*by).distinct().withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    slots = slots.withColumn("jump", jumps.cast("int"))
    place = F.row_number().over(W.partitionBy(*by, "jump").orderBy("slot"))
    slots = slots.withColumn("place", place)
    greedy = choose_top(scored, k, by).select(*by, "node", F.col("rank").alias("place"))
    greedy = slots.filter("jump = 0").join(greedy, [*by, "place"]).select(*by, "slot", "node", "jump")
    rest = scored.join(greedy.select(*by, "node"), [*by, "node"], "left_anti").select(*by, "node", "is_initial")
    order = [F.col("is_initial").desc(), hash_key(seed, "rand", *keys, step, F.col("node")), F.col("node")]
    if by:
        shuffled = rest.withColumn("place", F.row_number().over(group.orderBy(*order))).filter(F.col("place") <= k)
    else:
        shuffled = rest.orderBy(*order).limit(k).withColumn("place", F.row_number().over(group.orderBy(*order)))  # k rows
    random = slots.filter("jump = 1").join(shuffled, [*by, "place"]).select(*by, "slot", "node", "jump")
    return greedy.unionByName(random)


def decayed_epsilon(epsilon: float, query: Column, budget: int) -> Column:
    return F.lit(float(epsilon)) * F.exp(-query / F.lit(float(budget)))


def softmax(df: DataFrame, column: str, by: Sequence[str] = ()) -> DataFrame:
    """Adds ``p``: exp(x) over its sum; the maximum is taken off first."""
    top = df.groupBy(*by).agg(F.max(column).alias("_top"))
    out = df.join(top, list(by)) if by else df.crossJoin(F.broadcast(top))
    out = out.withColumn("_e", F.exp(F.col(column) - F.col("_top"))).drop("_top")
    total = out.groupBy(*by).agg(F.sum("_e").alias("_all"))
    out = out.join(total, list(by)) if by else out.crossJoin(F.broadcast(total))
    return out.withColumn("p", F.col("_e") / F.col("_all")).drop("_e", "_all")
