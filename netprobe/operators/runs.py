"""Analytics over the logs of many runs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from netprobe.functions.hashing import hash_key


def cumulative_reward(log: DataFrame, by: Sequence[str] = ("run_id",), value: str = "reward", out: str = "cum_reward") -> DataFrame:
    order = W.partitionBy(*by).orderBy("seq").rowsBetween(W.unboundedPreceding, 0)
    return log.withColumn(out, F.sum(value).over(order))


def total_reward(log: DataFrame, by: Sequence[str] = ("run_id",)) -> DataFrame:
    return log.groupBy(*by).agg(F.sum("reward").alias("total_reward"), F.count("*").alias("n_probes"))


def reward_curves(curves: DataFrame, keys: Sequence[str], value: str = "cum_reward") -> DataFrame:
    """Mean and population deviation over the runs that reached each probe."""
    return curves.groupBy(*keys, F.col("seq").alias("probe")).agg(F.avg(value).alias("avg"), F.stddev_pop(value).alias("std"), F.count("*").alias("n_runs"))


def best_params(curves: DataFrame, groups: Sequence[str], params: Sequence[str]) -> DataFrame:
    """For each group, the parameters whose mean reward rises highest; ties to the lower parameters."""
    top = curves.groupBy(*groups, *params).agg(F.max("avg").alias("best"))
    order = W.partitionBy(*groups).orderBy(F.col("best").desc(), *params)
    return top.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")


def error_curves(log: DataFrame, keys: Sequence[str], low: int = 50, high: int = 5000) -> DataFrame:
    """Mean and deviation of the absolute errors (``delta``, null as 0) summed from probe low to high."""
    own = log.filter((F.col("seq") >= low) & (F.col("seq") < high)).withColumn("err", F.abs(F.coalesce("delta", F.lit(0.0))))
    return reward_curves(cumulative_reward(own, ("run_id",), "err", "cum_error"), keys, "cum_error")


def theta_curves(log: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Each weight's mean and deviation by probe, of logs with a ``theta`` array."""
    long = log.select(*keys, F.col("seq").alias("probe"), F.posexplode("theta").alias("j", "w"))
    return long.groupBy(*keys, "j", "probe").agg(F.avg("w").alias("avg"), F.stddev_pop("w").alias("std"))


def gain_table(final: DataFrame, key: str, value: str, others: Mapping[str, str]) -> DataFrame:
    """Percentage gains of ``value`` over other columns: {output: column}."""
    gains = [(100 * (F.col(value) - F.col(c)) / F.col(c)).alias(k) for k, c in others.items()]
    return final.select(key, *gains)


def gain_extremes(gains: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(measure, least, most, least_at, most_at): the ends of each gain over all networks; ties to the first name."""
    key = gains.columns[0]
    long = gains.select(key, F.inline(F.array(*[F.struct(F.lit(c).alias("measure"), F.col(c).alias("gain")) for c in columns])))
    ends = long.filter("gain IS NOT NULL").groupBy("measure").agg(F.min(F.struct("gain", key)).alias("lo"), F.min(F.struct((-F.col("gain")).alias("gain"), key)).alias("hi"))
    return ends.select("measure", F.col("lo.gain").alias("least"), (-F.col("hi.gain")).alias("most"), F.col(f"lo.{key}").alias("least_at"), F.col(f"hi.{key}").alias("most_at"))


def curve_maxima(bands: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, top, at): the highest mean of each curve, and its first x."""
    best = bands.groupBy(*keys).agg(F.min(F.struct((-F.col("avg")).alias("top"), "x")).alias("b"))
    return best.select(*keys, (-F.col("b.top")).alias("top"), F.col("b.x").alias("at"))


def curve_bands(curves: DataFrame, keys: Sequence[str], low: int, high: int, every: int = 10, nodes: int | None = None) -> DataFrame:
    """Every tenth probe of a range with avg - std and avg + std; x is the probe, over the nodes if given."""
    x = F.col("probe") / nodes if nodes else F.col("probe").cast("double")
    own = curves.filter((F.col("probe") >= low) & (F.col("probe") < high) & (F.col("probe") % every == 0))
    return own.select(*keys, "probe", x.alias("x"), "avg", (F.col("avg") - F.col("std")).alias("low"), (F.col("avg") + F.col("std")).alias("high"))


def run_grid(spark: SparkSession, params: Mapping[str, Sequence], iterations: int) -> DataFrame:
    """All combinations of the parameters, each ``iterations`` times, with run_id and seed from their hash."""
    out = spark.range(iterations).select(F.col("id").cast("int").alias("iter"))
    for name, values in params.items():
        out = out.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    return with_run_ids(out, [*params, "iter"])


def with_run_ids(grid: DataFrame, columns: Sequence[str]) -> DataFrame:
    digest = hash_key(*[F.col(c) for c in columns])
    return grid.withColumn("run_id", digest).withColumn("seed", F.conv(F.substring(digest, 1, 8), 16, 10).cast("long"))
