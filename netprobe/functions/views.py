"""Graphs, attributes, probes and runs derived from the star-schema tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netprobe.functions.hashing import hash_key
from netprobe.operators.graph import node_set

TARGET_BRAND = "Brand#13"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def co_purchases(spark: SparkSession, sf_dir: str, least: float | None = None, flag: str | None = "R") -> DataFrame:
    """Pairs of parts returned (or, without a flag, ordered) in one order, in both directions and as often as they occur."""
    lines = table(spark, sf_dir, "lineitem")
    if flag is not None:
        lines = lines.filter(F.col("l_returnflag") == flag)
    if least is not None:
        lines = lines.filter(F.col("l_quantity") >= least)
    one = lines.select("l_orderkey", F.col("l_partkey").alias("src"))
    two = lines.select("l_orderkey", F.col("l_partkey").alias("dst"))
    return one.join(two, "l_orderkey").select("src", "dst")


#: Order lines for each part of a table of pairs; so many make about four times as many pairs.
PAIR_LINES = 200_000


def _pairs(spark: SparkSession, sf_dir: str, *options: object) -> DataFrame:
    """The distinct pairs of ``co_purchases``, src < dst. Pairs are dealt before they are compared, into parts whose
    number grows with the table, so what a task holds does not."""
    pairs = co_purchases(spark, sf_dir, *options).filter("src < dst")  # the other direction is there as well
    parts = table(spark, sf_dir, "lineitem").count() // PAIR_LINES
    return pairs.repartition(parts, "src", "dst").distinct() if parts > 1 else pairs.distinct()


def complete_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir)


def all_lines_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir, None, None)


def observed_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir, 35)


def observed_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return node_set(observed_graph(spark, sf_dir))


def targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").filter(F.col("p_brand") == TARGET_BRAND).select(F.col("p_partkey").alias("node"))


def probe_log(nodes: DataFrame, seed: int = 7) -> DataFrame:
    """(node, seq): all nodes in the order of their hashes."""
    from netprobe.operators.sampling import dense_rank_by

    return dense_rank_by(nodes.select("node"), hash_key(seed, F.col("node")), "seq")


def seed_probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The observed nodes that have the target attribute, in the order of their hashes."""
    return probe_log(observed_nodes(spark, sf_dir).join(targets(spark, sf_dir), "node", "left_semi"))


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(run_id, param, reward, seq): each user's events as one run."""
    from pyspark.sql import Window as W

    events = table(spark, sf_dir, "events")
    order = W.partitionBy("user_id").orderBy("ts", "event_id")
    return events.select(F.col("user_id").alias("run_id"), F.col("event_type").alias("param"), F.col("value").alias("reward"), (F.row_number().over(order) - 1).alias("seq"))
