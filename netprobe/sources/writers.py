"""Writers of curves, logs, features and edges."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netprobe.operators.graph import symmetrize


def write_curve(curves: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Curves (model, alpha, probe, avg, std), a folder for each model and alpha; tsv with the published head."""
    if fmt == "parquet":
        curves.write.partitionBy("model", "alpha").mode("append").parquet(path)
        return
    named = curves.select("model", "alpha", F.col("probe").alias("Probe"), F.col("avg").alias("AvgRewards"), F.col("std").alias("StdRewards"))
    named.repartition("model", "alpha").sortWithinPartitions("model", "alpha", "Probe").write.partitionBy("model", "alpha").option("sep", "\t").option("header", True).mode("append").csv(path)


def write_step_log(log: DataFrame, path: str, width: int = 0, fmt: str = "parquet") -> None:
    """Append steps (query, reward, estimate, delta, jump, p, theta); tsv has a column Theta[i] for each weight."""
    if fmt == "parquet":
        log.write.mode("append").parquet(path)
        return
    wide = log.select("query", "reward", "estimate", "delta", "jump", "p", *[F.col("theta")[i].alias(f"Theta[{i}]") for i in range(width)])
    wide.write.mode("append").option("sep", "\t").option("header", True).csv(path)


def format_probe_log(complete: DataFrame, probes: DataFrame, targets: DataFrame) -> DataFrame:
    """(seq, line): ``node:label,nbr:label,...``; a probed node is 1 as a target, else 0; a neighbour that was
    not probed before this step is -1."""
    adj = symmetrize(complete).select(F.col("src").alias("node"), F.col("dst").alias("nbr"))
    label = targets.select("node", F.lit(1).alias("hit")).distinct()
    own = probes.select("seq", "node").join(label, "node", "left").withColumn("hit", F.coalesce("hit", F.lit(0)))
    theirs = own.select(F.col("node").alias("nbr"), F.col("seq").alias("nbr_seq"), F.col("hit").alias("nbr_hit"))
    rows = own.join(adj, "node", "left").join(theirs, "nbr", "left")
    mark = F.when(F.col("nbr_seq") < F.col("seq"), F.col("nbr_hit")).otherwise(-1)
    each = F.when(F.col("nbr").isNotNull(), F.struct("nbr", F.concat_ws(":", F.col("nbr").cast("string"), mark.cast("string")).alias("t")))
    lines = rows.groupBy("seq", "node", "hit").agg(F.sort_array(F.collect_list(each)).alias("n"))
    return lines.select("seq", F.concat_ws(",", F.concat_ws(":", F.col("node").cast("string"), F.col("hit").cast("string")), F.transform("n", lambda x: x["t"])).alias("line"))


def write_features(features: DataFrame, path: str, columns: list[str], query: int) -> None:
    """Rows ``node,f0,f1,...`` without a head, in a folder for the query."""
    features.select("node", *columns).write.mode("overwrite").csv(f"{path}/query={query}")


def write_edge_list(edges: DataFrame, path: str) -> None:
    """Each edge in both directions, ``u v``."""
    symmetrize(edges).select(F.concat_ws(" ", "src", "dst").alias("value")).write.mode("overwrite").text(path)


def upsert_stats(names: DataFrame, path: str, compute) -> DataFrame:  # noqa: ANN001
    """Statistics by name: those stored under ``path``, and ``compute(missing names)`` appended to them."""
    spark = names.sparkSession
    try:
        stored = spark.read.parquet(path)
        missing = names.join(stored.select("name"), "name", "left_anti")
    except AnalysisException:
        missing = names
    if not missing.isEmpty():
        compute(missing).write.mode("append").parquet(path)
    return spark.read.parquet(path).join(names, "name", "left_semi")
