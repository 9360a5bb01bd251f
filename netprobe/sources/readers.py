"""Readers of networks, attributes, embeddings and run logs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from netprobe.operators.graph import canonical_edges


def read_network(spark: SparkSession, path: str, drop_loops: bool = True) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of an edge or adjacency list: the first token of a line is joined to all later ones, up
    to one that holds ``{``. Lines with ``#`` and empty lines are left out; a lone token is a singleton."""
    lines = spark.read.text(path).filter(~F.contains("value", F.lit("#"))).select(F.split(F.trim(F.regexp_replace("value", "\\s+", " ")), " ").alias("t")).filter("t[0] <> ''")
    stop = F.coalesce(F.array_min(F.filter(F.transform("t", lambda x, i: F.when(F.contains(x, F.lit("{")), i)), lambda i: i.isNotNull())), F.size("t"))
    cut = lines.select(F.slice("t", F.lit(1), stop).alias("t")).filter("size(t) > 0")
    edges = cut.select(F.col("t")[0].alias("src"), F.explode(F.slice("t", F.lit(2), F.size("t"))).alias("dst"))
    nodes = cut.select(F.explode("t").alias("node")).distinct()
    return nodes, canonical_edges(edges, drop_loops=drop_loops)


def read_edge_list(spark: SparkSession, path: str, delim: str = " ") -> tuple[int, DataFrame]:
    """(number of nodes, edges) of the first two columns."""
    rows = spark.read.option("sep", delim).option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True).csv(path)
    first, second = rows.columns[:2]
    edges = canonical_edges(rows.select(F.trim(first).alias("src"), F.trim(second).alias("dst")).dropna())
    n = edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct().count()
    return n, edges


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(value, number): lines with their 0-based place, files by name. Lines of a split are numbered by its task, and the
    splits' sizes are summed: no line goes through the driver."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_id"))
    sizes = lines.groupBy("_file", "_block").agg(F.count("*").alias("_n"))  # a row for each split
    before = W.partitionBy(F.lit(0)).orderBy("_file", "_block").rowsBetween(W.unboundedPreceding, -1)
    bases = sizes.select("_file", "_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    own = F.row_number().over(W.partitionBy("_file", "_block").orderBy("_id")) - 1
    return lines.withColumn("_own", own).join(bases, ["_file", "_block"]).select("value", (F.col("_base") + F.col("_own")).alias("number"))


def read_attributes(spark: SparkSession, path: str, delim: str = "\t", ids: Sequence[int] | None = None) -> DataFrame:
    """(node, attr_id): a line's 0-based number is the attribute that its tokens, nodes, have."""
    lines = numbered_lines(spark, path).select("value", F.col("number").cast("int").alias("attr_id"))
    if ids:
        lines = lines.filter(F.col("attr_id").isin(list(ids)))
    tokens = F.explode(F.split("value", f"\\Q{delim}\\E"))
    return lines.select(tokens.alias("node"), "attr_id").select(F.trim("node").alias("node"), "attr_id").filter("node <> ''").distinct()


def read_embeddings(spark: SparkSession, path: str) -> DataFrame:
    """(node, vec) of lines ``node x1 ... xd``. A first line ``n d`` of two whole numbers, where d is the length of the
    longest vector, is a head; empty lines are left out."""
    parts = numbered_lines(spark, path).select("number", F.split(F.trim("value"), "\\s+").alias("t")).filter("size(t) > 1")
    longest = parts.filter("number > 0").agg(F.max(F.size("t")) - 1).first()[0]
    head = (F.col("number") == 0) & (F.size("t") == 2) & F.col("t")[0].rlike("^[0-9]+$") & (F.col("t")[1] == F.lit(str(longest)))
    return parts.filter(~head).select(F.col("t")[0].alias("node"), F.transform(F.slice("t", F.lit(2), F.size("t")), lambda x: x.cast("double")).alias("vec"))


def _read_tsv(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame | None:
    found = None
    for path in [paths] if isinstance(paths, str) else paths:
        try:
            rows = spark.read.option("sep", "\t").option("header", True).csv(path).withColumn("file", F.input_file_name())
        except AnalysisException:
            continue  # a missing log is passed over
        found = rows if found is None else found.unionByName(rows, allowMissingColumns=True)
    return found


def path_parameters(df: DataFrame) -> DataFrame:
    """Adds the parameters that the file's path names (null if it names none)."""
    number = "([0-9]+(?:\\.[0-9]+)?)"
    patterns = {"mu": f"mu-{number}", "exponent": f"mu-[0-9.]+-alpha-{number}", "k": "-k-([a-z0-9]+)", "epsilon": f"epsilon-{number}", "decay": "decay-([01])", "sample": f"(?:node|walk)-{number}", "iter": "_iter([0-9]+)", "alpha": f"_a{number}"}
    for name, pattern in patterns.items():
        found = F.regexp_extract("file", pattern, 1)
        df = df.withColumn(name, F.when(found != "", found))
    return df


def read_curves(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame | None:
    """Reward curves (Probe, AvgRewards, StdRewards) with the parameters of their paths."""
    rows = _read_tsv(spark, paths)
    if rows is None:
        return None
    out = path_parameters(rows)
    return out.select(F.col("Probe").cast("int").alias("probe"), F.col("AvgRewards").cast("double").alias("avg"), F.col("StdRewards").cast("double").alias("std"), "mu", "exponent", "k", "epsilon", "decay", "sample", "alpha", "file")


def read_run_logs(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame | None:
    """Step logs with their weights gathered to an array, and the run's number from the path."""
    rows = _read_tsv(spark, paths)
    if rows is None:
        return None
    weights = sorted((c for c in rows.columns if c.startswith("Theta[")), key=lambda c: int(c[6:-1]))
    theta = F.array(*[F.col(f"`{c}`").cast("double") for c in weights]) if weights else F.array().cast("array<double>")
    out = path_parameters(rows)
    return out.select(F.col("iter").cast("int").alias("run_id"), F.col("query").cast("int").alias("seq"), *[F.col(c).cast("double").alias(c) for c in ("reward", "estimate", "delta", "p")], F.col("jump").cast("int").alias("jump"), theta.alias("theta"), "file")
