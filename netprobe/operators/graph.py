"""Shaping of edge tables. Edges are (src, dst); ``by`` names key columns, such as run_id, that keep graphs apart."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from netprobe.functions.tables import materialize


def canonical_edges(edges: DataFrame, by: Sequence[str] = (), drop_loops: bool = True) -> DataFrame:
    """Each undirected edge once, src < dst."""
    out = edges.select(*by, F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"))
    return (out.filter("src <> dst") if drop_loops else out.filter("src IS NOT NULL")).distinct()


def symmetrize(edges: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Both directions of canonical edges, by one pass over them; a loop once."""
    ends = F.when(F.col("src") == F.col("dst"), F.array(F.struct("src", "dst"))).otherwise(F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst"))))
    return edges.select(*by, F.inline(ends))


def node_set(edges: DataFrame, singletons: DataFrame | None = None, by: Sequence[str] = ()) -> DataFrame:
    out = edges.select(*by, F.explode(F.array("src", "dst")).alias("node"))
    return (out if singletons is None else out.unionByName(singletons.select(*by, "node"))).distinct()


def neighbor_sets(edges: DataFrame, nodes: DataFrame | None = None, by: Sequence[str] = ()) -> DataFrame:
    """(node, nbrs): sorted; with ``nodes``, those without neighbours have an empty list."""
    found = symmetrize(edges, by).groupBy(*by, F.col("src").alias("node")).agg(F.sort_array(F.collect_set("dst")).alias("nbrs"))
    if nodes is None:
        return found
    return nodes.select(*by, "node").join(found, [*by, "node"], "left").withColumn("nbrs", F.coalesce("nbrs", F.array().cast(found.schema["nbrs"].dataType)))


def neighbor_places(edges: DataFrame, nodes: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(node, place, nbr), each node's neighbours numbered from 0 in their order, and (node, degree).

    Rows are numbered within ranges of (node, nbr), so a hub's neighbours may lie in many of them."""
    adj = symmetrize(edges).repartitionByRange("src", "dst").withColumn("_range", F.spark_partition_id())
    adj = materialize(adj, "place-ranges")
    sizes = adj.groupBy("_range").agg(F.count("*").alias("_n"))  # a row for each range
    before = sizes.select("_range", (F.sum("_n").over(W.orderBy("_range")) - F.col("_n")).alias("_before"))
    own = F.row_number().over(W.partitionBy("_range").orderBy("src", "dst")) - 1
    rows = materialize(adj.join(before, "_range").select(F.col("src").alias("node"), F.col("dst").alias("nbr"), (F.col("_before") + own).alias("_at")), "place-rows")
    counts = rows.groupBy("node").agg(F.min("_at").alias("_first"), F.count("*").alias("degree"))
    places = materialize(rows.join(counts, "node").select("node", (F.col("_at") - F.col("_first")).alias("place"), "nbr"), "places")
    counts = counts.select("node", "degree")
    if nodes is not None:
        counts = nodes.select("node").distinct().join(counts, "node", "full").na.fill(0, ["degree"])
    return places, materialize(counts, "place-counts")


def singletons(nodes: DataFrame, edges: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return nodes.join(node_set(edges, by=by), [*by, "node"], "left_anti")


def induced_subgraph(edges: DataFrame, nodes: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Edges with both ends among the nodes."""
    own = nodes.select(*by, "node").distinct()
    for end in ("src", "dst"):
        edges = edges.join(own.withColumnRenamed("node", end), [*by, end], "left_semi")
    return edges.select(*by, "src", "dst")


def ego_nodes(edges: DataFrame, seeds: DataFrame, hops: int = 1, by: Sequence[str] = ()) -> DataFrame:
    """Seeds and all nodes within so many steps."""
    adj, found = symmetrize(edges, by), seeds.select(*by, "node").distinct()
    for _ in range(hops):
        step = adj.join(found.withColumnRenamed("node", "src"), [*by, "src"], "left_semi").select(*by, F.col("dst").alias("node"))
        found = found.unionByName(step).distinct()
    return found


def ego_expand(edges: DataFrame, seeds: DataFrame, hops: int = 1, by: Sequence[str] = ()) -> DataFrame:
    """Edges that touch a node within hops - 1 steps of a seed: stars, not neighbour to neighbour."""
    inner = ego_nodes(edges, seeds, hops - 1, by) if hops > 1 else seeds.select(*by, "node").distinct()
    adj = symmetrize(edges, by).join(inner.withColumnRenamed("node", "src"), [*by, "src"], "left_semi")
    return canonical_edges(adj, by)


def nodes_with_attr(attrs: DataFrame, attr_id: int | str) -> DataFrame:
    return attrs.filter(F.col("attr_id") == attr_id).select("node").distinct()


def complete_attrs(nodes: DataFrame, attrs: DataFrame) -> DataFrame:
    """(node, attrs): sorted; nodes without attributes have an empty list."""
    found = attrs.groupBy("node").agg(F.sort_array(F.collect_set("attr_id")).alias("attrs"))
    return nodes.select("node").join(found, "node", "left").withColumn("attrs", F.coalesce("attrs", F.array().cast(found.schema["attrs"].dataType)))


def candidates(observed: DataFrame, probes: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Observed nodes that were not probed; the columns of ``observed`` stay."""
    return observed.join(probes.select(*by, "node").distinct(), [*by, "node"], "left_anti")


def probed_nodes(observed: DataFrame, probes: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return observed.join(probes.select(*by, "node").distinct(), [*by, "node"], "left_semi")
