"""Node features of observed graphs. Every function returns a row for each node of ``nodes``."""

from __future__ import annotations

import math
from collections.abc import Sequence
from itertools import combinations_with_replacement

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from netprobe.functions.tables import materialize
from netprobe.operators.components import connected_components
from netprobe.operators.graph import ego_nodes, node_set, symmetrize
from netprobe.operators.probing import probed_neighbors


def degrees(edges: DataFrame, nodes: DataFrame | None = None, by: Sequence[str] = ()) -> DataFrame:
    """(node, degree); singletons have 0. Without ``nodes``, of those that have edges."""
    found = symmetrize(edges, by).groupBy(*by, F.col("src").alias("node")).agg(F.count("*").alias("degree"))
    if nodes is None:
        return found
    return nodes.select(*by, "node").join(found, [*by, "node"], "left").na.fill(0, ["degree"])


def min_max(df: DataFrame, columns: Sequence[str], by: Sequence[str] = (), zero: float = 0.0, suffix: str = "_norm") -> DataFrame:
    """Adds (x - min) / (max - min) of each column; ``zero`` where all values are equal. One row for each
    value of ``by`` goes back to the rows."""
    ends = df.groupBy(*by).agg(*[f(c).alias(f"_{k}_{c}") for c in columns for k, f in (("lo", F.min), ("hi", F.max))])
    out = df.join(materialize(ends, "ends"), list(by)) if by else df.crossJoin(F.broadcast(ends))  # without keys: one row
    for c in columns:
        span = F.col(f"_hi_{c}") - F.col(f"_lo_{c}")
        out = out.withColumn(c + suffix, F.when(span == 0, zero).otherwise((F.col(c) - F.col(f"_lo_{c}")) / span))
    return out.drop(*[f"_{k}_{c}" for c in columns for k in ("lo", "hi")])


def triangles(edges: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(a, b, c), each triangle once. Edges point from the lower (degree, id) to the higher, so a hub
    has few of them, and what is sent is bounded by m^1.5 ids.

    A node's list of higher neighbours is sent to each of them, without those up to it, and met there with that one's own
    list: a row for each edge, not for each wedge, and none of them is sorted."""
    deg = symmetrize(edges, by).groupBy(*by, F.col("src").alias("node")).agg(F.count("*").alias("d"))
    one = deg.select(*by, F.col("node").alias("src"), F.col("d").alias("d1"))
    two = deg.select(*by, F.col("node").alias("dst"), F.col("d").alias("d2"))
    both = edges.select(*by, "src", "dst").join(one, [*by, "src"]).join(two, [*by, "dst"])
    up = F.struct("d1", "src") < F.struct("d2", "dst")
    arcs = both.select(*by, F.when(up, F.col("src")).otherwise(F.col("dst")).alias("a"), F.when(up, F.struct(F.col("d2").alias("d"), F.col("dst").alias("b"))).otherwise(F.struct(F.col("d1").alias("d"), F.col("src").alias("b"))).alias("_to"))
    lists = arcs.groupBy(*by, "a").agg(F.sort_array(F.collect_list("_to"))["b"].alias("_above"))
    sent = lists.select(*by, "a", "_above", F.posexplode("_above").alias("_i", "b")).filter(F.col("_i") + 1 < F.size("_above"))
    sent = sent.select(*by, "a", "b", F.slice("_above", F.col("_i") + 2, F.size("_above")).alias("_rest"))
    theirs = lists.select(*by, F.col("a").alias("b"), F.col("_above").alias("_theirs")).hint("shuffle_hash")
    return sent.join(theirs, [*by, "b"]).select(*by, "a", "b", F.explode(F.array_intersect("_rest", "_theirs")).alias("c"))


def triangle_counts(edges: DataFrame, nodes: DataFrame | None, by: Sequence[str] = (), found: DataFrame | None = None) -> DataFrame:
    """(node, degree, triangles). ``found``: the triangles of nodes that have any, if they are counted already."""
    if found is None:
        found = triangles(edges, by).select(*by, F.explode(F.array("a", "b", "c")).alias("node")).groupBy(*by, "node").agg(F.count("*").alias("triangles"))
    return degrees(edges, nodes, by).join(found, [*by, "node"], "left").na.fill(0, ["triangles"])


def clustering(edges: DataFrame, nodes: DataFrame | None, by: Sequence[str] = (), found: DataFrame | None = None) -> DataFrame:
    """(node, degree, triangles, cc): 2 t / (d (d - 1)), 0 under degree 2. ``found`` as in ``triangle_counts``."""
    cc = F.when(F.col("degree") > 1, 2 * F.col("triangles") / (F.col("degree") * (F.col("degree") - 1))).otherwise(0.0)
    return triangle_counts(edges, nodes, by, found).withColumn("cc", cc)


def component_sizes(comps: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(node, comp, size, size_norm): 1 for all where sizes do not differ."""
    sizes = comps.groupBy(*by, "comp").agg(F.count("*").alias("size"))
    sizes = materialize(min_max(sizes, ["size"], by, 1.0), "component-sizes")  # as a table, Spark sees how small it is
    return comps.join(sizes, [*by, "comp"]).select(*by, "node", "comp", "size", "size_norm")


def merge_components(comps: DataFrame, new_edges: DataFrame, new_nodes: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Components after new edges and nodes: only labels that the new edges touch are joined anew."""
    known = comps.select(*by, "node", "comp").unionByName(new_nodes.select(*by, "node", F.col("node").alias("comp")))
    own = materialize(node_set(new_edges, by=by), "cc-ends")
    own = materialize(known.join(own, [*by, "node"], "left_semi"), "cc-ends")  # few of all nodes
    one = own.select(*by, F.col("node").alias("src"), F.col("comp").alias("a"))
    two = own.select(*by, F.col("node").alias("dst"), F.col("comp").alias("b"))
    ends = new_edges.select(*by, "src", "dst").join(one, [*by, "src"]).join(two, [*by, "dst"])
    links = ends.filter("a <> b").select(*by, F.col("a").alias("src"), F.col("b").alias("dst")).distinct()
    moved = connected_components(links, by=by).select(*by, F.col("node").alias("comp"), F.col("comp").alias("to"))
    moved = materialize(moved, "cc-moved")
    return known.join(moved, [*by, "comp"], "left").select(*by, "node", F.coalesce("to", "comp").alias("comp"))


def frac_probed(edges: DataFrame, nodes: DataFrame, probes: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(node, degree, probed_nbrs, frac_probed): 0 at degree 0."""
    found = probed_neighbors(edges, probes, by).withColumnRenamed("n", "probed_nbrs")
    out = degrees(edges, nodes, by).join(found, [*by, "node"], "left").na.fill(0, ["probed_nbrs"])
    return out.withColumn("frac_probed", F.when(F.col("degree") > 0, F.col("probed_nbrs") / F.col("degree")).otherwise(0.0))


def target_neighbors(edges: DataFrame, nodes: DataFrame, targets: DataFrame, by: Sequence[str] = (), probes: DataFrame | None = None) -> DataFrame:
    """(node, n): neighbours with the target attribute; with ``probes``, only those whose label is known."""
    own = targets.select(F.col("node").alias("src")).distinct()
    adj = symmetrize(edges, by).join(own, "src", "left_semi")
    if probes is not None:
        adj = adj.join(probes.select(*by, F.col("node").alias("src")).distinct(), [*by, "src"], "left_semi")
    found = adj.groupBy(*by, F.col("dst").alias("node")).agg(F.count("*").alias("n"))
    return nodes.select(*by, "node").join(found, [*by, "node"], "left").na.fill(0, ["n"])


def probed_overlap(edges: DataFrame, nodes: DataFrame, given: DataFrame) -> DataFrame:
    """(node, n, overlap): the share of the given nodes that are neighbours; 0 if none is given."""
    given = given.select("node").distinct()
    out = nodes.select("node").join(probed_neighbors(edges, given), "node", "left").na.fill(0, ["n"])
    out = out.crossJoin(F.broadcast(given.agg(F.count("*").alias("_all"))))
    return out.select("node", "n", F.when(F.col("_all") > 0, F.col("n") / F.col("_all")).otherwise(0.0).alias("overlap"))


def egonet_counts(edges: DataFrame, nodes: DataFrame, probes: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(node, degree, triangles, leaving, probed_nbrs): edges among and out of each node's neighbours.

    A neighbour's edges that leave number its degree less the common neighbours less one; the common
    neighbours of all edges at a node sum up to twice its triangles."""
    own = triangle_counts(edges, nodes, by)
    deg = own.select(*by, F.col("node").alias("dst"), F.col("degree").alias("d"))
    reach = symmetrize(edges, by).join(deg, [*by, "dst"]).groupBy(*by, F.col("src").alias("node")).agg(F.sum(F.col("d") - 1).alias("_reach"))
    probed = probed_neighbors(edges, probes, by).withColumnRenamed("n", "probed_nbrs")
    out = own.join(reach, [*by, "node"], "left").join(probed, [*by, "node"], "left").na.fill(0, ["_reach", "probed_nbrs"])
    return out.select(*by, "node", "degree", "triangles", (F.col("_reach") - 2 * F.col("triangles")).alias("leaving"), "probed_nbrs")


REFEX_BASE = ("degree", "triangles", "leaving", "probed_nbrs")


def neighbor_aggregate(edges: DataFrame, base: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Adds sums, medians, minima and maxima of the columns over each node's neighbours; 0 without any."""
    theirs = base.select(*by, F.col("node").alias("dst"), *columns)
    kinds = {"sum": F.sum, "median": lambda c: F.percentile(c, F.lit(0.5)), "min": F.min, "max": F.max}
    found = symmetrize(edges, by).join(theirs, [*by, "dst"]).groupBy(*by, F.col("src").alias("node")).agg(*[f(F.col(c)).cast("double").alias(f"{k}_{c}") for k, f in kinds.items() for c in columns])
    return base.join(found, [*by, "node"], "left").na.fill(0.0, [f"{k}_{c}" for k in kinds for c in columns])


def refex_raw(edges: DataFrame, nodes: DataFrame, probes: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Local and neighbour-aggregated columns: 20 features."""
    return neighbor_aggregate(edges, egonet_counts(edges, nodes, probes, by), REFEX_BASE, by)


def refex_features(edges: DataFrame, nodes: DataFrame, probes: DataFrame, comps: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Local and neighbour-aggregated columns (raw and normalised) and the component size: 21 features."""
    base = refex_raw(edges, nodes, probes, by)
    columns = [c for c in base.columns if c not in (*by, "node")]
    return min_max(base, columns, by).join(component_sizes(comps, by).select(*by, "node", "size_norm"), [*by, "node"])


def knn_raw(edges: DataFrame, nodes: DataFrame, probes: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """degree, probed_nbrs, mean and median of the neighbours' degrees."""
    own = frac_probed(edges, nodes, probes, by).drop("frac_probed")
    theirs = own.select(*by, F.col("node").alias("dst"), F.col("degree").alias("d"))
    found = symmetrize(edges, by).join(theirs, [*by, "dst"]).groupBy(*by, F.col("src").alias("node")).agg(F.avg("d").alias("mean_degree"), F.percentile("d", F.lit(0.5)).alias("median_degree"))
    return own.join(found, [*by, "node"], "left").na.fill(0.0, ["mean_degree", "median_degree"])


def knn_features(edges: DataFrame, nodes: DataFrame, probes: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``knn_raw``, raw and normalised."""
    return min_max(knn_raw(edges, nodes, probes, by), ["degree", "probed_nbrs", "mean_degree", "median_degree"], by)


def netdisc_features(edges: DataFrame, nodes: DataFrame, probes: DataFrame, comps: DataFrame, targets: DataFrame | None = None, by: Sequence[str] = ()) -> DataFrame:
    """degree_norm, cc, size_norm, frac_probed and, with targets, target_nbrs."""
    out = min_max(clustering(edges, nodes, by).select(*by, "node", "degree", "cc"), ["degree"], by)
    out = out.join(component_sizes(comps, by).select(*by, "node", "size_norm"), [*by, "node"])
    out = out.join(frac_probed(edges, nodes, probes, by).select(*by, "node", "frac_probed"), [*by, "node"])
    if targets is not None:
        out = out.join(target_neighbors(edges, nodes, targets, by).withColumnRenamed("n", "target_nbrs"), [*by, "node"])
    return out


def default_features(edges: DataFrame, nodes: DataFrame, probes: DataFrame, comps: DataFrame, counts: DataFrame, targets: DataFrame | None = None, by: Sequence[str] = ()) -> DataFrame:
    """``netdisc_features`` and the normalised reward count (``counts``: node, n)."""
    out = netdisc_features(edges, nodes, probes, comps, targets, by)
    own = out.select(*by, "node").join(counts.select(*by, "node", F.col("n").alias("reward_count")), [*by, "node"], "left").na.fill(0, ["reward_count"])
    own = min_max(own, ["reward_count"], by)
    return out.join(own.select(*by, "node", "reward_count", "reward_count_norm"), [*by, "node"])


#: How far a probe's change reaches, in steps from the probed node, by feature set.
REACH = {"default": 1, "netdisc": 1, "knn": 2, "refex": 3}
_LOCAL = ("degree", "triangles", "cc", "probed_nbrs")
#: Features before normalisation, by feature set.
RAW = {
    "default": _LOCAL, "netdisc": _LOCAL, "knn": ("degree", "probed_nbrs", "mean_degree", "median_degree"),
    "refex": (*REFEX_BASE, *[f"{k}_{c}" for k in ("sum", "median", "min", "max") for c in REFEX_BASE]),
}


def raw_features(kind: str, edges: DataFrame, nodes: DataFrame, probes: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(node, the columns of ``RAW[kind]``)."""
    if kind == "knn":
        out = knn_raw(edges, nodes, probes, by)
    elif kind == "refex":
        out = refex_raw(edges, nodes, probes, by)
    else:
        found = probed_neighbors(edges, probes, by).withColumnRenamed("n", "probed_nbrs")
        out = clustering(edges, nodes, by).join(found, [*by, "node"], "left").na.fill(0, ["probed_nbrs"])
    return out.select(*by, "node", *RAW[kind])


def refresh_raw(old: DataFrame, after: DataFrame, nodes: DataFrame, probes: DataFrame, changed: DataFrame, kind: str = "default", by: Sequence[str] = ()) -> DataFrame:
    """Raw features of the set ``kind`` after probes: only nodes within its reach of a changed (probed) one are
    made anew, from the edges around them; all others keep their old row."""
    affected = materialize(ego_nodes(after, changed, REACH[kind], by).join(nodes, [*by, "node"], "left_semi"), "refresh-affected")
    # a row depends on its neighbours' rows, and these on edges a step less far than the reach
    rim = materialize(ego_nodes(after, affected, max(1, REACH[kind] - 1), by), "refresh-rim")
    own = rim.select(*by, F.col("node").alias("src"))
    near = symmetrize(after, by).join(own, [*by, "src"], "left_semi").select(*by, F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()
    near = materialize(near, "refresh-edges")
    fresh = raw_features(kind, near, rim, probes, by).join(affected, [*by, "node"], "left_semi")
    return old.join(affected, [*by, "node"], "left_anti").select(*by, "node", *RAW[kind]).unionByName(fresh)


def polynomial_features(df: DataFrame, columns: Sequence[str], order: int = 2) -> DataFrame:
    """Adds ``poly``: 1 and all products of ``order`` of (1, columns), with repetition, in upper-triangle order."""
    terms = [F.lit(1.0), *[clean(F.col(c)) for c in columns]]

    def product(parts: tuple[Column, ...]) -> Column:
        out = parts[0]
        for p in parts[1:]:
            out = out * p
        return out

    return df.withColumn("poly", F.array(*[product(p) for p in combinations_with_replacement(terms, order)]))


def clean(column: Column) -> Column:
    """NaN and null to 0."""
    return F.coalesce(F.nanvl(column.cast("double"), F.lit(0.0)), F.lit(0.0))


def log_bins(df: DataFrame, column: str, p: float = 0.5) -> DataFrame:
    """Adds ``bin``: the lowest share p of the rows (and ties) is bin 1, then the same of the rest; null stays null.

    Running counts of the distinct values are made in ranges; each cut point, about log(rows) in all, is one
    aggregate over them."""
    values = df.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    values = materialize(values.repartitionByRange("value").withColumn("_range", F.spark_partition_id()), "bin-values")
    sizes = values.groupBy("_range").agg(F.sum("n").alias("_n"))  # a row for each range
    before = sizes.select("_range", (F.sum("_n").over(W.orderBy("_range")) - F.col("_n")).alias("_before"))
    own = F.sum("n").over(W.partitionBy("_range").orderBy("value"))
    running = materialize(values.join(before, "_range").select("value", (F.col("_before") + own).alias("upto")), "bin-counts")
    total, edges, done = running.agg(F.max("upto")).first()[0] or 0, [], 0
    while done < total:
        done, value = running.filter(F.col("upto") >= done + math.ceil(p * (total - done))).agg(F.min(F.struct("upto", "value"))).first()[0]
        edges.append(value)
    out = F.lit(None)
    for i in reversed(range(len(edges))):
        out = F.when(F.col(column) <= edges[i], i + 1).otherwise(out)
    return df.withColumn("bin", out.cast("int"))


def normalize_positive(df: DataFrame, column: str) -> DataFrame:
    """Adds ``value``: entries over 0 scaled by their minimum and maximum, others as they are."""
    positive = F.when(F.col(column) > 0, F.col(column))
    ends = df.agg(F.min(positive).alias("_lo"), F.max(positive).alias("_hi"))
    out = df.crossJoin(F.broadcast(ends))
    scaled = F.when(F.col("_hi") == F.col("_lo"), 0.0).otherwise((F.col(column) - F.col("_lo")) / (F.col("_hi") - F.col("_lo")))
    return out.withColumn("value", F.when(F.col(column) > 0, scaled).otherwise(F.col(column).cast("double"))).drop("_lo", "_hi")


def concat_features(left: DataFrame, right: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return left.join(right, [*by, "node"])
