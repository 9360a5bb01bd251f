"""Connected components by contraction."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netprobe.functions.tables import materialize, shuffled
from netprobe.operators.graph import symmetrize


def connected_components(edges: DataFrame, nodes: DataFrame | None = None, by: Sequence[str] = ()) -> DataFrame:
    """(node, comp): comp is the least node reachable over ``edges`` (src, dst; either direction), in each graph of ``by``.

    Each round, a node that has a neighbour of a lower hash (drawn anew each round) joins the lowest one, and the edges
    are drawn between what is left; so a round leaves a fixed share at most of the nodes that still have edges, in
    expectation, and a hub is gone after a few. The rounds' tables shrink, and are joined from the last to the first."""
    whole = materialize(edges.filter("src <> dst").select(*by, "src", "dst"), "cc-edges")
    rounds: list[DataFrame] = []
    while not whole.isEmpty():
        rank = lambda c: F.xxhash64(F.lit(len(rounds)), c)
        both = symmetrize(whole, by)
        # plain columns are kept in hash tables of one row a node; a struct would have all edges sorted
        lowest = both.groupBy(*by, "src").agg(F.min_by("dst", rank("dst")).alias("_low"))
        ranked = lambda c: F.struct(rank(c).alias("h"), F.col(c).alias("n"))
        to = materialize(lowest.select(*by, F.col("src").alias("node"), F.least(ranked("_low"), ranked("src"))["n"].alias("to")), "cc-round")
        rounds.append(to)
        for end in ("src", "dst"):  # the nodes are what is held, the edges pass by
            whole = whole.join(shuffled(to.withColumnRenamed("node", end)), [*by, end]).drop(end).withColumnRenamed("to", end)
        whole = whole.filter("src <> dst").select(*by, F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"))
        whole = materialize(whole.distinct(), "cc-edges")
    if not rounds:
        labels = whole.select(*by, F.col("src").alias("node"), F.col("src").alias("comp"))
    else:
        labels = rounds[-1].withColumnRenamed("to", "root")
        for to in reversed(rounds[:-1]):  # what joined in an earlier round goes where its target went later
            later = shuffled(labels.select(*by, F.col("node").alias("to"), F.col("root").alias("_later")))
            labels = materialize(to.join(later, [*by, "to"], "left").select(*by, "node", F.coalesce("_later", "to").alias("root")), "cc-labels")
        least = labels.groupBy(*by, "root").agg(F.min("node").alias("comp"))
        labels = labels.join(shuffled(least), [*by, "root"]).select(*by, "node", "comp")
    if nodes is None:
        return labels
    return nodes.select(*by, "node").distinct().join(shuffled(labels), [*by, "node"], "left").select(*by, "node", F.coalesce("comp", "node").alias("comp"))
