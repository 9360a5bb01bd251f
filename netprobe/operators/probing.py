"""Probing: revealing the complete graph's edges of chosen nodes, and the rewards of doing so.

State is two tables, ``obs_edges`` (src, dst canonical, seq) and ``obs_nodes`` (node, seq); seq is the
probe that revealed the row, -1 for the first sample. ``by`` keeps runs apart; the complete graph has
no run and is never copied for one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netprobe.operators.graph import node_set, symmetrize


def init_state(edges: DataFrame, nodes: DataFrame | None = None, by: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Observed edges and nodes of the first sample."""
    return edges.select(*by, "src", "dst", F.lit(-1).alias("seq")), node_set(edges, nodes, by).withColumn("seq", F.lit(-1))


def reveal(complete: DataFrame, chosen: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(node, seq, nbr): all neighbours of the chosen (node, seq)."""
    adj = symmetrize(complete).select(F.col("src").alias("node"), F.col("dst").alias("nbr"))
    return chosen.select(*by, "node", "seq").join(adj, "node").select(*by, "seq", "node", "nbr")


def first_edges(revealed: DataFrame, obs_edges: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """New edges, each credited to the lowest seq that reveals it: (src, dst, seq, node, nbr)."""
    ends = revealed.withColumns({"src": F.least("node", "nbr"), "dst": F.greatest("node", "nbr")})
    new = ends.join(obs_edges.select(*by, "src", "dst"), [*by, "src", "dst"], "left_anti")
    first = new.groupBy(*by, "src", "dst").agg(F.min(F.struct("seq", "node", "nbr")).alias("_f"))
    return first.select(*by, "src", "dst", "_f.*")


def first_nodes(revealed: DataFrame, obs_nodes: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """New nodes, each credited to the lowest seq that reveals it: (node, seq)."""
    found = revealed.select(*by, F.col("nbr").alias("node"), "seq")
    new = found.join(obs_nodes.select(*by, "node"), [*by, "node"], "left_anti")
    return new.groupBy(*by, "node").agg(F.min("seq").alias("seq"))


def probe(complete: DataFrame, obs_edges: DataFrame, obs_nodes: DataFrame, chosen: DataFrame, by: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """The state after a batch of probes; shared discoveries belong to the lower seq."""
    revealed = reveal(complete, chosen, by)
    edges = first_edges(revealed, obs_edges, by).select(*by, "src", "dst", "seq")
    nodes = first_nodes(revealed, obs_nodes, by)
    return obs_edges.unionByName(edges), obs_nodes.unionByName(nodes)


def rewards(complete: DataFrame, obs_edges: DataFrame, obs_nodes: DataFrame, chosen: DataFrame, targets: DataFrame | None = None, by: Sequence[str] = (), train_offset: float = 0.1) -> DataFrame:
    """(seq, node, new_nodes, new_edges, target_hit, train_reward) of every chosen probe.

    Replays a probe order of any length in one pass: what a probe finds first depends on lower seqs only."""
    revealed = reveal(complete, chosen, by)
    edges = first_edges(revealed, obs_edges, by).groupBy(*by, "seq").agg(F.count("*").alias("new_edges"))
    nodes = first_nodes(revealed, obs_nodes, by).groupBy(*by, "seq").agg(F.count("*").alias("new_nodes"))
    out = chosen.select(*by, "seq", "node").join(edges, [*by, "seq"], "left").join(nodes, [*by, "seq"], "left")
    if targets is None:
        out = out.withColumn("target_hit", F.lit(0))
    else:
        out = out.join(targets.select("node", F.lit(1).alias("target_hit")).distinct(), "node", "left")
    out = out.na.fill(0, ["new_edges", "new_nodes", "target_hit"])
    return out.select(*by, "seq", "node", "new_nodes", "new_edges", "target_hit", (F.col("target_hit") + train_offset).alias("train_reward"))


def reward_counts(complete: DataFrame, obs_edges: DataFrame, chosen: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(node, n): edges that probing others newly revealed to each node."""
    new = first_edges(reveal(complete, chosen, by), obs_edges, by)
    return new.groupBy(*by, F.col("nbr").alias("node")).agg(F.count("*").alias("n"))


def probed_neighbors(edges: DataFrame, probes: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(node, n): distinct probed nodes next to each node."""
    own = probes.select(*by, F.col("node").alias("src")).distinct()
    return symmetrize(edges, by).join(own, [*by, "src"], "left_semi").groupBy(*by, F.col("dst").alias("node")).agg(F.count("*").alias("n"))
