"""Raw features of growing graphs, kept up by what each round of probes changes.

Adjacency is stored in both directions by buckets of its first node, so a round reads the buckets of the
nodes that it touches. Counts (degree, triangles, probed and target neighbours, rewards) grow by the new
edges' share; triangles by those that hold a new edge. Features that look further (knn, refex) are made
anew within their reach of the probed nodes, or everywhere where that is more than a fifth of the nodes.
Component labels are joined along the new edges. Every state equals a full recompute.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netprobe.functions.tables import Buckets, materialize
from netprobe.operators import features as f
from netprobe.operators.components import connected_components
from netprobe.operators.graph import symmetrize

BY = ["run_id"]
#: What the additive sets keep of each node.
COUNTS = ("degree", "triangles", "probed_nbrs", "reward_count", "target_nbrs")
#: Share of the nodes from which on all are made anew.
ALL_FROM = 0.2


def new_triangles(new_edges: DataFrame, degrees: DataFrame, adj: DataFrame, since: int, by: Sequence[str] = BY) -> DataFrame:
    """(by, node, triangles): triangles of each node that hold an edge of ``new_edges``.

    ``adj``: both directions of all edges at the new edges' ends, with seq; those from ``since`` on are new. A new
    edge is followed from its end of the lower degree; a triangle of k new edges is met k times and counts 6 / k sixths."""
    one = degrees.select(*by, F.col("node").alias("src"), F.col("degree").alias("d1"))
    two = degrees.select(*by, F.col("node").alias("dst"), F.col("degree").alias("d2"))
    ends = new_edges.select(*by, "src", "dst").join(one, [*by, "src"]).join(two, [*by, "dst"])
    up = F.struct("d1", "src") < F.struct("d2", "dst")
    arcs = ends.select(*by, F.when(up, F.col("src")).otherwise(F.col("dst")).alias("a"), F.when(up, F.col("dst")).otherwise(F.col("src")).alias("b"))
    near = adj.select(*by, F.col("src").alias("a"), F.col("dst").alias("c"), (F.col("seq") >= since).cast("int").alias("n1"))
    far = adj.select(*by, F.col("src").alias("b"), F.col("dst").alias("c"), (F.col("seq") >= since).cast("int").alias("n2"))
    found = arcs.join(near, [*by, "a"]).join(far, [*by, "b", "c"])
    share = (6 / (1 + F.col("n1") + F.col("n2"))).cast("long")
    return found.select(*by, F.explode(F.array("a", "b", "c")).alias("node"), share.alias("_s")).groupBy(*by, "node").agg((F.sum("_s") / 6).cast("long").alias("triangles"))


class Graph:
    """The observed graphs of all runs: adjacency by buckets, and nodes with the probe that revealed them."""

    def __init__(self, spark: SparkSession, edges: DataFrame, nodes: DataFrame, buckets: int = 32) -> None:
        self.adj = Buckets(spark, "grow-adjacency", "src", buckets).add(self._both(edges))
        self.nodes = Buckets(spark, "grow-nodes", "node", buckets).add(nodes.select(*BY, "node", "seq"))

    @staticmethod
    def _both(edges: DataFrame) -> DataFrame:
        return symmetrize(edges, [*BY, "seq"]).select(*BY, "src", "dst", "seq")

    def edges(self) -> DataFrame:
        return self.adj.read().filter("src < dst").select(*BY, "src", "dst", "seq")

    def at(self, nodes: DataFrame) -> DataFrame:
        """Adjacency of the given (run_id, node), from their buckets."""
        own = nodes.select(*BY, F.col("node").alias("src")).distinct()
        return self.adj.near(own).join(own, [*BY, "src"], "left_semi")

    def add(self, edges: DataFrame, nodes: DataFrame) -> None:
        self.adj.add(self._both(edges))
        self.nodes.add(nodes.select(*BY, "node", "seq"))


class Maintained:
    """Features of the set ``kind`` for the observed ``graph``; ``probes`` (run_id, node) are probed from the start.
    The set ``plain`` has degrees and neighbour counts alone, and no triangles or components."""

    def __init__(self, kind: str, graph: Graph, probes: DataFrame, targets: DataFrame | None = None, share: float = ALL_FROM) -> None:
        self.kind, self.graph, self.share = kind, graph, share
        self.targets = None if targets is None else materialize(targets.select("node").distinct(), "grow-targets")
        self.probed = materialize(probes.select(*BY, "node").distinct(), "grow-probed")
        edges, nodes = graph.edges(), graph.nodes.read()
        self.comps = self._components(edges, nodes) if kind in ("default", "netdisc", "refex") else None
        self.raw = materialize(self._counts(edges, nodes) if self.additive else self._far(edges, nodes), "grow-raw")
        #: How many nodes the last update made anew.
        self.refreshed = 0

    @property
    def additive(self) -> bool:
        return self.kind in ("default", "netdisc", "plain")

    def _components(self, edges: DataFrame, nodes: DataFrame) -> DataFrame:
        found = connected_components(edges, by=BY)
        return materialize(nodes.select(*BY, "node").join(found, [*BY, "node"], "left").select(*BY, "node", F.coalesce("comp", "node").alias("comp")), "grow-components")

    def _counts(self, edges: DataFrame, nodes: DataFrame) -> DataFrame:
        out = f.degrees(edges, nodes, BY).withColumn("triangles", F.lit(0).cast("long")) if self.kind == "plain" else f.triangle_counts(edges, nodes, BY)
        probed = f.probed_neighbors(edges, self.probed, BY).withColumnRenamed("n", "probed_nbrs")
        out = out.join(probed, [*BY, "node"], "left").withColumn("reward_count", F.lit(0).cast("long"))
        if self.targets is None:
            out = out.withColumn("target_nbrs", F.lit(0).cast("long"))
        else:
            out = out.join(f.target_neighbors(edges, nodes, self.targets, BY).withColumnRenamed("n", "target_nbrs"), [*BY, "node"], "left")
        return out.na.fill(0, list(COUNTS)).select(*BY, "node", *COUNTS)

    def _far(self, edges: DataFrame, nodes: DataFrame) -> DataFrame:
        return f.raw_features(self.kind, edges, nodes, self.probed, BY)

    def update(self, new_edges: DataFrame, new_nodes: DataFrame, chosen: DataFrame, since: int) -> None:
        """After the graph got ``new_edges`` (run_id, src, dst, seq, nbr: the end they were revealed to) and ``new_nodes``,
        by probes of ``chosen`` with seq from ``since`` on."""
        before, self.probed = self.probed, materialize(self.probed.unionByName(chosen.select(*BY, "node")).distinct(), "grow-probed")
        if self.comps is not None:
            self.comps = materialize(f.merge_components(self.comps, new_edges, new_nodes, BY), "grow-components")
        self.raw = materialize(self._add(new_edges, new_nodes, chosen, since, before) if self.additive else self._anew(chosen), "grow-raw")

    def _add(self, new_edges: DataFrame, new_nodes: DataFrame, chosen: DataFrame, since: int, before: DataFrame) -> DataFrame:
        both = symmetrize(new_edges.select(*BY, "src", "dst"), BY)
        to = lambda df, name: df.groupBy(*BY, F.col("dst").alias("node")).agg(F.count("*").alias(name))
        degree = to(both, "degree")
        zeros = [F.lit(0).cast("long").alias(c) for c in COUNTS]
        old = self.raw.unionByName(new_nodes.select(*BY, "node", *zeros))
        own = lambda df: df.select(*BY, F.col("node").alias("src"))
        met = self.graph.at(chosen).select(*BY, "src", "dst").join(own(before), [*BY, "src"], "left_anti")
        again = both.join(own(before), [*BY, "src"], "left_semi")  # probed nodes (seeds) that got an edge by another's probe
        changes = {
            "degree": degree, "probed_nbrs": to(met.unionByName(again), "probed_nbrs"),
            "reward_count": new_edges.groupBy(*BY, F.col("nbr").alias("node")).agg(F.count("*").alias("reward_count")),
        }
        if self.targets is not None:
            changes["target_nbrs"] = to(both.join(self.targets.select(F.col("node").alias("src")), "src", "left_semi"), "target_nbrs")
        if self.kind != "plain":
            ends = materialize(both.select(*BY, F.col("src").alias("node")).distinct(), "grow-ends")
            now = materialize(old.join(ends, [*BY, "node"], "left_semi").select(*BY, "node", "degree"), "grow-touched")
            now = now.join(degree.withColumnRenamed("degree", "_more"), [*BY, "node"], "left").select(*BY, "node", (F.col("degree") + F.coalesce("_more", F.lit(0))).alias("degree"))
            changes["triangles"] = new_triangles(new_edges, now, materialize(self.graph.at(ends), "grow-adjacent"), since)
        # the changed nodes are few: one small table of them goes to all nodes, which stay where they are
        every = reduce(DataFrame.unionByName, [d.select(*BY, "node", *[(F.col(k) if k == c else F.lit(0)).cast("long").alias(k) for k in COUNTS]) for c, d in changes.items()])
        every = materialize(every.groupBy(*BY, "node").agg(*[F.sum(c).alias(f"_{c}") for c in COUNTS]), "grow-changes")
        old = old.join(every, [*BY, "node"], "left")
        more = lambda c: F.coalesce(F.col(f"_{c}"), F.lit(0))
        return old.select(*BY, "node", *[(F.col(c) + more(c)).cast("long").alias(c) for c in COUNTS])

    def _reach(self, nodes: DataFrame, hops: int) -> DataFrame:
        found = nodes.select(*BY, "node").distinct()
        for _ in range(hops):
            step = self.graph.at(found).select(*BY, F.col("dst").alias("node"))
            found = materialize(found.unionByName(step).distinct(), "grow-reach")
        return found

    def _anew(self, chosen: DataFrame) -> DataFrame:
        hops = f.REACH[self.kind]
        nodes = self.graph.nodes.read().select(*BY, "node")
        affected = self._reach(chosen, hops)
        self.refreshed = affected.count()
        if self.refreshed > self.share * self.raw.count():
            return self._far(self.graph.edges(), nodes)
        rim = self._reach(affected, max(1, hops - 1))
        near = self.graph.at(rim).select(*BY, F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()
        near = materialize(near, "grow-near")
        fresh = f.raw_features(self.kind, near, rim, self.probed, BY).join(affected, [*BY, "node"], "left_semi")
        return self.raw.join(affected, [*BY, "node"], "left_anti").select(*fresh.columns).unionByName(fresh)

    def features(self) -> DataFrame:
        """(run_id, node, the normalised columns)."""
        if not self.additive:
            out = f.min_max(self.raw, f.RAW[self.kind], BY)
        else:
            d = F.col("degree")
            out = f.min_max(self.raw, ["degree", "reward_count"], BY)
            out = out.withColumn("cc", F.when(d > 1, 2 * F.col("triangles") / (d * (d - 1))).otherwise(0.0))
            out = out.withColumn("frac_probed", F.when(d > 0, F.col("probed_nbrs") / d).otherwise(0.0))
        if self.comps is None:
            return out
        return out.join(f.component_sizes(self.comps, BY).select(*BY, "node", "size_norm"), [*BY, "node"])
