"""Sampling of graphs. All choices come from md5 ranks, so they repeat for a seed."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from netprobe.functions.hashing import hash_int, hash_key, uniform
from netprobe.functions.tables import materialize
from netprobe.operators.graph import canonical_edges, ego_expand, neighbor_places, node_set

#: Ranks are counted in groups of leading hash bits, so that no task sorts all rows.
_GROUP = 4096


def dense_rank_by(nodes: DataFrame, order: Column, out: str, key: str = "node") -> DataFrame:
    """Adds the 0-based place of each row by (order, key), where ``order`` is a hex digest.

    The digest's first three digits deal the rows into 4096 groups of like size; ranks within a group
    are added to the sizes of the groups before it."""
    marked = nodes.withColumn("_order", order).withColumn("_g", F.conv(F.substring("_order", 1, 3), 16, 10).cast("int"))
    before = W.partitionBy(F.lit(0)).orderBy("_g").rowsBetween(W.unboundedPreceding, -1)  # one row for each group
    base = marked.groupBy("_g").agg(F.count("*").alias("_n")).withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inner = F.row_number().over(W.partitionBy("_g").orderBy("_order", key)) - 1
    return marked.withColumn("_own", inner).join(base, "_g").withColumn(out, (F.col("_base") + F.col("_own")).cast("int")).drop("_g", "_base", "_own", "_order")


def node_sample(edges: DataFrame, p: float, seed: int = 0) -> DataFrame:
    """Edges induced by the least number of random nodes that hold int(p E) edges; (src, dst, at).

    An edge is induced at the higher rank of its ends, so the cut-off is an order statistic of these:
    no growing sample, no retries."""
    ranks = materialize(dense_rank_by(node_set(edges), hash_key(seed, F.col("node")), "rank"), "sample-ranks")
    one = ranks.select(F.col("node").alias("src"), F.col("rank").alias("r1"))
    two = ranks.select(F.col("node").alias("dst"), F.col("rank").alias("r2"))
    at = edges.join(one, "src").join(two, "dst").select("src", "dst", F.greatest("r1", "r2").alias("at"))
    counts = at.groupBy("at").agg(F.count("*").alias("n"))
    groups = counts.groupBy(F.floor(F.col("at") / _GROUP).alias("g")).agg(F.sum("n").alias("n"))
    every = W.partitionBy(F.lit(0)).orderBy("g")  # one row for each 4096 ranks
    groups = groups.select("g", "n", F.sum("n").over(every).alias("until"), F.sum("n").over(every.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)).alias("all"))
    want = F.floor(F.col("all") * p + 1e-9)
    inside = groups.filter((F.col("until") >= want) & (F.col("until") - F.col("n") < want)).select("g", (want - F.col("until") + F.col("n")).alias("want"))
    here = counts.withColumn("g", F.floor(F.col("at") / _GROUP)).join(F.broadcast(inside), "g")
    cut = here.withColumn("run", F.sum("n").over(W.partitionBy("g").orderBy("at"))).filter("run >= want").agg(F.min("at").alias("cut"))
    return at.join(F.broadcast(cut), F.col("at") <= F.col("cut")).select("src", "dst", "at")


def seed_sample(edges: DataFrame, holders: DataFrame, k: int, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(edges, seeds): k random nodes of ``holders`` and the edges at them."""
    seeds = holders.select("node").distinct().orderBy(hash_key(seed, F.col("node")), "node").limit(k)
    return ego_expand(edges, seeds), seeds


def _mover(edges: DataFrame, jump: float, seed: int, nodes: DataFrame | None) -> Callable[[DataFrame, int], DataFrame]:
    nbrs, counts = neighbor_places(edges, nodes)
    places = materialize(dense_rank_by(counts.select("node"), hash_key(seed, "place", F.col("node")), "place"), "walk-places")
    n = places.count()

    def move(now: DataFrame, step: int) -> DataFrame:
        leave = (uniform(seed, "jump", F.col("walker"), step) < jump) | (F.col("k") == 0)
        place = (hash_int(seed, "to", F.col("walker"), step) % n).cast("int")
        pick = hash_int(seed, "nbr", F.col("walker"), step) % F.greatest("k", F.lit(1))
        drawn = now.select("walker", "node").join(counts.select("node", F.col("degree").alias("k")), "node")
        drawn = drawn.select("walker", "node", leave.cast("int").alias("jumped"), F.when(leave, place).otherwise(pick).alias("place"))
        drawn = materialize(drawn, "walk-drawn")
        # inner joins, each once: Spark may send few walkers to the neighbours' rows, instead of dealing all of these anew
        stays = drawn.filter("jumped = 0").join(nbrs, ["node", "place"]).select("walker", F.col("nbr").alias("node"), "jumped")
        leaves = drawn.filter("jumped = 1").select("walker", "jumped", "place").join(places, "place").select("walker", "node", "jumped")
        return materialize(stays.unionByName(leaves).select("walker", "node", F.lit(step).alias("step"), "jumped"), "walk-step")

    return move


def walk(edges: DataFrame, starts: DataFrame, steps: int, jump: float = 0.15, seed: int = 0, nodes: DataFrame | None = None) -> DataFrame:
    """(walker, step, node, jumped) of walkers (walker, node) that step to a random neighbour, or jump to a
    random node with probability ``jump`` and where there is no neighbour. A row per walker and step."""
    move = _mover(edges, jump, seed, nodes)
    now = starts.select("walker", "node").withColumns({"step": F.lit(0), "jumped": F.lit(1)})
    out = now
    for step in range(1, steps + 1):
        now = move(now, step)
        out = out.unionByName(now)
    return out


def _first(found: DataFrame, want: int) -> DataFrame:
    """The first ``want`` rows by f = (step, walker), which no two rows share."""
    marked = found.withColumn("_g", F.struct(F.col("f.step").alias("step"), F.floor(F.col("f.walker") / _GROUP).alias("part")))
    before = W.partitionBy(F.lit(0)).orderBy("_g").rowsBetween(W.unboundedPreceding, -1)  # one row for each step and 4096 walkers
    base = marked.groupBy("_g").agg(F.count("*").alias("_n")).select("_g", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    inner = F.row_number().over(W.partitionBy("_g").orderBy("f"))
    return marked.withColumn("_own", inner).join(base, "_g").filter(F.col("_base") + F.col("_own") <= want).drop("_g", "_own", "_base")


def _crossed(path: DataFrame) -> DataFrame:
    last = path.select("walker", (F.col("step") + 1).alias("step"), F.col("node").alias("src"))
    crossed = path.filter("jumped = 0").select("walker", "step", F.col("node").alias("dst")).join(last, ["walker", "step"])
    return crossed.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), F.struct("step", "walker").alias("f")).groupBy("src", "dst").agg(F.min("f").alias("f"))


#: A walk that crosses nothing new in so many rounds cannot reach its target.
STALLED = 64


def walk_sample(edges: DataFrame, p: float, walkers: int, steps: int, jump: float = 0.15, stop: str = "edges", seed: int = 0) -> DataFrame:
    """The first int(p E) distinct edges (or edges among the first int(p n) nodes) that the walkers cross.

    At least ``walkers`` walkers, and as many as the target needs, go on in rounds of ``steps`` steps until it is reached."""
    nodes = materialize(node_set(edges), "walk-nodes")
    want = math.floor(p * (nodes if stop == "nodes" else edges).count() + 1e-9)
    ranks = dense_rank_by(nodes, hash_key(seed, "start", F.col("node")), "walker")
    starts = ranks.filter(F.col("walker") < max(walkers, -(-want // steps))).select("walker", "node")
    now = materialize(starts.withColumns({"step": F.lit(0), "jumped": F.lit(1)}), "walk-step")
    move, path, step, reached, stalled = _mover(edges, jump, seed, nodes), now, 0, -1, 0
    while reached < want:
        for _ in range(steps):
            step += 1
            now = move(now, step)
            path = path.unionByName(now)
        path = materialize(path, "walk-path")
        seen = path.groupBy("node").agg(F.min(F.struct("step", "walker")).alias("f")) if stop == "nodes" else _crossed(path)
        seen = materialize(seen, "walk-seen")
        found = seen.count()
        stalled = stalled + 1 if found == reached else 0
        if stalled == STALLED:
            raise RuntimeError(f"the walk reaches {found} of {want} {stop}")
        reached = found
    first = _first(seen, want)
    return canonical_edges(_crossed(path.join(first.select("node"), "node", "left_semi")) if stop == "nodes" else first)


def generate_sample(method: str, edges: DataFrame, p: float = 0.01, **options) -> DataFrame:  # noqa: ANN003
    """Sample by name: 'node', 'walk' (walk with jumps), 'iknn' (walk to a share of the nodes), 'netdisc'."""
    if not 0 <= p <= 1:
        raise ValueError(f"p must be within 0 and 1: {p}")
    name = method.lower()
    if name == "node":
        return node_sample(edges, p, **options).select("src", "dst")
    if name == "walk":
        return walk_sample(edges, p, **options)
    if name == "iknn":
        return walk_sample(edges, p, **{"jump": 0.01, "stop": "nodes"} | options)
    if name == "netdisc":
        return seed_sample(edges, **options)[0]
    raise ValueError(f"unknown sampling method: {method}")


def weighted_pick(values: DataFrame, num: int, seed: int = 0) -> DataFrame:
    """(draw, node): ``num`` draws with replacement by ``value`` of (node, value). Negative values count 0 if
    any is positive; without a positive one all weigh the same. Values count in millionths; no rows, no draws.

    Where nodes' ranges begin and where draws fall is one table in the order of its numbers, cut into ranges: a draw
    takes the last node before it, from its own range or else from the ranges before."""
    top = values.agg(F.max("value")).first()[0]
    if top is None:
        return values.select(F.lit(0).cast("long").alias("draw"), "node").filter("false")
    weight = F.round(F.greatest("value", F.lit(0)) * 1e6) if top > 0 else F.lit(1e6)
    weighed = values.select("node", weight.cast("long").alias("w")).filter("w > 0")
    groups = weighed.withColumn("g", F.conv(F.substring(hash_key(F.col("node")), 1, 3), 16, 10).cast("int"))
    sums = materialize(groups.groupBy("g").agg(F.sum("w").alias("w")), "pick-groups")
    total = sums.agg(F.sum("w")).first()[0] or 0
    before = W.partitionBy(F.lit(0)).orderBy("g").rowsBetween(W.unboundedPreceding, -1)  # one row for each of 4096 groups
    bases = sums.select("g", F.coalesce(F.sum("w").over(before), F.lit(0)).alias("base"))
    own = F.sum("w").over(W.partitionBy("g").orderBy(hash_key(F.col("node")), "node")) - F.col("w")
    begins = groups.withColumn("own", own).join(F.broadcast(bases), "g").select((F.col("base") + F.col("own")).alias("at"), F.lit(None).cast("long").alias("draw"), "node")
    draws = values.sparkSession.range(num).select(F.floor(uniform(seed, F.col("id")) * F.lit(total)).alias("at"), F.col("id").alias("draw"), F.lit(None).cast(values.schema["node"].dataType).alias("node"))
    both = begins.unionByName(draws).withColumn("kind", F.col("draw").isNotNull())
    both = materialize(both.repartitionByRange("at", "kind").withColumn("_range", F.spark_partition_id()), "pick-ranges")
    ends = both.groupBy("_range").agg(F.max_by("node", F.when(~F.col("kind"), F.col("at"))).alias("_end"))  # a row for each range
    earlier = ends.select("_range", F.last("_end", ignorenulls=True).over(W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)).alias("_end"))
    last = F.last("node", ignorenulls=True).over(W.partitionBy("_range").orderBy("at", "kind", "draw").rowsBetween(W.unboundedPreceding, 0))
    return both.withColumn("_last", last).filter("kind").join(earlier, "_range").select("draw", F.coalesce("_last", "_end").alias("node"))
