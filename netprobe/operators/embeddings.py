"""Node embeddings from biased random walks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netprobe.functions.hashing import hash_int, uniform
from netprobe.functions.tables import Parts, materialize
from netprobe.operators.graph import neighbor_places


#: Draws that a walker makes in one round of rejection sampling.
TRIES = 4


def node2vec_walks(edges: DataFrame, length: int = 3, per_node: int = 2, p: float = 0.3, q: float = 1.0, seed: int = 0) -> DataFrame:
    """(walker, path): second-order walks from every node. The weight of a step is 1/p back, 1 to a
    neighbour of the node before, 1/q elsewhere.

    A step is drawn from the places of the node's neighbours and accepted by its weight over the largest one; what
    1/p exceeds that by is drawn apart. Walkers that accept none of their draws go on to another round, which share
    does not depend on the graph. Neighbours are rows, so no list of a hub is copied to its walkers."""
    places, counts = neighbor_places(edges)
    adjacent = places.select(F.col("node").alias("prev"), "nbr", F.lit(True).alias("near"))
    walkers = counts.select(F.explode(F.sequence(F.lit(0), F.lit(per_node - 1))).alias("turn"), "node")
    now = walkers.select(F.concat_ws(":", "node", "turn").alias("walker"), F.array("node").alias("path"), "node", F.lit(None).cast(counts.schema["node"].dataType).alias("prev"))
    top = max(1.0, 1 / q)
    extra = max(0.0, 1 / p - top)
    sure = q == 1 and p <= 1  # all weights are the largest one, so the first draw is taken
    tries = 1 if sure else TRIES
    draw = lambda f, what, step: f(seed, what, F.col("walker"), step, F.col("t"))
    for step in range(1, length + 1):
        here = materialize(now.join(counts, "node"), "walk-here")
        left, found, t = here, None, 0
        while found is None or not left.isEmpty():
            own = left.withColumn("t", F.explode(F.sequence(F.lit(t), F.lit(t + tries - 1))))
            back = F.col("prev").isNotNull() & (draw(uniform, "back", step) * (extra + top * F.col("degree")) < extra)
            own = own.select("walker", "node", "prev", "t", F.when(~back, draw(hash_int, "place", step) % F.col("degree")).alias("place"))
            moved = own.join(places, ["node", "place"])  # inner, so few walkers may go to the neighbours' rows
            own = moved.unionByName(own.filter("place IS NULL"), allowMissingColumns=True)
            other = F.lit(1.0)
            if q != 1:
                own = own.join(adjacent, ["prev", "nbr"], "left")
                other = F.when(F.col("near"), 1.0).otherwise(1 / q)
            weight = F.when(F.col("prev").isNull() | F.col("nbr").isNull(), top).when(F.col("nbr") == F.col("prev"), min(1 / p, top)).otherwise(other)
            taken = own.filter(draw(uniform, "take", step) * top < weight)
            if sure:
                now = taken.select("walker", F.coalesce("nbr", "prev").alias("next"))
                break
            taken = taken.groupBy("walker").agg(F.min(F.struct("t", F.coalesce("nbr", "prev").alias("next")))["next"].alias("next"))
            found = Parts(edges.sparkSession, "walk-taken").add(taken) if found is None else found.add(taken)
            left, t = materialize(here.join(found.read(), "walker", "left_anti"), "walk-left"), t + tries
        now = here.join(now if sure else found.read(), "walker").select("walker", F.array_append("path", F.col("next")).alias("path"), F.col("next").alias("node"), F.col("node").alias("prev"))
    return now.select("walker", "path")


#: Steps between two nodes of a walk that still count as near, and rounds of the factorisation.
WINDOW, ROUNDS = 5, 5


def co_occurrences(walks: DataFrame, window: int = WINDOW) -> DataFrame:
    """(a, b, w): log of how much oftener than by chance b is within ``window`` steps of a in the paths, where positive."""
    spots = walks.select("path", F.posexplode("path").alias("i", "a"))
    near = spots.select("a", F.explode(F.filter(F.transform("path", lambda b, j: F.when((j != F.col("i")) & (F.abs(j - F.col("i")) <= window), b)), lambda b: b.isNotNull())).alias("b"))
    counts = materialize(near.groupBy("a", "b").agg(F.count("*").alias("n")), "walk-pairs")
    ends = counts.groupBy("a").agg(F.sum("n").alias("na"))
    total = ends.agg(F.sum("na")).first()[0] or 1
    both = counts.join(ends, "a").join(ends.select(F.col("a").alias("b"), F.col("na").alias("nb")), "b")
    w = F.log(F.col("n") * F.lit(float(total)) / (F.col("na").cast("double") * F.col("nb")))
    return both.select("a", "b", w.alias("w")).filter("w > 0")


def factorize(pairs: DataFrame, size: int, seed: int = 0, rounds: int = ROUNDS) -> DataFrame:
    """(node, vec): the symmetric table (a, b, w) as products of vectors, by block power iteration.

    The vectors are a table: a round joins them to the pairs and sums by node. What the driver holds is the
    size x size matrix of their inner products, by which they are made orthonormal; at the end it gives the
    table's action on them, whose axes and lengths the vectors take."""
    import numpy as np

    names = [f"v{i}" for i in range(size)]
    upper = [(i, j) for i in range(size) for j in range(i, size)]

    def inner(df: DataFrame, left: list[str], right: list[str]) -> np.ndarray:
        row = df.agg(*[F.sum(F.col(left[i]) * F.col(right[j])).alias(f"s{i}_{j}") for i, j in upper]).first()
        out = np.zeros((size, size))
        for k, (i, j) in enumerate(upper):
            out[i, j] = out[j, i] = row[k] or 0.0
        return out

    def turned(df: DataFrame, by: np.ndarray, width: int) -> DataFrame:
        mixed = [sum((F.col(names[i]) * float(by[i, j]) for i in range(size)), F.lit(0.0)).alias(names[j]) for j in range(width)]
        return df.select("node", *mixed, *[F.lit(0.0).alias(c) for c in names[width:]])

    def spread(df: DataFrame) -> DataFrame:
        own = df.select(F.col("node").alias("b"), *names)
        return pairs.join(own, "b").groupBy(F.col("a").alias("node")).agg(*[F.sum(F.col("w") * F.col(c)).alias(c) for c in names])

    now = pairs.select(F.col("a").alias("node")).distinct().select("node", *[(uniform(seed, "axis", F.col("node"), i) - 0.5).alias(c) for i, c in enumerate(names)])
    for _ in range(rounds):
        now = materialize(spread(materialize(now, "factor-axes")), "factor-sums")
        values, axes = np.linalg.eigh(inner(now, names, names))
        keep = values > max(values.max(), 0.0) * 1e-12
        by = axes[:, keep] / np.sqrt(values[keep])
        now = turned(now, by, int(keep.sum())) if keep.any() else now
    now = materialize(now, "factor-axes")
    onto = spread(now).select("node", *[F.col(c).alias(f"m{i}") for i, c in enumerate(names)])
    values, axes = np.linalg.eigh(inner(now.join(onto, "node"), names, [f"m{i}" for i in range(size)]))
    order = np.argsort(-np.abs(values))
    out = turned(now, axes[:, order] * np.sqrt(np.abs(values[order])), size)
    return out.select("node", F.array(*names).alias("vec"))


def node2vec_features(edges: DataFrame, size: int = 24, seed: int = 0, **options) -> DataFrame:  # noqa: ANN003
    """(node, vec) from biased walks: nodes are near as far as walks meet them together oftener than by chance (which is
    what word vectors of the walks factorise, Levy and Goldberg 2014). No array grows with the nodes."""
    walks = node2vec_walks(edges, seed=seed, **options)
    pairs = materialize(co_occurrences(walks), "walk-weights")
    return factorize(pairs, size, seed).select(F.col("node").cast("string").alias("node"), "vec")


def embedding_or_ones(nodes: DataFrame, vectors: DataFrame, size: int) -> DataFrame:
    """(node, vec): nodes without a vector get ones."""
    return nodes.select("node").join(vectors, "node", "left").withColumn("vec", F.coalesce("vec", F.array_repeat(F.lit(1.0), size)))
