"""The growth job: choose, probe, reward, learn, for all runs at once, round by round."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from netprobe.functions.hashing import uniform
from netprobe.functions.tables import Buckets, Parts, materialize
from netprobe.operators import embeddings, fitting, learning
from netprobe.operators import features as f
from netprobe.operators.graph import candidates, symmetrize
from netprobe.operators.maintain import Graph, Maintained
from netprobe.operators.policies import choose_epsilon_greedy, choose_top
from netprobe.operators.probing import first_edges, first_nodes, init_state

HEURISTICS = ("high", "low", "rand", "mod")
#: Policies whose weights are kept from round to round: online regression, and heavy-tailed regression.
WEIGHTED = ("linear", "htr")
#: Policies that are fitted anew to the samples of a run.
FITTED = ("linreg", "logit", "svm", "knn")
#: Numbers of a node's embedding.
WIDTH = 24
_EMBEDDED = tuple(f"n2v_{i}" for i in range(WIDTH))
_REFEX = tuple(f"{k}{c}_norm" for k in ("", "sum_", "median_", "min_", "max_") for c in f.REFEX_BASE) + ("size_norm",)
#: Columns of the feature sets.
FEATURE_SETS: dict[str, tuple[str, ...]] = {
    "default": ("degree_norm", "cc", "size_norm", "frac_probed", "reward_count_norm"),
    "netdisc": ("degree_norm", "cc", "size_norm", "frac_probed"),
    "knn": ("degree_norm", "probed_nbrs_norm", "mean_degree_norm", "median_degree_norm"),
    "refex": _REFEX, "node2vec": _EMBEDDED, "refex_node2vec": (*_REFEX, *_EMBEDDED),
}
FEATURES = FEATURE_SETS["default"]


def feature_columns(features: str, targets: DataFrame | None) -> tuple[str, ...]:
    """A set's columns; where targets are known, the default and netdisc sets count target neighbours too."""
    return FEATURE_SETS[features] + (("target_nbrs",) if targets is not None and features in ("default", "netdisc") else ())


def grow(
    complete: DataFrame, sample: DataFrame, budget: int, batch_size: int = 1, policy: str = "high", reward: str = "new_nodes",
    by: Sequence[str] = (), burn_in: int = 0, alpha: float = 0.01, regularization: str = "no", targets: DataFrame | None = None, seed: int = 0,
    epsilon: float = 0.0, decay: bool = False, features: str = "default", k: int | str = "ln", seeds: DataFrame | None = None,
    snapshot_gap: int = 0, snapshot_path: str | None = None,
) -> DataFrame:
    """(by, seq, node, estimate, reward, delta, jump, p, theta) of every probe. ``sample``: observed edges, with the
    columns ``by`` (none, or run_id).

    Policies: high, low, rand, mod (target neighbours); linear (online regression), htr (heavy-tailed regression in
    ``k`` groups); linreg, logit, svm, knn (fitted anew to all samples of each run, all runs in one job). Until a run has
    samples, fitted policies go by degree. Where all samples of a run are of one class, its unprobed nodes join as
    unlabelled ones and the probability is calibrated on samples held out (``fitting.fitted_runs``).
    Features: default, netdisc, knn, refex, node2vec, refex_node2vec; with ``targets``, the first two count target
    neighbours. They are kept up from round to round (``maintain``); embeddings are made anew each round.
    A jump, with probability ``epsilon`` (falling with exp(-seq / budget) if ``decay``), takes a random node instead, one of
    the first sample's as long as there are any. The first ``burn_in`` probes go by degree, or by target neighbours if
    targets are rewarded. ``seeds`` (by, node) start as probed, with seq below 0 and reward 1.

    A round probes ``batch_size`` nodes of every run; shared finds belong to the lower seq, scores are those of
    the round's start, so a batch of one is the sequential order. Each round adds to tables in the shared folder.
    Every ``snapshot_gap`` probes, the features go to a folder of ``snapshot_path``."""
    if policy not in (*HEURISTICS, *WEIGHTED, *FITTED):
        raise ValueError(f"unknown policy: {policy}")
    if features not in FEATURE_SETS:
        raise ValueError(f"unknown features: {features}")
    if reward not in ("new_nodes", "new_edges", "target_hit"):
        raise ValueError(f"unknown reward: {reward}")
    if targets is None and (policy == "mod" or reward == "target_hit"):
        raise ValueError("targets are needed")
    if by and list(by) != ["run_id"]:
        raise ValueError("runs are told apart by run_id")
    given, by = list(by), ["run_id"]
    lone = lambda df: df if given else df.withColumn("run_id", F.lit(0).cast("long"))
    spark, columns = complete.sparkSession, feature_columns(features, targets)
    buckets = Buckets.number(complete.count())
    around = Buckets(spark, "grow-complete", "node", buckets).add(symmetrize(complete).select(F.col("src").alias("node"), F.col("dst").alias("nbr")))
    start = [materialize(x, "grow-start") for x in init_state(lone(sample), by=by)]
    graph = Graph(spark, *start, buckets)
    run_type, node_type = (start[1].schema[c].dataType.simpleString() for c in ("run_id", "node"))
    log = Parts(spark, "grow-log", f"run_id {run_type}, seq int, node {node_type}, estimate double, reward double, delta double, jump int, p double, theta array<double>")
    samples = Parts(spark, "grow-samples", f"run_id {run_type}, seq int, features array<double>, reward double")
    learns = policy in (*WEIGHTED, *FITTED)
    if seeds is not None:
        order = F.row_number().over(W.partitionBy("run_id").orderBy("node"))
        own = lone(seeds).select(*by, "node").distinct().join(graph.nodes.read().select(*by, "node"), [*by, "node"]).withColumn("seq", (-order).cast("int"))
        own = materialize(own, "grow-seeds")
    described = learns or (snapshot_gap and snapshot_path)
    sets = _maintained(features) if described else []
    if not {"default", "netdisc"} & set(sets) and (burn_in or policy in ("high", "low", "mod", *FITTED)):
        sets.append("plain")  # degrees and target neighbours for the choices that go by them
    none = spark.createDataFrame([], f"run_id {run_type}, node {node_type}")
    kept = [Maintained(k, graph, none, targets) for k in sets]
    describe = lambda: _features(columns, graph, [m for m in kept if m.kind != "plain"], seed)
    if seeds is not None:
        if learns:
            samples.add(describe().join(own, [*by, "node"]).select("run_id", "seq", "features", F.lit(1.0).alias("reward")))
        log.add(own.select("run_id", "seq", "node", F.lit(0.0).alias("estimate"), F.lit(1.0).alias("reward"), F.lit(0.0).alias("delta"), F.lit(0).alias("jump"), F.lit(0.0).alias("p"), F.lit(None).cast("array<double>").alias("theta")))
        kept = [Maintained(k, graph, own, targets) for k in sets]  # probed from the start
    thetas = materialize(learning.init_theta(start[1], len(columns), seed, by), "grow-theta") if policy in WEIGHTED else None
    done, saved = 0, 0
    while done < budget:
        name = policy if done >= burn_in else "mod" if reward == "target_hit" else "high"
        left = materialize(candidates(graph.nodes.read(), log.read(), by).select(*by, "node", (F.col("seq") == -1).alias("is_initial")), "grow-left")
        now = materialize(describe(), "grow-features") if learns else None
        counts = next((m.raw for m in kept if m.additive), None)
        scored = _scored(name, left, counts, now, samples.read(), thetas, seed, done)
        size = min(batch_size, budget - done)
        p = epsilon * (math.exp(-done / budget) if decay else 1.0)
        if p > 0 and name != "rand":
            scored = materialize(scored, "grow-scored")
            picked = choose_epsilon_greedy(scored, size, p, seed, done, by).join(scored.select(*by, "node", "value"), [*by, "node"])
        else:
            picked = choose_top(scored, size, by).withColumn("slot", F.col("rank") - 1).withColumn("jump", F.lit(int(name == "rand")))
        value = F.lit(0.0) if name in ("high", "low", "rand", "mod") else F.col("value").cast("double")
        chosen = materialize(picked.select(*by, "node", (F.col("slot") + done).cast("int").alias("seq"), value.alias("estimate"), F.col("jump").cast("int").alias("jump")), "grow-chosen")
        if chosen.isEmpty():
            break
        # a probe's new edges are at the probed node, so both sides are read from its buckets
        revealed = materialize(chosen.select(*by, "seq", "node").join(around.near(chosen), "node").select(*by, "seq", "node", "nbr"), "grow-revealed")
        known = graph.at(chosen).select(*by, F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()
        new_edges = materialize(first_edges(revealed, known, by), "grow-new-edges")
        new_nodes = materialize(first_nodes(revealed, graph.nodes.near(revealed.select(*by, F.col("nbr").alias("node"))), by), "grow-new-nodes")
        gained = {"new_nodes": new_nodes, "new_edges": new_edges}.get(reward)
        if gained is not None:
            gained = gained.groupBy(*by, "seq").agg(F.count("*").cast("double").alias("reward"))
            step = chosen.join(gained, [*by, "seq"], "left").na.fill(0.0, ["reward"])
        else:
            step = chosen.join(targets.select("node", F.lit(1.0).alias("reward")).distinct(), "node", "left").na.fill(0.0, ["reward"])
        train = F.col("reward") + learning.TARGET_OFFSET if reward == "target_hit" and name in WEIGHTED else F.col("reward")
        step = materialize(step.withColumn("train", train), "grow-step")
        delta = F.col("train") - F.col("estimate") if learns and name == policy else F.lit(0.0)
        entry = step.withColumn("delta", delta).withColumn("p", F.lit(float(p)))
        entry = entry.join(thetas, by) if thetas is not None else entry.withColumn("theta", F.lit(None).cast("array<double>"))
        entry = materialize(entry.select(*log.columns), "grow-entry")
        if learns:
            batch = materialize(step.join(now, [*by, "node"]).select("run_id", "seq", "features", F.col("train").alias("reward")), "grow-batch")
            samples.add(batch)
            if policy == "linear":
                thetas = learning.sgd_update(batch, thetas, len(columns), alpha, by)
            elif policy == "htr":
                found = learning.htr_fit(samples.read(), len(columns), k, seed)
                thetas = thetas.join(found.withColumnRenamed("theta", "_new"), by, "left").select(*by, F.coalesce("_new", "theta").alias("theta"))
            if policy in WEIGHTED:
                thetas = materialize(thetas.withColumn("theta", learning.regularize(F.col("theta"), regularization)), "grow-theta")
        graph.add(new_edges.select(*by, "src", "dst", "seq"), new_nodes)
        for maintained in kept:
            maintained.update(new_edges, new_nodes, chosen, done)
        log.add(entry)
        done += size
        if snapshot_gap and snapshot_path and done // snapshot_gap > saved:
            saved = done // snapshot_gap
            describe().write.mode("overwrite").parquet(f"{snapshot_path}/query={done}")
    return log.read().select(*given, *[c for c in log.columns if c != "run_id"])


def _scored(name: str, left: DataFrame, counts: DataFrame | None, now: DataFrame | None, samples: DataFrame, thetas: DataFrame | None, seed: int, step: int) -> DataFrame:
    """(run_id, node, is_initial, value) of the candidates; the highest value is best. ``counts``: degrees and target
    neighbours, kept up from round to round."""
    by = ["run_id"]
    if name == "rand":
        return left.withColumn("value", uniform(seed, F.col("run_id"), step, F.col("node")))
    if name in WEIGHTED:
        return left.join(now, [*by, "node"]).join(thetas, by).withColumn("value", learning.dot(F.col("features"), F.col("theta"))).drop("features", "theta")
    by_count = left.join(counts.select(*by, "node", F.col("target_nbrs" if name == "mod" else "degree").cast("double").alias("value")), [*by, "node"])
    if name in ("high", "low", "mod"):
        return by_count.withColumn("value", F.col("value") * (-1 if name == "low" else 1))
    own, known = left.join(now, [*by, "node"]), samples.select("run_id", F.col("seq").cast("long").alias("id"), "features", "reward", (F.col("reward") > 0).cast("int").alias("label"))
    if name == "linreg":
        size = len(now.select(F.col("features")).first()["features"])
        found = learning.score_linreg(own, known, size)
    else:
        found = fitting.fitted_runs(name, materialize(own, "grow-own"), materialize(known, "grow-known"), seed=seed)
    waiting = by_count.join(known.select(*by).distinct(), by, "left_anti")  # runs without a sample yet
    return found.select(*by, "node", "is_initial", F.col("value").cast("double").alias("value")).unionByName(waiting.select(*by, "node", "is_initial", "value"))


def _maintained(features: str) -> list[str]:
    return [k for k in features.split("_") if k != "node2vec"]


def _features(columns: Sequence[str], graph: Graph, kept: Sequence[Maintained], seed: int) -> DataFrame:
    """(run_id, node, features) of all runs: what is kept up, and embeddings of each run's graph."""
    by = ["run_id"]
    out = graph.nodes.read().select(*by, "node")
    for maintained in kept:
        out = out.join(maintained.features(), [*by, "node"])
    if columns[-1] in _EMBEDDED:
        edges = graph.edges()
        label = lambda c: F.concat_ws(":", *by, c)  # noqa: E731  a run's nodes are its own
        vectors = embeddings.node2vec_features(edges.select(label("src").alias("src"), label("dst").alias("dst")), WIDTH, seed)
        found = embeddings.embedding_or_ones(out.select(label("node").alias("node")), vectors, WIDTH)
        out = out.withColumn("_k", label("node")).join(found.select(F.col("node").alias("_k"), *[F.col("vec")[i].alias(c) for i, c in enumerate(_EMBEDDED)]), "_k")
    return out.select(*by, "node", F.array(*[F.col(c).cast("double") for c in columns]).alias("features"))
