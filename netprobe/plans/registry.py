"""All queries over the graph operators, with the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netprobe.functions import views as v
from netprobe.functions.hashing import hash_key
from netprobe.functions.tables import materialize, new_path
from netprobe.operators import embeddings, features, graph, growth, learning, netstats, policies, probing, runs, sampling
from netprobe.operators.components import connected_components
from netprobe.operators.triangles import node_triangles
from netprobe.plans.sql import ORACLE
from netprobe.sources import readers, writers

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
FEATURES = ("degree_norm", "cc", "size_norm", "frac_probed", "reward_count_norm")
THETA = (0.5, -0.25, 0.125, 1.0, 0.75)


def query(f: Query) -> Query:
    _QUERIES[f.__name__] = f
    return f


class State:
    """The observed sample, its seeds' probes, and what they reveal."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir
        self.complete = v.complete_graph(spark, sf_dir)
        self.sample = v.observed_graph(spark, sf_dir)
        self.nodes = graph.node_set(self.sample)
        self.targets = v.targets(spark, sf_dir)
        self.probes = v.probe_log(self.nodes.join(self.targets, "node", "left_semi"))

    def stored(self, *names: str) -> State:
        """With these tables written out, or with all."""
        for name in names or ("complete", "sample", "nodes", "probes"):
            setattr(self, name, materialize(getattr(self, name), f"state-{name}"))
        return self

    def after(self) -> tuple[DataFrame, DataFrame]:
        edges, nodes = probing.probe(self.complete, *probing.init_state(self.sample), self.probes)
        return materialize(edges, "state-edges"), materialize(nodes, "state-observed")

    def counts(self) -> DataFrame:
        return probing.reward_counts(self.complete, self.sample, self.probes)


@query
def canonical_edges(spark, sf_dir):
    return v.complete_graph(spark, sf_dir)


@query
def symmetric_edges(spark, sf_dir):
    return graph.symmetrize(v.complete_graph(spark, sf_dir))


@query
def node_neighbors(spark, sf_dir):
    parts = v.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("node"))
    found = graph.neighbor_sets(v.observed_graph(spark, sf_dir), parts)
    return found.select("node", F.size("nbrs").alias("n_nbrs"), F.array_join("nbrs", ",").alias("nbrs"))


@query
def singleton_nodes(spark, sf_dir):
    parts = v.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("node"))
    return graph.singletons(parts, v.observed_graph(spark, sf_dir))


@query
def induced_subgraph(spark, sf_dir):
    return graph.induced_subgraph(v.complete_graph(spark, sf_dir), v.observed_nodes(spark, sf_dir))


@query
def ego_expand(spark, sf_dir):
    return graph.ego_expand(v.complete_graph(spark, sf_dir), v.targets(spark, sf_dir))


@query
def ego_nodes_2(spark, sf_dir):
    return graph.ego_nodes(v.observed_graph(spark, sf_dir), v.targets(spark, sf_dir), 2)


def _attrs(spark, sf_dir):
    lines = v.table(spark, sf_dir, "lineitem").filter("l_returnflag = 'A'")
    return lines.select(F.col("l_partkey").alias("node"), F.col("l_linenumber").alias("attr_id")).distinct()


@query
def attr_nodes(spark, sf_dir):
    return graph.nodes_with_attr(_attrs(spark, sf_dir), 7)


@query
def complete_attrs(spark, sf_dir):
    parts = v.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("node"))
    return graph.complete_attrs(parts, _attrs(spark, sf_dir)).select("node", F.array_join("attrs", ",").alias("attrs"))


@query
def unprobed_candidates(spark, sf_dir):
    s = State(spark, sf_dir).stored()
    _, nodes = s.after()
    return graph.candidates(nodes, s.probes).select("node", (F.col("seq") == -1).cast("int").alias("is_initial"))


@query
def probed_rows(spark, sf_dir):
    s = State(spark, sf_dir)
    return graph.probed_nodes(s.nodes, s.probes)


@query
def node_sample(spark, sf_dir):
    return sampling.node_sample(materialize(v.complete_graph(spark, sf_dir), "complete"), 0.05, 11).select("src", "dst")


@query
def seed_sample(spark, sf_dir):
    return sampling.seed_sample(v.complete_graph(spark, sf_dir), v.targets(spark, sf_dir), 5, 3)[0]


@query
def walk_path(spark, sf_dir):
    edges = materialize(v.complete_graph(spark, sf_dir), "complete")
    starts = v.targets(spark, sf_dir).select(F.col("node").alias("walker"), "node")
    starts = starts.join(graph.node_set(edges), "node", "left_semi")
    return sampling.walk(edges, starts, 4, 0.15, 5).select("walker", "step", "node", "jumped")


@query
def walk_sample(spark, sf_dir):
    return sampling.walk_sample(materialize(v.complete_graph(spark, sf_dir), "complete"), 0.01, 64, 8)


@query
def weighted_pick(spark, sf_dir):
    values = v.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("node"), F.col("c_acctbal").alias("value"))
    return sampling.weighted_pick(values, 100, 9)


@query
def probe_batch(spark, sf_dir):
    s = State(spark, sf_dir).stored()
    edges, _ = s.after()
    return edges.filter("seq >= 0").select("seq", "src", "dst")


@query
def replay_rewards(spark, sf_dir):
    s = State(spark, sf_dir)
    s.probes = v.probe_log(s.nodes)
    s.stored()
    out = probing.rewards(s.complete, s.sample, s.nodes, s.probes, s.targets)
    out = runs.cumulative_reward(out.withColumn("run_id", F.lit(0)), value="new_nodes", out="cum_new_nodes")
    return out.select("seq", "node", "new_nodes", "new_edges", "target_hit", "cum_new_nodes")


@query
def reward_counts(spark, sf_dir):
    return State(spark, sf_dir).stored().counts()


@query
def probed_neighbors(spark, sf_dir):
    s = State(spark, sf_dir)
    return probing.probed_neighbors(s.sample, s.probes)


@query
def degree_minmax(spark, sf_dir):
    s = State(spark, sf_dir).stored()
    edges, nodes = s.after()
    out = features.min_max(features.degrees(edges, nodes), ["degree"])
    return out.select("node", "degree", F.round("degree_norm", 6).alias("degree_norm"))


@query
def clustering(spark, sf_dir):
    edges = materialize(v.complete_graph(spark, sf_dir), "complete")
    out = features.clustering(edges, graph.node_set(edges))
    return out.select("node", "triangles", F.round("cc", 6).alias("cc"))


@query
def clustering_all_lines(spark, sf_dir):
    """On the graph of all order lines, returned or not."""
    edges = materialize(v.all_lines_graph(spark, sf_dir), "all-lines")
    out = features.clustering(edges, None, found=node_triangles(edges))
    return out.select("node", "degree", "triangles", F.round("cc", 6).alias("cc"))


@query
def components_all_lines(spark, sf_dir):
    """Components of the graph of all order lines: their least nodes and sizes."""
    edges = materialize(v.all_lines_graph(spark, sf_dir), "all-lines")
    return connected_components(edges).groupBy("comp").agg(F.count("*").alias("size"))


@query
def components(spark, sf_dir):
    s = State(spark, sf_dir).stored()
    out = features.component_sizes(connected_components(s.sample, s.nodes))
    return out.select("node", "comp", "size", F.round("size_norm", 6).alias("size_norm"))


@query
def merge_components(spark, sf_dir):
    s = State(spark, sf_dir).stored()
    edges, nodes = s.after()
    merged = features.merge_components(connected_components(s.sample, s.nodes), edges.filter("seq >= 0"), nodes.filter("seq >= 0"))
    return features.component_sizes(merged).select("node", "comp", "size")


@query
def frac_probed(spark, sf_dir):
    s = State(spark, sf_dir).stored()
    return features.frac_probed(s.sample, s.nodes, s.probes).select("node", "degree", "probed_nbrs", F.round("frac_probed", 6).alias("frac_probed"))


@query
def target_neighbors(spark, sf_dir):
    s = State(spark, sf_dir).stored()
    return features.target_neighbors(s.sample, s.nodes, s.targets)


@query
def probed_overlap(spark, sf_dir):
    s = State(spark, sf_dir).stored()
    return features.probed_overlap(s.sample, s.nodes, s.probes).select("node", "n", F.round("overlap", 6).alias("overlap"))


@query
def egonet_counts(spark, sf_dir):
    s = State(spark, sf_dir).stored()
    return features.egonet_counts(s.sample, s.nodes, s.probes)


@query
def refex_features(spark, sf_dir):
    s = State(spark, sf_dir).stored()
    out = features.refex_features(s.sample, s.nodes, s.probes, connected_components(s.sample, s.nodes))
    raw = [c for c in out.columns if c != "node" and not c.endswith("_norm")]
    return out.select("node", *raw, *[F.round(c, 6).alias(c) for c in out.columns if c.endswith("_norm")])


@query
def knn_features(spark, sf_dir):
    s = State(spark, sf_dir).stored()
    out = features.knn_features(s.sample, s.nodes, s.probes)
    return out.select("node", "degree", "probed_nbrs", *[F.round(c, 6).alias(c) for c in ("mean_degree", "median_degree", "degree_norm", "probed_nbrs_norm", "mean_degree_norm", "median_degree_norm")])


def _default(spark, sf_dir, s: State | None = None) -> DataFrame:
    s = s or State(spark, sf_dir).stored()
    edges, nodes = s.after()
    return features.default_features(edges, nodes, s.probes, connected_components(edges, nodes), s.counts(), s.targets)


def _rounded(df: DataFrame, columns) -> DataFrame:
    return df.select("node", *[F.round(c, 6).alias(c) if c.endswith(("_norm", "cc", "frac_probed")) else F.col(c) for c in columns])


@query
def default_features(spark, sf_dir):
    return _rounded(_default(spark, sf_dir), ["degree", "degree_norm", "cc", "size_norm", "frac_probed", "reward_count", "reward_count_norm", "target_nbrs"])


@query
def netdisc_features(spark, sf_dir):
    s = State(spark, sf_dir).stored()
    out = features.netdisc_features(s.sample, s.nodes, s.probes, connected_components(s.sample, s.nodes), s.targets)
    return _rounded(out, ["degree", "degree_norm", "cc", "size_norm", "frac_probed", "target_nbrs"])


def _refreshed(spark, sf_dir, kind: str) -> DataFrame:
    s = State(spark, sf_dir).stored()
    edges, nodes = s.after()
    old = features.raw_features(kind, s.sample, s.nodes, s.probes.filter("false"))
    return features.refresh_raw(old, edges.select("src", "dst"), nodes.select("node"), s.probes, s.probes.select("node"), kind)


@query
def refresh_features(spark, sf_dir):
    return _refreshed(spark, sf_dir, "default").withColumn("cc", F.round("cc", 6))


@query
def refresh_knn(spark, sf_dir):
    return _refreshed(spark, sf_dir, "knn").withColumn("mean_degree", F.round("mean_degree", 6))


@query
def refresh_refex(spark, sf_dir):
    return _refreshed(spark, sf_dir, "refex")


@query
def poly_features(spark, sf_dir):
    s = State(spark, sf_dir).stored()
    base = features.frac_probed(s.sample, s.nodes, s.probes)
    out = features.polynomial_features(base, ["degree", "probed_nbrs"], 2)
    return out.select("node", *[F.round(F.col("poly")[i], 6).alias(f"p{i}") for i in range(6)])


@query
def cubic_features(spark, sf_dir):
    s = State(spark, sf_dir).stored()
    base = features.frac_probed(s.sample, s.nodes, s.probes)
    out = features.polynomial_features(base, ["degree", "probed_nbrs"], 3)
    return out.select("node", *[F.round(F.col("poly")[i], 6).alias(f"p{i}") for i in range(10)])


@query
def log_bins(spark, sf_dir):
    s = State(spark, sf_dir).stored()
    return features.log_bins(features.degrees(s.complete, graph.node_set(s.complete)), "degree").select("node", "degree", "bin")


@query
def normalize_positive(spark, sf_dir):
    values = v.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("node"), F.col("c_acctbal").alias("x"))
    return features.normalize_positive(values, "x").select("node", F.round("value", 6).alias("value"))


@query
def linear_topk(spark, sf_dir):
    s = State(spark, sf_dir).stored()
    scored = policies.score_linear(_default(spark, sf_dir, s), FEATURES, THETA)
    scored = scored.join(s.probes.select("node"), "node", "left_anti").withColumn("value", F.round("value", 6))
    return policies.choose_top(scored, 20)


@query
def degree_topk(spark, sf_dir):
    s = State(spark, sf_dir).stored()
    return policies.choose_top(policies.score_degree(features.degrees(s.sample, s.nodes)), 10)


@query
def mod_topk(spark, sf_dir):
    s = State(spark, sf_dir).stored()
    scored = policies.score_mod(features.target_neighbors(s.sample, s.nodes, s.targets).withColumnRenamed("n", "target_nbrs"))
    return policies.choose_top(scored, 10)


@query
def reveal_topk(spark, sf_dir):
    """The best connected observed parts, and how many new parts each would reveal."""
    s = State(spark, sf_dir).stored()
    chosen = policies.choose_top(policies.score_degree(features.degrees(s.sample, s.nodes)), 10).select("node", (F.col("rank") - 1).alias("seq"))
    return probing.rewards(s.complete, s.sample, s.nodes, materialize(chosen, "chosen")).select("seq", "node", "new_nodes", "new_edges")


@query
def epsilon_greedy(spark, sf_dir):
    s = State(spark, sf_dir).stored()
    edges, nodes = s.after()
    left = graph.candidates(nodes, s.probes)
    scored = features.degrees(edges, left).join(left, "node").select("node", F.col("degree").cast("double").alias("value"), (F.col("seq") == -1).cast("int").alias("is_initial"))
    return policies.choose_epsilon_greedy(materialize(scored, "scored"), 20, 0.3, 1, 0)


@query
def softmax_values(spark, sf_dir):
    s = State(spark, sf_dir).stored()
    scored = features.degrees(s.sample, s.nodes)
    return policies.softmax(scored.withColumn("x", F.col("degree") / 10.0), "x").select("node", F.round("p", 9).alias("p"))


@query
def decayed_epsilon(spark, sf_dir):
    log = v.runs(spark, sf_dir)
    return log.select("run_id", "seq", F.round(policies.decayed_epsilon(0.3, F.col("seq"), 100), 9).alias("epsilon"))


def _vectors(spark, sf_dir):
    e = v.table(spark, sf_dir, "embeddings")
    digest = F.conv(F.substring(hash_key(F.col("vec_id")), 1, 4), 16, 10).cast("int")
    return e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("features"), (F.col("label") == 0).cast("int").alias("label"), (digest % 4 == 0).alias("known"))


@query
def knn_score(spark, sf_dir):
    rows = materialize(_vectors(spark, sf_dir), "vectors")
    out = learning.score_knn(rows.select("id", "features"), rows.filter("known").select("id", "features", "label"))
    return out.select(F.col("id").alias("vec_id"), F.round("value", 6).alias("score"))


@query
def logit_score(spark, sf_dir):
    rows = materialize(_vectors(spark, sf_dir), "vectors")
    out, _ = learning.score_logit(rows.select("id", "features"), rows.filter("known"))
    return out.select(F.col("id").alias("vec_id"), F.col("value").alias("score"))


@query
def svm_score(spark, sf_dir):
    rows = materialize(_vectors(spark, sf_dir), "vectors")
    out = learning.score_svm(rows.select("id", "features"), rows.filter("known"))
    return out.select(F.col("id").alias("vec_id"), F.col("value").alias("score"))


@query
def pu_score(spark, sf_dir):
    rows = materialize(_vectors(spark, sf_dir), "vectors")
    out = learning.score_positive_unlabelled(rows.filter("NOT (known AND label = 1)").select("id", "features"), rows.filter("known AND label = 1").select("id", "features"))
    return out.select(F.col("id").alias("vec_id"), F.col("value").alias("score"))


def _samples(spark, sf_dir):
    """Probe samples of each user's run: a constant, the rounded value and the hour; the reward is the next value."""
    from pyspark.sql import Window as W

    e = v.table(spark, sf_dir, "events")
    order = W.partitionBy("user_id").orderBy("ts", "event_id")
    x = F.array(F.lit(1.0), F.round("value"), F.hour("ts").cast("double"))
    return e.select(F.col("user_id").alias("run_id"), (F.row_number().over(order) - 1).alias("seq"), x.alias("features"), F.lead(F.round("value")).over(order).alias("reward")).filter("reward IS NOT NULL")


@query
def linreg_score(spark, sf_dir):
    """Each sample's value by its run's least squares, without the intercept."""
    rows = _samples(spark, sf_dir)
    plain = rows.select("run_id", "seq", F.slice("features", 2, 2).alias("features"), "reward")
    out = learning.score_linreg(plain, plain, 2)
    return out.select("run_id", "seq", F.round("value", 4).alias("value"))


@query
def sgd_update(spark, sf_dir):
    rows = _samples(spark, sf_dir)
    thetas = rows.select("run_id").distinct().withColumn("theta", F.array(F.lit(0.1), F.lit(-0.1), F.lit(0.05)))
    out = learning.sgd_update(rows, thetas, 3, 1e-5).select("run_id", F.posexplode("theta").alias("j", "w"))
    return out.select("run_id", "j", F.round("w", 6).alias("w"))


@query
def init_theta(spark, sf_dir):
    out = learning.init_theta(v.runs(spark, sf_dir), 3, 5).select("run_id", F.posexplode("theta").alias("j", "w"))
    return out.select("run_id", "j", F.round("w", 9).alias("w"))


@query
def regularize(spark, sf_dir):
    theta = F.transform(F.col("embedding"), lambda x: x.cast("double"))
    e = v.table(spark, sf_dir, "embeddings").select("vec_id", learning.regularize(theta, "pos_normalized").alias("theta"))
    return e.select("vec_id", F.posexplode("theta").alias("j", "w")).select("vec_id", "j", F.round("w", 6).alias("w"))


@query
def htr_gram(spark, sf_dir):
    out = learning.htr_gram(_samples(spark, sf_dir), 3, 4, 2)
    return out.select("run_id", "grp", "n", F.posexplode("gram").alias("j", "s")).select("run_id", "grp", "n", "j", F.round("s", 4).alias("s"))


@query
def htr_fit(spark, sf_dir):
    out = learning.htr_fit(_samples(spark, sf_dir), 3, "ln", 2)
    return out.select("run_id", F.posexplode("theta").alias("j", "w"))


@query
def cumulative_reward(spark, sf_dir):
    out = runs.cumulative_reward(v.runs(spark, sf_dir))
    return out.select("run_id", "seq", F.round("cum_reward", 4).alias("cum_reward"))


@query
def total_reward(spark, sf_dir):
    out = runs.total_reward(v.runs(spark, sf_dir))
    return out.select("run_id", F.round("total_reward", 4).alias("total_reward"), "n_probes")


def _curves(spark, sf_dir):
    log = v.runs(spark, sf_dir).withColumn("grp", (F.col("run_id") % 3).cast("int")).withColumn("k", (F.col("run_id") % 5).cast("int"))
    return runs.reward_curves(runs.cumulative_reward(log), ["grp", "k"])


@query
def reward_curves(spark, sf_dir):
    return _curves(spark, sf_dir).select("grp", "k", "probe", F.round("avg", 4).alias("avg"), F.round("std", 4).alias("std"), "n_runs")


@query
def best_params(spark, sf_dir):
    return runs.best_params(_curves(spark, sf_dir), ["grp"], ["k"]).select("grp", "k", F.round("best", 4).alias("best"))


@query
def error_curves(spark, sf_dir):
    log = v.runs(spark, sf_dir).withColumn("delta", F.when(F.col("param") != "error", F.col("reward") - 50)).withColumn("grp", (F.col("run_id") % 3).cast("int"))
    out = runs.error_curves(log, ["grp"], 2, 5000)
    return out.select("grp", "probe", F.round("avg", 4).alias("avg"), F.round("std", 4).alias("std"), "n_runs")


@query
def theta_curves(spark, sf_dir):
    e = v.table(spark, sf_dir, "embeddings").select((F.col("vec_id") % 10).alias("seq"), F.col("embedding").alias("theta"))
    out = runs.theta_curves(e)
    return out.select("j", "probe", F.round("avg", 6).alias("avg"), F.round("std", 6).alias("std"))


@query
def gain_table(spark, sf_dir):
    p = v.table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("name")).agg(F.max("l_extendedprice").alias("htr"), F.avg("l_extendedprice").alias("high"), F.min("l_extendedprice").alias("rand"))
    out = runs.gain_table(p, "name", "htr", {"gain_high": "high", "gain_rand": "rand"})
    return out.select("name", F.round("gain_high", 4).alias("gain_high"), F.round("gain_rand", 4).alias("gain_rand"))


@query
def curve_bands(spark, sf_dir):
    out = runs.curve_bands(_curves(spark, sf_dir), ["grp", "k"], 0, 5000, 2)
    return out.select("grp", "k", "probe", "x", *[F.round(c, 4).alias(c) for c in ("avg", "low", "high")])


@query
def gain_extremes(spark, sf_dir):
    p = v.table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("name")).agg(F.max("l_extendedprice").alias("htr"), F.avg("l_extendedprice").alias("high"), F.min("l_extendedprice").alias("rand"))
    gains = runs.gain_table(p, "name", "htr", {"gain_high": "high", "gain_rand": "rand"})
    out = runs.gain_extremes(gains, ["gain_high", "gain_rand"])
    return out.select("measure", F.round("least", 4).alias("least"), F.round("most", 4).alias("most"), "least_at", "most_at")


@query
def curve_maxima(spark, sf_dir):
    """Of the thinned curves over the share of 2,000 nodes."""
    out = runs.curve_maxima(runs.curve_bands(_curves(spark, sf_dir), ["grp", "k"], 0, 5000, 2, 2000), ["grp", "k"])
    return out.select("grp", "k", F.round("top", 4).alias("top"), F.round("at", 6).alias("at"))


@query
def run_grid(spark, sf_dir):
    """All supplier nations crossed with event types, as run ids."""
    types = v.table(spark, sf_dir, "events").select(F.col("event_type").alias("policy")).distinct()
    nations = v.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"))
    grid = types.join(F.broadcast(nations), F.lit(True))  # the grid is the product; nations are 25 rows
    return runs.with_run_ids(grid, ["policy", "k"])


@query
def grow_small(spark, sf_dir):
    s = State(spark, sf_dir).stored("complete", "sample")
    out = growth.grow(s.complete, s.sample, 8, 4, "high")
    return out.select("seq", "node", "reward")


@query
def grow_high(spark, sf_dir):
    """One probe after another, each at the node of the highest degree."""
    s = State(spark, sf_dir).stored("complete", "sample")
    return growth.grow(s.complete, s.sample, 6, 1, "high").select("seq", "node", F.col("reward").alias("new_nodes"))


@query
def grow_logit(spark, sf_dir):
    """Three runs of other samples, each with a model of its own, fitted in one job a round."""
    s = State(spark, sf_dir).stored("complete", "sample")
    runs = F.explode(F.array(*[F.lit(i).cast("long") for i in range(3)]))
    sample = s.sample.withColumn("run_id", runs).filter(F.xxhash64("run_id", "src", "dst") % 4 != 0)
    return growth.grow(s.complete, sample, 6, 3, "logit", by=["run_id"], burn_in=3, targets=s.targets).select("run_id", "seq", "node", "reward")


@query
def grow_learned(spark, sf_dir):
    """Three runs side by side, each learning its own weights."""
    s = State(spark, sf_dir).stored("complete", "sample")
    sample = s.sample.withColumn("run_id", F.explode(F.array(*[F.lit(i).cast("long") for i in range(3)])))
    return growth.grow(s.complete, sample, 4, 2, "linear", by=["run_id"]).select("run_id", "seq", "node", "reward")


@query
def transitivity_all_lines(spark, sf_dir):
    edges = materialize(v.all_lines_graph(spark, sf_dir), "all-lines")
    out = netstats.transitivity(edges, node_triangles(edges))
    return out.select("triangles", "triples", F.round("transitivity", 6).alias("transitivity"))


@query
def transitivity(spark, sf_dir):
    out = netstats.transitivity(materialize(v.complete_graph(spark, sf_dir), "complete"))
    return out.select("triangles", "triples", F.round("transitivity", 6).alias("transitivity"))


@query
def modularity(spark, sf_dir):
    parts = v.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("node"), F.col("p_brand").alias("comm"))
    return netstats.modularity(v.complete_graph(spark, sf_dir), parts).select("m", F.round("modularity", 6).alias("modularity"))


@query
def degree_histogram(spark, sf_dir):
    edges = v.complete_graph(spark, sf_dir)
    return netstats.degree_histogram(edges, graph.node_set(edges))


@query
def avg_degree(spark, sf_dir):
    edges = v.complete_graph(spark, sf_dir)
    return netstats.avg_degree(edges, graph.node_set(edges)).select("nodes", "degrees", F.round("avg_degree", 6).alias("avg_degree"))


@query
def power_law(spark, sf_dir):
    edges = v.complete_graph(spark, sf_dir)
    out = netstats.power_law_fit(materialize(netstats.degree_histogram(edges, graph.node_set(edges)), "histogram"))
    return out.select("xmin", F.round("alpha", 6).alias("alpha"), F.round("ks", 6).alias("ks"))


@query
def ols(spark, sf_dir):
    lines = v.table(spark, sf_dir, "lineitem").select("l_extendedprice", "l_quantity")
    out = netstats.ols(lines, ["l_quantity"], "l_extendedprice")
    return out.select("term", F.round("coef", 3).alias("coef"), F.round("r2", 6).alias("r2"))


@query
def ols_errors(spark, sf_dir):
    lines = v.table(spark, sf_dir, "lineitem").select("l_extendedprice", "l_quantity")
    out = netstats.ols(lines, ["l_quantity"], "l_extendedprice")
    return out.select("term", F.round("std_err", 3).alias("std_err"), F.round("t", 2).alias("t"))


@query
def gram_sums(spark, sf_dir):
    lines = v.table(spark, sf_dir, "lineitem").select("l_quantity", "l_discount", "l_tax")
    return netstats.gram_sums(lines, ["l_quantity", "l_discount"], "l_tax").select("i", "j", F.round("s", 2).alias("s"))


@query
def communities(spark, sf_dir):
    return netstats.communities(v.observed_graph(spark, sf_dir))


@query
def node2vec_features(spark, sf_dir):
    edges = materialize(v.observed_graph(spark, sf_dir), "observed")
    vectors = embeddings.node2vec_features(edges, 24, seed=1)
    nodes = graph.node_set(edges).select(F.col("node").cast("string").alias("node"))
    return embeddings.embedding_or_ones(nodes, vectors, 24)


@query
def refex_node2vec(spark, sf_dir):
    s = State(spark, sf_dir).stored()
    refex = features.refex_features(s.sample, s.nodes, s.probes, connected_components(s.sample, s.nodes))
    vectors = embeddings.node2vec_features(s.sample, 24, seed=1).withColumn("node", F.col("node").cast("long"))
    return features.concat_features(refex.select("node", *[c for c in refex.columns if c.endswith("_norm")]), vectors)


@query
def stream_rewards(spark, sf_dir):
    from netprobe.streaming.probes import run_to_table
    from netprobe.streaming.probes import stream_rewards as totals

    source = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(source).schema
    # the file source takes a folder or a pattern
    stream = spark.readStream.schema(schema).parquet(source + "*").select(F.col("user_id").alias("run_id"), F.col("value").alias("reward"))
    out = new_path(spark, "stream")
    run_to_table(totals(stream), out, new_path(spark, "stream-checkpoint")).awaitTermination()
    return spark.read.parquet(out).select("run_id", "n", F.round("total", 4).alias("total"))


def _streamed(spark, sf_dir) -> str:
    """The folder of a stream that got the seeds' probe responses in three parts, one after the other."""
    from netprobe.streaming.probes import stream_probes as start

    s = State(spark, sf_dir).stored()
    found = probing.reveal(s.complete, s.probes).select(F.lit(0).cast("long").alias("run_id"), F.col("seq").cast("int").alias("seq"), "node", "nbr")
    found = materialize(found, "responses")
    last = s.probes.agg(F.max("seq")).first()[0] or 0
    source, state, checkpoint = (new_path(spark, f"stream-{x}") for x in ("responses", "state", "checkpoint"))
    first = [d.withColumn("run_id", F.lit(0).cast("long")) for d in (s.sample, s.nodes)]
    for part in range(3):
        found.filter(F.floor(F.col("seq") * 3 / (last + 1)) == part).write.mode("append").parquet(source)
        start(spark.readStream.schema(found.schema).parquet(source), state, checkpoint, sample=first).awaitTermination()
    return state


@query
def stream_probes(spark, sf_dir):
    return spark.read.parquet(f"{_streamed(spark, sf_dir)}/log").select("seq", "new_edges", "new_nodes")


@query
def stream_counts(spark, sf_dir):
    from netprobe.streaming.probes import reward_counts as counts

    return counts(spark, _streamed(spark, sf_dir)).select("node", "n")


# Files: what is written is read back and compared with the table that it came from.


def _ordered(edges: DataFrame) -> DataFrame:
    a, b = F.col("src").cast("long"), F.col("dst").cast("long")
    return edges.select(F.least(a, b).alias("src"), F.greatest(a, b).alias("dst"))


@query
def network_file(spark, sf_dir):
    path = new_path(spark, "network")
    writers.write_edge_list(v.observed_graph(spark, sf_dir), path)
    return _ordered(readers.read_network(spark, path)[1])


@query
def edge_list_file(spark, sf_dir):
    path = new_path(spark, "edge-list")
    v.complete_graph(spark, sf_dir).select("src", "dst").write.option("sep", ",").csv(path)
    n, edges = readers.read_edge_list(spark, path, ",")
    return _ordered(edges).withColumn("n_nodes", F.lit(n).cast("long"))


@query
def attribute_file(spark, sf_dir):
    """A line of nodes for each size of part."""
    path = new_path(spark, "attributes")
    lines = v.table(spark, sf_dir, "part").groupBy("p_size").agg(F.concat_ws("\t", F.sort_array(F.collect_list(F.col("p_partkey").cast("string")))).alias("value"))
    lines.coalesce(1).sortWithinPartitions("p_size").select("value").write.text(path)
    return readers.read_attributes(spark, path).select(F.col("node").cast("long").alias("node"), "attr_id")


@query
def embedding_file(spark, sf_dir):
    path = new_path(spark, "embedding")
    v.table(spark, sf_dir, "embeddings").select(F.concat_ws(" ", F.col("vec_id").cast("string"), F.transform("embedding", lambda x: x.cast("string"))).alias("value")).write.text(path)
    out = readers.read_embeddings(spark, path)
    total = F.aggregate("vec", F.lit(0.0), lambda a, x: a + x)
    return out.select(F.col("node").cast("long").alias("vec_id"), F.size("vec").alias("n"), F.round(F.col("vec")[0], 3).alias("first"), F.round(total, 2).alias("total"))


@query
def step_log_file(spark, sf_dir):
    path = new_path(spark, "log") + "/linear_iter3_intermediate"
    value = F.col("value")
    log = v.table(spark, sf_dir, "events").select(F.col("event_id").cast("int").alias("query"), value.alias("reward"), (value / 2).alias("estimate"), (value / 2).alias("delta"), F.lit(1).alias("jump"), F.lit(0.25).alias("p"), F.array(value * 2, -value).alias("theta"))
    writers.write_step_log(log, path, 2, "tsv")
    out = readers.read_run_logs(spark, path)
    return out.select("run_id", "seq", F.round("reward", 4).alias("reward"), "jump", "p", F.round(F.col("theta")[0], 4).alias("w0"), F.round(F.col("theta")[1], 4).alias("w1"))


@query
def curve_file(spark, sf_dir):
    path = new_path(spark, "curves")
    curves = _curves(spark, sf_dir).select(F.concat_ws("-", F.lit("m"), "grp").alias("model"), F.col("k").alias("alpha"), "probe", "avg", "std")
    writers.write_curve(curves, path)
    return spark.read.parquet(path).groupBy("model", F.col("alpha").cast("int").alias("alpha")).agg(F.count("*").alias("n"), F.round(F.sum("avg"), 3).alias("total"))


@query
def curve_text_file(spark, sf_dir):
    """Curves as text, a file for each parameter, whose path names it."""
    curves, path = materialize(_curves(spark, sf_dir), "curves"), new_path(spark, "curve-text")
    paths = [f"{path}/mu-0.3-alpha-2.5-k-{k}" for k in range(5)]
    for k, to in enumerate(paths):
        own = curves.filter(F.col("k") == k).select(F.col("grp").alias("model"), F.lit(k).alias("alpha"), "probe", "avg", "std")
        writers.write_curve(own.filter("model = 0").select(F.lit("m").alias("model"), "alpha", "probe", "avg", "std"), to, "tsv")
    out = readers.read_curves(spark, [*paths, f"{path}/missing"])
    return out.select(F.col("k").cast("int").alias("k"), F.col("mu").cast("double").alias("mu"), F.col("exponent").cast("double").alias("exponent"), "probe", F.round("avg", 3).alias("avg"), F.round("std", 3).alias("std"))


@query
def appended_samples(spark, sf_dir):
    """Samples of every second probe, then those of every third one, one higher: what is there already stays."""
    rows = materialize(_samples(spark, sf_dir), "samples")
    new = rows.filter("seq % 3 = 0").withColumn("reward", F.col("reward") + 1)
    return learning.append_samples(rows.filter("seq % 2 = 0"), new).select("run_id", "seq", F.round("reward", 3).alias("reward"))


@query
def stored_stats(spark, sf_dir):
    """Order counts by customer, stored for a first half of the names, then completed."""
    path = new_path(spark, "stats")
    orders = v.table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("name"), "o_orderkey")
    names = materialize(orders.select("name").distinct(), "names")
    count = lambda factor: lambda missing: orders.join(missing, "name").groupBy("name").agg((F.count("*") * factor).alias("n"))
    writers.upsert_stats(names.filter("cast(name AS INT) % 2 = 0"), path, count(1))
    return writers.upsert_stats(names, path, count(-1)).select(F.col("name").cast("long").alias("custkey"), "n")


@query
def probe_lines(spark, sf_dir):
    s = State(spark, sf_dir)
    return writers.format_probe_log(s.complete, s.probes, s.targets)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The default feature table of the observed graph after its seeds' probes, with a linear score."""
    scored = policies.score_linear(_default(spark, sf_dir), FEATURES, THETA)
    return scored.orderBy(F.col("value").desc(), "node")


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return {k: sql for k, sql in ORACLE.items() if k in _QUERIES}
