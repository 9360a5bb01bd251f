"""Graph operators: the toy graph's known values, properties, files and streams."""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from netprobe.operators import embeddings, features, graph, growth, learning, netstats, policies, probing, runs, sampling
from netprobe.operators.components import connected_components
from netprobe.sources import readers, writers

COMPLETE = [(1, 2), (1, 3), (2, 3), (3, 4), (4, 5), (5, 6), (4, 6), (6, 7), (8, 9), (9, 10)]
SAMPLE = [(1, 2), (1, 3), (2, 3), (8, 9)]


@pytest.fixture(scope="module")
def toy(spark):
    edge = "src long, dst long"
    complete, sample = spark.createDataFrame(COMPLETE, edge), spark.createDataFrame(SAMPLE, edge)
    nodes = graph.node_set(sample, spark.createDataFrame([(4,)], "node long"))
    probes = spark.createDataFrame([(4, 0), (9, 1), (3, 2)], "node long, seq int")
    return complete, sample, nodes, probes


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_toy_before_any_probe(spark, toy):
    _, sample, nodes, probes = toy
    none, counts = probes.filter("false"), spark.createDataFrame([], "node long, n long")
    comps = connected_components(sample, nodes)
    out = features.default_features(sample, nodes, none, comps, counts)
    got = rows(out, "node", "degree", "degree_norm", "cc", "size_norm", "frac_probed", "reward_count")
    assert got == [(1, 2, 1, 1, 1, 0, 0), (2, 2, 1, 1, 1, 0, 0), (3, 2, 1, 1, 1, 0, 0), (4, 0, 0, 0, 0, 0, 0), (8, 1, 0.5, 0, 0.5, 0, 0), (9, 1, 0.5, 0, 0.5, 0, 0)]


def test_toy_after_three_probes(toy):
    complete, sample, nodes, probes = toy
    reward = rows(probing.rewards(complete, sample, nodes, probes), "seq", "node", "new_edges", "new_nodes")
    assert reward == [(0, 4, 3, 2), (1, 9, 1, 1), (2, 3, 0, 0)]
    edges, observed = probing.probe(complete, *probing.init_state(sample, nodes), probes)
    comps = connected_components(edges, observed)
    ego = rows(features.egonet_counts(edges, observed, probes), "node", "degree", "triangles", "leaving", "probed_nbrs")
    # 8 and 10 have one neighbour, 9, whose other edge leaves
    assert ego == [(1, 2, 1, 1, 1), (2, 2, 1, 1, 1), (3, 3, 1, 2, 1), (4, 3, 0, 2, 1), (5, 1, 0, 2, 1), (6, 1, 0, 2, 1), (8, 1, 0, 1, 1), (9, 2, 0, 0, 0), (10, 1, 0, 1, 1)]
    out = features.default_features(edges, observed, probes, comps, probing.reward_counts(complete, sample, probes))
    got = {r.node: r for r in out.collect()}
    assert {k: v.reward_count for k, v in got.items()} == {1: 0, 2: 0, 3: 1, 4: 0, 5: 1, 6: 1, 8: 0, 9: 0, 10: 1}
    assert got[3].cc == pytest.approx(1 / 3) and got[4].frac_probed == pytest.approx(1 / 3) and got[9].size_norm == 0
    new = features.merge_components(connected_components(sample, nodes), edges.filter("seq >= 0"), observed.filter("seq >= 0"))
    assert rows(new, "node", "comp") == rows(comps, "node", "comp")


def test_components_of_a_long_path(spark):
    path = spark.range(60).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    assert {r.comp for r in connected_components(path).collect()} == {0}
    assert connected_components(path.filter("false")).count() == 0


@pytest.mark.parametrize("n", [40, 400])
def test_components_against_brute_force(spark, n):
    import random

    rng = random.Random(n)
    pairs = [(rng.randrange(n), rng.randrange(n)) for _ in range(n // 2)] + [(n, n + i) for i in range(1, n)] + [(7, 7)]
    of = {x: x for e in pairs for x in e}
    for _ in of:
        moved = dict(of)
        for a, b in pairs:
            moved[a] = moved[b] = min(moved[a], moved[b])
        if moved == of:
            break
        of = moved
    edges = spark.createDataFrame(pairs, "src long, dst long")
    got = {r.node: r.comp for r in connected_components(edges, graph.node_set(edges)).collect()}
    assert got == of
    named = edges.select(*[F.concat(F.lit("n"), F.lpad(c, 5, "0")).alias(c) for c in ("src", "dst")])
    assert {int(r.node[1:]): int(r.comp[1:]) for r in connected_components(named, graph.node_set(named)).collect()} == of


def test_heavy_tailed_graph_has_each_triangle_once(spark):
    star = [(0, i) for i in range(1, 200)] + [(i, i + 1) for i in range(1, 199)]
    edges = spark.createDataFrame(star, "src long, dst long")
    assert features.triangles(edges).count() == 198
    counts = features.triangle_counts(edges, graph.node_set(edges))
    assert counts.agg(F.sum("triangles")).first()[0] == 3 * 198
    assert netstats.transitivity(edges).first().triangles == 198


@pytest.mark.parametrize("kind", ["default", "knn", "refex"])
def test_refresh_equals_recompute(spark, toy, kind):
    complete, sample, nodes, probes = toy
    path = spark.createDataFrame([(i, i + 1) for i in range(20, 40)] + [(20, 22), (25, 28), (30, 33), (33, 35)], "src long, dst long")
    far = spark.createDataFrame([(26, 29), (26, 31)], "src long, dst long")
    complete, sample = complete.unionByName(path).unionByName(far), sample.unionByName(path)
    nodes = graph.node_set(sample).unionByName(nodes.filter("node = 4"))
    probes = probes.unionByName(spark.createDataFrame([(26, 3)], "node long, seq int"))
    edges, observed = probing.probe(complete, *probing.init_state(sample, nodes), probes)
    old = features.raw_features(kind, sample, nodes, probes.filter("false"))
    fresh = features.refresh_raw(old, edges.select("src", "dst"), observed.select("node"), probes, probes.select("node"), kind)
    full = features.raw_features(kind, edges, observed, probes)
    assert rows(fresh, *full.columns) == rows(full, *full.columns)
    kept = graph.ego_nodes(edges, probes, features.REACH[kind])
    assert kept.count() < observed.count()  # some rows are kept


def test_bins_of_many_values(spark):
    values = [None, 0.5, 0.5, 1.25, 2.0, 7.0, 9.5, 9.5, 20.0]
    df = spark.createDataFrame([(x,) for x in values], "x double")
    got = {r.x: r.bin for r in features.log_bins(df, "x").collect()}
    assert got == {None: None} | _bins([x for x in values if x is not None])
    assert features.log_bins(df.filter("false"), "x").count() == 0


def _bins(values, p=0.5):
    """Brute force: the lowest share p of what is left, with ties."""
    left, out, number = sorted(values), {}, 0
    while left:
        number += 1
        edge = left[math.ceil(p * len(left)) - 1]
        out |= {x: number for x in left if x <= edge}
        left = [x for x in left if x > edge]
    return out


def test_growth_by_one_is_the_sequential_order(toy):
    complete, sample, _, _ = toy
    got = [(r.node, r.reward) for r in growth.grow(complete, sample, 5, 1, "high").orderBy("seq").collect()]
    adj = {}
    for a, b in COMPLETE:
        adj.setdefault(a, set()).add(b)
        adj.setdefault(b, set()).add(a)
    seen = {frozenset(e) for e in SAMPLE}
    known, probed, want = {n for e in SAMPLE for n in e}, set(), []
    for _ in range(5):
        node = min(known - probed, key=lambda n: (-sum(n in e for e in seen), n))
        want.append((node, float(len(adj[node] - known))))
        known |= adj[node]
        seen |= {frozenset((node, n)) for n in adj[node]}
        probed.add(node)
    assert got == want


def plain_growth(score, budget, lowest=False):
    """Probe by probe: (node, new nodes)."""
    adj = {}
    for a, b in COMPLETE:
        adj.setdefault(a, set()).add(b)
        adj.setdefault(b, set()).add(a)
    seen = {frozenset(e) for e in SAMPLE}
    known, probed, out = {n for e in SAMPLE for n in e}, set(), []
    while len(out) < budget and known - probed:
        node = min(known - probed, key=lambda n: (score(n, seen) * (1 if lowest else -1), n))
        out.append((node, float(len(adj[node] - known))))
        known |= adj[node]
        seen |= {frozenset((node, n)) for n in adj[node]}
        probed.add(node)
    return out


def test_growth_by_heuristics(spark, toy):
    complete, sample, _, _ = toy
    degree = lambda n, seen: sum(n in e for e in seen)
    hits = {3, 6, 9}
    targets = spark.createDataFrame([(n,) for n in hits], "node long")
    near = lambda n, seen: sum(n in e and bool((e - {n}) & hits) for e in seen)
    for policy, want in (("low", plain_growth(degree, 4, True)), ("mod", plain_growth(near, 4))):
        got = growth.grow(complete, sample, 4, 1, policy, targets=targets).orderBy("seq").collect()
        assert [(r.node, r.reward) for r in got] == want
        assert {(r.jump, r.delta, r.theta) for r in got} == {(0, 0.0, None)}
    drawn = growth.grow(complete, sample, 4, 2, "rand", seed=3).collect()
    assert len({r.node for r in drawn}) == 4 and {r.jump for r in drawn} == {1}


@pytest.mark.parametrize("policy", ["linear", "htr", "linreg", "logit", "svm", "knn"])
def test_growth_by_learned_policies(spark, toy, policy):
    """Rewards are those of a replay, no node comes twice, seeds start probed, weights are logged."""
    complete, sample, _, _ = toy
    seeds = spark.createDataFrame([(1,)], "node long")
    targets = spark.createDataFrame([(1,), (4,), (9,)], "node long")
    n = 4 if policy in growth.WEIGHTED else 2  # two rounds or one
    log = growth.grow(complete, sample, n, 2, policy, reward="target_hit", targets=targets, seeds=seeds, features="netdisc", k=2)
    got = log.orderBy("seq").collect()
    assert [(r.seq, r.node, r.reward) for r in got][0] == (-1, 1, 1.0)
    own = got[1:]
    assert [r.seq for r in own] == list(range(n)) and len({r.node for r in got}) == n + 1
    assert all(r.reward == float(r.node in (4, 9)) for r in own)
    assert all((r.theta is not None and len(r.theta) == 5) == (policy in ("linear", "htr")) for r in own)  # with target neighbours
    if policy in ("linear", "htr"):
        assert all(r.delta == pytest.approx(r.reward + 0.1 - r.estimate) for r in own)


def test_online_weights_follow_the_log(spark, toy):
    """The first choice is the best by the first weights, and a round moves them as the formula says."""
    complete, sample, _, _ = toy
    got = growth.grow(complete, sample, 2, 1, "linear", alpha=0.1, features="knn").orderBy("seq").collect()
    edges, nodes = probing.init_state(sample)
    x = {r.node: [r[c] for c in growth.FEATURE_SETS["knn"]] for r in features.knn_features(edges, nodes, nodes.filter("false")).collect()}
    value = {n: sum(a * b for a, b in zip(v, got[0].theta, strict=True)) for n, v in x.items()}
    best = min(value, key=lambda n: (-value[n], n))
    assert (got[0].node, got[0].estimate) == (best, pytest.approx(value[best]))
    assert got[1].theta == pytest.approx([w + 0.2 * got[0].delta * v for w, v in zip(got[0].theta, x[best], strict=True)])


def test_jumps_take_first_nodes_first(spark, toy, tmp_path):
    complete, sample, _, _ = toy
    runs = sample.withColumn("run_id", F.explode(F.array(*[F.lit(i).cast("long") for i in range(2)])))
    log = growth.grow(complete, runs, 6, 3, "high", by=["run_id"], epsilon=1.0, decay=True, seed=5, snapshot_gap=3, snapshot_path=str(tmp_path)).toPandas()
    assert sorted(log.run_id.unique()) == [0, 1] and log.groupby("run_id").node.nunique().tolist() == [6, 6]
    first = log[log.seq < 3]
    assert (first.jump == 1).all() and first.node.isin([1, 2, 3, 8, 9]).all() and (first.p == 1.0).all()
    assert log[log.seq >= 3].p.unique() == pytest.approx([math.exp(-0.5)])
    assert spark.read.parquet(str(tmp_path)).select("query").distinct().count() == 2


def test_unknown_names_are_errors(toy):
    complete, sample, _, _ = toy
    for options in ({"policy": "best"}, {"features": "all"}, {"reward": "fame"}, {"policy": "mod"}):
        with pytest.raises(ValueError, match="unknown|needed"):
            growth.grow(complete, sample, 1, **options)


def test_samples(spark, toy):
    complete = toy[0]
    out = sampling.node_sample(complete, 0.5, 3)
    assert out.count() >= 5 and rows(graph.induced_subgraph(complete, graph.node_set(out)), "src", "dst") == rows(out, "src", "dst")
    walked = sampling.generate_sample("walk", complete, 0.5, walkers=4, steps=6)
    assert 0 < walked.count() <= 5 and walked.join(complete, ["src", "dst"], "left_anti").isEmpty()
    with pytest.raises(ValueError, match="unknown"):
        sampling.generate_sample("none", complete)
    with pytest.raises(ValueError, match="within"):
        sampling.generate_sample("node", complete, 2)
    values = spark.createDataFrame([(1, -5.0), (2, 1.0), (3, 3.0)], "node long, value double")
    drawn = {r.node: r["count"] for r in sampling.weighted_pick(values, 400, 1).groupBy("node").count().collect()}
    assert sum(drawn.values()) == 400 and 1 not in drawn and 60 < drawn[2] < 140


@pytest.mark.parametrize("n", [400, 4000])
def test_walks_go_on_until_the_sample_is_full(spark, n, monkeypatch):
    ring = spark.range(n).select(F.col("id").alias("src"), ((F.col("id") + 1) % n).alias("dst"))
    edges = graph.canonical_edges(ring.unionByName(spark.range(n).select(F.col("id").alias("src"), ((F.col("id") * 7 + 3) % n).alias("dst"))))
    out = sampling.walk_sample(edges, 0.25, 4, 4)
    assert out.count() == edges.count() // 4 and out.join(edges, ["src", "dst"], "left_anti").isEmpty()
    few = sampling.generate_sample("iknn", edges, 0.1, walkers=4, steps=4)
    assert 0 < graph.node_set(few).count() <= n // 10
    monkeypatch.setattr(sampling, "STALLED", 1)
    with pytest.raises(RuntimeError, match="reaches"):
        sampling.walk_sample(spark.createDataFrame([(1, 2), (3, 4)], "src long, dst long"), 1, 1, 8, jump=0)


def test_policies(spark):
    scored = spark.createDataFrame([(i, float(i % 3), int(i < 4)) for i in range(9)], "node long, value double, is_initial int")
    assert [r.node for r in policies.choose_top(scored, 3).orderBy("rank").collect()] == [2, 5, 8]
    mixed = policies.choose_epsilon_greedy(scored, 6, 0.5, 4)
    assert mixed.count() == 6 == mixed.select("node").distinct().count()
    assert policies.softmax(scored, "value").agg(F.sum("p")).first()[0] == pytest.approx(1)


def test_learning_against_numpy(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 2))
    y = x @ [2.0, -1.0] + rng.standard_t(1.5, size=60) * 0.01
    data = [(0, i, x[i].tolist(), float(y[i])) for i in range(60)]
    samples = spark.createDataFrame(data, "run_id long, seq int, features array<double>, reward double")
    w = learning.htr_fit(samples, 2, 4, 1).first().theta
    assert np.allclose(w, [2, -1], atol=0.1)
    fit = learning.linreg_theta(samples, 2).first()
    want = np.linalg.lstsq(np.column_stack([np.ones(60), x]), y, rcond=None)[0]
    assert np.allclose([fit.intercept, *fit.theta], want)
    thetas = spark.createDataFrame([(0, [0.1, 0.2])], "run_id long, theta array<double>")
    one = learning.sgd_update(samples.filter("seq = 0"), thetas, 2, 0.05).first().theta
    t = np.array([0.1, 0.2])
    assert np.allclose(one, t + 2 * 0.05 * (y[0] - x[0] @ t) * x[0])
    assert (learning.resolve_k("ln", 100), learning.resolve_k("log2", 1), learning.resolve_k(9, 4)) == (4, 1, 4)
    with pytest.raises(ValueError, match="unknown"):
        learning.resolve_k("eval", 5)
    near = learning.score_knn(samples.select(F.col("seq").alias("id"), "features"), samples.select(F.col("seq").alias("id"), "features", (F.col("reward") > 0).cast("int").alias("label")), 5)
    got = {r.id: r.value for r in near.collect()}
    for i in (0, 7):
        order = np.argsort(((x - x[i]) ** 2).sum(axis=1), kind="stable")[:5]
        assert got[i] == pytest.approx((y[order] > 0).mean())


def test_nearest_samples_stay_out_of_the_driver(spark, monkeypatch):
    import numpy as np

    x = np.random.default_rng(3).integers(0, 4, (50, 2)).astype(float)  # many ties
    rows_ = spark.createDataFrame([(i, x[i].tolist(), i % 3 % 2) for i in range(50)], "id long, features array<double>, label int")
    monkeypatch.setattr(type(rows_), "toPandas", lambda _: pytest.fail("the driver collects the samples"))
    for name in ("KNN_ROWS", "KNN_SAMPLES"):
        monkeypatch.setattr(learning, name, 7, raising=False)
    got = {r.id: r.value for r in learning.score_knn(rows_.select("id", "features"), rows_, 5).collect()}
    for i in range(50):
        order = np.argsort(((x - x[i]) ** 2).sum(axis=1), kind="stable")[:5]
        assert got[i] == pytest.approx((order % 3 % 2).mean())


def test_communities_find_two_cliques(spark):
    edges = [(a, b) for base in (0, 10) for a in range(base, base + 5) for b in range(a + 1, base + 5)] + [(4, 10)]
    df = spark.createDataFrame(edges, "src long, dst long")
    parts = netstats.communities(df)
    assert netstats.modularity(df, parts).first().modularity > 0.3


@pytest.mark.parametrize("n", [0, 1])
def test_communities_are_connected(spark, n):
    """Rings of cliques and random graphs: each community is one component of its own edges, and Q is high."""
    rng = np.random.default_rng(n)
    pairs = {(c * 6 + a, c * 6 + b) for c in range(8) for a in range(6) for b in range(a + 1, 6)} | {(c * 6, (c * 6 + 9) % 48) for c in range(8)}
    if n:
        pairs = {tuple(p) for p in rng.integers(0, 60, (150, 2)).tolist()}
    df = spark.createDataFrame(sorted({tuple(sorted(p)) for p in pairs if p[0] != p[1]}), "src long, dst long").coalesce(2)
    parts = netstats.communities(df).cache()
    label = {r.node: r.comm for r in parts.collect()}
    inside = [(a, b) for a, b in df.collect() if label[a] == label[b]]
    for comm in set(label.values()):
        own = {k for k, c in label.items() if c == comm}
        reached, stack = {min(own)}, [min(own)]
        while stack:
            k = stack.pop()
            for a, b in inside:
                other = b if a == k else a if b == k else None
                if other is not None and other not in reached:
                    reached.add(other)
                    stack.append(other)
        assert reached == own
    assert netstats.modularity(df, parts).first().modularity > (0.7 if n == 0 else 0.3)


@pytest.mark.parametrize("exact", [8, 2048])
def test_power_law_by_bounds_equals_all_cuts(spark, exact, monkeypatch):
    monkeypatch.setattr(netstats, "EXACT", exact)
    monkeypatch.setattr(netstats, "GRID", 4)
    rng = np.random.default_rng(exact)
    values, counts = np.unique(np.floor(5 * (1 - rng.random(3000)) ** (-1 / 1.5)), return_counts=True)
    got = netstats.power_law_fit(spark.createDataFrame(list(zip(values.astype(int).tolist(), counts.tolist())), "degree long, n long")).first()
    best = []
    for i, xmin in enumerate(values):
        x, c = values[i:], counts[i:]
        size, logs = c.sum(), (c * np.log(x)).sum()
        if logs - size * np.log(xmin) <= 1e-9:
            continue
        alpha = 1 + size / (logs - size * np.log(xmin))
        theory, below = 1 - (x / xmin) ** (1 - alpha), 1 - c[::-1].cumsum()[::-1] / size
        best.append((round(max(np.abs(theory - below).max(), np.abs(theory - below - c / size).max()), 12), xmin, alpha))
    assert (got.ks, got.xmin, got.alpha) == pytest.approx(min(best))


def test_draws_fall_into_the_ranges_of_the_nodes(spark):
    values = spark.createDataFrame([(i, float(v)) for i, v in enumerate([0, 5, -3, 1000, 0.5, 7] + [1] * 200)], "node long, value double").repartition(5)
    picked = sampling.weighted_pick(values, 5000, 3)
    plan = picked._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    counts = {r.node: r["count"] for r in picked.groupBy("node").count().collect()}
    total = 1000 + 5 + 0.5 + 7 + 200
    assert sum(counts.values()) == 5000 and picked.select("draw").distinct().count() == 5000
    assert 0 not in counts and 2 not in counts and abs(counts[3] / 5000 - 1000 / total) < 0.03
    assert sampling.weighted_pick(values.filter("false"), 10).count() == 0
    even = sampling.weighted_pick(values.filter("node IN (0, 2)"), 400, 1).groupBy("node").count().collect()
    assert len(even) == 2 and all(120 < r["count"] < 280 for r in even)


def test_lines_are_numbered_over_splits_and_files(spark, tmp_path):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        (tmp_path / "many").mkdir()
        want = []
        for name in ("a", "b"):
            lines = [f"{name}{i} " + "x" * (i % 50) for i in range(400)]
            want += lines
            (tmp_path / "many" / f"{name}.txt").write_text("\n".join(lines) + "\n")
        got = readers.numbered_lines(spark, str(tmp_path / "many"))
        assert got.select("number").distinct().count() == 800
        assert [r.value for r in got.orderBy("number").collect()] == want
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    (tmp_path / "flat.txt").write_text("3 1\na 0.5\nb 2\n7 1\n")
    assert {r.node: r.vec for r in readers.read_embeddings(spark, str(tmp_path / "flat.txt")).collect()} == {"a": [0.5], "b": [2.0], "7": [1.0]}


def test_factors_give_the_table_back(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(30, 4))
    table = x @ x.T
    df = spark.createDataFrame([(i, j, float(table[i, j])) for i in range(30) for j in range(30)], "a long, b long, w double").coalesce(4)
    got = {r.node: r.vec for r in embeddings.factorize(df, 6, rounds=3).collect()}
    y = np.array([got[i] for i in range(30)])
    assert y @ y.T == pytest.approx(table, abs=1e-6)


def test_places_number_the_neighbours(spark):
    edges = spark.createDataFrame([(0, i) for i in range(1, 300)] + [(5, 6)], "src long, dst long")
    places, counts = graph.neighbor_places(edges, spark.createDataFrame([(900,), (0,)], "node long"))
    assert rows(places.filter("node = 0"), "place", "nbr") == [(i, i + 1) for i in range(299)]
    assert rows(places.filter("node = 5"), "place", "nbr") == [(0, 0), (1, 6)]
    assert rows(counts.filter("node IN (0, 5, 900)"), "node", "degree") == [(0, 299), (5, 2), (900, 0)]


@pytest.mark.parametrize(("p", "q"), [(0.3, 1.0), (0.5, 2.0), (4.0, 0.5)])
def test_second_steps_follow_the_weights(spark, p, q):
    pairs = [(1, 2), (1, 3), (2, 3), (3, 4), (3, 5), (4, 5), (5, 6), (2, 6)]
    edges = spark.createDataFrame(pairs, "src long, dst long")
    paths = [r.path for r in embeddings.node2vec_walks(edges, 2, 2000, p, q, 4).collect()]
    adj = {n: {b for a, b in pairs if a == n} | {a for a, b in pairs if b == n} for n in range(1, 7)}
    assert len(paths) == 12000 and all(b in adj[a] and c in adj[b] for a, b, c in paths)
    for first in adj:
        for second in adj[first]:
            after = [c for a, b, c in paths if (a, b) == (first, second)]
            weight = {c: 1 / p if c == first else 1.0 if c in adj[first] else 1 / q for c in adj[second]}
            for c, w in weight.items():
                share = w / sum(weight.values())
                assert abs(after.count(c) / len(after) - share) < 5 * math.sqrt(share * (1 - share) / len(after)) + 1e-9


def test_embeddings_tell_two_cliques_apart(spark):
    import numpy as np

    pairs = [(a + k, b + k) for k in (0, 10) for a in range(8) for b in range(a + 1, 8)] + [(0, 10)]
    edges = spark.createDataFrame(pairs, "src long, dst long")
    vectors = embeddings.node2vec_features(edges, 8, seed=2, length=12, per_node=30)
    all_rows = embeddings.embedding_or_ones(spark.createDataFrame([(str(n),) for n in (*range(8), *range(10, 18), 99)], "node string"), vectors, 8)
    got = {int(r.node): np.array(r.vec) for r in all_rows.collect()}
    assert len(got) == 17 and got.pop(99).tolist() == [1.0] * 8
    near = lambda a, b: got[a] @ got[b] / np.linalg.norm(got[a]) / np.linalg.norm(got[b])
    within = np.mean([near(a, b) for a in got for b in got if a < b and (a < 10) == (b < 10)])
    across = np.mean([near(a, b) for a in got for b in got if a < 10 <= b])
    assert within > across + 0.1


def test_positive_unlabelled(spark):
    """The share of positives among unlabelled rows comes out, though only positives are labelled."""
    import numpy as np

    rng = np.random.default_rng(3)
    truth = np.arange(2400) % 3 == 0
    x = rng.normal(size=(2400, 2)) + np.where(truth, 3.0, -1.0)[:, None]
    data = [(i, [float(u) for u in x[i]], bool(truth[i])) for i in range(2400)]
    df = spark.createDataFrame(data, "id long, features array<double>, truth boolean")
    labelled = df.filter("truth AND id % 2 = 0").select("id", "features")
    rest = df.filter("NOT (truth AND id % 2 = 0)").select("id", "features")
    got = {r.id: r.value for r in learning.score_positive_unlabelled(rest, labelled, seed=1).collect()}
    assert len(got) == 2000 and all(0 <= value <= 1 for value in got.values())
    hidden, negative = (np.mean([v for i, v in got.items() if truth[i] == side]) for side in (True, False))
    assert hidden > 0.8 and negative < 0.1


def test_files(spark, tmp_path):
    (tmp_path / "net.txt").write_text("# head\na b c\nb a\nd\n\nc c\ne f {'w': 1} g\nx # y z\n")
    nodes, edges = readers.read_network(spark, str(tmp_path / "net.txt"))
    assert rows(edges, "src", "dst") == [("a", "b"), ("a", "c"), ("e", "f")]
    assert {r.node for r in nodes.collect()} == {"a", "b", "c", "d", "e", "f"}
    (tmp_path / "edges.csv").write_text("a, b\nb,a\nb,c\n")
    n, edges = readers.read_edge_list(spark, str(tmp_path / "edges.csv"), ",")
    assert n == 3 and edges.count() == 2
    (tmp_path / "attr.txt").write_text("a\tb\n\nc\ta\n")
    assert rows(readers.read_attributes(spark, str(tmp_path / "attr.txt")), "node", "attr_id") == [("a", 0), ("a", 2), ("b", 0), ("c", 2)]
    assert readers.read_attributes(spark, str(tmp_path / "attr.txt"), ids=[2]).count() == 2
    (tmp_path / "emb.txt").write_text("1 2\na 0.5 1.5\n")
    assert readers.read_embeddings(spark, str(tmp_path / "emb.txt")).first().vec == [0.5, 1.5]
    log = spark.createDataFrame([(0, 1.0, 0.5, 0.5, 0, 0.1, [0.1, 0.2])], "query int, reward double, estimate double, delta double, jump int, p double, theta array<double>")
    writers.write_step_log(log, str(tmp_path / "NOL_iter3_x"), 2, "tsv")
    back = readers.read_run_logs(spark, [str(tmp_path / "NOL_iter3_x"), str(tmp_path / "missing")]).first()
    assert (back.run_id, back.theta, back.reward) == (3, [0.1, 0.2], 1.0)
    assert readers.read_run_logs(spark, [str(tmp_path / "missing")]) is None
    complete = spark.createDataFrame(COMPLETE, "src long, dst long")
    probes, hits = spark.createDataFrame([(4, 0), (3, 1)], "node long, seq int"), spark.createDataFrame([(4,)], "node long")
    lines = [r.line for r in writers.format_probe_log(complete, probes, hits).orderBy("seq").collect()]
    assert lines == ["4:1,3:-1,5:-1,6:-1", "3:0,1:-1,2:-1,4:1"]
    writers.write_edge_list(complete, str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out")).count() == 20
    names = spark.createDataFrame([("a",), ("b",)], "name string")
    made = []
    for _ in range(2):
        out = writers.upsert_stats(names, str(tmp_path / "stats"), lambda m: made.append(m.count()) or m.withColumn("v", F.lit(1)))
    assert made == [2] and out.count() == 2


def test_streams(spark, tmp_path):
    from netprobe.streaming import probes as stream

    data = [(0, 0, 1, 2), (0, 1, 2, 1), (0, 1, 2, 3), (1, 0, 1, 2)]
    spark.createDataFrame(data, stream.RESPONSES).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(stream.RESPONSES).parquet(str(tmp_path / "in"))
    for _ in range(2):  # a second run finds nothing new
        stream.stream_probes(source, str(tmp_path / "state"), str(tmp_path / "checkpoint")).awaitTermination()
    # node 1 was known to its prober, node 2 before it is probed itself
    assert rows(spark.read.parquet(str(tmp_path / "state/log")), "run_id", "seq", "new_edges", "new_nodes") == [(0, 0, 1, 1), (0, 1, 1, 1), (1, 0, 1, 1)]
    assert rows(stream.reward_counts(spark, str(tmp_path / "state")), "run_id", "node", "n") == [(0, 2, 1), (0, 3, 1), (1, 2, 1)]
    known = [spark.createDataFrame([(0, 2, 1)], "run_id long, src long, dst long"), spark.createDataFrame([(0, 1), (0, 2)], "run_id long, node long")]
    stream.stream_probes(source, str(tmp_path / "given"), str(tmp_path / "c3"), sample=known).awaitTermination()
    assert rows(spark.read.parquet(str(tmp_path / "given/log")), "run_id", "seq", "new_edges", "new_nodes") == [(0, 0, 0, 0), (0, 1, 1, 1), (1, 0, 1, 1)]
    log = spark.readStream.schema(stream.RESPONSES).parquet(str(tmp_path / "in")).select("run_id", F.lit(2.0).alias("reward"))
    stream.run_to_table(stream.stream_rewards(log), str(tmp_path / "sums"), str(tmp_path / "c2")).awaitTermination()
    assert rows(spark.read.parquet(str(tmp_path / "sums")), "run_id", "n", "total") == [(0, 3, 6.0), (1, 1, 2.0)]


def test_run_tables(spark):
    log = spark.createDataFrame([(0, 0, 1.0), (0, 1, 2.0), (1, 0, 3.0)], "run_id long, seq int, reward double")
    curves = runs.reward_curves(runs.cumulative_reward(log).withColumn("m", F.lit("a")), ["m"])
    assert rows(curves, "probe", "avg", "std", "n_runs") == [(0, 2.0, 1.0, 2), (1, 3.0, 0.0, 1)]
    grid = runs.run_grid(spark, {"k": [1, 2], "eps": [0.0, 0.1, 0.2]}, 2)
    assert grid.count() == 12 == grid.select("run_id").distinct().count()


def test_triangles_send_lists_and_not_wedges(spark):
    """Before, each wedge was a row of a join of its own, sorted and sent."""
    clique = [(i, j) for i in range(1, 9) for j in range(i + 1, 9)]
    df = spark.createDataFrame([*clique, *[(0, i) for i in range(1, 40)]], "src long, dst long")
    found = features.triangles(df)
    assert sorted(tuple(sorted(r)) for r in found.collect()) == sorted([*combinations(range(1, 9), 3), *[(0, *e) for e in clique]])
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "array_intersect" in plan and "LeftSemi" not in plan
    runs = df.withColumn("run", F.explode(F.array(F.lit("a"), F.lit("b"))))
    runs = runs.filter("run = 'a' OR src <> 0")
    assert {tuple(r) for r in features.triangles(runs, ["run"]).groupBy("run").count().collect()} == {("a", 84), ("b", 56)}


def test_components_hold_nodes_and_sort_no_edges(spark, monkeypatch):
    """Before, the least neighbour was a struct, for which all edges were sorted."""
    from netprobe.operators import components as module

    plans, write = [], module.materialize
    monkeypatch.setattr(module, "materialize", lambda df, label: (plans.append(df._jdf.queryExecution().executedPlan().toString()), write(df, label))[1])
    df = spark.createDataFrame([(3, 2), (2, 1), (2, 3), (5, 5), (9, 8)], "src long, dst long")
    assert rows(connected_components(df), "node", "comp") == [(1, 1), (2, 1), (3, 1), (8, 8), (9, 8)]
    assert len(plans) > 2 and not any("SortAggregate" in p for p in plans)


def test_pairs_are_dealt_to_more_parts_of_a_larger_table(spark, sf_dir, monkeypatch):
    from netprobe.functions import views

    plain = rows(views.complete_graph(spark, sf_dir), "src", "dst")
    monkeypatch.setattr(views, "PAIR_LINES", 1000)
    dealt = views.complete_graph(spark, sf_dir)
    assert rows(dealt, "src", "dst") == plain
    assert dealt.rdd.getNumPartitions() == views.table(spark, sf_dir, "lineitem").count() // 1000


def test_communities_send_no_table_of_nodes_through_the_driver(spark, monkeypatch):
    plans, write = [], netstats.materialize
    monkeypatch.setattr(netstats, "materialize", lambda df, label: (plans.append(df._jdf.queryExecution().executedPlan().toString()), write(df, label))[1])
    df = spark.createDataFrame([(1, 2), (2, 3), (1, 3), (3, 4), (4, 5), (5, 6), (4, 6)], "src long, dst long")
    parts = dict(rows(netstats.communities(df, 2, 1), "node", "comm"))
    assert sorted(parts) == [1, 2, 3, 4, 5, 6]
    assert len(plans) > 5 and not any("Broadcast" in p for p in plans)


def test_nearest_samples_by_one_product(monkeypatch):
    """Before, the distances of all pairs were made one by one and sorted."""
    rng = np.random.default_rng(3)
    q, x, ids = rng.normal(size=(40, 16)), rng.normal(size=(3000, 16)), rng.permutation(3000)
    x[100:110], q[3] = x[5], x[5]  # copies: ties by id
    gap = np.round(((q[:, None] - x[None]) ** 2).sum(axis=2), 9)
    want = np.lexsort((np.broadcast_to(ids, gap.shape), gap), axis=1)[:, :5]
    exact, plain = [], np.round
    monkeypatch.setattr(learning.np, "round", lambda a, n: (exact.append(len(a)), plain(a, n))[1])
    i, j, near = learning._nearest(q, x, ids, 5)
    assert sum(exact) < 0.01 * gap.size
    assert (i.reshape(40, 5) == np.arange(40)[:, None]).all() and (j.reshape(40, 5) == want).all()
    assert (near.reshape(40, 5) == np.take_along_axis(gap, want, axis=1)).all()
    x[7] = np.inf
    assert 7 not in learning._nearest(q, x, ids, 5)[1]
    assert sorted(learning._nearest(q[:1], x[:2], ids[:2], 5)[1]) == [0, 1]


def test_walk_steps_may_send_walkers_to_the_neighbours(spark, monkeypatch):
    """Before, an outer join kept the neighbours' rows from staying where they are."""
    plans, write = {}, sampling.materialize
    monkeypatch.setattr(sampling, "materialize", lambda df, label: (plans.setdefault(label, df._jdf.queryExecution().optimizedPlan().toString()), write(df, label))[1])
    edges = spark.createDataFrame(COMPLETE, "src long, dst long")
    starts = spark.createDataFrame([(i, i) for i in range(1, 11)] + [(11, 11)], "walker long, node long")
    path = rows(sampling.walk(edges, starts, 5, 0.3, nodes=spark.createDataFrame([(11,)], "node long")), "walker", "step", "node", "jumped")
    assert len(path) == 11 * 6 and any(j == 0 for _, s, _, j in path if s) and (11, 0, 11, 1) in path
    where, near = {(w, s): n for w, s, n, _ in path}, {frozenset(e) for e in COMPLETE}
    assert all(frozenset((where[w, s - 1], n)) in near for w, s, n, j in path if not j)
    assert "Outer" not in plans["walk-step"]


def test_node2vec_takes_the_first_draw_where_weights_are_equal(spark, monkeypatch):
    """Before, four draws were made for each step, and the rest looked for in another round."""
    monkeypatch.setattr(embeddings, "Parts", None)  # the table of further rounds
    edges = spark.createDataFrame(COMPLETE, "src long, dst long")
    paths = [r["path"] for r in embeddings.node2vec_walks(edges, seed=1).collect()]
    near = {frozenset(e) for e in COMPLETE}
    assert len(paths) == 20 and all(len(p) == 4 and all(frozenset(e) in near for e in zip(p, p[1:], strict=False)) for p in paths)


def _triangles_of_nodes(edges):
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    found = {n: sum(b in near[a] for a, b in combinations(sorted(near[n]), 2)) for n in near}
    return {n: t for n, t in found.items() if t}


@pytest.mark.parametrize("kind", ["near", "far", "hub"])
def test_triangles_in_parts_are_counted_once(spark, monkeypatch, kind):
    import random

    from netprobe.operators import triangles

    rng = random.Random(kind)
    if kind == "near":  # copies of one graph with shifted keys
        one = {tuple(sorted(rng.sample(range(30), 2))) for _ in range(120)}
        pairs = {(a + 30 * i - 200, b + 30 * i - 200) for a, b in one for i in range(20)}
    else:
        pairs = {tuple(sorted(rng.sample(range(-50, 90), 2))) for _ in range(1500)} | {(200, 200 + i) for i in range(1, 300 if kind == "hub" else 2)} | {(200 + i, 201 + i) for i in range(1, 299)}
    monkeypatch.setattr(triangles, "EDGES", 300)
    monkeypatch.setattr(triangles, "DEALT", 500)
    plans, plan = [], triangles._plan
    monkeypatch.setattr(triangles, "_plan", lambda sizes: (plans.append(plan(sizes)), plans[-1])[1])
    edges = spark.createDataFrame([e if rng.random() < 0.5 else e[::-1] for e in pairs], "src int, dst int")
    got = triangles.node_triangles(edges)
    assert got.schema["node"].dataType == edges.schema["src"].dataType
    assert {r.node: r.triangles for r in got.collect()} == _triangles_of_nodes(pairs)
    _, ranges, parts, sizes = plans[0]
    assert ranges > 2 and len(parts) > 3
    if kind == "near":  # an edge goes to few parts, though there are many ranges
        assert ranges > 8 and sizes.sum() < 5 * len(pairs)
    counted = features.clustering(edges, None, found=got)
    assert rows(counted, "node", "degree", "triangles", "cc") == rows(features.clustering(edges, graph.node_set(edges)), "node", "degree", "triangles", "cc")
    assert triangles.node_triangles(edges.filter("false")).count() == 0


def test_clustering_of_all_lines_sends_no_lists(spark, sf_dir):
    """Before, each node's list went to each of its higher neighbours: ten times the input at 60 copies of sf0.1."""
    from netprobe.plans import registry

    plan = registry.clustering_all_lines(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "array_intersect" not in plan and "collect_list" not in plan


def test_transitivity_of_all_lines_sends_no_lists(spark, sf_dir):
    """Before, each node's list went to each of its higher neighbours, and the nodes were made once more for their degrees."""
    from netprobe.plans import registry

    plan = registry.transitivity_all_lines(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "array_intersect" not in plan and "collect_list" not in plan and "Join LeftOuter" not in plan


def test_transitivity_of_counted_triangles(spark):
    edges = spark.createDataFrame([(i, j) for i in range(5) for j in range(i + 1, 5)] + [(4, 9)], "src long, dst long")
    from netprobe.operators.triangles import node_triangles

    assert netstats.transitivity(edges, node_triangles(edges)).first() == netstats.transitivity(edges).first()
    none = edges.filter("dst = 9")
    assert tuple(netstats.transitivity(none, node_triangles(none)).first()) == (0, 0, 0.0)
