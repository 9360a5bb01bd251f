"""Growth on maintained features, and models of many runs at once."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from netprobe.functions.tables import materialize
from netprobe.operators import features as f
from netprobe.operators import fitting, graph, growth, learning, maintain, probing
from netprobe.operators.components import connected_components

BY = ["run_id"]


def random_graph(spark, seed, nodes=40, edges=90):
    """A complete graph with a hub, and two runs that observe different parts of it."""
    rng = np.random.default_rng(seed)
    pairs = {tuple(sorted(p)) for p in rng.integers(0, nodes, (edges, 2)).tolist() if p[0] != p[1]} | {(0, i) for i in range(1, nodes, 3)}
    complete = spark.createDataFrame(sorted(pairs), "src long, dst long").coalesce(2)
    part = [(run, a, b) for run in (3, 8) for a, b in sorted(pairs) if rng.random() < 0.25]
    return complete, spark.createDataFrame(part, "run_id long, src long, dst long").coalesce(2)


def whole(kind, edges, nodes, probes, targets, counts):
    """Features by a full recompute."""
    if kind == "knn":
        return f.knn_features(edges, nodes, probes, BY)
    label = lambda c: F.concat_ws(":", "run_id", c)
    comps = connected_components(edges.select(label("src").alias("src"), label("dst").alias("dst")))
    comps = nodes.select(*BY, "node", label("node").alias("_k")).join(comps.withColumnRenamed("node", "_k"), "_k", "left").select(*BY, "node", F.coalesce("comp", "_k").alias("comp"))
    if kind == "refex":
        return f.refex_features(edges, nodes, probes, comps, BY)
    if kind == "netdisc":
        return f.netdisc_features(edges, nodes, probes, comps, targets, BY)
    return f.default_features(edges, nodes, probes, comps, counts, targets, BY)


@pytest.mark.parametrize("kind", ["default", "netdisc", "knn", "refex"])
def test_maintained_features_equal_a_recompute(spark, kind):
    complete, sample = random_graph(spark, 5, 60, 70)
    targets = spark.createDataFrame([(n,) for n in range(0, 60, 4)], "node long")
    edges, nodes = (materialize(x, "t") for x in probing.init_state(sample, by=BY))
    g = maintain.Graph(spark, edges, nodes)
    first = nodes.groupBy("run_id").agg(F.max("node").alias("node"))  # probed from the start, without a reveal
    kept = maintain.Maintained(kind, g, first, targets, share=0.9)
    probes, counts = first, spark.createDataFrame([], "run_id long, node long, n long")
    columns = growth.feature_columns(kind, targets)
    for since, per_run in ((0, 1), (10, 3)):
        left = graph.candidates(nodes, probes, BY).withColumn("value", F.xxhash64("node", F.lit(since)))
        order = F.row_number().over(growth.W.partitionBy("run_id").orderBy("value"))
        chosen = materialize(left.withColumn("r", order).filter(F.col("r") <= per_run).select(*BY, "node", (F.col("r") - 1 + since).cast("int").alias("seq")), "t")
        revealed = probing.reveal(complete, chosen, BY)
        new_edges, new_nodes = materialize(probing.first_edges(revealed, edges, BY), "t"), materialize(probing.first_nodes(revealed, nodes, BY), "t")
        g.add(new_edges.select(*BY, "src", "dst", "seq"), new_nodes)
        kept.update(new_edges, new_nodes, chosen, since)
        edges, nodes = materialize(edges.unionByName(new_edges.select(*edges.columns)), "t"), materialize(nodes.unionByName(new_nodes.select(*nodes.columns)), "t")
        probes = materialize(probes.unionByName(chosen.select(*BY, "node")), "t")
        counts = counts.unionByName(new_edges.groupBy(*BY, F.col("nbr").alias("node")).agg(F.count("*").alias("n"))).groupBy(*BY, "node").agg(F.sum("n").alias("n"))
        counts = materialize(counts, "t")
        rows = lambda df: {(r.run_id, r.node): [pytest.approx(float(r[c])) for c in columns] for r in df.collect()}
        got = {k: [float(v.expected) for v in x] for k, x in rows(kept.features()).items()}
        assert got == rows(whole(kind, edges, nodes, probes, targets, counts))
        if kind in ("knn", "refex"):
            assert 0 < kept.refreshed <= nodes.count()
    assert g.edges().count() == edges.count() and g.nodes.read().count() == nodes.count()


def test_a_wide_change_makes_all_anew(spark, monkeypatch):
    complete, sample = random_graph(spark, 6)
    edges, nodes = probing.init_state(sample, by=BY)
    g = maintain.Graph(spark, edges, nodes)
    kept = maintain.Maintained("knn", g, spark.createDataFrame([], "run_id long, node long"), share=0.0)
    calls = []
    monkeypatch.setattr(maintain.Maintained, "_far", lambda self, e, n: calls.append(1) or f.raw_features(self.kind, e, n, self.probed, BY))
    chosen = nodes.groupBy("run_id").agg(F.min("node").alias("node"))
    kept.update(spark.createDataFrame([], "run_id long, src long, dst long, seq int, nbr long"), nodes.filter("false"), chosen, 0)
    assert calls and kept.refreshed > 0


def test_buckets_read_what_keys_need_and_are_written_anew(spark, monkeypatch):
    from netprobe.functions.tables import Buckets

    monkeypatch.setattr(Buckets, "COMPACT", 3)
    b = Buckets(spark, "buckets", "k")
    paths = set()
    for i in range(8):
        b.add(spark.range(i * 100, i * 100 + 100).select(F.col("id").alias("k"), F.lit(i).alias("v")))
        paths.add(b.path)
    assert b.read().count() == 800 and len(paths) == 4
    near = b.near(spark.range(5, 6).select(F.col("id").alias("k")))
    assert near.filter("k = 5").count() == 1 and near.count() < 100


def plain_newton(x, y, loss, penalty):
    x, theta = np.hstack([np.ones((len(x), 1)), x]), np.zeros(x.shape[1] + 1)
    weight = np.r_[0, np.full(x.shape[1] - 1, penalty)]
    for _ in range(200):
        value, slope, curve = loss(x @ theta, y)
        move = np.linalg.solve((x * curve[:, None]).T @ x / len(x) + np.diag(weight) + 1e-12 * np.eye(len(theta)), x.T @ slope / len(x) + weight * theta)
        at = lambda t: loss(x @ t, y)[0].mean() + weight @ t**2 / 2
        step = 1.0
        while at(theta - step * move) > at(theta) + 1e-15 and step > 1e-8:
            step /= 2
        theta = theta - step * move
    return theta


def run_samples(spark, runs, size=3, seed=0):
    rng = np.random.default_rng(seed)
    rows = []
    for run in range(runs):
        x = rng.normal(size=(30 + run % 7, size))
        y = (x @ rng.normal(size=size) + 0.3 * rng.normal(size=len(x)) > 0).astype(int)
        y[:2] = 0, 1
        rows += [(run, i, x[i].tolist(), int(y[i])) for i in range(len(x))]
    return rows, spark.createDataFrame(rows, "run_id long, id long, features array<double>, label int").coalesce(4)


@pytest.mark.parametrize(("loss", "part", "runs"), [("logistic", 16, 12), ("squared_hinge", 1000, 500)])
def test_newton_of_many_runs_equals_each_alone(spark, loss, part, runs, monkeypatch):
    monkeypatch.setattr(fitting, "PART", part)  # several parts a run, or one
    rows, samples = run_samples(spark, runs)
    got = {r.run_id: r.theta for r in fitting.newton(samples, loss).collect()}
    assert len(got) == runs
    for run in got:
        own = [r for r in rows if r[0] == run]
        want = plain_newton(np.array([r[2] for r in own]), np.array([r[3] for r in own], float), fitting.LOSSES[loss], fitting.PENALTY)
        assert got[run] == pytest.approx(want.tolist(), abs=1e-6)


def test_machine_equals_the_kernel_solution(spark):
    """Degree 3: the machine on all monomials, against coefficients of the samples with the kernel (1 + x y)^3."""
    rows, samples = run_samples(spark, 1, size=4, seed=3)
    x, y = np.array([r[2] for r in rows]), np.array([r[3] for r in rows], float)
    kernel = (1 + x @ x.T) ** 3
    assert fitting.polynomial(x) @ fitting.polynomial(x).T == pytest.approx(kernel)
    a, b, n = np.zeros(len(x)), 0.0, len(x)
    for _ in range(300):  # Newton on (coefficients, intercept); the curvature of the penalty is the kernel itself
        value, slope, curve = fitting.squared_hinge(kernel @ a + b, y)
        h = np.block([[kernel @ (curve[:, None] * kernel) / n + fitting.PENALTY * kernel, (kernel @ curve / n)[:, None]], [(curve @ kernel / n)[None], np.array([[curve.sum() / n]])]])
        g = np.r_[kernel @ (slope / n + fitting.PENALTY * a), slope.sum() / n]
        move = np.linalg.lstsq(h + 1e-10 * np.eye(n + 1), g, rcond=None)[0]
        at = lambda a, b: fitting.squared_hinge(kernel @ a + b, y)[0].mean() + fitting.PENALTY / 2 * a @ kernel @ a
        step = 1.0
        while at(a - step * move[:-1], b - step * move[-1]) > at(a, b) + 1e-15 and step > 1e-9:
            step /= 2
        a, b = a - step * move[:-1], b - step * move[-1]
    got = {r.id: r.value for r in learning.score_svm(samples.select("id", "features"), samples).collect()}
    assert [got[i] for i in range(n)] == pytest.approx((kernel @ a + b).tolist(), abs=1e-4)


def test_wide_features_are_sketched():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 64)) / 8
    s = fitting.polynomial(x, 3, 4096)
    assert s.shape == (60, 4096)
    exact, got = (1 + x @ x.T) ** 3, s @ s.T
    assert np.abs(got - exact).max() < 1.0 and np.corrcoef(got.ravel(), exact.ravel())[0, 1] > 0.98


@pytest.mark.parametrize("name", ["logit", "svm", "knn"])
def test_runs_of_one_class_are_calibrated(spark, name):
    """Rows like the known positives get high probabilities, others low ones; a run of misses mirrors that."""
    rng = np.random.default_rng(2)
    rows, samples = [], []
    for run, label in ((1, 1), (2, 0)):
        samples += [(run, i, (rng.normal(size=2) * 0.3 + 2).tolist(), label) for i in range(60)]
        rows += [(run, i, ((rng.normal(size=2) * 0.3 + (2 if i < 40 else -2))).tolist()) for i in range(200)]
    mixed, two = run_samples(spark, 3, size=2)
    mixed = [(r + 10, i, x, y) for r, i, x, y in mixed]
    rows += [(r, i, x) for r, i, x, _ in mixed]
    samples = spark.createDataFrame(samples + mixed, "run_id long, id long, features array<double>, label int").coalesce(2)
    frame = spark.createDataFrame(rows, "run_id long, node long, features array<double>").coalesce(2)
    got = fitting.fitted_runs(name, frame, samples).toPandas()
    assert len(got) == len(rows)
    own = got[got.run_id == 1]
    assert own[own.node < 40].value.mean() > own[own.node >= 40].value.mean() + 0.4 and own.value.between(0, 1).all()
    own = got[got.run_id == 2]
    assert own[own.node < 40].value.mean() < own[own.node >= 40].value.mean() - 0.4 and own.value.between(0, 1).all()
    alone = fitting.fitted(name, frame.filter("run_id = 11"), samples.filter("run_id = 11")).toPandas().set_index("node").value
    assert got[got.run_id == 11].set_index("node").value.sort_index().tolist() == pytest.approx(alone.sort_index().tolist(), abs=1e-6)


def test_runs_grow_as_each_would_alone(spark):
    """Fitted policies for all runs together, without a loop over runs."""
    complete, sample = random_graph(spark, 9)
    together = growth.grow(complete, sample, 4, 2, "logit", by=BY, burn_in=2, features="knn").toPandas()
    for run in (8,):
        alone = growth.grow(complete, sample.filter(F.col("run_id") == run), 4, 2, "logit", by=BY, burn_in=2, features="knn").toPandas()
        own = together[together.run_id == run]
        assert own.sort_values("seq").node.tolist() == alone.sort_values("seq").node.tolist()


def test_growth_with_embeddings(spark):
    complete, sample = random_graph(spark, 4, 20, 30)
    got = growth.grow(complete, sample, 1, 1, "linear", by=BY, features="refex_node2vec").collect()
    assert len(got) == 2 and all(len(r.theta) == 21 + 24 for r in got)


def plain_online(pairs, start, budget, alpha, theta, targets):
    """NOL by the definition: default features recomputed at every step, batches of one."""
    adj = {}
    for a, b in pairs:
        adj.setdefault(a, set()).add(b)
        adj.setdefault(b, set()).add(a)
    seen = {}
    for a, b in start:
        seen.setdefault(a, set()).add(b)
        seen.setdefault(b, set()).add(a)
    probed, counts, out = set(), {}, []

    def describe():
        comp, sizes = {}, {}
        for n in seen:
            if n not in comp:
                stack, own = [n], {n}
                while stack:
                    for m in seen[stack.pop()]:
                        if m not in own:
                            own.add(m)
                            stack.append(m)
                for m in own:
                    comp[m], sizes[n] = n, len(own)
        deg = {n: len(seen[n]) for n in seen}
        span = lambda v, vs, same: same if max(vs) == min(vs) else (v - min(vs)) / (max(vs) - min(vs))
        tri = {n: sum(len(seen[n] & seen[m]) for m in seen[n]) / 2 for n in seen}
        return {n: [
            span(deg[n], deg.values(), 0.0), 2 * tri[n] / (deg[n] * (deg[n] - 1)) if deg[n] > 1 else 0.0, span(sizes[comp[n]], sizes.values(), 1.0),
            len(seen[n] & probed) / deg[n] if deg[n] else 0.0, span(counts.get(n, 0), [counts.get(m, 0) for m in seen], 0.0), len(seen[n] & targets),
        ] for n in seen}

    for _ in range(budget):
        x = describe()
        value = {n: sum(a * b for a, b in zip(x[n], theta)) for n in seen if n not in probed}
        node = min(value, key=lambda n: (-value[n], n))
        new = adj[node] - set(seen)
        out.append((node, float(len(new)), value[node]))
        step = 2 * alpha * (len(new) - value[node])
        theta = [w + step * v for w, v in zip(theta, x[node])]
        for m in adj[node] - seen[node]:
            counts[m] = counts.get(m, 0) + 1
        for m in adj[node]:
            seen.setdefault(m, set()).add(node)
            seen[node].add(m)
        probed.add(node)
    return out


def test_online_growth_equals_a_plain_run(spark):
    complete, sample = random_graph(spark, 11, 25, 40)
    own = sample.filter("run_id = 3").select("src", "dst").cache()
    targets = set(range(0, 25, 5))
    got = growth.grow(complete, own, 5, 1, "linear", alpha=0.05, targets=spark.createDataFrame([(n,) for n in targets], "node long")).orderBy("seq").collect()
    want = plain_online([tuple(r) for r in complete.collect()], [tuple(r) for r in own.collect()], 5, 0.05, list(got[0].theta), targets)
    assert [(r.node, r.reward) for r in got] == [w[:2] for w in want]
    assert [r.estimate for r in got] == pytest.approx([w[2] for w in want])


def test_streamed_state_is_keyed(spark, tmp_path):
    """Many batches: each touches its own keys in the state store, and all together equal one replay."""
    from netprobe.streaming import probes as streams

    rng = np.random.default_rng(3)
    rows = sorted({(int(r), int(s), int(r * 100 + s % 13), int(n)) for r, s, n in zip(rng.integers(0, 2, 400), rng.integers(0, 60, 400), rng.integers(0, 90, 400))})
    rows = [x for x in rows if x[2] != x[3]]
    batches = 6
    for b in range(batches):  # responses of a seq come in one batch
        own = [x for x in rows if x[1] * batches // 60 == b]
        spark.createDataFrame(own + own[:3], streams.RESPONSES).coalesce(1).write.parquet(f"{tmp_path}/in/part={b}")
    sample = [spark.createDataFrame([(0, 1, 5), (1, 5, 100)], "run_id long, src long, dst long"), spark.createDataFrame([(0, 1), (0, 5), (1, 5), (1, 100)], "run_id long, node long")]
    progress, state, check = [], f"{tmp_path}/state", f"{tmp_path}/check"
    for b in range(batches):  # one folder more each time: a restart from the checkpoint, too
        stream = spark.readStream.schema(streams.RESPONSES).parquet(f"{tmp_path}/in/part={{{','.join(map(str, range(b + 1)))}}}")
        q = streams.stream_probes(stream, state, check, sample=sample if b == 0 else tuple(sample))
        q.awaitTermination()
        progress += [p for p in q.recentProgress if p["numInputRows"]]
    assert len(progress) == batches
    used = [p["stateOperators"][0] for p in progress]
    assert all(u["numRowsUpdated"] <= 4 * p["numInputRows"] for u, p in zip(used, progress)) and used[-1]["numRowsTotal"] > 2 * used[0]["numRowsTotal"]
    edges, nodes = {(0, 1, 5), (1, 5, 100)}, {(0, 1), (0, 5), (1, 5), (1, 100)}
    want = {}
    for b in range(batches):
        own = sorted(x for x in rows if x[1] * batches // 60 == b)
        for run, seq, node, nbr in sorted(own, key=lambda x: (x[1], x[0])):
            e = want.setdefault((run, seq), [0, 0])
            if (run, min(node, nbr), max(node, nbr)) not in edges:
                edges.add((run, min(node, nbr), max(node, nbr)))
                e[0] += 1
        for n, kind in sorted({((run, seq, k), (run, n)) for run, seq, node, nbr in own for k, n in ((0, node), (1, nbr))}):
            if kind not in nodes:
                nodes.add(kind)
                want[n[0], n[1]][1] += n[2]
    got = {(r.run_id, r.seq): [r.new_edges, r.new_nodes] for r in spark.read.parquet(f"{state}/log").collect()}
    assert got == want
    assert {(r.run_id, r.src, r.dst) for r in spark.read.parquet(f"{state}/edges").collect()} == edges
    assert {(r.run_id, r.node) for r in spark.read.parquet(f"{state}/nodes").collect()} == nodes


def test_components_of_runs_stay_apart(spark):
    edges = spark.createDataFrame([(1, 5, 6), (1, 6, 7), (2, 6, 8), (2, 9, 10), (3, 4, 4)], "run_id long, src long, dst long")
    got = {tuple(r) for r in connected_components(edges, by=BY).collect()}
    assert got == {(1, 5, 5), (1, 6, 5), (1, 7, 5), (2, 6, 6), (2, 8, 6), (2, 9, 9), (2, 10, 9)}


def test_a_round_joins_all_nodes_to_one_table_of_changes(spark, monkeypatch):
    complete, sample = random_graph(spark, 5)
    edges, nodes = (materialize(x, "t") for x in probing.init_state(sample, by=BY))
    g = maintain.Graph(spark, edges, nodes)
    kept = maintain.Maintained("default", g, spark.createDataFrame([], "run_id long, node long"), None)
    chosen = materialize(nodes.groupBy("run_id").agg(F.min("node").alias("node")).withColumn("seq", F.lit(0)), "t")
    revealed = probing.reveal(complete, chosen, BY)
    new_edges, new_nodes = materialize(probing.first_edges(revealed, edges, BY), "t"), materialize(probing.first_nodes(revealed, nodes, BY), "t")
    g.add(new_edges.select(*BY, "src", "dst", "seq"), new_nodes)
    plans = {}
    monkeypatch.setattr(maintain, "materialize", lambda df, label: plans.setdefault(label, df._jdf.queryExecution().optimizedPlan().toString()) and materialize(df, label))
    kept.update(new_edges, new_nodes, chosen, 0)
    assert plans["grow-raw"].count("Join LeftOuter") == 1
