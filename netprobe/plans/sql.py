"""DuckDB SQL for the queries of the registry."""

from __future__ import annotations

# Views that most queries share.
_V = {
    "g": "SELECT DISTINCT a.l_partkey AS src, b.l_partkey AS dst FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_partkey < b.l_partkey WHERE a.l_returnflag = 'R' AND b.l_returnflag = 'R'",
    "s": "SELECT DISTINCT a.l_partkey AS src, b.l_partkey AS dst FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_partkey < b.l_partkey WHERE a.l_returnflag = 'R' AND b.l_returnflag = 'R' AND a.l_quantity >= 35 AND b.l_quantity >= 35",
    "sn": "SELECT src AS node FROM s UNION SELECT dst FROM s",
    "gn": "SELECT src AS node FROM g UNION SELECT dst FROM g",
    "al": "SELECT DISTINCT a.l_partkey AS src, b.l_partkey AS dst FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_partkey < b.l_partkey",
    "aln": "SELECT src AS node FROM al UNION SELECT dst FROM al",
    "ala": "SELECT src, dst FROM al UNION ALL SELECT dst, src FROM al",
    "ga": "SELECT src, dst FROM g UNION ALL SELECT dst, src FROM g",
    "sa": "SELECT src, dst FROM s UNION ALL SELECT dst, src FROM s",
    "t": "SELECT p_partkey AS node FROM part WHERE p_brand = 'Brand#13'",
    "pr": "SELECT node, row_number() OVER (ORDER BY md5(concat('7:', CAST(node AS VARCHAR))), node)::INT - 1 AS seq FROM sn WHERE node IN (SELECT node FROM t)",
    "rev": "SELECT seq, node, dst AS nbr, least(node, dst) AS src, greatest(node, dst) AS dst FROM pr JOIN ga ON ga.src = pr.node",
    "ne": "SELECT src, dst, min(seq) AS seq, arg_min(node, seq) AS node, arg_min(nbr, seq) AS nbr FROM rev WHERE (src, dst) NOT IN (SELECT src, dst FROM s) GROUP BY src, dst",
    "e": "SELECT src, dst, -1 AS seq FROM s UNION ALL SELECT src, dst, seq FROM ne",
    "n": "SELECT node, -1 AS seq FROM sn UNION ALL SELECT nbr, min(seq) FROM rev WHERE nbr NOT IN (SELECT node FROM sn) GROUP BY nbr",
    "ea": "SELECT src, dst FROM e UNION ALL SELECT dst, src FROM e",
}
_NEEDS = {"sn": ["s"], "gn": ["g"], "aln": ["al"], "ala": ["al"], "ga": ["g"], "sa": ["s"], "pr": ["sn", "t"], "rev": ["pr", "ga"], "ne": ["rev", "s"], "e": ["s", "ne"], "n": ["sn", "rev"], "ea": ["e"]}


def _with(names: str, body: str, recursive: str = "") -> str:
    wanted: list[str] = []

    def need(name: str) -> None:
        for other in _NEEDS.get(name, []):
            need(other)
        if name not in wanted:
            wanted.append(name)

    for name in names.split():
        need(name)
    parts = [f"{k} AS ({_V[k]})" for k in wanted]
    return f"WITH {'RECURSIVE ' if recursive else ''}{', '.join(parts + ([recursive] if recursive else []))} {body}"


def _degrees(adj: str, nodes: str) -> str:
    return f"SELECT n0.node, coalesce(d, 0) AS degree FROM {nodes} n0 LEFT JOIN (SELECT src, count(*) AS d FROM {adj} GROUP BY src) a ON a.src = n0.node"


def _triangles(edges: str) -> str:
    return f"SELECT x.src AS a, x.dst AS b, y.dst AS c FROM {edges} x JOIN {edges} y ON x.dst = y.src JOIN {edges} z ON z.src = x.src AND z.dst = y.dst"


def _per_node(edges: str) -> str:
    return f"SELECT node, count(*) AS triangles FROM (SELECT unnest([a, b, c]) AS node FROM ({_triangles(edges)})) GROUP BY node"


def _norm(x: str, zero: str = "0.0") -> str:
    return f"CASE WHEN max({x}) OVER () = min({x}) OVER () THEN {zero} ELSE ({x} - min({x}) OVER ()) / (max({x}) OVER () - min({x}) OVER ()) END"


def _comps(adj: str, nodes: str) -> str:
    return f"reach(node, root) AS (SELECT node, node FROM {nodes} UNION SELECT a.dst, r.root FROM reach r JOIN {adj} a ON a.src = r.node), comps AS (SELECT node, min(root) AS comp FROM reach GROUP BY node), sizes AS (SELECT comp, count(*) AS size FROM comps GROUP BY comp), sized AS (SELECT comp, size, {_norm('size', '1.0')} AS size_norm FROM sizes)"


def _ego(edges: str, adj: str, nodes: str) -> str:
    return f"""ego AS (SELECT d.node, d.degree, coalesce(t3.triangles, 0) AS triangles, coalesce(r.reach, 0) - 2 * coalesce(t3.triangles, 0) AS leaving, coalesce(p.n, 0) AS probed_nbrs
 FROM ({_degrees(adj, nodes)}) d LEFT JOIN ({_per_node(edges)}) t3 USING (node)
 LEFT JOIN (SELECT {adj}.src AS node, sum(d2.degree - 1) AS reach FROM {adj} JOIN ({_degrees(adj, nodes)}) d2 ON d2.node = {adj}.dst GROUP BY {adj}.src) r USING (node)
 LEFT JOIN (SELECT dst AS node, count(*) AS n FROM {adj} WHERE src IN (SELECT node FROM pr) GROUP BY dst) p USING (node))"""


_EGO = _ego("s", "sa", "sn")
_BASE = ["degree", "triangles", "leaving", "probed_nbrs"]
_KINDS = {"sum": "sum({})", "median": "median({})", "min": "min({})", "max": "max({})"}
_AGGS = [(f"{k}_{c}", f.format("b." + c)) for k, f in _KINDS.items() for c in _BASE]


def _uniform(key: str) -> str:
    return f"(('0x' || substr(md5({key}), 1, 13))::BIGINT / 16.0::DOUBLE^13)"


def _int(key: str) -> str:
    return f"('0x' || substr(md5({key}), 1, 13))::BIGINT"


_RUNS = "runs AS (SELECT user_id AS run_id, event_type AS param, value AS reward, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS seq, user_id % 3 AS grp, user_id % 5 AS k FROM events), cum AS (SELECT *, sum(reward) OVER (PARTITION BY run_id ORDER BY seq) AS cum_reward FROM runs), curves AS (SELECT grp, k, seq AS probe, avg(cum_reward) AS avg, stddev_pop(cum_reward) AS std, count(*) AS n_runs FROM cum GROUP BY grp, k, seq)"
_SAMPLES = "samples AS (SELECT * FROM (SELECT user_id AS run_id, row_number() OVER w - 1 AS seq, [1.0, round(value), hour(ts)] AS x, lead(round(value)) OVER w AS reward FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE reward IS NOT NULL)"
_DEFAULT = f"""f AS (SELECT d.node, d.degree, {_norm('d.degree')} AS degree_norm,
 CASE WHEN d.degree > 1 THEN 2 * coalesce(t3.triangles, 0) / (d.degree * (d.degree - 1)) ELSE 0.0 END AS cc, z.size_norm,
 CASE WHEN d.degree > 0 THEN coalesce(p.n, 0) / d.degree ELSE 0.0 END AS frac_probed,
 coalesce(rc.n, 0) AS reward_count, {_norm('coalesce(rc.n, 0)')} AS reward_count_norm, coalesce(tn.n, 0) AS target_nbrs
 FROM ({_degrees('ea', 'n')}) d LEFT JOIN ({_per_node('e')}) t3 USING (node) JOIN comps USING (node) JOIN sized z USING (comp)
 LEFT JOIN (SELECT dst AS node, count(*) AS n FROM ea WHERE src IN (SELECT node FROM pr) GROUP BY dst) p USING (node)
 LEFT JOIN (SELECT nbr AS node, count(*) AS n FROM ne GROUP BY nbr) rc USING (node)
 LEFT JOIN (SELECT dst AS node, count(*) AS n FROM ea WHERE src IN (SELECT node FROM t) GROUP BY dst) tn USING (node))"""

ORACLE: dict[str, str] = {
    "canonical_edges": _with("g", "SELECT src, dst FROM g"),
    "symmetric_edges": _with("ga", "SELECT src, dst FROM ga"),
    "node_neighbors": _with("sa", "SELECT p_partkey AS node, count(dst)::INT AS n_nbrs, coalesce(string_agg(dst, ',' ORDER BY dst), '') AS nbrs FROM part LEFT JOIN sa ON src = p_partkey GROUP BY p_partkey"),
    "singleton_nodes": _with("sn", "SELECT p_partkey AS node FROM part WHERE p_partkey NOT IN (SELECT node FROM sn)"),
    "induced_subgraph": _with("g sn", "SELECT src, dst FROM g WHERE src IN (SELECT node FROM sn) AND dst IN (SELECT node FROM sn)"),
    "ego_expand": _with("g t", "SELECT src, dst FROM g WHERE src IN (SELECT node FROM t) OR dst IN (SELECT node FROM t)"),
    "ego_nodes_2": _with("sa t", "SELECT node FROM t UNION SELECT dst FROM sa WHERE src IN (SELECT node FROM t) UNION SELECT b.dst FROM sa a JOIN sa b ON a.dst = b.src WHERE a.src IN (SELECT node FROM t)"),
    "attr_nodes": "SELECT DISTINCT l_partkey AS node FROM lineitem WHERE l_returnflag = 'A' AND l_linenumber = 7",
    "complete_attrs": "SELECT p_partkey AS node, coalesce(string_agg(a, ',' ORDER BY a), '') AS attrs FROM part LEFT JOIN (SELECT DISTINCT l_partkey, l_linenumber AS a FROM lineitem WHERE l_returnflag = 'A') ON l_partkey = p_partkey GROUP BY p_partkey",
    "unprobed_candidates": _with("n pr", "SELECT node, (seq = -1)::INT AS is_initial FROM n WHERE node NOT IN (SELECT node FROM pr)"),
    "probed_rows": _with("pr", "SELECT node FROM pr"),
    "node_sample": _with("g gn", ", r AS (SELECT node, row_number() OVER (ORDER BY md5(concat('11:', CAST(node AS VARCHAR))), node) - 1 AS r FROM gn), ranked AS (SELECT src, dst, greatest(a.r, b.r) AS high FROM g JOIN r a ON a.node = src JOIN r b ON b.node = dst) SELECT src, dst FROM ranked WHERE high <= (SELECT high FROM ranked ORDER BY high LIMIT 1 OFFSET (SELECT greatest(floor(count(*) * 0.05 + 1e-9)::BIGINT - 1, 0) FROM ranked))"),
    "seed_sample": _with("g t", "SELECT src, dst FROM g WHERE src IN (SELECT node FROM t ORDER BY md5(concat('3:', CAST(node AS VARCHAR))), node LIMIT 5) OR dst IN (SELECT node FROM t ORDER BY md5(concat('3:', CAST(node AS VARCHAR))), node LIMIT 5)"),
    "walk_path": _with("ga gn t", "SELECT walker, step, node, jumped FROM w",
        "nb AS (SELECT src AS node, list(dst ORDER BY dst) AS nbrs FROM ga GROUP BY src), pl AS (SELECT node, row_number() OVER (ORDER BY md5(concat('5:place:', CAST(node AS VARCHAR))), node) - 1 AS place FROM gn), "
        "w(walker, step, node, jumped) AS (SELECT node, 0, node, 1 FROM t WHERE node IN (SELECT node FROM gn) UNION ALL SELECT x.walker, x.step, CASE WHEN x.j = 1 THEN pl.node ELSE x.nxt END, x.j FROM ("
        f"SELECT w.walker, w.step + 1 AS step, ({_uniform(chr(39) + '5:jump:' + chr(39) + ' || w.walker || ' + chr(39) + ':' + chr(39) + ' || (w.step + 1)')} < 0.15)::INT AS j, nb.nbrs[1 + {_int(chr(39) + '5:nbr:' + chr(39) + ' || w.walker || ' + chr(39) + ':' + chr(39) + ' || (w.step + 1)')} % len(nb.nbrs)] AS nxt, {_int(chr(39) + '5:to:' + chr(39) + ' || w.walker || ' + chr(39) + ':' + chr(39) + ' || (w.step + 1)')} % (SELECT count(*) FROM gn) AS place FROM w JOIN nb USING (node) WHERE w.step < 4) x JOIN pl USING (place))"),
    "weighted_pick": f"WITH w AS (SELECT c_custkey AS node, (CASE WHEN (SELECT max(c_acctbal) FROM customer) > 0 THEN round(greatest(c_acctbal, 0) * 1e6) ELSE 1e6 END)::BIGINT AS w FROM customer), c AS (SELECT node, w, sum(w) OVER (ORDER BY md5(CAST(node AS VARCHAR)), node) AS high FROM w WHERE w > 0), d AS (SELECT draw, floor({_uniform(chr(39) + '9:' + chr(39) + ' || draw')} * (SELECT sum(w) FROM w))::BIGINT AS spot FROM range(100) r(draw)) SELECT draw, node FROM d JOIN c ON spot >= high - w AND spot < high",
    "probe_batch": _with("ne", "SELECT seq, src, dst FROM ne"),
    "replay_rewards": _with("sn ga s t", "SELECT 1").removesuffix("SELECT 1") + ", pl AS (SELECT node, row_number() OVER (ORDER BY md5(concat('7:', CAST(node AS VARCHAR))), node)::INT - 1 AS seq FROM sn), rv AS (SELECT seq, node, dst AS nbr, least(node, dst) AS a, greatest(node, dst) AS b FROM pl JOIN ga ON ga.src = pl.node), fe AS (SELECT seq, count(*) AS n FROM (SELECT a, b, min(seq) AS seq FROM rv WHERE (a, b) NOT IN (SELECT src, dst FROM s) GROUP BY a, b) GROUP BY seq), fn AS (SELECT seq, count(*) AS n FROM (SELECT nbr, min(seq) AS seq FROM rv WHERE nbr NOT IN (SELECT node FROM sn) GROUP BY nbr) GROUP BY seq) SELECT pl.seq, pl.node, coalesce(fn.n, 0) AS new_nodes, coalesce(fe.n, 0) AS new_edges, (pl.node IN (SELECT node FROM t))::INT AS target_hit, sum(coalesce(fn.n, 0)) OVER (ORDER BY pl.seq)::BIGINT AS cum_new_nodes FROM pl LEFT JOIN fe USING (seq) LEFT JOIN fn USING (seq)",
    "reward_counts": _with("ne", "SELECT nbr AS node, count(*) AS n FROM ne GROUP BY nbr"),
    "probed_neighbors": _with("sa pr", "SELECT dst AS node, count(*) AS n FROM sa WHERE src IN (SELECT node FROM pr) GROUP BY dst"),
    "degree_minmax": _with("ea n", f"SELECT node, degree, round({_norm('degree')}, 6) AS degree_norm FROM ({_degrees('ea', 'n')})"),
    "clustering": _with("g ga gn", f"SELECT d.node, coalesce(triangles, 0) AS triangles, round(CASE WHEN degree > 1 THEN 2 * coalesce(triangles, 0) / (degree * (degree - 1)) ELSE 0.0 END, 6) AS cc FROM ({_degrees('ga', 'gn')}) d LEFT JOIN ({_per_node('g')}) t3 USING (node)"),
    "clustering_all_lines": _with("al ala aln", f"SELECT d.node, degree, coalesce(triangles, 0) AS triangles, round(CASE WHEN degree > 1 THEN 2 * coalesce(triangles, 0) / (degree * (degree - 1)) ELSE 0.0 END, 6) AS cc FROM ({_degrees('ala', 'aln')}) d LEFT JOIN ({_per_node('al')}) t3 USING (node)"),
    "components": _with("sa sn", "SELECT node, comp, size, round(size_norm, 6) AS size_norm FROM comps JOIN sized USING (comp)", _comps("sa", "sn")),
    "merge_components": _with("ea n", "SELECT node, comp, size FROM comps JOIN sizes USING (comp)", _comps("ea", "n")),
    "frac_probed": _with("sa sn pr", f"SELECT d.node, degree, coalesce(p.n, 0) AS probed_nbrs, round(CASE WHEN degree > 0 THEN coalesce(p.n, 0) / degree ELSE 0.0 END, 6) AS frac_probed FROM ({_degrees('sa', 'sn')}) d LEFT JOIN (SELECT dst AS node, count(*) AS n FROM sa WHERE src IN (SELECT node FROM pr) GROUP BY dst) p USING (node)"),
    "target_neighbors": _with("sa sn t", "SELECT sn.node, count(sa.src) AS n FROM sn LEFT JOIN sa ON sa.dst = sn.node AND sa.src IN (SELECT node FROM t) GROUP BY sn.node"),
    "probed_overlap": _with("sa sn pr", "SELECT sn.node, count(sa.src) AS n, round(count(sa.src) / (SELECT count(*) FROM pr), 6) AS overlap FROM sn LEFT JOIN sa ON sa.dst = sn.node AND sa.src IN (SELECT node FROM pr) GROUP BY sn.node"),
    "egonet_counts": _with("s sa sn pr", "SELECT 1").removesuffix("SELECT 1") + f", {_EGO} SELECT node, degree, triangles, leaving::BIGINT AS leaving, probed_nbrs FROM ego",
    "refex_features": _with("s sa sn pr", f"SELECT node, degree, triangles, leaving::BIGINT AS leaving, probed_nbrs, {', '.join(k for k, _ in _AGGS)}, {', '.join(f'round({_norm(c)}, 6) AS {c}_norm' for c in [*_BASE, *[k for k, _ in _AGGS]])}, round(size_norm, 6) AS size_norm FROM full0 JOIN comps USING (node) JOIN sized USING (comp)",
        f"{_comps('sa', 'sn')}, {_EGO}, full0 AS (SELECT ego.*, {', '.join(f'coalesce({k}, 0.0) AS {k}' for k, _ in _AGGS)} FROM ego LEFT JOIN (SELECT sa.src AS node, {', '.join(f'{f}::DOUBLE AS {k}' for k, f in _AGGS)} FROM sa JOIN ego b ON b.node = sa.dst GROUP BY sa.src) USING (node))"),
    "knn_features": _with("sa sn pr", "SELECT 1").removesuffix("SELECT 1") + f", d AS ({_degrees('sa', 'sn')}), k AS (SELECT d.node, d.degree, coalesce(p.n, 0) AS probed_nbrs, coalesce(a.mean_degree, 0.0) AS mean_degree, coalesce(a.median_degree, 0.0) AS median_degree FROM d LEFT JOIN (SELECT dst AS node, count(*) AS n FROM sa WHERE src IN (SELECT node FROM pr) GROUP BY dst) p USING (node) LEFT JOIN (SELECT sa.src AS node, avg(d2.degree) AS mean_degree, median(d2.degree) AS median_degree FROM sa JOIN d d2 ON d2.node = sa.dst GROUP BY sa.src) a USING (node)) SELECT node, degree, probed_nbrs, round(mean_degree, 6) AS mean_degree, round(median_degree, 6) AS median_degree, {', '.join(f'round({_norm(c)}, 6) AS {c}_norm' for c in ('degree', 'probed_nbrs', 'mean_degree', 'median_degree'))} FROM k",
    "default_features": _with("e ea n ne pr t", "SELECT node, degree, round(degree_norm, 6) AS degree_norm, round(cc, 6) AS cc, round(size_norm, 6) AS size_norm, round(frac_probed, 6) AS frac_probed, reward_count, round(reward_count_norm, 6) AS reward_count_norm, target_nbrs FROM f", _comps("ea", "n") + ", " + _DEFAULT),
    "netdisc_features": _with("s sa sn pr t", "SELECT node, degree, round(degree_norm, 6) AS degree_norm, round(cc, 6) AS cc, round(size_norm, 6) AS size_norm, round(frac_probed, 6) AS frac_probed, target_nbrs FROM f",
        _comps("sa", "sn") + f", f AS (SELECT d.node, d.degree, {_norm('d.degree')} AS degree_norm, CASE WHEN d.degree > 1 THEN 2 * coalesce(t3.triangles, 0) / (d.degree * (d.degree - 1)) ELSE 0.0 END AS cc, z.size_norm, CASE WHEN d.degree > 0 THEN coalesce(p.n, 0) / d.degree ELSE 0.0 END AS frac_probed, coalesce(tn.n, 0) AS target_nbrs FROM ({_degrees('sa', 'sn')}) d LEFT JOIN ({_per_node('s')}) t3 USING (node) JOIN comps USING (node) JOIN sized z USING (comp) LEFT JOIN (SELECT dst AS node, count(*) AS n FROM sa WHERE src IN (SELECT node FROM pr) GROUP BY dst) p USING (node) LEFT JOIN (SELECT dst AS node, count(*) AS n FROM sa WHERE src IN (SELECT node FROM t) GROUP BY dst) tn USING (node))"),
    "refresh_features": _with("e ea n pr", f"SELECT d.node, degree, coalesce(triangles, 0) AS triangles, round(CASE WHEN degree > 1 THEN 2 * coalesce(triangles, 0) / (degree * (degree - 1)) ELSE 0.0 END, 6) AS cc, coalesce(p.n, 0) AS probed_nbrs FROM ({_degrees('ea', 'n')}) d LEFT JOIN ({_per_node('e')}) t3 USING (node) LEFT JOIN (SELECT dst AS node, count(*) AS n FROM ea WHERE src IN (SELECT node FROM pr) GROUP BY dst) p USING (node)"),
    "refresh_knn": _with("ea n pr", "SELECT 1").removesuffix("SELECT 1") + f", d AS ({_degrees('ea', 'n')}), k AS (SELECT d.node, d.degree, coalesce(p.n, 0) AS probed_nbrs, coalesce(a.mean_degree, 0.0) AS mean_degree, coalesce(a.median_degree, 0.0) AS median_degree FROM d LEFT JOIN (SELECT dst AS node, count(*) AS n FROM ea WHERE src IN (SELECT node FROM pr) GROUP BY dst) p USING (node) LEFT JOIN (SELECT ea.src AS node, avg(d2.degree) AS mean_degree, median(d2.degree) AS median_degree FROM ea JOIN d d2 ON d2.node = ea.dst GROUP BY ea.src) a USING (node)) SELECT node, degree, probed_nbrs, round(mean_degree, 6) AS mean_degree, median_degree FROM k",
    "refresh_refex": _with("e ea n pr", "SELECT 1").removesuffix("SELECT 1") + f", {_ego('e', 'ea', 'n')} SELECT node, degree, triangles, leaving::BIGINT AS leaving, probed_nbrs, {', '.join(f'coalesce({k}, 0.0) AS {k}' for k, _ in _AGGS)} FROM ego LEFT JOIN (SELECT ea.src AS node, {', '.join(f'{f}::DOUBLE AS {k}' for k, f in _AGGS)} FROM ea JOIN ego b ON b.node = ea.dst GROUP BY ea.src) USING (node)",
    "poly_features": _with("sa sn pr", f"SELECT node, 1.0::DOUBLE AS p0, degree::DOUBLE AS p1, n::DOUBLE AS p2, (degree * degree)::DOUBLE AS p3, (degree * n)::DOUBLE AS p4, (n * n)::DOUBLE AS p5 FROM (SELECT d.node, d.degree, coalesce(p.n, 0) AS n FROM ({_degrees('sa', 'sn')}) d LEFT JOIN (SELECT dst AS node, count(*) AS n FROM sa WHERE src IN (SELECT node FROM pr) GROUP BY dst) p USING (node))"),
    "log_bins": _with("ga gn", "SELECT node, degree, (SELECT min(b) FROM cuts WHERE cuts.edge >= dg.degree)::INT AS bin FROM dg",
        f"dg AS ({_degrees('ga', 'gn')}), h AS (SELECT degree, sum(count(*)) OVER (ORDER BY degree) AS upto FROM dg GROUP BY degree), tot AS (SELECT count(*) AS n FROM dg), cuts(b, edge, done) AS (SELECT 0, -1, 0::HUGEINT UNION ALL SELECT b + 1, (SELECT min(degree) FROM h WHERE upto >= c.done + ceil(0.5 * ((SELECT n FROM tot) - c.done))), (SELECT min(upto) FROM h WHERE upto >= c.done + ceil(0.5 * ((SELECT n FROM tot) - c.done))) FROM cuts c WHERE c.done < (SELECT n FROM tot))"),
    "normalize_positive": "SELECT c_custkey AS node, round(CASE WHEN c_acctbal > 0 THEN (c_acctbal - lo) / (hi - lo) ELSE c_acctbal END, 6) AS value FROM customer, (SELECT min(c_acctbal) AS lo, max(c_acctbal) AS hi FROM customer WHERE c_acctbal > 0)",
    "linear_topk": _with("e ea n ne pr t", "SELECT row_number() OVER (ORDER BY value DESC, node)::INT AS rank, node, value FROM (SELECT node, round(0.5 * degree_norm - 0.25 * cc + 0.125 * size_norm + frac_probed + 0.75 * reward_count_norm, 6) AS value FROM f WHERE node NOT IN (SELECT node FROM pr)) ORDER BY value DESC, node LIMIT 20", _comps("ea", "n") + ", " + _DEFAULT),
    "degree_topk": _with("sa sn", f"SELECT row_number() OVER (ORDER BY degree DESC, node)::INT AS rank, node, degree::DOUBLE AS value FROM ({_degrees('sa', 'sn')}) ORDER BY degree DESC, node LIMIT 10"),
    "mod_topk": _with("sa sn t", "SELECT row_number() OVER (ORDER BY n DESC, node)::INT AS rank, node, n::DOUBLE AS value FROM (SELECT sn.node, count(sa.src) AS n FROM sn LEFT JOIN sa ON sa.dst = sn.node AND sa.src IN (SELECT node FROM t) GROUP BY sn.node) ORDER BY n DESC, node LIMIT 10"),
    "reveal_topk": _with("s sa sn ga", f", ch AS (SELECT node, row_number() OVER (ORDER BY degree DESC, node) - 1 AS seq FROM ({_degrees('sa', 'sn')}) ORDER BY degree DESC, node LIMIT 10), rv AS (SELECT seq, dst AS nbr, least(node, dst) AS a, greatest(node, dst) AS b FROM ch JOIN ga ON ga.src = ch.node), fe AS (SELECT seq, count(*) AS n FROM (SELECT a, b, min(seq) AS seq FROM rv WHERE (a, b) NOT IN (SELECT src, dst FROM s) GROUP BY a, b) GROUP BY seq), fn AS (SELECT seq, count(*) AS n FROM (SELECT nbr, min(seq) AS seq FROM rv WHERE nbr NOT IN (SELECT node FROM sn) GROUP BY nbr) GROUP BY seq) SELECT seq::INT AS seq, node, coalesce(fn.n, 0) AS new_nodes, coalesce(fe.n, 0) AS new_edges FROM ch LEFT JOIN fe USING (seq) LEFT JOIN fn USING (seq)"),
    "epsilon_greedy": _with("ea n pr", f", sc AS (SELECT d.node, d.degree AS value, (n.seq = -1)::INT AS is_initial FROM ({_degrees('ea', 'n')}) d JOIN n USING (node) WHERE node NOT IN (SELECT node FROM pr)), sl AS (SELECT slot, jump, row_number() OVER (PARTITION BY jump ORDER BY slot) AS place FROM (SELECT slot::INT AS slot, ({_uniform(chr(39) + '1:eps:0:' + chr(39) + ' || slot')} < 0.3)::INT AS jump FROM range(20) r(slot))), gr AS (SELECT slot, node, jump FROM sl JOIN (SELECT node, row_number() OVER (ORDER BY value DESC, node) AS place FROM sc) USING (place) WHERE jump = 0), rn AS (SELECT node, row_number() OVER (ORDER BY is_initial DESC, md5('1:rand:0:' || node), node) AS place FROM sc WHERE node NOT IN (SELECT node FROM gr)) SELECT slot, node, jump FROM gr UNION ALL SELECT slot, node, jump FROM sl JOIN rn USING (place) WHERE jump = 1"),
    "softmax_values": _with("sa sn", f"SELECT node, round(exp(degree / 10.0::DOUBLE) / sum(exp(degree / 10.0::DOUBLE)) OVER (), 9) AS p FROM ({_degrees('sa', 'sn')})"),
    "decayed_epsilon": f"WITH {_RUNS} SELECT run_id, seq::INT AS seq, round(0.3 * exp(-seq / 100.0::DOUBLE), 9) AS epsilon FROM runs",
    "sgd_update": f"WITH {_SAMPLES}, st AS (SELECT run_id, x, 2 * 1e-5 * (reward - (0.1 * x[1] - 0.1 * x[2] + 0.05 * x[3])) AS g FROM samples) SELECT run_id, j::INT AS j, round([0.1, -0.1, 0.05][j + 1] + sum(g * x[j + 1]), 6) AS w FROM st, range(3) r(j) GROUP BY run_id, j",
    "init_theta": f"SELECT run_id, j::INT AS j, round({_uniform(chr(39) + '5:theta:' + chr(39) + ' || run_id || ' + chr(39) + ':' + chr(39) + ' || j')} * 0.4 - 0.2, 9) AS w FROM (SELECT DISTINCT user_id AS run_id FROM events), range(3) r(j)",
    "regularize": "SELECT vec_id, (i - 1)::INT AS j, round(greatest(embedding[i]::DOUBLE, 0.0) / sqrt(sum(greatest(embedding[i]::DOUBLE, 0.0)^2) OVER (PARTITION BY vec_id)), 6) AS w FROM embeddings, range(1, 65) r(i)",
    "htr_gram": f"WITH {_SAMPLES}, rk AS (SELECT run_id, x, row_number() OVER (PARTITION BY run_id ORDER BY md5('2:' || run_id || ':' || seq), seq) - 1 AS r, count(*) OVER (PARTITION BY run_id) AS c FROM samples), gr AS (SELECT run_id, x, least(4, c) AS kk, (r // least(2000, c // least(4, c)))::INT AS grp FROM rk), pairs(j, a, b) AS (VALUES (0, 1, 1), (1, 1, 2), (2, 1, 3), (3, 2, 2), (4, 2, 3), (5, 3, 3)) SELECT run_id, grp, count(*) AS n, j, round(sum(x[a] * x[b]), 4) AS s FROM gr, pairs WHERE grp < kk GROUP BY run_id, grp, j",
    "cumulative_reward": f"WITH {_RUNS} SELECT run_id, seq::INT AS seq, round(cum_reward, 4) AS cum_reward FROM cum",
    "total_reward": f"WITH {_RUNS} SELECT run_id, round(sum(reward), 4) AS total_reward, count(*) AS n_probes FROM runs GROUP BY run_id",
    "reward_curves": f"WITH {_RUNS} SELECT grp::INT AS grp, k::INT AS k, probe::INT AS probe, round(avg, 4) AS avg, round(std, 4) AS std, n_runs FROM curves",
    "best_params": f"WITH {_RUNS} SELECT grp::INT AS grp, k::INT AS k, round(best, 4) AS best FROM (SELECT grp, k, max(avg) AS best, row_number() OVER (PARTITION BY grp ORDER BY max(avg) DESC, k) AS n FROM curves GROUP BY grp, k) WHERE n = 1",
    "error_curves": f"WITH {_RUNS}, er AS (SELECT run_id, grp, seq, sum(abs(coalesce(CASE WHEN param <> 'error' THEN reward - 50 END, 0.0))) OVER (PARTITION BY run_id ORDER BY seq) AS c FROM runs WHERE seq >= 2 AND seq < 5000) SELECT grp::INT AS grp, seq::INT AS probe, round(avg(c), 4) AS avg, round(stddev_pop(c), 4) AS std, count(*) AS n_runs FROM er GROUP BY grp, seq",
    "theta_curves": "SELECT (i - 1)::INT AS j, vec_id % 10 AS probe, round(avg(embedding[i]::DOUBLE), 6) AS avg, round(stddev_pop(embedding[i]::DOUBLE), 6) AS std FROM embeddings, range(1, 65) r(i) GROUP BY i, vec_id % 10",
    "gain_table": "SELECT l_suppkey AS name, round(100 * (max(l_extendedprice) - avg(l_extendedprice)) / avg(l_extendedprice), 4) AS gain_high, round(100 * (max(l_extendedprice) - min(l_extendedprice)) / min(l_extendedprice), 4) AS gain_rand FROM lineitem GROUP BY l_suppkey",
    "curve_bands": f"WITH {_RUNS} SELECT grp::INT AS grp, k::INT AS k, probe::INT AS probe, probe::DOUBLE AS x, round(avg, 4) AS avg, round(avg - std, 4) AS low, round(avg + std, 4) AS high FROM curves WHERE probe < 5000 AND probe % 2 = 0",
    "run_grid": "SELECT policy, k, md5(policy || ':' || k) AS run_id, ('0x' || substr(md5(policy || ':' || k), 1, 8))::BIGINT AS seed FROM (SELECT DISTINCT event_type AS policy FROM events), (SELECT n_nationkey AS k FROM nation)",
    "transitivity": _with("g ga gn", f"SELECT t3 AS triangles, tr AS triples, round(3 * t3 / tr, 6) AS transitivity FROM (SELECT count(*) AS t3 FROM ({_triangles('g')})), (SELECT sum(degree * (degree - 1) // 2)::BIGINT AS tr FROM ({_degrees('ga', 'gn')}))"),
    "transitivity_all_lines": _with("al ala aln", f"SELECT t3 AS triangles, tr AS triples, round(3 * t3 / tr, 6) AS transitivity FROM (SELECT count(*) AS t3 FROM ({_triangles('al')})), (SELECT sum(degree * (degree - 1) // 2)::BIGINT AS tr FROM ({_degrees('ala', 'aln')}))"),
    "modularity": _with("g ga", ", c AS (SELECT p_partkey AS node, p_brand AS comm FROM part) SELECT m, round(sum(l / m - (d / (2 * m))^2), 6) AS modularity FROM (SELECT count(*) AS m FROM g), (SELECT comm, count(*) AS d, (SELECT count(*) FROM g JOIN c x ON x.node = src JOIN c y ON y.node = dst WHERE x.comm = c.comm AND y.comm = c.comm) AS l FROM ga JOIN c ON c.node = ga.src GROUP BY comm) GROUP BY m"),
    "degree_histogram": _with("ga gn", f"SELECT degree, count(*) AS n FROM ({_degrees('ga', 'gn')}) GROUP BY degree"),
    "avg_degree": _with("ga gn", f"SELECT count(*) AS nodes, sum(degree)::BIGINT AS degrees, round(avg(degree), 6) AS avg_degree FROM ({_degrees('ga', 'gn')})"),
    "power_law": _with("ga gn", f", h AS (SELECT degree::DOUBLE AS x, count(*)::DOUBLE AS n FROM ({_degrees('ga', 'gn')}) WHERE degree > 0 GROUP BY degree), tl AS (SELECT x, n, sum(n) OVER (ORDER BY x DESC) AS size, sum(n * ln(x)) OVER (ORDER BY x DESC) AS logs FROM h), fit AS (SELECT x AS xmin, size, 1 + size / (logs - size * ln(x)) AS alpha FROM tl WHERE logs - size * ln(x) > 1e-9), ks AS (SELECT xmin, alpha, max(greatest(abs(th - be), abs(th - be - n / size))) AS ks FROM (SELECT xmin, alpha, fit.size, tl.n, 1 - pow(tl.x / xmin, 1 - alpha) AS th, 1 - tl.size / fit.size AS be FROM fit JOIN tl ON tl.x >= xmin) GROUP BY xmin, alpha) SELECT xmin, round(alpha, 6) AS alpha, round(ks, 6) AS ks FROM ks ORDER BY round(ks.ks, 12), xmin LIMIT 1"),
    "ols": "SELECT 'l_quantity' AS term, round(regr_slope(l_extendedprice, l_quantity), 3) AS coef, round(regr_r2(l_extendedprice, l_quantity), 6) AS r2 FROM lineitem UNION ALL SELECT 'intercept', round(regr_intercept(l_extendedprice, l_quantity), 3), round(regr_r2(l_extendedprice, l_quantity), 6) FROM lineitem",
    "gram_sums": "SELECT a.i::INT AS i, b.i::INT AS j, round(sum(v[a.i + 1] * v[b.i + 1]), 2) AS s FROM (SELECT [1.0, l_quantity, l_discount, l_tax] AS v FROM lineitem), range(4) a(i), range(4) b(i) WHERE a.i <= b.i GROUP BY a.i, b.i",
    "stream_probes": _with("pr ne n", "SELECT pr.seq, coalesce(fe.c, 0) AS new_edges, coalesce(fn.c, 0) AS new_nodes FROM pr LEFT JOIN (SELECT seq, count(*) AS c FROM ne GROUP BY seq) fe USING (seq) LEFT JOIN (SELECT seq, count(*) AS c FROM n WHERE seq >= 0 GROUP BY seq) fn USING (seq)"),
    "stream_counts": _with("ne", "SELECT nbr AS node, count(*) AS n FROM ne GROUP BY nbr"),
    "stream_rewards": "SELECT user_id AS run_id, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY user_id",
    "network_file": _with("s", "SELECT src, dst FROM s"),
    "edge_list_file": _with("g gn", "SELECT src, dst, (SELECT count(*) FROM gn) AS n_nodes FROM g"),
    "attribute_file": "SELECT p_partkey AS node, (dense_rank() OVER (ORDER BY p_size) - 1)::INT AS attr_id FROM part",
    "embedding_file": "SELECT vec_id, len(embedding)::INT AS n, round(embedding[1]::DOUBLE, 3) AS first, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 2) AS total FROM embeddings",
    "step_log_file": "SELECT 3 AS run_id, event_id::INT AS seq, round(value, 4) AS reward, 1 AS jump, 0.25::DOUBLE AS p, round(value * 2, 4) AS w0, round(-value, 4) AS w1 FROM events",
    "curve_file": f"WITH {_RUNS} SELECT 'm-' || CAST(grp AS VARCHAR) AS model, k::INT AS alpha, count(*) AS n, round(sum(avg), 3) AS total FROM curves GROUP BY grp, k",
    "gain_extremes": """WITH p AS (SELECT l_suppkey AS name, max(l_extendedprice) AS htr, avg(l_extendedprice) AS high, min(l_extendedprice) AS rand FROM lineitem GROUP BY l_suppkey),
 g AS (SELECT name, 'gain_high' AS measure, 100 * (htr - high) / high AS gain FROM p UNION ALL SELECT name, 'gain_rand', 100 * (htr - rand) / rand FROM p)
 SELECT measure, round(min(gain), 4) AS least, round(max(gain), 4) AS most, first(name ORDER BY gain, name) AS least_at, first(name ORDER BY gain DESC, name) AS most_at FROM g GROUP BY measure""",
    "curve_maxima": f"WITH {_RUNS} SELECT grp::INT AS grp, k::INT AS k, round(max(avg), 4) AS top, round(first(probe ORDER BY avg DESC, probe) / 2000.0::DOUBLE, 6) AS at FROM curves WHERE probe < 5000 AND probe % 2 = 0 GROUP BY grp, k",
    "linreg_score": f"""WITH {_SAMPLES}, m AS (SELECT run_id, covar_pop(x[2], x[2]) AS a, covar_pop(x[2], x[3]) AS b, covar_pop(x[3], x[3]) AS c, covar_pop(x[2], reward) AS d, covar_pop(x[3], reward) AS e FROM samples GROUP BY run_id)
 SELECT run_id, seq::INT AS seq, round((c * d - b * e) / (a * c - b * b) * x[2] + (a * e - b * d) / (a * c - b * b) * x[3], 4) AS value FROM samples JOIN m USING (run_id)""",
    "grow_high": _with("ga sa sn", "SELECT seq::INT AS seq, node, new_nodes FROM steps WHERE seq >= 0", """steps AS (
 SELECT -1 AS seq, NULL::BIGINT AS node, []::BIGINT[] AS probed, 0.0::DOUBLE AS new_nodes
 UNION ALL
 SELECT seq + 1, pick.node, list_append(probed, pick.node),
  (SELECT count(*) FROM ga WHERE ga.src = pick.node AND ga.dst NOT IN (SELECT node FROM sn) AND NOT EXISTS (SELECT 1 FROM ga x WHERE x.dst = ga.dst AND list_contains(probed, x.src)))::DOUBLE
 FROM steps, LATERAL (
  SELECT src AS node FROM (SELECT src, dst FROM sa UNION SELECT src, dst FROM ga WHERE list_contains(probed, src) OR list_contains(probed, dst)) e
  WHERE NOT list_contains(probed, src) GROUP BY src ORDER BY count(*) DESC, src LIMIT 1) pick
 WHERE seq < 5)"""),
    "components_all_lines": _with("al aln ala", "SELECT comp, count(*) AS size FROM (SELECT node, min(label) AS comp FROM reach GROUP BY node) GROUP BY comp", "reach AS (SELECT node, node AS label FROM aln WHERE node NOT IN (SELECT src FROM ala WHERE dst < src) UNION SELECT ala.dst, reach.label FROM reach JOIN ala ON ala.src = reach.node)"),
    "cubic_features": _with("sa sn pr", f"SELECT node, 1.0::DOUBLE AS p0, d::DOUBLE AS p1, n::DOUBLE AS p2, (d * d)::DOUBLE AS p3, (d * n)::DOUBLE AS p4, (n * n)::DOUBLE AS p5, (d * d * d)::DOUBLE AS p6, (d * d * n)::DOUBLE AS p7, (d * n * n)::DOUBLE AS p8, (n * n * n)::DOUBLE AS p9 FROM (SELECT d.node, d.degree AS d, coalesce(p.n, 0) AS n FROM ({_degrees('sa', 'sn')}) d LEFT JOIN (SELECT dst AS node, count(*) AS n FROM sa WHERE src IN (SELECT node FROM pr) GROUP BY dst) p USING (node))"),
    "ols_errors": """WITH s AS (SELECT count(*) AS n, regr_slope(l_extendedprice, l_quantity) AS b, regr_intercept(l_extendedprice, l_quantity) AS a, regr_sxx(l_extendedprice, l_quantity) AS sxx, avg(l_quantity) AS m FROM lineitem),
 r AS (SELECT sum((l_extendedprice - a - b * l_quantity) * (l_extendedprice - a - b * l_quantity)) / (n - 2) AS v FROM lineitem, s GROUP BY n)
 SELECT 'l_quantity' AS term, round(sqrt(v / sxx), 3) AS std_err, round(b / sqrt(v / sxx), 2) AS t FROM s, r UNION ALL SELECT 'intercept', round(sqrt(v * (1.0 / n + m * m / sxx)), 3), round(a / sqrt(v * (1.0 / n + m * m / sxx)), 2) FROM s, r""",
    "curve_text_file": f"WITH {_RUNS} SELECT k::INT AS k, 0.3::DOUBLE AS mu, 2.5::DOUBLE AS exponent, probe::INT AS probe, round(avg, 3) AS avg, round(std, 3) AS std FROM curves WHERE grp = 0",
    "appended_samples": f"WITH {_SAMPLES} SELECT run_id, seq::INT AS seq, round(reward + CASE WHEN seq % 2 = 0 THEN 0 ELSE 1 END, 3) AS reward FROM samples WHERE seq % 2 = 0 OR seq % 3 = 0",
    "stored_stats": "SELECT o_custkey AS custkey, CASE WHEN o_custkey % 2 = 0 THEN count(*) ELSE -count(*) END AS n FROM orders GROUP BY o_custkey",
    "probe_lines": _with("pr ga", "SELECT p.seq, CAST(p.node AS VARCHAR) || ':1' || coalesce(string_agg(',' || CAST(a.dst AS VARCHAR) || ':' || CASE WHEN q.seq < p.seq THEN '1' ELSE '-1' END, '' ORDER BY a.dst), '') AS line FROM pr p LEFT JOIN ga a ON a.src = p.node LEFT JOIN pr q ON q.node = a.dst GROUP BY p.seq, p.node"),
}
