"""Exact top-k, spelling variants and conversation repair against plain versions."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from netprobe.llm import dialogue, spelling, topk

# 11


def plain_topk(rows, k=5, every=50):
    own = [(i, [int(np.floor(256 * float(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for i, q in own:
        if i % every == 0:
            scored = sorted((-max(min(sum(a * b for a, b in zip(q, v)), 2**63 - 1), -(2**63)), j) for j, v in own if j != i)
            out += [(i, rank, j, -s) for rank, (s, j) in enumerate(scored[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("n", [1, 3, 40, 700])
def test_block_keeps_the_best(n):
    rng = np.random.default_rng(n)
    for levels in (3, 200):  # few values: many ties
        rows, ids = rng.integers(-levels, levels, (n, 8)).astype(float), rng.permutation(n) - n // 2
        q, r, s = topk.best_of_block(rows[: n // 2 + 1], ids[: n // 2 + 1], rows, ids)
        for i in range(n // 2 + 1):
            scores = rows @ rows[i]
            want = [j for j in np.lexsort((ids, -scores)) if ids[j] != ids[i]][:5]
            assert r[q == i].tolist() == want and s[q == i].tolist() == scores[want].tolist()


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 1000), st.floats(0.01, 1))
def test_scores_lie_between_their_bounds(seed, share):
    rng = np.random.default_rng(seed)
    rows, queries = rng.integers(-9, 9, (30, 5)).astype(float), rng.integers(-9, 9, (4, 5)).astype(float)
    parts = np.hstack([np.maximum(queries, 0), np.minimum(queries, 0)])
    lower, upper = topk.bounds(parts, np.argsort(rows, axis=0), rows, max(1, int(30 * share)))
    scores = queries @ rows.T
    assert (lower <= scores).all() and (scores <= upper).all()


def test_reading_stops_before_the_end(monkeypatch):
    """On vectors with few large components, bounds settle the answer from a part of the lists."""
    depths, bounds = [], topk.bounds
    monkeypatch.setattr(topk, "bounds", lambda parts, order, rows, depth: depths.append(depth) or bounds(parts, order, rows, depth))
    rng = np.random.default_rng(5)
    rows = np.floor(rng.exponential(10, (1000, 4)) ** 2)
    topk.best_of_block(rows[:20], np.arange(20), rows, np.arange(1000))
    assert max(depths) < 1000


def test_topk_of_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(topk, "ROWS", 16)
    monkeypatch.setattr(topk, "QUERIES", 2)
    rng = random.Random(4)
    vector = lambda: [rng.choice([-0.5, 0.001, 0.25, 1.5]) for _ in range(4)]
    rows = [(i, vector()) for i in range(120)] + [(200, None), (250, [1.0, None, 0.0, 0.0]), (300, [float("nan")] * 4), (350, [float("inf")] * 4), (None, vector()), (400, []), (450, [1.0]), (500, [1.0] * 9), (-50, [1e30, -1e30, 3e20, 1.0])]
    df = spark.createDataFrame([(i, v, 7, 1) for i, v in rows], "vec_id long, embedding array<double>, rank int, score int")
    assert sorted(map(tuple, topk.search(df).collect())) == plain_topk(rows)
    again = topk.search(df.filter("vec_id = 0 OR vec_id < 20").union(df.filter("vec_id = 0")).union(df.filter("vec_id = 3"))).collect()
    assert Counter(r.query_id for r in again) == {0: 10, -50: 5}  # each row that repeats is asked for itself
    assert topk.search(df.filter("false")).count() == 0


def test_topk_equals_its_sql(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf_dir}/embeddings.parquet'")
    got = sorted(map(tuple, topk.query(spark, sf_dir).select("query_id", "rank", "vec_id", "score").collect()))
    assert got == sorted(con.execute(topk.ORACLE).fetchall()) and got


# 12


def plain_near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(rows):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            low = run.translate(str.maketrans(spelling.UPPER, spelling.LOWER))
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{low}".encode())
            if h % 199 == 0:
                low = low[: h % len(low)] + low[h % len(low) + 1 :]
            counts[low] += len(low) >= 6
    n = {w: c for w, c in counts.items() if c >= 5}
    near = {w: [v for v in n if plain_near(w, v)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 5 * n[w] else None

    def root(w):
        return w if form[w] is None else root(form[w])

    return sorted((w, form[w], root(w), n[w], len(near[w]), n[form[w]] if form[w] else None) for w in n)


def variants(df):
    return sorted(tuple(r) for r in spelling.query(df).select("word", "form", "root", "n", "n_near", "form_n").collect())


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text("abcé", min_size=1, max_size=7), min_size=2, max_size=12, unique=True))
def test_prefix_and_suffix_find_single_edits(words):
    m = spelling.Matrix(words)
    for i, j in itertools.combinations(range(len(words)), 2):
        s = min(len(words[i]), len(words[j]))
        one, two = np.array([i]), np.array([j])
        found = [bool(spelling.near_pairs(m, one, two, s // 2, last)[0]) for last in (False, True)]
        assert sum(found) == plain_near(words[i], words[j])  # in one of the two buckets


def test_variants_of_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got, want = variants(docs), plain_variants([(r.doc_id, r.text) for r in docs.collect()])
    assert got == want and any(r[1] for r in got)


def test_variants_of_hot_buckets(spark, monkeypatch):
    """One beginning for all words, cut into many blocks; chains of forms; ties."""
    monkeypatch.setattr(spelling, "BLOCK_WORDS", 8)
    rng = random.Random(1)
    words = ["prefix" + "".join(rng.choice("ab") for _ in range(rng.randint(0, 6))) for _ in range(120)]
    rows = [(i, " ".join([w] * (5 ** rng.randint(1, 4)))) for i, w in enumerate(dict.fromkeys(words))]
    df = spark.createDataFrame([(i, t, 3, "x") for i, t in rows], "doc_id long, text string, n long, word string")
    got = variants(df)
    assert got == plain_variants(rows) and any(r[1] and r[2] != r[1] for r in got)


def test_variants_of_odd_rows(spark):
    long = "q" * 100_000
    texts = [None, "", "12 34", "Wörter WÖRTER wörter Wörtern " * 9, f"{long} {long}a " * 6, "×÷Àÿéè " * 7, "aĀbcdefghi " * 8]
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, texts[3]), (None, "orphan orphans " * 20)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert variants(df) == plain_variants(rows)
    assert spelling.query(df.filter("false")).count() == 0


# 13


def plain_repair(rows):
    space = lambda x: " " if x is None else str(x)
    step = {("s", 0): 1, ("u", 0): 2, ("u", 1): 2, ("u", 3): 2, ("a", 2): 3}
    conversations = defaultdict(list)
    for c, t, role, text in rows:
        own, d = conversations[c], zlib.crc32(f"{space(c)}:{space(t)}".encode()) % 20
        role, text = space(role), space(text)
        text = "" if d == 1 else re.sub("[.!?]", "", text) if d == 2 else text
        own += [(t, "user" if d == 4 else role, text)] * (0 if d == 0 else 2 if d == 3 else 1)
    out = []
    for c, own in conversations.items():
        own = sorted(own, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        turns = [t for t, _, _ in own if t is not None]
        seen, faults = set(), []
        for _, role, text in own:
            bare = text.strip(" \t\n\x0b\x0c\r")
            faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
            seen.add((role, text))
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(own))
        best = {0: (0, "", [])}

        def keep(to, state, value):
            if state is not None and (state not in to or value[:2] < to[state][:2]):
                to[state] = value

        def inserted(best):
            for _ in range(3):
                for q, (cost, audit, kept) in list(best.items()):
                    for role in ("user", "assistant"):
                        keep(best, step.get((role[0], q)), (cost + 5, audit + "I", [*kept, (role, "")]))
            return best

        for (_, role, text), fault in zip(own, faults):
            then = {}
            for q, (cost, audit, kept) in inserted(best).items():
                keep(then, q, (cost + 2, audit + "D", kept))
                if fault not in ("blank", "duplicate"):
                    cost += 5 * (fault == "truncated")
                    keep(then, step.get((role[:1], q)), (cost, audit + "K", [*kept, (role, text)]))
                    for other in ("user", "assistant"):
                        keep(then, step.get((other[0], q)), (cost + 1, audit + "R", [*kept, (other, text)]))
            best = then
        cost, audit, kept = min((v for q, v in inserted(best).items() if q in (0, 3)), key=lambda v: v[:2])
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in kept).encode()).hexdigest()
        out.append((c, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *map(faults.count, ("blank", "duplicate", "truncated")), illegal, cost, audit, digest))
    return sorted(out, key=str)


def repaired(df):
    columns = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    return sorted((tuple(r) for r in dialogue.repair(df).select(*columns).collect()), key=str)


CHAT = "conv_id long, turn long, role string, text string"


def test_repair_of_conversations(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    got = repaired(df)
    assert got == plain_repair([tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()])
    assert sum(r[6] for r in got) > 0 and dialogue.query(spark, sf_dir).count() == len(got)


def odd_chats():
    rng = random.Random(3)
    roles, texts = ["system", "user", "assistant", "tool", "", None, "user", "User"], ["Hi.", "no end", "", "Ok!", "  \t", None, "Why? ", "a.\nb"]
    rows = [(c, rng.choice([None, *range(-2, 40)]), rng.choice(roles), rng.choice(texts)) for c in (None, 0, 8, 9) for _ in range(50)]
    rows += [(10, i, ("user", "assistant")[i % 2], f"t{i}.") for i in range(2000)]  # one rule upon another
    rows += [(11, i // 3, rng.choice(roles), f"q{i}" + rng.choice([".", "", " "])) for i in range(900)]
    rows += [(12, t, "user", "x.") for t in range(40) if zlib.crc32(f"12:{t}".encode()) % 20 == 0]  # nothing is left
    rows += [(13, 2**62, "user", "far."), (13, -(2**62), "user", "far away " * 20_000), rows[0], rows[60]]
    return rows


@pytest.mark.parametrize("parts", [1, 7])
def test_repair_of_odd_rows(spark, parts):
    rows = odd_chats()
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], CHAT + ", cost long, audit string").repartition(parts)
    assert repaired(df) == sorted([(c, g if g < 2**63 else None, *rest) for c, g, *rest in plain_repair(rows)], key=str)
    assert repaired(df.filter("false")) == []


def test_cut_conversations_are_joined(spark):
    """A conversation whose rows lie in several tasks."""
    rng = random.Random(9)
    rows = [(1, i, rng.choice(["user", "assistant", "system"]), f"text {i % 70}" + rng.choice([".", "?", ""])) for i in range(3000)]
    df = spark.createDataFrame(rows + [(2, 0, "user", "Hello.")], CHAT)
    faults = dialogue.with_faults(dialogue.damaged(df)).cache()
    found = dialogue.pieces(faults).cache()
    assert found.filter("conv = 1").count() > 1
    assert repaired(df) == plain_repair(rows + [(2, 0, "user", "Hello.")])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, dialogue.SYMBOLS - 1), max_size=40), min_size=1, max_size=6))
def test_grammar_keeps_the_products(sequences):
    grammar = dialogue.Grammar()
    plain = lambda t: [[None if e is None else (e[0], str(e[1])) for e in row] for row in t]
    for s, got in zip(sequences, grammar.evaluate([bytes(s) for s in sequences])):
        want = dialogue._unit()
        for symbol in s:
            want = dialogue.product(want, dialogue.ROWS[symbol])
        assert plain(got) == plain(want)


def test_rules_replace_repeats():
    grammar = dialogue.Grammar()
    grammar.evaluate([bytes([2, 4] * 4096)])
    assert 10 < len(grammar.pairs) < 30


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text("DIK", max_size=40), min_size=1, max_size=6), st.lists(st.text("DIK", max_size=40), min_size=1, max_size=6))
def test_ropes_compare_as_texts(one, two):
    a, b = (sum((dialogue.Rope(x) for x in parts), dialogue.Rope()) for parts in (one, two))
    assert str(a) == "".join(one) and (a < b) == ("".join(one) < "".join(two))


def test_damage_follows_the_digest(spark):
    df = spark.createDataFrame([(c, t, "assistant", "A b. C?") for c in range(30) for t in range(3)], CHAT)
    got = dialogue.damaged(df).groupBy("conv_id", "turn").agg(F.count("*").alias("n"), F.min("role").alias("role"), F.min("text").alias("text")).collect()
    for r in got:
        d = zlib.crc32(f"{r.conv_id}:{r.turn}".encode()) % 20
        assert (r.n, r.role, r.text) == ((2 if d == 3 else 1), "user" if d == 4 else "assistant", {1: "", 2: "A b C"}.get(d, "A b. C?"))
