"""Operators of netprobe.llm against brute force, and on odd rows: nulls, empty and long texts, ties,
repeated rows, empty tables, extra columns whose names clash with the operators' own."""

from __future__ import annotations

import hashlib
import io
import math
import re
import struct
import zlib
from collections import Counter
from functools import cache

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from netprobe.llm import langid, licenses, lmscore, media, mixing, neardup, packing, quality, tokenfiles, tokens, urlfilter
from netprobe.llm import common

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n long, keys string, size long, word string, host string, score string, kept string, part string, comp string"
LONG = " ".join(f"w{i % 977}x{i % 13}" for i in range(60_000))
PROSE = "The cat sat on the mat and it was a very good day for the cat in the house by the sea."


def odd_rows() -> list[tuple]:
    extra = (1, "k", 2, "w", "h", "s", "x", "p", "c")
    texts = [None, "", " \n\t ", "one", "one", "a b c d", LONG, LONG + " end", PROSE, PROSE.upper() + "!", "é　ü \x1f x", "Licensed under the MIT License.", "123 456", PROSE + "\n" + PROSE]
    rows = [(i, t, None if i % 5 == 0 else "en", None if i % 4 == 0 else f"s{i % 3}", None) for i, t in enumerate(texts)]
    rows += [rows[8], (None, "nobody knows me", None, None, None)]
    return [(*r, *extra) for r in rows]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(odd):
    return odd.filter("false")


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text for r in docs.collect()}


def words(text):
    return WORD.findall((text or "").translate(LOWER))


# common

def test_word_hashes_follow_the_words():
    odd = ["", None, " a b", "a", "B a", "ab", "a\tb\x0bA", "x" * 700_000 + " a", "é a"]
    keys, begins = common.word_hashes(pa.array(odd))
    seen = {}
    for i, text in enumerate(odd):
        own = keys[begins[i] : begins[i + 1]]
        assert len(own) == len(words(text))
        for w, k in zip(words(text), own, strict=True):
            assert seen.setdefault(w, k) == k
    assert len(set(seen.values())) == len(seen)


# 1

def test_licences(odd, empty, spark):
    full = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee\nis hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
    more = [(100, full), (101, "Foo. Licensed under the Apache License, Version 2.0. You may not use this file except in compliance with the License."), (102, "A licence of our own."), (103, "All rights reserved. Released under the MIT License")]
    out = {r.doc_id: r for r in licenses.query(spark.createDataFrame(more, "doc_id long, text string")).collect()}
    assert [out[i].licenses for i in (100, 101, 102, 103)] == ["ISC", "Apache-2.0", "", "MIT,Proprietary"]
    assert out[102].n_unknown == 1 and out[101].n_sentences == 2
    got = licenses.query(odd).collect()
    assert len(got) == odd.count() and {r.licenses for r in got if r.doc_id == 11} == {"MIT"}
    assert licenses.query(empty).count() == 0
    assert all(any(c in s for c in licenses.CUES) for s in licenses.sentence_table())


APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0
"""
GPL3 = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.
"""
GPL2 = GPL3.replace("software:", "software;").replace("Foundation,", "Foundation;").replace("version 3", "version 2")


def test_standard_notices(spark):
    """As they are printed, wrapped or on one line, by the query and by its SQL."""
    notices = {"Apache-2.0": APACHE, "GPL-3.0": GPL3, "GPL-2.0": GPL2, "MIT": "# SPDX-License-Identifier: MIT", "BSD-3-Clause": "/* SPDX-License-Identifier: BSD-3-Clause */\nint x;"}
    rows = [(f"{name} {k}", text) for name, wrapped in notices.items() for k, text in enumerate((wrapped, " ".join(wrapped.split()) if name not in ("MIT", "BSD-3-Clause") else wrapped, "Some words.\n\n" + wrapped))]
    out = {r.doc_id: r for r in licenses.query(spark.createDataFrame(rows, "doc_id string, text string")).collect()}
    assert {k: r.licenses for k, r in out.items()} == {k: k.split(" ")[0] for k, _ in rows}
    documents = pd.DataFrame(rows, columns=["doc_id", "text"])  # noqa: F841
    want = duckdb.sql(licenses.ORACLE).df()
    assert {r.doc_id: (r.sentence_ids, r.licenses, r.n_sentences, r.n_unknown) for r in want.itertuples()} == {k: (r.sentence_ids, r.licenses, r.n_sentences, r.n_unknown) for k, r in out.items()}


BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions
are met:
1. Redistributions of source code must retain the above copyright
   notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright
   notice, this list of conditions and the following disclaimer in the
   documentation and/or other materials provided with the distribution.
"""
ADVERT = """3. All advertising materials mentioning features or use of this software
   must display the following acknowledgement:
   This product includes software developed by somebody.
"""
ENDORSE = """{}. Neither the name of the University nor the names of its contributors
   may be used to endorse or promote products derived from this software
   without specific prior written permission.
"""


def gnu(name, version, stop=";"):
    return f"""This library is free software; you can redistribute it and/or
modify it under the terms of the {name} as published by
the Free Software Foundation{stop} either version {version} of the License, or
(at your option) any later version.
"""


LESSER, AFFERO, GENERAL = "GNU Lesser General Public License", "GNU Affero General Public License", "GNU General Public License"
NOTICES = [
    *[(x, f"SPDX-License-Identifier: {y}") for x, y in [
        ("GPL-2.0", "GPL-2.0-only"), ("GPL-2.0", "GPL-2.0-or-later"), ("GPL-2.0", "GPL-2.0"), ("GPL-3.0", "GPL-3.0-or-later"), ("LGPL-2.1", "LGPL-2.1"),
        ("LGPL-3.0", "LGPL-3.0-only"), ("AGPL-3.0", "AGPL-3.0-or-later"), ("Apache-2.0,MIT", "Apache-2.0 OR MIT"), ("Apache-2.0,MIT", "(MIT AND Apache-2.0)"),
        ("GPL-2.0", "GPL-2.0-only WITH Classpath-exception-2.0"), ("GPL-2.0,MIT", "GPL-2.0-or-later OR MIT"), ("BSD-2-Clause,CC0-1.0", "BSD-2-Clause AND CC0-1.0"),
        ("BSL-1.0", "BSL-1.0"), ("MPL-2.0", "MPL-2.0"), ("Unlicense", "Unlicense"), ("0BSD", "0BSD"), ("Zlib", "Zlib"), ("EPL-2.0", "EPL-2.0"),
    ]],
    ("LGPL-2.1", gnu(LESSER, "2.1")), ("LGPL-3.0", gnu(LESSER, "3")), ("LGPL-2.1", gnu(LESSER, "2.1", ",")), ("LGPL-3.0", gnu(LESSER, "3", ",")),
    ("AGPL-3.0", gnu(AFFERO, "3")), ("AGPL-3.0", gnu(AFFERO, "3", ",")), ("GPL-2.0", gnu(GENERAL, "2", ",")), ("GPL-3.0", gnu(GENERAL, "3")),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify\nit under the terms of the GNU General Public License version 2 as\npublished by the Free Software Foundation."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL was not distributed with this\nfile, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0.\n(See accompanying file or copy at the given place)"),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("BSD-2-Clause", BSD), ("BSD-3-Clause", BSD + ENDORSE.format(3)), ("BSD-4-Clause", BSD + ADVERT + ENDORSE.format(4)),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007\n\nEveryone is permitted to copy"), ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE\n   Version 2, June 1991"),
    ("LGPL-2.1", "GNU LESSER GENERAL PUBLIC LICENSE\nVersion 2.1, February 1999"), ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE\nVersion 3, 19 November 2007"),
    ("Apache-2.0", "Apache License\nVersion 2.0, January 2004"), ("GPL-3.0", "Licensed under the GNU General Public License v3.0."),
    ("CC-BY-NC-SA-4.0", "This work is licensed under a Creative Commons\nAttribution-NonCommercial-ShareAlike 4.0 International License."),
    ("Zlib", "This software is provided 'as-is', without any express or implied\nwarranty.\n\nPermission is granted to anyone to use this software for any purpose,\nincluding commercial applications, and to alter it and redistribute it\nfreely, subject to the following restrictions:"),
]


def test_printed_notices(spark):
    """Plain, and in comments of two kinds, by the query and by its SQL."""
    marks = {"plain": lambda t: t, "stars": lambda t: "/*\n" + "".join(f" * {x}\n" for x in t.splitlines()) + " */", "hashes": lambda t: "".join(f"# {x}\n" for x in t.splitlines())}
    rows = [(f"{i} {m}", f(t)) for i, (_, t) in enumerate(NOTICES) for m, f in marks.items()]
    out = {r.doc_id: r for r in licenses.query(spark.createDataFrame(rows, "doc_id string, text string")).collect()}
    wrong = {k: (NOTICES[int(k.split()[0])][0], r.licenses, r.sentence_ids) for k, r in out.items() if r.licenses != NOTICES[int(k.split()[0])][0]}
    assert not wrong
    documents = pd.DataFrame(rows, columns=["doc_id", "text"])  # noqa: F841
    want = duckdb.sql(licenses.ORACLE).df()
    assert {r.doc_id: (r.sentence_ids, r.licenses, r.n_sentences, r.n_unknown) for r in want.itertuples()} == {k: (r.sentence_ids, r.licenses, r.n_sentences, r.n_unknown) for k, r in out.items()}


# 2

def test_languages(docs, odd, empty, spark):
    out = langid.query(docs).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    held = out[out.held_out]
    assert (held.lang_pred == held.lang).mean() > 0.95 and out.score.between(0, 1).all()
    assert (out.held_out == out.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 3 == 1)).all()
    got = langid.query(odd).collect()
    assert len(got) == odd.count() and not any(r.held_out is None or (r.doc_id is None and r.held_out) for r in got)
    assert {r.doc_id: r.lang_pred for r in got if r.doc_id in (0, 1, 2, 12)} == dict.fromkeys((0, 1, 2, 12), "und")
    assert langid.query(empty).count() == 0
    assert {r.lang_pred for r in langid.query(odd.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    kept = langid.filter_language(odd)
    assert kept.columns == odd.columns and kept.filter("doc_id = 8").count() == 2 and kept.filter("doc_id = 1").isEmpty()


def test_languages_are_filtered_by_row(docs):
    own = docs.withColumn("doc_id", F.lit(1).cast(docs.schema["doc_id"].dataType)).limit(200)
    bad = own.limit(2).withColumn("text", F.lit("123 456"))
    nameless = bad.withColumn("doc_id", F.lit(None).cast(docs.schema["doc_id"].dataType))
    kept = langid.filter_language(own.unionByName(bad).unionByName(nameless)).toPandas()
    assert len(kept) > 150 and not (kept.text == "123 456").any() and kept.doc_id.notna().all()


def test_copies_and_dirty_labels_do_not_starve_the_sample(docs, spark, monkeypatch):
    own = docs.select("doc_id", "text", "lang")
    copies = spark.range(30_000).select(F.col("id").alias("doc_id"), F.lit(PROSE).alias("text"), F.lit("en").alias("lang"))
    langs, sample = langid.training_sample(own.filter("lang IS NOT NULL AND text IS NOT NULL"))
    more, bigger = langid.training_sample(own.filter("lang IS NOT NULL AND text IS NOT NULL").unionByName(copies))
    assert more == langs and len(langs) > 1
    assert bigger.exceptAll(sample).distinct().count() <= 1 and sample.exceptAll(bigger).isEmpty()
    monkeypatch.setattr(langid, "MAX_TRAIN", 40)
    assert set(langid.training_sample(own.filter("lang IS NOT NULL AND text IS NOT NULL"))[1].toPandas().lang) == set(langs)
    monkeypatch.setattr(langid, "MAX_LANGS", 3)
    dirty = spark.range(300).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"), F.concat(F.lit("x"), "id").alias("lang"))
    assert set(langid.training_sample(own.filter("lang IS NOT NULL AND text IS NOT NULL").unionByName(dirty))[0]) <= set(langs)


def test_leader_follows_the_formulas():
    """A pass against the published per-coordinate updates, written plainly."""
    rng = np.random.default_rng(4)
    rows = [(np.sort(rng.choice(20, 5, replace=False)), rng.random(5), int(rng.integers(3))) for _ in range(60)]
    z, n = np.zeros((21, 3)), np.zeros((21, 3))
    langid.ftrl_pass(z, n, rows)
    zs, ns = Counter(), Counter()

    def weight(k):
        if abs(zs[k]) <= langid.L1:
            return 0.0
        return -(zs[k] - math.copysign(langid.L1, zs[k])) / ((langid.BETA + math.sqrt(ns[k])) / langid.ALPHA + langid.L2)

    for found, value, label in rows:
        x = {**dict(zip(found.tolist(), value.tolist(), strict=True)), 20: 1.0}
        w = {(i, c): weight((i, c)) for i in x for c in range(3)}
        e = [math.exp(sum(w[i, c] * v for i, v in x.items())) for c in range(3)]
        for i, v in x.items():
            for c in range(3):
                g = v * (e[c] / sum(e) - (c == label))
                zs[i, c] += g - (math.sqrt(ns[i, c] + g * g) - math.sqrt(ns[i, c])) / langid.ALPHA * w[i, c]
                ns[i, c] += g * g
    assert np.allclose(z, [[zs[i, c] for c in range(3)] for i in range(21)])
    assert np.allclose(langid.ftrl_weights(z, n), [[weight((i, c)) for c in range(3)] for i in range(21)])


def test_temperature_is_that_of_least_loss():
    rng = np.random.default_rng(0)
    logits = rng.normal(size=(4000, 3)) * 2
    p = np.exp(logits) / np.exp(logits).sum(axis=1, keepdims=True)
    labels = np.array([rng.choice(3, p=x) for x in p])
    assert langid.fit_temperature(logits * 4, labels) == pytest.approx(4, rel=0.1)


# 3 and 9

@cache
def untouched():
    return Tokenizer.from_file(tokens.vocabulary_path())


def reference_ids(text):
    return untouched().encode(text or "", add_special_tokens=False).ids


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=" \n\t\r\x0b\x1f\x85\xa0　aB1.,'sé漢🙂_-|ŁŽ½²", max_size=30), max_size=5))
def test_encoder_equals_the_tokenizer(some):
    ids, begins = tokens.encoder(tokens.vocabulary_path()).encode(pa.array(some, pa.string()))
    assert [ids[b:e].tolist() for b, e in zip(begins[:-1], begins[1:], strict=True)] == [reference_ids(t) for t in some]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 99_999), max_size=300), st.sampled_from([17, 18, 24, 32]))
def test_bits_round_trip(ids, bits):
    assert tokenfiles.unpack_bits(tokenfiles.pack_bits(np.array(ids, np.uint32), bits), len(ids), bits).tolist() == ids


@pytest.mark.parametrize("which", ["docs", "odd"])
def test_token_files(which, request, spark, tmp_path):
    df = request.getfixturevalue(which)
    files = tokenfiles.write_files(df, str(tmp_path / "ids"))
    out = tokenfiles.read_files(files).toPandas().sort_values("start")
    own = df.select("doc_id", "text").toPandas()
    left = Counter((None if pd.isna(i) else int(i), tuple([*reference_ids(t), 2])) for i, t in zip(own.doc_id, own.text, strict=True))
    reader = None
    start = 0
    sums = Counter((i, len(t), zlib.crc32(np.array(t, "<u4"))) for i, t in left.elements())
    assert sums == Counter((None if pd.isna(i) else int(i), n, c) for i, n, c in zip(out.doc_id, out.n_tokens, out.ids_crc32, strict=True))
    for s, n in zip(out.start, out.n_tokens, strict=True):
        assert s == start
        start += n
    assert out.doc_id.dropna().is_monotonic_increasing
    reader = tokenfiles.Reader(files.orderBy("part").first().file)
    assert reader.document(len(reader.docs) - 1)[-1] == 2
    assert tokenfiles.query(df.filter("false")).count() == 0


@pytest.mark.parametrize("which", ["docs", "odd"])
def test_packing(which, request):
    df = request.getfixturevalue(which)
    out = packing.pack(df, with_ids=True).toPandas()
    for _, g in out.sort_values("offset").groupby("sequence_id"):
        assert g.offset.tolist() == [0, *np.cumsum(g.length)[:-1]]
        total = int(g.length.sum())
        assert total <= 1024 and total & (total - 1) == 0
    own = df.select("doc_id", "text").toPandas()
    want = Counter()
    for i, t in zip(own.doc_id, own.text, strict=True):
        want[None if pd.isna(i) else int(i)] += len(reference_ids(t)) + 1
    got = Counter()
    for r in out.itertuples():
        got[None if pd.isna(r.doc_id) else int(r.doc_id)] += r.length
        assert zlib.crc32(r.ids) == r.ids_crc32
    assert got == want
    if which == "docs":
        texts = dict(zip(own.doc_id, own.text, strict=True))
        for i, g in out.sort_values("start").groupby("doc_id"):
            assert np.frombuffer(b"".join(g.ids), "<u4").tolist() == [*reference_ids(texts[i]), 0]
    assert packing.pack(df.filter("false")).count() == 0


def test_strings_of_special_tokens_are_their_ids():
    some = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|>y  <|endoftext|>\n z"]
    ids, begins = tokens.encoder(tokens.vocabulary_path()).encode(pa.array(some))
    assert ids[begins[0] : begins[1]].tolist() == [64, 220, 50256, 275]
    assert [ids[b:e].tolist() for b, e in zip(begins[:-1], begins[1:], strict=True)] == [reference_ids(t) for t in some]


def test_table_of_parts_is_bounded(monkeypatch):
    monkeypatch.setattr(tokens, "MOST_IDS", 500)
    own = tokens.Encoder(tokens.vocabulary_path())
    for k in range(6):
        some = ["q" * 3000 + f" {k}", " ".join(f"w{k}x{i}" for i in range(400))]
        ids, begins = own.encode(pa.array(some))
        assert [ids[b:e].tolist() for b, e in zip(begins[:-1], begins[1:], strict=True)] == [reference_ids(t) for t in some]
        assert own.n_ids < 6000 and all(len(p) <= tokens.LONGEST_PART for p in own.plain)


def plain_bm25(units, seed, n, mean, df):
    """By the formula, a term of the seed at a time."""
    out = []
    for unit in units:
        tf = Counter(unit.tolist())
        idf = {t: math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) for t in set(units[seed].tolist())}
        norm = packing.K1 * (1 - packing.B + packing.B * len(unit) / mean)
        out.append(sum(idf[t] * tf[t] * (packing.K1 + 1) / (tf[t] + norm) for t in idf))
    return out


def random_units(rng, n=60):
    return [np.minimum(rng.zipf(1.3, rng.integers(1, 200)), 5000).astype(np.uint16) for _ in range(n)]


def laid_out(units):
    return np.concatenate(units), np.concatenate([[0], np.cumsum([len(u) for u in units])])


def test_scores_are_bm25_over_all_terms():
    units = random_units(np.random.default_rng(1))
    df = Counter(t for u in units for t in set(u.tolist()))
    index = packing.Index(*laid_out(units))
    for seed in range(len(units)):
        assert index.scores(seed) == pytest.approx(plain_bm25(units, seed, len(units), np.mean([len(u) for u in units]), df), abs=1e-8)


def test_windows_take_the_best_unused_units():
    """Against a greedy fill written plainly."""
    units = random_units(np.random.default_rng(2))
    index = packing.Index(*laid_out(units))
    left, got, seed = {i: len(u) for i, u in enumerate(units)}, [], 0
    while left:
        space, window = 256, []
        scores = index.scores(seed)
        queue = [seed, *sorted((i for i in left if i != seed), key=lambda i: (-scores[i], i))]
        for i in queue:
            take = min(space, left[i])
            begin = len(units[i]) - left[i]
            window.append((i, begin, begin + take))
            space -= take
            left[i] -= take
            if not left[i]:
                del left[i]
            if not space:
                break
        got.append(window)
        seed = window[-1][0] if window[-1][0] in left else min(left, default=None)
    assert got == list(packing.fill(np.array([len(u) for u in units]), index, 256))


def test_documents_are_routed_by_their_most_telling_terms():
    units = random_units(np.random.default_rng(3), 40)
    n, mean = len(units), np.mean([len(u) for u in units])
    df = np.bincount([t for u in units for t in set(u.tolist())], minlength=5001)
    found = packing.routes(*laid_out(units), packing.Corpus(n, mean, df))
    for i, u in enumerate(units):
        tf = Counter(u.tolist())
        weight = {t: packing.Corpus(n, mean, df).weight(np.array([t]), np.array([c]), np.array([len(u)]))[0] for t, c in tf.items() if df[t] > 1}
        want = sorted(weight, key=lambda t: (-weight[t], t))[: packing.ROUTE_TERMS]
        assert [t for t in found[i].tolist() if t >= 0] == want


def test_few_sequences_are_short(docs, spark):
    """However many partitions there are, a task's last window alone is cut."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "50")
    lengths = packing.pack(docs).groupBy("sequence_id").agg(F.sum("length").alias("n")).toPandas().n
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert (lengths < 1024).sum() <= 10 and len(lengths) > 100


def test_neighbours_meet_wherever_they_are_stored(spark, monkeypatch):
    monkeypatch.setattr(packing, "SHARD_DOCS", 8)
    topics = [f"{a}{b} " * 12 for a in ("zebra", "quartz", "violin", "harbor") for b in ("ish", "ness")]
    rows = [(i, topics[i % 8] + f"the and of number {i}") for i in range(64)]  # each topic spread over the table
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4, "doc_id")
    out = packing.pack(df, window=128).toPandas()
    groups = [set(g.doc_id % 8 // 2) for _, g in out.groupby("sequence_id") if g.doc_id.nunique() > 1]
    assert len(groups) > 4 and sum(map(len, groups)) / len(groups) < 2


def test_units_are_found_by_the_whole_document():
    rng = np.random.default_rng(2)
    body = rng.integers(100, 5000, 1024)
    texts = [np.append(body, [7, 8]), np.append(rng.integers(6000, 9000, 1024), [7, 9]), np.append(body, [10, 11])]
    first = next(packing.fill(np.array([len(t) - 1024 for t in texts]), packing.Index(*laid_out(texts)), 4))
    assert [u for u, _, _ in first] == [0, 2]


# 4

def check_scores(df, out):
    own = df.select("doc_id", "text").toPandas()
    split = {i: [*words(t), "\n"] for i, t in zip(own.doc_id, own.text, strict=True)}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in split}
    count = Counter(w for i, ws in split.items() if not held[i] for w in ws)
    n, v = sum(count.values()), len(count)
    for r in out.itertuples():
        ws = split[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(ws), sum(count[w] > 0 for w in ws), n, held[r.doc_id])
        assert r.base_score == pytest.approx(sum(math.log10((count[w] + 1) / (n + v + 1)) for w in ws), rel=1e-9)
        assert math.isfinite(r.score) and r.score < 0
    return out


def test_scores(docs, monkeypatch):
    monkeypatch.setattr(lmscore, "HOT", 300)  # most words take the way of the joined counts
    out = check_scores(docs, lmscore.query(docs).toPandas())
    held = out[out.held_out]
    assert held.score.sum() > held.base_score.sum()


def test_scores_of_odd_rows(odd, empty):
    out = lmscore.query(odd).toPandas()
    assert len(out) == odd.count() and out.score.notna().all() and (out[out.doc_id.isin([0, 1, 2])].n_tokens == 1).all()
    assert out.held_out.notna().all() and not out[out.doc_id.isna()].held_out.any()
    unique = odd.filter("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    check_scores(unique, lmscore.query(unique).toPandas())
    assert lmscore.query(empty).count() == 0


def segment_of(keys, counts, kind, buckets=1):
    merged = lmscore._merge(buckets)(pd.DataFrame({"kind": [kind], "bucket": [0], "keys": [keys.tobytes()], "counts": [counts.astype(np.uint32).tobytes()]}))
    return lmscore.Model(1, "", keys[:0], counts[:0], 1, 1, {(kind, 0): np.frombuffer(merged.segment[0], np.uint8)})


@pytest.mark.parametrize("kind", [lmscore.WORD, lmscore.PAIR])
def test_filter_gives_counts_back_within_a_level(kind):
    keys, counts = common.stream64(2000, 5), np.arange(1, 2001)
    model = segment_of(keys, counts, kind)
    levels = model.levels(keys, kind)
    assert (levels == lmscore.quantised(counts, kind)).mean() > 0.98
    assert (model.levels(common.stream64(2000, 6), kind) > 0).mean() < 0.05
    every = np.arange(1, 100_000)
    exact = lmscore.quantised(every, kind)
    assert (lmscore.least_count(exact, kind) <= every).all() and (lmscore.most_count(exact, kind) >= every).all()


def plain_log10(train, words_of_text):
    """The smoothed log10 probability of a text from exact counts, cut to their levels' bounds."""
    count = Counter(w for t in train for w in t)
    pair = Counter((v, w) for t in train for v, w in zip(["\n", *t[:-1]], t, strict=True))
    n, v = sum(count.values()), len(count)

    def least(c, kind):
        return float(lmscore.least_count(lmscore.quantised(np.array([c]), kind), kind)[0]) if c else 0.0

    def most(c):
        return float(lmscore.most_count(lmscore.quantised(np.array([c]), lmscore.WORD), lmscore.WORD)[0]) if c else 0.0

    def probability(w, before):
        single = (least(count[w], lmscore.WORD) + 1) / (n + v + 1)
        return (least(pair[before, w], lmscore.PAIR) + lmscore.PRIOR * single) / (most(count[before]) + lmscore.PRIOR)

    return probability, count, sum(math.log10(probability(w, b)) for b, w in zip(["\n", *words_of_text[:-1]], words_of_text, strict=True))


def test_scores_follow_the_formula(docs):
    """Against exact counts; what the filter holds by mistake may raise a few scores a little."""
    split = {r.doc_id: [*words(r.text), "\n"] for r in docs.select("doc_id", "text").collect()}
    train = [t for i, t in split.items() if zlib.crc32(str(i).encode()) % 7 != 2]
    out = lmscore.query(docs).toPandas().set_index("doc_id").score
    want = pd.Series({i: plain_log10(train, split[i])[2] for i in list(split)[:25]})
    off = (out[want.index] - want).abs() / want.abs()
    assert off.median() < 0.005 and off.max() < 0.03


def test_probabilities_sum_to_one_at_most(spark):
    train = [["a", "b", "\n"], ["a", "b", "a", "\n"], ["a", "\n"], ["\n"], ["c"] * 9 + ["\n"]]
    for before in ("a", "b", "c", "\n", "never"):
        probability, count, _ = plain_log10(train, ["\n"])
        assert sum(probability(w, before) for w in [*count, "unknown"]) <= 1
    for n in (1, 4, 8, 64, 1024):  # nothing but ends
        rows = spark.range(1, n + 1).select(F.col("id").alias("doc_id"), F.lit("").alias("text"))
        assert lmscore.query(rows).filter("score > 0 OR held_out IS NULL").isEmpty()


def test_no_sequence_is_left_out_of_the_filter(docs, monkeypatch):
    keys = common.stream64(2000, 5)
    for kind in (lmscore.WORD, lmscore.PAIR):  # one of very many buckets, full of sequences seen once
        assert (segment_of(keys, np.ones(2000), kind, 1 << 20).levels(keys, kind) > 0).all()
    monkeypatch.setattr(lmscore, "BUCKET_BYTES", 10_000)
    train = docs.filter(lmscore.training(F.col("doc_id")))
    model, _ = lmscore.fit(train)
    own, _ = lmscore.tokens(pa.array([r.text for r in train.select("text").collect()]))
    for kind, found in ((lmscore.WORD, own), (lmscore.PAIR, lmscore.pairs_of(own))):
        found, counts = np.unique(found, return_counts=True)
        levels = model.levels(found, kind)
        assert (levels >= lmscore.quantised(counts, kind)).all() and (levels == lmscore.quantised(counts, kind)).mean() > 0.93


# 5

def brute_targets(sizes):
    names = sorted(n for n in sizes if n is not None) + [None] * (None in sizes)
    weight = {n: (3, 1, 2)[i % 3] for i, n in enumerate(names)}
    total, fixed = 1.5 * sum(sizes.values()), {}
    while True:
        free = [n for n in names if n not in fixed]
        if not free:
            return fixed
        level = (total - sum(fixed.values())) / sum(weight[n] for n in free)
        over = [n for n in free if level * weight[n] > 2 * sizes[n]]
        if not over:
            return fixed | {n: level * weight[n] for n in free}
        fixed |= {n: 2.0 * sizes[n] for n in over}


@pytest.mark.parametrize("which", ["docs", "odd"])
def test_mixing(which, request):
    df = request.getfixturevalue(which)
    out = mixing.query(df).toPandas()
    own = df.select("doc_id", "text", "source").toPandas()
    own["size"] = [len(words(t)) for t in own.text]
    sizes = {None if pd.isna(k) else k: int(n) for k, n in own.groupby("source", dropna=False)["size"].sum().items()}
    target = brute_targets(sizes)
    assert sorted(out["size"]) == sorted(own["size"]) and (out.taken <= 2 * out["size"]).all()
    by_size = out.groupby(["source_size", "target"]).taken.sum()
    for (size, goal), taken in by_size.items():
        assert any(math.isclose(goal, t, abs_tol=1e-6) and sizes[n] == size for n, t in target.items())
        assert abs(taken - goal) <= 2 * mixing.BLOCK_WORDS + mixing.TOLERANCE * goal
    again = mixing.query(df).toPandas()
    key = ["doc_id", "size", "taken"]
    assert out.sort_values(key)[key].reset_index(drop=True).equals(again.sort_values(key)[key].reset_index(drop=True))
    assert mixing.query(df.filter("false")).count() == 0


def test_mixed_texts_hold_the_taken_words(docs, odd):
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    got = mixed.toPandas()
    counts = got.text.map(lambda t: len(words(t))).groupby(got.doc_id).sum()
    taken = mixing.query(docs).toPandas().set_index("doc_id").taken
    assert counts.to_dict() == taken[taken > 0].to_dict()
    assert mixing.mix(odd).columns == odd.columns


def spark_hash(*values):
    """xxhash64 of Spark: each value's hash seeds the next; nulls are passed over. Python ints are longs, np.int32 are ints."""
    h = 42
    for v in values:
        if v is not None:
            raw = v.encode() if isinstance(v, str) else struct.pack("<i", v) if isinstance(v, np.int32 | bool) else struct.pack("<q", v)
            h = xxhash.xxh64_intdigest(raw, seed=h)
    return h - (1 << 64) if h >> 63 else h


def plain_permutation(x, n, key):
    for r in range(mixing.ROUNDS):
        pair = (spark_hash(np.int32(r), key) % n - x) % n
        if spark_hash(np.int32(mixing.ROUNDS + r), key, max(x, pair)) < 0:
            x = pair
    return x


@pytest.mark.parametrize("n", [1, 2, 3, 7, 64, 1000])
def test_block_permutation(n, spark):
    rows = mixing.permuted(spark.range(n).select(F.col("id").alias("x"), "id", F.lit(n).cast("long").alias("n"), F.lit(99).cast("long").alias("key")), "x", "n", "key").collect()
    assert sorted(r.x for r in rows) == list(range(n))
    assert all(r.x == plain_permutation(r.id, n, 99) for r in rows)
    assert n < 64 or len({r.x - r.id for r in rows}) > n // 4  # no arithmetic progression


def plain_mix(own, counts, targets):
    """{row: words taken}, {shard and source: blocks}, in plain Python from the drawn counts."""
    taken, placed = Counter(), Counter()
    for name in set(own.skey):
        rows = own[own.skey == name]
        n_blocks = -(-int(rows["size"].sum()) // mixing.BLOCK_WORDS)
        if not n_blocks:
            continue
        quota = min(2 * n_blocks, round(targets[name] * n_blocks / rows["size"].sum()))
        runs = sorted((s, n) for s, k, n in counts if k == name)
        drawn = sum(n for _, n in runs)
        slack = math.ceil(quota * mixing.TOLERANCE)
        total = min(max(drawn, quota - slack), quota + slack, 2 * n_blocks)
        scaled = lambda x: total if x >= drawn else math.floor(x * (total / drawn))  # noqa: B023, E731
        used, first = Counter(), 0
        for shard, n in runs:
            for j in range(scaled(first), scaled(first + n)):
                used[plain_permutation(j % n_blocks, n_blocks, spark_hash(np.int32(mixing.SEED), name, j // n_blocks))] += 1
                placed[shard, name] += 1
            first += n
        off = 0
        for r in rows.sort_values("order").itertuples():
            taken[r.Index] = sum(used[w // mixing.BLOCK_WORDS] for w in range(off, off + r.size))
            off += r.size
    return taken, placed


def test_taken_words_follow_the_drawn_counts(docs, spark, monkeypatch):
    monkeypatch.setattr(mixing, "SLOTS_PER_SHARD", 64)
    own = docs.select("doc_id", "source", "text").toPandas()
    own["size"] = [len(words(t)) for t in own.text]
    own["skey"] = ["z" if s is None else "s" + s for s in own.source]
    own["order"] = [spark_hash(np.int32(mixing.SEED), int(d), False, s, s is None, t, t is None) for d, s, t in zip(own.doc_id, own.source, own.text, strict=True)]
    sources = mixing.source_targets(spark.createDataFrame(own[["skey", "size"]]))
    targets = {r.skey: r.target for r in sources.collect()}
    counts = [tuple(r) for r in mixing.draw_counts(sources).select("shard", "skey", "n").collect()]
    assert all(n == 64 for n in pd.DataFrame(counts).groupby(0)[2].sum().sort_index()[:-1])  # full shards
    want, placed = plain_mix(own, counts, targets)
    out = mixing.query(docs).toPandas().set_index("doc_id")
    assert {d: want[i] for i, d in own.doc_id.items()} == out.taken.to_dict()
    rows = mixing.takes(sources).toPandas()
    assert Counter(rows.groupby(["shard", "skey"]).size().to_dict()) == placed
    for _, g in rows.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))
    # other draws take other blocks, in other shards
    even = spark.createDataFrame([(s, k, 9) for s in range(40) for k in targets], "shard long, skey string, n long")
    monkeypatch.setattr(mixing, "draw_counts", lambda _: even)
    other = mixing.query(docs).toPandas().set_index("doc_id")
    assert (other.taken != out.taken).any() and (other.first_shard.fillna(-1) != out.first_shard.fillna(-1)).mean() > 0.3


def test_mix_keeps_columns_named_like_its_own(docs, spark):
    extra = docs.withColumns({"size": F.lit(-7), "skey": F.concat(F.lit("k"), "doc_id"), "_all": F.lit("a"), "mix_slot": F.lit(5), "takes": F.array(F.lit(1))})
    twice = extra.unionByName(extra.filter("doc_id % 7 = 0")).unionByName(extra.filter("doc_id % 3 = 0").withColumn("doc_id", F.lit(None).cast("long")))
    got = mixing.mix(twice).toPandas()
    assert (got["size"] == -7).all() and (got._all == "a").all() and (got.mix_slot == 5).all()
    named = got[got.doc_id.notna()]
    assert (named.skey == "k" + named.doc_id.astype(int).astype(str)).all() and got.doc_id.isna().sum() > 10
    taken = mixing.query(twice).toPandas()
    assert taken.taken.sum() == sum(len(words(t)) for t in got.text) and len(taken) == twice.count()
    placed = mixing.mix(docs, placed=True)
    assert placed.columns == [*docs.columns, "mix_shard", "mix_slot"] and placed.filter("mix_shard IS NULL OR mix_slot IS NULL").isEmpty()


# 6

def brute_repeats(ws):
    windows = Counter(tuple(ws[i : i + 8]) for i in range(len(ws) - 7))
    inside = set()
    for i in range(len(ws) - 7):
        if windows[tuple(ws[i : i + 8])] > 1:
            inside.update(range(i, i + 8))
    return len(inside)


@pytest.mark.parametrize("which", ["docs", "odd"])
def test_quality(which, request):
    df = request.getfixturevalue(which)
    out = quality.query(df).toPandas()
    own = {(None if pd.isna(i) else int(i)): t or "" for i, t in df.select("doc_id", "text").toPandas().itertuples(index=False)}
    assert len(out) == df.count()
    for r in out.itertuples():
        text = own[None if pd.isna(r.doc_id) else int(r.doc_id)]
        ws = WORD.findall(text)
        lines = [x for x in text.split("\n") if WORD.search(x)]
        want = (len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), brute_repeats(ws))
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0]) and not (r.base_failed and r.kept)
    kept = quality.filter_quality(df)
    assert kept.columns == df.columns and kept.count() == int(out.kept.sum())
    assert quality.query(df.filter("false")).count() == 0


# 7

def bmp(grid, bits):
    height, width = grid.shape[:2]
    if bits == 8:
        table = b"".join(bytes((i, i, i, 0)) for i in range(256))
        body = b"".join(r.tobytes().ljust((width + 3) // 4 * 4, b"\0") for r in grid[::-1])
    else:
        table = b""
        body = b"".join(r[:, ::-1].tobytes().ljust((width * 3 + 3) // 4 * 4, b"\0") for r in grid[::-1])
    at = 54 + len(table)
    return b"BM" + struct.pack("<IHHI", at + len(body), 0, 0, at) + struct.pack("<IiiHHIIiiII", 40, width, height, 1, bits, 0, len(body), 0, 0, 0, 0) + table + body


def test_images():
    rng = np.random.default_rng(3)
    grey, colour = rng.integers(0, 256, (5, 7), dtype=np.uint8), rng.integers(0, 256, (5, 7, 3), dtype=np.uint8)
    assert np.array_equal(media.decode(media.encode_pgm(grey)), grey)
    assert np.array_equal(media.decode(b"P6 # a note\n7 5\n255\n" + colour.tobytes()), colour)
    assert np.array_equal(media.decode(b"P2\n7 5\n255\n" + " ".join(map(str, grey.ravel())).encode()), grey)
    assert np.array_equal(media.decode(b"P1\n3 1\n1 0 1\n"), [[0, 255, 0]])
    assert np.array_equal(media.decode(b"P4\n3 1\n" + bytes([0b10100000])), [[0, 255, 0]])
    assert np.array_equal(media.decode(bmp(colour, 24)), colour)
    assert np.array_equal(media.decode(bmp(grey, 8))[..., 0], grey)
    for bad in (None, b"", b"P5\n7 5\n255\nxx", b"GIF89a", b"BM", b"P5 0 3 255\n"):
        assert media.decode(bad) is None
    big = rng.integers(0, 256, (12, 18), dtype=np.uint8)
    assert np.allclose(media.area_resize(big, 4, 6), big.reshape(4, 3, 6, 3).mean(axis=(1, 3)))
    assert media.area_resize(big, 5, 7).mean() == pytest.approx(big.mean())


def plain_resize(image, height, width):
    """Area by area, pixel by pixel."""
    out = np.zeros((height, width))
    for i in range(height):
        for j in range(width):
            top, bottom, left, right = i * image.shape[0] / height, (i + 1) * image.shape[0] / height, j * image.shape[1] / width, (j + 1) * image.shape[1] / width
            for y in range(int(top), min(image.shape[0], math.ceil(bottom))):
                for x in range(int(left), min(image.shape[1], math.ceil(right))):
                    out[i, j] += image[y, x] * (min(bottom, y + 1) - max(top, y)) * (min(right, x + 1) - max(left, x))
    return out * height * width / image.size


def test_resizing_in_bands(monkeypatch):
    monkeypatch.setattr(media, "BAND", 40)
    rng = np.random.default_rng(8)
    for shape in ((1, 1), (3, 50), (70, 64), (2, 64), (33, 9)):
        image = rng.integers(0, 256, shape, dtype=np.uint8)
        for to in ((8, 9), (4, 3), (1, 1)):
            assert np.allclose(media.area_resize(image, *to), plain_resize(image, *to))


@settings(max_examples=300, deadline=None)
@given(st.sampled_from([b"P1 ", b"P2 ", b"P3 ", b"P4 ", b"P5 ", b"P6 ", b"BM", b""]), st.binary(max_size=80), st.text("0123456789 \n#-xP", max_size=30))
def test_no_bytes_break_the_decoder(head, raw, text):
    for data in (head + raw, head + text.encode() + b" " + raw, bmp(np.zeros((2, 2), np.uint8), 8)[: 54 + len(raw)] + raw):
        image = media.decode(data)
        assert image is None or image.size


def test_malformed_images():
    for bad in (b"P2\n2 1\n255\nab cd", b"P2\n1 1\n255\n99999999999999999999", b"P5\n3037000500 3037000500\n255\nx", b"P2 2 1 255 -5 300", b"P2 1 1 9 10", b"P1 2 1 0 7", b"P5 " + b"9" * 5000 + b" 1 255 x"):
        assert media.decode(bad) is None
    palette = bmp(np.zeros((1, 4), np.uint8), 8)
    cut = palette[:46] + struct.pack("<II", 256, 0) + palette[54:61]  # the palette ends inside a colour
    assert media.decode(cut[:10] + struct.pack("<I", 50) + cut[14:]) is None or media.decode(cut[:10] + struct.pack("<I", 50) + cut[14:]).size


def test_media_features_and_stored_forms(docs, spark):
    out = media.query(docs).toPandas().set_index("doc_id")
    texts = docs.filter("length(text) < 3000").limit(20).collect()
    for r in texts:
        raw = (r.text or "").encode()
        grid = np.frombuffer(raw.ljust(max(1, -(-len(raw) // 64)) * 64, b"\0"), np.uint8).reshape(-1, 64)
        stored = b"P5\n64 %d\n255\n" % len(grid) + grid.tobytes()
        small = np.round(plain_resize(grid, 8, 9), 6)
        own = out.loc[r.doc_id]
        assert (own.media_bytes, own.media_sha256) == (len(stored), hashlib.sha256(stored).hexdigest())
        assert own.feature == np.packbits(small[:, :-1] < small[:, 1:]).tobytes().hex()
        assert own.tile_sha256 == hashlib.sha256(media.npy_tile(grid)).hexdigest()  # read back
    more = spark.createDataFrame([(1, media.encode_pgm(np.full((4, 4), 9, np.uint8)), 7, "x"), (2, b"?", 8, "y")], "id int, media binary, width int, other string")
    got = {r.id: r for r in media.add_tiles(more, side=2).collect()}
    tile = np.load(io.BytesIO(got[1].tile))
    assert (got[1].width, got[1].height, got[1].other) == (4, 4, "x") and tile.tolist() == [[9, 9], [9, 9]] and got[2].tile is None and got[2].width is None


@pytest.mark.parametrize("which", ["docs", "odd"])
def test_media(which, request):
    df = request.getfixturevalue(which)
    out = media.query(df).toPandas()
    own = Counter()
    for i, t in df.select("doc_id", "text").toPandas().itertuples(index=False):
        raw = (t or "").encode()
        payload = raw.ljust(max(1, -(-len(raw) // 64)) * 64, b"\0")
        own[(None if pd.isna(i) else int(i), len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))] += 1
    assert own == Counter((None if pd.isna(r.doc_id) else int(r.doc_id), r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in out.itertuples())
    assert media.query(df.filter("false")).count() == 0


# 8

def test_urls(spark, tmp_path):
    urls = [None, "", "example.net/en/", "http://net", "http://net/", "http://EXAMPLE.net/en/x?y", "http://a.example.net/en", "http://b.example.com/de/1#z", "http://example.com/fr/", "http://x.org/fr/", "http://x.org/fr", "http://notnet/", "ftp://u@example.net:80/en/", "http://a.net?/en/", "x://y://net/", "http://.net/", "http://" + "a." * 100_000 + "net/", "http://" + "example." * 50_000 + "com/de/"] * 2
    rows = spark.createDataFrame([(i, u, "h", "p", "r") for i, u in enumerate(urls)], "page_id long, url string, host string, path string, rule string").repartition(2)

    def brute(url):
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = host.translate(LOWER)
        fit = [(len(r), r, v) for r, v in urlfilter.RULES for h, _, p in [r.partition("/")] if (host == h or host.endswith("." + h)) and path.startswith("/" + p)]
        return (host, path, *(max(fit)[1:] if fit else (None, "allow")))

    index = urlfilter.build_index(spark.createDataFrame(urlfilter.RULES, "rule string, verdict string"), str(tmp_path / "index"))
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urlfilter.judge(rows, index).collect()}
    assert got == {i: brute(u) for i, u in enumerate(urls)}
    many = [(f"d{i}.example/", "block") for i in range(500)] + [("x.example/", "allow"), ("x.example/", "block"), (None, "block")]
    parted = urlfilter.build_index(spark.createDataFrame(many, "rule string, verdict string"), str(tmp_path / "many"), parts=4)
    pages = spark.createDataFrame([(i, f"http://d{i}.example/") for i in range(0, 600, 7)] + [(-1, "http://x.example/")], "page_id long, url string")
    verdicts = {r.page_id: r.verdict for r in urlfilter.judge(pages, parted).collect()}
    assert verdicts == {i: "block" if i < 500 else "allow" for i in range(0, 600, 7)} | {-1: "block" if max("allow", "block") == "block" else "allow"}
    spans = sorted((r["first"], r["last"]) for r in parted.collect())
    assert len(spans) == 4 and all(a[1] < b[0] for a, b in zip(spans, spans[1:], strict=False))  # dealt by digest range
    assert sum(len(urlfilter._open(r.part)["keys"]) for r in parted.collect()) == 501
    assert all(np.array_equal(k := urlfilter._open(r.part)["keys"], np.sort(k)) for r in parted.collect())
    nothing = urlfilter.build_index(spark.createDataFrame([], "rule string, verdict string"), str(tmp_path / "none"))
    assert {r.verdict for r in urlfilter.judge(pages, nothing).collect()} == {"allow"}
    assert urlfilter.judge(pages.filter("false"), index).count() == 0


def test_colliding_digests_do_not_decide():
    names = [b"a/", b"b/"]
    part = {"keys": np.array([5, 5], np.uint64), "ends": np.array([2, 4]), "text": np.frombuffer(b"".join(names), np.uint8)}
    assert urlfilter._probe(part, np.array([5, 5, 5], np.uint64), ["b/", "c/", "a/"]).tolist() == [1, -1, 0]


# 10

def shingles(text):
    ws = words(text)
    return {tuple(ws[i : i + 5]) for i in range(len(ws) - 4)} if len(ws) >= 5 else ({tuple(ws)} if ws else set())


def brute_components(texts):
    sets = {i: shingles(t) for i, t in texts.items()}
    label = {i: i for i in texts}
    ids = sorted(texts)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    return sets, label


def check_components(out, texts):
    sets, label = brute_components(texts)
    for r in out.itertuples():
        assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), label[r.doc_id], label[r.doc_id] == r.doc_id), r


def test_near_duplicates(docs, texts):
    check_components(neardup.query(docs).toPandas(), texts)


def test_no_link_is_lost_at_a_larger_size(spark, sf_dir):
    """All links among a thousand documents, by an inverted index of their shingles."""
    own = spark.read.parquet(f"{sf_dir.replace('sf0.001', 'sf0.01')}/documents.parquet")
    sets = {r.doc_id: shingles(r.text) for r in own.select("doc_id", "text").collect()}
    label, holders = {i: i for i in sets}, {}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in sorted(sets):
        both = Counter(j for s in sets[i] for j in holders.get(s, ()))
        for j, n in both.items():
            if 100 * n >= 75 * (len(sets[i]) + len(sets[j]) - n):
                low, high = sorted((root(i), root(j)))
                label[high] = low
        for s in sets[i]:
            holders.setdefault(s, []).append(i)
    out = neardup.query(own).toPandas()
    assert dict(zip(out.doc_id, out.component_id, strict=True)) == {i: root(i) for i in sets}


def test_links_that_no_star_holds(spark):
    rng = np.random.default_rng(5)
    base = [f"t{i}" for i in range(120)]
    texts = {}
    for i in range(40):  # copies of one original, each unlike most others; the original has the last id
        ws = list(base)
        for k in rng.choice(120, 3, replace=False):
            ws[k] = f"n{i}_{k}"
        texts[i] = " ".join(ws)
    texts[40] = " ".join(base)
    chain = list(base)
    for i in range(41, 60):  # a chain: each like the one before it only
        chain = chain[6:] + [f"c{i}_{k}" for k in range(6)]
        texts[i] = " ".join(chain)
    passage = " ".join(f"p{k}" for k in range(60))
    for i in range(60, 160):  # a passage that many share
        texts[i] = passage + " " + " ".join(f"u{i}_{k}" for k in range(30))
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    check_components(neardup.query(df).toPandas(), texts)


def test_heavy_buckets_are_compared_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(neardup, "LIGHT", 1)
    monkeypatch.setattr(neardup, "DEALT", 30)
    monkeypatch.setattr(neardup, "HELD", 30)
    test_links_that_no_star_holds(spark)


def test_templates_are_not_multiplied(spark, monkeypatch):
    """Texts of one template, of similarity 0.73: heavy buckets with no link but the planted ones. A document goes to
    as many cells as its bands have blocks, and a pair is compared in one of them."""
    monkeypatch.setattr(neardup, "LIGHT", 20)
    monkeypatch.setattr(neardup, "HELD", 250)
    written, cells = [], neardup._cells
    monkeypatch.setattr(neardup, "_cells", lambda heavy: written.append((heavy.count(), cells(heavy).count())) or cells(heavy))
    template = [f"t{k}" for k in range(100)]
    texts = {i: " ".join(template + [f"u{i}_{k}" for k in range(18)]) for i in range(600)}
    for i in range(0, 50, 2):
        texts[600 + i] = " ".join(texts[i].split()[:-3] + [f"v{i}", "w", "x"])
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    out = neardup.query(df).toPandas()
    linked = {600 + i: i for i in range(0, 50, 2)}
    assert dict(zip(out.doc_id, out.component_id, strict=True)) == {i: linked.get(i, i) for i in texts}
    (heavy, rows), = written
    assert len(texts) < heavy <= len(texts) * neardup.BANDS and rows <= heavy * 3


def test_pairs_are_left_to_their_first_heavy_bucket():
    sets = [np.arange(s, s + 100, dtype=np.uint16).tobytes() for s in (0, 1, 2)]
    bands = [[7, 0, 9], [7, 5, 9], [0, 5, 9]]
    found = pd.DataFrame({"key": 9, "id": range(3), "n": 100, "comp": range(3), "stray": True, "hashes": sets, "bins": b"", "bands": bands})
    out = neardup._similar(found)
    assert {tuple(sorted(p)) for p in zip(out.src, out.dst)} == {(0, 2)}  # 0 and 1 meet in 7, 1 and 2 in 5


def test_members_that_are_held_against_a_whole_component(spark, monkeypatch):
    monkeypatch.setattr(neardup, "DEALT", 7)
    base = [f"t{i}" for i in range(100)]
    texts = {i: " ".join([*base, f"n{i}"]) for i in range(30)}
    texts[30] = " ".join([*base[:90], *[f"z{k}" for k in range(10)]])  # similar to all of them
    texts[31] = " ".join([*base[:50], *[f"y{k}" for k in range(50)]])  # similar to none
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    goals = spark.createDataFrame([(30, 0), (31, 0)], "id long, comp long")
    members = spark.createDataFrame([(i, 0) for i in range(30)] + [(30, 30), (31, 31)], "id long, comp long")
    links = neardup.block_links(df, goals, members).toPandas()
    assert set(links.src) == {30} and set(links.dst) <= set(range(30)) and len(links) >= 1
    assert neardup.block_links(df, goals.filter("false"), members).count() == 0


def test_only_first_partners_are_cut():
    sets = [np.arange(s, s + 100, dtype=np.uint16) for s in [0, *[3 + (k % 3) for k in range(12)], 40]]
    found = pd.DataFrame({"id": range(14), "n": 100, "comp": [0, *[1] * 12, 2], "stray": [True, *[False] * 13], "hashes": [h.tobytes() for h in sets], "bins": b""})
    out = neardup._similar(found)
    assert len(out) == neardup.PARTNERS and out.cut.all() and set(out.src) == {0} and not (out.dst == 13).any()


def test_near_duplicates_of_odd_rows(odd, empty):
    out = neardup.query(odd).toPandas()
    assert len(out) == odd.count()
    named = out[out.doc_id.notna()]
    texts = {r[0]: r[1] for r in odd_rows() if r[0] is not None}
    check_components(named.astype({"doc_id": int, "component_id": int}), texts)
    assert out[out.doc_id.isna()].kept.all()
    kept = neardup.dedup(odd)
    assert kept.columns == odd.columns and kept.filter("doc_id IS NULL").count() == 1
    assert neardup.query(empty).count() == 0 and neardup.dedup(empty).count() == 0
