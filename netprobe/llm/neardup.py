"""MinHash near-duplicates: one-permutation hashing with optimal densification, banded buckets, stars.

1. Each document's set of 5-word shingles (64-bit hashes) gives 255 bins in one pass: a bin holds the
   least hash that falls into it, an empty bin the value of a filled one that a universal hash picks.
   51 bands of 5 bins miss a pair of similarity 0.75 with probability 1e-6.
2. Documents with equal sets become one representative (the least id).
3. In every bucket of two or more, each member is paired with the bucket's centre: the member whose
   buckets hold most documents, which is the original that copies were made from. Pairs are confirmed
   on the full sets, and links joined to components.
4. A star may miss a link between two members that are both unlike the centre. So buckets that still
   hold several components are searched for links across them, by comparing the members' shingles as
   16-bit hashes, or the bins of large sets: what may reach 0.75 (for bins, within five standard
   deviations) goes on to the full sets. The largest component of a bucket is dealt out over tasks, the others, at most
   2 * LIGHT where the largest is dealt at all, go to each of them.
   A heavy bucket, of too many members outside its largest component, is compared block against block: HELD
   members of each in a task, so a member goes to as many tasks as there are blocks and is never multiplied by its
   other bands. A pair that shares several heavy buckets (0.75 means 12 bands on average) is compared in the first of them only.
   Of many likely partners in one component the best few are tried first. Where none of them is confirmed,
   the member is held against the full sets of that whole component, in blocks.

Where a centre has very many copies, the joins on it are split by Spark's own handling of skewed joins: both
their sides come from plain exchanges.

Defined results: null or empty texts, or texts without words, have no shingles and are linked with
nothing; texts under five words are one shingle; rows of one doc_id count as one document; rows
without a doc_id are kept and linked with nothing; empty tables give empty tables; other columns are
ignored, or kept by ``dedup``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netprobe.llm.common import U64, materialize, mix64, slices, stream64, word_hashes
from netprobe.operators.components import connected_components

WORDS, PERCENT = 5, 75
BANDS, ROWS = 51, 5
BINS = BANDS * ROWS
#: A bucket is searched pair by pair while its pairs across components are at most this many times its members.
LIGHT = 1000
#: So many members of a bucket's largest component go to one task.
DEALT = 2000
#: Sets up to MOST_SHORT are compared by 16-bit hashes, which never understate what two sets share; if one of
#: a pair is larger, both have LEAST_BINS at least and are compared by bins.
MOST_SHORT, LEAST_BINS = 340, 192
#: Of the likely partners of a small set in one other component, so many are tried first: the most similar ones.
#: If none of them is confirmed, ``block_links`` searches the whole component.
PARTNERS = 8
#: Members of a heavy bucket's block; two blocks meet in a task.
HELD = 8192
_ATTEMPTS = 4096
_MULT = stream64(WORDS, 21) | U64(1)


def shingle_sets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, and where each text's begin (len + 1)."""
    words, begins = word_hashes(texts)
    n = np.diff(begins)
    with np.errstate(over="ignore"):
        if len(words) >= WORDS:
            count = len(words) - WORDS + 1
            full = np.zeros(count, U64)
            for k in range(WORDS):
                full = mix64(full ^ (words[k : k + count] * _MULT[k]))
        sets = []
        for b, size in zip(begins[:-1], n, strict=True):
            if size >= WORDS:
                sets.append(np.unique(full[b : b + size - WORDS + 1]))
            elif size:
                one = U64(size)
                for w in words[b : b + size]:
                    one = mix64((one ^ w) * _MULT[0] + U64(1))
                sets.append(np.array([one], U64))
            else:
                sets.append(np.zeros(0, U64))
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    return np.concatenate(sets) if sets else np.zeros(0, U64), np.concatenate([[0], np.cumsum(sizes)])


def _picks() -> np.ndarray:
    return (stream64(_ATTEMPTS * BINS, 22) % U64(BINS)).astype(np.int64).reshape(_ATTEMPTS, BINS)


_PICKS = _picks()


def band_keys(values: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys (texts, BANDS) uint64 and bins cut to bytes (texts, BINS); rows of texts without shingles mean nothing."""
    n = len(begins) - 1
    owner = np.repeat(np.arange(n), np.diff(begins))
    spread = mix64(values ^ U64(0x5851F42D4C957F2D))
    bins = ((spread >> U64(32)) * U64(BINS) >> U64(32)).astype(np.int64)
    grid = np.full((n, BINS), np.iinfo(np.uint64).max, U64)
    np.minimum.at(grid, (owner, bins), spread)
    filled = np.zeros((n, BINS), bool)
    filled[owner, bins] = True
    todo = np.argwhere(~filled & filled.any(axis=1)[:, None])
    for pick in _PICKS:
        if not len(todo):
            break
        source = pick[todo[:, 1]]
        good = filled[todo[:, 0], source]
        grid[todo[good, 0], todo[good, 1]] = grid[todo[good, 0], source[good]]
        todo = todo[~good]
    with np.errstate(over="ignore"):
        keys = np.broadcast_to(stream64(BANDS, 23), (n, BANDS)).copy()
        for k in range(ROWS):
            keys = mix64(keys ^ (grid[:, k::ROWS] * U64(0x9E3779B97F4A7C15)))
    return keys, (mix64(grid) & U64(255)).astype(np.uint8)


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, n, fp1, fp2 (a fingerprint of the set), the band keys, and what estimates a similarity: the
    bins as bytes, or for small sets all shingles as 16-bit hashes (sizes between have both)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                values, begins = shingle_sets(part.column("text"))
                sizes = np.diff(begins)
                sums = []
                with np.errstate(over="ignore"):
                    for salt in (0x1B873593CC9E2D51, 0x85EBCA6BC2B2AE35):
                        total = np.concatenate([np.zeros(1, U64), np.cumsum(mix64(values ^ U64(salt)), dtype=U64)])
                        sums.append((total[begins[1:]] - total[begins[:-1]]).view(np.int64))
                keys, cut = band_keys(values, begins)
                listed = pa.ListArray.from_arrays(np.arange(0, keys.size + 1, BANDS, dtype=np.int32), keys.view(np.int64).ravel())
                short = (mix64(values) & U64(0xFFFF)).astype(np.uint16)
                bins = pa.array([row.tobytes() if size >= LEAST_BINS else b"" for row, size in zip(cut, sizes, strict=True)], pa.binary())
                hashes = pa.array([short[b:e].tobytes() if e - b <= MOST_SHORT else b"" for b, e in zip(begins[:-1], begins[1:], strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(sizes), pa.array(sums[0]), pa.array(sums[1]), listed, bins, hashes], names=["doc_id", "n", "fp1", "fp2", "keys", "bins", "hashes"])

    doc_id = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {doc_id}, n long, fp1 long, fp2 long, keys array<long>, bins binary, hashes binary")


def full_sets(docs: DataFrame) -> DataFrame:
    """doc_id and its shingles, a sorted array."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                values, begins = shingle_sets(part.column("text"))
                listed = pa.ListArray.from_arrays(begins.astype(np.int32), values.view(np.int64))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), listed], names=["doc_id", "shingles"])

    doc_id = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {doc_id}, shingles array<long>")


def _may_link(n: Column, m: Column) -> Column:
    """Sizes that similarity 0.75 allows."""
    return (100 * F.least(n, m)) >= (PERCENT * F.greatest(n, m))


def confirm(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """Those (src, dst) whose full sets are similar enough."""
    ids = pairs.select(F.col("src").alias("doc_id")).union(pairs.select("dst")).distinct()
    sets = materialize(full_sets(docs.select("doc_id", "text").join(ids.hint("shuffle_hash"), "doc_id", "left_semi")), "dup-sets")
    one = sets.select(F.col("doc_id").alias("src"), F.col("shingles").alias("a"))
    two = sets.select(F.col("doc_id").alias("dst"), F.col("shingles").alias("b"))
    both = F.size(F.array_intersect("a", "b")).cast("long")
    linked = 100 * both >= PERCENT * (F.size("a") + F.size("b") - both)
    return pairs.join(one, "src").join(two, "dst").filter(linked).select("src", "dst")


def _similar(found: pd.DataFrame) -> pd.DataFrame:
    """Pairs of a member outside the largest component (src) with likely partners in other components (dst);
    cut: src has more of them in the component of dst. Where ``bands`` are given (the keys of heavy buckets by band, 0 for
    others), pairs that share an earlier one than this bucket's are left to that."""
    ids, sizes, comps, stray = (found[c].to_numpy() for c in ("id", "n", "comp", "stray"))
    short = np.flatnonzero(sizes <= MOST_SHORT)
    hashes = np.frombuffer(b"".join(found["hashes"].iloc[short]), np.uint16)
    first = np.concatenate([[0], np.cumsum(sizes[short])]).astype(np.int64)
    binned = np.flatnonzero(sizes >= LEAST_BINS)
    bins = np.frombuffer(b"".join(found["bins"].iloc[binned]), np.uint8).reshape(-1, BINS)
    row = np.full(len(ids), -1)
    row[binned] = np.arange(len(binned))
    place = np.full(len(ids), -1)
    place[short] = np.arange(len(short))
    earlier = np.zeros((len(ids), 0), np.int64)
    held = np.ones(len(ids), bool)
    if "bands" in found and len(ids) and found["bands"].iloc[0] is not None:
        bands = np.array(found["bands"].tolist(), np.int64)
        earlier = bands[:, : int(np.argmax(bands[0] == found["key"].iloc[0]))]
        held = ~stray if not stray.all() else held  # of two blocks, one against the other
    src, dst, cut = [], [], []

    def put(i: int, others: np.ndarray, more: np.ndarray) -> None:
        src.append(np.full(len(others), ids[i]))
        dst.append(ids[others])
        cut.append(more)

    def fits(i: int, others: np.ndarray) -> np.ndarray:
        low, high = np.minimum(sizes[others], sizes[i]), np.maximum(sizes[others], sizes[i])
        return others[(comps[others] != comps[i]) & (100 * low >= PERCENT * high)]

    inside = np.zeros(1 << 16, bool)
    for i in np.flatnonzero(stray):
        mine = held & ~((earlier == earlier[i]) & (earlier[i] != 0)).any(axis=1)
        if sizes[i] <= MOST_SHORT:
            some = np.flatnonzero(mine[short])
            lengths, text = sizes[short[some]], hashes
            begins = first[some]
            if len(some) < len(short):
                ends = np.cumsum(lengths)
                text = hashes[np.repeat(begins - ends + lengths, lengths) + np.arange(ends[-1] if len(ends) else 0)]
                begins = ends - lengths
            own = hashes[first[place[i]] : first[place[i] + 1]]
            inside[own] = True
            shared = np.add.reduceat(inside[text].astype(np.int64), begins) if len(some) else np.zeros(0, np.int64)
            inside[own] = False
            most = np.minimum(shared, np.minimum(lengths, sizes[i]))
            good = 100 * most >= PERCENT * (lengths + sizes[i] - most)
            score = np.zeros(len(ids))
            score[short[some]] = most / np.maximum(lengths + sizes[i] - most, 1)
            likely = fits(i, short[some[good]])
            more = np.zeros(len(likely), bool)
            if len(likely) > PARTNERS:  # the best of each component
                likely = likely[np.lexsort((ids[likely], -score[likely], comps[likely]))]
                starts = np.flatnonzero(np.concatenate([[True], comps[likely][1:] != comps[likely][:-1]]))
                counts = np.diff(np.append(starts, len(likely)))
                first_few = np.arange(len(likely)) - np.repeat(starts, counts) < PARTNERS
                likely, more = likely[first_few], np.repeat(counts > PARTNERS, counts)[first_few]
            put(i, likely, more)
        if sizes[i] >= LEAST_BINS:
            others = fits(i, binned[mine[binned]])
            others = others[(sizes[others] > MOST_SHORT) | (sizes[i] > MOST_SHORT)]
            equal = (bins[row[others]] == bins[row[i]]).mean(axis=1)
            others = others[equal >= PERCENT / 100 - 5 * np.sqrt(0.1875 / BINS)]
            put(i, others, np.zeros(len(others), bool))
    none = np.zeros(0, ids.dtype)
    return pd.DataFrame({"src": np.concatenate([none, *src]), "dst": np.concatenate([none, *dst]), "cut": np.concatenate([np.zeros(0, bool), *cut])})


def _block_links(found: pd.DataFrame) -> pd.DataFrame:
    """For each seeker of a block, one member of the block whose full set is similar enough, if there is any."""
    seek, held = found[found["seeker"]], found[~found["seeker"]]
    src, dst = [], []
    if len(held):
        flat = np.concatenate(list(held["shingles"])).astype(np.int64)
        sizes = held["shingles"].map(len).to_numpy()
        owner = np.repeat(np.arange(len(held)), sizes)
        low = (flat & 0xFFFF).astype(np.uint16)
        ids, inside = held["id"].to_numpy(), np.zeros(1 << 16, bool)
        for i, own in zip(seek["id"], seek["shingles"], strict=True):
            cut = (own & 0xFFFF).astype(np.uint16)
            inside[cut] = True
            hit = np.flatnonzero(inside[low])
            inside[cut] = False
            both = np.bincount(owner[hit[np.isin(flat[hit], own)]], minlength=len(held))
            linked = np.flatnonzero((100 * both >= PERCENT * (sizes + len(own) - both)) & (ids != i))
            if len(linked):
                src.append(i)
                dst.append(ids[linked[0]])
    none = np.zeros(0, found["id"].dtype)
    return pd.DataFrame({"src": np.concatenate([none, src]).astype(none.dtype), "dst": np.concatenate([none, dst]).astype(none.dtype)})


def block_links(docs: DataFrame, goals: DataFrame, members: DataFrame) -> DataFrame:
    """Links (src, dst) of each ``goals`` (id, comp) with members (id, comp) of that component, all of them
    compared on full sets, DEALT by DEALT in a task; one link for each id and block is returned."""
    wanted = goals.groupBy("comp").agg(F.ceil(F.count("*") / DEALT).alias("across"))
    held = members.join(wanted, "comp")
    down = held.groupBy("comp", "across").agg(F.ceil(F.count("*") / DEALT).alias("down"))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    dealt = lambda n: F.pmod(F.xxhash64("id"), F.col(n))
    held = held.join(down.drop("across"), "comp").select("comp", dealt("down").alias("row"), every("across").alias("col"), "id", F.lit(False).alias("seeker"))
    seek = goals.join(down, "comp").select("comp", every("down").alias("row"), dealt("across").alias("col"), "id", F.lit(True).alias("seeker"))
    blocks = materialize(held.unionByName(seek), "dup-blocks")
    ids = blocks.select(F.col("id").alias("doc_id")).distinct()
    sets = full_sets(docs.select("doc_id", "text").join(ids.hint("shuffle_hash"), "doc_id", "left_semi")).withColumnRenamed("doc_id", "id")
    kind = blocks.schema["id"].dataType.simpleString()
    return blocks.join(sets, "id").groupBy("comp", "row", "col").applyInPandas(_block_links, f"src {kind}, dst {kind}").distinct()


def _compared(dealt: DataFrame, reps: DataFrame) -> DataFrame:
    """(src, dst, cut) of likely pairs in each (key, deal) of rows (key, deal, id, n, comp, stray, heavy: the id's heavy
    buckets, or null).

    A deal's work is not told by its bytes, so as many tasks as there are partitions share the deals; Spark would merge them."""
    tasks = int(dealt.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = dealt.join(reps.select("id", "bins", "hashes", "keys"), "id")
    bands = F.when(F.col("heavy").isNotNull(), F.transform("keys", lambda k: F.when(F.array_contains("heavy", k), k).otherwise(F.lit(0).cast("long"))))
    rows = rows.withColumn("bands", bands).drop("keys", "heavy").repartition(tasks, "key", "deal")
    kind = dealt.schema["id"].dataType.simpleString()
    return rows.groupBy("key", "deal").applyInPandas(_similar, f"src {kind}, dst {kind}, cut boolean").distinct()


def _cells(heavy: DataFrame) -> DataFrame:
    """Members (key, id, n, comp, members) of heavy buckets in blocks: each pair of blocks is a deal."""
    own = heavy.withColumn("blocks", F.ceil(F.col("members") / HELD)).withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")))
    met = own.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    deal = F.least("own", "other") * F.col("blocks") + F.greatest("own", "other")
    return met.select("key", deal.alias("deal"), "id", "n", "comp", (F.col("own") <= F.col("other")).alias("stray"))


def _across(rows: DataFrame, reps: DataFrame) -> DataFrame:
    """(src, dst, cut) of likely pairs of different components in a bucket, of rows (key, id, n, comp)."""
    per = rows.groupBy("key", "comp").agg(F.count("*").alias("own"))
    per = per.groupBy("key").agg(F.sum("own").alias("members"), F.sum(F.col("own") * F.col("own")).alias("inner"), F.max(F.struct("own", "comp")).alias("main"))
    per = per.filter("members * members > inner").withColumn("light", F.expr(f"members * members - inner <= {2 * LIGHT} * members"))
    per = per.select("key", "light", "members", F.col("main.comp").alias("main"), F.ceil(F.col("main.own") / DEALT).alias("deals"))
    marked = materialize(rows.join(per, "key").withColumn("stray", F.col("comp") != F.col("main")), "dup-across")
    deal = F.when(F.col("stray"), F.sequence(F.lit(0).cast("long"), F.col("deals") - 1)).otherwise(F.array(F.pmod(F.xxhash64("id"), F.col("deals"))))
    light = marked.filter("light").select("key", F.explode(deal).alias("deal"), "id", "n", "comp", "stray", F.lit(None).cast("array<long>").alias("heavy"))
    heavy = marked.filter("NOT light").select("key", "id", "n", "comp", "members")
    if heavy.isEmpty():
        return _compared(light, reps)
    own = heavy.groupBy("id").agg(F.collect_set("key").alias("heavy"))  # at most the number of bands
    return _compared(light, reps).unionByName(_compared(_cells(heavy).join(own, "id"), reps)).distinct()


def components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row."""
    signed = materialize(signatures(docs), "dup-signatures")
    sets = ["n", "fp1", "fp2"]
    reps = signed.filter("n > 0 AND doc_id IS NOT NULL").groupBy(*sets).agg(F.min("doc_id").alias("id"))
    one = signed.join(reps.select(F.col("id").alias("doc_id"), *sets), ["doc_id", *sets], "left_semi")
    one = one.dropDuplicates(["doc_id", *sets])  # repeated rows; dealt out by these keys already
    reps = materialize(one.select(F.col("doc_id").alias("id"), *sets, "keys", "bins", "hashes"), "dup-reps")
    rows = reps.select(F.explode("keys").alias("key"), "id", "n")
    crowded = rows.groupBy("key").agg(F.count("*").alias("members")).filter("members > 1")
    shared = materialize(rows.join(crowded, "key"), "dup-buckets")
    central = shared.groupBy("id").agg(F.sum("members").alias("rank"))
    centre = shared.join(central, "id").groupBy("key").agg(F.max(F.struct("rank", (-F.col("id")).alias("minus"), "n")).alias("c"))
    centre = centre.select("key", (-F.col("c.minus")).alias("dst"), F.col("c.n").alias("m"))
    stars = shared.join(centre, "key").filter("id <> dst").filter(_may_link(F.col("n"), F.col("m"))).select(F.col("id").alias("src"), "dst").distinct()
    stars = materialize(stars, "dup-stars")
    links = materialize(confirm(docs, stars), "dup-links")
    first = connected_components(links)
    # second search: only buckets with several components
    labelled = shared.join(first.select(F.col("node").alias("id"), "comp"), "id", "left").withColumn("comp", F.coalesce("comp", "id"))
    mixed = labelled.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).filter("low < high").select("key")
    left = labelled.join(mixed, "key", "left_semi").select("key", "id", "n", "comp")
    tested = stars.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"))
    likely = materialize(_across(left, reps), "dup-likely")
    more = likely.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()
    more = materialize(more.join(tested, ["src", "dst"], "left_anti"), "dup-more")
    if not more.isEmpty():
        found = materialize(confirm(docs, more), "dup-found")
        if not found.isEmpty():
            links = materialize(links.unionByName(found), "dup-links")
            first = connected_components(links)
    # third search: members whose best partners in a component were not confirmed, against all of it
    label = reps.select(*sets, "id").join(first.select(F.col("node").alias("id"), "comp"), "id", "left").withColumn("comp", F.coalesce("comp", "id"))
    label = materialize(label, "dup-labels")
    at = label.select("id", "comp")
    goals = likely.filter("cut").join(at.select(F.col("id").alias("src"), F.col("comp").alias("own")), "src").join(at.withColumnRenamed("id", "dst"), "dst")
    goals = materialize(goals.filter("own <> comp").select(F.col("src").alias("id"), "comp").distinct(), "dup-goals")
    if not goals.isEmpty():
        found = materialize(block_links(docs, goals, at), "dup-found")
        if not found.isEmpty():
            first = connected_components(links.unionByName(found))
            label = label.drop("comp").join(first.select(F.col("node").alias("id"), "comp"), "id", "left").withColumn("comp", F.coalesce("comp", "id"))
    label = label.select(*sets, "comp")
    out = signed.select("doc_id", *sets).join(label, sets, "left")
    component = F.when(F.col("n") > 0, F.coalesce("comp", "doc_id")).otherwise(F.col("doc_id"))
    out = out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def dedup(docs: DataFrame) -> DataFrame:
    """The documents without those that have an earlier near-duplicate."""
    gone = components(docs).filter("NOT kept").select("doc_id").distinct()
    return docs.join(gone.hint("shuffle_hash"), "doc_id", "left_anti").select(*docs.columns)


def query(docs: DataFrame) -> DataFrame:
    return components(docs.select("doc_id", "text"))
