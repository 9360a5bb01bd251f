"""Mixing sources to target weights, in DataFrame operations only.

1. Each source's words form a stream of its documents in hash order, cut into blocks of ``BLOCK_WORDS``.
2. Output shards hold ``SLOTS_PER_SHARD`` slots; every slot draws a source by the quotas' shares, which makes
   a shard's source counts multinomial. The draws decide how many blocks of each source are taken, and in
   which shard. Only a source that has drawn over ``TOLERANCE`` too much or too little is corrected: its
   slots then hold a few blocks less or more, spread over all its shards.
3. The running sums of the counts number each source's slots. A slot's number, through a permutation of the
   source's block indexes (swap-or-not, with new keys in each pass over the source), is a block, joined by its index.
   Inside a shard, slots stand in hash order.

Defined results: null or empty texts have size 0 and are never taken; null sources are one source,
last in order; an empty table, or one without words, has targets 0; rows that are equal in all columns
are copies that hold places of their own; ``mix`` keeps all columns, also those named like its own, and rows
without a doc_id. No document is taken more than twice. Very long texts span many blocks and are never
held whole but as the row itself. Windows without a hash group hold a row for each source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType

from netprobe.llm.common import materialize, once, text_or_empty, words_of

BLOCK_WORDS = 64
SLOTS_PER_SHARD = 4096
WEIGHTS = (3.0, 1.0, 2.0)
SHARE, MOST = 1.5, 2.0
#: The share of its quota by which a source's draws may miss it; one block at least.
TOLERANCE = 0.005
SEED = 17
#: Rounds of the permutation.
ROUNDS = 10
_GROUP = 4096
_CELLS = 4096


def _source_key() -> Column:
    """Sorts by code point, null last."""
    return F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("z"))


def _before(df: DataFrame, keys: list[str], order: list[str], group: str, value: str, out: str) -> DataFrame:
    """``out``: sum of ``value`` over the rows of the same keys before this one. ``group`` goes with the
    order and has a bounded number of rows, so no window holds all rows of a hot key."""
    totals = df.groupBy(*keys, group).agg(F.sum(value).alias("_sum"))
    w = W.partitionBy(*keys).orderBy(group).rowsBetween(W.unboundedPreceding, -1)
    totals = totals.withColumn("_base", F.coalesce(F.sum("_sum").over(w), F.lit(0))).drop("_sum")
    own = W.partitionBy(*keys, group).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    inner = df.withColumn("_own", F.coalesce(F.sum(value).over(own), F.lit(0)))
    return inner.join(totals.hint("merge"), [*keys, group]).withColumn(out, F.col("_base") + F.col("_own")).drop("_base", "_own")


def source_targets(sized: DataFrame, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """skey, source_size, target, n_blocks, quota of each source of (skey, size)."""
    sources = sized.groupBy("skey").agg(F.sum("size").alias("source_size"))
    every = W.partitionBy(F.lit(0))  # one row for each source
    rank = F.row_number().over(every.orderBy("skey")) - 1
    sources = sources.withColumn("w", F.element_at(F.array(*[F.lit(x) for x in weights]), (rank % len(weights) + 1).cast("int")))
    sources = sources.withColumn("cap", MOST * F.col("source_size")).withColumn("reach", F.col("cap") / F.col("w"))
    order = every.orderBy("reach", "skey")
    left = F.sum("source_size").over(every) * SHARE - F.coalesce(F.sum("cap").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    level = left / F.sum("w").over(order.rowsBetween(0, W.unboundedFollowing))
    sources = sources.withColumn("level", level)
    # sources before the first whose share fits stand at their cap; the level is that first one's
    fits = F.when(F.col("level") <= F.col("reach") * (1 + 1e-12), F.struct("reach", "skey", "level"))
    sources = sources.withColumn("level", F.min(fits).over(every)["level"])
    target = F.least(F.col("cap"), F.col("level") * F.col("w"))
    blocks = F.ceil(F.col("source_size") / BLOCK_WORDS)
    # the last block is shorter: count in blocks of the mean length
    quota = F.when(blocks > 0, F.least(2 * blocks, F.round(F.col("target") * blocks / F.col("source_size")).cast("long"))).otherwise(0)
    return sources.withColumn("target", target).select("skey", "source_size", "target", blocks.cast("long").alias("n_blocks"), quota.alias("quota"))


def draw_counts(sources: DataFrame) -> DataFrame:
    """shard, skey, n: how many slots of each shard draw each source, multinomial by the quotas' shares."""
    spark = sources.sparkSession
    every = W.partitionBy(F.lit(0))  # one row for each source
    total = sources.agg(F.coalesce(F.sum("quota"), F.lit(0)).alias("n")).first()["n"]
    high = F.sum("quota").over(every.orderBy("skey")) / float(max(total, 1))
    edges = sources.filter("quota > 0").select("skey", high.alias("high"), (high - F.col("quota") / float(max(total, 1))).alias("low"))
    shards = spark.range(-(-total // SLOTS_PER_SHARD)).withColumnRenamed("id", "shard")
    slots = shards.select("shard", F.explode(F.sequence(F.col("shard") * SLOTS_PER_SHARD, F.least(F.lit(total), (F.col("shard") + 1) * SLOTS_PER_SHARD) - 1)).alias("slot"))
    u = F.pmod(F.xxhash64(F.lit(SEED), "slot"), F.lit(1 << 40)) / float(1 << 40)
    slots = slots.withColumn("u", u).withColumn("cell", F.floor(F.col("u") * _CELLS))
    cells = edges.withColumn("cell", F.explode(F.sequence(F.floor(F.greatest(F.col("low"), F.lit(0.0)) * _CELLS), F.least(F.floor(F.col("high") * _CELLS), F.lit(_CELLS - 1)))))
    # a cell's first and last source reach over its ends, so that rounding leaves no gap
    last = F.max("high").over(W.partitionBy("cell")) == F.col("high")
    begins = F.min("low").over(W.partitionBy("cell")) == F.col("low")
    cells = cells.select("cell", "skey", F.when(begins, -1.0).otherwise(F.col("low")).alias("low"), F.when(last, 2.0).otherwise(F.lead("low").over(W.partitionBy("cell").orderBy("low"))).alias("high"))
    drawn = slots.join(cells.hint("shuffle_hash"), "cell").filter((F.col("u") >= F.col("low")) & (F.col("u") < F.col("high")))
    return drawn.groupBy("shard", "skey").agg(F.count("*").alias("n"))


def permuted(rows: DataFrame, value: str, n: str, key: str) -> DataFrame:
    """Replaces ``value``, in [0, n), by its place in a pseudorandom permutation of [0, n) that ``key`` (a long) picks.

    Swap-or-not: each round pairs x with k - x modulo n, and a bit of the pair's hash swaps the two or not."""
    def swapped(x: Column, r: Column) -> Column:
        pair = F.pmod(F.pmod(F.xxhash64(r, key), F.col(n)) - x, F.col(n))
        # an array of one holds the pair's other half, so that it is made once
        return F.get(F.transform(F.array(pair), lambda p: F.when(F.xxhash64(r + ROUNDS, F.col(key), F.greatest(x, p)) < 0, p).otherwise(x)), F.lit(0))

    return rows.withColumn(value, F.aggregate(F.array(*[F.lit(r) for r in range(ROUNDS)]), F.col(value), swapped))


def takes(sources: DataFrame) -> DataFrame:
    """skey, block, pass, shard, slot: which blocks are taken, and where they stand in the mix.

    The planner sees only the small table of sources that all slots grow from, and would broadcast the
    slots; hence the join hints here and where blocks are joined."""
    counts = materialize(draw_counts(sources), "mix-draws")  # read five times below: each would draw again, in one large plan
    drawn = counts.groupBy("skey").agg(F.sum("n").alias("drawn"))
    slack = F.ceil(F.col("quota") * TOLERANCE)
    total = F.least(F.greatest(F.coalesce("drawn", F.lit(0).cast("long")), F.col("quota") - slack), F.col("quota") + slack, 2 * F.col("n_blocks"))
    per = sources.filter("quota > 0").join(drawn, "skey", "left").select("skey", "n_blocks", "drawn", total.alias("total"))
    shards = F.ceil(F.sum("quota").over(W.partitionBy(F.lit(0))) / SLOTS_PER_SHARD)
    # a small source that no slot has drawn stands in one shard
    missed = sources.filter("quota > 0").select("skey", F.pmod(F.xxhash64(F.lit(SEED), "skey"), shards).alias("shard"))
    missed = missed.join(drawn.select("skey"), "skey", "left_anti").select("shard", "skey", F.lit(1).cast("long").alias("n"))
    counts = counts.unionByName(missed).withColumn("_g", F.floor(F.col("shard") / _GROUP))
    runs = _before(counts, ["skey"], ["shard"], "_g", "n", "first").join(per.hint("merge"), "skey")
    drawn_n = F.coalesce("drawn", F.lit(1).cast("long"))
    scaled = lambda x: F.when(x >= drawn_n, F.col("total")).otherwise(F.floor(x * (F.col("total") / drawn_n)))
    runs = runs.select("skey", "shard", "n_blocks", scaled(F.col("first")).alias("begin"), scaled(F.col("first") + F.col("n")).alias("end")).filter("begin < end")
    tasks = int(sources.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    runs = materialize(runs, "mix-runs").repartition(tasks, "skey", "shard")  # a few bytes that grow to thousands of rows each
    slots = runs.select("skey", "shard", "n_blocks", F.explode(F.sequence(F.col("begin"), F.col("end") - 1)).alias("j"))
    slots = slots.withColumn("pass", F.floor(F.col("j") / F.col("n_blocks"))).withColumn("block", F.col("j") % F.col("n_blocks"))
    slots = permuted(slots.withColumn("_key", F.xxhash64(F.lit(SEED), "skey", "pass")), "block", "n_blocks", "_key")
    inside = W.partitionBy("shard").orderBy(F.xxhash64(F.lit(SEED), "skey", "j"), "skey", "j")  # about SLOTS_PER_SHARD rows
    return slots.withColumn("slot", F.row_number().over(inside) - 1).select("skey", "block", "pass", "shard", "slot")


def taken_blocks(sources: DataFrame) -> DataFrame:
    """skey, block, takes: the passes that take the block, each with its shard and slot."""
    return takes(sources).groupBy("skey", "block").agg(F.sort_array(F.collect_list(F.struct("pass", "shard", "slot"))).alias("takes"))


def _placed(sized: DataFrame) -> DataFrame:
    """A row for each document, copies too, with ``off``: its first word in its source's stream. The stream follows
    the order of hashes; groups by leading bits hold about 4096 rows."""
    n = sized.count()
    bits = max(0, (max(1, n) // _GROUP).bit_length())
    spans = sized.withColumn("_span", F.col("_size") * F.col("_n")).withColumn("_g", F.shiftrightunsigned("_o", 64 - bits) if bits else F.lit(0).cast("long"))
    placed = _before(spans, ["skey"], ["_o", "_k1", "_k2"], "_g", "_span", "off").drop("_span", "_g")
    copies = placed.withColumn("_copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)))
    return copies.withColumn("off", F.col("off") + F.col("_copy") * F.col("_size"))


def _pieces(placed: DataFrame, blocks: DataFrame, how: str) -> DataFrame:
    """A row for each document and block that overlap: begin, len (in the document's words), takes."""
    span = placed.filter("_size > 0").withColumn("block", F.explode(F.sequence(F.floor(F.col("off") / BLOCK_WORDS), F.floor((F.col("off") + F.col("_size") - 1) / BLOCK_WORDS))))
    begin = F.greatest(F.col("block") * BLOCK_WORDS - F.col("off"), F.lit(0))
    end = F.least((F.col("block") + 1) * BLOCK_WORDS - F.col("off"), F.col("_size"))
    return span.withColumn("begin", begin).withColumn("len", end - begin).join(blocks.hint("merge"), ["skey", "block"], how)


def _keyed(docs: DataFrame) -> DataFrame:
    """_all (the whole row), _text, skey, _size (words), _o (a hash of doc_id, source and text), and _k1 and _k2,
    a hash of all columns in 128 bits."""

    def hashed(seed: int, columns: list[str]) -> Column:
        parts: list[Column] = []
        for c in columns:
            own = F.col(f"`{c}`")
            nested = isinstance(docs.schema[c].dataType, ArrayType | MapType | StructType)
            parts += [F.to_json(own) if nested else own, own.isNull()]  # hashes pass over nulls
        return F.xxhash64(F.lit(seed), *parts)

    keys = {"_o": hashed(SEED, ["doc_id", "source", "text"]), "_k1": hashed(SEED + 1, docs.columns), "_k2": hashed(SEED + 2, docs.columns)}
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_all"), text_or_empty().alias("_text"), _source_key().alias("skey"), *[c.alias(k) for k, c in keys.items()])
    return rows.withColumn("_size", F.size(words_of(F.col("_text"))).cast("long"))


def query(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken, and the shard and slot where a document first stands in the mix."""
    keyed = _keyed(docs.select("doc_id", "source", "text")).withColumn("doc_id", F.col("_all.doc_id"))
    sized = materialize(keyed.groupBy("doc_id", "skey", "_size", "_o", "_k1", "_k2").agg(F.count("*").alias("_n")), "mix-sizes")
    sources = materialize(source_targets(sized.select("skey", (F.col("_size") * F.col("_n")).alias("size"))), "mix-sources")
    pieces = _pieces(_placed(sized), taken_blocks(sources), "left")
    first = F.array_min(F.transform("takes", lambda t: F.struct(t["shard"], t["slot"])))
    taken = pieces.groupBy("skey", "off", "doc_id", "_size").agg(F.sum(F.col("len") * F.coalesce(F.size("takes"), F.lit(0))).alias("taken"), F.min(first).alias("place"))
    rows = taken.select("doc_id", "skey", "_size", "taken", F.col("place.shard").alias("first_shard"), F.col("place.slot").alias("first_slot"))
    none = sized.filter("_size = 0").withColumn("_copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)))
    none = none.select("doc_id", "skey", "_size", F.lit(0).cast("long").alias("taken"), F.lit(None).cast("long").alias("first_shard"), F.lit(None).cast("int").alias("first_slot"))
    out = rows.unionByName(none).join(sources.select("skey", "source_size", "target"), "skey")
    return out.select("doc_id", F.col("_size").alias("size"), "source_size", "target", F.col("taken").cast("long").alias("taken"), "first_shard", "first_slot")


def mix(docs: DataFrame, placed: bool = False) -> DataFrame:
    """The mixed documents: a row for each document and pass that takes words of it, its text cut down to
    those words (whole texts stay as they are), n_chars made to fit, all other columns kept.

    ``placed`` adds mix_shard and mix_slot, where the row's first block stands; sorted by them, rows follow
    one another as the shards mix the sources."""
    rows, keys = _keyed(docs), ["_k1", "_k2"]
    sized = materialize(rows.groupBy("skey", "_size", "_o", *keys).agg(F.count("*").alias("_n")), "mix-sizes")
    sources = materialize(source_targets(sized.select("skey", (F.col("_size") * F.col("_n")).alias("size"))), "mix-sources")
    pieces = _pieces(_placed(sized), taken_blocks(sources), "inner").withColumn("_take", F.explode("takes"))
    cut = pieces.groupBy(*keys, "_copy", F.col("_take.pass").alias("_pass")).agg(
        F.sort_array(F.collect_list(F.struct("begin", "len"))).alias("_ranges"), F.sum("len").alias("_kept"), F.min(F.struct("_take.shard", "_take.slot")).alias("_place")
    )
    out = rows.filter("_size > 0").dropDuplicates(keys).join(cut.hint("merge"), keys)
    out = out.withColumn("_words", once(F.when(F.col("_kept") < F.col("_size"), words_of(F.col("_text")))))
    parts = F.transform("_ranges", lambda r: F.array_join(F.slice(F.col("_words"), (r["begin"] + 1).cast("int"), r["len"].cast("int")), " "))
    out = out.withColumn("_cut", F.when(F.col("_kept") < F.col("_size"), F.array_join(parts, "\n")).otherwise(F.col("_text")))
    new = {"text": F.col("_cut"), "n_chars": F.char_length("_cut")}
    columns = [(new[c].cast(docs.schema[c].dataType) if c in new else F.col("_all").getField(c)).alias(c) for c in docs.columns]
    more = [F.col("_place.shard").alias("mix_shard"), F.col("_place.slot").alias("mix_slot")] if placed else []
    return out.select(*[c for c, k in zip(columns, docs.columns, strict=True) if not (placed and k in ("mix_shard", "mix_slot"))], *more)
