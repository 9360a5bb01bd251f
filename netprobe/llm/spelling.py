"""Spelling variants: words that are one edit apart, and the frequent form that each goes back to.

Two words are near if one insertion, deletion or replacement of a code point turns one into the other:
their common prefix and suffix together reach the longer length less one. Words are held as rows of
padded code-point matrices, one aligned left and one right, and compared block against block.

Which blocks meet: let s be the shorter length and h = s // 2. An edit at place h or later leaves the
first h code points, an earlier one the last s - h. So a word of length n is dealt out by its first and
by its last half, once as the shorter word (s = n) and once as the longer one (s = n - 1). A large
bucket is cut into blocks, and each pair of blocks is a cell of its own; a pair of words is kept where
the first half agrees, or in the bucket of the last half where it does not, so it is found once.

Defined results: null or empty texts have no words; a null doc_id counts as an empty string; a row that
repeats counts again; equal counts go to the word first in code-point order; other columns are
ignored; an empty table gives no rows. Words of any length are compared whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netprobe.llm.common import materialize

RUN = "[A-Za-z\\u00C0-\\u00FF]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A word's least code points and occurrences; a form has at least so many times the word's occurrences.
LEAST_LENGTH, LEAST_COUNT, TIMES = 6, 5, 5
#: One run in so many loses a code point.
DAMAGED = 199
#: Words, and code points, of a block.
BLOCK_WORDS, BLOCK_POINTS = 2048, 1 << 21
#: Code points that are compared at once.
_POINTS = 1 << 21


def words(docs: DataFrame) -> DataFrame:
    """(word, n): distinct runs of letters after the planned damage, long and frequent enough."""
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("_id"), F.explode(F.regexp_extract_all("text", F.lit(RUN), F.lit(0))).alias("_run"))
    runs = runs.filter(F.char_length("_run") >= LEAST_LENGTH).select("_id", F.translate("_run", UPPER, LOWER).alias("_run"))
    digest = F.crc32(F.concat("_id", F.lit(":"), "_run").cast("binary"))
    at = (digest % F.char_length("_run")).cast("int")
    damaged = F.concat(F.substring("_run", F.lit(1), at), F.substring("_run", at + 2, F.char_length("_run")))
    found = runs.select(F.when(digest % DAMAGED == 0, damaged).otherwise(F.col("_run")).alias("word"))
    found = found.filter(F.char_length("word") >= LEAST_LENGTH).groupBy("word").agg(F.count("*").alias("n"))
    return found.filter(F.col("n") >= LEAST_COUNT)


def halves(vocabulary: DataFrame) -> DataFrame:
    """(s, last, key, word, n): each word by its first and last half, as the shorter and as the longer word."""
    length = F.char_length("word")
    as_shorter = F.explode(F.array(length, length - 1)).alias("s")
    own = vocabulary.select("word", "n", as_shorter).filter("s > 0").withColumn("last", F.explode(F.array(F.lit(False), F.lit(True))))
    half = F.floor(F.col("s") / 2).cast("int")
    rest = F.col("s") - half
    key = F.when(F.col("last"), F.substring("word", length - rest + 1, rest)).otherwise(F.substring("word", F.lit(1), half))
    return own.select("s", "last", F.xxhash64(key).alias("key"), "word", "n")


def cells(dealt: DataFrame) -> DataFrame:
    """Adds a, b (the cell's two blocks) and block (the word's own). Buckets of one word are left out."""
    bucket = ["s", "last", "key"]
    sizes = dealt.groupBy(*bucket).agg(F.count("*").alias("_n")).filter("_n > 1")
    blocks = F.ceil(F.greatest(F.col("_n") / BLOCK_WORDS, F.col("_n") * (F.col("s") + 1) / BLOCK_POINTS)).cast("int")
    own = dealt.join(sizes.select(*bucket, blocks.alias("_b")), bucket)
    own = own.withColumn("block", F.pmod(F.xxhash64("word"), F.col("_b")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("_b") - 1))
    own = own.withColumn("_o", other)
    return own.select(*bucket, F.least("block", "_o").alias("a"), F.greatest("block", "_o").alias("b"), "block", "word", "n")


class Matrix:
    """Words as code points, padded to one width, aligned left and right."""

    def __init__(self, texts: list[str]) -> None:
        left = np.array(texts, str)
        width = left.dtype.itemsize // 4
        self.left = left.view(np.uint32).reshape(len(texts), width)
        self.lengths = np.array([len(t) for t in texts], np.int64)  # a word may end in the padding's code point
        if self.left.size and self.left.max() < 256:
            self.left = self.left.astype(np.uint8)
        places = np.arange(width)[None, :] - (width - self.lengths)[:, None]
        self.right = np.where(places >= 0, np.take_along_axis(self.left, np.maximum(places, 0), axis=1), 0)


def _agreeing(equal: np.ndarray) -> np.ndarray:
    """How many leading entries of each row are true."""
    return np.where(equal.all(axis=1), equal.shape[1], np.argmin(equal, axis=1))


def near_pairs(m: Matrix, one: np.ndarray, two: np.ndarray, half: int, last: bool) -> np.ndarray:
    """Which of the pairs (one[i], two[i]) are one edit apart and belong to this bucket."""
    width, out = m.left.shape[1], np.zeros(len(one), bool)
    for i in range(0, len(one), max(1, _POINTS // max(1, width))):
        own = slice(i, i + max(1, _POINTS // max(1, width)))
        a, b = one[own], two[own]
        shorter, longer = np.minimum(m.lengths[a], m.lengths[b]), np.maximum(m.lengths[a], m.lengths[b])
        prefix = np.minimum(_agreeing(m.left[a] == m.left[b]), shorter)
        suffix = np.minimum(_agreeing(m.right[a, ::-1] == m.right[b, ::-1]), shorter)
        near = (longer - shorter <= 1) & (prefix + suffix >= longer - 1) & ~((longer == shorter) & (prefix == longer))
        out[own] = near & ((prefix < half) if last else (prefix >= half))
    return out


def compare(s: np.ndarray, group: np.ndarray, block: np.ndarray, texts: list[str], last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) of near words. ``group`` numbers the cells, in order and of one ``s``; a pair must have a word of
    length s, and in a cell of two blocks one word of each."""
    m, n = Matrix(texts), len(texts)
    ends = np.searchsorted(group, group, "right")
    partners = ends - np.arange(n) - 1
    upto = np.cumsum(partners)
    mixed = np.zeros(n, bool)  # rows of cells with two blocks
    starts = np.searchsorted(group, group, "left")
    lowest, highest = np.minimum.reduceat(block, np.unique(starts)), np.maximum.reduceat(block, np.unique(starts))
    number = np.cumsum(np.r_[True, group[1:] != group[:-1]]) - 1
    mixed = (lowest != highest)[number]
    found: list[tuple[np.ndarray, np.ndarray]] = []
    i, most = 0, max(1, _POINTS // max(1, m.left.shape[1]))
    while i < n:
        before = upto[i - 1] if i else 0
        j = max(i + 1, int(np.searchsorted(upto, before + most, "right")))
        one = np.repeat(np.arange(i, j), partners[i:j])
        two = one + 1 + np.arange(len(one)) - np.repeat(upto[i:j] - partners[i:j] - before, partners[i:j])
        keep = (np.minimum(m.lengths[one], m.lengths[two]) == s[one]) & (~mixed[one] | (block[one] != block[two]))
        one, two = one[keep], two[keep]
        for kind in (False, True):
            own = last[one] == kind
            hit = near_pairs(m, one[own], two[own], int(s[0]) // 2, kind)
            found.append((one[own][hit], two[own][hit]))
        i = j
    return np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found])


_NEAR = pa.schema([("word", pa.string()), ("near", pa.string()), ("near_n", pa.int64())])


def near_words(vocabulary: DataFrame) -> DataFrame:
    """(word, near, near_n): all near words of each word, each pair in both directions."""

    def emit(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        columns = {c: rows[c].to_numpy() for c in ("s", "last", "key", "a", "b", "block", "n")}
        texts = rows["word"].to_pylist()
        change = np.zeros(len(texts), bool)
        for c in ("s", "last", "key", "a", "b"):
            change[1:] |= columns[c][1:] != columns[c][:-1]
        group = np.cumsum(change)
        cuts = np.flatnonzero(np.r_[True, columns["s"][1:] != columns["s"][:-1]]).tolist() + [len(texts)]
        for begin, end in zip(cuts[:-1], cuts[1:], strict=True):
            own = slice(begin, end)
            one, two = compare(columns["s"][own], group[own], columns["block"][own], texts[own], columns["last"][own])
            for x, y in ((one, two), (two, one)):
                for i in range(0, len(x), 1 << 16):
                    u, v = x[i : i + (1 << 16)] + begin, y[i : i + (1 << 16)] + begin
                    yield pa.RecordBatch.from_arrays([rows["word"].take(pa.array(u)).combine_chunks(), rows["word"].take(pa.array(v)).combine_chunks(), pa.array(columns["n"][v])], schema=_NEAR)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.RecordBatch] = []  # the rows of the last cell, which may go on in the next batch
        for batch in batches:
            if not len(batch):
                continue
            rows = pa.Table.from_batches([*kept, batch])
            ids = [rows[c].to_numpy() for c in ("s", "last", "key", "a", "b")]
            other = np.flatnonzero(np.logical_or.reduce([x != x[-1] for x in ids]))
            cut = int(other[-1]) + 1 if len(other) else 0
            if cut:
                yield from emit(rows.slice(0, cut))
            kept = rows.slice(cut).to_batches()
        if kept:
            yield from emit(pa.Table.from_batches(kept))

    key = ["s", "last", "key", "a", "b"]
    return cells(halves(vocabulary)).repartition(*key).sortWithinPartitions(*key).mapInArrow(run, "word string, near string, near_n long")


def forms(vocabulary: DataFrame, near: DataFrame, times: int = TIMES) -> DataFrame:
    """(word, n, n_near, form, form_n): the near word of most occurrences, if it has ``times`` the word's."""
    best = near.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("neg"), F.col("near").alias("near"))).alias("_b"))
    own = vocabulary.join(best, "word", "left").withColumn("_n", -F.col("_b.neg"))
    taken = F.col("_n") >= F.col("n") * times
    return own.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(taken, F.col("_b.near")).alias("form"), F.when(taken, F.col("_n")).alias("form_n"))


def roots(found: DataFrame) -> DataFrame:
    """Adds ``root``: the last of the forms of forms. A form has several times its word's occurrences, so chains
    are short and have no circles; each round doubles the step, and holds only words whose chain goes on."""
    if found.select("form").filter("form IS NOT NULL").isEmpty():
        return found.withColumn("root", F.col("word"))
    step = materialize(found.filter("form IS NOT NULL").select("word", F.col("form").alias("to")), "spelling-steps")
    while True:
        on = step.select(F.col("word").alias("to"), F.col("to").alias("_next"))
        moved = materialize(step.join(on, "to", "left").select("word", F.coalesce("_next", "to").alias("to"), F.col("_next").isNotNull().alias("_moved")), "spelling-steps")
        step = moved.select("word", "to")
        if moved.filter("_moved").isEmpty():
            break
    return found.join(step, "word", "left").withColumn("root", F.coalesce("to", "word")).drop("to")


def variants(docs: DataFrame) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word."""
    vocabulary = materialize(words(docs), "spelling-words")
    found = materialize(forms(vocabulary, near_words(vocabulary)), "spelling-forms")
    return roots(found).select("word", "form", "root", "n", "n_near", "form_n")


def query(docs: DataFrame) -> DataFrame:
    return variants(docs)
