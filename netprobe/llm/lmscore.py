"""Language-model scores from a log-frequency Bloom filter of quantised n-gram counts.

Counting: tasks sum the one- and two-word sequences of their training texts, and buckets of the key
space merge these sums. A bucket writes its segment of the filter: a sequence of quantised count q =
1 + floor(STEPS * log2 count) is entered at levels 1 to q. A segment has ``ROOM`` times ``ENTRY_BITS`` bits for each of
its counted entries, so nothing is left out. Segments are files in the shared folder, named by kind and bucket,
which workers map into memory: only the folder's name goes with the tasks.

Scoring: a worker probes rising levels until one is missing, which gives the least and the most that the
count can be: a factor of 1.19 apart for words, 2 for pairs. With c- and c+ for these,

    P(w) = (c-(w) + 1) / (N + V + 1)        P(w | v) = (c-(v w) + PRIOR P(w)) / (c+(v) + PRIOR)

so that the probabilities of all words after v sum to 1 at most, but for sequences that the filter holds by
mistake; each is 1 at most in any case.

The exact base needs exact counts. Words above a count that at most ``HOT`` words reach go to every
worker; the occurrences of all rarer ones are joined with their counts.

Defined results: null or empty texts are the end alone; without training texts N is 0 and every word
unknown; rows without a doc_id count as the empty id, so they train; repeated rows are scored each for
itself; very long texts are counted in runs; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import contextlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netprobe.llm.common import U64, materialize, mix64, new_path, slices, stream64, text_or_empty, word_hashes
from netprobe.llm.urlfilter import _local

ENTRY_BITS, PROBES = 8, 3
#: At twice the least bits an entry, a level is found by mistake with probability 0.005.
ROOM = 2
HOT = 1 << 18
#: Weight of the single word's estimate, in occurrences of the word before.
PRIOR = 2.0
FLUSH_TOKENS, BUCKET_BYTES = 2_000_000, 8_000_000
END = stream64(1, 31)[0]
_LEVELS = stream64(256, 32)
WORD, PAIR = 1, 2
#: Levels for each doubling of a count.
STEPS = {WORD: 4, PAIR: 1}


def training(doc_id: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(7)) != 2


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all tokens, each text closed by the end, and where each text's begin (len + 1)."""
    words, begins = word_hashes(texts)
    return np.insert(words, begins[1:], END), begins + np.arange(len(begins))


def pairs_of(keys: np.ndarray) -> np.ndarray:
    """Key of each token and the one before it; before a text stands the end."""
    before = np.empty_like(keys)
    before[:1] = END
    before[1:] = keys[:-1]
    with np.errstate(over="ignore"):
        return mix64(before * U64(0xD1342543DE82EF95) + keys)


def bucket_of(keys: np.ndarray, n: int) -> np.ndarray:
    """Buckets rise with the key."""
    return ((keys >> U64(32)) * U64(n) >> U64(32)).astype(np.int64)


def quantised(counts: np.ndarray, kind: int) -> np.ndarray:
    return 1 + np.floor(STEPS[kind] * np.log2(counts) + 1e-9).astype(np.int64)


def least_count(levels: np.ndarray, kind: int) -> np.ndarray:
    """The least count of a level; 0 at level 0."""
    return np.where(levels > 0, np.ceil(2.0 ** ((levels - 1) / STEPS[kind]) - 1e-6), 0.0)


def most_count(levels: np.ndarray, kind: int) -> np.ndarray:
    """The most that a level's count can be; 0 at level 0."""
    return np.where(levels > 0, least_count(levels + 1, kind) - 1, 0.0)


def positions(keys: np.ndarray, level: int, bits: int | np.ndarray) -> Iterator[np.ndarray]:
    with np.errstate(over="ignore"):
        h = keys ^ _LEVELS[level]
        for _ in range(PROBES):
            h = mix64(h + U64(0x9E3779B97F4A7C15))
            yield ((h >> U64(32)) * U64(bits) >> U64(32)).astype(np.int64)


def make_segment(keys: np.ndarray, counts: np.ndarray, kind: int) -> bytes:
    """The filter's segment, with room for every entry of these sequences."""
    levels = quantised(counts, kind)
    bits = max(64, -(-int(levels.sum()) * ROOM * ENTRY_BITS // 8) * 8)
    own = np.zeros(bits, bool)
    for level in range(1, int(levels.max(initial=0)) + 1):
        for at in positions(keys[levels >= level], level, bits):
            own[at] = True
    return np.packbits(own, bitorder="little").tobytes()


@lru_cache(maxsize=1 << 14)
def _open(path: str) -> np.ndarray:
    """A segment's bytes, mapped into memory; from a store without local paths, loaded. Without a file, there is no sequence."""
    with contextlib.suppress(FileNotFoundError):
        if "://" not in path or path.startswith("file:"):
            return np.memmap(_local(path), np.uint8, "r")
        files, base = pafs.FileSystem.from_uri(path)
        with files.open_input_file(base) as file:
            return np.frombuffer(file.read(), np.uint8)
    return np.zeros(0, np.uint8)


@dataclass
class Model:
    buckets: int
    folder: str
    hot_keys: np.ndarray
    hot_counts: np.ndarray
    tokens: int  # N
    types: int  # V
    #: Segments held in memory instead of the folder, by kind and bucket.
    held: dict[tuple[int, int], np.ndarray] = field(default_factory=dict)

    def _segment(self, kind: int, bucket: int) -> np.ndarray:
        return self.held[kind, bucket] if self.held else _open(f"{self.folder}/{kind}-{bucket}")

    def levels(self, keys: np.ndarray, kind: int) -> np.ndarray:
        """Quantised counts by repeated probes of rising levels."""
        order = np.argsort(keys, kind="stable")  # buckets rise with the key
        keys, out = keys[order], np.zeros(len(keys), np.int64)
        owner = bucket_of(keys, self.buckets)
        first = np.flatnonzero(np.diff(owner, prepend=-1))
        data = [self._segment(kind, k) for k in owner[first].tolist()]
        counts = np.diff(np.append(first, len(keys)))
        bits = np.repeat(np.array([8 * len(d) for d in data], np.int64), counts)
        place = np.repeat(np.arange(len(first)), counts)
        left = np.flatnonzero(bits > 0)
        for level in range(1, len(_LEVELS)):
            if not len(left):
                break
            own = place[left]
            begins = np.flatnonzero(np.diff(own, prepend=-1))
            spans = list(zip(begins.tolist(), np.append(begins[1:], len(own)).tolist(), [data[k] for k in own[begins].tolist()], strict=True))
            hit = np.ones(len(left), bool)
            for at in positions(keys[left], level, bits[left]):
                byte, found = at >> 3, np.empty(len(at), np.uint8)
                for b, e, d in spans:
                    found[b:e] = d[byte[b:e]]
                hit &= (found >> (at & 7).astype(np.uint8) & 1).astype(bool)
            left = left[hit]
            out[left] = level
        back = np.empty_like(out)
        back[order] = out
        return back

    def log10(self, keys: np.ndarray, pairs: np.ndarray) -> np.ndarray:
        """log10 probability of every token, given the one before it."""
        words, place = np.unique(np.append(keys, END), return_inverse=True)
        levels = self.levels(words, WORD)
        both, pair_place = np.unique(pairs, return_inverse=True)
        joint = least_count(self.levels(both, PAIR), PAIR)[pair_place]
        most = most_count(levels, WORD)[place]
        before = np.concatenate([most[-1:], most[:-2]])[: len(keys)]  # before a text stands the end
        single = (np.minimum(least_count(levels, WORD)[place[:-1]], self.tokens) + 1) / (self.tokens + self.types + 1)
        return np.log10((np.minimum(joint, before) + PRIOR * single) / (before + PRIOR))


_SUMS = "kind int, bucket int, keys binary, counts binary"


def _partial_sums(train: DataFrame, buckets: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        n = 0

        def flush() -> Iterator[pa.RecordBatch]:
            keys = np.concatenate(held)
            for kind, found in ((WORD, keys), (PAIR, pairs_of(keys))):
                found, counts = np.unique(found, return_counts=True)
                owner = bucket_of(found, buckets)
                first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
                ends = np.append(first[1:], len(found))
                counts = counts.astype(np.uint32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([kind] * len(first), pa.int32()), pa.array(owner[first], pa.int32()), pa.array([found[b:e].tobytes() for b, e in zip(first, ends, strict=True)], pa.binary()), pa.array([counts[b:e].tobytes() for b, e in zip(first, ends, strict=True)], pa.binary())],
                    names=["kind", "bucket", "keys", "counts"],
                )

        for batch in batches:
            for part in slices(batch):
                keys, _ = tokens(part.column("text"))
                held.append(keys)
                n += len(keys)
                if n >= FLUSH_TOKENS:
                    yield from flush()
                    held, n = [], 0
        if n:
            yield from flush()

    return train.select("text").mapInArrow(run, _SUMS)


_MERGED = "kind int, bucket int, segment binary, types long, tokens long, above array<long>, keys binary, counts binary"


def _merge(buckets: int):  # noqa: ANN202
    def run(found: pd.DataFrame) -> pd.DataFrame:
        kind, bucket = int(found.kind.iloc[0]), int(found.bucket.iloc[0])
        keys = np.concatenate([np.frombuffer(x, U64) for x in found["keys"]])
        counts = np.concatenate([np.frombuffer(x, np.uint32) for x in found["counts"]]).astype(np.int64)
        order = np.argsort(keys)
        keys, counts = keys[order], counts[order]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        keys, counts = keys[first], np.add.reduceat(counts, first)
        segment = make_segment(keys, counts, kind)
        above = [int((counts >= 1 << k).sum()) for k in range(48)]
        own = kind == WORD
        return pd.DataFrame({"kind": [kind], "bucket": [bucket], "segment": [segment], "types": [len(keys)], "tokens": [int(counts.sum())], "above": [above], "keys": [keys.tobytes() if own else None], "counts": [counts.tobytes() if own else None]})

    return run


def _stored(buckets: int, folder: str):  # noqa: ANN202
    """As ``_merge``, with each segment in a file of the folder and not in the row."""
    merge = _merge(buckets)

    def run(found: pd.DataFrame) -> pd.DataFrame:
        out = merge(found)
        files, base = pafs.FileSystem.from_uri(folder if "://" in folder else "file://" + _local(folder))
        files.create_dir(base)
        # a task that runs again makes the same bytes under a name of its own, so either file may take the place
        name = f"{base}/{out['kind'].iloc[0]}-{out['bucket'].iloc[0]}"
        own = f"{name}.{np.random.SeedSequence().entropy:x}"
        with files.open_output_stream(own) as file:
            file.write(out.segment.iloc[0])
        try:
            files.move(own, name)
        except OSError:
            if files.get_file_info(name).type == pafs.FileType.NotFound:
                raise
            files.delete_file(own)
        return out.assign(segment=None)

    return run


def _word_counts(merged: DataFrame, low: int, high: int | None) -> DataFrame:
    """(word, c) of the words with low <= c < high."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, c in zip(batch.column("keys").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                keys, counts = np.frombuffer(k, np.int64), np.frombuffer(c, np.int64)
                keep = (counts >= low) & (counts < (high or np.iinfo(np.int64).max))
                yield pa.RecordBatch.from_arrays([pa.array(keys[keep]), pa.array(counts[keep])], names=["word", "c"])

    return merged.filter(F.col("kind") == WORD).select("keys", "counts").mapInArrow(run, "word long, c long")


def fit(train: DataFrame) -> tuple[Model, DataFrame]:
    """The model of all these texts, and the exact counts (word, c) of the words that it does not carry."""
    spark = train.sparkSession
    size = train.agg(F.coalesce(F.sum(F.octet_length(text_or_empty())), F.lit(0)).alias("n")).first()["n"]
    buckets = max(32, int(size) // BUCKET_BYTES)
    sums = _partial_sums(train, buckets).groupBy("kind", "bucket")
    folder = new_path(spark, "lm-filter")
    merged = materialize(sums.applyInPandas(_stored(buckets, folder), _MERGED), "lm-buckets")
    words = merged.filter(F.col("kind") == WORD)
    total = words.agg(F.sum("types").alias("types"), F.sum("tokens").alias("tokens"), *[F.sum(F.get("above", F.lit(k))).alias(f"a{k}") for k in range(48)]).first()
    level = next((k for k in range(48) if (total[f"a{k}"] or 0) <= HOT), 48)
    hot = _word_counts(merged, 1 << level, None).toPandas().sort_values("word")  # at most HOT rows
    keys = hot.word.to_numpy().astype(np.int64).view(U64)
    order = np.argsort(keys)
    model = Model(buckets, folder, keys[order], hot.c.to_numpy()[order], total["tokens"] or 0, total["types"] or 0)
    return model, _word_counts(merged, 1, 1 << level)


_ROWS = "row long, word long, tf long, n_tokens long, known long, sum double, score double"


def score(docs: DataFrame, model: Model, rare: DataFrame) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score of every row."""
    state = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = state.value
        row = TaskContext.get().partitionId() << 40
        none = pa.nulls
        for batch in batches:
            for part in slices(batch):
                keys, begins = tokens(part.column("text"))
                n = len(part)
                owner = np.repeat(np.arange(n), np.diff(begins))
                own = np.add.reduceat(m.log10(keys, pairs_of(keys)), begins[:-1])
                at = np.minimum(np.searchsorted(m.hot_keys, keys), max(0, len(m.hot_keys) - 1))
                hot = m.hot_keys[at] == keys if len(m.hot_keys) else np.zeros(len(keys), bool)
                value = np.where(hot, np.log10(m.hot_counts[at] + 1.0) if len(m.hot_keys) else 0.0, 0.0)
                rows = row + np.arange(n)
                row += n
                yield pa.RecordBatch.from_arrays(
                    # one row for the text itself, under a key that spreads such rows; it counts no word
                    [part.column("doc_id"), pa.array(rows), pa.array(mix64(rows.astype(U64)).view(np.int64)), pa.array(np.zeros(n, np.int64)), pa.array(np.diff(begins)), pa.array(np.add.reduceat(hot.astype(np.int64), begins[:-1])), pa.array(np.add.reduceat(value, begins[:-1])), pa.array(own)],
                    schema=schema,
                )
                words, place = np.unique(keys[~hot], return_inverse=True)
                found, tf = np.unique(owner[~hot] * max(1, len(words)) + place, return_counts=True)
                doc, word = np.divmod(found, max(1, len(words)))
                k = len(found)
                yield pa.RecordBatch.from_arrays([none(k, part.column("doc_id").type), pa.array(rows[doc]), pa.array(words[word].view(np.int64)), pa.array(tf), none(k, pa.int64()), none(k, pa.int64()), none(k, pa.float64()), none(k, pa.float64())], schema=schema)

    doc_id = docs.schema["doc_id"].dataType.simpleString()
    names = [x.split()[0] for x in _ROWS.split(", ")]
    kind = {"long": pa.int64(), "bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string()}
    schema = pa.schema([("doc_id", kind[doc_id]), *[(k, kind[x.split()[1]]) for k, x in zip(names, _ROWS.split(", "), strict=True)]])
    rows = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {doc_id}, {_ROWS}")
    joined = rows.join(rare.hint("merge"), "word", "left")
    c = F.coalesce("c", F.lit(0).cast("long"))
    out = joined.groupBy("row").agg(
        F.max("doc_id").alias("doc_id"), F.max("n_tokens").alias("n_tokens"),
        (F.max("known") + F.sum(F.when(c > 0, F.col("tf")).otherwise(0))).alias("n_known"),
        (F.max("sum") + F.sum(F.col("tf") * F.log10(c + F.lit(1.0)))).alias("sum"), F.max("score").alias("score"),
    )
    base = F.col("sum") - F.col("n_tokens") * float(np.log10(model.tokens + model.types + 1))
    return out.select("doc_id", "n_tokens", "n_known", F.lit(int(model.tokens)).cast("long").alias("train_tokens"), base.alias("base_score"), "score")


def query(docs: DataFrame) -> DataFrame:
    model, rare = fit(docs.filter(training(F.col("doc_id"))))
    out = score(docs, model, rare).withColumn("held_out", ~training(F.col("doc_id")))
    return out.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
