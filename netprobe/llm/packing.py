"""Packing documents into training windows by lexical retrieval.

1. Texts become ids, written to the shared folder; the same pass counts each term's document frequency.
2. Documents are sorted over all tasks by their most telling terms that others share, so that lexical
   neighbours meet wherever they were stored; a term with more documents than a shard holds is ordered by
   the next terms, then by hash, so no hot term or group of copies has to fit one task.
3. Each task packs its documents shard by shard. A shard, at most ``SHARD_DOCS`` documents and about
   ``SHARD_TOKENS`` tokens, has a BM25 inverted index with the counts of the whole corpus. A document's full
   windows are sequences of their own; what is left of it is a unit, found by all terms of the whole
   document. A seed (the first unit not used up) scores all units by all its own terms; unused ones fill the
   seed's window from the best on. The last one is cut where the window ends, and its rest seeds the next window.
   A shard's last window is filled on by the next shard, so only a task's last one is short; it is cut
   into powers of two, which need no padding. Tasks hold ``PART_TOKENS`` tokens or more, so these are rare.

Defined results: null or empty texts are the end id alone; a document longer than a shard is a shard of
its own; equal documents are packed each for itself, ties in score go by place; rows without a doc_id are
packed like others; an empty table gives no pieces; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netprobe.llm.common import materialize, slices, utf8
from netprobe.llm.tokens import encoder, vocabulary_path

WINDOW, END_ID = 1024, 0
#: Bounds of a shard, and the least tokens of a task (as far as the shuffle's partitions allow).
SHARD_DOCS, SHARD_TOKENS, PART_TOKENS = 1024, 1 << 19, 1 << 21
K1, B = 1.2, 0.75
#: Documents are sorted by so many of their most telling terms.
ROUTE_TERMS = 3
#: Terms in more than one unit of so many are scored for all seeds at once by a matrix product.
COMMON = 8


class Corpus:
    """What BM25 needs of all documents: their number, mean length and each term's document frequency."""

    def __init__(self, n: int, mean: float, df: np.ndarray) -> None:
        self.mean, self.df = max(mean, 1), df
        self.idf = np.log(1 + (n - df + 0.5) / (df + 0.5))

    def weight(self, terms: np.ndarray, tf: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        return self.idf[terms] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * lengths / self.mean))


def counted(ids: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """document, term, tf of every term of every document, by document and term."""
    small = ids.dtype.itemsize <= 2 and len(begins) <= 1 << 16
    kind, shift = (np.uint32, 16) if small else (np.uint64, 32)
    keys = (np.repeat(np.arange(len(begins) - 1, dtype=kind), np.diff(begins)) << kind(shift)) | ids.astype(kind)
    keys.sort()
    new = np.ones(len(keys), bool)
    np.not_equal(keys[1:], keys[:-1], out=new[1:])
    first = np.flatnonzero(new)
    keys = keys[first]
    return (keys >> kind(shift)).astype(np.int64), (keys & kind((1 << shift) - 1)).astype(np.int64), np.diff(np.append(first, len(ids)))


def routes(ids: np.ndarray, begins: np.ndarray, corpus: Corpus) -> np.ndarray:
    """Each document's most telling terms that other documents have too, in order; -1 where there are no more."""
    doc, term, tf = counted(ids, begins)
    weight = corpus.weight(term, tf, np.diff(begins)[doc])
    weight[corpus.df[term] < 2] = 0
    first = np.flatnonzero(np.diff(doc, prepend=-1))
    owner, counts = doc[first], np.diff(np.append(first, len(doc)))
    out = np.full((len(begins) - 1, ROUTE_TERMS), -1, np.int64)
    for k in range(ROUTE_TERMS if len(first) else 0):
        best = np.maximum.reduceat(weight, first)
        at = np.flatnonzero((weight == np.repeat(best, counts)) & (weight > 0))
        at = at[np.flatnonzero(np.diff(doc[at], prepend=-1))]  # of equal ones the least term
        out[doc[at], k] = term[at]
        weight[at] = 0
    return out


class Index:
    """BM25 postings of a shard's units: by term, the units and their weights. Without a corpus, the units are it."""

    def __init__(self, ids: np.ndarray, begins: np.ndarray, corpus: Corpus | None = None) -> None:
        self.n = n = len(begins) - 1
        unit, term, tf = counted(ids, begins)
        lengths = np.diff(begins)
        self.terms, rank, df = np.unique(term, return_inverse=True, return_counts=True)
        if corpus is None:
            every = np.zeros(int(self.terms.max(initial=0)) + 1, np.int64)
            every[self.terms] = df
            corpus = Corpus(n, lengths.mean(), every)
        weight = corpus.weight(term, tf, lengths[unit])
        common = df * COMMON > n
        dense = common[rank]
        place = (np.cumsum(common) - 1)[rank[dense]]
        has, held = np.zeros((n, int(common.sum()))), np.zeros((n, int(common.sum())))
        has[unit[dense], place], held[unit[dense], place] = 1, weight[dense]
        #: score of every unit (columns) for every seed (rows), by the common terms
        self.base = has @ held.T
        rank, unit, weight = rank[~dense], unit[~dense], weight[~dense]
        self.own = rank  # by unit
        self.own_first = np.searchsorted(unit, np.arange(n + 1))
        order = np.argsort(rank, kind="stable")
        self.unit, self.weight = unit[order], weight[order]
        self.first = np.concatenate([[0], np.cumsum(np.where(common, 0, df))])

    def scores(self, seed: int) -> np.ndarray:
        """BM25 of every unit for the seed's terms, each counted once."""
        own = self.own[self.own_first[seed] : self.own_first[seed + 1]]
        begin, size = self.first[own], self.first[own + 1] - self.first[own]
        ends = np.cumsum(size)
        at = np.repeat(begin - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)
        return np.round(self.base[seed] + np.bincount(self.unit[at], self.weight[at], self.n), 9)


Piece = tuple[int, int, int]


def fill(sizes: np.ndarray, index: Index, window: int, begun: list[Piece] | None = None) -> Iterator[list[Piece]]:
    """Windows as lists of (unit, begin, end), all full but the last. ``begun`` (of other shards) opens the first."""
    n = len(sizes)
    unused, begin, left = np.ones(n, bool), np.zeros(n, np.int64), n
    out = list(begun or ())
    space, seed = window - sum(e - b for _, b, e in out), 0
    scores: np.ndarray | None = None
    while left:
        if scores is None:
            unit = seed
            scores = index.scores(seed)
        else:
            unit = int(np.argmax(np.where(unused, scores, -1.0)))
        b = int(begin[unit])
        take = min(space, int(sizes[unit]) - b)
        out.append((unit, b, b + take))
        begin[unit] += take
        space -= take
        if b + take == sizes[unit]:
            unused[unit] = False
            left -= 1
        if not space:
            yield out
            out, space, scores = [], window, None
            seed = unit if unused[unit] else int(np.argmax(unused))
    if out:
        yield out


def in_powers(pieces: list[Piece]) -> Iterator[list[Piece]]:
    """A window as sequences whose lengths are powers of two, the longest first."""
    total = sum(e - b for _, b, e in pieces)
    queue = list(pieces)
    for power in range(total.bit_length() - 1, -1, -1):
        if not total >> power & 1:
            continue
        space, out = 1 << power, []
        while space:
            unit, b, e = queue.pop(0)
            take = min(space, e - b)
            out.append((unit, b, b + take))
            space -= take
            if take < e - b:
                queue.insert(0, (unit, b + take, e))
        yield out


_FIELDS = [("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())]


def ids_of(column: pa.Array, dtype: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """All ids of binary rows one after another, and where each row's begin (len + 1)."""
    data, offsets = utf8(column)
    return np.frombuffer(data.tobytes(), dtype), offsets // dtype.itemsize


def _encoded(docs: DataFrame, vocabulary: str, end_id: int) -> DataFrame:
    """doc_id and ids (the end id last) of every row; and a row (term, n) for each term and task: n of the
    task's documents hold it. Term -1 counts documents, -2 all ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary)
        df, n, total, kind = np.zeros(encode.size, np.int64), 0, 0, None
        for batch in batches:
            for part in slices(batch):
                ids, begins = encode.encode(part.column("text"))
                ids, begins = np.insert(ids, begins[1:], end_id), begins + np.arange(len(begins))
                df += np.bincount(counted(ids, begins)[1], minlength=encode.size)
                n, total, kind = n + len(part), total + len(ids), part.column("doc_id").type
                own = pa.Array.from_buffers(pa.large_binary(), len(part), [None, pa.py_buffer((begins * ids.itemsize).astype(np.int64)), pa.py_buffer(ids.tobytes())])
                none = pa.nulls(len(part), pa.int64())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), own.cast(pa.binary()), none, none], names=["doc_id", "ids", "term", "n"])
        if n:
            at = np.flatnonzero(df)
            terms, counts = np.concatenate([[-2, -1], at]), np.concatenate([[total, n], df[at]])
            yield pa.RecordBatch.from_arrays([pa.nulls(len(terms), kind), pa.nulls(len(terms), pa.binary()), pa.array(terms), pa.array(counts)], names=["doc_id", "ids", "term", "n"])

    doc_id = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {doc_id}, ids binary, term long, n long")


def _corpus(rows: DataFrame, size: int) -> tuple[Corpus, int]:
    """The counts of all documents, and the number of all ids."""
    found = rows.filter("term IS NOT NULL").groupBy("term").agg(F.sum("n").alias("n")).toPandas()  # at most the vocabulary
    count = dict(zip(found.term.tolist(), found.n.tolist(), strict=True))
    total, n = count.pop(-2, 0), count.pop(-1, 0)
    df = np.zeros(size, np.int64)
    df[list(count)] = list(count.values())
    return Corpus(n, total / max(n, 1), df), total


def _routed(ids: DataFrame, state, dtype: np.dtype) -> DataFrame:  # noqa: ANN001
    names = [f"t{i}" for i in range(ROUTE_TERMS)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "ids"):
                found = routes(*ids_of(part.column("ids"), dtype), state.value)
                yield pa.RecordBatch.from_arrays([*part.columns, *[pa.array(found[:, i].astype(np.int32)) for i in range(ROUTE_TERMS)]], names=[*part.schema.names, *names])

    return ids.mapInArrow(run, f"doc_id {ids.schema['doc_id'].dataType.simpleString()}, ids binary, " + ", ".join(f"{k} int" for k in names))


class _Packer:
    """Packs a task's documents, shard by shard, into rows of pieces."""

    def __init__(self, corpus: Corpus, window: int, sequence: int, with_ids: bool) -> None:
        self.corpus, self.window, self.sequence, self.with_ids = corpus, window, sequence, with_ids
        #: Pieces that open the next shard's first window: (document, begin, end); the document with its id and all ids.
        self.begun: list[tuple[tuple, int, int]] = []
        self.rows: list[tuple] = []

    def _put(self, pieces: list[tuple[tuple, int, int]]) -> None:
        offset = 0
        for (doc_id, ids), b, e in pieces:
            own = ids[b:e].astype("<u4")
            self.rows.append((doc_id, b, e - b, zlib.crc32(own), len(ids), self.sequence, offset, *[own.tobytes()] * self.with_ids))
            offset += e - b
        self.sequence += 1

    def shard(self, docs: list[tuple]) -> None:
        """``docs``: (doc_id, ids). Rows follow for all windows but the last, if it is short."""
        units = []
        for doc in docs:
            full = len(doc[1]) // self.window * self.window
            for b in range(0, full, self.window):
                self._put([(doc, b, b + self.window)])
            if full < len(doc[1]):
                units.append((doc, full))
        if not units:
            return
        ids = np.concatenate([doc[1] for doc, _ in units])
        begins = np.concatenate([[0], np.cumsum([len(doc[1]) for doc, _ in units])])
        sizes = np.array([len(doc[1]) - full for doc, full in units])
        opened, self.begun = self.begun, []
        marked = [(-1 - i, b, e) for i, (_, b, e) in enumerate(opened)]
        for pieces in fill(sizes, Index(ids, begins, self.corpus), self.window, marked):
            own = [opened[-1 - u] if u < 0 else (units[u][0], units[u][1] + b, units[u][1] + e) for u, b, e in pieces]
            if sum(e - b for _, b, e in own) == self.window:
                self._put(own)
            else:
                self.begun = own

    def end(self) -> None:
        if self.begun:
            for pieces in in_powers([(i, b, e) for i, (_, b, e) in enumerate(self.begun)]):
                self._put([(self.begun[i][0], b, e) for i, b, e in pieces])
            self.begun = []


def pack(docs: DataFrame, window: int = WINDOW, vocabulary: str | None = None, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids) of every piece."""
    spark, vocabulary = docs.sparkSession, vocabulary or vocabulary_path()
    dtype, size = encoder(vocabulary).dtype, encoder(vocabulary).size
    rows = materialize(_encoded(docs, vocabulary, end_id), "pack-ids")
    corpus, total = _corpus(rows, size)
    state = spark.sparkContext.broadcast(corpus)  # a number for each term of the vocabulary
    parts = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), total // PART_TOKENS))
    order = [*[f"t{i}" for i in range(ROUTE_TERMS)], "_h"]
    dealt = _routed(rows.filter("term IS NULL").select("doc_id", "ids"), state, dtype).withColumn("_h", F.xxhash64("doc_id", F.crc32("ids")))
    dealt = dealt.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    doc_id = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = _Packer(state.value, window, TaskContext.get().partitionId() << 40, with_ids)
        held: list[tuple] = []
        tokens, kind = 0, None

        def rows_of() -> Iterator[pa.RecordBatch]:
            columns = list(zip(*packer.rows, strict=True))
            packer.rows = []
            arrays = [pa.array(c, t) for c, t in zip(columns, [kind, *[t for _, t in _FIELDS], *[pa.binary()] * with_ids], strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", *[k for k, _ in _FIELDS], *["ids"] * with_ids])

        for batch in batches:
            for part in slices(batch, "ids"):
                kind = part.column("doc_id").type
                ids, begins = ids_of(part.column("ids"), dtype)
                for i, own in enumerate(part.column("doc_id").to_pylist()):
                    n = int(begins[i + 1] - begins[i])
                    if held and (len(held) == SHARD_DOCS or tokens + n > SHARD_TOKENS):
                        packer.shard(held)
                        held, tokens = [], 0
                        if packer.rows:
                            yield from rows_of()
                    held.append((own, ids[begins[i] : begins[i + 1]]))
                    tokens += n
        if held:
            packer.shard(held)
        packer.end()
        if packer.rows:
            yield from rows_of()

    return dealt.select("doc_id", "ids").mapInArrow(run, f"doc_id {doc_id}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids binary" * with_ids)


def query(docs: DataFrame) -> DataFrame:
    return pack(docs)
