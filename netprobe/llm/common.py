"""Pieces that several operators share: tables, shared folders, vectorised words."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from netprobe.functions.tables import materialize, new_path, shared_dir  # noqa: F401

#: The white space of all word rules: space and tab to carriage return.
WS_CHARS = " \t\n\x0b\x0c\r"
WS_CLASS = "[ \\t-\\r]"
U64 = np.uint64


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def words_of(text: Column) -> Column:
    """Array of the words ``[^\\x20\\x09-\\x0D]+`` of a non-null text."""
    trimmed = F.trim(text, F.lit(WS_CHARS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, WS_CLASS + "+"))


def once(column: Column) -> Column:
    """The same value, made in a projection that the optimizer neither merges into later ones nor pushes
    filters through: without this, a column used inside a lambda may be computed again for every element."""
    return F.when(F.monotonically_increasing_id() >= 0, column)


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, on arrays of uint64."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def stream64(n: int, seed: int) -> np.ndarray:
    """n pseudorandom uint64, the same everywhere; seeds give streams apart for n up to 2^32."""
    with np.errstate(over="ignore"):
        return mix64((np.arange(1, n + 1, dtype=U64) + (U64(seed) << U64(32))) * U64(0x9E3779B97F4A7C15))


_IS_WS = np.zeros(256, bool)
_IS_WS[[32, 9, 10, 11, 12, 13]] = True
_BYTE = stream64(256, 11)
_BYTE_LOWER = _BYTE.copy()
_BYTE_LOWER[65:91] = _BYTE[97:123]
_P = 0x9E3779B97F4A7C15 | 1
_P_INV = pow(_P, -1, 1 << 64)
_BLOCK = 1 << 18


def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, U64)
    out[0] = 1
    done = 1
    while done < n:
        step = min(done, n - done)
        out[done : done + step] = out[:step] * U64(pow(base, done, 1 << 64))
        done += step
    return out


_POW, _POW_INV = _powers(_P, _BLOCK), _powers(_P_INV, _BLOCK)


def utf8(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (len + 1) of a string array; nulls are empty."""
    if array.null_count:
        array = array.fill_null("")
    kind = np.int64 if pa.types.is_large_string(array.type) else np.int32
    offsets = np.frombuffer(array.buffers()[1], kind)[array.offset : array.offset + len(array) + 1].astype(np.int64)
    raw = array.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def word_hashes(array: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash of every word (A-Z lower-cased), and where each text's words begin (len + 1).

    A polynomial over a random table of bytes, from prefix sums: no Python object per word."""
    data, offsets = utf8(array)
    inside = ~_IS_WS[data]
    before = np.empty_like(inside)
    before[:1] = False
    before[1:] = inside[:-1]
    firsts = offsets[:-1][offsets[:-1] < offsets[1:]]
    before[firsts] = False  # a text begins a word of its own
    starts = np.flatnonzero(inside & ~before)
    after = np.empty_like(inside)
    after[-1:] = False
    after[:-1] = inside[1:]
    after[firsts[firsts > 0] - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    del inside, before, after
    table = _BYTE_LOWER if lower else _BYTE
    out = np.empty(len(starts), U64)
    i = 0
    with np.errstate(over="ignore"):
        while i < len(starts):
            j = max(i + 1, int(np.searchsorted(ends, starts[i] + _BLOCK, "right")))
            lo, n = starts[i], int(ends[j - 1] - starts[i])
            power, inverse = (_POW, _POW_INV) if n <= _BLOCK else (_powers(_P, n), _powers(_P_INV, n))
            sums = np.zeros(n + 1, U64)
            np.cumsum(table[data[lo : lo + n]] * power[:n], out=sums[1:])
            s, e = starts[i:j] - lo, ends[i:j] - lo
            out[i:j] = mix64((sums[e] - sums[s]) * inverse[s] + (e - s).astype(U64) * U64(0xD6E8FEB86659FD93))
            i = j
    return out, np.searchsorted(starts, offsets)


def slices(batch: pa.RecordBatch, column: str = "text", most_bytes: int = 4 << 20):
    """Cut a record batch into runs of rows with about ``most_bytes`` of text, at least one row each."""
    _, offsets = utf8(batch.column(batch.schema.get_field_index(column)))
    i = 0
    while i < len(batch):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most_bytes, "right")) - 1)
        yield batch.slice(i, j - i)
        i = j
