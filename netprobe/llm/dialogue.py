"""Repair of conversation structure: cheapest edits that make the roles alternate, as a grammar-compressed
dynamic program.

A row is one symbol: the initial of its role (s, u, a, other) and its first fault. Sequences of symbols
are compressed by Re-Pair (the most frequent pair of neighbours becomes a rule, again and again). Each
rule has one transfer matrix over the states of the automaton ``(s?(ua)+)?``, least cost and audit
text from every state to every other, the min-plus product of its two parts' matrices; audits are ropes
that share their parts. Conversations share the rules.

The product keeps the least audit: two cheapest edit texts of the same rows between the same states
differ before either ends (one that went on would cost more, by its inserts), so least parts make the
least whole.

Rows are sorted over all tasks by (conv_id, turn, role, text), so a conversation of any size is spread
over several; each task multiplies its own pieces, and the few pieces of a cut conversation are
multiplied in their order. The digest of a repaired text is that of a stream, row by row.

Defined results: a null role, text, conv_id or turn is a space in damage and text; rows without a
conv_id are one conversation; rows of the same turn go by role, then text, after the damage; a repeated
row repeats (and is a duplicate); other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netprobe.llm.common import WS_CHARS, materialize, read_table

REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: A row of damage in so many.
DAMAGE = 20
#: States: nothing yet, after s, after u, after a; a repaired conversation ends in the first or the last.
NOTHING, S, U, A = range(4)
_STEP = {("s", NOTHING): S, ("u", NOTHING): U, ("u", S): U, ("u", A): U, ("a", U): A}
INITIALS = "sua"
#: Symbols: three for each kind of initial (sound, truncated) and one for rows that must go.
SYMBOLS = 2 * (len(INITIALS) + 1) + 1
MUST_GO = SYMBOLS - 1
#: Symbols that one grammar compresses, the least use of a rule, and the most rules of a grammar.
PIECE, LEAST_USE, MOST_RULES = 1 << 20, 4, 512
_CACHED = 1 << 16
_M = (1 << 127) - 1
_BASE = 0x9E3779B97F4A7C15F39CC0605CEDC835 % _M


class Rope:
    """A text as a tree of shared parts, with the hash that tells parts of equal text."""

    __slots__ = ("left", "right", "text", "length", "hash", "power")

    def __init__(self, text: str = "", left: Rope | None = None, right: Rope | None = None) -> None:
        self.text, self.left, self.right = text, left, right
        if left is None:
            self.length, self.hash, self.power = len(text), 0, pow(_BASE, len(text), _M)
            for c in text:
                self.hash = (self.hash * _BASE + ord(c)) % _M
        else:
            self.length = left.length + right.length
            self.hash, self.power = (left.hash * right.power + right.hash) % _M, left.power * right.power % _M

    def __add__(self, other: Rope) -> Rope:
        if not other.length:
            return self
        if not self.length:
            return other
        if self.length + other.length <= 32:
            return Rope(str(self) + str(other))
        return Rope(left=self, right=other)

    def leaves(self) -> Iterator[str]:
        stack = [self]
        while stack:
            r = stack.pop()
            if r.left is None:
                yield r.text
            else:
                stack += [r.right, r.left]

    def __str__(self) -> str:
        return "".join(self.leaves())

    def __lt__(self, other: Rope) -> bool:
        """By code points; equal parts are passed over by their hashes."""
        one, two = [self], [other]
        while one and two:
            a, b = one.pop(), two.pop()
            if a.length == b.length and a.hash == b.hash:
                continue
            if a.left is not None and (b.left is None or a.length >= b.length):
                one += [a.right, a.left]
                two.append(b)
            elif b.left is not None:
                two += [b.right, b.left]
                one.append(a)
            else:
                n = min(a.length, b.length)
                if a.text[:n] != b.text[:n]:
                    return a.text[:n] < b.text[:n]
                if a.length > n:
                    one.append(Rope(a.text[n:]))
                if b.length > n:
                    two.append(Rope(b.text[n:]))
        return not any(r.length for r in one) and any(r.length for r in two)


#: From state to state: (cost, audit), or None.
Entry = tuple[int, Rope] | None
Transfer = list[list[Entry]]


def least(one: Entry, two: Entry) -> Entry:
    if one is None or two is None:
        return one or two
    if one[0] != two[0]:
        return min(one, two, key=lambda e: e[0])
    return two if two[1] < one[1] else one


def product(left: Transfer, right: Transfer) -> Transfer:
    """Both in turn."""
    out: Transfer = [[None] * 4 for _ in range(4)]
    for x in range(4):
        for y in range(4):
            if (first := left[x][y]) is not None:
                for z in range(4):
                    if (then := right[y][z]) is not None and ((now := out[x][z]) is None or first[0] + then[0] <= now[0]):
                        out[x][z] = least(now, (first[0] + then[0], first[1] + then[1]))
    return out


def _unit() -> Transfer:
    return [[(0, Rope()) if x == y else None for y in range(4)] for x in range(4)]


def _inserts() -> Transfer:
    """Up to two inserts: more would only return to a state."""
    one: Transfer = [[None] * 4 for _ in range(4)]
    for role, x in _STEP:
        if role != "s":
            one[x][_STEP[role, x]] = (INSERT, Rope("I"))
    some = _unit()
    for power in (one, product(one, one)):
        some = [[least(some[x][y], power[x][y]) for y in range(4)] for x in range(4)]
    return some


INSERTS = _inserts()


def _row(symbol: int) -> Transfer:
    out: Transfer = [[(DELETE, Rope("D")) if x == y else None for y in range(4)] for x in range(4)]
    if symbol != MUST_GO:
        initial, extra = (INITIALS + " ")[symbol // 2], symbol % 2 * TRUNCATED
        for (role, x), y in _STEP.items():
            if role == initial:
                out[x][y] = least(out[x][y], (extra, Rope("K")))
            elif role != "s":
                out[x][y] = least(out[x][y], (extra + REROLE, Rope("R")))
    return product(INSERTS, out)


ROWS = [_row(s) for s in range(SYMBOLS)]


class Grammar:
    """Re-Pair over many sequences at once, and the transfer matrix of every symbol."""

    def __init__(self) -> None:
        self.matrices: list[Transfer] = list(ROWS)
        self.pairs: dict[tuple[int, int], int] = {}
        self.known: dict[bytes, Transfer] = {}

    def rule(self, a: int, b: int) -> int:
        if (a, b) not in self.pairs:
            self.pairs[a, b] = len(self.matrices)
            self.matrices.append(product(self.matrices[a], self.matrices[b]))
        return self.pairs[a, b]

    def compress(self, flat: np.ndarray, most: int = MOST_RULES) -> np.ndarray:
        """``flat``: symbols, with -1 after each sequence. Rules are made bottom-up, so a rule's parts are known."""
        flat = flat.astype(np.int64)
        for _ in range(most):
            whole = (flat[:-1] >= 0) & (flat[1:] >= 0)
            if not whole.any():
                break
            size = int(flat.max()) + 1
            codes = flat[:-1][whole] * size + flat[1:][whole]
            values, counts = np.unique(codes, return_counts=True)
            best = int(np.argmax(counts))
            if counts[best] < LEAST_USE:
                break
            a, b = divmod(int(values[best]), size)
            at = np.flatnonzero((flat[:-1] == a) & (flat[1:] == b))
            if a == b:  # of a run, every second place
                run = np.cumsum(np.r_[True, np.diff(at) > 1])
                first = np.r_[True, run[1:] != run[:-1]]
                at = at[(at - at[first][run - 1]) % 2 == 0]
            flat[at] = self.rule(a, b)
            flat = np.delete(flat, at + 1)
        return flat

    def evaluate(self, sequences: list[bytes]) -> list[Transfer]:
        """The transfer matrix of each sequence of symbols (one byte a row)."""
        fresh = list(dict.fromkeys(s for s in sequences if s not in self.known))
        if len(self.known) + len(fresh) > _CACHED or len(self.matrices) > _CACHED:
            self.__init__()
            fresh = list(dict.fromkeys(sequences))
        if fresh:
            flat = np.frombuffer(b"".join(s + b"\xff" for s in fresh), np.uint8).astype(np.int64)
            flat = self.compress(np.where(flat == 255, -1, flat))
            ends = np.flatnonzero(flat < 0)
            for s, end, begin in zip(fresh, ends.tolist(), [0, *(ends[:-1] + 1).tolist()], strict=True):
                parts = [self.matrices[c] for c in flat[begin:end].tolist()]
                while len(parts) > 1:  # neighbours first: ropes stay flat
                    parts = [product(*parts[i : i + 2]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
                self.known[s] = parts[0] if parts else _unit()
        return [self.known[s] for s in sequences]


def best(transfer: Transfer) -> tuple[int, str]:
    """The cheapest repair of a whole conversation."""
    row = product(transfer, INSERTS)[NOTHING]
    cost, audit = least(row[NOTHING], row[A])
    return cost, str(audit)


def damaged(table: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) after the planned damage."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    digest = F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn")).cast("binary")) % DAMAGE
    own = table.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), blank("role").alias("role"), blank("text").alias("text"), digest.alias("_d"))
    text = F.when(F.col("_d") == 1, "").when(F.col("_d") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("_d") == 4, "user").otherwise(F.col("role"))
    times = F.when(F.col("_d") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return own.filter("_d <> 0").select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(times).alias("_t")).drop("_t")


def with_faults(rows: DataFrame) -> DataFrame:
    """Adds symbol, blank, truncated, and whether the row's role and text came up in an earlier turn."""
    bare = F.trim("text", F.lit(WS_CHARS))
    blank = bare == ""
    truncated = ~F.substring(bare, -1, 1).isin(".", "!", "?")
    # turns from 0 up, null before all: compared as (known, turn)
    when = F.struct(F.col("turn").isNotNull().alias("k"), F.coalesce("turn", F.lit(0).cast("long")).alias("t"))
    key = ["conv_id", "role", "_text"]
    own = rows.withColumn("_text", F.sha2(F.col("text").cast("binary"), 256)).withColumn("_when", when)
    own = own.withColumn("conv_id", F.struct(F.col("conv_id").isNull().alias("none"), F.coalesce("conv_id", F.lit(0).cast("long")).alias("id")))
    first = own.groupBy(*key).agg(F.min("_when").alias("_first"), F.count("*").alias("_n")).filter("_n > 1").drop("_n")
    own = own.join(first, key, "left").withColumn("again", F.coalesce(F.col("_when") > F.col("_first"), F.lit(False)))
    kind = F.lit(len(INITIALS))
    for i, c in enumerate(INITIALS):
        kind = F.when(F.substring("role", 1, 1) == c, i).otherwise(kind)
    symbol = F.when(blank, MUST_GO).otherwise(2 * kind + truncated.cast("int"))
    return own.select("conv_id", "turn", "role", "text", "again", symbol.cast("int").alias("symbol"))


_PIECE = "conv_none boolean, conv long, piece long, blank long, duplicate long, truncated long, illegal long, first string, last string, costs array<long>, audits array<string>"


def _conv(rows: pa.Table, name: str = "conv_id") -> tuple[np.ndarray, np.ndarray]:
    own = rows[name].combine_chunks()
    return own.field(0).to_numpy(zero_copy_only=False).astype(bool), own.field(1).to_numpy(zero_copy_only=False)


class Piece:
    """What is known of the rows of one conversation in one task."""

    def __init__(self, conv: tuple[bool, int], number: int) -> None:
        self.conv, self.number, self.symbols = conv, number, []
        self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.first = self.last = None
        self.before: tuple | None = None

    def add(self, turn: int | None, role: str, text: str, again: bool, symbol: int) -> None:
        now = (turn, role, text)
        if symbol == MUST_GO:
            self.blank += 1
        elif again or now == self.before:
            self.duplicate += 1
            symbol = MUST_GO
        else:
            self.truncated += symbol % 2
        self.before = now
        if self.first is None:
            self.first = role[:1]
        elif self.last + role[:1] not in ("su", "ua", "au"):
            self.illegal += 1
        self.last = role[:1]
        self.symbols.append(symbol)

    def row(self, transfer: Transfer) -> dict:
        flat = [e for row in transfer for e in row]
        return {
            "conv_none": self.conv[0], "conv": self.conv[1], "piece": self.number, "blank": self.blank, "duplicate": self.duplicate, "truncated": self.truncated, "illegal": self.illegal,
            "first": self.first, "last": self.last, "costs": [None if e is None else e[0] for e in flat], "audits": [None if e is None else str(e[1]) for e in flat],
        }


def pieces(rows: DataFrame) -> DataFrame:
    """Each conversation's rows in one task, or in several in order: counts, and the transfer matrix. ``first`` and
    ``last`` are the initials at the ends."""
    schema = pa.schema([("conv_none", pa.bool_()), ("conv", pa.int64()), ("piece", pa.int64()), *[(c, pa.int64()) for c in ("blank", "duplicate", "truncated", "illegal")], ("first", pa.string()), ("last", pa.string()), ("costs", pa.list_(pa.int64())), ("audits", pa.list_(pa.string()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammar, number = Grammar(), TaskContext.get().partitionId()
        now, ready, n = None, [], 0

        def emit() -> Iterator[pa.RecordBatch]:
            transfers = grammar.evaluate([bytes(p.symbols) for p in ready])
            for i in range(0, len(ready), 256):
                yield pa.RecordBatch.from_pylist([p.row(t) for p, t in zip(ready[i : i + 256], transfers[i : i + 256], strict=True)], schema=schema)

        for batch in batches:
            none, conv = _conv(pa.Table.from_batches([batch]))
            columns = [batch.column(c).to_pylist() for c in ("turn", "role", "text", "again", "symbol")]
            for own, *row in zip(zip(none.tolist(), conv.tolist(), strict=True), *columns, strict=True):
                if now is None or now.conv != own:
                    now = Piece(own, number)
                    ready.append(now)
                now.add(*row)
                n += 1
            if n > PIECE:
                last = ready.pop()
                if ready:
                    yield from emit()
                ready, n = [last], len(last.symbols)
        if ready:
            yield from emit()

    order = ["conv_id", F.col("turn").asc_nulls_first(), "role", "text"]
    return rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, _PIECE)


def _transfer(costs: list, audits: list) -> Transfer:
    flat = [None if c is None else (c, Rope(a)) for c, a in zip(costs, audits, strict=True)]
    return [flat[4 * x : 4 * x + 4] for x in range(4)]


def joined(found: DataFrame) -> DataFrame:
    """(conv_none, conv, blank, duplicate, truncated, illegal, cost, audit) of each conversation: its pieces, one for each
    task that had rows of it, in order."""
    schema = pa.schema([("conv_none", pa.bool_()), ("conv", pa.int64()), *[(c, pa.int64()) for c in ("blank", "duplicate", "truncated", "illegal", "cost")], ("audit", pa.string())])
    key = ["conv_none", "conv"]

    def finish(rows: list[dict]) -> dict:
        total, all_of = None, {c: sum(r[c] for r in rows) for c in ("blank", "duplicate", "truncated", "illegal")}
        for before, r in zip([None, *rows], rows, strict=False):
            own = _transfer(r["costs"], r["audits"])
            total = own if total is None else product(total, own)
            if before is not None and before["last"] + r["first"] not in ("su", "ua", "au"):
                all_of["illegal"] += 1
        cost, audit = best(total)
        return {**{c: rows[0][c] for c in key}, **all_of, "cost": cost, "audit": audit}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[dict] = []
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if kept and [kept[0][c] for c in key] != [r[c] for c in key]:
                    out.append(finish(kept))
                    kept = []
                kept.append(r)
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=schema)
        if kept:
            yield pa.RecordBatch.from_pylist([finish(kept)], schema=schema)

    fields = "conv_none boolean, conv long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
    return found.repartition(*key).sortWithinPartitions(*key, "piece").mapInArrow(run, fields)


class Repaired:
    """The digest of a repaired conversation, row by row."""

    def __init__(self, audit: str) -> None:
        self.audit, self.at, self.digest = audit, 0, hashlib.sha256()
        self.out, self.odd = 0, sum(map(audit.count, "KRI")) % 2

    def _put(self, role: str | None, text: str) -> None:
        if role is None:
            role = ("user", "assistant")[(self.out - self.odd) % 2]
        self.digest.update(("\n" * bool(self.out) + role + ":" + text).encode("utf-8", "surrogatepass"))
        self.out += 1

    def _inserts(self) -> None:
        while self.audit[self.at : self.at + 1] == "I":
            self._put(None, "")
            self.at += 1

    def add(self, role: str, text: str) -> None:
        self._inserts()
        edit = self.audit[self.at]
        if edit != "D":
            self._put(role if edit == "K" else None, text)
        self.at += 1

    def hex(self) -> str:
        self._inserts()
        return self.digest.hexdigest()


def digests(rows: DataFrame, audits: DataFrame) -> DataFrame:
    """(conv_none, conv, repaired_sha256). The audit comes before its conversation's rows, in the order of ``pieces``."""
    conv = F.struct(F.col("conv_none").alias("none"), F.col("conv").alias("id"))
    heads = audits.select(conv.alias("conv_id"), F.lit(0).alias("_k"), F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.col("audit").alias("text"))
    both = heads.unionByName(rows.select("conv_id", F.lit(1).alias("_k"), "turn", "role", "text"))
    schema = pa.schema([("conv_none", pa.bool_()), ("conv", pa.int64()), ("repaired_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, who = None, None
        for batch in batches:
            none, conv = _conv(pa.Table.from_batches([batch]))
            out = []
            for own, kind, role, text in zip(zip(none.tolist(), conv.tolist(), strict=True), *[batch.column(c).to_pylist() for c in ("_k", "role", "text")], strict=True):
                if kind == 0:
                    if now is not None:
                        out.append({"conv_none": who[0], "conv": who[1], "repaired_sha256": now.hex()})
                    now, who = Repaired(text), own
                else:
                    now.add(role, text)
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=schema)
        if now is not None:
            yield pa.RecordBatch.from_pylist([{"conv_none": who[0], "conv": who[1], "repaired_sha256": now.hex()}], schema=schema)

    order = ["conv_id", "_k", F.col("turn").asc_nulls_first(), "role", "text"]
    return both.repartition("conv_id").sortWithinPartitions(*order).mapInArrow(run, "conv_none boolean, conv long, repaired_sha256 string")


def repair(table: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of every conversation."""
    rows = materialize(with_faults(damaged(table)), "dialogue-rows")
    turns = rows.groupBy("conv_id").agg(F.min("turn").alias("lo"), F.max("turn").alias("hi"), F.count_distinct("turn").alias("n"))
    span = F.expr("try_cast(cast(hi AS decimal(20, 0)) - cast(lo AS decimal(20, 0)) + 1 - n AS bigint)")
    gaps = turns.select(F.col("conv_id.none").alias("conv_none"), F.col("conv_id.id").alias("conv"), F.when(F.col("n") == 0, 0).otherwise(span).cast("long").alias("gaps"))
    found = materialize(joined(materialize(pieces(rows), "dialogue-pieces")), "dialogue-audits")
    told = digests(rows, found)
    key = ["conv_none", "conv"]
    every = table.select(F.col("conv_id").cast("long").alias("conv_id")).distinct().select("conv_id", F.col("conv_id").isNull().alias("conv_none"), F.coalesce("conv_id", F.lit(0).cast("long")).alias("conv"))
    out = every.join(gaps, key, "left").join(found, key, "left").join(told, key, "left")
    zeros = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    out = out.withColumn("gaps", F.when(F.col("audit").isNull(), 0).otherwise(F.col("gaps")).cast("long"))
    return out.select(
        "conv_id", *[F.col(c) if c == "gaps" else F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in zeros],
        F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(read_table(spark, sf_dir, "conversations"))
