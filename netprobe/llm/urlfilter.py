"""URL filter: sorted 64-bit digests of the rules in memory-mapped arrays, probed by binary search.

The index is a folder of parts, each with the sorted xxhash64 keys of its rules, the rules' strings
and their verdicts, written by Spark tasks that deal the rules out by digest range. Workers map the
arrays into memory, so that an index may exceed a worker's heap. A probe that hits is confirmed on
the stored string, so colliding digests never decide.

Defined results: a null url, or one without ``://``, has empty host and path and fits no rule; a url
that no rule fits gets the default verdict; of duplicate rules that differ block counts, and so does any
verdict but ``allow``, null too; a rule without ``/`` fits nothing, a null rule is left out; an index without rules fits nothing;
of rules of equal length on one url only one can fit, so there are no ties; very long urls are tried in full;
repeated rows are judged each for itself; other columns are kept, but for those named like the new ones.
"""

from __future__ import annotations

import string
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from netprobe.llm.common import materialize, new_path

DEFAULT_VERDICT = "allow"
RULES_PER_PART = 1 << 20
#: Rules of the query: host and path prefix, verdict.
RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path."""
    rest = F.when(F.contains(url, F.lit("://")), F.substring(url, F.position(F.lit("://"), url) + 3, F.lit(2**31 - 1)))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), string.ascii_uppercase, string.ascii_lowercase)
    return host, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def _local(path: str) -> str:
    return path.removeprefix("file://") if path.startswith("file:///") else path.removeprefix("file:")


def digest(text: str) -> int:
    """The unsigned value of Spark's xxhash64 of a string, so that rules are dealt by what is stored."""
    return xxhash.xxh64_intdigest(text, seed=42)


def build_index(rules: DataFrame, path: str, parts: int | None = None) -> DataFrame:
    """Write the index of (rule, verdict) under ``path``; returns its parts (a small table: part, first and last
    digest, lengths of the rules' paths). ``parts``: by default one for each RULES_PER_PART rules."""
    clean = rules.filter("rule IS NOT NULL").groupBy("rule").agg(F.max(F.when(F.col("verdict") == "allow", "allow").otherwise("block")).alias("verdict"))
    clean = materialize(clean.withColumn("order", F.xxhash64("rule").bitwiseXOR(F.lit(-(1 << 63)))), "url-rules")  # signed, in the digests' unsigned order
    parts = parts or -(-clean.count() // RULES_PER_PART) or 1

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, sizes, text, allow, lengths, labels = [], [], [], [], set(), 0
        for b in batches:
            names = b["rule"].to_pylist()
            raw = [r.encode() for r in names]
            keys.append(b["order"].to_numpy().view(np.uint64) ^ np.uint64(1 << 63))
            sizes.append(np.array([len(r) for r in raw], np.int64))
            text.append(b"".join(raw))
            allow.append(np.array([v == "allow" for v in b["verdict"].to_pylist()], bool))
            lengths |= {len(r) - r.find("/") for r in names if "/" in r}
            labels = max([labels, *(r.partition("/")[0].count(".") + 1 for r in names)])
        if not sum(map(len, keys)):
            return
        arrays = {"keys": np.concatenate(keys), "ends": np.cumsum(np.concatenate(sizes)), "text": np.frombuffer(b"".join(text), np.uint8), "allow": np.concatenate(allow)}
        files, base = pafs.FileSystem.from_uri(path if "://" in path else "file://" + _local(path))
        # a task that runs again writes under its own name; only the part it reports is read
        part = f"{base}/part-{arrays['keys'][0]:016x}-{np.random.SeedSequence().entropy:x}"
        files.create_dir(part)
        for k, a in arrays.items():
            with files.open_output_stream(f"{part}/{k}.npy") as out:
                np.save(out, a)
        uri = path[: path.index(":") + 3] if "://" in path else ""
        ends = [pa.array([int(arrays["keys"][i] ^ np.uint64(1 << 63)) - (0 if arrays["keys"][i] >> np.uint64(63) else 1 << 64)], pa.int64()) for i in (0, -1)]
        yield pa.RecordBatch.from_arrays([pa.array([uri + part]), *ends, pa.array([sorted(lengths)], pa.list_(pa.int32())), pa.array([labels], pa.int32())], names=["part", "first", "last", "lengths", "labels"])

    dealt = clean.repartitionByRange(parts, "order").sortWithinPartitions("order", "rule")
    return materialize(dealt.mapInArrow(write, "part string, first long, last long, lengths array<int>, labels int"), "url-index")


@lru_cache(maxsize=64)
def _open(part: str) -> dict[str, np.ndarray]:
    """The arrays of a part, mapped into memory; from a store without local paths, loaded."""
    names = ("keys", "ends", "text", "allow")
    if "://" not in part or part.startswith("file:"):
        return {k: np.load(f"{_local(part)}/{k}.npy", mmap_mode="r") for k in names}
    files, base = pafs.FileSystem.from_uri(part)
    return {k: np.load(files.open_input_file(f"{base}/{k}.npy")) for k in names}


def _probe(part: dict[str, np.ndarray], keys: np.ndarray, texts: list[str]) -> np.ndarray:
    """-1, or the row of the part that holds exactly this string."""
    out = np.full(len(keys), -1)
    own = part["keys"]
    at = np.searchsorted(own, keys)
    for i in np.flatnonzero((at < len(own)) & (own[np.minimum(at, len(own) - 1)] == keys)):
        want = texts[i].encode()
        for row in range(at[i], len(own)):  # digests may collide: try each of the same key
            if own[row] != keys[i]:
                break
            begin = part["ends"][row - 1] if row else 0
            if part["text"][begin : part["ends"][row]].tobytes() == want:
                out[i] = row
                break
    return out


def judge(urls: DataFrame, index: DataFrame, default: str = DEFAULT_VERDICT) -> DataFrame:
    """Adds host, path, rule, verdict to rows with a ``url``. The index's list of parts (not the index) goes with the tasks."""
    rows = index.orderBy("first").collect()  # a row for each part
    parts, first = [r["part"] for r in rows], np.array([r["first"] for r in rows], np.int64)
    lengths = sorted({n for r in rows for n in r["lengths"]})
    most = max((r["labels"] for r in rows), default=0)  # a longer end of a host than any rule's can't be one

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts, paths = batch.column("host").to_pylist(), batch.column("path").to_pylist()
            owner: list[int] = []
            texts: list[str] = []
            for row, (host, path) in enumerate(zip(hosts, paths, strict=True)):
                labels = host.rsplit(".", most)[-most:] if host and most else []
                tails = [".".join(labels[k:]) for k in range(len(labels))]
                found = [tail + path[:n] for tail in tails for n in lengths if n <= len(path)]
                texts += found
                owner += [row] * len(found)
            known = {t: digest(t) for t in set(texts)}
            keys = np.fromiter((known[t] for t in texts), np.uint64, len(texts))
            # each key goes to the one part whose range of digests holds it
            route = np.searchsorted(first, (keys ^ np.uint64(1 << 63)).view(np.int64), "right") - 1
            best: dict[int, tuple[int, str, str]] = {}
            for part in np.unique(route[route >= 0]).tolist():
                arrays, own = _open(parts[part]), np.flatnonzero(route == part)
                hit = _probe(arrays, keys[own], [texts[i] for i in own.tolist()])
                for k in np.flatnonzero(hit >= 0).tolist():
                    i = int(own[k])
                    verdict = "allow" if arrays["allow"][hit[k]] else "block"
                    best[owner[i]] = max(best.get(owner[i], (0, "", "")), (len(texts[i]), texts[i], verdict))
            rule = [best[i][1] if i in best else None for i in range(len(hosts))]
            verdict = [best[i][2] if i in best else default for i in range(len(hosts))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rule, pa.string()), pa.array(verdict, pa.string())], names=[*batch.schema.names, "rule", "verdict"])

    host, path = split_url(F.col("url"))
    parsed = urls.drop("host", "path", "rule", "verdict").withColumns({"host": host, "path": path})
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in parsed.schema)
    return parsed.mapInArrow(run, f"{fields}, rule string, verdict string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "rule string, verdict string")
    index = build_index(rules, new_path(spark, "url-index"))
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return judge(pages, index).select("page_id", "host", "path", "rule", "verdict")


ORACLE = f"""
WITH r(rule, verdict) AS (VALUES {", ".join(f"('{a}', '{b}')" for a, b in RULES)}),
u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id,
    translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
fit AS (SELECT page_id, max_by(rule, length(rule)) AS rule, max_by(verdict, length(rule)) AS verdict
    FROM p JOIN r ON (host = split_part(rule, '/', 1) OR ends_with(host, '.' || split_part(rule, '/', 1)))
        AND starts_with(path, substr(rule, strpos(rule, '/'))) GROUP BY page_id)
SELECT page_id, host, path, rule, coalesce(verdict, '{DEFAULT_VERDICT}') AS verdict FROM p LEFT JOIN fit USING (page_id)
"""
