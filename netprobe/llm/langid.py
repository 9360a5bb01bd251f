"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Document frequencies come from all training documents. The weights are trained on a bounded sample of
them by follow-the-regularised-leader with elastic-net penalties: shards of the sample train side by
side from the same state, and their states are averaged after each round. A temperature, fitted on a
part of the sample that was not trained on, calibrates the probabilities.

Defined results: null text, and text without a letter, is ``und`` with score 0; without any labelled
training text everything is ``und``; equal texts get equal results, and of languages that are equally
likely the first by name; repeated rows are predicted each for itself, and any number of copies of a text
counts once in the sample; very long texts are read whole, in runs; rows without a doc_id count as the
empty id, so they are not held out; empty tables give empty tables; other columns are never read by
``predict``, and kept by ``filter_language``. Beyond ``MAX_LANGS`` labels, those with fewest texts are not learned.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from netprobe.llm.common import U64, materialize, mix64

ORDERS = (1, 2, 3)
BUCKETS = 1 << 15
#: At most about this many distinct labelled texts are trained on, as many of each language (or all it has),
#: in so many shards and rounds.
MAX_TRAIN, SHARDS, ROUNDS = 6000, 4, 3
MAX_LANGS = 256
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 1e-4
#: Of 10 parts of the sample, this one only calibrates.
CALIBRATION_PARTS = 10
#: Documents below this probability are rejected by ``filter_language``.
MIN_SCORE = 0.4
UNKNOWN = "und"


def ngram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the lower-cased text's character n-grams, and their counts."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(U64)
    counts = np.zeros(BUCKETS, np.int64)
    with np.errstate(over="ignore"):
        for begin in range(0, len(codes), 1 << 20):  # bounded memory for very long texts
            part = codes[begin : begin + (1 << 20) + max(ORDERS) - 1]
            own = min(1 << 20, len(codes) - begin)
            key = np.zeros(len(part), U64)
            for n in range(1, max(ORDERS) + 1):
                size = len(part) - n + 1
                if size <= 0:
                    break
                key = key[:size] * U64(0x100000001B3) + part[n - 1 : n - 1 + size]
                if n in ORDERS:
                    hashed = (mix64(key[:own] + U64(n)) >> U64(49)).astype(np.int64)
                    counts += np.bincount(hashed, minlength=BUCKETS)
    found = np.flatnonzero(counts)
    return found, counts[found]


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


@dataclass
class Model:
    langs: list[str]
    idf: np.ndarray
    weights: np.ndarray  # (BUCKETS, langs); mostly zeros
    bias: np.ndarray
    temperature: float = 1.0


def features(text: str, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and their TF-IDF weights, of length 1."""
    found, counts = ngram_counts(text)
    value = (1 + np.log(counts)) * idf[found]
    return found, value / max(float(np.sqrt(value @ value)), 1e-12)


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max())
    return e / e.sum()


def ftrl_weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The closed form of the leader: zero where the sum of gradients stays within the L1 penalty."""
    shrunk = np.sign(z) * np.maximum(np.abs(z) - L1, 0)
    return -shrunk / ((BETA + np.sqrt(n)) / ALPHA + L2)


def ftrl_pass(z: np.ndarray, n: np.ndarray, rows: list[tuple[np.ndarray, np.ndarray, int]]) -> None:
    """One pass over (buckets, values, label); z and n (buckets + 1, langs) change in place, the last row is the bias."""
    for found, value, label in rows:
        at = np.append(found, len(z) - 1)
        x = np.append(value, 1.0)
        w = ftrl_weights(z[at], n[at])
        p = _softmax(x @ w)
        p[label] -= 1
        g = x[:, None] * p[None, :]
        sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
        z[at] += g - sigma * w
        n[at] += g * g


def fit_temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature of least negative log-likelihood, by golden section on its logarithm."""
    if not len(labels):
        return 1.0

    def loss(log_t: float) -> float:
        x = logits / np.exp(log_t)
        x = x - x.max(axis=1, keepdims=True)
        return float((np.log(np.exp(x).sum(axis=1)) - x[np.arange(len(labels)), labels]).mean())

    low, high, ratio = -3.0, 3.0, (5**0.5 - 1) / 2
    for _ in range(40):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) < loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """In how many of all these texts each bucket occurs, and how many texts there are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(BUCKETS, np.int64), 0
        for batch in batches:
            for text in batch.column("text").to_pylist():
                if has_letter(text):
                    total[ngram_counts(text)[0]] += 1
                    n += 1
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(found, -1)), pa.array(np.append(total[found], n))], names=["bucket", "df"])

    sums = docs.select("text").mapInArrow(run, "bucket long, df long").groupBy("bucket").agg(F.sum("df").alias("df"))
    rows = sums.toPandas()  # at most BUCKETS + 1 rows
    out = np.zeros(BUCKETS, np.int64)
    real = rows[rows.bucket >= 0]
    out[real.bucket.to_numpy()] = real.df.to_numpy()
    return out, int(rows.df[rows.bucket < 0].sum())


def training_sample(labelled: DataFrame) -> tuple[list[str], DataFrame]:
    """The languages to learn, by name, and the texts (text, lang) to learn from.

    Rates follow the distinct texts of each language, so neither copies nor a large language starve another."""
    hashed = F.approx_count_distinct(F.xxhash64("text"))
    counted = labelled.groupBy("lang").agg(hashed.alias("n")).orderBy(F.desc("n"), "lang").limit(MAX_LANGS).collect()
    most = {r["lang"]: int(min(1.0, MAX_TRAIN / len(counted) / max(r["n"], 1)) * (1 << 30)) for r in counted}
    table = F.create_map(*[F.lit(x) for pair in most.items() for x in pair]) if most else F.create_map().cast("map<string,int>")
    rank = F.pmod(F.xxhash64("text"), F.lit(1 << 30))
    return sorted(most), labelled.filter(rank < F.try_element_at(table, F.col("lang"))).select("text", "lang").distinct()


def train(labelled: DataFrame) -> Model | None:
    """Fit on (text, lang) rows; null langs, and texts without a letter, ignored."""
    labelled = labelled.filter("lang IS NOT NULL AND text IS NOT NULL").filter(F.col("text").rlike(r"\p{L}")).select("text", "lang")
    langs, sample = training_sample(labelled)
    df, n_docs = document_frequencies(labelled)
    if not langs or not n_docs:
        return None
    idf = np.log((1 + n_docs) / (1 + df)) + 1
    sample = sample.withColumn("part", F.pmod(F.xxhash64(F.lit(3), "text"), F.lit(CALIBRATION_PARTS)))
    sample = materialize(sample.repartition(SHARDS, F.xxhash64(F.lit(5), "text")), "lang-sample")
    index = {lang: i for i, lang in enumerate(langs)}
    z, n = np.zeros((BUCKETS + 1, len(langs)), np.float64), np.zeros((BUCKETS + 1, len(langs)), np.float64)
    shard = F.pmod(F.xxhash64(F.lit(5), "text"), F.lit(SHARDS)).cast("int")

    for _ in range(ROUNDS):
        state = sample.sparkSession.sparkContext.broadcast((idf, z, n))  # BUCKETS x languages: bounded

        def one(pdf: pd.DataFrame) -> pd.DataFrame:
            idf, z, n = state.value  # noqa: B023
            z, n = z.copy(), n.copy()
            pdf = pdf.sort_values("text", kind="stable")
            rows = [(*features(t, idf), index[g]) for t, g in zip(pdf.text, pdf.lang, strict=True) if has_letter(t)]
            order = np.random.default_rng(7).permutation(len(rows))
            ftrl_pass(z, n, [rows[i] for i in order])
            return pd.DataFrame({"z": [z.tobytes()], "n": [n.tobytes()], "rows": [len(rows)]})

        trained = sample.filter("part > 0").withColumn("shard", shard).groupBy("shard").applyInPandas(one, "z binary, n binary, rows long")
        states = [r for r in trained.collect() if r["rows"]]  # one row for each of SHARDS
        if states:
            share = np.array([r["rows"] for r in states], float)
            share /= share.sum()
            z = sum(s * np.frombuffer(r["z"]).reshape(z.shape) for s, r in zip(share, states, strict=True))
            n = sum(s * np.frombuffer(r["n"]).reshape(n.shape) for s, r in zip(share, states, strict=True))
        state.unpersist()
    w = ftrl_weights(z, n)
    model = Model(langs, idf, w[:-1].astype(np.float32), w[-1])
    held = _logits(sample.filter("part = 0"), model).toPandas()  # bounded by the sample
    logits = np.array(held.logits.tolist(), float).reshape(-1, len(langs))
    model.temperature = fit_temperature(logits, np.array([index[g] for g in held.lang], int))
    return model


def _logits(rows: DataFrame, model: Model) -> DataFrame:
    state = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = state.value
        for batch in batches:
            texts, langs = batch.column("text").to_pylist(), batch.column("lang").to_pylist()
            good = [(t, g) for t, g in zip(texts, langs, strict=True) if has_letter(t)]
            out = [score_text(t, m).tolist() for t, _ in good]
            yield pa.RecordBatch.from_arrays([pa.array([g for _, g in good], pa.string()), pa.array(out, pa.list_(pa.float64()))], names=["lang", "logits"])

    return rows.select("text", "lang").mapInArrow(run, "lang string, logits array<double>")


def score_text(text: str, model: Model) -> np.ndarray:
    found, value = features(text, model.idf)
    return value @ model.weights[found] + model.bias


def predict(docs: DataFrame, model: Model | None, carried: str = "doc_id") -> DataFrame:
    """(doc_id, lang_pred, score) from the texts alone; or with another column carried in place of doc_id."""
    state = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = state.value
        for batch in batches:
            langs, scores = [], []
            for text in batch.column("text").to_pylist():
                if m is None or not has_letter(text):
                    langs.append(UNKNOWN)
                    scores.append(0.0)
                    continue
                p = _softmax(score_text(text, m) / m.temperature)
                best = int(p.argmax())
                langs.append(m.langs[best])
                scores.append(float(p[best]))
            yield pa.RecordBatch.from_arrays([batch.column(carried), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[carried, "lang_pred", "score"])

    rows = docs.select(carried, "text")
    schema = StructType([rows.schema[carried], StructField("lang_pred", StringType()), StructField("score", DoubleType())])
    return rows.mapInArrow(run, schema)


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(3)) == 1


def query(docs: DataFrame) -> DataFrame:
    model = train(docs.filter(~held_out(F.col("doc_id"))))
    return predict(docs, model).withColumn("held_out", held_out(F.col("doc_id"))).select("doc_id", "held_out", "lang_pred", "score")


def filter_language(docs: DataFrame) -> DataFrame:
    """The documents whose language is recognised, by a model of their own labels."""
    rows = docs.select(F.struct(*docs.columns).alias("_all"), "text")
    tagged = predict(rows, train(docs), "_all").filter((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= MIN_SCORE))
    return tagged.select("_all.*")
