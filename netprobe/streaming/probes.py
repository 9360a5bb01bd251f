"""Streams of probe responses: what each batch newly reveals, and running rewards.

What was seen before is a stateful operator: one streaming aggregation, keyed by run and edge (or run and
node), whose rows lie in the state store. A batch looks up the keys that it brings, and reads nothing of
what earlier batches wrote, so its time does not grow with them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

#: (run_id, seq, node, nbr)
RESPONSES = "run_id long, seq int, node long, nbr long"
_EDGES = "run_id long, src long, dst long, seq int, nbr long, batch long"
#: State on the executors' disks, with changes in the checkpoint; the other provider holds it in memory.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _stored(spark, path: str, schema: str) -> DataFrame:  # noqa: ANN001
    from pyspark.errors import AnalysisException

    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)


def _named(kind: str, a: str, b: str | None, seq: Column, nbr: Column) -> Column:
    none = F.lit(None).cast("long")
    return F.struct(F.lit(kind).alias("kind"), F.col(a).cast("long").alias("a"), (F.col(b) if b else F.lit(0).cast("long")).alias("b"), F.col("seq").alias("at"), seq.cast("int").alias("seq"), F.coalesce(nbr, none).alias("nbr"))


def first_seen(responses: DataFrame, sample: Sequence[DataFrame] = ()) -> DataFrame:
    """(run_id, kind, a, b, seq, nbr, new) of all edges (kind e), nodes (n) and probes (p) that a batch of responses names;
    ``new`` where no earlier batch, nor the sample, did. Of a batch the lowest seq counts, and a node that is probed
    before a response names it was known (seq -1)."""
    none = F.lit(None).cast("long")
    own = responses.select("run_id", "seq", "node", "nbr").na.drop().withColumns({"_src": F.least("node", "nbr"), "_dst": F.greatest("node", "nbr")})
    named = own.select("run_id", F.inline(F.array(
        _named("e", "_src", "_dst", F.col("seq"), F.col("nbr")), _named("n", "node", None, F.lit(-1), none),
        _named("n", "nbr", None, F.col("seq"), none), _named("p", "seq", None, F.col("seq"), none),
    )))
    if sample:
        edges, nodes = sample
        known = edges.select("run_id", F.lit("e").alias("kind"), F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"))
        known = known.unionByName(nodes.select("run_id", F.lit("n").alias("kind"), F.col("node").alias("a"), F.lit(0).cast("long").alias("b"))).distinct()
        named = named.join(known, ["run_id", "kind", "a", "b"], "left_anti")
    # within a batch the current time is one value, kept in the offset log: a batch that is delivered again has it again
    named = named.withColumn("time", F.current_timestamp())
    first = named.groupBy("run_id", "kind", "a", "b").agg(F.min(F.struct("time", "at", "seq", "nbr")).alias("_f"))
    return first.select("run_id", "kind", "a", "b", "_f.seq", "_f.nbr", (F.col("_f.time") == F.current_timestamp()).alias("new"))


def stream_probes(responses: DataFrame, path: str, checkpoint: str, trigger: dict | None = None, sample: Sequence[DataFrame] = ()) -> StreamingQuery:
    """Append what each batch of responses newly reveals to ``path``/edges and ``path``/nodes, and what each probe
    earned to ``path``/log (run_id, seq, new_edges, new_nodes).

    ``sample``: the observed edges (run_id, src, dst) and nodes (run_id, node) of the start, stored as batch -1.
    A batch that is delivered again finds the state as it was and overwrites its own partition (batch=<id>), so each
    counts once. Shared discoveries of a batch belong to the lower seq; those of earlier batches are left out. A node
    that is probed before a response names it was known. Rows with a null are left out, repeated ones count once."""
    spark = responses.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    if sample:
        edges, nodes = sample
        given = edges.select("run_id", F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), F.lit(-1).alias("seq"), F.lit(None).cast("long").alias("nbr"))
        given.write.mode("overwrite").parquet(f"{path}/edges/batch=-1")
        nodes.select("run_id", "node", F.lit(-1).alias("seq")).write.mode("overwrite").parquet(f"{path}/nodes/batch=-1")

    def one(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/seen/batch={batch_id}")  # the state is looked up once
        batch = batch.sparkSession.read.schema(batch.schema).parquet(f"{path}/seen/batch={batch_id}")
        found = batch.filter("new")
        kinds = {"edges": found.filter("kind = 'e'").select("run_id", F.col("a").alias("src"), F.col("b").alias("dst"), "seq", "nbr"), "nodes": found.filter("kind = 'n'").select("run_id", F.col("a").alias("node"), "seq")}
        log = batch.filter("kind = 'p'").select("run_id", F.col("a").cast("int").alias("seq"))
        for kind, own in kinds.items():
            own.write.mode("overwrite").parquet(f"{path}/{kind}/batch={batch_id}")
            log = log.join(own.groupBy("run_id", "seq").agg(F.count("*").alias(f"new_{kind}")), ["run_id", "seq"], "left").na.fill(0, [f"new_{kind}"])
        log.write.mode("overwrite").parquet(f"{path}/log/batch={batch_id}")

    seen = first_seen(responses, sample)
    return seen.writeStream.outputMode("update").foreachBatch(one).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def reward_counts(spark: SparkSession, path: str) -> DataFrame:
    """(run_id, node, n): edges that probing others has newly revealed to each node, from the state under ``path``."""
    found = _stored(spark, f"{path}/edges", _EDGES).filter("seq >= 0")
    return found.groupBy("run_id", F.col("nbr").alias("node")).agg(F.count("*").alias("n"))


def stream_rewards(log: DataFrame) -> DataFrame:
    """Running number and sum of rewards by run, of a stream (run_id, reward); exact, so without a watermark."""
    return log.groupBy("run_id").agg(F.count("*").alias("n"), F.sum("reward").alias("total"))


def run_to_table(result: DataFrame, path: str, checkpoint: str, mode: str = "complete") -> StreamingQuery:
    """Write each batch's result to ``path``, replacing the one before."""

    def one(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(path)

    return result.writeStream.outputMode(mode).foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
