"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

#: Folders that this process made, oldest first.
_MADE: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; where it is unset and Spark runs in one process (tests), a new local folder."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    path = f"{shared_dir(spark)}/netprobe/{label}-{uuid.uuid4().hex}"
    _MADE.append(path)
    return path


def materialize(df: DataFrame, label: str, codec: str = "zstd") -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffled(df: DataFrame) -> DataFrame:
    """``df`` as the side of a join that is dealt by key and held in parts: tables of a row for each node are small as files,
    and Spark would send them through the driver, in each round of a loop."""
    return df.hint("shuffle_hash")


def made() -> int:
    """A mark for ``discard``: how many folders there are."""
    return len(_MADE)


def discard(spark: SparkSession, begin: int, end: int) -> None:
    """Delete the folders made between two marks; no table that is still read may be among them."""
    for path in _MADE[begin:end]:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


class Parts:
    """A table in the shared folder that grows by parts; its plan stays a single scan."""

    def __init__(self, spark: SparkSession, label: str, schema: str | None = None) -> None:
        self.spark, self.path = spark, new_path(spark, label)
        self.schema = None
        if schema is not None:
            self.add(spark.createDataFrame([], schema))

    @property
    def columns(self) -> list[str]:
        return self.schema.fieldNames()

    def add(self, df: DataFrame) -> Parts:
        """``df`` must not read from this table's newest state in a way that a rerun would see its own rows."""
        self.schema = self.schema or df.schema
        df.select(*self.columns).write.mode("append").parquet(self.path)
        return self

    def read(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)


class Buckets(Parts):
    """A table that grows by parts, in folders by the hash of one column: rows of some keys are read from their
    folders alone. After ``COMPACT`` parts it is written anew, so that the number of its files stays bounded."""

    COMPACT, ROWS, MOST = 32, 100_000, 1024

    def __init__(self, spark: SparkSession, label: str, key: str, n: int = 32) -> None:
        super().__init__(spark, label)
        self.label, self.key, self.n, self.parts = label, key, n, 0

    @classmethod
    def number(cls, rows: int) -> int:
        """Buckets of about ``ROWS`` rows each."""
        return max(1, min(cls.MOST, rows // cls.ROWS))

    def _of(self, key: str) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.n)).cast("int")

    def _write(self, df: DataFrame) -> None:
        df.withColumn("_bucket", self._of(self.key)).hint("rebalance", "_bucket").write.mode("append").partitionBy("_bucket").parquet(self.path)
        self.parts += 1

    def add(self, df: DataFrame) -> Buckets:
        self.schema = self.schema or df.schema
        if self.parts == self.COMPACT:
            old, self.path, self.parts = self.read(), new_path(self.spark, self.label), 0
            self._write(old)
        self._write(df.select(*self.columns))
        return self

    def _read(self) -> DataFrame:
        return self.spark.read.schema(StructType([*self.schema.fields, StructField("_bucket", IntegerType())])).parquet(self.path)

    def read(self) -> DataFrame:
        return self._read().drop("_bucket")

    def near(self, keys: DataFrame) -> DataFrame:
        """The rows of all buckets that a key of ``keys`` (its column named as this table's) is in."""
        if self.n == 1:
            return self.read()
        touched = [r[0] for r in keys.select(self._of(self.key).alias("b")).distinct().collect()]  # n at most
        return self._read().filter(F.col("_bucket").isin(touched)).drop("_bucket")
