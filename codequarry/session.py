"""Session, table and lineage helpers shared by all operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a per-key side table may be broadcast. Checked by a count
#: before every broadcast of data whose size follows the input.
BROADCAST_ROWS = 50_000


def local_session(cores: int | str = 8, **conf: str) -> SparkSession:
    """A session for one machine, with the settings the operators expect."""
    b = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("codequarry")
        .config("spark.driver.memory", conf.pop("driver_memory", "12g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", conf.pop("partitions", "8"))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the parquet tables of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, from ``spark.checkpoint.dir``.

    Where the session does not name one, a temporary folder is set, which is
    right only where driver and executors are one machine; elsewhere this is
    refused.
    """
    sc = spark.sparkContext
    have = sc._jsc.sc().getCheckpointDir()
    if have.isDefined():
        # Spark appends a folder of its own per application
        return have.get()
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="codequarry-")
    sc.setCheckpointDir(named)
    return sc._jsc.sc().getCheckpointDir().get()


_written: list[str] = []


def materialize(df: DataFrame, partition_by: str | None = None) -> DataFrame:
    """Write ``df`` into the shared folder and read it back.

    Cuts the lineage like ``checkpoint()``, but in compressed columns, so a
    later reader prunes columns and an executor that is lost costs nothing. The
    tables stay until ``release``, as results may still read them.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    _written.append(path)
    w = df.write
    if partition_by:
        w = w.partitionBy(partition_by)
    w.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def join_on_keys(big: DataFrame, keys: DataFrame, on: list[str], spread: str, how: str = "inner", n_keys: int | None = None) -> DataFrame:
    """Join rows to a table with one row per key, safe for hot keys.

    ``keys`` is broadcast only if a count shows at most ``BROADCAST_ROWS``
    rows. Otherwise both sides shuffle on the key and a salt taken from the
    column ``spread``, so that no key's rows meet in one task.
    """
    n = keys.count() if n_keys is None else n_keys
    if n <= BROADCAST_ROWS:
        return big.join(F.broadcast(keys), on, how)
    salts = max(2, big.sparkSession.sparkContext.defaultParallelism)
    salted = keys.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return (
        big.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
        .join(salted, [*on, "_salt"], how)
        .drop("_salt")
    )


def release(spark: SparkSession) -> int:
    """Deletes the tables written by ``materialize``; call it once no result reads them any more."""
    jvm, n = spark.sparkContext._jvm, 0
    while _written:
        path = jvm.org.apache.hadoop.fs.Path(_written.pop())
        n += path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    return n
