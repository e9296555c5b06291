"""Session settings and the few helpers that depend on the running session."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings a corpus scan relies on. Partition counts are left to AQE: the initial
# number is set by the caller (or the cluster) and coalesced from the real sizes.
SCAN_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(app: str = "tidemark", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the scan settings; ``master`` only for local runs."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SCAN_CONF, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder named in ``spark.checkpoint.dir``.

    A temporary folder is only acceptable in local mode, where driver and
    executors share one machine; on a cluster a missing setting is an error.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
    elif sc.master.startswith("local"):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="tidemark-checkpoint-"))
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the reliable checkpoint folder and read it back."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table below the checkpoint folder and read it again.

    What follows may read it several times without doing the work again, and survives lost executors.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression="zstd")
    return spark.read.schema(df.schema).parquet(path)


class Scratch:
    """Tables below the checkpoint folder, for rounds of work in which each table replaces the one before."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        ensure_checkpoint_dir(spark)
        self.spark, self.base = spark, f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"
        self.paths: dict[DataFrame, str] = {}

    def write(self, df: DataFrame, instead_of: DataFrame | None = None) -> DataFrame:
        """``df`` written and read again; afterwards the table it replaces is deleted."""
        path = f"{self.base}/{len(self.paths)}"
        df.write.parquet(path, compression="zstd")
        table = self.spark.read.schema(df.schema).parquet(path)
        self.paths[table] = path
        if instead_of is not None:
            self.drop(instead_of)
        return table

    def drop(self, table: DataFrame) -> None:
        folder = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.paths[table])
        folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def spread(df: DataFrame) -> DataFrame:
    """Rows over all cores when the source comes in fewer splits than there are.

    A large table has more splits than cores and is returned as it is; only a small
    one (a single file, say) is redistributed before expensive work per row.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= 2 * cores else df.repartition(cores)
