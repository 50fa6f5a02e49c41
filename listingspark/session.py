"""Session defaults and the shared folder used to cut long lineages."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings the operators rely on. None of them depends on the size of the cluster:
# partition counts start high enough for a large job and are coalesced at run time.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Pages of markup are large rows; a Python worker holds one batch of them.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
}

_LOCAL_ROOTS: dict[str, str] = {}


def configured(builder: SparkSession.Builder) -> SparkSession.Builder:
    """Add the library's defaults to a session builder."""
    for key, value in DEFAULTS.items():
        builder = builder.config(key, value)
    return builder


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder for cut lineages, as named by the session.

    Only a local-mode session without the setting gets a folder of its own; on a cluster a
    machine-local folder would be lost with its machine, so a missing setting is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("Set spark.checkpoint.dir to a folder every executor can reach")
        application = spark.sparkContext.applicationId
        root = _LOCAL_ROOTS.get(application) or tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        _LOCAL_ROOTS[application] = root
    return root


# Below this many bytes per core a table is too small to fill the cluster by its file layout.
_SPREAD_BYTES_PER_CORE = 16 << 20


def spread_small(df: DataFrame) -> DataFrame:
    """Deal a scan over all cores when its estimated size is small, else leave it alone.

    A table in one or two row groups would keep every expression after it in one task.
    Large tables have enough splits of their own and must not pay for a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(2 * cores) if size < cores * _SPREAD_BYTES_PER_CORE else df


def _file_system(spark: SparkSession, path: str):
    location = spark._jvm.org.apache.hadoop.fs.Path(path)
    return location, location.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def path_exists(spark: SparkSession, path: str) -> bool:
    location, files = _file_system(spark, path)
    return files.exists(location)


class StageTables:
    """Intermediate tables of one iterative job, written below the checkpoint folder.

    A written table survives the loss of any executor and gives the next stage exact
    sizes, and unlike an eager checkpoint its plan runs once.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{checkpoint_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
        self.step = 0

    def write(self, df: DataFrame) -> DataFrame:
        path = f"{self.root}/{self.step:04d}"
        self.step += 1
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop_before(self, keep: int) -> None:
        """Delete all but the newest ``keep`` tables; nothing reads them any more."""
        step = self.step - keep - 1
        if step >= 0:
            location, files = _file_system(self.spark, f"{self.root}/{step:04d}")
            files.delete(location, True)
