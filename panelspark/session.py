"""Session settings and the one durable cut of lineage used by the library."""

from __future__ import annotations

import math
import os
import tempfile
import zipfile

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  **conf: str) -> SparkSession:
    """A session with the settings the plans are written for.

    Adaptive execution coalesces small shuffle partitions and splits skewed join
    partitions, so ``spark.sql.shuffle.partitions`` is an upper bound that can stay
    generous on a cluster. Co-partitioning on a subset of the join keys lets a
    (symbol, date) join reuse the hash partitioning the symbol windows need.
    """
    builder = (
        SparkSession.builder.appName("panelspark")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.requireAllClusterKeysForCoPartition", "false")
        .config("spark.sql.sources.partitionOverwriteMode", "dynamic")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


#: Shuffled bytes of one task, and bytes of a stored table that one shuffle partition is planned for.
TASK_BYTES, INPUT_BYTES = 16 << 20, 4 << 20
#: Bytes of bytecode beyond which the JVM never compiles a method (its HugeMethodLimit) and runs it step by step.
METHOD_BYTES = 8000


def roomy(spark: SparkSession, path: str) -> None:
    """Set the session up for a table of this size: a task's share does not grow with the table.

    There are at least as many shuffle partitions as the table has 4 MB, and adaptive execution merges them to 16 MB
    of shuffled bytes and not to one per core: windows by symbol hold a few sorts of a partition
    at once, some 30 times its shuffled bytes. Joins on (symbol, date) may reuse the partitioning by symbol.
    Projections too wide for one compiled method are cut into several.
    """
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    wanted = math.ceil(files.getContentSummary(place).getLength() / INPUT_BYTES)
    if wanted > int(spark.conf.get("spark.sql.shuffle.partitions")):
        spark.conf.set("spark.sql.shuffle.partitions", str(wanted))
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", str(TASK_BYTES))
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", str(METHOD_BYTES))


def durable(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and return the stored rows.

    Needed where a value must not change between two reads of the same plan (a
    partition number, a sampled boundary). The folder is the one the cluster names in
    ``spark.checkpoint.dir``; only a local master may fall back to a scratch folder.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not context.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder all executors share")
            folder = tempfile.mkdtemp(prefix="panelspark-checkpoint-")
        context.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


_SHIPPED: set[str] = set()


def shipped(spark: SparkSession) -> SparkSession:
    """Send this package to the executors once per application: tasks that run Python import it."""
    if spark.sparkContext.applicationId not in _SHIPPED:
        top = os.path.dirname(os.path.abspath(__file__))
        name = os.path.join(tempfile.mkdtemp(prefix="panelspark-"), "panelspark-core.zip")
        with zipfile.ZipFile(name, "w") as z:
            for folder, _, files in os.walk(top):
                for f in sorted(files):
                    if f.endswith(".py"):
                        z.write(os.path.join(folder, f), os.path.relpath(os.path.join(folder, f), os.path.dirname(top)))
        spark.sparkContext.addPyFile(name)
        _SHIPPED.add(spark.sparkContext.applicationId)
    return spark
