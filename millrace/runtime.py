"""Session helpers: sessions for tests and benches, lineage cuts in the shared checkpoint folder, table access."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "*", partitions: int = 8, **conf: str) -> SparkSession:
    """A session for tests and benches; on a cluster the session comes from the caller."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("millrace")
    settings = {
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
    } | conf
    session = builder.config(map=settings).getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    return session


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder of the session, the one the cluster names in spark.checkpoint.dir.

    Only a session of a local master without one (tests) gets a temporary folder; anywhere else that would be another disk on every
    node, so a cluster without the setting is an error.
    """
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = context.getConf().get("spark.checkpoint.dir")
        if not folder and context.master != "local" and not context.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="millrace-"))
    return context._jsc.sc().getCheckpointDir().get()


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, for tables that are written and read again."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write the rows to the shared checkpoint folder and go on from there."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


#: Bytes of a scan up to which it is worth a shuffle to use all cores; more has splits of its own.
SMALL_SCAN = 4 << 30


def spread(scan: DataFrame) -> DataFrame:
    """The rows of a plain scan in at least as many partitions as there are cores.

    For operators that spend long on a row: a table of one small file would otherwise be one task. Tables with enough splits
    or over SMALL_SCAN bytes are left as they are, so large data is never shuffled for this, and so are plans that shuffle anyway.
    """
    if "Exchange" in scan._jdf.queryExecution().executedPlan().toString():
        return scan
    if int(str(scan._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) > SMALL_SCAN:
        return scan
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of a data folder, one parquet file or directory each."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
