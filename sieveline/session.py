"""Session, shared folder and staged tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Keys are hashed to 64 bits twice with these seeds where a 128-bit key is needed.
SEEDS = (42, 1_000_003)


_OWN: dict[str, str] = {}


def local_session(cores: int = 8, partitions: int = 8, memory: str = "8g", name: str = "sieveline") -> SparkSession:
    """A session for tests and the benchmark; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where that is unset, a local master (tests) gets one of our own; on a
    cluster, where no folder of one machine will do, that is an error."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        app = spark.sparkContext.applicationId
        where = _OWN.get(app) or _OWN.setdefault(app, tempfile.mkdtemp(prefix="spark-sieveline-"))
    return where.rstrip("/")


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends there, sizes are known to the
    optimizer afterwards, and a lost executor costs nothing that is already written."""
    spark = df.sparkSession
    path = f"{_staged_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clear_staged(spark: SparkSession) -> None:
    """Remove what staged has written for this application; call it when no DataFrame made so far is needed any more."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_staged_dir(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def _staged_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/staged/{spark.sparkContext.applicationId}"


def small(df: DataFrame, max_rows: int) -> bool:
    """Whether df has at most max_rows rows: the check that has to come before every broadcast hint."""
    return df.limit(max_rows + 1).count() <= max_rows
