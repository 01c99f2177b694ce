"""Session defaults and the shared folder in which lineage is cut."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Set only where the caller has not set them.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}

_own_folder: list[str] = []


def get_spark(master: str = "local[8]", **conf: str) -> SparkSession:
    """A session with the defaults; entries of conf win."""
    builder = SparkSession.builder.master(master).appName("tactus")
    for key, value in (DEFAULTS | {"spark.ui.enabled": "false"} | conf).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def apply_defaults(spark: SparkSession, force: bool = False) -> dict[str, str]:
    """Set each default that has no value yet (all with force); returns what was set."""
    applied = {}
    for key, value in DEFAULTS.items():
        if force or spark.conf.get(key, None) is None:
            spark.conf.set(key, value)
            applied[key] = value
    return applied


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; a folder of our own only where it is unset and all runs on this machine, as in tests."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _own_folder:
        _own_folder.append("file://" + tempfile.mkdtemp(prefix="tactus-"))
    return _own_folder[0]


def fresh_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def durable(df: DataFrame, label: str, compression: str | None = None) -> DataFrame:
    """Write df to the shared folder and return a scan of it: what follows no longer depends on any executor."""
    path = fresh_path(df.sparkSession, label)
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def hadoop_path(spark: SparkSession, path: str):
    """(path, its file system) as Hadoop has them, for any store that Spark reads."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    place, store = hadoop_path(spark, path)
    return store.exists(place)
