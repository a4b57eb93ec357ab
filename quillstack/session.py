"""Session helpers: input tables and the shared folder for intermediate tables."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"

_local_dirs: dict[str, str] = {}
_shipped: set[str] = set()


def local_session(cores: str = "*", shuffle_partitions: int = 8, **conf) -> SparkSession:
    """A single-machine session for tests and the benchmark."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("quillstack")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "16g")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def path_exists(spark: SparkSession, path: str) -> bool:
    location = spark._jvm.org.apache.hadoop.fs.Path(path)
    return location.getFileSystem(spark._jsc.hadoopConfiguration()).exists(location)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Use all cores on a stored table that is read in fewer pieces than there are
    cores. A large table has enough pieces of its own and is not shuffled."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, *keys) if df.rdd.getNumPartitions() < cores else df


def read_documents(spark: SparkSession, folder: str) -> DataFrame:
    """The document table for work that is heavy per row."""
    return spread(read_table(spark, folder, "documents"), "doc_id")


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Where the setting is missing a temporary folder is used and removed at the end, but
    only in local mode: a machine-local folder on a cluster would be lost with its machine.
    """
    sc = spark.sparkContext
    folder = spark.conf.get(CHECKPOINT_KEY, None) or sc.getConf().get(CHECKPOINT_KEY)
    if folder:
        return folder.rstrip("/")
    if not sc.master.startswith("local"):
        raise RuntimeError(f"set {CHECKPOINT_KEY} to a folder shared by all executors")
    if sc.applicationId not in _local_dirs:
        _local_dirs[sc.applicationId] = tempfile.mkdtemp(prefix="quillstack-")
        atexit.register(shutil.rmtree, _local_dirs[sc.applicationId], ignore_errors=True)
        sc.setCheckpointDir(_local_dirs[sc.applicationId])
    return _local_dirs[sc.applicationId]


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write a reused stage once and read it back: the lineage ends at stored files."""
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_stages: dict[tuple[str, str, str], str] = {}


def stored_once(spark: SparkSession, folder: str, label: str, write) -> str:
    """Path of a stage of an input folder, written by ``write(path)`` at first use
    in this application and read by everything after it."""
    stage = (spark.sparkContext.applicationId, folder, label)
    if stage not in _stages:
        path = new_path(spark, label)
        write(path)
        _stages[stage] = path
    return _stages[stage]


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application, so that they
    can import it wherever the driver was started."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    package = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="quillstack-code-"), "quillstack")
    archive = shutil.make_archive(
        target, "zip", os.path.dirname(package), os.path.basename(package)
    )
    sc.addPyFile(archive)
    _shipped.add(sc.applicationId)
