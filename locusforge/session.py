"""Session helpers: building a session, reading tables, cutting lineage."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str = "local[*]", app: str = "locusforge", **conf: str) -> SparkSession:
    """A session with the settings that the operators are designed for.

    Everything set here may be overridden by keyword arguments (dots written as ``__``).
    """
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.parquet.compression.codec": "zstd",
        "spark.sql.requireAllClusterKeysForCoPartition": "false",
        "spark.ui.enabled": "false",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    builder = SparkSession.builder.master(master).appName(app)
    for k, v in settings.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` of a directory that holds one Parquet file or folder per table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder for checkpoints that all executors share.

    The cluster names it in ``spark.checkpoint.dir``. Only where neither that setting nor a folder
    set on the context exists (tests in one process) a temporary folder is made.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    present = sc.getCheckpointDir()
    if present:
        return present
    if named:
        sc.setCheckpointDir(named)
    elif sc.master.startswith("local[") or sc.master == "local":
        folder = tempfile.mkdtemp(prefix="locusforge-checkpoint-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        sc.setCheckpointDir(folder)
    else:
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return sc.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder and read back; survives lost executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def spread(df: DataFrame, key: str, least: int | None = None) -> DataFrame:
    """``df`` in at least ``least`` partitions (the cores of the session if not given), for costly work per row.

    Inputs that have as many stay as they lie, so that large texts are never shuffled; a few files are dealt by ``key``. Only the number
    of partitions counts, which the plan has.
    """
    cores = max(1, df.sparkSession.sparkContext.defaultParallelism)
    return df if df.rdd.getNumPartitions() >= (cores if least is None else least) else df.repartition(3 * cores, key)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
