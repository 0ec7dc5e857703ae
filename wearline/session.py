"""Session helpers: builder defaults, size checks and the written tables that cut lineage."""

from __future__ import annotations

import shutil
import tempfile
from collections.abc import Sequence
from pathlib import Path
from uuid import uuid4

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

#: Inputs up to this many bytes let one task hold the largest possible group.
TASK_BYTES_KEY = "spark.wearline.taskBytes"
TASK_BYTES = 64 * 1024 * 1024


def build_session(app: str = "wearline", master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """Session with adaptive execution on; a cluster supplies its own master and checkpoint folder."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.execution.arrow.maxBytesPerBatch", str(64 * 1024 * 1024))
    )
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()


def source_bytes(df: DataFrame) -> int:
    """Upper bound, from Catalyst's own statistics, of the bytes the plan's sources hold."""
    leaves = df._jdf.queryExecution().analyzed().collectLeaves()
    return sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))


def _task_bytes(spark: SparkSession) -> int:
    return int(spark.conf.get(TASK_BYTES_KEY, str(TASK_BYTES)))


def fits_one_task(df: DataFrame, share: float = 1.0) -> bool:
    """True when even a group holding every source row would be small enough for a single task (or a share of it)."""
    return source_bytes(df) <= _task_bytes(df.sparkSession) * share


def task_rows(spark: SparkSession) -> int:
    """Rows of a group that a single task may hold, at 64 bytes each."""
    return _task_bytes(spark) // 64


def measured_joins(spark: SparkSession) -> None:
    """Let only adaptive execution choose broadcasts, by the bytes it has measured, never the planner by file sizes.

    A written table is many times smaller in Parquet than in memory, so a size read off its files sends far more through the driver
    than the limit says. The limit itself stays the session's.
    """
    static, adaptive = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"
    limit = spark.conf.get(static)
    if spark.conf.get("spark.sql.adaptive.enabled") == "true" and limit != "-1":
        if spark.conf.get(adaptive, None) is None:
            spark.conf.set(adaptive, limit)
        spark.conf.set(static, "-1")


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``; only local mode may fall back to a new one."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="wearline-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return folder


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers once per application, wherever the driver imported it from."""
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        package = Path(__file__).resolve().parent
        archive = shutil.make_archive(f"{tempfile.mkdtemp(prefix='wearline-')}/{package.name}", "zip", package.parent, package.name)
        context.addPyFile(archive)
        _shipped.add(context.applicationId)


def scratch(spark: SparkSession, label: str) -> str:
    """A new folder below the one all executors share."""
    return f"{shared_folder(spark)}/{label}-{uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Write the rows to the shared folder and read them back.

    Later uses see the same rows, also after executors are lost, read only the columns they need and know the
    table's true size.
    """
    folder = scratch(df.sparkSession, "table")
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def parameter_table(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    """A few fitted numbers as a local relation, broadcast where rows are joined to them."""
    kind = T.StructType.fromDDL(schema)
    columns = {f.name: [r[i] for r in rows] for i, f in enumerate(kind.fields)}
    return spark.createDataFrame(pa.table(columns), schema=kind).hint("broadcast")
