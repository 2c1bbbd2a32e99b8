"""Session settings and the reliable checkpoint folder."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

RUNTIME_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # branches of a union are sized at run time; claiming a common partitioning for them fails when they differ
    "spark.sql.unionOutputPartitioning": "false",
}


#: bytes a task reads at most. Compressed measurements grow tenfold in the memory of a task that sorts them, and what
#: does not fit there is spilled, so that with Spark's own bounds spills outgrow the tables
TASK_BYTES = 16 << 20
#: a size that gives more tasks is none that is known
MOST_TASKS = 10_000
TASK_SIZES = {"spark.sql.files.maxPartitionBytes": "128m", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64m"}
UNITS = {"b": 0, "k": 10, "kb": 10, "m": 20, "mb": 20, "g": 30, "gb": 30, "": 0}


def byte_count(text: str) -> int:
    """Bytes of a size as Spark settings give it."""
    number, unit = re.fullmatch(r"\s*(\d+)\s*([a-z]*)\s*", text.lower()).groups()
    return int(number) << UNITS[unit]


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings the plans rely on to an existing session."""
    for key, value in RUNTIME_SETTINGS.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    for key, usual in TASK_SIZES.items():
        # smaller ones, as a session may have set, stay
        if byte_count(spark.conf.get(key, usual)) > TASK_BYTES:
            spark.conf.set(key, str(TASK_BYTES))
    return spark


def local_session(cores: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests and benchmarks."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("waferlake")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder of the session.

    The cluster names it in ``spark.checkpoint.dir``. Only a local master may
    fall back to a folder of its own; elsewhere a machine-local path would be
    lost with the machine.
    """
    sc = spark.sparkContext
    known = sc.getCheckpointDir()
    if known:
        return known
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder")
        named = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    sc.setCheckpointDir(named)
    return named


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, asked of the file system Spark reads it by."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)


def staged(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """Write a table several branches read to the shared folder and read it back.

    The branches then scan pruned columns of one table, a lost executor costs a
    re-read and no recomputation, and joins know the size they broadcast by.
    """
    path = f"{checkpoint_dir(df.sparkSession)}/staged/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.parquet(path)


def dealt(df: DataFrame, keys: Sequence[Column]) -> DataFrame:
    """Rows with equal keys in one task, in as many tasks as the size of what is read asks for."""
    spark = df.sparkSession
    tasks = -(-int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) // TASK_BYTES)
    usual = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # no number, where the usual one does: then small ones are put together at run time
    return df.repartition(tasks, *keys) if usual < tasks < MOST_TASKS else df.repartition(*keys)


def local_frame(spark: SparkSession, rows: Sequence[tuple], schema: str | T.StructType) -> DataFrame:
    """A small parameter table as a local relation.

    Its size is known to the optimizer, which therefore broadcasts it by the
    session's threshold; a frame built from Python rows has no known size.
    """
    if isinstance(schema, str):
        schema = T._parse_datatype_string(schema)
    columns = list(zip(*rows)) if rows else [[] for _ in schema.fields]
    arrow = to_arrow_schema(schema)
    table = pa.table([pa.array(list(c), type=f.type) for c, f in zip(columns, arrow)], schema=arrow)
    return spark.createDataFrame(table, schema=schema)
