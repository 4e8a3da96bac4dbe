"""Session settings shared by jobs, tests and the benchmark."""

from __future__ import annotations

import hashlib
import os
import tempfile
import uuid
from collections.abc import Callable
from contextvars import ContextVar

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.sql.variant.allowDuplicateKeys": "true",
    # State timeouts are checked when data arrives; without this they keep starting empty batches.
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
    "spark.ui.enabled": "false",
}


def build_session(master: str | None = None, shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName("pagewright")
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **conf}.items():
        builder = builder.config(key, value)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Take the shared folder the cluster names; fall back to a local one only in local mode."""
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        folder = tempfile.mkdtemp(prefix=f"pagewright-checkpoint-{os.getpid()}-")
    sc.setCheckpointDir(folder)


def shared_folder(spark: SparkSession) -> str:
    """A new place in the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/place-{uuid.uuid4().hex}"


#: Folders and catalog tables that were written on the way and not emptied yet: those of the run that ``stored`` makes just
#: now, each run having a list of its own, or else of the process.
_loose: list[tuple[str, str | None]] = []
_run: ContextVar[list[tuple[str, str | None]] | None] = ContextVar("run", default=None)


def _note(path: str, table: str | None = None) -> None:
    own = _run.get()
    (_loose if own is None else own).append((path, table))


def write_through(df: DataFrame) -> DataFrame:
    """Write a table to the shared checkpoint folder and read it back.

    The rows survive the loss of any executor, are computed once, and later plans see their size. No
    partitioning is remembered, so a join on a hot key is a shuffle on both sides that adaptive execution
    can split.
    """
    ensure_checkpoint_dir(df.sparkSession)
    path = f"{df.sparkSession.sparkContext.getCheckpointDir()}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _note(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_bucketed(df: DataFrame, columns: list[str], path: str, buckets: int, partition: str | None = None) -> DataFrame:
    """Append rows to a table at a path, dealt out by columns: joins and sums on these move the other side only.

    ``partition`` names a column whose values get sub-folders. A table that is not in this session's catalog yet, as after
    a restart, is entered under a name that follows from its path, with the partitions found there.
    """
    spark = df.sparkSession
    table = open_bucketed(spark, df.schema, columns, path, buckets, partition)
    df.repartition(buckets, *columns).select(spark.table(table).columns).write.insertInto(table)
    return spark.table(table)


def open_bucketed(spark: SparkSession, schema, columns: list[str], path: str, buckets: int, partition: str | None = None) -> str:
    """The catalog name of a bucketed table at a path, entered if it is not."""
    table = "table_" + hashlib.md5(path.encode()).hexdigest()
    if not spark.catalog.tableExists(table):
        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
        parted = f"PARTITIONED BY (`{partition}`)" if partition else ""
        keys = ", ".join(f"`{c}`" for c in columns)
        spark.sql(f"CREATE TABLE {table} ({fields}) USING parquet OPTIONS (path '{path}') {parted} CLUSTERED BY ({keys}) SORTED BY ({keys}) INTO {buckets} BUCKETS")
        _note(path, table)
        if partition and _exists(spark, path):
            spark.sql(f"MSCK REPAIR TABLE {table}")
    return table


def stored(spark: SparkSession, make: Callable[[], DataFrame]) -> DataFrame:
    """``write_through(make())``; the tables that ``make`` wrote on the way are emptied once its result is stored."""
    own: list[tuple[str, str | None]] = []
    token = _run.set(own)
    try:
        out = write_through(make())
    finally:
        _run.reset(token)
    kept = own.pop()
    _empty(spark, own)
    _note(*kept)
    return out


def empty_tables(spark: SparkSession) -> None:
    """Empty what was written outside of ``stored``; for tables that no DataFrame in use reads any more."""
    _empty(spark, _loose)


def _empty(spark: SparkSession, written: list[tuple[str, str | None]]) -> None:
    """Replace the rows of intermediate tables by none and take their names out of the catalog."""
    while written:
        path, table = written.pop()
        if table:
            spark.sql(f"DROP TABLE IF EXISTS {table}")
        spark.range(0).write.mode("overwrite").parquet(path)


def _exists(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.schema("x int").parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return False
    return True


def read_folder(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A folder of Parquet files, or no rows before the first one is written."""
    return spark.read.schema(schema).parquet(path) if _exists(spark, path) else spark.createDataFrame([], schema)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint, for rows that later steps read several times."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
