"""Session set-up and the few helpers that touch cluster-wide state."""

from __future__ import annotations

import gc
import os
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows and bytes up to which a side may be broadcast.
BROADCAST_ROWS, BROADCAST_BYTES = 1_000_000, 64 << 20
#: Bytes that a value of a type without a length of its own takes at most.
VALUE_BYTES = 16


def local_session(name: str = "ratelathe", cpus: int | None = None, **conf: str) -> SparkSession:
    """A local session for tests and benchmarks; a cluster brings its own."""
    cpus = cpus or int(os.environ.get("BENCH_CPUS", "8"))
    settings = {
        "spark.master": f"local[{cpus}]",
        "spark.app.name": name,
        "spark.driver.memory": "8g",
        "spark.sql.shuffle.partitions": str(cpus),
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.adaptive.enabled": "true",
        # What cut() stores is compressed, and deleted when nothing refers to it any more.
        "spark.checkpoint.compress": "true",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    } | conf
    spark = SparkSession.builder.config(map=settings).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, from spark.checkpoint.dir; a temporary one only in local mode without it."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    if not context.getCheckpointDir():
        context.setCheckpointDir(tempfile.mkdtemp(prefix="ratelathe-"))
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and stored in the shared folder; its lineage ends there, so a lost executor costs nothing."""
    spark = df.sparkSession
    folder = shared_dir(spark)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def packed(df: DataFrame) -> DataFrame:
    """As ``cut``, but stored as compressed Arrow batches whatever the session's settings, a fraction of what rows take;
    they are unpacked whenever they are read. For large tables that are kept for long."""
    import pyarrow as pa

    schema = df.schema

    def pack(batches):  # noqa: ANN001, ANN202
        for batch in batches:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_batch(batch)
            yield pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["batch"])

    def unpack(batches):  # noqa: ANN001, ANN202
        for batch in batches:
            for value in batch.column(0):
                yield from pa.ipc.open_stream(value.as_buffer())

    return cut(df.mapInArrow(pack, "batch binary")).mapInArrow(unpack, schema)


def release(spark: SparkSession) -> None:
    """Has Spark delete the stored results and shuffle files that nothing refers to any more, which else wait until the
    driver's JVM happens to collect its garbage: for loops that store something in every round."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def _value_bytes(value: Column, kind: T.DataType) -> Column:
    """About the bytes that a value takes; lists and maps by their text."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(value), F.lit(0)) + VALUE_BYTES
    if isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
        return F.coalesce(F.octet_length(F.to_json(F.struct(value))), F.lit(0)) + VALUE_BYTES
    return F.lit(VALUE_BYTES)


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES, known: int | None = None) -> DataFrame:
    """``df`` with a broadcast hint if counting proves that it has at most ``rows`` rows and about ``size`` bytes;
    otherwise ``df`` itself, which Spark then joins by shuffling with its own skew handling. Pass something cheap to
    count, or the ``known`` number of rows of columns without a length of their own."""
    if known is not None:
        return F.broadcast(df) if known <= rows and known * len(df.columns) * VALUE_BYTES <= size else df
    row = sum((_value_bytes(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields), F.lit(0))
    n, total = df.limit(rows + 1).agg(F.count("*"), F.coalesce(F.sum(row), F.lit(0))).first()
    return F.broadcast(df) if n <= rows and total <= size else df
