"""Dense 0-based ids in sorted order, without a single task that sorts or counts everything."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratelathe.session import cut

#: Bits of Spark's row numbers that count within a partition.
LOCAL_BITS = 33


def numbered(df: DataFrame, order: list[str], name: str, drop: tuple[str, ...] = (), store: Callable[[DataFrame], DataFrame] = cut) -> tuple[DataFrame, int]:
    """``df`` with the bigint ``name``: each row's place in the order of ``order``, from 0; and the number of rows. The
    order must be total (a unique combination), or ties take any order. Rows are sorted over ranges and stored once;
    each range then adds the number of rows in the ranges before it. The driver sees a row per range, a partition.
    Columns to ``drop``, which serve the order only, are not stored. ``store`` stores the rows."""
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id())
    placed = store(placed.drop(*drop)).withColumns({"__part": F.shiftright("__at", LOCAL_BITS), "__at": F.col("__at").bitwiseAND((1 << LOCAL_BITS) - 1)})
    total, before = 0, []
    for part, n in sorted(tuple(r) for r in placed.groupBy("__part").agg(F.count("*").alias("n")).collect()):
        before.append((part, total))
        total += n
    offsets = df.sparkSession.createDataFrame(before, "__of bigint, __before bigint")
    joined = placed.join(F.broadcast(offsets), F.col("__part") == F.col("__of"))
    return joined.withColumn(name, F.col("__at") + F.col("__before")).drop("__part", "__at", "__of", "__before"), total


def dense_ids(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """``numbered`` without the number of rows."""
    return numbered(df, order, name)[0]
