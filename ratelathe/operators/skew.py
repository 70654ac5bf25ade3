"""Per-key results where a few keys hold most records.

Rows are first grouped by key and value (``weigh``), then by key. The first grouping spreads a hot key over its values
and shrinks it on the map side, so what the second one sees of a key is one row per distinct value. Counts, distinct
counts and modes follow from a plain aggregation of these weighted values, which combines on the map side again.
Percentiles need order within a key: the weighted values are sorted over ranges of (key, value), so a key with very many
values spreads over several tasks, each of which adds up weights within its range; only the two keys at a range's ends
need what other ranges hold of them, and that is two rows a range.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ratelathe.session import cut


def weigh(df: DataFrame, key: str, value: str) -> DataFrame:
    """``key, value, n``: one row per distinct pair, nulls included. Other columns are ignored whatever their names."""
    slim = df.select(F.col(key).alias("key"), F.col(value).alias("value"))
    return slim.groupBy("key", "value").agg(F.count("*").alias("n"))


def key_counts(weighted: DataFrame) -> DataFrame:
    """``key, rows, filled, distinct_values, mode_value``: all rows of the key, those with a value, its number of
    distinct values and the most frequent value (the smallest of equally frequent ones; null if it has none). The null
    key is a key as well."""
    some = F.col("value").isNotNull()
    # max_by has no second key: the smallest value of the highest weight is the least (-n, value).
    mode = F.min(F.when(some, F.struct((-F.col("n")).alias("n"), F.col("value").alias("value"))))["value"]
    return weighted.groupBy("key").agg(
        F.sum("n").alias("rows"),
        F.coalesce(F.sum(F.when(some, F.col("n"))), F.lit(0)).alias("filled"),
        F.count("value").alias("distinct_values"),
        mode.alias("mode_value"),
    )


def key_percentiles(weighted: DataFrame, percents: list[float], store: Callable[[DataFrame], DataFrame] = cut) -> DataFrame:
    """``key, percent, percentile`` (double): exact percentiles of each key's non-null values, between the two
    neighbouring values in proportion. Keys that are null or have no value are left out. ``store`` stores the sorted values."""
    slim = weighted.filter("key is not null and value is not null").select("key", F.col("value").cast("double").alias("value"), "n")
    kind = slim.schema["key"].dataType
    ordered = slim.repartitionByRange("key", "value").sortWithinPartitions("key", "value")
    field = lambda name, type_: T.StructField(name, type_)
    schema = T.StructType([field("key", kind), field("value", T.DoubleType()), field("n", T.LongType()), field("upto", T.LongType()), field("part", T.IntegerType())])

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, last, total = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            codes = batch.column("key").dictionary_encode().indices.to_numpy()
            starts = np.concatenate([[0], np.flatnonzero(codes[1:] != codes[:-1]) + 1])
            n = batch.column("n").to_numpy()
            sums = np.cumsum(n)
            before = np.repeat(sums[starts] - n[starts], np.diff(np.append(starts, len(n))))
            upto = sums - before
            if batch.column("key")[0].as_py() == last:
                upto[: starts[1] if len(starts) > 1 else len(n)] += total
            last, total = batch.column("key")[-1].as_py(), int(upto[-1])
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("value"), batch.column("n"), pa.array(upto), pa.array(np.full(len(n), part, np.int32))], names=schema.names)

    summed = store(ordered.mapInArrow(add_up, schema))
    sizes = summed.groupBy("key", "part").agg(F.sum("n").alias("held"))
    span = Window.partitionBy("key")
    placed = sizes.withColumn("before", F.sum("held").over(span.orderBy("part")) - F.col("held")).withColumn("total", F.sum("held").over(span))
    # Joined by (key, part), a key that spans ranges is spread over as many rows of the right side.
    full = summed.join(placed.drop("held"), ["key", "part"]).withColumn("upto", F.col("upto") + F.col("before"))
    asked = F.array(*[F.struct(F.lit(float(p)).alias("percent"), (F.lit(float(p)) * (F.col("total") - 1)).alias("at")) for p in percents])
    held = full.withColumn("want", F.explode(asked)).select("key", "value", "upto", (F.col("upto") - F.col("n")).alias("from"), "want.*")
    low, high = F.floor("at"), F.ceil("at")
    inside = lambda x: (F.col("from") <= x) & (x < F.col("upto"))
    picked = held.filter(inside(low) | inside(high))
    ends = picked.groupBy("key", "percent").agg(F.max(F.when(inside(low), F.col("value"))).alias("low"), F.max(F.when(inside(high), F.col("value"))).alias("high"), F.first("at").alias("at"))
    return ends.select("key", "percent", (F.col("low") + (F.col("high") - F.col("low")) * (F.col("at") - F.floor("at"))).alias("percentile"))


def overloaded_keys(weighted: DataFrame, total: int, share: float) -> DataFrame:
    """``key, rows, share``: the non-null keys that hold at least ``share`` of ``total`` rows, compared exactly."""
    held = weighted.groupBy("key").agg(F.sum("n").alias("rows")).filter("key is not null")
    return held.withColumn("share", F.col("rows") / F.lit(max(total, 1))).filter(F.col("rows") >= F.lit(Decimal(str(share)) * total))
