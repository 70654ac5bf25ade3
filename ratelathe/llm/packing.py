"""Filling containers of fixed capacity with items that are not split unless they exceed it.

Items are dealt to shards of bounded size, and each shard is packed on its own: a container takes the largest item that
still fits, again and again (best fit); then, while that leaves less unused space, its smallest item goes back and two
unpacked ones that fit the wider gap more tightly take its place (best two fit). Sizes are counted by value, so a step
looks at no more values than the capacity has. A shard leaves one container partly empty at worst beyond what its sizes
force, so the loss from sharding is a container in some ten thousands.

An item larger than the capacity fills whole containers; what remains of it is an item like any other.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ratelathe.session import cut

#: Items in a shard, on average; it bounds the memory of a task.
SHARD_ITEMS = 100_000


def pack(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """A container number for each size; sizes lie between 0 and ``capacity``. Items of size 0 join container 0. Equal
    sizes are taken in their order."""
    counts = np.bincount(sizes, minlength=capacity + 1)
    counts[0] = 0
    bins: list[list[int]] = []
    values = np.arange(capacity + 1)
    while counts.any():
        gap, held = capacity, []
        while True:
            fits = np.flatnonzero(counts[1 : gap + 1])
            if not len(fits):
                break
            held.append(int(fits[-1]) + 1)
            counts[held[-1]] -= 1
            gap -= held[-1]
        while gap and counts.any():
            least = min(held)
            two = _two_fit(counts, values, least, gap + least)
            if two is None:
                break
            held.remove(least)
            counts[least] += 1
            for x in two:
                held.append(x)
                counts[x] -= 1
            gap += least - sum(two)
        bins.append(held)
    places = defaultdict(list)
    for number, held in enumerate(bins):
        for x in held:
            places[x].append(number)
    found = np.zeros(len(sizes), np.int64)
    order = np.argsort(sizes, kind="stable")
    edges = np.flatnonzero(np.diff(sizes[order], prepend=-1))
    for lo, hi in zip(edges, np.append(edges[1:], len(order))):
        if size := int(sizes[order[lo]]):
            found[order[lo:hi]] = places[size]
    return found


def _two_fit(counts: np.ndarray, values: np.ndarray, least: int, room: int) -> tuple[int, int] | None:
    """The two unpacked sizes whose sum is largest within ``room`` and above ``least``; None if there are none."""
    floor = np.maximum.accumulate(np.where(counts > 0, values, 0))
    first = values[1:room][counts[1:room] > 0]
    if not len(first):
        return None
    second = floor[room - first]
    # The same size twice needs two of it; else the next smaller one.
    alone = (second == first) & (counts[first] < 2)
    second = np.where(alone, floor[first - 1], second)
    total = np.where(second > 0, first + second, 0)
    best = int(total.argmax())
    return (int(first[best]), int(second[best])) if total[best] > least else None


def fill_containers(items: DataFrame, key: str, size: str, capacity: int, shard_items: int = SHARD_ITEMS) -> DataFrame:
    """``container_id, id, part, start, length``: each item's place. ``part`` counts an item's pieces from 0, ``start``
    is the piece's place in its item; only an item larger than ``capacity`` has several. A null or negative size counts
    as 0; items of size 0 are put beside others and take no space. Ids need not be unique. No items give no rows."""
    slim = items.select(F.col(key).alias("id"), F.greatest(F.coalesce(F.col(size).cast("long"), F.lit(0)), F.lit(0)).alias("size"))
    slim = cut(slim.withColumn("row", F.monotonically_increasing_id()))
    shards = max(1, -(-slim.count() // shard_items))
    whole = F.floor(F.col("size") / capacity).cast("long")
    full = slim.filter(F.col("size") >= capacity).select("id", "row", F.posexplode(F.sequence(F.lit(0).cast("long"), whole - 1)).alias("part", "k"))
    # Container ids: rest items by shard and number, full pieces after them by row and part.
    full = full.select(F.concat(F.lit("f"), "row", F.lit("-"), "part").alias("container_id"), "id", F.col("part").cast("long").alias("part"), (F.col("k") * capacity).alias("start"), F.lit(capacity).cast("long").alias("length"))
    rest = slim.withColumn("length", F.pmod("size", F.lit(capacity))).filter("length > 0 or size = 0")
    rest = rest.select("id", "row", whole.alias("part"), (F.col("size") - F.col("length")).alias("start"), "length", F.pmod(F.xxhash64("row"), F.lit(shards)).cast("int").alias("shard"))
    kind = rest.schema["id"].dataType
    schema = T.StructType([T.StructField("container_id", T.StringType()), T.StructField("id", kind), *(T.StructField(c, T.LongType()) for c in ("part", "start", "length"))])

    def one(batch: pa.Table) -> pa.Table:
        batch = batch.sort_by("row")
        numbers = pack(batch["length"].to_numpy(), capacity)
        shard = batch["shard"][0].as_py()
        names = pa.array([f"s{shard}-{n}" for n in numbers.tolist()])
        return pa.table([names, *(batch[c] for c in ("id", "part", "start", "length"))], names=schema.names)

    return full.unionByName(rest.groupBy("shard").applyInArrow(one, schema))


def fill_summary(placed: DataFrame, capacity: int) -> DataFrame:
    """One row: ``containers``, ``filled`` (units), ``least_possible`` (containers if nothing were unused) and ``fill``."""
    total = placed.agg(F.countDistinct("container_id").alias("containers"), F.coalesce(F.sum("length"), F.lit(0)).alias("filled"))
    return total.withColumn("least_possible", F.ceil(F.col("filled") / capacity)).withColumn("fill", F.try_divide(F.col("filled"), F.col("containers") * capacity))
