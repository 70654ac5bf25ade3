"""Items that appear together in baskets: pair counts and their ratio to chance.

Items get dense ids by ascending frequency, and every pair is counted under its rarer item, so that frequent items are
nobody's key. A basket turns into stripes: one row per item with all of the basket's more frequent items, four bytes
each, in place of a row per pair. A basket with more items than a block is dealt, by a hash of the items, to as many
chunks as its size makes blocks, and every product of two chunks is a row of its own that any task may take. Stripes of
both kinds are shuffled by the rarer item, which is the only time that pairs move, and counted there.

Items that cannot be in any wanted pair are left out before; both bounds are exact. A pair is in no more baskets than
its rarer item, so items of fewer than ``min_count`` baskets drop out, as do items in more than 1 / ``min_ratio`` of all
baskets, since a pair's ratio to chance is at most (all baskets) / (baskets with the more frequent item).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ratelathe.operators.dense_ids import dense_ids
from ratelathe.session import broadcast_if_small, cut

#: Items in a chunk; a larger basket is split. Baskets of one item above which the item's stripes are split, too.
BLOCK_ITEMS, KEY_BASKETS = 1_024, 1_000_000
#: Pairs that a task sorts at once.
TALLY_PAIRS = 4_000_000


def _products(sides: DataFrame) -> DataFrame:
    """Stripes ``x, ys, basket``: each id of the ascending arrays ``left`` and ``right`` with the larger ones of the
    other array; of the only one if ``right`` is null."""
    one = lambda ours, theirs: sides.filter("right is not null").select("basket", theirs, F.explode(ours).alias("x"))
    later = lambda theirs: F.filter(theirs, lambda y: y > F.col("x"))
    both = [one(a, b).select("basket", "x", later(b).alias("ys")) for a, b in (("left", "right"), ("right", "left"))]
    alone = sides.filter("right is null").select("basket", "left", F.posexplode("left").alias("k", "x"))
    alone = alone.select("basket", "x", F.slice("left", F.col("k") + 2, F.size("left")).alias("ys"))
    return alone.unionByName(both[0]).unionByName(both[1]).filter(F.size("ys") > 0)


def pair_counts(df: DataFrame, basket: str, item: str, min_count: int = 1, min_ratio: float = 0.0, block_items: int = BLOCK_ITEMS, key_baskets: int = KEY_BASKETS) -> DataFrame:
    """``item_a, item_b, together, baskets_a, baskets_b, baskets, ratio`` of every pair of different items, the smaller
    first, that at least ``min_count`` baskets hold together and whose ratio to chance, together x baskets /
    (baskets_a x baskets_b), is at least ``min_ratio``. A basket is the set of distinct items of one non-null basket
    key; null items are left out, repeated rows count once. No pair gives no rows."""
    sets = cut(df.select(F.col(basket).alias("basket"), F.col(item).alias("item")).dropna().distinct())
    n = sets.select("basket").distinct().count()
    kept = sets.groupBy("item").agg(F.count("*").alias("baskets")).filter((F.col("baskets") >= min_count) & (F.col("baskets") * F.lit(min_ratio) <= n))
    ids = dense_ids(kept, ["baskets", "item"], "id").withColumn("id", F.col("id").cast("int"))
    top = ids.agg(F.max("baskets")).first()[0] or 0
    encoded = sets.join(broadcast_if_small(ids.select("item", "id")), "item").select("basket", "id")
    sized = encoded.groupBy("basket").agg(F.count("*").alias("size")).filter(F.col("size") > block_items)
    # At most (all rows) / block_items keys.
    large = broadcast_if_small(cut(sized.select("basket", F.ceil(F.col("size") / block_items).cast("int").alias("chunks"))))
    chunks = encoded.join(large, "basket", "left").withColumn("chunk", F.pmod(F.hash("id"), F.col("chunks")))
    chunks = cut(chunks.groupBy("basket", "chunks", "chunk").agg(F.sort_array(F.collect_list("id")).alias("ids")))
    alone = chunks.select("basket", F.col("ids").alias("left"), F.expr("cast(null as array<int>)").alias("right"))
    stripes = _products(alone.unionByName(_chunk_pairs(chunks.filter("chunks is not null"))))
    return _scores(_count(stripes, ids, top, max(1, min_count), key_baskets), ids, n, min_ratio)


def _chunk_pairs(chunks: DataFrame) -> DataFrame:
    """``basket, left, right`` for every two chunks of a basket. Each chunk is sent to its pairs and met there by the
    other one, so that the pairs of a basket with very many chunks are not made in one task."""
    others = F.filter(F.sequence(F.lit(0), F.col("chunks") - 1), lambda k: k != F.col("chunk"))
    sent = chunks.withColumn("other", F.explode(others))
    first = F.col("chunk") < F.col("other")
    sides = sent.select("basket", F.least("chunk", "other").alias("lo"), F.greatest("chunk", "other").alias("hi"), F.when(first, F.col("ids")).alias("left"), F.when(~first, F.col("ids")).alias("right"))
    met = sides.groupBy("basket", "lo", "hi").agg(F.first("left", True).alias("left"), F.first("right", True).alias("right"))
    # A chunk that no item was dealt to has no pairs.
    return met.filter("left is not null and right is not null").select("basket", "left", "right")


def _tally(least: int):  # noqa: ANN202
    """For mapInArrow over stripes ``x, ys`` sorted by x: ``x, y, together`` of every pair with ``least`` stripes or
    more. Pairs are sorted as numbers, a bounded number of them at a time; what is not yet counted to its end is at most
    an item's pairs."""

    def run(batches):  # noqa: ANN001, ANN202
        keys, counts, waiting, size = np.zeros(0, np.int64), np.zeros(0, np.int64), [], 0

        def counted() -> tuple[np.ndarray, np.ndarray]:
            found = np.sort(np.concatenate([np.zeros(0, np.int64), *waiting]))
            starts = np.flatnonzero(np.diff(found, prepend=-1))
            found, n = found[starts], np.diff(np.append(starts, len(found)))
            if not len(keys):
                return found, n
            both, n = np.concatenate([keys, found]), np.concatenate([counts, n])
            order = np.argsort(both, kind="stable")
            both = both[order]
            starts = np.flatnonzero(np.diff(both, prepend=-1))
            return both[starts], np.add.reduceat(n[order], starts) if len(both) else n

        def told(keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
            keys, counts = keys[counts >= least], counts[counts >= least]
            return pa.RecordBatch.from_arrays([pa.array((keys >> 32).astype(np.int32)), pa.array((keys & 0xFFFFFFFF).astype(np.int32)), pa.array(counts.astype(np.int64))], names=["x", "y", "together"])

        for batch in batches:
            lists = batch["ys"]
            x = np.repeat(batch["x"].to_numpy().astype(np.int64) << 32, np.diff(lists.offsets.to_numpy()))
            waiting.append(x | lists.flatten().to_numpy().astype(np.int64))
            size += len(x)
            if size >= TALLY_PAIRS:
                keys, counts = counted()
                done = int(np.searchsorted(keys, keys[-1] >> 32 << 32))
                yield told(keys[:done], counts[:done])
                keys, counts, waiting, size = keys[done:], counts[done:], [], 0
        yield told(*counted())

    return run


def _count(stripes: DataFrame, ids: DataFrame, top: int, min_count: int, key_baskets: int) -> DataFrame:
    """``x, y, together`` of pairs with at least ``min_count``. Stripes with one x meet in one task, which counts them to
    the end; but those of items with more baskets than ``key_baskets``, which are rarer than the other item of few pairs
    only, are counted in several parts that are added up."""

    def tallied(df: DataFrame, by: list[str], least: int) -> DataFrame:
        return df.repartition(*by).sortWithinPartitions("x").select("x", "ys").mapInArrow(_tally(least), "x int, y int, together bigint")

    if top <= key_baskets:
        return tallied(stripes, ["x"], min_count)
    first_hot = ids.filter(F.col("baskets") > key_baskets).agg(F.min("id")).first()[0]
    hot = stripes.filter(F.col("x") >= first_hot).withColumn("part", F.pmod(F.hash("basket"), F.lit(-(-top // key_baskets))))
    parts = tallied(hot, ["x", "part"], 1).groupBy("x", "y").agg(F.sum("together").alias("together"))
    return tallied(stripes.filter(F.col("x") < first_hot), ["x"], min_count).unionByName(parts.filter(F.col("together") >= min_count))


def _exact(x: Column) -> Column:
    return x.cast("decimal(15,0)")


def _scores(counted: DataFrame, ids: DataFrame, n: int, min_ratio: float) -> DataFrame:
    slim = broadcast_if_small(ids)
    x = slim.select(F.col("id").alias("x"), F.col("item").alias("item_x"), F.col("baskets").alias("baskets_x"))
    y = slim.select(F.col("id").alias("y"), F.col("item").alias("item_y"), F.col("baskets").alias("baskets_y"))
    both = counted.join(x, "x").join(y, "y")
    chance = _exact(F.col("baskets_x")) * _exact(F.col("baskets_y"))
    wanted = both.filter(_exact(F.col("together")) * _exact(F.lit(n)) >= chance * F.lit(min_ratio).cast("decimal(8,3)"))
    swap = F.col("item_x") > F.col("item_y")
    return wanted.select(
        F.least("item_x", "item_y").alias("item_a"),
        F.greatest("item_x", "item_y").alias("item_b"),
        "together",
        F.when(swap, F.col("baskets_y")).otherwise(F.col("baskets_x")).alias("baskets_a"),
        F.when(swap, F.col("baskets_x")).otherwise(F.col("baskets_y")).alias("baskets_b"),
        F.lit(n).cast("long").alias("baskets"),
        (F.col("together").cast("double") * n / F.col("baskets_x") / F.col("baskets_y")).alias("ratio"),
    )
