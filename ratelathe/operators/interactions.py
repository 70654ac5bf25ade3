"""The dense-id interaction table, its dimension tables, and summaries of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratelathe.operators.dense_ids import dense_ids, numbered
from ratelathe.session import broadcast_if_small


def id_mapping(ratings: DataFrame, raw: str, idx: str) -> DataFrame:
    """``raw, idx``: the distinct non-null raw ids with their 0-based place in sorted order."""
    return dense_ids(ratings.select(raw).dropna().distinct(), [raw], idx).withColumn(idx, F.col(idx).cast("int"))


def id_mappings(ratings: DataFrame, names: dict[str, str]) -> list[tuple[DataFrame, int]]:
    """``id_mapping`` of several raw columns of one type, each with its number of ids: read, sorted and stored at once."""
    raws = list(names)
    every = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(raw).alias("raw")) for k, raw in enumerate(raws)]))
    found, _ = numbered(ratings.select(every.alias("x")).select("x.*").dropna().distinct(), ["kind", "raw"], "place")
    first = {r["kind"]: (r["first"], r["n"]) for r in found.groupBy("kind").agg(F.min("place").alias("first"), F.count("*").alias("n")).collect()}
    mapped = lambda k, raw: found.filter(F.col("kind") == k).select(F.col("raw").alias(raw), (F.col("place") - first.get(k, (0, 0))[0]).cast("int").alias(names[raw]))
    return [(mapped(k, raw), first.get(k, (0, 0))[1]) for k, raw in enumerate(raws)]


def with_row_ids(ratings: DataFrame, order: list[str]) -> DataFrame:
    """``ratings`` with the 0-based bigint ``row_id`` in the order of the given columns."""
    return dense_ids(ratings.drop("row_id"), order, "row_id") if order else ratings.withColumn("row_id", F.monotonically_increasing_id())


def build_interactions(ratings: DataFrame, users: DataFrame, items: DataFrame, known: tuple[int | None, int | None] = (None, None)) -> DataFrame:
    """``row_id, user_idx, item_idx, rating, timestamp, raw_user_id, raw_item_id``: ratings with their dense ids. Rows
    with a null id, which no mapping holds, drop out. A mapping is broadcast only if a count, or the ``known`` numbers
    of users and items, prove it small."""
    joined = ratings.join(broadcast_if_small(users, known=known[0]), "raw_user_id").join(broadcast_if_small(items, known=known[1]), "raw_item_id")
    return joined.select("row_id", "user_idx", "item_idx", "rating", "timestamp", "raw_user_id", "raw_item_id")


def with_index(dim: DataFrame, mapping: DataFrame, raw: str, idx: str) -> DataFrame:
    """``dim`` with ``idx`` after ``raw``; null for ids that were never rated."""
    columns = [c for c in dim.columns if c != idx]
    at = columns.index(raw) + 1
    joined = dim.select(columns).join(broadcast_if_small(mapping), raw, "left")
    return joined.select(*columns[:at], idx, *columns[at:])


def summary(interactions: DataFrame) -> DataFrame:
    """One row: ``interactions, users, rated_items, rating_min, rating_max, rating_mean`` (mean in double)."""
    rating = F.col("rating").cast("double")
    return interactions.agg(
        F.count("*").alias("interactions"),
        F.countDistinct("user_idx").alias("users"),
        F.countDistinct("item_idx").alias("rated_items"),
        F.min(rating).alias("rating_min"),
        F.max(rating).alias("rating_max"),
        F.avg(rating).alias("rating_mean"),
    )


def checksum(interactions: DataFrame) -> DataFrame:
    """One row ``checksum``: the sum of all user ids, item ids and ratings."""
    total = F.sum(F.col("user_idx").cast("double")) + F.sum(F.col("item_idx").cast("double")) + F.sum(F.col("rating").cast("double"))
    return interactions.agg(F.coalesce(total, F.lit(0.0)).alias("checksum"))


def fingerprint(df: DataFrame, columns: list[str]) -> str:
    """A digest of the rows' content that does not depend on their order or partitions, with the columns' types."""
    kinds = ",".join(df.schema[c].dataType.simpleString() for c in columns)
    digest = F.xxhash64(*columns)
    # Sums of 20, 20 and 24 bits of the digests, none of which a bigint is too small for with up to 2 ** 39 rows.
    pieces = [F.pmod(digest, F.lit(1 << 20)), F.shiftrightunsigned(digest, 20).bitwiseAND((1 << 20) - 1), F.shiftrightunsigned(digest, 40)]
    n, xor, low, middle, high = df.agg(F.count("*"), F.bit_xor(digest), *[F.coalesce(F.sum(x), F.lit(0)) for x in pieces]).first()
    import hashlib

    return hashlib.sha256(f"{kinds}:{(n, xor, low + (middle << 20), high)}".encode()).hexdigest()
