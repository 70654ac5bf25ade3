"""Seeded splits of ratings into train, validation and test that keep every user and item in training.

Rows get a position in a seeded order. The first ``train`` positions are training rows; a later row is one as well if it
is the first of its user or of its item in that order, since neither can then be known from training. That is the
outcome of walking the rest in order and moving each row whose user or item is not yet known, found here with two
minima, of which only those beyond the first training rows matter. Rows that stay keep their order: validation takes as
many as was asked, test the others; where it ends follows from the numbers of the moved rows. So the rows are sorted and
stored once, and nothing but positions of moved rows is joined to them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ratelathe.operators.dense_ids import numbered
from ratelathe.operators.views import Ratings
from ratelathe.session import broadcast_if_small, cut, packed

FAMILIES = ("benchmark_random_v1", "paper_faithful_ml100k_v1", "paper_faithful_ml100k_inner_v1")


def order_key(seed: int) -> Column:
    """The seeded order of rows: a digest of the row id and the seed. Any engine with MD5 has the same order."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col("row_id").cast("string")))


def _positions(rows: DataFrame, seed: int, row_order: list[int] | None = None) -> tuple[DataFrame, int]:
    """Stored rows with ``pos``, and their number; by ``row_order`` (row ids in a given order, small data only) if given."""
    if row_order is not None:
        given = rows.sparkSession.createDataFrame([(int(r), k) for k, r in enumerate(row_order)], "row_id bigint, pos bigint")
        placed = cut(rows.join(given, "row_id"))
        return placed, placed.count()
    # The digest's bytes have the order of its text and take half the room.
    return numbered(rows.withColumn("__key", F.unhex(order_key(seed))), ["__key", "row_id"], "pos", drop=("__key",), store=packed)


def _check(train: float, validation: float, parts: int) -> None:
    if not 0 < train < 1 or not 0 <= validation < 1 or parts == 3 and train + validation >= 1:
        raise ValueError(f"ratios out of range: train {train}, validation {validation}")


def _moved(placed: DataFrame, train_rows: int) -> DataFrame:
    """``pos`` of the rows from ``train_rows`` on that are the first of their user or item. Both minima aggregate per key
    before anything moves; few of them lie so late."""
    firsts = [placed.groupBy(key).agg(F.min("pos").alias("pos")).filter(F.col("pos") >= train_rows).select("pos") for key in ("user_idx", "item_idx")]
    return cut(firsts[0].unionByName(firsts[1]).distinct())


def _with_moved(placed: DataFrame, moved: DataFrame, train_rows: int) -> tuple[DataFrame, Column]:
    """``placed`` with ``__moved`` (null if not), and whether a row is a training row."""
    joined = placed.join(broadcast_if_small(moved.select("pos", F.lit(True).alias("__moved"))), "pos", "left")
    return joined, (F.col("pos") < train_rows) | F.col("__moved").isNotNull()


def split_rows(rows: DataFrame, train: float = 0.8, validation: float = 0.1, seed: int = 42, row_order: list[int] | None = None) -> DataFrame:
    """``rows`` with ``split`` (train, validation, test). Sizes are int(n * ratio) before rows move to train; no rows
    give no rows."""
    _check(train, validation, 3)
    placed, n = _positions(rows, seed, row_order)
    first, wanted = int(n * train), int(n * validation)
    moved = _moved(placed, first)
    # The k-th moved row has pos - first - k rows before it that stay; validation ends after as many as are wanted.
    ranked = numbered(moved, ["pos"], "__k")[0]
    end = first + wanted + ranked.filter(F.col("pos") - first - F.col("__k") <= wanted).count()
    joined, trains = _with_moved(placed, moved, first)
    part = F.when(trains, "train").when(F.col("pos") < end, "validation").otherwise("test")
    return joined.withColumn("split", part).drop("pos", "__moved")


def split_rows_in_two(rows: DataFrame, validation: float, seed: int = 42, row_order: list[int] | None = None) -> DataFrame:
    """``rows`` with ``split`` (train, validation): the last int(n * ratio) rows of the order are validation, but for
    those that training needs. ValueError if either is empty."""
    _check(1 - validation, 0, 2)
    placed, n = _positions(rows, seed, row_order)
    first = n - int(n * validation)
    moved = _moved(placed, first)
    left = n - first - moved.count()
    if not left or left == n:
        raise ValueError("the split leaves no training or no validation rows")
    joined, trains = _with_moved(placed, moved, first)
    return joined.withColumn("split", F.when(trains, "train").otherwise("validation")).drop("pos", "__moved")


def fold_row_ids(interactions: DataFrame, folds: DataFrame) -> DataFrame:
    """``fold, part, row_id``: the rows that fold records name by user, item, rating and timestamp. ValueError if two
    interactions share these four; KeyError if a record has no interaction."""
    keys = ["raw_user_id", "raw_item_id", "rating", "timestamp"]
    ours = interactions.select(*keys[:2], F.col("rating").cast("double").alias("rating"), "timestamp", "row_id")
    if ours.groupBy(keys).count().filter("count > 1").limit(1).count():
        raise ValueError("duplicate interaction key")
    theirs = folds.select("fold", "part", *keys[:2], F.col("rating").cast("double").alias("rating"), "timestamp")
    if theirs.join(ours, keys, "left_anti").limit(1).count():
        raise KeyError("a fold record has no interaction")
    return theirs.join(ours, keys).select("fold", "part", "row_id")


def fold_split(data: Ratings, ids: DataFrame, fold: int) -> DataFrame:
    """The rows of one fold with ``split`` (train, test). ValueError for another fold than 1 to 5, or if the parts
    overlap or do not cover all rows."""
    if fold not in range(1, 6):
        raise ValueError(f"fold must be 1 to 5, not {fold}")
    of = ids.filter(F.col("fold") == fold).select("row_id", F.col("part").alias("split"))
    counts = of.agg(F.count("*"), F.countDistinct("row_id")).first()
    if counts[0] != counts[1]:
        raise ValueError("train and test rows overlap")
    if counts[1] != data.rows.count():
        raise ValueError("the fold does not cover all rows")
    return data.rows.join(of, "row_id")


def inner_fold_split(data: Ratings, ids: DataFrame, fold: int, validation: float, seed: int) -> DataFrame:
    """A fold whose training rows are split again into train and validation; its test rows stay."""
    outer = fold_split(data, ids, fold)
    inner = split_rows_in_two(outer.filter("split = 'train'").drop("split"), validation, seed)
    return inner.unionByName(outer.filter("split = 'test'").select(inner.columns))


def build_split(data: Ratings, family: str, *, train: float = 0.8, validation: float = 0.1, seed: int = 42, fold: int | None = None, fold_ids: DataFrame | None = None, inner_seed: int | None = None) -> DataFrame:
    """Dispatch by the name of a split family."""
    if family == "benchmark_random_v1":
        return split_rows(data.rows, train, validation, seed)
    if family not in FAMILIES:
        raise ValueError(f"unknown split family: {family}")
    if fold is None or fold_ids is None:
        raise ValueError("this split family needs a fold and the fold rows")
    if family == "paper_faithful_ml100k_v1":
        return fold_split(data, fold_ids, fold)
    if inner_seed is None:
        raise ValueError("this split family needs an inner seed")
    return inner_fold_split(data, fold_ids, fold, validation, inner_seed)


def time_split(rows: DataFrame, order: str, train: float = 0.8, validation: float = 0.1) -> DataFrame:
    """``rows`` with ``split`` by time: the earliest are train, the latest test; rows of one time by row id."""
    _check(train, validation, 3)
    placed, n = numbered(rows, [order, "row_id"], "__pos")
    part = F.when(F.col("__pos") < int(n * train), "train").when(F.col("__pos") < int(n * train) + int(n * validation), "validation").otherwise("test")
    return placed.withColumn("split", part).drop("__pos")


def split_id(family: str, seed: int | None = None, train: float = 0.8, validation: float = 0.1, fold: int | None = None, inner_seed: int | None = None) -> str:
    """The split's name, such as benchmark_random_v1_tr080_va010_s001."""
    percent = lambda x: int(round(x * 100))
    if family == "benchmark_random_v1":
        return f"{family}_tr{percent(train):03d}_va{percent(validation):03d}_s{seed:03d}"
    if family == "paper_faithful_ml100k_v1":
        return f"{family}_u{fold}"
    if family == "paper_faithful_ml100k_inner_v1":
        return f"{family}_u{fold}_va{percent(validation):03d}_s{inner_seed:03d}"
    raise ValueError(f"unknown split family: {family}")


def as_parts(split: DataFrame, data: Ratings) -> dict[str, Ratings]:
    """One view per part; they share the numbers of the whole data set."""
    from dataclasses import replace

    return {part: replace(data, rows=split.filter(F.col("split") == part).drop("split"), name=part) for part in ("train", "validation", "test")}


def split_sizes(split: DataFrame) -> DataFrame:
    """``split, rows, users, items, rating_min, rating_max`` of each part."""
    return split.groupBy("split").agg(F.count("*").alias("rows"), F.countDistinct("user_idx").alias("users"), F.countDistinct("item_idx").alias("items"), F.min(F.col("rating").cast("double")).alias("rating_min"), F.max(F.col("rating").cast("double")).alias("rating_max"))
