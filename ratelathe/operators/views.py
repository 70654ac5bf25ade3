"""A set of ratings with what must stay the same in each of its subsets."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratelathe.session import cut

COLUMNS = ["row_id", "user_idx", "item_idx", "rating"]


@dataclass(frozen=True)
class Ratings:
    """Lazy rows with ``row_id, user_idx, item_idx, rating``; the numbers of users and items and the range of ratings
    are those of the whole data set, also in a subset."""

    rows: DataFrame
    n_users: int
    n_items: int
    rating_min: float
    rating_max: float
    name: str = "all"

    def __post_init__(self) -> None:
        missing = [c for c in COLUMNS if c not in self.rows.columns]
        if missing:
            raise ValueError(f"ratings lack columns {missing}")
        if self.rating_min > self.rating_max:
            raise ValueError("rating_min is above rating_max")

    @staticmethod
    def of(rows: DataFrame, name: str = "all") -> Ratings:
        """Takes the numbers from one aggregation; ValueError for no rows."""
        rating = F.col("rating").cast("double")
        n, users, items, low, high = rows.agg(F.count("*"), F.max("user_idx"), F.max("item_idx"), F.min(rating), F.max(rating)).first()
        if not n:
            raise ValueError("no ratings")
        return Ratings(rows, users + 1, items + 1, low, high, name)

    def subset(self, ids: DataFrame, name: str) -> Ratings:
        """The rows whose ``row_id`` is in ``ids``; a semi-join, evaluated when needed."""
        return replace(self, rows=self.rows.join(ids.select("row_id"), "row_id", "left_semi"), name=name)

    def where(self, condition: str, name: str) -> Ratings:
        return replace(self, rows=self.rows.filter(condition), name=name)

    def materialize(self) -> Ratings:
        """The same rows, computed once and stored."""
        return replace(self, rows=cut(self.rows))

    def row_ids(self) -> DataFrame:
        return self.rows.select("row_id")

    def mean(self) -> float | None:
        return self.rows.agg(F.avg(F.col("rating").cast("double"))).first()[0]


def spread_sample(df: DataFrame, order: list[str], size: int = 10_000) -> DataFrame:
    """``df`` in full if it has at most ``size`` rows, else the rows at the distinct places floor(k (n - 1) / (size - 1)),
    k from 0, in the given order: a fixed sample spread evenly, for diagnostics."""
    from ratelathe.operators.dense_ids import dense_ids

    n = df.count()
    if n <= size:
        return df
    placed = dense_ids(df, order, "__at")
    # A place p is taken if some k has floor(k * step) = p, that is if ceil(p / step) * step < p + 1.
    step = F.lit((n - 1) / (size - 1))
    k = F.ceil(F.col("__at") / step)
    return placed.filter((F.floor(k * step) == F.col("__at")) | (F.floor((k - 1) * step) == F.col("__at"))).drop("__at")


def repeated_prefix(df: DataFrame, rows: int, times: int) -> DataFrame:
    """The first ``rows`` rows by user and row id, each ``times`` times (numbered by ``repeat``): a query load of a given size."""
    first = df.orderBy("user_idx", "row_id").limit(rows)
    return first.withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(times - 1))))
