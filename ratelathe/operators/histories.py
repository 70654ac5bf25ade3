"""Per-user derived indices of training rows: history, explicit feedback, and counts of item clusters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ratelathe.operators.views import Ratings


def norm(count: Column) -> Column:
    """1 / sqrt(count); 0 where the count is 0."""
    return F.when(count > 0, 1.0 / F.sqrt(count.cast("double"))).otherwise(0.0)


def _all_users(grouped: DataFrame, n_users: int, empty: dict[str, Column]) -> DataFrame:
    users = grouped.sparkSession.range(n_users).select(F.col("id").cast("int").alias("user_idx"))
    joined = users.join(grouped, "user_idx", "left")
    return joined.withColumns({c: F.coalesce(c, e) for c, e in empty.items()}).withColumn("norm", norm(F.col("cnt")))


def _some(data: Ratings) -> DataFrame:
    if data.rows.limit(1).count() == 0:
        raise ValueError("no ratings to build an index from")
    return data.rows


def history(data: Ratings) -> DataFrame:
    """``user_idx, items, cnt, norm``: each user's distinct items in ascending order; users without any have an empty
    list. An item list is bounded by the catalogue. ValueError for no rows."""
    pairs = _some(data).select("user_idx", "item_idx").distinct()
    grouped = pairs.groupBy("user_idx").agg(F.sort_array(F.collect_list("item_idx")).alias("items"), F.count("*").alias("cnt"))
    return _all_users(grouped, data.n_users, {"items": F.expr("cast(array() as array<int>)"), "cnt": F.lit(0).cast("long")})


def explicit_feedback(data: Ratings) -> DataFrame:
    """``user_idx, feedback, cnt, norm``: as the history, with the rating of each user and item; the one of the least
    ``row_id`` if there are several."""
    pairs = _some(data).groupBy("user_idx", "item_idx").agg(F.min_by(F.col("rating").cast("double"), "row_id").alias("rating"))
    entry = F.struct("item_idx", "rating")
    grouped = pairs.groupBy("user_idx").agg(F.sort_array(F.collect_list(entry)).alias("feedback"), F.count("*").alias("cnt"))
    return _all_users(grouped, data.n_users, {"feedback": F.expr("cast(array() as array<struct<item_idx:int,rating:double>>)"), "cnt": F.lit(0).cast("long")})


def cluster_counts(histories: DataFrame, item_clusters: DataFrame) -> DataFrame:
    """``user_idx, cluster_id, cnt``: how many items of each user's history are in each cluster; only counts above 0.
    ``item_clusters`` has ``item_idx, cluster_id``."""
    pairs = histories.select("user_idx", F.explode("items").alias("item_idx"))
    return pairs.join(item_clusters, "item_idx").groupBy("user_idx", "cluster_id").agg(F.count("*").alias("cnt"))


def cluster_lists(counts: DataFrame) -> DataFrame:
    """``user_idx, clusters``: the counts as lists of (cluster_id, cnt) by ascending cluster."""
    return counts.groupBy("user_idx").agg(F.sort_array(F.collect_list(F.struct("cluster_id", "cnt"))).alias("clusters"))


def gather(histories: DataFrame, factors: DataFrame) -> DataFrame:
    """``user_idx, total``: the sum over each user's history of the items' vectors (``item_idx, f`` array of double)."""
    pairs = histories.select("user_idx", F.explode("items").alias("item_idx")).join(factors, "item_idx")
    parts = pairs.select("user_idx", F.posexplode("f").alias("at", "v")).groupBy("user_idx", "at").agg(F.sum("v").alias("v"))
    return parts.groupBy("user_idx").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "v"))), lambda x: x["v"]).alias("total"))


def validate_index(index: DataFrame, n_users: int, items: str = "items") -> None:
    """ValueError unless the index has one row for each user 0 ... n_users - 1 whose count is its list's length."""
    size = F.size(items)
    s = index.agg(F.count("*"), F.countDistinct("user_idx"), F.min("user_idx"), F.max("user_idx"), F.count_if(size != F.col("cnt"))).first()
    if s[0] != n_users or s[1] != n_users or n_users and (s[2] != 0 or s[3] != n_users - 1):
        raise ValueError(f"the index has {s[0]} rows for {n_users} users")
    if s[4]:
        raise ValueError("counts and lists of the index differ in length")


def history_summary(histories: DataFrame) -> DataFrame:
    """One row: ``users_with_history, mean_size`` (over all users), ``max_size``."""
    return histories.agg(F.count_if(F.col("cnt") > 0).alias("users_with_history"), F.avg("cnt").alias("mean_size"), F.max("cnt").alias("max_size"))


def active_clusters(counts: DataFrame, n_users: int) -> DataFrame:
    """One row: ``mean_active, max_active`` clusters of a user, users without a history counting 0."""
    per_user = counts.groupBy("user_idx").agg(F.count("*").alias("n"))
    return per_user.agg((F.coalesce(F.sum("n"), F.lit(0)) / n_users).alias("mean_active"), F.coalesce(F.max("n"), F.lit(0)).alias("max_active"))
