"""Clusters of users and items found in training rows, and the ratings between them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratelathe.operators.views import Ratings


@dataclass(frozen=True)
class Clusters:
    """``users`` and ``items`` (``*_idx, cluster_id``), ``r_star`` (``user_cluster, item_cluster, mean, cnt``, dense),
    and how they were found."""

    users: DataFrame
    items: DataFrame
    r_star: DataFrame
    n_user_clusters: int
    n_item_clusters: int
    train_rmse: float | None = None
    user_inertia: float | None = None
    item_inertia: float | None = None


def check_request(n_users: int, n_items: int, n_user_clusters: int, n_item_clusters: int, algorithm: str = "kmeans", restarts: int = 1) -> None:
    if n_user_clusters <= 0 or n_item_clusters <= 0 or n_user_clusters > n_users or n_item_clusters > n_items:
        raise ValueError("cluster numbers must be above 0 and no more than the users or items")
    if algorithm != "kmeans" or restarts <= 0:
        raise ValueError("the algorithm must be kmeans with at least one start")


def kmeans(vectors: DataFrame, key: str, k: int, seed: int, restarts: int = 1) -> tuple[DataFrame, float]:
    """``key, cluster_id`` of vectors ``f``, and the inertia; the best of several seeded starts."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    points = vectors.select(key, array_to_vector(F.col("f")).alias("features"))
    best, cost = None, float("inf")
    for start in range(restarts):
        model = KMeans(k=k, seed=seed + start, initMode="k-means||", maxIter=50, tol=1e-6).fit(points)
        if model.summary.trainingCost < cost:
            best, cost = model, model.summary.trainingCost
    return best.transform(points).select(key, F.col("prediction").alias("cluster_id")), cost


def rating_grid(data: Ratings, users: DataFrame, items: DataFrame, n_user_clusters: int, n_item_clusters: int) -> DataFrame:
    """``user_cluster, item_cluster, mean, cnt`` for every pair of clusters; mean 0 where there is no rating. The grid's
    size is the product of two parameters."""
    joined = data.rows.join(users.withColumnRenamed("cluster_id", "user_cluster"), "user_idx").join(items.withColumnRenamed("cluster_id", "item_cluster"), "item_idx")
    found = joined.groupBy("user_cluster", "item_cluster").agg(F.avg(F.col("rating").cast("double")).alias("mean"), F.count("*").alias("cnt"))
    cells = data.rows.sparkSession.range(n_user_clusters * n_item_clusters).select((F.col("id") / n_item_clusters).cast("int").alias("user_cluster"), (F.col("id") % n_item_clusters).cast("int").alias("item_cluster"))
    return cells.join(found, ["user_cluster", "item_cluster"], "left").na.fill({"mean": 0.0, "cnt": 0})


def sizes(assigned: DataFrame, k: int) -> DataFrame:
    """``cluster_id, size`` of each cluster 0 ... k - 1, empty ones included."""
    every = assigned.sparkSession.range(k).select(F.col("id").cast("int").alias("cluster_id"))
    return every.join(assigned.groupBy("cluster_id").agg(F.count("*").alias("size")), "cluster_id", "left").na.fill({"size": 0})


def size_summary(cluster_sizes: DataFrame) -> DataFrame:
    """One row: ``least, most, mean, empty, at_most_one, non_empty, coverage`` (share of non-empty clusters)."""
    size = F.col("size")
    return cluster_sizes.agg(F.min(size).alias("least"), F.max(size).alias("most"), F.avg(size).alias("mean"), F.count_if(size == 0).alias("empty"), F.count_if(size <= 1).alias("at_most_one"), F.count_if(size > 0).alias("non_empty"), F.avg((size > 0).cast("int")).alias("coverage"))


def grid_summary(r_star: DataFrame) -> DataFrame:
    """One row: ``filled_pairs, pairs, density, least_mean, most_mean`` (of the filled pairs)."""
    some = F.col("cnt") > 0
    return r_star.agg(F.count_if(some).alias("filled_pairs"), F.count("*").alias("pairs"), F.avg(some.cast("int")).alias("density"), F.min(F.when(some, F.col("mean"))).alias("least_mean"), F.max(F.when(some, F.col("mean"))).alias("most_mean"))


def induce(data: Ratings, config, n_user_clusters: int, n_item_clusters: int, algorithm: str = "kmeans", restarts: int = 1) -> Clusters:  # noqa: ANN001
    """Clusters from training rows only: a biased factorization is fitted, then the user and the item factors are
    clustered separately. ``config`` is the factorization's."""
    from ratelathe.functions import metrics
    from ratelathe.models import fit, scoring

    check_request(data.n_users, data.n_items, n_user_clusters, n_item_clusters, algorithm, restarts)
    model = fit.fit(data, config)
    users, user_cost = kmeans(model.table("p", "user_idx"), "user_idx", n_user_clusters, config.seed, restarts)
    items, item_cost = kmeans(model.table("q", "item_idx"), "item_idx", n_item_clusters, config.seed, restarts)
    # Only the one figure is computed: no range of ratings is looked up and no errors are sorted.
    rmse = metrics.rating_errors(scoring.predict(model, data.rows), "rating", "prediction", data.rating_min, data.rating_max, exact=False).select("rmse").first()["rmse"]
    scoring.forget(model)
    return Clusters(users, items, rating_grid(data, users, items, n_user_clusters, n_item_clusters), n_user_clusters, n_item_clusters, rmse, user_cost, item_cost)
