"""Timing harnesses: loading processed data, reusing derived tables, scoring with and without stored contexts."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ratelathe.functions import metrics
from ratelathe.models import fit, scoring
from ratelathe.models.config import Config
from ratelathe.operators import interactions as ops
from ratelathe.operators.views import Ratings, repeated_prefix
from ratelathe.plans.runtime import measurement
from ratelathe.session import cut
from ratelathe.sources import processed


def timed(spark: SparkSession, scenarios: dict[str, Callable[[], object]], repeats: int = 3, warmups: int = 1) -> DataFrame:
    """``scenario, count, mean, std, median, min, max, cv`` of the seconds that each scenario takes."""
    measurement(repeats, warmups, "discard" if warmups else "none")
    rows = []
    for name, job in scenarios.items():
        for number in range(warmups + repeats):
            began = time.perf_counter()
            job()
            if number >= warmups:
                rows.append((name, time.perf_counter() - began))
    return metrics.sample_summary(spark.createDataFrame(rows, "scenario string, seconds double"), "seconds", ["scenario"])


def loading(spark: SparkSession, manifest: str, repeats: int = 3) -> DataFrame:
    return timed(spark, {"construct_only": lambda: processed.load_ratings(spark, manifest), "full_scan_checksum": lambda: ops.checksum(processed.load_ratings(spark, manifest).rows).first()}, repeats)


def index_reuse(data: Ratings, config: Config, clusters=None, repeats: int = 1) -> DataFrame:  # noqa: ANN001
    """Fitting with derived tables that are at hand against building them anew."""
    ready = fit.build_indices(data, config, fit.Indices(clusters=clusters))
    spark = data.rows.sparkSession
    return timed(spark, {"precomputed": lambda: fit.fit(data, config, ready), "recomputed": lambda: fit.fit(data, config, fit.Indices(clusters=clusters))}, repeats, 0)


def context_reuse(model: fit.Model, rows: DataFrame, size: int, times: int, repeats: int = 2) -> tuple[DataFrame, float, float]:
    """Scoring the same queries with contexts of all users stored before, and with those of the asked users made on the
    way: the timings, the largest difference of predictions, and the ratio of the mean times."""
    queries = cut(repeated_prefix(rows, size, times).select("row_id", "repeat", "user_idx", "item_idx"))
    ready, asked = cut(scoring.contexts(model)), queries.select("user_idx").distinct()
    full = lambda: scoring.predict(model, queries, True, ready)
    unique = lambda: scoring.predict(model, queries, True, scoring.contexts(model, asked))
    keys = ["row_id", "repeat"]
    gap = full().select(*keys, F.col("prediction").alias("a")).join(unique().select(*keys, F.col("prediction").alias("b")), keys).agg(F.max(F.abs(F.col("a") - F.col("b")))).first()[0]
    spark = rows.sparkSession
    sums = timed(spark, {"full_context": lambda: full().agg(F.sum("prediction")).first(), "unique_context": lambda: unique().agg(F.sum("prediction")).first()}, repeats)
    mean = {r["scenario"]: r["mean"] for r in sums.collect()}
    return sums, gap or 0.0, mean["unique_context"] / mean["full_context"]
