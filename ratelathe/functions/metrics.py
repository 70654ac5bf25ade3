"""Error statistics of predictions and summaries of repeated measurements, each as one aggregation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratelathe.operators import skew
from ratelathe.session import packed

#: The statistics, and the percentiles among them.
FIELDS = ["rmse", "mae", "residual_mean", "residual_std", "abs_error_p50", "abs_error_p90", "abs_error_p95", "abs_error_max", "prediction_mean", "prediction_std", "prediction_min", "prediction_max", "below_range_rate", "above_range_rate", "out_of_range_rate"]
PERCENTS = {0.5: "abs_error_p50", 0.9: "abs_error_p90", 0.95: "abs_error_p95"}


def rating_errors(df: DataFrame, truth: str, prediction: str, low: float | None = None, high: float | None = None, by: list[str] | None = None, exact: bool = True) -> DataFrame:
    """The fifteen error statistics of each group. A residual is prediction less truth; deviations are those of the
    population; percentiles are exact and interpolated, from weighted errors sorted over ranges (``skew``), so that no
    task holds the errors of a group; or within 0.1 % of rank in one pass if not ``exact``. ``low`` and ``high`` default to the least and most truth. Rows that lack the truth or
    the prediction are left out. Without groups, no rows give one row of nulls."""
    if low is not None and high is not None and low > high:
        raise ValueError("low is above high")
    rows = df.select(*(by or []), F.col(truth).cast("double").alias("__t"), F.col(prediction).cast("double").alias("__p")).dropna(subset=["__t", "__p"])
    e = F.col("__p") - F.col("__t")
    size, p = F.abs(e), F.col("__p")
    if low is None or high is None:
        ends = rows.agg(F.min("__t"), F.max("__t")).first()
        low, high = ends[0] if low is None else low, ends[1] if high is None else high
    under, over = F.coalesce(p < F.lit(low), F.lit(False)), F.coalesce(p > F.lit(high), F.lit(False))
    share = lambda x: F.avg(x.cast("int"))
    ranks = [F.lit(None).cast("double")] * 3 if exact else [F.percentile_approx(size, q, 1000) for q in PERCENTS]
    values = [F.sqrt(F.avg(e * e)), F.avg(size), F.avg(e), F.stddev_pop(e), *ranks, F.max(size), F.avg(p), F.stddev_pop(p), F.min(p), F.max(p), share(under), share(over), share(under | over)]
    found = rows.groupBy(*(by or [])).agg(*[v.alias(n) for v, n in zip(values, FIELDS)])
    if not exact:
        return found
    # A group is named by its values as text, nulls included; without groups there is one.
    group = F.to_json(F.struct(*by), {"ignoreNullFields": "false"}) if by else F.lit("all")
    errors = rows.select(group.alias("__group"), size.alias("__size"))
    ranks = skew.key_percentiles(skew.weigh(errors, "__group", "__size"), list(PERCENTS), packed).groupBy(F.col("key").alias("__group"))
    wide = ranks.agg(*[F.max(F.when(F.col("percent") == q, F.col("percentile"))).alias(f"__{name}") for q, name in PERCENTS.items()])
    joined = found.withColumn("__group", group).join(wide, "__group", "left")
    return joined.select(*(by or []), *[F.col(f"__{n}").alias(n) if n in PERCENTS.values() else n for n in FIELDS])


def per_split(df: DataFrame, truth: str, prediction: str, low: float, high: float) -> dict:
    """A flat and nested record of the statistics of each split: ``train_rmse``, ... and ``train: {rmse, ...}``; an absent split is None."""
    found = {r["split"]: {f: r[f] for f in FIELDS} for r in rating_errors(df, truth, prediction, low, high, ["split"]).collect()}
    record: dict = {}
    for split in ("train", "validation", "test"):
        record[split] = found.get(split)
        record |= {f"{split}_{f}": v for f, v in found[split].items()} if split in found else {f"{split}_rmse": None}
    return record


def sample_summary(df: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """``count, mean, std, median, min, max, cv`` of each group's non-null values: the sample's deviation (0 for one
    value) and its ratio to the mean (0 for a mean of 0)."""
    x = F.col(value).cast("double")
    std = F.coalesce(F.stddev_samp(x), F.lit(0.0))
    found = df.filter(x.isNotNull()).groupBy(*(by or [])).agg(F.count(x).alias("count"), F.avg(x).alias("mean"), std.alias("std"), F.median(x).alias("median"), F.min(x).alias("min"), F.max(x).alias("max"))
    return found.filter("count > 0").withColumn("cv", F.when(F.col("mean") == 0, 0.0).otherwise(F.abs(F.col("std") / F.col("mean"))))
