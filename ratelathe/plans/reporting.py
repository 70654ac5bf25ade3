"""Tables of results collected from run folders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ratelathe.functions import scalars as x
from ratelathe.sources import artifacts

#: The columns of a result table, and the order of data sets and models in it.
COLUMNS = ["dataset", "model", "validation_rmse", "test_rmse", "validation_mae", "test_mae", "abs_error_p90", "prediction_out_of_range_rate", "train_time", "peak_memory", "alpha", "cb_claim_eligible", "diagnostic_claim_ready", "status"]
DATASETS = ["ml100k", "ml1m", "ml10m", "ml20m"]
MODELS = ["biased_mf", "svdpp", "asymmetric_svd", "asvdpp", "cb_svdpp", "cb_asvdpp"]
LAST = 999
STAGES = "array<struct<name:string,wall_clock_seconds:string,rss_end_mb:string>>"


def _rank(value: Column, order: list[str]) -> Column:
    known = F.array_position(F.array(*map(F.lit, order)), value)
    return F.when(known > 0, known - 1).otherwise(LAST)


def _stages(document: Column) -> Column:
    return F.from_json(x.json_at(document, "profiling.stages"), STAGES)


def result_rows(spark: SparkSession, runs: str) -> DataFrame:
    """A row per run folder with a manifest; values that the metrics or the manifest lack are null."""
    manifests = artifacts.scan_documents(spark, runs, "run_manifest.json").withColumnRenamed("document", "m")
    metrics = artifacts.scan_documents(spark, runs, "metrics.json").withColumnRenamed("document", "s")
    df = manifests.join(metrics, "run_dir", "left")
    m, s = F.col("m"), F.col("s")
    number = lambda doc, path: x.lenient_number(x.json_at(doc, path))
    metric = lambda split, name: x.lenient_number(x.split_metric(s, split, name))
    stages = _stages(s)
    main = F.filter(stages, lambda t: t["name"] == "main_training")
    most = lambda doc: F.array_max(F.transform(_stages(doc), lambda t: x.lenient_number(t["rss_end_mb"])))
    train = x.first_nonzero(number(s, "system_metrics.train_time_total"), number(s, "timing.training_wall_clock_seconds"), number(m, "timing.training_wall_clock_seconds"), x.lenient_number(F.get(main, F.lit(0))["wall_clock_seconds"]), number(s, "profiling.total_profiled_wall_clock_seconds"))
    peak = x.first_nonzero(number(s, "system_metrics.peak_memory_mb"), most(s), most(m))
    status = F.coalesce(x.empty_to_null(x.json_at(m, "status")), F.lit("unknown"))
    has_metrics = s.isNotNull()
    text = lambda path: F.coalesce(x.empty_to_null(x.json_at(m, path)), x.json_at(s, path), F.lit(""))
    return df.select(
        text("dataset.short_name").alias("dataset"),
        text("model.name").alias("model"),
        metric("validation", "rmse").alias("validation_rmse"),
        metric("test", "rmse").alias("test_rmse"),
        metric("validation", "mae").alias("validation_mae"),
        metric("test", "mae").alias("test_mae"),
        x.lenient_number(x.preferred_metric(s, "abs_error_p90")).alias("abs_error_p90"),
        x.lenient_number(x.preferred_metric(s, "prediction_out_of_range_rate")).alias("prediction_out_of_range_rate"),
        F.when(has_metrics, train).alias("train_time"),
        F.when(has_metrics, peak).alias("peak_memory"),
        x.first_nonzero(number(s, "cb_diagnostics.alpha"), number(s, "cb_semantics.alpha"), number(m, "cb_semantics.alpha")).alias("alpha"),
        x.lenient_bool(F.coalesce(x.json_at(s, "cb_diagnostics.cb_claim_eligible"), x.json_at(s, "cb_semantics.cb_claim_eligible"), x.json_at(m, "cb_semantics.cb_claim_eligible"))).alias("cb_claim_eligible"),
        x.lenient_bool(x.json_at(s, "cb_diagnostics.diagnostic_claim_ready")).alias("diagnostic_claim_ready"),
        F.when(has_metrics, status).otherwise(F.concat(status, F.lit("_missing_metrics"))).alias("status"),
        F.coalesce(x.empty_to_null(x.json_at(m, "run_id")), "run_dir").alias("run_id"),
        F.coalesce(x.empty_to_null(x.json_at(m, "generated_at_utc")), "run_dir").alias("generated_at_utc"),
    )


def latest(rows: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """The last row of each group in the given order."""
    w = Window.partitionBy(*by).orderBy(*[F.desc(c) for c in order])
    return rows.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def result_table(spark: SparkSession, runs: str, datasets: list[str] | None = None, all_runs: bool = False) -> DataFrame:
    """Result rows, the latest of each data set and model unless ``all_runs``, in the order of a report."""
    rows = result_rows(spark, runs)
    if datasets is not None:
        rows = rows.filter(F.col("dataset").isin(datasets))
    if not all_runs:
        rows = latest(rows, ["dataset", "model"], ["generated_at_utc", "run_id"])
    return report_order(rows)


def report_order(rows: DataFrame) -> DataFrame:
    return rows.orderBy(_rank(F.col("dataset"), DATASETS), "dataset", _rank(F.col("model"), MODELS), "model", "generated_at_utc")


def render(table: DataFrame, form: str = "markdown") -> str:
    """Markdown with formatted cells, or CSV with plain values. A report is small: a row per data set and model."""
    if form == "csv":
        return artifacts.render_csv(COLUMNS, [list(r) for r in table.select(COLUMNS).collect()])
    if form != "markdown":
        raise ValueError(f"unknown format: {form}")
    kinds = dict(table.dtypes)
    cells = table.select(*[x.cell(F.col(c), kinds[c]).alias(c) for c in COLUMNS])
    return artifacts.render_markdown(COLUMNS, [list(r) for r in cells.collect()])


def stage_totals(spark: SparkSession, runs: str) -> DataFrame:
    """``run_dir, total_seconds, peak_rss_mb`` over each run's recorded stages."""
    s = artifacts.scan_documents(spark, runs, "metrics.json").select("run_dir", F.explode(_stages(F.col("document"))).alias("t"))
    return s.groupBy("run_dir").agg(F.sum(x.lenient_number(F.col("t.wall_clock_seconds"))).alias("total_seconds"), F.max(x.lenient_number(F.col("t.rss_end_mb"))).alias("peak_rss_mb"))


def stored(spark: SparkSession, runs: str) -> DataFrame:
    """``run_dir, dataset, model, split, seed, status`` and the documents ``m`` (manifest) and ``s`` (metrics) of runs with both."""
    manifests = artifacts.scan_documents(spark, runs, "run_manifest.json").withColumnRenamed("document", "m")
    both = manifests.join(artifacts.scan_documents(spark, runs, "metrics.json").withColumnRenamed("document", "s"), "run_dir")
    at = lambda path: x.json_at(F.col("m"), path)
    return both.select("run_dir", at("dataset.short_name").alias("dataset"), at("model.name").alias("model"), at("split.id").alias("split"), at("model.seed").cast("int").alias("seed"), at("status").alias("status"), "m", "s")


def find_run(rows: DataFrame, **wanted: object) -> dict:
    """The only row with these values; LookupError if there is none or more than one."""
    for column, value in wanted.items():
        rows = rows.filter(F.col(column).eqNullSafe(F.lit(value)))
    found = rows.limit(2).collect()
    if len(found) != 1:
        raise LookupError(f"{'no run has' if not found else 'several runs have'} {wanted}")
    return found[0].asDict()
