"""Studies over several runs: tuning on validation rows, folds, seeds, and their aggregation."""

from __future__ import annotations

import json
import os
from dataclasses import asdict, replace
from datetime import datetime, timezone
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ratelathe.functions import metrics
from ratelathe.functions.scalars import candidate_file, merged
from ratelathe.models import config as cfg
from ratelathe.operators.views import Ratings
from ratelathe.plans import experiment, reporting, runtime
from ratelathe.plans.experiment import SplitPlan
from ratelathe.sources import artifacts, processed

#: Candidates that are fitted at once.
AT_ONCE = 4
RUN_SCHEMA = "unit string, seed int, fold int, validation_rmse double, test_rmse double, test_mae double, fit_seconds double, peak_mb double"


def _row(unit: str, plan: SplitPlan, seed: int, result: experiment.Result) -> tuple:
    m, took = result.metrics["metrics"], {s["name"]: s["wall_clock_seconds"] for s in result.metrics["profiling"]["stages"]}
    # A clustering-based model is not fitted without its clusters, so these count.
    fit_seconds = took["main_training"] + took.get("cluster_induction", 0.0)
    return (unit, seed, plan.fold, m["validation_rmse"], m["test_rmse"], m.get("test_mae"), fit_seconds, result.metrics["system_metrics"]["peak_memory_mb"])


def rank_candidates(rows: DataFrame, peak_limit_mb: float | None = None) -> DataFrame:
    """``rank, unit, candidate_index, mean_rmse, std_rmse, mean_seconds, peak_mb``: candidates by mean validation RMSE,
    its deviation, and seconds, then in their order. ``rows`` has ``unit, candidate_index`` and the columns of a run.
    Candidates above the memory limit are left out."""
    from pyspark.sql import Window

    g = rows.groupBy("unit", "candidate_index").agg(F.avg("validation_rmse").alias("mean_rmse"), F.coalesce(F.stddev_samp("validation_rmse"), F.lit(0.0)).alias("std_rmse"), F.avg("fit_seconds").alias("mean_seconds"), F.max("peak_mb").alias("peak_mb"))
    if peak_limit_mb is not None:
        g = g.filter(F.col("peak_mb") <= peak_limit_mb)
    # As many rows as there are candidates.
    return g.withColumn("rank", F.row_number().over(Window.orderBy("mean_rmse", "std_rmse", "mean_seconds", "candidate_index")))


def tune(spark: SparkSession, data: Ratings, base: dict, candidates: list[dict], plans: list[SplitPlan], *, seed: int = 1, out_dir: str | None = None, fold_ids: DataFrame | None = None, peak_limit_mb: float | None = None, at_once: int = AT_ONCE) -> DataFrame:
    """Fits every candidate (overrides of the base profile, with a name) on every split without looking at test rows,
    and ranks them. Several candidates are at work at once, whose jobs share the cluster. A candidate that exceeds the
    memory limit is given up at once; ValueError if none is left."""

    def fits(number: int, candidate: dict) -> list[tuple]:
        rows, profile = [], merged(base, candidate.get("overrides", {}))
        if out_dir:
            os.makedirs(out_dir, exist_ok=True)
            artifacts.write_yaml(os.path.join(out_dir, candidate_file(candidate["name"], number)), profile)
        for plan in plans:
            result = experiment.run(spark, data, profile, plan, seed=seed, fold_ids=fold_ids, evaluate_test=False)
            rows.append((number, *_row(candidate["name"], plan, seed, result)))
            if peak_limit_mb is not None and rows[-1][-1] > peak_limit_mb:
                break
        return rows

    with ThreadPool(at_once) as pool:
        # Jobs keep the settings of the thread that asked for them.
        rows = [row for found in pool.starmap(inheritable_thread_target(spark)(fits), enumerate(candidates)) for row in found]
    ranked = rank_candidates(spark.createDataFrame(rows, "candidate_index int, " + RUN_SCHEMA), peak_limit_mb)
    if ranked.limit(1).count() == 0:
        raise ValueError("no candidate stays within the memory limit")
    if out_dir:
        found = [r.asDict() for r in ranked.orderBy("rank").collect()]
        processed.write_json(os.path.join(out_dir, "tuning_summary.json"), {"best": found[0], "candidates": found})
        columns = ["rank", "unit", "mean_rmse", "std_rmse", "mean_seconds"]
        with open(os.path.join(out_dir, "tuning_summary.md"), "w", encoding="utf-8") as file:
            file.write(artifacts.render_markdown(columns, [[f"{r[c]:.6f}" if isinstance(r[c], float) else str(r[c]) for c in columns] for r in found]))
    return ranked


def _reused(runs: str | None, data: Ratings, profile: dict, plan: SplitPlan, seed: int) -> experiment.Result | None:
    """The latest completed run in ``runs`` of the same data set, model, split and seeds, made from the same commit. Only
    a clean repository is one that a run can be compared by; else, or if there is none, None."""
    state = runtime.git_state(runs) if runs and os.path.isdir(runs) else {}
    if not state.get("clean"):
        return None
    config = asdict(cfg.config_of(cfg.load_profile(profile), seed))
    config = json.loads(json.dumps(config | {"penalties": dict(config["penalties"])}))
    for name in sorted(os.listdir(runs), reverse=True):
        folder = os.path.join(runs, name)
        if not os.path.isfile(os.path.join(folder, "metrics.json")):
            continue
        m = processed.read_json(os.path.join(folder, "run_manifest.json"))
        same = m["dataset"]["short_name"] == data.name and m["model"]["config"] == config and m["split"]["id"] == plan.id()
        if same and m["status"] == "completed" and m["git"].get("clean") and m["git"]["commit"] == state["commit"]:
            return experiment.Result(folder, processed.read_json(os.path.join(folder, "metrics.json")), m, None)
    return None


def repeated(spark: SparkSession, data: Ratings, profile: dict, plans: list[SplitPlan], seeds: list[int], **options: object) -> DataFrame:
    """A row per plan and seed of full runs; with ``out_dir`` among the options, matching runs there are taken over."""
    rows = []
    for seed in seeds:
        for plan in plans:
            found = _reused(options.get("out_dir"), data, profile, plan, seed)
            rows.append(_row(plan.id(), plan, seed, found or experiment.run(spark, data, profile, plan, seed=seed, **options)))
    return spark.createDataFrame(rows, RUN_SCHEMA)


def folds(spark: SparkSession, data: Ratings, profile: dict, fold_ids: DataFrame, seeds: list[int], **options: object) -> DataFrame:
    """A row per fold and seed."""
    plans = [SplitPlan("paper_faithful_ml100k_v1", fold=k) for k in range(1, 6)]
    return repeated(spark, data, profile, plans, seeds, fold_ids=fold_ids, **options)


def random_splits(spark: SparkSession, data: Ratings, profile: dict, split_seeds: list[int], plan: SplitPlan = SplitPlan(), **options: object) -> DataFrame:
    """A row per split seed, the model's seed being the same as the split's; matching runs are taken over as in ``repeated``."""
    rows = []
    for s in split_seeds:
        p = replace(plan, seed=s)
        found = _reused(options.get("out_dir"), data, profile, p, s)
        rows.append(_row(p.id(), p, s, found or experiment.run(spark, data, profile, p, seed=s, **options)))
    return spark.createDataFrame(rows, RUN_SCHEMA)


def stored_runs(spark: SparkSession, runs: str, dataset: str, profile: dict, plans: list[SplitPlan], seeds: list[int], repository: str | None = None) -> DataFrame:
    """The rows of ``repeated`` from runs that are stored, one for each plan and its seed. LookupError if a run is
    missing or there are several; ValueError unless all are from the clean commit that the repository is at and have
    the configuration of the profile."""
    config = cfg.config_of(cfg.load_profile(profile), 0)
    found = reporting.stored(spark, runs).filter("status = 'completed'")
    rows, commits = [], set()
    for plan, seed in zip(plans, seeds):
        run = reporting.find_run(found, dataset=dataset, model=config.model, split=plan.id(), seed=seed)
        manifest, result = json.loads(run["m"]), json.loads(run["s"])
        wanted = json.loads(json.dumps(asdict(replace(config, seed=seed)) | {"penalties": dict(config.penalties)}))
        if manifest["model"]["config"] != wanted:
            raise ValueError(f"{run['run_dir']} has another configuration")
        if not manifest["git"].get("clean"):
            raise ValueError(f"{run['run_dir']} is not from a clean commit")
        commits.add(manifest["git"]["commit"])
        rows.append(_row(plan.id(), plan, seed, experiment.Result(run["run_dir"], result, manifest, None)))
    if len(commits) > 1:
        raise ValueError(f"the runs are from several commits: {sorted(commits)}")
    state = runtime.git_state(repository or runs)
    if commits != {state["commit"]} or not state["clean"]:
        raise ValueError("the runs are not from the commit that the repository is at")
    return spark.createDataFrame(rows, RUN_SCHEMA)


def by_seed(rows: DataFrame, value: str = "test_rmse") -> DataFrame:
    """One row: the summary over seeds of each seed's mean over folds."""
    return metrics.sample_summary(rows.groupBy("seed").agg(F.avg(value).alias(value)), value)


def by_run(rows: DataFrame, value: str = "test_rmse") -> DataFrame:
    """One row: the summary over all runs."""
    return metrics.sample_summary(rows, value)


def write_benchmark(out_dir: str, name: str, rows: DataFrame, values: tuple[str, ...] = ("validation_rmse", "test_rmse", "test_mae", "fit_seconds", "peak_mb")) -> str:
    """A benchmark manifest with the runs and their summaries."""
    folder = artifacts.reserve_folder(out_dir, name)
    summary = {}
    for v in values:
        levels = {"run": by_run(rows, v).first(), "seed": by_seed(rows, v).first()}
        summary[v] = {level: r.asDict() if r else None for level, r in levels.items()}
    payload = {"manifest_version": "v1", "kind": "benchmark_manifest", "benchmark_id": os.path.basename(folder), "status": "completed", "generated_at_utc": datetime.now(timezone.utc).isoformat(), "name": name, "runs": [r.asDict() for r in rows.collect()], "summary": summary, "git": runtime.git_state(out_dir)}
    processed.write_json(os.path.join(folder, "benchmark_manifest.json"), payload)
    return folder
