import json
import os
import shutil

import pytest
from pyspark.sql import functions as F

from ratelathe import cli
from ratelathe.models import config as cfg
from ratelathe.models import fit
from ratelathe.operators.views import Ratings
from ratelathe.plans import cache, experiment, manifests, reporting, runtime, studies, timings
from ratelathe.plans.experiment import SplitPlan
from ratelathe.sources import artifacts, processed
from ratelathe.streaming import scoring as streams
from tests.test_models import profile

GRID = [5, 4.5, 4, 3.5, 4.5, 4, 3.5, 3, 2.5, 3, 4, 4.5, 1, 1.5, 2, 2.5]
PLAN = SplitPlan(train=0.5, validation=0.25, seed=3)


@pytest.fixture(scope="module")
def data(spark):
    rows = [(k, k // 4, k % 4, float(r)) for k, r in enumerate(GRID)]
    return Ratings.of(spark.createDataFrame(rows, "row_id bigint, user_idx int, item_idx int, rating double"), "toy")


@pytest.mark.parametrize("name", cfg.PARTS)
def test_every_model_runs(spark, data, name, tmp_path):
    result = experiment.run(spark, data, profile(name, latent_dim=2, epochs=1), PLAN, out_dir=str(tmp_path), cache_policy="on", cache_dir=str(tmp_path / "cache"))
    m = result.metrics["metrics"]
    assert all(m[f"{s}_{f}"] is not None for s in ("train", "validation", "test") for f in ("rmse", "mae", "residual_std", "abs_error_p95", "out_of_range_rate"))
    assert m["train"]["out_of_range_rate"] == 0.0
    assert set(result.metrics["caches"].values()) == {"miss"}
    assert manifests.validate_file(os.path.join(result.folder, "run_manifest.json")) == "run_manifest"
    assert processed.read_json(os.path.join(result.folder, "run_manifest.json"))["status"] == "completed"
    diagnostics = result.metrics["cb_diagnostics"]
    assert (diagnostics is None) == ("cb" not in name)
    if diagnostics:
        assert diagnostics["cb_claim_eligible"] is False and diagnostics["clustering"]["r_star"]["pairs"] == 4
        assert diagnostics["missing_expected_artifacts"] == [] == diagnostics["missing_expected_model_fields"] and diagnostics["diagnostic_warnings"] == []
        again = experiment.run(spark, data, profile(name, latent_dim=2, epochs=1), PLAN, cache_policy="on", cache_dir=str(tmp_path / "cache"))
        assert set(again.metrics["caches"].values()) == {"hit"}
        assert again.metrics["metrics"]["test_rmse"] == pytest.approx(m["test_rmse"])


def test_a_failed_run_says_so(spark, data, tmp_path):
    with pytest.raises(ValueError):
        experiment.run(spark, data, profile("biased_mf"), SplitPlan("other"), out_dir=str(tmp_path))
    with pytest.raises(ValueError):
        experiment.run(spark, data, profile("biased_mf"), SplitPlan("paper_faithful_ml100k_v1", fold=1), out_dir=str(tmp_path))
    run = [d for d in os.listdir(tmp_path)]
    assert processed.read_json(str(tmp_path / run[0] / "run_manifest.json"))["status"] == "failed"


def test_dry_run():
    found = experiment.dry_run(profile("cb_svdpp"), PLAN, "toy")
    assert found["split_id"] == "benchmark_random_v1_tr050_va025_s003" and "cluster_artifacts" in found["steps"]


def test_cache(spark, tmp_path):
    made = []
    make = lambda: made.append(1) or {"t": spark.range(3)}
    for policy, state in (("auto", "disabled"), ("on", "miss"), ("on", "hit"), ("off", "disabled")):
        tables, found = cache.cached(spark, str(tmp_path), "k", {"a": 1}, make, policy)
        assert found == state and tables["t"].count() == 3
    assert len(made) == 3
    folder = tmp_path / "k" / cache.identity_key({"a": 1})
    with open(folder / "identity.json", "w") as file:
        file.write("broken")
    assert cache.cached(spark, str(tmp_path), "k", {"a": 1}, make, "on")[1] == "miss"
    assert len(cache.identity_key({"b": 2, "a": 1})) == 16 and cache.identity_key({"b": 2, "a": 1}) == cache.identity_key({"a": 1, "b": 2})
    with pytest.raises(ValueError):
        cache.check_applicable("on", False, "clusters")
    with pytest.raises(ValueError):
        cache.enabled("maybe")


def document(folder, name, manifest, metrics=None):
    os.makedirs(folder / name)
    processed.write_json(str(folder / name / "run_manifest.json"), manifest)
    if metrics is not None:
        processed.write_json(str(folder / name / "metrics.json"), metrics)


def test_result_table(spark, tmp_path):
    m = lambda d, n, t, **more: {"kind": "run_manifest", "run_id": f"{d}-{n}-{t}", "status": "completed", "generated_at_utc": t, "dataset": {"short_name": d}, "model": {"name": n}} | more
    document(tmp_path, "a", m("ml1m", "svdpp", "2026-01"), {"metrics": {"test": {"rmse": 0.9}, "validation_rmse": "0.8"}, "system_metrics": {"train_time_total": 0.0}, "timing": {"training_wall_clock_seconds": 7}})
    document(tmp_path, "b", m("ml1m", "svdpp", "2026-02"), {"metrics": {"test": {"rmse": 0.7, "abs_error_p90": True}}, "profiling": {"stages": [{"name": "main_training", "wall_clock_seconds": 3, "rss_end_mb": 50}, {"name": "x", "rss_end_mb": 70}]}, "cb_diagnostics": {"alpha": 0.0, "cb_claim_eligible": False}})
    document(tmp_path, "c", m("ml100k", "biased_mf", "2026-01"))
    document(tmp_path, "d", m("zz", "biased_mf", "2026-01"), {"metrics": {}})
    document(tmp_path, "e", m("ml100k", "cb_svdpp", "2026-01", status=""), {"metrics": {}, "cb_semantics": {"alpha": 0.3}})
    rows = reporting.result_table(spark, str(tmp_path)).collect()
    assert [(r["dataset"], r["model"]) for r in rows] == [("ml100k", "biased_mf"), ("ml100k", "cb_svdpp"), ("ml1m", "svdpp"), ("zz", "biased_mf")]
    last = rows[2]
    assert (last["test_rmse"], last["abs_error_p90"], last["train_time"], last["peak_memory"], last["alpha"], last["cb_claim_eligible"]) == (0.7, None, 3.0, 70.0, None, False)
    assert rows[0]["status"] == "completed_missing_metrics" and rows[1]["status"] == "unknown" and rows[1]["alpha"] == 0.3
    every = reporting.result_table(spark, str(tmp_path), ["ml1m"], True)
    assert [r["train_time"] for r in every.collect()] == [7.0, 3.0]
    assert reporting.render(every).splitlines()[2].startswith("| ml1m | svdpp | 0.800000 | 0.900000 |")
    assert reporting.render(every, "csv").splitlines()[1].startswith("ml1m,svdpp,0.8,0.9,")
    with pytest.raises(ValueError):
        reporting.render(every, "xml")
    assert reporting.find_run(every, run_id="ml1m-svdpp-2026-02")["test_rmse"] == 0.7
    for wanted in ({"run_id": "none"}, {"dataset": "ml1m"}):
        with pytest.raises(LookupError):
            reporting.find_run(every, **wanted)
    assert {r["run_dir"]: r["peak_rss_mb"] for r in reporting.stage_totals(spark, str(tmp_path)).collect()} == {"b": 70.0}


def test_tuning_and_seeds(spark, data, tmp_path):
    base = profile("biased_mf", latent_dim=2, epochs=1)
    candidates = [{"name": "slow", "overrides": {"training": {"learning_rate": 1e-6}}}, {"name": "fast", "overrides": {"training": {"learning_rate": 0.05, "epochs": 6}}}]
    ranked = studies.tune(spark, data, base, candidates, [PLAN], out_dir=str(tmp_path / "tune"))
    assert {r["unit"] for r in ranked.collect()} == {"slow", "fast"} and processed.read_json(str(tmp_path / "tune" / "tuning_summary.json"))["best"]["rank"] == 1
    assert os.path.exists(tmp_path / "tune" / "fast.yaml") and os.path.exists(tmp_path / "tune" / "tuning_summary.md")
    with pytest.raises(ValueError):
        studies.tune(spark, data, base, candidates[:1], [PLAN], peak_limit_mb=1e-3)
    rows = studies.random_splits(spark, data, base, [1, 2], PLAN)
    summary = studies.by_run(rows).first()
    assert summary["count"] == 2 and studies.by_seed(rows).first()["mean"] == pytest.approx(summary["mean"])
    folder = studies.write_benchmark(str(tmp_path), "bench", rows)
    assert manifests.validate_file(os.path.join(folder, "benchmark_manifest.json")) == "benchmark_manifest"


def test_runs_of_a_clean_commit_are_reused(spark, data, tmp_path):
    import subprocess

    git = lambda *a: subprocess.run(["git", "-c", "user.name=t", "-c", "user.email=t@t", "-C", str(tmp_path), *a], check=True, capture_output=True)
    git("init")
    (tmp_path / ".gitignore").write_text("*\n")
    git("commit", "--allow-empty", "-m", "x")
    base = profile("biased_mf", latent_dim=2, epochs=1)
    first = studies.repeated(spark, data, base, [PLAN], [1], out_dir=str(tmp_path)).first()
    runs = len(os.listdir(tmp_path))
    assert tuple(studies.repeated(spark, data, base, [PLAN], [1], out_dir=str(tmp_path)).first()) == tuple(first) and len(os.listdir(tmp_path)) == runs
    studies.repeated(spark, data, base, [PLAN], [2], out_dir=str(tmp_path))
    assert len(os.listdir(tmp_path)) == runs + 1

    # Stored runs are aggregated without a fit, if they are complete, alone, of one clean commit and the same profile.
    stored = studies.stored_runs(spark, str(tmp_path), data.name, base, [PLAN, PLAN], [1, 2])
    assert tuple(stored.orderBy("seed").first()) == tuple(first) and stored.count() == 2
    assert len(os.listdir(tmp_path)) == runs + 1
    with pytest.raises(LookupError, match="no run"):
        studies.stored_runs(spark, str(tmp_path), data.name, base, [PLAN], [3])
    with pytest.raises(ValueError, match="another configuration"):
        studies.stored_runs(spark, str(tmp_path), data.name, profile("biased_mf", latent_dim=2, epochs=2), [PLAN], [1])
    folders = {processed.read_json(os.path.join(tmp_path, n, "run_manifest.json"))["model"]["seed"]: tmp_path / n for n in os.listdir(tmp_path) if os.path.exists(tmp_path / n / "metrics.json")}
    shutil.copytree(folders[1], tmp_path / "twice")
    with pytest.raises(LookupError, match="several"):
        studies.stored_runs(spark, str(tmp_path), data.name, base, [PLAN], [1])
    shutil.rmtree(tmp_path / "twice")
    manifest = processed.read_json(str(folders[2] / "run_manifest.json"))
    for changed, match in (({"clean": False}, "clean"), ({"commit": "other"}, "several commits")):
        processed.write_json(str(folders[2] / "run_manifest.json"), manifest | {"git": manifest["git"] | changed})
        with pytest.raises(ValueError, match=match):
            studies.stored_runs(spark, str(tmp_path), data.name, base, [PLAN, PLAN], [1, 2])
    git("commit", "--allow-empty", "-m", "y")
    with pytest.raises(ValueError, match="repository is at"):
        studies.stored_runs(spark, str(tmp_path), data.name, base, [PLAN], [1])


def test_caches_asked_for_without_use(spark, data):
    for option in ("index_cache", "cluster_cache"):
        with pytest.raises(ValueError, match="does not apply"):
            experiment.run(spark, data, profile("biased_mf", latent_dim=2, epochs=1), PLAN, **{option: "on"})


def test_diagnostics_say_what_is_missing(spark, data):
    bare = fit.Model(cfg.Config("cb_svdpp", 2, 1, alpha=0.2), spark.createDataFrame([], fit.PARAMETERS), 3.0, 1.0, 5.0, data.n_users, data.n_items, fit.Indices())
    found = experiment.cluster_diagnostics(bare, data.rows)
    assert found["missing_expected_artifacts"] == ["cluster_artifacts", "user_history_index", "user_cluster_history_index"]
    assert found["missing_expected_model_fields"] == ["p", "q", "y", "pC", "qC", "yC"] and found["diagnostic_warnings"] and found["cluster_contribution_measured"] is None


def test_ranking_order(spark):
    rows = spark.createDataFrame([("a", 0, 1.0, 5.0, 1.0), ("a", 0, 1.0, 5.0, 1.0), ("b", 1, 1.0, 4.0, 1.0), ("c", 2, 0.9, 9.0, 99.0)], "unit string, candidate_index int, validation_rmse double, fit_seconds double, peak_mb double")
    assert [r["unit"] for r in studies.rank_candidates(rows).orderBy("rank").collect()] == ["c", "b", "a"]
    assert [r["unit"] for r in studies.rank_candidates(rows, 50).orderBy("rank").collect()] == ["b", "a"]


def test_manifests():
    with pytest.raises(ValueError):
        manifests.manifest_kind({})
    with pytest.raises(ValueError):
        manifests.validate({"kind": "run_manifest", "run_id": "x"})
    assert manifests.manifest_kind({"benchmark_id": 1}) == "benchmark_manifest"


def test_runtime(spark, tmp_path):
    stages = runtime.Stages()
    with stages.stage("a"), runtime.peak_memory() as memory:
        pass
    assert stages.payload()["stages"][0]["name"] == "a" and memory["peak_mb"] > 0
    s = runtime.system_metrics(10, 2, 4.0, 5, 0.0, 1.0, 1.0, 8_000_000)
    assert (s["train_ratings_per_second"], s["inference_ratings_per_second"], s["model_size_mb"]) == (5.0, None, 8.0)
    assert runtime.resolve_dtype({}, {"dtype": "float64"}, {"dtype": "float32"}) == "float64"
    with pytest.raises(ValueError):
        runtime.resolve_dtype({"dtype": "half"}, None, None)
    with pytest.raises(ValueError):
        runtime.measurement(0)
    assert runtime.assess_device({"cpus": 1}, spark)["satisfied"] and runtime.metadata(spark)["spark"] == spark.version
    os.makedirs(tmp_path / "r" / ".git")
    os.makedirs(tmp_path / "r" / "x")
    assert runtime.repo_root(str(tmp_path / "r" / "x")) == str(tmp_path / "r")


def test_timings(spark, data, tmp_path):
    model = fit.fit(data, cfg.Config("svdpp", 2, 1))
    sums, gap, ratio = timings.context_reuse(model, data.rows, 5, 2, 1)
    assert gap < 1e-9 and ratio > 0 and sums.count() == 2
    assert timings.index_reuse(data, cfg.Config("svdpp", 2, 1)).count() == 2
    data.rows.write.parquet(str(tmp_path / "x"))
    manifest = processed.write_manifest(str(tmp_path), {"interactions": str(tmp_path / "x")}, {"dataset_name": "t", "dataset_short_name": "t", "split_family": "s"}, data.rows, {})
    assert timings.loading(spark, manifest, 1).count() == 2


def test_command_line(spark, data, tmp_path, capsys):
    data.rows.write.parquet(str(tmp_path / "x"))
    manifest = processed.write_manifest(str(tmp_path), {"interactions": str(tmp_path / "x")}, {"dataset_name": "t", "dataset_short_name": "t", "split_family": "s"}, data.rows, {})
    artifacts.write_yaml(str(tmp_path / "m.yaml"), profile("biased_mf", latent_dim=2, epochs=1))
    common = ["--model-config", str(tmp_path / "m.yaml"), "--train-ratio", "0.5", "--validation-ratio", "0.25", "--split-seed", "3"]
    assert cli.main(["train-biased-mf", *common, "--dataset-manifest", manifest, "--out-dir", str(tmp_path / "runs")]) == 0
    assert json.loads(capsys.readouterr().out)["metrics"]["test_rmse"] > 0
    assert cli.main(["collect-results", "--runs-dir", str(tmp_path / "runs")]) == 0
    assert "| t | biased_mf |" in capsys.readouterr().out
    assert cli.main(["run-experiment", *common]) == 0 and cli.main(["validate-manifest", manifest]) == 0
    with pytest.raises(ValueError):
        cli.main(["train-svdpp", *common, "--dataset-manifest", manifest])
    names = set(cli.parser()._subparsers._group_actions[0].choices)
    assert {"bootstrap-check", "validate-runtime-profile", "prepare-dataset", "train", "tune-inner", "tune-ml100k-inner", "benchmark-ml100k-paper", "benchmark-ml100k-paper-multiseed", "benchmark-random-multiseed", "train-cb-asvdpp"} <= names


def test_streams(spark, data, tmp_path):
    model = fit.fit(data, cfg.Config("biased_mf", 2, 1))
    pairs = data.rows.select("user_idx", "item_idx")
    pairs.write.parquet(str(tmp_path / "pairs"))
    stream = spark.readStream.schema(pairs.schema).parquet(str(tmp_path / "pairs"))
    q = streams.score_stream(model, stream).writeStream.format("memory").queryName("scored").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("scored").filter(F.col("prediction").isNotNull()).count() == 16
    events = spark.createDataFrame([(1, 0), (1, 10), (1, 100), (2, 5), (9, 100_000)], "u int, s bigint").select("u", F.timestamp_seconds("s").alias("t"))
    events.write.parquet(str(tmp_path / "events"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "events"))
    q = streams.session_stream(stream, "u", "t", "30 seconds", "1 minute").writeStream.format("memory").queryName("sessions").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    found = {(r["entity"], r["events"]) for r in spark.table("sessions").collect()}
    assert found == {(1, 2), (1, 1), (2, 1)}
