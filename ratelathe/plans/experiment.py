"""The life of one experiment: split, derived tables, fit, scores, metrics, and the record of it all."""

from __future__ import annotations

import os
import time
from dataclasses import asdict, dataclass, replace
from datetime import datetime, timezone

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ratelathe.functions import metrics, vectors
from ratelathe.models import config as cfg
from ratelathe.models import fit, scoring
from ratelathe.operators import clusters as cl
from ratelathe.operators import histories as hist
from ratelathe.operators import interactions as ops
from ratelathe.operators import splits
from ratelathe.operators.views import Ratings, spread_sample
from ratelathe.plans import cache, runtime
from ratelathe.session import cut
from ratelathe.sources import artifacts, processed


@dataclass(frozen=True)
class SplitPlan:
    family: str = "benchmark_random_v1"
    train: float = 0.8
    validation: float = 0.1
    seed: int = 1
    fold: int | None = None
    inner_seed: int | None = None

    def id(self) -> str:
        return splits.split_id(self.family, self.seed, self.train, self.validation, self.fold, self.inner_seed)


@dataclass(frozen=True)
class Result:
    folder: str | None
    metrics: dict
    manifest: dict
    model: fit.Model


def resolve_split(spark: SparkSession, data: Ratings, plan: SplitPlan, fold_ids: DataFrame | None, root: str, policy: str, content: str) -> tuple[dict[str, Ratings], str]:
    """The parts of a split, from the cache if it holds them."""
    identity = {"content": content, "split": plan.id()}
    make = lambda: {"split": splits.build_split(data, plan.family, train=plan.train, validation=plan.validation, seed=plan.seed, fold=plan.fold, fold_ids=fold_ids, inner_seed=plan.inner_seed)}
    tables, state = cache.cached(spark, root, "splits", identity, make, policy)
    return splits.as_parts(cut(tables["split"].select("row_id", "user_idx", "item_idx", "rating", "split")), data), state


def resolve_indices(spark: SparkSession, train: Ratings, config: cfg.Config, profile, root: str, policy: str, cluster_policy: str, identity: dict, stages: runtime.Stages) -> tuple[fit.Indices, dict[str, str]]:  # noqa: ANN001
    """What the model needs, in the order of dependence: clusters, history, explicit feedback, cluster counts."""
    needs, state, found = cfg.requirements(config.model), {}, {}
    if needs.clusters:
        c = profile.clustering
        of = identity | {"clustering": c.model_dump(), "config": asdict(cfg.induction_config(config))}
        with stages.stage("cluster_induction"):

            def induce() -> dict[str, DataFrame]:
                k = cl.induce(train, cfg.induction_config(config), c.n_user_clusters, c.n_item_clusters, c.algorithm, c.kmeans_n_init)
                facts = spark.createDataFrame([(k.train_rmse, k.user_inertia, k.item_inertia)], "train_rmse double, user_inertia double, item_inertia double")
                return {"users": cut(k.users), "items": cut(k.items), "r_star": cut(k.r_star), "facts": facts}

            t, state["cluster_artifacts"] = cache.cached(spark, root, "cb_clusters", of, induce, cluster_policy)
            facts = t["facts"].first()
            found["clusters"] = cl.Clusters(t["users"], t["items"], t["r_star"], c.n_user_clusters, c.n_item_clusters, *facts)
    if needs.history:
        with stages.stage("user_history_index"):
            t, state["user_history_index"] = cache.cached(spark, root, "ti", identity | {"index": "history"}, lambda: {"history": hist.history(train)}, policy)
            found["history"] = cut(t["history"])
    if needs.explicit:
        with stages.stage("explicit_feedback_index"):
            t, state["explicit_feedback_index"] = cache.cached(spark, root, "ti", identity | {"index": "explicit"}, lambda: {"explicit": hist.explicit_feedback(train)}, policy)
            found["explicit"] = cut(t["explicit"])
    if needs.clusters:
        with stages.stage("user_cluster_history_index"):
            t, state["user_cluster_history_index"] = cache.cached(spark, root, "uch", of, lambda: {"counts": hist.cluster_counts(found["history"], found["clusters"].items)}, cluster_policy)
            found["cluster_counts"] = cut(t["counts"])
    return fit.Indices(**found), state


def clustering_payload(indices: fit.Indices, n_users: int) -> dict | None:
    """Sizes, density and activity of the clusters; None for a model without."""
    k = indices.clusters
    if k is None:
        return None
    one = lambda df: df.first().asDict()
    return {
        "user_clusters": one(cl.size_summary(cl.sizes(k.users, k.n_user_clusters))),
        "item_clusters": one(cl.size_summary(cl.sizes(k.items, k.n_item_clusters))),
        "r_star": one(cl.grid_summary(k.r_star)),
        "active_clusters": one(hist.active_clusters(indices.cluster_counts, n_users)),
        "train_rmse": k.train_rmse,
        "user_inertia": k.user_inertia,
        "item_inertia": k.item_inertia,
    }


def missing_artifacts(indices: fit.Indices) -> list[str]:
    """What a clustering-based model should have been fitted with and was not."""
    have = {"cluster_artifacts": indices.clusters, "user_history_index": indices.history, "user_cluster_history_index": indices.cluster_counts}
    return [name for name, found in have.items() if found is None]


def cluster_diagnostics(model: fit.Model, rows: DataFrame) -> dict | None:
    """What the clusters do to predictions and vectors, on an evenly spread sample of the rows, and what is missing to
    tell; None for a model without clusters. The names of the fields are those of a run record: fixed values."""
    if "pC" not in model.config.parts:
        return None
    own, k, warnings, shift, sampled = cfg.cluster_semantics(model.config.alpha), model.indices.clusters, [], {}, 0
    try:
        sample = cut(spread_sample(rows, ["row_id"]))
        shift, sampled = scoring.cluster_contribution(model, sample).first().asDict(), sample.count()
    except (PySparkException, Py4JJavaError, AttributeError) as e:
        warnings.append(f"the contribution of clusters was not measured: {type(e).__name__}: {e}"[:500])
    have = {r["part"] for r in model.parameters.select("part").distinct().collect()}
    norm = lambda *parts: vectors.mean_length(*[model.table(p, "id") for p in parts]).first()[0] if have.issuperset(parts) else None
    entity, cluster = norm("p", "q"), norm("pC", "qC")
    ratio = cluster / entity if entity and cluster is not None else None
    shapes = clustering_payload(model.indices, model.n_users) if not missing_artifacts(model.indices) else None
    users, items, grid = (shapes[x] for x in ("user_clusters", "item_clusters", "r_star")) if shapes else ({}, {}, {})
    return own | {
        "effective_alpha": model.config.alpha,
        "cluster_artifacts_present": k is not None,
        "user_cluster_count": k and k.n_user_clusters,
        "item_cluster_count": k and k.n_item_clusters,
        "empty_user_clusters": users.get("empty"),
        "empty_item_clusters": items.get("empty"),
        "user_cluster_size_min": users.get("least"),
        "user_cluster_size_max": users.get("most"),
        "item_cluster_size_min": items.get("least"),
        "item_cluster_size_max": items.get("most"),
        "individual_factor_norm_mean": entity,
        "cluster_factor_norm_mean": cluster,
        "cluster_to_individual_norm_ratio": ratio,
        "cluster_factor_norm_ratio": ratio,
        "implicit_factor_norm_mean": norm("y"),
        "implicit_cluster_factor_norm_mean": norm("yC"),
        "explicit_factor_norm_mean": norm("x"),
        "explicit_cluster_factor_norm_mean": norm("xC"),
        "missing_expected_artifacts": missing_artifacts(model.indices),
        "missing_expected_model_fields": [p for p in model.config.parts if p not in have],
        "cluster_contribution_measured": bool(shift["measured"]) if shift else None,
        "cb_contribution_measured": bool(shift["measured"]) if shift else None,
        "average_absolute_cluster_prediction_contribution": shift.get("mean_abs_contribution"),
        "largest_absolute_cluster_prediction_contribution": shift.get("max_abs_contribution"),
        "diagnostic_sample_rows": sampled,
        "diagnostic_claim_ready": False,
        "diagnostic_warnings": warnings,
        "r_star_density": grid.get("density"),
        "cluster_size_distribution": {"users": users, "items": items},
        "cluster_coverage": {"user_cluster_coverage": users.get("coverage"), "item_cluster_coverage": items.get("coverage")},
        "clustering": shapes,
        "alpha_zero_ablation_reference": {"available": False, "reason": "no run with alpha 0 on the same split was given"},
    }


def run(spark: SparkSession, data: Ratings, profile_payload: dict, plan: SplitPlan, *, seed: int = 1, out_dir: str | None = None, fold_ids: DataFrame | None = None, evaluate_test: bool = True, cache_policy: str = "auto", index_cache: str | None = None, cluster_cache: str | None = None, device: dict | None = None, cache_dir: str = "artifacts/cache", command: str = "") -> Result:
    """Runs one experiment. With ``out_dir``, a new folder there holds the manifest (started, then completed or failed),
    the metrics, the profile and a log. ``index_cache`` and ``cluster_cache`` override the policy of all caches; asked
    for by name where the model has no use for them, they are an error. ``device`` may name a type where the profile
    leaves it open."""
    profile = cfg.load_profile(profile_payload)
    config = cfg.config_of(profile, seed)
    config = replace(config, dtype=runtime.resolve_dtype({"dtype": config.dtype}, device, None))
    needs = cfg.requirements(config.model)
    cache.check_applicable(index_cache or "auto", needs.history or needs.explicit, "training indices")
    cache.check_applicable(cluster_cache or "auto", needs.clusters, "clusters")
    index_policy, cluster_policy = index_cache or cache_policy, cluster_cache or cache_policy
    stages, name = runtime.Stages(), config.model
    slug = f"{data.name}_{name}_{plan.id()}_m{seed:03d}"
    folder = artifacts.reserve_folder(out_dir, slug) if out_dir else None
    manifest = {
        "manifest_version": "v1",
        "kind": "run_manifest",
        "run_id": os.path.basename(folder) if folder else slug,
        "status": "started",
        "generated_at_utc": datetime.now(timezone.utc).isoformat(),
        "dataset": {"short_name": data.name},
        "model": {"name": name, "seed": seed, "config": asdict(config) | {"penalties": dict(config.penalties)}},
        "split": asdict(plan) | {"id": plan.id()},
        "git": runtime.git_state(out_dir or "."),
        "runtime": runtime.metadata(spark),
        "requirements": cfg.requirements_payload(name),
        "cb_semantics": cfg.cluster_semantics(config.alpha) if cfg.requirements(name).clusters else None,
        "command": command,
    }

    def record(**more: object) -> dict:
        manifest.update(more)
        if folder:
            processed.write_json(os.path.join(folder, "run_manifest.json"), manifest)
        return manifest

    record()
    try:
        root = cache.cache_root(cache_dir)
        with stages.stage("content"):
            content = ops.fingerprint(data.rows, ["row_id", "user_idx", "item_idx", "rating"]) if "on" in (cache_policy, index_policy, cluster_policy) else ""
        with stages.stage("split"):
            parts, split_state = resolve_split(spark, data, plan, fold_ids, root, cache_policy, content)
        identity = {"content": content, "split": plan.id(), "dtype": config.dtype}
        indices, states = resolve_indices(spark, parts["train"], config, profile, root, index_policy, cluster_policy, identity, stages)
        with runtime.peak_memory() as memory, stages.stage("main_training"):
            model = fit.fit(parts["train"], config, indices)
        users = cut(scoring.contexts(model))
        wanted = ["train", "validation"] + ["test"] * evaluate_test
        rows = None
        for part in wanted:
            p = parts[part].rows.withColumn("split", F.lit(part))
            rows = p if rows is None else rows.unionByName(p)
        began = time.perf_counter()
        with stages.stage("inference"):
            scored = cut(scoring.predict(model, rows, True, users))
        inference = time.perf_counter() - began
        sizes = {r["split"]: r.asDict() for r in splits.split_sizes(scored).collect()}
        values = metrics.per_split(scored, "rating", "prediction", data.rating_min, data.rating_max)
        took = {s["name"]: s["wall_clock_seconds"] for s in stages.stages}
        payload = {
            "dataset": manifest["dataset"],
            "model": manifest["model"],
            "metrics": values,
            "split_sizes": sizes,
            "timing": {"training_wall_clock_seconds": took["main_training"]},
            "system_metrics": runtime.system_metrics(sizes["train"]["rows"], config.epochs, took["main_training"], sum(s["rows"] for s in sizes.values()), inference, memory["peak_mb"], memory["delta_mb"], scoring.parameter_bytes(model)),
            "profiling": stages.payload(),
            "caches": {"split": split_state, **states},
            "cb_diagnostics": cluster_diagnostics(model, parts["validation"].rows),
        }
        if folder:
            processed.write_json(os.path.join(folder, "metrics.json"), payload)
            artifacts.write_yaml(os.path.join(folder, "model_config.yaml"), profile.model_dump(mode="json"))
            artifacts.write_log(os.path.join(folder, "run.log"), [f"{s['name']}: {s['wall_clock_seconds']:.3f} s" for s in stages.stages])
        record(status="completed", timing=payload["timing"], profiling=payload["profiling"], caches=payload["caches"])
        return Result(folder, payload, manifest, model)
    except BaseException as e:
        record(status="failed", error=f"{type(e).__name__}: {e}"[:2000])
        raise


def dry_run(profile_payload: dict, plan: SplitPlan, dataset: str) -> dict:
    """What a run would do, without data."""
    profile = cfg.load_profile(profile_payload)
    return {"dataset": dataset, "model": profile.model.name, "split_id": plan.id(), "requirements": cfg.requirements_payload(profile.model.name), "steps": ["load", "split", *cfg.requirements(profile.model.name).names(), "main_training", "inference", "metrics"]}
