"""Command line: python -m ratelathe.cli COMMAND ..."""

from __future__ import annotations

import argparse
import json
import sys
from dataclasses import replace

from ratelathe.models.config import PARTS

MODELS = {f"train-{name.replace('_', '-')}": name for name in PARTS}


def _plan(a: argparse.Namespace):  # noqa: ANN202
    from ratelathe.plans.experiment import SplitPlan

    return SplitPlan(a.split_family, a.train_ratio, a.validation_ratio, a.split_seed, a.fold, a.inner_seed)


def _session():  # noqa: ANN202
    from ratelathe.session import local_session

    return local_session("ratelathe-cli")


def _loaded(spark, a: argparse.Namespace):  # noqa: ANN001, ANN202
    from ratelathe.sources import processed

    data = processed.load_ratings(spark, a.dataset_manifest)
    tables = processed.read_json(a.dataset_manifest)["artifacts"]
    return data, spark.read.parquet(tables["official_folds"]) if "official_folds" in tables else None


def _profile(a: argparse.Namespace) -> dict:
    from ratelathe.sources.artifacts import read_yaml

    profile = read_yaml(a.model_config)
    wanted = MODELS.get(a.command)
    if wanted and profile.get("model", {}).get("name") != wanted:
        raise ValueError(f"{a.command} needs a profile of {wanted}")
    return profile


def _run(a: argparse.Namespace) -> object:
    from ratelathe.plans import experiment, manifests, prepare, reporting, runtime, studies
    from ratelathe.sources.artifacts import read_yaml

    name = a.command
    if name == "bootstrap-check":
        return {"repository": runtime.repo_root("."), "models": list(PARTS)}
    if name == "validate-manifest":
        return {"kind": manifests.validate_file(a.path)}
    if name == "run-experiment":
        return experiment.dry_run(_profile(a), _plan(a), a.dataset)
    spark = _session()
    if name == "validate-runtime-profile":
        return runtime.assess_device(read_yaml(a.path), spark)
    if name == "prepare-dataset":
        return {"manifest": prepare.prepare_from_config(spark, a.config, a.dtype, a.overwrite)}
    if name == "collect-results":
        return reporting.render(reporting.result_table(spark, a.runs_dir, a.dataset or None, a.all_runs), a.format)
    data, folds = _loaded(spark, a)
    if name == "train" or name in MODELS:
        result = experiment.run(spark, data, _profile(a), _plan(a), seed=a.model_seed, out_dir=a.out_dir, fold_ids=folds, cache_policy=a.cache, index_cache=a.index_cache, cluster_cache=a.cluster_cache, command=" ".join(sys.argv))
        return {"folder": result.folder, "metrics": result.metrics["metrics"]}
    if name in ("tune-inner", "tune-ml100k-inner"):
        plans = [_plan(a)] if name == "tune-inner" else [experiment.SplitPlan("paper_faithful_ml100k_inner_v1", validation=a.validation_ratio, fold=k, inner_seed=a.inner_seed or 1) for k in a.folds]
        ranked = studies.tune(spark, data, _profile(a), read_yaml(a.candidates)["candidates"], plans, seed=a.model_seed, out_dir=a.out_dir, fold_ids=folds, peak_limit_mb=a.peak_limit_mb)
        return [r.asDict() for r in ranked.orderBy("rank").collect()]
    seeds = a.seeds if name.endswith("multiseed") else [a.model_seed]
    if name.endswith("multiseed") and a.from_runs:
        random = name == "benchmark-random-multiseed"
        each = [(replace(_plan(a), seed=s) if random else experiment.SplitPlan("paper_faithful_ml100k_v1", fold=k), s) for s in seeds for k in ([0] if random else range(1, 6))]
        rows = studies.stored_runs(spark, a.from_runs, data.name, _profile(a), *map(list, zip(*each)))
    elif name == "benchmark-random-multiseed":
        rows = studies.random_splits(spark, data, _profile(a), seeds, _plan(a), out_dir=a.out_dir)
    else:
        rows = studies.folds(spark, data, _profile(a), folds, seeds, out_dir=a.out_dir)
    return {"folder": studies.write_benchmark(a.out_dir, name, rows)}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="ratelathe", description=__doc__)
    commands = p.add_subparsers(dest="command", required=True)
    add = lambda n: commands.add_parser(n)
    add("bootstrap-check")
    for n in ("validate-manifest", "validate-runtime-profile"):
        add(n).add_argument("path")
    c = add("prepare-dataset")
    c.add_argument("config")
    c.add_argument("--dtype", default="float32")
    c.add_argument("--overwrite", action="store_true")
    c = add("collect-results")
    c.add_argument("--runs-dir", default="artifacts/runs")
    c.add_argument("--all-runs", action="store_true")
    c.add_argument("--dataset", action="append")
    c.add_argument("--format", choices=("markdown", "csv"), default="markdown")
    studies = ("tune-inner", "tune-ml100k-inner", "benchmark-ml100k-paper", "benchmark-ml100k-paper-multiseed", "benchmark-random-multiseed")
    for n in ("run-experiment", "train", *MODELS, *studies):
        c = add(n)
        c.add_argument("--model-config", required=True)
        c.add_argument("--split-family", default="benchmark_random_v1")
        c.add_argument("--train-ratio", type=float, default=0.8)
        c.add_argument("--validation-ratio", type=float, default=0.1)
        for number in ("--split-seed", "--model-seed"):
            c.add_argument(number, type=int, default=1)
        for number in ("--fold", "--inner-seed"):
            c.add_argument(number, type=int)
        c.add_argument("--dataset", default="ml100k") if n == "run-experiment" else c.add_argument("--dataset-manifest", required=True)
        c.add_argument("--out-dir", default="artifacts/runs")
        c.add_argument("--cache", choices=("auto", "on", "off"), default="auto")
        for kind in ("--index-cache", "--cluster-cache"):
            c.add_argument(kind, choices=("auto", "on", "off"))
        if n.startswith("tune"):
            c.add_argument("--candidates", required=True)
            c.add_argument("--peak-limit-mb", type=float)
            c.add_argument("--folds", type=int, nargs="+", default=[1, 2, 3, 4, 5])
        if n.endswith("multiseed"):
            c.add_argument("--seeds", type=int, nargs="+", default=[1, 2, 3])
            c.add_argument("--from-runs")
    return p


def main(args: list[str] | None = None) -> int:
    found = _run(parser().parse_args(args))
    print(found if isinstance(found, str) else json.dumps(found, indent=2, default=str))
    return 0


if __name__ == "__main__":
    sys.exit(main())
