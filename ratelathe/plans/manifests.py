"""Run and benchmark manifests: kinds, required fields and their checks."""

from __future__ import annotations

from typing import Any, Literal

from pydantic import BaseModel, ConfigDict

from ratelathe.sources.processed import read_json


class Strict(BaseModel):
    model_config = ConfigDict(extra="forbid")


class RunManifest(Strict):
    manifest_version: str
    kind: Literal["run_manifest"]
    run_id: str
    status: Literal["started", "completed", "failed"]
    generated_at_utc: str
    dataset: dict[str, Any]
    model: dict[str, Any]
    split: dict[str, Any]
    git: dict[str, Any] = {}
    runtime: dict[str, Any] = {}
    requirements: dict[str, Any] = {}
    cb_semantics: dict[str, Any] | None = None
    timing: dict[str, Any] = {}
    profiling: dict[str, Any] = {}
    caches: dict[str, Any] = {}
    command: str = ""
    error: str | None = None


class BenchmarkManifest(Strict):
    manifest_version: str
    kind: Literal["benchmark_manifest"]
    benchmark_id: str
    status: Literal["started", "completed", "failed"]
    generated_at_utc: str
    name: str
    measurement: dict[str, Any] = {}
    runs: list[Any] = []
    summary: dict[str, Any] = {}
    git: dict[str, Any] = {}
    runtime: dict[str, Any] = {}
    error: str | None = None


class ProcessedManifest(BaseModel):
    manifest_version: str
    kind: Literal["processed_dataset_manifest"]
    dataset_name: str
    dataset_short_name: str
    split_family: str
    counts: dict[str, int]
    rating_range: dict[str, float]
    artifacts: dict[str, Any]


KINDS = {"run_manifest": RunManifest, "benchmark_manifest": BenchmarkManifest, "processed_dataset_manifest": ProcessedManifest}


def manifest_kind(payload: dict) -> str:
    """Told by the field kind, else by the id that it has; ValueError if neither tells."""
    kind = payload.get("kind") or ("run_manifest" if "run_id" in payload else "benchmark_manifest" if "benchmark_id" in payload else None)
    if kind not in KINDS:
        raise ValueError(f"unknown kind of manifest: {kind}")
    return kind


def validate(payload: dict) -> dict:
    """The manifest, checked; unknown top-level fields are errors in those of runs and benchmarks."""
    return KINDS[manifest_kind(payload)].model_validate(payload).model_dump()


def validate_file(path: str) -> str:
    payload = read_json(path)
    validate(payload)
    return manifest_kind(payload)
