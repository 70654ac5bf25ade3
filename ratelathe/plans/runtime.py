"""What is recorded about a run besides its results: stages, machine, memory, throughput, state of the repository."""

from __future__ import annotations

import os
import platform
import resource
import subprocess
import threading
import time
from collections.abc import Iterator
from contextlib import contextmanager
from datetime import datetime, timezone

from pyspark.sql import SparkSession


def resident_mb() -> float:
    with open("/proc/self/statm") as file:
        return int(file.read().split()[1]) * resource.getpagesize() / 1e6


class Stages:
    """Wall-clock seconds and memory of named stages."""

    def __init__(self) -> None:
        self.stages: list[dict] = []

    @contextmanager
    def stage(self, name: str) -> Iterator[None]:
        began, before = time.perf_counter(), resident_mb()
        try:
            yield
        finally:
            self.stages.append({"name": name, "wall_clock_seconds": time.perf_counter() - began, "rss_start_mb": before, "rss_end_mb": resident_mb()})

    def payload(self) -> dict:
        return {"stages": self.stages, "total_profiled_wall_clock_seconds": sum(s["wall_clock_seconds"] for s in self.stages)}


@contextmanager
def peak_memory(every: float = 0.01) -> Iterator[dict]:
    """Watches this process's memory meanwhile: ``peak_mb`` and ``delta_mb``."""
    found, done = {"start_mb": resident_mb(), "peak_mb": resident_mb()}, threading.Event()

    def watch() -> None:
        while not done.wait(every):
            found["peak_mb"] = max(found["peak_mb"], resident_mb())

    thread = threading.Thread(target=watch, daemon=True)
    thread.start()
    try:
        yield found
    finally:
        done.set()
        thread.join()
        found["peak_mb"] = max(found["peak_mb"], resident_mb())
        found["delta_mb"] = found["peak_mb"] - found["start_mb"]


def system_metrics(train_rows: int, epochs: int, train_seconds: float, inference_rows: int, inference_seconds: float, peak_mb: float, delta_mb: float, model_bytes: int) -> dict:
    rate = lambda n, s: n / s if s > 0 else None
    return {
        "train_time_total": train_seconds,
        "train_time_per_epoch": train_seconds / epochs if epochs else None,
        "train_ratings_per_second": rate(train_rows * epochs, train_seconds),
        "inference_ratings_per_second": rate(inference_rows, inference_seconds),
        "peak_memory_mb": peak_mb,
        "delta_memory_mb": delta_mb,
        "model_size_mb": model_bytes / 1e6,
    }


def measurement(repeats: int = 1, warmups: int = 0, policy: str = "none") -> dict:
    if repeats < 1 or warmups < 0 or policy not in ("none", "discard", "report"):
        raise ValueError("repeats must be at least 1, warm-ups at least 0, the policy none, discard or report")
    return {"repeats": repeats, "warmups": warmups, "warmup_policy": policy}


def metadata(spark: SparkSession) -> dict:
    wanted = ("spark.master", "spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled", "spark.executor.memory", "spark.driver.memory", "spark.sql.session.timeZone")
    return {"python": platform.python_version(), "platform": platform.platform(), "cpus": os.cpu_count(), "spark": spark.version, "conf": {k: spark.conf.get(k, None) for k in wanted}, "generated_at_utc": datetime.now(timezone.utc).isoformat()}


def executors(spark: SparkSession) -> dict:
    """Cores and storage memory of the executors that the session has now (of the driver in local mode)."""
    context, memory = spark.sparkContext, 0
    held = context._jsc.sc().getExecutorMemoryStatus().valuesIterator()
    while held.hasNext():
        memory += held.next()._1()
    return {"cpus": context.defaultParallelism, "memory_gb": memory / 1e9}


def assess_device(profile: dict, spark: SparkSession) -> dict:
    """Which of a device profile's wishes (cpus, memory_gb, shuffle_partitions) this session's executors meet."""
    has = executors(spark)
    met = {name: has[name] >= profile.get(name, 0) for name in ("cpus", "memory_gb")}
    if "shuffle_partitions" in profile:
        met["shuffle_partitions"] = int(spark.conf.get("spark.sql.shuffle.partitions")) == profile["shuffle_partitions"]
    return {"met": met, "satisfied": all(met.values())}


def resolve_dtype(model: dict | None, device: dict | None, runtime: dict | None, default: str = "float32") -> str:
    """The first type that the model, the device or the runtime profile names."""
    for profile in (model, device, runtime):
        if profile and profile.get("dtype"):
            if profile["dtype"] not in ("float32", "float64"):
                raise ValueError(f"dtype must be float32 or float64, not {profile['dtype']}")
            return profile["dtype"]
    return default


def git_state(folder: str) -> dict:
    def run(*args: str) -> str | None:
        found = subprocess.run(["git", "-C", folder, *args], capture_output=True, text=True)
        return found.stdout.strip() if found.returncode == 0 else None

    status = run("status", "--porcelain")
    return {"commit": run("rev-parse", "HEAD"), "branch": run("rev-parse", "--abbrev-ref", "HEAD"), "clean": status == "" if status is not None else None}


def repo_root(start: str) -> str:
    """The nearest folder above with a .git; FileNotFoundError if there is none."""
    here = os.path.abspath(start)
    while not os.path.exists(os.path.join(here, ".git")):
        above = os.path.dirname(here)
        if above == here:
            raise FileNotFoundError(f"no repository above {start}")
        here = above
    return here
