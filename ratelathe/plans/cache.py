"""Stored results of splits, indices and clusters, found again by what they were made from.

An entry is a folder of Parquet tables and a JSON identity. It counts as a hit only if its identity is the one asked for
and every table can be read; anything else, a broken entry included, is a miss and is made anew.
"""

from __future__ import annotations

import hashlib
import json
import os
import shutil
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession

from ratelathe.sources.processed import read_json, write_json

ROOT_VARIABLE = "RATELATHE_CACHE_ROOT"


def identity_key(identity: dict) -> str:
    """The first 16 hex digits of the SHA-256 of the identity as canonical JSON."""
    return hashlib.sha256(json.dumps(identity, sort_keys=True, separators=(",", ":")).encode()).hexdigest()[:16]


def cache_root(default: str) -> str:
    return os.environ.get(ROOT_VARIABLE, default)


def enabled(policy: str) -> bool:
    """``on`` uses the cache; ``off`` and ``auto`` do not."""
    if policy not in ("auto", "on", "off"):
        raise ValueError(f"unknown cache policy: {policy}")
    return policy == "on"


def check_applicable(policy: str, applicable: bool, what: str) -> None:
    if policy == "on" and not applicable:
        raise ValueError(f"a cache of {what} does not apply to this model")


def cached(spark: SparkSession, root: str, kind: str, identity: dict, make: Callable[[], dict[str, DataFrame]], policy: str = "auto") -> tuple[dict[str, DataFrame], str]:
    """The tables of an entry, and ``hit``, ``miss`` or ``disabled``. ``make`` is called for the last two only."""
    if not enabled(policy):
        return make(), "disabled"
    identity = json.loads(json.dumps(identity))  # as it is read back
    folder = os.path.join(root, kind, identity_key(identity))
    try:
        held = read_json(os.path.join(folder, "identity.json"))
        if held["identity"] == identity:
            tables = {name: spark.read.parquet(os.path.join(folder, name)) for name in held["tables"]}
            for df in tables.values():
                df.write.format("noop").mode("overwrite").save()  # reads all of it
            return tables, "hit"
    except (OSError, ValueError, KeyError, PySparkException, Py4JJavaError):
        pass  # a missing, foreign or broken entry is no hit
    shutil.rmtree(folder, ignore_errors=True)
    tables = make()
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(os.path.join(folder, name))
    # The identity comes last: an entry without it was not finished.
    write_json(os.path.join(folder, "identity.json"), {"identity": identity, "tables": sorted(tables)})
    return {name: spark.read.parquet(os.path.join(folder, name)) for name in tables}, "miss"
