"""Processed data sets: Parquet tables with a JSON manifest that says what they hold."""

from __future__ import annotations

import json
import os
import shutil
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ratelathe.operators import interactions as ops
from ratelathe.operators.views import COLUMNS, Ratings

TABLES = ("interactions", "user_mapping", "item_mapping", "movies", "links", "tags")


def write_atomically(path: str, text: str) -> None:
    """Readers see the old file or the new one, never a part."""
    with open(f"{path}.tmp", "w", encoding="utf-8") as file:
        file.write(text)
    os.replace(f"{path}.tmp", path)


def write_json(path: str, payload: object) -> None:
    write_atomically(path, json.dumps(payload, indent=2, sort_keys=True) + "\n")


def prepare_folder(folder: str, overwrite: bool) -> None:
    """An empty folder: FileExistsError if it holds something and may not be overwritten."""
    if os.path.isdir(folder) and os.listdir(folder):
        if not overwrite:
            raise FileExistsError(f"{folder} is not empty")
        for name in os.listdir(folder):
            path = os.path.join(folder, name)
            shutil.rmtree(path) if os.path.isdir(path) and not os.path.islink(path) else os.remove(path)
    os.makedirs(folder, exist_ok=True)


def write_table(df: DataFrame, path: str, partition_by: Iterable[str] = ()) -> str:
    writer = df.write.mode("errorifexists")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return path


def write_manifest(folder: str, tables: dict[str, str], described: dict, interactions: DataFrame, counts: dict[str, int]) -> str:
    """Writes the manifest of a processed data set and returns its path; counts come from one aggregation."""
    s = ops.summary(interactions).first()
    payload = {
        "manifest_version": "v1",
        "kind": "processed_dataset_manifest",
        **described,
        "counts": {"interactions": s["interactions"], "users": s["users"], "rated_items": s["rated_items"], **counts},
        "rating_range": {"min": s["rating_min"], "max": s["rating_max"]},
        "artifacts": tables,
    }
    path = os.path.join(folder, f"{described['dataset_short_name']}_processed_manifest.json")
    write_atomically(path, json.dumps(payload, indent=2))
    return path


def read_json(path: str) -> dict:
    """A JSON object; ValueError for another kind of document."""
    with open(path, encoding="utf-8") as file:
        payload = json.load(file)
    if not isinstance(payload, dict):
        raise ValueError(f"{path} holds no JSON object")
    return payload


def load_ratings(spark: SparkSession, manifest: str) -> Ratings:
    """The interactions that a manifest names, of the four columns that models read. A table without ``row_id`` gets
    one in the order of its files."""
    m = read_json(manifest)
    table = spark.read.parquet(m["artifacts"]["interactions"])
    if "row_id" not in table.columns:
        table = table.withColumn("row_id", F.monotonically_increasing_id())
    return Ratings(table.select(*COLUMNS), m["counts"]["users"], m["counts"]["rated_items"], m["rating_range"]["min"], m["rating_range"]["max"], m["dataset_short_name"])


def load_table(spark: SparkSession, manifest: str, name: str, columns: list[str] | None = None) -> DataFrame:
    table = spark.read.parquet(read_json(manifest)["artifacts"][name])
    return table.select(*columns) if columns else table
