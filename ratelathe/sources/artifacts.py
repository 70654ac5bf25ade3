"""Folders of run artifacts: reserving, writing, scanning, and rendering tables."""

from __future__ import annotations

import csv
import io
import os
from datetime import datetime, timezone

import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ratelathe.functions.scalars import stamp_after


def read_yaml(path: str) -> dict:
    """A YAML mapping; ValueError for another kind of document."""
    with open(path, encoding="utf-8") as file:
        payload = yaml.safe_load(file)
    if not isinstance(payload, dict):
        raise ValueError(f"{path} holds no YAML mapping")
    return payload


def write_yaml(path: str, payload: dict) -> None:
    with open(path, "w", encoding="utf-8") as file:
        yaml.safe_dump(payload, file, sort_keys=False, allow_unicode=True)


def write_log(path: str, lines: list[str]) -> None:
    with open(path, "w", encoding="utf-8") as file:
        file.write("".join(f"{x}\n" for x in lines))


def reserve_folder(parent: str, slug: str, now: datetime | None = None) -> str:
    """A new folder named by time and slug; one second later for each that is taken."""
    now = now or datetime.now(timezone.utc)
    os.makedirs(parent, exist_ok=True)
    seconds = 0
    while True:
        folder = os.path.join(parent, f"{stamp_after(now, seconds)}_{slug}")
        try:
            os.mkdir(folder)
            return folder
        except FileExistsError:
            seconds += 1


def scan_documents(spark: SparkSession, runs: str, name: str) -> DataFrame:
    """``run_dir, document`` (JSON text) of each run folder's file of this name. A run without it has no row."""
    files = spark.read.options(recursiveFileLookup=True, pathGlobFilter=name).text(runs, wholetext=True)
    return files.select(F.element_at(F.split(F.input_file_name(), "/"), -2).alias("run_dir"), F.col("value").alias("document"))


def render_markdown(columns: list[str], rows: list[list[str]]) -> str:
    line = lambda cells: "| " + " | ".join(cells) + " |"
    return "\n".join([line(columns), line(["---"] * len(columns)), *map(line, rows)]) + "\n"


def render_csv(columns: list[str], rows: list[list]) -> str:
    out = io.StringIO()
    writer = csv.writer(out, lineterminator="\n")
    writer.writerow(columns)
    writer.writerows([["" if x is None else x for x in row] for row in rows])
    return out.getvalue()
