"""From raw rating files to processed tables."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ratelathe.operators import interactions as ops
from ratelathe.operators import splits
from ratelathe.session import cut
from ratelathe.sources import artifacts, processed, raw


def prepare_dataset(spark: SparkSession, raw_dir: str, output_dir: str, *, dataset_name: str, dataset_short_name: str, split_family: str, preprocessing_family: str = "explicit_v1", dtype: str = "float32", format_family: str = "auto", source_manifest_path: str | None = None, overwrite: bool = False) -> str:
    """Reads a raw folder of any layout and writes the interactions, both id mappings and the three dimension tables,
    the rows of official folds if their files are there, and a manifest, whose path it returns. ValueError for no
    ratings, FileExistsError for a folder in use."""
    if dtype not in ("float32", "float64"):
        raise ValueError(f"dtype must be float32 or float64, not {dtype}")
    checked = raw.validate_folder(spark, raw_dir, format_family)
    layout = checked["format_family"]
    processed.prepare_folder(output_dir, overwrite)
    ratings = raw.read_ratings(spark, raw_dir, layout, "float" if dtype == "float32" else "double")
    # The order of the files' lines, which row ids keep.
    ratings = cut(ratings.withColumn("row_id", F.monotonically_increasing_id()))
    if ratings.limit(1).count() == 0:
        raise ValueError(f"no ratings in {raw_dir}")
    numbered = ops.with_row_ids(ratings.withColumnRenamed("row_id", "line"), ["line"]).drop("line")
    users, items = cut(ops.id_mapping(numbered, "raw_user_id", "user_idx")), cut(ops.id_mapping(numbered, "raw_item_id", "item_idx"))
    tags = ops.with_index(ops.with_index(raw.read_tags(spark, raw_dir, layout), users, "raw_user_id", "user_idx"), items, "raw_item_id", "item_idx")
    tables = {
        "interactions": ops.build_interactions(numbered, users, items),
        "user_mapping": users,
        "item_mapping": items,
        "movies": ops.with_index(raw.read_movies(spark, raw_dir, layout), items, "raw_item_id", "item_idx"),
        "links": ops.with_index(raw.read_links(spark, raw_dir, layout), items, "raw_item_id", "item_idx"),
        "tags": tags,
    }
    paths = {name: processed.write_table(df, os.path.join(output_dir, f"{dataset_short_name}_{name}.parquet")) for name, df in tables.items()}
    written = spark.read.parquet(paths["interactions"])
    folds = raw.read_folds(spark, raw_dir) if dataset_short_name == "ml100k" and layout == "legacy_100k" else None
    if folds is not None:
        ids = splits.fold_row_ids(written, folds)
        paths["official_folds"] = processed.write_table(ids, os.path.join(output_dir, f"{dataset_short_name}_paper_faithful_row_ids.parquet"), ["fold"])
    described = {
        "dataset_name": dataset_name,
        "dataset_short_name": dataset_short_name,
        "split_family": split_family,
        "preprocessing_family": preprocessing_family,
        "dtype": dtype,
        "source": {"raw_dir": raw_dir, "raw_manifest_path": source_manifest_path, "format_family": layout},
        "validation": checked,
    }
    counts = {name: spark.read.parquet(paths[table]).count() for name, table in (("catalog_items", "movies"), ("tags", "tags"), ("links", "links"))}
    return processed.write_manifest(output_dir, paths, described, written, counts)


def prepare_from_config(spark: SparkSession, config_path: str, dtype: str = "float32", overwrite: bool = False) -> str:
    """The same from a YAML file with dataset (name, short_name, format_family), paths (raw_dir, processed_dir) and split (family)."""
    c = artifacts.read_yaml(config_path)
    d, p = c["dataset"], c["paths"]
    return prepare_dataset(spark, p["raw_dir"], p["processed_dir"], dataset_name=d["name"], dataset_short_name=d["short_name"], format_family=d.get("format_family", "auto"), split_family=c.get("split", {}).get("family", "benchmark_random_v1"), preprocessing_family=d.get("preprocessing_family", "explicit_v1"), source_manifest_path=p.get("source_manifest"), dtype=dtype, overwrite=overwrite)
