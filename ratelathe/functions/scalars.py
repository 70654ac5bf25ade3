"""Scalar functions: limits, text, JSON paths, lenient parsing, names."""

from __future__ import annotations

import hashlib
import os
import re
from datetime import datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F


def clipped(x: Column, low: Column, high: Column) -> Column:
    """x within [low, high]; null stays null."""
    return F.when(x.isNotNull(), F.greatest(low, F.least(high, x)))


def below(x: Column, low: Column) -> Column:
    return x < low


def above(x: Column, high: Column) -> Column:
    return x > high


def outside(x: Column, low: Column, high: Column) -> Column:
    return below(x, low) | above(x, high)


def empty_to_null(x: Column) -> Column:
    return F.nullif(x, F.lit(""))


def json_at(document: Column, path: str) -> Column:
    """The value at a dotted path as text; null where the path ends early."""
    return F.get_json_object(document, "$." + path)


def split_metric(document: Column, split: str, name: str) -> Column:
    """A metric of a split: nested under the split, else flat with the split as prefix."""
    return F.coalesce(json_at(document, f"metrics.{split}.{name}"), json_at(document, f"metrics.{split}_{name}"))


def preferred_metric(document: Column, name: str) -> Column:
    return F.coalesce(split_metric(document, "test", name), split_metric(document, "validation", name))


def first_nonzero(*xs: Column) -> Column:
    """The first number that is neither null nor 0, else the last one: zeros give way to what comes after."""
    return F.coalesce(*[F.nullif(x, F.lit(0.0)) for x in xs[:-1]], xs[-1])


def lenient_number(x: Column) -> Column:
    """Text as double; null for true, false, empty or other text."""
    return F.when(~F.lower(x).isin("true", "false", ""), x.try_cast("double"))


def lenient_bool(x: Column) -> Column:
    """true and false as boolean; null for anything else."""
    return F.when(x == "true", True).when(x == "false", False)


def cell(x: Column, kind: str) -> Column:
    """A table cell: null is empty, a boolean true or false, a double has six decimals."""
    text = F.format_string("%.6f", x) if kind in ("double", "float") else x.cast("string")
    return F.when(x.isNull(), F.lit("")).otherwise(text)


def seed_slug(seed: Column) -> Column:
    return F.format_string("s%03d", seed)


def percent(x: Column) -> Column:
    """A share as whole percent, halves to even."""
    return F.bround(x * 100, 0).cast("int")


def utc_stamp(seconds: Column) -> Column:
    """Epoch seconds as 2026-01-31T235959Z, for a session in UTC."""
    return F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd'T'HHmmss'Z'")


def stamp_after(start: datetime, seconds: int) -> str:
    return (start + timedelta(seconds=seconds)).strftime("%Y-%m-%dT%H%M%SZ")


def candidate_file(name: str, index: int) -> str:
    """A candidate's file name: letters, digits, _ and - of its name; a digest if that is longer than 24 characters."""
    safe = re.sub(r"[^0-9A-Za-z_-]", "_", name)
    return f"{safe}.yaml" if len(safe) <= 24 else f"c{index:03d}_{hashlib.sha256(name.encode()).hexdigest()[:12]}.yaml"


def merged(base: dict, override: dict) -> dict:
    """Nested dicts merged; the override wins."""
    return base | {k: merged(base[k], v) if isinstance(v, dict) and isinstance(base.get(k), dict) else v for k, v in override.items()}


def relative_to(path: str, root: str) -> str:
    """A path as seen from root with forward slashes; as it is if it lies elsewhere."""
    absolute = os.path.abspath(path)
    inside = absolute == os.path.abspath(root) or absolute.startswith(os.path.abspath(root) + os.sep)
    return os.path.relpath(absolute, root).replace(os.sep, "/") if inside else absolute.replace(os.sep, "/")
