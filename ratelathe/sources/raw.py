"""Readers of raw rating dumps in four layouts, with pinned types and strict checks.

Layouts are told by their file names; the first whose files are all there counts. Paths may lie in any file system that
Spark can read. A scan stays lazy, and a malformed row fails the query that reads it (mode FAILFAST).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The files of each layout and their fields.
LAYOUTS = {
    "modern_csv": {"ratings": "ratings.csv", "movies": "movies.csv", "links": "links.csv", "tags": "tags.csv"},
    "legacy_100k": {"ratings": "u.data", "movies": "u.item", "genres": "u.genre"},
    "legacy_1m": {"ratings": "ratings.dat", "movies": "movies.dat", "users": "users.dat"},
    "legacy_10m": {"ratings": "ratings.dat", "movies": "movies.dat", "tags": "tags.dat"},
}
HEADERS = {
    "ratings": ["userId", "movieId", "rating", "timestamp"],
    "movies": ["movieId", "title", "genres"],
    "links": ["movieId", "imdbId", "tmdbId"],
    "tags": ["userId", "movieId", "tag", "timestamp"],
    "users": ["userId", "gender", "age", "occupation", "zipCode"],
}
NO_GENRES = "(no genres listed)"
TYPES = {"userId": "int", "movieId": "int", "rating": "double", "timestamp": "bigint", "age": "int", "occupation": "int"}
DIM_SCHEMAS = {
    "links": "raw_item_id int, item_idx int, imdb_id string, tmdb_id string",
    "tags": "raw_user_id int, user_idx int, raw_item_id int, item_idx int, tag string, timestamp bigint",
}


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a file is there, in the file system that its path names."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)


def detect_layout(spark: SparkSession, folder: str) -> str:
    """The first layout all of whose files are in the folder; FileNotFoundError if none."""
    for layout, files in LAYOUTS.items():
        if all(exists(spark, f"{folder}/{name}") for name in files.values()):
            return layout
    raise FileNotFoundError(f"no known layout of rating files in {folder}")


def required(spark: SparkSession, folder: str, name: str) -> str:
    path = f"{folder}/{name}"
    if not exists(spark, path):
        raise FileNotFoundError(f"missing rating file: {path}")
    return path


def line_count(spark: SparkSession, path: str, header: bool = False) -> int:
    """Lines that are not empty (white space counts as content), less one a file for a header, at least 0."""
    lines = spark.read.text(path).filter(F.col("value") != "").select(F.input_file_name().alias("file"))
    n, files = lines.agg(F.count("*"), F.countDistinct("file")).first()
    return n - files * header


def check_header(spark: SparkSession, path: str, expected: list[str]) -> None:
    first = spark.read.text(path).first()
    found = [x.strip('"') for x in (first["value"].rstrip("\r") if first else "").split(",")]
    if found != expected:
        raise ValueError(f"unexpected header in {path}: expected {expected}, got {found}")


def validate_folder(spark: SparkSession, folder: str, layout: str = "auto") -> dict:
    """``raw_dir, format_family, counts`` after checks of files and headers; counts are of non-empty lines."""
    layout = detect_layout(spark, folder) if layout == "auto" else layout
    if layout not in LAYOUTS:
        raise ValueError(f"unsupported format_family: {layout}")
    counts: dict[str, int] = {}
    for kind, name in LAYOUTS[layout].items():
        path = required(spark, folder, name)
        if layout == "modern_csv":
            check_header(spark, path, HEADERS[kind])
        counts[kind] = len(read_genres(spark, folder)) if kind == "genres" else line_count(spark, path, layout == "modern_csv")
    return {"raw_dir": folder, "format_family": layout, "counts": {"links": 0, "tags": 0} | counts}


def _schema(fields: list[str]) -> str:
    return ", ".join(f"{f} {TYPES.get(f, 'string')}" for f in fields)


def read_delimited(spark: SparkSession, path: str, fields: list[str], sep: str = ",", header: bool = True, encoding: str = "UTF-8") -> DataFrame:
    """Typed rows of a delimited file, quotes doubled inside quotes; a wrong header or a malformed row fails. An empty
    text field is an empty text (Spark's reader gives null for it, quoted or not)."""
    options = {"sep": sep, "header": header, "mode": "FAILFAST", "enforceSchema": False, "encoding": encoding, "escape": '"', "quote": '"' if sep == "," else "", "emptyValue": "", "nullValue": "\u0000"}
    df = spark.read.options(**options).schema(_schema(fields)).csv(path)
    return df.select(*[F.coalesce(c, F.lit("")).alias(c) if kind == "string" else c for c, kind in df.dtypes])


def read_double_colon(spark: SparkSession, path: str, fields: list[str], encoding: str = "ISO-8859-1") -> DataFrame:
    """Typed rows of a ``::`` file; blank lines are skipped, a row of another width fails."""
    return read_delimited(spark, path, fields, sep="::", header=False, encoding=encoding)


def read_genres(spark: SparkSession, folder: str) -> list[str]:
    """The genre names of a ``name|id`` file in its order; other lines are skipped, none at all is an error."""
    path = required(spark, folder, LAYOUTS["legacy_100k"]["genres"])
    parts = F.split(F.trim("value"), r"\|")
    # Bounded by the number of flag columns that a movie row has.
    rows = spark.read.text(path).filter(F.size(parts) == 2).select(F.trim(parts[0]).alias("name")).filter("name <> ''").collect()
    if not rows:
        raise ValueError(f"no genres in {path}")
    return [r["name"] for r in rows]


def genres_of_flags(flags: Column, names: list[str]) -> Column:
    """The names whose flag is ``1``, joined by ``|``; ``(no genres listed)`` for none."""
    pairs = F.arrays_zip(flags.alias("flag"), F.array(*map(F.lit, names)).alias("name"))
    active = F.transform(F.filter(pairs, lambda p: p["flag"] == "1"), lambda p: p["name"])
    return F.when(F.size(active) == 0, F.lit(NO_GENRES)).otherwise(F.array_join(active, "|"))


def read_ratings(spark: SparkSession, folder: str, layout: str = "auto", rating_type: str = "float") -> DataFrame:
    """``raw_user_id, raw_item_id, rating, timestamp`` in any layout; ``rating_type`` is float or double."""
    if rating_type not in ("float", "double"):
        raise ValueError(f"rating type must be float or double, not {rating_type}")
    layout = detect_layout(spark, folder) if layout == "auto" else layout
    path = required(spark, folder, LAYOUTS[layout]["ratings"])
    fields = HEADERS["ratings"]
    if layout == "modern_csv":
        df = read_delimited(spark, path, fields)
    elif layout == "legacy_100k":
        df = read_delimited(spark, path, fields, sep="\t", header=False)
    else:
        df = read_double_colon(spark, path, fields)
    return df.select(F.col("userId").alias("raw_user_id"), F.col("movieId").alias("raw_item_id"), F.col("rating").cast(rating_type).alias("rating"), "timestamp")


def read_movies(spark: SparkSession, folder: str, layout: str) -> DataFrame:
    """``raw_item_id, title, genres`` in any layout."""
    path = required(spark, folder, LAYOUTS[layout]["movies"])
    if layout == "legacy_100k":
        names = read_genres(spark, folder)
        lines = spark.read.options(sep="|", quote='"', encoding="ISO-8859-1", mode="FAILFAST", nullValue="\u0000", emptyValue="").schema(", ".join(f"c{k} string" for k in range(5 + len(names)))).csv(path)
        flags = F.array(*[F.col(f"c{k}") for k in range(5, 5 + len(names))])
        return lines.select(F.col("c0").cast("int").alias("raw_item_id"), F.coalesce("c1", F.lit("")).alias("title"), genres_of_flags(flags, names).alias("genres"))
    fields = HEADERS["movies"]
    df = read_delimited(spark, path, fields) if layout == "modern_csv" else read_double_colon(spark, path, fields)
    return df.select(F.col("movieId").alias("raw_item_id"), "title", "genres")


def read_links(spark: SparkSession, folder: str, layout: str) -> DataFrame:
    """``raw_item_id, imdb_id, tmdb_id``; empty ids are null. No rows in layouts without links."""
    if layout != "modern_csv":
        return spark.createDataFrame([], "raw_item_id int, imdb_id string, tmdb_id string")
    df = read_delimited(spark, required(spark, folder, LAYOUTS[layout]["links"]), HEADERS["links"])
    return df.select(F.col("movieId").alias("raw_item_id"), F.nullif("imdbId", F.lit("")).alias("imdb_id"), F.nullif("tmdbId", F.lit("")).alias("tmdb_id"))


def read_tags(spark: SparkSession, folder: str, layout: str) -> DataFrame:
    """``raw_user_id, raw_item_id, tag, timestamp``. No rows in layouts without tags."""
    if layout not in ("modern_csv", "legacy_10m"):
        return spark.createDataFrame([], "raw_user_id int, raw_item_id int, tag string, timestamp bigint")
    path, fields = required(spark, folder, LAYOUTS[layout]["tags"]), HEADERS["tags"]
    df = read_delimited(spark, path, fields) if layout == "modern_csv" else read_double_colon(spark, path, fields, "UTF-8")
    return df.select(F.col("userId").alias("raw_user_id"), F.col("movieId").alias("raw_item_id"), "tag", "timestamp")


def read_folds(spark: SparkSession, folder: str) -> DataFrame | None:
    """``fold, part`` (train or test) and the rating fields of the files u1.base, u1.test ... u5.test; None unless all ten are there."""
    paths = {(k, part): f"{folder}/u{k}.{suffix}" for k in range(1, 6) for part, suffix in (("train", "base"), ("test", "test"))}
    if not all(exists(spark, p) for p in paths.values()):
        return None
    found = None
    for (fold, part), path in paths.items():
        df = read_delimited(spark, path, HEADERS["ratings"], sep="\t", header=False, encoding="ISO-8859-1")
        df = df.select(F.lit(fold).alias("fold"), F.lit(part).alias("part"), F.col("userId").alias("raw_user_id"), F.col("movieId").alias("raw_item_id"), "rating", "timestamp")
        found = df if found is None else found.unionByName(df)
    return found
