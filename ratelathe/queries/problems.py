"""Queries of the general data-pipeline operators, with their SQL counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ratelathe.operators import lenient_load, sessions, skew

#: Seconds of inactivity that a session can hold, and the share of rows from which a key is overloaded.
SESSION_GAP, OVERLOAD_SHARE = 1_800, 0.02
GAPS = [600, SESSION_GAP, 7_200]


def _ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/ratings.parquet")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sessions.sessions(_ratings(spark, sf_dir), "raw_user_id", "ts", SESSION_GAP)
    return found.select(F.col("entity").alias("raw_user_id"), "session_start")


def p1_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.sessions(_ratings(spark, sf_dir), "raw_user_id", "ts", SESSION_GAP).withColumnRenamed("entity", "raw_user_id")


def p1_gap_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sessions.sessions_for_gaps(_ratings(spark, sf_dir), "raw_user_id", "ts", GAPS)
    return found.groupBy("gap").agg(F.count("*").alias("n_sessions"), F.sum("events").alias("n_events"), F.max("duration").alias("longest"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    ratings, found = _ratings(spark, sf_dir), None
    total = ratings.count()
    for field in ("raw_user_id", "raw_item_id"):
        keys = skew.overloaded_keys(skew.weigh(ratings, field, "rating"), total, OVERLOAD_SHARE)
        part = keys.select(F.lit(field).alias("field_name"), F.col("key").cast("long").alias("key_value"))
        found = part if found is None else found.unionByName(part)
    return found


def p5_user_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = skew.key_counts(skew.weigh(_ratings(spark, sf_dir), "raw_user_id", "raw_item_id"))
    return counts.select(F.col("key").alias("raw_user_id"), F.col("rows").alias("n_rows"), F.col("distinct_values").alias("n_movies"), F.col("mode_value").alias("most_rated_movie"))


def p5_movie_ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    weighted = skew.weigh(_ratings(spark, sf_dir), "raw_item_id", "rating")
    counts = skew.key_counts(weighted).select(F.col("key").alias("raw_item_id"), F.col("rows").alias("n_rows"), F.col("filled").alias("n_ratings"), F.col("mode_value").alias("mode_rating"))
    ranks = skew.key_percentiles(weighted, [0.25, 0.5, 0.9]).groupBy(F.col("key").alias("raw_item_id"))
    wide = ranks.agg(*[F.max(F.when(F.col("percent") == p, F.col("percentile"))).alias(name) for p, name in ((0.25, "p25"), (0.5, "p50"), (0.9, "p90"))])
    return counts.join(wide, "raw_item_id", "left")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lenient_load.rejected(spark.read.parquet(f"{sf_dir}/raw_lines.parquet")).select("line_id")


def p6_rejected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lenient_load.rejected(spark.read.parquet(f"{sf_dir}/raw_lines.parquet")).select("line_id", "reason")


def p6_ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lenient_load.rating_records(spark.read.parquet(f"{sf_dir}/raw_lines.parquet"))


def p6_movies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lenient_load.movie_records(spark.read.parquet(f"{sf_dir}/raw_lines.parquet"))


QUERIES = {f.__name__: f for f in (p1_found, p1_sessions, p1_gap_settings, p5_found, p5_user_counts, p5_movie_ratings, p6_found, p6_rejected, p6_ratings, p6_movies)}

_SESSIONS = """
SELECT raw_user_id, session_start, max(ts) AS session_end, max(ts) - session_start AS duration, count(*) AS events FROM (
  SELECT raw_user_id, ts, max(starts) OVER (PARTITION BY raw_user_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS session_start FROM (
    SELECT raw_user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w > {gap} THEN ts END AS starts
    FROM ratings WHERE raw_user_id IS NOT NULL AND ts IS NOT NULL WINDOW w AS (PARTITION BY raw_user_id ORDER BY ts)))
GROUP BY raw_user_id, session_start"""
_SUMMARY = "SELECT CAST({gap} AS BIGINT) AS gap, count(*) AS n_sessions, CAST(sum(events) AS BIGINT) AS n_events, max(duration) AS longest FROM ({sessions})"
_KEYS = "SELECT '{0}' AS field_name, CAST({0} AS BIGINT) AS key_value FROM ratings WHERE {0} IS NOT NULL GROUP BY {0} HAVING count(*) >= 0.02 * (SELECT count(*) FROM ratings)"

# The same grammar with DuckDB's functions: quoted fields are taken apart by a pattern for each file.
_ID, _NUM, _STARS = "0*[1-9][0-9]*", "[0-9]+", r"(?:0\.5|[1-4](?:\.[05])?|5(?:\.0)?)"


def _either(x: str) -> str:
    return f'(?:"({x})"|({x}))'


_CSV_RATING = "^" + ",".join(map(_either, (_ID, _ID, _STARS, _NUM))) + "$"
_DAT_RATING = "^" + "::".join(f"({x})" for x in (_ID, _ID, _STARS, _NUM)) + "$"
_CSV_MOVIE = "^" + _either(_ID) + ',(?:"((?:[^"]|"")*)"|([^",]*)),(?:"((?:[^"]|"")*)"|([^",]*))$'
_LINES = """
WITH l AS (SELECT line_id, file_name, line_text, regexp_replace(line_text, '\\r$', '') AS line FROM raw_lines),
r AS (SELECT line_id, m FROM (SELECT line_id, CASE WHEN file_name = 'ratings.csv' THEN regexp_extract(line, '{csv}', ['a','b','c','d','e','f','g','h'])
        WHEN file_name = 'ratings.dat' THEN struct_pack(a := regexp_extract(line, '{dat}', 1), b := '', c := regexp_extract(line, '{dat}', 2), d := '', e := regexp_extract(line, '{dat}', 3), f := '', g := regexp_extract(line, '{dat}', 4), h := '') END AS m
      FROM l WHERE file_name IN ('ratings.csv', 'ratings.dat')) WHERE m.a || m.b <> ''),
m AS (SELECT * FROM (SELECT line_id, CASE WHEN file_name = 'movies.csv' THEN m.a || m.b ELSE CASE WHEN len(d) = 3 AND regexp_full_match(d[1], '{id}') THEN d[1] ELSE '' END END AS id,
        CASE WHEN file_name = 'movies.csv' THEN CASE WHEN m.c <> '' THEN replace(m.c, '""', '"') ELSE m.d END ELSE d[2] END AS title,
        CASE WHEN file_name = 'movies.csv' THEN CASE WHEN m.e <> '' THEN replace(m.e, '""', '"') ELSE m.f END ELSE d[3] END AS genres
      FROM (SELECT line_id, file_name, regexp_extract(line, '{movie}', ['a','b','c','d','e','f']) AS m, string_split(line, '::') AS d FROM l WHERE file_name IN ('movies.csv', 'movies.dat')))
     WHERE id <> '' AND regexp_matches(title, '[^\\s\\x{{A0}}\\x{{2000}}-\\x{{200A}}\\x{{3000}}]'))
""".replace("{csv}", _CSV_RATING).replace("{dat}", _DAT_RATING).replace("{movie}", _CSV_MOVIE).replace("{id}", _ID).replace("{{", "{").replace("}}", "}")

# The first reason that holds, again with fields taken apart by DuckDB's functions.
_F = '(?:"(?:[^"]|"")*"|[^",]*)'
_REASONS = """
, s AS (SELECT line_id, file_name, line, file_name LIKE 'ratings.%' AS rating, CASE WHEN file_name LIKE '%.csv' THEN regexp_full_match(line, '{f}(?:,{f})*') ELSE true END AS quoting,
    CASE WHEN file_name LIKE '%.csv' THEN list_transform(regexp_extract_all(',' || line, ',({f})', 1), lambda x: CASE WHEN x LIKE '"%' THEN replace(substr(x, 2, len(x) - 2), '""', '"') ELSE x END) ELSE string_split(line, '::') END AS f FROM l)
SELECT line_id, CASE WHEN file_name IS NULL OR file_name NOT IN ('ratings.csv', 'movies.csv', 'ratings.dat', 'movies.dat') THEN 'unknown file' WHEN line IS NULL THEN 'missing line'
  WHEN NOT regexp_matches(line, '[^\\s\\x{A0}\\x{2000}-\\x{200A}\\x{3000}]') THEN 'blank line' WHEN NOT quoting THEN 'broken quoting' WHEN len(f) <> CASE WHEN rating THEN 4 ELSE 3 END THEN 'wrong column count'
  WHEN rating AND NOT regexp_full_match(f[1], '{id}') THEN 'invalid user id' WHEN NOT regexp_full_match(f[CASE WHEN rating THEN 2 ELSE 1 END], '{id}') THEN 'invalid movie id'
  WHEN rating AND NOT regexp_full_match(f[3], '{stars}') THEN 'invalid rating' WHEN rating AND NOT regexp_full_match(f[4], '{num}') THEN 'invalid timestamp' ELSE 'blank title' END AS reason
FROM s WHERE line_id NOT IN (SELECT line_id FROM r UNION ALL SELECT line_id FROM m)""".replace("{f}", _F).replace("{id}", _ID).replace("{stars}", _STARS).replace("{num}", _NUM)

SQL = {
    "p6_rejected": _LINES + _REASONS,
    "p1_found": f"SELECT raw_user_id, session_start FROM ({_SESSIONS.format(gap=SESSION_GAP)})",
    "p1_sessions": _SESSIONS.format(gap=SESSION_GAP),
    "p1_gap_settings": " UNION ALL ".join(_SUMMARY.format(gap=g, sessions=_SESSIONS.format(gap=g)) for g in GAPS),
    "p5_found": " UNION ALL ".join(_KEYS.format(f) for f in ("raw_user_id", "raw_item_id")),
    "p5_user_counts": """
WITH v AS (SELECT raw_user_id, raw_item_id, count(*) AS n FROM ratings GROUP BY ALL)
SELECT raw_user_id, CAST(sum(n) AS BIGINT) AS n_rows, count(raw_item_id) AS n_movies, (SELECT first(w.raw_item_id ORDER BY w.n DESC, w.raw_item_id) FROM v w
  WHERE w.raw_user_id IS NOT DISTINCT FROM v.raw_user_id AND w.raw_item_id IS NOT NULL) AS most_rated_movie FROM v GROUP BY raw_user_id""",
    "p5_movie_ratings": """
WITH v AS (SELECT raw_item_id, rating, count(*) AS n FROM ratings GROUP BY ALL),
m AS (SELECT raw_item_id, first(rating ORDER BY n DESC, rating) AS mode_rating FROM v WHERE rating IS NOT NULL GROUP BY raw_item_id)
SELECT raw_item_id, count(*) AS n_rows, count(rating) AS n_ratings, any_value(mode_rating) AS mode_rating,
  quantile_cont(rating, 0.25) AS p25, quantile_cont(rating, 0.5) AS p50, quantile_cont(rating, 0.9) AS p90
FROM ratings LEFT JOIN m USING (raw_item_id) GROUP BY raw_item_id""",
    "p6_found": _LINES + "SELECT line_id FROM l WHERE line_id NOT IN (SELECT line_id FROM r UNION ALL SELECT line_id FROM m)",
    "p6_ratings": _LINES + "SELECT line_id, TRY_CAST(m.a || m.b AS BIGINT) AS raw_user_id, TRY_CAST(m.c || m.d AS BIGINT) AS raw_item_id, CAST(m.e || m.f AS DOUBLE) AS rating, TRY_CAST(m.g || m.h AS BIGINT) AS ts FROM r",
    "p6_movies": _LINES + "SELECT line_id, TRY_CAST(id AS BIGINT) AS raw_item_id, title, genres FROM m",
}
