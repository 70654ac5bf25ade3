"""Lines of rating exports, loaded strictly, and those that cannot be loaded with the reason.

The strict load keeps the lines that conform to their file's grammar, with each line's offset (``line_id``). What
remains is the anti-join of all offsets with the loaded ones, and only these lines are diagnosed.

Grammar. One trailing carriage return is not part of a line. In ``.csv``, fields are parted by commas and may stand in
double quotes, in which a quote is written twice; a quote anywhere else breaks the line. In ``.dat``, fields are parted
by ``::`` and quotes are ordinary characters. A rating has a user id, a movie id (positive whole numbers in plain
digits), a rating among 0.5, 1, 1.5 ... 5 (a whole one with or without ``.0``) and a timestamp in plain digits. A movie
has such an id, a title that is not blank, and genres that may be empty. Ids and timestamps beyond the
range of bigint do not fit the typed record; they are null in it although the line conforms.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kind and form of each file.
FILES = {"ratings.csv": ("ratings", "csv"), "movies.csv": ("movies", "csv"), "ratings.dat": ("ratings", "dat"), "movies.dat": ("movies", "dat")}
FIELDS = {"ratings": 4, "movies": 3}
POSITIVE, DIGITS, STARS = r"\A0*[1-9][0-9]*\z", r"\A[0-9]+\z", r"\A(0\.5|[1-4](\.[05])?|5(\.0)?)\z"
NOT_BLANK = r"(?U)\S"
FIELD = r'(?:"(?:[^"]++|"")*+"|[^",]*+)'


def _split(lines: DataFrame) -> DataFrame:
    """Adds ``kind``, ``form``, ``quoting`` (whether quotes stand where they may) and ``f``, the fields."""
    names = F.create_map(*[F.lit(x) for name, (kind, form) in FILES.items() for x in (name, f"{kind} {form}")])
    parts = F.split(names[F.col("file_name")], " ")
    df = lines.select("line_id", "file_name", "line_text", F.regexp_replace("line_text", "\r\\z", "").alias("line"), parts[0].alias("kind"), parts[1].alias("form"))
    csv = F.col("form") == "csv"
    df = df.withColumn("quoting", ~csv | F.col("line").rlike(rf"\A{FIELD}(?:,{FIELD})*+\z"))
    # With a comma put before the line, every field follows one, an empty first field too.
    raw = F.regexp_extract_all(F.concat(F.lit(","), "line"), F.lit(f",({FIELD})"), 1)
    bare = F.transform(raw, lambda x: F.when(x.startswith('"'), F.replace(F.substring(x, F.lit(2), F.length(x) - 2), F.lit('""'), F.lit('"'))).otherwise(x))
    return df.withColumn("f", F.when(csv & F.col("quoting"), bare).when(~csv, F.split("line", "::", -1)))


def _at(k: int) -> Column:
    return F.get("f", F.lit(k))


def _ok(kind: str) -> Column:
    right = F.col("quoting") & (F.col("kind") == kind) & (F.size("f") == FIELDS[kind]) & _at(0).rlike(POSITIVE)
    if kind == "ratings":
        return right & _at(1).rlike(POSITIVE) & _at(2).rlike(STARS) & _at(3).rlike(DIGITS)
    return right & _at(1).rlike(NOT_BLANK)


def loaded(lines: DataFrame) -> DataFrame:
    """The lines that conform, as ``line_id, kind`` and the typed fields of either kind: ``raw_user_id, raw_item_id``
    (bigint), ``rating`` (double), ``ts`` (bigint) and ``title, genres`` (string)."""
    whole = lambda x: x.try_cast("bigint")
    rating = F.col("kind") == "ratings"
    return (
        _split(lines)
        .filter(_ok("ratings") | _ok("movies"))
        .select(
            "line_id",
            "kind",
            F.when(rating, whole(_at(0))).alias("raw_user_id"),
            whole(F.when(rating, _at(1)).otherwise(_at(0))).alias("raw_item_id"),
            F.when(rating, _at(2).try_cast("double")).alias("rating"),
            F.when(rating, whole(_at(3))).alias("ts"),
            F.when(~rating, _at(1)).alias("title"),
            F.when(~rating, _at(2)).alias("genres"),
        )
    )


def rating_records(lines: DataFrame) -> DataFrame:
    """The loaded ratings: ``line_id, raw_user_id, raw_item_id, rating, ts``."""
    return loaded(lines).filter("kind = 'ratings'").select("line_id", "raw_user_id", "raw_item_id", "rating", "ts")


def movie_records(lines: DataFrame) -> DataFrame:
    """The loaded movies: ``line_id, raw_item_id, title, genres``."""
    return loaded(lines).filter("kind = 'movies'").select("line_id", "raw_item_id", "title", "genres")


def rejected(lines: DataFrame) -> DataFrame:
    """``line_id, file_name, line_text, reason`` of every line that cannot be loaded, a null one included. The reason
    is the first that holds of: unknown file, missing line, blank line, broken quoting, wrong column count, and an
    invalid user id, movie id, rating, timestamp or title. ``line_id`` must be unique and not null, as offsets are."""
    rest = lines.join(loaded(lines).select("line_id"), "line_id", "left_anti")
    rating = F.col("kind") == "ratings"
    bad = lambda k, pattern: ~F.coalesce(_at(k).rlike(pattern), F.lit(False))
    reason = (
        F.when(F.col("kind").isNull(), "unknown file")
        .when(F.col("line").isNull(), "missing line")
        .when(~F.col("line").rlike(NOT_BLANK), "blank line")
        .when(~F.col("quoting"), "broken quoting")
        .when(F.size("f") != F.when(rating, FIELDS["ratings"]).otherwise(FIELDS["movies"]), "wrong column count")
        .when(rating & bad(0, POSITIVE), "invalid user id")
        .when(bad(0, POSITIVE) & ~rating | rating & bad(1, POSITIVE), "invalid movie id")
        .when(rating & bad(2, STARS), "invalid rating")
        .when(rating & bad(3, DIGITS), "invalid timestamp")
        .otherwise("blank title")
    )
    return _split(rest).select("line_id", "file_name", "line_text", reason.alias("reason"))
