"""Queries of sources, sinks, records and reports, with their SQL counterparts.

Raw files in each of the known layouts are made from the tables, in the shared folder, and read back by the readers; what
comes out must be what the tables hold. Records and reports are made from the tables or from numbers in the same way.
"""

from __future__ import annotations

import json
import os
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ratelathe.functions import metrics, scalars, vectors
from ratelathe.models import config as cfg
from ratelathe.models import scoring
from ratelathe.operators import histories as hist
from ratelathe.operators import interactions as ops
from ratelathe.operators import splits
from ratelathe.operators.views import Ratings
from ratelathe.plans import prepare, reporting, studies
from ratelathe.queries import reference as ref
from ratelathe.session import cut, shared_dir
from ratelathe.sources import processed, raw

QUERIES: dict = {}
SQL: dict[str, str] = {}
QUOTES = {"header": True, "quote": '"', "escape": '"', "emptyValue": "", "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def query(sql: str):  # noqa: ANN201
    def register(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return register


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _text(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def _tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return {
        "ratings": ref.ratings(spark, sf_dir).select(F.col("raw_user_id").alias("userId"), F.col("raw_item_id").alias("movieId"), "rating", "timestamp"),
        "movies": read("movies").select(F.col("raw_item_id").alias("movieId"), _text("title").alias("title"), _text("genres").alias("genres")),
        "links": read("links").select(F.col("raw_item_id").alias("movieId"), _text("imdb_id").alias("imdbId"), _text("tmdb_id").alias("tmdbId")),
        "tags": read("tags").dropna(subset=["raw_user_id", "raw_item_id", "ts"]).select(F.col("raw_user_id").alias("userId"), F.col("raw_item_id").alias("movieId"), _text("tag").alias("tag"), F.col("ts").alias("timestamp")),
    }


def _lines(df: DataFrame, sep: str, path: str, encoding: str = "UTF-8") -> None:
    df.select(F.concat_ws(sep, *[F.col(c).cast("string") for c in df.columns]).alias("value")).write.option("encoding", encoding).text(path)


def modern(spark: SparkSession, sf_dir: str) -> str:
    folder = _folder(spark, "modern")
    for name, df in _tables(spark, sf_dir).items():
        df.write.options(**QUOTES).csv(f"{folder}/{name}.csv")
    return folder


def _plain_movies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tables(spark, sf_dir)["movies"].select("movieId", F.concat(F.lit("Movie é "), "movieId").alias("title"), "genres")


def legacy_100k(spark: SparkSession, sf_dir: str) -> str:
    folder = _folder(spark, "legacy-100k")
    _lines(_tables(spark, sf_dir)["ratings"], "\t", f"{folder}/u.data")
    # As many names as there are genres, 18.
    names = [r["genre_name"] for r in spark.read.parquet(f"{sf_dir}/genre_ref.parquet").orderBy("genre_id").collect()]
    _lines(spark.createDataFrame(list(zip(names, range(len(names)))), "name string, id int").coalesce(1), "|", f"{folder}/u.genre")
    held = F.split("genres", r"\|")
    flags = [F.array_contains(held, n).cast("int").alias(f"g{k}") for k, n in enumerate(names)]
    movies = _plain_movies(spark, sf_dir).select("movieId", "title", F.lit("").alias("date"), F.lit("").alias("video"), F.lit("").alias("url"), *flags)
    text = movies.select(F.concat_ws("|", *[F.col(c).cast("string") for c in movies.columns]).alias("value"))
    # Latin-1, as the files of this layout are.
    text.write.options(sep="\u0001", quote="", encoding="ISO-8859-1", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(f"{folder}/u.item")
    ratings = ref.ratings(spark, sf_dir)
    for fold in range(1, 6):
        for suffix, keep in (("base", F.col("row_id") % 5 != fold - 1), ("test", F.col("row_id") % 5 == fold - 1)):
            _lines(ratings.filter(keep).select("raw_user_id", "raw_item_id", "rating", "timestamp"), "\t", f"{folder}/u{fold}.{suffix}")
    return folder


def legacy_dat(spark: SparkSession, sf_dir: str) -> str:
    """The files of the two layouts with double colons together: with users.dat it is the older one."""
    folder, tables = _folder(spark, "legacy-dat"), _tables(spark, sf_dir)
    _lines(tables["ratings"], "::", f"{folder}/ratings.dat")
    _lines(_plain_movies(spark, sf_dir).withColumn("title", F.concat(F.lit("Movie "), "movieId")).withColumn("genres", F.translate("genres", ":", "")), "::", f"{folder}/movies.dat")
    _lines(tables["tags"], "::", f"{folder}/tags.dat")
    return folder


RATINGS = "SELECT raw_user_id, raw_item_id, rating, ts AS timestamp FROM ratings WHERE raw_user_id IS NOT NULL AND raw_item_id IS NOT NULL AND rating IS NOT NULL AND ts IS NOT NULL"
TAGS = "SELECT raw_user_id, raw_item_id, coalesce(tag, '') AS tag, ts AS timestamp FROM tags WHERE raw_user_id IS NOT NULL AND raw_item_id IS NOT NULL AND ts IS NOT NULL"


@query("SELECT * FROM (VALUES ('modern', 'modern_csv'), ('oldest', 'legacy_100k'), ('dat', 'legacy_10m')) v(folder, layout)")
def s1_layouts(spark, sf_dir):
    folders = {"modern": modern, "oldest": legacy_100k, "dat": legacy_dat}
    return spark.createDataFrame([(name, raw.detect_layout(spark, make(spark, sf_dir))) for name, make in folders.items()], "folder string, layout string")


@query(f"SELECT 'ratings' AS kind, count(*) AS n FROM ({RATINGS}) UNION ALL SELECT 'movies', count(*) FROM movies UNION ALL SELECT 'links', count(*) FROM links UNION ALL SELECT 'tags', count(*) FROM ({TAGS})")
def s2_line_counts(spark, sf_dir):
    counts = raw.validate_folder(spark, modern(spark, sf_dir))["counts"]
    return spark.createDataFrame(list(counts.items()), "kind string, n bigint")


@query("SELECT * FROM (VALUES ('ratings', false), ('movies', true)) v(kind, refused)")
def s4_headers(spark, sf_dir):
    folder, found = modern(spark, sf_dir), []
    for kind in ("ratings", "movies"):
        try:
            raw.check_header(spark, f"{folder}/{kind}.csv", raw.HEADERS["ratings"])
            found.append((kind, False))
        except ValueError:
            found.append((kind, True))
    return spark.createDataFrame(found, "kind string, refused boolean")


@query(RATINGS)
def s5_csv_ratings(spark, sf_dir):
    return raw.read_ratings(spark, modern(spark, sf_dir), rating_type="double")


@query("SELECT raw_item_id, coalesce(title, '') AS title, coalesce(genres, '') AS genres FROM movies")
def s5_csv_movies(spark, sf_dir):
    return raw.read_movies(spark, modern(spark, sf_dir), "modern_csv")


@query("SELECT raw_item_id, nullif(imdb_id, '') AS imdb_id, nullif(tmdb_id, '') AS tmdb_id FROM links")
def s5_csv_links(spark, sf_dir):
    return raw.read_links(spark, modern(spark, sf_dir), "modern_csv")


@query(TAGS)
def s5_csv_tags(spark, sf_dir):
    return raw.read_tags(spark, modern(spark, sf_dir), "modern_csv")


@query(RATINGS)
def s6_tsv_ratings(spark, sf_dir):
    return raw.read_ratings(spark, legacy_100k(spark, sf_dir), rating_type="double")


@query("""SELECT raw_item_id, 'Movie é ' || raw_item_id AS title, coalesce((SELECT string_agg(genre_name, '|' ORDER BY genre_id) FROM genre_ref WHERE list_contains(string_split(genres, '|'), genre_name)), '(no genres listed)') AS genres FROM movies""")
def s8_flagged_movies(spark, sf_dir):
    return raw.read_movies(spark, legacy_100k(spark, sf_dir), "legacy_100k")


@query("SELECT CAST(row_number() OVER (ORDER BY genre_id) - 1 AS INTEGER) AS place, genre_name AS name FROM genre_ref")
def s10_genres(spark, sf_dir):
    return spark.createDataFrame(list(enumerate(raw.read_genres(spark, legacy_100k(spark, sf_dir)))), "place int, name string")


@query(RATINGS)
def s7_dat_ratings(spark, sf_dir):
    return raw.read_ratings(spark, legacy_dat(spark, sf_dir), rating_type="double")


@query("SELECT raw_item_id, 'Movie ' || raw_item_id AS title, replace(coalesce(genres, ''), ':', '') AS genres FROM movies")
def s9_dat_movies(spark, sf_dir):
    return raw.read_movies(spark, legacy_dat(spark, sf_dir), "legacy_10m")


@query(TAGS)
def s9_dat_tags(spark, sf_dir):
    return raw.read_tags(spark, legacy_dat(spark, sf_dir), "legacy_10m")


@query(f"SELECT CAST(k AS INTEGER) AS fold, CASE WHEN row_id % 5 = k - 1 THEN 'test' ELSE 'train' END AS part, raw_user_id, raw_item_id, rating, ts AS timestamp FROM ratings, range(1, 6) f(k) WHERE {RATINGS.split('WHERE ')[1]}")
def s15_folds(spark, sf_dir):
    return raw.read_folds(spark, legacy_100k(spark, sf_dir))


def _prepared(spark: SparkSession, sf_dir: str) -> str:
    return prepare.prepare_dataset(spark, modern(spark, sf_dir), _folder(spark, "processed"), dataset_name="toy", dataset_short_name="toy", split_family="benchmark_random_v1", dtype="float64")


@query(ref.BASE + "SELECT user_idx, item_idx, rating FROM x")
def k1_interactions(spark, sf_dir):
    return processed.load_ratings(spark, _prepared(spark, sf_dir)).rows.select("user_idx", "item_idx", "rating")


@query(ref.BASE + "SELECT item_idx, raw_item_id FROM movies LEFT JOIN im USING (raw_item_id)")
def k1_movies(spark, sf_dir):
    return processed.load_table(spark, _prepared(spark, sf_dir), "movies", ["item_idx", "raw_item_id"])


@query(ref.BASE + f"SELECT user_idx, item_idx, tag FROM ({TAGS}) t LEFT JOIN um USING (raw_user_id) LEFT JOIN im USING (raw_item_id)")
def k1_tags(spark, sf_dir):
    return processed.load_table(spark, _prepared(spark, sf_dir), "tags", ["user_idx", "item_idx", "tag"])


@query(ref.BASE + f"""SELECT 'interactions' AS name, count(*)::DOUBLE AS value FROM x UNION ALL SELECT 'users', count(DISTINCT user_idx) FROM x UNION ALL SELECT 'rated_items', count(DISTINCT item_idx) FROM x
UNION ALL SELECT 'catalog_items', count(*) FROM movies UNION ALL SELECT 'tags', count(*) FROM ({TAGS}) UNION ALL SELECT 'links', count(*) FROM links UNION ALL SELECT 'min', min(rating) FROM x UNION ALL SELECT 'max', max(rating) FROM x""")
def k5_manifest(spark, sf_dir):
    m = processed.read_json(_prepared(spark, sf_dir))
    return spark.createDataFrame([(k, float(v)) for k, v in (m["counts"] | m["rating_range"]).items()], "name string, value double")


@query("SELECT true AS again, true AS kept, 1::BIGINT AS files")
def k4_overwrite_guard(spark, sf_dir):
    """A folder in use is refused and kept as it is; with leave to overwrite it is emptied; a file is replaced as a whole."""
    folder = _folder(spark, "guard")
    processed.prepare_folder(folder, False)
    processed.write_json(f"{folder}/a.json", {"a": 1})
    try:
        processed.prepare_folder(folder, False)
        kept = False
    except FileExistsError:
        kept = processed.read_json(f"{folder}/a.json") == {"a": 1}
    processed.prepare_folder(folder, True)
    again = not os.listdir(folder)
    processed.write_json(f"{folder}/b.json", {"b": 1})
    processed.write_json(f"{folder}/b.json", {"b": 2})
    return spark.createDataFrame([(again, kept, len(os.listdir(folder)))], "again boolean, kept boolean, files bigint")


@query(ref.SPLIT + "SELECT row_id FROM s WHERE split = 'train'")
def f3_training_rows(spark, sf_dir):
    d = ref.data(spark, sf_dir)
    return splits.as_parts(splits.split_rows(d.rows, 0.8, 0.1, ref.SEED), d)["train"].row_ids()


@query(ref.FOLDS + f""", t AS (SELECT row_id, row_number() OVER (ORDER BY md5('{ref.SEED}:' || g.row_id), g.row_id) - 1 AS pos, count(*) OVER () AS n, raw_user_id, raw_item_id FROM g WHERE fold = 2 AND part = 'train'),
c AS (SELECT row_id, pos < n - CAST(floor(n * 0.1) AS BIGINT) OR pos = min(pos) OVER (PARTITION BY raw_user_id) OR pos = min(pos) OVER (PARTITION BY raw_item_id) AS covered FROM t)
SELECT row_id, CASE WHEN covered THEN 'train' ELSE 'validation' END AS split FROM c UNION ALL SELECT row_id, 'test' FROM g WHERE fold = 2 AND part = 'test'""")
def sp5_inner_fold_split(spark, sf_dir):
    unique, records = ref._folds(spark, sf_dir)
    return splits.inner_fold_split(Ratings.of(unique), cut(splits.fold_row_ids(unique, records)), 2, 0.1, ref.SEED).select("row_id", "split")


@query("SELECT printf('benchmark_random_v1_tr080_va010_s%03d', seed) AS name, CAST(seed AS INTEGER) AS seed FROM range(1, 12) r(seed)")
def sp7_split_ids(spark, sf_dir):
    return spark.createDataFrame([(splits.split_id("benchmark_random_v1", s), s) for s in range(1, 12)], "name string, seed int")


@query(ref.BASE + "SELECT row_id, CASE WHEN user_idx % 3 = 0 THEN NULL ELSE rating END AS number, CASE WHEN user_idx % 3 = 1 THEN true WHEN user_idx % 3 = 2 THEN false END AS flag, rating AS deep FROM x")
def x7_json_paths(spark, sf_dir):
    d = ref.data(spark, sf_dir).rows
    third = F.col("user_idx") % 3
    document = F.to_json(F.struct(F.when(third == 0, "true").otherwise(F.col("rating").cast("string")).alias("n"), F.when(third == 1, "true").when(third == 2, "false").otherwise("yes").alias("b"), F.struct(F.struct(F.col("rating").alias("c")).alias("b")).alias("a")))
    at = lambda path: scalars.json_at(F.col("d"), path)
    return d.select("row_id", document.alias("d")).select("row_id", scalars.lenient_number(at("n")).alias("number"), scalars.lenient_bool(at("b")).alias("flag"), F.coalesce(scalars.lenient_number(at("a.b.c.d")), scalars.lenient_number(at("a.b.c"))).alias("deep"))


@query(ref.SPLIT + """, m AS (SELECT item_idx, avg(rating) AS p FROM s WHERE split = 'train' GROUP BY item_idx), err AS (SELECT split, round(sqrt(avg((p - rating) * (p - rating))), 6) AS rmse, round(avg(abs(p - rating)), 6) AS mae FROM s JOIN m USING (item_idx) GROUP BY split)
SELECT split || '_rmse' AS name, rmse AS value FROM err UNION ALL SELECT split || '_mae', mae FROM err""")
def a12_split_record(spark, sf_dir):
    s = cut(splits.split_rows(ref.data(spark, sf_dir).rows, 0.8, 0.1, ref.SEED))
    means = s.filter("split = 'train'").groupBy("item_idx").agg(F.avg("rating").alias("p"))
    record = metrics.per_split(s.join(means, "item_idx"), "rating", "p", 2.0, 4.0)
    return spark.createDataFrame([(f"{x}_{f}", round(record[x][f], 6)) for x in ("train", "validation", "test") for f in ("rmse", "mae")], "name string, value double")


def _f(number: int, k: int, of: str) -> str:
    return f"((({of}) * {7 + number} + {k * 3 + number}) % 11 - 5) / 13.0::DOUBLE"


_NORM = lambda number, of: "sqrt(" + " + ".join(f"power({_f(number, k, of)}, 2)" for k in range(ref.DIM)) + ")"


@query(ref.BASE + f"SELECT round(avg(n), 6) AS mean_norm FROM (SELECT {_NORM(2, 'user_idx')} AS n FROM um UNION ALL SELECT {_NORM(3, 'item_idx')} FROM im)")
def a18_factor_norms(spark, sf_dir):
    model = ref.given_model(spark, ref.data(spark, sf_dir), "biased_mf")
    return ref.rounded(vectors.mean_length(model.table("p", "id"), model.table("q", "id")))


_TOTALS = ", ".join(f"round(sum({_f(5, k, 'item_idx')}), 6)" for k in range(ref.DIM))


@query(ref.BASE + f"SELECT user_idx, [{_TOTALS}] AS total FROM h GROUP BY user_idx")
def j7_history_sums(spark, sf_dir):
    d = ref.data(spark, sf_dir)
    factors = ref.given_model(spark, d, "svdpp").table("y", "item_idx")
    return hist.gather(hist.history(d), factors).select("user_idx", F.transform("total", lambda v: F.round(v, 6)).alias("total"))


@query(f"WITH a AS ({ref._scored_sql('cb_svdpp', clip=False)}), b AS ({ref._scored_sql('cb_svdpp', 0.0, False)}) SELECT round(avg(abs(a.prediction - b.prediction)), 4) AS mean_shift, round(max(abs(a.prediction - b.prediction)), 4) AS max_shift, true AS measured FROM a JOIN b USING (row_id)")
def a20_cluster_contribution(spark, sf_dir):
    d = ref.data(spark, sf_dir)
    found = scoring.cluster_contribution(ref.given_model(spark, d, "cb_svdpp"), d.rows)
    return found.select(F.round("mean_abs_contribution", 4).alias("mean_shift"), F.round("max_abs_contribution", 4).alias("max_shift"), "measured")


@query(ref._scored_sql("cb_asvdpp", 0.0))
def m14_scores_without_clusters(spark, sf_dir):
    d = ref.data(spark, sf_dir)
    return ref.rounded(scoring.predict(scoring.without_clusters(ref.given_model(spark, d, "cb_asvdpp")), d.rows).select("row_id", "prediction"))


@query(f"SELECT round(prediction, 6) AS prediction FROM ({ref._scored_sql('svdpp')}) WHERE row_id = (SELECT min(row_id) FROM ratings WHERE {RATINGS.split('WHERE ')[1]})")
def m12_one_score(spark, sf_dir):
    d = ref.data(spark, sf_dir)
    first = d.rows.orderBy("row_id").first()
    return spark.createDataFrame([(round(scoring.predict_one(ref.given_model(spark, d, "svdpp"), first["user_idx"], first["item_idx"]), 6),)], "prediction double")


@query(ref.BASE + f"SELECT ((SELECT count(*) FROM um) * {1 + ref.DIM} + (SELECT count(*) FROM im) * {1 + 2 * ref.DIM}) * 4 AS bytes")
def a27_parameter_bytes(spark, sf_dir):
    return spark.createDataFrame([(scoring.parameter_bytes(ref.given_model(spark, ref.data(spark, sf_dir), "svdpp")),)], "bytes bigint")


@query("SELECT true AS same_in_any_order, false AS same_with_a_row_less")
def a22_fingerprint(spark, sf_dir):
    rows, columns = ref.data(spark, sf_dir).rows, ["row_id", "user_idx", "item_idx", "rating"]
    one = ops.fingerprint(rows, columns)
    other = ops.fingerprint(rows.repartition(7, "item_idx"), columns)
    return spark.createDataFrame([(one == other, one == ops.fingerprint(rows.filter(F.col("row_id") != rows.agg(F.min("row_id")).first()[0]), columns))], "same_in_any_order boolean, same_with_a_row_less boolean")


@query(ref.BASE + ", u AS (SELECT user_idx % 7 AS seed, avg(rating) AS v FROM x GROUP BY 1) SELECT count(*) AS count, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS std, round(median(v), 6) AS median, round(min(v), 6) AS min, round(max(v), 6) AS max, round(stddev_samp(v) / avg(v), 6) AS cv FROM u")
def a24_two_levels(spark, sf_dir):
    rows = ref.data(spark, sf_dir).rows.select((F.col("user_idx") % 7).alias("seed"), F.col("rating").alias("test_rmse"))
    return ref.rounded(studies.by_seed(rows))


def _runs(spark: SparkSession) -> str:
    """Thirty stored runs in the folders of a run each."""
    folder = _folder(spark, "runs")
    for k in range(30):
        run = f"{folder}/r{k:02d}"
        os.makedirs(run)
        processed.write_json(f"{run}/run_manifest.json", {"kind": "run_manifest", "run_id": f"r{k:02d}", "status": "completed", "generated_at_utc": f"2026-01-01T00:00:{k:02d}", "dataset": {"short_name": ("ml1m", "ml100k")[k % 2]}, "model": {"name": reporting.MODELS[k % 6]}})
        stages = [{"name": "main_training", "wall_clock_seconds": k + 0.5, "rss_end_mb": 100 + k}, {"name": "inference", "wall_clock_seconds": 1, "rss_end_mb": 90}]
        with open(f"{run}/metrics.json", "w", encoding="utf-8") as file:
            json.dump({"metrics": {"validation_rmse": 1 + k / 64, "test": {"rmse": 2 + k / 64}}, "profiling": {"stages": stages}, "cb_semantics": {"alpha": k / 32}}, file)
    return folder


@query("""SELECT CASE WHEN k % 2 = 0 THEN 'ml1m' ELSE 'ml100k' END AS dataset, ['biased_mf', 'svdpp', 'asymmetric_svd', 'asvdpp', 'cb_svdpp', 'cb_asvdpp'][k % 6 + 1] AS model, 1 + k / 64 AS validation_rmse, 2 + k / 64 AS test_rmse, k + 0.5::DOUBLE AS train_time, 100.0::DOUBLE + k AS peak_memory, k / 32 AS alpha, 'completed' AS status,
CAST(row_number() OVER (ORDER BY k % 2 = 0, k % 6) AS INTEGER) AS place FROM range(24, 30) r(k)""")
def j10_result_table(spark, sf_dir):
    table = reporting.result_table(spark, _runs(spark))
    rows = [(*r, n) for n, r in enumerate(table.select("dataset", "model", "validation_rmse", "test_rmse", "train_time", "peak_memory", "alpha", "status").collect(), 1)]
    return spark.createDataFrame(rows, "dataset string, model string, validation_rmse double, test_rmse double, train_time double, peak_memory double, alpha double, status string, place int")


@query("SELECT printf('r%02d', k) AS run_dir, k + 1.5::DOUBLE AS total_seconds, 100.0::DOUBLE + k AS peak_rss_mb FROM range(30) r(k)")
def a25_stage_totals(spark, sf_dir):
    return reporting.stage_totals(spark, _runs(spark))


@query("SELECT 'r07' AS run_id, 1 + 7 / 64 AS validation_rmse")
def j11_one_run(spark, sf_dir):
    found = reporting.find_run(reporting.result_rows(spark, _runs(spark)), run_id="r07", dataset="ml100k", model="svdpp")
    return spark.createDataFrame([(found["run_id"], found["validation_rmse"])], "run_id string, validation_rmse double")


@query("SELECT name, needs FROM (VALUES " + ", ".join(f"('{n}', '{'history ' * (n != 'biased_mf')}{'explicit ' * (n in ('asymmetric_svd', 'asvdpp', 'cb_asvdpp'))}{'clusters ' * ('cb' in n)}')" for n in cfg.PARTS) + ") v(name, needs)")
def r1_requirements(spark, sf_dir):
    rows = [(n, "".join(f"{x} " for x, on in (("history", r.history), ("explicit", r.explicit), ("clusters", r.clusters)) if on)) for n in cfg.PARTS for r in [cfg.requirements(n)]]
    return spark.createDataFrame(rows, "name string, needs string")
