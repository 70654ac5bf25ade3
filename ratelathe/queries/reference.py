"""Queries of the rating-analytics operators over the ratings, movies, links and tags tables, with their SQL counterparts.

Fixed inputs stand in for what only a fit can make: clusters are assigned by id, and the parameters of the scoring
queries are small fractions (thirteenths, which no rounding ties) computed from part, id and place, so that SQL can state the same predictions.
"""

from __future__ import annotations

from dataclasses import replace
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ratelathe.functions import metrics, scalars
from ratelathe.models import config as cfg
from ratelathe.models import fit, scoring
from ratelathe.operators import clusters as cl
from ratelathe.operators import histories as hist
from ratelathe.operators import interactions as ops
from ratelathe.operators import splits
from ratelathe.operators.views import COLUMNS, Ratings, repeated_prefix, spread_sample
from ratelathe.plans import reporting, studies
from ratelathe.session import cut, packed, release

SEED, USER_CLUSTERS, ITEM_CLUSTERS, DIM, ALPHA = 7, 5, 6, 3, 0.25
#: Dimensions and epochs of a production fit.
FIT_DIM, FIT_EPOCHS = 50, 20
QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):  # noqa: ANN201
    def register(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


def ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/ratings.parquet").select("row_id", "raw_user_id", "raw_item_id", "rating", F.col("ts").alias("timestamp"))
    return df.dropna()


NAMES = {"raw_user_id": "user_idx", "raw_item_id": "item_idx"}


def mappings(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    (users, _), (items, _) = ops.id_mappings(df, NAMES)
    return users, items


def interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = ratings(spark, sf_dir)
    (users, n_users), (items, n_items) = ops.id_mappings(df, NAMES)
    return ops.build_interactions(df, users, items, (n_users, n_items))


def data(spark: SparkSession, sf_dir: str) -> Ratings:
    return Ratings.of(cut(interactions(spark, sf_dir).select("row_id", "user_idx", "item_idx", "rating")))


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    return df.select(*[F.round(c, places).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])


BASE = """
WITH r AS (SELECT row_id, raw_user_id, raw_item_id, rating, ts AS timestamp FROM ratings WHERE raw_user_id IS NOT NULL AND raw_item_id IS NOT NULL AND rating IS NOT NULL AND ts IS NOT NULL),
um AS (SELECT raw_user_id, CAST(row_number() OVER (ORDER BY raw_user_id) - 1 AS INTEGER) AS user_idx FROM (SELECT DISTINCT raw_user_id FROM r)),
im AS (SELECT raw_item_id, CAST(row_number() OVER (ORDER BY raw_item_id) - 1 AS INTEGER) AS item_idx FROM (SELECT DISTINCT raw_item_id FROM r)),
x AS (SELECT row_id, user_idx, item_idx, rating, timestamp, raw_user_id, raw_item_id FROM r JOIN um USING (raw_user_id) JOIN im USING (raw_item_id)),
h AS (SELECT DISTINCT user_idx, item_idx FROM x),
hn AS (SELECT user_idx, count(*) AS cnt, 1 / sqrt(count(*)) AS norm FROM h GROUP BY user_idx),
e AS (SELECT user_idx, item_idx, first(rating ORDER BY row_id) AS rating FROM x GROUP BY ALL)
"""


@query(BASE + "SELECT * FROM um")
def a2_user_mapping(spark, sf_dir):
    return ops.id_mapping(ratings(spark, sf_dir), "raw_user_id", "user_idx")


@query(BASE + "SELECT * FROM im")
def a2_item_mapping(spark, sf_dir):
    return ops.id_mapping(ratings(spark, sf_dir), "raw_item_id", "item_idx")


@query(BASE + "SELECT * FROM x")
def j1_interactions(spark, sf_dir):
    return interactions(spark, sf_dir)


@query(BASE + "SELECT m.raw_item_id, item_idx, title, genres FROM movies m LEFT JOIN im USING (raw_item_id)")
def j2_movies(spark, sf_dir):
    return ops.with_index(spark.read.parquet(f"{sf_dir}/movies.parquet"), mappings(ratings(spark, sf_dir))[1], "raw_item_id", "item_idx")


@query(BASE + "SELECT l.raw_item_id, item_idx, nullif(imdb_id, '') AS imdb_id, nullif(tmdb_id, '') AS tmdb_id FROM links l LEFT JOIN im USING (raw_item_id)")
def j2_links(spark, sf_dir):
    links = spark.read.parquet(f"{sf_dir}/links.parquet").withColumns({c: scalars.empty_to_null(F.col(c)) for c in ("imdb_id", "tmdb_id")})
    return ops.with_index(links, mappings(ratings(spark, sf_dir))[1], "raw_item_id", "item_idx")


@query(BASE + "SELECT tag_id, t.raw_user_id, user_idx, t.raw_item_id, item_idx, tag, ts FROM tags t LEFT JOIN um USING (raw_user_id) LEFT JOIN im USING (raw_item_id)")
def j2_tags(spark, sf_dir):
    users, items = mappings(ratings(spark, sf_dir))
    return ops.with_index(ops.with_index(spark.read.parquet(f"{sf_dir}/tags.parquet"), users, "raw_user_id", "user_idx"), items, "raw_item_id", "item_idx")


@query(BASE + "SELECT count(*) AS interactions, count(DISTINCT user_idx) AS users, count(DISTINCT item_idx) AS rated_items, min(rating) AS rating_min, max(rating) AS rating_max, avg(rating) AS rating_mean FROM x")
def a3_summary(spark, sf_dir):
    return ops.summary(interactions(spark, sf_dir))


@query(BASE + "SELECT sum(user_idx)::DOUBLE + sum(item_idx)::DOUBLE + sum(rating) AS checksum FROM x")
def a21_checksum(spark, sf_dir):
    return ops.checksum(interactions(spark, sf_dir))


@query(BASE + "SELECT row_id, user_idx, item_idx, rating FROM x WHERE row_id IN (SELECT min(row_id) FROM x GROUP BY user_idx, item_idx)")
def f1_subset(spark, sf_dir):
    d = data(spark, sf_dir)
    return d.subset(d.rows.groupBy("user_idx", "item_idx").agg(F.min("row_id").alias("row_id")), "first").rows.select("row_id", "user_idx", "item_idx", "rating")


@query(BASE + ", p AS (SELECT *, row_number() OVER (ORDER BY row_id) - 1 AS place, count(*) OVER () AS n FROM x) SELECT DISTINCT row_id, user_idx, item_idx, rating FROM p JOIN range(1000) k ON place = CASE WHEN n <= 1000 THEN place ELSE CAST(floor(k.range * ((n - 1)::DOUBLE / 999)) AS BIGINT) END")
def f10_spread_sample(spark, sf_dir):
    return spread_sample(data(spark, sf_dir).rows, ["row_id"], 1_000)


@query(BASE + "SELECT row_id, user_idx, item_idx, CAST(repeat AS INTEGER) AS repeat FROM (SELECT * FROM x ORDER BY user_idx, row_id LIMIT 500), (SELECT range AS repeat FROM range(3))")
def f11_repeated_prefix(spark, sf_dir):
    return repeated_prefix(data(spark, sf_dir).rows, 500, 3).select("row_id", "user_idx", "item_idx", "repeat")


@query(BASE + "SELECT row_id, greatest(1.0, least(4.5, rating)) AS clipped, rating < 1 AS below, rating > 4.5 AS above, rating < 1 OR rating > 4.5 AS outside, CAST(CAST(rating AS FLOAT) AS DOUBLE) AS as_float FROM x")
def f4_limits(spark, sf_dir):
    low, high, r = F.lit(1.0), F.lit(4.5), F.col("rating")
    return interactions(spark, sf_dir).select("row_id", scalars.clipped(r, low, high).alias("clipped"), scalars.below(r, low).alias("below"), scalars.above(r, high).alias("above"), scalars.outside(r, low, high).alias("outside"), r.cast("float").cast("double").alias("as_float"))


@query(BASE + "SELECT row_id, printf('%.6f', rating) AS cell, strftime(make_timestamp(timestamp * 1000000), '%Y-%m-%dT%H%M%SZ') AS stamp, printf('s%03d', user_idx) AS slug, CAST(round_even(rating / 8 * 100, 0) AS INTEGER) AS percent FROM x")
def x5_formats(spark, sf_dir):
    return interactions(spark, sf_dir).select("row_id", scalars.cell(F.col("rating"), "double").alias("cell"), scalars.utc_stamp(F.col("timestamp")).alias("stamp"), scalars.seed_slug(F.col("user_idx")).alias("slug"), scalars.percent(F.col("rating") / 8).alias("percent"))


@query(BASE + "SELECT user_idx, list(item_idx ORDER BY item_idx) AS items, count(*) AS cnt, 1 / sqrt(count(*)) AS norm FROM h GROUP BY user_idx")
def a4_history(spark, sf_dir):
    return hist.history(data(spark, sf_dir))


@query(BASE + "SELECT user_idx, item_idx, rating FROM e")
def a5_explicit_feedback(spark, sf_dir):
    return hist.explicit_feedback(data(spark, sf_dir)).select("user_idx", F.explode("feedback").alias("e")).select("user_idx", "e.*")


def given_clusters(spark, d: Ratings) -> tuple[DataFrame, DataFrame]:
    of = lambda n, key, k: spark.range(n).select(F.col("id").cast("int").alias(key), (F.col("id") % k).cast("int").alias("cluster_id"))
    return of(d.n_users, "user_idx", USER_CLUSTERS), of(d.n_items, "item_idx", ITEM_CLUSTERS)


COUNTS = f"SELECT user_idx, item_idx % {ITEM_CLUSTERS} AS cluster_id, count(*) AS cnt FROM h GROUP BY ALL"
GRID = f"""SELECT CAST(a.range AS INTEGER) AS user_cluster, CAST(b.range AS INTEGER) AS item_cluster, coalesce(avg(rating), 0) AS mean, count(rating) AS cnt
FROM range({USER_CLUSTERS}) a CROSS JOIN range({ITEM_CLUSTERS}) b LEFT JOIN x ON user_idx % {USER_CLUSTERS} = a.range AND item_idx % {ITEM_CLUSTERS} = b.range GROUP BY ALL"""


@query(BASE + COUNTS)
def a6_cluster_counts(spark, sf_dir):
    d = data(spark, sf_dir)
    return hist.cluster_counts(hist.history(d), given_clusters(spark, d)[1])


@query(BASE + GRID)
def a8_rating_grid(spark, sf_dir):
    d = data(spark, sf_dir)
    return cl.rating_grid(d, *given_clusters(spark, d), USER_CLUSTERS, ITEM_CLUSTERS)


SIZES = f"SELECT CAST(range AS INTEGER) AS cluster_id, count(item_idx) AS size FROM range({ITEM_CLUSTERS + 1}) LEFT JOIN im ON item_idx % {ITEM_CLUSTERS} = range GROUP BY range"


@query(BASE + SIZES)
def a9_cluster_sizes(spark, sf_dir):
    return cl.sizes(given_clusters(spark, data(spark, sf_dir))[1], ITEM_CLUSTERS + 1)


@query(BASE + "SELECT count(*) AS users_with_history, avg(cnt) AS mean_size, max(cnt) AS max_size FROM hn")
def a14_history_summary(spark, sf_dir):
    return hist.history_summary(hist.history(data(spark, sf_dir)))


@query(BASE + f"SELECT min(size) AS least, max(size) AS most, avg(size) AS mean, count(*) FILTER (size = 0) AS empty, count(*) FILTER (size <= 1) AS at_most_one, count(*) FILTER (size > 0) AS non_empty, avg(CASE WHEN size > 0 THEN 1 ELSE 0 END) AS coverage FROM ({SIZES})")
def a15_size_summary(spark, sf_dir):
    return cl.size_summary(a9_cluster_sizes(spark, sf_dir))


@query(BASE + f"SELECT count(*) FILTER (cnt > 0) AS filled_pairs, count(*) AS pairs, avg(CASE WHEN cnt > 0 THEN 1 ELSE 0 END) AS density, round(min(mean) FILTER (cnt > 0), 6) AS least_mean, round(max(mean) FILTER (cnt > 0), 6) AS most_mean FROM ({GRID})")
def a16_grid_summary(spark, sf_dir):
    return rounded(cl.grid_summary(a8_rating_grid(spark, sf_dir)))


@query(BASE + f"SELECT round(avg(n), 6) AS mean_active, max(n) AS max_active FROM (SELECT user_idx, count(*) AS n FROM ({COUNTS}) GROUP BY user_idx)")
def a17_active_clusters(spark, sf_dir):
    d = data(spark, sf_dir)
    return rounded(hist.active_clusters(hist.cluster_counts(hist.history(d), given_clusters(spark, d)[1]), d.n_users))


POSITIONS = BASE + f""", p AS (SELECT row_id, user_idx, item_idx, rating, row_number() OVER (ORDER BY md5('{SEED}:' || row_id), row_id) - 1 AS pos, count(*) OVER () AS n FROM x),
c AS (SELECT *, pos < {{first}} OR pos = min(pos) OVER (PARTITION BY user_idx) OR pos = min(pos) OVER (PARTITION BY item_idx) AS covered FROM p)
"""
SPLIT = POSITIONS.format(first="CAST(floor(n * 0.8) AS BIGINT)") + ", s AS (SELECT row_id, user_idx, item_idx, rating, CASE WHEN covered THEN 'train' WHEN row_number() OVER (PARTITION BY covered ORDER BY pos) <= CAST(floor(n * 0.1) AS BIGINT) THEN 'validation' ELSE 'test' END AS split FROM c)\n"


@query(SPLIT + "SELECT row_id, split FROM s")
def sp1_split(spark, sf_dir):
    return splits.split_rows(data(spark, sf_dir).rows, 0.8, 0.1, SEED).select("row_id", "split")


@query(POSITIONS.format(first="n - CAST(floor(n * 0.1) AS BIGINT)") + "SELECT row_id, CASE WHEN covered THEN 'train' ELSE 'validation' END AS split FROM c")
def sp3_split_in_two(spark, sf_dir):
    return splits.split_rows_in_two(data(spark, sf_dir).rows, 0.1, SEED).select("row_id", "split")


@query(SPLIT + "SELECT split, count(*) AS rows, count(DISTINCT user_idx) AS users, count(DISTINCT item_idx) AS items, min(rating) AS rating_min, max(rating) AS rating_max FROM s GROUP BY split")
def a28_split_sizes(spark, sf_dir):
    return splits.split_sizes(splits.split_rows(data(spark, sf_dir).rows, 0.8, 0.1, SEED))


@query(BASE + "SELECT row_id, CASE WHEN pos < CAST(floor(n * 0.8) AS BIGINT) THEN 'train' WHEN pos < CAST(floor(n * 0.8) AS BIGINT) + CAST(floor(n * 0.1) AS BIGINT) THEN 'validation' ELSE 'test' END AS split FROM (SELECT row_id, row_number() OVER (ORDER BY timestamp, row_id) - 1 AS pos, count(*) OVER () AS n FROM x)")
def sp6_time_split(spark, sf_dir):
    return splits.time_split(interactions(spark, sf_dir), "timestamp").select("row_id", "split")


FOLDS = BASE + ", f AS (SELECT min(row_id) AS row_id, raw_user_id, raw_item_id, rating, timestamp FROM x GROUP BY ALL), g AS (SELECT *, fold, CASE WHEN row_id % 5 = fold - 1 THEN 'test' ELSE 'train' END AS part FROM f, (SELECT CAST(range AS INTEGER) AS fold FROM range(1, 6)))\n"


def _folds(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    x = interactions(spark, sf_dir)
    keys = ["raw_user_id", "raw_item_id", "rating", "timestamp"]
    unique = cut(x.groupBy(keys).agg(F.min("row_id").alias("row_id"), F.min("user_idx").alias("user_idx"), F.min("item_idx").alias("item_idx")))
    every = unique.withColumn("fold", F.explode(F.sequence(F.lit(1), F.lit(5))))
    records = every.withColumn("part", F.when(F.col("row_id") % 5 == F.col("fold") - 1, "test").otherwise("train")).select("fold", "part", *keys)
    return unique, records


@query(FOLDS + "SELECT fold, part, row_id FROM g")
def j3_fold_rows(spark, sf_dir):
    return splits.fold_row_ids(*_folds(spark, sf_dir))


@query(FOLDS + "SELECT row_id, part AS split FROM g WHERE fold = 2")
def sp4_fold_split(spark, sf_dir):
    unique, records = _folds(spark, sf_dir)
    return splits.fold_split(Ratings.of(unique), cut(splits.fold_row_ids(unique, records)), 2).select("row_id", "split")


@query(BASE + "SELECT row_id, user_idx, item_idx, rating FROM (SELECT *, row_number() OVER (PARTITION BY user_idx, item_idx ORDER BY timestamp DESC, row_id DESC) AS n FROM x) WHERE n = 1")
def w1_latest_rating(spark, sf_dir):
    return reporting.latest(interactions(spark, sf_dir), ["user_idx", "item_idx"], ["timestamp", "row_id"]).select("row_id", "user_idx", "item_idx", "rating")


@query(BASE + "SELECT item_idx, count(*) AS count, avg(rating) AS mean, round(coalesce(stddev_samp(rating), 0), 6) AS std, median(rating) AS median, min(rating) AS min, max(rating) AS max, round(coalesce(stddev_samp(rating), 0) / avg(rating), 6) AS cv FROM x GROUP BY item_idx")
def a13_item_summary(spark, sf_dir):
    df = metrics.sample_summary(interactions(spark, sf_dir), "rating", ["item_idx"])
    return df.withColumns({c: F.round(c, 6) for c in ("std", "cv")})


@query(BASE + "SELECT item_idx AS candidate_index, CAST(row_number() OVER (ORDER BY round(avg(rating), 9), round(coalesce(stddev_samp(rating), 0), 9), avg(user_idx), item_idx) AS INTEGER) AS rank FROM x GROUP BY item_idx")
def o2_ranking(spark, sf_dir):
    rows = interactions(spark, sf_dir).select(F.col("item_idx").cast("string").alias("unit"), F.col("item_idx").alias("candidate_index"), F.col("rating").alias("validation_rmse"), F.col("user_idx").cast("double").alias("fit_seconds"), F.lit(0.0).alias("peak_mb"))
    return studies.rank_candidates(rows).select("candidate_index", "rank")


ERRORS = """round(sqrt(avg((p - t) * (p - t))), 6) AS rmse, round(avg(abs(p - t)), 6) AS mae, round(avg(p - t), 6) AS residual_mean, round(stddev_pop(p - t), 6) AS residual_std,
round(quantile_cont(abs(p - t), 0.5), 6) AS abs_error_p50, round(quantile_cont(abs(p - t), 0.9), 6) AS abs_error_p90, round(quantile_cont(abs(p - t), 0.95), 6) AS abs_error_p95, round(max(abs(p - t)), 6) AS abs_error_max,
round(avg(p), 6) AS prediction_mean, round(stddev_pop(p), 6) AS prediction_std, round(min(p), 6) AS prediction_min, round(max(p), 6) AS prediction_max,
round(avg(CASE WHEN p < 2 THEN 1 ELSE 0 END), 6) AS below_range_rate, round(avg(CASE WHEN p > 4 THEN 1 ELSE 0 END), 6) AS above_range_rate, round(avg(CASE WHEN p < 2 OR p > 4 THEN 1 ELSE 0 END), 6) AS out_of_range_rate"""


@query(SPLIT + f", m AS (SELECT item_idx, avg(rating) AS p FROM s WHERE split = 'train' GROUP BY item_idx) SELECT split, {ERRORS.replace('t)', 'rating)')} FROM s JOIN m USING (item_idx) GROUP BY split")
def a11_item_mean_errors(spark, sf_dir):
    s = cut(splits.split_rows(data(spark, sf_dir).rows, 0.8, 0.1, SEED))
    means = s.filter("split = 'train'").groupBy("item_idx").agg(F.avg("rating").alias("p"))
    return rounded(metrics.rating_errors(s.join(means, "item_idx"), "rating", "p", 2.0, 4.0, ["split"]))


def _fraction(k: int, part: int) -> Column:
    return ((F.col("id") * (7 + part) + k * 3 + part) % 11 - 5) / 13.0


def given_model(spark, d: Ratings, name: str) -> fit.Model:
    """A model whose parameters are fixed fractions instead of fitted ones."""
    users, items = given_clusters(spark, d)
    clustered = cfg.requirements(name).clusters
    config = cfg.Config(name, DIM, 1, alpha=ALPHA if clustered else 0.0)
    sizes = {"bu": d.n_users, "bi": d.n_items, "p": d.n_users, "q": d.n_items, "x": d.n_items, "y": d.n_items, "pC": USER_CLUSTERS, "qC": ITEM_CLUSTERS, "xC": ITEM_CLUSTERS, "yC": ITEM_CLUSTERS}
    table = None
    for number, part in enumerate(sizes):
        if part in ("bu", "bi", *config.parts):
            width = 1 if part in ("bu", "bi") else DIM
            t = spark.range(sizes[part]).select(F.lit(part).alias("part"), F.col("id").cast("int").alias("id"), F.array(*[_fraction(k, number) for k in range(width)]).alias("f"))
            table = t if table is None else table.unionByName(t)
    given = cl.Clusters(users, items, None, USER_CLUSTERS, ITEM_CLUSTERS) if clustered else None
    return fit.Model(config, table, 3.5, d.rating_min, d.rating_max, d.n_users, d.n_items, fit.build_indices(d, config, fit.Indices(clusters=given)))


def scored(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    d = data(spark, sf_dir)
    return rounded(scoring.predict(given_model(spark, d, name), d.rows).select("row_id", "prediction"))


def _scored_sql(name: str, alpha: float = ALPHA, clip: bool = True) -> str:
    parts, own, a = cfg.PARTS[name].split(), 1.0, 0.0
    clustered = "pC" in parts
    if clustered:
        own, a = 1 - alpha, alpha
    number = {p: n for n, p in enumerate(["bu", "bi", "p", "q", "x", "y", "pC", "qC", "xC", "yC"])}
    f = lambda part, k, of: f"((({of}) * {7 + number[part]} + {k * 3 + number[part]}) % 11 - 5) / 13.0::DOUBLE"
    uc, ic = f"user_idx % {USER_CLUSTERS}", f"item_idx % {ITEM_CLUSTERS}"
    w = f"(rating - (3.5 + {f('bu', 0, 'user_idx')} + {f('bi', 0, 'item_idx')}))"
    z, ctes = [], ""
    if "x" in parts:
        sums = ", ".join(f"sum({w} * ({own} * {f('x', k, 'item_idx')}" + (f" + {a} * {f('xC', k, ic)}" if clustered else "") + f")) AS x{k}" for k in range(DIM))
        ctes += f", xs AS (SELECT user_idx, {sums} FROM e GROUP BY user_idx)"
    if "y" in parts:
        sums = ", ".join(f"sum({own} * {f('y', k, 'item_idx')}" + (f" + {a} * {f('yC', k, ic)}" if clustered else "") + f") AS y{k}" for k in range(DIM))
        ctes += f", ys AS (SELECT user_idx, {sums} FROM h GROUP BY user_idx)"
    for k in range(DIM):
        terms = []
        if "p" in parts:
            terms.append(f"{own} * {f('p', k, 'user_idx')}" + (f" + {a} * {f('pC', k, uc)}" if clustered else ""))
        terms += [f"norm * {c}{k}" for c in "xy" if c in parts]
        q = f"({own} * {f('q', k, 'item_idx')}" + (f" + {a} * {f('qC', k, ic)})" if clustered else ")")
        z.append(f"{q} * ({' + '.join(terms)})")
    joins = " ".join(f"JOIN {c}s USING (user_idx)" for c in "xy" if c in parts)
    raw = f"3.5 + {f('bu', 0, 'user_idx')} + {f('bi', 0, 'item_idx')} + " + " + ".join(z)
    return BASE + ctes + f", b AS (SELECT min(rating) AS lo, max(rating) AS hi FROM x) SELECT row_id, round({f"greatest(lo, least(hi, {raw}))" if clip else raw}, 6) AS prediction FROM x JOIN hn USING (user_idx) {joins}, b"


for _number, _name in enumerate(cfg.PARTS, 1):
    QUERIES[f"m{_number}_{_name}_scores"] = partial(scored, _name)
    SQL[f"m{_number}_{_name}_scores"] = _scored_sql(_name)


def fitted(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    """Error statistics by split of a model fitted to the training rows; no SQL can state a fit."""
    d = Ratings.of(packed(interactions(spark, sf_dir).select(COLUMNS)))
    s = packed(splits.split_rows(d.rows, 0.8, 0.1, SEED))
    # The split holds all rows; those before it need not stay stored.
    d = replace(d, rows=s.drop("split"))
    train = splits.as_parts(s, d)["train"]
    config = cfg.Config(name, FIT_DIM, FIT_EPOCHS, 0.01, dtype="float64", seed=SEED, alpha=ALPHA if cfg.requirements(name).clusters else 0.0)
    found = cl.induce(train, cfg.induction_config(config), USER_CLUSTERS, ITEM_CLUSTERS) if cfg.requirements(name).clusters else None
    if found:
        found = cl.Clusters(cut(found.users), cut(found.items), None, USER_CLUSTERS, ITEM_CLUSTERS)
    model = fit.fit(train, config, fit.Indices(clusters=found))
    predicted = packed(scoring.predict(model, s).select("split", "rating", "prediction"))
    # All else that was stored can go before the errors are sorted.
    low, high = d.rating_min, d.rating_max
    scoring.forget(model)
    del d, s, train, model, found
    release(spark)
    return metrics.rating_errors(predicted, "rating", "prediction", low, high, ["split"])


for _number, _name in enumerate(cfg.PARTS, 1):
    QUERIES[f"m{_number}_{_name}_fit"] = partial(fitted, _name)


@query()
def c1_clusters(spark, sf_dir):
    """Sizes of the user clusters that are found in the ratings."""
    d = data(spark, sf_dir)
    found = cl.induce(d, cfg.Config("biased_mf", FIT_DIM, FIT_EPOCHS, 0.01, seed=SEED), USER_CLUSTERS, ITEM_CLUSTERS, restarts=2)
    return cl.sizes(found.users, USER_CLUSTERS)
