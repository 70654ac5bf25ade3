import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from ratelathe.functions import metrics, scalars, vectors
from ratelathe.operators import clusters as cl
from ratelathe.operators import histories as hist
from ratelathe.operators import interactions as ops
from ratelathe.operators import splits
from ratelathe.operators.dense_ids import dense_ids
from ratelathe.operators.views import Ratings, repeated_prefix, spread_sample


def rows(spark, users, items, ratings):
    return spark.createDataFrame([(k, int(u), int(i), float(r)) for k, (u, i, r) in enumerate(zip(users, items, ratings))], "row_id bigint, user_idx int, item_idx int, rating double")


def view(spark, users, items, ratings):
    return Ratings.of(rows(spark, users, items, ratings))


def ids(df, part):
    return sorted(r["row_id"] for r in df.filter(F.col("split") == part).collect())


def test_dense_ids(spark):
    df = spark.createDataFrame([(x,) for x in (5, 3, 9, 1)], "v int").repartition(3)
    assert {r["v"]: r["i"] for r in dense_ids(df, ["v"], "i").collect()} == {1: 0, 3: 1, 5: 2, 9: 3}
    assert dense_ids(df.limit(0), ["v"], "i").count() == 0


USERS, ITEMS, RATINGS = [0, 0, 0, 1, 1, 2], [2, 2, 1, 3, 2, 2], [5, 4.5, 4, 3, 2.5, 4]


def test_history(spark):
    h = {r["user_idx"]: r for r in hist.history(view(spark, USERS, ITEMS, RATINGS)).collect()}
    assert {u: r["items"] for u, r in h.items()} == {0: [1, 2], 1: [2, 3], 2: [2]}
    assert [h[u]["cnt"] for u in range(3)] == [2, 2, 1] and h[0]["norm"] == pytest.approx(1 / math.sqrt(2))


def test_explicit_feedback_takes_the_first(spark):
    e = {r["user_idx"]: [tuple(x) for x in r["feedback"]] for r in hist.explicit_feedback(view(spark, USERS, ITEMS, RATINGS)).collect()}
    assert e == {0: [(1, 4.0), (2, 5.0)], 1: [(2, 2.5), (3, 3.0)], 2: [(2, 4.0)]}


def test_subset_has_all_users(spark):
    d = view(spark, USERS, ITEMS, RATINGS)
    part = d.subset(spark.createDataFrame([(0,), (2,), (5,)], "row_id bigint"), "part")
    h = {r["user_idx"]: (r["items"], r["norm"]) for r in hist.history(part).collect()}
    assert h == {0: ([1, 2], pytest.approx(1 / math.sqrt(2))), 1: ([], 0.0), 2: ([2], 1.0)}
    assert (part.n_users, part.rating_min, part.mean()) == (3, 2.5, pytest.approx(13 / 3))
    assert part.materialize().row_ids().count() == 3
    index = hist.history(part)
    hist.validate_index(index, 3)
    with pytest.raises(ValueError):
        hist.validate_index(index, 4)
    with pytest.raises(ValueError):
        hist.history(d.where("row_id < 0", "none"))
    with pytest.raises(ValueError):
        Ratings.of(d.rows.limit(0))


def test_cluster_counts_and_grid(spark):
    d = view(spark, [0, 0, 1, 1, 2, 2, 3, 3], [0, 1, 1, 2, 2, 3, 0, 3], [5, 4.5, 4, 3.5, 2.5, 2, 1.5, 1])
    items = spark.createDataFrame([(0, 0), (1, 0), (2, 1), (3, 1)], "item_idx int, cluster_id int")
    users = spark.createDataFrame([(0, 0), (1, 0), (2, 1), (3, 1)], "user_idx int, cluster_id int")
    counts = hist.cluster_counts(hist.history(d), items)
    lists = {r["user_idx"]: [tuple(c) for c in r["clusters"]] for r in hist.cluster_lists(counts).collect()}
    assert lists == {0: [(0, 2)], 1: [(0, 1), (1, 1)], 2: [(1, 2)], 3: [(0, 1), (1, 1)]}
    grid = cl.rating_grid(d, users, items, 2, 3)
    assert grid.count() == 6 and grid.agg(F.sum("cnt")).first()[0] == 8
    assert grid.filter("item_cluster = 2").agg(F.max("mean")).first()[0] == 0.0
    assert [r["size"] for r in cl.sizes(items, 3).orderBy("cluster_id").collect()] == [2, 2, 0]
    assert tuple(cl.size_summary(cl.sizes(items, 3)).first()) == (0, 2, pytest.approx(4 / 3), 1, 1, 2, pytest.approx(2 / 3))
    assert tuple(hist.active_clusters(counts, 5).first()) == (pytest.approx(6 / 5), 2)
    total = hist.gather(hist.history(d), spark.createDataFrame([(k, [float(k), 1.0]) for k in range(4)], "item_idx int, f array<double>"))
    assert {r["user_idx"]: r["total"] for r in total.collect()} == {0: [1.0, 2.0], 1: [3.0, 2.0], 2: [5.0, 2.0], 3: [3.0, 2.0]}
    for wrong in ((0, 1), (5, 1), (1, 9)):
        with pytest.raises(ValueError):
            cl.check_request(4, 4, *wrong)


def greedy(order, users, items, train, validation):
    """The walk that the set-based split must agree with."""
    n = len(order)
    first, rest = list(order[: int(n * train)]), order[int(n * train) :]
    known_users, known_items = {users[k] for k in first}, {items[k] for k in first}
    kept = []
    for k in rest:
        if users[k] not in known_users or items[k] not in known_items:
            first.append(k)
            known_users.add(users[k])
            known_items.add(items[k])
        else:
            kept.append(k)
    return sorted(first), sorted(kept[: int(n * validation)]), sorted(kept[int(n * validation) :])


@pytest.mark.parametrize("seed", range(4))
def test_split_is_the_greedy_walk(spark, seed):
    rng = np.random.default_rng(seed)
    n = 60
    users, items = rng.integers(0, 25, n).tolist(), rng.integers(0, 20, n).tolist()
    order = rng.permutation(n).tolist()
    found = splits.split_rows(rows(spark, users, items, [3.0] * n), 0.5, 0.25, row_order=order)
    expected = greedy(order, users, items, 0.5, 0.25)
    assert tuple(ids(found, p) for p in ("train", "validation", "test")) == expected
    two = splits.split_rows_in_two(rows(spark, users, items, [3.0] * n), 0.25, row_order=order)
    expected = greedy(order, users, items, (n - int(n * 0.25)) / n, 1.0)
    assert (ids(two, "train"), ids(two, "validation")) == expected[:2]


def test_seeded_split_covers_all(spark):
    d = view(spark, [0, 0, 0, 1, 1, 1, 2, 2, 2, 3, 3, 3], [0, 1, 2, 0, 2, 3, 1, 2, 3, 0, 1, 3], [4, 3.5, 5, 2.5, 4, 3, 4.5, 5, 2, 3, 4, 4.5])
    s = splits.split_rows(d.rows, 0.5, 0.25, 7)
    train = s.filter("split = 'train'")
    assert s.count() == 12 and train.select("user_idx").distinct().count() == 4 == train.select("item_idx").distinct().count()
    assert sorted(map(tuple, s.collect())) == sorted(map(tuple, splits.split_rows(d.rows.repartition(5), 0.5, 0.25, 7).collect()))
    assert splits.split_rows(d.rows.limit(0)).count() == 0
    parts = splits.as_parts(s, d)
    assert sum(p.rows.count() for p in parts.values()) == 12 and parts["test"].n_users == 4
    for ratios in ((0, 0.1), (0.9, 0.2), (1.2, 0)):
        with pytest.raises(ValueError):
            splits.split_rows(d.rows, *ratios)
    with pytest.raises(ValueError):
        splits.split_rows_in_two(d.rows, 0.01)
    timed = splits.time_split(d.rows, "rating", 0.5, 0.25)
    assert timed.filter("split = 'train'").agg(F.max("rating")).first()[0] <= timed.filter("split = 'test'").agg(F.min("rating")).first()[0]


def test_folds(spark):
    x = spark.createDataFrame([(0, 0, 0, 4.0, 1, 10, 5), (1, 0, 1, 5.0, 1, 20, 6), (2, 1, 0, 3.0, 2, 10, 7), (3, 1, 1, 2.0, 2, 20, 8)], "row_id bigint, user_idx int, item_idx int, rating double, raw_user_id int, raw_item_id int, timestamp bigint")
    records = [(1, "train", 1, 10, 4.0, 5), (1, "train", 2, 10, 3.0, 7), (1, "test", 1, 20, 5.0, 6), (1, "test", 2, 20, 2.0, 8)]
    schema = "fold int, part string, raw_user_id int, raw_item_id int, rating double, timestamp bigint"
    ids_ = splits.fold_row_ids(x, spark.createDataFrame(records, schema))
    d = Ratings.of(x)
    s = splits.fold_split(d, ids_, 1)
    assert ids(s, "train") == [0, 2] and ids(s, "test") == [1, 3]
    inner = splits.build_split(d, "paper_faithful_ml100k_v1", fold=1, fold_ids=ids_)
    assert ids(inner, "train") == [0, 2]
    with pytest.raises(KeyError):
        splits.fold_row_ids(x, spark.createDataFrame([(1, "test", 9, 9, 1.0, 1)], schema))
    with pytest.raises(ValueError, match="duplicate"):
        splits.fold_row_ids(x.unionByName(x), spark.createDataFrame(records, schema))
    with pytest.raises(ValueError, match="overlap"):
        splits.fold_split(d, ids_.unionByName(ids_), 1)
    with pytest.raises(ValueError, match="cover"):
        splits.fold_split(d, ids_.filter("part = 'train'"), 1)
    with pytest.raises(ValueError):
        splits.fold_split(d, ids_, 6)
    with pytest.raises(ValueError, match="inner seed"):
        splits.build_split(d, "paper_faithful_ml100k_inner_v1", fold=1, fold_ids=ids_)
    with pytest.raises(ValueError, match="unknown"):
        splits.build_split(d, "benchmark_time_v1")


def test_inner_fold_split(spark):
    n = 12
    x = rows(spark, [0, 1, 2] * 4, [0, 0, 0, 1, 1, 1] * 2, [3.0] * n)
    ids_ = spark.createDataFrame([(2, "test" if k >= 10 else "train", k) for k in range(n)], "fold int, part string, row_id bigint")
    s = splits.build_split(Ratings.of(x), "paper_faithful_ml100k_inner_v1", validation=0.25, fold=2, fold_ids=ids_, inner_seed=17)
    sizes = {r["split"]: r["rows"] for r in splits.split_sizes(s).collect()}
    assert ids(s, "test") == [10, 11] and sizes["train"] + sizes["validation"] == 10


def test_split_ids():
    assert splits.split_id("benchmark_random_v1", 1) == "benchmark_random_v1_tr080_va010_s001"
    assert splits.split_id("paper_faithful_ml100k_v1", fold=3) == "paper_faithful_ml100k_v1_u3"
    assert splits.split_id("paper_faithful_ml100k_inner_v1", fold=3, validation=0.05, inner_seed=7) == "paper_faithful_ml100k_inner_v1_u3_va005_s007"


def test_error_statistics(spark):
    df = spark.createDataFrame([(1.0, 0.0), (3.0, 2.0), (5.0, 6.0), (5.0, 5.5), (None, 1.0)], "t double, p double")
    m = metrics.rating_errors(df, "t", "p", 1.0, 5.0).first()
    assert m["rmse"] == pytest.approx(math.sqrt(3.25 / 4)) and m["mae"] == pytest.approx(0.875) and m["residual_mean"] == pytest.approx(-0.125)
    assert [m[f] for f in ("abs_error_p50", "abs_error_p90", "abs_error_p95", "abs_error_max")] == [1.0] * 4
    assert m["prediction_mean"] == 3.375 and [m[f] for f in ("below_range_rate", "above_range_rate", "out_of_range_rate")] == [0.25, 0.5, 0.75]
    assert m["residual_std"] == pytest.approx(np.std([-1, -1, 1, 0.5]))
    assert metrics.rating_errors(df, "t", "p", 1.0, 5.0, exact=False).first()["abs_error_max"] == 1.0
    with pytest.raises(ValueError):
        metrics.rating_errors(df, "t", "p", 5.0, 1.0)
    record = metrics.per_split(df.withColumn("split", F.lit("train")), "t", "p", 1.0, 5.0)
    assert record["test"] is None and record["test_rmse"] is None and record["train_mae"] == record["train"]["mae"]


def test_sample_summary(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 2.0), ("c", 0.0), ("d", None)], "g string, v double")
    found = {r["g"]: r for r in metrics.sample_summary(df, "v", ["g"]).collect()}
    assert (found["a"]["std"], found["a"]["cv"]) == (pytest.approx(math.sqrt(2)), pytest.approx(math.sqrt(2) / 2))
    assert found["b"]["std"] == 0.0 and found["c"]["cv"] == 0.0 and "d" not in found


def test_scalars(spark):
    df = spark.createDataFrame([('{"metrics": {"test": {"a": 1}, "validation_b": 2}, "x": {"y": true}}', 0.0, 5.0, 0.125)], "j string, z double, w double, s double")
    j = F.col("j")
    row = df.select(
        scalars.preferred_metric(j, "a"), scalars.preferred_metric(j, "b"), scalars.json_at(j, "x.y"), scalars.json_at(j, "x.q"),
        scalars.first_nonzero(F.col("z"), F.col("w")), scalars.first_nonzero(F.col("z"), F.col("z")), scalars.lenient_number(F.lit("true")), scalars.lenient_number(F.lit("1e3")), scalars.lenient_number(F.lit("x")),
        scalars.lenient_bool(F.lit("true")), scalars.lenient_bool(F.lit("1")), scalars.cell(F.col("w"), "double"), scalars.cell(F.lit(None).cast("double"), "double"), scalars.seed_slug(F.lit(7)), scalars.percent(F.col("s")), scalars.utc_stamp(F.lit(0)), scalars.clipped(F.col("w"), F.lit(1.0), F.lit(4.0)),
    ).first()
    assert tuple(row) == ("1", "2", "true", None, 5.0, 0.0, None, 1000.0, None, True, None, "5.000000", "", "s007", 12, "1970-01-01T000000Z", 4.0)
    assert scalars.candidate_file("a b/c", 1) == "a_b_c.yaml" and scalars.candidate_file("x" * 30, 3).startswith("c003_")
    assert scalars.merged({"a": {"b": 1, "c": 2}, "d": 3}, {"a": {"b": 9}, "d": {"e": 1}}) == {"a": {"b": 9, "c": 2}, "d": {"e": 1}}
    assert scalars.relative_to("/a/b/c", "/a") == "b/c" and scalars.relative_to("/x", "/a") == "/x"


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [1.0, 2.0])], "a array<double>, b array<double>")
    a, b = F.col("a"), F.col("b")
    row = df.select(vectors.dot(a, b), vectors.mix(a, b, 0.25), vectors.length(a), vectors.ratio(F.lit(1.0), F.lit(0.0)), vectors.added(a, b), vectors.scaled(a, F.lit(2.0))).first()
    assert tuple(row) == (11.0, [2.5, 3.5], 5.0, None, [4.0, 6.0], [6.0, 8.0])
    assert vectors.mean_length(df.select(a.alias("f")), df.select(F.array(F.lit(1.0)).alias("f"))).first()[0] == 3.0


def test_samples_and_prefixes(spark):
    x = rows(spark, [0] * 25, range(25), [1.0] * 25)
    n, size = 25, 7
    expected = sorted({int(v) for v in np.linspace(0, n - 1, size)})
    assert sorted(r["row_id"] for r in spread_sample(x, ["row_id"], size).collect()) == expected
    assert spread_sample(x, ["row_id"], 25).count() == 25
    assert repeated_prefix(x, 4, 3).groupBy("row_id").count().filter("count = 3").count() == 4


def test_fingerprint(spark):
    x = rows(spark, [0, 1], [0, 1], [1.0, 2.0])
    names = ["user_idx", "item_idx", "rating"]
    assert ops.fingerprint(x, names) == ops.fingerprint(x.repartition(3), names)
    assert ops.fingerprint(x, names) != ops.fingerprint(x.withColumn("rating", F.col("rating") + 1), names)
    assert ops.fingerprint(x, names) != ops.fingerprint(x.unionByName(x), names)
    assert ops.checksum(x).first()[0] == 5.0 and ops.checksum(x.limit(0)).first()[0] == 0.0


def test_fingerprint_of_many_rows(spark):
    # Sums of 40 bits a row leave the range of a bigint from 2 ** 23 rows on.
    x = spark.range(20_000_000)
    assert ops.fingerprint(x, ["id"]) != ops.fingerprint(x.filter("id > 0"), ["id"])


def test_fingerprint_keeps_its_value(spark):
    # Stored caches are named by it.
    x = spark.range(5).selectExpr("id AS row_id", "cast(id AS int) AS user_idx")
    assert ops.fingerprint(x, ["row_id", "user_idx"]) == "5f303ca4aa139c883b71eafc01ae87412f6aa2dbe1479b71eb44c679e7632602"
