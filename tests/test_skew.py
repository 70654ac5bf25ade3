import numpy as np

from ratelathe.operators import skew


def table(spark):
    rng = np.random.default_rng(3)
    rows = [(1, float(v)) for v in rng.integers(0, 300, 2_000)] + [(int(k), float(v)) for k, v in zip(rng.integers(2, 30, 900), rng.integers(0, 9, 900))]
    rows += [(None, 2.0), (40, None), (41, 7.0), (41, 7.0)]
    return rows, spark.createDataFrame(rows, "k int, v double").repartition(4)


def test_counts_and_modes(spark):
    rows, df = table(spark)
    found = {r["key"]: r for r in skew.key_counts(skew.weigh(df, "k", "v")).collect()}
    keys = {k for k, _ in rows}
    assert set(found) == keys
    for k in keys:
        values = [v for x, v in rows if x == k and v is not None]
        assert found[k]["rows"] == sum(x == k for x, _ in rows)
        assert found[k]["filled"] == len(values)
        assert found[k]["distinct_values"] == len(set(values))
        assert found[k]["mode_value"] == (min(set(values), key=lambda v: (-values.count(v), v)) if values else None)


def test_percentiles_over_ranges(spark):
    rows, df = table(spark)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # several ranges for the hot key
    try:
        found = {(r["key"], r["percent"]): r["percentile"] for r in skew.key_percentiles(skew.weigh(df, "k", "v"), [0.0, 0.25, 0.5, 0.9, 1.0]).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    for k in {k for k, v in rows if k is not None and v is not None}:
        values = [v for x, v in rows if x == k and v is not None]
        for p in (0.0, 0.25, 0.5, 0.9, 1.0):
            assert abs(found[k, p] - np.quantile(values, p)) < 1e-9
    assert len(found) == 5 * len({k for k, v in rows if k is not None and v is not None})


def test_overloaded_keys_at_the_border(spark):
    df = spark.createDataFrame([(1, 1)] * 2 + [(2, 1)] * 1 + [(None, 1)] * 97, "k int, v int")
    found = skew.overloaded_keys(skew.weigh(df, "k", "v"), 100, 0.02)
    assert [(r["key"], r["rows"]) for r in found.collect()] == [(1, 2)]


def test_no_rows(spark):
    weighted = skew.weigh(spark.createDataFrame([], "k int, v double, key int, value int, n int"), "k", "v")
    assert skew.key_counts(weighted).count() == 0
    assert skew.key_percentiles(weighted, [0.5]).count() == 0
    assert skew.overloaded_keys(weighted, 0, 0.02).count() == 0
