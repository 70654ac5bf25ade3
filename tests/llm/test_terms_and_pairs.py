from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ratelathe.llm import queries, terms, together


def test_terms_against_counting(spark):
    rng = np.random.default_rng(5)
    words = ["a", "B", " b ", "common", "", "  ", "naïve", None]
    rows = [("x", [words[k] for k in rng.integers(0, len(words), 3)] + ["common"]) for _ in range(300)] + [("x", None), ("x", []), ("y", ["only"]), ("y", ["only"])]
    df = spark.createDataFrame(rows, "field_name string, raw array<string>").repartition(3)
    df = df.select("field_name", terms.clean_terms(F.col("raw")).alias("terms"))
    occurrences, records, total = Counter(), Counter(), Counter()
    for field, raw in rows:
        clean = [w.strip(" ").lower() for w in raw or [] if w is not None and w.strip(" ")]
        occurrences.update((field, w) for w in clean)
        records.update((field, w) for w in set(clean))
        total[field] += bool(clean)
    found = terms.mark_terms(terms.term_counts(df), 2, 0.1).collect()
    assert {(r["field_name"], r["term"]): (r["occurrences"], r["records"], r["field_records"]) for r in found} == {k: (n, records[k], total[k[0]]) for k, n in occurrences.items()}
    marks = {(r["field_name"], r["term"]): r["mark"] for r in found}
    assert marks["y", "only"] == "rare" and marks["x", "common"] == "common"
    assert sorted(r["term_id"] for r in found) == list(range(len(occurrences)))


def test_no_terms(spark):
    assert terms.term_counts(spark.createDataFrame([], "field_name string, terms array<string>")).count() == 0
    assert terms.term_counts(spark.createDataFrame([("x", [])], "field_name string, terms array<string>")).count() == 0


def brute_pairs(rows, least, ratio):
    baskets = {}
    for b, i in rows:
        if b is not None and i is not None:
            baskets.setdefault(b, set()).add(i)
    single, both = Counter(), Counter()
    for items in baskets.values():
        single.update(items)
        both.update(combinations(sorted(items), 2))
    n = len(baskets)
    return {(a, b): (k, single[a], single[b], n) for (a, b), k in both.items() if k >= least and k * n >= ratio * single[a] * single[b]}


@pytest.mark.parametrize(("block", "hot"), [(1_024, 1_000_000), (4, 1_000_000), (3, 10)])
@pytest.mark.parametrize(("least", "ratio"), [(1, 0), (3, 1.5)])
def test_pairs_against_counting(spark, block, hot, least, ratio):
    rng = np.random.default_rng(7)
    rows = [(int(b), int(i)) for b, i in zip(rng.integers(0, 40, 400), rng.zipf(1.6, 400) % 25)]
    rows += [(99, i) for i in range(25)] + [(98, i) for i in range(0, 25, 2)] + [(None, 1), (3, None), (99, 1), (97, 5)]
    df = spark.createDataFrame(rows, "basket int, item int").withColumns({"id": F.lit("x"), "x": F.lit(1)})
    found = together.pair_counts(df, "basket", "item", least, ratio, block_items=block, key_baskets=hot).collect()
    assert len(found) == len({(r["item_a"], r["item_b"]) for r in found})
    assert {(r["item_a"], r["item_b"]): (r["together"], r["baskets_a"], r["baskets_b"], r["baskets"]) for r in found} == brute_pairs(rows, least, ratio)
    for r in found:
        assert r["ratio"] == pytest.approx(r["together"] * r["baskets"] / r["baskets_a"] / r["baskets_b"])


def test_no_pairs(spark):
    assert together.pair_counts(spark.createDataFrame([], "b int, i string"), "b", "i").count() == 0
    assert together.pair_counts(spark.createDataFrame([(1, "a"), (2, "b")], "b int, i string"), "b", "i").count() == 0


def test_query_of_all_pairs_has_no_threshold(spark, tmp_path):
    rows = [(u, i) for u in range(20) for i in (1, 2)] + [(0, 3), (0, 4), (None, 5)]
    spark.createDataFrame(rows, "raw_user_id int, raw_item_id int").write.parquet(f"{tmp_path}/ratings.parquet")
    found = queries.QUERIES["p3_all_pairs"](spark, str(tmp_path)).collect()
    assert {(r["item_a"], r["item_b"]): (r["together"], r["ratio"]) for r in found} == {(1, 2): (20, 1.0), (3, 4): (1, 20.0), **{(a, b): (1, 1.0) for a in (1, 2) for b in (3, 4)}}


def test_a_large_basket_has_as_many_chunks_as_blocks(spark):
    """5 000 items, every 1 024th of a wide catalogue, make 5 chunks and 10 chunk pairs that hold every pair once."""
    from ratelathe.session import cut

    ids = spark.range(0, 5_000 * 1_024, 1_024).select(F.lit(1).alias("basket"), F.col("id").cast("int").alias("id"), F.lit(5).alias("chunks"))
    chunks = cut(ids.withColumn("chunk", F.pmod(F.hash("id"), F.col("chunks"))).groupBy("basket", "chunks", "chunk").agg(F.sort_array(F.collect_list("id")).alias("ids")))
    pairs = together._chunk_pairs(chunks)
    assert (chunks.count(), pairs.count()) == (5, 10)
    alone = chunks.select("basket", F.col("ids").alias("left"), F.expr("cast(null as array<int>)").alias("right"))
    stripes = together._products(alone.unionByName(pairs))
    assert stripes.agg(F.sum(F.size("ys"))).first()[0] == 5_000 * 4_999 // 2
    assert stripes.filter("exists(ys, y -> y <= x)").count() == 0


def test_gathering_holds_one_range(monkeypatch):
    """Ranges come out one after another, each with its own counts, without an array for each of them."""
    import pyarrow as pa

    ids = np.arange(0, 500 * terms.RANGE_IDS, 97)
    made, zeros = [], np.zeros
    monkeypatch.setattr(terms.np, "zeros", lambda *a, **k: made.append(a) or zeros(*a, **k))
    batches = [pa.RecordBatch.from_arrays([pa.array(ids[k : k + 1_000]), pa.array(np.full(len(ids[k : k + 1_000]), 2)), pa.array(np.full(len(ids[k : k + 1_000]), 1))], names=["id", "occurrences", "records"]) for k in range(0, len(ids), 1_000)]
    out = list(terms._gather(iter(batches), False))
    assert [b["range"][0].as_py() for b in out] == list(range(500)) and len(made) == 1
    assert sum(sum(b["occurrences"][0].as_py()) for b in out) == 2 * len(ids)
    again = list(terms._gather(iter(out), True))
    assert [b.to_pydict() for b in again] == [b.to_pydict() for b in out]


@pytest.mark.parametrize("key_baskets", [1_000_000, 20])
def test_pairs_are_counted_in_bounded_steps(spark, monkeypatch, key_baskets):
    monkeypatch.setattr(together, "TALLY_PAIRS", 50)
    rng = np.random.default_rng(3)
    rows = sorted({(int(b), int(i)) for b, i in zip(rng.integers(0, 120, 1_500), rng.integers(0, 40, 1_500) ** 2 // 40)})
    of = {}
    for b, i in rows:
        of.setdefault(b, []).append(i)
    expected = Counter(p for items in of.values() for p in combinations(sorted(items), 2))
    df = spark.createDataFrame(rows, "b int, i int")
    found = together.pair_counts(df, "b", "i", min_count=4, key_baskets=key_baskets, block_items=8)
    assert {(r["item_a"], r["item_b"]): r["together"] for r in found.collect()} == {p: n for p, n in expected.items() if n >= 4}
    # Counts of each step, as they come out of a task, and never a pair twice.
    x = pa.array([0] * 30 + [1] * 5, pa.int32())
    ys = pa.array([[5, 6, 7 + k % 3] for k in range(30)] + [[2]] * 5, pa.list_(pa.int32()))
    batches = [pa.RecordBatch.from_arrays([x[k : k + 4], ys[k : k + 4]], names=["x", "ys"]) for k in range(0, 35, 4)]
    told = [tuple(r.values()) for b in together._tally(6)(iter(batches)) for r in b.to_pylist()]
    assert sorted(told) == [(0, 5, 30), (0, 6, 30), (0, 7, 10), (0, 8, 10), (0, 9, 10)]


def test_pairs_of_cold_items_are_shuffled_once(spark):
    # Where some item has more baskets than a task is to count, pairs under all other items are final after one shuffle.
    rows = [(b, i) for b in range(60) for i in ([100, 101] if b < 50 else []) + [b % 7, 7 + b % 11]]
    df = spark.createDataFrame(rows, "b int, i int")
    plan = together.pair_counts(df, "b", "i", key_baskets=30)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan.split("Union")[1].split("Aggregate")[0]
