import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ratelathe.operators import sessions as s
from ratelathe.session import cut


def brute(rows, gap):
    found = []
    by = {}
    for u, t in rows:
        if u is not None and t is not None:
            by.setdefault(u, []).append(t)
    for u, ts in by.items():
        ts.sort()
        group = [ts[0]]
        for t in ts[1:]:
            if t - group[-1] > gap:
                found.append((u, group[0], group[-1], group[-1] - group[0], len(group)))
                group = []
            group.append(t)
        found.append((u, group[0], group[-1], group[-1] - group[0], len(group)))
    return sorted(found)


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def stack_tree(gaps):
    """The tree by the usual walk with a stack."""
    left, right, stack = [-1] * len(gaps), [-1] * len(gaps), []
    for k, gap in enumerate(gaps):
        below = -1
        while stack and gaps[stack[-1]] < gap:
            below = stack.pop()
        left[k] = below
        if stack:
            right[stack[-1]] = k
        stack.append(k)
    return left, right, stack[:1]


@given(st.lists(st.lists(st.integers(0, 9), max_size=25), min_size=1, max_size=4), st.integers(0, 9))
def test_trees_side_by_side(pieces, threshold):
    gaps = np.array([x for p in pieces for x in [*p, s.WALL]][:-1], np.int64)
    left, right, roots = s.gap_trees(gaps)
    at, expected = 0, ([], [], [])
    for p in pieces:
        shift = lambda xs: [x + at if x >= 0 else x for x in xs]  # noqa: B023, E731
        for out, found in zip(expected, stack_tree(p)):
            out.extend(shift(found))
        at += len(p) + 1
    inner = gaps != s.WALL
    assert left[inner].tolist() == expected[0] and right[inner].tolist() == expected[1]
    assert np.flatnonzero(roots).tolist() == expected[2]
    wide = s.wide_gaps(gaps, left, right, np.flatnonzero(roots), threshold)
    assert wide.tolist() == np.flatnonzero((gaps > threshold) & inner).tolist()


@pytest.mark.parametrize("gaps", [np.arange(65_536), np.arange(65_536)[::-1].copy(), np.full(65_536, 7), np.append(np.arange(5_000)[::-1], 10**6)])
def test_one_sided_trees(gaps):
    left, right, roots = s.gap_trees(gaps)
    x, y, root = stack_tree(gaps.tolist())
    assert left.tolist() == x and right.tolist() == y and np.flatnonzero(roots).tolist() == root


def test_chunks_without_a_cut_stay_shut(spark):
    """The tree over the chunks leads to the one that holds a wide gap."""
    rows = [(1, t) for t in [*range(0, 100), *range(500, 600)]] + [(2, 5)]
    forest = cut(s.gap_forest(spark.createDataFrame(rows, "u int, t bigint").coalesce(1), "u", "t", 10))
    merged = cut(s.merge_chunks(forest))
    one = merged.filter("entity = 1")
    assert len(one.first()["first"]) == 20 and max(one.first()["weight"]) == 401
    assert s._opened(merged, 30).filter("opened").count() == 1 and s._opened(merged, 401).filter("opened").count() == 0
    assert rows_of(s.cut_sessions(forest, 30, merged)) == [(1, 0, 99, 99, 100), (1, 500, 599, 99, 100), (2, 5, 5, 0, 1)]


@pytest.mark.parametrize("chunk", [1, 2, 7, 10_000])
def test_sessions_across_chunks(spark, chunk):
    rng = np.random.default_rng(1)
    hot = [(1, int(t)) for t in rng.integers(0, 4_000, 900)]
    rest = [(int(u), int(t)) for u, t in zip(rng.integers(2, 40, 600), rng.integers(0, 4_000, 600))]
    rows = hot + rest + [(None, 5), (3, None), (2, 10), (2, 10)]
    df = spark.createDataFrame(rows, "who int, at bigint").repartition(5)
    forest = cut(s.gap_forest(df, "who", "at", chunk))
    for gap in (0, 3, 30, 1_800):
        assert rows_of(s.cut_sessions(forest, gap)) == brute(rows, gap)


def test_gap_equal_to_threshold_stays_inside(spark):
    df = spark.createDataFrame([("a", 0), ("a", 1_800), ("a", 3_601)], "u string, t bigint")
    assert rows_of(s.sessions(df, "u", "t", 1_800)) == [("a", 0, 1_800, 1_800, 2), ("a", 3_601, 3_601, 0, 1)]


def test_empty_and_clashing_names(spark):
    df = spark.createDataFrame([], "u int, t bigint, entity string, ts string, n int, events int")
    assert s.sessions(df, "u", "t", 10).count() == 0
    df = spark.createDataFrame([(1, 5, "x", "y", 2, 3)], df.schema)
    assert rows_of(s.sessions(df, "u", "t", 10)) == [(1, 5, 5, 0, 1)]


def test_several_gaps_from_one_forest(spark):
    rows = [(1, t) for t in (0, 5, 20, 100)]
    df = spark.createDataFrame(rows, "u int, t bigint")
    found = s.sessions_for_gaps(df, "u", "t", [5, 15]).groupBy("gap").count().collect()
    assert {r["gap"]: r["count"] for r in found} == {5: 3, 15: 2}
