"""Sessions of each entity's events, cut out of a Cartesian tree over the gaps between them.

``gap_forest`` sorts events by entity and time over ranges, so that one entity with a third of all rows spreads over as
many tasks as it has ranges, and writes a max-Cartesian tree over the gaps of each chunk: every node's gap is at least
as wide as those below it. ``merge_chunks`` merges the trees of an entity of several chunks into one: a tree over its
chunks, each with the wider of its widest inner gap and the gap to the next chunk, at whose nodes the chunks' own trees
hang. ``cut_sessions`` walks each tree from its root through gaps wider than the threshold only, that of the chunks
first, so that chunks without a cut are never opened; its cost follows the number of sessions and not of events, and
one forest serves any number of thresholds. Sessions that reach the edge of an entity's chunk are then joined with their
neighbours in the next one; these are two rows a chunk at most, so this last step is small however large an entity is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ratelathe.session import cut

#: Distinct timestamps in a chunk; it bounds the memory of a task and the length of an array.
CHUNK_ROWS = 65_536


#: Stands between trees that are built side by side: wider than any gap.
WALL = np.iinfo(np.int64).max


def _nearest(gaps: np.ndarray, step: int, passes: np.ufunc) -> np.ndarray:
    """The nearest place in the direction of ``step`` whose gap ends the reach of each place's own; -1 or beyond the end
    if there is none. Places jump over what others have jumped over before, all at once."""
    found = np.arange(len(gaps)) + step
    todo = np.flatnonzero((found >= 0) & (found < len(gaps)))
    while len(todo):
        at = found[todo]
        todo = todo[passes(gaps[at], gaps[todo])]
        found[todo] = found[found[todo]]
        todo = todo[(found[todo] >= 0) & (found[todo] < len(gaps))]
    return found


def gap_trees(gaps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Left and right child of each gap (-1: none) and whether it is a root, of the trees between walls. Of equally wide
    gaps, the first is the ancestor."""
    n = len(gaps)
    inner = gaps != WALL
    before, after = _nearest(gaps, -1, np.less), _nearest(gaps, 1, np.less_equal)
    wide = np.append(gaps, WALL)
    over, under = wide[np.where(before < 0, n, before)], wide[np.minimum(after, n)]
    # The lower one of the two wider neighbours is the parent; of equal ones that is the later.
    roots = inner & (over == WALL) & (under == WALL)
    of_after, of_before = inner & ~roots & (under <= over), inner & ~roots & (under > over)
    left, right = np.full(n, -1), np.full(n, -1)
    left[after[of_after]] = np.flatnonzero(of_after)
    right[before[of_before]] = np.flatnonzero(of_before)
    return left, right, roots


def wide_gaps(gaps, left, right, roots: np.ndarray, threshold: int) -> np.ndarray:  # noqa: ANN001
    """Ascending places of the gaps wider than the threshold, from the roots (-1: none) down, a level of all trees at a
    time; subtrees under a narrower gap are not visited."""
    found, level = [], np.asarray(roots)
    while True:
        level = level[level >= 0]
        level = level[gaps[level] > threshold]
        if not len(level):
            return np.sort(np.concatenate(found)) if found else np.zeros(0, np.int64)
        found.append(level)
        level = np.concatenate([left[level], right[level]])


def gap_forest(events: DataFrame, entity: str, ts: str, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """One row per entity and chunk of its timeline: ``entity``, ``ts`` and cumulative ``events`` of each distinct
    time, the tree's ``left``, ``right`` and ``root``, its ``widest`` gap (-1: none), and whether the chunk may go on before (``open_left``) or after
    it (``open_right``). Events with a null entity or time are left out; repeated events count as one time with several
    events. No events give no rows. Other columns are ignored whatever their names.
    """
    slim = events.select(F.col(entity).alias("entity"), F.col(ts).cast("long").alias("ts")).dropna()
    times = slim.groupBy("entity", "ts").agg(F.count("*").alias("n"))  # repeated records shrink before the shuffle
    ordered = times.repartitionByRange("entity", "ts").sortWithinPartitions("entity", "ts")
    kind = ordered.schema["entity"].dataType
    schema = T.StructType(
        [
            T.StructField("entity", kind),
            T.StructField("ts", T.ArrayType(T.LongType())),
            T.StructField("events", T.ArrayType(T.LongType())),
            T.StructField("left", T.ArrayType(T.IntegerType())),
            T.StructField("right", T.ArrayType(T.IntegerType())),
            T.StructField("root", T.IntegerType()),
            T.StructField("widest", T.LongType()),
            T.StructField("open_left", T.BooleanType()),
            T.StructField("open_right", T.BooleanType()),
        ]
    )

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry, first = None, True
        for batch in batches:
            if not batch.num_rows:
                continue
            block = pa.Table.from_batches([batch])
            block = pa.concat_tables([carry, block]) if carry is not None else block
            # All but the last entity are complete; the last one waits unless it fills a chunk.
            starts = _starts(block)
            done = int(starts[-1]) if len(block) - starts[-1] < chunk_rows else len(block)
            if done:
                yield _trees(block.slice(0, done), first, done == len(block), chunk_rows)
                first = done == len(block)
            carry = block.slice(done)
        if carry is not None and len(carry):
            yield _trees(carry, first, True, chunk_rows)

    return ordered.mapInArrow(build, schema)


def _starts(block: pa.Table) -> np.ndarray:
    codes = block["entity"].combine_chunks().dictionary_encode()
    codes = (codes.combine_chunks() if isinstance(codes, pa.ChunkedArray) else codes).indices.to_numpy()
    return np.concatenate([[0], np.flatnonzero(codes[1:] != codes[:-1]) + 1])


def _trees(block: pa.Table, open_left: bool, open_right: bool, chunk_rows: int) -> pa.RecordBatch:
    """Trees of whole entities, but that the first may have begun before and the last may go on."""
    entities = _starts(block)
    ends = np.append(entities[1:], len(block))
    pieces = [(a, min(a + chunk_rows, z), a > s, a + chunk_rows < z) for s, z in zip(entities, ends) for a in range(s, z, chunk_rows)]
    first, last, before, after = map(np.array, zip(*pieces))
    before, after = before.copy(), after.copy()
    before[0] |= open_left
    after[-1] |= open_right
    ts, n = block["ts"].to_numpy(), block["n"].to_numpy()
    total = np.concatenate([[0], np.cumsum(n)])
    # The trees of all pieces at once, with a wall between one piece and the next.
    gaps = np.diff(ts)
    gaps[last[:-1] - 1] = WALL
    left, right, rooted = gap_trees(gaps)
    starts = np.repeat(first, np.diff(np.append(first, len(ts))))[: len(gaps)]
    inner = gaps != WALL
    left, right = (np.where(x >= 0, x - starts, -1)[inner] for x in (left, right))
    at_root = np.flatnonzero(rooted)
    roots, widest = np.full(len(first), -1), np.full(len(first), -1)
    piece = np.searchsorted(first, at_root, side="right") - 1
    roots[piece], widest[piece] = at_root - first[piece], gaps[at_root]
    sizes = last - first
    events = total[1:] - np.repeat(total[first], sizes)
    offsets, inner = np.append(0, np.cumsum(sizes)), np.append(0, np.cumsum(sizes - 1))
    lists = lambda at, values, kind: pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(values, kind))
    return pa.RecordBatch.from_arrays(
        [
            block["entity"].combine_chunks().take(pa.array(first)),
            lists(offsets, ts, pa.int64()),
            lists(offsets, events, pa.int64()),
            lists(inner, left, pa.int32()),
            lists(inner, right, pa.int32()),
            pa.array(roots, pa.int32()),
            pa.array(widest, pa.int64()),
            pa.array(before),
            pa.array(after),
        ],
        names=["entity", "ts", "events", "left", "right", "root", "widest", "open_left", "open_right"],
    )


def _cut_chunks(forest: DataFrame, threshold: int) -> DataFrame:
    kind = forest.schema["entity"].dataType
    schema = T.StructType([T.StructField("entity", kind)] + [T.StructField(c, T.LongType()) for c in ("start_ts", "end_ts", "events")] + [T.StructField("edge", T.BooleanType())])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            column = {n: batch.column(n) for n in batch.schema.names}
            flat = {n: column[n].flatten().to_numpy() for n in ("ts", "events", "left", "right")}
            at = column["ts"].offsets.to_numpy() - column["ts"].offsets[0].as_py()
            sizes, root = np.diff(at), column["root"].to_numpy()
            # Gaps and children by the place of the time before the gap; a chunk's last time has none.
            gaps, last = np.diff(flat["ts"], append=0), at[1:] - 1
            node = np.ones(len(gaps), bool)
            node[last] = False
            left, right = (np.full(len(gaps), -1) for _ in range(2))
            base = np.repeat(at[:-1], sizes)[node]
            left[node], right[node] = (np.where(flat[x] >= 0, flat[x] + base, -1) for x in ("left", "right"))
            wide = wide_gaps(gaps, left, right, np.where(root >= 0, root + at[:-1], -1), threshold)
            a = np.sort(np.concatenate([at[:-1], wide + 1]))
            z = np.append(a[1:], len(gaps)) - 1
            rows = np.searchsorted(at, a, side="right") - 1
            before, after = (column[x].to_numpy(zero_copy_only=False) for x in ("open_left", "open_right"))
            edge = (a == at[rows]) & before[rows] | (z == last[rows]) & after[rows]
            earlier = np.where(a > at[rows], flat["events"][np.maximum(a - 1, 0)], 0)
            yield pa.RecordBatch.from_arrays(
                [column["entity"].take(pa.array(rows)), pa.array(flat["ts"][a]), pa.array(flat["ts"][z]), pa.array(flat["events"][z] - earlier), pa.array(edge)],
                names=["entity", "start_ts", "end_ts", "events", "edge"],
            )

    return forest.mapInArrow(walk, schema)


def merge_chunks(forest: DataFrame) -> DataFrame:
    """One row per entity of several chunks, with its chunks in order: ``first``, ``last`` time and ``events`` of each,
    ``weight`` (its widest inner gap or the gap to the next chunk, the wider one) and the tree over the weights. An
    entity has a slim row for each chunk here, one for 65 536 distinct times."""
    chunks = forest.filter("open_left or open_right").select("entity", F.col("ts")[0].alias("first"), F.element_at("ts", -1).alias("last"), F.element_at("events", -1).alias("events"), "widest")
    kind = forest.schema["entity"].dataType
    longs = ("first", "last", "events", "weight", "left", "right")
    schema = T.StructType([T.StructField("entity", kind)] + [T.StructField(c, T.ArrayType(T.LongType())) for c in longs] + [T.StructField("root", T.LongType())])

    def merge(table: pa.Table) -> pa.Table:
        table = table.sort_by("first")
        first, last, widest = (table[c].to_numpy() for c in ("first", "last", "widest"))
        weight = np.maximum(widest, np.append(first[1:] - last[:-1], -1))
        left, right, roots = gap_trees(weight)
        values = [first, last, table["events"].to_numpy(), weight, left, right]
        return pa.table([table["entity"].slice(0, 1), *(pa.array([v], pa.list_(pa.int64())) for v in values), pa.array(np.flatnonzero(roots))], names=schema.names)

    return chunks.groupBy("entity").applyInArrow(merge, schema)


def _opened(merged: DataFrame, threshold: int) -> DataFrame:
    """``entity, first, last, events, opened``: every chunk in merged trees, and whether the walk from the root reaches it."""
    kind = merged.schema["entity"].dataType
    schema = T.StructType([T.StructField("entity", kind)] + [T.StructField(c, T.LongType()) for c in ("first", "last", "events")] + [T.StructField("opened", T.BooleanType())])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                of = lambda c: batch.column(c)[k].values.to_numpy()  # noqa: B023, E731
                opened = np.zeros(len(of("first")), bool)
                opened[wide_gaps(of("weight"), of("left"), of("right"), np.array([batch.column("root")[k].as_py()]), threshold)] = True
                entity = batch.column("entity").take(pa.array(np.full(len(opened), k)))
                yield pa.RecordBatch.from_arrays([entity, *(pa.array(of(c)) for c in ("first", "last", "events")), pa.array(opened)], names=schema.names)

    return merged.mapInArrow(walk, schema)


def cut_sessions(forest: DataFrame, threshold: int, merged: DataFrame | None = None) -> DataFrame:
    """Sessions of a forest: ``entity, session_start, session_end, duration, events``. A new session begins where the
    gap is wider than ``threshold`` (a gap equal to it stays inside). A single event is a session of duration 0. Give a
    forest that was stored with ``cut``, as it is read again for the chunks that are opened, and ``merge_chunks`` of it
    where several thresholds are cut."""
    apart = "open_left or open_right"
    chunks = _opened(merge_chunks(forest) if merged is None else merged, threshold)
    shut = chunks.filter("not opened").select("entity", F.col("first").alias("start_ts"), F.col("last").alias("end_ts"), "events")
    keys = chunks.filter("opened").select(F.col("entity").alias("of"), "first")
    reached = forest.filter(apart)
    reached = reached.join(keys, (reached["entity"] == keys["of"]) & (reached["ts"][0] == keys["first"]), "left_semi")
    pieces = _cut_chunks(reached, threshold)
    whole = _cut_chunks(forest.filter(f"not ({apart})"), threshold).unionByName(pieces.filter("not edge"))
    edges = pieces.filter("edge").drop("edge").unionByName(shut)
    order = Window.partitionBy("entity").orderBy("start_ts")
    new = F.col("start_ts") - F.lag("end_ts").over(order) > threshold
    numbered = edges.withColumn("new", F.coalesce(new, F.lit(True)).cast("int")).withColumn("session", F.sum("new").over(order))
    joined = numbered.groupBy("entity", "session").agg(F.min("start_ts").alias("start_ts"), F.max("end_ts").alias("end_ts"), F.sum("events").alias("events"))
    both = whole.select("entity", "start_ts", "end_ts", "events").unionByName(joined.drop("session"))
    return both.select("entity", F.col("start_ts").alias("session_start"), F.col("end_ts").alias("session_end"), (F.col("end_ts") - F.col("start_ts")).alias("duration"), "events")


def sessions(events: DataFrame, entity: str, ts: str, threshold: int, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """``cut_sessions`` of the ``gap_forest`` of ``events``, which is stored on the way."""
    return cut_sessions(cut(gap_forest(events, entity, ts, chunk_rows)), threshold)


def sessions_for_gaps(events: DataFrame, entity: str, ts: str, thresholds: list[int], chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """The sessions for each of several thresholds from one forest, with the threshold in ``gap``."""
    forest = cut(gap_forest(events, entity, ts, chunk_rows))
    out, merged = None, cut(merge_chunks(forest))
    for gap in thresholds:
        part = cut_sessions(forest, gap, merged).withColumn("gap", F.lit(gap).cast("long"))
        out = part if out is None else out.unionByName(part)
    return out
