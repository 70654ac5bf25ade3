"""How often every distinct term occurs, over all and in how many records.

The distinct terms get dense integer ids in sorted order (the dictionary), and every occurrence is encoded by a join with
it. Each block of the encoded rows, a partition, is sorted by id and counted range by range: an array of occurrences and
one of record presence for each range of ids, one range in memory at a time. The arrays of a range are then added up,
position by position, again one range at a time, and each position is turned back into its term. A term that is
everywhere is one number in one array a block from there on.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ratelathe.operators.dense_ids import dense_ids
from ratelathe.session import broadcast_if_small, cut

#: Ids in a range, whose counts form one array.
RANGE_IDS = 4_096
ARRAYS = "range bigint, at array<int>, occurrences array<bigint>, records array<bigint>"


def clean_terms(values: Column) -> Column:
    """The terms among an array's entries: without outer spaces (U+0020), in lower case, without empty and null ones."""
    bare = F.transform(values, lambda x: F.lower(F.regexp_replace(x, r"\A +| +\z", "")))
    return F.filter(bare, lambda x: x.isNotNull() & (x != ""))


def _gather(batches: Iterator[pa.RecordBatch], dense: bool) -> Iterator[pa.RecordBatch]:
    """Adds up counts by range of ids, in whose order the rows come: of rows (id, occurrences, records), or of arrays if
    ``dense``. Only the arrays of the current range are held."""
    current, held = None, np.zeros((2, RANGE_IDS), np.int64)
    for batch in batches:
        if dense:
            sizes = np.diff(batch.column("at").offsets.to_numpy())
            ranges = np.repeat(batch.column("range").to_numpy(), sizes)
            at, a, b = (batch.column(c).flatten().to_numpy() for c in ("at", "occurrences", "records"))
        else:
            ids, a, b = (batch.column(c).to_numpy() for c in ("id", "occurrences", "records"))
            ranges, at = ids // RANGE_IDS, ids % RANGE_IDS
        edges = np.flatnonzero(np.diff(ranges)) + 1
        for lo, hi in zip([0, *edges], [*edges, len(ranges)]) if len(ranges) else ():
            if int(ranges[lo]) != current:
                if current is not None:
                    yield _arrays(current, held)
                current = int(ranges[lo])
                held[:] = 0
            held[0] += np.bincount(at[lo:hi], a[lo:hi], RANGE_IDS).astype(np.int64)
            held[1] += np.bincount(at[lo:hi], b[lo:hi], RANGE_IDS).astype(np.int64)
    if current is not None:
        yield _arrays(current, held)


def _arrays(number: int, held: np.ndarray) -> pa.RecordBatch:
    used = np.flatnonzero(held[0])
    lists = lambda x, kind: pa.array([x], pa.list_(kind))
    return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), lists(used.astype(np.int32), pa.int32()), lists(held[0][used], pa.int64()), lists(held[1][used], pa.int64())], names=["range", "at", "occurrences", "records"])


def term_counts(records: DataFrame) -> DataFrame:
    """``field_name, term_id, term, occurrences, records, field_records`` of ``records`` (``field_name`` string,
    ``terms`` array of strings; one row per record). ``field_records`` counts the field's records that have a term.
    Null and empty arrays and null terms count nowhere; repeated rows count each; no rows give no rows."""
    slim = records.select("field_name", F.filter("terms", lambda x: x.isNotNull()).alias("terms"))
    entry = lambda x, n, m: F.struct(x.alias("term"), F.lit(n).alias("occurrences"), F.lit(m).alias("records"))
    several = F.concat(F.transform("terms", lambda x: entry(x, 1, 0)), F.transform(F.array_distinct("terms"), lambda x: entry(x, 0, 1)))
    marks = F.when(F.size("terms") == 1, F.transform("terms", lambda x: entry(x, 1, 1))).otherwise(several)
    each = slim.select("field_name", F.explode(marks).alias("x")).select("field_name", "x.*")
    dictionary = cut(dense_ids(each.select("field_name", "term").distinct(), ["field_name", "term"], "id"))
    # A dictionary too large to broadcast is joined by shuffling; a term that is everywhere is then split by AQE.
    encoded = each.join(broadcast_if_small(dictionary), ["field_name", "term"]).select("id", "occurrences", "records")
    arrays = encoded.sortWithinPartitions("id").mapInArrow(lambda x: _gather(x, False), ARRAYS)
    arrays = arrays.repartition("range").sortWithinPartitions("range").mapInArrow(lambda x: _gather(x, True), ARRAYS)
    counted = arrays.select("range", F.explode(F.arrays_zip("at", "occurrences", "records")).alias("x"))
    counted = counted.select((F.col("range") * RANGE_IDS + F.col("x.at")).alias("id"), "x.occurrences", "x.records")
    # A row a field.
    fields = broadcast_if_small(cut(slim.filter(F.size("terms") > 0).groupBy("field_name").agg(F.count("*").alias("field_records"))))
    return dictionary.join(counted, "id").join(fields, "field_name").select("field_name", F.col("id").alias("term_id"), "term", "occurrences", "records", "field_records")


def mark_terms(counts: DataFrame, rare_records: int, common_share: float) -> DataFrame:
    """``counts`` with ``mark``: ``rare`` in at most ``rare_records`` records, ``common`` if not rare and in more than
    ``common_share`` of the field's records, else null."""
    # In decimals, so that a share that is met exactly is not exceeded.
    common = F.col("records") > F.lit(Decimal(str(common_share))) * F.col("field_records")
    return counts.withColumn("mark", F.when(F.col("records") <= rare_records, "rare").when(common, "common"))
