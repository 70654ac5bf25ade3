"""Fitting a model to ratings.

Parameters are rows of one table: ``part`` (bu, bi, p, q, x, y, pC, qC, xC, yC), ``id`` and ``f`` (array of double). The
ratings are dealt to blocks of a bounded number of rows; a user with more than a part of a block is spread over several,
so no user is too large for a task. A block's ratings and user lists are stored once, a block a partition, and do not
move again; nor do the parameters of its users, which stay in a file of the block. Only what blocks share (parameters of
items, clusters and users that are spread) is exchanged, through files of arrays in the folder that all executors share
(``arrays``), without a shuffle: in an epoch each block reads the shared parameters that it touches, takes its steps in
one task (``lane_epoch``) and writes its changes; then each range of parameters adds up what the blocks have changed,
damped by how far they would have gone together (``kernel``): parameters that few ratings touch move as in one block,
those that all blocks pull at are averaged. So an epoch holds a copy of the users' parameters before and after it, and
the changes of as many copies of the shared ones as there are blocks.

Backend ``exact`` has a single block that keeps its state over all epochs: plain sequential descent in a seeded order,
for data that one task can hold. It is taken on request only: ``auto`` means ``distributed`` at every size, so that the
size of the data never chooses the initialisation or the order of the steps.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratelathe.models.config import Config
from ratelathe.models.arrays import Folder, normals
from ratelathe.models.kernel import EMPTY, Histories, State, UserLists, epoch, lane_epoch, lanes_for
from ratelathe.operators import histories as index
from ratelathe.operators.clusters import Clusters
from ratelathe.operators.views import Ratings
from ratelathe.session import broadcast_if_small, cut, packed, release, shared_dir

#: Ratings in a block, on average, until there are SOME_BLOCKS blocks, which then grow up to BLOCK_MOST ratings before there
#: are more; a user with more than a block's share of ratings is spread over blocks.
BLOCK_ROWS, SOME_BLOCKS, BLOCK_MOST, USER_SHARE = 50_000, 12, 2_000_000, 4
#: Ids of a shared part in a file.
RANGE = 16_384
PARAMETERS = "part string, id int, f array<double>"
#: Labels looked through, per block, for one that Spark's hash puts into a partition of its own.
LABELS = 40


@dataclass(frozen=True)
class Indices:
    """Derived tables of the training rows; a missing one is built where a model needs it."""

    history: DataFrame | None = None
    explicit: DataFrame | None = None
    cluster_counts: DataFrame | None = None
    clusters: Clusters | None = None


@dataclass(frozen=True, eq=False)
class Model:
    """A fitted model: its parameters and the indices that its user contexts are made of."""

    config: Config
    parameters: DataFrame
    mean: float
    rating_min: float
    rating_max: float
    n_users: int
    n_items: int
    indices: Indices

    def table(self, part: str, key: str) -> DataFrame:
        """``key, f`` of one part."""
        return self.parameters.filter(F.col("part") == part).select(F.col("id").alias(key), "f")


def build_indices(data: Ratings, config: Config, given: Indices | None = None) -> Indices:
    """The indices a model needs: those given, after a check, or new ones."""
    given, parts = given or Indices(), config.parts
    history = explicit = counts = None
    if "y" in parts:
        history = given.history if given.history is not None else packed(index.history(data))
        if given.history is not None:
            index.validate_index(history, data.n_users)
    if "x" in parts:
        explicit = given.explicit if given.explicit is not None else packed(index.explicit_feedback(data))
        if given.explicit is not None:
            index.validate_index(explicit, data.n_users, "feedback")
    if "pC" in parts:
        if given.clusters is None:
            raise ValueError(f"{config.model} needs clusters")
        counts = given.cluster_counts if given.cluster_counts is not None else cut(index.cluster_counts(history, given.clusters.items))
    return Indices(history, explicit, counts, given.clusters)


def _sizes(config: Config, data: Ratings, clusters: Clusters | None) -> dict[str, int]:
    users, items = (clusters.n_user_clusters, clusters.n_item_clusters) if clusters else (0, 0)
    every = {"p": data.n_users, "q": data.n_items, "x": data.n_items, "y": data.n_items, "pC": users, "qC": items, "xC": items, "yC": items}
    return {k: every[k] for k in config.parts}


def _lists(frame: pd.DataFrame, n_users: int, explicit: bool) -> list[UserLists]:
    lists = [EMPTY] * n_users
    for row in frame.itertuples():
        items = np.asarray(row.items, np.int64)
        ratings = np.asarray(row.ratings, float) if explicit else None
        lists[row.at] = UserLists(items, ratings, np.asarray(row.clusters, np.int64), np.asarray(row.counts, float))
    return lists


def _user_rows(indices: Indices, spark, n_users: int) -> DataFrame:  # noqa: ANN001
    """``user_idx, items, ratings, clusters, counts``: what the step needs to know of a user."""
    users = spark.range(n_users).select(F.col("id").cast("int").alias("user_idx"))
    empty = {"items": "array<int>", "ratings": "array<double>", "clusters": "array<int>", "counts": "array<bigint>"}
    if indices.explicit is not None:
        feedback = F.col("feedback")
        users = users.join(indices.explicit.select("user_idx", feedback["item_idx"].alias("items"), feedback["rating"].alias("ratings")), "user_idx", "left")
    elif indices.history is not None:
        users = users.join(indices.history.select("user_idx", "items"), "user_idx", "left")
    if indices.cluster_counts is not None:
        lists = index.cluster_lists(indices.cluster_counts)
        users = users.join(lists.select("user_idx", F.col("clusters")["cluster_id"].alias("clusters"), F.col("clusters")["cnt"].alias("counts")), "user_idx", "left")
    missing = {c: F.expr(f"cast(array() as {t})") for c, t in empty.items() if c not in users.columns}
    return users.withColumns(missing).withColumns({c: F.coalesce(c, F.expr(f"cast(array() as {t})")) for c, t in empty.items()})


def fit(data: Ratings, config: Config, indices: Indices | None = None, block_rows: int = BLOCK_ROWS) -> Model:
    """Fits a model to all rows of ``data``, repeated ones included. ValueError for no rows."""
    spark = data.rows.sparkSession
    rows = data.rows.select("row_id", "user_idx", "item_idx", F.col("rating").cast(config.dtype.replace("float32", "float").replace("float64", "double")).cast("double").alias("rating"))
    n, mean = rows.agg(F.count("*"), F.avg("rating")).first()
    if not n:
        raise ValueError("no ratings to fit")
    indices = build_indices(data, config, indices)
    sizes = _sizes(config, data, indices.clusters)
    users = _user_rows(indices, spark, data.n_users)
    clusters = indices.clusters
    user_cluster = clusters.users if clusters else None
    item_cluster = clusters.items if clusters else None
    if config.backend == "exact":
        parameters = cut(_fit_in_one_task(rows, users, user_cluster, item_cluster, config, sizes, data, mean))
    else:
        parameters = _fit_in_blocks(rows, users, user_cluster, item_cluster, config, sizes, data, n, mean, block_rows)
    return Model(config, parameters, mean, data.rating_min, data.rating_max, data.n_users, data.n_items, indices)


def _fit_in_one_task(rows, users, user_cluster, item_cluster, config: Config, sizes: dict[str, int], data: Ratings, mean: float) -> DataFrame:  # noqa: ANN001
    """Sequential descent: vectors drawn part by part and the order shuffled again in each epoch, by one generator."""
    n_users, n_items = data.n_users, data.n_items
    kinds = rows.withColumn("kind", F.lit("r"))
    told = users.select(F.col("user_idx"), "items", "ratings", "clusters", "counts")
    if user_cluster is not None:
        told = told.join(user_cluster, "user_idx", "left")
    else:
        told = told.withColumn("cluster_id", F.lit(0))
    of_items = (item_cluster if item_cluster is not None else rows.select("item_idx").limit(0).withColumn("cluster_id", F.lit(0))).withColumn("one", F.lit(1))
    ratings = kinds.withColumn("one", F.lit(1))
    explicit = "x" in config.parts

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        left = left.sort_values("row_id")
        people = right[right["user_idx"] >= 0].rename(columns={"user_idx": "at"})
        things = right[right["item_idx"] >= 0]
        rng = np.random.default_rng(config.seed)
        state = State(mean, config.alpha, {"bu": np.zeros(n_users, config.dtype), "bi": np.zeros(n_items, config.dtype)})
        for part, n in sizes.items():
            state.values[part] = rng.normal(0.0, config.init_std, (n, config.latent_dim)).astype(config.dtype)
        lists = _lists(people, n_users, explicit)
        of_user, of_item = np.zeros(n_users, np.int64), np.zeros(n_items, np.int64)
        of_user[people["at"]] = people["cluster_id"].fillna(0)
        of_item[things["item_idx"]] = things["cluster_id"]
        order = np.arange(len(left))
        penalty = {"b": config.penalty("b")} | {k: config.penalty(k) for k in config.parts}
        arrays = [left[c].to_numpy() for c in ("user_idx", "item_idx", "rating")]
        for _ in range(config.epochs):
            rng.shuffle(order)
            epoch(state, order, *arrays, lists, of_user, of_item, config.learning_rate, penalty)
        return pd.concat([pd.DataFrame({"part": part, "id": np.arange(len(v), dtype=np.int32), "f": [np.atleast_1d(r).astype(float).tolist() for r in v]}) for part, v in state.values.items()])

    right = told.withColumn("item_idx", F.lit(-1)).unionByName(of_items.drop("one").withColumn("user_idx", F.lit(-1)), allowMissingColumns=True).withColumn("one", F.lit(1))
    return ratings.groupBy("one").cogroup(right.groupBy("one")).applyInPandas(run, PARAMETERS)


def _fit_in_blocks(rows, users, user_cluster, item_cluster, config: Config, sizes: dict[str, int], data: Ratings, n: int, mean: float, block_rows: int) -> DataFrame:  # noqa: ANN001
    """The parameters after all epochs, each of which all blocks take at the same time."""
    spark = rows.sparkSession
    blocks = max(-(-n // BLOCK_MOST), min(-(-n // block_rows), SOME_BLOCKS))
    limit = max(1, max(block_rows, -(-n // blocks)) // USER_SHARE)
    # As many users as there are shares of a block in all rows, at most.
    large = rows.groupBy("user_idx").agg(F.count("*").alias("n")).filter(F.col("n") > limit).select("user_idx", F.ceil(F.col("n") / limit).cast("int").alias("pieces")).collect()
    spread = np.array(sorted(r["user_idx"] for r in large), np.int64)
    placed = packed(_blocks(rows, blocks, spark.createDataFrame(large, "user_idx int, pieces int")))
    held = cut(_held(placed, users, user_cluster, item_cluster, config.parts, blocks))
    del placed
    release(spark)
    job = _Job(config, Folder.new(shared_dir(spark)), {"bi": data.n_items} | {"bu": len(spread)} | {p: len(spread) if p == "p" else n for p, n in sizes.items()}, spread, mean)
    try:
        with_rows = 0
        for number in range(config.epochs):
            with_rows = sum(r["n"] for r in held.mapInArrow(job.step(number), "block int, n bigint").collect())
            names = sorted(r["block"] for r in held.select("block").collect()) if not number else names
            tasks = job.ranges()
            _tasks(spark, len(tasks)).mapInArrow(job.settle(number, tasks, names), "id bigint").collect()
            job.folder.delete(f"{number}", f"changes-{number}")
        written = job.ranges() + [("own", name) for name in names]
        found = _tasks(spark, len(written), sum(job.n.values()) + with_rows * (1 + ("p" in sizes))).mapInArrow(job.rows(config.epochs, written), PARAMETERS)
        if with_rows + len(spread) < data.n_users:
            # Users without a rating are in no block.
            absent = spark.range(data.n_users).join(rows.select(F.col("user_idx").cast("long").alias("id")).distinct(), "id", "left_anti")
            found = found.unionByName(absent.mapInArrow(job.untouched(), PARAMETERS))
        return cut(found)
    finally:
        job.folder.delete("")


def _tasks(spark, n: int, rows: int = 0) -> DataFrame:  # noqa: ANN001
    """``id`` 0 ... n - 1, each in a task of its own; or more ids in n tasks, as many as the tasks will have ``rows``, by
    which Spark judges the size of a result."""
    return spark.range(0, max(n, rows), 1, n)


def _rows_of(part: str, ids: np.ndarray, values: np.ndarray) -> pa.RecordBatch:
    values = values.reshape(len(ids), -1)
    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(ids) + 1, dtype=np.int32) * values.shape[1]), pa.array(np.ascontiguousarray(values).ravel()))
    return pa.RecordBatch.from_arrays([pa.array([part] * len(ids), pa.string()), pa.array(np.asarray(ids), pa.int32()), lists], names=["part", "id", "f"])


@dataclass(frozen=True)
class _Job:
    """What the tasks of a fit's epochs do. ``n`` has the number of ids of each part that blocks share; those of users are
    places in ``spread``, the sorted users that are in several blocks. Files of epoch k: ``k/part-range`` (shared),
    ``k/own-part-block`` (users of a block), ``changes-k/part-block``."""

    config: Config
    folder: Folder
    n: dict[str, int]
    spread: np.ndarray
    mean: float

    def ranges(self) -> list[tuple[str, int]]:
        return [(part, k) for part, n in self.n.items() for k in range(-(-n // RANGE))]

    def _new(self, part: str, ids: np.ndarray) -> np.ndarray:
        """Biases 0 and normal vectors, made where they are needed from the seed, the part and the id."""
        return np.zeros((len(ids), 1)) if part in ("bu", "bi") else normals(self.config.seed, part, ids, self.config.latent_dim) * self.config.init_std

    def _ids(self, part: str, at: np.ndarray) -> np.ndarray:
        return self.spread[at] if part in ("bu", "p") else at

    def _shared(self, number: int, part: str, at: np.ndarray) -> np.ndarray:
        """The values of a shared part at the sorted places ``at``, read range by range."""
        if not number:
            return self._new(part, self._ids(part, at))
        found = []
        for k in np.unique(at // RANGE).tolist():
            lo, hi = np.searchsorted(at, [k * RANGE, (k + 1) * RANGE])
            found.append(self.folder.read(f"{number}/{part}-{k}")[2][at[lo:hi] - k * RANGE])
        return np.concatenate(found) if found else np.zeros((0, 1 if part in ("bu", "bi") else self.config.latent_dim))

    def step(self, number: int):  # noqa: ANN201
        """Takes each block of ``held`` through an epoch."""
        config, folder, parts = self.config, self.folder, self.config.parts
        explicit, listed, clustered = "x" in parts, "y" in parts, "pC" in parts

        def block(name: int, kept: dict[str, np.ndarray]) -> int:
            user_ids, item_ids = kept["user_ids"].astype(np.int64), kept["item_ids"].astype(np.int64)
            common = np.isin(user_ids, self.spread)
            own, among = user_ids[~common], np.searchsorted(self.spread, user_ids[common])
            state, at = State(self.mean, config.alpha), {}
            for part, n in self.n.items():
                if part in ("bu", "p"):
                    at[part] = among
                    kept_back = folder.read(f"{number}/own-{part}-{name}")[2] if number else self._new(part, own)
                    full = np.empty((len(user_ids), kept_back.shape[1]))
                    full[~common] = kept_back
                    full[common] = self._shared(number, part, among)
                else:
                    at[part] = item_ids if part in ("bi", "q", "x", "y") else np.arange(n)
                    full = self._shared(number, part, at[part])
                state.values[part] = full[:, 0].copy() if part in ("bu", "bi") else full
            before = {part: (m[common] if part in ("bu", "p") else m).copy() for part, m in state.values.items()}
            histories = Histories(kept["ends"], kept["history"], kept["told"] if explicit else None) if listed else None
            of_user, of_item = (kept["of_user"], kept["of_item"]) if clustered else (None, None)
            penalty = {"b": config.penalty("b")} | {k: config.penalty(k) for k in parts}
            rng = np.random.default_rng([config.seed, number, name])
            pulls = lane_epoch(state, kept["users"], kept["items"], kept["rating"], histories, of_user, of_item, config.learning_rate, penalty, rng, lanes_for(len(kept["rating"])))
            for part, m in state.values.items():
                pull = pulls[part]
                if part in ("bu", "p"):
                    folder.write(f"{number + 1}/own-{part}-{name}", own, None, m[~common])
                    m, pull = m[common], pull[common]
                moved = pull > 0
                folder.write(f"changes-{number}/{part}-{name}", at[part][moved], pull[moved], (m - before[part])[moved])
            return len(own)

        def run(batches):  # noqa: ANN001, ANN202
            for batch in batches:
                for k in range(batch.num_rows):
                    name = batch["block"][k].as_py()
                    n = block(name, {c: _array(batch[c][k].as_buffer(), kind) for c, kind in KEPT.items()})
                    yield pa.RecordBatch.from_arrays([pa.array([name], pa.int32()), pa.array([n], pa.int64())], names=["block", "n"])

        return run

    def settle(self, number: int, tasks: list[tuple[str, int]], blocks: list[int]):  # noqa: ANN201
        """Adds the blocks' changes to each shared parameter, damped by their pulls; one that no block moved stays."""

        def run(batches):  # noqa: ANN001, ANN202
            for batch in batches:
                for part, k in [tasks[t] for t in batch["id"].to_pylist()]:
                    at = np.arange(k * RANGE, min((k + 1) * RANGE, self.n[part]))
                    value = self._shared(number, part, at).copy()
                    moves, together, apart = np.zeros_like(value), np.zeros(len(at)), np.zeros(len(at))
                    for name in blocks:
                        ids, pull, change = self.folder.read(f"changes-{number}/{part}-{name}", at[0], at[-1] + 1)
                        where = ids - at[0]
                        moves[where] += change
                        together[where] += pull
                        apart[where] -= np.expm1(-pull)
                    value += moves * np.divide(-np.expm1(-together), apart, out=np.ones_like(apart), where=apart > 0)[:, None]
                    self.folder.write(f"{number + 1}/{part}-{k}", at, None, value)
                yield batch

        return run

    def rows(self, number: int, written: list[tuple[str, int]]):  # noqa: ANN201
        """``part, id, f`` of shared ranges and of the users of blocks."""

        def run(batches):  # noqa: ANN001, ANN202
            from pyspark import TaskContext

            for _ in batches:
                pass
            part, k = written[TaskContext.get().partitionId()]
            for name in [p for p in ("bu", "p") if p in self.n] if part == "own" else [part]:
                ids, _, values = self.folder.read(f"{number}/own-{name}-{k}" if part == "own" else f"{number}/{part}-{k}")
                ids = ids if part == "own" else self._ids(part, ids)
                for lo in range(0, len(ids), RANGE):
                    yield _rows_of(name, ids[lo : lo + RANGE], values[lo : lo + RANGE])

        return run

    def untouched(self):  # noqa: ANN201
        def run(batches):  # noqa: ANN001, ANN202
            for batch in batches:
                for part in [p for p in ("bu", "p") if p in self.n]:
                    ids = batch["id"].to_numpy()
                    yield _rows_of(part, ids, self._new(part, ids))

        return run


def _blocks(rows: DataFrame, blocks: int, pieces: DataFrame) -> DataFrame:
    """``rows`` with ``block``: a user's rows together, but those of the users in ``pieces`` in as many pieces. Blocks are
    named by numbers that Spark's hash puts into different ones of as many partitions."""
    spread = rows.join(broadcast_if_small(pieces), "user_idx", "left")
    piece = F.coalesce(F.pmod(F.hash("row_id"), F.col("pieces")), F.lit(0))
    number = F.pmod(F.hash(F.lit("block"), "user_idx", piece), F.lit(blocks))
    labels = rows.sparkSession.range(blocks * LABELS).select(F.col("id").cast("int").alias("label"))
    labels = labels.groupBy(F.pmod(F.hash("label"), F.lit(blocks)).alias("number")).agg(F.min("label").alias("block"))
    return spread.withColumn("number", number).join(broadcast_if_small(cut(labels)), "number").drop("pieces", "number")


#: What a block keeps over all epochs, as NumPy arrays in compressed bytes: the sorted ids of its users and items; users, items (as
#: places among these) and numbers of its ratings; where each user's history ends, its items and ratings; clusters.
KEPT = {"user_ids": "int32", "item_ids": "int32", "users": "int32", "items": "int32", "rating": "float64", "ends": "int64", "history": "int32", "told": "float64", "of_user": "int32", "of_item": "int32"}


def _held(placed, users, user_cluster, item_cluster, parts: list[str], blocks: int) -> DataFrame:  # noqa: ANN001
    """One row a block with what it keeps."""
    people = placed.select("block", "user_idx").distinct().join(users, "user_idx").select("block", "user_idx", "items", "ratings")
    if user_cluster is not None:
        people = people.join(user_cluster, "user_idx", "left")
    found = placed.withColumn("kind", F.lit("r")).unionByName(people.withColumn("kind", F.lit("u")), allowMissingColumns=True)
    if item_cluster is not None:
        listed = people.select("block", F.explode("items").alias("item_idx")) if "y" in parts else None
        things = placed.select("block", "item_idx")
        things = (things.unionByName(listed) if listed is not None else things).distinct().join(item_cluster, "item_idx").withColumn("kind", F.lit("i"))
        found = found.unionByName(things, allowMissingColumns=True)
    # Empty lists in place of null ones: Spark looks through all null lists of an Arrow batch again for each of its rows.
    found = found.withColumns({c: F.coalesce(c, F.expr(f"cast(array() as array<{t}>)")) for c, t in (("items", "int"), ("ratings", "double"))})
    clustered = item_cluster is not None

    def pack(key: tuple, table: pa.Table) -> pa.Table:
        import pyarrow.compute as pc

        kind = lambda name: table.filter(pc.equal(table["kind"], name))
        rated, people = kind("r").sort_by("row_id"), kind("u").sort_by("user_idx")
        sizes, listed = _flat(people["items"], np.int32)
        rated_items, user_ids = rated["item_idx"].to_numpy(), people["user_idx"].to_numpy()
        item_ids = np.union1d(rated_items, listed)
        kept = {
            "user_ids": user_ids,
            "item_ids": item_ids,
            "users": np.searchsorted(user_ids, rated["user_idx"].to_numpy()),
            "items": np.searchsorted(item_ids, rated_items),
            "rating": rated["rating"].to_numpy(),
            "ends": np.concatenate([[0], np.cumsum(sizes)]),
            "history": np.searchsorted(item_ids, listed),
            "told": _flat(people["ratings"], float)[1],
            "of_user": people["cluster_id"].to_numpy() if clustered else [],
            "of_item": kind("i").sort_by("item_idx")["cluster_id"].to_numpy() if clustered else [],
        }
        stored = [pa.array([_bytes(np.asarray(kept[name]).astype(type_))], pa.binary()) for name, type_ in KEPT.items()]
        return pa.table([pa.array([key[0].as_py()], pa.int32()), *stored], names=["block", *KEPT])

    return found.repartition(blocks, "block").groupBy("block").applyInArrow(pack, "block int, " + ", ".join(f"{name} binary" for name in KEPT))


def _flat(lists: pa.ChunkedArray | pa.Array, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """The lengths of the lists of a column and their values one behind the other."""
    column = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.diff(column.offsets.to_numpy())
    return sizes, column.flatten().to_numpy(zero_copy_only=False).astype(kind)


def _bytes(array: np.ndarray) -> bytes:
    """The array's size and its compressed bytes."""
    return array.nbytes.to_bytes(8, "little") + pa.compress(array.tobytes(), codec="zstd", asbytes=True)


def _array(stored: pa.Buffer, kind: str) -> np.ndarray:
    return np.frombuffer(pa.decompress(stored.slice(8), int.from_bytes(stored[:8], "little"), codec="zstd"), kind)
