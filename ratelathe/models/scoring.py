"""Predictions of a fitted model, as joins with its parameter tables.

Each user's context is computed once (``contexts``), each item's vector once (``item_vectors``); a prediction is then two
joins and a dot product, however many pairs are asked for. A model that predicts again keeps both, stored, as long as it
lives (``kept``); a new fit is a new model. Vectors of items are no part of a shuffle where a task can hold them: tasks
read them from files (``_at_hand``), add up users' lists and multiply.
"""

from __future__ import annotations

import atexit
from dataclasses import replace
from weakref import WeakKeyDictionary

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ratelathe.functions import vectors
from ratelathe.functions.scalars import clipped
from ratelathe.models.arrays import Folder
from ratelathe.models.fit import Model
from ratelathe.session import broadcast_if_small, cut, shared_dir

#: Contexts and item vectors of models that have predicted before; None after the first time.
_KEPT: WeakKeyDictionary = WeakKeyDictionary()
#: Folders with vectors of models' items, by part; in a worker, what was read of the last ones.
_AT_HAND: WeakKeyDictionary = WeakKeyDictionary()
_READ: dict[Folder, tuple[np.ndarray, np.ndarray]] = {}
#: Items up to which their vectors may be broadcast; bytes of a part's vectors that a task may hold; list entries looked up at once.
BROADCAST_ITEMS, HELD_BYTES, ENTRIES = 100_000, 256 << 20, 65_536


def kept(model: Model) -> tuple[DataFrame, DataFrame]:
    """The model's contexts and item vectors: lazy ones at its first use, stored ones from the second on."""
    if model not in _KEPT:
        _KEPT[model] = None
        return contexts(model), item_vectors(model)
    if _KEPT[model] is None:
        _KEPT[model] = (cut(contexts(model)), cut(item_vectors(model)))
    return _KEPT[model]


def item_vectors(model: Model) -> DataFrame:
    """``item_idx, item_bias, v``: an item's bias and its vector, mixed with its cluster's where the model has clusters."""
    bias = model.table("bi", "item_idx").select("item_idx", F.col("f")[0].alias("item_bias"))
    q = model.table("q", "item_idx").select("item_idx", F.col("f").alias("v"))
    if model.indices.clusters:
        qc = model.table("qC", "cluster_id").withColumnRenamed("f", "c")
        mixed = q.join(model.indices.clusters.items, "item_idx").join(qc, "cluster_id")
        q = mixed.select("item_idx", vectors.mix(F.col("v"), F.col("c"), model.config.alpha).alias("v"))
    return bias.join(q, "item_idx")


def _sum_over(pairs: DataFrame, weight) -> DataFrame:  # noqa: ANN001
    """``user_idx, total``: the weighted sum of the vectors ``f`` of each user's pairs, added up in the JVM."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    scaled = pairs.select("user_idx", array_to_vector(vectors.scaled(F.col("f"), weight)).alias("v"))
    return scaled.groupBy("user_idx").agg(vector_to_array(Summarizer.sum(F.col("v"))).alias("total"))


def _fits_a_task(model: Model) -> bool:
    return model.n_items * model.config.latent_dim * 8 <= HELD_BYTES


def _at_hand(model: Model, part: str) -> Folder:
    """The folder with ``part``'s vectors and biases of all items, those of x, y and q mixed with their clusters', which
    tasks read in full in place of joining. It is kept until the model is forgotten or the program ends."""
    found = _AT_HAND.setdefault(model, {})
    if part not in found:
        vectors_ = model.table(part, "item_idx")
        if model.indices.clusters and part != "bi":
            of_cluster = model.table(f"{part}C", "cluster_id").withColumnRenamed("f", "c")
            mixed = vectors_.join(model.indices.clusters.items, "item_idx").join(of_cluster, "cluster_id")
            vectors_ = mixed.select("item_idx", vectors.mix(F.col("f"), F.col("c"), model.config.alpha).alias("f"))
        folder = found[part] = Folder.new(shared_dir(vectors_.sparkSession), "vectors")
        atexit.register(folder.delete, "")
        write = lambda batches: _written(folder, batches)
        vectors_.mapInArrow(write, "name string").collect()
    return found[part]


def forget(model: Model) -> None:
    """Deletes what predictions keep of the model; those not yet computed can't be any more."""
    for folder in _AT_HAND.pop(model, {}).values():
        folder.delete("")
        atexit.unregister(folder.delete)
    _KEPT.pop(model, None)


def _written(folder: Folder, batches):  # noqa: ANN001, ANN202
    from pyspark import TaskContext

    for k, batch in enumerate(batches):
        if batch.num_rows:
            name = f"{TaskContext.get().partitionId()}-{k}"
            folder.write(name, batch.column(0).to_numpy(), None, batch.column(1).flatten().to_numpy().reshape(batch.num_rows, -1))
            yield pa.RecordBatch.from_arrays([pa.array([name])], names=["name"])


def _matrix(folder: Folder, n: int) -> tuple[np.ndarray, np.ndarray]:
    """All vectors of a folder, by item, and which items have one; of the last few folders they stay in the worker."""
    if folder not in _READ:
        while len(_READ) >= 3:
            del _READ[next(iter(_READ))]
        full, known = None, np.zeros(n, bool)
        for name in folder.names():
            ids, _, found = folder.read(name)
            full = np.zeros((n, found.shape[1])) if full is None else full
            full[ids], known[ids] = found, True
        _READ[folder] = (full if full is not None else np.zeros((n, 1)), known)
    return _READ[folder]


def _list_sums(model: Model, lists: DataFrame, part: str) -> DataFrame:
    """``user_idx, total``: the sums of ``part``'s vectors over each user's ``items``, weighted by ``weights`` plus
    ``of_bias`` times the item's bias."""
    folder, bias, n, width = _at_hand(model, part), _at_hand(model, "bi") if part == "x" else None, model.n_items, model.config.latent_dim

    def run(batches):  # noqa: ANN001, ANN202
        for batch in batches:
            matrix = _matrix(folder, n)[0]
            items = batch["items"].flatten().to_numpy()
            weights = batch["weights"].flatten().to_numpy()
            lane = np.repeat(np.arange(batch.num_rows), np.diff(batch["items"].offsets.to_numpy()))
            if bias is not None:
                weights = weights + batch["of_bias"].to_numpy()[lane] * _matrix(bias, n)[0][items, 0]
            total = np.zeros((batch.num_rows, width))
            for lo in range(0, len(items), ENTRIES):
                hi = lo + ENTRIES
                starts = np.flatnonzero(np.diff(lane[lo:hi], prepend=-1))
                total[lane[lo:hi][starts]] += np.add.reduceat(matrix[items[lo:hi]] * weights[lo:hi, None], starts)
            rows = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * width), pa.array(total.ravel()))
            yield pa.RecordBatch.from_arrays([batch["user_idx"], rows], names=["user_idx", "total"])

    return lists.mapInArrow(run, "user_idx int, total array<double>")


def contexts(model: Model, asked: DataFrame | None = None) -> DataFrame:
    """``user_idx, user_bias, z``: each user's bias and context vector, from the final parameters; only of the distinct
    users ``asked`` for (``user_idx``) if given, whose lists alone are then read."""
    config, parts, ix = model.config, model.config.parts, model.indices
    of = lambda df: df if asked is None else df.join(asked, "user_idx", "left_semi")
    own, alpha = (1 - config.alpha, config.alpha) if ix.clusters else (1.0, 0.0)
    bias = of(model.table("bu", "user_idx")).select("user_idx", F.col("f")[0].alias("user_bias"))
    sums = []
    if "p" in parts:
        p = of(model.table("p", "user_idx"))
        sums.append(p.select("user_idx", vectors.scaled(F.col("f"), F.lit(own)).alias("total")))
    if ix.clusters:
        pc = of(ix.clusters.users).join(model.table("pC", "cluster_id"), "cluster_id")
        sums.append(pc.select("user_idx", vectors.scaled(F.col("f"), F.lit(alpha)).alias("total")))
    near = _fits_a_task(model)
    if near and "x" in parts:
        listed = of(ix.explicit).select("user_idx", "norm", F.col("feedback")["item_idx"].alias("items"), F.col("feedback")["rating"].alias("ratings")).join(bias, "user_idx")
        weight = F.transform("ratings", lambda r: F.col("norm") * (r - (F.lit(model.mean) + F.col("user_bias"))))
        sums.append(_list_sums(model, listed.select("user_idx", "items", weight.alias("weights"), (-F.col("norm")).alias("of_bias")), "x"))
    elif "x" in parts:
        item_bias = model.table("bi", "item_idx").select("item_idx", F.col("f")[0].alias("item_bias"))
        pairs = of(ix.explicit).select("user_idx", "norm", F.explode("feedback").alias("e")).select("user_idx", "norm", "e.*").join(bias, "user_idx").join(item_bias, "item_idx")
        weight = F.col("norm") * (F.col("rating") - (F.lit(model.mean) + F.col("user_bias") + F.col("item_bias")))
        weighted = pairs.select("user_idx", "item_idx", weight.alias("w"))
        sums.append(_sum_over(weighted.join(model.table("x", "item_idx"), "item_idx"), F.col("w") * own))
        if ix.clusters:
            sums.append(_sum_over(weighted.join(ix.clusters.items, "item_idx").join(model.table("xC", "cluster_id"), "cluster_id"), F.col("w") * alpha))
    if near and "y" in parts:
        weight = F.array_repeat(F.col("norm"), F.size("items"))
        sums.append(_list_sums(model, of(ix.history).select("user_idx", "items", weight.alias("weights"), F.lit(0.0).alias("of_bias")), "y"))
    elif "y" in parts:
        pairs = of(ix.history).select("user_idx", "norm", F.explode("items").alias("item_idx"))
        sums.append(_sum_over(pairs.join(model.table("y", "item_idx"), "item_idx"), F.col("norm") * own))
        if ix.clusters:
            counts = of(ix.cluster_counts).join(ix.history.select("user_idx", "norm"), "user_idx").join(model.table("yC", "cluster_id"), "cluster_id")
            sums.append(_sum_over(counts, F.col("norm") * F.col("cnt") * alpha))
    zero = F.array_repeat(F.lit(0.0), config.latent_dim)
    found = bias.withColumn("z", zero)
    for s in sums:
        found = found.join(s, "user_idx", "left").withColumn("z", vectors.added(F.col("z"), F.coalesce("total", zero))).drop("total")
    return found


def predict(model: Model, pairs: DataFrame, clip: bool = True, ready: DataFrame | None = None) -> DataFrame:
    """``pairs`` (with ``user_idx, item_idx``) with ``prediction``; within the range of ratings if ``clip``. Ids that the
    model does not know are an error in no case: their prediction is null. ``ready`` are contexts stored before."""
    users, items = (ready, item_vectors(model)) if ready is not None else kept(model)
    joined = pairs.join(users, "user_idx", "left")
    if model.n_items > BROADCAST_ITEMS and _fits_a_task(model):
        # Joined by item, every pair would be shuffled with its user's context.
        raw = F.lit(model.mean) + F.col("user_bias") + F.col("__rest")
        joined = _with_products(model, joined)
    else:
        joined = joined.join(broadcast_if_small(items, BROADCAST_ITEMS), "item_idx", "left")
        raw = F.lit(model.mean) + F.col("user_bias") + F.col("item_bias") + vectors.dot(F.col("z"), F.col("v"))
    if clip:
        raw = clipped(raw, F.lit(model.rating_min), F.lit(model.rating_max))
    return joined.withColumn("prediction", raw).drop("user_bias", "item_bias", "z", "v", "__rest")


def _with_products(model: Model, joined: DataFrame) -> DataFrame:
    """``joined`` with ``__rest`` in place of ``z``: the item's bias and the product of the vectors; null where one is missing."""
    folder, bias, n = _at_hand(model, "q"), _at_hand(model, "bi"), model.n_items
    kept_columns = [c for c in joined.columns if c != "z"]
    schema = T.StructType([*[joined.schema[c] for c in kept_columns], T.StructField("__rest", T.DoubleType())])

    def run(batches):  # noqa: ANN001, ANN202
        for batch in batches:
            (q, known), (b, _) = _matrix(folder, n), _matrix(bias, n)
            items = batch["item_idx"].fill_null(-1).to_numpy()
            some = (items >= 0) & (items < n) & batch["z"].is_valid().to_numpy(zero_copy_only=False)
            some[some] = known[items[some]]
            at, rest = items[some], np.full(len(items), np.nan)
            z = batch["z"].filter(pa.array(some)).flatten().to_numpy().reshape(len(at), -1)
            rest[some] = b[at, 0] + np.einsum("ij,ij->i", z, q[at])
            yield pa.RecordBatch.from_arrays([*[batch[c] for c in kept_columns], pa.array(rest, mask=~some)], names=schema.names)

    return joined.mapInArrow(run, schema)


def predict_one(model: Model, user: int, item: int, clip: bool = True) -> float | None:
    spark = model.parameters.sparkSession
    return predict(model, spark.createDataFrame([(user, item)], "user_idx int, item_idx int"), clip).first()["prediction"]


def without_clusters(model: Model) -> Model:
    """The same parameters read with alpha 0: what the model would predict without its clusters."""
    return replace(model, config=replace(model.config, alpha=0.0))


def cluster_contribution(model: Model, pairs: DataFrame) -> DataFrame:
    """One row: ``mean_abs_contribution, max_abs_contribution, measured`` of the clusters' share in unclipped predictions."""
    both = predict(model, pairs.select("row_id", "user_idx", "item_idx"), False).withColumnRenamed("prediction", "with")
    other = predict(without_clusters(model), pairs.select("row_id", "user_idx", "item_idx"), False).select("row_id", F.col("prediction").alias("without"))
    gap = F.abs(F.col("with") - F.col("without"))
    return both.join(other, "row_id").agg(F.avg(gap).alias("mean_abs_contribution"), F.max(gap).alias("max_abs_contribution"), (F.max(gap) > 1e-12).alias("measured"))


def parameter_bytes(model: Model) -> int:
    """Bytes of all parameters in the model's type."""
    n = model.parameters.agg(F.coalesce(F.sum(F.size("f")), F.lit(0))).first()[0]
    return n * (4 if model.config.dtype == "float32" else 8)
