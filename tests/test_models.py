import os
import time
from dataclasses import replace

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from ratelathe.functions import metrics
from ratelathe.models import config as cfg
from ratelathe.models import fit, scoring
from ratelathe.models.arrays import Folder, normals
from ratelathe.models.kernel import Histories, State, UserLists, epoch, lane_epoch
from ratelathe.operators import clusters as cl
from ratelathe.operators.views import Ratings
from ratelathe.session import packed, release, shared_dir

PENALTIES = {"b": 0.01, "p": 0.02, "q": 0.03, "x": 0.04, "y": 0.05, "pC": 0.06, "qC": 0.07, "xC": 0.08, "yC": 0.09}


def scalar_epoch(state, order, users, items, ratings, lists, uc, ic, rate, pen):
    """The update rules written out number by number, for one model and one epoch."""
    v, a, dim = state.values, state.alpha, state.values["q"].shape[1]
    clustered = "qC" in v
    o = 1 - a if clustered else 1.0
    for k in order:
        u, i, r = users[k], items[k], ratings[k]
        hist, norm = lists[u].items, 1 / np.sqrt(len(lists[u].items))
        bu, bi = v["bu"][u], v["bi"][i]
        q = v["q"][i].copy()
        mixed = [o * q[f] + (a * v["qC"][ic[i]][f] if clustered else 0) for f in range(dim)]
        w = [norm * (lists[u].ratings[n] - (state.mean + bu + v["bi"][j])) for n, j in enumerate(hist)] if "x" in v else []
        z = []
        for f in range(dim):
            s = (o * v["p"][u][f] if "p" in v else 0) + (a * v["pC"][uc[u]][f] if clustered else 0)
            for n, j in enumerate(hist):
                if "x" in v:
                    s += w[n] * (o * v["x"][j][f] + (a * v["xC"][ic[j]][f] if clustered else 0))
                if "y" in v:
                    s += norm * o * v["y"][j][f]
            if clustered and "y" in v:
                s += sum(norm * a * n * v["yC"][c][f] for c, n in zip(lists[u].clusters, lists[u].counts))
            z.append(s)
        e = r - (state.mean + bu + bi + sum(m * c for m, c in zip(mixed, z)))
        v["bu"][u] += rate * (e - pen["b"] * bu)
        v["bi"][i] += rate * (e - pen["b"] * bi)
        for f in range(dim):
            if "p" in v:
                v["p"][u][f] += rate * (e * o * mixed[f] - pen["p"] * v["p"][u][f])
            v["q"][i][f] += rate * (e * o * z[f] - pen["q"] * q[f])
            if clustered:
                v["pC"][uc[u]][f] += rate * (e * a * mixed[f] - pen["pC"] * v["pC"][uc[u]][f])
                v["qC"][ic[i]][f] += rate * (e * a * z[f] - pen["qC"] * v["qC"][ic[i]][f])
            for n, j in enumerate(hist):
                if "x" in v:
                    v["x"][j][f] += rate * (e * o * w[n] * mixed[f] - pen["x"] * v["x"][j][f])
                    if clustered:
                        c = ic[j]
                        v["xC"][c][f] += rate * (e * a * w[n] * mixed[f] - pen["xC"] * v["xC"][c][f])
                if "y" in v:
                    v["y"][j][f] += rate * (e * norm * o * mixed[f] - pen["y"] * v["y"][j][f])
            if clustered and "y" in v:
                for c, n in zip(lists[u].clusters, lists[u].counts):
                    v["yC"][c][f] += rate * (e * norm * a * n * mixed[f] - pen["yC"] * v["yC"][c][f])


@pytest.mark.parametrize("name", cfg.PARTS)
def test_kernel_against_scalars(name):
    rng = np.random.default_rng(3)
    n_users, n_items, n = 4, 5, 12
    users, items = rng.integers(0, n_users, n), rng.integers(0, n_items, n)
    ratings = rng.integers(1, 11, n) / 2
    uc, ic = np.array([0, 1, 0, 1]), np.array([0, 1, 1, 2, 2])
    lists = []
    for u in range(n_users):
        mine = np.array(sorted({int(i) for i, v in zip(items, users) if v == u}) or [0])
        c, k = np.unique(ic[mine], return_counts=True)
        lists.append(UserLists(mine, np.array([ratings[(users == u) & (items == i)][0] if ((users == u) & (items == i)).any() else 3.0 for i in mine]), c, k.astype(float)))
    rows = {"p": n_users, "q": n_items, "x": n_items, "y": n_items, "pC": 2, "qC": 3, "xC": 3, "yC": 3}
    make = lambda: State(3.1, 0.2 if "cb" in name else 0.0, {"bu": np.zeros(n_users), "bi": np.zeros(n_items)} | {p: np.random.default_rng(len(p) + ord(p[0])).normal(0, 0.1, (rows[p], 3)) for p in cfg.PARTS[name].split()})
    one, two = make(), make()
    for number in range(3):
        order = np.random.default_rng(number).permutation(n)
        epoch(one, order, users, items, ratings, lists, uc, ic, 0.05, PENALTIES)
        scalar_epoch(two, order, users, items, ratings, lists, uc, ic, 0.05, PENALTIES)
    for part in one.values:
        assert np.allclose(one.values[part], two.values[part], atol=1e-9), part


RATINGS = "/root/testdata/sf0.001/ratings.parquet"


@pytest.mark.skipif(not os.path.exists(RATINGS), reason="needs the test tables")
@pytest.mark.parametrize("name", cfg.PARTS)
def test_eight_blocks_predict_as_sequential_descent(name):
    """Held-out error after 20 epochs: blocks with damped changes against one step after the other."""
    table = pq.read_table(RATINGS).to_pandas().dropna()
    users, items = (np.unique(table[c], return_inverse=True)[1] for c in ("raw_user_id", "raw_item_id"))
    ratings, n_users, n_items, blocks, dim = table["rating"].to_numpy(), users.max() + 1, items.max() + 1, 8, 8
    held_out = np.random.default_rng(0).random(len(users)) < 0.1
    u, i, r = users[~held_out], items[~held_out], ratings[~held_out]
    order = np.lexsort((i, u))
    ends = np.concatenate([[0], np.cumsum(np.bincount(u, minlength=n_users))])
    histories = Histories(ends, i[order], r[order])
    uc, ic = np.arange(n_users) % 3, np.arange(n_items) % 4
    lists = []
    for k in range(n_users):
        mine = histories.items[ends[k] : ends[k + 1]]
        lists.append(UserLists(mine, histories.ratings[ends[k] : ends[k + 1]], *[x.astype(t) for x, t in zip(np.unique(ic[mine], return_counts=True), (np.int64, float))]))
    rows = {"p": n_users, "q": n_items, "x": n_items, "y": n_items, "pC": 3, "qC": 4, "xC": 4, "yC": 4}
    penalty = dict.fromkeys(PENALTIES, 0.02)

    def state():
        rng = np.random.default_rng(4)
        return State(r.mean(), 0.2 if "cb" in name else 0.0, {"bu": np.zeros(n_users), "bi": np.zeros(n_items)} | {p: rng.normal(0, 0.1, (rows[p], dim)) for p in cfg.PARTS[name].split()})

    def error(s):
        """A step of rate 0 leaves the state; the error it would take is that of a prediction."""
        v, a, c = s.values, s.alpha, "qC" in s.values
        own, z = 1 - a if c else 1.0, np.zeros((n_users, dim))
        for k, one in enumerate(lists):
            n = 1 / np.sqrt(max(len(one.items), 1))
            if "p" in v:
                z[k] += own * v["p"][k]
            if c:
                z[k] += a * v["pC"][uc[k]]
            for part, weights in (("x", n * (one.ratings - s.mean - v["bu"][k] - v["bi"][one.items])), ("y", np.full(len(one.items), n))):
                if part in v:
                    z[k] += weights @ (own * v[part][one.items] + (a * v[part + "C"][ic[one.items]] if c else 0))
        q = own * v["q"] + (a * v["qC"][ic] if c else 0)
        found = s.mean + v["bu"][users] + v["bi"][items] + (z[users] * q[items]).sum(axis=1)
        return np.sqrt(np.mean((np.clip(found, 0.5, 5) - ratings)[held_out] ** 2))

    one, rng, order = state(), np.random.default_rng(5), np.arange(len(u))
    for _ in range(20):
        rng.shuffle(order)
        epoch(one, order, u, i, r, lists, uc, ic, 0.01, penalty)
    many, rng = state(), np.random.default_rng(6)
    hot = np.bincount(u).argmax()
    block = (u * 7 + rng.integers(0, 4, len(u)) * (u == hot)) % blocks
    for _ in range(20):
        apart = []
        for b in range(blocks):
            mine = block == b
            s = State(many.mean, many.alpha, {p: m.copy() for p, m in many.values.items()})
            apart.append((s, lane_epoch(s, u[mine], i[mine], r[mine], histories, uc, ic, 0.01, penalty, rng)))
        for p, m in many.values.items():
            together, shares = sum(k[p] for _, k in apart), sum(-np.expm1(-k[p]) for _, k in apart)
            scale = np.divide(-np.expm1(-together), shares, out=np.ones_like(shares), where=shares > 0)
            m += sum(s.values[p] - m for s, _ in apart) * scale.reshape(-1, *[1] * (m.ndim - 1))
    assert error(many) < 1.005 * error(one)
    assert error(many) < 0.95 * ratings[held_out].std()


def test_one_lane_is_sequential():
    """One turn at a time in the same order takes the same steps."""
    rng = np.random.default_rng(0)
    u, i, r = np.sort(rng.integers(0, 5, 40)), rng.integers(0, 7, 40), rng.integers(1, 11, 40) / 2
    hist = [np.unique(i[u == k]) for k in range(5)]
    histories = Histories(np.concatenate([[0], np.cumsum([len(h) for h in hist])]), np.concatenate(hist), None)
    make = lambda: State(3.0, 0.0, {"bu": np.zeros(5), "bi": np.zeros(7)} | {p: np.random.default_rng(ord(p)).normal(0, 0.1, (n, 3)) for p, n in (("p", 5), ("q", 7), ("y", 7))})
    one, two, seed = make(), make(), 9
    lane_epoch(one, u, i, r, histories, None, None, 0.05, PENALTIES, np.random.default_rng(seed), 1)
    g = np.random.default_rng(seed)
    shuffled = g.permutation(40)
    by_user = shuffled[np.argsort(u[shuffled], kind="stable")]
    counts = np.bincount(u, minlength=5)
    turns = g.permutation(5)
    turns = turns[np.argsort(-counts[turns], kind="stable")]
    starts = np.cumsum(counts) - counts
    order = np.concatenate([by_user[starts[turns[k]] : starts[turns[k]] + counts[turns[k]]] for k in g.permutation(5)])
    epoch(two, order, u, i, r, [UserLists(h, None, np.zeros(0, int), np.zeros(0)) for h in hist], None, None, 0.05, PENALTIES)
    for part in one.values:
        assert np.allclose(one.values[part], two.values[part], atol=1e-12), part


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(0)
    taste, kind = rng.normal(0, 1, 30), rng.normal(0, 1, 20)
    rows = []
    for u in range(30):
        for i in rng.choice(20, 10, replace=False).tolist():
            rows.append((len(rows), u, i, float(np.clip(3.2 + 0.5 * taste[u] + 0.5 * kind[i] + 0.8 * taste[u] * kind[i], 1, 5))))
    rows.append((len(rows), *rows[0][1:]))
    return Ratings.of(spark.createDataFrame(rows, "row_id bigint, user_idx int, item_idx int, rating double")).materialize()


@pytest.fixture(scope="module")
def clusters(data):
    found = cl.induce(data, cfg.Config("biased_mf", 4, 5, 0.02), 3, 4)
    assert found.train_rmse > 0 and found.user_inertia > 0 and found.r_star.count() == 12
    return found


def rmse(model, data):
    return metrics.rating_errors(scoring.predict(model, data.rows), "rating", "prediction").first()["rmse"]


@pytest.mark.parametrize("name", cfg.PARTS)
def test_fit_beats_the_mean_and_scores_agree(name, data, clusters):
    config = cfg.Config(name, 4, 25, 0.03, dtype="float64", seed=5, alpha=0.2 if "cb" in name else 0.0, backend="exact")
    model = fit.fit(data, config, fit.Indices(clusters=clusters if "cb" in name else None))
    mean = data.mean()
    base = data.rows.agg(F.sqrt(F.avg((F.col("rating") - mean) ** 2))).first()[0]
    assert rmse(model, data) < 0.85 * base
    sizes = {"p": data.n_users, "q": data.n_items}
    assert all(model.table(p, "id").count() == n for p, n in sizes.items() if p in config.parts)
    again = fit.fit(data, config, fit.Indices(clusters=clusters if "cb" in name else None))
    assert rmse(again, data) == pytest.approx(rmse(model, data))  # sums may be taken in another order
    if "cb" in name:
        shift = scoring.cluster_contribution(model, data.rows).first()
        assert shift["measured"] and scoring.cluster_contribution(scoring.without_clusters(model), data.rows).first()["max_abs_contribution"] == 0.0


@pytest.mark.parametrize("name", ["biased_mf", "cb_asvdpp"])
def test_blocks_learn_too(name, data, clusters):
    config = cfg.Config(name, 4, 8, 0.05, dtype="float64", alpha=0.2 if "cb" in name else 0.0, backend="distributed")
    ready = fit.Indices(clusters=clusters if "cb" in name else None)
    model = fit.fit(data, config, ready, block_rows=90)
    untrained = fit.fit(data, replace(config, epochs=1, learning_rate=1e-9), ready, block_rows=90)
    assert rmse(model, data) < 0.95 * rmse(untrained, data)
    assert model.parameters.groupBy("part", "id").count().filter("count > 1").count() == 0


def test_one_block_is_the_sequential_descent(data):
    config = cfg.Config("svdpp", 4, 6, 0.03, dtype="float64", backend="distributed")
    one = fit.fit(data, config, block_rows=10_000)
    assert rmse(one, data) < 1.0


def test_size_does_not_choose_the_backend(data):
    """Small data are fitted by default as large ones are; exact is taken on request only."""
    config = cfg.Config("biased_mf", 4, 3, 0.03, dtype="float64")
    fitted = [{(r["part"], r["id"]): r["f"] for r in fit.fit(data, replace(config, backend=b)).parameters.collect()} for b in ("auto", "distributed", "exact")]
    assert fitted[0].keys() == fitted[1].keys() == fitted[2].keys()
    same = [all(np.allclose(fitted[0][k], other[k]) for k in fitted[0]) for other in fitted[1:]]
    assert same == [True, False]


def test_predictions(spark, data):
    model = fit.fit(data, cfg.Config("biased_mf", 2, 2, 0.02))
    pairs = spark.createDataFrame([(0, 0), (0, 0), (0, 999), (None, 1)], "user_idx int, item_idx int")
    found = [r["prediction"] for r in scoring.predict(model, pairs).orderBy(F.col("user_idx").asc_nulls_last(), "item_idx").collect()]
    assert found[0] == found[1] is not None and found[2:] == [None, None]
    assert scoring.predict_one(model, 0, 0) == pytest.approx(found[0])
    assert scoring.parameter_bytes(model) == 4 * (3 * data.n_users + 3 * data.n_items)
    assert scoring.predict(model, pairs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        fit.fit(data.where("row_id < 0", "none"), cfg.Config("biased_mf"))
    with pytest.raises(ValueError):
        fit.fit(data, cfg.Config("cb_svdpp"))


def profile(name, **training):
    base = {"latent_dim": 4, "epochs": 2, "learning_rate": 0.01, "lambda_b": 0.02, "init_std": 0.1, "dtype": "float32"} | {f"lambda_{p}": 0.02 for p in cfg.PARTS[name].split()}
    if "y" in cfg.PARTS[name].split():
        base["implicit_policy"] = "ratings_as_implicit"
    if "x" in cfg.PARTS[name].split():
        base["residual_weight_contract"] = "detached"
    if name in ("biased_mf", "svdpp"):
        base["training_backend"] = "auto"
    found = {"metadata": {"status": "active", "owner": "tests", "purpose": "test"}, "model": {"name": name, "family": "mf", "scope": "paper_inspired"}, "notes": [], "training": base | training}
    if "cb" in name:
        found["clustering"] = {"n_user_clusters": 2, "n_item_clusters": 2, "alpha": 0.2, "algorithm": "kmeans", "kmeans_n_init": 1}
    return found


def test_profiles():
    for name in cfg.PARTS:
        p = cfg.load_profile(profile(name))
        config = cfg.config_of(p, 3)
        assert config.model == name and config.penalty("q") == 0.02 and config.alpha == (0.2 if "cb" in name else 0.0)
    assert cfg.requirements_payload("cb_asvdpp")["required_artifacts"] == ["user_history_index", "explicit_feedback_index", "cluster_artifacts", "user_cluster_history_index"]
    assert cfg.requirements("biased_mf").names() == []
    assert cfg.with_overrides(cfg.load_profile(profile("svdpp")), {"epochs": 9}).training.epochs == 9
    assert cfg.cluster_semantics(0.0)["cb_contribution_measured"] is False and cfg.cluster_semantics(0.1)["cb_contribution_measured"] is None
    wrong = [profile("svdpp", epochs=0), profile("svdpp", lambda_y=-1), profile("svdpp", extra=1), profile("biased_mf", dtype="float16"), profile("svdpp") | {"more": 1}, profile("svdpp") | {"model": {"name": "other", "family": "mf", "scope": "x"}}]
    missing = profile("asvdpp")
    del missing["training"]["lambda_x"]
    outside = profile("cb_svdpp")
    outside["clustering"]["alpha"] = 1.5
    half = profile("cb_svdpp")
    del half["clustering"]["kmeans_n_init"]
    scope = profile("svdpp") | {"model": {"name": "svdpp", "family": "mf", "scope": "any"}}
    wrong += [half, scope, profile("svdpp", implicit_policy="other"), profile("asvdpp", residual_weight_contract="other"), profile("biased_mf", training_backend="gpu")]
    for payload in [*wrong, missing, outside]:
        with pytest.raises(ValueError):
            cfg.load_profile(payload)
    with pytest.raises(ValueError):
        cfg.load_profile(profile("svdpp"), family="other")
    for bad in ({"epochs": 0}, {"dtype": "int"}, {"alpha": 2}, {"backend": "gpu"}, {"penalties": (("b", -1.0),)}):
        with pytest.raises(ValueError):
            cfg.Config("biased_mf", **bad)


def test_no_null_lists_are_packed(spark):
    # For each row of an Arrow batch Spark looks through all null lists before it.
    rows = spark.createDataFrame([(k, k % 7, k % 5, 3.0, 0) for k in range(40)], "row_id long, user_idx int, item_idx int, rating double, block int")
    users = fit._user_rows(fit.Indices(), spark, 7)
    sent = []
    real = type(rows).groupBy
    try:
        type(rows).groupBy = lambda df, *by: (sent.append(df), real(df, *by))[1]
        held = fit._held(rows, users, None, None, ["p", "q"], 1)
    finally:
        type(rows).groupBy = real
    assert held.count() == 1
    assert sent[-1].filter("items is null or ratings is null").count() == 0


def test_a_fit_stores_one_epoch_at_a_time(spark):
    def stored():
        top = shared_dir(spark).removeprefix("file:")
        return sum(n.startswith("rdd-") for _, names, _ in os.walk(top) for n in names)

    rng = np.random.default_rng(1)
    rows = spark.createDataFrame([(k, int(u), int(i), 3.0) for k, (u, i) in enumerate(zip(rng.integers(0, 20, 200), rng.integers(0, 15, 200)))], "row_id long, user_idx int, item_idx int, rating double")
    release(spark)
    time.sleep(1)
    before = stored()
    model = fit.fit(Ratings.of(rows), cfg.Config("biased_mf", 2, 8))
    for _ in range(50):
        # Spark deletes in the background.
        if stored() - before <= 4:
            break
        time.sleep(0.2)
    assert stored() - before <= 4 and model.parameters.count()


def test_normals_are_those_of_sparks_hash(spark):
    uniform = lambda k, which: (F.shiftrightunsigned(F.xxhash64(F.lit(7), F.lit("pC"), F.col("id").cast("int"), k, F.lit(which)), 11) + 0.5) / float(1 << 53)
    vector = F.transform(F.sequence(F.lit(1), F.lit(3)), lambda k: F.sqrt(-2 * F.log(uniform(k, 1))) * F.cos(2 * np.pi * uniform(k, 2)))
    rows = spark.range(5).select("id", vector.alias("f")).orderBy("id").collect()
    assert np.allclose(normals(7, "pC", np.arange(5), 3), [r["f"] for r in rows], atol=1e-12)


def test_files_of_arrays(tmp_path):
    folder = Folder.new(f"file://{tmp_path}")
    ids, vectors = np.array([2, 5, 9]), np.arange(6.0).reshape(3, 2)
    folder.write("a/b", ids, np.array([1.0, 2.0, 3.0]), vectors)
    found = folder.read("a/b", 3, 9)
    assert [x.tolist() for x in found] == [[5], [2.0], [[2.0, 3.0]]]
    folder.write("a/none", ids[:0], None, vectors[:0])
    assert folder.read("a/none")[2].shape == (0, 2)
    folder.delete("a", "missing")
    assert not os.path.exists(f"{folder.uri.removeprefix('file://')}/a")


@pytest.mark.parametrize("name", ["biased_mf", "asymmetric_svd"])
def test_blocks_share_only_what_they_have_in_common(spark, data, name, monkeypatch):
    """Two epochs over blocks, a user spread over several among them, against the same on whole arrays."""
    rows = data.rows.unionByName(data.rows.selectExpr("row_id + 1000 as row_id", "0 as user_idx", "item_idx", "rating"))
    more = Ratings.of(rows).materialize()
    config, sent = cfg.Config(name, 3, 2, 0.05, dtype="float64", seed=5), {}
    real = fit._held
    monkeypatch.setattr(fit, "_held", lambda placed, *rest: (sent.setdefault("placed", placed.toPandas()), real(placed, *rest))[1])
    model = fit.fit(more, config, block_rows=120)
    placed = sent["placed"].sort_values("row_id")
    assert placed[placed["user_idx"] == 0]["block"].nunique() > 1 and placed["block"].nunique() > 3
    state = {"bu": np.zeros(30), "bi": np.zeros(20)} | {p: 0.1 * normals(5, p, np.arange(30 if p == "p" else 20), 3) for p in config.parts}
    histories = None
    if "y" in config.parts:
        first = placed.drop_duplicates(["user_idx", "item_idx"]).sort_values(["user_idx", "item_idx"])
        histories = Histories(np.concatenate([[0], np.cumsum(np.bincount(first["user_idx"], minlength=30))]), first["item_idx"].to_numpy(), first["rating"].to_numpy())
    penalty = dict.fromkeys(PENALTIES, 0.02)
    for number in range(2):
        apart = []
        for block, mine in placed.groupby("block"):
            s = State(model.mean, 0.0, {p: m.copy() for p, m in state.items()})
            u, i, r = (mine[c].to_numpy() for c in ("user_idx", "item_idx", "rating"))
            apart.append((s, lane_epoch(s, u, i, r, histories, None, None, 0.05, penalty, np.random.default_rng([5, number, block]))))
        for p, m in state.items():
            together, shares = sum(k[p] for _, k in apart), sum(-np.expm1(-k[p]) for _, k in apart)
            scale = np.divide(-np.expm1(-together), shares, out=np.ones_like(shares), where=shares > 0)
            m += sum(s.values[p] - m for s, _ in apart) * scale.reshape(-1, *[1] * (m.ndim - 1))
    for part, values in state.items():
        found = model.table(part, "id").orderBy("id").collect()
        assert np.allclose([r["f"] for r in found], values.reshape(len(values), -1), atol=1e-12), part
    assert not [n for n in os.listdir(shared_dir(spark).removeprefix("file:")) if n.startswith("fit-")]


def test_users_without_ratings_keep_their_first_values(spark):
    rows = spark.createDataFrame([(0, 0, 0, 3.0), (1, 2, 1, 4.0)], "row_id long, user_idx int, item_idx int, rating double")
    model = fit.fit(replace(Ratings.of(rows), n_users=5), cfg.Config("biased_mf", 2, 1))
    assert [r["id"] for r in model.table("p", "id").orderBy("id").collect()] == [0, 1, 2, 3, 4]


def test_packed_rows_take_a_fraction(spark):
    df = spark.range(40_000).select("id", F.when(F.col("id") % 3 > 0, "train").alias("split"), F.array((F.col("id") % 7).cast("int")).alias("few"))

    def stored(keep):
        top = shared_dir(spark).removeprefix("file:")
        size = lambda: {os.path.join(at, n): os.path.getsize(os.path.join(at, n)) for at, _, names in os.walk(top) for n in names}
        before = size()
        kept = keep(df)
        return sum(n for path, n in size().items() if path not in before), kept

    (small, kept), (large, whole) = stored(packed), stored(lambda x: x.checkpoint())
    assert kept.schema == df.schema and kept.exceptAll(whole).count() == 0 and kept.count() == 40_000
    assert small * 2 < large


@pytest.mark.parametrize("name", ["asvdpp", "cb_asvdpp"])
def test_scores_by_files_are_those_by_joins(spark, data, clusters, name, monkeypatch):
    config = cfg.Config(name, 3, 1, 0.05, dtype="float64", alpha=0.2 if "cb" in name else 0.0)
    model = fit.fit(data, config, fit.Indices(clusters=clusters if "cb" in name else None))
    pairs = data.rows.select("user_idx", "item_idx", "rating").unionByName(spark.createDataFrame([(0, 999, None), (None, 1, None), (999, 1, None)], "user_idx int, item_idx int, rating double"))
    read = lambda m: [(r["user_idx"], r["item_idx"], r["prediction"]) for r in scoring.predict(m, pairs).orderBy("user_idx", "item_idx", "rating").collect()]
    found = []
    for held, broadcast in ((0, 100_000), (1 << 20, 100_000), (1 << 20, 0)):
        monkeypatch.setattr(scoring, "HELD_BYTES", held)
        monkeypatch.setattr(scoring, "BROADCAST_ITEMS", broadcast)
        one = replace(model)
        found.append(read(one))
        plan = scoring.contexts(one)._jdf.queryExecution().executedPlan().toString()
        assert ("explode" in plan) == (not held)
        scoring.forget(one)
    for other in found[1:]:
        assert [x[:2] for x in other] == [x[:2] for x in found[0]]
        assert all((a[2] is None) == (b[2] is None) and (a[2] is None or abs(a[2] - b[2]) < 1e-9) for a, b in zip(found[0], other))


def test_clusters_need_no_sorted_errors(data, monkeypatch):
    fitted = []
    real = fit.fit
    monkeypatch.setattr(fit, "fit", lambda *a: (fitted.append(real(*a)), fitted[-1])[1])
    with monkeypatch.context() as m:
        m.setattr(metrics.skew, "key_percentiles", lambda *a: pytest.fail("errors are sorted"))
        found = cl.induce(data, cfg.Config("biased_mf", 2, 2, 0.02), 2, 2)
    assert found.train_rmse == pytest.approx(rmse(fitted[0], data))
