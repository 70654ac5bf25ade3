"""One epoch of stochastic gradient descent for any of the models, in NumPy.

Steps of a model with p and q only touch one user and one item each, so steps that share neither commute. They are
taken level by level, a step's level being above those of the earlier steps of its user and of its item: the outcome is
that of one step after the other, in whole-array operations.

The six models differ in their parts only, so one step serves all: a part that a model lacks is left out. With e the
error, z the user's context and q the mixed item vector, all read before the step, the step is

    b += rate (e - l b)                                    for the user's and the item's bias
    v += rate (e g - l v)                                  for a vector v with gradient g

where g is (1 - a) q for p, a q for pC, (1 - a) z for the item's q, a z for qC, and for the history's vectors the
context's own weights times q. ``yC`` is penalised once for each cluster of the history, ``xC`` once for each item.

Lanes. ``lane_epoch`` takes the ratings user by user, many turns side by side; a user with very many ratings has several
turns. While a user is at work, a step adds
one and the same vector, times a number of its own, to the vectors of all history items, so their weighted sums follow
from a few numbers: a step costs the same however long the history is, and the history is written back once, at the end
of the turn. What turns side by side do to a parameter at the same time is added up and damped (``settle``).

Damping. Moves of one parameter that were made apart from the same value are each the way to some goal, of which a move
with pull k has covered the share 1 - exp(-k); the pull of a step is the rate times the curvature of its error. Together
they would have covered 1 - exp(-sum of k), so their sum is scaled by that over the sum of their shares: little pulls
add up, strong ones are averaged. One move alone stays as it is.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass
class State:
    """Parameters by name: ``bu``, ``bi`` (vectors) and the parts (matrices)."""

    mean: float
    alpha: float
    values: dict[str, np.ndarray] = field(default_factory=dict)


@dataclass
class UserLists:
    """Of one user: history items, their ratings (None without explicit feedback), clusters of the history with counts."""

    items: np.ndarray
    ratings: np.ndarray | None
    clusters: np.ndarray
    counts: np.ndarray


EMPTY = UserLists(np.zeros(0, np.int64), None, np.zeros(0, np.int64), np.zeros(0))


def epoch(state: State, order: np.ndarray, users: np.ndarray, items: np.ndarray, ratings: np.ndarray, lists: list[UserLists], user_cluster: np.ndarray | None, item_cluster: np.ndarray | None, rate: float, penalty: dict[str, float]) -> None:
    """Takes a step for each position of ``order``, in that order, changing ``state`` in place."""
    v, a = state.values, state.alpha
    bu, bi, q = v["bu"], v["bi"], v["q"]
    p, x, y = v.get("p"), v.get("x"), v.get("y")
    pc, qc, xc, yc = (v.get(k) for k in ("pC", "qC", "xC", "yC"))
    clustered = qc is not None
    own = 1.0 - a if clustered else 1.0
    norms = [1.0 / np.sqrt(len(one.items)) if len(one.items) else 0.0 for one in lists]
    lb = penalty["b"]
    if x is None and y is None and not clustered:
        _level_epoch(state, order, users, items, ratings, rate, penalty)
        return
    for k in order.tolist():
        u, i, r = int(users[k]), int(items[k]), ratings[k]
        one, norm = lists[u], norms[u]
        bias_u, bias_i = float(bu[u]), float(bi[i])
        if clustered:
            cu, ci = int(user_cluster[u]), int(item_cluster[i])
            mixed = own * q[i] + a * qc[ci]
            z = own * p[u] + a * pc[cu]
        else:
            mixed = q[i].copy()
            z = p[u].copy() if p is not None else np.zeros_like(mixed)
        history = one.items
        if x is not None:
            weights = norm * (one.ratings - (state.mean + bias_u + bi[history]))
            z = z + own * (weights @ x[history])
            if clustered:
                near = item_cluster[history]
                z = z + a * (weights @ xc[near])
        if y is not None:
            z = z + own * norm * y[history].sum(axis=0)
            if clustered:
                z = z + a * norm * (one.counts @ yc[one.clusters])
        e = r - (state.mean + bias_u + bias_i + mixed @ z)

        bu[u] = bias_u + rate * (e - lb * bias_u)
        bi[i] = bias_i + rate * (e - lb * bias_i)
        if p is not None:
            p[u] += rate * (e * own * mixed - penalty["p"] * p[u])
        q[i] += rate * (e * own * z - penalty["q"] * q[i])
        if clustered:
            pc[cu] += rate * (e * a * mixed - penalty["pC"] * pc[cu])
            qc[ci] += rate * (e * a * z - penalty["qC"] * qc[ci])
        if x is not None:
            x[history] += rate * (np.outer(e * own * weights, mixed) - penalty["x"] * x[history])
            if clustered:
                for w, c in zip(weights.tolist(), near.tolist()):
                    xc[c] += rate * (e * a * w * mixed - penalty["xC"] * xc[c])
        if y is not None:
            y[history] += rate * (e * norm * own * mixed - penalty["y"] * y[history])
            if clustered:
                yc[one.clusters] += rate * (np.outer(e * norm * a * one.counts, mixed) - penalty["yC"] * yc[one.clusters])


def _levels(users: np.ndarray, items: np.ndarray, n_users: int, n_items: int) -> np.ndarray:
    of_user, of_item, found = [0] * n_users, [0] * n_items, []
    for u, i in zip(users.tolist(), items.tolist()):
        level = max(of_user[u], of_item[i])
        found.append(level)
        of_user[u] = of_item[i] = level + 1
    return np.array(found, np.int64)


def _level_epoch(state: State, order: np.ndarray, users: np.ndarray, items: np.ndarray, ratings: np.ndarray, rate: float, penalty: dict[str, float]) -> None:
    bu, bi, p, q = (state.values[k] for k in ("bu", "bi", "p", "q"))
    levels = _levels(users[order], items[order], len(bu), len(bi))
    by_level = np.argsort(levels, kind="stable")
    ends = np.flatnonzero(np.diff(levels[by_level], append=-1)) + 1
    placed = order[by_level]
    all_u, all_i, all_r = users[placed], items[placed], ratings[placed] - state.mean
    start = 0
    for end in ends.tolist():
        u, i = all_u[start:end], all_i[start:end]
        pu, qi, b, c = p[u], q[i], bu[u], bi[i]
        e = all_r[start:end] - b - c - np.einsum("ij,ij->i", pu, qi)
        bu[u] = b + rate * (e - penalty["b"] * b)
        bi[i] = c + rate * (e - penalty["b"] * c)
        e = e[:, None]
        p[u] = pu + rate * (e * qi - penalty["p"] * pu)
        q[i] = qi + rate * (e * pu - penalty["q"] * qi)
        start = end


#: Turns side by side; ratings of a turn (more for a long history, so that its entries are written back seldom enough),
#: and history entries that turns side by side may have.
LANES, TURN, HISTORY_PER_RATING, GROUP_ENTRIES = 64, 256, 4, 400_000
#: Ratings of a block for each turn that it takes side by side, where these are more than LANES and at most MOST_LANES.
RATINGS_PER_LANE, MOST_LANES = 780, 256


def lanes_for(ratings: int) -> int:
    """Turns side by side in a block of so many ratings: about the same share of a block at every size."""
    return min(MOST_LANES, max(LANES, ratings // RATINGS_PER_LANE))


@dataclass
class Histories:
    """User lists one behind the other: ``ends[u]`` to ``ends[u + 1]`` are user u's places in ``items`` and ``ratings``."""

    ends: np.ndarray
    items: np.ndarray
    ratings: np.ndarray | None

    def of(self, users: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The number of entries of each user, and of each entry the user's place in ``users`` and its own place."""
        sizes = self.ends[users + 1] - self.ends[users]
        lane = np.repeat(np.arange(len(users)), sizes)
        return sizes, lane, np.arange(len(lane)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(self.ends[users], sizes)


def settle(target: np.ndarray, at: np.ndarray, moves: np.ndarray, pull: np.ndarray, pulls: np.ndarray) -> None:
    """Adds ``moves`` to ``target[at]``, damped where a place has several, and their pull to ``pulls``."""
    if len(at) > 1:
        order = np.argsort(at, kind="stable")
        places = at[order]
        starts = np.flatnonzero(np.diff(places, prepend=-1))
    if len(at) == 1 or len(starts) == len(at):
        target[at] += moves
        pulls[at] += pull
        return
    k = pull[order]
    total, together = np.add.reduceat(moves[order], starts, axis=0), np.add.reduceat(k, starts)
    apart = np.add.reduceat(-np.expm1(-k), starts)
    scale = np.divide(-np.expm1(-together), apart, out=np.ones_like(apart), where=apart > 0)
    target[places[starts]] += total * (scale[:, None] if moves.ndim > 1 else scale)
    pulls[places[starts]] += together


def _sums(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums of ``values`` by lane, whose entries are neighbours."""
    upto = np.concatenate([np.zeros((1, *values.shape[1:])), np.cumsum(values, axis=0)])
    ends = np.cumsum(sizes)
    return upto[ends] - upto[ends - sizes]


def _turns(counts: np.ndarray, histories: Histories | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The turns that users take: each one's user, first place among the ratings by user, and length."""
    most = np.full(len(counts), TURN)
    if histories is not None:
        most = np.maximum(most, np.diff(histories.ends) // HISTORY_PER_RATING)
    turns = -(-counts // most)
    users = np.repeat(np.arange(len(counts)), turns)
    nth = np.arange(len(users)) - np.repeat(np.cumsum(turns) - turns, turns)
    starts = (np.cumsum(counts) - counts)[users]
    return users, starts + nth * most[users], np.minimum(most[users], counts[users] - nth * most[users])


def _groups(rng: np.random.Generator, lengths: np.ndarray, entries: np.ndarray, lanes: int) -> list[np.ndarray]:
    """Turns to be taken side by side, the longest first in each group: about equally long ones, in a random order of
    groups, no more than ``lanes`` and no more than a bounded number of history entries."""
    order = rng.permutation(len(lengths))
    order = order[np.argsort(-lengths[order], kind="stable")]
    groups, start, held = [], 0, 0
    for k, n in enumerate(entries[order].tolist()):
        if k > start and (k - start == lanes or held + n > GROUP_ENTRIES):
            groups.append(order[start:k])
            start, held = k, 0
        held += n
    groups.append(order[start:])
    return [groups[g] for g in rng.permutation(len(groups)).tolist() if len(groups[g])]


def lane_epoch(state: State, users: np.ndarray, items: np.ndarray, ratings: np.ndarray, histories: Histories | None, user_cluster: np.ndarray | None, item_cluster: np.ndarray | None, rate: float, penalty: dict[str, float], rng: np.random.Generator, lanes: int = LANES) -> dict[str, np.ndarray]:
    """One epoch over all ratings in a random order of users and of each one's ratings, changing ``state`` in place.
    Returns how much each parameter was pulled. The residuals of a user's explicit history keep the item biases of the
    start of the user's turn."""
    v, a, mean = state.values, state.alpha, state.mean
    bu, bi, q = v["bu"], v["bi"], v["q"]
    p, x, y = v.get("p"), v.get("x"), v.get("y")
    pc, qc, xc, yc = (v.get(k) for k in ("pC", "qC", "xC", "yC"))
    clustered = qc is not None
    own = 1.0 - a if clustered else 1.0
    pulls = {k: np.zeros(len(m)) for k, m in v.items()}
    lb = penalty["b"]
    shuffled = rng.permutation(len(users))
    by_user = shuffled[np.argsort(users[shuffled], kind="stable")]
    of_turn, firsts, lengths = _turns(np.bincount(users, minlength=len(bu)), histories)
    entries = np.diff(histories.ends)[of_turn] if histories is not None else np.zeros(len(of_turn), np.int64)
    for turn in _groups(rng, lengths, entries, lanes):
        group, length, first = of_turn[turn], lengths[turn], firsts[turn]
        m = len(group)
        bias, drawn = bu[group], np.zeros(m)
        mine = p[group] if p is not None else None
        if clustered:
            at_user = user_cluster[group]
            mine_c = pc[at_user]
        if histories is not None:
            n, lane, entry = histories.of(group)
            held = histories.items[entry]
            norm = np.divide(1.0, np.sqrt(n), out=np.zeros(m), where=n > 0)
            if clustered:
                near = item_cluster[held]
                per = np.bincount(lane * len(qc) + near, minlength=m * len(qc)).reshape(m, -1).astype(float)
        if y is not None:
            sum_y, add_y, keep_y = _sums(y[held], n), np.zeros((m, q.shape[1])), 1 - rate * penalty["y"]
            if clustered:
                sum_yc, add_yc, keep_yc, squares = per @ yc, np.zeros_like(add_y), 1 - rate * penalty["yC"], (per**2).sum(axis=1)
        if x is not None:
            c = histories.ratings[entry] - mean - bi[held]
            c1, c2, keep_x = _sums(c, n), _sums(c * c, n), 1 - rate * penalty["x"]
            sum_cx, sum_x = _sums(c[:, None] * x[held], n), _sums(x[held], n)
            add_c, add_b, size = np.zeros_like(sum_x), np.zeros_like(sum_x), np.zeros(m)
            if clustered:
                per_c = np.bincount(lane * len(qc) + near, weights=c, minlength=m * len(qc)).reshape(m, -1)
                mine_xc, size_c = np.repeat(xc[None], m, axis=0), np.zeros(m)
        for t in range(int(length[0])):
            m = int(np.searchsorted(-length, -t, side="left"))
            k = by_user[first[:m] + t]
            i, b = items[k], bias[:m]
            qi, ci = q[i], bi[i]
            mixed = qi
            z = own * mine[:m] if p is not None else np.zeros_like(qi)
            if clustered:
                of_item = item_cluster[i]
                qci = qc[of_item]
                mixed = own * qi + a * qci
                z = z + a * mine_c[:m]
            if x is not None:
                z = z + (own * norm[:m])[:, None] * (sum_cx[:m] - b[:, None] * sum_x[:m])
                if clustered:
                    weights = norm[:m, None] * (per_c[:m] - b[:, None] * per[:m])
                    z = z + a * np.matmul(weights[:, None, :], mine_xc[:m])[:, 0]
            if y is not None:
                z = z + (own * norm[:m])[:, None] * sum_y[:m]
                if clustered:
                    z = z + (a * norm[:m])[:, None] * sum_yc[:m]
            e = ratings[k] - mean - b - ci - np.einsum("ij,ij->i", mixed, z)
            reach, length_z = np.einsum("ij,ij->i", mixed, mixed), np.einsum("ij,ij->i", z, z)
            drawn[:m] += reach
            settle(bi, i, rate * (e - lb * ci), np.full(m, rate * (1 + lb)), pulls["bi"])
            ez, em = e[:, None] * z, e[:, None] * mixed
            settle(q, i, rate * (own * ez - penalty["q"] * qi), rate * (own * own * length_z + penalty["q"]), pulls["q"])
            if clustered:
                settle(qc, of_item, rate * (a * ez - penalty["qC"] * qci), rate * (a * a * length_z + penalty["qC"]), pulls["qC"])
                mine_c[:m] += rate * (a * em - penalty["pC"] * mine_c[:m])
            if p is not None:
                mine[:m] += rate * (own * em - penalty["p"] * mine[:m])
            if x is not None:
                step = (rate * own * norm[:m])[:, None] * em
                spread = c2[:m] - b * c1[:m]
                size[:m] += reach * norm[:m] ** 2 * np.maximum(spread - b * (c1[:m] - b * n[:m]), 0)
                sum_cx[:m] = keep_x * sum_cx[:m] + spread[:, None] * step
                sum_x[:m] = keep_x * sum_x[:m] + (c1[:m] - b * n[:m])[:, None] * step
                add_c[:m] = keep_x * add_c[:m] + step
                add_b[:m] = keep_x * add_b[:m] + b[:, None] * step
                if clustered:
                    size_c[:m] += reach * np.einsum("ij,ij->i", weights, weights)
                    mine_xc[:m] = mine_xc[:m] * ((1 - rate * penalty["xC"]) ** per[:m])[:, :, None] + (rate * a * weights)[:, :, None] * em[:, None, :]
            if y is not None:
                step = (rate * norm[:m])[:, None] * em
                sum_y[:m] = keep_y * sum_y[:m] + (own * n[:m])[:, None] * step
                add_y[:m] = keep_y * add_y[:m] + own * step
                if clustered:
                    sum_yc[:m] = keep_yc * sum_yc[:m] + (a * squares[:m])[:, None] * step
                    add_yc[:m] = keep_yc * add_yc[:m] + a * step
            bias[:m] = b + rate * (e - lb * b)
        settle(bu, group, bias - bu[group], rate * (1 + lb) * length, pulls["bu"])
        if p is not None:
            settle(p, group, mine - p[group], rate * (own * own * drawn + penalty["p"] * length), pulls["p"])
        if clustered:
            settle(pc, at_user, mine_c - pc[at_user], rate * (a * a * drawn + penalty["pC"] * length), pulls["pC"])
        if y is not None:
            settle(y, held, ((keep_y**length - 1)[lane])[:, None] * y[held] + add_y[lane], (rate * (own * own * drawn + penalty["y"] * length))[lane], pulls["y"])
            if clustered:
                one, two = np.nonzero(per)
                settle(yc, two, ((keep_yc**length - 1)[one])[:, None] * yc[two] + per[one, two][:, None] * add_yc[one], (rate * (a * a * drawn * norm**2 * squares + penalty["yC"] * length))[one], pulls["yC"])
        if x is not None:
            settle(x, held, ((keep_x**length - 1)[lane])[:, None] * x[held] + c[:, None] * add_c[lane] - add_b[lane], (rate * (own * own * size + penalty["x"] * length))[lane], pulls["x"])
            if clustered:
                one, two = np.nonzero(per)
                settle(xc, two, mine_xc[one, two] - xc[two], (rate * a * a * size_c)[one] + rate * penalty["xC"] * length[one] * per[one, two], pulls["xC"])
    return pulls
