"""A linear-chain conditional random field for BIO tags: hashed token features, distributed training and decoding.

Examples are encoded once, by expressions alone, and stored.  A training round broadcasts the weights; each task runs
forward and backward over its sentences, many side by side, and returns one gradient, whatever its number of rows; those
are added up by Spark in blocks, and the driver takes one quasi-Newton step.  What the driver holds is as large as the
model (``size`` times labels), never as the data.

A null token counts as '' and a null label as O; a sentence without tokens is left out of training and gets no labels.  Of tokens and labels of
unequal number the shorter ones count.  A sentence of any length is run through whole; its pairs of labels are summed in
parts.  Labels that the model doesn't know are an error in training.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skillweave.operators import bio
from skillweave.session import materialise

#: Slots for hashed features; tokens that are worked on together; weights in a block of the gradient.
SIZE, TOKENS_AT_ONCE, BLOCK = 1 << 15, 20_000, 1 << 16
#: A gradient is made by so many tasks for each core.
TASKS_A_CORE = 2
MOST_LABELS = 1_000
ENCODED = "id string, feats array<array<int>>, gold array<int>"


@dataclass
class Model:
    """Weights of a chain: features (slots x labels), transitions (from x to), and both ends."""

    labels: list[str]
    features: np.ndarray
    transitions: np.ndarray
    first: np.ndarray
    last: np.ndarray

    @classmethod
    def of(cls, labels: list[str], vector: np.ndarray, size: int) -> Model:
        n = len(labels)
        at = np.cumsum([size * n, n * n, n])
        return cls(labels, vector[: at[0]].reshape(size, n), vector[at[0] : at[1]].reshape(n, n), vector[at[1] : at[2]], vector[at[2] :])


def n_weights(labels: int, size: int) -> int:
    return size * labels + labels * labels + 2 * labels


def feature_ids(tokens: Column, size: int, hints: Column | None = None) -> Column:
    """array<array<int>>: the slots of each token's features, as many for every token.

    ``hints``, one string for each token (such as a vocabulary's types), are one feature more.
    """

    def one(token: Column, i: Column) -> Column:
        facts = bio.shape_features(token, F.when(i > 0, F.get(tokens, i - 1)), F.get(tokens, i + 1), i == 0, i == F.size(tokens) - 1)
        facts["bias"] = F.lit("1")
        if hints is not None:
            facts["hint"] = F.coalesce(F.get(hints, i), F.lit(""))
        return F.array(*[F.pmod(F.xxhash64(F.lit(name), F.coalesce(value.cast("string"), F.lit(""))), F.lit(size)).cast("int") for name, value in facts.items()])

    return F.transform(F.transform(tokens, lambda t: F.coalesce(t, F.lit(""))), one)


def encode(examples: DataFrame, labels: list[str], size: int = SIZE, hints: str | None = None) -> DataFrame:
    """id, feats, gold of ``examples`` (id, tokens, labels or none), where there is a token."""
    has_gold = "labels" in examples.columns
    n = F.least(F.size("tokens"), F.size("labels")) if has_gold else F.size("tokens")
    toks = F.slice("tokens", F.lit(1), n)
    gold = F.transform(F.slice("labels", F.lit(1), n), lambda x: F.array_position(F.array(*[F.lit(y) for y in labels]), F.coalesce(x, F.lit("O"))).cast("int") - 1) if has_gold else F.array().cast("array<int>")
    rows = examples.filter(F.coalesce(n, F.lit(0)) > 0)
    return rows.select(F.col("id").cast("string").alias("id"), feature_ids(toks, size, F.col(hints) if hints else None).alias("feats"), gold.alias("gold"))


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis)) + np.squeeze(top, axis)


def emissions(model: Model, feats: np.ndarray) -> np.ndarray:
    """The score of each label at each token, a feature at a time."""
    out = model.features[feats[:, 0]]
    for k in range(1, feats.shape[1]):
        out += model.features[feats[:, k]]
    return out


def _in_logs(model: Model, emission: np.ndarray, start: np.ndarray, end: np.ndarray, steps: list[int], places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward and backward in logarithms, for weights of any size: log-partitions, chances of labels, summed chances of moves."""
    alpha, beta = np.empty_like(emission), np.empty_like(emission)
    alpha[start] = emission[start] + model.first
    beta[end] = model.last
    for t in range(1, len(steps)):
        now = start[: steps[t]] + t
        alpha[now] = emission[now] + _log_sum(alpha[now - 1][:, :, None] + model.transitions[None], 1)
    for t in range(len(steps) - 1, 0, -1):
        now = start[: steps[t]] + t - 1
        beta[now] = _log_sum(model.transitions[None] + (emission[now + 1] + beta[now + 1])[:, None, :], 2)
    log_z = _log_sum(alpha[end] + model.last, 1)
    sentence_z = np.empty(len(emission))
    for s, e, z in zip(start.tolist(), end.tolist(), log_z.tolist(), strict=True):
        sentence_z[s : e + 1] = z
    moves = np.zeros_like(model.transitions)
    for i in range(0, len(places), TOKENS_AT_ONCE):
        now = places[i : i + TOKENS_AT_ONCE]
        moves += np.exp(alpha[now - 1][:, :, None] + model.transitions[None] + (emission[now] + beta[now])[:, None, :] - sentence_z[now][:, None, None]).sum(0)
    return log_z, np.exp(alpha + beta - sentence_z[:, None]), moves


#: A step of ``_scaled`` below this share may have lost what fell out of a double.
LEAST_SHARE = 1e-200


def _scaled(model: Model, emission: np.ndarray, start: np.ndarray, end: np.ndarray, steps: list[int], places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """The same by products of matrices, each token's sums scaled to one; None where a double doesn't hold them."""
    highest = emission.max(1, keepdims=True)
    seen, move, closing = np.exp(emission - highest), np.exp(model.transitions - model.transitions.max()), np.exp(model.last - model.last.max())
    alpha, beta, share = np.empty_like(emission), np.empty_like(emission), np.empty((len(emission), 1))
    with np.errstate(all="ignore"):
        for t in range(len(steps)):
            now = start[: steps[t]] + t
            reach = seen[now] * (alpha[now - 1] @ move if t else np.exp(model.first - model.first.max()))
            share[now] = reach.sum(1, keepdims=True)
            alpha[now] = reach / share[now]
        at_end = alpha[end] @ closing
        beta[end] = closing / at_end[:, None]
        for t in range(len(steps) - 1, 0, -1):
            now = start[: steps[t]] + t
            beta[now - 1] = (seen[now] * beta[now] / share[now]) @ move.T
        chance = alpha * beta
        moves = move * (alpha[places - 1].T @ (seen[places] * beta[places] / share[places]))
        per_token = np.log(share)[:, 0] + highest[:, 0] + model.transitions.max()
        log_z = np.log(at_end) + model.last.max() + model.first.max() - model.transitions.max()
        by_place = np.argsort(start)
        log_z[by_place] += np.add.reduceat(per_token, start[by_place])
    sound = min(share.min(), at_end.min()) >= LEAST_SHARE and np.isfinite(log_z).all() and np.isfinite(moves).all() and np.abs(chance.sum(1) - 1).max() < 1e-9
    return (log_z, chance, moves) if sound else None


def loss_and_gradient(model: Model, feats: np.ndarray, gold: np.ndarray, lengths: np.ndarray) -> tuple[float, Model]:
    """Negative log-likelihood of sentences laid end to end (feats: tokens x features), and its gradient as a model."""
    order = np.argsort(-lengths, kind="stable")
    start, lengths = (np.cumsum(lengths) - lengths)[order], lengths[order]
    end = start + lengths - 1
    emission = emissions(model, feats)
    steps = np.searchsorted(-lengths, -np.arange(int(lengths.max())), "left").tolist()  # sentences that are still going on
    later = np.ones(len(emission), bool)
    later[start] = False
    places = np.flatnonzero(later)
    where = (emission, start, end, steps, places)
    log_z, chance, moves = _scaled(model, *where) or _in_logs(model, *where)
    np.subtract.at(moves, (gold[places - 1], gold[places]), 1.0)
    score = emission[np.arange(len(gold)), gold].sum() + model.transitions[gold[places - 1], gold[places]].sum() + model.first[gold[start]].sum() + model.last[gold[end]].sum()
    opening, closing = chance[start].sum(0), chance[end].sum(0)
    np.subtract.at(opening, gold[start], 1.0)
    np.subtract.at(closing, gold[end], 1.0)
    chance[np.arange(len(gold)), gold] -= 1.0
    slots = feats.ravel()
    by_feature = np.column_stack([np.bincount(slots, np.repeat(chance[:, k], feats.shape[1]), len(model.features)) for k in range(chance.shape[1])])
    return float(log_z.sum() - score), Model(model.labels, by_feature, moves, opening, closing)


def _sentences(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(feats, gold, lengths) of runs of whole sentences with about ``TOKENS_AT_ONCE`` tokens."""
    column = batch.column(0)
    lengths = np.diff(column.offsets.to_numpy())
    inner = column.flatten()
    width = len(inner.flatten()) // max(len(inner), 1)
    feats = inner.flatten().to_numpy().reshape(-1, width) if width else np.zeros((0, 0), np.int32)
    gold = batch.column(1).flatten().to_numpy(zero_copy_only=False)
    upto = np.concatenate([[0], np.cumsum(lengths)])
    i = 0
    while i < len(lengths):
        j = max(i + 1, int(np.searchsorted(upto, upto[i] + TOKENS_AT_ONCE, "right")) - 1)
        yield feats[upto[i] : upto[j]], gold[upto[i] : upto[j]] if len(gold) else gold, lengths[i:j]
        i = j


def _gradients(shared, labels: list[str], size: int):
    """Encoded examples -> (block, part): this task's gradient in blocks of doubles, its loss as block -1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, loss, total = Model.of(labels, shared.value, size), 0.0, np.zeros(n_weights(len(labels), size))
        own = Model.of(labels, total, size)  # views of the sum
        for batch in batches:
            for feats, gold, lengths in _sentences(batch):
                value, part = loss_and_gradient(model, feats, gold, lengths)
                loss += value
                for name in ("features", "transitions", "first", "last"):
                    getattr(own, name)[...] += getattr(part, name)
        blocks = [(-1, np.array([loss]))] + [(k, total[at : at + BLOCK]) for k, at in enumerate(range(0, len(total), BLOCK))]
        for k, part in blocks:
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([part.astype("<f8").tobytes()], pa.binary())], names=["block", "part"])

    return run


def _add_blocks(table: pa.Table) -> pa.Table:
    parts = [np.frombuffer(x, "<f8") for x in table.column("part").to_pylist()]  # one from each of a fixed number of tasks
    return pa.table({"block": pa.array([table.column("block")[0].as_py()], pa.int32()), "part": pa.array([np.sum(parts, axis=0).astype("<f8").tobytes()], pa.binary())})


def total_gradient(encoded: DataFrame, labels: list[str], vector: np.ndarray, size: int) -> tuple[float, np.ndarray]:
    """Loss and gradient over all of ``encoded`` at the weights ``vector``: one Spark job."""
    context = encoded.sparkSession.sparkContext
    shared = context.broadcast(vector)
    parts = encoded.select("feats", "gold").coalesce(TASKS_A_CORE * context.defaultParallelism).mapInArrow(_gradients(shared, labels, size), "block int, part binary")
    table = parts.groupBy("block").applyInArrow(_add_blocks, "block int, part binary").toArrow()  # as large as the model
    shared.destroy()
    blocks = {k: np.frombuffer(x, "<f8") for k, x in zip(table.column("block").to_pylist(), table.column("part").to_pylist(), strict=True)}
    if -1 not in blocks:
        return 0.0, np.zeros_like(vector)
    return float(blocks[-1][0]), np.concatenate([blocks[k] for k in range(len(blocks) - 1)])


def _direction(slope: np.ndarray, steps: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The quasi-Newton direction of descent, from the last steps and changes of the gradient."""
    q, kept = slope.copy(), []
    for s, y in reversed(steps):
        rho = 1.0 / (s @ y)
        a = rho * (s @ q)
        q -= a * y
        kept.append((rho, a))
    if steps:
        s, y = steps[-1]
        q *= (s @ y) / (y @ y)
    for (s, y), (rho, a) in zip(steps, reversed(kept), strict=True):
        q += s * (a - rho * (y @ q))
    return -q


def minimise(at: Callable[[np.ndarray], tuple[float, np.ndarray]], x: np.ndarray, l1: float = 0.0, rounds: int = 100, memory: int = 8, tolerance: float = 1e-5) -> tuple[np.ndarray, float]:
    """Limited-memory quasi-Newton with backtracking; with ``l1`` > 0 a step stays in the orthant it starts from."""

    def slope_of(x: np.ndarray, g: np.ndarray) -> np.ndarray:
        if not l1:
            return g
        right, left = g + l1, g - l1
        return np.where(x > 0, right, np.where(x < 0, left, np.where(right < 0, right, np.where(left > 0, left, 0.0))))

    f, g = at(x)
    f += l1 * np.abs(x).sum()
    steps: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(rounds):
        slope = slope_of(x, g)
        d = _direction(slope, steps)
        if l1:
            d[d * slope >= 0] = 0.0
        if -(d @ slope) <= 1e-12:
            break
        side, length = np.where(x != 0, np.sign(x), -np.sign(slope)), 1.0 if steps else 1.0 / max(1.0, float(np.linalg.norm(slope)))
        while True:
            new = x + length * d
            if l1:
                new[new * side < 0] = 0.0
            value, g_new = at(new)
            value += l1 * np.abs(new).sum()
            if value <= f + 1e-4 * (slope @ (new - x)) or length < 1e-8:
                break
            length /= 2
        if value >= f:
            break
        s, y = new - x, g_new - g
        if s @ y > 1e-10:
            steps = [*steps[1 - memory :], (s, y)] if memory > 1 else [(s, y)]
        done = f - value < tolerance * max(1.0, abs(value))
        x, f, g = new, value, g_new
        if done:
            break
    return x, f


def labels_in(examples: DataFrame) -> list[str]:
    """``O``, then the other labels of the examples, sorted."""
    found = [r.label for r in examples.select(F.explode("labels").alias("label")).filter("label is not null and label <> 'O'").distinct().orderBy("label").limit(MOST_LABELS + 1).collect()]
    if len(found) > MOST_LABELS:
        raise ValueError(f"over {MOST_LABELS} labels: a chain's work grows with the square of their number")
    return ["O", *found]


def fit(examples: DataFrame, l2: float = 0.1, l1: float = 0.0, rounds: int = 60, size: int = SIZE, labels: list[str] | None = None, hints: str | None = None) -> Model:
    """A chain trained on all ``examples`` (id, tokens, labels): least loss + l2 * |w|^2 + l1 * |w|.

    ``hints`` names a column array<string> with one more feature for each token.
    """
    labels = labels or labels_in(examples)
    encoded = materialise(encode(examples, labels, size, hints))
    if encoded.filter(F.exists("gold", lambda y: y < 0)).limit(1).count():
        raise ValueError(f"labels beyond {labels}")

    def at(x: np.ndarray) -> tuple[float, np.ndarray]:
        loss, g = total_gradient(encoded, labels, x, size)
        return loss + l2 * float(x @ x), g + 2 * l2 * x

    best, _ = minimise(at, np.zeros(n_weights(len(labels), size)), l1, rounds)
    return Model.of(labels, best, size)


def best_paths(model: Model, scores: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The best label of each token of sentences laid end to end (scores: tokens x labels), many sentences side by side.

    Ties go to the lesser label, from the end on, as in ``sequences.viterbi``.
    """
    order = np.argsort(-lengths, kind="stable")
    start, lengths = (np.cumsum(lengths) - lengths)[order], lengths[order]
    into = np.ascontiguousarray(model.transitions.T)  # scores of coming to a label from every label
    reach, back = scores.copy(), np.zeros(scores.shape, np.min_scalar_type(scores.shape[1]))
    reach[start] = model.first + scores[start]
    going = np.searchsorted(-lengths, -np.arange(int(lengths.max(initial=0))), "left")  # sentences that are still going on
    for t in range(1, len(going)):
        now = start[: going[t]] + t
        for i in range(0, len(now), TOKENS_AT_ONCE):
            part = now[i : i + TOKENS_AT_ONCE]
            ways = reach[part - 1][:, None, :] + into[None]
            best = ways.argmax(2)
            back[part] = best
            reach[part] += np.take_along_axis(ways, best[:, :, None], 2)[:, :, 0]
    path = np.zeros(len(scores), np.int64)
    path[start + lengths - 1] = (reach[start + lengths - 1] + model.last).argmax(1)
    for t in range(len(going) - 1, 0, -1):
        now = start[: going[t]] + t
        path[now - 1] = back[now, path[now]]
    return path


def _decode(shared, labels: list[str]):
    """Encoded examples -> (id, labels)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, names = shared.value, pa.array(labels, pa.string())
        for batch in batches:
            ids, done = batch.column(0), 0
            for feats, _, lengths in _sentences(batch.select([1, 2])):
                path = best_paths(model, emissions(model, feats), lengths)
                tags = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32()), names.take(pa.array(path)))
                yield pa.RecordBatch.from_arrays([ids.slice(done, len(lengths)), tags], names=["id", "labels"])
                done += len(lengths)

    return run


def tag(examples: DataFrame, model: Model, hints: str | None = None) -> DataFrame:
    """id, labels: the best labels of each example's tokens; none for an example without tokens.

    A batch's sentences are decoded side by side where their scores are made, so the scores never leave the task.
    """
    encoded = encode(examples.drop("labels"), model.labels, len(model.features), hints)
    shared = examples.sparkSession.sparkContext.broadcast(model)
    return encoded.mapInArrow(_decode(shared, model.labels), "id string, labels array<string>")
