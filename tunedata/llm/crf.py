"""Linear-chain conditional random field: training by its likelihood, decoding by Viterbi, both over many
chains at once in numpy. A chain is a run of items; an item is a row of feature ids."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

#: Cells (chains times longest chain) of one decoding batch, but for a single longer chain.
BATCH_CELLS = 1 << 15
BANNED = -1e4


@dataclass(frozen=True)
class Crf:
    """``emit[feature, label]`` and ``move[label, label]``; the first label is the outside one, in
    which a chain starts and ends. Moves that ``allowed`` forbids weigh ``BANNED``."""

    emit: np.ndarray
    move: np.ndarray


def batches(lengths: np.ndarray) -> Iterator[np.ndarray]:
    """Indices of chains, longest first, in batches of similar length."""
    order = np.argsort(-lengths, kind="stable")
    at = 0
    while at < len(order):
        n = max(1, BATCH_CELLS // max(int(lengths[order[at]]), 1))
        yield order[at:at + n]
        at += n


def viterbi(model: Crf, features: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The likeliest labels of all items; ``starts`` and ``lengths`` cut the items into chains. Of equal
    scores the lower label wins."""
    labels = np.zeros(len(features), np.int8)
    for chosen in batches(lengths):
        first, length = starts[chosen], lengths[chosen]
        steps, n = int(length[0]), len(chosen)
        back = np.zeros((steps, n, len(model.move)), np.int8)
        score = model.move[0] + model.emit[features[first]].sum(axis=1)
        for t in range(1, steps):
            live = int(np.searchsorted(-length, -t, side="left"))  # chains longer than t
            paths = score[:live, :, None] + model.move
            back[t, :live] = paths.argmax(axis=1)
            score[:live] = paths.max(axis=1) + model.emit[features[first[:live] + t]].sum(axis=1)
        at = (score + model.move[:, 0]).argmax(axis=1)
        for t in range(steps - 1, -1, -1):
            live = int(np.searchsorted(-length, -t, side="left"))
            labels[first[:live] + t] = at[:live]
            if t:
                at[:live] = back[t, np.arange(live), at[:live]]
    return labels


def _sum_exp(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


def _expectations(emit: np.ndarray, move: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Label probabilities per cell ``[chain, step, label]`` and expected moves, by forward and backward sums.
    Chains are padded; the outside label is fixed beyond their ends."""
    n, steps, k = emit.shape
    forward = np.full((n, steps, k), BANNED)
    backward = np.zeros((n, steps, k))
    forward[:, 0] = move[0] + emit[:, 0]
    for t in range(1, steps):
        nxt = _sum_exp(forward[:, t - 1, :, None] + move, 1) + emit[:, t]
        forward[:, t] = np.where((t < length)[:, None], nxt, forward[:, t - 1])
    backward[:, -1] = move[:, 0]
    for t in range(steps - 2, -1, -1):
        prev = _sum_exp(move + (emit[:, t + 1] + backward[:, t + 1])[:, None, :], 2)
        backward[:, t] = np.where((t + 1 < length)[:, None], prev, move[:, 0])
    total = _sum_exp(forward[:, -1] + move[:, 0], 1)
    inside = (np.arange(steps) < length[:, None])[:, :, None]
    cells = np.exp(np.minimum(forward + backward - total[:, None, None], 0)) * inside
    moves = np.zeros((k, k))
    for t in range(1, steps):
        pair = forward[:, t - 1, :, None] + move + (emit[:, t] + backward[:, t])[:, None, :] - total[:, None, None]
        moves += (np.exp(np.minimum(pair, 0)) * (t < length)[:, None, None]).sum(axis=0)
    moves[0] += cells[:, 0].sum(axis=0)
    ends = cells[np.arange(n), length - 1].sum(axis=0)
    moves[:, 0] += ends
    return cells, moves


def train(features: np.ndarray, labels: np.ndarray, starts: np.ndarray, lengths: np.ndarray, n_features: int,
          allowed: np.ndarray, rounds: int = 80, rate: float = 0.25, penalty: float = 0.02) -> Crf:
    """Gradient ascent on the penalised log likelihood, with a step size per weight. All chains take part
    in every round; nothing is drawn at random, so the same rows give the same model."""
    k = len(allowed)
    emit, move = np.zeros((n_features, k)), np.where(allowed, 0.0, BANNED)
    seen_emit, seen_move = np.zeros_like(emit), np.zeros_like(move)
    steps = int(lengths.max()) if len(lengths) else 0
    if not steps:
        return Crf(emit.astype(np.float32), move.astype(np.float32))
    cell = starts[:, None] + np.minimum(np.arange(steps), lengths[:, None] - 1)
    inside = np.arange(steps) < lengths[:, None]
    width = features.shape[1]
    gold_moves = np.zeros((k, k))
    for s, n in zip(starts, lengths):
        path = [0, *labels[s:s + n], 0]
        np.add.at(gold_moves, (path[:-1], path[1:]), 1)
    flat = features.ravel()
    for _ in range(rounds):
        scores = emit[features].sum(axis=1)
        cells, moves = _expectations(scores[cell], move, lengths)
        off = np.zeros((len(features), k))
        off[cell[inside]] = -cells[inside]
        off[np.arange(len(features)), labels] += 1
        grad = np.stack([np.bincount(flat, np.repeat(off[:, j], width), n_features) for j in range(k)], axis=1) - penalty * emit
        grad_move = np.where(allowed, gold_moves - moves - penalty * move, 0)
        seen_emit += grad ** 2
        seen_move += grad_move ** 2
        emit += rate * grad / np.sqrt(seen_emit + 1e-8)
        move += rate * grad_move / np.sqrt(seen_move + 1e-8)
    return Crf(emit.astype(np.float32), move.astype(np.float32))
