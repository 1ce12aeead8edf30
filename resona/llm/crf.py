"""A two-state linear-chain conditional random field in numpy: fitting, and marginals of many chains at once.

State 0 is the ordinary one. A chain starts from state 0. The score of state 1 at
a position is ``features @ weights``, that of state 0 is 0; ``moves[i, j]`` is the
score of going from i to j.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

CLIP = 30.0


@dataclass
class Chain:
    weights: np.ndarray
    moves: np.ndarray


def _dot(features: np.ndarray, weights: np.ndarray, block: int = 1 << 16) -> np.ndarray:
    """features @ weights block by block, so that no second copy of the features is made."""
    return np.concatenate([features[i : i + block] @ weights for i in range(0, max(len(features), 1), block)])


def _layout(lengths: np.ndarray):
    """Positions of chains laid end to end, step by step with the longest chain first: their order, live chains per step, where each step begins."""
    owner = np.repeat(np.arange(len(lengths)), lengths)
    step = np.arange(len(owner)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    order = np.lexsort((owner, -lengths[owner], step))
    live = np.bincount(step)
    return order, live, np.cumsum(live) - live


class _Rest:
    """Powers of the matrix that an unlisted position stands for, in closed form from its two eigenvalues."""

    def __init__(self, moves: np.ndarray, resting: float):
        run = moves * np.array([1.0, np.exp(np.clip(resting, -CLIP, CLIP))])
        half, root = (run[0, 0] + run[1, 1]) / 2, np.sqrt(((run[0, 0] - run[1, 1]) / 2) ** 2 + run[0, 1] * run[1, 0])
        self.run, self.ratio = run / (half + root), (half - root) / (half + root)
        self.main = (run - (half - root) * np.eye(2)) / (2 * root)
        self.rest = np.eye(2) - self.main

    def power(self, k: np.ndarray) -> np.ndarray:
        return self.main[None] + (self.ratio ** k.astype(float))[:, None, None] * self.rest[None]

    def pairs(self, before: np.ndarray, after: np.ndarray, k: np.ndarray) -> np.ndarray:
        """Summed pair marginals of runs of k positions between forward vectors and backward vectors."""
        some = k > 0
        before, after, k = before[some], after[some], k[some].astype(float)
        a1, a2, b1, b2 = before @ self.main, before @ self.rest, after @ self.main.T, after @ self.rest.T
        power = self.ratio ** (k - 1)
        mixed = (1 - power * self.ratio) / (1 - self.ratio)
        times = lambda x, y: x[:, :, None] * y[:, None, :]
        both = (k[:, None, None] * (times(a1, b1) + power[:, None, None] * times(a2, b2)) + mixed[:, None, None] * (times(a1, b2) + times(a2, b1))) * self.run
        return (both * (k / both.sum((1, 2)))[:, None, None]).sum(0)


def _runs(emission: np.ndarray, moves: np.ndarray, live: np.ndarray, begins: np.ndarray, rest: _Rest | None = None, gaps: np.ndarray | None = None, tails: np.ndarray | None = None):
    """State 1's marginals and summed pair marginals at listed positions, and the pair marginals of unlisted ones, of chains laid out step by step."""
    n = int(live[0]) if len(live) else 0
    own = np.column_stack([np.ones(len(emission)), emission])
    step = np.broadcast_to(moves, (len(emission), 2, 2)) if gaps is None else rest.power(gaps) @ moves
    before, alpha = np.empty((len(emission), 2)), np.empty((len(emission), 2))
    now = np.tile([1.0, 0.0], (n, 1))
    for m, at in zip(live, begins):
        now = before[at : at + m] = now[:m]
        now = (now[:, :, None] * step[at : at + m]).sum(1) * own[at : at + m]
        now = now / now.sum(1, keepdims=True)
        alpha[at : at + m] = now
    last = np.empty((n, 2))
    for m, at in zip(live, begins):
        last[:m] = alpha[at : at + m]
    ending = np.ones((n, 2)) if tails is None else rest.power(tails).sum(2)
    after = np.empty((len(emission), 2))
    back = np.ones((0, 2))
    for m, at in zip(live[::-1], begins[::-1]):
        back = np.concatenate([back, ending[len(back) : m]])
        after[at : at + m] = back
        back = (step[at : at + m] * (back * own[at : at + m])[:, None, :]).sum(2)
        back /= back.sum(1, keepdims=True)
    gamma = alpha * after
    behind = before if gaps is None else (before[:, :, None] * rest.power(gaps)).sum(1)
    both = behind[:, :, None] * moves[None] * (after * own)[:, None, :]
    pairs = (both / both.sum((1, 2), keepdims=True)).sum(0)
    unlisted = np.zeros((2, 2))
    if gaps is not None:
        unlisted = rest.pairs(before, (after * own) @ moves.T, gaps) + rest.pairs(last, np.ones_like(last), tails)
    return gamma[:, 1] / gamma.sum(1), pairs, unlisted


def fit(features: np.ndarray, states: np.ndarray, lengths: np.ndarray, gaps: np.ndarray | None = None, tails: np.ndarray | None = None, steps: int = 150, rate: float = 0.1, penalty: float = 1e-3) -> Chain:
    """Penalised maximum likelihood by Adam, for chains of any lengths laid end to end; nothing is padded or cut.

    features (positions, k), states (positions,), lengths (chains,). ``gaps`` may say
    how many unlisted positions precede each listed one, and ``tails`` how many follow a
    chain's last (or make up a chain of length 0). Unlisted positions are in state 0 and
    have feature 0 alone, with value 1; they count in full, through powers of their matrix.
    """
    lengths = np.asarray(lengths, np.int64)
    bare = np.zeros(0, np.int64)
    if tails is not None:
        bare, tails, lengths = np.asarray(tails)[lengths == 0], np.asarray(tails)[lengths > 0], lengths[lengths > 0]
    order, live, begins = _layout(lengths)
    features, states = features[order], np.asarray(states)[order].astype(int)
    previous = np.zeros(len(states), int)
    for t in range(1, len(live)):
        previous[begins[t] : begins[t] + live[t]] = states[begins[t - 1] : begins[t - 1] + live[t]]
    hidden = np.zeros((2, 2))
    if gaps is not None:
        gaps, tails = np.asarray(gaps)[order], tails[np.argsort(-lengths, kind="stable")]
        final = np.zeros(len(lengths), int)
        for m, at in zip(live, begins):
            final[:m] = states[at : at + m]
        for own, k in ((previous, gaps), (final, tails), (np.zeros(len(bare), int), bare)):
            hidden[:, 0] += np.bincount(own[k > 0], minlength=2)
            hidden[0, 0] += (k[k > 0] - 1).sum()
        previous = np.where(gaps > 0, 0, previous)
    seen = np.bincount(previous * 2 + states, minlength=4).reshape(2, 2) + hidden
    total = max(1, len(states))  # the penalty is weighed against listed positions: ordinary ones are many and alike
    weights, moves = np.zeros(features.shape[1]), np.zeros((2, 2))
    first, second = np.zeros(weights.size + 4), np.zeros(weights.size + 4)
    for k in range(1, steps + 1):
        rest = None if gaps is None else _Rest(np.exp(moves), float(weights[0]))
        gamma, pairs, unlisted = _runs(np.exp(np.clip(_dot(features, weights), -CLIP, CLIP)), np.exp(moves), live, begins, rest, gaps, tails)
        if len(bare):
            unlisted += rest.pairs(np.tile([1.0, 0.0], (len(bare), 1)), np.ones((len(bare), 2)), bare)
        miss = states - gamma
        slope = np.concatenate([sum((miss[i : i + (1 << 16)] @ features[i : i + (1 << 16)] for i in range(0, len(miss), 1 << 16)), np.zeros(len(weights))), (seen - pairs - unlisted).reshape(-1)])
        slope[0] -= unlisted[:, 1].sum()
        slope = slope / total - penalty * np.concatenate([weights, moves.reshape(-1)])
        first, second = 0.9 * first + 0.1 * slope, 0.999 * second + 0.001 * slope**2
        move = rate * (first / (1 - 0.9**k)) / (np.sqrt(second / (1 - 0.999**k)) + 1e-8)
        weights, moves = weights + move[:-4], moves + move[-4:].reshape(2, 2)
    return Chain(weights, moves)


def marginals(chain: Chain, emission: np.ndarray, lengths: np.ndarray, gaps: np.ndarray | None = None, tails: np.ndarray | None = None, resting: float = 0.0) -> np.ndarray:
    """Probability of state 1 at every position of chains laid end to end.

    ``emission`` holds state 1's scores. ``gaps`` may say how many unlisted positions
    precede each listed one (``tails``: follow a chain's last); they all have the
    score ``resting``, and their product of matrices is taken in closed form, so a
    long run costs as much as one position.
    """
    moves = np.exp(chain.moves)
    factor = np.exp(np.clip(emission, -CLIP, CLIP))
    starts = np.cumsum(lengths) - lengths
    order = np.argsort(-lengths, kind="stable")
    sorted_lengths = lengths[order]
    power = _Rest(moves, resting).power
    alpha, out = np.empty((len(emission), 2)), np.empty(len(emission))
    longest = int(sorted_lengths[0]) if len(lengths) else 0
    now = np.tile([1.0, 0.0], (len(lengths), 1))
    for t in range(longest):
        live = order[: np.searchsorted(-sorted_lengths, -t, "left")]
        at = starts[live] + t
        a = now[live]
        if gaps is not None:
            a = np.einsum("ni,nij->nj", a, power(gaps[at]))
        a = a @ moves
        a[:, 1] *= factor[at]
        a /= a.sum(1, keepdims=True)
        now[live] = alpha[at] = a
    back = np.ones((len(lengths), 2))
    if tails is not None and len(lengths):
        back = power(tails).sum(2)
    for t in range(longest - 1, -1, -1):
        live = order[: np.searchsorted(-sorted_lengths, -t, "left")]
        at = starts[live] + t
        b = back[live]
        both = alpha[at] * b
        out[at] = both[:, 1] / both.sum(1)
        b[:, 1] *= factor[at]
        b = b @ moves.T
        if gaps is not None:
            b = np.einsum("nij,nj->ni", power(gaps[at]), b)
        back[live] = b / b.sum(1, keepdims=True)
    return out


def logistic(features: np.ndarray, labels: np.ndarray, weights: np.ndarray | None = None, penalty: float = 1e-2, steps: int = 100) -> np.ndarray:
    """Weights (last: bias) of a logistic regression by Newton steps, halved while they overshoot."""
    x = np.column_stack([features, np.ones(len(features))])
    w, weights = np.zeros(x.shape[1]), np.ones(len(x)) if weights is None else weights
    loss = lambda w: (weights * np.logaddexp(0, (1 - 2 * labels) * (x @ w))).sum() + penalty / 2 * w @ w
    best = loss(w)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -CLIP, CLIP)))
        curve = (x * (weights * p * (1 - p))[:, None]).T @ x + (penalty + 1e-9) * np.eye(len(w))
        move = np.linalg.solve(curve, x.T @ (weights * (labels - p)) - penalty * w)
        while (now := loss(w + move)) > best and np.abs(move).max() > 1e-9:
            move = move / 2
        if best - now < 1e-9 * max(1.0, best):
            break
        w, best = w + move, now
    return w


def apply_logistic(w: np.ndarray, features: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(features @ w[:-1] + w[-1], -CLIP, CLIP)))
