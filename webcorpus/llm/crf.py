"""A linear-chain conditional random field of two labels over sequences of binary features.

Label 0 is content, label 1 boilerplate. An item's score for label 1 is the sum
of the weights of its features (0 for label 0); transitions and the first label
have scores of their own. Fitted by gradient ascent on the penalised likelihood, with steps that shrink to nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

CONTENT, BOILERPLATE = 0, 1


@dataclass
class Field:
    """Weights of the features for boilerplate, scores of transitions [from, to] and of the first label."""

    weights: np.ndarray
    moves: np.ndarray
    first: np.ndarray

    def scores(self, features: np.ndarray) -> np.ndarray:
        """Score of boilerplate for each row of feature numbers."""
        return self.weights[features].sum(axis=1)

    def decode(self, scores: list[float]) -> list[int]:
        """The best labels of a sequence by Viterbi; ties go to content."""
        if not scores:
            return []
        (cc, cb), (bc, bb) = self.moves.tolist()
        content, boiler = float(self.first[0]), float(self.first[1]) + scores[0]
        back = []
        for u in scores[1:]:
            to_content, to_boiler = boiler + bc > content + cc, boiler + bb > content + cb
            back.append((to_content, to_boiler))
            content, boiler = (
                boiler + bc if to_content else content + cc,
                (boiler + bb if to_boiler else content + cb) + u,
            )
        label = int(boiler > content)
        labels = [label]
        for step in reversed(back):
            label = int(step[label])
            labels.append(label)
        return labels[::-1]


def fit(sequences: list[np.ndarray], labels: list[np.ndarray], n_features: int, steps: int = 300, penalty: float = 1e-4) -> Field:
    """A field for sequences of rows of feature numbers and their labels; each sequence counts by its items.

    Without sequences of both labels there is nothing to tell apart: all items are content then.
    """
    field = Field(np.zeros(n_features), np.zeros((2, 2)), np.zeros(2))
    seen = {int(x) for y in labels for x in np.unique(y)}
    if seen != {CONTENT, BOILERPLATE}:
        return field
    order = sorted(range(len(sequences)), key=lambda i: -len(sequences[i]))
    sequences, labels = [sequences[i] for i in order], [labels[i] for i in order]
    lengths = np.array([len(s) for s in sequences])
    flat, gold = np.concatenate(sequences), np.concatenate(labels)
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    active = [int((lengths > t).sum()) for t in range(lengths[0])]  # sequences that are longer than t, the longest first
    items = len(flat)

    def gradient() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        unary = np.zeros((items, 2))
        unary[:, 1] = field.scores(flat)
        forward, backward = np.empty((items, 2)), np.zeros((items, 2))
        forward[starts] = field.first + unary[starts]
        for t in range(1, len(active)):
            at = starts[: active[t]] + t
            forward[at] = np.logaddexp.reduce(forward[at - 1][:, :, None] + field.moves, axis=1) + unary[at]
        for t in range(len(active) - 1, 0, -1):
            at = starts[: active[t]] + t
            backward[at - 1] = np.logaddexp.reduce(field.moves + (unary[at] + backward[at])[:, None, :], axis=2)
        total = np.logaddexp.reduce(forward[starts] + backward[starts], axis=1)
        of = np.repeat(np.arange(len(lengths)), lengths)
        likely = np.exp(forward + backward - total[of][:, None])
        off = (gold == 1) - likely[:, 1]
        weights = np.bincount(flat.ravel(), np.repeat(off, flat.shape[1]), n_features)
        later = np.ones(items, bool)
        later[starts] = False
        at = np.flatnonzero(later)
        pair = np.exp(forward[at - 1][:, :, None] + field.moves + (unary[at] + backward[at])[:, None, :] - total[of[at]][:, None, None])
        moves = np.bincount(2 * gold[at - 1] + gold[at], minlength=4).reshape(2, 2)
        first = np.bincount(gold[starts], minlength=2) - likely[starts].sum(axis=0)
        return weights / items, (moves - pair.sum(axis=0)) / items, first / items

    parts = ("weights", "moves", "first")
    mean, square = {p: 0.0 for p in parts}, {p: 0.0 for p in parts}
    for step in range(1, steps + 1):
        for name, g in zip(parts, gradient()):
            g = g - penalty * getattr(field, name)
            mean[name] = 0.9 * mean[name] + 0.1 * g
            square[name] = 0.99 * square[name] + 0.01 * g * g
            move = mean[name] / (1 - 0.9**step) / (np.sqrt(square[name] / (1 - 0.99**step)) + 1e-8)
            setattr(field, name, getattr(field, name) + 0.1 * (1 - (step - 1) / steps) * move)
    return field
