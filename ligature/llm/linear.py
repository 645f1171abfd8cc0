"""Small linear models, trained on the driver from bounded samples or sums."""

from __future__ import annotations

import numpy as np


def train_svm(x: np.ndarray, y: np.ndarray, c: float = 1.0, epochs: int = 30, seed: int = 7) -> np.ndarray:
    """Weights, the last of them the bias, of a support vector machine with squared hinge loss, by coordinate descent in the dual.

    y is 1 or -1. Each class counts as much as the other.
    """
    x = np.hstack((x, np.ones((len(x), 1), x.dtype)))
    share = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())) * len(y)
    soft = 1 / (2 * c * share)
    norms = np.einsum("ij,ij->i", x, x) + soft
    alpha, w = np.zeros(len(y)), np.zeros(x.shape[1])
    draw = np.random.default_rng(seed)
    for _ in range(epochs):
        most = 0.0
        for i in draw.permutation(len(y)):
            gradient = y[i] * (w @ x[i]) - 1 + soft[i] * alpha[i]
            if alpha[i] > 0 or gradient < 0:
                new = max(0.0, alpha[i] - gradient / norms[i])
                w += (new - alpha[i]) * y[i] * x[i]
                most = max(most, abs(gradient))
                alpha[i] = new
        if most < 1e-3:
            break
    return w


def margin_scale(margins: np.ndarray, y: np.ndarray) -> float:
    """The factor a for which 1 / (1 + exp(-a * margin)) fits y best, between 1 and 20."""
    grid = np.geomspace(1, 20, 40)
    loss = [np.logaddexp(0, -a * margins * y).mean() + 1e-3 * a for a in grid]
    return float(grid[int(np.argmin(loss))])


def nn_pu_weights(gram_u: np.ndarray, mean_p: np.ndarray, gram_p: np.ndarray, prior: float, ridge: float = 1e-3, steps: int = 400) -> np.ndarray:
    """Weights w that minimise the non-negative risk  prior * Rp+ + max(0, Ru- - prior * Rp-)  with squared loss (1 - y * w.x)^2 / 4.

    gram_u = E[x x'] over the unlabelled, gram_p and mean_p over the positives: the risks of any w follow from these exactly. While the
    estimate of the negatives' risk is below zero, a step goes the other way along it.
    """
    mean_u = gram_u[-1]  # the last feature is 1
    d = len(mean_p)
    keep = np.eye(d)
    keep[-1, -1] = 0
    shape = np.linalg.inv(gram_u + ridge * keep + 1e-9 * np.eye(d))
    w = shape @ (2 * prior * mean_p - mean_u)  # where the max is not in the way this is the minimum
    best, least = w, np.inf
    for step in range(steps):
        rp_pos = (w @ gram_p @ w - 2 * w @ mean_p + 1) / 4
        rp_neg = (w @ gram_p @ w + 2 * w @ mean_p + 1) / 4
        ru_neg = (w @ gram_u @ w + 2 * w @ mean_u + 1) / 4
        inner = ru_neg - prior * rp_neg
        risk = prior * rp_pos + max(0.0, inner) + ridge / 4 * w @ keep @ w
        if risk < least:
            best, least = w, risk
        grad_inner = (gram_u @ w + mean_u - prior * (gram_p @ w + mean_p)) / 2
        if inner >= 0:
            gradient = prior * (gram_p @ w - mean_p) / 2 + grad_inner + ridge / 2 * keep @ w
        else:
            gradient = -grad_inner
        w = w - 0.5 / (1 + step / 20) * shape @ gradient
    return best
