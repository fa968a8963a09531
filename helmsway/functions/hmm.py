"""Forward-backward probabilities of a small hidden Markov model, over many series at once."""

from __future__ import annotations

import numpy as np


def posteriors(emissions: list[np.ndarray], moves: list[np.ndarray], chunk: int = 256, warm_up: int = 96) -> list[tuple[np.ndarray, np.ndarray]]:
    """State probabilities (n, k) of each series, and those of the moves (n, k, k) that lead to each reading.

    ``emissions`` has the likelihood (n, k) of each reading in each state, ``moves`` (n, k, k) that of
    each step from the state before to that of the reading; where all rows of a move are alike the
    past is forgotten. The first move of a series must be such. Every series is cut into chunks, and
    all chunks of all series run side by side, each with ``warm_up`` readings of its neighbours on
    either side; the chain forgets its start within far fewer steps.
    """
    k, width = emissions[0].shape[1], chunk + 2 * warm_up
    pieces = [-(-len(x) // chunk) for x in emissions]
    e, m = np.ones((sum(pieces), width, k)), np.full((sum(pieces), width, k, k), 1.0 / k)
    begin = np.cumsum([0, *pieces])
    for x, y, first, count in zip(emissions, moves, begin, pieces):
        at = np.arange(count)[:, None] * chunk + np.arange(width)[None, :]
        for whole, part, blank in ((e, x, 1.0), (m, y, 1.0 / k)):
            padded = np.full((count * chunk + 2 * warm_up, *part.shape[1:]), blank)
            padded[warm_up : warm_up + len(part)] = part
            whole[first : first + count] = padded[at]
    alpha, beta = np.empty_like(e), np.empty_like(e)
    alpha[:, 0] = e[:, 0] / e[:, 0].sum(axis=1, keepdims=True)
    for t in range(1, width):
        a = np.einsum("ci,cij->cj", alpha[:, t - 1], m[:, t]) * e[:, t]
        alpha[:, t] = a / a.sum(axis=1, keepdims=True)
    beta[:, -1] = 1.0
    for t in range(width - 2, -1, -1):
        b = np.einsum("cij,cj->ci", m[:, t + 1], beta[:, t + 1] * e[:, t + 1])
        beta[:, t] = b / b.sum(axis=1, keepdims=True)
    core = slice(warm_up, warm_up + chunk)
    p = (alpha * beta)[:, core]
    p = p / p.sum(axis=2, keepdims=True)
    steps = alpha[:, warm_up - 1 : warm_up + chunk - 1, :, None] * m[:, core] * (e * beta)[:, core, None, :]
    steps = steps / steps.sum(axis=(2, 3), keepdims=True)
    cut = [(slice(first, first + count), len(x)) for x, first, count in zip(emissions, begin, pieces)]
    return [(p[s].reshape(-1, k)[:n], steps[s].reshape(-1, k, k)[:n]) for s, n in cut]
