"""Viterbi decoding of many short chains at once.

Chains are laid end to end; step ``t`` of every chain that is still running is
decoded together, so the Python loop runs as often as the longest chain is long
and not as often as there are observations.
"""

from __future__ import annotations

import numpy as np


def viterbi(emit: np.ndarray, starts: np.ndarray, lengths: np.ndarray, trans: np.ndarray, init: np.ndarray) -> np.ndarray:
    """Best state of every observation.

    emit: [observations, states] log scores; starts, lengths: first observation
    and number of observations of each chain; trans: [from, to]; init: [states].
    Chains of length 0 are allowed.
    """
    out = np.zeros(len(emit), np.int8)
    keep = lengths > 0
    starts, lengths = starts[keep], lengths[keep]
    if not len(starts):
        return out
    order = np.argsort(-lengths, kind="stable")
    starts, lengths = starts[order], lengths[order]
    # running[t]: number of chains longer than t
    running = len(lengths) - np.searchsorted(np.sort(lengths), np.arange(lengths[0]), side="right")
    score = emit[starts] + init
    back = np.zeros(emit.shape, np.int8)
    final = np.empty(len(starts), np.int8)
    for t in range(1, lengths[0]):
        n = running[t]
        final[n : len(score)] = score[n:].argmax(1)
        at = starts[:n] + t
        step = score[:n, :, None] + trans
        best = step.argmax(1)
        back[at] = best
        score = np.take_along_axis(step, best[:, None, :], 1)[:, 0] + emit[at]
    final[: len(score)] = score.argmax(1)
    state = final
    for t in range(lengths[0] - 1, -1, -1):
        n = running[t]
        at = starts[:n] + t
        out[at] = state[:n]
        if t:
            state[:n] = back[at, state[:n]]
    return out
