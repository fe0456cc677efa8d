"""BagMinHash signatures of weighted multisets, vectorised over many documents.

For every element a Poisson process runs over time on each discretised range of its weight; a
point falls on a uniformly drawn register, and a register keeps its first point. Ranges are
nested by powers of two ([0,1), [1,2), [2,4), ...): a weight takes whole ranges as they are and of the last one only points whose
place lies below the weight, so the cost grows with the logarithm of a weight. Two signatures agree in a
register with probability sum(min weights) / sum(max weights). Points are drawn up to a time by
which all registers are likely hit; documents for which they are not are drawn again for longer.
"""

from __future__ import annotations

import numpy as np

_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (public-domain constants of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _uniform(x: np.ndarray) -> np.ndarray:
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53


def signatures(doc: np.ndarray, element: np.ndarray, weight: np.ndarray, n_docs: int, registers: int) -> np.ndarray:
    """(n_docs, registers) of 64-bit values. doc must be sorted; weights are counts; a document without elements gets zeros."""
    total = np.bincount(doc, weights=weight, minlength=n_docs)
    out = np.zeros((n_docs, registers), np.uint64)
    best = np.full(n_docs * registers, np.inf)
    value = np.zeros(n_docs * registers, np.uint64)
    open_docs = total > 0
    until = np.where(open_docs, (np.log(registers) + 4.0) / np.maximum(total, 1), 0.0)
    levels = np.zeros(len(weight), np.int64)  # ranges of an element: 1 + ceil(log2(weight))
    levels[weight > 0] = 1 + np.ceil(np.log2(weight[weight > 0])).astype(np.int64)
    while open_docs.any():
        use = open_docs[doc]
        d0, e0, w0, l0 = doc[use], element[use], weight[use], levels[use]
        item = np.repeat(np.arange(len(d0)), l0)
        level = np.arange(len(item)) - np.repeat(np.cumsum(l0) - l0, l0)
        low = np.where(level > 0, 2.0 ** (level - 1), 0.0)
        size = np.where(level > 0, low, 1.0)
        state = mix(e0[item] + _GOLDEN * (level.astype(np.uint64) + np.uint64(1)))
        d, w = d0[item], w0[item].astype(np.float64)
        time, limit = np.zeros(len(d)), until[d]
        while len(d):
            state = mix(state + _GOLDEN)
            time = time - np.log(_uniform(state)) / (registers * size)
            alive = time <= limit
            state, time, limit, d, w, low, size = (x[alive] for x in (state, time, limit, d, w, low, size))
            if not len(d):
                break
            place = low + size * _uniform(mix(state ^ np.uint64(0x5851F42D4C957F2D)))
            inside = place < w
            register = (mix(state ^ np.uint64(0x14057B7EF767814F)) % np.uint64(registers)).astype(np.int64)
            at, when, mark = (d * registers + register)[inside], time[inside], state[inside]
            order = np.lexsort((when, at))
            at, when, mark = at[order], when[order], mark[order]
            first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]])) if len(at) else np.zeros(0, np.int64)
            at, when, mark = at[first], when[first], mark[first]
            better = when < best[at]
            best[at[better]], value[at[better]] = when[better], mark[better]
        missing = np.isinf(best.reshape(n_docs, registers)).any(axis=1) & (total > 0)
        open_docs = missing
        until = until * 2
    done = value.reshape(n_docs, registers)
    out[total > 0] = done[total > 0]
    return out
