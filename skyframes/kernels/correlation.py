"""The best correlated rows of one set for each row of another, by blocked products, without a list of all pairs."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

NONE = np.iinfo(np.int64).min
CELLS, PAIRS, LEAST, MOST = 1 << 22, 1 << 18, 1e-100, 1e100


@dataclass
class Rows:
    """Frame numbers (NONE: null), centred pixels as rows (padded with zeros), norms (-1: null) and numbers of pixels."""

    index: np.ndarray
    v: np.ndarray
    norm: np.ndarray
    size: np.ndarray

    def take(self, at: np.ndarray) -> Rows:
        return Rows(self.index[at], self.v[at], self.norm[at], self.size[at])


def exact(t: Rows, r: Rows, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(scores of the pairs, whether they are null), pixels summed in their order."""
    score, null = np.empty(len(i)), np.empty(len(i), bool)
    tv, rv = np.ascontiguousarray(t.v.T), np.ascontiguousarray(r.v.T)
    with np.errstate(all="ignore"):
        for at in range(0, len(i), PAIRS):
            a, b = i[at : at + PAIRS], j[at : at + PAIRS]
            n = np.where((t.norm[a] < 0) | (r.norm[b] < 0), 0.0, t.norm[a] * r.norm[b])
            some, s = ~(n <= 1e-300), np.zeros(len(a))
            for x, y in zip(tv, rv, strict=True):
                s += x[a] * y[b]
            score[at : at + PAIRS] = np.where(some, s / np.where(some, n, 1.0), -np.inf)
            null[at : at + PAIRS] = some & (t.size[a] != r.size[b])
    return score, null


def ranked(owner: np.ndarray, reference: np.ndarray, score: np.ndarray, null: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(pairs, their ranks from 1): the best of each owner; NaN is largest, null least, ties go to the lower reference."""
    nan = np.isnan(score)
    order = np.lexsort((reference, np.where(nan | null, 0.0, -score), np.where(null, 2, np.where(nan, 0, 1)), owner))
    own = owner[order]
    first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]]) if len(own) else np.zeros(0, int)
    rank = np.arange(len(own)) - np.repeat(first, np.diff(np.r_[first, len(own)])) + 1
    return order[rank <= most], rank[rank <= most]


def distinct(r: Rows, most: int) -> Rows:
    """At most ``most`` rows with the same pixels, those with the lowest numbers: no others can be among the best."""
    r = r.take(np.argsort(r.index, kind="stable"))
    seen: dict[bytes, int] = {}
    keep = []
    for k, row in enumerate(np.column_stack([r.v, r.norm, r.size.astype(float)])):
        n = seen[key] = seen.get(key := row.tobytes(), 0) + 1
        if n <= most:
            keep.append(k)
    return r.take(np.array(keep, int))


def candidates(s: np.ndarray, most: int, slack: float) -> tuple[np.ndarray, np.ndarray]:
    """Cells of ``s`` not less than their row's ``most``-th largest, less ``slack``, and a few more.

    The ``most``-th largest of the maxima of groups of columns is a lower bound of it.
    """
    n = s.shape[1]
    groups = n // 32
    if n <= most:
        bound = np.full(len(s), -np.inf)
    elif groups < 4 * most:
        bound = np.partition(s, n - most, axis=1)[:, n - most]
    else:
        tops = s[:, : groups * 32].reshape(len(s), 32, groups).max(axis=1)
        bound = np.partition(tops, groups - most, axis=1)[:, groups - most]
    return np.nonzero(s >= (bound - slack)[:, None])


def best(t: Rows, r: Rows, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(target, reference, score, null, rank) of each target's best references.

    A product of normalised rows finds the candidates; its error is far below the slack that is left. Their scores are then
    summed exactly. Rows with a vanishing, huge or undefined norm are compared with all.
    """
    width = max(t.v.shape[1], r.v.shape[1])
    r = distinct(r, most)
    plain = lambda x: np.flatnonzero((x.norm > LEAST) & (x.norm < MOST) & (x.size == width))
    good_r, good_t = plain(r), np.zeros(len(t.index), bool)
    good_t[plain(t)] = True
    odd_r = np.setdiff1d(np.arange(len(r.index)), good_r)
    unit = (r.v[good_r] / r.norm[good_r, None]).T
    slack, step, parts = 16 * (width + 8) * np.finfo(float).eps, max(1, CELLS // max(1, len(r.index))), []
    for at in range(0, len(t.index), step):
        rows = np.arange(at, min(at + step, len(t.index)))
        usual, odd = rows[good_t[rows]], rows[~good_t[rows]]
        a, b = candidates((t.v[usual] / t.norm[usual, None]) @ unit, most, slack)
        i = np.concatenate([usual[a], np.repeat(usual, len(odd_r)), np.repeat(odd, len(r.index))])
        j = np.concatenate([good_r[b], np.tile(odd_r, len(usual)), np.tile(np.arange(len(r.index)), len(odd))])
        score, null = exact(t, r, i, j)
        keep, _ = ranked(i, r.index[j], score, null, most)
        parts.append((t.index[i[keep]], r.index[j[keep]], score[keep], null[keep]))
    target, reference, score, null = (np.concatenate(x) for x in zip(*parts, strict=True))
    keep, rank = ranked(target, reference, score, null, most)
    return target[keep], reference[keep], score[keep], null[keep], rank
