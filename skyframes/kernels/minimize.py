"""Minimisers for expensive merits: dense scan with Brent refinement, and a bounded simplex. Every trial is remembered."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

from ..functions.expressions import reflect


@dataclass
class Search:
    best: tuple[float, ...]
    merit: float
    converged: bool
    agrees: bool = True
    samples: list[tuple[tuple[float, ...], float]] = field(default_factory=list)


def remembered(merit: Callable[..., float], samples: list) -> Callable[..., float]:
    known: dict[tuple[float, ...], float] = {}

    def run(*x: float) -> float:
        if x not in known:
            value = float(merit(*x))
            if not math.isfinite(value):
                raise ValueError(f"merit at {x} is not finite")
            known[x] = value
            samples.append((x, value))
        return known[x]

    return run


def evaluation_budget(samples: int) -> int:
    """The least number of evaluations that a joint search may be given."""
    return 2 * (samples + 16) + 4


def brent(f: Callable[[float], float], low: float, mid: float, high: float, tolerance: float, most: int) -> tuple[float, float, bool]:
    """Brent's minimiser in a bracket: parabolic steps where they serve, golden sections elsewhere."""
    golden = (3 - math.sqrt(5)) / 2
    a, b, x = low, high, mid
    w = v = x
    fx = fw = fv = f(x)
    d = e = 0.0
    for _ in range(most):
        m, tol = (a + b) / 2, tolerance * max(1.0, abs(x)) / 2 + 1e-15
        if abs(x - m) <= 2 * tol - (b - a) / 2:
            return x, fx, True
        p = q = r = 0.0
        if abs(e) > tol:
            r = (x - w) * (fx - fv)
            q = (x - v) * (fx - fw)
            p = (x - v) * q - (x - w) * r
            q = 2 * (q - r)
            p, q = (-p, q) if q > 0 else (p, -q)
            r, e = e, d
        if abs(p) < abs(q * r / 2) and q * (a - x) < p < q * (b - x):
            d = p / q
            if x + d - a < 2 * tol or b - x - d < 2 * tol:
                d = math.copysign(tol, m - x)
        else:
            e = (b if x < m else a) - x
            d = golden * e
        u = x + (d if abs(d) >= tol else math.copysign(tol, d))
        fu = f(u)
        if fu <= fx:
            a, b = (x, b) if u >= x else (a, x)
            v, fv, w, fw, x, fx = w, fw, x, fx, u, fu
        else:
            a, b = (u, b) if u < x else (a, u)
            if fu <= fw or w == x:
                v, fv, w, fw = w, fw, u, fu
            elif fu <= fv or v in (x, w):
                v, fv = u, fu
    return x, fx, False


def minimize_contrast(merit: Callable[[float], float], low: float, high: float, samples: int = 9, tolerance: float = 1e-4, most: int = 64, batch: Callable[[list[float]], list[float]] | None = None) -> Search:
    """The first lowest of an even grid (``batch`` may evaluate it at once), then Brent between its neighbours."""
    if not low < high or samples < 3:
        raise ValueError("needs low < high and three samples")
    log: list = []
    grid = [low + (high - low) * i / (samples - 1) for i in range(samples)]
    if batch:
        table = dict(zip(grid, batch(grid), strict=True))
        inner = lambda x: table[x] if x in table else merit(x)
    else:
        inner = merit
    f = remembered(inner, log)
    values = [f(x) for x in grid]
    i = min(range(samples), key=lambda k: (values[k], k))
    a, b = grid[max(0, i - 1)], grid[min(samples - 1, i + 1)]
    x, fx, done = brent(f, a, grid[i], b, tolerance, most - samples)
    return Search((x,), fx, done and 0 < i < samples - 1, fx <= values[i], log)


def minimize_position(merit: Callable[[float, float, float], float], start: tuple[float, float, float], bound: float, contrast: tuple[float, float], samples: int = 9, tolerance: float = 1e-4, position_tolerance: float = 1e-3, merit_tolerance: float = 1e-9, most: int = 192) -> Search:
    """Row, column and contrast: a contrast scan, a simplex reflected into the bounds (1, 2, 1/2, 1/2), a last scan."""
    if most < evaluation_budget(samples):
        raise ValueError("the budget of evaluations is too small")
    log: list = []
    f = remembered(merit, log)
    row, col, _ = start
    seed = minimize_contrast(lambda c: f(row, col, c), *contrast, samples, tolerance, samples + 16)
    limits = [(row - bound, row + bound), (col - bound, col + bound), contrast]
    fold = lambda x: tuple(reflect(v, *b) for v, b in zip(x, limits, strict=True))
    base = (row, col, seed.best[0])
    steps = (bound / 2, bound / 2, (contrast[1] - contrast[0]) / 8)
    simplex = [base] + [fold(tuple(v + (steps[k] if k == i else 0) for k, v in enumerate(base))) for i in range(3)]
    reserve, done = samples + 16, False
    while len(log) < most - reserve - 4:
        simplex.sort(key=lambda x: f(*x))
        size = max(max(abs(x[k] - simplex[0][k]) for k in (0, 1)) for x in simplex[1:])
        if size <= position_tolerance and f(*simplex[-1]) - f(*simplex[0]) <= merit_tolerance * max(1.0, abs(f(*simplex[0]))):
            done = True
            break
        mid = tuple(sum(x[k] for x in simplex[:-1]) / 3 for k in range(3))
        worst = simplex[-1]
        go = lambda s: fold(tuple(m + s * (m - w) for m, w in zip(mid, worst, strict=True)))  # noqa: E731, B023
        one = go(1.0)
        if f(*one) < f(*simplex[0]):
            two = go(2.0)
            simplex[-1] = two if f(*two) < f(*one) else one
        elif f(*one) < f(*simplex[-2]):
            simplex[-1] = one
        else:
            half = go(0.5 if f(*one) < f(*worst) else -0.5)
            if f(*half) < min(f(*one), f(*worst)):
                simplex[-1] = half
            else:
                simplex = [simplex[0]] + [tuple((a + b) / 2 for a, b in zip(x, simplex[0], strict=True)) for x in simplex[1:]]
    top = min(simplex, key=lambda x: f(*x))
    last = minimize_contrast(lambda c: f(top[0], top[1], c), *contrast, samples, tolerance, samples + 16)
    best = (top[0], top[1], last.best[0]) if last.merit <= f(*top) else top
    return Search(best, f(*best), done and last.converged, last.agrees, log)
