"""Small searches and eigenvalue methods on the driver or within a group; everything is maximised or decomposed in numpy."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np

#: Shifts of the starts of a search from several places (fixed values).
SHIFTS = (0.0, 0.1, -0.1, 0.3, -0.3, 0.5)


@dataclass(frozen=True)
class Optimum:
    x: np.ndarray
    value: float
    rounds: int
    converged: bool


def nelder_mead(f: Callable[[np.ndarray], float], x0, step: float = 0.1, rounds: int = 1000, tolerance: float = 1e-8) -> Optimum:
    """Climbs by a simplex of len(x0) + 1 points; it has converged once points and values lie within tolerance.

    The worst point is put on the far side of the middle of the others: as far (1), twice as far, or half as far, and if
    none helps, all points move half the way to the best. Ties keep the order in which points came.
    """
    x0 = np.asarray(x0, float)
    if not len(x0):
        return Optimum(x0, f(x0), 0, True)
    points = x0 + np.vstack([np.zeros(len(x0)), step * np.eye(len(x0))])
    values = np.array([f(p) for p in points])
    done, k = False, 0
    while k < rounds and not done:
        k += 1
        order = np.argsort(-values, kind="stable")
        points, values = points[order], values[order]
        done = np.linalg.norm(points[1:] - points[0], axis=1).max() < tolerance and values[0] - values[-1] < tolerance
        if done:
            break
        away = points[:-1].mean(0) - points[-1]
        middle = points[-1] + away
        new = middle + away
        value = f(new)
        if value > values[0]:
            far = middle + 2 * away
            beyond = f(far)
            points[-1], values[-1] = (far, beyond) if beyond > value else (new, value)
        elif value > values[-2]:
            points[-1], values[-1] = new, value
        else:
            near = middle + away / 2
            inner = f(near)
            if inner > values[-1]:
                points[-1], values[-1] = near, inner
            else:
                points[1:] = (points[1:] + points[0]) / 2
                values[1:] = [f(p) for p in points[1:]]
    best = int(values.argmax())
    return Optimum(points[best], float(values[best]), k, bool(done))


def coordinate_ascent(f: Callable[[np.ndarray], float], x0, step: float = 0.3, rounds: int = 3000, tolerance: float = 1e-10) -> Optimum:
    """Tries a step up and down each coordinate in turn; a round without gain halves the step, and a step below tolerance ends."""
    x = np.array(x0, float)
    value = f(x)
    if not len(x):
        return Optimum(x, value, 0, True)
    for k in range(1, rounds + 1):
        before = value
        for move in np.vstack(list(zip(np.eye(len(x)), -np.eye(len(x)), strict=True))).reshape(len(x), 2, -1):
            for m in move:
                there = f(x + step * m)
                if there > value:
                    x, value = x + step * m, there
                    break
        if value == before:
            step /= 2
            if step < tolerance:
                return Optimum(x, float(value), k, True)
    return Optimum(x, float(value), rounds, False)


def multistart(f: Callable[[np.ndarray], float], x0, step: float = 0.3, rounds: int = 3000, tolerance: float = 1e-10) -> Optimum:
    """The best of the ascents from x0 and from x0 shifted in all coordinates; the first of equal ones."""
    return max((coordinate_ascent(f, np.asarray(x0, float) + s, step, rounds, tolerance) for s in SHIFTS), key=lambda o: o.value)


def projected_gradient(slope: Callable[[np.ndarray], np.ndarray], project: Callable[[np.ndarray], np.ndarray], x0, rate: float = 0.5, rounds: int = 200) -> np.ndarray:
    """Steps against slope, each followed by a projection to what is allowed."""
    x = np.asarray(x0, float)
    for _ in range(rounds):
        x = project(x - rate * slope(x))
    return x


def _signed(v: np.ndarray) -> np.ndarray:
    """v with its first entry that isn't 0 positive."""
    big = np.flatnonzero(np.abs(v) > 1e-12)
    return -v if len(big) and v[big[0]] < 0 else v


def power_method(a: np.ndarray, rounds: int = 1000, tolerance: float = 1e-10) -> tuple[float, np.ndarray]:
    """The eigenvalue of largest size and its vector of length 1, from equal entries on. No convergence or a zero image: ValueError."""
    a = np.asarray(a, float)
    v = np.full(len(a), 1 / np.sqrt(len(a)))
    for _ in range(rounds):
        w = a @ v
        size = np.linalg.norm(w)
        if size < 1e-300:
            raise ValueError("singular")
        w /= size
        w = w if w @ v >= 0 else -w
        gap, v = np.linalg.norm(w - v), w
        if gap < tolerance:
            break
    if gap > 1e-4:
        raise ValueError("not converged")
    return float(v @ a @ v), _signed(v)


def deflate(a: np.ndarray, value: float, vector: np.ndarray) -> np.ndarray:
    return np.asarray(a, float) - value * np.outer(vector, vector)


def top_eigen(a: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k leading eigenvalues and vectors (rows), each by power_method on what the ones before leave."""
    if not 0 <= k <= len(a):
        raise ValueError("more components than rows")
    found = []
    for _ in range(k):
        found.append(power_method(a))
        a = deflate(a, *found[-1])
    found.sort(key=lambda x: -x[0])
    return np.array([x for x, _ in found]), np.array([v for _, v in found])


def jacobi(a: np.ndarray, sweeps: int = 100) -> tuple[np.ndarray, np.ndarray]:
    """All eigenvalues, falling, and their vectors (rows) of a symmetric matrix: plane rotations that clear one pair after another."""
    a, turns = np.array(a, float), np.eye(len(a))
    for _ in range(sweeps):
        if np.sum(np.triu(a, 1) ** 2) < 1e-18:
            break
        for p, q in zip(*np.triu_indices(len(a), 1), strict=True):
            if abs(a[p, q]) < 1e-18:
                continue
            angle = 0.5 * np.arctan2(2 * a[p, q], a[q, q] - a[p, p])
            c, s = np.cos(angle), np.sin(angle)
            turn = np.eye(len(a))
            turn[[p, q, p, q], [p, q, q, p]] = c, c, s, -s
            a, turns = turn.T @ a @ turn, turns @ turn
    order = np.argsort(-np.diag(a), kind="stable")
    return np.diag(a)[order], turns[:, order].T
