"""Initial value problems, whole batches of them at once: each row has its own time and step size.

An equation is f(t, y) on arrays t (b,) and y (b, n). A row that fails (a step that is not
finite, too many rejected ones) keeps its status and stops; the others go on.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field
from fractions import Fraction

import numpy as np

from numfold.protocols import Equation

#: nodes, stages, weights, error weights, order
Tableau = tuple[tuple, tuple, tuple, tuple, int]
StepTaker = Callable[[np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


class OdeError(ArithmeticError):
    """A step that is not finite, too many rejected steps, or no interpolation asked for."""


#: Embedded Runge-Kutta tableaus.
RKF45: Tableau = (
    (0, 1 / 4, 3 / 8, 12 / 13, 1, 1 / 2),
    ((), (1 / 4,), (3 / 32, 9 / 32), (1932 / 2197, -7200 / 2197, 7296 / 2197), (439 / 216, -8, 3680 / 513, -845 / 4104), (-8 / 27, 2, -3544 / 2565, 1859 / 4104, -11 / 40)),
    (16 / 135, 0, 6656 / 12825, 28561 / 56430, -9 / 50, 2 / 55),
    (16 / 135 - 25 / 216, 0, 6656 / 12825 - 1408 / 2565, 28561 / 56430 - 2197 / 4104, -9 / 50 + 1 / 5, 2 / 55),
    5,
)
#: Tsitouras 5(4). A stage's first weight is its node less the weights named here.
TSIT_NODES = (0.0, 0.161, 0.327, 0.9, 0.9800255409045097, 1.0)
TSIT_STAGES = (
    (),
    (),
    (0.335480655492357,),
    (-6.359448489975075, 4.362295432869581),
    (-11.74888356406283, 7.495539342889836, -0.09249506636175525),
    (-12.92096931784711, 8.159367898576159, -0.071584973281401, -0.02826905039406838),
)
TSIT_WEIGHTS = (0.09646076681806523, 0.01, 0.4798896504144996, 1.379008574103742, -3.290069515436081, 2.324710524099774)
TSIT_ERRORS = (0.001780011052226, 0.000816434459657, -0.007880878010262, 0.144711007173263, -0.582357165452555, 0.458082105929187, -1 / 66)
TSIT54: Tableau = (
    (*TSIT_NODES, 1.0),
    ((), *((c - sum(rest), *rest) for c, rest in zip(TSIT_NODES[1:], TSIT_STAGES[1:], strict=True)), TSIT_WEIGHTS),
    (*TSIT_WEIGHTS, 0.0),
    TSIT_ERRORS,
    5,
)


def extrapolated(order: int) -> Tableau:
    """A pair of that order and one less, by its rule: Euler's method with 1, 2, ..., `order` steps, extrapolated to step 0.

    All parts share the first stage; the error is the difference to the extrapolation without the coarsest part."""

    def limit(sizes: list[int]) -> dict[int, Fraction]:
        return {n: math.prod((Fraction(n, n - m) for m in sizes if m != n), start=Fraction(1)) for n in sizes}

    sizes = list(range(1, order + 1))
    high, low = limit(sizes), limit(sizes[1:])
    nodes, stages, weights, errors = [Fraction(0)], [()], [Fraction(0)], [Fraction(0)]
    for n in sizes:
        own = [0]
        for i in range(1, n):
            row = [0.0] * len(nodes)
            for k in own:
                row[k] = 1 / n
            own.append(len(nodes))
            nodes.append(Fraction(i, n))
            stages.append(tuple(row))
            weights.append(Fraction(0))
            errors.append(Fraction(0))
        for k in own:
            weights[k] += high[n] / n
            errors[k] += (high[n] - low.get(n, 0)) / n
    return tuple(map(float, nodes)), tuple(stages), tuple(map(float, weights)), tuple(map(float, errors)), order


TABLEAUS: dict[str, Tableau] = {"rkf45": RKF45, "tsit54": TSIT54, "order65": extrapolated(6), "order87": extrapolated(8), "order98": extrapolated(9)}


def explicit(f: Equation, tableau: Tableau) -> StepTaker:
    nodes, stages, weights, errors, _ = tableau

    def combine(ws: tuple, k: list[np.ndarray], like: np.ndarray) -> np.ndarray:
        out = np.zeros_like(like)
        for w, s in zip(ws, k, strict=False):
            if w:
                out += w * s
        return out

    def step(t: np.ndarray, y: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        k: list[np.ndarray] = []
        for c, row in zip(nodes, stages, strict=True):
            k.append(np.asarray(f(t + c * h, y + h[:, None] * combine(row, k, y)), float))
        return y + h[:, None] * combine(weights, k, y), h[:, None] * combine(errors, k, y)

    return step


@dataclass
class Solution:
    """y (b, n) at the end, steps accepted and rejected and the status of each row; with a path, values in between."""

    y: np.ndarray
    accepted: np.ndarray
    rejected: np.ndarray
    status: np.ndarray
    step: StepTaker
    stages: int
    path: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)

    @property
    def evals(self) -> np.ndarray:
        return self.stages * (self.accepted + self.rejected)

    def at(self, time: float | np.ndarray) -> np.ndarray:
        """Values at a time within the path: a step of the method itself from the last point before, so of the method's order."""
        if not self.path:
            raise OdeError("integrate with dense=True to interpolate")
        times, values = np.stack([t for t, _ in self.path]), np.stack([y for _, y in self.path])
        rows = np.arange(times.shape[1])
        time = np.broadcast_to(np.asarray(time, float), rows.shape)
        sign = np.where(times[-1] >= times[0], 1.0, -1.0)
        if ((time - times[0]) * sign < 0).any() or ((time - times[-1]) * sign > 0).any():
            raise OdeError("a time outside the path")
        last = (times * sign <= time * sign).sum(axis=0) - 1
        t, y = times[last, rows], values[last, rows]
        return np.where((time == t)[:, None], y, self.step(t, y, time - t)[0])


def drive(step: StepTaker, t0: float, t1: float, y0: np.ndarray, order: int, stages: int, rtol: float, atol: float, dense: bool, most: int = 60) -> Solution:
    """Step control by the last two errors; a row's rejected steps in a row are limited."""
    y = np.array(y0, float)
    b, sign, length = len(y), 1.0 if t1 >= t0 else -1.0, abs(t1 - t0)
    t, h, last = np.full(b, float(t0)), np.full(b, sign * 1e-3 * length), np.full(b, 1.0)
    accepted, rejected, run = (np.zeros(b, int) for _ in range(3))
    status, going, path = np.full(b, "ok", object), np.full(b, length > 0), [(t.copy(), y.copy())]
    while going.any():
        at = np.flatnonzero(going)
        rest = np.abs(t1 - t[at])
        final = np.abs(h[at]) >= rest
        size = sign * np.minimum(np.abs(h[at]), rest)
        new, e = step(t[at], y[at], size)
        with np.errstate(all="ignore"):
            err = np.sqrt(np.mean((e / (atol + rtol * np.maximum(np.abs(y[at]), np.abs(new)))) ** 2, axis=1))
        bad = ~np.isfinite(err)
        status[at[bad]], going[at[bad]] = "NotFinite", False
        good = ~bad & (err < 1)
        ok, no = at[good], at[~good & ~bad]
        t[ok], y[ok], run[ok] = np.where(final[good], t1, t[ok] + size[good]), new[good], 0
        accepted[ok] += 1
        rejected[no] += 1
        run[no] += 1
        low = np.maximum(err, 1e-10)
        h[ok] = size[good] * np.clip(0.9 * low[good] ** (-0.7 / order) * last[ok] ** (0.4 / order), 0.2, 5.0)
        last[ok] = low[good]
        h[no] = size[~good & ~bad] * np.maximum(0.1, 0.9 * err[~good & ~bad] ** (-1 / order))
        stuck = no[run[no] > most]
        status[stuck], going[stuck] = "TooManyRejections", False
        going[ok] = t[ok] != t1
        if dense:
            path.append((t.copy(), y.copy()))
    return Solution(y, accepted, rejected, status, step, stages, path if dense else [])


def solve_many(f: Equation, t0: float, t1: float, y0: np.ndarray, method: str = "rkf45", rtol: float = 1e-10, atol: float = 1e-10, dense: bool = False) -> Solution:
    tableau = TABLEAUS[method]
    return drive(explicit(f, tableau), t0, t1, y0, tableau[4], len(tableau[0]), rtol, atol, dense)


def one_by_one(f: Callable[[float, np.ndarray], np.ndarray]) -> Equation:
    """An equation of a single time and state, for batches."""
    return lambda t, y: np.array([f(a, b) for a, b in zip(t, y, strict=True)], float).reshape(y.shape)


def solve_ivp(f: Callable[[float, np.ndarray], np.ndarray], t0: float, t1: float, y0: np.ndarray, method: str = "rkf45", rtol: float = 1e-10, atol: float = 1e-10, dense: bool = False):
    """One problem: (y at t1, accepted, rejected, [(t, y)]); an OdeError if it fails."""
    s = solve_many(one_by_one(f), t0, t1, np.array(y0, float)[None], method, rtol, atol, dense)
    if s.status[0] != "ok":
        raise OdeError(s.status[0])
    return s.y[0], int(s.accepted[0]), int(s.rejected[0]), [(float(t[0]), y[0]) for t, y in s.path]


def rk4_step(f: Equation, t: np.ndarray, y: np.ndarray, h: np.ndarray) -> np.ndarray:
    half, wide = h / 2, h[:, None]
    k1 = f(t, y)
    k2 = f(t + half, y + half[:, None] * k1)
    k3 = f(t + half, y + half[:, None] * k2)
    k4 = f(t + h, y + wide * k3)
    return y + wide / 6 * (k1 + 2 * k2 + 2 * k3 + k4)


def rk4(f: Equation, t0: float, t1: float, y0: np.ndarray, dt: float) -> np.ndarray:
    """Classic Runge-Kutta with fixed steps, the last one cut, forwards or backwards; one step at least."""
    y, t = np.array(y0, float), float(t0)
    size = math.copysign(abs(dt), t1 - t0)
    while True:
        h = size if abs(t1 - t) > abs(size) else t1 - t
        y = rk4_step(f, np.full(len(y), t), y, np.full(len(y), h))
        if abs(t1 - t) <= abs(size):
            return y
        t += h


#: RODAS4 of Hairer and Wanner (diagonal, nodes, stages, couplings, time weights).
GAMMA = 0.25
NODES = (0.0, 0.386, 0.21, 0.63, 1.0, 1.0)
STAGES = (
    (),
    (1.544,),
    (0.9466785280815826, 0.2557011698983284),
    (3.314825187068521, 2.896124015972201, 0.9986419139977817),
    (1.221224509226641, 6.019134481288629, 12.53708332932087, -0.687886036105895),
    (1.221224509226641, 6.019134481288629, 12.53708332932087, -0.687886036105895, 1.0),
)
COUPLINGS = (
    (),
    (-5.6688,),
    (-2.430093356833875, -0.2063599157091915),
    (-0.1073529058151375, -9.594562251023355, -20.47028614809616),
    (7.496443313967647, -10.24680431464352, -33.99990352819905, 11.7089089320616),
    (8.083246795921522, -7.981132988064893, -31.52159432874371, 16.31930543123136, -6.058818238834054),
)
TIME_WEIGHTS = (0.25, -0.1043, 0.1035, -0.0362, 0.0, 0.0)


def forward_jacobian(f: Equation, t: np.ndarray, y: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Stacks (b, n, n). Steps follow each component's size, as small ones of a stiff equation bend the most."""
    size = np.abs(y)
    steps = 1.5e-8 * np.maximum(size, np.maximum(1e-4 * size.max(axis=1, initial=0.0), 1e-8)[:, None])
    out = np.empty((len(y), y.shape[1], y.shape[1]))
    for j in range(y.shape[1]):
        moved = y.copy()
        moved[:, j] += steps[:, j]
        out[:, :, j] = (f(t, moved) - at) / steps[:, j, None]
    return out


def rosenbrock(f: Equation, jacobian: Equation | None, length: float) -> StepTaker:
    """Linearly implicit stages; the last one is the error. Time derivatives of f enter by a forward difference."""

    def step(t: np.ndarray, y: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.asarray(f(t, y), float)
        j = jacobian(t, y) if jacobian else forward_jacobian(f, t, y, at)
        dt = np.sign(h) * 1e-8 * np.maximum(np.abs(t), length)
        slope = (f(t + dt, y) - at) / dt[:, None]
        w = np.eye(y.shape[1]) / (h * GAMMA)[:, None, None] - j
        k: list[np.ndarray] = []
        inner = y
        for node, stage, coupling, weight in zip(NODES, STAGES, COUPLINGS, TIME_WEIGHTS, strict=True):
            inner = y + sum((a * s for a, s in zip(stage, k, strict=True)), np.zeros_like(y))
            pull = sum((c * s for c, s in zip(coupling, k, strict=True)), np.zeros_like(y)) / h[:, None]
            right = f(t + node * h, inner) + pull + weight * h[:, None] * slope
            k.append(np.linalg.solve(w, right[:, :, None])[:, :, 0])
        return inner + k[-1], k[-1]

    return step


def solve_stiff_many(f: Equation, t0: float, t1: float, y0: np.ndarray, jacobian: Equation | None = None, rtol: float = 1e-8, atol: float = 1e-8, dense: bool = False) -> Solution:
    """RODAS4. Without a Jacobian (b, n, n), forward differences."""
    return drive(rosenbrock(f, jacobian, abs(t1 - t0)), t0, t1, y0, 4, 6, rtol, atol, dense)


def solve_stiff(f: Callable[[float, np.ndarray], np.ndarray], t0: float, t1: float, y0: np.ndarray, jacobian: Callable[[float, np.ndarray], np.ndarray] | None = None, rtol: float = 1e-8, atol: float = 1e-8, dense: bool = False):
    """One stiff problem: (y at t1, accepted, rejected, [(t, y)]); an OdeError if it fails."""
    stacked = (lambda t, y: np.array([jacobian(a, b) for a, b in zip(t, y, strict=True)], float)) if jacobian else None
    s = solve_stiff_many(one_by_one(f), t0, t1, np.array(y0, float)[None], stacked, rtol, atol, dense)
    if s.status[0] != "ok":
        raise OdeError(s.status[0])
    return s.y[0], int(s.accepted[0]), int(s.rejected[0]), [(float(t[0]), y[0]) for t, y in s.path]
