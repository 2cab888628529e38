"""What users plug into the operators: the shapes of their functions."""

from __future__ import annotations

from typing import Protocol

import numpy as np


class Kernel(Protocol):
    """Of per_matrix(): a stack (b, m, n) gives stacks by name and a mask of the matrices that worked."""

    def __call__(self, stack: np.ndarray, /) -> tuple[dict[str, np.ndarray], np.ndarray]: ...


class Step(Protocol):
    """Of scan(): a state and a sample give the next state and an output."""

    def __call__(self, state: list, x: float, /) -> tuple[list, float]: ...


class Equation(Protocol):
    """Of solve_many(): times (b,) and states (b, n) give derivatives (b, n)."""

    def __call__(self, t: np.ndarray, y: np.ndarray, /) -> np.ndarray: ...


class Motion(Protocol):
    """Of a filter's model: a state gives the next one, or what is measured of it."""

    def __call__(self, x: np.ndarray, /) -> np.ndarray: ...
