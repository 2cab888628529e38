"""Filter design and controller tuning in closed form: coefficients of biquads, gains by row."""

from __future__ import annotations

import cmath
import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Normalised (b0, b1, b2, a1, a2).
Section = tuple[float, float, float, float, float]


def within(freq: float, rate: float) -> None:
    if not (0 < freq < rate / 2 and math.isfinite(rate)):
        raise ValueError("a frequency must be positive and under half the rate")


def sections(poles: list[complex], rate: float, high: bool) -> list[Section]:
    """Biquads of analog poles (one of each conjugate pair), each with gain 1 at DC, or at Nyquist for high-pass."""
    c, out = 2 * rate, []
    for p in poles:
        if abs(p.imag) < 1e-9 * abs(p):
            w = -p.real
            d = c + w
            out.append((c / d, -c / d, 0.0, (w - c) / d, 0.0) if high else (w / d, w / d, 0.0, (w - c) / d, 0.0))
        else:
            w2, a = abs(p) ** 2, -2 * p.real
            d = c * c + a * c + w2
            g = (c * c if high else w2) / d
            out.append((g, -2 * g if high else 2 * g, g, (2 * w2 - 2 * c * c) / d, (c * c - a * c + w2) / d))
    return out


def prototype(order: int, cutoff: float, rate: float, high: bool, stretch: float | None) -> list[Section]:
    """Poles on the unit circle, or with `stretch` on the ellipse of a Chebyshev filter, moved to the warped cutoff."""
    within(cutoff, rate)
    if order < 1:
        raise ValueError("order must be positive")
    w = 2 * rate * math.tan(math.pi * cutoff / rate)
    poles = []
    for k in range((order + 1) // 2):
        unit = cmath.exp(1j * math.pi * (2 * k + order + 1) / (2 * order))
        if stretch is not None:
            unit = complex(math.sinh(stretch) * unit.real, math.cosh(stretch) * unit.imag)
        poles.append(w / unit.conjugate() if high else w * unit)
    return sections(poles, rate, high)


def butterworth_highpass(order: int, cutoff: float, rate: float) -> list[Section]:
    return prototype(order, cutoff, rate, True, None)


def chebyshev1(order: int, ripple_db: float, cutoff: float, rate: float, high: bool = False) -> list[Section]:
    """Equal ripple in the passband; an even order starts at the bottom of the ripple."""
    if not (ripple_db > 0 and math.isfinite(ripple_db)):
        raise ValueError("the ripple must be positive")
    eps = math.sqrt(10 ** (ripple_db / 10) - 1)
    out = prototype(order, cutoff, rate, high, math.asinh(1 / eps) / order)
    if order % 2 == 0:
        g = 1 / math.sqrt(1 + eps * eps)
        b0, b1, b2, a1, a2 = out[0]
        out[0] = (g * b0, g * b1, g * b2, a1, a2)
    return out


def zero_pole(k: float, zero: float, pole: float, rate: float) -> Section:
    """k (s + zero) / (s + pole) by the bilinear transform."""
    c = 2 * rate
    return (k * (c + zero) / (c + pole), k * (zero - c) / (c + pole), 0.0, (pole - c) / (c + pole), 0.0)


def lead(phase: float, center: float, gain: float, rate: float) -> Section:
    """Largest phase lead `phase` (radians, under a quarter turn) at `center`; DC gain `gain`."""
    within(center, rate)
    if not 0 < phase < math.pi / 2:
        raise ValueError("the phase lead must lie between 0 and a quarter turn")
    alpha = (1 - math.sin(phase)) / (1 + math.sin(phase))
    w = 2 * math.pi * center
    return zero_pole(gain / alpha, w * math.sqrt(alpha), w / math.sqrt(alpha), rate)


def lag(boost: float, corner: float, rate: float) -> Section:
    """DC gain `boost` (above 1), gain 1 for high frequencies."""
    within(corner, rate)
    if not boost > 1:
        raise ValueError("the boost must exceed 1")
    w = 2 * math.pi * corner
    return zero_pole(1.0, w, w / boost, rate)


def gains(kp: Column, ti: Column, td: Column) -> list[Column]:
    return [kp, kp / ti, kp * td]


def cohen_coon(k: Column, tau: Column, delay: Column) -> list[Column]:
    """kp, ki, kd of a first-order plant with delay; null without a delay."""
    r = F.when(delay > 0, delay) / tau
    return gains((4 / F.lit(3.0) + r / 4) / (k * r), delay * (32 + 6 * r) / (13 + 8 * r), 4 * delay / (11 + 2 * r))


def simc(k: Column, tau: Column, delay: Column, tau_c: Column) -> list[Column]:
    """kp, ki, kd for the closed-loop time constant tau_c, with half the delay as derivative time; null unless tau_c > 0."""
    lag_ = F.when(tau_c > 0, tau_c) + delay
    return gains(tau / (k * lag_), F.least(tau, 4 * lag_), delay / 2)


def ultimate(ku: Column, tu: Column) -> list[Column]:
    """kp, ki, kd from the gain and period of sustained oscillation; null unless both are positive."""
    return gains(0.6 * F.when((ku > 0) & (tu > 0), ku), tu / 2, tu / 8)
