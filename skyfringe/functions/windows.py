"""Tapers, interpolation kernels and noise as column expressions."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# Coefficients of the rational approximation of the prolate spheroidal function (support 6, order 1),
# numerators and denominators for the lower part (up to 0.75) and the upper one.
SPHEROIDAL_P = ((8.203343e-2, -3.644705e-1, 6.278660e-1, -5.335581e-1, 2.312756e-1), (4.028559e-3, -3.697768e-2, 1.021332e-1, -1.201436e-1, 6.412774e-2))
SPHEROIDAL_Q = ((1.0, 8.212018e-1, 2.078043e-1), (1.0, 9.599102e-1, 2.918724e-1))
BOLTZMANN = 1.38064852e-23


def spheroidal(nu: Column) -> Column:
    """The prolate spheroidal function without its (1 - nu ** 2) factor; 0 beyond 1."""

    def part(k: int, end: float) -> Column:
        d = nu * nu - end * end
        return sum(c * F.pow(d, F.lit(float(i))) for i, c in enumerate(SPHEROIDAL_P[k])) / sum(c * F.pow(d, F.lit(float(i))) for i, c in enumerate(SPHEROIDAL_Q[k]))

    return F.when(F.abs(nu) < 0.75, part(0, 0.75)).when(F.abs(nu) <= 1.0, part(1, 1.0)).otherwise(F.lit(0.0))


def spheroidal_values(nu: np.ndarray) -> np.ndarray:
    """``spheroidal`` of numbers, for kernels that are made in a task."""
    part = lambda k, end: np.polynomial.polynomial.polyval(nu * nu - end * end, SPHEROIDAL_P[k]) / np.polynomial.polynomial.polyval(nu * nu - end * end, SPHEROIDAL_Q[k])
    return np.where(np.abs(nu) < 0.75, part(0, 0.75), np.where(np.abs(nu) <= 1.0, part(1, 1.0), 0.0))


def gaussian_taper(u: Column, v: Column, beam: float) -> Column:
    return F.exp(-(math.pi**2) * beam**2 / (4 * math.log(2)) * (u * u + v * v))


def tukey(x: Column, r: float) -> Column:
    """Tapered cosine on [0, 1]."""
    rising = 0.5 * (1 + F.cos(2 * math.pi / r * (x - r / 2)))
    falling = 0.5 * (1 + F.cos(2 * math.pi / r * (x - 1 + r / 2)))
    return F.when((x < 0) | (x > 1), F.lit(0.0)).when(x < r / 2, rising).when(x >= 1 - r / 2, falling).otherwise(F.lit(1.0))


def sinc_kernel(x: Column) -> Column:
    return F.when(x == 0, F.lit(1.0)).otherwise(F.sin(math.pi * x) / (math.pi * x))


def lanczos_kernel(x: Column, a: int) -> Column:
    return F.when(F.abs(x) < a, sinc_kernel(x) * sinc_kernel(x / a)).otherwise(F.lit(0.0))


def thermal_noise(bandwidth: Column, integration: Column, diameter: Column, t_sys: float = 200.0, eta: float = 0.78) -> Column:
    """Expected standard deviation of a visibility in jansky (radiometer equation)."""
    area = math.pi * diameter * diameter / 4
    return 1e26 * math.sqrt(2.0) * BOLTZMANN * t_sys / (area * eta * F.sqrt(bandwidth * integration))
