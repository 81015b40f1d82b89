"""Complex arithmetic on pairs of double columns; everything stays in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Pair = tuple[Column, Column]
TWO_PI = 6.283185307179586


def pair(name: str) -> Pair:
    """The columns ``name``_re and ``name``_im."""
    return F.col(f"{name}_re"), F.col(f"{name}_im")


def mul(a: Pair, b: Pair) -> Pair:
    return a[0] * b[0] - a[1] * b[1], a[0] * b[1] + a[1] * b[0]


def conj(a: Pair) -> Pair:
    return a[0], -a[1]


def add(a: Pair, b: Pair) -> Pair:
    return a[0] + b[0], a[1] + b[1]


def sub(a: Pair, b: Pair) -> Pair:
    return a[0] - b[0], a[1] - b[1]


def scale(a: Pair, s: Column | float) -> Pair:
    return a[0] * s, a[1] * s


def abs2(a: Pair) -> Column:
    return a[0] * a[0] + a[1] * a[1]


def div(a: Pair, b: Pair) -> Pair:
    """a / b, and 0 where b is 0."""
    n = abs2(b)
    re, im = mul(a, conj(b))
    return F.when(n > 0, re / n).otherwise(F.lit(0.0)), F.when(n > 0, im / n).otherwise(F.lit(0.0))


def magnitude(a: Pair) -> Column:
    return F.sqrt(abs2(a))


def phasor(turns: Column) -> Pair:
    """exp(-2 pi i turns)."""
    return F.cos(turns * TWO_PI), -F.sin(turns * TWO_PI)


def named(a: Pair, name: str) -> list[Column]:
    return [a[0].alias(f"{name}_re"), a[1].alias(f"{name}_im")]
