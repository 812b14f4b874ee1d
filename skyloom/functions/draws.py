"""Draws that depend on their names only: uniform, triangular and normal numbers by arithmetic, the same on every run."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Multipliers and modulus of the mixing steps, so that SQL can repeat them.
MODULUS = 2147483648


def uniform(draw: Column, stream: int) -> Column:
    """A number in (0, 1) for a draw of a stream: two rounds of multiplicative mixing with a fold between."""
    x = F.pmod((draw + 1) * 2654435761 + F.lit(stream * 40503), F.lit(MODULUS))
    y = F.pmod((x.bitwiseXOR(F.shiftright(x, 15))) * 2246822519, F.lit(MODULUS))
    z = F.pmod((y.bitwiseXOR(F.shiftright(y, 13))) * 1103515245 + 12345, F.lit(MODULUS))
    return (z + 0.5) / MODULUS


def uniform_sql(draw: str, stream: int) -> str:
    x = f"((({draw} + 1) * 2654435761 + {stream * 40503}) % {MODULUS})"
    y = f"((xor({x}, {x} >> 15) * 2246822519) % {MODULUS})"
    return f"(((xor({y}, {y} >> 13) * 1103515245 + 12345) % {MODULUS} + 0.5) / {MODULUS})"


def triangular(u: Column, lo: float, mode: float, hi: float) -> Column:
    cut = (mode - lo) / (hi - lo)
    return F.when(u < cut, lo + F.sqrt(u * ((hi - lo) * (mode - lo)))).otherwise(hi - F.sqrt((1 - u) * ((hi - lo) * (hi - mode))))


def normal(u: Column, v: Column) -> Column:
    """A standard normal number from two uniform ones."""
    return F.sqrt(-2 * F.log(u)) * F.cos(2 * math.pi * v)
