"""Tone curves as tables of 256 values, built from their rule."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def roll_off(threshold: int = 200, ceiling: int = 255, gamma: float = 1.0) -> list[int]:
    """Identity up to the threshold, then a power curve to the ceiling, truncated."""
    span = max(255 - threshold, 1)
    return [v if v <= threshold else int(threshold + (ceiling - threshold) * ((v - threshold) / span) ** gamma) for v in range(256)]


def tone(lift: float = 0.0, reach: int = 110, **rolled) -> list[int]:
    """The rolled-off curve with shadows lifted by a weight that falls to 0 at ``reach``."""
    return [min(255, int(y + lift * max(reach - v, 0) / max(reach, 1))) for v, y in enumerate(roll_off(**rolled))]


def gamma(g: float) -> list[int]:
    return [round(255 * (v / 255) ** g) for v in range(256)]


def applied(value: Column, table: list[int]) -> Column:
    """Look-up of a 0..255 column; the table is a constant of the plan."""
    return F.element_at(F.array(*[F.lit(v) for v in table]), value + 1)
