"""Angles, rounding conventions and circular arithmetic as column expressions.

Angles are clockwise from up. Three rounding rules coexist and are never mixed: ``half_up`` (floor of x + 0.5),
``half_even`` and truncation.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

TURN = 2 * math.pi


def half_up(x: Column) -> Column:
    return F.floor(x + F.lit(0.5)).cast("long")


def half_even(x: Column) -> Column:
    return F.rint(x)


def wrap(x: Column, turn: float) -> Column:
    return x - F.floor(x / F.lit(turn)) * F.lit(turn)


def clamp(x: Column, low: Column, high: Column) -> Column:
    return F.least(F.greatest(x, low), high)


def pointer_angle(dx: Column, dy: Column, vertical: float = 1.15) -> Column:
    """Radians in [0, 2 pi) from an offset, 0 = up, clockwise."""
    return wrap(F.atan2(dx, -dy * F.lit(vertical)), TURN)


def angular_distance(a: Column, b: Column) -> Column:
    """Signed shortest way from b to a in radians."""
    return F.atan2(F.sin(a - b), F.cos(a - b))


def shortest_delta(delta: Column, count: int) -> Column:
    """A difference on a ring of ``count`` steps, moved into (-count/2, count/2]."""
    inside = wrap(delta, count)
    return F.when(inside > F.lit(count / 2), inside - F.lit(count)).otherwise(inside)


def neutral(dx: Column, dy: Column, scale: Column, rx: float = 20, ry: float = 10, top: float = -6) -> Column:
    """Whether an offset lies in the resting ellipse, cut off above ``top``; strict inside."""
    x, y = dx / (F.lit(float(rx)) * scale), dy / (F.lit(float(ry)) * scale)
    return (dy >= F.lit(float(top))) & (x * x + y * y < 1)
