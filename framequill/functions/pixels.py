"""Pixel arithmetic as column expressions. Channels are 0..255 in INT columns: Spark has no unsigned byte."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F


def is_light(r: Column, g: Column, b: Column, above: int = 210, spread: int = 30) -> Column:
    """Light and nearly without colour."""
    return (F.least(r, g, b) > above) & (F.greatest(r, g, b) - F.least(r, g, b) < spread)


def smooth(x: Column, low: float, high: float) -> Column:
    """Smoothstep between two thresholds."""
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (x - F.lit(float(low))) / F.lit(float(high - low))))
    return t * t * (F.lit(3.0) - F.lit(2.0) * t)


def distance_alpha(pixel: Sequence[Column], key: Sequence[int], low: float = 12, high: float = 220) -> Column:
    """Alpha 0..255, cut to an integer, from the largest channel distance to a key colour."""
    far = F.greatest(*[F.abs(p - F.lit(k)) for p, k in zip(pixel, key)])
    return (smooth(far, low, high) * 255).cast("int")


def key_channels(key: Sequence[int]) -> list[int]:
    """Channels of a key colour that dominate: within 16 of the largest and at least 128; none if the largest is darker."""
    top = max(key)
    return [i for i, k in enumerate(key) if top >= 128 and k >= 128 and top - k <= 16]


def _least(columns: Sequence[Column]) -> Column:
    return F.least(*columns) if len(columns) > 1 else columns[0]


def _most(columns: Sequence[Column]) -> Column:
    return F.greatest(*columns) if len(columns) > 1 else columns[0]


def dominance_alpha(pixel: Sequence[Column], key: Sequence[int]) -> Column | None:
    """Alpha 0..255, cut to an integer, from how far the key's channels stand above the others, as a share of what they could; None
    for a key whose channels all dominate, or none."""
    channels = key_channels(key)
    if not 0 < len(channels) < 3:
        return None
    rest = _most([p for i, p in enumerate(pixel) if i not in channels])
    above = F.greatest(F.lit(0), _least([pixel[i] for i in channels]) - rest)
    return ((F.lit(1.0) - F.least(F.lit(1.0), above / F.greatest(F.lit(1), F.lit(max(key)) - rest))) * 255).cast("int")


def keyed(pixel: Sequence[Column], key: Sequence[int], low: float = 12, high: float = 220) -> tuple[Column, list[Column]]:
    """(alpha, channels) of a keyed pixel: the lesser of distance and dominance alpha; where that is below 252, the key's channels
    are held down to the largest other one."""
    alpha, by_share = distance_alpha(pixel, key, low, high), dominance_alpha(pixel, key)
    if by_share is None:
        return alpha, list(pixel)
    alpha, channels = F.least(alpha, by_share), key_channels(key)
    rest = _most([p for i, p in enumerate(pixel) if i not in channels])
    return alpha, [F.when(alpha < 252, F.least(p, rest)).otherwise(p) if i in channels else p for i, p in enumerate(pixel)]


def feather_alpha(x: Column, y: Column, width: int, height: int, left: float, top: float, right: float, bottom: float) -> Column:
    """Alpha 0..255, cut to an integer, that rises from each edge over its own width; an edge of width 0 doesn't fade."""
    edges = [F.when(F.lit(float(n)) > 0, d / F.lit(float(n))).otherwise(F.lit(1.0)) for d, n in (
        (x, left), (F.lit(width - 1) - x, right), (y, top), (F.lit(height - 1) - y, bottom))]
    return (F.greatest(F.lit(0.0), F.least(F.lit(1.0), *edges)) * 255).cast("int")


def over(front: Column, back: Column, alpha: Column) -> Column:
    """One channel of a composite, alpha 0..1, rounded half to even."""
    return F.rint(front * alpha + back * (F.lit(1.0) - alpha)).cast("int")


def layered(background: Column, layers: Column) -> Column:
    """A channel after all layers (z, value, alpha), in order of z."""
    return F.aggregate(F.array_sort(layers), background.cast("double"), lambda under, l: F.rint(l["value"] * l["alpha"] + under * (F.lit(1.0) - l["alpha"])))
