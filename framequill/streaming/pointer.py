"""Stateful pointer processing: the same step over a sorted batch and over a stream.

An event moves a (session) state: resting in the neutral ellipse until it leaves the wider one, the first angle
outside snaps, later ones move the target only if they differ from the last accepted angle by the hysteresis. A pointer that leaves the page puts
the state back to rest. A second fold lets a position follow its target on a critically damped spring.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from framequill.session import ship

ship(__name__)


@dataclass(frozen=True)
class Gate:
    """Fixed values by default: radii, upper cut, leaving scale and vertical scale of the resting zone."""

    rx: float = 20.0
    ry: float = 10.0
    top: float = -6.0
    leave: float = 1.35
    vertical: float = 1.15
    hysteresis: float = 0.0
    #: First and last degrees of an open arc, beyond which the pointer rests; None for a full ring.
    arc: tuple[float, float] | None = None


#: (resting, last accepted angle)
REST: tuple[bool, float | None] = (True, None)


def arc_degrees(angle: float, arc: tuple[float, float]) -> float | None:
    """Degrees of an angle on an arc, None outside; ends count with a slack of 1e-7."""
    at = math.degrees(angle) % 360
    at = at + 360 if at < arc[0] - 1e-7 else at
    return None if at > arc[1] + 1e-7 else min(max(at, arc[0]), arc[1])


def point(state: tuple[bool, float | None], dx: float, dy: float, gate: Gate, left: bool = False) -> tuple[tuple[bool, float | None], str]:
    """(state after an event, what it does): rest, snap, move or hold; ``left`` says that the pointer left, which is a rest wherever it was."""
    if left:
        return REST, "rest"
    resting, last = state
    scale = gate.leave if resting else 1.0
    x, y = dx / (gate.rx * scale), dy / (gate.ry * scale)
    if dy >= gate.top and x * x + y * y < 1:
        return REST, "rest"
    turn = 2 * math.pi
    angle = math.atan2(dx, -dy * gate.vertical)
    angle -= math.floor(angle / turn) * turn
    degrees = arc_degrees(angle, gate.arc) if gate.arc else None
    if gate.arc and degrees is None:
        return REST, "rest"
    if resting:
        return (False, angle), "snap"
    way = math.atan2(math.sin(angle - last), math.cos(angle - last)) if last is not None else math.inf
    if gate.arc and last is not None:
        way = math.radians(degrees - arc_degrees(last, gate.arc))
    if abs(way) < gate.hysteresis:
        return (False, last), "hold"
    return (False, angle), "move"


#: What stands for exp(wt) in 1 + wt + SQUARE (wt)^2 + CUBE (wt)^3, the first and the longest step in seconds, and the way from its goal, and
#: the speed, below which a position has arrived.
SQUARE, CUBE = 0.48, 0.235
FIRST_STEP, LONGEST_STEP, ARRIVED = 1 / 60, 1 / 30, 0.002


def spring(way: float, speed: float, t: float, smooth: float, most_speed: float) -> tuple[float, float]:
    """(way still to go, speed) of a critically damped spring after t seconds; ``way`` is counted from the goal.

    The motion is x(t) = (x + (v + w x) t) e^(-wt) with w = 2 / smooth. Of a long way only what is covered at ``most_speed`` pulls, the rest
    comes along unchanged. A spring that reaches its goal within the step stays there.
    """
    smooth = max(smooth, 1e-4)
    w, reach = 2 / smooth, most_speed * smooth
    e = 1 / sum(c * (w * t) ** k for k, c in enumerate((1, 1, SQUARE, CUBE)))
    x = max(-reach, min(reach, way))
    impulse = (speed + w * x) * t
    rest = way - x + (x + impulse) * e
    if (rest <= 0) if way >= 0 else (rest > 0):
        return 0.0, 0.0
    return rest, (speed - w * impulse) * e


def follow(state: tuple[float, float] | None, target: float, seconds: float | None, count: int, smooth: float, ring: bool = True) -> tuple[float, float]:
    """(position, speed) on a ring of ``count`` steps after an event; the way is the shorter one. An open arc has ends that nothing passes."""
    position, speed = state or (0.0, 0.0)
    ahead = (target - position) % count
    goal = position + (ahead if ahead <= count / 2 else ahead - count) if ring else min(max(target, 0.0), count - 1.0)
    rest, speed = spring(position - goal, speed, FIRST_STEP if seconds is None else max(0.0, min(seconds, LONGEST_STEP)), smooth, 2.0 * count)
    if abs(rest) <= ARRIVED and abs(speed) <= ARRIVED:
        rest, speed = 0.0, 0.0
    return ((goal + rest) % count if ring else goal + rest), speed


def folded(df: DataFrame, key: str, order: Sequence[str], columns: Sequence[str], schema: str, begin: Callable, step: Callable) -> DataFrame:
    """Fold rows of each key in order: ``step(state, *columns) -> (state, output tuple)``; one state in memory at a time."""
    slim = df.select(F.col(key).alias("key"), *[F.col(c) for c in dict.fromkeys([*order, *columns])])
    names = [part.split()[0] for part in schema.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for batch in batches:
            out = []
            for k, *values in zip(*(batch.column(i).to_pylist() for i in range(batch.num_columns))):
                if k != now:
                    now, state = k, begin()
                state, row = step(state, *values)
                out.append((k, *row))
            yield pa.RecordBatch.from_pylist([dict(zip(["key", *names], row)) for row in out], schema=target)

    kind = slim.schema["key"].dataType.simpleString()
    from pyspark.sql.pandas.types import to_arrow_schema

    full = f"key {kind}, {schema}"
    target = to_arrow_schema(df.sparkSession.createDataFrame([], full).schema)
    dealt = slim.repartition("key").sortWithinPartitions("key", *order).select("key", *columns)
    return dealt.mapInArrow(run, full)


def pointer_batch(events: DataFrame, key: str, order: Sequence[str], gate: Gate = Gate(), carry: str = "event_id") -> DataFrame:
    """(key, id, action, resting, angle) for events with dx, dy and perhaps ``left``; touch events are filtered by the caller."""

    def step(state, i, dx, dy, left=False):
        state, action = point(state, dx, dy, gate, bool(left))
        return state, (i, action, state[0], state[1])

    columns = [carry, "dx", "dy", *(["left"] if "left" in events.columns else [])]
    return folded(events, key, order, columns, "id long, action string, resting boolean, angle double", lambda: REST, step)


def pointer_stream(events: DataFrame, key: str, gate: Gate = Gate()) -> DataFrame:
    """The same over a stream with columns key, ts, id, dx, dy, pointer_type and perhaps left: (key, id, action, resting, angle) in update mode.

    The state of a key is two values, kept without expiry.
    """
    def advance(keys: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        resting, last = state.get if state.exists else (True, float("nan"))
        now = (resting, None if last is None or math.isnan(last) else last)
        rows = []
        for frame in frames:
            for r in frame.sort_values(["ts", "id"]).itertuples():
                now, action = point(now, r.dx, r.dy, gate, bool(getattr(r, "left", False)))
                rows.append((keys[0], r.id, action, now[0], now[1]))
        state.update((now[0], float("nan") if now[1] is None else now[1]))
        yield pd.DataFrame(rows, columns=["key", "id", "action", "resting", "angle"])

    kind = events.schema[key].dataType.simpleString()
    mice = events.where("pointer_type <> 'touch'")
    return mice.groupBy(key).applyInPandasWithState(
        advance, f"key {kind}, id long, action string, resting boolean, angle double", "resting boolean, last double", "update", GroupStateTimeout.NoTimeout)


def smooth_batch(events: DataFrame, key: str, order: Sequence[str], count: int, smooth: float = 0.14, carry: str = "event_id") -> DataFrame:
    """(key, id, position, velocity) following the target column, with ``seconds`` since the event before."""

    def step(state, i, target, seconds):
        state = follow(state, target, seconds, count, smooth)
        return state, (i, *state)

    return folded(events, key, order, [carry, "target", "seconds"], "id long, position double, velocity double", lambda: None, step)


def smooth_stream(events: DataFrame, key: str, count: int, smooth: float = 0.14) -> DataFrame:
    """The same over a stream with columns key, ts (seconds), id, target: (key, id, position, velocity) in update mode.

    The state of a key is its position, speed and last time, kept without expiry; times that go back take no time.
    """
    def advance(keys: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, last = (state.get[:2], state.get[2]) if state.exists else (None, None)
        rows = []
        for frame in frames:
            for r in frame.sort_values(["ts", "id"]).itertuples():
                held, last = follow(held, r.target, None if last is None else r.ts - last, count, smooth), r.ts
                rows.append((keys[0], r.id, *held))
        state.update((*held, last))
        yield pd.DataFrame(rows, columns=["key", "id", "position", "velocity"])

    kind = events.schema[key].dataType.simpleString()
    return events.groupBy(key).applyInPandasWithState(
        advance, f"key {kind}, id long, position double, velocity double", "position double, velocity double, last double", "update", GroupStateTimeout.NoTimeout)
