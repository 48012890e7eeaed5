"""Pointer events of every (session, subject) to the step its head shows, as a stream whose timers move the spring between events.

The gate of ``pointer`` decides what an event does; a move sets the target of a spring on ``steps`` steps, of a full ring or of an
open arc with its two ends. Frames come at a fixed rate from the moment a resting spring gets a target, so where it is at any time
does not depend on how the stream is cut into batches. Rows are given for events, and, while the spring moves, for timers
in event time: a timer fires when the watermark passes it.

State of a key is one row, kept without expiry; times that go back move nothing.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import astuple, dataclass, replace

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from framequill.session import ship
from framequill.streaming.pointer import ARRIVED, FIRST_STEP, REST, Gate, arc_degrees, follow, point

ship(__name__)

STATE = "resting boolean, last double, position double, speed double, target double, start double, frames long, moving boolean"
OUTPUT = "session string, subject string, id long, seconds double, action string, resting boolean, position double"


@dataclass(frozen=True)
class Head:
    resting: bool = REST[0]
    last: float | None = REST[1]
    position: float | None = None
    speed: float = 0.0
    target: float = 0.0
    start: float = 0.0
    frames: int = 0
    moving: bool = False


def step_of(angle: float, gate: Gate, steps: int) -> float:
    """The step of an angle; the ends of an arc are the first and the last."""
    if gate.arc is None:
        return angle / (2 * math.pi) * steps
    return (arc_degrees(angle, gate.arc) - gate.arc[0]) / (gate.arc[1] - gate.arc[0]) * (steps - 1)


def advanced(head: Head, until: float, gate: Gate, steps: int, smooth: float) -> Head:
    """The head after all frames up to a time; a spring that has arrived stops."""
    ring = gate.arc is None
    while head.moving and head.start + (head.frames + 1) * FIRST_STEP <= until + 1e-9:
        position, speed = follow((head.position, head.speed), head.target, FIRST_STEP, steps, smooth, ring)
        way = (head.target - position) % steps if ring else head.target - position
        way = min(way, steps - way) if ring else abs(way)
        head = replace(head, position=position, speed=speed, frames=head.frames + 1, moving=way > ARRIVED or abs(speed) > ARRIVED)
    return head


def moved(head: Head, at: float, dx: float, dy: float, left: bool, gate: Gate, steps: int, smooth: float) -> tuple[Head, str]:
    """The head after an event, and what the event did."""
    head = advanced(head, at, gate, steps, smooth)
    (resting, last), action = point((head.resting, head.last), dx, dy, gate, left)
    head = replace(head, resting=resting, last=last)
    if action == "rest":
        return replace(head, position=None, speed=0.0, moving=False), action
    if action == "snap":
        step = step_of(last, gate, steps)
        return replace(head, position=step, target=step, speed=0.0, moving=False), action
    if action == "move":
        head = replace(head, target=step_of(last, gate, steps))
        return head if head.moving else replace(head, start=at, frames=0, moving=True), action
    return head, action


class Follower(StatefulProcessor):
    def __init__(self, gate: Gate, steps: int, smooth: float, every: float):
        self.rules, self.every = (gate, steps, smooth), every

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.state = handle, handle.getValueState("head", STATE)

    def held(self) -> Head:
        if not self.state.exists():
            return Head()
        values = [None if v is None or isinstance(v, float) and math.isnan(v) else v for v in self.state.get()]
        return Head(*values)

    def keep(self, head: Head) -> None:
        self.state.update(astuple(head))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        head, out = self.held(), []
        for r in pd.concat(list(rows)).sort_values(["seconds", "id"]).itertuples():
            was = head.moving
            head, action = moved(head, r.seconds, r.dx, r.dy, bool(r.left), *self.rules)
            out.append((*key, r.id, r.seconds, action, head.resting, head.position))
            if head.moving and not was:
                self.handle.registerTimer(math.ceil((r.seconds + self.every) * 1000))
        self.keep(head)
        yield pd.DataFrame(out, columns=[c.split()[0] for c in OUTPUT.split(", ")])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at = expiredTimerInfo.getExpiryTimeInMs() / 1000
        head = self.held()
        if head.moving and head.start <= at:
            head = advanced(head, at, *self.rules)
            self.keep(head)
            if head.moving:
                self.handle.registerTimer(math.ceil((at + self.every) * 1000))
            yield pd.DataFrame([(*key, -1, at, "tick", head.resting, head.position)], columns=[c.split()[0] for c in OUTPUT.split(", ")])

    def close(self) -> None:
        pass


def followed(events: DataFrame, gate: Gate = Gate(), steps: int = 3600, smooth: float = 0.14, every: float = 0.1, late: str = "1 second") -> DataFrame:
    """OUTPUT rows of a stream of events (session, subject, ts timestamp, id, dx, dy, pointer_type, left), in update mode; touch
    does nothing. Rows of timers have id -1. Needs the RocksDB state store."""
    mice = events.where("pointer_type is null or pointer_type <> 'touch'").withWatermark("ts", late).withColumn("seconds", F.unix_micros("ts") / 1e6)
    mice = mice.select("session", "subject", "ts", "seconds", F.col("id").cast("long").alias("id"), F.col("dx").cast("double").alias("dx"), F.col("dy").cast("double").alias("dy"), F.coalesce("left", F.lit(False)).alias("left"))
    return mice.groupBy("session", "subject").transformWithStateInPandas(statefulProcessor=Follower(gate, steps, smooth, every), outputStructType=OUTPUT, outputMode="Update", timeMode="EventTime")
