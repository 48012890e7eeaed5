"""The budget ledger as a stream: the state of a budget lives in the state store, and a batch that comes twice changes nothing.

State of a budget are what it has used and the number of its last request (a value), and the fingerprints that it has
admitted (a map with ``most`` entries at most), kept without expiry. Requests of a budget are numbered in their order; one whose number is
not above the last is a replay and gives no row, so the decisions are those of ``ledger.admitted`` however the stream is cut
into batches.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from framequill.operators.ledger import refusal
from framequill.session import ship

ship(__name__)

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUTPUT = "key long, id long, seconds double, accepted boolean, reason string, used double"


class Admission(StatefulProcessor):
    def __init__(self, most: int, total: float, per_request: float):
        self.limits = (most, total, per_request)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.sums = handle.getValueState("sums", "count int, used double, last long")
        self.known = handle.getMapState("known", "fingerprint string", "id long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        count, used, last = self.sums.get() if self.sums.exists() else (0, 0.0, None)
        out = []
        for r in pd.concat(list(rows)).sort_values("id").itertuples():
            if last is not None and r.id <= last:
                continue
            seconds, last = (None if pd.isna(r.seconds) else float(r.seconds)), int(r.id)
            reason = refusal(seconds, bool(r.allowed), lambda r=r: self.known.containsKey((r.fingerprint,)), count, used, *self.limits)
            if not reason:
                count, used = count + 1, used + seconds
                self.known.updateValue((r.fingerprint,), (last,))
            out.append((key[0], last, seconds, not reason, reason, used))
        self.sums.update((count, used, last))
        yield pd.DataFrame(out, columns=["key", "id", "seconds", "accepted", "reason", "used"])

    def close(self) -> None:
        pass


def admitted_stream(requests: DataFrame, most: int, total: float, per_request: float) -> DataFrame:
    """Decisions (OUTPUT) on a stream of requests (key, id, seconds, fingerprint, allowed), in update mode; needs the RocksDB state store."""
    slim = requests.select(F.col("key").cast("long").alias("key"), F.col("id").cast("long").alias("id"), F.col("seconds").cast("double").alias("seconds"),
                           F.coalesce(F.col("fingerprint").cast("string"), F.lit("")).alias("fingerprint"), F.coalesce("allowed", F.lit(False)).alias("allowed"))
    return slim.groupBy("key").transformWithStateInPandas(statefulProcessor=Admission(most, total, per_request), outputStructType=OUTPUT, outputMode="Update", timeMode="None")
