"""Session defaults, table loading and the shared scratch area."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def session(master: str | None = None, **conf: str) -> SparkSession:
    """A session with the library's defaults; ``conf`` keys use ``__`` for dots."""
    builder = SparkSession.builder.appName("framequill")
    if master:
        builder = builder.master(master)
    for key, value in (DEFAULTS | {k.replace("__", "."): v for k, v in conf.items()}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_SCRATCH: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder name that driver and executors share: under ``spark.checkpoint.dir`` or the context's checkpoint folder.

    A cluster that names neither gets a folder in the warehouse, local mode (tests) a temporary one.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local":
            base = tempfile.mkdtemp(prefix="framequill-")
        else:
            base = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_framequill_scratch"
        spark.sparkContext.setCheckpointDir(base)
    _SCRATCH.append(f"{base.rstrip('/')}/framequill-{uuid.uuid4().hex}")
    return _SCRATCH[-1]


def scratch_mark() -> int:
    """What ``sweep`` takes as ``since`` to spare all scratch folders that exist now."""
    return len(_SCRATCH)


def sweep(spark: SparkSession, since: int = 0, keep: int = 0) -> int:
    """Delete the scratch folders of this process, those after the mark ``since`` but for the last ``keep``; call it when the results that read
    them have been written."""
    gone = _SCRATCH[since : len(_SCRATCH) - keep]
    del _SCRATCH[since : len(_SCRATCH) - keep]
    n = 0
    for folder in gone:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        n += bool(path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True))
    return n


def spool(df: DataFrame, name: str = "table", parts: int | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage is cut, lost executors cost nothing.

    ``parts`` bounds the tasks and files of a table that is known to be small.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}"
    (df.coalesce(parts) if parts else df).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spool_counted(df: DataFrame, name: str = "table", parts: int | None = None, **counts: Column) -> tuple[DataFrame, dict[str, int]]:
    """``spool`` and, from the same job, the rows written (``n``) and how many rows each of ``counts`` holds for.

    Tasks that ran twice may count twice: the figures say whether there are rows, and bound how many.
    """
    seen = Observation()
    whole = {"n": F.lit(True)} | counts
    table = spool(df.observe(seen, *[F.count_if(c).alias(k) for k, c in whole.items()]), name, parts)
    found = seen.get
    return table, {k: found.get(k) or 0 for k in whole}


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Inside, the shuffle files of a query go when it ends; else they stay until the driver happens to collect its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def ship(module: str) -> None:
    """Send a module's functions to executors by value, so that they need no copy of the package."""
    import sys

    from pyspark import cloudpickle

    cloudpickle.register_pickle_by_value(sys.modules[module])


def small_batches(spark: SparkSession, most: int = 8 << 20) -> None:
    """Bound what one Arrow batch to a Python worker may hold, whatever the length of texts."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(key).rstrip("b")) > most:
        spark.conf.set(key, str(most))


class Shared:
    """A broadcast object whose classes executors need not be able to import.

    Broadcasts are pickled by reference; here the object goes by value, and its arrays beside it, without a second copy
    on the workers.
    """

    def __init__(self, spark: SparkSession, value: object):
        import numpy as np
        from pyspark import cloudpickle

        buffers: list = []
        head = cloudpickle.dumps(value, protocol=5, buffer_callback=buffers.append)
        self.held = spark.sparkContext.broadcast((head, [np.frombuffer(b.raw(), np.uint8) for b in buffers]))
        self.loaded = None

    def __getstate__(self) -> dict:
        return {"held": self.held, "loaded": None}

    @property
    def value(self):
        if self.loaded is None:
            import pickle

            head, buffers = self.held.value
            self.loaded = pickle.loads(head, buffers=buffers)
        return self.loaded

    def unpersist(self) -> None:
        self.held.unpersist()


def tidy() -> None:
    """Give memory that a kernel's arrays have left back to the system; Python workers outlive their tasks."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


ship(__name__)
