"""Connected components of a distributed edge table: links contracted within tasks, then alternating large and small stars."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from framequill.session import ship, spool, spool_counted

ship(__name__)

#: A side is broadcast with at most so many rows (about 4 MB as a relation), or so many distinct keys of 8 bytes (about
#: 40 MB); beyond, both sides are shuffled.
BROADCAST_ROWS, BROADCAST_KEYS = 100_000, 1_000_000
#: Links that one task contracts at a time, 16 bytes each.
LINKS = 1 << 20


def matching(rows: DataFrame, keys: DataFrame, on: list[str] | str, how: str = "inner", n: int | None = None) -> DataFrame:
    """Join wide rows with a spooled slim table, so that rows without a match don't travel while the keys are few enough."""
    n = keys.count() if n is None else n
    if n <= BROADCAST_ROWS:
        return rows.join(F.broadcast(keys), on, how)
    if how == "inner" and isinstance(on, str):
        narrow, distinct = spool_counted(keys.select(on).distinct(), "keys")
        return (rows.join(F.broadcast(narrow), on, "left_semi") if distinct["n"] <= BROADCAST_KEYS else rows).join(keys, on)
    return rows.join(F.broadcast(keys) if n <= BROADCAST_KEYS and isinstance(on, str) else keys, on, how)


def starred(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(u, v): each node of the links but the least of its component, and that least node."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y, label = at[: len(a)], at[len(a) :], np.arange(len(nodes))
    while len(x):
        low = np.minimum(label[x], label[y])
        np.minimum.at(label, label[x], low)
        np.minimum.at(label, label[y], low)
        while not np.array_equal(label, above := label[label]):
            label = above
        apart = label[x] != label[y]
        x, y = x[apart], y[apart]
    own = label != np.arange(len(nodes))
    return nodes[own], nodes[label[own]]


def contract(batches: Iterator[pa.RecordBatch], most: int = LINKS) -> Iterator[pa.RecordBatch]:
    """The links (a, b) of a partition as stars (u, v), v the least node that u reaches by them.

    A partition with stars of more than ``most`` nodes gives several sets of stars, which connect the same nodes.
    """
    held, size = [], 0

    def stars() -> tuple[np.ndarray, np.ndarray]:
        return starred(*(np.concatenate(c) for c in zip(*held)))

    def batch(u: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

    for links in batches:
        held.append((links.column(0).to_numpy(), links.column(1).to_numpy()))
        size += links.num_rows
        if size >= 2 * most:
            held = [stars()]
            size = len(held[0][0])
            if size >= most:
                yield batch(*held[0])
                held, size = [], 0
    if size:
        yield batch(*stars())


def star_step(stars: DataFrame, parts: int) -> DataFrame:
    """A large-star and a small-star step: every edge is joined with the least neighbour of one of its ends, a partial
    aggregate written before the join, so that a node with a large share of all edges can be split."""
    both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least, n = spool_counted(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least", parts)
    large = matching(both, least, "u", n=n["n"]).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    least, n = spool_counted(large.groupBy("u").agg(F.min("v").alias("m")), "least", parts)
    small = matching(large, least, "u", n=n["n"]).where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return small.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, n: int | None = None, per_task: int = LINKS, rounds: int = 64) -> DataFrame:
    """(u, v) for each node u of the spooled ``edges`` (two columns, n rows) but the least of its component, which is v.

    Links are contracted to stars within tasks of about ``per_task`` links, then star steps join the tasks' stars until nothing
    changes; what has come down to one task's share needs no further step. The number of steps grows with the
    logarithm of the longest path; ``rounds`` of them without an end are an error.
    """
    a, b = edges.columns
    n = edges.count() if n is None else n
    parts = max(1, -(-n // per_task))
    links = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).coalesce(parts)
    stars, seen = spool_counted(links.mapInArrow(contract, "u long, v long"), "stars")
    before = None
    for _ in range(rounds):
        if parts == 1:
            return stars
        now = stars.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == before:
            return stars
        before, parts = now, max(1, -(-seen["n"] // per_task))
        stars, seen = spool_counted(star_step(stars, parts), "stars", parts)
        if seen["n"] <= per_task:
            parts = 1
            stars = spool(stars.coalesce(1).mapInArrow(contract, "u long, v long"), "stars")
    raise RuntimeError(f"components: not settled after {rounds} star steps")
