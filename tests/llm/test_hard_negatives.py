import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from framequill.llm import hard_negatives as hn
from framequill.llm.registry import QUERIES, SQL
from tests.oracle import connect, same

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, k=5, percent=80, every=10):
    held = []
    for i, v, label in rows:
        if label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        held.append((i, [math.floor(256 * float(np.float32(x))) for x in v], label))
    width = max((len(v) for _, v, _ in held), default=0)
    held = [(i, v + [0] * (width - len(v)), label) for i, v, label in held]
    out = []
    for a, (i, v, label) in enumerate(held):
        if i is None or i % every:
            continue
        scores = sorted((-sum(x * y for x, y in zip(v, w)), j is None, j or 0, m == label) for b, (j, w, m) in enumerate(held) if b != a)
        for p, none, j, _ in [s for s in scores if s[3]][:k]:
            fits = [s for s in scores if not s[3] and percent * -p <= 100 * -s[0] <= 100 * -p][:k]
            out += [(i, None if none else j, rank, None if s[1] else s[2], -p, -s[0]) for rank, s in enumerate(fits, 1)]
    return sorted(map(repr, out))


def found(df, every=10, **options):
    return sorted(repr(tuple(r)) for r in hn.hard_negatives(df, F.col("id") % every == 0, F.col("label"), **options).collect())


def vectors(rng, n, dim=6, labels=3, copies=0):
    centres = rng.normal(0, 0.4, (5, dim))
    rows = [(i, [float(x) for x in centres[rng.integers(5)] + rng.normal(0, 0.2, dim)], int(rng.integers(labels))) for i in range(n)]
    return rows + [(n + i, rows[0][1], int(rng.integers(labels))) for i in range(copies)]


@pytest.mark.parametrize("block,sample", [(4096, 4096), (16, 4096), (16, 12), (7, 2)])
def test_same_as_brute_force_with_many_copies(spark, block, sample):
    rows = vectors(np.random.default_rng(block), 150, copies=60)
    assert found(spark.createDataFrame(rows, SCHEMA).repartition(3), block=block, sample=sample) == brute(rows)


def test_odd_rows(spark):
    rows = vectors(np.random.default_rng(1), 40)
    nan, inf = float("nan"), float("inf")
    rows += [(50, None, 1), (60, [nan] * 6, 1), (70, [inf, 0.0, 0.0, 0.0, 0.0, 0.0], 1), (80, rows[1][1], None), (90, [None] * 6, 1), (None, rows[2][1], 1), (None, rows[3][1], 2)]
    rows += [(20, rows[5][1], 0), (20, rows[5][1], 0), (100, [0.0] * 6, 0), (110, [0.5, 0.25], 1), (120, [], 2), (-10, [-x for x in rows[4][1]], 1), (130, [900.0, -900.0, 5.0, 0.0, 0.0, 1.0], 2)]
    df = spark.createDataFrame(rows, SCHEMA)
    for name in ("node", "id", "v", "norm", "block", "leaf", "same", "low", "high", "score", "kind"):
        df = df.withColumn(name, F.lit("x"))
    assert found(df, block=9) == brute(rows)
    assert found(df.limit(0)) == []
    one = spark.createDataFrame(rows[:1], SCHEMA)
    assert found(one) == []


def test_scores_are_exact_beyond_53_bits(spark):
    rows = [(i, [float(2.0**19 + i), float(3 * i + 2.0**18)], i % 2) for i in range(40)]
    assert found(spark.createDataFrame(rows, SCHEMA), block=8) == brute(rows)
    with pytest.raises(Exception, match="63 bits|long overflow"):
        found(spark.createDataFrame([(0, [1e12], 1), (1, [1e12], 2)], SCHEMA))


def test_walk_goes_nearest_first_and_leaves_far_leaves_out():
    rng = np.random.default_rng(2)
    rows = np.floor(256 * (rng.normal(0, 1, (20, 4))[rng.integers(0, 20, 3000)] + rng.normal(0, 0.05, (3000, 4)))).astype(np.int64)
    norms = (rows * rows).sum(axis=1)
    space = hn.Space(4, int(norms.max()), int(np.abs(rows).max()))
    tree = hn.Tree(space, rows, norms, 32)
    assert sorted(np.concatenate(tree.leaves).tolist()) == list(range(3000))
    for a in range(20):
        scores = rows @ rows[a]
        low, high = int(0.8 * scores[a]), int(scores[a])
        seen = list(tree.nearest_first(rows[a], int(norms[a]), space.reach(norms[a], high), lambda: space.reach(norms[a], low)))
        assert [d for d, _ in seen] == sorted(d for d, _ in seen) and len(seen) < len(tree.leaves) / 2
        held = np.concatenate([tree.leaves[leaf] for _, leaf in seen])
        assert set(np.flatnonzero((scores >= low) & (scores <= high)).tolist()) <= set(held.tolist())


def test_query_equals_sql(spark, sf_dir):
    same(QUERIES["op12_hard_negatives"](spark, sf_dir), connect(sf_dir), SQL["op12_hard_negatives"])
