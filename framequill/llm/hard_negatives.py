"""Hard negatives by a vantage-point tree over norm-augmented vectors.

1. Components become floor(256 x); all scores are exact integers. With M the greatest norm, a row v gets one more component
   sqrt(M^2 - |v|^2) and an anchor a zero, so that |a - v|^2 = |a|^2 + M^2 - 2 a.v: a window of scores is an annulus of
   distances, and a higher score is a nearer row.
2. The top of the tree is fitted on at most ``SAMPLE`` rows (those with the least hashes): a node holds a vantage point and the median
   distance to it. All rows are routed down it in a map; a leaf's rows are dealt into blocks of about ``BLOCK`` by hash, however many
   rows or copies fall into one leaf.
3. A question (anchor, least and highest distance, label) goes to the leaves whose annuli can meet its own, and there to all blocks. A
   block's task builds a tree of its own and walks it nearest first, inside the annulus, until k rows of the wanted labels are
   found and nothing nearer can follow; questions stream past it. The k best of all blocks are the answer, so it is exact.
4. Positives are the k nearest rows of the anchor's label; an anchor first asks one block of its own leaf, and what it
   finds there bounds its question to the others. Each positive's score then opens the window for negatives; equal
   windows of an anchor are asked once.

Defined results
    rows with a null label, a null vector or a null, NaN or infinite component take no part; shorter vectors are filled up with
    zeros; rows that repeat an identifier are rows of their own; rows without identifier are no anchors and come last among ties;
    an anchor without positives, or a positive without negatives, gives no row; scores beyond 63 bits are an error; one row's norm
    far above the rest makes annuli wide and the walk long, but right; an empty table gives an empty result; further columns
    are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from framequill.session import Shared, load, ship, spool

ship(__name__)

#: Rows the top of the tree is fitted on, rows of a block, rows of a leaf of a block's own tree.
SAMPLE, BLOCK, BUCKET = 4096, 4096, 128
SCALE = 256


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Lists of integers as rows, filled up with zeros."""
    values, sizes = column.flatten().to_numpy(zero_copy_only=False), np.asarray(column.value_lengths())
    if len(sizes) and (sizes == width).all():
        return values.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width), np.int64)
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = values
    return out


class Space:
    """Distances of rows and anchors under the greatest squared norm, ``most``."""

    def __init__(self, width: int, most: int, largest: int):
        if max(width * largest * largest, most) >= 1 << 62:
            raise ValueError("components are too large for scores of 63 bits")
        self.width, self.most = width, most
        #: Products of floats are exact below 2^53.
        self.kind = np.float64 if width * largest * largest < 1 << 53 else np.int64
        #: What rounding may take from or add to a distance.
        self.slack = 1e-5 * (1 + most**0.5)

    def rest(self, norms: np.ndarray) -> np.ndarray:
        """The additional component of rows."""
        return np.sqrt(np.maximum(self.most - norms.astype(float), 0))

    def between(self, rows: np.ndarray, norms: np.ndarray, point: np.ndarray, norm: int) -> np.ndarray:
        """Distances of rows to a row."""
        products = (rows.astype(self.kind) @ point.astype(self.kind)).astype(float)
        return np.sqrt(np.maximum(2 * (self.most - products - self.rest(norms) * self.rest(np.asarray([norm]))[0]), 0))

    def asked(self, rows: np.ndarray, point: np.ndarray, norm: int) -> np.ndarray:
        """Distances of rows to an anchor."""
        return np.sqrt(np.maximum(norm + self.most - 2 * (rows.astype(self.kind) @ point.astype(self.kind)).astype(float), 0))

    def reach(self, norm: float, score: float) -> float:
        """The distance from an anchor at which rows have this score."""
        return max(norm + self.most - 2 * score, 0) ** 0.5


def split(space: Space, rows: np.ndarray, norms: np.ndarray, least: int, leaves: list, points: list, own: np.ndarray, depth: int = 0):
    """A tree as nested (point, nearest, median, farthest, inner, outer) over ``own`` row numbers; a leaf is its number.

    The vantage point is the row farthest from the first one, so that distances to it spread. Rows that all have one distance
    stay together.
    """
    if len(own) > least and depth < 64:
        far = own[np.argmax(space.between(rows[own], norms[own], rows[own[0]], norms[own[0]]))]
        d = space.between(rows[own], norms[own], rows[far], norms[far])
        middle = float(np.median(d))
        near = d <= middle
        if near.all():  # over half lie at the rim
            middle = float(d[d < d.max()].max(initial=d.min()))
            near = d <= middle
        if not near.all():
            points.append(far)
            at = len(points) - 1
            return (at, float(d.min()), middle, float(d.max()),
                    split(space, rows, norms, least, leaves, points, own[near], depth + 1), split(space, rows, norms, least, leaves, points, own[~near], depth + 1))
    leaves.append(own)
    return len(leaves) - 1


class Tree:
    """A vantage-point tree; ``open_ended`` where rows that it was not fitted on are routed down it."""

    def __init__(self, space: Space, rows: np.ndarray, norms: np.ndarray, least: int, open_ended: bool = False):
        self.space, self.leaves = space, []
        points: list = []
        self.root = split(space, rows, norms, least, self.leaves, points, np.arange(len(rows)))
        self.points, self.norms = rows[points], norms[points]
        self.open = open_ended
        if open_ended:
            self.leaves = [None] * len(self.leaves)

    def route(self, rows: np.ndarray, norms: np.ndarray) -> np.ndarray:
        """The leaf of each row."""
        found, todo = np.zeros(len(rows), np.int64), [(self.root, np.arange(len(rows)))]
        while todo:
            node, own = todo.pop()
            if isinstance(node, int):
                found[own] = node
            elif len(own):
                near = self.space.between(rows[own], norms[own], self.points[node[0]], self.norms[node[0]]) <= node[2]
                todo += [(node[4], own[near]), (node[5], own[~near])]
        return found

    def nearest_first(self, point: np.ndarray, norm: int, low: float, high) -> Iterator[tuple[float, int]]:
        """(least distance, leaf) of the leaves that can hold rows from ``low`` to ``high()``, by least distance."""
        slack = self.space.slack
        reach = self.space.asked(self.points, point, norm) if len(self.points) else ()
        queue, n = [(0.0, 0, np.inf, self.root)], 0
        while queue:
            least, _, most, node = heapq.heappop(queue)
            if least - slack > high():
                return
            if isinstance(node, int):
                yield least, node
                continue
            at, nearest, middle, farthest, inner, outer = node
            d = reach[at]
            for child, a, b in ((inner, 0.0 if self.open else nearest, middle), (outer, middle, np.inf if self.open else farthest)):
                l, m = max(least, d - b, a - d), min(most, d + b)
                if l - slack <= high() and m + slack >= low:
                    n += 1
                    heapq.heappush(queue, (l, n, m, child))


class Block:
    """The rows of a block under a tree of their own."""

    def __init__(self, space: Space, nodes: np.ndarray, ids: np.ndarray, labels: np.ndarray, rows: np.ndarray, norms: np.ndarray, bucket: int = BUCKET):
        self.tree = Tree(space, rows, norms, bucket)
        order = np.concatenate(self.tree.leaves) if len(rows) else np.zeros(0, int)
        self.at = np.concatenate([[0], np.cumsum([len(x) for x in self.tree.leaves])])
        self.nodes, self.ids, self.labels, self.rows = nodes[order], ids[order], labels[order], rows[order].astype(space.kind)
        self.space = space

    def best(self, node: int, point: np.ndarray, norm: int, label: int, same: bool, low: int, high: int, k: int) -> list[tuple[int, int]]:
        """(score, row) of the k first rows with (``same``) or without the label and low <= score <= high, but for the anchor's own."""
        space, found = self.space, []
        point = point.astype(space.kind)

        def outer() -> float:
            return space.reach(norm, max(low, found[k - 1][0])) + space.slack if len(found) >= k else space.reach(norm, low) + space.slack

        for _, leaf in self.tree.nearest_first(point, norm, space.reach(norm, high), outer):
            a, b = self.at[leaf], self.at[leaf + 1]
            scores = (self.rows[a:b] @ point).astype(np.int64)
            fits = (scores >= low) & (scores <= high) & ((self.labels[a:b] == label) == same) & (self.nodes[a:b] != node)
            hits = np.flatnonzero(fits)
            if len(hits):
                own = sorted(zip((-scores[hits]).tolist(), self.ids[a:b][hits].tolist(), (hits + a).tolist()))[:k]
                found = sorted([*((-s, i, r) for s, i, r in found), *own])[:k]
                found = [(-s, i, r) for s, i, r in found]
        return [(s, r) for s, _, r in found]


ROW = "node long, id long, label long, norm long, v array<bigint>"
LAST = (1 << 63) - 1


def answered(space: Space, k: int):
    """Rows of blocks (kind 0), each followed by the questions to it (kind 1), to the k best rows of each question."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, block = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            cut = np.flatnonzero(np.diff(np.asarray(batch.column(0))) | np.diff(np.asarray(batch.column(1)))) + 1
            for a, b in zip([0, *cut.tolist()], [*cut.tolist(), batch.num_rows]):
                part = batch.slice(a, b - a)
                key, kind = part.column(0)[0].as_py(), part.column(1)[0].as_py()
                if key != now:
                    now, held, block = key, [], None
                if not kind:
                    held.append([np.asarray(part.column(j).fill_null(LAST)) for j in (2, 3, 4, 5)] + [matrix(part.column(6), space.width)])
                    continue
                if not held and block is None:
                    continue
                if block is None:
                    nodes, ids, labels, norms, rows = (np.concatenate(c) for c in zip(*held))
                    block, held = Block(space, nodes, ids, labels, rows, norms), []
                points = matrix(part.column(6), space.width)
                asked = [part.column(j).to_pylist() for j in (2, 4, 5, 7, 8, 9)]
                out: tuple[list, list, list, list, list] = ([], [], [], [], [])
                for point, node, label, norm, same, low, high in zip(points, *asked):
                    for score, row in block.best(node, point, norm, label, same, low, high, k):
                        for column, value in zip(out, (node, high, block.nodes[row], block.ids[row], score)):
                            column.append(value)
                ids = pa.array(out[3], pa.int64(), mask=np.array(out[3], np.int64) == LAST) if out[3] else pa.array([], pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64()), ids, pa.array(out[4], pa.int64())],
                                                 ["node", "high", "found", "found_id", "score"])

    return run


class Index:
    """All rows, routed to leaves and dealt into blocks in a written table."""

    def __init__(self, rows: DataFrame, block: int = BLOCK, sample: int = SAMPLE):
        spark = rows.sparkSession
        facts = rows.agg(F.count(F.lit(1)).alias("n"), F.max("norm").alias("most"), F.max(F.size("v")).alias("width"), F.max(F.array_max(F.transform("v", F.abs))).alias("largest")).first()
        self.n = facts["n"]
        self.space = space = Space(facts["width"] or 0, facts["most"] or 0, facts["largest"] or 0)
        picked = rows.orderBy(F.xxhash64("v", "node"), "node").limit(min(sample, self.n)).select("norm", "v").toArrow()
        leaves = max(1, -(-self.n // block))
        tree = Tree(space, matrix(picked.column("v").combine_chunks(), space.width), picked.column("norm").to_numpy(), max(2, picked.num_rows // leaves), open_ended=True)
        self.top = top = Shared(spark, tree)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                where = top.value.route(matrix(batch.column(4), space.width), np.asarray(batch.column(3)))
                yield pa.RecordBatch.from_arrays([pa.array(where), *batch.columns], ["leaf", "node", "id", "label", "norm", "v"])

        routed = spool(rows.select("node", "id", "label", "norm", "v").mapInArrow(run, "leaf long, " + ROW), "routed")
        sizes = spool(routed.groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / block).alias("shares")), "leaves", 1)
        self.shares = F.broadcast(sizes)  # a row per leaf of the top, which has at most ``sample``
        self.rows = routed.join(self.shares, "leaf").select(self.number(F.col("leaf"), F.pmod(F.xxhash64("node"), "shares")).alias("block"), "node", "id", "label", "norm", "v")

    @staticmethod
    def number(leaf: Column, share: Column) -> Column:
        return F.shiftleft(leaf, 40) + share

    def ask(self, questions: DataFrame, k: int) -> DataFrame:
        """(node, high, found, found_id, score): the k best rows of questions (block, node, label, norm, v, same, low, high) in each block."""
        both = self.rows.select("block", F.lit(0).alias("kind"), "node", "id", "label", "norm", "v", F.lit(None).cast("boolean").alias("same"), F.lit(None).cast("long").alias("low"), F.lit(None).cast("long").alias("high"))
        both = both.join(questions.select("block").distinct(), "block", "left_semi")
        both = both.unionByName(questions.select("block", F.lit(1).alias("kind"), "node", F.lit(None).cast("long").alias("id"), "label", "norm", "v", "same", "low", "high"))
        return both.repartition("block").sortWithinPartitions("block", "kind", "node").mapInArrow(answered(self.space, k), "node long, high long, found long, found_id long, score long")

    def near(self, questions: DataFrame) -> DataFrame:
        """The questions (node, label, norm, v, same, low, high), one for each block that can hold an answer."""
        space, top = self.space, self.top

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                points = matrix(batch.column(3), space.width)
                rows, leaves = [], []
                for i, (point, norm, low, high) in enumerate(zip(points, *(batch.column(j).to_pylist() for j in (2, 5, 6)))):
                    far = space.reach(norm, low) + space.slack
                    own = [leaf for _, leaf in top.value.nearest_first(point, norm, space.reach(norm, high), lambda far=far: far)]
                    rows += [i] * len(own)
                    leaves += own
                held = batch.take(pa.array(rows, pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(leaves, pa.int64()), *held.columns], ["leaf", *batch.schema.names])

        spread = questions.select("node", "label", "norm", "v", "same", "low", "high").mapInArrow(run, "leaf long, node long, label long, norm long, v array<bigint>, same boolean, low long, high long")
        spread = spread.join(self.shares, "leaf").withColumn("share", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shares") - 1)))
        return spread.withColumn("block", self.number(F.col("leaf"), F.col("share")))


def first(found: DataFrame, by: list[str], k: int) -> DataFrame:
    """The k best of each group, with rank; a group has at most k rows of each block."""
    order = Window.partitionBy(*by).orderBy(F.col("score").desc(), F.col("found_id").isNull(), "found_id", "found")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def taking_part(rows: DataFrame, id_col: str, vector_col: str, label: Column) -> DataFrame:
    """(node, id, label, norm, v) of the rows that take part."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    held = rows.select(F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"), F.col(vector_col).cast("array<double>").alias("x"))
    held = held.where(F.col("label").isNotNull() & F.col("x").isNotNull() & ~F.exists("x", bad))
    held = held.select("id", "label", F.transform("x", lambda x: F.floor(x * SCALE)).alias("v"))
    held = held.withColumn("norm", F.aggregate("v", F.lit(0).cast("long"), lambda s, x: s + x * x))
    return spool(held.withColumn("node", F.monotonically_increasing_id()), "vectors")


def hard_negatives(
    rows: DataFrame, anchor: Column, label: Column, id_col: str = "vec_id", vector_col: str = "embedding",
    k: int = 5, percent: int = 80, block: int = BLOCK, sample: int = SAMPLE,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the rows for which ``anchor``, a condition on
    ``id``, holds: negatives from ``percent`` of the positive's score up to that score."""
    held = taking_part(rows, id_col, vector_col, label)
    anchors = spool(held.where(anchor), "anchors")
    index = Index(held, block, sample)
    bound = index.space.most + 1
    wide = anchors.withColumn("same", F.lit(True)).withColumn("low", F.lit(-bound).cast("long")).withColumn("high", F.lit(bound).cast("long"))

    # Positives: a block of the own leaf first, then all that can hold better ones.
    home = index.rows.select("block", "node").join(wide, "node")
    tried = first(index.ask(home, k), ["node"], k).where(F.col("rank") == k).select("node", F.col("score").alias("least"))
    rest = wide.join(tried, "node", "left").withColumn("low", F.coalesce("least", "low")).drop("least")
    positives = spool(first(index.ask(index.near(rest), k), ["node"], k).select("node", F.col("found_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")

    # Negatives: a window for each score of an anchor's positives.
    least = F.ceil(F.col("positive_score").cast("decimal(20,0)") * percent / 100).cast("long")
    windows = positives.select("node", F.col("positive_score").alias("high"), least.alias("low")).distinct().where("low <= high")
    questions = anchors.join(windows, "node").withColumn("same", F.lit(False))
    negatives = first(index.ask(index.near(questions), k), ["node", "high"], k)
    found = positives.join(negatives.withColumnRenamed("high", "positive_score"), ["node", "positive_score"]).join(anchors.select("node", F.col("id").alias("anchor_id")), "node")
    return found.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("found_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(load(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0, label)


OP12_SQL = """
with v as (
  select vec_id, cast(case when vec_id % 7 = 0 then (label + 1) % 10 else label end as bigint) as label,
         list_transform(embedding, lambda x: floor(256 * x::double)) as e
  from embeddings
  where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), s as (
  select a.vec_id as anchor_id, b.vec_id as other, a.label = b.label as same, cast(list_inner_product(a.e, b.e) as bigint) as score
  from v a join v b on a.vec_id % 100 = 0 and a.vec_id <> b.vec_id
), p as (
  select anchor_id, other as positive_id, score as positive_score from s where same
  qualify row_number() over (partition by anchor_id order by score desc, other) <= 5
)
select p.anchor_id, p.positive_id, cast(row_number() over (partition by p.anchor_id, p.positive_id order by s.score desc, s.other) as int) as rank,
       s.other as negative_id, p.positive_score, s.score as negative_score
from p join s on s.anchor_id = p.anchor_id and not s.same and 80 * p.positive_score <= 100 * s.score and s.score <= p.positive_score
qualify rank <= 5
"""
