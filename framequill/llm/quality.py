"""Quality by ordinal cumulative-link regression on graded ratings.

A text's features are its distinct words and a few marks of its shape (shares of capitals, digits, punctuation, distinct
words, bucketed), hashed into ``1 << BITS`` weights that all grades share. With ordered thresholds t_1 < t_2 < ... the model is
P(grade <= k) = sigmoid(t_k - w.x). It gives each text its expected grade and the tail probability of the highest grade,
by which documents are selected. Training takes at most ``sample`` rated documents, those with the least hashes of their
identifier, and runs on the driver by limited-memory BFGS; scoring is one pass over all texts.

Most words of a text say nothing of its grade, and words of one rated text only can be learned by heart. Only features whose
score statistic against the grades passes a bound get a weight, rare grades count for more than their rows, and the
bound and the penalty are those with the least balanced loss on held-out folds of the ratings.

Defined results
    null and empty texts are scored by their shape alone; a very long text is one set of distinct words, in pieces of text of
    bounded size; rows rated several times count as often; of ratings that tie for the last place of the sample those with the
    least identifier and grade are taken, and equal settings of the folds go to the stricter; a tail equal to the bound is
    selected; ratings without grade or without document are ignored; without ratings of two grades at least, grade and probability
    are null and every row is selected; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from framequill.llm.words import mix, slices, text_bytes, word_hashes
from framequill.session import Shared, load, ship, small_batches

ship(__name__)

BITS = 18
UPPER, DIGIT = np.zeros(256, bool), np.zeros(256, bool)
UPPER[65:91] = True
DIGIT[48:58] = True
MARK = np.zeros(256, bool)
MARK[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Distinct weight numbers of each text in a row, and where each text's begin (one more than texts)."""
    data, offsets = text_bytes(column)
    words, begin = word_hashes(data, offsets)
    texts = len(offsets) - 1
    owner = np.repeat(np.arange(texts), np.diff(begin))
    keys = np.unique((owner.astype(np.int64) << BITS) | (words >> np.uint64(64 - BITS)).astype(np.int64))
    distinct = np.bincount(keys >> BITS, minlength=texts)
    size = np.maximum(np.diff(offsets), 1)
    n = np.maximum(np.diff(begin), 1)
    count = lambda table: np.diff(np.concatenate([[0], np.cumsum(table[data])])[offsets])
    marks = [count(UPPER) / size, count(DIGIT) / size, count(MARK) / size, distinct / n, np.minimum(size / n, 40) / 40, np.log2(size) / 32]
    shape = [mix(np.full(texts, 1 + j, np.uint64) * np.uint64(1 << 20) + np.ceil(np.clip(m, 0, 1) * 12).astype(np.uint64)) for j, m in enumerate(marks)]
    shape = [(np.arange(texts, dtype=np.int64) << BITS) | (h >> np.uint64(64 - BITS)).astype(np.int64) for h in shape]
    keys = np.unique(np.concatenate([keys, *shape]))
    return (keys & ((1 << BITS) - 1)).astype(np.int32), np.searchsorted(keys >> BITS, np.arange(texts + 1))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


@dataclass
class Ordinal:
    weights: np.ndarray
    thresholds: np.ndarray
    #: Numbers of the features that have a weight, rising; None: all, weights by number.
    used: np.ndarray | None = None

    def index(self, numbers: np.ndarray, begin: np.ndarray) -> np.ndarray:
        if self.used is not None:
            numbers, begin = within(numbers, begin, self.used)
        sums = np.concatenate([[0.0], np.cumsum(self.weights[numbers], dtype=float)])[begin]
        return np.diff(sums) / np.sqrt(np.maximum(np.diff(begin), 1))

    def tails(self, numbers: np.ndarray, begin: np.ndarray) -> np.ndarray:
        """P(grade > k) for each text and threshold."""
        return sigmoid(self.index(numbers, begin)[:, None] - self.thresholds[None, :])


def within(numbers: np.ndarray, begin: np.ndarray, used: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The features that are among ``used``, by their place in it."""
    at = np.minimum(np.searchsorted(used, numbers), max(len(used) - 1, 0))
    hit = used[at] == numbers if len(used) else np.zeros(len(numbers), bool)
    return at[hit], np.concatenate([[0], np.cumsum(hit)])[begin]


def objective(
    point: np.ndarray, numbers: np.ndarray, begin: np.ndarray, grades: np.ndarray, penalty: float, share: np.ndarray | None = None,
) -> tuple[float, np.ndarray]:
    """(penalised negative log-likelihood, its gradient) at weights, first threshold and logarithms of the gaps.

    Rows count by ``share``, which sums to one; by default alike.
    """
    size = 1 << BITS if share is None else len(point) - int(grades.max())
    share = np.full(len(grades), 1 / len(grades)) if share is None else share
    weights, gaps = point[:size], np.exp(point[size + 1 :])
    model = Ordinal(weights, point[size] + np.concatenate([[0.0], np.cumsum(gaps)]))
    x = model.index(numbers, begin)
    edges = np.concatenate([[-np.inf], model.thresholds, [np.inf]])
    up, low = sigmoid(edges[grades + 1] - x), sigmoid(edges[grades] - x)
    p = np.maximum(up - low, 1e-12)
    d_up, d_low = share * up * (1 - up) / p, share * low * (1 - low) / p
    scale = 1 / np.sqrt(np.maximum(np.diff(begin), 1))
    grad_w = np.bincount(numbers, np.repeat((d_up - d_low) * scale, np.diff(begin)), size) + penalty * weights
    grad_t = np.array([d_low[grades == k + 1].sum() - d_up[grades == k].sum() for k in range(len(model.thresholds))])
    later = np.cumsum(grad_t[::-1])[::-1]
    return float(-(share * np.log(p)).sum() + 0.5 * penalty * weights @ weights), np.concatenate([grad_w, [later[0]], later[1:] * gaps])


def fit(
    numbers: np.ndarray, begin: np.ndarray, grades: np.ndarray, penalty: float = 1e-6, steps: int = 80, memory: int = 8,
    share: np.ndarray | None = None, size: int = 1 << BITS,
) -> Ordinal:
    """Maximum penalised likelihood by limited-memory BFGS; grades are 0, 1, ... without gaps. ``share`` as in ``objective``."""
    kinds = int(grades.max()) + 1
    held = np.full(len(grades), 1 / len(grades)) if share is None else share
    cum = np.clip(np.array([held[grades <= k].sum() for k in range(kinds - 1)]), 1e-4, 1 - 1e-4)
    start = np.log(cum / (1 - cum))
    point = np.concatenate([np.zeros(size), start[:1], np.log(np.maximum(np.diff(start), 1e-2))])
    value, grad = objective(point, numbers, begin, grades, penalty, share)
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        q, alphas = grad.copy(), []
        for s, y in reversed(pairs):
            alphas.append((s @ q) / (s @ y))
            q -= alphas[-1] * y
        q *= (pairs[-1][0] @ pairs[-1][1]) / (pairs[-1][1] @ pairs[-1][1]) if pairs else 1.0
        for (s, y), alpha in zip(pairs, reversed(alphas)):
            q += s * (alpha - (y @ q) / (s @ y))
        step, slope = 1.0, -(grad @ q)
        while step > 1e-8:
            tried = point - step * q
            after, new = objective(tried, numbers, begin, grades, penalty, share)
            if after <= value + 1e-4 * step * slope:
                break
            step /= 2
        else:
            break
        s, y = tried - point, new - grad
        if s @ y > 1e-12:
            pairs = [*pairs, (s, y)][-memory:]
        done = value - after < 1e-7 * max(1.0, abs(value))
        point, value, grad = tried, after, new
        if done:
            break
    return Ordinal(point[:size], point[size] + np.concatenate([[0.0], np.cumsum(np.exp(point[size + 1 :]))]))


#: Settings tried on held-out ratings: least score statistic of a feature, and penalty.
BOUNDS, PENALTIES, FOLDS = (5.0, 4.0, 3.0), (1e-3, 1e-4, 1e-5), 4
#: How far rare grades are made up for, from 0 (each row alike) to 1 (each grade alike).
POWER = 0.5


def balanced(grades: np.ndarray, power: float = 1.0) -> np.ndarray:
    """Shares of the rows that sum to one: with power 1 all grades count alike, with 0 all rows."""
    found, at, n = np.unique(grades, return_inverse=True, return_counts=True)
    share = (n ** -float(power))[at]
    return share / share.sum()


def statistics(numbers: np.ndarray, begin: np.ndarray, grades: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(features, g): the signed-root deviance of a feature's texts from the share of texts above a threshold, the largest over thresholds.

    The deviance stays small for features of one or two texts, however rare the grade.
    """
    found, at, seen = np.unique(numbers, return_inverse=True, return_counts=True)
    most = np.zeros(len(found))
    for k in range(int(grades.max())):
        above, p = grades > k, float((grades > k).mean())
        hit = np.bincount(at, np.repeat(above, np.diff(begin)), len(found))
        part = lambda o, e: o * np.log(np.maximum(o, 1) / e)
        most = np.maximum(most, np.sqrt(np.maximum(2 * (part(hit, seen * p) + part(seen - hit, seen * (1 - p))), 0)))
    return found, most


def screened(numbers: np.ndarray, begin: np.ndarray, grades: np.ndarray, bound: float, penalty: float, steps: int = 200) -> Ordinal:
    """The model of features whose statistic passes ``bound``."""
    share = balanced(grades, POWER)
    found, g = statistics(numbers, begin, grades)
    used = found[g >= bound]
    model = fit(*within(numbers, begin, used), grades, penalty, steps, share=share, size=len(used))
    model.used = used
    return model


def rows_of(numbers: np.ndarray, begin: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The features of some texts, in their order."""
    lengths = np.diff(begin)[rows]
    ends = np.concatenate([[0], np.cumsum(lengths)])
    return numbers[np.arange(ends[-1]) + np.repeat(begin[:-1][rows] - ends[:-1], lengths)], ends


def held_out_loss(numbers: np.ndarray, begin: np.ndarray, grades: np.ndarray, bound: float, penalty: float) -> float:
    """Balanced negative log-likelihood of ratings by models that have not seen them."""
    fold, losses = np.empty(len(grades), int), np.zeros(len(grades))
    for k in np.unique(grades):  # a fold has its part of each grade
        own = np.flatnonzero(grades == k)
        fold[own] = np.arange(len(own)) % FOLDS
    for i in range(FOLDS):
        seen, rest = np.flatnonzero(fold != i), np.flatnonzero(fold == i)
        if len(np.unique(grades[seen])) <= grades.max():
            return np.inf  # a grade with a single rating
        model = screened(*rows_of(numbers, begin, seen), grades[seen], bound, penalty)
        tails = np.concatenate([np.ones((len(rest), 1)), model.tails(*rows_of(numbers, begin, rest)), np.zeros((len(rest), 1))], axis=1)
        at = np.arange(len(rest))
        losses[rest] = -np.log(np.maximum(tails[at, grades[rest]] - tails[at, grades[rest] + 1], 1e-6))
    return float((balanced(grades) * losses).sum())


def chosen(numbers: np.ndarray, begin: np.ndarray, grades: np.ndarray) -> Ordinal:
    """The model with the bound and the penalty that do best on held-out folds."""
    settings = [(b, p) for b in BOUNDS for p in PENALTIES]
    return screened(numbers, begin, grades, *min(settings, key=lambda s: held_out_loss(numbers, begin, grades, *s)))


def train(docs: DataFrame, ratings: DataFrame, sample: int = 12_000) -> Ordinal | None:
    """The model of at most ``sample`` ratings (id, grade)."""
    rated = ratings.where("id is not null and grade is not null").select("id", F.col("grade").cast("int").alias("grade"))
    picked = rated.orderBy(F.xxhash64("id"), "id", "grade").limit(sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            numbers, begin = features(batch.column(1))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.ListArray.from_arrays(pa.array(begin, pa.int32()), pa.array(numbers)), batch.column(2)], ["grade", "numbers", "place"])

    held = docs.join(F.broadcast(picked), "id").select("grade", "text", F.xxhash64("id", "grade").alias("place"))
    held = held.mapInArrow(run, "grade int, numbers array<int>, place long").toArrow().sort_by([("place", "ascending"), ("grade", "ascending")])
    grades = held.column("grade").to_numpy()
    found, grades = np.unique(grades, return_inverse=True)
    if len(found) < 2:
        return None
    lists = held.column("numbers").combine_chunks()
    return chosen(lists.flatten().to_numpy(), np.concatenate([[0], np.cumsum(pa.compute.list_value_length(lists).to_numpy())]), grades)


def settled(found: DataFrame, ratings: DataFrame) -> DataFrame:
    """What was rated by hand is selected by its rating, the least if there are several; adds ``rated``."""
    rated = ratings.where("id is not null and grade is not null").groupBy("id").agg(F.min("grade").alias("own grade"))
    top = ratings.agg(F.max("grade")).first()[0]
    return found.join(rated, "id", "left").select(
        "id", "expected_grade", "tail_probability",
        F.coalesce(F.col("own grade") == F.lit(top), "selected").alias("selected"), F.col("own grade").isNotNull().alias("rated"))


def rate(docs: DataFrame, ratings: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_tail: float = 0.5, sample: int = 12_000) -> DataFrame:
    """(id, expected_grade, tail_probability, selected): expectation over 0, 1, ..., and the highest grade's probability."""
    small_batches(docs.sparkSession)
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    model = train(docs, ratings, sample)
    if model is None:
        return docs.select("id", F.lit(None).cast("double").alias("expected_grade"), F.lit(None).cast("double").alias("tail_probability"), F.lit(True).alias("selected"))
    given = Shared(docs.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            tails = given.value.tails(*features(batch.column(1))).astype(float)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(tails.sum(axis=1)), pa.array(tails[:, -1]), pa.array(tails[:, -1] >= least_tail)],
                ["id", "expected_grade", "tail_probability", "selected"])

    kind = docs.schema["id"].dataType.simpleString()
    return docs.mapInArrow(run, f"id {kind}, expected_grade double, tail_probability double, selected boolean")


def op8_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxic is grade 0, poor 1, good 2; the model judges what nobody has rated."""
    grade = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).when((F.col("quality") == 1) & (F.col("toxic") == 0), 2)
    ratings = load(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), grade.alias("grade"))
    return settled(rate(load(spark, sf_dir, "documents"), ratings), ratings).withColumnRenamed("id", "doc_id")
