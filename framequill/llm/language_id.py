"""Language identification by interpolated Kneser-Ney character models in sorted hash arrays.

One model of order 4 per language, over lower-cased letters, with everything else a word break; contexts end at the
break, so a model is one of words. All languages share one sorted array of n-gram hashes for each order,
with a row of log-probabilities, one for each language, already interpolated down; a prediction looks up the whole
4-gram and goes to shorter ones only where no language has it. As a model is one of words, each distinct word of a batch is scored
once. The language with the least cross-entropy per character wins.

Rejection is calibrated to a chosen rate: in each language and range of lengths, held-back training texts give limits of the
cross-entropy that one more such text passes with probability ``reject``, by Student's distribution (the fewer held-back texts, the
wider) and by an exponential tail fitted to their upper fifth (the longer that tail, the wider); a text is rejected above both, and
never within ``margin`` bits of what a held-back text of that range or a longer one reached: mixed and damaged texts are rarer than
the sample can show, and stay. A language with fewer than two held-back texts rejects nothing.

Training uses a bounded sample, ``per_language`` documents of each language, those with the least hashes of their identifier; the
counts of its 4-grams are all that reaches the driver.

Defined results
    null text or one without letters: ``und``, score 0, not accepted; equal cross-entropies: the first language in order; rows
    without identifier or language are predicted, not learned from; of rows that repeat an identifier one is learned from and each
    is predicted; a very long text counts whole, in batches of its own; without any labelled row all are ``und``;
    an empty table gives an empty result; further columns are ignored, or carried along by ``identified``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from framequill.llm.words import mix, powers, slices, text_bytes
from framequill.session import Shared, load, ship, small_batches, spool

ship(__name__)

ORDER = 4
PARTS = 256
BINS = 24
UPPER = 0.2
#: Bytes of text looked at together; each takes about 150 bytes of arrays.
PIECE = 1 << 19
#: Fixed value: no assigned letter lies at or beyond this code point.
LETTERS_END = 0x323B0
_LETTERS: list[np.ndarray] = []


def letters() -> np.ndarray:
    """Code point to lower-cased letter, 0 for what is no letter; ideographs beyond the table stand for themselves."""
    if not _LETTERS:
        table = np.zeros(0x30000, np.uint32)
        for i in range(len(table)):
            c = chr(i)
            if c.isalpha():
                low = c.lower()
                table[i] = ord(low) if len(low) == 1 else i
        _LETTERS.append(table)
    return _LETTERS[0]


def characters(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Letters of all texts, words closed by a 0, and where each text begins (one more than texts)."""
    data, offsets = text_bytes(column)
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le", "surrogatepass"), np.uint32)
    heads = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    begin = heads[offsets]
    table = letters()
    chars = table[np.minimum(points, len(table) - 1)]
    if len(points) and points.max() >= len(table):
        chars = np.where(points >= len(table), np.where(points < LETTERS_END, points, 0), chars)
    # One break after the last letter of a word or text; other breaks go.
    last = np.zeros(len(chars) + 1, bool)
    last[begin] = True
    inside = chars != 0
    stop = inside.copy()
    stop[:-1] &= (chars[1:] == 0) | last[1:-1]
    times = inside.astype(np.int64) + stop
    out = np.repeat(chars, times)
    sums = np.concatenate([[0], np.cumsum(times)])
    closing = sums[1:][stop] - 1
    out[closing] = 0
    return out, sums[begin]


def windows(chars: np.ndarray) -> list[np.ndarray]:
    """chars[i - j] for j = 0 .. ORDER-1, with 0 where a word break lies between."""
    out = [chars.astype(np.uint64)]
    open_ = np.ones(len(chars), bool)
    for j in range(1, ORDER):
        back = np.zeros(len(chars), np.uint64)
        back[j:] = chars[:-j]
        open_ = open_ & (back != 0)
        out.append(np.where(open_, back, 0))
    return out


def keys(columns: list[np.ndarray]) -> np.ndarray:
    """Hash of n-grams given by their characters, the last one first."""
    weights = powers(ORDER + 1)[1:]
    total = np.full(len(columns[0]), len(columns), np.uint64)
    for c, w in zip(columns, weights):
        total += (c + np.uint64(1)) * w
    return mix(total)


@dataclass
class Table:
    """Sorted hashes with a row of values each."""

    hashes: np.ndarray
    values: np.ndarray

    def __post_init__(self):
        order = np.argsort(self.hashes)
        self.hashes, self.values = self.hashes[order], self.values[order].astype(np.float32)

    def find(self, wanted: np.ndarray) -> np.ndarray:
        """Row of each hash, -1 where there is none."""
        if not len(self.hashes):
            return np.full(len(wanted), -1, np.int64)
        order = np.argsort(wanted)  # rising look-ups stay within cached pages
        at = np.minimum(np.searchsorted(self.hashes, wanted[order]), len(self.hashes) - 1)
        found = np.empty(len(wanted), np.int64)
        found[order] = np.where(self.hashes[at] == wanted[order], at, -1)
        return found


def distinct_words(chars: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(characters of the distinct words, where each begins, the number of each word of ``chars``); words end with a 0."""
    ends = np.flatnonzero(chars == 0) + 1
    starts = np.append(0, ends[:-1])
    size = ends - starts
    hashes = np.add.reduceat((chars + np.uint64(1)) * powers(int(size.max()))[np.arange(len(chars)) - np.repeat(starts, size)], starts)
    _, first, number = np.unique(mix(hashes), return_index=True, return_inverse=True)
    size, begin = size[first], np.concatenate([[0], np.cumsum(size[first])[:-1]])
    return chars[np.arange(size.sum()) + np.repeat(starts[first] - begin, size)], begin, number


@dataclass
class Model:
    langs: list[str]
    grams: list[Table]  # [m]: log2 P of the last of m+1 characters
    backoff: list[Table]  # [m]: log2 of what a context of m+1 characters leaves to the shorter one
    unseen: np.ndarray
    limit: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))

    def logs(self, chars: np.ndarray) -> np.ndarray:
        """log2 P of every character under every language."""
        columns = windows(chars)
        out = np.empty((len(chars), len(self.langs)), np.float32)
        todo, base = np.arange(len(chars)), None
        for m in range(ORDER, 0, -1):
            own = columns if m == ORDER else [c[todo] for c in columns]
            rows = self.grams[m - 1].find(keys(own[:m]))
            hit = rows >= 0
            values = self.grams[m - 1].values[rows[hit]]
            out[todo[hit]] = values if base is None else values + base[hit]
            left = np.flatnonzero(~hit)
            todo = todo[left]
            base = np.zeros((len(left), len(self.langs)), np.float32) if base is None else base[left]
            if not len(todo):
                return out
            if m > 1:
                rows = self.backoff[m - 2].find(keys([c[left] for c in own[1:m]]))
                base[rows >= 0] += self.backoff[m - 2].values[rows[rows >= 0]]
        out[todo] = base + self.unseen
        return out

    def entropies(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(cross-entropy in bits per character of each text under each language, characters of each text)."""
        chars, begin = characters(column)
        n = np.diff(begin)
        out = np.full((len(n), len(self.langs)), np.nan)
        full = np.flatnonzero(n > 0)
        if len(full) and self.langs:
            words, at, number = distinct_words(chars)
            sums = np.add.reduceat(self.logs(words), at, axis=0, dtype=np.float64)[number]
            first = np.concatenate([[0], np.cumsum(chars == 0)])[begin[full]]
            out[full] = -np.add.reduceat(sums, first, axis=0) / n[full, None]
        return out, n

    def decide(self, column: pa.Array) -> tuple[list, np.ndarray, np.ndarray, np.ndarray]:
        """(language, score, cross-entropy, accepted) of each text."""
        h, n = self.entropies(column)
        if not self.langs:
            return ["und"] * len(n), np.zeros(len(n)), np.full(len(n), np.nan), np.zeros(len(n), bool)
        known = n > 0
        filled = np.where(known[:, None], h, 0.0)
        best = filled.argmin(axis=1)
        least = filled[np.arange(len(n)), best]
        share = np.exp2(-np.minimum(n, 50)[:, None] * (filled - least[:, None]))
        score = np.where(known, 1 / share.sum(axis=1), 0.0)
        accepted = known & (least <= self.limit[best, length_bin(n)])
        return [self.langs[b] if k else "und" for b, k in zip(best, known)], score, np.where(known, least, np.nan), accepted


def length_bin(n: np.ndarray) -> np.ndarray:
    return np.minimum(np.log2(np.maximum(n, 1)).astype(int), BINS - 1)


def count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, text) to counted 4-grams (lang, c3, c2, c1, c0), c0 the last character."""
    for batch in slices(batches, "text", PIECE):
        langs = np.asarray(batch.column(0).to_pylist(), object)
        chars, begin = characters(batch.column(1))
        columns = windows(chars)
        owner = np.repeat(np.arange(len(langs)), np.diff(begin))
        for lang in sorted(set(langs)):
            rows = (langs == lang)[owner]
            grams, counts = np.unique(np.stack([c[rows].astype(np.int32) for c in columns[::-1]], axis=1), axis=0, return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(counts), pa.string()), *[pa.array(grams[:, j]) for j in range(ORDER)], pa.array(counts, pa.int64())],
                ["lang", "c3", "c2", "c1", "c0", "n"])


def fit(counted: pa.Table) -> Model:
    """Interpolated Kneser-Ney: counts at the highest order, numbers of distinct left neighbours below."""
    langs = sorted(set(counted.column("lang").to_pylist()))
    if not langs:
        return Model([], [], [], np.zeros(0))
    lang = np.asarray(counted.column("lang").to_pylist(), object)
    grams = np.stack([counted.column(c).to_numpy() for c in ("c3", "c2", "c1", "c0")], axis=1)
    top, row = np.unique(grams, axis=0, return_inverse=True)
    number = np.asarray(counted.column("n").to_numpy(), float)
    counts = np.zeros((len(top), len(langs)))
    for j, name in enumerate(langs):
        own = lang == name
        np.add.at(counts[:, j], row.ravel()[own], number[own])
    levels = [(top, counts)]
    for m in range(ORDER - 1, 0, -1):
        longer, c = levels[-1]
        shorter, row = np.unique(longer[:, 1:], axis=0, return_inverse=True)
        kinds = np.zeros((len(shorter), len(langs)))
        np.add.at(kinds, row.ravel(), (c > 0).astype(float))
        levels.append((shorter, kinds))
    levels.reverse()
    alphabet = len(levels[0][0]) + 1
    tables, leave, lower = [], [], np.full((1, len(langs)), 1 / alphabet)
    unseen = None
    for m, (rows, c) in enumerate(levels, 1):
        once, twice = (c == 1).sum(axis=0), (c == 2).sum(axis=0)
        discount = np.clip(np.where(once > 0, once / np.maximum(once + 2 * twice, 1), 0.5), 0.1, 0.95)
        if m == 1:
            context, suffix = np.zeros(len(rows), int), np.zeros(len(rows), int)
            contexts = np.zeros((1, 0), int)
        else:
            contexts, context = np.unique(rows[:, :-1], axis=0, return_inverse=True)
            suffix = lookup_rows(levels[m - 2][0], rows[:, 1:])
            context = context.ravel()
        total, kinds = np.zeros((len(contexts), len(langs))), np.zeros((len(contexts), len(langs)))
        np.add.at(total, context, c)
        np.add.at(kinds, context, (c > 0).astype(float))
        gamma = np.where(total > 0, discount * kinds / np.maximum(total, 1), 1.0)
        p = np.where(total[context] > 0, np.maximum(c - discount, 0) / np.maximum(total[context], 1), 0.0) + gamma[context] * lower[suffix]
        tables.append(Table(keys([rows[:, -1 - j].astype(np.uint64) for j in range(m)]), np.log2(p)))
        if m == 1:
            unseen = np.log2(gamma[0] / alphabet)
        else:
            leave.append(Table(keys([contexts[:, -1 - j].astype(np.uint64) for j in range(m - 1)]), np.log2(gamma)))
        lower = p
    return Model(langs, tables, leave, unseen, np.full((len(langs), BINS), np.inf))


def lookup_rows(table: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Where each row stands in a table of distinct rows that has it."""
    _, where = np.unique(np.concatenate([table, rows]), axis=0, return_inverse=True)
    where = where.ravel()
    place = np.empty(where.max() + 1, int)
    place[where[: len(table)]] = np.arange(len(table))
    return place[where[len(table) :]]


def student_quantile(tail: float, freedom: int) -> float:
    """What a Student variable exceeds with probability ``tail``, by the angle substitution x = sqrt(freedom) tan(angle)."""
    angle = np.linspace(-np.pi / 2, np.pi / 2, 200_001)
    density = np.cos(angle) ** (freedom - 1)
    upto = np.cumsum(density[::-1])[::-1]
    at = int(np.searchsorted(-upto, -tail * upto[0]))
    return float(np.sqrt(freedom) * np.tan(angle[min(at, len(angle) - 2)]))


def calibrate(model: Model, langs: np.ndarray, lengths: np.ndarray, own: np.ndarray, reject: float, margin: float = 1.5, least: int = 8) -> None:
    """Limits for each language and bin of length from the cross-entropies of held-back texts.

    A bin with fewer than ``least`` texts takes the next longer ones in, and one that has no longer ones the next shorter. A limit
    never falls towards shorter texts.
    """
    limit = np.full((len(model.langs), BINS), np.inf)
    bins = length_bin(lengths)
    for j, name in enumerate(model.langs):
        rows = langs == name
        if rows.sum() < 2:
            continue
        h, at = own[rows], bins[rows]
        for b in range(BINS):
            upto = next((u for u in range(b, BINS) if ((at >= b) & (at <= u)).sum() >= least), BINS - 1)
            from_ = next((f for f in range(b, -1, -1) if ((at >= f) & (at <= upto)).sum() >= least), 0)
            held = h[(at >= from_) & (at <= upto)]
            n = len(held)
            fifth = np.quantile(held, 1 - UPPER)
            tail = fifth + (held[held >= fifth] - fifth).mean() * np.log(UPPER / reject)
            limit[j, b] = max(held.mean() + student_quantile(reject, n - 1) * held.std(ddof=1) * np.sqrt(1 + 1 / n), tail, h[at >= from_].max() + margin)
        limit[j] = np.maximum.accumulate(limit[j][::-1])[::-1]
    model.limit = limit


def in_fold(id_col: str, of: int) -> Column:
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(of))


def sampled(docs: DataFrame, id_col: str, text_col: str, lang_col: str, learn: Column, per_language: int) -> DataFrame:
    """(id, lang, text) of the ``per_language`` identifiers of each language with the least hashes, one row of each.

    Each of PARTS parts of a language gives up more than its share first, so no task ranks a whole language.
    """
    rows = docs.where(learn & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & F.col(id_col).isNotNull())
    rows = rows.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    slim = rows.select("id", "lang").distinct().withColumn("drawn", F.xxhash64("id", F.lit(11))).withColumn("part", F.pmod("drawn", F.lit(PARTS)))
    parts = Window.partitionBy("lang", "part").orderBy("drawn", "id")
    whole = Window.partitionBy("lang").orderBy("drawn", "id")
    chosen = (slim.withColumn("nth", F.row_number().over(parts)).where(F.col("nth") <= 16 + 4 * -(-per_language // PARTS))
              .withColumn("nth", F.row_number().over(whole)).where(F.col("nth") <= per_language).select("id", "lang"))
    return rows.join(F.broadcast(chosen), ["id", "lang"], "left_semi").groupBy("id", "lang").agg(F.min("text").alias("text"))


def train(docs: DataFrame, id_col: str, text_col: str, lang_col: str, learn: Column, per_language: int = 2048, reject: float = 1e-5, margin: float = 1.5) -> Model:
    """The model of a sample with at most ``per_language`` documents of each language, an eighth of them held back for the limits."""
    spark = docs.sparkSession
    sample = spool(sampled(docs, id_col, text_col, lang_col, learn, per_language), "sample")
    held = F.pmod(F.xxhash64("id", F.lit(12)), F.lit(8)) == 0
    counted = sample.where(~held).select("lang", "text").mapInArrow(count_grams, "lang string, c3 int, c2 int, c1 int, c0 int, n long")
    model = fit(counted.groupBy("lang", "c3", "c2", "c1", "c0").agg(F.sum("n").alias("n")).toArrow())
    if model.langs:
        given = Shared(spark, model)

        def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, "text", PIECE):
                h, n = given.value.entropies(batch.column(1))
                own = [h[i, given.value.langs.index(l)] if l in given.value.langs else np.nan for i, l in enumerate(batch.column(0).to_pylist())]
                keep = np.isfinite(own) & (n > 0)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.array(np.asarray(own, float))], ["lang", "n", "h"]).filter(pa.array(keep))

        seen = sample.where(held).select("lang", "text").mapInArrow(measure, "lang string, n long, h double").toArrow()
        calibrate(model, np.asarray(seen.column("lang").to_pylist(), object), seen.column("n").to_numpy(), seen.column("h").to_numpy(), reject, margin)
    return model


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score, bits, accepted) for each row."""
    given = Shared(docs.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", PIECE):
            lang, score, bits, accepted = given.value.decide(batch.column(1))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(lang, pa.string()), pa.array(score), pa.array(bits, pa.float64(), from_pandas=True), pa.array(accepted)],
                ["id", "lang_pred", "score", "bits", "accepted"])

    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = slim.schema["id"].dataType.simpleString()
    return slim.mapInArrow(run, f"id {kind}, lang_pred string, score double, bits double, accepted boolean")


def identified(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text is accepted as one of the model's languages."""
    given = Shared(docs.sparkSession, model)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_col, PIECE):
            yield batch.filter(pa.array(given.value.decide(batch.column(at))[3]))

    return docs.mapInArrow(run, T.StructType(docs.schema.fields))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs = load(spark, sf_dir, "documents")
    model = train(docs, "doc_id", "text", "lang", in_fold("doc_id", 4) != 2)
    return predict(docs, model).select(
        F.col("id").alias("doc_id"), F.coalesce(in_fold("id", 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score", "bits", "accepted")
