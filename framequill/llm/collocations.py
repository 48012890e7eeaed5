"""Collocations of two to five words by hashed bucket counts (PCY, DHP) and Apriori pruning.

Pass k reads all texts once. It counts phrases of k words exactly, and hashes phrases of k + 1 words into ``buckets`` counters
that stop at the least frequency; tasks' counters are summed bucket by bucket and broadcast as a bitmap. A phrase of k + 1 words is
counted by the next pass only if its bucket was full and both of its phrases of k words are frequent, which a second
bitmap of the same size tells; a phrase is hashed only if its parts were counted. Both bitmaps only ever let too much through, so the
exact counts, which shuffle one row per phrase and task, decide. Cuts, scores and the dropping of contained
phrases are joins of the tables of frequent phrases; all arithmetic is on decimals of 38 digits.

The number of buckets follows from the bytes of text, up to ``MOST_BUCKETS`` (4 MB as a bitmap, 128 MB of counters in a task); beyond,
bitmaps fill up and prune less, and results stay the same.

Defined results
    null text counts as empty, null lang as ``und``; a phrase does not cross a break, and only words count, so empty pieces
    give nothing; very long texts are tokenised whole, one at a time, with arrays of about 30 bytes for each of their bytes; repeated rows
    count as often; equal scores are ordered by frequency, then by the bytes of the phrase; an empty table gives an empty
    result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from framequill.llm.graph import matching
from framequill.llm.words import mix, slices, text_bytes
from framequill.session import Shared, load, ship, small_batches, spool, spool_counted

ship(__name__)

LONGEST, LEAST, TOP = 5, 100, 2000
BREAKS, BLANKS = b".,;:!?\n\x0b\x0c\r", b" \t"
MOST_BUCKETS, CHUNK = 1 << 25, 1 << 16
#: Different phrases that a task holds before it hands them on.
HELD = 1 << 17

BREAK, WHITE, LOWER = np.zeros(256, bool), np.zeros(256, bool), np.arange(256, dtype=np.uint8)
BREAK[list(BREAKS)] = True
WHITE[list(BREAKS + BLANKS)] = True
LOWER[65:91] += 32
WEIGHTS = np.random.default_rng(77).integers(1, 1 << 63, LONGEST, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def digest(word: bytes) -> int:
    from xxhash import xxh64_intdigest

    return xxh64_intdigest(word, 13)


def hashed(langs: np.ndarray, words: list[np.ndarray]) -> np.ndarray:
    """Hashes of phrases, from those of their language and of each of their words."""
    total = langs.copy()
    for weight, own in zip(WEIGHTS, words):
        total += own * weight
    return mix(total)


class Text:
    """The words of the texts of a piece: their place in ``dictionary``, hashes, language and the stretch without break they lie in."""

    def __init__(self, langs: pa.Array, column: pa.Array):
        data, offsets = text_bytes(column)
        black = ~WHITE[data]
        first, last = black.copy(), black.copy()
        cut = np.zeros(len(data) + 1, bool)
        cut[offsets] = True
        first[1:] &= ~black[:-1] | cut[1:-1]
        last[:-1] &= ~black[1:] | cut[1:-1]
        at = np.flatnonzero(first)
        ends = np.concatenate([[0], np.cumsum(np.flatnonzero(last) + 1 - at)])
        held = pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(LOWER[data[black]])).dictionary_encode()
        self.dictionary, self.words = held.dictionary, np.asarray(held.indices).astype(np.int64)
        own = np.searchsorted(offsets, at, "right") - 1
        self.stretch = np.cumsum(BREAK[data])[at] + own if len(at) else at
        names = langs.dictionary_encode()
        self.names, self.langs = names.dictionary, np.asarray(names.indices).astype(np.int64)[own]
        hashes = lambda values: np.array([digest(v) for v in values.cast(pa.large_binary()).to_pylist()], np.uint64)
        self.word_hashes, self.lang_hashes = hashes(self.dictionary)[self.words], hashes(self.names)[self.langs]

    def whole(self, k: int) -> np.ndarray:
        """Whether k words from here on lie in one stretch."""
        found = np.zeros(len(self.words), bool)
        if len(found) >= k:
            found[: len(found) - k + 1] = self.stretch[: len(found) - k + 1] == self.stretch[k - 1 :]
        return found

    def hashes(self, at: np.ndarray, k: int) -> np.ndarray:
        return hashed(self.lang_hashes[at], [self.word_hashes[at + j] for j in range(k)])

    def counted(self, at: np.ndarray, k: int) -> pa.Table:
        """(lang, phrase, n) of the phrases of k words that begin ``at``; numbers stand for words, so equal means equal."""
        codes = self.langs[at]
        for j in range(k):
            _, codes = np.unique(codes * len(self.dictionary) + self.words[at + j], return_inverse=True)
        _, one, n = np.unique(codes, return_index=True, return_counts=True)
        parts = [self.dictionary.take(pa.array(self.words[at[one] + j])) for j in range(k)]
        phrase = pa.compute.binary_join_element_wise(*parts, pa.scalar(" ", pa.large_string())) if k > 1 else parts[0]
        return pa.table([self.names.take(pa.array(self.langs[at[one]])).cast(pa.string()), phrase.cast(pa.string()), pa.array(n)], ["lang", "phrase", "n"])


SCHEMA = "lang string, phrase string, n long, chunk int, counts binary"


def filled(table: pa.Table) -> Iterator[pa.RecordBatch]:
    n = table.num_rows
    table = table.append_column("chunk", pa.nulls(n, pa.int32())).append_column("counts", pa.nulls(n, pa.binary()))
    yield from table.combine_chunks().to_batches(max_chunksize=1 << 14)


def chunks(counts: np.ndarray, most: int) -> Iterator[pa.RecordBatch]:
    """The counters as rows of ``CHUNK`` bytes, without those that are all zero."""
    for c in range(-(-len(counts) // CHUNK)):
        part = np.minimum(counts[c * CHUNK : (c + 1) * CHUNK], most).astype(np.uint8)
        if part.any():
            null = lambda kind: pa.nulls(1, kind)
            yield pa.RecordBatch.from_arrays([null(pa.string()), null(pa.string()), null(pa.int64()), pa.array([c], pa.int32()), pa.array([part.tobytes()])], ["lang", "phrase", "n", "chunk", "counts"])


class Bits:
    """A bitmap asked by the upper bits of hashes; None holds everything."""

    def __init__(self, bits: np.ndarray | None, width: int):
        self.bits, self.shift = bits, np.uint64(64 - width)

    def has(self, hashes: np.ndarray) -> np.ndarray:
        if self.bits is None:
            return np.ones(len(hashes), bool)
        at = hashes >> self.shift
        return (self.bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def passed(k: int, width: int, least: int, longest: int, full: Shared | None, frequent: Shared | None):
    """Pass k over (lang, text): counts of phrases of k words, and bucket counters of those of k + 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << width if k < longest else 0, np.int32)
        held: list[pa.Table] = []
        size = 0
        bucket, parts = (Bits(given.value if given else None, width) for given in (full, frequent))
        for batch in slices(batches, "text"):
            text = Text(batch.column(0), batch.column(1))
            at = np.flatnonzero(text.whole(k))
            if k > 1 and len(at):
                sub = np.zeros(len(text.words), bool)
                inner = np.flatnonzero(text.whole(k - 1))
                sub[inner] = parts.has(text.hashes(inner, k - 1))
                at = at[sub[at] & sub[at + 1]]
                at = at[bucket.has(text.hashes(at, k))]
            if len(at):
                held.append(text.counted(at, k))
                size += held[-1].num_rows
                if k < longest:
                    mine = np.zeros(len(text.words) + 1, bool)
                    mine[at] = True
                    longer = np.flatnonzero(text.whole(k + 1))
                    longer = longer[mine[longer] & mine[longer + 1]]
                    np.add.at(counts, (text.hashes(longer, k + 1) >> np.uint64(64 - width)).astype(np.int64), 1)
            if size > 2 * HELD:
                held = [merged(held)]
                size = held[0].num_rows
                if size > HELD:
                    yield from filled(held.pop())
                    size = 0
        if held:
            yield from filled(merged(held))
        yield from chunks(counts, least)

    return run


def merged(held: list[pa.Table]) -> pa.Table:
    whole = pa.concat_tables(held).group_by(["lang", "phrase"], use_threads=False).aggregate([("n", "sum")])
    return whole.rename_columns({"n_sum": "n"}).select(["lang", "phrase", "n"])


def marks(width: int, least: int):
    """Counters that are full where a phrase of (lang, phrase) falls."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << width, np.uint8)
        for batch in batches:
            if batch.num_rows:
                words = [p.split(b" ") for p in batch.column(1).cast(pa.binary()).to_pylist()]
                langs = np.array([digest(v) for v in batch.column(0).cast(pa.binary()).to_pylist()], np.uint64)
                own = [np.array([digest(w[j]) for w in words], np.uint64) for j in range(len(words[0]))]
                counts[(hashed(langs, own) >> np.uint64(64 - width)).astype(np.int64)] = least
        yield from chunks(counts, least)

    return run


def bitmap(rows: DataFrame, width: int, least: int) -> Shared:
    """The broadcast bitmap of the buckets whose counters (chunk, counts) add up to ``least``: 2^(width - 3) bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([np.packbits(total >= least, bitorder="little").tobytes()])], ["chunk", "bits"])

        now, total = None, None
        for batch in batches:
            for chunk, counts in zip(batch.column(0).to_pylist(), batch.column(1)):
                part = np.frombuffer(counts.as_buffer(), np.uint8)
                if chunk != now:
                    if now is not None:
                        yield out()
                    now, total = chunk, part.astype(np.uint16)
                else:
                    np.minimum(total + part, least, out=total)
        if now is not None:
            yield out()

    summed = rows.select("chunk", "counts").repartition("chunk").sortWithinPartitions("chunk").mapInArrow(run, "chunk int, bits binary").toArrow()
    bits = np.zeros(1 << (width - 3), np.uint8)
    for chunk, own in zip(summed.column(0).to_pylist(), summed.column(1).to_pylist()):
        bits[chunk * CHUNK // 8 : chunk * CHUNK // 8 + len(own)] = np.frombuffer(own, np.uint8)
    return Shared(rows.sparkSession, bits)


def frequent_phrases(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, buckets: int | None = None) -> tuple[DataFrame, DataFrame, int]:
    """((lang, phrase, k, f) of all phrases of up to ``longest`` words with f >= ``least``; (lang, n); number of languages) of rows (lang, text)."""
    spark = docs.sparkSession
    if buckets is None:
        size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        buckets = min(MOST_BUCKETS, max(CHUNK, size // 256))
    width = max(16, (buckets - 1).bit_length())
    cap = min(least, 255)  # counters of one byte: with a higher least frequency a bucket counts as full at 255
    levels, totals, languages, full, frequent = [], None, 0, None, None
    for k in range(1, longest + 1):
        seen, n = spool_counted(docs.mapInArrow(passed(k, width, cap, longest, full, frequent), SCHEMA), f"pass{k}", None, phrases=F.col("phrase").isNotNull())
        for given in (full, frequent):
            if given:
                given.unpersist()
        phrases = seen.where("phrase is not null")
        if k == 1:
            totals, found = spool_counted(phrases.groupBy("lang").agg(F.sum("n").alias("n")), "totals")
            languages = found["n"]
        level, found = spool_counted(phrases.groupBy("lang", "phrase").agg(F.sum("n").alias("f")).where(F.col("f") >= least).select("lang", "phrase", F.lit(k).alias("k"), "f"), f"level{k}")
        levels.append(level)
        if not found["n"] or k == longest:
            break
        full = bitmap(seen.where("chunk is not null"), width, cap)
        frequent = bitmap(level.select("lang", "phrase").mapInArrow(marks(width, cap), SCHEMA), width, cap)
    whole = levels[0]
    for level in levels[1:]:
        whole = whole.unionByName(level)
    return whole, totals, languages


def part(words: Column, at: Column, n: Column) -> Column:
    return F.array_join(F.slice(words, at, n), " ")


def collocations(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", least: int = LEAST, longest: int = LONGEST, top: int = TOP, buckets: int | None = None) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of each language's ``top`` collocations."""
    small_batches(docs.sparkSession)
    texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).alias("text"))
    phrases, totals, languages = frequent_phrases(texts, least, longest, buckets)
    candidates = phrases.where("k > 1").select("lang", "phrase", "k", F.col("f").alias("a"), F.split("phrase", " ").alias("words"))

    # The lowest-scoring cut of each candidate.
    cut = F.col("cut")
    cuts = candidates.withColumn("cut", F.explode(F.expr("sequence(1, k - 1)")))
    cuts = cuts.select("lang", "phrase", "a", "cut", part(F.col("words"), F.lit(1), cut).alias("left"), part(F.col("words"), cut + 1, F.col("k") - cut).alias("right"))
    sizes = phrases.select("lang", "phrase", "f")
    cuts = cuts.join(sizes.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l")), ["lang", "left"])
    cuts = cuts.join(sizes.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r")), ["lang", "right"])
    cuts = matching(cuts, totals, "lang", "left", n=languages)
    score = F.expr("(cast(1000 as decimal(4,0)) * cast(a as decimal(15,0)) * cast(n as decimal(18,0))) div (cast(l as decimal(19,0)) * cast(r as decimal(19,0)))")
    best = cuts.withColumn("score", score).groupBy("lang", "phrase").agg(F.first("a").alias("a"), F.first("n").alias("n"), F.min(F.struct("score", "cut", "l", "r")).alias("best"))
    best = best.select("lang", "phrase", "a", "best.l", "best.r", "n", F.col("best.score").alias("score"))

    # A phrase goes if a longer candidate that holds it is as frequent.
    inner = candidates.where("k > 2").withColumn("size", F.explode(F.expr("sequence(2, k - 1)"))).withColumn("at", F.explode(F.expr("sequence(1, k - size + 1)")))
    inner = inner.select("lang", part(F.col("words"), F.col("at"), F.col("size")).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = best.join(inner, ["lang", "phrase"], "left").where("longer is null or longer < a").drop("longer")

    # The first ones of parts of a language, then of those.
    order = [F.col("score").desc(), F.col("a").desc(), "phrase"]
    for keys in (["lang", "part"], ["lang"]):
        kept = kept.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(64))).withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= top)
    return kept.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(load(spark, sf_dir, "documents"))


OP13_SQL = r"""
with d as (
  select coalesce(lang, 'und') as lang,
         unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece
  from documents
), w as (select lang, regexp_extract_all(piece, '[^\x20\x09]+') as ws from d),
t as (select lang, sum(len(ws)) as n from w group by lang),
s as (select lang, ws, unnest([1, 2, 3, 4, 5]) as k from w),
g as (select lang, k, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: array_to_string(ws[i:i+k-1], ' '))) as phrase from s),
f as (select lang, k, phrase, count(*) as a, string_split(phrase, ' ') as ws from g group by lang, k, phrase having count(*) >= 100),
c as (select lang, phrase, k, a, ws, unnest(range(1, k)) as cut from f where k > 1),
x as (
  select c.lang, c.phrase, c.a, c.cut, l.a as l, r.a as r, t.n,
         (1000 * c.a::hugeint * t.n::hugeint) // (l.a::hugeint * r.a::hugeint) as score
  from c join f l on l.lang = c.lang and l.phrase = array_to_string(c.ws[1:c.cut], ' ')
         join f r on r.lang = c.lang and r.phrase = array_to_string(c.ws[c.cut+1:c.k], ' ')
         join t on t.lang = c.lang
  qualify row_number() over (partition by c.lang, c.phrase order by score, c.cut) = 1
), i as (
  select distinct f.lang, array_to_string(f.ws[p:p+z-1], ' ') as phrase, f.a
  from f, (select unnest(range(2, 5)) as z) zs, (select unnest(range(1, 5)) as p) ps
  where f.k > 2 and z < f.k and p + z - 1 <= f.k
)
select lang, row_number() over (partition by lang order by score desc, a desc, phrase) as rank, phrase, a, l, r,
       cast(n as bigint) as n, cast(score as bigint) as score
from x where not exists (select 1 from i where i.lang = x.lang and i.phrase = x.phrase and 100 * i.a >= 100 * x.a)
qualify rank <= 2000
"""
