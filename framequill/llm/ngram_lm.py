"""Trigram language-model scores from a log-frequency Bloom filter.

Counts of word pairs and triples of the training documents are summed per hash, quantised to q(c) = 1 + floor(log2 c),
and stored in a Bloom filter as the members (n-gram, 1) ... (n-gram, q); triples seen once are left out, as is usual for this order
(``least``). A lookup probes levels until one is missing and so tells 2^(q-1) <= c < 2^q. Word counts are exact, from a sorted table.
With u v the words before w, a the lower and A the upper count that the filter tells,

    P1(w)     = (c(w) + 0.1) / (N + 0.1 (V + 1))
    P2(w|v)   = (a(vw) + m2 P1(w)) / (c(v) + F2 + m2)
    P3(w|uv)  = (a(uvw) + m3 P2(w|v)) / (A(uv) + F3 + m3)          if c(uv) may reach ``least``, else P2

F2 and F3 are what false positives are expected to add over the whole vocabulary, with a margin, from the rate at which each
built filter affirms n-grams that are not in it; so the probabilities of all words after a context sum to at most one. m2 and m3 are the pair
with the best leave-one-out likelihood over a share of the training documents, an eighth of them at any size.

The filter is built on the executors in segments of the hash space. How many there are follows from the bytes of training text, and bits per
entry are fixed, so scores do not depend on partitions or size. While filter and word table stay under
``max_bytes`` and ``max_words`` they are broadcast. Beyond, the segments stay a table: each batch of documents asks
the segments for its distinct n-grams through a shuffle, and gets the same answers back. This is done in ``rounds`` of documents, each written
and its shuffles deleted before the next begins, so the disk holds the questions of one round.

Defined results
    null text counts as empty and has one token, its end; equal texts have equal scores; a very long text is hashed in pieces and
    looked up whole; rows that repeat count and are scored as often as they occur; rows without identifier are scored,
    not learned from, and not held out; without training tokens all words are unknown words of an empty corpus;
    an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from framequill.llm.language_id import in_fold
from framequill.llm.words import BASE, mix, slices, text_bytes, word_hashes
from framequill.session import Shared, load, scratch_mark, ship, shuffles_freed, small_batches, spool, sweep, tidy

ship(__name__)

END = np.uint64(0x1B873593CC9E2D51)
START = np.uint64(0x85EBCA6B27D4EB2F)
TRIPLE = np.uint64(0xA0761D6478BD642F)
#: Each member sets so many bits in each of so many 64-bit words.
PLACES, BITS = 2, 3
FLUSH = 1_500_000
ADD = 0.1
STRENGTHS = (1.0, 4.0, 16.0, 64.0, 256.0, 1024.0, 4096.0)
#: Random keys that each segment is asked for, to learn how often it is wrong.
TRIALS = 4096
#: Members that are put into a filter at a time.
STEP = 1 << 17
ONE = np.uint64(1)
DROP = np.uint64(8)  # keys have 56 bits


def token_rows(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens, each text closed by the end token, and where each text begins (one more than texts)."""
    words, begin = word_hashes(*text_bytes(column))
    at = begin[1:] + np.arange(len(begin) - 1)
    tokens = np.empty(len(words) + len(begin) - 1, np.uint64)
    closing = np.zeros(len(tokens), bool)
    closing[at] = True
    tokens[closing] = END
    tokens[~closing] = words
    return tokens, begin + np.arange(len(begin))


def before(values: np.ndarray, begin: np.ndarray, first) -> np.ndarray:
    """The value one token back; ``first`` at the begin of each text."""
    out = np.empty_like(values)
    out[1:] = values[:-1]
    out[begin[:-1]] = first
    return out


def gram_keys(tokens: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of the word, the pair and the triple that end at each token; a text's first token has no triple (key 0)."""
    left = before(tokens, begin, START)
    pairs = mix(left * BASE + tokens)
    triples = mix(before(pairs, begin, START) * BASE + tokens + TRIPLE) >> DROP
    triples[begin[:-1]] = 0
    return tokens >> DROP, pairs >> DROP, triples


def segment_of(keys: np.ndarray, segments: int) -> np.ndarray:
    """Rising with the key, so that sorted keys lie by segment."""
    return (((keys >> np.uint64(24)) * np.uint64(segments)) >> np.uint64(32)).astype(np.int64)


def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and their summed counts."""
    keys, n = np.concatenate([k for k, _ in parts]), np.concatenate([c for _, c in parts])
    order = np.argsort(keys)
    keys, n = keys[order], n[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])[: len(keys)])
    return keys[first], np.add.reduceat(n, first) if len(first) else n


def tight(values: np.ndarray) -> bytes:
    """Bytes of the steps of a rising array, least bytes of all first: zeros of high bytes lie together and compress away."""
    return np.ascontiguousarray(np.diff(values, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T).tobytes()


def loosened(held: bytes) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(np.frombuffer(held, np.uint8).reshape(8, -1).T).view(np.uint64).ravel(), dtype=np.uint64)


def counter(segments: int):
    """Texts to counted n-grams, a row for each order and segment that a part of the input has: (seg, kind, keys, counts)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = ([], [], []), 0

        def flush() -> Iterator[pa.RecordBatch]:
            for kind, parts in enumerate(held):
                keys, n = merged(parts)
                seg = segment_of(keys, segments)
                cuts = [0, *(np.flatnonzero(np.diff(seg)) + 1).tolist(), len(seg)] if len(seg) else []
                spans = list(zip(cuts, cuts[1:]))
                for i in range(0, len(spans), 1024):
                    some = spans[i : i + 1024]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(seg[[a for a, _ in some]].astype(np.int32)), pa.array([kind] * len(some), pa.int32()),
                         pa.array([tight(keys[a:b]) for a, b in some], pa.binary()), pa.array([n[a:b].astype(np.int64).tobytes() for a, b in some], pa.binary())],
                        ["seg", "kind", "keys", "counts"])

        for batch in slices(batches, "text"):
            tokens, begin = token_rows(batch.column(0))
            for parts, keys in zip(held, gram_keys(tokens, begin)):
                own, n = np.unique(keys, return_counts=True)
                if parts is held[2] and len(own) and own[0] == 0:
                    own, n = own[1:], n[1:]
                parts.append((own, n))
                size += len(own)
            if size >= FLUSH:
                yield from flush()
                held, size = ([], [], []), 0
        if size:
            yield from flush()
        held = tokens = keys = own = n = None
        tidy()

    return run


def levels(n: np.ndarray) -> np.ndarray:
    return np.frexp(n.astype(float))[1]


def pattern(keys: np.ndarray, level: int, place: int, size: np.ndarray | int) -> tuple[np.ndarray, np.ndarray]:
    """(word, bits in it) of the members (key, level) for one of PLACES, in filters of ``size`` words."""
    seed = (level * 0xD6E8FEB86659FD93 + place * 0xE7037ED1A0B428DB) & 0xFFFFFFFFFFFFFFFF
    h = mix(keys * BASE + np.uint64(seed))
    bits = np.zeros(len(keys), np.uint64)
    for i in range(BITS):
        bits |= ONE << ((h >> np.uint64(6 * i)) & np.uint64(63))
    return (((h >> np.uint64(32)) * np.asarray(size, np.uint64)) >> np.uint64(32)).astype(np.int64), bits


def filled(keys: np.ndarray, q: np.ndarray, bits_per_entry: float) -> np.ndarray:
    """The filter of members (key, 1) ... (key, q)."""
    words = np.zeros(max(1, int(np.ceil(bits_per_entry * q.sum() / 64))), np.uint64)
    for at in range(0, len(keys), STEP):
        own, most = keys[at : at + STEP], q[at : at + STEP]
        for level in range(1, int(most.max(initial=0)) + 1):
            for place in range(PLACES):
                np.bitwise_or.at(words, *pattern(own[most >= level], level, place, len(words)))
    return words


def probed(keys: np.ndarray, words: np.ndarray, begin: np.ndarray | int = 0, size: np.ndarray | int | None = None) -> np.ndarray:
    """The highest level at which all levels up to it are members; filters of ``size`` words begin at ``begin``."""
    out, todo = np.zeros(len(keys), np.int8), np.arange(len(keys))
    begin, size = np.broadcast_to(begin, len(keys)), np.broadcast_to(len(words) if size is None else size, len(keys))
    for level in range(1, 65):
        for place in range(PLACES):
            at, bits = pattern(keys[todo], level, place, size[todo])
            todo = todo[words[begin[todo] + at] & bits == bits]
        if not len(todo):
            break
        out[todo] = level
    return out


SEGMENT = "seg int, bits binary, words binary, counts binary, entries long, vocabulary long, tokens long, documents long, wrong long"


def builder(bits_per_entry: float, least: int):
    """Rows (seg, kind, keys, counts) sorted by segment to one row per segment: its filter, its words with their counts, its totals."""

    def build(seg: int, parts: tuple[list, ...]) -> pa.RecordBatch:
        def drained(held: list) -> tuple[np.ndarray, np.ndarray]:
            found = merged(held) if held else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            held.clear()  # the next order's arrays come into their place
            return found

        words, pairs, triples = map(drained, parts)
        frequent = triples[1] >= least
        keys = np.concatenate([pairs[0], triples[0][frequent]])
        q = levels(np.concatenate([pairs[1], triples[1][frequent]]))
        bits = filled(keys, q, bits_per_entry)
        tried = mix(np.arange(TRIALS, dtype=np.uint64) + np.uint64(seg) * np.uint64(TRIALS) + BASE)
        return pa.RecordBatch.from_arrays([
            pa.array([seg], pa.int32()), pa.array([bits.tobytes()], pa.binary()), pa.array([words[0].tobytes()], pa.binary()),
            pa.array([words[1].astype(np.int64).tobytes()], pa.binary()), pa.array([int(q.sum())], pa.int64()), pa.array([len(words[0])], pa.int64()),
            pa.array([int(words[1].sum())], pa.int64()), pa.array([int(words[1][words[0] == END >> DROP].sum())], pa.int64()),
            pa.array([int((probed(tried, bits) > 0).sum())], pa.int64()),
        ], [c.split()[0] for c in SEGMENT.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts = None, ([], [], [])
        for batch in batches:
            for i in range(batch.num_rows):  # one row's bytes at a time
                seg, kind, keys, counts = (c[i].as_py() for c in batch.columns)
                if seg != now:
                    if now is not None:
                        yield build(now, parts)
                        tidy()
                    now, parts = seg, ([], [], [])
                parts[kind].append((loosened(keys), np.frombuffer(counts, np.int64)))
        if now is not None:
            yield build(now, parts)
        parts = batch = keys = counts = None
        tidy()

    return run


@dataclass
class Totals:
    """What the formulas need besides looked-up counts."""

    tokens: int
    vocabulary: int
    documents: int
    wrong: float  # how often the filter affirms what is not in it
    segments: int
    least: int = 2
    m2: float = 256.0
    m3: float = 16.0

    def false_counts(self, n: np.ndarray | float) -> np.ndarray | float:
        """Bound on the counts that false positives add over n n-grams: their mean, levels above the first included, and a margin."""
        mean = n * self.wrong / (1 - 2 * min(self.wrong, 0.25))
        return mean + 2 * np.sqrt(mean)

    def logs(self, seen: Lookups, taken: int = 0, m2: float | None = None, m3: float | None = None) -> np.ndarray:
        """log10 P of each token; ``taken`` off all counts of n-grams for leave-one-out."""
        m2, m3 = m2 or self.m2, m3 or self.m3
        p = np.minimum((seen.word + ADD) / (self.tokens + ADD * (self.vocabulary + 1)), 1.0)
        lower = lambda q: np.maximum(np.where(q > 0, np.exp2(q - 1.0), 0.0) - taken, 0)
        pair = np.minimum(lower(seen.pair), np.minimum(seen.word, seen.left))
        p = (pair + m2 * p) / (np.maximum(seen.left - taken, 0) + self.false_counts(float(self.vocabulary)) + m2)
        known = seen.context >= self.least.bit_length()  # a rarer pair begins no triple of the filter
        follow = np.minimum(seen.left, float(self.vocabulary)) + self.false_counts(float(self.vocabulary))
        whole = np.where(known, np.maximum(np.exp2(seen.context.astype(float)) - 1 - taken, 0) + self.false_counts(follow), 0.0)
        triple = np.where(known & (seen.pair > 0), np.minimum(lower(seen.triple), np.exp2(seen.context.astype(float)) - 1), 0.0)
        return np.log10(np.where(known, (triple + m3 * p) / (whole + m3), p))


@dataclass
class Lookups:
    word: np.ndarray  # exact count of each token
    left: np.ndarray  # exact count of the one before
    pair: np.ndarray  # levels
    context: np.ndarray
    triple: np.ndarray


def looked_up(held: Held | Answers, documents: int, tokens: np.ndarray, begin: np.ndarray) -> Lookups:
    words, pairs, triples = gram_keys(tokens, begin)
    each = lambda keys, f: (lambda distinct, inverse: f(distinct)[inverse])(*np.unique(keys, return_inverse=True))
    word, pair = each(words, held.counted), each(pairs, held.level)
    context = before(pair, begin, 0)
    triple, worth = np.zeros(len(tokens), np.int8), (pair > 0) & (context > 0) & (triples != 0)
    triple[worth] = each(triples[worth], held.level)
    return Lookups(word, before(word, begin, documents), pair, context, triple)


@dataclass
class Held:
    """The filter and word table of segments that follow each other: of all, as broadcast, or of one bucket."""

    bits: np.ndarray
    begin: np.ndarray  # first word of each segment
    size: np.ndarray  # words of each segment
    keys: np.ndarray
    counts: np.ndarray
    segments: int  # of all
    first: int = 0

    def counted(self, keys: np.ndarray) -> np.ndarray:
        return found(self.keys, self.counts, keys)

    def level(self, keys: np.ndarray) -> np.ndarray:
        seg = segment_of(keys, self.segments) - self.first
        out, there = np.zeros(len(keys), np.int8), self.size[seg] > 0
        out[there] = probed(keys[there], self.bits, self.begin[seg[there]], self.size[seg[there]])
        return out


@dataclass
class Answers:
    """Looked-up values of the keys of one batch of documents."""

    keys: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    counts: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    grams: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    levels: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int8))

    def counted(self, keys: np.ndarray) -> np.ndarray:
        return found(self.keys, self.counts, keys)

    def level(self, keys: np.ndarray) -> np.ndarray:
        return found(self.grams, self.levels, keys)


def found(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Values of sorted keys, 0 where there is none."""
    if not len(keys):
        return np.zeros(len(wanted), values.dtype)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], 0)


def build(docs: DataFrame, bits_per_entry: float = 10.0, least: int = 2, segment_bytes: int = 8 << 20) -> tuple[DataFrame, Totals]:
    """The segments as a spooled table, and the totals; a segment for each ``segment_bytes`` of training text."""
    total = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    segments = max(1, -(-total // segment_bytes))
    counted = docs.select("text").mapInArrow(counter(segments), "seg int, kind int, keys binary, counts binary")
    table = spool(counted.repartition("seg").sortWithinPartitions("seg", "kind").mapInArrow(builder(bits_per_entry, least), SEGMENT), "segments")
    vocabulary, tokens, documents, wrong, n = table.agg(F.sum("vocabulary"), F.sum("tokens"), F.sum("documents"), F.sum("wrong"), F.count("seg")).first()
    return table, Totals(tokens or 0, vocabulary or 0, documents or 0, ((wrong or 0) + 1) / (n * TRIALS + 1) if n else 0.0, segments, least)


def gathered(table: DataFrame, totals: Totals) -> Held:
    """All segments on the driver, for a broadcast; the caller has checked their size. Segments follow each other by key, so their words do."""
    sizes = np.zeros((2, totals.segments + 1), np.int64)
    for seg, *n in table.select("seg", F.octet_length("bits") / 8, "vocabulary").collect():
        sizes[:, seg + 1] = n
    word, entry = np.cumsum(sizes, axis=1)
    bits, keys = np.empty(word[-1], np.uint64), np.empty(totals.vocabulary, np.uint64)
    counts = np.empty(totals.vocabulary, np.int32 if totals.tokens < 1 << 31 else np.int64)
    for row in table.select("seg", "bits", "words", "counts").toLocalIterator():
        at = row["seg"]
        bits[word[at] : word[at + 1]] = np.frombuffer(row["bits"], np.uint64)
        keys[entry[at] : entry[at + 1]], counts[entry[at] : entry[at + 1]] = np.frombuffer(row["words"], np.uint64), np.frombuffer(row["counts"], np.int64)
    return Held(bits, word[:-1], np.diff(word), keys, counts, totals.segments)


def spread(keys: np.ndarray, cuts: np.ndarray, unit: int = 8) -> pa.Array:
    """The parts of an array between cuts as a column of bytes, without a step for each."""
    return pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer((cuts * unit).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(keys))])


def flat(column: pa.Array, kind) -> tuple[np.ndarray, np.ndarray]:
    """The values of a column of bytes one after another, and where those of each row begin (one more than rows)."""
    size = np.dtype(kind).itemsize
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1] // size
    values = np.frombuffer(column.buffers()[2], kind) if column.buffers()[2] is not None else np.zeros(0, kind)
    return values[offsets[0] : offsets[-1]], offsets - offsets[0]


def distinct(tokens: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct words and n-grams of a batch: what it asks for, and in which order it is answered."""
    def once(keys: np.ndarray) -> np.ndarray:  # np.unique hashes where it is not asked for counts, and takes ten times as long
        keys = np.sort(keys)
        return keys[np.append(True, keys[1:] != keys[:-1])[: len(keys)]]

    words, pairs, triples = gram_keys(tokens, begin)
    return once(words), once(np.concatenate([pairs, triples[triples != 0]]))


ASK = "bucket int, kind int, seg int, batch long, a binary, b binary, c binary"
#: Answers come without the keys, in their order.
TOLD = "batch long, bucket int, counts binary, levels binary"


def asked(per: int, segments: int):
    """Bundles (batch, texts) to questions: a row for each bucket that a batch has keys of, some thousand to a record batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                words, grams = distinct(*token_rows(batch.column(1).slice(i, 1).flatten()))
                own = [segment_of(p, segments) // per for p in (words, grams)]
                buckets = np.union1d(*own)
                cuts = [np.append(np.searchsorted(o, buckets), len(o)) for o in own]
                for at in range(0, len(buckets), 4096):
                    to = min(at + 4096, len(buckets))
                    columns = [spread(p[c[at] : c[to]], c[at : to + 1] - c[at]) for p, c in zip((words, grams), cuts)]
                    n, whole = to - at, lambda v, t: pa.array(np.full(to - at, v), t)  # noqa: B023, E731
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(buckets[at:to], pa.int32()), whole(1, pa.int32()), whole(0, pa.int32()), whole(batch.column(0)[i].as_py(), pa.int64()), *columns, pa.nulls(n, pa.binary())],
                        [c.split()[0] for c in ASK.split(", ")])
        tidy()

    return run


def told(per: int, segments: int):
    """Rows of ASK sorted by bucket, kind and segment, a bucket's segments before the questions to them, which stream past."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts, held = None, [], None
        for batch in batches:
            head = np.asarray(batch.column(0)).astype(np.int64) * 2 + np.asarray(batch.column(1))
            cuts = [0, *(np.flatnonzero(np.diff(head)) + 1).tolist(), len(head)] if len(head) else []
            for a, b in zip(cuts, cuts[1:]):
                rows, bucket, kind = batch.slice(a, b - a), int(head[a] // 2), int(head[a] % 2)
                if bucket != now:
                    now, parts, held = bucket, [], None
                if kind == 0:
                    parts += zip(rows.column(2).to_pylist(), *(rows.column(j).to_pylist() for j in (4, 5, 6)))
                    continue
                if held is None:
                    held, parts = gathered_bucket(parts, bucket * per, per, segments), []
                (words, w), (grams, g) = flat(rows.column(4), np.uint64), flat(rows.column(5), np.uint64)
                yield pa.RecordBatch.from_arrays(
                    [rows.column(3), rows.column(0), spread(held.counted(words).astype(np.int64), w), spread(held.level(grams), g, 1)],
                    [c.split()[0] for c in TOLD.split(", ")])
        held = parts = None
        tidy()

    return run


def gathered_bucket(parts: list[tuple], first: int, per: int, segments: int) -> Held:
    """The segments (seg, bits, words, counts) of a bucket, some of which may be missing, as one."""
    size = np.zeros(per, np.int64)
    for seg, bits, *_ in parts:
        size[seg - first] = len(bits) // 8
    whole = lambda j, kind: np.concatenate([np.frombuffer(p[j], kind) for p in parts]) if parts else np.zeros(0, kind)
    return Held(whole(1, np.uint64), np.cumsum(size) - size, size, whole(2, np.uint64), whole(3, np.int64), segments, first)


def answered(rows: DataFrame, table: DataFrame, totals: Totals, result: Callable, schema: str, size: int = 0, bucket_bytes: int = 64 << 20, rounds: int = 6) -> DataFrame:
    """``result(looked up, tokens, begin, numbers, identifiers)`` for each batch of (nth, doc_id, text), looked up bucket by bucket.

    Batches of texts are written as rows; each asks every bucket for its distinct keys of that bucket, once. A bucket is a run of segments
    of about ``bucket_bytes`` at most (all have ``size``), and there are no more buckets than shuffle partitions as long as that holds; a
    task holds one bucket, and questions stream past it. Questions take several times the space of the texts, so the batches are dealt to
    ``rounds``, and the results of each are written.
    """
    segments, documents = totals.segments, totals.documents
    spark = rows.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    each = max(1, (size + 16 * totals.vocabulary) // segments)
    per = max(1, min(-(-segments // partitions), bucket_bytes // each))
    mark = scratch_mark()

    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            ends = pa.array([0, batch.num_rows], pa.int32())
            lists = [pa.ListArray.from_arrays(ends, c) for c in batch.columns]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(0, 1), *lists], ["batch", "nths", "ids", "texts"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    bundles = spool(rows.mapInArrow(bundle, f"batch long, nths array<long>, ids array<{kind}>, texts array<string>"), "bundles")
    parts = table.select(F.expr(f"cast(seg div {per} as int)").alias("bucket"), F.lit(0).alias("kind"), "seg", F.lit(None).cast("long").alias("batch"), F.col("bits").alias("a"), F.col("words").alias("b"), F.col("counts").alias("c"))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                told = sorted(batch.column(3).slice(i, 1).to_pylist()[0], key=lambda t: t["bucket"])  # as keys rise
                counts, levels = (np.concatenate([np.frombuffer(t[k], kind) for t in told]) for k, kind in (("counts", np.int64), ("levels", np.int8)))
                numbers, ids, texts = (batch.column(j).slice(i, 1).flatten() for j in range(3))
                tokens, begin = token_rows(texts)
                words, grams = distinct(tokens, begin)
                yield result(looked_up(Answers(words, counts, grams, levels), documents, tokens, begin), tokens, begin, numbers, ids)

    found = []
    for nth in range(rounds):
        own = bundles.where(F.pmod(F.xxhash64("batch"), F.lit(rounds)) == nth)
        asks = own.select("batch", "texts").mapInArrow(asked(per, segments), ASK)
        answers = parts.unionByName(asks).repartition("bucket").sortWithinPartitions("bucket", "kind", "seg").mapInArrow(told(per, segments), TOLD)
        joined = own.join(answers.groupBy("batch").agg(F.collect_list(F.struct("bucket", "counts", "levels")).alias("told")), "batch")
        found.append(spool(joined.select("nths", "ids", "texts", "told").mapInArrow(finish, schema), "results"))
    sweep(spark, mark, keep=rounds)
    return reduce(DataFrame.unionByName, found)


def score_text(
    docs: DataFrame, learn, id_col: str = "doc_id", text_col: str = "text", bits_per_entry: float = 10.0, least: int = 2,
    segment_bytes: int = 8 << 20, max_bytes: int = 256 << 20, max_words: int = 12_000_000, share: int = 8, bucket_bytes: int = 64 << 20, rounds: int = 6,
) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) of each row; ``learn`` says which rows are learned from."""
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    training = docs.where(learn)
    with shuffles_freed(spark):
        mark = scratch_mark()
        table, totals = build(training, bits_per_entry, least, segment_bytes)
        size = table.agg(F.sum(F.octet_length("bits").cast("long"))).first()[0] or 0
        broadcast = size <= max_bytes and totals.vocabulary <= max_words
        given = Shared(spark, gathered(table, totals)) if broadcast else None
        if broadcast:
            sweep(spark, mark)
        tidy()
        kind = docs.schema["doc_id"].dataType.simpleString()

        def over(rows: DataFrame, result: Callable, schema: str, rounds: int = rounds) -> DataFrame:
            rows = rows.select(F.monotonically_increasing_id().alias("nth"), "doc_id", "text")
            if not broadcast:
                return answered(rows, table, totals, result, schema, size, bucket_bytes, rounds)
            documents = totals.documents

            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for batch in slices(batches, "text", 1 << 19):
                    tokens, begin = token_rows(batch.column(2))
                    out = result(looked_up(given.value, documents, tokens, begin), tokens, begin, batch.column(0), batch.column(1))
                    batch = tokens = begin = None  # not held while the next batch comes in
                    yield out
                    tidy()
                out = None
                tidy()

            return rows.mapInArrow(run, schema)

        def likelihoods(seen: Lookups, tokens: np.ndarray, begin: np.ndarray, *_) -> pa.RecordBatch:
            sums = [float(totals.logs(seen, 1, m2, m3).sum()) for m2 in STRENGTHS for m3 in STRENGTHS]
            return pa.RecordBatch.from_arrays([pa.array([sums])], ["sums"])

        sums = over(training.where(F.pmod(F.xxhash64("doc_id", F.lit(13)), F.lit(share)) == 0), likelihoods, "sums array<double>", -(-rounds // share))
        tried = sums.agg(*[F.sum(F.get("sums", F.lit(i))) for i in range(len(STRENGTHS) ** 2)]).first()
        if totals.tokens and tried[0] is not None:
            best = int(np.argmax(tried))
            totals.m2, totals.m3 = STRENGTHS[best // len(STRENGTHS)], STRENGTHS[best % len(STRENGTHS)]
        whole = totals.tokens + ADD * (totals.vocabulary + 1)

        def scores(seen: Lookups, tokens: np.ndarray, begin: np.ndarray, numbers: pa.Array, ids: pa.Array) -> pa.RecordBatch:
            columns = [np.add.reduceat(x, begin[:-1]) if len(tokens) else np.zeros(0) for x in (
                (seen.word > 0).astype(np.int64), np.log10((seen.word + ADD) / whole), totals.logs(seen))]
            return pa.RecordBatch.from_arrays([ids, pa.array(np.diff(begin)), *map(pa.array, columns)], ["doc_id", "n_tokens", "n_known", "base_score", "score"])

        scored = over(docs, scores, f"doc_id {kind}, n_tokens long, n_known long, base_score double, score double")
        if not broadcast:
            sweep(spark, mark, keep=rounds)
        return scored.select("doc_id", "n_tokens", "n_known", F.lit(totals.tokens).cast("long").alias("train_tokens"), "base_score", "score")


def op6_bloom_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.coalesce(in_fold("doc_id", 10) == 0, F.lit(False))
    scored = score_text(load(spark, sf_dir, "documents"), in_fold("doc_id", 10) != 0)
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
