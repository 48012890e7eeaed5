"""Repeated passages by content-defined chunking with a gear rolling hash.

A text is cut after words at which the gear hash of the last 32 bytes falls under a limit, every five to six words on average, and
every ``MOST`` words where the hash finds no cut. As the hash sees nothing else, cuts come back in step right after an insertion,
and a passage that two texts share has the same chunks in both. Chunks are deduplicated by digest: of a digest that
occurs in several documents, the one in the document with the smallest identifier stays. Neighbouring chunks of a
document that point to one other document seed a passage; seeds with eight words or more are looked up in that
document's text and extended byte by byte in both directions, so a passage found so is an exact and maximal match in whole words of both texts.

The earliest document with a chunk may have less of a passage than a later one. Runs of repeated chunks
that could hold more than ``words`` words are therefore looked at once more: every window of ``words + 1`` words in
them that is not whole in a passage found so, and those in the runs of other documents with the same chunks, is digested, and of equal windows
the earliest document's stays; such passages are equal in words, may differ in white space and may overlap those found first.
So the passages cover every word of a document that is in more than ``words`` words of an earlier one, but for passages without a whole chunk.

Defined results
    null and empty texts have no passage; rows without identifier neither match nor are reported; rows that repeat an
    identifier count as one document, whose passages are those of its texts together; repeats within one document are no match;
    a very long text is cut and compared whole, alone in its batch; an empty table gives an empty result; further columns are ignored.

How likely a passage of exactly 51 words has no whole chunk, and so is not looked at, was estimated at 0.05 to 0.1 %; longer ones have more chunks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from framequill.llm.near_dedup import matching
from framequill.llm.words import BASE, SPACES, mix, powers, slices, text_bytes
from framequill.session import load, ship, small_batches, spool

ship(__name__)

WINDOW = 32
MEAN = 5.5
MOST = 24
SEED = 8
#: Most words before or after a chunk that are told.
NEAR = (1 << 12) - 1
GEAR = np.random.default_rng(32).integers(0, 1 << 32, 256, dtype=np.uint64).astype(np.uint32)
RAW = np.random.default_rng(33).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
IS_SPACE = np.isin(np.arange(256), SPACES)


def gear(data: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Gear hash of the last 32 bytes up to each byte, by doubling; ``place`` is each byte's distance from its text's begin."""
    h = GEAR[data]
    step = 1
    while step < WINDOW:
        back = np.zeros_like(h)
        back[step:] = h[:-step] << np.uint32(step)
        back[place < step] = 0
        h = h + back
        step *= 2
    return h


def chunks(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """(text, start, end, words, digest, before, after) of each chunk; starts and ends are bytes from the text's begin, at words.

    ``before`` and ``after`` are the most words that a passage can have outside a run of chunks it shares which begins or ends with this one:
    cuts more than a window after its begin are its own, so it begins less than a window before the second cut back from the run.
    """
    empty = np.zeros(0, np.int64)
    if not len(data):
        return empty, empty, empty, empty, np.zeros(0, np.uint64), empty, empty
    place = np.arange(len(data)) - np.repeat(offsets[:-1], np.diff(offsets))
    black = ~IS_SPACE[data]
    bound = np.zeros(len(data) + 1, bool)
    bound[offsets] = True
    first = black.copy()
    first[1:] &= ~black[:-1] | bound[1:-1]
    last = black.copy()
    last[:-1] &= ~black[1:] | bound[1:-1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    if not len(starts):
        return empty, empty, empty, empty, np.zeros(0, np.uint64), empty, empty
    owner = np.searchsorted(offsets, starts, side="right") - 1
    natural = gear(data, place)[ends - 1] < np.uint32((1 << 32) / MEAN)
    natural[:-1] |= owner[1:] != owner[:-1]
    natural[-1] = True
    # Runs without a cut are cut every MOST words, counted from the last natural cut.
    begin = np.append(True, natural[:-1])
    nth = np.arange(len(starts)) - np.maximum.accumulate(np.where(begin, np.arange(len(starts)), 0))
    opens = np.flatnonzero(begin | (nth % MOST == 0))
    words = np.diff(np.append(opens, len(starts)))
    a, b = starts[opens], ends[opens + words - 1]
    values = RAW[data]
    where = np.arange(len(data))
    which = np.searchsorted(a, where, side="right") - 1
    inside = (which >= 0) & (where < b[which])
    weights = powers(int((b - a).max()))
    values = np.where(inside, values * weights[np.where(inside, where - a[which], 0)], 0)
    digest = mix(np.add.reduceat(values, a) + (b - a).astype(np.uint64) * BASE)
    text = owner[opens]
    segments = np.flatnonzero(begin)  # natural ones, by first word
    own = np.searchsorted(segments, opens, side="right") - 1
    previous = segments[np.maximum(own - 1, 0)]
    reach = np.maximum(np.searchsorted(ends, starts[previous] - WINDOW), np.searchsorted(starts, offsets[text]))
    before = np.where((own > 0) & (owner[previous] == text), opens - reach, opens - np.searchsorted(starts, offsets[text]))
    after = np.append(np.where(text[1:] == text[:-1], words[1:], 0), 0)
    return text, a - offsets[text], b - offsets[text], words, digest, before, after


def chunk_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(digest, id, at, near): start and bytes of a chunk in 32 and 31 bits; its words in 8, before and after in 12 each, its number in the text in 31."""
    for batch in slices(batches, "text"):
        text, start, end, words, digest, before, after = chunks(*text_bytes(batch.column(1)))
        at = (start << 31) | np.minimum(end - start, (1 << 31) - 1)
        nth = np.arange(len(text)) - np.searchsorted(text, text)
        near = (words << 55) | (np.minimum(before, NEAR) << 43) | (np.minimum(after, NEAR) << 31) | nth
        for a in range(0, len(text), 50_000):
            own = slice(a, a + 50_000)
            yield pa.RecordBatch.from_arrays([pa.array(digest[own].view(np.int64)), batch.column(0).take(pa.array(text[own])), pa.array(at[own]), pa.array(near[own])], ["digest", "id", "at", "near"])


def grown(base: np.ndarray, text: np.ndarray, pos: int, start: int, size: int) -> tuple[int, int]:
    """The largest (start, end) in ``text`` around a match of ``size`` bytes at ``pos`` in ``base``, in whole words of both."""
    a, b, end, stop = start, pos, start + size, pos + size
    while a > 0 and b > 0:
        n = min(a, b, 4096)
        off = np.flatnonzero(text[a - n : a] != base[b - n : b])
        n = n - 1 - int(off[-1]) if len(off) else n
        a, b = a - n, b - n
        if len(off):
            break
    while end < len(text) and stop < len(base):
        n = min(len(text) - end, len(base) - stop, 4096)
        off = np.flatnonzero(text[end : end + n] != base[stop : stop + n])
        n = int(off[0]) if len(off) else n
        end, stop = end + n, stop + n
        if len(off):
            break
    open_ = lambda x, i: i <= 0 or i >= len(x) or IS_SPACE[x[i]]
    if not (open_(text, a - 1) and open_(base, b - 1)):
        while a < start and not IS_SPACE[text[a]]:
            a += 1
    if not (open_(text, end) and open_(base, stop)):
        while end > start + size and not IS_SPACE[text[end - 1]]:
            end -= 1
    while a < start and IS_SPACE[text[a]]:
        a += 1
    while end > start + size and IS_SPACE[text[end - 1]]:
        end -= 1
    return a, end


def extender(words: int):
    """Rows sorted by (hub, part, role, node): a hub's text (role 0), then texts with their seeds in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, bases = None, []
        for batch in slices(batches, "text"):
            out: list[tuple] = []
            data, offsets = text_bytes(batch.column(4))
            for i, (h, role, node, seeds) in enumerate(zip(*(batch.column(j).to_pylist() for j in range(4)))):
                text = data[offsets[i] : offsets[i + 1]]
                if role == 0:  # each text of a repeated identifier
                    bases = [*(bases if hub == h else []), text.tobytes()]
                    hub = h
                    continue
                done: list[tuple[int, int]] = []
                whole = text.tobytes()
                for seed in sorted(seeds) if hub == h else []:
                    start, size = seed >> 31, seed & ((1 << 31) - 1)
                    if start + size > len(whole) or any(a <= start and start + size <= b for a, b in done):
                        continue  # a seed of another text of the identifier, or found already
                    for base in bases:
                        seed_bytes, pos, upto = whole[start : start + size], -1, 0
                        while (pos := base.find(seed_bytes, pos + 1)) >= 0:
                            if pos >= upto:  # else it lies in the match just grown
                                done.append(span := grown(np.frombuffer(base, np.uint8), text, pos, start, size))
                                upto = pos + span[1] - start
                spans: list[list[int]] = []
                for a, b in sorted(done):
                    piece = whole[a:b].split()
                    if len(piece) > words:
                        if spans and a <= spans[-1][1]:
                            spans[-1][1] = max(b, spans[-1][1])
                        else:
                            spans.append([a, b])
                for a, b in spans:
                    piece = whole[a:b].decode("utf-8", "replace")
                    out.append((node, h, len(whole[:a].decode("utf-8", "replace")), len(piece), len(whole[a:b].split()), a, b))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out) if out else [()] * 7)], ["id", "keep_id", "start", "length", "words", "byte_start", "byte_end"])

    return run


def windower(words: int, side: bool):
    """(id, regions, text, spans) to the windows of ``words`` words in the regions (a, b, before, after), bytes with words to either side.

    Windows that lie whole in one of the spans (byte_start, byte_end) are left out. A side's windows need no places.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            data, offsets = text_bytes(batch.column(2))
            black = ~IS_SPACE[data]
            bound = np.zeros(len(data) + 1, bool)
            bound[offsets] = True
            first, last = black.copy(), black.copy()
            first[1:] &= ~black[:-1] | bound[1:-1]
            last[:-1] &= ~black[1:] | bound[1:-1]
            starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
            begin = np.searchsorted(starts, offsets)
            picks = []
            for i, (regions, spans) in enumerate(zip(batch.column(1).to_pylist(), batch.column(3).to_pylist())):
                picked = [np.zeros(0, np.int64)]
                for region in regions:
                    a = np.searchsorted(starts, offsets[i] + region["a"]) - region["before"]
                    b = np.searchsorted(ends, offsets[i] + region["b"], side="right") + region["after"]
                    picked.append(np.arange(max(a, begin[i]), min(b, begin[i + 1]) - words + 1))
                own = np.unique(np.concatenate(picked))
                if spans and len(own):
                    spans = np.array(sorted((s["byte_start"], s["byte_end"]) for s in spans)) + offsets[i]
                    upto = np.append(-1, np.maximum.accumulate(spans[:, 1]))
                    own = own[ends[own + words - 1] > upto[np.searchsorted(spans[:, 0], starts[own], side="right")]]
                picks.append(own)
            own = np.concatenate([np.zeros(0, np.int64), *picks])
            if not len(own):
                continue
            weights = powers(int((ends - starts).max()))
            place = np.where(black, np.arange(len(data)) - np.repeat(np.append(0, starts), np.diff(np.concatenate([[0], starts, [len(data)]]))), 0)
            hashes = mix(np.add.reduceat(np.where(black, RAW[data] * weights[place], 0), starts))
            digest = np.zeros(len(own), np.uint64)
            for j, w in enumerate(powers(words)):
                digest += hashes[own + j] * w
            text = np.repeat(np.arange(len(picks)), [len(x) for x in picks])
            columns = [pa.array(mix(digest).view(np.int64)), batch.column(0).take(pa.array(text))]
            if not side:
                heads = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
                at, upto = starts[own], ends[own + words - 1]
                columns += map(pa.array, (own - begin[text], heads[at] - heads[offsets[text]], heads[upto] - heads[offsets[text]], at - offsets[text], upto - offsets[text]))
            for k in range(0, len(own), 50_000):
                yield pa.RecordBatch.from_arrays([c.slice(k, 50_000) for c in columns], ["digest", "id", *([] if side else ["nth", "a", "b", "at", "upto"])])

    return run


def placed(matched: DataFrame) -> DataFrame:
    """Chunks with start and size in bytes."""
    return matched.withColumn("start", F.shiftright("at", 31)).withColumn("size", F.col("at").bitwiseAND((1 << 31) - 1))


def number(chunk: Column) -> Column:
    return chunk.bitwiseAND((1 << 31) - 1)


def candidate_runs(chunk: DataFrame, words: int) -> DataFrame:
    """(id, a, b, before, after) of runs of chunks (id, at, near) that a passage of more than ``words`` words can hold."""
    along = Window.partitionBy("id").orderBy("at")
    opens = F.coalesce(number(F.col("near")) - F.lag(number(F.col("near"))).over(along) != 1, F.lit(True))
    runs = (placed(chunk).withColumn("run", F.sum(opens.cast("int")).over(along)).groupBy("id", "run").agg(
        F.sum(F.shiftright("near", 55)).alias("words"), F.min(F.struct("at", "near")).alias("first"), F.max(F.struct("at", "near")).alias("last"),
        F.min("start").alias("a"), F.max(F.col("start") + F.col("size")).alias("b")))
    reach = runs.withColumn("before", F.shiftright("first.near", 43).bitwiseAND(NEAR)).withColumn("after", F.shiftright("last.near", 31).bitwiseAND(NEAR))
    return reach.where(F.col("words") + F.col("before") + F.col("after") > words).select("id", "a", "b", "before", "after")


def regions(runs: DataFrame) -> DataFrame:
    return runs.groupBy("id").agg(F.collect_list(F.struct("a", "b", "before", "after")).alias("regions"))


def missed(docs: DataFrame, matched: DataFrame, found: DataFrame, words: int) -> DataFrame:
    """(id, keep_id, start, length, words) of passages outside the byte spans of ``found``, from repeated chunks (id, digest, keeper, at, near).

    What an earlier document has too is made of chunks with an earlier keeper, so only runs of such chunks ask; documents that share
    chunks with what they ask for answer.
    """
    spans_type = "array<struct<byte_start: bigint, byte_end: bigint>>"
    one = docs.groupBy("id").agg(F.count(F.lit(1)).alias("texts")).where("texts = 1").select("id")  # else spans do not say of which text
    spans = spool(found.join(one, "id", "left_semi").groupBy("id").agg(F.collect_list(F.struct("byte_start", "byte_end")).alias("spans")), "spans")
    wanted = spool(regions(candidate_runs(matched.where("id > keeper").select("id", "at", "near"), words)).join(spans, "id", "left"), "wanted")
    texts = matching(docs, spool(wanted.select("id"), "nodes"), "id", "left_semi").join(wanted, "id").select("id", "regions", "text", "spans")
    asks = spool(texts.mapInArrow(windower(words + 1, False), "digest long, id long, nth long, a long, b long, at long, upto long"), "asks")
    along = Window.partitionBy("id").orderBy("at")
    parts = asks.select("id", "at", "upto").withColumn("part", F.sum(F.coalesce((F.col("at") > F.lag("upto").over(along)).cast("int"), F.lit(0))).over(along))
    open_ = spool(parts.groupBy("id", "part").agg(F.min("at").alias("a"), F.max("upto").alias("b")).drop("part"), "open")
    inside = (F.col("start") >= F.col("a")) & (F.col("start") < F.col("b"))
    shared = spool(matching(placed(matched.where("id > keeper")).select("id", "digest", "start"), open_, "id").where(inside).select("digest").distinct(), "shared")
    sides = spool(regions(candidate_runs(matching(matched, shared, "digest", "left_semi").select("id", "at", "near"), words)), "sides")
    texts = matching(docs, spool(sides.select("id"), "nodes"), "id", "left_semi").join(sides, "id").select("id", "regions", "text", F.lit(None).cast(spans_type).alias("spans"))
    firsts = texts.mapInArrow(windower(words + 1, True), "digest long, id long").groupBy("digest").agg(F.min("id").alias("keep_id"))
    along = Window.partitionBy("id", "keep_id").orderBy("nth")
    hits = spool(firsts.join(asks.select("digest", "id", "nth", "a", "b"), "digest").where("keep_id < id").drop("digest"), "hits")
    hits = hits.withColumn("run", F.sum(F.coalesce((F.col("nth") - F.lag("nth").over(along) > 1).cast("int"), F.lit(1))).over(along))
    return hits.groupBy("id", "keep_id", "run").agg(F.min("a").alias("start"), (F.max("b") - F.min("a")).alias("length"), (F.max("nth") - F.min("nth") + words + 1).alias("words")).drop("run")


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 50, chunk: int = 48) -> DataFrame:
    """(id, keep_id, start, length, words): passages of ``id`` that the earlier document ``keep_id`` has too.

    ``start`` and ``length`` are code points.
    """
    if not 0 < words < NEAR:
        raise ValueError(f"words must lie below {NEAR}")
    small_batches(docs.sparkSession)
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("id is not null")
    rows = docs.mapInArrow(chunk_rows, "digest long, id long, at long, near long")
    firsts = rows.groupBy("digest").agg(F.min("id").alias("keeper"), F.max("id").alias("other")).where("keeper < other").select("digest", "keeper")
    matched = spool(rows.join(firsts, "digest").select("id", "digest", "keeper", "at", "near"), "matched")
    along = Window.partitionBy("id", "keeper").orderBy("at")
    gap = number(F.col("near")) - F.lag(number(F.col("near"))).over(along)
    runs = (placed(matched.where("id > keeper")).withColumn("words", F.shiftright("near", 55)).withColumn("run", F.sum(F.coalesce((gap != 1).cast("int"), F.lit(1))).over(along))
            .groupBy("id", "keeper", "run").agg(F.sum("words").alias("words"), F.max(F.struct("size", "at")).alias("longest")).where(F.col("words") >= SEED))
    seeds = spool(runs.groupBy("id", "keeper").agg(F.collect_list("longest.at").alias("seeds")), "seeds")
    counts = spool(seeds.groupBy("keeper").agg(F.count(F.lit(1)).alias("m")), "counts")
    asks = seeds.join(counts, "keeper").select(
        F.col("keeper").alias("hub"), F.pmod(F.xxhash64("id"), F.ceil(F.col("m") / chunk)).cast("long").alias("part"), F.lit(1).alias("role"), F.col("id").alias("node"), "seeds")
    asks = spool(asks.unionByName(asks.select("hub", "part").distinct().select(
        "hub", "part", F.lit(0).alias("role"), F.col("hub").alias("node"), F.array().cast("array<long>").alias("seeds"))), "asks")
    nodes = spool(asks.select("node").distinct(), "nodes")
    texts = matching(docs.withColumnRenamed("id", "node"), nodes, "node", "left_semi").join(asks, "node")
    dealt = texts.repartition("hub", "part").sortWithinPartitions("hub", "part", "role", "node").select("hub", "role", "node", "seeds", "text")
    found = spool(dealt.mapInArrow(extender(words), "id long, keep_id long, start long, length long, words long, byte_start long, byte_end long"), "found")
    return found.drop("byte_start", "byte_end").unionByName(missed(docs, matched, found, words))


def without_repeats(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the passages of ``found`` cut out of their texts."""
    spans = found.groupBy("id").agg(F.sort_array(F.collect_set(F.struct("start", "length"))).alias("__spans")).withColumnRenamed("id", "__id")
    begin = F.struct(F.lit("").alias("kept"), F.lit(0).cast("long").alias("upto"))
    text = F.col(f"`{text_col}`")

    def cut(state, span):
        piece = F.when(span["start"] > state["upto"], F.substring(text, (state["upto"] + 1).cast("int"), (span["start"] - state["upto"]).cast("int"))).otherwise(F.lit(""))
        return F.struct(F.concat(state["kept"], piece).alias("kept"), F.greatest(state["upto"], span["start"] + span["length"]).alias("upto"))

    rest = F.aggregate("__spans", begin, cut, lambda s: F.concat(s["kept"], F.substring(text, (s["upto"] + 1).cast("int"), F.char_length(text))))
    joined = docs.join(spans, docs[id_col] == spans["__id"], "left")
    return joined.withColumn(text_col, F.when(F.col("__spans").isNull(), text).otherwise(rest)).select(docs.columns)


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats(load(spark, sf_dir, "documents")).select(
        F.col("id").alias("doc_id"), F.col("keep_id").alias("keep_doc_id"), "start", "length", "words")
