"""Near-duplicate components by SimHash, found through fuzzy keys of the perfect Golay code.

1. A text's fingerprint has a bit set where over half of the hashes of its four-word shingles have it, repeats included.
   Equal fingerprints form a class, and each class goes on once, so copies never meet.
2. A fingerprint is cut into three segments of at most 23 bits. Of at most four differing bits no more than two lie in the two
   segments with the fewest (pigeonhole), so for one of the three pairs of segments the errors are (0, 0 to 2), (0 to 2, 0) or (1, 1).
3. The perfect binary Golay code of length 23 puts each word within three bits of exactly one code word. Two segments that
   differ in at most two bits have a word between them, one bit at most from each, so the code word numbers of a
   segment and of its neighbours (at most six different ones) share one. For errors of exactly one bit, the two words have different
   parity: an even one gives its own number, an odd one those of its neighbours.
4. A key is a pair of segments with either the bits of one and a number of the other, or a number of each, about sixty keys a
   fingerprint. Keys are shuffled once and sorted; within a key's group a breadth-first walk compares whole fingerprints, so that only
   verified links leave it, one for each member. Groups beyond a block, which a count with partial sums finds first, are dealt
   into blocks (``near_dedup.linked``). Links give the components.

Nothing is lost: any two fingerprints at a distance of four or less share a key.

Defined results
    null, empty and wordless texts have fingerprint zero and are linked like others; with one to three words the whole sequence is
    the one shingle; very long texts are hashed in windows that overlap by three words; a bit set in exactly half of the hashes is
    zero; rows that repeat an identifier are rows of their own; a component's name is its least identifier, null only if none of its
    rows has one; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from framequill.llm.graph import LINKS, components, contract, matching
from framequill.llm.near_dedup import BLOCK, edges, grouped, linked, spanned
from framequill.llm.words import SPACES, slices, text_bytes
from framequill.session import load, ship, small_batches, spool, spool_counted

ship(__name__)

WIDTH, SEED, MOST = 4, 42, 4
#: Bytes of text, and shingles, that are looked at together.
WINDOW, SHINGLES = 4 << 20, 1 << 17
BLANK = np.zeros(256, bool)
BLANK[list(SPACES)] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def spans(data: np.ndarray, offsets: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The words in lower case, each followed by one space; where each begins and ends there; how many words precede each
    text (one more than texts); and where each word begins in ``data``."""
    black = ~BLANK[data]
    first, last = black.copy(), black.copy()
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    first[1:] &= ~black[:-1] | cut[1:-1]
    last[:-1] &= ~black[1:] | cut[1:-1]
    at, size = np.flatnonzero(first), 0
    size = np.flatnonzero(last) + 1 - at
    ends = np.cumsum(size + 1) - 1
    out = np.full(int(ends[-1]) + 1 if len(at) else 0, 32, np.uint8)
    out[np.arange(int(size.sum())) + np.repeat(np.arange(len(at)), size)] = LOWER[data[black]]
    return out.tobytes(), ends - size, ends, np.searchsorted(at, offsets), at


def bit_counts(words: bytes, begin: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """How many of the hashes of words[begin:stop] have each of 64 bits."""
    from xxhash import xxh64_intdigest

    total = np.zeros(64, np.int64)
    for at in range(0, len(begin), SHINGLES):
        pairs = zip(begin[at : at + SHINGLES].tolist(), stop[at : at + SHINGLES].tolist())
        h = np.fromiter((xxh64_intdigest(words[a:b], SEED) for a, b in pairs), np.uint64)
        total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return total


def counted(data: np.ndarray) -> tuple[np.ndarray, int]:
    """(bit counts, shingles) of one text, in windows that are cut at white space and hold four words at least."""
    total, n, at, reach = np.zeros(64, np.int64), 0, 0, WINDOW
    while True:
        to = at + reach
        while to < len(data):
            free = np.flatnonzero(BLANK[data[to : to + WINDOW]])
            to += int(free[0]) if len(free) else WINDOW
            if len(free):
                break
        part = data[at:to]
        words, begin, ends, _, place = spans(part, np.array([0, len(part)]))
        m = len(begin)
        if m >= WIDTH:
            total += bit_counts(words, begin[: m - WIDTH + 1], ends[WIDTH - 1 :])
            n, at, reach = n + m - WIDTH + 1, at + int(place[m - WIDTH + 1]), WINDOW
        elif to < len(data):
            reach *= 2
            continue
        elif m and not n:
            return bit_counts(words, begin[:1], ends[-1:]), 1
        if to >= len(data):
            return total, n


def fingerprints(column: pa.Array) -> np.ndarray:
    """The fingerprint of each text, as signed integers."""
    data, offsets = text_bytes(column)
    counts, n = np.zeros((len(offsets) - 1, 64), np.int64), np.zeros(len(offsets) - 1, np.int64)
    if len(data) > WINDOW:
        for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
            counts[i], n[i] = counted(data[a:b])
    else:
        words, begin, ends, texts, _ = spans(data, offsets)
        for i, (a, b) in enumerate(zip(texts[:-1].tolist(), texts[1:].tolist())):
            if b > a:
                last = max(b - WIDTH + 1, a + 1)
                counts[i], n[i] = bit_counts(words, begin[a:last], ends[min(a + WIDTH, b) - 1 : b]), last - a
    return np.packbits(2 * counts > n[:, None], axis=1, bitorder="little").view(np.int64).ravel()


def printed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fingerprints(batch.column(1)))], ["id", "fp"])


class Golay:
    """The perfect binary Golay code of length 23, from its generator polynomial."""

    GENERATOR, LENGTH, CHECK = 0b110001110101, 23, 11

    def __init__(self) -> None:
        rest = []
        for j in range(self.LENGTH):
            r = 1 << j
            for k in range(j, self.CHECK - 1, -1):
                if r >> k & 1:
                    r ^= self.GENERATOR << (k - self.CHECK)
            rest.append(r)
        self.rest = np.array(rest, np.uint32)
        self.error = np.zeros(1 << self.CHECK, np.uint32)
        bits = [(1 << j, rest[j]) for j in range(self.LENGTH)]
        for a, (x, p) in enumerate(bits):
            self.error[p] = x
            for b, (y, q) in enumerate(bits[:a]):
                self.error[p ^ q] = x | y
                for z, r in bits[:b]:
                    self.error[p ^ q ^ r] = x | y | z
        at = np.arange(256, dtype=np.uint32)
        self.tables = [np.bitwise_xor.reduce([np.where(at >> k & 1, self.rest[8 * t + k] if 8 * t + k < self.LENGTH else 0, 0) for k in range(8)]).astype(np.uint32) for t in range(3)]

    def syndrome(self, words: np.ndarray) -> np.ndarray:
        return self.tables[0][words & 255] ^ self.tables[1][words >> 8 & 255] ^ self.tables[2][words >> 16]

    def numbers(self, words: np.ndarray, width: int) -> np.ndarray:
        """A column for the number of the code word next to each word, and one for that of each of its ``width`` neighbours."""
        s = self.syndrome(words)
        flips = [(words ^ (1 << j) ^ self.error[s ^ self.rest[j]]) >> self.CHECK for j in range(width)]
        return np.stack([(words ^ self.error[s]) >> self.CHECK, *flips], axis=1)


CODE = Golay()
#: (lowest bit, width) of the segments.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
NONE = 1 << 12


def distinct(numbers: np.ndarray, most: int = 6) -> np.ndarray:
    """The different numbers of each row, filled up with ``NONE``; code words near a word are six at most."""
    held = np.sort(numbers, axis=1)
    held[:, 1:][held[:, 1:] == held[:, :-1]] = NONE
    return np.sort(held, axis=1)[:, :most]


def keys(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key, row number) of all keys of each fingerprint."""
    bits = prints.view(np.uint64)
    exact, two, one = [], [], []
    for low, width in SEGMENTS:
        words = (bits >> np.uint64(low) & np.uint64((1 << width) - 1)).astype(np.uint32)
        numbers = CODE.numbers(words, width)
        odd = (np.bitwise_count(words) & 1).astype(bool)
        exact.append(words.astype(np.int64))
        two.append(distinct(numbers).astype(np.int64))
        own = np.full((len(words), 6), NONE, np.int64)
        own[:, 0] = numbers[:, 0]
        own[odd] = distinct(numbers[odd, 1:])
        one.append(own)
    found, rows = [], []
    for tag, (i, j) in enumerate(((0, 1), (0, 2), (1, 2))):
        for kind, (left, right) in enumerate(((exact[i][:, None], two[j]), (exact[j][:, None], two[i]), (one[i], one[j]))):
            at, a, b = np.nonzero((left != NONE if kind == 2 else np.ones_like(left, bool))[:, :, None] & (right != NONE)[:, None, :])
            found.append((3 * tag + kind << 36) | left[at, a] << 13 | right[at, b])
            rows.append(at)
    return np.concatenate(found), np.concatenate(rows)


def key_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 1 << 12):
            nodes = np.asarray(batch.column(0).slice(at, 1 << 12))
            key, row = keys(nodes)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(nodes[row])], ["g", "node"])


def within(most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for nodes, held in grouped(batches, lambda column: column.to_pylist()):
            table = np.array(held, np.int64).view(np.uint64)
            yield edges([(nodes[i], nodes[j]) for i, j in spanned(len(nodes), lambda i, rest: np.flatnonzero(np.bitwise_count(table[rest] ^ table[i]) <= most))])

    return run


def compared(most: int):
    """Links of the rows (g, node) of a partition sorted by both: single rows go at once, pairs are compared by column, larger groups walked."""

    def links(g: np.ndarray, nodes: np.ndarray) -> pa.RecordBatch:
        start = np.flatnonzero(np.append(True, g[1:] != g[:-1]))
        size = np.diff(np.append(start, len(g)))
        prints, two = nodes.view(np.uint64), start[size == 2]
        near = two[np.bitwise_count(prints[two] ^ prints[two + 1]) <= most]
        found = [(nodes[near], nodes[near + 1])]
        for at, n in zip(start[size > 2].tolist(), size[size > 2].tolist()):
            own = prints[at : at + n]
            pairs = np.array(list(spanned(n, lambda i, rest: np.flatnonzero(np.bitwise_count(own[rest] ^ own[i]) <= most))), np.int64).reshape(-1, 2)
            found.append((nodes[at + pairs[:, 0]], nodes[at + pairs[:, 1]]))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found)], ["a", "b"])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g, nodes = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            g, nodes = np.concatenate([g, np.asarray(batch.column(0))]), np.concatenate([nodes, np.asarray(batch.column(1))])
            cut = int(np.searchsorted(g, g[-1])) if len(g) else 0
            if cut:
                yield links(g[:cut], nodes[:cut])
                g, nodes = g[cut:], nodes[cut:]
        if len(g):
            yield links(g, nodes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from contract(walk(batches))

    return run


def similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """(id, fp, component) for each row of ``docs``: its fingerprint and the least identifier of its component."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    rows = spool(rows.mapInArrow(printed, "id long, fp long"), "prints")
    classes = spool(rows.groupBy("fp").agg(F.min("id").alias("first")).select(F.col("fp").alias("node"), "first"), "classes")
    held = classes.select("node").mapInArrow(key_rows, "g long, node long")
    heavy, n = spool_counted(held.groupBy("g").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > block).select("g"), "heavy")
    rest = matching(held, heavy, "g", "left_anti", n["n"]) if n["n"] else held
    links, seen = spool_counted(rest.repartition("g").sortWithinPartitions("g", "node").mapInArrow(compared(MOST), "u long, v long"), "links")
    total = seen["n"]
    if n["n"]:  # groups beyond a block are dealt
        groups, members = spool_counted(matching(held, heavy, "g", "left_semi", n["n"]), "groups")
        more, seen = linked(groups, members["n"], lambda rows: rows.withColumn("payload", F.col("node")), within(MOST), block)
        links, total = links.unionByName(more), total + seen
    labels = components(links, total)
    parts = max(1, -(-total // LINKS))
    named = spool(labels.unionByName(labels.select(F.col("v").alias("u"), "v").distinct()).join(classes, F.col("u") == F.col("node")).select("node", "v", "first"), "named", parts)
    leads = named.groupBy("v").agg(F.min("first").alias("lead"))
    found = classes.join(named.join(leads, "v").select("node", "lead"), "node", "left").select(F.col("node").alias("fp"), F.coalesce("lead", "first").alias("component"))
    return rows.join(found, "fp").select("id", "fp", "component")


def op11_golay_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar(load(spark, sf_dir, "documents")).select(
        F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("component").alias("component_id"))
