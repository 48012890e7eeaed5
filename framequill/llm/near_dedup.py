"""Near-duplicate components by banded MinHash, sequential Bayesian pruning and exact verification.

1. Each document's set of five-word shingles gets a digest and a signature of minima. Documents with equal
   sets form a class, and one signature of each class goes on, so copies never meet each other again.
2. Signatures are cut into 32 bands of 4. Two sets with similarity 0.75 share no band with a probability of 5e-6.
   Buckets with the same members count once.
3. Within a bucket, signatures are compared 32 minima at a time; a pair is dropped as soon as the posterior probability of
   reaching the threshold falls below ``miss``. What survives joins documents into families.
4. Within a family, pairs that survive the same pruning on twice as many minima are verified on the whole sets,
   computed anew from the texts. Verified links give the components.

Both searches walk breadth first from found to not yet found members, so a pair whose ends are already connected is never
looked at and each member is reported once, by one link; no group is written out as its pairs. A group larger than
``BLOCK`` is dealt into blocks that each get the group's leader too; only members that do not end up with the leader are then
compared with all blocks. That keeps every link between texts that share a band, and a group of copies linear.

Defined results
    null and wordless text: an empty set, linked with nothing; fewer than five words: one shingle of them all; rows without
    identifier are compared like others and give a component its name only if none of its rows has one; rows that repeat an
    identifier are documents of their own, each with the component of its own text; very long texts are signed and compared
    whole, one at a time; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from framequill.llm.exact_dedup import located
from framequill.llm.graph import LINKS, components, contract, matching
from framequill.llm.words import BASE, mix, powers, slices, text_bytes, word_hashes
from framequill.session import load, ship, small_batches, spool, spool_counted

ship(__name__)

WIDTH = 5
HASHES, ROWS, STEP = 128, 4, 32
#: Members of a group that are compared in one task.
BLOCK = 1024


def shingle_sets(column: pa.Array) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    data, offsets = text_bytes(column)
    words, begin = word_hashes(data, offsets)
    weights = powers(WIDTH)
    n = len(words) - WIDTH + 1
    runs = np.zeros(max(n, 0), np.uint64)
    for j in range(WIDTH if n > 0 else 0):
        runs += words[j : j + n] * weights[j]
    runs = mix(runs + np.uint64(WIDTH))
    for a, b in zip(begin[:-1].tolist(), begin[1:].tolist()):
        if b - a >= WIDTH:
            own = np.sort(runs[a : b - WIDTH + 1])
            yield own[np.append(True, own[1:] != own[:-1])]
        elif b > a:
            yield mix(np.array([(words[a:b] * weights[: b - a]).sum() + np.uint64(b - a)], np.uint64))
        else:
            yield np.zeros(0, np.uint64)


def parameters() -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.default_rng(7501).integers(0, 1 << 32, (2, 2 * HASHES), dtype=np.uint64).astype(np.uint32)
    return draw[0] | np.uint32(1), draw[1]


SCALE, SHIFT = parameters()


def signature(own: np.ndarray, hashes: int) -> np.ndarray:
    """The least value of the set under each of so many linear maps of its hashes' upper halves."""
    half = (own >> np.uint64(32)).astype(np.uint32)
    least = np.full(hashes, np.iinfo(np.uint32).max, np.uint32)
    for at in range(0, len(half), 512):
        part = half[at : at + 512, None] * SCALE[:hashes]
        part += SHIFT[:hashes]
        np.minimum(least, part.min(axis=0), out=least)
    return least


def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import hashlib

    for batch in slices(batches, "text"):
        sizes, digests, signatures = [], [], []
        for own in shingle_sets(batch.column(3)):
            sizes.append(len(own))
            digests.append(hashlib.blake2b(own.tobytes(), digest_size=16).digest())
            signatures.append(signature(own, HASHES).tobytes() if len(own) else None)
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:3], pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(signatures, pa.binary())],
            ["id", "path", "row", "n", "digest", "sig"])


def signature_matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(len(column), HASHES)


def band_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    bands = HASHES // ROWS
    for batch in batches:
        if not batch.num_rows:
            continue
        held = signature_matrix(batch.column(1)).reshape(-1, bands, ROWS).astype(np.uint64)
        keys = (held * powers(ROWS + 1)[1:]).sum(axis=2, dtype=np.uint64) + np.arange(bands, dtype=np.uint64) * BASE
        yield pa.RecordBatch.from_arrays(
            [pa.array(mix(keys).ravel().view(np.int64)), pa.array(np.repeat(np.asarray(batch.column(0)), bands))], ["key", "node"])


def cutoffs(hashes: int, threshold: float, miss: float) -> list[tuple[int, int]]:
    """(n, least matches of n with which a pair goes on): with fewer, P(similarity >= threshold) < miss under a uniform prior."""
    found = []
    for n in range(STEP, hashes + 1, STEP):
        below, m = 0.0, 0
        while m <= n:
            below += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if below >= miss:
                break
            m += 1
        found.append((n, m))
    return found


def alike(one: np.ndarray, others: np.ndarray, rules: list[tuple[int, int]]) -> np.ndarray:
    """Numbers of the rows of ``others`` whose comparison with ``one`` is not broken off."""
    alive, matches = np.arange(len(others)), np.zeros(len(others), np.int64)
    for n, least in rules:
        matches = matches + (others[alive, n - STEP : n] == one[n - STEP : n]).sum(axis=1)
        go = matches >= least
        alive, matches = alive[go], matches[go]
        if not len(alive):
            break
    return alive


def spanned(n: int, near: Callable[[int, np.ndarray], np.ndarray]) -> Iterator[tuple[int, int]]:
    """Links (found, newly found) of a breadth-first walk; ``near(i, rest)`` tells which of ``rest`` link with i."""
    rest = np.arange(n)
    while len(rest) > 1:
        queue, rest = [int(rest[0])], rest[1:]
        while queue and len(rest):
            i = queue.pop()
            hit = near(i, rest)
            for j in rest[hit].tolist():
                yield i, j
                queue.append(j)
            rest = np.delete(rest, hit)


def grouped(batches: Iterator[pa.RecordBatch], read) -> Iterator[tuple[list, list]]:
    """(nodes, payloads) of each group of rows (g, block, node, payload) sorted by g and block; repeated nodes count once."""
    now, nodes, held = None, [], []
    for batch in batches:
        for g, block, node, value in zip(*(batch.column(j).to_pylist() for j in range(3)), read(batch.column(3))):
            if (g, block) != now:
                if len(nodes) > 1:
                    yield nodes, held
                now, nodes, held = (g, block), [], []
            if not nodes or nodes[-1] != node:
                nodes.append(node)
                held.append(value)
    if len(nodes) > 1:
        yield nodes, held


def edges(found: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], ["a", "b"])


def by_signature(threshold: float, miss: float):
    rules = cutoffs(HASHES, threshold, miss)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for nodes, held in grouped(batches, lambda column: column.to_pylist()):
            table = np.frombuffer(b"".join(held), np.uint32).reshape(len(held), HASHES)
            yield edges([(nodes[i], nodes[j]) for i, j in spanned(len(nodes), lambda i, rest: alike(table[i], table[rest], rules))])

    return run


def bitmaps(sets: list[np.ndarray], most: int = 32 << 20) -> np.ndarray | None:
    """Rows of bits for the members that several sets have, which alone can be shared; None if they took more than ``most`` bytes."""
    members, n = np.unique(np.concatenate(sets), return_counts=True)
    members = members[n > 1]
    width = -(-len(members) // 64) or 1
    if len(sets) * width * 8 > most:
        return None
    bits = np.zeros((len(sets), width * 8), np.uint8)
    for row, own in zip(bits, sets):
        held = np.zeros(width * 64, bool)
        if len(members) and len(own):
            at = np.minimum(np.searchsorted(members, own), len(members) - 1)
            held[at[members[at] == own]] = True
        row[:] = np.packbits(held)
    return bits.view(np.uint64)


def by_set(percent: int, miss: float):
    rules = cutoffs(2 * HASHES, percent / 100, miss)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for nodes, sets in grouped(slices(batches, "payload"), shingle_sets):
            table = np.stack([signature(own, 2 * HASHES) for own in sets])
            sizes = np.array([len(own) for own in sets])
            bits = bitmaps(sets)

            def near(i: int, rest: np.ndarray) -> np.ndarray:
                fits = np.flatnonzero(100 * np.minimum(sizes[rest], sizes[i]) >= percent * np.maximum(sizes[rest], sizes[i]))
                fits = fits[alike(table[i], table[rest[fits]], rules)] if sizes[i] else fits[:0]
                if not len(fits):
                    return fits
                if bits is not None:
                    shared = np.bitwise_count(bits[rest[fits]] & bits[i]).sum(axis=1, dtype=np.int64)
                    return fits[100 * shared >= percent * (sizes[rest[fits]] + sizes[i] - shared)]
                parts = [sets[j] for j in rest[fits].tolist()]
                joined, base = np.concatenate(parts), sets[i]
                hit = base[np.minimum(np.searchsorted(base, joined), len(base) - 1)] == joined
                lengths = sizes[rest[fits]]
                shared = np.add.reduceat(hit.astype(np.int64), np.concatenate([[0], np.cumsum(lengths)[:-1]]))
                return fits[100 * shared >= percent * (lengths + sizes[i] - shared)]

            yield edges([(nodes[i], nodes[j]) for i, j in spanned(len(nodes), near)])

    return run


def linked(groups: DataFrame, n: int, attach: Callable[[DataFrame], DataFrame], kernel, block: int = BLOCK) -> tuple[DataFrame, int]:
    """Spooled stars (u, v) that connect the members of each of the ``n`` rows (g, node) as far as ``kernel`` finds them
    alike, and how many there are.

    ``attach`` adds what the kernel compares as ``payload`` to rows (g, block, node).
    """
    parts = max(1, -(-n // LINKS))

    def contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from contract(kernel(batches))

    def search(rows: DataFrame, *also: DataFrame) -> tuple[DataFrame, int]:
        rows = attach(rows).select("g", "block", "node", "payload")
        found = rows.repartition("g", "block").sortWithinPartitions("g", "block", "node").mapInArrow(contracted, "u long, v long")
        for more in also:
            found = found.unionByName(more)
        table, seen = spool_counted(found, "links")
        return table, seen["n"]

    def part(of):
        return F.pmod(F.xxhash64("node"), of)

    def each(of: str):
        return F.explode(F.sequence(F.lit(0).cast("long"), F.col(of) - 1))

    sizes = groups.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("lead")).where("n > 1").withColumn("blocks", F.ceil(F.col("n") / block))
    sizes, seen = spool_counted(sizes, "sizes", parts, large=F.col("blocks") > 1)
    large = sizes.where("blocks > 1")
    dealt = groups.join(sizes, "g").select("g", part(F.col("blocks")).alias("block"), "node")
    if not seen["large"]:
        return search(dealt)
    found, links = search(dealt.unionByName(large.select("g", each("blocks").alias("block"), F.col("lead").alias("node"))))
    # Members of large groups that are not with their leader yet meet every block of their group.
    labels = components(found, links)
    held = groups.join(large, "g").join(labels.select(F.col("u").alias("node"), "v"), "node", "left").select("g", "node", "lead", "blocks", F.coalesce("v", "node").alias("root"))
    lead_at = large.join(labels, F.col("lead") == F.col("u"), "left").select("g", F.coalesce("v", "lead").alias("lead_root"))
    held = held.join(lead_at, "g").select("g", "node", "blocks", (F.col("root") != F.col("lead_root")).alias("apart"))
    held, seen = spool_counted(held, "apart", parts, apart=F.col("apart"))
    if not seen["apart"]:
        return labels, links
    held = held.join(held.where("apart").groupBy("g").agg(F.ceil(F.count(F.lit(1)) / block).alias("shares")), "g")
    mine = held.where("apart").withColumn("x", part(F.col("shares"))).withColumn("y", each("blocks"))
    others = held.withColumn("y", part(F.col("blocks"))).withColumn("x", each("shares"))
    cells = mine.unionByName(others).select("g", (F.col("x") * F.col("blocks") + F.col("y")).alias("block"), "node").distinct()
    return search(cells, labels)


def near_components(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 75, miss: float = 1e-5, block: int = BLOCK,
) -> DataFrame:
    """(id, path, row, n, component, stays) for each row of ``docs``: n the size of its set, component the least identifier
    of its component, path and row where it lies (as ``exact_dedup.located`` tells), stays for one row of each component."""
    small_batches(docs.sparkSession)
    docs = located(docs, id_col, text_col).withColumn("id", F.col("id").cast("long"))
    signed = docs.select("id", "path", "row", "text").mapInArrow(sign, "id long, path string, row long, n long, digest binary, sig binary")
    signed = spool(signed.withColumn("node", F.monotonically_increasing_id()), "signed")
    first = F.struct(F.col("id").isNull().alias("no_id"), "id", "path", "row", "node")
    classes = (signed.where("n > 0").groupBy("digest").agg(F.min(first).alias("first"), F.first("sig").alias("sig"))
               .select("digest", "first", "sig", F.col("first.node").alias("node")))
    classes = spool(classes, "classes")

    # Buckets, each set of members once.
    bands = classes.select("node", "sig").mapInArrow(band_rows, "key long, node long")
    members = [F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y")]
    crowded = bands.groupBy("key").agg(*members).where("n > 1").groupBy("n", "x", "y").agg(F.min("key").alias("key")).select("key")
    buckets, seen = spool_counted(bands.join(crowded, "key", "left_semi").select(F.col("key").alias("g"), "node"), "buckets")
    parts = max(1, -(-seen["n"] // LINKS))
    nodes, several = spool_counted(buckets.select("node").distinct(), "nodes", parts)
    signatures = spool(matching(classes.select("node", F.col("sig").alias("payload")), nodes, "node", "left_semi", several["n"]), "signatures")
    families = components(*linked(buckets, seen["n"], lambda rows: rows.join(signatures, "node"), by_signature(percent / 100, miss), block))

    families = families.select(F.col("v").alias("g"), F.col("u").alias("node")).unionByName(families.select(F.col("v").alias("g"), F.col("v").alias("node")).distinct())
    members, seen = spool_counted(families.join(classes.select("node", "first.path", "first.row"), "node"), "families", parts)
    place = F.xxhash64("path", "row").alias("place")
    texts = docs.select(place, "path", "row", F.col("text").alias("payload"))

    def with_text(rows: DataFrame) -> DataFrame:
        keys = rows.join(members, ["g", "node"]).select("g", "block", "node", F.col("path").alias("own_path"), F.col("row").alias("own_row"), place)
        keys, n = spool_counted(keys, "rows")
        return matching(texts, keys, "place", n=n["n"]).where("path = own_path and row = own_row")

    labels = components(*linked(members.select("g", "node"), seen["n"], with_text, by_set(percent, miss), block))

    grouped_ = labels.unionByName(labels.select(F.col("v").alias("u"), "v").distinct()).withColumnRenamed("u", "node")
    grouped_ = spool(grouped_.join(classes.select("node", "first"), "node"), "grouped", parts)
    leads = grouped_.groupBy("v").agg(F.min("first").alias("lead"))
    named = (classes.select("digest", "node", "first").join(grouped_.select("node", "v").join(leads, "v").select("node", "lead"), "node", "left")
             .select("digest", F.coalesce("lead", "first").alias("lead")))
    return signed.select("id", "path", "row", "n", "digest").join(named, "digest", "left").select(
        "id", "path", "row", "n", F.when(F.col("n") > 0, F.col("lead.id")).otherwise(F.col("id")).alias("component"),
        ((F.col("n") == 0) | (F.col("path") == F.col("lead.path")) & (F.col("row") == F.col("lead.row"))).alias("stays"))


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_components(load(spark, sf_dir, "documents")).select(
        F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"),
        F.col("id").eqNullSafe(F.col("component")).alias("kept"))


OP10_SQL = r"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as ws
  from documents
), s as (
  select distinct doc_id, unnest(case when len(ws) >= 5
      then list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i+4], ' '))
      when len(ws) > 0 then [array_to_string(ws, ' ')] else [] end) as sh
  from w
), n as (select doc_id, count(*) as n from s group by doc_id),
p as (
  select a.doc_id as a, b.doc_id as b, count(*) as shared
  from s a join s b on a.sh = b.sh and a.doc_id < b.doc_id group by 1, 2
), l as (
  select p.a, p.b from p join n x on x.doc_id = p.a join n y on y.doc_id = p.b
  where 100 * p.shared >= 75 * (x.n + y.n - p.shared)
), e as (select a, b from l union select b, a from l),
r as (select doc_id as node, doc_id as root from documents union select e.b, r.root from r join e on e.a = r.node),
c as (select node, min(root) as root from r group by node)
select d.doc_id, cast(coalesce(n.n, 0) as bigint) as n_shingles, c.root as component_id, d.doc_id = c.root as kept
from documents d left join n on n.doc_id = d.doc_id join c on c.node = d.doc_id
"""
