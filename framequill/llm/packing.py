"""Best-fit packing of documents into sequences of several permitted lengths.

A document's length is its number of words and one end mark, or a column of token counts. What is longer than the longest
sequence is cut into pieces of that length and a rest. Pieces are dealt evenly to groups of bounded size, which pack
independently of each other: longest first, each goes to the open bin with the least room that still takes it; where there is none, a
bin opens, and at the end each bin shrinks to the shortest permitted length that holds its contents. Which length opens for
a piece is a table with an entry for each permitted length, by the shortest that takes the piece. The entries are chosen jointly: the
group is packed under a table, the finished and shrunk bins are added up, and entries change one at a time
as long as the total falls. A bin costs ``fixed + length + length**2 / curve``: a part for each sequence, one for each
token, one for attention, whose share of a token's work is its sequence's length over about twelve times the model's width.

Defined results
    null and empty texts are one end mark long; repeated rows are packed as often as they occur; ties go to the smaller identifier,
    then the earlier piece; rows without identifier are packed like others; a very long text becomes as many pieces as it
    takes, each packed like a text of that length; an empty table gives an empty result; further columns are ignored. The
    result follows from the rows alone, whatever their order or partitions.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from framequill.llm.mixing import word_count
from framequill.session import load, ship, spool

ship(__name__)

LENGTHS = (512, 1024, 2048, 4096)
SCHEMA = "doc_id long, piece int, start long, length int, bin_id long, bin_length int, place int"


def cost(length: int, fixed: float = 64.0, curve: float = 32768.0) -> float:
    return fixed + length + length * length / curve


def fill(sizes: Sequence[int], lengths: Sequence[int], opens: Sequence[int]) -> tuple[list[int], list[int], list[int]]:
    """(bin of each size, its place in the bin, contents of each bin); ``opens`` tells the length that opens by the shortest that fits.

    Rooms are kept as bits of one integer, so the least room that takes a size is the lowest set bit from there on.
    """
    rooms, by_room = 0, [[] for _ in range(lengths[-1] + 1)]
    bins, places, used = [], [], []
    for size in sizes:
        fit = rooms >> size
        if fit:
            room = size + (fit & -fit).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
        else:
            b, room = len(used), opens[bisect_left(lengths, size)]
            used.append(0)
        bins.append(b)
        places.append(used[b])
        used[b] += size
        room -= size
        if room:
            by_room[room].append(b)
            rooms |= 1 << room
    return bins, places, used


def chosen_opens(sizes: Sequence[int], lengths: Sequence[int]) -> list[int]:
    """The opening lengths with the least total cost of shrunk bins that changing one entry at a time finds."""
    costs, tried = [cost(c) for c in lengths], {}

    def total(opens: list[int]) -> float:
        if (key := tuple(opens)) not in tried:
            tried[key] = sum(costs[bisect_left(lengths, u)] for u in fill(sizes, lengths, opens)[2])
        return tried[key]

    cheapest = [min((cost(c) / c, c) for c in lengths[i:])[1] for i in range(len(lengths))]
    best = min(cheapest, list(lengths), key=total)
    used = {bisect_left(lengths, s) for s in set(sizes)}
    while True:
        before = total(best)
        for i in sorted(used):
            best = min((best[:i] + [c] + best[i + 1 :] for c in lengths[i:]), key=total)
        if total(best) >= before:
            return best


def pack(sizes: Sequence[int], lengths: Sequence[int] = LENGTHS) -> tuple[list[int], list[int], list[int]]:
    """(bin of each size, its place in the bin, length of each bin) for sizes in falling order, none above the longest length."""
    lengths = sorted(lengths)
    bins, places, used = fill(sizes, lengths, chosen_opens(sizes, lengths))
    return bins, places, [lengths[bisect_left(lengths, u)] for u in used]


def packer(lengths: Sequence[int], group_bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held = None, []

        def flush() -> pa.RecordBatch:
            rows = [np.concatenate(c) for c in zip(*held)]
            bins, places, sizes = pack(rows[3].tolist(), lengths)
            bins = np.asarray(bins, np.int64)
            return pa.RecordBatch.from_arrays([
                pa.array(rows[0], mask=rows[4]), pa.array(rows[1], pa.int32()), pa.array(rows[2], pa.int64()), pa.array(rows[3], pa.int32()),
                pa.array((np.int64(group) << group_bits) + bins), pa.array(np.asarray(sizes, np.int32)[bins]), pa.array(places, pa.int32()),
            ], ["doc_id", "piece", "start", "length", "bin_id", "bin_length", "place"])

        for batch in batches:
            groups = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(groups)) + 1).tolist(), len(groups)] if len(groups) else []
            for a, b in zip(cuts, cuts[1:]):
                if groups[a] != group:
                    if held:
                        yield flush()
                    group, held = groups[a], []
                part = batch.slice(a, b - a)
                ids = part.column(1)
                held.append((ids.fill_null(0).to_numpy(), *[part.column(j).to_numpy() for j in (2, 3, 4)], ids.is_null().to_numpy(zero_copy_only=False)))
        if held:
            yield flush()

    return run


def best_fit(docs: DataFrame, lengths: Sequence[int] = LENGTHS, id_col: str = "doc_id", text_col: str = "text", size_col: str | None = None, per_group: int = 4096, copies: int = 4096) -> DataFrame:
    """One row per piece: doc_id, piece, start, length (tokens of the document), bin_id, bin_length, place (in the bin)."""
    longest = max(lengths)
    size = F.col(size_col).cast("long") if size_col else word_count(F.col(text_col)) + 1
    content = F.xxhash64(text_col) if text_col in docs.columns else F.lit(0).cast("long")
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), size.alias("size"), content.alias("content")).where("size > 0")
    # Rows that are the same in all three count once with their number, so no order of rows has a say in where they go.
    held = spool(slim.groupBy("doc_id", "size", "content").agg(F.count(F.lit(1)).alias("n")), "sizes")
    total, most = held.agg(F.sum(F.col("n") * F.ceil(F.col("size") / longest)), F.max("n")).first()
    groups = max(1, -(-(total or 0) // per_group))
    parts = min(groups, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
    if (most or 0) > copies:
        held = held.select("*", upto(F.ceil(F.col("n") / copies)).alias("lot")).repartition("doc_id", "content", "lot")
    else:
        held = held.withColumn("lot", F.lit(0).cast("long"))
    pieces = (held.withColumn("copy", upto(F.least(F.lit(copies), F.col("n") - F.col("lot") * copies)))
              .select("*", F.explode(F.sequence(F.lit(0), F.ceil(F.col("size") / longest).cast("int") - 1)).alias("piece"))
              .select(F.pmod(F.xxhash64("doc_id", "content", "lot", "copy", "piece"), F.lit(groups)).cast("int").alias("grp"), "doc_id", "piece",
                      (F.col("piece").cast("long") * longest).alias("start"),
                      F.least(F.lit(longest), F.col("size") - F.col("piece") * longest).cast("int").alias("length"), "content"))
    dealt = pieces.repartitionById(parts, F.col("grp")).sortWithinPartitions("grp", F.desc("length"), "doc_id", "piece", "content")
    return dealt.select("grp", "doc_id", "piece", "start", "length").mapInArrow(packer(lengths, 32), SCHEMA)


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit(load(spark, sf_dir, "documents"))
