"""Document fingerprints from closed syncmers over words.

A k-mer is k words in a row; its inner substrings are its words, ordered by hash. A k-mer is a closed syncmer when its
least inner hash lies at its first or last word. Whether a k-mer is chosen depends on its own words alone, so an edit
disturbs only the k-mers it touches and the others stay anchors in both texts. Matching is positional: what two texts are
said to share are links, two anchors that follow each other together with the distance of their positions, which
stays the same wherever the passage lies. Likeness is the share of links that both texts have among the links of
either, over whole texts; ``matches`` tells at which shifts two texts agree. The fingerprint is the whole set of links, rising, eight
hexadecimal digits each, so that likeness can be had from two fingerprints alone.

Defined results
    null text counts as empty; a text without words has an empty fingerprint; one with fewer than k words has
    one link, all its words, one with a single anchor that anchor; equal link sets have likeness 1, also when both are empty; a row
    without identifier has no next document, and neither has an only row besides itself; rows that repeat an identifier follow
    each other by text, in one block; a very long text is one array of word hashes and one of links; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from framequill.session import load, spool

SPACE = r"[\x20\x09-\x0D]+"
K = 5
LOW32 = (1 << 32) - 1


def word_hashes(text: Column) -> Column:
    words = F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")
    return F.transform(words, lambda w: F.xxhash64(w))


def anchors(hashes: Column, k: int = K) -> Column:
    """array<struct<pos int, hash bigint>>: the closed syncmers of an array of word hashes, in order of position."""
    at = lambda i, j: F.get(hashes, i + F.lit(j))
    whole = F.array(F.struct(F.lit(0).alias("pos"), F.hash(hashes).cast("long").bitwiseAND(LOW32).alias("hash")))

    def closed(i: Column) -> Column:
        return F.least(at(i, 0), at(i, k - 1)) <= F.least(*[at(i, j) for j in range(1, k - 1)])

    def anchor(i: Column) -> Column:
        return F.struct(i.alias("pos"), F.xxhash64(*[at(i, j) for j in range(k)]).bitwiseAND(LOW32).alias("hash"))

    starts = F.filter(F.sequence(F.lit(0), F.size(hashes) - k), closed)
    return (F.when(F.size(hashes) == 0, F.array().cast("array<struct<pos:int,hash:bigint>>"))
            .when(F.size(hashes) < k, whole).otherwise(F.transform(starts, anchor)))


def with_links(df: DataFrame, text: str, name: str, k: int = K) -> DataFrame:
    """Adds ``name``: array<int>, the distinct hashed links of the text column.

    Each step is a column of its own, so that arrays are made once and not for each element of the next one.
    """
    hashes, starts, picks = (F.col(f"{name} {part}") for part in ("hashes", "starts", "picks"))
    at = lambda i, j: F.get(hashes, i + F.lit(j))
    closed = lambda i: F.least(at(i, 0), at(i, k - 1)) <= F.least(*[at(i, j) for j in range(1, k - 1)])
    links = F.transform(F.slice(starts, 2, F.greatest(F.size(starts), F.lit(1))), lambda p, i: F.hash(F.get(picks, i), F.get(picks, i + 1), p - F.get(starts, i)))
    return (df.withColumn(f"{name} hashes", word_hashes(F.col(text)))
            .withColumn(f"{name} starts", F.when(F.size(hashes) >= k, F.filter(F.sequence(F.lit(0), F.size(hashes) - k), closed)).otherwise(F.array().cast("array<int>")))
            .withColumn(f"{name} picks", F.transform(starts, lambda i: F.xxhash64(*[at(i, j) for j in range(k)])))
            .withColumn(name, F.when(F.size(starts) > 1, F.array_distinct(links)).when(F.size(starts) == 1, F.array(F.hash(F.get(picks, F.lit(0)))))
                        .when(F.size(hashes) > 0, F.array(F.hash(hashes))).otherwise(F.array().cast("array<int>")))
            .drop(*(f"{name} {part}" for part in ("hashes", "starts", "picks"))))


def likeness(a: Column, b: Column) -> Column:
    """Shared links among those of either text."""
    both = F.size(F.array_intersect(a, b))
    either = F.size(a) + F.size(b) - both
    return F.when(either == 0, F.lit(1.0)).otherwise(both / either)


def as_text(links: Column) -> Column:
    """The links as hexadecimal digits, in order."""
    return F.array_join(F.transform(F.sort_array(links), lambda h: F.lpad(F.lower(F.hex(h.cast("long").bitwiseAND(LOW32))), 8, "0")), "")


def matches(left: DataFrame, right: DataFrame, on: str, k: int = K) -> DataFrame:
    """Positional matching of text columns ``text`` of rows with equal ``on``: (on, shift, anchors), anchors unique in each text.

    ``shift`` is the position in the right text minus that in the left; long runs of anchors
    with one shift are passages that both texts have.
    """
    def unique(df: DataFrame, name: str) -> DataFrame:
        held = df.select(on, word_hashes(F.col("text")).alias("h")).select(on, F.explode(anchors(F.col("h"), k)).alias("a"))
        return held.groupBy(on, F.col("a.hash").alias("hash")).agg(F.min("a.pos").alias(name), F.count(F.lit(1)).alias("n")).where("n = 1").drop("n")

    return (unique(left, "l").join(unique(right, "r"), [on, "hash"])
            .groupBy(on, (F.col("r") - F.col("l")).alias("shift")).agg(F.count(F.lit(1)).alias("anchors")))


def blocks(docs: DataFrame, per_block: int, most: int) -> tuple[Column, int]:
    """The block of a row by identifier, and how many there are: quantiles of all identifiers are the bounds, ``most`` at most.

    Any rising bounds give right results; quantiles give blocks of about equal size however the identifiers lie.
    """
    n = docs.agg(F.count("doc_id")).first()[0]
    wanted = max(1, min(most, -(-n // per_block)))
    marks = []
    if wanted > 1:
        shares = F.split(F.lit(",".join(repr(i / wanted) for i in range(1, wanted))), ",").cast("array<double>")
        found = docs.agg(F.percentile_approx("doc_id", shares, F.lit(4 * wanted))).first()[0]
        marks = sorted({int(m) for m in found})
    if not marks:
        return F.lit(0), 1
    bounds = F.split(F.lit(",".join(map(str, marks))), ",").cast("array<bigint>")
    steps = F.array(*[F.lit(1 << i) for i in range(len(marks).bit_length() - 1, -1, -1)])
    reached = lambda to: (to <= F.lit(len(marks))) & (F.get(bounds, to - 1) <= F.col("doc_id"))
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(reached(at + step), at + step).otherwise(at)), len(marks) + 1


def with_next(docs: DataFrame, per_block: int = 256, most: int = 1 << 17) -> DataFrame:
    """Adds ``next``, a struct of the text and links of the row that follows by identifier, the first after the last.

    Identifiers fall into blocks of about ``per_block`` rows, or of 1 / ``most`` of the rows where that is more: below 1 GB of a table of
    100 TB, sorted with spill. The bounds take 1 MB at most. Within a block the next row is a lead, and the last row of a block gets the
    first of the next filled block through a join of one row per block. Rows without identifier get null.
    """
    number, n = blocks(docs, per_block, most)
    order = Window.partitionBy("block").orderBy("doc_id", "text")
    block = F.when(F.col("doc_id").isNotNull(), number).otherwise(-1 - F.pmod(F.xxhash64("text"), F.lit(1 << 20)).cast("int"))
    rows = docs.withColumn("block", block).withColumn("next", F.lead(F.struct("text", "links")).over(order))
    firsts = docs.where("doc_id is not null").select("doc_id", "text", block.alias("block")).withColumn("nth", F.row_number().over(order)).where("nth = 1")
    firsts = spool(with_links(firsts, "text", "links").select("block", F.struct("text", "links").alias("other")), "firsts")
    filled = firsts.select("block")  # no more rows than ``most``
    along = Window.orderBy("block")
    first = F.min("block").over(Window.partitionBy())
    heads = spool(filled.select(F.coalesce(F.lead("block").over(along), first).alias("follower"), "block"), "heads").join(
        firsts.withColumnRenamed("block", "follower"), "follower").select("block", "other")
    lasts = F.col("next").isNull() & F.col("doc_id").isNotNull()
    return (rows.join(heads, ["block"], "left")
            .withColumn("next", F.when(lasts, F.col("other")).otherwise(F.when(F.col("doc_id").isNotNull(), F.col("next"))))
            .drop("other", "block"))


def op4_closed_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = with_next(with_links(docs, "text", "links"))
    n = F.char_length("text")
    cut = F.expr("char_length(text) div 4").cast("int")
    edited = F.concat(F.expr("substring(text, 1, cast(char_length(text) - char_length(text) div 4 as int))"),
                      F.when(cut > 0, F.expr("substring(coalesce(next.text, ''), 1, cast(char_length(text) div 4 as int))")).otherwise(F.lit("")))
    rows = with_links(rows.withColumn("n_chars", n.cast("long")).withColumn("edited", edited), "edited", "edited_links")
    return rows.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
        as_text(F.col("links")).alias("fingerprint"), as_text(F.col("edited_links")).alias("edited_fingerprint"),
        likeness(F.col("links"), F.col("edited_links")).alias("near_edited"),
        F.coalesce(likeness(F.col("links"), F.col("next.links")), F.lit(0.0)).alias("near_next"))
