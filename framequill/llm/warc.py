"""WARC records and the Merkle audit of their replicas.

An archive is a sequence of records at byte offsets. Leaves are ranges of ``1 << LEAF_BITS`` offsets: a leaf's hash covers
the offsets and hashes of the records that begin in it, in order. Each node above covers 16 ranges below, up to
one root per archive. Two replicas are compared root by root; only ranges whose hashes differ are opened, level by
level, and only records in differing leaves are compared. No group is larger than a leaf's records or a node's 16 children.

Defined results
    null content counts as empty, a null address as none; rows without identifier come last in their archive; rows
    that repeat are separate records; a very long content makes a record that fills its archive's ranges alone and
    is hashed where it is read; a replica without records has no roots, so that all of the other are missing or extra;
    an empty table gives an empty result; further columns are ignored. What is no record in a file that ``read_warc`` reads
    becomes a row of kind ``unreadable`` with the bytes up to the next record.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from framequill.session import load, ship, spool

ship(__name__)

LEAF_BITS = 14
FAN_BITS = 4
LEVELS = 8  # 14 + 8 * 4 bits: archives up to 64 TB
ARCHIVE_BYTES = 4 << 20
SCHEMA = "offset long, record_id string, kind string, uri string, content binary"


def record(identifier: Column, uri: Column, content: Column) -> Column:
    """A WARC 1.1 resource record as bytes."""
    body = F.encode(F.coalesce(content, F.lit("")), "UTF-8")
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:record:"), F.coalesce(identifier.cast("string"), F.lit("none")),
        F.lit(">\r\nWARC-Target-URI: "), F.coalesce(uri, F.lit("")), F.lit("\r\nWARC-Block-Digest: sha256:"), F.sha2(body, 256),
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"))
    return F.concat(F.encode(head, "UTF-8"), body, F.encode(F.lit("\r\n\r\n"), "UTF-8"))


def archived(
    pages: DataFrame, id_col: str, uri_col: str, content_col: str, archive_bytes: int = ARCHIVE_BYTES,
    derived: Callable[[Column], dict[str, Column]] = lambda record: {"record": record},
) -> DataFrame:
    """(id, archive, offset, length, sha, ...): records dealt round by identifier to archives of about ``archive_bytes``.

    Lengths, hashes and what ``derived`` makes of a record are computed where the page is read; only they are
    written and shuffled, so the bytes of records stay behind unless they are asked for.
    """
    rows = pages.select(F.col(id_col).alias("id"), record(F.col(id_col), F.col(uri_col), F.col(content_col)).alias("record"))
    slim = spool(rows.select("id", F.octet_length("record").cast("long").alias("length"), F.sha2("record", 256).alias("sha"),
                             *[c.alias(k) for k, c in derived(F.col("record")).items()]), "records")
    total = slim.agg(F.sum("length")).first()[0] or 0
    n = max(1, -(-total // archive_bytes))
    order = Window.partitionBy("archive").orderBy(F.col("id").asc_nulls_last(), "sha")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    return (slim.withColumn("archive", F.coalesce(F.pmod("id", F.lit(n)), F.pmod(F.xxhash64("sha"), F.lit(n))).cast("long"))
            .withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0).cast("long"))))


def members(content: bytes) -> Iterator[tuple[int, bytes]]:
    """(offset in the file, bytes) of the gzip members of a file; a plain file is one."""
    import zlib

    if content[:2] != b"\x1f\x8b":
        yield 0, content
        return
    rest = memoryview(content)
    while len(rest):
        unpack = zlib.decompressobj(wbits=31)
        try:
            held = unpack.decompress(rest) + unpack.flush()
        except zlib.error:
            yield len(content) - len(rest), bytes(rest)
            return
        yield len(content) - len(rest), held
        rest = rest[len(rest) - len(unpack.unused_data) :] if unpack.eof else rest[:0]


def parse(content: bytes) -> Iterator[tuple[int, str, str, str, bytes]]:
    """(offset, record id, type, address, block) of the records of a WARC file, plain or gzipped by record.

    A record in a gzip member lies where the member begins, as archive indexes have it.
    """
    for begin, held in members(content):
        packed, at = held is not content, 0
        while at < len(held):
            split = held.find(b"\r\n\r\n", at) if held.startswith(b"WARC/", at) else -1
            if split < 0:
                upto = held.find(b"\r\n\r\nWARC/", at)
                upto = upto + 4 if upto >= 0 else len(held)
                yield begin if packed else at, "", "unreadable", "", held[at:upto]
                at = upto
                continue
            lines = held[at:split].decode("utf-8", "replace").split("\r\n")[1:]
            fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
            size = fields.get("content-length", "")
            size = int(size) if size.isdecimal() else 0
            yield begin if packed else at, fields.get("warc-record-id", ""), fields.get("warc-type", ""), fields.get("warc-target-uri", ""), held[split + 4 : split + 4 + size]
            at = split + 4 + size
            at += 4 * held.startswith(b"\r\n\r\n", at)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """(path, offset, record_id, kind, uri, content) of the WARC files under ``path``."""

    def run(frames):
        import pandas as pd

        def table(rows):
            return pd.DataFrame(rows, columns=["path", "offset", "record_id", "kind", "uri", "content"])

        for frame in frames:
            for name, content in zip(frame["path"], frame["content"]):
                rows, size = [], 0
                for row in parse(bytes(content)):
                    rows.append((name, *row))
                    size += len(row[-1])
                    if size > 4 << 20:
                        yield table(rows)
                        rows, size = [], 0
                if rows:
                    yield table(rows)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, f"path string, {SCHEMA}")


def hashes(records: DataFrame) -> DataFrame:
    return records.select("archive", "offset", "sha")


def leaves(records: DataFrame) -> DataFrame:
    """(archive, node, sha) of level 0 from (archive, offset, sha)."""
    entries = F.transform(F.sort_array(F.collect_list(F.struct("offset", "sha"))), lambda e: F.concat(e["offset"].cast("string"), F.lit(":"), e["sha"]))
    return records.groupBy("archive", F.shiftright("offset", LEAF_BITS).alias("node")).agg(F.sha2(F.array_join(entries, "\n"), 256).alias("sha"))


def above(nodes: DataFrame) -> DataFrame:
    """The next level: a node's hash covers its children's numbers and hashes in order."""
    entries = F.transform(F.sort_array(F.collect_list(F.struct("node", "sha"))), lambda e: F.concat(e["node"].cast("string"), F.lit(":"), e["sha"]))
    return nodes.groupBy("archive", F.shiftright("node", FAN_BITS).alias("up")).agg(F.sha2(F.array_join(entries, "\n"), 256).alias("sha")).withColumnRenamed("up", "node")


def tree(records: DataFrame) -> list[DataFrame]:
    """Levels from the leaves to the roots; a level is written only while it has several nodes in some archive."""
    levels = [spool(leaves(records), "leaves")]
    while len(levels) <= LEVELS and (levels[-1].agg(F.max("node")).first()[0] or 0) > 0:
        levels.append(spool(above(levels[-1]), "nodes"))
    return levels


def differing(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Keys whose hashes differ or that only one side has."""
    other = b.withColumnRenamed("sha", "other")
    return a.join(other, keys, "full_outer").where(~F.col("sha").eqNullSafe(F.col("other"))).select(*keys, "sha", "other")


def audit(a: DataFrame, b: DataFrame) -> DataFrame:
    """(archive, offset, status) of records (archive, offset, sha) that replica ``b`` lacks, has beyond ``a``, or has otherwise.

    Archives are compared from the roots down; trees of different height are raised to the same.
    """
    one, two = tree(a), tree(b)
    while len(one) < len(two):
        one.append(spool(above(one[-1]), "nodes"))
    while len(two) < len(one):
        two.append(spool(above(two[-1]), "nodes"))
    open_ = None
    for left, right in zip(reversed(one), reversed(two)):
        if open_ is not None:
            up = open_.select("archive", F.col("node").alias("up"))
            left, right = (x.withColumn("up", F.shiftright("node", FAN_BITS)).join(up, ["archive", "up"], "left_semi").drop("up") for x in (left, right))
        open_ = spool(differing(left, right, ["archive", "node"]), "differing")
    within = open_.select("archive", "node")
    a, b = (x.withColumn("node", F.shiftright("offset", LEAF_BITS)).join(within, ["archive", "node"], "left_semi").drop("node") for x in (a, b))
    status = F.when(F.col("other").isNull(), "missing").when(F.col("sha").isNull(), "extra").otherwise("corrupt")
    return differing(a, b, ["archive", "offset"]).select("archive", "offset", status.alias("status"))


def op5_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as a record, audited against a replica damaged by rule: page_id % 101 = 7 altered, page_id % 257 = 11 lost."""
    damaged = lambda record: {"damaged": F.sha2(F.concat(record, F.encode(F.lit("!"), "UTF-8")), 256)}
    slim = spool(archived(load(spark, sf_dir, "pages"), "page_id", "url", "html", derived=damaged), "placed")
    replica = slim.where("id is null or id % 257 <> 11").select("archive", "offset", F.when(F.expr("id % 101 = 7"), F.col("damaged")).otherwise(F.col("sha")).alias("sha"))
    found = audit(hashes(slim), replica)
    return slim.join(found, ["archive", "offset"], "left").select(
        F.col("id").alias("page_id"), "archive", "offset", "length", F.col("sha").alias("record_sha256"), F.coalesce("status", F.lit("intact")).alias("status"))


OP5_SQL = r"""
with b as (
  select page_id, concat('WARC/1.1', chr(13), chr(10), 'WARC-Type: resource', chr(13), chr(10), 'WARC-Record-ID: <urn:record:', cast(page_id as varchar), '>', chr(13), chr(10),
         'WARC-Target-URI: ', coalesce(url, ''), chr(13), chr(10), 'WARC-Block-Digest: sha256:', sha256(coalesce(html, '')), chr(13), chr(10),
         'Content-Type: text/html', chr(13), chr(10), 'Content-Length: ', cast(strlen(coalesce(html, '')) as varchar), chr(13), chr(10), chr(13), chr(10),
         coalesce(html, ''), chr(13), chr(10), chr(13), chr(10)) as record
  from pages
), n as (select greatest(1, cast(ceil(sum(strlen(record)) / 4194304.0) as bigint)) as n from b),
r as (
  select page_id, page_id % n.n as archive, cast(strlen(record) as bigint) as length, sha256(record) as record_sha256 from b, n
)
select page_id, cast(archive as bigint) as archive,
       cast(coalesce(sum(length) over (partition by archive order by page_id rows between unbounded preceding and 1 preceding), 0) as bigint) as "offset",
       length, record_sha256,
       case when page_id % 257 = 11 then 'missing' when page_id % 101 = 7 then 'corrupt' else 'intact' end as status
from r
"""
