"""Exact deduplication by a keyed, disk-backed streaming state.

Every document becomes a message (digest, size, stable identifier, content locator) in a
spool in the shared folder. A Structured Streaming query folds the messages into RocksDB state keyed
by the digest, without watermark or expiry; the state holds, for each digest, the document that stays,
where its content is, and how many have been seen. The state is read back as a table. As digests
only propose, the whole normalised texts of hits, digests seen more than once, are then grouped under their digest: a
digest that stands for more than one text is resolved by the texts themselves. Texts that nothing hit are not looked at again.

With a folder for ``state`` the stream goes on where the last call left it: rows are decided against all rows
of earlier calls, and the bytes of an earlier keeper are read from its locator, a row of a Parquet file that must still be there.
Earlier decisions stand as they were given, so an earlier keeper may lose to a longer later row only from then on.

Defined results
    null text counts as empty; null identifiers sort after all others; of rows that repeat the same
    identifier and text, the first by content locator stays; very long texts are rows like others, and only hits among them
    are shuffled; an empty table gives an empty result; further columns are ignored. A digest that clashes with
    another call's is settled among the rows at hand and the earlier keeper.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from framequill.llm.graph import matching
from framequill.session import load, shared_dir, spool, spool_counted

SPACE = r"[\x20\x09-\x0D]+"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def normalised(text: Column) -> Column:
    """The text without white space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, "")


def sha256_digest(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def located(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text, path, row): where each row's content lies. What is not a plain file scan is spooled first."""
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    try:
        if "_metadata" in docs.columns:
            raise AnalysisException("the column _metadata is the table's own")
        return docs.select(
            F.col(id_col).alias("id"), F.col(text_col).alias("text"),
            F.col("_metadata.file_path").alias("path"), F.col("_metadata.row_index").alias("row"),
        )
    except AnalysisException:
        return spool(slim, "documents").select(
            "id", "text", F.col("_metadata.file_path").alias("path"), F.col("_metadata.row_index").alias("row")
        )


def messages(rows: DataFrame, digest=sha256_digest) -> DataFrame:
    return rows.select(
        "id", "path", "row",
        F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n_chars"),
        digest(normalised(F.col("text"))).alias("digest"),
    )


def best(prefix: str = "") -> Column:
    """Least of this: most code points, then smallest identifier, then first locator."""
    return F.min(F.struct(
        (-F.col("n_chars")).alias("size"), F.col("id").isNull().alias("no_id"), F.col("id"),
        F.col("path"), F.col("row"),
    ))


def fold(stream: DataFrame) -> DataFrame:
    """The stateful step: one state row per digest, kept for good."""
    return stream.groupBy("digest").agg(best().alias("keeper"), F.count(F.lit(1)).alias("group_size"))


def run_stream(spark: SparkSession, base: str, schema, max_bytes: int, max_files: int | None = None) -> DataFrame:
    """Drain the spool under ``base`` through the stateful query; its state as (digest, keeper, group_size)."""
    conf = {
        "spark.sql.streaming.stateStore.providerClass": ROCKSDB,
        "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
        "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
        "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
        "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "128",
        "spark.sql.streaming.stateStore.unloadOnCommit": "true",  # else open stores stay in the executors after the stream
    }
    before = {k: spark.conf.get(k, None) for k in conf}
    reader = spark.readStream.schema(schema).option("recursiveFileLookup", "true")
    reader = reader.option("maxFilesPerTrigger", max_files) if max_files else reader.option("maxBytesPerTrigger", max_bytes)
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        query = (fold(reader.parquet(f"{base}/messages")).writeStream.format("noop").outputMode("update")
                 .option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start())
        query.awaitTermination()
        table = spark.read.format("statestore").load(f"{base}/state")
        return spool(table.select(
            F.col("key.digest").alias("digest"), F.col("value.min").alias("keeper"),
            F.col("value.count").alias("group_size"),
        ), "state")
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def earlier_keepers(spark: SparkSession, decided: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text, path, row) of keepers that lie in files of earlier calls."""
    keepers = spool(decided.where("not here").select(F.col("keeper.path").alias("path"), F.col("keeper.row").alias("row")).distinct(), "keepers")
    files = [r[0] for r in keepers.select("path").distinct().collect()]  # names of input files
    if not files:
        return decided.select("id", F.lit("").alias("text"), "path", "row").limit(0)
    return located(spark.read.parquet(*files), id_col, text_col).join(keepers, ["path", "row"], "left_semi").select("id", "text", "path", "row")


def exact_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest=sha256_digest,
    max_bytes_per_trigger: int = 1 << 36, max_files_per_trigger: int | None = None, state: str | None = None,
) -> DataFrame:
    """Decide which row of each set of equal texts stays.

    Returns (id, path, row, digest, keep_id, keep_path, keep_row, group_size, kept), a row per row of ``docs``. ``state`` names
    a shared folder that carries the keyed state from call to call; without it each call begins anew.
    """
    spark = docs.sparkSession
    rows = located(docs, id_col, text_col)
    log = messages(rows, digest)
    base = state or shared_dir(spark)
    folder = f"{base}/messages/{uuid.uuid4().hex}"
    log.write.parquet(folder)
    table = run_stream(spark, base, log.schema, max_bytes_per_trigger, max_files_per_trigger)
    log = spark.read.schema(log.schema).parquet(folder)
    decided = log.select("id", "path", "row", "digest").join(table, "digest")

    # Full bytes on hits: one row per text that a partition holds goes to the shuffle, not one per copy.
    whole = normalised(F.col("text"))
    hits, n = spool_counted(table.where("group_size > 1").select(F.xxhash64("digest").alias("hit")).distinct(), "hits")
    if state:
        files = log.select(F.col("path").alias("own")).distinct()
        decided = spool(decided.join(files.withColumn("here", F.lit(True)), F.col("keeper.path") == F.col("own"), "left").drop("own")
                        .withColumn("here", F.coalesce("here", F.lit(False))), "decided")
        rows = rows.unionByName(earlier_keepers(spark, decided, id_col, text_col))
        decided = decided.drop("here")
    hit = matching(rows.select("*", whole.alias("whole")).select("*", digest(F.col("whole")).alias("digest"))
                   .withColumn("hit", F.xxhash64("digest")), hits, "hit", "left_semi", n["n"]).drop("hit")
    texts = hit.groupBy("digest", "whole").agg(F.count(F.lit(1)).alias("n"))
    clashing, n = spool_counted(texts.groupBy("digest").agg(F.count(F.lit(1)).alias("texts")).where("texts > 1").select("digest"), "clashing")
    if n["n"]:
        disputed = spool(hit.withColumn("n_chars", F.length(F.coalesce("text", F.lit(""))).cast("long")).join(clashing, "digest", "left_semi"), "disputed")
        settled = disputed.groupBy("digest", "whole").agg(best().alias("keeper"), F.count(F.lit(1)).alias("group_size"))
        again = disputed.join(settled, ["digest", "whole"]).join(log.select("path", "row"), ["path", "row"], "left_semi")
        decided = decided.join(clashing, "digest", "left_anti").unionByName(again.select(decided.columns))
    return decided.select(
        "id", "path", "row", "digest",
        F.col("keeper.id").alias("keep_id"), F.col("keeper.path").alias("keep_path"), F.col("keeper.row").alias("keep_row"),
        F.col("group_size").cast("long").alias("group_size"),
        ((F.col("path") == F.col("keeper.path")) & (F.col("row") == F.col("keeper.row"))).alias("kept"),
    )


def on_files(docs: DataFrame) -> DataFrame:
    """``docs`` itself if it is a plain scan of files, else what it holds, spooled: rows with places that ``located`` tells."""
    try:
        if "_metadata" in docs.columns:
            raise AnalysisException("the column _metadata is the table's own")
        docs.select("_metadata.file_path", "_metadata.row_index")
        return docs
    except AnalysisException:
        return spool(docs.withColumnRenamed("_metadata", "_metadata of the table"), "documents")


def without_rows(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """The rows of ``docs``, as ``on_files`` gave it, without those at the places (path, row) of ``dropped``."""
    path, row = (f"{name} {uuid.uuid4().hex}" for name in ("path", "row"))
    placed = docs.select("*", F.col("_metadata.file_path").alias(path), F.col("_metadata.row_index").alias(row))
    keys, n = spool_counted(dropped.select(F.col("path").alias(path), F.col("row").alias(row)), "dropped")
    kept = matching(placed, keys, [path, row], "left_anti", n["n"]).drop(path, row)
    return kept.withColumnRenamed("_metadata of the table", "_metadata")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup(load(spark, sf_dir, "documents"))
    return found.select(
        F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


OP1_SQL = r"""
with d as (
  select doc_id, length(coalesce(text, '')) as n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') as norm
  from documents
), r as (
  select doc_id,
         first_value(doc_id) over (partition by norm order by n desc, doc_id) as keep_id,
         count(*) over (partition by norm) as group_size,
         sha256(norm) as text_sha256
  from d
)
select doc_id, keep_id, cast(group_size as bigint) as group_size, doc_id = keep_id as kept, text_sha256 from r
"""
