import pandas as pd
from pyspark.sql import functions as F

from framequill.functions import text
from framequill.plans import registry
from tests.oracle import connect, same

LONG = "https://blog.example.net/en/" + "4" * 120 + "?utm_source=feed"


def pages(folder, urls):
    pd.DataFrame({"page_id": range(len(urls)), "url": urls}).to_parquet(f"{folder}/pages.parquet")
    return str(folder)


def test_long_media_are_one_line(spark, tmp_path):
    at = pages(tmp_path, [LONG] * 6 + ["http://a.b/c"] * 6)
    same(registry.QUERIES["media_passthrough"](spark, at), connect(at), registry.SQL["media_passthrough"])
    uri = spark.range(1).select(text.data_uri(F.lit("a/b"), F.lit("x" * 500).cast("binary"))).first()[0]
    assert "\r" not in uri and "\n" not in uri


def test_long_media_come_back_whole(spark, tmp_path):
    at = pages(tmp_path, [LONG[: 40 + 9 * i] for i in range(14)])
    same(registry.QUERIES["media_uris"](spark, at), connect(at), registry.SQL["media_uris"])


def test_pages_without_an_address_keep_their_type(spark, tmp_path):
    at = pages(tmp_path, [None, "", "\x00", "é\U0001f600\r\n" * 30, LONG])
    same(registry.QUERIES["media_uris"](spark, at), connect(at), registry.SQL["media_uris"])


def test_escapes_cost_by_the_runs_that_need_them(spark):
    import json

    said = ["", "a", "aéb\U0001f600\U0001f601c", "\x80", '\t"q"\\ü\n', "$1日本"]
    body = text.canonical({"b": F.col("v"), "a": F.lit(1)}, ascii_only=True)
    found = spark.createDataFrame([(v,) for v in said], "v string").select("v", body.alias("c"))
    assert [r["c"] for r in found.collect()] == [json.dumps({"a": 1, "b": v}, separators=(",", ":")) for v in said]
    assert "sequence(" not in found._jdf.queryExecution().optimizedPlan().toString()  # no step for each character
