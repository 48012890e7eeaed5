import random
import re

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def ascii_lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", ascii_lower(text or ""))


def prose(rng, n, vocabulary=2000):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def table(spark, rows, schema=DOCS):
    """Rows (doc_id, text[, lang[, source]])."""
    full = [(*r, *(None,) * (4 - len(r)), None if r[1] is None else len(r[1])) for r in rows]
    return spark.createDataFrame(full, schema)


def edge_rows():
    """Nulls, empties, very long texts, ties, repeated rows."""
    rng = random.Random(7)
    long_ = prose(rng, 30000)
    return [
        (1, None, None, None), (2, "", "en", "a"), (3, "   \t\n", "en", "a"), (4, "one", "en", None), (5, "one", "en", "b"), (6, long_, "en", "b"),
        (7, long_ + " tail", "en", "b"), (8, "Same words here in this order", "en", "c"), (9, "same words here in this order", "en", "c"),
        (10, "10 + 10 = 20!", "en", "c"), (10, "10 + 10 = 20!", "en", "c"), (None, "no identifier at all", "en", "a"), (None, None, None, "a"),
        (-3, "negative id", "fr", "a"), (11, "漢字 かな 한글", "ja", "a"),
    ]


def odd_columns(df):
    """The table with columns whose names an operator might use itself."""
    from pyspark.sql import functions as F

    for name in ("id", "key", "n", "path", "row", "digest", "size", "part", "node", "block", "g", "copies", "words", "payload", "sig"):
        df = df.withColumn(name, F.lit("x"))
    return df
