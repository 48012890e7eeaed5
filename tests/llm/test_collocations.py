import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from framequill.llm import collocations as co
from framequill.llm.registry import QUERIES, SQL
from tests.llm.helpers import ascii_lower, edge_rows, odd_columns, table
from tests.oracle import connect, same


def brute(rows, least, longest=5, top=2000):
    n, f = Counter(), Counter()
    for _, text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", ascii_lower(text or "")):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, longest + 1):
                f.update((lang, tuple(words[i : i + k])) for i in range(len(words) - k + 1))
    held = {key: a for key, a in f.items() if a >= least}
    out = []
    for lang in n:
        found = []
        for (own, p), a in held.items():
            if own != lang or len(p) < 2:
                continue
            if any(o == lang and len(q) > len(p) and b >= a and any(q[i : i + len(p)] == p for i in range(len(q))) for (o, q), b in held.items()):
                continue
            score, cut = min((1000 * a * n[lang] // (held[lang, p[:c]] * held[lang, p[c:]]), c) for c in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), held[lang, p[:cut]], held[lang, p[cut:]]))
        out += [(lang, i, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(found)[:top], 1)]
    return sorted(out)


def found(docs, **options):
    return sorted(tuple(r) for r in co.collocations(docs, **options).collect())


def corpus(rng, n=150):
    phrases = ["new york city", "in the end", "on the other hand of it", "a a a", "Bonne nuit", "zürich see"]
    rows = []
    for i in range(n):
        words = []
        for _ in range(rng.randrange(60)):
            words.append(rng.choice(phrases) if rng.random() < 0.3 else f"w{int(rng.paretovariate(0.6)) % 300}")
            words.append(rng.choice([" ", " ", " ", "  ", "\t", ", ", ".\n", "\r", "\x0b", "? ", " "]))
        rows.append((i, "".join(words), rng.choice(["en", "fr", None, "und"])))
    return rows


@pytest.mark.parametrize("least,buckets,held", [(3, 1 << 16, 1 << 17), (8, 1 << 18, 40), (300, 1 << 16, 1 << 17)])
def test_same_as_brute_force(spark, monkeypatch, least, buckets, held):
    monkeypatch.setattr(co, "HELD", held)
    rows = corpus(random.Random(least)) * (6 if least == 300 else 1)
    want = brute(rows, least)
    assert found(odd_columns(table(spark, rows)).repartition(3), least=least, buckets=buckets) == want and want


def test_limits_ties_and_edges(spark):
    rows = corpus(random.Random(2))
    assert found(table(spark, rows), least=3, top=7) == brute(rows, 3, top=7)
    assert found(table(spark, rows), least=3, longest=2) == brute(rows, 3, longest=2)
    odd = edge_rows()
    assert found(odd_columns(table(spark, odd)), least=2) == brute(odd, 2)
    assert found(table(spark, odd).limit(0)) == [] and found(table(spark, [(1, None, None)])) == []


def test_pruning_lets_nothing_frequent_go(spark):
    rows = corpus(random.Random(9), 400)
    width, least = 16, 20
    docs = table(spark, rows).select("lang", "text")
    rows_ = docs.coalesce(2).mapInArrow(co.passed(1, width, least, 5, None, None), co.SCHEMA)
    full = co.bitmap(rows_.where("chunk is not null"), width, least).value
    counts = Counter()
    for _, text, lang in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", ascii_lower(text)):
            words = re.findall(r"[^\x20\x09]+", piece)
            counts.update((lang, a, b) for a, b in zip(words, words[1:]) if lang)
    import numpy as np

    bits = co.Bits(full, width)
    share = 0
    for (lang, a, b), n in counts.items():
        h = co.hashed(np.array([co.digest(lang.encode())], np.uint64), [np.array([co.digest(w.encode())], np.uint64) for w in (a, b)])
        assert bits.has(h)[0] or n < least
        share += bits.has(h)[0]
    assert share < len(counts) / 2


def test_arithmetic_beyond_64_bits(spark):
    big = 4_000_000_000_000
    row = spark.createDataFrame([(big, 9 * big, 3 * big, 2 * big)], "a long, n long, l long, r long")
    score = row.select(F.expr("(cast(1000 as decimal(4,0)) * cast(a as decimal(15,0)) * cast(n as decimal(18,0))) div (cast(l as decimal(19,0)) * cast(r as decimal(19,0)))")).first()[0]
    assert score == 1000 * big * 9 * big // (6 * big * big)


def test_query_equals_sql(spark, sf_dir):
    same(QUERIES["op13_collocations"](spark, sf_dir), connect(sf_dir), SQL["op13_collocations"])
