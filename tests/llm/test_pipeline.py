"""The registered queries and the pipeline's stages against plain Python on the smallest tables."""

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from framequill.llm.registry import QUERIES
from framequill.session import load, spool
from tests.llm.helpers import words
from tests.llm.test_dedup import brute_components
from tests.llm.test_models import base_scores
from tests.llm.test_rest import check_packing, edited, level_targets


@pytest.fixture(scope="module")
def documents(spark, sf_dir):
    return sorted((r["doc_id"], r["text"], r["lang"], r["source"]) for r in load(spark, sf_dir, "documents").collect())


def exact_kept(rows):
    groups = defaultdict(list)
    for d, t, *_ in rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", "", t or "")].append((-len(t or ""), d))
    return {min(g)[1] for g in groups.values()}


def check_targets(rows, taken):
    sizes, largest = Counter(), Counter()
    for d, t, _, s in rows:
        sizes[s] += len(words(t))
        largest[s] = max(largest[s], len(words(t)))
    want = level_targets(sizes)
    for s in sizes:
        assert abs(taken[s] - want[s]) <= max(1, 0.5 * largest[s]), s


def test_stages_do_what_they_say(spark, sf_dir, documents):
    docs, seen = load(spark, sf_dir, "documents"), {}
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        docs = spool(stage(spark, docs, sf_dir), name)
        seen[name] = docs.collect()
        assert name == corpus_pipeline.STAGES[-1][0] or docs.columns == columns
    as_rows = lambda name: sorted((r["doc_id"], r["text"], r["lang"], r["source"]) for r in seen[name])
    language, exact, near, mixed = (as_rows(n) for n in ("language_id", "exact_dedup", "near_dedup", "mixing"))
    assert set(language) <= set(documents) and len(language) >= 0.98 * len(documents)
    assert {r[0] for r in exact} == exact_kept(language) and len(exact) < len(language)
    labels = brute_components([r[:2] for r in exact])
    assert [r[0] for r in near] == sorted(d for d, c in labels.items() if d == c) and len(near) < len(exact)
    assert max(Counter(r[0] for r in mixed).values()) <= 2 and set(mixed) <= set(near)
    taken = Counter()
    for _, t, _, s in mixed:
        taken[s] += len(words(t))
    check_targets(near, taken)
    check_packing(mixed, seen["packing"], (512, 1024, 2048, 4096))


def test_run_is_the_stages_in_order(spark, sf_dir):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "near_dedup", "mixing", "packing"]
    assert corpus_pipeline.run(spark, sf_dir).count() > 0


def test_mix_query(spark, sf_dir, documents):
    found = {r["doc_id"]: r for r in QUERIES["op3_entropy_mix"](spark, sf_dir).collect()}
    taken = Counter()
    for d, t, _, s in documents:
        assert found[d]["size"] == len(words(t)) and found[d]["taken"] in (0, found[d]["size"], 2 * found[d]["size"])
        taken[s] += found[d]["taken"]
    check_targets(documents, taken)


def test_fingerprint_query(spark, sf_dir, documents):
    import hashlib

    found = {r["doc_id"]: r["edited_sha256"] for r in QUERIES["op4_closed_syncmers"](spark, sf_dir).collect()}
    assert found == {r[0]: hashlib.sha256(t.encode()).hexdigest() for r, t in zip(documents, edited([r[1] for r in documents]))}


def test_packing_query(spark, sf_dir, documents):
    check_packing(documents, QUERIES["op2_best_fit_packing"](spark, sf_dir).collect(), (512, 1024, 2048, 4096))


def test_language_model_query(spark, sf_dir, documents):
    found = {r["doc_id"]: r for r in QUERIES["op6_bloom_lm"](spark, sf_dir).collect()}
    for row, (n, known, total, base) in zip(documents, base_scores(documents)):
        r = found[row[0]]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (n, known, total) and abs(r["base_score"] - base) < 1e-6 * max(1, -base)
        assert r["held_out"] == (zlib.crc32(str(row[0]).encode()) % 10 == 0) and r["score"] < 0


def test_repeats_query(spark, sf_dir, documents):
    first, want = {}, set()
    for d, t, *_ in documents:
        data = t.encode()
        spans = [m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", data)]
        own = {data[spans[i][0] : spans[i + 50][1]] for i in range(len(spans) - 50)}
        want |= {d for p in own if first.get(p, d) != d}
        for p in own:
            first.setdefault(p, d)
    assert {r["doc_id"] for r in QUERIES["op7_substring_dedup"](spark, sf_dir).collect()} == want


def test_quality_query_keeps_good_and_drops_toxic(spark, sf_dir):
    labels = {r["doc_id"]: (r["quality"], r["toxic"]) for r in load(spark, sf_dir, "labels").collect()}
    found = {r["doc_id"]: r["selected"] for r in QUERIES["op8_ordinal_quality"](spark, sf_dir).collect()}
    assert np.mean([found[d] == (label == (1, 0)) for d, label in labels.items()]) > 0.97


def stage(name):
    return dict(corpus_pipeline.STAGES)[name]


def test_stages_take_odd_rows_and_columns(spark, sf_dir):
    from tests.llm.helpers import edge_rows, odd_columns, table

    rows = edge_rows() + [(20 + i, f"plain english words that say number {i} of the same kind of thing over and over", "en", "a") for i in range(20)]
    docs = odd_columns(table(spark, rows))
    for name, run in corpus_pipeline.STAGES[:-1]:
        kept = run(spark, docs, sf_dir)
        assert kept.columns == docs.columns and kept.count() <= 2 * len(rows), name
        assert run(spark, docs.limit(0), sf_dir).count() == 0, name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).count() >= len(rows)


def test_copies_go_by_row_whatever_their_identifiers(spark, sf_dir):
    import random

    from tests.llm.helpers import prose, table

    rng = random.Random(41)
    one, two, three = prose(rng, 80), prose(rng, 80), prose(rng, 80)
    rows = [(1, one), (2, one + " end"), (2, two), (None, two + " end"), (None, three), (None, three + " end"), (7, ""), (8, None)]
    kept = stage("near_dedup")(spark, table(spark, rows), sf_dir).collect()
    texts = Counter(r["text"] for r in kept)
    assert texts == Counter([one, two, "", None, *({three, three + " end"} & set(texts))]) and len(kept) == 5
    exact = stage("exact_dedup")(spark, table(spark, [(1, "a b"), (1, "ab"), (None, "a b"), (None, None), (3, " ")]), sf_dir).collect()
    assert sorted((r["doc_id"], r["text"]) for r in exact) == [(1, "a b"), (3, " ")]
