import itertools
import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from framequill.llm import exact_dedup, near_dedup, registry, substring_dedup
from framequill.llm.graph import components, contract, starred
from tests.llm.helpers import edge_rows, odd_columns, prose, table, words
from tests.oracle import connect, same


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_equals_sql(spark, sf_dir, name):
    same(registry.QUERIES[name](spark, sf_dir), connect(sf_dir), registry.SQL[name])


def decided(docs, **options):
    return sorted((r["id"] is None, r["id"] or 0, r["keep_id"] or 0, r["group_size"], r["kept"]) for r in exact_dedup.exact_dedup(docs, **options).collect())


def brute(rows):
    groups = {}
    for i, (d, text, *_) in enumerate(rows):
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", "", text or ""), []).append((-len(text or ""), d is None, d or 0, i))
    return sorted((no_id, d, min(g)[2], len(g)) for g in groups.values() for _, no_id, d, _ in g)


def test_exact_edges(spark):
    rows = edge_rows()
    found = decided(odd_columns(table(spark, rows)).coalesce(1))
    assert [f[:4] for f in found] == brute(rows)
    assert sum(f[4] for f in found) == len({re.sub(r"[\x20\x09-\x0D]+", "", r[1] or "") for r in rows})


def test_exact_over_many_batches(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice(["a b", "ab", " a  b ", "c", None, ""]) if i % 3 else prose(rng, 5)) for i in range(300)]
    docs = table(spark, rows).repartition(7)
    one, many = decided(docs), decided(docs, max_files_per_trigger=1)
    assert [f[:4] for f in one] == brute(rows) and one == many


def test_exact_settles_clashing_digests_by_whole_texts(spark):
    rows = [(i, t) for i, t in enumerate(["alpha", "beta", "alpha", "gamma", "be ta", "alpha "])]
    found = decided(table(spark, rows).coalesce(1), digest=lambda t: F.substring(F.unhex(F.sha2(t, 256)), 1, 0))
    assert [f[:4] for f in found] == brute(rows)


def test_exact_empty(spark):
    assert decided(table(spark, [(1, "x")]).limit(0)) == []


def linked(a, b):
    sets = []
    for t in (a, b):
        w = words(t)
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    x, y = sets
    return bool(x and y) and 100 * len(x & y) >= 75 * len(x | y)


def brute_components(rows):
    label = {d: d for d, *_ in rows}
    changed = True
    links = [(a[0], b[0]) for a, b in itertools.combinations(rows, 2) if linked(a[1], b[1])]
    while changed:
        changed = False
        for a, b in links:
            low = min(label[a], label[b])
            if label[a] != low or label[b] != low:
                label[a] = label[b] = low
                changed = True
    return label


def family(rng, start, n, size, edits):
    base = prose(rng, size).split()
    rows = []
    for i in range(n):
        own = list(base)
        for _ in range(rng.randrange(edits)):
            own[rng.randrange(size)] = f"x{rng.randrange(10**6)}"
        rows.append((start + i, " ".join(own)))
    return rows


@pytest.mark.parametrize("block", [3, 1024])
def test_near_components_equal_brute_force(spark, block):
    rng = random.Random(3)
    rows = [r for k in range(6) for r in family(rng, 100 * k, 14, 200, 1 + 4 * k)] + [(900 + i, prose(rng, rng.randrange(1, 60))) for i in range(40)]
    rows += [(990, "a b c"), (991, "A  b\tc"), (992, "a b"), (993, None), (994, "")]
    want = brute_components(rows)
    found = {r["id"]: r["component"] for r in near_dedup.near_components(table(spark, rows), block=block).collect()}
    assert found == want and len(set(want.values())) < len(rows)


def test_near_edges(spark):
    rows = edge_rows()
    found = near_dedup.near_components(odd_columns(table(spark, rows))).collect()
    assert len(found) == len(rows)
    by_id = {r["id"]: r for r in found if r["id"] is not None}
    assert by_id[4]["component"] == by_id[5]["component"] == 4 and by_id[6]["component"] == by_id[7]["component"] == 6
    assert by_id[8]["component"] == by_id[9]["component"] == 8 and by_id[1]["n"] == by_id[2]["n"] == by_id[3]["n"] == 0 and by_id[3]["component"] == 3
    assert near_dedup.near_components(table(spark, rows).limit(0)).count() == 0


def test_posterior_cutoffs():
    rules = near_dedup.cutoffs(128, 0.75, 1e-5)
    assert [n for n, _ in rules] == [32, 64, 96, 128] and all(0 < m < 0.75 * n for n, m in rules)
    assert rules == sorted(rules) and near_dedup.cutoffs(128, 0.75, 1e-9)[3][1] < rules[3][1]


@pytest.mark.parametrize("per_task", [5, 1 << 20])
def test_components_of_a_path_and_a_star(spark, per_task):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(30)] + [(7, 7), (-5, 60)]
    found = {r["u"]: r["v"] for r in components(spark.createDataFrame(edges, "a long, b long"), per_task=per_task).collect()}
    assert found == {**{i: 0 for i in range(1, 41)}, **{100 + i: 100 for i in range(1, 30)}, 60: -5}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_that_do_not_settle_are_an_error(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)], "a long, b long").repartition(8)
    with pytest.raises(RuntimeError, match="not settled"):
        components(edges, per_task=5, rounds=1)


def test_contraction_keeps_the_components():
    import numpy as np

    rng = np.random.default_rng(4)
    a, b = rng.integers(0, 400, (2, 300))
    label = {int(n): int(n) for n in np.concatenate([a, b])}
    for _ in range(400):
        for x, y in zip(a.tolist(), b.tolist()):
            label[x] = label[y] = min(label[x], label[y])
    u, v = starred(a, b)
    assert dict(zip(u.tolist(), v.tolist())) == {k: m for k, m in label.items() if k != m}
    batches = [pa.RecordBatch.from_arrays([pa.array(a[i : i + 7]), pa.array(b[i : i + 7])], ["a", "b"]) for i in range(0, 300, 7)]
    parts = list(contract(iter(batches), most=20))
    again = starred(*(np.concatenate([p.column(j).to_numpy() for p in parts]) for j in (0, 1)))
    assert len(parts) > 1 and dict(zip(again[0].tolist(), again[1].tolist())) == dict(zip(u.tolist(), v.tolist()))


def test_rows_that_share_an_identifier_are_compared_each(spark):
    rng = random.Random(31)
    text, other = prose(rng, 100), prose(rng, 100)
    rows = [(1, text), (2, text + " end"), (2, other), (None, text + " more"), (None, other + " more"), (None, prose(rng, 40))]
    found = near_dedup.near_components(table(spark, rows).coalesce(1)).orderBy("row").collect()
    assert [r["component"] for r in found] == [1, 1, 2, 1, 2, None]
    assert [r["stays"] for r in found] == [True, False, True, False, False, True]


def test_repeats_are_exact_and_maximal(spark):
    rng = random.Random(9)
    passage, short = prose(rng, 70, 10**6), prose(rng, 50, 10**6)
    rows = [(1, f"{prose(rng, 80)} {passage} {prose(rng, 9)}"), (2, f"zz {passage}. {prose(rng, 200)}"), (3, f"{prose(rng, 30)} {short} q"),
            (4, f"{short} {prose(rng, 90)}"), (5, f"é {passage}"), (6, prose(rng, 300)), (7, None), (8, ""), (None, passage), (9, "en " * 3000), (10, "en " * 2000)]
    found = {(r["id"], r["keep_id"]): r for r in substring_dedup.repeats(odd_columns(table(spark, rows))).collect()}
    text = dict(r for r in rows if r[0])
    assert set(found) == {(2, 1), (5, 1), (10, 9)}
    assert found[5, 1]["start"] == 2 and found[5, 1]["words"] == 70
    for (d, keep), r in found.items():
        held = text[d][r["start"] : r["start"] + r["length"]]
        assert held in text[keep] and len(held.split()) == r["words"] and (d == 10 or held in passage)
    docs = table(spark, rows)
    rest = {r["doc_id"]: r["text"] for r in substring_dedup.without_repeats(docs, substring_dedup.repeats(docs)).collect() if r["doc_id"]}
    assert rest[5] == "é " and rest[6] == text[6] and rest[7] is None and passage not in rest[2]
    assert substring_dedup.repeats(docs.limit(0)).count() == 0


def test_a_passage_that_the_earliest_document_has_in_pieces_is_found(spark):
    rng = random.Random(12)
    rows, n = [], 0
    for k in range(12):
        passage = prose(rng, 60, 10**6).split()
        pieces = list(passage)
        pieces[20 + k], pieces[40] = "other", "another"
        rows += [(n, f"{prose(rng, 40)} {' '.join(pieces)} {prose(rng, 20)}"), (n + 1, f"{prose(rng, 30)} {' '.join(passage)} {prose(rng, 50)}"), (n + 2, f"{' '.join(passage)} {prose(rng, 50)}")]
        n += 3
    found = {(r["id"], r["keep_id"]): (r["start"], r["words"]) for r in substring_dedup.repeats(table(spark, rows)).collect()}
    assert found == {(3 * k + 2, 3 * k + 1): (0, 60) for k in range(12)}


def covered(spark, rows, size=51):
    """(words of each document that the reported passages cover, the same by all windows of ``size`` words)."""
    found = {d: set() for d, _ in rows}
    text = dict(rows)
    for r in substring_dedup.repeats(table(spark, rows)).collect():
        at = len(text[r["id"]][: r["start"]].split())
        found[r["id"]] |= set(range(at, at + r["words"]))
    want, seen = {d: set() for d, _ in rows}, set()
    for d, t in sorted(rows):
        w = t.split()
        windows = [tuple(w[i : i + size]) for i in range(len(w) - size + 1)]
        want[d].update(*(range(i, i + size) for i, x in enumerate(windows) if x in seen))
        seen |= set(windows)
    return found, want


def test_a_further_passage_in_pieces_is_found_in_a_reported_document(spark):
    rng = random.Random(21)
    rows, n = [], 0
    for k in range(12):
        whole, passage = prose(rng, 70, 10**6), prose(rng, 60, 10**6).split()
        pieces = list(passage)
        pieces[20 + k], pieces[40] = "other", "another"
        both = f"{' '.join(passage)} {prose(rng, 3 * (k % 3))} {whole}".replace("  ", " ")
        rows += [(n, f"{prose(rng, 40)} {' '.join(pieces)} {prose(rng, 20)} {whole}"), (n + 1, f"{prose(rng, 30)} {' '.join(passage)} {prose(rng, 50)}"), (n + 2, f"{both} {prose(rng, 50)}")]
        n += 3
    found, want = covered(spark, rows)
    assert found == want and all(len(want[3 * k + 2]) == 130 for k in range(12))


def test_a_passage_that_goes_on_in_another_document_is_found_whole(spark):
    rng = random.Random(22)
    rows = []
    for k in range(12):
        passage = prose(rng, 160, 10**6).split()
        rows += [(4 * k, f"{prose(rng, 20)} {' '.join(passage[:100])} {prose(rng, 20)}"), (4 * k + 1, f"{prose(rng, 20)} {' '.join(passage[60 + k :])} {prose(rng, 9)}"),
                 (4 * k + 2, f"{prose(rng, 9)} {' '.join(passage[30:130])} {prose(rng, 9)}"), (4 * k + 3, f"{prose(rng, 9)} {' '.join(passage)} {prose(rng, 9)}")]
    found, want = covered(spark, rows)
    assert found == want


def test_wide_gaps_and_repeated_identifiers_lose_no_passage(spark):
    rng = random.Random(33)
    passage = prose(rng, 60, 10**6).split()
    wide = "   \n\n\t        ".join(passage)
    other = prose(rng, 70, 10**6)
    rows = [(1, f"{prose(rng, 20)} {wide}"), (1, f"{other} {prose(rng, 30)}"), (2, f"{wide} {prose(rng, 30)}"), (3, f"{prose(rng, 9)} {other}"), (3, "short"), (4, prose(rng, 50))]
    found = {}
    for r in substring_dedup.repeats(table(spark, rows)).collect():  # the second look does not know of which text of an identifier a span is, and may report parts again
        found[r["id"], r["keep_id"]] = max(found.get((r["id"], r["keep_id"]), 0), r["words"])
    assert found == {(2, 1): 60, (3, 1): 70}


def test_chunks_come_back_in_step_after_an_insertion():
    import numpy as np
    import pyarrow as pa

    from framequill.llm.words import text_bytes

    rng = random.Random(2)
    tail = prose(rng, 400)
    _, _, _, words_, digest, _, _ = substring_dedup.chunks(*text_bytes(pa.array([prose(rng, 31) + " " + tail, "insert " + tail])))
    split = np.flatnonzero(np.cumsum(words_) == 431)[0] + 1
    shared = set(digest[:split].tolist()) & set(digest[split:].tolist())
    assert len(shared) > 0.9 * (len(digest) - split)


def test_exact_state_carries_over_to_a_later_call(spark, tmp_path):
    first = [(1, "alpha"), (2, "beta"), (3, "alpha  ")]
    second = [(4, "al pha and more"), (5, "b eta"), (6, "gamma"), (7, "gam ma"), (8, "alpha")]
    for name, rows in {"a": first, "b": second}.items():
        table(spark, rows).coalesce(1).write.parquet(str(tmp_path / name))
    state = str(tmp_path / "state")
    run = lambda name: {r["id"]: (r["keep_id"], r["group_size"]) for r in exact_dedup.exact_dedup(spark.read.parquet(str(tmp_path / name)), state=state).collect()}
    assert run("a") == {1: (3, 2), 2: (2, 1), 3: (3, 2)}
    assert run("b") == {4: (4, 1), 5: (5, 2), 6: (7, 2), 7: (7, 2), 8: (3, 3)}


def test_exact_checks_the_bytes_of_an_earlier_keeper(spark, tmp_path):
    weak = lambda t: F.substring(F.unhex(F.sha2(t, 256)), 1, 0)
    for name, rows in {"a": [(1, "alpha")], "b": [(2, "beta"), (3, "alp ha")]}.items():
        table(spark, rows).coalesce(1).write.parquet(str(tmp_path / name))
    state = str(tmp_path / "state")
    run = lambda name: {r["id"]: r["keep_id"] for r in exact_dedup.exact_dedup(spark.read.parquet(str(tmp_path / name)), digest=weak, state=state).collect()}
    assert run("a") == {1: 1} and run("b") == {2: 2, 3: 3}
