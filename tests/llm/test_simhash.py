import random

import numpy as np
import pyarrow as pa
import xxhash

from framequill.llm import simhash
from framequill.llm.registry import QUERIES
from framequill.session import load
from tests.llm.helpers import edge_rows, odd_columns, prose, table, words


def plain(text):
    own = words(text)
    runs = [" ".join(own[i : i + 4]) for i in range(len(own) - 3)] if len(own) >= 4 else [" ".join(own)] if own else []
    hashes = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def brute(rows):
    """(id, fingerprint, component) by comparing all rows."""
    prints = [plain(t) for _, t, *_ in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 4:
                root[find(i)] = find(j)
    least = {}
    for i, (d, *_) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted((d is None, d or 0, signed(p), least.get(find(i)) or 0) for i, ((d, *_), p) in enumerate(zip(rows, prints)))


def found(docs, **options):
    return sorted((r["id"] is None, r["id"] or 0, r["fp"], r["component"] or 0) for r in simhash.similar(docs, **options).collect())


def test_code_is_perfect():
    error = simhash.CODE.error
    assert len(set(error.tolist())) == 2048 and max(int(e).bit_count() for e in error) == 3
    for w in np.random.default_rng(1).integers(0, 1 << 23, 300, dtype=np.uint32):
        s = simhash.CODE.syndrome(np.array([w], np.uint32))
        assert simhash.CODE.syndrome(np.array([w], np.uint32) ^ error[s])[0] == 0


def test_prints_up_to_four_bits_apart_share_a_key():
    rng = np.random.default_rng(3)
    a = rng.integers(-(1 << 63), 1 << 63, 4000, dtype=np.int64)
    for bits in range(5):
        flips = np.array([sum(1 << int(b) for b in rng.choice(64, bits, replace=False)) for _ in a], np.uint64)
        b = (a.view(np.uint64) ^ flips).view(np.int64)
        one, two = ({}, {})
        for held, table_ in ((one, a), (two, b)):
            for k, r in zip(*(x.tolist() for x in simhash.keys(table_))):
                held.setdefault(r, set()).add(k)
        assert all(one[i] & two[i] for i in range(len(a))), bits
    assert max(map(len, one.values())) <= 3 * (6 + 6 + 36)


def test_fingerprints_of_odd_and_long_texts(monkeypatch):
    rng = random.Random(4)
    texts = [None, "", " \t\n", "One", "one  TWO\x0bthree", "a b c d", "É é x y z", prose(rng, 3000), "x" * 5000 + " y z " + "w" * 9000 + " tail end of it", " " * 9000 + "p q"]
    whole = simhash.fingerprints(pa.array(texts)).tolist()
    assert whole == [signed(plain(t)) for t in texts]
    monkeypatch.setattr(simhash, "WINDOW", 512)
    monkeypatch.setattr(simhash, "SHINGLES", 100)
    assert simhash.fingerprints(pa.array(texts)).tolist() == whole
    assert simhash.fingerprints(pa.array(texts)[3:]).tolist() == whole[3:] and simhash.fingerprints(pa.array([], pa.string())).tolist() == []


def test_families_copies_and_blocks(spark):
    rng = random.Random(5)
    rows, n = [], 0
    for _ in range(12):
        base = prose(rng, 400).split()
        for _ in range(rng.randrange(1, 9)):
            own = base[:]
            for _ in range(rng.randrange(6)):
                own[rng.randrange(len(own))] = f"e{rng.randrange(99)}"
            rows += [(n := n + 1, " ".join(own))] * rng.choice([1, 1, 1, 2])
    rows += [(n + i, None if i % 2 else "") for i in range(1, 5)] + [(None, rows[0][1])]
    docs = odd_columns(table(spark, rows)).repartition(5)
    want = brute(rows)
    assert found(docs) == want and found(docs, block=2) == want


def test_edges_and_empty(spark):
    rows = edge_rows()
    assert found(odd_columns(table(spark, rows))) == brute(rows)
    assert found(table(spark, rows).limit(0)) == []


def test_query_against_brute_force(spark, sf_dir):
    docs = [(r["doc_id"], r["text"]) for r in load(spark, sf_dir, "documents").collect()]
    got = QUERIES["op11_golay_simhash"](spark, sf_dir)
    assert got.columns[:3] == ["doc_id", "fingerprint", "component_id"]
    assert sorted((False, r["doc_id"], signed(int(r["fingerprint"], 16)), r["component_id"]) for r in got.collect()) == brute(docs)
