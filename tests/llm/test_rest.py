import hashlib
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from framequill.llm import mixing, packing, syncmers, warc
from tests.llm.helpers import edge_rows, odd_columns, prose, table, words


def level_targets(sizes, weights=(3, 1, 2), share=1.5, most=2.0):
    """Weight shares with the excess over each stop reshared until none is above."""
    keys = sorted(sizes, key=lambda k: (k is None, k))
    weight = {k: weights[i % len(weights)] for i, k in enumerate(keys)}
    total, capped = share * sum(sizes.values()), set()
    while True:
        free = [k for k in keys if k not in capped]
        left = total - sum(most * sizes[k] for k in capped)
        target = {k: most * sizes[k] if k in capped else left * weight[k] / sum(weight[f] for f in free) for k in keys}
        over = {k for k in free if target[k] > most * sizes[k] + 1e-9}
        if not over:
            return target
        capped |= over


def check_mix(found, rows):
    sizes = defaultdict(int)
    for r in rows:
        sizes[r[3]] += len(words(r[1]))
    want, taken, largest = level_targets(sizes), defaultdict(int), defaultdict(int)
    for r in found:
        source = r["key"][1:] if r["key"][0] == "0" else None
        assert r["size"] == len(words(None)) or r["copies"] * r["size"] <= 2 * r["size"]
        assert abs(r["target"] - want[source]) < 1e-6 * max(1, want[source]) and r["source_size"] == sizes[source]
        taken[source] += r["copies"] * r["size"]
        largest[source] = max(largest[source], r["size"])
    for source in sizes:
        assert abs(taken[source] - want[source]) <= max(1, 0.5 * largest[source])


def test_mix_meets_targets(spark):
    rng = random.Random(2)
    rows = [(i, prose(rng, rng.randrange(1, 300)), None, rng.choice(["a", "a", "a", "b", "c", "d", None])) for i in range(800)]
    docs = table(spark, rows)
    found = mixing.mix_rows(docs).collect()
    assert len(found) == 800
    check_mix(found, rows)
    again = mixing.mix_rows(docs.repartition(5)).collect()
    assert sorted((r["row"]["doc_id"], r["copies"]) for r in found) == sorted((r["row"]["doc_id"], r["copies"]) for r in again)
    rates = {(r["key"], r["size"]): r["rate"] for r in found}
    for key in {k for k, _ in rates}:
        own = [rates[k, s] for k, s in sorted(rates) if k == key and s > 0]
        assert own == sorted(own) or own == sorted(own, reverse=True)
    mixed = mixing.mix_documents(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r["copies"] for r in found)


def test_mix_hot_cells_and_edges(spark):
    rows = [(i, "a b c d", None, "hot") for i in range(900)] + [(1000 + i, "a b", None, "cold") for i in range(10)]
    check_mix(mixing.mix_rows(table(spark, rows)).collect(), rows)
    edges = edge_rows()
    found = mixing.mix_rows(odd_columns(table(spark, edges))).collect()
    assert len(found) == len(edges) and all(r["copies"] == 0 for r in found if r["size"] == 0)
    assert mixing.mix_documents(odd_columns(table(spark, edges))).count() == sum(r["copies"] for r in found)
    assert mixing.mix_rows(table(spark, edges).limit(0)).count() == 0
    assert mixing.mix_rows(table(spark, [(1, None, None, "a"), (2, "", None, "b")])).count() == 2


def check_packing(rows, found, lengths):
    spans, bins = defaultdict(list), defaultdict(list)
    for r in found:
        spans[r["doc_id"]].append((r["start"], r["length"]))
        bins[r["bin_id"]].append((r["place"], r["length"], r["bin_length"]))
    want = defaultdict(int)
    for r in rows:
        want[r[0]] += len(words(r[1])) + 1
    assert {d: sum(n for _, n in s) for d, s in spans.items()} == want
    for held in bins.values():
        at = 0
        for place, length, size in sorted(held):
            assert place == at
            at += length
        assert size == min(l for l in lengths if l >= at)
    return bins


def test_packing_covers_everything(spark):
    rng = random.Random(5)
    rows = [(i, prose(rng, rng.choice([0, 3, 20, 60, 100, 130, 700]))) for i in range(500)] + [r[:2] for r in edge_rows()]
    for per_group in (100, 20000):
        found = packing.best_fit(odd_columns(table(spark, rows)), (64, 128, 256), per_group=per_group).collect()
        bins = check_packing(rows, found, (64, 128, 256))
        used = sum(l for held in bins.values() for _, l, _ in held)
        assert used / sum(held[0][2] for held in bins.values()) > 0.9
    assert packing.best_fit(table(spark, rows).limit(0)).count() == 0
    assert len(packing.best_fit(table(spark, [(7, "a b")] * 3)).collect()) == 3


def test_best_fit_takes_the_least_room_and_the_cheapest_length():
    bins, places, sizes = packing.pack([90, 60, 30, 10, 10], [100])
    assert bins == [0, 1, 1, 1, 0] and places == [0, 0, 60, 90, 90] and sizes == [100, 100]
    cheap = min((packing.cost(c) / c, c) for c in packing.LENGTHS)[1]
    _, _, sizes = packing.pack([300, 10], packing.LENGTHS)
    assert cheap > 512 and sizes == [512]


def spent(used, lengths):
    return sum(packing.cost(min(c for c in lengths if c >= u)) for u in used)


def test_opening_lengths_are_chosen_for_the_filled_bins():
    rng = random.Random(8)
    lengths, below, shrunk = list(packing.LENGTHS), 0, 0
    for spread in (0.5, 0.9, 1.3):
        sizes = sorted((min(4096, max(1, int(rng.lognormvariate(5.5, spread)))) for _ in range(3000)), reverse=True)
        opens = packing.chosen_opens(sizes, lengths)
        bins, _, used = packing.fill(sizes, lengths, opens)
        first = {}
        for size, b in zip(sizes, bins):
            first.setdefault(b, opens[next(i for i, c in enumerate(lengths) if c >= size)])
        held = packing.pack(sizes, lengths)[2]
        assert held == [min(c for c in lengths if c >= u) for u in used]
        shrunk += sum(final < first[b] for b, final in enumerate(held))
        smallest = spent(packing.fill(sizes, lengths, lengths)[2], lengths)
        assert opens != lengths and spent(used, lengths) <= smallest
        below += spent(used, lengths) < 0.99 * smallest
        for i, c in ((i, c) for i in range(4) for c in lengths[i:]):  # no single entry does better
            assert spent(used, lengths) <= spent(packing.fill(sizes, lengths, opens[:i] + [c] + opens[i + 1 :])[2], lengths)
    assert below and shrunk


def test_packing_follows_from_the_rows_alone(spark):
    rng = random.Random(15)
    rows = [(i, prose(rng, rng.choice([3, 60, 300]))) for i in range(200)] + [(None, None)] * 90 + [(7, "the same")] * 50
    docs = table(spark, rows)
    as_rows = lambda df: sorted(map(tuple, df.collect()), key=repr)
    one = as_rows(packing.best_fit(docs, per_group=50, copies=16))
    assert one == as_rows(packing.best_fit(docs.orderBy(F.desc("text")).repartition(5), per_group=50, copies=16)) and len(one) == len(rows)


def test_best_fit_equals_a_plain_search():
    rng = random.Random(1)
    for _ in range(30):
        sizes = sorted((rng.randrange(1, 65) for _ in range(60)), reverse=True)
        bins, _, _ = packing.pack(sizes, [64])
        rooms = []
        for b, s in zip(bins, sizes):
            fits = [r for r in rooms if r >= s]
            if fits:
                assert rooms[b] == min(fits)
                rooms[b] -= s
            else:
                assert b == len(rooms)
                rooms.append(64 - s)


def edited(texts):
    return [t[: len(t) - len(t) // 4] + n[: len(t) // 4] for t, n in zip(texts, texts[1:] + texts[:1])]


def test_fingerprints(spark, tmp_path):
    rng = random.Random(4)
    rows = sorted([(rng.randrange(10**9), prose(rng, rng.choice([0, 1, 3, 20, 200, 900])) + rng.choice(["", "é漢"])) for _ in range(300)] + [(5, None), (6, "same text here"), (7, "same text here")])
    odd_columns(table(spark, rows)).repartition(5).write.parquet(str(tmp_path / "documents.parquet"))
    found = sorted(syncmers.op4_closed_syncmers(spark, str(tmp_path)).collect(), key=lambda r: r["doc_id"])
    texts = [r[1] or "" for r in rows]
    assert [r["edited_sha256"] for r in found] == [hashlib.sha256(t.encode()).hexdigest() for t in edited(texts)]
    assert [r["n_chars"] for r in found] == [len(t) for t in texts]
    prints = defaultdict(set)
    for r, t in zip(found, texts):
        prints[t].add(r["fingerprint"])
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
        if len(t) > 500:
            assert r["near_edited"] > 0.3 > r["near_next"]
    assert all(len(p) == 1 for p in prints.values()) and prints[""] == {""}
    sets = lambda f: {f[i : i + 8] for i in range(0, len(f), 8)}
    for r, after in zip(found, found[1:] + found[:1]):  # likeness is that of the fingerprints shown
        for name, other in (("near_edited", r["edited_fingerprint"]), ("near_next", after["fingerprint"])):
            a, b = sets(r["fingerprint"]), sets(other)
            assert r[name] == (len(a & b) / len(a | b) if a | b else 1.0)


def test_fingerprints_of_odd_tables(spark, tmp_path):
    for name, rows in {"edges": edge_rows(), "one": [(1, "only one row here to read")], "none": []}.items():
        table(spark, rows).write.parquet(str(tmp_path / name / "documents.parquet"))
        found = syncmers.op4_closed_syncmers(spark, str(tmp_path / name)).collect()
        assert len(found) == len(rows)
    (only,) = syncmers.op4_closed_syncmers(spark, str(tmp_path / "one")).collect()
    assert only["edited_sha256"] == hashlib.sha256(edited(["only one row here to read"])[0].encode()).hexdigest()


@pytest.mark.parametrize("far", [[10**15], [-(2**63), 2**63 - 1], [2**53 + i for i in range(5)] + [2**62 + i for i in range(5)]])
def test_next_document_whatever_the_identifiers(spark, far):
    rng = random.Random(17)
    rows = sorted([(i, prose(rng, rng.choice([1, 9, 40]))) for i in range(0, 300, 3)] + [(d, prose(rng, 20)) for d in far])
    docs = syncmers.with_links(table(spark, rows).select("doc_id", "text"), "text", "links").repartition(3)
    found = {r["doc_id"]: r["next"]["text"] for r in syncmers.with_next(docs, per_block=8).collect()}
    assert found == {d: rows[(i + 1) % len(rows)][1] for i, (d, _) in enumerate(rows)}
    number, n = syncmers.blocks(docs, 8, 1000)
    sizes = [r["count"] for r in docs.groupBy(number.alias("block")).count().collect()]
    assert n > 8 and max(sizes) < 30


def test_likeness_is_that_of_linked_anchors(spark, tmp_path):
    rng = random.Random(18)
    base = prose(rng, 400)
    rows = [(1, base), (2, prose(rng, 50) + " " + base), (3, " ".join(sorted(base.split()))), (4, "a b c"), (5, "a b c"), (6, prose(rng, 6)), (7, ""), (8, None), (9, base)]
    table(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    found = sorted(syncmers.op4_closed_syncmers(spark, str(tmp_path)).collect(), key=lambda r: r["doc_id"])
    texts = [r[1] or "" for r in rows]
    pairs = spark.createDataFrame([(i, t) for i, t in enumerate(texts + edited(texts))], "i int, text string")
    held = pairs.select("i", "text", syncmers.word_hashes(F.col("text")).alias("h")).select("i", "text", syncmers.anchors(F.col("h")).alias("a")).collect()
    links = {}
    for r in held:
        a = [(x["pos"], x["hash"]) for x in r["a"]]
        links[r["i"]] = {(one[1], two[1], two[0] - one[0]) for one, two in zip(a, a[1:])} or {x[1] for x in a}
    like = lambda x, y: len(x & y) / len(x | y) if x | y else 1.0
    for i, r in enumerate(found):
        assert abs(r["near_edited"] - like(links[i], links[len(rows) + i])) < 0.01
        assert abs(r["near_next"] - like(links[i], links[(i + 1) % len(rows)])) < 0.01
    assert found[0]["near_next"] > 0.8 and found[1]["near_next"] < 0.1 and found[3]["near_next"] == found[6]["near_next"] == 1 and found[8]["fingerprint"] == found[0]["fingerprint"]


def closed_by_hand(h, k):
    out = []
    for i in range(len(h) - k + 1):
        inner = h[i : i + k]
        if min(inner) in (inner[0], inner[-1]):
            out.append(i)
    return out


def test_anchors_are_closed_syncmers_and_context_free(spark):
    rng = random.Random(6)
    text = prose(rng, 120)
    df = spark.createDataFrame([(text,)], "text string").withColumn("h", syncmers.word_hashes(F.col("text"))).withColumn("a", syncmers.anchors(F.col("h")))
    row = df.first()
    assert [a["pos"] for a in row["a"]] == closed_by_hand(row["h"], syncmers.K) and 20 < len(row["a"]) < 90
    left = spark.createDataFrame([(1, text)], "k int, text string")
    right = spark.createDataFrame([(1, prose(rng, 17) + " " + text)], "k int, text string")
    top = syncmers.matches(left, right, "k").orderBy(F.desc("anchors")).first()
    assert top["shift"] == 17 and top["anchors"] >= 0.9 * len(row["a"])


def replicas(spark, change):
    pages = [(i, f"http://h/{i}", "x" * (i * 37 % 500)) for i in range(400)] + [(None, None, None)]
    records = warc.archived(spark.createDataFrame(pages, "page_id long, url string, html string"), "page_id", "url", "html", archive_bytes=60_000)
    records = records.cache()
    a = warc.hashes(records).cache()
    return a, a.withColumn("sha", change), records


def test_audit_finds_what_differs_and_only_that(spark):
    a, b, records = replicas(spark, F.when(F.col("offset") % 11 == 3, F.reverse("sha")).otherwise(F.col("sha")))
    b = b.where("offset % 13 <> 5").unionByName(spark.createDataFrame([(0, 10**9, "ff")], "archive long, offset long, sha string"))
    found = {(r["archive"], r["offset"]): r["status"] for r in warc.audit(a, b).collect()}
    want = {(r["archive"], r["offset"]): "missing" if r["offset"] % 13 == 5 else "corrupt" for r in a.collect() if r["offset"] % 13 == 5 or r["offset"] % 11 == 3}
    assert found == want | {(0, 10**9): "extra"} and a.select("archive").distinct().count() > 1
    assert warc.audit(a, a).count() == 0
    assert {r["status"] for r in warc.audit(a, a.limit(0)).collect()} == {"missing"} and warc.audit(a.limit(0), a.limit(0)).count() == 0


@pytest.mark.parametrize("packed", [False, True])
def test_warc_files_round_trip(spark, tmp_path, packed):
    import gzip

    _, _, records = replicas(spark, F.col("sha"))
    rows = records.where("archive = 0").orderBy("offset").collect()
    held = [gzip.compress(bytes(r["record"])) if packed else bytes(r["record"]) for r in rows]
    (tmp_path / "a.warc").write_bytes(b"".join(held))
    found = warc.read_warc(spark, str(tmp_path)).orderBy("offset").collect()
    assert [r["offset"] for r in found] == [sum(map(len, held[:i])) for i in range(len(held))]
    for r, f in zip(rows, found):
        assert bytes(f["content"]) in bytes(r["record"]) and f["kind"] == "resource" and f["uri"] == ("" if r["id"] is None else f"http://h/{r['id']}")


def test_what_is_no_record_becomes_a_row():
    import gzip

    one = b"WARC/1.1\r\nWARC-Type: metadata\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    rows = list(warc.parse(one + b"torn off\r\n\r\n" + one + b"WARC/1.1 cut"))
    assert [(r[0], r[2], r[4]) for r in rows] == [
        (0, "metadata", b"abc"), (len(one), "unreadable", b"torn off\r\n\r\n"), (len(one) + 12, "metadata", b"abc"), (2 * len(one) + 12, "unreadable", b"WARC/1.1 cut")]
    damaged = gzip.compress(one) + b"\x1f\x8bnot gzip"
    assert [(r[0], r[2]) for r in warc.parse(damaged)] == [(0, "metadata"), (len(damaged) - 10, "unreadable")] and list(warc.parse(b"")) == []


def test_archives_of_odd_pages(spark):
    pages = [(1, "u", "same"), (1, "u", "same"), (None, None, None), (None, None, None), (2, "v", "x" * 3_000_000), (3, "", "")]
    docs = odd_columns(spark.createDataFrame(pages, "page_id long, url string, html string"))
    for column in ("archive", "offset", "length", "sha", "record"):
        docs = docs.withColumn(column, F.lit("x"))
    rows = warc.archived(docs, "page_id", "url", "html", archive_bytes=1_000_000).collect()
    assert len(rows) == len(pages) and all(r["length"] == len(r["record"]) and r["sha"] == hashlib.sha256(r["record"]).hexdigest() for r in rows)
    ends = {}
    for r in sorted(rows, key=lambda r: (r["archive"], r["offset"])):
        assert r["offset"] == ends.get(r["archive"], 0)
        ends[r["archive"]] = r["offset"] + r["length"]
    assert warc.archived(docs.limit(0), "page_id", "url", "html").count() == 0
