import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from framequill.llm import language_id, ngram_lm, quality
from framequill.llm.words import text_bytes, word_hashes
from framequill.session import load
from tests.llm.helpers import edge_rows, odd_columns, prose, table, words


def test_word_hashes_follow_the_words(monkeypatch):
    from framequill.llm import words as module

    monkeypatch.setattr(module, "PIECE", 37)
    rng = random.Random(3)
    docs = ["".join(rng.choice("abAB  \t\né漢\x0b") for _ in range(rng.choice([0, 1, 5, 40, 300]))) for _ in range(200)] + [None, "", " ", "a"]
    hashes, begin = word_hashes(*text_bytes(pa.array(docs)))
    lists = [words(d) for d in docs]
    assert np.diff(begin).tolist() == [len(w) for w in lists]
    seen = {}
    assert all(seen.setdefault(w, h) == h for w, h in zip([w for l in lists for w in l], hashes.tolist())) and len(set(seen.values())) == len(seen)


def base_scores(rows, folds=10):
    tokens = [words(r[1]) + [None] for r in rows]
    learn = [r[0] is not None and zlib.crc32(str(r[0]).encode()) % folds != 0 for r in rows]
    c = Counter(w for t, l in zip(tokens, learn) if l for w in t)
    n, v = sum(c.values()), len(c)
    return [(len(t), sum(c[w] > 0 for w in t), n, sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t)) for t in tokens]


def scored(docs, **options):
    found = ngram_lm.score_text(docs, language_id.in_fold("doc_id", 10) != 0, **options)
    return found.collect()


def check_scores(found, rows):
    order = lambda x: (x[0], x[1], round(x[3], 6))
    mine = sorted([(r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) for r in found], key=order)
    for a, b in zip(mine, sorted(base_scores(rows), key=order), strict=True):
        assert a[:3] == b[:3] and abs(a[3] - b[3]) < 1e-6


def test_scores_are_the_same_by_broadcast_and_by_asking_segments(spark):
    rng = random.Random(4)
    rows = [(i, prose(rng, rng.randrange(1, 80), 300)) for i in range(150)] + [r[:2] for r in edge_rows()] + [(3, prose(rng, 9))] * 3
    docs = odd_columns(table(spark, rows))
    one = scored(docs, segment_bytes=4000)
    check_scores(one, rows)
    assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in one)
    order = lambda found: sorted(tuple(r) for r in found if r["doc_id"] is not None)
    for options in ({"max_words": 0}, {"max_bytes": 0}, {"max_bytes": 0, "bucket_bytes": 1}):
        other = scored(docs.repartition(3), segment_bytes=4000, **options)
        check_scores(other, rows)
        assert np.allclose([r[-1] for r in order(one)], [r[-1] for r in order(other)], rtol=1e-12, atol=0)


def test_scores_do_not_depend_on_partitions(spark):
    rng = random.Random(14)
    docs = table(spark, [(i, prose(rng, 60, 200)) for i in range(120)])
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        found = []
        for n in (3, 17):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            found.append({r["doc_id"]: r["score"] for r in scored(docs.repartition(n), segment_bytes=3000)})
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert found[0].keys() == found[1].keys() and all(math.isclose(found[0][d], found[1][d], rel_tol=1e-12) for d in found[0])


def brute_grams(texts):
    grams = Counter()
    for t in texts:
        w = ["<s>", *words(t), None]
        grams.update(tuple(w[i : i + 2]) for i in range(len(w) - 1))
        grams.update(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    return grams


def test_filter_tells_counts_and_probabilities_sum_to_at_most_one(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice([f"a{rng.randrange(9)} b{rng.randrange(30)}", prose(rng, 2, 900)]) for _ in range(40))) for i in range(120)]
    segments, totals = ngram_lm.build(table(spark, rows), segment_bytes=20_000)
    model = ngram_lm.gathered(segments, totals)
    vocabulary = sorted({w for r in rows for w in words(r[1])})
    assert totals.vocabulary == len(vocabulary) + 1 and totals.documents == 120 and 0 < totals.wrong < 0.02 and segments.count() > 1
    grams = brute_grams(r[1] for r in rows)
    tokens, begin = ngram_lm.token_rows(pa.array([r[1] for r in rows]))
    seen = ngram_lm.looked_up(model, totals.documents, tokens, begin)
    flat = [(("<s>", *words(t), None), i) for _, t in rows for i in range(1, len(words(t)) + 2)]
    q = lambda c: c.bit_length()
    want = [(q(grams[w[i - 1 : i + 1]]), q(c) if i > 1 and (c := grams[w[i - 2 : i + 1]]) > 1 else 0) for w, i in flat]
    assert (seen.pair >= [p for p, _ in want]).all() and (seen.triple >= [t for _, t in want]).all()
    assert np.mean(seen.pair == [p for p, _ in want]) > 0.98 and np.mean(seen.triple == [t for _, t in want]) > 0.98
    for m2, m3 in ((1.0, 1.0), (256.0, 16.0), (16.0, 4096.0)):
        for context in ("", "a1", "a1 b2", "b2 a3", "a8", f"{vocabulary[0]} a1", "neverseen a1", "neverseen"):
            follow = pa.array([f"{context} {w}" for w in [*vocabulary, "unknownword"]] + [context])
            tokens, begin = ngram_lm.token_rows(follow)
            logs = totals.logs(ngram_lm.looked_up(model, totals.documents, tokens, begin), 0, m2, m3)
            total = (10 ** logs[begin[:-1] + len(context.split())]).sum()
            assert (0.2 if m3 > 1 else 0.01) < total <= 1 + 1e-9, (context, m2, m3, total)


def test_keys_survive_packing():
    keys = np.sort(np.random.default_rng(1).integers(0, 1 << 56, 1000, dtype=np.uint64))
    assert (ngram_lm.loosened(ngram_lm.tight(keys)) == keys).all() and len(ngram_lm.loosened(ngram_lm.tight(keys[:0]))) == 0


def test_known_pairs_score_higher(spark):
    rng = random.Random(6)
    rows = [(i, " ".join(f"{a} {a}next" for a in prose(rng, 30, 40).split())) for i in range(300)]
    found = {r["doc_id"]: r for r in scored(table(spark, rows))}
    held = [d for d in found if zlib.crc32(str(d).encode()) % 10 == 0]
    assert held and all(found[d]["score"] > found[d]["base_score"] + 10 for d in held)


def test_lm_without_rows_or_training(spark):
    assert scored(table(spark, [(1, "x")]).limit(0)) == []
    (only,) = scored(table(spark, [(None, "a b")]))
    assert only["n_tokens"] == 3 and only["train_tokens"] == 0 and math.isfinite(only["base_score"]) and math.isfinite(only["score"])


def test_language_is_right_on_held_out_rows(spark, sf_dir):
    from framequill.llm.registry import QUERIES

    docs = load(spark, sf_dir, "documents").select("doc_id", "lang")
    found = QUERIES["op9_language_id"](spark, sf_dir).join(docs, "doc_id").where("held_out").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in found]) > 0.97
    assert np.mean([r["accepted"] for r in found]) > 0.98 and all(0 <= r["score"] <= 1 for r in found)


SENTENCES = {"en": "the quick brown fox jumps over the lazy dog and thinks about the weather", "de": "der schnelle braune fuchs springt über den faulen hund und denkt an das wetter",
             "fr": "le rapide renard brun saute par dessus le chien paresseux et pense à la météo"}


def labelled(spark):
    rng = random.Random(8)
    rows = [(i, " ".join(rng.sample(SENTENCES[l].split(), 10)), l) for i, l in enumerate(list(SENTENCES) * 80)]
    return rows, language_id.train(table(spark, rows), "doc_id", "text", "lang", F.lit(True))


def test_language_edges_and_rejection(spark):
    rows, model = labelled(spark)
    assert model.langs == ["de", "en", "fr"]
    odd = [(900, None), (901, ""), (902, "12 + 30 = !"), (903, "THE WEATHER AND THE DOG"), (904, "über das wetter"), (905, "xqzv wkjq zzxq qqkv jxwz vvkq"), (None, "le chien"), (906, "漢字")]
    found = {r["id"]: r for r in language_id.predict(odd_columns(table(spark, odd)).drop("id"), model).collect()}
    assert [found[i]["lang_pred"] for i in (900, 901, 902)] == ["und"] * 3 and not any(found[i]["accepted"] for i in (900, 901, 902))
    assert found[903]["lang_pred"] == "en" and found[904]["lang_pred"] == "de" and found[None]["lang_pred"] == "fr"
    assert found[903]["accepted"] and not found[905]["accepted"] and found[906]["lang_pred"] in model.langs
    kept = language_id.identified(table(spark, odd), model)
    assert kept.columns == table(spark, odd).columns and {r["doc_id"] for r in kept.collect()} >= {903, 904} and kept.where("doc_id in (900, 901, 902, 905)").count() == 0


def test_language_probabilities_sum_to_one(spark):
    _, model = labelled(spark)
    letters = sorted({c for s in SENTENCES.values() for c in s if c.isalpha()})
    for context in ("th", "ei", "q", "zz"):
        chars = np.concatenate([np.array([*map(ord, context + c), 0], np.uint32) for c in letters] + [np.array([*map(ord, context), 0], np.uint32)])
        logs = model.logs(chars)
        at = len(context) + np.arange(len(letters)) * (len(context) + 2)
        total = np.exp2(logs[at]).sum(axis=0) + np.exp2(logs[len(letters) * (len(context) + 2) + len(context)])
        assert ((total > 0.97) & (total < 1.0001)).all(), (context, total)


def test_languages_without_labels(spark):
    docs = table(spark, [(1, "some text"), (2, None)])
    model = language_id.train(docs, "doc_id", "text", "lang", F.lit(True))
    assert {r["lang_pred"] for r in language_id.predict(docs, model).collect()} == {"und"}
    assert language_id.predict(docs.limit(0), model).count() == 0


def test_letters_cover_what_counts_as_letter():
    table_ = language_id.letters()
    assert all((table_[i] != 0) == chr(i).isalpha() for i in range(0, 0x30000, 7)) and table_[ord("É")] == ord("é")


def test_quality_learns_ordered_grades(spark):
    rng = random.Random(11)
    rows, ratings = [], []
    for i in range(600):
        grade = i % 3
        rows.append((i, prose(rng, 30, 300) + " " + " ".join(rng.choice([["vile", "nasty"], ["meh", "bland"], ["lucid", "rich"]][grade]) for _ in range(2))))
        if i % 2:
            ratings.append((i, grade))
    docs, graded = table(spark, rows), spark.createDataFrame(ratings + [(9999, 1), (5, None)], "id long, grade int")
    found = {r["id"]: r for r in quality.rate(docs, graded).collect()}
    held = [i for i in range(600) if i % 2 == 0]
    assert np.mean([found[i]["selected"] == (i % 3 == 2) for i in held]) > 0.97
    means = [np.mean([found[i]["expected_grade"] for i in held if i % 3 == g]) for g in range(3)]
    assert means[0] < 0.4 < means[1] < 1.5 < means[2]
    edges = quality.rate(odd_columns(table(spark, edge_rows())), graded.where("id < 0")).collect()
    assert len(edges) == len(edge_rows()) and all(r["selected"] and r["expected_grade"] is None for r in edges)
    odd = quality.rate(table(spark, edge_rows() + [r for r in rows if r[0] > 20]), graded.where("id > 20")).collect()
    assert all(0 <= r["expected_grade"] <= 2 for r in odd)


def test_ordinal_gradient_matches_differences():
    rng = np.random.default_rng(0)
    numbers, begin, grades = np.arange(30, dtype=np.int32), np.arange(0, 31, 3), np.array([0, 1, 2] * 3 + [1])
    point = np.zeros((1 << quality.BITS) + 2)
    point[:30], point[-2:] = rng.normal(0, 1, 30), (-0.3, 0.2)
    _, grad = quality.objective(point, numbers, begin, grades, 1e-3)
    for i in (0, 7, 29, len(point) - 2, len(point) - 1):
        step = np.zeros_like(point)
        step[i] = 1e-5
        slope = (quality.objective(point + step, numbers, begin, grades, 1e-3)[0] - quality.objective(point - step, numbers, begin, grades, 1e-3)[0]) / 2e-5
        assert abs(slope - grad[i]) < 1e-6
    model = quality.fit(numbers, begin, grades)
    assert (np.diff(model.thresholds) > 0).all()
    tails = model.tails(numbers, begin)
    assert (tails[:, 0] >= tails[:, 1]).all() and (np.round(tails.sum(axis=1)) == grades).all()


def brute_kneser_ney(samples):
    """{lang: f(word) -> log2 P of its characters and end} by the book, with dictionaries."""
    grams = {}
    for lang, text in samples:
        held = grams.setdefault(lang, Counter())
        for word in letters_of(text):
            padded = (0, 0, 0, *word, 0)
            for i in range(3, len(padded)):
                held[padded[i - 3 : i + 1]] += 1
    levels = {lang: {4: c} for lang, c in grams.items()}
    for c in levels.values():
        for m in (3, 2, 1):
            c[m] = Counter(g[1:] for g, n in c[m + 1].items() if n > 0)
    alphabet = len({g for c in levels.values() for g in c[1]}) + 1

    def model(c):
        discount, total, kinds = {}, {}, {}
        for m in range(1, 5):
            once, twice = sum(n == 1 for n in c[m].values()), sum(n == 2 for n in c[m].values())
            discount[m] = min(0.95, max(0.1, once / (once + 2 * twice) if once else 0.5))
            total[m], kinds[m] = Counter(), Counter()
            for g, n in c[m].items():
                total[m][g[:-1]] += n
                kinds[m][g[:-1]] += 1

        def p(g):
            m = len(g)
            lower = p(g[1:]) if m > 1 else 1 / alphabet
            t = total[m][g[:-1]]
            return lower if not t else max(c[m][g] - discount[m], 0) / t + discount[m] * kinds[m][g[:-1]] / t * lower

        return p

    return {lang: model(c) for lang, c in levels.items()}


def letters_of(text):
    """Words of lower-cased letters as tuples of code points."""
    low = lambda ch: ch.lower() if len(ch.lower()) == 1 else ch
    out, word = [], []
    for ch in (text or "") + " ":
        if ch.isalpha():
            word.append(ord(low(ch)))
        elif word:
            out.append(tuple(word))
            word = []
    return out


def test_language_query_equals_brute_force(spark, sf_dir):
    from framequill.llm.registry import QUERIES

    docs = load(spark, sf_dir, "documents")
    fold = language_id.in_fold("doc_id", 4) == 2
    rows = docs.select("doc_id", "text", "lang", fold.alias("out"), (F.pmod(F.xxhash64("doc_id", F.lit(12)), F.lit(8)) == 0).alias("limits")).collect()
    models = brute_kneser_ney([(r["lang"], r["text"]) for r in rows if r["lang"] and r["text"] and not r["out"] and not r["limits"]])
    found, cache = {r["doc_id"]: r for r in QUERIES["op9_language_id"](spark, sf_dir).collect()}, {}

    def bits(lang, word):
        if (lang, word) not in cache:
            padded = (0, 0, 0, *word, 0)
            # What lies before a word is no context, so a window is cut at the break.
            cache[lang, word] = -sum(math.log2(models[lang](padded[i - 3 : i + 1])) for i in range(3, len(padded)))
        return cache[lang, word]

    for r in rows:
        held, mine = letters_of(r["text"]), found[r["doc_id"]]
        assert mine["held_out"] == r["out"]
        if not held:
            assert (mine["lang_pred"], mine["score"]) == ("und", 0)
            continue
        n = sum(len(w) + 1 for w in held)
        h = {lang: sum(bits(lang, w) for w in held) / n for lang in sorted(models)}
        best = min(h, key=h.get)
        assert mine["lang_pred"] == best and abs(mine["bits"] - h[best]) < 1e-4
        assert abs(mine["score"] - 1 / sum(2 ** (-min(n, 50) * (x - h[best])) for x in h.values())) < 1e-3


def test_small_and_skewed_samples_learn_every_language(spark):
    rows, _ = labelled(spark)
    rows = rows + [(10_000, "an identifier that repeats", "en")] * 400
    docs = table(spark, rows)
    for per_language in (10, 200):
        sample = language_id.sampled(docs, "doc_id", "text", "lang", F.lit(True), per_language).collect()
        assert Counter(r["lang"] for r in sample) == {lang: min(per_language, 80 + (lang == "en")) for lang in SENTENCES}
        assert language_id.train(docs, "doc_id", "text", "lang", F.lit(True), per_language).langs == sorted(SENTENCES)


def test_student_quantiles():
    for tail, freedom, want in ((0.05, 5, 2.015), (0.01, 10, 2.764), (1e-3, 7, 4.785), (1e-4, 200, 3.789)):  # fixed values: a table's
        assert abs(language_id.student_quantile(tail, freedom) - want) < 0.01


def test_rejection_keeps_to_its_rate():
    rng = np.random.default_rng(2)
    model = language_id.Model(["x"], [], [], np.zeros(1))
    draw = lambda n: (rng.integers(20, 4000, n), rng.normal(0, 0.2, n))
    for reject in (0.01, 0.05):
        lengths, noise = draw(4000)
        language_id.calibrate(model, np.full(4000, "x", object), lengths, 2 + noise * 0 + rng.normal(0, 0.2, 4000), reject, margin=0.0)
        lengths, noise = draw(20_000)
        share = (2 + noise > model.limit[0][language_id.length_bin(lengths)]).mean()
        assert share <= reject, (reject, share)
    assert (np.diff(model.limit[0]) <= 0).all()


def test_ordinal_fit_equals_a_dense_one():
    rng = np.random.default_rng(5)
    texts = [" ".join(f"w{i}" for i in rng.choice(40, 12)) for _ in range(160)]
    numbers, begin = quality.features(pa.array(texts))
    strength = np.array([sum(int(w[1:]) for w in set(t.split())) for t in texts])
    grades = np.digitize(strength + rng.normal(0, 40, 160), np.quantile(strength, [0.3, 0.7]))
    used, column = np.unique(numbers, return_inverse=True)
    x = np.zeros((160, len(used)))
    for i in range(160):
        own = column[begin[i] : begin[i + 1]]
        x[i, own] = 1 / np.sqrt(len(own))
    penalty = 1e-3

    def loss(w, t0, gap):
        t1, z = t0 + np.exp(gap), x @ w
        s = lambda v: 1 / (1 + np.exp(-v))
        p = np.where(grades == 0, s(t0 - z), np.where(grades == 1, s(t1 - z) - s(t0 - z), 1 - s(t1 - z)))
        return -np.log(np.maximum(p, 1e-12)).mean() + 0.5 * penalty * w @ w, (s(t0 - z), s(t1 - z), t1)

    w, t0, gap = np.zeros(len(used)), -1.0, 0.0
    for _ in range(6000):  # plain gradient descent
        _, (a, b, t1) = loss(w, t0, gap)
        middle = np.maximum(b - a, 1e-12)
        dz = np.where(grades == 0, 1 - a, np.where(grades == 1, -(b * (1 - b) - a * (1 - a)) / middle * -1, -b))
        d0 = np.where(grades == 0, -(1 - a), np.where(grades == 1, a * (1 - a) / middle, 0)).mean()
        d1 = np.where(grades == 1, -b * (1 - b) / middle, np.where(grades == 2, b, 0)).mean()
        w, t0, gap = w - 2.0 * (x.T @ dz / 160 + penalty * w), t0 - 2.0 * (d0 + d1), gap - 2.0 * d1 * np.exp(gap)
    model = quality.fit(numbers, begin, grades, penalty=penalty, steps=300)
    point = np.concatenate([model.weights, [model.thresholds[0], np.log(model.thresholds[1] - model.thresholds[0])]])
    assert abs(quality.objective(point, numbers, begin, grades, penalty)[0] - loss(w, t0, gap)[0]) < 2e-3
    tails = model.tails(numbers, begin)
    z = x @ w
    dense = np.stack([1 / (1 + np.exp(t0 - z)), 1 / (1 + np.exp(t0 + np.exp(gap) - z))], axis=1)
    assert np.abs(tails - dense).max() < 0.05


def test_quality_on_labels_it_has_not_seen(spark):
    sf = "/root/testdata/sf0.01"
    labels = load(spark, sf, "labels").withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(4)))
    grade = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).otherwise(2)
    found = {r["id"]: r for r in quality.rate(load(spark, sf, "documents"), labels.where("part > 0").select(F.col("doc_id").alias("id"), grade.alias("grade"))).collect()}
    held = labels.where("part = 0").select("doc_id", grade.alias("grade")).collect()
    assert len(held) > 30 and np.mean([found[r["doc_id"]]["selected"] == (r["grade"] == 2) for r in held]) > 0.85
    means = [np.mean([found[r["doc_id"]]["expected_grade"] for r in held if r["grade"] == g]) for g in sorted({r["grade"] for r in held})]
    assert means == sorted(means)


def test_quality_of_unseen_toxic_texts_and_repeats(spark):
    sf = "/root/testdata/sf0.1"
    docs = load(spark, sf, "documents").join(load(spark, sf, "labels").select("doc_id"), "doc_id", "left_semi")
    labels = load(spark, sf, "labels").withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(4)))
    grade = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).otherwise(2).alias("grade")
    seen = labels.where("part > 0").select(F.col("doc_id").alias("id"), grade)
    held = {r["doc_id"]: r["grade"] for r in labels.where("part = 0").select("doc_id", grade).collect()}
    found = {r["id"]: r for r in quality.rate(docs, seen).where(F.pmod(F.xxhash64("id"), F.lit(4)) == 0).collect()}
    kept = {g: np.mean([found[d]["selected"] for d, own in held.items() if own == g]) for g in (0, 1, 2)}
    assert kept[0] < 0.1 and kept[1] < 0.1 and kept[2] > 0.95
    few = docs.limit(40)
    twice = quality.rate(few, seen.unionByName(seen)).collect()
    assert len(twice) == 40 and all(0 <= r["tail_probability"] <= 1 for r in twice)
    assert quality.rate(docs.limit(0), seen).count() == 0 and quality.rate(docs.limit(0), seen.limit(0)).count() == 0


def test_questions_of_a_batch_do_not_grow_with_the_segments():
    rng = random.Random(15)
    texts = pa.array([[prose(rng, 4000, 10**6)]])
    batch = pa.RecordBatch.from_arrays([pa.array([7]), texts], ["batch", "texts"])
    sizes = {}
    for segments in (8, 10_000, 1_000_000):
        per = -(-segments // 8)
        asked = list(ngram_lm.asked(per, segments)([batch]))
        sizes[segments] = sum(b.nbytes for b in asked)
        assert len(asked) == 1 and asked[0].num_rows == 8
        words = np.concatenate([ngram_lm.flat(b.column(4), np.uint64)[0] for b in asked])
        assert len(words) == len(set(words.tolist())) and (np.diff(words.astype(float)) >= 0).all()
        for bucket, own in zip(asked[0].column(0).to_pylist(), asked[0].column(5).to_pylist()):
            assert set((ngram_lm.segment_of(np.frombuffer(own, np.uint64), segments) // per).tolist()) == {bucket}
    assert len(set(sizes.values())) == 1
    fine = list(ngram_lm.asked(1, 10_000)([batch]))  # a bucket for each segment
    assert len(fine) < 5 and sum(b.nbytes for b in fine) < 4 * sizes[8]


def test_filter_scores_are_close_to_those_of_exact_counts(spark):
    rng = random.Random(16)
    texts = [prose(rng, 300, 400) for _ in range(60)]
    docs = table(spark, list(enumerate(texts)))
    off = {}
    for bits in (6.0, 10.0, 16.0):
        segments, totals = ngram_lm.build(docs.where("doc_id >= 10"), bits, segment_bytes=20_000)
        held = ngram_lm.gathered(segments, totals)
        learned = ngram_lm.gram_keys(*ngram_lm.token_rows(pa.array(texts[10:])))
        words, pairs, triples = (np.unique(k, return_counts=True) for k in learned)
        kept = (triples[0] != 0) & (triples[1] >= totals.least)
        grams, n = ngram_lm.merged([(pairs[0], pairs[1]), (triples[0][kept], triples[1][kept])])
        exact = ngram_lm.Answers(words[0], words[1], grams, ngram_lm.levels(n).astype(np.int8))
        tokens, begin = ngram_lm.token_rows(pa.array(texts))
        sums = [np.add.reduceat(totals.logs(ngram_lm.looked_up(h, totals.documents, tokens, begin)), begin[:-1]) for h in (held, exact)]
        off[bits] = np.abs(sums[0] - sums[1]).max() / 301
    assert off[16.0] < off[6.0] and off[16.0] < 0.005 and off[10.0] < 0.03, off
