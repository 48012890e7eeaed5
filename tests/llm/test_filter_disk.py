import os
import threading
import time

import numpy as np
import pyarrow as pa

from framequill import session
from framequill.llm import ngram_lm
from framequill.llm.language_id import in_fold


def size(folders, begins=""):
    total = 0
    for folder in folders:
        for path, _, names in os.walk(folder):
            for name in names:
                try:
                    total += os.path.getsize(f"{path}/{name}") if name.startswith(begins) else 0
                except OSError:  # gone meanwhile
                    pass
    return total


def test_asking_holds_the_questions_of_one_round_on_disk(spark):
    rng = np.random.default_rng(3)
    texts = [" ".join(map(str, rng.integers(10_000, 30_000, 25_000))) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(8).localCheckpoint()
    local = list(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString())
    scratch = os.path.dirname(session.shared_dir(spark)).removeprefix("file:")
    now = lambda: size(local, "shuffle_") + size([scratch])
    first, most, over = now(), [0], threading.Event()

    def watch():
        while not over.wait(0.02):
            most[0] = max(most[0], now() - first)

    thread = threading.Thread(target=watch)
    thread.start()
    try:
        found = ngram_lm.score_text(docs, in_fold("doc_id", 10) != 0, max_bytes=0).collect()
    finally:
        over.set()
        thread.join()
    assert len(found) == len({r["doc_id"] for r in found}) == 60 and all(r["n_tokens"] == 25_001 for r in found)
    assert most[0] < 4 * sum(map(len, texts)), most[0] / sum(map(len, texts))
    end = time.time() + 20
    while now() - first > 1 << 20 and time.time() < end:  # files go shortly after their query
        time.sleep(0.1)
    assert now() - first <= 1 << 20


def test_answers_come_without_the_keys():
    rng = np.random.default_rng(4)
    texts = pa.array([[" ".join(map(str, rng.integers(0, 1000, 2000)))]])
    batch = pa.RecordBatch.from_arrays([pa.array([7]), texts], ["batch", "texts"])
    asks = list(ngram_lm.asked(2, 8)([batch]))
    words, grams = ngram_lm.distinct(*ngram_lm.token_rows(texts.flatten()))
    told = [b for b in ngram_lm.told(2, 8)(iter(asks))]
    assert sorted(x for b in told for x in b.column(1).to_pylist()) == [0, 1, 2, 3] and {x for b in told for x in b.column(0).to_pylist()} == {7}
    assert sum(b.nbytes for b in told) < 8 * len(words) + len(grams) + 500
