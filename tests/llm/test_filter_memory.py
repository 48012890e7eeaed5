import tracemalloc

import numpy as np

from framequill.llm import ngram_lm


def test_filling_holds_a_step_of_members_at_a_time():
    keys, q = np.random.default_rng(1).integers(0, 1 << 56, 1 << 20, dtype=np.uint64), np.ones(1 << 20, np.int64)
    tracemalloc.start()
    words = ngram_lm.filled(keys, q, 10.0)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (ngram_lm.probed(keys[::64], words) > 0).all() and peak < 24 << 20
