"""A search cell holds the scores of few queries at a time."""

import tracemalloc

import numpy as np
import pandas as pd

from folioweave.operators import vector_search as vs


def test_scores_of_a_full_cell_take_little_memory():
    data = np.random.default_rng(1).standard_normal((8192, 8))
    corpus = pd.DataFrame({"item_id": np.arange(8192), "vector": list(data)})
    queries = corpus.head(2048).rename(columns={"item_id": "query_id"})
    tracemalloc.start()
    found = vs._best_in_cell(queries, corpus, 5, -2.0, True)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(found) == 2048 * 5
    assert peak < 120e6
