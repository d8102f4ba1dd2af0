"""Vector blocks are met piece by piece: the same rows as at once, in bounded memory; a model learns from every row."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from upswell.operators import pruned_search, search, topic_graph


def table(name, ids, vectors):
    return pa.table({name[0]: pa.array(ids, pa.int64()), name[1]: pa.array([list(map(float, v)) for v in vectors], pa.list_(pa.float32()))})


@pytest.mark.parametrize("rows,queries", [(1, 1), (7, 3), (4096, 512)])
def test_blocks_score_as_all_pairs_do(rows, queries):
    rng = np.random.default_rng(1)
    vectors = [rng.integers(-2, 3, d) for d in [3] * 60 + [5] * 40 + [7] * 2]  # many ties
    ids = rng.permutation(len(vectors)) - 20
    asked = vectors[::4] + [np.ones(9)]
    found = search.block_scorer("key", 5, 6, rows, queries)(table(("query_id", "_q"), range(len(asked)), asked), table(("key", "embedding"), ids, vectors))
    want = []
    for q, a in enumerate(asked):
        own = sorted((-float(a @ v), int(i)) for i, v in zip(ids, vectors) if len(v) == len(a))[:5]
        want += [(q, i, -s) for s, i in own]
    assert sorted(tuple(r.values()) for r in found.to_pylist()) == sorted(want)


def test_rows_without_a_score_take_no_place():
    cs = pa.table({"key": pa.array(range(6), pa.int64()), "embedding": pa.array([[1.0, None], [2.0, 0.0], [3.0, 0.0], [None, None], [1.0, 0.0], [0.0, 0.0]],
                                                                               pa.list_(pa.float32()))})
    found = search.block_scorer("key", 3, 6)(table(("query_id", "_q"), [1], [[1, 0]]), cs)
    assert found["key"].to_pylist() == [2, 1, 4]


def peak(f, *args):
    tracemalloc.start()
    try:
        f(*args)
        return tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def flat(name, n, dim):
    values = np.random.default_rng(n).standard_normal((n, dim)).astype(np.float32)
    vectors = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * dim, pa.int32()), pa.array(values.ravel()))
    return pa.table({name[0]: pa.array(np.arange(n)), name[1]: vectors})


def test_a_large_meeting_takes_bounded_memory():
    cs = flat(("key", "embedding"), 50_000, 16)
    assert peak(search.block_scorer("key", 10, 6), flat(("query_id", "_q"), 1024, 16), cs) < 120  # scores of all pairs: 410
    guests = flat(("key", "embedding"), 1024, 16)
    assert peak(topic_graph._meet("key", 50.0), guests, cs) < 120


def test_meeting_links_as_all_pairs_do():
    rng = np.random.default_rng(3)
    for dim, least in ((2, 5), (3, 9), (3, 12)):
        vectors = rng.integers(-3, 4, (300, dim))
        ids = rng.permutation(300)
        found = topic_graph._meet("key", float(least))(table(("key", "embedding"), ids[:130], vectors[:130]), table(("key", "embedding"), ids[130:], vectors[130:]))
        least_of = {int(i): int(i) for i in ids}
        near = vectors[:130] @ vectors[130:].T >= least
        changed = True
        while changed:
            changed = False
            for i, j in zip(*np.nonzero(near)):
                a, b = int(ids[i]), int(ids[130 + j])
                low = min(least_of[a], least_of[b])
                changed |= least_of[a] != low or least_of[b] != low
                least_of[a] = least_of[b] = low
        assert {(r["a"], r["b"]) for r in found.to_pylist()} == {(a, b) for a, b in least_of.items() if a != b}


def test_pruned_search_hands_its_pairs_on_in_parts(spark, monkeypatch):
    monkeypatch.setattr(pruned_search, "PAIRS_HELD", 20)
    rng = np.random.default_rng(4)
    df = spark.createDataFrame([(i, [float(x) for x in rng.integers(-3, 4, 4)]) for i in range(400)], "complaint_id long, embedding array<float>")
    queries = df.where("complaint_id % 5 = 0").selectExpr("complaint_id as query_id", "embedding")
    found = pruned_search.pruned_semantic_search(df, df, queries, 7, n_cells=16)
    want = search.batch_semantic_search(df, df, queries, 7)
    columns = ("query_id", "complaint_id", "similarity_score", "rank")
    rows = [sorted(map(tuple, x.select(*columns).collect())) for x in (found, want)]
    assert rows[0] == rows[1] and len(rows[0]) == 560
