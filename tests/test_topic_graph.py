"""Topics found from links between vectors."""

import math
import random

import pytest

from upswell.config import SearchConfig
from upswell.operators.topic_graph import connected_groups, similarity_topics


def groups_of(nodes, links):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in links:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def plain_topics(vectors, least, min_size):
    """All pairs compared."""
    sound = {k: v for k, v in vectors.items() if v}
    unit = {}
    for k, v in sound.items():
        n = math.sqrt(sum(x * x for x in v)) if all(x is not None and math.isfinite(x) for x in v) else 0
        if n:
            unit[k] = [x / n for x in v]
    links = [(a, b) for a in unit for b in unit if a < b and len(unit[a]) == len(unit[b])
             and sum(x * y for x, y in zip(unit[a], unit[b])) >= least - 1e-9]
    group = groups_of(sound, links)
    size = {g: list(group.values()).count(g) for g in group.values()}
    return {k: (g if size[g] >= min_size else -1, size[g]) for k, g in group.items()}


@pytest.fixture(scope="module")
def vectors():
    """Clusters, chains of neighbours, repeats, scaled copies, two sizes, vectors without a direction."""
    rng, out = random.Random(8), {}
    for i in range(240):
        out[i] = [4.0 * (j == i % 5) + rng.gauss(0, 0.25 + 0.2 * (i % 3)) for j in range(8)]
    for i in range(60):
        out[300 + i] = [math.cos(i / 20), math.sin(i / 20)]
    for i in range(25):
        out[400 + i] = [-float(1 + i)] * 8
        out[440 + i] = [rng.gauss(0, 1) for _ in range(8)]
    return out | {500: [0.0] * 8, 501: [float("nan")] + [1.0] * 7, 502: [None] + [1.0] * 7, 503: [], 504: None, 505: [1e200] * 2 + [0.0] * 6,
                  506: [float("inf")] + [1.0] * 7}


@pytest.mark.parametrize("least, n_cells, part", [(0.95, 12, 10_000), (0.95, 12, 9), (0.8, 1, 50), (0.999, 60, 10_000), (0.5, 300, 10_000)])
def test_topics_equal_the_groups_of_all_pairs(spark, vectors, least, n_cells, part):
    plain = dict(vectors)
    plain[505] = [float("inf")] * 8  # its length overflows: no direction
    df = spark.createDataFrame(list(vectors.items()), "complaint_id long, embedding array<double>")
    found = similarity_topics(df, least, 4, n_cells=n_cells, cfg=SearchConfig(candidates_per_part=part, queries_per_block=part))
    assert {r["complaint_id"]: (r["topic_id"], r["topic_size"]) for r in found.collect()} == plain_topics(plain, least, 4)
    assert found.count() == len([v for v in vectors.values() if v])


def test_topics_of_an_empty_table_and_of_one_row(spark):
    schema = "complaint_id long, embedding array<float>, date_received date"
    assert similarity_topics(spark.createDataFrame([], schema)).count() == 0
    one = spark.createDataFrame([(7, [1.0, 2.0], None)], schema)
    assert [tuple(r) for r in similarity_topics(one, min_size=1).collect()] == [(7, 7, 1)]
    assert [tuple(r) for r in similarity_topics(one).collect()] == [(7, -1, 1)]


def test_connected_groups_of_paths_hubs_and_cycles(spark):
    rng = random.Random(3)
    path = [(i, i + 1) for i in range(0, 90)]
    rng.shuffle(path)
    hub = [(500, 200 + i) for i in range(80)] + [(200 + i, 201 + i) for i in range(0, 80, 2)]
    loose = [(rng.randrange(1000, 1300), rng.randrange(1000, 1300)) for _ in range(200)] + [(2000, 2000)]
    links = path + hub + loose
    found = {r["node"]: r["group"] for r in connected_groups(spark.createDataFrame(links, "a long, b long")).collect()}
    nodes = {n for a, b in links if a != b for n in (a, b)}
    assert found == groups_of(nodes, links[:-1])
