"""Components against a plain union of links, with one task and with many."""

import random

import pytest

from attesta.llm import graph


def roots_of(links):
    root = {}

    def top(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        if a is not None and b is not None and a != b:
            x, y = top(a), top(b)
            root[max(x, y)] = min(x, y)
    return {x: top(x) for x in list(root)}


@pytest.mark.parametrize("task_edges", [graph.TASK_EDGES, 50])
def test_components(spark, monkeypatch, task_edges):
    monkeypatch.setattr(graph, "TASK_EDGES", task_edges)
    rng = random.Random(5)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(160)]
    links += [(1000 + i, 1001 + i) for i in range(40)] + [(2000, 2000 + i) for i in range(1, 90)]
    links += [links[0], (7, 7), (None, 3), (3, None)]
    found = graph.components(spark.createDataFrame(links, "a long, b long")).collect()
    assert len(found) == len({r.node for r in found}) and {r.node: r.root for r in found} == roots_of(links)


def test_no_edges(spark):
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0
