import random

import pytest

from lodestar.llm import graph
from lodestar.llm.tables import Saved


def brute(links):
    low = {x: x for ab in links for x in ab}
    while any(low[a] != low[b] for a, b in links):
        for a, b in links:
            low[a] = low[b] = min(low[a], low[b])
    return low


def shapes():
    rng = random.Random(4)
    chain = list(range(1000, 1060))
    rng.shuffle(chain)
    links = list(zip(chain, chain[1:], strict=False))  # one long chain
    links += [(k, 5) for k in range(2000, 2400)] + [(5, 5), (7, 2000), (2000, 7)]  # a star, a loop, a repeated link
    links += [(rng.randrange(3000, 3300), rng.randrange(3000, 3300)) for _ in range(170)]
    rng.shuffle(links)
    return links


@pytest.mark.parametrize("last", [0, 100, graph.LAST])
def test_components_by_rounds_and_by_one_last_task_agree(spark, monkeypatch, last):
    monkeypatch.setattr(graph, "LAST", last)
    links = shapes()
    want = {x: c for x, c in brute(links).items() if any(x in ab and ab[0] != ab[1] for ab in links)}
    edges = spark.createDataFrame([*links, (None, 1000), (9000, None)], "a long, b long").repartition(7)
    got = graph.components(edges).collect()
    assert len(got) == len(want) and {r.node: r.component for r in got} == want
    assert graph.components(edges.where("a = b")).count() == 0


def test_few_links_need_no_rounds(spark, monkeypatch):
    written = []
    monkeypatch.setattr(graph, "Saved", type("Counted", (Saved,), {"save": lambda self, df: written.append(df) or super(type(self), self).save(df)}))
    assert graph.components(spark.createDataFrame(shapes(), "a long, b long").repartition(7)).count() > 500
    assert len(written) == 2  # the links of each task, then those of all: a round more of shuffles and jobs each before
