import random

import pytest

from lodestream.llm.components import components


def union_find(links):
    parent = {x: x for link in links for x in link}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return sorted((x, find(x)) for x in parent)


def chain(seed):
    r = random.Random(seed)
    ids = r.sample(range(100), r.randint(5, 12))
    return list(zip(ids, ids[1:], strict=False))


@pytest.mark.parametrize("links", [[(1, 3), (3, 4), (4, 5), (5, 2)], *map(chain, range(12))], ids=str)
def test_single_chains(spark, links):
    got = components(spark.createDataFrame(links, "a long, b long")).collect()
    assert sorted((r.node, r.component) for r in got) == union_find(links)
