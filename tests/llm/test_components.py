"""Components of links: random graphs against a union-find, nodes with very many neighbours, and how many jobs they take."""

import random

import pytest

from fillwise.llm import common


def roots_by_hand(links):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in links:
        if a is not None and b is not None and a != b:
            lo, hi = sorted((find(a), find(b)))
            root[hi] = lo
    return {x: find(x) for x in list(root)}


def roots(spark, links):
    rows = common.components(spark.createDataFrame(links, "a long, b long")).collect()
    got = {r["node"]: r["root"] for r in rows}
    assert len(got) == len(rows)
    return got


@pytest.mark.parametrize("seed", range(4))
def test_random_graphs(spark, seed, monkeypatch):
    if seed % 2:
        monkeypatch.setattr(common, "HOT_DEGREE", 3)
    rng = random.Random(seed)
    links = [(rng.randrange(150), rng.randrange(150)) for _ in range(110)]
    links += [(77, rng.randrange(100, 150)) for _ in range(20)] + [(200 + i, 201 + (i * 7) % 11) for i in range(9)]
    links += [(links[0][1], links[0][0]), (5, None), (None, 6), (9, 9)]
    rng.shuffle(links)
    assert roots(spark, links) == roots_by_hand(links)


def test_no_links(spark):
    assert roots(spark, []) == {} and roots(spark, [(3, 3), (None, 1)]) == {}


def jobs(spark, group, links):
    spark.sparkContext.setJobGroup(group, group)
    try:
        assert roots(spark, links) == roots_by_hand(links)
    finally:
        spark.sparkContext._jsc.clearJobGroup()
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))


def test_few_links_take_few_jobs(spark):
    """Every job costs the driver memory: stars are known as such at once, other links take a few jobs a round."""
    stars = [(10 * i, 10 * i + k) for i in range(20) for k in range(1, 8)]
    assert jobs(spark, "stars", stars) <= 8
    assert jobs(spark, "pairs of stars", stars + [(8, 15), (33, 41)]) <= 36
