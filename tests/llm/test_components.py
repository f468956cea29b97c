import random

import pytest

from tideweave.llm.components import components


def brute(links):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return sorted((x, find(x)) for x in root if any(x in e and e[0] != e[1] for e in links))


@pytest.mark.parametrize("kind", ["chain", "random", "star", "none", "grid"])
def test_components(spark, kind):
    r = random.Random(3)
    links = {
        "chain": [(i, i + 1) for i in range(-40, 40)],
        "random": [(r.randrange(300), r.randrange(300)) for _ in range(170)] + [(5, 5)],
        "star": [(50, i) for i in range(100) if i != 50],
        "none": [],
        "grid": [(7 * i % 101, 7 * (i + 1) % 101) for i in range(60)] + [(200, 201), (201, 200)],
    }[kind]
    got = components(spark.createDataFrame(links, "a bigint, b bigint"))
    assert sorted(map(tuple, got.collect())) == brute(links)
