import random

import numpy as np
import pytest

from palimpsest.operators import components


def plain(edges):
    near = {}
    for a, b in edges:
        if a is not None and b is not None and a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    out = {}
    for start in near:
        if start not in out:
            seen, todo = {start}, [start]
            while todo:
                for x in near[todo.pop()] - seen:
                    seen.add(x)
                    todo.append(x)
            out |= dict.fromkeys(seen, min(seen))
    return out


@pytest.mark.parametrize("few", [components.FEW_EDGES, 0])
def test_components(spark, monkeypatch, few):
    monkeypatch.setattr(components, "FEW_EDGES", few)
    r = random.Random(3)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5000, 5001 + i) for i in range(3000)] + [(None, 4), (7, 7)]
    got = components.connected_components(spark.createDataFrame(edges, "x long, y long"), "x", "y").collect()
    assert {x["node"]: x["component"] for x in got} == plain(edges) and len(got) == len(plain(edges))
    assert components.connected_components(spark.createDataFrame([], "x long, y long"), "x", "y").count() == 0


def test_arrays():
    r = np.random.default_rng(1)
    for n, m in ((10, 5), (200, 150), (3000, 2999)):
        a, b = r.integers(0, n, m), r.integers(0, n, m)
        ok = a != b
        nodes, least = components.least_reachable(a[ok], b[ok])
        assert dict(zip(nodes.tolist(), least.tolist(), strict=True)) == plain(list(zip(a.tolist(), b.tolist(), strict=True)))
    chain = np.random.default_rng(2).permutation(200_000)
    nodes, least = components.least_reachable(chain[:-1], chain[1:])
    assert len(nodes) == 200_000 and not least.any()
