import random

import pytest

from millrace.llm import _graph, _skew
from millrace.llm._graph import components
from millrace.llm._skew import count_by, hot_keys, salted_join
from millrace.llm._store import Scratch
from pyspark.sql import functions as F


def brute(edges):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = sorted((find(a), find(b)))
            root[b] = a
    return {x: find(x) for x in root}


@pytest.mark.parametrize("hub", [1 << 20, 5])
def test_components_with_and_without_hubs(spark, monkeypatch, hub):
    monkeypatch.setattr(_graph, "HUB_EDGES", hub)
    r = random.Random(1)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(180)] + [(1000, 1001 + i) for i in range(60)] + [(2000 + i, 2001 + i) for i in range(30)] + [(5, 5), (9, 9)]
    found = components(spark.createDataFrame(edges, "u long, v long"), Scratch(spark, "test"), f"cc{hub}_").collect()
    assert {x.node: x.root for x in found} == brute(edges) and len(found) == len(brute(edges))


def test_salted_join_equals_a_plain_one(spark, monkeypatch):
    monkeypatch.setattr(_skew, "HOT_ROWS", 20)
    many = spark.createDataFrame([(i % 3 if i < 300 else i, i) for i in range(400)] + [(None, 1)], "k long, x long")
    one = spark.createDataFrame([(i, f"v{i}") for i in (0, 1, 350, 999)] + [(None, "null")], "k long, v string")
    hot = hot_keys(count_by(many, "k"), "k", 401)
    assert {r.k for r in hot.collect()} == {0, 1, 2}
    for how in ("inner", "left"):
        rows = lambda df: sorted(map(repr, df.select("k", "x", "v").collect()))
        assert rows(salted_join(many, one, "k", F.xxhash64("x"), hot, how)) == rows(many.join(one, "k", how))
    assert hot_keys(count_by(many, "k"), "k", 15) is None
