"""Cycles of a graph against a search in plain Python."""

import random

import pytest

from lodestone.operators import graph as G


@pytest.mark.parametrize("longest", [2, 5, 6])
def test_cycles_equal_brute_force(spark, longest):
    r = random.Random(longest)
    pairs = {(r.randrange(30), r.randrange(30)) for _ in range(45)} | {(40, i) for i in range(30)} | {(i, 41) for i in range(30)} | {(i, i + 1) for i in range(50, 58)} | {(58, 50), (60, 60)}
    edges = spark.createDataFrame([(a, b, "E") for a, b in pairs] + [(1, 2, "other"), (None, 3, "E"), (3, None, "E")], "src long, dst long, type string")
    want = {}
    for start in {a for a, _ in pairs}:
        at = {start}
        for n in range(1, longest + 1):
            at = {b for a, b in pairs if a in at and a != b}
            if start in at:
                want[start] = n
                break
    got = G.cycles(edges, ["E"], longest)
    assert {x["id"]: x["length"] for x in got.collect()} == want
    assert G.cycles(edges.where("src >= 50"), ["E"], 8).count() == 0
    assert G.cycles(edges.where("false"), ["E"], longest).count() == 0
