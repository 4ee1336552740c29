"""Best matches where many positions are near: right ones, and without sorting their pairs."""

import math
import random

from tablemill.operators import match

from .test_match import greedy, ids, table

NAMES = ("x0", "x1")


def test_ties_in_a_crowd_go_to_the_smallest_id(spark, monkeypatch):
    """Positions on a coarse grid: equal distances in one cell and across cells of several levels."""
    monkeypatch.setattr(match, "LEAF", 3)
    r = random.Random(4)
    a, b = [[(r.randrange(24) / 8, r.randrange(24) / 8) for _ in range(90)] for _ in range(2)]
    found = match.find_pairs(match.Cartesian(0.5, NAMES, NAMES), table(spark, a, "ia"), table(spark, b, "ib"), "ia", "ib", "best1")
    near = [min((math.dist(p, q), j) for j, q in enumerate(b)) for p in a]
    assert ids(found) == {(i, j) for i, (d, j) in enumerate(near) if d <= 0.5}


def test_pairs_are_hashed_not_sorted(spark):
    """Sorting all candidate pairs for their minimum filled the disk; least scores are kept in a hash table instead."""
    r = random.Random(6)
    a, b = [[(r.random(), r.random()) for _ in range(200)] for _ in range(2)]
    found = match.find_pairs(match.Cartesian(1.0, NAMES, NAMES), table(spark, a, "ia"), table(spark, b, "ib"), "ia", "ib", "best1")
    plan = [line for line in found._jdf.queryExecution().executedPlan().toString().splitlines() if "partial_min(_score" in line]
    assert plan and all("HashAggregate" in line for line in plan)


def test_one_to_one_along_a_chain_lists_few_pairs(spark, monkeypatch):
    """All positions hang together and each has some 24 partners within the reach: the nearest are paired off in steps."""
    r = random.Random(14)
    a, b = [[(r.uniform(0, 25),) for _ in range(300)] for _ in range(2)]
    listed, taken = [], match._paired_off
    monkeypatch.setattr(match, "_paired_off", lambda close: listed.append(close.count()) or taken(close))
    monkeypatch.setattr(match, "FEW", 0)
    found = match.find_pairs(match.Cartesian(1.0, ("x0",), ("x0",)), table(spark, a, "ia"), table(spark, b, "ib"), "ia", "ib", "best")
    assert ids(found) == greedy(a, b, 1.0, math.dist)
    assert max(listed) <= 4 * len(a + b)
