"""Filling what is left of a source's target."""

import random

from tablemill.llm import mixing


def test_rounds_fill_the_gaps_and_leave_fewer_rows(spark, monkeypatch):
    """The rows taken are those of going through all rows in order; no round joins away rows that an earlier one went through."""
    r = random.Random(3)
    rows = [(s, r.choice([1, 2, 3, 5, 9, 30, 70]), r.random(), k) for k, s in enumerate(r.choices(["a", "b", None], k=400))]
    left = [(s, size, rank, int(rank * 64), k, k, k) for s, size, rank, k in rows]
    df = spark.createDataFrame(left, "source string, size long, rank double, bin int, doc_id long, crc long, row long")
    gaps = {"a": 203.0, "b": 77.0, None: 5.0}
    opened, write = [], mixing.written
    monkeypatch.setattr(mixing, "written", lambda d, name: (opened.append(d.count()) if name == "open" else None) or write(d, name))
    found = mixing._filled(df, spark.createDataFrame(list(gaps.items()), "source string, gap double"))
    expected = set()
    for source, gap in gaps.items():
        for _, size, k in sorted((rank, size, k) for s, size, rank, k in rows if s == source):
            if size <= gap:
                gap -= size
                expected.add(k)
    assert {x.row for x in found.collect()} == expected
    assert opened and opened == sorted(opened, reverse=True) and opened[-1] < opened[0]
