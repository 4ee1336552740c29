"""What a task holds, moves and writes stays bounded, with the same results."""

import random

import pandas as pd

from tablemill.functions import conversions
from tablemill.operators import components, prepare


def test_a_tokenizer_gets_texts_of_bounded_length(spark, monkeypatch):
    """A whole Arrow batch of lists at once took gigabytes of Python memory."""
    monkeypatch.setattr(prepare, "CHARACTERS", 10)
    texts = ["abc", "", "x" * 25, "de", "fghijklm", "n", ""] * 3

    def ids(batch: pd.Series) -> pd.Series:
        held = sum(map(len, batch))
        assert held <= 10 or len(batch) == 1
        return batch.map(lambda t: [ord(c) for c in t])

    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string").coalesce(1)
    got = {r.i: (r.input_ids, r.attention_mask) for r in prepare.tokenise(df, ids).collect()}
    assert got == {i: ([ord(c) for c in t], [1] * len(t)) for i, t in enumerate(texts)}


def test_conversions_that_fail_by_the_million_throw_nothing(spark):
    """A failed cast costs an exception; whatever cannot be a number of the kind is seen before."""
    texts = ["n1", "1n", "", "--1", "1 2", "128", "-129", "40000", "3000000000"]
    kinds = {"byte": {128, -129, 40000, 3000000000}, "short": {40000, 3000000000}, "int": {3000000000}}
    for kind, beyond in kinds.items():
        checks = [(conversions.parse_byte, conversions.parse_short, conversions.parse_int)[list(kinds).index(kind)]("t").alias("v")]
        df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", *checks)
        assert {r.t for r in df.where("v is null").collect()} == {t for t in texts if not t.lstrip("-").isdigit() or t.startswith("--") or int(t) in beyond}
        condition = df._jdf.queryExecution().optimizedPlan().toString()
        assert "RLIKE" in condition and ">=" in condition
    edges = [(-32768.9, -32768), (-32769.0, None), (32767.9, 32767), (32768.0, None), (float("nan"), None), (float("inf"), None)]
    got = spark.createDataFrame([(v,) for v, _ in edges], "v double").select(conversions.to_short("v").alias("s"))
    assert [r.s for r in got.collect()] == [s for _, s in edges]
    assert "CASE WHEN" in got._jdf.queryExecution().optimizedPlan().toString()


def test_pairs_and_stars_are_done_before_any_round(spark, monkeypatch):
    """Finished parts of a graph leave; every round used to move all links again."""
    moved, keep = [], components.checkpointed
    monkeypatch.setattr(components, "checkpointed", lambda df: moved.append(keep(df)) or moved[-1])
    r = random.Random(3)
    chain = [(1000 + i, 1001 + i) for i in range(9)]
    edges = [(2 * i, 2 * i + 1) for i in range(50)] + [(500, 501 + i) for i in range(40)] + chain + [(700, 701), (701, 702), (700, 702)]
    edges += [(2000 + r.randrange(60), 2000 + r.randrange(60)) for _ in range(45)]
    found = {x.node: x.component for x in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    wanted = {n: n for e in edges if e[0] != e[1] for n in e}
    while any(wanted[a] != wanted[b] for a, b in edges if a != b):
        for a, b in edges:
            if a != b:
                wanted[a] = wanted[b] = min(wanted[a], wanted[b])
    assert found == wanted
    # After the list of links itself and the first look at it, rounds move what is no pair and no star.
    assert all(df.count() < len(edges) / 2 for df in moved[2:] if "leaf" in df.columns)
