"""The source audit against its contract in plain Python."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from tablemill.llm import divergence, terms

WORD = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def words(text, pattern=WORD):
    return pattern.findall(re.sub("[A-Z]+", lambda m: m.group().lower(), text or ""))


def plain(rows, top=200):
    """Rows of the audit of (lang, source, text)."""
    counts, docs = defaultdict(Counter), defaultdict(Counter)
    for lang, source, text in rows:
        w = words(text)
        counts[lang or "", source or ""].update(w)
        docs[lang or ""].update(set(w))
    out = []
    for (lang, source), own in counts.items():
        kept = sorted((t for t, n in docs[lang].items() if n >= 3), key=lambda t: t.encode())

        def shares(c):
            n = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 1) // (n + len(kept)) for t in kept}

        p = shares(own)
        pairs = []
        whole = Counter()
        for (l, other), c in counts.items():
            if l == lang:
                whole.update(c)
                if other != source:
                    q = shares(c)
                    pairs.append((-sum((p[t] - q[t]) ** 2 // q[t] for t in kept), other.encode()))
        q = shares(whole)
        most = [(-((p[t] - q[t]) ** 2 // q[t]), t.encode()) for t in kept if own[t] and p[t] > q[t]]
        for part, items in (("pair", sorted(pairs)), ("term", sorted(most)[:top])):
            out += [(lang, source, part, item.decode(), -value, k + 1) for k, (value, item) in enumerate(items)]
    return sorted(out)


def audited(docs):
    return sorted((r.lang, r.source, r.part, r.item, r.value, r["rank"]) for r in divergence.audit(docs).collect())


def test_driver_table(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert audited(docs) == plain([(r.lang, r.source, r.text) for r in docs.collect()])


SCHEMA = "text string, lang string, source string, other string, at int, n string, total long, block string"


def table(spark, rows):
    return spark.createDataFrame([(t, l, s, "x", 1, "n", 2, None) for l, s, t in rows], SCHEMA)


@pytest.mark.parametrize("seed", [1, 2])
def test_blocks_pieces_and_ties(spark, monkeypatch, seed):
    monkeypatch.setattr(divergence, "BLOCK", 3)
    monkeypatch.setattr(divergence, "TOP", 4)
    monkeypatch.setattr(terms, "PIECE", 40)
    draw = random.Random(seed)
    stock = ["the", "The", "ünder", "b1b", "c-d", "x" * 60, "é", "zz", "…", "9", ""]
    rows = [(draw.choice(["en", "de", None, ""]), draw.choice(["a", "b", "c", "B", None]), " ".join(draw.choices(stock, k=draw.choice([0, 1, 5, 60])))) for _ in range(70)]
    rows += [("en", "a", None), ("xx", "alone", "one two"), ("yy", "p", "one"), ("yy", "q", "two"), ("en", "quiet", "!!! 12")]
    rows += [("en", "hot", "the same words again")] * 40
    assert audited(table(spark, rows)) == plain(rows, 4)


def test_nothing(spark):
    assert audited(table(spark, [])) == []
    assert audited(table(spark, [(None, None, None)] * 3)) == []
    assert audited(table(spark, [("en", "a", None), ("en", "b", "x x")])) == [("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)]


def test_long_division():
    for count, total in ((0, 1), (10**14, 10**14 + 7), (999_999_999_999, 10**13), (6, 7)):
        assert divergence.shares(np.array([count]), total)[0] == 1 + 10**9 * (count + 1) // total


def test_terms_of_pieces(monkeypatch):
    import pyarrow as pa

    column = pa.array(["Ab c1ü", None, "", "  ", "a b c d e f g h i j k", "Üb" * 30 + " x"])
    table = terms.classes(digits=True)
    for limit in (1, 5, 1000):
        found = defaultdict(list)
        for k, data, offsets in terms.pieces(column, table, limit):
            number, known, places = terms.terms(data, offsets)
            for i in range(len(offsets) - 1):
                found[k + i] += [known[int(x)].as_py().decode() for x in number[places[i] : places[i + 1]]]
        pattern = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
        assert [found[i] for i in range(len(column))] == [words(t, pattern) for t in column.to_pylist()]
