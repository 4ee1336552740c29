"""How the sources of a language differ in their words: sorted sparse counts merged pair by pair."""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..operators.rank import number_rows
from ..session import written
from . import terms as cut

#: A term is kept in a language from so many of its documents on.
LEAST_DOCS = 3
#: Shares are whole numbers of this fraction.
UNIT = 1_000_000_000
#: Terms whose counts travel as one pair of arrays: what a pair task holds, whatever the size of the vocabulary.
BLOCK = 1 << 16
#: Terms reported of each group.
TOP = 200


def term_counts(docs: DataFrame, table: bytes) -> DataFrame:
    """(lang, source, term, n, docs) of docs (lang, source, text): occurrences, and documents with the term."""

    def count(batches):
        for batch in batches:
            lang, source = (batch.column(i).dictionary_encode().indices.to_numpy().astype(np.int64) for i in (0, 1))
            _, first, group = np.unique(lang * batch.num_rows + source, return_index=True, return_inverse=True)
            last, seen = -1, None
            for k, data, offsets in cut.pieces(batch.column(2), table):
                number, known, places = cut.terms(data, offsets)
                width = max(len(known), 1)
                pair, n = np.unique(np.repeat(np.arange(len(places) - 1), np.diff(places)) * width + number, return_counts=True)
                row, term = pair // width, pair % width
                fresh = np.ones(len(pair), np.int64)
                # A long text comes in pieces, and its terms count as one document's.
                own = set(known.to_pylist()) if len(places) == 2 else None
                if k == last and seen:
                    old = np.array([t in seen for t in known.to_pylist()], bool)
                    fresh[old[term]] = 0
                    own |= seen
                last, seen = k + len(places) - 2, own
                key, place = np.unique(group[k + row] * width + term, return_inverse=True)
                at = pa.array(first[key // width])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(at), batch.column(1).take(at), known.take(pa.array(key % width)).cast(pa.large_string()),
                     pa.array(np.bincount(place, n, len(key)).astype(np.int64)), pa.array(np.bincount(place, fresh, len(key)).astype(np.int64))],
                    names=["lang", "source", "term", "n", "docs"],
                )

    found = docs.mapInArrow(count, "lang string, source string, term string, n long, docs long")
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def shares(count: np.ndarray, total: int) -> np.ndarray:
    """1 + floor(UNIT * (count + 1) / total), by long division in steps of 1,000, so that nothing overflows."""
    rest, out = np.asarray(count, np.int64) + 1, 0
    for _ in range(3):
        rest = rest * 1000
        out, rest = out * 1000 + rest // total, rest % total
    return 1 + out


def share(count: Column, total: Column) -> Column:
    """The same as a column."""
    upper = (count + 1).cast("decimal(19,0)") * F.lit(UNIT).cast("decimal(10,0)")
    return F.call_function("div", upper, total.cast("decimal(19,0)")) + 1


def both_ways(one: tuple, two: tuple, size: int, kinds: int) -> tuple[int, int]:
    """Sums of floor((p - q)² / q) with p of the first group and q of the second, and the other way round, over the
    ``size`` terms of a block. A group is (sorted places, counts, total of its counts); ``kinds`` is the vocabulary.

    Places of the shorter array are looked up in the longer one, each search starting where the last one ended. What
    only one group has meets the share of a count of 0; terms that neither has are priced once and multiplied.
    """
    if not kinds:
        return 0, 0
    swapped = len(one[0]) > len(two[0])
    (a, n, all_n), (b, m, all_m) = (two, one) if swapped else (one, two)
    at = np.searchsorted(b, a)
    met = np.zeros(len(a), bool)
    inside = at < len(b)
    met[inside] = b[at[inside]] == a[inside]
    alone = np.ones(len(b), bool)
    alone[at[met]] = False
    p, q = shares(n, all_n + kinds), shares(m, all_m + kinds)
    p0, q0 = shares(np.zeros(1, np.int64), all_n + kinds), shares(np.zeros(1, np.int64), all_m + kinds)
    neither = size - len(a) - int(alone.sum())
    forth = back = 0
    for x, y, times in ((p[met], q[at[met]], 1), (p[~met], q0, 1), (p0, q[alone], 1), (p0, q0, neither)):
        square = (x - y) ** 2
        forth += times * int((square // y).sum())
        back += times * int((square // x).sum())
    return (back, forth) if swapped else (forth, back)


def _pair(one: pa.Table, two: pa.Table) -> pa.Table:
    sides = []
    for table, prefix in ((one, ""), (two, "_")):
        places, counts = (table.column(prefix + c).combine_chunks().flatten().to_numpy() for c in ("places", "counts"))
        sides.append((places, counts, table.column(f"{prefix}total")[0].as_py()))
    forth, back = both_ways(*sides, one.column("size")[0].as_py(), one.column("kinds")[0].as_py())
    return one.select(["lang", "one", "two"]).append_column("forth", pa.array([forth], pa.int64())).append_column("back", pa.array([back], pa.int64()))


def audit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """Rows (lang, source, part, item, value, rank) for every (lang, source) that occurs.

    Part ``pair``: item is each other source of the language, value how far this group's shares of the kept terms lie
    from that source's, summed over all kept terms. Part ``term``: the TOP terms whose share here most exceeds that in
    the whole language. Largest values come first, equal ones in the order of the item's bytes.

    Null and empty columns are the same group, ''. Groups without kept terms have the share of a count of 0 for every
    term, and no row in part ``term``; a language without kept terms has distances of 0. Repeated rows count each; an
    empty table gives no rows. Other columns are ignored.

    A pair task gets the two groups' counts for one block of BLOCK terms, so no task holds a vocabulary. The pairs of
    the sources of a language are what the result consists of.
    """
    empty = F.lit("")
    rows = docs.select(*[F.coalesce(docs[c].cast("string"), empty).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))])
    counts = written(term_counts(rows, cut.classes(digits=False)), "term-counts")
    kept = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("all_n")).where(F.col("docs") >= LEAST_DOCS).drop("docs")
    kept = number_rows(kept, [F.col("lang"), F.col("term")], "at").withColumn("at", F.col("at") - 1)
    languages = written(kept.groupBy("lang").agg(F.count("*").alias("kinds"), F.sum("all_n").alias("lang_total")), "languages")
    found = written(counts.drop("docs").join(kept, ["lang", "term"]), "found")

    groups = rows.select("lang", "source").distinct()
    totals = found.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    nothing = F.lit(0).cast("long")
    groups = groups.join(totals, ["lang", "source"], "left").join(languages, "lang", "left").select(
        "lang", "source", *[F.coalesce(c, nothing).alias(c) for c in ("total", "kinds", "lang_total")]
    )
    groups = written(groups, "groups")

    block = F.floor(F.col("at") / BLOCK).alias("block")
    blocks = kept.groupBy("lang", block).agg(F.count("*").alias("size"))
    entry = F.struct((F.col("at") % BLOCK).cast("int").alias("at"), "n")
    packed = found.groupBy("lang", "source", block).agg(F.array_sort(F.collect_list(entry)).alias("counts"))
    # Every group has a row for every block of its language, also where it has none of the terms.
    grid = groups.join(blocks, "lang", "left").withColumn("block", F.coalesce("block", nothing)).withColumn("size", F.coalesce("size", nothing))
    # Two plain arrays take 12 bytes a term on the way to the pair tasks, an array of pairs 32.
    arrays = [F.coalesce(F.col(f"counts.{c}"), F.array().cast(f"array<{kind}>")).alias(name) for c, kind, name in (("at", "int", "places"), ("n", "long", "counts"))]
    packed = grid.join(packed, ["lang", "source", "block"], "left").select("lang", "source", "block", "size", "kinds", "total", *arrays)
    packed = written(packed, "packed")
    other = groups.select(F.col("lang").alias("_lang"), F.col("source").alias("other"))
    pairs = packed.join(other, (F.col("lang") == F.col("_lang")) & (F.col("source") != F.col("other"))).drop("_lang")
    key = ["lang", "block", "one", "two"]
    left = pairs.where("source < other").withColumnsRenamed({"source": "one", "other": "two"})
    right = pairs.where("source > other").withColumnsRenamed({"source": "two", "other": "one"})
    right = right.select(*[F.col(c).alias(f"_{c}") for c in (*key, "total", "places", "counts")])
    priced = left.groupBy(*key).cogroup(right.groupBy(*[f"_{k}" for k in key])).applyInArrow(_pair, "lang string, one string, two string, forth long, back long")
    priced = priced.groupBy("lang", "one", "two").agg(F.sum("forth").alias("forth"), F.sum("back").alias("back"))
    ways = F.array(
        F.struct(F.col("one").alias("source"), F.col("two").alias("item"), F.col("forth").alias("value")),
        F.struct(F.col("two").alias("source"), F.col("one").alias("item"), F.col("back").alias("value")),
    )
    apart = priced.select("lang", F.explode(ways).alias("way")).select("lang", "way.*", F.lit("pair").alias("part"))
    # A window has as many rows as the language has other sources.
    place = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item"))
    apart = apart.withColumn("rank", place)

    p, q = share(F.col("n"), F.col("total") + F.col("kinds")), share(F.col("all_n"), F.col("lang_total") + F.col("kinds"))
    typical = found.join(groups, ["lang", "source"]).withColumn("p", p).withColumn("q", q).where("n > 0 and p > q")
    typical = typical.select("lang", "source", F.col("term").alias("item"), F.expr("(p - q) * (p - q) div q").alias("value"), F.lit("term").alias("part"))
    typical = cut.firsts(typical, ["lang", "source", "part"], [F.col("value").desc(), F.col("item")], F.col("item"), TOP)
    names = ["lang", "source", "part", "item", "value", "rank"]
    return apart.select(*names).unionByName(typical.select(*names))

