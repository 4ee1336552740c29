"""Matching more than two tables, pairwise against a reference or in linked groups."""

import itertools
import math
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..session import checkpointed
from .columns import quoted
from .combine import fix_columns
from .components import connected_components, contracted
from .match import ID1, ID2, Matcher, looked_up, sorted_join


@dataclass
class Input:
    """One table of a multi-table match: rows, unique key, position columns, row admission."""

    table: DataFrame
    key: str
    values: tuple
    join: str = "default"


def _matcher_for(matcher: Matcher, a: Input, b: Input) -> Matcher:
    return replace(matcher, values1=a.values, values2=b.values)


def admitted(inputs: list[Input], present: list[Column]) -> Column:
    """Whether an output row stays, given which tables it has an entry from.

    A row needs entries from two tables, and from every ``match`` and no ``nomatch`` table; an entry
    from an ``always`` table keeps it whatever the rest says.
    """
    stays = reduce(lambda x, y: x + y, [p.cast("int") for p in present]) >= 2
    for i, p in zip(inputs, present):
        if i.join == "match":
            stays = stays & p
        elif i.join == "nomatch":
            stays = stays & ~p
    for i, p in zip(inputs, present):
        if i.join == "always":
            stays = stays | p
    return stays


def _with_tables(ids: DataFrame, inputs: list[Input], fixcols: str, suffixes) -> DataFrame:
    """Replace the ids in columns _m0, _m1, … by the rows they stand for."""
    present = [F.col(f"_m{n}").isNotNull() for n in range(len(inputs))]
    result = ids.where(admitted(inputs, present))
    fixed = fix_columns([i.table for i in inputs], fixcols, suffixes)
    names = [f"_m{n}" for n in range(len(inputs))]
    for name, i, f in zip(names, inputs, fixed):
        result = looked_up(result, f, name, f.columns[i.table.columns.index(i.key)], "left", *names)
    return result.drop(*names)


def match_pairs(
    inputs: list[Input], matcher: Matcher, reference: int = 1, fixcols: str = "dups", suffixes: list[str] | None = None
) -> DataFrame:
    """One output row per row of the reference table, with its best match from every other table.

    ``reference`` counts from 1.
    """
    centre = inputs[reference - 1]
    ids = centre.table.select(quoted(centre.key).alias(f"_m{reference - 1}"))
    for n, other in enumerate(inputs):
        if n != reference - 1:
            best = _matcher_for(matcher, centre, other).nearest(centre.table, other.table, centre.key, other.key)
            best = best.select(F.col(ID1).alias(f"_m{reference - 1}"), F.col(ID2).alias(f"_m{n}"))
            ids = ids.join(sorted_join(best), f"_m{reference - 1}", "left")
    return _with_tables(ids, inputs, fixcols, suffixes)


# --- links in crowds ------------------------------------------------------------------------------

#: A cell whose positions all hang together is seen through one position in each of its parts, so many along each axis.
PARTS = 4
#: Cells along each axis of a region, whose links are put together before components are searched.
REGION = 64


def _positions(inputs: list[Input], matcher: Matcher) -> DataFrame:
    """Distinct positions of each table: (_node: table and smallest id there, _place)."""
    found = []
    for n, i in enumerate(inputs):
        rows = _matcher_for(matcher, i, i).keyed(i.table, i.key, i.values, "a")
        node = F.struct(F.lit(n).alias("t"), F.min("_id_a").alias("id"))
        found.append(rows.groupBy("_pa").agg(node.alias("_node")).select("_node", F.col("_pa").alias("_place")))
    return reduce(DataFrame.unionByName, found)


def _sides(rows: DataFrame, *names: str) -> tuple[DataFrame, DataFrame]:
    """The same rows as the two sides of a match, columns ``names`` with the side's letter."""
    fields = rows.schema["_place"].dataType.names
    return tuple(
        rows.select(
            F.struct(*[F.col(f"_place.{f}").alias(f.replace("a", side, 1)) for f in fields]).alias(f"_p{side}"),
            *[F.col(n).alias(n + side) for n in names],
        ).select("*", f"_p{side}.*")
        for side in "ab"
    )


class _Links:
    """Links that make the same groups as all close pairs, no more than some for each position.

    Cells are so small that all positions in one are close. Where a cell has positions of two tables (``among`` one table: of
    that table), all of them hang together: each gets a link to the first one, and the cell counts as one head. A head
    needs one link to any other only, and first looks for it with one position of each table in each of its parts.
    Positions of a table alone in their cell are heads of their own.
    """

    def __init__(self, matcher: Matcher, positions: DataFrame, among: bool):
        self.matcher, self.count, self.among = matcher, len(matcher.axes("a")), among
        side = (1 - 1e-6) / math.sqrt(self.count)
        axes = matcher.axes("a")
        cell = F.struct(*[F.floor(u / side).alias(f"k{i}") for i, u in enumerate(axes)])
        part = F.struct(*[F.floor(u / side * PARTS).alias(f"k{i}") for i, u in enumerate(axes)])
        rows = positions.select("*", "_place.*").select("_node", "_place", cell.alias("_cell"), part.alias("_part"))
        first = rows.groupBy("_cell").agg(F.min("_node").alias("_first"), F.max("_node").alias("_last"))
        shared = first.where("_first <> _last" if among else "_first.t <> _last.t").select("_cell", "_first")
        self.rows = checkpointed(rows.join(shared, "_cell", "left").withColumn("_head", F.coalesce("_first", "_node")))
        table = F.col("_node.t")
        part = F.when(F.col("_first").isNotNull(), F.col("_part"))
        seen = self.rows.groupBy("_head", part.alias("_part"), table.alias("_t")).agg(
            F.min(F.struct("_node", "_place")).alias("_one"), F.min("_cell").alias("_cell"), F.count("*").alias("_n")
        )
        self.seen = checkpointed(seen.select("_head", "_t", "_one._place", "_cell", "_n"))

    def first(self) -> DataFrame:
        """(u, v): numbers that stars in shared cells and links found between parts connect, chains inside a region made stars.

        Links of one region meet in one task where the region is not too full, which is not needed for right results.
        """
        stars = self.rows.where("_first <> _node").select("_cell", F.col("_node.id").alias("u"), F.col("_first.id").alias("v"))
        close = self.matcher.candidates(*_sides(self.seen, "_head", "_t", "_cell")).where("_heada <> _headb")
        if not self.among:
            close = close.where("_ta <> _tb")
        links = stars.unionByName(close.select(F.col("_cella").alias("_cell"), F.col("_heada.id").alias("u"), F.col("_headb.id").alias("v")))
        region = F.xxhash64(*[F.floor(F.col(f"_cell.k{i}") / REGION) for i in range(self.count)])
        near = links.select(region.alias("_region"), "u", "v").hint("rebalance", F.col("_region")).sortWithinPartitions("_region")
        return contracted(near.select("u", "v"))

    def crowds(self) -> DataFrame:
        """Cells with positions that :meth:`first` did not look at."""
        return self.seen.where("_n > 1").select("_cell").distinct()

    def second(self, components: DataFrame, crowds: DataFrame) -> DataFrame:
        """The links that are missing, given the components that the first links make.

        Only cells that hold different components and one of which is crowded are compared position by position.
        """
        rows = self.rows.join(components, F.col("_node.id") == F.col("node"), "left").withColumn("_group", F.coalesce("component", "_node.id"))
        rows = rows.withColumn("_t", F.col("_node.t"))
        reach = math.ceil(math.sqrt(self.count) * (1 + 2e-6))
        offsets = F.array(*[F.array(*map(F.lit, o)) for o in itertools.product(range(-reach, reach + 1), repeat=self.count)])
        near = crowds.select(F.col("_cell").alias("_ca"), F.explode(offsets).alias("_o"))
        moved = F.struct(*[(F.col(f"_ca.k{i}") + F.col("_o")[i]).alias(f"k{i}") for i in range(self.count)])
        pairs = near.select("_ca", moved.alias("_cb"))
        for n in "ab":
            ends = rows.groupBy(F.col("_cell").alias(f"_c{n}")).agg(F.min("_group").alias(f"_low{n}"), F.max("_group").alias(f"_high{n}"))
            pairs = pairs.join(ends, f"_c{n}")
        pairs = pairs.where("not (_lowa = _higha and _lowb = _highb and _lowa = _lowb)").select("_ca", "_cb")
        left, right = _sides(rows, "_cell", "_head", "_t", "_group")
        met = pairs.join(left, F.col("_ca") == F.col("_cella")).join(right, F.col("_cb") == F.col("_cellb")).where("_groupa <> _groupb")
        return _heads(self.matcher.scored(met), self.among)


def _between(matcher: Matcher, a: DataFrame, b: DataFrame, among: bool) -> DataFrame:
    return _heads(matcher.candidates(a, b), among)


def _heads(close: DataFrame, among: bool) -> DataFrame:
    """(u, v) of the heads of close positions, of different tables unless ``among`` one."""
    if not among:
        close = close.where("_ta <> _tb")
    return close.where("_heada <> _headb").select(F.greatest("_heada", "_headb").alias("u"), F.least("_heada", "_headb").alias("v")).distinct()


def _linked(positions: DataFrame, matcher: Matcher, among: bool) -> DataFrame:
    """(node, component) for positions linked by chains of close pairs, as a written table."""
    if matcher.axes("a") is None:
        rows = positions.select("_place", F.col("_node").alias("_head"), F.col("_node.t").alias("_t"))
        return checkpointed(connected_components(_between(matcher, *_sides(rows, "_head", "_t"), among)))
    # Numbers instead of ids of any type; the names come back in the end.
    numbered = checkpointed(positions.withColumn("_num", F.monotonically_increasing_id()))
    cells = _Links(matcher, numbered.select(F.struct("_node.t", F.col("_num").alias("id")).alias("_node"), "_place"), among)
    components = checkpointed(connected_components(cells.first()))
    crowds = cells.crowds()
    if not crowds.isEmpty():
        more = checkpointed(cells.second(components, crowds).select("u.id", F.col("v.id").alias("other")).toDF("u", "v"))
        if not more.isEmpty():
            components = checkpointed(connected_components(components.toDF("u", "v").where("u <> v").unionByName(more)))
    members = components.join(numbered.select("_node", "_num"), F.col("node") == F.col("_num")).select("_node", "component")
    names = members.groupBy("component").agg(F.min("_node").alias("_name"))
    return checkpointed(members.join(names, "component").select(F.col("_node").alias("node"), F.col("_name").alias("component")))


def match_groups(inputs: list[Input], matcher: Matcher, fixcols: str = "dups", suffixes: list[str] | None = None) -> DataFrame:
    """One output row per group of rows that are linked by chains of close pairs between tables.

    Of several entries from one table the one with the smallest key is shown.
    """
    components = _linked(_positions(inputs, matcher), matcher, False)
    members = components.select(F.col("node.t").alias("t"), F.col("node.id").alias("id"), "component")
    ids = members.groupBy("component").agg(
        *[F.min(F.when(F.col("t") == n, F.col("id"))).alias(f"_m{n}") for n in range(len(inputs))]
    ).drop("component")
    for n, i in enumerate(inputs):
        if i.join != "always":
            continue
        # Rows without any link are groups of their own. Rows at a linked position belong to its group.
        one = _matcher_for(matcher, i, i)
        rows = one.keyed(i.table, i.key, i.values, "a")
        linked = members.where(F.col("t") == n).select(F.col("id").alias("_ia"))
        first = rows.groupBy("_pa").agg(F.min("_id_a").alias("_ia")).join(linked, "_ia", "left_semi")
        grouped = rows.join(first, "_pa", "left_semi").select(F.col("_id_a").alias("_g"))
        alone = i.table.select(quoted(i.key).alias(f"_m{n}")).join(grouped, F.col(f"_m{n}") == F.col("_g"), "left_anti")
        ids = ids.unionByName(alone, allowMissingColumns=True)
    return _with_tables(ids, inputs, fixcols, suffixes)


def within_pairs(table: DataFrame, key: str, matcher: Matcher, values: tuple) -> DataFrame:
    """Close pairs of rows of one table, each once with the smaller key first: (_id1, _id2, _score).

    As many as there are; where copies abound, :func:`within_groups` says the same in one row per row.
    """
    return replace(matcher, values1=values, values2=values).pairs(table, table, key, key).where(F.col(ID1) < F.col(ID2))


def within_groups(table: DataFrame, key: str, matcher: Matcher, values: tuple, group: str = "group", size: str = "size") -> DataFrame:
    """Rows of one table that are linked with another by chains of close pairs: key, group (its smallest key), its size.

    Rows at one position are one from the start, so copies make no pairs. Rows with blank positions are in no group.
    """
    one = replace(matcher, values1=values, values2=values)
    component = _linked(_positions([Input(table, key, values)], one), one, True).select(F.col("node.id").alias("node"), F.col("component.id").alias("component"))
    rows = one.keyed(table, key, values, "a")
    firsts = rows.groupBy("_pa").agg(F.min("_id_a").alias("_ia"), F.count("*").alias("_na"))
    places = firsts.join(component, F.col("_ia") == F.col("node"), "left").select(
        F.col("_pa").alias("_place"), F.coalesce("component", "_ia").alias("_group"), F.col("_na").alias("_n")
    )
    sizes = places.groupBy("_group").agg(F.sum("_n").alias("_size")).where("_size > 1")
    places = places.drop("_n").join(sizes, "_group")
    return rows.join(places, F.col("_pa") == F.col("_place")).select(
        F.col("_id_a").alias(key), F.col("_group").alias(group), F.col("_size").alias(size)
    )
