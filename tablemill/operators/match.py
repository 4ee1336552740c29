"""Matching rows of two tables by equality, by distance on the sky, or by distance in space.

A matcher knows how to find pairs: rows of the first and second table (ids and a score, 0 for a
perfect match) that are close enough. Tolerance matches become equi-joins on grid cells, so Spark
plans, spills and splits them like any other join:

* cells are as wide as the search reaches on both sides, so a row looks into few cells;
* only the first table is copied into the cells it can reach, the second has one cell per row, and
  hence no pair is ever found twice;
* rows that only differ by id share one position, and positions are matched, not rows: a third of
  all rows at one place is a single candidate as far as best matches are concerned.
"""

import math
from dataclasses import dataclass, replace

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.sky import sky_distance, unit_vector
from ..session import checkpointed
from .combine import fix_columns
from .columns import quoted
from .components import connected_components, contracted
from .rank import rank_within

ID1, ID2, SCORE = "_id1", "_id2", "_score"
_ARCSEC = 1 / 3600
# The power of two, in arcseconds, that is more than half the sky.
_WHOLE_SKY = 20


class Matcher:
    """Positions are columns ``values1`` of the first and ``values2`` of the second table."""

    def candidates(self, a: DataFrame, b: DataFrame) -> DataFrame:
        """Join of ``a`` (columns a0, a1, …, _pa) and ``b`` (b0, b1, …, _pb) to pairs (_pa, _pb, _score)."""
        raise NotImplementedError

    def keyed(self, table: DataFrame, identity: str, values, name: str) -> DataFrame:
        """Rows as (id, position as one struct)."""
        columns = [quoted(v) if isinstance(v, str) else v for v in values]
        place = F.struct(*[c.cast("double").alias(f"{name}{i}") for i, c in enumerate(columns)])
        solid = F.lit(True)
        for c in columns:
            solid = solid & c.isNotNull() & ~F.isnan(c.cast("double"))
        return table.where(solid).select(quoted(identity).alias(f"_id_{name}"), place.alias(f"_p{name}"))

    def _close(self, a: DataFrame, b: DataFrame) -> DataFrame:
        """Distinct positions of both tables that are close: (_pa, _pb, _score)."""
        spread_a = a.select("_pa").distinct().select("_pa", "_pa.*")
        spread_b = b.select("_pb").distinct().select("_pb", "_pb.*")
        return self.candidates(spread_a, spread_b)

    def pairs(self, t1: DataFrame, t2: DataFrame, id1: str, id2: str) -> DataFrame:
        """All close pairs of rows: (_id1, _id2, _score)."""
        a, b = self.keyed(t1, id1, self.values1, "a"), self.keyed(t2, id2, self.values2, "b")
        return self._close(a, b).join(a, "_pa").join(b, "_pb").select(
            F.col("_id_a").alias(ID1), F.col("_id_b").alias(ID2), SCORE
        )

    def axes(self, name: str) -> list[Column] | None:
        """Coordinates in a space where close means a straight distance of at most 1; None if there is none."""
        return None

    def narrowed(self, fraction: float) -> "Matcher":
        """The same with a part of the reach, the scores unchanged; only for those with axes. Fractions are powers of 2."""
        return self

    def within(self, a: list[Column], b: list[Column]) -> Column:
        """The score of two positions, infinite where they are too far apart; only for those with axes."""
        raise NotImplementedError

    def closest(self, a: DataFrame, b: DataFrame) -> DataFrame:
        """The best partner of each position: (_pa, _score, _ib).

        ``a`` has _pa, a0, …; ``b`` has _pb, b0, … and ``_ib``, which decides between equally good ones.
        Cells of ``b`` that hold many positions are searched from coarse to fine, so that none is ever compared with all
        positions near it.
        """
        if self.axes("b") is not None:
            return descend(self, a, b)
        best = self.candidates(a, b).groupBy("_pa").agg(F.min(F.struct(SCORE, "_ib")).alias("_best"))
        return best.select("_pa", f"_best.{SCORE}", "_best._ib")

    def nearest(self, t1: DataFrame, t2: DataFrame, id1: str, id2: str) -> DataFrame:
        """For each row of ``t1`` its best partner in ``t2``, the lowest id among equally good ones.

        Each position of ``t2`` is represented by its lowest id, and the best partner is a minimum
        per position of ``t1``, taken partly before the shuffle.
        """
        a, b = self.keyed(t1, id1, self.values1, "a"), self.keyed(t2, id2, self.values2, "b")
        first = b.groupBy("_pb").agg(F.min("_id_b").alias("_ib")).select("_pb", "_pb.*", "_ib")
        best = self.closest(a.select("_pa").distinct().select("_pa", "_pa.*"), first)
        return a.join(sorted_join(best), "_pa").select(F.col("_id_a").alias(ID1), F.col("_ib").alias(ID2), SCORE)


def sorted_join(side: DataFrame) -> DataFrame:
    """A side of a join whose other side is a whole table: both are shuffled, none is sent to every task.

    Spark judges a table by its compressed file, and a file of some megabytes may hold millions of rows; sent to every task
    and hashed there, they took memory in proportion to the table.
    """
    return side.hint("merge")


def looked_up(rows: DataFrame, table: DataFrame, key: str, identity: str, how: str, *others: str) -> DataFrame:
    """``rows`` joined with the row of ``table`` whose ``identity`` is in column ``key``; a blank key finds none.

    Rows without a key go where the hash of columns ``others`` says. By the key alone all of them met in one task, which no
    outer join needs.
    """
    place = F.when(F.col(key).isNotNull(), F.xxhash64(F.col(key))).otherwise(F.xxhash64(*[quoted(c) for c in others]))
    table = table.withColumn("_dealt2", F.xxhash64(quoted(identity)))
    same = (F.col(key) == quoted(identity)) & (F.col("_dealt1") == F.col("_dealt2"))
    return rows.withColumn("_dealt1", place).join(sorted_join(table), same, how).drop("_dealt1", "_dealt2")


# --- from coarse to fine ---------------------------------------------------------------------------

#: Positions of a cell that are compared one by one; beyond it the cell is quartered along each axis.
LEAF = 64
# Cells of the first level are four times as wide as the search reaches on both sides: few positions see more than one or two.
COARSEST = -1
# Cells are quartered at most this often; below that, distances are beyond the precision of doubles.
FINEST = 23


def _cell_keys(level: int, points: list[Column]) -> list[Column]:
    """The cell of a point; cells are 2 wide (twice the reach) at level 0 and a quarter of it with each level."""
    return [F.floor(u * (4.0**level / 2)).cast("long").alias(f"_k{i}") for i, u in enumerate(points)]


def descend(matcher: Matcher, a: DataFrame, b: DataFrame) -> DataFrame:
    """The best partner of each position of ``a`` among ``b``: (_pa, _score, _ib).

    Positions of ``a`` meet those of ``b`` in the cells within their reach, if a cell holds at most LEAF of them. A fuller cell
    knows how many positions it holds and one of them. The nearest of the known positions is a limit for a position
    of ``a``; cells whose nearest corner is beyond it are dropped, the others are replaced by their parts, with which
    the same is done until no full cell is left. Exact, as only cells that cannot hold the best partner are dropped.

    The pairs are never sorted or moved: a first pass keeps the least score of each cell, which is hashed as the pairs are made,
    a second one looks for the partner in the best cell only.
    """
    n, sides = len(matcher.axes("b")), len(matcher.values1)
    keys, points = [f"_k{i}" for i in range(n)], [f"_u{i}" for i in range(n)]
    values = [f"b{i}" for i in range(sides)]
    # A hair more than the reach, so that rounding loses nothing; the true score decides in the end.
    slack = 1 + 1e-7

    def straight(parts: list[Column]) -> Column:
        return F.sqrt(sum((p * p for p in parts[1:]), parts[0] * parts[0]))

    def reached(rows: DataFrame, level: int) -> DataFrame:
        """Cells within the limit known so far, with their distance and that of the position they know."""
        side = 2.0 / 4.0**level
        rows = rows.select("*", "_pa.*")
        here = matcher.axes("a")
        corner = [F.greatest(F.col(k) * side - w, w - (F.col(k) + 1) * side, F.lit(0.0)) for k, w in zip(keys, here)]
        known = [F.col(f"_known.{u}") - w for u, w in zip(points, here)]
        measured = rows.select("_pa", *keys, "_n", "_limit", straight(corner).alias("_gap"), straight(known).alias("_near"))
        return measured.where(F.col("_gap") <= F.least("_limit", F.lit(1.0)) * slack)

    def pruned(rows: DataFrame, level: int) -> DataFrame:
        """Cells that may hold the best partner; ``_limit`` is the distance to the nearest known position."""
        measured = reached(rows, level).withColumn("_limit", F.least("_limit", F.min("_near").over(Window.partitionBy("_pa"))))
        return measured.where(F.col("_gap") <= F.least("_limit", F.lit(1.0)) * slack).select("_pa", *keys, "_n", "_limit")

    def counted(rows: DataFrame) -> DataFrame:
        return rows.groupBy(*keys).agg(F.count("*").alias("_n"), F.min_by(F.struct(*points), F.struct(*points)).alias("_known"))

    members = b.select("_ib", *values, *[u.alias(p) for u, p in zip(matcher.axes("b"), points)])
    members = members.select("*", *_cell_keys(COARSEST, [F.col(p) for p in points]))
    frontier, side, level = a.select("_pa", *[w.alias(p) for w, p in zip(matcher.axes("a"), points)]), 2 / 4.0**COARSEST, COARSEST
    for k, p in zip(keys, points):
        low, high = [F.floor((F.col(p) + way * slack) / side).cast("long") for way in (-1, 1)]
        frontier = frontier.withColumn(k, F.explode(F.sequence(low, high)))
    frontier = frontier.drop(*points)
    at, own = ["_level", *keys], [*keys, "_ib", *values]

    def numbered(rows: DataFrame) -> DataFrame:
        return rows.withColumn("_level", F.lit(level))

    full = checkpointed(counted(members).where(F.col("_n") > LEAF))
    # Positions of ``a`` with the cells to look into, and positions of ``b`` in these cells, each at one level.
    asked, leaves = numbered(frontier), numbered(members.select(*own))
    if not full.isEmpty():
        leaves = numbered(members.join(full.select(*keys), keys, "left_anti").select(*own))
        members = checkpointed(members.join(full.select(*keys), keys, "left_semi"))
        frontier = checkpointed(pruned(frontier.withColumn("_limit", F.lit(float("inf"))).join(full, keys), level).drop("_n"))
        while not frontier.isEmpty():
            level += 1
            members = members.select(*[c for c in members.columns if c not in keys], *_cell_keys(level, [F.col(p) for p in points]))
            cells = checkpointed(counted(members))
            # Four parts along each axis: their keys are the cell's key and two more bits.
            parts = cells.withColumns({f"_up{i}": F.shiftright(k, 2) for i, k in enumerate(keys)})
            into = [F.col(f"f.{k}") == F.col(f"c._up{i}") for i, k in enumerate(keys)]
            frontier = (
                frontier.alias("f").join(parts.alias("c"), into).select("_pa", "f._limit", *[F.col(f"c.{k}") for k in keys], "c._n", "c._known")
            )
            frontier = checkpointed(pruned(frontier, level))
            more = F.lit(level < FINEST) & (F.col("_n") > LEAF)
            open_ = cells.where(more).select(*keys)
            asked = asked.unionByName(numbered(frontier.where(~more).select("_pa", *keys)))
            leaves = leaves.unionByName(numbered(members.join(open_, keys, "left_anti").select(*own)))
            frontier = frontier.where(more).drop("_n")
            members = checkpointed(members.join(open_, keys, "left_semi"))
    score = matcher.within([F.col(f"_pa.a{i}") for i in range(sides)], [F.col(v) for v in values])
    pairs = asked.join(leaves, at).withColumn(SCORE, score).where(F.col(SCORE) < float("inf"))
    least = pairs.groupBy("_pa", F.struct(*at).alias("_cell")).agg(F.min(SCORE).alias("_least"))
    nearly = 1 + 1e-12
    chosen = least.withColumn("_best", F.min("_least").over(Window.partitionBy("_pa"))).where(F.col("_least") <= F.col("_best") * nearly)
    found = chosen.select("_pa", "_cell.*", "_best").join(leaves, at).withColumn(SCORE, score).where(F.col(SCORE) <= F.col("_best") * nearly)
    return found.groupBy("_pa").agg(F.min(F.struct(SCORE, "_ib")).alias("_found")).select("_pa", f"_found.{SCORE}", "_found._ib")


# --- equality --------------------------------------------------------------------------------------


@dataclass
class Exact(Matcher):
    """Equal keys; blank keys match nothing."""

    values1: tuple
    values2: tuple

    def keyed(self, table, identity, values, name):
        place = F.struct(*[quoted(v).alias(f"{name}{i}") for i, v in enumerate(values)])
        return table.dropna(subset=list(values)).select(quoted(identity).alias(f"_id_{name}"), place.alias(f"_p{name}"))

    def candidates(self, a, b):
        n = len(self.values1)
        return a.join(b, [F.col(f"a{i}") == F.col(f"b{i}") for i in range(n)]).withColumn(SCORE, F.lit(0.0))

    def pairs(self, t1, t2, id1, id2):
        a, b = self.keyed(t1, id1, self.values1, "a"), self.keyed(t2, id2, self.values2, "b")
        same = [F.col(f"_pa.a{i}") == F.col(f"_pb.b{i}") for i in range(len(self.values1))]
        return a.join(b, same).select(F.col("_id_a").alias(ID1), F.col("_id_b").alias(ID2), F.lit(0.0).alias(SCORE))


# --- sky -------------------------------------------------------------------------------------------


class _SkyCells:
    """Zones of equal height in declination, each cut into cells of right ascension.

    A cell is about as wide as high, measured at the zone's border nearer to a pole; zones that
    touch a pole are one cell. Everything is a function of the zone's number, so there is no table
    of zones.
    """

    def __init__(self, height):
        if isinstance(height, Column):
            self.height = F.least(F.greatest(height, F.lit(1e-7)), F.lit(60.0))
        else:
            self.height = min(max(height, 1e-7), 60.0)

    def zone(self, dec: Column) -> Column:
        return F.floor((dec + 90.0) / self.height).cast("long")

    def _far(self, zone: Column, margin) -> Column:
        """The largest declination (absolute) in the zone or within the margin of it."""
        low = zone * self.height - 90.0
        return F.least(F.greatest(F.abs(low), F.abs(low + self.height)) + margin, F.lit(90.0))

    @staticmethod
    def half_width(reach, far: Column) -> Column:
        """How far in right ascension a circle of this reach extends; 180 when it holds a pole."""
        ratio = F.sin(F.radians(reach)) / F.cos(F.radians(far))
        return F.when((far >= 89.999) | (ratio >= 1.0) | (reach >= 60.0), 180.0).otherwise(F.degrees(F.asin(ratio)))

    def cells(self, zone: Column) -> Column:
        """Number of cells of a zone."""
        half = self.half_width(F.lit(self.height / 2), self._far(zone, self.height / 2))
        return F.greatest(F.floor(180.0 / half), F.lit(1)).cast("long")

    @staticmethod
    def cell(ra: Column, cells: Column) -> Column:
        turn = F.pmod(ra, F.lit(360.0)) / 360.0
        return F.least(F.floor(turn * cells).cast("long"), cells - 1)

    def own(self, df: DataFrame, ra: str, dec: str) -> DataFrame:
        """The cell of each row."""
        zone = self.zone(F.col(dec))
        return df.withColumn("_zone", zone).withColumn(
            "_cell", self.cell(F.col(ra), self.cells(F.col("_zone")))
        )

    def reached(self, df: DataFrame, ra: str, dec: str, reach: Column) -> DataFrame:
        """Every cell within ``reach`` degrees of each row."""
        low = F.greatest(F.col(dec) - reach, F.lit(-90.0))
        high = F.least(F.col(dec) + reach, F.lit(90.0))
        in_zones = df.withColumn("_zone", F.explode(F.sequence(self.zone(low), self.zone(high))))
        zone = F.col("_zone")
        wide = self.half_width(reach, self._far(zone, reach))
        measured = in_zones.withColumn("_cells", self.cells(zone)).withColumn("_wide", wide)
        cells, centre = F.col("_cells"), F.pmod(F.col(ra), F.lit(360.0))
        west = F.floor((centre - F.col("_wide")) / 360.0 * cells).cast("long")
        east = F.floor((centre + F.col("_wide")) / 360.0 * cells).cast("long")
        all_round = (F.col("_wide") >= 180.0) | (east - west + 1 >= cells)
        some = F.transform(F.sequence(west, east), lambda k: F.pmod(k, cells))
        chosen = F.when(all_round, F.sequence(F.lit(0).cast("long"), cells - 1)).otherwise(some)
        return measured.withColumn("_cell", F.explode(chosen)).drop("_cells", "_wide")


@dataclass
class Sky(Matcher):
    """Great-circle distance of at most ``radius`` arcseconds; the score is the distance in arcseconds."""

    radius: float
    values1: tuple = ("ra", "dec")
    values2: tuple = ("ra", "dec")

    def axes(self, name):
        # A radius of 0 asks for equal positions; below this one, a point in space is not exact enough.
        if self.radius < 1e-4:
            return None
        # A straight line through the sphere instead of an arc on it, in units of the radius.
        unit = 2 * math.sin(math.radians(min(self.radius * _ARCSEC, 180.0)) / 2)
        return [x / unit for x in unit_vector(f"{name}0", f"{name}1")]

    def narrowed(self, fraction):
        return replace(self, radius=self.radius * fraction)

    def within(self, a, b):
        distance = sky_distance(a[0], a[1], b[0], b[1]) / _ARCSEC
        return F.when(distance <= self.radius, distance).otherwise(float("inf"))

    def scored(self, pairs):
        distance = sky_distance("a0", "a1", "b0", "b1") / _ARCSEC
        return pairs.withColumn(SCORE, distance).where(F.col(SCORE) <= self.radius)

    def candidates(self, a, b):
        reach = self.radius * _ARCSEC
        grid = _SkyCells(2 * reach)
        # A hair more than the radius, so that rounding cannot lose a border case.
        left = grid.reached(a, "a0", "a1", F.lit(reach * (1 + 1e-9) + 1e-12))
        right = grid.own(b, "b0", "b1")
        return self.scored(left.join(right, ["_zone", "_cell"])).drop("_zone", "_cell")


@dataclass
class SkyErrors(Matcher):
    """Distance on the sky of at most the sum of two per-row errors (arcseconds, third value).

    ``scale`` is a typical error; it sets the size of the smallest cells but never the result. The score is
    the distance as a fraction of the allowed one.

    Errors fall into classes by powers of two, and a pair is found in the cells of the larger of its two classes, so
    that one large error widens no other search. A row is copied to the classes above its own that occur at all:
    some ten, and never more than there are powers of two between ``scale`` and the whole sky.
    """

    scale: float
    values1: tuple = ("ra", "dec", "err")
    values2: tuple = ("ra", "dec", "err")

    def candidates(self, a, b):
        scale = max(float(self.scale), 1e-4)
        smallest = min(math.ceil(math.log2(scale)), _WHOLE_SKY)

        def classed(df: DataFrame, error: str) -> DataFrame:
            power = F.least(F.ceil(F.log2(F.greatest(error, F.lit(scale)))), F.lit(_WHOLE_SKY))
            return df.withColumn("_class", F.greatest(power, F.lit(smallest)).cast("int"))

        a, b = classed(a, "a2"), classed(b, "b2")
        levels = sorted(r[0] for r in a.select("_class").union(b.select("_class")).distinct().collect())
        level = F.array(*[F.lit(x) for x in levels]).cast("array<int>")
        higher = F.explode(F.filter(level, lambda x: x > F.col("_class")))
        # A hair more than the cells' own measure, so that rounding cannot lose a border case.
        widest = F.pow(F.lit(2.0), F.col("_level"))
        grid = _SkyCells(2 * widest * _ARCSEC)
        reach = F.least((F.col("a2") + widest) * _ARCSEC * (1 + 1e-9) + 1e-12, F.lit(360.0))

        def met(own_a: bool) -> DataFrame:
            """Pairs of the class of ``a``, those of equal class among them; or of the class of ``b`` where that is larger."""
            this, other = (a, b) if own_a else (b, a)
            this = this.withColumn("_level", F.col("_class"))
            other = other.withColumn("_level", F.col("_class")).unionByName(other.withColumn("_level", higher)) if own_a else other.withColumn("_level", higher)
            left, right = (this, other) if own_a else (other, this)
            left = grid.reached(left.drop("_class"), "a0", "a1", reach)
            right = grid.own(right.drop("_class"), "b0", "b1")
            return left.join(right, ["_level", "_zone", "_cell"])

        distance = sky_distance("a0", "a1", "b0", "b1") / _ARCSEC
        allowed = F.col("a2") + F.col("b2")
        return (
            met(True)
            .unionByName(met(False))
            .withColumn("_distance", distance)
            .where(F.col("_distance") <= allowed)
            .withColumn(SCORE, F.coalesce(F.try_divide(F.col("_distance"), allowed), F.lit(0.0)))
            .drop("_level", "_zone", "_cell", "_distance")
        )


# --- space -----------------------------------------------------------------------------------------


@dataclass
class Cartesian(Matcher):
    """Straight distance of at most ``tolerance`` in any number of dimensions; the score is the distance."""

    tolerance: float
    values1: tuple
    values2: tuple

    def scales(self) -> list[float]:
        return [float(self.tolerance)] * len(self.values1)

    def axes(self, name):
        if not all(self.scales()):
            return None
        return [F.col(f"{name}{i}") / s for i, s in enumerate(self.scales())]

    def narrowed(self, fraction):
        return replace(self, tolerance=self.tolerance * fraction)

    @staticmethod
    def _square(a: Column, b: Column, scale: float) -> Column:
        """The squared distance along an axis in units of its tolerance; a tolerance of 0 asks for equal values."""
        return ((a - b) / scale) ** 2 if scale else F.when(a == b, 0.0).otherwise(float("inf"))

    def _relative(self, a, b) -> Column:
        squares = [self._square(x, y, s) for x, y, s in zip(a, b, self.scales())]
        return F.sqrt(sum(squares[1:], squares[0]))

    def within(self, a, b):
        relative = self._relative(a, b)
        return F.when(relative <= 1.0, relative * self.unit()).otherwise(float("inf"))

    def scored(self, pairs):
        a, b = [[F.col(f"{side}{i}") for i in range(len(self.scales()))] for side in "ab"]
        relative = pairs.withColumn("_relative", self._relative(a, b)).where(F.col("_relative") <= 1.0)
        return relative.withColumn(SCORE, F.col("_relative") * self.unit()).drop("_relative")

    def candidates(self, a, b):
        scales = self.scales()
        left, right = a, b
        for i, scale in enumerate(scales):
            if not scale:
                left, right = left.withColumn(f"_cell{i}", F.col(f"a{i}")), right.withColumn(f"_cell{i}", F.col(f"b{i}"))
                continue
            reach = scale * (1 + 1e-9)
            low = F.floor((F.col(f"a{i}") - reach) / (2 * scale)).cast("long")
            high = F.floor((F.col(f"a{i}") + reach) / (2 * scale)).cast("long")
            left = left.withColumn(f"_cell{i}", F.explode(F.sequence(low, high)))
            right = right.withColumn(f"_cell{i}", F.floor(F.col(f"b{i}") / (2 * scale)).cast("long"))
        cells = [f"_cell{i}" for i in range(len(scales))]
        return self.scored(left.join(right, cells)).drop(*cells)

    def unit(self) -> float:
        return float(self.tolerance)


@dataclass
class Anisotropic(Cartesian):
    """Within an ellipsoid: one tolerance per axis; the score is the scaled distance (0 to 1).

    ``part`` is the part of the tolerances that is searched.
    """

    tolerance: tuple
    values1: tuple
    values2: tuple
    part: float = 1.0

    def scales(self) -> list[float]:
        return [float(t) * self.part for t in self.tolerance]

    def narrowed(self, fraction):
        return replace(self, part=self.part * fraction)

    def unit(self) -> float:
        return self.part


# --- which pairs are kept ---------------------------------------------------------------------------


def _swapped(matcher: Matcher) -> Matcher:
    return replace(matcher, values1=matcher.values2, values2=matcher.values1)


#: Close pairs for each position, on average, up to which all are listed at once.
PAIRS = 2
#: Close pairs of positions that hang together, up to which one task pairs them off.
COMPONENT = 1_000_000
#: Close pairs of positions, up to which their parts are looked for at once.
FEW = 10_000
#: Ranks of rows at one position that are looked up together.
RANKS = 1024


def _steps(matcher: Matcher, at_a: DataFrame, at_b: DataFrame) -> list[float]:
    """Growing parts of the reach, the last one 1, the first one so small that cells hold few pairs of positions."""
    steps = [1.0]
    if matcher.axes("a") is None:
        return steps
    sides = [at.select(f"_p{s}.*").select(*[u.alias(f"_u{i}") for i, u in enumerate(matcher.axes(s))]) for at, s in ((at_a, "a"), (at_b, "b"))]
    points = [F.col(c) for c in sides[0].columns]
    for level in range(FINEST):
        keys = [f"_k{i}" for i in range(len(points))]
        one, two = [side.groupBy(*_cell_keys(level, points)).agg(F.count("*").alias(n)) for side, n in zip(sides, ("_na", "_nb"))]
        pairs, places = one.join(two, keys).agg(F.sum(F.col("_na") * F.col("_nb")), F.sum(F.col("_na") + F.col("_nb"))).first()
        if (pairs or 0) <= PAIRS * (places or 0):
            break
        steps.insert(0, steps[0] / 4)
    return steps


def _mutual_best(matcher: Matcher, t1: DataFrame, t2: DataFrame, id1: str, id2: str) -> DataFrame:
    """One-to-one pairs: again and again the positions that are each other's nearest are paired off.

    Rows at the same position are paired in the order of their ids, as many as the scarcer side has. Where positions
    crowd together, the closest pairs are taken first, within growing parts of the reach: what they leave unpaired has no
    partner that near, so that the list of close pairs stays short although all pairs within the reach would be many.
    """
    a, b = matcher.keyed(t1, id1, matcher.values1, "a"), matcher.keyed(t2, id2, matcher.values2, "b")
    none = F.lit(0).cast("long")
    at_a = a.groupBy("_pa").agg(F.count("*").alias("_na"), F.min("_id_a").alias("_ia")).withColumn("_from_a", none)
    at_b = b.groupBy("_pb").agg(F.count("*").alias("_nb"), F.min("_id_b").alias("_ib")).withColumn("_from_b", none)
    chosen = None
    for part in _steps(matcher, at_a, at_b):
        close = matcher.narrowed(part).candidates(at_a.select("*", "_pa.*"), at_b.select("*", "_pb.*"))
        single = (F.col("_na") + F.col("_from_a") == 1) & (F.col("_nb") + F.col("_from_b") == 1)
        paired = _paired_off(checkpointed(close.select(*_PAIR, single.alias("_single"))))
        chosen = paired if chosen is None else chosen.unionByName(paired)
        if part < 1:
            at_a, at_b = checkpointed(_unpaired(at_a, paired, "a")), checkpointed(_unpaired(at_b, paired, "b"))
    alone = chosen.where("_single").select(F.col("_ia").alias(ID1), F.col("_ib").alias(ID2), SCORE)
    copies = chosen.where("not _single")
    return alone if copies.isEmpty() else alone.unionByName(_ranks_to_rows(copies, a, b))


_PAIR = ("_pa", "_pb", SCORE, "_ia", "_ib", "_na", "_nb", "_from_a", "_from_b")
_CHOSEN = ("_pa", "_pb", SCORE, "_ia", "_ib", "_from_a", "_from_b", "_n", "_single")


def _paired_off(close: DataFrame) -> DataFrame:
    """The pairs taken of a list of close positions with their numbers of unpaired and paired rows.

    A round takes the pairs that are each other's nearest; rounds go on while each takes away half of the list, so that all
    together cost about two. What is left then falls into parts that share no position; a task
    takes the pairs of a part in their order. Parts of more than COMPONENT pairs go through further rounds, until they
    fall apart.
    """
    none = F.lit(0).cast("long")
    chosen, before = None, close.count()
    while True:
        best_a = close.groupBy("_pa").agg(F.min(F.struct(SCORE, "_ib", "_pb")).alias("_x")).select("_pa", "_x._pb")
        best_b = close.groupBy("_pb").agg(F.min(F.struct(SCORE, "_ia", "_pa")).alias("_x")).select("_pb", "_x._pa")
        both = close.join(best_a, ["_pa", "_pb"]).join(best_b, ["_pa", "_pb"]).withColumn("_n", F.least("_na", "_nb"))
        paired = checkpointed(both.select(*_CHOSEN))
        chosen = paired if chosen is None else chosen.unionByName(paired)
        used_a, used_b = paired.select("_pa", F.col("_n").alias("_used_a")), paired.select("_pb", F.col("_n").alias("_used_b"))
        taken_a, taken_b = F.coalesce("_used_a", none), F.coalesce("_used_b", none)
        left = close.join(used_a, "_pa", "left").join(used_b, "_pb", "left").withColumns(
            {
                "_na": F.col("_na") - taken_a,
                "_nb": F.col("_nb") - taken_b,
                "_from_a": F.col("_from_a") + taken_a,
                "_from_b": F.col("_from_b") + taken_b,
                # Names of positions for the search of parts; two that share a name only make their parts one.
                "_u": F.xxhash64(F.lit("a"), "_pa"),
                "_v": F.xxhash64(F.lit("b"), "_pb"),
            }
        )
        left = checkpointed(left.where("_na > 0 and _nb > 0").drop("_used_a", "_used_b"))
        size, last = left.count(), before
        if not size:
            return chosen
        before = size
        if size > FEW and 2 * size <= last:
            close = left.drop("_u", "_v")
            continue
        parts = connected_components(contracted(left.select("_u", "_v")))
        placed = left.join(parts, F.col("_u") == F.col("node")).drop("_u", "_v", "node")
        sizes = placed.groupBy("component").agg(F.count("*").alias("_size"))
        placed = checkpointed(placed.join(sizes, "component"))
        chosen = chosen.unionByName(checkpointed(_in_order(placed.where(F.col("_size") <= COMPONENT).drop("_size"))))
        close = placed.where(F.col("_size") > COMPONENT).drop("component", "_size")
        before = close.count()
        if not before:
            return chosen


def _in_order(pairs: DataFrame) -> DataFrame:
    """The pairs of each component taken one after another, nearest first, while both positions have rows left."""

    def take(batches):
        part, used_a, used_b = None, {}, {}
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("component", "_ia", "_ib", "_na", "_nb")]
            at, ranks_a, ranks_b, numbers = [], [], [], []
            for k, (component, ia, ib, na, nb) in enumerate(zip(*columns)):
                if component != part:
                    part, used_a, used_b = component, {}, {}
                x, y = used_a.get(ia, 0), used_b.get(ib, 0)
                n = min(na - x, nb - y)
                if n > 0:
                    used_a[ia], used_b[ib] = x + n, y + n
                    at.append(k)
                    ranks_a.append(x)
                    ranks_b.append(y)
                    numbers.append(n)
            rows = batch.take(pa.array(at, pa.int64()))
            new = {
                "_from_a": pa.compute.add(rows.column("_from_a"), pa.array(ranks_a, pa.int64())),
                "_from_b": pa.compute.add(rows.column("_from_b"), pa.array(ranks_b, pa.int64())),
                "_n": pa.array(numbers, pa.int64()),
            }
            yield pa.RecordBatch.from_arrays([new[c] if c in new else rows.column(c) for c in _CHOSEN], names=list(_CHOSEN))

    ordered = pairs.repartition("component").sortWithinPartitions("component", SCORE, "_ia", "_ib")
    schema = ordered.withColumn("_n", F.lit(0).cast("long")).select(*_CHOSEN).schema
    return ordered.mapInArrow(take, schema)


def _unpaired(left: DataFrame, paired: DataFrame, side: str) -> DataFrame:
    place, number, start = f"_p{side}", f"_n{side}", f"_from_{side}"
    taken = F.coalesce("_taken", F.lit(0).cast("long"))
    used = paired.groupBy(place).agg(F.sum("_n").alias("_taken"))
    return (
        left.join(used, place, "left")
        .withColumns({number: F.col(number) - taken, start: F.col(start) + taken})
        .where(f"{number} > 0")
        .drop("_taken")
    )


def _ranks_to_rows(chosen: DataFrame, a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of paired positions: each pairing covers a run of ranks at both positions.

    Runs are looked up by blocks of RANKS ranks, so that the rows of a position spread over tasks.
    """
    low, high = F.col("_from_a"), F.col("_from_a") + F.col("_n")
    block = F.explode(F.sequence(F.floor(low / RANKS), F.floor((high - 1) / RANKS)))
    runs = chosen.select("_pa", "_pb", SCORE, "_from_a", "_from_b", "_n", block.alias("_block"))
    ranked_a = rank_within(a.join(chosen.select("_pa").distinct(), "_pa", "left_semi"), ["_pa"], "_id_a", "_ra")
    ranked_b = rank_within(b.join(chosen.select("_pb").distinct(), "_pb", "left_semi"), ["_pb"], "_id_b", "_rb")
    return (
        runs.join(ranked_a.withColumn("_block", F.floor((F.col("_ra") - 1) / RANKS)), ["_pa", "_block"])
        .where((F.col("_ra") > low) & (F.col("_ra") <= high))
        .withColumn("_rb", F.col("_ra") - low + F.col("_from_b"))
        .join(ranked_b, ["_pb", "_rb"])
        .select(F.col("_id_a").alias(ID1), F.col("_id_b").alias(ID2), SCORE)
    )


def find_pairs(matcher: Matcher, t1: DataFrame, t2: DataFrame, id1: str, id2: str, find: str = "best") -> DataFrame:
    """The chosen pairs (_id1, _id2, _score).

    ``all``: every close pair. ``best1``/``best2``: the best partner of each row of the first/second
    table. ``best``: one-to-one, nearest first.
    """
    if find == "all":
        return matcher.pairs(t1, t2, id1, id2)
    if find == "best1":
        return matcher.nearest(t1, t2, id1, id2)
    if find == "best2":
        back = _swapped(matcher).nearest(t2, t1, id2, id1)
        return back.select(F.col(ID2).alias(ID1), F.col(ID1).alias(ID2), SCORE)
    if find == "best":
        return _mutual_best(matcher, t1, t2, id1, id2)
    raise ValueError(f"find is all, best, best1 or best2, not {find!r}")


_JOINS = ("1and2", "1or2", "all1", "all2", "1not2", "2not1", "1xor2")


def match_tables(
    t1: DataFrame,
    t2: DataFrame,
    id1: str,
    id2: str,
    matcher: Matcher,
    find: str = "best",
    join: str = "1and2",
    fixcols: str = "dups",
    suffixes: tuple[str, str] = ("_1", "_2"),
    scorecol: str | None = "Score",
) -> DataFrame:
    """Two tables side by side where they match, with the rows that ``join`` asks for.

    ``1and2`` matched rows; ``all1``, ``all2``, ``1or2`` also the unmatched of one or both;
    ``1not2``, ``2not1`` only the unmatched of one table, with its own columns; ``1xor2`` the unmatched of both.
    ``id1`` and ``id2`` are unique keys.
    """
    if join not in _JOINS:
        raise ValueError(f"join is one of {', '.join(_JOINS)}, not {join!r}")
    if join in ("1not2", "2not1"):
        # Whether a row has any partner does not depend on which partner is best.
        first = join == "1not2"
        table, other, key = (t1, t2, id1) if first else (t2, t1, id2)
        other_key = id2 if first else id1
        if find == "best":
            pairs = find_pairs(matcher, t1, t2, id1, id2, find).select(F.col(ID1 if first else ID2).alias("_m"))
        else:
            way = matcher if first else _swapped(matcher)
            pairs = way.nearest(table, other, key, other_key).select(F.col(ID1).alias("_m"))
        return table.join(pairs, quoted(key) == F.col("_m"), "left_anti")
    pairs = find_pairs(matcher, t1, t2, id1, id2, find)
    if not scorecol:
        pairs = pairs.drop(SCORE)
    f1, f2 = fix_columns([t1, t2], fixcols, list(suffixes))
    k1, k2 = f1.columns[t1.columns.index(id1)], f2.columns[t2.columns.index(id2)]
    left = f1.withColumn("_has1", F.lit(True))
    right = f2.withColumn("_has2", F.lit(True))
    how1 = "left" if join in ("all1", "1or2", "1xor2") else "inner"
    how2 = "full" if join in ("1or2", "1xor2") else "right" if join == "all2" else "left" if join == "all1" else "inner"
    joined = looked_up(left.join(sorted_join(pairs), quoted(k1) == F.col(ID1), how1), right, ID2, k2, how2, k1)
    if join == "1xor2":
        joined = joined.where("_has1 is null or _has2 is null")
    if scorecol:
        joined = joined.withColumnRenamed(SCORE, scorecol)
    return joined.drop(ID1, ID2, "_has1", "_has2")
