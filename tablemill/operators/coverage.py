"""Sky coverage: sets of HEALPix tiles of several orders (MOC) as tables (order, ipix)."""

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import healpix
from ..functions.blanks import not_blank
from ..session import checkpointed
from .match import ID1, ID2, Sky


def tiles_of(df: DataFrame, order: int, ra: str = "ra", dec: str = "dec") -> DataFrame:
    """The tiles of one order that contain a position of the table."""
    solid = df.where(not_blank(ra) & not_blank(dec))
    return solid.select(F.lit(order).alias("order"), healpix.pixel(ra, dec, order).alias("ipix")).distinct()


def _orders(tiles: DataFrame) -> list[int]:
    """The orders that occur: 30 at most."""
    return [r["order"] for r in tiles.select("order").distinct().orderBy("order").collect()]


def _ancestors(order, ipix, upper: list[int]) -> Column:
    """(order, ipix) of the tiles of the given orders that contain a tile; NULL for finer orders."""
    return F.array(
        *[
            F.when(
                F.lit(o) <= order,
                F.struct(F.lit(o).alias("order"), healpix.parent(ipix, F.greatest(order - o, F.lit(0))).alias("ipix")),
            )
            for o in upper
        ]
    )


def merge_tiles(tiles: DataFrame, coarsest: int = 0) -> DataFrame:
    """The same area with as few tiles as possible.

    Tiles inside a larger tile of the set are dropped. Then each tile adds its area to every tile
    that contains it, and the full ones are those whose area is complete; of these the largest are
    kept. The areas are sums, so the few large tiles that everything lies in are added up before
    the shuffle, and the number of steps does not depend on the number of orders.
    """
    tiles = checkpointed(
        tiles.select(F.col("order").cast("int").alias("order"), F.col("ipix").cast("long").alias("ipix")).distinct()
    )
    orders = _orders(tiles)
    if not orders:
        return tiles
    finest = orders[-1]
    outer = tiles
    if len(orders) > 1:
        above = tiles.where(F.col("order") > orders[0]).select(
            F.struct("order", "ipix").alias("_tile"), F.explode(_ancestors(F.col("order"), "ipix", orders[:-1])).alias("_over")
        )
        above = above.where("_over is not null and _over <> _tile").select("_tile.*", "_over")
        cover = tiles.select(F.col("order").alias("_o"), F.col("ipix").alias("_i"))
        same = (F.col("_over.order") == F.col("_o")) & (F.col("_over.ipix") == F.col("_i"))
        outer = tiles.join(above.join(cover, same, "left_semi").drop("_over"), ["order", "ipix"], "left_anti")

    def area(order: Column) -> Column:
        return F.call_function("shiftleft", F.lit(1).cast("long"), (F.lit(finest) - order) * 2)

    upper = list(range(min(coarsest, orders[0]), finest + 1))
    parts = outer.select(area(F.col("order")).alias("_area"), F.explode(_ancestors(F.col("order"), "ipix", upper)).alias("_tile"))
    full = (
        parts.where("_tile is not null")
        .select("_tile.*", "_area")
        .groupBy("order", "ipix")
        .agg(F.sum("_area").alias("_area"))
        .where(F.col("_area") == area(F.col("order")))
        .select("order", "ipix")
    )
    full = full.where((F.col("order") >= coarsest) | (F.col("order") == orders[0]))
    larger = full.select((F.col("order") + 1).alias("_o"), F.col("ipix").alias("_i"))
    inside = (F.col("order") == F.col("_o")) & (F.shiftright("ipix", 2) == F.col("_i"))
    return full.join(larger, inside, "left_anti")


def coverage(df: DataFrame, order: int, ra: str = "ra", dec: str = "dec", coarsest: int = 0) -> DataFrame:
    """The coverage of a catalogue's positions at ``order``, merged."""
    return merge_tiles(tiles_of(df, order, ra, dec), coarsest)


def union_coverage(*tables: DataFrame) -> DataFrame:
    """The area covered by any of the tables, merged."""
    result = tables[0]
    for t in tables[1:]:
        result = result.unionByName(t)
    return merge_tiles(result)


def parse_ascii(df: DataFrame, column: str) -> DataFrame:
    """Tiles from text such as ``1/1 2 4 2/12-14 21``: order, slash, numbers and ranges.

    All columns of ``df`` are kept. A text may hold many tiles, and each becomes its own row. A range is
    given as the largest tiles that make it up, so its length does not matter.
    """
    blocks = F.regexp_extract_all(F.col(column), F.lit(r"(\d+)/([\d\s,-]*(?!\d*/))"), F.lit(0))
    orders = df.select("*", F.explode(blocks).alias("_block")).select(
        *df.columns,
        F.regexp_extract("_block", r"^(\d+)/", 1).cast("int").alias("order"),
        F.explode(F.regexp_extract_all(F.regexp_replace("_block", r"^\d+/", ""), F.lit(r"\d+(?:-\d+)?"), F.lit(0))).alias("_range"),
    )
    ends = F.split("_range", "-")
    first = ends[0].cast("long")
    last = F.coalesce(F.get(ends, F.lit(1)).cast("long"), first)
    return orders.select(*df.columns, F.explode(_range_tiles(F.col("order"), first, last)).alias("_tile")).select(*df.columns, "_tile.*")


def _range_tiles(order: Column, first: Column, last: Column) -> Column:
    """The largest tiles that make up the tiles ``first`` to ``last`` of an order: at most six of each order."""

    def inner(level: Column) -> tuple[Column, Column]:
        """The tiles ``level`` orders up that lie in the range whole: the first, and the one after the last."""
        bits = level * 2
        shift = lambda v: F.call_function("shiftright", v, bits)
        return shift(first - 1) + 1, shift(last + 1)

    def tiles(level: Column) -> Column:
        (low, end), (low_up, end_up) = inner(level), inner(level + 1)
        # What larger tiles take is in the middle; base tiles have no larger ones.
        takes = (low_up < end_up) & (level < order)
        left_end, right = F.when(takes, low_up * 4).otherwise(end), F.when(takes, end_up * 4).otherwise(end)

        def run(a: Column, b: Column) -> Column:
            return F.when(a < b, F.sequence(a, F.greatest(a, b - 1))).otherwise(F.array().cast("array<bigint>"))

        return F.transform(F.concat(run(low, left_end), run(right, end)), lambda i: F.struct((order - level).alias("order"), i.alias("ipix")))

    return F.flatten(F.transform(F.sequence(F.lit(0), order), tiles))


def sky_proportion(tiles: DataFrame) -> DataFrame:
    """One row: the proportion of the sky that (merged) tiles cover."""
    return tiles.agg(F.coalesce(F.sum(1.0 / (12.0 * F.pow(F.lit(4.0), "order"))), F.lit(0.0)).alias("proportion"))


def tile_count(tiles: DataFrame) -> DataFrame:
    """One row: the number of tiles."""
    return tiles.agg(F.count("*").alias("tiles"))


def in_coverage(df: DataFrame, tiles: DataFrame, ra: str = "ra", dec: str = "dec") -> DataFrame:
    """Rows whose position lies in the coverage.

    The lookup is done for the distinct pixels of the rows at the coverage's finest order, one tile
    per order that occurs, so a crowded pixel is looked up once. Rows are then kept by their pixel.
    """
    tiles = checkpointed(tiles.select("order", "ipix"))
    orders = _orders(tiles)
    if not orders:
        return df.limit(0)
    finest = orders[-1]
    placed = df.withColumn("_pix", healpix.pixel(ra, dec, finest))
    looked_up = (
        placed.select("_pix")
        .distinct()
        .select("_pix", F.explode(_ancestors(F.lit(finest), "_pix", orders)).alias("_over"))
        .select("_pix", F.col("_over.order").alias("order"), F.col("_over.ipix").alias("ipix"))
    )
    held = looked_up.join(tiles, ["order", "ipix"], "left_semi").select("_pix").distinct()
    return placed.join(held, "_pix", "left_semi").drop("_pix")


def near_coverage(
    df: DataFrame, key: str, tiles: DataFrame, distance: float, ra: str = "ra", dec: str = "dec"
) -> DataFrame:
    """Rows in the coverage or within ``distance`` degrees of it.

    A row in the coverage is near, and so is one whose nearest tile centre is within ``distance``. The
    others are near if the border of some tile is; only tiles whose centre is at most a tile's radius beyond
    the distance need measuring, and those are few, as tiles of an order do not overlap. Each order
    is matched on its own, since the radius sets the size of the search cells.
    """
    orders = _orders(tiles)
    if not orders:
        return df.limit(0)
    places = df.select(key, F.col(ra).alias("ra"), F.col(dec).alias("dec"))
    near = in_coverage(places, tiles, "ra", "dec").select(key)
    for order in orders:
        centre = healpix.pixel_centre("ipix", F.lit(order))
        centres = tiles.where(F.col("order") == order).select(F.col("ipix").alias("_ipix"), centre.alias("_at")).select("_ipix", "_at.*")
        centres = checkpointed(centres.distinct())
        if distance > 0:
            near = near.unionByName(Sky(distance * 3600.0).nearest(places, centres, key, "_ipix").select(F.col(ID1).alias(key)))
        near = checkpointed(near.distinct())
        rest = places.join(near, key, "left_anti")
        around = Sky((distance + healpix.pixel_radius_degrees(order)) * 3600.0).pairs(rest, centres, key, "_ipix")
        measured = around.join(rest, around[ID1] == rest[key]).select(
            key, healpix.distance_to_sides("ra", "dec", ID2, F.lit(order)).alias("_distance")
        )
        near = near.unionByName(measured.where(F.col("_distance") <= distance).select(key))
    return df.join(near.distinct(), key, "left_semi")


def add_pixel_sample(
    df: DataFrame,
    ra: str,
    dec: str,
    pixel_map: DataFrame,
    order: int,
    value: str = "value",
    radius: float | None = None,
    key: str | None = None,
    name: str = "sample",
) -> DataFrame:
    """Add the value of a pixel map (``ipix``, ``value``) at each position, NULL where it has none.

    With ``radius`` (degrees) the mean over the pixels whose centre is that near; ``key`` identifies a row.
    """
    if radius is None:
        sampled = pixel_map.select(F.col("ipix").alias("_ipix"), F.col(value).alias(name))
        return df.withColumn("_ipix", healpix.pixel(ra, dec, order)).join(sampled, "_ipix", "left").drop("_ipix")
    centre = healpix.pixel_centre("ipix", F.lit(order))
    centres = pixel_map.select("ipix", F.col(value).alias("_value"), centre.alias("_at")).select("ipix", "_value", "_at.*")
    pairs = Sky(radius * 3600.0, (ra, dec), ("ra", "dec")).pairs(df, centres, key, "ipix")
    means = (
        pairs.join(pixel_map.select(F.col("ipix").alias(ID2), F.col(value).alias("_value")), ID2)
        .groupBy(F.col(ID1).alias(key))
        .agg(F.avg("_value").alias(name))
    )
    return df.join(means, key, "left")
