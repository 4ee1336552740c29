"""Registered queries over matches and sky coverage."""

from pyspark.sql import functions as F

from ..functions.healpix import pixel
from ..operators import coverage, match, multimatch
from . import stand_ins as given
from .stand_ins import SKY_A, SKY_B, sky_sql
from .suite_functions import HEALPIX, healpix_sql

QUERIES = {}

# Radius in arcseconds; the offsets between the two catalogues stay clear of it.
RADIUS = 4.32


def query(sql=None):
    def add(function):
        QUERIES[function.__name__] = (function, sql)
        return function

    return add


DISTANCE = (
    "3600 * degrees(2 * asin(sqrt(least(1.0, pow(sin(radians(b.dec - a.dec) / 2), 2) + cos(radians(a.dec)) * cos(radians(b.dec)) * pow(sin(radians(b.ra - a.ra) / 2), 2)))))"
)
SKY_PAIRS = f"(select a.ia, b.ib, a.ra, a.dec, b.ra as ra_2, b.dec as dec_2, {DISTANCE} as d from {SKY_A} a, {SKY_B} b where {DISTANCE} <= {RADIUS})"
ALL_SKY = f"(select ia, ib, round(d, 6) as \"Score\" from {SKY_PAIRS})"


def _sky(spark, folder, **options):
    a, b = given.sky_a(spark, folder), given.sky_b(spark, folder)
    matched = match.match_tables(a, b, "ia", "ib", match.Sky(RADIUS), **options)
    if "Score" in matched.columns:
        matched = matched.withColumn("Score", F.round("Score", 6))
    return matched


@query(f"select * from {ALL_SKY}")
def sky_match_all(spark, folder):
    return _sky(spark, folder, find="all").select("ia", "ib", "Score")


BEST1 = f"(select ia, ib, round(d, 6) as \"Score\" from (select *, row_number() over (partition by ia order by d, ib) as rn from {SKY_PAIRS}) where rn = 1)"


@query(f"select * from {BEST1}")
def sky_match_best1(spark, folder):
    return _sky(spark, folder, find="best1").select("ia", "ib", "Score")


@query(
    f"select ia, ib, round(d, 6) as \"Score\" from (select *, row_number() over (partition by ib order by d, ia) as rn from {SKY_PAIRS}) where rn = 1"
)
def sky_match_best2(spark, folder):
    return _sky(spark, folder, find="best2").select("ia", "ib", "Score")


# Again and again the pairs that are each other's nearest; a pair is done once it is chosen (2) or loses a row (1).
MUTUAL = f"""with recursive pairs as materialized (select ia, ib, d from {SKY_PAIRS}),
    rounds(ia, ib, d, state, step) as (
      select ia, ib, d, 0, 0 from pairs
      union all
      select ia, ib, d, case when best then 2 when max(best::int) over (partition by ia) + max(best::int) over (partition by ib) > 0 then 1 else 0 end, step + 1
      from (
        select *, row_number() over (partition by ia order by d, ib) = 1 and row_number() over (partition by ib order by d, ia) = 1 as best
        from rounds where state = 0
      )
    )
    select ia, ib, round(d, 6) as "Score" from rounds where state = 2"""


@query(MUTUAL)
def sky_match_best(spark, folder):
    return _sky(spark, folder, find="best").select("ia", "ib", "Score")


@query(
    f'select a.ia, m.ib, m."Score" from {SKY_A} a left join {BEST1} m using (ia)'
)
def sky_match_all1(spark, folder):
    return _sky(spark, folder, find="best1", join="all1").select("ia", "ib", "Score")


@query(f'select m.ia, b.ib, m."Score" from {SKY_B} b left join {BEST1} m using (ib)')
def sky_match_all2(spark, folder):
    return _sky(spark, folder, find="best1", join="all2").select("ia", "ib", "Score")


@query(
    f'select a.ia, m.ib, m."Score" from {SKY_A} a left join {BEST1} m using (ia) union all select null, b.ib, null from {SKY_B} b where b.ib not in (select ib from {BEST1})'
)
def sky_match_1or2(spark, folder):
    return _sky(spark, folder, find="best1", join="1or2").select("ia", "ib", "Score")


@query(f"select ia, round(ra, 9) as ra, round(dec, 9) as dec from {SKY_A} where ia not in (select ia from {SKY_PAIRS})")
def sky_match_1not2(spark, folder):
    return _sky(spark, folder, join="1not2", find="all").select("ia", F.round("ra", 9).alias("ra"), F.round("dec", 9).alias("dec"))


@query(f"select ib from {SKY_B} where ib not in (select ib from {SKY_PAIRS})")
def sky_match_2not1(spark, folder):
    return _sky(spark, folder, join="2not1", find="all").select("ib")


@query(
    f"select ia, null::bigint as ib from {SKY_A} where ia not in (select ia from {BEST1}) union all select null, ib from {SKY_B} where ib not in (select ib from {BEST1})"
)
def sky_match_1xor2(spark, folder):
    return _sky(spark, folder, join="1xor2", find="best1").select("ia", "ib")


@query(
    f"select ia, ib, round(ra, 6) as ra_x, round(dec, 6) as dec_x, round(ra_2, 6) as ra_y, round(dec_2, 6) as dec_y from {SKY_PAIRS}"
)
def match_column_names(spark, folder):
    """Equal names get the tables' suffixes, others stay."""
    both = _sky(spark, folder, find="all", suffixes=("_x", "_y"), scorecol=None)
    return both.select("ia", "ib", *[F.round(c, 6).alias(c) for c in ("ra_x", "dec_x", "ra_y", "dec_y")])


ERRORS_A = f"(select ia, ra, dec, (1 + ia % 3)::double as err from {SKY_A})"
ERRORS_B = f"(select ib, ra, dec, (0.7 + ib % 2)::double as err from {SKY_B})"


@query(
    f"select ia, ib, round({DISTANCE} / (a.err + b.err), 6) as \"Score\" from {ERRORS_A} a, {ERRORS_B} b where {DISTANCE} <= a.err + b.err"
)
def sky_match_with_errors(spark, folder):
    a = given.sky_a(spark, folder).withColumn("err", 1.0 + F.col("ia") % 3)
    b = given.sky_b(spark, folder).withColumn("err", 0.7 + F.col("ib") % 2)
    found = match.match_tables(a, b, "ia", "ib", match.SkyErrors(3.0), find="all")
    return found.select("ia", "ib", F.round("Score", 6).alias("Score"))


@query("select o_orderkey, c_custkey, 0.0::double as \"Score\" from orders join customer on o_custkey = c_custkey")
def exact_match_all(spark, folder):
    orders = given.table(spark, folder, "orders").select("o_orderkey", "o_custkey")
    customers = given.table(spark, folder, "customer").select("c_custkey")
    matcher = match.Exact(("o_custkey",), ("c_custkey",))
    return match.match_tables(orders, customers, "o_orderkey", "c_custkey", matcher, find="all").select("o_orderkey", "c_custkey", "Score")


@query(
    """select a.o_orderkey as done, b.o_orderkey as open, 0.0::double as "Score" from orders a join orders b on a.o_custkey = b.o_custkey
    and a.o_orderpriority = b.o_orderpriority where a.o_orderstatus = 'F' and b.o_orderstatus <> 'F'"""
)
def exact_match_many(spark, folder):
    """Finished and other orders of one customer and priority: several a side."""
    orders = given.table(spark, folder, "orders")
    done = orders.where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("done"), "o_custkey", "o_orderpriority")
    open_ = orders.where("o_orderstatus <> 'F'").select(F.col("o_orderkey").alias("open"), F.col("o_custkey").alias("c"), F.col("o_orderpriority").alias("p"))
    matcher = match.Exact(("o_custkey", "o_orderpriority"), ("c", "p"))
    return match.match_tables(done, open_, "done", "open", matcher, find="all").select("done", "open", "Score")


@query("select c_custkey, min(s_suppkey) as s_suppkey from customer join supplier on c_nationkey = s_nationkey group by c_custkey")
def exact_match_best1(spark, folder):
    customers = given.table(spark, folder, "customer").select("c_custkey", "c_nationkey")
    suppliers = given.table(spark, folder, "supplier").select("s_suppkey", "s_nationkey")
    matcher = match.Exact(("c_nationkey",), ("s_nationkey",))
    return match.match_tables(customers, suppliers, "c_custkey", "s_suppkey", matcher, find="best1").select("c_custkey", "s_suppkey")


@query(
    """with c as (select c_custkey, c_nationkey as k, row_number() over (partition by c_nationkey order by c_custkey) as n from customer),
    s as (select s_suppkey, s_nationkey as k, row_number() over (partition by s_nationkey order by s_suppkey) as n from supplier)
    select c_custkey, s_suppkey from c join s using (k, n)"""
)
def exact_match_best(spark, folder):
    """One-to-one within each key, in the order of the ids."""
    customers = given.table(spark, folder, "customer").select("c_custkey", "c_nationkey")
    suppliers = given.table(spark, folder, "supplier").select("s_suppkey", "s_nationkey")
    matcher = match.Exact(("c_nationkey",), ("s_nationkey",))
    return match.match_tables(customers, suppliers, "c_custkey", "s_suppkey", matcher, find="best").select("c_custkey", "s_suppkey")


@query(
    """with c as (select c_custkey, round(c_acctbal * 100) as c from customer), s as (select s_suppkey, round(s_acctbal * 100) as s from supplier)
    select c_custkey, arg_min(s_suppkey, (abs(c - s), s_suppkey)) as s_suppkey, round(min(abs(c - s)), 6) as "Score" from c join s on abs(c - s) <= 2000.5 group by c_custkey"""
)
def one_dimensional_match(spark, folder):
    """The nearest balance in whole cents, so that equally near ones are so to the last bit; of these the smallest id."""
    customers = given.table(spark, folder, "customer").select("c_custkey", F.round(F.col("c_acctbal") * 100).alias("c"))
    suppliers = given.table(spark, folder, "supplier").select("s_suppkey", F.round(F.col("s_acctbal") * 100).alias("s"))
    matcher = match.Cartesian(2000.5, ("c",), ("s",))
    found = match.match_tables(customers, suppliers, "c_custkey", "s_suppkey", matcher, find="best1")
    return found.select("c_custkey", "s_suppkey", F.round("Score", 6).alias("Score"))


XYZ_A = f"(select ia, cos(radians(dec)) * cos(radians(ra)) * 10 as x, cos(radians(dec)) * sin(radians(ra)) * 10 as y, sin(radians(dec)) * 10 as z from {SKY_A})"


def _points(spark, folder):
    lon, lat = F.radians("ra"), F.radians("dec")
    return given.sky_a(spark, folder).select(
        "ia", (F.cos(lat) * F.cos(lon) * 10).alias("x"), (F.cos(lat) * F.sin(lon) * 10).alias("y"), (F.sin(lat) * 10).alias("z")
    )


@query(
    f"""select ia, arg_min(ib, (round(sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2) + pow(a.z - b.z, 2)), 9), ib)) as ib, round(min(sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2) + pow(a.z - b.z, 2))), 6) as "Score" from {XYZ_A} a,
    (select ia as ib, x, y, z + 0.1 as z from {XYZ_A}) b where sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2) + pow(a.z - b.z, 2)) <= 0.7 group by ia"""
)
def three_dimensional_match(spark, folder):
    a = _points(spark, folder)
    b = a.select(F.col("ia").alias("ib"), "x", "y", (F.col("z") + 0.1).alias("z"))
    found = match.match_tables(a, b, "ia", "ib", match.Cartesian(0.7, ("x", "y", "z"), ("x", "y", "z")), find="best1")
    return found.select("ia", "ib", F.round("Score", 6).alias("Score"))


@query(
    f"""select ia, arg_min(ib, (round(sqrt(pow((a.x - b.x) / 1.1, 2) + pow((a.y - b.y) / 0.6, 2)), 9), ib)) as ib, round(min(sqrt(pow((a.x - b.x) / 1.1, 2) + pow((a.y - b.y) / 0.6, 2))), 6) as "Score" from {XYZ_A} a,
    (select ia as ib, x + 0.05 as x, y from {XYZ_A}) b where pow((a.x - b.x) / 1.1, 2) + pow((a.y - b.y) / 0.6, 2) <= 1 group by ia"""
)
def anisotropic_match(spark, folder):
    a = _points(spark, folder).select("ia", "x", "y")
    b = a.select(F.col("ia").alias("ib"), (F.col("x") + 0.05).alias("x"), "y")
    found = match.match_tables(a, b, "ia", "ib", match.Anisotropic((1.1, 0.6), ("x", "y"), ("x", "y")), find="best1")
    return found.select("ia", "ib", F.round("Score", 6).alias("Score"))


# Both catalogues as one table.
SKY_BOTH = f"(select 2 * ia as i, ra, dec from {SKY_A} union all select 2 * ib + 1, ra, dec from {SKY_B})"
WITHIN = f"select a.i, b.i as j from {SKY_BOTH} a, {SKY_BOTH} b where a.i < b.i and {DISTANCE} <= {RADIUS}"


def _sky_both(spark, folder):
    a = given.sky_a(spark, folder).select((2 * F.col("ia")).alias("i"), "ra", "dec")
    return a.unionByName(given.sky_b(spark, folder).select((2 * F.col("ib") + 1).alias("i"), "ra", "dec"))


@query(WITHIN)
def match_within_pairs(spark, folder):
    found = multimatch.within_pairs(_sky_both(spark, folder), "i", match.Sky(RADIUS), ("ra", "dec"))
    return found.select(F.col(match.ID1).alias("i"), F.col(match.ID2).alias("j"))


@query(
    f"""with recursive pairs as materialized ({WITHIN}), links as (select i, j from pairs union select j, i from pairs),
    reached(i, j) as (select i, i from links union select r.i, l.j from reached r join links l on r.j = l.i),
    named as (select i, min(j) as "group" from reached group by i)
    select i, "group", count(*) over (partition by "group") as size from named"""
)
def match_within_groups(spark, folder):
    return multimatch.within_groups(_sky_both(spark, folder), "i", match.Sky(RADIUS), ("ra", "dec"))


# A third catalogue, displaced in declination.
SKY_C = f"(select ia as ic, ra, dec * 0.99999e0 as dec from {SKY_A})"


def _sky_c(spark, folder):
    return given.sky_a(spark, folder).select(F.col("ia").alias("ic"), "ra", (F.col("dec") * 0.99999).alias("dec"))


def _inputs(spark, folder, joins=("default", "default", "default")):
    place = ("ra", "dec")
    return [
        multimatch.Input(given.sky_a(spark, folder), "ia", place, joins[0]),
        multimatch.Input(given.sky_b(spark, folder), "ib", place, joins[1]),
        multimatch.Input(_sky_c(spark, folder), "ic", place, joins[2]),
    ]


def _best_sql(other, key):
    return (
        f"(select ia, {key} from (select a.ia, b.{key}, row_number() over (partition by a.ia order by {DISTANCE}, b.{key}) as rn "
        f"from {SKY_A} a, {other} b where {DISTANCE} <= {RADIUS}) where rn = 1)"
    )


PAIRS3 = f"(select a.ia, b.ib, c.ic from {SKY_A} a left join {_best_sql(SKY_B, 'ib')} b using (ia) left join {_best_sql(SKY_C, 'ic')} c using (ia))"


@query(f"select * from {PAIRS3} where ib is not null or ic is not null")
def multi_match_pairs(spark, folder):
    return multimatch.match_pairs(_inputs(spark, folder), match.Sky(RADIUS)).select("ia", "ib", "ic")


@query(f"select * from {PAIRS3}")
def multi_match_pairs_always(spark, folder):
    inputs = _inputs(spark, folder, ("always", "default", "default"))
    return multimatch.match_pairs(inputs, match.Sky(RADIUS)).select("ia", "ib", "ic")


@query(f"select * from {PAIRS3} where ib is not null and ic is null")
def multi_match_admission(spark, folder):
    inputs = _inputs(spark, folder, ("default", "match", "nomatch"))
    return multimatch.match_pairs(inputs, match.Sky(RADIUS)).select("ia", "ib", "ic")


LINKS = f"""edges as (select 'a' || ia as u, 'b' || ib as v from (select a.ia, b.ib from {SKY_A} a, {SKY_B} b where {DISTANCE} <= {RADIUS})
  union all select 'a' || ia, 'c' || ic from (select a.ia, b.ic from {SKY_A} a, {SKY_C} b where {DISTANCE} <= {RADIUS})
  union all select 'b' || ib, 'c' || ic from (select a.ib, b.ic from {SKY_B} a, {SKY_C} b where {DISTANCE} <= {RADIUS})),
  both_ways as (select u, v from edges union all select v, u from edges)"""
GROUPS = f"""with recursive {LINKS},
  reached as (select u as node, u as other from both_ways union select r.node, e.v from reached r join both_ways e on e.u = r.other),
  named as (select node, min(other) as component from reached group by node)
  select min(substr(node, 2)::bigint) filter (node[1] = 'a') as ia, min(substr(node, 2)::bigint) filter (node[1] = 'b') as ib,
  min(substr(node, 2)::bigint) filter (node[1] = 'c') as ic from named group by component"""


@query(GROUPS)
def multi_match_groups(spark, folder):
    return multimatch.match_groups(_inputs(spark, folder), match.Sky(RADIUS)).select("ia", "ib", "ic")


@query(
    f"""with recursive {LINKS},
  reached as (select u as node, u as other from both_ways union select r.node, e.v from reached r join both_ways e on e.u = r.other),
  named as (select node, min(other) as component from reached group by node)
  select min(substr(node, 2)::bigint) filter (node[1] = 'a') as ia, min(substr(node, 2)::bigint) filter (node[1] = 'b') as ib,
  min(substr(node, 2)::bigint) filter (node[1] = 'c') as ic from named group by component
  union all select ia, null, null from {SKY_A} where 'a' || ia not in (select u from both_ways)"""
)
def multi_match_groups_always(spark, folder):
    inputs = _inputs(spark, folder, ("always", "default", "default"))
    return multimatch.match_groups(inputs, match.Sky(RADIUS)).select("ia", "ib", "ic")


# --- coverage -------------------------------------------------------------------------------------


@query(
    f"""with recursive t as (select distinct 5 as k, (ipix >> 10)::bigint as i from {HEALPIX}),
    full5 as (select i >> 2 as i from t group by 1 having count(*) = 4), full4 as (select i >> 2 as i from full5 group by 1 having count(*) = 4),
    full3 as (select i >> 2 as i from full4 group by 1 having count(*) = 4), full2 as (select i >> 2 as i from full3 group by 1 having count(*) = 4),
    full1 as (select i >> 2 as i from full2 group by 1 having count(*) = 4)
    select 5 as "order", i as ipix from t where i >> 2 not in (select i from full5) union all select 4, i from full5 where i >> 2 not in (select i from full4)
    union all select 3, i from full4 where i >> 2 not in (select i from full3) union all select 2, i from full3 where i >> 2 not in (select i from full2)
    union all select 1, i from full2 where i >> 2 not in (select i from full1) union all select 0, i from full1"""
)
def catalogue_coverage(spark, folder):
    return coverage.coverage(given.sky_a(spark, folder), 5)


@query(f"select round(count(distinct ipix >> 8) / (12 * 4096.0), 9) as proportion from {HEALPIX}")
def coverage_proportion(spark, folder):
    tiles = coverage.tiles_of(given.sky_a(spark, folder), 6)
    merged = coverage.merge_tiles(tiles)
    return coverage.sky_proportion(merged).select(F.round("proportion", 9).alias("proportion"))


@query(f"select count(distinct ipix >> 8) as tiles from {HEALPIX}")
def coverage_tiles(spark, folder):
    return coverage.tile_count(coverage.tiles_of(given.sky_a(spark, folder), 6))


# Two footprints: the places of all suppliers in coarse tiles, those of all parts in fine ones.
SUPPLIER_PIXELS = healpix_sql(sky_sql("supplier", "s_suppkey", "s"), "s")
PART_PIXELS = healpix_sql(sky_sql("part", "p_partkey", "p"), "p")


@query(
    f"select ia from {HEALPIX} where (ipix >> 12) in (select ipix >> 12 from {SUPPLIER_PIXELS}) or (ipix >> 6) in (select ipix >> 6 from {PART_PIXELS})"
)
def rows_in_coverage(spark, folder):
    """The catalogue's rows inside the union of two coverages of different order."""
    coarse = coverage.tiles_of(given.sky_of(spark, folder, "supplier", "s_suppkey", "s"), 4)
    fine = coverage.tiles_of(given.sky_of(spark, folder, "part", "p_partkey", "p"), 7)
    return coverage.in_coverage(given.sky_a(spark, folder), coverage.union_coverage(coarse, fine)).select("ia")


@query()
def rows_near_coverage(spark, folder):
    tiles = coverage.tiles_of(given.sky_of(spark, folder, "supplier", "s_suppkey", "s"), 6)
    return coverage.near_coverage(given.sky_a(spark, folder), "ia", tiles, 1.5).select("ia")


def _pixel_map(spark, folder):
    """Mean key of the parts in each pixel of order 5."""
    parts = given.sky_of(spark, folder, "part", "p_partkey", "p")
    return parts.groupBy(pixel("ra", "dec", 5).alias("ipix")).agg(F.avg("p").alias("value"))


@query(
    f"""with m as (select (ipix >> 10)::bigint as ipix, avg(p) as value from {PART_PIXELS} group by 1)
    select h.ia, round(m.value, 6) as sample from {HEALPIX} h left join m on m.ipix = (h.ipix >> 10)"""
)
def sampled_pixel_map(spark, folder):
    sampled = coverage.add_pixel_sample(given.sky_a(spark, folder), "ra", "dec", _pixel_map(spark, folder), 5)
    return sampled.select("ia", F.round("sample", 6).alias("sample"))


@query()
def sampled_pixel_map_mean(spark, folder):
    sampled = coverage.add_pixel_sample(
        given.sky_a(spark, folder), "ra", "dec", _pixel_map(spark, folder), 5, radius=2.0, key="ia"
    )
    return sampled.select("ia", F.round("sample", 6).alias("sample"))


@query(
    "with recursive c as (select distinct c_custkey % 3072 as i from customer), q as (select i >> 2 as i from c group by 1 having count(*) = 4) "
    "select 4 as \"order\", i as ipix from c where i >> 2 not in (select i from q) union all select 3, i from q"
)
def parsed_coverage(spark, folder):
    """Coverage texts, one per customer, read and merged."""
    texts = given.table(spark, folder, "customer").select(
        F.concat(F.lit("4/"), (F.col("c_custkey") % 3072).cast("string")).alias("moc")
    )
    return coverage.merge_tiles(coverage.parse_ascii(texts, "moc").select("order", "ipix"), coarsest=3)
