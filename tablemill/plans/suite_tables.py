"""Registered queries over tables: row and column filters, concatenation, statistics, output modes."""

from pyspark.sql import functions as F

from ..functions import blanks
from ..functions.sky import sky_distance, unit_vector
from ..operators import columns, combine, coordinates, modes, rank, rows, stats
from ..session import new_folder
from ..sources import tables
from . import stand_ins as given
from .stand_ins import SKY_A
from .steps import process, step

QUERIES = {}


def query(sql=None):
    def add(function):
        QUERIES[function.__name__] = (function, sql)
        return function

    return add


def rounded(df, *names, places=6):
    return df.withColumns({n: F.round(n, places) for n in names})


# Events with blanks of both kinds: NULL for views, NaN for errors.
def _events(spark, folder):
    value = F.when(F.col("event_type") == "error", float("nan")).when(F.col("event_type") != "view", F.col("value"))
    return given.table(spark, folder, "events").select("event_id", "user_id", "event_type", value.alias("value"))


EVENTS = (
    "(select event_id, user_id, event_type, case event_type when 'error' then 'nan'::double when 'view' then null else value end as value from events)"
)
GOOD_EVENTS = f"(select event_id, user_id, event_type, case when isnan(value) then null else value end as value from {EVENTS})"


# --- rows -----------------------------------------------------------------------------------------


@query(
    """select l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 4) as net from lineitem
    where l_discount > 0.05 and l_returnflag = 'R' order by net desc, l_orderkey, l_linenumber limit 100"""
)
def ordered_filters(spark, folder):
    """A chain of steps, each on the output of the one before."""
    return process(
        given.table(spark, folder, "lineitem"),
        [
            step(rows.select_rows, "l_discount > 0.05 and l_returnflag = 'R'"),
            step(columns.add_column, "net", "round(l_extendedprice * (1 - l_discount), 4)", units="currency"),
            step(columns.keep_columns, "l_orderkey", "l_linenumber", "net"),
            step(rows.sort_head, 100, ["-net", "l_orderkey", "l_linenumber"]),
        ],
    )


@query("select o_orderkey, o_totalprice from orders where o_totalprice > 1000 and o_orderstatus <> 'F'")
def select_rows(spark, folder):
    orders = given.table(spark, folder, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    return rows.select_rows(orders, "o_totalprice > 1000 and o_orderstatus <> 'F'").drop("o_orderstatus")


@query("select * from customer order by c_acctbal, c_custkey limit 25")
def head_rows(spark, folder):
    return rows.head(given.table(spark, folder, "customer"), 25, ["c_acctbal", "c_custkey"])


@query("select * from customer order by c_acctbal desc, c_custkey desc limit 25")
def tail_rows(spark, folder):
    return rows.tail(given.table(spark, folder, "customer"), 25, ["c_acctbal", "c_custkey"])


@query("select * from orders order by o_orderdate, o_orderkey limit 50 offset 100")
def row_range(spark, folder):
    return rows.row_range(given.table(spark, folder, "orders"), 101, "+50", ["o_orderdate", "o_orderkey"])


@query("select l_orderkey, l_linenumber, row_number() over (order by l_shipdate, l_orderkey, l_linenumber) as rn from lineitem")
def row_numbers(spark, folder):
    lines = given.table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate")
    return rank.number_rows(lines, ["l_shipdate", "l_orderkey", "l_linenumber"], "rn").drop("l_shipdate")


@query(
    "select l_orderkey, l_linenumber, row_number() over (partition by l_returnflag order by l_orderkey, l_linenumber) as rn from lineitem"
)
def row_numbers_within_groups(spark, folder):
    lines = given.table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag")
    return rank.rank_within(lines, ["l_returnflag"], ["l_orderkey", "l_linenumber"], "rn").drop("l_returnflag")


@query(
    "select event_id, user_id from (select *, row_number() over (order by event_id) as rn from events) where rn % 10 = 1"
)
def every_tenth_row(spark, folder):
    return rows.every(given.table(spark, folder, "events").select("event_id", "user_id"), 10, "event_id")


@query("select event_id from events where ('0x' || substr(md5(event_id::varchar), 1, 15))::bigint % 10 = 0")
def every_tenth_row_approximately(spark, folder):
    return rows.every(given.table(spark, folder, "events").select("event_id"), 10, "event_id", exact=False)


@query(f"select event_id, row_number() over (order by value desc nulls last, event_id desc) as place from {GOOD_EVENTS}")
def sort_descending(spark, folder):
    """The place of each row in the sorted table; both kinds of blank go last."""
    events = _events(spark, folder)
    return rank.number_sorted(rows.sort(events, ["value", "event_id"], down=True), "place").select("event_id", "place")


@query("select * from part order by p_retailprice, p_partkey limit 10")
def sort_head_ascending(spark, folder):
    return rows.sort_head(given.table(spark, folder, "part"), 10, ["p_retailprice", "p_partkey"])


@query("select * from part order by p_retailprice, p_partkey limit 10")
def sort_head_from_tail(spark, folder):
    """The last rows of a descending sort."""
    part = given.table(spark, folder, "part")
    return rows.sort_head(part, 10, ["p_retailprice", "p_partkey"], down=True, from_tail=True)


@query(
    "select s_suppkey, cast(i as integer) as copy, row_number() over (order by i, s_suppkey) as place from supplier, generate_series(1, 3) as g(i)"
)
def repeat_table(spark, folder):
    suppliers = given.table(spark, folder, "supplier").select("s_suppkey")
    return rank.number_sorted(rows.repeat(suppliers, 3, "s_suppkey"), "place")


@query(
    "select s_suppkey, cast(i as integer) as copy, row_number() over (order by s_suppkey, i) as place from supplier, generate_series(1, 3) as g(i)"
)
def repeat_rows(spark, folder):
    return rank.number_sorted(rows.repeat(given.table(spark, folder, "supplier").select("s_suppkey"), 3, "s_suppkey", by_row=True), "place")


@query(
    """select n as copies, o_custkey, o_orderkey, o_totalprice from (select *, count(*) over (partition by o_custkey) as n,
    row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) as rn from orders) where rn = 1"""
)
def unique_by_key(spark, folder):
    orders = given.table(spark, folder, "orders").select("o_custkey", "o_orderkey", "o_totalprice", "o_orderdate")
    return rows.unique(orders, ["o_orderdate", "o_orderkey"], ["o_custkey"], count="copies").drop("o_orderdate")


@query("select distinct l_returnflag, l_linestatus from lineitem")
def unique_rows(spark, folder):
    lines = given.table(spark, folder, "lineitem").select("l_returnflag", "l_linestatus")
    return rows.unique(lines, ["l_returnflag"])


@query("select c_custkey, row_number() over (order by md5('3:' || c_custkey::varchar), c_custkey) as place from customer")
def shuffled_rows(spark, folder):
    return rank.number_sorted(rows.shuffle(given.table(spark, folder, "customer").select("c_custkey"), "c_custkey", seed=3), "place")


@query("select o_orderkey from orders where o_totalprice > 0")
def assert_rows(spark, folder):
    orders = given.table(spark, folder, "orders").select("o_orderkey", "o_totalprice")
    return rows.assert_all(orders, F.col("o_totalprice") > 0, "price is not positive").select("o_orderkey")


@query(
    f"""select count(*) as rows, count(*) filter (user_id is null) as null_keys,
    (select count(*) from (select user_id from {EVENTS} where user_id is not null group by user_id having count(*) > 1)) as duplicate_keys,
    count(*) filter (isnan(value)) as nan_cells from {EVENTS}"""
)
def check_table(spark, folder):
    return rows.check(_events(spark, folder), ["user_id"])


@query(
    f"""select event_type, user_id % 7 as class, count(*) as rows, count(value) as good, round(sum(value), 4) as total, round(avg(value), 6) as mean,
    min(value) as low, max(value) as high, round(stddev_pop(value), 6) as spread, count(distinct user_id) as users,
    round(median(value), 6) as middle, round(quantile_cont(value, 0.9), 6) as upper
    from {GOOD_EVENTS} group by event_type, user_id % 7"""
)
def group_and_aggregate(spark, folder):
    events = _events(spark, folder).withColumn("class", F.col("user_id") % 7)
    grouped = rows.group(
        events,
        ["event_type", "class"],
        [
            ("count", "value", "good"), ("sum", "value", "total"), ("mean", "value", "mean"), ("min", "value", "low"),
            ("max", "value", "high"), ("stdev", "value", "spread"), ("distinct", "user_id", "users"),
            ("median", "value", "middle"), ("Q.9", "value", "upper"),
        ],
    )
    return rounded(rounded(grouped, "total", places=4), "mean", "spread", "middle", "upper")


@query(
    f"""select ia, round(ra, 6) as ra, round(dec, 6) as dec from {SKY_A} where 2 * degrees(asin(sqrt(least(1.0,
    pow(sin(radians(dec - 20) / 2), 2) + cos(radians(dec)) * cos(radians(20.0)) * pow(sin(radians(ra - 150) / 2), 2))))) <= 30"""
)
def cone_selection(spark, folder):
    return rounded(rows.cone(given.sky_a(spark, folder), 150.0, 20.0, 30.0), "ra", "dec")


# --- columns --------------------------------------------------------------------------------------


@query("select p_partkey, p_retailprice * 2 as double_price, p_name, p_retailprice from part")
def add_column(spark, folder):
    part = given.table(spark, folder, "part").select("p_partkey", "p_name", "p_retailprice")
    return columns.add_column(part, "double_price", F.col("p_retailprice") * 2, after="p_partkey", units="currency")


@query("select c_custkey, round(c_acctbal / 100, 6) as balance_hundreds from customer")
def replace_column(spark, folder):
    customers = given.table(spark, folder, "customer").select("c_custkey", "c_acctbal")
    return columns.replace_column(customers, "c_acctbal", "round(c_acctbal / 100, 6)", name="balance_hundreds")


@query("select l_orderkey, l_linenumber, l_tax, l_returnflag, l_linestatus from lineitem")
def keep_columns(spark, folder):
    lines = given.table(spark, folder, "lineitem")
    return columns.keep_columns(lines, 1, "l_linenumber", "l_tax..l_linestatus")


@query("select l_quantity, l_tax, l_returnflag, l_shipdate from lineitem")
def delete_columns(spark, folder):
    lines = given.table(spark, folder, "lineitem")
    return columns.delete_columns(lines, "l_*key", "l_linenumber", "l_extendedprice..l_discount", "l_linestatus")


@query("select s_suppkey as supplier_id, s_name, s_acctbal from supplier")
def describe_column(spark, folder):
    suppliers = given.table(spark, folder, "supplier").select("s_suppkey", "s_name", "s_acctbal")
    named = columns.column_metadata(suppliers, 1, name="supplier_id", ucd="meta.id;meta.main", desc="key")
    found = columns.resolve(named, "ucd$meta.id")
    return named.select(*found, *[c for c in named.columns if c not in found])


@query(f"select event_id, case when event_type = 'click' then null else event_type end as event_type from {EVENTS}")
def bad_values(spark, folder):
    return columns.bad_value(_events(spark, folder).select("event_id", "event_type"), "click", "event_type")


@query(f"select event_id, coalesce(value, -99) as value from {GOOD_EVENTS}")
def replace_blanks(spark, folder):
    return columns.replace_value(_events(spark, folder).select("event_id", "value"), None, -99.0, "value")


@query("select c_custkey, case when c_mktsegment = 'BUILDING' then 'HOUSES' else c_mktsegment end as c_mktsegment from customer")
def replace_values(spark, folder):
    customers = given.table(spark, folder, "customer").select("c_custkey", "c_mktsegment")
    return columns.replace_value(customers, "BUILDING", "HOUSES", "c_mktsegment")


CONSTANT = ", ".join(
    f"('{c}', (select count(distinct {c}) = 1 and count({c}) = count(*) from t), "
    f"(select case when count(distinct {c}) = 1 and count({c}) = count(*) then min(cast({c} as varchar)) end from t))"
    for c in ("event_id", "kind", "half")
)


@query(
    f"with t as (select event_id, 'event' as kind, case when event_id % 2 = 0 then 1 end as half from events) "
    f"select * from (values {CONSTANT}) as v(\"column\", constant, value)"
)
def constant_columns(spark, folder):
    half = F.when(F.col("event_id") % 2 == 0, 1).alias("half")
    events = given.table(spark, folder, "events").select("event_id", F.lit("event").alias("kind"), half)
    return columns.constant_report(events)


@query("select event_id, user_id from events")
def drop_constant_columns(spark, folder):
    events = given.table(spark, folder, "events").select("event_id", F.lit(7).alias("version"), "user_id")
    kept, parameters = columns.constant_columns(events)
    assert parameters == {"version": 7}
    return kept


@query('select l_orderkey as "_1st_key", l_tax as "tax__", l_discount as "TAX___2", l_quantity as "_" from lineitem')
def fix_column_names(spark, folder):
    lines = given.table(spark, folder, "lineitem").select("l_orderkey", "l_tax", "l_discount", "l_quantity")
    return columns.fix_names(lines.toDF("1st key", "tax %", "TAX__", "-"))


@query("select p_partkey, [cast(p_size as double), p_retailprice] as pair, p_brand from part")
def collapse_columns(spark, folder):
    part = given.table(spark, folder, "part").select(
        "p_partkey", F.col("p_size").cast("double").alias("p_size"), "p_retailprice", "p_brand"
    )
    return columns.collapse_columns(part, "pair", "p_size", 2)


@query("select vec_id, " + ", ".join(f"embedding[{i}] as embedding_{i}" for i in range(1, 65)) + " from embeddings")
def explode_columns(spark, folder):
    return columns.explode_columns(given.table(spark, folder, "embeddings").select("vec_id", "embedding"), "embedding")


@query("select vec_id, " + ", ".join(f"embedding[{i + 1}] as {'ab'[i // 40]}_{i % 40 + 1}" for i in range(64)) + " from embeddings")
def explode_all_columns(spark, folder):
    vectors = given.table(spark, folder, "embeddings").select(
        "vec_id", F.slice("embedding", 1, 40).alias("a"), F.slice("embedding", 41, 24).alias("b")
    )
    return columns.explode_all(vectors, sizes={"a": 40})




@query(
    "select heading, " + ", ".join(f"max(cell) filter (s_name = 's{i}') as s{i}" for i in range(25))
    + " from (select 's' || n_nationkey as s_name, unnest(['n_name', 'n_regionkey']) as heading, unnest([n_name, cast(n_regionkey as varchar)]) as cell from nation) group by heading"
)
def transpose_table(spark, folder):
    nations = given.table(spark, folder, "nation").select(
        F.concat(F.lit("s"), F.col("n_nationkey").cast("string")).alias("s"), "n_name", "n_regionkey"
    )
    return columns.transpose(nations)


GALACTIC = """(select ia, 
  -0.0548755604162154e0 * x - 0.8734370902348850e0 * y - 0.4838350155487132e0 * z as gx,
  0.4941094278755837e0 * x - 0.4448296299600112e0 * y + 0.7469822444972189e0 * z as gy,
  -0.8676661490190047e0 * x - 0.1980763734312015e0 * y + 0.4559837761750669e0 * z as gz
  from (select ia, cos(radians(dec)) * cos(radians(ra)) as x, cos(radians(dec)) * sin(radians(ra)) as y, sin(radians(dec)) as z from {0}))"""


@query(
    "select ia, round((degrees(atan2(gy, gx)) + 360) % 360, 6) as l, round(degrees(atan2(gz, sqrt(gx * gx + gy * gy))), 6) as b from " + GALACTIC.format(SKY_A)
)
def add_galactic_coordinates(spark, folder):
    added = coordinates.add_sky_coordinates(given.sky_a(spark, folder), "icrs", "galactic", "ra", "dec", "l", "b")
    return rounded(added, "l", "b").select("ia", "l", "b")


@query(
    f"select ia, round(cos(radians(dec)) * cos(radians(ra)), 6) + 0.0 as x, round(cos(radians(dec)) * sin(radians(ra)), 6) + 0.0 as y, round(sin(radians(dec)), 6) + 0.0 as z from {SKY_A}"
)
def coordinates_there_and_back(spark, folder):
    """ICRS to each other system in turn and home again; unit vectors, as a pole has no longitude."""
    sky = given.sky_a(spark, folder)
    lon, lat = "ra", "dec"
    systems = ["icrs", "galactic", "supergalactic", "ecliptic", "fk5"]
    for before, after in zip(systems, systems[1:]):
        sky = coordinates.add_sky_coordinates(sky, before, after, lon, lat, f"{after}_lon", f"{after}_lat")
        lon, lat = f"{after}_lon", f"{after}_lat"
    return sky.select("ia", *[(F.round(v, 6) + 0.0).alias(n) for n, v in zip("xyz", unit_vector(lon, lat))])


@query(
    "select ia, round(radians((degrees(atan2(gy, gx)) + 360) % 360), 9) as l, round(atan2(gz, sqrt(gx * gx + gy * gy)), 9) as b, true as read_back from "
    + GALACTIC.format(SKY_A)
)
def sky_coordinate_units(spark, folder):
    """Galactic positions in radians; ICRS again as sexagesimal text, which reads back within its last place."""
    sky = coordinates.add_sky_coordinates(given.sky_a(spark, folder), "icrs", "galactic", "ra", "dec", "l", "b", out_unit="rad")
    sky = coordinates.add_sky_coordinates(sky, "galactic", "icrs", "l", "b", "h", "d", in_unit="rad", out_unit="sex")
    sky = coordinates.add_sky_coordinates(sky, "icrs", "fk5", "h", "d", "ra_back", "dec_back", in_unit="sex")
    off = sky_distance("ra", "dec", "ra_back", "dec_back") * 3600
    return sky.select("ia", F.round("l", 9).alias("l"), F.round("b", 9).alias("b"), (off < 0.1).alias("read_back"))


# --- tables together ------------------------------------------------------------------------------


def _parties(spark, folder):
    customers = given.table(spark, folder, "customer").select("c_custkey", "c_name", "c_nationkey", "c_acctbal")
    suppliers = given.table(spark, folder, "supplier").select("s_suppkey", "s_name", "s_nationkey", "s_acctbal")
    return [customers.toDF("key", "name", "nation", "balance"), suppliers.toDF("key", "name", "nation", "balance")]


PARTIES = """(select c_custkey as key, c_name as name, c_nationkey as nation, c_acctbal as balance, 1 as seq from customer
  union all select s_suppkey, s_name, s_nationkey, s_acctbal, 2 from supplier)"""


@query(f"select key, name, nation, balance, nation % 5 as class from {PARTIES} where balance > 0")
def concatenate_alike(spark, folder):
    return combine.concatenate(
        _parties(spark, folder),
        each=[step(rows.select_rows, "balance > 0")],
        after=[step(columns.add_column, "class", "nation % 5")],
    )


@query(
    f"""select key, name, seq, case seq when 1 then 'cat_customer.csv' else 'cat_supplier.csv' end as location,
    case seq when 1 then 'custom' else 'suppli' end as part from {PARTIES}"""
)
def concatenate_with_provenance(spark, folder):
    """The tables are written as files and read as one; where each row came from is known from its file."""
    place = new_folder(spark, "parties")
    paths = [f"{place}/cat_{kind}.csv" for kind in ("customer", "supplier")]
    for table, path in zip(_parties(spark, folder), paths):
        tables.write_table(table.select("key", "name"), path, "csv")
    read = tables.with_location(tables.read_table(spark, paths, "csv", "key long, name string"), whole_table=True)
    return combine.label_locations(read, sequence="seq", unique="part").withColumn("location", F.regexp_extract("location", "[^/]*$", 0))


@query(
    """select c_custkey as key, c_acctbal as amount, 'customer' as kind from customer union all
    select o_orderkey, o_totalprice, 'order' from orders where o_totalprice > 1000 union all select s_suppkey, s_acctbal, 'supplier' from supplier"""
)
def concatenate_unlike(spark, folder):
    def named(kind, key, amount):
        return lambda t: t.select(F.col(key).alias("key"), F.col(amount).alias("amount"), F.lit(kind).alias("kind"))

    return combine.concatenate_unlike(
        [given.table(spark, folder, t) for t in ("customer", "orders", "supplier")],
        [
            [named("customer", "c_custkey", "c_acctbal")],
            [step(rows.select_rows, "o_totalprice > 1000"), named("order", "o_orderkey", "o_totalprice")],
            [named("supplier", "s_suppkey", "s_acctbal")],
        ],
    )


@query(
    """select a.c_custkey, a.c_name, b.o_orderkey, b.o_totalprice from (select *, row_number() over (order by c_custkey) as rn from customer) a
    join (select *, row_number() over (order by o_totalprice desc, o_orderkey) as rn from orders) b on a.rn = b.rn"""
)
def join_by_position(spark, folder):
    customers = given.table(spark, folder, "customer").select("c_custkey", "c_name")
    orders = given.table(spark, folder, "orders").select("o_orderkey", "o_totalprice")
    return combine.join_rows(
        [customers, orders], ["c_custkey", [F.col("o_totalprice").desc(), F.col("o_orderkey").asc()]]
    )


@query(
    """select o_orderkey, o_custkey, cast(0 as bigint) as part, list(l_partkey order by l_linenumber, l_partkey, l_quantity) as l_partkey, list(l_quantity order by l_linenumber, l_partkey, l_quantity) as l_quantity
    from orders left join lineitem on l_orderkey = o_orderkey group by o_orderkey, o_custkey having count(l_orderkey) > 0
    union all select o_orderkey, o_custkey, 0, null, null from orders where o_orderkey not in (select l_orderkey from lineitem)"""
)
def array_join(spark, folder):
    side = given.table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    orders = given.table(spark, folder, "orders").select("o_orderkey", "o_custkey")
    return combine.array_join(orders, "o_orderkey", side, "l_orderkey", "l_linenumber")


@query(
    """select cast(floor((l_quantity - 1) / 10) as bigint) as bin_l_quantity, cast(floor((l_extendedprice - 0) / 5000) as bigint) as bin_l_extendedprice,
    count(*) as n from lineitem group by 1, 2"""
)
def cube_counts(spark, folder):
    lines = given.table(spark, folder, "lineitem")
    return combine.cube(lines, [("l_quantity", 1.0, 10.0), ("l_extendedprice", 0.0, 5000.0)])


@query(
    f"""select cast(floor(user_id / 10) as bigint) as bin_user_id, round(sum(value), 4) as sum from {GOOD_EVENTS} group by 1"""
)
def cube_sums(spark, folder):
    return rounded(combine.cube(_events(spark, folder), [("user_id", 0.0, 10.0)], weight="value"), "sum", places=4)


# --- statistics and output modes -----------------------------------------------------------------------

STATS_COLUMNS = ["event_id", "user_id", "event_type", "value"]


def _stat_sql(column, numeric=True):
    x = f"(select {column}::double as x, event_id, row_number() over (order by event_id) as rn from {GOOD_EVENTS})" if numeric else None
    if not numeric:
        return (
            f"select '{column}' as \"Name\", (select count({column}) from {GOOD_EVENTS}) as \"NGood\", (select count(*) - count({column}) from {GOOD_EVENTS}) as \"NBad\", "
            + ", ".join(f'null::double as "{i}"' for i in NUMERIC_ITEMS) + ', null::bigint as "MinPos", null::bigint as "MaxPos", '
            f"(select case when count(distinct {column}) <= 100 then count(distinct {column}) end from {GOOD_EVENTS}) as \"Cardinality\""
        )
    return f"""select '{column}' as "Name", count(x) as "NGood", count(*) - count(x) as "NBad", round(avg(x), 6) as "Mean",
      round(stddev_pop(x), 6) as "StDev", round(var_pop(x), 4) as "Variance", round(stddev_samp(x), 6) as "SampStDev", round(var_samp(x), 4) as "SampVariance",
      (select round(avg(pow(x - m, 3)) / pow(avg(pow(x - m, 2)), 1.5), 4) from {x}, (select avg(x) as m from {x})) as "Skew",
      (select round(avg(pow(x - m, 4)) / pow(avg(pow(x - m, 2)), 2) - 3, 4) from {x}, (select avg(x) as m from {x})) as "Kurtosis",
      min(x) as "Minimum", max(x) as "Maximum", round(sum(x), 4) as "Sum", round(quantile_cont(x, 0.5), 6) as "Median",
      round(quantile_cont(x, 0.25), 6) as "Quartile1", round(quantile_cont(x, 0.75), 6) as "Quartile3", round(quantile_cont(x, 0.95), 6) as "Q_95",
      round(mad(x), 6) as "MedAbsDev", round(mad(x) * 1.4826, 5) as "ScMedAbsDev",
      min_by(rn, (x, rn)) filter (x is not null) as "MinPos", min_by(rn, (-x, rn)) filter (x is not null) as "MaxPos",
      case when count(distinct x) <= 100 then count(distinct x) end as "Cardinality" from {x}"""


NUMERIC_ITEMS = [
    "Mean", "StDev", "Variance", "SampStDev", "SampVariance", "Skew", "Kurtosis", "Minimum", "Maximum", "Sum",
    "Median", "Quartile1", "Quartile3", "Q_95", "MedAbsDev", "ScMedAbsDev",
]
STATS = " union all by name ".join(_stat_sql(c, c != "event_type") for c in STATS_COLUMNS)
_PLACES = {"Variance": 4, "SampVariance": 4, "Skew": 4, "Kurtosis": 4, "Sum": 4, "ScMedAbsDev": 5, "Minimum": 12, "Maximum": 12}


@query(STATS)
def column_statistics(spark, folder):
    items = ["Name", "NGood", "NBad", "MinPos", "MaxPos", "Cardinality"] + [i.replace("_", ".") for i in NUMERIC_ITEMS]
    found = stats.statistics(_events(spark, folder), items=items, order_by="event_id")
    return found.withColumns({i: F.round(i, _PLACES.get(i, 6)) for i in NUMERIC_ITEMS})


@query(
    """select 'q' as name, round(quantile_cont(l_extendedprice, 0.1), 6) as q10, round(quantile_cont(l_extendedprice, 0.5), 6) as q50,
    round(quantile_cont(l_quantity, 0.25), 6) as quantity25, round(quantile_cont(l_tax, 0.99), 6) as tax99 from lineitem"""
)
def quantiles_by_counting(spark, folder):
    """Exact quantiles the way they are found on tables too large for the built-in aggregate."""
    lines = given.table(spark, folder, "lineitem")
    wanted = [("q10", "l_extendedprice", 0.1), ("q50", "l_extendedprice", 0.5), ("quantity25", "l_quantity", 0.25), ("tax99", "l_tax", 0.99)]
    found = rank.exact_quantiles(lines, [(blanks.blank_to_null(c), q) for _, c, q in wanted])
    return lines.agg(F.lit("q").alias("name"), *[F.first(F.lit(round(v, 6))).alias(n) for (n, _, _), v in zip(wanted, found)])


APPROXIMATE = {"Median": 0.5, "Quartile1": 0.25, "Quartile3": 0.75, "Q_99": 0.99}


@query(
    " union all ".join(
        f"select '{c}' as \"Name\", count({c}) as \"NGood\", " + ", ".join(f'true as "{i}"' for i in APPROXIMATE) + " from lineitem"
        for c in ("l_extendedprice", "l_quantity")
    )
)
def approximate_statistics(spark, folder):
    """Whether each approximate quantile is at most one row in 10,000 away from its rank."""
    lines = given.table(spark, folder, "lineitem")
    items = ["Name", "NGood", *[i.replace("_", ".") for i in APPROXIMATE]]
    found = stats.statistics(lines, ["l_extendedprice", "l_quantity"], items, approximate=True)
    answers = []
    for row in found.collect():
        x, n = F.col(row["Name"]).cast("double"), F.count(row["Name"])
        # The value takes up the ranks from its first to its last copy.
        near = [
            ((F.count(F.when(x < row[i], 1)) <= (share + 1e-4) * n + 1) & (F.count(F.when(x <= row[i], 1)) >= (share - 1e-4) * n - 1)).alias(i)
            for i, share in APPROXIMATE.items()
        ]
        answers.append(lines.agg(F.lit(row["Name"]).alias("Name"), F.lit(int(row["NGood"])).cast("long").alias("NGood"), *near))
    return answers[0].unionByName(answers[1])


@query(
    """select 'embedding' as "Name", list(n order by i) as "ArrayNGood", list(round(s, 4) order by i) as "ArraySum", list(round(m, 6) order by i) as "ArrayMean", list(round(d, 6) order by i) as "ArrayStDev"
    from (select i, count(x) as n, sum(x) as s, avg(x) as m, stddev_pop(x) as d from (select unnest(generate_series(1, 64)) as i, unnest(embedding)::double as x from embeddings) group by i)"""
)
def array_statistics(spark, folder):
    found = stats.array_statistics(given.table(spark, folder, "embeddings"), "embedding")
    return found.withColumns(
        {
            "ArraySum": F.transform("ArraySum", lambda x: F.round(x, 4)),
            "ArrayMean": F.transform("ArrayMean", lambda x: F.round(x, 6)),
            "ArrayStDev": F.transform("ArrayStDev", lambda x: F.round(x, 6)),
        }
    )


@query(
    "select o_orderkey, o_totalprice from orders where abs(o_totalprice - (select avg(o_totalprice) from orders)) > 1.5 * (select stddev_pop(o_totalprice) from orders)"
)
def sigma_clip(spark, folder):
    orders = given.table(spark, folder, "orders").select("o_orderkey", "o_totalprice")
    measured = stats.with_column_statistics(orders, "o_totalprice", mean="_mean", stdev="_stdev")
    return rows.select_rows(measured, F.abs(F.col("o_totalprice") - F.col("_mean")) > 1.5 * F.col("_stdev")).drop("_mean", "_stdev")


@query("select cast(11 as bigint) as columns, count(*) as rows from lineitem")
def count_mode(spark, folder):
    return process(given.table(spark, folder, "lineitem"), [], "count")


@query(
    "select 'p_size' as \"Name\", round(avg(p_size), 6) as \"Mean\", round(stddev_pop(p_size), 6) as \"StDev\", min(p_size)::double as \"Minimum\", max(p_size)::double as \"Maximum\", count(p_size) as \"NGood\" from part "
    "union all select 'p_retailprice', round(avg(p_retailprice), 6), round(stddev_pop(p_retailprice), 6), min(p_retailprice), max(p_retailprice), count(p_retailprice) from part"
)
def stats_mode(spark, folder):
    part = given.table(spark, folder, "part")
    return rounded(process(part, [step(columns.keep_columns, "p_size", "p_retailprice")], "stats"), "Mean", "StDev")


# Prices as cents, and times without a form of an engine's own.
CHECKED = ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", "cast(round(o_totalprice * 100) as bigint) as cents", "{} as ordered"]


@query(
    """select bit_xor(h) as "xor", sum(h)::varchar as total, count(*) as "rows" from (select ('0x' || substr(md5(concat("""
    + ", ".join(f"'|', coalesce({c}::varchar, chr(0))" for c in ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", "cents", "ordered"])
    + """)), 1, 15))::bigint as h from (select """
    + ", ".join(CHECKED).format("strftime(o_orderdate, '%Y-%m-%d %H:%M:%S')")
    + """ from orders))"""
)
def checksum_mode(spark, folder):
    orders = given.table(spark, folder, "orders")
    found = modes.checksum(orders.selectExpr(*[c.format("date_format(o_orderdate, 'yyyy-MM-dd HH:mm:ss')") for c in CHECKED]))
    return found.withColumn("total", F.col("total").cast("string"))


@query("select o_orderkey, o_orderstatus from orders where o_totalprice > 2000")
def out_mode(spark, folder):
    """Checked with an assertion first (computed and discarded), then written and read back."""
    place = new_folder(spark, "out")
    steps = [step(rows.select_rows, "o_totalprice > 2000"), step(columns.keep_columns, "o_orderkey", "o_orderstatus")]
    orders = given.table(spark, folder, "orders")
    process(orders, [*steps, step(rows.assert_all, F.col("o_orderkey") >= 0)], "discard")
    process(orders, steps, "out", path=place, ofmt="orc")
    return tables.read_table(spark, place, "orc", "o_orderkey LONG, o_orderstatus STRING")
