"""Registered queries over scalar functions, one per family, on whole tables."""



from pyspark.sql import functions as F

from ..functions import arithmetic, arrays, bits, blanks, conversions, fluxes, formats, healpix, sky, text, times
from . import stand_ins as given
from .stand_ins import SKY_A
from .suite_tables import EVENTS, _events

QUERIES = {}


def query(sql=None):
    def add(function):
        QUERIES[function.__name__] = (function, sql)
        return function

    return add


def r(value, places=6):
    return F.round(value, places)


def _lines(spark, folder):
    return given.table(spark, folder, "lineitem")


KEY = "l_orderkey, l_linenumber, l_partkey"
KEYS = ["l_orderkey", "l_linenumber", "l_partkey"]


@query(
    f"""select {KEY}, cast(ceil(p / 7) as bigint) as up, cast(floor(p / 7) as bigint) as down, cast(round_even(l_quantity / 2, 0) as bigint) as nearest,
    abs(l_quantity - 25) as size, p % 360 as rest, round(p % 360 / 360, 9) as phase,
    round(0.25 + ((p - 100) % 360 / 360 - 0.25 + 1) % 1, 6) as offset_phase, cast(l_partkey as bigint) // 7 as whole,
    round(log10(p), 9) as lg, round(ln(p), 9) as ln, round(sqrt(p), 9) as root, round(exp(l_discount), 9) as e, round(pow(l_quantity, 1.5), 6) as power,
    round(sin(p), 9) as s, round(tan(l_tax), 9) as t, round(atan2(l_quantity, l_tax + 1), 9) as angle, round(sqrt(l_quantity * l_quantity + 9), 9) as hypot, round(radians(l_quantity), 9) as rad
    from (select *, l_extendedprice as p from lineitem)"""
)
def arithmetic_functions(spark, folder):
    p = F.col("l_extendedprice")
    return _lines(spark, folder).select(
        *KEYS,
        arithmetic.round_up(p / 7).alias("up"),
        arithmetic.round_down(p / 7).alias("down"),
        arithmetic.round_nearest(F.col("l_quantity") / 2).alias("nearest"),
        arithmetic.absolute(F.col("l_quantity") - 25).alias("size"),
        arithmetic.mod(p, 360.0).alias("rest"),
        r(arithmetic.phase(p, 360.0), 9).alias("phase"),
        r(arithmetic.phase(p, 360.0, 100.0, 0.25)).alias("offset_phase"),
        arithmetic.integer_division("l_partkey", 7).alias("whole"),
        r(arithmetic.log10(p), 9).alias("lg"),
        r(arithmetic.ln(p), 9).alias("ln"),
        r(arithmetic.sqrt(p), 9).alias("root"),
        r(arithmetic.exp("l_discount"), 9).alias("e"),
        r(arithmetic.power("l_quantity", 1.5)).alias("power"),
        r(arithmetic.sin(p), 9).alias("s"),
        r(arithmetic.tan("l_tax"), 9).alias("t"),
        r(arithmetic.atan2("l_quantity", F.col("l_tax") + 1), 9).alias("angle"),
        r(arithmetic.hypot("l_quantity", 3.0), 9).alias("hypot"),
        r(arithmetic.to_radians("l_quantity"), 9).alias("rad"),
    )


@query(
    f"""with t as (select event_id, user_id, value as a, case when user_id % 2 = 0 then 100.0::double end as b, isnan(value) or value is null as x from {EVENTS})
    select event_id, case when x or b is null then null else greatest(a, b) end as max_nan, case when x or b is null then null else least(a, b) end as min_nan,
    case when x then b when b is null then a else greatest(a, b) end as max_real, case when x then b when b is null then a else least(a, b) end as min_real,
    greatest(event_id, user_id) as max_int, least(event_id, user_id) as min_int, x as blank from t"""
)
def extremes_with_blanks(spark, folder):
    events = _events(spark, folder).withColumn("b", F.when(F.col("user_id") % 2 == 0, 100.0))
    return events.select(
        "event_id",
        arithmetic.max_nan("value", "b").alias("max_nan"),
        arithmetic.min_nan("value", "b").alias("min_nan"),
        arithmetic.max_real("value", "b").alias("max_real"),
        arithmetic.min_real("value", "b").alias("min_real"),
        arithmetic.max_int("event_id", "user_id").alias("max_int"),
        arithmetic.min_int("event_id", "user_id").alias("min_int"),
        blanks.is_blank("value").alias("blank"),
    )


@query(
    """select o_orderkey, (o_custkey >> 3) & 1 = 1 as third, bit_count(o_custkey)::integer as ones, format('{:b}', o_custkey) as binary, o_custkey as back,
    o_custkey & 255 as low, o_custkey | 256 as with_bit, xor(o_custkey, 511) as turned, o_custkey << 4 as wider, o_custkey >> 2 as narrower, lower(to_hex(o_custkey)) as hex from orders"""
)
def bit_functions(spark, folder):
    k = F.col("o_custkey")
    return given.table(spark, folder, "orders").select(
        "o_orderkey",
        bits.has_bit(k, 3).alias("third"),
        bits.bit_count(k).alias("ones"),
        bits.to_binary(k).alias("binary"),
        bits.from_binary(bits.to_binary(k)).alias("back"),
        bits.bit_and(k, F.lit(255)).alias("low"),
        bits.bit_or(k, F.lit(256)).alias("with_bit"),
        bits.bit_xor(k, F.lit(511)).alias("turned"),
        bits.shift_left(k, 4).alias("wider"),
        bits.shift_right(k, 2).alias("narrower"),
        conversions.to_hex(k).alias("hex"),
    )


@query(
    f"""select {KEY}, cast(l_orderkey as varchar) as key_text, try_cast(substr(l_returnflag || l_orderkey, 2 - l_orderkey % 2) as bigint) as parsed,
    case when q < 128 then cast(trunc(q) as tinyint) end as byte, cast(trunc(l_extendedprice / 3) as integer) as whole, l_orderkey as from_hex,
    [cast(l_linenumber as integer), -cast(l_partkey as integer)] as ints, [l_quantity, l_discount] as doubles, cast(l_partkey as double) as wide
    from (select *, l_extendedprice / 500 as q from lineitem)"""
)
def conversion_functions(spark, folder):
    """Numbers as text, text as numbers, and what does not fit."""
    sometimes = F.substr(F.concat("l_returnflag", F.col("l_orderkey").cast("string")), (2 - F.col("l_orderkey") % 2).cast("int"))
    return _lines(spark, folder).select(
        *KEYS,
        conversions.to_string("l_orderkey").alias("key_text"),
        conversions.parse_long(sometimes).alias("parsed"),
        conversions.to_byte(F.col("l_extendedprice") / 500).alias("byte"),
        conversions.to_integer(F.col("l_extendedprice") / 3).alias("whole"),
        conversions.from_hex(conversions.to_hex("l_orderkey")).alias("from_hex"),
        conversions.parse_ints(F.concat_ws(", ", "l_linenumber", F.lit("x3y"), -F.col("l_partkey"))).alias("ints"),
        conversions.parse_doubles(F.concat_ws(" ", F.lit("Box"), "l_quantity", "l_discount")).alias("doubles"),
        conversions.to_double("l_partkey").alias("wide"),
    )


@query(
    """select p_partkey, round(pow(10, 23 - (m + 48.6) / 2.5), 12) as jansky, round(m, 6) as magnitude, round(p_retailprice / (4 * pi() * d * d), 12) as flux, round(p_retailprice, 6) as luminosity,
    round(m + 0.163, 9) as johnson_b, round(m - 1.39, 9) as vega_h, round(5 * log10(d) - 5, 9) as modulus, round(d, 6) as distance
    from (select *, p_size / 2e0 + 10 as m, p_retailprice / 10 as d from part)"""
)
def flux_functions(spark, folder):
    m, d = F.col("p_size") / 2 + 10, F.col("p_retailprice") / 10
    return given.table(spark, folder, "part").select(
        "p_partkey",
        r(fluxes.ab_to_jansky(m), 12).alias("jansky"),
        r(fluxes.jansky_to_ab(fluxes.ab_to_jansky(m))).alias("magnitude"),
        r(fluxes.luminosity_to_flux("p_retailprice", d), 12).alias("flux"),
        r(fluxes.flux_to_luminosity(fluxes.luminosity_to_flux("p_retailprice", d), d)).alias("luminosity"),
        r(fluxes.johnson_from_ab(m, "B"), 9).alias("johnson_b"),
        r(fluxes.vega_from_ab(m, "H"), 9).alias("vega_h"),
        r(fluxes.distance_to_modulus(d), 9).alias("modulus"),
        r(fluxes.modulus_to_distance(fluxes.distance_to_modulus(d))).alias("distance"),
    )


@query(
    """select c_custkey, regexp_replace(format('{:.2f}', c_acctbal), '^(-?)0[.]', '\\1.') as two, replace(regexp_replace(format('{:.2f}', c_acctbal), '^(-?)0[.]', '\\1.'), '.', ',') as local,
    case when c_acctbal < 0 then '-' else '+' end || format('{:.1f}', abs(c_acctbal)) as signed from customer"""
)
def format_functions(spark, folder):
    return given.table(spark, folder, "customer").select(
        "c_custkey",
        formats.format_decimal("c_acctbal", 2).alias("two"),
        formats.format_decimal_local("c_acctbal", 2).alias("local"),
        formats.format_decimal("c_acctbal", "+0.0;-0.0").alias("signed"),
    )


@query(
    f"""select {KEY}, try_cast(t as tinyint) as byte, try_cast(t as smallint) as short, try_cast(t as integer) as whole, cast(try_cast(t || '.5' as float) as double) as real, try_cast(t || '.25e2' as double) as wide,
    cast(try_cast(t || '000000000000000000001' as decimal(38, 0)) as varchar) as big, cast(try_cast(t || '.125' as decimal(38, 10)) as varchar) as exact,
    try_cast(l_partkey * 40 as smallint) as to_short, cast(trunc(l_extendedprice * 1e6 / 3) as bigint) as to_long, cast(cast(l_extendedprice / 3 as float) as double) as to_float, true as is_long, false as is_text
    from (select *, case when l_orderkey % 5 = 0 then 'n' || l_partkey when l_orderkey % 5 = 1 then '-' || l_partkey else l_partkey::varchar end as t from lineitem)"""
)
def parsed_numbers(spark, folder):
    """Numbers of every kind from text that is a number, a negative one or none."""
    lines = _lines(spark, folder)
    kind = F.col("l_orderkey") % 5
    t = F.concat(F.when(kind == 0, "n").when(kind == 1, "-").otherwise(""), F.col("l_partkey").cast("string"))
    return lines.select(
        *KEYS,
        conversions.parse_byte(t).alias("byte"),
        conversions.parse_short(t).alias("short"),
        conversions.parse_int(t).alias("whole"),
        conversions.parse_float(F.concat(t, F.lit(".5"))).cast("double").alias("real"),
        conversions.parse_double(F.concat(t, F.lit(".25e2"))).alias("wide"),
        conversions.parse_big_integer(F.concat(t, F.lit("000000000000000000001"))).cast("string").alias("big"),
        conversions.parse_big_decimal(F.concat(t, F.lit(".125"))).cast("string").alias("exact"),
        conversions.to_short(F.col("l_partkey") * 40).alias("to_short"),
        conversions.to_long(F.col("l_extendedprice") * 1e6 / 3).alias("to_long"),
        conversions.to_float(F.col("l_extendedprice") / 3).cast("double").alias("to_float"),
        conversions.has_type(lines, "l_orderkey", "bigint").alias("is_long"),
        conversions.has_type(lines, "l_orderkey", "string").alias("is_text"),
    )


@query(
    """select o_orderkey, (k - 500) % 7 as rest, case when k % 3 <> 0 then round(p / (k % 3), 6) end as shared, case when k = 0 then 0 else ((18446744073709551616::hugeint - k) // 4294967296::hugeint)::bigint end as unsigned,
    (k % 2 = 0) <> (p > 1000) as one_of_two, cast(round(p / 7, 2)::float as double) as short_decimal, round(cos(p), 9) as c, round(degrees(p / 1000), 6) as deg
    from (select o_orderkey, o_custkey as k, o_totalprice as p from orders)"""
)
def operator_functions(spark, folder):
    k, p = F.col("o_custkey"), F.col("o_totalprice")
    return given.table(spark, folder, "orders").select(
        "o_orderkey",
        arithmetic.remainder(k - 500, 7).alias("rest"),
        r(arithmetic.divide(p, k % 3)).alias("shared"),
        bits.shift_right_unsigned(-k, 32).alias("unsigned"),
        arithmetic.boolean_xor(k % 2 == 0, p > 1000).alias("one_of_two"),
        arithmetic.round_decimal(p / 7, 2).cast("double").alias("short_decimal"),
        r(arithmetic.cos(p), 9).alias("c"),
        r(arithmetic.to_degrees(p / 1000)).alias("deg"),
    )


@query(
    """select event_id, round(s / 86400 + 40587, 9) as mjd, round(s, 3) as unix_back, round(s / 86400 + 40587, 6) as from_jd from (select event_id, event_id * 977 + 0.25e0 as s from events)"""
)
def unix_time_functions(spark, folder):
    s = F.col("event_id") * 977 + 0.25
    return given.table(spark, folder, "events").select(
        "event_id",
        r(times.unix_to_mjd(s), 9).alias("mjd"),
        r(times.mjd_to_unix(times.unix_to_mjd(s)), 3).alias("unix_back"),
        r(times.jd_to_mjd(times.unix_to_mjd(s) + 2400000.5)).alias("from_jd"),
    )


@query(
    f"""with t as (select ia, ra, dec, radians(ra) as a, radians(dec) as d, radians(83.6) as a0, radians(22.0) as d0 from {SKY_A})
    select ia, round(degrees(2 * asin(sqrt(pow(sin((d - d0) / 2), 2) + cos(d) * cos(d0) * pow(sin((a - a0) / 2), 2)))), 6) as distance,
    round(atan2(cos(d0) * sin(a0 - a), cos(d) * sin(d0) - sin(d) * cos(d0) * cos(a0 - a)), 6) as angle,
    round(sqrt(pow(2 * cos(d) * cos(a) - 3 * cos(d0) * cos(a0), 2) + pow(2 * cos(d) * sin(a) - 3 * cos(d0) * sin(a0), 2) + pow(2 * sin(d) - 3 * sin(d0), 2)), 6) as straight,
    [round(1000 / (ia + 1e0) * cos(d) * cos(a), 6) + 0.0, round(1000 / (ia + 1e0) * cos(d) * sin(a), 6) + 0.0, round(1000 / (ia + 1e0) * sin(d), 6) + 0.0] as xyz from t"""
)
def sky_functions(spark, folder):
    lon0, lat0 = F.lit(83.6), F.lit(22.0)
    rad = [F.radians("ra"), F.radians("dec"), F.radians(lon0), F.radians(lat0)]
    return given.sky_a(spark, folder).select(
        "ia",
        r(sky.sky_distance("ra", "dec", lon0, lat0)).alias("distance"),
        r(sky.position_angle_radians(*rad)).alias("angle"),
        r(sky.polar_distance("ra", "dec", 2.0, lon0, lat0, 3.0)).alias("straight"),
        F.transform(sky.position_xyz("ra", "dec", F.col("ia") + 1.0), lambda v: F.round(v, 6) + 0.0).alias("xyz"),
    )


def _turned(rotation) -> str:
    """[longitude, latitude] in degrees of the unit vector (x, y, z) turned by a rotation, in SQL."""
    a, b, c = [" + ".join(f"({v!r}::double) * {n}" for v, n in zip(row, "xyz")) for row in rotation]
    return f"[round((degrees(atan2({b}, {a})) + 360) % 360, 6), round(degrees(atan2({c}, sqrt(pow({a}, 2) + pow({b}, 2)))), 6) + 0.0]"


@query(
    f"""select ia, {_turned(sky.ICRS_TO_GALACTIC)} as galactic, {_turned(zip(*sky.ICRS_TO_GALACTIC))} as from_galactic,
    [round((degrees(atan2(cos(e) * y - sin(e) * z, x)) + 360) % 360, 6), round(degrees(asin(sin(e) * y + cos(e) * z)), 6) + 0.0] as from_ecliptic,
    round(2 * asin(sqrt((pow(x - 1, 2) + y * y + z * z) / 4)), 9) as from_origin
    from (select ia, radians({sky.OBLIQUITY_ARCSEC}e0 / 3600) as e, cos(radians(dec)) * cos(radians(ra)) as x, cos(radians(dec)) * sin(radians(ra)) as y, sin(radians(dec)) as z from {SKY_A})"""
)
def sky_system_functions(spark, folder):
    """Each position read as one of a system and given in another, and its distance from (0, 0) in radians."""
    def each(pair):
        return F.transform(pair, lambda v: F.round(v, 6) + 0.0)

    return given.sky_a(spark, folder).select(
        "ia",
        each(sky.icrs_to_galactic("ra", "dec")).alias("galactic"),
        each(sky.galactic_to_icrs("ra", "dec")).alias("from_galactic"),
        each(sky.ecliptic_to_icrs("ra", "dec")).alias("from_ecliptic"),
        r(sky.sky_distance_radians(F.radians("ra"), F.radians("dec"), F.lit(0.0), F.lit(0.0)), 9).alias("from_origin"),
    )


@query(
    f"""with t as (select ia, ra, dec, round((ra / 15) * 360000)::bigint as h, round(abs(dec) * 36000)::bigint as d from {SKY_A})
    select ia, lpad((h // 360000 % 24)::varchar, 2, '0') || ':' || lpad((h // 6000 % 60)::varchar, 2, '0') || ':' || lpad((h // 100 % 60)::varchar, 2, '0') || '.' || lpad((h % 100)::varchar, 2, '0') as hms,
    case when dec < 0 then '-' else '+' end || lpad((d // 36000)::varchar, 2, '0') || ':' || lpad((d // 600 % 60)::varchar, 2, '0') || ':' || lpad((d // 10 % 60)::varchar, 2, '0') || '.' || d % 10 as dms,
    round(h % 8640000 / 24000, 6) as ra_back, round(case when dec < 0 then -d else d end / 36000, 6) + 0.0 as dec_back from t"""
)
def sexagesimal_functions(spark, folder):
    written = given.sky_a(spark, folder).select(
        "ia", sky.degrees_to_hms("ra", 2).alias("hms"), sky.degrees_to_dms("dec", 1).alias("dms")
    )
    return written.withColumns(
        {"ra_back": r(sky.hms_to_degrees("hms")), "dec_back": r(sky.dms_to_degrees("dms")) + 0.0}
    )


@query(
    """select event_id, round(s / 86400 + 40587, 7) as mjd, strftime(make_timestamp((round(s)::bigint) * 1000000), '%Y-%m-%dT%H:%M:%S') as iso,
    round(round(s) / 86400 + 40587, 9) as parsed, dayofyear(make_timestamp((round(s)::bigint) * 1000000))::integer as day, round(epoch(make_date(2000 + (event_id % 25)::int, 1, 1)::timestamp) / 86400 + 40587, 9) as year
    from (select event_id, epoch_us(ts) / 1e6 as s from events)"""
)
def time_functions(spark, folder):
    events = given.table(spark, folder, "events").select("event_id", times.timestamp_to_mjd("ts").alias("t"))
    return events.select(
        "event_id",
        r("t", 7).alias("mjd"),
        times.format_iso("t").alias("iso"),
        r(times.parse_iso(times.format_iso("t")), 9).alias("parsed"),
        times.day_of_year("t").alias("day"),
        r(times.year_to_mjd(F.lit(2000) + F.col("event_id") % 25), 9).alias("year"),
    )


@query(
    """select p_partkey, p_brand = 'Brand#11' as same, starts_with(p_type, 'S') as starts, ends_with(p_type, 'L') as ends, contains(p_name, 'a') as has,
    regexp_full_match(p_type, '[A-Z ]+') as whole, cast(length(p_name) as integer) as size, substr(p_name, 2, 3) as middle, regexp_replace(p_name, '[aeiou]', '*', 'g') as hidden,
    string_split_regex(p_name, '\\s+') as words, array_to_string(string_split_regex(p_name, '\\s+'), '_') as joined, p_brand || '/' || p_size as label from part"""
)
def string_functions(spark, folder):
    return given.table(spark, folder, "part").select(
        "p_partkey",
        text.equals("p_brand", "Brand#11").alias("same"),
        text.starts_with("p_type", "S").alias("starts"),
        text.ends_with("p_type", "L").alias("ends"),
        text.contains("p_name", "a").alias("has"),
        text.matches("p_type", "[A-Z ]+").alias("whole"),
        text.length("p_name").alias("size"),
        text.substring("p_name", 1, 4).alias("middle"),
        text.replace("p_name", "[aeiou]", "*").alias("hidden"),
        text.split("p_name").alias("words"),
        text.join(text.split("p_name"), "_").alias("joined"),
        text.concatenate("p_brand", F.lit("/"), "p_size").alias("label"),
    )


@query(
    """with t as (select vec_id, list_transform(embedding, lambda x: x::double) as a from embeddings), u as (select *, list_reverse(a) as b, list_avg(a) as m from t)
    select vec_id, round(m, 6) as mean, round(list_sum(a), 6) as total, round(list_stddev_pop(a), 6) as stdev, round(list_var_pop(a), 6) as variance, list_max(a) as high, list_min(a) as low,
    round(list_aggregate(a, 'quantile_cont', 0.5), 9) as median, round(list_aggregate(a, 'quantile_cont', 0.95), 9) as q95, round(list_inner_product(a, b), 9) as product,
    list_transform(a, lambda x: round(x * 2, 9) + 0.0) as doubled, list_transform(list_zip(a, b), lambda x: round(x[1] + x[2], 9) + 0.0) as added,
    list_transform(list_zip(a, b), lambda x: round(x[1] - x[2], 9) + 0.0) as less, list_transform(list_zip(a, b), lambda x: round(x[1] / x[2], 6) + 0.0) as ratio, list_transform(a, lambda x: round(1 / x, 6) + 0.0) as inverse,
    cast(len(a) as integer) as size, [a[1], a[64]] as ends, list_slice(a, 3, 5) as middle, cast(len(list_filter(a, lambda x: x > 0)) as integer) as positive, [7, 7] as sevens,
    [0, 1, 2] as counted, [1, 3, 5] as looped, array_to_string([vec_id, vec_id + 1], ';') as joined, cast(list_position(a, a[4]) - 1 as bigint) as found,
    list_transform(a, lambda x: case when x > 0 then 'up' else 'down' end) as signs, list_transform(a, lambda x, i: round(x * (i - 1), 9) + 0.0) as weighted, a[64] as final from u"""
)
def array_functions(spark, folder):
    vectors = given.table(spark, folder, "embeddings").select(
        "vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("a"), F.reverse(F.transform("embedding", lambda x: x.cast("double"))).alias("b")
    )
    signs = arrays.condition(F.transform("a", lambda x: x > 0), "up", "down")
    weighted = arrays.array_func("a", lambda x, i: x * i)

    def each(array, places=9):
        return F.transform(array, lambda x: F.round(x, places) + 0.0)

    return vectors.select(
        "vec_id",
        r(arrays.mean("a")).alias("mean"),
        r(arrays.total("a")).alias("total"),
        r(arrays.stdev("a")).alias("stdev"),
        r(arrays.variance("a")).alias("variance"),
        arrays.maximum("a").alias("high"),
        arrays.minimum("a").alias("low"),
        r(arrays.median("a"), 9).alias("median"),
        r(arrays.quantile("a", 0.95), 9).alias("q95"),
        r(arrays.dot_product("a", "b"), 9).alias("product"),
        each(arrays.multiply("a", 2)).alias("doubled"),
        each(arrays.add("a", "b")).alias("added"),
        each(arrays.subtract("a", "b")).alias("less"),
        each(arrays.divide("a", "b"), 6).alias("ratio"),
        each(arrays.reciprocal("a"), 6).alias("inverse"),
        arrays.size("a").alias("size"),
        arrays.pick("a", 0, 63).alias("ends"),
        arrays.slice_array("a", 2, 5).alias("middle"),
        arrays.count_true(F.transform("a", lambda x: x > 0)).alias("positive"),
        arrays.constant(2, 7).alias("sevens"),
        arrays.sequence(3).alias("counted"),
        arrays.loop(1, 7, 2).alias("looped"),
        arrays.join(arrays.array("vec_id", F.col("vec_id") + 1).cast("array<string>"), ";").alias("joined"),
        arrays.index_of("a", F.col("a")[3]).alias("found"),
        signs.alias("signs"),
        each(weighted).alias("weighted"),
        arrays.element("a", 63).alias("final"),
    )


@query(
    """select o_orderkey, i + (4::bigint << (2 * k)) as uniq, k as order_back, i as index_back, i >> 4 as grandparent
    from (select o_orderkey, (o_orderkey % 28 + 2)::integer as k, o_custkey as i from orders)"""
)
def moc_numbers(spark, folder):
    orders = given.table(spark, folder, "orders").select(
        "o_orderkey", (F.col("o_orderkey") % 28 + 2).cast("int").alias("k"), F.col("o_custkey").alias("i")
    )
    numbered = orders.withColumn("uniq", healpix.moc_uniq("k", "i"))
    # Pixel numbers are below 12 * 4^k; larger customer keys than that do not name a pixel.
    valid = F.col("i") < 12 * F.pow(F.lit(4.0), "k")
    return numbered.select(
        "o_orderkey",
        "uniq",
        F.when(valid, healpix.uniq_to_order("uniq")).otherwise(F.col("k")).alias("order_back"),
        F.when(valid, healpix.uniq_to_index("uniq")).otherwise(F.col("i")).alias("index_back"),
        healpix.parent("i", F.lit(2)).alias("grandparent"),
    )


def healpix_sql(sky: str, key: str) -> str:
    """The pixel of order 10 of each position."""
    return f"""(with t as (select {key}, sin(radians(dec)) as z, cos(radians(dec)) as c, (ra / 90) % 4 as q from {sky}),
  e as (select *, floor(1024 * (q + 0.5 - z * 0.75))::bigint as jp, floor(1024 * (q + 0.5 + z * 0.75))::bigint as jm,
    least(floor(q)::bigint, 3) as n, 1024 * c / sqrt((1 + abs(z)) / 3) as tmp from t),
  f as (select *, least(floor((q - n) * tmp)::bigint, 1023) as cp, least(floor((1 - (q - n)) * tmp)::bigint, 1023) as cm from e),
  g as (select {key}, case when abs(z) <= 2e0 / 3 then case when jp // 1024 = jm // 1024 then (jp // 1024) % 4 + 4 when jp // 1024 < jm // 1024 then jp // 1024 else jm // 1024 + 8 end
      when z > 0 then n else n + 8 end as face,
    case when abs(z) <= 2e0 / 3 then jm % 1024 when z > 0 then 1023 - cm else cp end as x,
    case when abs(z) <= 2e0 / 3 then 1023 - jp % 1024 when z > 0 then 1023 - cp else cm end as y from f)
  select {key}, face * 1048576 + {" + ".join(f"((x >> {i}) & 1) * {4**i} + ((y >> {i}) & 1) * {2 * 4**i}" for i in range(10))} as ipix from g)"""


HEALPIX = healpix_sql(SKY_A, "ia")


@query(f"select ia, cast(ipix as bigint) as ipix, cast(ipix // 1048576 as bigint) as face from {HEALPIX}")
def healpix_pixels(spark, folder):
    placed = given.sky_a(spark, folder).select("ia", healpix.pixel("ra", "dec", 10).alias("ipix"))
    return placed.withColumn("face", healpix.parent("ipix", F.lit(10)))


@query(f"select ia, cast(ipix as bigint) as ipix, true as same from {HEALPIX}")
def healpix_centres(spark, folder):
    """The centre of each position's pixel lies in that pixel again."""
    placed = given.sky_a(spark, folder).select("ia", healpix.pixel("ra", "dec", 10).alias("ipix"))
    centres = placed.withColumn("at", healpix.pixel_centre("ipix", F.lit(10)))
    same = healpix.pixel("at.ra", "at.dec", 10) == F.col("ipix")
    return centres.select("ia", "ipix", same.alias("same"))
