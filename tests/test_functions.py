"""Worked values of the scalar functions."""

import math

import pytest
from pyspark.sql import functions as F

from tablemill.functions import arithmetic, arrays, bits, blanks, conversions, fluxes, formats, healpix, sky, text, times

L = F.lit


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def cases():
    return [
        (arithmetic.mod(L(14), L(5)), 4),
        (arithmetic.mod(L(-14), L(5)), 1),
        (arithmetic.mod(L(2.75), L(0.5)), 0.25),
        (arithmetic.mod(L(-7), L(-4)), 1),
        (arithmetic.mod(L(7.0), L(0.0)), None),
        (arithmetic.phase(L(7), L(4)), 0.75),
        (arithmetic.phase(L(-1000.5), L(2.5)), 0.8),
        (arithmetic.phase(L(-3300), L(33)), 0.0),
        (arithmetic.phase(L(5003), L(100), L(0)), 0.03),
        (arithmetic.phase(L(5003), L(100), L(2)), 0.01),
        (arithmetic.phase(L(5003), L(100), L(4)), 0.99),
        (arithmetic.phase(L(23), L(10), L(1), L(99)), 99.2),
        (arithmetic.phase(L(8.6125), L(0.2), L(0.0125), L(-0.3)), 0.0),
        (arithmetic.phase(L(8.6125), L(0.2), L(0.1125), L(-0.7)), -0.5),
        (arithmetic.round_decimal(L(math.pi), 2), 3.14),
        (arithmetic.round_nearest(L(2.5)), 2),
        (arithmetic.round_nearest(L(3.5)), 4),
        (arithmetic.round_up(L(-1.5)), -1),
        (arithmetic.round_down(L(-1.5)), -2),
        (arithmetic.max_nan(L(1.0), L(float("nan"))), None),
        (arithmetic.max_real(L(1.0), L(float("nan"))), 1.0),
        (arithmetic.min_real(L(None).cast("double"), L(2.0)), 2.0),
        (arithmetic.max_real(L(None).cast("double"), L(float("nan"))), None),
        (arithmetic.max_int(L(3), L(None).cast("int")), None),
        (arithmetic.integer_division(L(7), L(2)), 3),
        (arithmetic.divide(L(5), L(60)), 5 / 60),
        (arithmetic.remainder(L(-7), L(4)), -3),
        (arithmetic.boolean_xor(L(True), L(False)), True),
        (bits.has_bit(L(64), 6), True),
        (bits.has_bit(L(63), 6), False),
        (bits.bit_count(L(64)), 1),
        (bits.bit_count(L(3)), 2),
        (bits.bit_count(L(-1)), 64),
        (bits.to_binary(L(42)), "101010"),
        (bits.to_binary(bits.bit_xor(L(255), L(7))), "11111000"),
        (bits.from_binary(L("101010")), 42),
        (bits.from_binary(L("abc")), None),
        (bits.from_binary(L("-101")), -5),
        (conversions.from_hex(L("xyz")), None),
        (conversions.from_hex(L("2a\n")), None),
        (conversions.from_hex(L("-ff")), -255),
        (conversions.to_hex(L(42)), "2a"),
        (conversions.from_hex(L("2a")), 42),
        (conversions.parse_ints(L("9 8 -23")), [9, 8, -23]),
        (conversions.parse_ints(L("tiddly-pom")), []),
        (conversions.parse_doubles(L("Polygon ICRS 0.8 2.1 9.0 2.1 6.2 8.6")), [0.8, 2.1, 9.0, 2.1, 6.2, 8.6]),
        (conversions.parse_doubles(L("La la la")), []),
        (conversions.parse_int(L("12x")), None),
        (conversions.parse_int(L("3000000000")), None),
        (conversions.parse_byte(L("200")), None),
        (conversions.parse_short(L("-300")), -300),
        (conversions.parse_long(L("3000000000")), 3000000000),
        (conversions.parse_float(L("0.5")), 0.5),
        (conversions.parse_double(L("1e3")), 1000.0),
        (conversions.parse_big_integer(L("-20000000000000000023")).cast("double"), -2e19),
        (conversions.parse_big_integer(L("1.5")), None),
        (conversions.parse_big_decimal(L("101")) < conversions.parse_big_decimal(L("102")), True),
        (conversions.to_byte(L(128.0)), None),
        (conversions.to_short(L(-1.9)), -1),
        (conversions.to_integer(L(1e12)), None),
        (conversions.to_long(L(float("nan"))), None),
        (conversions.to_float(L(1e300)), None),
        (conversions.to_string(L(True)), "true"),
        (formats.format_decimal(L(math.pi), 0), "3."),
        (formats.format_decimal(L(0.0), 10), ".0000000000"),
        (formats.format_decimal(L(10 * math.e), 3), "27.183"),
        (formats.format_decimal_local(L(math.pi), 0), "3,"),
        (formats.format_decimal_local(L(10 * math.e), 3), "27,183"),
        (formats.format_decimal(L(99.0), "#.000"), "99.000"),
        (formats.format_decimal(L(math.pi), "+0.##;-0.##"), "+3.14"),
        (fluxes.jansky_to_ab(fluxes.ab_to_jansky(L(20.5))), 20.5),
        (fluxes.ab_to_jansky(L(8.9)), 10 ** (23 - 57.5 / 2.5)),
        (fluxes.distance_to_modulus(L(10.0)), 0.0),
        (fluxes.modulus_to_distance(L(5.0)), 100.0),
        (fluxes.johnson_from_ab(L(10.0), "uPrime"), 10.0),
        (sky.hms_to_degrees(L("06:30:00")), 97.5),
        (sky.hms_to_degrees(L(6), L(30), L(0.0)), 97.5),
        (sky.dms_to_degrees(L("-00:30:36")), -0.51),
        (sky.dms_to_degrees(L("12d 30m 36s")), 12.51),
        (sky.dms_to_degrees(L(-1), L(30), L(0)), -1.5),
        (sky.degrees_to_dms(L(-0.51), 1), "-00:30:36.0"),
        (sky.degrees_to_hms(L(359.9999999), 2), "00:00:00.00"),
        (sky.degrees_to_dms(L(59.99999999), 0), "+60:00:00"),
        (sky.sky_distance(L(0.0), L(0.0), L(90.0), L(0.0)), 90.0),
        (sky.sky_distance(L(359.5), L(0.0), L(0.5), L(0.0)), 1.0),
        (sky.sky_distance(L(10.0), L(90.0), L(200.0), L(89.0)), 1.0),
        (sky.position_angle_radians(L(0.0), L(0.0), L(0.1), L(0.0)), math.pi / 2),
        (sky.polar_distance(L(0.0), L(0.0), L(3.0), L(90.0), L(0.0), L(4.0)), 5.0),
        (F.round(sky.icrs_to_galactic(L(192.85948), L(27.12825))[1], 4), 90.0),
        (F.round(sky.galactic_to_icrs(L(0.0), L(0.0))[0], 3), 266.405),
        (F.round(sky.ecliptic_to_icrs(L(90.0), L(0.0))[1], 5), 23.43928),
        (times.unix_to_mjd(L(0)), 40587.0),
        (times.mjd_to_unix(L(40588.0)), 86400.0),
        (times.jd_to_mjd(L(2451545.0)), 51544.5),
        (times.format_iso(L(51544.5)), "2000-01-01T12:00:00"),
        (times.parse_iso(L("2000-01-01T12:00:00")), 51544.5),
        (times.parse_iso(L("2000-01-01")), 51544.0),
        (times.parse_iso(L("yesterday")), None),
        (times.day_of_year(L(51544.0 + 59)), 60),
        (times.year_to_mjd(L(2000.5)), 51544.0 + 183),
        (text.matches(L("abc"), "b"), False),
        (text.matches(L("abc"), "a.c"), True),
        (text.matches(L("abc\n"), "abc"), False),
        (text.substring(L("2000-01-01T12"), 0, 10), "2000-01-01"),
        (text.substring(L("abc"), 1), "bc"),
        (text.strip(L(" \t a b\xa0\x1c\n")), "a b"),
        (text.clean_lines(L(" a \r\n\n\x0b b c ")), "a\nb\nc"),
        (text.file_stem(L("/x/a.b.json")), "a.b"),
        (text.file_stem(L(".json")), ".json"),
        (text.file_stem(L("plain")), "plain"),
        (text.file_safe(L("Error: No file, URL é")), "Error__No_file__URL_é"),
        (arrays.median(F.array(L(3.0), L(1.0), L(float("nan")), L(2.0))), 2.0),
        (arrays.mean(F.array().cast("array<double>")), None),
        (arrays.quantile(F.array(L(1.0), L(2.0), L(3.0), L(4.0)), 0.25), 1.75),
        (arrays.variance(F.array(L(1.0), L(3.0))), 1.0),
        (arrays.sequence(L(0)), []),
        (arrays.loop(5, 0, -2), [5, 3, 1]),
        (arrays.index_of(F.array(L("a"), L("b")), "c"), -1),
        (arrays.element(F.array(L(1)), 3), None),
        (arrays.divide(F.array(L(1.0), L(4.0)), F.array(L(0.0), L(2.0))), [None, 2.0]),
        (arrays.dot_product(F.array(L(1), L(2)), F.array(L(3), L(4))), 11.0),
        (arrays.count_true(F.array(L(True), L(False), L(True))), 2),
        (healpix.moc_uniq(L(0), L(0)), 4),
        (healpix.moc_uniq(L(29), L(12 * 4**29 - 1)), 12 * 4**29 - 1 + 4**30),
        (healpix.uniq_to_order(L(4)), 0),
        (healpix.uniq_to_order(L(12 * 4**29 - 1 + 4**30)), 29),
        (healpix.uniq_to_index(L(4**6 + 77)), 77),
        (blanks.is_blank(L(float("nan"))), True),
        (blanks.is_blank(L(0.0)), False),
    ]


def close(a, b):
    if isinstance(b, list):
        return len(a) == len(b) and all(close(x, y) for x, y in zip(a, b))
    if isinstance(b, float) and a is not None:
        return a == pytest.approx(b, rel=1e-6, abs=1e-9)
    return a == b


def test_worked_values(spark):
    listed = cases()
    row = spark.range(1).select(*[c.alias(f"x{i}") for i, (c, _) in enumerate(listed)]).first()
    wrong = [(str(c)[:100], row[i], expected) for i, (c, expected) in enumerate(listed) if not close(row[i], expected)]
    assert not wrong


def test_parse_doubles_keeps_nan(spark):
    a, b, c, d = value(spark, conversions.parse_doubles(L("1.3, 99e1, NaN, -23")))
    assert (a, b, d) == (1.3, 990.0, -23.0) and math.isnan(c)


def test_random_numbers_stay_below_one(spark):
    from tablemill.sources.generated import uniform

    row = spark.range(2000).select(uniform("id", 3).alias("u")).agg(F.min("u"), F.max("u"), F.avg("u")).first()
    assert 0 <= row[0] < 0.01 and 0.99 < row[1] < 1 and abs(row[2] - 0.5) < 0.03
