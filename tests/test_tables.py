"""Row positions, order statistics, row and column filters, statistics, combination."""

import decimal
import math
import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tablemill.operators import columns, combine, modes, rank, rows, stats
from tablemill.plans.steps import process, step
from tablemill.sources import tables

NAN = float("nan")


def frame(spark, data, schema):
    return spark.createDataFrame(data, schema)


# --- positions ------------------------------------------------------------------------------------


def test_row_numbers_with_a_hot_key(spark):
    """A third of all rows share the first key; the numbers still run through."""
    data = [(7 if i % 3 == 0 else i, i) for i in range(3000)]
    df = frame(spark, data, "k long, i long").repartition(6)
    numbered = {r.i: r.rn for r in rank.number_rows(df, ["k", "i"], "rn").collect()}
    assert numbered == {i: n for n, (_, i) in enumerate(sorted(data), 1)}
    ranked = {r.i: r["_rank"] for r in rank.rank_within(df, ["k"], "i").collect()}
    seen = {}
    for k, i in sorted(data):
        seen[k] = seen.get(k, 0) + 1
        assert ranked[i] == seen[k]


def test_number_by_key(spark):
    df = spark.range(50).withColumn("wide", F.lit("w"))
    assert {r["id"]: r["_rn"] for r in rank.number_by_key(df, "id").collect()} == {i: i + 1 for i in range(50)}


def test_rank_within_keeps_null_keys(spark):
    df = frame(spark, [(None, 2), (None, 1), ("a", 3)], "k string, i int")
    assert {(r.k, r.i, r["_rank"]) for r in rank.rank_within(df, ["k"], "i").collect()} == {(None, 1, 1), (None, 2, 2), ("a", 3, 1)}


VALUES = {
    "hot": [5.0] * 400 + [random.Random(1).gauss(0, 1e-3) for _ in range(800)],
    "wide": [random.Random(2).uniform(-1, 1) * 10 ** random.Random(i).uniform(-300, 300) for i in range(300)],
    "extreme": [1.7e308, -1.7e308, 0.0, math.inf, -math.inf, 1.0, 5e-324],
    "single": [3.0],
}


@pytest.mark.parametrize("name", list(VALUES))
def test_order_statistics(spark, name):
    data = VALUES[name]
    df = frame(spark, [(v,) for v in data] + [(None,)], "v double").repartition(5)
    ranks = sorted({1, 2, len(data) // 3, len(data) // 2, len(data)} & set(range(1, len(data) + 1)))
    found = rank.order_statistics(df, [(F.col("v"), lambda n, r=r: r) for r in ranks] + [(F.col("v"), lambda n: n + 1)])
    assert found == [sorted(data)[r - 1] for r in ranks] + [None]


def test_order_statistics_of_longs(spark):
    data = [2**62 + i % 100 for i in range(500)] + [-(2**62) - i for i in range(500)] + [i for i in range(100)]
    df = frame(spark, [(v,) for v in data], "v long")
    ranks = [1, 400, 500, 550, 700, 1100]
    assert rank.order_statistics(df, [(F.col("v"), lambda n, r=r: r) for r in ranks]) == [sorted(data)[r - 1] for r in ranks]


def test_at_most_six_passes(spark, monkeypatch):
    """Any doubles, 64 bits apart: 300 values over 600 powers of ten, and neighbours of one another."""
    passes, count = [], rank._counts
    monkeypatch.setattr(rank, "_counts", lambda *a: passes.append(1) or count(*a))
    near = [math.pi]
    for _ in range(200):
        near.append(math.nextafter(near[-1], 4))
    for data in (VALUES["wide"], near + VALUES["wide"] + VALUES["extreme"]):
        passes.clear()
        df = frame(spark, [(v,) for v in data], "v double").repartition(5)
        assert rank.order_statistics(df, [(F.col("v"), lambda n, r=r: r) for r in range(1, len(data), 40)]) == [sorted(data)[r - 1] for r in range(1, len(data), 40)]
        assert len(passes) <= 6


def test_order_statistics_of_decimals(spark):
    data = [decimal.Decimal(x) / 10**6 for x in [10**37 + k for k in range(90)] + [-(10**37) - 3 * k for k in range(90)] + list(range(60))]
    df = frame(spark, [(v,) for v in data], "v decimal(38,6)")
    assert rank.order_statistics(df, [(F.col("v"), lambda n, r=r: r) for r in range(1, 241, 17)]) == [sorted(data)[r - 1] for r in range(1, 241, 17)]


def test_grouped_quantiles(spark):
    draw = random.Random(6)
    data = [(draw.choice(["a", "b", None]), draw.choice([draw.gauss(0, 1e-3), draw.uniform(-1, 1) * 10 ** draw.uniform(-300, 300), 7.0]), i) for i in range(400)]
    data += [("hot", 5.0, 1)] * 500 + [("hot", 6.0, 1), ("nothing", None, None), ("nan", float("nan"), 2), ("one", -0.0, 3), ("two", 1.0, 4), ("two", 2.0, 9)]
    df = frame(spark, data, "k string, v double, n int").repartition(6)
    wanted = [("median", "v", "m"), ("Q.1", "v", "low"), ("Q.999", "v", "high"), ("median", "n", "whole"), ("sum", "n", "total")]
    got = {r.k: r for r in rows.group(df, ["k"], wanted).collect()}
    v = F.nanvl("v", F.lit(None))
    built_in = df.groupBy("k").agg(F.percentile(v, 0.5).alias("m"), F.percentile(v, 0.1).alias("low"), F.percentile(v, 0.999).alias("high"), F.percentile("n", 0.5).alias("whole"), F.sum("n").alias("total"), F.count("*").alias("rows"))
    for r in built_in.collect():
        for c in ("m", "low", "high", "whole", "total", "rows"):
            assert got[r.k][c] == (None if r[c] is None else pytest.approx(r[c], rel=1e-12))
    assert len(got) == 8 and got["nothing"].m is None and got["nan"].m is None


def test_quantiles_by_counting_agree_with_the_aggregate(spark):
    df = spark.range(1001).select((F.hash("id") % 1000 / 7.0).alias("x"))
    shares = [0.0, 0.1, 0.5, 0.9, 1.0]
    exact = df.agg(F.percentile("x", shares)).first()[0]
    assert rank.exact_quantiles(df, [(F.col("x"), s) for s in shares]) == pytest.approx(exact)


def test_head_tail_and_range(spark):
    df = spark.range(100).withColumn("v", -F.col("id")).repartition(4)
    ids = lambda d: [r.id for r in d.collect()]
    assert ids(rows.head(df, 20, "v")) == list(range(99, 79, -1))
    assert ids(rows.tail(df, 20, "v")) == list(range(19, -1, -1))
    assert ids(rows.row_range(df, 11, 30, "id")) == list(range(10, 30))
    assert ids(rows.row_range(df, 11, "+3", "id")) == [10, 11, 12]
    assert ids(rows.sort_head(df, 10, "v", down=True)) == list(range(10))
    assert ids(rows.sort_head(df, 10, "v", from_tail=True)) == list(range(9, -1, -1))
    assert ids(rows.head(df, 0, "id")) == [] and len(ids(rows.head(df, 500, "id"))) == 100
    assert ids(rows.head(df.where("id < 0"), 5, "id")) == [] and ids(rows.row_range(df, 99, 130, "id")) == [98, 99]
    assert ids(rows.head(df.withColumn("s", F.lpad(F.col("id").cast("string"), 3, "0")), 3, "s")) == [0, 1, 2]


def test_long_heads_with_ties_and_blanks(spark):
    df = spark.range(200_000).withColumn("x", F.when(F.col("id") % 10 == 0, F.lit(None)).when(F.col("id") % 3 > 0, F.hash("id") % 1000 / 8.0).otherwise(7.0))
    keys = {r.id: r.x for r in df.collect()}
    up = sorted(keys, key=lambda i: (keys[i] is None, keys[i] or 0, i))
    down = sorted(keys, key=lambda i: (keys[i] is None, -(keys[i] or 0), i))
    ids = lambda d: [r.id for r in d.select("id").collect()]
    assert ids(rows.head(df, 150_000, ["x", "id"])) == up[:150_000]
    assert ids(rows.tail(df, 25_000, ["x", "id"])) == up[-25_000:]
    assert ids(rows.row_range(df, 60_001, 60_020, ["x", "id"])) == up[60_000:60_020]
    assert ids(rows.row_range(df, 179_990, 180_010, ["x", "id"])) == up[179_989:180_010]
    assert ids(rows.sort_head(df, 12, ["-x", "id"])) == down[:12]
    blanks = [i for i in up if keys[i] is None]
    assert ids(rows.sort_head(df, 20_003, ["x", "id"], nulls_first=True)) == blanks + up[:3]


def test_row_counts_must_be_numbers(spark):
    with pytest.raises(ValueError):
        rows.head(spark.range(3), "x", "id")
    with pytest.raises(ValueError):
        rows.row_range(spark.range(3), 0, 2, "id")


def test_sort_puts_both_kinds_of_blank_last(spark):
    df = frame(spark, [(1, 2.0), (2, NAN), (3, None), (4, 1.0)], "i int, x double")
    ids = lambda d: [r.i for r in d.collect()]
    assert ids(rows.sort(df, ["x", "i"])) == [4, 1, 2, 3]
    assert ids(rows.sort(df, ["x", "-i"], down=True)) == [1, 4, 2, 3]
    assert ids(rows.sort(df, ["x", "i"], nulls_first=True)) == [2, 3, 4, 1]


def test_every_with_ties_and_blanks(spark):
    values = [None, float("nan"), 3.0, 3.0, 3.0, 3.0, 3.0, 1.0, 2.0, -0.0, 0.0, None]
    df = spark.createDataFrame(list(enumerate(values)), "id long, x double").repartition(3)
    in_order = [0.0, 0.0, 1.0, 2.0, 3.0, 3.0, 3.0, 3.0, 3.0, None, None, None]
    for step in (1, 2, 3, 5):
        found = [None if r.x is None or r.x != r.x else r.x + 0.0 for r in rows.every(df, step, "x").collect()]
        assert sorted(map(str, found)) == sorted(map(str, in_order[::step])), step
    assert sorted(r.id for r in rows.every(df, 4, ["-x", "id"]).collect()) == [2, 6, 10]
    assert rows.every(df.limit(0), 3, "x").count() == 0


def test_every_and_repeat(spark):
    df = spark.range(25).repartition(3)
    assert [r.id for r in rows.every(df, 10, "id").orderBy("id").collect()] == [0, 10, 20]
    assert rows.every(df, 1, "id").count() == 25
    twice = rows.repeat(spark.range(2), 2, "id")
    assert [(r.id, r.copy) for r in twice.collect()] == [(0, 1), (1, 1), (0, 2), (1, 2)]
    assert [(r.id, r.copy) for r in rows.repeat(spark.range(2), 2, "id", by_row=True).collect()] == [(0, 1), (0, 2), (1, 1), (1, 2)]


def test_unique_keeps_the_first_and_is_idempotent(spark):
    df = frame(spark, [("a", 3, 1.0), ("a", 1, 2.0), ("b", 2, 3.0), (None, 5, 4.0), (None, None, 5.0)], "k string, o int, x double")
    once = rows.unique(df, "o", ["k"], count="n")
    assert {tuple(r) for r in once.collect()} == {(2, "a", 1, 2.0), (1, "b", 2, 3.0), (2, None, 5, 4.0)}
    again = rows.unique(once.drop("n"), "o", ["k"])
    assert {tuple(r) for r in again.collect()} == {("a", 1, 2.0), ("b", 2, 3.0), (None, 5, 4.0)}


def test_assert(spark):
    good = rows.assert_all(spark.range(5), F.col("id") >= 0)
    assert good.count() == 5
    modes.discard(good)
    with pytest.raises(PySparkException, match="too large"):
        modes.discard(rows.assert_all(spark.range(5), "id < 3", "too large"))
    with pytest.raises(PySparkException):
        modes.discard(rows.assert_all(frame(spark, [(None,)], "id int"), "id < 3"))


def test_check(spark):
    df = frame(spark, [(1, 1.0), (1, NAN), (None, None), (None, NAN), (2, 0.0)], "k int, x double")
    assert tuple(rows.check(df, ["k"]).first()) == (5, 2, 1, 2)


# --- columns --------------------------------------------------------------------------------------


def test_column_specs(spark):
    df = frame(spark, [(1, 2, 3, 4)], "a_x int, b_x int, c int, d int")
    df = columns.column_metadata(df, "c", ucd="pos.eq.ra;meta.main")
    assert columns.resolve(df, 1, "4", "*_x") == ["a_x", "d", "b_x"]
    assert columns.resolve(df, "b_x..d") == ["b_x", "c", "d"]
    assert columns.resolve(df, "..b_x", "c..") == ["a_x", "b_x", "c", "d"]
    assert columns.resolve(df, "ucd$pos_eq_ra") == ["c"]
    with pytest.raises(ValueError):
        columns.resolve(df, "e")
    # Positions are those of the table a step sees.
    assert columns.delete_columns(columns.delete_columns(df, 1), 1).columns == ["c", "d"]


def test_metadata_survives_and_describes(spark):
    df = columns.add_column(spark.range(1), "v", "id * 2.0", before="id", units="m/s", desc="speed")
    assert df.columns == ["v", "id"]
    df = columns.replace_column(df, "v", F.col("v") + 1, ucd="phys.veloc")
    assert columns.describe_columns(df)[0] | {"class": ""} == {
        "index": 1, "name": "v", "class": "", "units": "m/s", "desc": "speed", "ucd": "phys.veloc",
    }


def test_replace_values_with_blanks(spark):
    df = frame(spark, [(1, -99.0), (2, NAN), (3, None), (4, 1.0)], "i int, x double")
    assert [r.x for r in columns.bad_value(df, -99.0, "x").orderBy("i").collect()][0] is None
    assert [r.x for r in columns.replace_value(df, None, 0.0, "x").orderBy("i").collect()] == [-99.0, 0.0, 0.0, 1.0]


def test_constant_columns(spark):
    df = frame(spark, [(1, "a", None, 5), (2, "a", "z", None)], "i int, c string, n string, h int")
    kept, found = columns.constant_columns(df)
    assert kept.columns == ["i", "n", "h"] and found == {"c": "a"}
    kept, found = columns.constant_columns(df, accept_null=True)
    assert kept.columns == ["i"] and found == {"c": "a", "n": "z", "h": 5}


def test_arrays_to_columns_and_back(spark):
    df = frame(spark, [(1, 2, 3, "x")], "a int, b int, c int, d string")
    packed = columns.collapse_columns(df, "v", "b", 2)
    assert packed.columns == ["a", "v", "d"] and packed.first().v == [2, 3]
    assert tuple(columns.explode_columns(packed, "v").first()) == (1, 2, 3, "x")
    assert columns.explode_all(packed).columns == ["a", "v_1", "v_2", "d"]
    ragged = frame(spark, [([1],), ([1, 2],), (None,)], "v array<int>")
    assert {tuple(r) for r in columns.explode_columns(ragged, "v").collect()} == {(1, None), (1, 2), (None, None)}


def test_fix_names(spark):
    df = frame(spark, [(1, 2, 3, 4)], "`a b` int, `a_b` int, `2x` int, `A_B` int")
    assert columns.fix_names(df).columns == ["a_b", "a_b_2", "_2x", "A_B_3"]


def test_transpose(spark):
    df = frame(spark, [("r1", 1, 2.5), ("r2", 3, None)], "n string, a int, b double")
    assert {tuple(r) for r in columns.transpose(df).collect()} == {("a", "1", "3"), ("b", "2.5", None)}
    with pytest.raises(ValueError):
        columns.transpose(frame(spark, [("r", 1), ("r", 2)], "n string, a int"))


# --- statistics -----------------------------------------------------------------------------------


def test_statistics_of_blank_columns(spark):
    df = frame(spark, [(1, NAN, None, "x"), (2, None, None, None)], "i int, x double, y int, s string")
    found = {r.Name: r for r in stats.statistics(df, items=["Name", "NGood", "NBad", "Mean", "Median", "Cardinality", "Class"]).collect()}
    assert (found["x"].NGood, found["x"].NBad, found["x"].Mean, found["x"].Median) == (0, 2, None, None)
    assert (found["y"].NGood, found["s"].NGood, found["s"].Mean) == (0, 1, None)
    assert found["i"].Median == 1.5 and found["i"].Class == "int" and found["x"].Cardinality == 0


def test_whole_numbers_stay_exact(spark):
    big = 2**53 + 1
    df = frame(spark, [(big, 1, "a"), (big + 2, 2, "b"), (None, 3, None)], "n long, i int, t string")
    got = {r.Name: r for r in stats.statistics(df, items=["Name", "Minimum", "Maximum", "Sum", "Class", "Index"]).collect()}
    assert (got["n"].Minimum, got["n"].Maximum, got["n"].Sum) == (big, big + 2, 2 * big + 2)
    assert (got["i"].Sum, got["t"].Sum, got["t"].Class, got["t"].Index) == (6, None, "string", 3)
    mixed = stats.statistics(df.withColumn("x", F.lit(0.5)), items=["Name", "Minimum"]).collect()
    assert {r.Name: r.Minimum for r in mixed} == {"n": float(big), "i": 1.0, "t": None, "x": 0.5}


def test_statistics_the_same_as_built_in_quantiles(spark):
    df = spark.range(300).select((F.hash("id") % 50 / 4.0).alias("x"), "id")
    items = ["Median", "Quartile1", "Quartile3", "Q.9", "MedAbsDev", "ScMedAbsDev"]
    for row in stats.statistics(df, items=items).collect():
        median, *others = df.agg(*[F.percentile(row.Name, s) for s in (0.5, 0.25, 0.75, 0.9)]).first()
        deviation = df.agg(F.percentile(F.abs(F.col(row.Name) - median), 0.5)).first()[0]
        assert tuple(row)[1:] == pytest.approx((median, *others, deviation, deviation * stats.MAD_SCALE))


def test_cardinality_limit_and_positions(spark):
    df = frame(spark, [(i, i % 100, i % 101, [4.0, 1.0, NAN, 1.0, 9.0][i % 5]) for i in range(505)], "i int, a int, b int, x double")
    found = {r.Name: r for r in stats.statistics(df, items=["Cardinality", "MinPos", "MaxPos"], order_by="i").collect()}
    assert (found["a"].Cardinality, found["b"].Cardinality) == (100, None)
    assert (found["x"].MinPos, found["x"].MaxPos) == (2, 5)
    with pytest.raises(ValueError):
        stats.statistics(df, items=["MinPos"])
    with pytest.raises(ValueError):
        stats.statistics(df, items=["a"])


def test_checksum_ignores_order_and_sees_changes(spark):
    df = spark.range(100).withColumn("v", F.col("id") % 7)
    first = modes.checksum(df).first()
    assert modes.checksum(df.repartition(5)).first() == first
    assert modes.checksum(df.withColumn("v", F.col("id") % 8)).first() != first
    assert modes.checksum(df.union(df).union(df)).first() != first


# --- together -------------------------------------------------------------------------------------


def test_unique_parts_of_locations():
    assert combine.unique_parts(["/data/cat_a1.fits", "/data/cat_b2.fits"]) == (["a1", "b2"], "/data/cat_", ".fits")
    assert combine.unique_parts(["aa", "aaa"]) == (["", "a"], "aa", "")
    assert combine.unique_parts(["x"]) == ([""], "x", "")


def test_concatenate_refuses_unlike_tables(spark):
    with pytest.raises(ValueError):
        combine.concatenate([spark.range(1), spark.range(1).withColumn("x", F.lit(1))])
    with pytest.raises(ValueError):
        combine.concatenate([spark.range(1), spark.range(1).select(F.col("id").cast("string"))])


def test_array_join_in_parts(spark):
    side = frame(spark, [("f", i, i * 10) for i in range(7)] + [("g", 0, 5)], "loc string, pos int, v int")
    df = frame(spark, [(1, "f"), (2, "g"), (3, "none")], "id int, url string")
    whole = {r.id: r.v for r in combine.array_join(df, "url", side, "loc", "pos").collect()}
    assert whole == {1: [0, 10, 20, 30, 40, 50, 60], 2: [5], 3: None}
    parts = combine.array_join(df, "url", side, "loc", "pos", rows_per_part=3).orderBy("id", "part").collect()
    assert [v for r in parts if r.id == 1 for v in r.v] == whole[1] and len(parts) == 5


def test_join_rows_stops_at_the_shorter(spark):
    joined = combine.join_rows([spark.range(5), spark.range(10, 13)], ["id", "id"])
    assert {tuple(r) for r in joined.collect()} == {(0, 10), (1, 11), (2, 12)}


def test_cube_leaves_blanks_out(spark):
    df = frame(spark, [(0.5, 1.0), (-0.5, NAN), (NAN, 1.0), (0.9, None)], "x double, w double")
    assert {tuple(r) for r in combine.cube(df, [("x", 0.0, 1.0)]).collect()} == {(0, 2), (-1, 1)}
    assert {tuple(r) for r in combine.cube(df, [("x", 0.0, 1.0)], "w").collect()} == {(0, 1.0), (-1, None)}


def test_steps_run_in_order(spark):
    steps = [step(rows.select_rows, "id < 6"), step(rows.tail, 3, "id"), step(rows.head, 2, "id")]
    assert [r.id for r in process(spark.range(10), steps).collect()] == [3, 4]
    assert tuple(process(spark.range(10), steps, "count").first()) == (1, 2)


def test_formats(spark, tmp_path):
    df = frame(spark, [(1, "a\tb"), (2, None)], "i long, s string")
    for name in ("csv", "tsv", "parquet", "orc", "json"):
        tables.write_table(df, str(tmp_path / name), name)
        assert {tuple(r) for r in tables.read_table(spark, str(tmp_path / name), name, df.schema).collect()} == {(1, "a\tb"), (2, None)}
    with pytest.raises(ValueError):
        tables.read_table(spark, "x", "fits")
    assert tables.with_location(tables.read_table(spark, str(tmp_path / "csv"), "csv", df.schema)).first().location.startswith("file:")


def test_files_are_processed_once(spark, tmp_path):
    from tablemill.streaming.once import process_new_files

    def add(ids):
        spark.createDataFrame([(i,) for i in ids], "id long").coalesce(1).write.mode("append").csv(str(tmp_path / "in"), header=True)

    def run():
        process_new_files(spark, str(tmp_path / "in"), "csv", "id long", [step(rows.select_rows, "id % 2 = 0")], str(tmp_path / "out"), str(tmp_path / "c"))
        return sorted(r.id for r in spark.read.schema("id long").parquet(str(tmp_path / "out")).collect())

    add(range(5))
    assert run() == [0, 2, 4]
    add(range(5, 9))
    assert run() == [0, 2, 4, 6, 8] == run()


@pytest.mark.parametrize("places", [["/d/cat_ab.csv", "/d/cat_cb.csv"], ["x"], ["aa", "aaa", "a"], ["abab", "ab"], ["p/1", "p/2", "p/10"]])
def test_location_parts(spark, places):
    df = frame(spark, [(p, i) for p in places for i in range(3)], "location string, i int")
    got = {(r.location, r.part, r.seq) for r in combine.label_locations(df, sequence="seq", unique="part").collect()}
    parts, _, _ = combine.unique_parts(places)
    assert got == {(p, part, sorted(places).index(p) + 1) for p, part in zip(places, parts)}


TEXTS = {
    "prefixed": [f"Customer#{i:09d}" for i in range(500)],
    "shared": ["common beginning, then more " + "x" * (i % 7) + chr(97 + i % 26) * (i % 40) for i in range(300)] + ["a", "z", "", "é", "\U0001F600"],
    "hot": ["the same long text in nearly every row"] * 400 + ["the same long text in nearly every rox", "b", None, None],
    "bytes": ["\x00", "\x00\x00", "a\x00b", "a", "aa", "ÿ", "\ue000", "\U00010000"] * 3,
}


@pytest.mark.parametrize("name", list(TEXTS))
def test_heads_of_texts(spark, name):
    data = [(t, i) for i, t in enumerate(TEXTS[name])]
    df = frame(spark, data, "t string, i int").repartition(3)
    ranked = sorted((x for x in data if x[0] is not None), key=lambda x: (x[0].encode(), x[1]))
    blank = [x for x in data if x[0] is None]
    same = lambda d: [tuple(r) for r in d.collect()]
    for n in (1, 4, 50):
        assert same(rows.head(df, n, ["t", "i"])) == (ranked + blank)[:n]
        assert same(rows.tail(df, n, ["t", "i"])) == (ranked + blank)[-n:]
        falling = sorted(ranked, key=lambda x: (x[0].encode(), x[1]), reverse=True)
        assert same(rows.sort_head(df, n, ["t", "i"], down=True)) == (falling + blank[::-1])[:n]
    middle = len(data) // 2
    assert same(rows.row_range(df, middle, "+3", ["t", "i"])) == (ranked + blank)[middle - 1 : middle + 2]


def test_heads_of_texts_sort_a_few_rows(spark, monkeypatch):
    """What is numbered is a small part of the table, also where nine tenths begin alike."""
    sizes, number = [], rows.number_rows
    monkeypatch.setattr(rows, "number_rows", lambda df, order: sizes.append(df.count()) or number(df, order))
    df = spark.range(50_000).select(F.when(F.col("id") % 10 > 0, F.format_string("a long beginning %08d", "id")).otherwise(F.md5(F.col("id").cast("string"))).alias("t"), "id")
    expected = [tuple(r) for r in df.orderBy("t", "id").limit(30_010).offset(30_000).collect()]
    assert [tuple(r) for r in rows.row_range(df, 30_001, "+10", ["t", "id"]).collect()] == expected
    assert [tuple(r) for r in rows.head(df, 5, ["t", "id"]).collect()] == [tuple(r) for r in df.orderBy("t", "id").limit(5).collect()]
    assert max(sizes) < 2_500
