"""Cases that earlier versions got wrong."""

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tablemill.functions import healpix
from tablemill.operators import columns, coverage, match, prepare, rank, rows
from tablemill.plans import registry
from tablemill.session import cleared, new_folder, shared_folder, written
from tablemill.sources import records
from tests.test_match import deepest, positions, sky, tiles


def test_stray_elements_leave_their_file(spark):
    texts = ['[{"prompt":"a"}, 3, {"prompt":"b","chat.jar":"x"}, null, "t", [1]]', '{"prompt":"c"}', "[", "[]"]
    files = spark.createDataFrame([(t, f"f{i}", "p") for i, t in enumerate(texts)], "value string, file string, path string")
    got = records.parse_arrays(files).collect()
    assert sorted((r.prompt, r.status, r.file) for r in got) == [("a", None, "f0"), ("b", "x", "f0")]


def test_corpus_folders(spark, tmp_path):
    for name, text in (("a/one.json", '[{"prompt":"a"},{"prompt":"b"}, 7]'), ("a/broken.json", "[{"), ("b/two.json", '[{"prompt":"c"}]'), ("b/alone.json", '{"prompt":"d"}')):
        path = tmp_path / name
        path.parent.mkdir(exist_ok=True)
        path.write_text(text)
    got = records.read_corpus(spark, str(tmp_path / "a"), str(tmp_path / "b"), str(tmp_path / "missing")).collect()
    assert sorted((r.prompt, r.file) for r in got) == [("a", "one.json"), ("b", "one.json"), ("c", "two.json")]


def test_median_between_two_values(spark):
    df = spark.createDataFrame([(1, float(v)) for v in range(4)] + [(2, 5.0), (2, float("nan"))], "k int, v double")
    got = {r.k: r.m for r in rows.group(df, ["k"], [("median", "v", "m")]).collect()}
    assert got == {1: 1.5, 2: 5.0}


def test_nan_is_blank_in_constant_columns(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, float("nan"))], "a double, b double")
    assert list(columns.constant_columns(df)[1]) == ["a"]
    assert sorted(columns.constant_columns(df, accept_null=True)[1]) == ["a", "b"]


@pytest.mark.parametrize("find", ["all", "best1", "best"])
def test_zero_tolerance_is_equality(spark, find):
    a = spark.createDataFrame([(1, 10.0, 5.0), (2, 10.0, 6.0), (3, 0.0, -90.0)], "i int, ra double, dec double")
    b = spark.createDataFrame([(7, 10.0, 5.0), (8, 10.0, 6.0 + 1e-9), (9, 0.0, -90.0)], "j int, ra double, dec double")
    pairs = lambda m: {(r[0], r[1], r[2]) for r in match.find_pairs(m, a, b, "i", "j", find).collect()}
    same = {(1, 7, 0.0), (3, 9, 0.0)}
    assert pairs(match.Sky(0.0)) == same
    assert pairs(match.Cartesian(0.0, ("ra", "dec"), ("ra", "dec"))) == same
    assert {p[:2] for p in pairs(match.Anisotropic((0.0, 1.0), ("ra", "dec"), ("ra", "dec")))} >= {(1, 7), (2, 8), (3, 9)}


def test_infinities_are_first_and_last_ranks(spark):
    inf = float("inf")
    values = [-inf, -inf, inf, float("nan"), None] + [float(i * i) for i in range(300)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    wanted = [(F.col("v"), lambda n, k=k: k) for k in (1, 2, 3, 150, 302, 303, 304)]
    assert rank.order_statistics(df, wanted) == [-inf, -inf, 0.0, 147.0**2, 299.0**2, inf, None]


def test_ranges_of_any_length(spark):
    top = 12 * 4**29 - 1
    df = spark.createDataFrame([(1, f"29/0-{top}"), (2, "3/5-70"), (3, f"29/1-{top}"), (4, "2/12-15"), (5, "0/2-4 2/7")], "i int, m string")
    found: dict = {}
    for r in coverage.parse_ascii(df, "m").collect():
        found.setdefault(r.i, set()).add((r.order, r.ipix))
    assert found[1] == {(0, i) for i in range(12)} and found[4] == {(1, 3)} and found[5] == {(0, 2), (0, 3), (0, 4), (2, 7)}
    assert deepest(found[2], 3) == set(range(5, 71))
    assert sum(4 ** (29 - o) for o, _ in found[3]) == top and len(found[3]) == 11 + 3 * 29


def test_near_coverage_is_exact(spark):
    places = positions(400, 21)
    cells = [(2, 17), (3, 400), (0, 11), (2, 70), (1, 0)]
    near = {r.i for r in coverage.near_coverage(sky(spark, places, "i"), "i", tiles(spark, cells), 3.0).collect()}
    order = 8
    fine = np.array(sorted(deepest(cells, order)), dtype="int64")
    at = healpix._centres(*(pd.Series(v) for v in (fine, np.full(len(fine), order))))

    def vectors(ra, dec):
        ra, dec = np.radians(ra), np.radians(dec)
        return np.stack([np.cos(dec) * np.cos(ra), np.cos(dec) * np.sin(ra), np.sin(dec)], axis=-1)

    grid = vectors(at.ra.to_numpy(), at.dec.to_numpy())
    gaps = [np.degrees(2 * np.arcsin(np.linalg.norm(grid - vectors(*p), axis=1).min() / 2)) for p in places]
    slack = healpix.pixel_radius_degrees(order)
    assert {i for i, g in enumerate(gaps) if g <= 3.0} <= near <= {i for i, g in enumerate(gaps) if g <= 3.0 + slack}
    assert len(near) < len(places)


def test_intermediate_tables_are_cleared(spark):
    def tables():
        place = spark._jvm.org.apache.hadoop.fs.Path(shared_folder(spark))
        found = place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).listStatus(place)
        return {f.getPath().getName() for f in found}

    outer = written(spark.range(3), "outer")
    before = tables()
    with cleared(spark):
        first = rows.sort_head(spark.range(1000), 10, ["id"]).count()
        numbered = rank.number_rows(spark.range(100).repartition(4), ["id"], "rn")
        with cleared(spark):
            inner = written(spark.range(5), "inner")
            assert inner.count() == 5 and len(tables() - before) >= 1
        assert numbered.agg(F.max("rn")).first()[0] == 100 and first == 10
        new_folder(spark, "never")
    assert tables() == before and outer.count() == 3
    with pytest.raises(ZeroDivisionError):
        with cleared(spark):
            written(spark.range(5), "inner")
            1 / 0
    assert tables() == before


def test_one_empty_or_missing_text_does_not_end_a_query(spark, tmp_path):
    """The empty text has no first token and the missing one no tokens at all; either raised an error."""
    function, sql = registry.ALL["batched_tokenizer"]
    ordinary = [(1, "ab"), (2, "\U0001f600x"), (2, "\U0001f600x"), (None, "\x00y")]
    for name, odd in (("empty", [(3, "")]), ("missing", [(4, None)]), ("both", [(3, ""), (4, None), (5, None)])):
        path = str(tmp_path / name)
        spark.createDataFrame(ordinary + odd, "doc_id long, text string").coalesce(1).write.parquet(f"{path}/documents.parquet")
        found = function(spark, path)
        assert found.dtypes == [("doc_id", "bigint"), ("tokens", "bigint"), ("first_id", "int")]
        connection = duckdb.connect()
        connection.execute(f"create view documents as select * from read_parquet('{path}/documents.parquet/*.parquet')")
        assert sorted(map(tuple, found.collect()), key=repr) == sorted(connection.execute(sql).fetchall(), key=repr)


def test_a_tokenizer_gets_no_missing_texts(spark, monkeypatch):
    def ids(batch: pd.Series) -> pd.Series:
        assert len(batch) and list(batch.index) == list(range(len(batch)))
        return batch.map(lambda t: [ord(c) for c in t])

    texts = [None, "ab", "", None, "cde", None, "fg", None, None, "h"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string").coalesce(1)
    wanted = {i: (None, None) if t is None else ([ord(c) for c in t], [1] * len(t)) for i, t in enumerate(texts)}
    for characters in (1, 3, 1000):  # batches of one row, some of them without any text, and one of all rows
        monkeypatch.setattr(prepare, "CHARACTERS", characters)
        assert {r.i: (r.input_ids, r.attention_mask) for r in prepare.tokenise(df, ids).collect()} == wanted
    assert [r.input_ids for r in prepare.tokenise(df.where("text is null"), ids).collect()] == [None] * 5
