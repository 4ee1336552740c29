"""Matches against brute force, connected components, sky coverage."""

import itertools
import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tablemill.functions import healpix
from tablemill.operators import components as graph, coverage, match, multimatch

random.seed(11)


def separation(a, b):
    (ra1, d1), (ra2, d2) = [(math.radians(x), math.radians(y)) for x, y in (a, b)]
    h = math.sin((d2 - d1) / 2) ** 2 + math.cos(d1) * math.cos(d2) * math.sin((ra2 - ra1) / 2) ** 2
    return math.degrees(2 * math.asin(math.sqrt(min(1.0, h))))


def positions(n, seed):
    """Positions with both poles, the seam at 0/360 and a dense patch over-represented."""
    r = random.Random(seed)
    found = []
    for i in range(n):
        kind = i % 5
        if kind == 0:
            found.append((r.uniform(0, 360), r.choice([-1, 1]) * (90 - abs(r.gauss(0, 1.5)))))
        elif kind == 1:
            found.append((r.gauss(0, 1.5) % 360, r.uniform(-60, 60)))
        elif kind == 2:
            found.append((120 + r.gauss(0, 2), 40 + r.gauss(0, 2)))
        else:
            found.append((r.uniform(0, 360), math.degrees(math.asin(r.uniform(-1, 1)))))
    return found + [(0.0, 90.0), (77.0, 90.0), (10.0, -90.0), (359.9999999, 0.0), (0.0, 0.0)]


def table(spark, places, key):
    return spark.createDataFrame([(i, *p) for i, p in enumerate(places)], f"{key} long, " + ", ".join(f"x{i} double" for i in range(len(places[0]))))


def sky(spark, places, key):
    return table(spark, places, key).withColumnsRenamed({"x0": "ra", "x1": "dec", "x2": "err"})


def ids(df):
    return {(r[0], r[1]) for r in df.select(match.ID1, match.ID2).collect()}


A, B = positions(400, 1), positions(400, 2)


@pytest.mark.parametrize("radius", [0.02, 1.0, 7.0, 100.0])
def test_sky_pairs(spark, radius):
    a, b = A[:120] + A[-5:], B[:120] + B[-5:]
    if radius < 50:
        a, b = A, B
    found = match.find_pairs(match.Sky(radius * 3600), sky(spark, a, "ia"), sky(spark, b, "ib"), "ia", "ib", "all")
    rows = found.collect()
    expected = {(i, j) for i, p in enumerate(a) for j, q in enumerate(b) if separation(p, q) <= radius}
    assert len(rows) == len(expected) and {(r[0], r[1]) for r in rows} == expected
    for r in rows[:50]:
        assert r[2] / 3600 == pytest.approx(separation(a[r[0]], b[r[1]]), abs=1e-9)


def test_longitudes_outside_the_circle(spark):
    a, b = [(-0.1, 5.0), (725.0, 0.0)], [(359.9, 5.0), (5.0, 0.0)]
    found = match.find_pairs(match.Sky(1.0), sky(spark, a, "ia"), sky(spark, b, "ib"), "ia", "ib", "all")
    assert ids(found) == {(0, 0), (1, 1)}


def test_blank_positions_match_nothing(spark):
    a = spark.createDataFrame([(1, None, 0.0), (2, float("nan"), 0.0), (3, 0.0, 0.0)], "ia long, ra double, dec double")
    b = a.withColumnRenamed("ia", "ib")
    for find in ("all", "best", "best1", "best2"):
        assert ids(match.find_pairs(match.Sky(10.0), a, b, "ia", "ib", find)) == {(3, 3)}
    left = match.match_tables(a, b, "ia", "ib", match.Sky(10.0), find="best1", join="1not2")
    assert {r.ia for r in left.collect()} == {1, 2}


def test_errors_per_row(spark):
    r = random.Random(3)
    a = [(*p, r.choice([10.0, 600.0, 3000.0])) for p in A]
    b = [(*p, r.choice([5.0, 1000.0])) for p in B]
    found = match.find_pairs(match.SkyErrors(60.0), sky(spark, a, "ia"), sky(spark, b, "ib"), "ia", "ib", "all")
    expected = {(i, j) for i, p in enumerate(a) for j, q in enumerate(b) if separation(p[:2], q[:2]) * 3600 <= p[2] + q[2]}
    assert ids(found) == expected and expected
    # One error of ten degrees, one of the whole sky, one of none.
    a[0], b[0], b[1] = (*a[0][:2], 36_000.0), (*b[0][:2], 3e6), (*b[1][:2], 0.0)
    found = match.find_pairs(match.SkyErrors(60.0), sky(spark, a, "ia"), sky(spark, b, "ib"), "ia", "ib", "all")
    expected = {(i, j) for i, p in enumerate(a) for j, q in enumerate(b) if separation(p[:2], q[:2]) * 3600 <= p[2] + q[2]}
    assert ids(found) == expected and found.count() == len(expected)


def test_groups_within_one_table(spark):
    r = random.Random(11)
    points = [(r.uniform(0, 30),) for _ in range(150)] + [(5.0,)] * 60 + [(None,)]
    df = table(spark, points, "i")
    matcher = match.Cartesian(0.1, ("x0",), ("x0",))
    close = {(i, j) for i, p in enumerate(points[:-1]) for j, q in enumerate(points[:-1]) if i < j and abs(p[0] - q[0]) <= 0.1}
    assert ids(multimatch.within_pairs(df, "i", matcher, ("x0",))) == close
    group = {i: i for i in range(len(points) - 1)}
    for _ in range(len(points)):
        for i, j in close:
            group[i] = group[j] = min(group[i], group[j])
    sizes = Counter(group.values())
    found = {tuple(x) for x in multimatch.within_groups(df, "i", matcher, ("x0",)).collect()}
    assert found == {(i, g, sizes[g]) for i, g in group.items() if sizes[g] > 1}


@pytest.mark.parametrize("dimensions", [1, 2, 3])
def test_cartesian(spark, dimensions):
    r = random.Random(dimensions)
    a, b = [[tuple(r.uniform(-3, 3) for _ in range(dimensions)) for _ in range(150)] for _ in range(2)]
    names = tuple(f"x{i}" for i in range(dimensions))
    found = match.find_pairs(match.Cartesian(0.4, names, names), table(spark, a, "ia"), table(spark, b, "ib"), "ia", "ib", "all")
    assert ids(found) == {(i, j) for i, p in enumerate(a) for j, q in enumerate(b) if math.dist(p, q) <= 0.4}
    tolerances = tuple(0.2 * (i + 1) for i in range(dimensions))
    found = match.find_pairs(match.Anisotropic(tolerances, names, names), table(spark, a, "ia"), table(spark, b, "ib"), "ia", "ib", "all")
    scaled = lambda p: tuple(x / t for x, t in zip(p, tolerances))
    assert ids(found) == {(i, j) for i, p in enumerate(a) for j, q in enumerate(b) if math.dist(scaled(p), scaled(q)) <= 1}


def greedy(a, b, limit, distance):
    """One-to-one pairs, closest first, ties by ids of the first and then of the second table."""
    close = sorted((distance(p, q), i, j) for i, p in enumerate(a) for j, q in enumerate(b) if distance(p, q) <= limit)
    used_a, used_b, pairs = set(), set(), set()
    for _, i, j in close:
        if i not in used_a and j not in used_b:
            used_a.add(i)
            used_b.add(j)
            pairs.add((i, j))
    return pairs


def test_best_is_one_to_one(spark):
    # Positions at a pole differ in longitude only, so their distances tie up to rounding.
    a, b = A[:-5], B[:-5]
    found = match.find_pairs(match.Sky(2 * 3600), sky(spark, a, "ia"), sky(spark, b, "ib"), "ia", "ib", "best")
    assert ids(found) == greedy(a, b, 2.0, separation)


def test_best_partners(spark):
    a, b = A[:-5], B[:-5]
    one = match.find_pairs(match.Sky(3600), sky(spark, a, "ia"), sky(spark, b, "ib"), "ia", "ib", "best1")
    two = match.find_pairs(match.Sky(3600), sky(spark, a, "ia"), sky(spark, b, "ib"), "ia", "ib", "best2")
    near = lambda p, others: min((separation(p, q), j) for j, q in enumerate(others))
    assert ids(one) == {(i, near(p, b)[1]) for i, p in enumerate(a) if near(p, b)[0] <= 1}
    assert ids(two) == {(near(q, a)[1], j) for j, q in enumerate(b) if near(q, a)[0] <= 1}


def test_copies_at_one_place(spark):
    """A third of both tables lies at one position; copies pair off in order, without all their pairs."""
    a = [(10.0, 10.0)] * 30 + A[:60]
    b = [(10.0, 10.0)] * 20 + [(10.0, 10.0001)] * 5 + B[:40]
    ta, tb = sky(spark, a, "ia"), sky(spark, b, "ib")
    assert ids(match.find_pairs(match.Sky(10.0), ta, tb, "ia", "ib", "best")) == greedy(a, b, 10 / 3600, separation)
    one = dict(ids(match.find_pairs(match.Sky(10.0), ta, tb, "ia", "ib", "best1")))
    assert all(one[i] == 0 for i in range(30))
    exact = match.Exact(("ra", "dec"), ("ra", "dec"))
    assert ids(match.find_pairs(exact, ta, tb, "ia", "ib", "best")) == {(i, i) for i in range(20)}


@pytest.mark.parametrize("join", match._JOINS)
def test_join_types(spark, join):
    a = spark.createDataFrame([(1, "x"), (2, "y"), (3, None)], "i long, k string")
    b = spark.createDataFrame([(7, "y"), (8, "z"), (9, None)], "j long, k string")
    out = match.match_tables(a, b, "i", "j", match.Exact(("k",), ("k",)), find="best1", join=join)
    both, one, two = {(2, 7)}, {(1, None), (3, None)}, {(None, 8), (None, 9)}
    expected = {
        "1and2": both, "all1": both | one, "all2": both | two, "1or2": both | one | two, "1xor2": one | two,
        "1not2": {1, 3}, "2not1": {8, 9},
    }[join]
    if join == "1not2":
        assert out.columns == ["i", "k"] and {r.i for r in out.collect()} == expected
    elif join == "2not1":
        assert out.columns == ["j", "k"] and {r.j for r in out.collect()} == expected
    else:
        assert out.columns == ["i", "k_1", "Score", "j", "k_2"]
        assert {(r.i, r.j) for r in out.collect()} == expected


def components(edges):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for u, v in edges:
        a, b = sorted((find(u), find(v)))
        root[b] = a
    return {x: find(x) for x in root}


GRAPHS = {
    "chain": [(i, i + 1) for i in range(60)],
    "star": [(0, i) for i in range(1, 40)] + [(100, i) for i in range(101, 120)],
    "random": [(random.Random(i).randrange(150), random.Random(-i - 1).randrange(150)) for i in range(120)],
    "loops": [(1, 1), (2, 3), (3, 2), (2, 3)],
    "none": [],
}


@pytest.mark.parametrize("name", list(GRAPHS))
def test_connected_components(spark, name):
    edges = GRAPHS[name]
    shuffled = [e[::-1] if i % 2 else e for i, e in enumerate(edges)]
    random.Random(4).shuffle(shuffled)
    found = multimatch.connected_components(spark.createDataFrame(shuffled, "u long, v long"))
    rows = found.collect()
    expected = components([e for e in edges if e[0] != e[1]])
    assert len(rows) == len(expected) and {r.node: r.component for r in rows} == expected


def test_groups_against_brute_force(spark):
    places = [positions(80, s) for s in (5, 6, 7)]
    inputs = [multimatch.Input(sky(spark, p, f"i{n}"), f"i{n}", ("ra", "dec")) for n, p in enumerate(places)]
    edges = [
        ((n, i), (m, j))
        for n, m in itertools.combinations(range(3), 2)
        for i, p in enumerate(places[n])
        for j, q in enumerate(places[m])
        if separation(p, q) <= 1.5
    ]
    groups = {}
    for node, head in components(edges).items():
        groups.setdefault(head, []).append(node)
    expected = {tuple(min((i for t, i in g if t == n), default=None) for n in range(3)) for g in groups.values()}
    found = multimatch.match_groups(inputs, match.Sky(1.5 * 3600)).select("i0", "i1", "i2").collect()
    assert len(found) == len(groups) and {tuple(r) for r in found} == expected


def test_admission_rules(spark):
    present = [(a, b, c) for a in (0, 1) for b in (0, 1) for c in (0, 1) if a + b + c]
    df = spark.createDataFrame(present, "a int, b int, c int")

    def kept(*joins):
        inputs = [multimatch.Input(None, "", (), j) for j in joins]
        return {tuple(r) for r in df.where(multimatch.admitted(inputs, [F.col(n) == 1 for n in "abc"])).collect()}

    assert kept("default", "default", "default") == {p for p in present if sum(p) >= 2}
    assert kept("match", "default", "nomatch") == {(1, 1, 0)}
    assert kept("always", "default", "default") == {p for p in present if sum(p) >= 2 or p[0]}
    assert kept("always", "nomatch", "default") == {p for p in present if (sum(p) >= 2 and not p[1]) or p[0]}


def test_column_renaming(spark):
    from tablemill.operators.combine import fix_columns

    a = spark.createDataFrame([(1, 2)], "id int, x int")
    b = spark.createDataFrame([(1, 2)], "id int, y int")
    names = lambda *args: [t.columns for t in fix_columns([a, b], *args)]
    assert names() == [["id_1", "x"], ["id_2", "y"]]
    assert names("none") == [["id", "x"], ["id", "y"]]
    assert names("all", ["_p", "_q"]) == [["id_p", "x_p"], ["id_q", "y_q"]]


# --- coverage -------------------------------------------------------------------------------------


def test_every_pixel_has_its_centre_in_itself(spark):
    for order in (0, 1, 2, 3):
        n = 12 * 4**order
        centres = spark.range(n).withColumn("at", healpix.pixel_centre("id", F.lit(order))).select("id", "at.*")
        back = centres.select("id", healpix.pixel("ra", "dec", order).alias("p"), healpix.pixel("ra", "dec", 29).alias("deep"))
        rows = back.select("id", "p", healpix.parent("deep", F.lit(29 - order)).alias("up")).collect()
        assert all(r.id == r.p == r.up for r in rows) and len(rows) == n


def test_pixels_have_equal_areas(spark):
    sky_rows = spark.range(48000).select(
        ((F.col("id") * 0.6180339887498949) % 1 * 360).alias("ra"), F.degrees(F.asin((F.col("id") * 2 + 1) / 48000 - 1)).alias("dec")
    )
    counts = [r["count"] for r in sky_rows.groupBy(healpix.pixel("ra", "dec", 1).alias("p")).count().collect()]
    assert len(counts) == 48 and all(abs(c - 1000) < 60 for c in counts)


def test_pixel_radius_bounds_the_corners(spark):
    for order in (0, 1, 2, 3):
        points = spark.range(20000).select(
            ((F.col("id") * 0.6180339887498949) % 1 * 360).alias("ra"), F.degrees(F.asin((F.col("id") * 2 + 1) / 20000 - 1)).alias("dec")
        )
        from tablemill.functions.sky import sky_distance

        placed = points.withColumn("p", healpix.pixel("ra", "dec", order)).withColumn("at", healpix.pixel_centre("p", F.lit(order)))
        far = placed.select("ra", "dec", F.col("at.ra").alias("r"), F.col("at.dec").alias("d")).agg(F.max(sky_distance("ra", "dec", "r", "d"))).first()[0]
        assert 0.85 * healpix.pixel_radius_degrees(order) < far <= healpix.pixel_radius_degrees(order)


def tiles(spark, cells):
    return spark.createDataFrame(cells, "order int, ipix long")


def deepest(cells, order=4):
    return {p * 4 ** (order - o) + i for o, p in cells for i in range(4 ** (order - o))}


@pytest.mark.parametrize("seed", range(4))
def test_merging_keeps_the_area_and_is_final(spark, seed):
    r = random.Random(seed)
    cells = [(o, r.randrange(12 * 4**o)) for o in (1, 2, 3, 4) for _ in range(12)]
    cells += [(4, 4 * 37 + i) for i in range(4)] + [(3, 4 * 5 + i) for i in range(4)] + [(4, 7), (4, 7)]
    merged = [tuple(x) for x in coverage.merge_tiles(tiles(spark, cells)).collect()]
    assert deepest(merged) == deepest(cells)
    # Disjoint, and no four tiles fill their parent.
    assert sum(4 ** (4 - o) for o, _ in merged) == len(deepest(cells))
    full = {}
    for o, p in merged:
        full[(o - 1, p // 4)] = full.get((o - 1, p // 4), 0) + 1
    assert max(full.values()) < 4
    again = {tuple(x) for x in coverage.merge_tiles(tiles(spark, merged)).collect()}
    assert again == set(merged)


def test_whole_sky_is_twelve_tiles(spark):
    every = spark.range(12 * 4**3).select(F.lit(3).alias("order"), F.col("id").alias("ipix"))
    merged = coverage.merge_tiles(every)
    assert {tuple(r) for r in merged.collect()} == {(0, i) for i in range(12)}
    assert coverage.sky_proportion(merged).first()[0] == 1.0 and coverage.tile_count(merged).first()[0] == 12
    assert coverage.merge_tiles(every, coarsest=2).count() == 12 * 16
    assert coverage.merge_tiles(tiles(spark, [(1, 5)]).where("order > 1")).count() == 0


def test_ascii_coverage(spark):
    df = spark.createDataFrame([(1, "1/1 2 4 2/12-14 21 23 25 8/"), (2, "0/3"), (3, "")], "i int, m string")
    found = {(r.i, r.order, r.ipix) for r in coverage.parse_ascii(df, "m").collect()}
    first = {(1, 1, p) for p in (1, 2, 4)} | {(1, 2, p) for p in (12, 13, 14, 21, 23, 25)}
    assert found == first | {(2, 0, 3)}


def test_in_and_near_coverage(spark):
    places = positions(300, 9)
    df = sky(spark, places, "i")
    cells = [(2, 17), (3, 400), (0, 11), (2, 70)]
    area = tiles(spark, cells)
    inside = {r.i for r in coverage.in_coverage(df, area).collect()}
    pixel = {r.i: r.p for r in df.select("i", healpix.pixel("ra", "dec", 4).alias("p")).collect()}
    assert inside == {i for i, p in pixel.items() if p in deepest(cells)} and inside
    near = {r.i for r in coverage.near_coverage(df, "i", area, 3.0).collect()}
    fine = spark.createDataFrame([(p,) for p in deepest(cells, 6)], "p long").withColumn("at", healpix.pixel_centre("p", F.lit(6))).select("at.*").collect()
    surely = {i for i, q in enumerate(places) if min(separation(q, tuple(f)) for f in fine) <= 3.0}
    assert inside | surely <= near


def crowd(n, seed, shift=0.0):
    """A tight cluster of clusters in one search cell, and a few places elsewhere."""
    r = random.Random(seed)
    found = [(50 + shift + r.gauss(0, 10.0 ** -r.randint(1, 2)), 20 + r.gauss(0, 10.0 ** -r.randint(1, 2))) for _ in range(n)]
    return found + [(50 + r.uniform(-3, 3), 20 + r.uniform(-3, 3)) for _ in range(n // 4)] + positions(n // 4, seed)[:-5]


@pytest.mark.parametrize("shift", [0.0, 0.7])
def test_crowded_cells_are_searched_exactly(spark, monkeypatch, shift):
    monkeypatch.setattr(match, "LEAF", 20)
    a, b = crowd(100, 21), crowd(120, 22, shift)
    ta, tb = sky(spark, a, "ia"), sky(spark, b, "ib")
    matcher = match.Sky(1.5 * 3600)
    near = lambda p, others: min((separation(p, q), j) for j, q in enumerate(others))
    one = ids(match.find_pairs(matcher, ta, tb, "ia", "ib", "best1"))
    assert one == {(i, near(p, b)[1]) for i, p in enumerate(a) if near(p, b)[0] <= 1.5}


def test_crowded_points_in_space(spark, monkeypatch):
    monkeypatch.setattr(match, "LEAF", 4)
    r = random.Random(8)
    a, b = [[(r.gauss(0, 0.1), r.gauss(0, 0.1), r.uniform(-3, 3)) for _ in range(100)] for _ in range(2)]
    names = ("x0", "x1", "x2")
    found = ids(match.find_pairs(match.Cartesian(0.5, names, names), table(spark, a, "ia"), table(spark, b, "ib"), "ia", "ib", "best1"))
    near = [min((math.dist(p, q), j) for j, q in enumerate(b)) for p in a]
    assert found == {(i, j) for i, (d, j) in enumerate(near) if d <= 0.5}


def test_crowded_one_to_one(spark, monkeypatch):
    monkeypatch.setattr(match, "PAIRS", 1)
    r = random.Random(12)
    a, b = [[(r.uniform(0, 3),) for _ in range(25)] + [(1.0,)] * n for n in (5, 3)]
    found = match.find_pairs(match.Cartesian(0.5, ("x0",), ("x0",)), table(spark, a, "ia"), table(spark, b, "ib"), "ia", "ib", "best")
    assert ids(found) == greedy(a, b, 0.5, math.dist)


@pytest.fixture
def tables_written(monkeypatch):
    """The intermediate tables that a match writes."""
    names = []

    def counted(module):
        write = module.checkpointed
        monkeypatch.setattr(module, "checkpointed", lambda df: names.append(module.__name__) or write(df))

    for module in (match, graph):
        counted(module)
    return names


def test_chain_of_shrinking_gaps(spark, tables_written):
    """Each pair can only be decided after the next one, 2,000 times in a row."""
    places, at = [], 0.0
    for k in range(4001):
        places.append(at)
        at += 1.0 - k / 8002
    a, b = [[(x,) for x in places[s::2]] for s in (0, 1)]
    found = match.find_pairs(match.Cartesian(1.0, ("x0",), ("x0",)), table(spark, a, "ia"), table(spark, b, "ib"), "ia", "ib", "best")
    # The narrowest gap is the last one, so all are paired from the end; the first position stays alone.
    assert ids(found) == {(i + 1, i) for i in range(2000)}
    assert len(tables_written) <= 15


@pytest.mark.parametrize("limit", [2, 8, 1000])
def test_large_components_fall_apart(spark, monkeypatch, limit):
    monkeypatch.setattr(match, "COMPONENT", limit)
    monkeypatch.setattr(match, "RANKS", 3)
    r = random.Random(limit)
    a, b = [[(r.choice([r.uniform(0, 4), 1.0, 2.25]), r.uniform(0, 0.3)) for _ in range(60)] + [(1.0, 0.0)] * n for n in (20, 33)]
    names = ("x0", "x1")
    found = match.find_pairs(match.Cartesian(0.25, names, names), table(spark, a, "ia"), table(spark, b, "ib"), "ia", "ib", "best")
    assert ids(found) == greedy(a, b, 0.25, math.dist)


def test_ellipsoids_in_a_crowd(spark, monkeypatch):
    monkeypatch.setattr(match, "PAIRS", 1)
    r = random.Random(5)
    a, b = [[(r.gauss(0, 0.4), r.gauss(0, 0.2)) for _ in range(80)] for _ in range(2)]
    names = ("x0", "x1")
    found = match.find_pairs(match.Anisotropic((1.0, 0.5), names, names), table(spark, a, "ia"), table(spark, b, "ib"), "ia", "ib", "best")
    scaled = lambda p, q: math.hypot(p[0] - q[0], (p[1] - q[1]) / 0.5)
    assert ids(found) == greedy(a, b, 1.0, scaled)
    exact = {(x[0], x[1]): x[2] for x in found.collect()}
    assert all(abs(s - scaled(a[i], b[j])) < 1e-12 for (i, j), s in exact.items())


def test_copies_over_many_tasks(spark):
    """200,000 rows at one place of either table: ranks meet in blocks, each in its own task."""
    a, b = [spark.range(n).select(F.col("id").alias(key), F.lit(1.0).alias("x0")) for n, key in ((200_000, "ia"), (150_000, "ib"))]
    found = match.find_pairs(match.Cartesian(1.0, ("x0",), ("x0",)), a, b, "ia", "ib", "best")
    assert found.where(F.col(match.ID1) == F.col(match.ID2)).count() == found.count() == 150_000


@pytest.mark.parametrize("chunk", [3, 1000])
def test_contracted_links(spark, monkeypatch, chunk):
    monkeypatch.setattr(graph, "CHUNK", chunk)
    r = random.Random(chunk)
    links = [(r.randrange(300), r.randrange(300)) for _ in range(200)] + [(1000 + k, 1001 + k) for k in range(200)]
    frame = spark.createDataFrame(links, "u long, v long").coalesce(3)
    whole = {tuple(x) for x in graph.connected_components(frame).collect()}
    short = graph.contracted(frame)
    assert {tuple(x) for x in graph.connected_components(short).collect()} == whole
    assert all(x.u > x.v for x in short.collect())


def clusters(seed, kinds, n):
    """Crowds at distances around the reach, some of one table only."""
    r = random.Random(seed)
    centres = [(r.uniform(0, 9), r.uniform(0, 3), r.choice(kinds), r.choice([0.02, 0.1, 0.3])) for _ in range(14)]
    out = {k: [] for k in range(max(map(max, kinds)) + 1)}
    for _ in range(n):
        x, y, owners, spread = r.choice(centres)
        out[r.choice(owners)].append((x + r.uniform(-spread, spread), y + r.uniform(-spread, spread)))
    return out


@pytest.mark.parametrize("seed", range(4))
def test_crowds_within_one_table(spark, seed):
    places = clusters(seed, [(0,)], 260)[0]
    found = multimatch.within_groups(table(spark, places, "id"), "id", match.Cartesian(0.8, ("x0", "x1"), ("x0", "x1")), ("x0", "x1"))
    links = [(i, j) for i, j in itertools.combinations(range(len(places)), 2) if math.dist(places[i], places[j]) <= 0.8]
    groups = Counter(components(links).values())
    assert {(r.id, r.group, r["size"]) for r in found.collect()} == {(i, g, groups[g]) for i, g in components(links).items()}


@pytest.mark.parametrize("seed", range(4))
def test_crowds_of_several_tables(spark, seed):
    places = clusters(seed, [(0,), (1,), (0, 1), (0, 1, 2), (2,)], 300)
    names = ("x0", "x1")
    inputs = [multimatch.Input(table(spark, places[k], "id").withColumn("x0", F.col("x0") * 1.0), "id", names) for k in range(3)]
    found = multimatch.match_groups(inputs, match.Cartesian(0.7, names, names), fixcols="all", suffixes=["_0", "_1", "_2"])
    nodes = [(k, i) for k in range(3) for i in range(len(places[k]))]
    at = lambda node: places[node[0]][node[1]]
    links = [(u, v) for u, v in itertools.combinations(nodes, 2) if u[0] != v[0] and math.dist(at(u), at(v)) <= 0.7]
    groups = {}
    for node, g in components(links).items():
        groups.setdefault(g, []).append(node)
    firsts = {tuple(min((i for t, i in g if t == k), default=None) for k in range(3)) for g in groups.values()}
    assert {tuple(r[f"id_{k}"] for k in range(3)) for r in found.collect()} == firsts


def test_links_of_a_crowd_are_linear(spark):
    """20,000 positions inside one radius."""
    r = random.Random(3)
    places = [(r.uniform(0, 0.7), r.uniform(0, 0.7)) for _ in range(20_000)]
    matcher = match.Cartesian(1.0, ("x0", "x1"), ("x0", "x1"))
    rows = table(spark, places, "id")
    given = multimatch._positions([multimatch.Input(rows, "id", ("x0", "x1"))], matcher)
    assert multimatch._Links(matcher, given, True).first().count() < 3 * len(places)
    found = multimatch.within_groups(rows, "id", matcher, ("x0", "x1"))
    assert found.where("group = 0 and size = 20000").count() == len(places)
