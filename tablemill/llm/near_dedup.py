"""Near-duplicate groups by MinHash with odd sketches."""

import math
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..operators.multimatch import connected_components
from ..session import written
from . import flat

#: Words of a shingle, and the least similarity of a link as a fraction, unless a caller asks for others.
WIDTH, ALIKE = 3, (85, 100)
#: Probability at most with which a link of the least similarity is in no common band, and with which it is above the
#: limit of its sketches; more alike pairs are missed less.
MISS = 1e-10
#: Bands have up to so many rows of MinHash samples, fewer where that would take more than so many bands.
MOST_ROWS, MANY_BANDS = 4, 64
#: Bits of an odd sketch. A sample that differs flips two bits at most, so the number of differing bits is at most twice
#: the number of differing samples, whatever the number of samples.
SKETCH_BITS = 512
#: Sets of a group that are compared with one another in one task, and shingles looked at side by side there. Sketches
#: are compared so many blocks at a time.
BLOCK, COLUMNS, SIDE_BY_SIDE = 512, 4096, 8


@dataclass(frozen=True)
class Likeness:
    """What a link is, and the bands and sketch limit that find it: bands of rows of samples, and the most bits in which
    the sketches of a link differ."""

    width: int
    alike: tuple[int, int]
    bands: int
    rows: int
    most_different: int

    @property
    def samples(self) -> int:
        return self.bands * self.rows


@lru_cache
def likeness(width: int = WIDTH, alike: tuple[int, int] = ALIKE) -> Likeness:
    """Shingles of ``width`` words and a similarity of at least ``alike``, with bands and limit by MISS."""
    if width < 1 or not 0 < alike[0] <= alike[1]:
        raise ValueError("shingles have a word or more, and the least similarity is above 0 and at most 1")
    s = alike[0] / alike[1]
    for rows in range(MOST_ROWS, 0, -1):
        bands = math.ceil(math.log(MISS) / math.log1p(-(s**rows))) if s < 1 else 1
        if bands <= MANY_BANDS:
            break
    most, beyond = bands * rows, 0.0
    while s < 1 and most > 0:
        # The probability that exactly ``most`` of all samples differ.
        n = bands * rows
        ways = math.lgamma(n + 1) - math.lgamma(most + 1) - math.lgamma(n - most + 1)
        beyond += math.exp(ways + most * math.log(1 - s) + (n - most) * math.log(s))
        if beyond > MISS:
            break
        most -= 1
    return Likeness(width, alike, bands, rows, 2 * most if s < 1 else 0)


@lru_cache
def _hashes(samples: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(5)
    factors = rng.integers(1, 2**32 - 1, samples, dtype=np.uint32) | np.uint32(1)
    return factors, rng.integers(0, 2**32 - 1, samples, dtype=np.uint32)


def shingles(column, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct 64-bit shingle hashes, offsets) of each text; a text of fewer words is one shingle.

    Words are runs without white space, with A-Z in lower case. The hashes depend on the words alone.
    """
    data, offsets = flat.flat(column)
    hashes, _, _, places = flat.words(flat.lowered(data), offsets)
    count = np.diff(places)
    n = np.where(count >= width, count - width + 1, np.minimum(count, 1))
    at = flat._each(places[:-1], n)
    size = np.repeat(np.minimum(count, width), n)
    grams = flat.mixed(flat.Spans(hashes).hash(at, at + size) + size.astype(np.uint64))
    text = np.repeat(np.arange(len(count)), n)
    order = np.lexsort((grams, text))
    grams, text = grams[order], text[order]
    new = np.r_[True, (grams[1:] != grams[:-1]) | (text[1:] != text[:-1])] if len(grams) else np.zeros(0, bool)
    return grams[new], np.r_[0, np.cumsum(np.bincount(text[new], minlength=len(count)))]


def sketches(grams: np.ndarray, offsets: np.ndarray, like: Likeness) -> tuple[np.ndarray, np.ndarray]:
    """(band keys, odd sketches) of the non-empty sets; a sketch is SKETCH_BITS bits as bytes."""
    short = (grams >> np.uint64(32)).astype(np.uint32)
    factors, masks = _hashes(like.samples)
    samples = np.empty((like.samples, len(offsets) - 1), np.uint32)
    step = 1 << 16
    cuts = np.searchsorted(offsets, np.arange(step, int(offsets[-1]), step))
    cuts = np.unique(np.r_[0, cuts, len(offsets) - 1])
    for a, b in zip(cuts[:-1], cuts[1:]):
        part, starts = short[offsets[a] : offsets[b]], offsets[a:b] - offsets[a]
        for k in range(like.samples):
            samples[k, a:b] = np.minimum.reduceat((part ^ masks[k]) * factors[k], starts)
    seat = np.arange(like.samples, dtype=np.uint64)[:, None] << np.uint64(32)
    named = flat.mixed(seat | samples)
    keys = np.zeros((like.bands, len(offsets) - 1), np.uint64)
    for r in range(like.rows):
        keys = flat.mixed(keys * np.uint64(0x9E3779B97F4A7C15) + named[r :: like.rows])
    # Folding by parity: the bit of a sample is flipped, so samples that share a bit cancel out in pairs.
    bits = np.zeros((len(offsets) - 1, SKETCH_BITS), np.uint8)
    column = (named % np.uint64(SKETCH_BITS)).astype(np.int64)
    for k in range(like.samples):
        bits[np.arange(len(bits)), column[k]] ^= 1
    return keys.T, np.packbits(bits, axis=1)


def _sets(docs: DataFrame, id_col: str, text_col: str, like: Likeness) -> DataFrame:
    """(doc_id, n, sign1, sign2, bands, sketch): the signature names the set, so equal sets need no further look."""

    def scan(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 2000):
                part = batch.slice(a, 2000)
                grams, offsets = shingles(part.column(1), like.width)
                n = np.diff(offsets)
                sums = [np.zeros(len(grams) + 1, np.uint64) for _ in range(2)]
                np.cumsum(flat.mixed(grams), out=sums[0][1:])
                np.cumsum(flat.mixed(grams ^ np.uint64(0x5851F42D4C957F2D)), out=sums[1][1:])
                sign = [flat.mixed(s[offsets[1:]] - s[offsets[:-1]]).view(np.int64) for s in sums]
                full = n > 0
                bands, sketch = np.zeros((len(n), like.bands), np.uint64), [None] * len(n)
                if full.any():
                    bands[full], packed = sketches(grams, np.r_[offsets[:-1][full], offsets[-1]], like)
                    for i, s in zip(np.flatnonzero(full), packed):
                        sketch[i] = s.tobytes()
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * like.bands), pa.array(bands.view(np.int64).ravel()))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(n), pa.array(sign[0]), pa.array(sign[1]), lists, pa.array(sketch, pa.binary())],
                    names=["doc_id", "n", "sign1", "sign2", "bands", "sketch"],
                )

    source = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    return source.mapInArrow(scan, "doc_id long, n long, sign1 long, sign2 long, bands array<long>, sketch binary")


def _confirmed(pairs: DataFrame, texts: DataFrame, like: Likeness) -> DataFrame:
    """The pairs (a, b) whose full shingle sets are alike."""
    a, b = (texts.select(F.col("doc_id").alias(f"id_{x}"), F.col("text").alias(f"text_{x}")) for x in "ab")
    both = pairs.join(a, F.col("a") == F.col("id_a")).join(b, F.col("b") == F.col("id_b")).select("a", "b", "text_a", "text_b")

    def check(batches):
        for whole in batches:
            for k in range(0, whole.num_rows, 500):
                batch = whole.slice(k, 500)
                alike = np.zeros(batch.num_rows, bool)
                (ga, oa), (gb, ob) = (shingles(batch.column(c), like.width) for c in (2, 3))
                for i in range(batch.num_rows):
                    x, y = ga[oa[i] : oa[i + 1]], gb[ob[i] : ob[i + 1]]
                    common = len(np.intersect1d(x, y, assume_unique=True))
                    alike[i] = common * like.alike[1] >= like.alike[0] * (len(x) + len(y) - common) and common > 0
                yield batch.select(["a", "b"]).filter(pa.array(alike))

    return both.mapInArrow(check, "a long, b long")


def _common(grams: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The number of shingles that each set of ``left`` shares with each of ``right``, as a product of 0/1 matrices over
    the shingles that occur in several sets, some columns at a time."""
    row = np.repeat(np.arange(len(grams)), [len(g) for g in grams])
    _, column, count = np.unique(np.concatenate(grams), return_inverse=True, return_counts=True)
    several = count[column] > 1
    row, column = row[several], (np.cumsum(count > 1) - 1)[column[several]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    total = np.zeros((len(left), len(right)), np.int64)
    for a in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        low, high = np.searchsorted(column, [a, a + COLUMNS])
        holds = np.zeros((len(grams), min(COLUMNS, int(column[-1]) + 1 - a)), np.float32)
        holds[row[low:high], column[low:high] - a] = 1
        total += (holds[left] @ holds[right].T).astype(np.int64)
    return total


def _near(table: pa.Table, left: np.ndarray, right: np.ndarray, like: Likeness) -> np.ndarray:
    """Which sets of ``left`` may be linked with which of ``right``, in other components: by the sizes of the sets, which
    must be as near as the similarity itself, and by their sketches."""
    component, n = (table.column(c).to_numpy() for c in ("component", "n"))
    near = component[left][:, None] != component[right][None, :]
    bits = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint64).reshape(table.num_rows, -1)
    for row, i in zip(near, left):
        row &= np.minimum(n[right], n[i]) * like.alike[1] >= like.alike[0] * np.maximum(n[right], n[i])
        at = np.flatnonzero(row)
        row[at] = np.bitwise_count(bits[right[at]] ^ bits[i]).sum(1) <= like.most_different
    return near


def _candidates(table: pa.Table, like: Likeness) -> pa.Table:
    """The sets that two blocks must compare in full, for each two blocks of two runs of SIDE_BY_SIDE."""
    own = table.column("own").to_numpy()
    run = own // SIDE_BY_SIDE
    x, y = table.column("x")[0].as_py(), table.column("y")[0].as_py()
    left, right = np.flatnonzero(run == x), np.flatnonzero(run == y)
    near = _near(table, left, right, like)
    parts = []
    for a in np.unique(own[left]):
        for b in np.unique(own[right]):
            if a <= b:
                here = near[np.ix_(own[left] == a, own[right] == b)]
                wanted = np.union1d(left[own[left] == a][here.any(1)], right[own[right] == b][here.any(0)])
                parts.append((np.full(len(wanted), a), np.full(len(wanted), b), wanted))
    a, b, wanted = (np.concatenate([part[i] for part in parts] or [np.zeros(0, np.int64)]) for i in range(3))
    kept = table.take(pa.array(wanted, pa.int64())).select(["grp", "own", "id", "component", "n", "sketch"])
    return kept.append_column("x", pa.array(a, pa.int32())).append_column("y", pa.array(b, pa.int32()))


def _linked(table: pa.Table, like: Likeness) -> pa.Table:
    """Links between components in two blocks of a group, on the full sets: as many as join all that is linked there."""
    own, ids, component = (table.column(c).to_numpy() for c in ("own", "id", "component"))
    x, y = table.column("x")[0].as_py(), table.column("y")[0].as_py()
    left, right = np.flatnonzero(own == x), np.flatnonzero(own == y)
    near = _near(table, left, right, like)
    found = []
    if near.any():
        grams = [np.frombuffer(g, np.uint64) for g in table.column("grams").to_pylist()]
        size = np.array([len(g) for g in grams])
        common = _common(grams, left, right)
        union = size[left][:, None] + size[right][None, :] - common
        root: dict = {}

        def find(c):
            while root.get(c, c) != c:
                c = root[c]
            return c

        for i, j in zip(*np.nonzero(near & (common * like.alike[1] >= like.alike[0] * union))):
            a, b = find(component[left[i]]), find(component[right[j]])
            if a != b:
                root[max(a, b)] = min(a, b)
                found.append((int(ids[left[i]]), int(ids[right[j]])))
    pairs = np.array(found, np.int64).reshape(-1, 2)
    return pa.table({"a": pairs[:, 0], "b": pairs[:, 1]})


def _across(named: DataFrame, bits: DataFrame, texts: DataFrame, like: Likeness) -> DataFrame:
    """Links (a, b) between different components of (band, id, component), on the full sets.

    Bands that hold several components are open. Sets that hang together by open bands form a group; whatever pair
    shares an open band is in one group, once. The sets of a group come in blocks. First only sizes and sketches meet, eight
    blocks with eight in a task; then the full sets go where a set has a possible partner, and a task compares
    two blocks as matrices and gives a spanning set of links. So neither a group in one task nor all its pairs are ever
    made, and no full set is sent to blocks without a possible partner.
    """
    sizes = named.groupBy("band").agg(F.min("id").alias("hub"), F.min("component").alias("low"), F.max("component").alias("high"))
    open_ = sizes.where("low < high").select(F.col("band").alias("open_band"), "hub")
    stars = named.join(open_, named["band"] == open_["open_band"]).select("hub", "id").where("hub <> id").distinct()
    group = written(connected_components(stars), "group").select(F.col("node").alias("member"), F.col("component").alias("grp"))
    own = named.select("id", "component").distinct()
    grouped = group.join(own, group["member"] == own["id"]).select("grp", "id", "component")

    blocks = grouped.groupBy("grp").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")).withColumnRenamed("grp", "of")
    blocked = grouped.join(blocks, grouped["grp"] == blocks["of"]).join(bits, grouped["id"] == bits["sketch_id"])
    blocked = blocked.withColumn("own", F.pmod(F.xxhash64("id"), "blocks").cast("int"))
    # Every run of blocks meets every other one once, and itself.
    run = F.floor(F.col("own") / SIDE_BY_SIDE).cast("int")
    last = F.floor((F.col("blocks") - 1) / SIDE_BY_SIDE).cast("int")
    meets = blocked.withColumn("other", F.explode(F.sequence(F.lit(0), last))).select(
        "grp", F.least(run, "other").alias("x"), F.greatest(run, "other").alias("y"), "own", "id", "component", "n", "sketch"
    )
    schema = "grp long, own int, id long, component long, n long, sketch binary, x int, y int"
    wanted = written(meets.groupBy("grp", "x", "y").applyInArrow(lambda table: _candidates(table, like), schema), "candidates")

    def sets(batches):
        for whole in batches:
            for k in range(0, whole.num_rows, 1000):
                batch = whole.slice(k, 1000)
                grams, offsets = shingles(batch.column(1), like.width)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array([grams[a:b].tobytes() for a, b in zip(offsets[:-1], offsets[1:])], pa.binary())], names=["gram_id", "grams"]
                )

    ids = wanted.select(F.col("id").alias("member")).distinct()
    full = texts.join(ids, texts["doc_id"] == ids["member"], "left_semi").select("doc_id", "text").mapInArrow(sets, "gram_id long, grams binary")
    pairs = wanted.join(full, wanted["id"] == full["gram_id"]).drop("gram_id")
    return pairs.groupBy("grp", "x", "y").applyInArrow(lambda table: _linked(table, like), "a long, b long")


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, alike: tuple[int, int] = ALIKE) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept (doc_id = component_id). Other columns are ignored.

    Documents are linked if the sets of their shingles of ``width`` words have a similarity of at least ``alike``: for
    the defaults, if 100 * intersection >= 85 * union of their 3-word shingles. Equal sets are one from the start, stood for by their smallest id. In each band of MinHash samples, every set is first
    compared with the smallest id there: one pair per set and band, whatever the size of a band. Components of the
    confirmed links need no more comparing inside. Sets that share bands which still hold several components are
    compared in blocks, first by their sizes and odd sketches and then on the full sets, so that no link is lost. Links are followed
    to components.

    Texts without words (null, empty, white space) have an empty set and are linked with nothing. Rows without id come
    back with a null component and are not kept; rows that repeat an id with the same text share their component.
    """
    like = likeness(width, tuple(alike))
    sets = written(_sets(docs, id_col, text_col, like), "sets")
    full = sets.where("n > 0 and doc_id is not null")
    heads = full.groupBy("sign1", "sign2").agg(F.min("doc_id").alias("id"))
    s, h = full.alias("s"), heads.alias("h")
    heads = written(
        h.join(s, (F.col("s.doc_id") == F.col("h.id")) & (F.col("s.sign1") == F.col("h.sign1")) & (F.col("s.sign2") == F.col("h.sign2")))
        .select("id", "h.sign1", "h.sign2", "n", "bands", "sketch").dropDuplicates(["id", "sign1", "sign2"]), "heads",
    )
    # A band key alone names the band: keys of different bands are hashed with their place.
    rows = heads.select("id", F.posexplode("bands").alias("no", "key")).select("id", F.xxhash64("no", "key").alias("band"))
    hubs = rows.groupBy("band").agg(F.min("id").alias("hub"), F.count("*").alias("m")).where("m > 1")
    hubs = hubs.select(F.col("band").alias("hub_band"), "hub")
    members = written(rows.join(hubs, rows["band"] == hubs["hub_band"]).select("band", "id", "hub"), "members")
    texts = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    wanted = members.select("id").distinct()
    # One text for each set; a repeated row would only repeat a pair.
    texts = written(texts.join(wanted.hint("shuffle_hash"), texts["doc_id"] == wanted["id"], "left_semi"), "texts")

    bits = heads.select(F.col("id").alias("sketch_id"), "n", "sketch")

    def near(pairs: DataFrame) -> DataFrame:
        a, b = (bits.select(F.col("sketch_id").alias(f"k_{x}"), F.col("sketch").alias(f"sketch_{x}")) for x in "ab")
        both = pairs.join(a, F.col("a") == F.col("k_a")).join(b, F.col("b") == F.col("k_b"))

        def check(batches):
            for batch in batches:
                x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint64).reshape(batch.num_rows, -1) for c in (2, 3))
                yield batch.select(["a", "b"]).filter(pa.array(np.bitwise_count(x ^ y).sum(1) <= like.most_different))

        return both.select("a", "b", "sketch_a", "sketch_b").mapInArrow(check, "a long, b long")

    stars = members.where("id <> hub").select(F.col("hub").alias("a"), F.col("id").alias("b")).distinct()
    links = written(_confirmed(near(stars), texts, like), "links")
    component = written(connected_components(links), "component")
    named = members.join(component, members["id"] == component["node"], "left")
    named = written(named.select("band", "id", F.coalesce("component", "id").alias("component")), "named")
    more = written(_across(named, bits, texts, like), "links")
    if not more.isEmpty():
        component = written(connected_components(links.unionByName(more)), "component")

    classes = heads.join(component, heads["id"] == component["node"], "left").select(
        F.col("sign1").alias("c1"), F.col("sign2").alias("c2"), F.coalesce("component", "id").alias("component")
    )
    classes = written(classes.groupBy("c1", "c2").agg(F.min("component").alias("component")), "classes")
    out = sets.select("doc_id", "n", "sign1", "sign2")
    out = out.join(classes, (out["sign1"] == classes["c1"]) & (out["sign2"] == classes["c2"]) & (out["n"] > 0), "left")
    name = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), name.alias("component_id"), F.coalesce(F.col("doc_id") == name, F.lit(False)).alias("kept"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, alike: tuple[int, int] = ALIKE) -> DataFrame:
    """The rows of ``docs`` that stand for their group, with all their columns: one row of each group of linked sets, the
    one with the smallest id, a row without id only if none there has one.

    Each row counts by its own text. Of rows that repeat id and text one stays. Rows without words are linked with
    nothing: one of each id stays, and all of those without id.
    """
    # Ids may be missing or repeat, so rows are numbered. The table is written: a number must be the same in all scans.
    row = F.struct(*[docs[c] for c in docs.columns])
    text = docs[text_col].cast("string")
    rows = written(docs.select(row.alias("row"), docs[id_col].cast("long").alias("id"), F.xxhash64(text).alias("hash"), F.monotonically_increasing_id().alias("no")), "rows")
    groups = near_groups(rows.select("no", F.col("row").getField(text_col).alias("text")), "no", "text", width, alike)
    groups = groups.select(F.col("doc_id").alias("group_no"), "n_shingles", "component_id")
    group = F.when(F.col("n_shingles") > 0, F.struct(F.lit(0).alias("kind"), F.col("component_id").alias("name")))
    group = group.when(F.col("id").isNotNull(), F.struct(F.lit(1).alias("kind"), F.col("id").alias("name")))
    group = group.otherwise(F.struct(F.lit(2).alias("kind"), F.col("no").alias("name")))
    # The hash of the text decides between rows without id, whatever their numbers.
    first = F.min(F.struct(F.col("id").isNull().alias("last"), "id", "hash", "no")).alias("first")
    named = rows.select("id", "hash", "no").join(groups, F.col("no") == F.col("group_no"))
    kept = named.groupBy(group.alias("group")).agg(first).select(F.col("first.no").alias("kept_no"))
    return rows.join(kept.hint("shuffle_hash"), rows["no"] == kept["kept_no"], "left_semi").select("row.*")
