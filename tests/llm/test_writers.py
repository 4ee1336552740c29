"""Shards, mixtures and archives."""

import random
import zlib

import pytest
from pyspark.sql import functions as F

from tablemill.llm import mixing, sharding, warc
from tablemill.session import new_folder


def test_shards_whole_table(spark, folder, documents):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    got = sharding.shard_digest(docs).collect()
    assert {(r.doc_id, r.size, r.text_crc32) for r in got} == {(i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in documents}
    slots = {}
    for r in got:
        slots.setdefault(r.shard, []).append(r.slot)
    assert sorted(slots) == list(range(24)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    again = sharding.shard_digest(docs.repartition(7)).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))
    # Neither shard nor slot follows the ids.
    order = [r.doc_id for r in sorted(got, key=lambda r: (r.shard, r.slot))]
    up = sum(a < b for a, b in zip(order, order[1:])) / len(order)
    assert 0.4 < up < 0.6


def test_shards_edges(odd):
    assert sharding.shard_digest(odd([])).collect() == []
    rows = [(None, None), (None, None), (1, "a"), (1, "a"), (2, ""), (3, "x" * 100_000)]
    got = sharding.shard_digest(odd(rows), shards=4).collect()
    assert len(got) == 6 and sorted((r.shard, r.slot) for r in got) == [(0, 0), (0, 1), (1, 0), (2, 0), (2, 1), (3, 0)]
    few = sharding.shard_digest(odd(rows[:2])).collect()
    assert sorted(r.slot for r in few) == [0, 0]


def test_equal_rows_spread_over_buckets(spark, odd, monkeypatch):
    monkeypatch.setattr(sharding, "EQUAL_BYTES", 1_000)
    rows = odd([(None, None)] * 3000 + [(i, f"text {i}") for i in range(1000)])
    sizes = [n for _, n in sharding._with_buckets(rows, "doc_id", "text", 17, 8).groupBy("bucket").count().collect()]
    assert len(sizes) == 8 and sum(sizes) == 4000 and max(sizes) < 700
    got = sharding.shard_digest(rows, shards=5).collect()
    slots = sorted((r.shard, r.slot) for r in got)
    assert slots == [(s, k) for s in range(5) for k in range(800)]
    assert sorted(r.doc_id for r in got if r.doc_id is not None) == list(range(1000))


def test_shards_keep_rows(spark, odd):
    rows = odd([(i, f"text {i}") for i in range(50)])
    stored = sharding.write_shards(rows, new_folder(spark, "t"), 3, seed=1).select("record.*")
    assert stored.columns == rows.columns and sorted(map(str, stored.collect())) == sorted(map(str, rows.collect()))


def fair(sizes, weights=(1, 2, 3), most=3):
    """Targets by sharing out and sharing anew, as the contract says."""
    total, target, done = sum(sizes), [0.0] * len(sizes), set()
    w = [weights[i % len(weights)] for i in range(len(sizes))]
    while len(done) < len(sizes):
        left = total - sum(most * sizes[i] for i in done)
        target = [most * s if i in done else left * w[i] / sum(w[k] for k in range(len(w)) if k not in done) for i, s in enumerate(sizes)]
        over = {i for i in range(len(sizes)) if i not in done and target[i] > most * sizes[i]}
        if not over:
            break
        done |= over
    return [most * s if i in done else t for i, (s, t) in enumerate(zip(sizes, target))]


def check_mix(df, sources):
    rows = df.collect()
    size = {s: sum(r["size"] for r in rows if sources[r.doc_id] == s) for s in set(sources.values())}
    order = sorted(size, key=lambda s: (s is None, (s or "").encode()))
    target = dict(zip(order, fair([size[s] for s in order])))
    for r in rows:
        s = sources[r.doc_id]
        assert r.source_size == size[s] and r.target == pytest.approx(target[s], rel=1e-9, abs=1e-9) and 0 <= r.copies <= 3
    for s in order:
        mine = [r for r in rows if sources[r.doc_id] == s]
        gap = target[s] - sum(r["size"] * r.copies for r in mine)
        certain = min((r.copies for r in mine if r["size"]), default=0)
        # Nothing that is left would still fit.
        assert gap > -1e-6 and all(r["size"] > gap for r in mine if r["size"] and r.copies == certain and gap > 1e-6)
        assert max((r.copies for r in mine if r["size"]), default=0) - min((r.copies for r in mine if r["size"]), default=0) <= 1
    return sorted((r.doc_id, r.copies) for r in rows)


def test_mix_whole_table(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    sources = {r.doc_id: r.source for r in docs.select("doc_id", "source").collect()}
    first = check_mix(mixing.copies(docs), sources)
    assert first == check_mix(mixing.copies(docs.repartition(5)), sources)
    counted = docs.join(spark.createDataFrame(first, "k long, n int"), F.col("doc_id") == F.col("k")).agg(F.sum("n")).first()[0]
    assert mixing.mix(docs).count() == counted and mixing.mix(docs).columns == docs.columns


def test_mix_uneven_sources(spark):
    rng = random.Random(2)
    rows = [(i, " w" * rng.randint(0, 60), rng.choice(["a"] * 30 + ["b", "c", "é", None])) for i in range(600)] + [(900, None, "zero"), (901, "", "zero")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    check_mix(mixing.copies(docs), {i: s for i, _, s in rows})


@pytest.mark.parametrize("seed", range(3))
def test_mix_with_one_long_document(spark, seed):
    rng = random.Random(seed)
    rows = [(i, " w" * rng.randint(1, 5), f"s{i % 4}") for i in range(1600)] + [(2000 + k, " w" * 1500, f"s{k}") for k in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.copies(docs, seed=seed)
    check_mix(got, {i: s for i, _, s in rows})
    taken = {r.target: r.taken for r in got.groupBy("source_size", "target").agg(F.sum(F.col("size") * F.col("copies")).alias("taken")).collect()}
    assert all(abs(t - g) < 1 for g, t in taken.items())


def test_mix_prefers_long_documents(spark):
    """Inclusion odds are in proportion to the words."""
    docs = spark.range(6000).select(F.col("id").alias("doc_id"), F.repeat(F.lit(" w"), (F.col("id") % 2 * 9 + 1).cast("int")).alias("text"), F.when(F.col("id") < 3000, "x").otherwise("y").alias("source"))
    got = mixing.copies(docs, weights=(1, 5)).where("source_size * 0.4 > target").groupBy("size").agg(F.avg("copies").alias("p")).collect()
    odds = {r["size"]: r.p / (1 - r.p) for r in got}
    assert 7 < odds[10] / odds[1] < 13


def test_mix_decides_for_each_of_equal_rows(spark):
    rows = [(None, "same words here", "a", k) for k in range(300)] + [(5, "x y", "a", 300)] * 40 + [(k, "w " * 7, "b", k) for k in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, row long")
    decided = mixing.copies(docs)
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    size = F.col("size") * F.col("copies")
    assert mixed.agg(F.sum(mixing.words(F.col("text")))).first()[0] == decided.agg(F.sum(size)).first()[0]
    written_docs = mixing.written(docs.repartition(3), "t")
    again = mixing.mix(written_docs)
    assert again.columns == docs.columns and again.agg(F.sum(mixing.words(F.col("text")))).first()[0] == decided.agg(F.sum(size)).first()[0]
    per_row = decided.select("row").distinct().count()
    assert per_row == len(rows)


def test_mix_shares_evenly(spark):
    # Of many equal documents, a fraction is taken that follows the target and not the order of ids.
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("a b c").alias("text"), F.when(F.col("id") < 2000, "x").otherwise("y").alias("source"))
    got = {r.doc_id: r.copies for r in mixing.copies(docs, weights=(1, 1)).collect()}
    low, high = (sum(got[i] for i in part) for part in (range(1000), range(1000, 2000)))
    assert low + high == 1500 and 650 < low < 850 and sum(got[i] for i in range(2000, 3000)) == 1500


def test_mix_edges(spark, odd):
    assert mixing.copies(odd([])).collect() == []
    got = mixing.copies(odd([(None, None), (1, "a b"), (1, "a b"), (2, "")])).collect()
    assert sum(r["size"] * r.copies for r in got) == 4 and {r.target for r in got} == {4.0}
    assert mixing.copies(odd([(1, None)])).first().target == 0.0


def archive(tmp_path, payloads, level=0):
    """An archive of records whose compressed form holds the gzip magic."""
    members = []
    for i, p in enumerate(payloads):
        http = b"HTTP/1.1 200 OK\r\nContent-Length: %d\r\n\r\n" % len(p) + p
        head = b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:%d>\r\nContent-Type: application/http\r\nContent-Length: %d\r\n\r\n"
        packer = zlib.compressobj(level, zlib.DEFLATED, 31)
        members.append(packer.compress(head % (i, len(http)) + http + b"\r\n\r\n") + packer.flush())
    path = tmp_path / "archive.warc"
    path.write_bytes(b"".join(members))
    return str(path)


@pytest.mark.parametrize("block", [97, 1000, 1 << 20])
def test_false_magic_across_ranges(spark, tmp_path, block):
    rng = random.Random(7)
    payloads = [b"".join(rng.choice([warc.MAGIC, b"\x1f\x8b", b"x" * 30, b"\r\n\r\n", bytes([rng.randrange(256)]), warc.MAGIC + b"\x00" * 7]) for _ in range(rng.randint(0, 80))) for _ in range(30)]
    path, before = archive(tmp_path, payloads), spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(block))
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        got = warc.read_archives(spark, path).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert {r.page_id: bytes(r.payload) for r in got} == dict(enumerate(payloads)) and len(got) == 30


def test_round_trip_edges(spark):
    long = "ü" * 20_000_000  # a size with a top byte other than 0
    same = "<p>" + "y" * 200
    rows = [(1, "http://a/ b\r\nc", None, "x"), (2, None, "", "x"), (3, "u", "short", "x"), (4, "u", "short", "x"), (9, "u", same, "x"), (7, "u", same, "x"), (7, "u", same, "x"),
            (5, "u", long, "x"), (None, "u", same, "x"), (6, "u", same[:100], "x"), (8, "u", same[:99], "x"), (10, "u", same[:99], "x"), (11, "u", same[:100], "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest string")
    got = warc.round_trip(pages).collect()
    import hashlib

    want = []
    for i, _, html, _ in rows:
        data = (html or "").encode()
        first = {same: 7, same[:100]: 6}.get(html)
        revisit = first is not None and i is not None and i > first
        want.append((i or 0, len(data), hashlib.sha256(data).hexdigest(), "revisit" if revisit else "response", first if revisit else 0))
    assert sorted((r.page_id or 0, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to or 0) for r in got) == sorted(want)
    assert {r.url for r in got if r.page_id == 1} == {"http://a/%20b%0D%0Ac"}
    assert warc.round_trip(pages.limit(0)).collect() == []


def test_archives_are_gzip(spark, tmp_path):
    import glob
    import gzip

    pages = spark.createDataFrame([(i, "u", f"<p>{i}") for i in range(20)], "page_id long, url string, html string")
    warc.write_archives(warc.marked(pages.coalesce(1)), str(tmp_path / "out"))
    (file,) = glob.glob(str(tmp_path / "out" / "part-*"))
    text = gzip.decompress(open(file, "rb").read())
    assert text.count(b"WARC/1.1\r\n") == 20 and text.count(b"WARC-Type: response") == 20


def test_archives_named_as_streams(spark, tmp_path):
    pages = spark.createDataFrame([(k, f"http://x/{k}", "page " * k) for k in range(20)], "page_id long, url string, html string")
    warc.write_archives(warc.marked(pages.coalesce(1)), str(tmp_path / "out"))
    data = b"".join(f.read_bytes() for f in sorted((tmp_path / "out").glob("part-*")))
    for name in ("x.warc", "x.warc.gz", "x.warc.bz2"):
        (tmp_path / name).write_bytes(data)
    split, whole = (sorted(warc.read_archives(spark, str(tmp_path / n)).collect(), key=str) for n in ("x.warc", "x.warc.gz"))
    assert len(split) == 20 and split == whole
    with pytest.raises(ValueError, match="stream"):
        warc.read_archives(spark, str(tmp_path / "x.warc.bz2"))
