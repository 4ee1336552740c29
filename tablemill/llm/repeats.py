"""Which windows of a corpus repeat: super-k-mers by minimiser, reduced before anything large is shuffled.

The shared first half of both substring operators. Runs of consecutive windows with one minimiser are compared as
wholes: a run whose key (minimiser) and signature (all of its units) occur earlier holds repeated windows only. What
remains open are the first runs of keys that have several signatures; only those travel as text.

Volume: one packed entry of 28 bytes per run (2 to 3 runs per 100 units), then the open runs. Copies inside a task
are settled there. Keys that gather 2,000 runs, or one in a million where that is more, found by an exact distributed
heavy-hitter count, are spread by whole windows (see ``flat.runs``), so no bucket holds a common passage of all documents.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import written
from . import flat

#: A minimiser is hot above this share of all runs, and above so many runs. At most 2 / HOT_SHARE (16 MB) are sent to tasks.
#: At 100 TB of text, some 2.5e12 runs, a key that is not hot has 2.5 million runs at most, 70 MB of packed entries.
HOT_SHARE, HOT_LEAST = 1 / 1_000_000, 2_000
#: Runs per bucket, some 60 MB in a task.
BUCKET_RUNS = 1_000_000
#: Open windows per partition in the second half.
PART_WINDOWS = 1_000_000

_LAYOUT = (("<u4", 4), ("<u8", 8), ("<i8", 8), ("<u4", 4), ("<u4", 4))


def word_units(column):
    """(values, offsets) of the words of an Arrow column."""
    hashes, _, _, offsets = flat.words(*flat.flat(column))
    return (lambda a, b: hashes[a:b]), offsets


def byte_units(column):
    """(values, offsets) of the UTF-8 bytes of an Arrow column."""
    data, offsets = flat.flat(column)
    return (lambda a, b: flat.BYTE_VALUES[data[a:b]]), offsets


def texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The two columns of a table, whatever the others are called."""
    return docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].cast("string").alias("text"))


def _pack(key, sign, doc, start, n) -> bytes:
    return b"".join(x.astype(t).tobytes() for x, (t, _) in zip((key & np.uint64(0xFFFFFFFF), sign, doc, start, n), _LAYOUT))


def _unpack(blobs) -> list[np.ndarray]:
    parts = []
    for blob in blobs:
        blob, at, n = blob.as_py(), 0, 0
        n = len(blob) // sum(w for _, w in _LAYOUT)
        columns = []
        for t, w in _LAYOUT:
            columns.append(np.frombuffer(blob, t, n, at))
            at += n * w
        parts.append(columns)
    return [np.concatenate(x) for x in zip(*parts)]


def hot_minimisers(source: DataFrame, units, window: int, gram: int) -> tuple[np.ndarray, int]:
    """(minimisers that may exceed the limit, number of runs). Each task names those above half the share in it, so
    at most 2 / HOT_SHARE rows come from a task. Their sums are written, and only those above the limit, which the sum
    of all runs gives, reach the driver: at most 2 / HOT_SHARE."""
    none = np.zeros(0, np.uint64)

    def count(batches):
        keys, counts, total = none, np.zeros(0, np.int64), 0
        fresh: list = []

        def merge():
            nonlocal keys, counts, fresh
            every = np.concatenate([keys, *fresh])
            weight = np.concatenate([counts, np.ones(len(every) - len(keys), np.int64)])
            keys, place = np.unique(every, return_inverse=True)
            counts, fresh = np.bincount(place, weight, len(keys)).astype(np.int64), []

        for batch in batches:
            key = flat.runs(*units(batch.column(0)), window, gram, none)[0]
            total += len(key)
            fresh.append(key)
            if sum(map(len, fresh)) > 1_000_000:
                merge()
        merge()
        often = counts >= max(2, total * HOT_SHARE / 2)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.r_[keys[often].view(np.int64), 0]), pa.array(np.r_[counts[often], 0]), pa.array(np.r_[counts[often] * 0, total])],
            names=["key", "n", "runs"],
        )

    found = source.select("text").mapInArrow(count, "key long, n long, runs long").groupBy("key").agg(F.sum("n").alias("n"), F.sum("runs").alias("runs"))
    found = written(found, "minimisers")
    # The extra rows of the tasks, which carry the numbers of runs, meet in key 0.
    runs = found.agg(F.sum("runs")).first()[0] or 0
    least = max(HOT_LEAST, runs * HOT_SHARE) / 2
    hot = found.where(F.col("n") >= least).select("key").toArrow().column("key").to_numpy().astype(np.int64).view(np.uint64)
    return np.sort(hot), runs


def repeated_runs(docs: DataFrame, units, window: int, gram: int, by_document: bool, id_col: str, text_col: str) -> DataFrame:
    """A written table of runs (doc_id, start, n, key): ``n`` windows from unit ``start`` on.

    Without a key, all windows of the run occur earlier. With one, the run is the first of its signature and shares
    its key with others: whether its windows occur earlier is open. ``by_document``: earlier means in a document
    with a smaller id, otherwise also at an earlier place of the same document. Rows without id take no part.
    """
    source = texts(docs, id_col, text_col).where("id is not null")
    spark = docs.sparkSession
    hot, total = hot_minimisers(source, units, window, gram)
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // BUCKET_RUNS))

    def first_of(key, sign, doc, start):
        """Order by class and place; for each, the index of the first of its class, and whether it comes later."""
        order = np.lexsort((start, doc, sign, key))
        k, s, d, p = key[order], sign[order], doc[order], start[order]
        new = np.r_[True, (k[1:] != k[:-1]) | (s[1:] != s[:-1])] if len(k) else np.zeros(0, bool)
        first = np.flatnonzero(new)[np.cumsum(new) - 1] if len(k) else np.zeros(0, np.int64)
        later = d > d[first]
        if not by_document:
            later |= p > p[first]
        return order, new, later

    def scan(batches):
        for batch in batches:
            key, sign, text, start, n = flat.runs(*units(batch.column(1)), window, gram, hot)
            if not len(key):
                continue
            doc = np.asarray(batch.column(0).to_numpy(zero_copy_only=False), np.int64)[text]
            order, _, later = first_of(key, sign, doc, start)
            known = np.zeros(len(key), bool)
            known[order] = later
            bucket = np.where(known, flat.mixed(doc.view(np.uint64)), key >> np.uint64(32)) % np.uint64(buckets)
            # Entries stay in the order of the documents, which the shuffle's compression uses.
            by = np.lexsort((known, bucket))
            bucket, known = bucket[by].astype(np.int32), known[by]
            cut = np.flatnonzero(np.r_[True, (bucket[1:] != bucket[:-1]) | (known[1:] != known[:-1])])
            columns = [x[by] for x in (key, sign, doc, start, n)]
            blobs = [_pack(*[x[a:b] for x in columns]) for a, b in zip(cut, np.r_[cut[1:], len(by)])]
            for a in range(0, len(cut), 4096):
                some = cut[a : a + 4096]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(bucket[some]), pa.array(known[some]), pa.array(blobs[a : a + 4096], pa.binary())], names=["bucket", "known", "runs"]
                )

    def settle(table: pa.Table) -> pa.Table:
        known = table.column("known").to_numpy()
        blobs = table.column("runs").combine_chunks()
        bucket = int(table.column("bucket")[0].as_py())
        out = []
        if known.any():
            _, _, doc, start, n = _unpack(blobs.filter(pa.array(known)))
            out.append((doc, start, n, np.full(len(doc), -1, np.int64)))
        if not known.all():
            key, sign, doc, start, n = _unpack(blobs.filter(pa.array(~known)))
            order, new, later = first_of(key, sign, doc, start)
            key, doc, start, n = key[order], doc[order], start[order], n[order]
            # Classes of each key; a key with one class has nothing open.
            at = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            classes = np.add.reduceat(new.astype(np.int64), at)
            several = classes > 1
            if by_document:
                several &= np.maximum.reduceat(doc, at) > np.minimum.reduceat(doc, at)
            open_ = np.repeat(several, np.diff(np.r_[at, len(key)])) & ~later
            # Entries that are neither are the first of their class under a key of their own.
            name = np.where(open_, (np.int64(bucket) << 32) | key.astype(np.int64), -1)
            keep = open_ | later
            out.append((doc[keep], start[keep], n[keep], name[keep]))
        doc, start, n, name = (np.concatenate(x) for x in zip(*out)) if out else [np.zeros(0, np.int64)] * 4
        return pa.table(
            {
                "doc_id": pa.array(doc, pa.int64()), "start": pa.array(start.astype(np.int32)), "n": pa.array(n.astype(np.int32)),
                "key": pa.array(name, pa.int64(), mask=name < 0),
            }
        )

    packed = source.mapInArrow(scan, "bucket int, known boolean, runs binary")
    return written(packed.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(settle, "doc_id long, start int, n int, key long"), "runs")


def packed_runs(docs: DataFrame, runs: DataFrame, cut, id_col: str, text_col: str) -> DataFrame:
    """The open runs with their text: (key, doc_id, start, n, packed), by key. ``cut(text, starts, n)`` gives the
    packed strings of the runs of one text."""
    wanted = (
        runs.where("key is not null").groupBy("doc_id")
        .agg(F.collect_list("start").alias("start"), F.collect_list("n").alias("n"), F.collect_list("key").alias("key"))
    )
    source = texts(docs, id_col, text_col).where("id is not null")
    # A row that is repeated as a whole counts once.
    joined = wanted.hint("shuffle_hash").join(source, wanted["doc_id"] == source["id"]).select("doc_id", "text", "start", "n", "key")

    def pack(batches):
        for batch in batches:
            strings = []
            for text, start, n in zip(*batch.columns[1:4]):
                text = text.as_buffer() if text.is_valid else pa.py_buffer(b"")
                strings += cut(text, *(x.values.to_numpy(zero_copy_only=False) for x in (start, n)))
            start, n, key = (c.flatten() for c in batch.columns[2:5])
            doc = batch.column(0).to_numpy()[batch.column(2).value_parent_indices().to_numpy()]
            yield pa.RecordBatch.from_arrays(
                [key, pa.array(doc), start, n, pa.array(strings, pa.binary())], names=["key", "doc_id", "start", "n", "packed"]
            )

    return joined.mapInArrow(pack, "key long, doc_id long, start int, n int, packed binary")


def by_key(packed: DataFrame, runs: DataFrame, judge) -> DataFrame:
    """Runs (doc_id, start, n) of repeated windows: ``judge`` gets all rows of some keys, sorted by key and place, in
    chunks of a few MB, so a task never holds its whole partition. ``runs`` is the written table behind ``packed``, whose
    open windows say how many partitions there are."""
    least = int(packed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    windows = runs.where("key is not null").agg(F.sum(F.col("n").cast("long"))).first()[0] or 0
    sorted_ = packed.repartition(max(least, -(-windows // PART_WINDOWS)), "key").sortWithinPartitions("key", "doc_id", "start")

    def stream(batches):
        held: list = []
        for batch in batches:
            held.append(batch)
            if sum(b.nbytes for b in held) < 4_000_000:
                continue
            table = pa.Table.from_batches(held).combine_chunks()
            keys = table.column("key").to_numpy()
            end = int(np.searchsorted(keys, keys[-1], "left"))
            if end:
                yield from judge(table.slice(0, end)).to_batches()
            held = table.slice(end).to_batches()
        if held:
            yield from judge(pa.Table.from_batches(held).combine_chunks()).to_batches()

    return sorted_.mapInArrow(stream, "doc_id long, start int, n int")


def judged(table: pa.Table, row: np.ndarray, place: np.ndarray, repeated: np.ndarray) -> pa.Table:
    """Runs of repeated windows from (row of the table, window in it, whether it is repeated), in that order."""
    row, place = row[repeated], place[repeated]
    cut = np.flatnonzero(np.r_[True, (np.diff(row) != 0) | (np.diff(place) != 1)]) if len(row) else np.zeros(0, np.int64)
    first = row[cut]
    return pa.table(
        {
            "doc_id": table.column("doc_id").to_numpy()[first],
            "start": (table.column("start").to_numpy()[first] + place[cut]).astype(np.int32),
            "n": np.diff(np.r_[cut, len(row)]).astype(np.int32),
        }
    )


def with_runs(docs: DataFrame, runs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Every row of the texts (id, text) with the lists ``start`` and ``n`` of its repeated runs, null where it has none."""
    lists = runs.groupBy("doc_id").agg(F.collect_list("start").alias("start"), F.collect_list("n").alias("n"))
    source = texts(docs, id_col, text_col)
    return source.join(lists.hint("shuffle_hash"), source["id"] == lists["doc_id"], "left").select("id", "text", "start", "n")
