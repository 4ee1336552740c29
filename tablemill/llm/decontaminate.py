"""Benchmark decontamination by Wu-Manber multi-pattern search over words."""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from ..session import written
from . import flat

WINDOW = 10
#: Bytes of the tables of one set of patterns; a larger benchmark is searched in several passes.
PACK_BYTES = 64_000_000
#: Bytes that a word takes in those tables besides its text: hash, two places, block and shift, suffix bucket, item.
WORD_BYTES = 56
#: Words in a piece of an item; pieces overlap by a window less one word, so that no window is lost.
PIECE_WORDS = 100_000
#: Words in a lane; the lanes of a batch are searched side by side.
LANE = 256

# A word is a run of digits, a-z and characters beyond ASCII, after lower-casing A-Z; all else separates words.
_WORD = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def normalised(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of the texts with one byte for each input byte: words lower-cased, separators as spaces."""
    data, offsets = flat.flat(column)
    return np.frombuffer(data.tobytes().translate(_WORD), np.uint8), offsets


class Patterns:
    """Test strings of the same number of words, with the tables that find them.

    ``shift`` says how far a window may move given its last block of two words: to the next place where that block
    occurs in a test string, or past it. Where a window may not move, test strings with its last block and its first one
    share a bucket. All are places in one text and its word hashes, so a string costs some 50 bytes. Strings that are
    equal by 128 bits are one, with the items of all.
    """

    def __init__(self, size: int, data: np.ndarray, offsets: np.ndarray, item: np.ndarray):
        self.size, self.block, self.data = size, min(2, size), data.tobytes()
        self.hashes, starts, ends, places = flat.words(data, offsets)
        self.starts, self.ends = starts.astype(np.int32), ends.astype(np.int32)
        n = np.diff(places)
        blocks = _blocks(np.stack([self.hashes[k : len(self.hashes) - self.block + 1 + k] for k in range(self.block)], 1))
        # A block may stand last in a string unless less than a whole string ends with it.
        last = size - self.block
        at, inner = flat._each(places[:-1], n - self.block + 1), flat._each(np.zeros(len(n), np.int64), n - self.block + 1)
        shift = np.maximum(last - inner, 0)
        order = np.lexsort((shift, blocks[at]))
        first = np.r_[True, np.diff(blocks[at][order]) != 0]
        self.known, self.shift, self.past = blocks[at][order][first], shift[order][first].astype(np.int8 if size < 100 else np.int64), last + 1
        # Strings by contents, then the distinct items of each.
        at, of = flat._each(places[:-1], n - size + 1), np.repeat(item, n - size + 1)
        one, two = (flat.Spans(self.hashes, base).hash(at, at + size) for base in (0, 1))
        order = np.lexsort((of, two, one))
        at, of, one, two = at[order], of[order], one[order], two[order]
        new = np.r_[True, (one[1:] != one[:-1]) | (two[1:] != two[:-1])]
        distinct = new | np.r_[True, of[1:] != of[:-1]]
        self.first, self.item = at[new].astype(np.int32), of[distinct].astype(np.int32)
        self.item_ends = np.r_[np.flatnonzero(new[distinct])[1:], len(self.item)].astype(np.int64)
        bucket = self._bucket(blocks, self.first)
        self.by_bucket = np.argsort(bucket, kind="stable").astype(np.int32)
        self.buckets = bucket[self.by_bucket]

    def _bucket(self, blocks: np.ndarray, at: np.ndarray) -> np.ndarray:
        return flat.mixed(blocks[at + self.size - self.block] + blocks[at] * np.uint64(0x9E3779B97F4A7C15))

    def string(self, k: int) -> bytes:
        return self.data[self.starts[self.first[k]] : self.ends[self.first[k] + self.size - 1]]

    def items(self, k: int) -> np.ndarray:
        """Places of the items that hold a string."""
        return self.item[self.item_ends[k - 1] if k else 0 : self.item_ends[k]]

    def search(self, hashes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first word, pattern) of all places in one text whose word hashes equal a pattern's."""
        total = len(hashes) - self.size + 1
        if total <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        blocks = _blocks(np.stack([hashes[k : len(hashes) - self.block + 1 + k] for k in range(self.block)], 1))
        at = np.arange(0, total, LANE)
        stop, stops = np.minimum(at + LANE, total), []
        while len(at):
            last = blocks[at + self.size - self.block]
            place = np.minimum(np.searchsorted(self.known, last), len(self.known) - 1)
            shift = np.where(self.known[place] == last, self.shift[place], self.past)
            stops.append(at[shift == 0])
            at = at + np.maximum(shift, 1)
            more = at < stop
            at, stop = at[more], stop[more]
        at = np.concatenate(stops)
        at = at[at + self.size <= offsets[np.searchsorted(offsets, at, "right")]]
        # All strings of the bucket, less those with another word.
        own = self._bucket(blocks, at)
        low, high = np.searchsorted(self.buckets, own, "left"), np.searchsorted(self.buckets, own, "right")
        at, pattern = np.repeat(at, high - low), self.by_bucket[flat._each(low, high - low)]
        for k in range(self.size):
            same = hashes[at + k] == self.hashes[self.first[pattern] + k]
            at, pattern = at[same], pattern[same]
        return at, pattern


def _blocks(hashes: np.ndarray) -> np.ndarray:
    out = hashes[:, 0]
    for k in range(1, hashes.shape[1]):
        out = flat.mixed(out + hashes[:, k] * np.uint64(0x9E3779B97F4A7C15))
    return out


def patterns(pack: pa.Table, window: int = WINDOW) -> tuple[list[str], list[Patterns]]:
    """(item ids, test strings) of (id, text, n) with words joined by one space: all windows of ``window`` words; shorter
    items are one string."""
    if not pack.num_rows:
        return [], []
    ids, item = np.unique(np.array(pack.column("id").to_pylist(), object), return_inverse=True)
    sizes = np.minimum(pack.column("n").to_numpy(), window)
    out = []
    for size in np.unique(sizes).tolist():
        rows = np.flatnonzero(sizes == size)
        data, offsets = flat.flat(pack.column("text").take(pa.array(rows)))
        out.append(Patterns(size, data[offsets[0] : offsets[-1]], offsets - offsets[0], item[rows]))
    return ids.tolist(), out


def _scan(source: DataFrame, pack: pa.Table, window: int) -> DataFrame:
    """For each (row, text): the row as it is, n_words, the places of the hit words, and the items found."""
    shared = source.sparkSession.sparkContext.broadcast(patterns(pack, window))

    def scan(batches):
        for batch in batches:
            data, offsets = normalised(batch.column(1))
            hashes, starts, ends, places = flat.words(data, offsets)
            hit, ids = [[] for _ in range(batch.num_rows)], [[] for _ in range(batch.num_rows)]
            names, found = shared.value
            for p in found:
                for at, k in zip(*(x.tolist() for x in p.search(hashes, places))):
                    if b" ".join(data[starts[w] : ends[w]].tobytes() for w in range(at, at + p.size)) == p.string(k):
                        text = int(np.searchsorted(places, at, "right")) - 1
                        hit[text].extend(range(at - int(places[text]), at - int(places[text]) + p.size))
                        ids[text].extend(names[i] for i in p.items(k).tolist())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(np.diff(places), pa.int64()),
                    pa.array([sorted(set(x)) for x in hit], pa.list_(pa.int32())),
                    pa.array([sorted(set(x)) for x in ids], pa.list_(pa.string())),
                ],
                names=["row", "n_words", "hit", "items"],
            )

    schema = T.StructType([source.schema["row"]]).add("n_words", "long").add("hit", T.ArrayType(T.IntegerType())).add("items", T.ArrayType(T.StringType()))
    return source.mapInArrow(scan, schema)


def benchmark_packs(benchmark: DataFrame, id_col: str, text_col: str, window: int = WINDOW):
    """The items with id and words, as tables (id, text, n) whose patterns take some PACK_BYTES each.

    Tasks normalise the items and cut long ones into pieces of PIECE_WORDS, so that a set holds no more than asked for,
    whatever the length of an item. One set at a time is on the driver.
    """
    items = benchmark.select(benchmark[id_col].cast("string").alias("id"), benchmark[text_col].cast("string").alias("text"))
    items = items.where("id is not null and text is not null").distinct()

    def cut(batches):
        for batch in batches:
            for item, text in zip(*batch.columns):
                words = text.as_buffer().to_pybytes().translate(_WORD).split()
                pieces = [words[k : k + PIECE_WORDS + window - 1] for k in range(0, max(1, len(words) - window + 1), PIECE_WORDS)] if words else []
                columns = [pa.array([item.as_py()] * len(pieces), pa.string()), pa.array([b" ".join(x) for x in pieces], pa.binary()), pa.array([len(x) for x in pieces], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "text", "n"])

    pieces = written(items.mapInArrow(cut, "id string, text binary, n long"), "items")
    volume = pieces.agg(F.sum(F.octet_length("text") + F.col("n") * WORD_BYTES)).first()[0] or 0
    packs = 1 + volume // PACK_BYTES
    part = F.pmod(F.xxhash64("id", "text"), F.lit(packs))
    for k in range(packs):
        yield (pieces if packs == 1 else pieces.where(part == k)).toArrow().combine_chunks()


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_words, hit (places of the hit words, from 0), items (ids as strings, sorted).

    A document word is hit inside any occurrence of ``window`` consecutive words of an item; a shorter item counts as a
    whole. Test strings go to all tasks in sets of bounded size; with more than one set, documents are scanned once per
    set, and the hits of a row are put together by id and text hash. Null and empty texts have no words; items without
    id or words are left out; rows without id and repeated rows are judged like any other. Other columns are ignored.
    """
    text = docs[text_col].cast("string")
    source = docs.select(F.struct(docs[id_col].alias("doc_id"), F.xxhash64(text).alias("hash")).alias("row"), text.alias("text"))
    passes = [_scan(source, items, window) for items in benchmark_packs(benchmark, item_col, item_text_col, window)]
    out = passes[0]
    if len(passes) > 1:
        for more in passes[1:]:
            out = out.unionByName(more)
        merged = [F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c) for c in ("hit", "items")]
        rows = (F.count("*") / len(passes)).cast("int").alias("rows")
        out = out.groupBy("row").agg(F.max("n_words").alias("n_words"), *merged, rows)
        out = out.withColumn("again", F.explode(F.sequence(F.lit(1), "rows")))
    return out.select("row.doc_id", "n_words", "hit", "items")


def without_benchmark(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, text_col: str = "text",
                      item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without any hit, with all their columns; nothing is shuffled."""
    out = docs
    for items in benchmark_packs(benchmark, item_col, item_text_col, window):
        source = out.select(F.struct(*[out[c] for c in docs.columns]).alias("row"), out[text_col].cast("string").alias("text"))
        out = _scan(source, items, window).where(F.size("hit") == 0).select("row.*")
    return out
