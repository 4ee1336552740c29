"""Substring deduplication on bytes: positions met by minimisers, those left open doubled inside a task."""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import flat, repeats

LENGTH = 100
#: Bytes of the prefix that ranks the sampled positions first.
FIRST = 32


def ranks(data: np.ndarray, offsets: np.ndarray, group: np.ndarray, wanted: np.ndarray, length: int) -> np.ndarray:
    """A rank of the ``length`` bytes at each wanted position: equal for equal bytes of one group, -1 where they are unique.

    Prefix doubling: positions start ranked by group and byte; the pair (rank at p, rank at p + h) ranks the first 2h
    bytes. Sorting the pairs gives the new ranks. Positions whose rank is unique leave, with all that needs them, until
    the prefix is ``length`` long; the last offset overlaps. Bytes are compared, not hashes.
    """
    size, end = len(data), np.repeat(offsets[1:], np.diff(offsets))
    # The group in the first rank keeps groups apart in all that follow.
    h = min(4, length)
    rank = group[np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))]
    for k in range(h):
        rank = (rank << 8) | np.r_[data[k:], np.zeros(min(k, size), np.uint8)]
    rank = np.unique(rank, return_inverse=True)[1].astype(np.int64)
    while h < length:
        step = min(h, length - h)
        live = np.flatnonzero(rank >= 0)
        live = live[live + h + step <= end[live]]
        live = live[rank[live + step] >= 0]
        pair = (rank[live] << 32) | rank[live + step]
        _, place, count = np.unique(pair, return_inverse=True, return_counts=True)
        rank = np.full(size, -1, np.int64)
        many = count[place] > 1
        rank[live[many]] = place[many]
        h += step
    return rank[wanted]


def _judge(table: pa.Table, length: int) -> pa.Table:
    data, offsets = flat.flat(table.column("packed"))
    data, offsets = data[offsets[0] : offsets[-1]], offsets - offsets[0]
    key, doc, start, n = (table.column(c).to_numpy().astype(np.int64) for c in ("key", "doc_id", "start", "n"))
    group = np.cumsum(np.r_[0, np.diff(key) != 0]).astype(np.int64)
    row = np.repeat(np.arange(len(n)), n)
    place = flat._each(np.zeros(len(n), np.int64), n)
    whole = offsets[row] + place + length <= offsets[row + 1]
    row, place = row[whole], place[whole]
    name = ranks(data, offsets, group, offsets[row] + place, length)
    repeated = np.zeros(len(row), bool)
    some = np.flatnonzero(name >= 0)
    order = some[np.lexsort((start[row[some]] + place[some], doc[row[some]], name[some]))]
    r, d, p = name[order], doc[row[order]], (start[row] + place)[order]
    if len(order):
        new = np.r_[True, r[1:] != r[:-1]]
        first = np.flatnonzero(new)[np.cumsum(new) - 1]
        repeated[order] = (d != d[first]) | (p != p[first])
    return repeats.judged(table, row, place, repeated)


def repeated_strings(docs: DataFrame, length: int = LENGTH, first: int = FIRST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Runs (doc_id, start, n): ``n`` strings of ``length`` bytes from byte ``start`` on that also start earlier.

    Earlier: in a document with a smaller id, or at an earlier place of the same document. Strings never cross documents.

    Round one ranks positions by ``first`` bytes. Only positions sampled by content take part, the minimiser of each
    string: what is unique there is unique at full length and leaves. Stretches that follow a shared position and are
    equal as wholes keep their earliest one. Then the positions of the stretches still open are dealt out by rank and
    doubled, four, eight, sixteen ... bytes, until unique or past ``length``.
    """
    runs = repeats.repeated_runs(docs, repeats.byte_units, length, first, False, id_col, text_col)

    def cut(text, starts, n):
        text = memoryview(text)
        return [bytes(text[s : s + k + length - 1]) for s, k in zip(starts.tolist(), n.tolist())]

    packed = repeats.packed_runs(docs, runs, cut, id_col, text_col)
    return runs.where("key is null").select("doc_id", "start", "n").unionByName(repeats.by_key(packed, runs, lambda t: _judge(t, length)))


def remove_repeats(docs: DataFrame, length: int = LENGTH, first: int = FIRST, id_col: str = "doc_id", text_col: str = "text", keep_bytes: bool = True) -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, with ``keep_bytes``, the kept bytes as ``kept``.

    A byte goes if a string of ``length`` bytes covering it also starts earlier; overlaps count, and strings are judged on
    the input. Spans are the maximal removed runs. Null and empty texts have no bytes; shorter texts lose nothing. Rows
    without id come back whole and count for nobody; a row that repeats another one whole is no earlier place. What is
    kept may end inside a character, so it is binary. Other columns are ignored.
    """
    texts = repeats.with_runs(docs, repeated_strings(docs, length, first, id_col, text_col), id_col, text_col)

    def remove(batches):
        for batch in batches:
            ids, text, start, n = batch.columns
            rows = []
            for t, s, k in zip(text, start, n):
                whole = t.as_buffer().to_pybytes() if t.is_valid else b""
                kept, spans = whole, 0
                if s.is_valid and whole:
                    firsts, ends = flat.covered(*(x.values.to_numpy(zero_copy_only=False) for x in (s, k)), len(whole), length - 1)
                    spans = len(firsts)
                    kept = b"".join(whole[a:b] for a, b in zip([0, *ends.tolist()], [*firsts.tolist(), len(whole)]))
                rows.append((len(whole), len(whole) - len(kept), spans, hashlib.sha256(kept).hexdigest(), kept))
            columns = list(zip(*rows)) or [()] * 5
            out = [ids, *[pa.array(c, pa.int64()) for c in columns[:3]], pa.array(columns[3], pa.string())]
            if keep_bytes:
                out.append(pa.array(columns[4], pa.binary()))
            yield pa.RecordBatch.from_arrays(out, names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"][: len(out)])

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * keep_bytes
    return texts.mapInArrow(remove, schema)
