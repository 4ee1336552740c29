"""Terms of whole texts as dictionary numbers, piece by piece, and the first rows of each key."""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from . import flat

#: Bytes of text looked at together; a longer text comes in several pieces, cut between two terms.
PIECE = 1 << 22
#: Parts of a key that find their own first rows, so that no task sees all rows of a large key.
PARTS = 256


def classes(digits: bool) -> bytes:
    """For each byte what it counts as: letters, digits if wanted, and all beyond ASCII stay, A-Z in lower case; the rest is a space."""
    kept = np.zeros(256, bool)
    kept[97:123] = kept[65:91] = kept[128:] = True
    kept[48:58] = digits
    return bytes(b + 32 * (65 <= b <= 90) if kept[b] else 32 for b in range(256))


def pieces(column, table: bytes, limit: int | None = None):
    """(number of the first text, bytes after ``table``, offsets) of neighbouring texts of a column, together about
    ``limit`` bytes; null is empty. A text that is longer comes alone and in several pieces."""
    limit = limit or PIECE
    data, offsets = flat.flat(column)
    space = np.frombuffer(table, np.uint8) == 32
    k, n = 0, len(offsets) - 1
    while k < n:
        last = int(np.searchsorted(offsets, offsets[k] + limit, "right")) - 1
        if last > k:
            yield k, _translated(data[offsets[k] : offsets[last]], table), offsets[k : last + 1] - offsets[k]
            k = last
            continue
        at, stop = int(offsets[k]), int(offsets[k + 1])
        while at < stop:
            end = min(at + limit, stop)
            while end < stop:
                gaps = np.flatnonzero(space[data[at:end]])
                if len(gaps):
                    end = at + int(gaps[-1]) + 1
                    break
                end = min(end + limit, stop)
            yield k, _translated(data[at:end], table), np.array([0, end - at])
            at = end
        k += 1


def _translated(data: np.ndarray, table: bytes) -> np.ndarray:
    return np.frombuffer(data.tobytes().translate(table), np.uint8)


def terms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """(number of each term in turn, the distinct terms, offsets in terms of each text). Terms are runs without space;
    equal ones are found by comparing them, not by a hash alone."""
    inside = data != 32
    if not inside.any():
        return np.zeros(0, np.int64), pa.array([], pa.large_binary()), np.zeros(len(offsets), np.int64)
    edge = np.ones(len(data) + 1, bool)
    edge[1:-1] = ~inside[:-1]
    edge[offsets] = True
    starts = np.flatnonzero(inside & edge[:-1])
    lengths = np.diff(np.searchsorted(np.flatnonzero(inside), np.r_[starts, len(data)]))
    bounds = np.r_[0, np.cumsum(lengths)].astype(np.int64)
    found = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(data[inside])])
    found = found.dictionary_encode()
    return found.indices.to_numpy().astype(np.int64), found.dictionary, np.searchsorted(starts, offsets, "left")


def firsts(rows: DataFrame, keys: list[str], order: list[Column], part: Column, count: int, name: str = "rank") -> DataFrame:
    """The first ``count`` rows of each key with their place, from 1. Each of PARTS parts of a key chooses first, so the
    last choice is among PARTS * count rows however large a key is."""
    some = rows.withColumn("_part", F.pmod(F.xxhash64(part), F.lit(PARTS)))
    place = F.row_number().over(Window.partitionBy(*keys, "_part").orderBy(*order))
    some = some.withColumn("_place", place).where(F.col("_place") <= count).drop("_place", "_part")
    return some.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(name) <= count)
