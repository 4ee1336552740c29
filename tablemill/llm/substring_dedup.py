"""Substring deduplication on words by super-k-mer partitioning."""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import flat, repeats

WINDOW = 50
#: Words of a minimiser; every window of 50 words holds 26 of them.
GRAM = 25


def _strings(text, starts, n, window):
    """Words start..start+n+window-1 of a text, joined by one space, for each run."""
    every = text.to_pybytes().split()
    return [b" ".join(every[s : s + k + window - 1]) for s, k in zip(starts.tolist(), n.tolist())]


def _judge(table: pa.Table, window: int) -> pa.Table:
    """Sort all windows of the buckets; those that a smaller document holds too are repeated."""
    hashes, _, _, offsets = flat.words(*flat.flat(table.column("packed")))
    n = table.column("n").to_numpy().astype(np.int64)
    row = np.repeat(np.arange(len(n)), n)
    place = flat._each(np.zeros(len(n), np.int64), n)
    at = offsets[row] + place
    whole = at + window <= offsets[row + 1]
    row, place, at = row[whole], place[whole], at[whole]
    sums = [flat.Spans(hashes, base).hash(at, at + window) for base in (0, 1)]
    doc = table.column("doc_id").to_numpy()[row]
    order = np.lexsort((doc, sums[1], sums[0]))
    a, b, d = sums[0][order], sums[1][order], doc[order]
    repeated = np.zeros(len(row), bool)
    if len(row):
        new = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])]
        repeated[order] = d > d[np.flatnonzero(new)[np.cumsum(new) - 1]]
    return repeats.judged(table, row, place, repeated)


def repeated_windows(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Runs (doc_id, start, n): ``n`` windows of ``window`` words from word ``start`` on that also start in a document with a smaller id.

    Consecutive windows with one minimiser form a super-k-mer. Super-k-mers that repeat as wholes are settled by
    minimiser and signature. The others travel as one packed string to the bucket of their minimiser, where all
    windows are sorted and counted exactly. Windows never cross documents; a document's own repetitions do not count.
    """
    runs = repeats.repeated_runs(docs, repeats.word_units, window, gram, True, id_col, text_col)
    packed = repeats.packed_runs(docs, runs, lambda t, s, n: _strings(t, s, n, window), id_col, text_col)
    resolved = repeats.by_key(packed, runs, lambda table: _judge(table, window))
    return runs.where("key is null").select("doc_id", "start", "n").unionByName(resolved)


def remove_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """One row per input row: doc_id, n_words, n_removed, kept_sha256 and, with ``keep_text``, the kept words as ``kept``.

    A word goes if a window covering it also starts in a document with a smaller id. Windows are judged on the input.
    Null and empty texts have no words; texts of fewer than ``window`` words lose nothing. Rows without id come
    back whole and count for nobody. Rows that repeat an id are one document to each other. Other columns are ignored.
    """
    texts = repeats.with_runs(docs, repeated_windows(docs, window, gram, id_col, text_col), id_col, text_col)

    def cut(batches):
        for batch in batches:
            ids, text, start, n = batch.columns
            rows = []
            for t, s, k in zip(text, start, n):
                every = t.as_buffer().to_pybytes().split() if t.is_valid else []
                kept = every
                if s.is_valid and every:
                    firsts, ends = flat.covered(*(x.values.to_numpy(zero_copy_only=False) for x in (s, k)), len(every), window - 1)
                    kept, at = [], 0
                    for a, b in zip(firsts.tolist(), ends.tolist()):
                        kept += every[at:a]
                        at = b
                    kept += every[at:]
                joined = b" ".join(kept)
                rows.append((len(every), len(every) - len(kept), hashlib.sha256(joined).hexdigest(), joined))
            columns = list(zip(*rows)) or [()] * 4
            out = [ids, pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.string())]
            if keep_text:
                out.append(pa.array(columns[3], pa.binary()).cast(pa.string()))
            yield pa.RecordBatch.from_arrays(out, names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept"][: len(out)])

    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept string" * keep_text
    return texts.mapInArrow(cut, schema)
