"""Ranked lexical search: tiles of items' term weights times tiles of documents' term impacts, as dense matrix products."""

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import written
from . import terms as cut

#: Weights are whole thousandths, impacts whole parts of IMPACT / 1000.
WEIGHT, IMPACT = 1000, 1_000_000_000
#: Items, columns of vocabulary, and documents of one matrix product.
ITEMS, COLUMNS, DOCUMENTS = 256, 2048, 512
#: A pack of items has about so many (item, term) entries; packs are searched one after another.
PACK = 500_000
#: Impacts are below IMPACT / 1000. A tile's entries are at most STEP, so that its sums of COLUMNS products stay below 2**53
#: and are exact in doubles; a larger entry is spread over several tiles.
STEP = 2**53 // (IMPACT // 1000) // COLUMNS


@dataclass
class Tile:
    """Entries (row, column, value) of neighbouring items over the terms ``vocabulary``."""

    vocabulary: np.ndarray
    row: np.ndarray
    column: np.ndarray
    value: np.ndarray


def tiles(item: np.ndarray, term: np.ndarray, value: np.ndarray) -> list[tuple[int, int, list[Tile]]]:
    """(first item, number of items, tiles) of each block of ITEMS items with whole numbers ``value`` at (item, term)."""
    blocks = []
    for first in range(0, int(item.max(initial=-1)) + 1, ITEMS):
        own = (item >= first) & (item < first + ITEMS) & (value > 0)
        at, of, rest = item[own] - first, term[own], value[own]
        found = []
        while len(rest):
            used, column = np.unique(of, return_inverse=True)
            for start in range(0, len(used), COLUMNS):
                some = (column >= start) & (column < start + COLUMNS)
                found.append(Tile(used[start : start + COLUMNS], at[some], column[some] - start, np.minimum(rest[some], STEP)))
            # What an entry has beyond STEP goes on to further tiles.
            more = rest > STEP
            at, of, rest = at[more], of[more], rest[more] - STEP
        if found:
            blocks.append((first, min(ITEMS, int(item.max()) + 1 - first), found))
    return blocks


class Firsts:
    """The documents of the highest scores of each item so far, equal scores by smaller id, a null id last."""

    def __init__(self, items: int, count: int):
        self.count = count
        self.score = [np.zeros(0, np.int64)] * items
        self.doc = [np.zeros(0, np.int64)] * items
        self.null = [np.zeros(0, bool)] * items

    def add(self, item: int, scores: np.ndarray, docs: np.ndarray, nulls: np.ndarray):
        least = self.score[item][-1] if len(self.score[item]) == self.count else 1
        at = np.flatnonzero(scores >= least)
        if len(at) > self.count:
            # All that reach the last place's score stay, so that ties are decided by id.
            last = np.partition(scores[at], len(at) - self.count)[len(at) - self.count]
            at = at[scores[at] >= last]
        if not len(at):
            return
        score, doc, null = np.r_[self.score[item], scores[at]], np.r_[self.doc[item], docs[at]], np.r_[self.null[item], nulls[at]]
        order = np.lexsort((doc, null, -score))[: self.count]
        self.score[item], self.doc[item], self.null[item] = score[order], doc[order], null[order]


def multiplied(blocks, items: int, count: int, documents) -> Firsts:
    """The first documents of each item, of batches (ids, null ids, offsets, terms, impacts) of documents."""
    best = Firsts(items, count)
    for ids, nulls, offsets, of, impact in documents:
        size = int(of.max(initial=-1)) + 1
        row = np.repeat(np.arange(len(ids)), np.diff(offsets))
        for first, many, found in blocks:
            scores = np.zeros((many, len(ids)), np.int64)
            for tile in found:
                seat = np.full(max(size, int(tile.vocabulary[-1]) + 1), -1)
                seat[tile.vocabulary] = np.arange(len(tile.vocabulary))
                column = seat[of]
                here = column >= 0
                if not here.any():
                    continue
                right = np.zeros((len(tile.vocabulary), len(ids)))
                right[column[here], row[here]] = impact[here]
                left = np.zeros((many, len(tile.vocabulary)))
                left[tile.row, tile.column] = tile.value
                scores += (left @ right).astype(np.int64)
            for i in np.flatnonzero(scores.any(1)):
                best.add(first + int(i), scores[i], ids, nulls)
    return best


def postings(docs: DataFrame, vocabulary, table: bytes) -> DataFrame:
    """(doc_id, n, terms, counts) of docs (doc_id, text): number of all terms, and the counts of those in the
    broadcast sorted ``vocabulary``, each by its place there."""

    def count(batches):
        known = vocabulary.value
        for whole in batches:
            for k in range(0, whole.num_rows, 2000):
                batch = whole.slice(k, 2000)
                n, keys = np.zeros(batch.num_rows, np.int64), []
                for first, data, offsets in cut.pieces(batch.column(1), table):
                    number, own, places = cut.terms(data, offsets)
                    n[first : first + len(places) - 1] += np.diff(places)
                    if not len(own) or not len(known):
                        continue
                    place = pa.compute.index_in(own, known).fill_null(-1).to_numpy().astype(np.int64)[number]
                    row = np.repeat(np.arange(first, first + len(places) - 1), np.diff(places))
                    pair, times = np.unique((row * len(known) + place)[place >= 0], return_counts=True)
                    keys.append((pair, times))
                pair, seat = np.unique(np.concatenate([x for x, _ in keys] or [np.zeros(0, np.int64)]), return_inverse=True)
                times = np.bincount(seat, np.concatenate([x for _, x in keys] or [np.zeros(0, np.int64)]), len(pair)).astype(np.int64)
                width = max(len(known), 1)
                offsets = pa.array(np.searchsorted(pair // width, np.arange(batch.num_rows + 1)).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(n), pa.ListArray.from_arrays(offsets, pa.array((pair % width).astype(np.int32))),
                     pa.ListArray.from_arrays(offsets, pa.array(times))],
                    names=["doc_id", "n", "terms", "counts"],
                )

    return docs.mapInArrow(count, "doc_id long, n long, terms array<int>, counts array<long>")


def _search(pack: pa.Table, docs: DataFrame, table: bytes, count: int, id_type: str) -> DataFrame:
    """(item_id, doc_id, score) with the first documents of each task for the items of a pack (item_id, term, n)."""
    context = docs.sparkSession.sparkContext
    names = pack.column("item_id").combine_chunks().dictionary_encode(null_encoding="encode")
    vocabulary = pa.compute.unique(pack.column("term"))
    vocabulary = vocabulary.take(pa.compute.sort_indices(vocabulary))
    # A pack has a bounded number of entries, whatever the corpus.
    found = written(postings(docs, context.broadcast(vocabulary), table), "postings")
    whole = found.agg(F.count(F.when(F.col("n") > 0, 1)).alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
    total, length = whole["docs"], whole["terms"]
    df = np.zeros(len(vocabulary), np.int64)
    for r in found.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count("*").alias("n")).collect():
        df[r["t"]] = r["n"]
    weight = np.array([math.floor(WEIGHT * math.log((2 * total + 2) / (2 * int(x) + 1))) for x in df], np.int64)
    term = pa.compute.index_in(pack.column("term"), vocabulary).to_numpy().astype(np.int64)
    item = names.indices.to_numpy().astype(np.int64)
    blocks = tiles(item, term, pack.column("n").to_numpy() * weight[term])
    shared = context.broadcast((blocks, names.dictionary))

    def impacts(batches):
        for whole in batches:
            for k in range(0, whole.num_rows, DOCUMENTS):
                batch = whole.slice(k, DOCUMENTS)
                lists = batch.column(2)
                offsets = lists.offsets.to_numpy()
                of, tf = lists.flatten().to_numpy().astype(np.int64), batch.column(3).flatten().to_numpy()
                # Python's numbers do not overflow, however long the corpus is.
                m = np.array([25 + 75 * n * total // length for n in batch.column(1).to_pylist()], np.int64)
                offsets = offsets - offsets[0]
                impact = (IMPACT * tf) // (1000 * tf + 8 * np.repeat(m, np.diff(offsets)))
                ids = batch.column(0)
                yield ids.fill_null(0).to_numpy(zero_copy_only=False), ids.is_null().to_numpy(zero_copy_only=False), offsets, of, impact

    def search(batches):
        blocks, names = shared.value
        best = multiplied(blocks, len(names), count, impacts(batches))
        many = [len(x) for x in best.score]
        doc = pa.array(np.concatenate([np.zeros(0, np.int64), *best.doc]), mask=np.concatenate([np.zeros(0, bool), *best.null]))
        yield pa.RecordBatch.from_arrays(
            [names.take(pa.array(np.repeat(np.arange(len(names)), many))), doc, pa.array(np.concatenate([np.zeros(0, np.int64), *best.score]))],
            names=["item_id", "doc_id", "score"],
        )

    return found.where("size(terms) > 0").mapInArrow(search, f"item_id {id_type}, doc_id long, score long")


def rank_documents(
    docs: DataFrame, items: DataFrame, count: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text"
) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``count`` documents of the highest scores above 0 for each item.

    Equal scores are ranked by smaller id, documents without id after the others. Null and empty texts have no terms;
    items without terms or without any document that shares one have no rows. Rows that repeat an item id are one item
    with the terms of all; those without id likewise. Documents that repeat an id each take a place of their own. Other
    columns are ignored.

    The items are the query set: packs of about PACK (item, term) entries, by a hash of the item, are searched one after
    another against all documents. A pass writes each document's counts of the pack's terms, the next one multiplies
    tiles of them. A task keeps ``count`` documents of each item.
    """
    table = cut.classes(digits=True)
    id_type = items.schema[item_col].dataType.simpleString()

    def count_terms(batches):
        for batch in batches:
            for k, data, offsets in cut.pieces(batch.column(1), table):
                number, known, places = cut.terms(data, offsets)
                width = max(len(known), 1)
                pair, n = np.unique(np.repeat(np.arange(len(places) - 1), np.diff(places)) * width + number, return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(k + pair // width)), known.take(pa.array(pair % width)), pa.array(n.astype(np.int64))], names=["item_id", "term", "n"]
                )

    wanted = items.select(items[item_col].alias("item_id"), items[item_text_col].cast("string").alias("text"))
    wanted = wanted.mapInArrow(count_terms, f"item_id {id_type}, term binary, n long").groupBy("item_id", "term").agg(F.sum("n").alias("n"))
    packs = max(1, -(-wanted.count() // PACK))
    wanted = written(wanted.withColumn("pack", F.pmod(F.xxhash64("item_id"), F.lit(packs))), "items")
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    found = None
    for k in range(packs):
        # One pack of bounded size, not the table.
        pack = wanted.where(F.col("pack") == k).drop("pack").orderBy("item_id", "term").toArrow()
        if pack.num_rows:
            some = _search(pack, rows, table, count, id_type)
            found = some if found is None else found.unionByName(some)
    if found is None:
        found = docs.sparkSession.createDataFrame([], f"item_id {id_type}, doc_id long, score long")
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    return cut.firsts(found, ["item_id"], order, F.col("doc_id"), count).select("item_id", "rank", "doc_id", "score")
