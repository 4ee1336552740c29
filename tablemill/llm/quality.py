"""Quality: votes of the nearest labelled texts in a latent semantic space."""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from . import flat, terms as cut
from .language_id import held_out

#: Hashed terms: word shapes, alone and with the next word's, and words themselves.
SHAPES, WORDS = 1 << 12, 1 << 13
FEATURES = SHAPES + WORDS
#: Dimensions of the latent space, and labelled texts that it is derived from, at most.
DIMENSIONS, BASIS_ROWS = 48, 2_000
#: Labelled texts that vote, at most so many of either label, of at most so many bytes each; all others are scored only.
SAMPLE_EACH, SAMPLE_BYTES = 4_000, 1 << 15
#: Nearest texts that vote, and the power of their similarity that weights a vote.
NEIGHBOURS, POWER = 31, 4
#: Documents of one block of the product with all labelled vectors.
BLOCK = 256
#: Score from which a text counts as good.
THRESHOLD = 0.7

_SPACES = bytes(32 if b in (9, 10, 11, 12, 13, 32) else b for b in range(256))
# Characters of a shape: letters by case, digits, and each sign as itself.
_SHAPE = np.array([ord("A") if 65 <= b <= 90 else ord("a") if 97 <= b <= 122 or b >= 128 else ord("0") if 48 <= b <= 57 else b for b in range(256)], np.uint8)


def _of_words(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(shape, feature) of each word: a hash of its classes of characters, runs as one, and the bucket of its letters."""
    data, offsets = flat.flat(words)
    data, offsets = data[offsets[0] : offsets[-1]], offsets - offsets[0]
    shape = _SHAPE[data]
    fresh = np.ones(len(data), bool)
    fresh[1:] = shape[1:] != shape[:-1]
    fresh[offsets[:-1]] = True
    places = np.r_[0, np.cumsum(fresh)][offsets]
    shapes = flat.Spans(flat.BYTE_VALUES[shape[fresh]]).hash(places[:-1], places[1:])
    letter = (shape == 97) | (shape == 65)
    lower = flat.lowered(data)[letter]
    places = np.r_[0, np.cumsum(letter)][offsets]
    letters = flat.Spans(flat.BYTE_VALUES[lower]).hash(places[:-1], places[1:])
    return shapes, (SHAPES + (letters % np.uint64(WORDS))).astype(np.int64)


def counts(column) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(offsets, features, counts) of whole texts: the words, their shapes, and pairs of neighbouring shapes. A word that
    is repeated at once is a shape of its own."""
    keys, times = [], []
    carry: dict = {}
    for first, data, offsets in cut.pieces(column, _SPACES):
        number, known, places = cut.terms(data, offsets)
        if not len(number):
            continue
        shapes, word = _of_words(known)
        row = first + np.repeat(np.arange(len(places) - 1), np.diff(places))
        again = np.zeros(len(number), bool)
        again[1:] = (number[1:] == number[:-1]) & (row[1:] == row[:-1])
        # A long text goes on in the next piece: its last word stands before this one's first.
        before = carry.get(int(row[0]))
        if before is not None:
            again[0] = before[0] == known[int(number[0])].as_py()
        shape = shapes[number] + again.astype(np.uint64)
        last = np.r_[np.uint64(before[1] if before else 0), shape[:-1]]
        start = np.r_[before is None, row[1:] != row[:-1]]
        last[start] = 0
        pair = flat.mixed(last * np.uint64(0x9E3779B97F4A7C15) + shape)
        carry = {int(row[-1]): (known[int(number[-1])].as_py(), int(shape[-1]))}
        one = (flat.mixed(shape) % np.uint64(SHAPES)).astype(np.int64)
        two = (pair % np.uint64(SHAPES)).astype(np.int64)
        key, n = np.unique(np.r_[row * FEATURES + one, row * FEATURES + two, row * FEATURES + word[number]], return_counts=True)
        keys.append(key)
        times.append(n)
    none = np.zeros(0, np.int64)
    key, seat = np.unique(np.concatenate([none, *keys]), return_inverse=True)
    n = np.bincount(seat, np.concatenate([none, *times]), len(key))
    return np.searchsorted(key // FEATURES, np.arange(len(column) + 1)), key % FEATURES, n


def weighted(offsets, features, n, idf) -> np.ndarray:
    """TF-IDF with the root of the counts, each text of length 1."""
    value = np.sqrt(n) * idf[features]
    upto = np.r_[0, np.cumsum(value * value)]
    norm = np.sqrt(np.maximum(np.diff(upto[offsets]), 1e-30))
    return value / np.repeat(norm, np.diff(offsets))


def latent(offsets, features, value, dimensions: int, seed: int = 5) -> np.ndarray:
    """The leading right singular vectors of a sparse matrix of texts and features, by a randomised range finder."""
    texts = len(offsets) - 1
    matrix = np.zeros((texts, FEATURES), np.float32)
    matrix[np.repeat(np.arange(texts), np.diff(offsets)), features] = value
    size = min(dimensions + 16, texts)
    side = np.random.default_rng(seed).normal(size=(FEATURES, size)).astype(np.float32)
    for _ in range(3):
        left = np.linalg.qr(matrix @ side)[0]
        side = matrix.T @ left
    return np.linalg.svd(side.T, full_matrices=False)[2][:dimensions].T.astype(np.float32)


@dataclass
class Model:
    """Weights of the features, the latent space, and the labelled vectors that vote."""

    idf: np.ndarray
    space: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray

    def place(self, offsets, features, n) -> np.ndarray:
        """The direction of each text in the latent space; 0 for texts without words."""
        value = weighted(offsets, features, n, self.idf).astype(np.float32)
        out = np.zeros((len(offsets) - 1, self.space.shape[1]), np.float32)
        filled = np.flatnonzero(np.diff(offsets))
        for a in range(0, len(filled), BLOCK):
            some = filled[a : a + BLOCK]
            at = flat._each(offsets[some], offsets[some + 1] - offsets[some])
            begin = np.r_[0, np.cumsum(offsets[some + 1] - offsets[some])[:-1]]
            out[some] = np.add.reduceat(self.space[features[at]] * value[at, None], begin)
        return out / np.maximum(np.sqrt((out * out).sum(1, keepdims=True)), 1e-12)

    def score(self, column) -> np.ndarray:
        """The share of label 1 in the votes of the nearest labelled texts; 0 without words."""
        offsets, features, n = counts(column)
        placed = self.place(offsets, features, n)
        out = np.zeros(len(placed))
        near = min(NEIGHBOURS, len(self.labels))
        filled = np.flatnonzero(np.diff(offsets))
        for a in range(0, len(filled), BLOCK):
            some = filled[a : a + BLOCK]
            cosine = placed[some] @ self.vectors.T
            top = np.argpartition(cosine, cosine.shape[1] - near, axis=1)[:, -near:]
            vote = np.maximum(np.take_along_axis(cosine, top, 1).astype(float), 1e-6) ** POWER
            out[some] = (vote * self.labels[top]).sum(1) / vote.sum(1)
        return np.clip(out, 0, 1)


def fit(texts: list[str], labels: np.ndarray, idf: np.ndarray) -> Model:
    """The latent space of a part of the labelled texts, and the vectors of all of them."""
    offsets, features, n = counts(pa.array(texts, pa.string()))
    some = np.sort(np.random.default_rng(2).permutation(len(texts))[:BASIS_ROWS])
    at = flat._each(offsets[some], offsets[some + 1] - offsets[some])
    inner = np.r_[0, np.cumsum(offsets[some + 1] - offsets[some])]
    space = latent(inner, features[at], weighted(inner, features[at], n[at], idf), DIMENSIONS)
    model = Model(idf, space, np.zeros((0, 0)), labels.astype(float))
    model.vectors = model.place(offsets, features, n)
    return model


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model | None:
    """Weights from the document frequencies of all texts; vectors of a bounded sample of labelled texts outside the
    held-out fourth, chosen by a hash of the id; None without any. The larger label of an id that is labelled twice holds."""
    known = labels.select(labels[id_col].cast("long").alias("id"), labels[label_col].cast("int").alias("label"))
    known = known.where(F.col("id").isNotNull() & F.col("label").isin(0, 1) & ~held_out(F.col("id"), 4, 2)).groupBy("id").agg(F.max("label").alias("label"))
    sizes = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return None
    texts = docs.select(docs[id_col].cast("long").alias("doc"), docs[text_col].cast("string").alias("text"))

    def frequencies(batches):
        found, rows = np.zeros(FEATURES, np.int64), 0
        for batch in batches:
            for k in range(0, batch.num_rows, 2000):
                some = batch.column(0).slice(k, 2000)
                found += np.bincount(counts(some)[1], minlength=FEATURES)
                rows += len(some)
        at = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[at, -1]), pa.array(np.r_[found[at], rows])], names=["feature", "n"])

    found = texts.select("text").mapInArrow(frequencies, "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n")).collect()
    found = {r["feature"]: r["n"] for r in found}
    total, df = found.pop(-1, 0), np.zeros(FEATURES)
    df[list(found)] = list(found.values())
    idf = np.log((1 + total) / (1 + df)) + 0.1

    draw = F.shiftrightunsigned(F.xxhash64(F.lit("sample"), "id"), 11) / F.lit(float(1 << 53))
    rate = F.when(F.col("label") == 0, min(1.0, 2 * SAMPLE_EACH / sizes.get(0, 1))).otherwise(min(1.0, 2 * SAMPLE_EACH / sizes.get(1, 1)))
    some = known.withColumn("draw", draw).where(F.col("draw") <= rate)
    place = F.row_number().over(Window.partitionBy("label").orderBy("draw", "id"))
    some = some.withColumn("place", place).where(F.col("place") <= SAMPLE_EACH).select("id", "label")
    # 2 * SAMPLE_EACH rows of two numbers, so the sample fits any task; its texts have SAMPLE_BYTES at most.
    rows = texts.where((F.octet_length("text") <= SAMPLE_BYTES) & (F.octet_length("text") > 0)).join(F.broadcast(some), F.col("doc") == F.col("id"))
    table = rows.groupBy("id").agg(F.max("label").alias("label"), F.max("text").alias("text")).orderBy("id").toArrow()
    if not table.num_rows:
        return None
    return fit(table.column("text").to_pylist(), table.column("label").to_numpy(), idf)


def quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted (1 from a score of THRESHOLD on).

    Scores come from the whole text alone: its cosines with every labelled vector are computed in blocks, and the
    NEIGHBOURS nearest vote with their similarity. Texts without words (null, empty, white space) score 0, as does
    everything if there is no labelled text to learn from. Rows without id are scored like any other and never learned
    from; rows that repeat an id count once in learning. Other columns are ignored.
    """
    # FEATURES x DIMENSIONS and 2 * SAMPLE_EACH x DIMENSIONS numbers at most, whatever the input.
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels, id_col, text_col, label_col))

    def score(batches):
        for whole in batches:
            for k in range(0, whole.num_rows, 2000):
                batch = whole.slice(k, 2000)
                scores = shared.value.score(batch.column(1)) if shared.value else np.zeros(batch.num_rows)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores)], names=["doc_id", "score"])

    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    scored = rows.mapInArrow(score, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
