"""Toxicity: bags of subword embeddings, averaged into a linear softmax."""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from . import flat
from .language_id import held_out

#: Hashed subwords, dimensions of their vectors, lengths of the character n-grams of a word with its two ends.
BUCKETS, DIMENSIONS, LENGTHS = 1 << 17, 8, (3, 4, 5)
#: Words of a passage; a text is scored by its most toxic passage, so that length hides nothing. A passage is an average
#: over this many places; a word that it repeats and places beyond the text's end stay empty. Passages start at every word, in
#: learning at every fourth and so that the last one is whole.
PASSAGE, STRIDE = 8, 4
#: Learned from at most so many texts of either label, of at most so many bytes each; all others are scored only.
SAMPLE_EACH, SAMPLE_BYTES = 2_000, 1 << 16
EPOCHS, BATCH, RATE = 8, 32, 0.5
#: A small sample is gone through more often, for at least so many steps.
LEAST_STEPS = 400
#: Subwords of fewer words in texts of the sample are not learned, so that rare words are known by their common parts.
LEAST_USES = 4
#: Score from which a text counts as toxic.
THRESHOLD = 0.7

# Letters of any script stay, lower-cased before; digits, signs and white space separate words.
_LETTERS = bytes(b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def word_bag(column) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """(distinct words, word number of each word in turn, offsets of the texts) of whole texts."""
    column = pc.utf8_lower(column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column)
    data, offsets = flat.flat(column)
    data = np.frombuffer(data.tobytes().translate(_LETTERS), np.uint8)
    hashes, starts, ends, places = flat.words(data, offsets)
    _, first, number = np.unique(hashes, return_index=True, return_inverse=True)
    return [data[starts[i] : ends[i]].tobytes() for i in first], number, places


def subwords(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(feature numbers, offsets) of each word: the word itself and all n-grams of its characters with a space at both ends."""
    codes = np.frombuffer((" " + " ".join(w.decode("utf-8", "replace") for w in words) + " ").encode("utf-32-le"), np.uint32).astype(np.uint64)
    space = codes == 32
    upto = np.r_[0, np.cumsum(space)]
    names, owners = [], []
    for n in LENGTHS:
        if len(codes) < n:
            continue
        at = np.arange(len(codes) - n + 1)
        at = at[upto[at + n - 1] == upto[at + 1]]  # no space inside
        name = np.full(len(at), n, np.uint64)
        for k in range(n):
            name = name * np.uint64(0x100000001B3) + codes[at + k]
        names.append(name)
        owners.append(upto[at + 1] - 1)
    ends = np.flatnonzero(space)
    names.append(flat.Spans(flat.mixed(codes)).hash(ends[:-1] + 1, ends[1:]))
    owners.append(np.arange(len(words)))
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    return (flat.mixed(np.concatenate(names))[order] % np.uint64(BUCKETS)).astype(np.int64), np.searchsorted(owner[order], np.arange(len(words) + 1))


def since(places: np.ndarray, number: np.ndarray) -> np.ndarray:
    """How many words ago each word stood in its text last; PASSAGE if that is longer ago or never."""
    text = np.repeat(np.arange(len(places) - 1), np.diff(places))
    out = np.full(len(number), PASSAGE)
    for k in range(min(PASSAGE, len(number)) - 1, 0, -1):
        out[k:][(number[k:] == number[:-k]) & (text[k:] == text[:-k])] = k
    return out


def passages(places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, end, text) of the passages that are learned from."""
    last = np.maximum(np.diff(places) - PASSAGE, 0)
    parts = np.where(np.diff(places) > 0, -(-last // STRIDE) + 1, 0)
    text = np.repeat(np.arange(len(last)), parts)
    first = places[text] + np.minimum(flat._each(np.zeros(len(last), np.int64), parts) * STRIDE, last[text])
    return first, np.minimum(first + PASSAGE, places[text + 1]), text


@dataclass
class Model:
    """What is left for scoring of the vectors and the softmax: the logit each subword adds, and the offset."""

    subword_logit: np.ndarray
    offset: float

    def score(self, column) -> np.ndarray:
        """The probability of label 1 of the most toxic passage of each text; 0 without words."""
        words, number, places = word_bag(column)
        out = np.zeros(len(places) - 1)
        if not words:
            return out
        features, offsets = subwords(words)
        word = np.add.reduceat(self.subword_logit[features], offsets[:-1]) / np.diff(offsets)
        # A word counts in the passages that start after it stood last and not after it: sums from two ends.
        at, size = np.arange(len(number)), np.diff(places)
        text = np.repeat(np.arange(len(size)), size)
        value = word[number] / PASSAGE
        total = np.bincount(np.maximum(at - since(places, number) + 1, places[text]), value, len(at) + 1)
        logit = np.cumsum(total[:-1] - np.r_[0, value[:-1]])
        # Passages that are whole, or the first one.
        logit[at - places[text] > np.maximum(size[text] - PASSAGE, 0)] = -np.inf
        filled = np.flatnonzero(size)
        most = np.round(np.maximum.reduceat(logit, places[filled]), 9) + self.offset
        out[filled] = 1 / (1 + np.exp(-np.clip(most, -50, 50)))
        return out


def fit(texts: list[str], labels: np.ndarray, seed: int = 11) -> Model:
    """Learn subword vectors and the softmax over them jointly, by gradient descent with adaptive steps per subword.

    A passage is the average of its words' vectors, a word that of its subwords' vectors. Of a text with label 1 the
    most toxic passage has to be toxic; of the others, no passage may be.
    """
    words, number, places = word_bag(pa.array(texts, pa.string()))
    features, offsets = subwords(words)
    first, ends, text = passages(places)
    again = since(places, number)
    of_text = np.searchsorted(text, np.arange(len(texts) + 1))
    used = np.unique(np.repeat(np.arange(len(texts)), np.diff(places)) * len(words) + number) % max(len(words), 1)
    uses = np.bincount(features, np.repeat(np.bincount(used, minlength=len(words)), np.diff(offsets)), BUCKETS)
    rng = np.random.default_rng(seed)
    vectors = rng.normal(0, 0.1, (BUCKETS, DIMENSIONS)) * (uses >= LEAST_USES)[:, None]
    softmax, offset = rng.normal(0, 0.1, (DIMENSIONS, 2)), np.zeros(2)
    seen, seen_softmax, seen_offset = np.full(BUCKETS, 1e-6), np.full((DIMENSIONS, 2), 1e-6), np.full(2, 1e-6)
    usable = np.flatnonzero(np.diff(of_text))
    for _ in range(max(EPOCHS, -(-LEAST_STEPS * BATCH // max(len(usable), 1)))):
        order = rng.permutation(usable)
        for a in range(0, len(order), BATCH):
            some = order[a : a + BATCH]
            part = flat._each(of_text[some], of_text[some + 1] - of_text[some])
            size = ends[part] - first[part]
            token = flat._each(first[part], size)
            inside = flat._each(np.zeros(len(part), np.int64), size)
            part_of, token = np.where(again[token] <= inside, 0.0, 1 / PASSAGE)[:, None], number[token]
            own, place = np.unique(token, return_inverse=True)
            width = offsets[own + 1] - offsets[own]
            feature = features[flat._each(offsets[own], width)]
            at = np.r_[0, np.cumsum(width)[:-1]]
            word = np.add.reduceat(vectors[feature], at) / width[:, None]
            begin = np.r_[0, np.cumsum(size)[:-1]]
            mean = np.add.reduceat(word[place] * part_of, begin)
            logit = mean @ softmax + offset
            p = np.exp(logit - logit.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            # Weights of the passages: the most toxic one of each text, and for label 0 all others a little too.
            many = of_text[some + 1] - of_text[some]
            start, gain, label = np.r_[0, np.cumsum(many)[:-1]], logit[:, 1] - logit[:, 0], np.repeat(labels[some], many)
            top = np.repeat(np.maximum.reduceat(gain, start), many) == gain
            weight = np.where(top, 1.0, np.where(label == 0, 1 / np.repeat(many, many), 0.0)) / len(some)
            error = (p - np.eye(2)[label]) * weight[:, None]
            in_word = np.zeros((len(own), DIMENSIONS))
            spread = np.repeat(error @ softmax.T, size, axis=0) * part_of
            for d in range(DIMENSIONS):
                in_word[:, d] = np.bincount(place, spread[:, d], len(own))
            per = np.repeat(in_word / width[:, None], width, axis=0) * (uses[feature] >= LEAST_USES)[:, None]
            touched, seat = np.unique(feature, return_inverse=True)
            change = np.stack([np.bincount(seat, per[:, d], len(touched)) for d in range(DIMENSIONS)], 1)
            seen[touched] += (change**2).mean(1)
            vectors[touched] -= RATE * change / np.sqrt(seen[touched])[:, None]
            for value, kept, grad in ((softmax, seen_softmax, mean.T @ error), (offset, seen_offset, error.sum(0))):
                kept += grad**2
                value -= 0.1 * grad / np.sqrt(kept)
    return Model(vectors @ (softmax[:, 1] - softmax[:, 0]), float(offset[1] - offset[0]))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model | None:
    """Learn from a bounded sample of labelled texts outside the held-out third, chosen by a hash of the id; None without
    texts of both labels. The larger label of an id that is labelled twice holds."""
    known = labels.select(labels[id_col].cast("long").alias("id"), labels[label_col].cast("int").alias("label"))
    known = known.where(F.col("id").isNotNull() & F.col("label").isin(0, 1) & ~held_out(F.col("id"), 3, 1)).groupBy("id").agg(F.max("label").alias("label"))
    sizes = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(sizes) < 2:
        return None
    draw = F.shiftrightunsigned(F.xxhash64(F.lit("sample"), "id"), 11) / F.lit(float(1 << 53))
    rate = F.when(F.col("label") == 0, min(1.0, 2 * SAMPLE_EACH / sizes[0])).otherwise(min(1.0, 2 * SAMPLE_EACH / sizes[1]))
    some = known.withColumn("draw", draw).where(F.col("draw") <= rate)
    place = F.row_number().over(Window.partitionBy("label").orderBy("draw", "id"))
    some = some.withColumn("place", place).where(F.col("place") <= SAMPLE_EACH).select("id", "label")
    texts = docs.select(docs[id_col].cast("long").alias("doc"), docs[text_col].cast("string").alias("text"))
    # 2 * SAMPLE_EACH rows of two numbers, so the sample fits any task.
    rows = texts.where(F.octet_length("text") <= SAMPLE_BYTES).join(F.broadcast(some), F.col("doc") == F.col("id"))
    rows = rows.groupBy("id").agg(F.max("label").alias("label"), F.max("text").alias("text")).orderBy("id").collect()
    if len({r["label"] for r in rows}) < 2:
        return None
    return fit([r["text"] for r in rows], np.array([r["label"] for r in rows]))


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted (1 from a score of THRESHOLD on).

    Scores come from the text alone, over all its passages. Texts without words (null, empty, signs only) score 0, as
    does everything if there are no texts of both labels to learn from. Rows without id are scored like any other and
    never learned from; rows that repeat an id count once in learning. Other columns are ignored.
    """
    # A table of BUCKETS numbers, whatever the input.
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels, id_col, text_col, label_col))

    def score(batches):
        for whole in batches:
            for k in range(0, whole.num_rows, 2000):
                batch = whole.slice(k, 2000)
                scores = shared.value.score(batch.column(1)) if shared.value else np.zeros(batch.num_rows)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores)], names=["doc_id", "score"])

    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    scored = rows.mapInArrow(score, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id"), 3, 1).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
