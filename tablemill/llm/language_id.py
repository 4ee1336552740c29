"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams."""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

#: Hashed n-gram features (2 ** BITS), and the n-gram lengths in characters.
BITS, LENGTHS = 14, (1, 2, 3)
#: Every language is learned. The table of weights has at most so many entries, and fewer features where there are more languages.
WEIGHTS = 1 << 23
#: About so many labelled rows are learned from, in equal parts by language, but at least so many of each language.
SAMPLE_ROWS, LEAST_EACH = 4_000, 10
#: Follow-the-regularised-leader: learning rate, its offset, and the L1 and L2 weights of the elastic net.
ALPHA, BETA, L1, L2, EPOCHS = 0.5, 1.0, 2e-3, 1e-3, 3
UNKNOWN = "und"

_PIECE = 1 << 20
_letters = None


def _is_letter() -> np.ndarray:
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _letters


def ngram_counts(text: str, bits: int = BITS) -> tuple[np.ndarray, bool]:
    """(number of each hashed n-gram of the whole text, whether it has a letter). Case is ignored; every character
    that is no letter counts as a space."""
    total, letters = np.zeros(1 << bits, np.int64), False
    text, longest = text.lower(), max(LENGTHS)
    for at in range(0, len(text), _PIECE):
        first = max(at - longest + 1, 0)
        codes = np.frombuffer(text[first : at + _PIECE].encode("utf-32-le", "replace"), np.uint32)
        letter = _is_letter()[codes]
        letters = letters or bool(letter.any())
        codes = np.where(letter, codes, 32).astype(np.uint64)
        for n in LENGTHS:
            # N-grams that end in this piece.
            own = codes[max(at - n + 1, 0) - first :]
            if len(own) < n:
                continue
            name = np.full(len(own) - n + 1, n, np.uint64)
            for k in range(n):
                name = name * np.uint64(0x100000001B3) + own[k : len(own) - n + 1 + k]
            name = (name * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)
            total += np.bincount(name.astype(np.int64), minlength=1 << bits)
    return total, letters


@dataclass
class Model:
    """Languages, inverse document frequencies, weights of (feature, language), and the temperature."""

    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray
    temperature: float = 1.0

    @property
    def bits(self) -> int:
        return len(self.idf).bit_length() - 1

    def logits(self, at: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Of a text with ``counts`` of the features ``at``."""
        value = np.log1p(counts) * self.idf[at]
        return (value @ self.weights[at]) / max(np.sqrt(value @ value), 1e-12)


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def fit(rows: list[tuple[np.ndarray, np.ndarray, int]], languages: list[str], idf: np.ndarray, seed: int = 3) -> Model:
    """Learn from (features, counts, language number) of each row; every fifth row sets the temperature only."""
    order = np.random.default_rng(seed).permutation(len(rows))
    checks, order = order[::5], np.delete(order, np.s_[::5])
    z, n = np.zeros((len(idf), len(languages))), np.zeros((len(idf), len(languages)))

    def weights(at) -> np.ndarray:
        w = -(z[at] - np.sign(z[at]) * L1) / ((BETA + np.sqrt(n[at])) / ALPHA + L2)
        return np.where(np.abs(z[at]) > L1, w, 0.0)

    for _ in range(EPOCHS):
        for i in order:
            at, counts, label = rows[i]
            x = np.log1p(counts) * idf[at]
            x = x / max(np.sqrt(x @ x), 1e-12)
            w = weights(at)
            error = _softmax(x @ w)
            error[label] -= 1
            g = x[:, None] * error
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
            z[at] += g - sigma * w
            n[at] += g * g
    model = Model(languages, idf, weights(slice(None)))
    logits = [model.logits(*rows[i][:2]) for i in checks]
    if logits:
        logits, labels = np.stack(logits), np.array([rows[i][2] for i in checks])

        def loss(t: float) -> float:
            return -np.log(np.maximum(_softmax(logits / t)[np.arange(len(labels)), labels], 1e-300)).mean()

        model.temperature = min(np.geomspace(0.02, 20, 120), key=loss)
    return model


def train(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model | None:
    """Learn from the rows that have an id, a text and a language; None if there are none.

    Document frequencies count all of these rows, in the tasks. Weights of all languages are learned from a sample of
    SAMPLE_ROWS rows, chosen by a hash of the id in equal parts by language, LEAST_EACH at least, over their whole texts. Memory
    grows with the number of languages only up to WEIGHTS: from 512 languages on, n-grams share more features.
    """
    rows = labelled.select(labelled[id_col].cast("string").alias("id"), labelled[text_col].cast("string").alias("text"), labelled[lang_col].cast("string").alias("lang"))
    rows = rows.where("id is not null and text is not null and lang is not null")
    sizes = rows.groupBy("lang").agg(F.count("*").alias("n"))
    languages = sorted(r["lang"] for r in sizes.select("lang").collect())
    if not languages:
        return None
    bits = min(BITS, max((WEIGHTS // len(languages)).bit_length() - 1, 1))

    def frequencies(batches):
        count, texts = np.zeros(1 << bits, np.int64), 0
        for batch in batches:
            for text in batch.column(0):
                count += ngram_counts(text.as_py(), bits)[0] > 0
                texts += 1
        at = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[at, -1]), pa.array(np.r_[count[at], texts])], names=["feature", "n"])

    found = rows.select("text").mapInArrow(frequencies, "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n")).collect()
    found = {r["feature"]: r["n"] for r in found}
    total, df = found.pop(-1), np.zeros(1 << bits)
    df[list(found)] = list(found.values())
    idf = np.log((1 + total) / (1 + df)) + 1

    each = max(LEAST_EACH, SAMPLE_ROWS // len(languages))
    # One row per language, and these are on the driver already. Texts that do not pass must not be shuffled to meet their rate.
    # Twice as many as wanted pass by rate; of these the first by hash are taken, so the window sees a bounded number.
    rates = sizes.select(F.col("lang").alias("_lang"), F.least(F.lit(1.0), 2 * each / F.col("n") + 1e-6).alias("_rate"))
    draw = F.shiftrightunsigned(F.xxhash64(F.lit("sample"), "id"), 11) / F.lit(float(1 << 53))
    some = rows.withColumn("draw", draw).join(F.broadcast(rates), (F.col("lang") == F.col("_lang")) & (F.col("draw") < F.col("_rate")))
    some = some.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy("draw", "id", "text"))).where(F.col("place") <= each)

    def features(batches):
        for batch in batches:
            at, counts = [], []
            for text in batch.column(0):
                count = ngram_counts(text.as_py(), bits)[0]
                at.append(np.flatnonzero(count).astype(np.int16).tobytes())
                counts.append(count[count > 0].astype(np.float32).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(at, pa.binary()), pa.array(counts, pa.binary())], names=["lang", "draw", "at", "counts"])

    sample = some.select("text", "lang", "draw").mapInArrow(features, "lang string, draw double, at binary, counts binary").collect()
    sample.sort(key=lambda r: (r["draw"], r["lang"], bytes(r["at"])))
    number = {lang: i for i, lang in enumerate(languages)}
    return fit([(np.frombuffer(r["at"], np.int16).astype(np.int64), np.frombuffer(r["counts"], np.float32).astype(float), number[r["lang"]]) for r in sample], languages, idf)


def predict(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """All rows with struct column ``row`` (the input row) and lang_pred, score: the calibrated probability of the language.

    ``und`` with score 0 where the text is null or has no letters, or nothing was learned.
    """
    source = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs[text_col].cast("string").alias("text"))
    # WEIGHTS numbers at most.
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def label(batches):
        known = shared.value
        for batch in batches:
            names, scores = [], []
            for text in batch.column(1):
                counts, letters = ngram_counts(text.as_py(), known.bits) if known and text.is_valid else (None, False)
                if not letters:
                    names.append(UNKNOWN)
                    scores.append(0.0)
                    continue
                at = np.flatnonzero(counts)
                p = _softmax(known.logits(at, counts[at]) / known.temperature)
                names.append(known.languages[int(p.argmax())])
                scores.append(float(p.max()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["row", "lang_pred", "score"])

    schema = source.select("row").schema.add("lang_pred", "string").add("score", "double")
    return source.mapInArrow(label, schema)


def held_out(identifier, parts: int, part: int):
    """Whether the id falls into the part that is never learned from; rows without id do not."""
    return F.coalesce(F.crc32(identifier.cast("string").cast("binary")) % parts == part, F.lit(False))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per input row: doc_id, held_out, lang_pred, score.

    Learned from the rows outside the held-out fourth that have an id, a text and a language; predicted from the text
    alone. Null, empty and letterless texts are ``und`` with score 0. Repeated rows are rows like any other; with
    nothing to learn from, all is ``und``. Other columns are ignored.
    """
    model = train(docs.where(~held_out(docs[id_col], 4, 2)), id_col, text_col, lang_col)
    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    out = predict(rows.select("doc_id", "text"), model)
    return out.select("row.doc_id", held_out(F.col("row.doc_id"), 4, 2).alias("held_out"), "lang_pred", "score")


def with_language(docs: DataFrame, least: float = 0.3, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows whose language is known with a score of at least ``least``, with all their columns."""
    model = train(docs.where(~held_out(docs[id_col], 4, 2)), id_col, text_col, lang_col)
    return predict(docs, model, text_col).where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least)).select("row.*")
