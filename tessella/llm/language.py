"""Language identification with string kernels, Nyström landmarks and kernel ridge regression."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Features: hashed n-grams of one to ORDER characters.
FEATURES, ORDER = 1 << 15, 3
#: Labelled rows that the classifier is fitted on, for a language and in all, at most (but one for every language), and
#: landmarks, of which every language has one at least. A row is FEATURES bits there, whatever its text's length.
SAMPLE, ROWS, LANDMARKS = 250, 8000, 256
#: Penalty of the ridge regression.
RIDGE = 1.0
#: Characters that are turned into features together; bounds memory, not what is read of a text.
_SLICE, _ROWS = 1 << 20, 64
_MIX = np.array([0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35], np.uint64)


def presence(texts: list[str]) -> np.ndarray:
    """Which hashed n-grams each whole text has: len(texts) x FEATURES booleans.

    Letters count in lower case; runs of others that are no letters count as one blank, so digits, signs
    and layout say nothing.
    """
    seen = np.zeros(len(texts) * FEATURES, bool)
    for n, text in enumerate(texts):
        row = seen[n * FEATURES : (n + 1) * FEATURES]
        carry = np.array([32], np.uint64)  # what n-grams of the next slice begin with
        for at in range(0, max(1, len(text)), _SLICE):
            part = text[at : at + _SLICE].lower()
            codes = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), np.uint32)
            codes = np.concatenate([carry, np.where(_letters(codes), codes, 32).astype(np.uint64)])
            if at + _SLICE >= len(text):
                codes = np.append(codes, np.uint64(32))
            keep = codes != 32
            keep[0] = True
            keep[1:] |= codes[:-1] != 32
            codes = codes[keep]
            carry = codes[1 - ORDER :]
            h = np.zeros(len(codes), np.uint64)
            for k in range(ORDER):
                if len(codes) <= k:
                    break
                h = (h[: len(codes) - k] + codes[k:]) * _MIX[k] & np.uint64(0xFFFFFFFF)
                row[(h ^ (h >> np.uint64(15))) & np.uint64(FEATURES - 1)] = True
    return seen.reshape(len(texts), FEATURES)


_TABLE: list[np.ndarray] = []


def _letters(codes: np.ndarray) -> np.ndarray:
    if not _TABLE:
        _TABLE.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _TABLE[0][codes]


@dataclass
class Classifier:
    """Decision values are (presence @ weights) / sqrt(n-grams present) + bias; bounded by the features."""

    languages: list[str]
    weights: np.ndarray
    bias: np.ndarray

    def values(self, texts: list[str]) -> np.ndarray:
        """Decision values, texts x languages, by one matrix product for each batch."""
        x = presence(texts).astype(np.float32)
        return (x @ self.weights) / np.sqrt(np.maximum(1.0, x.sum(axis=1, keepdims=True))) + self.bias


def fit(texts: list[str], labels: list[str]) -> Classifier:
    return fit_presence(np.packbits(presence(texts), axis=1), labels)


def fit_presence(bits: np.ndarray, labels: list[str]) -> Classifier:
    """One-versus-rest kernel ridge regression on the normalised presence kernel; bits: packed rows of `presence`.

    k(x, z) counts the n-grams that both have, over the geometric mean of how many each has. Landmarks,
    drawn evenly from the labelled texts by language, give Nyström features K_nm K_mm^(-1/2), in which the
    ridge regression on +1/-1 targets is solved. As the kernel is an inner product of presence vectors,
    the landmarks' part folds into one matrix: values are those of the kernel expansion over landmarks.
    """
    languages = sorted(set(labels))
    marks, at = [], 0
    by = {lang: [n for n, x in enumerate(labels) if x == lang] for lang in languages}
    most = min(max(LANDMARKS, len(languages)), len(labels))
    while len(marks) < most:
        marks += [rows[at] for rows in by.values() if at < len(rows)]
        at += 1
    marks = marks[:most]

    def unit(some: list[int] | slice) -> np.ndarray:
        x = np.unpackbits(bits[some], axis=1).astype(np.float32)
        return x / np.sqrt(np.maximum(1.0, x.sum(axis=1, keepdims=True)))

    landmarks = np.concatenate([unit(marks[n : n + _ROWS]) for n in range(0, len(marks), _ROWS)])
    k_nm = np.concatenate([unit(slice(n, n + _ROWS)) @ landmarks.T for n in range(0, len(labels), _ROWS)]).astype(np.float64)
    k_mm = (landmarks @ landmarks.T).astype(np.float64)
    value, vector = np.linalg.eigh(k_mm)
    root = vector @ np.diag(1 / np.sqrt(np.maximum(value, 1e-6))) @ vector.T
    phi = np.column_stack([k_nm @ root, np.ones(len(labels))])
    target = np.array([[1.0 if x == lang else -1.0 for lang in languages] for x in labels])
    # Every language counts the same, however many rows it has.
    weight = np.array([1.0 / len(by[x]) for x in labels])[:, None] * (len(labels) / len(languages))
    penalty = RIDGE * np.eye(phi.shape[1])
    penalty[-1, -1] = 1e-9
    solved = np.linalg.solve(phi.T @ (weight * phi) + penalty, phi.T @ (weight * target))
    return Classifier(languages, (landmarks.T.astype(np.float64) @ (root @ solved[:-1])).astype(np.float32), solved[-1].astype(np.float32))


def train(docs: DataFrame, where: Column, sample: int = SAMPLE) -> Classifier | None:
    """Fits on rows with a label and a letter: of every label, however many there are, at most `sample` distinct
    rows (by id and text; those of least hash), and no more than ROWS for all but one of each; None without any.

    A first pass estimates how many distinct rows each label has; a second keeps about four times what is wanted,
    combined before the shuffle, so copies of a row are one and what is ranked is bounded. What reaches the driver
    of a row are its label and FEATURES bits, so whole texts count, and ROWS * FEATURES / 8 bytes hold them.
    """
    rows = docs.where(where & F.col("lang").isNotNull()).select("lang", F.col("text").cast("string").alias("text"), F.xxhash64("doc_id", "text", F.lit("draw")).alias("h"))
    rows = rows.where(F.col("text").rlike(r"\p{L}"))
    counts = {r["lang"]: r.n for r in rows.groupBy("lang").agg(F.approx_count_distinct("h").alias("n")).collect()}
    if not counts:
        return None
    sample = max(1, min(sample, ROWS // len(counts)))
    share = docs.sparkSession.createDataFrame([(lang, min(1.0, 4.0 * (sample + 16) / n)) for lang, n in counts.items()], "lang string, share double")
    drawn = rows.join(F.broadcast(share), "lang").where(F.pmod("h", F.lit(1 << 20)) < F.col("share") * (1 << 20)).groupBy("lang", "h").agg(F.first("text").alias("text"))
    drawn = drawn.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).where(F.col("k") <= sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, _ROWS):
                some = batch.slice(at, _ROWS)
                bits = np.packbits(presence(some.column(2).to_pylist()), axis=1)
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), pa.array([x.tobytes() for x in bits], pa.binary())], names=["lang", "k", "bits"])

    got = sorted((r["lang"], r.k, bytes(r.bits)) for r in drawn.select("lang", "k", "text").mapInArrow(run, "lang string, k int, bits binary").collect())
    if not got:
        return None
    return fit_presence(np.frombuffer(b"".join(r[2] for r in got), np.uint8).reshape(len(got), -1), [r[0] for r in got])


def not_held_out() -> Column:
    """Rows that may be learnt from: crc32 of the id as text, modulo 4, is not 2 (no id: as the empty text)."""
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(4)) != 2


def scored(c: Classifier | None, column: pa.Array) -> tuple[list[str], list[float]]:
    """Language and score of each text of a column."""
    names, scores = [], []
    for at in range(0, len(column), _ROWS):
        texts = [x.as_py() or "" for x in column.slice(at, _ROWS)]
        known = [c is not None and any(map(str.isalpha, t)) for t in texts]
        if c is not None:
            value = c.values(texts) * 4
            share = np.exp(value - value.max(axis=1, keepdims=True))
            share /= share.sum(axis=1, keepdims=True)
            best = value.argmax(axis=1)
        names += [c.languages[best[n]] if ok else "und" for n, ok in enumerate(known)]
        scores += [float(share[n, best[n]]) if ok else 0.0 for n, ok in enumerate(known)]
    return names, scores


def identify(docs: DataFrame, classifier: Classifier | None) -> DataFrame:
    """docs (doc_id, text) to doc_id, lang_pred, score: the language of each whole text.

    score is the softmax share of the best decision value (0 to 1). A text that is null or without a
    letter is `und` with score 0, as is every text if there was nothing to learn from. The classifier is
    broadcast (FEATURES x languages numbers); texts stream through Arrow batches without a shuffle.
    Ties go to the language first in order; repeated rows stay; only doc_id and text are read. Long texts are
    turned into features a slice at a time, whole. An empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(classifier)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores = scored(shared.value, batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, lang_pred string, score double")


def keep_identified(docs: DataFrame, least: float) -> DataFrame:
    """docs without those whose language is unknown or scores below `least`; learns from labelled rows that
    are not held out. Rows are judged in one pass over the texts and keep all their columns, whatever their names;
    null texts and those without a letter go, repeated rows stay or go together, as do rows that tie; a score of
    `least` stays. An empty table, or one without a label, gives no row."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, not_held_out()))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores = scored(shared.value, batch.column(at))
            yield batch.filter(pa.array([n != "und" and x >= least for n, x in zip(names, scores, strict=True)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
