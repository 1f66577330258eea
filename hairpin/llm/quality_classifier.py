"""Quality classifier: logistic regression on hashed word n-grams, trained by follow-the-regularised-leader updates.

A document is a sparse vector: its lower-cased words and word pairs hashed to 2^BITS features with weight
sqrt(count), scaled to length one, and a bias. The updates follow one another, so one task makes them, over a sample of
some SAMPLE_ROWS different labelled texts, or of SAMPLE_BYTES of them, whatever the size of the corpus. Copies of a text
count once, in the size of the sample too, so a table of few texts repeated often is learned from whole. Scores are sparse dot products with the weights (2^BITS
float32, the bounded size that is sent to the executors) in every task.

Defined results: a null or blank text has only the bias; very long texts count whole; repeated rows get equal scores; an empty
table gives an empty table; without labelled rows every score is 0.5.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hairpin.llm.batches import Texts, arrow_rows, held_out, map_texts, mix, slices, span_hashes

BITS = 18
FOLDS, FOLD = 4, 2
#: Different labelled texts that are expected in the bounded training sample, by a hash of the text; all of them where there are fewer.
SAMPLE_ROWS = 12_000
#: Bytes of text that are expected in it at most; one text counts as TEXT_BYTES at most, as it has no more than 2^BITS features.
SAMPLE_BYTES = 64 << 20
TEXT_BYTES = 1 << 20
#: Updates that the learner makes at least, in 2 to 8 passes over the sample.
UPDATES = 24_000
#: FTRL-proximal: learning rate, its smoothing, and the two penalties.
ALPHA, BETA, L1, L2 = 2.0, 1.0, 0.01, 0.01
THRESHOLD = 0.7
_U = np.uint64


def features(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first, feature, value): rows first[i]:first[i + 1] are document i's distinct features; 0 is the bias."""
    low = texts.lowered()
    start, end, first = low.words()
    h = span_hashes(low.data, start, end)
    doc = np.repeat(np.arange(len(texts)), np.diff(first))
    pair = mix(h[:-1] * _U(3) + h[1:])[doc[:-1] == doc[1:]] if len(h) else h
    pair_doc = doc[:-1][doc[:-1] == doc[1:]] if len(h) else doc
    size = _U((1 << BITS) - 1)
    n = len(texts)
    key = np.concatenate([(doc.astype(_U) << _U(BITS)) | (h % size + _U(1)), (pair_doc.astype(_U) << _U(BITS)) | (pair % size + _U(1))])
    key.sort()
    new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    value = np.sqrt(np.diff(np.append(new, len(key)))).astype(np.float64)
    key = key[new]
    owner, feature = (key >> _U(BITS)).astype(np.int64), (key & size).astype(np.int64)
    norm = np.sqrt(np.bincount(owner, value * value, n))
    value /= norm[owner] if len(owner) else 1
    at = np.searchsorted(owner, np.arange(n + 1))
    # the bias leads each document
    feature, value = np.insert(feature, at[:-1], 0), np.insert(value, at[:-1], 1.0)
    return at + np.arange(n + 1), feature, value


def _ftrl(first: np.ndarray, feature: np.ndarray, value: np.ndarray, label: np.ndarray, z: np.ndarray, n: np.ndarray) -> None:
    """One pass in place over the documents in order."""
    for i in range(len(label)):
        f, x = feature[first[i] : first[i + 1]], value[first[i] : first[i + 1]]
        zf, nf = z[f], n[f]
        w = np.where(np.abs(zf) <= L1, 0.0, (np.sign(zf) * L1 - zf) / ((BETA + np.sqrt(nf)) / ALPHA + L2))
        p = 1 / (1 + np.exp(-min(35.0, max(-35.0, float(w @ x)))))
        g = (p - label[i]) * x
        after = nf + g * g
        z[f] = zf + g - (np.sqrt(after) - np.sqrt(nf)) / ALPHA * w
        n[f] = after


def weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
    return np.where(np.abs(z) <= L1, 0.0, (np.sign(z) * L1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2)).astype(np.float32)


def keyed(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with its text (null: empty) under the name text, its hash h and its bytes n_bytes."""
    docs = docs.withColumn("text", F.coalesce(F.col(text), F.lit("")))
    return docs.withColumns({"h": F.xxhash64("text", F.lit(11)), "n_bytes": F.least(F.octet_length("text"), F.lit(TEXT_BYTES))})


def train(labelled: DataFrame, text: str = "text", label: str = "label") -> np.ndarray:
    """Weights from rows of (text, label 0 or 1); rows with null labels don't count. 2^BITS numbers."""
    return _train(keyed(labelled.select(F.col(text).alias("text"), F.col(label).cast("double").alias("label"))))


def train_by_id(docs: DataFrame, known: DataFrame) -> np.ndarray:
    """Weights from the texts of ``docs`` (doc_id, text) that ``known`` (doc_id, label) has labels for.

    Texts are hashed before they meet their labels, so that only those of the sample are moved whole.
    """
    return _train(keyed(docs.select("doc_id", "text")).join(known.select("doc_id", F.col("label").cast("double").alias("label")), "doc_id"))


def _train(rows: DataFrame) -> np.ndarray:
    """Weights from rows of (text, h, n_bytes, label)."""
    spark = rows.sparkSession
    usable = rows.where(F.col("label").isNotNull())
    # copies meet before the shuffle
    size = usable.groupBy("h").agg(F.max("n_bytes").alias("n")).agg(F.count("*").alias("texts"), F.sum("n").alias("bytes")).first()
    if not size["texts"]:
        return np.zeros(1 << BITS, np.float32)
    share = min(1.0, SAMPLE_ROWS / size["texts"], SAMPLE_BYTES / max(1, size["bytes"]))
    sample = usable.where(F.pmod("h", F.lit(1 << 30)) <= F.lit(int(share * (1 << 30)))).select("text", "h", "label")
    arrow_rows(spark)

    def compress(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches):
            first, feature, value = features(texts)
            rows = [(feature[a:b].astype(np.int32).tobytes(), value[a:b].astype(np.float32).tobytes()) for a, b in zip(first[:-1], first[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([part.column("h"), part.column("label"), pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.binary())], names=["h", "label", "f", "x"])

    # copies of one text are one training row
    rows = sample.mapInArrow(compress, "h long, label double, f binary, x binary").groupBy("h", "label").agg(F.first("f").alias("f"), F.first("x").alias("x"))

    def learn(table: pa.Table) -> pa.Table:
        table = table.sort_by([("h", "ascending"), ("label", "ascending")])
        f = [np.frombuffer(x, np.int32) for x in table.column("f").to_pylist()]
        x = [np.frombuffer(x, np.float32).astype(np.float64) for x in table.column("x").to_pylist()]
        first = np.concatenate([[0], np.cumsum([len(a) for a in f])])
        feature, value, y = np.concatenate(f), np.concatenate(x), table.column("label").to_numpy()
        z, n = np.zeros(1 << BITS), np.zeros(1 << BITS)
        for _ in range(min(8, max(2, round(UPDATES / len(y))))):
            _ftrl(first, feature, value, y, z, n)
        return pa.table({"w": pa.array([weights(z, n).tobytes()], pa.binary())})

    learned = rows.groupBy(F.lit(0).alias("g")).applyInArrow(learn, "w binary").first()
    return np.frombuffer(learned["w"], np.float32) if learned else np.zeros(1 << BITS, np.float32)


def score(docs: DataFrame, w: np.ndarray, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with score double and predicted int; these replace columns so named."""
    arrow_rows(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(w)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for part, texts in slices(batches):
            first, feature, value = features(texts)
            p = 1 / (1 + np.exp(-np.clip(np.add.reduceat(w[feature] * value, first[:-1]), -35, 35)))
            yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(p, pa.float64()), pa.array((p >= threshold).astype(np.int32))], names=["row", "score", "predicted"])

    return map_texts(docs, text, "score double, predicted int", run)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Learns from labelled rows outside the held-out fold; scores every row of ``docs`` from its text."""
    known = labels.where(F.col("quality").isNotNull()).groupBy("doc_id").agg(F.max("quality").alias("label"))
    known = known.where(~held_out("doc_id", FOLDS, FOLD))
    w = train_by_id(docs, known)
    return score(docs.withColumn("held_out", held_out("doc_id", FOLDS, FOLD)), w)
