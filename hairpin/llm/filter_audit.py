"""Which filter removes what under every order of five document filters.

A document has a mask: which filters it fails. Documents are added up by (part, mask) first, so what follows is 32 rows a part at most.
Of a part, the mask matrix (masks x filters: 0 where the mask fails the filter, infinite elsewhere) is combined by min-plus with the position
matrix (filters x orders: where each filter stands in each order, the inverse of the permutation). The minimum over the filters is the step at
which an order removes a mask, or infinite. Counts of documents, weighted scatters at (order, step), give what is removed; what is
kept is the rest of a running sum; a failed filter that stands behind the removal step is redundant there.

Copies are found by the SHA-256 of the text. What a document's copies need is the least id of its text, so rows are added up by (text, lang,
labels) before they meet it: a group of copies with a third of all rows is a few rows by then.

Defined results: a null text is empty; null and empty language are one part, ``''``; a row without an id fails no filter for being a copy and
makes no other row one; rows of equal id and text are copies of each other's text but none has a smaller id, so they fail it only for a
smaller one; of several labels of an id the largest counts; a document without labels is neither good nor toxic; an empty table gives an
empty table; further columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hairpin.llm.batches import slices
from hairpin.plans.lineage import discard, store

FILTERS = "ABCDE"
#: A: fewer words. B: fewer distinct words of a hundred. C: more capitals of a hundred characters. D: any of the symbols.
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS, SYMBOLS = 100, 80, 10, b"#$%&*|"
#: The bit of the filter for copies in a mask.
_COPY = 1 << FILTERS.index("E")
_CAPITALS = bytes(range(65, 91))
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def mask(text: bytes, characters: int) -> int:
    """The filters that a text fails by itself, as bits."""
    words = text.split()  # of bytes: at space and 09-0D
    n = len(words)
    capitals = len(text) - len(text.translate(None, _CAPITALS))
    failed = (n < LEAST_WORDS, 100 * len(set(words)) < LEAST_DISTINCT * n, 100 * capitals > MOST_CAPITALS * characters, any(x in text for x in SYMBOLS))
    return sum(1 << i for i, x in enumerate(failed) if x)


def text_masks(docs: DataFrame) -> DataFrame:
    """(doc_id, part, digest, own): the text's SHA-256 and its mask without copies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in slices(batches):
            # bytes that begin a character
            starts = np.concatenate([[0], np.cumsum((texts.data & 0xC0) != 0x80)])
            n = np.diff(starts[texts.offsets])
            whole = [texts.text(i) for i in range(len(texts))]
            own = [mask(t, k) for t, k in zip(whole, n.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("part"), pa.array([sha256(t).digest() for t in whole], pa.binary()), pa.array(own, pa.int32())], names=["doc_id", "part", "digest", "own"])

    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("lang", F.lit("")).alias("part"), "text")
    return named.mapInArrow(run, "doc_id long, part string, digest binary, own int")


def mask_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): documents of each part by the filters that they fail."""
    known = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    rows = text_masks(docs).groupBy("doc_id", "part", "digest", "own").agg(F.count("*").alias("n"))
    flag = lambda c: F.coalesce(F.col(c) == 1, F.lit(False))
    rows = rows.join(known, "doc_id", "left").select("doc_id", "part", "digest", "own", "n", flag("quality").alias("good"), flag("toxic").alias("toxic"))
    named = F.col("doc_id").isNotNull()
    # stored, since it is read twice: texts are gone through once
    alike = store(
        rows.groupBy("digest", "part", "own", "good", "toxic").agg(
            F.sum("n").alias("n"), F.sum(F.when(named, F.col("n")).otherwise(0)).alias("named"), F.min("doc_id").alias("least"), F.min_by("n", F.when(named, F.col("doc_id"))).alias("at_least")
        )
    )
    first = alike.groupBy("digest").agg(F.min("least").alias("first"))
    # of rows with one text, labels and part, those at the text's least id are no copies
    copies = F.col("named") - F.when(F.col("least") == F.col("first"), F.col("at_least")).otherwise(0)
    both = alike.join(first, "digest").withColumn("copies", F.coalesce(copies, F.lit(0)))
    sides = F.explode(F.array(F.struct(F.col("own").alias("mask"), (F.col("n") - F.col("copies")).alias("n")), F.struct((F.col("own") + _COPY).alias("mask"), F.col("copies").alias("n"))))
    of = both.select("part", "good", "toxic", sides.alias("x")).where("x.n > 0")
    n = F.col("x.n")
    counts = of.groupBy("part", F.col("x.mask").alias("mask")).agg(F.sum(n).alias("n"), F.sum(F.when(F.col("good"), n).otherwise(0)).alias("good"), F.sum(F.when(F.col("toxic"), n).otherwise(0)).alias("toxic"))
    counts = store(counts)
    discard(alike)
    return counts


def removal_ranks(masks: np.ndarray, positions: np.ndarray) -> np.ndarray:
    """The step, from 0, at which each order removes each mask; len(FILTERS) where none does. Masks as 0 and 1 by filter, positions by
    (filter, order)."""
    cost = np.where(masks, 0, len(FILTERS))
    return np.minimum((cost[:, :, None] + positions[None, :, :]).min(axis=1), len(FILTERS))


def positions() -> tuple[list[str], np.ndarray]:
    """The orders as text, and where each filter stands in each: the inverse permutations, by (filter, order)."""
    orders = list(permutations(range(len(FILTERS))))
    return ["".join(FILTERS[f] for f in o) for o in orders], np.argsort(np.array(orders), axis=1).T


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, filter_order, step, and COUNTS): one row for each part, order of the filters and step, counts of documents in the part."""
    names, place = positions()
    steps, orders = len(FILTERS), len(names)
    at = np.argsort(place, axis=0)  # the filter at each step of each order

    def scatter(rank: np.ndarray, weight: np.ndarray) -> np.ndarray:
        out = np.zeros((orders, steps + 1), np.int64)
        np.add.at(out, (np.broadcast_to(np.arange(orders), rank.shape), rank), np.broadcast_to(weight[:, None], rank.shape))
        return out[:, :steps]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, rows in zip(batch.column("part").to_pylist(), batch.column("rows").to_pylist(), strict=True):
                n, good, toxic = (np.array([r[c] for r in rows], np.int64) for c in ("n", "good", "toxic"))
                failed = (np.array([r["mask"] for r in rows])[:, None] >> np.arange(steps)) & 1
                rank = removal_ranks(failed, place)
                removed = scatter(rank, n)
                behind = np.zeros((orders, steps), np.int64)
                for f in range(steps):
                    late = ((failed[:, f] == 1)[:, None] & (place[f] > rank)) * n[:, None]
                    behind[np.arange(orders), place[f]] = late.sum(axis=0)
                alone = np.array([n[(failed[:, f] == 1) & (failed.sum(axis=1) == 1)].sum() for f in range(steps)])
                share = np.array([removed[np.arange(orders), place[f]].sum() for f in range(steps)])
                columns = (n.sum() - np.cumsum(removed, axis=1), removed, behind, alone[at.T], scatter(rank, good), scatter(rank, toxic), share[at.T])
                size = orders * steps
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part] * size, pa.string()), pa.array(np.repeat(names, steps).tolist(), pa.string()), pa.array(np.tile(np.arange(1, steps + 1), orders), pa.int32()), *[pa.array(c.ravel().astype(np.int64)) for c in columns]],
                    names=["part", "filter_order", "step", *COUNTS],
                )

    # 32 masks a part at most
    parts = mask_counts(docs, labels).groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("rows"))
    return parts.mapInArrow(run, "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in COUNTS))
