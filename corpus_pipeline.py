"""A training-data pipeline over the documents table: quality, language, near copies, repeated passages, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last keep the columns of documents. Rows that a
stage drops: by quality, those scored under KEEP_SCORE; by language, those without an accepted language; by near copies, all but
the document with the smallest id of each group. Repeated passages are cut out of texts, and n_chars is counted again; the rows stay, also
if no text does.

Defined results: null texts are scored by the bias alone, and have no language, so they go at the second stage; rows with a null doc_id
are never near copies of each other; repeated rows are near copies; of rows with one doc_id and different texts that with the least hash
of its text stays; further columns pass through whatever their names, also those that an operator uses for its own results; an empty
table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hairpin.llm import bm25_packing, jaccard_join, language_id, quality_classifier, suffix_dedup
from hairpin.llm.batches import quoted
from hairpin.llm.queries import BYTE_BPE, tokenizer_path
from hairpin.plans.lineage import discard, store

#: Documents scored lower are rejected.
KEEP_SCORE = 0.4


def _carried(docs: DataFrame, *used: str) -> DataFrame:
    """The columns that an operator reads, and all columns as one that no operator looks into."""
    return docs.select(*used, F.struct(*[F.col(quoted(c)).alias(c) for c in docs.columns]).alias("carried_row"))


def _whole(carried: DataFrame, docs: DataFrame) -> DataFrame:
    return carried.select(*[F.col("carried_row")[c].alias(c) for c in docs.columns])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    known = labels.where("quality IS NOT NULL").groupBy("doc_id").agg(F.max("quality").alias("label"))
    known = known.where(~quality_classifier.held_out("doc_id", quality_classifier.FOLDS, quality_classifier.FOLD))
    weights = quality_classifier.train_by_id(docs, known)
    return _whole(quality_classifier.score(_carried(docs, "text"), weights, threshold=KEEP_SCORE).where("predicted = 1"), docs)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _whole(language_id.identify(_carried(docs, "doc_id", "text", "lang")).where("accepted"), docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    groups = jaccard_join.components(docs)
    kept = groups.where("doc_id = component_id").select("doc_id").distinct()
    named = _carried(docs, "doc_id").join(kept, "doc_id", "left_semi")
    one = named.groupBy("doc_id").agg(F.min_by("carried_row", F.xxhash64("carried_row.text")).alias("carried_row"))
    return _whole(one, docs).unionByName(docs.where("doc_id IS NULL"))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cut = suffix_dedup.remove(_carried(docs, "doc_id", "text"), as_text=True)
    changed = F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("text"))
    new = {"text": changed, "n_chars": F.length(changed).cast("long")}
    return cut.select(*[(new[c] if c in new else F.col("carried_row")[c]).alias(c) for c in docs.columns])


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bm25_packing.pack(docs, tokenizer_path(BYTE_BPE))


STAGES = [
    ("quality_classifier", quality),
    ("language_id", language),
    ("jaccard_join", near_copies),
    ("suffix_dedup", repeated_passages),
    ("bm25_packing", packing),
]

#: Trained models and token ids are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        before, docs = docs, stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = store(docs)
            discard(before)
    return docs
