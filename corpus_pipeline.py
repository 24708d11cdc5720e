"""A corpus pipeline: toxicity filter, near-duplicate removal, decontamination, masking of personal data, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before it kept; all but the last return the
columns of documents. The filters judge each row by its own text, whether its doc_id is null or shared.

Edge cases: null texts and texts without a word pass all filters, each row of them, and are packed as one piece with the end
id; of equal rows, and of a group of near duplicates, one row stays, that of the least id (a null id is the greatest), then
of the least hash; very long texts are taken whole; without labels nothing is toxic, without benchmark items nothing is
contaminated; no documents give an empty result; further columns are kept up to packing.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessel.llm import decontamination, ngram_join, packing, pii, toxicity
from tessel.llm.common import n_staged, read, release_staged, ship_package, small_batches, staged


def _keyed(docs: DataFrame) -> DataFrame:
    """docs with _row, a key of the id and the text that is never null."""
    return docs.withColumn("_row", F.xxhash64("doc_id", "text"))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the multiple-instance model rejects; it is fitted on labelled rows of docs."""
    model = toxicity.fit(docs, read(spark, sf_dir, "labels"))
    keyed = _keyed(docs)
    rejected = toxicity.score(keyed, model, id_col="_row").where("predicted = 1").select(F.col("doc_id").alias("_row")).distinct()
    return keyed.join(rejected, "_row", "left_anti").select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents that share three quarters of their shingles, the one with the least id, once; texts without a word stay."""
    keyed = _keyed(docs)
    groups = ngram_join.jaccard_groups(keyed, id_col="_row").where("n_shingles > 0").groupBy(F.col("doc_id").alias("_row"), "component_id")
    groups = staged(groups.agg(F.count(F.lit(1)).alias("n")), "groups")
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "_row")
    first = groups.join(keyed.select("_row", "doc_id"), "_row").groupBy("component_id").agg(F.min(order)["_row"].alias("first"))
    first = staged(first, "first")  # as a table, so that the join with it can be divided where a group is large
    others = groups.join(first, "component_id").where("_row <> first").select("_row")
    repeated = groups.where("n > 1").select("_row")
    left = keyed.join(others, "_row", "left_anti")
    once = left.join(repeated, "_row", "left_semi").dropDuplicates(["_row", "doc_id", "text"])
    return left.join(repeated, "_row", "left_anti").unionByName(once).select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that hold a benchmark item, exactly or nearly."""
    keyed = _keyed(docs)
    held = decontamination.contaminated(keyed, read(spark, sf_dir, "benchmark"), id_col="_row").select(F.col("doc_id").alias("_row")).distinct()
    return keyed.join(held, "_row", "left_anti").select(*docs.columns)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind; n_chars stays the original text's."""
    return pii.mask(docs, pii.fit(docs))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their places in sequences of 4096 tokens."""
    return packing.pack_documents(docs, packing.tokenizer_path(spark))


def _shipping(stage: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """The stage, after the executors have been sent the package and the session takes small batches."""

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        ship_package(spark)
        small_batches(spark)
        return stage(spark, docs, sf_dir)

    return run_stage


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", _shipping(drop_toxic)),
    ("ngram_join", _shipping(drop_near_duplicates)),
    ("decontamination", _shipping(drop_contaminated)),
    ("pii", _shipping(mask_personal_data)),
    ("packing", _shipping(pack_sequences)),
]

#: SQL can express neither the trained models nor the tokenizer; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other, each result but the last written as Parquet and read again; what a stage staged goes when its result is written."""
    docs, before = read(spark, sf_dir, "documents"), n_staged(spark)
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = staged(docs, f"pipeline-{name}")
            release_staged(spark, before, docs)
    return docs
