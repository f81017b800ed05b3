"""A training corpus from ``documents``: five stages, each of which works on what the last one kept.

1. quality classifier: documents of too high a perplexity go;
2. quality rules: documents that fail the base rules or hold too little content go;
3. line dedup: lines that repeat an earlier one go;
4. SimHash near-dedup: one document of each near-duplicate group (words by five, 0.8) stays;
5. best-fit packing: the token sequences.

Each function takes (spark, docs, sf_dir); all but the last return the columns of ``docs``.  Null ids, null
and empty texts, repeated rows, empty tables and further columns have the results that the operators state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.llm import kneser_ney, line_crf, line_dedup, packing, simhash
from scriptorium.llm.common import OWN
from scriptorium.staging import stage
from scriptorium.tables import table

#: Rejected rows are broadcast up to so many, and joined by shuffle beyond.
BROADCAST_ROWS = 500_000
#: Texts are long, so the pipeline's session sends at most so many rows at once to Python.
BATCH_ROWS = 1_000


def _short_batches(spark: SparkSession) -> None:
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity is within the quantile of their language."""
    _short_batches(spark)
    key = F.concat_ws(":", "doc_id", F.xxhash64("text", "lang"))  # rows of one id only could collide
    judged = kneser_ney.classify(docs.select("doc_id", "lang", "text", key.alias(OWN + "row")), table(spark, sf_dir, "labels"))
    gone = stage(judged.where(~F.col("kept")).select(OWN + "row").distinct(), "rejected")
    gone = F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone
    return docs.withColumn(OWN + "row", key).join(gone, OWN + "row", "left_anti").select(docs.columns)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and whose lines are content for the most part."""
    _short_batches(spark)
    # fitted on the whole table, as the classifier has already removed most labelled boilerplate from docs
    field = line_crf.fit_from_labels(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return docs.withColumn(OWN + "q", line_crf.quality_column(F.col("text"), field)).where(F.col(OWN + "q")["kept"]).drop(OWN + "q")


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that an earlier one repeats."""
    return line_dedup.dedup_lines(docs, count=OWN + "removed", short_copies=True).select(docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group."""
    _short_batches(spark)
    return simhash.keep_first(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 1024 tokens."""
    _short_batches(spark)
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality classifier", quality_classifier),
    ("quality rules", quality_rules),
    ("line dedup", dedup_lines),
    ("simhash near-dedup", near_dedup),
    ("best-fit packing", pack),
]

#: Trained models and local search have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written as Parquet and read again by the next one."""
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), name.replace(" ", "_"))
    return docs
