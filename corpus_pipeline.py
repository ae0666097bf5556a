"""A corpus from raw documents to token ids, in five stages; each works on all that its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from casemeter.llm import exact_dedup, line_crf, minhash_dedup, nbest_pieces, spaced_seeds
from casemeter.llm.common import table, without, written
from casemeter.llm.queries import MODEL

#: A name that no input column has; it marks rows inside a stage.
_ROW = "_casemeter_stage_row"


def _marked(docs: DataFrame) -> DataFrame:
    """``docs`` as a written table with a number for each row, so that a decision finds its row whatever is recomputed."""
    return written(docs.withColumn(_ROW, F.monotonically_increasing_id()))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line field takes for good. It is trained on the labelled rows of ``docs``."""
    return line_crf.keep_good(docs, line_crf.train(docs, table(spark, sf_dir, "labels")))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each text."""
    return exact_dedup.keep_first(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five-word shingles, similarity of 0.8 or more."""
    docs = _marked(docs)
    gone = minhash_dedup.classify(docs, size=5, percent=80, row_col=_ROW).where("not first").select(F.col("row").alias(_ROW))
    return without(docs, gone, _ROW).drop(_ROW)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark. The text alone decides, so its digest finds the rows and no copy is written."""
    text = F.coalesce("text", F.lit(""))
    docs = docs.withColumn(_ROW, F.substring(F.unhex(F.sha2(text, 256)), 1, 16))
    rows = docs.select(F.col(_ROW).alias("row"), text.alias("text"))
    found = spaced_seeds.matches(rows, table(spark, sf_dir, "benchmark"), short_items=True).select(F.col("row").alias(_ROW))
    return without(docs, found, _ROW).drop(_ROW)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids and the scores of the best segmentations of each document."""
    return nbest_pieces.encode(docs, MODEL)


STAGES = [("quality", quality), ("exact", exact), ("near", near), ("decontaminate", decontaminate), ("tokens", tokens)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir))
    return docs
