"""Exact dedup against a persistent index of digests, by DataFrame functions alone.

Texts are equal when they are identical after each run of white space has become one space. The index is a table bucketed
and sorted by digest, with one row per text. New data is reduced to its first rows (combined map-side, so that a group of
copies of any size costs one row per task), anti-joined to the index by sort-merge, and what is new is appended.
Only digests are shuffled, never texts.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from casemeter.llm.common import without, written
from casemeter.session import shared_folder


def text_digest(text_col: str = "text") -> Column:
    """SHA-256 of the normalised text; a null text counts as empty."""
    return F.unhex(F.sha2(F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), r"[\x20\x09-\x0D]+", " "), 256))


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """row, id, digest of every row. ``row`` tells repeated rows apart once the result is written."""
    row = F.col(row_col) if row_col else F.monotonically_increasing_id()
    return docs.select(row.alias("row"), F.col(id_col).alias("id"), text_digest(text_col).alias("digest"))


class DigestIndex:
    """A table (digest, keep_id, keep_row) in ``folder``, bucketed and sorted by digest; opened again by naming its folder."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int = 64):
        self.spark, self.buckets = spark, buckets
        self.name = f"digest_index_{hashlib.md5(folder.encode()).hexdigest()}"
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.name} (digest BINARY, keep_id BIGINT, keep_row BIGINT) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{folder}'"
        )

    def table(self) -> DataFrame:
        return self.spark.table(self.name)

    def add(self, rows: DataFrame) -> None:
        """Append the texts of ``rows`` (row, id, digest) that the index lacks. Of equal texts in one call the smallest
        (id, row) stands for all, null ids last; a text already there keeps its first document. After a failed call the
        same call may be repeated: what was appended is found by the anti-join."""
        first = rows.groupBy("digest").agg(F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "row")).alias("first"))
        first = first.select("digest", F.col("first.id").alias("keep_id"), F.col("first.row").alias("keep_row"))
        fresh = first.repartition(self.buckets, "digest").hint("merge").join(self.table().select("digest"), "digest", "left_anti")
        fresh.write.insertInto(self.name)

    def classify(self, rows: DataFrame) -> DataFrame:
        """row, id, digest, keep_id, group_size, kept. The size counts ``rows``; a hot digest is split by adaptive joins."""
        sizes = rows.groupBy("digest").agg(F.count("*").alias("group_size"))
        groups = sizes.repartition(self.buckets, "digest").hint("merge").join(self.table(), "digest")
        return rows.join(groups, "digest").select("row", "id", "digest", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"))

    def drop(self) -> None:
        """Forget the table's name; its files stay."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int | None = None, loads: int = 2, row_col: str | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    A new index takes the rows in ``loads`` loads by rising id, as a growing corpus would arrive, so the row with the
    smallest id stays. Rows without id come in the last load; among rows equal in id and text one stays. Empty tables give
    no rows; other columns, whatever their names, are not read.
    """
    spark = docs.sparkSession
    rows = written(digests(docs, id_col, text_col, row_col))
    low, high = rows.agg(F.min("id"), F.max("id")).first()
    index = DigestIndex(spark, f"{shared_folder(spark)}/index", buckets or int(spark.conf.get("spark.sql.shuffle.partitions")))
    load = F.lit(loads - 1)
    if low is not None:
        load = F.coalesce(F.least(F.lit(loads - 1), F.floor((F.col("id") - low) * loads / (high - low + 1))), load)
    for k in range(loads):
        index.add(rows.where(load == k))
    return index.classify(rows).select(
        F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"), "row"
    )


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with their columns; of rows equal in id and text one stays.

    The rows are numbered in a written copy, so a recomputed task finds the same ones. ``docs`` may have any columns but
    ``_casemeter_dedup_row``.
    """
    mark = "_casemeter_dedup_row"
    docs = written(docs.withColumn(mark, F.monotonically_increasing_id()))
    gone = deduplicate(docs, id_col, text_col, row_col=mark).where("not kept").select(F.col("row").alias(mark))
    return without(docs, gone, mark).drop(mark)
