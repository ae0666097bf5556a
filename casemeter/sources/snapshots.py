"""Snapshot and shard readers, write-once and partitioned writers."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from ..operators.audit import table_difference


def read_snapshot(spark: SparkSession, path: str, schema: str | StructType | None = None) -> DataFrame:
    """Columnar snapshot with an explicit schema (pruned to the scan)."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(path)


def read_shards(spark: SparkSession, paths: Sequence[str], splits: Sequence[str], schema: str | StructType | None = None, strict: bool = True) -> DataFrame:
    """Many shards; the split is the prefix of the file name. An empty split is an error.

    A shard that is a folder of part files has its split in the folder's name, as far as the names of the parts hold none.
    """
    prefix = r"^([A-Za-z]+)"
    reader = spark.read if schema is None else spark.read.schema(schema)
    folders: dict[str, list[str]] = {}
    for path in paths:
        found = re.match(prefix, path.rstrip("/").rsplit("/", 1)[-1])
        folders.setdefault(found[1] if found and found[1] in splits else "", []).append(path)
    own = F.regexp_extract(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1), prefix, 1)
    parts = []
    for name, some in folders.items():
        part = reader.parquet(*some)
        reader = reader.schema(part.schema)  # one schema for all shards
        parts.append(part.select("*", F.when(own.isin(*splits), own).otherwise(F.lit(name)).alias("_official_split")))
    df = reduce(DataFrame.unionAll, parts).where(F.col("_official_split").isin(*splits))
    if strict:
        found = {r[0] for r in df.select("_official_split").distinct().collect()}
        if not set(splits) <= found:
            raise ValueError(f"empty splits: {sorted(set(splits) - found)}")
    return df


def write_once(df: DataFrame, path: str, keys: Sequence[str] | None = None) -> None:
    """Write a snapshot that does not exist yet; an existing one must hold the same rows."""
    spark = df.sparkSession
    try:
        stored = spark.read.parquet(path)
    except Exception as error:  # no readable snapshot at the path
        if "PATH_NOT_FOUND" not in str(error):
            raise
        df.write.mode("errorifexists").parquet(path)
        return
    if table_difference(df, stored, keys or df.columns).limit(1).count():
        raise ValueError(f"the stored snapshot differs: {path}")


def read_delimited(spark: SparkSession, path: str, schema: str | StructType, sep: str = ",", header: bool = True) -> DataFrame:
    return spark.read.schema(schema).options(sep=sep, header=header, mode="FAILFAST").csv(path)


def read_label_text(spark: SparkSession, path: str, label: str = "label", text: str = "text") -> DataFrame:
    """Two fields per line, cut at the first tab only."""
    parts = F.split("value", "\t", 2)
    return spark.read.text(path).select(parts[0].alias(label), parts[1].alias(text))


def read_documents(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """JSON documents, one per file."""
    return spark.read.schema(schema).options(multiLine=True, mode="FAILFAST").json(path)


def read_json_lines(spark: SparkSession, path: str | Sequence[str], schema: str | StructType) -> DataFrame:
    """JSON Lines; a damaged line fails the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def discover_results(spark: SparkSession, root: str, schema: str | StructType, pattern: str, dims: Sequence[str]) -> DataFrame:
    """Result files at any depth; the last folders of the path are the dimensions."""
    df = spark.read.schema(schema).options(recursiveFileLookup=True, pathGlobFilter=pattern, mode="FAILFAST").json(root)
    folders = F.split(F.col("_metadata.file_path"), "/")
    n = len(dims)
    return df.select("*", *[F.element_at(folders, -(n + 1) + i).alias(d) for i, d in enumerate(dims)])


#: Files that one task holds open at a time; records of more dimensions are sorted first.
OPEN_FILES = 64


def write_predictions(df: DataFrame, path: str, dims: Sequence[str] = ("dataset", "model", "seed"), fmt: str = "json") -> None:
    """Compressed records laid out by dimension, so later reads prune to the runs they need.

    A task writes the files of its dimensions side by side, so that its records need no sort.
    """
    spark, name = df.sparkSession, "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(name, None)
    spark.conf.set(name, OPEN_FILES)
    try:
        df.write.partitionBy(*dims).mode("errorifexists").format(fmt).option("compression", "gzip").save(path)
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def write_report(df: DataFrame, path: str, columns: Sequence[str]) -> None:
    """CSV with a fixed column list and a header."""
    df.select(*columns).write.mode("errorifexists").option("header", True).csv(path)
