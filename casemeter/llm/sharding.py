"""Extendible hashing: shards are buckets of a directory indexed by the leading bits of a hash.

A bucket is split on its next bit only while it holds more bytes than the limit, so shards have different depths. Splits are
decided on byte sums by prefix, which are combined map-side; rows are assigned by a look-up of their prefix.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from casemeter.llm.common import written

#: Bits of the hash that the directory can use.
BITS = 60


def hashed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """row, id, hash (60 bits of the MD5 of the id, null as 'null'), bytes (UTF-8; null and empty texts have none)."""
    digest = F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("null")))
    return docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.conv(F.substring(digest, 1, BITS // 4), 16, 10).cast("long").alias("hash"),
        F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)).cast("long").alias("bytes"),
    )


def directory(rows: DataFrame, limit: int, step: int = 8) -> DataFrame:
    """prefix, depth, shard_bytes, shard_docs of each shard. Each round adds up to ``step`` bits to the buckets that are still too large.

    A round is one pass over the rows of those buckets: byte sums by ``step`` more bits are summed up to every shorter
    prefix, and the shortest prefix that fits becomes a shard. Rows whose hashes agree in all bits (the same id, or one
    text beyond the limit) stay in one shard, however large.
    """
    shards, depth, left = [], 0, rows.select("hash", "bytes")
    while True:
        reach = min(step, BITS - depth)
        fine = left.groupBy(F.shiftright("hash", BITS - depth - reach).alias("cell")).agg(F.sum("bytes").alias("bytes"), F.count("*").alias("docs"))
        levels = F.explode(F.array(*[F.struct(F.lit(depth + d).alias("depth"), F.shiftright("cell", reach - d).alias("prefix")) for d in range(reach + 1)])).alias("at")
        sums = fine.select("cell", "bytes", "docs", levels).groupBy("at.depth", "at.prefix").agg(F.sum("bytes").alias("shard_bytes"), F.sum("docs").alias("shard_docs"))
        fits = (F.col("shard_bytes") <= limit) | (F.col("depth") == BITS)
        # A prefix is a shard if it fits and its parent does not; the parent's sum is looked up one bit shorter.
        sums = written(sums)
        parent = sums.where(~fits).select((F.col("depth") + 1).alias("depth"), F.col("prefix").alias("parent"))
        root = sums.where(fits & (F.col("depth") == depth))
        split = sums.where(fits & (F.col("depth") > depth)).withColumn("parent", F.shiftright("prefix", 1)).join(parent, ["depth", "parent"], "left_semi").drop("parent")
        shards += [root, split] if depth == 0 else [split]
        large = sums.where(~fits & (F.col("depth") == depth + reach)).select(F.col("prefix").alias("large"))
        depth += reach
        if depth == BITS or large.isEmpty():
            break
        left = left.join(large, F.shiftright("hash", BITS - depth) == F.col("large"), "left_semi")
    columns = ["prefix", "depth", "shard_bytes", "shard_docs"]
    return written(reduce(DataFrame.union, [s.select(*columns) for s in shards]))


def assign(docs: DataFrame, limit: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, bytes, depth, shard (the prefix as a number), shard_bytes, shard_docs, row: one row per row of ``docs``.

    Rows look up every depth that the directory has (few), at most one of which is a shard of theirs.
    """
    rows = written(hashed(docs, id_col, text_col))
    shards = directory(rows, limit)
    depths = [r[0] for r in shards.select("depth").distinct().orderBy("depth").collect()]
    if not depths:
        depths = [0]
    tries = F.explode(F.array(*[F.struct(F.lit(d).alias("depth"), F.shiftright("hash", BITS - d).alias("prefix")) for d in depths])).alias("at")
    placed = rows.select("row", "id", "bytes", tries).select("row", "id", "bytes", "at.*").join(shards, ["depth", "prefix"])
    return placed.select(F.col("id").alias("doc_id"), "bytes", "depth", F.col("prefix").alias("shard"), "shard_bytes", "shard_docs", "row")


def write_shards(docs: DataFrame, folder: str, limit: int, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write ``docs``, a table read from files, with one folder for each (depth, shard)."""
    at = assign(docs, limit, id_col, text_col).select(F.col("row").alias("_row"), "depth", "shard")
    marked = docs.withColumn("_row", F.monotonically_increasing_id()).join(at, "_row").drop("_row")
    marked.repartition("depth", "shard").write.partitionBy("depth", "shard").parquet(folder)
