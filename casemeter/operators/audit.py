"""Fingerprints, freezing, split verification, recomputation and merging."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.keys import canonical_json, digest
from ..session import checkpointed
from .dedup import signed_difference


def row_digest(df: DataFrame, cols: Sequence[str] | None = None) -> Column:
    return digest(canonical_json(df.schema, list(cols or df.columns)))


def fingerprint(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Content fingerprint independent of row order and file layout: the root of :func:`hash_tree`."""
    return hash_tree(df, cols).where("level = 0").select("rows", F.col("digest").alias("fingerprint"))


#: Places of the words of a digest that are summed: five of 48 bits, one of 16.
_WORDS = tuple((1 + 12 * k, 12 if k < 5 else 4) for k in range(6))


def hash_tree(df: DataFrame, cols: Sequence[str] | None = None, depth: int = 2) -> DataFrame:
    """``level, bucket, rows, digest``: a tree over the buckets of the row digests' first ``depth`` hex digits.

    A leaf's digest covers its number of rows and the sums of all 256 bits of their digests, word by word, so it does not depend on
    their order and every row counts as often as it is there; the sums are combined map-side. A parent's digest covers its
    children's. Level 0 has the root, with an empty bucket; an empty table has a root without children.
    """
    d = df.select(row_digest(df, cols).alias("_d"))
    words = [F.sum(F.conv(F.substring("_d", at, n), 16, 10).cast("decimal(38,0)")).cast("string") for at, n in _WORDS]
    leaves = d.groupBy(F.substring("_d", 1, depth).alias("bucket")).agg(F.count(F.lit(1)).alias("rows"), F.array(*words).alias("_s"))
    level = leaves.select("bucket", "rows", F.sha2(F.concat_ws(":", "bucket", F.col("rows").cast("string"), "_s"), 256).alias("digest"))
    level = checkpointed(level)  # 16 ** depth rows at most
    out = level.withColumn("level", F.lit(depth))
    for k in range(depth - 1, -1, -1):
        above = [F.substring("bucket", 1, k).alias("bucket")] if k else []
        line = F.concat_ws(":", "bucket", "digest")
        level = level.groupBy(*above).agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"), F.sha2(F.array_join(F.array_sort(F.collect_list(line)), "\n"), 256).alias("digest"))
        level = level if k else level.withColumn("bucket", F.lit(""))
        out = out.unionByName(level.withColumn("level", F.lit(k)))
    return out.select("level", "bucket", "rows", "digest")


def tree_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """``bucket, rows_a, rows_b`` of the leaves of two hash trees that differ, found from the root down: equal subtrees are not entered."""
    pairs = a.select("level", "bucket", F.col("rows").alias("rows_a"), F.col("digest").alias("_a")).join(
        b.select("level", "bucket", F.col("rows").alias("rows_b"), F.col("digest").alias("_b")), ["level", "bucket"], "full_outer"
    )
    pairs = checkpointed(pairs.where(~F.col("_a").eqNullSafe(F.col("_b"))).fillna(0, ["rows_a", "rows_b"]))
    depth = pairs.agg(F.max("level")).first()[0] or 0
    open_ = pairs.where("level = 0")
    for k in range(1, depth + 1):
        above = open_.select(F.col("bucket").alias("_up"))
        open_ = pairs.where(F.col("level") == k).join(above, F.substring("bucket", 1, k - 1) == F.col("_up"), "left_semi")
    return open_.select("bucket", "rows_a", "rows_b")


def table_difference(new: DataFrame, stored: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Row digests whose multiplicity differs: one digest shuffle instead of two set differences."""
    a = new.select(row_digest(new, cols).alias("row_digest"))
    b = stored.select(row_digest(stored, cols).alias("row_digest"))
    return signed_difference(a, b, ["row_digest"])


def violations(*tables: DataFrame) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def _violation(df: DataFrame, rule: str, key: Column, detail: Column) -> DataFrame:
    return df.select(F.lit(rule).alias("rule"), key.cast("string").alias("key"), detail.cast("string").alias("detail"))


def split_violations(
    splits: DataFrame,
    case_id: str = "case_id",
    partition: str = "partition",
    pair_id: str | None = None,
    official: str | None = None,
    recomputed_id: Column | None = None,
    test_name: str = "test",
) -> DataFrame:
    """Violations ``(rule, key, detail)`` of a split; empty when it is sound."""
    per_case = splits.groupBy(case_id).agg(
        F.count(F.lit(1)).alias("n"), F.min(partition).alias("lo"), F.max(partition).alias("hi")
    )
    found = [
        _violation(per_case.where("n > 1 and lo = hi"), "duplicate row", F.col(case_id), F.col("n")),
        _violation(per_case.where("lo <> hi"), "overlapping partitions", F.col(case_id), F.concat_ws("/", "lo", "hi")),
    ]
    if recomputed_id is not None:
        found.append(_violation(splits.where(~recomputed_id.eqNullSafe(F.col(case_id))), "case id changed", F.col(case_id), recomputed_id))
    if pair_id is not None:
        pairs = splits.where(F.col(pair_id).isNotNull()).groupBy(pair_id).agg(
            F.count(F.lit(1)).alias("n"), F.min(partition).alias("lo"), F.max(partition).alias("hi")
        )
        found.append(_violation(pairs.where("n <> 2"), "incomplete pair", F.col(pair_id), F.col("n")))
        found.append(_violation(pairs.where("lo <> hi"), "pair crosses partitions", F.col(pair_id), F.concat_ws("/", "lo", "hi")))
    if official is not None:
        required = F.when(F.col(partition) == test_name, F.lit("test")).otherwise(F.lit("train"))
        crossed = splits.where(~F.col(official).eqNullSafe(required))
        found.append(_violation(crossed, "official boundary crossed", F.col(case_id), F.col(official)))
    return violations(*found)


def require_none(found: DataFrame, what: str = "violations") -> None:
    """Turn a non-empty violations table into an error that shows a few of them."""
    sample = found.limit(5).collect()
    if sample:
        raise ValueError(f"{what}: {[tuple(r) for r in sample]}")


def summary_mismatches(stored: DataFrame, recomputed: DataFrame, dims: Sequence[str], measures: Sequence[str]) -> DataFrame:
    """Stored measures that raw predictions do not reproduce (including missing groups)."""
    long = lambda df: df.unpivot(list(dims), list(measures), "measure", "value")
    keys = [*dims, "measure"]
    a = long(stored.select(*dims, *[F.col(m).cast("double") for m in measures])).withColumnRenamed("value", "stored")
    b = long(recomputed.select(*dims, *[F.col(m).cast("double") for m in measures])).withColumnRenamed("value", "recomputed")
    both = a.withColumn("_a", F.lit(True)).join(b.withColumn("_b", F.lit(True)), keys, "full_outer")
    differs = F.col("_a").isNull() | F.col("_b").isNull() | ~F.col("stored").eqNullSafe(F.col("recomputed"))
    return both.where(differs).drop("_a", "_b")


def snapshot_mismatches(predictions: DataFrame, snapshot: DataFrame, keys: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """Predictions that do not match the frozen snapshot: missing, extra, or other labels/context."""
    a = predictions.select(*keys, F.struct(*fields).alias("_p"), F.lit(1).alias("_in_p"))
    b = snapshot.select(*keys, F.struct(*fields).alias("_s"), F.lit(1).alias("_in_s"))
    both = a.join(b, list(keys), "full_outer")
    changed = F.array_join(F.array_compact(F.array(*[F.when(~F.col(f"_p.{f}").eqNullSafe(F.col(f"_s.{f}")), f) for f in fields])), ",")
    problem = F.when(F.col("_in_p").isNull(), "missing prediction").when(F.col("_in_s").isNull(), "unknown case").when(changed != "", F.concat(F.lit("changed: "), changed))
    return both.withColumn("problem", problem).where(F.col("problem").isNotNull()).select(*keys, "problem")


def run_mixture(df: DataFrame, scope: Sequence[str], run_id: str = "run_id") -> DataFrame:
    """Scopes that mix several run identities."""
    return df.groupBy(*scope).agg(F.min(run_id).alias("lo"), F.max(run_id).alias("hi")).where(F.col("lo") != F.col("hi"))


def run_identity(config: Column, source: Column) -> Column:
    return digest(F.to_json(F.struct(config.alias("config"), source.alias("source"))))


def merge_conflicts(artefacts: DataFrame, path: str = "path", checksum: str = "checksum", source: str = "source") -> DataFrame:
    """Artefacts that runs hold with different content, and the runs that hold them."""
    held = F.array_join(F.array_sort(F.collect_set(source)), ",")
    seen = artefacts.groupBy(path).agg(F.min(checksum).alias("_lo"), F.max(checksum).alias("_hi"), F.count(F.lit(1)).alias("copies"), held.alias("sources"))
    return seen.where(F.col("_lo") != F.col("_hi")).select(path, "copies", "sources")


def study_conflicts(runs: DataFrame) -> DataFrame:
    """``source, rule, detail``: runs (source, study, dataset, fingerprint) that belong to another study or saw other data than the first by name.

    Every run must name the same study, have every dataset, and have it with the same fingerprint.
    """
    first = runs.agg(F.min("source")).scalar()
    own = runs.where(F.col("source") == first).select("dataset", F.col("study").alias("_study"), F.col("fingerprint").alias("_print"))
    others = runs.where(F.col("source") != first)
    grid = others.select("source").distinct().crossJoin(own)  # sources x datasets, both declared lists
    both = grid.join(others, ["source", "dataset"], "full_outer")
    rule = (
        F.when(F.col("_print").isNull(), "dataset is not in the first run")
        .when(F.col("fingerprint").isNull(), "dataset is missing")
        .when(~F.col("study").eqNullSafe(F.col("_study")), "another study")
        .when(F.col("fingerprint") != F.col("_print"), "another inventory")
    )
    return both.withColumn("rule", rule).where("rule is not null").select("source", "rule", F.col("dataset").alias("detail"))


def merge_runs(artefacts: DataFrame, path: str = "path", checksum: str = "checksum", runs: DataFrame | None = None, source: str = "source") -> DataFrame:
    """One copy per artefact. Runs of another study or inventory (``runs`` as in :func:`study_conflicts`) and artefacts with
    different content are errors before anything is written."""
    if runs is not None:
        require_none(study_conflicts(runs), "runs that cannot be merged")
    require_none(merge_conflicts(artefacts, path, checksum, source), "conflicting artefacts")
    rest = [c for c in artefacts.columns if c != path]
    return artefacts.groupBy(path).agg(F.min_by(F.struct(*rest), F.struct(*rest)).alias("_r")).select(path, "_r.*")


def incomplete_jobs(predictions: DataFrame, frozen: DataFrame, dims: Sequence[str]) -> DataFrame:
    """Jobs whose number of predictions differs from the frozen partition."""
    a = frozen.groupBy(*dims).agg(F.count(F.lit(1)).alias("expected"))
    b = predictions.groupBy(*dims).agg(F.count(F.lit(1)).alias("found"))
    both = a.join(b, list(dims), "full_outer").fillna(0, ["expected", "found"])
    return both.where(F.col("expected") != F.col("found"))


def with_provenance(df: DataFrame, run_id: str, sources: dict[str, str]) -> DataFrame:
    """Environment and source digests as constant columns."""
    spark = df.sparkSession
    facts = {"run_id": run_id, "spark_version": spark.version, **{f"source_{k}": v for k, v in sources.items()}}
    return df.withColumns({k: F.lit(v) for k, v in facts.items()})


