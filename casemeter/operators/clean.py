"""Label mapping, leakage-safe projections, typing and record keys."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import NumericType

from ..functions.keys import canonical_json, digest, input_key
from ..session import small_table

#: Fixed value: category that stands for a missing one.
MISSING = "__MISSING__"


def map_labels(df: DataFrame, source: str, catalogue: DataFrame, strict: bool = True, out: str = "label") -> DataFrame:
    """Join a closed catalogue ``(name, id)``; an unmapped label is an error when strict."""
    names = small_table(catalogue.select(F.col("name").alias("_name"), F.col("id").cast("int").alias("_id")))
    joined = df.join(names, F.col(source) == F.col("_name"), "left")
    label = F.col("_id")
    if strict:
        label = F.when(label.isNull(), F.raise_error(F.concat(F.lit("unmapped label: "), F.coalesce(F.col(source), F.lit("null")))).cast("int")).otherwise(label)
    return joined.withColumn(out, label).drop("_name", "_id")


def boolean_label(col: Column) -> Column:
    return col.cast("int")


def categorical_strings(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Identifier-like numbers and booleans become categories."""
    return df.withColumns({c: F.col(c).cast("string") for c in cols})


def drop_unavailable(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Remove columns unknown at decision time."""
    return df.drop(*cols)


def guard_features(features: Iterable[str], forbidden: Iterable[str], label: str = "label") -> None:
    """Reject labels, metadata (leading underscore) and late columns among the features."""
    bad = [c for c in features if c == label or c.startswith("_") or c in set(forbidden)]
    if bad:
        raise ValueError(f"columns not available to a model: {sorted(bad)}")


def require_columns(df: DataFrame, required: Iterable[str]) -> None:
    missing = sorted(set(required) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {missing}")


def feature_columns(df: DataFrame, label: str = "label", extra: Sequence[str] = ()) -> list[str]:
    """All columns but the label, metadata and the named targets or identifiers."""
    return [c for c in df.columns if c != label and not c.startswith("_") and c not in set(extra)]


def column_kinds(df: DataFrame, features: Sequence[str]) -> dict[str, str]:
    """``numeric`` or ``categorical`` by declared type."""
    return {
        c: "numeric" if isinstance(df.schema[c].dataType, NumericType) else "categorical"
        for c in features
    }


def with_row_id(df: DataFrame, natural_key: Sequence[str]) -> DataFrame:
    """Order-free row id: the digest of the natural key."""
    return df.withColumn("_row_id", digest(input_key(*natural_key)))


def with_case_id(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Case id = digest of the canonical input record."""
    return df.withColumn("case_id", digest(canonical_json(df.schema, features)))


def fill_features(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str], medians: DataFrame) -> DataFrame:
    """Numeric nulls take the fitted median (zero when a column was empty); categories take a sentinel."""
    fills = {c: F.coalesce(F.col(c).cast("double"), medians.select(c).scalar(), F.lit(0.0)) for c in numeric}
    fills |= {c: F.coalesce(F.col(c).cast("string"), F.lit(MISSING)) for c in categorical}
    return df.withColumns(fills)


def labelled_by_rule(df: DataFrame, rule: Column, out: str = "label") -> DataFrame:
    """Binary label from a boolean rule; an undecidable rule is negative."""
    return df.withColumn(out, F.coalesce(rule, F.lit(False)).cast("int"))


def counterfactual_pairs(df: DataFrame, facts: Sequence[str], flips: Mapping[str, Column], rule: Callable[[Mapping[str, Column]], Column]) -> DataFrame:
    """Two rows per input: the facts as they are, and with the ``flips`` applied.

    ``rule`` maps a fact lookup to a boolean column. Both labels are computed on the one
    input row, so no shuffle brings the members of a pair together; ``pair_relation`` says
    whether the flip changed the outcome.
    """
    before = {c: F.col(c) for c in facts}
    after = before | dict(flips)
    decide = lambda f: F.coalesce(rule(f), F.lit(False)).cast("int")
    member = lambda i, f: F.struct(F.lit(i).alias("member"), *[f[c].alias(c) for c in facts], decide(f).alias("label"))
    relation = F.when(decide(before) == decide(after), "preserve").otherwise("flip")
    rest = [c for c in df.columns if c not in facts]
    members = F.explode(F.array(member(0, before), member(1, after))).alias("_m")
    return df.select(*rest, relation.alias("pair_relation"), members).select(*rest, "pair_relation", "_m.*")


def prefixed(task: str, text: Column) -> Column:
    return F.concat_ws("\n", F.lit(task), text)
