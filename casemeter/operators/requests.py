"""Decision requests, response validation, and input audits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.keys import digest
from ..functions.probability import normalised

#: Per-million-byte input price unit, the status codes worth a retry, and
#: the tolerances of a probability sum (current and earlier protocol).
PRICE_UNIT = 1e6
RETRY_CODES = (408, 429, 500, 502, 503, 504)
SUM_TOLERANCE = 0.005
EARLIER_SUM_TOLERANCE = 0.01


def choice_array(choices: Sequence[tuple[str, str]]) -> Column:
    """Ordered choices; an array because order is part of a request's identity."""
    return F.array(*[F.struct(F.lit(i).alias("id"), F.lit(d).alias("description")) for i, d in choices])


def with_request(df: DataFrame, state: Column, instructions: str, choices: Sequence[tuple[str, str]], model: str | None = None) -> DataFrame:
    """Add the request JSON and its digest."""
    fields = [state.alias("state"), F.lit(instructions).alias("instructions"), choice_array(choices).alias("choices")]
    if model is not None:
        fields.append(F.lit(model).alias("model"))
    return df.withColumn("request", F.to_json(F.struct(*fields))).withColumn("request_hash", digest("request"))


def request_status(state: str = "state", instructions: str = "instructions", choices: str = "choices") -> Column:
    """``ok`` or the first reason why a request is not valid."""
    c = F.col(choices)
    ids = F.transform(c, lambda x: x["id"])
    filled = F.forall(c, lambda x: (F.length(F.trim(x["id"])) > 0) & (F.length(F.trim(x["description"])) > 0))
    blank = lambda col: F.coalesce(F.length(F.trim(F.col(col))), F.lit(0)) == 0
    return (
        F.when(blank(state), "empty state")
        .when(blank(instructions), "empty instructions")
        .when(F.size(c) < 2, "too few choices")
        .when(F.size(F.array_distinct(ids)) < F.size(c), "choices not distinct")
        .when(~filled, "empty choice")
        .otherwise("ok")
    )


def separate_context(df: DataFrame, case_id: str, inputs: Sequence[str], context: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Model input and evaluation context as two tables that share only the case id."""
    shared = set(inputs) & set(context)
    if shared:
        raise ValueError(f"evaluation context would reach the model: {sorted(shared)}")
    return df.select(case_id, *inputs), df.select(case_id, *context)


def with_exemplars(cases: DataFrame, exemplars: DataFrame, order: Sequence[str]) -> DataFrame:
    """Attach the same short exemplar list to every request.

    The list has ``k`` rows per class, so it is one bounded value: a scalar subquery, not a join.
    """
    shots = exemplars.agg(F.array_sort(F.collect_list(F.struct(*order))).alias("shots")).scalar()
    return cases.withColumn("shots", shots)


def validate_responses(df: DataFrame, body: str, labels: Sequence[str], tolerance: float = SUM_TOLERANCE) -> DataFrame:
    """Add ``status``, ``prediction`` and normalised ``probabilities`` from response bodies.

    Values are checked by their JSON type before any cast: a boolean is not a probability.
    """
    parsed = F.try_parse_json(F.col(body))
    base = "$.answers.classification"
    choice = F.try_variant_get(parsed, f"{base}.choice", "string")
    keys = F.json_object_keys(F.get_json_object(body, f"{base}.probabilities"))
    # Labels with a dot or a quote would need an escaped path, so the object is read as a map.
    members = F.try_variant_get(parsed, f"{base}.probabilities", "map<string,variant>")
    value = lambda k: F.try_element_at(members, F.lit(k))
    kind = lambda k: F.schema_of_variant(value(k))
    numeric = lambda k: kind(k).rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)")
    number = lambda k: F.try_variant_get(value(k), "$", "double")
    probabilities = F.array(*[F.when(numeric(k), number(k)) for k in labels])
    expected = F.array(*[F.lit(k) for k in labels])
    covers = (F.size(keys) == len(labels)) & (F.size(F.array_except(keys, expected)) == 0) & (F.size(F.array_except(expected, keys)) == 0)
    in_range = F.forall(F.col("_p"), lambda x: x.isNotNull() & ~F.isnan(x) & (x >= 0.0) & (x <= 1.0))
    total = F.aggregate(F.col("_p"), F.lit(0.0), lambda a, x: a + x)
    reason = (
        F.when(F.col("_parsed").isNull(), "not json")
        .when(F.col("_choice").isNull() | ~F.col("_choice").isin(*labels), "unknown choice")
        .when(~F.coalesce(F.col("_covers"), F.lit(False)), "choices not covered")
        .when(~F.coalesce(in_range, F.lit(False)), "invalid value")
        .when(F.abs(total - 1.0) > F.lit(tolerance), "sum differs from one")
    )
    staged = df.withColumns({"_parsed": parsed, "_choice": choice, "_covers": covers, "_p": probabilities})
    checked = staged.withColumn("reason", reason).withColumn("status", F.when(F.col("reason").isNull(), "ok").otherwise("invalid"))
    ok = F.col("status") == "ok"
    position = (F.array_position(expected, F.col("_choice")) - 1).cast("int")
    return checked.withColumns(
        {
            "prediction": F.when(ok, position).otherwise(F.lit(-1)),
            "probabilities": F.when(ok, normalised(F.col("_p"))),
            "probability_sum": F.when(ok, total),
        }
    ).drop("_parsed", "_choice", "_covers", "_p")


def input_audit(df: DataFrame, state: Column, instructions: Column, choices: Column, limit: int, marker: str) -> DataFrame:
    """Longest (state, instruction + choice) pair in words; too long or marked inputs are unsupported.

    The state is counted once per case; nothing is truncated.
    """
    words = lambda c: F.size(F.regexp_extract_all(c, F.lit(r"\S+"), F.lit(0)))
    longest = F.array_max(F.transform(choices, lambda c: words(F.concat_ws(" ", instructions, c["description"]))))
    marked = F.contains(state, F.lit(marker)) | F.contains(instructions, F.lit(marker)) | F.exists(
        choices, lambda c: F.contains(c["description"], F.lit(marker)) | F.contains(c["id"], F.lit(marker))
    )
    out = df.withColumn("longest_pair", words(state) + longest).withColumn("_marked", marked)
    status = F.when(F.col("_marked") | (F.col("longest_pair") > limit), "unsupported").otherwise("ok")
    reason = F.when(F.col("_marked"), "reserved marker").when(F.col("longest_pair") > limit, "pair too long")
    return out.withColumn("status", status).withColumn("reason", reason).drop("_marked")


def input_cost(body: Column, price_per_million: float) -> Column:
    """Cost estimate from the UTF-8 bytes of a request."""
    return F.octet_length(body) * F.lit(price_per_million) / F.lit(PRICE_UNIT)


def retry_class(code: Column) -> Column:
    return F.when(code < 400, "none").when(code.isin(*RETRY_CODES), "transient").otherwise("permanent")
