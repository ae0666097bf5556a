"""Term selection by chi-square, and the cutting of texts into words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.numeric import ratio
from ..session import small_table

#: Lengths of the character n-grams.
GRAM_LENGTHS = (3, 4, 5)


def words(text: Column) -> Column:
    """Whitespace-separated lower-case words (input of the character n-grams)."""
    return F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")


def chi_square(weights: DataFrame, labels: DataFrame, doc_id: str, label: str) -> DataFrame:
    """Chi-square of summed weights per class against the class shares: ``term, chi2``."""
    shares = labels.groupBy(label).agg(F.count(F.lit(1)).alias("_c"))
    shares = small_table(shares.withColumn("_share", F.col("_c") / F.sum("_c").over(Window.partitionBy(F.lit(0)))).select(label, "_share"))
    observed = weights.join(labels.select(doc_id, label), doc_id).groupBy("term", label).agg(F.sum("weight").alias("_o"))
    totals = observed.groupBy("term").agg(F.sum("_o").alias("_t"))
    # A class without the term still contributes its whole expectation.
    expected = totals.withColumn("_e", F.explode(shares.agg(F.collect_list(F.struct(label, "_share"))).scalar())).select("term", f"_e.{label}", (F.col("_t") * F.col("_e._share")).alias("_x"))
    both = expected.join(observed, ["term", label], "left").withColumn("_o", F.coalesce("_o", F.lit(0.0)))
    return both.groupBy("term").agg(F.sum(ratio(F.pow(F.col("_o") - F.col("_x"), 2), F.col("_x"))).alias("chi2"))


def select_terms(scores: DataFrame, k: int) -> DataFrame:
    """Best ``k`` terms, in order, with their position in the selected representation."""
    top = scores.orderBy(F.desc("chi2"), "term").limit(k)
    return top.withColumn("position", F.row_number().over(Window.orderBy(F.desc("chi2"), "term")) - 1)
