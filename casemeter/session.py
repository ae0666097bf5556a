"""Session defaults, lineage cutting and size-checked broadcasting."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

#: Largest table (in rows) that may travel to the driver and back as a broadcast.
SMALL_TABLE_ROWS = 50_000


def builder(app: str = "casemeter", master: str | None = None) -> SparkSession.Builder:
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    return (
        b.config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )


def shared_folder(spark: SparkSession) -> str:
    """A new folder for written tables, in the shared folder that ``spark.checkpoint.dir`` names.

    Only where that is unset (a test session) is a local one made.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if base is None:
        return tempfile.mkdtemp(prefix="casemeter-")
    return f"{base.rstrip('/')}/casemeter-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint.

    The folder is the one the cluster names in ``spark.checkpoint.dir``; only where that
    is unset (a test session) does the library choose one itself.
    """
    sc = df.sparkSession.sparkContext
    if not sc.getConf().get("spark.checkpoint.dir", None) and sc.getCheckpointDir() is None:
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="casemeter-checkpoint-"))
    return df.checkpoint(eager=True)


def small_table(df: DataFrame, limit: int = SMALL_TABLE_ROWS) -> DataFrame:
    """Broadcast ``df`` after checking its size; return it unhinted when it is too large.

    Meant for catalogues, quotas, thresholds and vocabularies. The check reads at most
    ``limit + 1`` rows; the rows read become a local relation, so that the small side is
    computed once however many joins use it.
    """
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        return df
    return F.broadcast(df.sparkSession.createDataFrame(rows, df.schema))
