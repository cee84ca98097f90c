"""Which version of a page a read saw: an as-of join of reads with versions, and what has changed since the reader's last read."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def as_of(reads: DataFrame, versions: DataFrame, key: str, ts: str, version: str, step: int = 86_400) -> DataFrame:
    """Reads with the last version of their key that is not later than they are (null: none); of equal times the greatest version counts.

    A key's time is cut into steps of ``step`` seconds, which are sorted apart, so that a key with a third of all reads is work of many
    tasks; what was the last version before a step is found over the steps' last versions, and opens the step. Reads without a key or time see no version.
    """
    at = lambda df: F.floor(F.unix_micros(F.col(ts).cast("timestamp")) / F.lit(step * 1_000_000)).alias("_step")
    told = versions.where(F.col(key).isNotNull() & F.col(ts).isNotNull() & F.col(version).isNotNull())
    told = told.select(F.col(key).alias("_key"), F.unix_micros(F.col(ts).cast("timestamp")).alias("_us"), F.col(version).alias("_version"), at(told))
    asked = reads.withColumn("_row", F.struct(*reads.columns)).select(F.col(key).alias("_key"), F.unix_micros(F.col(ts).cast("timestamp")).alias("_us"), "_row", at(reads))
    last = told.groupBy("_key", "_step").agg(F.max(F.struct("_us", "_version")).alias("v"))
    steps = last.unionByName(asked.where("_key IS NOT NULL AND _us IS NOT NULL").select("_key", "_step").distinct(), allowMissingColumns=True).groupBy("_key", "_step").agg(F.max("v").alias("v"))
    before = Window.partitionBy("_key").orderBy("_step").rowsBetween(Window.unboundedPreceding, -1)
    opens = steps.select("_key", "_step", F.last("v", ignorenulls=True).over(before).alias("v")).where("v IS NOT NULL").select("_key", "_step", F.col("v._us").alias("_us"), F.col("v._version").alias("_version"))
    events = told.unionByName(opens).unionByName(asked, allowMissingColumns=True)
    # of equal times versions come before reads, the greatest last
    order = Window.partitionBy("_key", "_step").orderBy("_us", F.col("_row").isNotNull(), "_version").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = events.withColumn("_seen", F.when(F.col("_key").isNotNull() & F.col("_us").isNotNull(), F.last("_version", ignorenulls=True).over(order)))
    return seen.where(F.col("_row").isNotNull()).select("_row.*", F.col("_seen").alias(version))


def refreshed(reads: DataFrame, versions: DataFrame, key: str, ts: str, version: str, reader: str, order: str) -> DataFrame:
    """Reads with their version and ``refreshed``: whether the reader saw another version of this key at its read before (null at its first)."""
    seen = as_of(reads, versions, key, ts, version)
    before = F.lag(F.coalesce(F.col(version), F.lit(-1))).over(Window.partitionBy(reader, key).orderBy(ts, order))
    return seen.withColumn("refreshed", before != F.coalesce(F.col(version), F.lit(-1)))
