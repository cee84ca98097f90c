"""Reading inputs and cutting lineage, alike on one machine and on a cluster."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    The session's ``spark.checkpoint.dir`` names it. Only where that is unset and all
    runs on one machine, as in tests, a temporary folder takes its place; a cluster
    without the setting is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="webloom-shared-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a frame as Parquet in the shared folder and read it again.

    A lost executor then costs a reread, not the work above, and what is used
    twice is computed once.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/webloom/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._webloom_path = path
    return back


def discard(*frames: DataFrame | None) -> None:
    """Delete the files of stored frames that nothing will read again. What isn't a stored frame is left alone."""
    for df in frames:
        path = getattr(df, "_webloom_path", None)
        if path:
            spark = df.sparkSession
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def release(spark: SparkSession) -> None:
    """Let Spark delete the files of shuffles that are over: it does so when the driver collects their plans as garbage, which else may be long after."""
    gc.collect()
    spark._jvm.System.gc()


def narrow(docs: DataFrame, *columns: str) -> DataFrame:
    """Only the named columns, whatever else the frame holds."""
    return docs.select(*[F.col(f"`{c}`") for c in columns])


def crc_split(column: str, parts: int):
    """crc32(doc_id as text) mod parts; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % parts



def last_code(part: float, least: int) -> int:
    """The greatest 63-bit hash that belongs to a sample of about ``part`` of all rows; the row of the ``least`` hash always does."""
    return max(int(part * (1 << 63)) - 1 if part < 1 else (1 << 63) - 1, least)


def packed(docs: DataFrame, **columns) -> DataFrame:
    """Whole rows as one column ``_row`` beside the named ones, so that no column of theirs can clash; ``select("_row.*")`` gives them back."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), *[x.alias(name) for name, x in columns.items()])
