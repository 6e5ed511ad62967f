"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rookery.session import tune
from rookery.sources.tables import read

# Rows and bytes of one Arrow batch: bounds a Python worker's memory however
# long the texts are (one row may still be as large as its own text).
_BATCH_ROWS = "2000"
_BATCH_BYTES = str(16 << 20)

#: Words: runs of anything but blank, tab, line feed, vertical tab, form feed, return.
WORD = r"[^\x20\x09-\x0D]+"


def prepared(spark: SparkSession) -> SparkSession:
    """The runtime settings of the library, and bounded Arrow batches."""
    tune(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", _BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", _BATCH_BYTES)
    # Look-ups of few texts: filter the scan by the wanted keys before the shuffle. Spark
    # checks the size of the wanted side and of the filter itself.
    spark.conf.set("spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold", "0")
    return spark


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id`` and ``text`` of all documents; a null text is empty."""
    return texts(read(prepared(spark), sf_dir, "documents"))


def texts(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))


def free_name(taken: Iterable[str], base: str) -> str:
    """``base``, with underscores put before it until no column has that name."""
    lower = {c.lower() for c in taken}
    while base.lower() in lower:
        base = "_" + base
    return base
