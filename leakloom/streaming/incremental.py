"""Scans of what is new: Structured Streaming over files or tables, with a stored set of findings.

The checkpoint takes the place of a resume file. Each micro-batch is scanned like any batch; findings
whose fingerprints the store already has are left out by an anti-join, so state lives in a table
and not in the stream, and a batch that runs twice adds nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..schemas import FINDINGS


def table_stream(spark: SparkSession, schema, path: str, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


#: Findings are stored by this many leading digits of their fingerprints, so that a batch reads only the parts of the store that it may repeat.
DIGITS = 2
STORED = f"{FINDINGS}, batch bigint, prefix string"


def _stored(spark: SparkSession, store: str) -> DataFrame | None:
    path = spark._jvm.org.apache.hadoop.fs.Path(store)
    return spark.read.schema(STORED).parquet(store) if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path) else None


def only_new(found: DataFrame, store: str) -> DataFrame:
    """Findings (with their prefix) that the store does not have. found is read twice; its prefixes, 256 at most, go to the driver."""
    known = _stored(found.sparkSession, store)
    if known is None:
        return found
    prefixes = [r[0] for r in found.select("prefix").distinct().collect()]
    return found.join(known.where(F.col("prefix").isin(prefixes)).select("fingerprint").distinct(), "fingerprint", "left_anti").select(*found.columns)


def scan_stream(stream: DataFrame, scan: Callable[[DataFrame], DataFrame], store: str, checkpoint: str) -> StreamingQuery:
    """Scan all that is available in micro-batches and append new findings to the store (Parquet), then stop.

    A second run over the same input finds nothing new.
    """

    def each(batch: DataFrame, number: int) -> None:
        found = scan(batch).withColumns({"batch": F.lit(number).cast("bigint"), "prefix": F.left("fingerprint", F.lit(DIGITS))}).persist()
        try:
            only_new(found, store).repartition("prefix").write.mode("append").partitionBy("prefix").parquet(store)
        finally:
            found.unpersist()

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def findings_of(spark: SparkSession, store: str) -> DataFrame:
    """The stored findings, once each: a batch that was written twice counts once."""
    found = _stored(spark, store)
    return (spark.createDataFrame([], STORED) if found is None else found).drop("prefix").dropDuplicates(["fingerprint"])
