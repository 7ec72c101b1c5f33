"""Small helpers that the corpus operators share."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed value: one or more word separators (space, TAB to CR), for Java's and DuckDB's patterns alike.
GAP = r"[\x20\x09-\x0D]+"


def cut(df: DataFrame) -> DataFrame:
    """df computed once and kept in the cluster's shared checkpoint folder, so that a lost executor costs nothing.

    The folder is the session's spark.checkpoint.dir. Only where that is unset and Spark runs in one process (tests), a
    temporary one is made; a cluster without the setting is an error, as its machines share no such folder.
    """
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        where = sc.getConf().get("spark.checkpoint.dir")
        if not where and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        sc.setCheckpointDir(where or os.path.join(tempfile.gettempdir(), "leakloom-checkpoints"))
    return df.checkpoint(eager=True)


def compact(df: DataFrame, rows: int = 50_000) -> DataFrame:
    """df cut off and read back in as many parts as its size asks for, so that small tables don't cost a shuffle file for every task."""
    kept = cut(df)
    return kept.coalesce(max(4, kept.count() // rows + 1))


ROWS_PER_BATCH = 1000


def modest(spark: SparkSession) -> SparkSession:
    """The session, with small Arrow batches unless it names a size itself: texts are long, and both sides hold a batch or two."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(ROWS_PER_BATCH))
    return spark


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return modest(spark).read.parquet(f"{folder}/{name}.parquet")


def text_of(column: str | Column) -> Column:
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def word_list(text: Column) -> Column:
    """The words of a text, unchanged; an empty array for an empty or null text."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\x0c\r"))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, GAP))


def word_count(text: Column) -> Column:
    """Number of words; 0 for an empty or null text."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\x0c\r"))
    return F.when(bare == "", F.lit(0)).otherwise(F.size(F.split(bare, GAP))).cast("long")


def small(df: DataFrame, rows: int) -> DataFrame:
    """df marked for broadcast if it has at most so many rows; else as it is, and Spark shuffles the join."""
    return F.broadcast(df) if len(df.limit(rows + 1).select(F.lit(1)).take(rows + 1)) <= rows else df


def schema(**columns: str) -> T.StructType:
    return T.StructType([T.StructField(k, T._parse_datatype_string(v)) for k, v in columns.items()])
