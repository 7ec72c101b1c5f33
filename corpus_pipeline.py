"""Corpus pipeline: from raw documents to the shards of a training mix.

STAGES are (name, function) in order; each function takes (spark, docs, sf_dir) and returns a
DataFrame. All but the last return the columns of documents. run() applies them to the
documents of sf_dir, each stage's result being kept in the shared checkpoint folder.

* quality: rows whose text the byte-level network scores below QUALITY go.
* near_duplicates: one row of each group of near-identical texts stays, that of the smallest doc_id.
* decontamination: rows whose text contains a benchmark item go.
* mixture: rows are taken as often as their source's token target asks for: never, once or up to three times.
* sharding: rows get the number of one of SHARDS shards of nearly equal bytes, as column shard.

An empty table gives an empty table with the right columns, and extra columns are carried along up to a
column named shard, which the last stage replaces. What becomes of null, empty and very long texts, of
null ids and of repeated rows is said at each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from leakloom.llm import contamination, jaccard, mixing, quality, sharding
from leakloom.llm.common import cut, modest, table

#: Least score of a text that stays: the network is fitted with both labels weighing the same.
QUALITY = 0.5
SHARDS = 24


def filter_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that score QUALITY or more, as they were. Every whole text is scored, null and empty ones alike; repeated
    rows stay or go together. Without labels of both kinds all texts score one half, and all rows stay."""
    net = quality.fit_quality(docs.select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return quality.score_texts(docs, net, out_col="__leakloom_score").where(f"__leakloom_score >= {QUALITY}").drop("__leakloom_score")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group, that of the smallest id; of rows that equal it in id and shingles, one. Rows whose texts have no
    words (null ones too) are in no group and all stay. Among rows without ids, any of the group may be the one."""
    modest(spark)
    return jaccard.keep_one(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose whole text contains no benchmark item, as they were; null and empty texts stay, repeated rows stay or go together."""
    return contamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row as often as its source's target asks for, by a hash of id and text. Rows without words (null and empty texts)
    are taken by their hashes like others, and never where their source has no words; equal rows are divided."""
    modest(spark)
    return mixing.mix(docs)


def assign_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with the number of their shard; null and empty texts count eight bytes, repeated rows are divided."""
    modest(spark)
    return sharding.shard(docs, SHARDS)


STAGES = [
    ("quality", filter_quality),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_benchmark_leaks),
    ("mixture", mix_sources),
    ("sharding", assign_shards),
]

#: SQL can express neither the network nor the mix's hashes.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        docs = docs if name == STAGES[-1][0] else cut(docs)
    return docs
