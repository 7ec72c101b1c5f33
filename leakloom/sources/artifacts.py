"""Where items, rules and earlier results are read from."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..schemas import ERRORS, FINDINGS as FINDINGS, LISTING, REPORT, REPOS, STORAGE

#: How tables of texts are read as items: table, repository, path, name, content and time.
TABLES = {
    "documents": ("source", "lang", "concat('doc_', doc_id, '.txt')", "text", "cast(null as timestamp)"),
    "pages": ("'pages'", "regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)", "concat('page_', page_id, '.html')", "html", "cast(null as timestamp)"),
    "events": ("event_type", "'.'", "concat('event_', event_id, '.json')", "props", "cast(ts as timestamp)"),
    "conversations": ("role", "cast(conv_id as string)", "concat('turn_', turn, '.md')", "text", "cast(null as timestamp)"),
    "benchmark": ("'benchmark'", "'.'", "concat('item_', item_id, '.txt')", "text", "cast(null as timestamp)"),
}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


SMALL = 64 << 20


def spread(df: DataFrame) -> DataFrame:
    """df dealt over all cores if it comes from fewer files than cores and is small (SMALL bytes a core by the
    optimizer's estimate); other inputs stay as they are read. A small file often has one row group, which one task reads.

    For work that costs far more than moving the rows once.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size < cores * SMALL and len(df.inputFiles()) < cores else df


def items_of(df: DataFrame, name: str) -> DataFrame:
    """A table of texts as items (repo, path, name, size, sha256, modified, content as text). Null texts are no items.

    Size and digest are computed only where a query uses them.
    """
    repo, path, file, content, modified = TABLES[name]
    out = df.where(F.expr(f"{content} is not null")).select(F.expr(repo).alias("repo"), F.expr(path).alias("path"), F.expr(file).alias("name"), F.expr(modified).alias("modified"), F.expr(content).alias("content"))
    return out.withColumns({"size": F.octet_length("content").cast("long"), "sha256": F.sha2("content", 256)})


def repos_of(df: DataFrame, name: str) -> DataFrame:
    """The repositories of a table of texts, as local ones."""
    return df.select(F.expr(TABLES[name][0]).alias("key")).distinct().select("key", F.lit("LOCAL").alias("type"), F.lit("generic").alias("package_type"))


def files(spark: SparkSession, root: str, pattern: str = "*", max_bytes: int | None = None, modified_after: str | None = None) -> DataFrame:
    """Files below root, whose first folder is the repository, as items with binary content.

    Name patterns and times (modified_after, in UTC) are applied to the listing, before contents are read.
    """
    reader = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").option("timeZone", "UTC")
    if modified_after:
        reader = reader.option("modifiedAfter", modified_after)
    read = reader.load(root)
    rel = F.regexp_extract(F.url_decode(F.replace(F.col("path"), F.lit("+"), F.lit("%2B"))), r"(?s).*?" + _quoted(root.rstrip("/")) + r"/(.*)$", 1)
    inside = F.regexp_extract(rel, r"(?s)^[^/]*/(.*)$", 1)
    content = F.substring("content", 1, max_bytes) if max_bytes else F.col("content")
    return read.select(F.regexp_extract(rel, r"^([^/]*)/", 1).alias("repo"), text.split_folder(inside).alias("path"), text.split_name(inside).alias("name"), F.col("length").alias("size"), F.lit("").alias("sha256"), F.col("modificationTime").alias("modified"), content.alias("content"))


def _quoted(root: str) -> str:
    import re

    return re.escape(re.sub(r"^[a-z0-9]+:/*", "/", root)).replace("/", "/+")


def decoded(items: DataFrame) -> DataFrame:
    """Items whose content is text, as strings, and whether a character stands for a byte (bytewise). Binary contents are dropped.

    Contents that are no valid UTF-8 keep every byte as a character of its own, so that places in them are those of the file.
    """
    text_ = F.col("content").cast("string")
    valid = F.is_valid_utf8(text_)
    return items.where(~text.is_binary(F.col("content"))).withColumn("bytewise", ~valid).withColumn("content", F.when(valid, text_).otherwise(text.as_characters(F.col("content"))))


def repositories(spark: SparkSession, path: str) -> DataFrame:
    """A repository catalogue: a JSON array of key, type and packageType."""
    read = spark.read.schema("key string, type string, packageType string").option("multiLine", True).json(path)
    return read.withColumnRenamed("packageType", "package_type").select(*[c.split()[0] for c in REPOS.split(", ")])


def listing(spark: SparkSession, path: str) -> DataFrame:
    """Listing pages as rows repo, path, name, size, sha256."""
    return spark.read.schema(LISTING).option("multiLine", True).json(path).select(F.inline("results"))


def listing_page(items: DataFrame, offset: int, size: int = 1000) -> DataFrame:
    """One page of a listing by path and name: `size` items from `offset` on (a limit is the feature)."""
    return items.orderBy("path", "name", "repo").offset(offset).limit(size)


def storage_listing(spark: SparkSession, path: str, repo: str) -> DataFrame:
    """The fallback listing of one repository: files only, their URIs split into folder and name."""
    read = spark.read.schema(STORAGE).option("multiLine", True).json(path).select(F.inline("files")).where("not coalesce(folder, false)")
    rel = F.regexp_replace("uri", "^/", "")
    return read.select(F.lit(repo).alias("repo"), text.split_folder(rel).alias("path"), text.split_name(rel).alias("name"), "size", F.col("sha2").alias("sha256"))


def prior_report(spark: SparkSession, path: str) -> DataFrame:
    """Findings of an earlier JSON report."""
    return spark.read.schema(REPORT).option("multiLine", True).json(path).select(F.inline("findings"))


def errors(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(ERRORS).json(path)


def _kind(spark: SparkSession, path: str) -> str | None:
    """file, folder, or None if there is nothing."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    return ("folder" if fs.getFileStatus(at).isDirectory() else "file") if fs.exists(at) else None


def resume_file(spark: SparkSession, path: str) -> DataFrame:
    """Keys of items done, one a line, of a file or a folder of files; none if there is no such thing yet."""
    if _kind(spark, path) is None:
        return spark.createDataFrame([], "key string")
    return spark.read.text(path).select(F.trim("value").alias("key")).where("key <> ''").distinct()


def add_done(keys: DataFrame, path: str) -> None:
    """Append keys (column key) to a resume folder, written by the executors. An earlier single file becomes a file of the folder."""
    spark = keys.sparkSession
    if _kind(spark, path) == "file":
        jvm = spark._jvm
        at, aside = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(f"{path}.before")
        fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
        fs.rename(at, aside)
        fs.mkdirs(at)
        fs.rename(aside, jvm.org.apache.hadoop.fs.Path(f"{path}/before.txt"))
    keys.select("key").where("key <> ''").distinct().write.mode("append").text(path)


def replace_errors(errors_: DataFrame, path: str) -> int:
    """Errors as JSON lines in place of an earlier run's, which may still be read for them; none leaves nothing there."""
    spark = errors_.sparkSession
    jvm = spark._jvm
    at, new = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(f"{path}.new")
    errors_.write.mode("overwrite").option("ignoreNullFields", True).json(f"{path}.new")
    n = spark.read.schema(ERRORS).json(f"{path}.new").count()
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.delete(at, True)
    if n:
        fs.rename(new, at)
    else:
        fs.delete(new, True)
    return n
