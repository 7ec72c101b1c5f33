"""Findings as rows: enrichment, dedup, order, redaction, merging, resuming and replaying."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import allowlist, text
from ..functions.rules import severity_rank

COLUMNS = ["rule_id", "rule_name", "severity", "category", "repo", "path", "file_url", "line", "column", "match", "secret", "entropy", "sha256", "size", "via_decoder", "fingerprint"]
#: The order in which findings of a file are made.
SEQUENCE = ["phase", "run_no", "ordinal", "match_no"]


def enrich(found: DataFrame, base_url: str = "") -> DataFrame:
    """Full path, URL, collapsed match and fingerprint of detected rows (with repo, path, name, size, sha256 and optionally inner and shown).

    inner is the place inside a container; it goes behind the path with an exclamation mark. shown, where it is set, is the path to be shown.
    """
    outer = text.full_path(F.col("path"), F.col("name"))
    where = F.when(F.col("inner").isNull(), outer).otherwise(F.concat(outer, F.lit("!"), F.col("inner"))) if "inner" in found.columns else outer
    where = F.coalesce("shown", where) if "shown" in found.columns else where
    url = text.artifact_url(base_url, F.col("repo"), outer) if base_url else F.lit("")
    out = found.withColumns({"_path": where, "file_url": url, "match": text.collapse(F.col("match"))})
    return out.drop("path", "name", "inner", "shown").withColumnRenamed("_path", "path").withColumn("fingerprint", text.fingerprint(F.col("rule_id"), F.col("repo"), F.col("path"), F.col("secret")))


def first_by_fingerprint(findings: DataFrame) -> DataFrame:
    """One finding a fingerprint: the first made. A group is the repetitions of one secret in one file."""
    w = Window.partitionBy("fingerprint").orderBy(*SEQUENCE)
    return findings.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def most_specific(findings: DataFrame) -> DataFrame:
    """One finding for each secret on a line: highest severity, then not generic, then first made. Empty secrets all stay."""
    generic = allowlist.is_generic(F.col("rule_id"), F.col("category")).cast("int")
    alone = F.when(F.col("secret") == "", F.struct(*SEQUENCE))
    w = Window.partitionBy("repo", "path", "secret", "line", alone).orderBy(severity_rank(F.col("severity")).desc(), generic, *SEQUENCE)
    return findings.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def by_severity(findings: DataFrame) -> DataFrame:
    return findings.orderBy(*order_columns())


def order_columns() -> list[Column]:
    return [severity_rank(F.col("severity")).desc(), F.col("repo"), F.col("path"), F.col("line"), *[F.col(c) for c in SEQUENCE]]


def redacted(findings: DataFrame, show: bool = False) -> DataFrame:
    """The report's columns; unless shown, matches become redactions of the secret and secrets are emptied."""
    if not show:
        findings = findings.withColumns({"match": text.redact(F.col("secret"), F.col("entropy")), "secret": F.lit("")})
    return findings


def limited(findings: DataFrame, most: int) -> DataFrame:
    """The first `most` findings in report order; all if that is 0."""
    return by_severity(findings).limit(most) if most > 0 else findings


def merge(prior: DataFrame, current: DataFrame) -> DataFrame:
    """Both reports' findings, once a fingerprint (or rule, repo, path and match where it is empty); prior ones win.

    Of equal keys within a report the first by place and content stays, whatever order the rows are read in.
    """
    key = F.coalesce(F.when(F.col("fingerprint") != "", F.col("fingerprint")), F.concat_ws("|", "rule_id", "repo", "path", "match"))
    both = prior.withColumn("_s", F.lit(0)).unionByName(current.withColumn("_s", F.lit(1)))
    w = Window.partitionBy(key).orderBy("_s", "line", "column", F.xxhash64(*[c for c in prior.columns]))
    return both.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_s", "_n")


def resume_keys(items: DataFrame) -> Column:
    return text.resume_key(F.col("repo"), text.full_path(F.col("path"), F.col("name")), F.col("sha256"))


def not_done(items: DataFrame, done: DataFrame) -> DataFrame:
    """Items whose resume key (column key of done) is not among those done."""
    keys = done.select(F.trim("key").alias("_key")).where("_key <> ''").distinct()
    return items.withColumn("_key", resume_keys(items)).join(keys, "_key", "left_anti").drop("_key")


def to_retry(items: DataFrame, errors: DataFrame) -> DataFrame:
    """What earlier errors name: all items of repositories that could not be listed, and the single items."""
    repos = errors.where("kind = 'repo'").select("repo").distinct()
    single = errors.where("kind <> 'repo'").select("repo", "path", "name").distinct()
    whole = items.join(repos, "repo", "left_semi")
    return whole.union(items.join(repos, "repo", "left_anti").join(single, ["repo", "path", "name"], "left_semi"))
