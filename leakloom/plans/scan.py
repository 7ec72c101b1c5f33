"""Whole scans: from items to findings, with every step a DataFrame."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..functions.rules import Rule
from ..operators import containers, detect, findings
from ..operators.select import FileFilter, only_image_repos, select_files
from ..sources.artifacts import decoded


@dataclass(frozen=True)
class Options:
    """Parameters of a scan; see the command line for their meaning."""

    files: FileFilter = field(default_factory=FileFilter)
    max_size: int = 5 << 20
    max_layer: int = 100 << 20
    modified_after: str | None = None
    base64: bool = True
    most_matches: int = detect.MOST_MATCHES
    most_runs: int = detect.MOST_RUNS
    longest_run: int = detect.LONGEST_RUN
    image_configs: bool = False
    image_layers: bool = False
    min_severity: str = ""
    max_findings: int = 0
    show_secrets: bool = False
    base_url: str = ""


def texts(items: DataFrame, o: Options = Options(), image_repos: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Everything to be scanned (repo, path, name, size, sha256, inner, content as text, bytewise, shown), and the errors.

    image_repos (key): the repositories whose manifests are those of images; all, if it is not given or empty.
    """
    columns = ["repo", "path", "name", "size", "sha256", "inner", "content", "bytewise", "shown"]
    chosen = select_files(items, o.files, o.max_size, o.modified_after)
    none = F.lit(None).cast("string")
    cut = F.substring("content", 1, o.max_size) if o.max_size else F.col("content")
    plain = decoded(chosen.where(~F.col("archive")).withColumn("content", cut)).withColumns({"inner": none, "shown": none}).select(*columns)
    parts, failed = [plain], []
    if o.files.crack:
        whole = chosen.where("archive").drop("archive", "modified")
        whole = whole.withColumn("content", F.substring("content", 1, 8 * o.max_size)) if o.max_size else whole
        opened = containers.unpack(whole, o.max_size, files=o.files)
        failed.append(containers.archive_errors(opened))
        parts.append(decoded(opened.where("error is null")).withColumn("shown", none).select(*columns))
    if o.image_configs or o.image_layers:
        inner = containers.image_texts(items if image_repos is None else only_image_repos(items, image_repos), o.image_configs, o.image_layers, o.max_layer, o.max_size, o.files)
        failed.append(inner.where("error is not null").select("repo", "path", "name", "sha256", "size", F.lit("docker").alias("kind"), "error"))
        parts.append(decoded(inner.where("error is null")).select(*columns))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    errors = items.sparkSession.createDataFrame([], "repo string, path string, name string, sha256 string, size bigint, kind string, error string")
    for e in failed:
        errors = errors.unionByName(e)
    return out, errors


def scan_texts(read: DataFrame, rules: Sequence[Rule], o: Options = Options()) -> DataFrame:
    """Findings of texts with the columns of the report and those of their order; two shuffles, of findings only."""
    found = detect.detect(read, rules, o.base64, most_matches=o.most_matches, most_runs=o.most_runs, longest_run=o.longest_run)
    if o.min_severity:
        found = detect.at_least(found, o.min_severity)
    named = findings.enrich(found, o.base_url)
    return findings.most_specific(findings.first_by_fingerprint(named))


def scan(items: DataFrame, rules: Sequence[Rule], o: Options = Options(), image_repos: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Findings in report order, redacted unless shown, and errors."""
    read, errors = texts(items, o, image_repos)
    found = findings.limited(scan_texts(read, rules, o), o.max_findings)
    return findings.by_severity(findings.redacted(found, o.show_secrets)).select(*findings.COLUMNS), errors


def blob_texts(items: DataFrame, o: Options) -> tuple[DataFrame, DataFrame]:
    """Image blobs that are scanned on their own: binary ones as layers, others as text."""
    columns = ["repo", "path", "name", "size", "sha256", "inner", "content", "bytewise", "shown"]
    binary = text.is_binary(F.col("content"))
    cut = items.withColumn("content", F.substring("content", 1, o.max_layer)).drop("modified")
    opened = containers.unpack(cut.where(binary), o.max_size, layers=True, files=o.files)
    none = F.lit(None).cast("string")
    plain = decoded(cut.where(~binary).withColumn("inner", none)).unionByName(decoded(opened.where("error is null").drop("error")))
    return plain.withColumn("shown", none).select(*columns), containers.archive_errors(opened)


def retry(items: DataFrame, earlier_errors: DataFrame, prior: DataFrame, rules: Sequence[Rule], o: Options = Options(), image_repos: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """What failed before scanned again and merged behind an earlier report. Image blobs among it have names of their own.

    Blobs that are still missing stay errors.
    """
    again = findings.to_retry(items, earlier_errors)
    blob = F.lower("name").startswith("sha256__")
    read, errors = texts(again.where(~blob), o, image_repos)
    gone = earlier_errors.where(F.lower("name").startswith("sha256__") & (F.col("kind") == "docker")).join(items.select("repo", "path", "name"), ["repo", "path", "name"], "left_anti")
    errors = errors.unionByName(gone.select("repo", "path", "name", "kind", F.lit("blob not found").alias("error")), allowMissingColumns=True)
    blobs, more = blob_texts(again.where(blob), o)
    found = findings.limited(scan_texts(read.unionByName(blobs), rules, o), o.max_findings)
    done = findings.by_severity(findings.redacted(found, o.show_secrets)).select(*findings.COLUMNS)
    return findings.merge(prior, done), errors.unionByName(more)
