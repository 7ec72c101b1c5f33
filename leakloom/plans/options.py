"""Option parsing and the command line: python -m leakloom.plans.options ROOT --out report

LEAKLOOM_RULES, LEAKLOOM_REPOSITORIES and LEAKLOOM_BASE_URL stand in for the options of these names. A run leaves the report, OUT.errors.jsonl if something failed, and with --resume the keys of what it has done.
"""

from __future__ import annotations

import argparse
import base64
import binascii
import datetime as dt
import math
import os
import re
import sys
import time

#: Multiples of size and time units.
SIZES = {"": 1, "K": 1 << 10, "M": 1 << 20, "G": 1 << 30}
SPANS = {"w": 604800.0, "d": 86400.0, "h": 3600.0, "m": 60.0, "s": 1.0, "ms": 1e-3, "us": 1e-6, "µs": 1e-6, "ns": 1e-9}


def parse_size(s: str) -> int:
    """Bytes of 5MB, 512KB, 1G, 1024 or 10B; ValueError unless positive."""
    m = re.fullmatch(r"\s*([0-9]*\.?[0-9]+|[0-9]+\.)\s*([KMG]?)B?\s*", s.upper())
    value = int(float(m[1]) * SIZES[m[2]]) if m else 0
    if value <= 0:
        raise ValueError(f"not a size: {s!r}")
    return value


def parse_since(s: str) -> dt.timedelta:
    """A span such as 7d, 2w, 24h or 1h30m; ValueError for a bare number or unless positive."""
    t = s.strip().lower()
    if re.fullmatch(r"[0-9]*\.?[0-9]+[dw]", t):
        seconds = float(t[:-1]) * SPANS[t[-1]]
    elif re.fullmatch(r"(?:[0-9]*\.?[0-9]+(?:h|ms|us|µs|ns|m|s))+", t):
        seconds = sum(float(n) * SPANS[u] for n, u in re.findall(r"([0-9]*\.?[0-9]+)(h|ms|us|µs|ns|m|s)", t))
    else:
        seconds = 0.0
    if not seconds > 0 or math.isinf(seconds):
        raise ValueError(f"not a span: {s!r}")
    return dt.timedelta(seconds=seconds)


def parse_basic(s: str) -> tuple[str, str]:
    """User and password of a Basic credential, with or without the scheme; split at the first colon."""
    raw = re.sub(r"(?i)^basic ", "", s.strip())
    try:
        plain = base64.b64decode(raw + "=" * (-len(raw) % 4), validate=True).decode()
    except (binascii.Error, UnicodeDecodeError):
        raise ValueError("not base64") from None
    user, colon, password = plain.partition(":")
    if not colon or not user:
        raise ValueError("no user:password")
    return user, password


def or_env(value: str, name: str) -> str:
    """A value, or where it is empty that of an environment variable."""
    return value or os.environ.get(name, "")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="leakloom", description="Scan files below ROOT/<repository>/ for secrets.")
    a = p.add_argument
    a("root")
    for name in ("repos", "exclude", "package-type", "since", "extensions", "min-severity", "rules", "resume", "retry", "merge"):
        a(f"--{name}", default="")
    a("--repositories", default="", help="JSON catalogue of repositories (key, type, packageType); without it all folders below ROOT are local ones")
    a("--base-url", default="", help="what file URLs in the report begin with")
    a("--max-matches", type=int, default=64, help="matches of a rule in one text; 0: all"), a("--max-runs", type=int, default=256, help="base64 runs of an alphabet in one text; 0: all")
    a("--max-size", default="5MB"), a("--max-layer-size", default="100MB"), a("--max-findings", type=int, default=0)
    a("--out", default="leakloom-report"), a("--format", choices=["all", "json", "csv", "html"], default="all")
    a("--decode-base64", action=argparse.BooleanOptionalAction, default=True)
    for name in ("include-remote", "include-virtual", "extensionless", "no-files", "crack", "docker-config", "docker-layers", "show-secrets", "dry-run", "fail-on-findings", "live"):
        a(f"--{name}", action="store_true")
    return p


def main(argv: list[str] | None = None) -> int:
    """0 when done, 1 after a failure, 2 for wrong options, 3 for findings with --fail-on-findings."""
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    from ..functions import text
    from ..functions.rules import NoRules, load_rules, ruleset_version
    from ..operators import findings as rows
    from ..operators import report
    from ..operators.select import FileFilter, RepoFilter, filter_repos, listing_key, select_files, split_list
    from ..sources import artifacts
    from . import scan

    try:
        o = parser().parse_args(argv)
        o.rules, o.repositories, o.base_url = or_env(o.rules, "LEAKLOOM_RULES"), or_env(o.repositories, "LEAKLOOM_REPOSITORIES"), or_env(o.base_url, "LEAKLOOM_BASE_URL")
        since = dt.datetime.now(dt.timezone.utc) - parse_since(o.since) if o.since else None
        images = o.docker_config or o.docker_layers
        if o.no_files and not images:
            raise ValueError("--no-files needs --docker-config or --docker-layers")
        if not o.repositories and (o.package_type or o.include_remote or o.include_virtual):
            raise ValueError("--package-type, --include-remote and --include-virtual need --repositories")
        files = FileFilter(FileFilter.extensions(split_list(o.extensions)), not o.extensionless, o.crack, o.no_files, images)
        options = scan.Options(
            files, parse_size(o.max_size), parse_size(o.max_layer_size), None, o.decode_base64, o.max_matches, o.max_runs,
            image_configs=o.docker_config, image_layers=o.docker_layers, min_severity=o.min_severity, max_findings=o.max_findings, show_secrets=o.show_secrets, base_url=o.base_url,
        )
    except ValueError as e:
        print(e, file=sys.stderr)
        return 2
    except SystemExit as e:
        return int(e.code or 0)
    began = time.monotonic()
    spark = SparkSession.builder.appName("leakloom").getOrCreate()
    try:
        rules = load_rules(spark, o.rules or None)
    except NoRules as e:
        print(e, file=sys.stderr)
        return 1
    items = artifacts.files(spark, o.root, modified_after=since.strftime("%Y-%m-%dT%H:%M:%S") if since else None)
    wanted = RepoFilter(tuple(split_list(o.repos)), tuple(split_list(o.exclude)), o.package_type, o.include_remote, o.include_virtual)
    image_repos = None
    if o.repositories:
        known = artifacts.repositories(spark, o.repositories)
        chosen = filter_repos(known, wanted).select(listing_key(F.col("key"), F.col("type")).alias("repo"), "package_type").distinct()
        if not chosen.take(1):
            print("no repositories matched the selection", file=sys.stderr)
            return 1
        items = items.join(chosen.select("repo").distinct(), "repo", "left_semi")
        image_repos = chosen.where(F.lower("package_type") == "docker").select(F.col("repo").alias("key"))
    else:
        items = items.where(F.col("repo").isin(list(wanted.allow))) if wanted.allow else items
        items = items.where(~F.col("repo").isin(list(wanted.exclude))) if wanted.exclude else items
    if o.resume:
        items = rows.not_done(items, artifacts.resume_file(spark, o.resume))
    if o.dry_run:
        for r in report.dry_run(select_files(items.drop("content"), files, options.max_size)).toLocalIterator():
            print(r[0])
        return 0
    prior = artifacts.prior_report(spark, o.merge) if o.merge else None
    if o.retry:
        none = spark.createDataFrame([], artifacts.FINDINGS) if prior is None else prior
        found, errors = scan.retry(items, artifacts.errors(spark, o.retry), none, rules, options, image_repos)
    else:
        found, errors = scan.scan(items, rules, options, image_repos)
        found = found if prior is None else rows.merge(prior, found)
    found = found.cache()
    n = found.count()
    failed = f"{o.out}.errors.jsonl"
    number = artifacts.replace_errors(errors.select("*", *[F.lit(None).cast("string").alias(c) for c in ("type", "package_type")], F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX").alias("ts")), failed)
    chosen = select_files(items.drop("content"), files, options.max_size)
    run = report.stats(items.drop("content"), chosen.withColumn("skipped", F.lit(False)), found, number, time.monotonic() - began).withColumn("files_selected", F.col("files_scanned"))
    counted = run.first().asDict()
    report.write_reports(o.out, o.format, {"tool": "leakloom", "target": o.root, "ruleset_version": ruleset_version(), "rule_count": len(rules)}, counted, found)
    if o.live:
        for r in found.select(text.live_line(*[F.col(c) for c in ("severity", "rule_name", "repo", "path", "line")]).alias("value")).toLocalIterator():
            print(r[0], file=sys.stderr)
    for r in report.summary(run.sparkSession.createDataFrame([counted], run.schema), report.severity_counts(found)).orderBy("no").collect():
        print(r["value"], file=sys.stderr)
    if number:
        print(f"{number} errors in {failed} (scan them again with --retry {failed})", file=sys.stderr)
    if o.resume:
        done = chosen.join(spark.read.schema(artifacts.ERRORS).json(failed).select("repo", "path", "name").distinct(), ["repo", "path", "name"], "left_anti") if number else chosen
        artifacts.add_done(done.select(rows.resume_keys(done).alias("key")), o.resume)
    return 3 if n and o.fail_on_findings else 0


if __name__ == "__main__":
    sys.exit(main())
