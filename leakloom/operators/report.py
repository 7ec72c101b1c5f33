"""Summaries of findings and report files."""

from __future__ import annotations

import html
import json
import os
from collections.abc import Iterable, Iterator, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..functions.rules import SEVERITY
from .findings import COLUMNS

#: Columns of the CSV report.
CSV = ["severity", "rule", "category", "repo", "path", "line", "column", "match", "secret", "entropy", "via_decoder", "file_url", "fingerprint"]
TOP = 25


def counts(findings: DataFrame) -> DataFrame:
    """Findings by severity, by category and by repository in one pass: dimension, key, n."""
    grouped = findings.groupingSets([[F.col("severity")], [F.col("category")], [F.col("repo")]], "severity", "category", "repo").agg(F.count("*").alias("n"), F.grouping("severity").alias("_s"), F.grouping("category").alias("_c"))
    dimension = F.when(F.col("_s") == 0, "severity").when(F.col("_c") == 0, "category").otherwise("repo")
    return grouped.select(dimension.alias("dimension"), F.coalesce("severity", "category", "repo").alias("key"), "n")


def top(counted: DataFrame, dimension: str, most: int = TOP) -> DataFrame:
    """The `most` largest groups of a dimension, ties by key, and one row for all others (key null, n their number)."""
    own = counted.where(F.col("dimension") == dimension).select("key", "n")
    first = own.orderBy(F.desc("n"), "key").limit(most)
    rest = own.agg(F.count("*").alias("c")).where(F.col("c") > most).select(F.lit(None).cast("string").alias("key"), (F.col("c") - most).alias("n"))
    return first.union(rest)


def severity_counts(findings: DataFrame) -> DataFrame:
    """One row: a number for each known severity, and total."""
    each = [F.count_if(F.col("severity") == s).alias(s) for s in SEVERITY]
    return findings.agg(*each, F.count("*").alias("total"))


def repo_summary(repos: DataFrame, findings: DataFrame) -> DataFrame:
    """Per repository, also those without findings: numbers by severity, rules and files hit. Findings are counted before the join."""
    each = findings.groupBy("repo").agg(
        *[F.count_if(F.col("severity") == s).alias(s) for s in SEVERITY], F.count("*").alias("findings"), F.countDistinct("path").alias("files_hit"), F.countDistinct("rule_id").alias("rules_hit")
    )
    names = [c for c in each.columns if c != "repo"]
    return repos.select(F.col("key").alias("repo")).distinct().join(each, "repo", "left").select("repo", *[F.coalesce(c, F.lit(0)).alias(c) for c in names])


def stats(listed: DataFrame, scanned: DataFrame, findings: DataFrame, errors: int = 0, seconds: float = 0.0) -> DataFrame:
    """The run's counters as one row; listed and selected are the same number, as only selected files are listed."""
    spark = listed.sparkSession
    a = listed.agg(F.countDistinct("repo").alias("repos_scanned"), F.count("*").alias("files_listed"), F.count("*").alias("files_selected"))
    b = scanned.agg(F.count_if(~F.col("skipped")).alias("files_scanned"), F.count_if("skipped").alias("files_skipped"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes_downloaded"))
    c = findings.agg(F.count("*").alias("findings"))
    d = spark.range(1).select(F.lit(errors).alias("errors"), text.format_duration(F.lit(seconds)).alias("duration"))
    return a.join(b).join(c).join(d)


def summary(run: DataFrame, severities: DataFrame) -> DataFrame:
    """Two lines on a run, from stats() and severity_counts()."""
    first = F.format_string("repos=%d files=%d/%d bytes=%d errors=%d duration=%s", "repos_scanned", "files_scanned", "files_selected", "bytes_downloaded", "errors", "duration")
    second = F.format_string("findings: %d  (critical=%d high=%d medium=%d low=%d)", "total", "critical", "high", "medium", "low")
    return run.select(F.lit(1).alias("no"), first.alias("value")).union(severities.select(F.lit(2), second))


def dry_run(items: DataFrame) -> DataFrame:
    """Listing lines: repo/path, tab, size."""
    return items.select(F.format_string("%s/%s\t%d", "repo", text.full_path(F.col("path"), F.col("name")), "size").alias("value"))


def csv_rows(findings: DataFrame) -> DataFrame:
    safe = {c: text.csv_safe(F.coalesce(c, F.lit(""))) for c in ("severity", "category", "repo", "path", "match", "secret", "via_decoder", "file_url")}
    out = findings.withColumns(safe | {"rule": text.csv_safe(F.col("rule_name")), "entropy": F.format_string("%.2f", "entropy")})
    return out.select(*CSV)


def write_csv(findings: DataFrame, path: str) -> None:
    csv_rows(findings).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_json_rows(findings: DataFrame, path: str) -> None:
    """Findings of any number as JSON lines, written by the executors."""
    findings.select(*COLUMNS).write.mode("overwrite").json(path)


def write_errors(errors: DataFrame, path: str) -> None:
    errors.write.mode("overwrite").option("ignoreNullFields", True).json(path)


# single documents, written by the driver: for reports that people read

OMITTED = ("secret", "sha256", "via_decoder")


def _secure(path: str):
    return os.fdopen(os.open(path, os.O_WRONLY | os.O_CREAT | os.O_TRUNC, 0o600), "w", encoding="utf-8")


def document(meta: Mapping, run: Mapping, findings: Iterable[Mapping]) -> Iterator[str]:
    """One indented JSON document, in parts, one for each finding; empty fields of OMITTED are left out, no findings are null."""
    head = json.dumps({"meta": dict(meta), "stats": dict(run)}, indent=2, ensure_ascii=False)
    yield head.removesuffix("\n}") + ',\n  "findings": '
    some = False
    for f in findings:
        row = json.dumps({k: v for k, v in f.items() if v or k not in OMITTED}, indent=2, ensure_ascii=False)
        yield (",\n    " if some else "[\n    ") + row.replace("\n", "\n    ")
        some = True
    yield "\n  ]\n}\n" if some else "null\n}\n"


def _write(path: str, parts: Iterable[str]) -> None:
    with _secure(path) as f:
        f.writelines(parts)


def write_json(path: str, meta: Mapping, run: Mapping, findings: DataFrame) -> None:
    """The document, written finding by finding: the driver holds one partition of them at a time."""
    _write(path, document(meta, run, (r.asDict() for r in findings.select(*COLUMNS).toLocalIterator())))


STYLE = (
    "body{font:14px system-ui,sans-serif;margin:2rem;color:#222}table{border-collapse:collapse;width:100%}td,th{padding:.3rem .6rem;border-bottom:1px solid #ddd;text-align:left}"
    "th{cursor:pointer}.cards{display:flex;gap:1rem;margin:1rem 0}.card{padding:.8rem 1.2rem;border-radius:.5rem;background:#f3f3f3}.critical{color:#a00}.high{color:#c50}.medium{color:#a80}.low{color:#367}"
    ".lists{display:flex;gap:3rem}"
)
SCRIPT = (
    "const rows=[...document.querySelectorAll('tbody tr')],q=document.getElementById('q'),s=document.getElementById('s');"
    "const show=()=>rows.forEach(r=>r.hidden=!(r.dataset.t.includes(q.value.toLowerCase())&&(!s.value||r.dataset.s===s.value)));q.oninput=s.onchange=show;"
    "document.querySelectorAll('th').forEach((h,i)=>{let d=1;h.onclick=()=>{d=-d;const b=document.querySelector('tbody');"
    "rows.sort((x,y)=>x.cells[i].innerText.localeCompare(y.cells[i].innerText,undefined,{numeric:true})*d).forEach(r=>b.append(r))}});"
)


def html_page(meta: Mapping, run: Mapping, by: Mapping[str, list[tuple[str | None, int]]], findings: Iterable[Mapping]) -> Iterator[str]:
    """A self-contained page, in parts: run data, cards, the largest groups, and a table that filters and sorts, a part for each row.

    by: for each dimension, (key, number) of the largest groups; a key None has the number of groups that are left.
    """
    e = lambda x: html.escape(str(x if x not in (None, "") else "—"))
    severity = dict(by.get("severity", []))
    cards = [*((s, severity.get(s, 0)) for s in ("critical", "high", "medium", "low")), ("total", sum(severity.values()))]

    def group(title: str, rows: list[tuple[str | None, int]]) -> str:
        items = "".join(f"<li>{e(k or '(none)')} <b>{n}</b></li>" if k is not None else f"<li>… {n} more</li>" for k, n in rows)
        return f"<div><h2>{title}</h2><ul>{items}</ul></div>"

    head = "".join(f"<tr><th>{e(k)}</th><td>{e(v)}</td></tr>" for k, v in [*meta.items(), *run.items()])
    heads = "".join(f"<th>{h}</th>" for h in ("Severity", "Rule", "Repository", "Path", "Line", "Match", "Entropy", "Via"))
    options = "".join(f"<option>{s}</option>" for s in SEVERITY)
    yield (
        f'<!doctype html><html lang="en"><head><meta charset="utf-8"><title>Secrets in {e(meta.get("target"))}</title><style>{STYLE}</style></head><body><h1>Secret scan</h1><table class="meta"><thead>{head}</thead></table>'
        f'<div class="cards">{"".join(f"""<div class="card {k}"><b>{n}</b> {k}</div>""" for k, n in cards)}</div><div class="lists">{group("By repository", by.get("repo", []))}{group("By category", by.get("category", []))}</div>'
        f'<p><input id="q" type="search" placeholder="filter"> <select id="s"><option value="">all</option>{options}</select></p><table><thead><tr>{heads}</tr></thead><tbody>'
    )
    for f in findings:
        search = html.escape(" ".join(str(f[k] or "") for k in ("rule_name", "repo", "path", "match", "category")).lower())
        path = f'<a href="{html.escape(f["file_url"])}" rel="noreferrer">{e(f["path"])}</a>' if f.get("file_url") else e(f["path"])
        yield (
            f'<tr data-s="{e(f["severity"])}" data-t="{search}"><td class="{e(f["severity"])}">{e(f["severity"])}</td><td>{e(f["rule_name"])}</td><td>{e(f["repo"])}</td><td>{path}</td>'
            f"<td>{f['line']}</td><td><code>{e(f['match'])}</code></td><td>{f['entropy']:.2f}</td><td>{html.escape(f['via_decoder'] or '')}</td></tr>"
        )
    yield f"</tbody></table><script>{SCRIPT}</script></body></html>\n"


def write_html(path: str, meta: Mapping, run: Mapping, findings: DataFrame) -> None:
    """The page, written finding by finding. Of the groups, only those that it shows come to the driver."""
    counted = counts(findings).cache()
    by = {"severity": [(r["key"], r["n"]) for r in counted.where("dimension = 'severity'").collect()]}
    for dimension in ("repo", "category"):
        first = top(counted.withColumn("key", F.coalesce("key", F.lit(""))), dimension).collect()
        by[dimension] = [(r["key"], r["n"]) for r in first]
    _write(path, html_page(meta, run, by, (r.asDict() for r in findings.select(*COLUMNS).toLocalIterator())))
    counted.unpersist()


def write_reports(prefix: str, form: str, meta: Mapping, run: Mapping, findings: DataFrame) -> list[str]:
    """The files of a format (json, csv, html or all), as prefix.json, prefix-csv (a folder) and prefix.html."""
    done = []
    if form in ("all", "json"):
        write_json(f"{prefix}.json", meta, run, findings)
        done.append(f"{prefix}.json")
    if form in ("all", "csv"):
        write_csv(findings, f"{prefix}-csv")
        done.append(f"{prefix}-csv")
    if form in ("all", "html"):
        write_html(f"{prefix}.html", meta, run, findings)
        done.append(f"{prefix}.html")
    return done
