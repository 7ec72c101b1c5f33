"""Row types of the engine, as DDL that readers, createDataFrame and from_json take."""

from __future__ import annotations

REPOS = "key string, type string, package_type string"
ITEMS = "repo string, path string, name string, size bigint, sha256 string, modified timestamp, content binary"
RULES = "id string, name string, severity string, category string, regex string, keywords array<string>, entropy_min double, description string, ordinal int"
FINDINGS = (
    "rule_id string, rule_name string, severity string, category string, repo string, path string, file_url string, line int, column int, "
    "match string, secret string, entropy double, sha256 string, size bigint, via_decoder string, fingerprint string"
)
ERRORS = "repo string, path string, name string, sha256 string, size bigint, kind string, type string, package_type string, error string, ts string"
STATS = "repos_scanned int, files_listed int, files_selected int, files_scanned int, files_skipped int, bytes_downloaded bigint, findings int, errors int, duration string"
#: A listing page and its fallback, an image manifest, a rules file and a prior report, as JSON.
LISTING = "results array<struct<repo:string,path:string,name:string,size:bigint,sha256:string>>, range struct<total:int>"
STORAGE = "files array<struct<uri:string,size:bigint,folder:boolean,sha2:string>>"
MANIFEST = "config struct<digest:string>, layers array<struct<digest:string,size:bigint>>"
RULE_FILE = "version string, rules array<struct<id:string,name:string,severity:string,category:string,regex:string,keywords:array<string>,entropy_min:double,description:string>>"
META = "tool string, version string, target string, ruleset_version string, rule_count int, generated_at string, profile string"
REPORT = f"meta struct<{META}>, stats struct<{STATS}>, findings array<struct<{FINDINGS}>>"
