from __future__ import annotations

import csv
import datetime as dt
import gzip
import io
import json
import os
import stat
import tarfile
import zipfile

import pytest
from pyspark.sql import functions as F

from leakloom.functions import text
from leakloom.functions.rules import load_rules, parse_rules, pick
from leakloom.operators import containers, detect, findings, report
from leakloom.operators.select import FileFilter, classify, only_image_repos, select_files, shuffled
from leakloom.plans import options, scan
from leakloom.sources import artifacts
from leakloom.streaming import incremental

HEX = "9f86d081884c7d65" * 3
TOKEN = f'token = "{HEX[:40]}"\n'
RULES = pick(load_rules(), "hex-token-assign")
ITEM = "repo string, path string, name string, size bigint, sha256 string, modified timestamp, content binary"


def items(spark, *rows):
    full = [(r, p, n, len(c), "", None, bytearray(c)) for r, p, n, c in rows]
    return spark.createDataFrame(full, ITEM)


def zipped(**files) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for n, c in files.items():
            z.writestr(n.replace("__", "/").replace("_", "."), c)
    return out.getvalue()


def tarred(mode="w", **files) -> bytes:
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode=mode) as t:
        for n, c in files.items():
            info = tarfile.TarInfo(n.replace("__", "/").replace("_", "."))
            info.size = len(c)
            t.addfile(info, io.BytesIO(c.encode()))
    return out.getvalue()


def test_archives_are_opened(spark):
    df = items(
        spark,
        ("r", ".", "a.zip", zipped(conf_txt=TOKEN, bin_png="x", dir__b_env="x")),
        ("r", "d", "b.tar", tarred(app__c_txt=TOKEN)),
        ("r", "d", "c.tgz", tarred("w:gz", e_txt=TOKEN)),
        ("r", "d", "d.crate", tarred("w:gz", f_rs=TOKEN)),
        ("r", "d", "g.log.gz", gzip.compress(TOKEN.encode())),
        ("r", "d", "bad.jar", b"not a zip"),
        ("r", "d", "e.whl", zipped(x_txt="a\0b")),
    )
    got, errors = scan.scan(df, RULES, scan.Options(FileFilter(crack=True), show_secrets=True))
    assert {r["path"] for r in got.collect()} == {"a.zip!conf.txt", "d/b.tar!app/c.txt", "d/c.tgz!e.txt", "d/d.crate!f.rs", "d/g.log.gz!g.log"}
    bad = errors.collect()
    assert [(r["name"], r["kind"]) for r in bad] == [("bad.jar", "archive")]


def test_archives_stay_closed_unless_asked(spark):
    df = items(spark, ("r", ".", "a.zip", zipped(conf_txt=TOKEN)), ("r", ".", "b.txt", TOKEN.encode()))
    assert {r["path"] for r in scan.scan(df, RULES)[0].collect()} == {"b.txt"}


def test_bombs_are_bounded(monkeypatch):
    monkeypatch.setattr(containers, "MOST_ENTRIES", 3)
    data = zipped(**{f"f{i}_txt": "x" for i in range(9)})
    assert len(list(containers.entries(data, "a.zip", 100))) == 3
    big = zipped(a_txt="y" * 1000, b_txt="y" * 10)
    assert [n for n, _, _ in containers.entries(big, "a.zip", 100)] == ["b.txt"]
    assert containers.budget(0) == 512 << 20 and containers.budget(1) == 256 << 20 and containers.budget(1 << 30) == 1 << 30


@pytest.mark.parametrize(("pack", "name"), [(zipped, "a.jar"), (tarred, "a.tar")])
def test_only_entries_that_are_looked_at_use_the_budget(monkeypatch, pack, name):
    monkeypatch.setattr(containers, "budget", lambda max_file: 100)
    data = pack(**{f"c{i}_class": "x" * 60 for i in range(9)}, a_txt="y" * 60, b_txt="z" * 60, c_txt="never")
    assert [(n, len(d)) for n, d, _ in containers.entries(data, name, 80)] == [("a.txt", 60), ("b.txt", 60)]


def test_zip_goes_on_behind_entries_that_fail():
    data = zipped(a_txt="first", b_txt="second", c_txt="third")
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        central = data.index(b"PK\x01\x02")
        at = [data.index(b"PK\x01\x02", central + 46 * i) for i in range(2)]
        assert len(z.infolist()) == 3
    locked = bytearray(data)
    locked[at[0] + 8] |= 1  # encrypted
    assert [n for n, _, _ in containers.entries(bytes(locked), "a.zip", 100)] == ["b.txt", "c.txt"]
    method = bytearray(data)
    method[at[0] + 10] = 97
    assert [n for n, _, _ in containers.entries(bytes(method), "a.zip", 100)] == ["b.txt", "c.txt"]
    crc = bytearray(data)
    crc[at[0] + 16] ^= 255
    assert [(n, d) for n, d, _ in containers.entries(bytes(crc), "a.zip", 100)] == [("a.txt", b"first"), ("b.txt", b"second"), ("c.txt", b"third")]


def test_text_names_agree(spark):
    from leakloom.operators.select import is_text, text_name

    names = ["a.TXT", "x/.env.b", "x/y.class", "Dockerfile", "x/plain", "a.tar.gz", ".npmrc", "d.e/f", "k.foo", "", "a."]
    for f in (FileFilter(), FileFilter(text_only=False), FileFilter(extra_extensions=(".foo",))):
        got = spark.createDataFrame([(n,) for n in names], "n string").select("n", is_text(F.col("n"), f).alias("t")).collect()
        assert {r["n"]: r["t"] for r in got} == {n: text_name(n, f) for n in names}


def test_damaged_tar_keeps_what_was_read():
    data = tarred(a_txt=TOKEN, b_txt=TOKEN * 50)
    assert [n for n, _, _ in containers.entries(data[:1600], "x.tar", 1 << 20)][:1] == ["a.txt"]


DIGEST = "sha256:" + HEX[:20]


def image(spark, layer=b""):
    manifest = {"config": {"digest": DIGEST}, "layers": [{"digest": "sha256:aa", "size": len(layer)}]}
    return items(
        spark,
        ("img", "app/1", "manifest.json", json.dumps(manifest).encode()),
        ("img", "app/1", DIGEST.replace(":", "__"), json.dumps({"config": {"Env": [TOKEN]}}).replace('\\"', '"').encode()),
        ("img", "app/1", "sha256__aa", layer),
        ("img", "app/2", "manifest.json", json.dumps(manifest).encode()),
        ("img", "app/3", "list.manifest.json", json.dumps({"manifests": [{"digest": DIGEST}]}).encode()),
        ("img", ".", "leak.properties", TOKEN.encode()),
    )


def test_image_config_only(spark):
    o = scan.Options(FileFilter(no_files=True, images=True), image_configs=True)
    got, errors = scan.scan(image(spark, gzip.compress(b"x")), RULES, o)
    assert [r["path"] for r in got.collect()] == [f"app/1/manifest.json!config:{HEX[:12]}"]
    assert errors.count() == 0


@pytest.mark.parametrize("mode", ["w", "w:gz"])
def test_image_layers(spark, mode):
    o = scan.Options(FileFilter(no_files=True, images=True), image_layers=True)
    got, _ = scan.scan(image(spark, tarred(mode, app__x_env=TOKEN)), RULES, o)
    assert [r["path"] for r in got.collect()] == ["app/1/sha256__aa!app/x.env"]


def test_missing_blob_is_an_error(spark):
    df = image(spark).where("name not like 'sha256%'")
    _, errors = scan.scan(df, RULES, scan.Options(FileFilter(no_files=True, images=True), image_configs=True))
    assert sorted((r["kind"], r["path"], r["name"]) for r in errors.collect()) == [("docker", p, DIGEST.replace(":", "__")) for p in ("app/1", "app/2")]


def test_a_digest_is_read_where_it_lies(spark):
    df = image(spark)
    moved = df.withColumn("path", F.when(F.col("name").startswith("sha256__9"), F.lit("app/2")).otherwise(F.col("path")))
    got, errors = scan.scan(moved, RULES, scan.Options(FileFilter(no_files=True, images=True), image_configs=True, base_url="https://h/"))
    assert [(r["path"], r["file_url"].rsplit("/", 2)[1:]) for r in got.collect()] == [(f"app/2/manifest.json!config:{HEX[:12]}", ["2", DIGEST.replace(":", "__")])]
    assert errors.count() == 0


def test_only_image_repositories_are_asked_for_images(spark):
    o = scan.Options(FileFilter(no_files=True, images=True), image_configs=True)
    known = lambda *k: spark.createDataFrame([(x,) for x in k], "key string")
    assert scan.scan(image(spark), RULES, o, known("img"))[0].count() == 1 and scan.scan(image(spark), RULES, o, known("other"))[0].count() == 0


def test_places_in_files_that_are_no_utf8(spark):
    latin = 'é = 1\nñandú: token = "'.encode("latin-1") + HEX[:40].encode() + b'"\n'
    run = "x\né ".encode("latin-1") + b"dG9rZW4gPSAi" + __import__("base64").b64encode(HEX[:39].encode()) + b"IiA="
    df = items(spark, ("r", ".", "a.txt", latin), ("r", ".", "b.txt", latin.decode("latin-1").encode()), ("r", ".", "c.txt", run))
    rule = parse_rules('{"rules": [{"id": "t", "regex": "[^ \\\\n]+: token = \\"[0-9a-f]{39,40}\\"|token = \\"[0-9a-f]{39}\\""}]}')
    got = {r["path"]: r for r in scan.scan(df, rule, scan.Options(show_secrets=True))[0].collect()}
    assert {p: (r["line"], r["column"]) for p, r in got.items()} == {"a.txt": (2, 1), "b.txt": (2, 1), "c.txt": (2, 3)}
    assert got["b.txt"]["secret"].startswith("ñandú") and got["a.txt"]["secret"].startswith("\ufffdand\ufffd")
    accents = "éééé".encode("latin-1") + TOKEN.encode()
    assert scan.scan(items(spark, ("r", ".", "d.txt", accents)), RULES)[0].first()["column"] == 5


def test_bounds_of_a_text_are_parameters(spark):
    many = "".join(f'token = "{i:040x}"\n'.replace("0" * 30, HEX[:30]) for i in range(100, 200))
    df = items(spark, ("r", ".", "a.txt", many.encode()))
    assert scan.scan(df, RULES)[0].count() == 64 and scan.scan(df, RULES, scan.Options(most_matches=0))[0].count() == 100
    big = items(spark, ("r", ".", "a.txt", b"x" * (6 << 20) + TOKEN.encode()))
    assert scan.scan(big, RULES)[0].count() == 0 and scan.scan(big, RULES, scan.Options(max_size=0))[0].count() == 1


def test_only_image_repos(spark):
    df = items(spark, ("a", ".", "x", b""), ("b", ".", "y", b""))
    none = spark.createDataFrame([], "key string")
    assert only_image_repos(df, none).count() == 2
    assert only_image_repos(df, spark.createDataFrame([("a",)], "key string")).count() == 1


@pytest.mark.parametrize(
    ("name", "f", "scan_it", "archive"),
    [("a.txt", FileFilter(), True, False), ("A.PNG", FileFilter(), False, False), ("x.foo", FileFilter(), False, False), ("x.foo", FileFilter((".foo",)), True, False), ("x.png", FileFilter((".png",)), False, False),
     ("noext", FileFilter(), False, False), ("noext", FileFilter(text_only=False), True, False), ("a.jar", FileFilter(), False, False), ("a.jar", FileFilter(crack=True), True, True), (".env.x", FileFilter(), True, False),
     ("manifest.json", FileFilter(no_files=True, images=True), True, False), ("a.txt", FileFilter(no_files=True, images=True), False, False), ("Dockerfile", FileFilter(), True, False)],
)
def test_classify(spark, name, f, scan_it, archive):
    k = spark.range(1).select(classify(F.lit(name), f).alias("k")).first()["k"]
    assert (k["scan"], k["archive"]) == (scan_it, archive)


def test_sizes_and_times_decide_before_content(spark):
    t = dt.datetime(2026, 1, 1)
    df = spark.createDataFrame([("r", ".", n, s, "", m, bytearray(b"x")) for n, s, m in (("a.txt", 10, t), ("b.txt", 11, t), ("c.zip", 99, t), ("d.txt", 1, t + dt.timedelta(seconds=1)))], ITEM)
    assert {r["name"] for r in select_files(df, FileFilter(crack=True), 10).collect()} == {"a.txt", "c.zip", "d.txt"}
    assert {r["name"] for r in select_files(df, max_size=10, modified_after=t).collect()} == {"d.txt"}


def finding(spark, *rows):
    return spark.createDataFrame([("r", "p", s, 1, i, c, v, 0, 0, n, 0) for n, (s, i, c, v) in enumerate(rows)], "repo string, path string, secret string, line int, rule_id string, category string, severity string, phase int, run_no int, ordinal int, match_no int")


@pytest.mark.parametrize(
    ("rows", "kept"),
    [([("s", "generic-x", "generic", "medium"), ("s", "b", "saas", "critical")], ["b"]), ([("s", "b", "saas", "low"), ("s", "generic-x", "generic", "high")], ["generic-x"]),
     ([("s", "generic-x", "generic", "high"), ("s", "b", "saas", "high")], ["b"]), ([("s", "a", "x", "high"), ("t", "b", "x", "high")], ["a", "b"]), ([("s", "a", "x", "high"), ("s", "b", "x", "high")], ["a"]),
     ([("", "a", "x", "high"), ("", "b", "x", "high")], ["a", "b"])],
)
def test_dedupe_by_secret(spark, rows, kept):
    assert sorted(r["rule_id"] for r in findings.most_specific(finding(spark, *rows)).collect()) == kept


def test_base64_is_seen_once_and_keeps_its_place(spark):
    import base64

    run = base64.b64encode(TOKEN.encode()).decode()
    df = spark.createDataFrame([("a", "é\nx " + run), ("b", "y " + run.rstrip("=")), ("c", base64.b64encode(b"\0\1" * 40).decode()), ("d", None)], "name string, content string")
    got = {r["name"]: r for r in detect.detect(df, RULES).collect()}
    assert set(got) == {"a", "b"}
    assert (got["a"]["line"], got["a"]["column"], got["a"]["via_decoder"]) == (2, 3, "base64")
    assert detect.detect(df, RULES, base64=False).count() == 0


def full_report(spark, *rows):
    df = spark.createDataFrame([("r", "p", "n.txt", 3, "", c) for c in rows] or [("r", "p", "n.txt", 3, "", "")], "repo string, path string, name string, size bigint, sha256 string, content string")
    return scan.scan_texts(df.withColumn("inner", F.lit(None).cast("string")), RULES)


def test_reports(spark, tmp_path):
    found = findings.redacted(full_report(spark, "x\n" + TOKEN))
    made = report.write_reports(str(tmp_path / "out"), "all", {"target": "<t>"}, {"findings": 1}, found)
    assert len(made) == 3
    doc = json.loads((tmp_path / "out.json").read_text())
    assert doc["findings"][0]["line"] == 2 and "secret" not in doc["findings"][0] and HEX[:40] not in (tmp_path / "out.json").read_text()
    assert stat.S_IMODE(os.stat(tmp_path / "out.json").st_mode) == 0o600
    page = (tmp_path / "out.html").read_text()
    assert "&lt;t&gt;" in page and HEX[:40] not in page
    files = list((tmp_path / "out-csv").glob("*.csv"))
    rows = [r for f in files for r in csv.DictReader(f.open())]
    assert list(rows[0]) == report.CSV and rows[0]["entropy"].count(".") == 1
    assert artifacts.prior_report(spark, str(tmp_path / "out.json")).count() == 1
    assert json.loads("".join(report.document({}, {}, [])))["findings"] is None
    assert json.loads("".join(report.document({"a": 1}, {}, [{"line": i, "secret": "", "match": "x\ny"} for i in range(3)]))) == {"meta": {"a": 1}, "stats": {}, "findings": [{"line": i, "match": "x\ny"} for i in range(3)]}


def test_merge_prefers_prior_and_falls_back_to_match(spark):
    row = lambda fp, m: tuple("r" if c in ("repo", "rule_id") else fp if c == "fingerprint" else m if c == "match" else 1 if c in ("line", "column") else 1.0 if c == "entropy" else 1 if c == "size" else "" for c in findings.COLUMNS)
    kind = ", ".join(f"`{c}` " + ("int" if c in ("line", "column") else "double" if c == "entropy" else "bigint" if c == "size" else "string") for c in findings.COLUMNS)
    prior, now = spark.createDataFrame([row("f1", "old"), row("", "m")], kind), spark.createDataFrame([row("f1", "new"), row("f2", "x"), row("", "m"), row("", "k")], kind)
    assert sorted(r["match"] for r in findings.merge(prior, now).collect()) == ["k", "m", "old", "x"]


def test_retry_recovers_single_files_and_whole_repositories(spark, tmp_path):
    df = items(spark, ("r", ".", "a.txt", TOKEN.encode()), ("r", ".", "b.txt", TOKEN.encode()), ("s", ".", "c.txt", TOKEN.encode()))
    bad = spark.createDataFrame([("file", "r", ".", "a.txt"), ("repo", "s", None, None)], "kind string, repo string, path string, name string")
    report.write_errors(bad, str(tmp_path / "e"))
    prior = scan.scan(df.where("name = 'b.txt'"), RULES)[0]
    got, _ = scan.retry(df, artifacts.errors(spark, str(tmp_path / "e")), prior, RULES)
    assert sorted(r["path"] for r in got.collect()) == ["a.txt", "b.txt", "c.txt"]


def test_retry_opens_image_blobs(spark):
    df = image(spark, tarred("w:gz", app__x_env=TOKEN)).withColumn("content", F.when(F.col("name").startswith("sha256__9"), F.encode(F.lit(TOKEN), "UTF-8")).otherwise(F.col("content")))
    bad = df.where("name like 'sha256%'").select(F.lit("docker").alias("kind"), "repo", "path", "name")
    prior = scan.scan(df.limit(0), RULES)[0]
    got, errors = scan.retry(df, bad, prior, RULES)
    assert sorted(r["path"] for r in got.collect()) == ["app/1/sha256__9f86d081884c7d659f86", "app/1/sha256__aa!app/x.env"] and errors.count() == 0
    gone, still = scan.retry(df.where("name not like 'sha256__aa'"), bad, prior, RULES)
    assert gone.count() == 1 and [r["name"] for r in still.collect()] == ["sha256__aa"]


def test_stream_equals_batch_and_runs_once(spark, data, tmp_path):
    from leakloom.queries import scanned

    src = tmp_path / "in"
    docs = spark.read.parquet(f"{data}/documents.parquet").limit(30).withColumn("text", F.concat(F.lit('token = "'), F.sha1("text"), F.lit('"')))
    docs.repartition(3).write.parquet(str(src))
    stream = incremental.table_stream(spark, docs.schema, str(src), 1)
    store, check = str(tmp_path / "store"), str(tmp_path / "check")
    one = lambda batch: scanned(artifacts.items_of(batch, "documents"), RULES).select(*findings.COLUMNS)
    incremental.scan_stream(stream, one, store, check).awaitTermination()
    first = {r["fingerprint"] for r in incremental.findings_of(spark, store).collect()}
    assert first == {r["fingerprint"] for r in one(docs).collect()} and len(first) == 30
    incremental.scan_stream(stream, one, store, check).awaitTermination()
    assert spark.read.parquet(store).count() == 30


def test_files_are_read_below_a_root(spark, tmp_path):
    for p, c in {"lib/conf/a b.txt": TOKEN, "lib/x.bin": "a\0b", "doc/é.md": "plain"}.items():
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text(c)
    read = artifacts.files(spark, str(tmp_path))
    assert {(r["repo"], r["path"], r["name"]) for r in read.drop("content").collect()} == {("lib", "conf", "a b.txt"), ("lib", ".", "x.bin"), ("doc", ".", "é.md")}
    assert [r["path"] for r in scan.scan(read, RULES)[0].collect()] == ["conf/a b.txt"]


def test_listings(spark, tmp_path):
    (tmp_path / "l.json").write_text(json.dumps({"results": [{"repo": "r", "path": ".", "name": "a", "size": 1, "sha256": "x", "type": "file"}], "range": {"total": 1}}))
    (tmp_path / "s.json").write_text(json.dumps({"files": [{"uri": "/d/e/f.txt", "size": 2, "folder": False, "sha2": "y"}, {"uri": "/d", "folder": True}, {"uri": "/top", "size": 1}]}))
    (tmp_path / "r.json").write_text(json.dumps([{"key": "k", "type": "LOCAL", "packageType": "npm", "more": 1}]))
    assert artifacts.listing(spark, str(tmp_path / "l.json")).first()["sha256"] == "x"
    assert {(r["path"], r["name"]) for r in artifacts.storage_listing(spark, str(tmp_path / "s.json"), "k").collect()} == {("d/e", "f.txt"), (".", "top")}
    assert artifacts.repositories(spark, str(tmp_path / "r.json")).first()["package_type"] == "npm"


def test_resume(spark, tmp_path):
    (tmp_path / "done").write_text(" r|a.txt \n\nr|d/b.txt|abc\n")
    df = items(spark, ("r", ".", "a.txt", b""), ("r", "d", "b.txt", b""), ("r", "d", "c.txt", b"")).withColumn("sha256", F.when(F.col("name") == "b.txt", "abc").otherwise(""))
    assert [r["name"] for r in findings.not_done(df, artifacts.resume_file(spark, str(tmp_path / "done"))).collect()] == ["c.txt"]


@pytest.mark.parametrize(("s", "n"), [("5MB", 5 << 20), ("512KB", 512 << 10), ("1G", 1 << 30), ("1024", 1024), ("2M", 2 << 20), ("10b", 10), ("1.5k", 1536)])
def test_parse_size(s, n):
    assert options.parse_size(s) == n


@pytest.mark.parametrize("s", ["", "x", "0", "-1", "5XB"])
def test_parse_size_refuses(s):
    with pytest.raises(ValueError, match="size"):
        options.parse_size(s)


@pytest.mark.parametrize(("s", "h"), [("24h", 24), ("7d", 168), ("2w", 336), ("90m", 1.5), ("1h30m", 1.5), ("0.5d", 12)])
def test_parse_since(s, h):
    assert options.parse_since(s) == dt.timedelta(hours=h)


@pytest.mark.parametrize("s", ["", "abc", "7", "-3d", "0d"])
def test_parse_since_refuses(s):
    with pytest.raises(ValueError, match="span"):
        options.parse_since(s)


def test_parse_basic():
    import base64

    assert options.parse_basic("Basic " + base64.b64encode(b"user:pa:ss").decode()) == ("user", "pa:ss")
    for bad in ("", "!!", base64.b64encode(b"nocolon").decode()):
        with pytest.raises(ValueError, match="."):
            options.parse_basic(bad)


def test_texts(spark):
    row = spark.range(1).select(text.clip(F.lit("héllo"), 3).alias("c"), *[text.format_duration(F.lit(s)).alias(f"d{s}") for s in (5, 90, 7384)], text.percent(F.lit(1), F.lit(0)).alias("p"), text.basic_auth(F.base64(F.encode(F.lit("u:p:q"), "UTF-8"))).alias("b")).first()
    assert (row["c"], row["d5"], row["d90"], row["d7384"], row["p"], row["b"]["password"]) == ("héllo"[:3], "5s", "1m30s", "2h03m04s", 0.0, "p:q")


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "in/lib").mkdir(parents=True)
    (tmp_path / "in/lib/a.txt").write_text(TOKEN)
    out = str(tmp_path / "rep")
    assert options.main([str(tmp_path / "in"), "--out", out, "--format", "json", "--fail-on-findings", "--live"]) == 3
    said = capsys.readouterr().err
    assert "lib/a.txt:1" in said and f"repos=1 files=1/1 bytes={len(TOKEN)} errors=0" in said and "findings: 1  (critical=" in said
    assert json.load(open(f"{out}.json"))["stats"]["files_selected"] == 1
    assert options.main([str(tmp_path / "in"), "--dry-run"]) == 0
    assert "lib/a.txt" in capsys.readouterr().out
    assert options.main([str(tmp_path / "in"), "--no-files"]) == 2
    assert options.main([str(tmp_path / "in"), "--max-size", "x"]) == 2
    assert options.main([str(tmp_path / "in"), "--package-type", "npm"]) == 2


@pytest.fixture
def one_rule(monkeypatch):
    """The command line with a single built-in rule, which plans faster."""
    monkeypatch.setattr("leakloom.functions.rules.load_rules", lambda *a: RULES)


def test_command_line_lists_what_it_would_scan(spark, one_rule, tmp_path, capsys):
    for name, body in {"a.txt": TOKEN, "b.png": "x", "c.zip": "x", "old.txt": TOKEN}.items():
        (tmp_path / "in/lib").mkdir(parents=True, exist_ok=True)
        (tmp_path / "in/lib" / name).write_text(body)
    os.utime(tmp_path / "in/lib/old.txt", (1_000_000_000, 1_000_000_000))
    assert options.main([str(tmp_path / "in"), "--dry-run", "--since", "1h"]) == 0
    assert capsys.readouterr().out == f"lib/a.txt\t{len(TOKEN)}\n"
    assert options.main([str(tmp_path / "in"), "--dry-run", "--crack"]) == 0
    assert sorted(x.split("\t")[0] for x in capsys.readouterr().out.splitlines()) == ["lib/a.txt", "lib/c.zip", "lib/old.txt"]


def test_command_line_leaves_errors_and_resume_keys_and_tries_again(spark, one_rule, tmp_path):
    src, out, done = tmp_path / "in/lib", str(tmp_path / "rep"), str(tmp_path / "done")
    src.mkdir(parents=True)
    (src / "a.txt").write_text(TOKEN)
    (src / "b.zip").write_text("no archive")
    args = [str(tmp_path / "in"), "--out", out, "--format", "json", "--crack", "--resume", done]
    assert options.main(args) == 0
    failed = f"{out}.errors.jsonl"
    assert [(r["name"], r["kind"]) for r in artifacts.errors(spark, failed).collect()] == [("b.zip", "archive")]
    assert {r["key"] for r in artifacts.resume_file(spark, done).collect()} == {"lib|a.txt"}
    (src / "b.zip").write_bytes(zipped(c_txt=TOKEN.replace("9f86", "aaaa")))
    assert options.main([*args, "--retry", failed, "--merge", f"{out}.json"]) == 0
    assert sorted(f["path"] for f in json.load(open(f"{out}.json"))["findings"]) == ["a.txt", "b.zip!c.txt"]
    assert not os.path.exists(failed) and not os.path.exists(f"{failed}.new")
    assert {r["key"] for r in artifacts.resume_file(spark, done).collect()} == {"lib|a.txt", "lib|b.zip"}
    assert options.main([*args[:5], "--dry-run", "--resume", done, "--crack"]) == 0


def test_command_line_tries_image_blobs_again(spark, one_rule, tmp_path):
    src, out = tmp_path / "in/img/app/1", str(tmp_path / "rep")
    src.mkdir(parents=True)
    (src / "manifest.json").write_text(json.dumps({"config": {"digest": DIGEST}, "layers": [{"digest": "sha256:aa", "size": 9}]}))
    (src / DIGEST.replace(":", "__")).write_text("{}")
    args = [str(tmp_path / "in"), "--out", out, "--format", "json", "--docker-layers", "--no-files"]
    assert options.main(args) == 0
    failed = f"{out}.errors.jsonl"
    assert [r["name"] for r in artifacts.errors(spark, failed).collect()] == ["sha256__aa"]
    (src / "sha256__aa").write_bytes(tarred("w:gz", app__x_env=TOKEN))
    assert options.main([*args, "--retry", failed, "--fail-on-findings"]) == 3
    assert [f["path"] for f in json.load(open(f"{out}.json"))["findings"]] == ["app/1/sha256__aa!app/x.env"] and not os.path.exists(failed)


def test_command_line_selects_repositories_of_a_catalogue(spark, one_rule, tmp_path, capsys):
    for repo in ("lib", "far-cache", "all", "img"):
        (tmp_path / "in" / repo).mkdir(parents=True)
        (tmp_path / "in" / repo / "a.txt").write_text(TOKEN)
    (tmp_path / "r.json").write_text(json.dumps([{"key": k, "type": t, "packageType": p} for k, t, p in (("lib", "LOCAL", "npm"), ("far", "REMOTE", "npm"), ("all", "VIRTUAL", "maven"), ("img", "LOCAL", "docker"))]))

    def listed(*flags):
        code = options.main([str(tmp_path / "in"), "--dry-run", "--repositories", str(tmp_path / "r.json"), *flags])
        return code, sorted(x.split("/")[0] for x in capsys.readouterr().out.splitlines())

    assert listed() == (0, ["img", "lib"])
    assert listed("--include-remote") == (0, ["far-cache", "img", "lib"])
    assert listed("--include-virtual", "--package-type", "maven,docker") == (0, ["all", "img"])
    assert listed("--repos", "far", "--exclude", "lib") == (0, ["far-cache"])
    assert listed("--package-type", "gems") == (1, [])


def test_environment_stands_in_for_options(spark, tmp_path, monkeypatch):
    (tmp_path / "in/lib").mkdir(parents=True)
    (tmp_path / "in/lib/a.txt").write_text("mine 123")
    (tmp_path / "rules.json").write_text('{"rules": [{"id": "mine", "regex": "mine [0-9]+"}]}')
    monkeypatch.setenv("LEAKLOOM_RULES", str(tmp_path / "rules.json"))
    assert options.or_env("x", "LEAKLOOM_RULES") == "x" and options.or_env("", "LEAKLOOM_NONE") == ""
    assert options.main([str(tmp_path / "in"), "--out", str(tmp_path / "rep"), "--format", "json", "--fail-on-findings"]) == 3


def test_pages_and_random_orders(spark):
    df = items(spark, *[("r", f"d{i % 3}", f"f{i}", b"") for i in range(20)])
    whole = [(r["path"], r["name"]) for r in df.orderBy("path", "name").collect()]
    assert [(r["path"], r["name"]) for n in range(0, 24, 6) for r in artifacts.listing_page(df, n, 6).collect()] == whole
    orders = [[r["name"] for r in shuffled(df.repartition(p), seed).collect()] for p, seed in ((1, 1), (5, 1), (3, 2))]
    assert orders[0] == orders[1] != orders[2] and sorted(orders[0]) == sorted(orders[2]) != orders[0]


def test_merge_does_not_depend_on_the_order_of_rows(spark):
    kind = ", ".join(f"`{c}` " + ("int" if c in ("line", "column") else "double" if c == "entropy" else "bigint" if c == "size" else "string") for c in findings.COLUMNS)
    rows = [tuple("same" if c == "fingerprint" else i if c == "line" else 1 if c == "column" else 1.0 if c == "entropy" else 1 if c == "size" else f"m{i}" if c == "match" else "" for c in findings.COLUMNS) for i in range(9)]
    none = spark.createDataFrame([], kind)
    for seed in range(3):
        assert findings.merge(spark.createDataFrame(rows, kind).orderBy(F.rand(seed)), none).first()["match"] == "m0"


def test_base64_keeps_rows_of_equal_names_apart(spark):
    import base64 as b64

    text_ = lambda d: "v: " + b64.b64encode(f'token = "{d}"'.encode()).decode()
    df = spark.createDataFrame([("r", "a", text_(HEX[:40])), ("r", "a", text_(HEX[1:41]))], "repo string, name string, content string")
    assert detect.detect(df, RULES).count() == 2


def test_rows_without_names_and_contents(spark):
    df = spark.createDataFrame([(None, None, None, TOKEN), ("r", None, "n", TOKEN), ("r", "p", None, None)], "repo string, path string, name string, content string").withColumns({"size": F.lit(1).cast("long"), "sha256": F.lit(None).cast("string"), "inner": F.lit(None).cast("string")})
    got = scan.scan_texts(df, RULES).collect()
    assert sorted((r["repo"] or "", r["path"]) for r in got) == [("", ""), ("r", "n")]
    assert scan.scan_texts(df.limit(0), RULES).count() == 0


def test_limits_and_severity(spark):
    rule = parse_rules('{"rules": [{"id": "a", "regex": "aa[0-9]", "severity": "low"}, {"id": "b", "regex": "bb[0-9]", "severity": "critical"}]}')
    df = spark.createDataFrame([("r", ".", "x.txt", 1, "", "aa1 bb2 aa3 bb4")], "repo string, path string, name string, size bigint, sha256 string, content string").withColumn("inner", F.lit(None).cast("string"))
    found = scan.scan_texts(df, rule, scan.Options(base64=False))
    assert [r["match"] for r in findings.limited(found, 3).collect()] == ["bb2", "bb4", "aa1"]
    assert detect.at_least(found, "high").count() == 2 and detect.at_least(found, "odd").count() == 4
