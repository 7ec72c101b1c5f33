"""Detection: rules over text, directly and inside base64 runs.

Every rule is unrolled into a cheap test of the text (what a match begins with, keywords); only the rules that pass
are searched for, by one expression whose pattern is the rule's. So a scan is one narrow stage of built-in
expressions: no Python, no join with the rules, no shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import allowlist, text
from ..functions.rules import SEVERITY, Rule, severity_rank

#: Matches of a rule and base64 runs of an alphabet that are looked at in one text, and bytes of the longest run; 0: all of them.
MOST_MATCHES = 64
MOST_RUNS = 256
LONGEST_RUN = 262_144
#: base64 runs of either alphabet.
RUNS = {"std": r"[A-Za-z0-9+/]{24,}={0,2}", "url": r"[A-Za-z0-9_-]{24,}={0,2}"}
#: What a text with a run of either alphabet has. Runs begin where no character of theirs goes before, so that none is tried from its middle.
SOME_RUN = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{24}"


def keyword_hit(content: Column, rule: Rule) -> Column:
    """Whether any keyword occurs, A-Z folded; true without keywords."""
    if not rule.keywords or "" in rule.keywords:
        return F.lit(True)
    plain = [k for k in rule.keywords if k.isascii()]
    other = [k for k in rule.keywords if not k.isascii()]
    return text.contains_any(text.folded(content), plain) | text.contains_any(text.ascii_lower(content), other)


def _literal(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


#: Characters that are rare in prose, rarest first: rules whose matches begin with text that has one are tested only where it occurs.
RARE = "$@_=:/-.0123456789"


def _tests(rule: Rule, content: str, lower: str) -> str:
    """SQL for the cheap tests of a rule on column `content`: what every match begins with, then the keywords; lower has text.folded() of it."""
    tests = [f"contains({content}, {_literal(rule.literal)})"] if rule.literal else []
    if rule.keywords and "" not in rule.keywords:
        ascii_only = f"translate({content}, '{text.UPPER}', '{text.LOWER}')"
        tests.append("(" + " OR ".join(f"contains({lower if k.isascii() else ascii_only}, {_literal(k)})" for k in rule.keywords) + ")")
    return " AND ".join(tests) or "true"


def candidates_sql(rules: Sequence[Rule], content: str, lower: str) -> str:
    """SQL for the array of places (in rules) of the rules that a text must be searched for.

    SQL text makes hundreds of rules one call to the JVM.
    """
    groups: dict[str, list[str]] = {}
    for i, r in enumerate(rules):
        rare = next((c for c in RARE if c in r.literal), "")
        groups.setdefault(rare, []).append(f"CASE WHEN {_tests(r, content, lower)} THEN {i} END")
    parts = [f"CASE WHEN contains({content}, {_literal(c)}) THEN array({', '.join(x)}) ELSE cast(array() as array<int>) END" if c else f"array({', '.join(x)})" for c, x in groups.items()]
    return f"array_compact(concat({', '.join(parts)}))"


def raw_matches(df: DataFrame, rules: Sequence[Rule], content: str = "content", most: int = MOST_MATCHES) -> DataFrame:
    """df with a row for each match: columns ordinal, match_no, match, secret, and prefix (the text in front) for the content column.

    The first `most` matches of each rule in a text (0: all). A text is searched only for rules whose cheap tests it passes.
    """

    def of_rule(value) -> Column:
        return F.expr(f"element_at(array({', '.join(map(value, rules))}), _i + 1)")

    # explode_outer, as the optimizer would test explode's array for emptiness by computing it once more
    rows = df.withColumn("_lower", text.folded(F.col(content))).withColumn("_i", F.explode_outer(F.expr(candidates_sql(rules, f"`{content}`", "`_lower`")))).where("_i is not null")
    rows = rows.select(*df.columns, of_rule(lambda r: str(r.ordinal)).alias("ordinal"), of_rule(lambda r: str(r.group)).alias("_g"), of_rule(lambda r: str(r.whole).lower()).alias("_w"), of_rule(lambda r: _literal(r.java)).alias("_p"))
    groups = F.when(F.col("_g") > 0, F.regexp_extract_all(content, F.col("_p"), F.col("_g")))
    rows = rows.withColumn("_z", F.struct(F.regexp_extract_all(content, F.col("_p"), F.lit(0)).alias("m"), groups.alias("s"), F.split(content, F.col("_p"), -1).alias("b")))

    def one(x: Column, i: Column) -> Column:
        own = F.get("_z.s", i)
        secret = F.when((F.col("_g") == 0) | (F.col("_w") & (own == "")), x).otherwise(own)
        return F.struct(i.alias("no"), x.alias("match"), secret.alias("secret"), (_chars(F.col("_z.b"), i + 1) + _chars(F.col("_z.m"), i)).alias("before"))

    found = F.transform(F.slice("_z.m", 1, most) if most else F.col("_z.m"), one)
    rows = rows.withColumn("_m", F.explode_outer(found)).where("_m is not null")
    return rows.select(
        *[c for c in df.columns if c != content],
        "ordinal",
        F.col("_m.no").alias("match_no"),
        F.col("_m.match").alias("match"),
        F.col("_m.secret").alias("secret"),
        F.substring(content, F.lit(1), F.col("_m.before")).alias("prefix"),
    )


def _by_rule(rules: Sequence[Rule], value) -> Column:
    """A rule's attribute for the row's ordinal, as a literal map."""
    pairs = [F.lit(x) for r in rules for x in (r.ordinal, value(r))]
    return F.create_map(*pairs)[F.col("ordinal")]


def gated(matches: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Matches that pass the entropy gate and are no false positives, with rule attributes, entropy, line and column.

    A column bytewise says where a character stands for a byte; such matches become text again.
    """
    bytewise = F.col("bytewise") if "bytewise" in matches.columns else None
    if bytewise is not None:
        matches = matches.withColumns({c: F.when(bytewise, text.from_characters(F.col(c))).otherwise(F.col(c)) for c in ("match", "secret")})
    out = matches.withColumns(
        {
            "rule_id": _by_rule(rules, lambda r: r.id),
            "rule_name": _by_rule(rules, lambda r: r.name),
            "severity": _by_rule(rules, lambda r: r.severity),
            "category": _by_rule(rules, lambda r: r.category),
            "_least": _by_rule(rules, lambda r: float(r.entropy_min)),
            "_entropy": text.entropy(F.col("secret")),
        }
    ).where(F.col("secret") != "")
    out = out.where((F.col("_least") <= 0) | (F.col("_entropy") >= F.col("_least")))
    out = out.where(~allowlist.is_false_positive(F.col("secret"), allowlist.is_generic(F.col("rule_id"), F.col("category"))))
    return out.withColumns({"entropy": text.round2(F.col("_entropy")), "line": text.line_of(F.col("prefix")), "column": text.column_of(F.col("prefix"), bytewise)}).drop("_least", "_entropy", "prefix")


def base64_runs(df: DataFrame, content: str = "content", most: int = MOST_RUNS, longest: int = LONGEST_RUN) -> DataFrame:
    """df with a row for each decodable run: phase (1 standard, 2 URL alphabet), run_no, run_before, decoded (text); content stays.

    Runs have 24 bytes or more, `longest` at most, and are the first `most` of an alphabet (0: all); decoded they have 8 bytes or more of
    valid, mostly printable UTF-8.
    """
    rows = df.withColumn("_r", F.explode_outer(_all_runs(content, most))).withColumn("_d", _decoded(F.col("_r.run"), longest)).where(F.col("_d").isNotNull())
    return rows.select(*df.columns, F.col("_r.phase").alias("phase"), F.col("_r.no").alias("run_no"), F.col("_r.before").alias("run_before"), F.col("_d").alias("decoded"))


def _decoded(run: Column, longest: int) -> Column:
    """The text that a run stands for; null if it is none that is looked at."""
    data = text.decode_base64(run)
    good = (F.octet_length(data) >= 8) & F.is_valid_utf8(data.cast("string")) & text.mostly_printable(data)
    return F.when((F.octet_length(run) <= longest) & good if longest else good, data.cast("string"))


def _all_runs(content: str, most: int) -> Column:
    """(phase, no, before, run) of a text's runs in both alphabets."""
    arrays = []
    for phase, pattern in enumerate(RUNS.values(), 1):
        pattern = f"(?<!{pattern[: pattern.index(']') + 1]}){pattern}"
        runs = F.regexp_extract_all(F.col(content), F.lit(pattern), F.lit(0))
        between = F.split(F.col(content), pattern, -1)
        arrays.append(_runs(runs, between, phase, most))
    none = F.array().cast("array<struct<phase:int,no:int,before:int,run:string>>")
    return F.when(F.col(content).rlike(SOME_RUN), F.concat(*arrays)).otherwise(none)


def _chars(parts: Column, n: Column) -> Column:
    """Characters of the first n strings of an array."""
    return F.aggregate(F.slice(parts, F.lit(1), n), F.lit(0), lambda a, x: a + F.char_length(x))


def _runs(runs: Column, between: Column, phase: int, most: int) -> Column:
    def one(x, i):
        return F.struct(F.lit(phase).alias("phase"), i.alias("no"), (_chars(between, i + 1) + _chars(runs, i)).alias("before"), x.alias("run"))

    return F.transform(F.slice(runs, 1, most) if most else runs, one)


KEYS = ["phase", "run_no", "ordinal", "match_no"]


def detect(df: DataFrame, rules: Sequence[Rule], base64: bool = True, content: str = "content", most_matches: int = MOST_MATCHES, most_runs: int = MOST_RUNS, longest_run: int = LONGEST_RUN) -> DataFrame:
    """Findings of every row of df: its other columns, then ordinal, match_no, match, secret, rule attributes, entropy, line,
    column, via_decoder, and phase and run_no (0 for direct findings) which with ordinal and match_no give their order.

    Findings inside a base64 run have the run's place; a run of the URL alphabet counts only where the standard one that
    starts at the same place has none. Null contents have none. A column bytewise is read as gated() does, and dropped.
    """
    read = df.where(F.col(content).isNotNull())
    if not base64:
        return gated(raw_matches(read, rules, content, most_matches), rules).withColumns({"via_decoder": F.lit(""), "phase": F.lit(0), "run_no": F.lit(0)}).drop("bytewise")
    others = [c for c in df.columns if c not in (content, "bytewise")]
    bytewise = F.col("bytewise") if "bytewise" in df.columns else F.lit(False)
    # a text and its decoded runs are rows alike, so that the rules stand in the plan once
    itself = F.struct(F.lit(0).alias("phase"), F.lit(0).alias("no"), F.lit(0).alias("before"), F.lit(None).cast("string").alias("run"))
    rows = read.withColumn("_r", F.explode_outer(F.concat(F.array(itself), _all_runs(content, most_runs))))
    inside = F.col("_r.phase") > 0
    place = F.substring(content, F.lit(1), F.col("_r.before"))
    rows = rows.select(
        *others,
        F.when(inside, _decoded(F.col("_r.run"), longest_run)).otherwise(F.col(content)).alias(content),
        (bytewise & ~inside).alias("bytewise"),
        F.col("_r.phase").alias("phase"),
        F.col("_r.no").alias("run_no"),
        F.when(inside, text.line_of(place)).alias("_line"),
        F.when(inside, text.column_of(place, bytewise)).alias("_column"),
        # both alphabets' runs of a row meet by its columns, its text and their place, so that rows with equal names stay apart
        F.when(inside, F.col("_r.before")).alias("_at"),
        F.when(inside, F.xxhash64(content)).alias("_row"),
    ).where(F.col(content).isNotNull())
    found = gated(raw_matches(rows, rules, content, most_matches), rules)
    found = found.withColumns({"line": F.coalesce("_line", "line"), "column": F.coalesce("_column", "column"), "via_decoder": F.when(F.col("phase") > 0, "base64").otherwise("")})
    first = F.min("phase").over(Window.partitionBy(*others, "_row", "_at"))
    found = found.withColumn("_first", first).where(F.col("phase") == F.col("_first"))
    return found.drop("_first", "_at", "_row", "_line", "_column", "bytewise")


def at_least(findings: DataFrame, severity: str) -> DataFrame:
    """Findings of a severity or above; an unknown name keeps all."""
    return findings.where(severity_rank(F.col("severity")) >= SEVERITY.get(severity.lower(), 0))
