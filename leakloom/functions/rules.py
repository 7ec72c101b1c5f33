"""Detector rules: loading, defaults, precedence, and patterns for the JVM.

Rules are JSON (see data/rules.json). Patterns are written for leftmost-first engines that agree with
leftmost-longest ones on them: no lazy quantifiers, no alternative that begins another one, one
capture group at most. lint() tells which rules keep to that. Where the group takes no part in a match,
the whole match is the secret; a group that may take no part, but may also be empty, brings a warning.

Patterns are run by java.util.regex, so that is what must accept them: with a session at hand, rules that it refuses are
skipped. translated() turns what linear-time engines write in another way into Java's and Python's dialects.
"""

from __future__ import annotations

import json
import re
import warnings
from re import _parser as sre
from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import RULES

BUILT_IN = Path(__file__).resolve().parent.parent / "data" / "rules.json"
#: Ranks of severities; others rank 0.
SEVERITY = {"critical": 4, "high": 3, "medium": 2, "low": 1, "info": 0}
#: Word boundary by ASCII word characters, also next to accented letters.
BOUNDARY = r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))"

_PLAIN = re.compile(r"[A-Za-z0-9_\-:@/\"'. ]")
#: Named classes of bytes, as they stand inside brackets, and white space.
CLASSES = {
    "alnum": "0-9A-Za-z", "alpha": "A-Za-z", "ascii": r"\x00-\x7f", "blank": r"\t ", "cntrl": r"\x00-\x1f\x7f", "digit": "0-9", "graph": r"!-~", "lower": "a-z", "print": r" -~",
    "punct": r"!-/:-@\[-`{-~", "space": r"\t\n\x0b\f\r ", "upper": "A-Z", "word": "0-9A-Za-z_", "xdigit": "0-9A-Fa-f",
}
SPACE = r"\t\n\f\r "
_TOKEN = re.compile(r"\\Q.*?(?:\\E|$)|\\.|\[:\^?[a-z]+:\]|\(\?P?<[A-Za-z_]\w*>|\{\d+(?:,\d*)?\}|.", re.DOTALL)
#: A group, or a whole pattern, of nothing but plain alternatives.
_ALTERNATIVES = re.compile(r"((?<!\\)\((?:\?:|\?P?<[A-Za-z_]\w*>)?|^)([\w\- ]+(?:\|[\w\- ]+)+)(\)|$)")
_MULTILINE = re.compile(r"\(\?[a-zA-Z]*m")


def translated(regex: str, java: bool) -> tuple[str, int]:
    """A pattern in Java's or Python's dialect, and its number of capture groups.

    Groups lose their names, \\s is the space of linear-time engines (without VT), $ is the end of the text unless lines are
    asked for, \\Q...\\E is taken literally, and brackets, braces and && that are plain characters there are escaped.
    Plain alternatives go longest first, as engines that look for the longest match would choose.
    """
    regex = _ALTERNATIVES.sub(lambda m: m[1] + "|".join(sorted(m[2].split("|"), key=len, reverse=True)) + m[3], regex)
    out, groups, inside, first = [], 0, False, False
    lines = bool(_MULTILINE.search(regex))
    end = r"\z" if java else r"\Z"
    for m in _TOKEN.finditer(regex):
        t = m[0]
        if t.startswith("\\Q"):
            out.append(re.escape(t[2:].removesuffix("\\E")))
        elif t in ("\\s", "\\S"):
            out.append(SPACE if inside and t == "\\s" else t if inside else f"[{'^' if t[1] == 'S' else ''}{SPACE}]")
            first = False
        elif t == "\\z":
            out.append(end)
        elif t.startswith("[:") and inside and t.strip("[:^]") in CLASSES:
            body, first = CLASSES[t.strip("[:^]")], False
            out.append(f"[^{body}]" if "^" in t and java else body)
        elif inside and t[0] == "\\":
            out.append(t)
            first = False
        elif inside:
            for c in t:
                inside = inside and (c != "]" or first)
                out.append("\\" + c if c in "[&" or c == "]" and inside else c)
                first = first and c == "^" and out[-2] == "["
        elif t[0] == "[":
            out.append(t)
            inside = first = len(t) == 1
        elif t == "$" and not lines:
            out.append(end)
        elif t.startswith("(?P<") or t.startswith("(?<") and len(t) > 3:
            groups += 1
            out.append("(")
        else:
            if t == "(" and regex[m.end() : m.end() + 1] != "?":
                groups += 1
            out.append("\\{" if t == "{" else t)
    return "".join(out), groups


class NoRules(ValueError):
    pass


@dataclass(frozen=True)
class Rule:
    id: str
    name: str
    severity: str
    category: str
    regex: str
    keywords: tuple[str, ...] = ()
    entropy_min: float = 0.0
    description: str = ""
    ordinal: int = field(default=0, compare=False)

    @property
    def group(self) -> int:
        return min(1, translated(self.regex, java=True)[1])

    @property
    def whole(self) -> bool:
        """Whether an empty group means that it took no part in the match."""
        return bool(self.group) and (parsed := _parsed(self.regex)) is not None and _takes_part(parsed) is False

    @property
    def generic(self) -> bool:
        return self.category == "generic" or self.id.startswith("generic")

    @property
    def java(self) -> str:
        """The pattern with line ends, boundaries and case folding as the rules mean them.

        A boundary in front of a word character, or behind one at the end, needs to look to one side only.
        """
        flags, body = ("(?di)", self.regex[4:]) if self.regex.startswith("(?i)") else ("(?d)", self.regex)
        body = re.sub(r"^\\b(?=\(*(?:\?:)?[A-Za-z0-9])", r"(?<!\\w)", body)
        body = re.sub(r"(\[[A-Za-z0-9\-]+\](?:\{[0-9,]+\}|\+)?\)?)\\b$", r"\1(?!\\w)", body)
        body = translated(body, java=True)[0]
        return flags + re.sub(r"(\\\\)|\\b", lambda m: m[0] if m[1] else BOUNDARY, body)

    @property
    def literal(self) -> str:
        """Text that every match begins with; empty if the pattern doesn't show one."""
        parsed = _parsed(self.regex)
        return "" if parsed is None or parsed.state.flags & re.IGNORECASE else _opening(parsed)[0]


def _parsed(regex: str):
    """The pattern as Python reads it; None if only Java can."""
    try:
        return sre.parse(translated(regex, java=False)[0])
    except (re.error, OverflowError, RecursionError):
        return None


def _opening(parsed) -> tuple[str, bool]:
    """The characters that a parsed pattern must begin with, and whether they are all of it.

    Repeats, alternatives and classes end it, as do groups with flags of their own; a group without them is read as if it lay open.
    """
    text = ""
    for op, arg in parsed:
        if op is sre.LITERAL and _PLAIN.fullmatch(chr(arg)):
            text += chr(arg)
        elif op is sre.SUBPATTERN and not arg[1] and not arg[2]:
            inner, whole = _opening(arg[3])
            text += inner
            if not whole:
                return text, False
        elif op is not sre.AT:
            return text, False
    return text, True


def _takes_part(parsed) -> bool | None:
    """Whether the first group takes part in every match; None if it doesn't, but may also be empty where it does."""

    def found(items) -> bool:
        for op, arg in items:
            if op is sre.SUBPATTERN and (arg[0] == 1 or found(arg[3])):
                return True
            if op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and arg[0] > 0 and found(arg[2]):
                return True
            if op is sre.ATOMIC_GROUP and found(arg):
                return True
            if op is sre.BRANCH and all(found(x) for x in arg[1]):
                return True
        return False

    def group(items):
        for op, arg in items:
            parts = [arg[3]] if op is sre.SUBPATTERN else arg[1] if op is sre.BRANCH else [arg[2]] if op in (sre.MAX_REPEAT, sre.MIN_REPEAT) else [arg] if op is sre.ATOMIC_GROUP else []
            if op is sre.SUBPATTERN and arg[0] == 1:
                return arg[3]
            for x in parts:
                if (inner := group(x)) is not None:
                    return inner
        return None

    first = group(parsed)
    if parsed.state.groups < 2 or found(parsed):
        return True
    return False if first is not None and first.getwidth()[0] > 0 else None


def lint(regex: str) -> list[str]:
    """What keeps a pattern from meaning the same in every engine."""
    found = []
    bare = re.sub(r"\\.|\[(?:\\.|[^\]\\])*\]", "x", regex)
    if re.search(r"[*+?}]\?", bare):
        found.append("lazy quantifier")
    for group in re.findall(r"\((?:\?[:i]*)?([^()]*\|[^()]*)\)", bare):
        parts = group.split("|")
        if any(b.startswith(a) for i, a in enumerate(parts) for b in parts[i + 1 :]):
            found.append("an alternative begins a later one")
    try:
        compiled = re.compile(translated(regex, java=False)[0])
        if compiled.groups > 1:
            found.append("more than one capture group")
        if compiled.groups == 1 and re.search(r"(?<!\\)\((?!\?)[^()]*\)[?*]", regex):
            found.append("the capture group is optional")
    except re.error as e:
        found.append(f"invalid: {e}")
    return found


def _rule(raw: dict, ordinal: int, spark: SparkSession | None) -> Rule | None:
    rid, regex = (raw.get("id") or "").strip(), raw.get("regex") or ""
    if not rid or not regex:
        return None
    words = tuple(k.lower() for k in raw.get("keywords") or [])
    rule = Rule(rid, raw.get("name") or rid, (raw.get("severity") or "medium").lower(), raw.get("category") or "", regex, words, float(raw.get("entropy_min") or 0), raw.get("description") or "", ordinal)
    parsed = _parsed(regex)
    fault = refused(rule, spark) if spark is not None else "Python cannot read it" if parsed is None else None
    if fault:
        warnings.warn(f"rule {rid} is skipped: {fault}", stacklevel=3)
        return None
    if parsed is not None and _takes_part(parsed) is None:
        warnings.warn(f"rule {rid}: its group may take no part in a match or be empty, and such matches are dropped", stacklevel=3)
    return rule


def refused(rule: Rule, spark: SparkSession) -> str | None:
    """Why java.util.regex does not take a rule's pattern; None if it does."""
    from py4j.protocol import Py4JJavaError
    from pyspark.errors import PySparkException

    try:
        spark._jvm.java.util.regex.Pattern.compile(rule.java)
    except (Py4JJavaError, PySparkException) as e:
        said = e.java_exception.getMessage() if isinstance(e, Py4JJavaError) else e
        return str(said).splitlines()[0]
    return None


def first_wins(rules: Iterable[Rule]) -> list[Rule]:
    """One rule an id, the first; renumbered."""
    seen: dict[str, Rule] = {}
    for r in rules:
        seen.setdefault(r.id, r)
    return [Rule(*[getattr(r, f) for f in ("id", "name", "severity", "category", "regex", "keywords", "entropy_min", "description")], ordinal=i) for i, r in enumerate(seen.values())]


def parse_rules(*texts: str, spark: SparkSession | None = None) -> list[Rule]:
    """Rules of JSON documents in order. Invalid ones are skipped with a warning; NoRules if none is left.

    With a session, Java's engine says what is invalid; without one, Python's stands in for it.
    """
    rules, n = [], 0
    for text in texts:
        for raw in json.loads(text).get("rules") or []:
            rule = _rule(raw, n, spark)
            n += 1
            if rule:
                rules.append(rule)
    if not rules:
        raise NoRules("no usable rule")
    return first_wins(rules)


def load_rules(spark: SparkSession | None = None, path: str | None = None) -> list[Rule]:
    """The built-in rules, and those of a JSON file behind them. Spark reads the file, wherever it lies."""
    texts = [BUILT_IN.read_text(encoding="utf-8")]
    if path:
        texts.append(spark.read.text(path, wholetext=True).first()[0] if spark else Path(path).read_text(encoding="utf-8"))
    return parse_rules(*texts, spark=spark)


def ruleset_version(text: str | None = None) -> str:
    return json.loads(text if text is not None else BUILT_IN.read_text(encoding="utf-8")).get("version") or "unknown"


def pick(rules: Sequence[Rule], *ids: str) -> list[Rule]:
    by_id = {r.id: r for r in rules}
    return [by_id[i] for i in ids]


def rules_table(spark: SparkSession, rules: Sequence[Rule]) -> DataFrame:
    rows = [(r.id, r.name, r.severity, r.category, r.regex, list(r.keywords), r.entropy_min, r.description, r.ordinal) for r in rules]
    return spark.createDataFrame(rows, RULES)


def severity_rank(severity: Column) -> Column:
    out = None
    for name, rank in SEVERITY.items():
        out = F.when(severity == name, rank) if out is None else out.when(severity == name, rank)
    return out.otherwise(0)
