"""Scalar functions as Column expressions; all of them stay inside the JVM.

Byte semantics (offsets, columns, entropy) use octet_length or hex; code points use char_length.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(s: Column) -> Column:
    return F.translate(s, UPPER, LOWER)


#: The characters beyond ASCII whose lower case has letters of ASCII.
FOLD_TO_ASCII = ("\u0130", "\u212a")


def folded(s: Column) -> Column:
    """Lower case in which ASCII letters come from ASCII letters only, so that ASCII text is found in it as with A-Z folded."""
    for c in FOLD_TO_ASCII:
        s = F.replace(s, F.lit(c), F.lit("\ufffd"))
    return F.lower(s)


def contains_any(s: Column, parts) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | s.contains(p)
    return out


def byte_hex(s: Column) -> Column:
    """The bytes of a string or binary as two-digit hex values."""
    return F.regexp_extract_all(F.hex(s), F.lit(".."), F.lit(0))


def entropy(s: Column) -> Column:
    """Shannon entropy in bits per byte; 0 for an empty string."""
    data = byte_hex(F.encode(s, "UTF-8"))
    n = F.size(data).cast("double")
    # distinct bytes in byte order, so that the sum is the same on every run
    counts = F.transform(F.array_sort(F.array_distinct(data)), lambda x: F.size(F.filter(data, lambda y: y == x)).cast("double"))
    total = F.aggregate(counts, F.lit(0.0), lambda acc, c: acc - (c / n) * F.log2(c / n))
    return F.when(F.octet_length(s) == 0, F.lit(0.0)).otherwise(total)


def round2(x: Column) -> Column:
    """Two decimals, halves up, in doubles."""
    return F.floor(x.cast("double") * F.lit(100.0) + F.lit(0.5)).cast("double") / F.lit(100.0)


def collapse(s: Column, most: int = 200) -> Column:
    """Runs of newline, return, tab and space as one space, trimmed; cut to `most` characters and an ellipsis."""
    one = F.trim(F.regexp_replace(s, r"[\n\r\t ]+", " "))
    return F.when(F.char_length(one) > most, F.concat(F.left(one, F.lit(most)), F.lit("…"))).otherwise(one)


def redact(secret: Column, rounded_entropy: Column) -> Column:
    """A short prefix of long, dense secrets; four stars for all others."""
    one = collapse(secret)
    n = F.char_length(one)
    return F.when((n < 16) | (rounded_entropy < 3.5), "****").otherwise(F.concat(F.left(one, F.lit(4)), F.lit("…[redacted "), n.cast("string"), F.lit("]")))


def fingerprint(*parts: Column) -> Column:
    """First 16 hex digits of the SHA-1 of the NUL-joined parts."""
    return F.left(F.sha1(F.concat_ws("\0", *[F.coalesce(p, F.lit("")) for p in parts])), F.lit(16))


def line_of(before: Column) -> Column:
    """1-based line of the character behind a prefix."""
    return (F.char_length(before) - F.char_length(F.replace(before, F.lit("\n"))) + 1).cast("int")


def column_of(before: Column, single_bytes: Column | None = None) -> Column:
    """1-based byte column of the character behind a prefix. Where single_bytes, each character stands for one byte."""
    line = F.substring_index(before, "\n", -1)
    n = F.octet_length(line) if single_bytes is None else F.when(single_bytes, F.char_length(line)).otherwise(F.octet_length(line))
    return (n + 1).cast("int")


def as_characters(data: Column) -> Column:
    """Every byte as one character, so that classes of bytes are classes of characters."""
    return F.decode(data, "ISO-8859-1")


def from_characters(s: Column) -> Column:
    """The text of bytes that were read as characters; what is no UTF-8 is replaced."""
    return F.make_valid_utf8(F.encode(s, "ISO-8859-1").cast("string"))


def is_binary(data: Column) -> Column:
    """Empty, or in the first 8 KiB a NUL or more than 30 % control bytes (newline, return, tab and form feed are none)."""
    head = as_characters(F.substring(data, 1, 8192))
    n = F.char_length(head)
    control = n - F.char_length(F.regexp_replace(head, r"[\x00-\x08\x0b\x0e-\x1f\x7f]+", ""))
    return (n == 0) | head.contains("\0") | (control / F.greatest(n, F.lit(1)) > 0.30)


def mostly_printable(data: Column) -> Column:
    """More than 85 % of the bytes are printable ASCII, newline, return or tab."""
    each = as_characters(data)
    return F.char_length(F.regexp_replace(each, r"[^\n\r\t -~]+", "")) / F.greatest(F.char_length(each), F.lit(1)) > 0.85


def decode_base64(run: Column) -> Column:
    """Bytes of a padded or unpadded run of either alphabet; null if it is none or empty."""
    data = F.try_to_binary(F.translate(run, "-_", "+/"), F.lit("base64"))
    return F.when(F.octet_length(data) > 0, data)


def full_path(path: Column, name: Column) -> Column:
    """Folder and name; a missing one counts as empty."""
    path, name = F.coalesce(path, F.lit("")), F.coalesce(name, F.lit(""))
    return F.when(path.isin("", "."), name).otherwise(F.concat(path, F.lit("/"), name))


def split_folder(rel: Column) -> Column:
    return F.when(rel.contains("/"), F.regexp_extract(rel, r"(?s)^(.*)/", 1)).otherwise(".")


def split_name(rel: Column) -> Column:
    return F.element_at(F.split(rel, "/"), -1)


#: How url_encode writes a character, and how a path segment has it.
SEGMENT = [("+", "%20"), ("%24", "$"), ("%26", "&"), ("%2B", "+"), ("%3A", ":"), ("%3D", "="), ("%40", "@"), ("%7E", "~"), ("*", "%2A")]


def escape_path(path: Column) -> Column:
    """Percent-encode each segment, keep the slashes."""

    def one(seg: Column) -> Column:
        out = F.url_encode(seg)
        for a, b in SEGMENT:
            out = F.replace(out, F.lit(a), F.lit(b))
        return out

    return F.array_join(F.transform(F.split(path, "/"), one), "/")


def artifact_url(base: str, repo: Column, path: Column) -> Column:
    return F.concat(F.lit(base.rstrip("/") + "/"), escape_path(repo), F.lit("/"), escape_path(path))


def csv_safe(s: Column) -> Column:
    """A quote in front of what a spreadsheet would run as a formula."""
    return F.when(s.rlike("^[=+\\-@\t\r]"), F.concat(F.lit("'"), s)).otherwise(s)


def human_bytes(n: Column) -> Column:
    """Binary units with one decimal, exact halves to the even digit."""
    out = None
    for i, unit in reversed(list(enumerate("KMGTPE"))):
        text = F.format_string(f"%.1f {unit}iB", F.bround(n.cast("double") / F.lit(float(1024 ** (i + 1))), 1))
        out = F.when(n >= F.lit(1024 ** (i + 1)), text) if out is None else out.when(n >= F.lit(1024 ** (i + 1)), text)
    return out.otherwise(F.concat(n.cast("string"), F.lit(" B")))


def format_duration(seconds: Column) -> Column:
    s = F.floor(seconds.cast("double") + F.lit(0.5)).cast("long")
    h, m, r = F.floor(s / 3600), F.floor((s % 3600) / 60), s % 60
    return F.when(h > 0, F.format_string("%dh%02dm%02ds", h, m, r)).when(m > 0, F.format_string("%dm%02ds", m, r)).otherwise(F.format_string("%ds", r))


def percent(part: Column, whole: Column) -> Column:
    return F.when(whole <= 0, F.lit(0.0)).otherwise(F.lit(100.0) * part / whole)


def clip(s: Column, n: int) -> Column:
    """The first n characters."""
    return F.left(s, F.lit(n))


def size_bytes(s: Column) -> Column:
    """Bytes of a size such as 5MB, 512KB, 1G, 1024; null if it is none or not positive."""
    t = F.upper(F.trim(s))
    number = F.trim(F.regexp_extract(t, r"^([0-9.]+)\s*([KMG]?)B?$", 1)).try_cast("double")
    unit = F.regexp_extract(t, r"^([0-9.]+)\s*([KMG]?)B?$", 2)
    scale = F.when(unit == "K", 1 << 10).when(unit == "M", 1 << 20).when(unit == "G", 1 << 30).otherwise(1)
    value = (number * scale).cast("long")
    return F.when(value > 0, value)


def resume_key(repo: Column, path: Column, sha256: Column) -> Column:
    return F.concat_ws("|", repo, path, F.when(sha256 != "", sha256))


def basic_auth(text: Column) -> Column:
    """User and password of a Basic credential, split at the first colon; null if it has none."""
    plain = F.try_to_binary(text, F.lit("base64")).cast("string")
    parts = F.split(plain, ":", 2)
    return F.when(F.size(parts) == 2, F.struct(F.get(parts, 0).alias("user"), F.get(parts, 1).alias("password")))


def live_line(severity: Column, rule: Column, repo: Column, path: Column, line: Column) -> Column:
    return F.format_string("%-8s %s  %s/%s:%d", F.upper(severity), rule, repo, path, line)
