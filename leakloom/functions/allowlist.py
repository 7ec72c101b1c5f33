"""Placeholders, templates and other values that are never reported."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import byte_hex, contains_any

#: Whole secrets that are placeholders, as they are.
PLACEHOLDERS = [
    "AKIA" + "IOSFODNN7EXAMPLE", "wJalrXUtnFEMI" + "/K7MDENG/bPxRfiCYEXAMPLEKEY", "EXAMPLE", "example", "changeme", "password", "changeit", "secret", "redacted", "REDACTED",
    "xxxxxxxx", "your_api_key", "your-api-key", "yourapikey", "none", "null", "true", "false", "00000000000000000000000000000000",
]
#: Parts of placeholders, in lower case, in a secret of any length.
PLACEHOLDER_PARTS = [
    "example", "xxxxx", "placeholder", "your_", "your-", "yourtoken", "changeme", "change_me", "dummy", "test_test", "sample", "redacted", "insert_", "<your", "notreal",
    "todo", "lorem", "foobar", "secretsecret", "asdfasdf", "qwerty",
]
#: Parts that only count in secrets of at most 24 bytes, in lower case.
SHORT_PARTS = ["01234567", "abcdefgh", "deadbeef", "0xdeadbeef", "aaaaaa", "bbbbbb", "123456789", "fake"]
#: Openings of templates.
TEMPLATES = ["${", "{{", "%(", "#{", "<%", "$("]
#: Fixed value: characters of masks.
MASK = "*•#.-_= "
#: Fixed value: Unicode white space that trimming removes.
SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def is_generic(rule_id: Column, category: Column) -> Column:
    return (category == "generic") | rule_id.startswith("generic")


def tests(secret: Column, generic: Column) -> dict[str, Column]:
    """The single tests by name, each true for a false positive. They take the trimmed secret."""
    s = F.btrim(secret, F.lit(SPACE))
    low = F.lower(s)
    return {
        "empty": s == "",
        "placeholder": s.isin(PLACEHOLDERS),
        "placeholder_part": contains_any(low, PLACEHOLDER_PARTS),
        "short_part": (F.octet_length(s) <= 24) & contains_any(low, SHORT_PARTS),
        "maven": s.rlike(r"^\{[A-Za-z0-9+/=]{8,}\}\z"),
        "one_byte": (F.octet_length(s) >= 6) & (F.size(F.array_distinct(byte_hex(F.encode(s, "UTF-8")))) == 1),
        "mask": F.btrim(s, F.lit(MASK)) == "",
        "template": contains_any(s, TEMPLATES),
        "few_letters": generic & (F.size(F.array_distinct(F.split(s, ""))) < 5),
        "plain_hex": generic & s.rlike(r"^[0-9a-fA-F]+\z") & ((F.octet_length(s) <= 16) | F.octet_length(s).isin(32, 40, 64)),
    }


def is_false_positive(secret: Column, generic: Column) -> Column:
    out = F.lit(False)
    for test in tests(secret, generic).values():
        out = out | test
    return out
