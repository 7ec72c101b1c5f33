"""URL filters: many glob rules at once, by a bit-parallel automaton.

A glob is a row of elements: a literal byte, `?` (any one byte of its part) or `*` (any run
of bytes of its part). State j of a glob means that its first j elements have matched; every
glob's states get consecutive bits in a row of 64-bit words. For each byte value, mask `step`
holds the states whose next element takes it and mask `stay` those standing before a star
that takes it, so one byte of input moves all states of all globs by

    states = shift(states & step[byte]) | (states & stay[byte])

with carries between the words of a row. All URLs of a batch advance together, one byte
position a time. Globs are anchored at both ends.

A canonical URL is host + NUL + path: the host in lower case (A-Z only), up to the first `/`,
`?` or `#` after the first `://`; the path up to `?` or `#`. A glob is written host glob,
then `/`, then the path glob, and its host stars never cross into the path.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .textcore import flat

MARK = 0


@dataclass(frozen=True)
class Rule:
    """A rule of an allow or block list. It fits its host and all of its subdomains if the path starts with its path."""

    verdict: str
    host: str
    path: str

    @property
    def label(self) -> str:
        return self.host + self.path

    def globs(self) -> list[str]:
        quoted = "".join(f"\\{c}" if c in "*?\\" else c for c in self.path[1:])
        return [f"{self.host}/{quoted}*", f"*.{self.host}/{quoted}*"]


def _elements(glob: str) -> list[tuple[str, int]]:
    """(kind, byte) of each element; kinds: lit, host1, host*, path1, path*."""
    out, part, data, i = [], "host", glob.encode(), 0
    while i < len(data):
        c = data[i]
        if c == 0x5C and i + 1 < len(data):
            i += 1
            out.append(("lit", data[i]))
        elif c == 0x2A:
            out.append((f"{part}*", 0))
        elif c == 0x3F:
            out.append((f"{part}1", 0))
        elif c == 0x2F and part == "host":
            part = "path"
            out += [("lit", MARK), ("lit", c)]
        else:
            out.append(("lit", c))
        i += 1
    return out


class Automaton:
    """The masks of a list of globs."""

    def __init__(self, globs: Sequence[str]):
        rows = [_elements(g) for g in globs]
        bits = sum(sum(k[-1] != "*" for k, _ in r) + 1 for r in rows)
        self.words = max(1, -(-bits // 64))
        self.step = np.zeros((256, self.words), np.uint64)
        self.stay = np.zeros((256, self.words), np.uint64)
        self.start = np.zeros(self.words, np.uint64)
        self.final = []
        bit = 0
        for row in rows:
            self._set(self.start, bit)
            for kind, byte in row:
                takes = [byte] if kind == "lit" else [b for b in range(256) if b != MARK]
                mask = self.stay if kind[-1] == "*" else self.step
                for b in takes:
                    self._set(mask[b], bit)
                bit += kind[-1] != "*"
            self.final.append(bit)
            bit += 1

    @staticmethod
    def _set(words: np.ndarray, bit: int) -> None:
        words[bit >> 6] |= np.uint64(1) << np.uint64(bit & 63)

    def run(self, buf: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """For each row of bytes, whether each glob matches the whole of it: a bool matrix."""
        length = np.diff(rows)
        order = np.argsort(-length, kind="stable")
        at, length = rows[:-1][order], length[order]
        states = np.tile(self.start, (len(at), 1))
        alive = np.searchsorted(-length, -np.arange(int(length[0]) if len(length) else 0), "left")
        for i, n in enumerate(alive):  # rows are by falling length: the first n have a byte i
            c = buf[at[:n] + i]
            own = states[:n]
            moved = own & self.step[c]
            carry = moved >> np.uint64(63)
            moved = moved << np.uint64(1)
            moved[:, 1:] |= carry[:, :-1]
            states[:n] = moved | own & self.stay[c]
        out = np.empty((len(at), len(self.final)), bool)
        for k, bit in enumerate(self.final):
            out[order, k] = (states[:, bit >> 6] >> np.uint64(bit & 63) & np.uint64(1)).astype(bool)
        return out


def host_of(url: Column) -> Column:
    """Host of a URL; empty if it is null or has no ://."""
    return F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """Path of a URL, without query and fragment; empty if it is null or has no ://."""
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    u = F.coalesce(url, F.lit(""))
    return F.when(F.instr(u, "://") > 0, F.substring(u, F.instr(u, "://") + 3, F.length(u))).otherwise("")


def match_globs(df: DataFrame, globs: Sequence[str], url_col: str = "url", out_col: str = "globs") -> DataFrame:
    """df and an array of the numbers of all globs that match each row's canonical URL (out_col is replaced if it exists).

    Null, empty and scheme-less URLs have the canonical form NUL, which only a glob like `*/*` could not match either.
    """
    auto = Automaton(globs)
    df = df.drop(out_col)
    url = F.col(f"`{url_col}`")
    held = df.withColumn("__leakloom_url", F.concat(F.translate(host_of(url), "\0", "\1"), F.lit("\0"), F.translate(path_of(url), "\0", "\1")))

    names = [*df.columns, out_col]

    def scan(batches):
        for b in batches:
            for i in range(0, b.num_rows, 8192):
                part = b.slice(i, 8192)
                hit = auto.run(*flat(part.column(part.schema.names.index("__leakloom_url"))))
                offsets = np.concatenate([[0], np.cumsum(hit.sum(1))]).astype(np.int32)
                found = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.nonzero(hit)[1].astype(np.int32)))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], found], names=names)

    return held.mapInArrow(scan, T.StructType([*df.schema.fields, T.StructField(out_col, T.ArrayType(T.IntegerType()))]))


def judge_urls(df: DataFrame, rules: Sequence[Rule], block_globs: Sequence[str], url_col: str = "url") -> DataFrame:
    """df with host, path, rule and verdict; columns of these names are replaced, and url_col may be one of them.

    The longest fitting rule decides (first listed of equals); without one the verdict is block if any of block_globs
    matches, else allow. Null urls and those without :// have an empty host and path. Each row is judged alone, repeated ones alike.
    """
    globs = [g for r in rules for g in r.globs()] + list(block_globs)
    hit = match_globs(df, globs, url_col, "__leakloom_globs")
    rule, verdict = F.lit(None).cast("string"), F.when(F.exists("__leakloom_globs", lambda g: g >= 2 * len(rules)), "block").otherwise("allow")
    for i, r in sorted(enumerate(rules), key=lambda x: (len(x[1].label), -x[0])):  # the last to fit is the longest
        fits = F.arrays_overlap("__leakloom_globs", F.array(F.lit(2 * i), F.lit(2 * i + 1)))
        rule, verdict = F.when(fits, r.label).otherwise(rule), F.when(fits, r.verdict).otherwise(verdict)
    url = F.col(f"`{url_col}`")
    return hit.withColumns({"host": host_of(url), "path": path_of(url), "rule": rule, "verdict": verdict}).drop("__leakloom_globs")
