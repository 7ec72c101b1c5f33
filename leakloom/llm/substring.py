"""Substring dedup: passages of `length` words that occur anywhere else, by compressed FM-indexes.

A shard's index must meet every occurrence of a window, without every document visiting every
shard. So a window's shard follows from its content: of the k-word hashes inside it the leftmost
smallest is its anchor, and equal windows have equal anchors. Only anchors that occur twice can
own a repeated window; the others are dropped after one exact count. What an anchor owns in a
document is one segment: its consecutive windows, about half as many words again around them.

Each shard builds an FM-index over the distinct segments of its anchors: suffixes sorted by
prefix doubling, the Burrows-Wheeler transform kept only as a bit-packed wavelet matrix, words
as its symbols. Segments then stream through it backwards, all of them side by side: a backward
step extends a match to the left by one word; when `length` words are matched, the interval gives
the number of occurrences, and the match is cut to its first length - 1 words by the boundaries of
equal prefixes. These matching statistics, capped at `length`, are the intervals to report.

Identical texts are one text with a count: with two or more copies, all of its windows repeat. A task enters
each text once, and of passages that it has met twice only two; the others are known to repeat. An anchor
that very many texts share is divided: its windows go one by one to shards by their own content.
Words and anchors are compared by 64 bits of their hashes.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, schema, small, text_of
from .textcore import U64, batches, flat, grams, mix, trim, word_hashes, words

ANCHOR = np.dtype([("h", "<u8"), ("a", "<u8"), ("b", "<u8"), ("p", "<i4"), ("known", "u1")])
SEGMENT = np.dtype([("h", "<u8"), ("a", "<u8"), ("b", "<u8"), ("p", "<i4"), ("s", "<i4"), ("w", "<i4")])  # p: anchor, s: first window, w: windows
#: Anchors, and words of segments, that one task holds at a time on average; words of one index.
ANCHORS, SHARD, INDEX = 500_000, 1_000_000, 300_000
#: Texts with candidates, or with something to remove, beyond this number are joined by a shuffle.
BROADCAST_TEXTS = 250_000
#: The same for the bytes of their places.
BROADCAST_BYTES = 32 << 20
#: An anchor is hot from so many occurrences on; at most so many hot anchors are broadcast (the most frequent).
HOT, MOST_HOT = 10_000, 300_000
ZSTD = pa.Codec("zstd", compression_level=1)


# the index


class Wavelet:
    """A sequence of small integers as a wavelet matrix: one packed bit vector for each bit of the symbols."""

    def __init__(self, seq: np.ndarray, symbols: int):
        self.levels = []
        n = len(seq)
        names = np.arange(symbols)
        start = np.zeros(symbols, np.int64)
        for level in range(max(1, int(symbols - 1).bit_length()) - 1, -1, -1):
            bit = (seq >> level & 1).astype(bool)
            packed = np.zeros((n // 64 + 1) * 8, np.uint8)
            raw = np.packbits(bit, bitorder="little")
            packed[: len(raw)] = raw
            packed = packed.view(U64)
            before = np.concatenate([[0], np.cumsum(np.bitwise_count(packed), dtype=np.uint32)[:-1]]).astype(np.uint32)
            zeros = int(n - bit.sum())
            self.levels.append((level, packed, before, zeros))
            start = np.where(names >> level & 1, zeros + self._ones(packed, before, start), start - self._ones(packed, before, start))
            seq = np.concatenate([seq[~bit], seq[bit]])
        self.start = start

    @staticmethod
    def _ones(packed, before, at):
        word = at >> 6
        mask = (U64(1) << (at & 63).astype(U64)) - U64(1)
        return before[word] + np.bitwise_count(packed[word] & mask)

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each place."""
        i = at
        for level, packed, before, zeros in self.levels:
            ones = self._ones(packed, before, i)
            i = np.where(symbol >> level & 1, zeros + ones, i - ones)
        return i - self.start[symbol]


class FMIndex:
    """Segments of words (each followed by symbol 0), with suffixes in order of at least `length` words."""

    def __init__(self, text: np.ndarray, symbols: int, weight: np.ndarray, length: int):
        n = len(text)
        rank, width, at_depth = text.astype(np.int64), 1, {1: text.astype(np.int64)}
        while True:
            key = rank * np.int64(n + 1)
            key[: n - width] += rank[width:] + 1
            order = np.argsort(key, kind="stable")
            new = np.concatenate([[0], np.cumsum(np.diff(key[order]) != 0)])
            rank = np.empty(n, np.int64)
            rank[order] = new
            width *= 2
            at_depth[width] = rank
            if width >= length or new[-1] == n - 1:
                break
        self.length, self.n = length, n
        self.bwt = Wavelet(text[order - 1], symbols)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=symbols))])
        self.upto = np.concatenate([[0], np.cumsum(weight[order])])
        new = np.zeros(n, bool)  # where the first length - 1 words differ from the row above
        depth, rest = 0, length - 1
        for w in sorted((w for w in at_depth if w <= rest), reverse=True):
            while rest >= w:
                moved = np.zeros(n, np.int64) - 1
                moved[: n - depth] = at_depth[w][depth:]
                moved = moved[order]
                new[1:] |= moved[1:] != moved[:-1]
                depth, rest = depth + w, rest - w
        new[0] = True
        self.block = np.cumsum(new) - 1
        self.edge = np.append(np.flatnonzero(new), n)

    def extend(self, lo: np.ndarray, hi: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One backward step: the rows of each match with its symbol in front."""
        r = self.bwt.rank(np.concatenate([symbol, symbol]), np.concatenate([lo, hi]))
        k = len(lo)
        return self.first[symbol] + r[:k], self.first[symbol] + r[k:]

    def shorten(self, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows that share the first length - 1 words of each match."""
        b = self.block[lo]
        return self.edge[b], self.edge[b + 1]

    def occurrences(self, flat_words: np.ndarray, first: np.ndarray) -> np.ndarray:
        """For each word of each segment: the weight of all occurrences of the window that starts there (0: none)."""
        size = np.diff(first)
        by = np.argsort(-size, kind="stable")
        end, size = first[1:][by], size[by]
        lo, hi = np.zeros(len(by), np.int64), np.full(len(by), self.n, np.int64)
        out = np.zeros(len(flat_words), np.int64)
        for t in range(int(size[0]) if len(size) else 0):
            k = int(np.searchsorted(-size, -t, "left"))
            at = end[:k] - 1 - t
            if t >= self.length:
                lo[:k], hi[:k] = self.shorten(lo[:k])
            lo[:k], hi[:k] = self.extend(lo[:k], hi[:k], flat_words[at])
            if t >= self.length - 1:
                out[at] = np.where(hi[:k] > lo[:k], self.upto[hi[:k]] - self.upto[lo[:k]], 0)
        return out


def repeated_windows(codes: np.ndarray, first: np.ndarray, count: np.ndarray, length: int) -> np.ndarray:
    """For each word of distinct segments (which occur count times): whether the window that starts there occurs twice."""
    names, dense = np.unique(codes, return_inverse=True)
    size = np.diff(first)
    text = np.zeros(len(codes) + len(size), np.int64)
    place = np.arange(len(codes)) + np.repeat(np.arange(len(size)), size)
    text[place] = dense + 1
    weight = np.zeros(len(text), np.int64)
    weight[place] = np.repeat(count, size)
    index = FMIndex(text, len(names) + 1, weight, length)
    return index.occurrences(dense + 1, first) >= 2


# anchors and segments


def _anchors(h: np.ndarray, first: np.ndarray, length: int, k: int):
    """Per anchor: its word, its hash, its first window and number of windows (positions in the batch), and its text."""
    g = grams(h, k)
    span = length - k + 1
    n = np.maximum(np.diff(first) - length + 1, 0)
    starts = np.repeat(first[:-1], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    text = np.repeat(np.arange(len(n)), n)
    pick = np.empty(len(starts), np.int64)
    view = np.lib.stride_tricks.sliding_window_view(g, span) if len(g) >= span else None
    for i in range(0, len(starts), 1 << 15):
        s = starts[i : i + (1 << 15)]
        lo = s[0]
        pick[i : i + (1 << 15)] = s + view[lo : s[-1] + 1].argmin(1)[s - lo]
    edge = np.flatnonzero(np.concatenate([[True], (pick[1:] != pick[:-1]) | (text[1:] != text[:-1])])) if len(pick) else np.zeros(0, np.int64)
    return pick[edge], g[pick[edge]], starts[edge], np.diff(np.append(edge, len(pick))), text[edge]


def _packed(key: np.ndarray, e: np.ndarray, tail=None):
    """Record batch of (bucket, data): entries by bucket, compressed; tail(indices) gives further bytes for entries."""
    order = np.argsort(key, kind="stable")
    key = key[order]
    edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    data, more = [], []
    for i, j in zip(edge, [*edge[1:], len(key)], strict=True):
        part = order[i:j]
        data.append(e[part].tobytes())
        if tail:
            raw = tail(part).tobytes()
            more.append(np.int64(len(raw)).tobytes() + ZSTD.compress(raw, asbytes=True))
    columns = [pa.array(key[edge]), pa.array(data, pa.binary())] + ([pa.array(more, pa.binary())] if tail else [])
    return pa.RecordBatch.from_arrays(columns, names=["bucket", "data", "words"][: len(columns)])


def _keys(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    return b.column("h1").to_numpy().view(U64), b.column("h2").to_numpy().view(U64)


def _keyed(docs: DataFrame, text_col: str) -> DataFrame:
    text = text_of(F.col(f"`{text_col}`"))
    return docs.withColumns({"h1": F.xxhash64(text), "h2": F.xxhash64(F.lit(1), text), "_text": text})


def _each_bucket(it):
    """Lists of a bucket's rows, one list for each bucket, of rows sorted by bucket."""
    bucket, held = None, []
    for b in it:
        for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if row[0] != bucket and held:
                yield held
                held = []
            bucket = row[0]
            held.append(row[1:])
    if held:
        yield held
    trim()


def _distinct(e: np.ndarray) -> np.ndarray:
    """Entries by hash, text and place, each once."""
    e = e[np.lexsort((e["p"], e["b"], e["a"], e["h"]))]
    return e[_new(e["h"], e["a"], e["b"], e["p"])]


def _new(*columns: np.ndarray) -> np.ndarray:
    """Where sorted rows differ from the one before."""
    new = np.ones(len(columns[0]), bool)
    if len(new):
        new[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
    return new


def _fresh(b: pa.RecordBatch, seen: set) -> pa.RecordBatch:
    """The rows whose texts this task has not seen before."""
    new = []
    for key in zip(b.column("h1").to_pylist(), b.column("h2").to_pylist(), strict=True):
        new.append(key not in seen)
        seen.add(key)
    return b if all(new) else b.filter(pa.array(new, pa.bool_()))


def _candidates(read: DataFrame, buckets: int, length: int, k: int) -> DataFrame:
    """Rows (h1, h2, places) with places of a text's anchors (packed) that occur at another place too, and rows (hot, n) of anchors
    that occur HOT times or more.

    Of an anchor that a task has several times, two places go to the anchor's bucket, for others to meet; the rest
    are known to repeat and go by text, and their number to the bucket. So the anchor of a passage in very many texts fills no bucket.
    """

    def scan(it):
        seen, done = set(), np.zeros(0, U64)
        for b in batches(it):
            b = _fresh(b, seen)
            buf, rows = flat(b.column("_text"))
            start, end, first = words(buf, rows)
            p, h, _, _, text = _anchors(word_hashes(buf, start, end), first, length, k)
            if not len(p):
                continue
            h1, h2 = _keys(b)
            e = np.empty(len(p), ANCHOR)
            e["h"], e["a"], e["b"], e["p"], e["known"] = h, h1[text], h2[text], p - first[text], 0
            e = _distinct(e)
            edge = np.flatnonzero(_new(e["h"]))
            size = np.diff(np.append(edge, len(e)))
            met = np.isin(e["h"][edge], done)
            e["known"] = (np.arange(len(e)) - np.repeat(edge, size) >= 2) | np.repeat(met, size)
            counted = (size > 2) | met
            done = np.union1d(done, e["h"][edge[size > 1]])
            number = e[edge[counted]]
            number["p"], number["known"] = size[counted], 2
            place = np.concatenate([np.where(e["known"], e["a"], e["h"]), number["h"]])
            yield _packed((mix(place + U64(5)) % U64(buckets)).astype(np.int64), np.concatenate([e, number]))

    out = schema(h1="long", h2="long", places="binary", hot="long", n="long")

    def repeated(it):
        for rows in _each_bucket(it):
            e = np.concatenate([np.frombuffer(r[0], ANCHOR) for r in rows])
            known, number, e = e[e["known"] == 1], e[e["known"] == 2], _distinct(e[e["known"] == 0])  # copies of a text count once
            anchors, at = np.unique(np.concatenate([e["h"], number["h"]]), return_inverse=True)
            n = np.bincount(at, np.concatenate([np.ones(len(e)), number["p"]])).astype(np.int64) if len(at) else np.zeros(0, np.int64)
            hot = n >= HOT
            if hot.any():
                none = pa.nulls(int(hot.sum()), pa.int64())
                yield pa.RecordBatch.from_arrays([none, none, pa.nulls(len(none), pa.binary()), pa.array(anchors[hot].view(np.int64)), pa.array(n[hot])], names=out.names)
            same = e["h"][1:] == e["h"][:-1]
            e = np.concatenate([known, e[np.concatenate([[False], same]) | np.concatenate([same, [False]])]]) if len(e) else known
            if not len(e):
                continue
            e = e[np.lexsort((e["p"], e["b"], e["a"]))]
            e = e[_new(e["a"], e["b"], e["p"])]
            edge = np.flatnonzero(_new(e["a"], e["b"]))
            p = np.ascontiguousarray(e["p"])
            data = [p[i:j].tobytes() for i, j in zip(edge, [*edge[1:], len(e)], strict=True)]
            for s in range(0, len(edge), 50_000):
                at = edge[s : s + 50_000]
                none = pa.nulls(len(at), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(e["a"][at].view(np.int64)), pa.array(e["b"][at].view(np.int64)), pa.array(data[s : s + 50_000], pa.binary()), none, none], names=out.names)

    packed = read.select("h1", "h2", "_text").mapInArrow(scan, schema(bucket="long", data="binary"))
    return packed.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(repeated, out)


def _blocks(e: np.ndarray, data: np.ndarray, at: np.ndarray, length: int):
    """Segments of one shard cut into sets for one index each: whole anchors, or for anchors that are too
    large windows by their hash. Yields (entry numbers, window of the segment or None for all)."""
    size = e["w"] + length - 1
    order = np.argsort(e["h"], kind="stable")
    edge = np.flatnonzero(np.concatenate([[True], e["h"][order][1:] != e["h"][order][:-1]]))
    held, total = [], 0
    for i, j in zip(edge, [*edge[1:], len(e)], strict=True):
        part = order[i:j]
        n = int(size[part].sum())
        if n > 4 * INDEX:
            for w in range(int(e["p"][part].max() - e["s"][part].min()) + 1):  # windows at one distance from the anchor
                own = e["p"][part] - w
                inside = part[(own >= e["s"][part]) & (own < e["s"][part] + e["w"][part])]
                if not len(inside):
                    continue
                offset = e["p"][inside] - w - e["s"][inside]
                h = np.zeros(len(inside), U64)
                for q in range(length):
                    h = mix(h * U64(31) + data[at[inside] + offset + q] + U64(1))
                parts = int(len(inside) * length // INDEX) + 1
                group = h % U64(parts)
                for q in range(parts):
                    pick = group == q
                    if pick.any():
                        yield inside[pick], offset[pick]
            continue
        if held and total + n > INDEX:
            yield np.concatenate(held), None
            held, total = [], 0
        held.append(part)
        total += n
    if held:
        yield np.concatenate(held), None


def _shard_intervals(rows: list, length: int):
    """h1, h2 and packed word intervals (start, end) of each text of a shard that have repeated windows.

    Rows without words hold segments that are known to repeat as a whole. Of hot anchors, a segment is a single window.
    """
    none = np.zeros(0, SEGMENT)
    known = np.concatenate([none, *(np.frombuffer(r[0], SEGMENT) for r in rows if not r[1])])
    rows = [r for r in rows if r[1]]
    e = np.concatenate([none, *(np.frombuffer(r[0], SEGMENT) for r in rows)])
    data = np.concatenate([np.zeros(0, U64)] + [np.frombuffer(ZSTD.decompress(r[1][8:], int(np.frombuffer(r[1][:8], np.int64)[0]), asbytes=True), U64) for r in rows])
    at = np.concatenate([[0], np.cumsum(e["w"] + length - 1)])[:-1]
    once = np.lexsort((e["s"], e["p"], e["b"], e["a"], e["h"]))
    once = once[_new(*(e[c][once] for c in ("h", "a", "b", "p", "s")))]  # copies of a text bring their segments again
    e, at = e[once], at[once]
    texts, begin, stop = [], [], []
    for pick, offset in _blocks(e, data, at, length) if len(e) else ():
        size = e["w"][pick] + length - 1 if offset is None else np.full(len(pick), length)
        source = at[pick] + (0 if offset is None else offset)
        first = np.concatenate([[0], np.cumsum(size)])
        codes = data[np.repeat(source - first[:-1], size) + np.arange(first[-1])]
        # equal segments are one, with a count
        h = mix(mix(codes + U64(7)) + (np.arange(len(codes)) - np.repeat(first[:-1], size)).astype(U64))
        sums = np.add.reduceat(h, first[:-1])
        other = np.add.reduceat(mix(h + U64(11)), first[:-1])
        ident = np.stack([sums, other, size.astype(U64)], 1)
        _, lead, back, count = np.unique(ident, axis=0, return_index=True, return_inverse=True, return_counts=True)
        back = back.ravel()
        u_size = size[lead]
        u_first = np.concatenate([[0], np.cumsum(u_size)])
        u_codes = codes[np.repeat(first[:-1][lead] - u_first[:-1], u_size) + np.arange(u_first[-1])]
        again = repeated_windows(u_codes, u_first, count, length)
        # runs of repeated windows of each distinct segment, then for every place where it occurs
        hit = np.flatnonzero(again)
        seg = np.searchsorted(u_first, hit, "right") - 1
        run = np.flatnonzero(np.concatenate([[True], (np.diff(hit) != 1) | (np.diff(seg) != 0)])) if len(hit) else np.zeros(0, np.int64)
        r_seg, r_lo = seg[run], hit[run] - u_first[seg[run]]
        r_hi = hit[np.append(run[1:], len(hit)) - 1] - u_first[r_seg] + length if len(run) else r_lo
        per = np.bincount(r_seg, minlength=len(lead))
        r_first = np.concatenate([[0], np.cumsum(per)])
        many = per[back]
        own = np.repeat(np.arange(len(pick)), many)
        which = np.repeat(r_first[back] - np.cumsum(many) + many, many) + np.arange(many.sum())
        base = e["s"][pick] + (0 if offset is None else offset)
        texts.append(pick[own])
        begin.append(base[own] + r_lo[which])
        stop.append(base[own] + r_hi[which])
    texts, begin, stop = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (texts, begin, stop))
    a, b = np.concatenate([e["a"][texts], known["a"]]), np.concatenate([e["b"][texts], known["b"]])
    begin, stop = np.concatenate([begin, known["s"]]), np.concatenate([stop, known["s"] + known["w"] + length - 1])
    order = np.lexsort((begin, b, a))
    a, b, pairs = a[order], b[order], np.stack([begin[order], stop[order]], 1).astype(np.int32)
    edge = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])) if len(a) else np.zeros(0, np.int64)
    for s in range(0, len(edge), 50_000):
        part = edge[s : s + 50_000]
        ends = [*edge[s + 1 : s + 50_001], *([len(a)] if s + 50_000 >= len(edge) else [])]
        yield pa.RecordBatch.from_arrays([pa.array(a[part].view(np.int64)), pa.array(b[part].view(np.int64)), pa.array([pairs[i:j].tobytes() for i, j in zip(part, ends, strict=True)], pa.binary())], names=["h1", "h2", "spans"])


def repeated_spans(docs: DataFrame, length: int = 35, k: int = 6, text_col: str = "text") -> DataFrame:
    """h1, h2 (stand for a text), whole (it has copies) and spans: packed int32 pairs of word intervals [start, end)
    covered by windows of `length` words that start anywhere else too. Texts without such windows have no row."""
    read = _keyed(docs, text_col)
    n = read.agg(F.sum(F.octet_length("_text"))).first()[0] or 0
    per = 6 * (length - k + 2) / 2  # bytes of text for an anchor, roughly
    candidates = cut(_candidates(read, int(n / per) // ANCHORS + 1, length, k))
    places = candidates.agg(F.sum(F.octet_length("places"))).first()[0] or 0
    hot = np.sort(candidates.where("hot is not null").orderBy(F.desc("n"), "hot").limit(MOST_HOT).select("hot").toArrow()["hot"].to_numpy().astype(np.int64).view(U64))
    found = candidates.where("hot is null").groupBy("h1", "h2").agg(F.collect_list("places").alias("places"))
    shards = max(int(places / 4 * (1.5 * length)) // SHARD + 1, int(read.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    texts = read.select("h1", "h2", "_text").join(small(found, BROADCAST_TEXTS) if places <= BROADCAST_BYTES else found, ["h1", "h2"])

    def by_shard(place, e, h, start, size):
        """Entries and their words for shards."""

        def tail(part):
            at = np.cumsum(size[part]) - size[part]
            return h[np.repeat(start[part] - at, size[part]) + np.arange(size[part].sum())]

        return _packed((mix(place + U64(5)) % U64(shards)).astype(np.int64), e, tail)

    def by_text(e):
        """Entries that are known to repeat."""
        b = _packed((mix(e["a"] + U64(5)) % U64(shards)).astype(np.int64), e)
        return pa.RecordBatch.from_arrays([*b.columns, pa.array([b""] * b.num_rows, pa.binary())], names=["bucket", "data", "words"])

    def segments(it):
        seen, met, met_windows = set(), np.zeros(0, U64), np.zeros(0, U64)
        for b in batches(it):
            b = _fresh(b, seen)
            buf, rows = flat(b.column("_text"))
            start, end, first = words(buf, rows)
            h = word_hashes(buf, start, end)
            p, anchor, s, w, text = _anchors(h, first, length, k)
            if not len(p):
                continue
            wanted = b.column("places").to_pylist()
            keep = np.zeros(len(p), bool)
            edge = np.searchsorted(text, np.arange(b.num_rows + 1))
            for r, parts in enumerate(wanted):
                i, j = edge[r], edge[r + 1]
                keep[i:j] = np.isin(p[i:j] - first[r], np.frombuffer(b"".join(parts), np.int32))
            p, anchor, s, w, text = p[keep], anchor[keep], s[keep], w[keep], text[keep]
            if not len(p):
                continue
            h1, h2 = _keys(b)
            e = np.empty(len(p), SEGMENT)
            e["h"], e["a"], e["b"], e["p"], e["s"], e["w"] = anchor, h1[text], h2[text], p - first[text], s - first[text], w
            # of segments with equal words two go to their shard; the others are known to repeat and go by text
            size = w + length - 1
            at = np.cumsum(size) - size
            mixed = mix(h[np.repeat(s - at, size) + np.arange(size.sum())] + (np.arange(size.sum()) - np.repeat(at, size)).astype(U64))
            word_sums = np.add.reduceat(mixed, at), np.add.reduceat(mix(mixed + U64(11)), at)
            columns = [e["p"], e["b"], e["a"], size, p - s, *word_sums, anchor]
            order = np.lexsort(columns)
            order = order[_new(*(c[order] for c in columns))]  # copies of a text count once
            start = np.flatnonzero(_new(*(c[order] for c in columns[3:])))
            count = np.diff(np.append(start, len(order)))
            ident = word_sums[0] ^ mix(anchor + U64(3))
            known = (np.arange(len(order)) - np.repeat(start, count) >= 2) | np.isin(ident[order], met)
            met = np.union1d(met, ident[order[start[count > 1]]])
            known, sent = order[known], order[~known]
            split = np.isin(anchor[sent], hot)
            if len(known):
                yield by_text(e[known])
            plain, sent = sent[~split], sent[split]
            if len(plain):
                yield by_shard(anchor[plain], e[plain], h, s[plain], size[plain])
            if len(sent):  # hot anchors, window by window
                begin = np.repeat(s[sent], w[sent]) + np.arange(w[sent].sum()) - np.repeat(np.cumsum(w[sent]) - w[sent], w[sent])
                e = np.repeat(e[sent], w[sent])
                e["s"], e["w"] = begin - np.repeat(first[text[sent]], w[sent]), 1
                g = grams(h, length)[begin]
                order = np.lexsort((e["s"], e["b"], e["a"], g))
                begin, e, g = begin[order], e[order], g[order]
                edge = np.flatnonzero(_new(g))
                count = np.diff(np.append(edge, len(g)))
                known = (np.arange(len(g)) - np.repeat(edge, count) >= 2) | np.isin(g, met_windows)
                met_windows = np.union1d(met_windows, g[edge[count > 1]])
                if known.any():
                    yield by_text(e[known])
                if not known.all():
                    yield by_shard(g[~known], e[~known], h, begin[~known], np.full(int((~known).sum()), length))

    def search(it):
        for rows in _each_bucket(it):
            yield from _shard_intervals(rows, length)

    dealt = texts.select("h1", "h2", "_text", "places").mapInArrow(segments, schema(bucket="long", data="binary", words="binary"))
    spans = dealt.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(search, schema(h1="long", h2="long", spans="binary"))
    copies = read.groupBy("h1", "h2").agg(F.count("*").alias("c")).where("c > 1").select("h1", "h2", F.lit(True).alias("whole"), F.lit(None).cast("binary").alias("spans"))
    both = copies.unionByName(spans.select("h1", "h2", F.lit(False).alias("whole"), "spans"))
    return both.groupBy("h1", "h2").agg(F.max("whole").alias("whole"), F.collect_list("spans").alias("spans"))


def remove_repeats(docs: DataFrame, length: int = 35, k: int = 6, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """Per row of docs: its id, n_words, n_removed, kept_sha256 (of the kept words joined by one space) and
    spans of removed words; with_text adds the kept words as kept.

    Removed is each word covered by a window of `length` words whose words also start anywhere else, the
    same text and equal rows included. Words are runs of bytes other than space and TAB to CR. Null texts have no words.
    """
    spans = cut(repeated_spans(docs, length, k, text_col))
    held = spans.agg(F.sum(F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + F.octet_length(x)))).first()[0] or 0
    spans = small(spans, BROADCAST_TEXTS) if held <= BROADCAST_BYTES else spans
    held = _keyed(docs, text_col).select(F.col(f"`{id_col}`").alias(id_col), "h1", "h2", "_text").join(spans, ["h1", "h2"], "left")
    out = T.StructType([docs.schema[id_col], *schema(n_words="long", n_removed="long", kept_sha256="string", spans="array<struct<start:int,end:int>>").fields, *([T.StructField("kept", T.StringType())] if with_text else [])])
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def run(it):
        for b in batches(it):
            n_words, n_removed, sha, gone, kept = [], [], [], [], []
            for text, whole, packed in zip(b.column("_text").cast(pa.binary()), b.column("whole").to_pylist(), b.column("spans").to_pylist(), strict=True):
                own = text.as_py().split()  # bytes split at the same separators
                merged = []
                if whole and len(own) >= length:
                    merged = [[0, len(own)]]
                elif packed:
                    pairs = np.frombuffer(b"".join(packed), np.int32).reshape(-1, 2)
                    for i, j in pairs[np.argsort(pairs[:, 0], kind="stable")].tolist():
                        if merged and i <= merged[-1][1]:
                            merged[-1][1] = max(merged[-1][1], j)
                        else:
                            merged.append([i, j])
                left = own
                if merged:
                    mask = np.ones(len(own), bool)
                    for i, j in merged:
                        mask[i:j] = False
                    left = list(compress(own, mask.tolist()))
                rest = b" ".join(left)
                n_words.append(len(own)), n_removed.append(len(own) - len(left)), sha.append(hashlib.sha256(rest).hexdigest())
                gone.append([{"start": i, "end": j} for i, j in merged])
                if with_text:
                    kept.append(rest.decode("utf-8", "replace"))
            columns = [b.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(sha, pa.string()), pa.array(gone, span), *([pa.array(kept, pa.string())] if with_text else [])]
            yield pa.RecordBatch.from_arrays(columns, names=out.names)

    return held.select(id_col, "_text", "whole", "spans").mapInArrow(run, out)
