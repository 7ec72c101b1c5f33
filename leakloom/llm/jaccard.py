"""N-gram Jaccard join: documents whose shingle sets overlap by 80 % or more, and their components.

Sets are hashed five-word shingles. Equal sets are one class from the start. Candidates come from
an inverted index over prefixes: with tokens in one global order, two sets that reach the
threshold share a token among their first n - ceil(0.8 n) + 1. The order is by hash, except that
frequent tokens (found by counting in every partition) come last, rarest first, so that a line or
passage that many documents share does not fill lists. Only lists, never sets, cross the network.

Set relations skip work in both parts of the join:

* Lists: a list is divided into blocks by the token's position in the sets, each in order of set sizes.
  Position and size bound the overlap that is still possible, so of each block a set's partners are one
  stretch, found by search; blocks behind the last possible position are never visited, and pairs outside
  a stretch are never made. Parity bitmaps then bound
  the symmetric difference exactly from below, before any set is read.
* Answers: lists with MANY partners a set come from groups of highly similar sets. There, sets are first compared with
  a few leaders; a set that links to a leader has the leader's answers, and components don't need the
  pairs inside one. What is left between components is compared closest pairs first, then
  more, then all, joining components by the new links in between, until no pair is left unseen.
* Differences: the links table has the pairs inside components too. There, each set is its difference
  to one set of the component, and the differences of two sets tell exactly how far they are apart.

Survivors are verified on the whole sets. Components are found by star contraction on the
cluster, each task first contracting its own links; neither links nor components come to the driver.
Copies of a text go into the index once for each task that reads them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import compact, cut, schema, small
from .textcore import LOWER, U64, batches, flat, grams, mix, trim, word_hashes, words

ENTRY = np.dtype([("t", "<u8"), ("a", "<u8"), ("b", "<u8"), ("n", "<i4"), ("i", "<i4"), ("part", "u1")])
#: Lists with more possible pairs than this for each entry are not joined pair by pair.
MANY = 32
#: Block stretches and pairs that are looked up at a time.
STEP = 1_000_000
#: Links that one task contracts.
EDGES = 250_000
#: A token is frequent from so many sets on; at most so many frequent tokens are broadcast (the most frequent).
FREQUENT, MOST_FREQUENT = 32, 500_000
#: Index entries that one task holds at a time, on average.
BUCKET = 200_000
LEADERS = 3
#: A list expected to be longer than this is dealt over several buckets; comparisons in lists with many pairs go by blocks of this size.
SPLIT, BLOCKED = 50_000, 4_000
#: Sets of a component are compared by blocks of so many shingles, or BLOCKED sets.
BLOCKED_SHINGLES = 1_000_000
BROADCAST_ROWS = 300_000
#: A class is heavy with more copies than HEAVY and than one in MOST_HEAVY of all rows, so that there are no more heavy ones.
HEAVY, MOST_HEAVY = 500, 100_000


def _sets(batch: pa.RecordBatch, column: int, k: int):
    """The sorted distinct shingle hashes of each text."""
    buf, rows = flat(batch.column(column))
    start, end, first = words(buf, rows)
    h = word_hashes(buf, start, end, LOWER)
    g = grams(h, k)
    for a, z in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        yield np.unique(g[a : z - k + 1]) if z - a >= k else grams(h[a:z], z - a) if z > a else g[:0]


def _prefix(n: int, percent: int) -> int:
    return n + (-n * percent) // 100 + 1 if n else 0


def _fingerprint(x: np.ndarray) -> tuple[int, int]:
    return int(mix(x + U64(1)).sum()), int(mix(x ^ U64(0x5BF03635)).sum())


def _bitmap(x: np.ndarray) -> bytes:
    """Parity of the tokens by their low bits, about as many bits as tokens."""
    bits = max(256, 1 << max(0, len(x) - 1).bit_length())
    return np.packbits((np.bincount((x & U64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8), bitorder="little").tobytes()


def _apart(a: bytes, b: bytes) -> int:
    """At most the symmetric difference of two sets, from their bitmaps."""
    x, y = int.from_bytes(a, "little"), int.from_bytes(b, "little")
    n, m = len(a), len(b)
    while n > m:
        n //= 2
        x = x >> 8 * n ^ x & (1 << 8 * n) - 1
    while m > n:
        m //= 2
        y = y >> 8 * m ^ y & (1 << 8 * m) - 1
    return (x ^ y).bit_count()


def _near(apart, n, m, percent: int):
    """Whether a symmetric difference can belong to sets of these sizes that link."""
    return apart * (100 + percent) <= (100 - percent) * (n + m)


def set_table(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Per row: doc_id, n, fp (16 bytes that stand for the set), bitmap and text_hash; and the frequent prefix tokens with their counts."""
    kind = docs.schema[id_col]
    out = T.StructType([T.StructField("doc_id", kind.dataType), T.StructField("n", T.IntegerType()), T.StructField("fp", T.BinaryType()), T.StructField("bitmap", T.BinaryType()), T.StructField("text_hash", T.LongType()), T.StructField("token", T.LongType())])

    def run(it):
        seen, held, texts = [], 0, set()

        def frequent(ids):
            """Tokens that this partition has seen more than once."""
            t, c = np.unique(np.concatenate(seen), return_counts=True)
            t, c = t[c > 2], c[c > 2]
            return pa.RecordBatch.from_arrays([pa.nulls(len(t), ids), pa.array(c.astype(np.int32)), pa.nulls(len(t), pa.binary()), pa.nulls(len(t), pa.binary()), pa.nulls(len(t), pa.int64()), pa.array(t.view(np.int64))], names=out.names)

        ids = None
        for b in batches(it):
            ids = b.column(0).type
            n, fp, bitmap = [], [], []
            for x, text in zip(_sets(b, 1, k), b.column(2).to_pylist(), strict=True):
                n.append(len(x))
                fp.append(np.array(_fingerprint(x), U64).tobytes())
                bitmap.append(_bitmap(x))
                if text not in texts:
                    texts.add(text)
                    seen.append(x[: _prefix(len(x), percent)])
                    held += len(seen[-1])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int32()), pa.array(fp, pa.binary()), pa.array(bitmap, pa.binary()), b.column(2), pa.nulls(len(n), pa.int64())], names=out.names)
            if held > 4_000_000:
                yield frequent(ids)
                seen, held = [], 0
        if seen:
            yield frequent(ids)

    both = cut(docs.select(id_col, text_col, F.xxhash64(text_col).alias("text_hash")).mapInArrow(run, out))
    rows = both.where(F.col("token").isNull()).drop("token")
    common = both.where(F.col("token").isNotNull()).groupBy("token").agg(F.sum("n").alias("n")).where(F.col("n") >= FREQUENT)
    return rows, common


def _index(docs: DataFrame, common: tuple[np.ndarray, np.ndarray, np.ndarray], buckets: int, k: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """The prefix entries of every set, packed by bucket of their token. Entries of a very frequent token are dealt
    over buckets by their set and marked as part of a list. A task enters copies of a text once.

    common: the frequent tokens in order, their ranks by count, and in how many parts their lists come.
    """
    tokens, rank, parts_of = common

    split = len(tokens) and int(parts_of.max()) > 1

    def run(it):
        texts = set()
        for b in batches(it):
            new = []
            for text in b.column(2).to_pylist():
                new.append(text not in texts)
                texts.add(text)
            b = b.filter(pa.array(new, pa.bool_()))
            parts = []
            for x in _sets(b, 1, k):
                p = _prefix(len(x), percent)
                if not p:
                    continue
                fa, fb = _fingerprint(x)
                light = x
                if len(tokens):
                    at = np.minimum(np.searchsorted(tokens, x), len(tokens) - 1)
                    often = tokens[at] == x
                    light = x[~often]
                    if len(light) < p:
                        late = np.argsort(rank[at[often]])
                        light = np.concatenate([light, x[often][late]])
                e = np.empty(p, ENTRY)
                e["t"], e["a"], e["b"], e["n"], e["i"], e["part"] = light[:p], fa, fb, len(x), np.arange(p), 0
                if split:
                    at = np.minimum(np.searchsorted(tokens, e["t"]), len(tokens) - 1)
                    e["part"] = (tokens[at] == e["t"]) & (parts_of[at] > 1)
                parts.append(e)
            if not parts:
                continue
            e = np.concatenate(parts)
            place = e["t"] + U64(3)
            if split:
                at = np.flatnonzero(e["part"])
                of = parts_of[np.searchsorted(tokens, e["t"][at])].astype(U64)
                place[at] = mix(place[at]) + e["a"][at] % of
            key = (mix(place) % U64(buckets)).astype(np.int64)
            order = np.argsort(key, kind="stable")
            key, e = key[order], e[order]
            edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            data = [e[i:j].tobytes() for i, j in zip(edge, [*edge[1:], len(e)], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(key[edge]), pa.array(data, pa.binary())], names=["bucket", "entries"])

    packed = docs.select(id_col, text_col, F.xxhash64(text_col).alias("text_hash")).mapInArrow(run, schema(bucket="long", entries="binary"))
    return packed.repartition("bucket").sortWithinPartitions("bucket")


PAIR = {"fa": "binary", "fb": "binary"}


def _fp(a: np.ndarray, b: np.ndarray) -> pa.Array:
    raw = np.ascontiguousarray(np.stack([a, b], 1)).tobytes()
    return pa.Array.from_buffers(pa.binary(16), len(a), [None, pa.py_buffer(raw)]).cast(pa.binary())


def _possible(x, y, percent: int):
    """Length and position filters for entries of one token."""
    n, m = x["n"].astype(np.int64), y["n"].astype(np.int64)
    return (100 * np.minimum(n, m) >= percent * np.maximum(n, m)) & ((100 + percent) * np.minimum(n - x["i"], m - y["i"]) >= percent * (n + m))


def _stretches(e: np.ndarray, percent: int):
    """For entries in order of token, position and size: arrays x, lo, hi, where the partners of entry x that are not smaller
    are among entries lo to hi - 1, for each block that has any. Position and length filters hold for all of them."""
    n, i = e["n"].astype(np.int64), e["i"].astype(np.int64)
    fresh = np.concatenate([[True], e["t"][1:] != e["t"][:-1]])
    lists = np.cumsum(fresh) - 1
    edge = np.flatnonzero(fresh | np.concatenate([[True], i[1:] != i[:-1]]))  # blocks
    block = np.repeat(np.arange(len(edge)), np.diff(np.append(edge, len(e))))
    key = block << 32 | n
    places = lists[edge] << 32 | i[edge]
    # the largest partner that size and this entry's position allow, and the last position that a partner of any such size may have
    most = np.minimum(100 * n // percent, (100 + percent) * (n - i) // percent - n)
    last = (100 * most - percent * n) // (100 + percent)
    first = np.searchsorted(places, lists << 32)
    blocks = np.where((most >= n) & (last >= 0), np.searchsorted(places, lists << 32 | np.maximum(last, 0), "right") - first, 0)
    upto = np.concatenate([[0], np.cumsum(blocks)])
    s = 0
    while s < len(e):
        z = max(s + 1, int(np.searchsorted(upto, upto[s] + STEP, "right")) - 1)
        x = np.repeat(np.arange(s, z), blocks[s:z])
        b = first[x] + np.arange(len(x)) - (upto[x] - upto[s])
        least = np.maximum(n[x], -(-(percent * n[x] + (100 + percent) * i[edge[b]]) // 100))
        lo, hi = np.searchsorted(key, b << 32 | least), np.searchsorted(key, b << 32 | most[x], "right")
        some = lo < hi
        if some.any():
            yield x[some], lo[some], hi[some]
        s = z


def _bucket_pairs(e: np.ndarray, percent: int):
    """Yields candidate pairs of a bucket's lists, as two arrays of entries, and last the entries of lists with many pairs, with
    None. Of those, pairs with their leaders are candidates."""
    e = e[np.lexsort((e["b"], e["a"], e["t"]))]
    if len(e):  # copies once
        e = e[np.concatenate([[True], (e["t"][1:] != e["t"][:-1]) | (e["a"][1:] != e["a"][:-1]) | (e["b"][1:] != e["b"][:-1])])]
    e = e[np.lexsort((e["b"], e["a"], e["n"], e["i"], e["t"]))]
    edge = np.flatnonzero(np.concatenate([[True], e["t"][1:] != e["t"][:-1]])) if len(e) else np.zeros(0, np.int64)
    size = np.diff(np.append(edge, len(e)))
    whole = np.repeat((e["part"][edge] == 0) & (size > 1), size) if len(e) else np.zeros(0, bool)
    own = e[whole]
    found = np.zeros(len(own), np.int64)
    for x, lo, hi in _stretches(own, percent) if len(own) else ():
        np.add.at(found, x, hi - lo)
    lists = np.cumsum(np.concatenate([[True], own["t"][1:] != own["t"][:-1]])) - 1 if len(own) else np.zeros(0, np.int64)
    pairs = np.bincount(lists, found).astype(np.int64) if len(own) else lists
    many = (pairs > MANY * np.bincount(lists))[lists] if len(own) else np.zeros(0, bool)
    short = own[~many]
    for x, lo, hi in _stretches(short, percent) if len(short) else ():
        upto = np.concatenate([[0], np.cumsum(hi - lo)])
        s = 0
        while s < len(x):
            z = max(s + 1, int(np.searchsorted(upto, upto[s] + STEP, "right")) - 1)
            a = np.repeat(x[s:z], (hi - lo)[s:z])
            b = np.repeat(lo[s:z], (hi - lo)[s:z]) + np.arange(len(a)) - np.repeat(upto[s:z] - upto[s], (hi - lo)[s:z])
            once = (short["n"][b] > short["n"][a]) | (b > a)  # sets of one size meet twice
            yield short[a[once]], short[b[once]]
            s = z
    rest = np.ones(len(e), bool)
    rest[np.flatnonzero(whole)[~many]] = False
    alone = np.repeat((size == 1) & (e["part"][edge] == 0), size) if len(e) else rest
    long = e[rest & ~alone]
    edge = np.flatnonzero(np.concatenate([[True], long["t"][1:] != long["t"][:-1]])) if len(long) else np.zeros(0, np.int64)
    for at, z in zip(edge, np.append(edge[1:], len(long))[: len(edge)], strict=True):
        part = long[at:z]
        for lead in np.argsort(part["a"])[:LEADERS]:
            ok = _possible(part, np.broadcast_to(part[lead], len(part)), percent)
            ok[lead] = False
            yield np.broadcast_to(part[lead], int(ok.sum())), part[ok]
    yield long, None


def _pairs_of(index: DataFrame, percent: int) -> DataFrame:
    """Rows (fa, fb) of candidate pairs, once a bucket, and (fa, null, token, n, i) of long lists' entries."""
    out = schema(**PAIR, token="long", n="int", i="int")

    def run(it):
        bucket, held = None, []

        def distinct(parts):
            """Pairs as (fa, fb) with fa the smaller, each once."""
            xa, xb, ya, yb = (np.concatenate([p[side][c] for p in parts]) for side in (0, 1) for c in ("a", "b"))
            swap = (xa > ya) | ((xa == ya) & (xb > yb))
            xa, xb, ya, yb = np.where(swap, ya, xa), np.where(swap, yb, xb), np.where(swap, xa, ya), np.where(swap, xb, yb)
            order = np.lexsort((yb, ya, xb, xa))
            xa, xb, ya, yb = xa[order], xb[order], ya[order], yb[order]
            new = np.ones(len(xa), bool)
            new[1:] = (xa[1:] != xa[:-1]) | (xb[1:] != xb[:-1]) | (ya[1:] != ya[:-1]) | (yb[1:] != yb[:-1])
            xa, xb, ya, yb = xa[new], xb[new], ya[new], yb[new]
            for s in range(0, len(xa), 100_000):
                z = s + 100_000
                none = pa.nulls(len(xa[s:z]), pa.int32())
                yield pa.RecordBatch.from_arrays([_fp(xa[s:z], xb[s:z]), _fp(ya[s:z], yb[s:z]), pa.nulls(len(none), pa.int64()), none, none], names=out.names)

        def flush():
            parts, n = [], 0
            for x, y in _bucket_pairs(np.concatenate([np.frombuffer(d, ENTRY) for d in held]), percent):
                if y is None:
                    long = x
                    continue
                parts.append((x, y))
                n += len(x)
                if n > STEP:
                    yield from distinct(parts)
                    parts, n = [], 0
            if n:
                yield from distinct(parts)
            for s in range(0, len(long), 100_000):
                p = long[s : s + 100_000]
                yield pa.RecordBatch.from_arrays([_fp(p["a"], p["b"]), pa.nulls(len(p), pa.binary()), pa.array(np.ascontiguousarray(p["t"]).view(np.int64)), pa.array(np.ascontiguousarray(p["n"])), pa.array(np.ascontiguousarray(p["i"]))], names=out.names)

        for b in it:
            for key, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if key != bucket and held:
                    yield from flush()
                    held = []
                bucket = key
                held.append(data)
        if held:
            yield from flush()
        trim()

    return index.mapInArrow(run, out)


def _by_bitmap(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs that their bitmaps allow."""
    a = classes.select(F.col("fp").alias("fa"), F.col("n").alias("na"), F.col("bitmap").alias("ba"))
    b = classes.select(F.col("fp").alias("fb"), F.col("n").alias("nb"), F.col("bitmap").alias("bb"))

    def run(it):
        for r in it:
            n, m = r.column("na").to_numpy(), r.column("nb").to_numpy()
            d = np.array([_apart(x, y) for x, y in zip(r.column("ba").to_pylist(), r.column("bb").to_pylist(), strict=True)], np.int64)
            keep = pa.array(_near(d, n.astype(np.int64), m.astype(np.int64), percent)) if len(d) else pa.array([], pa.bool_())
            yield r.select(["fa", "fb"]).filter(keep)

    return pairs.join(a, "fa").join(b, "fb").select("fa", "fb", "na", "ba", "nb", "bb").mapInArrow(run, schema(**PAIR))


def _sets_of(needed: DataFrame, docs: DataFrame, k: int, id_col: str, text_col: str) -> DataFrame:
    """(fp, set) of the classes in needed (want, rep, text_hash). One text of each class is read again for its set."""
    same = F.col("_id").eqNullSafe(F.col("rep")) & (F.col("_hash") == F.col("text_hash"))
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.xxhash64(text_col).alias("_hash")).join(needed, same)

    def run(it):
        for b in batches(it):
            keys, data = [], []
            for want, x in zip(b.column(1).to_pylist(), _sets(b, 0, k), strict=True):
                if np.array(_fingerprint(x), U64).tobytes() == want:  # else another text with the same id
                    keys.append(want), data.append(x.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(data, pa.binary())], names=["fp", "set"])

    sets = texts.select("_text", "want").mapInArrow(run, schema(fp="binary", set="binary"))
    return sets.groupBy("fp").agg(F.first("set").alias("set"))


def _verified(pairs: DataFrame, docs: DataFrame, classes: DataFrame, k: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """The pairs that link, tested on the whole sets."""
    ends = pairs.select(F.col("fa").alias("fp")).union(pairs.select("fb")).distinct()
    needed = compact(ends.join(classes.select("fp", "rep", "text_hash"), "fp").withColumnRenamed("fp", "want"))
    sets = compact(_sets_of(small(needed, BROADCAST_ROWS), docs, k, id_col, text_col), 10_000)

    def test(it):
        last, x = None, None
        for b in it:
            keep = []
            for fa, p, q in zip(b.column("fa").to_pylist(), b.column("sa"), b.column("sb"), strict=True):
                if fa != last:
                    last, x = fa, np.frombuffer(p.as_buffer(), np.uint64)
                y = np.frombuffer(q.as_buffer(), np.uint64)
                at = np.minimum(np.searchsorted(x, y), len(x) - 1)
                common = int((x[at] == y).sum())
                keep.append(100 * common >= percent * (len(x) + len(y) - common))
            yield b.select(["fa", "fb"]).filter(pa.array(keep, pa.bool_()))
        trim()

    both = pairs.join(sets.withColumnRenamed("fp", "fb").withColumnRenamed("set", "sb"), "fb").join(sets.withColumnRenamed("fp", "fa").withColumnRenamed("set", "sa"), "fa")
    return both.select("fa", "fb", "sa", "sb").mapInArrow(test, schema(**PAIR))


def _forest(it):
    """Links (u, v) of a task as (node, smallest node that its links reach), without the smallest ones themselves."""
    up: dict = {}
    kind = None

    def root(x):
        while (y := up.setdefault(x, x)) != x:
            up[x] = up[y]
            x = y
        return x

    for b in it:
        kind = b.column(0).type
        for u, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            x, y = root(u), root(v)
            if x != y:
                up[max(x, y)] = min(x, y)
    nodes = [x for x in up if root(x) != x]
    for s in range(0, len(nodes), 100_000):
        part = nodes[s : s + 100_000]
        yield pa.RecordBatch.from_arrays([pa.array(part, kind), pa.array([root(x) for x in part], kind)], names=["u", "v"])


def star_components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) of all nodes in links (u, v): component is the smallest node reachable.

    Every task contracts the links it has. While these are more than EDGES, alternating large-star and small-star steps on
    the cluster go between, until nothing changes; an error if `rounds` are not enough.
    """
    edges = cut(links.where(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")))
    before = None
    for _ in range(rounds):
        n = edges.count()
        if n <= EDGES:
            edges = cut(edges.coalesce(1).mapInArrow(_forest, edges.schema))
            break
        parts = n // EDGES + 1
        edges = cut(edges.coalesce(parts).mapInArrow(_forest, edges.schema))
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = cut(large.where(F.col("u") != F.col("v")).distinct().coalesce(parts))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small_star = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        edges = cut(small_star.where(F.col("u") != F.col("v")).distinct().coalesce(parts))
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components are not final after {rounds} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("component"))).groupBy("node").agg(F.min("component").alias("component"))


def _joined(labels: DataFrame, links: DataFrame) -> DataFrame:
    """labels (node, component) after further links (fa, fb), of which only those between components are contracted."""
    a, b = (labels.select(F.col("node").alias(x), F.col("component").alias(c)) for x, c in (("fa", "ca"), ("fb", "cb")))
    ends = links.join(a, "fa", "left").join(b, "fb", "left").select(F.coalesce("ca", "fa").alias("u"), F.coalesce("cb", "fb").alias("v"))
    top = star_components(ends).select(F.col("node").alias("component"), F.col("component").alias("top"))
    fresh = links.select(F.col("fa").alias("node")).union(links.select("fb")).distinct().join(labels, "node", "left_anti").withColumn("component", F.col("node"))
    return labels.unionByName(fresh).join(small(top, BROADCAST_ROWS), "component", "left").select("node", F.coalesce("top", "component").alias("component"))


def _between(long: DataFrame, labels: DataFrame, classes: DataFrame, percent: int, most: int | None) -> DataFrame:
    """Pairs of long lists' entries in different components that all filters allow: for each set of the
    smaller component its `most` closest partners in a list (all, if None)."""
    named = long.join(classes.select(F.col("fp").alias("fa"), "bitmap"), "fa").join(labels.select(F.col("node").alias("fa"), "component"), "fa", "left").withColumn("component", F.coalesce("component", "fa"))
    # a list of many entries goes in blocks: one group for each pair of blocks
    blocks = long.groupBy("token").agg(F.ceil(F.count("*") / F.lit(BLOCKED)).cast("int").alias("blocks"))
    placed = named.join(blocks, "token").withColumn("block", F.pmod(F.xxhash64("fa"), F.col("blocks")).cast("int"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumns({"lo": F.least("block", "other"), "hi": F.greatest("block", "other")})
    dealt = placed.select("token", "lo", "hi", "fa", "n", "i", "component", "bitmap", "block").repartition("token", "lo", "hi").sortWithinPartitions("token", "lo", "hi", "n")

    def run(it):
        token, held = None, []

        def flush():
            comps = [r[6] for r in held]
            if len(set(comps)) < 2:
                return
            _, comp, counts = np.unique(np.array([c.hex() for c in comps]), return_inverse=True, return_counts=True)
            n, i, block = (np.array([r[c] for r in held], np.int64) for c in (4, 5, 8))
            across = held[0][1] != held[0][2]
            left, right = [], []
            maps: dict[int, np.ndarray] = {}
            for w in {len(r[7]) for r in held}:
                maps[w] = np.stack([np.frombuffer(_folded(r[7], w), np.uint64) if len(r[7]) >= w else np.zeros(w // 8, np.uint64) for r in held])
            by = np.argsort(n, kind="stable")
            ordered = n[by]
            rank = counts[comp] * np.int64(1 << 32) + comp
            for x in range(len(held)):
                lo, hi = np.searchsorted(ordered, [-(-n[x] * percent // 100), n[x] * 100 // percent + 1])
                y = by[lo:hi]
                y = y[(rank[y] > rank[x]) & ((block[y] != block[x]) if across else True)]
                y = y[(100 + percent) * np.minimum(n[x] - i[x], n[y] - i[y]) >= percent * (n[x] + n[y])]
                if not len(y):
                    continue
                d = np.empty(len(y), np.int64)
                mine = np.minimum(len(held[x][7]), np.array([len(held[j][7]) for j in y]))
                for w in np.unique(mine):
                    at = np.flatnonzero(mine == w)
                    for s in range(0, len(at), 4096):
                        d[at[s : s + 4096]] = np.bitwise_count(maps[w][y[at[s : s + 4096]]] ^ maps[w][x]).sum(1)
                ok = np.flatnonzero(_near(d, n[x], n[y], percent))
                if most is not None and len(ok) > most:
                    ok = ok[np.argpartition(d[ok], most)[:most]]
                left += [held[x][3]] * len(ok)
                right += [held[j][3] for j in y[ok]]
            if left:
                a = [min(p, q) for p, q in zip(left, right, strict=True)]
                b = [max(p, q) for p, q in zip(left, right, strict=True)]
                for s in range(0, len(a), 100_000):
                    yield pa.RecordBatch.from_arrays([pa.array(a[s : s + 100_000], pa.binary()), pa.array(b[s : s + 100_000], pa.binary())], names=["fa", "fb"])

        for b in it:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if row[:3] != token and held:
                    yield from flush()
                    held = []
                token = row[:3]
                held.append(row)
        if held:
            yield from flush()
        trim()

    return dealt.mapInArrow(run, schema(**PAIR)).distinct()


def _folded(bitmap: bytes, width: int) -> bytes:
    x = np.frombuffer(bitmap, np.uint64)
    while len(x) * 8 > width:
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return x.tobytes()


def _within(long: DataFrame, labels: DataFrame, classes: DataFrame, docs: DataFrame, k: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """All links between sets of one component that have entries in long lists. Nothing is computed until it is read.

    Each set is compared once with one set of its component, and from then on is its difference to that one: two sets
    are as far apart as their differences are. A component of many sets goes in blocks, one group for each pair of blocks.
    """
    members = long.select(F.col("fa").alias("fp")).distinct().join(labels.withColumnRenamed("node", "fp"), "fp").join(classes.select("fp", "n", "rep", "text_hash"), "fp")
    blocks = F.ceil(F.greatest(F.count("*") / F.lit(BLOCKED), F.sum("n") / F.lit(BLOCKED_SHINGLES))).cast("int")
    leaders = members.groupBy("component").agg(F.min("fp").alias("lead"), blocks.alias("blocks"), F.count("*").alias("c")).where("c > 1").drop("c")
    members = members.join(leaders, "component").withColumn("block", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    sets = _sets_of(members.select(F.col("fp").alias("want"), "rep", "text_hash"), docs, k, id_col, text_col)
    led = leaders.join(sets.select(F.col("fp").alias("lead"), F.col("set").alias("base")), "lead").select("component", "base", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    held = members.select("fp", "component", "blocks", "block").join(sets, "fp").join(led, ["component", "block"]).select("component", "blocks", "block", "fp", "set", "base")

    def differ(it):
        for b in it:
            n, diff = [], []
            for p, q in zip(b.column("set"), b.column("base"), strict=True):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (p, q))
                n.append(len(x))
                diff.append(np.setxor1d(x, y, assume_unique=True).tobytes())
            yield pa.RecordBatch.from_arrays([*b.select(["component", "blocks", "block", "fp"]).columns, pa.array(n, pa.int32()), pa.array(diff, pa.binary())], names=["component", "blocks", "block", "fp", "n", "diff"])
        trim()

    apart = held.mapInArrow(differ, schema(component="binary", blocks="int", block="int", fp="binary", n="int", diff="binary"))
    placed = apart.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumns({"lo": F.least("block", "other"), "hi": F.greatest("block", "other")})
    dealt = placed.select("component", "lo", "hi", "block", "fp", "n", "diff").repartition("component", "lo", "hi").sortWithinPartitions("component", "lo", "hi", "n")

    def run(it):
        group, rows = None, []

        def flush():
            fps = np.frombuffer(b"".join(r[4] for r in rows), "V16")
            block, n = (np.array([r[c] for r in rows], np.int64) for c in (3, 5))
            size = np.array([len(r[6]) // 8 for r in rows], np.int64)
            edge = np.concatenate([[0], np.cumsum(size)])
            _, ids = np.unique(np.frombuffer(b"".join(r[6] for r in rows), np.uint64), return_inverse=True)
            mine = np.zeros(len(ids) + 1, bool)
            across = rows[0][1] != rows[0][2]
            last = np.searchsorted(n, n * 100 // percent, "right")
            left, right, m = [], [], 0

            def pairs():
                a, b = (np.concatenate(x) for x in (left, right))
                parts = [pa.Array.from_buffers(pa.binary(16), len(x), [None, pa.py_buffer(fps[x].tobytes())]).cast(pa.binary()) for x in (a, b)]
                return pa.RecordBatch.from_arrays(parts, names=["fa", "fb"])

            for x in range(len(rows)):
                y = np.arange(x + 1, last[x])
                if not len(y):
                    continue
                own = ids[edge[x] : edge[x + 1]]
                mine[own] = True
                upto = np.concatenate([[0], np.cumsum(mine[ids[edge[x + 1] : edge[last[x]]]])])
                mine[own] = False
                at = edge[x + 1 : last[x] + 1] - edge[x + 1]
                d = size[x] + size[y] - 2 * (upto[at[1:]] - upto[at[:-1]])
                y = y[_near(d, n[x], n[y], percent) & ((block[y] != block[x]) if across else True)]
                left.append(np.full(len(y), x)), right.append(y)
                m += len(y)
                if m > 100_000:
                    yield pairs()
                    left, right, m = [], [], 0
            if m:
                yield pairs()

        for b in it:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if row[:3] != group and rows:
                    yield from flush()
                    rows = []
                group = row[:3]
                rows.append(row)
        if rows:
            yield from flush()
        trim()

    return dealt.mapInArrow(run, schema(**PAIR))


def _with_classes(rows: DataFrame, classed: DataFrame, classes: DataFrame) -> DataFrame:
    """rows and what classed has for their sets. Classes of very many copies, MOST_HEAVY at most, are sent to the rows, so that no task gets all copies of one."""
    total = classes.agg(F.sum("copies")).first()[0] or 0
    heavy = classes.where(F.col("copies") > max(HEAVY, total // MOST_HEAVY)).select("fp")
    if not heavy.take(1):
        return rows.join(classed, "fp", "left")
    sent = cut(classed.join(F.broadcast(heavy), "fp"))
    light = rows.join(F.broadcast(sent.select("fp")), "fp", "left_anti").join(classed, "fp", "left")
    return rows.join(F.broadcast(sent), "fp").unionByName(light)


def jaccard_join(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Join documents with 100 * |intersection| >= percent * |union| of their distinct k-word shingles.

    Words are runs of bytes other than space and TAB to CR, A-Z in lower case; a text with fewer than k
    words is one shingle, null, empty and blank texts have none and link with nothing.

    Returns (rows, links). rows: doc_id, n_shingles, fp (stands for the set), rep (smallest doc_id with the same set),
    component_id (smallest doc_id reachable by links), keeper (one row of each component; repeated rows all or none). links: fa and fb of all pairs of
    sets that link, each pair once; copies share an fp. Components do without the links inside components of long lists: these are computed when
    links is read, in time by the square of a component's sets. Rows with null ids take part, but name no component.
    """
    rows, common = set_table(docs, k, percent, id_col, text_col)
    classes = compact(rows.where("n > 0").groupBy("fp", "n").agg(F.min("doc_id").alias("rep"), F.coalesce(F.min_by("text_hash", "doc_id"), F.min("text_hash")).alias("text_hash"), F.first("bitmap").alias("bitmap"), F.count("*").alias("copies")))
    entries = classes.agg(F.sum(F.expr(f"n + floor(-n * {percent} / 100) + 1"))).first()[0] or 0
    often = common.orderBy(F.desc("n"), "token").limit(MOST_FREQUENT).toArrow()
    token, count = often["token"].to_numpy().astype(np.int64).view(np.uint64), often["n"].to_numpy()
    order = np.argsort(token)
    rank = np.empty(len(token), np.int64)
    rank[np.lexsort((token, count))] = np.arange(len(token))
    parts = np.minimum(count // SPLIT + 1, 1 << 30)
    index = _index(docs, (token[order], rank[order], parts[order]), max(1, int(entries) // BUCKET + 1), k, percent, id_col, text_col)
    found = cut(_pairs_of(index, percent))
    pairs = compact(_by_bitmap(found.where(F.col("fb").isNotNull()).select("fa", "fb").distinct(), classes, percent))
    links = compact(_verified(pairs, docs, classes, k, percent, id_col, text_col))
    long = found.where(F.col("fb").isNull()).select("fa", "token", "n", "i")
    labels = compact(star_components(links.select(F.col("fa").alias("u"), F.col("fb").alias("v"))))
    tested = pairs
    lists = bool(long.take(1))
    for most in (4, 64, None) if lists else ():
        more = compact(_between(long, labels, classes, percent, most).join(tested, ["fa", "fb"], "left_anti"))
        if not more.take(1):
            if most is None:
                break
            continue
        tested = tested.union(more)
        more = compact(_verified(more, docs, classes, k, percent, id_col, text_col))
        links = links.union(more)
        labels = compact(_joined(labels, more))
    if lists:
        every = links.union(_within(long, labels, classes, docs, k, percent, id_col, text_col))
        links = every.select(F.least("fa", "fb").alias("fa"), F.greatest("fa", "fb").alias("fb")).distinct()
    named = classes.select("fp", "rep").join(labels.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    least = cut(named.join(labels.select(F.col("node").alias("fp")), "fp", "left_semi").groupBy("component").agg(F.min("rep").alias("least"), F.min(F.struct(F.col("rep").isNull().alias("last"), "rep", "fp"))["fp"].alias("first")))
    classed = named.join(small(least, BROADCAST_ROWS), "component", "left").select("fp", "rep", F.when(F.col("first").isNull(), F.col("rep")).otherwise(F.col("least")).alias("component_id"), (F.col("fp") == F.coalesce("first", "fp")).alias("keeper"))
    out = _with_classes(rows.select("doc_id", F.col("n").cast("long").alias("n_shingles"), "fp"), classed, classes)
    alone = F.col("n_shingles") == 0
    rep, component = F.when(alone, F.col("doc_id")).otherwise(F.col("rep")), F.when(alone, F.col("doc_id")).otherwise(F.col("component_id"))
    keeper = alone | (F.col("keeper") & F.col("doc_id").eqNullSafe(F.col("rep")))
    return out.select("doc_id", "n_shingles", "fp", rep.alias("rep"), component.alias("component_id"), keeper.alias("keeper")), links


def keep_one(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """docs with one row of each component left, that of the smallest doc_id; rows without words all stay.

    Columns and rows that stay are as they were. Of rows that equal each other in id and set, one stays.
    """
    names = docs.columns
    rows, _ = jaccard_join(docs, k, percent)
    rows = cut(rows.where("n_shingles > 0"))
    gone = rows.where(~F.col("keeper")).select(F.col("doc_id").alias("__leakloom_id"), F.col("fp").alias("__leakloom_f"))
    repeated = rows.groupBy("doc_id").agg(F.count("*").alias("c")).where("c > 1").take(1)
    if not repeated:
        return docs.join(small(gone.drop("__leakloom_f"), BROADCAST_ROWS), F.col("doc_id").eqNullSafe(F.col("__leakloom_id")), "left_anti")
    # ids that repeat (null is one): decided by id and set
    at = names.index("text")

    def run(it):
        for b in batches(it):
            fp = [np.array(_fingerprint(x), U64).tobytes() if len(x) else None for x in _sets(b, at, k)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(fp, pa.binary())], names=[*names, "__leakloom_fp"])

    held = docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("__leakloom_fp", T.BinaryType())]))
    left = held.join(small(gone.distinct(), BROADCAST_ROWS), F.col("doc_id").eqNullSafe(F.col("__leakloom_id")) & (F.col("__leakloom_fp") == F.col("__leakloom_f")), "left_anti")
    none = left.where(F.col("__leakloom_fp").isNull())
    return left.where(F.col("__leakloom_fp").isNotNull()).dropDuplicates(["doc_id", "__leakloom_fp"]).unionByName(none).select(*names)
