"""Sharding by sampled splitters: range partitions of nearly equal bytes.

Every record gets a 64-bit order key: the high 40 bits hash its text and the low 24 bits
its id, so equal texts lie side by side and yet a group of any size can be divided. A
size-weighted sample of keys gives quantile boundaries for fine ranges, many to a shard.
Bytes and rows of each range are then counted exactly; ranges that turn out overfull are
sampled again and subdivided, until none is. Consecutive fine ranges fill the shards up to
equal bytes. Boundaries fall between groups of equal texts, except inside groups that fill whole ranges.

Rows that equal each other in id and text are one record with a count. Records that outweigh a
fine range, by size or by count, can number shards * fine at most; they are dealt out first,
largest first, in portions of a fine range (or one row), before the ranges fill what is left of each shard.

Only keys, sizes and ids move; texts stay where they are. Samples, range totals and the
large records that reach the driver are bounded by the parameters, whatever the input.
"""

from __future__ import annotations

import math
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, schema, text_of

LOW = 24
LOW_MASK = (1 << LOW) - 1


def keyed_column(docs: DataFrame, id_col: str, text_col: str):
    high = F.xxhash64(text_of(text_col)).bitwiseAND(~LOW_MASK)
    return high.bitwiseOR(F.xxhash64(F.lit(7), F.col(id_col)).bitwiseAND(LOW_MASK))


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size (UTF-8 bytes + 8; null text: 8), text_crc32 and the order key of each row."""
    text = text_of(text_col)
    raw = F.encode(text, "UTF-8")
    return docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(raw).alias("text_crc32"),
        keyed_column(docs, id_col, text_col).alias("key"),
    )


RECORD = ["key", "doc_id", "size", "text_crc32"]


def counted(rows: DataFrame) -> DataFrame:
    """Rows of keyed(), equal ones as one record with their number n. They are counted before they move."""
    return rows.groupBy(*RECORD).agg(F.count("*").alias("n"))


def _boundaries(sample: np.ndarray, parts: int) -> np.ndarray:
    """At most parts - 1 quantiles of the sampled keys, moved to the start of their text's group where that is no repeat."""
    if not len(sample):
        return sample
    sample = np.sort(sample)
    picks = np.unique(sample[(np.arange(1, parts) * len(sample)) // parts])
    start = picks & ~np.int64(LOW_MASK)
    fresh = np.concatenate([[True], start[1:] != start[:-1]])
    return np.unique(np.where(fresh, start, picks))


def _ranged(rows: DataFrame, bounds: np.ndarray) -> DataFrame:
    """rows and the number of the range that holds each key."""
    out = T.StructType([*rows.schema.fields, T.StructField("range", T.IntegerType())])

    def assign(batches):
        for b in batches:
            at = np.searchsorted(bounds, b.column("key").to_numpy(zero_copy_only=False), "right").astype(np.int32)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(at)], names=[*b.schema.names, "range"])

    return rows.mapInArrow(assign, out)


@dataclass(frozen=True)
class Plan:
    """Where every record goes: range boundaries, the shard and first slot of each range, and portions (shard, first slot, rows) of the large records."""

    bounds: np.ndarray
    shard_of: np.ndarray
    slot_of: np.ndarray
    dealt: dict[tuple, list[tuple[int, int, int]]]
    ideal: float


def plan_shards(records: DataFrame, shards: int = 24, fine: int = 128, oversample: int = 8) -> Plan | None:
    """The plan for records of counted(); None if there are none. records should be cut off, as it is read several times."""
    weight = F.col("size") * F.col("n")
    total = records.agg(F.sum(weight)).first()[0]
    if not total:
        return None
    ideal = total / (shards * fine)
    large = [tuple(r) for r in records.where(weight > ideal).select(*RECORD, "n").collect()]
    rest = records.where(weight <= ideal)

    def drawn(of: DataFrame, seed: int) -> np.ndarray:
        """Keys drawn with a probability in proportion to their weight, `oversample` for a fine range, by a hash: the same on every run."""
        dice = F.shiftrightunsigned(F.xxhash64(F.lit(seed), "key", "doc_id"), 11) / F.lit(float(1 << 53))
        return np.array([r[0] for r in of.where(dice < weight * F.lit(oversample / ideal)).select("key").collect()], np.int64)

    bounds, seed = _boundaries(drawn(rest, 0), shards * fine), 0
    while True:
        ranged = _ranged(rest, bounds)
        full = {r["range"]: r for r in ranged.groupBy("range").agg(F.sum("n").alias("n"), F.sum(weight).alias("size"), F.min("key").alias("lo"), F.max("key").alias("hi")).collect()}
        over = [k for k, r in full.items() if r["lo"] != r["hi"] and r["size"] > 2 * ideal]
        if not over:
            break
        seed += 1
        again, extra = drawn(ranged.where(F.col("range").isin(over)), seed), []
        where = np.searchsorted(bounds, again, "right")
        for k in over:
            lo, hi = full[k]["lo"], full[k]["hi"]
            own = _boundaries(again[where == k], math.ceil(full[k]["size"] / ideal))
            own = own[(own > lo) & (own <= hi)]
            extra.append(own if len(own) else np.array([lo + (hi - lo) // 2 + 1], np.int64))  # no splitter drawn: the middle divides it too
        bounds = np.unique(np.concatenate([bounds, *extra]))

    # large records: groups of equal texts together where that is small enough, largest first into the emptiest shard
    goal, load, count = total / shards, np.zeros(shards), np.zeros(shards, np.int64)
    groups: dict[int, list] = {}
    for x in sorted(large, key=lambda x: (x[0], x[1] is None, x[1] or 0, x[2])):
        groups.setdefault(x[0] >> LOW, []).append(x)
    units = []
    for g in groups.values():
        if sum(x[2] * x[4] for x in g) <= goal / 16:
            units.append(g)
            continue
        for x in g:
            most = max(1, int(ideal // x[2]))
            units += [[(*x[:4], min(most, x[4] - i))] for i in range(0, x[4], most)]
    dealt: dict[tuple, list[tuple[int, int, int]]] = {}
    for unit in sorted(units, key=lambda u: (-sum(x[2] * x[4] for x in u), u[0][0])):
        s = int(load.argmin())
        for x in unit:
            dealt.setdefault(x[:4], []).append((s, int(count[s]), x[4]))
            load[s] += x[2] * x[4]
            count[s] += x[4]

    shard_of, slot_of = np.zeros(len(bounds) + 1, np.int32), np.zeros(len(bounds) + 1, np.int64)
    room, s = np.maximum(goal - load, 0), 0
    room *= sum(r["size"] for r in full.values()) / max(room.sum(), 1)
    edge, filled = np.cumsum(room), 0.0
    for k in sorted(full):
        n, size = full[k]["n"], full[k]["size"]
        while s < shards - 1 and filled + size / 2 > edge[s]:
            s += 1
        shard_of[k], slot_of[k] = s, count[s]
        count[s] += n
        filled += size

    return Plan(bounds, shard_of, slot_of, dealt, ideal)


#: Rows that one row of a plan is unfolded to before it is dealt on.
UNFOLD = 100_000


def _unfolded(records: DataFrame) -> DataFrame:
    """A row for each of the n rows of a record, with slots from `slot` on."""
    each = records.withColumn("_i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    return each.withColumn("slot", F.col("slot") + F.col("_i")).drop("n", "_i")


def shard_table(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """doc_id, size, text_crc32, shard (0 to shards - 1) and slot (gapless from 0 in each shard).

    Sizes of shards are near equal: they differ by about a fine range, 1 / fine of a shard, unless
    single rows are larger. Equal rows get slots of their own, and however many there are, they are divided like
    others. Null ids and texts count as values (a null text has 8 bytes). An empty table gives an empty result.
    """
    records = cut(counted(keyed(docs, id_col, text_col)))
    plan = plan_shards(records, shards, **kw)
    if plan is None:
        return records.select("doc_id", "size", "text_crc32", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    bounds, shard_of, slot_of = plan.bounds, plan.shard_of, plan.slot_of
    rest = records.where(F.col("size") * F.col("n") <= plan.ideal)
    order = Window.partitionBy("range").orderBy(*RECORD).rowsBetween(Window.unboundedPreceding, -1)
    numbered = _ranged(rest, bounds).withColumn("slot", F.coalesce(F.sum("n").over(order), F.lit(0)))
    names = ["doc_id", "size", "text_crc32", "shard", "slot", "n"]

    def assign(batches):
        for b in batches:
            k = b.column("range").to_numpy()
            slot = b.column("slot").to_numpy() + slot_of[k]
            yield pa.RecordBatch.from_arrays([*b.select(names[:3]).columns, pa.array(shard_of[k]), pa.array(slot), b.column("n")], names=names)

    kind = rest.schema["doc_id"].dataType
    out = schema(doc_id=kind.simpleString(), size="long", text_crc32="long", shard="int", slot="long", n="long")
    ranged = _unfolded(numbered.mapInArrow(assign, out))
    portions = [(d, size, crc, s, slot, n) for (_, d, size, crc), at in plan.dealt.items() for s, slot, n in at]
    if not portions:
        return ranged
    first = docs.sparkSession.createDataFrame(portions, out).withColumn("_at", F.explode(F.expr(f"sequence(0L, n - 1, {UNFOLD}L)")))
    first = first.withColumns({"slot": F.col("slot") + F.col("_at"), "n": F.least(F.col("n") - F.col("_at"), F.lit(UNFOLD))}).drop("_at")
    return ranged.unionByName(_unfolded(first.repartition("shard", "slot")))


def _turns(portions: list[tuple[int, int, int]], record: tuple):
    """The shards of a record's rows in turn: each row of all once, beginning somewhere else in each task."""
    upto = np.cumsum([n for _, _, n in portions])
    total = int(upto[-1])
    step = max(1, round(total * 0.6180339887))
    while math.gcd(step, total) > 1:
        step += 1
    context = TaskContext.get()
    at = zlib.crc32(repr((context.partitionId() if context else 0, record)).encode()) % total
    while True:
        yield portions[int(np.searchsorted(upto, at, "right"))][0]
        at = (at + step) % total


def shard(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """docs with their own columns and an int column shard. Texts are not moved: each row looks its range up.

    Equal rows that outweigh a fine range together take the portions dealt to them in turn; that is exact where they
    lie in one task, as repetitions from a mix do, and near it elsewhere. Null ids and texts count as values, an empty
    table gives an empty result, and a column of docs named shard is replaced.
    """
    docs = docs.drop("shard")
    plan = plan_shards(cut(counted(keyed(docs, id_col, text_col))), shards, **kw)
    if plan is None:
        return docs.withColumn("shard", F.lit(0))
    large = {k[:3]: at for k, at in plan.dealt.items()}
    keys = np.unique(np.array([k[0] for k in large], np.int64))
    names, bounds, shard_of = docs.columns, plan.bounds, plan.shard_of
    held = docs.withColumns({"__leakloom_key": keyed_column(docs, id_col, text_col), "__leakloom_size": F.octet_length(text_of(text_col)) + 8})

    def assign(batches):
        turns: dict[tuple, object] = {}
        for b in batches:
            key, size = b.column("__leakloom_key").to_numpy(), b.column("__leakloom_size").to_numpy()
            out = shard_of[np.searchsorted(bounds, key, "right")]
            ids = b.column(id_col)
            for i in np.flatnonzero(np.isin(key, keys)):
                record = int(key[i]), ids[int(i)].as_py(), int(size[i])
                if record in large:
                    if record not in turns:
                        turns[record] = _turns(large[record], record)
                    out[i] = next(turns[record])
            kept = b.select(names)
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(out)], names=[*names, "shard"])

    return held.mapInArrow(assign, T.StructType([*docs.schema.fields, T.StructField("shard", T.IntegerType())]))
