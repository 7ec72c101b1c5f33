"""Mixing sources to target weights by hash-threshold histograms.

Each source gets a token budget. Every document has a uniform hash; a source's
budget becomes one threshold on that hash, and the mix is a plain filter: no sort,
no shuffle of texts, and the same documents again on every run.

The threshold comes from histograms. Tokens are summed by (source, top hash bits);
the bucket in which the running sum crosses the budget is the boundary bucket, and
only its documents are summed again by the next bits, until a bucket holds one hash
value. With 2**bits buckets a level, the rows in play fall by that factor each time.
Budgets above the source's size are nested: whole repetitions for all of its documents
and a threshold for the rest.

Rows that equal each other in id, text and source are counted first and go as records of their
own: each such record has a hash, so a source that is one text many times over is divided like any other.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, schema, small, text_of, word_count

#: Sources beyond this many are joined by a shuffle instead of a broadcast.
BROADCAST_SOURCES = 100_000
#: Groups of equal rows beyond this many are joined by a shuffle.
BROADCAST_GROUPS = 300_000
#: Records that a group of equal rows is divided into at most; the mix takes whole records.
PIECES = 4096
HASH_BITS = 63


def ranked(sizes: DataFrame) -> DataFrame:
    """Rows (source, size) with rank: the number of sources before it by code point, null last. One count a task comes to the driver."""
    keys = [F.col("source").isNull(), F.col("source")]
    laid = cut(sizes.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_part", F.spark_partition_id()))
    before, total = [], 0
    for part, n in sorted((r["_part"], r["count"]) for r in laid.groupBy("_part").count().collect()):
        before.append((part, total))
        total += n
    offsets = sizes.sparkSession.createDataFrame(before, schema(_part="int", _before="long"))
    own = F.row_number().over(Window.partitionBy("_part").orderBy(*keys)) - 1
    return laid.withColumn("_own", own).join(F.broadcast(offsets), "_part").select("source", "size", (F.col("_own") + F.col("_before")).alias("rank"))


def targets(sizes: DataFrame, weights: Sequence[float] = (5, 2, 1), most: float = 3) -> DataFrame:
    """Rows (source, size) with the token target of each source: its share by weight of all tokens, at most `most` times its size.

    Weights go to the sources by code point (null last), repeating. What a source cannot take is shared among the
    others by weight, until no target is above its limit. Only sums come to the driver.
    """
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    rows = cut(ranked(sizes).withColumns({"_w": weight, "_limit": F.col("size") * F.lit(float(most))}))
    total = float(rows.agg(F.sum("size")).first()[0] or 0)
    full, share = F.lit(False), F.lit(0.0)
    while True:
        r = rows.agg(F.sum(F.when(full, F.col("_limit"))).alias("taken"), F.sum(F.when(~full, F.col("_w"))).alias("parts"), F.count_if(full).alias("n")).first()
        if not r["parts"]:
            break
        left = total - (r["taken"] or 0.0)
        share = F.lit(left) * F.col("_w") / F.lit(r["parts"])
        above = share > F.col("_limit")  # shares grow from step to step, so that what was above stays above
        if rows.agg(F.count_if(above)).first()[0] == r["n"]:
            break
        full = above
    return rows.select("source", "size", F.when(full, F.col("_limit")).otherwise(share).alias("target"))


def place(id_col: str = "doc_id", text_col: str = "text") -> Column:
    """A document's uniform hash, 63 bits. Equal rows have equal hashes; records() tells them apart."""
    return F.shiftrightunsigned(F.xxhash64(F.col(id_col), text_of(text_col)), 1)


def mixture_plan(sized: DataFrame, weights: Sequence[float] = (5, 2, 1), most: float = 3, bits: int = 12, near: float = 0.002) -> DataFrame:
    """One row per source: source, source_size, target, copies of every document, and limits, floors and cuts for one copy more.

    A document gets one copy more for each i where its size is at most limits[i] and its place above floors[i] and at most cuts[i].
    The first limit and floor are none. Where the boundary document is larger than what is left, and that is more than
    `near` of the target, a further threshold is sought beyond it among the documents that fit, until no more than that
    is left or no document fits; then among all documents again, while that leaves them `most` copies. The boundary document is taken after
    all if that comes nearer to the target than all these do.

    sized: source, size, place. The plan is a table that is refined level by level; neither documents nor sources come to the
    driver, only sums over all of them. An empty table gives an empty plan.
    """
    largest = (1 << 63) - 1
    left, size = F.col("left"), F.col("size")
    plan = targets(sized.groupBy("source").agg(F.sum("size").alias("size")), weights, most)
    plan = plan.withColumn("copies", F.when(size > 0, F.least(F.floor(F.col("target") / size), F.lit(int(most)))).otherwise(0).cast("int"))
    plan = plan.withColumn("left", F.when(size > 0, F.col("target") - F.col("copies") * size).otherwise(0.0))
    none = F.array().cast("array<bigint>")
    #: state: 2 begins with the next round, 1 is open in this one, 0 is done
    plan = cut(
        plan.withColumns({"limits": none, "floors": none, "cuts": none, "over": F.lit(None).cast("struct<excess:double,n:int,hi:bigint>"), "passes": F.lit(1), "floor": F.lit(-1).cast("long"), "limit": F.lit(largest)})
        .withColumns({"prefix": F.lit(0).cast("long"), "state": F.when(left >= 1, 2).otherwise(0)})
    )
    few = plan.count() <= BROADCAST_SOURCES
    sent = F.broadcast if few else lambda df: df

    def level(plan: DataFrame, shift: int, width: int) -> DataFrame:
        """The plan after one level: for each open source, the boundary bucket of its documents (the last one if all fit) is resolved or entered."""
        at = plan.where("state = 1").select(F.col("source").alias("of"), "floor", "limit", "prefix", left.alias("budget"))
        inside = sized.join(sent(at), F.col("source").eqNullSafe(F.col("of")) & (F.col("place") > F.col("floor")) & (size <= F.col("limit")))
        if shift + width < HASH_BITS:
            inside = inside.where(F.shiftright("place", shift + width) == F.col("prefix"))
        hist = inside.groupBy("source", F.shiftright("place", shift).alias("bucket")).agg(F.sum("size").alias("n"), F.first("budget").alias("budget"), F.min("place").alias("lo"), F.max("place").alias("hi"))
        upto = F.sum("n").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))
        last = F.max("bucket").over(Window.partitionBy("source"))
        crossed = (F.col("upto") > F.col("budget")) & (F.col("upto") - F.col("n") <= F.col("budget"))
        edge = hist.withColumns({"upto": upto, "_last": last}).where(crossed | ((F.col("bucket") == F.col("_last")) & (F.col("upto") <= F.col("budget"))))
        joined = plan.join(sent(edge.select(F.col("source").alias("_of"), "bucket", "n", "upto", "lo", "hi")), F.col("source").eqNullSafe(F.col("_of")), "left")

        is_open, some = F.col("state") == 1, F.col("upto").isNotNull()
        joined = joined.withColumn("_fits", ~some | (F.col("upto") <= left))  # the budget takes all that is left
        joined = joined.withColumn("left", F.when(is_open & some, left - F.when(F.col("_fits"), F.col("upto")).otherwise(F.col("upto") - F.col("n"))).otherwise(left))
        deeper = ~F.col("_fits") & (F.col("lo") != F.col("hi")) & F.lit(shift > 0)
        joined = joined.withColumns({"_deeper": is_open & deeper, "_closed": is_open & ~deeper, "prefix": F.when(is_open & deeper, F.col("bucket")).otherwise(F.col("prefix"))})
        closed = F.col("_closed")
        added = lambda c, value: F.when(closed, F.concat(c, F.array(value))).otherwise(F.col(c))
        joined = joined.withColumns({"limits": added("limits", F.col("limit")), "floors": added("floors", F.col("floor")), "cuts": added("cuts", F.when(F.col("_fits"), F.lit(largest)).otherwise(F.col("lo") - 1))})
        over = F.struct((F.col("n") - left).cast("double").alias("excess"), F.size("cuts").alias("n"), F.col("hi").alias("hi"))
        joined = joined.withColumn("over", F.when(closed & ~F.col("_fits"), F.least("over", over)).otherwise(F.col("over")))
        wanting = closed & (left >= F.greatest(F.lit(1.0), F.lit(near) * F.col("target")))
        onward, again = wanting & ~F.col("_fits"), wanting & F.col("_fits") & (F.col("copies") + F.col("passes") < int(most))
        joined = joined.withColumns({"_onward": onward, "_again": again})
        done = closed & ~F.col("_onward") & ~F.col("_again")
        # a boundary document itself, if that is nearer to the target
        back = done & F.col("over").isNotNull() & (F.col("over.excess") < left)
        shorter = lambda c: F.when(back, F.slice(c, F.lit(1), F.col("over.n"))).otherwise(F.col(c))
        joined = joined.withColumns({"limits": shorter("limits"), "floors": shorter("floors"), "cuts": F.when(back, F.concat(F.slice("cuts", F.lit(1), F.col("over.n") - 1), F.array("over.hi"))).otherwise(F.col("cuts"))})
        whole = F.floor(left).cast("long")
        joined = joined.withColumns(
            {
                "floor": F.when(F.col("_onward"), F.col("hi")).when(F.col("_again"), -1).otherwise(F.col("floor")),
                "limit": F.when(F.col("_onward"), F.least("limit", whole)).when(F.col("_again"), whole).otherwise(F.col("limit")),
                "passes": F.col("passes") + F.col("_again").cast("int"),
                "state": F.when(F.col("_onward") | F.col("_again"), 2).when(closed, 0).otherwise(F.col("state")),
            }
        )
        return joined.select(*plan.columns)

    def counted(plan: DataFrame) -> tuple[int, int]:
        r = plan.agg(F.count_if(F.col("state") == 1).alias("open"), F.count_if(F.col("state") == 2).alias("next")).first()
        return r["open"], r["next"]

    shift, (_, waiting) = 0, counted(plan)
    inside = 0
    while inside or waiting:
        if not inside:
            plan, shift = plan.withColumn("state", F.when(F.col("state") == 2, 1).otherwise(F.col("state"))), HASH_BITS
        width = min(bits, shift)
        shift -= width
        plan = cut(level(plan, shift, width))
        inside, waiting = counted(plan)
    return plan.select("source", F.col("size").alias("source_size"), "target", "copies", "limits", "floors", "cuts")


def with_plan(docs: DataFrame, plan: DataFrame, source_col: str = "source") -> DataFrame:
    """docs (with columns size and place) and the number of times that the mix takes each row, as column copies."""
    p = small(plan, BROADCAST_SOURCES).withColumnRenamed("source", "_of")
    joined = docs.join(p, F.col(source_col).eqNullSafe(F.col("_of"))).drop("_of")
    fits = F.size(F.filter(F.arrays_zip("limits", "floors", "cuts"), lambda x: (F.col("size") <= x["limits"]) & (F.col("place") > x["floors"]) & (F.col("place") <= x["cuts"])))
    fits = F.when(F.col("size") > 0, fits).otherwise(F.least(fits, F.lit(1)))  # documents without words fill no target
    return joined.withColumn("copies", F.col("copies") + fits).drop("limits", "floors", "cuts")


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), place(id_col, text_col).alias("place"))


def records(rows: DataFrame) -> DataFrame:
    """What the plan decides on: doc_id, source, size, place, n and group, for rows of sized().

    A row without an equal is a record of its own. Of more, PIECES records at most are made, each of n of them, with the size
    of them all and a place of its own; group is the place of the rows.
    """
    groups = rows.groupBy("doc_id", "source", "size", F.col("place").alias("group")).agg(F.count("*").alias("_m"))
    k = F.least("_m", F.lit(PIECES)).cast("int")
    each = groups.withColumn("_k", k).withColumn("_j", F.explode(F.sequence(F.lit(0), F.col("_k") - 1)))
    n = F.floor(F.col("_m") / F.col("_k")) + (F.col("_j") < F.col("_m") % F.col("_k")).cast("long")
    own = F.when(F.col("_j") == 0, F.col("group")).otherwise(F.shiftrightunsigned(F.xxhash64("group", "_j"), 1))
    return each.select("doc_id", "source", (F.col("size") * n).alias("size"), own.alias("place"), n.alias("n"), "group")


def mix_table(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), most: float = 3, bits: int = 12) -> DataFrame:
    """Per document: doc_id, source, size, source_size, target of its source, copies and taken = copies * size.

    Null texts have size 0; a null source is a source of its own. Of equal rows (same id, text and source) as many are
    taken once more as the target asks for. Extra columns of docs play no part. An empty table gives an empty result.
    """
    rows = cut(records(sized(docs)))
    planned = with_plan(rows, mixture_plan(rows, weights, most, bits)).drop("place", "group")
    many = planned.where("n > 1").repartition("doc_id", "source", F.rand(0)).withColumn("size", F.floor(F.col("size") / F.col("n")))
    each = many.withColumn("_i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n")))).drop("_i")
    return planned.where("n = 1").unionByName(each).drop("n").withColumn("taken", F.col("copies").cast("long") * F.col("size"))


def mix(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), most: float = 3, bits: int = 12) -> DataFrame:
    """The mix itself: rows of docs with their own columns, each as often as the mix takes it.

    Rows without words are taken like others, by their hash, but not where their source has no words at all. Null ids, texts and
    sources count as values, an empty table gives an empty result. Texts are read where they lie: the plan is joined to the scan by source and nothing is
    sorted. Only rows that have equals (in id, text and source) are numbered, by input partition and then within it, and the first ones are taken once more.
    """
    names = [F.col(f"_doc.`{c}`").alias(c) for c in docs.columns]
    rows = cut(records(sized(docs)))
    plan = mixture_plan(rows, weights, most, bits)
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"), F.col("source").alias("_source"), word_count(F.col("text")).alias("size"), place().alias("place"))
    equal = with_plan(rows, plan).groupBy("source", "group").agg(F.sum("n").alias("_m"), F.min("copies").alias("copies"), F.sum(F.col("copies") * F.col("n")).alias("_all"))
    equal = cut(equal.where("_m > 1").select(F.col("source").alias("_of"), F.col("group").alias("_group"), "copies", (F.col("_all") - F.col("copies") * F.col("_m")).alias("_more")))
    if equal.take(1):
        same = F.col("_source").eqNullSafe(F.col("_of")) & (F.col("place") == F.col("_group"))
        marked = held.withColumn("_part", F.spark_partition_id()).join(small(equal, BROADCAST_GROUPS), same, "left")
        alone = with_plan(marked.where("_group is null").drop("copies", "_of"), plan, "_source").select("_doc", "copies")
        grouped = marked.where("_group is not null")
        before = F.sum("count").over(Window.partitionBy("_of", "_group").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
        ahead = grouped.groupBy("_of", "_group", "_part").count().withColumn("_before", F.coalesce(before, F.lit(0))).select(F.col("_of").alias("_of2"), F.col("_group").alias("_group2"), F.col("_part").alias("_part2"), "_before")
        number = F.row_number().over(Window.partitionBy("_of", "_group", "_part").orderBy(F.lit(0)))
        placed = grouped.withColumn("_number", number).join(ahead, F.col("_of").eqNullSafe(F.col("_of2")) & (F.col("_group") == F.col("_group2")) & (F.col("_part") == F.col("_part2")))
        more = (F.col("_number") + F.col("_before") <= F.col("_more")).cast("int")
        planned = alone.unionByName(placed.select("_doc", (F.col("copies") + more).alias("copies")))
    else:
        planned = with_plan(held, plan, "_source").select("_doc", "copies")
    return planned.where(F.col("copies") > 0).select("_doc", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*names)
