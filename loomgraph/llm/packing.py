"""Filling fixed-capacity containers: bulk-synchronous best fit.

Sizes are handled in ranges, from the largest: (C/2, C], (C/4, C/2], ... and the rest. A superstep
takes the documents of a range that are still open and the gaps of all containers:

* **Slots.** A gap of several times the range's upper end counts as several slots of that size and a
  remainder, so a container takes many small documents in one superstep.
* **Range sort and successor sweep.** Slots and documents stand in falling order of size, slots
  first. A document wants its successor, the smallest slot that holds it; of equal claims the
  larger document goes first. That is the matching of brackets: slots open, documents close.
  Counts by size and salted bucket give the depth before each (running sums and minima in one
  task, over a row for each), ranks within a bucket give every slot and document its own depth,
  and at one depth slots and documents take turns. So all conflicts are settled by rank, in
  one shuffle by depth, and no document waits for another's placement.
* **Update.** Gaps are reduced by what they took, and the superstep is repeated until next to
  nothing fits; then containers are opened for what is left.

Everything is a table: nothing but three sums of each superstep comes to the driver. Equal
sizes are ranked in salted buckets, so a size shared by a third of all documents is spread over
tasks, and at one depth there are at most two rows for each size.

Every shuffle of a superstep costs the driver memory to plan it, whatever the input, so a
superstep has few of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.llm.bpe import encode_corpus
from loomgraph.session import Scratch, cut

CAPACITY = 2048
#: Rows of one rank bucket, about.
BUCKET_ROWS = 200_000
#: Ranges of sizes that are handled one by one; the last holds all smaller sizes.
RANGES = 5
#: A superstep that places a smaller share of the open documents is the last before containers are opened.
LEAST_SHARE = 0.02


def size_ranges(capacity: int, ranges: int = RANGES) -> list[tuple[int, int]]:
    """(low, high] of each range, from the largest sizes down."""
    out, high = [], capacity
    while high and len(out) < ranges - 1:
        out.append((high // 2, high))
        high //= 2
    return [*out, (0, high)] if high else out


def slots(gaps: DataFrame, low: int, high: int, buckets: int) -> DataFrame:
    """(container, size, b): gaps as slots of more than ``low`` and at most ``high``."""
    whole, rest = F.floor(F.col("gap") / high).cast("int"), (F.col("gap") % high).cast("int")
    sizes = F.concat(F.array_repeat(F.lit(high), whole), F.when(rest > low, F.array(rest)).otherwise(F.array().cast("array<int>")))
    rows = gaps.where(F.col("gap") > low).select("container", F.posexplode(sizes).alias("nth", "size"))
    return rows.select("container", "size", F.pmod(F.xxhash64("container", "nth"), F.lit(buckets)).cast("int").alias("b"))


def superstep(items: DataFrame, gaps: DataFrame, low: int, high: int, buckets: int) -> DataFrame:
    """``items`` (id, start, size, b) of one range with the container that each goes to, or null."""
    opened = slots(gaps, low, high, buckets)
    none = F.lit(None).cast(items.schema["id"].dataType)
    both = opened.select(none.alias("id"), F.lit(None).cast("int").alias("start"), "size", "b", "container").withColumn("open", F.lit(True)).unionByName(
        items.select("id", "start", "size", "b", F.lit(None).cast("bigint").alias("container")).withColumn("open", F.lit(False))
    )
    # The depth before each cell, in order: slots before documents of their size.
    down = Window.orderBy(F.desc("size"), F.desc("open"), "b")
    step = F.when(F.col("open"), F.col("c")).otherwise(-F.col("c"))
    cells = both.groupBy("size", "open", "b").agg(F.count(F.lit(1)).alias("c")).withColumn("d", F.sum(step).over(down.rowsBetween(Window.unboundedPreceding, 0)))
    lowest = F.least(F.lit(0), F.min("d").over(down.rowsBetween(Window.unboundedPreceding, -1)))
    places = cells.select("size", "open", "b", (F.col("d") - step - lowest).alias("before"))
    rank = F.row_number().over(Window.partitionBy("size", "open", "b").orderBy("id", "start", "container"))
    deep = both.withColumn("r", rank).join(places, ["size", "open", "b"])
    deep = deep.withColumn("depth", F.when(F.col("open"), F.col("before") + F.col("r") - 1).otherwise(F.col("before") - F.col("r")))
    # Below 0 there are no slots, and documents of many sizes and buckets.
    turn = Window.partitionBy("depth", F.when(F.col("depth") < 0, F.col("b"))).orderBy(F.desc("size"), F.desc("open"))
    met = deep.withColumn("taken", F.lag("container").over(turn)).where("not open")
    return met.select("id", "start", "size", "b", F.col("taken").alias("container"))


def pack(items: DataFrame, id_col: str, size_col: str, capacity: int = CAPACITY) -> DataFrame:
    """container bigint, the id column, start int, end int: where each range of an item goes.

    An item within the capacity has one range; a larger one fills containers of its own and its
    remainder is packed like an item. Items of size 0 or null have the range 0 to 0 and no
    container. Repeated ids are items of their own. Other columns are ignored.
    """
    spark = items.sparkSession
    scratch = Scratch(spark)
    own = scratch.put(items.select(F.col(id_col).alias("id"), F.coalesce(F.col(size_col).cast("int"), F.lit(0)).alias("n")))
    rest = F.col("n") % capacity
    ranges = size_ranges(capacity)
    in_range = [F.when((rest > low) & (rest <= high), rest) for low, high in ranges]
    rows, *known = own.agg(F.count(F.lit(1)), *[f(x) for x in in_range for f in (F.count, F.sum)]).first()
    buckets = max(16, rows // BUCKET_ROWS)
    parts = own.where(rest > 0).select("id", (F.col("n") - rest).alias("start"), rest.alias("size"), F.pmod(F.xxhash64("id"), F.lit(buckets)).cast("int").alias("b"))
    put: list[DataFrame] = []
    used = 0
    gaps: DataFrame | None = None
    for left, total, (low, high) in zip(known[::2], known[1::2], ranges):
        open_items = parts.where((F.col("size") > low) & (F.col("size") <= high))
        fresh = False
        while left:
            if gaps is None or fresh:
                # What is left fits for certain, or, where containers take many, by its sum.
                need = -(-total // capacity) if low == 0 else -(-left // (capacity // high))
                new = spark.range(used, used + need).select(F.col("id").alias("container"), F.lit(capacity).alias("gap"))
                gaps = new if gaps is None else gaps.unionByName(new)
                used += need
            out = scratch.put(superstep(open_items, gaps, low, high, buckets))
            placed, total, rest_n = out.agg(F.count("container"), F.sum(F.when(F.col("container").isNull(), F.col("size"))), F.count(F.when(F.col("container").isNull(), 1))).first()
            if placed:
                put.append(out)
                taken = out.where("container is not null").select("container", (-F.col("size")).alias("gap"))
                less = gaps.unionByName(taken).groupBy("container").agg(F.sum("gap").cast("int").alias("gap"))
                gaps = scratch.put(less.where("gap > 0"), gaps)
            fresh = placed < max(1, LEAST_SHARE * left)
            open_items, left = out.where("container is null").drop("container"), rest_n
    columns = [F.col("container"), F.col("id"), F.col("start"), (F.col("start") + F.col("size")).alias("end")]
    # Items beyond the capacity: whole containers, numbered after the packed ones. The running sum
    # over buckets is one row for each of ``buckets``.
    large = own.where(F.col("n") >= capacity).withColumn("k", F.floor(F.col("n") / capacity)).withColumn("b", F.pmod(F.xxhash64("id"), F.lit(buckets)).cast("int"))
    so_far = large.groupBy("b").agg(F.sum("k").alias("k")).select(
        "b", F.coalesce(F.sum("k").over(Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("ahead")
    )
    upto = Window.partitionBy("b").orderBy("id", "n").rowsBetween(Window.unboundedPreceding, -1)
    whole = (
        large.withColumn("base", F.coalesce(F.sum("k").over(upto), F.lit(0)))
        .join(so_far, "b")
        .select("id", (F.col("base") + F.col("ahead") + used).alias("base"), F.explode(F.sequence(F.lit(0), F.col("k").cast("int") - 1)).alias("j"))
        .select(
            (F.col("base") + F.col("j")).cast("bigint").alias("container"),
            "id",
            (F.col("j") * capacity).alias("start"),
            ((F.col("j") + 1) * capacity).alias("end"),
        )
    )
    none = own.where("n = 0").select(F.lit(None).cast("bigint").alias("container"), "id", F.lit(0).alias("start"), F.lit(0).alias("end"))
    out = whole.unionByName(none)
    if put:
        out = out.unionByName(scratch.all(put).where("container is not null").select(*columns))
    out = cut(out)
    scratch.drop()
    return out.withColumnRenamed("id", id_col)


def packed_documents(documents: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Containers of documents, measured in ids of the public tokenizer."""
    return pack(encode_corpus(documents, lengths_only=True), "doc_id", "n_ids", capacity)


def packing_report(packed: DataFrame, id_col: str = "doc_id", capacity: int = CAPACITY) -> DataFrame:
    """One row: documents, overfull (containers over the capacity), torn (documents whose ranges leave a
    gap, overlap or do not begin at 0) and cut (documents of several ranges one of which could
    have been the whole document)."""
    one = packed.select(F.col(id_col).alias("id"), "container", "start", "end")
    fill = one.where("container is not null").groupBy("container").agg(F.sum(F.col("end") - F.col("start")).alias("n"))
    over = fill.agg(F.count(F.when(F.col("n") > capacity, 1)).alias("overfull"))
    docs = one.groupBy("id").agg(F.min("start").alias("lo"), F.max("end").alias("hi"), F.sum(F.col("end") - F.col("start")).alias("n"), F.count(F.lit(1)).alias("ranges"))
    torn = (F.col("lo") != 0) | (F.col("n") != F.col("hi"))
    cut = (F.col("ranges") > 1) & (F.col("n") <= capacity)
    own = docs.agg(F.count(F.lit(1)).alias("documents"), F.count(F.when(torn, 1)).alias("torn"), F.count(F.when(cut, 1)).alias("cut"))
    return own.join(F.broadcast(over)).select("documents", "overfull", "torn", "cut")
