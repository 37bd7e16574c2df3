"""Consolidating pairwise matches into groups (peeled hub components, then minimum propagation).

1. The highest-degree vertex is taken as a hub; frontier breadth-first joins collect its whole
   component, which is labelled and anti-joined away. While the next hub still holds a large
   share of the edges, it is peeled too. A hub's neighbours start as a frontier of one row, so
   a vertex with a third of all edges never becomes a shuffle key of a skewed join. What a level
   reaches lies in it or beside it, so only the last two levels are anti-joined, and no list
   of all that was seen is rewritten.
2. The remaining small components are labelled by propagating minima: every vertex takes the
   least label of its neighbourhood, labels are followed once more (pointer jumping), and the
   edges are contracted to labels, so chains shrink geometrically and not hop by hop.

A breadth-first search that is still running after ``max_hops`` rounds (a long chain tied to a
hub) is contracted to the hub and left to step 2, which ends the same way. Joins on vertices or
labels that may be hot are salted from ``HOT_ROWS`` rows of the table on (fewer rows hold no
hot key). Intermediate tables lie in a folder of their own, which is deleted when the result stands.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.text import key
from loomgraph.operators.skew import hot_codes, salted_join
from loomgraph.session import Scratch, cut

#: A frontier is broadcast up to this many rows, and joined by shuffle beyond it.
BROADCAST_ROWS = 20_000
#: Keys of fewer rows are not salted.
HOT_ROWS = 100_000


def connected_groups(pairs: DataFrame, left: str = "a", right: str = "b", hub_share: float = 0.05, hub_degree: int = 8, max_hops: int = 40) -> DataFrame:
    """``id`` and ``group_id`` (the least id of the group) of each id in a pair of two ids.

    Pairs with a null end or with one id twice link nothing; repeated and reversed pairs count
    once; other columns are ignored. An empty input gives an empty result.
    """
    scratch = Scratch(pairs.sparkSession)
    kept = pairs.select(F.col(left).alias("a"), F.col(right).alias("b")).where(F.col("a") != F.col("b"))
    both = kept.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.a", "e.b")
    edges = scratch.put(both.distinct())
    parts: list[DataFrame] = []
    while True:
        degrees = edges.groupBy("a").agg(F.count(F.lit(1)).alias("n"))
        total, top = degrees.agg(F.sum("n"), F.max(F.struct("n", "a"))).first()
        if not total:
            break
        hub, degree = top["a"], top["n"]
        if parts and (degree < hub_degree or degree < hub_share * total):
            parts.append(_propagate(scratch, edges, edges.select(F.col("a").alias("id")).distinct().withColumn("label", F.col("id")), total))
            break
        seen, finished = _reach(scratch, edges, hub, max_hops, total)
        if not finished:
            # Contract what was reached to the hub and let the labels travel on from there.
            ends = edges.select(F.col("a").alias("id")).distinct()
            reached = seen.select(F.col("id").alias("r"), F.lit(hub).alias("label"))
            labels = scratch.put(ends.join(reached, F.col("id") == F.col("r"), "left").select("id", F.coalesce("label", "id").alias("label")))
            parts.append(_propagate(scratch, _relabel(scratch, edges, labels, total), labels, total))
            break
        parts.append(seen.withColumn("label", F.lit(seen.agg(F.min("id")).first()[0])))
        edges = scratch.put(_join(edges, seen.withColumnRenamed("id", "r"), "a", "r", "left_anti", total), edges)
    if not parts:
        return kept.select(F.col("a").alias("id"), F.col("b").alias("group_id"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    out = cut(out.select("id", F.col("label").alias("group_id")))
    scratch.drop()
    return out


def _join(left: DataFrame, right: DataFrame, a: str, b: str, how: str, rows: int, hot: list[int] | None = None) -> DataFrame:
    """``left`` (of at most ``rows`` rows) joined with ``right`` (one row for a key); hot keys are salted."""
    if rows < HOT_ROWS:
        return left.join(right, F.col(a) == F.col(b), how)
    return salted_join(left, right, [(a, b)], how, hot_rows=HOT_ROWS, hot=hot)


def _reach(scratch: Scratch, edges: DataFrame, hub: str, max_hops: int, total: int) -> tuple[DataFrame, bool]:
    """All vertices within ``max_hops`` of the hub, and whether these are its whole component."""
    frontier = scratch.spark.createDataFrame([(hub,)], "id string")
    seen, before, size = frontier, None, 1
    for _ in range(max_hops):
        near = frontier.withColumnRenamed("id", "r")
        # Beyond the first level the hub's own edges lead back and are left out before any shuffle.
        own = edges if before is None else edges.where((F.col("a") != hub) & (F.col("b") != hub))
        met = own.join(F.broadcast(near), F.col("a") == F.col("r"), "left_semi") if size <= BROADCAST_ROWS else _join(own, near, "a", "r", "left_semi", total)
        nxt = met.select(F.col("b").alias("id")).distinct()
        past = frontier if before is None else frontier.unionByName(before)
        nxt = nxt.join(past, "id", "left_anti")
        frontier, before = scratch.put(nxt), frontier
        size = frontier.count()
        if not size:
            return seen, True
        seen = seen.unionByName(frontier)
    return seen, False


def _relabel(scratch: Scratch, edges: DataFrame, labels: DataFrame, total: int) -> DataFrame:
    """Edges between the labels of their ends, without loops."""
    x = labels.select(F.col("id").alias("xa"), F.col("label").alias("la"))
    y = labels.select(F.col("id").alias("yb"), F.col("label").alias("lb"))
    # Edges stand in both directions, so both of their ends have the same hot ids.
    hot = hot_codes(edges, F.xxhash64("a"), 0.01, HOT_ROWS) if total >= HOT_ROWS else None
    moved = _join(_join(edges, x, "a", "xa", "inner", total, hot), y, "b", "yb", "inner", total, hot).select(F.col("la").alias("a"), F.col("lb").alias("b"))
    return scratch.put(moved.where(F.col("a") != F.col("b")).distinct())


def _propagate(scratch: Scratch, edges: DataFrame, labels: DataFrame, total: int) -> DataFrame:
    """(id, label) with the least id of each component as label."""
    while not edges.isEmpty():
        least = edges.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("v"), F.least("a", "m").alias("m"))
        up = least.select(F.col("v").alias("m"), F.col("m").alias("top"))
        parent = scratch.put(least.join(up, "m", "left").select(F.col("v").alias("id"), F.coalesce("top", "m").alias("label")))
        moved = parent.select(F.col("id").alias("was"), F.col("label").alias("to"))
        labels = scratch.put(_join(labels, moved, "label", "was", "left", total).select("id", F.coalesce("to", "label").alias("label")), labels)
        edges = _relabel(scratch, edges, parent, total)
    low = labels.groupBy("label").agg(F.min("id").alias("least")).withColumnRenamed("label", "was")
    return _join(labels, low, "label", "was", "inner", total).select("id", F.col("least").alias("label"))


def alias_links(records: DataFrame, id_col: str, list_col: str) -> DataFrame:
    """Pairs (a, b) that tie each id to the least id with the same list entry.

    Entries are compared like keys; null and blank entries, null lists and null ids link nothing.
    Links number the entries, not their pairs; a very common entry is salted.
    """
    own = records.select(key(F.col(id_col)).alias("a"), F.explode(list_col).alias("e"))
    own = own.select("a", key(F.col("e")).alias("e")).dropna().distinct()
    shared = own.groupBy("e").agg(F.min("a").alias("b"), F.max("a").alias("z")).where("b < z")
    ends = shared.select(F.col("e").alias("e2"), "b")
    return salted_join(own, ends, [("e", "e2")], "inner").where("a <> b").select("a", "b")


def entity_groups(entity_matches: DataFrame, entities: DataFrame) -> DataFrame:
    """canonical_id, group_id of every id tied to another by a true match or a common alias.

    Ids are compared and given without outer white space and in lower case. A null is_match is
    no match.
    """
    matched = entity_matches.where("is_match").select(key(F.col("left_id")).alias("a"), key(F.col("right_id")).alias("b"))
    pairs = matched.dropna().unionByName(alias_links(entities, "canonical_id", "aliases"))
    return connected_groups(pairs).select(F.col("id").alias("canonical_id"), "group_id")
