"""Bounded multi-hop paths, facts and their evidence, for many seeds at once.

A search is at most five self-joins of a frontier with the ranked outgoing neighbours. Breadth-
first order equals the order of (length, hop ordinals), so the first ``max_paths`` of a length are
an extension of prefixes. A seed with ``max_paths`` paths leaves the search, since longer ones come
after them. Paths are numbered by counts of their prefixes, so that a path is written out once it is
known to stay, and is not moved afterwards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions.text import strip
from loomgraph.operators.resolution import small
from loomgraph.session import Scratch


def path_score(hops: Column) -> Column:
    return F.round(1.0 / (1.0 + 0.25 * (hops - 1)), 3)


def outgoing(neighbour_table: DataFrame) -> DataFrame:
    """Hops of the graph: outgoing neighbours with their distinct evidence chunks in order."""
    chunk_ids = F.array_distinct(F.filter(F.transform(F.coalesce("evidence", F.array().cast(neighbour_table.schema["evidence"].dataType)), lambda e: e["chunk_id"]), lambda c: c.isNotNull() & (c != "")))
    return neighbour_table.where("direction = 'OUTGOING'").select(
        F.col("node_id").alias("hop_from"), F.col("ordinal").alias("hop_ord"), F.col("relation").alias("hop_rel"), F.col("target_id").alias("hop_to"), F.col("target_name").alias("hop_name"), chunk_ids.alias("hop_ev")
    )


def hop_lists(hops: DataFrame, scratch: Scratch, max_hops: int) -> DataFrame:
    """One row for each node: hop_from and ``out``, its hops in order. ``least`` of a hop: how many paths go on
    from its end at least, for paths of 2, 3 ... names that end with it, whatever the other names are."""
    flat = scratch.put(hops.where("hop_name is not null and hop_to is not null"))
    ends = flat.groupBy("hop_from").agg(F.collect_list("hop_name").alias("names"), F.collect_list("hop_to").alias("ids"))
    blocks = lambda x: F.size(F.filter("names", lambda y: y == x)) + F.size(F.filter("ids", lambda y: y == x))
    # How many hops the names that block most of them block, most first.
    most = F.slice(F.reverse(F.array_sort(F.transform(F.array_union("names", "ids"), blocks))), 1, max_hops)
    ends = ends.select(F.col("hop_from").alias("hop_to"), "names", "ids", most.alias("most"))
    met = flat.join(ends, "hop_to", "left").withColumn("sure", F.size("names") - blocks(F.col("hop_name")))
    least = F.array(*[F.coalesce(F.greatest(F.col("sure") - F.aggregate(F.slice("most", 1, n), F.lit(0), lambda s, x: s + x), F.lit(0)), F.lit(0)) for n in range(1, max_hops)]).cast("array<int>")
    each = F.struct("hop_ord", "hop_name", "hop_to", "hop_rel", "hop_ev", F.col("names").isNotNull().alias("goes_on"), least.alias("least"))
    return scratch.put(met.groupBy("hop_from").agg(F.sort_array(F.collect_list(each)).alias("out")), flat)


def find_paths(seeds: DataFrame, hops: DataFrame, max_hops: int = 2, max_paths: int = 20) -> DataFrame:
    """Paths from each seed: seed, path_rank, entities, relationships, length, score,
    evidence_chunk_ids, explanation.

    seeds: (seed, canonical_id, canonical_name) of entities found; seeds that are no entity must
    be left out and so have no paths. A path never comes to a name or id that is already among
    its names. Evidence lists each chunk once, in path order.
    """
    if not 1 <= max_hops <= 5:
        raise ValueError("max_hops must be from 1 to 5")
    scratch = Scratch(seeds.sparkSession)
    lists = hop_lists(hops, scratch, max_hops)
    prefixes = seeds.select(
        "seed",
        F.col("canonical_id").alias("at"),
        F.array(F.coalesce(F.when(F.col("canonical_name") != "", F.col("canonical_name")), "canonical_id")).alias("entities"),
        F.array().cast("array<string>").alias("relationships"),
        F.array().cast("array<int>").alias("ords"),
        F.array().cast("array<string>").alias("evidence_chunk_ids"),
        F.lit(0).cast("long").alias("had"),
    )
    found = None
    for hop in range(1, max_hops + 1):
        kept = scratch.put(_counted(prefixes, lists, max_paths, hop if hop < max_hops else None))
        paths = _extended(kept, lists).where(F.col("path_rank") <= max_paths).select("seed", "path_rank", "entities", "relationships", "evidence_chunk_ids")
        found = paths if found is None else found.unionByName(paths)
        # What a path is followed by comes after what all paths before it are followed by; these are
        # enough from ``rest`` on.
        if hop == max_hops:
            break
        longer = _extended(kept.where("ahead < rest"), lists, hop)
        prefixes = longer.where("goes_on and ahead < rest").select("seed", "at", "entities", "relationships", "ords", "evidence_chunk_ids", (F.lit(max_paths) - F.col("rest")).alias("had"))
    length = F.size("relationships")
    return found.select(
        "seed", "path_rank", "entities", "relationships", length.alias("length"), path_score(length).alias("score"), "evidence_chunk_ids", F.array_join("entities", " -> ").alias("explanation")
    )


def _open_hops(out: Column) -> Column:
    return F.filter(out, lambda h: ~F.array_contains("entities", h["hop_name"]) & ~F.array_contains("entities", h["hop_to"]))


def _counted(prefixes: DataFrame, lists: DataFrame, max_paths: int, hop: int | None) -> DataFrame:
    """``prefixes`` that hold one of their seed's first max_paths paths, with the number of paths of this length
    that come before theirs (``before``), of prefixes with the same ordinals (``peers``), of paths the seed still
    lacks after this length (``rest``) and, of the next length, of those that surely come before theirs
    (``ahead``; none is counted after the last length, without ``hop``). The paths themselves are not moved."""
    least = lambda h: F.get(h["least"], F.lit(hop - 1)) if hop else F.lit(0)
    slim = F.transform("out", lambda h: F.struct(h["hop_name"].alias("hop_name"), h["hop_to"].alias("hop_to"), least(h).alias("least")))
    met = prefixes.join(lists.select("hop_from", slim.alias("out")), F.col("at") == F.col("hop_from")).select(*prefixes.columns, _open_hops(F.col("out")).alias("open"))
    ahead = F.aggregate("open", F.lit(0).cast("long"), lambda n, h: n + h["least"]) if hop else F.lit(0).cast("long")
    met = met.select(*prefixes.columns, F.size("open").alias("n"), ahead.alias("least")).where("n > 0")
    seed, alike = Window.partitionBy("seed"), Window.partitionBy("seed", "ords")
    # Rows of equal ordinals are one step of the running sum.
    earlier = lambda c: F.sum(c).over(seed.orderBy("ords")) - F.sum(c).over(alike)
    ranked = met.select(
        *prefixes.columns, "n", earlier("n").alias("before"), F.count(F.lit(1)).over(alike).alias("peers"), (F.lit(max_paths) - F.col("had") - F.sum("n").over(seed)).alias("rest"), earlier("least").alias("ahead")
    )
    return ranked.where(F.col("before") < F.lit(max_paths) - F.col("had"))


def _extended(kept: DataFrame, lists: DataFrame, hop: int | None = None) -> DataFrame:
    """The paths of counted prefixes, one row each, with path_rank, ``goes_on`` and ``rest``; ``ahead`` only where
    the number of hops is given."""
    met = kept.join(lists, F.col("at") == F.col("hop_from")).withColumn("open", F.when(F.col("n") == F.size("out"), F.col("out")).otherwise(_open_hops(F.col("out"))))

    def rows(pos: Column, ahead: Column) -> list[Column]:
        return [
            F.col("seed"),
            F.col("h.hop_to").alias("at"),
            F.concat("entities", F.array("h.hop_name")).alias("entities"),
            F.concat("relationships", F.array("h.hop_rel")).alias("relationships"),
            F.concat("ords", F.array("h.hop_ord")).alias("ords"),
            F.array_union("evidence_chunk_ids", "h.hop_ev").alias("evidence_chunk_ids"),
            (F.col("had") + F.col("before") + pos + 1).cast("int").alias("path_rank"),
            F.col("h.goes_on").alias("goes_on"),
            F.col("rest"),
            ahead.alias("ahead"),
        ]

    columns = ["seed", "entities", "relationships", "ords", "evidence_chunk_ids", "had", "before", "rest", "ahead"]
    alone = met.where("peers = 1")
    if hop is None:
        longer = alone.select(*columns, F.posexplode("open").alias("pos", "h")).select(*rows(F.col("pos"), F.col("ahead")))
    else:
        sums = F.aggregate("open", F.array(F.lit(0).cast("long")), lambda s, h: F.concat(s, F.array(F.element_at(s, -1) + F.get(h["least"], F.lit(hop - 1)))))
        both = alone.withColumn("sums", F.slice(sums, 1, F.size("open"))).select(*columns, F.posexplode(F.arrays_zip("open", "sums")).alias("pos", "x"))
        longer = both.select(*columns, "pos", F.col("x.open").alias("h"), F.col("x.sums").alias("sum")).select(*rows(F.col("pos"), F.col("ahead") + F.col("sum")))
    if not kept.where("peers > 1").isEmpty():
        # Prefixes of equal ordinals (a seed or hop that is there twice): their paths come in turns.
        many = met.where("peers > 1").select(*columns, F.explode("open").alias("h"))
        turn = F.row_number().over(Window.partitionBy("seed", "ords").orderBy("h.hop_ord")) - 1
        longer = longer.unionByName(many.withColumn("pos", turn).select(*rows(F.col("pos"), F.col("ahead"))))
    return longer


def find_facts(paths: DataFrame, max_facts: int = 30) -> DataFrame:
    """Facts of the first 2 x max_facts paths: seed, fact_rank, source_name, relation,
    target_name, evidence_chunk_id, confidence. ``paths`` must hold that many.

    Triples count once whatever their case; the first place in path order gives spelling, the
    path's first chunk and the path's score.
    """
    p = paths.where(F.col("path_rank") <= 2 * max_facts)
    hop = p.select("seed", "path_rank", "entities", "score", F.coalesce(F.try_element_at("evidence_chunk_ids", F.lit(1)), F.lit("")).alias("evidence_chunk_id"), F.posexplode("relationships").alias("hop", "relation"))
    rows = hop.select("seed", "path_rank", "hop", F.element_at("entities", F.col("hop") + 1).alias("source_name"), "relation", F.element_at("entities", F.col("hop") + 2).alias("target_name"), "evidence_chunk_id", F.col("score").alias("confidence"))
    key = [F.lower("source_name"), F.lower("relation"), F.lower("target_name")]
    once = rows.withColumn("nth", F.row_number().over(Window.partitionBy("seed", *key).orderBy("path_rank", "hop"))).where("nth = 1")
    rank = F.row_number().over(Window.partitionBy("seed").orderBy("path_rank", "hop"))
    return once.withColumn("fact_rank", rank).where(F.col("fact_rank") <= max_facts).select("seed", "fact_rank", "source_name", "relation", "target_name", "evidence_chunk_id", "confidence")


def evidence_chunks(paths: DataFrame, chunks: DataFrame, max_paths: int = 20) -> DataFrame:
    """Chunks behind the paths: seed, rank, chunk_id, document_id, text, score.

    rank is the place among the distinct ids in path order; ids without a chunk leave gaps.
    """
    ids = paths.where(F.col("path_rank") <= max_paths).select("seed", "path_rank", F.posexplode("evidence_chunk_ids").alias("n", "chunk_id"))
    first = ids.groupBy("seed", "chunk_id").agg(F.min(F.struct("path_rank", "n")).alias("place"))
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("seed").orderBy("place")))
    # Texts that no path names are not moved.
    wanted = small(ids.select("chunk_id").distinct())
    body = chunks.select("chunk_id", "document_id", "text").join(wanted, "chunk_id", "left_semi").dropDuplicates(["chunk_id"])
    return ranked.join(body, "chunk_id").select("seed", "rank", "chunk_id", "document_id", "text", F.lit(1.0).alias("score"))


def render(paths: DataFrame) -> DataFrame:
    """``paths`` with ``pattern``: (A)-[:R]->(B)."""
    steps = F.zip_with(F.col("relationships"), F.slice("entities", 2, F.greatest(F.size("entities") - 1, F.lit(0))), lambda r, e: F.concat(F.lit("-[:"), r, F.lit("]->("), e, F.lit(")")))
    text = F.concat(F.lit("("), F.try_element_at("entities", F.lit(1)), F.lit(")"), F.array_join(steps, ""))
    return paths.withColumn("pattern", F.when(F.size("entities") > 0, text).otherwise(""))


def retrieve(seed_names: DataFrame, lookup: DataFrame, graph_nodes: DataFrame, hops: DataFrame, chunks: DataFrame, max_hops: int = 2, max_paths: int = 20, max_facts: int = 30) -> dict[str, DataFrame]:
    """Paths, facts and evidence chunks of seeds named by id, name or alias.

    seed_names: (seed); blank ones give nothing. lookup: (identifier, canonical_id). Paths are
    searched once, as far as facts need them.
    """
    named = seed_names.withColumn("identifier", strip(F.col("seed"))).where("identifier <> ''")
    seeds = named.join(lookup, "identifier").join(graph_nodes.select("canonical_id", "canonical_name"), "canonical_id").select("seed", "canonical_id", "canonical_name")
    every = find_paths(seeds, hops, max_hops, max(max_paths, 2 * max_facts))
    return {"paths": every.where(F.col("path_rank") <= max_paths), "facts": find_facts(every, max_facts), "evidence_chunks": evidence_chunks(every, chunks, max_paths)}
