"""The property graph as tables: entities, documents, chunks, mentions and edges.

Edges are keyed by (source_id, target_id, type). Names, stubs and neighbour order are settled
once, when the graph is built, so that reading it takes plain joins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions.text import title_words, token_runs, tokens
from loomgraph.operators.resolution import merge_evidence, small
from loomgraph.schema import STRUCTURAL


def latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Upsert: the last row of each key by ``order``; rows with a null key are left out.

    One aggregation with partial results, no window: a much-repeated key is reduced before it
    is shuffled. Equal orders are settled by a hash of the row.
    """
    rest = [c for c in df.columns if c not in keys]
    flat = [c for c in rest if "map<" not in df.schema[c].dataType.simpleString()]
    picked = df.dropna(subset=keys).groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order, F.xxhash64(*flat) if flat else F.lit(0))).alias("r"))
    return picked.select(*keys, "r.*").select(*df.columns)


def entity_lookup(entities: DataFrame) -> DataFrame:
    """lookup_key -> canonical_id by lower-case name or alias; the last writer (by id) wins."""
    names = F.concat(F.array("canonical_name"), F.coalesce("aliases", F.array().cast("array<string>")))
    keys = entities.select("canonical_id", F.explode(names).alias("v")).where("v is not null")
    return keys.groupBy(F.lower("v").alias("lookup_key")).agg(F.max("canonical_id").alias("canonical_id"))


def find_entities(wanted: DataFrame, entities: DataFrame) -> DataFrame:
    """(identifier, canonical_id) of identifiers that are an id or a name or alias in any case."""
    by_id = wanted.join(entities.select("canonical_id"), F.col("identifier") == F.col("canonical_id")).select("identifier", "canonical_id", F.lit(0).alias("way"))
    by_name = wanted.join(entity_lookup(entities), F.lower("identifier") == F.col("lookup_key")).select("identifier", "canonical_id", F.lit(1).alias("way"))
    return by_id.unionByName(by_name).groupBy("identifier").agg(F.min_by("canonical_id", F.struct("way", "canonical_id")).alias("canonical_id"))


def part_of(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """(chunk_id, document_id) of chunks whose document exists."""
    known = documents.select("document_id").distinct()
    return chunks.select("chunk_id", "document_id").distinct().join(known, "document_id", "left_semi").select("chunk_id", "document_id")


def edges(relations: DataFrame, accumulate: bool = True) -> DataFrame:
    """Edges of relations (rel_seq, source_id, target_id, type, description, weight, evidence).

    Repeats of (source_id, target_id, type) are merged in the order of rel_seq: first
    description, evidence by chunk, and the sum of weights; with ``accumulate`` off the first
    weight plus 0.5 for each repeat, which loading the same relations again does not change.
    """
    keys = ["source_id", "target_id", "type"]
    r = relations.dropna(subset=keys)
    weight = F.sum("weight") if accumulate else F.min_by("weight", "rel_seq") + 0.5 * (F.count(F.lit(1)) - 1)
    head = r.groupBy(*keys).agg(F.min_by("description", "rel_seq").alias("description"), weight.alias("weight"), F.min("rel_seq").alias("edge_seq"))
    return head.join(merge_evidence(r.select(*keys, "rel_seq", "evidence"), keys), keys, "left")


def stub_entities(graph_edges: DataFrame, entities: DataFrame) -> DataFrame:
    """Entities that edges need and nobody described: type OTHER, named by their id."""
    ends = graph_edges.select(F.col("source_id").alias("canonical_id")).unionByName(graph_edges.select(F.col("target_id").alias("canonical_id"))).distinct()
    missing = ends.join(entities.select("canonical_id").distinct(), "canonical_id", "left_anti")
    tail = F.regexp_replace(F.element_at(F.split("canonical_id", ":"), -1), "_", " ")
    return missing.select("canonical_id", title_words(tail).alias("canonical_name"), F.lit("OTHER").alias("primary_type"))


def nodes(entities: DataFrame, graph_edges: DataFrame) -> DataFrame:
    """canonical_id, canonical_name, primary_type of all entities, stubs included."""
    own = entities.select("canonical_id", "canonical_name", "primary_type")
    return own.unionByName(stub_entities(graph_edges, entities))


def neighbours(graph_edges: DataFrame, graph_nodes: DataFrame, limit: int = 50, incoming: bool = True) -> DataFrame:
    """Up to ``limit`` neighbours of each entity, outgoing before incoming: node_id, ordinal,
    direction, source_id, source_name, relation, target_id, target_name, description, evidence.

    Structural edges do not count. Order: first edge to the other end, then the edge itself. The
    cap is part of the operator; ranks are pruned inside partitions before the shuffle. Without ``incoming``
    the outgoing ones alone, in the same places.
    """
    e = graph_edges.where(~F.col("type").isin(*STRUCTURAL))
    pair = Window.partitionBy("source_id", "target_id")
    e = e.withColumn("pair_seq", F.min("edge_seq").over(pair))
    out = e.withColumn("node_id", F.col("source_id")).withColumn("direction", F.lit("OUTGOING"))
    inc = e.withColumn("node_id", F.col("target_id")).withColumn("direction", F.lit("INCOMING"))
    # OUTGOING sorts after INCOMING, hence the descending order.
    rank = F.row_number().over(Window.partitionBy("node_id").orderBy(F.desc("direction"), "pair_seq", "edge_seq"))
    kept = (out.unionByName(inc) if incoming else out).withColumn("ordinal", rank).where(F.col("ordinal") <= limit)
    s = graph_nodes.select(F.col("canonical_id").alias("source_id"), F.col("canonical_name").alias("source_name"))
    t = graph_nodes.select(F.col("canonical_id").alias("target_id"), F.col("canonical_name").alias("target_name"))
    named = kept.join(s, "source_id", "left").join(t, "target_id", "left")
    return named.select(
        "node_id",
        "ordinal",
        "direction",
        "source_id",
        F.coalesce(F.when(F.col("source_name") != "", F.col("source_name")), "source_id").alias("source_name"),
        F.col("type").alias("relation"),
        "target_id",
        F.coalesce(F.when(F.col("target_name") != "", F.col("target_name")), "target_id").alias("target_name"),
        "description",
        "evidence",
    )


def stats(entities: DataFrame, documents: DataFrame, chunks: DataFrame, graph_edges: DataFrame) -> DataFrame:
    """entity_count, document_count, chunk_count, relationship_count in one row."""
    count = lambda df, k: df.agg(F.countDistinct(*k).alias("n"))
    e = nodes(entities, graph_edges).agg(F.countDistinct("canonical_id").alias("entity_count"))
    d = count(documents, ["document_id"]).withColumnRenamed("n", "document_count")
    c = count(chunks, ["chunk_id"]).withColumnRenamed("n", "chunk_count")
    r = count(graph_edges.where(~F.col("type").isin(*STRUCTURAL)), ["source_id", "target_id", "type"]).withColumnRenamed("n", "relationship_count")
    one = e
    for other in (d, c, r):
        one = one.join(F.broadcast(other))
    return one


def link_mentions(chunks: DataFrame, entities: DataFrame) -> DataFrame:
    """(chunk_id, canonical_id): chunks whose text holds a name or alias of an entity between
    non-alphanumeric characters, in any case.

    Token runs of texts meet token runs of names by equality (no pairwise matching); each
    meeting is then checked on the characters. Names without a letter or digit match nothing;
    null texts neither.
    """
    names = F.concat(F.array("canonical_name"), F.coalesce("aliases", F.array().cast("array<string>")))
    phrases = entities.select("canonical_id", F.explode(names).alias("name")).where("name <> ''").withColumn("run", F.array_join(tokens(F.col("name")), " ")).where("run <> ''").distinct()
    # Bounded by the tokens of the longest name.
    lengths = sorted(r["n"] for r in phrases.select(F.size(F.split("run", " ")).alias("n")).distinct().collect()) or [1]
    texts = chunks.where("text is not null").select("chunk_id", "text", tokens(F.col("text")).alias("tokens"))
    spoken = texts.select("chunk_id", "text", F.explode(token_runs(F.col("tokens"), lengths)).alias("run"))
    met = spoken.join(small(phrases), "run")
    # A name of one ASCII word that is its own run needs no further check.
    sure = (F.lower("name") == F.col("run")) & ~F.contains("run", F.lit(" ")) & F.col("run").rlike("^[a-z0-9]+$")
    pattern = F.concat(F.lit("(?<![a-zA-Z0-9])"), F.regexp_replace(F.lower("name"), r"([^\p{L}\p{N}\s_])", r"\\$1"), F.lit("(?![a-zA-Z0-9])"))
    return met.where(F.when(sure, F.lit(True)).otherwise(F.regexp_like(F.lower("text"), pattern))).select("chunk_id", "canonical_id").distinct()


def documents_of_chunks(chunks: DataFrame) -> DataFrame:
    """Documents as their first chunk describes them, where none are given."""
    m = F.struct(F.col("metadata.title").alias("title"), F.col("metadata.department").alias("department"), F.col("metadata.access_tier").alias("access_tier"), F.col("metadata.version").alias("version"))
    return chunks.where("document_id is not null").groupBy("document_id").agg(F.min_by(m, F.struct("index", "chunk_id")).alias("m")).select("document_id", "m.*")
