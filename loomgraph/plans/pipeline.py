"""The ingest pipeline (documents to graph and vectors) and the execution of retrieval plans."""

from __future__ import annotations

import warnings
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.lexicon import ENTITY_RULES, RELATION_CUES, default_lexicon
from loomgraph.operators import chunking, extraction, fusion, graph, questions, resolution, traversal, vectors
from loomgraph.settings import Settings, get_settings
from loomgraph.sources.store import Store

TABLES = ("documents", "chunks", "entity_mentions", "entities", "relationships", "edges", "mentions", "points")


@dataclass(frozen=True)
class Graph:
    """The tables of an ingested corpus."""

    documents: DataFrame
    chunks: DataFrame
    entity_mentions: DataFrame
    entities: DataFrame
    relationships: DataFrame
    edges: DataFrame
    mentions: DataFrame
    points: DataFrame


def ingest(docs: DataFrame, lexicon: DataFrame | None = None, settings: Settings | None = None, rules=ENTITY_RULES, cues=RELATION_CUES, extractor=None, entity_model=None, relation_model=None, dimension: int | None = None, store: Store | None = None) -> Graph:
    """Tables of parsed documents (see ``sources.markdown``).

    With a store each table is written as soon as it is made, and the next ones read it; without
    one, all tables are parts of one lazy plan, for small inputs.

    extractor: replaces the entity rules by a function of the chunks that gives the columns of
    ``extraction.extract_entities``; if it raises, the rules are used. entity_model, relation_model: see
    ``extraction``.
    """
    s = settings or get_settings()
    lex = lexicon if lexicon is not None else default_lexicon(docs.sparkSession)
    keep = store.write if store else lambda name, df: df
    docs = keep("documents", docs)
    chunks = keep("chunks", chunking.chunk_documents(docs, s))
    found = extraction.extract_entities(chunks, rules, entity_model)
    if extractor:
        try:
            found = extractor(chunks)
        except Exception as error:
            warnings.warn(f"entity extractor failed, rules are used: {error}", stacklevel=2)
    # Mentions are ordered by document, chunk and place.
    seq = F.concat_ws("#", "document_id", "chunk_id", F.format_string("%09d", "pos"))
    mentions = keep("entity_mentions", found.withColumn("mention_seq", seq))
    entities = keep("entities", resolution.canonical_entities(mentions, lex))
    raw = extraction.extract_relations(chunks, rules, cues, model=relation_model)
    raw = raw.withColumn("rel_seq", F.concat_ws("#", "chunk_id", F.format_string("%09d", "pos")))
    relationships = keep("relationships", resolution.resolve_relations(raw, lex, entities))
    edges = keep("edges", graph.edges(relationships.withColumn("rel_seq", F.col("first_seq")), accumulate=False))
    linked = keep("mentions", graph.link_mentions(chunks, entities))
    vec = vectors.hash_embeddings(chunks.select("chunk_id", "text"), "chunk_id", "text", dimension or s.embedding_dimension)
    return Graph(docs, chunks, mentions, entities, relationships, edges, linked, keep("points", vectors.points(chunks, vec)))


def load(store: Store) -> Graph:
    """The tables of an earlier ingest."""
    return Graph(**{name: store.read(name) for name in TABLES})


def summary(g: Graph) -> DataFrame:
    """Counts of an ingest in one row."""
    parts = {
        "documents": g.documents, "chunks": g.chunks, "entity_mentions": g.entity_mentions, "entities": g.entities, "relationships": g.relationships, "mention_links": g.mentions,
        "points": g.points,
    }
    one = None
    for name, df in parts.items():
        n = df.agg(F.count(F.lit(1)).alias(f"{name}_count"))
        one = n if one is None else one.join(F.broadcast(n))
    return one


def _vector_list(plans: DataFrame, g: Graph, dimension: int) -> DataFrame:
    """(query_id, chunk_id, rank, score) of the plans' questions under their filters, within each
    plan's top_k. Blank questions are asked by no plan."""
    widest = max(p[0] for p in questions.INTENT_PLAN.values())
    best = vectors.retrieve(plans.select("query_id", "query", "filters"), g.points, widest, dimension)
    return best.join(plans.select("query_id", "top_k"), "query_id").where(F.col("rank") <= F.col("top_k")).drop("top_k")


def execute(plans: DataFrame, g: Graph, settings: Settings | None = None, dimension: int | None = None) -> DataFrame:
    """Results of retrieval plans: query_id, chunk_id, vector_rank, graph_rank, rrf_score.

    vector plans use the vector list only, multi_hop and global ones the graph list too, and all
    lists are fused by reciprocal rank. Plans of equal max_hops share one search of that depth.
    """
    s = settings or get_settings()
    vector = _vector_list(plans, g, dimension or s.embedding_dimension)
    own = plans.where(F.col("strategy") != "vector").select("query_id", "max_hops", F.explode("seed_entities").alias("e"))
    seeds = own.select("max_hops", F.concat_ws("\x01", "query_id", "e.canonical_id").alias("seed"), F.col("e.canonical_id").alias("canonical_id"), F.col("e.canonical_name").alias("canonical_name"))
    near = graph.neighbours(g.edges, graph.nodes(g.entities, g.edges), s.fan_out)
    paths = None
    # Plans without a depth of their own take that of the settings; at most five depths.
    deep = seeds.withColumn("max_hops", F.coalesce("max_hops", F.lit(s.max_hops)))
    for depth in sorted(r["max_hops"] for r in deep.select("max_hops").distinct().collect()) or [s.max_hops]:
        found = traversal.find_paths(deep.where(F.col("max_hops") == depth), traversal.outgoing(near), depth, s.max_paths)
        paths = found if paths is None else paths.unionByName(found)
    ev = traversal.evidence_chunks(paths, g.chunks, s.max_paths)
    id_type = plans.schema["query_id"].dataType
    by_graph = ev.select(F.substring_index("seed", "\x01", 1).cast(id_type).alias("query_id"), "chunk_id", "rank").groupBy("query_id", "chunk_id").agg(F.min("rank").alias("rank"))
    return fusion.reciprocal_rank_fusion({"vector": vector, "graph": by_graph}, ["query_id", "chunk_id"], s)
