"""Command line: ingest a folder of Markdown files, search it, traverse it, analyse questions."""

from __future__ import annotations

import argparse

from loomgraph.lexicon import default_lexicon
from loomgraph.operators import graph, questions, traversal, vectors
from loomgraph.plans import pipeline
from loomgraph.session import build_session
from loomgraph.settings import get_settings
from loomgraph.sources.markdown import load_directory
from loomgraph.sources.store import Store


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="loomgraph")
    p.add_argument("--store", default="loomgraph-store")
    sub = p.add_subparsers(dest="command", required=True)
    one = sub.add_parser("ingest")
    one.add_argument("folder")
    one = sub.add_parser("search")
    one.add_argument("query")
    one.add_argument("--top-k", type=int, default=get_settings().top_k_chunks)
    one.add_argument("--document-id")
    one.add_argument("--access-tier")
    one = sub.add_parser("traverse")
    one.add_argument("entity")
    one.add_argument("--max-hops", type=int, default=get_settings().max_hops)
    one.add_argument("--max-paths", type=int, default=get_settings().max_paths)
    one = sub.add_parser("analyze")
    one.add_argument("question")
    sub.add_parser("stats")
    a = p.parse_args(argv)

    spark = build_session()
    spark.sparkContext.setLogLevel("ERROR")
    store = Store(spark, a.store)
    if a.command == "ingest":
        pipeline.summary(pipeline.ingest(load_directory(spark, a.folder), store=store)).show(truncate=False)
    elif a.command == "search":
        asked = spark.createDataFrame([(0, a.query)], "id int, query string")
        vector = vectors.hash_embeddings(asked, "id", "query", get_settings().embedding_dimension).first()["vector"]
        filters = {"document_id": a.document_id, "access_tier": a.access_tier}
        vectors.search(store.read("points"), vector, "chunk_id", "vector", a.top_k, filters).select("rank", "score", "chunk_id", "text").orderBy("rank").show(truncate=100)
    elif a.command == "traverse":
        entities, edges = store.read("entities"), store.read("edges")
        nodes = graph.nodes(entities, edges)
        named = spark.createDataFrame([(a.entity,)], "seed string")
        lookup = graph.find_entities(named.withColumnRenamed("seed", "identifier"), entities)
        found = traversal.retrieve(named, lookup, nodes, traversal.outgoing(graph.neighbours(edges, nodes)), store.read("chunks"), a.max_hops, a.max_paths)
        traversal.render(found["paths"]).orderBy("path_rank").select("path_rank", "score", "pattern").show(truncate=False)
        found["facts"].orderBy("fact_rank").show(truncate=False)
        found["evidence_chunks"].orderBy("rank").select("rank", "chunk_id", "text").show(truncate=100)
    elif a.command == "analyze":
        asked = spark.createDataFrame([("q", a.question)], "query_id string, query string")
        questions.analyze(asked, default_lexicon(spark)).show(truncate=False, vertical=True)
    else:
        graph.stats(store.read("entities"), store.read("documents"), store.read("chunks"), store.read("edges")).show()


if __name__ == "__main__":
    main()
