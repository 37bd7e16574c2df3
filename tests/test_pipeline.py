import __spark_entry__ as entry
from loomgraph import queries
from loomgraph.lexicon import default_lexicon
from loomgraph.operators import questions, vectors
from loomgraph.plans import pipeline
from loomgraph.sources import markdown
from loomgraph.sources.store import Store
from loomgraph.streaming.ingest import chunk_stream, upsert_stream


def test_ingest_and_execute(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.md").write_text("---\ntitle: Acme\ndocument_id: a\n---\n# Acme\n\nAcme Corp relies on Product Nova hosted in AWS. Product Nova depends on Identity Service.\n")
    (tmp_path / "in/b.md").write_text("# Idle\n\nIdentity Service supports OAuth 2.1. Acme Corp relies on Product Nova.\n")
    store = Store(spark, str(tmp_path / "store"))
    docs = markdown.load_directory(spark, str(tmp_path / "in"))
    g = pipeline.ingest(docs, store=store, dimension=64)
    edges = {(r.source_id, r.type, r.target_id): r.weight for r in g.edges.collect()}
    assert edges[("entity:customer:acme_corp", "DEPENDS_ON", "entity:product:nova")] == 1.5
    assert g.points.count() == g.chunks.count() == 2
    store.assert_unique("entities", ["canonical_id"])
    counts = pipeline.summary(pipeline.load(store)).first()
    assert (counts.documents_count, counts.chunks_count) == (2, 2) and counts.relationships_count == len(edges)
    # Ingesting the same files again changes nothing.
    again = pipeline.ingest(docs, store=store, dimension=64)
    assert {(r.source_id, r.type, r.target_id): r.weight for r in again.edges.collect()} == edges
    asked = spark.createDataFrame([("q1", "How does Acme Corp depend on Identity Service?"), ("q2", "What is the price of storage?")], "query_id string, query string")
    out = pipeline.execute(questions.analyze(asked, default_lexicon(spark)), again, dimension=64).collect()
    assert {r.query_id for r in out} == {"q1", "q2"}
    assert any(r.graph_rank for r in out if r.query_id == "q1") and not any(r.graph_rank for r in out if r.query_id == "q2")


def test_plans_keep_their_depth_and_filters(spark):
    def chunk(i):
        meta = {"title": "", "department": "Engineering" if i == 9 else "Legal", "version": "3.2", "section_title": "", "section_path": "", "access_tier": "Internal", "entity_hints": []}
        return (f"c{i}", "d", "rate limit report" + " more" * i, i, meta)

    shape = "title string, department string, version string, section_title string, section_path string, access_tier string, entity_hints array<string>"
    chunks = spark.createDataFrame([chunk(i) for i in range(10)], f"chunk_id string, document_id string, text string, index int, metadata struct<{shape}>")
    edge = "edge_seq long, source_id string, type string, target_id string, description string, weight double, evidence array<struct<chunk_id:string>>"
    edges = spark.createDataFrame([(n, a, "USES", b, None, 1.0, [(f"c{n}",)]) for n, (a, b) in enumerate(("AB", "BC", "CD"), 1)], edge)
    entities = spark.createDataFrame([(x, x, "OTHER", None) for x in "ABCD"], "canonical_id string, canonical_name string, primary_type string, description string")
    points = vectors.points(chunks, vectors.hash_embeddings(chunks, "chunk_id", "text", 64))
    g = pipeline.Graph(None, chunks, None, entities, None, edges, None, points)
    seed = [("A", "A", "A", "OTHER", 1.0)]
    rows = [(1, "x", "multi_hop", seed, 1, 1, {}), (2, "x", "multi_hop", seed, 2, 1, {}), (3, "x", "multi_hop", seed, 3, 1, {}), (4, "rate limit report", "vector", [], 1, 3, {"department": "Engineering"})]
    plan = "query_id int, query string, strategy string, seed_entities array<struct<raw_mention:string,canonical_id:string,canonical_name:string,entity_type:string,confidence:double>>, max_hops int, top_k int, filters map<string,string>"
    out = pipeline.execute(spark.createDataFrame(rows, plan), g, dimension=64).collect()
    by_graph = {q: {r.chunk_id for r in out if r.query_id == q and r.graph_rank} for q in (1, 2, 3)}
    assert by_graph == {1: {"c1"}, 2: {"c1", "c2"}, 3: {"c1", "c2", "c3"}}
    assert [r.chunk_id for r in out if r.query_id == 4] == ["c9"]


def test_stream_upserts_are_idempotent(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    one = spark.createDataFrame([("c1", "old", 1), ("c2", "x", 1)], "chunk_id string, text string, v int")
    two = spark.createDataFrame([("c1", "new", 2), (None, "y", 1)], "chunk_id string, text string, v int")
    for df in (one, two, two):
        df.write.mode("append").parquet(str(tmp_path / "in"))
        stream = chunk_stream(spark, str(tmp_path / "in"), one.schema)
        upsert_stream(stream, store, "chunks", ["chunk_id"], ["v"], str(tmp_path / "ckpt")).awaitTermination(120)
    assert sorted(tuple(r) for r in store.read("chunks").collect()) == [("c1", "new", 2), ("c2", "x", 1)]
    store.clear("chunks")
    assert not store.exists("chunks")


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(queries.ORACLE) <= set(queries.QUERIES)
