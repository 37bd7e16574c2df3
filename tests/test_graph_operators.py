import hashlib
import re
import uuid

import pytest
from pyspark.sql import functions as F

from loomgraph.operators import fusion, graph, traversal, vectors

EDGE = "rel_seq long, source_id string, target_id string, type string, description string, weight double, evidence array<struct<chunk_id:string,document_id:string,text:string,confidence:double>>"
NAMES = {"acme": "Acme Corp", "nova": "Product Nova", "idp": "Identity Service", "oauth": "OAuth 2.1"}


def ev(*ids):
    return [(c, "d", "t", 0.9) for c in ids]


@pytest.fixture(scope="module")
def cycle(spark):
    rel = spark.createDataFrame(
        [(1, "acme", "nova", "USES", "", 1.0, ev("chunk_01")), (2, "nova", "idp", "DEPENDS_ON", "", 1.0, ev("chunk_02")), (3, "idp", "oauth", "INTEGRATES_WITH", "", 1.0, ev("chunk_03")), (4, "oauth", "acme", "RELATED_TO", "", 1.0, ev("chunk_03"))], EDGE)
    ents = spark.createDataFrame([(k, v, "OTHER", [v + "!"]) for k, v in NAMES.items()], "canonical_id string, canonical_name string, primary_type string, aliases array<string>")
    e = graph.edges(rel)
    return ents, e, graph.neighbours(e, graph.nodes(ents, e))


def seeds(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "seed string")


@pytest.mark.parametrize("hops,count", [(1, 1), (2, 2), (3, 3), (5, 3)])
def test_paths_of_a_cycle(spark, cycle, hops, count):
    start = spark.createDataFrame([("s", "acme", "Acme Corp")], "seed string, canonical_id string, canonical_name string")
    rows = traversal.find_paths(start, traversal.outgoing(cycle[2]), hops).orderBy("path_rank").collect()
    assert len(rows) == count
    assert all(len(set(r.entities)) == len(r.entities) for r in rows)
    assert [r.score for r in rows] == [1.0, 0.8, 0.667][:count]


def test_retrieve(spark, cycle):
    ents, e, near = cycle
    chunks = spark.createDataFrame([("chunk_02", "d", "two")], "chunk_id string, document_id string, text string")
    asked = seeds(spark, " Acme corp ", "nobody", "  ")
    lookup = graph.find_entities(spark.createDataFrame([("Acme corp",), ("nobody",)], "identifier string"), ents)
    out = traversal.retrieve(asked, lookup, graph.nodes(ents, e), traversal.outgoing(near), chunks)
    assert [r.pattern for r in traversal.render(out["paths"]).orderBy("path_rank").collect()] == ["(Acme Corp)-[:USES]->(Product Nova)", "(Acme Corp)-[:USES]->(Product Nova)-[:DEPENDS_ON]->(Identity Service)"]
    facts = out["facts"].orderBy("fact_rank").collect()
    assert [(f.source_name, f.target_name, f.evidence_chunk_id, f.confidence) for f in facts] == [("Acme Corp", "Product Nova", "chunk_01", 1.0), ("Product Nova", "Identity Service", "chunk_01", 0.8)]
    # The first chunk is missing, so its rank is.
    assert [(r.rank, r.chunk_id) for r in out["evidence_chunks"].collect()] == [(2, "chunk_02")]


def test_names_block_paths(spark):
    rel = spark.createDataFrame([(1, "a", "b", "USES", "", 1.0, []), (2, "b", "c", "USES", "", 1.0, []), (3, "a", "d", "PART_OF", "", 1.0, [])], EDGE)
    ents = spark.createDataFrame([("a", "Same", "OTHER", []), ("b", "B", "OTHER", []), ("c", "Same", "OTHER", [])], "canonical_id string, canonical_name string, primary_type string, aliases array<string>")
    e = graph.edges(rel)
    near = graph.neighbours(e, graph.nodes(ents, e))
    start = spark.createDataFrame([("s", "a", "Same")], "seed string, canonical_id string, canonical_name string")
    rows = traversal.find_paths(start, traversal.outgoing(near), 3).collect()
    assert [r.entities for r in rows] == [["Same", "B"]]


HOPS = "hop_from string, hop_ord int, hop_rel string, hop_to string, hop_name string, hop_ev array<string>"


def walks(starts, hops, max_hops, max_paths):
    """seed -> its first paths as (ordinals, entities), one by one."""
    out, level = {}, [(s, at, (), (name,)) for s, at, name in starts]
    for _ in range(max_hops):
        level = [(s, h[3], o + (h[1],), e + (h[4],)) for s, at, o, e in level for h in hops if h[0] == at and h[4] not in e and h[3] not in e]
        for s, _at, o, e in level:
            out.setdefault(s, []).append((o, e))
    return {s: sorted(x, key=lambda p: (len(p[0]), p[0]))[:max_paths] for s, x in out.items()}


@pytest.mark.parametrize("max_hops,max_paths", [(1, 3), (3, 12), (3, 45), (4, 90), (5, 1000)])
def test_paths_equal_all_walks_in_order(spark, max_hops, max_paths):
    # Hubs, several edges between two nodes, a name of two nodes, a name that is an id, a loop.
    name = {5: "N4", 6: "n1"}
    ends = {0: [1, 1, 1, 2, 3, 4, 5, 6, 7], 1: [0, 0, 1, 2, 3, 5, 8], 2: [0, 1], 3: [1], 4: [0, 8], 5: [2], 6: [0, 1, 4], 8: [9], 9: [0]}
    hops = [(f"n{a}", i + 1, f"R{i + 1}", f"n{b}", name.get(b, f"N{b}"), [f"c{a}", f"c{b}"]) for a, bs in ends.items() for i, b in enumerate(bs)]
    starts = [(f"s{i}", f"n{i}", name.get(i, f"N{i}")) for i in range(10)]
    # A seed and a hop that are there twice, under two names.
    starts.append(("s3", "n3", "Twice"))
    hops.append(("n3", 1, "R1", "n1", "Other", []))
    frames = spark.createDataFrame(starts, "seed string, canonical_id string, canonical_name string"), spark.createDataFrame(hops, HOPS)
    rows = traversal.find_paths(*frames, max_hops, max_paths).orderBy("seed", "path_rank").collect()
    want = walks(starts, hops, max_hops, max_paths)
    assert {(r.seed, r.path_rank) for r in rows} == {(s, i + 1) for s, x in want.items() for i in range(len(x))} and len(rows) == sum(map(len, want.values()))
    assert [(r.seed, r.relationships) for r in rows] == [(s, [f"R{o}" for o in p[0]]) for s in sorted(want) for p in want[s]]
    known = {s: set(p[1] for p in x) for s, x in walks(starts, hops, max_hops, 10**6).items()}
    assert all(tuple(r.entities) in known[r.seed] for r in rows)
    if max_paths == 1000:
        assert {s: sorted(p[1] for p in x) for s, x in want.items()} == {s: sorted(tuple(r.entities) for r in rows if r.seed == s) for s in want}


def test_paths_beyond_the_first_are_not_stored(spark, tmp_path):
    # 14 nodes that all know each other have 24,024 walks of three hops, of which 434 are asked for.
    spark.sparkContext.setCheckpointDir(f"file://{tmp_path}")
    hops = [(f"n{a}", b + 1, "R", f"n{b}", f"Name {b}", ["chunk"]) for a in range(14) for b in range(14) if a != b]
    start = spark.createDataFrame([(f"s{i}", f"n{i}", f"Name {i}") for i in range(14)], "seed string, canonical_id string, canonical_name string")
    rows = traversal.find_paths(start, spark.createDataFrame(hops, HOPS), 3, 200).collect()
    assert len(rows) == 14 * 200 and sum(r.length == 3 for r in rows) == 14 * (200 - 13 - 13 * 12)
    assert sum(p.stat().st_size for p in tmp_path.rglob("*") if p.is_file()) < 500_000


def test_neighbours_are_capped_in_order(spark):
    rows = [(i, "hub", f"t{i % 60}", f"R{i // 60}", "", 1.0, []) for i in range(70)] + [(99, "x", "hub", "USES", "", 1.0, [])]
    e = graph.edges(spark.createDataFrame(rows, EDGE))
    ents = spark.createDataFrame([("hub", "Hub", "OTHER", None)], "canonical_id string, canonical_name string, primary_type string, aliases array<string>")
    out = graph.neighbours(e, graph.nodes(ents, e)).where("node_id = 'hub'").orderBy("ordinal").collect()
    assert len(out) == 50 and all(r.direction == "OUTGOING" for r in out)
    # Both edges to t0 come first, as that is the first target met.
    assert [(r.target_id, r.relation) for r in out[:3]] == [("t0", "R0"), ("t0", "R1"), ("t1", "R0")]
    assert out[0].target_name == "T0"


def test_edges_merge_evidence(spark):
    rel = spark.createDataFrame([(1, "a", "b", "USES", "one", 1.0, ev("c1")), (2, "a", "b", "USES", "two", 1.0, ev("c1", "c2")), (3, "a", None, "USES", "", 1.0, [])], EDGE)
    one = graph.edges(rel).first()
    assert (one.description, one.weight, [x.chunk_id for x in one.evidence]) == ("one", 2.0, ["c1", "c2"])
    assert graph.edges(rel, accumulate=False).first().weight == 1.5


def test_mention_links_respect_boundaries(spark):
    chunks = spark.createDataFrame([("1", "The renovation process"), ("2", "PRO-Plan by OAuth 2.1, Nova!"), ("3", None), ("4", "oauth  2.1")], "chunk_id string, text string")
    ents = spark.createDataFrame([("pro", "Pro", ["Pro Plan", ""]), ("nova", "Nova", None), ("oauth", "OAuth 2.1", []), ("none", None, [None])], "canonical_id string, canonical_name string, aliases array<string>")
    assert {tuple(r) for r in graph.link_mentions(chunks, ents).collect()} == {("2", "pro"), ("2", "nova"), ("2", "oauth")}


def test_stats_and_upsert(spark, cycle):
    ents, e, _ = cycle
    docs = spark.createDataFrame([("d", 1), ("d", 2)], "document_id string, v int")
    chunks = spark.createDataFrame([("c",), ("c",)], "chunk_id string")
    assert tuple(graph.stats(ents, docs, chunks, e).first()) == (4, 1, 1, 4)
    assert [tuple(r) for r in graph.latest(docs, ["document_id"], ["v"]).collect()] == [("d", 2)]


def reference_weights(text, d):
    if not (text or "").strip():
        return {0: 100}
    low, out = text.lower(), {}
    pieces = [(w, 200 if len(w) > 5 else 100) for w in re.findall(r"\b\w+\b", low)] + [(low[i : i + 3], 35) for i in range(len(low) - 2)]
    for p, w in pieces:
        h = int(hashlib.md5(p.encode()).hexdigest(), 16)
        out[h % d] = out.get(h % d, 0) + (w if h % 2 == 0 else -w)
    return {k: v for k, v in out.items() if v}


def test_hash_embeddings(spark):
    texts = ["OAuth 2.1 requires PKCE", "café naïve übergroß", "ab", "", None, "  "]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    for d in (1536, 77):
        got = {}
        for r in vectors.hash_weights(df, "i", "t", d).collect():
            got.setdefault(r.i, {})[r.idx] = r.weight
        assert got == {i: reference_weights(t, d) for i, t in enumerate(texts)}
    dense = {r.i: r.vector for r in vectors.hash_embeddings(df, "i", "t", 64).collect()}
    assert all(abs(sum(x * x for x in v) - 1) < 1e-5 for v in dense.values()) and dense[3][0] == 1.0


def test_points(spark):
    df = spark.createDataFrame([("chunk_é_001",), ("x",)], "c string").withColumn("p", vectors.point_id(F.col("c")))
    assert all(r.p == str(uuid.uuid5(uuid.NAMESPACE_DNS, r.c)) for r in df.collect())
    twice = df.withColumnRenamed("p", "point_id")
    assert vectors.upsert_points(twice, twice.unionByName(twice)).count() == 2


def test_search(spark):
    rows = [(1, [1.0, 0.0], "a", ["x"]), (2, [0.6, 0.8], "a", []), (3, [0.0, 1.0], "b", ["x"]), (4, [0.0, 0.0], "a", []), (5, None, "a", [])]
    t = spark.createDataFrame(rows, "id int, v array<float>, tier string, hints array<string>")
    got = vectors.search(t, [1.0, 0.0], "id", "v", 2).orderBy("rank").collect()
    assert [(r.id, r.rank, round(r.score, 3)) for r in got] == [(1, 1, 1.0), (2, 2, 0.6)]
    assert [r.id for r in vectors.search(t, [1.0, 0.0], "id", "v", 5, {"tier": "b", "hints": "x", "other": None}).collect()] == [3]
    q = spark.createDataFrame([(7, [0.0, 1.0]), (8, None)], "q int, w array<float>")
    assert [(r.q, r.id) for r in vectors.search_batch(q, "q", "w", t, "id", "v", 1).collect()] == [(7, 3)]


def test_fusion_and_communities(spark):
    a = spark.createDataFrame([("x", 1), ("y", 2), ("x", 5)], "k string, rank int")
    b = spark.createDataFrame([("y", 1)], "k string, rank int")
    out = {r.k: r.rrf_score for r in fusion.reciprocal_rank_fusion({"vector": a, "graph": b}, ["k"]).collect()}
    assert out["x"] == pytest.approx(0.5 / 61) and out["y"] == pytest.approx(0.5 / 62 + 0.3 / 61)
    e = spark.createDataFrame([("a", "b", 1.0), ("b", "c", 1.0), ("a", "c", 1.0), ("p", "q", 1.0)], "source_id string, target_id string, weight double")
    got = {r.canonical_id: r.community_id for r in fusion.communities(e).collect()}
    assert got["a"] == got["b"] == got["c"] and got["p"] not in (got["a"],)
