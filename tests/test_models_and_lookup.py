import pytest

from loomgraph.lexicon import default_lexicon
from loomgraph.operators import extraction, fusion, graph, orphans, questions, resolution, traversal, vectors
from loomgraph.session import ensure_checkpoint_dir
from loomgraph.sources import markdown
from loomgraph.sources.store import Store

LEX = "seq int, canonical_id string, canonical_name string, type string, description string, aliases array<string>"


def test_knowledge_base_and_lookup(spark):
    stored = spark.createDataFrame([("entity:other:zed", "Zed Unit", "OTHER", ["Zed", None]), ("entity:product:nova", "Nova Renamed", None, None), (None, "x", "OTHER", None)], "canonical_id string, canonical_name string, primary_type string, aliases array<string>")
    base = questions.knowledge_base(default_lexicon(spark), stored)
    asked = spark.createDataFrame([("entity:product:nova",), (" PRODUCT NOVA ",), ("nova",), ("zed",), ("Starter Tier",), ("ENTITY:PLAN:PRO",), ("nobody",), (None,), ("nova",)], "identifier string")
    got = {r.identifier: (r.canonical_id, r.entity_type, r.confidence) for r in questions.canonical_lookup(asked, base).collect()}
    assert got == {
        "entity:product:nova": ("entity:product:nova", "OTHER", 1.0), " PRODUCT NOVA ": ("entity:product:nova", "PRODUCT", 1.0), "nova": ("entity:product:nova", "PRODUCT", 0.95),
        "zed": ("entity:other:zed", "OTHER", 0.95), "Starter Tier": ("entity:plan:developer", "PLAN", 0.95), "ENTITY:PLAN:PRO": ("entity:plan:pro", "PLAN", 1.0),
    }
    q = spark.createDataFrame([(1, "What does the Zed unit do?")], "query_id int, query string")
    assert [e.canonical_id for e in questions.analyze(q, default_lexicon(spark), stored).first().seed_entities] == ["entity:other:zed"]


def test_overlapping_phrases(spark):
    rows = [(1, "a", "Data Plane", "OTHER", "", ["plane"]), (2, "b", "Plane Data Plane", "OTHER", "", []), (3, "c", "C++", "OTHER", "", ["北京", "naïve bay"])]
    lex = spark.createDataFrame(rows, LEX)
    asked = spark.createDataFrame([(1, "the plane data  plane and data plane; plane"), (2, "C++ in 在北京的 cafés, naïve  bay xplane"), (3, "aircplane"), (4, None)], "query_id int, query string")
    got = {r.query_id: [(e.raw_mention, e.canonical_id) for e in r.linked] for r in questions.link_entities(asked, questions.phrase_table(lex)).collect()}
    # Of an entity only its best stretch is listed.
    assert got == {1: [("plane data  plane", "b"), ("data plane", "a")], 2: [("naïve  bay", "c")], 3: [], 4: []}
    chunks = spark.createDataFrame([("x", "In 在北京的 street"), ("y", "beijing")], "chunk_id string, text string")
    assert [tuple(r) for r in graph.link_mentions(chunks, lex).collect()] == [("x", "c")]
    said = spark.createDataFrame([(1, "Office 北京 East", "OTHER", None, None)], "mention_seq int, name string, type string, description string, aliases array<string>")
    wide = spark.createDataFrame([(1, "c", "北京市", "OTHER", "", []), (2, "d", "Office 北京", "OTHER", "", [])], LEX)
    assert resolution.resolve_mentions(said, wide).first().record.canonical_id == "d"


def test_models_answer_and_rules_step_in(spark):
    chunks = spark.createDataFrame([("c1", "d", "Acme Corp uses Product Nova."), ("c2", "d", "Initech uses Product Orion."), ("c3", "d", None)], "chunk_id string, document_id string, text string")

    def entities(rows):
        return [[{"name": "Own Thing", "type": "concept", "description": "told", "aliases": None}] if r["chunk_id"] == "c1" else None for r in rows]

    def relations(rows):
        return [[{"source": "A", "target": "B", "type": "uses", "description": None, "sentence": "s", "confidence": 0.5}] if r["chunk_id"] == "c1" else None for r in rows]

    def broken(rows):
        raise RuntimeError("no answer")

    names = lambda m: {(r.chunk_id, r.name) for r in extraction.extract_entities(chunks, model=m).collect()}
    rules = names(None)
    assert names(broken) == rules and names(lambda rows: []) == rules
    assert names(entities) == {("c1", "Own Thing"), *(x for x in rules if x[0] == "c2")}
    told = lambda m: {(r.chunk_id, r.source_id, r.type, r.evidence[0].confidence) for r in extraction.extract_relations(chunks, model=m).collect()}
    rules = told(None)
    assert ("c2", "entity:initech", "USES", 0.9) in rules and told(broken) == rules
    assert told(relations) == {("c1", "entity:a", "USES", 0.5), *(x for x in rules if x[0] == "c2")}
    linked = questions.link_entities(spark.createDataFrame([(1, "What is Product Nova?"), (2, "Compare Product Nova and Product Orion.")], "query_id int, query string"), questions.phrase_table(default_lexicon(spark)))
    intents = lambda m: {r.query_id: r.intent for r in questions.plan_questions(linked, m).collect()}
    assert intents(broken) == intents(None) == {1: "ENTITY_LOOKUP", 2: "COMPARISON"}
    assert intents(lambda rows: [" global " if len(r["linked"]) == 1 else "nonsense" for r in rows]) == {1: "GLOBAL", 2: "COMPARISON"}


def test_relations_of_a_sentence(spark):
    rows = [
        ("c1", "Alpha relies on Beta and Gamma. Alpha relies on Beta."), ("c2", "Alpha (Beta) uses C++ Core; gamma."), ("c3", "Alphabet uses Beta"), ("c4", "Alpha, Alpha; Beta"),
        ("c5", "Alpha Beta Gamma"), ("c5", "Alpha Beta Gamma"), ("c6", None),
    ]
    df = spark.createDataFrame([(c, "d", t, ["Alpha", "Beta", "Gamma", "C++ Core", "Alpha Beta"]) for c, t in rows], "chunk_id string, document_id string, text string, names array<string>")
    got = sorted((r.chunk_id, r.pos, r.id) for r in extraction.extract_relations(df, names=df["names"]).collect())
    assert got == [
        ("c1", 0, "rel:alpha:depends_on:beta"), ("c1", 1, "rel:alpha:depends_on:gamma"), ("c1", 2, "rel:beta:related_to:gamma"),
        ("c2", 0, "rel:alpha:related_to:beta"), ("c2", 1, "rel:beta:uses:c_core"), ("c2", 2, "rel:beta:uses:gamma"), ("c2", 3, "rel:c_core:related_to:gamma"),
        ("c4", 0, "rel:alpha:related_to:beta"), ("c5", 0, "rel:alpha_beta:related_to:gamma"),
    ]


def test_dimension_and_filtered_retrieval(spark):
    chunks = [(f"c{i}", "rate limit of the gateway" if i % 2 else "holiday plans", "Legal" if i < 3 else "Sales", f"d{i % 3}", ["x", "y"] if i == 5 else None) for i in range(6)]
    df = spark.createDataFrame(chunks, "chunk_id string, text string, department string, document_id string, entity_hints array<string>")
    points = df.join(vectors.hash_embeddings(df, "chunk_id", "text", 64), "chunk_id")
    q = [(1, "gateway rate limit", None, None), (2, " ", None, None), (3, "gateway rate limit", "d1", None), (4, "gateway rate limit", "d1", {"document_id": "d2", "department": "Sales"}), (5, "rate limit", None, {"entity_hints": "y", "department": ""}), (6, "gateway", None, {"department": "None"})]
    asked = spark.createDataFrame(q, "query_id int, query string, document_id string, filters map<string,string>")
    got: dict[int, list] = {}
    for r in vectors.retrieve(asked, points, 2, 64).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.chunk_id)
    assert got == {1: ["c1", "c3"], 3: ["c1", "c4"], 4: ["c5"], 5: ["c5"]}
    assert vectors.check_dimension(points, "vector", 64).count() == 6
    with pytest.raises(Exception, match="expected 65 dimensions"):
        vectors.check_dimension(points, "vector", 65).count()


def test_search_batch_equals_brute_force(spark):
    import random

    own = random.Random(2)
    rows = [(i, [own.choice([-1.0, 0.0, 0.5, 1.0]) for _ in range(4)]) for i in range(60)] + [(60, None), (61, [0.0] * 4)]
    df = spark.createDataFrame(rows, "id int, v array<float>")
    got: dict[int, list] = {}
    for r in vectors.search_batch(df, "id", "v", df.withColumnRenamed("id", "p"), "p", "v", 7, block=9).orderBy("id", "rank").collect():
        got.setdefault(r.id, []).append(r.p)
    size = lambda v: sum(x * x for x in v) ** 0.5
    good = [(i, v) for i, v in rows if v and size(v)]
    cos = lambda a, b: round(sum(x * y for x, y in zip(a, b)) / size(a) / size(b), 9)
    assert got == {i: [j for j, w in sorted(good, key=lambda x: (-cos(v, x[1]), x[0]))[:7]] for i, v in good}
    assert vectors.search_batch(df.limit(0), "id", "v", df.withColumnRenamed("id", "p"), "p", "v").count() == 0


def test_index_with_all_lists_is_exact(spark):
    import random

    own = random.Random(5)
    rows = [(i, [own.choice([-1.0, 0.0, 0.5, 1.0]) for _ in range(4)]) for i in range(90)] + [(90, None), (91, [0.0] * 4)]
    df = spark.createDataFrame(rows, "id int, v array<float>")
    points = df.withColumnRenamed("id", "p")
    centroids = vectors.fit_lists(points, "p", "v", 6)
    index = vectors.build_index(points, "p", "v", centroids, rows_per_block=7)
    exact = {tuple(r) for r in vectors.search_batch(df, "id", "v", points, "p", "v", 5).collect()}
    assert {tuple(r) for r in vectors.search_index(df, "id", "v", index, centroids, "p", 5, probes=6).collect()} == exact
    some = {tuple(r)[:3:2] for r in vectors.search_index(df, "id", "v", index, centroids, "p", 5, probes=3).collect()}
    assert some and len({p for _, p in some}) <= 90
    assert index.count() == sum(1 for _, v in rows if v and any(v))
    none = vectors.fit_lists(points.limit(0), "p", "v")
    assert vectors.search_index(df, "id", "v", vectors.build_index(points.limit(0), "p", "v", none), none, "p").count() == 0


def test_composite_references(spark):
    refs = spark.createDataFrame([(1, "d1", "c1"), (2, "d1", "c9"), (3, None, "c1"), (4, None, "c9"), (5, " ", ""), (6, "D1 ", "c2"), (6, "D1 ", "c2")], "cit_seq int, document_id string, chunk_id string")
    chunks = spark.createDataFrame([("d1", "c1", 1), ("d2", "c2", 2)], "document_id string, chunk_id string, cit_seq int")
    got = {m: sorted(r.cit_seq for r in orphans.composite_orphans(refs, chunks, m).collect()) for m in orphans.MATCHES}
    assert got == {"simple": [2, 6], "partial": [2, 4, 6], "full": [2, 3, 4, 6]}


def test_upserts_touch_only_hit_buckets(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    row = lambda k, v: spark.createDataFrame([(k, v, v)], "k string, v int, extra int")
    store.write("t", spark.createDataFrame([(f"k{i}", 1) for i in range(40)], "k string, v int"))
    store.upsert("t", row("k3", 2), ["k"], ["v"])
    before = store._buckets("t")
    store.upsert("t", row("k3", 3), ["k"], ["v"])
    store.upsert("t", row("k3", 1), ["k"], ["v"])
    after = store._buckets("t")
    assert sum(before[n] != after[n] for n in before) == 1
    got = {r.k: (r.v, r.extra) for r in store.read("t").collect()}
    assert len(got) == 40 and got["k3"] == (3, 3) and got["k4"] == (1, None)
    store.write("t", row("z", 1))
    assert [r.k for r in store.read("t").collect()] == ["z"]


def test_directory_order(spark, tmp_path):
    for n in ("b", "a", "c"):
        (tmp_path / f"{n}.md").write_text(f"# {n}\n\nText\n")
    assert [(r.document_id, r.doc_seq) for r in markdown.load_directory(spark, str(tmp_path)).orderBy("doc_seq").collect()] == [("a", 1), ("b", 2), ("c", 3)]


def test_communities_end_when_nothing_changes(spark):
    e = spark.createDataFrame([("a", "b", 2.0), ("b", "c", 2.0), ("a", "c", 2.0), ("x", "y", None), ("z", "z", 1.0)], "source_id string, target_id string, weight double")
    got = [{r.canonical_id: r.community_id for r in fusion.communities(e, n).collect()} for n in (4, 40)]
    assert set(got[0]) == set("abcxy") and got[1]["a"] == got[1]["b"] == got[1]["c"]


def test_paths_of_three_hops(spark):
    edges = spark.createDataFrame([(a, 1, "USES", b, b.upper(), [f"{a}{b}"]) for a, b in ("ab", "bc", "cd", "da")], "hop_from string, hop_ord int, hop_rel string, hop_to string, hop_name string, hop_ev array<string>")
    seeds = spark.createDataFrame([("s", "a", "A")], "seed string, canonical_id string, canonical_name string")
    got = {r.explanation: r.evidence_chunk_ids for r in traversal.find_paths(seeds, edges, 5, 20).collect()}
    assert got == {"A -> B": ["ab"], "A -> B -> C": ["ab", "bc"], "A -> B -> C -> D": ["ab", "bc", "cd"]}


def test_a_cluster_needs_a_shared_folder():
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Conf:
        def get(self, name, default):
            return default

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        ensure_checkpoint_dir(Session())
