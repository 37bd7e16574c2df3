"""Named queries over a data directory, and the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph import oracles
from loomgraph.functions import text
from loomgraph.functions.text import quote
from loomgraph.operators import chunking, extraction, fusion, graph, orphans, questions, resolution, traversal, vectors
from loomgraph.plans import pipeline
from loomgraph.session import Scratch, cut, table
from loomgraph.sources import markdown
from loomgraph.sources.store import Store
from loomgraph.streaming.ingest import chunk_stream, mentions_per_window, upsert_stream

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def p1_found(spark, d):
    return orphans.found_orphans(
        *(table(spark, d, t) for t in ("relationships", "graph_facts", "citations", "entities", "lexicon", "chunks"))
    )


def _composite(match):
    return lambda spark, d: orphans.composite_orphans(table(spark, d, "citations"), table(spark, d, "chunks"), match)


for _match in orphans.MATCHES:
    QUERIES[f"p1_composite_{_match}"] = _composite(_match)


@query
def p1_report(spark, d):
    return orphans.orphan_report(p1_found(spark, d))


P1_FOUND_SQL = r"""
WITH refs AS (
  SELECT 'relationships' AS ref_table, 'source_id' AS ref_field, rel_seq AS row_seq, recorded_at AS t,
         lower(trim(source_id, E' \t\n\r')) AS k, 'e' AS side FROM relationships
  UNION ALL SELECT 'relationships', 'target_id', rel_seq, recorded_at, lower(trim(target_id, E' \t\n\r')), 'e' FROM relationships
  UNION ALL SELECT 'graph_facts', 'evidence_chunk_id', fact_seq, recorded_at, lower(trim(evidence_chunk_id, E' \t\n\r')), 'c' FROM graph_facts
  UNION ALL SELECT 'citations', 'chunk_id', cit_seq, cited_at, lower(trim(chunk_id, E' \t\n\r')), 'c' FROM citations
), lives AS (
  SELECT lower(trim(canonical_id, E' \t\n\r')) AS k, ingested_at AS f, deleted_at AS u, 'e' AS side FROM entities
  UNION ALL SELECT lower(trim(canonical_id, E' \t\n\r')), TIMESTAMP '0001-01-01', NULL, 'e' FROM lexicon
  UNION ALL SELECT lower(trim(chunk_id, E' \t\n\r')), ingested_at, deleted_at, 'c' FROM chunks
), found AS (
  SELECT DISTINCT ref_table, ref_field, row_seq, strftime(t, '%Y-%m') AS period FROM refs r
  WHERE k IS NOT NULL AND k <> '' AND NOT EXISTS (
    SELECT 1 FROM lives l WHERE l.side = r.side AND l.k = r.k AND l.f <= r.t AND (l.u IS NULL OR l.u > r.t))
)
"""
ORACLE["p1_found"] = P1_FOUND_SQL + "SELECT * FROM found"
ORACLE["p1_report"] = P1_FOUND_SQL + "SELECT ref_table, ref_field, period, count(*) AS orphans FROM found GROUP BY ALL"

# ---- the graph -----------------------------------------------------------------------------


def _relations(spark, d):
    """Relation mentions, each once."""
    return table(spark, d, "relationships").dropDuplicates(["rel_seq"])


def _entities(spark, d):
    """Stored entities in their last state, and the lexicon."""
    own = graph.latest(table(spark, d, "entities").drop("metadata"), ["canonical_id"], ["ingested_at"])
    lex = table(spark, d, "lexicon")
    return own.select("canonical_id", "canonical_name", "primary_type", "aliases").unionByName(
        lex.select("canonical_id", "canonical_name", F.col("type").alias("primary_type"), "aliases")
    )


def _edges(spark, d):
    return graph.edges(_relations(spark, d))


def _neighbours(spark, d):
    e = _edges(spark, d)
    return graph.neighbours(e, graph.nodes(_entities(spark, d), e))


def _paths(spark, d, max_hops, max_paths):
    """Paths of every entity, stored or curated."""
    scratch = Scratch(spark)
    known = scratch.put(_entities(spark, d).select("canonical_id", "canonical_name", "primary_type"))
    seeds = known.select(F.col("canonical_id").alias("seed"), "canonical_id", "canonical_name")
    # Of evidence, paths tell the chunks; its texts are not moved.
    told = table(spark, d, "relationships").select("rel_seq", "source_id", "target_id", "type", F.lit("").alias("description"), "weight", F.transform("evidence.chunk_id", lambda c: F.struct(c.alias("chunk_id"))).alias("evidence"))
    e = scratch.put(graph.edges(told.dropDuplicates(["rel_seq"])).select("source_id", "target_id", "type", "edge_seq", "description", "evidence"))
    return traversal.find_paths(seeds, traversal.outgoing(graph.neighbours(e, graph.nodes(known, e), incoming=False)), max_hops, max_paths)


@query
def graph_entities(spark, d):
    return graph.latest(table(spark, d, "entities").drop("metadata"), ["canonical_id"], ["ingested_at"]).select(
        "canonical_id", "canonical_name", "primary_type", "description", F.size("aliases").alias("n_aliases")
    )


@query
def graph_documents(spark, d):
    docs = graph.latest(table(spark, d, "loaded_documents").drop("metadata", "content"), ["document_id"], ["ingested_at", "doc_seq"])
    return docs.select("document_id", "title", "department", chunking.access_tier(F.col("access_tier")).alias("access_tier"), "version")


@query
def graph_part_of_chunks(spark, d):
    return graph.part_of(table(spark, d, "chunks"), table(spark, d, "loaded_documents"))


@query
def graph_edges(spark, d):
    return _edges(spark, d).select(
        "source_id", "target_id", "type", F.round("weight", 6).alias("weight"), "edge_seq", F.array_join(F.transform("evidence", lambda e: e["chunk_id"]), "|", "-").alias("chunks")
    )


@query
def graph_edge_evidence(spark, d):
    """The evidence of edges as a table, one row for each piece."""
    keys = ["source_id", "target_id", "type"]
    rows = resolution.evidence_rows(_relations(spark, d).dropna(subset=keys).select(*keys, "rel_seq", "evidence"), keys)
    return rows.select(*keys, "rel_seq", "n", F.col("e.chunk_id").alias("chunk_id"))


@query
def graph_edges_idempotent(spark, d):
    twice = _relations(spark, d)
    return graph.edges(twice, accumulate=False).select("source_id", "target_id", "type", F.round("weight", 6).alias("weight"))


@query
def graph_stub_entities(spark, d):
    return graph.stub_entities(_edges(spark, d), _entities(spark, d))


@query
def graph_neighbors_capped(spark, d):
    return _neighbours(spark, d).select("node_id", "ordinal", "direction", "source_id", "source_name", "relation", "target_id", "target_name")


@query
def graph_stats(spark, d):
    return graph.stats(_entities(spark, d), table(spark, d, "loaded_documents"), table(spark, d, "chunks"), _edges(spark, d))


@query
def entity_lookup(spark, d):
    lex = table(spark, d, "lexicon")
    names = table(spark, d, "graph_facts").select(F.col("source_name").alias("identifier")).unionByName(lex.select(F.upper("canonical_name").alias("identifier")))
    return graph.find_entities(names.dropna().distinct(), _entities(spark, d))


@query
def chunk_lookup(spark, d):
    wanted = table(spark, d, "citations").select("chunk_id").dropna().distinct()
    return table(spark, d, "chunks").select("chunk_id", "document_id", F.length("text").alias("chars")).join(wanted, "chunk_id", "left_semi").dropDuplicates(["chunk_id"])


@query
def graph_paths_1hop(spark, d):
    return _flat_paths(_paths(spark, d, 1, 20))


@query
def graph_paths_2hop(spark, d):
    return _flat_paths(_paths(spark, d, 2, 60))


@query
def graph_paths_3hop(spark, d):
    return _flat_paths(_paths(spark, d, 3, 200))


def _flat_paths(paths):
    return paths.select(
        "seed", "path_rank", F.array_join("entities", "|").alias("entities"), F.array_join("relationships", "|").alias("relationships"), "length", "score", F.array_join("evidence_chunk_ids", "|").alias("evidence_chunk_ids")
    )


@query
def graph_path_render(spark, d):
    return traversal.render(_paths(spark, d, 2, 20)).select("seed", "path_rank", "pattern", "explanation")


@query
def graph_facts(spark, d):
    return traversal.find_facts(_paths(spark, d, 2, 60), 30)


@query
def graph_evidence_chunks(spark, d):
    return traversal.evidence_chunks(_paths(spark, d, 2, 20), table(spark, d, "chunks"), 20).select("seed", "rank", "chunk_id", "document_id", F.length("text").alias("chars"), "score")


@query
def mentions_link(spark, d):
    # Links are made distinct by the operator.
    return graph.link_mentions(table(spark, d, "chunks"), table(spark, d, "lexicon"))


def _weights_sql(weight: str) -> str:
    return f"""
rel AS (SELECT rel_seq, any_value(source_id) AS source_id, any_value(target_id) AS target_id, any_value(type) AS type, any_value(description) AS description,
        any_value(weight) AS weight, any_value(evidence) AS evidence FROM relationships GROUP BY rel_seq),
keyed AS (SELECT * FROM rel WHERE source_id IS NOT NULL AND target_id IS NOT NULL AND type IS NOT NULL),
heads AS (SELECT source_id, target_id, type, {weight} AS weight, min(rel_seq) AS edge_seq FROM keyed GROUP BY ALL)"""


EDGES_SQL = (
    "WITH RECURSIVE"
    + _weights_sql("round(sum(weight), 6)")
    + """,
items AS (SELECT source_id, target_id, type, rel_seq, n, evidence[n] AS e FROM (SELECT *, unnest(range(1, len(evidence) + 1)) AS n FROM keyed)),
picked AS (SELECT * FROM (SELECT i.*, h.edge_seq, row_number() OVER (PARTITION BY i.source_id, i.target_id, i.type, e.chunk_id ORDER BY rel_seq, n) AS nth
  FROM items i JOIN heads h USING (source_id, target_id, type)) WHERE nth = 1 OR rel_seq = edge_seq),
ev AS (SELECT source_id, target_id, type, list(e.chunk_id ORDER BY rel_seq, n) AS chunk_ids FROM picked GROUP BY ALL),
edges AS (SELECT h.*, ev.chunk_ids FROM heads h LEFT JOIN ev USING (source_id, target_id, type)),
stored AS (SELECT canonical_id, arg_max(canonical_name, ingested_at) AS canonical_name, arg_max(primary_type, ingested_at) AS primary_type FROM entities WHERE canonical_id IS NOT NULL GROUP BY 1),
ents AS (SELECT * FROM stored UNION ALL SELECT canonical_id, canonical_name, type FROM lexicon),
ends AS (SELECT source_id AS canonical_id FROM edges UNION SELECT target_id FROM edges),
stubs AS (SELECT canonical_id, array_to_string(list_transform(regexp_extract_all(lower(replace(string_split(canonical_id, ':')[-1], '_', ' ')), '[a-z]+|[^a-z]+'),
  lambda p: upper(p[1]) || p[2:]), '') AS canonical_name, 'OTHER' AS primary_type FROM ends WHERE canonical_id NOT IN (SELECT canonical_id FROM ents)),
nodes AS (SELECT * FROM ents UNION ALL SELECT * FROM stubs),
rels AS (SELECT *, min(edge_seq) OVER (PARTITION BY source_id, target_id) AS pair_seq FROM edges WHERE type NOT IN ('PART_OF', 'MENTIONS')),
near AS (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY direction DESC, pair_seq, edge_seq) AS ordinal FROM (
  SELECT source_id AS node_id, 'OUTGOING' AS direction, * FROM rels UNION ALL SELECT target_id, 'INCOMING', * FROM rels)),
neighbors AS (SELECT n.node_id, n.ordinal::INT AS ordinal, n.direction, n.source_id, coalesce(nullif(s.canonical_name, ''), n.source_id) AS source_name, n.type AS relation, n.target_id,
  coalesce(nullif(t.canonical_name, ''), n.target_id) AS target_name, n.chunk_ids FROM near n LEFT JOIN nodes s ON s.canonical_id = n.source_id LEFT JOIN nodes t ON t.canonical_id = n.target_id WHERE n.ordinal <= 50),
hops AS (SELECT *, list_filter(chunk_ids, lambda c: c IS NOT NULL AND c <> '') AS ev FROM neighbors WHERE direction = 'OUTGOING')"""
)


def _paths_sql(max_hops: int, max_paths: int) -> str:
    """Paths of all entities; ``uniq`` lists keep the first place of each value."""
    uniq = "list_filter({0}, lambda c, i: list_position({0}, c) = i)"
    return EDGES_SQL + f""",
walk AS (
  SELECT canonical_id AS seed, canonical_id AS at, [coalesce(nullif(canonical_name, ''), canonical_id)] AS entities, []::VARCHAR[] AS rels, []::INT[] AS ords, []::VARCHAR[] AS ev FROM ents
  UNION ALL
  SELECT w.seed, h.target_id, list_append(w.entities, h.target_name), list_append(w.rels, h.relation), list_append(w.ords, h.ordinal), list_concat(w.ev, h.ev)
  FROM walk w JOIN hops h ON h.node_id = w.at
  WHERE len(w.rels) < {max_hops} AND NOT list_contains(w.entities, h.target_name) AND NOT list_contains(w.entities, h.target_id)
),
paths AS (SELECT seed, row_number() OVER (PARTITION BY seed ORDER BY len(rels), ords)::INT AS path_rank, entities, rels, len(rels)::INT AS length,
  round(1.0 / (1.0 + 0.25 * (len(rels) - 1)), 3) AS score, {uniq.format("ev")} AS ev FROM walk WHERE len(rels) > 0 QUALIFY path_rank <= {max_paths})"""


FLAT_PATHS = """ SELECT seed, path_rank, array_to_string(entities, '|') AS entities, array_to_string(rels, '|') AS relationships, length, score::DOUBLE AS score,
 array_to_string(ev, '|') AS evidence_chunk_ids FROM paths"""

ORACLE["graph_entities"] = """SELECT canonical_id, arg_max(canonical_name, ingested_at) AS canonical_name, arg_max(primary_type, ingested_at) AS primary_type,
 (arg_max({'d': description}, ingested_at)).d AS description, (arg_max({'d': len(aliases)::INT}, ingested_at)).d AS n_aliases FROM entities WHERE canonical_id IS NOT NULL GROUP BY 1"""
ORACLE["graph_documents"] = """SELECT document_id, title, department, CASE lower(trim(access_tier)) WHEN 'public' THEN 'Public' WHEN 'confidential' THEN 'Confidential'
 WHEN 'restricted' THEN 'Restricted' ELSE 'Internal' END AS access_tier, version FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY ingested_at DESC, doc_seq DESC) AS n
 FROM loaded_documents WHERE document_id IS NOT NULL) WHERE n = 1"""
ORACLE["graph_part_of_chunks"] = "SELECT DISTINCT chunk_id, document_id FROM chunks WHERE document_id IN (SELECT document_id FROM loaded_documents)"
ORACLE["graph_edges"] = EDGES_SQL + " SELECT source_id, target_id, type, weight, edge_seq, array_to_string(list_transform(chunk_ids, lambda c: coalesce(c, '-')), '|') AS chunks FROM edges"
ORACLE["graph_edge_evidence"] = EDGES_SQL + " SELECT source_id, target_id, type, rel_seq, (n - 1)::INT AS n, e.chunk_id AS chunk_id FROM picked"
ORACLE["graph_edges_idempotent"] = "WITH" + _weights_sql("round(arg_min(weight, rel_seq) + 0.5 * (count(*) - 1), 6)") + " SELECT source_id, target_id, type, weight FROM heads"
ORACLE["graph_stub_entities"] = EDGES_SQL + " SELECT * FROM stubs"
ORACLE["graph_neighbors_capped"] = EDGES_SQL + " SELECT node_id, ordinal, direction, source_id, source_name, relation, target_id, target_name FROM neighbors"
ORACLE["graph_stats"] = (
    EDGES_SQL
    + """ SELECT (SELECT count(DISTINCT canonical_id) FROM nodes) AS entity_count, (SELECT count(DISTINCT document_id) FROM loaded_documents) AS document_count,
 (SELECT count(DISTINCT chunk_id) FROM chunks) AS chunk_count, (SELECT count(*) FROM rels) AS relationship_count"""
)
ORACLE["entity_lookup"] = (
    EDGES_SQL
    + """, named AS (SELECT DISTINCT source_name AS identifier FROM graph_facts WHERE source_name IS NOT NULL UNION SELECT upper(canonical_name) FROM lexicon),
 last_alias AS (SELECT canonical_id, (arg_max({'a': aliases}, ingested_at)).a AS aliases FROM entities GROUP BY 1 UNION ALL SELECT canonical_id, aliases FROM lexicon),
 keys AS (SELECT lower(canonical_name) AS k, canonical_id FROM ents UNION ALL SELECT lower(a), canonical_id FROM (SELECT canonical_id, unnest(aliases) AS a FROM last_alias) WHERE a IS NOT NULL),
 hit AS (SELECT identifier, canonical_id, 0 AS way FROM named JOIN ents ON identifier = canonical_id UNION ALL
  SELECT identifier, m, 1 FROM named JOIN (SELECT k, max(canonical_id) AS m FROM keys GROUP BY k) ON k = lower(identifier))
 SELECT identifier, arg_min(canonical_id, way) AS canonical_id FROM hit GROUP BY 1"""
)
ORACLE["chunk_lookup"] = "SELECT chunk_id, any_value(document_id) AS document_id, any_value(length(text))::INT AS chars FROM chunks WHERE chunk_id IN (SELECT chunk_id FROM citations) GROUP BY 1"
ORACLE["graph_paths_1hop"] = _paths_sql(1, 20) + FLAT_PATHS
ORACLE["graph_paths_2hop"] = _paths_sql(2, 60) + FLAT_PATHS
ORACLE["graph_paths_3hop"] = _paths_sql(3, 200) + FLAT_PATHS
ORACLE["graph_path_render"] = (
    _paths_sql(2, 20)
    + """ SELECT seed, path_rank, '(' || entities[1] || ')' || array_to_string(list_transform(rels, lambda r, i: '-[:' || r || ']->(' || entities[i + 1] || ')'), '') AS pattern,
 array_to_string(entities, ' -> ') AS explanation FROM paths"""
)
ORACLE["graph_facts"] = (
    _paths_sql(2, 60)
    + """, hop AS (SELECT seed, path_rank, i, entities[i] AS source_name, rels[i] AS relation, entities[i + 1] AS target_name, coalesce(ev[1], '') AS evidence_chunk_id, score::DOUBLE AS confidence
  FROM (SELECT *, unnest(range(1, length + 1)) AS i FROM paths)),
 once AS (SELECT * FROM hop QUALIFY row_number() OVER (PARTITION BY seed, lower(source_name), lower(relation), lower(target_name) ORDER BY path_rank, i) = 1)
 SELECT seed, row_number() OVER (PARTITION BY seed ORDER BY path_rank, i)::INT AS fact_rank, source_name, relation, target_name, evidence_chunk_id, confidence FROM once QUALIFY fact_rank <= 30"""
)
ORACLE["graph_evidence_chunks"] = (
    _paths_sql(2, 20)
    + """, ids AS (SELECT seed, path_rank, i, ev[i] AS chunk_id FROM (SELECT *, unnest(range(1, len(ev) + 1)) AS i FROM paths)),
 firsts AS (SELECT seed, chunk_id, min((path_rank, i)) AS place FROM ids GROUP BY ALL),
 ranked AS (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY place)::INT AS rank FROM firsts),
 body AS (SELECT chunk_id, any_value(document_id) AS document_id, any_value(length(text))::INT AS chars FROM chunks GROUP BY 1)
 SELECT seed, rank, chunk_id, document_id, chars, 1.0::DOUBLE AS score FROM ranked JOIN body USING (chunk_id)"""
)
ORACLE["mentions_link"] = r"""
WITH names AS (SELECT DISTINCT canonical_id, lower(n) AS n FROM (SELECT canonical_id, unnest(list_append(aliases, canonical_name)) AS n FROM lexicon) WHERE n <> ''),
c AS (SELECT chunk_id, any_value(lower(text)) AS t FROM chunks GROUP BY 1)
SELECT DISTINCT chunk_id, canonical_id FROM c JOIN names ON regexp_matches(t, '(^|[^a-zA-Z0-9])' || regexp_escape(n) || '([^a-zA-Z0-9]|$)')
"""

# ---- resolution ----------------------------------------------------------------------------


def _canonical(spark, d):
    mentions = table(spark, d, "entity_mentions").dropDuplicates(["mention_seq"])
    return resolution.canonical_entities(mentions, table(spark, d, "lexicon"))


@query
def entity_resolve(spark, d):
    return _canonical(spark, d).select(
        "canonical_id", "canonical_name", "primary_type", "description", "first_seq", F.array_join("source_mentions", "|").alias("source_mentions"), F.array_join("aliases", "|").alias("aliases")
    )


@query
def relations_resolve(spark, d):
    stored = graph.latest(table(spark, d, "entities").drop("metadata"), ["canonical_id"], ["ingested_at"])
    out = resolution.resolve_relations(_relations(spark, d), table(spark, d, "lexicon"), stored, evidence="count")
    return out.select("id", "source_id", "target_id", "type", F.round("weight", 6).alias("weight"), "first_seq", "n_evidence")


# ---- text and chunks -----------------------------------------------------------------------


def _alternation(names):
    return "|".join(quote(n) for n in names)


def _lexicon_rules(spark, d, aliases=True):
    """Extraction rules from the curated entities (a fixed table of 40 rows)."""
    rows = table(spark, d, "lexicon").select("type", "canonical_name", "aliases").orderBy("canonical_id").limit(1001).collect()
    if len(rows) > 1000:
        raise ValueError("more than 1,000 curated entities; use link_mentions instead of literal patterns")
    names: dict[str, set] = {}
    for r in rows:
        names.setdefault(r["type"], set()).update(n for n in [r["canonical_name"], *((r["aliases"] or []) if aliases else [])] if n and n.strip())
    return tuple((rf"\b(?:{_alternation(sorted(ns, key=lambda n: (-len(n), n)))})\b", k, "curated entity") for k, ns in names.items())


@query
def text_word_stats(spark, d):
    c = table(spark, d, "chunks").where("text is not null")
    stats = chunking.enriched(F.col("text"))
    # Numbers are made distinct, not texts.
    return c.select("chunk_id", *[stats[k].alias(k) for k in ("char_count", "word_count", "estimated_tokens")]).dropDuplicates(["chunk_id"])


@query
def text_sentences(spark, d):
    c = table(spark, d, "chunks").where("text is not null").dropDuplicates(["chunk_id"])
    s = c.select("chunk_id", F.posexplode(text.sentences(F.col("text"))).alias("pos", "sentence"))
    return s.select("chunk_id", "pos", "sentence")


@query
def access_tier_norm(spark, d):
    return table(spark, d, "documents").select("doc_id", chunking.access_tier(F.col("access_tier")).alias("access_tier"))


@query
def entity_hints(spark, d):
    patterns = tuple(r[0] for r in _lexicon_rules(spark, d, aliases=False))
    c = table(spark, d, "chunks").where("text is not null")
    return c.select("chunk_id", F.array_join(chunking.entity_hints(F.col("text"), patterns), "|").alias("hints")).dropDuplicates(["chunk_id"])


def _documents(spark, d):
    """Loaded documents with their sections, in their last state."""
    docs = graph.latest(table(spark, d, "loaded_documents").drop("metadata"), ["document_id"], ["ingested_at", "doc_seq"])
    body = F.coalesce("content", F.lit(""))
    title = F.coalesce("title", F.lit(""))
    return docs.select(
        "document_id", title.alias("title"), "department", F.coalesce("access_tier", F.lit("Internal")).alias("access_tier"), "version", "content",
        markdown.sections_of(body, title).alias("sections"), F.create_map().cast("map<string,string>").alias("metadata"),
    )


@query
def section_parse(spark, d):
    return _documents(spark, d).select("document_id", F.posexplode("sections").alias("pos", "s")).select("document_id", "pos", "s.level", "s.title", "s.path", F.length("s.content").alias("chars"))


@query
def chunk_documents(spark, d):
    return chunking.chunk_documents(_documents(spark, d)).select("chunk_id", "document_id", "index", "text", "metadata.section_path")


@query
def frontmatter_parse(spark, d):
    t = table(spark, d, "loaded_documents")
    raw = t.select(
        F.concat(F.lit("/in/"), "document_id", F.lit(".md")).alias("file_path"),
        F.concat(F.lit("---\ntitle: "), F.coalesce("title", F.lit("")), F.lit("\nversion: "), F.coalesce("version", F.lit("")), F.lit("\n---\n"), F.coalesce("content", F.lit(""))).alias("raw_text"),
    ).distinct()
    return markdown.parse_documents(raw).select("document_id", "title", "version", F.length("content").alias("chars"))


@query
def entity_mentions_extracted(spark, d):
    found = extraction.extract_entities(table(spark, d, "chunks"), _lexicon_rules(spark, d))
    return found.select("chunk_id", "pos", "id", "name", "type", "description").dropDuplicates(["chunk_id", "pos"])


@query
def relation_mentions_extracted(spark, d):
    return extraction.extract_relations(table(spark, d, "chunks"), _lexicon_rules(spark, d)).select("chunk_id", "pos", "id", "type", F.col("evidence")[0]["text"].alias("sentence"))


@query
def relations_of_facts(spark, d):
    """Relations in texts that say the facts of a query, three to a sentence, under every cue."""
    f = table(spark, d, "graph_facts").where("query_id is not null").dropDuplicates(["fact_seq"])
    link = F.element_at(F.array(*[F.lit(x) for x in oracles.LINKS]), (F.col("fact_seq") % len(oracles.LINKS) + 1).cast("int"))
    told = F.concat(F.coalesce("source_name", F.lit("it")), F.lit(" "), link, F.lit(" "), F.coalesce("target_name", F.lit("it")))
    # Bounded by the facts of a query.
    said = f.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("fact_rank", "fact_seq", told.alias("told"), "source_name", "target_name"))).alias("fs"))
    pieces = F.transform("fs", lambda x, i: F.concat(x["told"], F.when(i % 3 == 2, ". ").otherwise(" and ")))
    names = F.array_distinct(F.filter(F.flatten(F.transform("fs", lambda x: F.array(x["source_name"], x["target_name"]))), lambda n: text.strip(n) != ""))
    c = said.select(F.col("query_id").alias("chunk_id"), F.lit("").alias("document_id"), F.array_join(pieces, "").alias("text"), names.alias("names"))
    return extraction.extract_relations(c, names=F.col("names")).select("chunk_id", "pos", "id", "type", F.col("evidence")[0]["text"].alias("sentence"))


# ---- vectors -------------------------------------------------------------------------------


def _query_vector(spark, d):
    return table(spark, d, "embeddings").where("vec_id = 0").select("embedding").first()[0]


@query
def vector_topk(spark, d):
    return vectors.search(table(spark, d, "embeddings"), _query_vector(spark, d), "vec_id", "embedding", 10).select("vec_id", "rank", F.round("score", 6).alias("score"))


@query
def vector_topk_filtered(spark, d):
    return vectors.search(table(spark, d, "embeddings"), _query_vector(spark, d), "vec_id", "embedding", 5, {"label": 3}).select("vec_id", "rank", F.round("score", 6).alias("score"))


@query
def vector_topk_batch(spark, d):
    e = table(spark, d, "embeddings")
    q = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("v"))
    return vectors.search_batch(q, "query_id", "v", e, "vec_id", "embedding", 5).select("query_id", "vec_id", "rank", F.round("score", 6).alias("score"))


@query
def vector_topk_indexed(spark, d):
    """vector_topk_batch by an inverted-list index over every row; approximate, so without SQL. These vectors
    form hardly any clusters: 32 of 64 lists find 0.92 to 0.93 of the neighbours, 40 some more."""
    e = table(spark, d, "embeddings")
    centroids = vectors.fit_lists(e, "vec_id", "embedding")
    index = vectors.build_index(e, "vec_id", "embedding", centroids)
    q = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("v"))
    return vectors.search_index(q, "query_id", "v", index, centroids, "vec_id", 5, probes=40).select("query_id", "vec_id", "rank", F.round("score", 6).alias("score"))


@query
def vector_index_recall(spark, d):
    """Share of the five exact neighbours that the index finds is 0.9 or more; and with all lists, all of them."""
    e = table(spark, d, "embeddings")
    exact = vector_topk_batch(spark, d).select("query_id", "vec_id")
    found = vector_topk_indexed(spark, d).select("query_id", "vec_id")
    centroids = vectors.fit_lists(e, "vec_id", "embedding")
    q = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("v"))
    whole = vectors.search_index(q, "query_id", "v", vectors.build_index(e, "vec_id", "embedding", centroids), centroids, "vec_id", 5, probes=len(centroids)).select("query_id", "vec_id")
    n = exact.agg(F.count(F.lit(1)).alias("neighbours"))
    hit = exact.join(found, ["query_id", "vec_id"]).agg(F.count(F.lit(1)).alias("hit"))
    all_hit = exact.join(whole, ["query_id", "vec_id"]).agg(F.count(F.lit(1)).alias("all_hit"))
    return n.join(F.broadcast(hit)).join(F.broadcast(all_hit)).select("neighbours", (F.col("hit") >= 0.9 * F.col("neighbours")).alias("enough"), (F.col("neighbours") - F.col("all_hit")).alias("missed_by_all_lists"))


@query
def vector_count_by_payload(spark, d):
    return table(spark, d, "embeddings").groupBy("label").agg(F.count(F.lit(1)).alias("points"))


@query
def embed_hash_buckets(spark, d):
    c = table(spark, d, "chunks").dropDuplicates(["chunk_id"])
    return vectors.hash_weights(c, "chunk_id", "text")


@query
def embed_hash_norm(spark, d):
    c = table(spark, d, "chunks").dropDuplicates(["chunk_id"])
    w = vectors.hash_weights(c, "chunk_id", "text")
    return w.groupBy("chunk_id").agg(F.round(F.sqrt(F.sum(F.col("weight").cast("double") * F.col("weight"))) / 100, 6).alias("norm"))


@query
def point_uuid5(spark, d):
    return table(spark, d, "chunks").select("chunk_id").distinct().select("chunk_id", vectors.point_id(F.col("chunk_id")).alias("point_id"))


def _points(spark, d):
    """Points of all chunks, with vectors of the production dimension."""
    c = table(spark, d, "chunks").dropDuplicates(["chunk_id"])
    return vectors.points(c, vectors.hash_embeddings(c.select("chunk_id", "text"), "chunk_id", "text"))


def _asked(spark, d):
    """The titles of a twentieth of the documents as questions."""
    return table(spark, d, "documents").where("doc_id % 20 = 0").select(F.col("doc_id").alias("query_id"), F.col("title").alias("query"), "department", "access_tier")


@query
def semantic_search(spark, d):
    """The five chunks nearest to the title of each document whose id is divisible by 20."""
    out = vectors.retrieve(_asked(spark, d).select("query_id", "query"), _points(spark, d))
    return out.select("query_id", "rank", "chunk_id", F.round("score", 5).alias("score"))


@query
def semantic_search_filtered(spark, d):
    """The same within the tier and department of the document, where these are known."""
    q = _asked(spark, d)
    extra = F.create_map(F.lit("department"), F.col("department"))
    out = vectors.retrieve(q.select("query_id", "query", chunking.access_tier(F.col("access_tier")).alias("access_tier"), extra.alias("filters")), _points(spark, d))
    return out.select("query_id", "rank", "chunk_id", F.round("score", 5).alias("score"))


@query
def vector_points(spark, d):
    """Payloads of the points of all chunks, and length and norm of their vectors."""
    p = vectors.check_dimension(_points(spark, d), "vector", 1536)
    return p.select(
        "point_id", "chunk_id", "document_id", F.md5("text").alias("text_md5"), "index", "title", "department", "version", "section_title", "section_path", "access_tier",
        F.array_join("entity_hints", "|").alias("hints"), F.size("vector").alias("dimension"), F.round(vectors.norm(F.col("vector")), 4).alias("norm"),
    )


@query
def vector_upsert(spark, d):
    """Points after all chunks are delivered twice."""
    c = table(spark, d, "chunks")
    p = c.select(vectors.point_id(F.col("chunk_id")).alias("point_id"), "chunk_id")
    return vectors.upsert_points(p.distinct(), p).select("point_id", "chunk_id")


# ---- questions -----------------------------------------------------------------------------


def _questions(spark, d):
    """One question for each retrieval query of the fact table."""
    f = table(spark, d, "graph_facts").dropDuplicates(["fact_seq"])
    said = f.groupBy("query_id").agg(F.min_by(F.struct("source_name", "target_name", "relation"), F.struct("fact_rank", "fact_seq")).alias("x"))
    a, b = F.coalesce("x.source_name", F.lit("it")), F.coalesce("x.target_name", F.lit("it"))
    r = F.lower(F.coalesce("x.relation", F.lit("compare")))
    start = F.when(r == "uses", "Compare the service ").when(r == "affects", "What is the impact of ").when(r == "part_of", "List all products of ").when(r == "supports", "Describe ").otherwise("How much storage links ")
    return said.select("query_id", F.concat(start, a, F.lit(" and "), b, F.lit(" on the platform?")).alias("query"))


@query
def classify_intents(spark, d):
    linked = questions.link_entities(_questions(spark, d), questions.phrase_table(table(spark, d, "lexicon")))
    n = F.size("linked")
    own = questions.intent(F.col("query"), n)
    return linked.select("query_id", "query", n.alias("entities"), own.alias("intent"), questions.strategy(own, n).alias("strategy"))


@query
def entity_knowledge(spark, d):
    """Lookup of names and ids among the lexicon, the standard entities and those of the graph."""
    stored = graph.latest(table(spark, d, "entities").drop("metadata"), ["canonical_id"], ["ingested_at"])
    base = questions.knowledge_base(table(spark, d, "lexicon"), stored)
    asked = table(spark, d, "graph_facts").select(F.col("source_name").alias("identifier"))
    asked = asked.unionByName(table(spark, d, "lexicon").select(F.upper("canonical_id").alias("identifier"))).unionByName(table(spark, d, "entities").select(F.col("canonical_id").alias("identifier")))
    return questions.canonical_lookup(asked, base)


@query
def link_questions(spark, d):
    linked = questions.link_entities(_questions(spark, d), questions.phrase_table(table(spark, d, "lexicon")))
    return linked.select("query_id", F.posexplode("linked").alias("pos", "e")).select("query_id", "pos", "e.*")


@query
def plan_questions(spark, d):
    p = questions.analyze(_questions(spark, d), table(spark, d, "lexicon"))
    return p.select(
        "query_id", "intent", "strategy", F.size("seed_entities").alias("seeds"), F.array_join("target_entity_types", "|").alias("targets"), "max_hops", "require_paths", "top_k",
        F.to_json("filters").alias("filters"),
    )


# ---- store, stream and pipeline ------------------------------------------------------------


def _own_store(spark):
    """A store in a folder of its own under the shared checkpoint folder."""
    return Store(spark, Scratch(spark).root)


@query
def store_upsert(spark, d):
    """Documents after they were delivered in three batches, each key once; the store is cleared."""
    docs = table(spark, d, "loaded_documents").drop("metadata")
    store = _own_store(spark)
    for n in range(3):
        store.upsert("documents", docs.where(F.col("doc_seq") % 3 == n), ["document_id"], ["ingested_at", "doc_seq"])
    store.assert_unique("documents", ["document_id"])
    out = cut(store.read("documents").select("document_id", "doc_seq", "title", "version", "ingested_at"))
    store.clear()
    return out


@query
def stream_upsert(spark, d):
    """Chunks in their last state, upserted from a file stream that is run to its end."""
    schema = table(spark, d, "chunks").select("chunk_id", "document_id", "ingested_at", "deleted_at").schema
    store = _own_store(spark)
    stream = chunk_stream(spark, f"{d}/chunk[s].parquet", schema)
    upsert_stream(stream, store, "chunks", ["chunk_id"], ["ingested_at"], f"{store.root}/checkpoint").awaitTermination()
    out = cut(store.read("chunks").select("chunk_id", "document_id", "ingested_at"))
    store.clear()
    return out


@query
def chunks_per_day(spark, d):
    return mentions_per_window(table(spark, d, "chunks").select("ingested_at"), "ingested_at")


@query
def pipeline_summary(spark, d):
    """An ingest of all documents: what was stored of documents, chunks and points."""
    store = _own_store(spark)
    lex = table(spark, d, "lexicon")
    g = pipeline.ingest(_documents(spark, d), lex, rules=_lexicon_rules(spark, d), store=store)
    out = cut(pipeline.summary(g).select("documents_count", "chunks_count", "points_count"))
    store.clear()
    return out


# ---- extensions ----------------------------------------------------------------------------


@query
def rrf_fusion(spark, d):
    e = table(spark, d, "embeddings")
    near = vectors.search(e, _query_vector(spark, d), "vec_id", "embedding", 50).select("vec_id", "rank")
    other = e.where("vec_id = 20").select("embedding").first()[0]
    far = vectors.search(e, other, "vec_id", "embedding", 50).select("vec_id", "rank")
    out = fusion.reciprocal_rank_fusion({"vector": near, "graph": far}, ["vec_id"])
    return out.select("vec_id", "vector_rank", "graph_rank", F.round("rrf_score", 9).alias("rrf_score"))


@query
def graph_communities(spark, d):
    return fusion.communities(_edges(spark, d), 2)


LEX_SQL = r"""
alias_keys AS (
  SELECT canonical_id AS seq, n, k, canonical_id, canonical_name, type, description, aliases FROM (
    SELECT *, unnest(range(len(ks))) AS n, unnest(ks) AS k FROM (
      SELECT *, list_concat(list_concat([lower(trim(canonical_id)), string_split(lower(trim(canonical_id)), ':')[-1], 'entity:' || string_split(lower(trim(canonical_id)), ':')[-1]],
        list_transform(aliases, lambda a: lower(trim(a)))), [lower(trim(canonical_name))]) AS ks FROM lexicon)) WHERE k <> ''),
idx AS (SELECT k, arg_max(struct_pack(canonical_id, canonical_name, type, description, aliases), (seq, n)) AS record, min((seq, n)) AS place FROM alias_keys GROUP BY k)"""

ORACLE["entity_resolve"] = (
    r"WITH "
    + LEX_SQL
    + r""",
m AS (SELECT mention_seq, any_value(name) AS name, coalesce(any_value(type), 'OTHER') AS type, any_value(description) AS description, any_value(aliases) AS aliases FROM entity_mentions GROUP BY 1),
low AS (SELECT *, lower(regexp_replace(name, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g')) AS low FROM m WHERE name IS NOT NULL),
exact AS (SELECT low.*, idx.record AS exact FROM low LEFT JOIN idx ON idx.k = low.low),
held AS (SELECT low, arg_min(record, (-len(k), place)) AS held FROM (SELECT DISTINCT low FROM exact WHERE exact IS NULL) x JOIN idx
  ON len(k) >= 3 AND regexp_matches(low, '(^|[^a-zA-Z0-9])' || regexp_escape(k) || '([^a-zA-Z0-9]|$)') GROUP BY low),
r AS (SELECT mention_seq, name, coalesce(exact, held, struct_pack(
   canonical_id := 'entity:' || lower(type) || ':' || regexp_replace(regexp_replace(lower(name), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'),
   canonical_name := regexp_replace(name, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g'), type := type, description := description, aliases := coalesce(aliases, []))) AS rec FROM exact LEFT JOIN held USING (low)),
head AS (SELECT rec.canonical_id AS canonical_id, arg_min(rec.canonical_name, mention_seq) AS canonical_name, arg_min(rec.type, mention_seq) AS primary_type,
   (arg_max({'d': rec.description}, (len(coalesce(rec.description, '')), -mention_seq))).d AS description, min(mention_seq) AS first_seq FROM r GROUP BY 1),
said AS (SELECT canonical_id, string_agg(name, '|' ORDER BY s) AS source_mentions FROM (SELECT rec.canonical_id AS canonical_id, name, min(mention_seq) AS s FROM r GROUP BY ALL) GROUP BY 1),
al AS (SELECT canonical_id, string_agg(a, '|' ORDER BY s) AS aliases FROM (SELECT canonical_id, a, min((mention_seq, n)) AS s FROM (
   SELECT rec.canonical_id AS canonical_id, mention_seq, unnest(range(len(rec.aliases))) AS n, unnest(rec.aliases) AS a FROM r) WHERE a IS NOT NULL GROUP BY ALL) GROUP BY 1)
SELECT head.*, source_mentions, coalesce(aliases, '') AS aliases FROM head JOIN said USING (canonical_id) LEFT JOIN al USING (canonical_id)
"""
)

ORACLE["relations_resolve"] = (
    r"WITH "
    + LEX_SQL
    + r""",
rel AS (SELECT rel_seq, any_value(source_id) AS source_id, any_value(target_id) AS target_id, any_value(type) AS type, any_value(weight) AS weight, any_value(evidence) AS evidence FROM relationships GROUP BY 1),
named AS (SELECT 0 AS level, canonical_id, list_concat([canonical_name], aliases) AS names FROM lexicon UNION ALL
  SELECT 1, canonical_id, list_concat(list_concat([arg_max(canonical_name, ingested_at)], coalesce((arg_max({'a': aliases}, ingested_at)).a, [])), coalesce((arg_max({'a': source_mentions}, ingested_at)).a, [])) FROM entities GROUP BY canonical_id),
one AS (SELECT level, canonical_id, lower(regexp_replace(v, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g')) AS v FROM (SELECT level, canonical_id, unnest(names) AS v FROM named) WHERE v IS NOT NULL),
forms AS (SELECT level, canonical_id, canonical_id AS k FROM named UNION ALL SELECT level, canonical_id, string_split(canonical_id, ':')[-1] FROM named UNION ALL SELECT level, canonical_id, 'entity:' || string_split(canonical_id, ':')[-1] FROM named
  UNION ALL SELECT level, canonical_id, v FROM one
  UNION ALL SELECT level, canonical_id, trim(regexp_replace(v, '[^a-z0-9]+', ' ', 'g')) FROM one
  UNION ALL SELECT level, canonical_id, regexp_replace(regexp_replace(v, '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') FROM one
  UNION ALL SELECT level, canonical_id, 'entity:' || regexp_replace(regexp_replace(v, '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') FROM one),
ends AS (SELECT k, arg_max(canonical_id, (level, canonical_id)) AS cid FROM forms WHERE k <> '' GROUP BY k),
raws AS (SELECT source_id AS raw FROM rel UNION SELECT target_id FROM rel),
bound AS (SELECT raw, lower(regexp_replace(raw, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g')) AS clean FROM raws WHERE raw IS NOT NULL),
prep AS (SELECT raw, lower(replace(replace(raw, 'entity:', ''), '_', ' ')) AS spaced, clean,
   trim(replace(regexp_replace(clean, '^entity:(?:[a-z]+:)?', ''), '_', ' ')) AS bare,
   'entity:' || regexp_replace(regexp_replace(regexp_replace(clean, '^entity:(?:[a-z]+:)?', ''), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS own FROM bound),
res AS (SELECT raw, coalesce(e1.cid, e2.cid, i1.record.canonical_id, i2.record.canonical_id, own) AS cid FROM prep LEFT JOIN ends e1 ON e1.k = raw LEFT JOIN ends e2 ON e2.k = spaced
   LEFT JOIN idx i1 ON i1.k = clean LEFT JOIN idx i2 ON i2.k = bare),
r AS (SELECT rel_seq, s.cid AS source_id, t.cid AS target_id, type, weight, evidence,
   'rel:' || replace(replace(s.cid, 'entity:', ''), ':', '_') || ':' || lower(type) || ':' || replace(replace(t.cid, 'entity:', ''), ':', '_') AS id
   FROM rel JOIN res s ON s.raw = source_id JOIN res t ON t.raw = target_id WHERE s.cid <> t.cid AND type IS NOT NULL),
head AS (SELECT id, arg_min(source_id, rel_seq) AS source_id, arg_min(target_id, rel_seq) AS target_id, arg_min(type, rel_seq) AS type, round(arg_min(weight, rel_seq) + 0.5 * (count(*) - 1), 6) AS weight, min(rel_seq) AS first_seq FROM r GROUP BY id),
items AS (SELECT id, rel_seq, n, evidence[n].chunk_id AS c FROM (SELECT *, unnest(range(1, len(evidence) + 1)) AS n FROM r)),
ev AS (SELECT id, count(*)::INT AS n_evidence FROM (SELECT i.id FROM items i JOIN head h USING (id) QUALIFY row_number() OVER (PARTITION BY i.id, c ORDER BY rel_seq, n) = 1 OR rel_seq = first_seq) GROUP BY id)
SELECT head.*, coalesce(n_evidence, 0) AS n_evidence FROM head LEFT JOIN ev USING (id)
"""
)

ONE_CHUNK = "(SELECT chunk_id, any_value(text) AS text FROM chunks WHERE text IS NOT NULL GROUP BY 1)"
WS = r"[\s\p{Z}\x1c-\x1f\x85]"
ORACLE["text_word_stats"] = rf"""SELECT chunk_id, length(text)::INT AS char_count, len(list_filter(regexp_split_to_array(text, '{WS}+'), lambda w: w <> ''))::INT AS word_count,
 greatest(1, length(text) // 4)::INT AS estimated_tokens FROM {ONE_CHUNK}"""
ORACLE["text_sentences"] = rf"""SELECT chunk_id, (i - 1)::INT AS pos, s[i] AS sentence FROM (SELECT chunk_id, s, unnest(range(1, len(s) + 1)) AS i FROM (
 SELECT chunk_id, list_filter(list_transform(string_split(regexp_replace(text, '([.!?]){WS}+', '\1' || chr(1), 'g'), chr(1)), lambda x: regexp_replace(x, '^{WS}+|{WS}+$', '', 'g')), lambda x: x <> '') AS s FROM {ONE_CHUNK}))"""
ORACLE["access_tier_norm"] = "SELECT doc_id, CASE lower(trim(access_tier)) WHEN 'public' THEN 'Public' WHEN 'confidential' THEN 'Confidential' WHEN 'restricted' THEN 'Restricted' ELSE 'Internal' END AS access_tier FROM documents"
ORACLE["entity_hints"] = rf"""SELECT chunk_id, array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(text, (SELECT '(?i)\b(?:' || string_agg(regexp_escape(canonical_name), '|') || ')\b' FROM lexicon)),
 lambda h: regexp_replace(h, '{WS}+', ' ', 'g')))), '|') AS hints FROM {ONE_CHUNK}"""
COS = "list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[])"
ORACLE["vector_topk"] = f"SELECT vec_id, row_number() OVER (ORDER BY s DESC, vec_id)::INT AS rank, round(s, 6) AS score FROM (SELECT e.vec_id, {COS} AS s FROM embeddings e, embeddings q WHERE q.vec_id = 0) QUALIFY rank <= 10"
ORACLE["vector_topk_filtered"] = f"SELECT vec_id, row_number() OVER (ORDER BY s DESC, vec_id)::INT AS rank, round(s, 6) AS score FROM (SELECT e.vec_id, {COS} AS s FROM embeddings e, embeddings q WHERE q.vec_id = 0 AND e.label = 3) QUALIFY rank <= 5"
ORACLE["vector_topk_batch"] = f"SELECT query_id, vec_id, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id)::INT AS rank, round(s, 6) AS score FROM (SELECT q.vec_id AS query_id, e.vec_id, {COS} AS s FROM embeddings e, embeddings q WHERE q.vec_id % 20 = 0) QUALIFY rank <= 5"
ORACLE["vector_index_recall"] = "SELECT (SELECT count(*) FROM embeddings WHERE vec_id % 20 = 0) * least(5, (SELECT count(*) FROM embeddings)) AS neighbours, true AS enough, 0::BIGINT AS missed_by_all_lists"
ORACLE["vector_count_by_payload"] = "SELECT label, count(*) AS points FROM embeddings GROUP BY 1"
HASH_SQL = rf"""WITH c AS {ONE_CHUNK.replace(" WHERE text IS NOT NULL", "")},
low AS (SELECT chunk_id, lower(text) AS t FROM c WHERE regexp_replace(coalesce(text, ''), '^{WS}+', '') <> ''),
p AS (SELECT chunk_id, w AS piece, CASE WHEN length(w) > 5 THEN 200 ELSE 100 END AS x FROM (SELECT chunk_id, unnest(regexp_extract_all(t, '[\p{{L}}\p{{N}}_]+')) AS w FROM low)
  UNION ALL SELECT chunk_id, substring(t, i, 3), 35 FROM (SELECT chunk_id, t, unnest(range(1, length(t) - 1)) AS i FROM low WHERE length(t) >= 3)),
g AS (SELECT chunk_id, piece, sum(x) AS x FROM p GROUP BY ALL),
h AS (SELECT chunk_id, x, ((('0x' || substr(md5(piece), 1, 16))::UBIGINT::HUGEINT % 3072) * (18446744073709551616::HUGEINT % 3072) + ('0x' || substr(md5(piece), 17, 16))::UBIGINT::HUGEINT % 3072) % 3072 AS k FROM g),
w AS (SELECT chunk_id, (k % 1536)::INT AS idx, sum(CASE WHEN k % 2 = 0 THEN x ELSE -x END)::BIGINT AS weight FROM h GROUP BY ALL UNION ALL SELECT chunk_id, 0, 100 FROM c WHERE chunk_id NOT IN (SELECT chunk_id FROM low))"""
ORACLE["embed_hash_buckets"] = HASH_SQL + " SELECT * FROM w WHERE weight <> 0"
ORACLE["embed_hash_norm"] = HASH_SQL + " SELECT chunk_id, round(sqrt(sum(weight::DOUBLE * weight)) / 100, 6) AS norm FROM w GROUP BY 1"
ORACLE["point_uuid5"] = """SELECT chunk_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || ['8', '9', 'a', 'b'][(('0x' || substr(h, 17, 1))::INT & 3) + 1] || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS point_id
 FROM (SELECT DISTINCT chunk_id, sha1(unhex('6ba7b8109dad11d180b400c04fd430c8') || encode(chunk_id)) AS h FROM chunks)"""
ORACLE["vector_upsert"] = ORACLE["point_uuid5"]
ORACLE["frontmatter_parse"] = rf"""SELECT DISTINCT document_id, coalesce(nullif(regexp_replace(coalesce(title, ''), '^{WS}+|{WS}+$', '', 'g'), ''),
 nullif(regexp_replace(regexp_extract(coalesce(content, ''), '(?m)^#[\s\p{{Z}}]+(.+)$', 1), '^{WS}+|{WS}+$', '', 'g'), ''),
 array_to_string(list_transform(regexp_extract_all(lower(replace(document_id, '_', ' ')), '[a-z]+|[^a-z]+'), lambda p: upper(p[1]) || p[2:]), '')) AS title,
 regexp_replace(coalesce(version, ''), '^{WS}+|{WS}+$', '', 'g') AS version, length(regexp_replace(coalesce(content, ''), '^{WS}+|{WS}+$', '', 'g'))::INT AS chars FROM loaded_documents"""
ORACLE["rrf_fusion"] = f"""WITH a AS (SELECT vec_id, row_number() OVER (ORDER BY s DESC, vec_id)::INT AS r FROM (SELECT e.vec_id, {COS} AS s FROM embeddings e, embeddings q WHERE q.vec_id = 0) QUALIFY r <= 50),
 b AS (SELECT vec_id, row_number() OVER (ORDER BY s DESC, vec_id)::INT AS r FROM (SELECT e.vec_id, {COS} AS s FROM embeddings e, embeddings q WHERE q.vec_id = 20) QUALIFY r <= 50)
 SELECT coalesce(a.vec_id, b.vec_id) AS vec_id, a.r AS vector_rank, b.r AS graph_rank, round(coalesce(0.5 / (60 + a.r), 0) + coalesce(0.3 / (60 + b.r), 0), 9) AS rrf_score FROM a FULL JOIN b ON a.vec_id = b.vec_id"""


def _vote_sql(source: str, target: str) -> str:
    return f"""{target} AS (SELECT x AS canonical_id, arg_min(community_id, (-w, community_id)) AS community_id FROM (
  SELECT x, community_id, round(sum(coalesce(weight, 1.0)), 6) AS w FROM both_ways JOIN {source} l ON l.canonical_id = y GROUP BY ALL) GROUP BY 1)"""


ORACLE["graph_communities"] = (
    EDGES_SQL
    + """, both_ways AS (SELECT source_id AS x, target_id AS y, weight FROM edges WHERE source_id <> target_id UNION ALL SELECT target_id, source_id, weight FROM edges WHERE source_id <> target_id),
 l0 AS (SELECT DISTINCT x AS canonical_id, x AS community_id FROM both_ways), """
    + _vote_sql("l0", "l1")
    + ", "
    + _vote_sql("l1", "l2")
    + " SELECT * FROM l2"
)

ORACLE["store_upsert"] = """SELECT document_id, doc_seq, title, version, ingested_at FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY ingested_at DESC, doc_seq DESC) AS n
 FROM loaded_documents WHERE document_id IS NOT NULL) WHERE n = 1"""
ORACLE["stream_upsert"] = "SELECT chunk_id, arg_max(document_id, ingested_at) AS document_id, max(ingested_at) AS ingested_at FROM chunks WHERE chunk_id IS NOT NULL GROUP BY 1"
ORACLE["chunks_per_day"] = """SELECT date_trunc('day', ingested_at)::TIMESTAMP AS "start", date_trunc('day', ingested_at)::TIMESTAMP + INTERVAL 1 DAY AS "end", count(*) AS rows FROM chunks WHERE ingested_at IS NOT NULL GROUP BY ALL"""
ORACLE["pipeline_summary"] = f"""SELECT (SELECT count(DISTINCT document_id) FROM loaded_documents) AS documents_count, count(*) AS chunks_count, count(*) AS points_count FROM ({oracles.CHUNK_DOCUMENTS})"""
ORACLE["section_parse"] = oracles.SECTION_PARSE
ORACLE["chunk_documents"] = oracles.CHUNK_DOCUMENTS
ORACLE["entity_mentions_extracted"] = oracles.ENTITY_MENTIONS
ORACLE["relation_mentions_extracted"] = oracles.RELATION_MENTIONS
ORACLE["relations_of_facts"] = oracles.RELATIONS_OF_FACTS
ORACLE["link_questions"] = oracles.LINK_QUESTIONS
ORACLE["classify_intents"] = oracles.CLASSIFY_INTENTS
ORACLE["plan_questions"] = oracles.PLAN_QUESTIONS
ORACLE["entity_knowledge"] = oracles.ENTITY_KNOWLEDGE
for _match in orphans.MATCHES:
    ORACLE[f"p1_composite_{_match}"] = oracles.composite(_match)
ORACLE["vector_points"] = rf"""
WITH u AS ({ORACLE["point_uuid5"]}), c AS (SELECT chunk_id, any_value(document_id) AS document_id, any_value(text) AS text, any_value(index) AS index, any_value(metadata) AS m FROM chunks GROUP BY 1)
SELECT point_id, c.chunk_id, document_id, md5(text) AS text_md5, index, coalesce(m.title, '') AS title, coalesce(m.department, 'General') AS department, coalesce(m.version, '1.0') AS version,
 coalesce(m.section_title, '') AS section_title, coalesce(m.section_path, '') AS section_path, coalesce(m.access_tier, 'Internal') AS access_tier,
 coalesce(array_to_string(m.entity_hints, '|'), '') AS hints, 1536::INT AS dimension, 1.0::DOUBLE AS norm FROM c JOIN u USING (chunk_id)"""


def _search_sql(condition: str) -> str:
    """Hash embeddings of chunks and titles in sparse form, and the five best scores."""
    titles = HASH_SQL.replace("WITH c AS (SELECT chunk_id, any_value(text) AS text FROM chunks GROUP BY 1)", "WITH c AS (SELECT doc_id AS chunk_id, title AS text FROM asked)")
    q = rf"""asked AS (SELECT doc_id, title, department, CASE lower(trim(access_tier)) WHEN 'public' THEN 'Public' WHEN 'confidential' THEN 'Confidential' WHEN 'restricted' THEN 'Restricted' ELSE 'Internal' END AS tier
  FROM documents WHERE doc_id % 20 = 0 AND regexp_replace(coalesce(title, ''), '^{WS}+', '') <> '')"""
    return rf"""WITH {q}, chunk_w AS ({HASH_SQL} SELECT chunk_id, idx, weight FROM w WHERE weight <> 0), query_w AS ({titles} SELECT chunk_id AS query_id, idx, weight FROM w WHERE weight <> 0),
nc AS (SELECT chunk_id, sqrt(sum(weight::DOUBLE * weight)) AS n FROM chunk_w GROUP BY 1), nq AS (SELECT query_id, sqrt(sum(weight::DOUBLE * weight)) AS n FROM query_w GROUP BY 1),
meta AS (SELECT chunk_id, coalesce(any_value(metadata).department, 'General') AS department, coalesce(any_value(metadata).access_tier, 'Internal') AS tier FROM chunks GROUP BY 1),
dots AS (SELECT query_id, chunk_id, sum(a.weight::DOUBLE * b.weight) AS s FROM query_w a JOIN chunk_w b USING (idx) GROUP BY ALL),
scored AS (SELECT nq.query_id, nc.chunk_id, coalesce(s, 0) / (nq.n * nc.n) AS score FROM nq JOIN asked ON asked.doc_id = nq.query_id JOIN meta ON {condition} JOIN nc ON nc.chunk_id = meta.chunk_id
  LEFT JOIN dots ON dots.query_id = nq.query_id AND dots.chunk_id = nc.chunk_id)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id)::INT AS rank, chunk_id, round(score, 5) AS score FROM scored QUALIFY rank <= 5"""


ORACLE["semantic_search"] = _search_sql("true")
ORACLE["semantic_search_filtered"] = _search_sql("meta.tier = asked.tier AND (asked.department IS NULL OR asked.department = '' OR meta.department = asked.department)")
