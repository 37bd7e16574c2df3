"""Queries of the training-data operators, and the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph.llm import bpe, components, names, neardup, packing, splitting, subjects
from loomgraph.session import table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def p4_found(spark, d):
    return components.entity_groups(table(spark, d, "entity_matches"), table(spark, d, "entities"))


@query
def p5_found(spark, d):
    return splitting.oversized_items(table(spark, d, "loaded_documents"), table(spark, d, "chunks"))


@query
def p5_pieces(spark, d):
    return splitting.oversized_pieces(table(spark, d, "loaded_documents"), table(spark, d, "chunks")).distinct()


@query
def p6_ids(spark, d):
    return bpe.encode_corpus(table(spark, d, "documents"))


@query
def p5_report(spark, d):
    """The pieces of each oversized text put together again."""
    return splitting.pieces_report(table(spark, d, "loaded_documents"), table(spark, d, "chunks"))


@query
def p6_decoded(spark, d):
    """The texts read back from their ids."""
    return bpe.decode_corpus(p6_ids(spark, d)).select("doc_id", F.md5("text").alias("text_md5"), F.length("text").alias("chars"))


ORACLE["p5_report"] = r"""
WITH body AS (SELECT DISTINCT 'document' AS item_kind, document_id AS item_key, regexp_replace(content, '^[\s\p{Z}\x1c-\x1f\x85]+|[\s\p{Z}\x1c-\x1f\x85]+$', '', 'g') AS body, content AS raw, 4000 AS most FROM loaded_documents
  UNION SELECT 'chunk', chunk_id, regexp_replace(text, '^[\s\p{Z}\x1c-\x1f\x85]+|[\s\p{Z}\x1c-\x1f\x85]+$', '', 'g'), text, 600 FROM chunks)
SELECT item_kind, item_key, md5(body) AS body_md5, 0::BIGINT AS over, 0::BIGINT AS far FROM body WHERE length(body) > most
"""
ORACLE["p6_decoded"] = "SELECT doc_id, md5(coalesce(text, '')) AS text_md5, coalesce(length(text), 0)::INT AS chars FROM documents"
ORACLE["p4_found"] = r"""
WITH RECURSIVE links AS (
  SELECT lower(trim(left_id, E' \t\n\r')) AS a, lower(trim(right_id, E' \t\n\r')) AS b FROM entity_matches WHERE is_match
  UNION
  SELECT i, m FROM (SELECT i, min(i) OVER (PARTITION BY e) AS m FROM (
    SELECT DISTINCT lower(trim(canonical_id, E' \t\n\r')) AS i, lower(trim(e, E' \t\n\r')) AS e
    FROM (SELECT canonical_id, unnest(aliases) AS e FROM entities)) WHERE e <> '')
), edges AS (
  SELECT a, b FROM links WHERE a <> b AND a <> '' AND b <> '' UNION SELECT b, a FROM links WHERE a <> b AND a <> '' AND b <> ''
), walk AS (
  SELECT a AS id, a AS low FROM edges
  UNION
  SELECT e.b, w.low FROM walk w JOIN edges e ON e.a = w.id WHERE w.low < e.b
)
SELECT id AS canonical_id, min(low) AS group_id FROM walk GROUP BY id
"""

ORACLE["p5_found"] = r"""
SELECT DISTINCT 'document' AS item_kind, document_id AS item_key FROM loaded_documents
WHERE length(regexp_replace(content, '^[\s\p{Z}\x1c-\x1f\x85]+|[\s\p{Z}\x1c-\x1f\x85]+$', '', 'g')) > 4000
UNION ALL
SELECT DISTINCT 'chunk', chunk_id FROM chunks
WHERE length(regexp_replace(text, '^[\s\p{Z}\x1c-\x1f\x85]+|[\s\p{Z}\x1c-\x1f\x85]+$', '', 'g')) > 600
"""


@query
def p2_found(spark, d):
    return neardup.similar_pairs(table(spark, d, "chunks"), table(spark, d, "relationships"))


@query
def p2_classes(spark, d):
    return neardup.similar_classes(table(spark, d, "chunks"), table(spark, d, "relationships"))


# Texts meet on their common word pairs, and each meeting is counted out.
SIMILAR_SQL = r"""
WITH items AS (
  SELECT DISTINCT 'chunk' AS item_kind, chunk_id AS k, text FROM chunks WHERE chunk_id IS NOT NULL
  UNION SELECT 'evidence', rel_seq || '#' || (i - 1), evidence[i].text FROM (SELECT rel_seq, evidence, unnest(range(1, len(evidence) + 1)) AS i FROM relationships)
), said AS (SELECT item_kind, k, list_transform(regexp_extract_all(text, '[\p{L}\p{N}]+'), lambda w: lower(w)) AS w FROM items WHERE text IS NOT NULL),
grams AS (SELECT DISTINCT item_kind, k, w[i] || ' ' || w[i + 1] AS g FROM (SELECT *, unnest(range(1, len(w))) AS i FROM said)),
sizes AS (SELECT item_kind, k, count(*) AS n FROM grams GROUP BY ALL),
met AS (SELECT a.item_kind, a.k AS x, b.k AS y, count(*) AS shared FROM grams a JOIN grams b ON a.item_kind = b.item_kind AND a.g = b.g AND a.k < b.k GROUP BY ALL),
alike AS (SELECT met.item_kind, x, y FROM met JOIN sizes s ON s.item_kind = met.item_kind AND s.k = x JOIN sizes t ON t.item_kind = met.item_kind AND t.k = y
  WHERE shared * 5 >= 3 * (s.n + t.n - shared))"""
ORACLE["p2_found"] = SIMILAR_SQL + " SELECT item_kind, x AS left_key, y AS right_key FROM alike"
ORACLE["p2_classes"] = (
    SIMILAR_SQL
    + """, sets AS (SELECT item_kind, k, list(g ORDER BY g) AS s FROM grams GROUP BY ALL),
classes AS (SELECT item_kind, s, min(k) AS class_id, count(*) AS copies FROM sets GROUP BY ALL),
members AS (SELECT item_kind, k, class_id, copies FROM sets JOIN classes USING (item_kind, s)),
ways AS (SELECT item_kind, x, y FROM alike UNION ALL SELECT item_kind, y, x FROM alike),
links AS (SELECT a.item_kind, a.class_id, count(DISTINCT b.class_id) AS links FROM ways w JOIN members a ON a.item_kind = w.item_kind AND a.k = w.x
  JOIN members b ON b.item_kind = w.item_kind AND b.k = w.y WHERE a.class_id <> b.class_id GROUP BY ALL)
SELECT m.item_kind, k AS item_key, m.class_id, copies, coalesce(links, 0) AS links FROM members m LEFT JOIN links l ON l.item_kind = m.item_kind AND l.class_id = m.class_id"""
)


@query
def p7_containers(spark, d):
    return packing.packed_documents(table(spark, d, "documents"))


@query
def p7_report(spark, d):
    """What must hold of p7_containers on the whole table."""
    return packing.packing_report(p7_containers(spark, d))


ORACLE["p7_report"] = "SELECT count(DISTINCT doc_id) AS documents, 0::BIGINT AS overfull, 0::BIGINT AS torn, 0::BIGINT AS cut FROM documents"


@query
def p8_found(spark, d):
    return subjects.document_subjects(
        table(spark, d, "documents"), table(spark, d, "subject_labels"), table(spark, d, "subjects")
    )


@query
def p8_shares(spark, d):
    return subjects.subject_shares(p8_found(spark, d))


@query
def p3_found(spark, d):
    return names.found_mentions(table(spark, d, "entity_mentions"), table(spark, d, "entities"))
