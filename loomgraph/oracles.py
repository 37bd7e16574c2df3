"""SQL of the queries on sections, chunks, extraction, questions and points, written from the rules of the
operators and not from their plans: state machines are recursive queries, spans are found by marks."""

from __future__ import annotations

from loomgraph.lexicon import PLAIN_RELATIONS, RELATION_CUES, STANDARD_NAMES
from loomgraph.operators import questions

WS = r"[\s\p{Z}\x1c-\x1f\x85]"
#: A private character put after every other character than a letter or digit: so a name's two
#: neighbours can be matched without taking them from the next name.
MARK = "chr(57344)"


def sql_text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def stripped(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def marked(x: str) -> str:
    return f"regexp_replace({x}, '([^a-zA-Z0-9])', '\\1' || {MARK}, 'g')"


SECTIONS = rf"""
docs AS (SELECT document_id, coalesce(title, '') AS title, coalesce(content, '') AS body FROM
  (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY ingested_at DESC, doc_seq DESC) AS n FROM loaded_documents WHERE document_id IS NOT NULL) WHERE n = 1),
split AS (SELECT document_id, title, string_split_regex(body, '\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{{85}}\x{{2028}}\x{{2029}}]') AS ls FROM docs WHERE body <> ''),
ln AS (SELECT document_id, i, line, length(regexp_extract(line, '^(#{{1,6}})[\s\p{{Z}}]+(.+)$', 1)) AS level, {stripped(r"regexp_extract(line, '^(#{1,6})[\s\p{Z}]+(.+)$', 2)")} AS head
  FROM (SELECT document_id, unnest(range(1, len(ls) + 1)) AS i, unnest(ls) AS line FROM split)),
numbered AS (SELECT *, sum((level > 0)::INT) OVER (PARTITION BY document_id ORDER BY i) AS sec FROM ln),
heads AS (SELECT document_id, 0 AS sec, 1 AS level, title FROM docs UNION ALL SELECT document_id, sec, level, head FROM numbered WHERE level > 0),
bodies AS (SELECT document_id, sec, {stripped("string_agg(line, chr(10) ORDER BY i)")} AS content FROM numbered WHERE level = 0 GROUP BY ALL),
paths AS (SELECT k.document_id, k.sec, string_agg(j.title, ' > ' ORDER BY j.sec) AS path FROM heads k JOIN heads j ON j.document_id = k.document_id AND j.sec <= k.sec
  WHERE NOT EXISTS (SELECT 1 FROM heads m WHERE m.document_id = k.document_id AND m.sec > j.sec AND m.sec <= k.sec AND m.level <= j.level) GROUP BY ALL),
sections AS (SELECT document_id, (row_number() OVER (PARTITION BY document_id ORDER BY sec) - 1)::INT AS pos, h.level::INT AS level, h.title, path, content
  FROM bodies JOIN heads h USING (document_id, sec) JOIN paths USING (document_id, sec) WHERE content <> '')"""

SECTION_PARSE = "WITH" + SECTIONS + " SELECT document_id, pos, level, title, path, length(content)::INT AS chars FROM sections"

#: Limit, overlap and least length of chunks are the defaults of the settings.
LIMIT, OVERLAP, LEAST = 500, 100, 80
CHUNK_DOCUMENTS = (
    "WITH RECURSIVE"
    + SECTIONS
    + rf""",
parts AS (SELECT document_id, pos, path, content FROM sections UNION ALL SELECT document_id, 0, title, {stripped("body")} FROM docs WHERE document_id NOT IN (SELECT document_id FROM sections)),
paras AS (SELECT document_id, pos, path, list_filter(list_transform(string_split_regex({stripped("content")}, '\n{WS}*\n'), lambda p: {stripped("p")}), lambda p: p <> '') AS ps FROM parts),
one AS (SELECT document_id, pos, k, ps[k] AS p FROM (SELECT *, unnest(range(1, len(ps) + 1)) AS k FROM paras)),
large AS (SELECT document_id, pos, k, list_filter(list_transform(string_split(regexp_replace(p, '([.!?]){WS}+', '\1' || chr(1), 'g'), chr(1)), lambda s: {stripped("s")}), lambda s: s <> '') AS ss FROM one WHERE length(p) > {LIMIT}),
by_sentence AS (
  SELECT document_id, pos, k, ss, 0 AS i, []::VARCHAR[] AS done, []::VARCHAR[] AS buf, 0::BIGINT AS size FROM large
  UNION ALL
  SELECT document_id, pos, k, ss, i + 1, CASE WHEN over THEN list_append(done, array_to_string(buf, ' ')) ELSE done END, new, CASE WHEN over THEN list_sum(list_transform(new, lambda y: length(y) + 1)) ELSE size + length(x) + 1 END
  FROM (SELECT *, CASE WHEN over THEN list_append(buf[len(buf) - keep + 1:], x) ELSE list_append(buf, x) END AS new FROM (
    SELECT *, ss[i + 1] AS x, size + length(ss[i + 1]) + 1 > {LIMIT} AND len(buf) > 0 AS over,
      list_max(list_filter(range(0, len(buf) + 1), lambda n: n = 0 OR list_sum(list_transform(buf[len(buf) - n + 1:], lambda y: length(y) + 1)) <= {OVERLAP})) AS keep FROM by_sentence WHERE i < len(ss)))
),
pieces_of AS (SELECT document_id, pos, k, CASE WHEN len(buf) > 0 THEN list_append(done, array_to_string(buf, ' ')) ELSE done END AS pieces FROM by_sentence WHERE i = len(ss)),
units AS (SELECT document_id, pos, path, len(ps) AS n, list(struct_pack(p := p, pieces := pieces) ORDER BY k) AS us FROM paras JOIN one USING (document_id, pos) LEFT JOIN pieces_of USING (document_id, pos, k) GROUP BY ALL),
by_para AS (
  SELECT document_id, pos, path, us, n, 0 AS i, []::VARCHAR[] AS done, []::VARCHAR[] AS buf, 0::BIGINT AS size FROM units
  UNION ALL
  SELECT document_id, pos, path, us, n, i + 1,
    CASE WHEN pieces IS NOT NULL THEN list_concat(CASE WHEN len(buf) > 0 THEN list_append(done, array_to_string(buf, chr(10) || chr(10))) ELSE done END, pieces)
      WHEN over THEN list_append(done, array_to_string(buf, chr(10) || chr(10))) ELSE done END,
    CASE WHEN pieces IS NOT NULL THEN [] WHEN over THEN [p] ELSE list_append(buf, p) END,
    CASE WHEN pieces IS NOT NULL THEN 0 WHEN over THEN length(p) ELSE size + length(p) + 2 END
  FROM (SELECT *, us[i + 1].p AS p, us[i + 1].pieces AS pieces, size + length(us[i + 1].p) + 2 > {LIMIT} AND len(buf) > 0 AS over FROM by_para WHERE i < n)
),
packed AS (SELECT document_id, pos, path, CASE WHEN len(buf) = 0 THEN done
    WHEN length(last) < {LEAST} AND len(done) > 0 AND length(done[-1]) + length(last) + 2 <= {LIMIT} * 1.2 THEN list_append(done[:len(done) - 1], done[-1] || chr(10) || chr(10) || last)
    ELSE list_append(done, last) END AS texts FROM (SELECT *, array_to_string(buf, chr(10) || chr(10)) AS last FROM by_para WHERE i = n)),
flat AS (SELECT document_id, path, row_number() OVER (PARTITION BY document_id ORDER BY pos, t) AS number, texts[t] AS text FROM (SELECT *, unnest(range(1, len(texts) + 1)) AS t FROM packed))
SELECT 'chunk_' || document_id || '_' || lpad(number::VARCHAR, greatest(3, length(number::VARCHAR))::INT, '0') AS chunk_id, document_id, number::INT AS index, {stripped("text")} AS text, path AS section_path
FROM flat WHERE {stripped("text")} <> ''"""
)

ONE_CHUNK = "(SELECT chunk_id, any_value(document_id) AS document_id, any_value(text) AS text FROM chunks WHERE text IS NOT NULL GROUP BY 1)"
STANDARD_CASE = " ".join(f"WHEN contains(low, {sql_text(w)}) THEN {sql_text(n)}" for w, n in STANDARD_NAMES)
MENTIONS = rf"""
spelled AS (SELECT DISTINCT type, n FROM (SELECT type, unnest(list_concat([canonical_name], coalesce(aliases, []))) AS n FROM lexicon) WHERE {stripped("n")} <> ''),
pats AS (SELECT type, p, rk FROM (SELECT type, '(?i)\b(?:' || string_agg(regexp_escape(n), '|' ORDER BY -length(n), n) || ')\b' AS p FROM spelled GROUP BY 1) JOIN (SELECT type, min(canonical_id) AS rk FROM lexicon GROUP BY 1) USING (type)),
c AS {ONE_CHUNK},
hit AS (SELECT chunk_id, document_id, text, rk, type, i, hits[i] AS raw FROM (SELECT *, unnest(range(1, len(hits) + 1)) AS i FROM (SELECT *, regexp_extract_all(text, p) AS hits FROM c, pats))),
clean AS (SELECT *, lower(clean) AS low FROM (SELECT *, {stripped(f"regexp_replace(raw, '{WS}+', ' ', 'g')")} AS clean FROM hit)),
named AS (SELECT *, CASE WHEN type = 'VERSION' AND regexp_matches(clean, '3\.[012]') THEN 'Version ' || regexp_extract(clean, '3\.[012]')
    WHEN type = 'PRODUCT' AND regexp_matches(clean, '(?i)^(?:Product\s+)?(Nova|Orion|Atlas|Vega)') THEN 'Product ' || upper(regexp_extract(clean, '(?i)^(?:Product\s+)?(Nova|Orion|Atlas|Vega)', 1)[1]) || lower(regexp_extract(clean, '(?i)^(?:Product\s+)?(Nova|Orion|Atlas|Vega)', 1)[2:])
    {STANDARD_CASE} ELSE clean END AS name FROM clean),
once AS (SELECT * FROM named QUALIFY row_number() OVER (PARTITION BY chunk_id, lower(name) ORDER BY rk, i) = 1),
mention AS (SELECT *, (row_number() OVER (PARTITION BY chunk_id ORDER BY rk, i) - 1)::INT AS pos FROM once)"""
SENTENCES = rf"list_transform(string_split(regexp_replace(text, '([.!?]){WS}+', '\1' || chr(1), 'g'), chr(1)), lambda s: {stripped('s')})"


def slugged(x: str) -> str:
    return f"regexp_replace(regexp_replace(lower({x}), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g')"


ENTITY_MENTIONS = (
    "WITH"
    + MENTIONS
    + rf""", told AS (SELECT *, list_filter({SENTENCES}, lambda s: contains(lower(s), lower(raw)))[1] AS s FROM mention)
SELECT chunk_id, pos, 'entity:' || lower(type) || ':' || {slugged("name")} AS id, name, type, coalesce(CASE WHEN length(s) > 200 THEN s[1:197] || '...' ELSE s END, 'curated entity') AS description FROM told"""
)

CUES = " ".join(f"WHEN regexp_matches({{0}}, '(?i){p}') THEN {sql_text(k)}" for p, k, _ in RELATION_CUES)
ANY_CUE = "(?i)" + "|".join(p for p, _, _ in RELATION_CUES)
PLAIN = " ".join(f"WHEN regexp_matches(lower({where}), '{'|'.join(words)}') THEN '{kind}'" for where, words, kind, _ in PLAIN_RELATIONS if words)
#: From chunk (chunk_id, text, names, alts) on.
PAIRS = rf""",
piece AS (SELECT chunk_id, names, alts, nth, ss[nth] AS sentence FROM (SELECT *, unnest(range(1, len(ss) + 1)) AS nth FROM (SELECT *, {SENTENCES} AS ss FROM chunk))),
cut AS (SELECT *, list_transform(string_split(regexp_replace({marked("sentence")}, '(?i)(^|[^a-zA-Z0-9])(' || alts || ')([^a-zA-Z0-9]|$)', '\1' || chr(2) || '\2' || chr(2) || '\3', 'g'), chr(2)), lambda x: replace(x, {MARK}, '')) AS ps FROM piece),
apart AS (SELECT *, (len(ps) - 1) // 2 AS n FROM cut WHERE len(ps) >= 5),
pair AS (SELECT *, unnest(range(i + 1, n + 1)) AS j FROM (SELECT *, unnest(range(1, n)) AS i FROM apart)),
ends AS (SELECT *, list_filter(names, lambda x: lower(x) = lower(ps[2 * i]))[1] AS source, list_filter(names, lambda x: lower(x) = lower(ps[2 * j]))[1] AS target,
  array_to_string(ps[2 * i + 1:2 * j - 1], '') AS btw FROM pair),
good AS (SELECT * FROM ends WHERE lower(source) <> lower(target) AND len(list_filter(range(i + 1, j), lambda k: regexp_matches(array_to_string(ps[2 * k + 1:2 * j - 1], ''), '{ANY_CUE}'))) = 0),
typed AS (SELECT *, CASE {CUES.format("btw")} WHEN j > i + 1 THEN NULL {PLAIN} ELSE '{PLAIN_RELATIONS[-1][2]}' END AS kind FROM good),
first AS (SELECT * FROM typed WHERE kind IS NOT NULL QUALIFY row_number() OVER (PARTITION BY chunk_id, lower(source), lower(target), kind ORDER BY nth, i, j) = 1)
SELECT chunk_id, (row_number() OVER (PARTITION BY chunk_id ORDER BY nth, i, j) - 1)::INT AS pos, 'rel:' || {slugged("source")} || ':' || lower(kind) || ':' || {slugged("target")} AS id, kind AS type, sentence FROM first"""
CHUNK_NAMES = rf"list(name ORDER BY pos) AS names, string_agg(regexp_escape({marked('name')}), '|' ORDER BY -length(name), pos) AS alts"
RELATION_MENTIONS = "WITH" + MENTIONS + f", chunk AS (SELECT chunk_id, any_value(text) AS text, {CHUNK_NAMES} FROM mention GROUP BY 1 HAVING count(*) > 1)" + PAIRS
#: What links the names of a fact in the sentences that are made of facts; the last holds no cue.
LINKS = ("relies on", "uses", "affects", "was introduced in", "supports", "runs on", "integrates with", "complies with", "is governed by", "is part of", "sits near")
RELATIONS_OF_FACTS = (
    rf"""WITH one AS (SELECT fact_seq, any_value(query_id) AS query_id, any_value(fact_rank) AS fact_rank, any_value(source_name) AS s, any_value(target_name) AS t FROM graph_facts GROUP BY 1),
f AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY fact_rank, fact_seq) - 1 AS rn FROM one WHERE query_id IS NOT NULL),
texts AS (SELECT query_id AS chunk_id, string_agg(coalesce(s, 'it') || ' ' || {list(LINKS)!r}[fact_seq % {len(LINKS)} + 1] || ' ' || coalesce(t, 'it') || CASE WHEN rn % 3 = 2 THEN '. ' ELSE ' and ' END, '' ORDER BY rn) AS text FROM f GROUP BY 1),
said AS (SELECT chunk_id, name, min(pos) AS pos FROM (SELECT query_id AS chunk_id, s AS name, 2 * rn AS pos FROM f UNION ALL SELECT query_id, t, 2 * rn + 1 FROM f) WHERE {stripped("name")} <> '' GROUP BY ALL),
chunk AS (SELECT chunk_id, any_value(text) AS text, {CHUNK_NAMES} FROM said JOIN texts USING (chunk_id) GROUP BY 1 HAVING count(*) > 1)"""
    + PAIRS
)

# ---- questions -----------------------------------------------------------------------------

QUESTIONS = """
f AS (SELECT query_id, arg_min(struct_pack(s := source_name, t := target_name, r := relation), (fact_rank, fact_seq)) AS x FROM graph_facts GROUP BY 1),
q AS (SELECT query_id, CASE lower(coalesce(x.r, 'compare')) WHEN 'uses' THEN 'Compare the service ' WHEN 'affects' THEN 'What is the impact of ' WHEN 'part_of' THEN 'List all products of '
  WHEN 'supports' THEN 'Describe ' ELSE 'How much storage links ' END || coalesce(x.s, 'it') || ' and ' || coalesce(x.t, 'it') || ' on the platform?' AS query FROM f)"""
LINKED = (
    QUESTIONS
    + rf""",
said AS (SELECT canonical_id AS seq, 0 AS n, lower({stripped("canonical_name")}) AS phrase, true AS canonical, canonical_id, canonical_name, type FROM lexicon
  UNION ALL SELECT canonical_id, k, lower({stripped("aliases[k]")}), false, canonical_id, canonical_name, type FROM (SELECT *, unnest(range(1, len(aliases) + 1)) AS k FROM lexicon)
  UNION ALL SELECT canonical_id, 1000000, lower(canonical_id), true, canonical_id, canonical_name, type FROM lexicon),
phrases AS (SELECT phrase, coalesce(arg_max(struct_pack(canonical_id, canonical_name, type), (seq, n)) FILTER (canonical), arg_min(struct_pack(canonical_id, canonical_name, type), (seq, n)) FILTER (NOT canonical)) AS e,
  bool_or(canonical) AS canonical, min((seq, n)) AS place FROM said WHERE length(phrase) >= 2 GROUP BY 1),
searched AS (SELECT *, '(?i)(^|[^a-zA-Z0-9])(' || array_to_string(list_transform(string_split_regex(phrase, '\s+'), lambda w: regexp_escape({marked("w")})), '(?:\s' || {MARK} || ')+') || ')([^a-zA-Z0-9]|$)' AS p FROM phrases),
cut AS (SELECT query_id, phrase, e, canonical, place, list_transform(string_split(regexp_replace({marked("query")}, p, '\1' || chr(2) || '\2' || chr(2) || '\3', 'g'), chr(2)), lambda x: replace(x, {MARK}, '')) AS ps FROM q, searched
  WHERE contains(lower(query), string_split(phrase, ' ')[1])),
hits AS (SELECT *, length(array_to_string(ps[1:2 * h - 1], '')) AS a, length(array_to_string(ps[1:2 * h], '')) AS b, ps[2 * h] AS raw FROM (SELECT *, unnest(range(1, (len(ps) - 1) // 2 + 1)) AS h FROM cut)),
ranked AS (SELECT query_id, list(struct_pack(a, b, raw, e, canonical) ORDER BY -length(phrase), place, a) AS hs FROM hits GROUP BY 1),
pick AS (
  SELECT query_id, hs, 0 AS i, hs[1:0] AS kept, []::BOOLEAN[] AS fresh FROM ranked
  UNION ALL
  SELECT query_id, hs, i + 1, CASE WHEN clash THEN kept ELSE list_append(kept, x) END, CASE WHEN clash THEN fresh ELSE list_append(fresh, len(list_filter(kept, lambda k: k.e.canonical_id = x.e.canonical_id)) = 0) END
  FROM (SELECT *, hs[i + 1] AS x, len(list_filter(kept, lambda k: hs[i + 1].a < k.b AND k.a < hs[i + 1].b)) > 0 AS clash FROM pick WHERE i < len(hs))
),
won AS (SELECT query_id, kept[k] AS x FROM (SELECT *, unnest(range(1, len(kept) + 1)) AS k FROM pick WHERE i = len(hs)) WHERE fresh[k])"""
)
LINK_QUESTIONS = (
    "WITH RECURSIVE"
    + LINKED
    + """ SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY x.a) - 1)::INT AS pos, x.raw AS raw_mention, x.e.canonical_id AS canonical_id, x.e.canonical_name AS canonical_name,
 x.e.type AS entity_type, CASE WHEN x.canonical THEN 1.0 ELSE 0.95 END::DOUBLE AS confidence FROM won"""
)


def _any(patterns: tuple[str, ...]) -> str:
    return "regexp_matches(low, '" + "|".join(patterns) + "')"


INTENTS = (
    LINKED
    + rf""",
n AS (SELECT query_id, query, lower(trim(query)) AS low, coalesce(c, 0)::INT AS entities FROM q LEFT JOIN (SELECT query_id, count(*) AS c FROM won GROUP BY 1) USING (query_id)),
i AS (SELECT *, CASE WHEN low = '' THEN 'NO_ANSWER'
  WHEN entities = 0 AND NOT list_has_any(regexp_extract_all(low, '[a-z0-9_-]+'), {list(questions.DOMAIN_WORDS)!r}) THEN 'NO_ANSWER'
  WHEN {_any(questions.COMPARISON)} OR (entities >= 2 AND regexp_matches(low, '\b(?:or|versus|difference)\b')) THEN 'COMPARISON'
  WHEN {_any(questions.GLOBAL)} THEN 'GLOBAL' WHEN {_any(questions.MULTI_HOP)} THEN 'MULTI_HOP' WHEN {_any(questions.FACT)} THEN 'DIRECT_FACT'
  WHEN {_any(questions.RELATIONSHIP)} OR entities >= 2 THEN 'RELATIONSHIP' WHEN {_any(questions.ENTITY_LOOKUP)} OR entities = 1 THEN 'ENTITY_LOOKUP' ELSE 'DIRECT_FACT' END AS intent FROM n),
s AS (SELECT *, CASE WHEN intent = 'GLOBAL' THEN 'global' WHEN intent IN ('MULTI_HOP', 'RELATIONSHIP') THEN 'multi_hop' WHEN intent IN ('COMPARISON', 'ENTITY_LOOKUP') THEN 'hybrid'
  WHEN intent = 'DIRECT_FACT' AND entities > 0 THEN 'hybrid' ELSE 'vector' END AS strategy FROM i)"""
)
CLASSIFY_INTENTS = "WITH RECURSIVE" + INTENTS + " SELECT query_id, query, entities, intent, strategy FROM s"


def _plan(n: int) -> str:
    return "CASE intent " + " ".join(f"WHEN '{k}' THEN {str(v[n]).lower()}" for k, v in questions.INTENT_PLAN.items()) + " END"


TARGETS = ", ".join(rf"CASE WHEN regexp_matches(low, '\b(?:{'|'.join(ws)})\b') THEN '{kind}' END" for kind, ws in questions.TARGET_WORDS)
DEPARTMENT, TIER = questions.DEPARTMENT, questions.TIER
PLAN_QUESTIONS = (
    "WITH RECURSIVE"
    + INTENTS
    + rf""", x AS (SELECT *, nullif(regexp_extract(low, '\b(?:version\s+|v)?(3\.[12])\b', 1), '') AS version,
  coalesce(nullif(regexp_extract(low, '\b(?:access\s+tier|tier|classification)\s*[:=]?\s*{TIER}\b', 1), ''), nullif(regexp_extract(low, '\b{TIER}\s+(?:tier|access|classification|documents?|docs?)\b', 1), ''),
    CASE WHEN contains(low, 'confidential') THEN 'confidential' WHEN contains(low, 'restricted') THEN 'restricted' END) AS tier,
  coalesce(nullif(regexp_extract(low, '\b(?:in|from|department|dept|team)\s+(?:the\s+)?{DEPARTMENT}\b', 1), ''), nullif(regexp_extract(low, '\b{DEPARTMENT}\s+(?:department|team|docs?|documents?)\b', 1), '')) AS department FROM s)
SELECT query_id, intent, strategy, entities AS seeds, array_to_string(list_filter([{TARGETS}], lambda t: t IS NOT NULL), '|') AS targets,
 (CASE WHEN intent = 'MULTI_HOP' AND (contains(low, '3 hops') OR contains(low, 'three hops') OR contains(low, 'chain')) THEN 3 ELSE {_plan(1)} END)::INT AS max_hops, {_plan(2)} AS require_paths, ({_plan(0)})::INT AS top_k,
 '{{' || array_to_string(list_filter(['"version":"' || version || '"', '"access_tier":"' || upper(tier[1]) || tier[2:] || '"', '"department":"' || upper(department[1]) || department[2:] || '"'], lambda f: f IS NOT NULL), ',') || '}}' AS filters FROM x"""
)

ENTITY_KNOWLEDGE = rf"""
WITH asked AS (SELECT DISTINCT identifier FROM (SELECT source_name AS identifier FROM graph_facts UNION ALL SELECT upper(canonical_id) FROM lexicon UNION ALL SELECT canonical_id FROM entities) WHERE identifier IS NOT NULL),
standard AS (SELECT * FROM (VALUES {", ".join(f"({i}, {sql_text(c)}, {sql_text(n)}, {sql_text(t)}, [{', '.join(map(sql_text, al))}])" for i, (c, n, t, _, al) in enumerate(questions.STANDARD_ENTITIES))}) AS v(i, canonical_id, canonical_name, type, aliases)),
stored AS (SELECT canonical_id, arg_max(canonical_name, ingested_at) AS canonical_name, (arg_max({{'t': primary_type}}, ingested_at)).t AS type, (arg_max({{'a': aliases}}, ingested_at)).a AS aliases FROM entities WHERE canonical_id IS NOT NULL GROUP BY 1),
base AS (SELECT 0 AS src, canonical_id AS ord, canonical_id, canonical_name, type, aliases FROM lexicon UNION ALL SELECT 1, lpad(i::VARCHAR, 20, '0'), canonical_id, canonical_name, type, aliases FROM standard
  UNION ALL SELECT 2, canonical_id, canonical_id, canonical_name, coalesce(type, 'OTHER'), coalesce(aliases, []) FROM stored),
said AS (SELECT (src, ord) AS seq, 0 AS n, lower({stripped("canonical_name")}) AS phrase, true AS canonical, canonical_id, canonical_name, type FROM base
  UNION ALL SELECT (src, ord), k, lower({stripped("aliases[k]")}), false, canonical_id, canonical_name, type FROM (SELECT *, unnest(range(1, len(aliases) + 1)) AS k FROM base)
  UNION ALL SELECT (src, ord), 1000000, lower(canonical_id), true, canonical_id, canonical_name, type FROM base),
phrases AS (SELECT phrase, coalesce(arg_max(struct_pack(canonical_id, canonical_name, type), (seq, n)) FILTER (canonical), arg_min(struct_pack(canonical_id, canonical_name, type), (seq, n)) FILTER (NOT canonical)) AS e,
  bool_or(canonical) AS canonical FROM said WHERE phrase <> '' GROUP BY 1),
ids AS (SELECT canonical_id, arg_max(struct_pack(canonical_id, canonical_name, type), (src, ord)) AS e FROM base GROUP BY 1)
SELECT identifier, coalesce(i.e.canonical_id, p.e.canonical_id) AS canonical_id, coalesce(i.e.canonical_name, p.e.canonical_name) AS canonical_name, coalesce(i.e.type, p.e.type) AS entity_type,
 CASE WHEN i.e IS NOT NULL OR p.canonical THEN 1.0 ELSE 0.95 END::DOUBLE AS confidence
FROM asked LEFT JOIN ids i ON i.canonical_id = identifier LEFT JOIN phrases p ON p.phrase = lower({stripped("identifier")}) WHERE i.e IS NOT NULL OR p.e IS NOT NULL"""


def composite(match: str) -> str:
    """Citations whose (document_id, chunk_id) is an orphan under a match rule."""
    key = r"nullif(lower(trim({0}, E' \t\n\r')), '')"
    refs = f"(SELECT cit_seq, any_value({key.format('document_id')}) AS d, any_value({key.format('chunk_id')}) AS c FROM citations GROUP BY 1)"
    par = f"(SELECT DISTINCT {key.format('document_id')} AS d, {key.format('chunk_id')} AS c FROM chunks)"
    both = "d IS NOT NULL AND c IS NOT NULL"
    absent = f"NOT EXISTS (SELECT 1 FROM {par} p WHERE (r.d IS NULL OR p.d = r.d) AND (r.c IS NULL OR p.c = r.c))"
    rule = {"simple": f"{both} AND {absent}", "partial": f"(d IS NOT NULL OR c IS NOT NULL) AND {absent}", "full": f"((d IS NULL) <> (c IS NULL)) OR ({both} AND {absent})"}[match]
    return f"SELECT cit_seq FROM {refs} r WHERE {rule}"
