"""Entity and relation mentions of chunks, by rules or by models of one's own.

All rules are native expressions on the row. A sentence with the names of its chunk as one
alternation, longest first, falls into hits and the gaps between them; relations are pairs of hits
with the gaps they span. Only relations found are shuffled, to count each once in a chunk.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions.text import SENTENCE_GAP, slug, squeeze, strip
from loomgraph.lexicon import ENTITY_RULES, PLAIN_RELATIONS, RELATION_CUES, STANDARD_NAMES
from loomgraph.operators.hooks import answered
from loomgraph.session import cut


def standard_name(raw: Column, kind: Column) -> Column:
    """The name an entity goes by: versions and products by number and name, known words by
    their standard name, else the text with white space squeezed."""
    clean = strip(squeeze(raw))
    low = F.lower(clean)
    number = F.regexp_extract(clean, r"3\.[012]", 0)
    product = F.regexp_extract(clean, r"(?i)^(?:Product\s+)?(Nova|Orion|Atlas|Vega)", 1)
    out = F.when((kind == "VERSION") & (number != ""), F.concat(F.lit("Version "), number))
    out = out.when((kind == "PRODUCT") & (product != ""), F.concat(F.lit("Product "), F.initcap(product)))
    for word, name in STANDARD_NAMES:
        out = out.when(low.contains(word), F.lit(name))
    return out.otherwise(clean)


def entity_id(name: Column, kind: Column) -> Column:
    return F.concat(F.lit("entity:"), F.lower(kind), F.lit(":"), slug(name))


def context_sentence(text: Column, raw: Column) -> Column:
    """The first sentence that holds the mention, cut to 200 characters; null if there is none."""
    hit = strip(F.try_element_at(F.filter(F.split(text, SENTENCE_GAP), lambda s: F.contains(F.lower(s), F.lower(raw))), F.lit(1)))
    return F.when(F.length(hit) > 200, F.concat(F.substring(hit, 1, 197), F.lit("..."))).otherwise(hit)


def _tagger(typed: Column):
    return lambda h: F.struct(strip(h).alias("raw"), typed["type"].alias("type"), typed["fallback"].alias("fallback"))


def mention_array(text: Column, rules=ENTITY_RULES) -> Column:
    """Mentions of a text in rule order, then text order; the first of each name counts."""
    found = []
    for pattern, kind, fallback in rules:
        hits = F.regexp_extract_all(text, F.lit("(?iU)" + pattern), F.lit(0))
        typed = F.struct(F.lit(kind).alias("type"), F.lit(fallback).alias("fallback"))
        found.append(F.transform(hits, _tagger(typed)))
    named = F.transform(F.concat(*found), lambda m: m.withField("name", standard_name(m["raw"], m["type"])))
    none = F.array().cast("array<struct<raw:string,type:string,fallback:string,name:string>>")
    # A fold, so that the list is built once and not for each comparison.
    return F.aggregate(
        named, none, lambda out, m: F.when(F.exists(out, lambda n: F.lower(n["name"]) == F.lower(m["name"])), out).otherwise(F.array_append(out, m))
    )


MENTION = "array<struct<name:string,type:string,description:string,aliases:array<string>>>"
RELATION = "array<struct<source:string,target:string,type:string,description:string,sentence:string,confidence:double>>"


def _by_rules(chunks: DataFrame, rules) -> DataFrame:
    rows = chunks.where("text is not null").select("chunk_id", "document_id", "text", F.posexplode(mention_array(F.col("text"), rules)).alias("pos", "m"))
    raw, name = F.col("m.raw"), F.col("m.name")
    return rows.select(
        "chunk_id",
        "document_id",
        "pos",
        entity_id(name, F.col("m.type")).alias("id"),
        name.alias("name"),
        F.col("m.type").alias("type"),
        F.coalesce(context_sentence(F.col("text"), raw), F.col("m.fallback")).alias("description"),
        F.when(F.lower(raw) != F.lower(name), F.array(raw)).otherwise(F.array().cast("array<string>")).alias("aliases"),
        F.create_map(F.lit("source_chunk_id"), F.col("chunk_id"), F.lit("document_id"), F.col("document_id")).alias("metadata"),
    )


def extract_entities(chunks: DataFrame, rules=ENTITY_RULES, model=None) -> DataFrame:
    """Mentions of (chunk_id, document_id, text): pos, id, name, type, description, aliases,
    metadata. Null texts have none; chunks delivered again give theirs again.

    model: gives the mentions of a list of {chunk_id, text} as lists of {name, type, description,
    aliases}; chunks that it gives None for, or fails on, go by the rules (see ``hooks``).
    """
    if model is None:
        return _by_rules(chunks, rules)
    rows = answered(chunks.where("text is not null").select("chunk_id", "document_id", "text"), ["chunk_id", "text"], model, "told", MENTION)
    # The model is asked once.
    rows = cut(rows)
    named = rows.where("told is not null").select("chunk_id", "document_id", F.posexplode("told").alias("pos", "m")).where("m.name is not null")
    kind = F.upper(F.coalesce("m.type", F.lit("OTHER")))
    own = named.select(
        "chunk_id",
        "document_id",
        "pos",
        entity_id(F.col("m.name"), kind).alias("id"),
        F.col("m.name").alias("name"),
        kind.alias("type"),
        F.col("m.description").alias("description"),
        F.coalesce("m.aliases", F.array().cast("array<string>")).alias("aliases"),
        F.create_map(F.lit("source_chunk_id"), F.col("chunk_id"), F.lit("document_id"), F.col("document_id")).alias("metadata"),
    )
    return own.unionByName(_by_rules(rows.where("told is null"), rules))


def _name_pattern(names: Column) -> Column:
    """Names as one regex, longest first, so that the longest hit at each place is found."""
    ranked = F.array_sort(F.array_distinct(names), lambda a, b: F.length(b) - F.length(a))
    each = F.transform(ranked, lambda n: F.regexp_replace(n, r"([^\p{L}\p{N}\s_])", r"\\$1"))
    return F.concat(F.lit("(?iu)(?<![a-zA-Z0-9])(?:"), F.array_join(each, "|"), F.lit(")(?![a-zA-Z0-9])"))


def _cue(text: Column, cues) -> Column:
    """Type and description of the first cue in a text, or null."""
    out = F.lit(None).cast("struct<type:string,description:string>")
    for pattern, kind, told in reversed(cues):
        out = F.when(text.rlike("(?iU)" + pattern), F.struct(F.lit(kind).alias("type"), F.lit(told).alias("description"))).otherwise(out)
    return out


def _plain(source: Column, target: Column) -> Column:
    """The relation of two neighbours without a cue, by their names."""
    side = {"source": F.lower(source), "target": F.lower(target)}
    out = None
    for where, words, kind, told in reversed(PLAIN_RELATIONS):
        own = F.struct(F.lit(kind).alias("type"), F.lit(told).alias("description"))
        out = own if out is None else F.when(side[where].rlike("|".join(words)), own).otherwise(out)
    return out


def extract_relations(chunks: DataFrame, rules=ENTITY_RULES, cues=RELATION_CUES, names: Column | None = None, model=None) -> DataFrame:
    """Relations of (chunk_id, document_id, text): pos, id, source_id, target_id, type,
    description, weight, evidence, metadata.

    names: the entity names of a chunk as array<string>, in order; by default those that the
    rules find. Of two names in a sentence the first is the source. A cue between them tells the
    relation; a name between them with a cue of its own rules it out; without any cue only
    neighbours are related. Each (source, target, type) counts once for a chunk, where it comes
    first. Chunks with fewer than two names and null texts have no relations; chunks delivered again
    count once.

    model: gives the relations of a list of {chunk_id, text, names} as lists of {source, target, type,
    description, sentence, confidence}; chunks that it gives None for, or fails on, go by the rules.
    """
    named = names if names is not None else F.transform(mention_array(F.col("text"), rules), lambda m: m["name"])
    rows = chunks.where("text is not null").select("chunk_id", "document_id", "text", named.alias("names"))
    told = None
    if model is not None:
        rows = cut(answered(rows, ["chunk_id", "text", "names"], model, "told", RELATION))
        told = rows.where("told is not null").dropDuplicates(["chunk_id"]).select("chunk_id", "document_id", F.posexplode("told").alias("pos", "r")).where("r.source is not null and r.target is not null")
        told = told.select("chunk_id", "document_id", "pos", "r.source", "r.target", F.upper(F.coalesce("r.type", F.lit("RELATED_TO"))).alias("type"), "r.description", "r.sentence", F.coalesce("r.confidence", F.lit(0.9)).alias("confidence"))
        rows = rows.where("told is null")
    rows = rows.where(F.size("names") >= 2)
    parts = rows.select("chunk_id", "document_id", "names", _name_pattern(F.col("names")).alias("pattern"), F.posexplode(F.split("text", SENTENCE_GAP)).alias("nth", "piece"))
    parts = parts.withColumn("sentence", strip(F.col("piece")))
    cut_up = parts.select("chunk_id", "document_id", "names", "nth", "sentence", F.regexp_extract_all("sentence", F.col("pattern"), F.lit(0)).alias("hits"), F.split("sentence", F.col("pattern"), -1).alias("gaps"))
    # Hits under the name they were given in the chunk.
    spelled = F.transform("hits", lambda h: F.coalesce(F.try_element_at(F.filter("names", lambda n: F.lower(n) == F.lower(h)), F.lit(1)), h))
    several = cut_up.where(F.size("hits") >= 2).withColumn("said", spelled)
    n = F.size("hits")
    pairs = several.select("*", F.explode(F.sequence(F.lit(1), n - 1)).alias("i")).select("*", F.explode(F.sequence(F.col("i") + 1, n)).alias("j"))

    def between(k: Column) -> Column:
        """The text from hit k to hit j."""
        inner = F.zip_with(F.slice("gaps", k + 1, F.col("j") - k), F.slice("hits", k + 1, F.col("j") - k), lambda g, h: F.concat(g, h))
        # The last piece ends with hit j itself.
        return F.concat(F.array_join(F.slice(inner, 1, F.size(inner) - 1), ""), F.element_at(F.slice("gaps", k + 1, F.col("j") - k), -1))

    any_cue = "(?iU)" + "|".join(p for p, _, _ in cues)
    source, target = F.element_at("said", F.col("i")), F.element_at("said", F.col("j"))
    pairs = pairs.withColumn("source", source).withColumn("target", target).where(F.lower("source") != F.lower("target"))
    own_cue = F.exists(F.filter(F.sequence(F.col("i"), F.col("j")), lambda k: (k > F.col("i")) & (k < F.col("j"))), lambda k: between(k).rlike(any_cue))
    pairs = pairs.where(~own_cue).withColumn("text", between(F.col("i")))
    pairs = pairs.withColumn("r", F.coalesce(_cue(F.col("text"), cues), F.when(F.col("j") == F.col("i") + 1, _plain(F.col("source"), F.col("target"))))).where("r is not null")
    found = pairs.select("chunk_id", "document_id", "nth", "i", "j", "source", "target", "r.type", "r.description", "sentence").repartition("chunk_id")
    place = F.struct("nth", "i", "j")
    first = Window.partitionBy("chunk_id", F.lower("source"), F.lower("target"), "type").orderBy(place)
    once = found.withColumn("again", F.row_number().over(first)).where("again = 1")
    rel = once.withColumn("pos", F.row_number().over(Window.partitionBy("chunk_id").orderBy(place)) - 1)
    rel = rel.select("chunk_id", "document_id", "pos", "source", "target", "type", "description", "sentence", F.lit(0.9).alias("confidence"))
    rel = rel if told is None else rel.unionByName(told)
    s, t = slug(F.col("source")), slug(F.col("target"))
    evidence = F.struct("chunk_id", "document_id", F.col("sentence").alias("text"), "confidence")
    return rel.select(
        "chunk_id",
        "pos",
        F.concat(F.lit("rel:"), s, F.lit(":"), F.lower("type"), F.lit(":"), t).alias("id"),
        F.concat(F.lit("entity:"), s).alias("source_id"),
        F.concat(F.lit("entity:"), t).alias("target_id"),
        "type",
        "description",
        F.lit(1.0).alias("weight"),
        F.array(evidence).alias("evidence"),
        F.create_map(F.lit("source_chunk_id"), F.col("chunk_id"), F.lit("document_id"), F.col("document_id")).alias("metadata"),
    )
