"""Canonical entities from mentions, and relations between canonical entities.

The lexicon is a parameter table (seq, canonical_id, canonical_name, type, description,
aliases); it is broadcast behind a check of its size and joined by shuffle beyond it. Order is carried by
``seq`` columns, so results do not depend on partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.text import slug, strip
from loomgraph.operators.skew import salted_join
from loomgraph.session import cut, planned_bytes

BROADCAST_BYTES = 32 << 20
#: Up to this many rows (counted, short strings each) are broadcast.
BROADCAST_IDS = 200_000


def small(df: DataFrame) -> DataFrame:
    """``df``, a table of short rows, with a broadcast hint if it is counted to be small."""
    if planned_bytes(df) > BROADCAST_BYTES:
        return df
    return F.broadcast(df) if df.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS else df


def _tail(cid: Column) -> Column:
    return F.element_at(F.split(cid, ":"), -1)


def with_seq(lexicon: DataFrame) -> DataFrame:
    """A lexicon with ``seq``; without one, the order of canonical ids."""
    if "seq" in lexicon.columns:
        return lexicon
    return lexicon.withColumn("seq", F.col("canonical_id"))


def alias_index(lexicon: DataFrame) -> DataFrame:
    """alias_key -> record of the lexicon. Ids, their last parts, aliases and names are keys in
    lower case; the last writer of a key wins. Null and blank keys are none."""
    cid = F.lower(strip(F.col("canonical_id")))
    keys = F.concat(
        F.array(cid, _tail(cid), F.concat(F.lit("entity:"), _tail(cid))),
        F.transform(F.coalesce("aliases", F.array().cast("array<string>")), lambda a: F.lower(strip(a))),
        F.array(F.lower(strip(F.col("canonical_name")))),
    )
    rows = with_seq(lexicon).select("seq", F.posexplode(keys).alias("n", "alias_key"), F.struct("canonical_id", "canonical_name", "type", "description", "aliases").alias("record"))
    return rows.where("alias_key <> ''").groupBy("alias_key").agg(F.max_by("record", F.struct("seq", "n")).alias("record"), F.min(F.struct("seq", "n")).alias("place"))


#: Tokens of a name (runs of ASCII letters and digits, any other letter alone) and what lies between.
PART = r"[a-zA-Z0-9]+|[\p{L}\p{N}&&[^\x00-\x7F]]|[^a-zA-Z0-9\p{L}\p{N}]+"
AT_ENDS = r"^[a-zA-Z0-9\p{L}\p{N}](?s:.*[a-zA-Z0-9\p{L}\p{N}])?$"


def _grams(parts: Column, longest: int) -> Column:
    """Distinct stretches of up to so many parts that begin and end with a token. ``parts`` should
    be a plain column: inside a lambda an expression is computed for each element."""
    at = F.sequence(F.lit(1), F.greatest(F.size(parts), F.lit(1)))
    spans = F.flatten(F.transform(at, lambda i: F.transform(F.sequence(F.lit(1), F.lit(longest)), lambda n: F.array_join(F.slice(parts, i, n), ""))))
    return F.array_distinct(F.filter(spans, lambda x: x.rlike(AT_ENDS)))


def resolve_mentions(mentions: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Each mention with its canonical record: the lexicon's by the whole name, else by the
    longest key (of three letters or more) that stands in the name between non-alphanumeric
    characters, else one of its own, ``entity:{type}:{slug}``.

    mentions: mention_seq, name, type, description, aliases, metadata. Keys must begin and
    end with a letter or digit. Null names give a null record; a null type counts as OTHER.
    """
    index = alias_index(lexicon)
    exact = index.select(F.col("alias_key").alias("k1"), F.col("record").alias("exact"))
    low = F.lower(strip(F.col("name")))
    named = mentions.withColumn("low", low).withColumn("type", F.coalesce("type", F.lit("OTHER")))
    hit = named.join(small(exact), F.col("low") == F.col("k1"), "left").drop("k1")
    # Containment by equality of word runs, over the distinct names that are left.
    left = hit.where("exact is null and low is not null").select("low").distinct()
    keys = index.where(F.length("alias_key") >= 3)
    # Bounded by the parts of the longest key.
    longest = keys.agg(F.max(F.size(F.regexp_extract_all("alias_key", F.lit(PART), F.lit(0))))).first()[0] or 1
    parted = left.select("low", F.regexp_extract_all("low", F.lit(PART), F.lit(0)).alias("parts"))
    runs = parted.select("low", F.explode(_grams(F.col("parts"), longest)).alias("k2"))
    held = runs.join(small(keys), F.col("k2") == F.col("alias_key"))
    sized = held.withColumn("len", F.length("k2"))
    longest_key = sized.groupBy("low").agg(F.max("len").alias("len"))
    best = sized.join(longest_key, ["low", "len"]).groupBy("low").agg(F.min_by("record", "place").alias("held"))
    full = hit.join(best.withColumnRenamed("low", "low2"), F.col("low") == F.col("low2"), "left").drop("low2")
    own = F.struct(
        F.concat(F.lit("entity:"), F.lower("type"), F.lit(":"), slug(F.col("name"))).alias("canonical_id"),
        strip(F.col("name")).alias("canonical_name"),
        F.col("type"),
        F.col("description"),
        F.coalesce("aliases", F.array().cast("array<string>")).alias("aliases"),
    )
    return full.withColumn("record", F.when(F.col("name").isNotNull(), F.coalesce("exact", "held", own))).drop("exact", "held", "low")


def canonical_entities(mentions: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Canonical entities: canonical_id, canonical_name, primary_type, description, aliases,
    source_mentions, first_seq.

    Mentions of one id are merged in the order of mention_seq: name and type of the first, all
    aliases and surface names once, the longest description (the first of equals). Distinct
    (id, name) pairs are reduced before lists are gathered, so a much-named entity moves its
    distinct names only. Mentions without a name are left out.
    """
    r = resolve_mentions(mentions, lexicon).where("record is not null").select("mention_seq", "name", "record")
    cid = F.col("record.canonical_id").alias("canonical_id")
    head = r.groupBy(cid).agg(
        F.min_by(F.struct("record.canonical_name", "record.type"), "mention_seq").alias("head"),
        F.min_by("record.description", F.struct(F.negative(F.length(F.coalesce("record.description", F.lit("")))), "mention_seq")).alias("description"),
        F.min("mention_seq").alias("first_seq"),
    )
    once = r.groupBy(cid, "name").agg(F.min("mention_seq").alias("s"))
    said = once.groupBy("canonical_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("s", "name"))), lambda x: x["name"]).alias("source_mentions"))
    alias = r.select(cid, "mention_seq", F.posexplode("record.aliases").alias("n", "a")).where("a is not null").groupBy("canonical_id", "a").agg(F.min(F.struct("mention_seq", "n")).alias("s"))
    listed = alias.groupBy("canonical_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("s", "a"))), lambda x: x["a"]).alias("aliases"))
    out = head.join(said, "canonical_id").join(listed, "canonical_id", "left")
    return out.select(
        "canonical_id",
        F.col("head.canonical_name").alias("canonical_name"),
        F.col("head.type").alias("primary_type"),
        "description",
        F.coalesce("aliases", F.array().cast("array<string>")).alias("aliases"),
        "source_mentions",
        "first_seq",
    )


def endpoint_index(lexicon: DataFrame, entities: DataFrame) -> DataFrame:
    """end_key -> canonical_id: ids, their last parts, and names, aliases and mentions in lower case,
    with blanks and with underscores. Entities override the lexicon, later ids earlier ones."""
    none = F.array().cast("array<string>")
    lex = lexicon.select(F.lit(0).alias("level"), "canonical_id", F.concat(F.array("canonical_name"), F.coalesce("aliases", none)).alias("names"))
    ent = entities.select(F.lit(1).alias("level"), "canonical_id", F.concat(F.array("canonical_name"), F.coalesce("aliases", none), F.coalesce("source_mentions", none)).alias("names"))
    rows = lex.unionByName(ent).where("canonical_id is not null")

    def forms(v: Column) -> Column:
        low = F.lower(strip(v))
        under = slug(low)
        return F.array(low, slug(low, " "), under, F.concat(F.lit("entity:"), under))

    tail = _tail(F.col("canonical_id"))
    own = F.array(F.col("canonical_id"), tail, F.concat(F.lit("entity:"), tail))
    keys = rows.select("level", "canonical_id", F.explode(F.array_distinct(F.concat(own, F.flatten(F.transform(F.filter("names", lambda n: n.isNotNull()), forms))))).alias("end_key"))
    return keys.where("end_key <> ''").groupBy("end_key").agg(F.max_by("canonical_id", F.struct("level", "canonical_id")).alias("end_id"))


def _fallback(raw: Column) -> Column:
    bare = F.regexp_replace(F.lower(strip(raw)), "^entity:(?:[a-z]+:)?", "")
    return F.concat(F.lit("entity:"), slug(bare))


def resolve_endpoints(relations: DataFrame, lexicon: DataFrame, entities: DataFrame) -> DataFrame:
    """``relations`` with canonical source_id and target_id.

    An endpoint is looked up as written, then as a name (without ``entity:``, underscores as
    blanks, lower case), then without its type in the lexicon; else it becomes an untyped id.
    Few endpoints are broadcast; of more, hot ones are salted. Null endpoints stay null.
    """
    ends = endpoint_index(lexicon, entities).select("end_key", F.lit(0).alias("table"), "end_id")
    alias = alias_index(lexicon).select(F.col("alias_key").alias("end_key"), F.lit(1).alias("table"), F.col("record.canonical_id").alias("end_id"))
    index = ends.unionByName(alias)
    # Each distinct endpoint of either side is looked up once, under all its forms in order.
    raw = F.col("raw")
    spaced = F.lower(F.regexp_replace(F.regexp_replace(raw, "entity:", ""), "_", " "))
    clean = F.lower(strip(raw))
    bare = strip(F.regexp_replace(F.regexp_replace(clean, "^entity:(?:[a-z]+:)?", ""), "_", " "))
    form = lambda key, table, rank: F.struct(key.alias("end_key"), F.lit(table).alias("table"), F.lit(rank).alias("rank"))
    raws = relations.select(F.explode(F.array("source_id", "target_id")).alias("raw")).where("raw is not null").distinct()
    forms = raws.select("raw", F.explode(F.array(form(raw, 0, 0), form(spaced, 0, 1), form(clean, 1, 2), form(bare, 1, 3))).alias("f")).select("raw", "f.*")
    hit = forms.join(index, ["end_key", "table"]).groupBy("raw").agg(F.min_by("end_id", "rank").alias("hit"))
    ids = cut(raws.join(hit, "raw", "left").select(F.col("raw").alias("raw_end"), F.coalesce("hit", _fallback(raw)).alias("new_end")))
    out = relations
    for side in ("source_id", "target_id"):
        if ids.count() <= BROADCAST_IDS:
            out = out.join(F.broadcast(ids), F.col(side) == F.col("raw_end"), "left")
        else:
            out = salted_join(out, ids, [(side, "raw_end")], "left")
        out = out.withColumn(side, F.col("new_end")).drop("raw_end", "new_end")
    return out


def relation_id(source: Column, kind: Column, target: Column) -> Column:
    part = lambda c: F.regexp_replace(F.regexp_replace(c, "entity:", ""), ":", "_")
    return F.concat(F.lit("rel:"), part(source), F.lit(":"), F.lower(kind), F.lit(":"), part(target))


def evidence_rows(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Evidence of groups of relations, one row for each piece: keys, rel_seq, n, e, in the order of
    (rel_seq, n): all of the first relation's, then each later one whose chunk the group does not
    have yet. rows: keys, rel_seq, evidence.

    No group is ever gathered, so an edge with a third of all evidence is spread over tasks.
    """
    items = rows.select(*keys, "rel_seq", F.posexplode("evidence").alias("n", "e"))
    lead = items.groupBy(*keys, F.col("e.chunk_id").alias("chunk")).agg(F.min(F.struct("rel_seq", "n", "e")).alias("x"))
    # Chunks named twice by the first relation itself stay. The join's key holds the relation, so
    # it is no hot one.
    first = rows.groupBy(*keys).agg(F.min("rel_seq").alias("rel_seq"))
    twice = items.join(first, [*keys, "rel_seq"], "left_semi").select(*keys, F.struct("rel_seq", "n", "e").alias("x"))
    return lead.select(*keys, "x").unionByName(twice).distinct().select(*keys, "x.rel_seq", "x.n", "x.e")


def merge_evidence(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The same as one list for each group, as the records of the graph hold it. Lists must fit a
    row: beyond some 100,000 pieces to an edge keep ``evidence_rows`` as a table."""
    every = evidence_rows(rows, keys).select(*keys, F.struct("rel_seq", "n", "e").alias("x"))
    return every.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["e"]).alias("evidence"))


def resolve_relations(relations: DataFrame, lexicon: DataFrame, entities: DataFrame, evidence: str = "list") -> DataFrame:
    """Merged relations between canonical entities: id, source_id, target_id, type, description,
    weight, evidence, first_seq. evidence "count": their number as n_evidence instead of the list, for
    edges of any size.

    Self-loops are dropped. Relations of one id are merged in the order of rel_seq: description of
    the first, its weight plus 0.5 for each further one, evidence by chunk. Null endpoints or
    types are left out; rows delivered again must be dropped before.
    """
    r = resolve_endpoints(relations, lexicon, entities).where("source_id <> target_id and type is not null")
    r = r.withColumn("id", relation_id(F.col("source_id"), F.col("type"), F.col("target_id")))
    head = r.groupBy("id").agg(
        F.min_by(F.struct("source_id", "target_id", "type", "description", "weight"), "rel_seq").alias("h"),
        F.count(F.lit(1)).alias("n"),
        F.min("rel_seq").alias("first_seq"),
    )
    own = r.select("id", "rel_seq", "evidence")
    if evidence == "count":
        told = evidence_rows(own, ["id"]).groupBy("id").agg(F.count(F.lit(1)).alias("evidence"))
        shown = F.coalesce("evidence", F.lit(0)).cast("int").alias("n_evidence")
    else:
        told = merge_evidence(own, ["id"])
        shown = F.coalesce("evidence", F.array().cast(relations.schema["evidence"].dataType)).alias("evidence")
    return head.join(told, "id", "left").select(
        "id",
        "h.source_id",
        "h.target_id",
        "h.type",
        "h.description",
        (F.col("h.weight") + 0.5 * (F.col("n") - 1)).alias("weight"),
        shown,
        "first_seq",
    )
