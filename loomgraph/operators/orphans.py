"""References to records that do not exist (anti-joins by null mask).

A reference is a tuple of columns that should name a row of a parent table. References
are grouped by their null mask; every mask is anti-joined on its non-null columns only,
under the declared match semantics of SQL's MATCH clause:

* ``simple``: a reference with any null column names nothing and is never an orphan;
* ``partial``: the non-null columns must match some parent row; all null is no reference;
* ``full``: all null is no reference, a partly null one is always an orphan.

With a lifetime, parent rows only count while they exist: from <= t and (to null or > t).

Scale: parent rows are reduced to distinct (key, from, to) before any shuffle of theirs and
references carry only their columns, so texts are never moved. Keys of more than
``hot_share`` of all references (at most 1 / hot_share of them, which bounds the broadcast
list) are salted; the parent rows of these few keys are copied to every salt.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.text import key
from loomgraph.operators.skew import salted_join
from loomgraph.session import cut

MATCHES = ("simple", "partial", "full")


def orphan_references(
    refs: DataFrame,
    parents: DataFrame,
    on: dict[str, str],
    match: str = "simple",
    at: str | None = None,
    lifetime: tuple[str, str] | None = None,
    hot_share: float = 0.01,
    salts: int = 32,
) -> DataFrame:
    """Rows of ``refs`` whose reference finds no parent.

    on: reference column -> parent column, all already in comparable form.
    at, lifetime: reference time and the parent's (from, to) columns; without them every
    parent row counts at all times. A null reference time matches no limited lifetime; a null
    ``from`` never begins; a null ``to`` never ends.
    Nulls in reference columns follow ``match``; an empty parent table makes every reference
    an orphan; repeated rows of ``refs`` stay; columns of either side may clash by name, since
    only renamed parent columns enter the join. Columns of ``refs`` starting with ``__`` are
    reserved.
    """
    if match not in MATCHES:
        raise ValueError(f"match must be one of {MATCHES}")
    if (at is None) != (lifetime is None):
        raise ValueError("at and lifetime go together")
    cols = list(on)
    side = parents.select(
        *[F.col(on[c]).alias(f"__p_{i}") for i, c in enumerate(cols)],
        *([F.col(lifetime[0]).alias("__from"), F.col(lifetime[1]).alias("__to")] if lifetime else []),
    )
    if lifetime:
        side = side.where(F.col("__from").isNotNull())
    # One pass gives every reference its mask; masks that can be no orphans leave here.
    bits = sum((F.when(F.col(c).isNotNull(), 1 << i).otherwise(0) for i, c in enumerate(cols)), F.lit(0))
    whole = (1 << len(cols)) - 1
    if match == "simple":
        return _absent(refs.dropna(subset=cols), side, [(c, f"__p_{i}") for i, c in enumerate(cols)], at, bool(lifetime), hot_share, salts)
    masked = refs.withColumn("__mask", bits).where("__mask <> 0")
    if len(cols) > 1:
        masked = cut(masked)
    if match == "full":
        found = _absent(masked.where(F.col("__mask") == whole), side, [(c, f"__p_{i}") for i, c in enumerate(cols)], at, bool(lifetime), hot_share, salts)
        return found.unionByName(masked.where(F.col("__mask") != whole)).drop("__mask")
    out = None
    for mask in range(1, whole + 1):
        used = [(c, f"__p_{i}") for i, c in enumerate(cols) if mask >> i & 1]
        found = _absent(masked.where(F.col("__mask") == mask), side, used, at, bool(lifetime), hot_share, salts)
        out = found if out is None else out.unionByName(found)
    return out.drop("__mask")


def _absent(refs, side, used, at, timed, hot_share, salts) -> DataFrame:
    names = [p for _, p in used]
    lives = side.dropna(subset=names).select(*names, *(["__from", "__to"] if timed else [])).distinct()
    alive = None
    if timed:
        alive = (F.col("__from") <= F.col(at)) & (F.col("__to").isNull() | (F.col("__to") > F.col(at)))
    return salted_join(refs, lives, used, "left_anti", alive, hot_share, salts=salts)


def found_orphans(
    relationships: DataFrame,
    graph_facts: DataFrame,
    citations: DataFrame,
    entities: DataFrame,
    lexicon: DataFrame,
    chunks: DataFrame,
) -> DataFrame:
    """Orphan references of the project's tables: ref_table, ref_field, row_seq, period.

    Null or blank references refer to nothing and are left out. A row delivered again (same
    sequence number) counts once. Rows without a time have a null period and are orphans
    unless a lexicon row carries their key.
    """
    ends = relationships.select(
        F.col("rel_seq").alias("row_seq"),
        F.col("recorded_at").alias("t"),
        F.explode(
            F.array(
                F.struct(F.lit("source_id").alias("ref_field"), key(F.col("source_id")).alias("ref_key")),
                F.struct(F.lit("target_id").alias("ref_field"), key(F.col("target_id")).alias("ref_key")),
            )
        ).alias("r"),
    ).select(F.lit("relationships").alias("ref_table"), "r.ref_field", "row_seq", "t", "r.ref_key")
    facts = graph_facts.select(
        F.lit("graph_facts").alias("ref_table"),
        F.lit("evidence_chunk_id").alias("ref_field"),
        F.col("fact_seq").alias("row_seq"),
        F.col("recorded_at").alias("t"),
        key(F.col("evidence_chunk_id")).alias("ref_key"),
    )
    quotes = citations.select(
        F.lit("citations").alias("ref_table"),
        F.lit("chunk_id").alias("ref_field"),
        F.col("cit_seq").alias("row_seq"),
        F.col("cited_at").alias("t"),
        key(F.col("chunk_id")).alias("ref_key"),
    )
    always = F.lit("0001-01-01 00:00:00").cast("timestamp")
    kind = entities.schema["ingested_at"].dataType
    named = entities.select(
        key(F.col("canonical_id")).alias("k"), F.col("ingested_at").alias("f"), F.col("deleted_at").alias("u")
    ).unionByName(
        lexicon.select(
            key(F.col("canonical_id")).alias("k"), always.cast(kind).alias("f"), F.lit(None).cast(kind).alias("u")
        )
    )
    stored = chunks.select(
        key(F.col("chunk_id")).alias("k"), F.col("ingested_at").alias("f"), F.col("deleted_at").alias("u")
    )
    find = lambda refs, side: orphan_references(refs, side, {"ref_key": "k"}, "simple", "t", ("f", "u"))
    return (
        find(ends, named)
        .unionByName(find(facts.unionByName(quotes), stored))
        .select("ref_table", "ref_field", "row_seq", F.date_format("t", "yyyy-MM").alias("period"))
        .dropDuplicates(["ref_table", "ref_field", "row_seq"])
    )


def orphan_report(found: DataFrame) -> DataFrame:
    """Orphans per table, field and period."""
    return found.groupBy("ref_table", "ref_field", "period").agg(F.count(F.lit(1)).alias("orphans"))


def composite_orphans(citations: DataFrame, chunks: DataFrame, match: str) -> DataFrame:
    """cit_seq of citations whose (document_id, chunk_id) names no chunk of that document under a match
    rule. Keys are compared like keys; blank ones are null. Rows delivered again count once."""
    refs = citations.select("cit_seq", key(F.col("document_id")).alias("doc"), key(F.col("chunk_id")).alias("chunk")).dropDuplicates(["cit_seq"])
    parents = chunks.select(key(F.col("document_id")).alias("d"), key(F.col("chunk_id")).alias("c"))
    return orphan_references(refs, parents, {"doc": "d", "chunk": "c"}, match).select("cit_seq")
