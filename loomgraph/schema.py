"""Record types, enumerations and checks of records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Enumerations of the data model.
ENTITY_TYPES = ("PRODUCT", "SERVICE", "CUSTOMER", "TECHNOLOGY", "VERSION", "INCIDENT", "POLICY", "PLAN", "ORGANIZATION", "CONCEPT", "OTHER")
RELATION_TYPES = ("USES", "DEPENDS_ON", "SUPPORTS", "AFFECTS", "INTRODUCED_IN", "PART_OF", "DEPLOYS_TO", "INTEGRATES_WITH", "COMPLIES_WITH", "OWNED_BY", "RELATED_TO")
INTENTS = ("DIRECT_FACT", "ENTITY_LOOKUP", "RELATIONSHIP", "MULTI_HOP", "GLOBAL", "COMPARISON", "NO_ANSWER")
STRATEGIES = ("vector", "graph", "hybrid", "multi_hop", "global")
ACCESS_TIERS = ("Public", "Internal", "Confidential", "Restricted")
#: Edges that hold the graph together and are no relations between entities.
STRUCTURAL = ("PART_OF", "MENTIONS")

SECTION = "struct<level:int,title:string,content:string,path:string>"
EVIDENCE = "struct<chunk_id:string,document_id:string,text:string,confidence:double>"
LINKED = "struct<raw_mention:string,canonical_id:string,canonical_name:string,entity_type:string,confidence:double>"

CHECKS = {
    "sections": "level BETWEEN 1 AND 6",
    "evidence": "confidence BETWEEN 0 AND 1",
    "relationships": "weight >= 0 AND forall(evidence, e -> e.confidence IS NULL OR e.confidence BETWEEN 0 AND 1)",
    "linked": "confidence BETWEEN 0 AND 1",
    "plans": "max_hops BETWEEN 1 AND 5 AND top_k >= 1",
}


def validate(df: DataFrame, kind: str) -> DataFrame:
    """``df`` unchanged; a row that breaks the check of its kind ends the query with an error.

    Nulls pass, as for absent values.
    """
    rule = F.expr(CHECKS[kind])
    failed = F.raise_error(F.concat(F.lit(f"{kind}: "), F.to_json(F.struct("*")))).cast("boolean")
    return df.where(F.when(F.coalesce(rule, F.lit(True)), F.lit(True)).otherwise(failed))


def invalid(df: DataFrame, kind: str) -> DataFrame:
    """Rows that break the check of their kind."""
    return df.where(~F.coalesce(F.expr(CHECKS[kind]), F.lit(True)))
