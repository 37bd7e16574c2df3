"""Structure-aware chunks of documents, as folds of native expressions inside a row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.text import SENTENCE_GAP, SPACE, squeeze, strip, words
from loomgraph.schema import ACCESS_TIERS
from loomgraph.settings import Settings, get_settings

# Words that hint at entities, one regex for each family.
HINTS = (
    r"\bProduct\s+(Nova|Orion|Atlas|Vega)\b",
    r"\b(Identity\s+Service|Policy\s+Engine|Gateway\s+Service|Data\s+Anonymization\s+Service|Billing\s+Engine|Authz\s+Service)\b",
    r"\b(Acme\s+Corp|Globex\s+Corp|Initech)\b",
    r"\b(OAuth\s+2\.[01]|PASETO|JWT|Ed25519|PKCE|mTLS|SAML|RBAC|ABAC|SOC2|GDPR|CCPA)\b",
    r"\b(AWS|Azure|Kubernetes|EKS|AKS|Kafka|PostgreSQL|Aurora)\b",
    r"\b(Version\s+3\.[012]|INC-402)\b",
)



def _empty() -> Column:
    return F.array().cast("array<string>")


def _state(out: Column, buf: Column, size: Column) -> Column:
    return F.struct(out.alias("out"), buf.alias("buf"), size.cast("int").alias("size"))


def pack_sentences(paragraph: Column, limit: int, overlap: int) -> Column:
    """Pieces of an oversized paragraph: whole sentences, one blank apart, each piece led by the
    last sentences of the one before that fit the overlap. A sentence over the limit stays whole."""
    parts = F.filter(F.transform(F.split(paragraph, SENTENCE_GAP), strip), lambda s: s != "")

    def tail(buf: Column) -> Column:
        start = F.struct(_empty().alias("kept"), F.lit(0).alias("size"), F.lit(False).alias("full"))

        def step(s: Column, x: Column) -> Column:
            size = (s["size"] + F.length(x) + 1).cast("int")
            fits = ~s["full"] & (size <= overlap)
            return F.struct(
                F.when(fits, F.concat(F.array(x), s["kept"])).otherwise(s["kept"]).alias("kept"),
                F.when(fits, size).otherwise(s["size"]).alias("size"),
                (s["full"] | ~fits).alias("full"),
            )

        return F.aggregate(F.reverse(buf), start, step, lambda s: s["kept"])

    def step(s: Column, x: Column) -> Column:
        kept = F.concat(tail(s["buf"]), F.array(x))
        total = F.aggregate(kept, F.lit(0), lambda n, y: (n + F.length(y) + 1).cast("int"))
        over = (s["size"] + F.length(x) + 1 > limit) & (F.size(s["buf"]) > 0)
        return F.when(over, _state(F.concat(s["out"], F.array(F.array_join(s["buf"], " "))), kept, total)).otherwise(
            _state(s["out"], F.concat(s["buf"], F.array(x)), s["size"] + F.length(x) + 1)
        )

    done = lambda s: F.when(F.size(s["buf"]) > 0, F.concat(s["out"], F.array(F.array_join(s["buf"], " ")))).otherwise(s["out"])
    return F.aggregate(parts, _state(_empty(), _empty(), F.lit(0)), step, done)


def pack_paragraphs(text: Column, limit: int, overlap: int, least: int) -> Column:
    """Pieces of a section: paragraphs packed up to the limit, oversized ones by sentences; a
    last piece below ``least`` joins the one before if both stay within 1.2 limits."""
    paragraphs = F.filter(F.transform(F.split(strip(text), rf"\n[{SPACE}]*\n"), strip), lambda p: p != "")
    joined = lambda s: F.array(F.array_join(s["buf"], "\n\n"))
    flushed = lambda s: F.when(F.size(s["buf"]) > 0, F.concat(s["out"], joined(s))).otherwise(s["out"])

    def step(s: Column, p: Column) -> Column:
        n = F.length(p)
        large = _state(F.concat(flushed(s), pack_sentences(p, limit, overlap)), _empty(), F.lit(0))
        turn = _state(F.concat(s["out"], joined(s)), F.array(p), n)
        more = _state(s["out"], F.concat(s["buf"], F.array(p)), s["size"] + n + 2)
        over = (s["size"] + n + 2 > limit) & (F.size(s["buf"]) > 0)
        return F.when(n > limit, large).when(over, turn).otherwise(more)

    def done(s: Column) -> Column:
        last = F.array_join(s["buf"], "\n\n")
        before = F.try_element_at(s["out"], F.lit(-1))
        glue = (F.length(last) < least) & (F.size(s["out"]) > 0) & (F.length(before) + F.length(last) + 2 <= limit * 1.2)
        merged = F.concat(F.slice(s["out"], 1, F.greatest(F.size(s["out"]) - 1, F.lit(0))), F.array(F.concat(before, F.lit("\n\n"), last)))
        return F.when(F.size(s["buf"]) == 0, s["out"]).when(glue, merged).otherwise(F.concat(s["out"], F.array(last)))

    return F.aggregate(paragraphs, _state(_empty(), _empty(), F.lit(0)), step, done)


def access_tier(col: Column) -> Column:
    """One of the four tiers, whatever the case and padding; anything else is Internal."""
    low = F.lower(strip(col))
    out = F.lit("Internal")
    for tier in ACCESS_TIERS:
        out = F.when(low == tier.lower(), F.lit(tier)).otherwise(out)
    return out


def entity_hints(text: Column, patterns: tuple[str, ...] = HINTS) -> Column:
    """Distinct surface forms that match a pattern, white space squeezed, in code point order."""
    found = F.flatten(F.array(*[F.regexp_extract_all(text, F.lit("(?iU)" + p), F.lit(0)) for p in patterns]))
    return F.array_sort(F.array_distinct(F.transform(found, lambda x: squeeze(strip(x)))))


def enriched(text: Column, patterns: tuple[str, ...] = HINTS) -> dict[str, Column]:
    """Counted and detected fields of a chunk's metadata."""
    return {
        "char_count": F.length(text),
        "word_count": F.size(words(text)),
        "estimated_tokens": F.greatest(F.lit(1), F.floor(F.length(text) / 4)).cast("int"),
        "entity_hints": entity_hints(text, patterns),
    }


def chunk_documents(docs: DataFrame, settings: Settings | None = None, patterns: tuple[str, ...] = HINTS) -> DataFrame:
    """Chunks of parsed documents: chunk_id, document_id, text, index, metadata.

    ``docs`` needs document_id, title, department, access_tier, version, content, sections and
    metadata. Documents without sections are packed as a whole; null or blank ones give no
    chunk. Documents delivered again give their chunks again.
    """
    s = settings or get_settings()
    whole = F.array(F.struct(F.lit(1).alias("level"), F.col("title").alias("title"), F.coalesce("content", F.lit("")).alias("content"), F.col("title").alias("path")))
    parts = F.when(F.size("sections") > 0, F.col("sections")).otherwise(whole)
    pieces = F.flatten(
        F.transform(
            parts,
            lambda x: F.transform(
                pack_paragraphs(x["content"], s.chunk_size, s.chunk_overlap, s.min_chunk_size),
                lambda t: F.struct(t.alias("text"), x["title"].alias("section_title"), x["path"].alias("section_path")),
            ),
        )
    )
    rows = docs.select("*", F.posexplode(pieces).alias("pos", "piece")).withColumn("text", strip(F.col("piece.text"))).where("text <> ''")
    # Numbers below 100 are padded, larger ones are not cut.
    number = F.format_string("%03d", F.col("pos") + 1)
    meta = F.struct(
        "document_id",
        "title",
        "department",
        access_tier(F.col("access_tier")).alias("access_tier"),
        "version",
        F.col("piece.section_title").alias("section_title"),
        F.col("piece.section_path").alias("section_path"),
        *[c.alias(n) for n, c in enriched(F.col("text"), patterns).items()],
        F.col("metadata").alias("custom_attributes"),
    )
    return rows.select(
        F.concat(F.lit("chunk_"), "document_id", F.lit("_"), number).alias("chunk_id"),
        "document_id",
        "text",
        (F.col("pos") + 1).alias("index"),
        meta.alias("metadata"),
    )
