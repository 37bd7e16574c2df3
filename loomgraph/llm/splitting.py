"""Splitting oversized items at natural boundaries by recursive bisection.

A text over the limit is cut at the strongest boundary near its midpoint (heading, paragraph,
line, sentence, word, and only then between characters); halves that still exceed the limit
minus the overlap are cut again; at last each piece but the first is extended to the left by
at most the overlap, to a natural boundary where there is one.

The cores of the pieces, laid end to end, are the stripped text again; no piece exceeds the
limit. Only items over the limit leave the JVM; each is cut on its own, in n log n.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left, bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.text import strip

#: Places where a new piece may start, from the strongest kind to the weakest.
BOUNDARIES = (
    re.compile(r"(?:(?<=\n)|(?<=\r))(?=#{1,6}[ \t])"),
    re.compile(r"(?:\r\n|\n|\r)[ \t]*(?:\r\n|\n|\r)\s*(?=\S)"),
    re.compile(r"(?:\r\n|\n|\r)(?=[^\r\n])"),
    re.compile(r"[.!?…。！？][\"'”’)\]]*\s+(?=\S)"),
    re.compile(r"\s+(?=\S)"),
)
#: Characters of pieces that are given out at once.
BATCH_CHARS = 32 << 20
#: How far from the midpoint a cut may lie, as a share of the stretch.
REACH = 0.25


def _joined(text: str, at: int) -> bool:
    """Whether a cut before ``at`` would part a character from its marks or a line end."""
    here, before = text[at], text[at - 1]
    return (
        unicodedata.category(here)[0] == "M"
        or here in "‍️"
        or before == "‍"
        or (before == "\r" and here == "\n")
        or 0x1F3FB <= ord(here) <= 0x1F3FF
    )


def bisect_text(text: str, limit: int, overlap: int) -> list[tuple[int, int, int]]:
    """(start, core start, end) of each piece of a text; one piece if it is within the limit."""
    n = len(text)
    if n <= limit:
        return [(0, 0, n)]
    room = max(1, limit - overlap)
    places = [[m.end() for m in b.finditer(text)] for b in BOUNDARIES]
    cuts: list[int] = []
    work = [(0, n)]
    while work:
        lo, hi = work.pop()
        if hi - lo <= room:
            cuts.append(lo)
            continue
        at = _cut(text, places, lo, hi)
        work += [(at, hi), (lo, at)]
    cuts.sort()
    return [(c if i == 0 else _reach_back(text, places, c, max(cuts[i - 1], c - overlap)), c, e) for i, (c, e) in enumerate(zip(cuts, [*cuts[1:], n]))]


def _cut(text: str, places: list[list[int]], lo: int, hi: int) -> int:
    mid, span = (lo + hi) // 2, max(1, int((hi - lo) * REACH))
    first, last = max(lo + 1, mid - span), min(hi - 1, mid + span)
    for own in places:
        i = bisect_left(own, mid)
        near = [p for p in (own[i - 1] if i else -1, own[i] if i < len(own) else -1) if first <= p <= last]
        if near:
            return min(near, key=lambda p: (abs(p - mid), p))
    for at in range(mid, last + 1):
        if not _joined(text, at):
            return at
    return mid


def _reach_back(text: str, places: list[list[int]], core: int, least: int) -> int:
    """Where the overlap of the piece at ``core`` begins: the longest that starts at a sentence
    or else a word; none if no such place lies within reach."""
    for own in (places[3], places[4]):
        i = bisect_left(own, least)
        if i < bisect_right(own, core - 1):
            return own[i]
    return core


def split_oversized(items: DataFrame, keys: list[str], text_col: str, limit: int, overlap: int) -> DataFrame:
    """Pieces of all items over ``limit`` code points: the key columns, piece (from 0), start and
    end (in the stripped text), core_start, text.

    Length counts code points without white space at both ends. Items within the limit and null
    texts give no rows; repeated rows give repeated pieces. Columns not named are ignored.
    """
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be at least 0 and less than limit")
    body = strip(F.col(text_col))
    large = (
        items.where(F.length(text_col) > limit)
        .select(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)], body.alias("body"))
        .where(F.length("body") > limit)
    )
    kinds = [large.schema[f"k{i}"].dataType.simpleString() for i in range(len(keys))]

    def cut_batches(batches):
        names = [f"k{i}" for i in range(len(keys))] + ["piece", "start", "core_start", "end", "text"]

        def packed(batch, rows, cols):
            at = pa.array(rows, pa.int64())
            own = [batch.column(f"k{i}").take(at) for i in range(len(keys))]
            return pa.RecordBatch.from_arrays(own + [pa.array(c, pa.int32()) for c in cols[:4]] + [pa.array(cols[4], pa.string())], names)

        for batch in batches:
            rows: list[int] = []
            cols: list[list] = [[], [], [], [], []]
            size = 0
            for row in range(batch.num_rows):
                text = batch.column("body")[row].as_py()
                for n, (start, core, end) in enumerate(bisect_text(text, limit, overlap)):
                    rows.append(row)
                    for c, v in zip(cols, (n, start, core, end, text[start:end])):
                        c.append(v)
                    size += end - start
                    # Far below the 2 GB that a batch of strings can hold.
                    if size > BATCH_CHARS:
                        yield packed(batch, rows, cols)
                        rows, cols, size = [], [[], [], [], [], []], 0
            if rows:
                yield packed(batch, rows, cols)

    shape = ", ".join(f"k{i} {t}" for i, t in enumerate(kinds))
    out = large.mapInArrow(cut_batches, f"{shape}, piece int, start int, core_start int, end int, text string")
    return out.select(*[F.col(f"k{i}").alias(k) for i, k in enumerate(keys)], "piece", "start", "core_start", "end", "text")


#: Limit and overlap in characters of contents and of chunk texts.
DOCUMENT_LIMIT, DOCUMENT_OVERLAP = 4000, 200
CHUNK_LIMIT, CHUNK_OVERLAP = 600, 100


def oversized_pieces(loaded_documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """Pieces of contents over 4,000 and chunk texts over 600 characters: item_kind, item_key
    and the columns of ``split_oversized``. Rows delivered again count once; a document stored
    anew with another content is cut anew."""
    docs = loaded_documents.select(F.lit("document").alias("item_kind"), F.col("document_id").alias("item_key"), F.col("content").alias("body"))
    small = chunks.select(F.lit("chunk").alias("item_kind"), F.col("chunk_id").alias("item_key"), F.col("text").alias("body"))
    own = ["item_kind", "item_key"]
    return (
        split_oversized(docs, own, "body", DOCUMENT_LIMIT, DOCUMENT_OVERLAP)
        .unionByName(split_oversized(small, own, "body", CHUNK_LIMIT, CHUNK_OVERLAP))
    )


def oversized_items(loaded_documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """item_kind, item_key of each item that had to be cut."""
    return oversized_pieces(loaded_documents, chunks).where("piece = 1").select("item_kind", "item_key").distinct()


def pieces_report(loaded_documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """What must hold of the pieces of each oversized text: item_kind, item_key, body_md5 (of the cores laid
    end to end), over (pieces above the limit) and far (overlaps above the bound)."""
    docs = loaded_documents.select(F.lit("document").alias("item_kind"), F.col("document_id").alias("item_key"), F.col("content").alias("body"))
    small = chunks.select(F.lit("chunk").alias("item_kind"), F.col("chunk_id").alias("item_key"), F.col("text").alias("body"))
    out = None
    for items, limit, overlap in ((docs, DOCUMENT_LIMIT, DOCUMENT_OVERLAP), (small, CHUNK_LIMIT, CHUNK_OVERLAP)):
        own = items.withColumn("h", F.md5("body"))
        pieces = split_oversized(own, ["item_kind", "item_key", "h"], "body", limit, overlap).dropDuplicates(["item_kind", "item_key", "h", "piece"])
        core = F.substring("text", F.col("core_start") - F.col("start") + 1, F.col("end") - F.col("core_start"))
        # Bounded by one text.
        joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("piece", core.alias("core")))), lambda x: x["core"]), "")
        one = pieces.groupBy("item_kind", "item_key", "h").agg(
            F.md5(joined).alias("body_md5"), F.count(F.when(F.length("text") > limit, 1)).alias("over"), F.count(F.when(F.col("core_start") - F.col("start") > overlap, 1)).alias("far")
        )
        out = one if out is None else out.unionByName(one)
    return out.drop("h")
