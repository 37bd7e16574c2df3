"""Encoding of a corpus with a public byte-level BPE tokenizer by corpus-level merge replay.

The corpus is encoded through its vocabulary of distinct pre-tokens ("words"):

1. every document falls into one of P parts; a scan over the documents gives the distinct
   (word, part) pairs, without moving any text;
2. the distinct words of the whole corpus are hashed into partitions; each partition keeps an
   inverted index from token pair to word positions and applies every merge of the tokenizer
   once, in rank order, touching only the neighbours of merged positions;
3. words with their ids go back to the parts that hold them, and each part's documents are
   read off its dictionary by array lookups.

Every distinct word is thus merged once in the whole corpus, however often it occurs. A part's
dictionary is bounded by the part's text, and P follows the input size. Results are a function
of each text alone, whatever the partitioning.

Null and empty texts have the empty list of ids. Texts are taken whole.
"""

from __future__ import annotations

import json
import os
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.session import planned_bytes, shuffle_width

TOKENIZER_DIR = os.environ.get("LOOMGRAPH_TOKENIZERS", "/opt/tokenizers")
TOKENIZER = "byte_bpe_50k"
#: Parquet bytes of documents for one part (texts are some three times as large in memory).
PART_BYTES = 6 << 20
#: Up to this many parts each has a task of its own; beyond it, parts are hashed to tasks.
FEW_PARTS = 2000
#: Parts of a word that one task gives their ids; a word of more parts is merged once for each so many.
WORD_PARTS = 4096

OTHER, LETTER, NUMBER, SPACE, END = range(5)
#: Suffixes that split off after an apostrophe, in the order they are tried.
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")


@lru_cache(maxsize=1)
def char_classes() -> np.ndarray:
    """Class of each code point: letters, numbers, Unicode white space, anything else."""
    first = {"L": LETTER, "N": NUMBER}
    out = np.fromiter((first.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)), np.uint8, 0x110000)
    for c in (*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000):
        out[c] = SPACE
    return out


def split_words(texts: list[str]) -> tuple[np.ndarray, bytes, np.ndarray]:
    """Pre-tokenize many texts at once.

    Returns byte offsets of the words of all texts laid end to end (n + 1 values), the bytes,
    and the number of words of each text. Words tile the texts: an apostrophe suffix, or an
    optional blank with a run of letters, of numbers or of other characters, or white space
    (whose last blank goes to what follows).
    """
    # A private END mark after each text keeps runs from crossing texts; it is cut out below.
    joined = "\0".join(texts) + "\0"
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    ends = np.cumsum(lengths + 1) - 1
    kind = char_classes()[points].copy()
    kind[ends] = END
    n = len(points)
    before = np.empty(n, np.uint8)
    before[0], before[1:] = END, kind[:-1]
    start = kind != before
    blank = points == 32
    after = np.empty(n, np.uint8)
    after[-1], after[:-1] = END, kind[1:]
    # The last of a run of white space, if more text follows: a blank opens the next word,
    # any other character stands alone.
    last = (kind == SPACE) & (after != SPACE) & (after != END)
    start |= last
    follows = np.zeros(n, bool)
    follows[1:] = last[:-1]
    start &= ~(follows & np.concatenate(([False], blank[:-1])))
    # Apostrophe suffixes: a lone apostrophe that opens a word.
    lone = np.flatnonzero((points == 39) & (kind == OTHER) & start & (after == LETTER))
    if len(lone):
        at = lambda k: points[np.minimum(lone + k, n - 1)]
        cut = np.zeros(len(lone), np.int64)
        for suffix in CONTRACTIONS:
            hit = cut == 0
            for k, c in enumerate(suffix, 1):
                hit &= at(k) == ord(c)
            cut[hit] = len(suffix)
        hit = cut > 0
        start[lone[hit] + 1] = False
        nxt = lone[hit] + 1 + cut[hit]
        start[nxt] = True
    start[ends] = False
    width = np.ones(n, np.int64)
    width += points > 0x7F
    width += points > 0x7FF
    width += points > 0xFFFF
    width[ends] = 0
    at_byte = np.cumsum(width) - width
    first = np.flatnonzero(start)
    raw = "".join(texts).encode("utf-8", "surrogatepass")
    counts = np.diff(np.searchsorted(first, np.concatenate(([0], ends + 1))))
    return np.concatenate((at_byte[first], [len(raw)])), raw, counts


def words_of(texts: list[str]) -> tuple[pa.DictionaryArray, np.ndarray]:
    """All words of the texts, dictionary-coded, and the number of words of each text."""
    offsets, raw, counts = split_words(texts)
    flat = pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(raw)]
    )
    return flat.dictionary_encode(), counts


Merges = tuple[dict[int, int], np.ndarray, list[tuple[int, int, int]]]


@lru_cache(maxsize=2)
def merges(tokenizer: str, folder: str) -> Merges:
    """Rank of each pair (left << 16 | right), ids of the 256 bytes, (left, right, merged) by rank.

    Read on the driver and sent to the executors, which need no tokenizer files (some 50,000 rows)."""
    with open(os.path.join(folder, f"{tokenizer}.json"), encoding="utf-8") as f:
        model = json.load(f)["model"]
    vocab = model["vocab"]
    # Byte-level alphabets print unprintable bytes as characters from 256 on.
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    shown = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}
    byte_ids = np.array([vocab[shown[b]] for b in range(256)], np.int32)
    table = []
    for m in model["merges"]:
        left, right = m.split(" ") if isinstance(m, str) else m
        table.append((vocab[left], vocab[right], vocab[left + right]))
    return {a << 16 | b: r for r, (a, b, _) in enumerate(table)}, byte_ids, table


def replay(words: pa.Array, model: Merges | None = None) -> pa.ListArray:
    """Ids of each word: all merges in rank order over an inverted index of pair positions."""
    rank_of, byte_ids, table = model or merges(TOKENIZER, TOKENIZER_DIR)
    words = words.cast(pa.large_binary())
    sizes = pc.binary_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    raw = np.frombuffer(b"".join(words.to_pylist()), np.uint8)
    n = len(raw)
    starts = np.cumsum(sizes) - sizes
    first = byte_ids[raw] if n else np.empty(0, np.int32)
    is_last = np.zeros(n, bool)
    is_last[(starts + sizes)[sizes > 0] - 1] = True
    index: list[list[int] | None] = [None] * len(table)
    # The initial index, grouped by pair.
    inner = np.flatnonzero(~is_last[:-1]) if n else np.empty(0, np.int64)
    pairs = first[inner].astype(np.int64) << 16 | first[inner + 1]
    order = np.argsort(pairs, kind="stable")
    heads = np.flatnonzero(np.diff(pairs[order], prepend=-1))
    for lo, hi in zip(heads, [*heads[1:], len(order)]):
        r = rank_of.get(int(pairs[order[lo]]))
        if r is not None:
            index[r] = inner[order[lo:hi]].tolist()
    tok = first.tolist()
    nxt = np.where(is_last, -1, np.arange(1, n + 1)).tolist()
    is_first = np.zeros(n, bool)
    is_first[starts[sizes > 0]] = True
    prv = np.where(is_first, -1, np.arange(-1, n - 1)).tolist()
    get = rank_of.get
    for r, (a, b, c) in enumerate(table):
        places = index[r]
        if places is None:
            continue
        index[r] = None
        if a == b:
            places.sort()
        for p in places:
            q = nxt[p]
            if q < 0 or tok[p] != a or tok[q] != b:
                continue
            tok[p] = c
            tok[q] = -1
            q = nxt[p] = nxt[q]
            if q >= 0:
                prv[q] = p
                s = get(c << 16 | tok[q])
                if s is not None:
                    if index[s] is None:
                        index[s] = [p]
                    else:
                        index[s].append(p)
            q = prv[p]
            if q >= 0:
                s = get(tok[q] << 16 | c)
                if s is not None:
                    if index[s] is None:
                        index[s] = [q]
                    else:
                        index[s].append(q)
    ids = np.array(tok, np.int32)
    alive = ids >= 0
    seen = np.concatenate(([0], np.cumsum(alive)))
    offsets = seen[np.concatenate((starts, [n]))].astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids[alive]))


def _texts(batch_column) -> list[str]:
    return ["" if t is None else t for t in batch_column.to_pylist()]


def corpus_words(parted: DataFrame) -> DataFrame:
    """(part, word) of a table (part, text), each once for a scan partition or 128 MB of words."""

    def distinct(batches):
        seen: list[pa.Table] = []
        held = 0

        def flush():
            every = pa.concat_tables(seen).combine_chunks()
            coded = every.column("word").combine_chunks().dictionary_encode()
            both = np.unique(every.column("part").to_numpy().astype(np.int64) << 32 | coded.indices.to_numpy())
            for at in range(0, len(both), 50_000):
                some = both[at : at + 50_000]
                word = coded.dictionary.take(pa.array(some & 0xFFFFFFFF)).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array((some >> 32).astype(np.int32)), word], ["part", "word"])

        for batch in batches:
            for at in range(0, batch.num_rows, 2_000):
                some = batch.slice(at, 2_000)
                coded, counts = words_of(_texts(some.column(1)))
                if not len(coded):
                    continue
                part = np.repeat(some.column(0).to_numpy(zero_copy_only=False).astype(np.int64), counts)
                both = np.unique(part << 32 | coded.indices.to_numpy())
                word = coded.dictionary.take(pa.array(both & 0xFFFFFFFF))
                seen.append(pa.table({"part": (both >> 32).astype(np.int32), "word": word}))
                held += word.nbytes + 4 * len(both)
                if held > 128 << 20:
                    yield from flush()
                    seen, held = [], 0
        if seen:
            yield from flush()

    return parted.mapInArrow(distinct, "part int, word binary")


def part_count(docs: DataFrame, part_bytes: int = PART_BYTES) -> int:
    """Parts by the planner's size; no more than 16 for each partition of the input, as sizes of
    anything but files may be mere guesses."""
    return max(4, min(-(-planned_bytes(docs) // part_bytes), 16 * docs.rdd.getNumPartitions()))


def even_labels(spark, parts: int) -> list[int]:
    """One number for each shuffle partition, so that every part gets a task of its own."""
    drawn = spark.range(parts * (8 + parts.bit_length())).select(F.col("id").cast("int").alias("id"))
    rows = drawn.groupBy(F.expr(f"pmod(hash(id), {parts})").alias("slot")).agg(F.min("id").alias("id")).collect()
    return [r["id"] for r in sorted(rows)]


def in_parts(docs: DataFrame, id_col: str, text_col: str, parts: int) -> tuple[DataFrame, int]:
    """(id, text, part) and the number of shuffle partitions. Few parts are dealt out by a hash, one for
    each task. Many are blocks of neighbouring rows of a file where the source knows these, so that
    a scan task meets few parts and gives each its words once."""
    own = [F.col(id_col).alias("id"), F.col(text_col).alias("text")]
    dealt = F.xxhash64("id", F.length("text"))
    if parts <= FEW_PARTS:
        labels = even_labels(docs.sparkSession, parts)
        chosen = F.pmod(dealt, F.lit(len(labels))).cast("int")
        return docs.select(*own).withColumn("part", F.element_at(F.array(*[F.lit(x) for x in labels]), chosen + 1)), parts
    try:
        placed = docs.select(*own, F.xxhash64("_metadata.file_path", F.floor(F.col("_metadata.row_index") / -(-docs.count() // parts))).alias("block"))
    except AnalysisException:
        placed = docs.select(*own).withColumn("block", dealt)
    return placed.select("id", "text", F.pmod("block", F.lit(parts)).cast("int").alias("part")), -(-parts // 4)


def encode_corpus(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    tokenizer: str = TOKENIZER,
    folder: str = TOKENIZER_DIR,
    lengths_only: bool = False,
) -> DataFrame:
    """``id_col`` and ``ids`` (array<int>), or ``n_ids`` (int) with ``lengths_only``.

    One row out for each row in: repeated rows and rows without an id stay. Null, empty and
    blank texts are no exception to the rules: null and empty ones have no ids. Other columns
    of ``docs`` are ignored, whatever their names.
    """
    spark = docs.sparkSession
    id_type = docs.schema[id_col].dataType.simpleString()
    parts = part_count(docs)
    parted, width = in_parts(docs, id_col, text_col, parts)
    found = corpus_words(parted.select("part", "text"))
    # All rows of a word meet, at most ``WORD_PARTS`` parts at a time.
    salts = -(-parts // WORD_PARTS)
    met = found.repartition(max(shuffle_width(spark), parts // 4), "word", F.pmod("part", F.lit(salts))).sortWithinPartitions("word")
    model = spark.sparkContext.broadcast(merges(tokenizer, folder))
    shape = "n int" if lengths_only else "ids array<int>"

    def merged(batches):
        # Large sets of words at a time: the walk over all ranks is paid once for each.
        held, count = [], 0

        def done():
            table = pa.Table.from_batches(held).combine_chunks()
            coded = table.column("word").combine_chunks().dictionary_encode()
            ids = replay(coded.dictionary, model.value)
            value = pc.list_value_length(ids).cast(pa.int32()) if lengths_only else ids
            # Scan tasks may have found a word in the same part.
            both = np.unique(table.column("part").to_numpy().astype(np.int64) << 32 | coded.indices.to_numpy())
            for at in range(0, len(both), 100_000):
                some = both[at : at + 100_000]
                take = pa.array(some & 0xFFFFFFFF)
                yield pa.RecordBatch.from_arrays(
                    [pa.array((some >> 32).astype(np.int32)), coded.dictionary.take(take), value.take(take)],
                    ["part", "word", "n" if lengths_only else "ids"],
                )

        for batch in batches:
            held.append(batch.select(["part", "word"]))
            count += batch.num_rows
            if count >= 1_000_000:
                yield from done()
                held, count = [], 0
        if held:
            yield from done()

    known = met.mapInArrow(merged, f"part int, word binary, {shape}")
    out_type = "int" if lengths_only else "array<int>"

    def read_off(texts: pa.Table, words: pa.Table) -> pa.Table:
        lookup = words.column("word").combine_chunks().cast(pa.large_binary())
        values = words.column(1 + words.column_names.index("word")).combine_chunks()
        sizes = values.to_numpy() if lengths_only else pc.list_value_length(values).to_numpy()
        out = []
        for at in range(0, texts.num_rows, 2_000):
            some = texts.slice(at, 2_000)
            coded, counts = words_of(_texts(some.column("text")))
            code = pc.index_in(coded.dictionary, value_set=lookup).to_numpy(zero_copy_only=False)[
                coded.indices.to_numpy()
            ].astype(np.int64)
            upto = np.concatenate(([0], np.cumsum(sizes[code])))
            bounds = upto[np.concatenate(([0], np.cumsum(counts)))]
            if lengths_only:
                result = pa.array(np.diff(bounds).astype(np.int32))
            else:
                result = pa.ListArray.from_arrays(
                    pa.array(bounds.astype(np.int32)), values.take(pa.array(code)).flatten()
                )
            out.append(pa.table({"id": some.column("id"), "out": result}))
        return pa.concat_tables(out) if out else pa.table({"id": texts.column("id"), "out": pa.array([], pa.int32() if lengths_only else pa.list_(pa.int32()))})

    return (
        parted.repartition(width, "part")
        .groupBy("part")
        .cogroup(known.repartition(width, "part").groupBy("part"))
        .applyInArrow(read_off, f"id {id_type}, out {out_type}")
        .select(F.col("id").alias(id_col), F.col("out").alias("n_ids" if lengths_only else "ids"))
    )


def decode_corpus(encoded: DataFrame, id_col: str = "doc_id", tokenizer: str = TOKENIZER, folder: str = TOKENIZER_DIR) -> DataFrame:
    """``id_col`` and ``text`` of (``id_col``, ids): the bytes of the ids laid end to end, as UTF-8."""
    _, byte_ids, table = merges(tokenizer, folder)
    held: dict[int, bytes] = {int(t): bytes([b]) for b, t in enumerate(byte_ids)}
    for a, b, c in table:
        held[c] = held[a] + held[b]
    sent = encoded.sparkSession.sparkContext.broadcast(held)
    id_type = encoded.schema[id_col].dataType.simpleString()

    def rows(batches):
        get = sent.value.__getitem__
        for batch in batches:
            texts = [b"".join(map(get, ids or ())).decode("utf-8", "replace") for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(id_col), pa.array(texts, pa.string())], [id_col, "text"])

    return encoded.select(id_col, "ids").mapInArrow(rows, f"`{id_col}` {id_type}, text string")
