"""Near-duplicate texts with small edits: a multi-index Hamming join over minhash signatures.

A text is the set of its pairs of adjacent words. Its signature has 32 symbols, each the least
value of the set under its own hash function, so two sets of similarity J differ in a symbol
with probability 1 - J; the signature distance is the number of differing symbols.

* Multi-index: a signature is split into 8 chunks of 4 symbols. Each chunk is entered under
  every way in which one of its symbols may be in error, that is under each 3 of its 4 symbols.
  By pigeonhole every pair of distance 15 or less shares an entry (16 errors are needed to put 2
  into each chunk). Pairs beyond that share one with a probability of 1 - (1 - (J^4 + 4 J^3
  (1 - J)))^8: 99.4 % at J = 0.6, 99.98 % at J = 0.7.
* Entries carry 5 bits of every symbol. Partners in a bucket whose signatures are seen to differ in
  more than ``RADIUS`` = 21 of the 32 symbols are dropped at once. What is seen never exceeds the
  true distance (equal symbols have equal bits), so no pair within distance 21 that shares an
  entry is dropped, and all pairs within 15 are kept for certain. A pair of J = 0.6 lies beyond 21
  with a probability of 8e-4. What is left is compared exactly.
* Equal sets are collapsed to one representative before any bucket is formed, so copies never
  meet each other; members are joined on again at the end.
* A bucket of more than ``HOT`` representatives is split into blocks of about ``BLOCK``, and each
  block meets itself and every other block in a task of its own. So all members of a bucket meet,
  whatever its size; no bucket is ever collected.

Words are the longest runs of Unicode letters and numbers, lower-cased. The exact check compares
sets of 32-bit hashes of word pairs: two texts of 100 pairs have a common false element with a
probability of 2e-6. Equal sets are told by a 64-bit fingerprint of their pairs and their number. Null texts and texts of fewer than two words are similar to nothing.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.operators.skew import salted_join
from loomgraph.session import cut

CHUNKS, CHUNK = 8, 4
SYMBOLS = CHUNKS * CHUNK
#: Bits of each symbol that entries carry, and in how many symbols partners may be seen to differ.
SHOWN, RADIUS = 5, 21
HOT, BLOCK = 4096, 2048
#: Rows of a block compared at once with the other block.
SLAB = 256
#: Members of one class from which on joins with it are salted.
HOT_MEMBERS = 10_000
#: Up to this many representatives in candidate pairs are broadcast to thin out the sets.
BROADCAST_ROWS = 1_000_000

M1, M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * M2
    return x ^ (x >> np.uint64(29))


@lru_cache(maxsize=1)
def _word_points() -> np.ndarray:
    return np.fromiter((unicodedata.category(chr(c))[0] in "LN" for c in range(0x110000)), bool, 0x110000)


@lru_cache(maxsize=1)
def _seeds() -> tuple[np.ndarray, np.ndarray]:
    own = np.random.Generator(np.random.PCG64(20240601))
    draw = own.integers(0, 2**63, size=(2, SYMBOLS), dtype=np.uint64)
    return draw[0], draw[1] | np.uint64(1)


def word_pairs(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(text number, 64-bit hash) of the distinct pairs of adjacent words, sorted."""
    joined = "\n".join(texts) + "\n"
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    inside = _word_points()[points]
    edge = np.flatnonzero(np.diff(inside.view(np.int8), prepend=0, append=0))
    starts, ends = edge[0::2], edge[1::2]
    if not len(starts):
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    # Words and gaps tile the text: dictionary-code all tiles, then take the words.
    width = np.ones(len(points), np.int64)
    for least in (0x7F, 0x7FF, 0xFFFF):
        width += points > least
    at = np.concatenate(([0], np.cumsum(width)))
    cuts = np.concatenate(([0], edge[edge > 0], [len(points)]))
    cuts = cuts[np.concatenate(([True], np.diff(cuts) > 0))]
    raw = joined.encode("utf-8", "surrogatepass")
    tiles = pa.LargeStringArray.from_buffers(len(cuts) - 1, pa.py_buffer(at[cuts].astype(np.int64)), pa.py_buffer(raw))
    coded = tiles.dictionary_encode()
    words = np.array([w.lower() for w in coded.dictionary.to_pylist()], dtype=object)
    hashes = pd.util.hash_array(words, categorize=False)
    code = coded.indices.to_numpy()[np.searchsorted(cuts, starts)]
    h = hashes[code]
    line_ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
    text = np.searchsorted(line_ends, starts, side="right")
    same = text[1:] == text[:-1]
    pair = _mix((h[:-1] * M1 + h[1:])[same])
    text = text[:-1][same]
    order = np.lexsort((pair, text))
    pair, text = pair[order], text[order]
    keep = np.ones(len(pair), bool)
    keep[1:] = (pair[1:] != pair[:-1]) | (text[1:] != text[:-1])
    return text[keep], pair[keep]


def signatures(pair: np.ndarray, heads: np.ndarray) -> np.ndarray:
    """Symbols (n x 32, 32 bits each) of sets laid end to end."""
    xor, mul = _seeds()
    symbols = np.empty((len(heads), SYMBOLS), np.uint32)
    for j in range(SYMBOLS):
        symbols[:, j] = np.minimum.reduceat(((pair ^ xor[j]) * mul[j]) >> np.uint64(32), heads)
    return symbols


def shown_bits(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The low bits of all symbols as planes of 32: two planes in each of the first two columns
    (64 bits), the last one in a third (32 bits)."""
    planes = [np.packbits((symbols >> k) & 1, axis=1).view(np.uint32)[:, 0].astype(np.uint64) for k in range(SHOWN)]
    high = np.uint64(32)
    return (planes[0] << high | planes[1]).view(np.int64), (planes[2] << high | planes[3]).view(np.int64), planes[4].astype(np.uint32).view(np.int32)


def seen_distance(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Symbols whose shown bits differ, from the XOR of two texts' planes."""
    wide = a.view(np.uint64) | b.view(np.uint64)
    return np.bitwise_count((wide >> np.uint64(32)).astype(np.uint32) | wide.astype(np.uint32) | c.view(np.uint32))


def _entries(symbols: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """64-bit bucket of each chunk and error position, n x 32."""
    out = np.empty((len(symbols), SYMBOLS), np.uint64)
    wide = symbols.astype(np.uint64)
    for c in range(CHUNKS):
        for e in range(CHUNK):
            acc = kind.astype(np.uint64) * M1 + np.uint64(c * CHUNK + e + 1)
            for s in range(CHUNK):
                if s != e:
                    acc = _mix(acc * M1 + wide[:, c * CHUNK + s])
            out[:, c * CHUNK + e] = acc
    return out


SHAPE = "kind string, key string, fp long, n int, p1 long, p2 long, p3 int, entries array<long>, pairs array<int>"


def sketches(items: DataFrame) -> DataFrame:
    """Sets, shown bits and buckets of (kind, key, text). ``entries``, the buckets, is null for a text
    that a batch has already given."""

    def batches(source):
        for batch in source:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            if not texts:
                continue
            text, pair = word_pairs(texts)
            if not len(text):
                continue
            heads = np.flatnonzero(np.diff(text, prepend=-1))
            rows = text[heads]
            sizes = np.diff(np.concatenate((heads, [len(text)])))
            kinds = batch.column("kind").take(pa.array(rows))
            kind = pd.util.hash_array(np.array(kinds.to_pylist(), dtype=object), categorize=False)
            fp = _mix((np.add.reduceat(_mix(pair * M1), heads) ^ kind) * M1 + sizes.astype(np.uint64)).view(np.int64)
            symbols = signatures(pair, heads)
            planes = shown_bits(symbols)
            entries = _entries(symbols, kind).view(np.int64)
            fresh = np.zeros(len(fp), bool)
            fresh[np.unique(fp, return_index=True)[1]] = True
            upto = np.concatenate(([0], np.cumsum(fresh * SYMBOLS))).astype(np.int32)
            ends = np.concatenate((heads, [len(text)])).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    kinds,
                    batch.column("key").take(pa.array(rows)),
                    pa.array(fp),
                    pa.array(sizes.astype(np.int32)),
                    *map(pa.array, planes),
                    pa.ListArray.from_arrays(pa.array(upto), pa.array(entries[fresh].ravel()), mask=pa.array(~fresh)),
                    pa.ListArray.from_arrays(pa.array(ends), pa.array((pair >> np.uint64(32)).astype(np.uint32).view(np.int32))),
                ],
                ["kind", "key", "fp", "n", "p1", "p2", "p3", "entries", "pairs"],
            )

    return items.select("kind", "key", "text").where("text is not null").mapInArrow(batches, SHAPE)


def _pairs_in(bucket: np.ndarray, fp: np.ndarray, p1: np.ndarray, p2: np.ndarray, p3: np.ndarray):
    """Partners in buckets of sorted rows that are not seen to differ in too many symbols."""
    a, b = [], []
    at = np.arange(len(fp))
    d = 1
    while len(at):
        at = at[at + d < len(fp)]
        at = at[bucket[at] == bucket[at + d]]
        if not len(at):
            break
        to = at + d
        off = seen_distance(p1[at] ^ p1[to], p2[at] ^ p2[to], p3[at] ^ p3[to])
        hit = at[(off <= RADIUS) & (fp[at] != fp[to])]
        a.append(fp[hit])
        b.append(fp[hit + d])
        d += 1
    return (np.concatenate(a), np.concatenate(b)) if a else (np.empty(0, np.int64), np.empty(0, np.int64))


def _columns(batch) -> list[np.ndarray]:
    return [batch.column(i).to_numpy(zero_copy_only=False) for i in range(batch.num_columns)]


def _meet(rows: DataFrame, hot_size: int) -> DataFrame:
    """Rows (bucket, fp, p1, p2, p3) -> (a, b, bucket): pairs, or with a null b the members of a hot bucket."""

    def find(source):
        held = None
        hot = None

        def out(a, b, bucket=None):
            n = len(a)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(a, pa.int64()),
                    pa.array(b, pa.int64()) if b is not None else pa.nulls(n, pa.int64()),
                    pa.array(bucket, pa.int64()) if bucket is not None else pa.nulls(n, pa.int64()),
                ],
                ["a", "b", "bucket"],
            )

        def whole(x):
            """Complete buckets: pairs of the small ones, members of the hot ones."""
            bucket = x[0]
            first = np.flatnonzero(np.concatenate(([True], np.diff(bucket) != 0)))
            size = np.diff(np.concatenate((first, [len(bucket)])))
            big = np.repeat(size > hot_size, size)
            if big.any():
                yield out(x[1][big], None, bucket[big])
            a, b = _pairs_in(*(c[~big] for c in x))
            if len(a):
                yield out(np.minimum(a, b), np.maximum(a, b))

        for batch in source:
            if not batch.num_rows:
                continue
            x = _columns(batch)
            if hot is not None:
                own = int(np.searchsorted(x[0], hot, side="right"))
                if own:
                    yield out(x[1][:own], None, x[0][:own])
                if own == len(x[0]):
                    continue
                x, hot = [c[own:] for c in x], None
            if held is not None:
                x = [np.concatenate(c) for c in zip(held, x)]
            # Copies of one representative stand side by side.
            keep = np.concatenate(([True], (np.diff(x[0]) != 0) | (np.diff(x[1]) != 0)))
            x = [c[keep] for c in x]
            tail = int(np.searchsorted(x[0], x[0][-1]))
            if tail:
                yield from whole([c[:tail] for c in x])
            held = [c[tail:] for c in x]
            if len(held[0]) > hot_size:
                hot = held[0][0]
                yield out(held[1], None, held[0])
                held = None
        if held is not None:
            yield from whole(held)

    return rows.repartition("bucket").sortWithinPartitions("bucket", "fp").mapInArrow(find, "a long, b long, bucket long")


def _cross(f: np.ndarray, p1: np.ndarray, p2: np.ndarray, p3: np.ndarray, split: int | None):
    """Partners, first ``split`` rows against the others, or if None all rows against each other."""
    for at in range(0, len(f) if split is None else split, SLAB):
        upto = min(at + SLAB, len(f) if split is None else split)
        base = at + 1 if split is None else split
        off = seen_distance(*((p[at:upto, None] ^ p[None, base:]) for p in (p1, p2, p3)))
        hit = (off <= RADIUS) & (f[at:upto, None] != f[None, base:])
        if split is None:
            hit &= np.arange(base, len(f))[None, :] > np.arange(at, upto)[:, None]
        i, j = np.nonzero(hit)
        if len(i):
            yield f[i + at], f[j + base]


def _meet_hot(hot: DataFrame, block: int) -> DataFrame:
    """Members (bucket, fp, p1, p2, p3) of hot buckets -> (a, b): pairs, block against block."""
    blocks = hot.groupBy("bucket").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    own = hot.join(blocks, "bucket").withColumn("own", F.pmod(F.xxhash64("fp"), "blocks").cast("int"))
    rows = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("bucket", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).cast("int").alias("side"), "fp", "p1", "p2", "p3")

    def find(source):
        held = None

        def cells(x):
            edge = np.flatnonzero((np.diff(x[0]) != 0) | (np.diff(x[1]) != 0) | (np.diff(x[2]) != 0)) + 1
            for lo, hi in zip([0, *edge], [*edge, len(x[0])]):
                own = [c[lo:hi] for c in x]
                split = None if own[1][0] == own[2][0] else int(np.searchsorted(own[3], 1))
                for a, b in _cross(*own[4:], split):
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

        for batch in source:
            if not batch.num_rows:
                continue
            x = _columns(batch)
            x = x if held is None else [np.concatenate(c) for c in zip(held, x)]
            # The last cell may go on in the next batch.
            other = np.flatnonzero((x[0] != x[0][-1]) | (x[1] != x[1][-1]) | (x[2] != x[2][-1]))
            tail = int(other[-1]) + 1 if len(other) else 0
            if tail:
                yield from cells([c[:tail] for c in x])
            held = [c[tail:] for c in x]
        if held is not None:
            yield from cells(held)

    return rows.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", "side", "fp").mapInArrow(find, "a long, b long")


def candidate_pairs(sketched: DataFrame, hot_size: int = HOT, block: int = BLOCK) -> DataFrame:
    """Distinct pairs (a, b) of representatives that share an entry and are not seen to differ in
    more than ``RADIUS`` symbols. hot_size and block change the way, never the rows."""
    own = sketched.where("entries is not null").select("fp", "p1", "p2", "p3", "entries")
    met = cut(_meet(own.select(F.explode("entries").alias("bucket"), "fp", "p1", "p2", "p3"), hot_size))
    found = met.where("b is not null").select("a", "b")
    hot = met.where("b is null").select(F.col("a").alias("fp"), "bucket").distinct()
    if not hot.isEmpty():
        shown = own.select("fp", "p1", "p2", "p3").dropDuplicates(["fp"])
        members = hot.join(shown, "fp").select("bucket", "fp", "p1", "p2", "p3")
        found = found.unionByName(_meet_hot(cut(members), block))
    return cut(found.distinct())


def _few(df: DataFrame) -> DataFrame:
    """``df``, to be broadcast if it is checked to be small enough."""
    df = cut(df)
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def similar_representatives(sketched: DataFrame, similarity: tuple[int, int] = (3, 5), hot_size: int = HOT, block: int = BLOCK) -> DataFrame:
    """(a, b) of representatives with at least the given similarity (numerator, denominator)."""
    up, down = similarity
    near = candidate_pairs(sketched, hot_size, block)
    ids = _few(near.select(F.explode(F.array("a", "b")).alias("fp")).distinct())
    # Only the sets of candidates are moved.
    sets = sketched.where("entries is not null").select("fp", "n", "pairs").join(ids, "fp", "left_semi").dropDuplicates(["fp"])
    left = sets.select(F.col("fp").alias("a"), F.col("n").alias("na"), F.col("pairs").alias("pa"))
    right = sets.select(F.col("fp").alias("b"), F.col("n").alias("nb"), F.col("pairs").alias("pb"))
    both = F.size(F.array_intersect("pa", "pb"))
    checked = near.join(left, "a").join(right, "b").withColumn("both", both)
    return checked.where(F.col("both") * down >= up * (F.col("na") + F.col("nb") - F.col("both"))).select("a", "b")


def near_duplicates(items: DataFrame, hot_size: int = HOT, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """From (kind, key, text): members (kind, key, fp), one for each row of two words or more,
    and the links (a, b) between different texts of one kind, by fp."""
    sketched = sketches(items).persist(StorageLevel.MEMORY_AND_DISK)
    links = cut(similar_representatives(sketched, hot_size=hot_size, block=block))
    members = cut(sketched.select("kind", "key", "fp").distinct())
    sketched.unpersist()
    return members, links


def text_items(chunks: DataFrame, relationships: DataFrame) -> DataFrame:
    """Chunk texts and evidence quotes as (kind, key, text). Null keys are left out."""
    quotes = relationships.select("rel_seq", F.posexplode("evidence").alias("pos", "e")).select(
        F.lit("evidence").alias("kind"), F.concat_ws("#", "rel_seq", "pos").alias("key"), F.col("e.text").alias("text")
    )
    own = chunks.select(F.lit("chunk").alias("kind"), F.col("chunk_id").alias("key"), "text")
    return own.unionByName(quotes).where("key is not null")


def similar_pairs(chunks: DataFrame, relationships: DataFrame, hot_size: int = HOT, block: int = BLOCK) -> DataFrame:
    """item_kind, left_key, right_key of all similar items; the case list asks for pairs of
    copies too, so classes of equal texts are written out as pairs here."""
    members, links = near_duplicates(text_items(chunks, relationships), hot_size, block)
    # Only members of a class that is linked or holds copies are joined on.
    copied = members.groupBy("fp").agg(F.min("key").alias("x"), F.max("key").alias("y")).where("x < y").select("fp")
    wanted = _few(links.select(F.explode(F.array("a", "b")).alias("fp")).unionByName(copied).distinct())
    own = members.join(wanted, "fp", "left_semi")
    x = own.select(F.col("kind").alias("item_kind"), F.col("key").alias("x"), F.col("fp").alias("fx"))
    y = own.select(F.col("key").alias("y"), F.col("fp").alias("fy"))
    # A class may hold a third of all texts: its members are salted against copies of the other side.
    half = cut(salted_join(x, links, [("fx", "a")], "inner", hot_rows=HOT_MEMBERS).select("item_kind", "x", "b"))
    across = salted_join(half, y, [("b", "fy")], "inner", hot_rows=HOT_MEMBERS)
    within = salted_join(x, y, [("fx", "fy")], "inner", hot_rows=HOT_MEMBERS).where("x < y")
    every = across.select("item_kind", "x", "y").unionByName(within.select("item_kind", "x", "y")).where("x <> y")
    return every.select("item_kind", F.least("x", "y").alias("left_key"), F.greatest("x", "y").alias("right_key")).distinct()


def similar_classes(chunks: DataFrame, relationships: DataFrame, hot_size: int = HOT, block: int = BLOCK) -> DataFrame:
    """One row for each item: item_kind, item_key, class_id (least key of the equal texts),
    copies and links (number of other texts it is similar to)."""
    members, links = near_duplicates(text_items(chunks, relationships), hot_size, block)
    classes = members.groupBy("fp").agg(F.min("key").alias("class_id"), F.count(F.lit(1)).alias("copies"))
    ends = links.select(F.explode(F.array("a", "b")).alias("fp")).groupBy("fp").agg(F.count(F.lit(1)).alias("links"))
    known = classes.join(ends, "fp", "left").withColumn("links", F.coalesce("links", F.lit(0)))
    return members.join(known, "fp").select(F.col("kind").alias("item_kind"), F.col("key").alias("item_key"), "class_id", "copies", "links")
