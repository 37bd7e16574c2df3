"""Variant spellings of names typed by people: metric-space partitioning under an edit metric.

Points of the space are the parts of names (people reorder and drop parts, which whole names would
not survive) and, beside them, whole names with the blanks left out. The distance is that of
Damerau and Levenshtein with unrestricted transpositions, a true metric; the radius is 1:

* pivots are chosen farthest-first from a bounded sample of the records' names; each of these
  belongs to the cell of its nearest pivot, and there to the ring of its distance d from it;
* a name of a mention at distance d from its nearest pivot is replicated to every cell whose pivot
  is within d + 2 x radius, and there to the rings that differ by at most the radius: by
  the triangle inequality this reaches all its partners;
* in a ring all names of mentions meet all names of records, in blocks, so that no ring is ever
  collected: letters and pairs of letters that only one of two names has are counted first (an edit
  changes two and six at most), and the metric decides. More pivots mean fewer meetings, never other rows.

Meetings lead to candidate records of a mention's strings, and a string names a record if each of its
words fits a word of the record: equal, within the radius, as initial, as beginning, or as a
variant. **Variants and fillers are learnt from the tables**, not listed: where a string shares a
rare word with just one record, or is recorded as a spelling of it, the words left over on both
sides are counted together; a word that mostly stands for one other word is its variant (nicknames,
abbreviations), one that stands beside anything is a filler. Name and aliases of a mention vote. A
mention that fits two records equally well is left out.
"""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.text import key
from loomgraph.operators.skew import salted_join
from loomgraph.session import cut

#: Whole names are three times as long as words, and their distances nine times as dear.
RADIUS, PIVOTS, WHOLE_PIVOTS, SAMPLE = 1, 16, 6, 1024
#: Shorter words are only matched exactly.
MIN_LETTERS = 5
#: Longer names meet by their ends instead of by cells, as distances cost the product of the lengths.
LONGEST = 100
#: Names of records in one block of a ring, and names of mentions that meet it at once.
BLOCK, SLAB = 4096, 256
#: Pairs that go to the metric together.
PAIRS_AT_ONCE = 20_000
#: Pairs of adjacent letters that one edit adds or takes at most (a swap: three each).
PAIRS_CHANGED = 6
#: Letters that one edit adds or takes at most.
LETTERS_CHANGED = 2
#: A word of more than this share of the records (and of ``COMMON_LEAST``) is common: it tells little alone.
COMMON_SHARE, COMMON_LEAST = 0.003, 5
#: Learnt words: least number of records, least share of all counts (so that at most 1 / share words
#: are learnt, whatever the tables), and the share of its records in which a variant stands for one word.
LEARN_LEAST, LEARN_SHARE, VARIANT_SHARE = 3, 2e-5, 0.25
#: What a recorded spelling counts, compared with a mention.
RECORDED = 3
#: Least score of a string that names a record.
LEAST_SCORE = 1.35

# Closed classes of words around names (titles, legal forms, function words).
TITLES = {"dr", "prof", "mr", "mrs", "ms", "miss", "mx", "herr", "frau", "ing", "dipl", "sir", "madam", "madame", "monsieur", "professor", "doctor", "jr", "sr", "phd", "mag", "rev", "hon", "esq", "don", "dona", "senor", "senora"}
LEGAL = {"co", "ag", "bv", "corp", "sa", "inc", "gmbh", "ltd", "llc", "llp", "lp", "plc", "limited", "corporation", "incorporated", "company", "nv", "kg", "ohg", "ug", "se", "oy", "oyj", "ab", "as", "aps", "spa", "srl", "sl", "sas", "sarl", "kk", "pty", "pte", "sdn", "bhd", "aktiengesellschaft", "gesellschaft", "mbh", "societe", "anonyme", "sociedad", "anonima", "societa", "besloten", "vennootschap"}
FUNCTION_WORDS = {"the", "and", "und", "et", "of", "de", "del", "der", "von", "van"}

DIGIT = str.maketrans({"0": "o", "1": "l", "5": "s", "|": "l"})
DOTTED = re.compile(r"\b(?:\w\.){2,}|\b\w\.\w\.(?:\w\.)*\w\b")


def folded(text: str) -> str:
    """Lower case, without accents."""
    plain = unicodedata.normalize("NFKD", text)
    return "".join(c for c in plain if not unicodedata.combining(c)).lower()


def name_tokens(text: str) -> list[str]:
    """Words of a name: folded, dots of abbreviations dropped, digits read as the letters they
    look like, i and l as one letter."""
    flat = folded(text).replace("'", "").replace("’", "")
    # Dotted legal forms such as G.m.b.H. become one word.
    flat = re.sub(r"\b(?:[a-z]\.\s?){2,}(?:[a-z]\b)?", lambda m: m.group().replace(".", "").replace(" ", "") + " ", flat) if _legal_dots(flat) else flat
    out = []
    for t in re.split(r"[^a-z0-9|]+", flat):
        if t:
            out.append(t.translate(DIGIT) if re.search("[a-z]", t) else t)
    return out


def _legal_dots(flat: str) -> bool:
    m = re.search(r"(?:[a-z]\.\s?){2,}(?:[a-z]\b)?", flat)
    return bool(m) and m.group().replace(".", "").replace(" ", "") in LEGAL


def skeleton(word: str) -> str:
    """A word as it is compared: l and i look alike when read, and so do rn and m."""
    return word.replace("rn", "m").replace("l", "i")


def distances(words: list[str], pivot: str) -> np.ndarray:
    """Damerau-Levenshtein distance (unrestricted) of each word to the pivot."""
    n, m = len(words), len(pivot)
    if not n:
        return np.empty(0, np.int16)
    sizes = np.fromiter(map(len, words), np.int64, n)
    top = int(sizes.max())
    letters = np.zeros((n, top), np.int32)
    for i, w in enumerate(words):
        letters[i, : len(w)] = [ord(c) for c in w]
    target = [ord(c) for c in pivot]
    far = top + m
    d = np.full((top + 2, m + 2, n), far, np.int16)
    d[1, 1:, :] = np.arange(m + 1, dtype=np.int16)[:, None]
    d[1:, 1, :] = np.arange(top + 1, dtype=np.int16)[:, None]
    row_of = {c: np.zeros(n, np.int64) for c in set(target)}
    at = np.arange(n)
    for i in range(1, top + 1):
        a = letters[:, i - 1]
        column = np.zeros(n, np.int64)
        for j in range(1, m + 1):
            c = target[j - 1]
            k, l = row_of[c], column
            same = a == c
            best = np.minimum(d[i, j] + ~same, np.minimum(d[i + 1, j], d[i, j + 1]) + 1)
            swap = d[k, l, at] + (i - k - 1) + 1 + (j - l - 1)
            d[i + 1, j + 1] = np.minimum(best, swap)
            column = np.where(same, j, column)
        for c in row_of:
            row_of[c] = np.where(a == c, i, row_of[c])
    return d[sizes + 1, m + 1, at]


def distance(a: str, b: str) -> int:
    return int(distances([a], b)[0])


def choose_pivots(sample: list[str], count: int = PIVOTS) -> list[str]:
    """Farthest-first traversal of a sample."""
    if not sample:
        return []
    chosen = [sample[0]]
    least = distances(sample, sample[0])
    while len(chosen) < min(count, len(sample)) and least.max() > 0:
        chosen.append(sample[int(least.argmax())])
        least = np.minimum(least, distances(sample, chosen[-1]))
    return chosen


def pair_distances(left: list[str], right: list[str]) -> np.ndarray:
    """Damerau-Levenshtein distance (unrestricted) of the names of each pair."""
    n = len(left)
    if not n:
        return np.empty(0, np.int16)
    code = {c: i + 2 for i, c in enumerate(sorted({c for w in (*left, *right) for c in w}))}

    def coded(words: list[str], pad: int) -> tuple[np.ndarray, np.ndarray]:
        sizes = np.fromiter(map(len, words), np.int64, n)
        out = np.full((n, max(1, int(sizes.max()))), pad, np.int64)
        for i, w in enumerate(words):
            out[i, : len(w)] = [code[c] for c in w]
        return out, sizes

    (a, na), (b, nb) = coded(left, 0), coded(right, 1)
    la, lb, at = a.shape[1], b.shape[1], np.arange(n)
    d = np.full((la + 2, lb + 2, n), la + lb, np.int16)
    d[1, 1:, :] = np.arange(lb + 1, dtype=np.int16)[:, None]
    d[1:, 1, :] = np.arange(la + 1, dtype=np.int16)[:, None]
    row = np.zeros((n, len(code) + 2), np.int64)
    for i in range(1, la + 1):
        column = np.zeros(n, np.int64)
        for j in range(1, lb + 1):
            k, l = row[at, b[:, j - 1]], column
            same = a[:, i - 1] == b[:, j - 1]
            best = np.minimum(d[i, j] + ~same, np.minimum(d[i + 1, j], d[i, j + 1]) + 1)
            d[i + 1, j + 1] = np.minimum(best, d[k, l, at] + (i - k - 1) + 1 + (j - l - 1))
            column = np.where(same, j, column)
        row[at, a[:, i - 1]] = i
    return d[na + 1, nb + 1, at]


def masks(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The letters and the pairs of adjacent letters that each name has, hashed into 64 bits each."""
    letters, pairs = np.zeros(len(words), np.uint64), np.zeros(len(words), np.uint64)
    for i, w in enumerate(words):
        codes = [ord(c) for c in w]
        one = two = 0
        for x in codes:
            one |= 1 << (x & 63)
        for x, y in zip(codes, codes[1:]):
            two |= 1 << ((x * 31 + y) & 63)
        letters[i], pairs[i] = one, two
    return letters, pairs


def radius_join(left: DataFrame, right: DataFrame, col: str = "word", pivots: int = PIVOTS, radius: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """(w, v, d): distinct names w of ``left`` and v of ``right`` within the radius.

    Null names match nothing; names of fewer than five letters match only themselves. pivots and
    block change the work, never the rows.
    """
    ours = left.select(F.col(col).alias("w")).dropna().distinct()
    theirs = right.select(F.col(col).alias("v")).dropna().distinct()
    equal = ours.join(theirs, F.col("w") == F.col("v")).select("w", "v", F.lit(0).alias("d"))
    equal = equal.unionByName(_long_names(ours, theirs, radius))
    long = theirs.where((F.length("v") >= MIN_LETTERS) & (F.length("v") <= LONGEST))
    sample = [r["v"] for r in long.orderBy(F.xxhash64("v"), "v").limit(SAMPLE).collect()]
    chosen = choose_pivots(sample, pivots)
    if not chosen:
        return equal
    # Rings that hold names of records, and their blocks: pivots x longest name at most.
    # Small to move but dear to place: not to be put together into few tasks.
    tasks = max(4, 2 * left.sparkSession.sparkContext.defaultParallelism)
    base = cut(long.repartition(tasks, F.xxhash64("v")).mapInArrow(_placer(chosen, None, radius), "word string, cell int, ring int"))
    rings = base.groupBy("cell", "ring").agg(F.count(F.lit(1)).alias("n"))
    blocks = {(r["cell"], r["ring"]): -(-r["n"] // block) for r in rings.collect()}
    table = left.sparkSession.createDataFrame([(*k, n) for k, n in blocks.items()], "cell int, ring int, blocks int")
    near = ours.where((F.length("w") >= MIN_LETTERS) & (F.length("w") <= LONGEST)).repartition(tasks, F.xxhash64("w")).mapInArrow(_placer(chosen, set(blocks), radius), "word string, cell int, ring int")
    own = base.join(F.broadcast(table), ["cell", "ring"]).select("cell", "ring", F.pmod(F.xxhash64("word"), "blocks").cast("int").alias("block"), F.lit(0).alias("side"), "word")
    asked = near.join(F.broadcast(table), ["cell", "ring"]).select("cell", "ring", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(1).alias("side"), "word")
    # Names of mentions of one block are spread over tasks as well; its names of records are bounded.
    spread = 4
    rows = own.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(spread - 1)))).unionByName(asked.withColumn("part", F.pmod(F.xxhash64("word"), F.lit(spread)).cast("int")))
    keys = ["cell", "ring", "block", "part"]
    met = rows.repartition(tasks, *keys).sortWithinPartitions(*keys, "side").mapInArrow(_meeter(radius), "w string, v string, d int")
    return equal.unionByName(met)


def _long_names(ours: DataFrame, theirs: DataFrame, radius: int) -> DataFrame:
    """The same for pairs with a name beyond ``LONGEST`` letters: an edit leaves the first or the last 40
    letters as they are, so partners share one of these."""
    if radius != 1:
        raise ValueError("names are joined within a radius of 1")
    ends = lambda df, c: df.where(F.length(c) >= LONGEST).select(c, F.explode(F.array(F.substring(c, 1, 40), F.concat(F.lit("\n"), F.expr(f"right({c}, 40)")))).alias("end"))
    met = ends(ours, "w").join(ends(theirs, "v"), "end").where((F.col("w") != F.col("v")) & (F.greatest(F.length("w"), F.length("v")) > LONGEST)).select("w", "v").distinct()

    def decided(batches):
        for batch in batches:
            keep = [_within_one(w, v) for w, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return met.mapInArrow(decided, "w string, v string").withColumn("d", F.lit(1))


def _placer(pivots: list[str], known: set | None, radius: int):
    """Rows (word, cell, ring): of the nearest cell, or of all known rings within reach."""

    def rows(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 5_000):
                words = batch.column(0).slice(at, 5_000).to_pylist()
                d = np.stack([distances(words, p) for p in pivots], axis=1)
                if known is None:
                    row, cell = np.arange(len(words)), d.argmin(1)
                    ring = d[row, cell]
                else:
                    r, c = np.nonzero(d <= d.min(1, keepdims=True) + 2 * radius)
                    row, cell, ring = (np.concatenate(x) for x in zip(*((r, c, d[r, c] + off) for off in range(-radius, radius + 1))))
                    keep = np.fromiter(((x, y) in known for x, y in zip(cell.tolist(), ring.tolist())), bool, len(row))
                    row, cell, ring = row[keep], cell[keep], ring[keep]
                yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()).take(pa.array(row)), pa.array(cell, pa.int32()), pa.array(ring, pa.int32())], ["word", "cell", "ring"])

    return rows


def _meeter(radius: int):
    """Sorted rows (cell, ring, block, side, word, part) -> (w, v, d): all of one block meet."""

    def meet(own, asked, left, right):
        """Pairs that the metric has to decide."""
        (v, (ov, mv), lv), (w, (ow, mw), lw) = own, asked
        sizes, first = np.unique(lw, return_index=True)
        for size, lo, hi in zip(sizes.tolist(), first, [*first[1:], len(w)]):
            # Lengths are distances from the empty name: a pivot that costs nothing.
            a, b = np.searchsorted(lv, [size - radius, size + radius + 1])
            for at in range(lo, hi if a < b else lo, SLAB):
                upto = min(at + SLAB, hi)
                close = np.bitwise_count(mw[at:upto, None] ^ mv[None, a:b]) <= PAIRS_CHANGED * radius
                close &= np.bitwise_count(ow[at:upto, None] ^ ov[None, a:b]) <= LETTERS_CHANGED * radius
                i, j = np.nonzero(close)
                left.extend(w[at + x] for x in i.tolist())
                right.extend(v[a + x] for x in j.tolist())

    def decided(left, right):
        d = pair_distances(left, right)
        hit = np.flatnonzero((d <= radius) & (d > 0))
        return pa.RecordBatch.from_arrays([pa.array([left[x] for x in hit], pa.string()), pa.array([right[x] for x in hit], pa.string()), pa.array(d[hit], pa.int32())], ["w", "v", "d"])

    def described(words):
        words = sorted(words, key=len)
        return words, masks(words), np.fromiter(map(len, words), np.int16, len(words))

    def rows(batches):
        at, own, words = None, None, []
        left: list[str] = []
        right: list[str] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            c = {n: batch.column(n).to_numpy(zero_copy_only=False) for n in ("cell", "ring", "block", "part", "side")}
            said = batch.column("word").to_pylist()
            edges = np.flatnonzero(np.any([np.diff(x) != 0 for x in c.values()], axis=0)) + 1
            for lo, hi in zip([0, *edges], [*edges, batch.num_rows]):
                place = tuple(int(c[n][lo]) for n in ("cell", "ring", "block", "part"))
                if place != at:
                    at, own, words = place, None, []
                if c["side"][lo] == 0:
                    words += said[lo:hi]
                    own = None
                elif words:
                    own = own or described(words)
                    meet(own, described(said[lo:hi]), left, right)
                    # The metric is paid by the call rather than by the pair.
                    if len(left) > PAIRS_AT_ONCE:
                        yield decided(left, right)
                        left, right = [], []
        if left:
            yield decided(left, right)

    return rows


def _within_one(a: str, b: str) -> bool:
    """Whether the distance is at most 1: one letter changed, added, left out or one swap."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    if len(a) < len(b):
        return a[i:] == b[i + 1 :]
    return i >= len(a) or a[i + 1 :] == b[i + 1 :] or (a[i : i + 2] == b[i : i + 2][::-1] and a[i + 2 :] == b[i + 2 :])


class Learnt:
    """What the tables tell about words: common ones, variants (said, meant) and fillers."""

    def __init__(self, common=(), variants=(), fillers=()) -> None:
        self.common, self.variants, self.fillers = frozenset(common), frozenset(variants), frozenset(fillers)


def core_words(tokens: list[str]) -> list[str]:
    """Words of a record's name without legal forms, titles and function words, if any are left."""
    return [t for t in tokens if t not in LEGAL and t not in TITLES and t not in FUNCTION_WORDS] or tokens


def _abbreviates(token: str, word: str) -> bool:
    """Letters of a long word in order, from its first on."""
    if len(token) < 3 or token[0] != word[0] or len(word) < 2 * len(token):
        return False
    rest = iter(word)
    return all(c in rest for c in token)


def word_fit(token: str, word: str, learnt: Learnt) -> float:
    """How well a word as typed fits a word of a record, from 0 to 1."""
    x, y = skeleton(token), skeleton(word)
    if x == y:
        return 1.0
    if (token, word) in learnt.variants:
        return 0.9
    if len(token) == 1:
        return (0.7 if word in learnt.common else 0.4) if token == word[0] else 0.0
    if min(len(x), len(y)) >= MIN_LETTERS - 1 and len(y) >= MIN_LETTERS and _within_one(x, y):
        return 0.8
    if len(token) >= 3 and y.startswith(x):
        return 0.8
    if word in learnt.common and token not in learnt.common:
        if _abbreviates(token, word) or (len(word) > MIN_LETTERS and token.startswith(word[:MIN_LETTERS])):
            return 0.7
        if len(token) >= 4 and token[0] == word[0] and _within_one(token, word[: len(token)]):
            return 0.7
    return 0.0


def fits(tokens: list[str], words: list[str], learnt: Learnt) -> tuple[float, list[str], list[str]]:
    """Score of a string's words as a name of the record, 0 if they are none, and the words left
    over on both sides."""
    rest = [t for t in tokens if t not in LEGAL and t not in FUNCTION_WORDS and t not in TITLES]
    left, missing, got, rare = list(rest), list(words), 0.0, False
    matched = 0

    def take(word: str, fit: float) -> None:
        nonlocal got, rare, matched
        missing.remove(word)
        got += fit
        matched += 1
        rare = rare or (fit >= 0.8 and word not in learnt.common)

    # The best fits first; two words of a name may be written as one.
    for least in (0.8, 0.3):
        for t in sorted(left, key=len, reverse=True):
            if not missing:
                break
            fit, word = max(((word_fit(t, w, learnt), w) for w in missing), key=lambda x: x[0])
            if fit >= least:
                left.remove(t)
                take(word, fit)
                continue
            joined = next(((a, b) for a in missing for b in missing if a is not b and len(t) >= len(a) + len(b) - 1 and word_fit(t, a + b, NOTHING) >= 0.8), None)
            if joined:
                left.remove(t)
                for w in joined:
                    take(w, 0.95)
    # Two letters that are initials of what is left, or of one word where no other is; at either
    # end of a name even where they spell a title or legal form.
    for t in [*left, *dict.fromkeys(x for x in (*tokens[:1], *tokens[-1:]) if x not in left)]:
        if len(t) == 2 and missing and t[0] == missing[0][0] and (len(missing) == 1 or t[1] == missing[1][0]):
            left = [x for x in left if x is not t]
            for w in missing[:2]:
                take(w, 0.6)
    strange = [t for t in left if t not in learnt.fillers]
    if not rare or got < LEAST_SCORE and not (len(words) == 1 and not missing):
        return 0.0, strange, missing
    if any(t in learnt.common for t in strange) or len(strange) > 1 or (strange and missing and matched < 3):
        return 0.0, strange, missing
    return got + (0.1 if not missing else 0.0) - 0.3 * len(strange), strange, missing


NOTHING = Learnt()


def spelled_alike(said: list[str], known: list[str]) -> float:
    """How well two spellings agree: 3 as a whole, 1.6 word by word with errors in long words."""
    if "".join(map(skeleton, said)) == "".join(map(skeleton, known)):
        return 3.0
    return 1.6 if len(said) == len(known) and all(word_fit(t, w, NOTHING) >= 0.8 for t, w in zip(said, known)) else 0.0


def _tokenized(strings: DataFrame, col: str, out: str) -> DataFrame:
    """(col, out): distinct strings with their words."""

    def rows(batches):
        for batch in batches:
            tokens = [name_tokens(s) for s in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(tokens, pa.list_(pa.string()))], [col, out])

    return strings.mapInArrow(rows, f"{col} string, {out} array<string>")


def _searched(words: DataFrame, records: int) -> DataFrame:
    """(rid, core, word) of records (rid, core): the words a record is searched by, in the form they
    are compared: its words that are not common, else its rarest one, and its first two written as one."""
    each = words.select("rid", "core", F.posexplode("core").alias("n", "t"))
    often = each.select("rid", "t").distinct().groupBy("t").agg(F.count(F.lit(1)).alias("df"))
    told = each.join(often, "t")
    rarest = told.groupBy("rid").agg(F.min("df").alias("least"))
    limit = max(COMMON_LEAST, COMMON_SHARE * records)
    own = told.join(rarest, "rid").where((F.col("df") <= limit) | (F.col("df") == F.col("least"))).select("rid", "core", "t")
    two = words.where(F.size("core") > 1).select("rid", "core", F.explode(F.array(F.concat(F.col("core")[0], F.col("core")[1]), F.concat(F.col("core")[1], F.col("core")[0]))).alias("t"))
    return own.unionByName(two).select("rid", "core", _skeleton("t").alias("word")).distinct()


def _skeleton(col: str):
    return F.translate(F.regexp_replace(col, "rn", "m"), "l", "i")


def _learn(pairs: DataFrame, recorded: DataFrame, common: frozenset) -> Learnt:
    """Variants and fillers from candidates (s, tokens, rid, core) and recorded spellings
    (tokens, rid, core).

    A string counts for the record that leaves the fewest words over, if that is one alone, and each
    record once for each pair of words, so that a much-named record tells no more than others.
    """
    known = Learnt(common)

    def rows(batches):
        for batch in batches:
            out = []
            for s, tokens, rid, core in zip(*(batch.column(n).to_pylist() for n in ("s", "tokens", "rid", "core"))):
                _, strange, missing = fits(tokens, core, known)
                said = [t for t in strange if len(t) > 1]
                out.append((s, rid, said, missing, len(said) + len(missing)))
            cols = list(zip(*out)) if out else [[]] * 5
            kinds = [pa.string(), pa.string(), pa.list_(pa.string()), pa.list_(pa.string()), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["s", "rid", "said", "missing", "n"])

    shape = "s string, rid string, said array<string>, missing array<string>, n int"
    met = pairs.select("s", "tokens", "rid", "core").mapInArrow(rows, shape)
    least = met.groupBy("s").agg(F.min("n").alias("n"), F.min_by("rid", "n").alias("one"))
    alone = met.join(least, ["s", "n"]).groupBy("s").agg(F.count(F.lit(1)).alias("c"), F.first(F.struct("rid", "said", "missing")).alias("x")).where("c = 1").select("x.*", F.lit(1).alias("times"))
    sure = recorded.select(F.lit("").alias("s"), "tokens", "rid", "core").mapInArrow(rows, shape).where("size(said) = 1 and size(missing) = 1").select("rid", "said", "missing", F.lit(RECORDED).alias("times"))
    told = alone.unionByName(sure).where("size(said) > 0").select("rid", F.explode("said").alias("t"), "missing", "times")
    once = told.select("rid", "t", F.explode_outer("missing").alias("w"), "times").groupBy("rid", "t", "w").agg(F.max("times").alias("times"))
    pairs_of = once.where("w is not null").groupBy("t", "w").agg(F.sum("times").alias("n"))
    of = told.groupBy("rid", "t").agg(F.max("times").alias("times")).groupBy("t").agg(F.sum("times").alias("all"))
    total = of.agg(F.sum("all")).first()[0] or 0
    enough = max(LEARN_LEAST, LEARN_SHARE * total)
    counted = cut(of.where(F.col("all") >= enough).join(pairs_of.where(F.col("n") >= enough), "t", "left"))
    variants = counted.where(F.col("n") >= VARIANT_SHARE * F.col("all")).select("t", "w").collect()
    pointing = {r["t"] for r in variants}
    fillers = {r["t"] for r in counted.select("t").distinct().collect()} - pointing - common
    return Learnt(common, {(r["t"], r["w"]) for r in variants if r["t"] not in common or r["w"] not in common}, fillers)


def found_mentions(entity_mentions: DataFrame, entities: DataFrame) -> DataFrame:
    """mention_seq, canonical_id: the organisation or person a mention means.

    Names and aliases vote, whatever the mention's type says. Null, blank and empty names say
    nothing; rows delivered again count once; a mention without a fitting record, or with two
    that fit equally well, gives no row. Names, aliases and source mentions recorded for a record
    are spellings of it, whole or with one error.
    """
    own = entities.where(F.upper("primary_type").isin("CUSTOMER", "ORGANIZATION", "OTHER"))
    # A record that was ingested anew under another name has both.
    named = own.select(F.col("canonical_id").alias("rid"), F.col("canonical_name").alias("k")).dropna().where(key(F.col("k")).isNotNull()).distinct()
    words_of = _tokenized(named.select("k").distinct(), "k", "known")

    def cored(batches):
        for batch in batches:
            core = [core_words(t) for t in batch.column("known").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("rid"), pa.array(core, pa.list_(pa.string()))], ["rid", "core"])

    cores = cut(named.join(words_of, "k").where("size(known) > 0").select("rid", "known").mapInArrow(cored, "rid string, core array<string>").distinct())
    records = cores.select("rid").distinct().count()
    often = cores.select("rid", F.explode("core").alias("t")).distinct().groupBy("t").agg(F.count(F.lit(1)).alias("df"))
    # At most words per name / COMMON_SHARE words.
    common = frozenset(r["t"] for r in often.where(F.col("df") > max(COMMON_LEAST - 1, COMMON_SHARE * records)).select("t").collect())
    posts = cut(_searched(cores, records))

    none = F.array().cast("array<struct<weight:double,s:string>>")
    every = F.concat(F.array(F.struct(F.lit(1.5).alias("weight"), F.col("name").alias("s"))), F.coalesce(F.transform("aliases", lambda x: F.struct(F.lit(1.0).alias("weight"), x.alias("s"))), none))
    said = entity_mentions.select("mention_seq", F.explode(every).alias("x")).select("mention_seq", "x.weight", "x.s").where(key(F.col("s")).isNotNull()).groupBy("mention_seq", "s").agg(F.max("weight").alias("weight"))
    tokens = cut(_tokenized(said.select("s").distinct(), "s", "tokens"))

    # Names count in full, other recorded spellings for less.
    listed = [F.transform(c, lambda x: F.struct(x.alias("k"), F.lit(2.0).alias("most"))) for c in ("aliases", "source_mentions") if c in own.columns]
    names_of = F.array(F.struct(F.col("canonical_name").alias("k"), F.lit(3.0).alias("most")))
    spellings = F.concat(names_of, *[F.coalesce(x, F.array().cast("array<struct<k:string,most:double>>")) for x in listed])
    recorded = own.select(F.col("canonical_id").alias("rid"), F.explode(spellings).alias("x")).select("rid", "x.k", "x.most").dropna().where(key(F.col("k")).isNotNull())
    recorded = recorded.groupBy("rid", "k").agg(F.max("most").alias("most"))
    known = cut(recorded.join(_tokenized(recorded.select("k").distinct(), "k", "known"), "k"))

    spoken = tokens.select("s", "tokens", F.explode("tokens").alias("t")).withColumn("word", _skeleton("t")).select("s", "tokens", "word").distinct()
    matches = cut(radius_join(spoken, posts).select("w", "v"))
    # Words of many records or many strings are salted.
    heard = cut(salted_join(spoken.select("s", "word"), matches, [("word", "w")], "inner").select("s", "v").distinct())
    met = salted_join(heard, posts, [("v", "word")], "inner").select("s", "rid", "core").distinct()
    pairs = cut(met.join(tokens, "s").select("s", "tokens", "rid", "core"))
    learnt = _learn(pairs, known.join(cores, "rid").select(F.col("known").alias("tokens"), "rid", "core"), common)
    model = entities.sparkSession.sparkContext.broadcast(learnt)

    def judged(batches):
        for batch in batches:
            scores = [fits(t, c, model.value)[0] for t, c in zip(batch.column("tokens").to_pylist(), batch.column("core").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("s"), batch.column("rid"), pa.array(scores, pa.float64())], ["s", "rid", "score"]).filter(pa.array([x > 0 for x in scores], pa.bool_()))

    good = pairs.mapInArrow(judged, "s string, rid string, score double").groupBy("s", "rid").agg(F.max("score").alias("score"))

    # Whole spellings meet under the same radius, with the blanks left out.
    whole = lambda c: F.array_join(F.transform(c, lambda t: F.translate(F.regexp_replace(t, "rn", "m"), "l", "i")), "")
    uttered = tokens.withColumn("word", whole("tokens")).where("word <> ''")
    written = known.withColumn("v", whole("known")).where("v <> ''")
    near = cut(radius_join(uttered, written.withColumnRenamed("v", "word"), pivots=WHOLE_PIVOTS).select("w", F.col("v").alias("v2")))
    echoed = cut(salted_join(uttered.select("s", "word"), near, [("word", "w")], "inner").select("s", "v2").distinct())
    alike = salted_join(echoed, written, [("v2", "v")], "inner").select("s", "rid", "known", "most").distinct().join(tokens, "s")

    def compared(batches):
        for batch in batches:
            c = {n: batch.column(n).to_pylist() for n in ("tokens", "known", "most")}
            scores = [min(spelled_alike(t, k), most) for t, k, most in zip(*c.values())]
            yield pa.RecordBatch.from_arrays([batch.column("s"), batch.column("rid"), pa.array(scores, pa.float64())], ["s", "rid", "score"]).filter(pa.array([x > 0 for x in scores], pa.bool_()))

    spelled = alike.mapInArrow(compared, "s string, rid string, score double")
    # The better of the two ways.
    good = good.unionByName(spelled).groupBy("s", "rid").agg(F.max("score").alias("score"))
    votes = said.join(good, "s").groupBy("mention_seq", "rid").agg(F.round(F.sum(F.col("weight") * F.col("score")), 6).alias("score"))
    best = votes.groupBy("mention_seq").agg(F.max("score").alias("score"))
    top = votes.join(best, ["mention_seq", "score"]).groupBy("mention_seq").agg(F.count(F.lit(1)).alias("n"), F.min("rid").alias("canonical_id"))
    return top.where("n = 1").select("mention_seq", "canonical_id")
