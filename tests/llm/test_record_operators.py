import random
import re
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgraph.llm import components, names, neardup


def groups(pairs):
    up: dict[str, str] = {}

    def top(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        if a is not None and b is not None and a != b:
            x, y = top(a), top(b)
            up[max(x, y)] = min(x, y)
    return {x: top(x) for x in up}


@pytest.mark.parametrize("max_hops", [40, 3])
def test_groups_equal_union_find(spark, max_hops):
    own = random.Random(8)
    pairs = [("hub", f"s{i:03}") for i in range(60)] + [(f"c{i:03}", f"c{i + 1:03}") for i in range(40)] + [("s001", "c000")]
    pairs += [(f"r{own.randint(0, 90):02}", f"r{own.randint(0, 90):02}") for _ in range(40)]
    pairs += [("x", "x"), (None, "y"), ("s002", "hub")] + [(f"t{i:02}", f"t{i + 1:02}") for i in range(25)]
    df = spark.createDataFrame(pairs, "a string, b string")
    got = {r.id: r.group_id for r in components.connected_groups(df, max_hops=max_hops).collect()}
    assert got == groups(pairs)
    assert components.connected_groups(df.limit(0)).count() == 0


def test_entity_groups(spark):
    m = spark.createDataFrame([(" A", "b", True), ("b", "c", None), ("c", "d", False), ("e", "E ", True), ("z", None, True)], "left_id string, right_id string, is_match boolean")
    e = spark.createDataFrame([("c", ["Same ", None, " "]), ("D", ["same"]), ("e", [" "]), ("f", None), ("b", ["other"])], "canonical_id string, aliases array<string>")
    got = {tuple(r) for r in components.entity_groups(m, e).collect()}
    assert got == {("a", "a"), ("b", "a"), ("c", "c"), ("d", "c")}


def word_pairs(t):
    w = [x.lower() for x in re.findall(r"[^\W_]+", t or "")]
    return set(zip(w, w[1:]))


def planted(own, n):
    vocab = [f"w{i}" for i in range(3000)]
    out = []
    for _ in range(n):
        base = [own.choice(vocab) for _ in range(own.randint(20, 50))]
        out.append(" ".join(base))
        for _ in range(own.randint(0, 2)):
            copy = list(base)
            for _ in range(own.randint(0, 4)):
                copy[own.randrange(len(copy))] = own.choice(vocab)
            out.append("  ".join(copy).upper() if own.random() < 0.3 else ", ".join(copy))
    return out


@pytest.mark.parametrize("hot", [4096, 3])
def test_similar_pairs_equal_brute_force(spark, hot):
    own = random.Random(11)
    texts = planted(own, 60) + ["one", "", None, "two words", "Two  words!", "Ünï cödé wörds äre fine", "ünï CÖDÉ wörds äre fine"]
    chunks = spark.createDataFrame([(f"k{i:03}", t) for i, t in enumerate(texts)] + [("k000", texts[0])], "chunk_id string, text string")
    rel = spark.createDataFrame([(1, [(texts[0],), (texts[0],), (None,)]), (2, [])], "rel_seq long, evidence array<struct<text:string>>")
    want = set()
    for (i, a), (j, b) in combinations(enumerate(map(word_pairs, texts)), 2):
        if a and b and len(a & b) / len(a | b) >= 0.6:
            want.add(("chunk", f"k{i:03}", f"k{j:03}"))
    want.add(("evidence", "1#0", "1#1"))
    got = {tuple(r) for r in neardup.similar_pairs(chunks, rel, hot, 2).collect()}
    assert got == want
    classes = {r.item_key: r for r in neardup.similar_classes(chunks, rel, hot, 2).where("item_kind = 'chunk'").collect()}
    assert classes["k%03d" % texts.index("Two  words!")].copies == 2


def test_one_family_of_edited_copies_is_found_whatever_the_bucket_size(spark):
    own = random.Random(4)
    base = [f"w{own.randrange(5000)}" for _ in range(40)]
    rows = []
    for i in range(120):
        copy = list(base)
        for _ in range(own.randint(0, 5)):
            copy[own.randrange(len(copy))] = f"x{own.randrange(5000)}"
        rows.append((f"k{i:03}", " ".join(copy)))
    rows += [(f"z{i:03}", " ".join(base)) for i in range(40)]
    chunks = spark.createDataFrame(rows, "chunk_id string, text string")
    rel = spark.createDataFrame([], "rel_seq long, evidence array<struct<text:string>>")
    found = [{(r.left_key, r.right_key) for r in neardup.similar_pairs(chunks, rel, hot, 5).collect()} for hot in (4096, 3)]
    sets = {k: word_pairs(t) for k, t in rows}
    want = {(a, b) for a, b in combinations(sorted(sets), 2) if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.6}
    assert found[0] == found[1] and found[0] <= want and len(found[0]) >= 0.99 * len(want)


@pytest.mark.parametrize("hot", [4096, 3])
def test_members_that_share_only_a_hot_entry_meet(spark, hot, monkeypatch):
    monkeypatch.setattr(neardup, "SLAB", 2)
    # One common bucket and a bucket for each alone; text 0 is seen to differ in all 32 symbols.
    rows = [(f, 0 if f else -1, 0, 0, [7, 100 + f]) for f in range(40)]
    sketch = spark.createDataFrame(rows, "fp long, p1 long, p2 long, p3 int, entries array<long>")
    got = neardup.candidate_pairs(sketch, hot, 7).collect()
    assert sorted(map(tuple, got)) == list(combinations(range(1, 40), 2))


def test_no_pair_within_the_radius_is_dropped():
    own = np.random.default_rng(3)
    a = own.integers(0, 2**32, (500, neardup.SYMBOLS), dtype=np.uint32)
    b = a.copy()
    for row in range(500):
        at = own.permutation(neardup.SYMBOLS)[: row % 22]
        b[row, at] = own.integers(0, 2**32, len(at), dtype=np.uint32)
    true = (a != b).sum(1)
    seen = neardup.seen_distance(*(x ^ y for x, y in zip(neardup.shown_bits(a), neardup.shown_bits(b))))
    assert (seen <= true).all() and (seen >= true - 4).all() and (seen[true <= 21] <= neardup.RADIUS).all()
    # Pigeonhole: up to 15 errors leave a chunk with at most one, hence a common entry.
    kind = np.zeros(500, np.uint64)
    shared = (neardup._entries(a, kind) == neardup._entries(b, kind)).any(1)
    assert shared[true <= 15].all()


def damerau(a, b):
    """Unrestricted Damerau-Levenshtein, by the definition."""
    last: dict[str, int] = {}
    far = len(a) + len(b)
    d = {(-1, -1): far}
    for i in range(len(a) + 1):
        d[i, -1], d[i, 0] = far, i
    for j in range(len(b) + 1):
        d[-1, j], d[0, j] = far, j
    for i in range(1, len(a) + 1):
        col = 0
        for j in range(1, len(b) + 1):
            k, m = last.get(b[j - 1], 0), col
            cost = 1
            if a[i - 1] == b[j - 1]:
                cost, col = 0, j
            d[i, j] = min(d[i - 1, j - 1] + cost, d[i, j - 1] + 1, d[i - 1, j] + 1, d[k - 1, m - 1] + (i - k - 1) + 1 + (j - m - 1))
        last[a[i - 1]] = i
    return d[len(a), len(b)]


def test_distance_is_the_metric():
    own = random.Random(9)
    word = lambda: "".join(own.choice("abc") for _ in range(own.randint(1, 7)))
    for _ in range(40):
        ws, p = [word() for _ in range(12)], word()
        assert names.distances(ws, p).tolist() == [damerau(w, p) for w in ws]
        assert [names._within_one(w, p) for w in ws] == [damerau(w, p) <= 1 for w in ws]


def test_pair_distances_are_the_metric():
    own = random.Random(12)
    word = lambda: "".join(own.choice("abcé") for _ in range(own.randint(0, 7)))
    a, b = [word() for _ in range(150)], [word() for _ in range(150)]
    assert names.pair_distances(a, b).tolist() == [damerau(x, y) for x, y in zip(a, b)]
    (la, pa_), (lb, pb) = names.masks(a), names.masks(b)
    near = np.array([damerau(x, y) <= 1 for x, y in zip(a, b)])
    assert (np.bitwise_count(la ^ lb)[near] <= names.LETTERS_CHANGED).all() and (np.bitwise_count(pa_ ^ pb)[near] <= names.PAIRS_CHANGED).all()


def test_variants_and_fillers_are_learnt(spark):
    own = random.Random(13)
    last = ["".join(own.choice("bdfgklmnprstvz") + own.choice("aeiou") for _ in range(4)) for _ in range(60)]
    firsts = ["Charlotte", "Bartholomew", "Wilfred", "Ottoline"]
    nick = {"Charlotte": "Lottie", "Bartholomew": "Barty", "Wilfred": "Freddo", "Ottoline": "Tilly"}
    people = [(f"p{i:02}", firsts[i % 4], n) for i, n in enumerate(last)]
    ents = spark.createDataFrame([(i, f"{f} {n.title()}", "OTHER", ["x"], None) for i, f, n in people], "canonical_id string, canonical_name string, primary_type string, aliases array<string>, metadata string")
    said = [(k, f"{nick[f]} {n.title()}", None) for k, (i, f, n) in enumerate(people)] + [(100 + k, f"{f} {n.title()} Esteemed", []) for k, (i, f, n) in enumerate(people)]
    said += [(200 + k, f"{firsts[(k + 1) % 4]} {n.title()}", None) for k, (i, f, n) in enumerate(people)]
    got = {r.mention_seq: r.canonical_id for r in names.found_mentions(spark.createDataFrame(said, "mention_seq long, name string, aliases array<string>"), ents).collect()}
    assert got == {k + add: i for add in (0, 100) for k, (i, _, _) in enumerate(people)}


def test_radius_join_equals_brute_force(spark):
    own = random.Random(10)
    base = ["".join(own.choice("abcdef") for _ in range(own.randint(3, 8))) for _ in range(150)]
    typed = [w[:2] + own.choice("abcdef") + w[2 + own.randint(0, 1) :] for w in base] + base[:20] + [None]
    left, right = spark.createDataFrame([(w,) for w in typed], "word string"), spark.createDataFrame([(w,) for w in base], "word string")
    own_rows = [sorted((r.w, r.v, r.d) for r in names.radius_join(left, right, **how).collect()) for how in ({}, {"pivots": 1}, {"pivots": 5, "block": 7})]
    assert own_rows[0] == own_rows[1] == own_rows[2]
    got = {(w, v) for w, v, _ in own_rows[0]}
    want = {(a, b) for a in set(typed) - {None} for b in set(base) if a == b or (min(len(a), len(b)) >= names.MIN_LETTERS and damerau(a, b) <= 1)}
    assert got == want
    assert names.radius_join(left, right.limit(0)).count() == 0


def test_mentions_find_their_record(spark):
    records = [
        ("o1", "Riltpindror Saimsut Engineering Co", "CUSTOMER"), ("o2", "Riltpindror Saimsut Foods BV", "CUSTOMER"), ("o3", "Kedtirzeish Teltnap Insurance Ltd", "ORGANIZATION"),
        ("p1", "Alexander Diknegzux", "OTHER"), ("p2", "Anthony Feinfal Desriltjak", "OTHER"), ("p3", "Victoria Rorvilban", "OTHER"), ("x1", "Alexander Diknegzux", "PRODUCT"), ("n", None, "OTHER"),
    ]
    # A nickname is known from a recorded spelling of another Alexander.
    records = [(*r, None) for r in records] + [("p4", "Alexander Moutgaish", "OTHER", ["Moutgaish, Sasha"])]
    ents = spark.createDataFrame(records, "canonical_id string, canonical_name string, primary_type string, source_mentions array<string>")
    said = {
        1: ("RILTPINDROR ENGI", None, "o1"), 2: ("Riltpindror & Saimsut", [], None), 3: ("the customer", ["riltpindror saimsut f00ds"], "o2"), 4: ("Kedtirzeish T. Ins.", [None, ""], "o3"),
        5: ("KedtirzeishTeltnap Insurance Group", [], "o3"), 6: ("Diknegzux, Sasha", [], "p1"), 7: ("Dr. A. Diknegzúx", [], "p1"), 8: ("Desriltjak AF", [], "p2"), 9: ("Edward Rorvilban", [], None),
        10: ("victoria.rorvilbna", [], "p3"), 11: (None, None, None), 12: (" ", ["RRJ"], None), 13: ("Riltpindror Saimsut Engineering Gesellschaft mbH", [], "o1"), 14: ("Teltnap Kedtirzeish Insurance", [], "o3"),
    }
    rows = [(i, n, a) for i, (n, a, _) in said.items()] * 2
    got = {r.mention_seq: r.canonical_id for r in names.found_mentions(spark.createDataFrame(rows, "mention_seq long, name string, aliases array<string>"), ents).collect()}
    assert got == {i: want for i, (_, _, want) in said.items() if want}


def linked(spark, records, said):
    shape = "canonical_id string, canonical_name string, primary_type string, aliases array<string>, source_mentions array<string>"
    ents = spark.createDataFrame([(*r, None, None)[:5] if len(r) == 3 else r for r in records], shape)
    rows = spark.createDataFrame([(i, n, None) for i, (n, _) in enumerate(said)], "mention_seq long, name string, aliases array<string>")
    got = {r.mention_seq: r.canonical_id for r in names.found_mentions(rows, ents).collect()}
    assert got == {i: want for i, (_, want) in enumerate(said) if want}


def test_all_words_of_a_record_count(spark):
    records = [
        ("o1", "Foobarius Bartholin Consulting GmbH", "CUSTOMER"), ("o2", "Siemensis", "ORGANIZATION"), ("o3", "Quentlin Harbouria Shipping", "ORGANIZATION"),
        ("p1", "Maria del Carmen Lopezino", "OTHER"),
    ]
    said = [
        ("Foobarius Bartholin Consulting GmbH", "o1"), ("Foobarius Bartholin Consultng", "o1"), ("Foobarius Consulting", "o1"), ("Foobarius Bartholin Zeppelin", None), ("Siemensis AG", "o2"),
        ("Quentlin Harbouria", "o3"), ("Maria del Carmen Lopezino", "p1"), ("Lopezino, Maria Carmn", "p1"), ("Maria Ignatia Lopezino", None),
    ]
    linked(spark, records, said)


def test_short_names_are_found(spark):
    records = [("p1", "William Fox", "OTHER"), ("p2", "Anna Lee", "OTHER"), ("o1", "Bay Oak Foods Ltd", "CUSTOMER")]
    records += [("p3", "Robert Ng", "OTHER"), ("p4", "Anthony Lepjipvil", "OTHER")]
    said = [("Robert Ng", "p3"), ("Ng, Robert", "p3"), ("Li Ng", None), ("William Fox", "p1"), ("Lee, Anna", "p2"), ("Bay Oak Foods", "o1"), ("BayOak Foods", "o1"), ("Anna Lea", None), ("Bob Fox", None), ("A. G. Lepjipvil", "p4"), ("Lepjipvil AG", "p4")]
    linked(spark, records, said)


def test_recorded_spellings_count(spark):
    records = [
        ("o1", "Riltpindror Saimsut Foods BV", "CUSTOMER", ["RSF"], ["Oldenburger Keksfabrik", None, " "]), ("o2", "Kedtirzeish Teltnap Insurance Ltd", "CUSTOMER", None, ["Shared Former Name"]),
        ("o3", "Zistaixbit Peidsol Foods AG", "CUSTOMER", [], ["Shared Former Name"]), ("o3", "Neuenhauser Werkstatt AG", "CUSTOMER", [], []), ("o4", "Services Group", "ORGANIZATION", None, None),
    ]
    said = [
        ("rsf", "o1"), ("Oldenburger Keksfabrik", "o1"), ("Oldenburger Keksfabrk", "o1"), ("Shared Former Name", None), ("Zistaixbit Peidsol Foods", "o3"), ("Neuenhauser Werkstatt", "o3"),
        ("RSG", None), ("Services Group", "o4"),
    ]
    linked(spark, records, said)


def test_empty_and_odd_tables(spark):
    said = spark.createDataFrame([(1, "Anna Lee", None, "x"), (2, None, [None, " "], "x"), (3, "李 小龍", ["李小龍"], "x"), (4, "ab" * 2500, [], "x"), (5, "ab" * 2500 + "c", [], "x")], "mention_seq long, name string, aliases array<string>, rid string")
    ents = spark.createDataFrame([("p", "Anna Lee", "OTHER"), (None, "Anna Lee", "OTHER"), ("q", "李小龍", "other"), ("r", "...", "OTHER"), ("s", "ab" * 2500, "OTHER")], "canonical_id string, canonical_name string, primary_type string")
    assert names.found_mentions(said.limit(0), ents).count() == 0 and names.found_mentions(said, ents.limit(0)).count() == 0
    got = {r.mention_seq: r.canonical_id for r in names.found_mentions(said, ents).collect()}
    assert got[1] == "p" and got[4] == got[5] == "s" and 2 not in got
    chunks = spark.createDataFrame([("a", None), ("b", ""), (None, "two words here"), ("c", "two words here")], "chunk_id string, text string")
    rel = spark.createDataFrame([(1, None), (2, [(None,)])], "rel_seq long, evidence array<struct<text:string>>")
    assert neardup.similar_pairs(chunks, rel).count() == 0 and neardup.similar_pairs(chunks.limit(0), rel.limit(0)).count() == 0
    assert [tuple(r) for r in neardup.similar_classes(chunks, rel).collect()] == [("chunk", "c", "c", 1, 0)]
