import random

import pytest

from loomgraph.llm import bpe, packing, splitting, subjects

tokenizers = pytest.importorskip("tokenizers")

TEXTS = [
    "it's 'll ''s 's't  x\n\n y  ", "a b   c", "", "  ", "x'S y'RE z're'd 'de", " '", "'s", "\n 's", "12'34's", "é'll", " \n\n'tx", "<|endoftext|>", "naïve 日本語 👩‍👩‍👧 zero​width é",
    "\x00\x01 tab\there\r\n", "aaaaaaaaaaaa aaaa", "x" * 5000, "Straße ÀÉ 3½ ٣٤", None,
]


def reference():
    t = tokenizers.Tokenizer.from_file(f"{bpe.TOKENIZER_DIR}/{bpe.TOKENIZER}.json")
    t.encode_special_tokens = True
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def test_encoding_equals_the_tokenizer(spark):
    df = spark.createDataFrame([(i, t, 7) for i, t in enumerate(TEXTS)] + [(0, TEXTS[0], 8), (None, "null id", 9)], "doc_id long, text string, part int")
    want, own = reference(), bpe.encode_corpus(df)
    rows = own.collect()
    assert len(rows) == len(TEXTS) + 2
    for r in rows:
        assert r.ids == want("null id" if r.doc_id is None else TEXTS[r.doc_id])
    sizes = bpe.encode_corpus(df, lengths_only=True).collect()
    assert sorted(r.n_ids for r in sizes) == sorted(len(r.ids) for r in rows)
    assert bpe.encode_corpus(df.limit(0)).count() == 0


def test_replay_on_random_words():
    own, want = random.Random(3), reference()
    words = ["".join(own.choice("abcdehilnorstu") for _ in range(own.randint(1, 18))) for _ in range(400)]
    import pyarrow as pa

    assert bpe.replay(pa.array([w.encode() for w in words])).to_pylist() == [want(w) for w in words]


def test_parts_of_neighbouring_rows(spark, tmp_path, monkeypatch):
    docs = [(i, f"{TEXTS[i % 10]} row {i % 7}") for i in range(200)]
    spark.createDataFrame(docs, "doc_id long, text string").repartition(3).write.parquet(str(tmp_path / "d"))
    df = spark.read.parquet(str(tmp_path / "d"))
    want = {r.doc_id: r.ids for r in bpe.encode_corpus(df).collect()}
    for few, words in ((2, 4096), (2, 1)):
        monkeypatch.setattr(bpe, "FEW_PARTS", few)
        monkeypatch.setattr(bpe, "WORD_PARTS", words)
        assert {r.doc_id: r.ids for r in bpe.encode_corpus(df).collect()} == want
    # A source without row numbers has its rows dealt out by hash.
    assert {r.doc_id: r.ids for r in bpe.encode_corpus(df.where("doc_id >= 0").distinct()).collect()} == want


def test_labels_give_each_part_a_task(spark):
    labels = bpe.even_labels(spark, 37)
    tasks = spark.createDataFrame([(x,) for x in labels], "part int").repartition(37, "part").selectExpr("spark_partition_id() AS t").distinct().count()
    assert len(labels) == len(set(labels)) == tasks == 37


def test_containers_are_nearly_full(spark):
    own = random.Random(5)
    for shape, capacity in ((lambda: own.randint(1, 100), 100), (lambda: own.choice([51, 49, 34, 33, 17, 8, 3]), 100), (lambda: min(64, int(own.expovariate(0.1)) + 1), 64)):
        sizes = [shape() for _ in range(1500)]
        out = packing.pack(spark.createDataFrame(list(enumerate(sizes)), "id int, n int"), "id", "n", capacity).toPandas()
        fill = (out.end - out.start).groupby(out.container).sum()
        gaps: list[int] = []
        for s in sorted(sizes, reverse=True):
            fit = min((g for g in gaps if g >= s), default=None)
            if fit is not None:
                gaps.remove(fit)
            gaps.append((capacity if fit is None else fit) - s)
        assert fill.max() <= capacity and fill.sum() == sum(sizes) and len(out) == len(sizes)
        assert len(fill) <= 1.03 * len(gaps) + 1


def test_pack_covers_every_item_once(spark):
    own = random.Random(2)
    rows = [(i, own.choice([0, 3, 3, 3, 7, 10, 25, 40, None])) for i in range(500)] + [(1, 3), (1, 3)]
    out = packing.pack(spark.createDataFrame(rows, "id int, n int"), "id", "n", 10).toPandas()
    full = out[out.container.notna()]
    assert ((full.end - full.start).groupby(full.container).sum() <= 10).all()
    assert (out.end - out.start).sum() == sum(n or 0 for _, n in rows)
    assert out.container.isna().sum() == sum(not n for _, n in rows)
    big = full[full.id.isin([i for i, n in rows if n == 25])].sort_values(["id", "start"])
    assert (big.groupby("id").start.agg(list).map(tuple) == (0, 10, 20)).all()
    assert packing.pack(spark.createDataFrame([], "id int, n int"), "id", "n", 10).count() == 0


def test_superstep_matches_brackets_in_few_shuffles(spark):
    own = random.Random(8)
    items = [(i, 0, own.randint(26, 50), i % 5) for i in range(300)]
    gaps = [(c, own.randint(1, 100)) for c in range(150)]
    out = packing.superstep(spark.createDataFrame(items, "id int, start int, size int, b int"), spark.createDataFrame(gaps, "container bigint, gap int"), 25, 50, 5)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") <= 7
    opened = [s for _, g in gaps for s in [50] * (g // 50) + [g % 50] * (g % 50 > 25)]
    stack, taken = [], 0
    for size, slot in sorted([(s, True) for s in opened] + [(n, False) for _, _, n, _ in items], reverse=True):
        if slot:
            stack.append(size)
        elif stack:
            taken += stack.pop()
    rows = out.toPandas()
    placed = rows[rows.container.notna()]
    used = placed.groupby("container")["size"].sum()
    assert sorted(rows.id) == list(range(300)) and len(placed) == len(opened) - len(stack)
    assert all(used[c] <= dict(gaps)[c] for c in used.index) and taken == sum(opened) - sum(stack)


def test_pieces_restore_the_text():
    own = random.Random(4)
    parts = ["word ", "Sentence one. ", "\n", "\n\n", "\n# Head\n", "é̂", "x" * 50, "👍🏽", "\r\n\r\n", "- item\n"]
    for _ in range(120):
        text = "".join(own.choice(parts) for _ in range(own.randint(0, 200))).strip()
        limit, overlap = own.choice([(40, 10), (100, 0), (64, 63), (200, 50)])
        pieces = splitting.bisect_text(text, limit, overlap)
        assert "".join(text[c:e] for _, c, e in pieces) == text
        assert all(e - s <= limit and 0 <= c - s <= overlap for s, c, e in pieces)
        assert (len(pieces) > 1) == (len(text) > limit)


def test_cuts_prefer_strong_boundaries():
    text = "aa bb. cc dd " * 3 + "\n\n" + "ee ff. gg hh " * 3
    assert splitting.bisect_text(text.strip(), 60, 10)[1][1] == text.index("ee")


def test_split_oversized(spark):
    rows = [("a", "  " + "y" * 30 + "  ", 1), ("b", "y" * 31, 1), ("b", "y" * 31, 1), ("c", None, 1), ("d", " " * 99, 1)]
    out = splitting.split_oversized(spark.createDataFrame(rows, "id string, text string, piece int"), ["id"], "text", 30, 5)
    assert {r.id for r in out.collect()} == {"b"} and out.count() == 4
    with pytest.raises(ValueError):
        splitting.split_oversized(out, ["id"], "text", 5, 5)


def test_subjects_on_planted_texts(spark):
    own = random.Random(6)
    words = {"law": "court appeal statute plaintiff clause".split(), "sport": "goal match referee marathon medal".split()}
    filler = "the of in and meeting notes about some other report today".split()
    sentence = lambda s: " ".join(own.choice(words[s] if own.random() < 0.4 else filler) for _ in range(10)) + ". "
    docs, truth = [], {}
    for i in range(240):
        on = [["law"], ["sport"], ["law", "sport"]][i % 3]
        docs.append((i, "".join(sentence(on[k % len(on)]) for k in range(8))))
        truth[i] = set(on)
    docs += [(900, None), (901, ""), (902, "12 34")]
    labels = [(i, s.upper() + " ") for i in range(150) for s in truth[i]] + [(3, None), (5, "unknown")]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    lab = spark.createDataFrame(labels, "doc_id long, subject string")
    sub = spark.createDataFrame([("law",), ("sport",), (None,)], "subject string")
    got: dict[int, set] = {}
    for r in subjects.document_subjects(d, lab, sub).collect():
        got.setdefault(r.doc_id, set()).add(r.subject)
    held = range(150, 240)
    assert sum(got.get(i, set()) == truth[i] for i in held) >= 0.9 * len(held)
    assert not {900, 901, 902} & set(got)
    assert subjects.document_subjects(d, lab, sub.limit(0)).count() == 0
