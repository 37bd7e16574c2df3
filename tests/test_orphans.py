from datetime import datetime

import pytest
from pyspark.sql import functions as F

from loomgraph.operators.orphans import found_orphans, orphan_references, orphan_report
from loomgraph.operators.skew import salted_join


def ids(df):
    return sorted(r["i"] for r in df.collect())


@pytest.fixture(scope="module")
def sides(spark):
    refs = spark.createDataFrame([(1, "a", "x"), (2, "a", None), (3, None, "z"), (4, None, None), (5, "b", "x"), (5, "b", "x")], "i int, p string, q string")
    parents = spark.createDataFrame([("a", "x", 0), ("a", "y", 0), (None, "z", 0)], "p string, q string, i int")
    return refs, parents


def test_simple_skips_partly_null_references(sides):
    refs, parents = sides
    assert ids(orphan_references(refs, parents, {"p": "p", "q": "q"})) == [5, 5]


def test_partial_matches_the_columns_that_are_there(sides):
    refs, parents = sides
    # z only stands in a parent row with a null first column, which still matches on q alone.
    assert ids(orphan_references(refs, parents, {"p": "p", "q": "q"}, "partial")) == [5, 5]
    other = parents.where("q <> 'z'")
    assert ids(orphan_references(refs, other, {"p": "p", "q": "q"}, "partial")) == [3, 5, 5]


def test_full_rejects_partly_null_references(sides):
    refs, parents = sides
    assert ids(orphan_references(refs, parents, {"p": "p", "q": "q"}, "full")) == [2, 3, 5, 5]


def test_empty_tables(sides):
    refs, parents = sides
    assert ids(orphan_references(refs, parents.limit(0), {"p": "p"})) == [1, 2, 5, 5]
    assert ids(orphan_references(refs.limit(0), parents, {"p": "p"})) == []
    with pytest.raises(ValueError):
        orphan_references(refs, parents, {"p": "p"}, "some")


def test_lifetimes(spark):
    t = lambda day: datetime(2024, 1, day)
    refs = spark.createDataFrame([(1, "a", t(1)), (2, "a", t(2)), (3, "a", t(4)), (4, "a", t(6)), (5, "a", None)], "i int, p string, t timestamp")
    rows = [("a", t(2), t(4)), ("a", t(5), None), ("a", None, None)]
    parents = spark.createDataFrame(rows, "p string, f timestamp, u timestamp")
    assert ids(orphan_references(refs, parents, {"p": "p"}, at="t", lifetime=("f", "u"))) == [1, 3, 5]


def test_hot_keys_are_salted_without_loss(spark):
    left = spark.range(1000).select(F.col("id").alias("i"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), "id")).alias("a"))
    right = spark.createDataFrame([("hot", 1), ("k1", 2), ("k1", 3)], "b string, v int")
    joined = salted_join(left, right, [("a", "b")], "inner", hot_rows=10)
    assert joined.count() == 334 + 2
    assert salted_join(left, right, [("a", "b")], "left_anti", hot_rows=10).count() == 1000 - 334 - 1


def test_found_orphans(spark):
    t = datetime(2024, 5, 1)
    rel = spark.createDataFrame([(1, " E1 ", "gone", t), (1, " E1 ", "gone", t), (2, None, "  ", t), (3, "lex", "late", t)], "rel_seq long, source_id string, target_id string, recorded_at timestamp")
    facts = spark.createDataFrame([(7, "C1", t), (8, "c9", t)], "fact_seq long, evidence_chunk_id string, recorded_at timestamp")
    cits = spark.createDataFrame([(9, "c1", datetime(2023, 1, 1))], "cit_seq long, chunk_id string, cited_at timestamp")
    ents = spark.createDataFrame([("e1", datetime(2024, 1, 1), None), ("late", datetime(2024, 6, 1), None)], "canonical_id string, ingested_at timestamp, deleted_at timestamp")
    lex = spark.createDataFrame([("LEX",)], "canonical_id string")
    chunks = spark.createDataFrame([("c1", datetime(2024, 1, 1), None)], "chunk_id string, ingested_at timestamp, deleted_at timestamp")
    found = found_orphans(rel, facts, cits, ents, lex, chunks)
    assert sorted((r.ref_field, r.row_seq, r.period) for r in found.collect()) == [("chunk_id", 9, "2023-01"), ("evidence_chunk_id", 8, "2024-05"), ("target_id", 1, "2024-05"), ("target_id", 3, "2024-05")]
    assert {(r.ref_field, r.orphans) for r in orphan_report(found).collect()} == {("chunk_id", 1), ("evidence_chunk_id", 1), ("target_id", 2)}
