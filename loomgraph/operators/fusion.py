"""Extensions: reciprocal rank fusion of result lists, and communities of a graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.operators.skew import salted_join
from loomgraph.session import cut
from loomgraph.settings import Settings, get_settings

#: Keys of fewer rows are not salted.
HOT_ROWS = 100_000


def reciprocal_rank_fusion(lists: dict[str, DataFrame], keys: list[str], settings: Settings | None = None) -> DataFrame:
    """Fused score of results: keys, one ``{name}_rank`` for each list, rrf_score.

    lists: vector, graph and entity lists with the keys and ``rank``; a list's weight comes from
    the settings. Score: the sum of weight / (k + rank) over the lists that hold a result. Repeats
    of a result count with their best rank. One aggregation instead of outer joins.
    """
    s = settings or get_settings()
    weights = {"vector": s.vector_weight, "graph": s.graph_weight, "entity": s.entity_weight}
    every = None
    for name, df in lists.items():
        one = df.select(*keys, F.lit(name).alias("list"), "rank")
        every = one if every is None else every.unionByName(one)
    best = [F.min(F.when(F.col("list") == n, F.col("rank"))).alias(f"{n}_rank") for n in lists]
    out = every.groupBy(*keys).agg(*best)
    score = sum((F.coalesce(F.lit(weights[n]) / (s.rrf_k + F.col(f"{n}_rank")), F.lit(0.0)) for n in lists), F.lit(0.0))
    return out.withColumn("rrf_score", score)


def communities(graph_edges: DataFrame, rounds: int = 3) -> DataFrame:
    """Label propagation: canonical_id, community_id after ``rounds`` rounds, or fewer if a round
    changes no label.

    Every entity starts as its own community and takes the most common one among its
    neighbours, weighted by edges (ties: the least). A hub is the neighbour of many: its edges are
    salted to meet its label. Votes are counted by (entity, label) before they are shuffled.
    """
    pairs = graph_edges.select("source_id", "target_id", "weight").where("source_id <> target_id")
    both = cut(pairs.select(F.col("source_id").alias("x"), F.col("target_id").alias("y"), "weight").unionByName(pairs.select(F.col("target_id").alias("x"), F.col("source_id").alias("y"), "weight")))
    large = both.count() >= HOT_ROWS
    labels = both.select(F.col("x").alias("canonical_id")).distinct().withColumn("community_id", F.col("canonical_id"))
    for _ in range(rounds):
        met = salted_join(both, labels, [("y", "canonical_id")], "inner", hot_rows=HOT_ROWS) if large else both.join(labels, F.col("y") == F.col("canonical_id"))
        votes = met.groupBy("x", "community_id").agg(F.round(F.sum(F.coalesce("weight", F.lit(1.0))), 6).alias("w"))
        top = votes.groupBy("x").agg(F.min(F.struct(F.negative("w"), "community_id")).alias("m"))
        new = cut(top.select(F.col("x").alias("canonical_id"), F.col("m.community_id").alias("community_id")))
        same = new.join(labels.withColumnRenamed("community_id", "old"), "canonical_id").where("community_id <> old").isEmpty()
        labels = new
        if same:
            break
    return labels
