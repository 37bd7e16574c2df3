"""Joins that split hot keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def hot_codes(df: DataFrame, code: Column, hot_share: float, hot_rows: int) -> list[int]:
    """Codes of more than ``hot_share`` of all rows (and of ``hot_rows``), counted with partial results.

    At most 1 / hot_share codes qualify, whatever the size of ``df``.
    """
    counts = df.groupBy(code.alias("__code")).agg(F.count(F.lit(1)).alias("__n"))
    total = counts.agg(F.sum("__n").alias("__all"))
    few = counts.where(F.col("__n") >= hot_rows).join(F.broadcast(total)).where(F.col("__n") > hot_share * F.col("__all"))
    return sorted(r["__code"] for r in few.select("__code").collect())


def salted_join(
    left: DataFrame,
    right: DataFrame,
    on: list[tuple[str, str]],
    how: str,
    extra: Column | None = None,
    hot_share: float = 0.01,
    hot_rows: int = 100_000,
    salts: int = 32,
    hot: list[int] | None = None,
) -> DataFrame:
    """``left`` joined with ``right`` on equal columns; hot keys of ``left`` are salted.

    how: inner, left, left_semi or left_anti. Column names of the two sides must differ.
    The keys of ``left`` are counted at once, in a job of its own, unless their hot codes are given; without
    hot ones this is a plain join. So ``left`` should be cheap to compute, or cut before.
    The rows of ``right`` under a hot key are copied to each salt, so ``right`` should have
    few rows for a key. Null keys match nothing. Repeated rows of a hot key that are alike in all
    columns share a salt.
    """
    same = None
    for x, y in on:
        same = F.col(x) == F.col(y) if same is None else same & (F.col(x) == F.col(y))
    cond = same if extra is None else same & extra
    code_l = F.xxhash64(*[F.col(a) for a, _ in on])
    if hot is None:
        hot = hot_codes(left.dropna(subset=[a for a, _ in on]), code_l, hot_share, hot_rows)
    if not hot:
        return left.join(right, cond, how)
    code_r = F.xxhash64(*[F.col(b) for _, b in on])
    # A row's salt is a hash of the row, so that a task run again deals its rows out alike. Rows
    # of nothing but the key have no such hash.
    rest = [F.col(f"`{c}`") for c, t in left.dtypes if "map<" not in t and c not in {x for x, _ in on}]
    salt = F.pmod(F.xxhash64(*rest), F.lit(salts)) if rest else F.floor(F.rand(17) * salts)
    a = left.withColumn("__salt", F.when(code_l.isin(hot), salt.cast("int")).otherwise(0))
    each = F.when(code_r.isin(hot), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    b = right.withColumn("__psalt", F.explode(each))
    return a.join(b, cond & (F.col("__salt") == F.col("__psalt")), how).drop("__salt", "__psalt")
