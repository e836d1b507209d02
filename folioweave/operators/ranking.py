"""Ranking helpers shared by all families."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_per_key(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank"
) -> DataFrame:
    """First ``k`` rows per key, numbered from 1.

    ``row_number() <= k`` lets Spark place a partial group limit below the
    exchange, so a hot key sends at most ``k`` rows per map task.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    ranked = df.withColumn(rank, F.row_number().over(window))
    return ranked.filter(F.col(rank) <= F.lit(k))


def page_per_key(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], limit: int, offset: int
) -> DataFrame:
    """Rows ``offset+1 .. offset+limit`` of every key."""
    return top_per_key(df, keys, order, offset + limit).filter(F.col("rank") > offset)


def top_overall(df: DataFrame, order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    """Global top ``k`` (partial top-k per task), then numbering of those k rows."""
    best = df.orderBy(*order).limit(k)
    return best.withColumn(rank, F.row_number().over(Window.orderBy(*order)))


def ranked_prefix(
    needs: DataFrame,
    ranked: DataFrame,
    group: str,
    need: str,
    rank: str = "rank",
) -> DataFrame:
    """Give every row of ``needs`` the first ``need`` rows of its group's ranking.

    The ranks wanted are generated and matched by equality on (group, rank), so
    that a row reads only the prefix it asked for and a group shared by a third
    of all rows is spread over its ranks.
    """
    wanted = needs.withColumn(rank, F.explode(F.sequence(F.lit(1), F.col(need).cast("int"))))
    return wanted.join(ranked, [group, rank], "inner")


def lead_in_time(
    df: DataFrame,
    key: str,
    order: Sequence[str],
    bucket: Column,
    values: dict[str, str],
) -> DataFrame:
    """Next row's ``values`` per key, without one task owning a whole key.

    A key may hold a large share of all rows, so the ordered scan runs per
    (key, bucket).  Only the last row of a bucket needs the first row of the
    following bucket; those first rows are a pre-aggregated table with one row
    per (key, bucket).  ``bucket`` must be monotone in ``order``.
    """
    parts = df.withColumn("_bucket", bucket)
    inner = Window.partitionBy(key, "_bucket").orderBy(*order)
    led = parts.select("*", *[F.lead(src).over(inner).alias(dst) for dst, src in values.items()])
    last_flag = F.lead(F.lit(1)).over(inner).isNull()
    led = led.withColumn("_last", last_flag)

    firsts = parts.groupBy(key, "_bucket").agg(
        F.min(F.struct(*order, *[c for c in values.values() if c not in order])).alias("_first")
    )
    chain = Window.partitionBy(key).orderBy("_bucket")
    following = firsts.select(
        key, "_bucket", F.lead("_first").over(chain).alias("_next")
    ).filter(F.col("_next").isNotNull())

    joined = led.join(
        following.withColumn("_last", F.lit(True)), [key, "_bucket", "_last"], "left"
    )
    fixed = {
        dst: F.when(F.col("_last"), F.col(f"_next.{src}")).otherwise(F.col(dst))
        for dst, src in values.items()
    }
    return joined.withColumns(fixed).drop("_bucket", "_last", "_next")
