"""Joins whose keys may be hot."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot when it holds at least one row in HOT_SHARE of all rows, so that
#: there are at most HOT_SHARE hot keys whatever the size of the data.
HOT_SHARE = 1000
#: Rows that a broadcast has answered, or that have a null key, go through the shuffle in so many parts.
SPREAD = 4096
#: Fewer narrow rows than FEW, or rows with texts than FEW_TEXTS, of one key burden no task, so that they are not hot.
FEW, FEW_TEXTS = 1_000_000, 100_000


def lookup_join(rows: DataFrame, found: DataFrame, keys: list[str], weight: str, total: int, how: str = "left") -> DataFrame:
    """``rows`` joined (left or inner) to ``found``, which has one row for each value of ``keys``.

    ``weight`` names a column of ``found`` with the number of ``rows`` that have the
    key; it is not returned. Keys that hold one row in HOT_SHARE or more are joined by
    broadcast: as their weights sum to ``total`` at most, there are at most HOT_SHARE of
    them. All other keys go through a shuffle in which no key is hot; the rows that are
    answered by then are spread over it by a hash of the row. Both sides are read once.
    Null keys find nothing. Where no key can be hot this is a plain join with the same result.
    """
    bound = max(FEW, -(-total // HOT_SHARE))
    extra = [c for c in found.columns if c not in (*keys, weight)]
    if total < bound:
        return rows.join(found.select(*keys, *extra), keys, how).select(*rows.columns, *extra)
    both = found.withColumns({"__ok": F.lit(True), "__spread": F.lit(0)}).select(*keys, *extra, "__ok", "__spread", weight)
    hot = both.filter(F.col(weight) >= bound).select(*keys, *[F.col(c).alias(f"__hot_{c}") for c in (*extra, "__ok")])
    cold = both.filter(F.col(weight) < bound).drop(weight)
    tried = rows.join(F.broadcast(hot), keys, "left")
    null = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])
    hashed = F.xxhash64(*[F.col(c) for c, kind in rows.dtypes if "map<" not in kind])
    tried = tried.withColumn("__spread", F.when(F.col("__hot___ok") | null, 1 + F.pmod(hashed, F.lit(SPREAD))).otherwise(0).cast("int"))
    done = tried.join(cold, [*keys, "__spread"], "left").withColumns({c: F.coalesce(f"__hot_{c}", c) for c in (*extra, "__ok")})
    if how == "inner":
        done = done.filter("__ok")
    return done.select(*rows.columns, *extra)


def weighed_join(rows: DataFrame, found: DataFrame, keys: list[str], total: int, how: str = "left") -> DataFrame:
    """As ``lookup_join``, for a ``found`` that does not know how many of the ``total`` rows have its keys: hot ones are counted first."""
    bound = max(FEW, -(-total // HOT_SHARE))
    if total < bound:
        # ``found`` grows with the data: it is not for the driver to gather, even while it is small.
        return rows.join(found.hint("shuffle_merge"), keys, how).select(*rows.columns, *[c for c in found.columns if c not in keys])
    hot = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("__weight")).filter(F.col("__weight") >= bound)
    known = found.join(F.broadcast(hot), keys, "left").withColumn("__weight", F.coalesce("__weight", F.lit(1)))
    return lookup_join(rows, known, keys, "__weight", total, how)


def salted_join(rows: DataFrame, found: DataFrame, key: str, total: int) -> DataFrame:
    """The ``total`` ``rows`` joined (inner) to ``found``, whose rows, one for each ``key``, may be too large to broadcast.

    The rows of a hot key are dealt to parts of about one in HOT_SHARE of all rows, and
    its row of ``found`` is sent to each: over all keys there are 2 * HOT_SHARE such copies at most.
    """
    bound = max(FEW_TEXTS, -(-total // HOT_SHARE))
    if total < bound:
        return rows.join(found.hint("shuffle_merge"), key)
    hot = rows.groupBy(key).agg(F.count(F.lit(1)).alias("__rows")).filter(F.col("__rows") >= bound)
    hot = F.broadcast(hot.select(key, F.ceil(F.col("__rows") / bound).cast("int").alias("__parts")))
    parts = F.coalesce("__parts", F.lit(1))
    dealt = rows.join(hot, key, "left").withColumn("__part", F.pmod(F.xxhash64(*rows.columns), parts).cast("int")).drop("__parts")
    copies = found.join(hot, key, "left").withColumn("__part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("__parts")
    return dealt.join(copies.hint("shuffle_merge"), [key, "__part"]).drop("__part")
