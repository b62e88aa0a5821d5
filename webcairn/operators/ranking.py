"""Ordered picks that stay spread out when one key holds most of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from webcairn.session import materialize

SALTS = 32
BLOCK = 4_096


def first_by(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key: the least by ``order``.  Combines map-side, so copies never pile up."""
    rest = [c for c in df.columns if c not in keys and c not in order]
    packed = F.struct(*order, *rest)
    best = df.groupBy(*keys).agg(F.min(packed).alias("__first"))
    return best.select(
        *keys, *[F.col("__first")[c].alias(c) for c in df.columns if c not in keys]
    )


def top_k(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    k: int,
    rank: str = "rank",
    salts: int = 1,
) -> DataFrame:
    """Rows ranked 1..k per key.

    Spark prunes each task to k rows per key before the shuffle.  With ``salts``
    a first pass keeps k rows per (key, salt), so a hot key reaches the last pass
    with at most ``k * salts`` rows however many tasks read it.
    """
    if salts > 1:
        spread = F.pmod(F.xxhash64(*[F.col(c) for c in df.columns]), F.lit(salts)).alias("__salt")
        w = Window.partitionBy(*keys, "__salt").orderBy(*order)
        df = (
            df.select("*", spread)
            .withColumn("__pre", F.row_number().over(w))
            .where(F.col("__pre") <= k)
            .drop("__pre", "__salt")
        )
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)


def positions(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], out: str = "pos"
) -> DataFrame:
    """Dense 1-based position of every row per key, without one task per key.

    Rows are range-partitioned and sorted by (keys, order), so a hot key spans
    many partitions.  Row ids of that layout are fixed by writing them out; a small
    table of rows per (key, partition) then gives each partition its offset.
    ``order`` must be unique within a key.
    """
    sort = [*keys, *order]
    laid = (
        df.repartitionByRange(*sort)
        .sortWithinPartitions(*sort)
        .withColumn("__row", F.monotonically_increasing_id())
    )
    laid = materialize(laid).withColumns(
        {
            "__part": F.shiftright("__row", 33),
            "__idx": F.col("__row").bitwiseAND(F.lit((1 << 33) - 1)),
        }
    )
    runs = laid.groupBy(*keys, "__part").agg(
        F.count(F.lit(1)).alias("__n"), F.min("__idx").alias("__start")
    )
    before = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = runs.select(
        *keys,
        "__part",
        (F.coalesce(F.sum("__n").over(before), F.lit(0)) - F.col("__start") + 1).alias("__shift"),
    )
    return (
        laid.join(offsets, [*keys, "__part"])
        .withColumn(out, F.col("__idx") + F.col("__shift"))
        .select(*df.columns, out)
    )


def running_total(
    df: DataFrame, keys: Sequence[str], number: str, value: str, out: str = "before"
) -> DataFrame:
    """Add the sum of ``value`` over the key's rows with a smaller ``number``.

    ``number`` counts a key's rows from 1 on, without gaps.  Sums of whole blocks are
    added up first, so a window holds one block or one row per block, never a whole key.
    """
    cut = df.withColumn("__block", F.floor((F.col(number) - 1) / F.lit(BLOCK)))
    earlier = Window.rowsBetween(Window.unboundedPreceding, -1)
    sums = cut.groupBy(*keys, "__block").agg(F.sum(value).alias("__n"))
    starts = sums.select(
        *keys,
        "__block",
        F.coalesce(F.sum("__n").over(earlier.partitionBy(*keys).orderBy("__block")), F.lit(0)).alias("__start"),
    )
    inside = F.coalesce(F.sum(value).over(earlier.partitionBy(*keys, "__block").orderBy(number)), F.lit(0))
    summed = cut.withColumn("__inside", inside).join(starts, [*keys, "__block"])
    return summed.withColumn(out, (F.col("__start") + F.col("__inside")).cast("bigint")).select(*df.columns, out)


def ranked(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], k: int | None = None, salts: int = 1
) -> DataFrame:
    """Rows with their ``rank`` per key: all of them, or the first ``k``."""
    if k is None:
        return positions(materialize(df), keys, order, "rank")
    best = top_k(df, keys, [F.col(c) for c in order], k, salts=salts)
    return best.withColumn("rank", F.col("rank").cast("bigint"))


def spread_join(big: DataFrame, small: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join onto a side with one row per key when ``big`` may hold one key very often.

    The big side is salted and the small side repeated per salt, so no task gets a
    whole hot key; a small enough right side is still broadcast by the optimizer.
    """
    salt = F.pmod(F.xxhash64(*[F.col(c) for c in big.columns]), F.lit(SALTS)).cast("int")
    copies = small.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return big.withColumn("__salt", salt).join(copies, [*keys, "__salt"], how).drop("__salt")


def copied_join(big: DataFrame, small: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """As ``spread_join``, for a small side with wide rows: copies only of keys that ``big`` holds often.

    Keys are counted first, so ``big`` is read twice, the first time for its keys alone.  Rows of
    ``small`` whose key is not in ``big`` go no further; ``how`` is inner or left.
    """
    found = big.groupBy(*keys).agg(F.when(F.count(F.lit(1)) > BLOCK, SALTS).otherwise(1).alias("__salts"))
    hot = found.where(F.col("__salts") > 1)
    salt = F.pmod(F.xxhash64(*[F.col(c) for c in big.columns]), F.lit(SALTS)).cast("int")
    spread = big.join(hot, list(keys), "left").withColumn(
        "__salt", F.when(F.col("__salts").isNotNull(), salt).otherwise(0)
    ).select(*big.columns, "__salt")
    copies = small.join(found, list(keys)).withColumn(
        "__salt", F.explode(F.sequence(F.lit(0), F.col("__salts") - 1))
    ).drop("__salts")
    return spread.join(copies, [*keys, "__salt"], how).drop("__salt")
