"""Mixing sources to target weights as a curriculum over training time.

Every source has a weight schedule over time 0..1; its integral fixes the words the
source gives in all, and its running integral, inverted, tells at what time the next
word of the source is due.  Documents of a source stand in seeded order; the words
before a document in that order are its cumulative demand, hence its position, and
range-sorting positions interleaves all sources.  A source that must give more words
than it has starts over, at most ``repeats`` times.

DataFrame functions only.  The running sum of a source is cut into hash buckets whose
number follows the rows, so a source with a third of all rows is many small windows.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from webcairn.llm.common import materialize, table

WEIGHTS = (1.0, 2.0, 3.0)
REPEATS = 3
SLOPES = (0.8, 0.0, -0.8)
SEED = "mix-1"
BUCKET_ROWS = 20_000
WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    """Runs of anything but ASCII white space; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def order_key(text: Column, id: Column, seed: str) -> Column:
    """Seeded place of a row among those of its source."""
    name = F.coalesce(id.cast("string"), F.lit("-"))
    return F.md5(F.concat_ws("|", F.lit(seed), name, F.coalesce(text.cast("string"), F.lit(""))).cast("binary"))


def _cycle(rank: Column, values: Sequence[float]) -> Column:
    return F.element_at(F.array(*[F.lit(float(v)) for v in values]), (F.pmod(rank - 1, F.lit(len(values))) + 1).cast("int"))


def targets(sizes: DataFrame, weights: Sequence[float], repeats: int, slopes: Sequence[float]) -> DataFrame:
    """Per source (skey, source_size): target, slope.  One row per source goes through the windows.

    The words of all sources are shared by weight; a source stops at ``repeats`` times
    its size and what it leaves is shared again by weight.  In order of size per weight
    the sources that stop come first, so one running sum finds where sharing ends.
    """
    named = sizes.withColumn("rank", F.row_number().over(Window.orderBy(F.col("skey") == "-", "skey")))
    named = named.withColumns(
        {
            "weight": _cycle(F.col("rank"), weights),
            "slope": _cycle(F.col("rank"), slopes),
            "most": F.col("source_size") * F.lit(float(repeats)),
        }
    )
    order = Window.orderBy(F.col("most") / F.col("weight"), "rank")
    everything = Window.partitionBy()
    sharing = named.withColumns(
        {
            "total": F.sum(F.col("source_size").cast("double")).over(everything),
            "stopped": F.sum("most").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("most"),
            "left": F.sum("weight").over(everything)
            - F.sum("weight").over(order.rowsBetween(Window.unboundedPreceding, 0))
            + F.col("weight"),
        }
    ).withColumn("unit", (F.col("total") - F.col("stopped")) / F.col("left"))
    fits = F.when(F.col("unit") <= F.col("most") / F.col("weight"), F.struct("rank_by_size", "unit"))
    return (
        sharing.withColumn("rank_by_size", F.row_number().over(order))
        .withColumn("unit", F.min(fits).over(everything)["unit"])
        .select(
            "skey",
            "source_size",
            "slope",
            F.coalesce(F.least("most", F.col("weight") * F.col("unit")), "most").alias("target"),
        )
    )


def mix(
    docs: DataFrame,
    text: str = "text",
    source: str = "source",
    id: str = "doc_id",
    weights: Sequence[float] = WEIGHTS,
    repeats: int = REPEATS,
    slopes: Sequence[float] = SLOPES,
    seed: str = SEED,
) -> DataFrame:
    """Per row: id, order_key, size, source_size, target, taken, position.

    ``weights`` and ``slopes`` go round over the sources by code point, null last.  A
    source's weight at time t is weight * (1 + slope * (2t - 1)).  ``taken`` are the words
    of the row that the mix uses, ``position`` the time of its first take (null without).
    Rows without words take nothing; equal rows share one order key and split what is
    due between them in either order.  Sources without words have target 0.
    """
    text_col, id_col = F.col(text).cast("string"), F.col(id)
    base = materialize(
        docs.select(
            id_col.alias("id"),
            F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit("-")).alias("skey"),
            order_key(text_col, id_col, seed).alias("order_key"),
            n_words(text_col).alias("size"),
        )
    )
    rows = base.count()
    digits = max(1, math.ceil(math.log(max(rows / BUCKET_ROWS, 1), 16)))
    base = base.withColumn("bucket", F.substring("order_key", 1, digits))
    buckets = materialize(base.groupBy("skey", "bucket").agg(F.sum("size").alias("bucket_size")))
    share = targets(buckets.groupBy("skey").agg(F.sum("bucket_size").alias("source_size")), weights, repeats, slopes)
    before = Window.partitionBy("skey").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = materialize(
        buckets.withColumn("offset", F.coalesce(F.sum("bucket_size").over(before), F.lit(0)))
        .join(share, "skey")
        .select("skey", "bucket", "offset", "source_size", "slope", "target")
    )
    inside = Window.partitionBy("skey", "bucket").orderBy("order_key").rowsBetween(Window.unboundedPreceding, 0)
    size, at, target = F.col("size"), F.col("at"), F.col("target")
    passes = F.when(F.col("source_size") > 0, F.floor(target / F.col("source_size"))).otherwise(F.lit(0))
    rest = F.floor(target - F.col("passes") * F.col("source_size"))
    u, a = at / target, F.col("slope")
    due = 2 * u / ((1 - a) + F.sqrt((1 - a) * (1 - a) + 4 * a * u))
    return (
        base.join(offsets, ["skey", "bucket"])
        .withColumn("at", F.col("offset") + F.sum("size").over(inside) - size)
        .withColumn("passes", passes)
        .withColumn("taken", (F.col("passes") * size + F.least(size, F.greatest(F.lit(0), rest - at))).cast("bigint"))
        .withColumn("position", F.when((F.col("taken") > 0) & (target > 0), F.when(u > 0, due).otherwise(F.lit(0.0))))
        .select("id", "order_key", "size", "source_size", "target", "taken", "position", "at", "slope")
    )


def curriculum(
    docs: DataFrame,
    text: str = "text",
    source: str = "source",
    id: str = "doc_id",
    **options,
) -> DataFrame:
    """The training order: rows of ``docs`` once per take, range-sorted by training time.

    A row that gives at least half of its words in its last pass is taken whole there.
    Rows with equal id and text are taken alike.
    """
    seed = options.get("seed", SEED)
    plan = mix(docs, text, source, id, **options)
    times = F.when(F.col("size") > 0, F.round(F.col("taken") / F.col("size"))).otherwise(0).cast("int")
    u = F.least(F.lit(1.0), (F.col("at") + F.col("turn") * F.col("source_size")) / F.col("target"))
    a = F.col("slope")
    due = F.when(u > 0, 2 * u / ((1 - a) + F.sqrt((1 - a) * (1 - a) + 4 * a * u))).otherwise(F.lit(0.0))
    takes = materialize(
        plan.where(times > 0)
        .withColumn("turn", F.explode(F.sequence(F.lit(0), times - 1)))
        .select(F.col("order_key").alias("__key"), "turn", due.alias("__due"))
        .groupBy("__key", "turn")
        .agg(F.min("__due").alias("__due"))
    )
    return (
        docs.withColumn("__key", order_key(F.col(text), F.col(id), seed))
        .join(takes, "__key")
        .repartitionByRange("__due", "__key", "turn")
        .sortWithinPartitions("__due", "__key", "turn")
        .select(*docs.columns)
    )


def op5_curriculum(spark, sf_dir: str) -> DataFrame:
    out = mix(table(spark, sf_dir, "documents"))
    return out.repartitionByRange("position", "order_key").sortWithinPartitions("position", "order_key").select(
        F.col("id").alias("doc_id"), "size", "source_size", "target", "taken", "position"
    )


OP5_SQL = r"""
WITH base AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         md5('mix-1|' || coalesce(doc_id::VARCHAR, '-') || '|' || coalesce(text, '')) AS k
  FROM documents),
sized AS (
  SELECT source, sum(size)::DOUBLE AS s, row_number() OVER (ORDER BY source NULLS LAST) AS rank
  FROM base GROUP BY source),
named AS (
  SELECT *, 1.0 + (rank - 1) % 3 AS w, [0.8, 0.0, -0.8][1 + (rank - 1) % 3]::DOUBLE AS slope, 3.0 * s AS most FROM sized),
shared AS (
  SELECT *, row_number() OVER o AS i,
         (sum(s) OVER () - (sum(most) OVER o - most)) / (sum(w) OVER () - sum(w) OVER o + w) AS unit
  FROM named WINDOW o AS (ORDER BY most / w, rank ROWS UNBOUNDED PRECEDING)),
goal AS (
  SELECT source, s, slope, least(most, w * (SELECT arg_min(unit, i) FROM shared WHERE unit <= most / w)) AS target
  FROM shared),
placed AS (
  SELECT b.doc_id, b.size, g.s, g.target::DOUBLE AS target, g.slope,
         sum(b.size) OVER (PARTITION BY b.source ORDER BY b.k ROWS UNBOUNDED PRECEDING) - b.size AS c,
         CASE WHEN g.s > 0 THEN floor(g.target / g.s) ELSE 0 END AS passes
  FROM base b JOIN goal g ON b.source IS NOT DISTINCT FROM g.source),
took AS (
  SELECT *, passes * size + least(size, greatest(0, floor(target - passes * s) - c)) AS t FROM placed)
SELECT doc_id, size::BIGINT AS size, s::BIGINT AS source_size, target, t::BIGINT AS taken,
       CASE WHEN t > 0 AND target > 0 THEN
         CASE WHEN c > 0 THEN 2 * (c / target) / ((1 - slope) + sqrt((1 - slope) * (1 - slope) + 4 * slope * (c / target)))
         ELSE 0.0 END END::DOUBLE AS position
FROM took
"""
