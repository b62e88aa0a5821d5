"""What the operators share: tables, keys of texts, tables between steps, fixed-size filters."""

from __future__ import annotations

import contextlib

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

import webcairn.llm
from webcairn.llm import textkit
from webcairn.session import materialize

# Tasks get the functions of this folder with the plan, so workers need no copy of it.
cloudpickle.register_pickle_by_value(webcairn.llm)

#: Most bits of a filter sent to the tasks (4 MiB); beyond it a filter only lets more rows through.
FILTER_BITS = 1 << 25
#: Bytes of an Arrow batch that a task hands to Python where batches are kept small.
BATCH_BYTES = 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@contextlib.contextmanager
def small_batches(spark: SparkSession, size: int | None = None):
    """Actions inside hand Arrow batches of about ``size`` bytes to Python, a longer row alone.

    By default a batch may take 64 MiB, which a task holds a few times over in both processes.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name, None)
    spark.conf.set(name, str(size or BATCH_BYTES))
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def text_key(text: Column) -> Column:
    """16 bytes that stand for a text; null counts as empty, so equal texts share a key."""
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def filter_bits(keys: DataFrame, column: str, most: int = FILTER_BITS) -> np.ndarray:
    """A bit per key (a bigint column) modulo a size fixed by the number of keys and ``most``.

    The driver receives at most ``most / 8`` bytes whatever the input.  A key of the
    table always finds its bit; others rarely do, so a filter prunes and never decides.
    """
    n = max(1, keys.count())
    bits = min(most, max(1 << 10, 1 << (16 * n - 1).bit_length()))
    slot = F.pmod(F.col(column), F.lit(bits))
    rows = (
        keys.select(slot.alias("slot"))
        .groupBy(F.shiftright("slot", 6).alias("word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(slot & 63 as int))")).alias("bits"))
        .toArrow()
    )
    out = np.zeros(bits // 64, np.int64)
    out[rows["word"].to_numpy()] = rows["bits"].to_numpy()
    return out.view(np.uint64)


def in_filter(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    slot = keys.astype(np.int64, copy=False) & np.int64(len(bits) * 64 - 1)
    return ((bits[slot >> 6] >> (slot & 63).astype(np.uint64)) & np.uint64(1)).astype(bool)


__all__ = ["BATCH_BYTES", "FILTER_BITS", "filter_bits", "in_filter", "materialize", "small_batches", "table", "text_key", "textkit"]
