"""Shuffled shards by a two-pass external shuffle.

Pass one scatters rows by seeded hashes: the id and the number of shards name the shard
(rendezvous hashing, so one more shard takes rows only into itself), a hash of id and
text names a bucket inside it.  The number of buckets follows the measured bytes, so a
bucket fits a task's memory.  Pass two sets a bucket into a fixed order, shuffles it
(Fisher-Yates, seeded by shard and bucket) and writes it.  Rows with one text differ in
their ids, so a text that fills a third of the table spreads over all buckets.
"""

from __future__ import annotations

import math
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from webcairn.llm.common import materialize, table
from webcairn.session import checkpoint_dir

SHARDS = 8
BUCKET_BYTES = 8 << 20
SEED = 17


def shard_of(key: Column, shards: int, seed: int = SEED) -> Column:
    """The shard with the greatest hash for the key; a null key counts as one key of its own."""
    scores = [F.struct(F.xxhash64(F.lit(seed), F.lit(j), key), F.lit(j).alias("shard")) for j in range(shards)]
    return F.greatest(*scores)["shard"] if shards > 1 else F.lit(0)


def _shuffled(seed, columns):
    def bucket(group: pa.Table) -> pa.Table:
        place = group.select(["__shard", "__bucket"]).slice(0, 1).to_pylist()[0]
        rows = group.take(pc.sort_indices(group, sort_keys=[("__order", "ascending"), ("__crc", "ascending")]))
        order = np.arange(len(rows))
        np.random.default_rng([seed, place["__shard"], place["__bucket"]]).shuffle(order)
        out = rows.take(pa.array(order)).drop_columns(["__order", "__crc"])
        return out.append_column("__index", pa.array(np.arange(len(order)), pa.int64())).select(columns)

    return bucket


def write_shards(
    docs: DataFrame,
    path: str,
    id: str = "doc_id",
    text: str = "text",
    shards: int = SHARDS,
    bucket_bytes: int = BUCKET_BYTES,
    seed: int = SEED,
) -> tuple[DataFrame, DataFrame, list[str]]:
    """Write the rows of ``docs`` under path/shard=N in shuffled order.

    Returns the table written, the first slot of each bucket and the columns kept.
    Columns named shard or slot are replaced.  No rows give an empty table.
    """
    spark = docs.sparkSession
    rest = [c for c in docs.columns if c not in ("shard", "slot")]
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    size = F.octet_length(body) + 1
    total = docs.agg(F.sum(size.cast("bigint"))).first()[0] or 0
    buckets = max(1, math.ceil(total / shards / bucket_bytes))
    crc = F.crc32(body.cast("binary"))
    order = F.xxhash64(F.lit(seed + 1), F.col(id), body)
    rows = docs.select(
        *rest,
        shard_of(F.col(id), shards, seed).alias("__shard"),
        F.pmod(F.xxhash64(F.lit(seed + 2), F.col(id), body), F.lit(buckets)).cast("int").alias("__bucket"),
        order.alias("__order"),
        crc.alias("__crc"),
    )
    columns = [*rest, "__shard", "__bucket", "__index"]
    schema = rows.drop("__order", "__crc").schema.add("__index", "long")
    shuffled = rows.groupBy("__shard", "__bucket").applyInArrow(_shuffled(seed, columns), schema)
    shuffled.withColumn("shard", F.col("__shard")).write.partitionBy("shard").option("compression", "zstd").parquet(path)
    written = spark.read.schema(schema).parquet(path)
    sizes = written.groupBy("__shard", "__bucket").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("__shard").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = materialize(
        sizes.select("__shard", "__bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__before"))
    )
    return written, offsets, rest


def sharded(docs: DataFrame, path: str | None = None, **options) -> DataFrame:
    """Rows of ``docs`` as written to ``path``, with shard and slot (0.. without gaps per shard).

    Equal rows are interchangeable; null ids share a shard; null texts count as empty.
    """
    path = path or f"{checkpoint_dir(docs.sparkSession)}/shards-{uuid.uuid4().hex}"
    written, offsets, rest = write_shards(docs, path, **options)
    return written.join(offsets, ["__shard", "__bucket"]).select(
        *rest, F.col("__shard").alias("shard"), (F.col("__before") + F.col("__index")).alias("slot")
    )


def digest(docs: DataFrame, id: str = "doc_id", text: str = "text", shards: int = SHARDS, **options) -> DataFrame:
    """What went where: id, size, text_crc32, law, shard, slot, grown_shard, from the written shards."""
    path = options.pop("path", None) or f"{checkpoint_dir(docs.sparkSession)}/shards-{uuid.uuid4().hex}"
    written, offsets, _ = write_shards(docs, path, id=id, text=text, shards=shards, **options)
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    seed = options.get("seed", SEED)
    narrow = written.select(
        F.col(id),
        (F.octet_length(body) + 1).cast("bigint").alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
        "__shard",
        "__bucket",
        "__index",
    )
    return narrow.join(offsets, ["__shard", "__bucket"]).select(
        id,
        "size",
        "text_crc32",
        F.lit("key").alias("law"),
        F.col("__shard").alias("shard"),
        (F.col("__before") + F.col("__index")).alias("slot"),
        shard_of(F.col(id), shards + 1, seed).alias("grown_shard"),
    )


def op10_sharding(spark, sf_dir: str) -> DataFrame:
    return digest(table(spark, sf_dir, "documents").select("doc_id", "text"))
