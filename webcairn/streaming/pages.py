"""Page change stream, its moving stored side, and idempotent publishing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import StructType

from webcairn.operators.monitor import KEYS, judged, resolve_checks
from webcairn.operators.upsert import append_versions
from webcairn.session import materialize
from webcairn.sources.versioned import BUCKETS, VersionedTable
from webcairn.streaming.runner import read_sink


def change_stream(responses: DataFrame, stored: DataFrame) -> DataFrame:
    """Resolved checks of arriving responses against the stored pages."""
    return resolve_checks(stored, responses)


STORE = "site_id string, url string, etag string, last_modified string, content_hash string, status string"


def page_store(spark: SparkSession, path: str, buckets: int = BUCKETS) -> VersionedTable:
    """The stored side of the change stream: validators, hash and status of every page."""
    return VersionedTable(spark, path, StructType.fromDDL(STORE), KEYS, buckets)


def resolve_in_order(stored: DataFrame, responses: DataFrame, order: str) -> DataFrame:
    """Every response with what its page was before it: the last answer with a body, else the stored row.

    ``known`` is false for a page that neither holds.  Answers of one page are few; they meet in a window.
    """
    before = Window.partitionBy(*KEYS).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    full = F.col("status") == 200
    hash_before = F.last(F.when(full, F.col("current_hash")), ignorenulls=True).over(before)
    held_before = F.last(F.when(full, F.struct("new_etag", "new_modified")), ignorenulls=True).over(before)
    r = responses.select(*KEYS, order, "status", F.col("etag").alias("new_etag"), F.col("last_modified").alias("new_modified"), "current_hash")
    r = r.withColumns({"__hash": hash_before, "__held": held_before})
    s = stored.select(*KEYS, "etag", "last_modified", "content_hash", F.lit(True).alias("__stored"))
    d = r.join(s, KEYS, "left")
    fresh = F.col("__held").isNotNull()
    return d.select(
        *KEYS, order, "status", "new_etag", "new_modified", "current_hash",
        F.when(fresh, F.col("__held.new_etag")).otherwise(F.col("etag")).alias("etag"),
        F.when(fresh, F.col("__held.new_modified")).otherwise(F.col("last_modified")).alias("last_modified"),
        F.coalesce("__hash", "content_hash").alias("content_hash"),
        (fresh | F.col("__stored").isNotNull()).alias("known"),
    )


def update_pages(store: VersionedTable, order: str = "seq") -> Callable[[str], Callable[[DataFrame, int], None]]:
    """A sink that writes the checks of each batch and then moves the stored side on.

    A response is judged by what its page was just before it, in this batch or an earlier one.  An answer with a
    body replaces validators and hash (a missing hash keeps the old one), 404 and 410 mark the page removed, and
    a page not stored yet is added by its first body, without a check.  A batch that comes again after its store
    commit does nothing; before it, the same checks are written again.
    """

    def sink(path: str) -> Callable[[DataFrame, int], None]:
        def update(batch: DataFrame, batch_id: int) -> None:
            if store.committed(f"batch-{batch_id}"):
                return
            seen = materialize(resolve_in_order(store.read(), batch, order))
            known = seen.where("known")
            checks = judged(known).select(*KEYS, order, "outcome", "resolved", "changed", "hash_changed")
            checks.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
            body = F.col("status") == 200
            gone = F.col("status").isin(404, 410) & F.col("known")
            last = seen.groupBy(*KEYS).agg(
                F.max_by(F.struct(F.col("new_etag").alias("etag"), F.col("new_modified").alias("last_modified")), F.when(body, F.col(order))).alias("new"),
                F.max_by("current_hash", F.when(body & F.col("current_hash").isNotNull(), F.col(order))).alias("new_hash"),
                F.max_by(F.when(body, "active").otherwise("removed"), F.when(body | gone, F.col(order))).alias("new_status"),
            )
            rows = last.where("new_status IS NOT NULL").join(store.read(), KEYS, "left")
            moved = F.col("new").isNotNull()
            store.merge(
                rows.select(
                    *KEYS,
                    *[F.when(moved, F.col("new")[c]).otherwise(F.col(c)).alias(c) for c in ("etag", "last_modified")],
                    F.coalesce("new_hash", "content_hash").alias("content_hash"),
                    F.col("new_status").alias("status"),
                ),
                f"batch-{batch_id}",
            )

        return update

    return sink


def publish_batches(path: str) -> Callable[[DataFrame, int], None]:
    """A sink that publishes each run once, however often its row is delivered.

    Every batch reads what earlier ones published, numbers the new runs and appends them under
    its own batch id, so a repeated batch writes the same rows again.
    """

    def publish(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        try:
            earlier = read_sink(session, path).where(f"batch < {batch_id}")
        except Exception as error:  # nothing published yet
            if "PATH_NOT_FOUND" not in str(error) and "UNABLE_TO_INFER_SCHEMA" not in str(error):
                raise
            earlier = session.createDataFrame([], "site_id string, run_id string, version bigint")
        new = batch.dropDuplicates(["run_id"])
        append_versions(new, earlier).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return publish
