"""Writers for tables and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from webcairn.sources.versioned import BUCKETS, VersionedTable


def write_pages(pages: DataFrame, path: str) -> None:
    """Next version of the page table, clustered by (site, URL) so a large site spans files."""
    pages.repartitionByRange("site_id", "url").sortWithinPartitions("site_id", "url").write.mode(
        "overwrite"
    ).parquet(path)


def document_table(spark: SparkSession, path: str, schema: StructType, buckets: int = BUCKETS) -> VersionedTable:
    """Document parts by hash bucket of site and part: never one folder per site."""
    return VersionedTable(spark, path, schema, ["site_id", "part_no"], buckets)


def write_documents(parts: DataFrame, path: str, run_id: str, buckets: int = BUCKETS) -> bool:
    """Add the parts of a run; a repeated run adds nothing, a failed one is not seen."""
    return document_table(parts.sparkSession, path, parts.schema, buckets).append(parts, run_id)


def export_text(parts: DataFrame, path: str) -> None:
    """One text file per document part, under the site and version it belongs to."""
    parts.select("site_id", "version", "part_no", F.col("content").alias("value")).write.mode(
        "overwrite"
    ).partitionBy("site_id", "version", "part_no").text(path)
