"""Running a stream over what its source holds now, with state in the shared folder."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from webcairn.session import checkpoint_dir


def work_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder next to the checkpoints, where every executor can reach it."""
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def run_available(
    stream: DataFrame,
    each: Callable[[DataFrame, int], None],
    checkpoint: str,
    mode: str = "append",
) -> None:
    """Process all available input in micro-batches; a restart resumes at ``checkpoint``."""
    query = (
        stream.writeStream.outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .foreachBatch(each)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()


def end_mark(spark: SparkSession, schema: StructType, time: str = "ts") -> DataFrame:
    """The row a source ends with: a time after all others and nothing else.

    It closes every open window of a stream; whatever arrives later is late.
    """
    return spark.range(1).select(
        *[(F.lit("9000-01-01") if f.name == time else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema]
    )


def append_to(path: str) -> Callable[[DataFrame, int], None]:
    """A sink that adds each batch to a table under its batch id, so a repeated batch replaces itself."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write


def read_sink(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("basePath", path).parquet(path)
