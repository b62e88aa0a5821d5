"""Streams over tables that arrive in parts; each must equal its batch query."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from webcairn import limits as L
from webcairn.catalog import q_monitor, q_reports, views
from webcairn.catalog.ctes import define, oracle
from webcairn.operators.monitor import due_sites
from webcairn.operators.ranking import first_by
from webcairn.sources.versioned import VersionedTable
from webcairn.streaming import admission, cadence, pages, progress
from webcairn.streaming.runner import append_to, end_mark, read_sink, run_available, work_dir

QUERIES: dict = {}
ORACLE: dict[str, str] = {}

PARTS = 3


def replay(
    spark: SparkSession,
    rows: DataFrame,
    by: str,
    transform: Callable[[DataFrame], DataFrame],
    mode: str = "append",
    each: Callable[[str], Callable[[DataFrame, int], None]] = append_to,
    end: bool = False,
) -> DataFrame:
    """Let a table arrive in consecutive thirds; every arrival restarts the stream.

    Each run resumes from the checkpoint of the one before it.  With ``end`` a last
    arrival says that the source has ended.  Returns the sink.
    """
    out = work_dir(spark, "stream")
    cuts = rows.agg(F.percentile_approx(by, [i / PARTS for i in range(1, PARTS)]).alias("c")).first()["c"]
    part = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: F.col(by) > c))
    arrivals = [rows.where(part == i) for i in range(PARTS)] + ([end_mark(spark, rows.schema)] if end else [])
    for arrival in arrivals:
        arrival.write.mode("append").parquet(f"{out}/source")
        stream = spark.readStream.schema(rows.schema).parquet(f"{out}/source")
        run_available(transform(stream), each(f"{out}/rows"), f"{out}/state", mode)
    return read_sink(spark, f"{out}/rows")


def stream_cadence(spark: SparkSession, sf: str) -> DataFrame:
    sink = replay(spark, views.checks(spark, sf), "event_id", cadence.cadence_stream, "update")
    latest = cadence.latest_cadence(sink)
    return latest.select("site_id", "checks", "interval_s", "streak", "last_changed_at")


QUERIES["stream_cadence"] = stream_cadence
ORACLE["stream_cadence"] = q_monitor.FOLD_ORACLE


def stream_progress(spark: SparkSession, sf: str) -> DataFrame:
    sink = replay(spark, timed_events(spark, sf), "event_id", progress.progress_stream, "update")
    return progress.progress_from_sink(sink.drop("batch"))


QUERIES["stream_progress"] = stream_progress
ORACLE["stream_progress"] = q_reports.ORACLE["run_progress"]


def stream_foreign(spark: SparkSession, sf: str) -> DataFrame:
    current = q_reports.runs(spark, sf).where("status <> 'done'")
    sink = replay(
        spark, views.crawl_events(spark, sf), "event_id", lambda s: progress.split_foreign(s, current)
    )
    return sink.groupBy("run_id", "foreign").agg(F.count(F.lit(1)).alias("events"))


QUERIES["stream_foreign"] = stream_foreign
ORACLE["stream_foreign"] = oracle(
    "SELECT run_id, status = 'done' AS foreign, pages_found AS events FROM run_rows", "run_rows"
)


def timed_events(spark: SparkSession, sf: str) -> DataFrame:
    return views.crawl_events(spark, sf).withColumn("ts", F.timestamp_seconds("ts"))


def stream_stale(spark: SparkSession, sf: str) -> DataFrame:
    """Every session without a finish, the last of a run too: the source ends."""
    sink = replay(
        spark, timed_events(spark, sf), "event_id", lambda s: progress.stale_run_stream(s, 6 * L.HOUR), end=True
    )
    return sink.drop("batch")


QUERIES["stream_stale"] = stream_stale
ORACLE["stream_stale"] = oracle(
    f"""
SELECT run_id, min(ts) AS started_at, max(ts) + {6 * L.HOUR} AS released_at, count(*) AS events FROM (
  SELECT *, sum(CASE WHEN prev IS NULL OR ts - prev > {6 * L.HOUR} THEN 1 ELSE 0 END) OVER (PARTITION BY run_id ORDER BY ts, event_id) AS session
  FROM (SELECT *, lag(ts) OVER (PARTITION BY run_id ORDER BY ts, event_id) AS prev FROM crawl_events))
GROUP BY run_id, session
HAVING bool_and(event <> 'finish')""",
    "crawl_events",
)


def stream_admission(spark: SparkSession, sf: str) -> DataFrame:
    rows = q_reports.requests(spark, sf).withColumn("ts", F.timestamp_seconds("ts_s"))
    sink = replay(spark, rows, "request_id", lambda s: admission.admission_stream(s, 86_400, 3), end=True)
    return sink.drop("batch")


QUERIES["stream_admission"] = stream_admission
ORACLE["stream_admission"] = oracle(
    "SELECT * FROM windows", "windows"
)


def stream_changes(spark: SparkSession, sf: str) -> DataFrame:
    s = q_monitor.snap(spark, sf)
    sink = replay(
        spark, s["responses"], "page_id", lambda r: pages.change_stream(r, s["stored"])
    )
    return sink.drop("batch")


QUERIES["stream_changes"] = stream_changes
ORACLE["stream_changes"] = q_monitor.ORACLE["check_resolved"]


# Two answers of every page, the second after all first ones.
ANSWERS = """
SELECT site_id, url, page_id AS seq, CAST(status AS int) AS status, etag, last_modified, current_hash FROM {responses}
UNION ALL
SELECT site_id, url, page_id + 1000000000, CASE WHEN page_id % 7 = 0 THEN 304 WHEN page_id % 13 = 0 THEN 410 ELSE 200 END,
  CASE WHEN page_id % 3 = 0 THEN 'new' ELSE 'round2' END, last_modified, CASE WHEN page_id % 2 = 0 THEN 'r2-' || CAST(page_id AS varchar(20)) ELSE current_hash END
FROM {responses}
"""
ANSWERS_BEFORE = """
SELECT a.*, s.site_id IS NOT NULL OR held IS NOT NULL AS known, coalesce(hash, s.content_hash) AS content_hash,
  CASE WHEN held IS NULL THEN s.etag ELSE held.e END AS old_etag, CASE WHEN held IS NULL THEN s.last_modified ELSE held.m END AS old_modified
FROM (SELECT *, last_value(CASE WHEN status = 200 THEN current_hash END IGNORE NULLS) OVER w AS hash,
    last_value(CASE WHEN status = 200 THEN {'e': etag, 'm': last_modified} END IGNORE NULLS) OVER w AS held
  FROM answers WINDOW w AS (PARTITION BY site_id, url ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) a
LEFT JOIN stored s ON s.site_id = a.site_id AND s.url = a.url"""
define("answers", ("responses",), ANSWERS.format(responses="responses"))
define("answers_before", ("answers", "stored"), ANSWERS_BEFORE)


def _updated(spark: SparkSession, sf: str) -> tuple[VersionedTable, DataFrame]:
    s = q_monitor.snap(spark, sf)
    store = pages.page_store(spark, work_dir(spark, "pages"), 16)
    store.merge(s["stored"].select(*store.schema.names), "start")
    answers = spark.sql(ANSWERS, responses=s["responses"])
    return store, replay(spark, answers, "seq", lambda r: r, each=pages.update_pages(store))


def stream_upserts(spark: SparkSession, sf: str) -> DataFrame:
    """Checks of answers against a stored side that earlier answers, of this batch or others, have moved."""
    return _updated(spark, sf)[1].drop("batch")


QUERIES["stream_upserts"] = stream_upserts
ORACLE["stream_upserts"] = oracle(
    """
SELECT site_id, url, seq, outcome, CASE WHEN current_hash IS NOT NULL AND outcome = 'modified' THEN 'unchanged' ELSE outcome END AS resolved,
  CASE WHEN current_hash IS NOT NULL THEN hash_changed ELSE outcome = 'modified' END AS changed, hash_changed
FROM (SELECT *, coalesce(content_hash <> current_hash, false) AS hash_changed,
  CASE WHEN status = 304 THEN 'unchanged' WHEN status IN (404, 410) THEN 'removed' WHEN status <> 200 THEN 'error'
    WHEN old_etag IS NOT NULL AND etag IS NOT NULL AND old_etag = etag THEN 'unchanged'
    WHEN old_etag IS NULL AND old_modified IS NOT NULL AND old_modified = last_modified THEN 'unchanged' ELSE 'modified' END AS outcome
  FROM answers_before WHERE known)""",
    "answers_before",
)


def page_store(spark: SparkSession, sf: str) -> DataFrame:
    """The stored side after all answers."""
    return _updated(spark, sf)[0].read()


QUERIES["page_store"] = page_store
ORACLE["page_store"] = oracle(
    """
SELECT coalesce(s.site_id, a.site_id) AS site_id, coalesce(s.url, a.url) AS url, CASE WHEN held IS NULL THEN etag ELSE held.e END AS etag,
  CASE WHEN held IS NULL THEN last_modified ELSE held.m END AS last_modified, coalesce(hash, content_hash) AS content_hash, coalesce(new_status, status) AS status
FROM stored s FULL JOIN (
  SELECT site_id, url, max_by({'e': etag, 'm': last_modified}, seq) FILTER (status = 200) AS held,
    max_by(current_hash, seq) FILTER (status = 200 AND current_hash IS NOT NULL) AS hash,
    max_by(CASE WHEN status = 200 THEN 'active' ELSE 'removed' END, seq) FILTER (status = 200 OR status IN (404, 410) AND known) AS new_status
  FROM answers_before GROUP BY ALL) a ON s.site_id = a.site_id AND s.url = a.url
WHERE s.site_id IS NOT NULL OR new_status IS NOT NULL""",
    "answers_before",
)


def stream_publish(spark: SparkSession, sf: str) -> DataFrame:
    """One run per document, delivered twice; a site gets at most one version a batch."""
    docs = views.table(spark, sf, "documents").select(
        F.concat("source", F.lit("-"), "lang", F.lit("-"), (F.col("doc_id") % 7).cast("string")).alias("site_id"), "doc_id"
    )
    runs = first_by(docs, ["site_id"], ["doc_id"]).withColumn("run_id", F.concat(F.lit("run"), F.col("doc_id").cast("string")))
    twice = runs.select("site_id", "run_id", F.explode(F.array("doc_id", F.col("doc_id") + 1_000_000_000)).alias("seq"))
    sink = replay(spark, twice, "seq", lambda s: s.drop("seq"), each=pages.publish_batches)
    return sink.select("site_id", "run_id", "version")


QUERIES["stream_publish"] = stream_publish
ORACLE["stream_publish"] = oracle(
    """
SELECT source || '-' || lang || '-' || (doc_id % 7) AS site_id, 'run' || min(doc_id) AS run_id, CAST(1 AS BIGINT) AS version
FROM documents GROUP BY 1"""
)


def stream_due(spark: SparkSession, sf: str) -> DataFrame:
    """The due scan as the timer runs it: cadence state from the stream, then the batch filter."""
    sink = replay(spark, views.checks(spark, sf), "event_id", cadence.cadence_stream, "update")
    state = cadence.latest_cadence(sink).withColumn("monitoring", F.lit(True))
    return due_sites(state, q_reports.NOW + 20 * L.DAY).select("site_id", "next_check_at")


QUERIES["stream_due"] = stream_due
ORACLE["stream_due"] = q_monitor.FOLD_ORACLE.replace(
    "SELECT site_id, n AS checks, interval_s, streak, last_changed_at FROM fold",
    "SELECT site_id, last_at + interval_s AS next_check_at FROM (SELECT * FROM fold",
).replace("ORDER BY n DESC) = 1", f"""ORDER BY n DESC) = 1) JOIN (SELECT site_id, max(checked_at) AS last_at FROM checks GROUP BY ALL) USING (site_id)
WHERE last_at + interval_s <= {q_reports.NOW + 20 * L.DAY}""")
