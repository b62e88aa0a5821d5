"""Run progress, requests, site lists and lookups."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from webcairn import limits as L
from webcairn.functions import text
from webcairn.functions.urls import canonical, path_of, public_host
from webcairn.operators.ranking import top_k
from webcairn.operators.versions import latest_versions


def page_states(events: DataFrame, *more: Column) -> DataFrame:
    """Per (run, URL) and whatever else is named: the event that admitted it and the last that completed it, by event id or else by time."""
    seq = F.col("event_id" if "event_id" in events.columns else "ts")
    return events.groupBy("run_id", "url", *more).agg(
        F.min(F.when(F.col("event").isin("seed", "link"), seq)).alias("admitted"),
        F.max(F.when(F.col("event") == "complete", seq)).alias("completed"),
    )


def progress_counts(states: DataFrame, max_pages: int = L.MAX_PAGES) -> DataFrame:
    """Found, crawled, in flight, capped and drained per run.

    A page counts once however often it completes, and only after its admission.
    """
    merged = states.groupBy("run_id", "url").agg(
        F.min("admitted").alias("admitted"), F.max("completed").alias("completed")
    )
    d = merged.groupBy("run_id").agg(
        F.count("admitted").alias("found"),
        F.count_if(F.col("completed") > F.col("admitted")).alias("crawled"),
    )
    return d.withColumns(
        {
            "in_flight": F.col("found") - F.col("crawled"),
            "capped": F.col("found") >= max_pages,
            "drained": (F.col("found") > 0) & (F.col("found") == F.col("crawled")),
        }
    )


def run_progress(events: DataFrame) -> DataFrame:
    return progress_counts(page_states(events))


def progress_rows(runs: DataFrame, live: DataFrame) -> DataFrame:
    """What a progress view shows: phase, totals, fraction done and the class of an error.

    Final totals come from the run itself, all others from its live counts.
    """
    d = runs.join(live.select("run_id", F.col("found").alias("l_found"), F.col("crawled").alias("l_crawled")), "run_id", "left")
    done = F.col("status") == "done"
    phases = F.array(*[F.lit(s) for s in ("queued", "crawling", "generating")])
    at = F.array_position(phases, F.col("status"))
    third = 1.0 / 3.0
    d = d.withColumns(
        {
            "phase": F.when(at > 0, at - 1).otherwise(3).cast("bigint"),
            "found": F.when(done, F.col("pages_found")).otherwise(F.coalesce("l_found", "pages_found")),
            "crawled": F.when(done, F.col("pages_crawled")).otherwise(F.coalesce("l_crawled", "pages_crawled")),
        }
    )
    share = F.when(F.col("found") > 0, F.least(F.col("crawled") / F.col("found"), F.lit(1.0))).otherwise(0.0)
    fraction = (
        F.when(done, 1.0)
        .when(F.col("phase") == 0, 0.0)
        .when(F.col("phase") == 1, third + share * third)
        .when(F.col("phase") == 2, 2 * third)
        .otherwise(third)
    )
    error = F.when(
        F.col("status") == "error",
        F.when(F.coalesce("error", F.lit("")) == "", "unknown")
        .when(F.col("error").startswith("fetch_failed"), "unreachable")
        .when(F.col("error").startswith("robots"), "robots")
        .when(F.col("error").startswith("timeout"), "timeout")
        .otherwise(F.col("error")),
    )
    return d.select("run_id", "status", "phase", "found", "crawled", fraction.alias("fraction"), error.alias("error_class"))


def stale_runs(runs: DataFrame, now: int, limit_s: int = L.STALE_RUN_S) -> DataFrame:
    """Unfinished runs that began too long ago; another run may take over their site."""
    open_run = ~F.col("status").isin("done", "error")
    return runs.where(open_run & (F.col("started_at") < now - limit_s))


def request_windows(requests: DataFrame, window_s: int = L.REQUEST_WINDOW_S, limit: int = L.REQUEST_LIMIT) -> DataFrame:
    """Requests and admitted requests per client and fixed window."""
    start = F.floor(F.col("ts_s") / window_s) * window_s
    counts = requests.groupBy("client", start.cast("bigint").alias("window_start")).agg(
        F.count(F.lit(1)).alias("requests")
    )
    return counts.withColumn("admitted", F.least("requests", F.lit(limit)).cast("bigint"))


def admitted_requests(requests: DataFrame, window_s: int = L.REQUEST_WINDOW_S, limit: int = L.REQUEST_LIMIT) -> DataFrame:
    """The first requests of each client and window, up to the limit; refused ones do not count."""
    d = requests.withColumn("window_start", (F.floor(F.col("ts_s") / window_s) * window_s).cast("bigint"))
    return top_k(d, ["client", "window_start"], [F.col("ts_s"), F.col("request_id")], limit)


def search_key(query: Column) -> Column:
    """What a typed search looks for: the host of a URL, else the text without scheme and path."""
    typed = text.strip(query)
    url = F.when(typed.rlike(r"(?i)^[a-z][a-z0-9+.\-]*://"), typed).otherwise(F.concat(F.lit("https://"), typed))
    host = public_host(canonical(url)["origin"])
    plain = F.regexp_replace(F.regexp_replace(F.lower(typed), r"^https?://", ""), "/.*$", "")
    return F.coalesce(host, plain)


def search_sites(sites: DataFrame, query: str, limit: int | None = None) -> DataFrame:
    """Sites whose origin holds the searched text, the newest first; all of them, or ``limit``."""
    found = sites.where(F.contains(F.lower("origin"), search_key(F.lit(query))))
    found = found.orderBy(F.desc("created_at"), "site_id")
    return found if limit is None else found.limit(limit)


def domain_keys(params: DataFrame, column: str) -> DataFrame:
    """Origins a domain parameter may mean, in order of preference."""
    decoded = F.coalesce(F.try_url_decode(F.replace(column, F.lit("+"), F.lit("%2B"))), F.col(column))
    d = params.withColumn("__text", decoded).withColumn("__c", canonical(F.col("__text")))
    origin = F.when(public_host(F.col("__c.origin")).isNotNull(), F.col("__c.origin"))
    bare = ~F.contains("__text", F.lit("://"))
    keys = F.array_compact(
        F.array(
            origin,
            F.col("__text"),
            F.when(bare, F.concat(F.lit("https://"), "__text")),
            F.when(bare, F.concat(F.lit("http://"), "__text")),
        )
    )
    return d.select(*params.columns, F.posexplode(F.array_distinct(keys)).alias("priority", "origin"))


def lookup_sites(params: DataFrame, column: str, sites: DataFrame) -> DataFrame:
    """The site each domain parameter names: the first candidate that exists."""
    hits = domain_keys(params, column).join(sites.select("origin", "site_id"), "origin")
    return hits.groupBy(*params.columns).agg(F.min_by("site_id", "priority").alias("site_id"))


def site_list(sites: DataFrame, versions: DataFrame, limit: int | None = None) -> DataFrame:
    """Sites with their latest version; with ``limit`` the newest, sites without a version dropping out after it."""
    newest = sites if limit is None else sites.orderBy(F.desc("created_at"), "site_id").limit(limit)
    latest = latest_versions(versions.join(newest.select("site_id"), "site_id", "left_semi"))
    latest = latest.select("site_id", "version", F.col("created_at").alias("version_at"))
    return newest.join(latest, "site_id").orderBy(F.desc("version_at"), "site_id")


def site_dashboard(sites: DataFrame, versions: DataFrame, now: int) -> DataFrame:
    """Every site with its cadence and the age of its latest version as text."""
    latest = versions.groupBy("site_id").agg(
        F.max(F.struct("version", "created_at")).alias("v")
    )
    return sites.join(latest, "site_id", "left").select(
        "site_id",
        "origin",
        text.cadence_label(F.col("check_interval_s")).alias("cadence"),
        F.coalesce("v.version", F.lit(0)).cast("bigint").alias("versions"),
        text.age_label(F.col("v.created_at"), F.lit(now)).alias("updated"),
    )


def url_fields(df: DataFrame, url: str) -> DataFrame:
    """Origin and path of a URL for logs: no query, no fragment; a flag when it is none."""
    origin = canonical(F.col(url))["origin"]
    d = df.withColumn("domain", origin)
    ok = F.col("domain").isNotNull()
    return d.withColumns(
        {"path": F.when(ok, path_of(F.col(url))), "url_parse_error": ~ok}
    ).drop(url)


def redact_logs(logs: DataFrame, column: str = "record") -> DataFrame:
    """Log records (JSON text) with the values of sensitive keys masked, at any depth.

    A masked value may be a whole object or list.  All other text stays as written:
    order, numbers, spaces, and records that are no JSON.  Null stays null.
    """
    sensitive, mask = "|".join(L.SENSITIVE_KEYS), f'"{L.REDACTED}"'

    def masked(records: pd.Series) -> pd.Series:
        token = re.compile(r'"(?:[^"\\]|\\.)*"?|[{}\[\]]|[^\s{}\[\]",:]+', re.DOTALL)
        key, colon = re.compile(sensitive, re.IGNORECASE), re.compile(r"\s*:\s*")

        def plain(name):
            return re.sub(r"\\u([0-9a-fA-F]{4})", lambda m: chr(int(m[1], 16)), name)

        def one(text):
            if not key.search(text) and "\\u" not in text:
                return text
            kept, done, hiding, depth = [], 0, False, 0
            for t in token.finditer(text):
                if hiding:  # inside a sensitive value, until its brackets close
                    depth += (t[0] in ("{", "[")) - (t[0] in ("}", "]"))
                    if depth <= 0:
                        kept.append(mask if depth == 0 else mask + t[0])
                        done, hiding, depth = t.end(), False, 0
                elif t[0][0] == '"' and (at := colon.match(text, t.end())) and key.search(plain(t[0])):
                    kept.append(text[done : at.end()])
                    done, hiding = at.end(), True
            return "".join(kept) + (mask if hiding else text[done:])

        return records.map(one, na_action="ignore")

    return logs.withColumn(column, F.pandas_udf(masked, "string")(F.col(column)))
