"""Generation runs to published versions, in two steps around the outside refinement.

Every run has a document of its own, so between the steps all tables are keyed by the run:
their ``site_id`` holds the run id, and two runs of one site never mix.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from webcairn import limits as L
from webcairn.operators import document, inventory, plan as plans, upsert
from webcairn.operators.ranking import spread_join
from webcairn.session import materialize

UNKNOWN_SITE = "site not found"
INVALID_DOCUMENT = "heuristic output failed validation"


def open_runs(runs: DataFrame, versions: DataFrame, sites: DataFrame) -> DataFrame:
    """Runs that have published nothing yet, each once, with the origin of their site (null: no such site)."""
    asked = runs.select("run_id", "site_id", "started_at", "change_summary").dropDuplicates(["run_id"])
    fresh = asked.join(versions.select("run_id"), "run_id", "left_anti")
    return fresh.join(sites.select("site_id", "origin"), "site_id", "left")


def start_generation(pages: DataFrame, sites: DataFrame, runs: DataFrame, versions: DataFrame) -> dict[str, DataFrame]:
    """Open runs, and inventory and heads of their documents, both keyed by run.

    A run sees the active pages last seen since its start (null: all of them); a run
    without any has a head and no inventory.  ``inventory`` and ``heads`` are what an
    outside model is asked about, see ``prompt_payloads``.
    """
    opened = materialize(open_runs(runs, versions, sites))
    known = opened.where(F.col("origin").isNotNull())
    active = pages.where(F.col("status") == "active").drop("origin")
    seen = F.col("started_at").isNull() | (F.col("last_seen_at") >= F.col("started_at"))
    joined = spread_join(active, known.select("site_id", "run_id", "origin", "started_at"), ["site_id"]).where(seen)
    fields = [c for c in ("url", "title", "description", "h1", "snippet", "section_hint") if c in pages.columns]
    own = materialize(joined.select(F.col("run_id").alias("site_id"), "origin", *fields))
    bare = known.select(F.col("run_id").alias("site_id"), "origin")
    return {
        "runs": opened,
        "inventory": materialize(inventory.build_inventory(own)),
        "heads": materialize(inventory.site_heads(own.unionByName(bare, allowMissingColumns=True))),
    }


def publish_generation(
    generation: dict[str, DataFrame],
    versions: DataFrame,
    now: int,
    plan: DataFrame | None = None,
    plan_heads: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """New version rows, the parts of their documents, and what became of every open run.

    ``plan`` and ``plan_heads`` answer by run, in the columns of ``apply_plan``.  A valid
    refinement is published, else the heuristic document; a run whose heuristic document
    breaks a rule, or whose site is unknown, publishes nothing and is an error row that names
    the rules.  Runs of one site are numbered by run id after the site's last version.
    """
    opened, items, heads = (generation[k] for k in ("runs", "inventory", "heads"))
    heuristic = materialize(document.document_lines(items, heads))
    broken = (
        document.validate_lines(heuristic)
        .groupBy("site_id")
        .agg(F.array_join(F.array_sort(F.collect_set("rule")), ",").alias("rules"))
    )
    broken = materialize(broken)
    if plan is None or plan_heads is None:
        chosen = heuristic.withColumn("generated_by", F.lit(L.GENERATED_BY[0]))
    else:
        summaries = plans.accepted_plans(plan_heads)
        refined_heads = heads.drop("summary").join(summaries, "site_id")
        refined = materialize(document.document_lines(plans.apply_plan(items, plan, plan_heads), refined_heads))
        chosen = document.choose_documents(heuristic, refined, document.validate_lines(refined))
    good = materialize(chosen.join(broken.select("site_id"), "site_id", "left_anti"))
    labels = good.where("line_no = 1").select(F.col("site_id").alias("run_id"), "generated_by")
    new = opened.join(labels, "run_id").select(
        "site_id", "run_id", F.coalesce("change_summary", F.lit("initial generation")).alias("change_summary"), "generated_by"
    )
    numbered = materialize(upsert.append_versions(new, versions))
    rows = numbered.withColumns(
        {
            "path": F.concat("site_id", F.lit("/v"), F.col("version").cast("string"), F.lit(".txt")),
            "created_at": F.lit(now).cast("bigint"),
        }
    )
    parts = document.assemble(good.withColumnRenamed("site_id", "run_id"), ("run_id",))
    outcome = opened.select("run_id", "site_id", "origin").join(broken.withColumnRenamed("site_id", "run_id"), "run_id", "left")
    outcome = outcome.join(numbered.select("run_id", "version"), "run_id", "left")
    error = F.when(F.col("origin").isNull(), UNKNOWN_SITE).when(
        F.col("rules").isNotNull(), F.concat(F.lit(f"{INVALID_DOCUMENT}: "), "rules")
    )
    return {
        "versions": rows.select("site_id", "run_id", "version", "path", "change_summary", "generated_by", "created_at"),
        "parts": spread_join(parts, numbered.select("run_id", "site_id", "version"), ["run_id"]),
        "runs": outcome.select(
            "run_id", "site_id", F.when(error.isNull(), "done").otherwise("error").alias("status"), error.alias("error"), "version"
        ),
    }
