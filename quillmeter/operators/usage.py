"""Visits, feedback, activity, jobs, audit and usage limits (survey group B)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmeter.functions.exprs import col, long_count, lookup
from quillmeter.operators.scans import running_total, time_chunk, top_k

# Allowed audit states and resource types.
AUDIT_STATUSES = ("success", "failure", "error")
AUDIT_RESOURCES = ("pdf", "user", "organization", "api", "payment", "security")

# Largest file in bytes by plan (-1: no limit); anonymous callers get 6 MB.
ANONYMOUS_FILE_LIMIT = 6 * 1024 * 1024
PLAN_FILE_LIMITS = {"free": 50 * 1024 * 1024, "premium": 200 * 1024 * 1024, "business": -1}


def visit_rollup(visits: DataFrame, user: str, page: str, tool: str, credits: str, ts: str, tie: str) -> DataFrame:
    """B1: one row per (user, page). The tool is the latest non-null one. Partial aggregation only."""
    when_tool = F.when(F.col(tool).isNotNull(), F.struct(ts, tie))
    return visits.groupBy(user, page).agg(
        F.count(F.lit(1)).alias("visit_count"),
        F.max_by(tool, when_tool).alias("tool_used"),
        F.sum(F.col(credits).cast("decimal(18,2)")).cast("double").alias("credits_spent"),
        F.min(ts).alias("first_visited"),
        F.max(ts).alias("last_visited"),
    )


def recent_per_user(rows: DataFrame, user: str, ts: str, tie: str, k: int) -> DataFrame:
    """Newest k rows of every user."""
    return top_k(rows, [user], [F.col(ts).desc(), F.col(tie).desc()], k)


def feedback_list(feedback: DataFrame, page: str | None = None, limit: int = 500) -> DataFrame:
    """Newest feedback, optionally of one page. ``orderBy.limit`` becomes a per-task top-k."""
    rows = feedback if page in (None, "all") else feedback.where(F.col("page") == page)
    return rows.orderBy(F.col("createdAt").desc(), F.col("id").desc()).limit(limit)


def feedback_pages(feedback: DataFrame) -> DataFrame:
    """Feedback count of each page in one aggregation."""
    return feedback.groupBy("page").agg(F.count(F.lit(1)).alias("count"))


def _blank_to_null(c: str) -> Column:
    return F.nullif(F.trim(F.col(c)), F.lit(""))


def normalise_feedback(raw: DataFrame) -> DataFrame:
    """Drop rows without comment or page; fill name and page name; trim texts."""
    page_title = F.replace(F.regexp_replace("page", r"^(.*?)\.html", "$1"), F.lit("-"), F.lit(" "))
    return raw.where(_blank_to_null("comment").isNotNull() & (F.length("page") > 0)).withColumns(
        {
            "name": F.coalesce(_blank_to_null("name"), F.lit("Anonymous")),
            "email": _blank_to_null("email"),
            "comment": F.trim("comment"),
            "pageName": F.coalesce(_blank_to_null("pageName"), page_title),
            "page": F.trim("page"),
        }
    )


def replies_in_order(feedback: DataFrame, replies: DataFrame, chunk_seconds: int = 86400) -> DataFrame:
    """Replies numbered in time order under their feedback; feedback without replies stays.

    One row per reply instead of one growing array, and the number is a two-level running count,
    so a feedback entry with very many replies is neither collected nor put in one task.
    """
    numbered = running_total(
        replies, ["feedback_id"], ["createdAt", "reply_id"], {"reply_no": F.lit(1).cast("long")},
        time_chunk("createdAt", chunk_seconds),
    ).select("feedback_id", "reply_no", "reply_id", F.col("comment").alias("reply"))
    return feedback.join(numbered, feedback["id"] == numbered["feedback_id"], "left").drop("feedback_id")


def display_date(ts: str | Column) -> Column:
    """B7: 'January 5, 2026', or 'Recently' without a date."""
    return F.coalesce(F.date_format(col(ts), "MMMM d, yyyy"), F.lit("Recently"))


def usage_series(events: DataFrame, user: str, ts: str, as_of: str, days: int = 7, months: int = 6) -> DataFrame:
    """Zero-filled counts of the last days and months per user, newest last.

    Every period is a conditional count of the same aggregation, so no calendar join is needed.
    """
    today = F.to_date(F.lit(as_of))
    periods = [
        (F.lit("day"), F.date_sub(today, i).cast("string"), F.to_date(ts) == F.date_sub(today, i))
        for i in range(days)
    ] + [
        (
            F.lit("month"),
            F.date_format(F.add_months(today, -i), "yyyy-MM"),
            F.trunc(F.to_date(ts), "month") == F.trunc(F.add_months(today, -i), "month"),
        )
        for i in range(months)
    ]
    counts = events.groupBy(user).agg(*[long_count(p[2]).alias(f"__p{i}") for i, p in enumerate(periods)])
    cells = F.array(
        *[F.struct(k.alias("grain"), p.alias("period"), F.col(f"__p{i}").alias("value"))
          for i, (k, p, _) in enumerate(periods)]
    )
    return counts.select(user, F.inline(cells))


def job_counts(jobs: DataFrame, status: str = "status") -> DataFrame:
    """Queued / active / total / completed / failed."""
    s = F.col(status)
    return jobs.agg(
        long_count(s == "queued").alias("queued"),
        long_count(s == "active").alias("active"),
        F.count(F.lit(1)).alias("total"),
        long_count(s == "completed").alias("completed"),
        long_count(s == "failed").alias("failed"),
    )


def latest_state(updates: DataFrame, key: Sequence[str], order: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """The last value of each field by key (``max_by`` combines map-side)."""
    at = F.struct(*order)
    return updates.groupBy(*key).agg(*[F.max_by(f, at).alias(f) for f in fields])


def audit_filter(audit: DataFrame, **equals: object) -> DataFrame:
    """Audit rows matching all given columns; None means any value."""
    for name, value in equals.items():
        if value is not None:
            audit = audit.where(F.col(name) == F.lit(value))
    return audit


def audit_violations(
    audit: DataFrame, statuses: Sequence[str] = AUDIT_STATUSES, resources: Sequence[str] = AUDIT_RESOURCES
) -> DataFrame:
    """Rows whose status or resource type is outside the declared sets."""
    bad_status = ~F.col("status").isin(*statuses)
    bad_resource = ~F.col("resourceType").isin(*resources)
    return audit.where(bad_status | bad_resource).withColumns(
        {"bad_status": bad_status, "bad_resource": bad_resource}
    )


def retain(rows: DataFrame, ts: str, as_of: str, keep: str) -> DataFrame:
    """Drop rows older than ``keep`` (an interval such as '365 days'). Pushed to the scan."""
    return rows.where(F.col(ts) >= F.expr(f"timestamp_ntz'{as_of}' - interval {keep}"))


def flatten_members(orgs: DataFrame) -> DataFrame:
    """One row per member entry of each organisation."""
    return orgs.select("org_id", F.inline("members"))


def current_members(changes: DataFrame) -> DataFrame:
    """Latest entry per (organisation, user); a removed user leaves the list."""
    last = latest_state(changes, ["org_id", "user_id"], ["ts", "change_id"], ["role", "status", "action"])
    return last.where(F.col("action") != "remove").drop("action")


def active_member_counts(members: DataFrame) -> DataFrame:
    return members.groupBy("org_id").agg(
        F.count(F.lit(1)).alias("members"), long_count(F.col("status") == "active").alias("active_members")
    )


def within_limit(used: str | Column, limit: str | Column) -> Column:
    """True below the limit; -1 means unlimited."""
    return (col(limit) == -1) | (col(used) < col(limit))


def usage_by_type(
    events: DataFrame, user: str, kind: str, amount: str, kinds: Sequence[str]
) -> DataFrame:
    """Usage increments summed into one column per type (explicit list: no extra pass)."""
    return events.groupBy(user).agg(
        *[
            F.coalesce(
                F.sum(F.when(F.col(kind) == k, F.col(amount).cast("decimal(18,2)"))).cast("double"), F.lit(0.0)
            ).alias(k)
            for k in kinds
        ]
    )


def tracked_keys(usage: DataFrame, key: str, used: str, reset: str) -> DataFrame:
    """Overview by the first eight characters of the tracked key."""
    return usage.groupBy(F.substring(key, 1, 8).alias("key_prefix")).agg(
        F.sum(used).alias("pdfs_used"), F.max(reset).alias("last_reset")
    )


def file_size_allowed(
    size: str | Column, plan: str | Column, limits: Mapping[str, int] = PLAN_FILE_LIMITS
) -> Column:
    """Size test by plan; no plan (anonymous) means 6 MB."""
    table = {k: int(v) for k, v in limits.items()}
    limit = F.coalesce(lookup(table, plan).cast("long"), F.lit(ANONYMOUS_FILE_LIMIT).cast("long"))
    return (limit == -1) | (col(size) <= limit)


def tool_use_rows(requests: DataFrame, user: str, tool: str, size: str, ts: str) -> DataFrame:
    """Activity rows for signed-in tool use."""
    return requests.where(F.col(user).isNotNull()).select(
        F.col(user).alias("user_id"),
        F.lit("tool_used").alias("type"),
        F.col(tool).alias("tool"),
        F.coalesce(F.col(size), F.lit(0)).cast("long").alias("file_size"),
        F.col(ts).alias("ts"),
    )
