"""Usage, feedback, job and audit queries over events and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmeter.operators import usage as U
from quillmeter.plans.registry import Tables, query

AS_OF = "2024-01-30"


def visits(t: Tables) -> DataFrame:
    return t.events.select(
        "user_id", F.col("event_type").alias("page"),
        F.when(F.col("event_type") != "error", F.get_json_object("props", "$.k")).alias("tool"),
        F.col("value").alias("credits"), "ts", "event_id",
    )


VISITS = """(SELECT user_id, event_type AS page,
  CASE WHEN event_type <> 'error' THEN json_extract_string(props, '$.k') END AS tool,
  value AS credits, ts, event_id FROM events)"""


@query("b1_visit_rollup", f"""
SELECT user_id, page, count(*) AS visit_count,
  max_by(tool, (epoch_us(ts), event_id)) FILTER (WHERE tool IS NOT NULL) AS tool_used,
  CAST(sum(CAST(credits AS DECIMAL(18,2))) AS DOUBLE) AS credits_spent,
  min(ts) AS first_visited, max(ts) AS last_visited
FROM {VISITS} GROUP BY user_id, page""")
def visit_rollup(t: Tables) -> DataFrame:
    return U.visit_rollup(visits(t), "user_id", "page", "tool", "credits", "ts", "event_id")


def _recent_sql(k: int, where: str = "TRUE") -> str:
    return f"""SELECT * FROM (SELECT user_id, event_id, event_type, value, ts,
  row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rank
  FROM events WHERE {where}) WHERE rank <= {k}"""


def _recent(df: DataFrame, k: int) -> DataFrame:
    return U.recent_per_user(df.select("user_id", "event_id", "event_type", "value", "ts"), "user_id", "ts", "event_id", k)


@query("b2_recent_visits", _recent_sql(50))
def recent_visits(t: Tables) -> DataFrame:
    return _recent(t.events, 50)


@query("b9_user_activity", _recent_sql(20, "event_type <> 'view'"))
def user_activity(t: Tables) -> DataFrame:
    return _recent(t.events.where("event_type <> 'view'"), 20)


@query("b10_recent_payments", _recent_sql(10, "event_type = 'purchase'"))
def recent_payments(t: Tables) -> DataFrame:
    return _recent(t.events.where("event_type = 'purchase'"), 10)


def feedback(t: Tables) -> DataFrame:
    opening = t.conversations.where("turn = 0")
    return opening.select(
        F.col("conv_id").alias("id"),
        F.concat(F.lit("tool-"), F.col("conv_id") % 7, F.lit(".html")).alias("page"),
        F.col("text").alias("comment"),
        F.when(F.col("conv_id") % 5 != 0,
               F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(F.col("conv_id").cast("int"))).alias("createdAt"),
    )


FEEDBACK = """(SELECT conv_id AS id, 'tool-' || (conv_id % 7) || '.html' AS page, text AS comment,
  CASE WHEN conv_id % 5 <> 0 THEN TIMESTAMP '2024-01-01' + to_days(CAST(conv_id AS INTEGER)) END AS createdAt
  FROM conversations WHERE turn = 0)"""


@query("b3_feedback_list", f"""SELECT id, page, comment, createdAt FROM {FEEDBACK}
WHERE page = 'tool-3.html' ORDER BY createdAt DESC NULLS LAST, id DESC LIMIT 500""")
def feedback_list(t: Tables) -> DataFrame:
    return U.feedback_list(feedback(t), "tool-3.html")


@query("b4_feedback_pages", f"SELECT page, count(*) AS count FROM {FEEDBACK} GROUP BY page")
def feedback_pages(t: Tables) -> DataFrame:
    return U.feedback_pages(feedback(t))


@query("b5_feedback_normalised", """
SELECT conv_id, turn, CASE WHEN trim(role) = '' THEN 'Anonymous' ELSE trim(role) END AS name,
  NULLIF(trim(CASE WHEN turn % 2 = 0 THEN '  ' ELSE ' a@b.c ' END, ' '), '') AS email,
  trim(text, ' ') AS comment, 'tool-' || (conv_id % 7) || '.html' AS page,
  CASE WHEN turn % 3 = 0 THEN 'tool ' || (conv_id % 7) ELSE 'named' END AS "pageName"
FROM conversations WHERE trim(text, ' ') <> '' AND text IS NOT NULL""")
def feedback_normalised(t: Tables) -> DataFrame:
    raw = t.conversations.select(
        "conv_id", "turn", F.col("role").alias("name"),
        F.when(F.col("turn") % 2 == 0, "  ").otherwise(" a@b.c ").alias("email"),
        F.col("text").alias("comment"),
        F.concat(F.lit("tool-"), F.col("conv_id") % 7, F.lit(".html")).alias("page"),
        F.when(F.col("turn") % 3 == 0, "  ").otherwise(" named ").alias("pageName"),
    )
    return U.normalise_feedback(raw)


@query("b6_feedback_replies", f"""
SELECT f.id, f.page, r.reply_no, r.turn AS reply_id, r.text AS reply
FROM {FEEDBACK} f LEFT JOIN (
  SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS reply_no
  FROM conversations WHERE turn > 0 AND role = 'assistant') r ON f.id = r.conv_id""")
def feedback_replies(t: Tables) -> DataFrame:
    replies = t.conversations.where("turn > 0 AND role = 'assistant'").select(
        F.col("conv_id").alias("feedback_id"), F.col("turn").alias("reply_id"), F.col("text").alias("comment"),
        (F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(hours=F.col("turn").cast("int"))).alias("createdAt"),
    )
    return U.replies_in_order(feedback(t).select("id", "page"), replies)


@query("b7_feedback_dates", f"""SELECT id,
  COALESCE(strftime(createdAt, '%B %-d, %Y'), 'Recently') AS date FROM {FEEDBACK}""")
def feedback_dates(t: Tables) -> DataFrame:
    return feedback(t).select("id", U.display_date("createdAt").alias("date"))


@query("b8_usage_series", f"""
WITH u AS (SELECT DISTINCT user_id FROM events),
d AS (SELECT 'day' AS grain, strftime(DATE '{AS_OF}' - CAST(i AS INTEGER), '%Y-%m-%d') AS period FROM range(7) r(i)),
m AS (SELECT 'month' AS grain, strftime(DATE '{AS_OF}' - to_months(CAST(i AS INTEGER)), '%Y-%m') AS period FROM range(6) r(i)),
e AS (SELECT user_id, strftime(ts, '%Y-%m-%d') AS period FROM events
      UNION ALL SELECT user_id, strftime(ts, '%Y-%m') FROM events)
SELECT u.user_id, s.grain, s.period, count(e.period) AS value
FROM u CROSS JOIN (SELECT * FROM d UNION ALL SELECT * FROM m) s
LEFT JOIN e ON e.user_id = u.user_id AND e.period = s.period GROUP BY 1, 2, 3""")
def usage_series(t: Tables) -> DataFrame:
    return U.usage_series(t.events, "user_id", "ts", AS_OF)


def job_updates(t: Tables) -> DataFrame:
    status = F.element_at(F.array(*map(F.lit, ["queued", "active", "completed", "failed", "queued"])),
                          (F.col("event_id") % 5 + 1).cast("int"))
    return t.events.select((F.col("event_id") % 997).alias("job_id"), "event_id", "ts", status.alias("status"), "value")


JOBS = """(SELECT event_id % 997 AS job_id, event_id, ts, value,
  list_extract(['queued','active','completed','failed','queued'], event_id % 5 + 1) AS status FROM events)"""


@query("b12_latest_job_state", f"""SELECT job_id, max_by(status, (epoch_us(ts), event_id)) AS status,
  max_by(value, (epoch_us(ts), event_id)) AS value FROM {JOBS} GROUP BY job_id""")
def latest_job_state(t: Tables) -> DataFrame:
    return U.latest_state(job_updates(t), ["job_id"], ["ts", "event_id"], ["status", "value"])


@query("b11_job_counts", f"""SELECT count(*) FILTER (WHERE status = 'queued') AS queued,
  count(*) FILTER (WHERE status = 'active') AS active, count(*) AS total,
  count(*) FILTER (WHERE status = 'completed') AS completed, count(*) FILTER (WHERE status = 'failed') AS failed
FROM (SELECT job_id, max_by(status, (epoch_us(ts), event_id)) AS status FROM {JOBS} GROUP BY job_id)""")
def job_counts(t: Tables) -> DataFrame:
    return U.job_counts(latest_job_state(t))


def audit(t: Tables) -> DataFrame:
    kind = F.element_at(F.array(*map(F.lit, ["pdf", "user", "subscription", "payment"])), (F.col("event_id") % 4 + 1).cast("int"))
    return t.events.select(
        "event_id", "user_id", F.col("event_type").alias("action"), kind.alias("resourceType"),
        F.when(F.col("event_type") == "error", "failed").otherwise("success").alias("status"), "ts",
    )


AUDIT = """(SELECT event_id, user_id, event_type AS action,
  list_extract(['pdf','user','subscription','payment'], event_id % 4 + 1) AS "resourceType",
  CASE WHEN event_type = 'error' THEN 'failed' ELSE 'success' END AS status, ts FROM events)"""


@query("b13_audit_filter", f"""SELECT * FROM {AUDIT} WHERE action = 'purchase' AND "resourceType" = 'payment'""")
def audit_filter(t: Tables) -> DataFrame:
    return U.audit_filter(audit(t), action="purchase", resourceType="payment", user_id=None)


@query("b13_audit_violations", f"""SELECT *, status NOT IN ('success','failure','error') AS bad_status,
  "resourceType" NOT IN ('pdf','user','organization','api','payment','security') AS bad_resource
FROM {AUDIT} WHERE status NOT IN ('success','failure','error')
  OR "resourceType" NOT IN ('pdf','user','organization','api','payment','security')""")
def audit_violations(t: Tables) -> DataFrame:
    return U.audit_violations(audit(t))


@query("b14_retained_audit", "SELECT event_id, user_id, ts FROM events WHERE ts >= TIMESTAMP '2024-12-31' - INTERVAL 350 DAY")
def retained_audit(t: Tables) -> DataFrame:
    return U.retain(t.events, "ts", "2024-12-31 00:00:00", "350 days").select("event_id", "user_id", "ts")


def member_changes(t: Tables) -> DataFrame:
    return t.events.where("event_type IN ('signup', 'click', 'error')").select(
        (F.col("user_id") % 20).alias("org_id"), "user_id", F.col("event_id").alias("change_id"), "ts",
        F.when(F.col("event_id") % 2 == 0, "editor").otherwise("viewer").alias("role"),
        F.when(F.col("event_type") == "signup", "pending").otherwise("active").alias("status"),
        F.when(F.col("event_type") == "error", "remove").otherwise("set").alias("action"),
    )


MEMBERS = """(SELECT org_id, user_id, role, status FROM (SELECT user_id % 20 AS org_id, user_id,
  max_by(CASE WHEN event_id % 2 = 0 THEN 'editor' ELSE 'viewer' END, (epoch_us(ts), event_id)) AS role,
  max_by(CASE WHEN event_type = 'signup' THEN 'pending' ELSE 'active' END, (epoch_us(ts), event_id)) AS status,
  max_by(event_type, (epoch_us(ts), event_id)) AS last_type
  FROM events WHERE event_type IN ('signup', 'click', 'error') GROUP BY user_id % 20, user_id) WHERE last_type <> 'error')"""


@query("b15_members", f"SELECT * FROM {MEMBERS}")
def members(t: Tables) -> DataFrame:
    return U.current_members(member_changes(t))


@query("b15_active_members", f"""SELECT org_id, count(*) AS members,
  count(*) FILTER (WHERE status = 'active') AS active_members FROM {MEMBERS} GROUP BY org_id""")
def active_members(t: Tables) -> DataFrame:
    return U.active_member_counts(members(t))


@query("b16_usage_limits", """
SELECT user_id, count(*) AS used, CASE WHEN user_id % 3 = 0 THEN -1 ELSE 60 END AS usage_limit,
  (user_id % 3 = 0 OR count(*) < 60) AS allowed FROM events GROUP BY user_id""")
def usage_limits(t: Tables) -> DataFrame:
    used = t.events.groupBy("user_id").agg(F.count(F.lit(1)).alias("used"))
    return used.withColumn("usage_limit", F.when(F.col("user_id") % 3 == 0, -1).otherwise(60)).withColumn(
        "allowed", U.within_limit("used", "usage_limit")
    )


KINDS = ["signup", "error", "click", "view", "purchase"]


@query("b17_usage_by_type", "SELECT user_id, " + ", ".join(
    f"CAST(COALESCE(sum(CAST(value AS DECIMAL(18,2))) FILTER (WHERE event_type = '{k}'), 0) AS DOUBLE) AS {k}" for k in KINDS
) + " FROM events GROUP BY user_id")
def usage_by_type(t: Tables) -> DataFrame:
    return U.usage_by_type(t.events, "user_id", "event_type", "value", KINDS)


@query("b18_tracked_keys", """SELECT substr(sha256(CAST(user_id AS VARCHAR)), 1, 8) AS key_prefix,
  count(*) AS pdfs_used, max(ts) AS last_reset FROM events GROUP BY 1""")
def tracked_keys(t: Tables) -> DataFrame:
    usage = t.events.select(F.sha2(F.col("user_id").cast("string"), 256).alias("key"), F.lit(1).cast("long").alias("n"), "ts")
    return U.tracked_keys(usage, "key", "n", "ts")


@query("b19_file_size_limit", """
SELECT event_id, CAST(floor(value * 1048576) AS BIGINT) AS size,
  CASE WHEN user_id % 4 = 3 THEN true
       ELSE CAST(floor(value * 1048576) AS BIGINT) <= CASE user_id % 4 WHEN 0 THEN 52428800 WHEN 1 THEN 209715200 ELSE 6291456 END
  END AS allowed FROM events""")
def file_size_limit(t: Tables) -> DataFrame:
    plan = F.element_at(F.array(F.lit("free"), F.lit("premium"), F.lit(None).cast("string"), F.lit("business")),
                        (F.col("user_id") % 4 + 1).cast("int"))
    rows = t.events.select("event_id", F.floor(F.col("value") * 1048576).cast("long").alias("size"), plan.alias("plan"))
    return rows.withColumn("allowed", U.file_size_allowed("size", "plan")).drop("plan")


@query("b20_tool_use_rows", """SELECT user_id, 'tool_used' AS type, event_type AS tool,
  CAST(floor(value) AS BIGINT) AS file_size, ts FROM events WHERE user_id % 10 <> 0""")
def tool_use_rows(t: Tables) -> DataFrame:
    calls = t.events.select(
        F.when(F.col("user_id") % 10 != 0, F.col("user_id")).alias("user_id"), "event_type",
        F.floor("value").cast("long").alias("size"), "ts")
    return U.tool_use_rows(calls, "user_id", "event_type", "size", "ts")
