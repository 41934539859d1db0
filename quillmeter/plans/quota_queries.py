"""Quota, rate limit, eligibility and lockout queries over events and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmeter.operators import quota as Q
from quillmeter.operators.usage import latest_state
from quillmeter.plans.registry import Tables, query


def device_usage(t: Tables) -> DataFrame:
    return t.events.select("event_id", F.col("user_id").alias("device_id"), "ts",
                           F.floor(F.col("value") * 10000).cast("long").alias("upload"),
                           F.floor(F.col("value") * 5000).cast("long").alias("download"))


DEVICES = """(SELECT event_id, user_id AS device_id, ts, CAST(floor(value * 10000) AS BIGINT) AS upload,
  CAST(floor(value * 5000) AS BIGINT) AS download FROM events)"""
COUNTERS = f"""(SELECT device_id, strftime(ts, '%Y-%m') AS month, count(*) AS used_count,
  CAST(sum(upload) AS BIGINT) AS upload_bytes, CAST(sum(download) AS BIGINT) AS download_bytes FROM {DEVICES} GROUP BY 1, 2)"""


@query("d1_monthly_counters", f"SELECT * FROM {COUNTERS}")
def monthly_counters(t: Tables) -> DataFrame:
    return Q.monthly_counters(device_usage(t), "device_id", "ts", "upload", "download")


@query("d2_quota_decision", f"""
SELECT *, blocked_by IS NULL AS allowed, CAST(greatest(0, least(40 - used_count, floor(10 - upload_bytes / 1048576.0::DOUBLE),
  floor(10 - download_bytes / 1048576.0::DOUBLE))) AS BIGINT) AS remaining FROM (
  SELECT *, CASE WHEN used_count >= 40 THEN 'count' WHEN upload_bytes / 1048576.0::DOUBLE >= 10 THEN 'upload'
    WHEN download_bytes / 1048576.0::DOUBLE >= 10 THEN 'download' END AS blocked_by FROM {COUNTERS})""")
def quota_decision(t: Tables) -> DataFrame:
    return Q.quota_decision(monthly_counters(t))


@query("d3_admission", f"""
WITH RECURSIVE ev AS (SELECT device_id AS device, strftime(ts, '%Y-%m') AS month, event_id AS request_id, upload AS size, ts,
    row_number() OVER (PARTITION BY device_id, strftime(ts, '%Y-%m') ORDER BY ts, event_id) AS rn FROM {DEVICES}),
st AS (
  SELECT device, month, 0::BIGINT AS rn, NULL::BIGINT AS request_id, NULL::BIGINT AS size, NULL::TIMESTAMP AS ts,
    false AS accepted, 0::BIGINT AS n, 0::BIGINT AS used FROM (SELECT DISTINCT device, month FROM ev)
  UNION ALL
  SELECT device, month, rn, request_id, size, ts, ok, n + CASE WHEN ok THEN 1 ELSE 0 END, used + CASE WHEN ok THEN size ELSE 0 END
  FROM (SELECT e.device, e.month, e.rn, e.request_id, e.size, e.ts, s.n, s.used,
      s.n + 1 <= 40 AND s.used + e.size <= 10485760 AND e.size <= 1048576 AS ok
    FROM st s JOIN ev e ON e.device = s.device AND e.month = s.month AND e.rn = s.rn + 1))
SELECT device, month, request_id, size, ts, accepted FROM st WHERE rn > 0""")
def admission(t: Tables) -> DataFrame:
    return Q.admission(device_usage(t), "device_id", "ts", "event_id", "upload")


UNITS = "CASE WHEN event_id % 7 = 0 THEN NULL ELSE event_id % 13 END"


@query("d3_admission_units", f"""
WITH RECURSIVE ev AS (SELECT device_id % 20 AS device, strftime(ts, '%Y-%m') AS month, event_id AS request_id, upload AS size, ts,
    COALESCE({UNITS}, 1) AS amount,
    row_number() OVER (PARTITION BY device_id % 20, strftime(ts, '%Y-%m') ORDER BY ts, event_id) AS rn FROM {DEVICES}),
st AS (
  SELECT device, month, 0::BIGINT AS rn, NULL::BIGINT AS request_id, NULL::BIGINT AS size, NULL::TIMESTAMP AS ts, 0::BIGINT AS amount,
    false AS accepted, 0::BIGINT AS n, 0::BIGINT AS used FROM (SELECT DISTINCT device, month FROM ev)
  UNION ALL
  SELECT device, month, rn, request_id, size, ts, amount, ok, n + CASE WHEN ok THEN amount ELSE 0 END, used + CASE WHEN ok THEN size ELSE 0 END
  FROM (SELECT e.device, e.month, e.rn, e.request_id, e.size, e.ts, e.amount, s.n, s.used,
      s.n + e.amount <= 40 AND s.used + e.size <= 10485760 AND e.size <= 1048576 AS ok
    FROM st s JOIN ev e ON e.device = s.device AND e.month = s.month AND e.rn = s.rn + 1))
SELECT device, month, request_id, size, ts, amount, accepted FROM st WHERE rn > 0""")
def admission_units(t: Tables) -> DataFrame:
    rows = device_usage(t).withColumns({"device": F.col("device_id") % 20, "units": F.expr(UNITS)})
    return Q.admission(rows, "device", "ts", "event_id", "upload", amount="units")


@query("d5_latest_device", """SELECT user_id AS device_id, max_by(event_type, (epoch_us(ts), event_id)) AS last_type,
  max_by(value, (epoch_us(ts), event_id)) AS last_value FROM events GROUP BY user_id""")
def latest_device(t: Tables) -> DataFrame:
    rows = t.events.select(F.col("user_id").alias("device_id"), "ts", "event_id",
                           F.col("event_type").alias("last_type"), F.col("value").alias("last_value"))
    return latest_state(rows, ["device_id"], ["ts", "event_id"], ["last_type", "last_value"])


@query("d6_abuse_key", """SELECT event_id, substr(sha256('10.0.0.' || user_id || '|' || event_type || '|' || props), 1, 16) AS free_key FROM events""")
def abuse_key(t: Tables) -> DataFrame:
    rows = t.events.select("event_id", F.concat(F.lit("10.0.0."), "user_id").alias("ip"), "event_type", "props")
    return rows.select("event_id", Q.abuse_key("ip", "event_type", "props").alias("free_key"))


@query("d7_free_window", """
WITH RECURSIVE ev AS (SELECT 'key' || (user_id % 10) AS key, event_id AS request_id, epoch_us(ts) AS at_us,
    row_number() OVER (PARTITION BY user_id % 10 ORDER BY ts, event_id) AS rn FROM events),
st AS (
  SELECT key, 0::BIGINT AS rn, NULL::BIGINT AS request_id, NULL::BIGINT AS at_us, false AS allowed, NULL::BIGINT AS started, 0::BIGINT AS used
  FROM (SELECT DISTINCT key FROM ev)
  UNION ALL
  SELECT key, rn, request_id, at_us, u0 < 5, s0, u0 + CASE WHEN u0 < 5 THEN 1 ELSE 0 END FROM (
    SELECT e.key, e.rn, e.request_id, e.at_us,
      CASE WHEN s.started IS NULL OR e.at_us - s.started >= 86400000000 THEN e.at_us ELSE s.started END AS s0,
      CASE WHEN s.started IS NULL OR e.at_us - s.started >= 86400000000 THEN 0 ELSE s.used END AS u0
    FROM st s JOIN ev e ON e.key = s.key AND e.rn = s.rn + 1))
SELECT key, request_id, at_us, allowed, 5 - used AS remaining FROM st WHERE rn > 0""")
def free_window(t: Tables) -> DataFrame:
    rows = t.events.select(F.concat(F.lit("key"), F.col("user_id") % 10).alias("k"), "event_id", "ts")
    return Q.free_window(rows, "k", "ts", "event_id")


@query("d7_free_window_files", f"""
WITH RECURSIVE ev AS (SELECT 'key' || (user_id % 3) AS key, event_id AS request_id, epoch_us(ts) AS at_us, COALESCE({UNITS.replace("13", "7")}, 1) AS requested,
    row_number() OVER (PARTITION BY user_id % 3 ORDER BY ts, event_id) AS rn FROM events),
st AS (
  SELECT key, 0::BIGINT AS rn, NULL::BIGINT AS request_id, NULL::BIGINT AS at_us, 0::BIGINT AS requested, false AS allowed,
    NULL::BIGINT AS started, 0::BIGINT AS used
  FROM (SELECT DISTINCT key FROM ev)
  UNION ALL
  SELECT key, rn, request_id, at_us, requested, u0 + requested <= 5, s0, u0 + CASE WHEN u0 + requested <= 5 THEN requested ELSE 0 END FROM (
    SELECT e.key, e.rn, e.request_id, e.at_us, e.requested,
      CASE WHEN s.started IS NULL OR e.at_us - s.started >= 86400000000 THEN e.at_us ELSE s.started END AS s0,
      CASE WHEN s.started IS NULL OR e.at_us - s.started >= 86400000000 THEN 0 ELSE s.used END AS u0
    FROM st s JOIN ev e ON e.key = s.key AND e.rn = s.rn + 1))
SELECT key, request_id, at_us, requested, allowed, 5 - used AS remaining FROM st WHERE rn > 0""")
def free_window_files(t: Tables) -> DataFrame:
    """Three keys, all cut into chunks."""
    rows = t.events.select(F.concat(F.lit("key"), F.col("user_id") % 3).alias("k"), "event_id", "ts", F.expr(UNITS.replace("13", "7")).alias("files"))
    return Q.free_window(rows, "k", "ts", "event_id", requested="files", chunk_rows=300)


@query("d8_daily_pages", """
SELECT user_id, CAST(ts AS DATE) AS day, CAST(sum(CASE WHEN event_type <> 'view' THEN p ELSE 0 END) AS BIGINT) AS text_pages,
  CAST(sum(CASE WHEN event_type = 'view' THEN p ELSE 0 END) AS BIGINT) AS ocr_pages,
  CAST(greatest(0, 1 - sum(CASE WHEN event_type <> 'view' THEN p ELSE 0 END)) AS BIGINT) AS text_remaining,
  CAST(greatest(0, 0 - sum(CASE WHEN event_type = 'view' THEN p ELSE 0 END)) AS BIGINT) AS ocr_remaining
FROM (SELECT *, CAST(floor(value / 40) AS BIGINT) AS p FROM events) GROUP BY 1, 2""")
def daily_pages(t: Tables) -> DataFrame:
    rows = t.events.select("user_id", "ts", F.floor(F.col("value") / 40).cast("long").alias("pages"),
                           (F.col("event_type") == "view").alias("is_ocr"))
    return Q.daily_pages(rows, "user_id", "ts", "pages", "is_ocr")


@query("d9_rate_limit", """SELECT user_id % 3 AS client, time_bucket(INTERVAL 15 MINUTE, ts, TIMESTAMP '1970-01-01') AS window_start,
  count(*) AS requests, greatest(0, count(*) - 3) AS refused FROM events GROUP BY 1, 2""")
def rate_limit(t: Tables) -> DataFrame:
    width, _ = Q.RATE_LIMITS["api"]
    return Q.rate_limit(t.events.select((F.col("user_id") % 3).alias("client"), "ts"), "client", "ts", width, 3)


def doc_facts(t: Tables) -> DataFrame:
    return t.documents.select(
        "doc_id", (F.lit(1) + F.floor(F.col("n_chars") / 3000)).cast("long").alias("page_count"),
        (F.col("n_chars") * 2000).alias("file_size"), F.col("text").contains("|").alias("has_tables"),
        (F.col("doc_id") % 17 == 0).alias("is_id_card"), (F.col("doc_id") % 5 == 0).alias("signed_in"))


FACTS = """(SELECT doc_id, 1 + CAST(floor(n_chars / 3000) AS BIGINT) AS page_count, n_chars * 2000 AS file_size,
  contains(text, '|') AS has_tables, doc_id % 17 = 0 AS is_id_card, doc_id % 5 = 0 AS signed_in FROM documents)"""


@query("d10_free_tier", f"""SELECT *, CASE WHEN signed_in THEN 'must_use_credits' WHEN page_count > 1 THEN 'exceeds_pages'
  WHEN file_size > 2097152 THEN 'exceeds_size' WHEN has_tables OR is_id_card THEN 'requires_excel' ELSE 'eligible' END AS reason FROM {FACTS}""")
def free_tier(t: Tables) -> DataFrame:
    c = F.col
    return doc_facts(t).withColumn("reason", Q.free_tier_reason(
        c("signed_in"), c("page_count"), c("file_size"), c("has_tables"), c("is_id_card")))


@query("d11_premium_requirements", f"""
SELECT f.doc_id, f.page_count, f.file_size, c.c_acctbal AS credits, CASE WHEN COALESCE(c_acctbal, 0) < 30 THEN 'below_minimum'
  WHEN page_count > 100 THEN 'exceeds_pages' WHEN file_size > 104857600 THEN 'exceeds_size'
  WHEN COALESCE(c_acctbal, 0) < page_count * 500.0 THEN 'insufficient_credits' ELSE 'eligible' END AS reason
FROM {FACTS} f LEFT JOIN customer c ON c.c_custkey = f.doc_id * 3""")
def premium_requirements(t: Tables) -> DataFrame:
    have = t.customer.select(F.col("c_custkey").alias("owner"), F.col("c_acctbal").alias("credits"))
    rows = doc_facts(t).withColumn("owner", F.col("doc_id") * 3).join(have, "owner", "left")
    reason = Q.premium_reason(F.col("credits"), F.col("page_count"), F.col("file_size"), F.lit(500.0))
    return rows.select("doc_id", "page_count", "file_size", "credits", reason.alias("reason"))


LOCKOUT_SQL = """
WITH RECURSIVE ev AS (SELECT user_id % 5 AS user_id, event_id, epoch_us(ts) AS at_us, event_type IN ('purchase', 'signup') AS success,
    row_number() OVER (PARTITION BY user_id % 5 ORDER BY ts, event_id) AS rn FROM events),
st AS (
  SELECT user_id, 0::BIGINT AS rn, NULL::BIGINT AS event_id, NULL::BIGINT AS at_us, false AS success, '' AS outcome,
    0::BIGINT AS fails, NULL::BIGINT AS until FROM (SELECT DISTINCT user_id FROM ev)
  UNION ALL
  SELECT user_id, rn, event_id, at_us, success, CASE WHEN locked THEN 'locked' WHEN success THEN 'ok' ELSE 'failed' END,
    CASE WHEN locked THEN fails WHEN success THEN 0 ELSE fails + 1 END,
    CASE WHEN locked THEN until WHEN success THEN NULL WHEN fails + 1 >= 5 THEN at_us + 1800000000 ELSE until END
  FROM (SELECT e.*, s.fails, s.until, COALESCE(s.until > e.at_us, false) AS locked
        FROM st s JOIN ev e ON e.user_id = s.user_id AND e.rn = s.rn + 1))
SELECT user_id, event_id, at_us, success, outcome, fails AS failed_attempts FROM st WHERE rn > 0"""


@query("d12_lockout", LOCKOUT_SQL)
def lockout(t: Tables, **chunks: int) -> DataFrame:
    rows = t.events.select((F.col("user_id") % 5).alias("u"), "event_id", "ts",
                           F.col("event_type").isin("purchase", "signup").alias("ok"))
    return Q.lockout(rows, "u", "ts", "event_id", "ok", **chunks)


@query("d12_lockout_chunks", LOCKOUT_SQL)
def lockout_chunks(t: Tables) -> DataFrame:
    """The same with all users cut into chunks."""
    return lockout(t, chunk_rows=100)


@query("d13_client_ip", """
SELECT event_id, CASE event_id % 4 WHEN 0 THEN '10.0.0.' || user_id WHEN 1 THEN '10.1.0.' || user_id
  WHEN 2 THEN '10.2.0.' || user_id ELSE 'unknown' END AS ip FROM events""")
def client_ip(t: Tables) -> DataFrame:
    k, ip = F.col("event_id") % 4, lambda net: F.concat(F.lit(f"10.{net}.0."), F.col("user_id"))
    rows = t.events.select(
        "event_id", F.when(k == 0, F.concat(F.lit(" "), ip(0), F.lit(" , 9.9.9.9"))).otherwise("").alias("fwd"),
        F.when(k <= 1, ip(1)).alias("real"), F.when(k <= 2, ip(2)).alias("remote"))
    return rows.select("event_id", Q.client_ip("fwd", "real", "remote").alias("ip"))


@query("d14_daily_caps", """
SELECT *, cap = 'within' AS allowed FROM (SELECT *, CASE WHEN documents >= 10 THEN 'documents' WHEN pages + 1 > 150 THEN 'pages' ELSE 'within' END AS cap
FROM (SELECT user_id % 40 AS client, CAST(ts AS DATE) AS day, count(*) AS documents, CAST(sum(CAST(floor(value / 3) AS BIGINT)) AS BIGINT) AS pages
  FROM events GROUP BY 1, 2))""")
def daily_caps(t: Tables) -> DataFrame:
    rows = t.events.select((F.col("user_id") % 40).alias("client"), "ts", F.floor(F.col("value") / 3).cast("long").alias("pages"))
    return Q.daily_caps(rows, "client", "ts", "pages")
