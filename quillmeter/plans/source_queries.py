"""Source, sink and stream queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmeter.operators import layout as J
from quillmeter.operators import subscriptions as S
from quillmeter.plans import billing_queries as B
from quillmeter.plans import ledger_queries as LQ
from quillmeter.plans import quota_queries as QQ
from quillmeter.plans.layout_queries import CELLS, KEY, cells, ocr_blocks
from quillmeter.plans.registry import ORACLES, Tables, query
from quillmeter.sources import readers as R
from quillmeter.sources import sinks as K
from quillmeter.streaming import streams as X


@query("a1_html_pages", r"""SELECT page_id, path, length(html) AS size FROM (SELECT page_id, html, regexp_replace(url, '^https?://[^/]*|[?#].*$', '', 'g') || CASE WHEN page_id % 4 = 0 THEN '/backup/x.html' ELSE '.html' END AS path FROM pages)
WHERE NOT regexp_matches(path, '(^|/)(node_modules|backup|backups|server|api|frontend|services|tools|scripts|css|js|images|(\.venv|venv|env)[^/]*)/')""")
def html_pages(t: Tables) -> DataFrame:
    path = F.concat(F.regexp_replace("url", r"^https?://[^/]*|[?#].*$", ""), F.when(F.col("page_id") % 4 == 0, "/backup/x.html").otherwise(".html"))
    rows = t.pages.select("page_id", path.alias("path"), F.length("html").cast("long").alias("size"))
    return rows.where(R.outside_folders("path"))


@query("a2_by_key", "SELECT * FROM events WHERE user_id = 7 AND event_type = 'purchase'")
def by_key(t: Tables) -> DataFrame:
    return R.by_key(t.events, user_id=7, event_type="purchase")


@query("a3_csv_report", f"""SELECT CAST(user_id AS VARCHAR) AS user_id, event_type, CAST(count(*) AS VARCHAR) AS events, 'a "quoted", ' || event_type AS note FROM events GROUP BY user_id, event_type""")
def csv_report(t: Tables) -> DataFrame:
    """The report as it is read back from its files; every field is quoted, so all are texts."""
    counts = t.events.groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("events"))
    path = K.shared_folder(t.spark, "a3")
    K.write_csv_report(counts.withColumn("note", F.concat(F.lit('a "quoted", '), "event_type")), path)
    return t.spark.read.schema("user_id string, event_type string, events string, note string").option("header", True).option("escape", '"').csv(path)


@query("a4_append_rows", "SELECT event_id, user_id, value, event_type FROM events")
def append_rows(t: Tables) -> DataFrame:
    """Two appends to one table, read back."""
    path = K.shared_folder(t.spark, "a4")
    rows = t.events.select("event_id", "user_id", "value", "event_type")
    K.append_rows(rows.where("value < 50"), path, ["event_type"])
    K.append_rows(rows.where("NOT coalesce(value < 50, false)"), path, ["event_type"])
    return t.spark.read.schema(rows.schema).parquet(path)


@query("a4_append_stream", "SELECT event_id, user_id, value, event_type FROM events")
def append_rows_stream(t: Tables) -> DataFrame:
    return in_slices(t, "a4", lambda s: s.events.select("event_id", "user_id", "value", "event_type"))


@query("a5_additive_upsert", "SELECT user_id, CAST(ts AS DATE) AS day, CAST(sum(CAST(floor(value) AS BIGINT)) AS BIGINT) AS pages, count(*) AS uses FROM events GROUP BY 1, 2")
def additive_upsert(t: Tables) -> DataFrame:
    rows = t.events.select("user_id", F.to_date("ts").alias("day"), F.floor("value").cast("long").alias("pages"), F.lit(1).cast("long").alias("uses"), "event_type")
    stored = rows.where("event_type = 'view'").groupBy("user_id", "day").agg(F.sum("pages").alias("pages"), F.sum("uses").alias("uses"))
    return K.add_up(stored, rows.where("event_type <> 'view'"), ["user_id", "day"], ["pages", "uses"])


def webhook_bodies(t: Tables, *more: str) -> DataFrame:
    e = F.element_at(F.array(*map(F.lit, B.WEBHOOKS)), (F.col("event_id") % 5 + 1).cast("int"))
    pay = F.struct(F.struct(F.concat(F.lit("pay_"), "event_id").alias("id"), F.floor(F.col("value") * 100).cast("long").alias("amount"), F.lit("INR").alias("currency"),
                            F.struct(F.col("user_id").cast("string").alias("userId"), F.lit("premium").alias("plan")).alias("notes")).alias("entity"))
    email = F.concat(F.lit("U"), F.col("user_id") % 50, F.lit("."), F.col("event_id") % 2, F.lit("@x.org"))
    sub = F.struct(F.struct(email.alias("customer_email"), F.lit(1735689600).cast("long").alias("end_at")).alias("entity"))
    is_pay = e.startswith("payment")
    body = F.to_json(F.struct(e.alias("event"), F.struct(F.when(is_pay, pay).alias("payment"), F.when(~is_pay, sub).alias("subscription")).alias("payload")))
    return t.events.select("event_id", *more, F.when(F.col("event_id") % 20 == 0, "not json").otherwise(body).alias("body"))


HOOK_EVENTS = f"""(SELECT event_id, ts, user_id, event, event LIKE 'payment%' AS p, CASE WHEN event NOT LIKE 'payment%' THEN 'U' || (user_id % 50) || '.' || (event_id % 2) || '@x.org' END AS email
  FROM (SELECT *, CASE WHEN event_id % 20 <> 0 THEN list_extract({B.WEBHOOKS!r}, event_id % 5 + 1) END AS event FROM events))"""


@query("a6_webhooks", f"""SELECT e.event_id, h.event, CASE WHEN p THEN 'pay_' || e.event_id END AS payment_id, CASE WHEN p THEN CAST(floor(value * 100) AS BIGINT) END AS amount,
  CASE WHEN p THEN 'INR' END AS currency, CASE WHEN p THEN e.user_id END AS user_id, h.email, CASE WHEN p THEN 'premium' END AS plan, CASE WHEN NOT p THEN TIMESTAMP '2025-01-01' END AS end_at
FROM events e JOIN {HOOK_EVENTS} h USING (event_id)""")
def webhooks(t: Tables) -> DataFrame:
    return R.parse_webhooks(webhook_bodies(t))


def addresses(t: Tables) -> DataFrame:
    """A user takes an address with each sign-up; some addresses pass from user to user."""
    email = F.concat(F.lit("u"), F.col("user_id") % 50, F.lit("."), F.col("event_id") % 2, F.lit("@X.org"))
    return t.events.where("event_type = 'signup'").select("user_id", email.alias("email"), F.col("ts").alias("since"), F.col("event_id").alias("change_id"))


OWNED = f"""(SELECT h.event_id, h.ts, h.event, h.p, h.email, CASE WHEN h.email IS NULL THEN h.user_id ELSE o.owner END AS user_id
FROM {HOOK_EVENTS} h LEFT JOIN (
  SELECT event_id, CASE WHEN last.moved IS NULL OR ts < last.moved THEN last.user_id END AS owner FROM (
    SELECT h.event_id, h.ts, arg_max(a, (epoch_us(a.since), a.change_id)) AS last FROM {HOOK_EVENTS} h JOIN (
      SELECT user_id, lower('u' || (user_id % 50) || '.' || (event_id % 2) || '@x.org') AS email, ts AS since, event_id AS change_id,
        lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS moved FROM events WHERE event_type = 'signup') a
    ON a.email = lower(h.email) AND a.since <= h.ts GROUP BY h.event_id, h.ts)) o USING (event_id))"""


def owned_webhooks(t: Tables, changes: Tables | None = None) -> DataFrame:
    """Parsed bodies with the user of payments and the owner of the address of subscriptions."""
    return S.with_owners(R.parse_webhooks(webhook_bodies(t, "ts")), addresses(changes or t))


@query("a6_webhook_users", f"SELECT event_id, event, email, user_id FROM {OWNED} WHERE event IS NOT NULL")
def webhook_users(t: Tables) -> DataFrame:
    return owned_webhooks(t).where("event IS NOT NULL").select("event_id", "event", "email", "user_id")


@query("a6_webhook_users_stream", ORACLES["a6_webhook_users"])
def webhook_users_stream(t: Tables) -> DataFrame:
    """Bodies that arrive in slices, against the table of addresses."""
    rule = lambda s: owned_webhooks(s, t).where("event IS NOT NULL").select("event_id", "event", "email", "user_id")
    return in_slices(t, "a6", rule)


E3_BY_EMAIL = f"""SELECT user_id, max_by(plan, (epoch_us(ts), event_id)) FILTER (WHERE plan IS NOT NULL) AS plan,
  max_by(status, (epoch_us(ts), event_id)) FILTER (WHERE status IS NOT NULL) AS status,
  max_by(expires_at, (epoch_us(ts), event_id)) FILTER (WHERE expires_at IS NOT NULL) AS expires_at
FROM (SELECT user_id, ts, event_id, CASE WHEN event = 'payment.captured' THEN 'premium' END AS plan,
    CASE WHEN event IN ('payment.captured', 'subscription.activated') THEN 'active' WHEN event = 'subscription.cancelled' THEN 'cancelled' END AS status,
    CASE WHEN event = 'payment.captured' THEN ts + INTERVAL 30 DAY WHEN event IN ('subscription.activated', 'subscription.charged') THEN TIMESTAMP '2025-01-01' END AS expires_at
  FROM {OWNED} WHERE user_id IS NOT NULL AND event IS NOT NULL) GROUP BY user_id"""


@query("e3_state_by_email", E3_BY_EMAIL)
def state_by_email(t: Tables) -> DataFrame:
    return S.webhook_state(owned_webhooks(t).where("event IS NOT NULL"))


@query("e3_state_by_email_stream", E3_BY_EMAIL)
def state_by_email_stream(t: Tables) -> DataFrame:
    """Changes are stored as they arrive; the state is the last change of each field."""
    changes = in_slices(t, "e3-email", lambda s: X.subscription_effects(owned_webhooks(s, t).where("event IS NOT NULL")))
    at = F.struct("ts", "event_id")
    return changes.groupBy("user_id").agg(*[F.max_by(f, F.when(F.col(f).isNotNull(), at)).alias(f) for f in ("plan", "status", "expires_at")])


@query("a7_ocr_blocks", ORACLES["j32_block_tree_cells"])
def ocr_response_cells(t: Tables) -> DataFrame:
    """The block list goes through the JSON form of a recognition response and back."""
    kids = F.when(F.col("children").isNotNull(), F.array(F.struct(F.lit("CHILD").alias("Type"), F.col("children").alias("Ids"))))
    one = ocr_blocks(t).select("doc_id", F.to_json(F.struct(F.array(F.struct(
        F.col("id").alias("Id"), F.col("block_type").alias("BlockType"), F.col("row_index").alias("RowIndex"), F.col("column_index").alias("ColumnIndex"),
        F.col("text").alias("Text"), kids.alias("Relationships"))).alias("Blocks"))).alias("j"))
    schema = R.OCR_BLOCKS.split(", ", 1)[1]
    return J.block_tree_cells(R.explode_blocks(one.select("doc_id", F.from_json("j", schema)["Blocks"].alias("Blocks"))))


@query("a8_sheet_cells", """SELECT l_orderkey, l_linenumber, c AS col, v AS value FROM (SELECT l_orderkey, l_linenumber, unnest([0, 1, 2]) AS c,
  unnest([CAST(l_partkey AS VARCHAR), l_returnflag, l_linestatus]) AS v FROM lineitem)""")
def sheet_cells(t: Tables) -> DataFrame:
    return R.sheet_cells(t.lineitem, ["l_orderkey", "l_linenumber"], ["l_partkey", "l_returnflag", "l_linestatus"])


@query("a9_wide_grid", f"""SELECT {KEY}, row, max(value) FILTER (WHERE col = 0) AS "0", max(value) FILTER (WHERE col = 1) AS "1", max(value) FILTER (WHERE col = 2) AS "2" FROM {CELLS} GROUP BY {KEY}, row""")
def wide_grid(t: Tables) -> DataFrame:
    return K.wide_grid(cells(t), J.KEY, [0, 1, 2])


class Streamed(Tables):
    """The events table read as a stream; everything else as usual."""

    @property
    def events(self) -> DataFrame:
        return R.table_stream(self.spark, self.sf_dir, "events.parquet")


def streamed(t: Tables) -> Streamed:
    return Streamed(t.spark, t.sf_dir)


class Sliced(Tables):
    """Tables whose events come from a stream instead."""

    def __init__(self, t: Tables, events: DataFrame) -> None:
        super().__init__(t.spark, t.sf_dir)
        self.arriving = events

    @property
    def events(self) -> DataFrame:
        return self.arriving


def in_slices(t: Tables, name: str, rule: Callable[[Tables], DataFrame]) -> DataFrame:
    """The events arrive in three slices of time; between them the query ends and starts again from its checkpoint."""
    return X.replayed(t.events, "ts", lambda stream: rule(Sliced(t, stream)), name)


@query("c3_conditional_balance_stream", ORACLES["c3_conditional_balance"])
def conditional_balance_stream(t: Tables) -> DataFrame:
    return in_slices(t, "c3", lambda s: X.conditional_balance(LQ.ledger(s), "user_id", "ts", "event_id", "type", "amount", LQ.EXPIRY_DAYS))


@query("c5_first_grant_stream", f"SELECT order_id, event_id, epoch_us(ts) AS at_us FROM ({ORACLES['c5_first_grant']})")
def first_grant_stream(t: Tables) -> DataFrame:
    rows = lambda s: s.events.where("event_type <> 'error'").select(F.expr("event_id div 3").alias("order_id"), "event_id", "ts")
    return in_slices(t, "c5", lambda s: X.first_grants(rows(s), "order_id", "ts", "event_id"))


@query("d1_monthly_counters_stream", ORACLES["d1_monthly_counters"])
def monthly_counters_stream(t: Tables) -> DataFrame:
    """The counters after each event as they arrive; the last ones of a month are its counters."""
    rows = in_slices(t, "d1", lambda s: X.monthly_counters(QQ.device_usage(s), "device_id", "ts", "event_id", "upload", "download"))
    counters = ["used_count", "upload_bytes", "download_bytes"]
    last = rows.groupBy("device_id", "month").agg(F.max_by(F.struct(*counters), "used_count").alias("c"))
    return last.select("device_id", "month", "c.*")


@query("d3_admission_stream", f"SELECT device, month, request_id, size, accepted FROM ({ORACLES['d3_admission']})")
def admission_stream(t: Tables) -> DataFrame:
    return in_slices(t, "d3", lambda s: X.admission(QQ.device_usage(s), "device_id", "ts", "event_id", "upload")).drop("at_us")


@query("d7_free_window_stream", ORACLES["d7_free_window_files"])
def free_window_stream(t: Tables) -> DataFrame:
    files = F.expr(QQ.UNITS.replace("13", "7")).alias("files")
    rows = lambda s: s.events.select(F.concat(F.lit("key"), F.col("user_id") % 3).alias("k"), "event_id", "ts", files)
    return in_slices(t, "d7", lambda s: X.free_window(rows(s), "k", "ts", "event_id", "files"))


@query("d9_rate_limit_stream", ORACLES["d9_rate_limit"])
def rate_limit_stream(t: Tables) -> DataFrame:
    rows = streamed(t).events.select((F.col("user_id") % 3).alias("client"), "ts")
    limited = X.rate_limit(rows, "client", "ts", "15 minutes", 3)
    return X.stored_updates(limited, "d9", ["client", "window_start"]).withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query("d12_lockout_stream", ORACLES["d12_lockout"])
def lockout_stream(t: Tables) -> DataFrame:
    good = F.col("event_type").isin("purchase", "signup").alias("ok")
    rows = lambda s: s.events.select((F.col("user_id") % 5).alias("u"), "event_id", "ts", good)
    return in_slices(t, "d12", lambda s: X.lockout(rows(s), "u", "ts", "event_id", "ok"))


@query("e3_webhook_state_stream", ORACLES["e3_webhook_state"])
def webhook_state_stream(t: Tables) -> DataFrame:
    """Changes are stored as they arrive; the state is the last change of each field."""
    changes = X.stored(X.subscription_effects(B.webhooks(streamed(t))), "e3")
    at = F.struct("ts", "event_id")
    return changes.groupBy("user_id").agg(*[F.max_by(f, F.when(F.col(f).isNotNull(), at)).alias(f) for f in ("plan", "status", "expires_at")])



@query("e5_verified_payments_stream", """SELECT o_orderkey AS order_id, CASE WHEN p.payment_id IS NOT NULL THEN 'completed' ELSE 'created' END AS status, p.payment_id, p.completed_at
FROM orders LEFT JOIN (SELECT event_id // 3 AS order_id, max_by(event_id, (epoch_us(ts), event_id)) AS payment_id, max(ts) AS completed_at
  FROM events WHERE event_type = 'purchase' GROUP BY 1) p ON p.order_id = o_orderkey""")
def verified_payments_stream(t: Tables) -> DataFrame:
    """Verified payments are stored as they arrive; an order is completed by the latest one stored."""
    paid = lambda s: s.events.where("event_type = 'purchase'").select(
        F.expr("event_id div 3").alias("order_id"), F.col("event_id").alias("payment_id"), "ts")
    orders = t.orders.select(F.col("o_orderkey").alias("order_id"), F.lit("created").alias("status"))
    return S.apply_verified_payments(orders, in_slices(t, "e5", paid))
