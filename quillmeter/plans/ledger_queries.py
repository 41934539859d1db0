"""Credit ledger and payment queries: purchases add credits, clicks and views deduct."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmeter.operators import ledger as L
from quillmeter.plans.registry import Tables, query

EXPIRY_DAYS = 3


def ledger(t: Tables) -> DataFrame:
    amount = (F.floor("value") + 1).cast("long")
    return t.events.where("event_type IN ('purchase', 'click', 'view')").select(
        "event_id", "user_id", "ts",
        F.when(F.col("event_type") == "purchase", "purchase").otherwise("deduct").alias("type"),
        amount.alias("amount"),
        F.when(F.col("event_type") == "purchase", amount).otherwise(-amount).alias("change"),
    )


LEDGER = """(SELECT event_id, user_id, ts, CASE WHEN event_type = 'purchase' THEN 'purchase' ELSE 'deduct' END AS type,
  CAST(floor(value) AS BIGINT) + 1 AS amount,
  (CAST(floor(value) AS BIGINT) + 1) * CASE WHEN event_type = 'purchase' THEN 1 ELSE -1 END AS change
  FROM events WHERE event_type IN ('purchase', 'click', 'view'))"""


@query("c1_deduction_check", """
SELECT event_id, amount, CASE WHEN amount IS NULL OR amount <= 0 OR amount <> floor(amount) THEN 'invalid_amount'
  WHEN amount > 1000 THEN 'amount_too_large' ELSE 'ok' END AS status
FROM (SELECT event_id, CASE event_id % 4 WHEN 0 THEN value WHEN 1 THEN floor(value) * 20 WHEN 2 THEN -floor(value)
      ELSE floor(value) END AS amount FROM events)""")
def deduction_check(t: Tables) -> DataFrame:
    whole = F.floor("value").cast("double")
    k = F.col("event_id") % 4
    rows = t.events.select("event_id", F.when(k == 0, F.col("value")).when(k == 1, whole * 20).when(k == 2, -whole)
                           .otherwise(whole).alias("amount"))
    return L.deduction_check(rows, "amount")


@query("c2_running_balance", f"""
SELECT event_id, user_id, change, CAST(sum(change) OVER (PARTITION BY user_id ORDER BY ts, event_id
  ROWS UNBOUNDED PRECEDING) AS BIGINT) AS balance_after FROM {LEDGER}""")
def running_balance(t: Tables) -> DataFrame:
    return L.running_balance(ledger(t), "user_id", "ts", "event_id", "change").select(
        "event_id", "user_id", "change", "balance_after")


def balance_sql(user: str) -> str:
    return f"""
WITH RECURSIVE ev AS (SELECT *, epoch_us(ts) AS at_us, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM (SELECT * REPLACE ({user} AS user_id) FROM {LEDGER})),
st AS (
  SELECT user_id, 0::BIGINT AS rn, NULL::BIGINT AS event_id, NULL::BIGINT AS at_us, NULL::VARCHAR AS type, NULL::BIGINT AS amount,
    NULL::BOOLEAN AS accepted, 0::BIGINT AS balance, 0::BIGINT AS expired_credits, NULL::BIGINT AS expires, NULL::BIGINT AS last_used
  FROM (SELECT DISTINCT user_id FROM ev)
  UNION ALL
  SELECT user_id, rn, event_id, at_us, type, amount, (type = 'purchase' OR b0 >= amount),
    CASE WHEN type = 'purchase' THEN b0 + amount WHEN b0 >= amount THEN b0 - amount ELSE b0 END, gone,
    CASE WHEN type = 'purchase' THEN (CASE WHEN expires IS NULL OR expires < at_us THEN at_us + keep ELSE expires END)
         WHEN b0 >= amount THEN at_us + keep ELSE expires END,
    CASE WHEN type <> 'purchase' AND b0 >= amount THEN at_us ELSE last_used END
  FROM (SELECT *, prev - gone AS b0 FROM (
    SELECT e.user_id, e.rn, e.event_id, e.at_us, e.type, e.amount, s.balance AS prev, s.expires, s.last_used,
      {EXPIRY_DAYS * L.DAY_MICROS}::BIGINT AS keep,
      CASE WHEN s.expires IS NOT NULL AND s.balance > 0
        AND COALESCE(s.last_used + {EXPIRY_DAYS * L.DAY_MICROS}, s.expires) < e.at_us THEN s.balance ELSE 0 END AS gone
    FROM st s JOIN ev e ON e.user_id = s.user_id AND e.rn = s.rn + 1)))
SELECT user_id, event_id, at_us, type, amount, accepted, balance, expired_credits FROM st WHERE rn > 0"""


@query("c3_conditional_balance", balance_sql("user_id"))
def conditional_balance(t: Tables) -> DataFrame:
    return L.conditional_balance(ledger(t), "user_id", "ts", "event_id", "type", "amount", EXPIRY_DAYS)


@query("c3_balance_chunks", balance_sql("user_id % 2"))
def balance_chunks(t: Tables) -> DataFrame:
    """Two users, both cut into chunks."""
    rows = ledger(t).withColumn("user_id", F.col("user_id") % 2)
    return L.conditional_balance(rows, "user_id", "ts", "event_id", "type", "amount", EXPIRY_DAYS, chunk_rows=500)


@query("c4_history_page", f"""SELECT * FROM (SELECT event_id, user_id, ts, change,
  row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rank FROM {LEDGER}) WHERE rank BETWEEN 11 AND 30""")
def history_page(t: Tables) -> DataFrame:
    return L.history_page(ledger(t).select("event_id", "user_id", "ts", "change"), "user_id", "ts", "event_id", 20, 10)


@query("c5_first_grant", """SELECT order_id, event_id, ts FROM (SELECT event_id // 3 AS order_id, event_id, ts,
  row_number() OVER (PARTITION BY event_id // 3 ORDER BY ts, event_id) AS rn FROM events WHERE event_type <> 'error') WHERE rn = 1""")
def first_grant(t: Tables) -> DataFrame:
    rows = t.events.where("event_type <> 'error'").select(F.expr("event_id div 3").alias("order_id"), "event_id", "ts")
    return L.first_grant_per_order(rows, "order_id", "ts", "event_id")


def stored_orders(t: Tables) -> DataFrame:
    return t.orders.select(
        F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("owner_id"),
        (F.floor(F.col("o_totalprice") / 1000) - 5).cast("long").alias("credits"))


def payments(t: Tables) -> DataFrame:
    """Two payment attempts for pending orders, one for the rest; some name a wrong payer or order."""
    tries = F.when(F.col("o_orderstatus") == "P", F.sequence(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return t.orders.select("o_orderkey", "o_custkey", "o_orderpriority", "o_orderdate", F.explode(tries).alias("n")).select(
        (F.col("o_orderkey") * 2 + F.col("n")).alias("payment_id"),
        (F.col("o_orderkey") + F.when(F.col("o_orderkey") % 11 == 0, 1_000_000_000).otherwise(0)).alias("order_id"),
        (F.col("o_custkey") + F.when(F.col("o_orderpriority") == "5-LOW", 1).otherwise(0)).alias("user_id"),
        (F.col("o_orderdate") + F.make_dt_interval(hours=F.col("n"))).alias("ts"))


ORDERS = """(SELECT o_orderkey AS order_id, o_custkey AS owner_id, CAST(floor(o_totalprice / 1000) AS BIGINT) - 5 AS credits FROM orders)"""
PAYMENTS = """(SELECT o_orderkey * 2 + n AS payment_id,
  o_orderkey + CASE WHEN o_orderkey % 11 = 0 THEN 1000000000 ELSE 0 END AS order_id,
  o_custkey + CASE WHEN o_orderpriority = '5-LOW' THEN 1 ELSE 0 END AS user_id, o_orderdate + to_hours(n) AS ts
  FROM orders, range(2) r(n) WHERE n = 0 OR o_orderstatus = 'P')"""


@query("c6_reconcile_payments", f"""
WITH j AS (SELECT p.payment_id, p.order_id, p.user_id, p.ts, o.owner_id, o.credits FROM {PAYMENTS} p LEFT JOIN {ORDERS} o USING (order_id)),
f AS (SELECT order_id, min((epoch_us(ts), payment_id)) AS first FROM j WHERE owner_id = user_id AND credits > 0 GROUP BY order_id)
SELECT j.payment_id, j.order_id, j.user_id, j.ts, j.owner_id, j.credits, CASE WHEN owner_id IS NULL THEN 'order_not_found'
  WHEN owner_id <> user_id THEN 'wrong_owner' WHEN (epoch_us(ts), payment_id) > f.first THEN 'already_processed'
  WHEN COALESCE(credits, 0) <= 0 THEN 'invalid_credits' ELSE 'ok' END AS status
FROM j LEFT JOIN f ON f.order_id = j.order_id""")
def reconcile(t: Tables) -> DataFrame:
    return L.reconcile_payments(payments(t), stored_orders(t))


@query("c6_orphan_payments", f"""SELECT payment_id, order_id, user_id, ts FROM {PAYMENTS} p
WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = p.order_id)""")
def orphans(t: Tables) -> DataFrame:
    return L.orphan_payments(payments(t), stored_orders(t))


@query("c7_lifetime_totals", f"""SELECT user_id, CAST(COALESCE(sum(change) FILTER (WHERE change > 0), 0) AS BIGINT) AS total_earned,
  CAST(COALESCE(-sum(change) FILTER (WHERE change < 0), 0) AS BIGINT) AS total_used FROM {LEDGER} GROUP BY user_id""")
def lifetime(t: Tables) -> DataFrame:
    return L.lifetime_totals(ledger(t), "user_id", "change")


@query("c8_sufficient_credits", f"""
WITH b AS (SELECT user_id, CAST(sum(change) AS BIGINT) AS balance FROM {LEDGER} GROUP BY user_id)
SELECT e.event_id, e.user_id, CAST(floor(e.value) AS BIGINT) AS need, COALESCE(b.balance, 0) AS balance,
  COALESCE(b.balance, 0) >= floor(e.value) AS sufficient FROM events e LEFT JOIN b USING (user_id) WHERE e.event_type = 'signup'""")
def sufficient(t: Tables) -> DataFrame:
    balances = ledger(t).groupBy("user_id").agg(F.sum("change").alias("balance"))
    asks = t.events.where("event_type = 'signup'").select("event_id", "user_id", F.floor("value").cast("long").alias("need"))
    return L.sufficient_credits(asks, balances, ["user_id"], "need", "balance")


@query("c9_ledger_audit", f"""
SELECT event_id, user_id, stored, recomputed FROM (
  SELECT event_id, user_id, recomputed, recomputed + CASE WHEN event_id % 50 = 0 THEN 1 ELSE 0 END AS stored FROM (
    SELECT event_id, user_id, CAST(sum(change) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT)
      AS recomputed FROM {LEDGER})) WHERE stored <> recomputed""")
def audit(t: Tables) -> DataFrame:
    written = L.running_balance(ledger(t), "user_id", "ts", "event_id", "change", "stored").withColumn(
        "stored", F.col("stored") + F.when(F.col("event_id") % 50 == 0, 1).otherwise(0))
    return L.ledger_audit(written, "user_id", "ts", "event_id", "change", "stored").select(
        "event_id", "user_id", "stored", "recomputed")


@query("c10_receipts", f"""
SELECT p.payment_id, p.order_id, p.user_id, o.credits, c.c_name, b.balance
FROM {PAYMENTS} p JOIN {ORDERS} o USING (order_id) JOIN customer c ON c.c_custkey = p.user_id
LEFT JOIN (SELECT user_id, CAST(sum(change) AS BIGINT) AS balance FROM {LEDGER} GROUP BY user_id) b ON b.user_id = p.user_id""")
def receipts(t: Tables) -> DataFrame:
    users = t.customer.select(F.col("c_custkey").alias("user_id"), "c_name")
    balances = ledger(t).groupBy("user_id").agg(F.sum("change").alias("balance"))
    return L.receipts(payments(t), stored_orders(t).drop("owner_id"), users, balances).drop("ts")
