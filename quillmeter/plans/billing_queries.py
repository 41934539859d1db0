"""Subscription, price and page-billing queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmeter.operators import pricing as P
from quillmeter.operators import subscriptions as S
from quillmeter.plans.registry import Tables, query

NOW = "1999-06-01 00:00:00"


def now() -> Column:
    return F.lit(NOW).cast("timestamp_ntz")


def _pick(values: list[str], by: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (by + 1).cast("int"))


def subs(t: Tables) -> DataFrame:
    return t.orders.select(
        F.col("o_orderkey").alias("user_id"), _pick(["free", "premium", "business", "trial"], F.col("o_custkey") % 4).alias("plan"),
        F.when(F.col("o_orderstatus") == "F", "cancelled").otherwise("active").alias("status"),
        F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderdate")).alias("expires_at"),
        (F.col("o_orderkey") % 50).alias("used"))


SUBS = """(SELECT o_orderkey AS user_id, list_extract(['free','premium','business','trial'], o_custkey % 4 + 1) AS plan,
  CASE WHEN o_orderstatus = 'F' THEN 'cancelled' ELSE 'active' END AS status,
  CASE WHEN o_orderkey % 7 <> 0 THEN o_orderdate END AS expires_at, o_orderkey % 50 AS used FROM orders)"""
DUE = f"(status = 'active' AND plan <> 'free' AND COALESCE(expires_at < TIMESTAMP '{NOW}', false))"


@query("e1_expire_subscriptions", f"""SELECT user_id, CASE WHEN {DUE} THEN 'free' ELSE plan END AS plan,
  CASE WHEN {DUE} THEN 'expired' ELSE status END AS status, expires_at, used, CASE WHEN {DUE} THEN plan END AS previous_plan,
  CASE WHEN {DUE} THEN TIMESTAMP '{NOW}' END AS expired_at FROM {SUBS}""")
def expire(t: Tables) -> DataFrame:
    return S.expire_subscriptions(subs(t), now())


@query("e1_expiry_activity", f"""SELECT user_id, 'subscription_expired' AS type, plan AS previous_plan, expires_at AS expired_at FROM {SUBS} WHERE {DUE}""")
def expiry_activity(t: Tables) -> DataFrame:
    return S.expiry_activity(subs(t), now())


@query("e2_downgrade", f"""SELECT user_id, CASE WHEN x THEN 'free' ELSE plan END AS plan, CASE WHEN x THEN 'active' ELSE status END AS status,
  CASE WHEN NOT x THEN expires_at END AS expires_at, CASE WHEN x THEN 0 ELSE used END AS used,
  CASE WHEN x OR plan NOT IN ('premium', 'business') THEN 3 ELSE -1 END AS limit_pdfs,
  CAST(CASE WHEN x OR plan NOT IN ('premium', 'business') THEN 0.1 ELSE -1 END AS DOUBLE) AS limit_storage_gb,
  CASE WHEN x OR plan NOT IN ('premium', 'business') THEN 100 ELSE -1 END AS limit_api_calls
FROM (SELECT *, {DUE} AS x FROM {SUBS})""")
def downgrade(t: Tables) -> DataFrame:
    rows = subs(t)
    return S.downgrade_to_free(rows, (F.col("status") == "active") & (F.col("plan") != "free") & (F.col("expires_at") < now()))


WEBHOOKS = ["payment.captured", "payment.failed", "subscription.activated", "subscription.cancelled", "subscription.charged"]


def webhooks(t: Tables) -> DataFrame:
    return t.events.select(
        "event_id", "ts", F.when(F.col("event_id") % 13 != 0, F.col("user_id")).alias("user_id"),
        _pick(WEBHOOKS, F.col("event_id") % 5).alias("event"),
        F.when(F.col("event_id") % 2 == 0, F.when(F.col("value") > 50, "premium").otherwise("business")).alias("plan"),
        (F.col("ts") + F.make_dt_interval(F.floor("value").cast("int"))).alias("end_at"))


HOOKS = f"""(SELECT event_id, ts, user_id, event,
  CASE WHEN event = 'payment.captured' THEN COALESCE(CASE WHEN event_id % 2 = 0 THEN CASE WHEN value > 50 THEN 'premium' ELSE 'business' END END, 'basic') END AS plan,
  CASE WHEN event IN ('payment.captured', 'subscription.activated') THEN 'active' WHEN event = 'subscription.cancelled' THEN 'cancelled' END AS status,
  CASE WHEN event = 'payment.captured' THEN ts + INTERVAL 30 DAY
       WHEN event IN ('subscription.activated', 'subscription.charged') THEN ts + to_days(CAST(floor(value) AS INTEGER)) END AS expires_at
  FROM (SELECT *, list_extract({WEBHOOKS!r}, event_id % 5 + 1) AS event FROM events WHERE event_id % 13 <> 0))"""


@query("e3_webhook_state", f"""SELECT user_id, """ + ", ".join(
    f"max_by({c}, (epoch_us(ts), event_id)) FILTER (WHERE {c} IS NOT NULL) AS {c}" for c in ("plan", "status", "expires_at")
) + f" FROM {HOOKS} GROUP BY user_id")
def webhook_state(t: Tables) -> DataFrame:
    return S.webhook_state(webhooks(t))


@query("e3_webhook_audit", f"""SELECT user_id, event_id, replace(event, '.', '_') AS action,
  CASE WHEN event = 'payment.captured' THEN 'success' ELSE 'failed' END AS status FROM {HOOKS} WHERE event LIKE 'payment.%'""")
def webhook_audit(t: Tables) -> DataFrame:
    return S.webhook_audit(webhooks(t))


@query("e4_plan_limits", f"""SELECT user_id, plan, CASE WHEN plan IN ('premium', 'business') THEN -1 ELSE 3 END AS limit_pdfs,
  CAST(CASE WHEN plan IN ('premium', 'business') THEN -1 ELSE 0.1 END AS DOUBLE) AS limit_storage_gb,
  CASE WHEN plan IN ('premium', 'business') THEN -1 ELSE 100 END AS limit_api_calls,
  CASE plan WHEN 'premium' THEN 209715200 WHEN 'business' THEN -1 ELSE 52428800 END AS limit_max_file FROM {SUBS}""")
def plan_limits(t: Tables) -> DataFrame:
    return S.plan_limits(subs(t).select("user_id", "plan"))


@query("e5_verified_payments", """
SELECT o_orderkey AS order_id, CASE WHEN p.payment_id IS NOT NULL THEN 'completed' ELSE 'created' END AS status, p.payment_id, p.completed_at
FROM orders LEFT JOIN (SELECT l_orderkey, max_by(l_linenumber, (epoch_us(l_shipdate), l_linenumber)) AS payment_id, max(l_shipdate) AS completed_at
  FROM lineitem WHERE l_returnflag = 'R' GROUP BY l_orderkey) p ON l_orderkey = o_orderkey""")
def verified_payments(t: Tables) -> DataFrame:
    orders = t.orders.select(F.col("o_orderkey").alias("order_id"), F.lit("created").alias("status"))
    paid = t.lineitem.where("l_returnflag = 'R'").select(
        F.col("l_orderkey").alias("order_id"), F.col("l_linenumber").alias("payment_id"), F.col("l_shipdate").alias("ts"))
    return S.apply_verified_payments(orders, paid)


CURRENCIES = [*P.RATES, "XXX"]


def priced_orders(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", F.col("o_totalprice").alias("usd"), _pick(CURRENCIES, F.col("o_orderkey") % 12).alias("currency"))


PRICED = f"(SELECT o_orderkey, o_totalprice AS usd, list_extract({CURRENCIES!r}, o_orderkey % 12 + 1) AS currency FROM orders)"


def _rate_case(c: str) -> str:
    return f"CASE {c} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in P.RATES.items()) + " ELSE 1.0 END::DOUBLE"


@query("f1_convert_price", f"""SELECT o_orderkey, usd, currency, floor(usd * ({_rate_case('currency')}) * 100::DOUBLE + 0.5::DOUBLE) / 100::DOUBLE AS price FROM {PRICED}""")
def convert_price(t: Tables) -> DataFrame:
    return priced_orders(t).withColumn("price", P.convert_price("usd", "currency"))


@query("f2_smallest_unit", f"""SELECT o_orderkey, currency, CAST(floor(floor(usd * ({_rate_case('c2')}) * 100::DOUBLE + 0.5::DOUBLE) / 100::DOUBLE
  * CASE WHEN c2 = 'JPY' THEN 1::DOUBLE ELSE 100::DOUBLE END + 0.5::DOUBLE) AS BIGINT) AS amount
FROM (SELECT *, CASE WHEN currency = 'XXX' THEN 'INR' ELSE currency END AS c2 FROM {PRICED})""")
def smallest_unit(t: Tables) -> DataFrame:
    return priced_orders(t).select("o_orderkey", "currency", P.smallest_unit("usd", "currency").alias("amount"))


LANGS = ["en-US,en;q=0.9", "en-GB", "hi-IN", "de-DE", "fr-CA", "ja", "ru-RU", "en-AU", "zh-SG", "ar-AE", "ar-SA", "xx", "ko", "zh-CN"]


def _any(c: str, marks: list[str]) -> str:
    return "(" + " OR ".join(f"contains({c}, '{m}')" for m in marks) + ")"


LANG_CASE = f"""CASE WHEN {_any('lang', P.INR_MARKS)} THEN 'INR'
  WHEN contains(lang, 'en-us') OR (contains(lang, 'en') AND NOT contains(lang, 'en-in') AND NOT contains(lang, 'en-gb')) THEN 'USD'
  WHEN contains(lang, 'en-gb') THEN 'GBP' WHEN contains(lang, 'ja') THEN 'JPY' WHEN contains(lang, 'ru') THEN 'RUB'
  WHEN {_any('lang', P.EUR_MARKS)} THEN 'EUR' """ + " ".join(
    f"WHEN {_any('lang', m)} THEN '{c}'" for c, m in P.LOCALE_MARKS.items()) + " END"
COUNTRIES = ["IN", "us", "GB", "ZZ", "fr", "SG", "AE"]
COUNTRY_CASE = "CASE upper(country) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in P.COUNTRY_CURRENCY.items()) + " END"
ASKS = ["eur", "usd", "BTC", "", "sgd"]


@query("f3_detect_currency", f"""
SELECT c_custkey, COALESCE(CASE WHEN upper(ask) IN {tuple(P.RATES)!r} THEN upper(ask) END, {LANG_CASE}, {COUNTRY_CASE}, 'USD') AS currency
FROM (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN list_extract({ASKS!r}, c_custkey % 5 + 1) END AS ask,
  lower(list_extract({LANGS!r}, c_custkey % 14 + 1)) AS lang, list_extract({COUNTRIES!r}, c_nationkey % 7 + 1) AS country FROM customer)""")
def detect_currency(t: Tables) -> DataFrame:
    k = F.col("c_custkey")
    return t.customer.select("c_custkey", P.detect_currency(
        F.when(k % 3 == 0, _pick(ASKS, k % 5)), _pick(LANGS, k % 14), _pick(COUNTRIES, F.col("c_nationkey") % 7)).alias("currency"))


@query("f4_country_currency", f"""SELECT c_custkey, country, {COUNTRY_CASE} AS currency
FROM (SELECT c_custkey, list_extract({COUNTRIES!r}, c_nationkey % 7 + 1) AS country FROM customer)""")
def country_currency(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", _pick(COUNTRIES, F.col("c_nationkey") % 7).alias("country")).withColumn(
        "currency", P.country_currency("country"))


TOOLS = [*P.TOOL_CREDITS, "unknown-tool"]


@query("f5_tool_credits", f"""SELECT tool, count(*) AS uses, CAST(sum(credits) AS BIGINT) AS credits FROM (
  SELECT tool, CASE tool {' '.join(f"WHEN '{k}' THEN {v}" for k, v in P.TOOL_CREDITS.items())} ELSE 1 END AS credits
  FROM (SELECT list_extract({TOOLS!r}, event_id % {len(TOOLS)} + 1) AS tool FROM events)) GROUP BY tool""")
def tool_credits(t: Tables) -> DataFrame:
    uses = t.events.select(_pick(TOOLS, F.col("event_id") % len(TOOLS)).alias("tool"))
    return uses.groupBy("tool").agg(F.count(F.lit(1)).alias("uses"), F.sum(P.tool_credits("tool")).cast("long").alias("credits"))


TYPES = ["Bank Letter", "invoice", "ID card", "heavy scan", "notes"]


@query("f6_page_credits", f"""SELECT doc_id, CAST(CASE
  WHEN contains(t, 'bank') OR contains(t, 'statement') THEN 2.5 WHEN contains(t, 'invoice') OR contains(t, 'bill') OR contains(t, 'report') THEN 3
  WHEN contains(t, 'id') OR contains(t, 'card') THEN 6 WHEN contains(t, 'scanned') OR contains(t, 'heavy') THEN 6
  WHEN doc_id % 7 = 0 THEN 6 WHEN doc_id % 7 = 1 THEN 6 WHEN doc_id % 7 = 2 THEN 2.5 WHEN doc_id % 7 = 3 THEN 3 ELSE 2 END AS DOUBLE) AS credits
FROM (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN lower(list_extract({TYPES!r}, doc_id % 5 + 1)) END AS t FROM documents)""")
def page_credits(t: Tables) -> DataFrame:
    d = F.col("doc_id")
    return t.documents.select("doc_id", P.page_credits(
        F.when(d % 2 == 0, _pick(TYPES, d % 5)), d % 7 == 0, d % 7 == 1, d % 7 == 2, d % 7 == 3).alias("credits"))


def billed_pages(t: Tables) -> DataFrame:
    return t.lineitem.select("l_orderkey", F.col("l_linenumber").alias("page"),
                             F.when(F.col("l_returnflag") == "R", "Adobe").when(F.col("l_returnflag") == "A", "docai").otherwise("none").alias("engine"))


BILLED = """(SELECT l_orderkey, l_linenumber <= 5 AS early, lower(engine) AS engine,
  CASE WHEN lower(engine) = 'docai' THEN CASE WHEN l_linenumber <= 5 THEN 5 ELSE 2 END ELSE CASE WHEN l_linenumber <= 5 THEN 15 ELSE 5 END END AS credits
  FROM (SELECT *, CASE l_returnflag WHEN 'R' THEN 'Adobe' WHEN 'A' THEN 'docai' ELSE 'none' END AS engine FROM lineitem) WHERE engine <> 'none')"""


@query("f7_bill_documents", f"SELECT l_orderkey, count(*) AS pages, CAST(sum(credits) AS BIGINT) AS credits FROM {BILLED} GROUP BY l_orderkey")
def bill_documents(t: Tables) -> DataFrame:
    return P.bill_documents(billed_pages(t), "l_orderkey", "page", "engine")


@query("f8_billing_breakdown", f"""SELECT l_orderkey, engine, count(*) AS page_count, count(*) FILTER (WHERE early) AS slab_1_5_count,
  count(*) FILTER (WHERE NOT early) AS slab_6_plus_count, CAST(sum(credits) AS BIGINT) AS credits FROM {BILLED} GROUP BY ROLLUP (l_orderkey, engine)""")
def billing_breakdown(t: Tables) -> DataFrame:
    return P.billing_breakdown(billed_pages(t), "l_orderkey", "page", "engine")


@query("f9_required_credits", """
SELECT doc_id, pages * CASE WHEN doc_id % 3 = 0 THEN 5::DOUBLE ELSE 2::DOUBLE END AS required, doc_id % 60 >= 30 AS premium
FROM (SELECT doc_id, 1 + CAST(floor(n_chars / 3000) AS BIGINT) AS pages FROM documents)""")
def required_credits(t: Tables) -> DataFrame:
    pages = (F.lit(1) + F.floor(F.col("n_chars") / 3000)).cast("long")
    return t.documents.select("doc_id", P.required_credits(pages, F.col("doc_id") % 3 == 0).alias("required"),
                              P.can_access_premium(F.col("doc_id") % 60).alias("premium"))
