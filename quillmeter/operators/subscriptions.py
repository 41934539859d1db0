"""Subscription state, expiry and payment webhooks (survey group E)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from quillmeter.functions.exprs import col, first_rule, lookup

# Limits by plan; -1 means unlimited.
PLANS = {
    "free": {"pdfs": 3, "storage_gb": 0.1, "api_calls": 100, "max_file": 50 * 1024 * 1024},
    "premium": {"pdfs": -1, "storage_gb": -1.0, "api_calls": -1, "max_file": 200 * 1024 * 1024},
    "business": {"pdfs": -1, "storage_gb": -1.0, "api_calls": -1, "max_file": -1},
}
PAID_DAYS = 30


def plan_limit(plan: str | Column, name: str) -> Column:
    """A limit of the plan; unknown or missing plans get the free limit."""
    table = {p: v[name] for p, v in PLANS.items()}
    return F.coalesce(lookup(table, col(plan)), F.lit(table["free"]))


def plan_limits(subs: DataFrame, plan: str = "plan") -> DataFrame:
    return subs.withColumns({f"limit_{n}": plan_limit(plan, n) for n in PLANS["free"]})


def _due(now: Column) -> Column:
    return (F.col("status") == "active") & (F.col("plan") != "free") & (F.col("expires_at") < now)


def expire_subscriptions(subs: DataFrame, now: Column) -> DataFrame:
    """Active paid plans past their end become free and expired and remember the plan and the moment.

    Rows that are not due keep their earlier previous_plan and expired_at, null where they have none.
    """
    due = F.coalesce(_due(now), F.lit(False))
    earlier = {c: F.col(c) if c in subs.columns else F.lit(None) for c in ("previous_plan", "expired_at")}
    return subs.withColumns(
        {
            "previous_plan": F.when(due, F.col("plan")).otherwise(earlier["previous_plan"]),
            "expired_at": F.when(due, now).otherwise(earlier["expired_at"]),
            "plan": F.when(due, "free").otherwise(F.col("plan")),
            "status": F.when(due, "expired").otherwise(F.col("status")),
        }
    )


def expiry_activity(subs: DataFrame, now: Column) -> DataFrame:
    """One activity row for each subscription that expires."""
    return subs.where(_due(now)).select(
        "user_id", F.lit("subscription_expired").alias("type"),
        F.col("plan").alias("previous_plan"), F.col("expires_at").alias("expired_at"),
    )


def downgrade_to_free(users: DataFrame, when: Column) -> DataFrame:
    """Where ``when`` holds: free plan, no end date, free limits, usage back to zero."""
    hit = F.coalesce(when, F.lit(False))
    free = PLANS["free"]
    return users.withColumns(
        {
            "plan": F.when(hit, "free").otherwise(F.col("plan")),
            "status": F.when(hit, "active").otherwise(F.col("status")),
            "expires_at": F.when(~hit, F.col("expires_at")),
            "limit_pdfs": F.when(hit, free["pdfs"]).otherwise(plan_limit("plan", "pdfs")),
            "limit_storage_gb": F.when(hit, free["storage_gb"]).otherwise(plan_limit("plan", "storage_gb")),
            "limit_api_calls": F.when(hit, free["api_calls"]).otherwise(plan_limit("plan", "api_calls")),
            "used": F.when(hit, 0).otherwise(F.col("used")),
        }
    )


def address_spans(addresses: DataFrame) -> DataFrame:
    """(user_id, email, since, until): when an address belongs to a user, from a table of changes (user_id, email, since,
    change_id). It ends when the user takes another address or another user takes it. Addresses are compared in
    lower case. Spans of one address do not overlap."""
    change = addresses.select("user_id", F.lower("email").alias("email"), "since", "change_id")
    order = ["since", "change_id"]
    moved = F.lead("since").over(W.partitionBy("user_id").orderBy(*order))
    taken = F.lead("since").over(W.partitionBy("email").orderBy(*order))
    return change.withColumns({"moved": moved, "taken": taken}).select(
        "user_id", "email", "since", F.least("moved", "taken").alias("until")
    ).where("until IS NULL OR since < until")


def with_owners(events: DataFrame, addresses: DataFrame) -> DataFrame:
    """``user_id`` of events that only name an address (``email``): its owner at the time of the event.

    events(…, ts, user_id, email), a batch or a stream; addresses as in ``address_spans``. Events without an address keep
    their user; those whose address belongs to nobody at that time have none. An as-of join: equality on the
    address, and the one span that covers the time.
    """
    spans = address_spans(addresses).select(
        F.col("user_id").alias("__owner"), F.col("email").alias("__email"), F.col("since").alias("__since"), F.col("until").alias("__until")
    )
    covers = (F.col("ts") >= F.col("__since")) & (F.col("__until").isNull() | (F.col("ts") < F.col("__until")))
    joined = events.join(spans, (F.lower("email") == F.col("__email")) & covers, "left")
    owner = F.when(F.col("email").isNull(), F.col("user_id")).otherwise(F.col("__owner"))
    return joined.withColumn("user_id", owner).drop("__owner", "__email", "__since", "__until")


def webhook_effects(events: DataFrame) -> DataFrame:
    """What each webhook sets: plan, status and end date; null leaves a field as it was.

    events(event_id, ts, user_id, event, plan, end_at): captured payments run 30 days from now.
    """
    e = F.col("event")
    captured = e == "payment.captured"
    dated = e.isin("subscription.activated", "subscription.charged")
    return events.where(F.col("user_id").isNotNull()).select(
        "user_id", "ts", "event_id",
        F.when(captured, F.coalesce("plan", F.lit("basic"))).alias("plan"),
        first_rule(
            [(captured | (e == "subscription.activated"), "active"), (e == "subscription.cancelled", "cancelled")]
        ).alias("status"),
        F.when(captured, F.col("ts") + F.expr(f"interval {PAID_DAYS} days"))
        .when(dated, F.col("end_at")).alias("expires_at"),
    )


def webhook_state(events: DataFrame) -> DataFrame:
    """Subscription state per user: the last non-null effect on each field (map-side combine)."""
    at = F.struct("ts", "event_id")
    return webhook_effects(events).groupBy("user_id").agg(
        *[F.max_by(f, F.when(F.col(f).isNotNull(), at)).alias(f) for f in ("plan", "status", "expires_at")]
    )


def webhook_audit(events: DataFrame) -> DataFrame:
    """Audit rows written for captured and failed payments."""
    return events.where(
        F.col("event").isin("payment.captured", "payment.failed") & F.col("user_id").isNotNull()
    ).select(
        "user_id", "event_id", F.replace("event", F.lit("."), F.lit("_")).alias("action"),
        F.when(F.col("event") == "payment.captured", "success").otherwise("failed").alias("status"),
    )


def apply_verified_payments(orders: DataFrame, payments: DataFrame) -> DataFrame:
    """E5: an order with a verified payment becomes completed and keeps the latest payment id."""
    last = payments.groupBy("order_id").agg(
        F.max_by("payment_id", F.struct("ts", "payment_id")).alias("payment_id"), F.max("ts").alias("completed_at")
    )
    return orders.join(last, "order_id", "left").withColumn(
        "status", F.when(F.col("payment_id").isNotNull(), "completed").otherwise(F.col("status"))
    )
