"""Credit ledger and payment reconciliation (survey group C)."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from quillmeter.functions.exprs import first_rule, micros
from quillmeter.operators.paths import CHUNK_ROWS, entering_states, finished_chunks, numbered, split_hot
from quillmeter.operators.scans import ordered_fold, running_total, time_chunk, top_k
from quillmeter.sources.sinks import written

MAX_DEDUCTION = 1000
EXPIRY_DAYS = 90
DAY_MICROS = 86_400_000_000


def deduction_check(requests: DataFrame, amount: str, max_amount: int = MAX_DEDUCTION) -> DataFrame:
    """C1: 'ok', 'invalid_amount' (not a positive integer) or 'amount_too_large'."""
    a = F.col(amount)
    bad = a.isNull() | (a <= 0) | (a != F.floor(a))
    return requests.withColumn(
        "status", first_rule([(bad, "invalid_amount"), (a > max_amount, "amount_too_large")], "ok")
    )


def running_balance(
    ledger: DataFrame, user: str, ts: str, tie: str, change: str, out: str = "balance_after", chunk_seconds: int = 86400
) -> DataFrame:
    """Balance after each transaction, as a two-level prefix sum (no task holds a whole user)."""
    return running_total(ledger, [user], [ts, tie], {out: F.col(change)}, time_chunk(ts, chunk_seconds))


ACCOUNT_STATE = "credits long, deadline long, used boolean"
ACCOUNT_ROWS = "user_id long, event_id long, at_us long, type string, amount long"
ACCOUNT_OUT = "accepted boolean, balance long, expired_credits long"


def account_step(keep: int):
    """One ledger event against [credits, deadline, used]: expire if due, then grant or deduct.

    The deadline is ``keep`` after the last accepted deduction; before the first one, after the purchase that found no
    running deadline.
    """

    def step(s: list, row: tuple) -> tuple[bool, int, int]:
        now, kind, amount, gone = row[2], row[3], row[4], 0
        if s[1] is not None and s[0] > 0 and s[1] < now:
            gone, s[0] = s[0], 0
        if kind == "purchase":
            s[0] += amount
            if not s[2] and (s[1] is None or s[1] < now):
                s[1] = now + keep
            return True, s[0], gone
        if s[0] < amount:
            return False, s[0], gone
        s[0] -= amount
        s[1], s[2] = now + keep, True
        return True, s[0], gone

    return step


def account_start() -> list:
    return [0, None, False]


#: Entering balances low..high and deadlines from..until make the same decisions; then the balance changes by ``shift`` or
#: becomes ``fixed``, and the deadline stays or becomes ``set_to``.
ACCOUNT_PIECE = (
    "low long, high long, since long, until long, unset boolean, used_before boolean, "
    "shift long, fixed long, set_to long, used_after boolean"
)
LEAST, MOST = -(2**63), 2**63 - 1


def account_piece(keep: int):
    """The piece of a chunk's map around one entering state; None: an empty account with a running deadline."""

    def run(rows: list[tuple], entering: tuple | None) -> tuple:
        credits, deadline, used = entering or (0, rows[0][2] + keep, True)
        first, unset, used_before = credits, deadline is None, used
        low, high, since, until, open_balance, own_deadline = LEAST, MOST, LEAST, MOST, True, False
        for row in rows:
            now, kind, amount = row[2], row[3], row[4]
            due = deadline is not None and deadline < now
            if deadline is not None and not own_deadline:
                since, until = (since, min(until, now)) if due else (max(since, now), until)
            if due:
                credits, open_balance = 0, False
            if kind == "purchase":
                credits += amount
                if not used and (deadline is None or due):
                    deadline, own_deadline = now + keep, True
                continue
            accepted = credits >= amount
            if open_balance:
                limit = amount - (credits - first)
                low, high = (max(low, limit), high) if accepted else (low, min(high, limit - 1))
            if accepted:
                credits -= amount
                deadline, used, own_deadline = now + keep, True, True
        shift, fixed = (credits - first, None) if open_balance else (None, credits)
        return low, high, since, until, unset, used_before, shift, fixed, deadline if own_deadline else None, used

    return run


#: Pieces of one chunk's map that are kept; beyond them those next to the entering balance.
MOST_PIECES = 4096


def account_pieces(keep: int):
    """``account_piece`` for all entering balances up to ``bound`` at once: a range of balances is cut where a deduction is
    accepted for its upper part only, so the pieces are the whole map for one entering deadline."""

    def run(rows: list[tuple], entering: tuple | None, bound: int) -> list[tuple]:
        credits, deadline, used_before = entering or (0, rows[0][2] + keep, True)
        unset = deadline is None
        whole = [[min(0, credits)], [max(bound, credits)], [min(0, credits)], [0 if unset else deadline], [LEAST], [MOST]]
        low, high, now_has, due_at, since, until = (np.array(v, dtype=np.int64) for v in whole)
        is_open, own, running, used = (np.array([v]) for v in (True, False, not unset, used_before))
        for row in rows:
            now, kind, amount = row[2], row[3], row[4]
            due = running & (due_at < now)
            given = running & ~own
            if given.any():
                since, until = np.where(given & ~due, np.maximum(since, now), since), np.where(given & due, np.minimum(until, now), until)
            if due.any():
                now_has, is_open = np.where(due, 0, now_has), is_open & ~due
            if kind == "purchase":
                now_has = now_has + amount
                starts = ~used & (~running | due)
                if starts.any():
                    due_at, own, running = np.where(starts, now + keep, due_at), own | starts, running | starts
                continue
            cut = np.flatnonzero(is_open & (now_has < amount) & (now_has + (high - low) >= amount))
            if cut.size:
                at = low[cut] + (amount - now_has[cut])
                low, now_has = np.insert(low, cut + 1, at), np.insert(now_has, cut + 1, amount)
                upper = high[cut]
                high[cut] = at - 1
                high = np.insert(high, cut + 1, upper)
                due_at, since, until, is_open, own, running, used = (np.insert(v, cut + 1, v[cut]) for v in (due_at, since, until, is_open, own, running, used))
                if len(low) > MOST_PIECES:
                    first = max(0, int(np.searchsorted(low, credits, "right")) - 1 - MOST_PIECES // 4)
                    near = slice(first, first + MOST_PIECES // 2)
                    low, high, now_has, due_at, since, until, is_open, own, running, used = (
                        v[near] for v in (low, high, now_has, due_at, since, until, is_open, own, running, used))
            accepted = now_has >= amount
            if accepted.any():
                now_has = np.where(accepted, now_has - amount, now_has)
                due_at, own, running, used = np.where(accepted, now + keep, due_at), own | accepted, running | accepted, used | accepted
        return [
            (a, b, f, u, unset, used_before, c - a if o else None, None if o else c, d if w else None, e)
            for a, b, f, u, o, c, d, w, e in zip(*(v.tolist() for v in (low, high, since, until, is_open, now_has, due_at, own, used)), strict=True)
        ]

    return run


def balance_bounds(rows: DataFrame, keys: Sequence[str], chunk_rows: int) -> DataFrame:
    """(keys, __chunk, __bound): no balance that enters a chunk is above ``__bound``.

    A deduction of ``a`` either takes ``a`` off or leaves a balance below ``a``. So the bound moves with all amounts, as if
    none was refused, and is at least the last refusable amount less one. Expiry only lowers balances.
    """
    change = F.when(F.col("type") == "purchase", F.col("amount")).otherwise(-F.col("amount"))
    chunk = F.floor(F.col("i") / chunk_rows)
    inside = W.partitionBy(*keys, "__chunk").orderBy("i").rowsBetween(W.unboundedPreceding, 0)
    moved = rows.select(*keys, "i", "type", "amount", chunk.alias("__chunk"), change.alias("c")).withColumn("p", F.sum("c").over(inside))
    left = F.max(F.when(F.col("type") != "purchase", F.col("amount") - 1 - F.col("p")))
    sums = moved.groupBy(*keys, "__chunk").agg(F.sum("c").alias("net"), left.alias("left"))
    before = W.partitionBy(*keys).orderBy("__chunk").rowsBetween(W.unboundedPreceding, -1)
    offset = sums.withColumn("p", F.coalesce(F.sum("net").over(before), F.lit(0)))
    above = F.coalesce(F.max(F.col("left") - F.col("p")).over(before), F.lit(0))
    return offset.select(*keys, "__chunk", (F.col("p") + F.greatest(F.lit(0), above)).cast("long").alias("__bound"))


def piece_holds(piece: tuple, state: tuple) -> bool:
    low, high, since, until, unset, used_before = piece[:6]
    balance, deadline, used = state
    if used != used_before or unset != (deadline is None) or not low <= balance <= high:
        return False
    return deadline is None or since <= deadline < until or (until == MOST and since <= deadline)


def leaving(piece: tuple, state: tuple) -> tuple:
    shift, fixed, set_to, used = piece[6:]
    return (state[0] + shift if fixed is None else fixed, state[1] if set_to is None else set_to, used)


def account_rows(ledger: DataFrame, user: str, ts: str, tie: str, kind: str, amount: str) -> DataFrame:
    return ledger.select(
        F.col(user).alias("user_id"), F.col(tie).alias("event_id"), micros(ts).alias("at_us"),
        F.col(kind).alias("type"), F.col(amount).cast("long").alias("amount"),
    )


def conditional_balance(
    ledger: DataFrame, user: str, ts: str, tie: str, kind: str, amount: str, expiry_days: int = EXPIRY_DAYS,
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Deductions are refused when the balance is short; credits expire ``expiry_days`` after the
    last use, or after the purchase when never used. ``amount`` is positive for both kinds.

    Each decision depends on all earlier ones, so a user's events are read in order with one small account at a
    time. A user with more than ``chunk_rows`` events is cut into chunks of that size, which find out what enters
    them by composing their maps (``paths.entering_states``) and then run side by side.
    """
    keep = expiry_days * DAY_MICROS
    order, out, schema = ["at_us", "event_id"], ["accepted", "balance", "expired_credits"], f"{ACCOUNT_ROWS}, {ACCOUNT_OUT}"
    cold, hot = split_hot(account_rows(ledger, user, ts, tie, kind, amount), ["user_id"], chunk_rows)
    decided = ordered_fold(cold, ["user_id"], order, schema, account_start, account_step(keep), out)
    if hot is None:
        return decided
    rows = written(numbered(hot, ["user_id"], order, "at_us", DAY_MICROS), "ledger-rows")
    entries = entering_states(
        rows, ["user_id"], ACCOUNT_STATE, ACCOUNT_PIECE, tuple(account_start()), account_pieces(keep), piece_holds, leaving,
        balance_bounds(rows, ["user_id"], chunk_rows), chunk_rows,
    )
    return decided.unionByName(finished_chunks(rows, ["user_id"], entries, chunk_rows, schema, account_step(keep), out))


def history_page(ledger: DataFrame, user: str, ts: str, tie: str, limit: int = 50, offset: int = 0) -> DataFrame:
    """C4: rows offset+1 .. offset+limit of each user's history, newest first."""
    return top_k(ledger, [user], [F.col(ts).desc(), F.col(tie).desc()], offset + limit).where(F.col("rank") > offset)


def first_grant_per_order(verifications: DataFrame, order_id: str, ts: str, tie: str) -> DataFrame:
    """The first verification of an order grants credits; later ones are ignored."""
    return top_k(verifications, [order_id], [F.col(ts), F.col(tie)], 1).drop("rank")


def reconcile_payments(payments: DataFrame, orders: DataFrame, stored: str | None = None) -> DataFrame:
    """Status of each payment: order_not_found, wrong_owner, already_processed, invalid_credits or ok.

    payments(payment_id, order_id, user_id, ts), orders(order_id, owner_id, credits). Only a payment that
    passes the earlier checks marks the order as paid; the first such one wins. ``stored`` names the column of
    orders with the payment that paid it before, if any: other payments of such an order are already_processed.
    A payment without a user is not the owner's.
    """
    joined = payments.join(orders, "order_id", "left")
    good = F.col("owner_id").isNotNull() & (F.col("owner_id") == F.col("user_id")) & (F.col("credits") > 0)
    first = joined.where(good).groupBy("order_id").agg(F.min(F.struct("ts", "payment_id")).alias("__first"))
    status = first_rule(
        [
            (F.col("owner_id").isNull(), "order_not_found"),
            (~F.col("owner_id").eqNullSafe(F.col("user_id")), "wrong_owner"),
            *([(F.col(stored).isNotNull() & (F.col(stored) != F.col("payment_id")), "already_processed")] if stored else []),
            (F.struct("ts", "payment_id") > F.col("__first"), "already_processed"),
            (F.coalesce(F.col("credits"), F.lit(0)) <= 0, "invalid_credits"),
        ],
        "ok",
    )
    return joined.join(first, "order_id", "left").withColumn("status", status).drop("__first")


def orphan_payments(payments: DataFrame, orders: DataFrame) -> DataFrame:
    """Payments without any order."""
    return payments.join(orders, "order_id", "left_anti")


def lifetime_totals(ledger: DataFrame, user: str, change: str) -> DataFrame:
    """Credits ever earned and used."""
    c = F.col(change)
    return ledger.groupBy(user).agg(
        F.coalesce(F.sum(F.when(c > 0, c)), F.lit(0)).alias("total_earned"),
        F.coalesce(F.sum(F.when(c < 0, -c)), F.lit(0)).alias("total_used"),
    )


def sufficient_credits(requests: DataFrame, balances: DataFrame, on: Sequence[str], need: str, have: str) -> DataFrame:
    """A missing balance counts as zero."""
    return requests.join(balances, list(on), "left").withColumns(
        {have: F.coalesce(have, F.lit(0)), "sufficient": F.coalesce(have, F.lit(0)) >= F.col(need)}
    )


def ledger_audit(ledger: DataFrame, user: str, ts: str, tie: str, change: str, stored: str) -> DataFrame:
    """Rows whose stored balance differs from the recomputed one."""
    return running_balance(ledger, user, ts, tie, change, "recomputed").where(F.col(stored) != F.col("recomputed"))


def receipts(payments: DataFrame, orders: DataFrame, users: DataFrame, balances: DataFrame) -> DataFrame:
    """Payment + order + user + balance in one row."""
    return payments.join(orders, "order_id").join(users, "user_id").join(balances, "user_id", "left")
