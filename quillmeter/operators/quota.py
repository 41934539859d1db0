"""Quotas, rate limits, eligibility and lockout (survey group D)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmeter.functions.exprs import col, first_rule, micros
from quillmeter.operators.paths import CHUNK_ROWS, numbered, path_nodes, split_hot, with_next
from quillmeter.operators.scans import join_null_safe, ordered_fold, running_min_before, running_total, time_chunk, top_k
from quillmeter.sources.sinks import written

MB = 1024 * 1024


@dataclass(frozen=True)
class MonthlyLimits:
    count: int
    upload_mb: int
    max_file_mb: int
    download_mb: int | None = None


# Free monthly limits by operation, free window, rate limits, lockout, tier limits.
IMAGE_LIMITS = MonthlyLimits(count=40, upload_mb=10, max_file_mb=1, download_mb=10)
PDF_LIMITS = MonthlyLimits(count=10, upload_mb=50, max_file_mb=50)
FREE_PDFS, FREE_WINDOW_HOURS = 5, 24
RATE_LIMITS = {"api": ("15 minutes", 100), "ocr": ("1 hour", 50), "upload": ("1 hour", 20)}
MAX_FAILED, LOCK_MINUTES = 5, 30
FREE_TEXT_PAGES, FREE_OCR_PAGES, FREE_MAX_PAGES, FREE_MAX_MB = 1, 0, 1, 2
PREMIUM_MIN_CREDITS, PREMIUM_MAX_PAGES, PREMIUM_MAX_MB = 30, 100, 100
DAILY_DOCS, DAILY_PAGES = 10, 150


def monthly_counters(usage: DataFrame, device: str, ts: str, upload: str, download: str) -> DataFrame:
    """Counters by device and UTC month; the month key is the roll-over. Bytes stay integral."""
    return usage.groupBy(device, F.date_format(ts, "yyyy-MM").alias("month")).agg(
        F.count(F.lit(1)).alias("used_count"),
        F.sum(upload).alias("upload_bytes"),
        F.sum(download).alias("download_bytes"),
    )


def quota_decision(counters: DataFrame, limits: MonthlyLimits = IMAGE_LIMITS) -> DataFrame:
    """Allowed flag, blocking reason and what remains (smallest of the allowances, floored, >= 0)."""
    up, down = F.col("upload_bytes") / MB, F.col("download_bytes") / MB
    left = [F.lit(limits.count) - F.col("used_count"), F.floor(F.lit(limits.upload_mb) - up)]
    rules = [(F.col("used_count") >= limits.count, "count"), (up >= limits.upload_mb, "upload")]
    if limits.download_mb is not None:
        left.append(F.floor(F.lit(limits.download_mb) - down))
        rules.append((down >= limits.download_mb, "download"))
    reason = first_rule(rules)
    return counters.withColumns(
        {
            "blocked_by": reason,
            "allowed": reason.isNull(),
            "remaining": F.greatest(F.lit(0), F.least(*left)).cast("long"),
        }
    )


def admission_step(limits: MonthlyLimits):
    """One request (size and amount at positions 4, 5) against [count, bytes] used by its device and month."""

    def step(used: list, row: tuple) -> tuple[bool]:
        ok = (
            row[4] <= limits.max_file_mb * MB and used[0] + row[5] <= limits.count and used[1] + row[4] <= limits.upload_mb * MB
        )
        if ok:
            used[0] += row[5]
            used[1] += row[4]
        return (ok,)

    return step


def units(amount: str | None) -> Column:
    """Units of a request: one where nothing is said. Amounts are whole and not negative."""
    return F.lit(1).cast("long") if amount is None else F.coalesce(F.col(amount).cast("long"), F.lit(1).cast("long"))


def admission(
    requests: DataFrame, device: str, ts: str, tie: str, size: str, limits: MonthlyLimits = IMAGE_LIMITS,
    chunk_seconds: int = 86400, amount: str | None = None,
) -> DataFrame:
    """D3: accept in time order while count and upload fit; only accepted requests use quota. A request asks for
    ``amount`` units (one if not given); with an amount the result has a column ``amount`` too.

    A plain running sum is wrong after the first refusal. Most requests of a busy device can be
    refused without looking at their order in detail, and are, before the ordered pass:

    * a file above the size limit, or more units than the limit, never fit;
    * among the requests for ``a`` units in one size class [2^k, 2^(k+1)) at most ``count / a`` are accepted before
      the class sees its first refusal. If units were short, all later ones of the class are refused too. If
      bytes were short, less than 2^(k+1) is left, so one more acceptance leaves less than 2^k: at most one
      more of that class fits, and a later request as large as an earlier refused one is refused, because what is
      left only shrinks. So beyond the first ``count / a + 1`` requests of a class only a new strict minimum of
      those later ones can still be accepted.

    The rest (a bounded number of requests per class, and new size minima) is folded in order; refused rows are
    restored by a join on the request id, so every request gets its decision. Requests for no units are limited by
    size alone: of these the classes have no first part, and all stay in the fold.
    """
    cap, most = limits.upload_mb * MB, limits.max_file_mb * MB
    rows = requests.select(
        F.col(device).alias("device"), F.date_format(ts, "yyyy-MM").alias("month"),
        micros(ts).alias("at_us"), F.col(tie).alias("request_id"), F.col(size).cast("long").alias("size"), F.col(ts).alias("ts"),
        units(amount).alias("amount"),
    )
    keys, order = ["device", "month"], ["at_us", "request_id"]
    fits = rows.where((F.col("size") <= most) & (F.col("size") <= cap) & (F.col("amount") <= limits.count)).withColumn(
        "cls", F.when(F.col("size") > 0, F.length(F.bin("size"))).otherwise(0)
    )
    classes = [*keys, "amount", "cls"]
    numbered_ = running_total(fits, classes, order, {"nth": F.lit(1).cast("long")}, time_chunk("ts", chunk_seconds))
    first = (F.col("amount") <= 0) | (F.col("nth") <= F.floor(limits.count / F.col("amount")) + 1)
    later = running_min_before(
        numbered_.where(~first), classes, order, F.col("size"), time_chunk("ts", chunk_seconds), "least"
    ).where(F.col("least").isNull() | (F.col("size") < F.col("least")))
    candidates = numbered_.where(first).select(*keys, *order, "size", "amount").unionByName(
        later.select(*keys, *order, "size", "amount")
    )

    decided = ordered_fold(
        candidates, keys, order,
        "device long, month string, at_us long, request_id long, size long, amount long, accepted boolean",
        lambda: [0, 0], admission_step(limits), ["accepted"],
    ).where("accepted").select("request_id", F.lit(True).alias("accepted"))
    shown = rows.drop("at_us") if amount else rows.drop("at_us", "amount")
    return shown.join(decided, "request_id", "left").withColumn("accepted", F.coalesce("accepted", F.lit(False)))


def abuse_key(ip: str, agent: str, fingerprint: str) -> Column:
    """First 16 hex digits of sha-256 over 'ip|agent|fingerprint'."""
    parts = [F.coalesce(col(c).cast("string"), F.lit("")) for c in (ip, agent, fingerprint)]
    return F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 16)


def free_window_step(max_pdfs: int = FREE_PDFS, hours: int = FREE_WINDOW_HOURS):
    """One request (time and amount at positions 2, 3) against [start, used]."""
    span = hours * 3_600_000_000

    def step(s: list, row: tuple) -> tuple[bool, int]:
        if s[0] is None or row[2] - s[0] >= span:
            s[0], s[1] = row[2], 0
        ok = s[1] + row[3] <= max_pdfs
        s[1] += row[3] if ok else 0
        return ok, max_pdfs - s[1]

    return step


def free_window_rows(requests: DataFrame, key: str, ts: str, tie: str, requested: str | None = None) -> DataFrame:
    return requests.select(F.col(key).alias("key"), F.col(tie).alias("request_id"), micros(ts).alias("at_us"), units(requested).alias("requested"))


FREE_WINDOW_OUT = "key string, request_id long, at_us long, requested long, allowed boolean, remaining long"


def free_window(
    requests: DataFrame, key: str, ts: str, tie: str, max_pdfs: int = FREE_PDFS, hours: int = FREE_WINDOW_HOURS,
    requested: str | None = None, chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """A counter that restarts at the first request 24 h or more after its own start. A request asks for
    ``requested`` files (one if not given) and is refused whole if fewer remain.

    Not a tumbling window: the start depends on the requests themselves. Keys with more than ``chunk_rows`` requests
    are cut into chunks of that size (``paths``).
    """
    rows = free_window_rows(requests, key, ts, tie, requested)
    cold, hot = split_hot(rows, ["key"], chunk_rows)
    out = ordered_fold(
        cold, ["key"], ["at_us", "request_id"], FREE_WINDOW_OUT, lambda: [None, 0], free_window_step(max_pdfs, hours), ["allowed", "remaining"],
    )
    if hot is not None:
        out = out.unionByName(_free_window_of_hot_keys(hot, max_pdfs, hours * 3_600_000_000, chunk_rows))
    return out if requested else out.drop("requested")


def _free_window_of_hot_keys(rows: DataFrame, max_pdfs: int, span: int, chunk_rows: int) -> DataFrame:
    """D7 without an ordered pass: the requests that open windows are the path of "first request ``span`` later".

    In a window a request for ``a`` files is surely refused behind the first ``max / a + 1`` requests for as many: at
    most ``max / a`` of these were accepted, and what remains only shrinks. The few others are folded.
    """
    hour = 3_600_000_000
    counted = written(with_next(numbered(rows, ["key"], ["at_us", "request_id"], "at_us", hour), ["key"], "at_us", span, hour), "window-rows")
    opening = path_nodes(counted.withColumn("jumps", F.array("next")), ["key"], 1, chunk_rows).select("key", "i", F.lit(1).cast("long").alias("opens"))
    chunk = F.floor(F.col("i") / chunk_rows)
    marked = join_null_safe(counted, opening, ["key", "i"], "left").fillna({"opens": 0})
    windows = written(running_total(marked, ["key"], ["i"], {"window": F.col("opens")}, chunk), "window-numbers")
    window = ["key", "window"]

    limited = windows.where((F.col("requested") > 0) & (F.col("requested") <= max_pdfs)).select(*window, "requested", "i")
    first = top_k(limited, [*window, "requested"], [F.col("i")], max_pdfs + 1).where(F.col("rank") <= F.floor(max_pdfs / F.col("requested")) + 1)
    few = first.groupBy(*window).agg(F.sort_array(F.collect_list(F.struct("i", "requested"))).alias("few"))
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<bigint>").alias("taken"))

    def take(s, x):
        fits = s["used"] + x["requested"] <= max_pdfs
        return F.struct(
            F.when(fits, s["used"] + x["requested"]).otherwise(s["used"]).alias("used"),
            F.when(fits, F.array_append(s["taken"], x["i"])).otherwise(s["taken"]).alias("taken"),
        )

    taken = few.select("key", F.explode(F.aggregate("few", start, take)["taken"]).alias("i"), F.lit(True).alias("taken"))
    decided = join_null_safe(windows, taken, ["key", "i"], "left").withColumn("allowed", F.coalesce("taken", F.col("requested") == 0))
    spent = F.when(F.col("allowed"), F.col("requested")).otherwise(0)
    return running_total(decided, window, ["i"], {"used": spent}, chunk).select(
        "key", "request_id", "at_us", "requested", "allowed", (max_pdfs - F.col("used")).alias("remaining")
    )


def daily_pages(usage: DataFrame, user: str, ts: str, pages: str, is_ocr: str) -> DataFrame:
    """Text and OCR pages per user and UTC day with what remains of the free allowance."""
    text = F.sum(F.when(~F.col(is_ocr), F.col(pages)).otherwise(0))
    ocr = F.sum(F.when(F.col(is_ocr), F.col(pages)).otherwise(0))
    return usage.groupBy(user, F.to_date(ts).alias("day")).agg(
        text.alias("text_pages"), ocr.alias("ocr_pages"),
        F.greatest(F.lit(0), F.lit(FREE_TEXT_PAGES) - text).alias("text_remaining"),
        F.greatest(F.lit(0), F.lit(FREE_OCR_PAGES) - ocr).alias("ocr_remaining"),
    )


def rate_limit(requests: DataFrame, client: str, ts: str, width: str, maximum: int) -> DataFrame:
    """Requests per client and tumbling window, with the number refused."""
    counts = requests.groupBy(client, F.window(ts, width).alias("w")).agg(F.count(F.lit(1)).alias("requests"))
    return counts.select(
        client, F.col("w.start").alias("window_start"), "requests",
        F.greatest(F.lit(0), F.col("requests") - maximum).alias("refused"),
    )


def free_tier_reason(signed_in: Column, pages: Column, size: Column, tables: Column, id_card: Column) -> Column:
    """First failed rule of the free tier, else 'eligible'."""
    return first_rule(
        [
            (signed_in, "must_use_credits"),
            (pages > FREE_MAX_PAGES, "exceeds_pages"),
            (size > FREE_MAX_MB * MB, "exceeds_size"),
            (tables | id_card, "requires_excel"),
        ],
        "eligible",
    )


def premium_reason(credits: Column, pages: Column, size: Column, cost_per_page: Column) -> Column:
    """First failed premium rule, else 'eligible'. A missing balance counts as zero."""
    have = F.coalesce(credits, F.lit(0.0))
    return first_rule(
        [
            (have < PREMIUM_MIN_CREDITS, "below_minimum"),
            (pages > PREMIUM_MAX_PAGES, "exceeds_pages"),
            (size > PREMIUM_MAX_MB * MB, "exceeds_size"),
            (have < pages * cost_per_page, "insufficient_credits"),
        ],
        "eligible",
    )


def lockout_step(max_failed: int = MAX_FAILED, lock_minutes: int = LOCK_MINUTES):
    """One attempt (time, success at positions 2, 3) against [failed, locked until]."""
    span = lock_minutes * 60_000_000

    def step(s: list, row: tuple) -> tuple[str, int]:
        if s[1] is not None and s[1] > row[2]:
            return "locked", s[0]
        if row[3]:
            s[0], s[1] = 0, None
            return "ok", 0
        s[0] += 1
        if s[0] >= max_failed:
            s[1] = row[2] + span
        return "failed", s[0]

    return step


def lockout_rows(logins: DataFrame, user: str, ts: str, tie: str, success: str) -> DataFrame:
    return logins.select(
        F.col(user).alias("user_id"), F.col(tie).alias("event_id"), micros(ts).alias("at_us"), F.col(success).alias("success")
    )


LOCKOUT_OUT = "user_id long, event_id long, at_us long, success boolean, outcome string, failed_attempts long"


def lockout(
    logins: DataFrame, user: str, ts: str, tie: str, success: str, max_failed: int = MAX_FAILED,
    lock_minutes: int = LOCK_MINUTES, chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """The fifth failure locks for 30 minutes; attempts while locked change nothing; a success
    resets. After a lock the count stays, so the next failure locks again. Users with more than ``chunk_rows``
    attempts are cut into chunks of that size (``paths``)."""
    cold, hot = split_hot(lockout_rows(logins, user, ts, tie, success), ["user_id"], chunk_rows)
    out = ordered_fold(
        cold, ["user_id"], ["at_us", "event_id"], LOCKOUT_OUT, lambda: [0, None], lockout_step(max_failed, lock_minutes), ["outcome", "failed_attempts"],
    )
    return out if hot is None else out.unionByName(_lockout_of_hot_users(hot, max_failed, lock_minutes * 60_000_000, chunk_rows))


def _lockout_of_hot_users(rows: DataFrame, max_failed: int, span: int, chunk_rows: int) -> DataFrame:
    """D12 without an ordered pass: the attempts made while unlocked are a path.

    Its nodes are an attempt and the failures before it, up to ``max_failed - 1``: a success leads to the next attempt
    with none, a failure to the next one with one more, the failure that locks to the first attempt after the lock.
    """
    keys, hour = ["user_id"], 3_600_000_000
    counted = numbered(rows, keys, ["at_us", "event_id"], "at_us", hour)
    counted = written(with_next(counted, keys, "at_us", span, hour).withColumn("good", F.coalesce("success", F.lit(False))), "lockout-rows")
    after = (F.col("i") + 1) * max_failed
    jumps = [F.when(F.col("good"), after).otherwise(after + c + 1) for c in range(max_failed - 1)]
    jumps.append(F.when(F.col("good"), after).otherwise(F.col("next") * max_failed + max_failed - 1))
    open_ = path_nodes(counted.withColumn("jumps", F.array(*jumps)), keys, max_failed, chunk_rows).select(*keys, "i", F.lit(True).alias("open"))
    chunk = F.floor(F.col("i") / chunk_rows)
    decided = join_null_safe(counted, open_, [*keys, "i"], "left").withColumn("open", F.coalesce("open", F.lit(False)))
    resets = F.when(F.col("open") & F.col("good"), 1).otherwise(0).cast("long")
    failures = F.when(F.col("open") & ~F.col("good"), 1).otherwise(0).cast("long")
    spans = written(running_total(decided, keys, ["i"], {"reset": resets}, chunk), "lockout-spans")
    outcome = F.when(~F.col("open"), "locked").when(F.col("good"), "ok").otherwise("failed")
    return running_total(spans, [*keys, "reset"], ["i"], {"failed_attempts": failures}, chunk).select(
        *keys, "event_id", "at_us", "success", outcome.alias("outcome"), "failed_attempts"
    )


def client_ip(forwarded: str, real_ip: str, remote: str) -> Column:
    """First forwarded address, else the real-ip header, else the socket address."""
    def filled(c: Column) -> Column:
        return F.nullif(c, F.lit(""))

    first = F.trim(F.element_at(F.split(F.col(forwarded), ","), 1))
    return F.coalesce(filled(first), filled(F.col(real_ip)), filled(F.col(remote)), F.lit("unknown"))


def daily_caps(conversions: DataFrame, user: str, ts: str, pages: str, requested: int = 1) -> DataFrame:
    """Documents and pages of each user and day against the premium caps."""
    usage = conversions.groupBy(user, F.to_date(ts).alias("day")).agg(
        F.count(F.lit(1)).alias("documents"), F.sum(pages).alias("pages")
    )
    reason = first_rule(
        [(F.col("documents") >= DAILY_DOCS, "documents"), (F.col("pages") + requested > DAILY_PAGES, "pages")], "within"
    )
    return usage.withColumns({"cap": reason, "allowed": reason == "within"})
