"""The same rules on streams.

State per key is a few numbers in a value state of the state store (``transformWithState``). A rule takes the rows of a
key and micro-batch in order, one by one. State that can not matter any more leaves the store: where a rule knows the
time from which its state is as good as none (a closed month, a window that has run out), a timer on event time
clears it; a state that equals that of a new key is cleared at once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from quillmeter.operators import ledger as L
from quillmeter.operators import quota as Q
from quillmeter.operators import subscriptions as S
from quillmeter.sources.sinks import append_stream, shared_folder

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: How late a row may arrive where state is cleared by time.
DELAY = "1 hour"


class OrderedRule(StatefulProcessor):
    """``step(state, row) -> outputs`` over the rows of a key; ``ends(key, state)`` is the time in microseconds from which
    the state no longer matters (None: it always does)."""

    def __init__(self, columns: Sequence[str], out_columns: Sequence[str], order: Sequence[str], state_schema: str, start: Callable[[], list], step: Callable[[list, tuple], tuple],
                 ends: Callable[[tuple, list], int | None] | None) -> None:
        self.columns, self.order = list(columns), [list(columns).index(c) for c in order]
        self.made = Row(*out_columns)
        self.state_schema, self.start, self.step, self.ends = state_schema, start, step, ends

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", self.state_schema)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        state = list(self.state.get()) if self.state.exists() else self.start()
        taken = sorted((tuple(r[c] for c in self.columns) for r in rows), key=lambda r: [r[i] for i in self.order])
        for row in taken:
            yield self.made(*row, *self.step(state, row))
        if state == self.start():
            self.state.clear()
            return
        self.state.update(tuple(state))
        if self.ends is not None and (end := self.ends(key, state)) is not None:
            self.handle.registerTimer(-(-end // 1000))

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        """A timer of an older state may come first; then the state still has a later end."""
        if self.state.exists():
            end = self.ends(key, list(self.state.get()))
            if end is not None and end <= expiredTimerInfo.getExpiryTimeInMs() * 1000:
                self.state.clear()
        yield from ()

    def close(self) -> None:
        pass


def stateful_fold(
    stream: DataFrame, keys: Sequence[str], order: Sequence[str], out_schema: str, state_schema: str,
    start: Callable[[], list], step: Callable[[list, tuple], tuple],
    ends: Callable[[tuple, list], int | None] | None = None, event_time: str | None = None, delay: str = DELAY, mode: str = "append",
) -> DataFrame:
    """Streaming twin of ``ordered_fold``. With ``ends``, ``event_time`` is a timestamp column; rows that come more than
    ``delay`` behind the latest are dropped, as their state may be gone."""
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    columns = [c for c in stream.columns if c != event_time]
    rule = OrderedRule(columns, T._parse_datatype_string(out_schema).names, order, state_schema, start, step, ends)
    timed = stream if event_time is None else stream.withWatermark(event_time, delay)
    return timed.groupBy(*keys).transformWithState(rule, out_schema, mode, "None" if ends is None else "EventTime")


def with_time(stream: DataFrame, micros: str = "at_us") -> DataFrame:
    return stream.withColumn("__at", F.timestamp_micros(micros))


def conditional_balance(ledger: DataFrame, user: str, ts: str, tie: str, kind: str, amount: str, expiry_days: int = L.EXPIRY_DAYS) -> DataFrame:
    """C3. An account is kept: whether it was used before decides about later deadlines."""
    return stateful_fold(
        L.account_rows(ledger, user, ts, tie, kind, amount), ["user_id"], ["at_us", "event_id"], f"{L.ACCOUNT_ROWS}, {L.ACCOUNT_OUT}",
        L.ACCOUNT_STATE, L.account_start, L.account_step(expiry_days * L.DAY_MICROS),
    )


def end_of_month(month: str) -> int:
    """First microsecond after a month given as year-month."""
    year, number = map(int, month.split("-"))
    after = datetime(year + number // 12, number % 12 + 1, 1, tzinfo=timezone.utc)
    return (after - datetime(1970, 1, 1, tzinfo=timezone.utc)) // timedelta(microseconds=1)


def admission(requests: DataFrame, device: str, ts: str, tie: str, size: str, limits: Q.MonthlyLimits = Q.IMAGE_LIMITS, amount: str | None = None, delay: str = DELAY) -> DataFrame:
    """D3. The counters of a month are cleared when it is over."""
    rows = requests.select(
        F.col(device).alias("device"), F.date_format(ts, "yyyy-MM").alias("month"), Q.micros(ts).alias("at_us"),
        F.col(tie).alias("request_id"), F.col(size).cast("long").alias("size"), Q.units(amount).alias("amount"),
    )
    out = stateful_fold(
        with_time(rows), ["device", "month"], ["at_us", "request_id"],
        "device long, month string, at_us long, request_id long, size long, amount long, accepted boolean", "count long, bytes long",
        lambda: [0, 0], Q.admission_step(limits), lambda key, state: end_of_month(key[1]), "__at", delay,
    )
    return out if amount else out.drop("amount")


def monthly_counters(usage: DataFrame, device: str, ts: str, tie: str, upload: str, download: str, delay: str = DELAY) -> DataFrame:
    """The counters of a device and month after each row; a month's state is cleared when it is over."""
    rows = usage.select(
        F.col(device).alias("device_id"), F.date_format(ts, "yyyy-MM").alias("month"), Q.micros(ts).alias("at_us"), F.col(tie).alias("event_id"),
        F.col(upload).cast("long").alias("upload"), F.col(download).cast("long").alias("download"),
    )

    def step(s: list, row: tuple) -> tuple[int, int, int]:
        s[0], s[1], s[2] = s[0] + 1, s[1] + (row[4] or 0), s[2] + (row[5] or 0)
        return tuple(s)

    return stateful_fold(
        with_time(rows), ["device_id", "month"], ["at_us", "event_id"],
        "device_id long, month string, at_us long, event_id long, upload long, download long, used_count long, upload_bytes long, download_bytes long",
        "count long, up long, down long", lambda: [0, 0, 0], step, lambda key, state: end_of_month(key[1]), "__at", delay,
    )


def free_window(requests: DataFrame, key: str, ts: str, tie: str, requested: str | None = None, hours: int = Q.FREE_WINDOW_HOURS, delay: str = DELAY) -> DataFrame:
    """D7. A window is cleared when it has run out: the next request opens a new one anyway."""
    span = hours * 3_600_000_000
    out = stateful_fold(
        with_time(Q.free_window_rows(requests, key, ts, tie, requested)), ["key"], ["at_us", "request_id"], Q.FREE_WINDOW_OUT, "started long, used long",
        lambda: [None, 0], Q.free_window_step(hours=hours), lambda key, state: state[0] + span, "__at", delay,
    )
    return out if requested else out.drop("requested")


def lockout(logins: DataFrame, user: str, ts: str, tie: str, success: str) -> DataFrame:
    """D12. A success clears the state; failures are remembered until then, as the rule wants."""
    return stateful_fold(
        Q.lockout_rows(logins, user, ts, tie, success), ["user_id"], ["at_us", "event_id"], Q.LOCKOUT_OUT, "failed long, until long",
        lambda: [0, None], Q.lockout_step(),
    )


def first_grants(verifications: DataFrame, order_id: str, ts: str, tie: str, keep_days: int | None = None, delay: str = DELAY) -> DataFrame:
    """(order_id, at_us, event_id) of the verification that grants each order: the first to arrive, of one
    micro-batch the earliest. The state keeps one number an order.

    With ``keep_days`` an order is forgotten that long after its grant, and a later verification is granted again.
    """
    rows = verifications.select(F.col(order_id).alias("order_id"), Q.micros(ts).alias("at_us"), F.col(tie).alias("event_id"))

    def step(s: list, row: tuple) -> tuple[bool]:
        first = s[0] is None
        s[0] = row[1] if first else s[0]
        return (first,)

    forget = None if keep_days is None else lambda key, state: state[0] + keep_days * L.DAY_MICROS
    return stateful_fold(
        rows if forget is None else with_time(rows), ["order_id"], ["at_us", "event_id"], "order_id long, at_us long, event_id long, granted boolean",
        "granted_at long", lambda: [None], step, forget, None if forget is None else "__at", delay,
    ).where("granted").drop("granted")


def rate_limit(requests: DataFrame, client: str, ts: str, width: str, maximum: int, delay: str = "10 minutes") -> DataFrame:
    """Tumbling windows that close when the watermark passes them."""
    timed = requests.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)
    return Q.rate_limit(timed, client, ts, width, maximum)


def subscription_effects(events: DataFrame) -> DataFrame:
    """Field changes as they arrive; ``webhook_state`` over the stored changes is the current state."""
    return S.webhook_effects(events)


def stored_updates(stream: DataFrame, name: str, keys: Sequence[str]) -> DataFrame:
    """Run what has arrived in update mode and return the latest row of each key, open windows included.

    Every batch writes its changed rows below its own id, so a repeated batch replaces itself.
    """
    spark = stream.sparkSession
    folder = shared_folder(spark, name)
    rest = [c for c in stream.columns if c not in keys]

    def store(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("__batch", F.lit(batch_id).cast("long")).write.mode("overwrite").parquet(f"{folder}/data/run={batch_id}")

    query = stream.writeStream.outputMode("update").foreachBatch(store).option("checkpointLocation", f"{folder}/state")
    query.trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.schema(stream.select("*", F.lit(0).cast("long").alias("__batch")).schema).parquet(f"{folder}/data")
    latest = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "__batch").alias("__r"))
    return latest.select(*keys, "__r.*").select(*stream.columns)


def stored(stream: DataFrame, name: str) -> DataFrame:
    """Run what has arrived into a table in the shared folder and return that table."""
    spark = stream.sparkSession
    folder = shared_folder(spark, name)
    append_stream(stream, f"{folder}/data", f"{folder}/state").awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/data")


def replayed(rows: DataFrame, ts: str, rule: Callable[[DataFrame], DataFrame], name: str, slices: int = 3) -> DataFrame:
    """Let a table arrive in ``slices`` of time, one after the other, and return what the rule makes of the stream.

    After each slice the query ends; with the next one it starts again from its checkpoint. So every slice is a
    micro-batch of its own, and the rule's state comes back from the state store each time.
    """
    spark = rows.sparkSession
    folder = shared_folder(spark, name)
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    cuts = rows.select(at.alias("t")).approxQuantile("t", [i / slices for i in range(1, slices)], 0.01)
    bounds = [None, *cuts, None]
    for low, high in zip(bounds, bounds[1:], strict=False):
        inside: Column = F.lit(True)
        inside = inside if low is None else inside & (at >= int(low))
        inside = inside if high is None else inside & (at < int(high))
        rows.where(inside).write.mode("append").parquet(f"{folder}/in")
        out = rule(spark.readStream.schema(rows.schema).parquet(f"{folder}/in"))
        append_stream(out, f"{folder}/data", f"{folder}/state").awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{folder}/data")
