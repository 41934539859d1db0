"""State of the streamed rules: what is kept, what is cleared, restarts; and owners of addresses in time."""

from datetime import datetime, timedelta


from quillmeter.operators import subscriptions as S
from quillmeter.sources import sinks as K
from quillmeter.sources.sinks import append_stream
from quillmeter.streaming import streams as X

START = datetime(2024, 1, 30)


def fed(spark, folder, slices, schema, rule):
    """Run the rule after each slice, from its checkpoint; returns what it wrote."""
    for rows in slices:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        out = rule(spark.readStream.schema(schema).parquet(f"{folder}/in"))
        append_stream(out, f"{folder}/out", f"{folder}/state").awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{folder}/out")


def keys_in_state(spark, folder):
    state = spark.read.format("statestore").option("stateVarName", "state").load(f"{folder}/state")
    return sorted(tuple(r.key) for r in state.select("key").collect())


def test_counters_of_a_closed_month_leave_the_state(spark, tmp_path):
    schema = "id long, device long, ts timestamp_ntz, size long"
    slices = [
        [(i, i % 2, START + timedelta(hours=i), 500_000) for i in range(30)],
        [(100 + i, 0, START + timedelta(days=3, hours=i), 900_000) for i in range(30)],
        [(200, 0, START + timedelta(days=6), 1_000_000)],
    ]
    out = fed(spark, tmp_path, slices, schema, lambda s: X.admission(s, "device", "ts", "id", "size"))
    used, want = {}, {}
    for i, device, t, size in sum(slices, []):
        s = used.setdefault((device, t.month), 0)
        want[i] = s + size <= 10 * 1024 * 1024
        used[device, t.month] = s + size * want[i]
    assert {r.request_id: r.accepted for r in out.collect()} == want
    assert keys_in_state(spark, tmp_path) == [(0, "2024-02")]


def test_windows_that_ran_out_and_successful_users_leave_the_state(spark, tmp_path):
    schema = "id long, key string, ts timestamp_ntz, good boolean"
    hours = [0, 1, 2, 23, 25, 26, 60, 61]
    rows = [(i, "ab"[i % 2], START + timedelta(hours=h), i % 4 == 3) for i, h in enumerate(hours)]
    slices = [rows[:4], rows[4:6], rows[6:]]
    out = fed(spark, tmp_path / "window", slices, schema, lambda s: X.free_window(s, "key", "ts", "id"))
    assert {r.request_id: r.remaining for r in out.collect()} == {0: 4, 1: 4, 2: 3, 3: 3, 4: 4, 5: 4, 6: 4, 7: 4}
    assert keys_in_state(spark, tmp_path / "window") == [("a",), ("b",)]
    late = [(50, "c", START + timedelta(days=9), False)]
    fed(spark, tmp_path / "window", [late], schema, lambda s: X.free_window(s, "key", "ts", "id"))
    assert keys_in_state(spark, tmp_path / "window") == [("c",)]

    users = [[(i, 1 + i % 2, t, good) for i, _, t, good in part] for part in slices]
    fed(spark, tmp_path / "lock", users, "id long, user long, ts timestamp_ntz, good boolean", lambda s: X.lockout(s, "user", "ts", "id", "good"))
    assert keys_in_state(spark, tmp_path / "lock") == [(1,)]  # user 2 ends with a success


def test_an_order_is_granted_once_and_forgotten_after_its_time(spark, tmp_path):
    schema = "order_id long, ts timestamp_ntz, event long"
    slices = [[(1, START, 7), (1, START, 5), (2, START, 9)], [(1, START + timedelta(hours=1), 1)], [(3, START + timedelta(days=5), 2)], [(1, START + timedelta(days=6), 3)]]
    once = fed(spark, tmp_path / "once", slices, schema, lambda s: X.first_grants(s, "order_id", "ts", "event"))
    assert sorted((r.order_id, r.event_id) for r in once.collect()) == [(1, 5), (2, 9), (3, 2)]
    again = fed(spark, tmp_path / "again", slices, schema, lambda s: X.first_grants(s, "order_id", "ts", "event", keep_days=2))
    assert sorted((r.order_id, r.event_id) for r in again.collect()) == [(1, 3), (1, 5), (2, 9), (3, 2)]
    assert (2,) not in keys_in_state(spark, tmp_path / "again")


def test_the_owner_of_an_address_depends_on_the_time(spark):
    day = lambda n: START + timedelta(days=n)
    addresses = spark.createDataFrame(
        [(1, "Old@x", day(0), 1), (1, "new@x", day(5), 2), (2, "old@x", day(8), 3), (3, "new@x", day(9), 4), (4, "same@x", day(1), 5), (5, "same@x", day(1), 6)],
        "user_id long, email string, since timestamp_ntz, change_id long",
    )
    events = spark.createDataFrame(
        [(1, day(4), None, "old@X"), (2, day(6), None, "old@x"), (3, day(6), None, "new@x"), (4, day(9), None, "old@x"), (5, day(9), None, "new@x"), (6, day(2), None, "same@x"), (7, day(2), 77, None), (8, day(2), None, None), (9, day(-1), None, "old@x")],
        "event_id long, ts timestamp_ntz, user_id long, email string",
    )
    got = {r.event_id: r.user_id for r in S.with_owners(events, addresses).collect()}
    assert got == {1: 1, 2: None, 3: 1, 4: 2, 5: 3, 6: 5, 7: 77, 8: None, 9: None}
    assert S.with_owners(events, addresses).columns == events.columns


def test_an_additive_table_lives_on(spark, tmp_path):
    path, keys, amounts = str(tmp_path / "table"), ["k"], ["n", "bytes"]
    batch = lambda *rows: spark.createDataFrame(list(rows), "k string, n long, bytes long")
    table = lambda: {r.k: (r.n, r.bytes) for r in K.read_additive_table(spark, path, keys, amounts).collect()}
    store = lambda n, *rows: K.store_increments(batch(*rows), n, path, keys, amounts)
    store(0, ("a", 1, 10), ("a", 2, 20), ("b", 5, 1))
    store(1, ("a", 1, 1))
    store(1, ("a", 1, 1))  # comes again
    assert table() == {"a": (4, 31), "b": (5, 1)}
    K.compact_additive_table(spark, path, keys, amounts)
    store(0, ("a", 1, 10), ("a", 2, 20), ("b", 5, 1))  # comes again after compaction
    store(2, ("c", 7, 7))
    assert table() == {"a": (4, 31), "b": (5, 1), "c": (7, 7)}
    assert K._numbers(spark, f"{path}/log", "batch") == [2] and K._numbers(spark, f"{path}/snapshots", "upto") == [1]
    # a crash while the next snapshot is written: no marker, so it does not count
    batch(("a", 999, 999)).write.parquet(f"{path}/snapshots/upto=2")
    K._drop(spark, f"{path}/snapshots/upto=2/_SUCCESS")
    assert table() == {"a": (4, 31), "b": (5, 1), "c": (7, 7)}
    K.compact_additive_table(spark, path, keys, amounts)
    # a crash before the old folders are dropped: the log is there again, behind the snapshot
    batch(("c", 7, 7)).write.parquet(f"{path}/log/batch=2")
    assert table() == {"a": (4, 31), "b": (5, 1), "c": (7, 7)}
    K.compact_additive_table(spark, path, keys, amounts)
    assert K._numbers(spark, f"{path}/log", "batch") == []


def test_a_stream_compacts_its_table(spark, tmp_path):
    schema, path = "k long, n long", str(tmp_path / "table")
    for i in range(4):
        spark.createDataFrame([(i % 2, i), (7, 1)], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        rows = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        K.additive_table_stream(rows, path, f"{tmp_path}/state", ["k"], ["n"], compact_every=2).awaitTermination()
    assert {r.k: r.n for r in K.read_additive_table(spark, path, ["k"], ["n"]).collect()} == {0: 2, 1: 4, 7: 4}
    assert K._numbers(spark, f"{path}/log", "batch") == [] and K._numbers(spark, f"{path}/snapshots", "upto") == [3]
