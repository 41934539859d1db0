"""Ordered rules against plain loops, with one key that holds much of the data."""

import random
from datetime import datetime, timedelta

import pytest

from quillmeter.operators import ledger as L
from quillmeter.operators import quota as Q
from quillmeter.operators.scans import running_total, time_chunk
from quillmeter.streaming import streams as X
from pyspark.sql import functions as F

START = datetime(2024, 1, 1)


def requests(sizes):
    rng = random.Random(5)
    rows, t = [], START
    for i, size in enumerate(sizes):
        t += timedelta(seconds=rng.randint(0, 4000))
        rows.append((i, 1 if i % 3 else rng.randint(2, 9), t, size))
    return rows


CASES = {
    "random": [random.Random(1).randint(0, 1_200_000) for _ in range(600)],
    "shrinking": [1_000_000 - 1500 * i for i in range(600)],
    "tiny": [random.Random(2).choice([0, 1, 2, 3]) for _ in range(300)],
    "equal": [900_000] * 200,
}


@pytest.mark.parametrize("case", CASES)
def test_admission_equals_loop(spark, case):
    rows = requests(CASES[case])
    used, want = {}, {}
    for i, device, t, size in rows:
        s = used.setdefault((device, t.strftime("%Y-%m")), [0, 0])
        ok = size <= Q.MB and s[0] + 1 <= 40 and s[1] + size <= 10 * Q.MB
        if ok:
            s[0] += 1
            s[1] += size
        want[i] = ok
    df = spark.createDataFrame(rows, "id long, device long, ts timestamp_ntz, size long")
    got = {r.request_id: r.accepted for r in Q.admission(df, "device", "ts", "id", "size", chunk_seconds=3600).collect()}
    assert got == want


def test_running_total_equals_loop_for_a_hot_key(spark):
    rng = random.Random(3)
    rows = [(i, 1 if i % 3 else i, START + timedelta(seconds=rng.randint(0, 500_000)), rng.randint(-9, 9)) for i in range(2000)]
    want, sums = {}, {}
    for i, k, t, v in sorted(rows, key=lambda r: (r[2], r[0])):
        sums[k] = sums.get(k, 0) + v
        want[i] = sums[k]
    df = spark.createDataFrame(rows, "id long, k long, ts timestamp_ntz, v long")
    out = running_total(df, ["k"], ["ts", "id"], {"total": F.col("v")}, time_chunk("ts", 7200))
    assert {r.id: r.total for r in out.collect()} == want


def ledger_rows():
    rng = random.Random(7)
    rows, t = [], START
    for i in range(900):
        t += timedelta(hours=rng.choice([1, 5, 30, 80]))
        rows.append((i, rng.choice([1, 1, 2]), t, rng.choice(["purchase", "deduct", "deduct"]), rng.randint(1, 50)))
    return rows


def loop_balance(rows, keep):
    state, out = {}, {}
    for i, user, t, kind, amount in rows:
        s = state.setdefault(user, {"c": 0, "e": None, "u": None})
        if s["e"] and s["c"] > 0 and (s["u"] + keep if s["u"] else s["e"]) < t:
            s["c"] = 0
        if kind == "purchase":
            s["c"] += amount
            if s["e"] is None or s["e"] < t:
                s["e"] = t + keep
            out[i] = (True, s["c"])
        elif s["c"] < amount:
            out[i] = (False, s["c"])
        else:
            s["c"] -= amount
            s["u"], s["e"] = t, t + keep
            out[i] = (True, s["c"])
    return out


def test_conditional_balance_batch_and_stream(spark, tmp_path):
    rows = ledger_rows()
    want = loop_balance(rows, timedelta(days=2))
    schema = "id long, user long, ts timestamp_ntz, kind string, amount long"
    df = spark.createDataFrame(rows, schema)
    got = {r.event_id: (r.accepted, r.balance) for r in L.conditional_balance(df, "user", "ts", "id", "kind", "amount", 2).collect()}
    assert got == want
    for n in range(3):  # three files, one micro-batch each
        spark.createDataFrame(rows[n * 300:(n + 1) * 300], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    streamed = X.stored(X.conditional_balance(stream, "user", "ts", "id", "kind", "amount", 2), "test")
    assert {r.event_id: (r.accepted, r.balance) for r in streamed.collect()} == want


def test_free_window_restarts_after_its_own_start(spark):
    hours = [0, 1, 2, 3, 4, 5, 23.99, 24, 25, 47, 48.5]
    rows = [(i, "k", START + timedelta(hours=h)) for i, h in enumerate(hours)]
    df = spark.createDataFrame(rows, "id long, key string, ts timestamp_ntz")
    out = sorted(Q.free_window(df, "key", "ts", "id").collect(), key=lambda r: r.request_id)
    assert [r.allowed for r in out] == [True] * 5 + [False, False] + [True] * 4
    assert [r.remaining for r in out][7:] == [4, 3, 2, 4]


def test_lockout(spark):
    minutes = [0, 1, 2, 3, 4, 5, 33, 35, 36, 70]
    ok = [False] * 5 + [True, True, False, True, True]
    df = spark.createDataFrame([(i, 1, START + timedelta(minutes=m), s) for i, (m, s) in enumerate(zip(minutes, ok))], "id long, u long, ts timestamp_ntz, ok boolean")
    out = sorted(Q.lockout(df, "u", "ts", "id", "ok").collect(), key=lambda r: r.event_id)
    assert [r.outcome for r in out] == ["failed"] * 5 + ["locked", "locked", "failed", "locked", "ok"]
