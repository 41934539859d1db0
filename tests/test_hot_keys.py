"""Ordered rules on keys that hold most rows, cut into chunks, against plain loops."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F
from test_stateful import loop_balance

from quillmeter.operators import ledger as L
from quillmeter.operators import paths
from quillmeter.operators import quota as Q

START = datetime(2024, 1, 1)


def times(rng, n, seconds):
    t, out = START, []
    for _ in range(n):
        t += timedelta(seconds=rng.choice(seconds))
        out.append(t)
    return out


@pytest.mark.parametrize("requested", [None, "amount"])
def test_free_window_of_a_hot_key(spark, requested):
    rng = random.Random(4)
    rows = [(i, rng.choice(["hot"] * 9 + ["b", None]), t, rng.choice([0, 1, 1, 2, 3, 5, 6, None])) for i, t in enumerate(times(rng, 900, [0, 60, 1800, 7200, 90_000]))]
    want, state = {}, {}
    for i, key, t, amount in rows:
        s = state.setdefault(key, [None, 0])
        if s[0] is None or t - s[0] >= timedelta(hours=24):
            s[0], s[1] = t, 0
        a = (1 if amount is None else amount) if requested else 1
        ok = s[1] + a <= 5
        s[1] += a * ok
        want[i] = (ok, 5 - s[1])
    df = spark.createDataFrame(rows, "id long, key string, ts timestamp_ntz, amount long")
    for chunk_rows in (37, 10_000):
        out = Q.free_window(df, "key", "ts", "id", requested=requested, chunk_rows=chunk_rows).collect()
        assert {r.request_id: (r.allowed, r.remaining) for r in out} == want and len(out) == len(rows)


@pytest.mark.parametrize("share", [0.02, 0.3])
def test_lockout_of_a_hot_user(spark, share):
    rng = random.Random(int(share * 100))
    rows = [(i, rng.choice([1] * 9 + [2]), t, rng.random() < share) for i, t in enumerate(times(rng, 900, [0, 5, 120, 900, 2000]))]
    want, state = {}, {}
    for i, user, t, good in rows:
        s = state.setdefault(user, [0, None])
        if s[1] is not None and s[1] > t:
            want[i] = ("locked", s[0])
        elif good:
            s[0], s[1] = 0, None
            want[i] = ("ok", 0)
        else:
            s[0] += 1
            s[1] = t + timedelta(minutes=30) if s[0] >= 5 else s[1]
            want[i] = ("failed", s[0])
    df = spark.createDataFrame(rows, "id long, u long, ts timestamp_ntz, ok boolean")
    for chunk_rows in (41, 10_000):
        out = Q.lockout(df, "u", "ts", "id", "ok", chunk_rows=chunk_rows).collect()
        assert {r.event_id: (r.outcome, r.failed_attempts) for r in out} == want and len(out) == len(rows)


@pytest.mark.parametrize("case", ["short of credits", "plenty", "expiring"])
def test_balance_of_a_hot_user(spark, case):
    rng = random.Random(len(case))
    hours, kinds, days = {"short of credits": ([1, 5], ["purchase", "deduct", "deduct", "deduct"], 30), "plenty": ([1], ["purchase", "deduct"], 30), "expiring": ([1, 5, 30, 80], ["purchase", "deduct"], 2)}[case]
    rows = [(i, rng.choice([1] * 9 + [2]), t, rng.choice(kinds), rng.randint(1, 90)) for i, t in enumerate(times(rng, 900, [h * 3600 for h in hours]))]
    df = spark.createDataFrame(rows, "id long, user long, ts timestamp_ntz, kind string, amount long")
    want = loop_balance(rows, timedelta(days=days))
    for chunk_rows in (100, 10_000):
        out = L.conditional_balance(df, "user", "ts", "id", "kind", "amount", days, chunk_rows).collect()
        assert {r.event_id: (r.accepted, r.balance) for r in out} == want and len(out) == len(rows)


def test_a_piece_holds_for_its_whole_range():
    rng = random.Random(9)
    keep = 50
    for _ in range(300):
        rows, t = [], 100
        for i in range(rng.randint(1, 12)):
            t += rng.randint(0, 40)
            rows.append((1, i, t, rng.choice(["purchase", "deduct"]), rng.randint(1, 9)))
        piece = L.account_piece(keep)(rows, (rng.randint(0, 30), rng.choice([None, rng.randint(60, 300)]), rng.random() < 0.5))
        for _ in range(30):
            state = (rng.randint(0, 40), rng.choice([None, rng.randint(60, 300)]), rng.random() < 0.5)
            if state[1] is None and state[2] or not L.piece_holds(piece, state):
                continue
            s = list(state)
            for row in rows:
                L.account_step(keep)(s, row)
            assert tuple(s) == L.leaving(piece, state)


def test_no_task_reads_more_than_a_chunk(spark):
    steps = spark.range(1000).select((F.col("id") * 0).alias("k"), F.col("id").alias("i"), F.array(F.col("id") + 1 + F.col("id") % 7).alias("jumps"))
    seen = {r.i for r in paths.path_nodes(steps, ["k"], 1, 50).collect()}
    at, want = 0, set()
    while at < 1000:
        want.add(at)
        at += 1 + at % 7
    assert seen == want
    plan = paths.path_nodes(steps, ["k"], 1, 50)._jdf.queryExecution().executedPlan().toString()
    assert "__chunk" in plan and "Window" not in plan


@pytest.mark.parametrize("case", ["random", "shrinking", "none"])
def test_admission_of_several_units(spark, case):
    rng = random.Random(len(case))
    size = {"random": lambda i: rng.randint(0, 1_200_000), "shrinking": lambda i: 1_000_000 - 1500 * i, "none": lambda i: rng.choice([0, 3, 900_000])}[case]
    amounts = [0, 0, 1, 40] if case == "none" else [1, 1, 2, 3, 7, 40, 41, None]
    rows = [(i, 1 if i % 3 else rng.randint(2, 9), t, size(i), rng.choice(amounts)) for i, t in enumerate(times(rng, 600, [0, 900, 4000]))]
    used, want = {}, {}
    for i, device, t, bytes_, amount in rows:
        s = used.setdefault((device, t.strftime("%Y-%m")), [0, 0])
        a = 1 if amount is None else amount
        ok = bytes_ <= Q.MB and s[0] + a <= 40 and s[1] + bytes_ <= 10 * Q.MB
        if ok:
            s[0] += a
            s[1] += bytes_
        want[i] = ok
    df = spark.createDataFrame(rows, "id long, device long, ts timestamp_ntz, size long, amount long")
    got = {r.request_id: r.accepted for r in Q.admission(df, "device", "ts", "id", "size", chunk_seconds=3600, amount="amount").collect()}
    assert got == want
