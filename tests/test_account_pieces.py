"""Chunks of a ledger that find out what leaves them for every balance that may enter."""

import random

from quillmeter.operators import ledger as L
from quillmeter.operators import paths


def events(rng, n, top=30):
    at, rows = 0, []
    for i in range(n):
        at += rng.randint(1, 12)
        rows.append((1, i, at, "purchase" if rng.random() < 0.35 else "deduct", rng.randint(1, top)))
    return rows


def left_by(rows, state, keep):
    account, step = list(state), L.account_step(keep)
    for row in rows:
        step(account, row)
    return tuple(account)


def test_pieces_are_the_whole_map():
    rng = random.Random(11)
    for _ in range(60):
        keep, rows = rng.choice([8, 40, 5000]), events(rng, 25)
        entering = (rng.randint(0, 40), rng.choice([None, rng.randint(5, 300)]), rng.random() < 0.5)
        pieces = L.account_pieces(keep)(rows, entering, 120)
        for balance in range(121):
            state = (balance, *entering[1:])
            fits = [p for p in pieces if L.piece_holds(p, state)]
            assert len(fits) == 1 and L.leaving(fits[0], state) == left_by(rows, state, keep)
        for piece in pieces:  # other deadlines that a piece claims to hold for
            for deadline in range(0, 400, 7):
                state = (min(max(piece[0], 0) + 1, 120), deadline, entering[2])
                if L.piece_holds(piece, state):
                    assert L.leaving(piece, state)[0] == left_by(rows, state, keep)[0]


def test_few_pieces_stay_next_to_the_entering_balance(monkeypatch):
    monkeypatch.setattr(L, "MOST_PIECES", 8)
    rng = random.Random(3)
    for _ in range(40):
        rows, entering = events(rng, 60), (rng.randint(0, 200), 10_000, True)
        pieces = L.account_pieces(9000)(rows, entering, 500)
        assert len(pieces) <= 8 * 2
        fits = [p for p in pieces if L.piece_holds(p, entering)]
        assert len(fits) == 1 and L.leaving(fits[0], entering) == left_by(rows, entering, 9000)


def test_short_credits_take_few_rounds(spark, monkeypatch):
    """Sixty chunks whose decisions all depend on the exact balance: not a round for each."""
    rng = random.Random(7)
    rows = events(rng, 1200)
    names = []
    monkeypatch.setattr(paths, "written", lambda df, name, old=paths.written: names.append(name) or old(df, name))
    frame = spark.createDataFrame([(u, i, at, k, a) for u, i, at, k, a in rows], L.ACCOUNT_ROWS.replace("at_us long", "at long")).selectExpr(
        "user_id", "event_id", "timestamp_micros(at) AS ts", "type", "amount")
    got = L.conditional_balance(frame, "user_id", "ts", "event_id", "type", "amount", 1, chunk_rows=20).orderBy("event_id").collect()
    account, step = L.account_start(), L.account_step(L.DAY_MICROS)
    assert [(r["accepted"], r["balance"], r["expired_credits"]) for r in got] == [step(account, row) for row in rows]
    assert names.count("chunk-entries") <= 4
