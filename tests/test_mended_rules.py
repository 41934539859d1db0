"""Cases that an earlier review found wrong, each on a small hand-made table."""

import random

from pyspark.sql import functions as F

from quillmeter.operators import cells as K
from quillmeter.operators import layout as J
from quillmeter.operators import ledger as L
from quillmeter.operators import pagefolds as P
from quillmeter.operators import pagesets as M
from quillmeter.operators import search as R
from quillmeter.operators import siteaudit as G
from quillmeter.operators import subscriptions as S
from quillmeter.operators.scans import running_total, time_chunk


def plain_score(q, t, d, keywords):
    q, t, d, kw = q.strip(" ").lower(), t.lower(), d.lower(), [k.lower() for k in keywords]
    words = [w for w in q.split(" ") if len(w) > 2]
    return (
        100 * (t == q) + 50 * (q in t) + 15 * sum(w in t for w in words)
        + sum(30 if k == q else 20 if k in q else 15 if q in k else 0 for k in kw)
        + 10 * sum(k.find(w) >= 0 or w.find(k) >= 0 for w in words for k in kw) + 5 * sum(w in d for w in words)
    )


def test_search_takes_a_table_of_queries(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcde") for _ in range(rng.randint(1, 6)))
    items = [(i, " ".join(word() for _ in range(3)), word(), " ".join(word() for _ in range(4)), [word() for _ in range(3)]) for i in range(25)]
    queries = sorted({" ".join(word() for _ in range(rng.randint(1, 4))) for _ in range(6400)})
    assert len(queries) > 5000
    table = spark.createDataFrame(items, "page_id long, title string, category string, description string, keywords array<string>")
    got = {}
    for r in R.smart_search(table, spark.createDataFrame([(q,) for q in queries], "query string"), "page_id", 8).collect():
        got.setdefault(r["query"], []).append((r["rank"], r["page_id"], r["score"]))
    want = {}
    for q in queries:
        scored = sorted((-plain_score(q, t, d, kw), i) for i, t, _, d, kw in items)
        best = [(rank + 1, i, -s) for rank, (s, i) in enumerate(scored[:8]) if s < 0]
        if best:
            want[q] = best
    assert {q: sorted(rows) for q, rows in got.items()} == want
    assert R.tiered_search(table, queries[:50], "page_id", 3).count() > 0


def test_keyword_limit_is_optional(spark):
    row = spark.createDataFrame([("a-b.html", " ".join(f"word{i}" for i in range(30)))], "f string, t string")
    assert row.select(F.size(G.index_keywords("f", "t"))).first()[0] == 31
    assert row.select(F.size(G.index_keywords("f", "t", 15))).first()[0] == 15


def test_spans_have_no_silent_limit(spark):
    words = [(1, 0, 0, k, 0.0 if k == 0 else 20.0 * k, 400.0 if k == 0 else 20.0 * k + 1, 0.0, 1.0) for k in range(30)]
    rows = spark.createDataFrame(words, "doc_id long, page long, row long, word_id long, x0 double, x1 double, y0 double, y1 double")
    wide = lambda df: df.agg(F.max("colspan")).first()[0]
    assert wide(J.spans(rows)) > 10 and wide(J.spans(rows, most_columns=10)) == 10


def test_payments_without_user_or_of_paid_orders(spark):
    payments = spark.createDataFrame([(1, 10, 5, 1), (2, 10, None, 2), (3, 11, 6, 3), (4, 11, 6, 4)], "payment_id long, order_id long, user_id long, ts long")
    orders = spark.createDataFrame([(10, 5, 3, None), (11, 6, 3, 4)], "order_id long, owner_id long, credits long, paid_by long")
    status = {r.payment_id: r.status for r in L.reconcile_payments(payments, orders, stored="paid_by").collect()}
    assert status[1] == "ok" and status[2] == "wrong_owner" and status[3] == "already_processed"


def test_expiry_keeps_earlier_plans(spark):
    subs = spark.createDataFrame(
        [(1, "premium", "active", 1, "business"), (2, "premium", "active", 9, "business")], "user_id long, plan string, status string, expires_at long, previous_plan string"
    )
    out = {r.user_id: (r.plan, r.previous_plan, r.expired_at) for r in S.expire_subscriptions(subs, F.lit(5)).collect()}
    assert out == {1: ("free", "premium", 5), 2: ("premium", "business", None)}


def test_running_total_keeps_rows_without_key_or_time(spark):
    rows = spark.createDataFrame([(1, "2024-01-01 00:00:00", 5), (1, None, 2), (None, "2024-01-02 00:00:00", 7)], "k long, ts string, v long")
    rows = rows.withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    out = running_total(rows, ["k"], ["ts"], {"s": F.col("v")}, time_chunk("ts", 86400)).collect()
    assert sorted(r.s for r in out) == [2, 7, 7]


def test_empty_words_join_no_cell(spark):
    box = lambda i, text, y: (1, 0, i, text, 0.0, y, 0.5, y + 0.01, 10.0)
    words = spark.createDataFrame([box(0, "", 0.0), box(1, None, 0.011), box(2, "abc", 0.022), box(3, "abd", 0.033)], P.BOX)
    cells = {r.word_id: r.cell for r in P.logical_cells(words).collect()}
    assert cells[2] == cells[3] and len(set(cells.values())) == 3


def test_merge_sums_long_targets_in_stretches(spark):
    pages = spark.createDataFrame([(d, p) for d in range(30) for p in range(1, 3)], "doc_id long, page_no long")
    members = spark.createDataFrame([("t", d, 1000 * d - 9000) for d in range(30)], "target string, doc_id long, seq long")
    got = sorted((r.new_page, r.doc_id, r.page_no) for r in M.merge_documents(pages, members).collect())
    assert got == [(2 * d + p, d, p) for d in range(30) for p in range(1, 3)]


def sheet(spark, rows):
    cells = [(1, 0, r, c, v) for r, row in enumerate(rows) for c, v in enumerate(row)]
    return K.rows_of(spark.createDataFrame(cells, "doc_id long, page long, row long, col long, value string"))


def test_bill_labels_and_middle_cells(spark):
    rows = sheet(spark, [["Payment mode", ""], ["by card", ""], ["website url", ""], ["example.org", ""], ["a", "middle", "z"]])
    got = [(r.label, r.value) for r in K.pair_bill_rows(rows).orderBy("row").collect()]
    assert got == [("Payment mode", "by card"), ("website url", "example.org"), ("a", "middle z")]


def test_labels_do_not_take_labels(spark):
    rows = sheet(spark, [["Biller Name"], ["Payment Status"], ["ACME"], ["address"], ["HIGH STREET 5"], ["नाम"], ["RAM"]])
    got = {}
    for r in K.pair_label_rows(rows).collect():
        got.setdefault(r.row, {})[r.col] = r.value
    assert [got[k] for k in sorted(got)] == [{0: "Biller Name"}, {0: "Payment Status", 1: "ACME"}, {0: "address", 1: "HIGH STREET 5"}, {0: "नाम", 1: "RAM"}]
