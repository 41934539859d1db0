"""Sheets of all types go through one pass; its rules are those of the single operators."""

import random

import pytest

import __spark_entry__ as entry
from quillmeter.operators import cells as K

CELLS = "doc_id long, page long, row long, col long, value string"
VALUES = ["", "  ", None, "a", "Name: Bo", "x:y:z", ": v", "one\ntwo\n", "\n", "A b. C d. E f. G", "...", "a | b|", "p; q ;r", ";", "wide  gap", "• item", "3. third",
          "Payment mode", "by card", "a long line of five words", "another long line of words", "Date", " end ", "9.5", "नाम", "\ta\x0b", "same text", "same text"]


@pytest.fixture(scope="module")
def sheets(spark):
    """Sheets of one to thirty rows with one to four columns, not always from zero on."""
    rng, cells = random.Random(11), []
    for page in range(60):
        for row in range(rng.choice([1, 5, 30])):
            for col in sorted(rng.sample(range(5), rng.randint(1, 4))):
                cells.append((page // 20, page, row * 2, col, rng.choice(VALUES)))
    return spark.createDataFrame(cells, CELLS).repartition(3, "doc_id").cache()


def found(df):
    return sorted((r.doc_id, r.page, r.row, r.label, r.value) for r in df.collect())


@pytest.mark.parametrize("types, one", [
    (["invoice", "bank_statement"], lambda rows: K._as_pairs(K.rows_of(K.drop_repeated_rows(K.cells_of(rows))))),
    (["bill_or_receipt"], K.pair_bill_rows), (["resume"], K.resume_layout), (["certificate", "id_card"], K.certificate_layout),
    (["letter"], K.letter_layout), (["generic_form"], K.pair_form_rows), (["unknown", "x"], lambda rows: K._as_pairs(K.generic_fixes(rows))),
])
def test_each_type_equals_its_operator(spark, sheets, types, one):
    """Types by sheet, next to sheets of other types and of none."""
    pages = [(p // 20, p, types[p % len(types)] if p % 3 else None) for p in range(60)]
    typed = spark.createDataFrame(pages, "doc_id long, page long, doc_type string")
    want = found(one(K.rows_of(sheets.where("page % 3 <> 0"))))
    assert found(K.fixes_by_type(sheets, typed)) == want and len(want) > 50


def test_types_by_document(spark, sheets):
    kinds = spark.createDataFrame([(0, "letter"), (2, "resume"), (7, "letter")], "doc_id long, doc_type string")
    want = found(K.letter_layout(K.rows_of(sheets.where("doc_id = 0")))) + found(K.resume_layout(K.rows_of(sheets.where("doc_id = 2"))))
    assert found(K.fixes_by_type(sheets, kinds)) == sorted(want)


@pytest.mark.parametrize("name", ["k9_pair_bill_rows", "k11_fixes_by_type"])
def test_words_are_made_once(spark, name):
    """The sheets come from the words once, and one page rule reads them."""
    plan = entry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and plan.count("posexplode") == 2 and "InPandas" not in plan and "Join" not in plan
