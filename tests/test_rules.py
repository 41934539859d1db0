"""Hand-made inputs for rules whose words or shapes the given tables lack."""

from pyspark.sql import functions as F

from quillmeter.operators import cells as K
from quillmeter.operators import layout as J
from quillmeter.operators import pagefolds as P
from quillmeter.operators import pricing as B
from quillmeter.operators import profile as I
from quillmeter.sources import readers as R
from quillmeter.sources import sinks as S

WORD = "doc_id long, page long, word_id long, text string, x0 double, y0 double, x1 double, y1 double, font_size double, bold boolean, confidence double"


def words(spark, rows):
    return spark.createDataFrame([(1, 1, i, t, float(x), float(y), float(x + w), float(y + 10), float(f), False, 0.9) for i, (t, x, y, w, f) in enumerate(rows)], WORD)


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return row.select(column.alias("x")).first().x


def test_drifting_rows_follow_the_running_mean(spark):
    rows = [("a", 0, 0, 5, 10), ("b", 9, 4, 5, 10), ("c", 18, 8, 5, 10), ("d", 27, 9, 5, 10), ("e", 0, 30, 5, 10)]
    got = {r.text: r.row for r in P.rows_by_font(words(spark, rows)).collect()}
    # centres 5, 9, 13, 14: means 5 -> 7 -> (13 is 6 away: new row) 13 -> 13.5
    assert got == {"a": 0, "b": 0, "c": 1, "d": 1, "e": 2}


def test_rows_by_overlap(spark):
    rows = [("a", 0, 0, 5, 10), ("b", 9, 1, 5, 10), ("c", 0, 20, 5, 10), ("d", 9, 4, 5, 10)]
    got = {r.text: r.row for r in P.rows_by_overlap(words(spark, rows)).collect()}
    assert got == {"a": 0, "b": 0, "c": 1, "d": 2}


def test_logical_cells_partition_the_words(spark):
    rows = [("name", 0, 0, 40, 10), ("of", 2, 12, 36, 10), ("12", 100, 0, 12, 10), ("34", 100, 12, 12, 10), ("far", 0, 60, 40, 10)]
    got = {r.text: r.cell for r in P.logical_cells(words(spark, rows)).collect()}
    assert got["name"] == got["of"] and got["12"] == got["34"] and len(set(got.values())) == 3 and len(got) == 5


def test_numeric_pieces_join(spark):
    rows = [("1234 5678", 0, 0, 50, 10), ("9012 34", 52, 0, 30, 10), ("x", 400, 0, 10, 10)]
    got = [r.text for r in P.merge_numeric_pieces(words(spark, rows), gap=5.0).orderBy("x0").collect()]
    assert got == ["1234 5678", "9012 34", "x"]  # nine and six digits: no long number yet
    rows[0] = ("1234 5678 90", 0, 0, 50, 10)
    got = [r.text for r in P.merge_numeric_pieces(words(spark, rows), gap=5.0).orderBy("x0").collect()]
    assert got == ["1234 5678 90 9012 34", "x"]


def test_boxes_are_inferred_from_neighbours(spark):
    cells = spark.createDataFrame(
        [(1, 1, 0, 0, 0.0, 0.0, 10.0, 5.0), (1, 1, 0, 1, None, None, None, None), (1, 1, 1, 0, None, None, None, None), (1, 1, 1, 1, None, None, None, None)],
        "doc_id long, page long, row long, col long, x0 double, y0 double, x1 double, y1 double")
    got = {(r.row, r.col): (r.x0, r.y0, r.x1, r.y1) for r in P.fill_boxes(cells).collect()}
    assert got == {(0, 0): (0, 0, 10, 5), (0, 1): (10, 0, 20, 5), (1, 0): (0, 5, 10, 10), (1, 1): (10, 5, 20, 10)}


def test_ruled_lines_break_and_attract_columns(spark):
    rows = words(spark, [("a", 0, 0, 5, 10), ("b", 14, 0, 5, 10), ("c", 0, 12, 5, 10), ("d", 14, 12, 5, 10)]).withColumn("row", (F.col("y0") / 12).cast("long"))
    plain = [r.x for r in J.weighted_columns(rows).orderBy("x").collect()]
    hints = spark.createDataFrame([(1, 1, 15.0), (1, 1, 300.0)], "doc_id long, page long, x double")
    ruled = [r.x for r in J.weighted_columns(rows, hints).orderBy("x").collect()]
    assert plain == [7.0] and ruled == [0.0, 15.0, 300.0]


def test_nearest_column_takes_the_left_one_on_ties(spark):
    cols = spark.createDataFrame([(1, 1, 0, 10.0), (1, 1, 1, 20.0), (1, 1, 2, 40.0)], "doc_id long, page long, col long, x double")
    rows = words(spark, [("a", 0, 0, 5, 10), ("b", 15, 0, 0, 10), ("c", 16, 0, 0, 10), ("d", 99, 0, 1, 10), ("e", 20, 0, 0, 10)])
    got = {r.text: r.col for r in J.assign_nearest(rows, cols).collect()}
    assert got == {"a": 0, "b": 0, "c": 1, "d": 2, "e": 1}


def sheet(spark, grid):
    return spark.createDataFrame([(1, 1, r, c, v) for r, row in enumerate(grid) for c, v in enumerate(row)], "doc_id long, page long, row long, col long, value string")


def pairs(df):
    return [(r.label, r.value) for r in df.orderBy("row").collect()]


def test_collapsed_and_delimited_rows(spark):
    rows = K.rows_of(sheet(spark, [["one\ntwo", "x"], ["a | b", ""], ["Name: Bo", ""], ["A b. C d. E f. G", ""]]))
    lines = [(r.row, r.value) for r in K.cells_of(K.split_collapsed_rows(rows)).where("col = 0").orderBy("row").collect()]
    assert [v for _, v in lines] == ["one", "two", "a | b", "Name: Bo", "A b.", "C d.", "E f.", "G."]
    parts = [r.value for r in K.cells_of(K.split_delimited_rows(rows)).where("col = 0").orderBy("row").collect()]
    assert parts[1:3] == ["a", "b"]
    split = K.cells_of(K.split_label_value(rows)).where("row = 2").orderBy("col").collect()
    assert [c.value for c in split] == ["Name", "Bo"]


def test_bill_and_form_pairs(spark):
    bill = K.rows_of(sheet(spark, [["Name: Bo", ""], ["Biller id", ""], ["AB-77", ""], ["plain", "text"], ["", ""]]))
    assert pairs(K.pair_bill_rows(bill)) == [("Name", "Bo"), ("Biller id", "AB-77"), ("plain", "text")]
    form = K.rows_of(sheet(spark, [["Date"], ["the first long line of words"], ["a second long line of words"], ["a third long line of words"]]))
    assert pairs(K.pair_form_rows(form)) == [
        ("Date", "the first long line of words"), ("a second long line of words", "a third long line of words")]


def test_value_splitting_keeps_everything(spark):
    text = "12-05-2024 10:30 payment received 1234567 42.50 'quoted note'"
    assert one(spark, K.split_value("t"), t=text) == ["12-05-2024 10:30 payment received 1234567 42.50", "'quoted note'"]
    bare = text.replace(" 'quoted note'", "")
    assert one(spark, K.split_value("t"), t=bare) == ["12-05-2024", "10:30", "payment received", "1234567", "42.50"]
    assert one(spark, K.split_value("t", 3), t=bare) == ["12-05-2024", "10:30", "payment received 1234567 42.50"]
    assert one(spark, K.split_value("t"), t="short") == ["short"]


def test_key_value_split(spark):
    assert one(spark, K.key_value_split("t"), t="Total - 12") == ("Total", "12")
    assert one(spark, K.key_value_split("t"), t="Biller Name Acme Power") == ("Biller Name", "Acme Power")
    assert one(spark, K.key_value_split("t"), t="nothing here") == ("nothing here", "")


def test_default_lexicons(spark):
    def kind(text, tables=False, **kw):
        return one(spark, I.document_type("t", F.lit(tables), **kw), t=text)

    assert kind("Invoice 7: total and tax") == "invoice"
    assert kind("balance of the account") == "bank_statement"
    assert kind("xyz") == "unknown" and kind("q" * 101) == "digital_pdf"
    assert kind("tomorrow") == "letter" and kind("tomorrow", whole_word=True) == "unknown"
    assert one(spark, I.type_by_hits("t"), t="bank statement with opening balance") == "bank_statement"
    assert one(spark, I.language_signal("t"), t="आवेदन फॉर्म") == "hindi"
    assert one(spark, I.normalise_text("t"), t="é‍") == "é"


def test_locale_order(spark):
    assert one(spark, B.currency_from_language("t"), t="en-AU") == "USD"
    assert one(spark, B.currency_from_language("t", strict_locale=True), t="en-AU") == "AUD"
    assert one(spark, B.currency_from_language("t", strict_locale=True), t="fr-CA") == "CAD"


def test_html_tree_and_report(spark, tmp_path):
    for name in ("a.html", "sub/b.html", "backup/c.html", "venv1/d.html", "sub/e.txt"):
        path = tmp_path / "site" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(f"<title>{name}</title>")
    pages = R.html_tree(spark, str(tmp_path / "site"))
    assert sorted(r.url for r in pages.collect()) == ["/a.html", "/sub/b.html"]
    S.write_csv_report(pages, str(tmp_path / "report"))
    back = spark.read.option("header", "true").csv(str(tmp_path / "report"))
    assert back.count() == 2 and back.columns == ["url", "html"]


def test_appends_and_additive_table(spark, tmp_path):
    rows = spark.createDataFrame([(1, 2), (1, 3), (2, 5)], "k long, n long")
    S.append_rows(rows, str(tmp_path / "t"))
    S.append_rows(rows, str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 6
    stream = spark.readStream.schema("k long, n long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "t"))
    S.additive_table_stream(stream, str(tmp_path / "sum"), str(tmp_path / "state"), ["k"], ["n"]).awaitTermination()
    got = {r.k: r.n for r in S.read_additive_table(spark, str(tmp_path / "sum"), ["k"], ["n"]).collect()}
    assert got == {1: 10, 2: 10}


def test_recognition_response_file(spark, tmp_path):
    (tmp_path / "r.json").write_text(
        '{"doc_id": 4, "Blocks": [{"Id": "t", "BlockType": "TABLE", "Relationships": [{"Type": "CHILD", "Ids": ["c", "d"]}]},'
        '{"Id": "c", "BlockType": "CELL", "RowIndex": 1, "ColumnIndex": 2, "Relationships": [{"Type": "CHILD", "Ids": ["w2", "w1"]}]},'
        '{"Id": "d", "BlockType": "CELL", "RowIndex": 2, "ColumnIndex": 1},'
        '{"Id": "w1", "BlockType": "WORD", "Text": "one"}, {"Id": "w2", "BlockType": "WORD", "Text": "two"}]}')
    got = {(r.row, r.col): r.value for r in J.block_tree_cells(R.ocr_responses(spark, str(tmp_path / "r.json"))).collect()}
    assert got == {(0, 1): "two one", (1, 0): ""}
