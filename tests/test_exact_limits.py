"""Measures that lie on a limit do not depend on units or on the order of addition."""

import random

from pyspark.sql import functions as F

from quillmeter.operators import profile as I
from quillmeter.operators import qa as L
from quillmeter.sources import words as S


def test_spread_on_the_limit_is_that_of_page_points(spark):
    """Words at every place of a line, 162 points (0.3 of the page) apart: as max / width - min / width says."""
    places = [(3.0 * k, 3.0 * k + 162.0) for k in range(1, 120)]
    rows = [(i, c - 3.0, c + 3.0, 10.0, False) for i, pair in enumerate(places) for c in pair]
    words = spark.createDataFrame(rows, "doc_id long, x0 double, x1 double, font_size double, bold boolean")
    got = {r["doc_id"]: r["x_span"] for r in L.page_spans(words, S.PAGE_W).collect()}
    assert got == {i: b / S.PAGE_W - a / S.PAGE_W for i, (a, b) in enumerate(places)}
    assert len({v > 0.3 for v in got.values()}) == 2


def test_text_density_on_the_limit(spark):
    """Headings and lines that cover 0.15 of the page exactly, in any cut into words: never below 0.15."""
    rng = random.Random(5)

    def cut(chars):
        while chars > 0:
            n = min(chars, rng.randint(1, 12))
            chars -= n
            yield "x" * n

    texts = []
    for i in range(400):
        heading = 5 * rng.randint(1, 80)  # 8 parts each, other characters 5, 3375 in all
        body = list(cut((3375 - 8 * heading) // 5))
        texts.append((i, "\n".join([" ".join(cut(heading)), *(" ".join(body[k:k + 9]) for k in range(0, len(body), 9))])))
    words = S.words_from_text(spark.createDataFrame(texts, "doc_id long, text string"))
    facts = words.select("doc_id", "page").distinct().select("doc_id", "page", F.lit(0.0).alias("image_density"), F.lit(False).alias("rectangles"))
    got = I.visual_page_score(words, facts, S.PAGE_W, S.PAGE_H).select("score", F.col("boxed").cast("int").alias("boxed")).collect()
    assert len(got) == 400 and all(r["score"] == 15 * r["boxed"] for r in got)
