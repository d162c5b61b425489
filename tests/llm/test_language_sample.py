"""No label with a text is lost from the sample, whatever the sizes of its texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.llm.language import sample


def test_labels_with_short_or_long_texts_only(spark):
    rows = [(i, "w" * 80 + str(i), "mid") for i in range(30)] + [(100 + i, "ab", "mid") for i in range(30)]
    rows += [(200, "kurz", "short"), (201, None, "short"), (202, "", "empty"), (203, "x", None), (300, "".join(chr(97 + i % 26) for i in range(900)), "long")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = sample(docs, F.lit(True), 20, "doc_id", "text", "lang", 50, 500)
    assert set(got) == {"mid", "short", "long"} and got["short"] == ["kurz"]
    assert len(got["mid"]) == 20 and min(map(len, got["mid"])) >= 80
    assert [len(t) for t in got["long"]] == [500] and got["long"][0] in rows[-1][1]
    more = sample(docs, F.lit(True), 40, "doc_id", "text", "lang", 50, 500)["mid"]
    assert len(more) == 40 and sum(len(t) >= 80 for t in more) == 30
    assert sample(docs.limit(0), F.lit(True), 40, "doc_id", "text", "lang") == {}


def test_labels_whose_rows_share_an_id(spark):
    """Neither one id for all rows nor thousands of copies cost a label its sample."""
    rows = [(11, f"{lang} text number {i} " + "x" * 60, lang) for lang in ("de", "en", "es", "fr") for i in range(2000)]
    rows += [(12, "one text only " + "y" * 60, "copies")] * 8000
    got = sample(spark.createDataFrame(rows, "doc_id long, text string, lang string"), F.lit(True), 40, "doc_id", "text", "lang")
    assert {k: len(v) for k, v in got.items()} == {"de": 40, "en": 40, "es": 40, "fr": 40, "copies": 1}
