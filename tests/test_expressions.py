"""Missing-value, boundary and parsing rules of the scalar and text expressions."""

from __future__ import annotations

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from basketry.functions import scalars as sc
from basketry.functions import text as tx


def one(df, col):
    return [r[0] for r in df.select(col).collect()]


def test_timestamps_in_mixed_forms(rows):
    df = rows("t string", ("2024-01-02 03:04:05",), ("2024-01-02T03:04:05Z",), ("2024-01-02 03:04:05+00:00",), ("2024-01-02 03:04:05 UTC",), ("nope",), (None,))
    assert one(df, sc.parse_timestamp(F.col("t"))) == [datetime(2024, 1, 2, 3, 4, 5)] * 4 + [None, None]


def test_numbers_with_defaults(rows):
    df = rows("t string, o double", ("1.5", 9.0), ("x", 9.0), ("NaN", 9.0), (None, 9.0))
    assert one(df, sc.to_number(F.col("t"))) == [1.5, None, None, None]
    assert one(df, sc.to_number(F.col("t"), 0)) == [1.5, 0.0, 0.0, 0.0]
    assert one(df, sc.to_number(F.col("t"), F.col("o"))) == [1.5, 9.0, 9.0, 9.0]


def test_text_repair_and_blanks(rows):
    df = rows("t string", ("itâ€™s 10Â® â€“ ok",), (" nan ",), ("None",), ("  ",), (" a ",), (None,))
    assert one(df, sc.repair_text(F.col("t")))[0] == "it's 10® - ok"
    assert one(df, sc.blank_to_null(F.col("t")))[1:] == [None, None, None, "a", None]


def test_ratio_clip_and_days(rows):
    df = rows("a double, b double", (4.0, 2.0), (1.0, 0.0), (None, 2.0))
    assert one(df, sc.safe_ratio(F.col("a"), F.col("b"))) == [2.0, 0.0, 0.0]
    assert one(df, sc.clip(F.col("a"), 2.0, 3.0)) == [3.0, 2.0, None]
    days = rows("x timestamp, y timestamp", (datetime(2024, 1, 3, 1), datetime(2024, 1, 1, 2)), (datetime(2024, 1, 1), datetime(2024, 1, 1, 1)))
    assert one(days, sc.whole_days(F.col("x"), F.col("y"))) == [1, -1]


def test_bins(rows):
    df = rows("a double", (13.0,), (14.0,), (14.5,), (24.0,), (64.0,), (100.0,), (101.0,), (None,))
    assert one(df, sc.age_group(F.col("a"))) == [None, None, "14-24", "14-24", "55-64", "65+", None, None]
    risk = rows("p double", (0.0,), (0.35,), (0.36,), (0.65,), (0.66,), (1.0,))
    assert one(risk, sc.risk_band(F.col("p"))) == ["low", "low", "medium", "medium", "high", "high"]


def test_known_values_respect_the_recording_time(rows):
    early, late = datetime(2024, 1, 1), datetime(2024, 1, 2)
    df = rows("created_at timestamp, f double, at timestamp", (late, 1.0, early), (early, 2.0, late), (late, 3.0, None), (late, None, early))
    out = sc.known_value(df, "f", "at", fill=F.lit(-1.0)).collect()
    assert [(r["f_is_known"], r["f_value"]) for r in out] == [(1, 1.0), (0, -1.0), (0, -1.0), (0, -1.0)]
    assert [r["f_is_known"] for r in sc.known_value(df, "f").collect()] == [1, 1, 1, 0]


@pytest.mark.parametrize(
    "review, words, unique, score, negative, positive, has",
    [
        ("", 0, 0, 0, 0, 0, 1),
        (None, 1, 1, 0, 0, 0, 0),
        ("Good, good!! but BAD?", 4, 3, 1, 0, 1, 1),
        ("bad good", 2, 2, 0, 0, 0, 1),
        ("broken 123 late", 2, 2, -2, 1, 0, 1),
    ],
)
def test_review_features(rows, review, words, unique, score, negative, positive, has):
    r = tx.review_features(rows("customer_review string", (review,))).first()
    assert (r["review_word_count"], r["review_unique_word_count"], r["review_sentiment_score"]) == (words, unique, score)
    assert (r["review_negative_flag"], r["review_positive_flag"], r["has_review"]) == (negative, positive, has)
    if review and "!!" in review:
        assert (r["review_exclamation_count"], r["review_question_count"]) == (2, 1)


def test_substring_flag_and_words(rows):
    df = rows("t string", ("Arrived LATEr",), ("fine",), (None,))
    assert one(df, tx.mentions_any(F.col("t"))) == [1, 0, 0]
    reviews = tx.review_features(rows("customer_review string", ("bad bad box",), ("bad the box",), ("good box",)))
    words = tx.frequent_negative_words(reviews, ["the"], top=2).collect()
    assert [(r["word"], r["freq"]) for r in words] == [("bad", 3), ("box", 2)]


def test_missing_reviews_are_not_split(spark):
    """A missing review has the counts of its stand-in without being split; other writings of it are split as ever."""
    from basketry.functions.text import review_features

    words = {"positive": ["unknown"], "negative": ["good"]}
    found = review_features(spark.createDataFrame([(None,), ("Unknown",), ("unknown",)], "customer_review string"), **words)
    hidden = {"customer_review", "review_text", "has_review"}
    got = [{k: v for k, v in r.asDict().items() if k not in hidden} for r in found.collect()]
    assert got[0] == got[1] == got[2] and got[0]["positive_word_count"] == 1 and got[0]["review_word_count"] == 1
    # the split is made where the text is given; before, the words of every row were made
    plan = found.select("review_word_count")._jdf.queryExecution().optimizedPlan().toString()
    assert "= Unknown" in plan
    assert [r["has_review"] for r in found.collect()] == [0, 0, 1]
