"""Review-text features as built-in expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Words that mark a review as positive.
POSITIVE_WORDS = [
    "good", "great", "excellent", "amazing", "perfect", "love", "loved", "happy",
    "comfortable", "durable", "nice", "solid", "recommend", "satisfied", "works",
]

# Words that mark a review as negative.
NEGATIVE_WORDS = [
    "bad", "poor", "terrible", "awful", "disappointed", "broken", "late", "return",
    "cheap", "worst", "hate", "problem", "issue", "damaged", "small", "big", "fit",
]

# Substrings of the simple negative flag.
NEGATIVE_SUBSTRINGS = [
    "bad", "poor", "terrible", "awful", "disappointed", "broken", "late", "return",
    "defect", "cheap", "worst", "hate", "problem", "issue", "damaged",
]

# Fixed value: the text of a missing review.
MISSING_REVIEW = "Unknown"


def normal_text(col: Column) -> Column:
    """Lower case, anything but a-z squeezed to one space, trimmed."""
    return F.trim(F.regexp_replace(F.lower(col), "[^a-z]+", " "))


def tokens(clean: Column) -> Column:
    """Words of normalised text; the empty text has none."""
    return F.when(clean == "", F.array().cast("array<string>")).otherwise(F.split(clean, " "))


def mentions_any(col: Column, substrings: Sequence[str] = NEGATIVE_SUBSTRINGS) -> Column:
    """1 if the lower-cased text holds any of the substrings, 0 if not or missing."""
    lowered = F.lower(F.coalesce(col, F.lit("")))
    hit = F.lit(False)
    for word in substrings:
        hit = hit | F.contains(lowered, F.lit(word))
    return hit.cast("int")


def _listed(words: Column, lexicon: Sequence[str]) -> Column:
    return F.size(F.filter(words, lambda w: w.isin(list(lexicon))))


def review_features(
    df: DataFrame,
    review: str = "customer_review",
    positive: Sequence[str] = POSITIVE_WORDS,
    negative: Sequence[str] = NEGATIVE_WORDS,
) -> DataFrame:
    """Add the review columns: text, lengths, punctuation counts, lexicon counts, sentiment.

    A missing review reads as ``Unknown``; its counts are constants, so that nothing is split for it.
    """
    text = F.coalesce(F.col(review), F.lit(MISSING_REVIEW))
    given = F.col("review_text") != MISSING_REVIEW
    word = MISSING_REVIEW.lower()

    def count(col: Column, missing: int) -> Column:
        return F.when(given, col).otherwise(F.lit(missing))

    out = df.withColumn("review_text", text)
    out = out.withColumn("review_text_clean", F.when(given, normal_text(F.col("review_text"))).otherwise(F.lit(word)))
    out = out.withColumn("_words", F.when(given, tokens(F.col("review_text_clean")))).select(
        "*",
        F.length("review_text").alias("review_char_len"),
        count(F.size("_words"), 1).alias("review_word_count"),
        count(F.size(F.array_distinct("_words")), 1).alias("review_unique_word_count"),
        count(F.regexp_count("review_text", F.lit("!")), 0).alias("review_exclamation_count"),
        count(F.regexp_count("review_text", F.lit("[?]")), 0).alias("review_question_count"),
        given.cast("int").alias("has_review"),
        count(_listed(F.col("_words"), positive), int(word in positive)).alias("positive_word_count"),
        count(_listed(F.col("_words"), negative), int(word in negative)).alias("negative_word_count"),
    )
    pos, neg = F.col("positive_word_count"), F.col("negative_word_count")
    return out.drop("_words").select(
        "*",
        (pos - neg).alias("review_sentiment_score"),
        (neg > pos).cast("int").alias("review_negative_flag"),
        (pos > neg).cast("int").alias("review_positive_flag"),
    )


def frequent_negative_words(reviews: DataFrame, stop_words: Sequence[str], top: int = 20, min_length: int = 3) -> DataFrame:
    """Top words of reviews flagged negative, stop words and short words left out."""
    words = (
        reviews.where(F.col("review_negative_flag") == 1)
        .select(F.explode(tokens(F.col("review_text_clean"))).alias("word"))
        .where((F.length("word") >= min_length) & ~F.col("word").isin(list(stop_words)))
    )
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("freq")).orderBy(F.desc("freq"), "word").limit(top)
