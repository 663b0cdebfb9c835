"""Benchmark decontamination by winnowing.

A window is ``WINDOW`` consecutive words of an item. Of the GRAM-word strings in a window the one with the least hash
(leftmost among equals) is its fingerprint, in benchmark and documents alike, so every window that both share gives
both the same fingerprint at the same place. Shared fingerprints are extended to the whole window and compared word
by word, so hashes decide nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketry.session import stage

WINDOW, GRAM = 10, 5
#: Benchmark fingerprints that may be sent to every executor (about 300 bytes each); beyond, both sides are shuffled.
BROADCAST_ROWS = 100_000
#: A hash and a position in one number: the low bits hold the position.
POSITION_BITS = 29
_SPLIT = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    """Words of a text, A-Z lower-cased; none for null."""
    lowered = F.translate(text, _UPPER, _LOWER)
    return F.filter(F.split(F.coalesce(lowered, F.lit("")), _SPLIT), lambda w: w != "")


def _packed(words: Column, gram: int) -> Column:
    """Per position the hash of the next ``gram`` words, with the position in the low bits."""
    mask = F.lit(-1 << POSITION_BITS)

    def of(hashes: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(hashes) - gram)
        return F.transform(starts, lambda i: F.xxhash64(F.slice(hashes, i + 1, gram)).bitwiseAND(mask).bitwiseOR(i.cast("long")))

    return let(F.transform(words, lambda w: F.xxhash64(w)), of)


def _fingerprints(words: Column, window: int, gram: int) -> Column:
    """The chosen packed values of all windows of ``words``, which has ``window`` words at least."""
    span = window - gram + 1
    return let(
        _packed(words, gram),
        lambda p: F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(p) - span + 1), lambda i: F.array_min(F.slice(p, i, span)))),
    )


def _position(packed: Column) -> Column:
    return packed.bitwiseAND(F.lit((1 << POSITION_BITS) - 1)).cast("int")


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Distinct windows of all items with the items that have them: words, n, items."""
    worded = benchmark.select("item_id", words_of(F.col("text")).alias("all")).where(F.size("all") > 0)
    each = F.when(F.size("all") < window, F.array("all")).otherwise(
        F.transform(F.sequence(F.lit(1), F.size("all") - window + 1), lambda i: F.slice("all", i, window))
    )
    return (
        worded.select("item_id", F.explode(each).alias("words"))
        .groupBy("words")
        .agg(F.collect_set(F.col("item_id").cast("string")).alias("items"))
        .withColumn("n", F.size("words"))
    )


def _hits(docs: DataFrame, windows: DataFrame, length: int, window: int, gram: int) -> DataFrame:
    """(row_id, first, n, items) of each occurrence of the windows of ``length`` words."""
    gram = min(gram, length)
    chosen = F.col("words") if length < window else None
    grams = windows.where(F.col("n") == length)
    if length == window:
        mine, theirs = _fingerprints(F.col("words"), window, gram), _fingerprints(F.col("all"), window, gram)
    else:  # a short item is one window: looked for by its first words, at every position
        mine, theirs = F.slice(_packed(chosen, gram), 1, 1), _packed(F.col("all"), gram)
    shift = F.lit(POSITION_BITS)
    keyed = grams.select("words", "items", F.explode(mine).alias("p")).select(
        F.call_function("shiftright", "p", shift).alias("hash"), _position(F.col("p")).alias("offset"), "words", "items"
    )
    keyed = stage(keyed.groupBy("hash").agg(F.collect_list(F.struct("offset", "words", "items")).alias("windows")), "windows")
    few = keyed.count() <= BROADCAST_ROWS
    printed = docs.where(F.size("all") >= length)
    if few:
        printed = printed.select("row_id", "all", F.explode(theirs).alias("p"))
    else:
        printed = printed.select("row_id", F.explode(theirs).alias("p"))
    printed = printed.withColumn("hash", F.call_function("shiftright", "p", shift)).withColumn("at", _position(F.col("p")))
    met = printed.join(F.broadcast(keyed) if few else keyed, "hash")
    if not few:
        met = met.drop("p", "hash").join(docs, "row_id")
    each = met.select("row_id", "all", "at", F.explode("windows").alias("w")).withColumn("first", F.col("at") - F.col("w.offset"))
    return each.where((F.col("first") >= 0) & (F.slice("all", F.greatest("first", F.lit(0)) + 1, length) == F.col("w.words"))).select(
        "row_id", "first", F.lit(length).alias("n"), F.col("w.items").alias("items")
    )


def _covered(spans: Column) -> Column:
    """Words in the union of (first, n) spans sorted by first."""
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("total"))

    def add(state: Column, x: Column) -> Column:
        end = F.greatest(state["end"], x["first"] + x["n"])
        return F.struct(end.alias("end"), (state["total"] + end - F.least(end, F.greatest(state["end"], x["first"]))).alias("total"))

    return F.aggregate(spans, zero, add, lambda s: s["total"])


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): n_words, n_hit, n_items, items_sha256, contaminated,
    and text_hash (xxhash64 of the text, to find the row again).

    Words are runs of ASCII letters, digits and non-ASCII characters, A-Z lower-cased. A document word within any
    occurrence of an item's window is hit. Null and wordless texts have no words and match nothing, as do such items.
    Items with equal windows all count; a null item_id has a window but is no item of the list. Repeated rows with one
    doc_id and text get equal results. Other columns are ignored.
    """
    row_id = F.struct(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"))
    worded = docs.select(row_id.alias("row_id"), words_of(F.col("text")).alias("all"))
    windows = stage(benchmark_windows(benchmark, window), "benchmark")
    # a window has 1 to ``window`` words, so this list is short
    lengths = sorted(r.n for r in windows.select("n").distinct().collect())
    hits = None
    for length in lengths:
        found = _hits(worded, windows, length, window, gram)
        hits = found if hits is None else hits.union(found)
    plain = docs.select(row_id.alias("row_id"), F.size(words_of(F.col("text"))).cast("long").alias("n_words"))
    if hits is None:
        joined = plain.select("row_id", "n_words", F.lit(None).cast("array<struct<first:int,n:int>>").alias("spans"), F.lit(None).cast("array<string>").alias("names"))
    else:
        per_doc = hits.groupBy("row_id").agg(
            F.array_sort(F.collect_set(F.struct("first", "n"))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("names")
        )
        joined = plain.join(stage(per_doc, "hits"), "row_id", "left")
    names = F.coalesce("names", F.array().cast("array<string>"))
    hit = F.coalesce(_covered(F.col("spans")), F.lit(0).cast("long"))
    return joined.select(
        F.col("row_id.doc_id").alias("doc_id"), "n_words", hit.alias("n_hit"), F.size(names).cast("long").alias("n_items"),
        F.sha2(F.array_join(names, ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated"), F.col("row_id.text_hash").alias("text_hash"),
    )
