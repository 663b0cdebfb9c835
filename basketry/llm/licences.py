"""Licence scan: whole texts and their paragraphs, lines and sentences, brought to a canonical form, are looked up by
digest among known licence texts.

The canonical form folds case, drops the title, copyright lines and punctuation, and replaces equivalent spellings, so
that typographic variants of a licence have one digest.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from basketry.session import stage

#: Words that are spelt in two ways, with the spelling kept.
EQUIVALENT = {
    "licence": "license", "licences": "licenses", "licenced": "licensed", "sublicence": "sublicense", "acknowledgement": "acknowledgment",
    "analogue": "analog", "authorisation": "authorization", "behaviour": "behavior", "centre": "center", "colour": "color",
    "favour": "favor", "favourite": "favorite", "fulfil": "fulfill", "honour": "honor", "judgement": "judgment", "labour": "labor",
    "merchantibility": "merchantability", "noncommercial": "non commercial", "organisation": "organization", "organise": "organize",
    "programme": "program", "realise": "realize", "recognise": "recognize", "whilst": "while", "wilful": "willful",
    "copyright holder": "copyright owner", "per cent": "percent",
}
#: Full standard texts, one file by identifier.
TEXTS = Path(__file__).with_name("licence_texts")
#: Short notices and licence texts by identifier, as their publishers give them.
KNOWN = {
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0."],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0."],
    "MIT": [
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ],
    "GPL-3.0-only": ["This work is licensed under the GNU General Public License, version 3."],
    "LicenseRef-all-rights-reserved": ["All rights reserved."],
    "ISC": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
    ],
    "0BSD": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
    ],
}
_COPYRIGHT = r"(?m)^[^\S\n]*(?:copyright\b(?=[^\S\n]*(?:\(c\)|©|[0-9]))|\(c\)|©)[^\n]*$"


_TITLE = r"^\s*(?:the[^\S\n]+)?(?:mit|expat|isc|0bsd|(?:zero-clause|0-clause)[^\S\n]+bsd|bsd[^\S\n]+(?:zero[ -]clause|[0-4]-clause))[^\S\n]+licen[cs]e(?:[^\S\n]*\([^)\n]*\))?[^\S\n]*[.:]?[^\S\n]*\n"
#: Marks of the ends of paragraphs, lines and sentences.
_PARAGRAPH, _LINE, _SENTENCE = "\ue000", "\ue001", "\ue002"
#: Spellings of one word are looked up word by word, those of two words in the joined text.
_ONE_WORD = {old: new for old, new in EQUIVALENT.items() if " " not in old}
_TWO_WORDS = {old: new for old, new in EQUIVALENT.items() if " " in old}  # their beginnings: what follows stays


def _bare(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), _TITLE, ""), _COPYRIGHT, " ")


def _marked(text: Column) -> Column:
    """Words in one spelling and marks, each with a space around it; one pass over the words."""
    marked = F.regexp_replace(_bare(text), f"[{_PARAGRAPH}{_LINE}{_SENTENCE}]", " ")
    marked = F.regexp_replace(marked, r"\n[^\S\n]*(?:\n\s*)+", f" {_PARAGRAPH} ")
    marked = F.regexp_replace(F.replace(marked, F.lit("\n"), F.lit(f" {_LINE} ")), r"(?<=[.!?])[^\S\n]+", f" {_SENTENCE} ")
    words = F.split(F.regexp_replace(marked, f"[^\\p{{L}}\\p{{N}}{_PARAGRAPH}{_LINE}{_SENTENCE}]+", " "), " ")
    spelt = F.create_map(*[F.lit(x) for pair in _ONE_WORD.items() for x in pair])
    return F.concat(F.lit(" "), F.array_join(F.transform(words, lambda w: F.coalesce(F.try_element_at(spelt, w), w)), " "), F.lit(" "))


def _joined(marked: Column, within: str) -> Column:
    """The words with one space between them, with marks ``within`` as white space and spellings of two words changed."""
    words = F.regexp_replace(marked, f"[ {within}]+", " ")
    for old, new in _TWO_WORDS.items():
        words = F.replace(words, F.lit(f" {old}"), F.lit(f" {new}"))
    return words


def _whole(joined: Column) -> Column:
    """The canonical text from words in which paragraphs' marks alone are left."""
    return F.trim(F.replace(joined, F.lit(f"{_PARAGRAPH} "), F.lit("")))


def canonical(text: Column) -> Column:
    """Lower-case words with one space between them, without a title and copyright lines, in one spelling."""
    return _whole(_joined(_marked(text), _LINE + _SENTENCE))


def known_licences(spark: SparkSession, folder: str | None = None) -> DataFrame:
    """(digest, licence, length): one row per distinct digest of the known texts, and of ``folder``/<identifier>.txt files."""
    rows = [(name, text) for name, texts in KNOWN.items() for text in texts]
    rows += [(path.stem, path.read_text("utf-8")) for path in sorted(TEXTS.glob("*.txt"))]
    texts = spark.createDataFrame(rows, "licence string, text string")
    if folder:
        files = spark.read.text(folder, wholetext=True).select(F.regexp_extract(F.input_file_name(), r"([^/]+)\.txt$", 1).alias("licence"), F.col("value").alias("text"))
        texts = texts.unionByName(files)
    form = texts.select("licence", canonical(F.col("text")).alias("form")).where("form <> ''")
    return form.groupBy(F.sha2("form", 256).alias("digest")).agg(F.min("licence").alias("licence"), F.max(F.length("form")).alias("length"))


def scan(docs: DataFrame, folder: str | None = None) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): digest of the canonical whole text, its n_words, and the licence.

    ``licence`` is that of the whole text, or else of a paragraph, line or sentence that is a known text; null where
    there is none, and for null, empty and wordless texts, which have a digest of nothing. Of several licences, or
    identifiers with one canonical text, the smallest is given, and ``licences`` has all. Repeated rows get equal
    results. Other columns are ignored.

    The digests of units that are as long as some known text are joined with the known digests, however many there are.
    """
    known = stage(known_licences(docs.sparkSession, folder), "known")
    # a digit for each length up to the longest known text: 1 where a known text has it
    lengths = {r.length for r in known.select("length").distinct().collect()}
    has = F.lit("".join("01"[k in lengths] for k in range(max(lengths) + 1)))
    longest = max(lengths)
    marked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _marked(F.col("text")).alias("marked"))
    joined = marked.select(
        "doc_id",
        _joined(F.col("marked"), _LINE + _SENTENCE).alias("paragraphs"),
        # without a mark of lines, lines are paragraphs; sentences likewise
        F.when(F.contains("marked", F.lit(_LINE)), _joined(F.col("marked"), _SENTENCE)).otherwise("").alias("lines"),
        F.when(F.contains("marked", F.lit(_SENTENCE)), _joined(F.col("marked"), _LINE)).otherwise("").alias("sentences"),
    )
    units = joined.select(
        "doc_id",
        _whole(F.col("paragraphs")).alias("form"),
        F.split("paragraphs", _PARAGRAPH).alias("paragraphs"),
        F.split("lines", f"[{_PARAGRAPH}{_LINE}]").alias("lines"),
        F.split("sentences", f"[{_PARAGRAPH}{_SENTENCE}]").alias("sentences"),
    )

    def possible(unit: Column) -> Column:
        size = F.length(F.trim(unit))
        return (size <= longest) & (F.substring(has, size + 1, 1) == "1")

    def digests(column: str) -> Column:
        return F.transform(F.filter(column, possible), lambda u: F.sha2(F.trim(u), 256))

    looked = units.select(
        F.monotonically_increasing_id().alias("row"),
        "doc_id",
        F.when(F.col("form") == "", 0).otherwise(F.length("form") - F.length(F.replace("form", F.lit(" "))) + 1).cast("long").alias("n_words"),
        F.sha2("form", 256).alias("digest"),
        F.array_distinct(F.concat(digests("paragraphs"), digests("lines"), digests("sentences"))).alias("units"),
    )
    looked = stage(looked, "digests")  # row numbers hold from here on
    asked = looked.select("row", "digest", F.explode("units").alias("unit")).union(looked.select("row", "digest", F.col("digest").alias("unit")))
    hits = asked.join(known.select(F.col("digest").alias("unit"), "licence"), "unit")
    found = hits.groupBy("row").agg(F.min(F.when(F.col("unit") == F.col("digest"), F.col("licence"))).alias("whole"), F.min("licence").alias("least"), F.sort_array(F.collect_set("licence")).alias("licences"))
    return looked.join(found, "row", "left").select(
        "doc_id", "n_words", "digest", F.coalesce("whole", "least").alias("licence"), F.coalesce("licences", F.array().cast("array<string>")).alias("licences")
    )
