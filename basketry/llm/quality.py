"""Quality rules on tokeniser fertility: how a public vocabulary copes with the words of a text.

Measured per text: characters per token, share of byte-fallback tokens, and entropy of the token distribution in
bits, judged against what is usual for a text of so many tokens. Each language (or, where it is unknown, each script) has a band;
a text outside its band is rejected.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.llm import hashing as H

PIECES = "/opt/tokenizers/piece_bpe_32k.model"


@dataclass(frozen=True)
class Band:
    """Accepted values of texts with ``least_tokens`` tokens or more.

    ``bits`` are the coefficients (constant first) of the usual token entropy as a polynomial of x = log2(tokens),
    4 <= x <= 16; a text may fall short of it by ``slack`` bits.
    """

    chars_per_token: tuple[float, float]
    byte_share: float
    bits: tuple[float, ...]
    slack: float
    least_tokens: int = 20


#: Parameters of the method. The curve is that of good labelled texts; ordinary prose has 2 to 5 characters a token, so the
#: upper limit only meets texts of a few long pieces.
BANDS = {
    "en": Band((1.3, 6.0), 0.1, (-2.1666, 2.0150, -0.1501, 0.0038), 0.38),
    "de": Band((1.3, 6.0), 0.1, (-3.0092, 2.2977, -0.1834, 0.0050), 0.38),
    "fr": Band((1.3, 6.0), 0.1, (-2.9328, 2.3289, -0.1920, 0.0054), 0.38),
    "es": Band((1.3, 6.0), 0.1, (-1.9794, 1.9560, -0.1462, 0.0037), 0.38),
}
#: For languages without a band, by the script of most letters: wider, as less is known about them.
SCRIPT_BANDS = {
    "latin": Band((1.1, 6.0), 0.2, (-2.9, 2.3, -0.19, 0.005), 0.9),
    "other": Band((0.2, 6.0), 0.95, (-2.9, 2.3, -0.19, 0.005), 2.0),
}

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_tokens", "n_byte_tokens")
#: Measures stand beside the columns of the input under names with this before them.
OWN = "__quality_"
_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_LETTER = np.zeros(256, dtype=bool)
_LETTER[65:91] = _LETTER[97:123] = True
#: Distinct words whose tokens a worker remembers.
_REMEMBERED = 200_000


def _per_row(at: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many of the sorted positions lie in each row."""
    return np.diff(np.searchsorted(at, offsets))


def _dup_lines(data: np.ndarray, offsets: np.ndarray, sums: np.ndarray, word_starts: np.ndarray) -> np.ndarray:
    if not len(data):
        return np.zeros(len(offsets) - 1, dtype=np.int64)
    ends = np.flatnonzero(data == 10)
    starts = np.unique(np.concatenate((offsets[:-1], ends + 1)))
    starts = starts[starts < len(data)]
    stops = np.append(starts[1:], len(data))
    breaks = data[stops - 1] == 10
    stops = stops - breaks
    worded = np.searchsorted(word_starts, stops) > np.searchsorted(word_starts, starts)
    starts, stops = starts[worded], stops[worded]
    row = np.searchsorted(offsets, starts, side="right") - 1
    return _later(H.span_hash(sums, starts, stops), row, len(offsets) - 1)


def _later(hashes: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    """How many of a row's hashes equal an earlier one of the row."""
    order = np.lexsort((hashes, row))
    hashes, row = hashes[order], row[order]
    again = (hashes[1:] == hashes[:-1]) & (row[1:] == row[:-1])
    return np.bincount(row[1:][again], minlength=n)


def _repeat_words(words: np.ndarray, before: np.ndarray, n: int = 5) -> np.ndarray:
    """Words per row that lie in an n-word window found twice or more in the row."""
    counts = np.diff(before)
    rows = len(counts)
    hashes, bounds = H.grams(words, before, n)
    row = np.repeat(np.arange(rows), np.diff(bounds))
    order = np.lexsort((hashes, row))
    same = (hashes[order][1:] == hashes[order][:-1]) & (row[order][1:] == row[order][:-1])
    twice = np.zeros(len(hashes), dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    at = np.flatnonzero(twice)
    start = at - bounds[row[at]] + before[row[at]]
    cover = np.zeros(len(words) + n + 1, dtype=np.int64)
    np.add.at(cover, start, 1)
    np.add.at(cover, start + n, -1)
    covered = np.flatnonzero(np.cumsum(cover)[: len(words)] > 0)
    return np.diff(np.searchsorted(covered, before))


class _Fertility:
    """Tokens of words by a vocabulary file; remembers the words of late."""

    def __init__(self, path: str):
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = self.pieces.get_piece_size()
        self.is_byte = np.array([self.pieces.is_byte(k) for k in range(self.size)])
        self.known: dict[bytes, list[int]] = {}

    def of(self, words: list[bytes]) -> list[list[int]]:
        known = self.known
        new = [w for w in words if w not in known]
        if len(known) + len(new) > _REMEMBERED:
            known.clear()
            new = words
        known.update(zip(new, self.pieces.encode([w.decode("utf-8", "replace") for w in new]), strict=True))
        return [known[w] for w in words]


def _measured(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _Fertility(path)
        for batch in batches:
            for row, data, offsets in H.slices(batch.column("text")):
                n = len(offsets) - 1
                starts, ends, before = H.word_spans(data, offsets)
                sums = H.prefix(data)
                words = H.span_hash(sums, starts, ends)
                in_words = np.concatenate(([0], np.cumsum(((data & 0xC0) != 0x80) & ~H.SPACE[data])))
                letters = np.concatenate(([0], np.cumsum(_LETTER[data])))
                n_words, chars = np.diff(before), np.diff(in_words[offsets])
                _, first, which = np.unique(words, return_index=True, return_inverse=True)
                body = data.tobytes()
                tokens = vocabulary.of([body[starts[k] : ends[k]] for k in first])
                lengths = np.array([len(t) for t in tokens], dtype=np.int64)
                flat = np.array([t for x in tokens for t in x], dtype=np.int64)
                begins = np.concatenate(([0], np.cumsum(lengths)))
                bytes_in = np.concatenate(([0], np.cumsum(vocabulary.is_byte[flat])))
                word_row = np.repeat(np.arange(n), n_words)
                n_tokens = np.bincount(word_row, lengths[which], minlength=n).astype(np.int64)
                n_bytes = np.bincount(word_row, (bytes_in[begins[1:]] - bytes_in[begins[:-1]])[which], minlength=n).astype(np.int64)
                own = lengths[which]
                at = np.arange(own.sum()) - np.repeat(np.cumsum(own) - own, own) + np.repeat(begins[which], own)
                pairs = np.repeat(word_row, own) * vocabulary.size + flat[at]
                pairs.sort()
                cuts = np.flatnonzero(np.concatenate(([True], pairs[1:] != pairs[:-1]))) if len(pairs) else np.zeros(0, np.int64)
                count = np.diff(np.append(cuts, len(pairs)))
                spread = np.bincount(pairs[cuts] // vocabulary.size, count * np.log2(count), minlength=n) if len(cuts) else np.zeros(n)
                entropy = np.log2(np.maximum(n_tokens, 1)) - spread / np.maximum(n_tokens, 1)
                counts = (n_words, chars, _per_row(np.flatnonzero(_SYMBOL[data]), offsets), _dup_lines(data, offsets, sums, starts), _repeat_words(words, before), n_tokens, n_bytes)
                latin = 2 * np.diff(letters[offsets]) >= chars
                given = [batch.column(k).slice(row, n) for k in range(batch.num_columns)]
                yield pa.RecordBatch.from_arrays(
                    given + [pa.array(x.astype(np.int64)) for x in counts] + [pa.array(entropy), pa.array(latin)],
                    batch.schema.names + [OWN + c for c in (*COUNTS, "token_entropy", "latin")],
                )

    return run


def _verdict(bands: dict[str, Band], scripts: dict[str, Band]):
    """Whether a text lies inside its band."""
    tokens, entropy = F.col(OWN + "n_tokens"), F.col(OWN + "token_entropy")
    x = F.least(F.greatest(F.log2(F.greatest(tokens, F.lit(1))), F.lit(4.0)), F.lit(16.0))

    def inside(band: Band):
        usual = sum((F.lit(c) * F.pow(x, F.lit(k)) for k, c in enumerate(band.bits)), F.lit(0.0))
        per_token = F.col(OWN + "word_chars") / F.greatest(tokens, F.lit(1))
        return (tokens < band.least_tokens) | (
            per_token.between(*band.chars_per_token) & (F.col(OWN + "n_byte_tokens") <= band.byte_share * tokens) & (entropy >= usual - band.slack)
        )

    rule = F.when(F.lit(False), F.lit(True))
    for lang, band in bands.items():
        rule = rule.when(F.col("lang") == lang, inside(band))
    return rule.when(F.col(OWN + "latin"), inside(scripts["latin"])).otherwise(inside(scripts["other"]))


def measured(docs: DataFrame, vocabulary: str = PIECES, bands: dict[str, Band] | None = None, scripts: dict[str, Band] | None = None) -> DataFrame:
    """``docs`` (text, lang and any other columns) with the measures and verdicts beside them, named OWN + name."""
    given = docs.withColumn("text", F.col("text").cast("string")).withColumn("lang", F.col("lang").cast("string"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in given.schema)
    own = ", ".join([*(f"{OWN}{c} long" for c in COUNTS), f"{OWN}token_entropy double", f"{OWN}latin boolean"])
    words = F.col(OWN + "n_words")
    return (
        given.mapInArrow(_measured(vocabulary), f"{fields}, {own}")
        .withColumn(OWN + "base_failed", (words < 10) | (100 * F.col(OWN + "n_repeat_words") > 20 * words))
        .withColumn(OWN + "kept", ~F.col(OWN + "base_failed") & _verdict(bands or BANDS, scripts or SCRIPT_BANDS))
    )


def quality(docs: DataFrame, **parameters) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text, lang): counts, fertility measures, base_failed and kept.

    Null and empty texts have zero counts and fail the base rule. A null or unknown ``lang`` is judged by script.
    The order of rows and repeated rows do not matter. Other columns are ignored. ``parameters`` are those of
    measured().
    """
    names = [*COUNTS, "token_entropy", "latin", "base_failed", "kept"]
    out = measured(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang"), **parameters)
    return out.select("doc_id", *(F.col(OWN + c).alias(c) for c in names))


def good_only(docs: DataFrame, **parameters) -> DataFrame:
    """The rows of ``docs`` that quality() keeps, with their columns as they were."""
    return measured(docs, **parameters).where(OWN + "kept").select(*(F.col(f"`{c}`") for c in docs.columns))
