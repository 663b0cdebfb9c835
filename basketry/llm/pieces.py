"""N-best piece segmentation of whole texts, and decoding.

The lattice of a text has a node between any two characters and an edge for every vocabulary piece that fits;
a character without a piece has an edge that stands for its bytes. A segmentation's score is the sum of its pieces'
scores. No piece has a space mark after another character, so the lattice falls apart before each run of space marks.

Forward Viterbi scores are found for all distinct parts of a batch at once. Backward scores give the loss of each
part's second-best path; only the ``n - 1`` parts of a text with the least loss can differ in its n best
segmentations. Over their lattices a backward A* search, with the forward scores as exact heuristic, lists these.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.llm import hashing as H

PIECES = "/opt/tokenizers/piece_bpe_32k.model"
MARK = 0x2581
NEVER = -(1 << 60)
#: The loss of a character without a piece beyond the worst piece.
UNKNOWN = 10
#: Piece scores at or below this are for other uses of the vocabulary; such pieces get the worst ordinary score.
UNUSED = -1e8
#: Parts of a batch are handled by length, so that short ones need little room.
LENGTHS = (4, 8, 12, 16, 24, 32, 64)
RESULT = (
    "doc_id long, n_pieces long, n_fallback long, piece_ids array<int>, scores array<long>, "
    "changes array<array<struct<part:int,ids:array<int>>>>, round_trip boolean"
)
_STEP = np.uint64(0xD1342543DE82EF95)


class Vocabulary:
    """Scores and look-up tables of a vocabulary file."""

    def __init__(self, path: str):
        file = sentencepiece.SentencePieceProcessor(model_file=path)
        size = file.get_piece_size()
        self.names = [file.id_to_piece(k) for k in range(size)]
        own = [k for k in range(size) if not (file.is_control(k) or file.is_unknown(k) or file.is_byte(k) or file.is_unused(k))]
        scores = {k: file.get_score(k) for k in own}
        worst = min(v for v in scores.values() if v > UNUSED)
        self.score = {self.names[k]: (max(v, worst), k) for k, v in scores.items()}
        # whole numbers: sums are exact in any order
        self.scale = 1 if all(float(v).is_integer() for v, _ in self.score.values()) else 1 << 20
        self.score = {p: (round(v * self.scale), k) for p, (v, k) in self.score.items()}
        self.unknown = round((worst - UNKNOWN) * self.scale)
        self.longest = max(map(len, self.score))
        self.byte = {int(file.id_to_piece(k)[3:5], 16): k for k in range(size) if file.is_byte(k)}
        self.text = [bytes([int(n[3:5], 16)]) if file.is_byte(k) else n.encode() for k, n in enumerate(self.names)]
        for k in range(size):
            if file.is_control(k) or file.is_unknown(k):
                self.text[k] = b""
        # by length: hashes of all beginnings of pieces, with the score and id where the beginning is a piece
        own = list(self.score)
        size = np.array([len(p) for p in own])
        chars = np.zeros((len(own), self.longest), np.uint32)
        for k, p in enumerate(own):
            chars[k, : size[k]] = np.frombuffer(p.encode("utf-32-le"), np.uint32)
        values, names = (np.array(x, np.int64) for x in zip(*self.score.values(), strict=True))
        mixed, h, self.tables = H.mix(chars.astype(np.uint64)), np.zeros(len(own), np.uint64), []
        for n in range(1, self.longest + 1):
            h = h * _STEP + mixed[:, n - 1]
            keys = np.unique(h[size >= n])
            scores, ids = np.full(len(keys), NEVER), np.full(len(keys), -1)
            at = np.searchsorted(keys, h[size == n])
            scores[at], ids[at] = values[size == n], names[size == n]
            self.tables.append((keys, scores, ids))

    def fallback(self, char: str) -> list[int]:
        return [self.byte[b] for b in char.encode("utf-8", "replace")]


def nbest(parts: list[str], vocabulary: Vocabulary, n: int) -> list[tuple[int, list[list[int]]]]:
    """The n best segmentations of ``parts``, whose lattices follow each other: (score, ids of each part).

    Forward Viterbi, then A* from the end; equal scores in the order of the longer last pieces.
    """
    forward, edges, owner = [0], [[]], []
    for part in parts:
        base = len(forward) - 1
        for end in range(1, len(part) + 1):
            into = []
            for begin in range(max(0, end - vocabulary.longest), end):
                if (found := vocabulary.score.get(part[begin:end])) is not None:
                    into.append((base + begin, found[0], [found[1]]))
                elif end - begin == 1:
                    into.append((base + begin, vocabulary.unknown, vocabulary.fallback(part[begin:end])))
            forward.append(max(forward[b] + v for b, v, _ in into))
            edges.append(into)
            owner.append(None)
        owner[base : base + len(part)] = [len(owner)] * len(part)
    ends = np.cumsum([len(p) for p in parts])
    heap, out, tick = [(-forward[-1], 0, len(forward) - 1, 0, None)], [], 0
    while heap and len(out) < n:
        _, _, node, tail, path = heapq.heappop(heap)
        if node == 0:
            ids: list[list[int]] = [[] for _ in parts]
            while path is not None:
                (begin, own), path = path
                ids[int(np.searchsorted(ends, begin, side="right"))].extend(own)
            out.append((tail, ids))
            continue
        for begin, value, own in edges[node]:
            tick += 1
            heapq.heappush(heap, (-(forward[begin] + value + tail), tick, begin, value + tail, ((begin, own), path)))
    return out


def decode(ids, vocabulary: Vocabulary) -> str:
    """Text of piece ids; bytes that are no UTF-8 give replacement characters."""
    body = b"".join([vocabulary.text[k] for k in ids]).replace("▁".encode(), b" ")
    return body[1:].decode("utf-8", "replace") if body[:1] == b" " else body.decode("utf-8", "replace")


def _viterbi(chars: np.ndarray, size: np.ndarray, vocabulary: Vocabulary):
    """Over parts as rows of characters: best score, loss of the second-best path, and the best path's pieces.

    The pieces come as (part, step from the end, id or -1 - character, sorted by part and from the start).
    """
    n, width = chars.shape
    most = min(vocabulary.longest, width)
    values = np.full((most, n, width), NEVER, np.int64)
    ids = np.full((most, n, width), -1, np.int32)
    mixed = H.mix(chars.astype(np.uint64))
    inside = np.arange(width)[None, :] < size[:, None]
    row, col = np.nonzero(inside)
    h = np.zeros(len(row), np.uint64)
    for k in range(most):
        fits = col + k < size[row]
        row, col, h = row[fits], col[fits], h[fits]
        h = h * _STEP + mixed[row, col + k]
        keys, scores, names = vocabulary.tables[k]
        at = np.minimum(np.searchsorted(keys, h), max(len(keys) - 1, 0))
        known = keys[at] == h if len(keys) else np.zeros(len(h), bool)
        if k == 0:
            values[0][inside] = vocabulary.unknown
        row, col, h, at = row[known], col[known], h[known], at[known]
        whole = scores[at] > NEVER
        values[k, row[whole], col[whole]] = scores[at[whole]]
        ids[k, row[whole], col[whole]] = names[at[whole]]
    forward = np.full((n, width + 1), NEVER, np.int64)
    forward[:, 0] = 0
    back = np.zeros((n, width + 1), np.int8 if most < 127 else np.int32)
    for end in range(1, width + 1):
        for k in range(min(most, end) - 1, -1, -1):  # of equal scores the longest last piece
            score = forward[:, end - k - 1] + values[k, :, end - k - 1]
            better = score > forward[:, end]
            forward[better, end] = score[better]
            back[better, end] = k + 1
    rows = np.arange(n)
    best = forward[rows, size]
    behind = np.full((n, width + most + 1), NEVER, np.int64)
    behind[rows, size] = 0
    for begin in range(width - 1, -1, -1):
        own = behind[:, begin]
        for k in range(most):
            np.maximum(own, behind[:, begin + k + 1] + values[k, :, begin], out=own)
    part, step, piece, at, taken = [], [], [], size.copy(), 0
    on_path = values  # scores of the best path's edges are struck out below
    live = rows
    while len(live):
        length = back[live, at[live]].astype(np.int64)
        begin = at[live] - length
        name = ids[length - 1, live, begin]
        part.append(live)
        step.append(np.full(len(live), taken))
        piece.append(np.where(name >= 0, name, -1 - chars[live, begin].astype(np.int64)))
        on_path[length - 1, live, begin] = NEVER
        at[live] = begin
        live = live[begin > 0]
        taken += 1
    second = np.full(n, NEVER, np.int64)
    for k in range(most):
        through = forward[:, : width - k] + on_path[k][:, : width - k] + behind[:, k + 1 : width + 1]
        np.maximum(second, through.max(axis=1), out=second)
    part, step, piece = (np.concatenate(x) for x in (part, step, piece))
    order = np.lexsort((-step, part))
    return best, np.where(second > NEVER // 2, best - second, 1 << 60), part[order], piece[order]


def _encode(path: str, n_best: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary(path)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            row = 0
            while row < len(texts):
                last, held = row, 0
                while last < len(texts) and (last == row or held + len(texts[last] or "") <= H.SLICE_BYTES):
                    held += len(texts[last] or "")
                    last += 1
                yield _encoded(batch.column("doc_id").slice(row, last - row), texts[row:last], vocabulary, n_best)
                row = last

    return run


def _encoded(doc_ids: pa.Array, texts: list[str | None], vocabulary: Vocabulary, n_best: int) -> pa.RecordBatch:
    marked = ["▁" + t.replace(" ", "▁") if t else "" for t in texts]
    chars = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), np.uint32)
    edges = np.concatenate(([0], np.cumsum([len(m) for m in marked])))
    mark = chars == MARK
    begins = mark.copy()
    begins[1:] &= ~mark[:-1]
    begins[edges[:-1][edges[:-1] < len(chars)]] = True
    start = np.flatnonzero(begins)
    stop = np.append(start[1:], len(chars))
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(H.mix(chars.astype(np.uint64)) * H.powers(len(chars) + 1)[: len(chars)], dtype=np.uint64)))
    _, first, which = np.unique(H.span_hash(sums, start, stop), return_index=True, return_inverse=True)
    size = (stop - start)[first]
    best, loss = np.zeros(len(first), np.int64), np.zeros(len(first), np.int64)
    owner, pieces, low = [], [], 0
    for high in (*LENGTHS, *(1 << k for k in range(7, 32))):
        # a table of parts, their lengths and piece lengths stays near 4 million places
        group = np.flatnonzero((size > low) & (size <= high))
        room = max(1, (1 << 22) // (high * min(high, vocabulary.longest)))
        for k in range(0, len(group), room):
            some = group[k : k + room]
            width = int(size[some].max())
            at = start[first[some]][:, None] + np.arange(width)[None, :]
            square = np.where(np.arange(width)[None, :] < size[some][:, None], chars[np.minimum(at, len(chars) - 1)], 0)
            best[some], loss[some], part, piece = _viterbi(square, size[some], vocabulary)
            owner.append(some[part])
            pieces.append(piece)
        low = high
        if low >= size.max(initial=0):
            break
    owner = np.concatenate(owner) if owner else np.zeros(0, np.int64)
    pieces = np.concatenate(pieces) if pieces else np.zeros(0, np.int64)
    # spell out characters without a piece
    odd = pieces < 0
    if odd.any():
        spelled = {c: vocabulary.fallback(chr(-1 - c)) for c in np.unique(pieces[odd]).tolist()}
        counts = np.ones(len(pieces), np.int64)
        counts[odd] = [len(spelled[c]) for c in pieces[odd].tolist()]
        owner = np.repeat(owner, counts)
        long = np.repeat(pieces, counts)
        long[long < 0] = [b for c in pieces[odd].tolist() for b in spelled[c]]
        pieces = long
    order = np.argsort(owner, kind="stable")
    owner, pieces = owner[order], pieces[order].astype(np.int32)
    begin = np.searchsorted(owner, np.arange(len(first) + 1))
    count = np.diff(begin)
    own = count[which]
    flat = pieces[np.arange(own.sum()) - np.repeat(np.cumsum(own) - own, own) + np.repeat(begin[which], own)]
    parts_before = np.searchsorted(start, edges)
    pieces_before = np.concatenate(([0], np.cumsum(own)))[parts_before]
    score = np.concatenate(([0], np.cumsum(best[which])))[parts_before]
    score = np.diff(score)
    byte_ids = np.zeros(len(vocabulary.names), bool)
    byte_ids[list(vocabulary.byte.values())] = True
    fallback = np.diff(np.concatenate(([0], np.cumsum(byte_ids[flat])))[pieces_before])
    scores, changes, whole = [], [], []
    losses = loss[which]
    known: dict[tuple[str, ...], list] = {}
    for k, text in enumerate(texts):
        a, b = parts_before[k], parts_before[k + 1]
        own_loss = losses[a:b]
        m = min(n_best - 1, b - a)
        near = np.sort(np.argpartition(own_loss, m - 1)[:m]) if 0 < m < b - a else np.arange(b - a)
        words = tuple("".join(map(chr, chars[start[a + j] : stop[a + j]])) for j in near) if m > 0 else ()
        lists = []
        if words:
            lists = known.get(words)
            if lists is None:
                lists = known[words] = nbest(list(words), vocabulary, n_best)
        scores.append([int(score[k] - lists[0][0] + s) for s, _ in lists] if lists else [int(score[k])] if b > a else [])
        changes.append([[{"part": int(j), "ids": x} for j, x, y in zip(near, ids, lists[0][1], strict=True) if x != y] for _, ids in lists])
        whole.append(decode(flat[pieces_before[k] : pieces_before[k + 1]].tolist(), vocabulary) == (text or "").replace("▁", " "))
    return pa.RecordBatch.from_arrays(
        [
            doc_ids,
            pa.array(np.diff(pieces_before)),
            pa.array(fallback.astype(np.int64)),
            pa.ListArray.from_arrays(pa.array(pieces_before.astype(np.int32)), pa.array(flat)),
            pa.array(scores, pa.list_(pa.int64())),
            pa.array(changes, pa.list_(pa.list_(pa.struct([("part", pa.int32()), ("ids", pa.list_(pa.int32()))])))),
            pa.array(whole),
        ],
        ["doc_id", "n_pieces", "n_fallback", "piece_ids", "scores", "changes", "round_trip"],
    )


def encode(docs: DataFrame, vocabulary: str = PIECES, n_best: int = 3) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): the best segmentation's ids and the scores of the ``n_best`` best.

    ``changes`` has for each of them the parts (from 0; a part begins at each run of spaces) that differ from the
    best, with their ids. ``round_trip`` says that decoding the ids gives the text (a literal U+2581 reads as a
    space). Null and empty texts have no pieces, no scores, and round_trip true. Texts with fewer than ``n_best``
    segmentations list all. Repeated rows give equal rows. Other columns are ignored.
    """
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return plain.mapInArrow(_encode(vocabulary, n_best), RESULT)


def decoded(encoded: DataFrame, vocabulary: str = PIECES) -> DataFrame:
    """(doc_id, text) from (doc_id, piece_ids); null ids give an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Vocabulary(vocabulary)
        for batch in batches:
            texts = [decode(x.as_py() or (), known) for x in batch.column("piece_ids")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "piece_ids").mapInArrow(run, "doc_id long, text string")
