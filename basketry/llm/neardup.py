"""Near duplicates by MinHash with tensored banding, confirmed on full shingle sets.

Two collections of ``BANDS`` keys, each from ``ROWS`` minhashes, are paired into BANDS x BANDS table keys of
2 x ROWS minhashes each, so 2 x BANDS x ROWS minhashes do the work of BANDS^2 x 2 x ROWS. Texts with the same
shingle set are one class from the start. Only ids are dealt out by the keys of the first collection; a key that two
classes share is a bucket, whose members get their sketches and are paired by the second collection inside the task.

Buckets of many copies are not written out as pairs. First each bucket gives a spanning forest of its likeliest links;
what the full sets confirm joins components. Buckets whose members lie in several components give another forest across
them, and in the end all pairs across components that a table key shares, so that none is passed over.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.llm import hashing as H
from basketry.llm.components import components
from basketry.session import stage

BANDS, ROWS = 18, 4
#: Minhashes of the table keys, and as many more to tell how alike two texts are.
KEYED = 2 * BANDS * ROWS
SKETCH = 2 * KEYED
#: Shingles are counted in so many classes, in half a byte each: the sum of the smaller counts bounds an intersection.
CLASSES = 128
WIDE = SKETCH + CLASSES // 2
#: Buckets up to this size are compared together; larger ones each by itself, in blocks of about HELD members.
SMALL, HELD = 64, 2000
#: The first forests are made from the buckets of so many keys of the first collection.
FIRST_BANDS = 6
_SEEDS = H.mix(np.arange(1, SKETCH + 1, dtype=np.uint64))
_FACTORS = (_SEEDS >> np.uint64(32)).astype(np.uint32) | np.uint32(1)


def _shingles(column: pa.Array, words: int):
    for row, data, offsets in H.slices(column):
        data = H.LOWER[data]
        starts, ends, before = H.word_spans(data, offsets)
        hashes, bounds = H.grams(H.span_hash(H.prefix(data), starts, ends), before, words)
        yield row, hashes, bounds


def _sketches(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, hashes, bounds in _shingles(batch.column("text"), words):
                n = len(bounds) - 1
                classes = np.zeros((n, CLASSES), np.uint8)
                count, low, high = np.zeros(n, np.int64), np.zeros(n, np.uint64), np.zeros(n, np.uint64)
                for k in range(n):
                    own = np.unique(hashes[bounds[k] : bounds[k + 1]])
                    count[k], low[k], high[k] = len(own), own.sum(dtype=np.uint64), H.mix(own).sum(dtype=np.uint64)
                    classes[k] = np.minimum(np.bincount((own % np.uint64(CLASSES)).astype(np.int64), minlength=CLASSES), 15)
                sketch = np.zeros((n, SKETCH), np.uint8)
                full = np.flatnonzero(np.diff(bounds))
                if len(full):
                    lower, upper = hashes.astype(np.uint32), (hashes >> np.uint64(32)).astype(np.uint32)
                    for k in range(SKETCH):
                        least = np.minimum.reduceat((lower ^ np.uint32(_SEEDS[k] & np.uint64(0xFFFFFFFF))) * _FACTORS[k] + upper, bounds[full])
                        sketch[full, k] = H.mix(least.astype(np.uint64)).astype(np.uint8)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(row, n),
                        pa.array(count),
                        pa.array(low.view(np.int64)),
                        pa.array(high.view(np.int64)),
                        pa.array([x.tobytes() for x in np.hstack((sketch, classes[:, ::2] << 4 | classes[:, 1::2]))], pa.binary()),
                    ],
                    ["doc_id", "n_shingles", "low", "high", "sketch"],
                )

    return run


def _keys(sketch: np.ndarray) -> np.ndarray:
    """The keys of each sketch, BANDS of the first collection and BANDS of the second; more are not used."""
    return np.ascontiguousarray(sketch[:, :SKETCH]).view(np.uint32).astype(np.uint64)


def _first_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One narrow row per class and key of the first collection."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        sketch = np.frombuffer(b"".join(batch.column("sketch").to_pylist()), np.uint8).reshape(n, WIDE)
        keys = _keys(sketch)[:, :BANDS]
        for i in range(BANDS):
            key = H.mix(keys[:, i] * np.uint64(64) + np.uint64(i))
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(np.full(n, i, np.int32)), batch.column("id")], ["key", "band", "id"])


class _Rows:
    """Members of buckets as arrays, sorted by bucket; ``own`` is the component of each."""

    def __init__(self, cell, ids, size, own, sketch):
        self.cell, self.ids, self.size, self.own, self.sketch = cell, ids, size, own, sketch

    @classmethod
    def of(cls, batch: pa.RecordBatch) -> _Rows:
        key, block = (batch.column(c).to_numpy().astype(np.int64).view(np.uint64) for c in ("key", "block"))
        arrays = [batch.column(c).to_numpy() for c in ("id", "n_shingles", "own")]
        return cls(H.mix(key ^ H.mix(block)), *arrays, np.frombuffer(b"".join(batch.column("sketch").to_pylist()), np.uint8).reshape(batch.num_rows, WIDE))

    def take(self, at) -> _Rows:
        return _Rows(*(x[at] for x in (self.cell, self.ids, self.size, self.own, self.sketch)))

    @staticmethod
    def join(parts: list[_Rows]) -> _Rows:
        return _Rows(*(np.concatenate([getattr(p, c) for p in parts]) for c in ("cell", "ids", "size", "own", "sketch")))

    def runs(self) -> np.ndarray:
        """Size of each row's bucket."""
        cuts = np.flatnonzero(np.concatenate(([True], self.cell[1:] != self.cell[:-1]))) if len(self.cell) else np.zeros(0, np.int64)
        length = np.diff(np.append(cuts, len(self.cell)))
        return np.repeat(length, length)


def _may_link(rows: _Rows, x: np.ndarray, y: np.ndarray, percent: int) -> np.ndarray:
    """False where the counts by class show that too few shingles can be common."""
    a, b = rows.sketch[x, SKETCH:], rows.sketch[y, SKETCH:]
    high, low = np.minimum(a >> 4, b >> 4), np.minimum(a & 15, b & 15)
    most = high.sum(axis=1, dtype=np.int64) + low.sum(axis=1, dtype=np.int64)
    unknown = (high == 15).any(axis=1) | (low == 15).any(axis=1)  # a class that is full in both
    return unknown | (100 * most >= percent * (rows.size[x] + rows.size[y] - most))


def _least(percent: int) -> float:
    """Equal places of two sketches below which a pair is no link: six standard errors under the threshold."""
    share = percent / 100
    return SKETCH * (share - 6 * (share * (1 - share) / SKETCH) ** 0.5)


def _candidates(rows: _Rows, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of pairs of one bucket, but not of one component, that share a table key and whose sketches don't rule out a link."""
    least, found = _least(percent), [(np.zeros(0, np.int64),) * 3]
    seconds = _keys(rows.sketch)[:, BANDS : 2 * BANDS]
    for d in range(1, int(rows.runs().max(initial=1))):
        x = np.flatnonzero((rows.cell[d:] == rows.cell[:-d]) & (rows.own[d:] != rows.own[:-d]))
        low, high = np.minimum(rows.size[x], rows.size[x + d]), np.maximum(rows.size[x], rows.size[x + d])
        x = x[100 * low >= percent * high]
        if len(x):
            x = x[(seconds[x] == seconds[x + d]).any(axis=1)]
            equal = (rows.sketch[x, :SKETCH] == rows.sketch[x + d, :SKETCH]).sum(axis=1)
            x, equal = x[equal >= least], equal[equal >= least]
            fits = _may_link(rows, x, x + d, percent)
            found.append((x[fits], x[fits] + d, equal[fits]))
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def spanning_forest(of: np.ndarray, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Places of the edges (x, y) of a heaviest forest over nodes whose parts ``of`` are joined already."""
    order = np.argsort(-weight, kind="stable")
    x, y, of, chosen = x[order], y[order], of.copy(), []
    left = np.arange(len(x))
    while True:
        a, b = of[x[left]], of[y[left]]
        left, a, b = left[a != b], a[a != b], b[a != b]
        if not len(left):
            return order[np.unique(np.concatenate(chosen))] if chosen else np.zeros(0, np.int64)
        # every part takes its heaviest edge; the order has no ties, so that only pairs of parts can choose each other
        best = np.full(int(of.max()) + 1, len(x))
        np.minimum.at(best, a, left)
        np.minimum.at(best, b, left)
        parts = np.flatnonzero(best < len(x))
        edge = best[parts]
        ends = of[x[edge]]
        up = np.arange(len(best))
        up[parts] = np.where(ends == parts, of[y[edge]], ends)
        up[parts] = np.where((up[up[parts]] == parts) & (parts < up[parts]), parts, up[parts])
        while (higher := up[up])[parts].tolist() != up[parts].tolist():
            up = higher
        chosen.append(edge)
        of = up[of]


def _pairs(percent: int, forest: bool):
    """Over rows sorted by key and block: pairs to look at, all of them or a forest of the likeliest."""

    def compared(rows: _Rows) -> Iterator[pa.RecordBatch]:
        x, y, equal = _candidates(rows, percent)
        if forest:
            _, of = np.unique(np.stack((rows.cell.view(np.int64), rows.own), axis=1), axis=0, return_inverse=True)
            kept = spanning_forest(of.ravel(), x, y, equal)
            x, y = x[kept], y[kept]
        a, b = rows.ids[x], rows.ids[y]
        both = np.unique(np.stack((np.minimum(a, b), np.maximum(a, b)), axis=1), axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[_Rows] = []

        def parts(rows: _Rows) -> Iterator[pa.RecordBatch]:
            large = rows.runs() > SMALL
            yield from compared(rows.take(~large))
            for cell in np.unique(rows.cell[large]):
                yield from compared(rows.take(rows.cell == cell))

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = _Rows.of(batch)
            if held and held[-1].cell[-1] == rows.cell[-1]:
                held.append(rows)  # one bucket goes on
                continue
            rows = _Rows.join([*held, rows])
            last = rows.cell == rows.cell[-1]
            yield from parts(rows.take(~last))
            held = [rows.take(last)]
        if held:
            yield from parts(_Rows.join(held))

    return run


def _sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, hashes, bounds in _shingles(batch.column("text"), words):
                n = len(bounds) - 1
                sets = [np.unique(hashes[bounds[k] : bounds[k + 1]]).tobytes() for k in range(n)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(row, n), pa.array(sets, pa.binary())], ["id", "shingles"])

    return run


def _confirm(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for k, (x, y) in enumerate(zip(batch.column("set_a"), batch.column("set_b"), strict=True)):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                joined = np.concatenate((x, y))
                joined.sort(kind="stable")
                common = int((joined[1:] == joined[:-1]).sum())
                keep[k] = 100 * common >= percent * (len(x) + len(y) - common)
            mask = pa.array(keep)
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(mask), batch.column("b").filter(mask)], ["a", "b"])

    return run


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 85) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs`` (doc_id, text).

    Linked are texts whose sets of ``words``-word shingles (A-Z lower-cased) have 100 * intersection >=
    ``percent`` * union; a component is closed over links. Texts with the same set are always one component.
    Null and wordless texts have no shingles and stand alone. Repeated rows with one doc_id get equal results.
    Rows without a doc_id count as copies of what they equal but never give a component its id.
    Other columns are ignored.
    """
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sketches = stage(plain.mapInArrow(_sketches(words), "doc_id long, n_shingles long, low long, high long, sketch binary"), "sketches")
    same = ["n_shingles", "low", "high"]
    classes = stage(
        sketches.where("n_shingles > 0 and doc_id is not null").groupBy(*same).agg(F.min_by("sketch", "doc_id").alias("sketch"), F.min("doc_id").alias("id")), "classes"
    )
    firsts = classes.select("id", "sketch").mapInArrow(_first_keys, "key long, band int, id long")
    # only keys that two classes share are buckets
    shared = firsts.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    members = stage(firsts.join(shared.hint("merge"), "key"), "members")
    sets = _set_table(plain, members.select(F.col("id").alias("doc_id")), words)
    described = classes.select("id", "n_shingles", "sketch")
    links = labels = None
    for bands, forest in ((FIRST_BANDS, True), (BANDS, True), (BANDS, False)):
        pairs = _open_pairs(members.where(F.col("band") < bands), described, labels, percent, forest)
        found = _linked(sets, pairs, percent)
        links = found if links is None else links.union(found)
        labels = stage(components(links), "components")
    classes = classes.select(*same, "id").join(labels, "id", "left").select(*same, F.coalesce("component", "id").alias("component_id"))
    own = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return (
        sketches.select("doc_id", *same)
        .join(classes, same, "left")
        .select("doc_id", "n_shingles", own.alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))
    )


def _open_pairs(members: DataFrame, described: DataFrame, labels: DataFrame | None, percent: int, forest: bool) -> DataFrame:
    """(a, b): pairs to look at in buckets whose members lie in more than one component.

    A bucket of more than HELD members is dealt out in blocks. Forests are those of the blocks. For all pairs, the members
    outside the bucket's largest component go to every block and so meet all others; those of that component need not
    meet each other.
    """
    placed = members.withColumn("own", F.col("id"))
    if labels is not None:
        placed = members.join(labels, "id", "left").select("key", "n", "id", F.coalesce("component", "id").alias("own"))
        sizes = placed.groupBy("key", "own").agg(F.count("*").alias("k"))
        mixed = sizes.groupBy("key").agg(F.max_by("own", F.struct("k", "own")).alias("largest"), F.count("*").alias("parts")).where("parts > 1")
        placed = placed.join(mixed.select("key", "largest").hint("merge"), "key")
    else:
        placed = placed.withColumn("largest", F.lit(None).cast("long"))
    blocks = F.ceil(F.col("n") / F.lit(HELD)).cast("int")
    at = F.pmod(F.xxhash64("key", "id"), blocks).cast("int")
    block = F.array(at) if forest else F.when((blocks > 1) & (F.col("own") != F.col("largest")), F.sequence(F.lit(0), blocks - 1)).otherwise(F.array(at))
    rows = placed.select("key", "id", "own", F.explode(block).alias("block")).join(described, "id")
    dealt = rows.repartition("key", "block").sortWithinPartitions("key", "block", "n_shingles", "id")
    return stage(dealt.mapInArrow(_pairs(percent, forest), "a long, b long").distinct(), "pairs")


def _set_table(plain: DataFrame, ids: DataFrame, words: int) -> DataFrame:
    """The full shingle sets of the given ids. Texts move once, at every size, so that cost grows evenly."""
    needed = plain.join(ids.distinct().hint("merge"), "doc_id", "left_semi").mapInArrow(_sets(words), "id long, shingles binary")
    # repeated rows of an id have the same set only if their texts are alike: take the one that stands for the id
    return stage(needed.groupBy("id").agg(F.min("shingles").alias("shingles")), "sets")


def _linked(sets: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets are alike enough."""
    a = sets.select(F.col("id").alias("a"), F.col("shingles").alias("set_a"))
    b = sets.select(F.col("id").alias("b"), F.col("shingles").alias("set_b"))
    return stage(pairs.join(a.hint("merge"), "a").join(b.hint("merge"), "b").mapInArrow(_confirm(percent), "a long, b long"), "confirmed")


