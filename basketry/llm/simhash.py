"""Near duplicates by SimHash, joined through Gray-order hierarchical indexes.

Two fingerprints with at most ``bits`` differing bits agree on one of bits + 1 segments, so each distinct fingerprint goes
to one bucket per segment. A bucket that is too large for a task is dealt out again by segments of the bits that its
members do not yet share, for the same reason without loss, as often as it takes.

In a bucket fingerprints are sorted by Gray rank, in which neighbours tend to differ little. Runs of neighbours form the
leaves of a tree; a node's mask holds the bits on which all below it agree, less those that its parent has already, and
its pattern their values. A search goes down level by level for many fingerprints at once, adds up the differences under
the masks, and leaves a group when the sum is too large, or when its members already are in the fingerprint's component.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketry.llm.components import components
from basketry.session import stage

BITS = 4
#: Fingerprints of a node on the level above; of a bucket that one task joins; searched at a time.
FANOUT, HELD, CHUNK = 16, 8192, 512
#: Hashes whose bits are counted at a time.
_COUNTED = 1 << 16


def fingerprint(text: bytes, words: int = 4) -> int:
    """SimHash of a text's ``words``-word shingles, A-Z lower-cased, repeats included; zero without words."""
    parts = text.lower().split()
    if not parts:
        return 0
    joined = b" ".join(parts)
    lengths = np.fromiter(map(len, parts), np.int64, len(parts))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    n = max(len(parts) - words + 1, 1)
    ends = ends[min(words, len(parts)) - 1 :]
    digest = xxhash.xxh64_intdigest
    counts = np.zeros(64, np.int64)
    for at in range(0, n, _COUNTED):
        spans = zip(starts[at : min(at + _COUNTED, n)].tolist(), ends[at : at + _COUNTED].tolist())
        hashes = np.array([digest(joined[a:b], 42) for a, b in spans], np.uint64)
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.uint64)[0])


def _fingerprints(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # one text at a time; Spark's strings are UTF-8 bytes
            column = batch.column("text").cast(pa.binary())
            values = np.array([fingerprint(x.as_buffer().to_pybytes() if x.is_valid else b"", words) for x in column], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(values.view(np.int64))], ["doc_id", "fp"])

    return run


def gray_rank(fp: Column) -> Column:
    """Place of a 64-bit pattern in the reflected Gray code, as a signed long with the unsigned order."""
    for shift in (1, 2, 4, 8, 16, 32):
        fp = fp.bitwiseXOR(F.shiftrightunsigned(fp, shift))
    return fp.bitwiseXOR(F.lit(-(1 << 63)))


def _popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x).astype(np.int16)


class GrayIndex:
    """Levels of (mask, pattern) over fingerprints in Gray order, from single ones up to few groups."""

    def __init__(self, fps: np.ndarray, fanout: int = 0):
        fanout = fanout or FANOUT
        self.fps, self.fanout = fps, fanout
        both, either = [fps], [fps]
        while len(both[-1]) > fanout:
            cuts = np.arange(0, len(both[-1]), fanout)
            both.append(np.bitwise_and.reduceat(both[-1], cuts))
            either.append(np.bitwise_or.reduceat(either[-1], cuts))
        # bits on which all members agree, from the top: what the level above has is taken out below
        self.levels, above = [], None
        for low, high in zip(reversed(both), reversed(either), strict=True):
            agreed = ~(low ^ high)
            own = agreed if above is None else agreed & ~np.repeat(above, fanout)[: len(agreed)]
            self.levels.append((own, low & own))
            above = agreed

    def labels(self, of: np.ndarray) -> list[np.ndarray]:
        """Per level, the component that all members of a node are in, or -1."""
        low, high = [of], [of]
        while len(low[-1]) > self.fanout:
            cuts = np.arange(0, len(low[-1]), self.fanout)
            low.append(np.minimum.reduceat(low[-1], cuts))
            high.append(np.maximum.reduceat(high[-1], cuts))
        return [np.where(a == b, a, -1) for a, b in zip(reversed(low), reversed(high), strict=True)]

    def search(self, queries: np.ndarray, bits: int, labels: list[np.ndarray] | None = None, own: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(query, fingerprint) places with at most ``bits`` differing bits; components given, only across them."""
        mask, pattern = self.levels[0]
        query = np.repeat(np.arange(len(queries)), len(mask))
        node = np.tile(np.arange(len(mask)), len(queries))
        total = np.zeros(len(node), np.int16)
        for level, (mask, pattern) in enumerate(self.levels):
            if level:
                child = node[:, None] * self.fanout + np.arange(self.fanout)
                there = child < len(mask)
                query, total = (np.repeat(x, self.fanout).reshape(child.shape)[there] for x in (query, total))
                node = child[there]
            total = total + _popcount((queries[query] ^ pattern[node]) & mask[node])
            keep = total <= bits
            if labels is not None:
                keep &= labels[level][node] != own[query]
            query, node, total = query[keep], node[keep], total[keep]
        return query, node


class _Parts:
    """Components of places in a bucket."""

    def __init__(self, n: int):
        self.of = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Adds links; gives back those that joined two parts."""
        up = {}

        def root(x: int) -> int:
            while x in up:
                x = up[x]
            return x

        kept = []
        for k, (x, y) in enumerate(zip(self.of[a].tolist(), self.of[b].tolist(), strict=True)):
            x, y = root(x), root(y)
            if x != y:
                up[max(x, y)] = min(x, y)
                kept.append(k)
        if up:
            moved = np.arange(len(self.of))
            for x in up:
                moved[x] = root(x)
            self.of = moved[self.of]
        return a[kept], b[kept]


def joined(fps: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what pairs of at most ``bits`` differing bits connect: fewer than there are fingerprints.

    ``fps`` are distinct and in Gray order. Every pair is compared or passed over because it is connected already or
    because a group's shared bits differ too much.
    """
    parts, links = _Parts(len(fps)), [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for d in range(1, min(9, len(fps))):  # neighbours first, so that dense groups are one part early
        at = np.flatnonzero(_popcount(fps[d:] ^ fps[:-d]) <= bits)
        links.append(parts.join(at, at + d))
    if len(fps) > 9:
        index = GrayIndex(fps)
        for at in range(0, len(fps), CHUNK):
            own = parts.of[at : at + CHUNK]
            query, place = index.search(fps[at : at + CHUNK], bits, index.labels(parts.of), own)
            before = place < query + at
            links.append(parts.join(query[before] + at, place[before]))
    return np.concatenate([a for a, _ in links]), np.concatenate([b for _, b in links])


def _segments(free: np.ndarray, parts: int) -> list[np.ndarray]:
    """The given bit places in ``parts`` runs, as even as they go."""
    return [x for x in np.array_split(free, parts) if len(x)]


def _dealt(bits: int):
    """A row for each segment of a fingerprint's bits that its bucket has not fixed yet.

    ``fixed`` is the mask of bits that the bucket's members share, ``key`` their value and the way it was reached.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps, fixed, keys = (batch.column(c).to_numpy().view(np.uint64) for c in ("fp", "fixed", "key"))
            for mask in np.unique(fixed):
                own = np.flatnonzero(fixed == mask)
                free = np.array([b for b in range(64) if not int(mask) >> b & 1])
                for k, places in enumerate(_segments(free, bits + 1)):
                    part = np.uint64(sum(1 << int(p) for p in places))
                    with np.errstate(over="ignore"):
                        key = (keys[own] ^ (fps[own] & part)) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(k + 1)
                        key ^= key >> np.uint64(29)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(x.view(np.int64)) for x in (fps[own], np.full(len(own), mask | part), key)], ["fp", "fixed", "key"]
                    )

    return run


def _buckets(bits: int, held: int):
    """Over rows sorted by bucket and Gray rank: links, and the rows of buckets that are too large."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(a, b, fixed=None, key=None) -> pa.RecordBatch:
            n = len(a)
            more = [pa.nulls(n, pa.int64())] * 2 if fixed is None else [pa.array(np.full(n, fixed)), pa.array(np.full(n, key))]
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64)) if b is not None else pa.nulls(n, pa.int64()), *more], ["a", "b", "fixed", "key"])

        parts: list[np.ndarray] = []
        last, size, passing = None, 0, False
        found_a, found_b, waiting = [], [], 0

        def close():
            nonlocal waiting
            fps = np.concatenate(parts).view(np.uint64)
            if len(fps) > 1:
                a, b = joined(fps, bits)
                if len(a):
                    found_a.append(fps[a])
                    found_b.append(fps[b])
                    waiting += len(a)

        for batch in batches:
            fps, fixed, keys = (batch.column(c).to_numpy() for c in ("fp", "fixed", "key"))
            if not len(fps):
                continue
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]) | (fixed[1:] != fixed[:-1])) + 1), len(fps)]
            for x, y in zip(cuts, cuts[1:]):
                if (own := (int(fixed[x]), int(keys[x]))) != last:
                    if parts:
                        close()
                    parts, last, size, passing = [], own, 0, False
                parts.append(fps[x:y])
                size += y - x
                if passing or size > held:
                    for part in parts:
                        yield rows(part, None, *own)
                    parts, passing = [], True
            if waiting > 1 << 16:
                yield rows(np.concatenate(found_a), np.concatenate(found_b))
                found_a.clear(), found_b.clear()
                waiting = 0
        if parts:
            close()
        if found_a:
            yield rows(np.concatenate(found_a), np.concatenate(found_b))

    return run


def linked(fps: DataFrame, bits: int = BITS) -> DataFrame:
    """(a, b): links between the distinct fingerprints of ``fps`` (fp long) that connect all pairs of at most ``bits`` differing bits."""
    if not 0 <= bits < 63:
        raise ValueError("bits must lie in 0 to 62")
    rows = fps.select("fp", F.lit(0).cast("long").alias("fixed"), F.lit(0).cast("long").alias("key"))
    links = None
    while True:
        dealt = rows.mapInArrow(_dealt(bits), "fp long, fixed long, key long")
        sorted_rows = dealt.repartition("fixed", "key").sortWithinPartitions("fixed", "key", gray_rank(F.col("fp")))
        # a bucket with f free bits has at most 2**f members, so one of more has bits + 1 free bits to be dealt out by
        held = max(HELD, 1 << (bits + 1))
        out = stage(sorted_rows.mapInArrow(_buckets(bits, held), "a long, b long, fixed long, key long"), "buckets")
        own = out.where("b is not null").select("a", "b")
        links = own if links is None else links.union(own)
        rows = out.where("b is null").select(F.col("a").alias("fp"), "fixed", "key")
        # with every depth a bucket's members share more bits; with all 64 there is one fingerprint
        if rows.limit(1).count() == 0:
            return links


def simhash_duplicates(docs: DataFrame, words: int = 4, bits: int = BITS) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of ``docs`` (doc_id, text).

    The fingerprint has 16 lowercase hex digits. Rows are linked when their fingerprints differ in at most ``bits`` bits;
    component_id is the smallest doc_id that links reach, the row's own included. Null, empty and wordless texts have the
    fingerprint zero and are linked like any other. Rows without a doc_id take part but never give a component its id (a
    component of such rows alone has a null one); repeated rows are rows each. An empty table gives no rows, other
    columns are ignored. A task's memory follows the longest single text, of which it holds about 20 bytes a byte.
    """
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    prints = stage(plain.mapInArrow(_fingerprints(words), "doc_id long, fp long"), "fingerprints")
    classes = stage(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "classes")
    labels = components(linked(classes.select("fp"), bits)).select(F.col("id").alias("fp"), "component")
    placed = classes.join(labels, "fp", "left").select("fp", "first", F.coalesce("component", "fp").alias("component"))
    placed = stage(placed, "placed")
    firsts = placed.groupBy("component").agg(F.min("first").alias("component_id"))
    ids = placed.join(firsts, "component").select("fp", "component_id")
    return prints.join(ids, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
