"""Removal of repeated byte strings by a sparse suffix sort with hash-compared suffixes.

Every window of ``length`` bytes picks the GRAM-byte string in it with the least hash (leftmost among equals), its
anchor; equal windows pick the same place in themselves. Consecutive windows with one anchor are a run, and the bytes
they span its context. Runs are dealt out by their anchor's hash, equal contexts are counted where they are made,
and only anchors with several different contexts go on. There the contexts' suffixes from the anchor on are merge
sorted; a comparison finds the common extension by binary search over prefix polynomial hashes. Neighbours whose
extension is long enough are compared window by window.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.llm import hashing as H
from basketry.session import stage

GRAM = 100
#: Text of an anchor's contexts that a task sorts at once; the windows of larger groups are counted by Spark.
HELD_BYTES = 16 << 20
#: Rows of a join side that may be sent to every executor (about 100 bytes each); beyond, both sides are shuffled.
BROADCAST_ROWS = 200_000


def _sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """Minima of all windows of ``width``."""
    blocks = -(-len(x) // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(x)] = x
    square = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(square, axis=1).ravel()
    back = np.minimum.accumulate(square[:, ::-1], axis=1)[:, ::-1].ravel()
    n = len(x) - width + 1
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


def _runs(length: int):
    """(anchor, context, doc_id, text_hash, first, last, at): hashes of anchor and context, windows and anchor's place."""
    width = length - GRAM + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, data, offsets in H.slices(batch.column("text"), 2 << 20):
                counts = np.maximum(np.diff(offsets) - length + 1, 0)
                if not counts.any():
                    continue
                sums = H.prefix(data)
                inverse = H.powers(len(sums), H.BASE_INVERSE)
                grams = H.mix((sums[GRAM:] - sums[:-GRAM]) * inverse[: len(sums) - GRAM])
                packed = (grams & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64)
                anchor = (_sliding_least(packed, width) & np.uint64(0xFFFFFFFF)).astype(np.int64)
                rows = np.repeat(np.arange(len(counts)), counts)
                begin = np.cumsum(counts) - counts
                window = np.arange(len(rows)) + np.repeat(offsets[:-1] - begin, counts)
                anchor = anchor[window]
                cut = np.flatnonzero(np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (rows[1:] != rows[:-1]))))
                stop = np.append(cut[1:], len(rows)) - 1
                first, last, at, rows = window[cut], window[stop], anchor[cut], rows[cut]
                context = H.mix(H.span_hash(sums, first, last + length) + H.mix((at - first).astype(np.uint64)))
                base = offsets[rows]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(grams[at].view(np.int64)), pa.array(context.view(np.int64))]
                    + [batch.column(c).slice(row, len(counts)).take(pa.array(rows)) for c in ("doc_id", "text_hash")]
                    + [pa.array(x - base) for x in (first, last, at)],
                    ["anchor", "context", "doc_id", "text_hash", "first", "last", "at"],
                )

    return run


def _contexts(length: int):
    """The bytes of the runs listed with each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = {c: [] for c in ("anchor", "context", "offset", "windows", "copies", "bytes")}
            for text, runs in zip(batch.column("text"), batch.column("runs"), strict=True):
                body = (text.as_py() or "").encode()
                for x in runs.as_py():
                    out["anchor"].append(x["anchor"])
                    out["context"].append(x["context"])
                    out["offset"].append(x["at"] - x["first"])
                    out["windows"].append(x["last"] - x["first"] + 1)
                    out["copies"].append(x["copies"])
                    out["bytes"].append(body[x["first"] : x["last"] + length])
            yield pa.RecordBatch.from_arrays(
                [pa.array(v, pa.binary() if c == "bytes" else pa.int64()) for c, v in out.items()], list(out)
            )

    return run


class _Suffixes:
    """Suffixes of one byte buffer, compared by the hashes of their parts."""

    def __init__(self, data: np.ndarray, start: np.ndarray, end: np.ndarray):
        self.data, self.start, self.end = data, start, end
        self.sums = H.prefix(data)
        self.inverse = H.powers(len(self.sums), H.BASE_INVERSE)

    def common(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Length of the common extension of suffixes x and y: binary search by hash, then checked on the bytes."""
        a, b = self.start[x], self.start[y]
        most = np.minimum(self.end[x] - a, self.end[y] - b)
        found = np.zeros(len(a), np.int64)
        step = 1 << max(0, int(most.max(initial=0)).bit_length() - 1)
        while step:
            fits = found + step <= most
            i, j = np.where(fits, a + found, 0), np.where(fits, b + found, 0)
            reach_i, reach_j = np.where(fits, i + step, 0), np.where(fits, j + step, 0)
            same = (self.sums[reach_i] - self.sums[i]) * self.inverse[i] == (self.sums[reach_j] - self.sums[j]) * self.inverse[j]
            found += np.where(fits & same, step, 0)
            step >>= 1
        return found

    def checked(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """common(), each made sure of by comparing the bytes."""
        found = self.common(x, y)
        for k in np.flatnonzero(found):
            a, b, n = self.start[x[k]], self.start[y[k]], found[k]
            differ = np.flatnonzero(self.data[a : a + n] != self.data[b : b + n])
            if len(differ):  # a hash collision
                found[k] = differ[0]
        return found

    def less(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Whether suffix x comes strictly before suffix y."""
        n = self.common(x, y)
        a, b = self.start[x] + n, self.start[y] + n
        over_x, over_y = a >= self.end[x], b >= self.end[y]
        last = len(self.data) - 1
        return np.where(over_x | over_y, over_x & ~over_y, self.data[np.minimum(a, last)] < self.data[np.minimum(b, last)])

    def sort(self, group: np.ndarray) -> np.ndarray:
        """Order by group (already ascending), then by suffix: a bottom-up merge sort over all groups at once."""
        order = np.arange(len(group))
        first = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
        size = np.diff(np.append(first, len(group)))
        base, count = np.repeat(first, size), np.repeat(size, size)
        within = np.arange(len(group)) - base
        width = 1
        while width < size.max():
            run = within // width
            other = np.where(run % 2 == 0, (run + 1) * width, (run - 1) * width)
            low = np.minimum(other, count)
            high = np.minimum(low + width, count)
            begin = low.copy()
            right = run % 2 == 1  # an equal suffix of the left run goes first
            while (open_ := low < high).any():
                at = np.flatnonzero(open_)
                mid = (low[at] + high[at]) // 2
                mine, theirs = order[at], order[base[at] + mid]
                before = np.where(right[at], ~self.less(mine, theirs), self.less(theirs, mine))
                low[at] = np.where(before, mid + 1, low[at])
                high[at] = np.where(before, high[at], mid)
            pair = run // 2 * 2 * width
            to = base + pair + (within - run * width) + (low - begin)
            merged = np.empty_like(order)
            merged[to] = order
            order = merged
            width *= 2
        return order


def _ranges(length: int):
    """Over contexts sorted by anchor: (anchor, context, near, far), windows that occur elsewhere by their distance to the anchor."""

    def decide(rows: list[tuple]) -> tuple[np.ndarray, ...]:
        group, context, offset, windows, copies = (np.array(x, np.int64) for x in list(zip(*rows, strict=True))[:5])
        bodies = [r[5] for r in rows]
        sizes = np.array([len(b) for b in bodies])
        data = np.frombuffer(b"".join(bodies), np.uint8)
        begin = np.cumsum(sizes) - sizes
        suffixes = _Suffixes(data, begin + offset, begin + sizes)
        order = suffixes.sort(group)
        same = group[order][1:] == group[order][:-1]
        x, y = order[:-1][same], order[1:][same]
        reach = suffixes.checked(x, y)
        # a common window that starts d before the anchor needs an extension of length - d at least
        rows_in = np.zeros(len(rows), bool)
        for end in (x, y):
            rows_in[end[reach >= length - offset[end]]] = True
        at = np.flatnonzero(rows_in)
        n = windows[at]
        owner = np.repeat(at, n)
        step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        start = begin[owner] + step
        whole = H.span_hash(suffixes.sums, start, start + length)
        distance = offset[owner] - step
        key = H.mix(whole + H.mix(distance.astype(np.uint64) + H.mix(group[owner].view(np.uint64))))
        by = np.argsort(key, kind="stable")
        equal = key[by][1:] == key[by][:-1]
        twice = np.zeros(len(key), bool)
        twice[by[1:][equal]] = True
        twice[by[:-1][equal]] = True
        hit = twice & (copies[owner] == 1)
        owner, distance = owner[hit], distance[hit]
        cut = np.flatnonzero(np.concatenate(([True], (owner[1:] != owner[:-1]) | (distance[1:] != distance[:-1] - 1)))) if len(owner) else np.zeros(0, np.int64)
        stop = np.append(cut[1:], len(owner)) - 1 if len(cut) else cut
        return group[owner[cut]], context[owner[cut]], distance[stop], distance[cut]

    def batch_of(arrays) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(a) for a in arrays] + [pa.nulls(len(arrays[0]), pa.int64())] * 2, ["anchor", "context", "near", "far", "low", "high"])

    def spelled(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        """A row for each window of a group too large for one task, with two hashes of its bytes."""
        for anchor, context, offset, windows, copies, body in rows:
            data = np.frombuffer(body, np.uint8)
            start = np.arange(windows)
            low, high = (H.span_hash(H.prefix(d), start, start + length) for d in (data, 255 - data))
            distance = offset - start
            fixed = [np.full(windows, v) for v in (anchor, context if copies == 1 else 0)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(x) for x in (*fixed, distance, distance, low.view(np.int64), high.view(np.int64))], ["anchor", "context", "near", "far", "low", "high"]
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, held_bytes, group, group_bytes, passing = [], 0, [], 0, None
        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in range(batch.num_columns)), strict=True):
                if row[0] == passing:
                    yield from spelled([row])
                    continue
                if group and row[0] != group[0][0]:
                    held, held_bytes = held + group if len(group) > 1 else held, held_bytes + group_bytes
                    group, group_bytes = [], 0
                    if held_bytes > HELD_BYTES // 4 and held:
                        yield batch_of(decide(held))
                        held, held_bytes = [], 0
                group.append(row)
                group_bytes += len(row[5])
                if group_bytes > HELD_BYTES:
                    passing = row[0]
                    yield from spelled(group)
                    group, group_bytes = [], 0
        held += group if len(group) > 1 else []
        if held:
            yield batch_of(decide(held))

    return run


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for text, spans in zip(batch.column("text"), batch.column("spans"), strict=True):
            body = (text.as_py() or "").encode()
            digest, at, removed, runs, end = hashlib.sha256(), 0, 0, 0, -1
            for x in spans.as_py() or ():
                if x["start"] > end:
                    digest.update(body[at : x["start"]])
                    runs, removed = runs + 1, removed + x["stop"] - x["start"]
                else:
                    removed += max(0, x["stop"] - end)
                at = end = max(end, x["stop"])
            digest.update(body[at:])
            out.append((len(body), removed, runs, digest.hexdigest()))
        columns = list(zip(*out, strict=True)) or [()] * 4
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3], pa.string()), batch.column("spans")],
            ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"],
        )


def _fitting(df: DataFrame) -> DataFrame:
    """A staged join side, sent to every executor only if its counted rows are few."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def repeated_spans(docs: DataFrame, length: int = 400) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): n_bytes, n_removed, n_spans, kept_sha256 and the spans.

    Removed is every UTF-8 byte covered by a ``length``-byte string that starts at another place too, in the same or
    another text; overlaps count and texts are not joined. Null and empty texts, and those shorter than ``length``,
    lose nothing. Exact copies (repeated rows too) lose everything if they have ``length`` bytes. A null doc_id is
    kept as it is. Other columns are ignored. A task's memory follows its longest text.
    """
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash"))
    runs = stage(
        keyed.where(F.octet_length("text") >= length).mapInArrow(_runs(length), "anchor long, context long, doc_id long, text_hash long, first long, last long, at long"), "runs"
    )
    place = F.struct("doc_id", "text_hash", "first", "last", "at")
    contexts = runs.groupBy("anchor", "context").agg(F.count("*").alias("copies"), F.min(place).alias("place"))
    contexts = stage(contexts, "contexts")
    several = contexts.groupBy("anchor").agg(F.count("*").alias("n"), F.max("copies").alias("most")).where("n > 1 or most > 1")
    several = stage(several, "anchors")
    texts = (
        contexts.join(several.where("n > 1"), "anchor")
        .groupBy("place.doc_id", "place.text_hash")
        .agg(F.collect_list(F.struct("anchor", "context", "copies", "place.first", "place.last", "place.at")).alias("runs"))
    )
    texts = _fitting(stage(texts, "lists"))
    # a repeated row gives its contexts twice, but those have copies anyhow
    bodies = keyed.join(texts, [keyed.doc_id.eqNullSafe(texts.doc_id), keyed.text_hash == texts.text_hash]).select("text", "runs")
    spread = bodies.mapInArrow(_contexts(length), "anchor long, context long, offset long, windows long, copies long, bytes binary")
    found = stage(
        spread.repartition("anchor").sortWithinPartitions("anchor", "context").mapInArrow(_ranges(length), "anchor long, context long, near long, far long, low long, high long"), "ranges"
    )
    wide = found.where("low is not null")
    again = wide.groupBy("anchor", "near", "low", "high").agg(F.count("*").alias("n")).where("n > 1")
    ranges = found.where("low is null").select("anchor", "context", "near", "far").union(
        wide.join(again, ["anchor", "near", "low", "high"], "left_semi").where("context <> 0").select("anchor", "context", "near", "far")
    )
    copied = contexts.where("copies > 1").select("anchor", "context", (F.col("place.at") - F.col("place.last")).alias("near"), (F.col("place.at") - F.col("place.first")).alias("far"))
    covered = (
        runs.join(ranges.union(copied), ["anchor", "context"])
        .groupBy("doc_id", "text_hash")
        .agg(F.array_sort(F.collect_set(F.struct((F.col("at") - F.col("far")).alias("start"), (F.col("at") - F.col("near") + length).alias("stop")))).alias("spans"))
    )
    covered = _fitting(stage(covered, "covered"))
    joined = keyed.join(covered, [keyed.doc_id.eqNullSafe(covered.doc_id), keyed.text_hash == covered.text_hash], "left").select(keyed.doc_id, "text", "spans")
    return joined.mapInArrow(
        _kept, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:long,stop:long>>"
    )
