"""Hard negatives by inner product: cover trees over norm-augmented candidates, searched best first.

A candidate x gets one more component, sqrt(M^2 - |x|^2) with M the largest norm, and a query one of zero. Inner products
stay what they are, all candidates lie on one sphere, and for a node with centre c and covering radius r both
|<q,x> - <q,c>| <= |q| r and the sphere's own inequality bound what its members can score.

The top level of the tree is a bounded set of centres; every row belongs to the cell of its nearest. A cell is dealt out
into blocks of rows, and a task builds the lower levels of a block: a net grown farthest first until it covers at half the
radius above, so centres of a level lie apart and their balls cover, down to leaves of a few rows. Queries meet the blocks
of the cells that can matter, first those of their own cell, whose scores then bound the search in the others.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from basketry.session import stage

#: Centres of the top level, from the rows with the least hashes of their ids: a documented, bounded sample. It decides
#: only how rows are grouped; every row is indexed and the result is exact whatever the centres.
CELLS, SAMPLE = 32, 2048
#: Rows of a block, children of a node, rows of a leaf, queries that a task holds at a time.
BLOCK, FANOUT, LEAF, HELD = 16384, 16, 64, 256
_FAR = 1 << 62
_TREE = "block long, kind int, size long, ids binary, labels binary, vectors binary, nodes binary, anchor long, copy long, label long, v array<long>, lows array<long>, highs array<long>, least array<long>"
_QUERY = ["anchor", "copy", "label", "v", "lows", "highs", "least"]
_FOUND = "anchor long, copy long, w int, score long, vec_id long, vec_copy long"
_NODE = np.dtype([("centre", np.int64), ("parent", np.int64), ("start", np.int64), ("end", np.int64), ("radius", np.float64), ("leaf", np.bool_)])


def _matrix(lists: pa.ListArray, width: int | None = None) -> np.ndarray:
    """Vectors as rows of a matrix; shorter ones are filled up with zeros."""
    lengths = np.diff(lists.offsets.to_numpy())
    values = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(lists), max(int(lengths.max(initial=0)), width or 0)), np.int64)
    row = np.repeat(np.arange(len(lists)), lengths)
    out[row, np.arange(len(values)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = values
    return out


def _norms2(x: np.ndarray) -> np.ndarray:
    return (x.astype(np.float64) ** 2).sum(axis=1)


def _scores(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows of x and the rows of q, as whole numbers."""
    width = min(x.shape[1], q.shape[1])
    x, q = x[:, :width], q[:, :width]
    bound = float(np.abs(x).max(initial=0)) * float(np.abs(q).max(initial=0)) * max(width, 1)
    if bound < 2**53:
        return (x.astype(np.float64) @ q.T.astype(np.float64)).astype(np.int64)
    if bound >= 2**63:
        raise OverflowError("inner products of these vectors do not fit 64 bits")
    return x.astype(np.int64) @ q.T.astype(np.int64)


def _augmented(x: np.ndarray, most2: float) -> np.ndarray:
    return np.column_stack((x.astype(np.float64), np.sqrt(np.maximum(most2 - _norms2(x), 0.0))))


def _distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.sqrt(((x - c) ** 2).sum(axis=1))


def net(points: np.ndarray, first: int, near: np.ndarray, enough: float, most: int) -> tuple[list[int], np.ndarray, np.ndarray]:
    """Centres chosen farthest first until ``enough`` covers all points or there are ``most``; each point's centre and distance."""
    centres, of, near = [first], np.zeros(len(points), np.int64), near.copy()
    while len(centres) < most:
        far = int(near.argmax())
        if near[far] <= enough:
            break
        apart = _distances(points, points[far])
        closer = apart < near
        closer[far] = True
        of[closer], near[closer] = len(centres), apart[closer]
        centres.append(far)
    return centres, of, near


def build(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order of the rows, nodes): a node's rows lie side by side in this order, and a parent stands before its children."""
    order, nodes = np.arange(len(points)), []
    start = _distances(points, points[0])
    queue = [(0, np.arange(len(points)), 0, start, -1)]
    for begin, rows, first, near, parent in queue:  # grows while it is read: level by level
        radius = float(near.max())
        leaf = len(rows) <= LEAF or radius == 0.0
        nodes.append([int(rows[first]), parent, begin, begin + len(rows), radius, leaf])
        order[begin : begin + len(rows)] = rows
        if leaf:
            continue
        centres, of, near = net(points[rows], first, near, radius / 2, FANOUT)
        at = begin
        for k, centre in enumerate(centres):
            own = np.flatnonzero(of == k)
            queue.append((at, rows[own], int(np.searchsorted(own, centre)), near[own], len(nodes) - 1))
            at += len(own)
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    table = np.array([tuple(n) for n in nodes], _NODE)
    table["centre"] = place[table["centre"]]
    return order, table


class _Tree:
    def __init__(self, row: dict, most2: float):
        self.ids = np.frombuffer(row["ids"], np.int64).reshape(-1, 2)
        self.labels = np.frombuffer(row["labels"], np.int64)
        self.vectors = np.frombuffer(row["vectors"], np.int64 if len(row["vectors"]) == 8 * row["size"] else np.int32 if len(row["vectors"]) == 4 * row["size"] else np.int16)
        self.vectors = self.vectors.reshape(len(self.ids), -1)
        self.nodes, self.most2 = np.frombuffer(row["nodes"], _NODE), most2
        self.leaves = np.flatnonzero(self.nodes["leaf"])

    def bounds(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and largest score that a node's rows can have, for nodes by queries."""
        return ball_bounds(_scores(self.vectors[self.nodes["centre"]], q), self.nodes["radius"], _norms2(q), self.most2)

    def search(self, labels, same, q, ids, lows, highs, least, k: int) -> list[np.ndarray]:
        """Per query the (window, score, row) of each window's first k rows here that reach its ``least``."""
        below, above = self.bounds(q)
        parent, found = self.nodes["parent"][1:], []
        for j in range(len(q)):
            low, high, kth = lows[j], highs[j], np.maximum(lows[j], least[j])
            if not len(low):
                found.append(np.zeros((0, 3), np.int64))
                continue
            # level by level: nodes outside all windows go with all below them
            alive = ((above[:, j, None] >= kth) & (below[:, j, None] <= high)).any(axis=1)
            while (lost := alive[1:] & ~alive[parent]).any():
                alive[1:][lost] = False
            leaves = self.leaves[alive[self.leaves]]
            leaves = leaves[np.argsort(-above[leaves, j], kind="stable")]
            rows, scores, at, step = np.zeros(0, np.int64), np.zeros(0, np.int64), 0, 2
            while at < len(leaves):
                some = leaves[at : at + step]
                at, step = at + step, 2 * step
                needed = ((above[some, j, None] >= kth) & (below[some, j, None] <= high)).any(axis=1)
                some = some[needed]
                if not len(some):
                    if not (above[leaves[at:], j, None] >= kth).any():
                        break
                    continue
                new = np.concatenate([np.arange(a, b) for a, b in zip(self.nodes["start"][some], self.nodes["end"][some])])
                fit = (self.labels[new] == labels[j]) == same
                fit &= (self.ids[new] != ids[j]).any(axis=1)
                new = new[fit]
                own = _scores(self.vectors[new], q[j : j + 1])[:, 0]
                useful = ((own[:, None] >= kth) & (own[:, None] <= high)).any(axis=1)
                rows, scores = np.concatenate((rows, new[useful])), np.concatenate((scores, own[useful]))
                kth = kth.copy()
                for w in range(len(low)):
                    inside = scores[(scores >= kth[w]) & (scores <= high[w])]
                    if len(inside) >= k:
                        kth[w] = max(kth[w], np.partition(inside, len(inside) - k)[len(inside) - k])
            out = []
            for w in range(len(low)):
                inside = np.flatnonzero((scores >= kth[w]) & (scores <= high[w]))
                best = inside[np.lexsort((self.ids[rows[inside], 1], self.ids[rows[inside], 0], -scores[inside]))[:k]]
                out.append(np.column_stack((np.full(len(best), w), scores[best], rows[best])))
            found.append(np.concatenate(out))
        return found


def ball_bounds(centre: np.ndarray, radius: np.ndarray, norm2: np.ndarray, most2: float) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of <q,x> for x within ``radius`` of a centre that scores ``centre`` (nodes x queries), rounded outwards."""
    r = radius[:, None] * (1 + 1e-9) + 1e-9 * math.sqrt(most2) * (radius[:, None] > 0)
    reach = np.sqrt(norm2)[None, :] * r
    both = norm2[None, :] + most2
    apart = np.sqrt(np.maximum(both - 2.0 * centre, 0.0))
    slack = 1e-9 * both + 1e-6
    above = np.minimum(centre + reach, (both - np.maximum(apart - r, 0.0) ** 2) / 2) + slack
    below = np.maximum(centre - reach, (both - (apart + r) ** 2) / 2) - slack
    return below, above


def _assigned(centres: np.ndarray, most2: float):
    """Each row's cell, and its distance from the cell's centre."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        points = _augmented(centres, most2)
        for batch in batches:
            x = _augmented(_matrix(batch.column("v"), centres.shape[1]), most2)
            cell, near = np.zeros(len(x), np.int32), np.full(len(x), np.inf)
            for k, c in enumerate(points):
                apart = _distances(x, c)
                cell[apart < near] = k
                near = np.minimum(near, apart)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(near)], [*batch.schema.names, "cell", "near"])

    return run


def _trees(most2: float):
    """Rows sorted by block become one row per block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def tree(block: int, held: list[pa.RecordBatch]) -> pa.RecordBatch:
            table = pa.Table.from_batches(held).combine_chunks()
            x = _matrix(table.column("v").combine_chunks())
            order, nodes = build(_augmented(x, most2))
            most = int(np.abs(x).max(initial=0))
            kind = np.int16 if most < 1 << 15 else np.int32 if most < 1 << 31 else np.int64
            ids = np.column_stack((table.column("vec_id").to_numpy(), table.column("copy").to_numpy()))[order]
            blobs = [ids.tobytes(), table.column("label").to_numpy()[order].tobytes(), x[order].astype(kind).tobytes(), nodes.tobytes()]
            return pa.RecordBatch.from_arrays(
                [pa.array([block]), pa.array([x.size]), *(pa.array([b], pa.binary()) for b in blobs)], ["block", "size", "ids", "labels", "vectors", "nodes"]
            )

        held, last = [], None
        for batch in batches:
            blocks = batch.column("block").to_numpy()
            if not len(blocks):
                continue
            cuts = [0, *(np.flatnonzero(blocks[1:] != blocks[:-1]) + 1), len(blocks)]
            for a, b in zip(cuts, cuts[1:]):
                if held and blocks[a] != last:
                    yield tree(last, held)
                    held = []
                held.append(batch.slice(a, b - a))
                last = int(blocks[a])
        if held:
            yield tree(last, held)

    return run


def _routed(centres: np.ndarray, cells: dict[int, tuple[float, int]], most2: float, home: bool):
    """A row for each block that a query has to see: those of its own cell, or of the others that can hold a result."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = np.array(sorted(cells))
        radius = np.array([cells[c][0] for c in numbers.tolist()])
        for batch in batches:
            if not batch.num_rows:
                continue
            q = _matrix(batch.column("v"), centres.shape[1])
            below, above = ball_bounds(_scores(centres[numbers], q), radius, _norms2(q), most2)
            rows, blocks = [], []
            for j, (own, lows, highs, least) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("cell", "lows", "highs", "least")), strict=True)):
                for n, cell in enumerate(numbers.tolist()):
                    if home == (cell == own) and any(above[n, j] >= max(a, c) and below[n, j] <= b for a, b, c in zip(lows, highs, least)):
                        rows += [j] * cells[cell][1]
                        blocks += [(cell << 32) + s for s in range(cells[cell][1])]
            taken = batch.take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.int64()), *(taken.column(c) for c in _QUERY)], ["block", *_QUERY])

    return run


def _searched(most2: float, same: bool, k: int):
    """Over each block's tree and then its queries: the rows that a query finds there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, block = None, None
        for batch in batches:
            kinds, blocks = batch.column("kind").to_numpy(), batch.column("block").to_numpy()
            at = 0
            while at < batch.num_rows:
                if kinds[at] == 0:
                    tree, block = _Tree(batch.slice(at, 1).to_pylist()[0], most2), blocks[at]
                    at += 1
                    continue
                stop = at
                while stop < batch.num_rows and kinds[stop] == 1 and blocks[stop] == blocks[at] and stop - at < HELD:
                    stop += 1
                part = batch.slice(at, stop - at)
                at = stop
                if block != part.column("block")[0].as_py():
                    continue  # a cell's block that got no row
                ids = np.column_stack((part.column("anchor").to_numpy(), part.column("copy").to_numpy()))
                lists = [[np.array(x, np.int64) for x in part.column(c).to_pylist()] for c in ("lows", "highs", "least")]
                found = tree.search(part.column("label").to_numpy(), same, _matrix(part.column("v"), tree.vectors.shape[1]), ids, *lists, k)
                row = np.repeat(np.arange(len(found)), [len(f) for f in found])
                hits = np.concatenate(found)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x) for x in (ids[row, 0], ids[row, 1], hits[:, 0].astype(np.int32), hits[:, 1], tree.ids[hits[:, 2], 0], tree.ids[hits[:, 2], 1])],
                    ["anchor", "copy", "w", "score", "vec_id", "vec_copy"],
                )

    return run


class CoverIndex:
    """Trees of all rows (vec_id, copy, label, v), staged, one row per block."""

    def __init__(self, rows: DataFrame):
        self.most2 = float(rows.select(F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))).first()[0] or 0.0)
        sample = rows.select("v").orderBy(F.xxhash64("vec_id"), "vec_id", "copy").limit(SAMPLE).collect()
        x = _matrix(pa.array([r.v for r in sample], pa.list_(pa.int64())))
        points = _augmented(x, self.most2)
        if len(points):
            chosen, _, _ = net(points, 0, _distances(points, points[0]), 0.0, CELLS)
            self.centres = x[chosen]
        else:
            self.centres = np.zeros((1, 0), np.int64)
        fields = "vec_id long, copy long, label long, v array<long>, cell int, near double"
        self.rows = stage(rows.select("vec_id", "copy", "label", "v").mapInArrow(_assigned(self.centres, self.most2), fields), "cells")
        counts = self.rows.groupBy("cell").agg(F.count("*").alias("n"), F.max("near").alias("radius")).collect()  # CELLS rows at most
        self.cells = {r.cell: (r.radius, math.ceil(r.n / BLOCK)) for r in counts}
        blocks = F.create_map(*[F.lit(x) for c, (_, n) in self.cells.items() for x in (c, n)]) if self.cells else F.create_map(F.lit(0), F.lit(1))
        block = F.col("cell").cast("long") * (1 << 32) + F.pmod(F.xxhash64("vec_id", "copy"), blocks[F.col("cell")].cast("long"))
        dealt = self.rows.select("vec_id", "copy", "label", "v", block.alias("block")).repartition("block").sortWithinPartitions("block")
        self.trees = stage(dealt.mapInArrow(_trees(self.most2), "block long, size long, ids binary, labels binary, vectors binary, nodes binary"), "trees")

    def _pass(self, queries: DataFrame, same: bool, k: int, home: bool) -> DataFrame:
        routed = queries.mapInArrow(_routed(self.centres, self.cells, self.most2, home), "block long, anchor long, copy long, label long, v array<long>, lows array<long>, highs array<long>, least array<long>")
        both = self.trees.withColumn("kind", F.lit(0)).unionByName(routed.withColumn("kind", F.lit(1)), allowMissingColumns=True)
        dealt = both.repartition("block").sortWithinPartitions("block", "kind")
        return stage(dealt.mapInArrow(_searched(self.most2, same, k), _FOUND), "found")

    def nearest(self, queries: DataFrame, same: bool, k: int) -> DataFrame:
        """The first k rows (score downwards, then vec_id) of each window of each query, with their rank from 1.

        ``queries``: anchor, copy, label, v, cell and windows of scores as arrays lows and highs. Rows of the query's
        label (``same``) or of others are looked at, but not the query's own row.
        """
        best = Window.partitionBy("anchor", "copy", "w").orderBy(F.desc("score"), "vec_id", "vec_copy")

        def ranked(found: DataFrame) -> DataFrame:
            return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)

        near = self._pass(queries.withColumn("least", F.transform("lows", lambda x: F.lit(-_FAR))), same, k, True)
        kth = ranked(near).where(F.col("rank") == k).groupBy("anchor", "copy").agg(F.map_from_entries(F.collect_list(F.struct("w", "score"))).alias("kth"))
        least = F.transform("lows", lambda x, w: F.coalesce(F.try_element_at("kth", w.cast("int")), F.lit(-_FAR)))
        far = self._pass(stage(queries.join(kth, ["anchor", "copy"], "left").withColumn("least", least).drop("kth"), "queries"), same, k, False)
        return stage(ranked(near.union(far)), "nearest")


def numbered(vectors: DataFrame) -> DataFrame:
    """(vec_id, copy, label, v): repeated ids get copy numbers from 0, by label and vector."""
    order = Window.partitionBy("vec_id").orderBy("label", "v")
    return stage(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), "v").withColumn("copy", (F.row_number().over(order) - 1).cast("long")), "vectors")


def mine(vectors: DataFrame, every: int = 100, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of ``vectors`` (vec_id, label, v array<long>).

    Anchors are the rows whose vec_id is divisible by ``every``, scores inner products, larger first, ties by smaller
    vec_id. An anchor's positives are its first other rows of its label; for each, the first rows of other labels with
    low * positive_score <= 100 * score <= high * positive_score follow. Anchors without positives, and positives without
    such rows, give no row.

    Rows with a null vec_id, label or vector, or a null in the vector, take no part; shorter vectors count as filled up
    with zeros; repeated ids are rows each (an anchor's copy is another row of its label). Scores beyond 64 bits raise an
    error. Other columns are ignored, and an empty table gives no rows.
    """
    rows = numbered(vectors.where("vec_id is not null and label is not null and v is not null and not exists(v, x -> x is null)"))
    index = CoverIndex(rows)
    anchors = index.rows.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("anchor"), "copy", "label", "v", "cell")
    all_scores = anchors.withColumn("lows", F.array(F.lit(-_FAR))).withColumn("highs", F.array(F.lit(_FAR)))
    found = index.nearest(all_scores, True, positives).select("anchor", "copy", "rank", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    # 30 p <= 100 n <= 90 p has whole solutions only from ceil(30 p / 100) to floor(90 p / 100)
    usable = found.where(F.lit(low) * F.col("positive_score") <= F.lit(high) * F.col("positive_score"))
    per_anchor = usable.groupBy("anchor", "copy").agg(F.sort_array(F.collect_list(F.struct("rank", "positive_id", "positive_score"))).alias("own"))
    score = "x.positive_score"
    queries = anchors.join(per_anchor, ["anchor", "copy"]).withColumns(
        {"lows": F.expr(f"transform(own, x -> -((-{low} * {score} - pmod(-{low} * {score}, 100L)) div 100))"), "highs": F.expr(f"transform(own, x -> ({high} * {score} - pmod({high} * {score}, 100L)) div 100)")}
    )
    queries = stage(queries, "windows")
    hits = index.nearest(queries.drop("own"), False, negatives)
    return (
        hits.join(queries.select("anchor", "copy", F.posexplode("own").alias("w", "positive")), ["anchor", "copy", "w"])
        .select(
            F.col("anchor").alias("anchor_id"), F.col("positive.positive_id").alias("positive_id"), F.col("rank").cast("int").alias("rank"),
            F.col("vec_id").alias("negative_id"), F.col("positive.positive_score").alias("positive_score"), F.col("score").alias("negative_score"),
        )
    )


def quantised(embeddings: DataFrame, scale: int = 256, moved: int = 7, labels: int = 10) -> DataFrame:
    """(vec_id, label, v) of ``embeddings`` (vec_id, embedding, label): components floor(scale * x), x as double.

    The label of every ``moved``-th vec_id becomes the next one modulo ``labels``. Rows with a null label or vector, or a
    null or non-finite component, are left out.
    """
    finite = "label is not null and embedding is not null and not exists(embedding, x -> x is null or isnan(x) or abs(x) = double('infinity'))"
    label = F.when(F.col("vec_id") % moved == 0, (F.col("label") + 1) % labels).otherwise(F.col("label"))
    return embeddings.where(finite).select("vec_id", label.cast("long").alias("label"), F.expr(f"transform(embedding, x -> floor({scale} * cast(x as double)))").alias("v"))
