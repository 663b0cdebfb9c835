"""Trie of conversation prefixes from sorted conversations, by range minima over their common prefix lengths.

Conversations are sorted as sequences of turn keys, and ``lcp[i]`` is the number of leading turns that the i-th shares
with the one before it. A prefix of depth d at position i is shared by the positions around i up to the next
``lcp < d`` on either side; a sparse table of range minima finds both ends by binary search, for every prefix on its own.

A task works on blocks of sorted conversations. What ends inside a block is final. Only prefixes of a block's first and
last conversation can go on in other blocks: these two go on as weighted sequences, which are sorted and treated the
same way, level by level, until one block holds them all. A prefix shared by any number of conversations, or any
number of copies of one, is thus spread over as many blocks as it fills.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.session import stage

#: A block ends at so many conversations, or at so many turns once it has LEAST conversations.
ROWS, TURNS, LEAST = 4096, 1 << 18, 64
KEY_BYTES = 16
#: Kinds of rows that a level returns: a node; a sequence for the next level; the first member of a sequence's prefix,
#: or the block of the next level that knows it; a run of member ids of a node that may go on elsewhere.
_NODE, _ITEM, _MEMBER, _ENDS = 0, 1, 2, 3
_LISTS = ("convs", "ns", "childs", "leafs", "saves")
_SCHEMA = pa.schema(
    [("kind", pa.int32()), ("block", pa.int64()), ("side", pa.int32()), ("seq", pa.binary()), ("sizes", pa.list_(pa.int32()))]
    + [(c, pa.list_(pa.int64())) for c in _LISTS]
    + [(c, pa.int64()) for c in ("depth", "conv", "parent", "up_block")]
    + [("up_side", pa.int32())]
    + [(c, pa.int64()) for c in ("n_convs", "n_children", "n_leaves", "saved")]
    + [("key", pa.binary()), ("ends", pa.string())]
)
_FIELDS = (
    "kind int, block long, side int, seq binary, sizes array<int>, convs array<long>, ns array<long>, childs array<long>, leafs array<long>,"
    " saves array<long>, depth long, conv long, parent long, up_block long, up_side int, n_convs long, n_children long, n_leaves long,"
    " saved long, key binary, ends string"
)
NO_ENDS = hashlib.sha256(b"").hexdigest()


def _rows(n: int, kind: int, **columns) -> pa.RecordBatch:
    """A batch of one kind; columns that are not given are null."""
    columns["kind"] = np.full(n, kind, np.int32)
    arrays = [pa.nulls(n, f.type) if f.name not in columns else columns[f.name] for f in _SCHEMA]
    arrays = [a if isinstance(a, pa.Array) else pa.array(a, f.type) for a, f in zip(arrays, _SCHEMA, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, schema=_SCHEMA)


def _ragged(values: np.ndarray, lengths: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(lengths))), pa.int32()), pa.array(values, kind))


def common_prefixes(keys: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Leading turns that each sequence shares with the one before it; -1 for the first."""
    lengths = np.diff(offsets)
    out = np.full(len(lengths), -1, np.int64)
    if len(lengths) > 1:
        both = np.minimum(lengths[1:], lengths[:-1])
        out[1:] = both
        pair = np.repeat(np.arange(1, len(lengths)), both)
        k = np.arange(len(pair)) - np.repeat(np.cumsum(both) - both, both)
        differ = np.flatnonzero((keys[offsets[pair] + k] != keys[offsets[pair - 1] + k]).any(axis=1))
        np.minimum.at(out, pair[differ], k[differ])
    return out


class RangeMinima:
    """A sparse table: minima of all runs of 2**k neighbouring values."""

    def __init__(self, values: np.ndarray):
        self.levels, k = [values], 1
        while 2 * k <= len(values):
            last = self.levels[-1]
            self.levels.append(np.minimum(last[: len(last) - k], last[k:]))
            k *= 2

    def extents(self, at: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last position that share ``depth`` leading turns with position ``at``; each end by its own search."""
        n = len(self.levels[0])
        left, right = at.copy(), at.copy()
        for k in range(len(self.levels) - 1, -1, -1):
            level, step = self.levels[k], 1 << k
            begin = left - step + 1
            left = np.where((begin >= 1) & (level[np.maximum(begin, 0)] >= depth), left - step, left)
            fits = right + step < n
            right = np.where(fits & (level[np.where(fits, right + 1, 0)] >= depth), right + step, right)
        return left, right


class _Block:
    """Sorted sequences with what lower levels found under each of their prefixes."""

    def __init__(self, table: pa.Table, level: int, number: int):
        self.level, self.number = level, number
        seqs = table.column("seq").combine_chunks()
        self.sizes = table.column("sizes").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        self.bodies = seqs.to_pylist()
        self.lengths = np.array([len(x) // KEY_BYTES for x in self.bodies], np.int64)
        self.offsets = np.concatenate(([0], np.cumsum(self.lengths)))
        self.keys = np.frombuffer(b"".join(self.bodies), np.uint64).reshape(-1, 2)
        per_row = self.lengths + 1  # the depths 0 to length of a sequence
        self.flat = np.concatenate(([0], np.cumsum(per_row)))
        if level:
            self.of = table.column("block").to_numpy(), table.column("side").to_numpy()
            self.convs, self.ns, *self.below = (table.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False) for c in _LISTS)
        else:
            self.ids = table.column("conv_id").to_numpy()
            self.convs, self.ns = np.repeat(self.ids, per_row), np.ones(self.flat[-1], np.int64)
            self.below = [np.zeros(self.flat[-1], np.int64)] * 3
        self._nodes(per_row)

    def _nodes(self, per_row: np.ndarray) -> None:
        m = len(self.lengths)
        self.lcp = common_prefixes(self.keys, self.offsets)
        self.minima = RangeMinima(self.lcp)
        # a prefix is a node where it first occurs; in this order a node stands before its subtree
        new = self.lengths - self.lcp
        self.first = np.concatenate(([0], np.cumsum(new)))
        self.at = np.repeat(np.arange(m), new)
        self.depth = np.arange(self.first[-1]) - self.first[self.at] + self.lcp[self.at] + 1
        self.left, self.right = self.minima.extents(self.at, self.depth)
        self.end = self.first[self.right + 1]
        up_left, _ = self.minima.extents(self.at, np.maximum(self.depth - 1, 0))
        self.up = np.where(self.depth > 0, self.node_at(up_left, self.depth - 1), -1)
        self.last_size = np.zeros(len(self.at), np.int64)
        inner = self.depth > 0
        self.last_size[inner] = self.sizes[self.offsets[self.at[inner]] + self.depth[inner] - 1]
        # sums and minima over the entries of one depth, which lie side by side in this order
        flat_depth = np.arange(self.flat[-1]) - np.repeat(self.flat[:-1], per_row)
        order = np.argsort(flat_depth, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        begin, stop = place[self.flat[self.left] + self.depth], place[self.flat[self.right] + self.depth] + 1
        total = lambda x: (c := np.concatenate(([0], np.cumsum(x[order]))))[stop] - c[begin]
        self.n = total(self.ns)
        self.children, self.leaves, self.saved = (total(x) for x in self.below)
        pairs = np.stack((begin, stop), axis=1).ravel()
        self.conv = np.minimum.reduceat(np.append(self.convs[order], np.iinfo(np.int64).max), pairs)[::2]

    def node_at(self, left: np.ndarray, depth: np.ndarray) -> np.ndarray:
        """The node of a depth whose members begin at ``left``."""
        return self.first[left] + depth - self.lcp[left] - 1

    def close(self, everything: bool) -> None:
        """Settles the nodes that cannot go on in another block."""
        m = len(self.lengths)
        self.open = ((self.at == 0) | (self.right == m - 1)) & (not everything)
        known = ~self.open
        self.children += np.bincount(self.up[known & (self.up >= 0)], minlength=len(self.at))
        leaf = known & (self.children == 0)
        saving = np.where(known, (self.n - 1) * self.last_size, 0)
        under = lambda x: (c := np.concatenate(([0], np.cumsum(x))))[self.end] - c[:-1]
        self.leaves += under(leaf.astype(np.int64))
        self.saved += under(saving)

    def side(self, nodes: np.ndarray) -> np.ndarray:
        """Open nodes lead to the block's first (0) or last (1) sequence."""
        return (self.at[nodes] > 0).astype(np.int32)

    def ends(self) -> tuple[np.ndarray, list[str]]:
        """Nodes at which conversations end, and their ids."""
        full = np.flatnonzero(self.depth == self.lengths[self.at])
        starts = self.at[full]
        stops = np.append(starts[1:], len(self.lengths))
        return full, [",".join(map(str, self.ids[a:b].tolist())) for a, b in zip(starts.tolist(), stops.tolist(), strict=True)]

    def prefix_keys(self, nodes: np.ndarray) -> list[bytes]:
        out, row, state, done = [], -1, None, 0
        for p, d in zip(self.at[nodes].tolist(), self.depth[nodes].tolist(), strict=True):
            if p != row:
                row, state, done = p, hashlib.sha256(), 0
            state.update(self.bodies[p][done * KEY_BYTES : d * KEY_BYTES])
            done = d
            out.append(state.copy().digest()[:KEY_BYTES])
        return out

    def node_rows(self) -> pa.RecordBatch:
        nodes = np.flatnonzero(~self.open)
        up = self.up[nodes]
        waits = (up >= 0) & self.open[up]
        columns = {
            "parent": pa.array(self.conv[up], mask=(up < 0) | waits),
            "up_block": pa.array(np.full(len(nodes), self.number), mask=~waits),
            "up_side": pa.array(self.side(up), mask=~waits),
        }
        if self.level:
            columns["key"] = pa.array(self.prefix_keys(nodes), pa.binary())
        else:
            hashes = np.full(len(self.at), NO_ENDS, object)
            full, ids = self.ends()
            for k, text in zip(full.tolist(), ids, strict=True):
                if not self.open[k]:
                    hashes[k] = hashlib.sha256(text.encode()).hexdigest()
            columns["ends"] = pa.array(hashes[nodes], pa.string())
        values = {c: getattr(self, a)[nodes] for c, a in (("depth", "depth"), ("conv", "conv"), ("n_convs", "n"), ("n_children", "children"), ("n_leaves", "leaves"), ("saved", "saved"))}
        return _rows(len(nodes), _NODE, **values, **columns)

    def end_rows(self) -> pa.RecordBatch:
        full, ids = self.ends()
        held = [(k, text) for k, text in zip(full.tolist(), ids, strict=True) if self.open[k]]
        nodes = np.array([k for k, _ in held], np.int64)
        return _rows(len(held), _ENDS, key=pa.array(self.prefix_keys(nodes), pa.binary()), conv=self.ids[self.at[nodes]], ends=[t for _, t in held])

    def member_rows(self) -> pa.RecordBatch:
        """For each prefix of each sequence that a lower level asks for: its first member, or where it is known."""
        row = np.repeat(np.arange(len(self.lengths)), self.lengths + 1)
        depth = np.arange(self.flat[-1]) - self.flat[row]
        held = self.ns > 0
        row, depth = row[held], depth[held]
        node = self.node_at(self.minima.extents(row, depth)[0], depth)
        waits = self.open[node]
        block, side = self.of
        return _rows(
            len(row), _MEMBER, block=block[row], side=side[row], depth=depth, conv=pa.array(self.conv[node], mask=waits),
            up_block=pa.array(np.full(len(row), self.number), mask=~waits), up_side=pa.array(self.side(node), mask=~waits),
        )

    def item_rows(self) -> pa.RecordBatch:
        """The first and, if it is another, the last sequence, with what lies under their prefixes in this block."""
        last = len(self.lengths) - 1
        shared = int(self.lcp[1:].min(initial=self.lengths[0]))
        rows = [0] if shared == self.lengths[last] else [0, last]
        values = {c: [] for c in _LISTS}
        for p in rows:
            depth = np.arange(self.lengths[p] + 1)
            node = self.node_at(self.minima.extents(np.full(len(depth), p), depth)[0], depth)
            own = depth > (shared if p else -1)  # prefixes of both count with the first
            for c, x in zip(_LISTS, (self.conv, self.n, self.children, self.leaves, self.saved), strict=True):
                values[c].append(np.where(own, x[node], np.iinfo(np.int64).max if c == "convs" else 0))
        lengths = self.lengths[rows]
        sizes = np.concatenate([self.sizes[self.offsets[p] : self.offsets[p + 1]] for p in rows])
        return _rows(
            len(rows), _ITEM, block=np.full(len(rows), self.number), side=np.arange(len(rows)), seq=pa.array([self.bodies[p] for p in rows], pa.binary()),
            sizes=_ragged(sizes, lengths, pa.int32()), **{c: _ragged(np.concatenate(x), lengths + 1, pa.int64()) for c, x in values.items()},
        )


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    held, rows, turns = [], 0, 0
    for batch in batches:
        lengths = np.cumsum([0, *(len(x) for x in batch.column("sizes"))])
        begin = 0
        for k in range(1, batch.num_rows + 1):
            more = lengths[k] - lengths[begin] + turns
            if rows + k - begin == ROWS or (more >= TURNS and rows + k - begin >= LEAST):
                yield pa.Table.from_batches([*held, batch.slice(begin, k - begin)])
                held, rows, turns, begin = [], 0, 0, k
        if begin < batch.num_rows:
            held.append(batch.slice(begin))
            rows, turns = rows + batch.num_rows - begin, turns + int(lengths[-1] - lengths[begin])
    if held:
        yield pa.Table.from_batches(held)


def _level(level: int, final: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = (level << 56) + (TaskContext.get().partitionId() << 28)
        tables = _blocks(batches)
        if final:
            held = [t for t in tables if t.num_rows]
            tables = iter([pa.concat_tables(held)] if held else [])
        for k, table in enumerate(tables):
            block = _Block(table, level, base + k)
            block.close(final)
            yield block.node_rows()
            if level:
                yield block.member_rows()
            elif not final:
                yield block.end_rows()
            if not final:
                yield block.item_rows()

    return run


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One hash per key over its runs of ids, which come in order."""
    key, state, done = None, None, []

    def flush() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([k for k, _ in done], pa.binary()), pa.array([h for _, h in done], pa.string())], ["key", "ends"])

    for batch in batches:
        for k, text in zip(batch.column("key").to_pylist(), batch.column("ends").to_pylist(), strict=True):
            if k != key:
                if key is not None:
                    done.append((key, state.hexdigest()))
                key, state = k, hashlib.sha256(text.encode())
            else:
                state.update(b"," + text.encode())
        if len(done) > 4096:
            yield flush()
            done = []
    if key is not None:
        done.append((key, state.hexdigest()))
    yield flush()


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """Every distinct prefix of ``conversations`` (conv_id long, turns array of structs with role and text).

    Per prefix: conv_id (smallest member), depth, parent_conv_id (null for the root), n_convs, n_children, n_leaves,
    saved_tokens (over the subtree, (members - 1) x code points of the prefix's last text) and ends_sha256 (of the ids
    of the conversations that are the prefix, ascending, joined by commas).

    Null roles and texts count as empty; a null or empty list of turns is a member of the root alone; rows without a
    conv_id take no part; repeated rows are members each. Without rows there are no nodes. Other columns are ignored.
    Turns are compared by 128 bits of SHA-256. A task's memory follows its block and the longest conversation, at about
    100 bytes a turn.
    """
    plain = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turns").select(
        "conv_id",
        F.expr("coalesce(transform(turns, x -> substring(sha2(concat(length(coalesce(x.role, '')), ':', coalesce(x.role, ''), coalesce(x.text, '')), 256), 1, 32)), array())").alias("keys"),
        F.expr("coalesce(transform(turns, x -> length(coalesce(x.text, ''))), array())").alias("sizes"),
    )
    return trie_of_keys(plain)


def trie_of_keys(plain: DataFrame) -> DataFrame:
    """prefix_trie() of (conv_id long, keys array of 32 hexadecimal digits per turn, sizes array of int)."""
    spark = plain.sparkSession
    items = stage(plain.select("conv_id", F.expr("unhex(array_join(keys, ''))").alias("seq"), "sizes"), "sequences")
    levels, level = [], 0
    rows = items.count()
    while True:
        order = ["seq", "conv_id"] if level == 0 else ["seq", "block", "side"]
        final = rows <= ROWS
        dealt = items.repartition(1) if final else items.repartitionByRange(*([] if level == 0 else [max(1, -(-rows // ROWS))]), *order)
        out = stage(dealt.sortWithinPartitions(*order).mapInArrow(_level(level, final), _FIELDS), f"trie{level}")
        levels.append(out)
        if final:
            break
        items = out.where(f"kind = {_ITEM}").select("seq", "block", "side", "sizes", *_LISTS)
        rows, level = items.count(), level + 1
    nodes = ["depth", "conv", "parent", "up_block", "up_side", "n_convs", "n_children", "n_leaves", "saved"]
    empty = F.lit(NO_ENDS)
    found = levels[0].where(f"kind = {_NODE}").select(*nodes, "ends")
    if len(levels) == 1:
        return _named(found.withColumn("parent_conv_id", F.col("parent")))
    runs = levels[0].where(f"kind = {_ENDS}").select("key", "conv", "ends")
    hashes = stage(runs.repartition("key").sortWithinPartitions("key", "conv").mapInArrow(_hashed, "key binary, ends string"), "ends")
    for out in levels[1:]:
        upper = out.where(f"kind = {_NODE}").select("key", *nodes).join(hashes, "key", "left")
        found = found.union(upper.select(*nodes, F.coalesce("ends", empty).alias("ends")))
    # first members of open prefixes, from the last level down
    known = None
    for out in reversed(levels[1:]):
        rows_of = out.where(f"kind = {_MEMBER}").select("block", "side", "depth", "conv", "up_block", "up_side")
        direct = rows_of.where("conv is not null").select("block", "side", "depth", "conv")
        if known is not None:
            asked = rows_of.where("conv is null").select(F.col("block").alias("b"), F.col("side").alias("s"), F.col("depth").alias("d"), "up_block", "up_side")
            there = asked.join(known, (F.col("up_block") == F.col("block")) & (F.col("up_side") == F.col("side")) & (F.col("d") == F.col("depth")))
            direct = direct.union(known).union(there.select("b", "s", "d", "conv"))
        known = stage(direct, "members")
    waits = found.where("up_block is not null")
    known = known.select(F.col("block").alias("up_block"), F.col("side").alias("up_side"), (F.col("depth") + 1).alias("depth"), F.col("conv").alias("parent_conv_id"))
    resolved = waits.join(known, ["up_block", "up_side", "depth"])
    settled = found.where("up_block is null").withColumn("parent_conv_id", F.col("parent"))
    return _named(settled).union(_named(resolved))


def _named(nodes: DataFrame) -> DataFrame:
    return nodes.select(
        F.col("conv").alias("conv_id"), "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves",
        F.col("saved").alias("saved_tokens"), F.col("ends").alias("ends_sha256"),
    )


def rebuilt_keys(turns: DataFrame, most: int = 6, group: int = 100) -> DataFrame:
    """Conversations whose first turns come from the group's first: (conv_id, keys, sizes), one row per conv_id.

    ``turns`` has conv_id, turn, role, text; turns are ordered by turn (null first), equal ones by the SHA-256 of role
    and text. Conversation c gets the first h turns of c - c % ``group`` (all if it has fewer, none if absent), then its
    own after its first h, with h = crc32(decimal c) % ``most``. Texts are read once and only their hashes are shuffled.
    """
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    key = F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256), 1, 2 * KEY_BYTES)
    plain = turns.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", key.alias("key"), F.length(text).alias("size"))
    own = stage(plain.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "key", "size"))).alias("own")), "conversations")
    heads = own.where(F.col("conv_id") % group == 0).select(F.col("conv_id").alias("base"), F.slice("own", 1, most - 1).alias("head"))
    taken = F.crc32(F.col("conv_id").cast("string").cast("binary")) % most
    joined = own.select("conv_id", "own", (F.col("conv_id") - F.col("conv_id") % group).alias("base"), taken.cast("int").alias("taken")).join(heads, "base", "left")
    turns_now = F.expr("concat(coalesce(slice(head, 1, taken), array()), slice(own, taken + 1, size(own)))")
    return joined.select("conv_id", turns_now.alias("now")).select("conv_id", F.expr("now.key").alias("keys"), F.expr("now.size").alias("sizes"))
