"""The prefix trie against plain Python, in blocks of several sizes, and its SQL."""

from __future__ import annotations

import hashlib
import math
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest

from basketry.llm import oracles, prefix_trie as T

SCHEMA = "conv_id long, turn long, role string, text string, depth int, seq string, key string"


def rebuilt(rows):
    conv = defaultdict(list)
    for c, t, r, x, *_ in rows:
        if c is not None:
            conv[c].append((t is not None, t or 0, hashlib.sha256(f"{len(r or '')}:{r or ''}{x or ''}".encode()).hexdigest(), r or "", x or ""))
    own = {c: [z[3:] for z in sorted(v)] for c, v in conv.items()}
    out = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = tuple(own.get(c - int(math.fmod(c, 100)), [])[:h] + v[h:])
    return out


def trie(seqs):
    """Nodes of (id, sequence) pairs, every prefix written out."""
    members, kids, leaves, saved = defaultdict(list), defaultdict(int), defaultdict(int), defaultdict(int)
    for c, s in seqs:
        for d in range(len(s) + 1):
            members[s[:d]].append(c)
    for p in members:
        if p:
            kids[p[:-1]] += 1
    for p in members:
        for d in range(len(p) + 1):
            leaves[p[:d]] += not kids[p]
            saved[p[:d]] += (len(members[p]) - 1) * len(p[-1][1]) if p else 0
    ends = defaultdict(list)
    for c, s in seqs:
        ends[s].append(c)
    return sorted(
        (
            (min(m), len(p), min(members[p[:-1]]) if p else None, len(m), kids[p], leaves[p], saved[p], hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest())
            for p, m in members.items()
        ),
        key=str,
    )


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_extents_are_those_of_a_scan():
    rng = np.random.default_rng(3)
    lcp = np.concatenate(([-1], rng.integers(0, 4, 60)))
    at, depth = np.arange(61), rng.integers(0, 5, 61)
    left, right = T.RangeMinima(lcp).extents(at, depth)
    for p, d, a, b in zip(at, depth, left, right):
        x = p
        while x > 0 and lcp[x] >= d:
            x -= 1
        y = p
        while y + 1 < 61 and lcp[y + 1] >= d:
            y += 1
        assert (x, y) == (a, b)


@pytest.mark.parametrize("block", [4096, 40, 8])
def test_equal_to_every_prefix_written_out(spark, monkeypatch, block):
    monkeypatch.setattr(T, "ROWS", block)
    monkeypatch.setattr(T, "LEAST", 4)
    df = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    copies = [(700_000 + k, t, "user", x, 1, "s", "k") for k in range(60) for t, x in enumerate(("same", "words", "again"))]
    odd = [(1, None, None, "first", 1, "s", "k"), (2, 0, "user", None, 1, "s", "k"), (2, 0, "user", None, 1, "s", "k"), (None, 1, "user", "lost", 1, "s", "k")]
    odd += [(-150, 0, "a", "", 1, "s", "k"), (-7, 3, "", "a" * 100_000, 1, "s", "k"), (990_050, 0, "user", "x", 1, "s", "k")] + [(31, t, "u", f"t{t}", 1, "s", "k") for t in range(600)]
    extra = spark.createDataFrame(copies + odd, SCHEMA)
    rows = [tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()] + copies + odd
    got = T.trie_of_keys(T.rebuilt_keys(df.unionByName(extra, allowMissingColumns=True)))
    assert rows_of(got) == trie(list(rebuilt(rows).items()))


def test_own_interface_and_empty_tables(spark):
    schema = "conv_id long, turns array<struct<role: string, text: string>>, keys int"
    data = [(1, [("u", "a"), ("v", "b")]), (1, [("u", "a")]), (2, None), (3, []), (None, [("u", "a")]), (4, [(None, None)]), (5, [("", "")])]
    got = T.prefix_trie(spark.createDataFrame([(*r, 1) for r in data], schema))
    assert rows_of(got) == trie([(c, tuple((r or "", x or "") for r, x in s or ())) for c, s in data if c is not None])
    assert T.prefix_trie(spark.createDataFrame([], schema)).count() == 0
    assert T.trie_of_keys(T.rebuilt_keys(spark.createDataFrame([], SCHEMA))).count() == 0


def test_sql_gives_the_same_rows(spark):
    file = "/root/testdata/sf0.01/conversations.parquet"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{file}'")
    relation = con.execute(oracles.PREFIX_TRIE)
    names = [c[0] for c in relation.description]
    got = T.trie_of_keys(T.rebuilt_keys(spark.read.parquet(file)))
    assert got.columns == names and rows_of(got) == sorted(relation.fetchall(), key=str)
