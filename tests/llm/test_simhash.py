"""SimHash classes against plain Python over all pairs, with small buckets and nodes."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest
import xxhash

from basketry.llm import simhash as S
from basketry.session import stage

SCHEMA = "doc_id long, text string, fp long, key string, component_id int"


def plain_fingerprint(text, n=4):
    words = [w for w in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    if not words:
        return 0
    shingles = [" ".join(words[k : k + n]) for k in range(len(words) - n + 1)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(fps, bits):
    """Component of each place, over all pairs."""
    a = np.array(fps, np.uint64)
    of = list(range(len(a)))
    changed = True
    near = [np.flatnonzero(np.bitwise_count(a ^ x) <= bits).tolist() for x in a]
    while changed:
        changed = False
        for k, others in enumerate(near):
            low = min(of[o] for o in others)
            if low < of[k]:
                of[k], changed = low, True
    return of


def brute(rows, bits=4):
    fps = [plain_fingerprint(t) for _, t in rows]
    of = classes(fps, bits)
    out = []
    for (doc_id, _), fp, c in zip(rows, fps, of):
        ids = [d for (d, _), o in zip(rows, of) if o == c and d is not None]
        out.append((doc_id, f"{fp:016x}", min(ids) if ids else None))
    return sorted(out, key=str)


def text_of(rng, n):
    return " ".join(rng.choice("alpha Beta gamma delta été naïve zeta eta theta".split()) + str(rng.randrange(40)) for _ in range(n))


def test_equal_to_all_pairs(spark):
    rng = random.Random(11)
    rows = []
    for _ in range(40):
        words = text_of(rng, rng.choice([3, 10, 400, 900])).split()
        for _ in range(rng.choice([1, 4])):
            rows.append((len(rows), " ".join(words)))
            words[rng.randrange(len(words))] = "Changed" + str(rng.random())
    rows += [(500 + k, t) for k, t in enumerate([None, "", " \n\t", "one", "ONE", "two words", "a b c d", "A  b\tc\x0bd", "nb sp is one", "é É"])]
    rows += [(None, rows[0][1]), (None, "only here and nowhere else at all"), (7, "seven again"), (7, "seven again"), (900, "x y " * 50_000)]
    df = spark.createDataFrame([(*r, 1, "k", 1) for r in rows], SCHEMA).repartition(3)
    got = sorted((tuple(r) for r in S.simhash_duplicates(df).collect()), key=str)
    assert got == brute(rows)
    assert len({r[2] for r in got}) < len(got)


def near_fps(rng, n):
    """A dense ball, chains, and spread ones."""
    centre = rng.getrandbits(64)
    ball = [centre ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(9))) for _ in range(n)]
    chain = [rng.getrandbits(64)]
    for _ in range(60):
        chain.append(chain[-1] ^ sum(1 << b for b in rng.sample(range(64), 4)))
    return sorted({*ball, *chain, *(rng.getrandbits(64) for _ in range(n)), 0, (1 << 64) - 1})


@pytest.mark.parametrize("held", [8192, 32])
def test_links_connect_all_near_fingerprints(spark, monkeypatch, held):
    monkeypatch.setattr(S, "HELD", held)
    monkeypatch.setattr(S, "CHUNK", 64)
    fps = near_fps(random.Random(12), 400)
    signed = np.array(fps, np.uint64).view(np.int64).tolist()
    df = spark.createDataFrame([(f,) for f in signed], "fp long").repartition(3)
    links = [(r.a, r.b) for r in stage(S.linked(df)).collect()]
    assert all(int(np.bitwise_count(np.uint64(a & (2**64 - 1)) ^ np.uint64(b & (2**64 - 1)))) <= 4 for a, b in links)
    up = {f: f for f in signed}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    of = classes(fps, 4)
    roots = [root(f) for f in signed]
    assert len(set(roots)) == len(set(of)) == len(set(zip(roots, of)))


def test_gray_index_finds_what_a_scan_finds():
    rng = random.Random(13)
    fps = np.array(near_fps(rng, 500), np.uint64)
    rank = fps.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    fps = fps[np.argsort(rank)]
    query, place = S.GrayIndex(fps, 5).search(fps, 4)
    found = set(zip(query.tolist(), place.tolist()))
    assert found == {(k, int(p)) for k in range(len(fps)) for p in np.flatnonzero(np.bitwise_count(fps ^ fps[k]) <= 4)}
    # neighbours in Gray order differ in one bit if their ranks are neighbours
    ranks = np.arange(64, dtype=np.uint64)
    assert (np.bitwise_count((ranks ^ ranks >> np.uint64(1))[1:] ^ (ranks ^ ranks >> np.uint64(1))[:-1]) == 1).all()


def test_gray_rank_in_spark(spark):
    values = [0, 1, 3, 2, 6, -1, 1 << 62, -(1 << 63)]
    got = {r.fp: r.g for r in spark.createDataFrame([(v,) for v in values], "fp long").withColumn("g", S.gray_rank(S.F.col("fp"))).collect()}

    def rank(x):
        x &= 2**64 - 1
        out = 0
        while x:
            out, x = out ^ x, x >> 1
        return out

    assert sorted(values, key=got.get) == sorted(values, key=rank) and got[2] - got[0] == 3


def test_empty_table(spark):
    assert S.simhash_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
