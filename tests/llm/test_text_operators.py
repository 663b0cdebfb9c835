"""The operators on texts against plain Python, with odd rows, empty tables and clashing columns."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from basketry.llm import surrogates, winnowing
from basketry.llm.components import components
from basketry.llm.licences import KNOWN, TEXTS, scan
from basketry.llm.neardup import near_duplicates
from basketry.llm.pieces import PIECES, Vocabulary, decoded, encode, nbest
from basketry.llm.quality import good_only, quality
from basketry.llm.shards import load_map, newest_version, rebalance, shard
from basketry.llm.substrings import repeated_spans


@pytest.fixture(scope="module")
def docs(spark):
    def make(*texts, start=0):
        """Texts with ids, a language, and columns whose names the operators use for their own."""
        rows = [(start + k, t, "en", "x", 1, True) for k, t in enumerate(texts)]
        return spark.createDataFrame(rows, "doc_id long, text string, lang string, key string, n long, kept boolean")

    return make


def words(text):
    return [w for w in re.split("[\x20\x09-\x0d]+", text or "") if w]


def noise(rng, n, letters="abcdé "):
    return "".join(rng.choice(letters) for _ in range(n))


ODD = [None, "", " \n\t ", "one", "a b c d", "x y z", "日本 語", "w " * 3000]


# --- near duplicates


def linked(texts, percent=85):
    sets, above = [], list(range(len(texts)))
    for t in texts:
        w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in words(t)]
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())

    def root(x):
        while above[x] != x:
            x = above[x]
        return x

    for a in range(len(texts)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= 85 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                above[max(x, y)] = min(x, y)
    return [(len(sets[k]), root(k)) for k in range(len(texts))]


def edited(rng, base, times):
    w = base.split()
    for _ in range(times):
        w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
    return " ".join(w)


def test_near_duplicates_match_all_pairs(docs):
    rng = random.Random(4)
    bases = [" ".join(f"w{rng.randrange(400)}" for _ in range(120)) for _ in range(4)]
    texts = [*ODD, *ODD[3:6], "ONE", "A b C d"]
    for base in bases:
        texts += [base, base.upper(), *(edited(rng, base, rng.randrange(1, 5)) for _ in range(25))]
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_duplicates(docs(*texts)).collect()}
    assert got == {k: (n, c, c == k) for k, (n, c) in enumerate(linked(texts))}


def test_full_buckets_lose_no_link(docs, monkeypatch):
    import basketry.llm.neardup as module

    monkeypatch.setattr(module, "SMALL", 3)
    monkeypatch.setattr(module, "HELD", 6)
    rng = random.Random(6)
    base = " ".join(f"w{rng.randrange(400)}" for _ in range(100))
    texts = [edited(rng, base, rng.randrange(1, 4)) for _ in range(30)]
    got = {r.doc_id: r.component_id for r in near_duplicates(docs(*texts)).collect()}
    assert got == {k: c for k, (_, c) in enumerate(linked(texts))}


def test_pairs_among_texts_below_the_threshold_are_found(docs, monkeypatch):
    import basketry.llm.neardup as module

    monkeypatch.setattr(module, "DEALT", 200, raising=False)
    # 1000 texts with 80 common words, alike by 0.656 to each other, and 20 pairs alike by 0.757
    common = [f"c{k}" for k in range(80)]
    texts = [" ".join(common + [f"own{n}x{k}" for k in range(21)]) for n in range(1000)]
    for n in range(20):
        both = common + [f"pair{n}x{k}" for k in range(7)]
        texts += [" ".join(both + [f"pair{n}{side}{k}" for k in range(14)]) for side in "ab"]
    got = {r.doc_id: r.component_id for r in near_duplicates(docs(*texts), words=1, percent=75).collect()}
    assert got == {k: k - (k - 1000) % 2 if k >= 1000 else k for k in range(len(texts))}


def test_forests_join_what_all_edges_join_by_the_heaviest():
    import numpy as np

    from basketry.llm.neardup import spanning_forest

    rng = np.random.default_rng(7)
    for n, m in ((2, 1), (40, 30), (40, 400), (1, 0)):
        x, y, weight = rng.integers(0, n, m), rng.integers(0, n, m), rng.integers(0, 9, m)
        start = np.where(np.arange(n) < 5, 0, np.arange(n))  # some are joined already
        above = start.tolist()

        def root(k):
            while above[k] != k:
                k = above[k]
            return k

        total = count = 0
        for k in np.argsort(-weight, kind="stable").tolist():
            a, b = root(x[k]), root(y[k])
            if a != b:
                above[max(a, b)] = min(a, b)
                total, count = total + weight[k], count + 1
        kept = spanning_forest(start, x, y, weight)
        assert (weight[kept].sum(), len(kept)) == (total, count)
        again = start.tolist()
        above = again
        for k in kept.tolist():
            a, b = root(x[k]), root(y[k])
            assert a != b
            above[max(a, b)] = min(a, b)


def test_many_near_copies_give_few_pairs(docs, monkeypatch):
    """Pairs that are looked at grow with the number of copies, not with its square."""
    import basketry.llm.neardup as module

    seen = []
    whole = module._linked
    monkeypatch.setattr(module, "_linked", lambda sets, pairs, percent: seen.append(pairs.count()) or whole(sets, pairs, percent))
    rng = random.Random(8)
    base = " ".join(f"w{rng.randrange(4000)}" for _ in range(150))
    texts = [edited(rng, base, 1) for _ in range(300)]
    got = {r.component_id for r in near_duplicates(docs(*texts)).collect()}
    assert got == {0} and sum(seen) < 300 * module.BANDS


def test_near_duplicates_of_nothing_and_of_repeated_rows(docs):
    assert near_duplicates(docs("a").limit(0)).count() == 0
    rows = docs("a b c d e f", "a b c d e f")
    got = near_duplicates(rows.union(rows).withColumn("doc_id", F.when(F.col("doc_id") == 0, F.lit(7)))).collect()
    assert sorted((r.doc_id is None, r.component_id, r.kept) for r in got) == [(False, 7, True)] * 2 + [(True, 7, False)] * 2


def test_components(spark):
    edges = [(3, 2), (2, 9), (9, 3), (5, 5), (None, 1), (20, 21), *((k, k + 1) for k in range(100, 140))]
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {2: 2, 3: 2, 9: 2, 20: 20, 21: 20, **{k: 100 for k in range(100, 141)}}


# --- repeated byte strings


def without_repeats(texts, length):
    bodies = [(t or "").encode() for t in texts]
    seen = Counter(b[k : k + length] for b in bodies for k in range(len(b) - length + 1))
    out = []
    for b in bodies:
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if seen[b[k : k + length]] > 1:
                gone[k : k + length] = b"\1" * length
        runs = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((len(b), sum(gone), runs, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    return out


@pytest.mark.parametrize(("held", "few"), [(None, None), (2000, -1)])
def test_repeated_spans_match_brute_force(docs, monkeypatch, held, few):
    import basketry.llm.substrings as module

    if held:  # groups too large for a task, and no side small enough to send around
        monkeypatch.setattr(module, "HELD_BYTES", held)
        monkeypatch.setattr(module, "BROADCAST_ROWS", few)
    rng = random.Random(3)
    bases = [noise(rng, 1500) for _ in range(3)]
    texts = [*ODD, "a" * 399, "a" * 400, "ab" * 700, bases[0], bases[0], bases[1][:900] + "X" + bases[1][900:], bases[1], bases[2][:500] + bases[2][100:700]]
    for _ in range(30):
        a = rng.randrange(900)
        part = list(rng.choice(bases)[a : a + rng.randrange(300, 900)])
        part[rng.randrange(len(part))] = "Z"
        texts.append("".join(part))
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeated_spans(docs(*texts)).collect()}
    assert [got[k] for k in range(len(texts))] == without_repeats(texts, 400)


def test_repeated_spans_of_nothing_and_of_nameless_rows(docs):
    assert repeated_spans(docs("a").limit(0)).count() == 0
    rows = docs("q" + noise(random.Random(1), 500)).withColumn("doc_id", F.lit(None).cast("long"))
    assert {(r.n_removed, r.n_spans) for r in repeated_spans(rows.union(rows)).collect()} == {(r, 1) for r in [repeated_spans(rows.union(rows)).first().n_bytes]}


# --- decontamination


def plain_words(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def contaminated(texts, items):
    windows: dict = {}
    for k, t in enumerate(items):
        w = plain_words(t)
        for x in [w] if 0 < len(w) < 10 else [w[j : j + 10] for j in range(len(w) - 9)]:
            windows.setdefault(tuple(x), set()).add(str(k))
    out = []
    for t in texts:
        w, hit, names = plain_words(t), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if (x := tuple(w[k : k + n])) in windows:
                    hit |= set(range(k, k + n))
                    names |= windows[x]
        out.append((len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)))
    return out


@pytest.mark.parametrize("few", [100_000, -1])
def test_decontamination_matches_brute_force(spark, docs, monkeypatch, few):
    monkeypatch.setattr(winnowing, "BROADCAST_ROWS", few)
    rng = random.Random(2)
    letters = ["a", "b", "É", "c1"]
    texts = [*ODD, "..."] + [" ".join(rng.choice(letters) for _ in range(rng.randrange(1, 60))) for _ in range(40)]
    items = [None, "!", "a A b", "É", "a " * 12] + [" ".join(rng.choice(letters) for _ in range(rng.randrange(2, 14))) for _ in range(25)]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    names = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    got = {r.doc_id: tuple(r[n] for n in names) for r in winnowing.decontaminate(docs(*texts), bench).collect()}
    assert [got[k] for k in range(len(texts))] == contaminated(texts, items)


def test_decontamination_without_items_or_documents(spark, docs):
    none = spark.createDataFrame([], "item_id long, text string")
    assert [r.n_hit for r in winnowing.decontaminate(docs("a b"), none).collect()] == [0]
    assert winnowing.decontaminate(docs("a").limit(0), none).count() == 0


# --- quality


def base_counts(text):
    w, body = words(text), text or ""
    windows = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
    repeated = {j for k in range(len(w) - 4) if windows[tuple(w[k : k + 5])] > 1 for j in range(k, k + 5)}
    lines = [x for x in body.split("\n") if words(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", body)), len(lines) - len(set(lines)), len(repeated)


def test_quality_counts_and_verdicts(docs):
    rng = random.Random(8)
    texts = [*ODD, "a|b\na|b\n \na|b", "#x $y\n" * 4] + [noise(rng, 300, "ab \n*") for _ in range(20)]
    rows = {r.doc_id: r for r in quality(docs(*texts)).collect()}
    for k, t in enumerate(texts):
        r, expected = rows[k], base_counts(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == expected
        assert r.base_failed == (expected[0] < 10 or 100 * expected[4] > 20 * expected[0])
        assert not (r.kept and r.base_failed)
    vocabulary = Vocabulary(PIECES)
    import sentencepiece

    file = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    assert [rows[k].n_tokens for k in range(8)] == [sum(len(file.encode(w)) for w in words(t)) for t in texts[:8]]
    assert len(vocabulary.byte) == 256
    assert good_only(docs(*texts)).columns == docs("a").columns
    assert quality(docs("a").limit(0)).count() == 0


@pytest.mark.parametrize("texts", [[None], [""], [None, ""], ["\n \n"], ["", "one", None]])
def test_quality_of_batches_without_words(docs, texts):
    rows = quality(docs(*texts).coalesce(1)).collect()
    assert len(rows) == len(texts) and all(r.base_failed and not r.kept and r.n_words <= 1 for r in rows)
    assert good_only(docs(*texts)).count() == 0


PROSE = """The city council met on Tuesday evening to discuss the proposed changes to the public transport network. Several
residents spoke against the plan, arguing that longer routes would make it harder for older people to reach the hospital. The
mayor said that the current system costs too much and that fewer passengers have used the buses since the new bridge opened
last year. A decision is expected before the end of the month, although members of the opposition have asked for more time to
study the figures."""


def test_quality_keeps_ordinary_prose(docs):
    rows = quality(docs(PROSE, PROSE.replace("\n", " "))).collect()
    assert all(r.kept for r in rows)


def test_quality_separates_labelled_texts(spark):
    folder = "/root/testdata/sf0.01"
    judged = quality(spark.read.parquet(f"{folder}/documents.parquet")).where("not base_failed")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    share = {r.quality: r.kept for r in judged.join(labels, "doc_id").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept")).collect()}
    assert share[1] > 0.99 and share[0] < 0.1


# --- licences


def test_licence_texts(docs):
    mit = KNOWN["MIT"][1]
    texts = ["Released UNDER the mit licence!!", "Copyright (c) 2020 Foo\n(c) bar\n\n" + mit.replace('"', "“"), mit.replace("sublicense", "sublicence"), mit + " more", None, "", "© 1"]
    got = {r.doc_id: r.licence for r in scan(docs(*texts)).collect()}
    assert [got[k] for k in range(len(texts))] == ["MIT", "MIT", "MIT", None, None, None, None]
    assert scan(docs("a").limit(0)).count() == 0


def test_licences_within_documents_and_full_texts(docs):
    mit, isc = KNOWN["MIT"][1], KNOWN["ISC"][0]
    wrapped = "some words\n\nThis work is licensed under the GNU\nGeneral Public License, version 3.\n\nmore"
    texts = ["MIT License\n\nCopyright (c) 2020 Foo\n\n" + mit, "ISC License\n\nCopyright 2020 Foo\n\n" + isc, "Some words.\nReleased under the MIT licence\nmore words", wrapped]
    texts += ["A line. All rights reserved. Licensed under CC BY-NC 4.0. The end", "the MIT License is one of many"]
    texts += [p.read_text() for p in sorted(TEXTS.glob("*.txt"))]
    got = {r.doc_id: (r.licence, r.licences) for r in scan(docs(*texts)).collect()}
    first = [got[k][0] for k in range(len(texts))]
    assert first == ["MIT", "ISC", "MIT", "GPL-3.0-only", "CC-BY-NC-4.0", None, "Apache-2.0", "BSD-3-Clause", "GPL-3.0-only", "MPL-2.0"]
    assert got[4][1] == ["CC-BY-NC-4.0", "LicenseRef-all-rights-reserved"] and got[5][1] == []


# --- pieces


def segmentations(text, vocabulary):
    if not text:
        return [0]
    out = []
    for end in range(1, min(len(text), vocabulary.longest) + 1):
        found = vocabulary.score.get(text[:end])
        value = found[0] if found else vocabulary.unknown if end == 1 else None
        if value is not None:
            out += [value + rest for rest in segmentations(text[end:], vocabulary)]
    return out


def test_best_segmentations_match_enumeration(docs):
    rng, vocabulary = random.Random(1), Vocabulary(PIECES)
    texts = [None, "", " ", "a  b", "\tq\n", "▁x", "日本 é"] + [noise(rng, rng.randrange(1, 10), "theofin é日 \n") for _ in range(40)]
    encoded = encode(docs(*texts), n_best=3)
    rows = {r.doc_id: r for r in encoded.collect()}
    for k, t in enumerate(texts):
        scores = sorted(segmentations("▁" + t.replace(" ", "▁"), vocabulary), reverse=True)[:3] if t else []
        assert list(rows[k].scores) == scores and rows[k].round_trip
        assert len(rows[k].changes) in (0, len(scores))
    back = {r.doc_id: r.text for r in decoded(encoded).collect()}
    assert [back[k] for k in range(len(texts))] == [(t or "").replace("▁", " ") for t in texts]
    assert encode(docs("a").limit(0)).count() == 0
    best = nbest(["▁the", "▁in"], vocabulary, 4)
    assert [s for s, _ in best] == sorted((s for s, _ in best), reverse=True) and len({str(x) for x in best}) == 4


# --- surrogates


def test_surrogates_keep_type_format_and_coreference(docs):
    texts = ["Foo.Bar@x.com foo.bar@x.com z@x.com", "+1 (526) 555-9022, 89.89.56.213", "4111 1111 1111 1111 4777431686562174 123-45-6789", "Frau Müller, Mr. Иванов, Mrs Maria", None, "", "plain 12 text"]
    got = {r.doc_id: r for r in surrogates.pseudonymise(docs(*texts)).collect()}
    a, b, c = got[0].text.split()
    assert a == b != c and "@" in a and not a.startswith("Foo")
    assert re.fullmatch(r"\+1 \(\d{3}\) \d{3}-\d{4}, \d+\.\d+\.\d+\.\d+", got[1].text) and got[1].n_entities == 2
    card = re.fullmatch(r"(4\d{3} \d{4} \d{4} \d{4}) (4\d{15}) \d{3}-\d{2}-\d{4}", got[2].text)[1].replace(" ", "")
    digits = [int(d) for d in card]
    assert (sum(digits[1::2]) + sum(sum(divmod(2 * d, 10)) for d in digits[::2])) % 10 == 0 and card != "4" + "1" * 15
    assert re.fullmatch(r"Frau [A-Z]\w{4}r, Mr\. [А-Я][а-я]{4}в, Mrs [A-Z][a-z]{3}a", got[3].text)
    assert (got[4].text, got[5].text, got[6].text) == (None, "", "plain 12 text")
    assert surrogates.pseudonymise(docs("a").limit(0)).count() == 0


def test_surrogates_that_collide_are_drawn_again(docs, monkeypatch):
    own = surrogates.surrogate

    def few(kind, mention, attempt, key):
        place = F.pmod(F.hash(surrogates.canonical(kind, mention)) + attempt * 5, F.lit(40)).cast("string")
        return F.when(kind == "ip", F.concat(F.lit("1.1.1."), place)).otherwise(own(kind, mention, attempt, key))

    monkeypatch.setattr(surrogates, "surrogate", few)
    texts = [f"ip 9.9.9.{k} and 1.1.1.{k % 3} again 9.9.9.{k}" for k in range(12)]
    found = [re.findall(r"\d+\.\d+\.\d+\.\d+", r.text) for r in surrogates.pseudonymise(docs(*texts)).collect()]
    assert all(x[0] == x[2] for x in found)
    assert len({y for x in found for y in x}) == 15
    assert not {y for x in found for y in x} & {f"1.1.1.{k}" for k in range(3)}


@pytest.mark.parametrize(
    "text, kind",
    [("+1-555-123-4567", "phone"), ("1-555-123-4567", "phone"), ("+15551234567", "phone"), ("5551234567", "phone"), ("+49 30 1234567", "phone"), ("(030) 123-4567", "phone"),
     ("555-123-4567", "phone"), ('API_KEY = "abcdefgh1234"', "secret"), ("PASSWORD: hunter2hunter2", "secret"), ("my_password=hunter2hunter2", "secret"), ("token=abcdefgh", "secret"),
     ("api-key: 12345678abc", "secret")],
)
def test_forms_of_numbers_and_secrets(docs, text, kind):
    row = surrogates.pseudonymise(docs(f"before {text} after, on 12 May 2024 at 10:30 for 1,234,567 or 1700000000")).collect()[0]
    assert row.n_entities == 1 and text.strip('"') not in row.text
    assert row.text.startswith("before ") and row.text.endswith(" after, on 12 May 2024 at 10:30 for 1,234,567 or 1700000000")
    kept = re.sub(r"\d", "0", row.text) if kind == "phone" else ""
    assert kind != "phone" or kept == re.sub(r"\d", "0", f"before {text} after, on 12 May 2024 at 10:30 for 1,234,567 or 1700000000")


def test_more_names_than_a_form_has_room_for(docs):
    """Two letters, of which the last stays: 16 surrogates at most before they grow."""
    names = [f"{a}i" for a in "BCDFGHKLMNPRSTVZ"]
    rows = surrogates.pseudonymise(docs(*[f"Mr {n} met Mr {n}" for n in names], "Mr Հայկ left")).collect()
    found = [re.findall(r"Mr (\w+)", r.text) for r in sorted(rows, key=lambda r: r.doc_id)]
    assert all(x[0] == x[-1] for x in found)
    new = [x[0] for x in found]
    assert len(set(new)) == 17 and not set(new) & {*names, "Հայկ"} and all(n.endswith("i") for n in new[:16])


def test_names_of_columns_do_not_clash(spark):
    df = spark.createDataFrame([("Mr Foo", "a", "b", "c", 7)], "text string, __hash string, __attempts string, __new string, n_entities int")
    row = surrogates.pseudonymise(df.union(spark.createDataFrame([("Mr Li", "a", "b", "c", 7), ("Mr Ti", "a", "b", "c", 7)], df.schema))).collect()
    assert all((r["__hash"], r["__attempts"], r["__new"], r.n_entities) == ("a", "b", "c", 1) for r in row)


# --- shards


def test_shards_are_even_and_slots_gapless(spark, docs, tmp_path):
    rng = random.Random(5)
    texts = [*ODD] + [noise(rng, rng.randrange(1, 300)) for _ in range(400)]
    rows = shard(docs(*texts), shards=7, slots=512, folder=str(tmp_path / "map")).collect()
    assert {r.doc_id: r.text_crc32 for r in rows} == {k: zlib.crc32((t or "").encode()) for k, t in enumerate(texts)}
    assert {r.doc_id: r.size for r in rows} == {k: len((t or "").encode()) + 16 for k, t in enumerate(texts)}
    loads = Counter()
    for k in range(7):
        own = [r for r in rows if r.shard == k]
        assert sorted(r.slot for r in own) == list(range(len(own)))
        loads[k] = sum(r.size for r in own)
    assert max(loads.values()) - min(loads.values()) <= 0.02 * max(loads.values())
    one, two = (load_map(spark, str(tmp_path / "map"), v) for v in (1, 2))
    assert all(two[r.virtual_slot] == r.shard for r in rows) and set(one) == set(two)
    assert shard(docs("a").limit(0), shards=3, slots=16).count() == 0


def test_a_stored_map_is_edited(spark, docs, tmp_path):
    rng = random.Random(6)
    texts, folder = [noise(rng, rng.randrange(1, 300)) for _ in range(300)], str(tmp_path / "map")
    first = {r.doc_id: r.shard for r in shard(docs(*texts), shards=5, slots=256, folder=folder).collect()}
    again = {r.doc_id: r.shard for r in shard(docs(*texts), shards=5, slots=256, folder=folder).collect()}
    grown = {r.doc_id: r.shard for r in shard(docs(*texts), shards=6, slots=256, folder=folder).collect()}
    assert newest_version(spark, folder) == 4 and first == again
    moved = [k for k in first if grown[k] != first[k]]
    assert 0 < len(moved) < 0.4 * len(texts) and set(grown.values()) == set(range(6))
    with pytest.raises(ValueError, match="256 slots"):
        shard(docs(*texts), shards=5, slots=64, folder=folder)


def test_rebalancing_moves_only_what_it_must():
    sizes = {k: 10 for k in range(100)}
    even = {k: k % 10 for k in range(100)}
    assert rebalance(even, sizes, 10) == even
    more = rebalance(even, sizes, 11)
    assert sum(more[k] != even[k] for k in even) <= 10 and {more[k] for k in even if more[k] != even[k]} == {10}
    assert set(rebalance(even, sizes, 9).values()) == set(range(9))
