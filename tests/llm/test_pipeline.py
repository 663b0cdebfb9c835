"""The pipeline's stages, and every operator's registered query on the small tables."""

from __future__ import annotations

import re

import corpus_pipeline
import __spark_entry__
from basketry.llm import neardup
from basketry.llm.pieces import decoded
from basketry.session import stage

FOLDER = "/root/testdata/sf0.001"


def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    extra = docs.union(docs.limit(5)).union(spark.createDataFrame([(None, "free of ids " * 3, "en", "s", 1), (7_000_001, None, None, None, None)], docs.schema))
    counts = [extra.count()]
    for name, step in corpus_pipeline.STAGES[:-1]:
        extra = stage(step(spark, extra, FOLDER), name)
        assert extra.columns == corpus_pipeline.COLUMNS
        counts.append(extra.count())
    assert counts == sorted(counts, reverse=True) and counts[-1] > 0
    assert extra.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").count() == 0
    encoded = stage(corpus_pipeline.STAGES[-1][1](spark, extra, FOLDER), "encoded")
    back = decoded(encoded).join(extra.withColumnRenamed("text", "before"), "doc_id")
    assert encoded.count() == counts[-1] and back.where("text <> before").count() == 0


def test_near_dedup_joins_pairs_between_80_and_85(spark):
    words = [f"w{k}" for k in range(200)]
    # 196 shingles each; 12 words changed at the end: 184 common of 208 (0.885), 18: 178 of 214 (0.832), 24: 172 of 220 (0.782)
    rows = []
    for group, changed in enumerate((12, 18, 24)):
        base = [f"g{group}{w}" for w in words]
        other = base[: len(base) - changed] + [f"other{w}" for w in base[len(base) - changed :]]
        rows += [(10 * group + k, " ".join(t), "en", "s", 1) for k, t in enumerate((base, other))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, FOLDER).collect()}
    assert kept == {0, 10, 20, 21}


def test_decontamination_equals_a_search_for_every_window(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    items = spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()

    def words(text):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))

    windows = set()
    for item in items:
        own = words(item.text)
        windows |= {tuple(own[k : k + 10]) for k in range(max(1, len(own) - 9))} if own else set()
    sizes = {len(w) for w in windows}
    clean = {
        d.doc_id for d in docs.collect()
        if not any(tuple(w[k : k + n]) in windows for w in [words(d.text)] for n in sizes for k in range(len(w) - n + 1))
    }
    kept = corpus_pipeline.benchmark_decontamination(spark, docs, FOLDER)
    assert {r.doc_id for r in kept.collect()} == clean and 0 < len(clean) < docs.count()


def test_personal_data_goes_and_the_rest_stays(spark):
    docs = spark.createDataFrame(
        [(1, "write to Foo.Bar@x.com or call +1-555-123-4567 now", "en", "s", 9), (2, "nothing here", "en", "s", 12), (3, None, None, None, None), (4, "Mr Foo met Foo.Bar@x.com", "en", "s", 1)],
        "doc_id long, text string, lang string, source string, n_chars long",
    )
    got = {r.doc_id: r for r in corpus_pipeline.personal_data(spark, docs, FOLDER).collect()}
    assert got[2].text == "nothing here" and got[3].text is None and got[3].n_chars is None
    assert re.fullmatch(r"write to (\S+@\S+) or call \+1-\d{3}-\d{3}-\d{4} now", got[1].text) and "Foo" not in got[1].text and "555-123-4567" not in got[1].text
    assert re.search(r"\S+@\S+", got[1].text)[0] == re.search(r"\S+@\S+", got[4].text)[0] and not got[4].text.startswith("Mr Foo ")
    assert all(r.n_chars == len(r.text) for r in got.values() if r.text is not None)


def test_banding_finds_pairs_at_the_pipelines_threshold():
    found = (1 - (1 - 0.8**neardup.ROWS) ** neardup.BANDS) ** 2
    assert found >= 0.9998


def test_queries_are_registered():
    queries = __spark_entry__.queries()
    assert {n.split("_")[0] for n in queries if n.startswith("op")} == {f"op{k}" for k in range(1, 14)}
    assert "pipeline" in queries
