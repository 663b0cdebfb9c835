"""Template extraction and transcript parsing."""

from __future__ import annotations

import html
import random
import re

import pytest
from pyspark.sql import functions as F

from basketry.llm.templates import _gaps, extract
from basketry.llm.transcripts import FEATURES, ROLES, fit, lines_of, marked_turns, parse, raw_transcripts

PAGE = """<html><head><title>T &amp; x</title><style>p{}</style></head><body><div class="cookie-notice">We use cookies</div>
<header><a href=/>Home</a></header><ul class="top"><li><a href=a>One</a><li><a href=b>Two</a></ul><div id="content"><h1>Title %d</h1>
<p>text<b>%d</b> &lt;5 &nbsp; x<br>next %d</p><p>part<script>var a="</p>";</script> %d<div class=comments><p>reader says %d</p></div>
<p>Read our house rules before posting.</p></div><div class="sidebar">side %d</div><footer>foot</footer></body></html>"""


def test_template_and_slots(spark):
    rows = [(k, f"http://h.com/{k}", PAGE.replace("%d", str(k)), "u") for k in range(8)]
    rows += [(20 + k, "http://h.com/copy", PAGE.replace("%d", "c"), "u") for k in range(30)]
    rows += [
        (100, None, None, "u"), (101, "bad", "", "u"), (102, "http://one.org/", "<p>just <i>a</i> p", "u"), (103, "http://one.org/", "plain text <", "u"),
        (104, "http://one.org/", "<article><h1>A</h1>x<p>y</article><p>no</p><div cla", "u"), (105, "http://long.org/", "<p>" + "w " * 20000, "u"),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, host string")
    got = {r.page_id: r.text for r in extract(pages).collect()}
    assert got[3] == "Title 3\ntext3 <5 x next 3\npart 3"
    assert got[25] == "Title c\ntextc <5 x next c\npart c"
    assert [got[k] for k in range(100, 105)] == ["", "", "just a p", "plain text <", "A\nx\ny"]
    assert len(got[105]) == 39999
    assert extract(pages.limit(0)).count() == 0


ARTICLE_TEXT = "This is the article of page {0} and its words {0} differ."


@pytest.mark.parametrize(
    "page",
    [
        '<div class="content with-sidebar"><article><p>{0}</p></article></div>', '<body class="x"><div class="layout no-sidebar"><article><p>{0}</p></article></div>',
        '<div class="post has-comments"><article>{0}</article></div>', '<div class="entry widget-text"><article>{0}</article></div>',
        '<div class="elementor-widget-text-editor"><article>{0}</article></div>', '<main><div class="skip-ads">{0}</div></main>',
    ],
)
def test_wrappers_keep_their_article(spark, page):
    rows = [(k, f"http://one.example/{k}", "<html><body>" + page.format(ARTICLE_TEXT.format(k)) + '<div class="site-footer">foot</div></body></html>') for k in range(6)]
    got = {r.page_id: r.text for r in extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {k: ARTICLE_TEXT.format(k) for k in range(6)}


def test_only_the_template_tells(spark):
    """No article, menu or class: what a host's pages share goes, what differs stays."""
    rows = [
        (k, f"http://two.example/{k}", f"<html><body><table><tr><td>Home</td><td>About us</td></tr></table><div><p>{ARTICLE_TEXT.format(k)}</p><p>More on {k}.</p></div><table><tr><td>Imprint and more</td></tr></table></body></html>")
        for k in range(8)
    ]
    got = {r.page_id: r.text for r in extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {k: f"{ARTICLE_TEXT.format(k)}\nMore on {k}." for k in range(8)}


def test_gaps_equal_a_scan():
    rng = random.Random(3)
    for _ in range(300):
        size, rounds = rng.randrange(1, 4), rng.choice([1, 1, 2])
        places = sorted(rng.sample(range(40), size * rounds + rng.randrange(1, 6)))
        outer = sorted(rng.sample(places, size * rounds))
        inner = [p for p in places if p not in outer]
        found = [sum(o < p for o in outer) % size for p in inner]
        assert _gaps(outer, size, inner) == (min(found), max(found))


def test_articles_of_the_test_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: (r.text, r.n_chars) for r in extract(pages).collect()}
    for r in pages.collect():
        article = re.search(r"<article>(.*?)(</article>|$)", r.html, re.S)[1]
        parts = (re.sub(r"\s+", " ", html.unescape(re.sub("<[^>]+>", "", p))).strip() for p in re.split(r"</?(?:p|h1)>", article))
        text = "\n".join(p for p in parts if p)
        assert got[r.page_id] == (text, len(text))


def bare(text):
    """A turn as it is rendered: lines without white space around them, blank ones left out."""
    return "\n".join(x.strip() for x in (text or "").split("\n") if x.strip())


def test_roles_of_held_out_transcripts(spark):
    talks = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    turns = parse(raw_transcripts(talks), fit(marked_turns(talks).where("conv_id % 2 = 0"))).where("conv_id % 2 = 1")
    assert turns.where("not rendered like '<|%|>%<|end|>%' or rendered like '%<|end|>%<|end|>%'").count() == 0
    found, lines = {(r.conv_id, r.role, r.text) for r in turns.collect()}, {}
    for r in turns.collect():
        for line in r.text.split("\n"):
            lines[r.conv_id, line] = r.role
    true = [(r.conv_id, r.role, bare(r.text)) for r in talks.where("conv_id % 2 = 1").collect()]
    whole = sum(t in found for t in true) / len(true)
    # of a turn without a marker the first line may pass for the turn before it
    role = [lines.get((c, line)) == r for c, r, text in true for line in text.split("\n") if line]
    print(f"turns found whole {whole:.3f}, lines with the right role {sum(role) / len(role):.3f}")
    assert whole > 0.5 and sum(role) / len(role) > 0.75


def path_score(states, features, fitted):
    emit = [sum(fitted[n][s][f[n]] for n in FEATURES) for s, f in zip(states, features)]
    return fitted["moves"][-1][states[0]] + sum(fitted["moves"][a][b] for a, b in zip(states, states[1:])) + sum(emit)


def best_path(features, fitted):
    """Viterbi in plain Python over one list of lines."""
    emit = [[sum(fitted[n][s][f[n]] for n in FEATURES) for s in range(2 * len(ROLES))] for f in features]
    score = [fitted["moves"][-1][s] + emit[0][s] for s in range(6)]
    for e in emit[1:]:
        ways = [max(range(6), key=lambda a: score[a] + fitted["moves"][a][s]) for s in range(6)]
        score = [score[ways[s]] + fitted["moves"][ways[s]][s] + e[s] for s in range(6)]
    return max(score)


@pytest.mark.parametrize("block", [64, 3])
def test_turns_are_those_of_the_best_path(spark, monkeypatch, block):
    import basketry.llm.transcripts as module

    monkeypatch.setattr(module, "BLOCK", block)
    talks = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    fitted = fit(marked_turns(talks))
    logs = raw_transcripts(talks.where("conv_id < 12"))
    lines = sorted(lines_of(logs).collect(), key=lambda r: (r.conv_id, r.seq, r.line_no))
    turns = sorted(parse(logs, fitted).collect(), key=lambda r: (r.conv_id, r.seq, r.line_no))
    for conv in range(12):
        own = [r for r in lines if r.conv_id == conv]
        states = []
        for t in (t for t in turns if t.conv_id == conv):
            role = ROLES.index(t.role)
            states += [2 * role + t.continued] + [2 * role + 1] * (t.n_lines - 1)
        assert len(states) == len(own)
        assert path_score(states, own, fitted) == pytest.approx(best_path(own, fitted))
        assert bare("".join(r.line for r in own)).endswith(turns[-1].text.split("\n")[-1]) or conv < 11


def test_a_turn_across_blocks_is_one_row(spark, monkeypatch):
    import basketry.llm.transcripts as module

    talks = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    fitted = fit(marked_turns(talks))
    logs = raw_transcripts(talks.where("conv_id < 8"), lines=1)
    whole = sorted(tuple(r) for r in parse(logs, fitted).collect())
    monkeypatch.setattr(module, "BLOCK", 1)
    assert sorted(tuple(r) for r in parse(logs, fitted).collect()) == whole
    assert max(r[5] for r in whole) >= 3 and all(r[-1].count("<|end|>") == 1 for r in whole)


def test_odd_transcripts(spark):
    schema = "conv_id long, seq long, text string, role string, line string"
    rows = [(1, 0, "User: hi?\nmore\n\nAssistant: yes", "user", "x"), (1, 1, None, "user", "x"), (None, 0, "Q: a\nA: b", None, "x"), (2, None, "", "user", "x"), (3, None, "bot> x", "other", "x")]
    logs = spark.createDataFrame(rows + rows[:1], schema)
    fitted = fit(logs)
    got = parse(logs, fitted).collect()
    assert {r.conv_id for r in got} == {1, None, 3}
    assert parse(logs.limit(0), fitted).count() == 0
    assert fit(logs.limit(0))["moves"]
