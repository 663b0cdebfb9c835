"""Main text of web pages by template deduction over the pages of a host.

A token is a start tag in its role (the path of tags, classes and ids that leads to it) or a whole text in its role.
Tokens with the same occurrence vector over a host's pages (how often they occur on each) form an equivalence class.
Classes that most pages have make the template if they are valid: their tokens come in one order on every page, and
each class lies in one gap of the other. What lies between the template's tokens are slots. Texts of the template and
slots of menus, adverts, forms and the like are left out; the remaining slots are the article.
"""

from __future__ import annotations

import hashlib
import html
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.llm import hashing as H
from basketry.session import stage

#: A class belongs to the template if at least this share of a host's different pages has it, and LEAST_PAGES do.
SHARE, LEAST_PAGES = 0.6, 4
#: A slot outside an article with more of its characters than this in links is a menu.
LINKS = 0.5
#: Hosts whose templates (some kilobytes each) may be sent to every executor; beyond, pages are dealt out by host and salt.
BROADCAST_HOSTS = 5_000
SALTS = 64

_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*+)>", re.S)
_CUT = re.compile(r"<[/a-zA-Z!?]")
_ATTRIBUTE = re.compile(r"([a-zA-Z_:][\w:.-]*)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_TELLING = re.compile(r"class|\bid\b|role|hidden|style", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")

# Fixed values of HTML and of common page markup
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title noscript iframe template svg math object noembed noframes xmp".split())
BLOCKS = set(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html "
    "legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
CLOSE_P = BLOCKS - set("td th tr tbody thead tfoot li dd dt".split())
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}
DROPPED_TAGS = set("head nav footer aside form button select option label fieldset dialog menu search audio video canvas".split())
DROPPED_ROLES = set("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar".split())
DROPPED_WORDS = set(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion promoted sidebar nav navbar navigation menu breadcrumb breadcrumbs footer "
    "cookie cookies consent gdpr notice notices notification popup modal overlay comment comments commentlist disqus share sharing social related recommended newsletter "
    "subscribe subscription signup login search widget toolbar pagination pager masthead skip copyright".split()
)
PAGE_WORDS = {"header", "banner", "top", "bar"}
#: Names that begin so tell what an element has or lacks beside it, not what it is; a part named so is a plain wrapper.
DESCRIBING = set("with without no not non has have is hide hidden show skip above below before after".split())
WRAPPERS = {"widget"}
ARTICLE = {"article", "main"}


class Page:
    """Start tags and texts of a page, each with the hash of its role; what the page shows of them is judged later."""

    def __init__(self, source: str):
        self.tokens: list[tuple[int, str | None, bool, bool, bool, int]] = []  # role, text, dropped, in article, in link, block
        stack: list[tuple[str, int, bool, bool, bool]] = [("", 0, False, False, False)]
        block, at, apart = 0, 0, ""

        def text(value: str) -> None:
            nonlocal apart
            if value and not value.isspace():
                _, role, dropped, article, link = stack[-1]
                self.tokens.append((role, apart + value, dropped, article, link, block))
                apart = ""
            elif value:
                apart = " "

        def close(names: set[str], scope: set[str]) -> None:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] in names:
                    del stack[k:]
                    return
                if stack[k][0] in scope:
                    return

        while at < len(source):
            found = _TOKEN.search(source, at)
            if found is None:
                cut = _CUT.search(source, at)  # a tag that the page's end cuts off
                text(source[at : cut.start()] if cut else source[at:])
                break
            text(source[at : found.start()])
            at = found.end()
            if found[2] is None:
                if found[0].startswith("<![CDATA["):
                    text(html.escape(found[0][9:].removesuffix("]]>")))
                continue
            name = found[2].lower()
            if name in BLOCKS:
                block += 1
            if found[1]:
                if name == "p" and not any(s[0] == "p" for s in stack):
                    continue
                close({name}, {"table"} if name not in BLOCKS else set())
                continue
            if name in CLOSE_P:
                close({"p"}, BLOCKS - {"p"})
            if name in SIBLINGS:
                close(SIBLINGS[name], SCOPES[name])
            _, above, dropped, article, link = stack[-1]
            marks, drop = self._marks(name, found[3], article or name in ARTICLE)
            role = _remembered(_role, above, name, marks)
            self.tokens.append((role, None, dropped or drop, article or name in ARTICLE, link or name == "a", block))
            if name in RAW:
                end = re.compile(rf"</{name}\b[^>]*>", re.I).search(source, at)
                at = end.end() if end else len(source)
            elif name in VOID:
                apart = " "  # a line break or picture is white space within its block
            else:
                stack.append((name, role, dropped or drop, article or name in ARTICLE, link or name == "a"))

    @staticmethod
    def _marks(name: str, attributes: str, in_article: bool) -> tuple[str, bool]:
        """What of the attributes belongs to the role, and whether they or the tag name something other than an article."""
        drop = name in DROPPED_TAGS or (name == "header" and not in_article)
        return _remembered(Page._told, name, attributes, in_article, drop) if _TELLING.search(attributes) else ("", drop)

    @staticmethod
    def _told(name: str, attributes: str, in_article: bool, drop: bool) -> tuple[str, bool]:
        """_marks() of attributes with something to tell, which the pages of a host repeat."""
        found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(attributes)}
        kinds = f"{found.get('class', '')} {re.sub('[0-9]+', '', found.get('id', ''))}"
        if name not in ("html", "body", *ARTICLE):
            drop = drop or any(_remembered(_names_no_article, kind, in_article) for kind in kinds.split())
        role = found.get("role", "").lower()
        hidden = "hidden" in found or found.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", found.get("style", ""))
        return f".{kinds.strip()}@{role}" if kinds.strip() or role else "", bool(drop or role in DROPPED_ROLES or hidden)


#: What a worker has worked out of late; pages of a host repeat it. (A plain dictionary travels with the functions.)
_MEMORY: dict[tuple, object] = {}


def _remembered(work, *given):
    key = (work.__name__, *given)
    if (found := _MEMORY.get(key)) is None:
        if len(_MEMORY) > 1 << 16:
            _MEMORY.clear()
        found = _MEMORY[key] = work(*given)
    return found


def _names_no_article(kind: str, in_article: bool) -> bool:
    """Whether a class or id names a menu, advert or the like: by its first or last word, as in footer-links or site-footer.

    with-sidebar, no-ads or has-comments describe an element that may hold the article, and widget-text wraps one.
    """
    words = [w.lower() for w in _WORD.findall(kind)]
    if not words:
        return False
    first, last = words[0], words[-1]
    if first == "skip" and len(words) > 1 and words[1] in ("link", "links", "nav", "navigation", "to"):
        return True
    if len(words) > 1 and first in DESCRIBING:
        return False
    named = {last} | ({first} - (WRAPPERS if len(words) > 1 else set()))
    return bool(named & DROPPED_WORDS) or (not in_article and "header" in named)


def hash_text(value: str) -> int:
    """63-bit hash of a string, the same in every process."""
    return int.from_bytes(hashlib.blake2b(value.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big") >> 1


def _role(above: int, name: str, marks: str) -> int:
    """Hash of a role from that of the element above; pages of a host have few different ones."""
    return hash_text(f"{above}/{name}{marks}")


def _plain(value: str) -> str:
    return " ".join((html.unescape(value) if "&" in value else value).split())


def _keys(page: Page) -> list[int]:
    """The token of each entry: a start tag's role, or a text in its role."""
    return [role if text is None else hash_text(f"{role}={_plain(text)}") for role, text, *_ in page.tokens]


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, token, part, page): a summand of each token's occurrence vector."""
    for batch in batches:
        hosts, tokens, pages, counts = [], [], [], []
        for host, key, source in zip(batch.column("host").to_pylist(), batch.column("page_key").to_pylist(), batch.column("html").to_pylist(), strict=True):
            own = Counter(_keys(Page(source)))
            hosts += [host] * len(own)
            pages += [key] * len(own)
            tokens += own.keys()
            counts += own.values()
        mixed = H.mix(np.array(pages, np.int64).view(np.uint64) + np.array(counts, np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(tokens, pa.int64()), pa.array((mixed >> np.uint64(1)).astype(np.int64)), pa.array(pages, pa.int64())], ["host", "token", "part", "page_key"])


_ORDER, _GAP, _SLOT = 0, 1, 2


def _slot(role: int, last: int) -> int:
    return (role * 31 + last) & 0x7FFFFFFFFFFFFFFF


def _slots(page: Page, keys: list[int], template: set[int]) -> Iterator[tuple[int, int]]:
    """(entry, slot) of the texts that are not the template's; a slot is the innermost template role around a text."""
    last = 0
    for k, (role, text, *_) in enumerate(page.tokens):
        if text is None:
            if keys[k] in template:
                last = role
        elif keys[k] not in template:
            yield k, _slot(role if role in template else 0, last)


def _gaps(outer: list[int], size: int, inner: list[int]) -> tuple[int, int]:
    """Least and largest gap of a class's tokens, in rounds of ``size``, in which the places ``inner`` lie; before is after."""
    if len(outer) == size:
        low, high = bisect_left(outer, inner[0]), bisect_left(outer, inner[-1])
        if low == high or low > 0 and high < size:
            return low % size, high % size
        if bisect_left(inner, outer[0]) == bisect_left(inner, outer[-1]):
            return 0, 0
    found = np.searchsorted(outer, inner) % size
    return int(found.min()), int(found.max())


def _evidence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """By host: the order of each class's tokens, the gap of one class in which another lies, and characters by slot.

    A batch's pages are summed up before they leave the task.
    """
    for batch in batches:
        orders: set[tuple] = set()
        gaps: dict[tuple, tuple[int, int]] = {}
        chars: dict[tuple, list[int]] = {}
        for n, (host, source, entries) in enumerate(zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), batch.column("tokens").to_pylist(), strict=True)):
            classes = {e["token"]: e["group"] for e in entries or ()}
            if not classes:
                continue
            page = Page(source)
            keys = _keys(page)
            sizes = Counter(classes.values())
            places: dict[int, list[int]] = {}
            for k, key in enumerate(keys):
                if key in classes:
                    places.setdefault(classes[key], []).append(k)
            for group, found in places.items():
                size = sizes[group]
                rounds = {tuple(keys[k] for k in found[r : r + size]) for r in range(0, len(found), size)}
                one = next(iter(rounds))
                good = len(rounds) == 1 and len(set(one)) == size
                orders.add((host, group, hash_text(str(one)) if good else -1 - n))
                for other, inner in places.items():
                    if other != group:
                        low, high = _gaps(found, size, inner)
                        at = host, group, other
                        was = gaps.get(at)
                        gaps[at] = (low, high) if was is None else (min(low, was[0]), max(high, was[1]))
            for k, slot in _slots(page, keys, set(classes)):
                _, text, dropped, article, link, _ = page.tokens[k]
                if not dropped:
                    sums = chars.setdefault((host, slot), [0, 0])
                    sums[0] += len(text)
                    sums[1] += len(text) if link and not article else 0
        out = [(host, _ORDER, group, 0, order, 0) for host, group, order in orders]
        out += [(host, _GAP, group, other, low, high) for (host, group, other), (low, high) in gaps.items()]
        out += [(host, _SLOT, slot, 0, a, b) for (host, slot), (a, b) in chars.items()]
        columns = list(zip(*out, strict=True)) or [()] * 6
        kinds = [pa.string(), pa.int32(), *[pa.int64()] * 4]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["host", "kind", "a", "b", "low", "high"])


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, slots_of = [], []
        for source, tokens, menus in zip(batch.column("html").to_pylist(), batch.column("tokens").to_pylist(), batch.column("menus").to_pylist(), strict=True):
            page = Page(source or "")
            keys = _keys(page)
            template = set(tokens or ())
            menu = set(menus or ())
            chosen = [(k, slot) for k, slot in _slots(page, keys, template) if not page.tokens[k][2] and slot not in menu]
            if any(page.tokens[k][3] for k, _ in chosen):
                chosen = [(k, slot) for k, slot in chosen if page.tokens[k][3]]
            blocks: dict[int, list[str]] = {}
            own = {page.tokens[k][5] for k, _ in chosen}
            for _, value, dropped, _, _, block in page.tokens:
                if value is not None and block in own and not dropped:  # the template's words within a slot's block belong to it
                    blocks.setdefault(block, []).append(value)
            lines = [line for parts in blocks.values() if (line := _plain("".join(parts)))]
            texts.append("\n".join(lines))
            slots_of.append(len({s for _, s in chosen}))
        yield pa.RecordBatch.from_arrays(
            [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), pa.array(slots_of, pa.int64())],
            ["page_id", "url", "text", "n_chars", "n_slots"],
        )


def _with_template(pages: DataFrame, templates: DataFrame) -> DataFrame:
    """Pages with their host's row of ``templates`` (staged). A hot host's pages are spread by a salt."""
    if templates.count() <= BROADCAST_HOSTS:
        return pages.join(F.broadcast(templates), "host", "left")
    salted = templates.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return pages.withColumn("salt", F.pmod("page_key", F.lit(SALTS)).cast("int")).join(salted, ["host", "salt"], "left").drop("salt")


def extract(pages: DataFrame) -> DataFrame:
    """One row per row of ``pages`` (page_id, url, html): page_id, url, text, n_chars, n_slots.

    Null and empty pages give an empty text, unreadable markup is taken as it comes (unclosed tags end with their
    parent). A page without a usable url belongs to the host ''. Exact copies count once as evidence of a template,
    so copied or repeated pages don't turn their article into one. Hosts with few pages have no template; their
    texts are judged by markup alone. Other columns are ignored.
    """
    host = F.regexp_extract(F.lower(F.coalesce("url", F.lit(""))), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)
    plain = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", host.alias("host"), F.coalesce("html", F.lit("")).alias("html"))
    plain = plain.withColumn("page_key", F.xxhash64("html"))
    vectors = plain.select("host", "page_key", "html").mapInArrow(_vectors, "host string, token long, part long, page_key long")
    # numbers of different pages, about exact up to some thousands and within 2 % beyond
    hosts = plain.groupBy("host").agg(F.approx_count_distinct("page_key", 0.02).alias("n_pages"))
    found = vectors.groupBy("host", "token").agg(F.sum(F.pmod("part", F.lit(1 << 32))).alias("vector"), F.approx_count_distinct("page_key", 0.02).alias("support"))
    classes = (
        found.join(hosts, "host")
        .where((F.col("support") >= SHARE * F.col("n_pages")) & (F.col("support") >= LEAST_PAGES))
        .select("host", "token", F.xxhash64("vector", "support").alias("group"))
    )
    candidates = stage(classes.groupBy("host").agg(F.sort_array(F.collect_list(F.struct("token", "group"))).alias("tokens")), "classes")
    evidence = _with_template(plain.select("host", "page_key", "html"), candidates).where("tokens is not null").mapInArrow(
        _evidence, "host string, kind int, a long, b long, low long, high long"
    )
    characters = F.when(F.col("kind") == _SLOT, F.array("low", "high"))
    summed = stage(
        evidence.groupBy("host", "kind", "a", "b").agg(F.min("low").alias("low"), F.max("low").alias("most"), F.max("high").alias("high"), F.sum(characters.getItem(0)).alias("chars"), F.sum(characters.getItem(1)).alias("links")), "evidence"
    )
    ordered = summed.where(f"kind = {_ORDER} and low = most and low >= 0").select("host", F.col("a").alias("group"))
    # two ordered classes are at odds if neither lies in one gap of the other
    split = summed.where(f"kind = {_GAP} and low < high").select("host", "a", "b")
    for end in ("a", "b"):
        split = split.join(ordered.withColumnRenamed("group", end), ["host", end], "left_semi")
    odd = split.join(split.select("host", F.col("a").alias("b"), F.col("b").alias("a")), ["host", "a", "b"], "left_semi").select("host", F.greatest("a", "b").alias("group")).distinct()
    valid = ordered.join(odd, ["host", "group"], "left_anti")
    kept = candidates.select("host", F.explode("tokens").alias("t")).select("host", "t.token", "t.group").join(valid, ["host", "group"], "left_semi")
    menus = summed.where(f"kind = {_SLOT} and links > {LINKS} * chars").groupBy("host").agg(F.collect_list("a").alias("menus"))
    templates = stage(kept.groupBy("host").agg(F.collect_list("token").alias("tokens")).join(menus, "host", "full"), "templates")
    joined = _with_template(plain, templates)
    return joined.select("page_id", "url", "html", "tokens", "menus").mapInArrow(_texts, "page_id long, url string, text string, n_chars long, n_slots long")
