"""Main text of web pages by equivalence-class template deduction.

A page is a sequence of tokens: start tags with their path of tags and
classes, and text blocks with their path.  Tokens of one host's pages that
have the same occurrence vector (how often on which page) form an equivalence
class.  Pages count by what they hold: copies with the same sequence of tokens are one page of
the vector, so that no page becomes template by being repeated.  Classes that are frequent (``support`` of the host's pages) and have at
least three tokens may belong to the template.  A class is text, though, if its pages hold little besides while others of the host
hold articles (``trusted``): an article and its near copies differ in a line, pages under one template in
their whole text; a host whose pages all are near copies of one has no template.  On a page, a class is valid if its
tokens come in the class's order, and nested if it lies inside one gap of
each larger class; the valid, nested classes are the template, and
what lies between their tokens are slots.

Text blocks that are template tokens are boilerplate.  Slots are judged by the
path that holds them: those in navigation, header, footer, aside, form, advert, notice or comment
elements (by tag, role, class or id) are boilerplate too.  Content elements are the outermost article, main and
named content elements; if one of them holds at least as many characters as all slots outside them, the
slots inside them are the text, else (the marked ones are teasers beside an unmarked body) all slots left
are.  An article named as boilerplate is boilerplate unless it has a content name as well.  The same classes decide inside and outside such an element, on hosts
of every size: a notice that all articles open with is in the class of the page's frame, while a
passage that articles quote from each other makes a class of its own, too small to be template
(three quoted blocks with the same pages, or a notice on some pages only without tags of its own,
cannot be told apart from the class alone: the first is template, the second text).  Hosts of one page make
a group with all such pages of the same layout (tags and paths).  Inside content a class or id names boilerplate only if
all its words do.

Occurrence vectors are never built: two sums of hashes over (page, count)
stand for a vector, so a host with a third of all pages is a partial
aggregate like any other.  A host's template holds tokens on half its pages at
least, so it is no larger than a few pages; it is joined to the host's pages
(broadcast if its measured size is small).

Edge cases: null html is empty text; pages without a host have no template and
are judged by their paths alone, like pages whose layout no other host of one page shares; cut pages and unclosed tags are
parsed to the end; stray and unclosed quotes in a tag do not reach past its '>'; repeated rows share their result; very long pages are parsed whole in
linear time; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import html
import re
from bisect import bisect
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import small
from .url_filter import url_parts

# An attribute; quotes hold its value only if they come right after the '=' and are closed, all others are ordinary characters.
ATTRIBUTE = re.compile(r"""([^\s/>][^\s/>=]*)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]*))?""")
TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<[a-zA-Z/!?][^\s/>]*(?:[\s/]+|{ATTRIBUTE.pattern})*(?:>|\Z)", re.S)
NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea template noscript iframe svg xmp noembed noframes".split())
BLOCK = frozenset("""address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset
    figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre
    search section summary table tbody td tfoot th thead tr ul""".split())
RAW_END = {name: re.compile(rf"</{name}(?=[\s/>]|\Z)", re.I | re.A) for name in RAW}
#: Start tags that end an open element of the same group (up to the nearest holder).
SIBLINGS = {"li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)),
            "tr": (("tr", "td", "th"), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")),
            "option": (("option",), ("select", "datalist"))}
BOILER_TAGS = frozenset("nav aside footer form button select datalist dialog menu search head object canvas audio video".split())
BOILER_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar".split())
BOILER_NAMES = frozenset("""nav navbar navigation menu menubar breadcrumb breadcrumbs header masthead banner footer sidebar aside
    cookie cookies consent gdpr notice notices notification alert popup modal overlay ad ads advert adverts advertisement
    advertising sponsor sponsored promo promotion newsletter subscribe subscription signup login search form comment
    comments commentlist disqus reply replies respond share sharing social related recommended recommendations widget widgets
    toolbar pagination pager copyright hidden""".split())
#: Words that say nothing beside one of the names above, and names that need not stand alone inside content.
PLAIN_NAMES = frozenset("""box block button buttons bar list link links section container wrapper area panel inner outer item items
    top bottom left right main site page global""".split())
COMMENT_NAMES = frozenset("comment comments commentlist disqus reply replies respond".split())
CONTENT_NAMES = frozenset("content article post entry main story articlebody maincontent".split())
NOT_NAMES = frozenset("has with no without is".split())


def _number(*parts) -> int:
    """Stable signed 64-bit hash."""
    n = xxhash.xxh3_64_intdigest("\x00".join(map(str, parts)).encode("utf-8", "surrogatepass"))
    return n - (1 << 64) if n >> 63 else n


def _names_in(value: str) -> list[list[str]]:
    return [[w.lower() for w in WORDS.findall(x)] for x in value.split()]


def _boilerplate(words: list[str], in_content: bool) -> bool:
    """Does a class or id name boilerplate?  Inside content all its words must, so that ``share-price`` is no share box."""
    if {words[0], words[-1]} & (COMMENT_NAMES if in_content else BOILER_NAMES):
        return True
    return in_content and not set(words) <= PLAIN_NAMES and set(words) <= BOILER_NAMES | PLAIN_NAMES


class Labels:
    """What a start tag's name and attributes say, remembered by its source text (bounded)."""

    def __init__(self):
        self.known: dict[tuple, tuple] = {}

    def of(self, tag: str, name: str, path: int, in_content: bool) -> tuple[int, bool, bool]:
        """(path hash, boilerplate, content element)."""
        key = (tag, path, in_content)
        got = self.known.get(key)
        if got is None:
            if len(self.known) > 50_000:
                self.known.clear()
            got = self.known[key] = self._read(tag, name, path, in_content)
        return got

    @staticmethod
    def _read(tag, name, path, in_content):
        found = {k.lower(): html.unescape(v.strip("\"'")) for k, v in ATTRIBUTE.findall(tag, 1 + len(name))}
        names = _names_in(found.get("class", "")) + _names_in(found.get("id", ""))
        role = found.get("role", "").lower()
        body = found.get("itemprop", "").lower() == "articlebody" or any("".join(n) in CONTENT_NAMES for n in names)
        main = name == "main" or role == "main"
        content = main or name == "article" or (name in ("div", "section", "td") and (body or any(
            len(n) > 1 and n[0] in CONTENT_NAMES and n[-1] in ("content", "body", "text") for n in names)))
        boiler = (name in BOILER_TAGS or role in BOILER_ROLES or "hidden" in found or found.get("aria-hidden", "").lower() == "true"
                  or (name == "header" and not in_content))
        if not boiler and not main and not (name == "article" and body) and name not in ("html", "body"):
            boiler = any(n and not NOT_NAMES & set(n) and _boilerplate(n, in_content) for n in names)
        label = name + "." + ".".join(sorted("".join(n) for n in names if n and not any(x.isdigit() for x in n)))
        return _number(path, label), boiler, content


def parse(page: str | None, labels: Labels) -> list[tuple[int, str | None, bool, int]]:
    """Tokens in page order: (token, text of a block or None for a tag, boilerplate, content element or 0)."""
    page = page or ""
    out: list[tuple] = []
    stack: list[tuple[str, int, bool, int]] = []       # name, path, boilerplate, number of the outermost content element or 0
    held: list[str] = []
    here = ("", 0, False, 0)

    def flush():
        if held:
            text = " ".join(html.unescape("".join(held)).split())
            held.clear()
            if text:
                out.append((_number(here[1], "text", text), text, here[2], here[3]))

    def pop(n: int):
        nonlocal here
        del stack[n:]
        here = stack[-1] if stack else ("", 0, False, 0)

    at = contents = 0
    while True:
        m = TOKEN.search(page, at)
        if m is None:
            held.append(page[at:])
            break
        if m.start() > at:
            held.append(page[at:m.start()])
        at, tag = m.end(), m[0]
        named = NAME.match(tag)
        if not named:
            continue                                       # comment, doctype, processing instruction
        name = named[1].lower()
        block = name in BLOCK
        if block:
            flush()
        if tag[1] == "/":
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    pop(i)
                    break
            continue
        if block and name != "br":                         # a block ends an open paragraph, and siblings end each other
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == "p":
                    pop(i)
                    break
                if stack[i][0] in BLOCK:
                    break
            if name in SIBLINGS:
                ends, holders = SIBLINGS[name]
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] in holders:
                        break
                    if stack[i][0] in ends:
                        pop(i)
                        break
        path, boiler, content = labels.of(tag, name, here[1], here[3] > 0)
        if block:
            out.append((path, None, False, 0))
        if name in RAW:
            end = RAW_END[name].search(page, at)
            at = end.start() if end else len(page)
            continue
        if name not in VOID and not tag.endswith("/>"):
            if content and not here[3]:
                contents += 1
            here = (name, path, here[2] or boiler, here[3] or (contents if content else 0))
            stack.append(here)
    flush()
    return out


def page_tokens(pages: DataFrame) -> DataFrame:
    """(host, page, tokens): each different page of a host once; token 0 stands for the page itself.

    ``pages``: host number (null: none), html.  ``page`` is a hash of the page's tokens, ``layout`` one of
    its distinct tags with their paths; ``chars`` of a token are those of its text outside marked boilerplate.
    """

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labels = Labels()
        for batch in batches:
            keys: tuple = ([], [], [], [])
            cols: tuple = ([], [], [], [])
            ends = [0]
            for host, text in zip(*(batch.column(k).to_pylist() for k in range(2))):
                if host is None:
                    continue
                parsed = parse(text, labels)
                found = [t[0] for t in parsed]
                chars = {t[0]: len(t[1]) for t in parsed if t[1] is not None and not t[2]}
                times, first = Counter(found), {}
                for i, t in enumerate(found):
                    first.setdefault(t, i / len(found))
                times[0], first[0] = 1, 0.0
                layout = _number("layout", *sorted({t[0] for t in parsed if t[1] is None}))
                for c, v in zip(keys, (host, _number("page", *found), _number("copy", *found), layout)):
                    c.append(v)
                for t, n in times.items():
                    for c, v in zip(cols, (t, n, first[t], n * chars.get(t, 0))):
                        c.append(v)
                ends.append(len(cols[0]))
            held = pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.float64(), pa.int64()))],
                                              names=["token", "times", "place", "chars"])
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in keys), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), held)],
                                             names=["host", "page", "copy", "layout", "tokens"])

    parsed = pages.mapInArrow(emit, "host long, page long, copy long, layout long, "
                                    "tokens array<struct<token: long, times: int, place: double, chars: long>>")
    return parsed.dropDuplicates(["host", "page", "copy"])


def templates(once: DataFrame, support: float = 0.5, least_pages: int = 2, least_tokens: int = 3) -> DataFrame:
    """(host, template): array of (cls, place, token) of each host's candidate classes."""
    tokens = once.select("host", "page", F.inline("tokens"))
    part = lambda salt: F.pmod(F.xxhash64("page", "times", F.lit(salt)), F.lit(1 << 31))
    seen = tokens.groupBy("host", "token").agg(
        F.count(F.lit(1)).alias("n"), F.sum("times").alias("times"), F.sum(part(1)).alias("v1"), F.sum(part(2)).alias("v2"),
        F.avg("place").alias("place"))
    seen = materialize(seen.filter(F.col("n") >= least_pages), "page_tokens")
    hosts = seen.filter("token = 0").select("host", F.col("n").alias("pages"))
    often = seen.filter("token <> 0").join(hosts, "host").filter(F.col("n") >= F.col("pages") * support)
    vector = F.xxhash64("n", "times", "v1", "v2")
    classes = (often.groupBy("host", vector.alias("cls")).agg(F.collect_list(F.struct("place", "token")).alias("ts"))
                    .filter(F.size("ts") >= least_tokens))
    listed = classes.select("host", F.transform("ts", lambda t: F.struct("cls", t["place"].alias("place"), t["token"].alias("token"))).alias("ts"))
    return listed.groupBy("host").agg(F.array_sort(F.flatten(F.collect_list("ts"))).alias("template"))


def trusted(once: DataFrame, found: DataFrame, other: float = 0.5, own: float = 0.05) -> DataFrame:
    """``found`` without classes that are text: ``found``'s classes are judged by what their pages hold besides.

    A template stands on pages with text of their own.  If the pages of a class hold less than ``other`` of the
    text that the host's pages without it hold, the class is what an article and its near copies share.
    If all classes together leave less than ``own`` of the host's text, its pages are near copies of one, and none of its
    classes count.
    """

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: tuple = ([], [], [], [])
            classes: dict = {}
            for i, host in enumerate(batch.column(0).to_pylist()):
                if host not in classes:
                    if len(classes) > 500:
                        classes.clear()
                    token, cls = _fields(batch.column(2)[i], "token", "cls")
                    order = np.argsort(token)
                    classes[host] = token[order], cls[order]
                mine, names = classes[host]
                token, chars = _fields(batch.column(1)[i], "token", "chars")
                at = np.minimum(np.searchsorted(mine, token), len(mine) - 1)
                inside = mine[at] == token
                for cls in (None, *np.unique(names[at[inside]]).tolist()):
                    for c, v in zip(out, (host, cls, int(chars[~inside].sum()), int(chars.sum()))):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=["host", "cls", "rest", "text"])

    side = _side(found)
    held = (once.join(side, F.col("host") == F.col("_key")).select("host", "tokens", "template")
                .mapInArrow(measure, "host long, cls long, rest long, text long")
                .groupBy("host", "cls").agg(F.count(F.lit(1)).alias("n"), F.sum("rest").alias("rest"), F.sum("text").alias("text")))
    held = materialize(held, "template_rests")
    whole = held.filter("cls IS NULL").select("host", F.col("n").alias("pages"), F.col("rest").alias("all_rest"), "text")
    judged = held.filter("cls IS NOT NULL").drop("text").join(whole, "host")
    without = (F.col("all_rest") - F.col("rest")) / (F.col("pages") - F.col("n"))
    bad = (F.col("all_rest") < own * F.col("text")) | ((F.col("n") < F.col("pages")) & (F.col("rest") / F.col("n") < other * without))
    dropped = judged.filter(bad).groupBy("host").agg(F.collect_list("cls").alias("dropped"))
    kept = found.join(dropped, "host", "left").withColumn("dropped", F.coalesce("dropped", F.array().cast("array<bigint>")))
    lists = kept.select("host", F.filter("template", lambda t: ~F.array_contains("dropped", t["cls"])).alias("template"))
    return lists.filter(F.size("template") > 0)


def _fields(rows: pa.ListScalar, *names: str) -> list[np.ndarray]:
    """Columns of a list of structs."""
    return [rows.values.field(n).to_numpy(zero_copy_only=False) for n in names]


def _side(found: DataFrame) -> DataFrame:
    """``found`` as the side of a join by host (``_key``), broadcast if its measured size is small."""
    size = found.agg(F.count(F.lit(1)).alias("h"), F.sum(F.size("template")).alias("n")).first()
    return small(found.withColumnRenamed("host", "_key"), (size["n"] or 0) + size["h"], 64)


def deduce(found: list[int], classes: dict[int, list[int]]) -> set[int]:
    """Tokens of the classes that are ordered on this page and nested in each other."""
    where: dict[int, list[int]] = {}
    for i, t in enumerate(found):
        where.setdefault(t, []).append(i)
    accepted, spans = set(), []
    for tokens in sorted(classes.values(), key=lambda c: (-len(c), c)):
        at = [where.get(t) for t in tokens]
        if any(a is None or len(a) != len(at[0] or ()) for a in at):
            continue
        rounds = [list(r) for r in zip(*at)]               # one round of the class for each occurrence
        flat = [i for r in rounds for i in r]
        if any(a >= b for a, b in zip(flat, flat[1:])):
            continue                                       # not ordered
        if all(_nested(rounds, flat, outer) for outer in spans):
            spans.append(flat)
            accepted.update(tokens)
    return accepted


def _nested(rounds: list[list[int]], flat: list[int], outer: list[int]) -> bool:
    """Does every round of a class lie in one gap of ``outer``, or all of ``outer`` in one gap of the class?"""
    return all(bisect(outer, r[0]) == bisect(outer, r[-1]) for r in rounds) or bisect(flat, outer[0]) == bisect(flat, outer[-1])


def main_text(page: str | None, labels: Labels, classes: dict[int, list[int]], kept: set[int] = frozenset()) -> str:
    """Text of the page's slots; tokens in ``kept`` are no template whatever their class."""
    found = parse(page, labels)
    template = deduce([t[0] for t in found], classes) if classes else set()
    slots = [t for t in found if t[1] is not None and not t[2] and (t[0] not in template or t[0] in kept)]
    held = Counter()
    for t in slots:
        held[t[3]] += len(t[1])
    outside = held.pop(0, 0)
    marked = max(held.values(), default=0) >= outside
    return "\n".join(t[1] for t in slots if t[3] or not marked)


def extract(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", support: float = 0.5) -> DataFrame:
    """One row per input row: id, url, ``text``."""
    host = url_parts(F.col(url_col))[0]
    pages = df.select(F.when(host != "", F.xxhash64(host)).alias("_host"), F.col(html_col).alias("_html"),
                      F.col(id_col).alias("_id"), F.col(url_col).alias("_url"))
    once = materialize(page_tokens(pages.select("_host", "_html")), "different_pages")
    # Hosts of one page share the template of all such pages with the same layout.
    lone = once.groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.max("layout").alias("layout")).filter("n = 1").select(
        F.col("host").alias("_lone"), F.xxhash64(F.lit("layout"), "layout").alias("_group"))
    lone = materialize(lone, "lone_hosts")
    side = small(lone, lone.count(), 24)
    grouped = (once.join(side, F.col("host") == F.col("_lone"), "left")
                   .select(F.coalesce("_group", "host").alias("host"), "page", "tokens"))
    grouped = materialize(grouped, "page_groups")
    first = materialize(templates(grouped, support), "candidates")
    found = materialize(trusted(grouped, first), "templates")
    pages = pages.join(side, F.col("_host") == F.col("_lone"), "left").withColumn("_host", F.coalesce("_group", "_host")).drop("_lone", "_group")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labels, known = Labels(), {}
        for batch in batches:
            texts = []
            rows = zip(*(batch.column(k).to_pylist() for k in (2, 4)))
            for i, (key, page) in enumerate(rows):
                if key not in known:
                    if len(known) > 500:
                        known.clear()
                    classes: dict[int, list[int]] = {}
                    if batch.column(3)[i].is_valid:
                        for cls, token in zip(*(c.tolist() for c in _fields(batch.column(3)[i], "cls", "token"))):
                            classes.setdefault(cls, []).append(token)
                    known[key] = classes
                texts.append(main_text(page, labels, known[key]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["_id", "_url", "text"])

    joined = pages.join(_side(found), F.col("_host") == F.col("_key"), "left")
    kind = pages.schema["_id"].dataType.simpleString()
    out = joined.select("_id", "_url", "_key", "template", "_html").mapInArrow(read, f"_id {kind}, _url string, text string")
    return out.withColumnsRenamed({"_id": id_col, "_url": url_col})
