"""Web crawl operators: admission, links, frontier, cleaning to Markdown, quality verdicts."""

from __future__ import annotations

import functools
import operator
import re
from collections import Counter
from collections.abc import Callable, Iterator, Sequence
from html.entities import html5
from html.parser import HTMLParser

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import netloc, normalize_url, resolve_url
from .graphs import cut_lineage
from .selectors import Automaton, Selection

#: Markers of pages that stand between a reader and the content.
STRONG = ("cf-challenge", "cf-mitigated", "cf-please-wait", "/cdn-cgi/challenge-platform/")
TITLE, CHECKING = "<title>just a moment", "checking your browser"
WEAK = ("just a moment", "needs to review the security")
SKIPPED = ("#", "javascript:", "mailto:", "tel:")
HREF = r"(?is)<a\s[^>]*?href\s*=\s*[\"']([^\"']*)[\"']"


def raw_links(html: Column) -> Column:
    """Link targets of a page, without empty, fragment, script, mail and telephone ones."""
    found = F.transform(F.regexp_extract_all(html, F.lit(HREF), 1), lambda x: F.trim(x))
    return F.array_distinct(F.filter(found, lambda x: (x != "") & functools.reduce(operator.and_, (~F.startswith(F.lower(x), F.lit(s)) for s in SKIPPED))))


def links(pages: DataFrame, *, url: str = "url", html: str = "html") -> DataFrame:
    """``source, target`` absolute and normalised, each once."""
    each = pages.select(F.col(url).alias("source"), F.explode(raw_links(F.col(html))).alias("link"))
    return each.select("source", normalize_url(resolve_url("source", "link")).alias("target")).where("target is not null").distinct()


def admitted(url: Column, *, start: str | None = None, include: Sequence[str] = (), exclude: Sequence[str] = (), disallow: Sequence[str] = ()) -> Column:
    """Valid, on the start's host and port, allowed by robots rules, not excluded, and included (no patterns: all)."""
    ok = normalize_url(url).isNotNull()
    if start:
        ok &= netloc(url) == netloc(F.lit(start))
    path = F.regexp_extract(url, "^[A-Za-z]+://[^/?#]*(/[^#]*)?", 1)
    for rule in disallow:
        ok &= ~F.startswith(path, F.lit(rule))
    for p in exclude:
        ok &= ~F.coalesce(url.rlike(p), F.lit(False))
    if include:
        ok &= functools.reduce(operator.or_, (url.rlike(p) for p in include))
    return F.coalesce(ok, F.lit(False))


def robots_rules(text: str, agent: str = "*") -> list[str]:
    """Disallowed path prefixes for an agent, else for all."""
    groups: dict[str, list[str]] = {}
    names: list[str] = []
    fresh = False
    for line in text.splitlines():
        field, _, value = line.split("#")[0].partition(":")
        field, value = field.strip().lower(), value.strip()
        if field == "user-agent":
            names = [*names, value.lower()] if fresh else [value.lower()]
            fresh = True
        elif field:
            fresh = False
            if field == "disallow" and value:
                for n in names:
                    groups.setdefault(n, []).append(value)
    return groups.get(agent.lower(), groups.get("*", []))


def crawl(seeds: DataFrame, edges: DataFrame, *, max_depth: int, max_pages: int | None = None, admit: Callable[[Column], Column] | None = None, keep: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """``url, depth`` in breadth-first order over a link table: one anti-join for each depth.

    ``keep`` is applied to each depth's frontier to cut its lineage: a checkpoint, unless another way is given.
    """
    keep = keep or cut_lineage
    frontier = keep(seeds.select("url", F.lit(0).alias("depth")).distinct())
    seen = frontier
    for depth in range(1, max_depth + 1):
        new = frontier.join(edges, frontier["url"] == edges["source"]).select(F.col("target").alias("url")).distinct()
        if admit is not None:
            new = new.where(admit(F.col("url")))
        frontier = keep(new.join(seen, "url", "left_anti").withColumn("depth", F.lit(depth)))
        seen = seen.unionByName(frontier)
    return seen.orderBy("depth", "url").limit(max_pages) if max_pages else seen


class _Cleaner(HTMLParser):
    """Collects title, meta content and Markdown text."""

    DROP = ("script", "style", "noscript", "iframe", "svg")
    BLOCK = frozenset(("p", "div", "section", "article", "main", "header", "footer", "nav", "ul", "ol", "table", "tr", "blockquote", "pre", "br", "hr"))
    VOID = frozenset(("br", "hr", "img", "meta", "link", "input", "area", "base", "col", "embed", "source", "track", "wbr"))

    def __init__(self, drop: Automaton, content: Automaton | None = None):
        super().__init__(convert_charrefs=True)
        self.drop = Selection(drop)
        self.content = Selection(content) if content else None
        #: Where the first selected element begins and ends in ``out``, and the depth that it opened at.
        self.begin: int | None = None
        self.finish: int | None = None
        self.depth = 0
        self.skip, self.stack = 0, []
        #: How many elements of each tag are open, so that a step doesn't cost the depth.
        self.inside: Counter[str] = Counter()
        self.out: list[str] = []
        self.title: list[str] = []
        self.h1: list[str] = []
        self.meta: dict[str, str] = {}
        self.href: list[str] = []

    def _opened(self, tag: str, attrs: dict, void: bool) -> bool:
        """Follow both automata; whether the element is dropped.  The first selected one outside dropped ones is the content."""
        dropped = self.drop.start(tag, attrs, void=void)
        if self.content is not None:
            selected = self.content.start(tag, attrs, void=void)
            if selected and self.begin is None and not self.skip and not dropped:
                self.begin, self.depth = len(self.out), len(self.stack)
                if void:
                    self.finish = self.begin + 1
        return dropped

    def handle_starttag(self, tag, attrs):  # noqa: ANN001
        a = dict(attrs)
        if tag == "meta":
            name = (a.get("name") or a.get("property") or "").lower()
            if name:
                self.meta.setdefault(name, a.get("content") or "")
        dropped = self._opened(tag, a, tag in self.VOID)
        if tag in self.VOID:
            if not self.skip and not dropped:
                self.out.append({"br": "\n", "hr": "\n---\n", "img": f"![{a.get('alt') or ''}]({a.get('src') or ''})"}.get(tag, ""))
            return
        self.stack.append((tag, dropped))
        self.inside[tag] += 1
        self.skip += dropped
        if self.skip:
            return
        if re.fullmatch("h[1-6]", tag):
            self.out.append("\n\n" + "#" * int(tag[1]) + " ")
        elif tag == "li":
            self.out.append("\n- ")
        elif tag in ("td", "th"):
            self.out.append(" | ")
        elif tag in self.BLOCK:
            self.out.append("\n\n" if tag != "tr" else "\n")
        elif tag in ("b", "strong"):
            self.out.append("**")
        elif tag in ("i", "em"):
            self.out.append("*")
        elif tag == "code":
            self.out.append("`")
        elif tag == "a":
            self.href.append(a.get("href") or "")
            self.out.append("[")

    def handle_endtag(self, tag):  # noqa: ANN001
        while self.inside[tag]:
            t, dropped = self.stack.pop()
            self.inside[t] -= 1
            self.drop.end()
            if self.content is not None:
                self.content.end()
            if not self.skip:
                if t in ("b", "strong"):
                    self.out.append("**")
                elif t in ("i", "em"):
                    self.out.append("*")
                elif t == "code":
                    self.out.append("`")
                elif t == "a":
                    self.out.append(f"]({self.href.pop() if self.href else ''})")
                elif t in self.BLOCK or re.fullmatch("h[1-6]", t):
                    self.out.append("\n\n" if t != "tr" else " |")
            self.skip -= dropped
            if self.begin is not None and self.finish is None and len(self.stack) == self.depth:
                self.finish = len(self.out)
            if t == tag:
                return

    def handle_data(self, data):  # noqa: ANN001
        if self.inside["title"]:
            self.title.append(data)
            return
        if self.inside["h1"]:
            self.h1.append(data)
        if not self.skip and not self.inside["head"]:
            self.out.append(data if self.inside["pre"] else re.sub(r"\s+", " ", data))


#: Elements that hold text without references, and an ampersand with the reference that it may begin.
_AMPERSAND = re.compile(rf"<({'|'.join(HTMLParser.CDATA_CONTENT_ELEMENTS)})\b.*?(?:</\1\s*>|\Z)|&(#[0-9]+;|#x[0-9a-f]+;|[a-z][a-z0-9]*;)?", re.IGNORECASE | re.DOTALL)


def _closed_references(page: str) -> str:
    """The page with ampersands escaped that begin no reference with a semicolon at its end."""
    return _AMPERSAND.sub(lambda m: m[0] if m[1] or (m[2] and (m[2][0] == "#" or m[2] in html5)) else f"&amp;{m[0][1:]}", page)


def _rules(drop: Sequence[str], content: str | None) -> tuple[Automaton, Automaton | None]:
    return Automaton([*_Cleaner.DROP, *drop]), Automaton([content]) if content else None


def clean_html(html: str | None, drop: Sequence[str] = (), content: str | None = None) -> dict[str, str]:
    """``title, meta, markdown`` of a page: title, else first heading, else og:title; description and keywords.

    ``drop`` are CSS selectors of elements to leave out, besides scripts, styles and the like.  ``content`` selects what
    the Markdown is made of: the first such element outside dropped ones, or the whole page if there is none.  Both
    see the page as it stands, dropped elements included.
    """
    return _cleaned(html, *_rules(drop, content))


def _cleaned(html: str | None, drop: Automaton, content: Automaton | None) -> dict[str, str]:
    p = _Cleaner(drop, content)
    p.feed(html or "")
    p.close()
    squeeze = lambda parts: re.sub(r"\s+", " ", "".join(parts)).strip()
    markdown = re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]*\n[ \t]*", "\n", "".join(p.out[p.begin : p.finish]))).strip()
    meta = [p.meta.get("description", p.meta.get("og:description", "")).strip()]
    if p.meta.get("keywords"):
        meta.append(f"Keywords: {p.meta['keywords'].strip()}")
    return {"title": squeeze(p.title) or squeeze(p.h1) or p.meta.get("og:title", "").strip(), "meta": "\n".join(x for x in meta if x), "markdown": markdown}


def clean_pages(pages: DataFrame, *, key: str = "page_id", url: str = "url", html: str = "html", drop: Sequence[str] = (), content: str | None = None, closed: bool = False) -> DataFrame:
    """``key, url, title, meta, markdown`` as :func:`clean_html` gives them, over Arrow batches; a bad selector fails here, not in a task.

    Browsers take some references without their semicolon, ``&amp`` at the end of a cut text say; with ``closed`` those stay as they stand.
    """
    rules = _rules(drop, content)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                piece = b.slice(at, 256)
                got = [_cleaned(_closed_references(x or "") if closed else x, *rules) for x in piece.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([piece.column(0), piece.column(1), *(pa.array([g[c] for g in got], pa.string()) for c in ("title", "meta", "markdown"))], names=[key, url, "title", "meta", "markdown"])

    kind = dict(pages.dtypes)[key]
    return pages.select(key, url, html).mapInArrow(run, f"`{key}` {kind}, `{url}` string, title string, meta string, markdown string")


class _Selected(HTMLParser):
    """The elements of a page that an automaton selects, in the order of their start tags, with all text within each."""

    def __init__(self, rules: Automaton):
        super().__init__(convert_charrefs=True)
        self.rules = Selection(rules)
        self.open: list[tuple[str, int | None]] = []
        self.inside: Counter[str] = Counter()
        self.pieces: list[str] = []
        self.found: list[dict] = []

    def handle_starttag(self, tag, attrs):  # noqa: ANN001
        void = tag in _Cleaner.VOID
        at = None
        if self.rules.start(tag, dict(attrs), void=void):
            at = len(self.found)
            self.found.append({"tag": tag, "depth": len(self.open), "begin": len(self.pieces), "end": len(self.pieces) if void else None})
        if not void:
            self.open.append((tag, at))
            self.inside[tag] += 1

    def handle_endtag(self, tag):  # noqa: ANN001
        while self.inside[tag]:
            t, at = self.open.pop()
            self.inside[t] -= 1
            self.rules.end()
            if at is not None:
                self.found[at]["end"] = len(self.pieces)
            if t == tag:
                return

    def handle_data(self, data):  # noqa: ANN001
        self.pieces.append(data)


def _selected(html: str | None, rules: Automaton) -> list[dict]:
    p = _Selected(rules)
    p.feed(html or "")
    p.close()
    return [{"position": k, "tag": f["tag"], "depth": f["depth"], "text": "".join(p.pieces[f["begin"] : f["end"]])} for k, f in enumerate(p.found)]


def select_elements(pages: DataFrame, selectors: str, *, key: str = "page_id", html: str = "html", closed: bool = False) -> DataFrame:
    """``key, position, tag, depth, text`` of each element that a list of CSS selectors selects, in page order from 0.

    ``text`` is all text within the element, ``depth`` the number of elements around it.  An element that is never closed
    ends with its parent, or with the page.  Null and empty pages give no rows.  ``closed`` is that of :func:`clean_pages`.
    """
    rules = Automaton([selectors])
    element = pa.struct([("position", pa.int32()), ("tag", pa.string()), ("depth", pa.int32()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                piece = b.slice(at, 256)
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array([_selected(_closed_references(x or "") if closed else x, rules) for x in piece.column(1).to_pylist()], pa.list_(element))], names=[key, "_elements"])

    kind = dict(pages.dtypes)[key]
    found = pages.select(key, html).mapInArrow(run, f"`{key}` {kind}, _elements array<struct<position:int,tag:string,depth:int,text:string>>")
    return found.select(key, F.inline("_elements"))


def as_document(title: Column, url: Column, meta: Column, markdown: Column) -> Column:
    """A page as a Markdown document with a header block."""
    return F.concat(F.format_string("# %s\n\nSource: %s\n", title, url), F.when(meta != "", F.concat(F.lit("\n"), meta, F.lit("\n"))).otherwise(""), F.lit("\n"), markdown)


def challenge(body: Column) -> Column:
    """``strong``, ``weak`` or ``none`` by markers among the first 3000 characters.

    A title that asks to wait is strong together with the words about checking the browser; weak markers never add up to strong.
    """
    head = F.lower(F.substring(F.coalesce(body, F.lit("")), 1, 3000))
    has = lambda markers: functools.reduce(operator.or_, (F.contains(head, F.lit(m)) for m in markers))
    strong = has(STRONG) | (F.contains(head, F.lit(TITLE)) & F.contains(head, F.lit(CHECKING)))
    return F.when(strong, "strong").when(has(WEAK), "weak").otherwise("none")


def raw_verdict(body: Column) -> Column:
    """empty (no character at all), challenge or ok."""
    return F.when(body.isNull() | (body == ""), "empty").when(challenge(body) == "strong", "challenge").otherwise("ok")


@F.pandas_udf(T.IntegerType())
def readable_count(values: pd.Series) -> pd.Series:
    """Printable characters and line ends, as the language's own tables have them."""
    return values.map(lambda s: sum(c.isprintable() or c in "\n\r\t" for c in s) if s is not None else None).astype("Int32")


def text_verdict(text: Column, *, min_length: int = 10, readable: Column | None = None) -> Column:
    """empty, too_short, challenge, null_bytes, replacement_ratio, control_ratio, readable_ratio or ok.

    Under 200 characters three bad ones are enough; above, their share must also pass its limit.
    Without ``readable`` a character counts as unreadable if it is a control, format, unassigned or private one.
    """
    n = F.length(text)
    count = lambda form: F.regexp_count(text, F.lit(form))
    replaced, control = count("�"), count(r"[\x01-\x08\x0b\x0c\x0e-\x1f]")
    bad = n - readable if readable is not None else count(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f￾￿]")
    over = lambda k, limit: (k >= 3) & ((n < 200) | (k / n > limit))
    out = F.when(text.isNull() | (n == 0), "empty").when(n < min_length, "too_short").when(challenge(text) == "strong", "challenge").when(F.contains(text, F.lit("\x00")), "null_bytes")
    return out.when(over(replaced, 0.01), "replacement_ratio").when(over(control, 0.005), "control_ratio").when(over(bad, 0.15), "readable_ratio").otherwise("ok")


def valid_content(text: Column, min_length: int = 10) -> Column:
    return F.coalesce((F.length(text) >= min_length) & text.rlike(r"\S"), F.lit(False))


class _Rows(HTMLParser):
    """The rows of a table, each a list of its cells' texts."""

    def __init__(self) -> None:
        super().__init__()
        self.rows: list[list[str]] = []
        self.cell: list[str] | None = None

    def handle_starttag(self, tag, attrs):  # noqa: ANN001
        if tag == "tr":
            self.rows.append([])
        elif tag in ("td", "th"):
            self.cell = []

    def handle_endtag(self, tag):  # noqa: ANN001
        if tag in ("td", "th") and self.cell is not None and self.rows:
            self.rows[-1].append(_cell("".join(self.cell)))
            self.cell = None

    def handle_data(self, data):  # noqa: ANN001
        if self.cell is not None:
            self.cell.append(data)


def _cell(text: str) -> str:
    return re.sub(r"\s+", " ", text).strip().replace("|", r"\|")


_PLAIN_CELL = r"<t[dh]>[^<>&]*</t[dh]>"
#: A table of bare rows and cells, without attributes, references or other tags: its rows can be read off without a parser.
_PLAIN_TABLE = re.compile(rf"\s*<table>\s*(?:<tr>\s*(?:{_PLAIN_CELL}\s*)*+</tr>\s*)*+</table>\s*")
_CELLS = re.compile(r"<t[dh]>([^<>&]*)</t[dh]>")


def table_to_markdown(html: str) -> str:
    """An HTML table's rows as Markdown; the first row is the header."""
    if _PLAIN_TABLE.fullmatch(html):
        found = [[_cell(c) for c in _CELLS.findall(row)] for row in html.split("<tr>")[1:]]
    else:
        p = _Rows()
        p.feed(html)
        found = p.rows
    rows = [r for r in found if r]
    if not rows:
        return ""
    width = max(map(len, rows))
    line = lambda r: "| " + " | ".join(r + [""] * (width - len(r))) + " |"
    return "\n".join([line(rows[0]), "|" + " --- |" * width, *map(line, rows[1:])])
