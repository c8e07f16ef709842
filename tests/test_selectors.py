"""Selectors on the stack of open elements against a matcher on trees."""

import re
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestone.operators import crawling as K
from lodestone.operators.selectors import Automaton, parse

TAGS = ("div", "p", "ul", "li", "a", "img")
WORDS = ("x", "y", "x-1", "Zed")


class Node:
    def __init__(self, tag, attributes, children):
        self.tag, self.attributes, self.children = tag, attributes, [] if tag == "img" else children
        self.parent, self.at = None, 0

    def html(self):
        start = "<" + self.tag + "".join(f' {k}="{v}"' for k, v in self.attributes.items()) + ">"
        return start if self.tag == "img" else start + "".join(c.html() for c in self.children) + f"</{self.tag}>"

    def walk(self):
        for k, c in enumerate(self.children):
            c.parent, c.at = self, k
            yield c
            yield from c.walk()


attributes = st.dictionaries(st.sampled_from(("id", "class", "data-k")), st.lists(st.sampled_from(WORDS), min_size=1, max_size=2).map(" ".join), max_size=2)
trees = st.recursive(st.builds(Node, st.sampled_from(TAGS), attributes, st.just([])), lambda inner: st.builds(Node, st.sampled_from(TAGS), attributes, st.lists(inner, max_size=4)), max_leaves=20)
simple = st.one_of(
    st.sampled_from(WORDS).map(lambda w: f".{w}"),
    st.sampled_from(WORDS).map(lambda w: f"#{w}"),
    st.just("[class]"),
    st.builds(lambda op, w, i: f'[data-k{op}"{w}"{i}]', st.sampled_from(("=", "~=", "|=", "^=", "$=", "*=")), st.sampled_from((*WORDS, "")), st.sampled_from(("", " i"))),
)
compound = st.builds(lambda t, s: t + "".join(s) if t or s else "*", st.sampled_from(("", "*", *TAGS)), st.lists(simple, max_size=2))
chain = st.builds(lambda first, rest: first + "".join(c + x for c, x in rest), compound, st.lists(st.tuples(st.sampled_from((" ", " > ", ">", " + ", " ~ ")), compound), max_size=3))
lists = st.lists(chain, min_size=1, max_size=3).map(", ".join)


def one_fits(node, text):
    """A compound, read anew from its text."""
    tag = re.match(r"[a-z]+|\*", text)
    if tag and tag[0] not in ("*", node.tag):
        return False
    classes = node.attributes.get("class", "").split()
    for kind, word in re.findall(r"([.#])([\w-]+)", re.sub(r"\[[^]]*\]", "", text)):
        if (kind == "." and word not in classes) or (kind == "#" and node.attributes.get("id") != word):
            return False
    for name, op, want, case in re.findall(r'\[([\w-]+)(?:([~|^$*]?=)"([^"]*)"( i)?)?\]', text):
        value = node.attributes.get(name)
        if value is None:
            return False
        if case:
            value, want = value.lower(), want.lower()
        ok = {"": True, "=": value == want, "~=": want != "" and want in value.split(), "|=": value == want or value[: len(want) + 1] == want + "-"}
        ok |= {"^=": want != "" and value.find(want) == 0, "$=": want != "" and value[-len(want) :] == want, "*=": want != "" and value.count(want) > 0}
        if not ok[op]:
            return False
    return True


def chain_fits(node, steps):
    """From right to left over the tree, trying every way."""
    *before, (sign, last) = steps
    if not one_fits(node, last):
        return False
    if not before:
        return True
    siblings = node.parent.children[: node.at]
    up = []
    p = node.parent
    while p is not None and p.parent is not None:
        up.append(p)
        p = p.parent
    ways = {" ": up, ">": up[:1], "+": siblings[-1:], "~": siblings}[sign]
    return any(chain_fits(w, before) for w in ways)


def steps_of(text):
    parts = re.split(r"\s*([>+~])\s*(?![^\[]*\])|\s+(?![^\[]*\])", text)
    out, sign = [], " "
    for k, part in enumerate(parts):
        if k % 2:
            sign = part or " "
        else:
            out.append((sign, part))
    return out


@settings(max_examples=400, deadline=None)
@given(st.lists(trees, max_size=4), lists)
def test_equal_to_tree_matcher(roots, selectors):
    page = Node("root", {}, roots)
    nodes = list(page.walk())
    want = [n for n in nodes if any(chain_fits(n, steps_of(s)) for s in selectors.split(", "))]
    marked = "".join(r.html() for r in roots)

    def depth(n):
        return 0 if n.parent is page else 1 + depth(n.parent)

    got = [(f["tag"], f["depth"]) for f in K._selected(marked, Automaton([selectors]))]
    assert got == [(n.tag, depth(n)) for n in want]


def test_parse():
    assert [[(c, x.tag) for c, x in s] for s in parse("a>B , * c~d+e")] == [[(" ", "a"), (">", "b")], [(" ", None), (" ", "c"), ("~", "d"), ("+", "e")]]
    for bad in ("", "a:hover", "a,,b", "> a", "a >", "[x=", "..a", ".a*", "a::before", "a|b", ","):
        with pytest.raises(ValueError):
            Automaton([bad])


PAGE = (
    "<html><head><title>T</title><meta name='description' content='d'></head><body><div class='top'><p>menu</p></div>"
    "<main id=m><div class='ad x'><article>sold</article></div><article><h2>A</h2><p>one <b>two</b></p><img class=ad src=s alt=z>"
    "<ul><li>k</ul></article><article>second</article></main><p>after"
)


def test_content_and_dropped():
    whole = K.clean_html(PAGE)["markdown"]
    assert "menu" in whole and "sold" in whole and "after" in whole and "![z](s)" in whole
    got = K.clean_html(PAGE, [".ad"], "#m article")
    assert got["markdown"] == "## A\n\none **two**\n\n- k" and got["title"] == "T" and got["meta"] == "d"
    assert K.clean_html(PAGE, [], "main > article")["markdown"].startswith("## A")
    assert K.clean_html(PAGE, [], "main article")["markdown"] == "sold"
    assert K.clean_html(PAGE, [], ".none")["markdown"] == whole
    assert K.clean_html(PAGE, ["main"], "article")["markdown"] == K.clean_html(PAGE, ["main"])["markdown"] == "menu\n\nafter"
    assert K.clean_html(PAGE, [], "img")["markdown"] == "![z](s)"
    assert K.clean_html(PAGE, ["div + article > p ~ *"], "article + article")["markdown"] == "second"
    assert K.clean_html(PAGE, [], "body > p")["markdown"] == "after"
    assert K.clean_html(None, ["a"], "b") == K.clean_html("") == {"title": "", "meta": "", "markdown": ""}


def test_elements_of_odd_pages(spark):
    pages = spark.createDataFrame([(1, "<p>a<p>b</div></p>c"), (2, None), (3, ""), (None, "<P CLASS='q'>x&amp;y<br>z</P>"), (1, "<p>a<p>b</div></p>c")], "page_id int, html string")
    got = sorted((str(r.page_id), r.position, r.tag, r.depth, r.text) for r in K.select_elements(pages, "p, br").collect())
    twice = [("1", 0, "p", 0, "abc"), ("1", 1, "p", 1, "b")]
    assert got == sorted([*twice, *twice, ("None", 0, "p", 0, "x&yz"), ("None", 1, "br", 1, "")])
    assert K.select_elements(pages.limit(0), "p").count() == 0
    with pytest.raises(ValueError):
        K.select_elements(pages, "p:first")
    with pytest.raises(ValueError):
        K.clean_pages(pages, drop=["p["])


def test_deep_page_takes_linear_time():
    t = time.monotonic()
    K.clean_html("<p>x</i>" * 100_000, ["div p"], "b")
    assert time.monotonic() - t < 20


def test_references_without_semicolon_stay_when_only_closed_ones_count(spark):
    page = '<title>a &amp b</title><h1 title="x&amp">cut &amp</h1><p>&lt;b&gt; &copy &#x27; &#39 &nosuch; A&B</p><style>h1 > p::after { content: "&amp" }</style>'
    pages = spark.createDataFrame([(1, "u", page), (2, "u", None)], "page_id long, url string, html string")
    told = {(r["tag"], r["text"]) for r in K.select_elements(pages, "h1, p, style", closed=True).collect()}
    assert told == {("h1", "cut &amp"), ("p", "<b> &copy ' &#39 &nosuch; A&B"), ("style", 'h1 > p::after { content: "&amp" }')}
    assert {r["text"] for r in K.select_elements(pages, "h1").collect()} == {"cut &"}
    assert K.clean_pages(pages, closed=True).where("page_id = 1").first()["title"] == "a &amp b"
